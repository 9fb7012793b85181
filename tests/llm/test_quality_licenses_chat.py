import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest

from neargrid.llm import chat, licenses, quality, queries

SF = "/root/testdata/sf0.01"


def oracle(sql, tables):
    c = duckdb.connect()
    for name, frame in tables.items():
        c.register(name, frame.toArrow()) if not isinstance(frame, Path) else c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{frame}'")
    return sorted(c.execute(sql).fetchall(), key=str)


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.resample(docs, labels.where("doc_id % 2 = 0"), ["doc_id"]).select("row.doc_id", "sampled", "log_weight")
    assert out.count() == docs.count()
    rows = out.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = ([r.sampled for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.05, (np.mean(good), np.mean(bad))


def test_quality_cases(spark):
    rows = [(1, "plain good words here", "x"), (2, None, "x"), (3, " \n", "x"), (4, "BAD!! BAD!! BAD!!", "x"), (4, "BAD!! BAD!! BAD!!", "x"), (None, "plain good words", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = quality.resample(docs, spark.createDataFrame([(1, 1, 9), (4, 0, 9), (4, 0, 9), (77, 1, 9), (1, None, 9)], "doc_id long, quality int, _id int"), ["doc_id"]).collect()
    assert {str(r.row.doc_id): r.sampled for r in got} == {"1": True, "2": False, "3": False, "4": False, "None": True} and len(got) == 6
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert sum(r.sampled for r in quality.resample(docs, none, ["doc_id"]).collect()) == 4
    assert quality.resample(docs.limit(0), none, ["doc_id"]).collect() == []
    assert quality.select_good(docs, none).columns == docs.columns


def test_quality_of_one_id_with_many_texts(spark):
    rows = [(1, "plain good words here")] + [(4, f"BAD!! BAD!! BAD!! {i}") for i in range(40)] + [(4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = quality.resample(docs, spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int"), ["doc_id"]).collect()
    assert len(got) == len(rows) and [r.sampled for r in got if r.row.doc_id == 1] == [True]


def test_kth_key(spark):
    x = [random.Random(1).gauss(0, 5) for _ in range(5000)] + [1.5] * 50
    rows = spark.createDataFrame([(v,) for v in x], "key double")
    for k in (1, 17, 2500, 5050):
        assert quality._kth(rows, "key", k) == sorted(x, reverse=True)[k - 1]


def test_licenses(spark, monkeypatch):
    mit = "MIT License\n\nCopyright (c) 2024 X\n\n" + ". ".join(licenses.SENTENCES[k] for k in ("mit.grant", "mit.keep", "mit.asis")) + "."
    rows = [(1, mit), (2, "Foo. Released under the MIT License.\nLicensed under the Apache License, Version 2.0."), (3, None), (4, ""), (5, "Licensed under CC BY-NC 4.0."), (5, "Licensed under CC BY-NC 4.0."), (6, "é\nAll  rights   reserved!\nLicensed under CC-BY-4.0"), (7, "x. " * 20_000), (None, "released under the mit license; all rights reserved: z")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    got = sorted(map(tuple, licenses.scan(docs).collect()), key=str)
    assert {r[0]: r[3] for r in got} == {1: "MIT", 2: "MIT,Apache-2.0", 3: "", 4: "", 5: "CC-BY-NC-4.0", 6: "proprietary,CC-BY-4.0", 7: "", None: "MIT,proprietary"}
    assert got == oracle(licenses.oracle(), {"documents": docs})
    assert licenses.scan(docs.limit(0)).collect() == []
    real = oracle(licenses.oracle(), {"documents": Path(SF, "documents.parquet")})
    assert sorted(map(tuple, queries.op8_licenses(spark, SF).collect()), key=str) == real and any(r[4] for r in real)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
"""
BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
MPL2 = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE2 = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law"""


def test_wrapped_licenses(spark):
    gpl2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
    comment = "\n".join(f" * {line}" for line in MIT.splitlines())
    mit = "mit.grant,mit.keep,mit.asis"
    cases = [
        (MIT, mit, "MIT"), (MIT.replace("\n", "\r\n"), mit, "MIT"), (comment, mit, "MIT"),
        (BSD3, "bsd.grant,bsd.source,bsd.binary,bsd.names", "BSD-3-Clause"),
        (GPL3, "gpl.free,gpl.hope", "GPL-3.0-or-later"), (" ".join(GPL3.split()), "gpl.free,gpl.hope", "GPL-3.0-or-later"), (gpl2, "gpl2.free,gpl.hope", "GPL-2.0-or-later"),
        (MPL2, "mpl2.notice,mpl2.copy", "MPL-2.0"), (MPL2[MPL2.index("If") :], "mpl2.copy", "MPL-2.0"),
        (APACHE2, "apache2.notice2,apache2.comply,apache2.copy", "Apache-2.0"),
        ("Released under the\n\nMIT License", "mit.title", "MIT"), ("Released under the\r\nMIT | License ~\n \t\r\nfoo", "mit.notice", "MIT"),
        ("Released under the. MIT licenses\n" + "." * 50_000 + " " * 50_000 + "x", "", ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(cases)], "doc_id long, text string")
    assert [(r.sentences, r.licenses) for r in licenses.scan(docs).orderBy("doc_id").collect()] == [tuple(c[1:]) for c in cases]
    assert sorted(map(tuple, licenses.scan(docs).collect()), key=str) == oracle(licenses.oracle(), {"documents": docs})


def test_mixed_licenses_as_sql(spark):
    """Sentences wrapped, cut and joined at random: the scan and the SQL agree."""
    rnd = random.Random(9)
    known, gaps = list(licenses.SENTENCES.values()), [" ", "\n", "\r\n", "\r", " \n ", "\n\n", "; ", ": ", ". ", ".\n", "~", "|", " - ", "!! ", "\t"]
    texts = []
    for _ in range(400):
        words = " ".join(rnd.choice(known + ["foo", "the end"]) for _ in range(rnd.randrange(1, 5))).split(" ")
        texts.append("".join(w.upper() * (rnd.random() < 0.1) or w for w in (x + (rnd.choice(gaps) if rnd.random() < 0.15 else " ") for x in words)))
    texts += [rnd.choice(gaps).join(rnd.choice(known) for _ in range(rnd.randrange(1, 6))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, licenses.scan(docs).collect()), key=str)
    assert got == oracle(licenses.oracle(), {"documents": docs}) and sum(r[4] > 0 for r in got) > 200


@pytest.mark.parametrize("limit", [500_000, 0])
def test_chat(spark, monkeypatch, limit):
    monkeypatch.setattr(chat, "BROADCAST_ROWS", limit)
    rnd = random.Random(2)
    base = [[("user", rnd.choice("ab")), ("assistant", rnd.choice("cd")), ("user", rnd.choice("ef")), ("assistant", "g")][: rnd.randrange(1, 5)] for _ in range(40)]
    rows = [(i * 7 % 101, k, *x) for i, c in enumerate(base) for k, x in enumerate(c)]
    rows += [(500, None, None, None), (500, 1, "user", None), (501, 3, "b", "x"), (501, 3, "a", "y"), (None, 0, "user", "n"), (0, 0, *base[0][0])]
    rows += [(None, 4, "user", "n"), (None, 0, *base[3][0]), (None, None, None, "only"), (None, 1, None, "only")]  # of no conversation: one of its own each
    rows += [(600, k, "user", f"turn {k}") for k in range(-3, 2500)] + [(601, k, "user", f"turn {k}") for k in range(-3, 2000)] + [(602, -3, "user", "turn -3"), (602, 5000, "a", "z" * 100_000)]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, i string").repartition(5)
    got = sorted(map(tuple, chat.maximal_conversations(turns).collect()), key=str)
    assert got == oracle(chat.ORACLE, {"conversations": turns})
    assert [r[1:4] for r in got if r[0] is None] == [(1, 2, 0), (1, 2, 0)] and sorted(r[3] for r in got if r[0] == 600) == [0, 1, 2] and not any(r[0] == 601 for r in got)
    assert chat.maximal_conversations(turns.limit(0)).collect() == []


def test_chat_table(spark):
    real = oracle(chat.ORACLE, {"conversations": Path(SF, "conversations.parquet")})
    assert sorted(map(tuple, queries.op9_chat(spark, SF).collect()), key=str) == real


def test_native_plans(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    turns = spark.createDataFrame([(1, 1, "a", "b")], "conv_id long, turn long, role string, text string")
    for frame in (licenses.scan(docs), chat.maximal_conversations(turns)):
        assert not re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().executedPlan().toString())
