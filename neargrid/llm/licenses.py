"""Licence scan: known sentences to identifiers, and identifier sequences to ordered rules. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neargrid.llm.common import UPPER

#: Sentences of public licence texts and notices, lower case without punctuation, by identifier.
SENTENCES = {
    "mit.notice": "released under the mit license",
    "mit.notice2": "licensed under the mit license",
    "mit.title": "mit license",
    "mit.title2": "the mit license mit",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc.notice": "licensed under the isc license",
    "bsd.grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd2.notice": "licensed under the bsd 2 clause license",
    "bsd3.notice": "licensed under the bsd 3 clause license",
    "apache2.notice": "licensed under the apache license version 2.0",
    "apache2.notice2": "licensed under the apache license version 2.0 the license",
    "apache2.title": "apache license",
    "apache2.comply": "you may not use this file except in compliance with the license",
    "apache2.copy": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "apache2.released": "released under the apache license 2.0",
    "gpl3.notice": "this work is licensed under the gnu general public license version 3",
    "gpl2.notice": "this work is licensed under the gnu general public license version 2",
    "gpl.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl3.notice": "this work is licensed under the gnu lesser general public license version 3",
    "agpl3.notice": "this work is licensed under the gnu affero general public license version 3",
    "mpl2.notice": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "mpl2.copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
    "ccbynd.notice": "licensed under cc by nd 4.0",
    "ccbync.notice": "licensed under cc by nc 4.0",
    "ccbysa.notice": "licensed under cc by sa 4.0",
    "ccby.notice": "licensed under cc by 4.0",
    "cc0.notice": "released under cc0 1.0",
    "unlicense.notice": "this is free and unencumbered software released into the public domain",
    "rights.reserved": "all rights reserved",
}
#: Rules in order: at each place of a document's identifier sequence the first that matches takes its identifiers.
RULES = (
    ("MIT", "mit.title", "mit.grant", "mit.keep", "mit.asis"),
    ("MIT", "mit.grant", "mit.keep", "mit.asis"),
    ("MIT", "mit.grant", "mit.keep"),
    ("BSD-3-Clause", "bsd.grant", "bsd.source", "bsd.binary", "bsd.names"),
    ("BSD-2-Clause", "bsd.grant", "bsd.source", "bsd.binary"),
    ("Apache-2.0", "apache2.notice2", "apache2.comply", "apache2.copy"),
    ("Apache-2.0", "apache2.notice2", "apache2.comply"),
    ("Apache-2.0", "apache2.notice", "apache2.comply"),
    ("GPL-3.0-or-later", "gpl.free", "gpl.hope"),
    ("GPL-2.0-or-later", "gpl2.free", "gpl.hope"),
    ("MPL-2.0", "mpl2.notice", "mpl2.copy"),
    ("GPL-3.0-or-later", "gpl.free"),
    ("GPL-2.0-or-later", "gpl2.free"),
    ("MPL-2.0", "mpl2.notice"),
    ("MIT", "mit.notice"), ("MIT", "mit.notice2"), ("MIT", "mit.title"), ("MIT", "mit.title2"),
    ("ISC", "isc.grant"), ("ISC", "isc.notice"),
    ("BSD-2-Clause", "bsd2.notice"), ("BSD-3-Clause", "bsd3.notice"),
    ("Apache-2.0", "apache2.notice2"), ("Apache-2.0", "apache2.notice"), ("Apache-2.0", "apache2.released"), ("Apache-2.0", "apache2.copy"),
    ("GPL-3.0", "gpl3.notice"), ("GPL-2.0", "gpl2.notice"), ("LGPL-3.0", "lgpl3.notice"), ("AGPL-3.0", "agpl3.notice"),
    ("CC-BY-ND-4.0", "ccbynd.notice"), ("CC-BY-NC-4.0", "ccbync.notice"), ("CC-BY-SA-4.0", "ccbysa.notice"), ("CC-BY-4.0", "ccby.notice"), ("CC0-1.0", "cc0.notice"),
    ("Unlicense", "unlicense.notice"), ("proprietary", "rights.reserved"),
)
#: Line ends, ';' and ':' may stand in a known sentence; HARD cuts only where the sentence has them.
HARD = r"[.!?][;:]*[ \t\r\n]+|(?:\r\n?+|\n)[ \t]*+[\r\n][ \t\r\n]*"
SOFT = r"[;:][ \t]+|[\r\n]+"
CUTS = {"v. 2.0": "v|2.0", " at http ": " at|http "}
#: Besides RULES.
ALONE = (("MPL-2.0", "mpl2.copy"),)


def _body(sentence: str) -> str:
    """A pattern for a known sentence in a text that `marked` gave."""
    for plain, hard in CUTS.items():
        sentence = sentence.replace(plain, hard)
    out = sentence.replace(".", r"\.").replace(" ", "[ ~]").replace("|", "[ ~|]")
    return out.replace("http[", "https?[")


def marked(text: Column) -> Column:
    """Words by single blanks, '|' where sentences end for certain and '~' where they may, both without blanks beside them."""
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + "|~", UPPER.lower() + ",,")
    t = F.regexp_replace(F.regexp_replace(t, HARD, "|"), SOFT, "~")
    t = F.concat(F.lit("|"), F.regexp_replace(t, r"[^a-z0-9.|~]+", " "), F.lit("|"))
    return F.regexp_replace(F.regexp_replace(t, r"(?<![ .~])[ .~]*+\|[ .~|]*", "|"), r"(?<![ .])[ .]*+~[ .~]*", "~")


def _words(rule: tuple[str, ...]) -> str:
    return "".join(f"<{s}>" for s in rule[1:])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> one row per row: doc_id, n_known, sentences, licenses, n_licenses.

    `sentences` are the identifiers of the known sentences in order, `licenses` those of the rules that match, in
    order of their first match, once each; both are joined by commas. A sentence may be wrapped: a single line end is a
    blank in it, and blank lines end it; of sentences that start at one place the longest counts. A rule matches
    identifiers that follow each other among the known sentences, whatever unknown ones stand between; at each place
    the first rule that matches takes its identifiers, and later matches start after them. Null and empty texts have
    neither; texts of any length are read whole. Repeated rows keep a row each; an empty table gives none; other columns are ignored. The known sentences
    are fixed, so nothing that is sent along grows with the data, and no text is shuffled.
    """
    bodies = "|".join(_body(s) for s in sorted(SENTENCES.values(), key=len, reverse=True))
    known = F.regexp_extract_all(marked(F.col("text")), F.lit(f"(?<=[|~])({bodies})(?=[|~])"), F.lit(1))
    plain = lambda s: F.regexp_replace(F.regexp_replace(s, "[|~]", " "), " https ", " http ")
    name = F.create_map(*(F.lit(x) for k, v in SENTENCES.items() for x in (v.replace("v. 2.0", "v 2.0"), k)))
    d = docs.select("doc_id", F.transform(known, lambda s: F.element_at(name, plain(s))).alias("ids"))
    rules = RULES + ALONE
    sequence = F.concat(F.lit(""), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), ""))
    pattern = "|".join(_words(r).replace(".", r"\.") for r in rules)
    license_ = F.create_map(*(F.lit(x) for r in rules for x in (_words(r), r[0])))
    found = F.array_distinct(F.transform(F.regexp_extract_all(sequence, F.lit(f"({pattern})"), F.lit(1)), lambda m: F.element_at(license_, m)))
    d = d.withColumn("found", F.when(F.size("ids") > 0, found).otherwise(F.array().cast("array<string>")))
    return d.select("doc_id", F.size("ids").cast("bigint").alias("n_known"), F.array_join("ids", ",").alias("sentences"), F.array_join("found", ",").alias("licenses"), F.size("found").cast("bigint").alias("n_licenses"))


def oracle() -> str:
    """The scan in SQL: the same fixed sentences and rules, but cuts, marks and matches found without look-around or possessive loops.

    Each cut is written twice, so that a match can take one half on either side and leave the other to its neighbour.
    """
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    gap = lambda s: s.replace(" ", "(?: |~~)").replace("\x00", "(?: |~~|[|][|])")
    body = lambda s: gap(s.replace(".", "[.]").replace("v[.] 2", "v\x002").replace(" at http ", " at\x00https? ").replace(" http ", " https? "))
    bodies = "|".join(body(s) for s in sorted(SENTENCES.values(), key=len, reverse=True))
    rules = RULES + ALONE
    known = "MAP {" + ", ".join(f"{quoted(v.replace('v. 2.0', 'v 2.0'))}: {quoted(k)}" for k, v in SENTENCES.items()) + "}"
    chosen = "MAP {" + ", ".join(f"{quoted(_words(r))}: {quoted(r[0])}" for r in rules) + "}"
    pattern = "|".join(_words(r).replace(".", "[.]") for r in rules)
    return f"""
    WITH a AS (
      SELECT doc_id, translate(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '{UPPER}|~', '{UPPER.lower()},,') AS t FROM documents
    ), b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[.!?][;:]*[ \\t\\r\\n]+|[\\r\\n][ \\t]*[\\r\\n][ \\t\\r\\n]*', '|', 'g'), '[;:][ \\t]+|[\\r\\n]+', '~', 'g') AS t FROM a
    ), c AS (SELECT doc_id, regexp_replace(regexp_replace('|' || regexp_replace(t, '[^a-z0-9.|~]+', ' ', 'g') || '|', '[ .~]*[|][ .~|]*', '||', 'g'), '[ .]*~[ .~]*', '~~', 'g') AS t FROM b
    ), s AS (SELECT doc_id, list_transform(regexp_extract_all(t, '[|~]({bodies})[|~]', 1), lambda x: replace(regexp_replace(x, '[|~]+', ' ', 'g'), ' https ', ' http ')) AS l FROM c
    ), i AS (SELECT doc_id, list_transform(l, lambda x: {known}[x]) AS ids FROM s
    ), m AS (SELECT doc_id, ids, list_transform(regexp_extract_all(list_aggregate(list_concat([''], list_transform(ids, lambda x: '<' || x || '>')), 'string_agg', ''), '{pattern}'), lambda x: {chosen}[x]) AS l FROM i
    ), d AS (SELECT doc_id, ids, list_transform(list_filter(list_transform(l, lambda x, k: {{'x': x, 'first': list_position(l, x) = k}}), lambda z: z.first), lambda z: z.x) AS found FROM m)
    SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, array_to_string(ids, ',') AS sentences, array_to_string(found, ',') AS licenses, CAST(len(found) AS BIGINT) AS n_licenses FROM d"""
