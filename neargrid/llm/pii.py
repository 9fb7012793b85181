"""Personal data: generators propose spans, boosted trees on format and context select. DataFrame functions only."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neargrid.llm.common import cut, fields, quoted

#: Possessive loops run without recursion, and look-behinds let a run of characters be tried once.
_LOCAL = "A-Za-z0-9._%+-"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = ("email", "ip", "card", "phone", "email_text", "phone_local", "id_number")
#: Kinds whose rules are the fixed formats; the others' spans are selected by the trees.
FIXED = 4
_AT, _DOT = r"(?:\x20at\x20|\x20?\[at\]\x20?|\x20?\(at\)\x20?)", r"(?:\x20dot\x20|\x20?\[dot\]\x20?|\x20?\(dot\)\x20?|\.)"
#: Generators by kind. The first four are the fixed formats, the others looser ones that overlap them and each other.
GENERATORS = (
    rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    rf"(?<![A-Za-z0-9._-])[A-Za-z0-9][A-Za-z0-9._-]{{0,39}}{_AT}[A-Za-z0-9-]{{1,40}}(?:{_DOT}[A-Za-z][A-Za-z0-9-]{{1,20}}){{1,3}}(?![A-Za-z0-9-])",
    r"(?<![0-9A-Za-z+.,/-])(?:\([0-9]{2,5}\)[\x20.-]?)?[0-9]{2,5}(?:[\x20./-][0-9]{2,5}){1,4}(?![0-9A-Za-z-]|[.,/][0-9])",
    r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])",
)
#: Texts without these have no match of the generator.
NEEDED = ("@", "[0-9]\\.[0-9]", "[0-9][\\x20-]?[0-9]", "\\+[0-9]", r"\x20at\x20|[\[(]at[\])]", r"[0-9]{2}[\x20./)-][\x20.(/-]?[0-9]{2}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}")
#: Words before a span, by what they speak for.
CONTEXT = {
    "mail": "e-?mail|mail|write|reach|contact|contacto|schreib|correo|courriel",
    "phone": "call|tel|t\u00e9l|phone|telefon|t\u00e9l\u00e9phone|tel\u00e9fono|mobile|mobil|m\u00f3vil|fax|handy|whatsapp|sms|cell|ring|appelez|ll\u00e1ma(?:me)?",
    "identity": "ssn|social|security|iban|account|konto|compte|cuenta|sozialversicherung|tax|steuer|bank",
    "thing": "version|figure|table|section|isbn|issn|page|order|item|rev|no|nr|eq|part|serial|invoice|rechnung|commande|pedido|art|sku|model|build|ticket|case|lot|ref|chapter|seite|kapitel|volume|vol|since|from|between|in|on|scored|total|about",
}
BLOCK = 512


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _with_starts(d: DataFrame, k: int) -> DataFrame:
    """Column s{k}: starts of the matches m{k}, from their lengths and those of the text between.

    Sums go by blocks, so that a text with very many matches costs their number times BLOCK at most. Each column that
    a lambda reads is named twice, or else Catalyst would put its definition inside the lambda.
    """
    none = F.array().cast("array<bigint>")
    lengths = F.transform(f"m{k}", lambda m: F.length(m).cast("bigint"))
    d = d.withColumn(f"g{k}", F.when(F.size(f"m{k}") > 0, F.transform(F.split("t", GENERATORS[k], -1), lambda x: F.length(x).cast("bigint"))).otherwise(none))
    d = d.withColumn(f"p{k}", F.when(F.size(f"g{k}") > 0, F.zip_with(f"g{k}", F.concat(F.array(F.lit(0).cast("bigint")), lengths), lambda g, n: g + n)).otherwise(none))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(f"p{k}") / BLOCK).cast("int")), lambda b: _sum(F.slice(f"p{k}", b * BLOCK + 1, BLOCK)))
    d = d.withColumn(f"b{k}", F.when(F.size(f"p{k}") > 0, F.aggregate(blocks, F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))).otherwise(none))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    starts = F.transform(f"m{k}", lambda m, i: F.get(f"b{k}", block(i)) + _sum(F.slice(f"p{k}", block(i) * BLOCK + 1, i % BLOCK + 1)))
    return d.withColumn(f"s{k}", F.when((F.size(f"b{k}") > 0) & (F.size(f"p{k}") > 0), starts).otherwise(none))


def _luhn(digits: Column) -> Column:
    d = F.split(F.reverse(digits), "")
    value = F.transform(F.filter(d, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + (c.cast("int") * 2) % 10))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: int, m: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == 2:
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15) if kind == 3 else F.lit(False)


def _features(k: Column, m: Column, before: Column, after: Column) -> tuple[Column, ...]:
    """Format and context of a span as small integers."""
    n = lambda pattern: F.length(F.regexp_replace(m, pattern, ""))
    says = lambda words: before.rlike(rf"(?iu)(?:^|[^\p{{L}}])(?:{words})\W{{0,4}}(?:(?:is|me|us|at|:|#|number|numbers|nummer|mich|ist|est|es|code|under|unter|au|al)\W{{0,3}}){{0,2}}$").cast("int")
    digits = F.regexp_replace(m, "[^0-9]", "")
    return (
        k, F.least(F.floor(F.length(m) / 4), F.lit(9)), F.least(F.length(digits), F.lit(19)), F.least(n("[0-9A-Za-z\\x20]"), F.lit(6)), F.least(n("[^\\x20]"), F.lit(5)),
        F.length(F.regexp_extract(m, "^[^0-9]*([0-9]*)", 1)), F.least(F.length(F.regexp_extract(m, "([0-9]*)$", 1)), F.lit(9)), F.least(F.greatest(F.ascii(digits) - 47, F.lit(0)), F.lit(10)),
        F.size(F.array_distinct(F.split(F.regexp_replace(m, "[0-9A-Za-z]", ""), ""))), m.rlike(r"\(|\[").cast("int"), m.rlike(r"(?i)\Wdot\W").cast("int"),
        m.rlike(r"^[A-Za-z0-9-]*[._0-9][A-Za-z0-9._-]*[\x20\[(]").cast("int"), m.rlike(r"^(?:19|20)[0-9]{2}\D|\D(?:19|20)[0-9]{2}$").cast("int"), F.least(F.length(F.regexp_extract(m, "([A-Za-z]*)$", 1)), F.lit(6)),
        *(says(words) for words in CONTEXT.values()), before.rlike(r"[\p{Sc}%\x{20ac}=*/+]\s?$").cast("int"), after.rlike(r"^\s?(?:%|\p{Sc}|[a-z]{1,2}\b|:[0-9])").cast("int"),
    )


def propose(docs: DataFrame, carry: list[str]) -> DataFrame:
    """(text, ...) -> row (struct of `carry`), c: array {kind, start, end, base, x: features} of all generators' spans.

    Only spans of the looser kinds have features: format (lengths, digits, separators, groups, brackets) and context
    (words before that speak for mail, phones, identities or things, marks at the sides).
    """
    text = F.coalesce(quoted("text").cast("string"), F.lit(""))
    d = docs.select(fields(carry).alias("row"), text.alias("t"))
    for k, (pattern, needed) in enumerate(zip(GENERATORS, NEEDED, strict=True)):
        found = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
        d = d.withColumn(f"m{k}", F.when(F.col("t").rlike(needed), found).otherwise(F.array().cast("array<string>")))
    for k in range(len(GENERATORS)):
        d = _with_starts(d, k)

    def span(k: int):
        def one(m: Column, i: Column) -> Column:
            s = F.get(f"s{k}", i)
            e = s + F.length(m)
            x = F.array().cast("array<int>")
            if k >= FIXED:
                before = F.substring(F.col("t"), F.greatest(s - 39, F.lit(1)).cast("int"), F.least(s, F.lit(40)).cast("int"))
                x = F.array(*(f.cast("int") for f in _features(F.lit(k), m, before, F.substring(F.col("t"), (e + 1).cast("int"), F.lit(4)))))
            return F.struct(F.lit(k).alias("kind"), s.cast("int").alias("start"), e.cast("int").alias("end"), _valid(k, m).alias("base"), x.alias("x"))

        return F.transform(f"m{k}", one)

    return d.select("row", F.concat(*(span(k) for k in range(len(KINDS)))).alias("c"))


def planted(seed: int, n: int = 3000) -> list[tuple[str, int, int, bool]]:
    """Made-up texts (text, start, end, personal): personal data of the looser kinds, and as many lookalikes.

    What is personal is known from how it was made, not from the features: a text has a phone number, a spelt-out
    address or an identity number in a sentence that may or may not say so, or a date, an order number, a
    version, a sum or a phrase with 'at' in it.
    """
    rnd = random.Random(seed)
    pick = rnd.choice
    d = lambda k, first="0123456789": pick(first) + "".join(pick("0123456789") for _ in range(k - 1))
    name = lambda: pick(["anna", "joe", "m.keller", "s_lopez", "kim99", "li.wei", "jean-luc", "pat", "r2", "maria.b", "tom_h", "ola"])
    host = lambda: pick(["example", "site", "mail", "firma", "uni-x", "post", "web", "acme"])
    tld = lambda: pick(["com", "org", "net", "de", "fr", "es", "co", "info"])
    at, dot = lambda: pick([" at ", " [at] ", "[at]", "(at)", " (at) "]), lambda: pick([" dot ", " [dot] ", "[dot]", "(dot)"])

    def address() -> str:
        return name() + at() + host() + (dot() if rnd.random() < 0.75 else ".") + tld()

    def phone() -> str:
        s, area = pick(["-", " ", "."]), d(3, "23456789")
        us = f"{area}{s}{d(3, '23456789')}{s}{d(4)}"
        return pick([us, us, f"({area}) {d(3, '23456789')}-{d(4)}", f"({area}){d(3, '23456789')}-{d(4)}", f"0{d(3, '123456789')} {d(6)[:3]} {d(4)}", f"0{d(2, '123456789')}/{d(4)} {d(3)}", "0" + d(1, "1234567") + "".join(" " + d(2) for _ in range(4)), f"0{d(3, '123456789')}-{d(5)}"])

    def identity() -> str:
        ssn = f"{d(3, '012345678')}-{d(2)}-{d(4)}"
        return pick([ssn, ssn, pick(["DE", "FR", "ES", "NL", "GB"]) + d(2) + "".join((" " if rnd.random() < 2 else "") + d(4) for _ in range(pick([4, 5]))) + pick(["", " " + d(2)])])

    def thing() -> str:
        y, s = str(rnd.randrange(1950, 2035)), pick(["-", "/", "."])
        return pick([
            f"{y}{s}{rnd.randrange(10, 13)}{s}{rnd.randrange(10, 29)}", f"{rnd.randrange(10, 29)}{s}{rnd.randrange(10, 13)}{s}{y}", f"978-{d(1)}{d(1)}-{d(4)}-{d(3)}", f"{d(2)}-{d(4)}-{d(2)}", f"{d(3)} {d(3)} {d(3)}",
            f"{d(2)}.{d(2)}.{d(2)}", f"{y}-{rnd.randrange(1950, 2035)}", f"{d(4)}-{d(4)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(2)} {d(3)}", f"{d(3)}/{d(3)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(3, '1')}.{d(4)}",
        ])

    def phrase() -> str:
        return pick(["look", "meet", "sold", "shown", "live", "arrive", "aimed", "only", "stay", "anna"]) + " at " + pick([f"{host()}.{tld()}", f"noon dot {pick(['matrix', 'by', 'com'])}", f"{host()}.{pick(['Then', 'The', 'It', 'Some'])}", f"home.{pick(['But', 'And'])}"])

    fill = lambda: " ".join(pick("the of and zu der la que mountain table answer today nothing once again paper green water some more other people".split()) for _ in range(rnd.randrange(3, 9)))
    said = {
        address: ["mail", "e-mail me:", "write to", "contact", "reach me under", "correo:", "", "or"],
        phone: ["call", "phone:", "tel.", "Tel:", "Telefon", "call me at", "mobile number", "fax:", "WhatsApp", "cell is", "t\u00e9l.", "ring us at"],
        identity: ["SSN", "social security number", "IBAN", "account", "Konto", "bank account:", "my ssn is", "compte"],
    }
    things = ["order", "invoice no.", "version", "from", "between", "ISBN", "part", "ticket", "page", "since", "on", "scored", "total", "serial number", "Rechnung Nr.", "", "the", "about", "section", "lot"]
    out = []
    for _ in range(n):
        personal = rnd.random() < 0.5
        make = pick([address, phone, phone, identity])
        span = make() if personal else pick([thing, thing, thing, phrase])()
        lead = pick(said[make]) if personal else "" if " at " in span else pick(things)
        head = f"{fill()} {lead}".rstrip() + " "
        out.append((head + span + pick(["", ".", ", "]) + " " + fill(), len(head), len(head) + len(span), personal))
    return out


@dataclass
class Tree:
    """feature <= cut ? low : high; leaves are numbers."""

    feature: int
    cut: int
    low: Tree | float
    high: Tree | float

    def column(self, x: Column) -> Column:
        low, high = (n.column(x) if isinstance(n, Tree) else F.lit(float(n)) for n in (self.low, self.high))
        return F.when(F.get(x, F.lit(self.feature)) <= self.cut, low).otherwise(high)

    def value(self, x: tuple[int, ...]) -> float:
        n = self.low if x[self.feature] <= self.cut else self.high
        return n.value(x) if isinstance(n, Tree) else n


def boost(rows: list[tuple[tuple[int, ...], float, float]], trees: int = 12, depth: int = 3, rate: float = 0.4) -> list[Tree]:
    """Second-order gradient boosting of log-loss on weighted distinct feature vectors (x, positives, negatives)."""
    score = [0.0] * len(rows)
    out: list[Tree] = []
    features = len(rows[0][0]) if rows else 0

    def grow(at: list[int], g: list[float], h: list[float], left: int) -> Tree | float:
        sg, sh = sum(g[i] for i in at), sum(h[i] for i in at)
        best = (1e-6, None)
        for f in range(features) if left else ():
            by: dict[int, list[float]] = {}
            for i in at:
                s = by.setdefault(rows[i][0][f], [0.0, 0.0])
                s[0], s[1] = s[0] + g[i], s[1] + h[i]
            lg = lh = 0.0
            for v in sorted(by)[:-1]:
                lg, lh = lg + by[v][0], lh + by[v][1]
                gain = lg * lg / (lh + 1) + (sg - lg) ** 2 / (sh - lh + 1) - sg * sg / (sh + 1)
                if gain > best[0]:
                    best = (gain, (f, v))
        if best[1] is None:
            return rate * sg / (sh + 1)
        f, v = best[1]
        return Tree(f, v, grow([i for i in at if rows[i][0][f] <= v], g, h, left - 1), grow([i for i in at if rows[i][0][f] > v], g, h, left - 1))

    for _ in range(trees if rows else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [pos * (1 - q) - neg * q for q, (_, pos, neg) in zip(p, rows, strict=True)]
        h = [(pos + neg) * q * (1 - q) for q, (_, pos, neg) in zip(p, rows, strict=True)]
        tree = grow(list(range(len(rows))), g, h, depth)
        if not isinstance(tree, Tree):
            break
        out.append(tree)
        score = [s + tree.value(x) for s, (x, _, _) in zip(score, rows, strict=True)]
    return out


def calibrated(trees: list[Tree], rows: list[tuple[tuple[int, ...], float, float]], precision: float) -> float:
    """The least score over which held-out candidates are positive at `precision`; infinite if there is none."""
    scored = sorted(((sum(t.value(x) for t in trees), pos, neg) for x, pos, neg in rows), reverse=True)
    pos = neg = 0.0
    bound = math.inf
    for k, (s, p, n) in enumerate(scored):
        pos, neg = pos + p, neg + n
        if (k + 1 == len(scored) or scored[k + 1][0] < s) and pos / (pos + neg) >= precision:
            bound = s
    return bound


def train(spark: SparkSession, seed: int = 3, precision: float = 0.95) -> tuple[list[Tree], dict[int, float]]:
    """Trees and, for each looser kind, the least score that gives `precision`: the former from one set of `planted` texts, the latter from another.

    Proposals on planted texts are positive if they cover the planted personal span but for its ends. The sets are made
    here, so nothing of this grows with the data.
    """
    sets = [planted(seed), planted(seed + 1)]
    texts = [(k, *t) for k, part in enumerate(sets) for t in part]
    frame = spark.range(1).select(F.posexplode(F.split(F.lit("\x01".join(t[1] for t in texts)), "\x01")).alias("i", "text"))
    found: list[list[tuple]] = [[], []]
    for r in propose(frame, ["i"]).collect():
        k, _, s, e, personal = texts[r["row"]["i"]]
        covers = lambda c: c["start"] < e and c["end"] > s and abs(c["start"] - s) + abs(c["end"] - e) <= 6  # noqa: B023, E731
        found[k] += [(c["kind"], tuple(c["x"]), personal and covers(c)) for c in r["c"] if c["kind"] >= FIXED]

    def counted(rows: list[tuple]) -> list[tuple[tuple[int, ...], float, float]]:
        out: dict[tuple, list[float]] = {}
        for _, x, y in rows:
            out.setdefault(x, [0.0, 0.0])[not y] += 1
        return [(x, p, n) for x, (p, n) in sorted(out.items())]

    trees = boost(counted(found[0]), trees=25, depth=4)
    return trees, {k: calibrated(trees, counted([f for f in found[1] if f[0] == k]), precision) for k in range(FIXED, len(KINDS))}


def find_pii(docs: DataFrame, carry: list[str], precision: float = 0.95) -> DataFrame:
    """(text, ...) -> `row` (struct of `carry`), `base`, `pii`: arrays {kind, start, end, name} by kind and start.

    `base` are the fixed formats that hold their rules (octets, Luhn, counts of digits); a span of these formats that
    does not is never added. `pii` has these and those spans of the looser kinds (spelt-out addresses, local phone
    numbers, identity numbers) that boosted trees on format and context score over their kind's threshold, that
    overlap no base span and lie in no wider one of them (of equal ones the last kind stays). Trees and thresholds come from `train`: from texts whose personal data are known because they
    were put there. The trees are applied as CASE expressions.

    Offsets are code points, ends are exclusive. Null and empty texts have no spans; texts of any length are read whole.
    Repeated rows and ties each keep their row; an empty table gives no rows; other columns, whatever their names, are
    carried only if asked for. Texts are read once and not shuffled.
    """
    trees, bounds = train(docs.sparkSession, precision=precision)
    d = propose(docs, carry)
    d = cut(d.select("row", F.filter("c", lambda s: s["base"]).alias("base"), F.filter("c", lambda s: s["kind"] >= FIXED).alias("c")))

    def chosen(s: Column) -> Column:
        score = sum((t.column(s["x"]) for t in trees), F.lit(0.0))
        bound = F.get(F.array(*(F.lit(bounds[k] - 1e-9 if k >= FIXED else math.inf) for k in range(len(KINDS)))), s["kind"])
        inside = F.exists("base", lambda o: (o["start"] < s["end"]) & (o["end"] > s["start"]))
        return (s["kind"] >= FIXED) & (score >= bound) & ~inside

    def widest(s: Column) -> Column:
        return ~F.exists("more", lambda o: (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & ((o["end"] - o["start"] > s["end"] - s["start"]) | (o["kind"] > s["kind"])))

    name = lambda k: F.get(F.array(*map(F.lit, KINDS)), k)
    short = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), name(s["kind"]).alias("name"))))
    # each column that a lambda reads is stored: else Catalyst would put its definition inside the lambda
    d = cut(d.select("row", "base", F.filter("c", chosen).alias("more")))
    return d.select("row", short(F.col("base")).alias("base"), short(F.concat("base", F.filter("more", widest))).alias("pii"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")
