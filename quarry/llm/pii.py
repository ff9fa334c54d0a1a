"""Personal data by candidate gradient boosting. DataFrame and SQL functions only on the main path.

Base rules (e-mail, IP, card, phone) find spans that always stay. High-recall generators, looser or
tighter than the base rules, propose further spans that may overlap them and each other: a card inside a longer run of
digits or written with dots, a phone number without its plus sign, an obfuscated or defanged address. Boosted trees
score each proposal from its format and its context, and a proposal is added when its score reaches the calibrated
threshold of its kind and it overlaps no base span and no added span of a higher score.

The trees are trained on the driver, from about ``SAMPLE_PROPOSALS`` proposals at most, ``TEXT_PROPOSALS`` of a text, in
about ``SAMPLE_DOCS`` documents (smallest hash of the id). Nobody has labelled spans here, and labels from the base rules alone would only teach the
rules again. So every sampled text gets some made-up items planted between its words: personal data in forms that the
base rules miss, and look-alikes (order numbers, versions, dates, decimals, failed checksums) that are none. A proposal
is positive if it is exactly a planted item of its kind or a base span, negative if it touches a planted look-alike,
cuts a planted item short, or fails its kind's check. Half of the documents fit the trees, the other half sets the
thresholds: the lowest score at which ``PRECISION`` holds. Scoring stays in the JVM, inside the row of the document: no
shuffle.

Edge cases: null and empty texts have no spans; a sample without both classes adds nothing (base spans only);
ties between overlapping proposals go to the earlier start, then the kind in the order listed; repeated
rows and null ids are scored like any other; an empty table gives an empty result; other columns are not read. All
passes over the matches of a text are linear but the one that settles overlaps between proposals over the threshold.
"""

from __future__ import annotations

import json
import random
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrays import empty, running
from quarry.llm.boosting import Boosted, boost
from quarry.llm.decontaminate import _settle
from quarry.llm.sampling import under_cover, uncovered
from quarry.session import cut

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 2000
SAMPLE_PROPOSALS = 10_000
TEXT_PROPOSALS = 50  # of one sampled text
PRECISION = 0.99
PLANTED_ITEMS = 600  # made-up items to draw from, of either class
PLANTED_EACH = 3  # in a sampled text

#: The base rules, written so that a match can only begin where a run of its characters begins (or the last match
#: ended) and never gives characters back: the same leftmost matches, in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: (kind, pattern): several patterns may propose spans of one kind.
GENERATORS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\[at\]|\(at\)|(?<= )at(?= )) ?[A-Za-z0-9-]{1,63}+(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot )[A-Za-z0-9-]{1,63}+){1,8}+"),
    ("ip", r"(?<![0-9])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![0-9])"),
    ("ip", r"(?<![0-9])[0-9]{1,3}+(?: ?(?:\[\.\]|\(\.\)|\.) ?[0-9]{1,3}+){3}(?![0-9])"),
    ("card", r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}([ ./-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}+|[0-9]{4}([ ./-])[0-9]{6}\2[0-9]{5})(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z+(./-])(?:00[0-9]{1,3}[ ./-]?)?(?:\([0-9]{3,5}\)|[0-9]{3,5})[ ./-]{1,2}[0-9]{3,4}[ ./-]?[0-9]{3,5}(?![0-9])"),
]
BEFORE, AFTER = 24, 8  # characters of context
_HINTS = {
    "email": "mail|contact|write|send|reach",
    "ip": "ip|host|addr|server|login|from",
    "card": "card|visa|credit|pay|debit",
    "phone": "tel|phone|call|fax|mobile|ring",
    "other": "order|version|ref|invoice|number|no[.]|id|total|on|isbn|release|v$",
}
FEATURES = [
    "kind", "generator", "n_digits", "n_chars", "n_other", "luhn", "octets", "n_groups", "before_word", "after_word", "before_digit", "after_digit", "before_quote", "dots", "has_at", "has_word_at", "has_bracket",
    "has_plus", "last_group", "hint_email", "hint_ip", "hint_card", "hint_phone", "hint_other",
]
_MATCH = "struct<s:int,k:int,e:int,m:string,b:string,a:string,j:int>"
_SPAN = "struct<s:int,k:int,e:int>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(x)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: F.coalesce(add(a, i), F.lit(0))) % 10 == 0)


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, "[^0-9]+"), lambda x: x.cast("double") <= 255)


def _passes(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    return {"email": F.lit(True), "ip": _octets(m), "card": n.between(14, 19) & _luhn(m), "phone": n.between(10, 15)}[kind]


def with_spans(docs: DataFrame) -> DataFrame:
    """Adds t (text), base spans and proposals, in order; each is made only where its first character occurs.

    A match carries its text and what stands around it, so that nothing is cut out of the whole text again.
    """
    rows = docs.withColumn("t", F.coalesce("text", F.lit("")))
    # what a text must hold for any match, looked for once
    gates = {
        "at": F.contains("t", F.lit("@")),
        "word_at": F.col("t").rlike(r"at[\])]|[ \[(]dot[ \])]| at "),
        "plus": F.contains("t", F.lit("+")),
        "octets": F.col("t").rlike(r"[0-9] ?[\[(]?\.[\])]? ?[0-9]"),
        "digits": F.col("t").rlike(r"[0-9][ ./)-]?[0-9][ ./)-]?[0-9]"),
    }
    rows = _settle(rows.withColumns({f"has_{k}": v for k, v in gates.items()}))
    at, octets, digits = F.col("has_at"), F.col("has_octets"), F.col("has_digits")
    has = {"email": at, "ip": octets, "card": digits, "phone": F.col("has_plus")}
    near = {"email": at | F.col("has_word_at"), "ip": octets, "card": digits, "phone": digits}
    jobs = [(i, BASE[k], has[k], -1) for i, k in enumerate(KINDS)] + [(KINDS.index(k), rx, near[k], j) for j, (k, rx) in enumerate(GENERATORS)]
    zipped = {}
    for c, (_, rx, some, _) in enumerate(jobs):
        gaps, found = F.split("t", rx, -1), F.regexp_extract_all("t", F.lit(rx), F.lit(0))
        placed = F.filter(F.arrays_zip(gaps.alias("g"), found.alias("m"), F.slice(gaps, 2, F.size(gaps)).alias("x")), lambda z: z["m"].isNotNull())
        zipped[f"z{c}"] = F.when(some & F.col("t").rlike(rx), placed).otherwise(empty("struct<g:string,m:string,x:string>"))
    rows = _settle(rows.withColumns(zipped))
    rows = _settle(rows.withColumns({f"m{c}": _placed(f"z{c}", k, j) for c, (k, _, _, j) in enumerate(jobs)}).drop(*zipped, *(f"has_{k}" for k in gates)))
    base = F.concat(*(_checked(f"m{i}", k) for i, k in enumerate(KINDS)))
    more = F.concat(*(F.col(f"m{c}") for c in range(len(KINDS), len(jobs))))
    return _settle(rows.withColumns({"base": F.array_sort(base), "proposed": F.array_sort(more)}).drop(*(f"m{c}" for c in range(len(jobs)))))


def _checked(matches: str, kind: str) -> Column:
    return F.filter(matches, lambda x: _passes(kind, x["m"]))


def _placed(zipped: str, kind: int, generator: int) -> Column:
    end = lambda at, z: at + F.length(z["g"]) + F.length(z["m"])

    def match(at: Column, z: Column) -> Column:
        return F.struct(
            (at + F.length(z["g"])).alias("s"), F.lit(kind).alias("k"), end(at, z).alias("e"), z["m"].alias("m"),
            F.substring(z["g"], -BEFORE, BEFORE).alias("b"), F.substring(z["x"], 1, AFTER).alias("a"), F.lit(generator).alias("j"),
        )

    return running(zipped, F.lit(0), end, match, _MATCH)


def described(proposals: str) -> Column:
    """Proposals as (s, k, e, m, x): with their features."""

    def one(p: Column) -> Column:
        m, before, after = p["m"], p["b"], p["a"]
        last, first = F.substring(before, -1, 1), F.substring(after, 1, 1)
        groups = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
        values = {
            "kind": p["k"],
            "generator": p["j"],
            "n_digits": F.length(_digits(m)),
            "n_chars": F.length(m),
            "n_other": F.length(m) - F.length(_digits(m)),
            "luhn": _luhn(m),
            "octets": F.when(p["k"] == 1, _octets(m)).otherwise(F.lit(False)),
            "n_groups": F.size(groups),
            "before_word": last.rlike("[A-Za-z]"),
            "after_word": first.rlike("[A-Za-z]"),
            "before_digit": before.rlike("[0-9][ .-]?$"),
            "after_digit": after.rlike("^[ .-]?[0-9]"),
            "before_quote": last.rlike("[\"'=]"),
            "dots": F.length(m) - F.length(F.replace(m, F.lit("."), F.lit(""))),
            "has_at": F.contains(m, F.lit("@")),
            "has_word_at": m.rlike(" at "),
            "has_bracket": m.rlike(r"[\[(]"),
            "has_plus": m.startswith("+"),
            "last_group": F.coalesce(F.length(F.try_element_at(groups, F.lit(-1))), F.lit(0)),
            **{f"hint_{k}": F.lower(before).rlike(rx) for k, rx in _HINTS.items()},
        }
        x = F.array(*(F.coalesce(values[f].cast("double"), F.lit(0.0)) for f in FEATURES))
        return F.struct(p["s"].alias("s"), p["k"].alias("k"), p["e"].alias("e"), m.alias("m"), x.alias("x"))

    return F.transform(proposals, one)


def made_up(seed: int = 5, n: int = PLANTED_ITEMS) -> list[dict]:
    """Items to plant: what leads to them, the item, what follows, and the kind (-1: a look-alike)."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9)))
    octet = lambda: str(rng.randint(0, 255))

    def card(valid: bool) -> str:
        body = rng.choice(["4", "51", "52", "37", "6011"])
        body += digits((14 if body == "37" else 15) - len(body))
        total = sum(int(c) if k % 2 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(reversed(body)))
        check = (10 - total % 10) % 10
        return body + str(check if valid else (check + rng.randint(1, 9)) % 10)

    def fours(d: str, sep: str) -> str:
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4)) if len(d) == 16 else sep.join((d[:4], d[4:10], d[10:]))

    def email() -> tuple[str, str, str]:
        a, b, tld = name(), name(), rng.choice(["com", "org", "net", "example", "de", "co"])
        at, dot = rng.choice([("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" at ", " dot "), (" @ ", "."), ("@ ", "."), ("[at]", "[dot]")])
        return rng.choice(["mail", "contact", "write to", "", "e-mail:"]), f"{a}{at}{b}{dot}{tld}", rng.choice(["", "for more", "today"])

    def ip() -> tuple[str, str, str]:
        sep = rng.choice(["[.]", "(.)", " . ", "[.]"])
        return rng.choice(["host", "ip", "from", "server", ""]), sep.join(octet() for _ in range(4)), rng.choice(["", "port 22", "failed"])

    def paid() -> tuple[str, str, str]:
        d = card(True)
        return rng.choice(["card", "visa", "pay with", ""]), rng.choice([fours(d, "."), fours(d, "/"), d]), rng.choice(["", card(True), "exp 12/27"])

    def phone() -> tuple[str, str, str]:
        a, b, c = digits(3), digits(3), digits(4)
        form = rng.choice(["({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "{a} {b} {c}", "0044 {a} {b} {c}", "0{a}/{b}{c}"])
        return rng.choice(["call", "tel", "phone:", "fax", ""]), form.format(a=a, b=b, c=c), rng.choice(["", "now", "ext 5"])

    def none() -> tuple[str, str, str]:
        what = rng.randrange(9)
        if what == 0:
            return "order", digits(rng.randint(13, 19)), ""
        if what == 1:
            return "ref", fours(card(False), rng.choice([" ", ".", "-"])), ""
        if what == 2:
            return rng.choice(["version", "release", "v"]), ".".join(str(rng.randint(256, 999)) for _ in range(4)), ""
        if what == 3:
            return "on", rng.choice([f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}"]), "at noon"
        if what == 4:
            return rng.choice(["look at", "we met at", "it was at", "sold at"]), f"{name()}.{name()}", name()
        if what == 5:
            return "total", f"{digits(3)}.{digits(3)}.{digits(3)}", rng.choice(["", "units"])
        if what == 6:
            return rng.choice(["invoice", "id", "number"]), f"{digits(4)}-{digits(4)}-{digits(rng.randint(3, 6))}", ""
        if what == 7:
            return "isbn", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", ""
        return "no.", f"{digits(3)} {digits(3)} {digits(5)}", ""

    makers = [email, ip, paid, phone]
    out = []
    for i in range(n):
        kind = i % 8 if i % 8 < 4 else -1
        lead, item, tail = makers[kind]() if kind >= 0 else none()
        out.append({"lead": f" {lead} " if lead else " ", "item": item, "tail": f" {tail} " if tail else " ", "kind": kind})
    return out


def planted(docs: DataFrame, salt: int) -> DataFrame:
    """Sampled texts with one made-up item at a word's end: doc_id, text, from_, to_, kind."""
    items = F.from_json(F.lit(json.dumps(made_up())), "array<struct<lead:string,item:string,tail:string,kind:int>>")
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(f"item{salt}")), F.lit(PLANTED_ITEMS)).cast("int")
    rows = docs.withColumn("i", F.get(items, drawn)).withColumn("w", F.split("text", " "))
    at = F.pmod(F.xxhash64("doc_id", "text", F.lit(f"place{salt}")), F.size("w") + 1).cast("int")
    rows = _settle(rows.withColumn("at", at))
    head = F.concat(F.array_join(F.slice("w", F.lit(1), F.col("at")), " "), F.col("i.lead"))
    rows = _settle(rows.select("doc_id", head.alias("head"), F.array_join(F.slice("w", F.col("at") + 1, F.size("w")), " ").alias("rest"), "i"))
    text = F.concat("head", "i.item", "i.tail", "rest")
    return rows.select("doc_id", text.alias("text"), F.length("head").alias("from_"), (F.length("head") + F.length("i.item")).alias("to_"), "i.kind")


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, precision: float = PRECISION, most: int = SAMPLE_PROPOSALS) -> tuple[Boosted, dict[int, float]] | None:
    """Trees and the threshold of each kind; None where the sample has not both classes."""
    usable = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    n = usable.count()
    if not n:
        return None
    hashed = F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(1 << 40))
    sample = usable.where(hashed < min(1 << 40, (1 << 40) * sample_docs // n))
    plants = [planted(sample, k) for k in range(PLANTED_EACH)]
    plain = sample.select("doc_id", "text", F.lit(0).alias("from_"), F.lit(0).alias("to_"), F.lit(-2).alias("kind"))
    for p in plants:
        plain = plain.unionByName(p)
    some = F.array_sort(F.transform("proposed", lambda p: F.struct(F.xxhash64("doc_id", "kind", p["s"], p["e"], p["j"]).alias("h"), p.alias("p"))))
    rows = _settle(with_spans(plain).withColumn("proposed", F.transform(F.slice(some, 1, TEXT_PROPOSALS), lambda x: x["p"])))
    rows = _settle(rows.withColumn("seen", described("proposed")))
    confirmed = lambda p: F.exists("base", lambda b: (b["s"] == p["s"]) & (b["e"] == p["e"]) & (b["k"] == p["k"]))
    rows = _settle(rows.select("doc_id", "from_", "to_", "kind", F.transform("seen", lambda p: F.struct(p.alias("p"), confirmed(p).alias("same"))).alias("seen")))
    each = rows.select("doc_id", "from_", "to_", "kind", F.explode("seen").alias("q")).select("doc_id", "from_", "to_", "kind", "q.p", "q.same")
    same = F.col("same")
    ok = F.coalesce(*(F.when(F.col("p.k") == i, _passes(k, F.col("p.m"))) for i, k in enumerate(KINDS)))
    touches = (F.col("p.s") < F.col("to_")) & (F.col("from_") < F.col("p.e"))
    exact = (F.col("p.s") == F.col("from_")) & (F.col("p.e") == F.col("to_")) & (F.col("p.k") == F.col("kind"))
    # where nothing is planted, a proposal whose check holds but that no base span confirms teaches nothing
    y = F.when(touches, exact | ((F.col("kind") >= 0) & same)).when(same, True).when(~ok, False)
    found = each.select("doc_id", "p.s", F.col("p.k").alias("k"), F.col("p.x").alias("x"), y.alias("y"), "kind").where("y is not null")
    found = cut(found.withColumn("h", F.pmod(F.xxhash64("doc_id", "s", "k", "kind", "x"), F.lit(1 << 40))))
    held = found.count()
    rows = found.where(F.col("h") < min(1 << 40, (1 << 40) * most // max(1, held))).select("h", F.col("doc_id").cast("string").alias("id"), "x", "y").toArrow()
    if not rows.num_rows:
        return None
    x, y = np.array(rows["x"].to_pylist(), float), rows["y"].to_numpy().astype(float)
    ids = rows["id"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (rows["h"][i].as_py(), ids[i], tuple(x[i]), y[i]))
    x, y, ids = x[order], y[order], [ids[i] for i in order]
    fit = np.array([zlib.crc32(f"half{i}".encode()) % 2 == 0 for i in ids])
    if len(set(y)) < 2 or len(set(y[fit])) < 2:
        return None
    model = boost(x[fit], y[fit])
    p, held = 1 / (1 + np.exp(-model.raw(x))), ~fit
    thresholds = {}
    for i in range(len(KINDS)):
        at = held & (x[:, 0] == i)
        scores = np.unique(p[at & (y == 1)])
        good = [s for s in scores if (y[at & (p >= s)]).mean() >= precision]
        thresholds[i] = max(0.5, float(min(good)) - 1e-9) if good else 2.0
    return model, thresholds


def _bare(spans: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def _apart(rows: DataFrame) -> DataFrame:
    """Leaves of ``proposed`` what overlaps no base span: two sweeps over both in order of their starts."""
    mark = "struct<s:int,t:int,e:int,i:int,hit:boolean>"

    def marked(spans: str, t: int) -> Column:
        return F.transform(spans, lambda x, i: F.struct(x["s"].alias("s"), F.lit(t).alias("t"), x["e"].alias("e"), i.alias("i"), F.lit(False).alias("hit")))

    def again(x: Column, hit: Column) -> Column:
        return F.struct(x["s"].alias("s"), x["t"].alias("t"), x["e"].alias("e"), x["i"].alias("i"), (x["hit"] | hit).alias("hit"))

    both = (F.size("base") > 0) & (F.size("proposed") > 0)
    rows = _settle(rows.withColumn("marks", F.when(both, F.array_sort(F.concat(marked("base", 0), marked("proposed", 1)))).otherwise(empty(mark))))
    ends = lambda at, x: F.when(x["t"] == 0, F.greatest(at, x["e"])).otherwise(at)
    starts = lambda at, x: F.when(x["t"] == 0, x["s"]).otherwise(at)
    rows = _settle(rows.withColumn("marks", F.reverse(running("marks", F.lit(-1), ends, lambda at, x: again(x, at > x["s"]), mark))))
    rows = _settle(rows.withColumn("marks", running("marks", F.lit(2147483647), starts, lambda at, x: again(x, at < x["e"]), mark)))
    free = F.transform(F.filter("marks", lambda x: (x["t"] == 1) & ~x["hit"]), lambda x: F.get("proposed", x["i"]))
    return _settle(rows.withColumn("proposed", F.when(both, free).otherwise(F.col("proposed"))).drop("marks"))


def detect(docs: DataFrame, model: tuple[Boosted, dict[int, float]] | None) -> DataFrame:
    """Adds ``base`` and ``spans`` (arrays of s, k, e) to the documents, and the text as ``t``."""
    rows = with_spans(docs)
    if model is None:
        return rows.withColumns({"base": _bare("base"), "spans": _bare("base")}).drop("proposed")
    trees, thresholds = model
    rows = _apart(rows)
    rows = _settle(rows.withColumn("seen", F.when(F.size("proposed") > 0, described("proposed"))).drop("proposed"))
    limit = lambda k: F.coalesce(*(F.when(k == i, F.lit(v)) for i, v in thresholds.items()))
    scored = F.transform("seen", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), trees.column(x["x"]).alias("p")))
    rows = _settle(rows.withColumn("scored", scored).drop("seen"))
    rows = _settle(rows.withColumn("good", F.array_distinct(F.filter("scored", lambda x: x["p"] >= limit(x["k"])))).drop("scored"))
    wins = "(y.p > x.p or (y.p = x.p and (y.s < x.s or (y.s = x.s and (y.k < x.k or (y.k = x.k and y.e > x.e))))))"
    added = F.expr(f"transform(filter(good, x -> not exists(good, y -> y.s < x.e and x.s < y.e and {wins})), x -> struct(x.s as s, x.k as k, x.e as e))")
    rows = rows.withColumn("base", _bare("base"))
    return _settle(rows.withColumn("spans", F.array_sort(F.concat("base", F.coalesce(added, empty(_SPAN))))).drop("good"))


def _written(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def pii(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_sha256 and all spans."""
    found = detect(docs.select("doc_id", "text"), train(docs))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))


BLOCK = 512


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one mark."""
    safe, names = under_cover(docs)
    found = detect(safe, train(docs.select("doc_id", "text")))
    some = F.size("spans") > 0
    # pieces are put together from blocks of the text, so that none is searched from the start again
    found = _settle(found.withColumn("blocks", F.when(some, F.regexp_extract_all("t", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))))
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def piece(a: Column, b: Column) -> Column:
        first = F.floor(a / BLOCK).cast("int")
        held = F.array_join(F.slice("blocks", first + 1, F.floor(b / BLOCK).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(held, a - first * BLOCK + 1, b - a)).otherwise(F.lit(""))

    def written(at: Column, x: Column) -> Column:
        return F.when(x["s"] >= at, F.concat(piece(at, x["s"]), F.element_at(marks, x["k"] + 1))).otherwise(F.lit(""))

    parts = running("spans", F.lit(0), lambda at, x: F.greatest(at, x["e"]), written, "string")
    done = F.concat(F.array_join(parts, ""), piece(F.array_max(F.transform("spans", lambda x: x["e"])), F.length("t")))
    found = found.withColumn("text", F.when(some, done).otherwise(F.col("text")))
    return uncovered(found, docs, names)
