"""Personal data: base patterns, and further spans by weak supervision; DataFrame functions only.

Labelers (patterns, gazetteers, contexts) vote on each candidate token.  The votes of all documents are counted by
their combination, expectation-maximisation over these counts (a SQL ``aggregate``, no rows but the table of
combinations) estimates how far each labeler can be trusted, and the votes' posteriors train the span
classifier, log-odds of a candidate's shape and context, that decides which spans are added.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut

#: The base patterns.  Possessive quantifiers and \G only keep the search linear; the matches are those of the plain
#: patterns email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+),
#: card [0-9]([\x20-]?[0-9])+ and phone \+[0-9][\x20().0-9-]+[0-9].
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no match of the pattern.
HINTS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?+){16}", "phone": r"\+[0-9]"}

#: Fixed word lists of the gazetteer and context labelers.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|br"
SECRET_WORDS = "password|passwd|pwd|secret|token|api_?key|access_?key"
CONTACT_WORDS = "e-?mail|mail|tel|phone|call|fax|mobile|card|visa|account|iban|ssn|login|user|contact|address"
PLAIN_WORDS = "version|licen[cs]e|cc|by|page|chapter|section|figure|table|no|volume|year|line|step"

#: A word with a digit or an at sign, with the name and sign in front of a value ("password=", "token = ").
CANDIDATE = rf"(?<![^\s])(?:(?:{SECRET_WORDS})\x20?[=:]\x20?\S++|[^\s0-9@]*+[0-9@]\S*+)"
_ROUNDS, _SMOOTH = 25, 0.5
LABELERS = ("personal pattern", "secret pattern", "gazetteer", "context", "shape", "base match")


#: Matches whose lengths are added up together, and code points of a cell, so that long texts with many matches take no quadratic time.
RUN, CELL = 64, 4096


def _running(sizes: Column) -> Column:
    """Sums of all elements before each one: of whole runs by one pass over the runs, and of the rest within a run."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int")), lambda k: F.aggregate(F.slice(sizes, k * RUN + 1, F.lit(RUN)), F.lit(0), lambda t, x: t + x))
    before = F.aggregate(runs, F.array(F.lit(0)), lambda t, x: F.concat(t, F.array(F.element_at(t, -1) + x)))
    held = F.struct(before.alias("before"), sizes.alias("sizes"))
    one = lambda h: F.transform(h["sizes"], lambda _, i: F.get(h["before"], (i / RUN).cast("int")) + F.aggregate(F.slice(h["sizes"], i - i % RUN + 1, i % RUN), F.lit(0), lambda t, x: t + x))
    return F.get(F.transform(F.array(held), one), F.lit(0))


def _spans(text: Column, pattern: str, hint: str) -> Column:
    """Matches of ``pattern`` as structs s, e (code points), m (match), l (the text before it), r (after it).

    The text between matches (``split``) and the matches (``regexp_extract_all``) alternate, so running
    lengths are the positions.
    """
    found = F.when(text.rlike(hint), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0)))
    empty = F.array().cast("array<struct<s:int,e:int,m:string,l:string,r:string>>")

    def placed(x: Column) -> Column:
        pairs = F.transform(x["found"], lambda m, i: F.struct(m.alias("m"), F.get(x["gaps"], i).alias("g"), F.get(x["gaps"], i + 1).alias("after")))
        at = _running(F.transform(pairs, lambda p: F.length(p["g"]) + F.length(p["m"])))
        both = F.zip_with(pairs, at, lambda p, t: F.struct(p["m"].alias("m"), p["g"].alias("g"), p["after"].alias("after"), (t + F.length(p["g"])).alias("s")))
        return F.transform(both, lambda p: F.struct(p["s"].alias("s"), (p["s"] + F.length(p["m"])).alias("e"), p["m"].alias("m"), F.right(p["g"], F.lit(24)).alias("l"), F.left(p["after"], F.lit(12)).alias("r")))

    # a one-element array binds the matches, so that they are made once
    once = F.array(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps")))
    return F.when(text.rlike(hint), F.get(F.transform(once, lambda x: F.when(F.size(x["found"]) > 0, placed(x)).otherwise(empty)), F.lit(0))).otherwise(empty)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, F.try_element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str):
    def check(x: Column) -> Column:
        if kind == "ip":
            plain = lambda p: F.ltrim(p, F.lit("0"))
            return F.forall(F.split(x["m"], r"\."), lambda p: (F.length(plain(p)) < 3) | ((F.length(plain(p)) == 3) & (plain(p) <= "255")))
        if kind == "card":
            n = F.length(_digits(x["m"]))
            return F.when((n >= 16) & (n <= 19), _luhn(_digits(x["m"]))).otherwise(False)
        if kind == "phone":
            return F.length(_digits(x["m"])).between(8, 15)
        return F.lit(True)

    return check


def _cells(spans: Column, size: Column) -> Column:
    """For each cell of CELL code points, how many of the (sorted) spans end before it."""
    ends = F.transform(spans, lambda x: (x["e"] - 1))
    return F.transform(F.sequence(F.lit(0), F.floor(size / CELL).cast("int")), lambda k: F.size(F.filter(ends, lambda e: e < k * CELL)))


def _overlaps(base: list[str], x: Column) -> Column:
    """If a candidate touches a base span; only spans that lie in the candidate's cells are looked at."""

    def hit(c: str) -> Column:
        cells = F.col(f"{c}_cells")
        first = F.get(cells, F.floor(x["s"] / CELL).cast("int"))
        stop = F.coalesce(F.get(cells, F.floor(x["e"] / CELL).cast("int") + 1) + 1, F.size(F.col(c)))
        near = F.slice(F.col(c), first + 1, F.greatest(stop - first, F.lit(0)))
        return (F.size(F.col(c)) > 0) & F.exists(near, lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"]))

    hits = [hit(c) for c in base]
    return hits[0] | hits[1] | hits[2] | hits[3]


def _votes(x: Column) -> list[Column]:
    """A vote of 1 (personal), -1 (not) or 0 (none) of each labeler on a candidate."""
    m, left = x["m"], F.lower(x["l"])
    digits, size = F.length(_digits(m)), F.length(m)
    say = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0)
    return [
        say(m.rlike(r"@[A-Za-z0-9-]+\.[A-Za-z]|^\+?[0-9][0-9().-]{7,}$|^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), m.rlike(r"^[0-9]{1,2}(\.[0-9]{1,2}){0,2}\.?$")),
        say(m.rlike(rf"(?i)^({SECRET_WORDS})\W*[=:]|\bAKIA[0-9A-Z]{{16}}\b|\b[0-9a-f]{{32,}}\b")),
        say(m.rlike(rf"(?i)@.*\.({DOMAINS})\b") | (digits.between(16, 19) & m.rlike("^(4|5[1-5]|3[47]|6)")), left.rlike(r"(?i)licen[cs]e|public|creative")),
        say(left.rlike(rf"\b({CONTACT_WORDS})\b\W*$"), left.rlike(rf"\b({PLAIN_WORDS})\b\W*$")),
        say((size >= 16) & (digits >= 4) & m.rlike("[A-Za-z]") & ~m.rlike(r"[|/\\]"), (size <= 5) | (digits < 3)),
        say(x["base"]),
    ]


def _shape(x: Column) -> list[Column]:
    """The final classifier's features: shape of the candidate and its neighbourhood."""
    m, digits = x["m"], F.length(_digits(x["m"]))
    return [
        F.when(F.length(m) < 6, "short").when(F.length(m) < 14, "middle").otherwise("long"),
        F.when(digits < 3, "few").when(digits < 8, "some").otherwise("many"),
        F.when(m.contains("@"), "at").when(m.rlike("[=:]"), "sign").when(m.rlike("[A-Za-z].*[0-9]|[0-9].*[A-Za-z]"), "mixed").otherwise("numeric"),
        F.when(m.rlike("[0-9A-Fa-f]{16}|[0-9A-Z]{16}"), "dense").otherwise("loose"),
        F.when(F.lower(x["l"]).rlike(rf"\b({CONTACT_WORDS}|{SECRET_WORDS})\b\W*$"), "named").when(F.lower(x["l"]).rlike(rf"\b({PLAIN_WORDS})\b\W*$"), "plain").otherwise("none"),
    ]


def _prepared(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Base spans of each kind and the candidates of each text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    base = [f"b_{k}" for k in KINDS]
    slim = lambda xs: F.transform(xs, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    rows = rows.select("doc_id", "text", *[slim(F.filter(_spans(F.col("text"), p, HINTS[k]), _valid(k))).alias(f"b_{k}") for k, p in KINDS.items()])
    found = _spans(F.col("text"), CANDIDATE, rf"[0-9@]|(?:{SECRET_WORDS})\x20?[=:]")
    rows = rows.withColumns({"found": found} | {f"{c}_cells": _cells(F.col(c), F.length("text")) for c in base})
    return rows.select("doc_id", *base, F.transform("found", lambda x: x.withField("base", _overlaps(base, x))).alias("found")), base


def _expectation_maximisation(counts: DataFrame) -> DataFrame:
    """``counts``: v array<int> (the votes), n.  Adds q, the posterior that candidates with these votes are personal.

    Each labeler has a chance of each vote for either class; all in one SQL expression over the combinations.
    """
    n = len(LABELERS)
    odds = f"aggregate(sequence(0, {n - 1}), ln(a.pi / (1 - a.pi)), (t, j) -> t + ln(a.p1[3 * j + p.v[j] + 1] / a.p0[3 * j + p.v[j] + 1]))"
    scored = f"transform(ps, p -> named_struct('v', p.v, 'n', p.n, 'q', 1 / (1 + exp(-{odds}))))"
    part = lambda w: f"transform(sequence(0, {3 * n - 1}), k -> (aggregate(s.qs, {_SMOOTH}D, (t, p) -> t + if(p.v[int(k div 3)] = k % 3 - 1, {w}, 0D)) / (aggregate(s.qs, {3 * _SMOOTH}D, (t, p) -> t + {w}))))"
    again = f"transform(array(named_struct('qs', {scored})), s -> named_struct('pi', least(0.99D, greatest(0.01D, aggregate(s.qs, 0D, (t, p) -> t + p.n * p.q) / aggregate(s.qs, 0D, (t, p) -> t + p.n))), 'p1', {part('p.n * p.q')}, 'p0', {part('p.n * (1 - p.q)')}))[0]"
    first = f"named_struct('pi', 0.5D, 'p1', transform(sequence(0, {3 * n - 1}), k -> array(0.1D, 0.4D, 0.5D)[int(k % 3)]), 'p0', transform(sequence(0, {3 * n - 1}), k -> array(0.5D, 0.4D, 0.1D)[int(k % 3)]))"
    one = counts.groupBy("v").agg(F.sum("n").cast("double").alias("n")).agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("ps"))
    fitted = one.selectExpr("ps", f"aggregate(sequence(1, {_ROUNDS}), {first}, (a, i) -> {again}) AS a")
    return fitted.selectExpr(f"inline({scored})").select("v", "q")


def train(docs: DataFrame) -> dict[str, float]:
    """The span classifier: log-odds of each feature value, from the votes on all candidates of all documents.

    Only counts by votes and feature values, a bounded number of combinations, are shuffled and reach the driver.
    """
    return _fitted(_prepared(docs)[0])


def _fitted(rows: DataFrame) -> dict[str, float]:
    seen = rows.select(F.explode("found").alias("x"))
    seen = seen.select(F.array(*_votes(F.col("x"))).alias("v"), F.array(*_shape(F.col("x"))).alias("f"))
    counts = seen.groupBy("v", "f").agg(F.count("*").alias("n")).persist()
    try:
        soft = counts.join(F.broadcast(_expectation_maximisation(counts)), "v")  # at most 3 ** labelers rows
        values = soft.select("q", "n", F.posexplode(F.concat(F.array(F.lit("all")), "f")).alias("i", "value"))
        table = values.groupBy("i", "value").agg(F.sum(F.col("n") * F.col("q")).alias("yes"), F.sum(F.col("n") * (1 - F.col("q"))).alias("no")).collect()
    finally:
        counts.unpersist()
    total = next(((r["yes"] + 1, r["no"] + 1) for r in table if r["i"] == 0), (1.0, 1.0))
    odds = {f"{r['i'] - 1}:{r['value']}": log((r["yes"] + 0.5) / (total[0] + 1)) - log((r["no"] + 0.5) / (total[1] + 1)) for r in table if r["i"]}
    return odds | {"prior": log(total[0] / total[1])}


def find_personal_data(docs: DataFrame, model: dict[str, float] | None = None) -> DataFrame:
    """Spans of personal data in every whole text: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Base spans are the leftmost matches of KINDS that pass their checks (ip parts to 255, cards of 16 to 19 digits under
    Luhn, phones of 8 to 15 digits).  ``spans`` also has ``secret`` and ``other``: candidates that the classifier
    (``model``, else trained on ``docs``) takes for personal and that touch no base span.  Each span is kind:start:end in code
    points, end exclusive, joined by commas in the order of kind, then start.

    Null text counts as empty and has no spans; null and repeated doc_ids keep their rows; an empty table gives no
    rows; other columns are ignored.
    """
    rows, base = _prepared(docs)
    if model is None:
        rows = cut(rows)  # spans and candidates, no texts: the patterns run once over the corpus
        model = _fitted(rows)
    weights = F.create_map(*[F.lit(v) for item in sorted(model.items()) for v in item])
    log_odds = lambda x: sum((F.coalesce(F.try_element_at(weights, F.concat(F.lit(f"{i}:"), f)), F.lit(0.0)) for i, f in enumerate(_shape(x))), F.lit(float(model["prior"])))
    # the closing sign of a sentence is no part of a span
    end = lambda x: x["e"] - F.length(F.regexp_extract(x["m"], r"([,;.!?)\"']*)$", 1))
    added = F.filter("found", lambda x: ~x["base"] & (log_odds(x) >= 0))
    secret = lambda x: x["m"].rlike(rf"(?i)^({SECRET_WORDS})|AKIA[0-9A-Z]{{16}}|(?=[0-9]*[a-f])[0-9a-f]{{16}}")
    join = lambda kind, xs, e: F.transform(xs, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), e(x).cast("string")))
    spans = [join(k, F.col(f"b_{k}"), lambda x: x["e"]) for k in KINDS]
    more = [join("secret", F.filter("added", secret), end), join("other", F.filter("added", lambda x: ~secret(x)), end)]
    out = rows.select("doc_id", *base, added.alias("added"))
    return out.select(
        "doc_id",
        *[F.size(c).cast("bigint").alias(f"n_{k}") for c, k in zip(base, KINDS, strict=True)],
        F.sha2(F.array_join(F.concat(*spans), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*spans, *more), ",").alias("spans"),
    )
