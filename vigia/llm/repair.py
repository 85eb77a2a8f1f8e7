"""Conversation structure repair: turns as min-plus matrices over (cost, edits), multiplied in a tree across partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

#: Roles by their initials; the states of ``(s?(ua)+)?``: nothing yet, after s, after u, after a (the first and the last may end it).
ROLES = {"s": "system", "u": "user", "a": "assistant"}
STATES, ENDS = 4, (0, 3)
#: Where a turn of a role leads from each state; None where it can't stand.
_NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: An edit's mark: Delete D; Insert I (user) or J (assistant); Keep K; Rerole R (to user) or S (to assistant).  From one state only one
#: role can be inserted, so marks sort as the edits' initials do.
_INSERTED, _REROLED = {"u": "I", "a": "J"}, {"u": "R", "a": "S"}
#: Rows that are taken one by one before their product enters the tree, and factors of a product across partitions.
CHUNK, FAN = 64, 16

_SPACES = " \t\n\x0b\x0c\r"

# a matrix is a list of 16 elements, row by row: (cost, marks), or None where no edits lead from state to state


def _times(a: list, b: list) -> list:
    """Min-plus product: the cheapest way over a state between; of equal ones that of the least marks.

    Ways of equal cost between two states never have marks that begin those of the other (these would cost more), so the
    least stays the least whatever follows, and the product is associative.
    """
    out = [None] * (STATES * STATES)
    for i in range(STATES):
        for k in range(STATES):
            x = a[STATES * i + k]
            if x is None:
                continue
            for j in range(STATES):
                y = b[STATES * k + j]
                if y is not None:
                    way = (x[0] + y[0], x[1] + y[1])
                    at = STATES * i + j
                    if out[at] is None or way < out[at]:
                        out[at] = way
    return out


def _plus(a: list, b: list) -> list:
    return [x if y is None or x is not None and x <= y else y for x, y in zip(a, b, strict=True)]


def _identity() -> list:
    return [(0, "") if k % (STATES + 1) == 0 else None for k in range(STATES * STATES)]


def _closure() -> list:
    """Any number of inserts."""
    once = _identity()
    for role, mark in _INSERTED.items():
        for i, j in enumerate(_NEXT[role]):
            if j is not None:
                once[STATES * i + j] = (INSERT, mark)
    out = once
    for _ in range(STATES):
        out = _plus(out, _times(out, once))
    return out


CLOSURE = _closure()


def turn_matrix(initial: str, fault: str) -> list:
    """A turn's matrix: inserts before it, then the turn kept, reroled or deleted; ``fault``: "", "blank", "duplicate" or "truncated"."""
    out = [None] * (STATES * STATES)
    for i in range(STATES):
        out[STATES * i + i] = (DELETE, "D")
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        for role, mark in _REROLED.items():
            for i, j in enumerate(_NEXT[role]):
                if j is not None:
                    out[STATES * i + j] = (REROLE + more, mark)
        for i, j in enumerate(_NEXT.get(initial, ())):
            if j is not None:
                out[STATES * i + j] = (more, "K")
    return _times(CLOSURE, out)


_FAULTS = ("", "blank", "duplicate", "truncated")
_MATRICES = {(initial, fault): turn_matrix(initial, fault) for initial in ("s", "u", "a", "") for fault in _FAULTS}


def _product(turns: Iterator[tuple[str, str]]) -> list:
    """The product of the turns' matrices, in order: short runs, then a tree of runs of equal length."""
    done: list[tuple[int, list]] = []
    run, n = _identity(), 0

    def close(run: list, n: int) -> None:
        while done and done[-1][0] <= n:
            size, before = done.pop()
            run, n = _times(before, run), n + size
        done.append((n, run))

    for initial, fault in turns:
        run, n = _times(run, _MATRICES[initial if initial in ROLES else "", fault]), n + 1
        if n == CHUNK:
            close(run, n)
            run, n = _identity(), 0
    while done:
        run = _times(done.pop()[1], run)
    return run


#: What is known of a run of turns; every part of it can be put together from those of two runs that follow one another.
_RUN = "conv string, p bigint, start bigint, n bigint, costs array<bigint>, marks array<string>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, low bigint, high bigint, turns bigint"
_LEGAL = {"su", "ua", "au"}


def _packed(matrix: list) -> dict:
    return {"costs": [None if x is None else x[0] for x in matrix], "marks": [None if x is None else x[1] for x in matrix]}


def _unpacked(row) -> list:
    return [None if m is None else (int(c), m) for c, m in zip(row["costs"], row["marks"], strict=True)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation and partition, from turns in order."""
    names = ("conv", "p", "at", "turn", "initial", "fault")
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True))
    out: list[dict] = []
    for (conv, p), own in groupby(rows, key=lambda r: r[:2]):
        known = {"conv": conv, "p": p, "start": None, "n": 0, "illegal": 0, "head": None, "tail": None, "low": None, "high": None, "turns": 0} | dict.fromkeys(_FAULTS[1:], 0)

        def turns(own=own, known=known) -> Iterator[tuple[str, str]]:
            for _, _, at, turn, initial, fault in own:
                if not known["n"]:
                    known["start"], known["head"] = at, initial
                elif known["tail"] + initial not in _LEGAL:
                    known["illegal"] += 1
                known["tail"] = initial
                known["n"] += 1
                if fault:
                    known[fault] += 1
                if turn is not None and turn != known["high"]:
                    known["low"] = turn if known["low"] is None else known["low"]
                    known["high"], known["turns"] = turn, known["turns"] + 1
                yield initial, fault

        matrix = _product(turns())
        out.append(known | _packed(matrix))
        if len(out) >= 1000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


_SCHEMA = pa.schema([(name, {"string": pa.string(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}[kind]) for name, kind in (field.split() for field in _RUN.split(", "))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _together(runs: pd.DataFrame) -> pd.DataFrame:
    """Runs that follow one another as one; FAN at most."""
    out = None
    none = lambda x: None if pd.isna(x) else int(x)
    for row in runs.sort_values("p").to_dict("records"):
        row = row | {"matrix": _unpacked(row), "low": none(row["low"]), "high": none(row["high"])}
        if out is None:
            out = row
            continue
        out["matrix"] = _times(out["matrix"], row["matrix"])
        out["illegal"] += row["illegal"] + (out["tail"] + row["head"] not in _LEGAL)
        out["turns"] += row["turns"] - (row["low"] is not None and out["high"] == row["low"])
        for name in ("n", *_FAULTS[1:]):
            out[name] += row[name]
        out["tail"], out["low"] = row["tail"], row["low"] if out["low"] is None else out["low"]
        out["high"] = out["high"] if row["high"] is None else row["high"]
    out |= _packed(out.pop("matrix"))
    return pd.DataFrame([[out[name] for name in _SCHEMA.names]], columns=_SCHEMA.names).astype({"low": "Int64", "high": "Int64"})


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the cheapest edits of each whole conversation."""
    for batch in batches:
        best = []
        for costs, marks in zip(batch.column("costs").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            whole = _times(_unpacked({"costs": costs, "marks": marks}), CLOSURE)
            best.append(min(whole[j] for j in ENDS if whole[j] is not None))
        keep = [c for c in batch.schema.names if c not in ("costs", "marks")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([x[0] for x in best], pa.int64()), pa.array([x[1] for x in best], pa.string())], names=[*keep, "cost", "chosen"])


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with damage keyed by crc32(``conv_id:turn``) % 20 (nulls: one space).

    0 drops the row, 1 empties its text, 2 removes the text's ``[.!?]``, 3 repeats it, 4 makes its role user; equal rows are damaged alike.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    text = F.when(what == 1, "").when(what == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    rows = turns.where(what != 0).select("conv_id", "turn", F.when(what == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.when(what == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("nth", F.explode(F.expr("sequence(1, times)"))).select("conv_id", "turn", "role", "text")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cheapest edits that give each conversation's roles the form ``(s?(ua)+)?``, as two tables.

    The first has a row a conversation: ``conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit``.  The second has the
    repaired turns: ``conv_id, pos, step, edit, role, text`` in the order of pos (the row of the conversation, from 0) and step.

    Rows go by turn (nulls first), then role, then the text's digest; null roles and texts are one space.  A row's first fault counts: blank (no
    character outside ``[\\x20\\x09-\\x0D]``), duplicate (role and text seen earlier), truncated (its last such character is not ``[.!?]``).
    Keep costs 0, Rerole to user or assistant 3, Delete 4 (the only edit of blank and duplicate rows), Insert of an empty user or
    assistant turn 3; truncated rows that stay add 3.  Of equal costs the ASCII-least audit (the edits' initials) is taken.  A role with another
    initial than s, u or a, the empty one too, can't be kept.  gaps: the span of turns less the distinct ones, 0 where all are null.

    Rows are dealt by ranges of (conversation, turn), so that a conversation of any length lies in as many partitions as its rows fill.  Each partition multiplies the
    matrices of its turns in a tree; products of a conversation are multiplied 16 at a time by partition.  One conversation's 16 strings of edits must fit
    a task.  Null ids are one conversation; repeated rows are duplicates; an empty table gives two empty ones; other columns are ignored.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), F.col("turn").cast("bigint").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    order = ["conv", "turn", "role", "digest"]
    rows = cut(rows.withColumn("digest", F.unhex(F.sha2("text", 256))).repartitionByRange(*order).sortWithinPartitions(*order))
    # written and read back in order: the number is the same in every run
    rows = rows.withColumn("at", F.monotonically_increasing_id())

    bare = F.rtrim("text", F.lit(_SPACES))
    slim = rows.select("conv", "turn", "role", "digest", "at", F.shiftright("at", 33).alias("p"), F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"))
    again = slim.groupBy("conv", "role", "digest").agg(F.min("at").alias("first"), F.count("*").alias("times")).where("times > 1")
    again = cut(again, gather=True)
    # turns with over a thousandth of all rows, fewer than a thousand, meet their rows where these lie
    hot = F.broadcast(again.where(F.col("times") > rows.count() / 1000))
    key = ["conv", "role", "digest"]
    slim = slim.join(hot, key, "left")
    seen = again.join(hot.select(*key), key, "left_anti").select(*key, F.col("first").alias("other"))
    slim = slim.join(seen, key, "left").withColumn("first", F.coalesce("first", "other"))
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(F.col("open"), "truncated").otherwise("")
    slim = cut(slim.select("conv", "p", "at", "turn", "initial", fault.alias("fault")))

    runs = cut(slim.repartition("conv", "p").sortWithinPartitions("conv", "p", "at").mapInArrow(_runs, _RUN), gather=True)
    split = cut(runs.groupBy("conv").agg(F.count("*").alias("parts")).where("parts > 1"), gather=True)
    whole, many = runs.join(split, "conv", "left_anti"), runs.join(split.select("conv"), "conv")
    most = many.agg(F.max("p")).first()[0] or 0
    while most:
        many = many.withColumn("p", F.col("p").cast("bigint")).groupBy("conv", F.floor(F.col("p") / FAN).alias("group")).applyInPandas(_together, _RUN)
        many, most = cut(many.withColumn("p", F.floor(F.col("p") / FAN)), gather=True), most // FAN
    done = cut(whole.unionByName(many).mapInArrow(_chosen, "conv string, p bigint, start bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, low bigint, high bigint, turns bigint, cost bigint, chosen string"), gather=True)

    own_id = rows.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("bigint")
    summary = done.join(own_id, "conv").select("conv_id", F.col("n").alias("n_rows"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", F.translate("chosen", "JS", "IR").alias("audit"))

    steps = done.select("conv", F.posexplode(F.split("chosen", "(?<=[DKRS])")).alias("pos", "marks"))
    steps = steps.select("conv", "pos", F.posexplode(F.split("marks", "")).alias("step", "mark")).where("mark not in ('', 'D')")
    before = Window.partitionBy("conv").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    begins = runs.select("conv", "p", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    places = slim.select("conv", "p", "at").join(begins, ["conv", "p"]).select("conv", (F.col("at") - F.col("start") + F.col("before")).alias("pos"), "at")
    stay = steps.where("mark in ('K', 'R', 'S')").join(places, ["conv", "pos"]).join(rows.select("at", "role", "text"), "at").select("conv", "pos", "step", "mark", "role", "text")
    new = steps.where("mark in ('I', 'J')").select("conv", "pos", "step", "mark", F.lit("").alias("role"), F.lit("").alias("text"))
    role = F.when(F.col("mark").isin("I", "R"), ROLES["u"]).when(F.col("mark").isin("J", "S"), ROLES["a"]).otherwise(F.col("role"))
    repaired = stay.unionByName(new).join(own_id, "conv").select("conv_id", F.col("pos").cast("bigint").alias("pos"), F.col("step").cast("bigint").alias("step"), F.translate("mark", "JS", "IR").alias("edit"), role.alias("role"), "text")
    return summary, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: the digest of each conversation's ``role:text``, newline-joined in order.

    A digest takes its bytes one after another, so a conversation streams through one task, sorted on disk, a batch of rows in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
        ids, found = [], []
        for conv, own in groupby(rows, key=lambda r: r[0]):
            digest, between = hashlib.sha256(), ""
            for _, role, text in own:
                digest.update(f"{between}{role}:{text}".encode())
                between = "\n"
            ids.append(conv)
            found.append(digest.hexdigest())
            if len(ids) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(found)], names=["conv_id", "repaired_sha256"])
                ids, found = [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(found)], names=["conv_id", "repaired_sha256"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(repaired.schema["conv_id"].dataType)
    ordered = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "step").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


#: The digest of a conversation without turns.
NOTHING = hashlib.sha256(b"").hexdigest()


def report(turns: DataFrame) -> DataFrame:
    """One row for every conv_id of ``turns``: what ``repair`` finds after ``damage``, and the digest of the repaired turns.

    A conversation that loses all its rows has zeros, an empty audit and the digest of nothing.
    """
    summary, repaired = repair(damage(turns))
    own = digests(repaired)
    every = turns.select("conv_id").distinct()
    out = every.join(summary.withColumnRenamed("conv_id", "of"), every["conv_id"].eqNullSafe(F.col("of")), "left").drop("of", "n_rows")
    out = out.join(own.withColumnRenamed("conv_id", "of"), out["conv_id"].eqNullSafe(F.col("of")), "left").drop("of")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(NOTHING))})


#: DuckDB SQL for the rows of op13_conversation_repair over the view ``conversations``: one recursive step a row, with the four states' best ways.
SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT),
         lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS h FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS nth
  FROM hashed WHERE h <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), nth) AS pos, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
judged AS (
  SELECT conv_id, turn, pos, role, text, left(role, 1) AS i,
         CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1), 'su') AS pair FROM placed),
facts AS (
  SELECT conv_id, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
edges AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) AS e(a, r, b)),
inserts AS (SELECT * FROM (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:']),
            (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])) AS e(a, b, c, m, lines)),
acts AS (
  SELECT j.conv_id, j.pos, s.a, s.a AS b, 4 AS c, 'D' AS m, []::VARCHAR[] AS lines FROM judged j, (SELECT unnest(range(4)) AS a) s
  UNION ALL SELECT j.conv_id, j.pos, e.a, e.b, CASE WHEN fault = 't' THEN 3 ELSE 0 END, 'K', [j.role || ':' || j.text] FROM judged j JOIN edges e ON e.r = j.i WHERE fault NOT IN ('b', 'd')
  UNION ALL SELECT j.conv_id, j.pos, e.a, e.b, CASE WHEN fault = 't' THEN 6 ELSE 3 END, 'R', [CASE e.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END || j.text] FROM judged j JOIN edges e ON e.r IN ('u', 'a') WHERE fault NOT IN ('b', 'd')),
moves AS (
  SELECT x.conv_id, x.pos, i.a, x.b, min(struct_pack(c := i.c + x.c, m := i.m || x.m, lines := i.lines || x.lines)) AS w
  FROM acts x JOIN inserts i ON i.b = x.a GROUP BY ALL),
walk AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS state, struct_pack(c := 0, m := '', lines := []::VARCHAR[]) AS w FROM facts
  UNION ALL
  SELECT conv_id, pos, state, w FROM (
    SELECT k.conv_id, v.pos, v.b AS state, struct_pack(c := k.w.c + v.w.c, m := k.w.m || v.w.m, lines := k.w.lines || v.w.lines) AS w,
           row_number() OVER (PARTITION BY k.conv_id, v.b ORDER BY k.w.c + v.w.c, k.w.m || v.w.m) AS nth
    FROM walk k JOIN moves v ON v.conv_id IS NOT DISTINCT FROM k.conv_id AND v.pos = k.pos + 1 AND v.a = k.state) WHERE nth = 1),
ends AS (
  SELECT f.conv_id, w.w.c + i.c AS cost, w.w.m || i.m AS audit, array_to_string(w.w.lines || i.lines, chr(10)) AS whole
  FROM facts f JOIN walk w ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.pos = f.n_rows JOIN inserts i ON i.a = w.state AND i.b IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY f.conv_id ORDER BY w.w.c + i.c, w.w.m || i.m) = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
