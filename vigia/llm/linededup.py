"""Line dedup: windows of three consecutive lines that occur earlier in the corpus are cut out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _with_windows(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, row (tie-break of repeated ids), pos, w (hash of the window's lines) of each window."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    clean = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))
    starts = F.when(F.size("lines") >= window, F.sequence(F.lit(0), F.size("lines") - window)).otherwise(F.array().cast("array<int>"))
    # joined by "\n", which no line holds: equal strings are equal windows
    hashes = F.transform(starts, lambda i: F.substring(F.sha2(F.array_join(F.slice("lines", i + 1, window), "\n"), 256), 1, 32))
    windows = docs.select("doc_id", "row", clean.alias("lines")).select("doc_id", "row", F.posexplode(hashes).alias("pos", "w"))
    return windows.select("doc_id", "row", "pos", F.unhex("w").alias("w"))


def repeated_positions(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Lines to remove: ``doc_id, row, cut`` with the sorted line numbers (from 0) of each text that has any.

    A window is ``window`` consecutive lines, equal after each run of white space became one space and the ends
    were trimmed.  Of equal windows the first by (doc_id, row, line) stays; all lines of the others go, also those that a later
    one shares with the first where they overlap: of four equal lines only the first is left.  A
    document with fewer lines has no window.  Only the first occurrence of each repeated window
    is joined back, so the shuffled rows are window digests and positions, never text.
    """
    windows = _with_windows(docs, window)
    here = F.struct("doc_id", "row", "pos")
    first = windows.groupBy("w").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1").select("w", "first")
    later = windows.join(first, "w").where(F.col("first") < here)
    covered = later.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("starts"))
    spread = F.flatten(F.transform("starts", lambda p: F.sequence(p, p + window - 1)))
    return covered.select("doc_id", "row", F.array_sort(F.array_distinct(spread)).alias("cut"))


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, longer where a column has them; Spark takes names that differ in case for one."""
    out, used = [], {x.lower() for x in taken}
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def remove_repeated_lines(docs: DataFrame, window: int = WINDOW, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with repeated line windows cut out of ``text``; adds ``n_lines`` and ``n_removed``, or the two names of ``counts``.

    Every row stays, also one whose text becomes empty; other columns pass through (a column that has a name of
    ``counts`` is replaced).  Null text stays null and has 0 lines; empty text has one
    empty line.  Rows that repeat a doc_id are ordered by the hash of their text; rows equal in both id and text count
    as one document and lose the same lines.  A null doc_id sorts first.  An empty table gives an empty table.
    """
    docs = docs.drop(*counts)
    row, key, at, gone = free_names([*docs.columns, *counts], "row", "key", "at", "gone")
    keyed = docs.withColumn(row, F.xxhash64("text"))
    found = repeated_positions(docs.select("doc_id", F.xxhash64("text").alias("row"), "text"), window)
    found = found.select(F.col("doc_id").alias(key), F.col("row").alias(at), F.col("cut").alias(gone))
    joined = keyed.join(found, keyed["doc_id"].eqNullSafe(found[key]) & (keyed[row] == found[at]), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    # a one-element array binds the lines, so that the text is split once
    left = F.array_join(F.get(F.transform(F.array(lines), lambda x: F.transform(kept, lambda i: F.get(x, i))), F.lit(0)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    removed = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("bigint")
    out = joined.withColumns({counts[0]: n_lines, counts[1]: removed, "text": text})
    return out.select(*docs.columns, *counts)


#: DuckDB SQL for the rows of op1_line_dedup over the view ``documents``.
SQL = r"""
WITH lines AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS raw,
         list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS ls
  FROM documents),
starts AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS p FROM lines WHERE len(ls) >= 3),
windows AS (SELECT doc_id, p, array_to_string(ls[p:p + 2], chr(10)) AS w FROM starts),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM windows),
covered AS (SELECT doc_id, list_distinct(flatten(list([p, p + 1, p + 2]))) AS cut FROM ranked WHERE k > 1 GROUP BY doc_id),
joined AS (SELECT l.doc_id, l.text, l.raw, coalesce(c.cut, []) AS cut FROM lines l LEFT JOIN covered c USING (doc_id))
SELECT doc_id,
       CASE WHEN text IS NULL THEN 0 ELSE len(raw) END AS n_lines,
       len(cut) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(raw, lambda x, i: NOT list_contains(cut, i)), chr(10)), '')) AS text_sha256
FROM joined
"""
