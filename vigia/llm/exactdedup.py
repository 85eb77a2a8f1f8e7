"""Exact dedup through minimal perfect hash shards over the digests of the historical rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut

#: Distinct historical digests that one shard's table is meant to hold.
SHARD_KEYS = 20_000
#: Key slots a key while a level of the hash is filled.
GAMMA = 2.0

_DIGEST = 32


class MinimalPerfectHash:
    """Levels of bit arrays: a key sits at the first level where no other key shares its slot.

    The rank of that bit is the key's slot, so n keys fill slots 0 to n - 1.  A foreign key
    gets -1 or some key's slot; the caller compares the full digest that the slot holds.
    """

    def __init__(self, keys: np.ndarray, gamma: float = GAMMA):
        """``keys``: uint64 array of shape (n, 4), the digests' words, all different."""
        self.levels: list[np.ndarray] = []
        left = keys
        while len(left):
            size = max(8, int(gamma * len(left)))
            at = self._slot(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(alone)
            left = left[~alone[at]]
        self.before = np.concatenate(([0], np.cumsum([x.sum() for x in self.levels]))).astype(np.int64)
        self.ranks = [np.cumsum(x) - x for x in self.levels]

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = keys[:, level % 4] ^ (keys[:, (level + 1) % 4] * np.uint64(2 * level + 3))
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self._slot(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.before[level] + self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return out


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, _DIGEST // 8)


def _lookup(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """One shard: build the table from the historical digests, then look the new ones up."""
    out = []
    if len(old):
        words, n = _words(old["digest"]), len(old)
        table = MinimalPerfectHash(words)
        slot = table.slots(words)
        held, winner, count = np.zeros((n, _DIGEST // 8), np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        held[slot], winner[slot], count[slot] = words, old["winner"].to_numpy(), old["n"].to_numpy()
        if len(new):
            asked = _words(new["digest"])
            at = table.slots(asked)
            member = at >= 0
            member[member] = (held[at[member]] == asked[member]).all(axis=1)
            count[at[member]] += new["n"].to_numpy()[member]  # digests are distinct: no slot twice
            np.minimum.at(winner, at[member], new["winner"].to_numpy()[member])
            new = new[~member]
        out.append(pd.DataFrame({"digest": [x.tobytes() for x in held], "winner": winner, "n": count}))
    if len(new):
        out.append(new[["digest", "winner", "n"]])
    if not out:
        return pd.DataFrame({"digest": [], "winner": [], "n": []})
    whole = pd.concat(out)
    return whole[whole["n"] > 1]


def exact_groups(docs: DataFrame, history_below: int | None = None, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Which row of each group of equal texts stays.

    Texts are equal when they are identical after each ``[\\x20\\x09-\\x0D]+`` became one space; null counts as empty.
    Rows with ``doc_id < history_below`` (default: the middle of the ids' range) are the history.  Its distinct
    digests, with the smallest doc_id and the number of rows, fill the slots of minimal perfect hash tables, one a shard of
    digests (about ``shard_keys`` keys each, so their number grows with the data); the other rows' distinct digests are looked
    up there, byte for byte.  Members join the historical winner, nonmembers form groups of their own.  Both sides are
    aggregated by digest before the shuffle, so a text with millions of copies is one row.

    Returns every row: ``doc_id, keep_id, group_size, kept, text_sha256``.  Ties: rows that repeat a doc_id all count
    in ``group_size`` and share ``kept``.  A row with null doc_id counts in the group; in a group
    of null ids only, keep_id is null and its rows are kept.  An empty table gives no rows; other columns are ignored.
    """
    plain = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    rows = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(plain, 256)).alias("digest")))
    span = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if history_below is None:
        history_below = 0 if span[0] is None else span[0] + (span[1] - span[0] + 1) // 2
    shards = max(1, -(-span[2] // shard_keys))
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("bigint"), F.lit(shards)).cast("int")
    old = F.coalesce(F.col("doc_id") < history_below, F.lit(False))
    sums = lambda part: part.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count("*").alias("n")).select(shard.alias("shard"), F.col("digest").alias("digest"), F.coalesce("winner", F.lit(_NONE)).alias("winner"), "n")
    history, new = sums(rows.where(old)), sums(rows.where(~old))
    groups = history.groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(_lookup, "digest binary, winner bigint, n bigint")
    groups = groups.select("digest", F.nullif("winner", F.lit(_NONE)).alias("winner"), "n")
    groups = cut(groups)
    # texts with over a thousandth of all rows, fewer than a thousand, meet their rows where these lie
    hot = F.broadcast(groups.where(F.col("n") > span[2] / 1000))
    out = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(groups, "digest", "left"))
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("winner"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


#: Stands for "no doc_id" inside the shards; larger than any real id there, so that an id wins.
_NONE = (1 << 63) - 1

#: DuckDB SQL for the rows of op2_exact_dedup over the view ``documents``.
SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
