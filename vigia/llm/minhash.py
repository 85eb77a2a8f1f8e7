"""Near-duplicate documents: bottom-k sketches, inverted lists, union-sketch filter, exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .kernels import U64, list_array, mix, shingles, slices
from .storage import cut

#: Smallest values kept of each set, and how many of them have an inverted list.
K, INDEX = 64, 16
#: What a pair of Jaccard 0.75 shares but for about 3 pairs in a million: LEAST indexed values, P(Binomial(16, 0.75) < 4),
#: and this share of the union's K smallest values, P(Binomial(64, 0.75) < 32).
LEAST, SHARE = 4, 0.5
#: Values of each class of many long lists that get new lists, and how many of them such a pair shares but for about 2 pairs in a million,
#: P(Binomial(28, 0.75) < 10).
LISTED, NEEDED = 28, 10
#: Longest inverted list whose pairs are all emitted; longer ones go through leaders and blocks.
LIST_CAP = 32
#: Members of one block of a family, and shingles of all of them: what one task holds of either side.
BLOCK, BLOCK_SHINGLES = 8192, 4_000_000
#: Bits a text of the filter that says which texts take part in links, and the most bits that it has (8 MB).
TEXT_BITS, MOST_BITS = 16, 1 << 26
WIDTH, PERCENT = 5, 75

_SKETCH = "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, sketch array<bigint>"


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches):
            sets = shingles(data, offsets, width)
            with np.errstate(over="ignore"):
                sums = [[int(mix(s.view(U64) + U64(c)).sum(dtype=np.uint64).view(np.int64)) for s in sets] for c in (1, 7)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), list_array([s[:k] for s in sets], pa.int64())],
                names=["doc_id", "n_shingles", "s1", "s2", "sketch"],
            )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), list_array(shingles(data, offsets, width), pa.int64())], names=["doc_id", "full"])

    return run


def _sets_of(ids: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``doc_id, full``: the whole sets of the texts in ``ids`` (distinct ``id``), and of few others.

    A bitmap of the ids goes to the tasks that read the texts, so that no text is shuffled.  It has TEXT_BITS bits an id and
    MOST_BITS at most: beyond, more texts that are not asked for come along, and the join with what asked for them drops them.
    """
    bits = 64
    while bits < min(MOST_BITS, TEXT_BITS * ids.count()):
        bits *= 2
    slot = lambda name: F.pmod(F.xxhash64(name), F.lit(bits))
    words = ids.select(slot("id").alias("s")).groupBy(F.shiftright("s", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(s & 63))")).alias("bits")).toArrow()
    bitmap = np.zeros(bits >> 6, np.int64)
    bitmap[words.column("at").to_numpy()] = words.column("bits").to_numpy()

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((bitmap[at >> 6] >> (at & 63)) & 1 == 1))
            if batch.num_rows:
                yield batch

    return texts.withColumn("slot", slot("doc_id")).mapInArrow(lambda batches: _full_sets(width)(wanted(batches)), "doc_id bigint, full array<bigint>")


def _estimate(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Keep pairs whose share of common values among the k smallest of the union is large enough.

    Sets of at most k values are whole in their sketches, so that for two of them the Jaccard index itself decides.
    """
    union = F.array_union("sk_a", "sk_b")
    common = F.array_intersect("sk_a", "sk_b")
    low = F.slice(F.array_sort(union), 1, k)
    whole = (F.col("na") <= k) & (F.col("nb") <= k)
    return pairs.withColumn("estimate", F.when(whole, F.size(common) / F.size(union)).otherwise(F.size(F.array_intersect(common, low)) / F.size(low))).where(F.col("estimate") >= F.when(whole, percent / 100).otherwise(SHARE))


def _sized(a: str, b: str, percent: int):
    """Sets whose sizes differ too much can't be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links by their whole sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("full").alias("fa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("full").alias("fb"))
    both = F.size(F.array_intersect("fa", "fb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("fa") + F.size("fb") - both)).select("a", "b").distinct()


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


class _Postings:
    """Inverted lists of the values of many sets: how many values each set shares with another one."""

    def __init__(self, sets: list[np.ndarray]):
        self.flat, self.n = np.concatenate(sets), len(sets)
        owner = np.repeat(np.arange(self.n), [len(x) for x in sets])
        order = np.argsort(self.flat, kind="stable")
        self.flat, self.owner = self.flat[order], owner[order]

    def shared(self, values: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.flat, values, "left"), np.searchsorted(self.flat, values, "right")
        size = hi - lo
        at = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
        return np.bincount(self.owner[at], minlength=self.n)


def _block_links(k: int, percent: int):
    """Links between one block of classes outside their family's main component and one block of the whole family.

    Inverted lists of the sketches count what each pair shares; a pair that shares less than the estimate needs is dropped, as
    the estimate can't be larger; the whole sets decide on the others.  A link within what the block has linked already says
    nothing new, so a block gives fewer links than it has components.
    """

    def run(key: tuple, odd: pd.DataFrame, every: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(odd) and len(every):
            ids, sizes = every["id"].to_numpy(), every["n"].to_numpy()
            full = every["full"].to_list()
            held = np.minimum(sizes, k)
            sketches, whole = _Postings([x[:k] for x in full]), None
            _, label = np.unique(np.concatenate([every["comp"].to_numpy(), odd["comp"].to_numpy()]), return_inverse=True)
            root = np.arange(label.max() + 1)  # of each component, after the links found here
            label, own = label[: len(every)], label[len(every) :]
            for a, n, mine, values in zip(odd["id"].tolist(), odd["n"].tolist(), own.tolist(), odd["full"].to_list(), strict=True):
                shared = sketches.shared(values[:k])
                exact = (n <= k) & (sizes <= k)
                near = np.where(exact, 100 * shared >= percent * (n + sizes - shared), shared >= SHARE * np.minimum(min(n, k), held))
                near &= (root[label] != root[mine]) & (100 * np.minimum(n, sizes) >= percent * np.maximum(n, sizes))
                if not near.any():
                    continue
                whole = whole or _Postings(full)
                both = whole.shared(values)
                for i in np.flatnonzero(near & (100 * both >= percent * (n + sizes - both))).tolist():
                    if root[label[i]] != root[mine]:
                        root[root == root[label[i]]] = root[mine]
                        out.append((min(a, int(ids[i])), max(a, int(ids[i]))))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, k: int = K, list_cap: int = LIST_CAP) -> DataFrame:
    """Groups of documents whose sets of ``width``-word shingles have a Jaccard index of ``percent`` / 100 or more.

    Steps: (1) every whole text becomes its set of hashed shingles, of which the ``k`` smallest values are kept;
    (2) texts with equal sets form one class, so copies never meet each other; (3) an inverted list a
    retained value, for the INDEX smallest; each class is held against one pseudo-random leader of each of its lists and the best
    candidate by the union-sketch estimate is verified on the full sets; (4) short lists emit their pairs that are not yet
    in one component; (5) a pair that no short list holds shares LEAST values of long lists.  Classes with so many get new
    lists, of those of their LISTED smallest values that are rarest among them: as many as leave no room for a pair that could pass the estimate
    without one of them in common.  Short ones of these emit their pairs; classes that long ones tie together are a family, and
    what lies outside a family's main component is held against the whole family, block by block, with whole sets, so that a
    block says at once which of its components are one.  No list is cut or skipped.

    Defined results: null text counts as empty; a text without words has ``n_shingles`` 0 and is its own
    component; rows that repeat a ``doc_id`` are grouped each by its own text; a row with null ``doc_id`` is linked with
    nothing, its ``component_id`` is null and it is kept; an empty table gives no rows.  Other columns are ignored.

    Returns ``doc_id, n_shingles, component_id, kept`` for each row.
    """
    gathered = lambda df: cut(df, gather=True)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = cut(docs.mapInArrow(_sketches(width, k), _SKETCH))
    named = sketches.where("doc_id is not null and n_shingles > 0")
    classes = gathered(named.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")))
    nodes = classes.select("id", F.col("n_shingles").alias("n"), "sketch")

    posts = nodes.select("id", "n", F.explode(F.slice("sketch", 1, INDEX)).alias("v"))
    lists = posts.groupBy("v").agg(F.count("*").alias("df"), F.min(F.struct(F.xxhash64("id", "v").alias("h"), F.col("id"))).getField("id").alias("leader")).where("df > 1")
    posts = gathered(posts.join(lists, "v"))

    # leaders: the best candidate of each class first
    pairs = posts.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    seen = posts.select("id").distinct()
    own = gathered(nodes.join(seen, "id"))
    with_sketches = lambda p: p.join(own.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sk_a")), "a").join(own.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sk_b")), "b").where(_sized("na", "nb", percent))
    best = gathered(_estimate(with_sketches(pairs), k, percent).groupBy("a").agg(F.max_by("b", F.struct("estimate", "b")).alias("b")))
    texts = docs.where("doc_id is not null")
    links = gathered(_links(best, _sets_of(_ids(best), texts, width), percent))
    comp = components(links)

    # short lists: all pairs between components
    hot_count = posts.where(F.col("df") > list_cap).groupBy("id").agg(F.count("*").alias("hot"))
    at = own.join(comp.withColumnRenamed("node", "id"), "id", "left").join(hot_count, "id", "left").select("id", "n", "sketch", F.coalesce("component", "id").alias("comp"), F.coalesce("hot", F.lit(0)).alias("hot"))
    at = gathered(at)
    enough = F.when(F.col("n") >= INDEX, LEAST).otherwise(1)

    def pairs_of(rows: DataFrame) -> DataFrame:
        """Pairs of different components in each (short) list, with the number of lists that they share."""
        one, two = (rows.select("v", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "comp", "hot")]) for x in "ab")
        met = one.join(two, "v").where("id_a < id_b and comp_a <> comp_b").where(_sized("n_a", "n_b", percent))
        return met.groupBy(F.col("id_a").alias("a"), F.col("id_b").alias("b")).agg(F.count("*").alias("shared"), F.first(F.least("hot_a", "hot_b")).alias("hot"), F.first(F.least("n_a", "n_b")).alias("n"))

    short = posts.where(F.col("df") <= list_cap).select("id", "v").join(at.select("id", "n", "comp", "hot"), "id")
    met = pairs_of(short).where(F.col("shared") + F.col("hot") >= enough).select("a", "b")

    # classes of many long lists: lists of their rarest values
    dense = at.where(F.col("hot") >= enough)
    held = dense.select("id", "n", F.explode(F.slice("sketch", 1, LISTED)).alias("v"))
    # two sets that are whole in their lists are held to percent, others only to NEEDED: where a list has a cut set small enough for a whole partner
    mixed = (F.col("n") > LISTED) & (percent * F.col("n") <= 100 * LISTED)
    rare = held.join(held.groupBy("v").agg(F.count("*").alias("df"), F.max(mixed).alias("mixed")), "v")
    m = F.least("n", F.lit(LISTED))
    needed = F.when((F.col("n") <= LISTED) & ~(F.col("mixed") & (100 * F.col("n") > percent * LISTED)), F.ceil(percent * m / 100)).otherwise(F.ceil(NEEDED * m / LISTED))
    rare = rare.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("df", "v"))).where(F.col("nth") <= m - needed + 1)
    rare = gathered(rare.where("df > 1").select("id", "v", "df"))
    few = rare.where(F.col("df") <= list_cap).select("id", "v").join(at.select("id", "n", "comp", "hot"), "id")
    met = met.unionByName(pairs_of(few).select("a", "b"))

    # classes that long ones of these lists tie together are a family; what the leaders left outside its main component
    tied = rare.where(F.col("df") > list_cap).select("id", "v")
    heads = tied.groupBy("v").agg(F.min("id").alias("head"))
    family = components(tied.join(heads, "v").select(F.col("id").alias("a"), F.col("head").alias("b"))).select(F.col("node").alias("id"), F.col("component").alias("v"))
    long = at.join(tied.select("id").distinct(), "id", "left_semi").join(family, "id", "left").select(F.coalesce("v", "id").alias("v"), "id", "n", "comp")
    sizes = long.groupBy("v", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s")).groupBy("v").agg(F.max_by(F.struct("comp", "c", "s"), F.struct("c", "comp")).alias("main"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    blocks_of = lambda c, s: F.ceil(F.greatest(c / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.where("c > main.c").select("v", F.col("main.comp").alias("main"), blocks_of(F.col("c"), F.col("s")).alias("blocks"), blocks_of(F.expr("c - main.c"), F.expr("s - main.s")).alias("odd_blocks"))
    long = gathered(long.join(sizes, "v"))

    more = gathered(_estimate(with_sketches(met.distinct()), k, percent).select("a", "b"))
    sets = _sets_of(_ids(more).unionByName(long.select("id")).distinct(), texts, width)
    links = links.unionByName(_links(more, sets, percent))
    if not long.isEmpty():
        of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = long.join(sets.withColumnRenamed("doc_id", "id"), "id")
        odd = rows.where("comp <> main").select("v", "id", "n", "comp", "full", of("odd_blocks").alias("x"), upto("blocks").alias("y"))
        every = rows.select(*[F.col(c).alias(c) for c in ("v", "id", "n", "comp", "full")], of("blocks").alias("y"), upto("odd_blocks").alias("x"))
        links = links.unionByName(odd.groupBy("v", "x", "y").cogroup(every.groupBy("v", "x", "y")).applyInPandas(_block_links(k, percent), "a bigint, b bigint"))
    comp = components(links)

    copies = classes.where("copies > 1").select("s1", "s2", "n_shingles", "id")
    rows = sketches.select("doc_id", "n_shingles", "s1", "s2").join(copies, ["s1", "s2", "n_shingles"], "left")
    node = F.when(F.col("n_shingles") > 0, F.coalesce("id", "doc_id")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", "n_shingles", node.alias("node")).join(comp, "node", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node"))
    return rows.select("doc_id", "n_shingles", found.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: DuckDB SQL for the rows of op9_near_dedup over the view ``documents``: every pair of texts with a shingle in common, and all that each reaches.
SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * shared >= 75 * (len(p.s) + len(q.s) - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM reach r JOIN edges e ON e.a = r.y)
SELECT doc_id, len(s) AS n_shingles, min(y) AS component_id, doc_id = min(y) AS kept FROM sets JOIN reach ON x = doc_id GROUP BY doc_id, len(s)
"""
