"""Conversation repair against a plain walk over all edits, and the matrices' laws."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from vigia.llm import repair
from vigia.llm.queries import op13_conversation_repair

NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def faults_of(rows):
    seen = set()
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        yield "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))


def walked(rows):
    """The cheapest (cost, audit, lines) by one step a row over the four states."""

    def put(at, state, way):
        if state is not None and (state not in at or way[:2] < at[state][:2]):
            at[state] = way

    def inserted(at):
        for _ in range(4):
            for state, (cost, audit, lines) in list(at.items()):
                for r in "ua":
                    put(at, NEXT[r][state], (cost + 3, audit + "I", [*lines, repair.ROLES[r] + ":"]))
        return at

    at = {0: (0, "", [])}
    for (role, text), fault in zip(rows, faults_of(rows), strict=True):
        to = {}
        for state, (cost, audit, lines) in inserted(at).items():
            put(to, state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if role[:1] in NEXT:
                put(to, NEXT[role[:1]][state], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            for r in "ua":
                put(to, NEXT[r][state], (cost + more + 3, audit + "R", [*lines, f"{repair.ROLES[r]}:{text}"]))
        at = to
    at = inserted(at)
    return min((at[s] for s in (0, 3) if s in at), key=lambda w: w[:2])


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text, out = " " if role is None else role, " " if text is None else text, own[conv]
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(turn, "user" if what == 4 else role, text)] * {0: 0, 3: 2}.get(what, 1)
    found = {}
    for conv, turns in own.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
        known, rows = [t[0] for t in turns if t[0] is not None], [t[1:] for t in turns]
        faults = list(faults_of(rows))
        cost, audit, lines = walked(rows)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        found[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def got(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op13_conversation_repair(spark, sf_dir)) == plain(rows)


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_rows_and_a_conversation_over_many_partitions(spark, many_partitions):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, *range(30)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["a.", "b", "c!", " ", "", None, "d.\n", "e", "f?", "g."])) for _ in range(300)]
    rows += [(77, i, rng.choice(["user", "assistant", "system"]), f"{rng.choice(['x.', 'y', 'z!'])}{i % 900}{rng.choice(['.', ''])}") for i in range(3000)]
    rows += [(78, None, "user", "same.")] * 50 + [(79, 5, "x", None)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int").repartition(7)
    after = repair.damage(turns)
    assert after.where("conv_id = 77").repartitionByRange("conv_id", "turn").rdd.getNumPartitions() > 16
    assert got(repair.report(turns)) == plain(rows)


def test_repaired_turns_have_the_form(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", "Why?", ""]) + str(t) + rng.choice(["", "."])) for c in range(30) for t in range(rng.randrange(0, 9))]
    summary, repaired = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    roles = defaultdict(str)
    for r in repaired.orderBy("conv_id", "pos", "step").collect():
        roles[r["conv_id"]] += r["role"][0]
    summary = summary.collect()
    assert len(summary) == len({r[0] for r in rows})
    for r in summary:
        assert re.fullmatch("(s?(ua)+)?", roles[r["conv_id"]])
        assert len(re.sub("I", "", r["audit"])) == r["n_rows"] and len(re.sub("D", "", r["audit"])) == len(roles[r["conv_id"]])


def test_product_is_associative_and_equals_every_choice_of_edits():
    rng = random.Random(1)
    turns = [(rng.choice(["s", "u", "a", ""]), rng.choice(["", "", "truncated", "blank"])) for _ in range(200)]
    matrices = [repair._MATRICES[t] for t in turns]
    left = repair._identity()
    for m in matrices:
        left = repair._times(left, m)
    right = repair._identity()
    for m in reversed(matrices):
        right = repair._times(m, right)
    assert left == right == repair._product(iter(turns))
    for n in range(4):
        for roles in product(["user", "assistant", "system", "x"], repeat=n):
            rows = [(r, f"{i}{'.' if i % 2 else ''}") for i, r in enumerate(roles)]
            whole = repair._times(repair._product((r[:1], f) for (r, _), f in zip(rows, faults_of(rows), strict=True)), repair.CLOSURE)
            best = min(whole[j] for j in repair.ENDS if whole[j])
            assert (best[0], best[1].translate(str.maketrans("JS", "IR"))) == walked(rows)[:2]


def test_empty_table(spark):
    assert repair.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
