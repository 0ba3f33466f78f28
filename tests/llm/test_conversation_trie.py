"""The trie of rebuilt conversations against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from fitgauge.llm import conversation_trie as ct, queries

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = [f.split(" ")[0] for f in ct.NODE.split(", ")]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    """The nodes by dictionaries of whole sequences."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t for *_, t in sorted(x, key=lambda x: x[:2])] for c, x in own.items()}
    whole, nodes = {}, collections.defaultdict(list)
    for c in sorted(own):
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            nodes[whole[c][:d]].append(c)
    children = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    ends = {k: ",".join(str(c) for c in members if whole[c] == k) for k, members in nodes.items()}
    return sorted(
        ((m[0], len(k), nodes[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest())
         for k, m in nodes.items()), key=str)


def built(df):
    return sorted((tuple(r) for r in ct.prefix_trie(*ct.rebuilt(df)).select(*NAMES).collect()), key=str)


def agrees(spark, rows):
    return built(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_given_conversations(spark):
    df = queries.op11_conversation_trie(spark, SMALL)
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in df.select(*NAMES).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("seed", [0, 1])
def test_few_texts_nulls_ties_repeats_and_negative_ids(spark, seed):
    rng = random.Random(seed)
    rows = [
        (c, rng.choice([t, t, t, None]), rng.choice(["u", "u", "a", None]), rng.choice(["x", "x", "x", "yé", None, ""]))
        for c in rng.sample(range(-30, 120), 90) for t in range(rng.choice([1, 2, 3, 4, 9, 12])) if rng.random() < 0.9
    ]
    assert agrees(spark, rows + rows[:5] + [(None, 1, "u", "x")])


def test_copies_over_many_blocks_beside_a_long_conversation(spark):
    rows = [(5 * c, t, "u", f"t{t}") for c in range(100) for t in range(20)] + [(9_999_995, t, "u", f"z{t % 7}") for t in range(150)]
    rows += [(5 * c, t, "u", f"t{t}" if t < 9 else f"own {c} {t}") for c in range(200, 260) for t in range(12)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert agrees(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table_and_conversations_without_turns(spark):
    assert built(spark.createDataFrame([], SCHEMA)) == []
    rows = [(6, 0, "u", "x"), (7, 0, "u", "x")]  # their opening is of a conversation that is absent, and longer than they are
    assert agrees(spark, rows) and len(brute(rows)) == 1


def test_extra_columns_and_long_texts(spark):
    rows = [(c, t, "u", "long " * 50_000 if t == 1 else "x") for c in (0, 1, 2, 5) for t in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("pos", "key", "size", "n", "h", "m", "cut", "c", "block", "owner", "depth", "_h", "rest", "place", "part"):
        df = df.withColumn(name, F.lit("x"))
    assert built(df) == brute(rows)


def test_minima():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 65):
        values = rng.integers(0, 5, n)
        table, at, bound = ct.Minima(values), np.arange(n), rng.integers(0, 6, n)
        low = np.array([rng.integers(0, i + 1) for i in at])
        assert (table.least(low, at) == [values[a : b + 1].min() for a, b in zip(low, at)]).all()
        for i, b, r, x in zip(at, bound, table.right(at, bound), table.left(at, bound)):
            assert r == max(j for j in range(i, n) if (values[i + 1 : j + 1] >= b).all())
            assert x == min(j for j in range(-1, i + 1) if (values[j + 1 : i + 1] >= b).all())
