"""The pipeline, stage by stage, against brute force."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from fitgauge.llm import quality
from test_operators import counted, fingerprint, union


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, written and read again."""
    root = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(root / str(i)))
        docs = spark.read.parquet(str(root / str(i)))
        out.append(docs)
    return [[r.asDict() for r in df.collect()] for df in out]


def covariance_determinant(x):
    """Centre and inverse scatter: the better of two descents, on exactly the nearest rows."""
    n, p = x.shape
    wanted = math.ceil(n * quality.SHARE)
    found = []
    for robust in (True, False):
        centre = np.median(x, axis=0) if robust else x.mean(axis=0)
        spread = np.diag((1.4826 * np.median(np.abs(x - centre), axis=0)) ** 2 + np.square(quality.FLOORS))
        scatter = spread if robust else np.cov(x.T, bias=True) * quality.consistency() + np.diag(np.square(quality.FLOORS))
        for _ in range(30):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
            near = x[np.argsort(d, kind="stable")[:wanted]]
            centre, scatter = near.mean(axis=0), np.cov(near.T, bias=True) * quality.consistency() + np.diag(np.square(quality.FLOORS))
        found.append((np.linalg.slogdet(scatter)[1], centre, np.linalg.inv(scatter)))
    return min(found, key=lambda f: f[0])[1:]


def test_quality_stage(stages):
    before, after = stages[0], stages[1]
    good, vectors = [], []
    for r in before:
        n, chars, symbols, lines, repeated = counted(r["text"])
        if n >= 50 and 100 * repeated <= 50 * n:
            good.append(r)
            vectors.append((math.log(n), math.log(chars / n), math.asinh(100 * symbols / n), math.sqrt(repeated / n), math.log1p(lines)))
    # no language has enough documents here for an estimate of its own
    assert max(collections.Counter(r["lang"] for r in good).values()) < quality.GROUP_ROWS
    x = np.array(vectors)
    centre, precision = covariance_determinant(x)
    distance = np.einsum("ij,jk,ik->i", x - centre, precision, x - centre)
    expected = {r["doc_id"] for r, d in zip(good, distance) if d <= quality.limit()}
    assert {r["doc_id"] for r in after} == expected and 0 < len(expected) < len(good)
    assert len(after) == len(expected)


def test_near_duplicate_stage(stages):
    before, after = sorted(stages[1], key=lambda r: r["doc_id"]), stages[2]
    prints = [fingerprint(r["text"]) for r in before]
    pairs = [(i, j) for i in range(len(before)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    kept = {before[r]["doc_id"] for r in union(len(before), pairs)}
    assert sorted(r["doc_id"] for r in after) == sorted(kept) and len(kept) < len(before)


def test_decontamination_stage(stages, spark):
    flat = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [flat(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = [r["doc_id"] for r in stages[2] if not any(x in flat(r["text"]) for x in items)]
    assert sorted(r["doc_id"] for r in stages[3]) == sorted(clean) and len(clean) < len(stages[2])


def test_mixing_stage(stages):
    size = collections.Counter()
    for r in stages[3]:
        size[r["source"]] += len(r["text"].encode())
    weights = sum(n**0.5 for n in size.values())
    expected = collections.Counter()
    for r in stages[3]:
        rate = sum(size.values()) * (size[r["source"]] ** 0.5 / weights) / size[r["source"]]
        u = int(hashlib.md5(f"42:0:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        total = p
        while total <= u:
            k += 1
            p = p * rate / k
            total += p
        expected[r["doc_id"]] = k
    assert collections.Counter(r["doc_id"] for r in stages[4]) == +expected
    assert list(stages[4][0]) == list(stages[0][0])


def test_sharding_stage(stages):
    key = lambda t: int(hashlib.md5(str(t).encode()).hexdigest()[:15], 16)
    rows = sorted(stages[4], key=lambda r: (key(r["text"]), key(r["doc_id"])))
    total, before, expected = sum(len(r["text"].encode()) + 16 for r in rows), 0, collections.Counter()
    for r in rows:
        expected[r["doc_id"], before * corpus_pipeline.SHARDS // total] += 1
        before += len(r["text"].encode()) + 16
    assert collections.Counter((r["doc_id"], r["shard"]) for r in stages[5]) == expected
    slots = collections.defaultdict(list)
    for r in stages[5]:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_gives_the_last_stage(spark, stages):
    rows = collections.Counter((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert rows == collections.Counter((r["doc_id"], r["shard"]) for r in stages[5])


#: extra columns named like helper columns of the stages
HELPERS = ("_id", "_key", "_lang", "_source", "_own_id", "_own_key", "_kept_id", "_kept_key", "_group", "_rate", "_count", "_size", "_part", "_row", "_packed",
           "fp", "kept", "rate", "text_key")


def test_pipeline_of_odd_tables(spark, tmp_path):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, "", "en", "a", 0), (2, "word " * 20, "en", "a", 100), (2, "word " * 20, "en", "a", 100)]
    text = " ".join(f"w{i}" for i in range(80))
    for i, table in enumerate(([], rows, [*rows, (3, text, None, None, None), (3, text, None, None, None), (None, text + " x", "en", "b", 1)])):
        docs = spark.createDataFrame(table, schema)
        if i:
            docs = docs.select("*", *(F.lit("x").alias(c) for c in HELPERS))
        docs.write.parquet(str(tmp_path / str(i) / "documents.parquet"))
        spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(tmp_path / str(i) / "benchmark.parquet"))
        found = corpus_pipeline.run(spark, str(tmp_path / str(i))).collect()
        assert {r.doc_id for r in found} <= {3, None} and (i == 2 or not found)
        assert all(r[c] == "x" for r in found for c in HELPERS)
