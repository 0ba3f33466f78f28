"""Secrets against regular expressions run over every text, and what the trigram queries ask for."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from fitgauge.llm import queries, secrets

DOCS = "doc_id long, text string"
#: The base rules as they were given, with their least lengths apart.
GIVEN = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, re.I | re.A),
    "access": ("AKIA[A-Z0-9]+", 0, 18, re.A), "hex": ("[0-9a-f]+", 0, 16, re.A),
}


def brute(text):
    text, found = text or "", []
    for n, r in enumerate(secrets.RULES):
        pattern, group, least, flags = GIVEN.get(r.kind, (r.pattern, r.group, r.least, re.A))
        found += [(m.start(), n, m.end(), r.kind) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def texts():
    rng = random.Random(3)
    parts = [
        "password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "api__key", "=", ":", " = ", "\"'", "'", " ", "  ", "\n", "é", "𝄞", "AKIA", "AKIAABCDEFGH1234", "ABCDEFGHIJ12345",
        "0123456789abcdef", "deadbeef", "short", "abcdefghijkl", "a+b/c_d.e=f-g", "eyJhbGciOi", ".", "ghp_", "A" * 40, "xoxb-1234567890", "AIza" + "x" * 35,
        "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "https://user:pass@host", "token=secret: abcdefghijklmnop", "ſecret=abcdefghijklmnop", "toKen=abcdefghijklmnop",
        "token==abcdefghijklmnop", "tokentoken='0123456789abcdef0123'",
    ]
    made = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(400)]
    return [*made, None, "", " ", "𝄞" * 20 + "token=" + "b" * 20, "x" * 100_000 + " api_key: 'abcdefghijklmnop' ", "token=abcdefghijkl " * 5_000, made[0], made[0]]


def test_spans(spark):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("row", "mask", "gram", "low", "i", "rule", "spans", "found_row", "end"):
        df = df.withColumn(name, F.lit("x"))
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in secrets.spans(df).collect()]
    assert sorted(got, key=str) == sorted([(i, brute(t)) for i, t in rows], key=str)


def test_shuffled_candidates_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(secrets, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame(list(enumerate(texts()[:60])), DOCS)
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.spans(df).collect()} == {i: brute(t) for i, t in enumerate(texts()[:60])}


def test_empty_table(spark):
    assert secrets.spans(spark.createDataFrame([], DOCS)).collect() == []


def test_query_columns(spark, tmp_path):
    rows = [(1, "token = abcdefghijkl and AKIA" + "Z" * 14 + " xoxb-1234567890"), (2, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_secrets(spark, str(tmp_path)).collect()}
    base = "assign:0:20,access:25:43"
    assert tuple(got[1]) == (1, 1, 1, 0, hashlib.sha256(base.encode()).hexdigest(), base + ",slack:44:59")
    assert tuple(got[2]) == (2, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")


def test_matches_hold_an_alternative_of_their_query():
    found = 0
    for r in secrets.RULES:
        query = secrets.trigram_query(r.pattern)
        for text in texts():
            for m in re.finditer(r.pattern, text or "", re.A | (re.I if r.ignore_case else 0)) if query else ():
                held = m[0].lower()
                found += 1
                assert any(all(g in held for g in grams) for grams in query)
    assert found > 500


@pytest.mark.parametrize("pattern,query", [
    ("abcd", [{"abc", "bcd"}]), ("ab?cde", [{"abc", "bcd", "cde"}, {"acd", "cde"}]), ("[0-9a-f]{16,}", None), ("x*", None), ("(abc|def)+g", [{"abc"}, {"def"}]),
    ("ab[cd]e", [{"abc", "bce"}, {"abd", "bde"}]), ("abc|ab", None), ("abc.def", [{"abc", "def"}]), ("a{3}", [{"aaa"}]), ("(ab){2,}", [{"aba", "bab"}]), ("ABCé", [{"abc"}]),
])
def test_trigram_queries(pattern, query):
    got = secrets.trigram_query(pattern)
    assert (got and sorted(map(sorted, got))) == (query and sorted(map(sorted, query)))


def test_no_python_in_the_plan(spark):
    plan = secrets.spans(spark.createDataFrame([(1, "x")], DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
