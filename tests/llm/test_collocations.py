"""Collocations against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from fitgauge.llm import collocations

DOCS = "doc_id long, text string, lang string"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, top):
    counts, totals = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + m])) for m in range(1, 6) for i in range(len(words) - m + 1))
    counts = {k: f for k, f in counts.items() if f >= least}
    longest = collections.Counter()
    for (lang, words), f in counts.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                key = lang, words[i : i + m]
                longest[key] = max(longest[key], f)
    out = collections.defaultdict(list)
    for (lang, words), a in counts.items():
        if len(words) > 1 and longest[lang, words] < a:
            n = totals[lang]
            cuts = [(1000 * a * n // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]], n))
    return sorted(
        (lang, rank, phrase.decode(), -a, l, r, n, -score)
        for lang, found in out.items() for rank, (score, a, phrase, l, r, n) in enumerate(sorted(found)[:top], 1))


def texts(seed):
    rng = random.Random(seed)
    words = ["The", "the", "a", "É", "é", "new", "york", "times", "x-1", "\x00", " ", "ß", "\x0e"] + [f"rare{i}" for i in range(200)]
    weights = [40] * 13 + [1] * 200
    seps = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!?", ": "]
    rows = []
    for i in range(150):
        text = "".join(w + rng.choice(seps) for w in rng.choices(words, weights, k=rng.randint(0, 60)))
        rows.append((i, text + " New York Times of old" * (i % 3), rng.choice(["en", "en", "de", "und", None])))
    return [*rows, *rows[:9], (None, None, "en"), (1, "", None), (2, " .,\n", "fr"), (3, "a a a a a a a a", "fr"), (4, "long text " * 20_000, "en")]


@pytest.mark.parametrize("bits,top", [(26, 2000), (4, 3)])
def test_collocations(spark, monkeypatch, bits, top):
    """Also with many slices and with a table that cuts nothing, as one with too few counters does."""
    if bits != 26:
        monkeypatch.setattr(collocations, "SLICE_BYTES", 500)
        monkeypatch.setattr(collocations, "TASK_ROWS", 300)
        monkeypatch.setattr(collocations, "frequent", lambda docs, counters, least, size: np.full(size >> 3, 255, np.uint8))
    rows = texts(bits)
    df = spark.createDataFrame(rows, DOCS)
    for name in ("m", "n", "w1", "level", "phrase", "f", "a", "k", "rank"):
        df = df.withColumn(name, F.lit("x"))
    for least in (2, 7):
        got = collocations.collocations(df, least, top)
        assert sorted(map(tuple, got.collect())) == brute(rows, least, top)


def test_windows_are_handed_on_once(spark, monkeypatch):
    """However many tasks and slices meet a window, ``ROLLUP`` reads it once."""
    monkeypatch.setattr(collocations, "SLICE_BYTES", 500)
    rows = texts(3)[:40]
    df = spark.createDataFrame(rows * 6, DOCS).repartition(12)
    seen = []
    rollup = DataFrame.rollup
    monkeypatch.setattr(DataFrame, "rollup", lambda df, *by: seen.append(df) or rollup(df, *by))
    got = sorted(map(tuple, collocations.collocations(df, 2).collect()))
    assert got == brute(rows * 6, 2, 2000)
    windows = seen[0]
    assert windows.count() == windows.select("lang", *collocations.WORDS).distinct().count() > 0


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []


def test_split_words_of_a_slice_of_an_array():
    array = pa.array(["skipped", "Ab\tCÉ.d", "", None, "e  f"]).fill_null("")[1:]
    words, text, piece = collocations.split_words(array)
    assert words.to_pylist() == ["ab", "cÉ", "d", "e", "f"] and list(text) == [0, 0, 0, 3, 3]
    assert [a == b for a, b in zip(piece, piece[1:])] == [True, False, False, True]


def test_counters_sum_over_slices(spark, monkeypatch):
    """A bit is set where all slices together reach the least count; functions in tasks see the module's own slice size."""
    rows = texts(1)
    counts = collections.Counter()
    p = collocations._Pairs(pa.array(["und" if lang is None else lang for *_, lang in rows]), pa.array([t or "" for _, t, _ in rows]))
    counts.update(p.pair[p.pair >= 0].tolist())
    counts.update(p.single.tolist())
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    bits = collocations.frequent(df, collocations._words_and_pairs, 4, 2 << collocations.TABLE_BITS)
    assert set(np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()) == {c for c, n in counts.items() if n >= 4}
