"""Collocations: phrases whose words occur together more often than apart.

Only the longest windows are counted: each word with the four behind it, lead columns that are padded where the piece of text
ends. ``ROLLUP`` over lang and the lead columns sums the shorter prefixes, so that no phrase length is exploded by itself.
The lead columns come from whole texts in their order, batch by batch, and need no sort.

Most windows of five words occur once. A window therefore ends before a pair or a triple of words that can't be frequent, and a word that can't be
frequent is counted without its name: words and pairs, then triples of those pairs that are left, are counted before in tables of hashed
counters, whose totals are never below a phrase's own count. A phrase with the least count holds no such pair or triple, so no count of it
changes, whatever the size of the tables; small ones only cut fewer windows.

Tasks meet mostly the same windows. They are sent packed, in parts by hash, and summed before ``ROLLUP`` reads them, which so has each
window once however many tasks there are, until a part outgrows what a task may hold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from fitgauge.llm.shared import stored

LONGEST = 5
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
#: Texts of so many bytes are counted at a time.
SLICE_BYTES = 4 << 20
#: 2 ** 26 counters for pairs, as many for words and as many for triples: 24 MB of bits on the driver and on every executor.
TABLE_BITS = 26
#: Different windows that a task holds before it hands them on.
TASK_ROWS = 600_000
#: Counters that are sent and summed together.
BUCKET = 1 << 15
#: Parts, by hash, in which the windows of a task are sent.
PARTS = 256
#: Bytes that end a piece, bytes between words.
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)], KIND[list(BREAKS)] = 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def split_words(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """All words of the texts, A-Z in lower case, in order; for each its text and its piece."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = KIND[raw]
    inside = kind == 0
    before = np.r_[False, inside[:-1]] if len(raw) else inside
    before[ends[:-1][ends[:-1] < len(raw)]] = False
    starts = np.flatnonzero(inside & ~before)
    letters = LOWER[raw[inside]]
    offsets = np.r_[(np.cumsum(inside) - 1)[starts], len(letters)].astype(np.int32)
    text = np.searchsorted(ends[1:], starts, "right")
    piece = np.cumsum(kind == 2)[starts] + text
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes()))
    return words, text, piece


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.StringArray]]:
    """Langs and texts, some at a time. A text is never divided."""
    lang, text = batch.column(0).fill_null("und"), batch.column(1).cast(pa.large_string()).fill_null("")
    sizes = np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1])
    at = np.cumsum(sizes) // SLICE_BYTES
    cuts = np.flatnonzero(np.diff(at)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(text)]):
        yield lang[a:b], pa.array(text[a:b], pa.large_string()).cast(pa.string())


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class _Pairs:
    """Words of a slice as codes; for every word its counter and that of the pair that it begins, -1 where its piece ends."""

    def __init__(self, langs: pa.Array, texts: pa.StringArray):
        words, text, piece = split_words(texts)
        coded = words.dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        coded = langs.dictionary_encode()
        self.langs, self.lang = coded.dictionary, coded.indices.to_numpy().astype(np.int64)[text]
        h = np.array([zlib.crc32(w.encode()) for w in self.words.to_pylist()], np.uint64)
        seed = np.array([zlib.crc32(w.encode()) for w in self.langs.to_pylist()], np.uint64)
        seed = seed[self.lang]
        self.single = _mixed(h[self.code] ^ seed << np.uint64(32)) + (1 << TABLE_BITS)
        self.pair = np.full(len(self.code), -1, np.int64)
        if len(self.code) > 1:
            both = _mixed(h[self.code[:-1]] * np.uint64(0x9E3779B97F4A7C15) ^ h[self.code[1:]] + seed[:-1])
            self.pair[:-1] = np.where(piece[1:] == piece[:-1], both, -1)


    def triple(self, goes_on: np.ndarray) -> np.ndarray:
        """The counter of the triple that a word begins; -1 unless both its pairs go on."""
        out = np.full(len(self.code), -1, np.int64)
        if len(out) > 2:
            h = self.pair[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ self.pair[1:-1].astype(np.uint64)
            out[:-2] = np.where(goes_on[:-2] & goes_on[1:-1], _mixed(h), -1)
        return out


def often(bits: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Whether the counters' bits are set; no counter (-1) has none."""
    at = np.maximum(counter, 0)
    return (counter >= 0) & (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _words_and_pairs(p: _Pairs) -> np.ndarray:
    return np.r_[p.pair[p.pair >= 0], p.single]


def _triples(bits: Broadcast):
    def of(p: _Pairs) -> np.ndarray:
        found = p.triple(often(bits.value, p.pair))
        return found[found >= 0]

    return of


def _count(counters):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a slice, packed by bucket: the places of counters in it, two bytes each, and their counts, four bytes each."""
        for batch in batches:
            for langs, texts in _slices(batch):
                counter, n = np.unique(counters(_Pairs(langs, texts)), return_counts=True)
                bucket, starts = np.unique(counter // BUCKET, return_index=True)
                ends = np.r_[starts, len(counter)]
                packed = [
                    pa.BinaryArray.from_buffers(pa.binary(), len(bucket), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])
                    for x in ((counter % BUCKET).astype(np.uint16), n.astype(np.uint32))
                ]
                for a in range(0, len(bucket), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[a : a + 1000].astype(np.int32)), *(x[a : a + 1000] for x in packed)], names=["bucket", "at", "n"])

    return count


def _often(least: int):
    def sum_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bits of counters that reach ``least``, for sorted buckets; one bucket is summed at a time."""
        bucket, total = None, np.zeros(BUCKET, np.int64)

        def bits() -> pa.RecordBatch:
            packed = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([packed], pa.binary())], names=["bucket", "bits"])

        for batch in batches:
            for b, at, n in zip(batch.column("bucket").to_pylist(), batch.column("at"), batch.column("n")):
                if b != bucket:
                    if bucket is not None:
                        yield bits()
                    bucket, total = b, np.zeros(BUCKET, np.int64)
                total[np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), np.uint32)  # places of a slice differ
        if bucket is not None:
            yield bits()

    return sum_buckets


def frequent(docs: DataFrame, counters, least: int, size: int) -> np.ndarray:
    """The bits of those of ``size`` counters that reach ``least`` over all documents."""
    counted = docs.select("lang", "text").mapInArrow(_count(counters), "bucket int, at binary, n binary")
    summed = counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_often(least), "bucket int, bits binary")
    bits = np.zeros(max(BUCKET, size) >> 3, np.uint8)
    for row in summed.toLocalIterator():
        bits[row.bucket * BUCKET >> 3 : (row.bucket + 1) * BUCKET >> 3] = np.frombuffer(bytes(row.bits), np.uint8)
    return bits


KEYS = ["lang", *WORDS]


def _grouped(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(KEYS).aggregate([("n", "sum")]).select([*KEYS, "n_sum"]).rename_columns([*KEYS, "n"])


def _parted(found: pa.Table) -> Iterator[pa.RecordBatch]:
    """Windows packed by part: one row for all those of a part."""
    h = np.zeros(found.num_rows, np.uint64)
    for name in KEYS:
        coded = found[name].combine_chunks().dictionary_encode()
        h = h * np.uint64(0x9E3779B97F4A7C15) ^ np.array([zlib.crc32(w.encode()) for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
    part = _mixed(h) * PARTS >> TABLE_BITS
    order = np.argsort(part, kind="stable")
    found, (parts, starts) = found.take(pa.array(order)).combine_chunks(), np.unique(part[order], return_index=True)
    for p, a, b in zip(parts, starts, [*starts[1:], found.num_rows]):
        packed = pa.BufferOutputStream()
        with pa.ipc.new_stream(packed, found.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(found.slice(a, b - a))
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([packed.getvalue().to_pybytes()], pa.binary())], names=["part", "windows"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows summed over all tasks, for sorted parts; one part is summed at a time. A window comes once as far as ``TASK_ROWS`` allow;
    ``ROLLUP`` sums again what a larger part hands on in between."""
    part, held, rows = None, [], 0
    for batch in batches:
        for p, packed in zip(batch.column("part").to_pylist(), batch.column("windows")):
            if p != part and held:
                yield from _grouped(held).combine_chunks().to_batches(50_000)
                held, rows = [], 0
            part = p
            held.append(pa.ipc.open_stream(packed.as_buffer()).read_all())
            rows += held[-1].num_rows
            if rows > TASK_ROWS:
                held = [_grouped(held)]
                rows = held[0].num_rows
                if rows > TASK_ROWS // 2:
                    yield from held.pop().combine_chunks().to_batches(50_000)
                    rows = 0
    if held:
        yield from _grouped(held).combine_chunks().to_batches(50_000)


def _windows(pairs: Broadcast, triples: Broadcast):
    def windows(p: _Pairs) -> pa.Table:
        goes_on = often(pairs.value, p.pair)
        after = often(triples.value, p.triple(goes_on))
        n, none, alive = len(p.code), len(p.words), often(pairs.value, p.single)
        columns = [p.lang, np.where(alive, p.code, none)]
        for j in range(1, LONGEST):
            alive = alive & (goes_on if j == 1 else np.r_[after[j - 2 :], np.zeros(j - 2, bool)][:n])
            columns.append(np.where(alive, np.r_[p.code[j:], np.zeros(j, np.int64)][:n], none))
        found = _grouped([pa.table([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(np.ones(n, np.int64))], names=["lang", *WORDS, "n"])])
        named = pa.concat_arrays([p.words, pa.array([""])])
        texts = [p.langs.take(found["lang"].combine_chunks()), *(named.take(found[w].combine_chunks()) for w in WORDS)]
        return pa.table([*texts, found["n"]], names=["lang", *WORDS, "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of all slices of a task together, as far as ``TASK_ROWS`` allow, packed by part."""
        held: list[pa.Table] = []
        for batch in batches:
            for langs, texts in _slices(batch):
                held.append(windows(_Pairs(langs, texts)))
                if sum(t.num_rows for t in held) > TASK_ROWS:
                    held = [_grouped(held)]
                if held[0].num_rows > TASK_ROWS // 2:
                    yield from _parted(held.pop(0))
        if held:
            yield from _parted(_grouped(held))

    return count


def phrase_counts(docs: DataFrame, least: int) -> DataFrame:
    """``lang``, ``m`` (words; 0: all words of the lang), ``phrase``, ``f`` of every phrase of up to five words that occurs ``least`` times."""
    context, size = docs.sparkSession.sparkContext, 1 << TABLE_BITS
    pairs = context.broadcast(frequent(docs, _words_and_pairs, least, 2 * size))
    triples = context.broadcast(frequent(docs, _triples(pairs), least, size))
    sent = docs.select("lang", "text").mapInArrow(_windows(pairs, triples), "part int, windows binary")
    windows = sent.repartition("part").sortWithinPartitions("part").mapInArrow(_merged, ", ".join(f"{k} string" for k in KEYS) + ", n bigint")
    summed = windows.rollup("lang", *WORDS).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    m = F.greatest(F.lit(LONGEST) - F.bit_count("level"), F.lit(0))
    last = F.element_at(F.array(F.lit("-"), *map(F.col, WORDS)), m + 1)
    # the last level sums all langs; an empty word is padding
    kept = summed.where("lang is not null").withColumn("m", m).where((last != "") & ((F.col("f") >= least) | (F.col("m") == 0)))
    return kept.select("lang", "m", F.concat_ws(" ", *WORDS).alias("phrase"), "f")


def _words(column: str) -> Column:
    return F.split(F.col(column), " ")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of two to five words of each lang by score: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A phrase occurs ``a`` times, at least ``least``; cut into two parts with ``l`` and ``r`` occurrences it scores floor(1000 a n / (l r)), where the
    lang has ``n`` words; the lowest cut counts, the first of equal ones. A phrase within a longer one of the same count is dropped. Ties
    end on ``a``, then on the phrase. A null lang is ``und``, a null text has no words; repeated rows count each; an
    empty table has no phrases. Other columns are not read. Texts are counted whole; every stage is a sum or a join on phrases that occur
    ``least`` times, and ranks are cut before the shuffle.
    """
    counts = stored(phrase_counts(docs, least), "phrases")
    total = counts.where("m = 0").select("lang", F.col("f").alias("n"))
    found = counts.where("m >= 2").select("lang", "m", "phrase", F.col("f").alias("a"))
    longer = found.where("m >= 3").withColumn("words", _words("phrase"))
    size, start = F.explode(F.sequence(F.lit(2), F.col("m").cast("int") - 1)), F.explode(F.expr("sequence(1, m - size + 1)"))
    inner = longer.withColumn("size", size).withColumn("start", start)
    inner = inner.groupBy(F.col("lang").alias("in_lang"), F.expr("array_join(slice(words, start, size), ' ')").alias("in_phrase")).agg(F.max("a").alias("in_a"))
    kept = found.join(inner, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase")) & (F.col("in_a") >= F.col("a")), "left_anti")
    cuts = kept.withColumn("words", _words("phrase")).withColumn("k", F.explode(F.expr("sequence(1, cast(m as int) - 1)")))
    cuts = cuts.selectExpr("lang", "phrase", "a", "k", "array_join(slice(words, 1, k), ' ') as head", "array_join(slice(words, k + 1, size(words) - k), ' ') as tail")
    parts = counts.where("m > 0")
    heads = parts.select(F.col("lang").alias("h_lang"), F.col("phrase").alias("h"), F.col("f").alias("l"))
    tails = parts.select(F.col("lang").alias("t_lang"), F.col("phrase").alias("t"), F.col("f").alias("r"))
    cuts = cuts.join(heads, (F.col("lang") == F.col("h_lang")) & (F.col("head") == F.col("h")))
    cuts = cuts.join(tails, (F.col("lang") == F.col("t_lang")) & (F.col("tail") == F.col("t")))
    cuts = cuts.join(total.select(F.col("lang").alias("n_lang"), "n"), F.col("lang") == F.col("n_lang"))
    whole = "cast({} as decimal(38,0))".format
    score = F.expr(f"{whole('a')} * {whole('n')} * 1000 div ({whole('l')} * {whole('r')})")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    lowest = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return lowest.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
