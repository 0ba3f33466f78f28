"""Repeated windows of a corpus, exactly: the plan that the suffix-array and the Lempel-Ziv operator share.

A window is ``window`` consecutive tokens of one document. Its anchor is the leftmost of its ``gram``-token sequences with the
least hash, so equal windows have equal anchors at equal offsets, and consecutive windows mostly share theirs: a document is
a sequence of runs of windows with one anchor each.

1. Documents are packed into shards of some megabytes, one row each, stored bucketed by shard together with their runs.
2. Every shard sends the sorted distinct hashes of its anchors to hash ranges (four bytes each); a range answers each shard
   with one bit per hash: does it occur again?
3. Every shard sends the runs with such an anchor to the ranges: the text of the run's windows, distinct within the shard,
   with a weight. A range compares the windows (this is the operator's part) and answers one bit per window.
4. Every shard marks its windows and returns each document's covered tokens.

The shards are read three times but never move: only hashes, candidate runs and bits are shuffled. Copies collapse in the
shards, so that a hot passage reaches its range once from each shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fitgauge.llm.shared import shared_root, stored

U64 = np.uint64
HIGH, LOW = U64(0xFFFFFFFF00000000), U64(0xFFFFFFFF)
#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20
#: Bytes of text for each bucket of the stored shards, and for each hash range.
BUCKET_BYTES, RANGE_BYTES = 16 << 20, 12 << 20
#: Stands for a null id: after all others.
NO_ID = np.iinfo(np.int64).max


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def row_hash(columns: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of a matrix of 64-bit numbers, from a start value for each."""
    h = start.astype(U64)
    for i in range(columns.shape[1]):
        h = (h ^ columns[:, i]) * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(29)
    return mixed(h)


def spans_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges start, start + 1, ... end to end."""
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(starts - first, sizes)


@dataclass
class Tokens:
    """A shard's tokens: by document where they end, and a 64-bit hash of the gram at each token."""

    doc_start: np.ndarray
    doc_end: np.ndarray
    grams: np.ndarray
    #: what else the kind of tokens keeps
    state: dict


@dataclass(frozen=True)
class Runs:
    start: np.ndarray  # first window's first token
    length: np.ndarray  # windows
    anchor: np.ndarray  # the anchor's first token
    doc: np.ndarray


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Where the leftmost least of ``width`` hashes (their upper halves) stands, for each first position."""
    out = np.empty(max(0, len(h) - width + 1), np.uint32)
    for low in range(0, len(out), 1 << 16):
        high = min(len(out), low + (1 << 16))
        part = h[low : high + width - 1]
        least, size = (part & HIGH) | np.arange(len(part), dtype=U64), 1
        while 2 * size <= width:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        out[low:high] = (least & LOW) + U64(low)
    return out


def _windows(t: Tokens, window: int) -> tuple[np.ndarray, np.ndarray]:
    """By document: its number of windows, and what to add to a window's number to get its first token."""
    count = np.maximum(t.doc_end - t.doc_start - window + 1, 0)
    return count, t.doc_start - (np.cumsum(count) - count)


def find_runs(t: Tokens, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs as two byte arrays: windows, and tokens from the first window to the anchor."""
    count, shift = _windows(t, window)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    at = np.arange(total) + np.repeat(shift, count)
    anchor = sliding_least(t.grams, window - gram + 1)[at]
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return np.diff(np.append(new, total)).astype(np.uint8), (anchor[new] - at[new]).astype(np.uint8)


def restored(t: Tokens, window: int, length: np.ndarray, off: np.ndarray) -> Runs:
    count, shift = _windows(t, window)
    number = np.cumsum(length, dtype=np.int64) - length
    doc = np.searchsorted(np.cumsum(count), number, "right")
    start = number + shift[doc] if len(number) else number
    return Runs(start, length.astype(np.int64), start + off, doc)


class Kind:
    """What a token is. ``combine`` joins the weights of equal pieces; ``own_weight`` gives the runs' weights."""

    window: int
    gram: int
    combine: np.ufunc

    def tokens(self, data: np.ndarray, ends: np.ndarray) -> Tokens:
        raise NotImplementedError

    def repeated_inside(self, first_doc: np.ndarray, last_doc: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Is an anchor with this first and last document and count repeated within the shard already?"""
        raise NotImplementedError

    def weights(self, ids: np.ndarray, runs: Runs, chosen: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def content(self, data: np.ndarray, t: Tokens, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A row of 64-bit numbers for each piece (its first token and number of tokens) that tells its content."""
        raise NotImplementedError

    def text(self, data: np.ndarray, t: Tokens, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' bytes end to end, and their sizes in bytes."""
        raise NotImplementedError

    def compare(self, text: np.ndarray, sizes: np.ndarray, length: np.ndarray, off: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For every window of the pieces of a range: does it count as repeated?"""
        raise NotImplementedError

    def also(self, own: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """Runs that count as repeated because of their own weight beside their piece's within the shard."""
        return np.zeros(len(own), bool)

    def result(self, data: np.ndarray, t: Tokens, doc: int, covered: np.ndarray) -> tuple:
        """A document's output values from its covered tokens."""
        raise NotImplementedError

    schema: str
    columns: list[str]
    types: list[pa.DataType]


def _array(cell: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(cell, kind)


def packed_shards(docs: DataFrame, kind: Kind, shard_bytes: int) -> DataFrame:
    """Rows of documents end to end, a line break after each, with ids, ends and runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            nonlocal made, size
            made += 1
            ends = np.cumsum([len(t) + 1 for t in texts]) - 1
            data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
            length, off = find_runs(kind.tokens(data, ends), kind.window, kind.gram)
            cells = [data.tobytes(), np.array(ids, np.int64).tobytes(), ends.astype(np.int64).tobytes(), length.tobytes(), off.tobytes()]
            ids.clear()
            texts.clear()
            size = 0
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + made]), *(pa.array([c], pa.binary()) for c in cells)],
                ["shard", "data", "ids", "ends", "run_length", "run_off"])

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                value = t.as_buffer().to_pybytes() if t.is_valid else b""
                if texts and size + len(value) > shard_bytes:
                    yield row()
                ids.append(NO_ID if i is None else i)
                texts.append(value)
                size += len(value) + 1
        if texts:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(run, "shard long, data binary, ids binary, ends binary, run_length binary, run_off binary")


def bucketed(shards: DataFrame, buckets: int) -> DataFrame:
    """The shards as a table bucketed by shard, so that joining answers to them moves the answers only."""
    spark = shards.sparkSession
    name = f"llm_shards_{uuid.uuid4().hex}"
    path = f"{shared_root(spark)}/{name}"
    (shards.write.bucketBy(buckets, "shard").option("path", path).option("compression", "zstd")
     .option("parquet.enable.dictionary", "false").option("parquet.block.size", str(32 << 20)).saveAsTable(name))
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.table(name)


def _range_of(g: np.ndarray, ranges: int) -> np.ndarray:
    return ((g >> U64(32)) * U64(ranges)) >> U64(32)


def _opened(b: pa.RecordBatch, kind: Kind) -> Iterator[tuple]:
    for i in range(b.num_rows):
        cell = lambda c: b.column(c)[i].as_buffer()  # noqa: B023, E731
        data, ids, ends = _array(cell("data"), np.uint8), _array(cell("ids"), np.int64), _array(cell("ends"), np.int64)
        t = kind.tokens(data, ends)
        runs = restored(t, kind.window, _array(cell("run_length"), np.uint8), _array(cell("run_off"), np.uint8))
        yield i, b.column("shard")[i].as_py(), data, ids, t, runs, mixed(t.grams[runs.anchor])


def _sent_anchors(kind: Kind, ranges: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, shard, _, _, _, runs, g in _opened(b, kind):
                order = np.argsort(g, kind="stable")
                ordered = g[order]
                head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(g) else np.zeros(0, np.int64)
                tail = np.append(head[1:], len(g))[: len(head)] - 1  # a shard of short texts has no runs
                inside = kind.repeated_inside(runs.doc[order[head]], runs.doc[order[tail]], tail - head + 1)
                distinct = ordered[head]
                cells = ((distinct & U64(0x7FFFFFFF)) << U64(1) | inside.astype(U64)).astype(np.uint32)
                yield _by_range(shard, _range_of(distinct, ranges), ranges, {"anchors": cells})

    return run


def _by_range(shard: int, of: np.ndarray, ranges: int, columns: dict[str, np.ndarray], more: dict | None = None) -> pa.RecordBatch:
    """A row for each range that has entries; ``of`` is ascending. ``more``: name -> cells by range and bounds."""
    bounds = np.searchsorted(of, np.arange(ranges + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(bounds))
    arrays = [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), shard))]
    names = ["range", "shard"]
    for name, values in columns.items():
        arrays.append(pa.array([values[bounds[r] : bounds[r + 1]].tobytes() for r in full], pa.binary()))
        names.append(name)
    for name, (values, ends) in (more or {}).items():
        cut = np.concatenate([[0], ends])[bounds]
        arrays.append(pa.array([values[cut[r] : cut[r + 1]].tobytes() for r in full], pa.binary()))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names)


def _answered_anchors(part: pd.DataFrame) -> pd.DataFrame:
    sent = [_array(c, np.uint32) for c in part["anchors"]]
    every = np.concatenate(sent)
    hashes = np.sort(every >> 1)
    again = np.unique(np.concatenate([hashes[1:][hashes[1:] == hashes[:-1]], (every[(every & 1) == 1]) >> 1]))
    return pd.DataFrame({
        "shard": part["shard"], "kind": np.int32(0), "range": part["range"],
        "bits": [np.packbits(_among(s >> 1, again)).tobytes() for s in sent]})


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _candidates(kind: Kind, ranges: int, data: np.ndarray, ids: np.ndarray, t: Tokens, runs: Runs, g: np.ndarray, answers: list) -> dict:
    """The runs whose anchor occurs again, as distinct pieces in the order in which they are sent and answered."""
    distinct = np.unique(g)
    of = _range_of(distinct, ranges)
    bounds = np.searchsorted(of, np.arange(ranges + 1, dtype=np.uint64))
    again = np.zeros(len(distinct), bool)
    for r, bits in answers:
        again[bounds[r] : bounds[r + 1]] = np.unpackbits(_array(bits, np.uint8), count=bounds[r + 1] - bounds[r])
    chosen = np.flatnonzero(_among(g, distinct[again]))
    start, length = runs.start[chosen], runs.length[chosen]
    content = kind.content(data, t, start, length + kind.window - 1)
    hashes = row_hash(content, length)
    of = _range_of(g[chosen], ranges)
    bits = U64(max(1, int(ranges).bit_length()))
    order = np.argsort((of << (U64(64) - bits)) | (hashes >> bits), kind="stable")
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        same[1:] = (hashes[a] == hashes[b]) & (length[a] == length[b]) & (of[a] == of[b])
        check = np.flatnonzero(same)
        same[check] = (content[order[check]] == content[order[check - 1]]).all(axis=1)
    head = np.flatnonzero(~same)
    piece = np.empty(len(order), np.int64)
    piece[order] = np.cumsum(~same) - 1
    first = order[head]
    weight = kind.combine.reduceat(kind.weights(ids, runs, chosen)[order], head) if len(head) else np.zeros(0, np.int64)
    return {"chosen": chosen, "piece": piece, "first": first, "start": start[first], "length": length[first],
            "off": (runs.anchor - runs.start)[chosen[first]], "weight": weight, "range": of[first]}


def _sent_pieces(kind: Kind, ranges: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, shard, data, ids, t, runs, g in _opened(b, kind):
                answers = [(a["range"], a["bits"]) for a in b.column("answers")[i].as_py() or []]
                c = _candidates(kind, ranges, data, ids, t, runs, g, answers)
                text, sizes = kind.text(data, t, c["start"], c["length"] + kind.window - 1)
                yield _by_range(
                    shard, c["range"], ranges,
                    {"length": c["length"].astype(np.uint8), "off": c["off"].astype(np.uint8), "weight": c["weight"].astype(np.int64),
                     "size": sizes.astype(np.uint32)},
                    {"text": (text, np.cumsum(sizes))})

    return run


def _answered_pieces(kind: Kind) -> Callable:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        joined = {c: np.concatenate([_array(x, k) for x in part[c]])
                  for c, k in (("length", np.uint8), ("off", np.uint8), ("weight", np.int64), ("size", np.uint32), ("text", np.uint8))}
        counts = [int(_array(x, np.uint8).sum(dtype=np.int64)) for x in part["length"]]
        answer = kind.compare(
            joined["text"], joined["size"].astype(np.int64), joined["length"].astype(np.int64), joined["off"].astype(np.int64), joined["weight"])
        ends = np.cumsum(counts)
        return pd.DataFrame({
            "shard": part["shard"], "kind": np.int32(1), "range": part["range"],
            "bits": [np.packbits(answer[e - n : e]).tobytes() for n, e in zip(counts, ends)]})

    return run


def _finished(kind: Kind, ranges: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, data, ids, t, runs, g in _opened(b, kind):
                answers = b.column("answers")[i].as_py() or []
                c = _candidates(kind, ranges, data, ids, t, runs, g, [(a["range"], a["bits"]) for a in answers if a["kind"] == 0])
                # windows by piece, in the order sent
                ends = np.cumsum(c["length"])
                bounds = np.searchsorted(c["range"], np.arange(ranges + 1, dtype=np.uint64))
                cut = np.concatenate([[0], ends])[bounds]
                marked = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
                for a in answers:
                    if a["kind"] == 1:
                        low, high = cut[a["range"]], cut[a["range"] + 1]
                        marked[low:high] = np.unpackbits(_array(a["bits"], np.uint8), count=high - low)
                length, start = runs.length[c["chosen"]], runs.start[c["chosen"]]
                piece_start = (ends - c["length"])[c["piece"]] if len(ends) else np.zeros(0, np.int64)
                copies = kind.also(kind.weights(ids, runs, c["chosen"]), c["weight"][c["piece"]])
                windows = spans_of(start, length)[marked[spans_of(piece_start, length)] | np.repeat(copies, length)]
                n = int(t.doc_end[-1]) if len(t.doc_end) else 0
                change = np.bincount(windows, minlength=n + 1)[: n + 1] - np.bincount(windows + kind.window, minlength=n + 1)[: n + 1]
                covered = np.cumsum(change)[:n] > 0
                rows = [kind.result(data, t, d, covered[s:e]) for d, (s, e) in enumerate(zip(t.doc_start, t.doc_end))]
                columns = [pa.array([None if x == NO_ID else x for x in ids.tolist()], pa.int64())]
                columns += [pa.array([r[k] for r in rows], kind_) for k, kind_ in enumerate(kind.types)]
                for low in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_arrays([x.slice(low, 500) for x in columns], ["doc_id", *kind.columns])

    return run


def repeated(docs: DataFrame, kind: Kind, shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``doc_id`` and the kind's output columns, a row per row of ``docs``."""
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(64, -(-total // range_bytes))
    shards = bucketed(packed_shards(docs, kind, shard_bytes), max(32, -(-total // BUCKET_BYTES)))
    answer = "shard long, kind int, range int, bits binary"

    def answered(*parts: DataFrame) -> DataFrame:
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        gathered = rows.groupBy("shard").agg(F.collect_list(F.struct("kind", "range", "bits")).alias("answers"))
        gathered = gathered.withColumnRenamed("shard", "of").hint("shuffle_hash")
        return shards.join(gathered, F.col("shard") == F.col("of"), "left").drop("of")

    anchors = shards.mapInArrow(_sent_anchors(kind, ranges), "range int, shard long, anchors binary")
    again = stored(anchors.groupBy("range").applyInPandas(_answered_anchors, answer), "anchors")
    pieces = answered(again).mapInArrow(
        _sent_pieces(kind, ranges), "range int, shard long, length binary, off binary, weight binary, size binary, text binary")
    marked = stored(pieces.groupBy("range").applyInPandas(_answered_pieces(kind), answer), "pieces")
    return answered(again, marked).mapInArrow(_finished(kind, ranges), f"doc_id long, {kind.schema}")
