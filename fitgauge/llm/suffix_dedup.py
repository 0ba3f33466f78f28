"""Suffix-array dedup: removes bytes that stand in a string of ``window`` bytes which also starts in an earlier document.

The hash ranges of ``windows`` are the shards. Each builds suffix arrays over its text by Larsson and Sadakane's refinement and
common prefixes by Kasai's rule; where an anchor is too large for one array its parts get arrays of their own, and their
windows are merged by binary search. A class of equal windows has a least document; windows of later ones go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fitgauge.llm.blocks import Pieces, distinct, values_by_window
from fitgauge.llm.suffixes import BLOCK
from fitgauge.llm.windows import Kind, RANGE_BYTES, Runs, SHARD_BYTES, Tokens, U64, repeated, spans_of

GRAM = 16


def _loads(data: np.ndarray, extra: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The eight bytes from each position on, and the data they look at, with zeros behind the end."""
    padded = np.concatenate([data, np.zeros(extra, np.uint8)])
    return np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,)), padded


def gram_hash(data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of the 16 bytes from each position on (from the positions ``at``)."""
    words, _ = _loads(data)
    low, high = (words[: len(data)], words[8 : len(data) + 8]) if at is None else (words[at], words[at + 8])
    x = low * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(32)
    x += high
    x *= U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def masked_rows(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` bytes from the starts on, zero beyond their sizes, as 64-bit columns."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, width), (1, 1))[start]
    rows[np.arange(width) >= size[:, None]] = 0
    return rows.view("<u8")


class Bytes(Kind):
    gram = GRAM
    combine = np.minimum
    schema = "n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    columns = ["n_bytes", "spans", "kept"]
    types = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]

    def __init__(self, window: int, block: int = BLOCK) -> None:
        self.window, self.block = window, block
        #: a run's text is at most so long; a multiple of eight
        self.width = -(-(2 * window - GRAM) // 8) * 8

    def tokens(self, data: np.ndarray, ends: np.ndarray) -> Tokens:
        return Tokens(np.concatenate([[0], ends[:-1] + 1]).astype(np.int64), ends, _Lazy(data), {})

    def repeated_inside(self, first_doc, last_doc, count):
        return first_doc != last_doc

    def weights(self, ids: np.ndarray, runs: Runs, chosen: np.ndarray) -> np.ndarray:
        return ids[runs.doc[chosen]]

    def content(self, data, t, start, size):
        return masked_rows(data, start, size, self.width)

    def text(self, data, t, start, size):
        return data[spans_of(start, size)], size

    def compare(self, text, sizes, length, off, weight):
        start = np.cumsum(sizes) - sizes
        found, first, place = distinct(Pieces(start, sizes, length, weight), masked_rows(text, start, sizes, self.width), self.combine)
        anchor = gram_hash(text, found.start + off[first])
        order = np.argsort(anchor, kind="stable")
        found, anchor = found.take(order), anchor[order]
        least = values_by_window(text, found, anchor, self.window, self.combine, _first_bytes, _rows_as_bytes, limit=self.block)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        window_start = (np.cumsum(found.length) - found.length)[back[place]]
        return least[spans_of(window_start, length)] < np.repeat(weight, length)

    def also(self, own, joined):
        return own > joined

    def result(self, data, t, doc, covered):
        low, high = int(t.doc_start[doc]), int(t.doc_end[doc])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
        spans = [{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])]
        return high - low, spans, data[low:high][~covered].tobytes()


class _Lazy:
    """Gram hashes that are computed for the positions asked for."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data

    def __len__(self) -> int:
        return len(self.data)

    def __getitem__(self, at) -> np.ndarray:
        if isinstance(at, slice):
            low, high, _ = at.indices(len(self.data))
            return gram_hash(self.data[low : high + GRAM])[: high - low]
        return gram_hash(self.data, at)


def _first_bytes(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    padded = np.concatenate([tokens, np.zeros(8, np.uint8)])
    words = np.ndarray((len(tokens),), ">u8", padded.data, strides=(1,)).astype(np.uint64)
    return tokens, words >> U64(16), 6


def _rows_as_bytes(rows: np.ndarray) -> np.ndarray:
    rows = np.ascontiguousarray(rows)
    return rows.view(f"V{rows.shape[1] * rows.itemsize}").ravel()


def suffix_dedup(docs: DataFrame, window: int = 50, shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES,
                 block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (maximal removed runs of bytes, start and end) and ``kept`` (the bytes that stay), a row
    per row of ``docs``.

    A byte goes if a string of ``window`` bytes (16 to 128) that covers it also starts in a row with a smaller ``doc_id``,
    judged on the input; strings stay within a document. A null text has no bytes; texts shorter than the window stay whole.
    A null ``doc_id`` comes after all ids. Rows with equal ids remove nothing from each other. Other columns are ignored; an
    empty table gives an empty result.
    """
    return repeated(docs, Bytes(window, block), shard_bytes, range_bytes)
