"""Substring dedup by relative Lempel-Ziv parsing: removes words in windows whose words stand anywhere else.

The hash ranges of ``windows`` are reference blocks, indexed by suffix arrays over words. Every candidate run is factored
greedily against its block: from a cursor, the factor is the longest match with any other place; a factor of a window's length
or more is a duplicate span, and windows that cross a factor's boundary are checked there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fitgauge.llm.blocks import Pieces, distinct, values_by_window
from fitgauge.llm.suffix_dedup import _rows_as_bytes
from fitgauge.llm.suffixes import BLOCK
from fitgauge.llm.windows import Kind, RANGE_BYTES, SHARD_BYTES, Tokens, U64, mixed, repeated, spans_of

GRAM = 10


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end: runs without the six ASCII white space characters."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from eight bytes at a time."""
    import xxhash

    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    size = end - start
    h = mixed(size.astype(U64))
    short = np.flatnonzero(size <= 64)
    for done in range(0, 64, 8):
        short = short[size[short] > done]
        if not len(short):
            break
        left = np.minimum(size[short] - done, 8).astype(U64)
        h[short] = mixed(h[short] ^ (words[start[short] + done] & (~U64(0) >> (U64(64) - U64(8) * left))))
    for i in np.flatnonzero(size > 64):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return h


def sequence_hash(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each word on; what reaches beyond the last word has no meaning."""
    padded = np.concatenate([h, np.zeros(size, U64)])
    total = np.zeros(len(h), U64)
    factor = 1
    for i in range(size):
        factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
        total += padded[i : i + len(h)] * U64(factor)
    return mixed(total)


def greedy_factors(longest: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
    """Which windows lie in duplicate spans. ``longest`` is, for each window of the pieces end to end, the longest match of the
    text from its start with any other place; ``length`` the windows of each piece. All pieces are parsed in step."""
    start = np.cumsum(length) - length
    marked = np.zeros(int(length.sum()), np.int8)
    piece, cursor = np.arange(len(length)), np.zeros(len(length), np.int64)
    change = np.zeros(len(marked) + 1, np.int64)
    while len(piece):
        at = start[piece] + cursor
        factor = np.maximum(longest[at], 1)
        inside = np.clip(factor - window + 1, 0, length[piece] - cursor)  # windows within the factor
        np.add.at(change, at, inside > 0)
        np.add.at(change, at + inside, -(inside > 0).astype(np.int64))
        boundary = np.minimum(cursor + factor, length[piece])
        crossing = spans_of(at + inside, boundary - cursor - inside)  # windows from here that cross the boundary
        marked[crossing] |= (longest[crossing] >= window).astype(np.int8)
        cursor = cursor + factor
        open_ = cursor < length[piece]
        piece, cursor = piece[open_], cursor[open_]
    return (np.cumsum(change)[:-1] > 0) | (marked > 0)


class Words(Kind):
    gram = GRAM
    combine = np.add
    schema = "n_words long, spans array<struct<start: long, end: long>>, kept binary"
    columns = ["n_words", "spans", "kept"]
    types = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]

    def __init__(self, window: int, block: int = BLOCK) -> None:
        self.window, self.block = window, block
        self.width = 2 * window - GRAM

    def tokens(self, data: np.ndarray, ends: np.ndarray) -> Tokens:
        start, end = word_bounds(data)
        doc_end = np.searchsorted(start, ends)
        h = word_hashes(data, start, end)
        return Tokens(np.concatenate([[0], doc_end[:-1]]).astype(np.int64), doc_end, sequence_hash(h, GRAM), {"start": start, "end": end, "hash": h})

    def repeated_inside(self, first_doc, last_doc, count):
        return count > 1

    def weights(self, ids, runs, chosen):
        return np.ones(len(chosen), np.int64)

    def _rows(self, values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        padded = np.concatenate([values, np.zeros(self.width, values.dtype)])
        rows = np.lib.stride_tricks.as_strided(padded, (len(values) + 1, self.width), (padded.itemsize,) * 2)[start].astype(U64)
        rows[np.arange(self.width) >= size[:, None]] = 0
        return rows

    def content(self, data, t, start, size):
        return self._rows(t.state["hash"], start, size)

    def text(self, data, t, start, size):
        # a piece and the white space behind it
        low = t.state["start"][start] if len(start) else np.zeros(0, np.int64)
        high = t.state["end"][start + size - 1] + 1 if len(start) else low
        return data[spans_of(low, high - low)], high - low

    def compare(self, text, sizes, length, off, weight):
        low, high = word_bounds(text)
        ends = np.cumsum(sizes)
        token_end = np.searchsorted(low, ends)
        size = length + self.window - 1
        start = token_end - size
        raw = text.tobytes()
        known: dict[bytes, int] = {}
        tokens = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(low.tolist(), high.tolist())), np.int64, len(low))
        found, first, place = distinct(Pieces(start, size, length, weight), self._rows(tokens, start, size), self.combine)
        anchor = sequence_hash(mixed(tokens.astype(U64) + U64(1)), GRAM)[found.start + off[first]]
        order = np.argsort(anchor, kind="stable")
        found, anchor = found.take(order), anchor[order]
        times = values_by_window(
            tokens, found, anchor, self.window, self.combine, _first_words, lambda rows: _rows_as_bytes(rows.astype(">u4")), _factored(self.window), self.block)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        window_start = (np.cumsum(found.length) - found.length)[back[place]]
        return times[spans_of(window_start, length)] > 0

    def result(self, data, t, doc, covered):
        low, high = int(t.doc_start[doc]), int(t.doc_end[doc])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
        spans = [{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])]
        stay = np.flatnonzero(~covered) + low
        start = t.state["start"][stay]
        size = t.state["end"][stay] - start  # of this document's words alone: a shard has many documents
        # each kept word and one more byte, which becomes the space behind it
        out = data[spans_of(start, size + 1)]
        if len(stay):
            out[np.cumsum(size + 1) - 1] = 32
        return high - low, spans, out[:-1].tobytes()


def _first_words(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    dense = np.unique(tokens, return_inverse=True)[1].astype(np.uint16)
    ahead = np.concatenate([dense.astype(U64) + U64(1), np.zeros(2, U64)])
    return dense, (ahead[:-2] << U64(32)) | (ahead[1:-1] << U64(16)) | ahead[2:], 3


def _factored(window: int):
    """Marks a block's windows by parsing its pieces: a match reaches as far as consecutive windows stand elsewhere."""

    def visit(pieces: Pieces, times: np.ndarray) -> np.ndarray:
        n = len(times)
        again = times > 1
        ends = np.cumsum(pieces.length)
        # first window at or after each that stands nowhere else, or the piece's end
        stop = np.where(again, n, np.arange(n))
        stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], np.repeat(ends, pieces.length))
        run = stop - np.arange(n)
        return greedy_factors(np.where(again, run + window - 1, 0), pieces.length, window).astype(np.int64)

    return visit


def substring_dedup(docs: DataFrame, window: int = 35, shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES,
                    block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``n_words``, ``spans`` (maximal removed runs of words, start and end) and ``kept`` (the words that stay, joined by
    one space, UTF-8), a row per row of ``docs``.

    Words are runs without ASCII white space, unchanged. A word goes if a window of ``window`` words (10 to 130) that covers it
    also starts anywhere else, in the same document too, judged on the input; all occurrences go. A null text has no words;
    shorter texts stay whole. Repeated rows remove each other. Ids are only handed on. Other columns are ignored; an empty
    table gives an empty result.
    """
    return repeated(docs, Words(window, block), shard_bytes, range_bytes)
