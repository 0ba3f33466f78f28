"""Comparing the windows of a hash range: distinct pieces, blocks by anchor, suffix arrays, merging of divided anchors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from fitgauge.llm.suffixes import BLOCK, common_prefixes, suffix_array
from fitgauge.llm.windows import row_hash, spans_of


@dataclass
class Pieces:
    """Pieces of a range: where their tokens start and how many there are, windows (a piece's first tokens), weights."""

    start: np.ndarray
    size: np.ndarray
    length: np.ndarray
    weight: np.ndarray

    def take(self, at: np.ndarray | slice) -> Pieces:
        return Pieces(self.start[at], self.size[at], self.length[at], self.weight[at])


def distinct(pieces: Pieces, content: np.ndarray, combine: np.ufunc) -> tuple[Pieces, np.ndarray, np.ndarray]:
    """The distinct pieces with joined weights, where the first of each stands, and each piece's place among them."""
    hashes = row_hash(content, pieces.length)
    order = np.argsort(hashes, kind="stable")
    same = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    same[1:] = (hashes[a] == hashes[b]) & (pieces.length[a] == pieces.length[b])
    check = np.flatnonzero(same)
    same[check] = (content[order[check]] == content[order[check - 1]]).all(axis=1)
    head = np.flatnonzero(~same)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(~same) - 1
    found = pieces.take(order[head])
    found.weight = combine.reduceat(pieces.weight[order], head)
    return found, order[head], place


def blocks(anchor: np.ndarray, size: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Bounds of blocks of at most ``limit`` tokens that hold anchors whole; an anchor that is larger is a block alone.

    ``anchor`` is ascending.
    """
    if not len(anchor):
        return
    ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor))
    total = np.concatenate([[0], np.cumsum(size)])
    low = high = 0
    for end in ends.tolist():
        if total[end] - total[low] > limit and high > low:
            yield low, high
            low = high
        high = end
    yield low, high


def window_classes(tokens: np.ndarray, first: np.ndarray, depth: int, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows (positions ``at``) in suffix order, and a class number for each: equal for equal windows."""
    order = suffix_array(first, depth)
    number = np.cumsum(common_prefixes(tokens, order) < window)
    among = np.zeros(len(tokens), bool)
    among[at] = True
    chosen = among[order]
    return order[chosen], number[chosen]


def class_values(number: np.ndarray, weight: np.ndarray, combine: np.ufunc) -> np.ndarray:
    """By window in suffix order, the joined weight of its class."""
    head = np.concatenate([[True], number[1:] != number[:-1]])
    return combine.reduceat(weight, np.flatnonzero(head))[np.cumsum(head) - 1]


def merged_values(shards: list[tuple[np.ndarray, np.ndarray]], combine: np.ufunc) -> list[np.ndarray]:
    """Joins classes across shards. A shard has its distinct windows (rows of bytes) in ascending order and their values;
    returned are the values over all shards. Each shard's windows are found by binary search among those merged so far."""
    keys, values = shards[0]
    for own, weight in shards[1:]:
        place = np.searchsorted(keys, own)
        known = np.zeros(len(own), bool)
        inside = place < len(keys)
        known[inside] = keys[place[inside]] == own[inside]
        values = values.copy()
        values[place[known]] = combine(values[place[known]], weight[known])
        keys, values = np.insert(keys, place[~known], own[~known]), np.insert(values, place[~known], weight[~known])
    return [values[np.searchsorted(keys, own)] for own, _ in shards]


def values_by_window(
    tokens: np.ndarray, pieces: Pieces, anchor: np.ndarray, window: int, combine: np.ufunc,
    ready: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, int]], bytes_of: Callable[[np.ndarray], np.ndarray],
    visit: Callable | None = None, limit: int = BLOCK,
) -> np.ndarray:
    """The joined weight of each window's class, by window, pieces in order. ``anchor`` (a hash) is ascending.

    ``ready`` makes a block's tokens dense and gives their first sort key and its depth; ``bytes_of`` gives windows (rows of
    tokens) as byte strings that compare alike; ``visit`` sees each block's windows and classes.
    """
    out = np.empty(int(pieces.length.sum()), np.int64)
    window_end = np.cumsum(pieces.length)
    for low, high in blocks(anchor, pieces.size, limit):
        cut = [low]
        if pieces.size[low:high].sum() > limit:  # one anchor: divide its pieces
            taken = np.cumsum(pieces.size[low:high])
            while cut[-1] < high:
                base = taken[cut[-1] - low - 1] if cut[-1] > low else 0
                cut.append(max(cut[-1] + 1, low + int(np.searchsorted(taken, base + limit, "right"))))
        else:
            cut.append(high)
        made = []
        for a, b in zip(cut, cut[1:]):
            own = pieces.take(slice(a, b))
            dense, first, depth = ready(tokens[spans_of(own.start, own.size)])
            inner = np.cumsum(own.size) - own.size
            at = spans_of(inner, own.length)
            order, number = window_classes(dense, first, depth, at, window)
            weight = np.repeat(own.weight, own.length)
            back = np.empty(len(dense), np.int64)
            back[at] = np.arange(len(at))
            places = back[order]  # window in the block's order, by suffix order
            value = class_values(number, weight[places], combine)
            made.append((a, b, own, order, number, places, value))
        if len(made) > 1:
            shards = []
            for a, b, own, order, number, places, value in made:
                head = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
                local = np.repeat(own.start - (np.cumsum(own.size) - own.size), own.size)[order[head]] + order[head]
                keys = bytes_of(tokens[local[:, None] + np.arange(window)])
                rank = np.argsort(keys)
                shards.append((keys[rank], value[head][rank], head, rank))
            for i, joined in enumerate(merged_values([s[:2] for s in shards], combine)):
                a, b, own, order, number, places, value = made[i]
                by_class = np.empty(len(joined), np.int64)
                by_class[shards[i][3]] = joined
                made[i] = (a, b, own, order, number, places, by_class[np.cumsum(np.concatenate([[True], number[1:] != number[:-1]])) - 1])
        for a, b, own, order, number, places, value in made:
            base = window_end[a] - pieces.length[a]
            block = np.empty(len(places), np.int64)
            block[places] = value
            out[base : base + len(places)] = visit(own, block) if visit else block
    return out
