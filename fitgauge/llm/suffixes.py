"""Suffix arrays and common prefixes of small blocks of tokens, in numpy."""

from __future__ import annotations

import numpy as np

#: A block's positions and ranks have to fit 16 bits each.
BLOCK = 65_535


def suffix_array(first: np.ndarray, depth: int) -> np.ndarray:
    """The block's suffixes in order. ``first`` (48 bits each) orders them by their first ``depth`` tokens.

    Larsson and Sadakane: each round sorts only the groups that are still tied, by the ranks of what follows, which are
    known to the depth reached so far; taking two such ranks at a time triples the depth. Rank, two following ranks and
    position make up one 64-bit number, so that a round is one sort. Beyond the block's end comes rank 0.
    """
    n = len(first)
    last = np.uint64(n - 1)
    place = np.arange(n, dtype=np.uint64)
    packed = np.sort((first << np.uint64(16)) | (last - place))  # of tied suffixes the shorter comes first
    order = (last - (packed & np.uint64(0xFFFF))).astype(np.int64)
    head = np.ones(n + 1, bool)
    head[1:n] = (packed[1:] >> np.uint64(16)) != (packed[:-1] >> np.uint64(16))
    rank = np.zeros(n + 1, np.uint64)  # from 1; the last is what lies beyond the end
    rank[order] = np.maximum.accumulate(np.where(head[:n], place, np.uint64(0))) + np.uint64(1)
    while depth < n:
        tied = np.flatnonzero(~(head[:n] & head[1:]))
        if not len(tied):
            break
        at = order[tied]
        packed = np.sort(
            (rank[at] << np.uint64(48)) | (rank[np.minimum(at + depth, n)] << np.uint64(32))
            | (rank[np.minimum(at + 2 * depth, n)] << np.uint64(16)) | (last - at.astype(np.uint64)))
        at = (last - (packed & np.uint64(0xFFFF))).astype(np.int64)
        order[tied] = at
        prefix = packed >> np.uint64(16)
        head[tied[1:]] |= prefix[1:] != prefix[:-1]
        rank[at] = np.maximum.accumulate(np.where(head[tied], tied, 0)).astype(np.uint64) + np.uint64(1)
        depth *= 3
    return order


def common_prefixes(tokens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many tokens each suffix, in order, shares with the one before it.

    Kasai's observation in text order: where the tokens before a suffix and before its predecessor are equal, the length is
    one less than that of the suffix before. Only the other positions are compared, eight bytes at a time.
    """
    n, width = len(tokens), tokens.itemsize
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    own = np.ones(n, bool)
    inner = np.flatnonzero(before[1:] > 0) + 1
    own[inner] = tokens[inner - 1] != tokens[before[inner] - 1]
    raw = np.concatenate([tokens, np.zeros(8 // width + 1, tokens.dtype)]).view(np.uint8)
    words = np.ndarray((n * width + 1,), "<u8", raw.data, strides=(1,))
    length = np.zeros(n, np.int64)
    at = np.flatnonzero(own & (before >= 0))
    other, done = before[at], np.zeros(len(at), np.int64)
    while len(at):
        a, b = at * width + done, other * width + done
        ahead = (a < n * width) & (b < n * width)
        differ = words[np.minimum(a, n * width)] ^ words[np.minimum(b, n * width)]
        same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
        done = done + np.where(ahead, same, 0)
        more = ahead & (differ == 0)
        stop = ~more
        length[at[stop]] = np.minimum(done[stop] // width, n - np.maximum(at[stop], other[stop]))
        at, other, done = at[more], other[more], done[more]
    source = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    length = length[source] - (np.arange(n) - source)
    return length[order]
