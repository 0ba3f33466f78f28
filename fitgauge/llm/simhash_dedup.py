"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint's 64 bits are grouped into partitions, correlated bits together. Two fingerprints that differ in at most ``r``
bits differ in at most ``t[i]`` bits of some partition ``i`` whenever the thresholds add up to ``r - m + 1`` (a threshold of
-1 leaves a partition out). Dynamic programming deals that sum out where it costs the fewest estimated candidates. A
fingerprint probes, for a threshold ``t``, the partition's value with every choice of ``t`` bits masked; whoever meets in a
bucket is verified on all 64 bits, and the bucket hands on a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fitgauge.llm.components import components
from fitgauge.llm.shared import packed, stored, unpacked

BITS = 64
#: Relative cost of a probe (a row that is shuffled) and of a comparison inside a bucket.
PROBE_COST, COMPARE_COST = 3000.0, 2.0
#: A bucket with more fingerprints is divided by its remaining bits.
BUCKET_ROWS = 30_000


def simhash(text: bytes, shingle_words: int) -> int:
    """Fingerprint of a text: bit set where over half of the shingles' XXH64 values (seed 42) have it."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white space characters
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return hash_of(joined, 42)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    hashes = np.array([hash_of(joined[s:e], 42) for s, e in zip(starts, ends[shingle_words - 1 :])], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """``doc_id``, ``text_key`` (XXH64 of the text), ``fp`` (bigint), a row per document. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            fp = np.fromiter((simhash(t or b"", shingle_words) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fp)], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many distinct fingerprints there are, and in how many of them each pair of bits is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(fp), both + bits.T @ bits
        cells = np.append(both.astype(np.int64).ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    rows = prints.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1, np.int64)
    for cell, n in rows:
        cells[cell] = n
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near equal width; each grows by the bit with the strongest mean correlation to those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-9, None))
    strength = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    left, groups = list(range(BITS)), []
    for i in range(parts):
        width = len(left) // (parts - i)
        group = [max(left, key=lambda b: (strength[b][left].max(), -b))]
        left.remove(group[0])
        while len(group) < width:
            bit = max(left, key=lambda b: (strength[b][group].mean(), -b))
            group.append(bit)
            left.remove(bit)
        groups.append(sorted(group))
    return groups


def allocate(n: int, both: np.ndarray, groups: list[list[int]], max_bits: int) -> tuple[float, list[int]]:
    """Thresholds by partition that add up to ``max_bits - m + 1``, by dynamic programming on the estimated cost.

    The share of pairs at distance t in a partition follows from how often two fingerprints agree in each of its bits;
    masking t of its w bits makes C(w, t) probes, each of which meets those that agree in the other bits.
    """
    p = np.diag(both) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)

    def cost(group: list[int], t: int) -> float:
        if t < 0:
            return 0.0
        share = np.prod(agree[group])
        worst = np.sort(1 / agree[group])[::-1]  # masked bits no longer have to agree
        met = n * share * comb(len(group), t) * float(np.prod(worst[:t]) if t else 1)
        return comb(len(group), t) * PROBE_COST + met * COMPARE_COST

    best = {0: (0.0, [])}  # sum of (threshold + 1) so far
    for group in groups:
        grown: dict[int, tuple[float, list[int]]] = {}
        for used, (spent, chosen) in best.items():
            for t in range(-1, min(max_bits, len(group)) + 1):
                key, value = used + t + 1, (spent + cost(group, t), [*chosen, t])
                if key <= max_bits + 1 and (key not in grown or value < grown[key]):
                    grown[key] = value
        best = grown
    return best[max_bits + 1]


def plan(n: int, both: np.ndarray, max_bits: int) -> list[tuple[list[int], int]]:
    """The partitions to probe with their thresholds: the number of partitions with the least estimated cost."""
    found = []
    for parts in range(1, max_bits + 2):
        groups = group_bits(n, both, parts)
        found.append((*allocate(n, both, groups, max_bits), groups))
    _, thresholds, groups = min(found, key=lambda x: (x[0], len(x[2])))
    return [(g, t) for g, t in zip(groups, thresholds) if t >= 0]


def masks(parts: list[tuple[list[int], int]]) -> list[int]:
    """The bits that a bucket's members share, one mask for each partition and choice of masked bits."""
    return [sum(1 << b for b in group if b not in free) for group, t in parts for free in combinations(group, t)]


def forest(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """For each of the distinct fingerprints, the least one that it reaches by links inside the bucket.

    Each fingerprint is compared once with those not yet reached; a tight cluster is reached by its first member.
    """
    root, open_, bits = fps.copy(), np.arange(len(fps)), fps.view(np.uint64)  # signed values count the bits of their magnitude
    while len(open_):
        frontier, open_, tree = [open_[0]], open_[1:], [open_[0]]
        while frontier and len(open_):
            near = np.bitwise_count(bits[open_] ^ bits[frontier.pop()]) <= max_bits
            found = open_[near]
            open_ = open_[~near]
            frontier.extend(found)
            tree.extend(found)
        if len(tree) > 1:
            root[tree] = fps[tree].min()
    return root


def _probes(prints: DataFrame, shared: list[int]) -> DataFrame:
    """A row for each fingerprint and mask: the mask and the bits under it name the bucket."""
    return prints.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in shared))).alias("mask")).select(
        "mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _divided(crowded: DataFrame, max_bits: int) -> DataFrame:
    """Members of crowded buckets, in buckets that also share one of ``max_bits + 1`` pieces of the remaining bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, list[int]] = {}
        for b in batches:
            mask, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "fp"))
            for m in np.unique(mask):
                if m not in pieces:
                    free = [i for i in range(BITS) if not int(m) >> i & 1]
                    cut = np.array_split(np.array(free), max_bits + 1)
                    pieces[m] = [_signed((int(m) & (1 << 64) - 1) | sum(1 << int(i) for i in c)) for c in cut]
                own = fp[mask == m]
                for wider in pieces[m]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), wider)), pa.array(own & np.int64(wider)), pa.array(own)], ["mask", "value", "fp"])

    return crowded.select("mask", "fp").mapInArrow(run, "mask long, value long, fp long")


def links(prints: DataFrame, max_bits: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``u``, ``v``: edges that connect distinct fingerprints exactly as all pairs with ``max_bits`` or fewer bits between
    them do. ``prints`` has distinct ``fp``. At most one edge for each member of a bucket."""
    n, both = bit_statistics(prints)
    probes = _probes(prints, masks(plan(n, both, max_bits)))
    ready = []
    while True:
        sizes = probes.groupBy("mask", "value").agg(F.count("*").alias("members"))
        # each division leaves fewer bits open; with max_bits of them a bucket has 2 ** max_bits members at most
        crowded = stored(sizes.where((F.col("members") > bucket_rows) & (F.bit_count("mask") < BITS - max_bits)), "crowded").select(
            F.col("mask").alias("m"), F.col("value").alias("x"))
        if crowded.isEmpty():
            ready.append(probes)
            break
        same = (F.col("mask") == F.col("m")) & (F.col("value") == F.col("x"))
        ready.append(probes.join(crowded, same, "left_anti"))
        probes = stored(_divided(probes.join(crowded, same, "left_semi"), max_bits).distinct(), "probes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            rows = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "value", "fp")])
            rows = np.concatenate([*held, rows], axis=1)
            cuts = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
            last = cuts[-1] if len(cuts) else 0
            held = [rows[:, last:]]
            yield from found(rows[2, :last], cuts)
        if held:
            yield from found(held[0][2], np.array([], np.int64))

    def found(fp: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        bounds = [0, *cuts[cuts < len(fp)].tolist(), len(fp)]
        for start, end in zip(bounds, bounds[1:]):
            if end - start > 1:
                own = np.ascontiguousarray(fp[start:end])
                root = forest(own, max_bits)
                apart = root != own
                if apart.any():
                    u.append(own[apart])
                    v.append(root[apart])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    members = ready[0]
    for more in ready[1:]:
        members = members.unionByName(more)
    members = members.repartition("mask", "value").sortWithinPartitions("mask", "value")
    return members.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle_words: int = 4, max_bits: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links documents whose SimHash fingerprints differ in ``max_bits`` or fewer bits.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns a row per input row: ``doc_id``, ``text_key``
    (XXH64 of the text), ``fp``, ``component_id`` (least ``doc_id`` that is reached by links, itself included).
    A null or wordless text has fingerprint zero and links like any other. Repeated rows repeat. A null ``doc_id`` stays null
    and takes part; a component with no other id has a null ``component_id``. An empty table gives an empty result.
    Equal fingerprints are compared once, whatever the number of documents that have them.
    """
    rows = stored(fingerprints(docs, shingle_words), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = stored(components(links(prints.select("fp"), max_bits, bucket_rows)), "roots")
    named = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("component_fp"))
    ids = named.groupBy(F.col("component_fp").alias("c")).agg(F.min("least").alias("component_id"))
    classes = named.join(ids, F.col("component_fp") == F.col("c")).select(F.col("fp").alias("f"), "component_fp", "component_id")
    return rows.join(classes, F.col("fp") == F.col("f")).select("doc_id", "text_key", "fp", "component_fp", "component_id")


def representatives(docs: DataFrame, shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """One document of each group, all columns, whatever their names: that with the least ``doc_id``, of several the least text key.

    Rows without ``doc_id`` come after all others. Where several rows have both equal, one of them stays. Null and wordless texts
    are one group. An empty table gives an empty result.
    """
    rows = near_duplicates(docs, shingle_words, max_bits)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first")
    kept = rows.groupBy("component_fp").agg(first).select(
        F.col("first.doc_id").alias("_kept_id"), F.col("first.text_key").alias("_kept_key"))
    keyed = packed(docs).withColumns({"_own_id": F.col("doc_id").cast("long"), "_own_key": F.xxhash64("text")})
    same = F.col("_own_id").eqNullSafe(F.col("_kept_id")) & (F.col("_own_key") == F.col("_kept_key"))
    chosen = keyed.join(kept, same, "left_semi").dropDuplicates(["_own_id", "_own_key"])
    return unpacked(chosen.drop("_own_id", "_own_key"), docs.columns)
