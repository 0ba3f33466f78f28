"""The prefix trie of conversations: range-minimum queries over the common prefixes of sorted neighbours.

Conversations are sorted by their turns (as digests) and dealt into ranges, the blocks. Members of a node are neighbours
in that order. In a block, the number of turns that neighbours share goes into a sparse table of range minima; every
candidate prefix (a row and a depth at which it differs from the row before) binary-searches the left and right end of
its interval in it. All other figures of a node are differences of running sums over its interval. An interval that
touches the end of its block goes on in the next: the same search over the minima of whole blocks finds the block in which
it starts, and its parts are summed there. A block sends a few numbers to the driver, whatever its size.

A conversation needs sorting only up to the first turn that no other has at that place; behind it lies a chain of nodes
with itself as only member, which is written without a search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from fitgauge.llm.shared import stored

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
#: What a block says about its candidates. ``n`` members from row ``i`` on, of which the least id is ``conv``.
CANDIDATE = (
    "block int, i bigint, d bigint, n bigint, conv bigint, shared bigint, before bigint, leaves bigint, children bigint, total bigint, "
    "last boolean, p_first boolean, p_last boolean, p_conv bigint, ends string, ends_open boolean"
)
#: What it says about itself: its least inner common prefix, its first and last keys, and where the last run of equal keys starts.
BLOCK = "inner bigint, count bigint, run bigint, low array<binary>, sizes array<bigint>, high array<binary>"
#: Ids of members that end at a node, by pieces of so many.
PIECE = 512
#: Chain nodes written from one row.
CHAIN = 4096
#: Up to so many open nodes (three numbers each) are sent to every executor.
BROADCAST_NODES = 200_000
FAR = np.iinfo(np.int64).max
NOBODY = hashlib.sha256(b"").hexdigest()


def turn_key(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of a turn; the length keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the rows of each conversation in a sorted partition, across batches."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy()
        if not len(conv):
            continue
        starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        runs = np.diff(np.r_[starts, len(conv)])
        place = np.arange(len(conv)) - np.repeat(starts, runs)
        if conv[0] == last:
            place[: runs[0]] += n
        last, n = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(place, pa.int64()), pa.array(np.full(len(conv), part, np.int32))],
            names=["conv_id", "key", "size", "place", "part"])


def placed_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 0, by turn, null first), ``key``, ``size`` (UTF-8 bytes of the text), whatever other columns there are.

    Equal turn numbers of a conversation are ordered by the key. Rows without ``conv_id`` belong to no conversation and are left
    out. Rows are dealt by range, so that a conversation of any length is divided; counts of those parts give the rest.
    """
    text = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), turn_key(F.col("role"), F.col("text")).alias("key"), text.alias("size"), F.col("turn").cast("bigint").alias("turn"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "key", "size"]
    numbered = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "size")
    numbered = stored(numbered.mapInArrow(_number, "conv_id bigint, key binary, size bigint, place bigint, part int"), "turns")
    parts = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # at most one conversation goes on from a part to the next, so there are no more of these rows than parts
    later = parts.withColumn("before", before).where("before is not null").select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "before")
    found = numbered.join(F.broadcast(later), (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("p")), "left")
    return found.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "size")


def _opening(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % 9


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with a common opening: the first h turns of conversation ``c - c % 5`` (none where there is none), then the own
    turns behind the first h, where h is the CRC-32 of the decimal id modulo 9. ``c % 5`` has the sign of c.

    Returns the turns as ``placed_turns`` does, and ``conv_id``, ``n`` (turns, 0 too) of every conversation.
    """
    turns = stored(placed_turns(conversations), "placed")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    opening = lengths.select(F.col("conv_id").alias("base_id"), F.col("own").alias("base"))
    sizes = lengths.withColumn("h", _opening(F.col("conv_id"))).join(opening, F.expr("conv_id - conv_id % 5") == F.col("base_id"), "left")
    sizes = sizes.select("conv_id", "h", F.least("h", F.coalesce("base", F.lit(0))).alias("m"), F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("rest"))
    sizes = stored(sizes, "sizes")
    own = turns.where(F.col("pos") >= _opening(F.col("conv_id"))).join(sizes, "conv_id").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "key", "size")
    # every conversation whose base this one is; around 0 they lie on both sides
    near = F.expr("sequence(conv_id - if(conv_id <= 0, 4, 0), conv_id + if(conv_id >= 0, 4, 0))")
    lent = turns.where("pos < 8 and conv_id % 5 = 0").select(F.explode(near).alias("conv_id"), "pos", "key", "size")
    lent = lent.where(F.col("pos") < _opening(F.col("conv_id"))).join(sizes.select("conv_id"), "conv_id", "left_semi")
    return own.unionByName(lent), sizes.select("conv_id", (F.col("m") + F.col("rest")).alias("n"))


# --- range minima


class Minima:
    """A sparse table of range minima."""

    def __init__(self, values: np.ndarray):
        self.n, self.rows = len(values), [values]
        while 2 << (len(self.rows) - 1) <= self.n:
            half, last = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The minimum of ``values[low..high]``, ends included, for every pair."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.rows[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.rows[k][low[at]], self.rows[k][high[at] - (1 << int(k)) + 1])
        return out

    def right(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place up to which all values behind ``start`` reach ``bound``; binary search."""
        at = start.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            ends = at + (1 << k)
            go = ends < self.n
            go[go] = self.rows[k][at[go] + 1] >= bound[go]
            at = np.where(go, ends, at)
        return at

    def left(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The least place from which all values up to and at ``start`` reach ``bound``, less one: where the interval begins
        if a value tells how much a row shares with the row before."""
        at = start.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            ends = at - (1 << k)
            go = ends >= -1
            go[go] = self.rows[k][ends[go] + 1] >= bound[go]
            at = np.where(go, ends, at)
        return at


def _ramps(counts: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n, one behind the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def shared_turns(keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many leading turns each row has in common with the row before; 0 for the first."""
    both = np.minimum(lengths[1:], lengths[:-1])
    row, j = np.repeat(np.arange(len(both)), both), _ramps(both)
    differ = (keys[starts[1:][row] + j] != keys[starts[:-1][row] + j]).any(axis=1)
    first = both.copy()
    np.minimum.at(first, row[differ], j[differ])
    return np.r_[0, first].astype(np.int64)


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _candidates(block: int, conv: np.ndarray, total: np.ndarray, keys: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> tuple:
    """Columns of CANDIDATE for one block, the numbers of BLOCK, and the pieces of runs that touch an end."""
    n, starts = len(conv), np.cumsum(lengths) - lengths
    lcp = shared_turns(keys, starts, lengths)
    known = lcp.copy()
    known[0] = FAR  # what the first row shares with the block before is not known here
    minima, ids = Minima(known), Minima(conv)
    bytes_to = np.r_[0, np.cumsum(sizes)]  # a row's first k turns have bytes_to[start + k] - bytes_to[start]
    shared = np.cumsum(np.r_[0, (bytes_to[starts + lcp] - bytes_to[starts])[1:]])
    leaf = np.cumsum(np.r_[0, lcp[1:] < lengths[:-1]])
    fresh = np.where(np.arange(n) > 0, lengths > lcp, False)  # rows that bring a new node, as a child of depth lcp
    branch = np.sort(lcp[fresh] * np.int64(n) + np.flatnonzero(fresh))

    def children(low: np.ndarray, high: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.searchsorted(branch, d * n + high, "right") - np.searchsorted(branch, d * n + low, "right")

    least = np.r_[0, lcp[1:] + 1]  # the first row's depths may belong to a node of the block before
    counts = np.maximum(lengths - least + 1, 0)
    i, d = np.repeat(np.arange(n), counts), _ramps(counts) + np.repeat(least, counts)
    right, left = minima.right(i, d), np.where(i > 0, minima.left(i, d), 0)
    left = np.maximum(left, 0)
    assert (left == i).all()
    p_left, p_right = np.maximum(minima.left(i, d - 1), 0), minima.right(i, d - 1)
    at = starts[i] + np.maximum(d - 1, 0)
    # runs of equal keys
    run = np.flatnonzero(np.r_[True, (lcp[1:] != lengths[1:]) | (lengths[1:] != lengths[:-1])])
    run_end = np.r_[run[1:], n]
    ends, ends_open, pieces = np.full(len(i), NOBODY, object), np.zeros(len(i), bool), []
    node_of = np.cumsum(counts) - 1  # a run's first row ends in its deepest candidate, if it brings one
    for a, b in zip(run.tolist(), run_end.tolist()):
        if total[a] > lengths[a]:
            continue  # cut: the conversation ends further down
        if a == 0 or b == n:
            if counts[a]:
                ends_open[node_of[a]] = True
            for k in range(a, b, PIECE):
                pieces.append((a, int(lengths[a]), k, _joined(conv[k : min(k + PIECE, b)])))
        elif counts[a]:
            ends[node_of[a]] = hashlib.sha256(_joined(conv[a:b]).encode()).hexdigest()
    columns = {
        "block": np.full(len(i), block, np.int32), "i": i, "d": d, "n": right - i + 1, "conv": ids.least(i, right), "shared": shared[right] - shared[i],
        "before": bytes_to[at] - bytes_to[starts[i]], "leaves": leaf[right] - leaf[i], "children": children(i, right, d), "total": total[i],
        "last": right == n - 1, "p_first": p_left == 0, "p_last": p_right == n - 1, "p_conv": ids.least(p_left, p_right), "ends": ends, "ends_open": ends_open,
    }
    inner = int(lcp[1:].min()) if n > 1 else FAR
    return columns, inner, int(run[-1]), pieces


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block: a sorted partition of conv_id, total, keys, sizes."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    table = pa.Table.from_batches(table).combine_chunks()
    block = TaskContext.get().partitionId()
    lists = table["keys"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    keys = np.frombuffer(b"".join(lists.flatten().to_pylist()), np.uint64).reshape(-1, 2)
    size = table["sizes"].combine_chunks()
    size = size.chunk(0) if isinstance(size, pa.ChunkedArray) else size
    columns, inner, run, pieces = _candidates(
        block, table["conv_id"].to_numpy(), table["total"].to_numpy(), keys, size.flatten().to_numpy().astype(np.int64), lengths)
    n, m = len(columns["i"]), len(pieces)
    piece = {"block": [block] * m, "i": [p[0] for p in pieces], "d": [p[1] for p in pieces], "n": [p[2] for p in pieces], "ends": [p[3] for p in pieces]}
    about = {"block": [block], "inner": [inner], "count": [len(lengths)], "run": [run]}
    about |= {"low": [lists[0].as_py()], "sizes": [size[0].as_py()], "high": [lists[-1].as_py()]}
    schema = _schema()
    for kind, rows, count in (("candidate", columns, n), ("piece", piece, m), ("block", about, 1)):
        rows = {"kind": [kind] * count} | rows
        for at in range(0, count, 10_000):
            part = {k: v[at : at + 10_000] for k, v in rows.items()}
            size_of = min(10_000, count - at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[f.name], f.type) if f.name in part else pa.nulls(size_of, f.type) for f in schema], schema=schema)


def _schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<binary>": pa.list_(pa.binary()), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in f"kind string, {CANDIDATE}, {BLOCK}".split(", "))])


@dataclass(frozen=True)
class Blocks:
    """The blocks in order: a few numbers each. ``edge`` is what the first row shares with the row before it."""

    ids: np.ndarray
    edge: np.ndarray
    inner: np.ndarray
    edge_bytes: np.ndarray
    edge_leaf: np.ndarray
    run: np.ndarray

    def owner(self, at: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The block in which the interval of depth ``d`` starts that reaches back over the start of block ``at``."""
        return np.maximum(Minima(np.minimum(self.edge, self.inner)).left(at - 1, d), 0)


def _blocks(found: DataFrame) -> Blocks:
    """Joins neighbouring blocks by their first and last keys; only numbers come to the driver, some for each block."""
    rows = found.where("kind = 'block'").select("block", "inner", "run", "low", "sizes", F.lag("high").over(Window.orderBy("block")).alias("before"))
    same = F.zip_with("low", "before", lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, False)
    both = F.least(F.size("low"), F.size("before"))
    edge = F.when(F.col("before").isNull(), -1).when(first > 0, F.least(first - 1, both)).otherwise(both).cast("bigint")
    rows = rows.select("block", "inner", "run", edge.alias("edge"), "sizes", F.size("before").cast("bigint").alias("length"))
    add = F.aggregate(F.slice("sizes", 1, F.greatest("edge", F.lit(0)).cast("int")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    got = rows.select("block", "inner", "run", "edge", add.alias("bytes"), F.coalesce(F.col("edge") < F.col("length"), F.lit(False)).alias("leaf")).orderBy("block").collect()
    number = lambda name: np.array([r[name] for r in got], np.int64)
    return Blocks(number("block"), number("edge"), number("inner"), number("bytes"), number("leaf"), number("run"))


def _placer(blocks: Blocks):
    """Adds to candidates: whether they continue a node (``edge``), the block where that starts (``owner``), what the step from block to
    block adds, and the block of an open parent."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(blocks.ids, batch.column("block").to_numpy())
            i, d = batch.column("i").to_numpy(), batch.column("d").to_numpy()
            edge = blocks.edge[at]
            goes_on = (i == 0) & (d <= edge)
            owner = np.where(goes_on, blocks.owner(at, d), at)
            p_before = batch.column("p_first").to_numpy(zero_copy_only=False) & (d - 1 <= edge)
            p_open = p_before | batch.column("p_last").to_numpy(zero_copy_only=False)
            p_owner = np.where(p_before, blocks.owner(at, d - 1), at)
            child = goes_on & (edge == d) & (batch.column("total").to_numpy() > d)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(goes_on), pa.array(blocks.ids[owner]), pa.array(np.where(p_open & (d > 0), blocks.ids[p_owner], -1)),
                 pa.array(np.where(goes_on, blocks.edge_bytes[at], 0)), pa.array(np.where(goes_on, blocks.edge_leaf[at], 0)), pa.array(child.astype(np.int64))],
                names=[*batch.schema.names, "edge", "owner", "p_owner", "edge_bytes", "edge_leaf", "edge_child"])

    return place


def _ends(pieces: DataFrame, blocks: Blocks) -> DataFrame:
    """``e_block``, ``e_i``, ``sha``: hash of the joined ids of runs that touch the end of a block. The pieces of a run arrive in order and
    are hashed one after the other, so that memory holds one batch of them."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(blocks.ids, batch.column("block").to_numpy())
            i, d = batch.column("i").to_numpy(), batch.column("d").to_numpy()
            goes_on = (i == 0) & (d <= blocks.edge[at])
            owner = np.where(goes_on, blocks.owner(at, d), at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks.ids[owner]), pa.array(np.where(goes_on, blocks.run[owner], i)), batch.column("block"), batch.column("n"), batch.column("ends")],
                names=["e_block", "e_i", "block", "n", "ends"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        done: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            for column, value in zip(done, (*key, state.hexdigest())):
                column.append(value)

        for batch in batches:
            for block, i, ends in zip(batch.column("e_block").to_pylist(), batch.column("e_i").to_pylist(), batch.column("ends").to_pylist()):
                if (block, i) != key:
                    if key is not None:
                        close()
                    key, state = (block, i), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ends.encode())
        if key is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())], names=["e_block", "e_i", "sha"])

    rows = pieces.select("block", "i", "d", "n", "ends").mapInArrow(place, "e_block bigint, e_i bigint, block int, n bigint, ends string")
    rows = rows.repartition("e_block", "e_i").sortWithinPartitions("e_block", "e_i", "block", "n")
    return rows.mapInArrow(joined, "e_block bigint, e_i bigint, sha string")


def _chains(cut: DataFrame) -> DataFrame:
    """The nodes below the first turn that a conversation has alone: ``conv_id``, ``length`` (turns up to it), ``total``."""
    parts = cut.where("total > length").select(
        "conv_id", "total", F.explode(F.expr(f"sequence(length + 1, total, {CHAIN}L)")).alias("start"))
    depths = parts.select("conv_id", "total", F.explode(F.expr(f"sequence(start, least(start + {CHAIN - 1}L, total))")).alias("depth"))
    ends = F.col("depth") == F.col("total")
    one = F.lit(1).cast("bigint")
    return depths.select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(ends, 0).otherwise(1).cast("bigint").alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"), F.when(ends, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOBODY).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for every distinct sequence of a conversation's first turns, the empty one (the root) included; columns as in ``NODE``.

    ``turns``: ``conv_id``, ``pos`` (gapless from 0), ``key`` (16 bytes that tell turns apart), ``size``; ``lengths``: ``conv_id``, ``n`` of every
    conversation, those without turns too. ``conv_id`` is a node's least member, ``parent_conv_id`` null at the root; ``saved_tokens`` sums
    (members - 1) x ``size`` over the subtree; ``ends_sha256`` hashes the ids of the conversations that end at the node. Without
    conversations there are no members and so no rows. No figure is capped. A row of the sort has 16 bytes for each turn up to the first one that
    the conversation has alone; the ids that end at one node are hashed in order by one task, as SHA-256 asks.
    """
    turns, lengths = stored(turns.select("conv_id", "pos", "key", "size"), "rebuilt"), stored(lengths, "lengths")
    # a turn that occurs once at its place: from there on its conversation is alone
    lone = turns.groupBy("pos", "key").agg(F.count("*").alias("k"), F.min("conv_id").alias("conv_id")).where("k = 1")
    alone = lone.groupBy("conv_id").agg((F.min("pos") + 1).alias("cut"))
    named = alone.select(F.col("conv_id").alias("c"), "cut")
    kept = turns.join(named, F.col("conv_id") == F.col("c"), "left").where("cut is null or pos < cut")
    rows = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "size"))).alias("turns"))
    rows = lengths.join(rows, "conv_id", "left").select("conv_id", F.col("n").alias("total"), F.coalesce("turns", F.array()).alias("turns"))
    rows = rows.select("conv_id", "total", F.col("turns.key").alias("keys"), F.col("turns.size").alias("sizes"))
    dealt = rows.repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    found = stored(dealt.mapInArrow(_search, f"kind string, {CANDIDATE}, {BLOCK}"), "found")
    blocks = _blocks(found)
    fields = [f.split(" ")[0] for f in CANDIDATE.split(", ")]
    placed = f"{CANDIDATE}, edge boolean, owner bigint, p_owner bigint, edge_bytes bigint, edge_leaf bigint, edge_child bigint"
    nodes = found.where("kind = 'candidate'").select(*fields).mapInArrow(_placer(blocks), placed)
    more = nodes.where("edge").groupBy(F.col("owner").alias("o"), F.col("d").alias("o_d")).agg(
        F.sum("n").alias("o_n"), F.min("conv").alias("o_conv"), F.sum(F.col("shared") + F.col("edge_bytes")).alias("o_shared"),
        F.sum(F.col("leaves") + F.col("edge_leaf")).alias("o_leaves"), F.sum(F.col("children") + F.col("edge_child")).alias("o_children"))
    own = nodes.where("not edge").withColumn("children", F.col("children") + (F.col("total") > F.col("d")).cast("bigint"))
    keep = ["block", "i", "d", "n", "conv", "shared", "before", "leaves", "children", "p_conv", "p_owner", "ends", "ends_open"]
    # an open node holds the last row of its block, so there is one for a block and a depth
    opened = own.where("last").join(more, (F.col("block") == F.col("o")) & (F.col("d") == F.col("o_d")), "left").withColumns({
        "conv": F.least("conv", "o_conv"), **{c: F.col(c) + F.coalesce(f"o_{c}", F.lit(0)) for c in ("n", "shared", "leaves", "children")}})
    opened = stored(opened.select(*keep), "open")
    parents = opened.select(F.col("block").alias("q"), (F.col("d") + 1).alias("q_d"), F.col("conv").alias("q_conv"))
    if opened.count() <= BROADCAST_NODES:
        parents = F.broadcast(parents)
    every = own.where("not last").select(*keep).unionByName(opened)
    every = every.join(parents, (F.col("p_owner") == F.col("q")) & (F.col("d") == F.col("q_d")), "left")
    ends = _ends(found.where("kind = 'piece'"), blocks)
    same = (F.col("ends_open") & (F.col("block") == F.col("e_block"))) & (F.col("i") == F.col("e_i"))
    every = every.join(ends, same, "left")
    parent = F.when(F.col("d") > 0, F.when(F.col("p_owner") >= 0, F.col("q_conv")).otherwise(F.col("p_conv")))
    shown = every.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        (F.col("leaves") + 1).alias("n_leaves"), (F.col("shared") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"),
        F.coalesce("sha", "ends").alias("ends_sha256"))
    cut = lengths.join(alone, "conv_id").select("conv_id", F.col("cut").alias("length"), F.col("n").alias("total"))
    return shown.unionByName(_chains(cut))
