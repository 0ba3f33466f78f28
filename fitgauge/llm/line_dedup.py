"""Fuzzy line dedup in DataFrame operations: SimHash, pigeonhole blocks, edit similarity, connected groups.

Lines are reduced to their letters, or with ``whole`` to lower case and single spaces; equal ones are one line from there on. Lines whose 64-bit SimHash values differ in at most
``max_bits`` bits agree in all but ``max_bits`` of b blocks, so that they meet under one of the C(b, max_bits) choices of
agreeing blocks. Inside that join every pair is verified on all bits and on its lengths, then by its edit distance. In a
crowded bucket, members link to pivots first, and only pairs that are not under one pivot are compared: a tight cluster
gives as many links as it has members.

Few bits apart are few changed words of long lines only, so ``line_groups`` can find pairs without bits instead, by filters
that lose nothing (``shared_words``). Pairs of up to ``SHORT`` characters are found by their edits: k edits leave one of k + 1
segments of the longer line as it was. Longer pairs have to share ``SHARED`` of the distinct words of the line that has more;
such lines have one of their rarest words in common, and l of them among the l - 1 next ones too. Where the rarest is a ``HOT``
word, so are all others: of g + 1 words in g groups two are in one group, and such pairs of words are rare.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import combinations
from math import comb, log2

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fitgauge.llm.components import components
from fitgauge.llm.shared import packed, unpacked, shared_root, stored

BITS = 64
#: Spark's setting that drops the shuffle files of a query when it has ended.
DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Relative cost of a row that is shuffled and of a comparison in the join.
ROW_COST, COMPARE_COST = 1500.0, 30.0
#: Words that a count of 16 bits in a signed number holds.
LANE = (1 << 15) - 1
#: Characters from which on a pair's common ends are cut off before its edit distance is taken.
LONG = 1000
#: Characters up to which a pair's distance is taken at once; characters of a piece that is looked for, from one to the next, and how far from its place.
CUT, PIECE, STEP, SLACK = 48, 8, 24, 12
#: A bucket with more lines is crowded; rounds of pivots before its remaining lines are paired.
CROWDED, ROUNDS = 4000, 4

#: Characters of the longer line up to which pairs are found by segments.
SHORT = 24
#: Share of distinct words that longer pairs share: a fifth of the characters can be a third of the words.
SHARED = 2 / 3
#: Share below which a pair is not compared, though its masks let it through; those of ``MASKS`` 64-bit numbers err for long lines.
LEAST_SHARED, MASKS = 0.6, 8
#: Share of words and length by which two lines differ that seem far apart; rounds in which any two groups are compared once.
FAR_APART, TURNS = 0.25, 2
#: Words are counted in one of so many lines.
COUNTED = 8
#: Words are ordered by how often their slot of this many occurs; those in more lines than ``HOT`` are looked for in pairs.
SLOTS, HOT = 1 << 18, 512
#: Hot words of a line for each group that pairs are made in.
GROUPED = 8
#: Word rows are made, shuffled and dropped in passes: lines to a pass, until there are so many passes.
PASS_LINES, PASSES = 1 << 18, 8
#: Scripts without spaces: each character counts as a word. All are of characters from ``FAR`` on.
FAR = r"[\x{E00}-\x{10FFFF}]"
UNSPACED = r"([฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\x{20000}-\x{3FFFF}])"


def normalised(line: Column) -> Column:
    """Lower case, one space for whatever is no letter."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}]+", " "))


def whole_line(line: Column) -> Column:
    """Lower case, one space for white space: digits, symbols and marks count."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\s\p{Z}]+", " "))


#: What a line has of which its normal form leaves anything: asked of the line, as a filter on the form would make it twice.
LEAVES = {normalised: r"\p{L}", whole_line: r"[^\s\p{Z}]"}


def occurrences(docs: DataFrame, normal: Callable[[Column], Column] = normalised) -> DataFrame:
    """``row``, ``doc_id``, ``line_no`` (from 0), ``line``, ``norm``, its 128-bit key ``k1``, ``k2``: lines of which ``normal``
    leaves anything."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    lines = rows.select("row", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.where(F.col("line").rlike(LEAVES[normal])).withColumn("norm", normal(F.col("line")))
    return lines.withColumns({"k1": F.xxhash64("norm"), "k2": F.xxhash64(F.lit(1), "norm")})


def _bit(i: int) -> Column:
    return F.lit(1 << i if i < 63 else -(1 << 63))


def with_simhash(lines: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``len`` and ``fp``: the bits that over half of the words' XXH64 values have set.

    Words are counted bit by bit, four counts to a number, in parts of a line whose counts fit 16 bits; the parts are
    added up then. Lines are bucketed by their key, so that nothing is shuffled.
    """
    words = lines.select("k1", "k2", F.length("norm").alias("len"), F.posexplode(F.split("norm", " ")).alias("place", "word"))
    words = words.select("k1", "k2", "len", F.floor(F.col("place") / LANE).alias("part"), F.xxhash64("word").alias("h"))
    spread = F.lit(0x0001000100010001)
    sums = [F.sum(F.shiftright("h", i).bitwiseAND(spread)).alias(f"c{i}") for i in range(16)]
    parts = words.groupBy("k1", "k2", "len", "part").agg(F.count("*").alias("n"), *sums)
    counts = [F.shiftrightunsigned(f"c{i % 16}", i // 16 * 16).bitwiseAND(F.lit(0xFFFF)) for i in range(BITS)]
    whole = parts.groupBy("k1", "k2", "len").agg(F.sum("n").alias("n"), *(F.sum(c).alias(f"b{i}") for i, c in enumerate(counts)))
    fp = F.lit(0).cast("long")
    for i in range(BITS):
        fp = fp.bitwiseOR(F.when(2 * F.col(f"b{i}") > F.col("n"), _bit(i)).otherwise(F.lit(0).cast("long")))
    return whole.select("k1", "k2", "len", fp.alias("fp"))


def choices(lines: int, max_bits: int) -> list[int]:
    """Masks of the bits that two lines share under each choice, for the number of blocks with the least estimated cost."""
    found = []
    for agreeing in range(1, 5):
        blocks = max_bits + agreeing
        keys = comb(blocks, max_bits)
        shared = BITS * agreeing / blocks
        found.append((keys * ROW_COST + keys * lines / 2**shared * COMPARE_COST, blocks, agreeing))
    _, blocks, agreeing = min(found)
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [_signed(sum(c)) for c in combinations(parts, agreeing)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _shared(a: Column, b: Column, end: Callable) -> Column:
    """How many characters two texts share at one end (``left`` or ``right``), by halving."""

    def halved(range_: Column, _: Column) -> Column:
        mid = F.shiftright(range_["low"] + range_["high"] + 1, 1)
        same = end(a, mid) == end(b, mid)
        return F.struct(
            F.when(same, mid).otherwise(range_["low"]).alias("low"),
            F.when(same, range_["high"]).otherwise(F.greatest(mid - 1, range_["low"])).alias("high"))

    whole = F.struct(F.lit(0).alias("low"), F.least(F.length(a), F.length(b)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), whole, halved, lambda r: r["low"])


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _most_apart(a: Column, b: Column, most: Column) -> Column:
    """An upper bound of the edit distance, or any number over ``most``.

    Pieces of ``a`` are looked for in ``b`` near the place that the last piece found suggests. Both lines are cut there, and the
    distances between the cuts add up to no less than the whole distance.
    """

    def apart(i: Column, i_end: Column, j: Column, j_end: Column) -> Column:
        both = F.struct(F.substring(a, i + 1, i_end - i).alias("a"), F.substring(b, j + 1, j_end - j).alias("b"))
        far = lambda x: F.call_function("levenshtein", x["a"], x["b"], most)
        return _let(both, lambda x: F.when(x["a"] == x["b"], 0).otherwise(_let(far(x), lambda d: F.when(d < 0, most + 1).otherwise(d))))

    # long lines have longer pieces, that they repeat less often, and not more of them: each is looked up from the line's start
    step = F.greatest(F.lit(STEP), F.shiftright(F.length(a), 6))
    piece = F.greatest(F.lit(PIECE), F.least(F.shiftright(F.length(a), 8), F.lit(4 * PIECE)))

    def cut(s: Column, place: Column) -> Column:
        gap = place - s["i"]
        slack = F.lit(SLACK) + F.shiftright(gap, 1)
        low = s["j"] + F.greatest(gap - slack, F.lit(0))
        at = F.call_function("instr", F.substring(b, low + 1, 2 * slack + piece), F.substring(a, place + 1, piece))
        there = _let(at, lambda n: F.when(n > 0, F.struct((place + piece).alias("i"), (low + n - 1 + piece).alias("j"), (
            s["cost"] + apart(s["i"], place, s["j"], low + n - 1)).alias("cost"))).otherwise(s))
        same = F.substring(a, s["i"] + 1, gap + piece) == F.substring(b, s["j"] + 1, gap + piece)
        on = F.struct((place + piece).alias("i"), (s["j"] + gap + piece).alias("j"), s["cost"].alias("cost"))
        return F.when(s["cost"] > most, s).when(same, on).otherwise(there)

    zero = F.lit(0)
    start = F.struct(zero.alias("i"), zero.alias("j"), zero.alias("cost"))
    last = F.length(a) - piece
    places = F.when(last >= 0, F.sequence(zero, F.greatest(last, zero), step)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, cut, lambda s: F.when(s["cost"] > most, s["cost"]).otherwise(
        s["cost"] + apart(s["i"], F.length(a), s["j"], F.length(b))))


def _similar(pairs: DataFrame, similarity: float, shared: bool = False) -> DataFrame:
    """Pairs of which the edit similarity of ``a_norm`` and ``b_norm``, 1 - distance / longer length, is high enough.

    The distance takes the product of the lengths. Where an upper bound decides, it is not taken; else what long lines share at
    both ends, which doesn't change it, is cut off first. With ``shared``, pairs beyond the bound that share less than
    ``LEAST_SHARED`` of the distinct words of the line with more of them are not similar. Other pairs that seem ``far``,
    where there is such a column, are compared without the bound.
    """
    a, b = F.col("a_norm"), F.col("b_norm")
    longer = F.greatest(F.length(a), F.length(b))
    most = F.floor(longer * (1 - similarity) + 1e-9).cast("int")

    def distance(x: Column, y: Column, limit: Column = most) -> Column:
        return F.call_function("levenshtein", x, y, limit)  # -1 beyond the limit

    def narrow_first(x: Column, y: Column) -> Column:  # its work is in proportion to the limit
        near = F.when(longer > 4 * LONG, distance(x, y, F.shiftright(most, 2))).otherwise(-1)
        return F.when(near >= 0, 0).otherwise(distance(x, y))

    def without_start(n: Column) -> Column:
        rest = F.struct(F.substring(a, n + 1, F.length(a)).alias("a"), F.substring(b, n + 1, F.length(b)).alias("b"))
        return _let(rest, lambda r: _let(_shared(r["a"], r["b"], F.right), lambda m: _let(
            F.struct(F.left(r["a"], F.length(r["a"]) - m).alias("a"), F.left(r["b"], F.length(r["b"]) - m).alias("b")), lambda x: narrow_first(x["a"], x["b"]))))

    exact = F.when(longer <= LONG, distance(a, b)).otherwise(_let(_shared(a, b, F.left), without_start)) >= 0
    within = _let(most, lambda m: _most_apart(a, b, m) <= m)
    beyond, far = exact, F.lit(False)
    if shared:
        words = F.struct(_words(a).alias("a"), _words(b).alias("b"))
        apart = _let(words, lambda w: F.size(F.array_intersect(w["a"], w["b"])) < LEAST_SHARED * F.greatest(F.size(w["a"]), F.size(w["b"])))
        beyond = ~apart & exact
        if "far" in pairs.columns:
            far = (F.col("far") > FAR_APART) & ~apart
    found = F.when(longer <= CUT, distance(a, b) >= 0).when(far, exact).when(within, True).otherwise(beyond)
    return pairs.where(found).drop("a_norm", "b_norm")


def _members(prints: DataFrame, masks: list[int]) -> DataFrame:
    """A row for each line and choice: ``bucket``, the line's key, bits and length."""
    rows = prints.select("k1", "k2", "fp", "len", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    return rows.select(F.xxhash64("mask", F.col("mask").bitwiseAND(F.col("fp"))).alias("bucket"), "k1", "k2", "fp", "len")


def _near(a: str, b: str, max_bits: int, similarity: float) -> Column:
    """Do two members pass the bits and the lengths? Both sides are told apart by prefix."""
    longer, shorter = F.greatest(f"{a}len", f"{b}len"), F.least(f"{a}len", f"{b}len")
    bits = F.bit_count(F.col(f"{a}fp").bitwiseXOR(F.col(f"{b}fp"))) <= max_bits
    return bits & (longer - shorter <= F.floor(longer * (1 - similarity) + 1e-9))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def _verified(pairs: DataFrame, lines: DataFrame, similarity: float, shared: bool = False) -> DataFrame:
    """``pairs`` (a_k1, a_k2, b_k1, b_k2) that are similar in their texts. ``lines`` is bucketed by its key: only pairs move."""
    for side in ("a", "b"):
        text = lines.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("norm").alias(f"{side}_norm"))
        pairs = pairs.join(text, (F.col(f"{side}_k1") == F.col("t1")) & (F.col(f"{side}_k2") == F.col("t2"))).drop("t1", "t2")
    return _similar(pairs, similarity, shared)


def _order(prefix: str) -> Column:
    return F.struct(f"{prefix}k1", f"{prefix}k2")


KEYS = ["a_k1", "a_k2", "b_k1", "b_k2"]


def _pivoted(busy: DataFrame, near: Callable[[str, str], Column], lines: DataFrame, similarity: float, shared: bool = False) -> DataFrame:
    """Links that connect the members of crowded buckets exactly as all similar pairs in them do.

    Members that one pivot reaches are connected; every other pair is compared. Of two members under different pivots, one at
    least is outside the bucket's most common pivot, so only those meet the whole bucket.
    """
    same = (F.col("bucket") == F.col("of")) & (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2"))
    met_in = F.col("a_bucket") == F.col("b_bucket")
    open_, rounds = busy.select("bucket", "k1", "k2"), []
    for _ in range(ROUNDS):
        least = open_.groupBy("bucket").agg(F.min(F.struct("k1", "k2")).alias("least")).select(
            F.col("bucket").alias("of"), F.col("least.k1").alias("o1"), F.col("least.k2").alias("o2"))
        pivots = busy.join(least, same).drop("of", "o1", "o2")
        met = _prefixed(busy, "a_").join(_prefixed(pivots, "b_"), met_in & near("a_", "b_"))
        rounds.append(stored(_verified(met.select("a_bucket", *KEYS), lines, similarity, shared), "reached"))  # the pivot reaches itself
        gone = rounds[-1].select(F.col("a_bucket").alias("of"), F.col("a_k1").alias("o1"), F.col("a_k2").alias("o2"))
        open_ = stored(open_.join(gone, same, "left_anti"), "open")
        if open_.isEmpty():
            break
    reached = rounds[0]
    for more in rounds[1:]:
        reached = reached.unionByName(more)
    under = stored(reached.groupBy(F.col("a_bucket").alias("of"), F.col("a_k1").alias("o1"), F.col("a_k2").alias("o2")).agg(
        F.min(F.struct("b_k1", "b_k2")).alias("pivot")), "under")
    most = under.groupBy("of", "pivot").agg(F.count("*").alias("n")).groupBy("of").agg(F.max_by("pivot", F.struct("n", "pivot")).alias("usual"))
    marked = busy.join(under, same, "left").drop("of", "o1", "o2")
    other = marked.join(most, F.col("bucket") == F.col("of"), "left").where(~F.col("pivot").eqNullSafe(F.col("usual"))).drop("of", "usual")
    apart = ~F.coalesce(F.col("a_pivot") == F.col("b_pivot"), F.lit(False)) & (_order("a_") != _order("b_"))
    rest = _prefixed(other, "a_").join(_prefixed(marked, "b_"), met_in & apart & near("a_", "b_"))
    links = reached.where(_order("a_") != _order("b_")).select(*KEYS)
    return links.unionByName(_verified(rest.select(*KEYS).distinct(), lines, similarity, shared))


def line_links(lines: DataFrame, prints: DataFrame, max_bits: int, similarity: float, crowded: int = CROWDED) -> DataFrame:
    """Pairs of distinct lines (``a_k1``, ``a_k2``, ``b_k1``, ``b_k2``) that connect lines exactly as all similar pairs do."""
    members = _members(prints, choices(prints.count(), max_bits))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > crowded)
    full = stored(sizes.select(F.col("bucket").alias("full")), "crowded")
    calm = members.join(full, F.col("bucket") == F.col("full"), "left_anti")
    a, b = _prefixed(calm, "a_"), _prefixed(calm, "b_")
    found = a.join(b, (F.col("a_bucket") == F.col("b_bucket")) & (_order("a_") < _order("b_")) & _near("a_", "b_", max_bits, similarity))
    links = stored(_verified(found.select(*KEYS).distinct(), lines, similarity), "links")
    if full.isEmpty():
        return links
    busy = stored(members.join(full, F.col("bucket") == F.col("full"), "left_semi"), "busy")
    return links.unionByName(_pivoted(busy, lambda a, b: _near(a, b, max_bits, similarity), lines, similarity))


def _edits(length: Column, similarity: float) -> Column:
    return F.floor(length * (1 - similarity) + 1e-9).cast("int")


def short_links(lines: DataFrame, similarity: float) -> DataFrame:
    """All similar pairs (``KEYS``) of which the longer line has at most ``SHORT`` characters.

    Of k + 1 segments of the longer line there is one that no edit touches, with i edits at most before it if it is the i-th
    (from 0) and k - i behind it. The shorter line has it at a place that these numbers bound.
    """
    rows = lines.select("k1", "k2", "norm", F.length("norm").cast("int").alias("len")).where(F.col("len").between(2, SHORT))
    size, k = F.col("size"), F.col("k")
    start = F.floor(F.col("i") * size / (k + 1)).cast("int")
    width = F.floor((F.col("i") + 1) * size / (k + 1)).cast("int") - start
    whole = rows.withColumn("size", F.col("len")).withColumn("k", _edits(size, similarity)).where("k > 0")
    parts = whole.withColumn("i", F.explode(F.sequence(F.lit(0), k))).select(
        "k1", "k2", "norm", "size", "i", "k", F.substring("norm", start + 1, width).alias("part"))
    most = F.least(F.lit(SHORT), F.floor(F.col("len") / similarity + 1e-9).cast("int"))
    probes = rows.withColumn("size", F.explode(F.sequence(F.col("len"), F.greatest("len", most)))).withColumn("k", _edits(size, similarity))
    probes = probes.where((F.col("k") > 0) & (size - F.col("len") <= k)).withColumn("i", F.explode(F.sequence(F.lit(0), k)))
    low = F.greatest(-F.col("i"), F.col("i") - k - (size - F.col("len")), -start)
    high = F.least(F.col("i"), k - F.col("i") - (size - F.col("len")))
    probes = probes.withColumns({"low": low, "high": high}).where("low <= high").withColumn("shift", F.explode(F.sequence("low", "high")))
    probes = probes.select("k1", "k2", "norm", "size", "i", F.substring("norm", start + F.col("shift") + 1, width).alias("part"))
    a, b = _prefixed(probes, "a_"), _prefixed(parts, "b_")
    met = (F.col("a_size") == F.col("b_size")) & (F.col("a_i") == F.col("b_i")) & (F.col("a_part") == F.col("b_part"))
    near = F.call_function("levenshtein", F.col("a_norm"), F.col("b_norm"), F.col("b_k")) >= 0
    return a.join(b, met & (_order("a_") != _order("b_")) & near).select(*KEYS).distinct()


def _slot(word: Column) -> Column:
    return F.pmod(word, F.lit(SLOTS)).cast("int")


def _needed(n: Column) -> Column:
    """How many distinct words a line of ``n`` shares with any that is similar; one may always differ."""
    return F.greatest(F.least(F.ceil(n * SHARED - 1e-9), n - 1), F.lit(1)).cast("int")


def _words(text: Column) -> Column:
    """The XXH64 values of a line's distinct words."""
    spaced = F.when(text.rlike(FAR), F.regexp_replace(text, UNSPACED, " $1 ")).otherwise(text)
    words = F.array_remove(F.split(spaced, r"[^\p{L}\p{M}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def _ranked(words: Column, ranks: bytes) -> Column:
    """The words in order, rarest first: 8 bits of rank, then 56 of the hash."""
    rank = lambda w: F.ascii(F.substring(F.lit(ranks), _slot(w) + 1, F.lit(1)).cast("string")).cast("long")
    return F.sort_array(F.transform(words, lambda w: F.shiftleft(rank(w), 56).bitwiseOR(F.shiftrightunsigned(w, 8))))


def _rank(n: int) -> int:
    return min(127, int(5 * log2(n + 1)))


def _groups(n: Column) -> Column:
    """Groups of the hot words of a line of ``n``: a power of two, at most twice as many for up to twice the words."""
    return F.call_function("shiftleft", F.lit(1), F.length(F.bin(F.greatest(F.floor(n / GROUPED), F.lit(1)))) - 1)


def worded(lines: DataFrame, similarity: float, counted: int = COUNTED) -> DataFrame:
    """Lines that pairs beyond ``SHORT`` characters can have: ``k1``, ``k2``, ``size`` (characters and distinct words), ``m0`` and on (a bit for each word)
    and ``words``, the hashes of the rarest distinct words, as many as ``word_links`` looks at, rarest first. Any one order of the words serves; a rough count, of the words in one of
    ``counted`` lines, does."""
    least = int((SHORT + 1) * similarity - 1e-9)
    rows = lines.where(F.length("norm") >= least).select("k1", "k2", F.length("norm").cast("int").alias("len"), _words(F.col("norm")).alias("words"))
    some = rows.where(F.pmod("k2", F.lit(counted)) == 0)
    # the outer explode, as the other's own filter would make all words once more
    counts = some.select(F.explode_outer("words").alias("w")).groupBy(_slot(F.col("w")).alias("slot")).agg(F.count("w").alias("n"))
    ranks = bytearray(SLOTS)
    for slot, n in counts.where("n > 1").collect():
        ranks[slot] = _rank(n)
    masks = [_mask(j, MASKS // 2).alias(f"m{j}") for j in range(MASKS // 2)]
    n = F.size("words")
    # stored, as a filter on what is made here would make it once more
    first = F.slice(_ranked(F.col("words"), bytes(ranks)), F.lit(1), n - _needed(n) + _groups(F.shiftright(3 * n, 1)) + 1)
    found = rows.select("k1", "k2", _size(F.col("len"), n).alias("size"), *masks, first.alias("words"))
    return stored(found, "worded").where(F.size("words") > 0)


def _size(length: Column, words: Column) -> Column:
    return F.shiftleft(length.cast("long"), 32).bitwiseOR(words.cast("long"))


def _count(size: Column) -> Column:
    return size.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def _mask(part: int, parts: int = MASKS) -> Column:
    """64 of the bits: those of the words whose hash starts with ``part``."""

    def added(mask: Column, word: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(word, 55).bitwiseAND(F.lit(63)).cast("int"))
        return F.when(F.shiftrightunsigned(word, 61).bitwiseAND(F.lit(parts - 1)) == part, mask.bitwiseOR(bit)).otherwise(mask)

    return F.aggregate("words", F.lit(0).cast("long"), added)


def _sharing(a: str, b: str, similarity: float, masks: int = MASKS) -> Column:
    """Can two members share the words they need, and do their lengths allow the edits?"""

    def length(x: str) -> Column:
        return F.shiftright(f"{x}size", 32).cast("int")

    def words(x: str) -> Column:
        return _count(F.col(f"{x}size"))

    longer, shorter = F.greatest(length(a), length(b)), F.least(length(a), length(b))
    needed = _needed(F.greatest(words(a), words(b)))

    def enough(x: str, y: str) -> Column:  # both ways, so that both sides of a join have the same columns and are shuffled once
        lone = [F.bit_count(F.col(f"{x}m{j}").bitwiseAND(F.bitwise_not(F.col(f"{y}m{j}")))) for j in range(masks)]
        return words(x) - sum(lone[1:], lone[0]) >= needed

    return (longer > SHORT) & (longer - shorter <= _edits(longer, similarity)) & enough(a, b) & enough(b, a)


def _far(a: str, b: str) -> Column:
    """How unlike two members seem: by the bits of their words, and by their lengths."""
    unlike = [F.bit_count(F.col(f"{a}m{j}").bitwiseXOR(F.col(f"{b}m{j}"))) for j in range(MASKS)]
    long, short = (f(F.shiftright(f"{a}size", 32), F.shiftright(f"{b}size", 32)) for f in (F.greatest, F.least))
    return sum(unlike[1:], unlike[0]) / (_count(F.col(f"{a}size")) + _count(F.col(f"{b}size"))) + (long - short) / long


def _keyed(rows: DataFrame, hot: int, part: int = 0, parts: int = 1) -> DataFrame:
    """``bucket`` and what ``_sharing`` reads of each line of ``worded``, for each rare word that it looks at and each pair of hot
    ones (those from rank ``hot`` on) in one group; of ``parts`` of the first words, those of one.

    Lines that share t words have the first l of them among their n - t + l first, for every l up to t. Groups are as many as the line of the
    two with more words has, so a line has those of lines with up to half as many words more, too. Of two words one is needed only.
    """
    own = ["k1", "k2", "size", *(f"m{j}" for j in range(MASKS // 2))]
    n = _count(F.col("size"))
    each = rows.withColumn("n", n).withColumn("spare", F.col("n") - _needed(F.col("n")))
    firsts = each.select(*own, "n", "spare", "words", F.posexplode("words").alias("i", "w"))
    if parts > 1:
        firsts = firsts.where(F.pmod(F.shiftrightunsigned("w", 24), F.lit(parts)) == part)
    is_hot = F.shiftrightunsigned("w", 56) >= hot
    single = firsts.where((F.col("i") <= F.col("spare")) & (~is_hot | (F.col("n") <= 2)))
    more = firsts.where(is_hot).withColumns({"g": _groups(F.col("n")), "h": _groups(F.shiftright(3 * F.col("n"), 1))})
    more = more.select(*own, "spare", "g", "h", "i", "w", F.posexplode(F.slice("words", F.col("i") + 2, F.size("words"))).alias("j", "v"))
    beyond = F.col("i") + F.col("j") + 1 - F.col("spare")
    unlike = F.col("w").bitwiseXOR(F.col("v"))
    meet = lambda g: (beyond <= F.col(g)) & (unlike.bitwiseAND((F.col(g) - 1).cast("long")) == 0)
    double = more.where(meet("g") | meet("h"))
    return single.select(F.col("w").alias("bucket"), *own).unionByName(double.select(F.xxhash64("w", "v").alias("bucket"), *own))


def _sided(pairs: DataFrame) -> DataFrame:
    """Each of ``pairs`` (``KEYS``) once, the lesser key on side a."""
    a, b = F.struct(F.col("a_k1").alias("k1"), F.col("a_k2").alias("k2")), F.struct(F.col("b_k1").alias("k1"), F.col("b_k2").alias("k2"))
    sides = pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return sides.select(*(F.col(f"{side}.{k}").alias(f"{side}_{k}") for side in "ab" for k in ("k1", "k2"))).distinct()


def _connecting(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """Links that connect lines exactly as all similar ones of ``pairs`` (``KEYS``, each once, and ``far``, how unlike they seem) do.

    Every line is compared with the least it meets, of those that seem near if any does. Then, again and again, one pair of any
    two groups that this has made is compared, the one that seems nearest; at last all pairs that are not connected yet.
    """
    pairs = stored(pairs, "pairs")
    turned = pairs.select(*(F.col(f"{x}_{k}").alias(f"{y}_{k}") for x, y in ("ba", "ab") for k in ("k1", "k2")), "far")
    least = pairs.unionByName(turned).groupBy("a_k1", "a_k2").agg(F.min(F.struct(F.col("far") > FAR_APART, "b_k1", "b_k2")).alias("least"))
    sided = _sided(least.select("a_k1", "a_k2", "least.b_k1", "least.b_k2"))
    tried = stored(pairs.join(sided, KEYS, "left_semi"), "tried")
    links = stored(_verified(tried, lines, similarity, True).select(*KEYS), "links")
    merged = links.select(F.col("a_k1").alias("u"), F.col("b_k1").alias("v"))
    rest = pairs.withColumns({"u": F.col("a_k1"), "v": F.col("b_k1")})
    for turn in range(TURNS + 1):
        roots = stored(components(merged), "roots")
        rest = rest.join(tried.select(*KEYS), KEYS, "left_anti")
        for side in "uv":
            of = roots.select(F.col("node").alias("of"), F.col("root").alias("in"))
            rest = rest.join(of, F.col(side) == F.col("of"), "left").withColumn(side, F.coalesce("in", side)).drop("of", "in")
        rest = stored(rest.where("u <> v"), "rest")
        if turn == TURNS or rest.isEmpty():
            return links.unionByName(_verified(rest.select(*KEYS, "far"), lines, similarity, True).select(*KEYS))
        once = rest.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(F.struct("far", *KEYS)).alias("pair"))
        once = stored(once.select("u", "v", "pair.*"), "tried")
        more = stored(_verified(once, lines, similarity, True), "links")
        links, tried, merged = links.unionByName(more.select(*KEYS)), once, more.select("u", "v")


def _gone(*read: DataFrame) -> None:
    """Deletes the files of what ``stored`` gave and nothing reads any more."""
    for df in read:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(conf).delete(folder, True)


def word_links(lines: DataFrame, similarity: float, crowded: int = CROWDED) -> DataFrame:
    """Pairs (``KEYS``) that connect lines exactly as all similar pairs do of which the longer line has more than ``SHORT``
    characters and that share the words that the line with more of them needs.

    Sizes of buckets are estimated from one of ``sampled`` lines.
    """
    rows = worded(lines, similarity, counted := max(1, min(COUNTED, crowded // 256)))
    hot, sampled = _rank(min(HOT, crowded) // counted), max(1, min(64, crowded // 64))
    parts = max(1, min(PASSES, rows.count() // PASS_LINES))
    few = MASKS // 2
    sizes = _keyed(rows.where(F.pmod("k2", F.lit(sampled)) == 0), hot).groupBy("bucket").agg(F.count("*").alias("n"))
    full = stored(sizes.where(F.col("n") * sampled > crowded).select(F.col("bucket").alias("full")), "crowded")
    none = full.isEmpty()
    # lines that share a first key are one node anyway
    met_in = (F.col("a_bucket") == F.col("b_bucket")) & (F.col("a_k1") < F.col("b_k1"))
    by_part = []
    for part in range(parts):
        members = _keyed(rows, hot, part, parts).drop("k2")
        calm = members if none else members.join(full, F.col("bucket") == F.col("full"), "left_anti")
        a, b = _prefixed(calm, "a_"), _prefixed(calm, "b_")
        met = a.join(b, met_in & _sharing("a_", "b_", similarity, few)).select(F.col("a_k1").alias("a_of"), F.col("b_k1").alias("b_of"))
        by_part.append(stored(met.distinct(), "met"))
    found = stored(reduce(DataFrame.unionByName, by_part).distinct(), "met")
    _gone(*by_part)
    # the finer masks of lines that meet any
    some = found.select(F.col("a_of").alias("of")).union(found.select("b_of")).distinct()
    some = rows.select("k1", "k2").join(some, F.col("k1") == F.col("of")).select(F.col("k1").alias("o1"), F.col("k2").alias("o2"))
    some = lines.join(some, (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2")))
    some = some.select("k1", "k2", "norm", _words(F.col("norm")).alias("words"))
    masks = [_mask(j).alias(f"m{j}") for j in range(MASKS)]
    texts = stored(some.select("k1", "k2", "norm", _size(F.length("norm"), F.size("words")).alias("size"), *masks), "texts")
    for side in ("a_", "b_"):
        found = found.join(_prefixed(texts.drop("norm"), side), F.col(f"{side}of") == F.col(f"{side}k1"))
    found = found.where(_sharing("a_", "b_", similarity)).select(*KEYS, _far("a_", "b_").alias("far"))
    links = _connecting(found, texts.select("k1", "k2", "norm"), similarity)
    if not none:
        busy = stored(_keyed(rows, hot).join(full, F.col("bucket") == F.col("full"), "left_semi"), "busy")
        links = links.unionByName(_pivoted(busy, lambda a, b: _sharing(a, b, similarity, few), lines, similarity, True))
    links = stored(links, "links")
    _gone(rows)
    return links


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files, which else stay until the driver happens to collect its garbage."""
    before = spark.conf.get(DROPPED, None)
    spark.conf.set(DROPPED, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROPPED) if before is None else spark.conf.set(DROPPED, before)


def _by_key(lines: DataFrame) -> DataFrame:
    """The lines as a table bucketed by their key, in as many buckets as a shuffle has partitions: the aggregation that made
    them has dealt them out like that already, and later joins on the key move the other side only."""
    spark = lines.sparkSession
    name = f"llm_lines_{uuid.uuid4().hex}"
    path = f"{shared_root(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines.write.bucketBy(buckets, "k1", "k2").option("path", path).option("compression", "zstd").saveAsTable(name)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.table(name)


def line_groups(docs: DataFrame, max_bits: int = 3, similarity: float = 0.8, crowded: int = CROWDED, shared_words: bool = False,
                whole: bool = False) -> DataFrame:
    """A row for each line with a letter, or with ``whole`` for each that is not blank: ``row`` (the document's position),
    ``doc_id``, ``line_no`` (from 0),
    ``group_doc_id`` and ``group_line_no`` (the occurrence that its group keeps), ``kept``.

    Lines are normalised to their letters, with ``whole`` to lower case and single spaces only.
    Groups are connected by equal normalised lines and by pairs whose SimHash values differ in at most ``max_bits`` bits and
    whose edit similarity is at least ``similarity``; with ``shared_words``, by pairs of that similarity whatever their bits,
    if they have at most ``SHORT`` characters or share ``SHARED`` of their words. A group keeps its occurrence with the least ``doc_id`` (null last), then
    line, then position of the row, so that of repeated rows one keeps the line. Other lines have no row and always stay;
    null and empty texts have none. Other columns are ignored. An empty table gives an empty result.
    """
    every = occurrences(docs, whole_line if whole else normalised)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "line_no", "row").alias("place")
    lines = every.groupBy("k1", "k2").agg(F.first("norm").alias("norm"), F.min(place).alias("place"))
    with _shuffles_dropped(docs.sparkSession):
        lines = _by_key(lines)
        if shared_words:
            links = short_links(lines, similarity).unionByName(word_links(lines, similarity, crowded))
        else:
            links = line_links(lines, stored(with_simhash(lines), "line-prints"), max_bits, similarity, crowded)
        # a line's node is its first key; two lines that share one of 2 ** 64 keys would be one node
        roots = stored(components(links.select(F.col("a_k1").alias("u"), F.col("b_k1").alias("v"))), "roots")
    named = lines.select("k1", "k2", "place").join(roots, F.col("k1") == F.col("node"), "left")
    named = named.select("k1", "k2", "place", F.coalesce("root", "k1").alias("root"))
    first = named.groupBy(F.col("root").alias("r")).agg(F.min("place").alias("kept_place"))
    named = named.join(first, F.col("root") == F.col("r")).select(F.col("k1").alias("l1"), F.col("k2").alias("l2"), "kept_place")
    found = every.select("row", "doc_id", "line_no", "k1", "k2").join(named, (F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")))
    kept = (F.col("row") == F.col("kept_place.row")) & (F.col("line_no") == F.col("kept_place.line_no"))
    return found.select(
        "row", "doc_id", "line_no", F.col("kept_place.doc_id").alias("group_doc_id"), F.col("kept_place.line_no").alias("group_line_no"),
        kept.alias("kept"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the lines removed that ``line_groups`` doesn't keep; all columns and rows stay.

    Rows are told apart by their position, so ``docs`` has to be a table that gives rows in the same order when read again.
    """
    gone = line_groups(docs, **({"shared_words": True, "whole": True} | options)).where("not kept").groupBy(F.col("row").alias("_gone_row")).agg(F.collect_set("line_no").alias("_gone"))
    inner = packed(docs)
    own = inner.withColumn("_row", F.monotonically_increasing_id())
    joined = own.join(gone, F.col("_row") == F.col("_gone_row"), "left")
    lines = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    return unpacked(joined.withColumn("text", text).select(*inner.columns), docs.columns)
