"""Benchmark decontamination: BM25 retrieval of test items for every training passage, by block-max WAND.

The inverted index holds the test items. A posting's impact is its BM25 contribution divided by what the item scores against
itself, so that a threshold reads as a share of the item. Every passage of every document is a query: block maxima bound
what each block of items can score, and only passages with a block above the threshold run WAND, which skips blocks by their
maxima and scores the rest exactly. A retrieved item counts when the passage also overlaps with its question and its answer.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fitgauge.llm.shared import packed, unpacked

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
#: Items in a block of the index.
BLOCK = 4
#: Terms in more than this share of the items are not looked up one by one in the first bound.
COMMON = 0.03
#: Words of test items that one index holds; a larger benchmark is searched index by index.
INDEX_WORDS = 1_000_000


def terms(text: str | None) -> list[str]:
    """Lower-cased words without punctuation."""
    return WORD.findall(text.lower()) if text else []


def question_and_answer(text: str | None) -> tuple[str, str]:
    """Splits an item: its last sentence is the answer, what stands before it the question; a single sentence is both."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text or "") if WORD.search(p)]
    if len(parts) < 2:
        return text or "", text or ""
    return " ".join(parts[:-1]), parts[-1]


def shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    size = min(size, len(words))
    return set(zip(*(words[i:] for i in range(size)))) if size else set()


@dataclass
class Index:
    """Postings by term, ordered by item; impacts, list and block maxima."""

    items: np.ndarray
    vocabulary: dict[str, int]
    postings: list[tuple[np.ndarray, np.ndarray]]
    block_max: list[dict[int, float]]
    maximum: np.ndarray
    longest: int
    shingles: list[tuple[tuple[int, set], tuple[int, set]]]

    def __post_init__(self) -> None:
        blocks = -(-len(self.items) // BLOCK)
        common = np.array([len(p[0]) > COMMON * len(self.items) for p in self.postings])
        self.blocks = blocks
        #: what a block's best item can get from common terms
        per_item = np.zeros(len(self.items))
        for t in np.flatnonzero(common):
            np.add.at(per_item, self.postings[t][0], self.postings[t][1])
        self.common_max = np.array([per_item[b * BLOCK : (b + 1) * BLOCK].max() for b in range(blocks)])
        #: the other terms' block maxima, end to end
        self.rare = {w: t for w, t in self.vocabulary.items() if not common[t]}
        ends, of, value = [0], [], []
        for t in range(len(self.postings)):
            pairs = [] if common[t] else sorted(self.block_max[t].items())
            of.extend(b for b, _ in pairs)
            value.extend(v for _, v in pairs)
            ends.append(len(of))
        self.cell_start = np.array(ends, np.int64)
        self.cell_block, self.cell_value = np.array(of, np.int64), np.array(value)


def build(items: pd.DataFrame, frequencies: dict[str, int], n_items: int, mean_words: float, size: int) -> Index:
    """``items``: item_id, question, answer. Frequencies, count and mean length are those of the whole benchmark."""
    vocabulary: dict[str, int] = {}
    rows: list[list[tuple[int, float]]] = []
    kept, parts, longest = [], [], 1
    for item_id, question, answer in items.sort_values("item_id").itertuples(index=False):
        q, a = terms(question), terms(answer)
        words = q if question == answer else q + a
        if not words:
            continue
        longest = max(longest, len(words))
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        scores = {}
        for w, tf in counts.items():
            df = frequencies[w]
            idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
            scores[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words))
        whole = sum(scores.values())
        for w, s in scores.items():
            t = vocabulary.setdefault(w, len(vocabulary))
            if t == len(rows):
                rows.append([])
            rows[t].append((len(kept), s / whole))
        kept.append(item_id)
        parts.append(tuple((min(size, len(p)), shingles(p, size)) for p in (q, a)))
    postings = [(np.array([i for i, _ in r], np.int64), np.array([s for _, s in r])) for r in rows]
    block_max: list[dict[int, float]] = []
    for docs, impacts in postings:
        best: dict[int, float] = {}
        for d, s in zip((docs // BLOCK).tolist(), impacts.tolist()):
            best[d] = max(s, best.get(d, 0.0))
        block_max.append(best)
    maximum = np.array([p[1].max() for p in postings])
    return Index(np.array(kept), vocabulary, postings, block_max, maximum, longest, parts)


def search(index: Index, query: set[int], threshold: float) -> list[tuple[int, float]]:
    """All items that score at least ``threshold``, by block-max WAND: (position in the index, score)."""
    slack = threshold - 1e-9
    cursors = []  # (current item, term, place in the list)
    for t in query:
        docs = index.postings[t][0]
        heapq.heappush(cursors, (int(docs[0]), t, 0))
    found = []

    def advanced(t: int, place: int, to: int) -> None:
        docs = index.postings[t][0]
        place += int(np.searchsorted(docs[place:], to))
        if place < len(docs):
            heapq.heappush(cursors, (int(docs[place]), t, place))

    while cursors:
        # pivot: the first item at which the list maxima add up to the threshold
        taken, bound, pivot = [], 0.0, None
        while cursors and (pivot is None or cursors[0][0] == pivot):
            taken.append(heapq.heappop(cursors))
            bound += index.maximum[taken[-1][1]]
            if pivot is None and bound >= slack:
                pivot = taken[-1][0]
        if pivot is None:
            break
        block = pivot // BLOCK
        if sum(index.block_max[t].get(block, 0.0) for _, t, _ in taken) < slack:
            # none of the block's items up to the next list's item can reach it
            to = (block + 1) * BLOCK
            if cursors:
                to = min(to, cursors[0][0])
            for _, t, place in taken:
                advanced(t, place, max(to, pivot + 1))
        elif taken[0][0] == pivot:
            score = sum(index.postings[t][1][place] for _, t, place in taken)
            if score >= slack:
                found.append((pivot, float(score)))
            for _, t, place in taken:
                advanced(t, place, pivot + 1)
        else:
            for item, t, place in taken:
                if item < pivot:
                    advanced(t, place, pivot)
                else:
                    heapq.heappush(cursors, (item, t, place))
    return found


def candidates(index: Index, words: list[list[str]], threshold: float) -> list[tuple[int, int]]:
    """(text, passage) pairs of which a block's bound reaches the threshold.

    Passage p of a text is its words from ``p * longest`` on, twice ``longest`` of them, so that whatever is no longer than the
    longest item lies in a passage whole.
    """
    step, get = index.longest, index.rare.get
    lengths = np.array([len(w) for w in words], np.int64)
    slots = -(-lengths // step)
    first = np.concatenate([[0], np.cumsum(slots)])
    ids = np.fromiter((get(w, -1) for text in words for w in text), np.int64, int(lengths.sum()))
    hit = np.flatnonzero(ids >= 0)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    text = np.searchsorted(starts, hit, "right") - 1
    slot = first[text] + (hit - starts[text]) // step
    n_terms = len(index.postings)
    keys = np.unique(slot * n_terms + ids[hit])  # a term counts once in a slot
    slot, term = keys // n_terms, keys % n_terms
    size = index.cell_start[term + 1] - index.cell_start[term]
    cell = np.repeat(index.cell_start[term] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    found = []
    n_slots, share = int(first[-1]), max(1, 4_000_000 // max(index.blocks, 1))
    owner = np.repeat(slot, size)
    for low in range(0, n_slots, share):  # so many slots at a time
        high = min(n_slots, low + share + 1)
        inside = slice(*np.searchsorted(owner, (low, high)))
        flat = (owner[inside] - low) * index.blocks + index.cell_block[cell[inside]]
        bound = np.bincount(flat, index.cell_value[cell[inside]], (high - low) * index.blocks).reshape(-1, index.blocks)
        both = bound + index.common_max
        both[:-1] += bound[1:]
        reach = np.flatnonzero((both >= threshold - 1e-9).any(axis=1)) + low
        found.append(reach[reach < low + share])
    passages = np.concatenate(found) if found else np.zeros(0, np.int64)
    text = np.searchsorted(first, passages, "right") - 1
    # the sum may reach into the next text; WAND looks at the passage's own words only
    return list(zip(text.tolist(), (passages - first[text]).tolist()))


def contaminated(index: Index, words: list[list[str]], threshold: float, overlap: float) -> dict[int, dict[int, tuple]]:
    """By text: item -> (score, question overlap, answer overlap), the best passage's."""
    step, known = index.longest, index.vocabulary
    out: dict[int, dict[int, tuple]] = {}
    for text, p in candidates(index, words, threshold):
        passage = words[text][p * step : (p + 2) * step]
        query = {known[w] for w in passage if w in known}
        made: dict[int, set] = {}
        for item, score in search(index, query, threshold):
            shares = []
            for size, wanted in index.shingles[item]:
                if size not in made:
                    made[size] = shingles(passage, size) if size <= len(passage) else set()
                shares.append(len(wanted & made[size]) / len(wanted) if wanted else 1.0)
            if min(shares) >= overlap:
                best = out.setdefault(text, {})
                best[item] = max(best.get(item, (-1.0,)), (score, *shares))
    return out


def with_answers(benchmark: DataFrame) -> DataFrame:
    """``item_id``, ``question``, ``answer``; items without these columns are split by ``question_and_answer``."""
    if {"question", "answer"} <= set(benchmark.columns):
        return benchmark.select("item_id", F.col("question").cast("string"), F.col("answer").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [question_and_answer(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("item_id"), pa.array([q for q, _ in pairs], pa.string()), pa.array([a for _, a in pairs], pa.string())],
                ["item_id", "question", "answer"])

    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "item_id long, question string, answer string")


def _indexes(benchmark: DataFrame, size: int, index_words: int) -> Iterator[Index]:
    """One index after the other, of about ``index_words`` words each, with the benchmark's own frequencies."""
    items = with_answers(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, word, first = [], [], []
            for i, q, a in zip(*(b.column(c).to_pylist() for c in ("item_id", "question", "answer"))):
                own = terms(q) if q == a else terms(q) + terms(a)
                seen = set()
                for w in own:
                    ids.append(i)
                    word.append(w)
                    first.append(0 if w in seen else 1)
                    seen.add(w)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(word, pa.string()), pa.array(first, pa.int64())], ["item_id", "term", "first"])

    words = items.select(F.col("item_id").cast("long"), "question", "answer").mapInArrow(run, "item_id long, term string, first long")
    n_words = words.count()
    n_items = items.count()
    frequencies = words.groupBy("term").agg(F.sum("first").alias("df"))
    chunks = max(1, -(-n_words // index_words))
    chunk = F.pmod(F.xxhash64("item_id"), F.lit(chunks))
    for c in range(chunks):
        own = items.where(chunk == c)
        if chunks == 1:
            df = frequencies
        else:
            df = frequencies.join(words.where(chunk == c).select(F.col("term").alias("t")).distinct(), F.col("term") == F.col("t")).select("term", "df")
        # null ids as None: as floats, ids would be rounded
        rows = own.select(F.col("item_id").cast("long"), "question", "answer").toArrow().to_pandas(integer_object_nulls=True)
        if len(rows):
            index = build(rows, {r.term: r.df for r in df.collect()}, n_items, max(n_words / n_items, 1e-9), size)
            if len(index.items):  # items without words have no postings
                yield index


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, shingle_words: int = 5,
          index_words: int = INDEX_WORDS) -> DataFrame:
    """The test items that documents contain: ``doc_id``, ``text_key`` (XXH64 of the text), ``item_id``, ``score`` (BM25 as a
    share of the item's own), ``question_overlap``, ``answer_overlap``; a row for each contaminated row of ``docs`` and item.

    ``benchmark`` has ``item_id`` and either ``question`` and ``answer`` or ``text``. A passage has to score ``threshold`` and
    to contain the share ``overlap`` of the ``shingle_words``-word sequences of both question and answer (shorter ones: of the
    whole). Case and punctuation do not count. Null and empty texts, and items without words, match nothing; repeated rows
    repeat; items with equal texts are all reported; a null ``doc_id`` or ``item_id`` stays null. Empty tables give an empty result. An index
    holds at most about ``index_words`` words and goes to the executors with the tasks; a larger benchmark makes several.
    """
    schema = "doc_id long, text_key long, item_id long, score double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))
    found = None
    for index in _indexes(benchmark, shingle_words, index_words):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column("text")
                for low in range(0, len(texts), 1000):
                    part = texts.slice(low, 1000)
                    hits = contaminated(index, [terms(t) for t in part.to_pylist()], threshold, overlap)
                    out = [(low + text, index.items[item], *best) for text, items in hits.items() for item, best in items.items()]
                    if out:
                        place = pa.array([o[0] for o in out])
                        yield pa.RecordBatch.from_arrays(
                            [b.column("doc_id").take(place), b.column("text_key").take(place), pa.array([None if o[1] is None else int(o[1]) for o in out], pa.int64()),
                             *(pa.array([o[i] for o in out], pa.float64()) for i in range(2, 5))],
                            ["doc_id", "text_key", "item_id", "score", "question_overlap", "answer_overlap"])

        hits = rows.mapInArrow(run, schema)
        found = hits if found is None else found.unionByName(hits)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns, whatever their names.

    Rows with equal id and text, null ids too, stay or go together; null and empty texts stay. Without items all rows stay.
    """
    hit = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    own = packed(docs).withColumn("_own_key", F.xxhash64("text"))
    same = (F.col("_own_key") == F.col("_key")) & own["doc_id"].cast("long").eqNullSafe(F.col("_id"))
    return unpacked(own.join(hit, same, "left_anti").drop("_own_key"), docs.columns)
