"""Quality rules: counted base rules, then robust multivariate outliers by language and source.

Each group's centre and scatter are minimum-covariance-determinant estimates: concentration steps refit mean and covariance
on the share of rows with the least Mahalanobis distance, until the determinant no longer falls, from two starts. All rows
take part in every step; a step is one aggregation of the stored statistic vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from fitgauge.llm.shared import packed, stored, unpacked

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = b"#*$%&|<>"
#: Least spread of each transformed statistic (in its own unit), added to the scatter: a statistic that is constant in most
#: rows must not make every other value an outlier. About the step of one symbol, window or line in a text of some hundred
#: words, or half of it; words and their lengths have finer steps.
FLOORS = (0.1, 0.04, 0.3, 0.1, 0.35)
NAMES = ("log_words", "log_word_length", "symbols", "repeats", "dup_lines")
P = len(NAMES)
#: Share of a group's rows that an estimate is fitted on, and rows that a group needs for an estimate of its own.
SHARE, GROUP_ROWS = 0.75, 200
#: Chance that a row of a normal group is rejected.
TAIL = 1e-4
#: Chance that a normal row takes part in the estimates' last refit.
REWEIGHTED = 0.975
#: Distances are compared in bins of 1/64 of a doubling.
BINS = 64
MAX_STEPS = 12
#: A descent ends when no group's log determinant falls by more.
SETTLED = 1e-3
#: With at most so many groups their estimates (30 numbers each) are sent to every executor.
BROADCAST_GROUPS = 10_000


def text_counts(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()  # at the six ASCII white space characters
    n = len(words)
    points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    word_chars = points - (len(text) - sum(map(len, words)))
    symbols = sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that stand twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    seen = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, n)
    if len(ids) < 1 << 21:
        keys = (seen[:-2] << np.uint64(42)) | (seen[1:-1] << np.uint64(21)) | seen[2:]
    else:
        pairs = np.unique(seen[:-1] * np.uint64(len(ids)) + seen[1:], return_inverse=True)[1].astype(np.uint64)
        keys = pairs[:-1] * np.uint64(len(ids)) + seen[2:]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    starts = twice[place] == keys
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= starts
    return int(covered.sum())


def statistics(docs: DataFrame) -> DataFrame:
    """A row per document: ``doc_id``, ``text_key``, ``lang``, ``source`` and the five counts of its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            counts = np.array([text_counts(t or b"") for t in texts], np.int64).reshape(-1, len(COUNTS))
            kept = [b.column(c) for c in ("doc_id", "text_key", "lang", "source")]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(counts[:, i]) for i in range(len(COUNTS)))], ["doc_id", "text_key", "lang", "source", *COUNTS])

    rows = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("lang").cast("string"),
        F.col("source").cast("string"), F.col("text").cast("string"))
    schema = "doc_id long, text_key long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed() -> dict[str, Column]:
    words = F.col("n_words").cast("double")
    return {
        "log_words": F.log(words),
        "log_word_length": F.log(F.col("word_chars") / words),
        "symbols": F.asinh(100 * F.col("n_symbols") / words),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
        "dup_lines": F.log1p(F.col("n_dup_lines").cast("double")),
    }


def chi_square(x: float, freedom: int) -> float:
    """Cumulative chi-square probability, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, x = freedom / 2, x / 2
    if x > a + 40 + 10 * math.sqrt(a):
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def upper_tail(x: float, freedom: int) -> float:
    """1 - chi_square for an odd number of degrees, exact far out in the tail."""
    total, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(3, freedom + 1, 2):
        total += term
        term *= x / k
    return total


def _solved(f, target: float, low: float = 0.0, high: float = 1e4) -> float:
    """Where the falling function reaches the target."""
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > target else (low, mid)
    return (low + high) / 2


def limit(tail: float = TAIL) -> float:
    return _solved(lambda x: upper_tail(x, P), tail)


def consistency(share: float = SHARE) -> float:
    """What the covariance of the nearest ``share`` of normal rows has to be multiplied with."""
    cut = _solved(lambda x: 1 - chi_square(x, P), 1 - share)
    return share / chi_square(cut, P + 2)


def grouped(rows: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds ``grp``: language and source; small groups of a language together; small languages together."""
    pair = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    lang = F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})
    rows = rows.withColumns({"_pair": pair, "_lang": lang})
    pairs = rows.where("not base_failed").groupBy("_pair", "_lang").agg(F.count("*").alias("n"))
    own = pairs.where(F.col("n") >= group_rows).select(F.col("_pair").alias("p"), F.lit(True).alias("own"))
    rest = pairs.where(F.col("n") < group_rows).groupBy("_lang").agg(F.sum("n").alias("n"))
    pooled = rest.where(F.col("n") >= group_rows).select(F.col("_lang").alias("l"), F.lit(True).alias("pooled"))
    rows = rows.join(own, F.col("_pair") == F.col("p"), "left").join(pooled, F.col("_lang") == F.col("l"), "left")
    grp = F.when(F.col("own"), F.col("_pair")).when(F.col("pooled"), F.col("_lang")).otherwise(F.lit("*"))
    return rows.withColumn("grp", grp).drop("_pair", "_lang", "p", "l", "own", "pooled")


def _distance(centre: str = "centre", precision: str = "precision") -> Column:
    away = [F.col(c) - F.col(centre)[i] for i, c in enumerate(NAMES)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + (1.0 if i == j else 2.0) * F.col(precision)[i * P + j] * away[i] * away[j]
    return F.greatest(total, F.lit(0.0))


def _estimates(sums: DataFrame, share: float = SHARE) -> DataFrame:
    """Centre, inverse scatter and log determinant of each (grp, start) from its count, sums and sums of products; ``was``, the
    log determinant before, is handed on."""
    factor, floors = consistency(share), np.diag(np.square(FLOORS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                centre = np.array(r.sums) / r.n
                products = np.zeros((P, P))
                products[np.triu_indices(P)] = r.products
                products = products + np.triu(products, 1).T
                scatter = products / r.n - np.outer(centre, centre)
                scatter = scatter * factor + floors
                out.append((r.grp, r.start, centre.tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1]), r.was))
            yield pd.DataFrame(out, columns=["grp", "start", "centre", "precision", "log_det", "was"])

    return sums.mapInPandas(run, "grp string, start int, centre array<double>, precision array<double>, log_det double, was double")


def _summed() -> list[Column]:
    pairs = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i:]]
    return [F.count("*").alias("n"), *(F.sum(c).alias(f"s_{c}") for c in NAMES), *(F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs)]


def _added(frame: DataFrame, by: list[str]) -> DataFrame:
    """Adds up rows of ``_summed`` and gathers them as arrays."""
    sums = [c for c in frame.columns if c.startswith("s_")]
    products = [c for c in frame.columns if c.startswith("p_")]
    added = frame.groupBy(*by).agg(F.sum("n").alias("n"), F.max("was").alias("was"), *(F.sum(c).alias(c) for c in [*sums, *products]))
    return added.select(*by, "n", "was", F.array(*sums).alias("sums"), F.array(*products).alias("products"))


def mcd(vectors: DataFrame, share: float = SHARE, max_steps: int = MAX_STEPS) -> DataFrame:
    """``grp``, ``centre``, ``precision``, ``log_det``: the better of two descents for each group of ``vectors``
    (``grp`` and the transformed statistics)."""
    groups = stored(vectors.groupBy("grp").agg(
        F.count("*").alias("rows"), *(F.percentile_approx(c, 0.5, 10_000).alias(f"m_{c}") for c in NAMES)), "groups")
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS

    def beside(right: DataFrame, key: str) -> DataFrame:
        return vectors.join(F.broadcast(right) if few else right, F.col("grp") == F.col(key))

    # start 0: medians and median deviations; start 1: means and covariances of all rows
    medians = groups.drop("rows").withColumnRenamed("grp", "g")
    deviations = beside(medians, "g").groupBy("grp").agg(
        *(F.first(f"m_{c}").alias(f"m_{c}") for c in NAMES),
        *(F.percentile_approx(F.abs(F.col(c) - F.col(f"m_{c}")), 0.5, 10_000).alias(f"d_{c}") for c in NAMES))
    variance = [F.pow(1.4826 * F.col(f"d_{c}"), F.lit(2)) + f * f for c, f in zip(NAMES, FLOORS)]
    diagonal = F.array(*((1 / variance[i]) if i == j else F.lit(0.0) for i in range(P) for j in range(P)))
    robust = deviations.select(
        "grp", F.lit(0).alias("start"), F.array(*(F.col(f"m_{c}") for c in NAMES)).alias("centre"), diagonal.alias("precision"),
        F.lit(float("inf")).alias("log_det"))
    whole = vectors.groupBy("grp").agg(*_summed()).withColumns({"start": F.lit(1), "was": F.lit(float("inf"))})
    plain = _estimates(_added(whole, ["grp", "start"])).drop("was")
    now = stored(robust.unionByName(plain.withColumn("log_det", F.lit(float("inf")))), "estimates")
    nearest = Window.partitionBy("grp", "start").orderBy("bin")
    for _ in range(max_steps):
        ranked = beside(now.withColumnRenamed("grp", "g"), "g")
        bins = ranked.withColumn("bin", F.floor(F.log2(1 + _distance()) * BINS)).groupBy("grp", "start", "bin").agg(
            *_summed(), F.max("log_det").alias("was"))
        bins = bins.withColumn("before", F.sum("n").over(nearest) - F.col("n"))
        wanted = groups.select(F.col("grp").alias("g"), F.ceil(F.col("rows") * share).alias("wanted"))
        inner = bins.join(wanted, F.col("grp") == F.col("g")).where("before < wanted").drop("g", "wanted", "before", "bin")
        fall = Observation()
        then = _estimates(_added(inner, ["grp", "start"])).observe(fall, F.max(F.col("was") - F.col("log_det")).alias("most"))
        now = stored(then, "estimates").drop("was")
        if (fall.get["most"] or 0) <= SETTLED:
            break
    best = F.min_by(F.struct("centre", "precision", "log_det"), F.struct("log_det", "start")).alias("best")
    return now.groupBy("grp").agg(best).select("grp", "best.*")


def reweighted(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """The estimates refitted on all rows that are near by them, which are more than the share that they come from."""
    few = estimates.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    right = estimates.select(F.col("grp").alias("g"), "centre", "precision")
    near = vectors.join(F.broadcast(right) if few else right, F.col("grp") == F.col("g")).where(_distance() <= limit(1 - REWEIGHTED))
    sums = near.groupBy("grp").agg(*_summed()).withColumns({"start": F.lit(0), "was": F.lit(float("inf"))})
    return _estimates(_added(sums, ["grp", "start"]), REWEIGHTED).select("grp", "centre", "precision", "log_det")


def assessed(docs: DataFrame, tail: float = TAIL, share: float = SHARE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """A row per row of ``docs`` (``doc_id``, ``text``, ``lang``, ``source``): ``doc_id``, ``text_key``, ``lang``, ``source``,
    the five counts, ``base_failed``, ``grp``, ``distance`` (squared Mahalanobis distance, null where the base rules fail)
    and ``kept``.

    Words are runs without ASCII white space. The base rules reject texts under 50 words, null and empty texts among
    them, and texts of which over half the words repeat in windows of three. All others have their transformed statistics
    compared with the estimate of their language and source; a null language or source is a value like others, groups under
    ``group_rows`` documents share one estimate by language, then over all. Rejected: a squared distance above the chi-square
    value that a normal row exceeds with probability ``tail``. Repeated rows count and are returned as often as they
    stand there; other columns are ignored. An empty table gives an empty result.
    """
    rows = grouped(stored(statistics(docs), "statistics").withColumn("base_failed", base_failed()), group_rows)
    rows = rows.withColumns({k: F.when(~F.col("base_failed"), v) for k, v in transformed().items()})
    rows = stored(rows, "vectors")
    vectors = rows.where("not base_failed").select("grp", *NAMES)
    estimates = stored(reweighted(vectors, stored(mcd(vectors, share), "estimates")), "estimates")
    few = estimates.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    estimates = estimates.withColumnRenamed("grp", "g").drop("log_det")
    found = rows.join(F.broadcast(estimates) if few else estimates, F.col("grp") == F.col("g"), "left")
    found = found.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= limit(tail))).drop("g", "centre", "precision", *NAMES)


def accepted(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``assessed`` keeps, with all their columns, whatever their names.

    Rows with equal id, text, language and source are kept or rejected together, null ids, languages and sources too; null and
    empty texts are rejected. An empty table gives an empty result.
    """
    rejected = assessed(docs, **options).where("not kept").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("lang").alias("_lang"), F.col("source").alias("_source")).distinct()
    own = packed(docs).withColumn("_own_key", F.xxhash64("text"))
    same = (F.col("_own_key") == F.col("_key")) & own["doc_id"].cast("long").eqNullSafe(F.col("_id"))
    same = same & own["lang"].cast("string").eqNullSafe(F.col("_lang")) & own["source"].cast("string").eqNullSafe(F.col("_source"))
    return unpacked(own.join(rejected, same, "left_anti").drop("_own_key"), docs.columns)
