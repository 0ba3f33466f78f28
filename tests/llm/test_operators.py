"""The corpus operators against brute force, on a small table of the given data and on rows made for edge cases."""

import base64
import collections
import gzip
import hashlib
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SMALL
from fitgauge.llm import (
    components, decontamination, extraction, line_dedup, markup, mixing, quality, queries, sharding, simhash_dedup,
    substring_dedup, suffix_dedup, suffixes, warc, windows,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


def clashing(df):
    """The table with extra columns of names that operators use themselves."""
    for name in ("shard", "slot", "copy", "fp", "kept", "spans", "row", "rate", "u", "v", "node", "root", "text_key", "component_id",
                 "_id", "_key", "_own_id", "_own_key", "_kept_id", "_kept_key", "_lang", "_source", "_group", "_rate", "_count", "_gone", "_gone_row",
                 "_row", "_part", "_size", "_k1", "_k2", "_k3", "_packed", "shuffle_key", "group", "a`b.c"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(small):
    return [(r.doc_id, r.text) for r in small.orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, white space and accents of all kinds."""
    passage = " ".join(f"w{i % 97}x{i}" for i in range(70))
    long = " ".join(f"word{i * i % 1009}" for i in range(40_000))
    rows = [
        (1, passage, "a"), (2, "before it " + passage + " behind it", "a"), (2, "before it " + passage + " behind it", "a"), (3, None, None),
        (4, "", "a"), (None, passage + " tail", "b"), (5, " \t\n ", "b"), (6, long, "b"), (7, long + " end", "b"), (8, "Ünï çødé wörds\n" * 30, "c"),
        (9, "same line\nother line\nsame line\n" * 9, "c"), (10, "a " * 300, "c"), (11, "x" * 5000, "c"), (12, "x" * 5000, "c"),
        (13, "aé" * 200, "c"), (14, "\x00" * 120 + "b", "c"), (15, "\x00" * 120 + "c", "c"),
    ]
    return documents(spark, rows)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# --- helpers


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(i, i + 1) for i in range(500, 700)] + [(900, x) for x in range(901, 1200)]
    edges = spark.createDataFrame([(a, b) for a, b in pairs] + [(5, 5), (None, 3)], "u long, v long")
    roots = union(1300, pairs)
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {x: roots[x] for p in pairs for x in p if p[0] != p[1]}
    assert components.components(edges.limit(0)).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(5)
    for trial in range(150):
        t = rng.integers(0, rng.integers(1, 4), rng.integers(1, 150)).astype(np.uint8)
        t = np.tile(t, 3) if trial % 3 == 0 else t
        _, first, depth = suffix_dedup._first_bytes(t)
        order = suffixes.suffix_array(first, depth)
        assert list(order) == sorted(range(len(t)), key=lambda i: tuple(t[i:]))
        shared = suffixes.common_prefixes(t, order)
        for k in range(1, len(t)):
            a, b = t[order[k - 1] :], t[order[k] :]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            assert shared[k] == (differ[0] if len(differ) else n)


def test_sliding_least_takes_the_leftmost():
    h = np.random.default_rng(1).integers(0, 5, 300).astype(np.uint64) << np.uint64(32)
    got = windows.sliding_least(h, 13)
    assert got.tolist() == [i + int(np.argmin(h[i : i + 13])) for i in range(len(h) - 12)]


# --- 1 decontamination


def test_leaks_match_brute_force(spark, small, texts):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    flat = [(r.item_id, " " + " ".join(re.findall(r"\w+", r.text.lower())) + " ") for r in benchmark.collect()]
    expected = {(d, i) for d, t in texts for i, x in flat if x in " " + " ".join(re.findall(r"\w+", t.lower())) + " "}
    for options in ({}, {"index_words": 300}):
        got = {(r.doc_id, r.item_id) for r in decontamination.leaks(clashing(small), benchmark, **options).collect()}
        assert got == expected and expected
    left = decontamination.clean(clashing(small), benchmark)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in texts} - {d for d, _ in expected}
    assert left.columns == clashing(small).columns


def test_items_of_odd_ids(spark):
    """Null and very large ids, repeated items, null parts and items without words; a document holds all of them."""
    question = "what do the seven green lanterns by the old harbour say to ships that come in at night"
    least, large = "slow down and keep to the left of the third pier", 2 ** 53 + 1
    items = spark.createDataFrame(
        [(None, question, least), (large, question, least), (large, question, least), (7, None, None), (8, "?", "!"), (9, None, least), (None, None, least)],
        "item_id long, question string, answer string")
    docs = documents(spark, [(1, f"{question} {least}", "a"), (None, f"so {question} {least} then", "a"), (3, None, None), (4, "", "a")])
    for words in (decontamination.INDEX_WORDS, 10):
        got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items, index_words=words).collect()}
        assert got == {(d, i) for d in (1, None) for i in (None, large, 9)}
        assert {r.doc_id for r in decontamination.clean(docs, items, index_words=words).collect()} == {3, 4}
    assert decontamination.clean(docs, items.limit(0)).count() == 4


def test_columns_of_helper_names_pass_through(spark, odd):
    """Each operator that returns documents keeps columns of any names with their values."""
    table = clashing(odd.where("length(text) < 9000 or text is null"))
    extra = table.columns
    rows = table.count()
    for made, added in (
            (sharding.sharded(table, 3), ["shard", "slot"]), (mixing.replicated(table, mixing.tempered_rates(table)), ["copy", "shuffle_key"]),
            (simhash_dedup.representatives(table), []), (quality.accepted(table), []), (line_dedup.deduplicated(table), [])):
        assert made.columns == [c for c in extra if c not in added] + added
        names = [c for c in extra if c not in (*table.columns[:5], *added, "n_chars")]
        for r in made.collect():
            assert all(r[n] == "x" for n in names if n not in ("doc_id", "text", "lang", "source"))
    assert line_dedup.deduplicated(table).count() == sharding.sharded(table, 3).count() == rows


def test_wand_finds_all_above_the_threshold():
    rng = np.random.default_rng(2)
    vocabulary = [f"t{i}" for i in range(60)]
    items = pd.DataFrame([(i, " ".join(rng.choice(vocabulary, 12)), "x. y") for i in range(100)], columns=["item_id", "question", "answer"])
    frequencies = collections.Counter(w for q, a in zip(items.question, items.answer) for w in {*decontamination.terms(q), *decontamination.terms(a)})
    index = decontamination.build(items, frequencies, 100, 14, 5)
    for _ in range(60):
        query = {index.vocabulary[w] for w in rng.choice(vocabulary, 25) if w in index.vocabulary}
        scores = np.zeros(100)
        for t in query:
            scores[index.postings[t][0]] += index.postings[t][1]
        for threshold in (0.3, 0.5, 0.7):
            got = dict(decontamination.search(index, query, threshold))
            assert set(got) == set(np.flatnonzero(scores >= threshold - 1e-9))
            assert all(abs(scores[i] - s) < 1e-9 for i, s in got.items())


def test_passage_bounds_lose_nothing():
    rng = np.random.default_rng(4)
    vocabulary = [f"t{i}" for i in range(200)]
    items = pd.DataFrame([(i, " ".join(rng.choice(vocabulary, 15)), "") for i in range(40)], columns=["item_id", "question", "answer"])
    frequencies = collections.Counter(w for q in items.question for w in set(q.split()))
    index = decontamination.build(items, frequencies, 40, 15, 5)
    docs = [list(rng.choice(vocabulary, int(n))) for n in rng.integers(0, 90, 80)]
    found = set(decontamination.candidates(index, docs, 0.6))
    for d, words in enumerate(docs):
        for p in range(-(-len(words) // index.longest)):
            query = {index.vocabulary[w] for w in words[p * index.longest : (p + 2) * index.longest] if w in index.vocabulary}
            assert (d, p) in found or not decontamination.search(index, query, 0.6)


def test_leaks_of_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (4, "w0x0 w1x1 w2x2 w3x3 w4x4 w5x5. W6X6 w7x7"), (5, "w0x0 w1x1 w2x2 w3x3 w4x4 w5x5. W6X6 w7x7")],
                                  "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id) for r in decontamination.leaks(odd, items).collect())
    assert got == sorted([(d, i) for d in (1, 2, 2, -1) for i in (4, 5)])
    assert decontamination.leaks(odd.limit(0), items).count() == 0
    assert decontamination.leaks(odd, items.limit(0)).count() == 0
    assert decontamination.clean(odd, items).count() == odd.count() - 4
    split = spark.createDataFrame([(4, "w0x0 w1x1 w2x2 w3x3 w4x4 w5x5", "absent answer")], "item_id long, question string, answer string")
    assert decontamination.leaks(odd, split).count() == 0  # the answer has to be there too


# --- 2 line dedup


def normal(line):
    return " ".join("".join(c if unicodedata.category(c)[0] == "L" else " " for c in line.lower()).split())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_brute(rows, bits=3, similarity=0.8):
    seen = {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            if normal(line):
                seen.setdefault(normal(line), []).append((d is None, d, i))
    lines = list(seen)
    prints = []
    for line in lines:
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in line.split(" ")]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    pairs = []
    for i, a in enumerate(lines):
        for j in range(i):
            b = lines[j]
            most = int(max(len(a), len(b)) * (1 - similarity) + 1e-9)
            if (prints[i] ^ prints[j]).bit_count() <= bits and abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                pairs.append((i, j))
    roots, best = union(len(lines), pairs), {}
    for r, line in zip(roots, lines):
        best[r] = min([*seen[line], *([best[r]] if r in best else [])], key=lambda x: (x[0], x[1] or 0, x[2]))
    return {place: best[r] for r, line in zip(roots, lines) for place in seen[line]}


def test_line_groups_match_brute_force(spark, small, texts):
    base = "this is one fairly common line of words that many documents share with small edits in it"
    near = [(1000 + i, f"{base} {i % 7}{'x' * (i % 5)}\n{base.replace('common', 'comm' + 'o' * (i % 4) + 'n')}") for i in range(40)]
    rows = [*texts[:120], *near]
    expected = line_brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for crowded in (200, 2):
        got = {(False, r.doc_id, r.line_no): (False, r.group_doc_id, r.group_line_no) for r in line_dedup.line_groups(clashing(df), crowded=crowded).collect()}
        assert got == expected
    assert len(set(expected.values())) < len({x for x in expected})


def test_lines_of_odd_rows(spark, odd):
    got = line_dedup.line_groups(odd).collect()
    kept = collections.Counter((r.group_doc_id, r.group_line_no) for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {(r.group_doc_id, r.group_line_no) for r in got}
    assert not {r.doc_id for r in got} & {3, 4, 5}
    whole = line_dedup.deduplicated(clashing(odd))
    left = {(r.doc_id, r.text) for r in whole.select("doc_id", "text").collect()}
    assert {(9, "same line\nother line\n"), (4, ""), (3, None)} <= left
    assert whole.columns == clashing(odd).columns
    assert line_dedup.line_groups(odd.limit(0)).count() == 0


def test_pivots_keep_chains(spark):
    """A chain whose ends have the least keys and become pivots: only the two lines between, under different pivots, link them."""
    chain = [(0, "a" * 20), (2, "a" * 17 + "b" * 3), (3, "a" * 14 + "b" * 6), (1, "a" * 11 + "b" * 9)]
    lines = spark.createDataFrame([(k, 0, t) for k, t in chain], "k1 long, k2 long, norm string")
    prints = lines.select("k1", "k2", F.length("norm").alias("len"), F.lit(0).cast("long").alias("fp"))
    for crowded in (100, 2):
        links = line_dedup.line_links(lines, prints, 3, 0.8, crowded)
        roots = components.components(links.select(F.col("a_k1").alias("u"), F.col("b_k1").alias("v"))).collect()
        assert {(r.node, r.root) for r in roots} == {(k, 0) for k in range(4)}


def similar_groups(lines, similarity=0.8):
    """Components of all pairs of that edit similarity, whatever their bits or words."""
    pairs = []
    for i, a in enumerate(lines):
        for j in range(i):
            most = int(max(len(a), len(lines[j])) * (1 - similarity) + 1e-9)
            if abs(len(a) - len(lines[j])) <= most and distance(a, lines[j]) <= most:
                pairs.append((i, j))
    return union(len(lines), pairs)


def test_shared_words_find_what_edits_allow(spark):
    """Planted lines with random edits in up to a sixth of their words; short ones with edits anywhere."""
    rng = np.random.default_rng(7)

    def word(n):
        return "".join(rng.choice(list("abcdefghijklmnop"), n))

    common, lines = [word(4) for _ in range(12)], []
    for i in range(60):
        n = int(rng.integers(6, 30))
        words = [str(rng.choice(common)) if rng.random() < 0.3 else word(int(rng.integers(3, 9))) for _ in range(n)]
        lines.append(" ".join(words))
        for _ in range(3):
            other = list(words)
            for at in rng.choice(n, max(1, n // 6), replace=False):
                other[at] = word(len(other[at]))
            lines.append(" ".join(other))
    for i in range(40):
        base = list(word(int(rng.integers(5, 25))))
        lines.append("".join(base))
        for at in rng.choice(len(base), len(base) // 5, replace=False):
            base[at : at + 1] = list(word(int(rng.integers(0, 3))))
        lines.append("".join(base))
    lines = sorted(set(lines))
    expected = similar_groups(lines)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    for crowded in (line_dedup.CROWDED, 3):
        found = {r.doc_id: r.group_doc_id for r in line_dedup.line_groups(df, crowded=crowded, shared_words=True).collect()}
        assert len(found) == len(lines)
        least = {}
        for i, root in enumerate(expected):
            least.setdefault(root, i)
        assert found == {i: least[root] for i, root in enumerate(expected)}
    by_bits = {r.doc_id: r.group_doc_id for r in line_dedup.line_groups(df).collect()}
    assert len(set(by_bits.values())) > 1.3 * len(least)


def edited(rng, text, edits):
    """``text`` with characters replaced, put in and left out."""
    chars = list(text)
    for _ in range(edits):
        at = int(rng.integers(0, len(chars)))
        chars[at : at + 1] = rng.choice(list("abcdéß中😀 "), int(rng.integers(0, 3)))
    return "".join(chars)


def test_bound_of_edit_distance(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n in (0, 1, 7, 8, 9, 40, 150, 300):
        for edits in (0, 1, n // 20, n // 8, n // 3):
            a = "".join(rng.choice(list("abcdéß中😀 "), n))
            b = edited(rng, a, edits) if a else "x" * edits
            rows += [(a, b), (a, b[n // 6 :]), (a, b[: n // 2] + "some other words " + b[n // 2 :]), (a, b[::-1])]
    df = spark.createDataFrame(rows, "a_norm string, b_norm string").withColumn("most", F.floor(F.greatest(F.length("a_norm"), F.length("b_norm")) * 0.2).cast("int"))
    got = df.select("*", line_dedup._most_apart(F.col("a_norm"), F.col("b_norm"), F.col("most")).alias("bound")).collect()
    decided = 0
    for r in got:
        d = distance(r.a_norm, r.b_norm)
        assert r.bound >= min(d, r.most + 1)
        decided += r.bound <= r.most
        if r.a_norm == r.b_norm:
            assert r.bound == 0
    assert decided > 40
    kept = line_dedup._similar(df.drop("most").withColumns({"a": F.col("a_norm"), "b": F.col("b_norm")}), 0.8).collect()
    near = [(r.a_norm, r.b_norm) for r in got if distance(r.a_norm, r.b_norm) <= r.most]
    assert sorted((r.a, r.b) for r in kept) == sorted(near)


def test_connected_lines_are_not_compared_again(spark, monkeypatch):
    """Near copies of one line: few of their pairs are compared, and they are one group still."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(40)]
    texts = []
    for i in range(60):
        own = list(words)
        own[i % 40] = f"other{i}"
        texts.append(" ".join(own))
    compared, similar = [], line_dedup._similar
    monkeypatch.setattr(line_dedup, "_similar", lambda pairs, *options: (compared.append(pairs.count()), similar(pairs, *options))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = line_dedup.line_groups(df, shared_words=True, whole=True).collect()
    assert len(found) == 60 and {r.group_doc_id for r in found} == {0}
    assert sum(compared) < 5 * 60  # of 1770 pairs


def test_hot_words_are_met_in_pairs(spark):
    """Lines of few common words: hardly any two meet that are not near copies, and each near copy meets its line."""
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(150)]
    texts = []
    for _ in range(300):
        words = list(rng.choice(vocabulary, 20, replace=False))
        texts.append(" ".join(words))
        words[int(rng.integers(0, 20))] = str(rng.choice(vocabulary))
        texts.append(" ".join(words))
    lines = line_dedup.occurrences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), line_dedup.whole_line)
    rows = line_dedup.worded(lines, 0.8, 1)

    def met(hot):
        own = line_dedup._keyed(rows, hot).select("bucket", F.col("k1").alias("k"))
        pairs = own.join(own.select(F.col("bucket").alias("met"), F.col("k").alias("l")), (F.col("bucket") == F.col("met")) & (F.col("k") < F.col("l")))
        return {tuple(r) for r in pairs.select("k", "l").collect()}, pairs.count()

    alone, paired = met(128), met(0)  # no word is hot, all are
    keys = [r.k1 for r in lines.orderBy("doc_id").collect()]
    copies = {tuple(sorted(keys[i : i + 2])) for i in range(0, 600, 2) if texts[i] != texts[i + 1]}
    assert copies <= alone[0] and copies <= paired[0]
    assert paired[1] < alone[1] / 2
    parts = [line_dedup._keyed(rows, 0, part, 3) for part in range(3)]
    whole = collections.Counter(tuple(r) for r in line_dedup._keyed(rows, 0).collect())
    assert whole == sum((collections.Counter(tuple(r) for r in x.collect()) for x in parts), collections.Counter())


def test_line_shuffles_go_and_the_setting_stays(spark):
    before = spark.conf.get(line_dedup.DROPPED, None)
    line_dedup.line_groups(spark.createDataFrame([(1, "some line of text here"), (2, "some line of texts here")], "doc_id long, text string"), shared_words=True)
    assert spark.conf.get(line_dedup.DROPPED, None) == before


def test_numbers_symbols_and_marks_count(spark):
    texts = ["Order 17: 250 units", "Order 93: 8 units", "order  17: 250\tunits", "2024-01-31", "2024-01-31", "=====", "=====", " \t ", "कि", "का"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id: r.text for r in line_dedup.deduplicated(df).collect()}
    assert len(left) == 10 and {i for i, t in left.items() if t} == {0, 1, 3, 5, 7, 8, 9}
    found = {r.doc_id: r.group_doc_id for r in line_dedup.line_groups(df, shared_words=True, whole=True).collect()}
    assert found == {0: 0, 1: 1, 2: 0, 3: 3, 4: 3, 5: 5, 6: 5, 8: 8, 9: 9}


def test_more_blocks_for_more_lines():
    assert len(line_dedup.choices(1000, 3)) == 4
    many = line_dedup.choices(10**10, 3)
    assert len(many) > 4 and len(set(many)) == len(many)


def test_mixing_query_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    expected = con.sql(queries.ORACLE["op6_mixing"])
    got = queries.op6_mixing(spark, SMALL)
    assert sorted(got.columns) == sorted(expected.columns)
    assert sorted(tuple(r) for r in got.select(*expected.columns).collect()) == sorted(expected.fetchall())


def test_line_dedup_runs_no_python(spark):
    df = queries.op2_line_dedup(spark, SMALL)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


# --- 3 sharding


def test_shards_are_equal_in_bytes(spark, small, texts):
    size = lambda t: len((t or "").encode()) + 16
    key = lambda t: int(hashlib.md5(str(t or "").encode()).hexdigest()[:15], 16)
    for shards, part_bytes in ((40, 1 << 28), (7, 9000), (1, 1 << 28)):
        got = sharding.sharded(clashing(small), shards, part_bytes=part_bytes).collect()
        total, before, expected, slots = sum(size(t) for _, t in texts), 0, {}, collections.Counter()
        for d, t in sorted(texts, key=lambda x: (key(x[1]), key(x[0]))):
            shard = before * shards // total
            expected[d] = (shard, slots[shard])
            slots[shard] += 1
            before += size(t)
        assert {r.doc_id: (r.shard, r.slot) for r in got} == expected


def test_shards_of_odd_and_repeated_rows(spark, odd):
    rows = [(1, "same text", "a")] * 3000 + [(i, "same text", "a") for i in range(2, 1500)] + [(None, None, None)] * 500
    df = documents(spark, rows)
    for table, shards in ((df, 10), (odd, 3), (odd, 100)):
        got = sharding.sharded(table, shards).collect()
        assert len(got) == table.count()
        by = collections.defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    by = collections.Counter()
    for r in sharding.sharded(df, 10).collect():
        by[r.shard] += len((r.text or "").encode()) + 16
    assert max(by.values()) - min(by.values()) <= 2 * 25
    assert sharding.sharded(odd.limit(0)).count() == 0


def test_sharding_query(spark, texts):
    rows = queries.op3_sharding(spark, SMALL).collect()
    sums = {d: zlib.crc32(t.encode()) for d, t in texts}
    assert {r.doc_id: r.text_crc32 for r in rows} == sums
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


# --- 4 WARC


def test_warc_round_trip(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    responses = warc.responses(clashing(pages)).collect()
    made = warc.archived(warc.derived(warc.responses(pages)))
    rows = made.collect()
    assert len(rows) == 2 * pages.count()
    sources = {r.record_id: {h["name"]: h["value"] for h in r.headers} | {"block": r.block} for r in responses}
    for r in rows:
        headers = {h["name"]: h["value"] for h in r.headers}
        source = sources[headers["WARC-Refers-To"]]
        assert headers["WARC-Refers-To-Target-URI"] == source["WARC-Target-URI"] == r.target_uri
        assert headers["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r.block).digest()).decode()
        assert int(headers["Content-Length"]) == len(r.block)
        if r.warc_type == "metadata":
            assert f"source-payload-digest: {source['WARC-Payload-Digest']}" in r.block.decode()
            assert f"source-block-digest: {source['WARC-Block-Digest']}" in r.block.decode()
            assert "http-header-content-type: text/html; charset=utf-8" in r.block.decode()
    linked = {r.record_id: {h["name"]: h["value"] for h in r.headers}["WARC-Concurrent-To"] for r in rows}
    assert all(linked[linked[i]] == i for i in linked)
    file = spark.createDataFrame([(bytearray(b"".join(r.member for r in rows)),), (None,), (bytearray(b""),)], "content binary")
    again = warc.parsed(file).collect()
    assert [(r.record_id, r.warc_type, r.block) for r in again] == [(r.record_id, r.warc_type, r.block) for r in rows]


def test_warc_bodies_as_servers_send_them():
    body = "<html lang=fr><title>Été\n x</title><p>caf\xe9 <a href='/a?b&amp;c'>l</a></p>".encode("latin-1")
    packed = gzip.compress(body)
    chunks = f"{len(packed):x}".encode() + b"\r\n" + packed + b"\r\n0\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n"
    metadata, conversion = warc.derivatives("<urn:x>", "http://h/", {"WARC-Date": "2020-01-01T00:00:00Z", "WARC-Payload-Digest": "sha1:SOURCE"}, head + chunks)
    assert conversion[5].decode() == "café l"
    text = metadata[5].decode()
    for line in ("source-payload-digest: sha1:SOURCE", "title: Été x", "languages-declared: fr", "outlink: /a?b&c", "charset-detected: iso-8859-1"):
        assert line + "\r\n" in text


def test_warc_of_odd_rows(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "http://x/", ""), (1, "http://x/", "")], "page_id long, url string, html string")
    rows = warc.derived(warc.responses(pages)).collect()
    assert len(rows) == 6 and all(r.block == b"" for r in rows if r.warc_type == "conversion")
    assert warc.derived(warc.responses(pages.limit(0))).count() == 0
    assert warc.derived(warc.derived(warc.responses(pages))).count() == 0  # no response among them
    for broken in (b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort", b"\x1f\x8bbroken", b"no record"):
        assert [(r[1], r[5]) for r in warc.read(broken)] == [(warc.DAMAGED, broken)]


def a_record(i):
    block = f"block {i}\r\n\r\nWARC/ is no record\n".encode() * 60
    return warc.written([{"name": "WARC-Type", "value": "response"}, {"name": "WARC-Record-ID", "value": f"<{i}>"},
                         {"name": "Content-Length", "value": str(len(block))}], block)


def test_warc_files_are_read_on_behind_damage(spark):
    plain = [a_record(i) for i in range(6)]
    members = [gzip.compress(r) for r in plain]

    def ids(data):
        return [r[0] or r[1] for r in warc.read(data)]

    every = [f"<{i}>" for i in range(6)]
    assert ids(b"".join(plain)) == ids(b"".join(members)) == ids(gzip.compress(b"".join(plain))) == every
    expected = [*every[:2], warc.DAMAGED, *every[3:]]
    for hole in (plain[2][:-300], plain[2].replace(b"Content-Length: ", b"Content-Length: -"), plain[2].replace(b"Content-Length: ", b"Content-Length: 9"),
                 plain[2][:20], plain[2].replace(b"WARC/1.1", b"WRAC/1.1")):
        data = b"".join([*plain[:2], hole, *plain[3:]])
        assert ids(data) == expected
        assert next(r[5] for r in warc.read(data) if r[1] == warc.DAMAGED) == hole
    broken = members[2][:20] + b"\0\0\0" + members[2][23:]
    assert ids(b"".join([*members[:2], broken, *members[3:]])) == expected
    assert ids(b"".join(members)[:-9]) == [*every, warc.DAMAGED] and ids(b"junk\n" + b"".join(plain)) == [warc.DAMAGED, *every]
    files = spark.createDataFrame([(bytearray(b"".join([*plain[:2], plain[2][:40], *plain[3:]])), "x")], "content binary, block string")
    assert warc.derived(warc.parsed(files)).count() == 10


@pytest.mark.parametrize("charset", ["idna", "undefined", "utf-7", "unicode_escape", "rot13", "hex", "punycode", "no-such", "utf-16", "latin-1"])
def test_warc_pages_of_any_charset(charset):
    page = b"<p>plain +2AA- \\ud800 \xff words</p>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}\r\n\r\n".encode() + page
    for record in warc.derivatives("<urn:x>", "http://h/", {}, block):
        record[5].decode()
    if charset in ("idna", "undefined", "rot13", "hex", "no-such"):
        assert record[5].decode() == "plain +2AA- \\ud800 \ufffd words"


@pytest.mark.parametrize("size", ["-6", "+3", "0x3", "1_0", "", "zz"])
def test_warc_chunk_sizes_that_are_none(size):
    body = f"{size}\r\nabc\r\n0\r\n\r\n".encode()
    assert warc._dechunked(body) == body
    assert warc._dechunked(b"3;name=x\r\nabc\r\n00\r\n\r\n") == b"abc" and warc._dechunked(b" 3 \r\nab") == b"ab"


# --- 5 quality rules


def counted(text):
    words = words_of(text)
    threes = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_quality_counts(spark, small, texts, odd):
    got = {r.doc_id: tuple(r[c] for c in quality.COUNTS) for r in quality.statistics(small).collect()}
    assert got == {d: counted(t) for d, t in texts}
    rows = [(r.doc_id, tuple(r[c] for c in quality.COUNTS)) for r in quality.statistics(odd).collect()]
    assert sorted(rows, key=str) == sorted([(r.doc_id, counted(r.text)) for r in odd.collect()], key=str)


def test_many_distinct_words_count_alike(monkeypatch):
    words = [f"{i % 700}".encode() for i in range(3000)]
    assert quality.repeated_words(words) == counted(" ".join(w.decode() for w in words))[4]


def test_quality_verdicts(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(900):
        words = ["".join(rng.choice(list("abcdefgh"), int(n))) for n in rng.integers(2, 9, int(rng.integers(60, 400)))]
        if i % 30 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "hot" if i % 3 else f"s{i % 9}"))
    df = documents(spark, [*rows, (None, None, None), (1000, "short", "hot")])
    got = {r.doc_id: r for r in quality.assessed(clashing(df)).collect()}
    assert len(got) == 902 and not got[None].kept and got[None].base_failed and not got[1000].kept
    assert {i for i in range(900) if not got[i].kept} == set(range(0, 900, 30))
    kept = quality.accepted(df)
    assert kept.count() == 870 and kept.columns == df.columns
    assert quality.assessed(df.limit(0)).count() == 0


def test_quality_finds_an_outlier_of_each_statistic(spark):
    """One planted row for each statistic in a clean source, and clean rows beside it."""
    rng = np.random.default_rng(3)

    def words(n, low=3, high=8):
        return ["".join(rng.choice(list("abcdefgh"), int(k))) for k in rng.integers(low, high, n)]

    clean = [(i, "\n".join(" ".join(words(10)) for _ in range(int(rng.integers(18, 23)))), "s") for i in range(600)]
    passage = words(48)
    planted = [
        " ".join(words(2600)), " ".join(words(200, 9, 10)), " ".join(w + "#" if i % 5 == 0 else w for i, w in enumerate(words(200))),
        " ".join(passage + words(120) + passage), "\n".join([*(" ".join(words(10)) for _ in range(18)), *["ab"] * 10]),
    ]
    got = {r.doc_id: r for r in quality.assessed(documents(spark, [*clean, *((1000 + i, t, "s") for i, t in enumerate(planted))])).collect()}
    assert not any(r.base_failed for r in got.values())
    assert not any(got[1000 + i].kept for i in range(len(planted)))
    assert sum(not got[i].kept for i in range(600)) <= 3


def test_quality_estimates_resist_outliers(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(0, 1, (4000, quality.P)) * 3
    values[:800] += 60
    df = spark.createDataFrame([("g", *map(float, v)) for v in values], "grp string, " + ", ".join(f"{c} double" for c in quality.NAMES))
    found = quality.mcd(df).first()
    assert np.abs(np.array(found.centre)).max() < 0.5
    scatter = np.linalg.inv(np.array(found.precision).reshape(quality.P, quality.P))
    assert 6 < np.diag(scatter).min() and np.diag(scatter).max() < 13  # 9, with clean rows about 94 % of the share's complement


def test_chi_square():
    assert abs(quality.chi_square(11.0705, 5) - 0.95) < 1e-5 and abs(quality.upper_tail(11.0705, 5) - 0.05) < 1e-5
    assert abs(quality.upper_tail(quality.limit(1e-9), 5) - 1e-9) < 1e-12


# --- 6 mixing


def test_mixing_follows_the_rates(spark, small, texts):
    rates = {r.source: r.rate for r in mixing.tempered_rates(small).collect()}
    sizes = collections.Counter()
    for r in small.collect():
        sizes[r.source] += len(r.text.encode())
    weights = sum(v**0.5 for v in sizes.values())
    for s, n in sizes.items():
        assert abs(rates[s] - sum(sizes.values()) * (n**0.5 / weights) / n) < 1e-9
    counts = collections.Counter(r.doc_id for r in mixing.replicated(clashing(small), mixing.tempered_rates(small)).collect())
    source = {r.doc_id: r.source for r in small.collect()}
    for d, s in source.items():
        u = int(hashlib.md5(f"42:0:{d}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, np.exp(-rates[s])
        c = p
        while c <= u:
            k += 1
            p = p * rates[s] / k
            c += p
        assert counts[d] == k


def test_poisson_means(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"))
    for mean in (0.0, 0.3, 4.0, 700.0):
        got = df.select(mixing.poisson_count(F.lit(mean), 1, F.col("doc_id")).alias("n")).agg(F.avg("n"), F.variance("n")).first()
        assert abs(got[0] - mean) <= 5 * (mean / 4000) ** 0.5
        assert abs(got[1] - mean) <= 0.15 * mean


def test_mixing_of_odd_rows(spark, odd):
    rates = spark.createDataFrame([("a", 3.0), (None, 9.0), ("b", 0.0)], "source string, rate double")
    got = mixing.replicated(odd, rates)
    rows = got.collect()
    assert {r.source for r in rows} <= {"a", None} and got.columns == [*odd.columns, "copy", "shuffle_key"]
    copies = collections.Counter((r.doc_id, r.copy) for r in rows)
    assert all(n == (2 if d == 2 else 1) for (d, _), n in copies.items())
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    assert mixing.replicated(odd.limit(0), mixing.tempered_rates(odd.limit(0))).count() == 0


# --- 7 HTML extraction


@pytest.fixture(scope="module")
def model(spark):
    return extraction.train(extraction.labelled_pages(extraction.training_texts(spark.read.parquet(f"{SMALL}/benchmark.parquet"))))


def test_extraction_of_the_given_pages(spark, model):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    from html import unescape

    for r in extraction.extracted(clashing(pages), model).collect():
        page = pages.where(F.col("page_id") == r.page_id).first().html
        article = page[page.index("<article>") + 9 :].split("</article>")[0]
        parts = (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:h1|p)>", article))
        assert r.text == "\n".join(p for p in parts if p)


def test_extraction_held_out(spark, model):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    pages = extraction.labelled_pages(texts, 300, seed=99)
    wrong = sum(a != b for page, y in pages for a, b in zip(y, model.labels(page)))
    assert wrong / sum(len(y) for _, y in pages) < 0.03


def test_viterbi_is_the_best_sequence(model):
    from itertools import product

    for page, _ in extraction.labelled_pages(["One text. Of some words.", "And another one"], 40, seed=5):
        if len(page) > 9:
            continue
        scores = [[sum(model.weights.get(f, (0, 0))[k] for f in names) for k in (0, 1)] for names in extraction.features(page)]

        def total(y, scores=scores):
            return model.start[y[0]] + sum(s[k] for s, k in zip(scores, y)) + sum(model.pairs[a, b] for a, b in zip(y, y[1:]))

        best = max(product((0, 1), repeat=len(page)), key=total)
        assert abs(total(best) - total(model.labels(page))) < 1e-9


def test_markup_of_broken_pages():
    page = "<p>a &amp; b<p>c<b>d</b> e\n f<br>g<ul><li>x<li>y</ul><script>no</p></script><!-- no --><style>no</style>tail < 5 &lt; &nbsp;z<div"
    assert [b.text for b in markup.blocks(page)] == ["a & b", "cd e f g", "x", "y", "tail < 5 < z"]
    assert [b.path[-1][0] for b in markup.blocks(page)[:4]] == ["p", "p", "li", "li"]
    assert markup.blocks("") == [] and markup.blocks("<div><p></p></div>") == []
    assert markup.attribute_words(' class="mainNav side-bar2" id=Top data-x="class"') == ("main", "nav", "side", "bar", "top")
    assert [b.text for b in markup.blocks("<" * 2000 + "x" + "<p" * 500)]  # and it ends


def test_extraction_of_odd_rows(spark, model):
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<article><p>" + "long text. " * 50_000), (3, "u", "<nav><a href=x>y</a></nav>")],
                                  "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extraction.extracted(pages, model).collect()}
    assert got[1] == got[None] == got[3] == "" and got[2] == ("long text. " * 50_000).strip()
    assert extraction.extracted(pages.limit(0), model).count() == 0


# --- 8 SimHash near-dedup


def fingerprint(text):
    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, small, texts, odd):
    for df, rows in ((clashing(small), texts), (odd, [(r.doc_id, r.text) for r in odd.collect()])):
        prints = [fingerprint(t) for _, t in rows]
        pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
        roots = union(len(rows), pairs)
        least = {}
        for (d, _), r in zip(rows, roots):
            least[r] = min((x for x in (d, least.get(r)) if x is not None), default=None)
        expected = sorted(((d, f, least[r]) for (d, _), f, r in zip(rows, prints, roots)), key=str)
        for bucket_rows in (30_000, 3):
            got = simhash_dedup.near_duplicates(df, bucket_rows=bucket_rows).collect()
            assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == expected


def test_simhash_links_lose_nothing(spark):
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 1 << 63, 12)
    flips = [sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 5)), replace=False)) for _ in range(600)]
    prints = np.unique([int(centres[i % 12]) ^ f for i, f in enumerate(flips)] + [int(x) for x in rng.integers(0, 1 << 63, 300)])
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 4]
    roots = union(len(prints), pairs)
    df = spark.createDataFrame([(int(x),) for x in prints], "fp long")
    for bucket_rows in (30_000, 10):
        edges = [(r.u, r.v) for r in simhash_dedup.links(df, 4, bucket_rows).collect()]
        at = {int(x): i for i, x in enumerate(prints)}
        assert union(len(prints), [(at[u], at[v]) for u, v in edges]) == roots


@pytest.mark.parametrize("max_bits", [0, 1, 3, 4, 6])
def test_pigeonhole_plans_cover_every_pair(max_bits):
    rng = np.random.default_rng(max_bits)
    bits = (rng.random((2000, 64)) < rng.random(64)).astype(float)
    both = (bits.T @ bits).astype(np.int64)
    for parts in range(1, max_bits + 2):
        groups = simhash_dedup.group_bits(2000, both, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        _, thresholds = simhash_dedup.allocate(2000, both, groups, max_bits)
        assert sum(thresholds) == max_bits - parts + 1 and min(thresholds) >= -1
        probed = [(set(g), t) for g, t in zip(groups, thresholds)]
        for _ in range(300):
            difference = set(rng.choice(64, max_bits, replace=False).tolist())
            assert any(len(difference & g) <= t for g, t in probed)
    masks = simhash_dedup.masks(simhash_dedup.plan(2000, both, max_bits))  # of the plan that is used
    for _ in range(300):
        difference = sum(1 << int(b) for b in rng.choice(64, max_bits, replace=False))
        assert any(not m & difference for m in masks)


def test_representatives(spark, odd):
    rows = simhash_dedup.near_duplicates(odd).collect()
    groups = {r.component_fp for r in rows}
    kept = simhash_dedup.representatives(clashing(odd))
    assert kept.count() == len(groups)
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in rows}
    assert simhash_dedup.representatives(odd.limit(0)).count() == 0 and simhash_dedup.near_duplicates(odd.limit(0)).count() == 0


# --- 9 and 10: repeated bytes and words


def spans(covered):
    return [(m.start(), m.end()) for m in re.finditer("1+", "".join("1" if c else "0" for c in covered))]


def bytes_brute(rows, window=50):
    first = {}
    for d, t in rows:
        b, d = (t or "").encode(), float("inf") if d is None else d
        for i in range(len(b) - window + 1):
            first[b[i : i + window]] = min(d, first.get(b[i : i + window], d))
    out = []
    for d, t in rows:
        b, covered = (t or "").encode(), [False] * len((t or "").encode())
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < (float("inf") if d is None else d):
                covered[i : i + window] = [True] * window
        out.append((d, len(b), spans(covered), bytes(x for x, c in zip(b, covered) if not c)))
    return out


def words_brute(rows, window=35):
    count = collections.Counter()
    for _, t in rows:
        w = words_of(t)
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, t in rows:
        w = words_of(t)
        covered = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                covered[i : i + window] = [True] * window
        out.append((d, len(w), spans(covered), " ".join(x for x, c in zip(w, covered) if not c).encode()))
    return out


def spanned(rows, n):
    return sorted(((r.doc_id, r[n], [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in rows), key=str)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 3000, "range_bytes": 200_000, "block": 700}])
def test_repeated_bytes(spark, texts, odd, options):
    rows = texts[:130] + [(r.doc_id if r.doc_id is None else 5000 + r.doc_id, (r.text or "")[:3000] if r.text is not None else None) for r in odd.collect()]
    rows += [(6000 + i, f"{i} " + "the passage that stands in a great many documents, whole as it is, " * 2 + f"{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("shard", F.lit(1))
    assert spanned(suffix_dedup.suffix_dedup(df, **options).collect(), "n_bytes") == sorted(bytes_brute(rows), key=str)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 3000, "range_bytes": 200_000, "block": 200}])
def test_repeated_words(spark, texts, odd, options):
    rows = texts[:150] + [(r.doc_id, r.text) for r in odd.collect()]
    rows += [(6000 + i, f"{i} " + "the passage that stands in a great many documents whole as it is " * 4 + f"{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("shard", F.lit(1))
    assert spanned(substring_dedup.substring_dedup(df, **options).collect(), "n_words") == sorted(words_brute(rows), key=str)


def test_repeated_parts_of_empty_tables(spark, odd):
    assert suffix_dedup.suffix_dedup(odd.limit(0)).count() == 0
    assert substring_dedup.substring_dedup(odd.limit(0)).count() == 0


def test_merged_classes():
    rng = np.random.default_rng(8)
    shards, every = [], {}
    for _ in range(5):
        keys = sorted({bytes(rng.integers(0, 3, 4, dtype=np.uint8)) for _ in range(30)})
        values = rng.integers(1, 100, len(keys))
        shards.append((np.array(keys, dtype="V4"), values))
        for k, v in zip(keys, values):
            every[k] = min(every.get(k, 1000), int(v))
    from fitgauge.llm.blocks import merged_values

    for (keys, _), got in zip(shards, merged_values(shards, np.minimum)):
        assert got.tolist() == [every[k.tobytes()] for k in keys]


def test_kept_words_take_time_by_their_own_document():
    """A shard has many documents: no document may go through the words of all."""
    sizes = []

    class Counted(np.ndarray):
        def __sub__(self, other):
            sizes.append(len(self))
            return np.asarray(self) - np.asarray(other)

    texts = [b"a bc  def", b"", b"one two three four", b"\tx "]
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = substring_dedup.Words(35)
    t = kind.tokens(data, np.cumsum([len(x) + 1 for x in texts]))
    t.state = {k: v.view(Counted) for k, v in t.state.items()}
    covered = np.zeros(len(t.state["start"]), bool)
    covered[1] = True
    found = [kind.result(data, t, d, covered[a:b]) for d, (a, b) in enumerate(zip(t.doc_start, t.doc_end))]
    assert found == [(3, [{"start": 1, "end": 2}], b"a def"), (0, [], b""), (4, [], b"one two three four"), (1, [], b"x")]
    assert max(sizes) <= 4
