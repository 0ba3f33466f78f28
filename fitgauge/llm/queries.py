"""Each corpus operator as a query over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fitgauge.llm import (
    collocations, conversation_trie, decontamination, extraction, line_dedup, mixing, quality, secrets, sharding, simhash_dedup, substring_dedup, suffix_dedup, warc,
)
from fitgauge.llm.shared import table, text_bytes

SHARDS = 40


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "question_overlap", "answer_overlap")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_groups(table(spark, sf_dir, "documents"), shared_words=True, whole=True).drop("row")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumns({
        "size": text_bytes() + 16, "text_crc32": F.coalesce(F.crc32("text"), F.lit(0)).cast("long")})
    return sharding.sharded(docs, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers as text, so that a record is one comparable row."""
    found = warc.derived(warc.responses(table(spark, sf_dir, "pages")))
    head = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return found.select("record_id", "warc_type", "target_uri", "refers_to", head.alias("header"), F.decode("block", "UTF-8").alias("block"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assessed(table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS, "base_failed", "kept", "distance")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.replicated(docs, mixing.tempered_rates(docs))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extraction.training_texts(table(spark, sf_dir, "benchmark"))
    model = extraction.train(extraction.labelled_pages(texts))
    return extraction.extracted(table(spark, sf_dir, "pages"), model).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _removed() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), window=50)
    return found.select(
        "doc_id", "n_bytes", _removed().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", _removed().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(*conversation_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.spans(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secrets.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(secrets.joined_spans(base), 256).alias("base_sha256"), secrets.joined_spans(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_sharding": op3_sharding,
    "op4_warc": op4_warc,
    "op5_quality_rules": op5_quality_rules,
    "op6_mixing": op6_mixing,
    "op7_html_extraction": op7_html_extraction,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_collocations": op12_collocations,
    "op13_secrets": op13_secrets,
}

def _secrets_sql() -> str:
    """Every rule on every text, without an index."""
    one = """
            select "row", {n} as rule, '{kind}' as kind, {least} as least, i, length(between[i]) as b, length(whole[i]) as w, length(part[i]) as p
            from (select *, unnest(range(1, len(whole) + 1)) as i from (
                select "row", string_split_regex(text, '{pattern}') as between, regexp_extract_all(text, '{pattern}') as whole,
                    regexp_extract_all(text, '{pattern}', {group}) as part from texts))"""
    rules = [
        one.format(n=n, kind=r.kind, least=r.least, pattern=r.expression.replace("'", "''"), group=r.group) for n, r in enumerate(secrets.RULES)]
    return f"""
        with texts as materialized (select row_number() over () as "row", doc_id, coalesce(text, '') as text from documents),
        matches as ({" union all ".join(rules)}),
        placed as (select *, cast(sum(b + w) over (partition by "row", rule order by i) as bigint) as "end" from matches),
        spans as (select *, kind || ':' || ("end" - w) || ':' || "end" as span, "end" - w as start from placed where p >= least)
        select doc_id, count(*) filter (rule = 0) as n_assign, count(*) filter (rule = 1) as n_access, count(*) filter (rule = 2) as n_hex,
            sha256(coalesce(string_agg(span, ',' order by start, rule) filter (rule < 3), '')) as base_sha256,
            coalesce(string_agg(span, ',' order by start, rule), '') as spans
        from texts left join spans using ("row") group by "row", doc_id"""


ORACLE: dict[str, str] = {
    "op6_mixing": """
        with recursive sizes as (
            select source, cast(sum(coalesce(strlen(text), 0)) as double) as size from documents group by source),
        whole as (select sum(size) as total, sum(case when size > 0 then size ** 0.5 end) as weights from sizes),
        rates as (
            select source, case when size > 0 then total * 1.0 * (size ** 0.5 / weights) / size else 0.0 end as rate
            from sizes, whole),
        cumulative(source, rate, n, p, c) as (
            select source, rate, 0, exp(-rate), exp(-rate) from rates
            union all
            select source, rate, n + 1, p * rate / (n + 1), c + p * rate / (n + 1) from cumulative
            where n < ceil(rate + 12 * sqrt(rate) + 40)),
        drawn as (
            select d.*, cast(cast('0x' || substr(md5('42:0:' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) as double)
                / 4503599627370496.0 as u
            from documents d),
        counts as (
            select d.doc_id, d.text, d.lang, d.source, d.n_chars, count(c.n) as k
            from drawn d join cumulative c on d.source is not distinct from c.source and c.c <= d.u
            group by all)
        select doc_id, text, lang, source, n_chars, cast(copy as integer) as copy,
            cast('0x' || substr(md5('42:' || coalesce(cast(doc_id as varchar), '') || ':' || copy || ':order'), 1, 15) as bigint) as shuffle_key
        from (select *, unnest(range(1, k + 1)) as copy from counts)""",
    "op12_collocations": r"""
        with pieces as (
            select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
            from documents),
        words as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
        totals as (select lang, cast(sum(len(w)) as bigint) as n from words group by lang),
        counts as materialized (
            select lang, m, phrase, count(*) as f
            from (select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as phrase
                from words, (select unnest(range(1, 6)) as m))
            group by all having count(*) >= 100),
        inner_phrases as (
            select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, max(f) as f
            from (select c.lang, c.f, c.m, string_split(phrase, ' ') as w, k, unnest(range(1, m - k + 2)) as i
                from (select *, unnest(range(2, m)) as k from counts where m >= 3) c)
            group by all),
        kept as (
            select c.lang, c.phrase, c.m, c.f as a, string_split(c.phrase, ' ') as w
            from counts c left join inner_phrases i on c.lang = i.lang and c.phrase = i.phrase and i.f >= c.f
            where c.m >= 2 and i.phrase is null),
        cuts as (
            select lang, phrase, a, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:], ' ') as tail
            from (select *, unnest(range(1, m)) as k from kept)),
        scored as (
            select u.lang, u.phrase, u.a, u.k, h.f as l, t.f as r, n,
                cast(cast(1000 as hugeint) * a * n // (cast(h.f as hugeint) * t.f) as bigint) as score
            from cuts u join counts h on h.lang = u.lang and h.phrase = u.head join counts t on t.lang = u.lang and t.phrase = u.tail
                join totals s on s.lang = u.lang),
        lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
        select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
        from lowest qualify rank <= 2000""",
    "op13_secrets": _secrets_sql(),
}
