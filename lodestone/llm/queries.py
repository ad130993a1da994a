"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chroma import recording_classes
from .common import table
from .licenses import scan_licenses
from .linededup import dedup_lines
from .mixing import mix_sources
from .packing import pack_documents
from .prefix_tokens import count_tokens
from .probminhash import near_classes
from .quality import PHRASES, judge_documents
from .sharding import shard_documents
from .urlfilter import Rule, judge_urls

#: Longest first is not needed: the operator orders them.
URL_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: Domains of advertising, gambling, spam and adult pages.
LISTED_DOMAINS = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix by weights 5, 2, 1 takes of every document."""
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), columns=["doc_id"])
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"),
    )


def op3_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in eight shards whose counts differ by one at most."""
    placed = shard_documents(table(spark, sf_dir, "documents"), shards=8, epsilon=0.0, columns=["doc_id"])
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    judged = judge_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines", "bad_words"]
    return judged.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in own])


def op4_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies: five-word shingles, similarity 0.8 or more."""
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def op5_chroma_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, played as a recording, with its class of aligned recordings."""
    return recording_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated runs of 50 words or more, and the places of the lines that went."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    listed = spark.createDataFrame([(x,) for x in LISTED_DOMAINS], "key string")
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, listed)
    return judged.select(
        "page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"),
        F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"),
    )


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in sequences of 512 to 4,096 words."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    scanned = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select(
        "doc_id", F.size("license_hits").alias("n_hits"), F.array_sort(F.array_distinct("license_hits.license")).alias("licenses"), "license_hits",
    )


def op10_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and how much of it fits into 4,096."""
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model"), limit=4096).drop("text")


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_line_quality": op2_line_quality,
    "op3_ring_shards": op3_ring_shards,
    "op4_prob_minhash": op4_prob_minhash,
    "op5_chroma_classes": op5_chroma_classes,
    "op6_line_runs": op6_line_runs,
    "op7_url_filter": op7_url_filter,
    "op8_best_fit": op8_best_fit,
    "op9_license_scan": op9_license_scan,
    "op10_prefix_tokens": op10_prefix_tokens,
}

def _listed_sql() -> str:
    return ", ".join(f"'{x}'" for x in LISTED_DOMAINS)


#: The six blanks and the word pattern in SQL.
BLANKS_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


ORACLES: dict[str, str] = {
    "op6_line_runs": rf"""
        with split as (
            select doc_id, text, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
        worded as (
            select doc_id, pos, trim(x, {BLANKS_SQL}) as line, len({WORDS_SQL.format("x")}) as n from split where len({WORDS_SQL.format("x")}) > 0),
        placed as (
            select *, row_number() over (partition by doc_id order by pos) as i, sum(n) over (partition by doc_id order by pos) as e from worded),
        spans as (
            select p.doc_id, p.i as first, min(q.i) as last from placed p join placed q on p.doc_id = q.doc_id and q.i between p.i and p.i + 49 and q.e - (p.e - p.n) >= 50 group by 1, 2
            union
            select p.doc_id, max(q.i), p.i from placed p join placed q on p.doc_id = q.doc_id and q.i between p.i - 49 and p.i and p.e - (q.e - q.n) >= 50 group by p.doc_id, p.i),
        content as (
            select s.doc_id, first, last, string_agg(line, chr(10) order by p.i) as body from spans s join placed p on p.doc_id = s.doc_id and p.i between first and last group by 1, 2, 3),
        ranked as (select *, row_number() over (partition by body order by doc_id, first) as k from content),
        gone as (select distinct p.doc_id, p.pos from ranked r join placed p on p.doc_id = r.doc_id and p.i between first and last where k > 1),
        lists as (select doc_id, list(pos::integer order by pos) as gone_lines from gone group by 1),
        totals as (select doc_id, count(*) as n from worded group by 1),
        rest as (select s.doc_id, string_agg(x, chr(10) order by s.pos) as t from split s anti join gone g on s.doc_id = g.doc_id and s.pos = g.pos group by 1)
        select d.doc_id, case when gone_lines is null then d.text else coalesce(t, '') end as text, coalesce(n, 0)::integer as lines_total,
            coalesce(len(gone_lines), 0)::integer as lines_gone, coalesce(gone_lines, []::integer[]) as gone_lines
        from documents d left join lists using (doc_id) left join totals using (doc_id) left join rest using (doc_id)""",
    "op2_line_quality": rf"""
        with words as (
            select doc_id, unnest({WORDS_SQL.format("text")}) as w, generate_subscripts({WORDS_SQL.format("text")}, 1) as i from documents),
        grams as (
            select doc_id, i, count(*) over (partition by doc_id, w, w2, w3, w4, w5) as n from (
                select *, lead(w) over o as w2, lead(w, 2) over o as w3, lead(w, 3) over o as w4, lead(w, 4) over o as w5 from words window o as (partition by doc_id order by i))
            where w5 is not null),
        repeated as (select doc_id, count(distinct i + k) as n_repeat_words from grams, (select unnest([0, 1, 2, 3, 4]) as k) where n > 1 group by 1),
        base as (
            select doc_id, count(*) as n_words, sum(length(w)) as word_chars from words group by 1),
        split as (
            select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
        lines as (
            select *, {WORDS_SQL.format("x")} as ws, row_number() over (partition by doc_id, x order by pos) as copy from split where len({WORDS_SQL.format("x")}) > 0),
        judged as (
            select doc_id, copy, len(ws) as n,
                len(regexp_extract_all(x, '[|»›•·→]')) >= 2
                or 100 * len(regexp_extract_all(x, '[#*$%&|<>]')) > 10 * length(array_to_string(ws, ''))
                or len(ws) >= 4 and (
                    len(list_filter(ws, lambda w: regexp_matches(w, '[.!?…。！？:;]["''”’»)\]]*$'))) = 0
                    or len(regexp_extract_all(x, '\p{{L}}')) > 0 and 100 * len(regexp_extract_all(x, '\p{{Lu}}')) > 80 * len(regexp_extract_all(x, '\p{{L}}')))
                or len(ws) <= 12 and regexp_matches(lower(x), '{"|".join(PHRASES)}') as bad
            from lines),
        by_doc as (
            select doc_id, count(*) as n_lines, count(*) filter (copy > 1) as n_dup_lines, count(*) filter (bad) as n_bad_lines, coalesce(sum(n) filter (bad), 0) as bad_words
            from judged group by 1),
        whole as (
            select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
                coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0)::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
                coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_bad_lines, 0)::bigint as n_bad_lines,
                coalesce(bad_words, 0)::bigint as bad_words
            from documents left join base using (doc_id) left join repeated using (doc_id) left join by_doc using (doc_id))
        select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
            not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * bad_words <= 30 * n_words as kept
        from whole""",
    "op7_url_filter": rf"""
        with parts as (
            select page_id,
                coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
            from pages),
        ruled as (
            select *, case
                when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
                when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
                when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
                when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
                when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/'
                end as rule,
                list_has_any([array_to_string(list_slice(string_split(host, '.'), -k, -1), '.') for k in [1, 2, 3]], [{_listed_sql()}]) as listed
            from parts)
        select page_id, host, path, rule, case
            when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
            when listed then 'block' else 'allow' end as verdict
        from ruled""",
}
