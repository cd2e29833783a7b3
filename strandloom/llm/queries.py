"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses
from .common import read_table
from .decontaminate import flag as flag_leaks
from .html_text import main_texts
from .neardup import near_duplicates
from .packing import pack
from .pii import pseudonymise
from .token_files import encode_and_read_back
from .topk import top_k
from .toxicity import classify as classify_toxicity
from .warc import archive_and_read_back


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read_table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read_back(read_table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=2)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), k=10, query_filter=F.col("vec_id") % 100 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read_back(read_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_html_extraction": op2_html_extraction,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_files": op4_token_files,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_toxicity": op7_toxicity,
    "op8_license_scan": op8_license_scan,
    "op9_pii_pseudonyms": op9_pii_pseudonyms,
    "op10_warc_index": op10_warc_index,
}


def _license_sql() -> str:
    """Every template at every place of every document: no index, no rarest words."""
    entries = [(phrase, label, True, (phrase,)) for phrase, label in licenses.BASE] + [(template, label, False, keys) for template, label, keys in licenses.TEMPLATES]
    postings = []
    for i, (template, label, exact, keys) in enumerate(entries):
        words = template.split()
        spans = [range(at, at + len(key)) for key in map(str.split, keys) for at in range(len(words)) if words[at : at + len(key)] == key]
        postings += [f"({i}, '{label}', {exact}, {len(words)}, {place}, '{word}', {any(place in span for span in spans)})" for place, word in enumerate(words)]
    return rf"""
        with postings(template, label, exact, size, place, word, is_key) as (values {", ".join(postings)}),
        keyed as (select template, count(*) as n_keys from postings where is_key group by 1),
        d as (
            select row_number() over () as row, doc_id,
                regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
            from documents),
        w as (select row, unnest(words) as word, unnest(range(len(words))) as spot from d),
        met as (
            select row, template, label, exact, spot - place as start, count(distinct place) / any_value(size) as share, count(distinct place) filter (where is_key) as n_keys
            from w join postings using (word) group by 1, 2, 3, 4, 5),
        matches as (select met.* from met join keyed using (template) where case when exact then share = 1 else share >= {licenses.COVERAGE} and met.n_keys = keyed.n_keys end),
        per as (
            select row, count(*) filter (where exact) as n_base, min(start) filter (where exact) as first_word, max(start) filter (where exact) as last_word,
                list_sort(list(distinct label) filter (where exact)) as base_labels, list_sort(list(distinct label)) as labels, max(share) as score
            from matches group by 1)
        select d.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, first_word, last_word,
            coalesce(array_to_string(base_labels, ','), '') as base_labels, coalesce(array_to_string(labels, ','), '') as labels, cast(coalesce(score, 0) as double) as score
        from d left join per using (row)"""


ORACLES: dict[str, str] = {
    "op8_license_scan": _license_sql(),
    "op5_minhash_near_dedup": r"""
        with recursive w as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
            from documents),
        s as (
            select doc_id, case when len(words) = 0 then [] when len(words) = 1 then [words[1]]
                else list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) end as shingles
            from w),
        u as (select doc_id, len(shingles) as n, unnest(shingles) as shingle from s),
        c as (
            select a.doc_id as x, b.doc_id as y
            from u a join u b on a.shingle = b.shingle and a.doc_id <> b.doc_id
            group by a.doc_id, b.doc_id, a.n, b.n
            having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        r as (select doc_id as x, doc_id as y from documents union select r.x, c.y from r join c on r.y = c.x),
        m as (select x, min(y) as component_id from r group by x)
        select s.doc_id, cast(len(s.shingles) as bigint) as n_shingles, m.component_id, s.doc_id = m.component_id as kept
        from s join m on m.x = s.doc_id""",
    "op6_exact_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as code
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.code, c.code), lambda x: x[1] * x[2])) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id
            where q.vec_id % 100 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 10""",
    "op10_warc_index": """
        with p as (
            select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
            from pages),
        f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
        select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
            case when payload_bytes >= 100 and first_id < page_id then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= 100 and first_id < page_id then first_id end as refers_to
        from f""",
}
