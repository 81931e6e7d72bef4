"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscope.llm import language, licenses, quality, warc
from bucketscope.llm.common import table
from bucketscope.llm.exact_dedup import exact_duplicates
from bucketscope.llm.jaccard import near_duplicates
from bucketscope.llm.mixing import mix
from bucketscope.llm.neighbours import nearest_neighbours
from bucketscope.llm.packing import pack_documents
from bucketscope.llm.pseudonyms import pseudonymise
from bucketscope.llm.resampling import importance_ranks
from bucketscope.llm.sharding import digest_columns, shuffle_to_shards
from bucketscope.llm.whitening import whiten
from bucketscope.session import scratch


def tokenizer_file() -> str:
    """The public byte-level vocabulary, at the same path on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: A real job passes a secret of its own; this one makes the query repeatable.
PSEUDONYM_KEY = "bucketscope"

Query = Callable[[SparkSession, str], DataFrame]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = table(spark, sf_dir, "documents").select(*digest_columns("doc_id", "text"))
    placed = shuffle_to_shards(digests, shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.held_out(F.col("doc_id"))
    found = language.identify(docs, docs.where(language.learnable(F.col("doc_id"), out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return found.select("doc_id", "text", "n_replaced")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranks.select("doc_id", "n_features", "weight", "score", "rank")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archive")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payloads=False).select(
        F.col("source_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_sharding, op2_neighbours, op3_licenses, op4_quality, op5_ngram_jaccard, op6_language,
        op7_packing, op8_pii, op9_exact_dedup, op10_mixing, op11_importance, op12_warc, op13_whitening,
    )
}

ORACLES: dict[str, str] = {
    "op9_exact_dedup": r"""
        with texts as (
            select doc_id, coalesce(text, '') as text,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm
            from documents
        ), grouped as (
            select doc_id, norm,
                   first_value(doc_id) over (partition by norm order by length(text) desc, doc_id) as keep_id,
                   count(*) over (partition by norm) as group_size
            from texts
        )
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from grouped
    """,
    # CRC-32 over the bytes of each distinct word; its table of 256 entries follows from the polynomial
    "op11_importance": r"""
        with recursive steps as (
            select i as entry, i::ubigint as value, 0 as step from range(256) t(i)
            union all
            select entry, case when value & 1 = 1 then xor(value >> 1, 3988292384::ubigint) else value >> 1 end, step + 1
            from steps where step < 8
        ), crc_table as (
            select list(value order by entry) as entries from steps where step = 8
        ), words as (
            select doc_id, text_of, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word
            from (select doc_id, 'd' as text_of, text from documents union all select null, 'b', text from benchmark)
        ), spelt as (
            select word, hex(encode(word)) as digits from (select distinct word from words)
        ), hashed as (
            select word, xor(4294967295::ubigint, list_reduce(
                list_prepend(4294967295::ubigint,
                    list_transform(range(0, length(digits), 2), lambda i: ('0x' || substr(digits, i::int + 1, 2))::ubigint)),
                lambda crc, byte: xor(crc >> 8, entries[(xor(crc, byte) & 255)::int + 1]))) % 10000 as bucket
            from spelt, crc_table
        ), counts as (
            select bucket, sum((text_of = 'd')::int) as s, sum((text_of = 'b')::int) as t from words join hashed using (word) group by 1
        ), totals as (
            select sum(s)::double as s_all, sum(t)::double as t_all from counts
        ), gains as (
            select bucket, floor(1000 * ln((t + 1)::double * (s_all + 10000) / ((s + 1)::double * (t_all + 10000))))::bigint as gain
            from counts, totals
        ), weights as (
            select doc_id, count(*) as n, sum(gain)::bigint as weight
            from words join hashed using (word) join gains using (bucket) where text_of = 'd' group by 1
        ), scored as (
            select d.doc_id, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
                coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln(
                    (('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::ubigint::double + 0.5) / 4294967296)))::bigint as score
            from documents d left join weights w on w.doc_id = d.doc_id
        ), drawn as (
            select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () * 10 // 100 as most
            from scored where n_features >= 20
        )
        select s.doc_id, n_features, weight, score, case when place <= most then place end as rank
        from scored s left join drawn d on d.doc_id = s.doc_id
    """,
    "op12_warc": r"""
        with payloads as (
            select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as digest,
                min(page_id) over (partition by coalesce(html, '')) as first_id
            from pages
        )
        select page_id, octet_length(encode(html))::bigint as payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(digest, (i // 4 * 5)::int + 1, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int + 1, 1)), '') as payload_digest,
            case when page_id = first_id then 'response' else 'revisit' end as record_type,
            case when page_id <> first_id then first_id end as refers_to
        from payloads
    """,
}
