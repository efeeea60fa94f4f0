"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from passagelake.llm import cross_parsing, decontamination, hard_negatives, html_text, licenses, sentence_pieces
from passagelake.llm import simhash, suffix_tree, token_alignment, token_files, url_filters, warc
from passagelake.llm import weighted_sampling
from passagelake.llm.common import crc32_remainder, read_table

QUERIES = {}
ORACLES = {}


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file, by the name that the installed package knows."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


@query()
def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded: doc_id, token_ids, n_tokens, n_byte_tokens, ids_crc32, round_trip, decoded."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = sentence_pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"), keep_decoded=True)
    return encoded.drop("text")


@query()
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


@query()
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query()
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.label_documents(*licenses.scan(read_table(spark, sf_dir, "documents")))


@query()
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, overlap, cosine, first_word."""
    docs, items = read_table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contaminations(docs, items).drop("row_id")


@query()
def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = suffix_tree.held_out()
    scored = suffix_tree.score(docs, docs.where(~held))
    return scored.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT >> {shift}) & 31)::INT, 1)"
    for i in range(8)
    for shift in (15, 10, 5, 0)
)


@query(f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
    SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest,
      CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN page_id > first_id THEN first_id END AS refers_to FROM f""")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(read_table(spark, sf_dir, "pages"))
    read = warc.read_archives(spark, folder, keep_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op8_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.compare_with_next(read_table(spark, sf_dir, "documents"))


@query()
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_token_files(
        read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), added_tokens=True
    )
    return token_files.read_token_files(spark, folder)


@query()
def op10_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = cross_parsing.train(cross_parsing.training_rows(docs))
    found = cross_parsing.identify(docs, model)
    return found.select("doc_id", (crc32_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("""WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
      CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM r AS a JOIN r AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id,
      positive_score, score AS negative_score
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
      AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
    QUALIFY row_number() OVER w <= 10""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives.mine(rows, F.col("id") % 100 == 0, label=label)


#: The rules that the pages' urls are judged by.
URL_RULES = [
    url_filters.Rule.parse("org/", url_filters.ALLOW),
    url_filters.Rule.parse("example.org/es/", url_filters.BLOCK),
    url_filters.Rule.parse("example.org/en/1", url_filters.BLOCK),
    url_filters.Rule.parse("com/fr/", url_filters.ALLOW),
    url_filters.Rule.parse("com/de/", url_filters.BLOCK),
]


@query()
def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = url_filters.train(url_filters.labelled_by_rules(pages, URL_RULES))
    return url_filters.judge(pages, URL_RULES, model)


@query()
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, at the top of the repository."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if top not in sys.path:
        sys.path.insert(0, top)
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
