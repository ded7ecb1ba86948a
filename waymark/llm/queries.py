"""One query an operator, over whole tables with production parameters, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from waymark.llm import exact_dedup, fingerprint, licenses, main_text, near_dedup, packing, pii, quality, sentence_pieces, token_files
from waymark.llm._common import new_path, read_table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(read_table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(read_table(spark, sf_dir, "documents"), threshold=0.8).drop("digest")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    files = token_files.write_files(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_files(files, folder)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(read_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trips(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.find_personal(docs, pii.train(docs))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents")).select("doc_id", "n_licenses", "licenses")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(read_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_fingerprints, op3_near_dedup, op4_token_files, op5_exact_dedup, op6_sentencepiece, op7_pii, op8_quality, op9_licenses, op10_main_text)
}


def _license_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted(licenses.TEMPLATES.items()))
    runs = "list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])"
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    return f"""
        WITH t AS (SELECT name, {runs} AS runs FROM (SELECT name, {words} AS w FROM (VALUES {rows}) AS v(name, text))),
             d AS (SELECT doc_id, {runs} AS runs FROM (SELECT doc_id, {words} AS w FROM documents)),
             m AS (SELECT doc_id, list(name ORDER BY name) AS names FROM d, t
                   WHERE len(list_intersect(t.runs, d.runs)) >= 0.8 * len(t.runs) GROUP BY doc_id)
        SELECT doc_id, coalesce(len(names), 0) AS n_licenses, coalesce(array_to_string(names, ','), '') AS licenses
        FROM documents LEFT JOIN m USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op9_licenses": _license_sql(),
}
