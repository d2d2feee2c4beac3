"""One query per training-data operator, each over its whole table."""

from __future__ import annotations

from . import archives, htmltext, langid, lattice, linededup, media, merkle, mixing, neardup, packing, quality, sketches
from .common import documents, pages


def op3_media_columns(spark, sf_dir):
    return media.sound_fingerprints(documents(spark, sf_dir))


def op5_best_fit_packing(spark, sf_dir):
    return packing.pack(spark, packing.token_pieces(documents(spark, sf_dir)))


def op6_language_id(spark, sf_dir):
    return langid.identify(spark, documents(spark, sf_dir))


def op9_lm_scoring(spark, sf_dir):
    return lattice.score_texts(spark, documents(spark, sf_dir))


def op4_html_extraction(spark, sf_dir):
    return htmltext.main_text(pages(spark, sf_dir))


def op2_warc(spark, sf_dir):
    return archives.archive(spark, pages(spark, sf_dir)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op1_mixing(spark, sf_dir):
    return mixing.mix(spark, documents(spark, sf_dir)).select("doc_id", "source", "lang", "topic", "n_tokens", "prob")


def op7_document_fingerprints(spark, sf_dir):
    return sketches.fingerprints(spark, documents(spark, sf_dir))


def op8_line_dedup(spark, sf_dir):
    return linededup.dedup_lines(spark, documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_exact", "n_near")


def op10_minhash_near_dedup(spark, sf_dir):
    return neardup.classes(spark, documents(spark, sf_dir))


def op11_merkle_manifest(spark, sf_dir):
    return merkle.manifest(spark, documents(spark, sf_dir))


def op12_quality_classifier(spark, sf_dir):
    return quality.classify(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op1_mixing": op1_mixing,
    "op2_warc": op2_warc,
    "op4_html_extraction": op4_html_extraction,
    "op3_media_columns": op3_media_columns,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_language_id": op6_language_id,
    "op9_lm_scoring": op9_lm_scoring,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_quality_classifier": op12_quality_classifier,
}
OP2_SQL = """
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), last AS (
  SELECT digest, max(page_id) AS last_page FROM p WHERE n >= 1000 GROUP BY digest
)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last_page THEN last_page END AS refers_to
FROM p LEFT JOIN last ON p.digest = last.digest
"""

ORACLES: dict[str, str] = {"op1_mixing": mixing.oracle_sql(), "op2_warc": OP2_SQL, "op8_line_dedup": linededup.oracle_sql(), "op11_merkle_manifest": merkle.oracle_sql()}
