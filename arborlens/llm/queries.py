"""The operators over their whole tables, with production parameters, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, chat, chunks, decontaminate, lines, packing, repair, sentences, simhash, suffixes, toxicity, warc
from .common import documents


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likenesses."""
    return chunks.edited_likeness(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every whole text, learnt from the labels that are not held out."""
    d = toxicity.score(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return d.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, duplicates as revisits, and read back."""
    return warc.archive_round_trip(_pages(spark, sf_dir))


def op4_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of every whole text and the components of those within 4 bits."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the sentences of repeated runs."""
    d = sentences.drop_repeated_spans(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", "text", F.col("_n_sentences").alias("n_sentences"), F.col("_n_removed").alias("n_removed"))


def op6_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's token ids packed into windows of 4096 at the sources' shares."""
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    d = blocks.main_text(_pages(spark, sf_dir).select("page_id", "url", "html"))
    return d.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op8_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without its host's boilerplate lines."""
    d = lines.drop_boilerplate(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return d.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item found in it, with the similarity of the best window."""
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes of strings of 200 bytes that start elsewhere too."""
    d = suffixes.drop_repeated(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged by rule, then repaired by the cheapest edits."""
    return repair.damaged_and_repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


def op12_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as examples of one trainable reply each, read back from their texts."""
    return chat.digests(chat.examples(chat.with_probe(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


QUERIES = {f.__name__: f for f in (op1_chunk_fingerprints, op2_toxicity, op3_warc_revisits, op4_simhash_pigeonring, op5_sentence_spans, op6_mixture_packing, op7_main_text, op8_site_lines, op9_decontaminate, op10_suffix_dedup, op11_structure_repair, op12_prefix_targets)}

ORACLES = {
    "op3_warc_revisits": """
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    CASE WHEN r IS NULL OR r = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN r IS NULL OR r = page_id THEN NULL ELSE r END AS refers_to
FROM (SELECT *, CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 THEN max(page_id) OVER (PARTITION BY coalesce(html, '')) END AS r FROM pages)
""",
    "op8_site_lines": "WITH " + lines.SQL_KEPT.format(docs="documents", ratio=lines.RATIO, min_pages=lines.MIN_PAGES) + """
SELECT doc_id, array_to_string(kept_lines, chr(10)) AS text, CAST(coalesce(len(all_lines), 0) AS BIGINT) AS n_lines,
    CAST(coalesce(len(all_lines) - len(kept_lines), 0) AS BIGINT) AS n_dropped FROM _kept
""",
    "op5_sentence_spans": sentences.SQL_CUT,
    "op9_decontaminate": decontaminate.SQL_FOUND,
    "op10_suffix_dedup": suffixes.SQL_CUT,
    "op11_structure_repair": repair.SQL_REPAIRED,
    "op12_prefix_targets": chat.SQL_DIGESTS,
}
