"""The queries of this subpackage, by name, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, fill_middle, html_text, mixture, near_dups, piece_counts, quality, repeats, token_store, warc, whitening

END_ID = 2


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_output(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.piece_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = mixture.mixture_copies(table(spark, sf_dir, "documents"))
    return copies.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.page_captures(table(spark, sf_dir, "pages")))
    shown = ("etag", "last-modified", "date", "content-type", "server")
    return found.select("record_id", "url_key", "ts", "outcome", "response_id", "response_ts", *(F.element_at("headers", h).alias(h.replace("-", "_")) for h in shown))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= quality.KEEP_AT, 1).otherwise(0).alias("predicted"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_chats(table(spark, sf_dir, "conversations"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    chars = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    hashes = [F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return cut.select("doc_id", "n", "form", *chars, *hashes)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = white.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("k", "whitened"), "explained", "identity_error")
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("k")).alias("explained"), "identity_error")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_mixture": op6_mixture,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_quality": op8_quality,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_html_extraction": op10_html_extraction,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_whitening": op12_whitening,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {"op7_warc_revisits": warc.ORACLE, "op9_chat_formatting": chat.ORACLE, "op11_fill_in_middle": fill_middle.ORACLE}
