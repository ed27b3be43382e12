"""Queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm import lm, mixing, packing, pii, quality, repair, simhash, substrings, tokenfiles, toxicity, vptree, warc, whitening
from presswork.llm.sql import ORACLES
from presswork.shared import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Neighbours of a query, and the relaxation of pruning.
NEIGHBOURS, FACTOR = 20, 1.05


def op1_vantage_point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vptree.nearest(rows, rows.where("vec_id % 20 = 0"), NEIGHBOURS, FACTOR, vptree.shards_for(rows))


def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.detect(rows, pii.fit(rows), drop=("text",))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))
    base_failed = ~quality.passes("base-1")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & quality.passes("strict-1")).alias("kept"), "rule_bits",
    )


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"), keep_payload=False)
    return rows.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def warc_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is salvaged of the pages' archives when two records of ten are damaged, and the log of the gaps."""
    path = shared_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, False, warc.damaged).select("kind", "page_id", "record_type", "length", "reason")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the strict policy rejects, alone and beside others, by the ledger's bits."""
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",)), "strict-1")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column("ids")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sums], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokenfiles.round_trip(table(spark, sf_dir, "documents")).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_relative_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"))


#: Components of whitened vectors.
COMPONENTS = 8


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows, COMPONENTS)
    made = whitening.whiten(rows, model).select("vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    explained = F.element_at(F.array(*(F.lit(float(e)) for e in (model.explained if model else [0.0]))), F.col("place") + 1)
    return made.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )


def op12_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lm.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    scores = lm.score(docs, lm.fit(docs))
    return scores.select("doc_id", lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(repair.filled(table(spark, sf_dir, "conversations")))
    return repair.digests(rows, repair.diagnosed_plans(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_vantage_point_neighbours, op2_pii_boosting, op3_quality_rules, op4_warc_salvage, op5_token_files,
        op6_compression_toxicity, op7_best_fit_packing, op8_relative_parsing, op9_simhash_near_dedup, op10_poisson_mixing, warc_damaged, quality_ablations,
        op11_whitening, op12_bilinear_scores, op13_conversation_repair,
    )
}
