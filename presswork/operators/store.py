"""Stored tables that are merged into by key, in buckets, of which a merge rewrites those only that change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.shared import written

#: Buckets of a stored table.
BUCKETS = 64
STAMPS = ("created_at", "updated_at")


def _bucket(key: str, buckets: int) -> F.Column:
    return F.expr(f"cast(pmod(xxhash64(`{key}`), {buckets}) as int)").alias("bucket")


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``(run, bucket, inserted, updated)`` of what merges have written, by run."""
    return spark.read.schema("run string, bucket int, inserted long, updated long").parquet(f"{path}-commits")


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table without its buckets; ``schema`` is that of what is merged into it."""
    stamps = [T.StructField(s, T.TimestampType()) for s in STAMPS]
    whole = T.StructType([f for f in schema.fields if f.name not in STAMPS] + stamps + [T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(whole).parquet(path)


def merge_into(path: str, new: DataFrame, key: str, at: str, run: str, schema: T.StructType | None = None, owner: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Merge rows by ``key`` into the table at ``path``: values that aren't null replace stored ones, rows of new keys are added,
    none is deleted. Returns what was written, ``(bucket, inserted, updated)``.

    ``created_at`` is set on rows that are added and ``updated_at`` on these and on rows that a value changes in, to ``at``. Of the
    table, buckets of the rows' keys (or of ``owner``, a column that holds several keys) are read, and those are rewritten,
    by dynamic partition overwriting, in which a row is added or changed; the others keep their files. ``run`` names the merge
    in the log of commits, which is written last: a merge that was cut off is run again, and one that is run twice changes
    nothing. Keys of ``new`` are distinct; of repeated rows one is taken. ``schema``: the table's, where ``new`` has not all
    its columns.
    """
    spark, owner = new.sparkSession, owner or key
    names = [f.name for f in (schema or new.schema).fields]
    rows = written(new.dropDuplicates([key]).withColumn("bucket", _bucket(owner, buckets)), "merge-rows")
    hit = [r.bucket for r in rows.select("bucket").distinct().collect()]  # as many as buckets at most
    try:
        old = stored(spark, path, schema or new.schema).where(F.col("bucket").isin(hit))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = spark.createDataFrame([], T.StructType([*(schema or new.schema).fields, *(T.StructField(s, T.TimestampType()) for s in STAMPS), T.StructField("bucket", T.IntegerType())]))
    a, b = old.withColumn("known", F.lit(True)).alias("a"), rows.withColumn("given", F.lit(True)).alias("b")
    given = [c for c in names if c in rows.columns and c != key]
    changed = " or ".join(f"(b.`{c}` is not null and not (a.`{c}` <=> b.`{c}`))" for c in given) or "false"
    met = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").withColumn("inserted", F.expr("a.known is null")).withColumn("updated", F.expr(f"a.known and coalesce(b.given, false) and ({changed})"))
    stamp = F.lit(at).cast("timestamp")
    columns = [F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in rows.columns else F.col(f"a.{c}").alias(c) for c in names]
    merged = met.select(
        *columns, F.when(F.col("inserted"), stamp).otherwise(F.col("a.created_at")).alias("created_at"), F.when(F.col("inserted") | F.col("updated"), stamp).otherwise(F.col("a.updated_at")).alias("updated_at"),
        F.coalesce("a.bucket", "b.bucket").alias("bucket"), "inserted", "updated",
    )
    merged = written(merged, "merged")
    done = written(merged.groupBy("bucket").agg(F.count_if("inserted").alias("inserted"), F.count_if("updated").alias("updated")).where("inserted + updated > 0"), "merge-counts")
    fresh = merged.join(done.select("bucket"), "bucket", "left_semi").select(*names, *STAMPS, "bucket")
    fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    done.select(F.lit(run).alias("run"), "bucket", "inserted", "updated").write.mode("append").parquet(f"{path}-commits")
    return done


def merge_sources(path: str, sources: DataFrame, at: str, run: str, buckets: int = BUCKETS) -> DataFrame:
    """Add children ``(article_id, url, ...)`` that a stored story doesn't have by their address; others stay as they are."""
    keyed = sources.withColumn("source_id", F.concat(F.col("article_id").cast("string"), F.lit(" "), "url"))
    held = keyed.schema
    once = keyed.dropDuplicates(["source_id"])
    try:
        known = stored(sources.sparkSession, path, held).select("source_id")
        once = once.join(known, "source_id", "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return merge_into(path, once, "source_id", at, run, held, "article_id", buckets)
