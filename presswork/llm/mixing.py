"""Mixing of sources to target weights by Poisson replication.

A source's mean repetition rate is its share of the target divided by its share of the corpus. Each document is
repeated by a count that inverts the Poisson distribution of that mean at a number hashed from the seed and the
document's id, so any machine that computes it again gets the same count. A large mean is drawn in equal parts, each at
a hashed number of its own, and their counts are summed, which is a Poisson count of the whole mean. The copies are dealt anew over the cluster
by a hashed key and sorted by it, which shuffles them globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.shared import written

#: Terms of the distribution that are summed, and the mean of one draw at most, where the tail beyond them vanishes.
TERMS, DRAW_MOST = 64, 16.0
#: Hexadecimal digits of the hash that make the uniform number.
DIGITS = 13
#: Up to so many sources (about half a kilobyte each) the means are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def source_means(df: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """``(source, mean)``: the mean repetitions that bring each source to its weight of the characters.

    ``weights`` needn't sum to one and gives no copies to sources that it doesn't name; None weighs all alike. The
    result holds ``epochs`` times the corpus's characters on average. A null source counts as ``''``, a null text as
    empty; a source whose texts are all empty gets the mean ``epochs``.
    """
    sizes = df.groupBy(F.coalesce(F.col(source), F.lit("")).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).alias("size"))
    if weights is not None:
        known = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in (pair[0], float(pair[1]))]) if weights else F.create_map().cast("map<string,double>")
        sizes = sizes.withColumn("weight", F.coalesce(F.try_element_at(known, F.col("source")), F.lit(0.0)))
    else:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    totals = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    exact = F.expr(f"case when size = 0 then {float(epochs)!r}D when all_weight = 0 then 0D else {float(epochs)!r}D * (weight / all_weight) / (cast(size as double) / cast(all_size as double)) end")
    one = F.lit(1).alias("one")
    return sizes.select("*", one).join(totals.select("*", one), "one").select("source", exact.alias("mean"))


def replicate(
    df: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = "mix-1", doc_id: str = "doc_id", source: str = "source", text: str = "text"
) -> DataFrame:
    """All copies of the rows, shuffled: their columns, ``mix_copy`` (from 0) and ``mix_key`` (a hash, the order).

    Rows with one id, repeated rows among them, get one count; a null id counts as ``''``. An empty table stays
    empty. Columns of the table named ``mix_copy`` or ``mix_key`` are replaced. Beyond BROADCAST_SOURCES sources the
    means are joined by a shuffle, in which adaptive execution splits a source that holds much of the rows.
    """
    own = [c for c in df.columns if c.lower() not in ("mix_copy", "mix_key")]
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))

    def uniform(*parts: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts, name)), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)

    counts = (
        source_means(df, weights, epochs, source, text)
        .withColumnRenamed("source", "__source")
        .withColumn("__draws", F.expr(f"greatest(1, cast(ceil(mean / {DRAW_MOST!r}D) as int))"))
        .withColumn("mean", F.expr("mean / __draws"))
        .withColumn("__steps", F.expr(f"""
            aggregate(sequence(1, {TERMS}), struct(array(exp(-mean)) as sums, exp(-mean) as term),
                (s, k) -> struct(concat(s.sums, array(element_at(s.sums, -1) + s.term * mean / k)) as sums, s.term * mean / k as term)).sums"""))
        .select("__source", "__draws", "__steps")
    )
    counts = written(counts, "source-means")
    if counts.count() <= BROADCAST_SOURCES:
        counts = F.broadcast(counts)
    rows = df.select(*own).withColumn("__source", F.coalesce(F.col(source), F.lit("")))
    drawn = rows.join(counts, "__source").withColumn("__u", uniform()).withColumn("__n", F.expr("size(filter(__steps, s -> s <= __u))"))
    others = F.transform(F.sequence(F.lit(1), F.col("__draws") - 1), lambda k: uniform(F.lit("draw"), k.cast("string")))
    summed = F.aggregate(others, F.col("__n"), lambda n, u: n + F.size(F.filter("__steps", lambda s: s <= u)))
    drawn = drawn.withColumn("__n", F.when(F.col("__draws") > 1, summed).otherwise(F.col("__n")))
    copies = drawn.where("__n > 0").select(*own, F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("mix_copy"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col("mix_copy").cast("string")))
    keyed = copies.withColumn("mix_key", key)
    return keyed.repartition(F.col("mix_key")).sortWithinPartitions("mix_key")
