"""Facts of sentences, and their comparison between sources."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.functions import rules as R
from presswork.functions.dialect import Dialect


def money(d: Dialect, x: str) -> dict[str, str]:
    """Value and currency of an amount; units need a word boundary before them."""
    low = f"lower({d.replace(x, ',')})"
    number = d.number(d.extract(low, r"(\d+(?:\.\d+)?)"))

    def unit(word: str, short: str) -> str:
        return f"(contains({low}, '{word}') or {d.matches(low, rf'\b{short}\b')})"

    factor = (
        f"case when {unit('billion', 'b')} then {d.double('1000000000.0')} when {unit('million', 'm')} then {d.double('1000000.0')} "
        f"when {unit('crore', 'cr')} then {d.double('10000000.0')} when {unit('lakh', 'l')} then {d.double('100000.0')} "
        f"when {d.matches(low, r'\bk\b')} then {d.double('1000.0')} else {d.double('1.0')} end"
    )
    return {"num_value": f"{number} * ({factor})", "currency": f"case when {number} is null then null when {d.has(low, ('$', 'usd', 'dollar'))} then 'USD' else 'INR' end"}


def percentage(d: Dialect, x: str) -> str:
    return d.number(d.extract(x, r"(\d+(?:\.\d+)?)"))


def rules(d: Dialect) -> list[tuple[str, str, str, str, str, str, float]]:
    """Of each rule: condition, fact type, original, number, text, currency, confidence, over ``low`` (a sentence)."""
    original = d.extract("low", R.CURRENCY)
    paid = money(d, original)
    none = "cast(null as string)"
    out = [(d.has("low", words), d.lit(name), original, paid["num_value"], none, paid["currency"], confidence) for name, confidence, words in R.MONEY_FACTS]
    out.append((f"(contains(low, 'ipo') and {d.has('low', R.IPO_SIZE)})", "'ipo_size'", original, paid["num_value"], none, paid["currency"], 0.90))
    band = r"(?:rs|₹|inr)?\s*(\d+)\s*(?:to|-)\s*(?:rs|₹|inr)?\s*(\d+)"
    ends = [d.extract("low", band, g) for g in (1, 2)]
    out.append((d.has("low", R.PRICE_BAND), "'ipo_price_band'", d.extract("low", band, 0), "cast(null as double)", f"concat({ends[0]}, '.0-', {ends[1]}, '.0')", none, 0.95))
    percent = d.extract("low", r"(\d+(?:\.\d+)?\s*(?:%|percent))")
    moved = f"{percentage(d, percent)} * case when {d.has('low', R.STOCK_DOWN)} then {d.double('-1.0')} else {d.double('1.0')} end"
    out.append((f"({d.has('low', R.STOCK_NOUNS)} and {d.has('low', R.STOCK_VERBS)})", "'stock_movement'", percent, moved, none, none, 0.85))
    times = d.extract("low", r"\b(\d+(?:\.\d+)?\s*(?:times|x))\b")
    out.append((d.has("low", R.SUBSCRIPTION), "'subscription_number'", times, percentage(d, times), none, none, 0.95))
    kind = f"case when {d.has('low', ('profit', 'net income'))} then 'profit' when contains(low, 'loss') then 'loss' else 'revenue' end"
    out.append((d.has("low", R.RESULTS), kind, original, paid["num_value"], none, paid["currency"], 0.90))
    return out


def sentences(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """``keys, pos, sentence``: trimmed non-empty sentences, ended by a stop and a blank."""
    split = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"([.!?])\s+", "$1\u0001"), "\u0001")
    return df.select(*keys, F.posexplode(split).alias("pos", "sentence")).withColumn("sentence", F.trim("sentence")).where("sentence <> ''")


def extract_facts(parts: DataFrame, *keys: str) -> DataFrame:
    """Facts of sentences, each rule's first match; a value that a text has repeated is kept once, the first."""
    from presswork.functions.dialect import SPARK

    rows = parts.withColumn("low", F.lower("sentence"))
    found = [
        F.expr(
            f"case when {condition} and {original} <> '' then named_struct('rule', {i}, 'fact_type', {kind}, 'original_value', {original}, 'num_value', {number}, "
            f"'text_value', {text}, 'currency', {currency}, 'confidence', {confidence}D, 'context', substr(sentence, 1, 250)) end"
        )
        for i, (condition, kind, original, number, text, currency, confidence) in enumerate(rules(SPARK))
    ]
    facts = rows.select(*keys, "pos", F.explode(F.array_compact(F.array(*found))).alias("f")).select(*keys, "pos", "f.*")
    order = W.partitionBy(*keys, "fact_type", "num_value", "text_value", "currency").orderBy("pos", "rule")
    return facts.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def mismatch(a: str, b: str) -> str:
    """SQL: two values of a fact type that don't agree, numbers by five hundredths, others exactly."""
    numbers = f"{a}.num_value is not null and {b}.num_value is not null"
    top = f"greatest({a}.num_value, {b}.num_value)"
    return f"case when {numbers} then {top} > 0 and abs({a}.num_value - {b}.num_value) / {top} > 0.05 else coalesce({a}.text_value, cast({a}.num_value as string)) <> coalesce({b}.text_value, cast({b}.num_value as string)) end"


TOLERANCE = 0.05


def _beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group, how many pairs of numbers are apart by more than TOLERANCE of the larger one, from rows ``(group, num_value, n)``
    sorted by group and number. Numbers pass in rising order; those still near the present one are held, the others only
    counted."""
    group, near, far, pairs, kind = None, deque(), 0, 0, None
    for batch in batches:
        kind, out = batch.schema.field("group").type, []
        for key, value, n in zip(*(c.to_pylist() for c in batch.columns)):
            if key != group:
                if pairs:
                    out.append((group, pairs))
                group, near, far, pairs = key, deque(), 0, 0
            while near and value > 0 and (value - near[0][0]) / value > TOLERANCE:
                far += near.popleft()[1]
            pairs += far * n
            near.append((value, n))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], kind), pa.array([n for _, n in out], pa.int64())], ["group", "n"])
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array([group], kind), pa.array([pairs], pa.int64())], ["group", "n"])


def _unlike(facts: DataFrame, *keys: str) -> DataFrame:
    """``(group, n)``: how many pairs of facts with the same keys don't agree; ``group`` is a struct of the keys."""
    group = F.struct(*keys).alias("group")
    text = F.coalesce("text_value", F.col("num_value").cast("string"))
    counted = facts.groupBy(group, "num_value", text.alias("s")).agg(F.count("*").alias("c"))
    number = F.col("num_value").isNotNull()
    values = counted.where(number).groupBy("group", F.col("num_value").cast("double").alias("num_value")).agg(F.sum("c").alias("n"))
    schema = f"group {counted.schema['group'].dataType.simpleString()}, n long"
    numbers = values.repartition("group").sortWithinPartitions("group", "num_value").mapInArrow(_beyond, schema)
    texts = counted.where("s is not null").groupBy("group", "s").agg(F.coalesce(F.sum(F.when(number, F.col("c"))), F.lit(0)).alias("m"), F.coalesce(F.sum(F.when(~number, F.col("c"))), F.lit(0)).alias("t"))
    sums = texts.groupBy("group").agg(F.sum("t").alias("t"), F.sum("m").alias("m"), F.sum(F.expr("t * t")).alias("tt"), F.sum(F.expr("m * t")).alias("mt"))
    return numbers.unionByName(sums.select("group", F.expr("cast((t * t - tt) div 2 + m * t - mt as bigint)").alias("n")))


def conflict_counts(facts: DataFrame) -> DataFrame:
    """``(report_id, fact_type, n, severity)``: how many pairs of facts of a report and type don't agree (see mismatch), where any do.

    No pair is made. Facts of one value are counted first; numbers are compared in a sorted sweep, texts by the counts of equal ones, a
    number with a text by the counts of those that read alike. A value that is missing agrees with all. Facts of one ``pos`` are one
    statement and aren't compared, so what is counted among these is taken off.
    """
    several = facts.groupBy("report_id", "fact_type", "pos").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    same = facts.join(several, ["report_id", "fact_type", "pos"], "left_semi")
    found = _unlike(facts, "report_id", "fact_type").select("group.report_id", "group.fact_type", "n")
    found = found.unionByName(_unlike(same, "report_id", "fact_type", "pos").select("group.report_id", "group.fact_type", (-F.col("n")).alias("n")))
    severity = F.when(F.col("fact_type").isin(*R.HIGH_SEVERITY), "HIGH").otherwise("MEDIUM")
    return found.groupBy("report_id", "fact_type").agg(F.sum("n").alias("n")).where("n > 0").withColumn("severity", severity)


def fact_conflicts(facts: DataFrame) -> DataFrame:
    """One row for each two facts of a report and type that don't agree, the earlier one first. Only facts of groups that have
    such pairs meet; their number is that of the rows asked for, or near it (see conflict_counts for the numbers alone)."""
    disputed = conflict_counts(facts).select("report_id", "fact_type")
    facts = facts.join(disputed, ["report_id", "fact_type"], "left_semi")
    a, b = facts.alias("a"), facts.alias("b")
    pairs = a.join(b, F.expr("a.report_id = b.report_id and a.fact_type = b.fact_type and a.pos < b.pos")).where(mismatch("a", "b"))
    severity = F.when(F.col("a.fact_type").isin(*R.HIGH_SEVERITY), "HIGH").otherwise("MEDIUM")
    return pairs.select("a.report_id", "a.fact_type", F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), F.col("a.source_id").alias("source_a"), F.col("b.source_id").alias("source_b"), severity.alias("severity"), F.lit("OPEN").alias("status"))


def consensus(facts: DataFrame, counts: DataFrame) -> DataFrame:
    """One fact alone as it is; of facts that agree the first, with full confidence; of facts in conflict all. ``counts``: see
    conflict_counts."""
    group = W.partitionBy("report_id", "fact_type")
    ranked = facts.withColumn("n", F.count("*").over(group)).withColumn("rank", F.row_number().over(group.orderBy("pos")))
    disputed = counts.select("report_id", "fact_type", F.lit(True).alias("disputed"))
    joined = ranked.join(disputed, ["report_id", "fact_type"], "left").where("n = 1 or disputed or rank = 1")
    return joined.select("report_id", "fact_type", "pos", F.expr("if(n > 1 and disputed is null, 1D, confidence)").alias("confidence"))


def confirmed(facts: DataFrame, counts: DataFrame) -> DataFrame:
    """Numeric facts whose type isn't disputed in their report."""
    return facts.where(F.col("fact_type").isin(*R.NUMERIC_FACTS)).join(counts.select("report_id", "fact_type"), ["report_id", "fact_type"], "left_anti")


def research_confidence(sources: DataFrame, facts: DataFrame, counts: DataFrame) -> DataFrame:
    """``(report_id, confidence, status)`` from the sources' priorities, the facts and the numbers of open conflicts."""
    official = F.bool_or(F.lower("source_name").rlike("|".join(R.OFFICIAL)))
    s = sources.groupBy("report_id").agg(F.sum("priority").alias("sum"), F.count("*").alias("n"), official.alias("official"))
    f = facts.groupBy("report_id").agg(F.count("*").alias("facts"))
    c = counts.groupBy("report_id").agg(F.sum(F.when(F.col("severity") == "HIGH", F.col("n")).otherwise(0)).alias("high"), F.sum(F.when(F.col("severity") != "HIGH", F.col("n")).otherwise(0)).alias("other"))
    joined = s.join(f, "report_id", "left").join(c, "report_id", "left").na.fill(0, ["facts", "high", "other"])
    return joined.select("report_id", F.expr(f"cast({CONFIDENCE.format(even='rint')} as int)").alias("confidence"), F.expr("if(high > 0, 'NEEDS_REVIEW', 'COMPLETED')").alias("status"))


CONFIDENCE = (
    "least(greatest({even}(sum / cast(n as double) / 100 * 30 + case when n = 1 then 10 when n = 2 then 20 else 30 end + case when official then 15 else 0 end"
    " + case when facts >= 3 then 15 when facts > 0 then 8 else 0 end + case when facts > 0 then 10 else 0 end - 25 * high - 10 * other), 0), 100)"
)


def impact(first_type: Column, first_value: Column, event_type: Column) -> Column:
    """Direction of the first decisive fact, else of the event type."""
    return (
        F.when(first_type == "stock_movement", F.when(first_value >= 0, "positive").otherwise("negative"))
        .when(first_type.isin("profit", "revenue"), "positive")
        .when(first_type == "loss", "negative")
        .when(event_type.isin(*R.NEGATIVE_EVENTS), "negative")
        .when(event_type.isin(*R.POSITIVE_EVENTS), "positive")
        .otherwise("neutral")
    )
