"""Queries of the news engine over whole tables, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions import rules as R
from presswork.functions.dialect import DUCK, SPARK, Dialect
from presswork.operators import dedup, events, facts, feed, lexicon, posts, reconcile, shapes, similar, store
from presswork.operators import reports as reports_text
from presswork.plans import stories as plan
from presswork.plans.stories import ARTICLES_SQL
from presswork.shared import columns_of, shared_path, written
from presswork.sources import feeds, pages
from presswork.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Derived columns of every story, by operator; arrays are joined so that engines compare alike.
PROJECTIONS: dict[str, tuple[str, ...]] = {
    "normalize_url": ("clean_url",),
    "clean_text": ("plain_title",),
    "remove_stopwords": ("no_stopwords",),
    "content_hash": ("content_hash",),
    "financial_amount": ("amount",),
    "source_tier": ("tier",),
    "source_score": ("source_score",),
    "research_priority": ("research_priority",),
    "priority_band": ("priority_band",),
    "story_badge": ("badge",),
    "classify_category": ("category",),
    "secondary_tags": ("secondary_tags",),
    "event_type": ("event_type",),
    "content_type": ("content_type",),
    "hard_news_anchor": ("hard_news_anchor",),
    "major_catalyst": ("major_catalyst",),
    "content_penalty": ("content_penalty",),
    "detect_noise": ("is_noise", "noise_penalty", "noise_reasons"),
    "india_relevance": ("india_relevance",),
    "relevance_multiplier": ("relevance_multiplier",),
    "freshness_bonus": ("freshness_bonus",),
    "is_ongoing": ("ongoing",),
    "staleness_multiplier": ("staleness_multiplier",),
    "entities_regulators": ("regulators",),
    "entities_companies_lexicon": ("lexicon_companies",),
    "entities_companies_verb": ("verb_companies",),
    "filter_non_company": ("companies",),
    "entities_people": ("people",),
    "entities_sectors": ("sectors",),
    "entities_countries": ("countries",),
    "real_companies": ("real_companies",),
    "main_company": ("main_company",),
    "main_country": ("main_country",),
    "score_market_impact": ("market_impact",),
    "score_financial": ("financial_significance",),
    "score_novelty": ("novelty",),
    "score_audience": ("audience_interest",),
    "score_discussion": ("discussion_potential",),
    "score_importance": ("importance_score",),
    "score_postability": ("postability_score",),
    "score_confidence": ("confidence_score",),
    "score_final": ("final_score",),
    "key_reason": ("key_reason",),
    "score_breakdown": (
        "market_impact", "financial_significance", "novelty", "audience_interest", "discussion_potential", "source_confidence_sub",
        "india_relevance", "relevance_multiplier", "tier", "source_score", "freshness_bonus", "noise_penalty", "noise_reasons",
        "content_type", "content_penalty", "staleness_multiplier", "key_reason", "rating_market_relevance",
        "rating_financial_materiality", "rating_india_relevance", "rating_source_quality", "rating_investor_relevance",
    ),
}
ARRAYS = {"secondary_tags", "noise_reasons", "regulators", "lexicon_companies", "verb_companies", "companies", "people", "sectors", "countries", "real_companies"}


def column(d: Dialect, name: str) -> str:
    return f"{d.join(name, '|')} as {name}" if name in ARRAYS else name


def _projection(names: tuple[str, ...]) -> Query:
    return lambda spark, sf_dir: plan.stories(spark, sf_dir).selectExpr("article_id", *(column(SPARK, n) for n in names))


for _name, _columns in PROJECTIONS.items():
    register(_name, _projection(_columns), f"select article_id, {', '.join(column(DUCK, n) for n in _columns)} from ({plan.stories_sql()})")


#: Addresses by another way: parameters one by one, in rows.
_ADDRESS_SQL = f"""with a as (select article_id, split_part(article_url, '#', 1) as whole from ({ARTICLES_SQL})),
    p as (select article_id, split_part(whole, '?', 1) as head, string_split(split_part(whole, '?', 2), '&') as pairs from a),
    q as (select article_id, place, pairs[place] as pair from (select *, unnest(range(1, len(pairs) + 1)) as place from p)),
    k as (select article_id, place, url_decode(replace(regexp_extract(pair, '^([^=]*)=', 1), '+', ' ')) as name, url_decode(replace(regexp_extract(pair, '^[^=]*=(.*)$', 1), '+', ' ')) as value from q where position('=' in pair) > 0),
    g as (select article_id, string_agg(replace(url_encode(name), '%20', '+') || '=' || replace(url_encode(value), '%20', '+'), '&' order by place) as query from k
        where value <> '' and left(lower(name), 4) <> 'utm_' and lower(name) not in ({", ".join(DUCK.lit(t) for t in R.TRACKING)}) group by 1)
    select article_id, lower(regexp_extract(head, '^[a-zA-Z]+://[^/]*')) || case when length(regexp_replace(head, '^[a-zA-Z]+://[^/]*', '')) > 1 then rtrim(regexp_replace(head, '^[a-zA-Z]+://[^/]*', ''), '/') else regexp_replace(head, '^[a-zA-Z]+://[^/]*', '') end
        || coalesce('?' || query, '') as clean_url from p left join g using (article_id)"""
ORACLES["normalize_url"] = _ADDRESS_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked feed of processed stories: the ten best ready for review."""
    rows = _slim(spark, sf_dir, "title", "category", "event_type", "main_company", "final_score", "published_at", "status")
    return rows.where("status = 'READY_FOR_REVIEW'").drop("status").orderBy(F.desc("final_score"), F.desc("published_at"), "article_id").limit(10)


# --- deduplication ---

STORIES_SQL = plan.stories_sql()


_STORED: dict[tuple, str] = {}
#: What only serves to find other columns and isn't stored.
_SCRATCH = ("raw", "low_title", "low_text", "url_host", "url_path", "url_query")


def _stamp(spark: SparkSession, path: str) -> tuple:
    """What tells a table's files from others': their number, bytes, latest time, and a checksum of these by file."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return tuple(files.agg(F.count("*"), F.sum("length"), F.max("modificationTime"), F.expr("bit_xor(xxhash64(path, length, modificationTime))")).first())


def _slim(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the stored stories: an application processes an input once and keeps it as a table, until the input's files
    change. What follows filters and joins on derived columns, which would otherwise be spelled out again in every predicate
    that is pushed down; of the table only the asked columns are read."""
    key = (spark.sparkContext.applicationId, sf_dir, *_stamp(spark, f"{sf_dir}/orders.parquet"))
    if key not in _STORED:
        path = shared_path(spark, "stories")
        plan.stories(spark, sf_dir).drop(*_SCRATCH).write.option("compression", "zstd").parquet(path)
        _STORED[key] = path
    return columns_of(spark, _STORED[key], *dict.fromkeys(("article_id", *columns)))


def _founders(key: str) -> Query:
    return lambda spark, sf_dir: dedup.first_of(_slim(spark, sf_dir, "published_at", key), key)


def _founders_sql(key: str) -> str:
    return f"""with s as (select article_id, first_value(article_id) over (partition by {key} order by published_at, article_id) as founder_id
        from ({STORIES_SQL}) where {key} <> '') select * from s where article_id <> founder_id"""


register("dedup_url", _founders("clean_url"), _founders_sql("clean_url"))
register("dedup_hash", _founders("content_hash"), _founders_sql("content_hash"))
#: Addresses as they came in, which differ where the normal ones are equal.
_RAW = "concat(article_url, '#s', cast(article_id % 11 as string))"
register("append_sources", lambda spark, sf_dir: appended(spark, sf_dir), f"""
    with f as ({_founders_sql("clean_url")}), a as (select article_id, {_RAW} as source_url from ({ARTICLES_SQL}))
    select distinct f.founder_id as article_id, a.source_url from f join a using (article_id)
    where (f.founder_id, a.source_url) not in (select article_id, source_url from a)""")  # fmt: skip
register("company_conflict", lambda spark, sf_dir: conflicting(spark, sf_dir), f"""
    with f as ({_founders_sql("clean_url")}), s as (select article_id, real_companies from ({STORIES_SQL}))
    select f.article_id, f.founder_id, (len(a.real_companies) > 0 and len(b.real_companies) > 0 and not list_has_any(a.real_companies, b.real_companies)) as conflict
    from f join s a using (article_id) join s b on b.article_id = f.founder_id""")  # fmt: skip
register("recent_pool", lambda spark, sf_dir: plan.articles(spark, sf_dir).where(f"published_at >= {plan.STAMP} - interval '7' day").orderBy(F.desc("published_at"), "article_id").limit(dedup.POOL_ROWS).select("article_id", "published_at"),
    f"select article_id, published_at from ({ARTICLES_SQL}) where published_at >= {plan.STAMP} - interval '7' day order by published_at desc, article_id limit {dedup.POOL_ROWS}")
register("dedup_event", lambda spark, sf_dir: dedup.event_links(_slim(spark, sf_dir, "published_at", "event_type", "real_companies")), f"""
    with e as (select article_id, published_at, event_type, unnest(real_companies) as company from ({STORIES_SQL})
        where event_type in ({", ".join(DUCK.lit(x) for x in R.CLUSTERABLE)})),
    p as (select article_id, published_at, lag({{'t': published_at, 'i': article_id}}) over (partition by event_type, company order by published_at, article_id) as b from e),
    n as (select article_id, max(b) as b from p where b is not null and epoch(published_at) - epoch(b.t) <= 7 * 86400 group by article_id)
    select article_id, b.i as earlier_id from n""")  # fmt: skip
register("title_similarity", lambda spark, sf_dir: shapes.similar_classes(_slim(spark, sf_dir, "published_at", "plain_title")))
register("dedup_similar", lambda spark, sf_dir: dedup.similar_links(_slim(spark, sf_dir, "published_at", "plain_title", "real_companies")))
register("find_duplicates", lambda spark, sf_dir: dedup.find_duplicates(_slim(spark, sf_dir, "published_at", "plain_title", "real_companies", "clean_url", "content_hash", "event_type")))


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that duplicates by address add to their founders."""
    articles = plan.articles(spark, sf_dir).selectExpr("article_id", f"{_RAW} as source_url")
    new = QUERIES["dedup_url"](spark, sf_dir).join(articles, "article_id").select(F.col("founder_id").alias("article_id"), "source_url")
    return new.distinct().join(articles, ["article_id", "source_url"], "left_anti")


def conflicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an article and its founder by address name different companies."""
    stories = _slim(spark, sf_dir, "published_at", "clean_url", "real_companies")
    found = dedup.first_of(stories, "clean_url")
    own = stories.selectExpr("article_id", "real_companies as own")
    other = stories.selectExpr("article_id as founder_id", "real_companies as other")
    return found.join(own, "article_id").join(other, "founder_id").selectExpr("article_id", "founder_id", f"{dedup.conflicts('own', 'other')} as conflict")


def primaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary of every cluster of exact duplicates."""
    stories = _slim(spark, sf_dir, "published_at", "clean_url", "content_hash", "tier", "source_count")
    return dedup.choose_primary(dedup.exact_clusters(stories).join(stories, "article_id"))


# --- feed ---

_SHOWN = "article_id, title, category, final_score, published_at"


def _feed(**filters) -> Query:
    return lambda spark, sf_dir: feed.feed(_slim(spark, sf_dir, "title", "category", "final_score", "published_at", "status", "source_count"), **filters).select("article_id", "title", "category", "final_score", "published_at")


register("feed", _feed(), f"select {_SHOWN} from ({STORIES_SQL}) where status not in ('REJECTED', 'FILTERED', 'MERGED') order by final_score desc, published_at desc, article_id limit 100")
register("feed_category_page", _feed(status="any", category="IPO", offset=50, limit=50), f"select {_SHOWN} from ({STORIES_SQL}) where category = 'IPO' order by final_score desc, published_at desc, article_id limit 50 offset 50")
register("feed_newest_medium", _feed(priority="medium", sort="newest"), f"select {_SHOWN} from ({STORIES_SQL}) where status = 'READY_FOR_REVIEW' and final_score >= 40 and final_score < 75 order by published_at desc, article_id limit 100")


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of every founding story: its own article and those that share its address."""
    founders = QUERIES["dedup_url"](spark, sf_dir)
    counts = founders.groupBy(F.col("founder_id").alias("article_id")).agg((F.count("*") + 1).alias("source_count"))
    own = plan.articles(spark, sf_dir).select("article_id").join(founders, "article_id", "left_anti")
    return own.join(counts, "article_id", "left").select("article_id", F.coalesce("source_count", F.lit(1)).cast("long").alias("source_count"))


register("source_counts", source_counts, f"""with f as ({_founders_sql("clean_url")}), a as ({ARTICLES_SQL})
    select a.article_id, coalesce(n, 0) + 1 as source_count from a left join (select founder_id, count(*) as n from f group by 1) c on c.founder_id = a.article_id
    where a.article_id not in (select article_id from f)""")  # fmt: skip
register("feed_stats", lambda spark, sf_dir: feed.feed_stats(_slim(spark, sf_dir, "status", "final_score"), plan.articles(spark, sf_dir)), f"""
    select count(*) as total_articles, count(*) filter (status not in ('REJECTED', 'MERGED')) as unique_events,
    count(*) filter (status = 'READY_FOR_REVIEW' and final_score >= 75) as high_priority,
    count(*) filter (status = 'READY_FOR_REVIEW' and final_score >= 40 and final_score < 75) as medium_priority,
    count(*) filter (status = 'REJECTED') as rejected from ({STORIES_SQL})""")  # fmt: skip
#: A single pass over a few columns, without any filter on them: worked out as it is read, as to store all columns of all stories costs more.
register("process_new", lambda spark, sf_dir: plan.stories(spark, sf_dir).select("status", "is_noise", "noise_penalty").groupBy("status").agg(F.count("*").alias("n"), F.count_if("is_noise").alias("n_noise"), F.count_if(F.col("noise_penalty") > 0).alias("n_penalized")),
    f"select status, count(*) as n, count(*) filter (is_noise) as n_noise, count(*) filter (noise_penalty > 0) as n_penalized from ({STORIES_SQL}) group by 1")
#: Reports that exist: of every third order; their states by the order's key.
_REPORTS = {"article_id": "o_orderkey", "status": "case o_orderkey % 4 when 0 then 'COMPLETED' when 1 then 'FAILED' when 2 then 'RESEARCHING' else 'QUEUED' end"}


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").selectExpr(*(f"{e} as {n}" for n, e in _REPORTS.items()))


register("research_queue", lambda spark, sf_dir: feed.research_queue(_slim(spark, sf_dir, "status", "importance_score", "postability_score", "final_score", "published_at"), reports(spark, sf_dir), 200).select("article_id", "importance_score", "postability_score", "final_score"), f"""
    select article_id, importance_score, postability_score, final_score from ({STORIES_SQL}) where status in ('NEW', 'READY_FOR_REVIEW', 'APPROVED')
    and (importance_score >= 70 or postability_score >= 75)
    and article_id not in (select o_orderkey from orders where o_orderkey % 3 = 0 and o_orderkey % 4 in (0, 2)) order by final_score desc, published_at desc, article_id limit 200""")  # fmt: skip
_ACTIONS = "user_id as article_id, ts, event_id, case event_type when 'purchase' then 'APPROVED' else 'REJECTED' end as new_status"
register("apply_story_actions", lambda spark, sf_dir: feed.apply_actions(_slim(spark, sf_dir, "status"), table(spark, sf_dir, "events").where("event_type in ('purchase', 'error')").selectExpr(*_ACTIONS.split(", "))), f"""
    with a as (select {_ACTIONS} from events where event_type in ('purchase', 'error')),
    l as (select article_id, max({{'t': ts, 'e': event_id, 's': new_status}}).s as s from a group by 1)
    select article_id, coalesce(l.s, status) as status from (select article_id, status from ({STORIES_SQL})) left join l using (article_id)""")  # fmt: skip


def collection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source and in all: articles fetched, founding ones, merged ones."""
    merged = QUERIES["dedup_url"](spark, sf_dir).select("article_id", F.lit(True).alias("merged"))
    rows = plan.articles(spark, sf_dir).select("article_id", "source_name").join(merged, "article_id", "left")
    counts = rows.rollup("source_name").agg(F.count("*").alias("fetched"), F.count_if(F.col("merged").isNull()).alias("new"), F.count_if("merged").alias("merged"))
    return counts.withColumn("source_name", F.coalesce("source_name", F.lit("TOTAL")))


register("collection_summary", collection_summary, f"""with f as ({_founders_sql("clean_url")}), a as (select source_name, article_id in (select article_id from f) as merged from ({ARTICLES_SQL}))
    select coalesce(source_name, 'TOTAL') as source_name, count(*) as fetched, count(*) filter (not merged) as new, count(*) filter (merged) as merged from a group by rollup(source_name)""")  # fmt: skip


def explode_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each entity of a story."""
    kinds = ("companies", "people", "sectors", "countries", "regulators")
    pairs = F.array(*(F.struct(F.lit(k).alias("bucket"), F.col(k).alias("names")) for k in kinds))
    return plan.stories(spark, sf_dir).select("article_id", F.explode(pairs).alias("p")).select("article_id", "p.bucket", F.explode("p.names").alias("name"))


register("explode_entities", explode_entities, " union all ".join(f"select article_id, '{k}' as bucket, unnest({k}) as name from ({STORIES_SQL})" for k in ("companies", "people", "sectors", "countries", "regulators")))

# --- facts ---

_SENTENCES_SQL = "select doc_id, trim(s) as sentence from (select doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) as s from documents) where trim(s) <> ''"
register("split_sentences", lambda spark, sf_dir: facts.sentences(table(spark, sf_dir, "documents"), "text", "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars")),
    f"select doc_id, count(*) as n, cast(sum(length(sentence)) as bigint) as chars from ({_SENTENCES_SQL}) group by 1")
register("pct_count", lambda spark, sf_dir: plan.articles(spark, sf_dir).selectExpr("article_id", f"{SPARK.count('title', R.PERCENT)} as n"), f"select article_id, {DUCK.count('title', R.PERCENT)} as n from ({ARTICLES_SQL})")
register("keyword_hit", lambda spark, sf_dir: plan.articles(spark, sf_dir).selectExpr("article_id", f"{SPARK.hit('lower(title)', R.AUDIENCE_2)} as hit"), f"select article_id, {DUCK.hit('lower(title)', R.AUDIENCE_2)} as hit from ({ARTICLES_SQL})")


def _money(d: Dialect) -> str:
    return ", ".join(f"{e} as {n}" for n, e in facts.money(d, "title").items())


register("parse_monetary", lambda spark, sf_dir: plan.articles(spark, sf_dir).selectExpr("article_id", *(f"{e} as {n}" for n, e in facts.money(SPARK, "title").items())), f"select article_id, {_money(DUCK)} from ({ARTICLES_SQL})")
register("parse_percentage", lambda spark, sf_dir: plan.articles(spark, sf_dir).selectExpr("article_id", f"{facts.percentage(SPARK, 'title')} as value"), f"select article_id, {facts.percentage(DUCK, 'title')} as value from ({ARTICLES_SQL})")


def _facts_of(articles: DataFrame) -> DataFrame:
    texts = articles.selectExpr("article_id", "concat(title, '. ', summary) as text")
    return facts.extract_facts(facts.sentences(texts, "text", "article_id"), "article_id")


def story_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every headline and summary."""
    return _facts_of(plan.articles(spark, sf_dir))


def _texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One story of each distinct title and summary: the one of the least id, by which the text goes. What only the text decides is
    found for it, and given to the others by ``_of_stories``."""
    return _slim(spark, sf_dir, "text_id", *columns).where("article_id = text_id").drop("text_id")


def _of_stories(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows of texts, whose ``article_id`` is the text's, for every story of the text."""
    return _slim(spark, sf_dir, "text_id").join(rows.withColumnRenamed("article_id", "text_id"), "text_id").drop("text_id")


def _facts_sql() -> str:
    rows = " union all ".join(
        f"select article_id, pos, {i} as rule, {kind} as fact_type, {original} as original_value, {number} as num_value, {text} as text_value, {currency} as currency, {confidence}::double as confidence, substr(sentence, 1, 250) as context from p where {condition} and {original} <> ''"
        for i, (condition, kind, original, number, text, currency, confidence) in enumerate(facts.rules(DUCK))
    )
    return f"""with a as (select article_id, string_split(regexp_replace(concat(title, '. ', summary), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as s from ({ARTICLES_SQL})),
        q as (select article_id, unnest(s) as sentence, unnest(range(0, len(s))) as pos from a), p as (select article_id, pos, trim(sentence) as sentence, lower(trim(sentence)) as low from q where trim(sentence) <> ''),
        f as ({rows}) select * exclude (n) from (select *, row_number() over (partition by article_id, fact_type, num_value, text_value, currency order by pos, rule) as n from f) where n = 1"""


_FACT = ("article_id", "fact_type", "original_value", "num_value", "text_value", "currency", "confidence", "context")
register("extract_facts", lambda spark, sf_dir: story_facts(spark, sf_dir).select(*_FACT), f"select {', '.join(_FACT)} from ({_facts_sql()})")
register("dedup_facts", lambda spark, sf_dir: story_facts(spark, sf_dir).groupBy("fact_type").agg(F.count("*").alias("n"), F.countDistinct("num_value").alias("n_values")), f"select fact_type, count(*) as n, count(distinct num_value) as n_values from ({_facts_sql()}) group by 1")
register("fact_confidence_pct", lambda spark, sf_dir: story_facts(spark, sf_dir).selectExpr("article_id", "fact_type", "cast(confidence * 100 as int) as pct").groupBy("fact_type", "pct").agg(F.count("*").alias("n")), f"select fact_type, cast(trunc(confidence * 100) as int) as pct, count(*) as n from ({_facts_sql()}) group by 1, 2")

#: Facts that order lines stand for: an order is a report, a supplier a source, a price a value.
_LINE_FACTS = {
    "report_id": "l_orderkey", "pos": "l_linenumber", "source_id": "l_suppkey",
    "fact_type": "case l_linenumber % 3 when 0 then 'funding_amount' when 1 then 'stock_movement' else 'ipo_price_band' end",
    "num_value": "case when l_linenumber % 3 < 2 then l_extendedprice end",
    "text_value": "case when l_linenumber % 3 = 2 then cast(cast(l_quantity as int) % 3 as string) end",
    "confidence": "case when l_linenumber % 2 = 0 then cast(0.9 as double) else cast(0.85 as double) end",
}
_LINE_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in _LINE_FACTS.items()) + " from lineitem"


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} as {n}" for n, e in _LINE_FACTS.items()))


def line_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct suppliers of an order as the sources of its report."""
    names = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as source_id", "case s_nationkey % 3 when 0 then 'Official filing' when 1 then 'Reuters' else 'Blog' end as source_name", "case s_nationkey % 3 when 0 then 100 when 1 then 85 else 60 end as priority")
    return line_facts(spark, sf_dir).select("report_id", "source_id").distinct().join(names, "source_id")


_MISMATCH_SQL = facts.mismatch("a", "b")
_CONFLICTS_SQL = f"""select a.report_id, a.fact_type, a.pos as pos_a, b.pos as pos_b, a.source_id as source_a, b.source_id as source_b,
    case when a.fact_type in ({", ".join(DUCK.lit(x) for x in R.HIGH_SEVERITY)}) then 'HIGH' else 'MEDIUM' end as severity, 'OPEN' as status
    from ({_LINE_SQL}) a join ({_LINE_SQL}) b on a.report_id = b.report_id and a.fact_type = b.fact_type and a.pos < b.pos where {_MISMATCH_SQL}"""
register("fact_conflicts", lambda spark, sf_dir: facts.fact_conflicts(line_facts(spark, sf_dir)), _CONFLICTS_SQL)
register("open_conflicts", lambda spark, sf_dir: facts.conflict_counts(line_facts(spark, sf_dir)).groupBy("report_id", "severity").agg(F.sum("n").alias("n")), f"select report_id, severity, count(*) as n from ({_CONFLICTS_SQL}) where status = 'OPEN' group by 1, 2")


def consensus_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_facts(spark, sf_dir)
    return facts.consensus(rows, facts.conflict_counts(rows))


register("consensus_facts", consensus_facts, f"""with f as ({_LINE_SQL}), c as (select distinct report_id, fact_type from ({_CONFLICTS_SQL})),
    r as (select f.*, count(*) over (partition by report_id, fact_type) as n, row_number() over (partition by report_id, fact_type order by pos) as rank from f)
    select r.report_id, r.fact_type, r.pos, case when n > 1 and c.report_id is null then 1.0::double else confidence end as confidence
    from r left join c using (report_id, fact_type) where n = 1 or c.report_id is not null or rank = 1""")  # fmt: skip


def report_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_facts(spark, sf_dir)
    return facts.research_confidence(line_sources(spark, sf_dir), rows, facts.conflict_counts(rows))


_CONFIDENCE_SQL = f"""with s as (select distinct l_orderkey as report_id, l_suppkey as source_id from lineitem),
    n as (select s_suppkey as source_id, case s_nationkey % 3 when 0 then 'official filing' when 1 then 'reuters' else 'blog' end as name, case s_nationkey % 3 when 0 then 100 when 1 then 85 else 60 end as priority from supplier),
    g as (select report_id, cast(sum(priority) as bigint) as sum, count(*) as n, bool_or(regexp_matches(name, '{"|".join(R.OFFICIAL)}')) as official from s join n using (source_id) group by 1),
    f as (select l_orderkey as report_id, count(*) as facts from lineitem group by 1),
    c as (select report_id, count(*) filter (severity = 'HIGH') as high, count(*) filter (severity <> 'HIGH') as other from ({_CONFLICTS_SQL}) group by 1),
    j as (select g.*, coalesce(facts, 0) as facts, coalesce(high, 0) as high, coalesce(other, 0) as other from g left join f using (report_id) left join c using (report_id))
    select report_id, cast({facts.CONFIDENCE.format(even="round_even").replace("25 * high - 10 * other)", "25 * high - 10 * other, 0)")} as int) as confidence, case when high > 0 then 'NEEDS_REVIEW' else 'COMPLETED' end as status from j"""
register("research_confidence", lambda spark, sf_dir: report_confidence(spark, sf_dir).select("report_id", "confidence"), f"select report_id, confidence from ({_CONFIDENCE_SQL})")
register("report_status", lambda spark, sf_dir: report_confidence(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n")), f"select status, count(*) as n from ({_CONFIDENCE_SQL}) group by 1")
_LABEL = "case when confidence >= 75 then 'HIGH' when confidence >= 45 then 'MEDIUM' when confidence > 0 then 'LOW' else 'UNCONFIRMED' end"
register("confidence_label", lambda spark, sf_dir: report_confidence(spark, sf_dir).selectExpr("report_id", f"{_LABEL} as label"), f"select report_id, {_LABEL} as label from ({_CONFIDENCE_SQL})")


def _why(d: Dialect) -> str:
    return "case event_type " + " ".join(f"when '{e}' then replace({d.lit(t)}, '{{company}}', coalesce(main_company, 'The entity'))" for e, t in R.WHY.items()) + f" else {d.lit(R.WHY_DEFAULT)} end"


register("why_it_matters", lambda spark, sf_dir: plan.stories(spark, sf_dir).selectExpr("article_id", f"{_why(SPARK)} as why"), f"select article_id, {_why(DUCK)} as why from ({STORIES_SQL})")


def key_numbers(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """Numeric facts of headlines, at reduced confidence."""
    return (found or story_facts(spark, sf_dir)).where(F.col("fact_type").isin(*R.NUMERIC_FACTS)).select("article_id", "fact_type", "num_value", F.least("confidence", F.lit(0.6)).alias("confidence"))


register("key_numbers", key_numbers, f"select article_id, fact_type, num_value, least(confidence, 0.6::double) as confidence from ({_facts_sql()}) where fact_type in ({', '.join(DUCK.lit(x) for x in R.NUMERIC_FACTS)})")
_DECISIVE = "('stock_movement', 'profit', 'revenue', 'loss')"


def market_impact_label(spark: SparkSession, sf_dir: str, stories: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """Direction of every story by its first decisive fact; of given ``stories`` and their facts where these are given."""
    firsts = (found or story_facts(spark, sf_dir)).where(f"fact_type in {_DECISIVE}").groupBy("article_id").agg(F.min(F.struct("pos", "rule", "fact_type", "num_value")).alias("f"))
    rows = (stories or plan.stories(spark, sf_dir)).select("article_id", "event_type").join(firsts, "article_id", "left")
    return rows.select("article_id", facts.impact(F.col("f.fact_type"), F.col("f.num_value"), F.col("event_type")).alias("impact"))


register("market_impact_label", market_impact_label, f"""with f as (select article_id, min({{'p': pos, 'r': rule, 'k': fact_type, 'v': num_value}}) as f from ({_facts_sql()}) where fact_type in {_DECISIVE} group by 1)
    select article_id, case when f.k = 'stock_movement' then case when f.v >= 0 then 'positive' else 'negative' end when f.k in ('profit', 'revenue') then 'positive' when f.k = 'loss' then 'negative'
    when event_type in ({", ".join(DUCK.lit(x) for x in R.NEGATIVE_EVENTS)}) then 'negative' when event_type in ({", ".join(DUCK.lit(x) for x in R.POSITIVE_EVENTS)}) then 'positive' else 'neutral' end as impact
    from (select article_id, event_type from ({STORIES_SQL})) left join f using (article_id)""")  # fmt: skip


def _angles(d: Dialect) -> str:
    lists = " ".join(f"when '{e}' then {d.array(d.lit(a) for a in angles)}" for e, angles in R.ANGLES.items())
    whole = f"case event_type {lists} else {d.array(d.lit(a) for a in R.DEFAULT_ANGLES)} end"
    plain = d.where(whole, "x not in ('number_led', 'data_led')")
    return d.join(f"case when has_facts then {whole} when {d.size(plain)} = 0 then {d.array(d.lit(a) for a in R.DEFAULT_ANGLES)} else {plain} end", "|")


def candidate_angles(spark: SparkSession, sf_dir: str, stories: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """Angles that a story's type and facts allow; of given ``stories`` and their facts where these are given."""
    known = key_numbers(spark, sf_dir, found).select("article_id", F.lit(True).alias("known")).distinct()
    rows = (stories or plan.stories(spark, sf_dir)).select("article_id", "event_type").join(known, "article_id", "left").withColumn("has_facts", F.col("known").isNotNull())
    return rows.selectExpr("article_id", f"{_angles(SPARK)} as angles")


register("candidate_angles", candidate_angles, f"""select article_id, {_angles(DUCK)} as angles from (select article_id, event_type, article_id in
    (select article_id from ({_facts_sql()}) where fact_type in ({", ".join(DUCK.lit(x) for x in R.NUMERIC_FACTS)})) as has_facts from ({STORIES_SQL}))""")  # fmt: skip

def lexicon_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies by the lexicon as a table, through one automaton."""
    names = spark.createDataFrame([(c, c.upper() if c in R.COMPANIES_UPPER else c.title()) for c in R.COMPANIES], "name string, shown string")
    rows = plan.articles(spark, sf_dir).selectExpr("article_id", "lower(concat(title, ' ', coalesce(summary, ''))) as low_text")
    known = f"filter(names, x -> lower(x) not in ({', '.join(SPARK.lit(c) for c in R.NON_COMPANIES)}))"
    return lexicon.tagged(rows, names, "low_text").selectExpr("article_id", f"array_join({known}, '|') as names")


register("lexicon_entities", lexicon_entities, f"select article_id, array_to_string(list_sort(lexicon_companies), '|') as names from ({STORIES_SQL})")

# --- pages and feeds ---

register("extract_article_text", lambda spark, sf_dir: table(spark, sf_dir, "pages").select("page_id", pages.extract_article_text("html").alias("text")))
register("strip_html_summary", lambda spark, sf_dir: table(spark, sf_dir, "pages").select("page_id", F.length(pages.strip_tags("html")).alias("n_chars")))


def ingest_rss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles landed as feed files and read back."""
    path = shared_path(spark, "feed")
    feeds.write_feed(plan.articles(spark, sf_dir), path)
    return feeds.read_feed(spark, path, plan.AS_OF).select("title", "article_url", "published_at", "summary")


register("ingest_rss", ingest_rss, f"select title, article_url, published_at, summary from ({ARTICLES_SQL})")


def stream_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles landed as feed files, taken up as a stream, once by address and title hash."""
    path, kept = shared_path(spark, "feed"), shared_path(spark, "stream-table")
    feeds.write_feed(plan.articles(spark, sf_dir), path)
    ingest.exact_dedup_stream(feeds.read_feed(spark, path, plan.AS_OF, stream=True), kept, shared_path(spark, "stream-checkpoint"))
    return ingest.stored(spark, kept).select("clean_url", "content_hash", "published_at")


register("stream_exact_dedup", stream_exact_dedup)
_TITLED = "concat(title, case o_orderkey % 3 when 0 then ' - Reuters' when 1 then ' - A very long name of a publisher that takes more than fifty characters' else '' end) as title, 'feed' as source_name"
register("split_publisher", lambda spark, sf_dir: feeds.split_publisher(plan.articles(spark, sf_dir).withColumnRenamed("article_id", "o_orderkey").selectExpr("o_orderkey as article_id", *_TITLED.split(", 'feed'")[:1], "'feed' as source_name")), f"""
    with a as (select article_id, {_TITLED.replace("o_orderkey", "article_id")} from ({ARTICLES_SQL})), s as (select *, trim(regexp_extract(title, '(?s)^(.*) - (.*)$', 1)) as h, trim(regexp_extract(title, '(?s)^(.*) - (.*)$', 2)) as p from a)
    select article_id, case when h <> '' and p <> '' and length(p) < 50 then h else title end as title, case when h <> '' and p <> '' and length(p) < 50 then p else source_name end as source_name from s""")  # fmt: skip
register("drop_incomplete", lambda spark, sf_dir: feeds.drop_incomplete(table(spark, sf_dir, "pages").selectExpr("page_id", "regexp_extract(html, '<title>([^<]*)</title>', 1) as title", "url as article_url")).select("page_id"),
    "select page_id from pages where coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') <> '' and coalesce(url, '') <> ''")
register("lookup_stories", lambda spark, sf_dir: _slim(spark, sf_dir, "clean_url").join(table(spark, sf_dir, "customer").selectExpr("c_custkey as article_id"), "article_id"), f"select article_id, clean_url from ({STORIES_SQL}) where article_id in (select c_custkey from customer)")
#: States of stories by the order's; new ones are those of open orders.
_STATE = "case o_orderstatus when 'O' then 'NEW' when 'F' then 'READY_FOR_REVIEW' else 'APPROVED' end"
register("scan_new", lambda spark, sf_dir: feed.scan_new(table(spark, sf_dir, "orders").selectExpr("o_orderkey as article_id", f"{_STATE} as status")).select("article_id"), f"select o_orderkey as article_id from orders where {_STATE} = 'NEW'")
_OLD, _NEW = "o_orderkey as article_id, o_orderstatus as status, o_totalprice as value", "o_orderkey + 100 as article_id, case when o_orderkey % 2 = 0 then 'NEW' end as status"


def upsert_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories stored, then some given anew and some added: the table after the merge, with the times of the last changes."""
    orders, path = table(spark, sf_dir, "orders"), shared_path(spark, "stored-stories")
    old = orders.selectExpr(*_OLD.split(", "))
    store.merge_into(path, old, "article_id", plan.AS_OF, "load")
    new = orders.where("o_orderkey % 5 = 0").selectExpr("o_orderkey + 100 as article_id", "case when o_orderkey % 2 = 0 then 'NEW' end as status")
    store.merge_into(path, new, "article_id", _NEXT_DAY, "merge", old.schema)
    return store.stored(spark, path, old.schema).selectExpr("article_id", "status", "value", "cast(created_at as string) as created_at", "cast(updated_at as string) as updated_at")


_NEXT_DAY = "2001-08-02 00:00:00"
register("upsert_stories", upsert_stories, f"""select coalesce(b.article_id, a.article_id) as article_id, coalesce(b.status, a.status) as status, a.value,
    case when a.article_id is null then '{_NEXT_DAY}' else '{plan.AS_OF}' end as created_at, case when a.article_id is null or (b.status is not null and b.status is distinct from a.status) then '{_NEXT_DAY}' else '{plan.AS_OF}' end as updated_at
    from (select {_OLD} from orders) a full join (select {_NEW} from orders where o_orderkey % 5 = 0) b on a.article_id = b.article_id""")  # fmt: skip
register("replace_report_children", lambda spark, sf_dir: feed.replace_children(line_facts(spark, sf_dir).select("report_id", "pos"), line_facts(spark, sf_dir).where("report_id % 7 = 0 and pos = 1").selectExpr("report_id", "pos + 100 as pos"), "report_id"), f"""
    with f as ({_LINE_SQL}), n as (select report_id, pos + 100 as pos from f where report_id % 7 = 0 and pos = 1)
    select report_id, pos from f where report_id not in (select report_id from n) union all select * from n""")  # fmt: skip
register("report_document", lambda spark, sf_dir: line_facts(spark, sf_dir).groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fact_type"))), lambda f: F.concat(f["pos"].cast("string"), F.lit(":"), f["fact_type"])), ",").alias("facts")),
    f"select report_id, string_agg(cast(pos as varchar) || ':' || fact_type, ',' order by pos, fact_type) as facts from ({_LINE_SQL}) group by 1")
_STAMPS = {
    "text": "case event_id % 5 when 0 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") when 1 then concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+05:30') when 2 then date_format(ts, 'yyyy-MM-dd HH:mm:ss') when 3 then 'no time' end",
    "published": "case event_id % 4 when 0 then date_format(ts, \"EEE, d MMM yyyy HH:mm:ss '+0000'\") when 1 then date_format(ts, \"d MMM yyyy HH:mm:ss '+0530'\") when 2 then date_format(ts, 'yyyy-MM-dd HH:mm:ss') else 'soon' end",
}
register("normalize_timestamps", lambda spark, sf_dir: table(spark, sf_dir, "events").selectExpr("event_id", f"{_STAMPS['text']} as text").select("event_id", feeds.publication_time(F.col("text"), F.lit(None).cast("timestamp")).cast("string").alias("at")),
    "select event_id, case event_id % 5 when 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 1 then strftime(date_trunc('second', ts) - interval '330' minute, '%Y-%m-%d %H:%M:%S') when 2 then strftime(ts, '%Y-%m-%d %H:%M:%S') end as at from events")
register("parse_pub_date", lambda spark, sf_dir: table(spark, sf_dir, "events").selectExpr("event_id", f"{_STAMPS['published']} as text").select("event_id", feeds.publication_time(F.col("text"), F.lit(plan.AS_OF).cast("timestamp")).cast("string").alias("at")),
    f"select event_id, case event_id % 4 when 1 then strftime(date_trunc('second', ts) - interval '330' minute, '%Y-%m-%d %H:%M:%S') when 3 then '{plan.AS_OF}' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as at from events")
_CONTENT = "case when article_id % 4 in (0, 2) then concat('https://img.example.com/c/', article_id) when article_id % 8 = 1 then '' end"
_THUMBNAIL = "case when article_id % 4 in (1, 2) then concat('https://img.example.com/t/', article_id) end"


def image_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of articles landed with media elements."""
    path = shared_path(spark, "media-feed")
    rows = plan.articles(spark, sf_dir).selectExpr("article_id", "cast(article_id as string) as title", "article_url", "published_at", "summary")
    feeds.write_feed(rows.selectExpr("*", f"{_CONTENT} as content_url", f"{_THUMBNAIL} as thumbnail_url").drop("article_id"), path)
    return feeds.read_feed(spark, path, plan.AS_OF).selectExpr("cast(title as bigint) as article_id", "image_url")


register("image_url", image_url, f"select article_id, coalesce(nullif({_CONTENT}, ''), {_THUMBNAIL}) as image_url from ({ARTICLES_SQL})")


def evolve_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows without a column and new ones with it, the column's default in the old ones."""
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderkey % 2 = 0").selectExpr("o_orderkey as id")
    new = orders.where("o_orderkey % 2 = 1").selectExpr("o_orderkey as id", "o_orderpriority as priority")
    return old.unionByName(new, allowMissingColumns=True).na.fill({"priority": "none"})


register("evolve_schema", evolve_schema, "select o_orderkey as id, case when o_orderkey % 2 = 0 then 'none' else o_orderpriority end as priority from orders")


def story_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Founding stories with the articles of their address, joined in order."""
    stories = _slim(spark, sf_dir, "title", "published_at", "clean_url", "source_name")
    firsts = stories.groupBy("clean_url").agg(F.min(F.struct("published_at", "article_id", "title")).alias("f"), F.array_sort(F.collect_list(F.struct("article_id", "source_name"))).alias("s"))
    return firsts.select(F.col("f.article_id").alias("article_id"), F.col("f.title").alias("title"), F.expr("array_join(transform(s, x -> concat(cast(x.article_id as string), ':', x.source_name)), ',')").alias("sources"))


register("story_document", story_document, f"""select min({{'p': published_at, 'i': article_id, 't': title}}).i as article_id, min({{'p': published_at, 'i': article_id, 't': title}}).t as title,
    string_agg(cast(article_id as varchar) || ':' || source_name, ',' order by article_id) as sources from ({STORIES_SQL}) group by clean_url""")  # fmt: skip
_BEST = "tier, published_at, article_id"
register("promote_primary", lambda spark, sf_dir: _slim(spark, sf_dir, "title", "source_name", "published_at", "tier", "content_hash").groupBy("content_hash").agg(F.min(F.struct("published_at", "article_id")).alias("o"), F.min(F.struct("tier", "published_at", "article_id", "source_name")).alias("b")).select(F.col("o.article_id").alias("article_id"), F.col("b.source_name").alias("source_name"), F.col("b.article_id").alias("shown_id")), f"""
    with s as (select * from ({STORIES_SQL})), o as (select content_hash, article_id, row_number() over (partition by content_hash order by published_at, article_id) as n from s),
    b as (select content_hash, source_name, article_id, row_number() over (partition by content_hash order by {_BEST}) as n from s)
    select o.article_id, b.source_name, b.article_id as shown_id from o join b using (content_hash) where o.n = 1 and b.n = 1""")  # fmt: skip


def merge_plan(stories: DataFrame) -> DataFrame:
    """Stories with the primary and the size of their cluster of exact duplicates; null where they have none."""
    clusters = dedup.exact_clusters(stories)
    groups = dedup.choose_primary(clusters.join(stories, "article_id"))
    return stories.join(clusters.join(groups, "cluster_id"), "article_id", "left")


def exact_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan over stories that equal addresses or title hashes connect."""
    return merge_plan(_slim(spark, sf_dir, "published_at", "clean_url", "tier", "source_count", "content_hash", "status"))


def _plan_sql(rounds: int = 12) -> str:
    """Stories with the least id that equal addresses and title hashes lead to, by rounds of minima (far more than these
    tables need), and their cluster's primary and size."""
    sql = f"select article_id, tier, source_count, published_at, status, clean_url, content_hash, article_id as least from ({STORIES_SQL})"
    for _ in range(rounds):
        for key in ("clean_url", "content_hash"):
            sql = f"select * replace (min(least) over (partition by {key}) as least) from ({sql})"
    return f"""select *, first_value(article_id) over (partition by least order by tier, -source_count, published_at, article_id) as primary_id,
        count(*) over (partition by least) as size from ({sql})"""


_PLAN_SQL = _plan_sql()
register("duplicate_clusters", lambda spark, sf_dir: dedup.exact_clusters(_slim(spark, sf_dir, "published_at", "clean_url", "content_hash")), f"select article_id, least as cluster_id from ({_PLAN_SQL}) where size > 1")
register("choose_primary", lambda spark, sf_dir: primaries(spark, sf_dir), f"select least as cluster_id, primary_id, size from ({_PLAN_SQL}) where size > 1 and article_id = primary_id")
register("exact_reconciliation_plan", lambda spark, sf_dir: exact_plan(spark, sf_dir).where("article_id <> primary_id").groupBy("primary_id", "size").agg(F.array_join(F.array_sort(F.collect_list("article_id")), ",").alias("duplicate_ids")), f"""
    select primary_id, size, string_agg(cast(article_id as varchar), ',' order by article_id) as duplicate_ids from ({_PLAN_SQL}) where size > 1 and article_id <> primary_id group by 1, 2""")  # fmt: skip
register("exact_apply_plan", lambda spark, sf_dir: exact_plan(spark, sf_dir).selectExpr("article_id", "if(article_id <> primary_id, 'MERGED', status) as status", "if(article_id <> primary_id, primary_id, null) as merged_into_id").selectExpr("article_id", "status", "coalesce(cast(merged_into_id as string), '') as merged_into_id"), f"""
    select article_id, case when size > 1 and article_id <> primary_id then 'MERGED' else status end as status, case when size > 1 and article_id <> primary_id then cast(primary_id as varchar) else '' end as merged_into_id from ({_PLAN_SQL})""")  # fmt: skip
_NEXT = "2001-08-02 00:00:00"
register("rescore", lambda spark, sf_dir: plan.rescored(_slim(spark, sf_dir, *(c for c in plan.RAW if c != "article_id"), "freshness_bonus", "staleness_multiplier", "final_score"), plan.AS_OF, _NEXT).select("article_id", "freshness_bonus", "staleness_multiplier", "final_score"), f"select article_id, freshness_bonus, staleness_multiplier, final_score from ({plan.stories_sql(_NEXT)})")
register("reprocess", lambda spark, sf_dir: plan.process(plan.articles(spark, sf_dir).join(table(spark, sf_dir, "supplier").selectExpr("s_suppkey * 3 as article_id"), "article_id", "left_semi").withColumn("source_count", F.lit(1)), _NEXT).select("article_id", "final_score"), f"select article_id, final_score from ({plan.stories_sql(_NEXT)}) where article_id in (select s_suppkey * 3 from supplier)")
register("late_articles", lambda spark, sf_dir: plan.articles(spark, sf_dir).selectExpr("article_id", f"published_at < {plan.STAMP} - interval '7' day as late"), f"select article_id, published_at < {plan.STAMP} - interval '7' day as late from ({ARTICLES_SQL})")


def _terms(d: Dialect) -> str:
    start = "concat(split_part(title, ' ', 1), ' ', split_part(title, ' ', 2), ' ', split_part(title, ' ', 3))"
    return f"case when main_company is null and category = 'OTHER' then {start} else trim(concat(coalesce(main_company, ''), ' ', case when category = 'OTHER' then '' else category end)) end"


register("search_terms", lambda spark, sf_dir: plan.stories(spark, sf_dir).selectExpr("article_id", f"{_terms(SPARK)} as terms"), f"select article_id, {_terms(DUCK)} as terms from ({STORIES_SQL})")
_KIND = "case when contains(article_url, 'news.google') then 'google_news' else 'rss' end"
register("research_sources", lambda spark, sf_dir: _slim(spark, sf_dir, "article_url", "clean_url", "research_priority").groupBy("clean_url", "article_url").agg(F.max("research_priority").alias("priority")).selectExpr("clean_url", "trim(article_url) as url", "priority", f"{_KIND} as kind"), f"""
    select clean_url, trim(article_url) as url, max(research_priority) as priority, {_KIND} as kind from ({STORIES_SQL}) group by clean_url, article_url""")  # fmt: skip
#: Sources that reports want, of every page; those that are held, of pages by their ids' remainders.
_WANTED = "select page_id % 10 as report_id, url, case when page_id % 11 = 0 then '' else html end as content from pages"
_HELD = "select page_id % 10 as report_id, url, case when page_id % 2 = 0 then 'COMPLETED' else 'FAILED' end as extraction_status, 'held' as content_hash from pages where page_id % 3 = 0"


def cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reports take from their cache, and what they extract."""
    rows = table(spark, sf_dir, "pages")
    wanted = rows.selectExpr("page_id % 10 as report_id", "url", "case when page_id % 11 = 0 then '' else html end as content")
    held = rows.where("page_id % 3 = 0").selectExpr("page_id % 10 as report_id", "url", "case when page_id % 2 = 0 then 'COMPLETED' else 'FAILED' end as extraction_status", "'held' as content_hash")
    return feed.cache_reuse(wanted, held)


register("cache_reuse", cache_reuse, f"""with w as ({_WANTED}), h as (select report_id, url, min(content_hash) as held_hash from ({_HELD}) where extraction_status = 'COMPLETED' group by all)
    select w.report_id, w.url, case when held_hash is not null then 'REUSE' else 'EXTRACT' end as action, case when held_hash is not null or coalesce(content, '') <> '' then 'COMPLETED' else 'FAILED' end as status,
    case when held_hash is not null then held_hash when coalesce(content, '') <> '' then md5(content) end as content_hash from w left join h on w.report_id = h.report_id and w.url = h.url""")  # fmt: skip
register("drafts_list", lambda spark, sf_dir: table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).selectExpr("o_orderkey as draft_id", "o_orderdate as created_at"), "select o_orderkey as draft_id, o_orderdate as created_at from orders where o_orderstatus = 'O' order by o_orderdate desc, o_orderkey limit 50")
_DRAFT = "case event_type when 'click' then 'EDITED' when 'error' then 'DISCARDED' else 'POSTED' end"
register("apply_draft_actions", lambda spark, sf_dir: feed.apply_actions(table(spark, sf_dir, "customer").selectExpr("c_custkey as article_id", "'NEW' as status"), table(spark, sf_dir, "events").where("event_type in ('click', 'error', 'purchase')").selectExpr("user_id as article_id", "ts", "event_id", f"{_DRAFT} as new_status")).withColumnRenamed("article_id", "draft_id"), f"""
    select c_custkey as draft_id, coalesce(s, 'NEW') as status from customer left join (select user_id, max({{'t': ts, 'e': event_id, 's': {_DRAFT}}}).s as s from events where event_type in ('click', 'error', 'purchase') group by 1) on user_id = c_custkey""")  # fmt: skip
#: Drafts of every second customer, and their states.
_DRAFTS = "select c_custkey as story_id, c_custkey + 1000000 as draft_id, case c_custkey % 6 when 0 then 'EDITED' when 2 then 'POSTED' else 'NEW' end as status from customer where c_custkey % 2 = 0"
register("regenerate_guard", lambda spark, sf_dir: feed.regenerate_guard(table(spark, sf_dir, "customer").selectExpr("c_custkey as story_id"), table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey as story_id", "c_custkey + 1000000 as draft_id", "case c_custkey % 6 when 0 then 'EDITED' when 2 then 'POSTED' else 'NEW' end as status")), f"""
    select c_custkey as story_id, draft_id, case when draft_id is null then 'CREATE' when status in ('EDITED', 'POSTED') then 'KEEP' else 'REPLACE' end as action from customer left join ({_DRAFTS}) on story_id = c_custkey""")  # fmt: skip

# --- posts ---


def _first_facts(found: DataFrame) -> DataFrame:
    """The first two numeric facts of a story, and its first stock movement."""
    rows = found.where(F.col("fact_type").isin(*R.NUMERIC_FACTS))
    listed = rows.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("pos", "rule", "fact_type", "num_value", "currency"))).alias("f"), F.min_by("num_value", F.when(F.col("fact_type") == "stock_movement", F.struct("pos", "rule"))).alias("moved"))
    return listed.selectExpr("article_id", "moved", "f[0].fact_type as kind_1", "f[0].num_value as value_1", "f[0].currency as currency_1", "try_element_at(f, 2).fact_type as kind_2")


_FIRST_SQL = f"""select article_id, min(case when fact_type = 'stock_movement' then {{'p': pos, 'r': rule, 'v': num_value}} end).v as moved, l[1].k as kind_1, l[1].v as value_1, l[1].c as currency_1, l[2].k as kind_2
    from (select *, list_sort(list({{'p': pos, 'r': rule, 'k': fact_type, 'v': num_value, 'c': currency}}) over (partition by article_id)) as l from ({_facts_sql()}) where fact_type in ({", ".join(DUCK.lit(x) for x in R.NUMERIC_FACTS)})) group by article_id, l"""


def post_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible hooks of every distinct text; they name nothing else of a story, so its stories have them all (``_of_stories``)."""
    found = written(_facts_of(_texts(spark, sf_dir, "title", "summary")), "text-facts")
    texts = _texts(spark, sf_dir, "title", "event_type", "main_company")
    angles = candidate_angles(spark, sf_dir, texts, found).select("article_id", F.split("angles", r"\|").alias("angles"))
    stories = texts.join(angles, "article_id").join(market_impact_label(spark, sf_dir, texts, found), "article_id")
    return written(posts.candidates(stories, _first_facts(found)), "post-candidates")


def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hooks with their checks, once; dealt before, as the comparison costs far more than its bytes."""
    parts = plan.TEXT_PARTS * spark.sparkContext.defaultParallelism
    return written(posts.scored(post_candidates(spark, sf_dir).repartition(parts, "article_id")), "scored-candidates")


_HOOKS_SQL = f"""with a as ({ORACLES["candidate_angles"]}), i as ({ORACLES["market_impact_label"]}), f as ({_FIRST_SQL}),
    s as (select article_id, title, event_type, main_company, impact, string_split(angles, '|') as l, moved, kind_1, value_1, currency_1, kind_2 from ({STORIES_SQL}) join a using (article_id) join i using (article_id) left join f using (article_id)),
    e as (select * exclude (l), unnest(l) as strategy, unnest(range(0, len(l))) as position from s), h as (select *, {posts.hook(DUCK)} as hook from e)
    select *, {posts.post(DUCK)} as post from h where hook is not null"""
register("hook_candidates", lambda spark, sf_dir: _of_stories(spark, sf_dir, post_candidates(spark, sf_dir).select("article_id", "strategy", "hook")), f"select article_id, strategy, hook from ({_HOOKS_SQL})")
register("compose_post", lambda spark, sf_dir: _of_stories(spark, sf_dir, post_candidates(spark, sf_dir).select("article_id", "strategy", "post")), f"select article_id, strategy, post from ({_HOOKS_SQL})")
register("reject_reason", lambda spark, sf_dir: table(spark, sf_dir, "documents").selectExpr("doc_id", f"{posts.reject_reason(SPARK, 'text')} as reason"), f"select doc_id, {posts.reject_reason(DUCK, 'text')} as reason from documents")
register("draft_quality", lambda spark, sf_dir: _of_stories(spark, sf_dir, scored_candidates(spark, sf_dir).select("article_id", "strategy", *posts.WEIGHTS, "quality")))
register("headline_rewrite", lambda spark, sf_dir: _of_stories(spark, sf_dir, scored_candidates(spark, sf_dir).selectExpr("article_id", "strategy", "similarity", "not adds_info as rewrite")))
register("select_post", lambda spark, sf_dir: _of_stories(spark, sf_dir, posts.select_post(scored_candidates(spark, sf_dir))))
register("diverse_alternates", lambda spark, sf_dir: _of_stories(spark, sf_dir, posts.diverse_alternates(scored_candidates(spark, sf_dir))))

# --- reports ---

_TOLD = f"fact_type in ({', '.join(DUCK.lit(x) for x in reports_text.REPORTED)})"


def assemble_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text report of every story that its own article tells."""
    lines = _facts_of(_texts(spark, sf_dir, "title", "summary")).where(_TOLD).withColumn("line", F.expr(reports_text.fact_line(SPARK)))
    numbers = lines.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("pos", "rule", "line"))).alias("l")).selectExpr("article_id as text_id", "array_join(transform(l, x -> x.line), chr(10)) as numbers")
    columns = ("text_id", "title", "summary", "main_company", "category", "event_type", "companies", "sectors", "countries", "source_name", "article_url", "research_priority", "confidence_score")
    return _slim(spark, sf_dir, *columns).join(numbers, "text_id", "left").selectExpr("article_id", f"{reports_text.report(SPARK, _why(SPARK))} as report")


register("assemble_report", assemble_report, f"""with n as (select article_id, string_agg({reports_text.fact_line(DUCK)}, chr(10) order by pos, rule) as numbers from ({_facts_sql()}) where {_TOLD} group by 1)
    select article_id, {reports_text.report(DUCK, _why(DUCK))} as report from (select * from ({STORIES_SQL})) left join n using (article_id)""")  # fmt: skip


def upsert_report_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by key, some of them given anew with full confidence."""
    keyed = line_facts(spark, sf_dir).selectExpr("concat(report_id, ':', pos) as fact_id", "report_id", "confidence")
    keyed = keyed.groupBy("fact_id", "report_id").agg(F.max("confidence").alias("confidence"))
    return feed.upsert(keyed, keyed.where("report_id % 5 = 0").selectExpr("fact_id", "1.0D as confidence"), "fact_id")


register("upsert_report_children", upsert_report_children, f"select concat(report_id, ':', pos) as fact_id, report_id, case when report_id % 5 = 0 then 1.0::double else max(confidence) end as confidence from ({_LINE_SQL}) group by report_id, pos")

# --- events, research and baseline posts ---

_MATCHED = ("published_at", "plain_title", "real_companies", "clean_url", "content_hash", "event_type")
register("assign_events", lambda spark, sf_dir: events.assign_events(_slim(spark, sf_dir, *_MATCHED)))
_SWEPT = ("status", "final_score", *_MATCHED)
register("reconcile_pairs", lambda spark, sf_dir: reconcile.reconcile_pairs(_slim(spark, sf_dir, *_SWEPT)))


def swept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stories, and the plan of a sweep by all legs."""
    stories = _slim(spark, sf_dir, "tier", "source_count", "source_name", "article_url", "title", *_SWEPT)
    pairs, clusters = reconcile.sweep(stories)
    return stories, reconcile.plan_merges(stories, pairs, clusters)


def reconciliation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sweep would merge: each duplicate with its primary, the size of their cluster, and a reason."""
    return swept(spark, sf_dir)[1].where("article_id <> primary_id").select("primary_id", F.col("article_id").alias("duplicate_id"), "size", "reason")


def apply_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    stories, merges = swept(spark, sf_dir)
    return reconcile.merged_stories(stories.select("article_id", "status"), merges)


def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of all stories after a sweep's merge."""
    stories, merges = swept(spark, sf_dir)
    sources = stories.selectExpr("article_id", "source_name", f"{_RAW} as url", "published_at", "title")
    return reconcile.united_sources(sources, stories, merges).select("article_id", "source_name", "url")


register("reconciliation_plan", reconciliation_plan)
register("apply_plan", apply_plan)
register("merged_sources", merged_sources)


def _exact_sweep_sql(rounds: int = 40) -> str:
    """The clusters of all pairs that address, title hash or event match, without links: pairs as the rules have them, then
    rounds of least ids."""
    order = "(-{0}.final_score, -{0}.t, {0}.article_id)"
    first, other = order.format("a"), order.format("b")
    days = f"abs(case when {first} < {other} then floor((a.t - b.t) / 86400.0) else floor((b.t - a.t) / 86400.0) end)"
    steps = "".join(f", r{i} as materialized (select p.a as node, least(min(x.least), min(y.least)) as least from p join r{i - 1} x on x.node = p.a join r{i - 1} y on y.node = p.b group by 1)" for i in range(1, rounds + 1))
    return f"""with s as materialized (select article_id, epoch(published_at)::bigint as t, final_score, real_companies, clean_url, content_hash, event_type from ({STORIES_SQL}) where status not in ('REJECTED', 'MERGED')),
        e as materialized (select article_id, t, event_type, unnest(real_companies) as company from s where event_type in ({", ".join(DUCK.lit(x) for x in R.CLUSTERABLE)})),
        m as (select a.article_id as a, b.article_id as b from s a join s b on a.clean_url = b.clean_url and a.article_id < b.article_id where a.clean_url <> '' union
            select a.article_id, b.article_id from s a join s b on a.content_hash = b.content_hash and a.article_id < b.article_id where a.content_hash <> '' union
            select a.article_id, b.article_id from e a join e b on a.event_type = b.event_type and a.company = b.company and a.article_id < b.article_id where abs(a.t - b.t) <= 604800),
        w as (select m.a, m.b from m join s a on a.article_id = m.a join s b on b.article_id = m.b where {days} <= 7
            and not (len(a.real_companies) > 0 and len(b.real_companies) > 0 and not list_has_any(a.real_companies, b.real_companies))),
        p as materialized (select a, b from w union all select b, a from w), r0 as (select distinct a as node, a as least from p){steps}
        select node as article_id, least as cluster_id from r{rounds}"""


def exact_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of a sweep by address, title hash and event."""
    return reconcile.exact_classes(_slim(spark, sf_dir, *_SWEPT))


register("exact_sweep", exact_sweep, _exact_sweep_sql())


def stream_event_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles landed as feed files, taken up as streams, each with what it goes on: by similar title (level 4), else by event
    (level 5). The stream of titles lands classified articles, which that of events takes up."""
    path, kept, titles, found = (shared_path(spark, n) for n in ("feed", "stream-table", "stream-titles", "stream-links"))
    feeds.write_feed(plan.articles(spark, sf_dir), path)
    ingest.title_match_stream(feeds.read_feed(spark, path, plan.AS_OF, stream=True), kept, titles, shared_path(spark, "stream-checkpoint"))
    ingest.event_match_stream(ingest.stored_stream(spark, ingest.classified_of(kept)), found, shared_path(spark, "stream-checkpoint"))
    levels = [ingest.stored(spark, p).select("article_id", "earlier_id", F.lit(level).alias("level")) for p, level in ((titles, 4), (found, 5))]
    return levels[0].unionByName(levels[1]).groupBy("article_id").agg(F.min_by("earlier_id", "level").alias("earlier_id"), F.min("level").alias("level"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles landed as feed files, taken up as a stream."""
    path, kept = shared_path(spark, "feed"), shared_path(spark, "stream-articles")
    feeds.write_feed(plan.articles(spark, sf_dir), path)
    rows = feeds.read_feed(spark, path, plan.AS_OF, stream=True)
    rows.writeStream.format("parquet").option("path", kept).option("checkpointLocation", shared_path(spark, "stream-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(kept).select("title", "article_url", "published_at", "summary")


register("stream_event_match", stream_event_match)
register("stream_ingest", stream_ingest, f"select title, article_url, published_at, summary from ({ARTICLES_SQL})")
#: A registry of feeds: every supplier is one, by its key.
_FEEDS = {
    "slug": "cast(s_suppkey as string)", "name": "s_name", "url": "concat('https://feeds.example.com/', s_suppkey)", "type": "case s_suppkey % 3 when 0 then 'google_news' when 1 then 'rss' end",
    "category": "case s_nationkey % 2 when 0 then 'REGULATORY' else 'OTHER' end", "country": "case when s_nationkey % 3 > 0 then 'India' end",
    "enabled": "case s_suppkey % 4 when 0 then false when 1 then true end", "priority": "cast(s_suppkey % 5 as int)",
}
_FEEDS_SQL = f"select {', '.join(f'{e} as {n}' for n, e in _FEEDS.items())} from supplier"
#: Feeds that articles are landed by.
_LANDED = 20


def landed_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry landed as a file and read back."""
    path = shared_path(spark, "feed-registry")
    rows = table(spark, sf_dir, "supplier").selectExpr(*(f"{e} as {n}" for n, e in _FEEDS.items()))
    rows.write.json(path)
    return feeds.read_registry(spark, path, lines=True)


def collected_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles landed in the folders of their feeds, with what the registry says of these."""
    path = shared_path(spark, "collected-feed")
    feeds.write_feed(plan.articles(spark, sf_dir).withColumn("feed", (F.col("article_id") % _LANDED).cast("string")), path)
    return feeds.collected(feeds.read_feed(spark, path, plan.AS_OF), landed_registry(spark, sf_dir)).select("title", "article_url", "source_name", "category", "country")


register("feed_registry", lambda spark, sf_dir: landed_registry(spark, sf_dir).select("name", "type", "url", "category", "country"), f"select name, coalesce(type, 'rss') as type, url, category, country from ({_FEEDS_SQL}) where coalesce(enabled, true)")
register("collected_articles", collected_articles, f"""select title, article_url, f.name as source_name, f.category, coalesce(f.country, 'Global') as country from ({ARTICLES_SQL}) a
    join (select * from ({_FEEDS_SQL}) where coalesce(enabled, true)) f on f.slug = cast(a.article_id % {_LANDED} as varchar)""")  # fmt: skip


def found_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search finds for a story: here, the five articles after it."""
    articles = plan.articles(spark, sf_dir).selectExpr("article_id as other", "title", "source_name", "article_url as link")
    wanted = plan.articles(spark, sf_dir).select("article_id", F.posexplode(F.sequence(F.col("article_id") + 1, F.col("article_id") + 5)).alias("position", "other"))
    return wanted.join(articles, "other").selectExpr("article_id", "position", "concat(title, ' - ', source_name) as title", "link")


register("match_candidates", lambda spark, sf_dir: posts.match_candidates(_slim(spark, sf_dir, "plain_title").withColumn("held", (F.col("article_id") % 8).cast("int")), found_entries(spark, sf_dir)))
register("confirmed_facts", lambda spark, sf_dir: facts.confirmed(line_facts(spark, sf_dir), facts.conflict_counts(line_facts(spark, sf_dir))).select("report_id", "fact_type", "pos", "num_value"), f"""
    with f as ({_LINE_SQL}), c as (select distinct report_id, fact_type from ({_CONFLICTS_SQL}))
    select report_id, fact_type, pos, num_value from f where fact_type in ({", ".join(DUCK.lit(x) for x in R.NUMERIC_FACTS)}) and (report_id, fact_type) not in (select * from c)""")  # fmt: skip


def research_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue's stories researched as one job: facts of their articles, verified and rated; a story without text fails and
    holds up no other."""
    queue = QUERIES["research_queue"](spark, sf_dir).select(F.col("article_id").alias("report_id"))
    stories = written(_slim(spark, sf_dir, "title", "summary", "source_name", "research_priority").withColumnRenamed("article_id", "report_id").join(queue, "report_id"), "research-stories")
    found = _facts_of(stories.withColumnRenamed("report_id", "article_id")).withColumnRenamed("article_id", "report_id").withColumn("source_id", F.col("report_id"))
    rated = facts.research_confidence(stories.selectExpr("report_id", "source_name", "research_priority as priority"), found, facts.conflict_counts(found))
    failed = F.expr("trim(concat(coalesce(title, ''), coalesce(summary, ''))) = ''")
    return stories.join(rated, "report_id", "left").select("report_id", F.when(failed, 0).otherwise(F.col("confidence")).alias("confidence"), F.when(failed, "FAILED").otherwise(F.col("status")).alias("status"))


register("research_batch", research_batch)

_TITLED_SQL = "select doc_id, coalesce(text, '') as text from documents"


def _of_documents(name: str, expression) -> None:
    """A query that applies an expression over ``text`` to every document."""
    register(name, lambda spark, sf_dir: table(spark, sf_dir, "documents").selectExpr("doc_id", "coalesce(text, '') as text").selectExpr("doc_id", f"{expression(SPARK)} as {name}"), f"select doc_id, {expression(DUCK)} as {name} from ({_TITLED_SQL})")


def _of_titles(name: str, expression) -> None:
    """A query that applies an expression over ``low_title`` to every article."""
    register(name, lambda spark, sf_dir: plan.articles(spark, sf_dir).selectExpr("article_id", "lower(title) as low_title").selectExpr("article_id", f"{expression(SPARK)} as {name}"), f"select article_id, {expression(DUCK)} as {name} from (select article_id, lower(title) as low_title from ({ARTICLES_SQL}))")


_of_documents("normalize_title", lambda d: plan._clean(d, "text"))
_of_documents("truncate_ellipsis", lambda d: posts.truncated(d, "text"))
_of_titles("ipo_listing_rule", lambda d: f"({d.has('low_title', R.LISTING)} and not {d.has('low_title', R.LISTING_NOT)})")
_of_titles("earnings_rule", lambda d: f"case when {d.has('low_title', R.EARNINGS)} then {plan.earnings_kind(d)} end")
register("company_guard", lambda spark, sf_dir: _slim(spark, sf_dir, "main_company").selectExpr("article_id", f"{posts.guarded(SPARK)} as company"), f"select article_id, {posts.guarded(DUCK)} as company from ({STORIES_SQL})")
register("source_line", lambda spark, sf_dir: plan.articles(spark, sf_dir).selectExpr("article_id", f"{posts.source_line(SPARK)} as line"), f"select article_id, {posts.source_line(DUCK)} as line from ({ARTICLES_SQL})")
_AMOUNTS = {"format_amount": lambda d: posts.amount(d, "num_value", "currency"), "format_fact_value": lambda d: posts.shown(d, "fact_type", "num_value", "currency")}
for _name, _form in _AMOUNTS.items():
    register(_name, lambda spark, sf_dir, e=_form(SPARK), n=_name: story_facts(spark, sf_dir).where("num_value is not null").selectExpr("article_id", "fact_type", "num_value", f"{e} as {n}"),
        f"select article_id, fact_type, num_value, {_form(DUCK)} as {_name} from ({_facts_sql()}) where num_value is not null")
_POST = ("article_id", "post_text", "thread", "image_headline", "image_subheadline")


def baseline_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template post of every story, its thread and the lines of its image."""
    rows = story_facts(spark, sf_dir).selectExpr("article_id", "cast(pos * 100 + rule as bigint) as p", "fact_type as k", "num_value as v", "currency as c")
    firsts = [F.min(F.when(F.col("k") == k, F.struct("p", "v", "c"))).alias(k) for k in posts.NAMED]
    numbers = F.array_sort(F.collect_list(F.when(F.col("k").isin(*posts.MONEY_FACTS), F.struct("p", "k", "v", "c")))).alias("numbers")
    stories = _slim(spark, sf_dir, "title", "event_type", "main_company", "category", "article_url", "source_name").join(rows.groupBy("article_id").agg(*firsts, numbers), "article_id", "left")
    for layer in posts.baseline(SPARK):
        stories = stories.selectExpr("*", *(f"{e} as {n}" for n, e in layer.items()))
    return stories.select(*_POST)


def _baseline_sql() -> str:
    firsts = ", ".join(f"min(case when k = '{k}' then {{'p': p, 'v': v, 'c': c}} end) as {k}" for k in posts.NAMED)
    money = ", ".join(DUCK.lit(k) for k in posts.MONEY_FACTS)
    sql = f"""select * from (select article_id, title, event_type, main_company, category, article_url, source_name from ({STORIES_SQL})) left join
        (select article_id, {firsts}, list_sort(list({{'p': p, 'k': k, 'v': v, 'c': c}}) filter (k in ({money}))) as numbers
        from (select article_id, cast(pos * 100 + rule as bigint) as p, fact_type as k, num_value as v, currency as c from ({_facts_sql()})) group by 1) using (article_id)"""
    for layer in posts.baseline(DUCK):
        sql = f"select *, {', '.join(f'{e} as {n}' for n, e in layer.items())} from ({sql})"
    return f"select {', '.join(_POST)} from ({sql})"


register("baseline_post", baseline_post, _baseline_sql())
