"""One sweep over stored stories: what the rules of deduplication would merge now, and the merge.

Stories are taken in an order (best score, latest, smallest id). Two of them match if they aren't more than seven whole days apart, no
companies conflict, and address, title hash, similar title or event agree. Days are counted from the story that is first in
the order and rounded down, so where the later one is first, all but eight days are allowed, else seven.

No group gives all its pairs. Links are found that connect the same stories: each story to the last before it, by key and
company, since stories that share a key and a company within the window form chains; stories without companies, which
conflict with none, to their neighbours among these. Every link is itself a match. Keys are dealt by stretches of the
window's length, each with the stories of the neighbouring ones that its windows need.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.functions.rules import CLUSTERABLE
from presswork.operators.components import connected_components
from presswork.operators.dedup import choose_primary, conflicts, similar_links
from presswork.operators.latest import may_match
from presswork.operators.shapes import shape, similar_pairs
from presswork.operators.similar import DAY, LOOKBACK_DAYS, SIMILAR, candidate_titles, verified
from presswork.shared import written

EXCLUDED = ("REJECTED", "MERGED")
LEGS = ("url", "hash", "similar", "event")


def _prepared(df: DataFrame) -> DataFrame:
    """Stories that take part, with their time in seconds (null: 0) and their place in the order (smaller: earlier)."""
    score = F.col("final_score") if "final_score" in df.columns else F.lit(0)
    t = F.coalesce(F.unix_timestamp("published_at"), F.lit(0))
    return written(df.where(F.coalesce("status", F.lit("")).isin(*EXCLUDED) == F.lit(False)).select(
        "article_id", t.alias("t"), F.struct((-F.coalesce(score, F.lit(0))).cast("long").alias("s"), (-t).alias("t"), "article_id").alias("rank"), "real_companies",
        F.nullif("clean_url", F.lit("")).alias("url"), F.nullif("content_hash", F.lit("")).alias("hash"), F.nullif("plain_title", F.lit("")).alias("title"),
        F.when(F.col("event_type").isin(*CLUSTERABLE), F.col("event_type")).alias("event"),
    ), "sweep-stories")


def _neighbours(rows: DataFrame, stretch: int, after: Column | None = None) -> DataFrame:
    """Rows in their own stretch (``own``), in the next, and, where ``after`` holds, in the one before."""
    places = F.array(F.struct(F.lit(0).alias("d"), F.lit(True).alias("own")), F.struct(F.lit(1).alias("d"), F.lit(False).alias("own")))
    if after is not None:
        places = F.when(after, F.concat(places, F.array(F.struct(F.lit(-1).alias("d"), F.lit(False).alias("own"))))).otherwise(places)
    placed = rows.withColumn("p", F.explode(places)).withColumn("stretch", F.expr(f"floor(t / {stretch}) + p.d")).withColumn("own", F.col("p.own"))
    return placed.drop("p")


def _links(found: DataFrame, near: list[str], far: list[tuple[str, str]], window: int) -> DataFrame:
    """``(article_id, earlier_id)`` of own rows and the structs (t, article_id[, rank]) that windows found for them."""
    made = [f"case when {c} is not null and abs(t - {c}.t) <= {window} then {c}.article_id end" for c in near]
    made += [f"case when {c} is not null and {first} then {c}.article_id end" for c, first in far]
    other = found.where("own").select("article_id", "t", F.explode(F.array_compact(F.array(*(F.expr(m) for m in made)))).alias("other"))
    return other.select(F.greatest("article_id", "other").alias("a"), F.least("article_id", "other").alias("b")).distinct()


def _chained(rows: DataFrame, key: str, window: int, placed: bool = False) -> DataFrame:
    """Links ``(a, b)`` that connect stories of one key. A row may stand for equal stories of one time, with the least and the
    greatest (``top``) of their places in the order; ``placed``: where the order decides, the link is of the stories that have these places."""
    top = F.col("top" if "top" in rows.columns else "rank").alias("top")
    keyed = rows.where(F.col(key).isNotNull()).select("article_id", "t", "rank", top, "real_companies", F.col(key).alias("key"))
    stretch, late = window + DAY, f"range between {window + DAY - 1} preceding and {window + 1} preceding"
    at, least, most = "struct(t, article_id)", "struct(rank, t, article_id)", "struct(top as rank, t, article_id)"
    alone = F.size("real_companies") == 0
    tracks = keyed.withColumn("company", F.explode(F.when(alone, F.array(F.lit(""))).otherwise(F.col("real_companies")))).drop("real_companies")
    by = "partition by key, company, stretch order by t"
    tracked = _neighbours(tracks, stretch).selectExpr("*", f"lag({at}) over ({by}, article_id) as before", f"max({most}) over ({by} {late}) as low")
    mixed = _neighbours(keyed.withColumn("alone", alone).drop("real_companies"), stretch, F.col("alone"))
    by = "partition by key, stretch order by t"
    early = f"range between {window + 1} following and {window + DAY - 1} following"
    mixed = mixed.selectExpr(
        "*", f"last_value(case when alone then {at} end, true) over ({by}, article_id rows between unbounded preceding and 1 preceding) as before",
        f"first_value(case when alone then {at} end, true) over ({by}, article_id rows between 1 following and unbounded following) as next",
        f"max(case when alone then {most} end) over ({by} {late}) as low", f"min(case when alone then {least} end) over ({by} {early}) as high",
    ).where("not alone")
    first, last = "low.rank > rank", "high.rank < top"
    made = _links(tracked, ["before"], [] if placed else [("low", first)], window).union(_links(mixed, ["before", "next"], [] if placed else [("low", first), ("high", last)], window))
    if not placed:
        return made
    ends = [(tracked, first, "rank", "low"), (mixed, first, "rank", "low"), (mixed, last, "top", "high")]
    found = [df.where(f"own and {far} is not null and {so}").selectExpr(f"{own}.article_id as x", f"{far}.rank.article_id as y") for df, so, own, far in ends]
    return made.union(reduce(DataFrame.union, found).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))).distinct()


def _event_chained(rows: DataFrame, window: int) -> DataFrame:
    """Links of stories of one event type and company."""
    tracks = rows.where("event is not null").select("article_id", "t", "event", F.explode("real_companies").alias("company"))
    by = "partition by event, company, stretch order by t, article_id"
    return _links(_neighbours(tracks, window).selectExpr("*", f"lag(struct(t, article_id)) over ({by}) as before"), ["before"], [], window)


def _nearest_alike(rows: DataFrame, asked: DataFrame, least: float, days: int) -> DataFrame:
    """Links ``(a, b)`` of asked stories to the latest earlier one of a similar title, where that is a match: the title that is
    similar to the other has to be the one of the story that is first in the order."""
    dated = [df.select("article_id", F.timestamp_seconds("t").alias("published_at"), F.col("title").alias("plain_title"), "real_companies") for df in (rows, asked)]
    found = similar_links(dated[0], days, dated[1], least)
    sides = [rows.select(F.col("article_id").alias(i), F.col("rank").alias(f"{i}_rank"), F.col("title").alias(f"{i}_title")) for i in ("article_id", "earlier_id")]
    both = found.join(sides[0], "article_id").join(sides[1], "earlier_id")
    turned = both.where("article_id_rank > earlier_id_rank and article_id_title <> earlier_id_title").select(F.col("earlier_id_title").alias("title"), F.col("article_id_title").alias("earlier_title"))
    true = verified(turned.distinct(), least, even=False).selectExpr("title as earlier_id_title", "earlier_title as article_id_title", "true as so")
    kept = both.join(true, ["earlier_id_title", "article_id_title"], "left").where("article_id_rank < earlier_id_rank or article_id_title = earlier_id_title or so")
    return kept.select(F.greatest("article_id", "earlier_id").alias("a"), F.least("article_id", "earlier_id").alias("b"))


def _outside(rows: DataFrame) -> DataFrame:
    """Rows that aren't in the largest part."""
    largest = rows.groupBy("part").count().orderBy(F.desc("count"), "part").limit(1).select("part")
    return written(rows.join(largest, "part", "left_anti"), "sweep-outside")


def _crossing(rows: DataFrame, outside: DataFrame, least: float, span: int) -> list[DataFrame]:
    """Of the rows and those outside, which have a title whose shape may be similar to one of another part that occurs near it. Others
    match no other part by titles."""
    named = [df.where("title is not null").withColumn("shape", shape("title")) for df in (rows, outside)]
    placed = [written(df.select(F.col("shape").alias("title"), F.floor(F.col("t") / span).alias("stretch"), F.col("part").alias("component")).distinct(), "sweep-shapes") for df in named]
    pairs = written(candidate_titles(placed[0], least, placed[1], after=True).mapInArrow(may_match(least), "title string, earlier_title string"), "sweep-shapes")
    split = placed[0].groupBy("title").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("title")
    kept = written(pairs.select("title").union(pairs.select("earlier_title")).union(split).distinct().withColumnRenamed("title", "shape"), "sweep-shapes")
    return [written(df.join(kept, "shape").drop("shape"), "sweep-crossing") for df in named]


def _joined(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the parts that links of stories make of theirs."""
    sides = [rows.select(F.col("article_id").alias(i), F.col("part").alias(f"{i}_part")) for i in ("a", "b")]
    edges = links.join(sides[0], "a").join(sides[1], "b").where("a_part <> b_part").selectExpr("a_part as a", "b_part as b").distinct()
    found = connected_components(edges).selectExpr("node as part", "component")
    return written(rows.join(found, "part", "left").withColumn("part", F.coalesce("component", "part")).drop("component"), "sweep-parts")


def _alike(rows: DataFrame, least: float, days: int) -> DataFrame:
    """Links of stories whose titles differ and are similar, so many that with those that made the ``part`` of each row, which hold those
    of equal titles, they connect what all such matches connect.

    Only titles whose shapes may be similar to one of another part are looked at. First the stories outside of the largest component are linked to their nearest similar ones; then only stories of
    different components need be compared, of which one at least isn't in the largest.

    Stories of one title and the same companies within half a window are a cell; all of them match each other. Cells are
    linked by one pair where all their stories match, or their nearest do; stories are compared one by one only where the
    order decides: where titles are similar one way round only, or where the nearest stories are over seven days apart.
    """
    window = days * DAY
    rows, outside = _crossing(rows, _outside(rows), least, window + DAY)
    if outside.isEmpty():
        return rows.select(F.col("article_id").alias("a"), F.col("article_id").alias("b")).limit(0)
    near = written(_nearest_alike(rows, outside, least, days), "sweep-nearest")
    rows = _joined(rows, near)
    outside = _outside(rows)
    if outside.isEmpty():
        return near
    half = window // 2
    named = rows.withColumn("cell", F.floor(F.col("t") / half)).withColumn("companies", F.array_sort("real_companies"))
    cells = named.groupBy("title", "companies", "cell").agg(F.min(F.struct("t", "article_id")).alias("first"), F.max(F.struct("t", "article_id")).alias("last"), F.min("part").alias("part"))
    cells = written(cells, "sweep-cells")
    placed = [df.select("title", F.floor(F.col("t") / (window + DAY)).alias("stretch"), F.col("part").alias("component")).distinct() for df in (rows, outside.where("title is not null"))]
    pairs = candidate_titles(placed[0], least, placed[1], after=True)
    pairs = pairs.union(pairs.select("earlier_title", "title")).distinct()
    late = cells.selectExpr("title as other_title", "companies as other_companies", "cell as other_cell", "first as other_first", "last as other_last", "part as other_part")
    late = late.withColumn("cell", F.explode(F.expr("sequence(other_cell - 3, other_cell)")))
    gap = "other_first.t - last.t"
    met = cells.join(pairs.withColumnRenamed("earlier_title", "other_title"), "title").join(late, ["other_title", "cell"])
    met = met.where(f"part <> other_part and not {conflicts('companies', 'other_companies')} and (cell < other_cell or title < other_title) and {gap} < {window + DAY}")
    met = written(met, "sweep-candidates")
    compared = met.select("title", F.col("other_title").alias("earlier_title"))
    compared = compared.union(compared.select("earlier_title", "title")).distinct()
    similar = written(verified(compared, least).selectExpr("title", "earlier_title as other_title", "true as so"), "sweep-similar")
    turned = similar.select(F.col("other_title").alias("title"), F.col("title").alias("other_title"), F.lit(True).alias("back"))
    # Each unordered pair of titles, with the ways round in which it is similar.
    ways = similar.join(turned, ["title", "other_title"], "full").select("title", "other_title", F.coalesce("so", F.lit(False)).alias("so"), F.coalesce("back", F.lit(False)).alias("back"))
    met = met.join(ways, ["title", "other_title"]).withColumn("plain", F.expr(f"so and back and {gap} <= {window}"))
    met = written(met, "sweep-met")
    plain = met.where("plain").select(F.col("last.article_id").alias("x"), F.col("other_first.article_id").alias("y"))
    own = named.select("title", "companies", "cell", F.col("article_id").alias("x"), F.col("t").alias("x_t"), F.col("rank").alias("x_rank"))
    other = named.select(F.col("title").alias("other_title"), F.col("companies").alias("other_companies"), F.col("cell").alias("other_cell"), F.col("article_id").alias("y"), F.col("t").alias("y_t"), F.col("rank").alias("y_rank"))
    single = met.where("not plain").join(own, ["title", "companies", "cell"]).join(other, ["other_title", "other_companies", "other_cell"])
    in_time = f"case when y_t >= x_t = (y_rank < x_rank) or x_t = y_t then abs(y_t - x_t) < {window + DAY} else abs(y_t - x_t) <= {window} end"
    single = single.where(f"{in_time} and case when x_rank < y_rank then so else back end")
    single = single.groupBy("title", "companies", "cell", "other_title", "other_companies", "other_cell", "x").agg(F.min("y").alias("y")).select("x", "y")
    # Within a cell pair, what matches some story of a cell is connected with the whole cell.
    return near.union(plain.union(single).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")))


def _celled(rows: DataFrame, legs: tuple[str, ...], window: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the ``rep`` (least id, with its time and address) of their cell, and cells by times.

    A cell is the stories of one title, hash, event and companies in a stretch of the window's length: all of them match each other. Stories
    that share nothing a leg asks for are cells of their own. Of a cell, a time has the least and the greatest place in the order."""
    asked = {"hash": "hash is not null", "similar": "title is not null", "event": "event is not null and size(real_companies) > 0"}
    alike = " or ".join(f"({c})" for leg, c in asked.items() if leg in legs) or "false"
    told = [x for c in ("hash", "title", "event") for x in (F.col(c), F.col(c).isNull())]
    kind = F.xxhash64(*told, "companies", F.when(F.expr(f"not ({alike})"), F.col("article_id")))
    named = rows.where("real_companies is not null").withColumn("companies", F.array_sort("real_companies"))
    named = named.withColumn("kind", kind).withColumn("week", F.expr(f"floor(t / {window})"))
    first = [F.first(c).alias(c) for c in ("hash", "title", "event", "companies")]
    times = named.groupBy("kind", "week", "t").agg(F.min("rank").alias("rank"), F.max("rank").alias("top"), F.min(F.struct("article_id", "t", "url")).alias("rep"), *first)
    times = times.withColumn("rep", F.min("rep").over(W.partitionBy("kind", "week")))
    times = written(times.withColumns({"article_id": F.col("rank.article_id"), "real_companies": F.col("companies")}).drop("companies"), "sweep-cells")
    reps = times.groupBy("kind", "week").agg(F.first("rep").alias("rep"))
    return written(named.drop("companies").join(reps, ["kind", "week"]).drop("kind", "week"), "sweep-placed"), times


def _directed(a: str, b: str, at: str, bt: str) -> list[Column]:
    """The later of two stories, and the earlier."""
    later = F.expr(f"({at}, {a}) > ({bt}, {b})")
    return [F.when(later, F.expr(a)).otherwise(F.expr(b)).alias("article_id"), F.when(later, F.expr(b)).otherwise(F.expr(a)).alias("earlier_id")]


def sweep(df: DataFrame, days: int = LOOKBACK_DAYS, least: float = SIMILAR, legs: tuple[str, ...] = LEGS, placed: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """The pairs of reconcile_pairs, and, where ``placed``, ``(article_id, cluster_id)`` of the stories that they connect.

    Stories of a cell are linked to its least id, and cells by the times of theirs. What this leaves apart is linked by addresses, by one story of
    each for two parts, and then by similar titles; so components go by cells and parts, and never by all stories."""
    window = days * DAY
    rows, times = _celled(_prepared(df), legs, window)
    found = [_event_chained(times, window) if leg == "event" else _chained(times, {"similar": "title"}.get(leg, leg), window, placed=True) for leg in legs if leg != "url"]
    none = rows.select(F.col("article_id").alias("a"), F.col("article_id").alias("b")).limit(0)
    every = written(reduce(DataFrame.union, found, none).distinct(), "sweep-links")
    cells = [times.select(F.col("article_id").alias(i), F.col("rep.article_id").alias(f"{i}_cell")) for i in ("a", "b")]
    edges = every.join(cells[0], "a").join(cells[1], "b").where("a_cell <> b_cell").selectExpr("a_cell as a", "b_cell as b")
    parts = connected_components(edges).selectExpr("node as cell", "component as part")
    members = rows.where("article_id <> rep.article_id").select("article_id", "t", "rep", "url", "hash", "title")
    rows = rows.withColumn("cell", F.col("rep.article_id")).drop("rep").join(parts, "cell", "left").withColumn("part", F.coalesce("part", "cell")).drop("cell")
    rows = written(rows, "sweep-parts")
    if "url" in legs:
        split = rows.where("url is not null").groupBy("url").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("url")
        addressed = rows.join(split, "url").withColumn("article_id", F.struct("part", "article_id"))
        # Of two parts one link.
        by_url = _chained(addressed, "url", window).where("a.part <> b.part").groupBy("a.part", F.col("b.part").alias("other")).agg(F.min(F.struct("a.article_id", F.col("b.article_id").alias("other"))).alias("l"))
        by_url = written(by_url.selectExpr("greatest(l.article_id, l.other) as a", "least(l.article_id, l.other) as b"), "sweep-addresses")
        rows, every = _joined(rows, by_url), every.unionByName(by_url)
    if "similar" in legs:
        alike = written(_alike(rows, least, days), "sweep-alike")
        rows, every = _joined(rows, alike) if placed else rows, every.unionByName(alike)
    sides = [rows.select(F.col("article_id").alias(i), *(F.col(c).alias(f"{i}_{c}") for c in ("t", "rank", "url", "hash", "title"))) for i in ("a", "b")]
    both = every.distinct().join(sides[0], "a").join(sides[1], "b")
    both = both.withColumns({"title": F.expr("if(a_rank < b_rank, a_title, b_title)"), "other_title": F.expr("if(a_rank < b_rank, b_title, a_title)")})
    exact = F.expr("case when a_url = b_url then 'url' when a_hash = b_hash then 'hash' when a_title = b_title then 'similar' end")
    told = both.select("a", "b", "a_t", "b_t", "title", "other_title", exact.alias("exact")).withColumn("so", F.lit(False))
    if "similar" in legs:
        told = written(told.drop("so"), "sweep-told")
        asked = told.where("exact is null and title is not null and other_title is not null").select(F.col("title"), F.col("other_title").alias("earlier_title")).distinct()
        similar = similar_pairs(asked, least).selectExpr("title", "earlier_title as other_title", "true as so")
        told = told.join(similar, ["title", "other_title"], "left")
    linked = told.select(*_directed("a", "b", "a_t", "b_t"), F.expr("coalesce(exact, if(so, 'similar', 'event'))").alias("reason"))
    same = F.expr("case when url = rep.url then 'url' when hash is not null then 'hash' when title is not null then 'similar' else 'event' end")
    pairs = linked.unionByName(members.select(*_directed("article_id", "rep.article_id", "t", "rep.t"), same.alias("reason")))
    if not placed:
        return pairs, None
    several = rows.groupBy("part").count().where("count > 1").select("part")
    return pairs, rows.join(several, "part").select("article_id", F.col("part").alias("cluster_id"))


def reconcile_pairs(df: DataFrame, days: int = LOOKBACK_DAYS, least: float = SIMILAR, legs: tuple[str, ...] = LEGS) -> DataFrame:
    """``(article_id, earlier_id, reason)``: matches that connect the stories which matches connect; ``earlier_id`` is the one that comes
    first by time. The reason is the first of url, hash, similar, event that holds for the pair.

    ``legs`` are those that may match. Rejected and merged stories take no part. Null or empty addresses, hashes and titles match nothing.
    """
    return sweep(df, days, least, legs, placed=False)[0]


def exact_classes(df: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """``(article_id, cluster_id)`` of stories that others match by address, title hash or event: the least id that matches connect.

    Stories of one hash, event, companies and time all match each other, so one row (``cell``) stands for them. Those of one stretch of
    the window's length still do, so the least id of these is what hash and event link, and addresses link what this leaves apart:
    windows go by cells, and components by few rows.
    """
    window = days * DAY
    # Without a hash, and without an event or companies, equal stories don't match: each is a cell.
    apart = F.when(F.col("hash").isNull() & (F.col("event").isNull() | (F.size("real_companies") == 0)), F.col("article_id"))
    rows = _prepared(df).withColumns({"of_hash": F.coalesce("hash", F.lit("")), "of_event": F.coalesce("event", F.lit("")), "companies": F.array_sort("real_companies"), "apart": F.coalesce(apart, F.lit(0).cast("long"))})
    rows = rows.where("real_companies is not null")
    same = ["of_hash", "of_event", "companies", "apart", "t"]
    cells = rows.groupBy(*same).agg(F.min("article_id").alias("article_id"), F.count("*").alias("n"), F.min("rank").alias("rank"), F.max("rank").alias("top"))
    cells = cells.withColumns({"hash": F.nullif("of_hash", F.lit("")), "event": F.nullif("of_event", F.lit("")), "real_companies": F.col("companies")})
    week = W.partitionBy(*same[:-1], F.expr(f"floor(t / {window})"))
    cells = written(cells.withColumn("article_id", F.min("article_id").over(week)), "sweep-cells")
    first = connected_components(_event_chained(cells, window).union(_chained(cells, "hash", window)).distinct())
    labels = cells.join(first.withColumnRenamed("node", "article_id"), "article_id", "left").select(*same, "n", F.coalesce("component", "article_id").alias("label"))
    labels = written(labels, "sweep-labels")
    placed = written(rows.join(labels.drop("n"), same).select("article_id", "label", "t", "rank", "real_companies", "url"), "sweep-placed")
    # Stories of one address go by their labels: a link of two stories of one label is none.
    links = _chained(placed.drop("article_id").withColumnRenamed("label", "article_id"), "url", window)
    second = connected_components(links).select(F.col("node").alias("label"), F.col("component").alias("cluster_id"))
    sizes = labels.groupBy("label").agg(F.sum("n").alias("n")).join(second, "label", "left").withColumn("cluster_id", F.coalesce("cluster_id", "label"))
    kept = sizes.groupBy("cluster_id").agg(F.sum("n").alias("all")).where("all > 1").select("cluster_id")
    clusters = written(sizes.select("label", "cluster_id").join(kept, "cluster_id"), "sweep-clusters")
    return placed.select("article_id", "label").join(clusters, "label").select("article_id", "cluster_id")


def plan_merges(df: DataFrame, pairs: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """``(article_id, primary_id, size, reason)`` of every story of a cluster: stories that ``pairs`` connect, the primary, the
    cluster's size, and for each other story the reason of the pair that touches it whose partner has the least id. ``clusters``
    (article_id, cluster_id), where what the pairs connect is known."""
    if clusters is None:
        clusters = connected_components(pairs.selectExpr("article_id as a", "earlier_id as b")).selectExpr("node as article_id", "component as cluster_id")
    primaries = choose_primary(clusters.join(df, "article_id"))
    touching = pairs.select("article_id", F.col("earlier_id").alias("partner"), "reason").union(pairs.select("earlier_id", "article_id", "reason"))
    reasons = touching.groupBy("article_id").agg(F.min_by("reason", F.struct("partner", "reason")).alias("reason"))
    placed = clusters.join(primaries, "cluster_id").join(reasons, "article_id", "left")
    return placed.select("article_id", "primary_id", "size", F.when(F.col("article_id") != F.col("primary_id"), F.col("reason")).alias("reason"))


def merged_stories(df: DataFrame, plan: DataFrame) -> DataFrame:
    """The stories, ``status`` MERGED and ``merged_into_id`` set for all but the primaries of their clusters. None is dropped."""
    into = plan.where("article_id <> primary_id").select("article_id", F.col("primary_id").alias("merged_into_id"))
    joined = df.drop("merged_into_id").join(into, "article_id", "left")
    return joined.withColumn("status", F.when(F.col("merged_into_id").isNotNull(), "MERGED").otherwise(F.col("status")))


def united_sources(sources: DataFrame, stories: DataFrame, plan: DataFrame) -> DataFrame:
    """``(article_id, source_name, url, published_at, title)``: sources of all stories after a merge. A primary also gets those of
    its duplicates, and the duplicates' own addresses, each address once: its own before the others', then of the story with
    the least id. Duplicates keep theirs.

    ``sources`` has these columns and ``stories`` article_id, source_name, article_url, published_at, title. A story that
    has a third of all sources is split: an address is chosen by a grouped minimum.
    """
    columns = ("source_name", "url", "published_at", "title")
    into = plan.where("article_id <> primary_id").select("article_id", "primary_id")
    own = sources.select("article_id", *columns)
    moved = own.join(into, "article_id").select(F.col("primary_id").alias("owner"), F.struct(F.lit(1).alias("k"), F.col("article_id").alias("i"), F.lit(0).alias("own")).alias("o"), *columns)
    named = stories.select("article_id", "source_name", F.col("article_url").alias("url"), "published_at", "title").join(into, "article_id")
    named = named.select(F.col("primary_id").alias("owner"), F.struct(F.lit(1).alias("k"), F.col("article_id").alias("i"), F.lit(1).alias("own")).alias("o"), *columns)
    kept = own.select(F.col("article_id").alias("owner"), F.struct(F.lit(0).alias("k"), F.col("article_id").alias("i"), F.lit(0).alias("own")).alias("o"), *columns)
    every = kept.unionByName(moved).unionByName(named)
    once = every.groupBy("owner", "url").agg(F.min_by(F.struct("source_name", "published_at", "title"), F.struct("o", "source_name", "title")).alias("s"))
    return once.select(F.col("owner").alias("article_id"), "s.source_name", "url", "s.published_at", "s.title")
