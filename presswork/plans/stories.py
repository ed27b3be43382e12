"""From landed articles to classified, tagged and scored stories, as layers of column expressions.

Each layer names new columns by expressions over the earlier ones. Spark gets them as projections, which collapse into
one generated stage; the same layers, spelled for DuckDB, make the statements that results are compared with.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions import rules as R
from presswork.functions.dialect import DUCK, SPARK, Dialect
from presswork.shared import columns_of

AS_OF = "2001-08-01 00:00:00"
STAMP = f"timestamp '{AS_OF}'"

_SUBJECTS = ("Zepto", "Tata Motors", "NSE", "Paytm", "Infosys", "Quest Global", "Reuters", "The company")
_TEMPLATES = (
    "concat(' raises $', cast(cast(floor(o_totalprice / 1000) as bigint) as string), ' million in Series B funding round')",
    "concat(' acquires rival for Rs ', cast(cast(floor(o_totalprice / 100) as bigint) as string), ' crore')",
    "' files DRHP with SEBI for IPO'",
    "' IPO price band set at Rs 500 to Rs 520'",
    "' shares listed, debuts on NSE with 12% premium'",
    "' eyes September listing after IPO nod'",
    "' Q1 profit surges 42%, beats estimates'",
    "' Q2 revenue up 9% on quarterly growth'",
    "' shares jump 8% after results'",
    "' shares fall 6.5% on weak outlook'",
    "' faces RBI penalty of Rs 5 crore, regulatory probe ongoing'",
    "' lays off 300 in job cuts'",
    "' launches electric vehicle with AI chip'",
    "' appoints new CEO Ritesh Agarwal'",
    "' plans to invest Rs 5,000 crore in capex expansion'",
    "': 5 stocks to watch today'",
    "' and 20 companies to post earnings today'",
    "': should you buy the stock?'",
    "': why markets may rise | Explained'",
    "' success story: how she built the startup'",
    "': Sensex today, market live updates'",
    "' as Sensex rises 700 points after rate hike, inflation cools'",
    "' announces new office in Mumbai'",
    "' merges with rival to form new lender'",
    "' expands into ten new cities'",
    "' partners with global bank on UPI payment'",
    "' faces lawsuit over user data'",
    "': startups raised over $200 million, weekly roundup'",
    "': what to expect today from GDP and inflation data'",
    "' comments on crude oil and Fed rate'",
)
_SOURCES = ("Reuters", "Livemint", "TechCrunch", "SEBI Press Release", "Random Blog", "The Indian Express", "Rediff")


def _pick(key: str, values: tuple[str, ...], quoted: bool = True) -> str:
    return f"case {key} " + " ".join(f"when {i} then {repr(v) if quoted else v}" for i, v in enumerate(values)) + " end"


#: Headlines of an order, in words that both engines read alike.
ARTICLES = {
    "article_id": "o_orderkey",
    "title": f"concat({_pick('o_custkey % 8', _SUBJECTS)}, {_pick('o_orderkey % 30', _TEMPLATES, quoted=False)})",
    "source_name": _pick("o_orderkey % 7", _SOURCES),
    "article_url": "concat('https://Site', cast(o_orderkey % 7 as string), '.Example.com/a/', cast(o_orderkey % 1000 as string), "
    "case o_orderkey % 4 when 0 then '/' when 1 then '?utm_source=x&id=1' when 2 then '?ref=y#top' "
    "else case when o_orderkey % 3 = 0 then '?q=a%20b&c==d&e=' else '?q=a+b&utm_medium=z&c=%3Dd' end end)",
    "country": "case when o_custkey % 3 = 0 then 'India' else 'Global' end",
    "published_at": f"{STAMP} - interval '1' hour * cast(o_orderkey % 3001 as int)",
    "summary": "case when o_custkey % 5 = 0 then 'Analysts in Mumbai expect growth. Revenue rose to Rs 1,200 crore. CEO Karan Shah spoke in India.' else '' end",
}


def _base(d: Dialect, as_of: str) -> dict[str, str]:
    stamp = f"timestamp '{as_of}'"
    return {
        "raw": "concat(title, ' ', coalesce(summary, ''))",
        "low_title": "lower(title)",
        "low_text": "lower(concat(title, ' ', coalesce(summary, '')))",
        "hours": f"greatest(({d.seconds(stamp)} - {d.seconds('published_at')}) / {d.double('3600.0')}, {d.double('0.0')})",
        "source_key": "lower(trim(coalesce(source_name, '')))",
        "plain_title": _clean(d, "title"),
    }


def _clean(d: Dialect, x: str) -> str:
    stripped = d.replace(f"lower(coalesce({x}, ''))", r"[^a-z0-9\s]")
    return f"trim({d.replace(stripped, r'\s+', ' ')})"


_SITE = r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?)"


def _url(d: Dialect) -> dict[str, str]:
    """Pieces of an address: scheme and host in lower case, path, query."""
    plain = d.replace("article_url", r"[\t\r\n]")
    return {
        "url_host": f"lower({d.extract(plain, _SITE)})",
        "url_path": d.extract(plain, _SITE + r"([^?#]*)", 2),
        "url_query": d.extract(plain, r"^[^?#]*\?([^#]*)"),
    }


def _url_joined(d: Dialect) -> dict[str, str]:
    """The address without its fragment, tracking parameters and parameters without a value; what is left of the query is decoded
    and encoded anew, so that forms of one address become one."""
    key, value = d.decoded("split_part(x, '=', 1)"), "substr(x, instr(x, '=') + 1)"
    low = f"lower({key})"
    starts = "starts_with" if d.duck else "startswith"
    kept = d.where(d.split("url_query", "&"), f"instr(x, '=') > 0 and {value} <> '' and not {starts}({low}, 'utm_') and {low} not in ({', '.join(d.lit(t) for t in R.TRACKING)})")
    written = d.each(kept, f"concat({d.encoded(key)}, '=', {d.encoded(d.decoded(value))})")
    path = f"case when length(url_path) > 1 then {d.replace('url_path', '/+$')} else url_path end"
    query = f"case when contains(url_query, '=') then {d.join(written, '&')} else '' end"
    if not d.duck:  # the query is spelled once, since each time it is spelled it is worked out; encoded, it holds no question mark
        return {"clean_url": f"case when coalesce(article_url, '') = '' then '' else concat(url_host, {path}, trim(trailing '?' from concat('?', {query}))) end"}
    return {"clean_url": f"case when coalesce(article_url, '') = '' then '' else concat(url_host, {path}, case when {query} <> '' then concat('?', {query}) else '' end) end"}


def _hashes(d: Dialect) -> dict[str, str]:
    words = d.where(d.split("plain_title", " "), f"x not in ({', '.join(d.lit(w) for w in R.STOPWORDS)})")
    return {"no_stopwords": d.join(words, " ")}


def earnings_kind(d: Dialect) -> str:
    """What a title about results tells of."""
    return f"case when {d.has('low_title', ('profit', 'surges', 'surged'))} then 'PROFIT_UPDATE' when {d.has('low_title', ('revenue',))} then 'REVENUE_UPDATE' else 'EARNINGS' end"


def _classes(d: Dialect) -> dict[str, str]:
    moves, percents = d.hit("low_text", R.MOVE_VERBS), d.count("low_text", R.PERCENT)
    when = []
    tags: list[str] = []
    for name, words in R.CATEGORIES:
        condition = d.hit("low_text", words) if words else f"({percents} >= 2 and {moves})"
        if name == "STOCK":
            condition = f"({condition} or ({percents} = 1 and {moves}))"
        when.append(f"when {condition} then {d.lit(name)}")
    for name, extra in R.CATEGORY_TAGS.items():
        items = [(t, "true" if not w else d.matches("low_text", w) if isinstance(w, str) else d.has("low_text", w)) for t, w in extra]
        tags.append(f"when category_rule = {d.lit(name)} then {d.distinct(d.present((c, t) for t, c in items))}")
    event = [f"when {d.has('low_title', w)} then {d.lit(n)}" for n, w in R.EVENTS_1]
    event.append(f"when {d.has('low_title', R.LISTING)} and not {d.has('low_title', R.LISTING_NOT)} then 'IPO_LISTING'")
    event.append(f"when {d.has('low_title', ('ipo',))} then 'IPO_ANNOUNCEMENT'")
    event.append(f"when {d.has('low_title', R.EARNINGS)} then {earnings_kind(d)}")
    event += [f"when {d.has('low_title', w)} then {d.lit(n)}" for n, w in R.EVENTS_2]
    figure = d.replace("low_title", ",")
    billions, millions = d.extract(figure, r"\$\s*(\d+(?:\.\d+)?)\s*(?:billion|b)\b"), d.extract(figure, r"\$\s*(\d+(?:\.\d+)?)\s*(?:million|m)\b")
    crores, bare = d.extract(figure, r"(?:rs|inr|rupee|rupees|₹)\s*(\d+(?:\.\d+)?)\s*(?:crore|cr|crores)\b"), d.extract(figure, r"\b(\d+(?:\.\d+)?)\s*(?:cr|crores)\b")
    amount = (
        f"case when {billions} <> '' then {d.number(billions)} * {d.double('1000.0')} when {millions} <> '' then {d.number(millions)} "
        f"when {crores} <> '' then {d.number(crores)} / {d.double('8.3')} when {bare} <> '' then {d.number(bare)} / {d.double('8.3')} else {d.double('0.0')} end"
    )
    display = {c: c.upper() if c in R.COMPANIES_UPPER else c.title() for c in R.COMPANIES}
    lexicon = d.present((d.bounded("low_text", (c,)), display[c]) for c in R.COMPANIES)
    known = f"lower(x) not in ({', '.join(d.lit(c) for c in R.NON_COMPANIES)})"
    verbs = d.where(d.distinct(d.extract_all("title", r"\b([A-Z][a-zA-Z0-9&]*(?:\s+[A-Z][a-zA-Z0-9&]*)*)\s+" + R.COMPANY_VERBS)), f"upper(x) not in ({', '.join(d.lit(c) for c in R.COMPANY_STOPS)}) and {known}")
    named = d.distinct(d.extract_all("raw", r"\b" + R.PEOPLE_TITLES + r"\s+([A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)+)\b"))
    return {
        "category_rule": f"case {' '.join(when)} else 'OTHER' end",
        "event_type": f"case {' '.join(event)} else 'OTHER' end",
        "amount": amount,
        "lexicon_companies": d.where(lexicon, known),
        "verb_companies": verbs,
        "lexicon_people": d.present((d.bounded("low_text", (p,)), p.title()) for p in R.PEOPLE),
        "named_people": named,
        "sectors": d.distinct(d.present((d.bounded("low_text", words), s.upper()) for s, words in R.SECTORS.items())),
        "countries": d.distinct(d.present((d.bounded("low_text", (c,)), "United States" if c in ("us", "usa") else c.title()) for c in R.COUNTRIES)),
        "regulators": d.distinct(d.present((d.bounded("low_text", (r,)), r.upper() if len(r) <= 5 else r.title()) for r in R.REGULATORS)),
        "_tags": " ".join(tags),
    }


def _after_classes(d: Dialect, tags: str) -> dict[str, str]:
    empty = f"cast({d.array([])} as {d.array_type()})"
    low = d.each("lexicon_companies", "lower(x)")
    people = d.each("lexicon_people", "lower(x)")
    return {
        "category": "case category_rule when 'MARKET_MOVES' then 'MARKET' else category_rule end",
        "secondary_tags": f"case {tags} else {empty} end",
        "companies": d.distinct(d.plus("lexicon_companies", d.where("verb_companies", f"not {d.within(low, 'lower(x)')}"))),
        "people": d.distinct(d.plus("lexicon_people", d.where("named_people", f"not {d.within(people, 'lower(x)')}"))),
        "tier": f"case when source_key = '' then 4 when {d.has('source_key', R.TIER_1)} then 1 when {d.has('source_key', R.TIER_2)} then 2 when {d.has('source_key', R.TIER_3)} then 3 else 4 end",
        "has_material_event": f"event_type in ({', '.join(d.lit(e) for e in R.CLUSTERABLE)})",
        "has_numbers": f"(amount > 0 or {d.matches('raw', R.NUMBERS, ignore_case=True)})",
        "is_listicle": d.matches("raw", *R.LISTICLE, ignore_case=True),
        "is_filler": d.matches("raw", *R.FILLER, ignore_case=True),
        "is_fluff": d.matches("raw", *R.FLUFF, ignore_case=True),
        "hard_news_anchor": d.matches("raw", R.ANCHOR, ignore_case=True),
        "major_catalyst": f"({d.matches('raw', R.CATALYST, ignore_case=True)} or coalesce({d.number(d.replace(d.extract('raw', R.POINTS), ','))}, {d.double('0.0')}) >= 1000)",
        "ongoing": f"(event_type in ({', '.join(d.lit(e) for e in R.LONG_CYCLE)}) or {d.has('low_text', R.ONGOING)})",
    }


def research_priority(d: Dialect) -> str:
    """How much a source counts in research, by ``source_key``."""
    return f"case when {d.has('source_key', R.TIER_1)} then 100 when {d.has('source_key', R.TIER_2)} then 85 when {d.has('source_key', R.TIER_3)} then 68 when {d.has('source_key', ('general',))} then 42 else 60 end"


def _kinds(d: Dialect) -> dict[str, str]:
    large = "amount >= 1000"
    return {
        "company_count": d.size("companies"),
        "real_companies": d.where(d.each("companies", "lower(x)"), f"x not in ({', '.join(d.lit(c) for c in R.PURE_REGULATORS)})"),
        "content_type": f"""case when {d.matches("raw", *R.CALENDAR, ignore_case=True)} or {d.size("companies")} >= 5 then case when {large} then 'SINGLE_EVENT' else 'CALENDAR' end
            when {d.matches("raw", *R.ROUNDUP, ignore_case=True)} then case when {large} then 'SINGLE_EVENT' else 'ROUNDUP' end
            when {d.matches("raw", *R.ADVICE, ignore_case=True)} then 'ADVICE'
            when {d.matches("raw", *R.OPINION, ignore_case=True)} and not hard_news_anchor then 'OPINION'
            when {d.matches("raw", *R.FORECAST, ignore_case=True)} then 'FORECAST'
            when {d.matches("raw", *R.WRAP, ignore_case=True)} and not major_catalyst then 'MARKET_WRAP'
            when {d.matches("raw", R.MOVE, ignore_case=True)} then 'MARKET_EVENT' else 'SINGLE_EVENT' end""",
        "source_score": "case tier " + " ".join(f"when {t} then {s}" for t, s in R.TIER_SCORES.items()) + " end",
        "research_priority": research_priority(d),
        "has_shape": "(is_listicle or is_filler or is_fluff)",
        "noise_reasons": d.plus(
            d.present((("is_listicle", R.NOISE_LISTICLE), ("is_filler", R.NOISE_FILLER), ("is_fluff", R.NOISE_FLUFF))),
            d.present((
                (f"not (is_listicle or is_filler or is_fluff) and not has_material_event and not has_numbers and {d.size('companies')} = 0", R.NOISE_EMPTY),
                ("(is_listicle or is_filler or is_fluff) and not has_material_event and not has_numbers", R.NOISE_BARE),
                ("(is_listicle or is_filler or is_fluff) and (has_material_event or has_numbers)", R.NOISE_GROUNDED),
            )),
        ),
    }


def _parts(d: Dialect) -> dict[str, str]:
    place = d.each("companies", "concat(lpad(cast(case when instr(low_text, lower(x)) = 0 then 99999 else instr(low_text, lower(x)) end as string), 6, '0'), x)")
    main = f"case when content_type in ('ROUNDUP', 'CALENDAR') or {d.size('companies')} = 0 or {d.size('companies')} > 3 then null else substr({d.least(place)}, 7) end"
    country = f"case when {d.size('countries')} > 0 then {d.least('countries')} else country end"

    def steps(pairs, default: int) -> str:
        return "case " + " ".join(f"when {d.has('low_text', w)} then {v}" for v, w in pairs) + f" else {default} end"

    aged = [("hours <= 6", "1.0", "1.0"), ("hours <= 24", "0.95", "0.95"), ("hours <= 48", "0.85", "0.85"), ("hours <= 168", "0.65", "0.65"), ("hours <= 720", "0.5", "0.35"), ("hours <= 2160", "0.25", "0.15"), ("true", "0.10", "0.05")]
    return {
        "main_company": main,
        "main_country": country,
        "market_impact": steps(R.IMPACT, 5),
        "financial_significance": f"case when amount >= 1000 then 20 when amount >= 100 then 17 when amount >= 10 then 12 when amount > 0 then 8 when {d.has('low_text', ('billion',))} then 15 when {d.hit('low_text', ('million', 'crore', 'cr'))} then 10 else 2 end",
        "novelty": steps(R.NOVEL, 5),
        "audience_interest": f"case when {d.has('low_text', R.AUDIENCE)} then 14 when {d.hit('low_text', R.AUDIENCE_2)} then 11 else 5 end",
        "discussion_potential": steps(((13, R.DISCUSSION), (10, R.DISCUSSION_2)), 5),
        "source_confidence_sub": d.whole(f"source_score / {d.double('10.0')}"),
        "freshness_bonus": "case when published_at is null then 0 when hours <= 1 then 10 when hours <= 3 then 8 when hours <= 6 then 6 when hours <= 12 then 4 when hours <= 24 then 2 else 0 end",
        "staleness_multiplier": f"case when published_at is null then {d.double('1.0')} " + " ".join(f"when {c} then case when ongoing then {d.double(a)} else {d.double(b)} end" for c, a, b in aged) + " end",
        "is_noise": "(not has_shape and not has_material_event and not has_numbers and company_count = 0) or (has_shape and not has_material_event and not has_numbers)",
        "noise_penalty": "case when not has_shape then case when not has_material_event and not has_numbers and company_count = 0 then 30 else 0 end when not has_material_event and not has_numbers then 45 else 15 end",
        "content_penalty": "case when content_type in ('SINGLE_EVENT', 'MARKET_EVENT') then 0 when amount >= 1000 then 10 else 22 end",
    }


def _relevance(d: Dialect) -> dict[str, str]:
    money = d.matches("low_text", r"\b(?:" + "|".join(R.INDIA_MONEY) + r")\b")
    direct = (
        f"case when contains(lower(coalesce(main_country, '')), 'india') then 35 else 0 end + case when {d.has('low_text', R.INDIA)} then 45 else 0 end"
        f" + case when {money} then 15 else 0 end + case when {d.has('low_text', R.CITIES)} then 10 else 0 end + case when company_count > 0 then 20 else 0 end"
        f" + case when {d.within('countries', d.lit('India'))} then 15 else 0 end"
    )
    return {"direct_relevance": direct, "macro": d.has("low_text", R.GLOBAL_MACRO)}


def _multipliers(d: Dialect) -> dict[str, str]:
    return {
        "india_relevance": "case when direct_relevance = 0 and macro then 55 else least(100, direct_relevance) end",
        "title_has_money": f"(amount > 0 or {d.has('low_title', R.MONEY_TOKENS)})",
        "has_brand": d.has("low_text", R.BRANDS),
        "has_share_word": d.has("low_text", R.SHARE_WORDS),
        "has_hot_topic": d.has("low_text", ("ipo", "funding", "startup")),
    }


def _scores(d: Dialect) -> dict[str, str]:
    relevance = "case when india_relevance >= 70 then {} when india_relevance >= 45 then {} when india_relevance >= 25 then {} else {} end".format(*(d.double(x) for x in ("1.15", "1.0", "0.8", "0.6")))
    total = "cast(market_impact + financial_significance + novelty + audience_interest + discussion_potential + source_confidence_sub + freshness_bonus as double)"
    return {
        "relevance_multiplier": relevance,
        "importance_score": f"least(greatest({d.even(f'{total} * ({relevance}) * staleness_multiplier')} - noise_penalty - content_penalty, 0), 100)",
        "postability_score": "least(greatest(30 + case when has_brand then 25 else 0 end + case when title_has_money then 20 else 0 end + case when has_share_word then 15 else 0 end"
        f" + case when has_hot_topic then 10 else 0 end - {d.whole(f'noise_penalty * {d.double("0.6")}')}, 0), 100)",
        "confidence_score": "least(source_score + case when source_count = 2 then 15 when source_count >= 3 then 25 else 0 end, 100)",
    }


def _final(d: Dialect) -> dict[str, str]:
    half, third, rest = (d.double(x) for x in ("0.50", "0.35", "0.15"))
    ratio = {c: f"({c} / {d.double(f'{m}.0')})" for c, m, _ in R.REASONS}
    best = f"greatest({', '.join(ratio.values())})"
    why = " ".join(f"when {ratio[c]} = {best} then {d.lit(said)}" for c, _, said in R.REASONS)
    reasons = d.join("noise_reasons", "; ")
    first = f"split_part({reasons}, '; ', 1)"
    return {
        "final_score": f"least(greatest({d.whole(f'importance_score * {half} + postability_score * {third} + confidence_score * {rest}')}, 0), 100)",
        "key_reason": f"case when noise_penalty >= 30 then concat('Down-ranked: ', {first}, '.') {why} end",
        "rating_market_relevance": d.tenth(f"least(market_impact / {d.double('25.0')}, {d.double('1.0')}) * 10"),
        "rating_financial_materiality": d.tenth(f"least(financial_significance / {d.double('20.0')}, {d.double('1.0')}) * 10"),
        "rating_india_relevance": d.tenth(f"india_relevance / {d.double('10.0')}"),
        "rating_source_quality": d.tenth(f"source_score / {d.double('10.0')}"),
        "rating_investor_relevance": d.tenth(f"least((audience_interest + discussion_potential) / {d.double('30.0')}, {d.double('1.0')}) * 10"),
    }


def _status(d: Dialect) -> dict[str, str]:
    return {
        "status": "case when final_score >= 40 then 'READY_FOR_REVIEW' else 'FILTERED' end",
        "priority_band": "case when final_score >= 75 then 'high' when final_score >= 40 then 'medium' else 'low' end",
        "badge": "case when hours <= 3 and final_score >= 75 then 'BREAKING' when event_type = 'REGULATORY_ACTION' then 'REGULATORY' when event_type in ('ACQUISITION', 'MERGER') then 'M&A'"
        " when event_type like 'IPO%' then 'IPO' when event_type in ('EARNINGS', 'PROFIT_UPDATE', 'REVENUE_UPDATE') then 'EARNINGS'"
        " when event_type = 'STOCK_MOVEMENT' and final_score >= 60 then 'MARKET MOVING' when final_score >= 85 then 'HIGH IMPACT' end",
        "content_hash": "md5(no_stopwords)",
    }


def layers(d: Dialect, as_of: str = AS_OF) -> list[dict[str, str]]:
    classes = _classes(d)
    tags = classes.pop("_tags")
    return [_base(d, as_of), _url(d), _url_joined(d), _hashes(d), classes, _after_classes(d, tags), _kinds(d), _parts(d), _relevance(d), _multipliers(d), _scores(d), _final(d), _status(d)]


def dealt(df: DataFrame) -> DataFrame:
    """The rows on as many partitions as there are cores, where the files have fewer splits: what follows costs far more
    than to move the raw rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed articles, each with one source."""
    return dealt(columns_of(spark, f"{sf_dir}/orders.parquet", "o_orderkey", "o_custkey", "o_totalprice")).select(*(F.expr(e).alias(n) for n, e in ARTICLES.items()))


def process(df: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """All derived columns, as of a time, of articles that have ``source_count``.

    Null titles and summaries read as empty; a null time gives no freshness and no ageing. Rows aren't compared.
    """
    df = df.withColumns({"title": F.coalesce("title", F.lit("")), "summary": F.coalesce("summary", F.lit(""))})
    for layer in layers(SPARK, as_of):
        df = df.select("*", *(F.expr(e).alias(n) for n, e in layer.items()))
    return df


#: Partitions that distinct texts are dealt into, for each core: work goes by texts and not by bytes.
TEXT_PARTS = 4


def told(whole: list[dict[str, str]]) -> tuple[list[dict[str, str]], list[dict[str, str]]]:
    """Layers in two: the columns that title and summary alone decide, and the others."""
    apart, texts, rest = set(RAW) - {"title", "summary"}, [], []
    for layer in whole:
        own = {n for n, e in layer.items() if apart.intersection(re.findall(r"\w+", e))}
        apart |= own
        texts.append({n: e for n, e in layer.items() if n not in own})
        rest.append({n: e for n, e in layer.items() if n in own})
    return texts, rest


def processed_texts(df: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """As ``process``, of a table, with ``text_id``, the least id of the articles of the same title and summary: what these alone
    decide, nearly all of the work, is found once for each text and joined. The join splits hot texts."""
    df = df.withColumns({"title": F.coalesce("title", F.lit("")), "summary": F.coalesce("summary", F.lit(""))})
    text_layers, layers_left = told(layers(SPARK, as_of))
    parts = TEXT_PARTS * df.sparkSession.sparkContext.defaultParallelism
    texts = df.groupBy("title", "summary").agg(F.min("article_id").alias("text_id")).repartition(parts, "title", "summary")
    for layer in text_layers:
        texts = texts.select("*", *(F.expr(e).alias(n) for n, e in layer.items()))
    df = df.join(texts.hint("merge"), ["title", "summary"])
    for layer in layers_left:
        df = df.select("*", *(F.expr(e).alias(n) for n, e in layer.items()))
    return df


#: Hours of age at which freshness or staleness change.
AGE_EDGES = (1, 3, 6, 12, 24, 48, 168, 720, 2160)
#: What an article has before it is processed.
RAW = ("article_id", "title", "source_name", "article_url", "country", "published_at", "summary", "source_count")


def crossing(earlier: str, later: str) -> str:
    """SQL: whether an article's age crosses an edge between two times, as ranges of ``published_at``, which a scan prunes by."""
    ranges = (f"(published_at >= timestamp '{earlier}' - interval '{e}' hour and published_at < timestamp '{later}' - interval '{e}' hour + interval '1' second)" for e in AGE_EDGES)
    return f"({' or '.join(ranges)})"


def rescored(stored: DataFrame, earlier: str, later: str) -> DataFrame:
    """Stories as of ``later``, from those stored as of ``earlier``: only articles whose age crosses an edge in between are
    processed again; of the others, no score depends on the time. The columns that tell the age itself and the badge,
    which follows it by the hour, aren't given."""
    timed = ("hours", "badge")
    columns = [c for c in stored.columns if c not in timed]
    old = stored.where(f"published_at is null or not {crossing(earlier, later)}").select(*columns)
    new = processed_texts(stored.where(crossing(earlier, later)).select(*RAW), later).select(*columns)
    return old.unionByName(new)


def stories(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    return processed_texts(articles(spark, sf_dir).withColumn("source_count", F.lit(1)), as_of)


ARTICLES_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in ARTICLES.items()) + " from orders"


def stories_sql(as_of: str = AS_OF) -> str:
    """A DuckDB query of all stories."""
    sql = f"select *, 1 as source_count from ({ARTICLES_SQL})"
    for layer in layers(DUCK, as_of):
        sql = f"select *, {', '.join(f'{e} as {n}' for n, e in layer.items())} from ({sql})"
    return sql
