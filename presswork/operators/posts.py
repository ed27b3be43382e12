"""Post candidates: grounded hooks, their checks and scores, and the choice of one for each story."""

from __future__ import annotations

import difflib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from presswork.functions import rules as R
from presswork.functions.dialect import SPARK, Dialect
from presswork.operators.similar import seq_ratio
from presswork.plans.stories import research_priority
from presswork.sources.feeds import drop_incomplete, split_publisher

# --- fixed values: limits, weights and patterns ---
LIMIT, REWRITE, ALIKE, MOST_ALTERNATES = 280, 0.72, 0.85, 3
PERCENT_FACTS = ("stock_movement", "percentage")
INVESTOR_EVENTS = ("FUNDING", "IPO_FILING", "IPO_ANNOUNCEMENT", "IPO_PRICING", "INVESTMENT")
BREAKING_EVENTS = ("IPO_LISTING", "REGULATORY_ACTION")
SECOND_EVENTS = ("ACQUISITION", "MERGER", "STOCK_MOVEMENT", "POLICY_CHANGE")
MALFORMED = r"\{[\"']|\[\"|```|<\|.*?\|>|\{\{.*?\}\}|\[INSERT|as an ai language model|i cannot |i can.?t assist|undefined|NaN%|None%"
CLICKBAIT = (
    r"\b(you won.?t believe|shocking|must[- ]?see|mind[- ]?blowing|game[- ]?changer|insane|unbelievable|jaw[- ]?dropping|breaking news!!+|"
    r"act now|don.?t miss)\b"
)
PUNCTUATION = r"!!!+|(?:![^!]{0,20}){2,}"
CAPITALS = r"\b(?:[A-Z]{4,}\b\W+){2,}[A-Z]{4,}\b"
CUES = r"^\W*(here.?s|why|how|nobody|is\s|the\s+(bigger|real|immediate)|that.?s\s+the\s+number|isn.?t\s+the|just\s+made|could\s+(change|reshape))\b"
CONTRAST = r"\?|→|but the|isn.?t the|second-order"
NUMBER = r"\d+(?:\.\d+)?\s*%|[$₹]\s*[\d.]+\s*[BMK]?|\b\d+(?:\.\d+)?\s*(cr|crore|lakh|billion|million)\b"
INVESTOR = r"\b(investor|stock|shares|market|valuation|growth|revenue|profit|consequence|impact)\b"
WEIGHTS = {
    "has_hook": 20,
    "adds_info": 25,
    "has_numbers": 15,
    "has_angle": 15,
    "within_limit": 10,
    "grounded_numbers": 10,
    "not_empty": 3,
    "strong_opening": 2,
    "acceptable": 15,
    "no_repetition": 5,
}
CANDIDATE, MOST_SOURCES = 0.5, 6
NEWS_HOST = "news.google.com"
MONEY_FACTS = ("funding_amount", "valuation", "acquisition_value", "ipo_size", "revenue", "profit", "loss")
#: Of each event: the fact that the opening names, the opening with and without it, and the plain line after it.
BASELINE = {
    "FUNDING": ("funding_amount", "\U0001f4b0 {who} just landed {fact} in funding!", "\U0001f4b0 {who} just landed fresh funding!", "That's fresh cash to grow faster, hire more people, and expand."),
    "ACQUISITION": ("acquisition_value", "\U0001f91d Big deal: {who} is buying another company for {fact}.", "\U0001f91d Big deal: {who} just acquired another company.", "One company is taking over another — expect changes ahead."),
    "IPO_FILING": ("ipo_size", "\U0001f4c8 {who} is going public! Filing to raise {fact}.", "\U0001f4c8 {who} is going public!", "Soon, regular investors will be able to buy a piece of {who} on the stock market."),
    "IPO_ANNOUNCEMENT": ("ipo_size", "\U0001f4c8 {who} is going public! Filing to raise {fact}.", "\U0001f4c8 {who} is going public!", "Soon, regular investors will be able to buy a piece of {who} on the stock market."),
    "IPO_LISTING": (None, "", "\U0001f514 Big day: {who} just hit the stock market!", "You can now buy or sell {who} shares like any other stock."),
    "REGULATORY_ACTION": (None, "", "⚠️ {who} just got in trouble with regulators.", "That usually means rules were broken — a fine or restrictions could follow."),
    "LAYOFF": (None, "", "\U0001f4c9 {who} is cutting jobs.", "A sign the company is trying to cut costs and tighten its belt."),
}
RESULT_EVENTS = ("PROFIT_UPDATE", "REVENUE_UPDATE", "EARNINGS")
RESULTS = ("\U0001f4b0 {who}'s results are in — {label} of {fact}.", "\U0001f4b0 {who} just reported its latest results.", "This shows how {who} is actually doing financially.")
MOVES = (
    ("\U0001f4c8 {who} stock is on fire — up {moved}% today!", "Investors are feeling good about {who} right now."),
    ("\U0001f4c9 {who} stock just dropped {moved}%.", "Investors are worried about {who} right now."),
)
IN_FOCUS, HEADLINE = "\U0001f4ca {who} shares are in focus today.", "\U0001f4f0 {title}"
#: The hook of each strategy.
HOOKS = {
    "number_led": "{fact}. That's the {label} figure {who} just put on the board.",
    "consequence_negative": "This could change how investors look at {who} next quarter.",
    "consequence_positive": "This could reshape {who}'s next growth phase.",
    "contrast": "{who} stock {direction} {moved}% today. But the real story is what's underneath it →",
    "curiosity": "There's one number in {who}'s update most headlines are missing.",
    "investor_angle": "Why are investors suddenly paying attention to {who}?",
    "breaking": "{who} just made a move that could reshape what comes next.",
    "data_led": "{first} isn't the biggest surprise here. {second} is.",
    "question": "Is {company} turning a corner, or is this a one-off?",
    "second_order": "The immediate reaction is obvious. The second-order effect is more interesting.",
}


def printf(d: Dialect, form: str, x: str) -> str:
    return f"{'printf' if d.duck else 'format_string'}('{form}', {x})"


def amount(d: Dialect, value: str, currency: str) -> str:
    """A short amount of money."""
    sign = f"case when {currency} = 'USD' then '$' else '₹' end"
    grouped = f"format('{{:,}}', cast({d.even(value)} as bigint))" if d.duck else f"format_number({value}, 0)"
    return (
        f"case when coalesce({currency}, 'INR') = 'INR' and {value} >= 10000000 then concat({sign}, {printf(d, '%.1f', f'{value} / {d.double("10000000.0")}')}, 'Cr') "
        f"when {value} >= 1000000000 then concat({sign}, {printf(d, '%.2f', f'{value} / {d.double("1000000000.0")}')}, 'B') "
        f"when {value} >= 1000000 then concat({sign}, {printf(d, '%.1f', f'{value} / {d.double("1000000.0")}')}, 'M') else concat({sign}, {grouped}) end"
    )


def shown(d: Dialect, kind: str, value: str, currency: str) -> str:
    """A fact's value in a post."""
    return f"case when {kind} in ('stock_movement', 'percentage') then concat({printf(d, '%.1f', f'abs({value})')}, '%') when {kind} = 'subscription_number' then concat({printf(d, '%.1f', value)}, 'x') else {amount(d, value, currency)} end"


def filled(d: Dialect, form: str, **parts: str) -> str:
    """SQL: a template whose names in braces are replaced by expressions."""
    pieces, rest = [], form
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            pieces.append(d.lit(head))
        name, _, rest = tail.partition("}") if brace else ("", "", "")
        if name:
            pieces.append(parts[name])
    return f"concat({', '.join(pieces)})"


def hook(d: Dialect) -> str:
    """The text of ``strategy`` for a story with its first two facts; null where it isn't eligible."""
    who = "coalesce(main_company, 'This company')"
    label = "trim(replace(replace(kind_1, '_', ' '), 'amount', ''))"
    title = "concat(upper(substr({0}, 1, 1)), substr({0}, 2))"

    def titled(kind: str) -> str:
        first, second = f"split_part({kind}, '_', 1)", f"split_part({kind}, '_', 2)"
        return f"concat({title.format(first)}, case when {second} = '' then '' else concat(' ', {title.format(second)}) end)"

    def within(events: tuple[str, ...]) -> str:
        return f"event_type in ({', '.join(d.lit(e) for e in events)})"

    parts = {
        "who": who, "label": label, "company": "main_company", "fact": shown(d, "kind_1", "value_1", "currency_1"), "moved": printf(d, "%.1f", "abs(moved)"),
        "direction": "case when moved >= 0 then 'jumped' else 'fell' end", "first": titled("kind_1"), "second": titled("kind_2"),
    }
    eligible = (
        ("number_led", "kind_1 is not null and kind_1 not in ('stock_movement', 'percentage')", "number_led"),
        ("consequence", "impact = 'negative'", "consequence_negative"), ("consequence", "impact = 'positive'", "consequence_positive"),
        ("contrast", "moved is not null", "contrast"), ("curiosity", "kind_1 is not null", "curiosity"), ("investor_angle", within(INVESTOR_EVENTS), "investor_angle"),
        ("breaking", within(BREAKING_EVENTS), "breaking"), ("data_led", "kind_2 is not null", "data_led"), ("question", "main_company is not null", "question"),
        ("second_order", within(SECOND_EVENTS), "second_order"),
    )
    return "case " + " ".join(f"when strategy = '{strategy}' and {condition} then {filled(d, HOOKS[name], **parts)}" for strategy, condition, name in eligible) + " else null end"


def post(d: Dialect) -> str:
    """A hook with the first fact behind it, where that fits and the hook doesn't hold it."""
    fact = f"concat(hook, ' (', replace(kind_1, '_', ' '), ': ', {shown(d, 'kind_1', 'value_1', 'currency_1')}, ')')"
    return f"case when strategy in ('number_led', 'contrast', 'data_led') or kind_1 is null or length({fact}) > {LIMIT} then hook else {fact} end"


def truncated(d: Dialect, x: str, most: int = LIMIT) -> str:
    """A text cut to a length, with an ellipsis where something is cut off."""
    return f"case when length(trim({x})) <= {most} then trim({x}) else concat(rtrim(substr(trim({x}), 1, {most - 1})), '…') end"


def source_line(d: Dialect) -> str:
    """The address of a story, or its source's name where the address is a redirect."""
    return f"case when coalesce(article_url, '') = '' then null when contains(article_url, '{NEWS_HOST}') then case when coalesce(source_name, '') <> '' then concat('Source: ', source_name) end else concat('Source: ', article_url) end"


def guarded(d: Dialect, company: str = "main_company") -> str:
    """The company, unless the name is a wire service's, a regulator's or a publication's."""
    return f"case when {company} = '' or lower({company}) in ({', '.join(d.lit(c) for c in R.NON_COMPANIES)}) then null else {company} end"


#: Facts that a baseline post may name: the first of each type, as struct p (place), v (value), c (currency).
NAMED = ("funding_amount", "acquisition_value", "ipo_size", "stock_movement", "profit", "revenue")


def baseline(d: Dialect) -> list[dict[str, str]]:
    """Layers over a story with the NAMED facts and ``numbers``, its numeric facts in order (structs p, k, v, c): the opening,
    the plain line, the post, its thread and the image's lines."""

    hooks, lines, used = [], [], []
    for event, (kind, with_fact, without, line) in BASELINE.items():
        if kind:
            hooks.append(f"when event_type = '{event}' and {kind} is not null then {filled(d, with_fact, who='who', fact=amount(d, f'{kind}.v', f'{kind}.c'))}")
            used.append(f"when event_type = '{event}' then {kind}.p")
        hooks.append(f"when event_type = '{event}' then {filled(d, without, who='who')}")
        lines.append(f"when event_type = '{event}' then {filled(d, line, who='who')}")
    moved = printf(d, "%.1f", "abs(stock_movement.v)")
    for sign, (opening, line) in zip((">= 0", "< 0"), MOVES):
        when = f"when event_type = 'STOCK_MOVEMENT' and stock_movement.v {sign} then "
        hooks.append(when + filled(d, opening, who="who", moved=moved))
        lines.append(when + filled(d, line, who="who"))
    hooks.append(f"when event_type = 'STOCK_MOVEMENT' then {filled(d, IN_FOCUS, who='who')}")
    used.append("when event_type = 'STOCK_MOVEMENT' then stock_movement.p")
    results = f"event_type in ({', '.join(d.lit(e) for e in RESULT_EVENTS)})"
    for kind in ("profit", "revenue"):
        hooks.append(f"when {results} and {kind} is not null then {filled(d, RESULTS[0], who='who', label=d.lit(kind), fact=amount(d, f'{kind}.v', f'{kind}.c'))}")
    hooks.append(f"when {results} then {filled(d, RESULTS[1], who='who')}")
    lines.append(f"when {results} then {filled(d, RESULTS[2], who='who')}")
    used.append(f"when {results} then coalesce(profit.p, revenue.p)")
    named = "case x.k " + " ".join(f"when '{k}' then '{k.replace('_', ' ').title()}'" for k in MONEY_FACTS) + " end"
    others = d.where("numbers", "used is null or x.p <> used")
    shown_facts = d.join(d.each(f"({others})[1:2]" if d.duck else f"slice({others}, 1, 2)", f"concat({named}, ': ', {amount(d, 'x.v', 'x.c')})"), " | ")
    both = "case when line is null then hook else concat(hook, ' ', line) end"
    overflow = f"case when length(both_lines) > {LIMIT} then {truncated(d, 'line')} end"
    thread = d.array((overflow, f"case when shown <> '' then {truncated(d, 'shown')} end", truncated(d, "source_line")))
    present = d.where(thread, "x is not null")
    return [
        {"who": f"coalesce({guarded(d)}, 'This company')"},
        {"hook": f"case {' '.join(hooks)} else {filled(d, HEADLINE, title='title')} end", "line": f"case {' '.join(lines)} end", "used": f"case {' '.join(used)} end"},
        {"both_lines": both, "shown": shown_facts, "source_line": source_line(d)},
        {
            "post_text": f"case when length(both_lines) <= {LIMIT} then {truncated(d, 'both_lines')} else {truncated(d, 'hook')} end",
            "thread": d.join(present, "\n"),
            "image_headline": truncated(d, "coalesce(nullif(main_company, ''), title)", 60),
            "image_subheadline": truncated(d, "coalesce(category, '')", 60),
        },
    ]


def match_candidates(stories: DataFrame, entries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(article_id, position, title, source_name, link, priority)``: of found ``entries`` (with the story's ``article_id``, in the
    order of ``position``) those whose title, without what stands behind its last dash, is like the story's, each link once and
    none that ``known`` (article_id, link) has.

    A story takes them until it has MOST_SOURCES with those it ``held``, and always the first, since it is full only when one is
    added. Entries without a title or link are left out.
    """
    rows = split_publisher(drop_incomplete(entries.withColumnRenamed("link", "article_url")).withColumn("source_name", F.lit("Google News")), below=None)
    rows = rows.join(stories.selectExpr("article_id", "plain_title", "held"), "article_id").withColumn("link", F.trim("article_url"))
    if known is not None:
        rows = rows.join(known.select("article_id", F.trim("link").alias("link")).distinct(), ["article_id", "link"], "left_anti")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("title"), r"[^a-z0-9\s]", ""), r"\s+", " "))
    like = rows.withColumn("ratio", seq_ratio("plain_title", plain)).where(F.col("ratio") >= CANDIDATE)
    first = like.withColumn("n", F.row_number().over(W.partitionBy("article_id", "link").orderBy("position"))).where("n = 1")
    taken = first.withColumn("n", F.row_number().over(W.partitionBy("article_id").orderBy("position"))).where(f"n <= greatest(1, {MOST_SOURCES} - held)")
    keyed = taken.withColumn("source_key", F.lower(F.trim("source_name")))
    return keyed.select("article_id", "position", "title", "source_name", "link", F.expr(research_priority(SPARK)).alias("priority"))


def reject_reason(d: Dialect, x: str) -> str:
    """Why a text can't be a post; null if it can."""
    return (
        f"case when trim(coalesce({x}, '')) = '' then 'empty output' when length(trim({x})) < 8 then 'suspiciously short output' "
        f"when {d.matches(x, MALFORMED.replace(chr(39), '.'), ignore_case=True)} then 'malformed output (code/JSON artifact, template placeholder, or model refusal text)' "
        f"when {d.matches(x, CLICKBAIT, ignore_case=True)} then 'clickbait/promotional language' when {d.matches(x, PUNCTUATION)} then 'excessive punctuation (promotional tone)' "
        f"when {d.matches(x, CAPITALS)} then 'excessive capitalization (shouting)' end"
    )


def checks(d: Dialect) -> dict[str, str]:
    """Checks of ``post`` for a story, but for the comparison with its headline (``similarity``)."""
    cue = d.matches("post", CUES, ignore_case=True)
    has_number = d.matches("post", NUMBER, ignore_case=True)
    return {
        "has_hook": f"({cue} or {d.matches('post', CONTRAST, ignore_case=True)})",
        "adds_info": f"(similarity < {REWRITE})",
        "has_numbers": has_number,
        "has_angle": d.matches("post", INVESTOR, ignore_case=True),
        "within_limit": f"(length(post) <= {LIMIT})",
        "grounded_numbers": f"(not {has_number} or kind_1 is not null)",
        "not_empty": "(trim(post) <> '')",
        "strong_opening": f"(not {'starts_with' if d.duck else 'startswith'}(lower(trim(post)), substr(lower(trim(title)), 1, 20)))",
        "acceptable": f"({reject_reason(d, 'post')} is null)",
        "no_repetition": f"(main_company is null or (length(post) - length(replace(lower(post), lower(main_company), ''))) <= 2 * length(main_company))",
    }


def candidates(stories: DataFrame, first_facts: DataFrame) -> DataFrame:
    """``article_id, strategy, position, post`` and the story's columns: every eligible hook of every story.

    ``stories`` has ``angles`` (array), ``impact`` and what hooks name; ``first_facts`` has one row for each story.
    """
    rows = stories.join(first_facts, "article_id", "left").select("*", F.posexplode("angles").alias("position", "strategy"))
    hooks = rows.withColumn("hook", F.expr(hook(SPARK))).where("hook is not null")
    return hooks.withColumn("post", F.expr(post(SPARK)))


def scored(rows: DataFrame) -> DataFrame:
    """Add ``similarity`` to the headline, the checks and ``quality``."""
    cleaned = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""), r"\s+", " "))
    rows = rows.withColumn("similarity", seq_ratio(cleaned("post"), cleaned("title")))
    rows = rows.withColumns({n: F.expr(e) for n, e in checks(SPARK).items()})
    total = sum((F.col(n).cast("int") * w for n, w in WEIGHTS.items()), F.lit(0))
    return rows.withColumn("quality", F.least(total, F.lit(100)))


def select_post(rows: DataFrame) -> DataFrame:
    """The best acceptable candidate of a story, ties in their order; a framed headline where none is left."""
    best = W.partitionBy("article_id").orderBy(F.desc("quality"), "position")
    good = rows.where("adds_info and acceptable").withColumn("n", F.row_number().over(best)).where("n = 1").select("article_id", "strategy", "post", "quality")
    rest = rows.select("article_id", "title").distinct().join(good, "article_id", "left_anti")
    framed = rest.select("article_id", F.lit("explainer").alias("strategy"), F.concat(F.lit("Here's what just happened: "), "title").alias("post"), F.lit(None).cast("int").alias("quality"))
    return good.unionByName(framed)


def diverse_alternates(rows: DataFrame) -> DataFrame:
    """``(article_id, place, post)``: after the best one, further candidates unlike all that are kept.

    A story has a few candidates at most, so a group is small.
    """

    @pandas_udf("array<string>")
    def unlike(ranked: pd.Series) -> pd.Series:
        return pd.Series([_unlike(texts) for texts in ranked])

    good = rows.where("adds_info and acceptable").select("article_id", F.struct((-F.col("quality")).alias("q"), "position", "post").alias("c"))
    listed = good.groupBy("article_id").agg(F.array_sort(F.collect_list("c")).alias("c")).select("article_id", unlike(F.col("c.post")).alias("kept"))
    return listed.select("article_id", F.posexplode("kept").alias("place", "post")).select("article_id", F.col("place").cast("long").alias("place"), "post")


def _unlike(texts: Iterable[str]) -> list[str]:
    kept: list[str] = []
    for text in texts:
        if len(kept) <= MOST_ALTERNATES and all(difflib.SequenceMatcher(None, text.lower(), k.lower()).ratio() < ALIKE for k in kept):
            kept.append(text)
    return kept
