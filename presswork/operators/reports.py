"""Text reports of stories."""

from __future__ import annotations

from presswork.functions import rules as R
from presswork.functions.dialect import Dialect
from presswork.operators.posts import printf

# --- fixed values: the wording of a report ---
HAPPENED = "Reports indicate that {title}. This event has been tracked and analyzed across multiple news publications."
NO_NUMBERS = "- *No numerical metrics confidently isolated from body content.*"
CHECKED = "We evaluated and cross-checked the following sources:"
AGREED = "- *No high-severity fact conflicts detected. Publications are in alignment.*"
BANDS = (
    (80, "This report has HIGH confidence due to consensus agreement across reputable sources."),
    (50, "This report has MEDIUM confidence. Sources are generally reliable, but metrics may represent secondary reporting."),
    (0, "This report has LOW confidence. Verify core numbers manually before drafting content."),
)
#: Heads of the sections, the first with the title behind it, and lines that name a value.
TITLE = "# Research Report: "
HEADS = ("## WHAT HAPPENED", "## KEY FACTS", "## IMPORTANT NUMBERS", "## ENTITIES", "## WHY IT MATTERS", "## SOURCE VERIFICATION", "## CONFLICTS DETECTED", "## RESEARCH CONFIDENCE")
FACT_LINES = (("- **Primary Company**: ", "coalesce(main_company, 'Generic')"), ("- **Category**: ", "category"), ("- **Event Action**: ", "event_type"))
ENTITY_LINES = (("- **Companies**: ", "companies", "None identified"), ("- **Sectors**: ", "sectors", "None identified"), ("- **Countries**: ", "countries", "Global"))
SOURCE_LINES = ("1. **[", "]**: ", "   - URL: ", "   - Priority Rating: ", "/100 (Extraction Status: COMPLETED)")
RATING_LINE = ("**Confidence Rating: ", "/100**")
REPORTED = (*R.NUMERIC_FACTS, "ipo_price_band")
UNITS = {"stock_movement": " percentage", "subscription_number": " times"}


def fact_line(d: Dialect) -> str:
    """A line for one fact."""
    name = "case fact_type " + " ".join(f"when '{k}' then '{k.replace('_', ' ').title()}'" for k in REPORTED) + " end"
    unit = "case fact_type " + " ".join(f"when '{k}' then '{u}'" for k, u in UNITS.items()) + " else '' end"
    value = f"coalesce(text_value, {printf(d, '%.1f', 'num_value')})"
    return f"concat('- **', {name}, '**: ', original_value, ' (Normalized: ', {value}, {unit}, ')')"


def report(d: Dialect, why: str) -> str:
    """The report of a story with ``numbers`` (its fact lines, or null) that one source has told."""
    happened, facts, numbers, entities, matters, checked, conflicts, confidence = (d.lit(h) for h in HEADS)
    open_name, close_name, url, rating, extracted = (d.lit(x) for x in SOURCE_LINES)
    before, after = (d.lit(x) for x in RATING_LINE)
    named = (f"concat({d.lit(label)}, case when {d.size(column)} > 0 then {d.join(column, ', ')} else '{none}' end)" for label, column, none in ENTITY_LINES)
    bands = "case " + " ".join(f"when confidence_score >= {least} then {d.lit(said)}" for least, said in BANDS) + " end"
    sections = (
        (f"concat({d.lit(TITLE)}, title)",),
        (happened, f"case when summary <> '' then summary else replace({d.lit(HAPPENED)}, '{{title}}', title) end"),
        (facts, *(f"concat({d.lit(label)}, {value})" for label, value in FACT_LINES)),
        (numbers, f"coalesce(numbers, {d.lit(NO_NUMBERS)})"),
        (entities, *named),
        (matters, why),
        (checked, d.lit(CHECKED), f"concat({open_name}, source_name, {close_name}, title)", f"concat({url}, article_url)", f"concat({rating}, cast(research_priority as string), {extracted})"),
        (conflicts, d.lit(AGREED)),
        (confidence, f"concat({before}, cast(confidence_score as string), {after})", "''", bands),
    )
    return "concat(" + ", chr(10), chr(10), ".join(", chr(10), ".join(lines) for lines in sections) + ")"
