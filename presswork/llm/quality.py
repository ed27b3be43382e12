"""Quality rules kept as a ledger of failure bits.

Every rule is evaluated once for each document; the ledger holds the measurements and one bit for each failed rule.
A policy is a named, versioned set of rules, so judging by another policy, or asking what a rule alone removes,
needs only bitwise work on the ledger and never the texts again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.llm.batches import append_columns, words_of

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")

#: Each rule: its bit, and when it fails. Bits are never given anew, so that old ledgers stay readable.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 20"),
    "repeated_windows": (1, "100 * n_repeat_words > 30 * n_words"),
    "symbols": (2, "10 * n_symbols > 3 * n_words"),
    "shouting": (3, "n_letters >= 40 and 10 * n_upper > 6 * n_letters"),
    "odd_word_length": (4, "word_chars < 2 * n_words or word_chars > 25 * n_words"),
    "repeated_lines": (5, "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
}

#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_windows"),
    "strict-1": tuple(RULES),
}


def mask(policy: str) -> int:
    return sum(1 << RULES[r][0] for r in POLICIES[policy])


def _measure(texts: pa.Array) -> list[np.ndarray]:
    n, codes, vocabulary = words_of(texts)
    docs = len(n)
    owner = np.repeat(np.arange(docs), n)
    chars = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False)
    word_chars = np.bincount(owner, chars[codes], docs)
    symbols = pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy(zero_copy_only=False)
    letters = pc.count_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    upper = pc.count_substring_regex(texts, r"\p{Lu}").to_numpy(zero_copy_only=False)

    # Lines with a word; a line that equals an earlier one of its document is a duplicate.
    parts = pc.split_pattern(texts, "\n")
    lines, at = parts.flatten(), np.repeat(np.arange(docs), np.diff(parts.offsets.to_numpy()))
    worded = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    at = at[worded]
    line = lines.filter(pa.array(worded)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_lines = np.bincount(at, minlength=docs)
    distinct = np.unique(at * (len(line) + 1) + line)
    n_dup = n_lines - np.bincount((distinct // (len(line) + 1)).astype(np.int64), minlength=docs)

    # Ranks of runs of 1, 2, 4 and 8 words: equal ranks mean equal runs of one document, with no hashing.
    rank = owner * np.int64(len(vocabulary) + 1) + codes
    width, size = 1, len(rank)
    rank = np.unique(rank, return_inverse=True)[1] if size else rank
    while width < WINDOW and size > width:
        size -= width
        rank = np.unique(rank[:size] * np.int64(len(rank) + 1) + rank[width : width + size], return_inverse=True)[1]
        width *= 2
    repeat = np.zeros(len(codes), bool)
    if width == WINDOW and size > 0:
        inside = owner[:size] == owner[WINDOW - 1 : WINDOW - 1 + size]
        found = inside & (np.bincount(rank[inside], minlength=rank.max() + 1)[rank] > 1)
        edge = np.zeros(len(codes) + 1, np.int64)
        starts = np.flatnonzero(found)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + WINDOW, -1)
        repeat = np.cumsum(edge)[:-1] > 0
    return [n, word_chars.astype(np.int64), symbols, n_dup, np.bincount(owner, repeat, docs).astype(np.int64), n_lines, letters, upper]


def ledger(df: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the measurements (longs) and ``rule_bits`` (long; bit set: that rule failed) to every row.

    Null and empty texts measure zero and fail ``few_words``. Rows aren't compared with each other, so ties and
    repeated rows each get their own verdict; an empty table stays empty. A column of the table that has the name of
    a measurement or ``rule_bits`` is replaced.
    """
    fields = [T.StructField(m, T.LongType()) for m in MEASURES]
    measured = append_columns(df, text, fields, _measure, drop)
    bits = " + ".join(f"if({fails}, {1 << bit}L, 0L)" for bit, fails in RULES.values())
    return measured.withColumn("rule_bits", F.expr(bits))


def passes(policy: str) -> Column:
    """Whether the ledger's bits pass the policy."""
    return F.col("rule_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: how many documents fail it, fail it alone, and would stay without it.

    The ledger is first counted by its bits (at most two to the number of rules rows, combined before the shuffle).
    An empty ledger gives zeros.
    """
    whole = mask(policy)
    by_bits = rows.groupBy(F.col("rule_bits").bitwiseAND(F.lit(whole)).alias("bits")).count()
    sums = []
    for name in POLICIES[policy]:
        bit = 1 << RULES[name][0]
        for key, when in (("failed", f"bits & {bit} <> 0"), ("alone", f"bits = {bit}"), ("kept", f"bits & {whole & ~bit} = 0")):
            sums.append(F.expr(f"coalesce(sum(if({when}, count, 0)), 0)").alias(f"{name}.{key}"))
    counted = by_bits.agg(*sums)
    entries = [
        F.struct(F.lit(r).alias("rule"), *(F.col(f"`{r}.{k}`").alias(a) for k, a in (("failed", "n_failed"), ("alone", "n_failed_alone"), ("kept", "n_kept_without"))))
        for r in POLICIES[policy]
    ]
    return counted.select(F.inline(F.array(*entries)))


def filter_quality(df: DataFrame, policy: str = "strict-1", text: str = "text") -> DataFrame:
    """The rows, with their own columns (those with names of the ledger too), that pass the policy."""
    taken = {*MEASURES, "rule_bits"}
    aside = {c: f"__own_{c}" for c in df.columns if c.lower() in taken}
    judged = ledger(df.withColumnsRenamed(aside), text).where(passes(policy))
    return judged.select(*(F.col(aside.get(c, c)).alias(c) for c in df.columns))
