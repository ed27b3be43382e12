"""Names of a replaceable lexicon in texts, by one automaton for all names."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that a lexicon may have (the automaton of so many takes some 200 MB in a worker).
MOST_NAMES = 1_000_000


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _bounded(text: str, start: int, end: int) -> bool:
    """Whether a word begins or ends at both places."""
    before = start > 0 and _word(text[start - 1])
    after = end < len(text) and _word(text[end])
    return before != _word(text[start]) and after != _word(text[end - 1])


def automaton_of(names: list[tuple[str, str]]) -> ahocorasick.Automaton | None:
    """An automaton over pairs of a name and how it is shown; None without names. Empty names are left out."""
    made = ahocorasick.Automaton()
    for name, shown in names:
        if name:
            made.add_word(name, (len(name), shown))
    if not len(made):
        return None
    made.make_automaton()
    return made


def tagged(df: DataFrame, lexicon: DataFrame, text: str, column: str = "names") -> DataFrame:
    """Add ``column``, the sorted distinct shown forms of the lexicon's names that stand between word boundaries in a text.

    ``lexicon`` has ``name`` (as in the texts, which are in lower case if the names are) and ``shown``; its size is checked, and
    it is broadcast. Every task builds one automaton and reads each text once, so neither plan nor work grows with the names.
    A null text has none. A column of ``df`` with the new one's name is replaced.
    """
    names = [tuple(r) for r in lexicon.select("name", "shown").where("name is not null").distinct().limit(MOST_NAMES + 1).collect()]
    if len(names) > MOST_NAMES:
        raise ValueError(f"a lexicon of more than {MOST_NAMES} names")
    shared = df.sparkSession.sparkContext.broadcast(names)
    kept = [c for c in df.columns if c != column]
    rows = df.select(*kept, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton_of(shared.value)
        for batch in batches:
            out = []
            for whole in batch.column(len(kept)).to_pylist():
                hits = set()
                for last, (size, shown) in found.iter(whole) if found and whole else ():
                    if shown not in hits and _bounded(whole, last + 1 - size, last + 1):
                        hits.add(shown)
                out.append(sorted(hits))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, pa.list_(pa.string()))], [*kept, column])

    schema = df.select(*kept).withColumn(column, F.array().cast("array<string>")).schema
    return rows.mapInArrow(run, schema)
