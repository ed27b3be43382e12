"""Arrow batches of texts: bounded slices, words, and columns added beside those of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text worked on at a time in a task; a longer text is worked on alone.
SLICE_BYTES = 4 << 20


def filled(texts: pa.Array) -> pa.Array:
    """Texts with null as the empty text."""
    return pc.fill_null(texts.cast(pa.string()), "")


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes, or one row."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += int(size) or 1
    if held:
        yield start, len(sizes)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: the number in each, the code of each word, and the distinct words."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    solid = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not solid.all():
        flat, owner = flat.filter(pa.array(solid)), owner[solid]
    coded = flat.dictionary_encode()
    return np.bincount(owner, minlength=len(texts)), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def append_columns(
    df: DataFrame, text: str, fields: list[T.StructField], compute: Callable[[pa.Array], list], drop: tuple[str, ...] = ()
) -> DataFrame:
    """Pass every row once through Python and add ``fields``, computed from its text by bounded slices.

    ``compute`` takes texts without nulls and returns an array for each field. A column of ``df`` that has the name
    of a new one is replaced; those in ``drop`` are left out.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new and f.name not in drop]
    names = [f.name for f in kept]
    schema = T.StructType(kept + fields)
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(text))
            for start, end in slices(texts):
                part = batch.slice(start, end - start)
                made = compute(texts.slice(start, end - start))
                made = [a.cast(t) if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + made, names + [f.name for f in fields])
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
