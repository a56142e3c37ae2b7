"""Sorted groups in Python tasks: many small groups at a time, none of them cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def sorted_by(df: DataFrame, keys: list[str], tie: tuple[str, ...] = ()) -> DataFrame:
    """Rows of equal ``keys`` together in one partition, in order."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *tie)


#: Rows of a table that a Python task works on; its memory follows this, not the size of its partition.
ROWS = 40_000


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether each row begins a new group of sorted rows."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        codes = pc.dictionary_encode(table[k].combine_chunks(), null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables of about ``rows`` that never cut a group, each with its group numbers."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held)
        new = _changes(table, keys)
        cut = int(np.flatnonzero(new)[-1])
        if cut:
            yield table.slice(0, cut), np.cumsum(new[:cut]) - 1
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.cumsum(_changes(table, keys)) - 1
