"""Series folded in order: rows stream through their task sorted by key, so memory holds one state and never a series."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable, step: Callable, out: str, end: Callable | None = None) -> DataFrame:
    """(*keys, *out): step(state, *columns) for each row of a key in order gives an iterable of output tuples; state is
    what start() makes for a key, and end(state), where given, adds rows after the key's last.

    One key is one task, serial by definition; keys are dealt out by hash.
    """
    schema = StructType([*rows.select(*keys).schema, *StructType.fromDDL(out)])
    kinds, width = to_arrow_schema(schema), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = state = None

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = row[:width]
                if key != now:
                    if now is not None and end is not None:
                        held += [(*now, *x) for x in end(state)]
                    now, state = key, start()
                held += [(*key, *x) for x in step(state, *row[width:])]
            if len(held) >= 5000:
                yield emit()
                held = []
        if now is not None and end is not None:
            held += [(*now, *x) for x in end(state)]
        if held:
            yield emit()

    extra = [c for c in order if c not in columns]
    dealt = rows.select(*keys, *columns, *extra).repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *columns)
    return dealt.mapInArrow(run, schema)
