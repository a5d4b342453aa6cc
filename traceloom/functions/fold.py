"""Folds over ordered rows of a key that never hold more than one batch of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: (state or None at a key's first row, row without key) -> (state, values to put out or None)
Step = Callable[[object, tuple], tuple[object, tuple | None]]


def fold(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    values: Sequence[str],
    out: str,
    step: Step,
    end: Callable[[object], tuple] | None = None,
) -> DataFrame:
    """Run `step` over each key's rows in order; rows (key, *out) for what step, and end after the last row, put out.

    Rows are distributed by key and sorted on disk if need be; a task then reads them once and
    carries the state from batch to batch, so memory doesn't grow with the length of a key.  The
    steps of one key are sequential, as its result depends on every row before.
    """
    fields = [df.schema[key], *StructType.fromDDL(out).fields]
    schema = StructType(fields)
    rows = df.select(key, *order, *[v for v in values if v not in order]).repartition(key).sortWithinPartitions(key, *order)
    at = [rows.columns.index(v) for v in values]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.field(f.name, kind) for f, kind in zip(fields, _arrow(schema))]
        current, state, begun = None, None, False
        for batch in batches:
            found: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in (0, *at)]
            for row in zip(*columns):
                if not begun or row[0] != current:
                    if begun and end:
                        found.append((current, *end(state)))
                    current, state, begun = row[0], None, True
                state, given = step(state, row[1:])
                if given is not None:
                    found.append((current, *given))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*found), kinds)], schema=pa.schema(kinds))
        if begun and end:
            last = [(x,) for x in (current, *end(state))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(last, kinds)], schema=pa.schema(kinds))

    return rows.mapInArrow(run, schema)


def _arrow(schema: StructType) -> list:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]
