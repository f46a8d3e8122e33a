"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from setaccio.plans.tables import cut, table

__all__ = ["arrow_map", "cut", "keyed", "table", "texts_of"]


def keyed(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """Only the named columns, as id and c0, c1, ...; rows without an id are left out, other columns don't matter."""
    return df.select(df[id_col].alias("id"), *(df[c].alias(f"c{i}") for i, c in enumerate(cols))).where("id is not null")


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict] | dict]], schema: str) -> DataFrame:
    """mapInArrow with one call of `make` a task: it loads what a worker needs and gives the function of a batch,
    which gives the result's columns as a dict of Arrow arrays or lists."""
    struct = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                got = f(batch)
                for out in [got] if isinstance(got, dict) else got:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=arrow.field(k).type) for k, x in ((n, out[n]) for n in arrow.names)], schema=arrow)

    return df.mapInArrow(run, struct)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's strings, nulls as empty ones."""
    return [t or "" for t in batch.column(column).to_pylist()]
