"""Folds over each key's rows in order, for what no aggregate or window can say."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Result rows that a task gathers before it hands them on.
CHUNK = 8192


class Fold:
    """The state of one key: step takes the next row, end comes after the last; both yield result rows."""

    def step(self, row: dict) -> Iterable[dict]:
        return ()

    def end(self) -> Iterable[dict]:
        return ()


def fold_by_key(rows: DataFrame, key: str, order: list[str], start: Callable[[], Fold], schema: T.StructType) -> DataFrame:
    """Result rows of a fold of each key. Keys are dealt and sorted by Spark, which spills, and stream through the task:
    its memory holds a batch and one state, never a key's rows. A null key is a key.

    Rows are dealt by a column made here. An exchange by the key itself may be left out where
    the rows seem to be dealt by it already (a join, an aggregate, a union of such), and what
    seemed so may change when the plan is adapted; by a column that nothing below knows of it can't.
    """
    wanted = to_arrow_schema(schema)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        state, own = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row[key] != own:
                    if state is not None:
                        yield from state.end()
                    state, own = start(), row[key]
                yield from state.step(row)
        if state is not None:
            yield from state.end()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: list[dict] = []
        for row in results(batches):
            chunk.append(row)
            if len(chunk) == CHUNK:
                yield pa.RecordBatch.from_pylist(chunk, wanted)
                chunk = []
        if chunk:
            yield pa.RecordBatch.from_pylist(chunk, wanted)

    name = "_dealt"
    while name in rows.columns:
        name = f"_{name}"
    dealt = rows.withColumn(name, F.xxhash64(F.lit("fold"), F.col(key))).repartition(F.col(name))
    return dealt.sortWithinPartitions(key, *order).drop(name).mapInArrow(run, schema)
