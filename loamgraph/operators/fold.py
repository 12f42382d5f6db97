"""Folds over the rows of a key in their order, for rules that depend on what was decided before."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Fold(Protocol):
    """What is remembered about a key: ``add`` takes its next row, ``end`` follows its last; both give output rows."""

    def add(self, row: dict) -> Iterable[dict]: ...

    def end(self) -> Iterable[dict]: ...


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], fresh: Callable[[], Fold], schema: str) -> DataFrame:
    """Fold each key's rows by ``order``. Rows are hash-partitioned and sorted by Spark and then streamed: a task holds a
    batch and the fold of one key, never a key's rows. Keys are nulls or values alike; without rows nothing is folded."""
    fields = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                now = tuple(row[k] for k in keys)
                if fold is None or now != key:
                    out.extend(fold.end() if fold is not None else ())
                    key, fold = now, fresh()
                out.extend(fold.add(row))
            yield pa.RecordBatch.from_pylist(out, arrow)
        if fold is not None:
            yield pa.RecordBatch.from_pylist(list(fold.end()), arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(folded, schema)
