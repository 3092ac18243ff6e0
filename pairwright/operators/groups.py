"""Kernels over one group at a time, groups streamed through tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a task gives out at once.
OUT_ROWS = 10_000


def by_group(df: DataFrame, key: str, work: Callable[[object, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``work(key, rows)`` gives for each group of equal ``key``; ``rows`` hold the other columns in order.

    Groups are dealt out by hash and sorted within tasks, and a task holds one group at a time, however many
    it has; so partitions, not a number of batches, grow with the data. They are dealt out by a hash of the key: where a
    join has dealt out rows by the key itself, Spark leaves a second exchange out, and the groups are torn if it then
    finds at run time that it can broadcast one side of the join and reads the other where it lies.
    """
    names, arrow = [c for c in df.columns if c != key], to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(batch[key].to_pylist(), zip(*(batch[c].to_pylist() for c in names), strict=True), strict=True)

        out: list[tuple] = []
        for value, group in groupby(rows(), key=lambda r: r[0]):
            out += work(value, [r for _, r in group])
            if len(out) >= OUT_ROWS:
                yield _batch(out, arrow)
                out = []
        if out:
            yield _batch(out, arrow)

    return df.repartition(F.xxhash64(key)).sortWithinPartitions(key).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
