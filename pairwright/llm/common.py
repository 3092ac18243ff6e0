"""Helpers that several of the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Documents that a task works on at once, in bytes of text.
SLICE_BYTES = 4 << 20
#: Entries that a task's word cache holds before it starts anew.
CACHE_ENTRIES = 1 << 19


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, df: DataFrame) -> str:
    """A column name made from ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than the six ASCII white-space characters."""
    return text.encode().split() if text else []


def crc32_of(id_col):
    """CRC-32 of an id written as text, as the hold-out rules use it."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


class WordCache(dict):
    """word -> what ``make`` gives for it; started anew at a bound of entries."""

    def __init__(self, make: Callable, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, word):
        value = self[word] = self.make(word)
        return value

    def trim(self) -> None:
        if len(self) > self.entries:
            self.clear()


def slices(batch: pa.RecordBatch, text_col: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows that hold about ``most`` bytes of text (one row at least)."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch[text_col]), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        upto = max(upto, at + 1)
        yield batch.slice(at, upto - at)
        at = upto


def map_arrow(df: DataFrame, task: Callable[[], Callable], schema: StructType | str) -> DataFrame:
    """Apply ``task()``, made once in each task, to every Arrow record batch of ``df``.

    The inner function takes a RecordBatch and yields RecordBatches or tables; empty ones
    are left out.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def run(batches):
        work = task()
        for batch in batches:
            for out in work(batch):
                if out.num_rows:
                    out = out.cast(arrow)
                    yield from out.to_batches() if isinstance(out, pa.Table) else (out,)

    return df.mapInArrow(run, schema)
