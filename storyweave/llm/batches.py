"""Arrow batches in, Arrow batches out: the few helpers all operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Step = Callable[[pa.RecordBatch], pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, make: Callable[[], Step], schema: StructType | str) -> DataFrame:
    """``make`` is called once per task and returns the function that turns a
    batch into a batch, so that a task builds its tables once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def bucket(column: Column, n: int) -> Column:
    """crc32 of a value as text, modulo ``n``: the fold of a document; -1 for null."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % n, F.lit(-1))


def sampled(column: Column, share: float) -> Column:
    """A row is taken by the hash of its key, so that a rerun takes the same rows."""
    return F.pmod(F.xxhash64(column, F.lit("sample")), F.lit(1 << 30)) < F.lit(int(min(share, 1.0) * (1 << 30)))


def first_of(rows: Iterable, default):
    return next(iter(rows), default)


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with low lines before it until no column is called so in any case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def few(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Small tables are sent to every task, larger ones joined by their keys; the rows are the same."""
    return F.broadcast(rows) if rows.count() <= most else rows
