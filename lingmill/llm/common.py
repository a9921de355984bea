"""What the operators share: reading tables, cutting lineage, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shared import shared_root

#: White space that ends a word in every contract of this package.
WORD = r"[^\x20\x09-\x0D]+"
#: bytes.translate table that lower-cases A-Z alone.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share (see shared_root)."""
    return f"{shared_root(spark)}/lingmill-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no more than a reread."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound what an Arrow batch holds: texts of any length travel in batches of few rows and few bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """f gives each batch's columns (lists, arrays) by name; types come from schema."""
    fields = T._parse_datatype_string(schema) if not isinstance(schema, T.StructType) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield to_batch(f(b), arrow)

    return df.mapInArrow(each, fields)


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[x.name], pa.Array) and c.type == x.type else c.cast(x.type) if isinstance(c, pa.Array) else pa.array(c, type=x.type) for x in schema], schema=schema)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold at most `most` bytes together (one longer text makes its own range)."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def hash_mod(column: str, by: int) -> F.Column:
    """crc32(column as text) mod by; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)
