"""Readers and writers: JSON lines, CSV with a byte order mark, Parquet, resumable and split sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bare

SAMPLE = "task string, source string, lang_code string, input string, output string"
TESTS = "id string, prompt string, task string, question_lang string"
ROWS = "task string, question_lang string, context_lang string, source string, input string, output string, item_group string, constraint string"
SHARD = "qa_idx int, source string, lang_code string, input string, gold string, teacher string"
ANSWERS = "source string, lang_code string, input string, gold string, prediction string"
SUBMISSION = "id string, output string"


def read_jsonl(spark: SparkSession, *paths: str, schema: str | T.StructType, lineage: bool = False) -> DataFrame:
    """One object a line, blank lines skipped; a malformed line fails the read. `lineage` adds src_file."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(list(paths))
    return df.withColumn("src_file", F.col("_metadata.file_path")) if lineage else df


def read_csv(spark: SparkSession, *paths: str, schema: str = ANSWERS) -> DataFrame:
    """Header with or without byte order mark, quoted line breaks, null text as empty."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).csv(list(paths))
    return df.select(*(F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema))


def read_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """By suffix: .jsonl or .json, .parquet, else CSV."""
    if path.endswith((".jsonl", ".json")):
        return read_jsonl(spark, path, schema=schema)
    return spark.read.parquet(path) if path.endswith(".parquet") else read_csv(spark, path, schema=schema)


def read_parquets(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def newest(spark: SparkSession, folder: str, glob: str = "*.csv") -> str:
    """Path of the file written last; equal times: the greatest name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "modificationTime")
    row = files.orderBy(F.desc("modificationTime"), F.desc("path")).first()
    if row is None:
        raise FileNotFoundError(f"{folder}/{glob}")
    return row.path


def require(df: DataFrame, *columns: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}; there are {df.columns}")
    return df


def normalise_rows(df: DataFrame, drop_tasks: tuple[str, ...] = ("sum-sum",)) -> DataFrame:
    """Both dialects to one: lang_code from question_lang, bare `lang`; tasks that aren't answered drop out."""
    if "question_lang" in df.columns and "lang_code" not in df.columns:
        df = df.withColumnRenamed("question_lang", "lang_code")
    if "task" in df.columns:
        df = df.where(F.col("task").isNull() | ~F.col("task").isin(*drop_tasks))
    return df.withColumn("lang", bare(F.col("lang_code")))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_sides(df: DataFrame, path: str, side: str = "_side") -> None:
    """A folder for each side; the column itself isn't written."""
    df.write.mode("overwrite").partitionBy(side).json(path)


def write_sorted(df: DataFrame, path: str, key: str) -> None:
    """Range-partitioned and sorted: file names follow the key's order, no task holds all rows."""
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_missing(df: DataFrame, path: str, key: str, schema: str) -> int:
    """Append the rows whose key isn't in the sink yet; how many there were. A rerun writes nothing twice."""
    spark = df.sparkSession
    try:
        done = spark.read.schema(schema).json(path).select(key).distinct()
    except Exception as e:  # noqa: BLE001  the sink doesn't exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    todo = df if done is None else df.join(done, key, "left_anti")
    before = 0 if done is None else done.count()
    todo.write.mode("append").json(path)
    return spark.read.schema(schema).json(path).select(key).distinct().count() - before
