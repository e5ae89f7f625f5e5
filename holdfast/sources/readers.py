"""Sources: explicit schemas, bad records kept apart instead of failing the job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ref
from ..operators.clean import normalise_nan, require_columns

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, keep_corrupt: bool = False) -> DataFrame:
    """CSV with a header.  Without a schema the types are inferred, which costs a second scan.

    `keep_corrupt` adds the raw text of malformed lines as `_corrupt_record`.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is None:
        return normalise_nan(reader.option("inferSchema", True).csv(path))
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if keep_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return normalise_nan(reader.schema(schema).csv(path))


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_bulk_upload(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined lines with their text and file) of a landing folder."""
    raw = read_csv(spark, path, schema, keep_corrupt=True).withColumn("source_file", F.col("_metadata.file_path"))
    fields = [c for c in raw.columns if c not in (CORRUPT, "source_file")]
    # The parser only checks columns a query asks for: ask for all, so that a line is judged alike by every query.
    judged = raw.filter(F.length(F.concat_ws("", *[ref(c).cast("string") for c in fields])) >= 0)
    good = judged.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, "source_file")
    bad = judged.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"), "source_file")
    return good, bad


def read_training_upload(spark: SparkSession, path: str, target: str, schema: T.StructType | str | None = None) -> DataFrame:
    return require_columns(read_csv(spark, path, schema), [target])


METRICS_SCHEMA = "model string, accuracy double, precision double, recall double, f1 double, auc double"


def read_metrics(spark: SparkSession, path: str, schema: str = METRICS_SCHEMA) -> DataFrame:
    return read_csv(spark, path, schema)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The prediction log; a filter on `date` prunes folders."""
    return spark.read.parquet(path)
