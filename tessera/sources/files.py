"""Readers and writers: manifests, raw files, JSON, indexes and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import nfc
from tessera.operators.dense import check_vectors
from tessera.operators.ingest import NAME

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("sections", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("path", T.StringType())]))),
])


def read_manifest(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """CSV rows as strings with pos and the NFC filename; the header must name the file column. limit keeps the first rows."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be 1 or more")
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    if NAME not in rows.columns:
        raise ValueError(f"the manifest needs a column {NAME}")
    rows = rows.withColumn("pos", F.monotonically_increasing_id())  # a manifest is one file, read in order
    rows = rows.withColumn("filename", nfc(F.trim(F.coalesce(F.col(f"`{NAME}`"), F.lit("")))))
    return rows if limit is None else rows.orderBy("pos").limit(limit)


def read_raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """filename (NFC), suffix, content of the files in a folder; names that become equal are an error."""
    rows = spark.read.format("binaryFile").load(folder)
    rows = rows.withColumn("filename", nfc(F.element_at(F.split("path", "/"), -1))).withColumn("suffix", F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1)))
    twice = rows.groupBy("filename").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"file names are equal after normalisation: {twice[0]['filename']}")
    return rows.select("filename", "suffix", "content")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_documents(documents: DataFrame, errors: DataFrame, folder: str) -> tuple[int, int]:
    """Documents and error rows, both also where there are none, and how many; no document at all is an error, after that."""
    spark = documents.sparkSession
    documents.write.mode("overwrite").parquet(f"{folder}/documents")
    write_json(errors, f"{folder}/errors")
    n, bad = spark.read.parquet(f"{folder}/documents").count(), spark.read.schema("filename string, error string").json(f"{folder}/errors").count()
    if not n:
        raise ValueError(f"no document could be parsed; {folder}/errors has {bad} rows")
    return n, bad


def write_index(tables: dict[str, DataFrame], path: str, config: dict[str, object]) -> None:
    """The tables of an index (chunks, vectors and others); the config is written last, as the mark that the index is whole.

    It gets the number of chunks and the dimension of the vectors, after each vector is found to have it and a finite length.
    """
    spark = tables["chunks"].sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    vectors = spark.read.parquet(f"{path}/vectors")
    bad = check_vectors(vectors).select("chunk_no").limit(1).collect()
    if bad:
        raise ValueError(f"the vector of chunk {bad[0]['chunk_no']} has another dimension, or no finite length")
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dimension")).first()
    spark.createDataFrame([{**config, "chunk_count": size["n"], "dimension": size["dimension"] or 0}]).coalesce(1).write.mode("overwrite").parquet(f"{path}/config")


def read_index(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables of an index and its config; counts and dimension must agree."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("chunks", "vectors", "grams")}
    config = spark.read.parquet(f"{path}/config").first().asDict()
    seen = tables["vectors"].agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min(F.size("embedding")), F.lit(0)).alias("lo"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("hi")).first()
    if not (tables["chunks"].count() == tables["grams"].count() == seen["n"] == config["chunk_count"] and seen["lo"] == seen["hi"] == config["dimension"]):
        raise ValueError("chunks, vectors and config of the index do not agree")
    return tables, config


def latest_by_key(rows: DataFrame, key: str = "key", order: str = "at") -> DataFrame:
    """The last row of each key of an append-only cache."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("__n = 1").drop("__n")


def read_cache(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """An append-only cache, empty where it does not exist yet."""
    if path:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def append_cache(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def compact_cache(spark: SparkSession, path: str, key: str = "key", order: str = "at") -> None:
    """The last row of each key in place of all rows: written beside the cache, which is replaced when that is whole."""
    fresh, old = f"{path}.fresh", f"{path}.old"
    latest_by_key(spark.read.parquet(path), key, order).write.mode("overwrite").parquet(fresh)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at(old), True)
    if not (fs.rename(at(path), at(old)) and fs.rename(at(fresh), at(path))):
        raise OSError(f"{path} could not be replaced; its rows are in {old} and {fresh}")
    fs.delete(at(old), True)
