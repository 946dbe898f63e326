"""From a manifest and files to documents and error rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import document_key

NAME, TEXT, NOTICE = "파일명", "텍스트", "공고 번호"


def match_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest (pos, filename, ...) left-joined to files (filename, text, read_error), with error where a row has no document.

    The first row of a file name counts; later ones are errors, as are names without a file and files that cannot be read.
    """
    nth = F.row_number().over(Window.partitionBy("filename").orderBy("pos"))
    rows = manifest.withColumn("nth", nth).join(files, "filename", "left")
    error = F.when(F.col("nth") > 1, "duplicate file name").when(F.col("text").isNull() & F.col("read_error").isNull(), "no such file").otherwise(F.col("read_error"))
    return rows.withColumn("error", error).drop("nth", "read_error")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs (pos, filename, notice, text) with kept_by: the filename kept of the rows of one text.

    That is the first row with a notice number, else the first row. Texts are compared by their SHA-256.
    """
    w = Window.partitionBy(F.sha2("text", 256)).orderBy((F.coalesce("notice", F.lit("")) == "").cast("int"), "pos")
    return docs.withColumn("kept_by", F.first("filename").over(w)).withColumn("keep", F.row_number().over(w) == 1)


def split_documents(matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and error rows (filename, error) of matched rows; equal texts leave one document and error rows."""
    good = exact_dedup(matched.where("error is null"))
    docs = good.where("keep").withColumn("doc_id", document_key(F.col("filename"))).drop("keep", "kept_by", "error")
    lost = good.where("not keep").select("filename", F.concat(F.lit("same text as "), "kept_by").alias("error"))
    return docs, matched.where("error is not null").select("filename", "error").unionByName(lost)


def metadata_map(columns: list[str]) -> Column:
    """A map of manifest columns, null as empty string, without the text column."""
    return F.create_map(*[x for c in columns if c != TEXT for x in (F.lit(c), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))])
