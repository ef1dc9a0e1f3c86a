"""Document folders, the registry of known files, and page assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.functions.payloads import document_metadata_json
from casework.functions.text import normalize_document_text


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    """File names ending in ``.pdf`` directly in a folder; no file content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.select(F.col("_metadata.file_name").alias("filename"))


def attach_metadata(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files with their registry entry; ``known`` is false where there is none."""
    entries = registry.withColumn("known", F.lit(True))
    joined = files.join(entries, "filename", "left")
    return joined.withColumn("known", F.coalesce("known", F.lit(False)))


def scan_documents(files: DataFrame, registry: DataFrame, unknown: str = "skip") -> DataFrame:
    """``.pdf`` files (case-sensitive) with metadata. Unknown files are skipped, or with
    ``unknown="fail"`` kept with an error."""
    if unknown not in ("skip", "fail"):
        raise ValueError(f"unknown policy: {unknown}")
    found = attach_metadata(files.where(F.endswith("filename", F.lit(".pdf"))), registry)
    if unknown == "skip":
        return found.where("known").drop("known")
    error = F.when(~F.col("known"), "unknown document")
    return found.withColumn("error", error).drop("known")


def document_rows(known_files: DataFrame) -> DataFrame:
    """Rows for the documents table, without ids."""
    return known_files.select(
        "filename", "title", "document_type", "status", "authority_rank", "account_id",
        document_metadata_json().alias("metadata"),
    )


def assemble_pages(
    pages: DataFrame, key: str = "document", page: str = "page", text: str = "text"
) -> DataFrame:
    """One normalised text per document, pages in order, null pages skipped.

    The group ends up as one value because the document is one value; each page is normalised
    first, so only the text that stays is shuffled.
    """
    tidy = pages.select(key, page, normalize_document_text(F.col(text)).alias("_t"))
    kept = F.when(F.col("_t") != "", F.struct(page, "_t"))
    grouped = tidy.groupBy(key).agg(F.array_sort(F.collect_list(kept)).alias("_pages"))
    joined = F.array_join(F.transform("_pages", lambda p: p["_t"]), "\n")
    return grouped.select(key, joined.alias("text"))


def chunk_counts(documents: DataFrame, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Chunks per document, 0 included."""
    per = chunks.groupBy(key).agg(F.count("*").alias("n_chunks"))
    counted = documents.select(key).join(per, key, "left")
    return counted.withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
