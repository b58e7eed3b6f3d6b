"""Metadata of files, documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import tokens


def file_metadata(files: DataFrame, table: str | None = None) -> DataFrame:
    """``files`` of a file source with source, file_type, file_path, file_size_bytes, modified_at (ISO) from its hidden column.

    ``table`` is the path that was read where it is one table, a file or a folder of parts: its name is the source of all rows, in
    however many parts it is stored. Path, size and time are those of the part that a row is from.
    """
    meta = F.col("_metadata")
    name = meta["file_name"] if table is None else F.lit(table.rstrip("/").rsplit("/", 1)[-1])
    return files.select(
        "*",
        name.alias("source"),
        F.lower(F.regexp_extract(name, r"(\.[^./]+)\z", 1)).alias("file_type"),
        meta["file_path"].alias("file_path"),
        meta["file_size"].alias("file_size_bytes"),
        iso(meta["file_modification_time"]).alias("modified_at"),
    )


def iso(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def merged(*maps: Column) -> Column:
    """Maps of strings merged; a later one wins."""
    parts = [F.coalesce(m, F.create_map().cast("map<string,string>")) for m in maps]
    out = parts[0]
    for m in parts[1:]:
        out = F.map_concat(_without(out, m), m)
    return out


def _without(a: Column, b: Column) -> Column:
    """The entries of ``a`` whose keys are not in ``b``."""
    return F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))


def cleaned(metadata: Column) -> Column:
    """Without null and empty values."""
    return F.map_filter(metadata, lambda _, v: v.isNotNull() & (v != ""))


def chunk_id(source: Column, index: Column, text: Column) -> Column:
    return F.concat(source, F.lit("_chunk_"), index.cast("string"), F.lit("_"), F.substring(F.md5(text.cast("binary")), 1, 8))


def document_id(source: Column, path: Column) -> Column:
    digest = F.md5(F.concat(source, F.lit(":"), F.coalesce(path, F.lit(""))).cast("binary"))
    return F.concat(F.lit("doc_"), source, F.lit("_"), F.substring(digest, 1, 8))


def chunk_position(index: Column, total: Column) -> Column:
    """"i of n", counted from 1."""
    return F.concat((index + 1).cast("string"), F.lit(" of "), total.cast("string"))


def enriched(chunks: DataFrame, system: str = "foliant") -> DataFrame:
    """Chunk rows (source, file_path, chunk_text, chunk_index) with ids, counts, system and time of ingestion."""
    return chunks.withColumns(
        {
            "chunk_id": chunk_id(F.col("source"), F.col("chunk_index"), F.col("chunk_text")),
            "document_id": document_id(F.col("source"), F.col("file_path")),
            "char_count": F.length("chunk_text"),
            "word_count": F.size(tokens("chunk_text")),
            "ingested_at": iso(F.current_timestamp()),
            "system": F.lit(system),
        }
    )


def document_totals(chunks: DataFrame) -> DataFrame:
    """(document_id, total_chunks, total_chars, total_words)."""
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_chunks"), F.sum("char_count").alias("total_chars"), F.sum("word_count").alias("total_words"))


def with_total(chunks: DataFrame) -> DataFrame:
    """Chunk rows (source, file_path, ...) with the number of chunks of their document.

    Documents are told apart by source and path themselves: ids hold 32 bits of a digest, which some of many documents share.
    """
    return chunks.withColumn("total_chunks", F.count(F.lit(1)).over(Window.partitionBy("source", "file_path")))


def batch_id(spark) -> str:
    """A new name for one ingestion: its UTC time and eight random hexadecimal digits."""
    row = spark.range(1).select(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyyMMdd_HHmmss").alias("t"), F.expr("substr(uuid(), 1, 8)").alias("u")).first()
    return f"batch_{row['t']}_{row['u']}"


def typed(metadata: DataFrame, *columns: str) -> Column:
    """The named columns as a struct, with their types; times in ISO form."""
    kinds = dict(metadata.dtypes)
    return F.struct(*((iso(F.col(c)) if kinds[c].startswith(("timestamp", "date")) else F.col(c)).alias(c) for c in columns))


def storable(metadata: DataFrame, *columns: str) -> Column:
    """The named columns as a map of strings: nulls dropped, times in ISO form, arrays, maps and structs as JSON."""
    kinds = dict(metadata.dtypes)
    entries = []
    for c in columns:
        value = F.col(c)
        if kinds[c].startswith(("array", "map", "struct")):
            value = F.to_json(value)
        elif kinds[c].startswith(("timestamp", "date")):
            value = iso(value)
        entries += [F.lit(c), value.cast("string")]
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
