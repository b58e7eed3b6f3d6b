"""Vector collections in hash buckets with typed metadata: what is merged or deleted rewrites the buckets it touches.

A collection is a Parquet table partitioned by bucket, a hash of what a point belongs to; Spark's dynamic partition
overwrite replaces the buckets of a write and leaves all other files alone. Metadata keep their types in a VARIANT column;
those that are declared as fields are columns of their own, so that filters on them reach the scan.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators import collection, knn

POINT = "point_id string, doc_id string, parent string, vec_id bigint, text string, embedding array<float>, metadata variant"
#: What the engine filters by.
FIELDS = {"source": "string", "document_id": "string"}
#: How many buckets are rewritten at once.
TOGETHER = 16
_KINDS = {bool: "boolean", int: "bigint", float: "double", str: "string"}


def _member(name: str) -> str:
    if "'" in name or "\\" in name:
        raise ValueError(f"invalid metadata name {name!r}")
    return f"$['{name}']"


def as_variant(df: DataFrame, name: str) -> Column:
    """A map, struct or array column with its types; a variant as it is; null as an empty object."""
    kind = df.schema[name].dataType.simpleString()
    empty = F.parse_json(F.lit("{}"))
    return F.coalesce(F.col(name) if kind == "variant" else F.to_variant_object(F.col(name)), empty)


@dataclass
class BucketedStore(collection.Store):
    """A store of collections as above; ``buckets`` and ``fields`` (name: type) are those of collections created by it.

    Each bucket is replaced as a whole. Merging or replacing the same points again changes nothing, so that a write that fails between
    buckets is mended by repeating it. Writers that touch different buckets do not disturb each other; of two that rewrite one
    bucket at the same time the later one wins, and a reader whose files are replaced under it fails and has to read
    again. Where that cannot be had, the versions of ``Store`` stay whole.
    """

    buckets: int = 64
    fields: Mapping[str, str] = field(default_factory=lambda: dict(FIELDS))

    #: The engine hands over metadata with their types, and what a chunk belongs to.
    typed = True

    def create(self, name: str, dimension: int) -> bool:
        if self._info(name) is not None:
            return False
        self._set_info(name, {"dimension": dimension, "buckets": self.buckets, "fields": dict(self.fields)})
        return True

    def _points(self, name: str) -> str:
        return f"{self._folder(name)}/points"

    def _schema(self, info: dict) -> str:
        return ", ".join([POINT, *(f"`f_{k}` {kind}" for k, kind in info["fields"].items()), "bucket int"])

    def _rows(self, name: str, info: dict) -> DataFrame:
        """The points with their fields and buckets; every bucket that was written also has one row without an id."""
        fs, path = self._fs(self._points(name))
        if not fs.exists(path):
            return self.spark.createDataFrame([], self._schema(info))
        return self.spark.read.schema(self._schema(info)).parquet(self._points(name)).where("point_id is not null")

    def read(self, name: str) -> DataFrame:
        info = self._info(name)
        if info is None:
            return self.spark.createDataFrame([], POINT)
        return self._rows(name, info)

    def _bucket(self, key: Column, info: dict) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(info["buckets"])).cast("int")

    def _replace(self, name: str, info: dict, rows: DataFrame, touched: list[int]) -> None:
        """Writes the buckets ``touched``, whole. Points are numbered in their bucket: ``vec_id`` is unique in the collection."""
        columns = [c.name for c in self.spark.createDataFrame([], self._schema(info)).schema]
        place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.asc_nulls_first("point_id")))
        # Some buckets after others, so that an exchange, and what is written beside the files that it replaces, hold no more than these.
        for at in range(0, len(touched), TOGETHER):
            some = touched[at : at + TOGETHER]
            marks = self.spark.createDataFrame([(b,) for b in some], "bucket int")
            every = rows.drop("vec_id").where(F.col("bucket").isin(some)).unionByName(marks, allowMissingColumns=True)
            numbered = every.withColumn("vec_id", F.col("bucket").cast("long") * F.lit(1 << 40) + place).select(*(F.col(f"`{c}`") for c in columns))
            with collection.released(numbered):
                numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", collection.COMPRESSION).partitionBy("bucket").parquet(self._points(name))

    def _touched(self, rows: DataFrame) -> list[int]:
        """The buckets of ``rows``: no more than a collection has."""
        return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())

    def upsert(self, name: str, points: DataFrame, mode: str = "merge", stored: bool = False) -> bool:
        """Adds points (doc_id, text, embedding, metadata, and parent if they have one), all or none.

        False if the collection is missing or a vector has another dimension. ``merge`` replaces points with the same parent and doc_id;
        ``replace`` also takes away all other points of the parents that come; ``append`` keeps all and gives each point a
        new id. Of repeated points the last by text, vector and metadata wins. A point without a parent is its own.
        ``points`` is computed once: it is written beside the collection before it is looked at, unless it is read from a table
        that was written already (``stored``).
        """
        info = self._info(name)
        if info is None:
            return False
        if mode not in ("merge", "replace", "append"):
            raise ValueError(f"unknown mode {mode!r}")
        own = F.col("doc_id").cast("string")
        parent = F.coalesce(F.col("parent").cast("string"), own) if "parent" in points.columns else own
        rows = points.select(own.alias("doc_id"), parent.alias("parent"), "text", F.col("embedding").cast("array<float>").alias("embedding"), as_variant(points, "metadata").alias("metadata"))
        rows = staged = (lambda df: df if stored else self.staged(df))(rows.withColumn("point_id", F.expr("uuid()") if mode == "append" else F.sha2(F.concat_ws("\u001f", "parent", "doc_id"), 256)).withColumn("bucket", self._bucket(F.col("parent"), info)))
        try:
            wrong = F.col("embedding").isNull() | (F.size("embedding") != info["dimension"])
            if rows.agg(F.count_if(wrong).alias("n")).first()["n"]:
                return False
            touched = self._touched(rows)
            if not touched:
                return True
            kept = self._rows(name, info).where(F.col("bucket").isin(touched))
            if mode != "append":
                own = ["bucket", "parent", "doc_id"]
                repeated = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                with collection.released(repeated):
                    once = repeated.isEmpty()
                if not once:
                    order = F.struct(F.coalesce("text", F.lit("")), "embedding", F.to_json("metadata"))
                    rows = rows.groupBy(*own).agg(F.max_by(F.struct("point_id", "text", "embedding", "metadata"), order).alias("_p")).select(*own, "_p.*")
                # Only keys are exchanged to see whether any point stays.
                on = own if mode == "merge" else own[:2]
                kept = kept.join(rows.select(*on).distinct(), on, "left_anti")
                with collection.released(kept):
                    if kept.isEmpty():
                        kept = kept.where("false")
            fields = {f"f_{k}": F.try_variant_get("metadata", F.lit(_member(k)), kind) for k, kind in info["fields"].items()}
            self._replace(name, info, kept.unionByName(rows.withColumns(fields), allowMissingColumns=True), touched)
        finally:
            self.unstage(staged)
        return True

    def delete(self, name: str, doc_ids: DataFrame) -> bool:
        """Removes the points of ``doc_ids`` (doc_id); ids that are not there do not matter."""
        info = self._info(name)
        if info is None:
            return True
        gone = doc_ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
        rows = self._rows(name, info)
        touched = self._touched(rows.join(gone, "doc_id", "left_semi"))
        if touched:
            self._replace(name, info, rows.where(F.col("bucket").isin(touched)).join(gone, "doc_id", "left_anti"), touched)
        return True

    def matching(self, name: str, where: Mapping[str, object] | None = None) -> DataFrame:
        """The points whose metadata equal all of ``where``, compared in the type of the value; None is a missing one."""
        info = self._info(name)
        points = self.read(name)
        for key, value in (where or {}).items():
            if value is not None and type(value) not in _KINDS:
                raise ValueError(f"metadata can be compared with strings, numbers and booleans, not {value!r}")
            if info and key in info["fields"]:
                at = F.col(f"`f_{key}`")
            else:
                at = F.try_variant_get("metadata", F.lit(_member(key)), _KINDS.get(type(value), "string"))
            points = points.where(at.isNull() if value is None else at == F.lit(value))
        return points

    def search(self, name: str, queries: DataFrame, top_k: int = 5, where: Mapping[str, object] | None = None) -> DataFrame:
        """(query_id, rank, id, score, text, metadata, payload): the nearest points that match all of ``where``.

        Metadata are given as text and, in payload, as they are. Vectors carry the number of their point, which no other has.
        """
        points = self.matching(name, where)
        hits = knn.top_k(queries, points.select("vec_id", "embedding"), top_k)
        found = hits.join(points.select("vec_id", "doc_id", "text", "metadata"), "vec_id")
        return found.select("query_id", "rank", F.col("doc_id").alias("id"), "score", "text", F.col("metadata").cast("map<string,string>").alias("metadata"), F.col("metadata").alias("payload"))


collection.register("bucketed", BucketedStore)
