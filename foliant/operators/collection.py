"""Vector collections as versioned Parquet tables, one folder for each tenant's collection."""

from __future__ import annotations

import json
import re
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import knn

SCHEMA = "point_id string, doc_id string, text string, embedding array<float>, metadata map<string,string>, vec_id bigint"
METRIC = "cosine"
_NAME = re.compile(r"[A-Za-z0-9_-]{1,100}")
#: Where the tables of ``staged`` are.
_STAGED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: With this setting Spark deletes the shuffle files of a query when the query has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Of tables that this package writes for itself.
COMPRESSION = "zstd"


@contextmanager
def released(df: DataFrame) -> Iterator[None]:
    """What is run of ``df`` here loses its shuffle files when it has ended, not when the driver collects garbage: for writes and looks that nothing repeats."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        conf.unset(_CLEAN) if before is None else conf.set(_CLEAN, before)


def tenant_collection(tenant: str) -> str:
    """The collection name of a tenant; names have 1 to 100 letters, digits, underscores and hyphens."""
    if not _NAME.fullmatch(tenant):
        raise ValueError(f"invalid collection id {tenant!r}")
    return f"rag_{tenant}"


class VectorStore(Protocol):
    """What the engine asks of a store of collections."""

    def create(self, name: str, dimension: int) -> bool: ...

    def exists(self, name: str) -> bool: ...

    def drop(self, name: str) -> bool: ...

    def read(self, name: str) -> DataFrame: ...

    def upsert(self, name: str, points: DataFrame, mode: str = "merge") -> bool: ...

    def delete(self, name: str, doc_ids: DataFrame) -> bool: ...

    def count(self, name: str) -> int: ...

    def info(self, name: str) -> DataFrame: ...

    def search(self, name: str, queries: DataFrame, top_k: int = 5, where: dict | None = None) -> DataFrame: ...


@dataclass
class Store:
    """Collections under ``root``, which may be in any store that Spark reads.

    A collection is a folder ``collection=NAME`` with versions; each version is complete, and a file beside
    them says which one is current, so that readers never see half a rewrite. Reading one collection touches
    no file of another.
    """

    spark: SparkSession
    root: str

    #: Whether metadata keep their types.
    typed = False

    # -- files, through Hadoop's file system so that any store works

    def _fs(self, path: str):
        jvm = self.spark._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _folder(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/collection={name}"

    def _info(self, name: str) -> dict | None:
        fs, path = self._fs(f"{self._folder(name)}/current.json")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _set_info(self, name: str, info: dict) -> None:
        fs, path = self._fs(f"{self._folder(name)}/current.json")
        stream = fs.create(path, True)
        stream.write(bytearray(json.dumps(info).encode()))
        stream.close()

    # -- collections

    def create(self, name: str, dimension: int) -> bool:
        """True if the collection is new; an existing one stays as it is."""
        if self._info(name) is not None:
            return False
        self._set_info(name, {"dimension": dimension, "version": None})
        return True

    def exists(self, name: str) -> bool:
        return self._info(name) is not None

    def drop(self, name: str) -> bool:
        """Removes a collection; True also if there was none."""
        fs, path = self._fs(self._folder(name))
        fs.delete(path, True)
        return True

    def read(self, name: str) -> DataFrame:
        """The points of a collection; no rows if it is empty or missing."""
        info = self._info(name)
        if info is None or info["version"] is None:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self._folder(name)}/{info['version']}")

    def _write(self, name: str, points: DataFrame, info: dict) -> None:
        """A new current version; the one before stays for readers that have planned with it, and goes with the next write.

        Points are numbered as they are written, so that a search can name each by a number that no other point of the version has.
        """
        version = f"version={uuid.uuid4().hex}"
        points.drop("vec_id").withColumn("vec_id", F.monotonically_increasing_id()).write.parquet(f"{self._folder(name)}/{version}")
        oldest = info.get("previous")
        self._set_info(name, info | {"version": version, "previous": info["version"]})
        if oldest:
            self._delete(f"{self._folder(name)}/{oldest}")

    def _delete(self, at: str) -> None:
        fs, path = self._fs(at)
        fs.delete(path, True)

    def staged(self, df: DataFrame, *by: str) -> DataFrame:
        """``df`` written once and read again, so that what it costs, as embeddings do, is paid once; gone by ``unstage`` or when the driver ends.

        The table is parted ``by`` columns where there are some. It is compressed more than Spark would, and shuffle files go when it is written.
        """
        return self.staged_parts([df], *by)

    def staged_parts(self, parts: Iterable[DataFrame], *by: str) -> DataFrame:
        """``staged`` of one table from ``parts`` with the same columns, written one after another: an exchange holds no more than one of them."""
        at, schema = f"{self.root.rstrip('/')}/staging/{uuid.uuid4().hex}", None
        for part in parts:
            schema = part.schema
            with released(part):
                part.write.mode("append").option("compression", COMPRESSION).partitionBy(*by).parquet(at)
        fs, path = self._fs(at)
        fs.deleteOnExit(path)
        out = self.spark.read.schema(schema).parquet(at)
        _STAGED[out] = at
        return out

    def unstage_part(self, df: DataFrame, name: str, value: int) -> None:
        """Deletes the rows of one value of a column that ``df`` was ``staged`` by, when nothing reads them any more."""
        self._delete(f"{_STAGED[df]}/{name}={value}")

    def unstage(self, df: DataFrame) -> None:
        """Deletes what ``staged`` wrote, when nothing reads it any more."""
        at = _STAGED.pop(df, None)
        if at is not None:
            self._delete(at)

    def upsert(self, name: str, points: DataFrame, mode: str = "merge") -> bool:
        """Adds points (doc_id, text, embedding, metadata), all or none.

        False if the collection is missing or a vector has another dimension. ``append`` gives each point a new id
        and keeps all; ``merge`` replaces points with the same doc_id, the last of repeated ones by text, vector and
        metadata winning. ``points`` is computed once: it is written beside the collection before it is looked at.
        """
        info = self._info(name)
        if info is None:
            return False
        rows = staged = self.staged(points.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("embedding").cast("array<float>").alias("embedding"), F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")).alias("metadata")))
        wrong = F.col("embedding").isNull() | (F.size("embedding") != info["dimension"])
        if rows.agg(F.count_if(wrong).alias("n")).first()["n"]:
            self.unstage(staged)
            return False
        rows = rows.select(F.expr("uuid()").alias("point_id") if mode == "append" else F.sha2(F.col("doc_id"), 256).alias("point_id"), "doc_id", "text", "embedding", "metadata")
        if mode == "append":
            self._write(name, self.read(name).select(*rows.columns).unionByName(rows), info)
            self.unstage(staged)
            return True
        item = F.struct(F.coalesce("text", F.lit("")).alias("_t"), "text", "embedding", F.array_sort(F.map_entries("metadata")).alias("_m"), "point_id")
        last = rows.groupBy("doc_id").agg(F.max(item).alias("_p")).select("_p.point_id", "doc_id", "_p.text", "_p.embedding", F.map_from_entries("_p._m").alias("metadata"))
        kept = self.read(name).join(last.select("doc_id"), "doc_id", "left_anti").select(*last.columns)
        self._write(name, kept.unionByName(last), info)
        self.unstage(staged)
        return True

    def delete(self, name: str, doc_ids: DataFrame) -> bool:
        """Removes the points of ``doc_ids`` (doc_id); ids that are not there do not matter."""
        info = self._info(name)
        if info is None or info["version"] is None:
            return True
        gone = doc_ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
        self._write(name, self.read(name).join(gone, "doc_id", "left_anti").select("point_id", "doc_id", "text", "embedding", "metadata"), info)
        return True

    def count(self, name: str) -> int:
        return self.read(name).count()

    def info(self, name: str) -> DataFrame:
        """One row: provider, collection, dimension, points, status, metric."""
        info = self._info(name)
        return self.read(name).agg(F.count(F.lit(1)).alias("total_points")).select(
            F.lit("parquet").alias("provider"), F.lit(name).alias("collection"), F.lit(info and info["dimension"]).cast("int").alias("dimension"), "total_points", F.lit("ready" if info else "missing").alias("status"), F.lit(METRIC).alias("metric")
        )

    def search(self, name: str, queries: DataFrame, top_k: int = 5, where: dict | None = None) -> DataFrame:
        """(query_id, rank, id, score, text, metadata): the nearest points that match all of ``where`` (metadata equality).

        Queries of another dimension have no results. Texts join after the top k, by the number of the point; in versions written
        before points had numbers, by a hash of the id.
        """
        points = self.read(name)
        for key, value in (where or {}).items():
            points = points.where(F.col("metadata")[key] == F.lit(str(value)))
        points = points.withColumn("vec_id", F.coalesce("vec_id", F.xxhash64("point_id")))
        hits = knn.top_k(queries, points.select("vec_id", "embedding"), top_k)
        return hits.join(points.select("vec_id", "doc_id", "text", "metadata"), "vec_id").select("query_id", "rank", F.col("doc_id").alias("id"), "score", "text", "metadata")


_STORES: dict[str, Callable[[SparkSession, str], VectorStore]] = {"parquet": Store}


def register(name: str, factory: Callable[[SparkSession, str], VectorStore]) -> None:
    _STORES[name] = factory


def create(provider: str, spark: SparkSession, root: str) -> VectorStore:
    """A store of collections under ``root`` by the name of its provider."""
    if provider not in _STORES:
        raise ValueError(f"unknown store provider {provider!r}; there are {sorted(_STORES)}")
    return _STORES[provider](spark, root)
