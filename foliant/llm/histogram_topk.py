"""Exact top-k search by distributed histogram selection.

Scores are integer inner products of vectors scaled and rounded down. All of them are computed in every pass,
block by block. A pass counts each query's scores in bins of its current range; the bin that holds the kth
highest score becomes the next range, until a bin is one score wide. The last pass keeps what reaches that score and
breaks ties by the smaller id. A task's histogram is cut below its own kth score, which cannot be above the global
one, so that it returns at most k bins for a query, however the scores are spread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import pick, stored

#: Rows of a block, and queries that one task holds.
ROWS, QUERIES = 1024, 4096
BINS = 4096
#: Whole numbers up to here are exact in double precision.
EXACT = float(1 << 53)


@dataclass(frozen=True)
class Search:
    k: int = 5
    scale: int = 256


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part: an id, and a vector of finite numbers without nulls."""
    rows = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)


_BLOCK = "dim int, ids binary, data binary, low binary"


def _blocks(rows: DataFrame, scale: int) -> DataFrame:
    """Rows (vec_id, embedding, low) packed into blocks of one dimension: ids and low as int64, data as float64."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, lists, low = zip(*held.pop(dim), strict=True)
            data = np.floor(np.array(lists, np.float64) * scale)
            return pa.record_batch([pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([data.tobytes()]), pa.array([np.array(low, np.int64).tobytes()])], names=["dim", "ids", "data", "low"])

        for batch in batches:
            for row in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), batch.column("low").to_pylist(), strict=True):
                dim = len(row[1])
                held.setdefault(dim, []).append(row)
                if len(held[dim]) >= ROWS:
                    yield block(dim)
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(pack, _BLOCK)


def _scores(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products, exact; they are held as doubles, and as whole numbers where doubles would round."""
    if np.abs(q).max(initial=0) * np.abs(r).max(initial=0) * q.shape[1] < EXACT:
        return q @ r.T
    whole = [[int(x) for x in row] for row in q], [[int(x) for x in row] for row in r]
    return np.array([[max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(x, y, strict=True)))) for y in whole[1]] for x in whole[0]], object)


def _places(scores: np.ndarray, low: np.ndarray, span: int, width: int) -> np.ndarray:
    """The bin of each score in its query's range, or -1; where doubles would round, by whole numbers of any size."""
    own = scores == -np.inf
    if span < EXACT / 2 and scores.dtype != object:
        at = scores - low[:, None].astype(np.float64)
        return np.where(~own & (at >= 0) & (at < span), at // width, -1)
    gaps = np.where(own, 0, scores).astype(object) - low.astype(object)[:, None]
    whole = [[int(g) // width if 0 <= g < span else -1 for g in line] for line in gaps]
    return np.where(own, -1, np.array(whole, np.float64).reshape(scores.shape))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(query ids, low, row ids, scores) of each pair of blocks; a query's own rows score None's stand-in, minus infinity."""
    for batch in batches:
        for row in batch.to_pylist():
            if row["dim"] != row["r_dim"]:
                continue
            qi, ri = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["r_ids"], np.int64)
            q, r = (np.frombuffer(row[c], np.float64).reshape(-1, row["dim"]) for c in ("data", "r_data"))
            scores = _scores(q, r)
            order = np.argsort(ri, kind="stable")
            first, last = np.searchsorted(ri[order], qi, "left"), np.searchsorted(ri[order], qi, "right")
            for x in np.flatnonzero(last > first):
                scores[x, order[first[x] : last[x]]] = -np.inf
            yield row["ids"], qi, np.frombuffer(row["low"], np.int64), ri, scores


def _against(queries: DataFrame, rows: DataFrame, n_queries: int, scale: int) -> DataFrame:
    """Every block of queries beside every block of rows."""
    q = _blocks(queries.coalesce(max(1, -(-n_queries // QUERIES))), scale)
    r = _blocks(rows.withColumn("low", F.lit(0).cast("long")), scale).select(F.col("dim").alias("r_dim"), F.col("ids").alias("r_ids"), F.col("data").alias("r_data"))
    return r.crossJoin(q)


def _refine(ranges: DataFrame, queries: DataFrame, rows: DataFrame, n_queries: int, span: int, width: int, how: Search) -> DataFrame:
    """The next ranges (query_id, low, above), from ranges of ``span`` scores: the bin of ``width`` with the kth score, and how many scores lie over it."""
    k = how.k

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple] = {}
        for key, qi, low, _, scores in _pairs(batches):
            at = _places(scores, low, span, width)
            if at.shape[1] > k:
                at = np.partition(at, at.shape[1] - k, axis=1)[:, -k:]
            if key in best:
                at = np.concatenate([best[key][1], at], axis=1)
                at = np.partition(at, at.shape[1] - k, axis=1)[:, -k:] if at.shape[1] > k else at
            best[key] = (qi, at)
        for qi, at in best.values():
            x, y = np.nonzero(at >= 0)
            yield pa.record_batch([pa.array(qi[x]), pa.array(at[x, y].astype(np.int64))], names=["query_id", "bin"])

    vectors = queries.join(ranges.select(F.col("query_id").alias("vec_id"), "low"), "vec_id").select("vec_id", "embedding", "low")
    bins = _against(vectors, rows, n_queries, how.scale).mapInArrow(count, "query_id bigint, bin bigint").groupBy("query_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
    over = bins.join(ranges, "query_id").withColumn("_over", F.sum("n").over(down) - F.col("n") + F.col("above"))
    found = over.where((F.col("_over") < k) & (F.col("_over") + F.col("n") >= k)).select("query_id", "bin", F.col("_over"))
    # With fewer than k scores there is no such bin: the range stays at its lowest bin.
    wide = lambda c: c.cast("decimal(20,0)")
    moved = (wide(F.col("low")) + wide(F.coalesce("bin", F.lit(0))) * wide(F.lit(width))).cast("long")
    return ranges.join(found, "query_id", "left").select("query_id", moved.alias("low"), F.when(F.col("bin").isNull(), F.col("above")).otherwise(F.col("_over")).alias("above"))


def top_k(queries: DataFrame, vectors: DataFrame, how: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest scores among all rows but those with its own id.

    Both tables have vec_id and embedding. Rows with a null id, and vectors that are null, empty, or hold null or
    non-finite components take no part. Vectors are compared with those of equal length. Equal scores
    rank by the smaller vec_id; rows that repeat an id are candidates of their own, and of a query id that
    repeats one row (the least vector) is asked. A query with fewer than ``k`` candidates gets them all. Scores beyond
    a long are cut to its range. Empty tables give no rows. The queries of a task and the blocks are bounded, and so
    is what a task returns, by k for each query.
    """
    spark = vectors.sparkSession
    rows, asked = usable(vectors), usable(queries)
    asked = stored(asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    size = rows.agg(F.max(F.array_max(F.transform("embedding", F.abs))).alias("most"), F.max(F.size("embedding")).alias("dim")).first()
    size_q = asked.agg(F.max(F.array_max(F.transform("embedding", F.abs))).alias("most"), F.count(F.lit(1)).alias("n")).first()
    if size["dim"] is None or not size_q["n"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    whole = lambda x: int(np.ceil(x * how.scale)) + 1
    bound = min((1 << 63) - 1, size["dim"] * whole(size["most"]) * whole(size_q["most"]))
    ranges = asked.select(F.col("vec_id").alias("query_id"), F.lit(-bound).cast("long").alias("low"), F.lit(0).cast("long").alias("above"))
    width = 2 * bound + 1
    while width > 1:
        span, width = width, -(-width // BINS)
        ranges = stored(_refine(ranges, asked, rows, size_q["n"], span, width, how), "ranges")
    k = how.k

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        for _, qi, low, ri, scores in _pairs(batches):
            floor = low[:, None] if np.abs(low).max(initial=0) < EXACT and scores.dtype != object else low.astype(object)[:, None]
            x, y = np.nonzero((scores >= floor) & (scores != -np.inf))
            if not len(x):
                continue
            s = scores[x, y]
            order = np.lexsort((ri[y], np.array([-int(v) for v in s], object if s.dtype == object else np.int64), x))
            x, y, s = x[order], y[order], s[order]
            begin = np.searchsorted(x, x, "left")
            for i in np.flatnonzero(np.arange(len(x)) - begin < k).tolist():
                best.setdefault(int(qi[x[i]]), []).append((-int(s[i]), int(ri[y[i]])))
            for q in set(qi[x].tolist()):
                best[q] = sorted(best[q])[:k]
        flat = [(q, v, -s) for q, found in best.items() for s, v in found]
        yield pa.record_batch([pa.array([f[i] for f in flat], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    final = asked.join(ranges.select(F.col("query_id").alias("vec_id"), "low"), "vec_id").select("vec_id", "embedding", "low")
    found = _against(final, rows, size_q["n"], how.scale).mapInArrow(take, "query_id bigint, vec_id bigint, score bigint")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
