"""Exact cosine search: the k nearest vectors for each of many queries."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries that are scored by one matrix product.
ROWS, QUERIES = 2048, 512
#: Queries and vectors that meet in one task, at most.
TASK_QUERIES, TASK_ROWS = 16_384, 32_768
#: Vectors, and components, of a block as it travels.
BLOCK_ROWS, BLOCK_SIZE = 8192, 1 << 20
#: Scores are compared after rounding, so that equal vectors tie however their sums were ordered.
DIGITS = 9
#: What a score may lose by rounding, and more.
SLACK = 1e-8


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, vectors) of the rows of a batch whose vectors are neither null nor empty and hold no null, by length."""
    named, lists = batch.column(0), batch.column(1)
    if len(lists) and not named.null_count and not lists.null_count:
        flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
        if not flat.null_count and sizes[0] and (sizes == sizes[0]).all():
            yield int(sizes[0]), named.to_numpy(), flat.to_numpy().reshape(len(lists), -1)
            return
    by_size: dict[int, list[tuple[int, list]]] = {}
    for i, v in zip(named.to_pylist(), lists.to_pylist(), strict=True):
        if v and None not in v:
            by_size.setdefault(len(v), []).append((i, v))
    for dim, held in by_size.items():
        yield dim, np.array([i for i, _ in held], np.int64), np.array([v for _, v in held], np.float64)


def units(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, unit vectors) of the usable rows (id, embedding) of a batch, by length of the vectors."""
    for dim, ids, data in _arrays(batch):
        most = np.abs(data).max(axis=1)
        usable = np.isfinite(most) & (most > 0)
        ids, data = ids[usable], data[usable] / most[usable, None]
        data /= np.sqrt((data * data).sum(axis=1, keepdims=True))
        yield dim, ids, data


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows (id long, embedding) as blocks of at most ``most`` ids and their unit vectors.

    Vectors that are null, empty or zero, or hold null or non-finite components, are left out. Vectors are scaled by their
    greatest component first, which keeps their squares in range.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def given(dim: int) -> Iterator[pa.RecordBatch]:
            ids, data = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            size = max(1, min(most, BLOCK_SIZE // dim))
            for at in range(0, len(ids), size):
                yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([ids[at : at + size].tobytes()]), pa.array([data[at : at + size].tobytes()])], names=["dim", "ids", "data"])

        for batch in batches:
            for dim, ids, data in units(batch):
                held.setdefault(dim, []).append((ids, data))
                if sum(len(x) for x, _ in held[dim]) >= min(most, BLOCK_SIZE // dim):
                    yield from given(dim)
        for dim in list(held):
            yield from given(dim)

    return rows.mapInArrow(pack, "dim int, ids binary, data binary")


def _best(values: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each line's ``k`` greatest values, equal ones by the smaller name, and their names; only what reaches the kth is sorted."""
    floor = np.partition(values, -k, axis=1)[:, -k] if values.shape[1] > k else np.full(len(values), -np.inf)
    x, y = np.nonzero(values >= floor[:, None])
    v, n = values[x, y], names[x, y]
    order = np.lexsort((n, -v, x))
    x, v, n = x[order], v[order], n[order]
    place = np.arange(len(x)) - np.searchsorted(x, x)
    keep = place < k
    out, out_names = np.full((len(values), k), -np.inf), np.zeros((len(values), k), np.int64)
    out[x[keep], place[keep]], out_names[x[keep], place[keep]] = v[keep], n[keep]
    return out, out_names


def _met(own: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, values: np.ndarray, names: np.ndarray, exclude_self: bool) -> None:
    """Brings the hits of queries (``own``, ``q``) among vectors (``ids``, ``x``) into ``values`` and ``names``, their best so far.

    Only scores that come near a query's last hit are rounded and sorted; all are, until there are as many hits as are asked for.
    """
    k, scores = values.shape[1], q @ x.T
    bar = values[:, -1]
    if np.isneginf(bar).any():
        scores = np.round(scores, DIGITS)
        named = np.broadcast_to(ids, scores.shape)
        if exclude_self:
            scores = np.where(named == own[:, None], -np.inf, scores)
        values[:], names[:] = _best(np.concatenate([values, scores], axis=1), np.concatenate([names, named], axis=1), k)
        return
    a, b = np.nonzero(scores >= bar[:, None] - SLACK)
    v, n = np.round(scores[a, b], DIGITS), ids[b]
    keep = (v > bar[a]) | ((v == bar[a]) & (n < names[a, -1]))
    if exclude_self:
        keep &= n != own[a]
    _merge(a[keep], v[keep], n[keep], values, names)


def _merge(a: np.ndarray, v: np.ndarray, n: np.ndarray, values: np.ndarray, names: np.ndarray) -> None:
    """Brings hits (line, value, name) into the lines of ``values`` and ``names``, which are in order."""
    if not len(a):
        return
    k, up = values.shape[1], np.unique(a)
    line, v, n = np.concatenate([np.repeat(up, k), a]), np.concatenate([values[up].ravel(), v]), np.concatenate([names[up].ravel(), n])
    order = np.lexsort((n, -v, line))
    line, v, n = line[order], v[order], n[order]
    place = np.arange(len(line)) - np.searchsorted(line, line)
    best = place < k
    values[line[best], place[best]], names[line[best], place[best]] = v[best], n[best]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, where: Mapping[str, object] | None = None, exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest by cosine, ties by the smaller vec_id.

    ``queries`` has query_id and embedding, ``vectors`` vec_id, embedding and what ``where`` compares for equality;
    that filter reaches the scan. Both are dealt out by number, so that a task holds a bounded number of queries against
    a bounded number of vectors, however they are stored; a task returns k rows for each query, so that only these are exchanged.
    A query whose vector is null or zero, is not finite, or has another length than the stored ones, has no results.
    """
    for name, value in (where or {}).items():
        vectors = vectors.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    asked_parts, n = max(1, -(-queries.count() // TASK_QUERIES)), vectors.count()
    idle = queries.sparkSession.sparkContext.defaultParallelism // asked_parts
    parts = max(1, -(-n // TASK_ROWS), min(idle, -(-n // ROWS)))
    rows = _blocks(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).repartition(parts), BLOCK_ROWS)
    asked = _blocks(queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>")).repartition(asked_parts), TASK_QUERIES)
    pairs = rows.crossJoin(asked.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.monotonically_increasing_id().alias("q_block")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in batch.schema.names}
                dim, key = r["dim"].as_py(), r["q_block"].as_py()
                if dim != r["q_dim"].as_py():
                    continue
                ids, q_ids = (np.frombuffer(r[c].as_buffer(), np.int64) for c in ("ids", "q_ids"))
                x, q = (np.frombuffer(r[c].as_buffer(), np.float64).reshape(-1, dim) for c in ("data", "q_data"))
                if key not in best:
                    best[key] = (q_ids.copy(), np.full((len(q_ids), k), -np.inf), np.zeros((len(q_ids), k), np.int64))
                own, values, names = best[key]
                for a in range(0, len(q), QUERIES):
                    s = slice(a, a + QUERIES)
                    for b in range(0, len(x), ROWS):
                        _met(own[s], q[s], ids[b : b + ROWS], x[b : b + ROWS], values[s], names[s], exclude_self)
        for own, values, names in best.values():
            a, b = np.nonzero(values > -np.inf)
            yield pa.record_batch([pa.array(own[a]), pa.array(names[a, b]), pa.array(values[a, b])], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(score, "query_id bigint, vec_id bigint, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
