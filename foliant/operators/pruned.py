"""Exact cosine search that looks only at the rings of vectors that can hold a result.

Vectors belong to the cell of the nearest of a bounded number of centres and are laid out by cell and by angle to its
centre, in rings of near angles. A query at angle a to a centre is at least as far from a vector of a ring as a is from
the ring's angles, since angles obey the triangle inequality. What is best in a query's own cell tells which rings of others matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators import knn

#: Bounds give way by this much, which is far above the error of an angle in double precision.
SLACK = 1e-6
#: Vectors of a cell that meet queries in one task; larger cells are split.
TASK_ROWS = 262_144
#: Groups of queries whose best hits a task keeps at a time.
HELD = 64
#: Blocks of queries whose best hits a task keeps while rings pass by.
HELD_BLOCKS = 256
#: Vectors of the sample for each centre.
MEMBERS = 32
_PLACED = "cell int, angle double, id bigint, unit binary"
_GROUP = "cell int, q_ids binary, q_angles binary, q_floors binary, q_data binary"
_HIT = "query_id bigint, vec_id bigint, score double, compared bigint"


def _angles(data: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(data @ centres.T, -1.0, 1.0))


def _gaps(angles: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The least angle between a vector at ``angles`` to a centre and one whose angle is from ``near`` to ``far``."""
    return np.maximum(np.maximum(near - angles, angles - far), 0.0)


def fitted_centres(sample: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    """At most ``cells`` unit centres of unit vectors, by rounds of assignment and mean from the first ``cells`` distinct ones."""
    _, first = np.unique(sample, axis=0, return_index=True)
    centres = sample[np.sort(first)[:cells]]
    for _ in range(rounds if len(centres) else 0):
        home = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def _packed(cells: np.ndarray, most: int) -> Iterator[tuple[int, slice]]:
    """Runs of equal cells in order, none longer than ``most``."""
    ends = np.append(np.flatnonzero(np.diff(cells)) + 1, len(cells))
    start = 0
    for end in ends:
        for at in range(start, end, most):
            yield int(cells[at]), slice(at, min(at + most, end))
        start = end


@dataclass
class PrunedIndex:
    """Vectors under ``path`` (a folder that all executors share), laid out for pruned search.

    ``cells`` bounds the number of centres and ``sample`` the vectors they are fitted on, those whose ids have the smallest
    hashes. Both change the time a search takes and never its results: every usable vector is in a ring.
    """

    spark: SparkSession
    path: str
    cells: int = 256
    sample: int = 8192

    def build(self, vectors: DataFrame, dimension: int) -> None:
        """Lays out ``vectors`` (vec_id, embedding) in place of what was there.

        Left out are vectors of another length, null and zero ones, and those with null or non-finite components; of an
        empty table the index is empty. Equal vectors and repeated ids stay apart.
        """
        rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where((F.size("embedding") == dimension) & F.col("id").isNotNull())
        drawn = rows.orderBy(F.xxhash64("id"), "id").limit(self.sample).toArrow()
        parts = [data for batch in drawn.to_batches() for _, _, data in knn.units(batch)]
        sample = np.concatenate(parts) if parts else np.zeros((0, dimension))
        centres = fitted_centres(sample, min(self.cells, max(1, len(sample) // MEMBERS)))
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, ids, data in knn.units(batch):
                    if len(ids) and len(centres):
                        angles = _angles(data, centres)
                        home = angles.argmin(axis=1)
                        yield pa.record_batch([pa.array(home.astype(np.int32)), pa.array(angles[np.arange(len(ids)), home]), pa.array(ids), pa.array([v.tobytes() for v in data], pa.binary())], names=["cell", "angle", "id", "unit"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                angles, ids, unit = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_pylist()
                made = [(c, float(angles[s].min()), float(angles[s].max()), s.stop - s.start, ids[s].astype(np.int64).tobytes(), b"".join(unit[s])) for c, s in _packed(batch.column(0).to_numpy(zero_copy_only=False), knn.ROWS)]
                kinds = (pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*made, strict=True), kinds, strict=True)], names=["cell", "near", "far", "n", "ids", "data"])

        placed = rows.mapInArrow(place, _PLACED)
        laid = placed.repartitionByRange("cell", "angle", "id").sortWithinPartitions("cell", "angle", "id")
        laid.mapInArrow(pack, "cell int, near double, far double, n bigint, ids binary, data binary").write.mode("overwrite").parquet(f"{self.path}/rings")

    def rings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rings")

    def _shape(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, centres and sizes: as many rows as there are cells."""
        made = self.rings().groupBy("cell").agg(F.sum("n").alias("n"))
        rows = made.join(self.spark.read.parquet(f"{self.path}/centres"), "cell").orderBy("cell").collect()
        column = lambda name, kind: np.array([r[name] for r in rows], kind)
        return column("cell", np.int32), column("centre", np.float64), column("n", np.int64)

    def _scanned(self, groups: DataFrame, salts: Column, k: int, exclude_self: bool) -> DataFrame:
        """Hits of groups of queries in the rings of their cells, and a row for each query that says how many it was compared with."""

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[bytes, list] = {}

            def given() -> Iterator[pa.RecordBatch]:
                for ids, values, names, compared in held.values():
                    a, b = np.nonzero(values > -np.inf)
                    none, zero = [None] * len(ids), np.zeros(len(a), np.int64)
                    yield pa.record_batch([pa.array(ids[a]), pa.array(names[a, b]), pa.array(values[a, b]), pa.array(zero)], names=["query_id", "vec_id", "score", "compared"])
                    yield pa.record_batch([pa.array(ids), pa.array(none, pa.int64()), pa.array(none, pa.float64()), pa.array(compared)], names=["query_id", "vec_id", "score", "compared"])
                held.clear()

            for batch in batches:
                for r in batch.to_pylist():
                    q_ids, angles, floors = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_angles"]), np.frombuffer(r["q_floors"])
                    key = r["q_ids"] + r["cell"].to_bytes(4, "little")
                    if key not in held:
                        if len(held) >= HELD:
                            yield from given()
                        held[key] = [q_ids, np.full((len(q_ids), k), -np.inf), np.zeros((len(q_ids), k), np.int64), np.zeros(len(q_ids), np.int64)]
                    _, values, names, compared = held[key]
                    reach = np.cos(_gaps(angles, r["near"], r["far"])) + SLACK
                    bar = np.maximum(floors, values[:, -1])
                    live = np.flatnonzero(reach >= bar)
                    if not len(live):
                        continue
                    ids = np.frombuffer(r["ids"], np.int64)
                    q, x = (np.frombuffer(r[c]).reshape(n, -1) for c, n in (("q_data", len(q_ids)), ("data", len(ids))))
                    scores = np.round(q[live] @ x.T, knn.DIGITS)
                    if exclude_self:
                        scores = np.where(ids == q_ids[live][:, None], -np.inf, scores)
                    some = (scores >= bar[live][:, None]).any(axis=1)
                    if some.any():
                        up, better = live[some], scores[some]
                        values[up], names[up] = knn._best(np.concatenate([values[up], better], axis=1), np.concatenate([names[up], np.broadcast_to(ids, better.shape)], axis=1), k)
                    compared[live] += len(ids)
            yield from given()

        rings = self.rings().withColumn("salt", F.pmod(F.xxhash64("ids"), salts))
        asked = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
        return rings.join(asked, ["cell", "salt"]).drop("salt", "n").mapInArrow(scan, _HIT)

    def _abroad(self, asked: DataFrame, centres: np.ndarray, cells: np.ndarray, k: int, exclude_self: bool) -> DataFrame:
        """As ``_scanned``, of queries (query_id, embedding, floor) in the cells that are not their own.

        Queries near each other travel together, once, and meet the rings where these are stored: nothing is exchanged for each pair of
        query and cell, of which there may be as many as queries times cells. A ring that none of them reaches is not scored.
        """
        place_of = np.full(int(cells.max()) + 1, -1)
        place_of[cells] = np.arange(len(cells))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                floor_of = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
                for dim, ids, data in knn.units(batch):
                    if dim == centres.shape[1] and len(ids):
                        angles = _angles(data, centres)
                        home = angles.argmin(axis=1)
                        floors = np.array([-np.inf if floor_of[i] is None else floor_of[i] for i in ids.tolist()])
                        yield pa.record_batch([pa.array(home.astype(np.int32)), pa.array(angles[np.arange(len(ids)), home]), pa.array(ids), pa.array(floors), pa.array([v.tobytes() for v in data], pa.binary())], names=["home", "angle", "id", "floor", "unit"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, knn.ROWS):
                    part = batch.slice(at, knn.ROWS)
                    home, ids, floors = (part.column(c).to_numpy(zero_copy_only=False) for c in ("home", "id", "floor"))
                    made = (ids.astype(np.int64).tobytes(), home.astype(np.int32).tobytes(), floors.tobytes(), b"".join(part.column("unit").to_pylist()))
                    yield pa.record_batch([pa.array([x], pa.binary()) for x in made], names=["q_ids", "q_homes", "q_floors", "q_data"])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple] = {}

            def given() -> Iterator[pa.RecordBatch]:
                for ids, values, names, compared in held.values():
                    a, b = np.nonzero(values > -np.inf)
                    some = np.flatnonzero(compared)
                    none, zero = [None] * len(some), np.zeros(len(a), np.int64)
                    yield pa.record_batch([pa.array(ids[a]), pa.array(names[a, b]), pa.array(values[a, b]), pa.array(zero)], names=["query_id", "vec_id", "score", "compared"])
                    yield pa.record_batch([pa.array(ids[some]), pa.array(none, pa.int64()), pa.array(none, pa.float64()), pa.array(compared[some])], names=["query_id", "vec_id", "score", "compared"])
                held.clear()

            for batch in batches:
                for i in range(batch.num_rows):
                    r = {c: batch.column(c)[i] for c in batch.schema.names}
                    key, cell = r["q_block"].as_py(), r["cell"].as_py()
                    q_ids, homes, floors = (np.frombuffer(r[c].as_buffer(), t) for c, t in (("q_ids", np.int64), ("q_homes", np.int32), ("q_floors", np.float64)))
                    if key not in held:
                        if len(held) >= HELD_BLOCKS:
                            yield from given()
                        held[key] = (q_ids.copy(), np.full((len(q_ids), k), -np.inf), np.zeros((len(q_ids), k), np.int64), np.zeros(len(q_ids), np.int64))
                    _, values, names, compared = held[key]
                    q = np.frombuffer(r["q_data"].as_buffer()).reshape(len(q_ids), -1)
                    gaps = _gaps(_angles(q, centres[place_of[cell]][None, :])[:, 0], r["near"].as_py(), r["far"].as_py())
                    bar = np.maximum(floors, values[:, -1])
                    live = np.flatnonzero((homes != place_of[cell]) & (np.cos(gaps) + SLACK >= bar))
                    if not len(live):
                        continue
                    ids = np.frombuffer(r["ids"].as_buffer(), np.int64)
                    x = np.frombuffer(r["data"].as_buffer()).reshape(len(ids), -1)
                    for at in range(0, len(live), knn.QUERIES):
                        mine = live[at : at + knn.QUERIES]
                        scores = q[mine] @ x.T
                        a, b = np.nonzero(scores >= bar[mine][:, None] - knn.SLACK)
                        v, n, line = np.round(scores[a, b], knn.DIGITS), ids[b], mine[a]
                        keep = v >= bar[line]
                        if exclude_self:
                            keep &= n != q_ids[line]
                        knn._merge(line[keep], v[keep], n[keep], values, names)
                    compared[live] += len(ids)
            yield from given()

        parts = max(1, -(-asked.count() // knn.TASK_QUERIES))
        placed = asked.select("query_id", "embedding", "floor").mapInArrow(place, "home int, angle double, id bigint, floor double, unit binary")
        laid = placed.repartitionByRange(parts, "home", "angle", "id").sortWithinPartitions("home", "angle", "id")
        blocks = laid.mapInArrow(pack, "q_ids binary, q_homes binary, q_floors binary, q_data binary").withColumn("q_block", F.monotonically_increasing_id())
        return self.rings().drop("n").crossJoin(blocks).mapInArrow(scan, _HIT)

    def search(self, queries: DataFrame, k: int = 5, exclude_self: bool = False) -> DataFrame:
        """(query_id, rank, vec_id, score, compared): the ``k`` nearest by cosine, ties by the smaller vec_id.

        The same rows as those of ``knn.top_k``; ``compared`` says with how many vectors a query was compared. Queries
        (query_id, embedding) have ids of their own; those whose vector cannot be compared have no rows. The first hits of queries are written
        beside the index, where the result reads them.
        """
        cells, centres, sizes = self._shape()
        if not len(cells):
            return self.spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, compared bigint")
        by_cell = np.ones(int(cells.max()) + 1, np.int64)
        by_cell[cells] = -(-sizes // TASK_ROWS)
        salts = F.element_at(F.array(*(F.lit(int(x)) for x in by_cell)), F.col("cell") + 1).cast("long")
        dimension = centres.shape[1]

        def grouped(q: np.ndarray, c: np.ndarray, ids: np.ndarray, data: np.ndarray, angles: np.ndarray, floors: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Queries ``q`` asked of the cells at ``c``, as groups of one cell each."""
            order = np.argsort(c, kind="stable")
            q, c = q[order], c[order]
            for at, s in _packed(c, knn.ROWS):
                mine = q[s]
                yield pa.record_batch([pa.array([int(cells[at])], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids[mine], angles[mine, at], floors[mine], data[mine]))], names=["cell", "q_ids", "q_angles", "q_floors", "q_data"])

        def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, ids, data in knn.units(batch):
                    if dim == dimension and len(ids):
                        angles = _angles(data, centres)
                        yield from grouped(np.arange(len(ids)), angles.argmin(axis=1), ids, data, angles, np.full(len(ids), -np.inf))

        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        first = self._best(self._scanned(asked.mapInArrow(at_home, _GROUP), salts, k, exclude_self), k)
        at = f"{self.path}/first-{uuid.uuid4().hex}"
        first.write.parquet(at)
        first = self.spark.read.schema(first.schema).parquet(at)
        floors = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        second = self._abroad(asked.join(floors, "query_id", "left"), centres, cells, k, exclude_self)
        # a query's count of the first part stands in its hit of rank 1, or in a row without a hit
        before = first.select("query_id", "vec_id", "score", F.when(F.coalesce("rank", F.lit(1)) == 1, F.col("compared")).otherwise(0).alias("compared"))
        return self._best(before.unionByName(second), k).where("vec_id is not null")

    @staticmethod
    def _best(found: DataFrame, k: int) -> DataFrame:
        """The ``k`` best hits of each query, with how many vectors it was compared with; a row without a hit where there is none."""
        by_query = Window.partitionBy("query_id")
        place = F.row_number().over(by_query.orderBy(F.desc_nulls_last("score"), F.asc("vec_id")))
        ranked = found.withColumns({"rank": place, "compared": F.sum("compared").over(by_query)})
        return ranked.where((F.col("rank") <= k) & (F.col("vec_id").isNotNull() | (F.col("rank") == 1))).select("query_id", "rank", "vec_id", "score", "compared")
