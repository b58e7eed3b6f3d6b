"""Embedding near-duplicates by range search on a robust-pruned flat graph.

Distinct vectors of a label are dealt into overlapping shards around cluster centres. Each shard builds a
graph: every vector's near neighbours, and some random far ones, are pruned robustly (a candidate goes if one that was
taken is nearer to it by a factor than the vector is). The adjacency lists of all shards are united. Then each vector
is searched from its shards' medoids by a greedy beam, and from what the beam found in the range the search expands over
the graph as long as it finds more. Where an edge of a vector in the range leaves the shard, the search goes on as a guest
in the shards that it leads to, round by round, until no search reaches a new shard. Links are verified in double
precision. A brute-force audit of a bounded sample measures the recall; labels below its target are compared in full,
block by block.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import discard, pick, stored
from foliant.llm.components import components


@dataclass(frozen=True)
class FlatGraph:
    similarity: float = 0.98
    #: Vectors that a shard holds at most, the children of one that is split, and the shards a vector is put in.
    shard: int = 8192
    branches: int = 16
    overlap: int = 2
    #: Vectors that the centres of one split are fitted on.
    fitted: int = 4096
    near: int = 24
    far: int = 8
    candidates: int = 64
    slack: float = 1.2
    beam: int = 16
    #: The search also passes through vectors this far below the similarity.
    margin: float = 0.05
    #: Vectors of a label, and of those near its cell borders, that the audit draws; if they hold fewer links, ``shard`` of each.
    audited: int = 256
    audited_links: int = 256
    recall: float = 0.95
    levels: int = 8


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding as doubles) of rows that can link: an id, a label, and a finite vector that is not zero."""
    rows = pick(vectors, "vec_id", "label", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision; first by their largest component, which keeps squares in range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


# -- overlapping cluster shards -----------------------------------------------------------------------


def _centres(table: pa.Table, how: FlatGraph) -> np.ndarray:
    """Spherical k-means on a bounded sample; deterministic for the same rows."""
    table = table.sort_by("rep")
    x = _unit(_matrix(table["embedding"]))
    k = min(table["_k"][0].as_py(), len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(8):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[near == c].sum(axis=0) if (near == c).any() else centres[c] for c in range(k)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return centres


def _nearest(centres: np.ndarray, v: np.ndarray, how: FlatGraph) -> tuple[np.ndarray, bool]:
    """The ``how.overlap`` centres nearest to a unit vector, nearest first, that a vector within the similarity can need.

    And whether such a vector can be nearest to a centre beyond these: only then the split can part the two.

    Let a be the centre nearest to v, and c the one nearest to a vector w within the similarity. Then (a - c)v is at most
    |a - c||v - w|. A centre with a wider gap than any such c can have is left out: where v and w share it, they share c.
    """
    score = centres @ v
    order = np.argsort(-score, kind="stable")
    near, rest = order[: how.overlap], order[how.overlap :]
    gap = score[near[0]] - score - 1e-9
    reach = np.linalg.norm(centres - centres[near[0]], axis=1) * np.sqrt(max(0.0, 2 - 2 * how.similarity))
    return near[gap[near] <= reach.max()], bool((gap[rest] <= reach[rest]).any())


def shards(reps: DataFrame, how: FlatGraph) -> DataFrame:
    """(rep, label, dim, cell, embedding, copies, cut), one row for each shard a vector is in; cells are paths of cluster numbers.

    All vectors of a label and length begin in one cell. Cells over ``how.shard`` are split, level by level, around
    centres fitted on at most about ``how.fitted`` of their vectors. At every level a vector goes to the ``how.overlap``
    nearest centres, but to none so much farther than the nearest that no vector within the similarity can be nearest to it.
    A vector is ``cut`` if it lies so near to a border that more centres could be needed.
    """
    rows = reps.withColumns({"cell": F.lit(""), "cut": F.lit(False)})
    for _ in range(how.levels):
        big = rows.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > how.shard)
        big = stored(big.withColumn("_k", F.least(F.lit(how.branches), F.ceil(F.col("_n") * how.overlap / how.shard).cast("int") + 1)), "cells")
        if big.isEmpty():
            break
        place = ["label", "dim", "cell"]
        drawn = F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = rows.join(big, place).where(drawn < F.lit(float(how.fitted)) / F.col("_n")).select(*place, "rep", "embedding", "_k")

        def fit(table: pa.Table) -> pa.Table:
            return table.select(place).slice(0, 1).append_column("_centres", pa.array([_centres(table, how).astype("<f8").tobytes()]))

        fitted = sample.groupBy(*place).applyInArrow(fit, "label string, dim int, cell string, _centres binary")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                centres, cells, take, names = batch.column("_centres").to_pylist(), batch.column("cell").to_pylist(), [], []
                before, cut = batch.column("cut").to_pylist(), []
                table = {raw: np.frombuffer(raw, "<f8") for raw in set(centres) if raw}
                vectors = batch.column("embedding")
                for i, raw in enumerate(centres):
                    if not raw:
                        take.append(i)
                        names.append(cells[i])
                        cut.append(before[i])
                        continue
                    v = _unit(np.array([vectors[i].as_py()]))[0]
                    near, beyond = _nearest(table[raw].reshape(-1, len(v)), v, how)
                    take += [i] * len(near)
                    cut += [before[i] or beyond] * len(near)
                    names += [f"{cells[i]}/{c}" for c in near.tolist()]
                part = batch.take(pa.array(take, pa.int64()))
                yield pa.record_batch([part.column("rep"), part.column("label"), part.column("dim"), pa.array(names, pa.string()), part.column("embedding"), part.column("copies"), pa.array(cut, pa.bool_())], names=["rep", "label", "dim", "cell", "embedding", "copies", "cut"])

        split = rows.join(fitted, place, "left").select("rep", "label", "dim", "cell", "embedding", "copies", "cut", "_centres")
        rows = stored(split.mapInArrow(assign, "rep bigint, label string, dim int, cell string, embedding array<double>, copies bigint, cut boolean"), "shards")
    return rows


# -- the graph ----------------------------------------------------------------------------------------


def robust_prune(x: np.ndarray, candidates: np.ndarray, most: int, slack: float) -> list[np.ndarray]:
    """Out-neighbours of each row of ``x``: of its candidates, nearest first, those that no taken one covers."""
    out = []
    for begin in range(0, len(x), 256):
        who = np.arange(begin, min(begin + 256, len(x)))
        c = candidates[who]
        gaps = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bd,bcd->bc", x[who], x[c])))
        gaps[c == who[:, None]] = np.inf
        between = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(x[c], x[c].transpose(0, 2, 1))))
        alive = np.isfinite(gaps)
        taken = np.zeros_like(alive)
        lines = np.arange(len(who))
        for _ in range(most):
            best = np.where(alive, gaps, np.inf).argmin(axis=1)
            ok = alive[lines, best]
            taken[lines[ok], best[ok]] = True
            alive &= ~((slack * between[lines, best] <= gaps) & ok[:, None])
            alive[lines, best] = False
        out += [np.unique(c[i][taken[i]]) for i in range(len(who))]
    return out


def build(x: np.ndarray, how: FlatGraph) -> list[np.ndarray]:
    """Adjacency lists of a shard's unit vectors: pruned near and random far candidates, with the reverse edges."""
    n = len(x)
    if n == 1:
        return [np.zeros(0, np.int64)]
    near = np.empty((n, min(how.candidates, n)), np.int64)
    for begin in range(0, n, 512):
        dots = x[begin : begin + 512] @ x.T
        near[begin : begin + 512] = np.argpartition(-dots, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
    far = np.random.Generator(np.random.PCG64(n)).integers(0, n, (n, 2 * how.far))
    lists = [np.union1d(a, b) for a, b in zip(robust_prune(x, near, how.near, how.slack), robust_prune(x, far, how.far, how.slack), strict=True)]
    back: list[list[int]] = [[] for _ in range(n)]
    for i, out in enumerate(lists):
        for j in out.tolist():
            if len(back[j]) < how.near:
                back[j].append(i)
    return [np.union1d(a, np.array(b, np.int64)) for a, b in zip(lists, back, strict=True)]


class Finder:
    """Searches a shard's graph: ``x`` are its unit vectors, ``adjacent`` their neighbours in it."""

    def __init__(self, x: np.ndarray, adjacent: list[np.ndarray], how: FlatGraph) -> None:
        self.x, self.adjacent, self.how, self.low = x, adjacent, how, x.astype(np.float32)
        self.table = np.full((len(x), max(1, max((len(a) for a in adjacent), default=0))), -1, np.int64)
        for i, a in enumerate(adjacent):
            self.table[i, : len(a)] = a
        self.medoid = int((x @ x.mean(axis=0)).argmax())

    def beams(self, queries: np.ndarray) -> np.ndarray:
        """For each query, the places its greedy beam from the medoid ended with (-1: none)."""
        n, how, table, low = len(self.x), self.how, self.table, self.low
        ends, queries = np.full((len(queries), how.beam), -1, np.int64), queries.astype(np.float32)
        for begin in range(0, len(queries), 256):
            q = queries[begin : begin + 256]
            lines = np.arange(len(q))
            beam = np.full((len(q), how.beam), -1, np.int64)
            score = np.full((len(q), how.beam), -np.inf, np.float32)
            done = np.ones((len(q), how.beam), bool)
            beam[:, 0], score[:, 0], done[:, 0] = self.medoid, q @ low[self.medoid], False
            seen = np.zeros((len(q), n), bool)
            seen[:, self.medoid] = True
            while not done.all():
                pick_at = np.where(done, -np.inf, score).argmax(axis=1)
                active = ~done[lines, pick_at]
                done[lines, pick_at] = True
                new = np.where(active[:, None], table[np.maximum(beam[lines, pick_at], 0)], -1)
                new = np.where(seen[lines[:, None], np.maximum(new, 0)], -1, new)
                x_at, y_at = np.nonzero(new >= 0)
                seen[x_at, new[x_at, y_at]] = True
                fresh = np.full(new.shape, -np.inf, np.float32)
                fresh[x_at, y_at] = np.einsum("ij,ij->i", q[x_at], low[new[x_at, y_at]])
                both, values = np.concatenate([beam, new], axis=1), np.concatenate([score, fresh], axis=1)
                flags = np.concatenate([done, new < 0], axis=1)
                top = np.argpartition(-values, how.beam - 1, axis=1)[:, : how.beam]
                beam, score, done = (np.take_along_axis(v, top, axis=1) for v in (both, values, flags))
                done |= beam < 0
            ends[begin : begin + 256] = beam
        return ends

    def expand(self, query: np.ndarray, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors within the similarity of the query, vectors within the margin below it too), reached from ``front`` through the latter."""
        n, loose = len(self.x), self.how.similarity - self.how.margin
        seen, near = np.zeros(n, bool), np.zeros(n, bool)
        front = np.unique(front)
        while len(front):
            seen[front] = True
            front = front[self.x[front] @ query >= loose]
            near[front] = True
            around = np.zeros(n, bool)
            around[np.concatenate([self.adjacent[j] for j in front.tolist()] or [front])] = True
            front = np.flatnonzero(around & ~seen)
        at = np.flatnonzero(near)
        return at[self.x[at] @ query >= self.how.similarity], at


def range_links(x: np.ndarray, adjacent: list[np.ndarray], how: FlatGraph) -> tuple[np.ndarray, list[np.ndarray]]:
    """(which pairs of a shard's unit vectors the search finds within the similarity, as a symmetric matrix; what each search came near)."""
    found, near, finder = np.zeros((len(x), len(x)), bool), [], Finder(x, adjacent, how)
    for i, ends in enumerate(finder.beams(x)):
        hits, around = finder.expand(x[i], np.append(ends[ends >= 0], i))
        found[i, hits] = True
        near.append(around)
    found |= found.T
    np.fill_diagonal(found, False)
    return found, near


def _graph(rows: DataFrame, how: FlatGraph) -> DataFrame:
    """(rep, adjacent, cells): the union of the adjacency lists of a vector's shards, and those shards."""

    def edges(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        reps = table["rep"].to_numpy()
        lists = build(_unit(_matrix(table["embedding"])), how)
        return pa.table({"rep": table["rep"], "cell": table["cell"], "adjacent": pa.array([reps[a].tolist() for a in lists], pa.list_(pa.int64()))})

    made = rows.groupBy("label", "dim", "cell").applyInArrow(edges, "rep bigint, cell string, adjacent array<bigint>")
    return made.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("adjacent"))).alias("adjacent"), F.array_sort(F.collect_set("cell")).alias("cells"))


def _lowest(reps: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The first of the ascending ``reps`` that each one is linked with, through others."""
    lowest, free = reps.copy(), np.ones(len(reps), bool)
    for i in range(len(reps)):
        if free[i]:
            todo = [i]
            free[i] = False
            while todo:
                j = todo.pop()
                lowest[j] = reps[i]
                new = np.flatnonzero(found[j] & free)
                free[new] = False
                todo += new.tolist()
    return lowest


def _cell(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[frozenset]]:
    """(reps, unit vectors, neighbours in the shard, the shards of each) of a shard's rows, sorted by rep."""
    reps = table["rep"].to_numpy()
    place = {r: i for i, r in enumerate(reps.tolist())}
    adjacent = [np.array([place[r] for r in a if r in place], np.int64) for a in table["adjacent"].to_pylist()]
    known: dict[tuple, frozenset] = {}
    cells = [known.setdefault(tuple(c), frozenset(c)) for c in table["cells"].to_pylist()]
    return reps, _unit(_matrix(table["embedding"])), adjacent, cells


def _ahead(near: np.ndarray, cells: list[frozenset], visited: frozenset) -> list[str]:
    """The shards to which edges of the vectors ``near`` lead and which are not ``visited``: an edge of a vector is in one of its shards."""
    return sorted(set().union(*{cells[j] for j in near.tolist()}) - visited) if len(near) else []


_HIT = "rep bigint, cell string, n bigint, joined array<bigint>, ahead array<string>"


def _hits(table: pa.Table, n: np.ndarray, joined: list[list[int]], ahead: list[list[str]]) -> pa.Table:
    return pa.table({"rep": table["rep"], "cell": table["cell"], "n": pa.array(n, pa.int64()), "joined": pa.array(joined, pa.list_(pa.int64())), "ahead": pa.array(ahead, pa.list_(pa.string()))})


def _search(members: DataFrame, how: FlatGraph) -> DataFrame:
    """(rep, cell, n, joined, ahead): of each vector in each of its shards, the links counted there, a vector it is linked with, through others,
    and the shards, other than its own, to which its search leads; the latter for cut vectors only: others share a shard with all their links."""

    def find(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        reps, x, adjacent, cells = _cell(table)
        copies, cut, cell = table["copies"].to_numpy(), table["cut"].to_pylist(), table["cell"][0].as_py()
        found, near = range_links(x, adjacent, how)
        # A pair that shares several shards is counted in the first of them.
        kinds: dict[frozenset, int] = {}
        kind = np.array([kinds.setdefault(c, len(kinds)) for c in cells])
        first = np.array([[min(a & b) == cell for b in kinds] for a in kinds])
        counts = np.zeros(len(reps), np.int64)
        for i in range(len(reps)):
            at = np.flatnonzero(found[i])
            counts[i] = copies[at[first[kind[i], kind[at]]]].sum()
        ahead = [_ahead(near[i], cells, cells[i]) if c else [] for i, c in enumerate(cut)]
        return _hits(table, counts, [[r] for r in _lowest(reps, found).tolist()], ahead)

    return members.groupBy("label", "dim", "cell").applyInArrow(find, _HIT)


def _visits(members: DataFrame, guests: DataFrame, how: FlatGraph) -> DataFrame:
    """As ``_search``, of guests (rep, label, dim, cell, embedding, visited) in shards that are not theirs.

    ``members`` has the shards' rows and, as ``lowest``, what each is linked with there. Links with vectors that share a shard
    already visited are not counted again. Guests of a shard are dealt into tasks of at most about half a shard.
    """
    place = ["label", "dim", "cell"]
    parts = guests.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) * 2 / how.shard).cast("int").alias("_parts"))
    none = F.lit(None)
    columns = ["rep", *place, "embedding", "copies", "adjacent", "cells", "lowest", "visited"]
    own = members.withColumn("visited", none.cast("array<string>")).join(parts, place).select(*columns, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    more = guests.join(parts, place).withColumns({"copies": none.cast("long"), "adjacent": none.cast("array<bigint>"), "cells": none.cast("array<string>"), "lowest": none.cast("long")})
    more = more.select(*columns, F.pmod(F.xxhash64("rep", F.lit(21)), F.col("_parts")).cast("int").alias("_part"))

    def find(table: pa.Table) -> pa.Table:
        is_guest = pa.compute.is_valid(table["visited"])
        asked, table = table.filter(is_guest).sort_by("rep"), table.filter(pa.compute.invert(is_guest)).sort_by("rep")
        _, x, adjacent, cells = _cell(table)
        copies, lowest, finder = table["copies"].to_numpy(), table["lowest"].to_numpy(), Finder(x, adjacent, how)
        queries, cell = _unit(_matrix(asked["embedding"])), table["cell"][0].as_py()
        counts, joined, ahead = [], [], []
        for q, ends, visited in zip(queries, finder.beams(queries), asked["visited"].to_pylist(), strict=True):
            before = frozenset(visited)
            found, near = finder.expand(q, ends[ends >= 0])
            new = np.array([i for i in found.tolist() if cells[i].isdisjoint(before)], np.int64)
            counts.append(int(copies[new].sum()))
            joined.append(np.unique(lowest[found]).tolist())
            ahead.append(_ahead(near, cells, before | {cell}))
        return _hits(asked, np.array(counts, np.int64), joined, ahead)

    return own.unionByName(more).groupBy(*place, "_part").applyInArrow(find, _HIT)


def search(rows: DataFrame, how: FlatGraph) -> DataFrame:
    """(rep, n, joined): the links of each vector in each shard that its search came to; ``rows`` are of ``shards``.

    A shard that is reached in a round is visited in the next one, all of a round's in the order of their names: a link with
    a vector that is in several of them is counted in the first.
    """
    graph = stored(_graph(rows, how), "graph")
    members = stored(rows.join(graph, "rep").select("rep", "label", "dim", "cell", "embedding", "copies", "cut", "adjacent", "cells"), "members")
    hits = stored(_search(members, how), "hits")
    every = hits.select("rep", "n", "joined")
    ahead = hits.where(F.size("ahead") > 0)
    if not ahead.isEmpty():
        members = stored(members.join(hits.select("rep", "cell", F.col("joined")[0].alias("lowest")), ["rep", "cell"]), "members")
        own = members.groupBy("rep").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("embedding").alias("embedding"), F.first("cells").alias("visited"))
        guests = stored(own.join(ahead.select("rep").distinct(), "rep"), "guests")
        while not ahead.isEmpty():
            new = ahead.select("rep", F.explode("ahead").alias("cell")).distinct().groupBy("rep").agg(F.array_sort(F.collect_list("cell")).alias("_new"))
            new = guests.join(new, "rep").withColumn("_new", F.array_except("_new", "visited"))
            each = new.select("rep", "label", "dim", "embedding", "visited", F.col("_new").alias("_all"), F.posexplode("_new").alias("_i", "cell"))
            each = each.withColumn("visited", F.concat("visited", F.slice("_all", F.lit(1), F.col("_i")))).drop("_all", "_i")
            hits = stored(_visits(members, each, how), "hits")
            every = every.unionByName(hits.select("rep", "n", "joined"))
            gone = new.select("rep", F.concat("visited", "_new").alias("_v"))
            guests = stored(guests.join(gone, "rep").select("rep", "label", "dim", "embedding", F.col("_v").alias("visited")), "guests")
            ahead = hits.where(F.size("ahead") > 0).select("rep", "ahead")
            ahead = ahead.join(guests.select("rep", "visited"), "rep").withColumn("ahead", F.array_except("ahead", "visited")).where(F.size("ahead") > 0).select("rep", "ahead")
    return stored(every, "links")


def compare(reps: DataFrame, how: FlatGraph) -> DataFrame:
    """As ``search``, without a graph: every vector is compared with all of its label and length.

    Vectors are dealt into blocks of about half a shard by a hash; each two blocks, and each by itself, are a task's.
    """
    place = ["label", "dim"]
    blocks = reps.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) * 2 / how.shard).cast("int").alias("_b"))
    dealt = reps.join(blocks, place).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(13)), F.col("_b")).cast("int"))
    dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    pairs = dealt.select("rep", *place, "embedding", "copies", "own", F.least("own", "_with").alias("_i"), F.greatest("own", "_with").alias("_j"))

    def find(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        reps, copies, own = (table[c].to_numpy() for c in ("rep", "copies", "own"))
        x = _unit(_matrix(table["embedding"]))
        apart = table["_i"][0].as_py() != table["_j"][0].as_py()
        found = np.zeros((len(x), len(x)), bool)
        for begin in range(0, len(x), 512):
            part = slice(begin, begin + 512)
            found[part] = x[part] @ x.T >= how.similarity
            if apart:
                found[part] &= own[part, None] != own
        found |= found.T
        np.fill_diagonal(found, False)
        counts = np.array([copies[row].sum() for row in found], np.int64)
        return pa.table({"rep": table["rep"], "n": pa.array(counts), "joined": pa.array([[r] for r in _lowest(reps, found).tolist()], pa.list_(pa.int64()))})

    return pairs.groupBy(*place, "_i", "_j").applyInArrow(find, "rep bigint, n bigint, joined array<bigint>")


def audit(reps: DataFrame, cells: DataFrame, links: DataFrame, how: FlatGraph) -> DataFrame:
    """(label, dim, size, asked, found, true, share): what the search found of some vectors' links, compared with all of their label.

    ``reps`` has rep, label, dim, embedding and copies, ``cells`` is of ``shards``; ``links`` has rep and n, the number of
    links found. About ``how.audited`` vectors of each label are drawn by a hash, and as many of those cut by a border. Labels
    where these hold fewer than ``how.audited_links`` links are drawn anew, ``how.shard`` vectors of each kind; a label
    of that size or less is compared in full. found and true count links, share is the mean over the vectors with links.
    """
    place = ["label", "dim"]
    cut = cells.where("cut").select("rep").distinct().withColumn("_cut", F.lit(True))
    rows = reps.join(cut, "rep", "left").join(links, "rep", "left").select("rep", *place, "embedding", "copies", F.coalesce("_cut", F.lit(False)).alias("_cut"), F.coalesce("n", F.lit(0)).alias("n"))
    sizes = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("size"), F.count_if("_cut").alias("_m"), F.ceil(F.count(F.lit(1)) / how.shard).cast("int").alias("_b"))
    sizes = stored(sizes, "sizes")

    def count(table: pa.Table) -> pa.Table:
        asked = table.filter(table["n"].to_numpy() >= 0)
        others = table.filter(table["n"].to_numpy() < 0)
        own, ids, copies = asked["rep"].to_numpy(), others["rep"].to_numpy(), others["copies"].to_numpy()
        q, true = _unit(_matrix(asked["embedding"])) if len(own) else np.zeros((0, 1)), np.zeros(len(own), np.int64)
        x = _unit(_matrix(others["embedding"])) if len(ids) else np.zeros((0, q.shape[1]))
        for begin in range(0, len(q), 512):
            part = slice(begin, begin + 512)
            true[part] = ((q[part] @ x.T >= how.similarity) & (own[part, None] != ids)) @ copies
        return pa.table({"label": asked["label"], "dim": asked["dim"], "rep": asked["rep"], "n": asked["n"], "true": pa.array(true)})

    def measured(sizes: DataFrame, quota: int) -> DataFrame:
        drawn = lambda seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        at = rows.join(sizes, place)
        columns = ["rep", *place, "embedding", "copies", "n"]
        asked = at.where((drawn(9) * F.col("size") < quota) | (F.col("_cut") & (drawn(10) * F.col("_m") < quota)))
        asked = asked.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).select(*columns, "_at")
        blocks = at.withColumns({"n": F.lit(-1).cast("long"), "_at": F.pmod(F.xxhash64("rep", F.lit(13)), F.col("_b")).cast("int")}).select(*columns, "_at")
        each = blocks.unionByName(asked).groupBy(*place, "_at").applyInArrow(count, "label string, dim int, rep bigint, n bigint, true bigint")
        each = each.groupBy(*place, "rep").agg(F.first("n").alias("n"), F.sum("true").alias("true")).withColumn("found", F.least("n", "true"))
        per = each.groupBy(*place).agg(F.count(F.lit(1)).alias("asked"), F.sum("found").alias("found"), F.sum("true").alias("true"), F.avg(F.try_divide("found", "true")).alias("share"))
        none = {c: F.coalesce(c, F.lit(0)) for c in ("asked", "found", "true")}
        return stored(sizes.join(per, place, "left").withColumns(none), "audit")

    first = measured(sizes, how.audited)
    # Where a sample holds too few links, one eight times as large is drawn, up to a quarter of the vectors; then the label counts as not measured.
    few, quota = (F.col("true") < how.audited_links) & (F.col("asked") < F.col("size")), how.shard
    while True:
        again = first.where(few & (F.lit(quota) <= F.greatest(F.col("size") / 4, F.lit(how.shard))))
        if again.isEmpty():
            return first.withColumn("unknown", few).drop("_m", "_b")
        first = stored(first.join(again.select(*place), place, "left_anti").unionByName(measured(again.select(*sizes.columns), quota)), "audit")
        quota *= 8


def near_vectors(vectors: DataFrame, how: FlatGraph = FlatGraph()) -> tuple[DataFrame, float]:
    """((vec_id, n_links, component_id, recall_reached) for each row of ``vectors``, the audited recall; 1 where there are no links).

    ``vectors`` has vec_id, label and embedding; vectors of equal label and length are linked if their cosine
    reaches the similarity. n_links counts the other rows linked directly; component_id is the smallest vec_id that can
    be reached. Equal vectors are searched once and count each. A null label, and a vector that is null, empty, zero,
    or holds null or non-finite components, links with nothing; a null vec_id has no component. Rows that repeat
    an id count each, and share the component. An empty table gives no rows. Labels whose audit finds less than
    ``how.recall`` of their links are compared in full.
    """
    reps, seed = _representatives(valid_vectors(vectors))
    plain = reps.select("rep", "label", "dim", "embedding", "copies")
    cells = shards(plain, how)
    # Labels with shards that could not be split small enough are left to the audit, which has them compared in full.
    over = stored(cells.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * how.shard).select("label", "dim").distinct(), "over")
    hits = search(cells if over.isEmpty() else cells.join(over, ["label", "dim"], "left_anti"), how)
    links = hits.groupBy("rep").agg(F.sum("n").alias("n"))
    audited = audit(plain, cells, links, how)
    low = (F.col("found") < how.recall * F.col("true")) | (F.coalesce("share", F.lit(1.0)) < how.recall) | F.col("unknown")
    audited = stored(audited.withColumn("low", low), "audit")
    failing = audited.where("low").select("label", "dim")
    if not failing.isEmpty():
        failing = plain.join(failing, ["label", "dim"], "left_semi")
        hits = stored(hits.join(failing.select("rep"), "rep", "left_anti").unionByName(compare(failing, how)), "hits")
        links = hits.groupBy("rep").agg(F.sum("n").alias("n"))
    # Labels that were compared in full have all their links.
    seen = audited.agg(F.sum(F.when(F.col("low"), F.col("true")).otherwise(F.col("found"))).alias("found"), F.sum("true").alias("true"), F.count_if("low").alias("low"), F.count_if("unknown").alias("unknown")).first()
    recall = seen["found"] / seen["true"] if seen["true"] else 1.0
    logging.getLogger("foliant.flat_graph").info("recall %s; labels compared in full: %d, of these not measured: %d", recall, seen["low"] or 0, seen["unknown"] or 0)
    label = components(hits.select(F.col("rep").alias("a"), F.explode("joined").alias("b")))
    out = _answer(vectors, reps, seed, links, label).withColumn("recall_reached", F.lit(recall >= how.recall))
    return out, recall


def _representatives(valid: DataFrame) -> tuple[DataFrame, int]:
    """((rep, _id, label, dim, embedding, copies) of the distinct vectors, the seed of the hash rep, which no two of them share)."""
    groups = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("_id"), F.count(F.lit(1)).alias("copies"))
    for seed in range(8):
        reps = stored(groups.select(F.xxhash64("label", "embedding", F.lit(seed)).alias("rep"), "_id", "label", F.size("embedding").alias("dim"), "embedding", "copies"), "reps")
        if reps.groupBy("rep").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
            return reps, seed
        discard(reps)
    raise RuntimeError("different vectors share a hash under every seed")


def _answer(vectors: DataFrame, reps: DataFrame, seed: int, links: DataFrame, label: DataFrame) -> DataFrame:
    of_rep = reps.select("rep", "_id", "copies").join(links, "rep", "left").join(label.select(F.col("node").alias("rep"), F.col("label").alias("_c")), "rep", "left")
    of_rep = of_rep.select("rep", "_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("_c", "rep").alias("_c"))
    names = of_rep.groupBy("_c").agg(F.min("_id").alias("component_id"))
    of_rep = stored(of_rep.join(names, "_c").select("rep", "n_links", "component_id"), "answers")
    rows = pick(vectors, "vec_id", "label", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    # Rows that cannot link have no representative; their key is made null, and all keys are spread by it.
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite
    keyed = rows.select("vec_id", F.when(able, F.xxhash64("label", "embedding", F.lit(seed))).alias("rep"))
    out = keyed.join(of_rep, "rep", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
