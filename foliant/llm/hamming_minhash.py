"""MinHash near-duplicates by a multi-index Hamming join.

A document's shingle set gets a signature of K symbols of b bits, and two sets are candidates if their
signatures differ in at most D symbols. D is chosen so that a pair at the similarity threshold differs in more with
a probability under ``miss``. Signatures are split into chunks; by the pigeonhole principle two signatures
within D agree, up to D // chunks errors, in one chunk at least. For every chunk and every set of places where
errors are allowed the other symbols form a key, so that all pairs within D share a key, with no exception.

Members of a key are not paired with each other. In two rounds they are compared with leaders of the key, on full
sets, and linked sets become components. A key whose members lie in one component is done. In the others,
members of different components whose signatures are within D are compared on full sets inside a task, large
keys in blocks, each pair in the first of its keys only; what leaves the task are links that join components. No link is
lost: a pair within D is in one component already or compared.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import discard, pick, small_batches, stored, trim
from foliant.llm.components import components

_U = np.uint64
#: Words remembered by one Python worker before it starts afresh.
MEMO = 200_000


@dataclass(frozen=True)
class NearDuplicates:
    """Sets of ``words``-word shingles are linked if ``per_hundred`` * union <= 100 * intersection."""

    words: int = 5
    per_hundred: int = 80
    symbols: int = 64
    bits: int = 16
    miss: float = 1e-6
    #: Members of a key in one block; a task compares two blocks at a time.
    block: int = 500

    @property
    def distance(self) -> int:
        p, tail = 1 - self.per_hundred / 100, 1.0
        for d in range(self.symbols + 1):
            tail -= math.comb(self.symbols, d) * p**d * (1 - p) ** (self.symbols - d)
            if tail <= self.miss:
                return d
        return self.symbols

    @property
    def chunks(self) -> int:
        """As many as leave one error to a chunk."""
        n = self.distance // 2 + 1
        if 2 * n > self.symbols:
            raise ValueError("the similarity is too low for this many symbols")
        return n

    @property
    def errors(self) -> int:
        return self.distance // self.chunks


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _numbers(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Texts to sorted arrays of 64-bit shingle hashes.

    ASCII letters are lower-cased and words are runs of anything but ASCII white space, as bytes.lower and
    bytes.split have it. A text with fewer words than a shingle has its whole sequence as the one shingle.
    """

    def __init__(self, words: int) -> None:
        self.words, self.memo = words, _Words()
        self.factors = _numbers(3, words) | _U(1)

    def shingles(self, data: bytes) -> np.ndarray:
        found = data.lower().split()
        if len(self.memo) > MEMO:
            self.memo.clear()
        codes = np.fromiter(map(self.memo.__getitem__, found), _U, len(found))
        k = min(self.words, len(codes))
        if not k:
            return codes
        total = np.full(len(codes) - k + 1, k, _U)
        for i in range(k):
            total += codes[i : len(codes) - k + 1 + i] * self.factors[i]
        return np.unique(_mixed(total))


class Signer:
    def __init__(self, how: NearDuplicates) -> None:
        self.how = how
        self.seeds, self.factors = _numbers(5, how.symbols)[:, None], (_numbers(7, how.symbols) | _U(1))[:, None]

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.how.symbols, ~_U(0))
        for at in range(0, len(shingles), 8192):
            least = np.minimum(least, ((shingles[at : at + 8192] ^ self.seeds) * self.factors).min(axis=1))
        return (_mixed(least) >> _U(64 - self.how.bits)).astype("<u4" if self.how.bits > 16 else "<u2")

    def places(self) -> list[np.ndarray]:
        return np.array_split(np.arange(self.how.symbols), self.how.chunks)

    def keys(self, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, slots): a column for each chunk and place left out of it; the slot is that place.

        Without errors to allow there is one column for each chunk, whose slot is its first place.
        """
        columns = [np.ascontiguousarray(signatures[:, i]).astype(_U) for i in range(self.how.symbols)]
        out, slots = [], []
        for chunk in self.places():
            for slot in chunk.tolist() if self.how.errors else chunk[:1].tolist():
                key = np.full(len(signatures), slot + 1, _U)
                for i in chunk.tolist():
                    if i != slot or not self.how.errors:
                        key = _mixed(key + columns[i] + _U((i + 1) << 32))
                out.append(key)
                slots.append(slot)
        return _mixed(np.stack(out, axis=1)), np.array(slots, np.int32)

    def first_slots(self, differ: np.ndarray) -> np.ndarray:
        """The slot of the first key shared by pairs whose places ``differ`` as the rows say; -1 if none is."""
        starts = np.array([c[0] for c in self.places()])
        per_chunk = np.add.reduceat(differ, starts, axis=1, dtype=np.int32)
        shared = per_chunk <= self.how.errors
        chunk = shared.argmax(axis=1)
        ends = np.append(starts[1:], self.how.symbols)
        inside = (np.arange(self.how.symbols) >= starts[chunk][:, None]) & (np.arange(self.how.symbols) < ends[chunk][:, None])
        odd = differ & inside
        slot = np.where(odd.any(axis=1), odd.argmax(axis=1), starts[chunk])
        return np.where(shared.any(axis=1), slot, -1)


def _node(shingles: np.ndarray, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed) - (1 << 63)


#: The seed of the second hash of a set, by which sets with the same first one are told apart.
CONTROL = 1 << 40


def row_digests(docs: DataFrame, how: NearDuplicates, seed: int = 0) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, control, signature) of each row; node and control are hashes of the set, null for an empty one."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("control", pa.int64()), ("signature", pa.binary())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(how.words), Signer(how)
        for batch in small_batches(batches, "text"):
            sizes, nodes, controls, signatures = [], [], [], []
            for x in batch.column("text"):
                s = shingler.shingles(x.as_py() or b"")
                sizes.append(len(s))
                nodes.append(_node(s, seed) if len(s) else None)
                controls.append(_node(s, CONTROL) if len(s) else None)
                signatures.append(signer.sign(s).tobytes() if len(s) else None)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(controls, pa.int64()), pa.array(signatures, pa.binary())], schema=schema)
        trim()

    text = F.col("text").cast("string")
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(digest, "doc_id bigint, text_hash bigint, n_shingles bigint, node bigint, control bigint, signature binary")


def _digests(docs: DataFrame, how: NearDuplicates) -> tuple[DataFrame, DataFrame, int]:
    """(row_digests, one row for each set, the seed): written tables. The seed is one under which no two sets share a node.

    A set's row has node, doc, the least doc_id, signature, and at: (doc_id, text_hash) of a row with the set.
    """
    for seed in range(8):
        rows = stored(row_digests(docs, how, seed), "digests")
        nodes = rows.where("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("doc"), F.first("signature").alias("signature"), F.min(F.struct("doc_id", "text_hash")).alias("at"), (F.min("control") != F.max("control")).alias("mixed")
        )
        nodes = stored(nodes, "nodes")
        if nodes.where("mixed").isEmpty():
            return rows, nodes.drop("mixed"), seed
        discard(rows, nodes)
    raise RuntimeError("different sets share a hash under every seed")


def _keys(nodes: DataFrame, how: NearDuplicates) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(how)
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                batch = big.slice(at, 2048)
                table, slots = signer.keys(_signatures(batch.column("signature").to_pylist(), how))
                nodes = np.repeat(batch.column("node").to_numpy(), table.shape[1])
                yield pa.record_batch([pa.array(table.view(np.int64).ravel()), pa.array(np.tile(slots, len(table))), pa.array(nodes)], names=["key", "slot", "node"])

    return nodes.select("node", "signature").mapInArrow(keys, "key bigint, slot int, node bigint")


def _signatures(data: list[bytes], how: NearDuplicates) -> np.ndarray:
    return np.frombuffer(b"".join(data), "<u4" if how.bits > 16 else "<u2").reshape(len(data), how.symbols)


def _full_sets(docs: DataFrame, members: DataFrame, how: NearDuplicates, seed: int) -> DataFrame:
    """(node, shingles) of the members (node, at), made from the rows that ``at`` names by doc_id and hash of the text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(how.words)
        for batch in small_batches(batches, "text"):
            found = [(n, s) for n, x in zip(batch.column("node").to_pylist(), batch.column("text"), strict=True) if _node(s := shingler.shingles(x.as_py()), seed) == n]
            yield pa.record_batch([pa.array([n for n, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["node", "shingles"])
        trim()

    text = F.col("text").cast("string")
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc"), text.cast("binary").alias("text"), F.xxhash64(text).alias("_h")).where("text is not null")
    at = members.select("node", F.col("at.doc_id").alias("_d"), F.col("at.text_hash").alias("_t"))
    rows = rows.join(at, rows["doc"].eqNullSafe(at["_d"]) & (F.col("_h") == F.col("_t"))).select("node", "text")
    return rows.mapInArrow(sets, "node bigint, shingles binary").dropDuplicates(["node"])


def _similar(a: np.ndarray, b: np.ndarray, how: NearDuplicates) -> bool:
    """Whether two sets, as sorted arrays, reach the similarity."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < how.per_hundred * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= how.per_hundred * (len(a) + len(b) - both)


def _linked(pairs: DataFrame, sets: DataFrame, how: NearDuplicates) -> DataFrame:
    """The pairs (a, b, ...) whose full sets reach the similarity."""
    names = pairs.columns

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "set_b"):
            keep, last, a = [], None, None
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                raw = x.as_py()
                if raw != last:
                    last, a = raw, np.frombuffer(raw, _U)
                b = np.frombuffer(y.as_py(), _U)
                keep.append(_similar(a, b, how))
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))
        trim()

    set_a, set_b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    rows = pairs.join(set_a, "a").join(set_b, "b").select(*names, "set_a", "set_b")
    return rows.mapInArrow(check, ", ".join(f"{n} bigint" for n in names))


def _blocks(members: DataFrame, how: NearDuplicates) -> DataFrame:
    """Members (key, slot, n, node, comp, signature) dealt into pairs (i, j) of blocks of their key."""
    blocks = F.ceil(F.col("n") / how.block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = members.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select("key", "slot", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), (F.col("_own") > F.col("_other")).cast("int").alias("side"), "node", "comp", "signature")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one (key, i, j) after the other; the batches are sorted by these."""
    rows = (r for batch in batches for at in range(0, batch.num_rows, 1000) for r in batch.slice(at, 1000).to_pylist())
    for _, held in itertools.groupby(rows, lambda r: (r["key"], r["i"], r["j"])):
        yield list(held)


class _Near:
    """Which members of a block pair are within the distance, in different components, and first meet here."""

    def __init__(self, held: list[dict], how: NearDuplicates, signer: Signer) -> None:
        self.comps, self.sides = (np.array([r[k] for r in held], np.int64) for k in ("comp", "side"))
        self.signatures = _signatures([r["signature"] for r in held], how)
        self.how, self.signer, self.slot, self.two = how, signer, held[0]["slot"], held[0]["i"] != held[0]["j"]

    def others(self, x: int) -> np.ndarray:
        """Members after ``x`` to compare it with."""
        ok = self.comps[x + 1 :] != self.comps[x]
        if self.two:
            ok &= self.sides[x + 1 :] != self.sides[x]
        at = np.flatnonzero(ok) + x + 1
        differ = self.signatures[at] != self.signatures[x]
        close = differ.sum(axis=1) <= self.how.distance
        at, differ = at[close], differ[close]
        return at[self.signer.first_slots(differ) == self.slot] if len(at) else at


_MEMBER = "key bigint, slot int, i int, j int, side int, node bigint, comp bigint, signature binary"


def _with_near(blocks: DataFrame, how: NearDuplicates) -> DataFrame:
    """The rows of blocks that have someone to be compared with."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, names, out = Signer(how), [f.split()[0] for f in _MEMBER.split(", ")], []
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        batch = lambda rows: pa.record_batch([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)
        for held in _groups(batches):
            if len({r["comp"] for r in held}) > 1:
                near, there = _Near(held, how, signer), np.zeros(len(held), bool)
                for x in range(len(held) - 1):
                    if len(at := near.others(x)):
                        there[at] = there[x] = True
                out += [r for r, t in zip(held, there.tolist(), strict=True) if t]
            if len(out) >= 5000:
                yield batch(out)
                out = []
        trim()
        yield batch(out)

    return blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(keep, _MEMBER)


def _joining(blocks: DataFrame, how: NearDuplicates) -> DataFrame:
    """(a, b): components that a link on full sets joins; ``blocks`` has the shingles too.

    Inside a task, components that a link has joined are one from then on, so that a block pair gives
    fewer links than it has components.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, out = Signer(how), []
        for held in _groups(batches):
            near = _Near(held, how, signer)
            sets = [np.frombuffer(r["shingles"], _U) for r in held]
            for x in range(len(held) - 1):
                for y in near.others(x).tolist():
                    a, b = int(near.comps[x]), int(near.comps[y])
                    if a != b and _similar(sets[x], sets[y], how):
                        out.append((min(a, b), max(a, b)))
                        near.comps[near.comps == b] = a
            if len(out) >= 50_000:
                yield pa.record_batch([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
                out = []
        trim()
        yield pa.record_batch([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(link, "a bigint, b bigint").distinct()


def _merged(label: DataFrame, more: DataFrame) -> DataFrame:
    """The labels (node, label) after links between labels have given ``more`` (node, label)."""
    top = more.select(F.col("node").alias("label"), F.col("label").alias("_top"))
    moved = label.join(top, "label", "left").select("node", F.coalesce("_top", "label").alias("label"))
    return stored(moved.unionByName(more.join(label.select("node"), "node", "left_anti")), "merged")


def _in_open_keys(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members with their component, of the keys that hold more than one component."""
    rows = members.join(label, "node", "left").select("key", "slot", "n", "node", F.coalesce("label", "node").alias("comp"))
    still = rows.groupBy("key").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y")).where("_x <> _y").select("key")
    return stored(rows.join(still, "key"), "open")


def near_duplicates(docs: DataFrame, how: NearDuplicates = NearDuplicates()) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, component_id), one row for each row of ``docs`` (doc_id, text).

    component_id is the smallest non-null doc_id among the documents that are linked directly or through
    others; documents with equal sets are linked. A null, empty or blank text has an empty set and is linked
    with nothing. A row with a null doc_id takes part, but its component has no id if all its rows lack one. Rows
    that share a doc_id stay rows of their own, grouped by their texts. An empty table gives no rows.
    """
    rows, nodes, seed = _digests(docs, how)
    keys = _keys(nodes, how)
    # The first leader is the least member, which the keys of a group mostly share: few different pairs.
    leaders = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1")
    members = stored(keys.join(leaders, "key"), "members")
    sets = stored(_full_sets(docs, nodes.join(members.select("node").distinct(), "node"), how, seed), "sets")
    stars = members.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    label = components(_linked(stars, sets, how))
    every, members = members, _in_open_keys(members, label)
    discard(every)
    # The second round: each key has a leader drawn by a hash, and members of other components are compared with it
    # in a quarter of their keys. This only spares the last step work: that one is complete by itself.
    second = members.groupBy("key").agg(F.min(F.struct(F.col("node").bitwiseXOR(F.xxhash64("key", F.lit(2))).alias("t"), "node", "comp")).alias("_l"))
    pairs = members.join(second, "key").where((F.col("_l.comp") != F.col("comp")) & (F.pmod(F.xxhash64("key", "node"), F.lit(4)) == 0)).select(F.least("_l.node", "node").alias("a"), F.greatest("_l.node", "node").alias("b"), F.least("_l.comp", "comp").alias("ca"), F.greatest("_l.comp", "comp").alias("cb")).distinct()
    label = _merged(label, components(_linked(pairs, sets, how).select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
    members = _in_open_keys(members.drop("comp"), label)
    near = _with_near(_blocks(members.join(nodes.select("node", "signature"), "node"), how), how)
    near = stored(near, "near")
    label = _merged(label, components(_joining(near.join(sets, "node"), how)))
    discard(near, sets)
    of_node = nodes.select("node", "doc").join(label, "node", "left").select("node", "doc", F.coalesce("label", "node").alias("label"))
    names = of_node.groupBy("label").agg(F.min("doc").alias("component_id"))
    of_node = stored(of_node.join(names, "label").select("node", "component_id"), "components")
    out = rows.join(of_node, "node", "left")
    return out.select("doc_id", "text_hash", "n_shingles", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, how: NearDuplicates = NearDuplicates()) -> DataFrame:
    """The rows of ``docs``, all columns kept, less all but one document of each near-duplicate group.

    The row with the smallest doc_id stays (a null one only if there is no other). A row that is repeated whole,
    with its id, is one document. Documents without words belong to no group and stay.
    """
    found = stored(near_duplicates(docs, how), "groups")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("_no"), F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")))
    tagged = found.where("node is not null")
    anchor = F.coalesce("component_id", "node")
    chosen = tagged.groupBy(anchor.alias("_c"), F.col("component_id").isNull().alias("_n")).agg(best.alias("_b")).select(F.col("_b._d").alias("_d"), F.col("_b._t").alias("_t"))
    counted = tagged.groupBy(F.col("doc_id").alias("_d2"), F.col("text_hash").alias("_t2")).agg(F.count(F.lit(1)).alias("_rows"))
    chosen = stored(chosen.distinct().join(counted, chosen["_d"].eqNullSafe(F.col("_d2")) & (F.col("_t") == F.col("_t2"))).select("_d", "_t", "_rows"), "chosen")
    empty = found.where("node is null").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct()
    names = docs.columns
    at = {x: f"_k{next(i for i, n in enumerate(names) if n.lower() == x)}" for x in ("doc_id", "text")}
    plain = docs.toDF(*(f"_k{i}" for i in range(len(names))))
    text = F.col(at["text"]).cast("string")
    match = lambda right: plain[at["doc_id"]].cast("long").eqNullSafe(right["_d"]) & (F.xxhash64(text) == right["_t"])
    single = chosen.where("_rows = 1").select("_d", "_t").unionByName(empty)
    out = plain.join(single, match(single), "left_semi")
    repeated = chosen.where("_rows > 1")
    if not repeated.isEmpty():
        out = out.unionByName(plain.join(repeated, match(repeated), "left_semi").dropDuplicates([at["doc_id"], at["text"]]))
    return out.toDF(*names)
