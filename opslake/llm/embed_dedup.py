"""Near duplicates of embeddings: cover trees, traversed in pairs."""
from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from opslake.llm.components import component_labels
from opslake.session import fresh_path

#: Vectors from which the top of the tree is chosen, by smallest digest; all vectors then descend it.
TOP_SAMPLE = 8192
#: Vectors a chunk of a cell aims at, cells of the top level, and cells of the tree inside a chunk.
CHUNK, TOP_CELLS, INNER_CELLS = 4096, 1024, 128
#: Bytes of vectors in a chunk at most, so long vectors make smaller chunks; chunks of a file, and bytes of those that a task of block pairs holds.
CHUNK_BYTES, CHUNKS_PER_FILE, BLOCK_BYTES = 4 << 20, 8, 64 << 20
#: Bytes of chunk pairs that go to Python at once.
ROW_BATCH_BYTES = 16 << 20
#: Rows, and bytes, among which a task merges equal vectors before they are dealt to chunks.
MERGED_ROWS, MERGED_BYTES = 1 << 16, 32 << 20
#: Directions of a sketch, rows of a chunk whose sketches are multiplied at once, and what single precision may take from a product.
SKETCH, BLOCK, SKETCH_ROUNDING = 23, 256, 1e-5
#: Bits of a node's number that are its place in a chunk.
PLACE_BITS = 13
#: Allowance for rounding in distances that only prune.
ROUNDING = 1e-6


def distance_of(cosine: float) -> float:
    """Distance of unit vectors with this cosine."""
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip(2 - 2 * (a @ b.T), 0, None))


class CoverTree:
    """Nested levels of centres with halving radii over unit vectors.

    Centres are taken farthest first, so every prefix covers all vectors within the distance at which the next centre was
    taken; a level is the prefix whose distance is at most half of the level above. ``radius`` of a node bounds the
    distance of every vector below it.
    """

    def __init__(self, vectors: np.ndarray, cells: int, least: float):
        order, gap, far = [0], [np.inf], distances(vectors, vectors[:1])[:, 0]
        self.cell = np.zeros(len(vectors), int)
        while len(order) < min(cells, len(vectors)) and (at := int(far.argmax())) is not None and far[at] > least:
            gap.append(float(far[at]))
            d = distances(vectors, vectors[at:at + 1])[:, 0]
            self.cell[d < far] = len(order)
            far = np.minimum(far, d)
            order.append(at)
        self.order, self.centres = np.array(order), vectors[order]
        self.sizes = [1]
        bound = gap[1] / 2 if len(gap) > 1 else 0.0
        while self.sizes[-1] < len(order):
            self.sizes.append(max(self.sizes[-1] + 1, int(np.searchsorted(-np.array(gap[1:]), -bound, side="right")) + 1))
            self.sizes[-1] = min(self.sizes[-1], len(order))
            bound /= 2
        leaf = np.zeros(len(order))
        np.maximum.at(leaf, self.cell, far)
        self.set_radii(leaf)

    @classmethod
    def restored(cls, vectors: np.ndarray, cell: np.ndarray, order: np.ndarray, sizes: list[int], leaf: np.ndarray) -> CoverTree:
        """A tree over the same vectors from its parts."""
        tree = cls.__new__(cls)
        tree.cell, tree.order, tree.sizes, tree.centres = cell, order, sizes, vectors[order]
        tree.set_radii(leaf)
        return tree

    def set_radii(self, leaf: np.ndarray) -> None:
        """Radii of all levels from those of the last one; ``parents[l]`` maps level l + 1 to level l."""
        self.radii, self.parents = [leaf], []
        for upper, lower in zip(self.sizes[-2::-1], self.sizes[:0:-1]):
            d = distances(self.centres[:lower], self.centres[:upper])
            parent = d.argmin(axis=1)
            radius = np.full(upper, 0.0)
            np.maximum.at(radius, parent, d[np.arange(lower), parent] + self.radii[0])
            self.radii.insert(0, radius)
            self.parents.insert(0, parent)


def close_cells(a: CoverTree, b: CoverTree, reach: float) -> np.ndarray:
    """Pairs of last-level cells that may hold vectors within ``reach``; both trees are descended level by level.

    A pair of nodes is followed only if their centres are not further apart than the radii and ``reach`` allow.
    """
    alive = np.ones((1, 1), bool)
    for level in range(max(len(a.sizes), len(b.sizes))):
        la, lb = min(level, len(a.sizes) - 1), min(level, len(b.sizes) - 1)
        if level:
            if level < len(a.sizes):
                alive = alive[a.parents[level - 1]]
            if level < len(b.sizes):
                alive = alive[:, b.parents[level - 1]]
        d = distances(a.centres[:a.sizes[la]], b.centres[:b.sizes[lb]])
        alive = alive & (d <= a.radii[la][:, None] + b.radii[lb][None, :] + reach + ROUNDING)
    return alive


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each component of n points."""
    root = np.arange(n)
    while len(i):
        old = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (old == root).all():
            break
    return root


def _units(v: np.ndarray) -> np.ndarray:
    """Rows in unit length, in double precision."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _bytes(rows: np.ndarray) -> pa.Array:
    """One byte string per row of a two-dimensional array."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.itemsize * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


class Chunk:
    """Vectors of a row of ``_pack``, in the order of the cells of their tree, with the leading part of each as ``sketch``.

    A sketch holds the coordinates of a unit vector along a few directions and the length of the rest, so the product of two
    sketches is never below that of their vectors.
    """

    def __init__(self, base: int, weights: bytes, vectors: bytes, tree: bytes, dim: int, kind: str, axes: np.ndarray):
        self.base, self.weights = base, np.frombuffer(weights, np.int64)
        self.ids = base + np.arange(len(self.weights))
        self.unit = _units(np.frombuffer(vectors, kind).reshape(-1, dim))
        self.tree = CoverTree.restored(self.unit, *pickle.loads(tree))
        along = self.unit @ axes
        rest = np.sqrt(np.clip(1 - (along * along).sum(axis=1), 0, None))
        self.sketch = np.column_stack((along, rest)).astype(np.float32)


def _axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal directions along which vectors differ most, all if they are few."""
    return np.linalg.eigh(np.cov(sample, rowvar=False, bias=True).reshape(sample.shape[1], -1))[1][:, ::-1][:, :SKETCH]


def _links(a: Chunk, b: Chunk, rows: slice, cols: np.ndarray | slice, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``a``, place in ``b``) with this cosine: sketches are multiplied first, vectors where sketches allow it."""
    products, least = a.sketch[rows] @ b.sketch[cols].T, np.float32(cosine - SKETCH_ROUNDING)
    some = np.flatnonzero(products.max(axis=1, initial=-1) >= least)
    x, y = np.nonzero(products[some] >= least)
    x, y = some[x] + rows.start, y if isinstance(cols, slice) else cols[y]
    if len(x) <= BLOCK * 8:
        linked = np.einsum("ij,ij->i", a.unit[x], b.unit[y]) >= cosine
        return x[linked], y[linked]
    some, others = np.unique(x), np.unique(y)
    x, y = np.nonzero(a.unit[some] @ b.unit[others].T >= cosine)
    return some[x], others[y]


def compare(a: Chunk, b: Chunk, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact links between two chunks (or within one): per node its linked weight, and a star edge per linked node.

    Returns node ids, weights and the id of the root of the node's component among these links.
    """
    alive = close_cells(a.tree, b.tree, distance_of(cosine))
    shift, n = (0, len(a.ids)) if same else (len(a.ids), len(a.ids) + len(b.ids))
    linked = np.zeros(n, np.int64)
    edges, waiting = [(np.arange(n), np.arange(n))], 0
    for k in range(0, len(a.ids), BLOCK):
        rows = slice(k, min(k + BLOCK, len(a.ids)))
        some = alive[a.tree.cell[rows.start]:a.tree.cell[rows.stop - 1] + 1].any(axis=0)
        x, y = _links(a, b, rows, slice(None) if some.all() else np.flatnonzero(some[b.tree.cell]), cosine)
        if same:
            x, y = x[x != y], y[x != y]
        linked += np.bincount(x, b.weights[y], minlength=n).astype(np.int64)
        if not same:
            linked += np.bincount(y + shift, a.weights[x], minlength=n).astype(np.int64)
        edges.append((x, y + shift))
        waiting += len(x)
        if waiting > 4 * n:  # one edge per node is held instead of a crowd's pairs
            edges, waiting = [(np.arange(n), _roots(n, *map(np.concatenate, zip(*edges, strict=True))))], 0
    root = _roots(n, *map(np.concatenate, zip(*edges, strict=True)))
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    hit = np.flatnonzero(linked)
    return ids[hit], linked[hit], ids[root[hit]]


def _written(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _small_batches(spark: SparkSession):
    """Rows of two chunks take megabytes, so few of them go to Python at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(ROW_BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _read(kind: str):
    """(id, list) to (id, length, digest, bytes); the last three are null where a vector cannot be compared. -0.0 counts as 0.0."""

    def run(batches):
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            left_out = [np.flatnonzero(length == 0)]
            for dim in np.unique(length[length > 0]):
                at = np.flatnonzero(length == dim)
                v = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim) + np.dtype(kind).type(0)
                fine = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
                left_out.append(at[~fine])
                v = np.ascontiguousarray(v[fine])
                if len(v):
                    keys = [hashlib.blake2b(r, digest_size=16).digest() for r in v]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[fine])), pa.array(np.full(len(v), dim, np.int32)), pa.array(keys, pa.binary()), _bytes(v)],
                                                     names=["_id", "dim", "key", "v"])
            at = np.concatenate(left_out)
            if len(at):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *[pa.nulls(len(at), t) for t in (pa.int32(), pa.binary(), pa.binary())]],
                                                 names=["_id", "dim", "key", "v"])

    return run


def _merged(keys: pa.ChunkedArray, ids: pa.ChunkedArray, weights: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Equal vectors as one: the place of the first of each, their smallest id (null if none has one) and the sum of their weights."""
    words = np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, 2)
    order = np.lexsort((words[:, 1], words[:, 0]))
    words = words[order]
    start = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]).any(axis=1))))
    known = pc.is_valid(ids).to_numpy()[order]
    most = np.iinfo(np.int64).max
    least = np.minimum.reduceat(np.where(known, pc.fill_null(ids, most).to_numpy()[order], most), start)
    has = np.logical_or.reduceat(known, start)
    return order[start], pa.array(least, mask=~has), np.add.reduceat(weights[order], start)


def _gathered(batches: Iterator[pa.RecordBatch], merge: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= MERGED_ROWS or sum(h.nbytes for h in held) >= MERGED_BYTES:
            yield from merge(pa.Table.from_batches(held)).combine_chunks().to_batches(max_chunksize=CHUNK)
            held.clear()
    if sum(h.num_rows for h in held):
        yield from merge(pa.Table.from_batches(held)).combine_chunks().to_batches(max_chunksize=CHUNK)


def _first_of_each(rows: pa.Table) -> pa.Table:
    return rows.take(pa.array(_merged(rows["key"], rows["_id"], np.ones(rows.num_rows, np.int64))[0]))


PLACED = "place int, part int, key binary, least bigint, weight bigint, far double, v binary"


def _place(tops: dict[int, tuple[np.ndarray, int, np.ndarray]], kind: str):
    """Each vector descends the top of the tree of its length; equal vectors among MERGED_ROWS become one row."""

    def out(rows: pa.Table) -> pa.Table:
        first, least, weight = _merged(rows["key"], rows["_id"], np.ones(rows.num_rows, np.int64))
        rows = rows.take(pa.array(first))
        dims, vectors = rows["dim"].to_numpy(), rows["v"].combine_chunks()
        place, part, far = np.empty(len(dims), np.int32), np.empty(len(dims), np.int32), np.empty(len(dims))
        word = np.frombuffer(b"".join(rows["key"].to_pylist()), np.uint32).reshape(-1, 4)[:, 0]
        for dim in np.unique(dims):
            centres, offset, parts = tops[int(dim)]
            at = np.flatnonzero(dims == dim)
            for k in range(0, len(at), CHUNK):
                some = at[k:k + CHUNK]
                d = distances(_units(_matrix(vectors.take(pa.array(some)), dim, kind)), centres)
                cell = d.argmin(axis=1)
                place[some], far[some], part[some] = cell + offset, d[np.arange(len(some)), cell], word[some] % parts[cell]
        return pa.table({"place": place, "part": part, "key": rows["key"], "least": least, "weight": weight, "far": far, "v": vectors})

    return lambda batches: _gathered(batches, out)


CHUNKS = "place int, n int, far double, keys binary, least array<bigint>, weights binary, vectors binary, tree binary"


def _pack(dim_of: Callable[[int], int], kind: str, sizes: dict[int, int], reach: float):
    """The vectors of one part of a cell as rows of bounded size, each with its tree."""

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType.fromDDL(CHUNKS))

    def run(key, table):
        place = key[0].as_py()
        dim = dim_of(place)
        first, least, weight = _merged(table["key"], table["least"], table["weight"].to_numpy())
        table = table.take(pa.array(first))
        out = []
        for at in np.array_split(np.arange(len(first)), ceil(len(first) / sizes[dim])):
            some = table.take(pa.array(at))
            v = _matrix(some["v"], dim, kind)
            tree = CoverTree(_units(v), INNER_CELLS, reach / 4)
            order = np.argsort(tree.cell, kind="stable")  # rows of a cell stand together
            now = np.empty(len(order), np.int64)
            now[order] = np.arange(len(order))
            out.append({"place": place, "n": len(at), "far": max(some["far"].to_pylist()), "keys": b"".join(some["key"].take(pa.array(order)).to_pylist()),
                        "least": least.take(pa.array(at[order])).to_pylist(), "weights": weight[at[order]].tobytes(), "vectors": v[order].tobytes(),
                        "tree": pickle.dumps((tree.cell[order], now[tree.order], tree.sizes, tree.radii[-1]))})
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, key, least, weight) of the vectors of chunks."""
    for b in batches:
        for base, keys, least, weights in zip(*(b.column(c) for c in range(4)), strict=True):
            n = len(least.values)
            yield pa.RecordBatch.from_arrays([pa.array(base.as_py() + np.arange(n)), _bytes(np.frombuffer(keys.as_py(), np.uint8).reshape(n, -1)), least.values,
                                              pa.array(np.frombuffer(weights.as_py(), np.int64))], names=["node", "key", "least", "weight"])


def _traverse(dim_of: Callable[[int], int], kind: str, axes: dict[int, np.ndarray], cosine: float, same: bool):
    """Links of each row's chunk a with its chunk b, or with itself. Rows that follow each other mostly have one chunk a, which is kept."""

    def run(batches):
        kept = None
        for b in batches:
            for k in range(b.num_rows):
                def chunk(side: str, row: int = k, batch: pa.RecordBatch = b) -> Chunk:
                    base, place, *rest = (batch.column(c + side)[row].as_py() for c in ("base", "place", "weights", "vectors", "tree"))
                    dim = dim_of(place)
                    return Chunk(base, *rest, dim, kind, axes[dim])

                if kept is None or kept.base != b.column("base_a")[k].as_py():
                    kept = chunk("_a")
                ids, linked, root = compare(kept, kept if same else chunk("_b"), same, cosine)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked), pa.array(root)], names=["node", "linked", "root"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Links and class of every vector under cosine >= ``cosine``, in double precision.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
    lengths. Equal vectors form one node, whose rows all link with each other. A row without an id takes part, but names no
    component unless its component has no id. Every row is a vector: repeated ids count each. Returns one row per row:
    vec_id, n_links, component_id (smallest id reachable, itself included) and kept (vec_id = component_id); for
    rows of one id and one vector that means all or none. No rows give no rows.

    Vectors stay in the precision they come in until they are compared, and cross the network once: the top levels of the tree
    are chosen from a bounded sample, every vector descends them, and the radii cover all. Cells are cut in chunks of bounded
    size, so a cell with most vectors is spread over many tasks; each chunk gets its own lower levels once. Pairs of cells that
    the radii rule out are never met; of each remaining pair of chunks both trees are descended together. Few such pairs
    are joined; many are met block by block, each task reading its two blocks of chunks from the shared folder, so what is
    stored does not grow with the number of pairs. A pair hands on how many vectors each node is linked with and one edge per
    linked node, never its pairs.
    """
    spark, reach = vectors.sparkSession, distance_of(cosine)
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    kind, width = ("float32", 4) if single else ("float64", 8)
    given = F.col(embedding) if single else F.col(embedding).cast("array<double>")
    rows = _written(vectors.select(F.col(vec_id).cast("long").alias("_id"), given.alias("_v")).mapInArrow(
        _read(kind), "_id bigint, dim int, key binary, v binary"), "vectors")
    used = rows.where(F.col("key").isNotNull())

    trees, tops, axes, sizes, offsets = {}, {}, {}, {}, []
    for dim, total in used.select("dim", "key").distinct().groupBy("dim").count().orderBy("dim").collect():
        low = used.where(F.col("dim") == dim)
        if total > 2 * TOP_SAMPLE:  # digests are spread evenly
            low = low.where(F.col("key") < F.lit(int(2.0**32 * 1.25 * TOP_SAMPLE / total).to_bytes(4, "big")))
        chosen = low.join(F.broadcast(low.select("key").distinct().orderBy("key").limit(TOP_SAMPLE)), "key", "left_semi")
        chosen = chosen.select(*rows.columns).mapInArrow(lambda batches: _gathered(batches, _first_of_each), rows.schema).dropDuplicates(["key"]).orderBy("key")
        sample = _units(np.frombuffer(b"".join(r["v"] for r in chosen.select("v").collect()), kind).reshape(-1, dim))
        sizes[dim] = max(1, min(CHUNK, CHUNK_BYTES // (dim * width)))
        top = trees[dim] = CoverTree(sample, max(1, min(TOP_CELLS, total // sizes[dim])), reach / 4)
        axes[dim] = _axes(sample)
        parts = np.ceil(np.bincount(top.cell, minlength=len(top.centres)) * (total / len(sample) / sizes[dim])).astype(int)
        offsets.append((sum(len(t.centres) for t in trees.values()) - len(top.centres), dim))
        tops[dim] = top.centres, offsets[-1][0], np.maximum(parts, 1)

    def dim_of(place: int) -> int:
        return offsets[bisect_right(offsets, (place, float("inf"))) - 1][1]

    packed = _written(used.mapInArrow(_place(tops, kind), PLACED).groupBy("place", "part").applyInArrow(_pack(dim_of, kind, sizes, reach), CHUNKS).withColumn(
        "base", F.shiftleft(F.monotonically_increasing_id(), PLACE_BITS)), "chunks", CHUNKS_PER_FILE)
    filled = {r["place"]: r for r in packed.groupBy("place").agg(F.max("far").alias("far"), F.count("*").alias("n"), F.sum(F.length("vectors")).alias("size")).collect()}
    near, pairs = [], 0
    for offset, dim in offsets:
        top = trees[dim]
        places = range(offset, offset + len(top.centres))
        top.set_radii(np.array([filled[p]["far"] if p in filled else 0.0 for p in places]))
        alive = np.triu(close_cells(top, top, reach))
        n = np.array([filled[p]["n"] if p in filled else 0 for p in places], float)
        pairs += (n @ alive @ n - n.sum()) / 2 + (n @ np.triu(alive, 1) @ n) / 2
        near += [(p, [int(q) + offset for q in np.flatnonzero(row & (n > 0))]) for p, row in zip(places, alive, strict=True) if p in filled]

    near = F.broadcast(spark.createDataFrame(near, "place_a int, near array<int>"))
    sides = [packed.select(*[F.col(c).alias(c + s) for c in ("base", "place", "weights", "vectors", "tree")]) for s in ("_a", "_b")]
    later = (F.col("place_a") < F.col("place_b")) | ((F.col("place_a") == F.col("place_b")) & (F.col("base_a") < F.col("base_b")))
    if pairs <= sum(r["n"] for r in filled.values()):
        met = near.withColumn("place_b", F.explode("near")).drop("near").join(packed.select(F.col("place").alias("place_a"), F.col("base").alias("base_a")), "place_a").join(
            packed.select(F.col("place").alias("place_b"), F.col("base").alias("base_b")), "place_b").where(later).select("base_a", "base_b")
        both = sides[0].join(F.broadcast(met), "base_a").join(sides[1].hint("merge"), "base_b")
    else:
        blocks = max(isqrt(4 * spark.sparkContext.defaultParallelism) + 1, ceil(sum(r["size"] for r in filled.values()) / BLOCK_BYTES))
        both = sides[0].join(near, "place_a").coalesce(blocks).hint("shuffle_replicate_nl").join(
            sides[1].coalesce(blocks), F.array_contains("near", F.col("place_b")) & later).drop("near")
    links = "node bigint, linked bigint, root bigint"
    with _small_batches(spark):
        linked = _written(sides[0].mapInArrow(_traverse(dim_of, kind, axes, cosine, True), links).union(
            both.mapInArrow(_traverse(dim_of, kind, axes, cosine, False), links)), "linked")

    nodes = packed.select("base", "keys", "least", "weights").mapInArrow(_nodes_of, "node bigint, key binary, least bigint, weight bigint")
    label = component_labels(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = linked.groupBy("node").agg(F.sum("linked").alias("linked"))
    named = _written(nodes.join(counted, "node", "left").join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    of_label = named.groupBy("label").agg(F.min("least").alias("component"))
    of_node = _written(named.join(of_label, "label").select("key", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component"), "classes")
    component = F.when(F.col("key").isNotNull(), F.col("component")).otherwise(F.col("_id"))
    return rows.select("_id", "key").join(of_node, "key", "left").select(
        F.col("_id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"))
