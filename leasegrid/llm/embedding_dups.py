"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated by a fixed random rotation and split into low-dimensional blocks. Two
vectors of cosine >= t lie within squared distance 2 - 2t, so in at least one block they lie within
that block's share of it, proportional to its dimensions. Each block is range-joined on its own:
strips of its first coordinate, as wide as the block's radius, meet themselves and the next strip,
in tiles of bounded size. The union of the blocks' candidates is verified exactly in double
precision. A pair is counted in the one block where its share is smallest, so nothing is counted
twice and no list of pairs leaves a task: tiles give link counts and a spanning forest.

Equal vectors are one representative with a multiplicity. Vectors that are null, empty, zero or hold
null or non-finite components link with nothing and are their own component; vectors of different
length do not link. Rows with a null id are returned with no links and a null component; rows that
share an id are vectors of their own, in one component. An empty table gives an empty result, and
other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .components import components
from .shared import bounded_batches, lean, stored

#: dimensions per block
BLOCK_DIMS = 8
#: vectors on each side of a tile
TILE = 16_384
#: rows of a tile's side compared at once, and candidate pairs verified at once
STEP, VERIFY = 128, 1 << 17
#: allowance of the candidate search for rounding, in squared distance
SLACK = 1e-5

TILE_KEY = ["dim", "block", "cell", "up", "i", "j"]


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(dim)).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def block_bounds(dim: int) -> np.ndarray:
    """First dimension of each block, and the end."""
    return np.linspace(0, dim, max(1, round(dim / BLOCK_DIMS)) + 1).round().astype(int)


def rotated(x: np.ndarray) -> np.ndarray:
    """Unit vectors in rotated coordinates; a row's result depends on that row alone, to the last bit."""
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    turn, out = rotation(x.shape[1]), np.zeros_like(unit)
    for k in range(x.shape[1]):
        out += unit[:, k:k + 1] * turn[k]
    return out


def _matrix(vecs, dim: int, single: bool) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), np.float32 if single else np.float64).reshape(-1, dim).astype(np.float64)


def _clean(rows: DataFrame) -> DataFrame:
    """(vec_id, dim, vec): vec holds the components' bytes, null if the vector takes part in no link."""
    single = rows.schema["embedding"].dataType.elementType.simpleString() == "float"
    number = np.float32 if single else np.float64
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            vecs, dims = [], []
            for v in b.column(1):
                vals = v.values if v.is_valid else None
                a = vals.to_numpy(zero_copy_only=False).astype(number) if vals is not None and len(vals) and not vals.null_count else None
                wide = a.astype(np.float64) if a is not None else None
                ok = a is not None and np.isfinite(wide).all() and 0 < (wide * wide).sum() < np.inf
                vecs.append(a.tobytes() if ok else None)
                dims.append(len(a) if ok else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], names=["vec_id", "dim", "vec"])

    return rows.mapInArrow(lean(run), f"vec_id {kind}, dim int, vec binary")


def _groups(t: pa.Table) -> dict[int, np.ndarray]:
    dims = t.column("dim").to_numpy()
    return {int(d): np.flatnonzero(dims == d) for d in np.unique(dims)}


def _cells(y: np.ndarray, budget: float) -> list[np.ndarray]:
    """The strip of each vector in each block."""
    dim, first = y.shape[1], block_bounds(y.shape[1])
    radius = np.sqrt(budget * np.diff(first) / dim)
    return [np.floor(y[:, a] / r).astype(np.int64) for a, r in zip(first[:-1], radius, strict=True)]


def _links(xa, ya, xb, yb, same: bool, block: int, t: float, budget: float):
    """(i, j) of the links of a tile that belong to ``block``."""
    dim, first = ya.shape[1], block_bounds(ya.shape[1])
    width = np.diff(first)
    lo, hi, share = first[block], first[block + 1], budget * width[block] / dim
    # |a - b|^2 as one product: (-2a, |a|^2, 1) . (b, 1, |b|^2)
    left, right = ya[:, lo:hi], yb[:, lo:hi]
    left = np.column_stack((-2 * left, (left * left).sum(axis=1), np.ones(len(left)))).astype(np.float32)
    right = np.column_stack((right, np.ones(len(right)), (right * right).sum(axis=1))).astype(np.float32)
    size_a, size_b = np.sqrt((xa * xa).sum(axis=1)), np.sqrt((xb * xb).sum(axis=1))
    for s in range(0, len(ya), STEP):
        e = min(s + STEP, len(ya))
        from_b = s if same else 0
        found = np.flatnonzero(left[s:e] @ right[from_b:].T <= np.float32(share + SLACK))
        i, j = np.divmod(found, len(right) - from_b)
        i, j = i + s, j + from_b
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), VERIFY):
            u, v = i[k:k + VERIFY], j[k:k + VERIFY]
            ok = np.einsum("ij,ij->i", xa[u], xb[v]) >= t * (size_a[u] * size_b[v])
            u, v = u[ok], v[ok]
            if len(u):
                d = np.add.reduceat((ya[u] - yb[v]) ** 2, first[:-1], axis=1) / width
                mine = d.argmin(axis=1) == block
                yield u[mine], v[mine]


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a and b in ``parent``, smallest index on top."""
    while len(a):
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _tile(t: pa.Table, single: bool, limit: float, budget: float) -> pa.RecordBatch:
    dim, block = t.column("dim")[0].as_py(), t.column("block")[0].as_py()
    side, rep, mult = (t.column(c).to_numpy() for c in ("side", "rep", "mult"))
    x = _matrix((v.as_py() for v in t.column("vec")), dim, single)
    y = rotated(x)
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = t.column("up")[0].as_py() == 0 and t.column("i")[0].as_py() == t.column("j")[0].as_py()
    if same:
        b = a
    links, parent = np.zeros(len(rep), np.int64), np.arange(len(rep))
    for i, j in _links(x[a], y[a], x[b], y[b], same, block, limit, budget):
        i, j = a[i], b[j]
        np.add.at(links, i, mult[j])
        np.add.at(links, j, mult[i])
        _merge(parent, i, j)
    at, edge = np.flatnonzero(links), np.flatnonzero(parent != np.arange(len(rep)))
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate((rep[at], rep[edge]))), pa.array(np.concatenate((links[at], np.zeros(len(edge), np.int64)))),
        pa.array(np.concatenate((rep[at], rep[parent[edge]])))], names=["a", "links", "b"])


def near_duplicates(vectors: DataFrame, t: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are pairs of cosine >= t, the component is
    the smallest id reachable by links, and a row is kept if that is its own."""
    bounded_batches(vectors.sparkSession)
    budget = 2 - 2 * t + 1e-12
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"))
    single = source.schema["embedding"].dataType.elementType.simpleString() == "float"
    clean = stored(_clean(source).withColumn("key", F.when(F.col("vec_id").isNotNull(), F.md5("vec"))), "vectors")
    reps = stored(clean.where("key is not null").groupBy("dim", "key")
                  .agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("vec").alias("vec")), "reps")

    def strips(batches):
        for b in batches:
            tab = pa.Table.from_batches([b])
            for dim, at in _groups(tab).items():
                cells = _cells(rotated(_matrix(tab.column("vec").take(at).to_pylist(), dim, single)), budget)
                for block, c in enumerate(cells):
                    cell, n = np.unique(c, return_counts=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(cell), dim, np.int32)), pa.array(np.full(len(cell), block, np.int32)),
                        pa.array(cell), pa.array(n.astype(np.int64))], names=["dim", "block", "cell", "n"])

    # at most 2 / radius strips for each block of each vector length
    counts = (reps.select("dim", "vec").mapInArrow(lean(strips), "dim int, block int, cell long, n long")
              .groupBy("dim", "block", "cell").agg(F.sum("n").alias("n")).collect())
    chunks = {(r["dim"], r["block"], r["cell"]): -(-r["n"] // TILE) for r in counts}

    def deal(batches):
        for b in batches:
            tab = pa.Table.from_batches([b])
            rep_all = tab.column("rep").to_numpy()
            for dim, at in _groups(tab).items():
                cells = _cells(rotated(_matrix(tab.column("vec").take(at).to_pylist(), dim, single)), budget)
                spread = wordhash.mix(rep_all[at].astype(np.uint64))
                for block, c in enumerate(cells):
                    for cell in np.unique(c):
                        own, cell = at[c == cell], int(cell)
                        k = chunks[dim, block, cell]
                        chunk = (spread[c == cell] % np.uint64(k)).astype(np.int64)
                        below, above = chunks.get((dim, block, cell - 1), 0), chunks.get((dim, block, cell + 1), 0)
                        roles = [(chunk == i, cell, 0, i, j, 0) for i in range(k) for j in range(i, k)]
                        roles += [(chunk == j, cell, 0, i, j, 1) for i in range(k) for j in range(i + 1, k)]
                        roles += [(chunk == i, cell, 1, i, j, 0) for i in range(k) for j in range(above)]
                        roles += [(chunk == j, cell - 1, 1, i, j, 1) for j in range(k) for i in range(below)]
                        for mask, low, up, i, j, side in roles:
                            rows = own[mask]
                            if len(rows):
                                key = [np.full(len(rows), v, np.int32) for v in (dim, block, low, up, i, j, side)]
                                yield pa.RecordBatch.from_arrays(
                                    [*(pa.array(v) for v in key), *(tab.column(n).take(rows).combine_chunks() for n in ("rep", "mult", "vec"))],
                                    names=[*TILE_KEY, "side", "rep", "mult", "vec"])

    def join(batches):
        held = None
        for b in batches:
            tab = pa.Table.from_batches([b])
            tab = pa.concat_tables([held, tab]) if held is not None else tab
            key = np.stack([tab.column(c).to_numpy() for c in TILE_KEY])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                yield _tile(tab.slice(lo, hi - lo), single, t, budget)
            held = tab.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield _tile(held, single, t, budget)

    dealt = reps.select("dim", "rep", "mult", "vec").mapInArrow(
        lean(deal), ", ".join(f"{c} int" for c in [*TILE_KEY, "side"]) + ", rep long, mult long, vec binary")
    found = stored(dealt.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY)
                   .mapInArrow(lean(join), "a long, links long, b long"), "links")
    degree = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    comp = components(found.where("links = 0").select("a", "b")).withColumnRenamed("node", "rep")
    per_rep = reps.select("dim", "key", "rep", "mult").join(degree, "rep", "left").join(comp, "rep", "left")
    out = clean.select("vec_id", "dim", "key").join(per_rep, ["dim", "key"], "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("mult") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
