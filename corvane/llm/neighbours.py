"""Problem 1: the most similar vectors of every vector, by one navigable small-world graph per shard.

Shards are the cells of a coarse quantizer, fitted on at most ``FIT_ROWS`` vectors.  Cells
are counted exactly; one that holds more than ``SHARD_ROWS`` vectors is cut by planes through
its centre into sub-cells, so vectors are never copied to parts they can't belong to.

A shard's index is a hierarchy of small-world graphs: every vector has a random top level,
and a level's graph links each of its vectors to at most ``DEGREE`` others and as many
reverse ones.  Links start from the leaves of a few random-projection trees and are bettered
by neighbour descent (the neighbours of neighbours are the only candidates), then chosen by the
rule that a neighbour must be closer to the vector than to any neighbour already chosen.  A level is
one flat int32 array of neighbours, -1 where there is none.  A search descends the levels
with a narrow beam and ends in a beam of ``EF`` candidates over level 0; vectors of the shard
itself start at their own node.

The job has two passes.  The first builds every shard's graph and searches it for its own
vectors; the k-th cosine found, or the least one asked for, is a vector's floor.  The second
searches the other shards that may hold a better vector and merges the results.  Whether one
may is judged by planes: a vector of another cell lies beyond the plane halfway between the
two centres.  A neighbour of cosine f is sqrt(1 - f^2) away across the vector, and in ``dim``
dimensions that displacement points ``PROBE_WIDTH`` / sqrt(dim) of its length or further in one given direction
only rarely; planes further off than that are not crossed.  The rule is the same at every size and for every
floor, so its loss does not grow with the table; it is measured by :func:`recall`.

Equal vectors are collapsed to one node before indexing (on digests, with map-side
limits), so a vector that fills a third of the table costs one node; its copies are each
other's nearest, and of more than k + 1 copies each is linked to the first ones.

Defined results: null, zero, wrong-length vectors and those holding null, NaN or infinity
take no part; ties are broken by the smaller id; repeated rows of an id count once; an
empty table has no pairs; a vector without others above the least cosine has no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import cut_lineage, small

DIM = 64
FIT_ROWS = 40_000
"""Bound of the sample that the coarse quantizer is fitted on."""
CELL_ROWS = 16_000
SHARD_ROWS = 36_000
"""Cells of more vectors are cut by planes."""
MAX_CELLS = 10_000
"""Bound of the broadcast centres (2.5 MB); a larger table has its cells cut by planes."""
PROBE_WIDTH = 1.2
"""How far off, in standard deviations of an isotropic displacement, a plane is still crossed."""
DEGREE = 16
NEAR = 28
"""Near vectors that a vector's links are chosen from."""
LEVEL_SHARE = 1 / 4
TOP_ROWS = 1024
"""A level of no more vectors is the hierarchy's top and is scanned."""
TREES, LEAF, DESCENTS = 6, 96, 1
EF, STEPS = 24, 10
"""Width and steps of the beam over level 0; vectors of the shard itself take ``OWN_STEPS``."""
UPPER_EF, UPPER_STEPS = 20, 8
SLACK = 1e-5
"""What cosines in single precision may be off by."""
OWN_STEPS = 6
BATCH = 256
SCALE = 32_767
"""Unit vectors are shuffled with two bytes a dimension; cosines are off by some 1e-5."""


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dim: int = DIM) -> DataFrame:
    """(vec_id, embedding, h) of the vectors that take part; ``h`` is a digest of the vector."""
    e = F.col(column).cast("array<float>")
    top, low = F.array_max("embedding"), F.array_min("embedding")  # NaN counts as the greatest
    return (
        vectors.select(F.col(key).cast("long").alias("vec_id"), e.alias("embedding"))
        .where((F.size("embedding") == dim) & F.col("vec_id").isNotNull() & (F.size(F.array_compact("embedding")) == dim))
        .where(~F.isnan(top) & (top < float("inf")) & (low > float("-inf")) & ((top > 0) | (low < 0)))
        .withColumn("h", F.xxhash64("embedding"))
    )


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float32).reshape(-1, dim) if len(vectors) else np.empty((0, dim), np.float32)
    return m / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def fit_cells(sample: np.ndarray, n_cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means."""
    rng = np.random.default_rng(seed)
    if len(sample) <= n_cells:
        return sample if len(sample) else np.eye(1, DIM, dtype=np.float32)
    centers = sample[rng.choice(len(sample), n_cells, replace=False)]
    for _ in range(rounds):
        at = np.concatenate([np.argmax(sample[k : k + 8192] @ centers.T, 1) for k in range(0, len(sample), 8192)])
        sums = np.zeros_like(centers)
        np.add.at(sums, at, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        fresh = sample[rng.choice(len(sample), n_cells)]
        centers = np.where(size > 0, sums / np.maximum(size, 1e-9), fresh).astype(np.float32)
    return centers


# --- one shard's graph -------------------------------------------------------------------------

def _dots(vectors: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Cosines of every query with its own row of ``ids``; -2 for -1."""
    out = np.matmul(vectors.take(ids, 0, mode="clip"), queries[:, :, None])[:, :, 0]
    out[ids < 0] = -2.0
    return out


def _pick(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The elements of every row at its row of positions."""
    return a.ravel().take(at + (np.arange(len(a)) * a.shape[1])[:, None])


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best distinct ids of every row, best first."""
    order = np.argsort(ids, axis=1)
    ids, sims = _pick(ids, order), _pick(sims, order)
    sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -2.0
    if ids.shape[1] > k:
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        ids, sims = _pick(ids, top), _pick(sims, top)
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = _pick(ids, order), _pick(sims, order)
    ids[sims < -1.5] = -1
    return ids, sims


def _tree_leaves(vectors: np.ndarray, rng: np.random.Generator, leaf: int) -> np.ndarray:
    """Rows of about ``leaf`` near vectors each, by median cuts along random pairs' differences; some vectors occur twice."""
    n = len(vectors)
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    width = -(-n // (1 << depth))
    rows = np.concatenate((rng.permutation(n), rng.integers(0, n, (width << depth) - n)))[None, :]
    for _ in range(depth):
        g, w = rows.shape
        ends = rng.integers(0, w, (g, 2))
        at = np.arange(g)
        along = vectors[rows[at, ends[:, 0]]] - vectors[rows[at, ends[:, 1]]]
        rows = _pick(rows, np.argsort(np.matmul(vectors.take(rows, 0), along[:, :, None])[:, :, 0], axis=1))
        rows = rows.reshape(2 * g, -1) if w % 2 == 0 else _halves(rows)
    return rows


def _halves(rows: np.ndarray) -> np.ndarray:
    h = (rows.shape[1] + 1) // 2
    return np.concatenate((rows[:, None, :h], rows[:, None, -h:]), 1).reshape(-1, h)


def near_vectors(vectors: np.ndarray, k: int = NEAR, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """About the k nearest others of every vector (positions, cosines), by random-projection trees and neighbour descent."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    ids, sims = np.full((n, k), -1, np.int32), np.full((n, k), -2.0, np.float32)
    for _ in range(TREES):
        leaves = _tree_leaves(vectors, rng, max(LEAF, k + 2)).astype(np.int32)
        for a in range(0, len(leaves), 256):
            part = leaves[a : a + 256]
            v = vectors.take(part, 0)
            s = np.matmul(v, v.transpose(0, 2, 1))
            s[part[:, :, None] == part[:, None, :]] = -2.0
            w = part.shape[1]
            m = min(k, w)
            near = np.argpartition(-s, m - 1, axis=2)[:, :, :m].reshape(-1, m)
            at = part.ravel()
            s = _pick(s.reshape(-1, w), near)
            near = part[np.arange(len(part)).repeat(w)[:, None], near]
            at, once = np.unique(at, return_index=True)
            ids[at], sims[at] = _best(np.concatenate((ids[at], near[once]), 1), np.concatenate((sims[at], s[once]), 1), k)
    ids[sims < -1.5] = -1
    half = max(1, k * 2 // 5)
    for _ in range(DESCENTS):
        back = _reverse(ids, sims, half)
        around = np.concatenate((ids[:, :half], back), 1)
        new_ids, new_sims = ids.copy(), sims.copy()
        for a in range(0, n, BATCH):
            via = around[a : a + BATCH]
            far = ids[np.maximum(via, 0), :half]
            far[via < 0] = -1
            far = np.concatenate((far.reshape(len(via), -1), back[a : a + BATCH]), 1)
            far[far == np.arange(a, a + len(via), dtype=np.int32)[:, None]] = -1
            # only what beats the worst near vector goes on
            s = _dots(vectors, vectors[a : a + BATCH], far)
            s[s <= sims[a : a + BATCH, -1:]] = -2.0
            wide = min(2 * k, far.shape[1])
            top = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
            all_ids = np.concatenate((ids[a : a + BATCH], _pick(far, top)), 1)
            all_sims = np.concatenate((sims[a : a + BATCH], _pick(s, top)), 1)
            new_ids[a : a + BATCH], new_sims[a : a + BATCH] = _best(all_ids, all_sims, k)
        ids, sims = new_ids, new_sims
    return ids, sims


def _reverse(links: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Who links to every vector, the nearest ``width`` ones."""
    n = len(links)
    src, j = np.nonzero(links >= 0)
    dst, sim = links[src, j], sims[src, j]
    order = np.argsort(-sim, kind="stable")
    order = order[np.argsort(dst[order].astype(np.uint16 if n <= 65_536 else np.int32), kind="stable")]  # two bytes are sorted by radix
    src, dst = src[order], dst[order]
    rank = np.arange(len(dst)) - np.searchsorted(dst, np.arange(n))[dst]
    keep = rank < width
    back = np.full((n, width), -1, np.int32)
    back[dst[keep], rank[keep]] = src[keep]
    return back


def build_level(vectors: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The flat neighbour array of one level: ``degree`` chosen links and as many reverse ones."""
    n = len(vectors)
    if n <= 1:
        return np.full((n, 2 * degree), -1, np.int32)
    near, sims = near_vectors(vectors, NEAR)
    links = np.concatenate([_select_block(vectors, a, near[a : a + 512], sims[a : a + 512], degree) for a in range(0, n, 512)])
    kept = np.full(links.shape, -2.0, np.float32)
    for a in range(0, n, 4096):
        kept[a : a + 4096] = _dots(vectors, vectors[a : a + 4096], links[a : a + 4096])
    back = _reverse(links, kept, degree)
    back[(back[:, :, None] == links[:, None, :]).any(2)] = -1
    return np.concatenate((links, back), axis=1)


def _select_block(vectors: np.ndarray, start: int, near: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    around = vectors.take(near, 0, mode="clip")
    between = np.matmul(around, around.transpose(0, 2, 1))
    n, m = near.shape
    chosen = np.full((n, degree), -1, np.int32)
    count = np.zeros(n, np.int64)
    kept = np.zeros((n, m), bool)
    for j in range(m):
        closest = np.where(kept[:, :j], between[:, j, :j], -2.0).max(1, initial=-2.0)
        rows = np.flatnonzero((closest < sims[:, j]) & (count < degree) & (near[:, j] >= 0))
        kept[rows, j] = True
        chosen[rows, count[rows]] = near[rows, j]
        count[rows] += 1
    for j in range(m):
        rows = np.flatnonzero(~kept[:, j] & (count < degree) & (near[:, j] >= 0))
        chosen[rows, count[rows]] = near[rows, j]
        count[rows] += 1
    return chosen


class Graph:
    """A hierarchy of levels over one shard's unit vectors; ``base`` gives level 0 if it is built already.

    Without ``upper`` there is level 0 only, which is all that :meth:`search_own` needs.
    """

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, seed: int = 11, base: np.ndarray | None = None, upper: bool = True):
        self.vectors = vectors
        rng = np.random.default_rng(seed)
        members = np.arange(len(vectors))
        #: the level's members, their vectors, and their neighbours as positions in members
        self.levels = [(members, vectors, build_level(vectors, degree) if base is None else base)]
        while upper and len(members) > TOP_ROWS:
            members = members[rng.random(len(members)) < LEVEL_SHARE]
            if not len(members):
                break
            v = vectors[members]
            self.levels.append((members, v, build_level(v, degree)))
        #: where a level's members are among those of the level below
        self.below = [np.searchsorted(lower[0], level[0]) for lower, level in zip(self.levels, self.levels[1:])]

    def search(self, queries: np.ndarray, k: int, ef: int = EF, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
        """The k best (positions, cosines) per query by descending the levels; -1 where there are fewer."""
        out_ids, out_sims = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -2.0, np.float32)
        for a in range(0, len(queries), BATCH):
            q = queries[a : a + BATCH]
            members, v, _ = self.levels[-1]
            s = q @ v.T
            wide = min(UPPER_EF if len(self.levels) > 1 else max(ef, k), len(members))
            at = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
            s = _pick(s, at)
            for level in range(len(self.levels) - 2, -1, -1):
                _, v, links = self.levels[level]
                at = self.below[level][at]  # where there is no node, its cosine of -2 says so
                at, s = self._beam(q, at, s, v, links, ef if level == 0 else UPPER_EF, steps if level == 0 else UPPER_STEPS)
            self._put(out_ids, out_sims, a, at, s, k)
        return out_ids, out_sims

    def search_own(self, k: int, ef: int = EF, steps: int = OWN_STEPS) -> tuple[np.ndarray, np.ndarray]:
        """The k best others (positions, cosines) of every vector of the shard, from its own node."""
        n = len(self.vectors)
        out_ids, out_sims = np.full((n, k), -1, np.int64), np.full((n, k), -2.0, np.float32)
        _, v, links = self.levels[0]
        for a in range(0, n, BATCH):
            at = np.arange(a, min(n, a + BATCH))[:, None]
            at, s = self._beam(v[a : a + BATCH], at, np.full(at.shape, 2.0, np.float32), v, links, max(ef, k + 1), steps)
            self._put(out_ids, out_sims, a, at[:, 1:], s[:, 1:], k)  # the first is the vector itself
        return out_ids, out_sims

    @staticmethod
    def _put(out_ids: np.ndarray, out_sims: np.ndarray, a: int, at: np.ndarray, s: np.ndarray, k: int) -> None:
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        out_ids[a : a + len(at), : order.shape[1]] = np.take_along_axis(at, order, 1)
        out_sims[a : a + len(at), : order.shape[1]] = np.take_along_axis(s, order, 1)
        out_ids[a : a + len(at)][out_sims[a : a + len(at)] < -1.5] = -1

    @staticmethod
    def _beam(queries: np.ndarray, at: np.ndarray, sims: np.ndarray, v: np.ndarray, links: np.ndarray, ef: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``ef`` nodes met when the best node not yet expanded is expanded ``steps`` times."""
        n, have = at.shape
        rows = np.arange(n)
        start = np.arange(1, n * (len(v) + 1), len(v) + 1)[:, None]
        seen = np.zeros(n * (len(v) + 1), bool)  # a query's flags begin with the one of -1
        seen[start - 1] = True
        ids = np.full((n, max(ef, have)), -1, np.int64)
        best = np.full(ids.shape, -2.0, np.float32)
        ids[:, :have], best[:, :have] = np.where(sims > -1.5, at, -1), sims
        todo = ids >= 0
        seen[start + ids] = True
        for _ in range(steps):
            open_sims = np.where(todo, best, -3.0)
            pick = np.argmax(open_sims, axis=1)
            live = open_sims[rows, pick] > -2.5
            if not live.any():
                break
            todo[rows, pick] = False
            near = links.take(ids[rows, pick], 0, mode="clip").astype(np.int64)
            near[~live] = -1
            flags = start + near
            near[seen.take(flags)] = -1
            seen[flags] = True
            s = _dots(v, queries, near)
            all_ids, all_sims = np.concatenate((ids, near), 1), np.concatenate((best, s), 1)
            all_todo = np.concatenate((todo, near >= 0), 1)
            top = np.argpartition(-all_sims, ids.shape[1] - 1, axis=1)[:, : ids.shape[1]]
            ids, best, todo = _pick(all_ids, top), _pick(all_sims, top), _pick(all_todo, top)
        order = np.argsort(-best, axis=1, kind="stable")
        return _pick(ids, order), _pick(best, order)


# --- all shards ----------------------------------------------------------------------------------

class Cells:
    """The shared plan: the cells' centres and how many planes cut each."""

    def __init__(self, centers: np.ndarray, counts: np.ndarray):
        self.centers = centers
        self.planes = np.ceil(np.log2(np.maximum(1.0, counts / SHARD_ROWS))).astype(np.int64)
        rng = np.random.default_rng(13)
        self.directions = rng.standard_normal((max(1, int(self.planes.max(initial=0))), centers.shape[1])).astype(np.float32)

    def own(self, v: np.ndarray) -> np.ndarray:
        return np.argmax(v @ self.centers.T, axis=1)

    def sides(self, v: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Signed distances of every vector from the planes of the cell beside it; planes hold the cell's centre."""
        c = self.centers[cell]
        out = v @ self.directions.T - np.einsum("nd,nd->n", v, c)[:, None] * (c @ self.directions.T)
        across = np.sqrt(np.maximum(1e-6, (self.directions ** 2).sum(1)[None, :] - (c @ self.directions.T) ** 2))
        return out / across

    def sub(self, v: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The sub-cell of every vector in the cell beside it."""
        n = self.planes[cell]
        if not n.any():
            return np.zeros(len(v), np.int64)
        bits = (self.sides(v, cell) > 0) & (np.arange(len(self.directions))[None, :] < n[:, None])
        return bits @ (1 << np.arange(len(self.directions)))

    def routes(self, v: np.ndarray, cell: int, sub: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, sub) of every other shard that a vector is to be searched in."""
        reach = PROBE_WIDTH * np.sqrt(np.maximum(0.0, 1.0 - np.clip(floors, 0.0, 1.0) ** 2)) / np.sqrt(v.shape[1])
        apart = np.linalg.norm(self.centers[cell] - self.centers, axis=1)
        sims = v @ self.centers.T
        s = (sims[:, cell, None] - sims) / np.maximum(apart, 1e-3)
        r, c = np.nonzero((s <= reach[:, None]) | (np.arange(len(apart)) == cell)[None, :])
        if not self.planes[c].any():
            other = c != cell
            return r[other], c[other], np.zeros(int(other.sum()), np.int64)
        sides, n = self.sides(v[r], c), self.planes[c]
        to = np.zeros(len(r), np.int64)
        for j in range(len(self.directions)):
            used = j < n
            up = used & (sides[:, j] > 0)
            both = np.flatnonzero(used & (np.abs(sides[:, j]) <= reach[r]))
            to2 = to[both] + (~up[both]).astype(np.int64) * (1 << j)
            to = to + up * (1 << j)
            r, c, n, sides, to = np.concatenate((r, r[both])), np.concatenate((c, c[both])), np.concatenate((n, n[both])), np.concatenate((sides, sides[both])), np.concatenate((to, to2))
        other = (c != cell) | (to != sub)
        return r[other], c[other], to[other]


def _assigner(shared, dim: int):
    """Every vector with its own shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            v = _matrix(pdf["embedding"], dim)
            cell = cells.own(v)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "sub": cells.sub(v, cell).astype(np.int32), "vec_id": pdf["vec_id"].to_numpy(), "v": _blobs(np.rint(v * SCALE).astype(np.int16))})

    return run


def _counter(shared, dim: int):
    """How many vectors of a batch are in every cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell, n = np.unique(np.argmax(_matrix(pdf["embedding"], dim) @ shared.value.T, axis=1), return_counts=True)
                yield pd.DataFrame({"cell": cell.astype(np.int32), "n": n})

    return run


def _blobs(m: np.ndarray) -> np.ndarray:
    out = np.empty(len(m), dtype=object)
    out[:] = [x.tobytes() for x in m]
    return out


def _links(m: np.ndarray) -> np.ndarray:
    """A level's links as one blob per vector, two bytes a link where the shard allows."""
    return _blobs(m.astype(np.uint16) if len(m) < 65_535 else m)


def _level(blobs: np.ndarray) -> np.ndarray:
    if len(blobs[0]) == 8 * DEGREE:
        return _stack(blobs, np.int32, 2 * DEGREE)
    m = _stack(blobs, np.uint16, 2 * DEGREE).astype(np.int32)
    m[m == 65_535] = -1
    return m


def _stack(blobs: np.ndarray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=kind).reshape(-1, width)


def _vectors(blobs: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors as they were shuffled."""
    m = _stack(blobs, np.int16, dim).astype(np.float32)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


ROUTED = "cell int, sub int, vec_id long, v binary, floor float, links binary, own binary"


def _builder(shared, k: int, dim: int, least: float):
    """A shard's vectors with their links and nearest of the shard, and copies for the other shards to be searched."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = shared.value
        cell, sub = int(pdf["cell"].iloc[0]), int(pdf["sub"].iloc[0])
        ids, first = np.unique(pdf["vec_id"].to_numpy(), return_index=True)
        blobs = pdf["v"].to_numpy()[first]
        v = _vectors(blobs, dim)
        g = Graph(v, upper=False)
        own, sims = g.search_own(k)
        floors = np.maximum(sims[:, k - 1], np.float32(least))
        home = pd.DataFrame({
            "cell": np.int32(cell), "sub": np.int32(sub), "vec_id": ids, "v": blobs, "floor": floors, "links": _links(g.levels[0][2]), "own": _blobs(own.astype(np.int32)),
        })
        parts = [cells.routes(v[a : a + BATCH], cell, sub, floors[a : a + BATCH]) for a in range(0, len(v), BATCH)]
        r = np.concatenate([p[0] + a for p, a in zip(parts, range(0, len(v), BATCH))])
        away = pd.DataFrame({
            "cell": np.concatenate([p[1] for p in parts]).astype(np.int32), "sub": np.concatenate([p[2] for p in parts]).astype(np.int32),
            "vec_id": ids[r], "v": blobs[r], "floor": floors[r], "links": None, "own": None,
        })
        return pd.concat((home, away), ignore_index=True) if len(away) else home

    return run


def _searcher(k: int, dim: int, least: float):
    """What a shard's vectors found at home, and what the vectors of other shards find here over their floors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at_home = pdf["links"].notna().to_numpy()
        home = pdf[at_home].sort_values("vec_id")
        if not len(home):
            return pd.DataFrame({"vec_id": np.empty(0, np.int64), "other": np.empty(0, np.int64), "cosine": np.empty(0)})
        ids, v = home["vec_id"].to_numpy(), _vectors(home["v"].to_numpy(), dim)
        own = _stack(home["own"].to_numpy(), np.int32, k)
        r, j = np.nonzero(own >= 0)
        found = [(ids[r], ids[own[r, j]], np.einsum("nd,nd->n", v[r].astype(np.float64), v[own[r, j]].astype(np.float64)))]
        away = pdf[~at_home]
        if len(away):
            g = Graph(v, base=_level(home["links"].to_numpy()))
            q, asked = _vectors(away["v"].to_numpy(), dim), away["vec_id"].to_numpy()
            at, sims = g.search(q, k)
            r, j = np.nonzero((at >= 0) & (sims > away["floor"].to_numpy()[:, None] - SLACK))
            found.append((asked[r], ids[at[r, j]], np.einsum("nd,nd->n", q[r].astype(np.float64), v[at[r, j]].astype(np.float64))))
        a, b, cosine = (np.concatenate(x) for x in zip(*found))
        keep = (cosine > least) & (a != b)
        return pd.DataFrame({"vec_id": a[keep], "other": b[keep], "cosine": cosine[keep]})

    return run


def nearest(vectors: DataFrame, k: int = 5, least: float = -1.0, dim: int = DIM) -> DataFrame:
    """(vec_id, other, cosine, rank): the k most similar others of every usable vector, over the cosine ``least``."""
    spark = vectors.sparkSession
    all_rows = usable(vectors, dim=dim)
    ids = all_rows.select("vec_id", "h")
    # copies: the first k + 1 ids of every digest, limited before the shuffle
    w = Window.partitionBy("h").orderBy("vec_id")
    groups = ids.groupBy("h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    groups = cut_lineage(groups)
    groups_side = small(groups)
    nodes = (
        all_rows.join(groups_side, "h", "left").where(F.col("rep").isNull() | (F.col("rep") == F.col("vec_id"))).select("vec_id", "h", "embedding")
        if groups.take(1) else all_rows.select("vec_id", "h", "embedding")
    )
    n = vectors.count()
    n_cells = min(MAX_CELLS, max(1, -(-n // CELL_ROWS)))
    share = min(1.0, FIT_ROWS / max(1, n))
    picked = nodes.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("embedding").limit(FIT_ROWS).toPandas()
    centers = fit_cells(_matrix(picked["embedding"], dim), n_cells)
    counts = np.zeros(len(centers))
    if len(centers) > 1 or n > SHARD_ROWS:
        context = spark.sparkContext.broadcast(centers)
        # at most MAX_CELLS sums reach the driver
        for r in nodes.select("embedding").mapInPandas(_counter(context, dim), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            counts[r.cell] = r.n
    cells = Cells(centers, counts)
    shared = spark.sparkContext.broadcast(cells)
    assigned = nodes.mapInPandas(_assigner(shared, dim), "cell int, sub int, vec_id long, v binary")
    # the number of tasks follows the number of shards, so a task's input is bounded at every size
    shards = int((1 << cells.planes).sum())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * shards)
    routed = assigned.repartition(tasks, "cell", "sub").groupBy("cell", "sub").applyInPandas(_builder(shared, k, dim, least), ROUTED)
    hits = routed.repartition(tasks, "cell", "sub").groupBy("cell", "sub").applyInPandas(_searcher(k, dim, least), "vec_id long, other long, cosine double")
    if groups.take(1):
        member = ids.join(groups_side, "h").select("h", "vec_id", "rep")
        first = member.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1).select("h", "rep", F.col("vec_id").alias("other"))
        copies = member.select("h", "vec_id").join(first, "h").where("vec_id <> other").select("vec_id", "other", F.lit(1.0).alias("cosine"))
        # a found representative stands for its first copies; what it found itself holds for those of its copies
        # that have room left, which copies beyond the first k + 1 (all linked to the first ones) never have
        mine = small(first.select(F.col("rep").alias("r"), F.col("other").alias("copy")).distinct())
        to = hits.join(mine, hits.other == mine.r, "left").select("vec_id", F.coalesce("copy", "other").alias("other"), "cosine")
        hits = to.join(mine, to.vec_id == mine.r, "left").select(F.coalesce("copy", "vec_id").alias("vec_id"), "other", "cosine").unionByName(copies)
    best = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "other")
    return (
        hits.where((F.col("cosine") > least) & (F.col("vec_id") != F.col("other"))).repartition("vec_id").dropDuplicates(["vec_id", "other"])  # one exchange for both
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    )


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.85, dim: int = DIM) -> DataFrame:
    """(vec_a, vec_b), a < b: one of the two is among the k nearest of the other, over ``least``."""
    got = nearest(vectors, k, least, dim)
    return got.select(F.least("vec_id", "other").alias("vec_a"), F.greatest("vec_id", "other").alias("vec_b")).distinct()


def recall(vectors: DataFrame, k: int = 5, least: float = 0.85, dim: int = DIM, every: int = 100) -> DataFrame:
    """Recall of the pairs of every ``every``-th vector against all vectors, by brute force in blocks: (n_true, n_found, recall)."""
    spark = vectors.sparkSession
    rows = usable(vectors, dim=dim).dropDuplicates(["vec_id"])
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    blocks = max(1, -(-asked.count() // 512))
    out = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", "embedding").toPandas()
        shared = spark.sparkContext.broadcast((part["vec_id"].to_numpy(), _matrix(part["embedding"], dim)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            q_ids, q = shared.value
            for pdf in batches:
                if not len(pdf) or not len(q):
                    continue
                ids = pdf["vec_id"].to_numpy()
                s = q.astype(np.float64) @ _matrix(pdf["embedding"], dim).astype(np.float64).T
                s[q_ids[:, None] == ids[None, :]] = -2.0
                top = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, : k + 1]
                r = np.repeat(np.arange(len(q)), top.shape[1])
                c = top.ravel()
                ok = s[r, c] > least
                yield pd.DataFrame({"vec_id": q_ids[r[ok]], "other": ids[c[ok]], "cosine": s[r[ok], c[ok]]})

        hits = rows.select("vec_id", "embedding").mapInPandas(run, "vec_id long, other long, cosine double")
        out = hits if out is None else out.unionByName(hits)
    best = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "other")
    true = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("vec_id", "other")
    mine = nearest(vectors, k, least, dim).select("vec_id", "other", F.lit(1).alias("hit"))
    return true.join(mine, ["vec_id", "other"], "left").agg(
        F.count("*").alias("n_true"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall")
    )
