"""Exact top-k search by inner product: a Voronoi join of queries and data.

Vectors are quantized to integers, floor(64 * x). Pivots, more of them for larger tables, part them into cells; the
vectors of a cell are packed in blocks of at most ``BLOCK``, those of queries and those of data apart. Let p(j) be
the pivot of data cell j and s(j) the largest distance of its data to it (a block has such a radius of its own). Then

    q . d  <=  q . p(j) + |q| s(j)

bounds the scores of a whole cell for a query. The other side is a floor: the scores of a fixed number of
data vectors, known to all tasks, give every query a score that its k-th neighbour reaches. Cells whose bound stays below
the floor of every query of a group fall out; the data of the others are replicated to that group. A group holds at
most ``GROUP`` queries and its data are dealt out in slabs of about ``SLAB`` vectors, so no task grows with the table.
Each (group, slab) solves locally, by matrix products of the block's vectors with those queries whose bound for the block
reaches their k-th score so far; the best k of its slabs are merged by query.

Defined results: vectors null, empty, of another length than most of the sample, or with null or non-finite
components take no part, nor do null ids, nor vectors so long that a score might not fit in 64 bits; equal scores go to
the smaller id; a query's own id is never its neighbour (rows that repeat an id included); repeated rows of one id and
score count once; fewer candidates than k give all of them; an empty table gives an empty one; further columns don't
matter. Sums beyond 2**53 are taken in 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import Scratch, prepare, tidy

K, SCALE, SAMPLE, BLOCK, GROUP = 20, 64, 4096, 2048, 2048
NONE = -(1 << 63) + 1  # no score; its negative fits too
#: Data vectors of a slab, about; vectors that a packing task holds; fewest and most pivots.
SLAB, HELD, PIVOTS = 1 << 18, 1 << 16, (48, 512)
BLOCKS = "side int, cell int, block long, n int, ids binary, vectors binary, norm double, radius double"


def quantized(column: pa.Array, dim: int, scale: int = SCALE):
    """Integer vectors (rows x dim) and the rows that take part."""
    sizes = np.array([-1 if v is None else v for v in pa.compute.list_value_length(column).to_pylist()])
    rows = np.flatnonzero(sizes == dim)
    if not len(rows):
        return rows, np.zeros((0, dim), np.int64)
    flat = pa.compute.list_flatten(column.take(pa.array(rows)))
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(len(rows), dim)
    with np.errstate(invalid="ignore"):
        good = np.isfinite(x).all(1) & (np.abs(x * scale) < (2**62 // dim) ** 0.5 - 1).all(1)
    return rows[good], np.floor(scale * x[good]).astype(np.int64)


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Few rounds of k-means on the sample, started from spread rows; every step is determined by the rows."""
    x = np.unique(x, axis=0).astype(float)
    if len(x) <= n:
        return x
    p = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(5):
        near = ((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)).argmin(1)
        for c in range(n):
            if (near == c).any():
                p[c] = x[near == c].mean(0)
    return np.unique(p, axis=0)


def _pack(pivots, dim, every):
    def run(batches):
        held: dict[tuple[int, int], list] = {}
        size: dict[tuple[int, int], int] = {}
        serial = 0

        def flush(key):
            nonlocal serial
            parts = held.pop(key)
            size.pop(key)
            ids, x = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
            order = np.lexsort((*x.T[::-1], ids))
            ids, x = ids[order], x[order]
            new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(1)))  # repeated rows once
            ids, x = ids[new], x[new]
            far = np.sqrt(((x - pivots[key[1]]) ** 2).sum(1)).max()
            serial += 1
            small = np.int16 if np.abs(x).max(initial=0) < 2**15 else np.int64
            row = [key[0], key[1], serial, len(ids), ids.tobytes(), x.astype(small).tobytes(), float(np.sqrt((x.astype(float) ** 2).sum(1)).max()), float(far)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.float64()], strict=True)], ["side", "cell", "block", "n", "ids", "vectors", "norm", "radius"])

        for batch in batches:
            ids = np.array([-1 if v is None else v for v in batch.column(0).to_pylist()], np.int64)
            known = ~np.asarray(batch.column(0).is_null())
            rows, x = quantized(batch.column(1), dim)
            ids, known = ids[rows], known[rows]
            ids, x = ids[known], x[known]
            if not len(ids):
                continue
            cell = ((pivots * pivots).sum(1)[None] - 2 * x.astype(float) @ pivots.T).argmin(1)
            for side, own in ((0, np.ones(len(ids), bool)), (1, ids % every == 0)):
                for c in np.unique(cell[own]):
                    at = np.flatnonzero(own & (cell == c))
                    for i in range(0, len(at), BLOCK):
                        part = at[i : i + BLOCK]
                        key = (side, int(c))
                        if size.get(key, 0) + len(part) > BLOCK:
                            yield flush(key)
                        held.setdefault(key, []).append((ids[part], x[part]))
                        size[key] = size.get(key, 0) + len(part)
            while sum(size.values()) > HELD:
                yield flush(max(size, key=size.get))
        for key in list(held):
            yield flush(key)

    return run


def _matrix(blob: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(blob, np.int16 if len(blob) == 2 * n * dim else np.int64).reshape(n, dim)


def floors(q: np.ndarray, q_ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """A score that the k-th neighbour of each query reaches: its k-th best among the sample, itself left out."""
    if len(sample) <= k:
        return np.full(len(q), NONE)
    s = products(q, sample)
    s[q_ids[:, None] == sample_ids[None]] = NONE
    return -np.partition(-s, k - 1, 1)[:, k - 1]


def reach(q: np.ndarray, pivot: np.ndarray, radius) -> np.ndarray:
    """What no score of a query with a vector that is within radius of the pivot exceeds; a little more, for rounding."""
    x = q.astype(float)
    top = x @ pivot + np.sqrt((x * x).sum(1)) * radius
    return top + 1e-9 * np.abs(top) + 1


def _needs(pivots, dim, radius, known, k):
    """(g, part, cell) of the data cells that some query of the block may have neighbours in."""

    def run(batches):
        sample, sample_ids = known.value
        for batch in batches:
            out = [[], [], []]
            for g, part, n, ids, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q = _matrix(blob, n, dim)
                low = floors(q, np.frombuffer(ids, np.int64), sample, sample_ids, k)
                for j in radius:
                    if (reach(q, pivots[j], radius[j]) >= low).any():
                        out[0].append(g)
                        out[1].append(part)
                        out[2].append(j)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in out], ["g", "part", "cell"])

    return run


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    a, b = np.abs(q).max(initial=0), np.abs(d).max(initial=0)
    if float(a) * float(b) * q.shape[1] < 2**53:
        return (q.astype(float) @ d.astype(float).T).astype(np.int64)
    return q.astype(np.int64) @ d.astype(np.int64).T


def best_of(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, n: int, k: int):
    """The k best (row, id, score) of each row: high scores first, then small ids; equal ones once."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    if len(rows):
        new = np.concatenate(([True], (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])))
        rows, ids, scores = rows[new], ids[new], scores[new]
    start = np.searchsorted(rows, np.arange(n))
    keep = np.arange(len(rows)) - start[rows] < k
    return rows[keep], ids[keep], scores[keep]


def _solve(pivots, dim, known, k):
    class State:
        def __init__(self, ids, x):
            self.ids, self.x = ids, x
            self.rows = self.found = self.scores = np.zeros(0, np.int64)
            self.floor = floors(x, ids, *known.value, k)

        def add(self, ids, x, pivot, radius):
            repeated = len(np.unique(ids)) < len(ids)  # an id with several vectors: its scores may be equal
            top = reach(self.x, pivot, radius)
            for i in range(0, len(self.ids), 512):
                part = slice(i, i + 512)
                open_ = np.flatnonzero(top[part] >= self.floor[part]) + i
                if not len(open_):
                    continue
                s = products(self.x[open_], x)
                s[self.ids[open_][:, None] == ids[None]] = NONE
                kth = -np.partition(-s, k - 1, 1)[:, k - 1] if s.shape[1] > k and not repeated else np.full(len(open_), NONE)
                r, c = np.nonzero((s >= np.maximum(kth, self.floor[open_])[:, None]) & (s > NONE))
                if not len(r):
                    continue
                # Columns ascend by id, so of equal scores in a block the first are the ones that count.
                r, c, v = best_of(r, ids[c], s[r, c], len(open_), k)
                old = np.isin(self.rows, open_)
                rows, found, scores = best_of(np.concatenate((self.rows[old], open_[r])), np.concatenate((self.found[old], c)), np.concatenate((self.scores[old], v)), len(self.ids), k)
                self.rows, self.found, self.scores = np.concatenate((self.rows[~old], rows)), np.concatenate((self.found[~old], found)), np.concatenate((self.scores[~old], scores))
                full = np.bincount(rows, minlength=len(self.ids)) == k
                last = np.searchsorted(rows, np.flatnonzero(full), "right") - 1
                self.floor[full] = np.maximum(self.floor[full], scores[last])

        def out(self):
            return pa.RecordBatch.from_arrays([pa.array(self.ids[self.rows]), pa.array(self.found), pa.array(self.scores)], ["query_id", "vec_id", "score"])

    def run(batches):
        group, state = None, None
        for batch in batches:
            for g, part, slab, side, cell, n, ids, blob, radius in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, x = np.frombuffer(ids, np.int64), _matrix(blob, n, dim)
                if (g, part, slab) != group:
                    if state is not None and len(state.rows):
                        yield state.out()
                    group, state = (g, part, slab), None
                    queries = []
                if side == 1:  # the queries come first; a query id on several rows of equal vectors is one query
                    queries.append((ids, x))
                elif queries:
                    if state is None:
                        state = State(np.concatenate([a for a, _ in queries]), np.concatenate([b for _, b in queries]))
                    state.add(ids, x, pivots[cell], radius)
        if state is not None and len(state.rows):
            yield state.out()

    return run


def top_k(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose vec_id is divisible by ``every`` (columns vec_id, embedding)."""
    spark = vectors.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "knn")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = vectors.where("embedding is not null and vec_id is not null")
    total = usable.count()
    share = int(1_000_000 * min(1, SAMPLE / max(1, total)))
    mark = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000))
    sample = usable.where(mark <= share).dropDuplicates(["vec_id"]).orderBy(F.xxhash64("vec_id")).limit(2 * SAMPLE).toPandas()
    sizes = [len(v) for v in sample.embedding if len(v)]
    if not sizes:
        return empty
    dim = max(set(sizes), key=lambda n: (sizes.count(n), -n))
    rows, x = quantized(pa.array(list(sample.embedding), pa.list_(pa.float64())), dim)
    sample_ids = sample.vec_id.to_numpy()[rows]
    p = choose_pivots(x if len(x) else np.zeros((1, dim), np.int64), int(min(max(total**0.5 / 8, PIVOTS[0]), PIVOTS[1])))
    known = spark.sparkContext.broadcast((x, sample_ids))  # at most 2 * SAMPLE vectors
    blocks = scratch.keep(vectors.mapInArrow(tidy(_pack(p, dim, every)), BLOCKS), "blocks")
    cells = blocks.groupBy("side", "cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()  # at most 2 * pivots
    data, asked = {r.cell: r for r in cells if r.side == 0}, {r.cell: r for r in cells if r.side == 1}
    scratch.at_exit()
    if not asked:
        return empty
    # Groups: whole query cells together up to GROUP queries, a larger cell in several parts.
    home: dict[int, int] = {}
    load, g = GROUP + 1, -1
    for i in sorted(asked):
        if load + asked[i].n > GROUP:
            g, load = g + 1, 0
        home[i] = g
        load += asked[i].n
    parts = {g: max(1, -(-sum(asked[i].n for i in asked if home[i] == g) // GROUP)) for g in set(home.values())}
    # A row for each pivot: tables of fixed size.
    to_query = spark.createDataFrame([(i, home[i], parts[home[i]]) for i in asked], "cell int, g int, parts int")
    sizes = spark.createDataFrame([(j, data[j].n) for j in data], "cell int, of_cell long")
    mine = blocks.where("side = 1").join(F.broadcast(to_query), "cell").withColumn("part", F.pmod(F.xxhash64("block", "ids"), F.col("parts")).cast("int")).drop("parts")
    need = mine.select("g", "part", "n", "ids", "vectors").mapInArrow(tidy(_needs(p, dim, {j: data[j].radius for j in data}, known, k)), "g int, part int, cell int").distinct()
    need = scratch.keep(need, "need")
    slabs = need.join(F.broadcast(sizes), "cell").groupBy("g", "part").agg(F.ceil(F.sum("of_cell") / SLAB).cast("int").alias("slabs"))
    mine = mine.join(slabs, ["g", "part"]).withColumn("slab", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)))
    theirs = blocks.where("side = 0").join(need.join(slabs, ["g", "part"]), "cell").withColumn("slab", F.pmod(F.xxhash64("block", "ids"), F.col("slabs")).cast("int"))
    both = mine.unionByName(theirs).repartition("g", "part", "slab").sortWithinPartitions("g", "part", "slab", F.desc("side"), F.desc("norm"), "ids")
    found = both.select("g", "part", "slab", "side", "cell", "n", "ids", "vectors", "radius").mapInArrow(tidy(_solve(p, dim, known, k)), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
