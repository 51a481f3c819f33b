"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Queries and candidates meet on a grid of cells: queries, packed in blocks, go to every stripe of candidates, and
candidates to every block row of queries, so that neither table is ever in the driver or in all tasks. In a cell the
queries come first and the candidates stream by. They are cut into blocks, and every
dimension of a block is sorted. A block is read from the ends of its lists inwards, in
rounds of growing depth; rows met are scored in full, and a query is done with the
block as soon as the best score any unmet row could have (each component at its
list's current end) is below the query's kth score so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
#: Queries of one row of cells; candidates of one stripe, and the most stripes; rows whose lists are held in memory at once.
QUERIES_PER_ROW = 32_768
ROWS_PER_STRIPE, MAX_STRIPES = 4_096, 4_096
ROWS_PER_BLOCK = 65_536
#: Queries that are sent as one row.
QUERIES_PER_PACK = 256
FIRST_DEPTH, DEPTH_GROWTH = 32, 8
_NO_ID = np.iinfo(np.int64).max
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (as doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~odd)


def _floors(values: np.ndarray) -> np.ndarray:
    """floor(256 x) of doubles, as doubles where all are below 2^53 and as Python integers else."""
    if np.abs(values).max(initial=0) < 2**53 / SCALE:
        return np.floor(values * SCALE)
    return np.array([math.floor(x * SCALE) if abs(x) < 2**53 else int(x) * SCALE for x in values.tolist()], dtype=object)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of each row, short rows padded with zeros, long ones cut to `width`."""
    sizes = column.value_lengths().to_numpy()
    values = _floors(column.flatten().to_numpy(zero_copy_only=False))
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(column), width), dtype=values.dtype)
    inside = place < width
    out[np.repeat(np.arange(len(column)), sizes)[inside], place[inside]] = values[inside]
    return out


def _kind(queries: np.ndarray, block: np.ndarray) -> type:
    """The type in which all inner products, and sums on the way to them, are exact."""
    largest = int(np.abs(queries).max(initial=0)) * int(np.abs(block).max(initial=0)) * max(1, block.shape[1])
    return np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else object


def _within(scores: np.ndarray) -> np.ndarray:
    """Scores that exceed a long put at the end of its range; only Python integers can."""
    return np.minimum(np.maximum(scores, _LEAST), _MOST) if scores.dtype == object else scores


class Search:
    """Running top k of a block of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.asked, self.k = ids, queries, k
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), _NO_ID)

    def offer(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Score `vectors` for the queries numbered `rows`."""
        for a in range(0, len(ids), 2048):
            part_ids, part = ids[a : a + 2048], vectors[a : a + 2048]
            for b in range(0, len(rows), 1024):
                some = rows[b : b + 1024]
                scores = _within(self.queries[some] @ part.T)
                scores[self.ids[some][:, None] == part_ids[None, :]] = -np.inf
                hit_q, hit_r = np.nonzero((scores >= self.scores[some, -1][:, None]) & (scores > -np.inf))
                cuts = np.searchsorted(hit_q, np.arange(len(some) + 1))
                for i in np.nonzero(np.diff(cuts))[0]:
                    at = hit_r[cuts[i] : cuts[i + 1]]
                    self._merge(some[i], scores[i, at], part_ids[at])

    def _merge(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[query], scores]), np.concatenate([self.found[query], ids])
        if scores.dtype == object:
            order = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])))
        else:
            order = np.lexsort((ids, -scores))
        scores, ids = scores[order], ids[order]
        if len(np.unique(ids)) < len(ids):  # an id counts once, with its best score
            first = np.zeros(len(ids), dtype=bool)
            first[np.unique(ids, return_index=True)[1]] = True
            keep = np.nonzero(first | (ids == _NO_ID))[0][: self.k]
        else:
            keep = slice(self.k)
        self.scores[query], self.found[query] = scores[keep], ids[keep]

    def search(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """The threshold algorithm over one block, in a type that is exact for it."""
        kind = _kind(self.asked, vectors)
        self.queries, vectors = self.asked.astype(kind), vectors.astype(kind)
        if kind is object:
            self.scores = self.scores.astype(object)
        lists = np.argsort(vectors, axis=0, kind="stable")
        ordered = np.take_along_axis(vectors, lists, axis=0)
        n, depth = len(ids), 0
        unmet = np.ones(n, dtype=bool)
        up, down = np.maximum(self.queries, 0), np.minimum(self.queries, 0)
        active = np.arange(len(self.ids))
        while True:
            bound = _within(up[active] @ ordered[n - 1 - depth] + down[active] @ ordered[depth])
            active = active[self.scores[active, -1] <= bound]  # an equal score may still win by its id
            if not len(active):
                return
            deeper = min(max(FIRST_DEPTH, depth * DEPTH_GROWTH), n)
            met = np.unique(np.concatenate([lists[depth:deeper].ravel(), lists[n - deeper : n - depth].ravel()]))
            met = met[unmet[met]]
            unmet[met] = False
            self.offer(active, ids[met], vectors[met])
            depth = deeper
            if depth >= n or not unmet.any():
                return


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query row.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows of
    another vec_id. Vectors that are null or hold null, NaN or infinite components
    take no part, nor do rows without an id; of vectors of different lengths the shorter
    ones count as padded with zeros. Rows that repeat an id count once, with their best score. Ties go to
    the smaller vec_id. Scores are exact, however large; one beyond the range of a long counts as the end of that range.
    No query or no candidate: no row. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = _valid(vectors)
    asked = F.col("vec_id") % every == 0
    shape = rows.agg(F.count("*"), F.count_if(asked), F.max(F.when(asked, F.size("embedding")))).first()
    if not shape[1]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    stripes = min(MAX_STRIPES, -(-shape[0] // ROWS_PER_STRIPE))
    across = -(-shape[1] // QUERIES_PER_ROW)
    width = max(1, shape[2])

    packed = rows.where(asked).mapInArrow(_packer(width), "ids binary, queries binary")
    to_rows = F.pmod(F.xxhash64("ids"), F.lit(across)).alias("across")
    to_stripes = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))).alias("stripe")
    queries = packed.select(to_rows, to_stripes, F.lit(0).cast("long").alias("kind"), "ids", "queries", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("embedding"))
    # Rows are dealt one by one, so that no id and no vector, however frequent, makes a stripe larger.
    dealt = rows.select("*", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(stripes)).alias("stripe"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))) if across > 1 else F.lit(0).cast("long")
    none = F.lit(None).cast("binary")
    candidates = dealt.select(copies.alias("across"), "stripe", F.lit(1).cast("long").alias("kind"), none.alias("ids"), none.alias("queries"), "vec_id", "embedding")
    cells = queries.unionByName(candidates).repartition("across", "stripe").sortWithinPartitions("across", "stripe", "kind")
    found = cells.mapInArrow(_searcher(width, k), "query_id long, vec_id long, score long")
    # Only repeated ids come twice for a query, and each cell has sent k rows a query at most.
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )


def _packer(width: int):
    """Queries in packs: their ids, and their components as doubles, which all inputs are."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), QUERIES_PER_PACK):
                part = batch.slice(start, QUERIES_PER_PACK)
                vectors = np.zeros((len(part), width))
                for i, v in enumerate(part.column("embedding").to_pylist()):
                    vectors[i, : len(v)] = v
                ids = part.column("vec_id").to_numpy()
                columns = [pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "queries"])

    return pack


def _searcher(width: int, k: int):
    """Reducer over cells, one after the other: packs of queries first, then candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, packs, held, state = None, [], [], None

        def look() -> None:
            nonlocal held, state
            ids, block = np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held])
            held = []
            if state is None:
                query_ids = np.concatenate([np.frombuffer(i, np.int64) for i, _ in packs])
                values = np.concatenate([np.frombuffer(q) for _, q in packs])
                state = Search(query_ids, _floors(values).reshape(len(query_ids), width), k)
            state.search(ids, block)

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal packs, state
            if held and packs:
                look()
            if state is not None:
                real = state.found != _NO_ID
                query = np.repeat(state.ids, k).reshape(real.shape)[real]
                scores = list(map(int, state.scores[real]))
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(state.found[real]), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])
            packs, state = [], None
            held.clear()

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("across", "stripe", "kind")])
            cuts = [0, *(np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1).tolist(), len(batch)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if start == stop:
                    continue
                if tuple(keys[:2, start]) != cell:
                    yield from done()
                    cell = tuple(keys[:2, start])
                part = batch.slice(start, stop - start)
                if keys[2, start] == 0:
                    packs += zip(part.column("ids").to_pylist(), part.column("queries").to_pylist(), strict=True)
                elif packs:
                    held.append((part.column("vec_id").to_numpy(), _matrix(part.column("embedding"), width)))
                    if sum(len(i) for i, _ in held) >= ROWS_PER_BLOCK:
                        look()
        yield from done()

    return run
