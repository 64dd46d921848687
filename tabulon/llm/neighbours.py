"""Approximate nearest neighbours by inner product.

Vectors get one more component that makes all as long as the longest, so that the largest inner product is the smallest
distance. Gaussian projections to a few dimensions are stable: the squared projected distance over the squared distance
follows a chi-square law. The projections are cut into cells by a kd-tree whose upper part is fitted on a bounded sample
and deals all vectors over tasks; each task goes on cutting its own. Candidates come by rising projected distance, a box
of the tree at a time, and are verified on the original vectors, until a chi-square test says that a nearer one would
have been projected this far off only with small probability.

A query is first searched in the cell that it lies in. The distance of the k-th neighbour found there is then put to the
test for every other cell, and the query goes on only to those that could hold a nearer one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import small_batches, stored, tidy, work_dir

LEAF = 128
DIMENSIONS = 8
#: The most cells of the upper tree, whose boxes every task gets, and the rows that it is fitted on.
CELLS, SAMPLE = 4_096, 50_000
#: More candidates are carried than asked for, so that sums in another order can't cost one of them.
SPARE = 8


def chi_square_below(x: np.ndarray) -> np.ndarray:
    """Distribution function of the chi-square law with DIMENSIONS (an even number of) degrees of freedom."""
    half = np.minimum(x / 2, 700.0)
    term = total = np.ones_like(half)
    for i in range(1, DIMENSIONS // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def projected(vectors: np.ndarray, longest: float, asking: bool = False) -> np.ndarray:
    """Projections of the lengthened vectors; a query's extra component is 0."""
    extra = np.zeros(len(vectors)) if asking else np.sqrt(np.maximum(0, longest - (vectors * vectors).sum(axis=1)))
    drawn = np.random.default_rng(9).standard_normal((vectors.shape[1] + 1, DIMENSIONS))
    return np.column_stack([vectors, extra]) @ drawn


def away(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        out += np.maximum(0, np.maximum(low[:, d] - points[:, d, None], points[:, d, None] - high[:, d])) ** 2
    return out


@dataclass
class Cells:
    """The upper kd-tree of one dimension: node i has the children 2 i + 1 and 2 i + 2."""

    axis: np.ndarray
    cut: np.ndarray
    levels: int

    @classmethod
    def fitted(cls, points: np.ndarray, wanted: int) -> Cells:
        levels = min(int(np.ceil(np.log2(max(1, wanted)))), int(np.log2(max(1, len(points)))))
        axis, cut, own = np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1), {0: points}
        for i in range(len(axis)):
            held = own.pop(i)
            axis[i] = int(np.argmax(held.max(axis=0) - held.min(axis=0))) if len(held) else 0
            cut[i] = np.median(held[:, axis[i]]) if len(held) else 0.0
            left = held[:, axis[i]] <= cut[i]
            own[2 * i + 1], own[2 * i + 2] = held[left], held[~left]
        return cls(axis, cut, levels)

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        for _ in range(self.levels):
            at = 2 * at + 1 + (points[np.arange(len(points)), self.axis[at]] > self.cut[at])
        return at - len(self.axis)


class Tree:
    """A block of vectors under a kd-tree over their projections; equal vectors are one point."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        self.longest = longest
        _, first, copy_of = np.unique(vectors.view([("", vectors.dtype)] * vectors.shape[1]).ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((ids, copy_of))
        starts = np.searchsorted(copy_of[order], np.arange(len(first) + 1))
        self.copies, points = ids[order], vectors[first]
        at, parts, stack = projected(points, longest), [], [np.arange(len(points))]
        while stack:
            own = stack.pop()
            if len(own) <= LEAF:
                parts.append(own)
                continue
            held = at[own]
            axis, middle = int(np.argmax(held.max(axis=0) - held.min(axis=0))), len(own) // 2
            split = np.argpartition(held[:, axis], middle)
            stack += [own[split[:middle]], own[split[middle:]]]
        self.low, self.high = np.array([at[x].min(axis=0) for x in parts]), np.array([at[x].max(axis=0) for x in parts])
        order = np.concatenate(parts)
        self.points, self.starts, self.ends = points[order], starts[order], starts[order + 1]
        self.smallest = self.copies[self.starts]
        self.leaf = np.cumsum([0, *map(len, parts)])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int, sure: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, vec_ids, scores) of the nearest found for each query; bound: a score that k others reach, or -inf."""
        least = away(projected(queries, self.longest, asking=True), self.low, self.high)
        order = np.argsort(least, axis=1, kind="stable")
        rank = np.argsort(order, axis=1, kind="stable")
        length = (queries * queries).sum(axis=1) + self.longest
        width = k + 1 + SPARE
        best, scores = np.full((len(queries), width), -1), np.full((len(queries), width), -np.inf)
        active, done, step = np.ones(len(queries), bool), 0, 2
        while active.any() and done < len(self.low):
            for leaf in range(len(self.low)):
                asked = np.flatnonzero(active & (rank[:, leaf] >= done) & (rank[:, leaf] < done + step))
                if not len(asked):
                    continue
                first, last = self.leaf[leaf], self.leaf[leaf + 1]
                found = queries[asked] @ self.points[first:last].T
                better = (found >= np.maximum(scores[asked, -1], bound[asked] - 1e-9 * length[asked])[:, None]).any(axis=1)
                if better.any():
                    mine = asked[better]
                    names = np.concatenate([best[mine], np.broadcast_to(np.arange(first, last), (len(mine), last - first))], axis=1)
                    values = np.concatenate([scores[mine], found[better]], axis=1)
                    top = np.lexsort((np.where(names < 0, np.iinfo(np.int64).max, self.smallest[names]), -values), axis=1)[:, :width]
                    best[mine], scores[mine] = np.take_along_axis(names, top, axis=1), np.take_along_axis(values, top, axis=1)
            done, step = done + step, step * 2
            if done < len(self.low):
                nearest = np.take_along_axis(least, order[:, done : done + 1], axis=1)[:, 0]
                kth = np.maximum(scores[:, k], bound)
                distance = np.maximum(length - 2 * kth, 1e-300)
                active &= ~((kth > -np.inf) & (chi_square_below(nearest / distance) >= sure))
        for query_id, query, own in zip(query_ids.tolist(), queries, best):
            # Of copies, the k + 1 with the smallest ids can be among the nearest, of which one may be the query itself.
            own = own[own >= 0]
            names = [self.copies[self.starts[p] : min(self.ends[p], self.starts[p] + k + 1)] for p in own]
            if names:
                score = np.repeat((self.points[own] * query).sum(axis=1), [len(n) for n in names])
                found = np.concatenate(names)
                score, found = score[found != query_id], found[found != query_id]
                top = np.lexsort((found, -score))[:k]
                yield query_id, found[top], score[top]


def usable(vectors: DataFrame) -> DataFrame:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    return rows.where(F.coalesce(F.forall("v", finite), F.lit(False))).where(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def runs_of(dims: np.ndarray) -> list[np.ndarray]:
    return [np.flatnonzero(dims == d) for d in np.unique(dims)]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, sure: float = 0.9, block: int = 8_192, query_batch: int = 512, most_queries: int = 65_536) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found to each row whose vec_id is divisible by ``every``.

    A cell holds about ``block`` vectors, or where the upper tree has its most cells and they hold more, several blocks.
    A task takes one block and streams the queries that go there through it, ``query_batch`` at a time; where more than
    ``most_queries`` go to a block, several tasks take it. ``sure`` is the probability of the stopping test.

    Vectors null, empty, zero, or with a null or non-finite component take no part, nor does a null vec_id. Vectors are
    compared with those of their own dimension. Ties go to the smaller vec_id; the rows of one vec_id are never each
    other's neighbours, and a vec_id with two vectors asks once for each of them, and answers once, with the nearer. An
    empty table gives no rows; other columns, whatever their names, are ignored.
    """
    spark = vectors.sparkSession
    path = work_dir(spark, "nearest")
    small_batches(spark)
    rows = usable(vectors)
    asks_too = F.col("vec_id") % every == 0
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sizes = stored(rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(asks_too).alias("nq"), F.max(squared).alias("longest")).where("nq > 0"), f"{path}/sizes")
    n_rows = sizes.agg(F.sum("n")).first()[0] or 0
    known = {r["dim"]: r for r in sizes.orderBy(F.desc("n")).limit(CELLS).collect()}
    # Dimensions beyond the most that are told apart here are one cell each, and those are searched whole.
    fit = rows.join(F.broadcast(sizes.orderBy(F.desc("n")).limit(CELLS).select("dim")), "dim", "left_semi")
    fit = fit.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1_000_003)) < SAMPLE / max(SAMPLE, n_rows) * 1_000_003).limit(2 * SAMPLE).select("dim", "v").toArrow().combine_chunks()
    trees: dict[int, Cells] = {}
    sampled = fit.column("dim").to_numpy()
    for dim, r in known.items():
        own = fit.filter(pa.array(sampled == dim)).column("v")
        points = projected(np.array(own.to_pylist(), float), r["longest"]) if len(own) else np.zeros((0, DIMENSIONS))
        trees[dim] = Cells.fitted(points, min(CELLS, -(-r["n"] // block)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column(1).to_numpy(), np.zeros(batch.num_rows, np.int64)
            home, at = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, DIMENSIONS))
            for own in runs_of(dims):
                dim = int(dims[own[0]])
                held = matrix(batch.column(2).take(pa.array(own)), dim)
                at[own] = projected(held, batch.column(3)[int(own[0])].as_py())
                if dim in trees:
                    cell[own], home[own] = trees[dim].of(at[own]), trees[dim].of(projected(held, 0.0, asking=True))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(at.ravel()), DIMENSIONS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(home), lists], names=["vec_id", "dim", "v", "longest", "cell", "home", "at"])

    placed = rows.join(sizes.select("dim", "longest"), "dim").select("vec_id", "dim", "v", "longest")
    placed = stored(placed.mapInArrow(tidy(place), "vec_id long, dim int, v array<double>, longest double, cell long, home long, at array<double>"), f"{path}/placed")
    corners = [f(F.col("at")[d]).alias(f"{f.__name__}{d}") for f in (F.min, F.max) for d in range(DIMENSIONS)]
    boxes = stored(placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).alias("n_blocks"), *corners), f"{path}/boxes")
    each_box: dict[int, np.ndarray] = {}
    for r in boxes.join(sizes.orderBy(F.desc("n")).limit(CELLS).select("dim"), "dim", "left_semi").collect():  # CELLS rows of a dimension at most
        each_box.setdefault(r["dim"], []).append([r["cell"], *[r[f"{f}{d}"] for f in ("min", "max") for d in range(DIMENSIONS)]])
    each_box = {dim: np.array(b, float) for dim, b in each_box.items()}
    data = placed.join(boxes.select("dim", "cell", "n_blocks"), ["dim", "cell"]).withColumn("b", F.pmod(F.xxhash64("vec_id"), "n_blocks"))
    data = data.select("dim", "cell", "b", "vec_id", "v", "longest", F.lit(0.0).alias("bound"))
    queries = placed.where(asks_too).select("dim", F.col("home").alias("cell"), "vec_id", "v", "longest", F.lit(float("-inf")).alias("bound"))

    def search(asked: DataFrame, name: str) -> DataFrame:
        """(query_id, vec_id, score) of the queries in the blocks of their cells."""
        asked = asked.join(boxes.select("dim", "cell", "n_blocks"), ["dim", "cell"])
        asked = asked.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))).drop("n_blocks")
        asked = stored(asked, f"{path}/{name}-asked")
        tasks = stored(asked.groupBy("dim", "cell", "b").agg(F.ceil(F.count("*") / most_queries).alias("n_tasks")), f"{path}/{name}-tasks")
        here = ["dim", "cell", "b"]
        held = data.join(tasks, here).withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tasks") - 1))).withColumn("asks", F.lit(False))
        going = asked.join(tasks, here).withColumn("task", F.pmod(F.xxhash64("vec_id"), "n_tasks")).withColumn("asks", F.lit(True))
        columns = [*here, "task", "asks", "vec_id", "v", "longest", "bound"]
        both = held.select(columns).unionByName(going.select(columns)).repartition(*here, "task").sortWithinPartitions(*here, "task", "asks")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, tree = None, [], None
            for batch in batches:
                keys = np.column_stack([batch.column(c).to_numpy() for c in range(4)])
                asks = batch.column(4).to_numpy(zero_copy_only=False)
                breaks = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (asks[1:] != asks[:-1])) + 1
                for low, high in zip([0, *breaks.tolist()], [*breaks.tolist(), len(keys)]):
                    part = batch.slice(low, high - low)
                    if tuple(keys[low]) != key:
                        key, held, tree = tuple(keys[low]), [], None
                    ids, vectors = part.column(5).to_numpy(), matrix(part.column(6), int(key[0]))
                    if not asks[low]:
                        held.append((ids, vectors))
                        continue
                    if held:
                        tree = Tree(*(np.concatenate(x) for x in zip(*held)), part.column(7)[0].as_py())
                        held = []
                    for at in range(0, len(ids) if tree else 0, query_batch):
                        own = slice(at, at + query_batch)
                        out = list(tree.search(ids[own], vectors[own], part.column(8).to_numpy()[own], k, sure))
                        if out:
                            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([np.full(len(i), q) for q, i, _ in out], [i for _, i, _ in out], [s for *_, s in out])], names=["query_id", "vec_id", "score"])

        return both.mapInArrow(tidy(run), "query_id long, vec_id long, score double")

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every cell but its home that the test doesn't rule out."""
        for batch in batches:
            dims, home, bound = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(5).to_numpy()
            for every_own in runs_of(dims):
                dim = int(dims[every_own[0]])
                if dim not in each_box:
                    continue
                table = each_box[dim]
                for start in range(0, len(every_own), 256):
                    own = every_own[start : start + 256]
                    held = matrix(batch.column(3).take(pa.array(own)), dim)
                    least = away(projected(held, 0.0, asking=True), table[:, 1 : 1 + DIMENSIONS], table[:, 1 + DIMENSIONS :])
                    distance = np.maximum((held * held).sum(axis=1) + batch.column(4)[int(own[0])].as_py() - 2 * bound[own], 1e-300)
                    going = (chi_square_below(least / distance[:, None]) < sure) & (table[:, 0] != home[own, None])
                    query, cell = np.nonzero(going)
                    out = batch.take(pa.array(own[query]))
                    yield pa.RecordBatch.from_arrays([out.column(0), pa.array(table[cell, 0].astype(np.int64)), *out.columns[2:]], names=batch.schema.names)

    at_home = stored(search(queries, "home"), f"{path}/home")
    # The k-th best score at home, if there are k: none nearer than that is looked for elsewhere.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = at_home.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    kth = pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    bounded = queries.join(kth, "vec_id", "left").select("dim", "cell", "vec_id", "v", "longest", F.coalesce("kth", "bound").alias("bound"))
    schema = "dim int, cell long, vec_id long, v array<double>, longest double, bound double"
    further = search(bounded.mapInArrow(tidy(elsewhere), schema), "further")
    found = at_home.unionByName(further).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
