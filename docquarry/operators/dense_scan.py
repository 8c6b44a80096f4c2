"""The exhaustive scan: every question against every item of its scope, without a table of all pairs.

Vectors of items stream through as Arrow batches; each batch is one matrix product with a block of questions. Products are
made in single precision and only tell which items may be among the nearest: those are measured in double precision. A task
keeps the nearest items so far of each question and hands them over once, at its end: what is shuffled grows with tasks times
questions, not with items times questions. Questions travel in blocks of BLOCK rows, so what a task holds has a fixed size;
where there are many blocks, each is scanned in fewer tasks.

Count, mean and spread of a question's scores need no pair: scores are linear in the items' unit vectors, so their mean and
their matrix of squared deviations, summed in one pass for each scope, give them for any question.

A question may have a scope, a set of documents that it is asked of. Each distinct scope of a block is a bit of the
documents in it, and a scope's questions meet its items alone. A question without a scope is asked of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Questions to a block: a block of vectors is broadcast, so this bounds what is sent. More questions make more scans.
BLOCK = 16_384
#: Items and questions to a matrix product, and scopes whose moments are summed in one pass.
STEP, TILE, SCOPES = 2_048, 1_024, 256
#: What products of unit vectors in single precision are off by at most.
MARGIN = 2e-5


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _scoped(questions: DataFrame) -> DataFrame:
    return questions if "scope" in questions.columns else questions.withColumn("scope", F.lit(None).cast("string"))


def _blocks(questions: DataFrame) -> Iterator[tuple[list, np.ndarray, np.ndarray, list]]:
    """(ids, vectors, norms, scopes) of at most BLOCK questions at a time, in the order of their ids."""
    held: list = []

    def block() -> tuple[list, np.ndarray, np.ndarray, list]:
        return [r[0] for r in held], np.array([r[1] for r in held], np.float64), np.sqrt(np.array([r[2] for r in held], np.float64)), [r[3] for r in held]

    for row in _scoped(questions).select("qid", "qv", "qnorm2", "scope").orderBy("qid").toLocalIterator():
        held.append(row)
        if len(held) == BLOCK:
            yield block()
            held = []
    if held:
        yield block()


def few_tasks(items: DataFrame, blocks: int) -> DataFrame:
    """items in so few partitions that all blocks together make some four tasks a core: fewer tasks hand over fewer rows."""
    return items.coalesce(max(1, -(-4 * items.sparkSession.sparkContext.defaultParallelism // blocks))) if blocks > 1 else items


def _with_bits(items: DataFrame, scopes: list, members: DataFrame | None, columns: tuple[str, ...] = ("v", "norm2")) -> DataFrame:
    """items with bits: the numbers, from 1, of those of the scopes (at most BLOCK) that hold the item's document."""
    if not scopes or members is None:
        return items.select("doc_id", "idx", *columns, F.lit(None).cast("array<int>").alias("bits"))
    numbered = items.sparkSession.createDataFrame([(s, n + 1) for n, s in enumerate(scopes)], "scope string, bit int")
    of_docs = members.join(F.broadcast(numbered), "scope").groupBy("doc_id").agg(F.collect_set("bit").alias("bits"))
    return items.join(of_docs, "doc_id", "left").select("doc_id", "idx", *columns, "bits")


def by_scope(scope: np.ndarray) -> list[tuple[int, int, int]]:
    """(scope, first, end) of the runs of a sorted array of scopes' numbers."""
    heads = np.flatnonzero(np.append(True, scope[1:] != scope[:-1])[: len(scope)])
    return list(zip(scope[heads].tolist(), heads.tolist(), np.append(heads[1:], len(scope)).tolist(), strict=True))


def held_by(bits: pa.Array) -> dict[int, np.ndarray]:
    """For each scope's number the rows that it holds, in order."""
    number, row = bits.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(bits)), bits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    order = np.argsort(number, kind="stable")
    number, row = number[order], row[order]
    return {s: row[a:b] for s, a, b in by_scope(number)}


class _Nearest:
    """The nearest items so far of each of a block's questions; of equal ones at the edge maybe more than k, up to WIDE times k."""

    WIDE = 8

    def __init__(self, q: np.ndarray, norm: np.ndarray, k: int) -> None:
        self.q, self.norm, self.k = q, norm, k
        self.unit = (q / norm[:, None]).astype(np.float32)
        self.least = np.full(len(q), -np.inf, np.float32)
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.fresh = 0

    def take(self, first: int, end: int, v: np.ndarray, lengths: np.ndarray, doc_id: np.ndarray, idx: np.ndarray) -> None:
        """Items that are asked by the questions from first to end."""
        unit = (v / lengths[:, None]).astype(np.float32).T
        for at in range(first, end, TILE):
            to = min(at + TILE, end)
            near, least = self.unit[at:to] @ unit, self.least[at:to]
            void = np.isinf(least)
            if void.any() and near.shape[1] > self.k:  # the items at hand tell what is too far
                least = least.copy()
                least[void] = np.partition(near[void], -self.k, axis=1)[:, -self.k] - 2 * MARGIN
            row, column = np.divmod(np.flatnonzero(near >= least[:, None]), near.shape[1])
            row += at
            for a in range(0, len(row), 1 << 16):
                r, c = row[a : a + (1 << 16)], column[a : a + (1 << 16)]
                self.kept.append((r, np.einsum("ij,ij->i", self.q[r], v[c]) / (self.norm[r] * lengths[c]), doc_id[c], idx[c]))
                self.fresh += len(r)
                if 2 * self.fresh > 3 * self.k * max(len(self.q), TILE):
                    self.prune()

    def prune(self) -> None:
        row, score, doc_id, idx = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        order = np.argsort(row.astype(np.int16) if len(self.q) < 1 << 15 else row, kind="stable")
        row, score, doc_id, idx = row[order], score[order], doc_id[order], idx[order]
        counts = np.bincount(row, minlength=len(self.q))
        if counts.max(initial=0) > self.WIDE * self.k:  # many equal ones: the first of them by id
            order = np.lexsort((idx, doc_id, -score, row))
            order = order[np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) < self.k]
            row, score, doc_id, idx = row[order], score[order], doc_id[order], idx[order]
            counts = np.bincount(row, minlength=len(self.q))
        full = np.flatnonzero(counts >= self.k)
        if len(full):
            seat = np.full(len(self.q), -1)
            seat[full] = np.arange(len(full))
            mine = seat[row] >= 0
            laid = np.full((len(full), counts.max()), -np.inf)
            laid[seat[row[mine]], (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts))[mine]] = score[mine]
            edge = np.full(len(self.q), -np.inf)
            edge[full] = np.partition(laid, laid.shape[1] - self.k, axis=1)[:, laid.shape[1] - self.k]
            self.least = (edge - MARGIN).astype(np.float32)
            keep = score >= edge[row]
            row, score, doc_id, idx = row[keep], score[keep], doc_id[keep], idx[keep]
        self.kept, self.fresh = [(row, score, doc_id, idx)], 0


def top_dense(items: DataFrame, questions: DataFrame, k: int, members: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, idx, dense, r): the k nearest items of each question, ties by doc_id and idx.

    members(scope, doc_id) says which documents a scope holds; a question whose scope holds none has no row.
    """
    spark = items.sparkSession
    schema = "qid long, doc_id long, idx int, dense double"
    blocks = list(_blocks(questions))
    out = None
    for ids, vectors, norms, scopes in blocks:
        distinct = sorted({s for s in scopes if s is not None})
        number = {s: n + 1 for n, s in enumerate(distinct)}
        scope = np.array([number.get(s, 0) for s in scopes])
        order = np.argsort(scope, kind="stable")
        sent = spark.sparkContext.broadcast((np.asarray(ids)[order], vectors[order], norms[order], by_scope(scope[order])))

        def batches(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, q, norm, groups = sent.value
            nearest = _Nearest(q, norm, k)
            for part in parts:
                for at in range(0, part.num_rows, STEP):
                    some = part.slice(at, STEP)
                    v, lengths = _matrix(some.column(2)), np.sqrt(some.column(3).to_numpy(zero_copy_only=False).astype(np.float64))
                    doc_id, idx = (some.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                    inside = held_by(some.column(4)) if groups[-1][0] else {}
                    for s, first, end in groups:
                        if s == 0:
                            nearest.take(first, end, v, lengths, doc_id, idx)
                        elif s in inside:
                            nearest.take(first, end, *(x[inside[s]] for x in (v, lengths, doc_id, idx)))
            if nearest.kept:
                nearest.prune()
                row, score, doc_id, idx = nearest.kept[0]
                for at in range(0, len(row), 1 << 18):
                    cut = slice(at, at + (1 << 18))
                    yield pa.record_batch([pa.array(c) for c in (qid[row[cut]], doc_id[cut], idx[cut].astype(np.int32), score[cut])], ["qid", "doc_id", "idx", "dense"])

        found = few_tasks(_with_bits(items, distinct, members), len(blocks)).mapInArrow(batches, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    ranked = out.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("dense").desc(), "doc_id", "idx")))
    return ranked.where(F.col("r") <= k)


def _merged(a: tuple | None, b: tuple) -> tuple:
    """Count, mean and sum of the products of deviations of two sets of vectors together."""
    if a is None:
        return b
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _moments(items: DataFrame, scopes: list, members: DataFrame | None) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, mean and sum of the products of deviations of the unit vectors of each scope (by number) and of all (0)."""
    schema = "scope int, n long, mean binary, products binary"
    laid = lambda s, m: pa.record_batch([pa.array([s], pa.int32()), pa.array([m[0]], pa.int64()), pa.array([m[1].tobytes()], pa.binary()), pa.array([m[2].tobytes()], pa.binary())], ["scope", "n", "mean", "products"])

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for part in parts:
            for at in range(0, part.num_rows, STEP):
                some = part.slice(at, STEP)
                unit = _matrix(some.column(2)) / np.sqrt(some.column(3).to_numpy(zero_copy_only=False).astype(np.float64))[:, None]
                for s, rows in [(0, slice(None)), *(held_by(some.column(4)).items() if scopes else ())]:
                    mean = unit[rows].mean(axis=0)
                    off = unit[rows] - mean
                    held[s] = _merged(held.get(s), (len(off), mean, off.T @ off))
        for s, m in held.items():
            yield laid(s, m)

    def read(batches: Iterator) -> dict[int, tuple]:
        held: dict[int, tuple] = {}
        for s, n, mean, products in batches:
            mean = np.frombuffer(mean, np.float64)
            held[s] = _merged(held.get(s), (n, mean, np.frombuffer(products, np.float64).reshape(len(mean), -1)))
        return held

    def summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, m in read(row for part in parts for row in zip(*(c.to_pylist() for c in part.columns), strict=True)).items():
            yield laid(s, m)

    return read(_with_bits(items, scopes, members).mapInArrow(partial, schema).repartition("scope").mapInArrow(summed, schema).toLocalIterator())


def spread(items: DataFrame, questions: DataFrame, k: int, members: DataFrame | None = None, nearest: DataFrame | None = None) -> DataFrame:
    """(qid, n_items, top, z): how far the best score of a question stands out among those of its scope; z is null under
    10 items or without spread. nearest is what top_dense gives, if it was made already.

    Deviations are taken from the means of batches and merged, which doesn't lose digits as sums of squares would.
    """
    questions = _scoped(questions)
    spark = items.sparkSession
    named = sorted(r[0] for r in questions.select("scope").distinct().where("scope IS NOT NULL").collect())
    schema = "qid long, n_items long, mid double, deviation double"
    out = None
    for at in range(0, max(len(named), 1), SCOPES):
        scopes = named[at : at + SCOPES]
        sent = spark.sparkContext.broadcast(({s: n + 1 for n, s in enumerate(scopes)} | ({None: 0} if at == 0 else {}), _moments(items, scopes, members)))

        def batches(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            number, moments = sent.value
            for part in parts:
                scope = np.array([number.get(s, -1) for s in part.column(3).to_pylist()])
                for s in np.unique(scope[scope >= 0]).tolist():
                    if s in moments:
                        rows = np.flatnonzero(scope == s)
                        some = part.take(pa.array(rows))
                        n, mean, products = moments[s]
                        unit = _matrix(some.column(1)) / np.sqrt(some.column(2).to_numpy(zero_copy_only=False).astype(np.float64))[:, None]
                        deviation = np.sqrt(np.maximum(np.einsum("ij,ij->i", unit @ products, unit), 0) / n)
                        yield pa.record_batch([some.column(0), pa.array(np.full(len(rows), n)), pa.array(unit @ mean), pa.array(deviation)], ["qid", "n_items", "mid", "deviation"])

        found = questions.select(F.col("qid").cast("long").alias("qid"), "qv", "qnorm2", "scope").mapInArrow(batches, schema)
        out = found if out is None else out.unionByName(found)
    best = (top_dense(items, questions, 1, members) if nearest is None else nearest).where("r = 1").select("qid", F.col("dense").alias("top"))
    z = F.when((F.col("n_items") >= 10) & (F.col("deviation") > 1e-6), (F.col("top") - F.col("mid")) / F.col("deviation"))
    return out.join(best, "qid").select("qid", "n_items", "top", z.alias("z"))
