"""Trained vectors: the leading directions of the weighted item-word matrix, by a randomised range finder.

The matrix (items by words, hashed into BUCKETS columns) is never built. One pass takes a block of directions Q, broadcast
with a fixed size, and returns the product of the matrix's transpose with the matrix with Q, summed over all items in
blocks of columns. Between passes the block is made orthonormal on the driver, which holds BUCKETS * (RANK + MORE) numbers
however many items there are. A last product with the block gives the small matrix whose eigenvectors turn it into the
leading directions. Items and questions are folded in by the same product, so a question that was never seen has a vector.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, RANK, MORE, PASSES = 1 << 14, 64, 16, 2
#: Items to a product, columns to a summed block, and the length of a unit vector in whole numbers.
STEP, COLUMNS, UNIT = 4_096, 512, 10_000
#: Entries whose rows of a block of directions are gathered at a time.
PIECE = 1_024


def _rows(words: pa.Array, idf: np.ndarray | None, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, weight) of the entries of a batch, rows of length one; in order of rows."""
    coded = words.flatten().dictionary_encode()
    hashed = np.array([zlib.crc32((w or "").encode()) % buckets for w in coded.dictionary.to_pylist()], np.int64)
    row = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    column = hashed[coded.indices.to_numpy(zero_copy_only=False)] if len(hashed) else np.zeros(0, np.int64)
    weight = np.ones(len(column)) if idf is None else idf[column]
    norm = np.sqrt(np.bincount(row, weight**2, len(words)))
    return row, column, weight / np.maximum(norm[row], 1e-12)


def _sums(items: DataFrame, column: str, width: int, buckets: int, part, *shared: np.ndarray | None) -> np.ndarray:
    """The sum over all batches of what part(words, sum, *shared) adds, a matrix of buckets rows; summed in blocks of rows, in tasks."""
    sent = items.sparkSession.sparkContext.broadcast(shared)

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in parts:
            for at in range(0, batch.num_rows, STEP):
                total = np.zeros((buckets, width)) if total is None else total
                part(batch.column(0).slice(at, STEP), total, *sent.value)
        for at in range(0, buckets if total is not None else 0, COLUMNS):
            if total[at : at + COLUMNS].any():
                yield pa.record_batch([pa.array([at], pa.int32()), pa.array([total[at : at + COLUMNS].tobytes()], pa.binary())], ["at", "data"])

    def summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in parts:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(data, np.float64)
                held[at] = held[at] + more if at in held else more
        for at, data in held.items():
            yield pa.record_batch([pa.array([at], pa.int32()), pa.array([data.tobytes()], pa.binary())], ["at", "data"])

    schema = "at int, data binary"
    out = np.zeros((buckets, width))
    for row in items.select(column).mapInArrow(partial, schema).repartition("at").mapInArrow(summed, schema).toLocalIterator():
        out[row["at"] : row["at"] + COLUMNS] = np.frombuffer(row["data"], np.float64).reshape(-1, width)
    return out


def _counted(words: pa.Array, out: np.ndarray, buckets: int) -> None:
    row, column, _ = _rows(words, None, buckets)
    pairs = np.unique(row * buckets + column)
    out[:, 0] += np.bincount(pairs % buckets, minlength=buckets)


def _squared(words: pa.Array, out: np.ndarray, idf: np.ndarray, q: np.ndarray) -> None:
    """Adds the transposed rows of a batch times the rows times q; entries are gathered PIECE at a time, which caches hold."""
    row, column, weight = _rows(words, idf, len(q))
    if len(row):
        folded = _folded(row, column, weight, q, len(words))
        order = np.argsort(column.astype(np.int16) if len(q) <= 1 << 15 else column, kind="stable")
        row, column, weight = row[order], column[order], weight[order]
        for at in range(0, len(row), PIECE):
            some = slice(at, at + PIECE)
            heads = np.flatnonzero(np.append(True, np.diff(column[some]) != 0))
            out[column[some][heads]] += np.add.reduceat(folded[row[some]] * weight[some, None], heads, axis=0)


def _folded(row: np.ndarray, column: np.ndarray, weight: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """Rows, whose entries lie together, times q."""
    out = np.zeros((n, q.shape[1]))
    for at in range(0, len(row), PIECE):
        some = slice(at, at + PIECE)
        heads = np.flatnonzero(np.append(True, np.diff(row[some]) != 0))
        out[row[some][heads]] += np.add.reduceat(q[column[some]] * weight[some, None], heads, axis=0)
    return out


@dataclass
class Latent:
    """A weight a column, and the leading directions as columns of a matrix, strongest first."""

    idf: np.ndarray
    directions: np.ndarray
    strengths: np.ndarray

    def vectors(self, rows: DataFrame, keys: list[str], words: str, v: str = "v", norm2: str = "norm2") -> DataFrame:
        """(keys, v array<int>, norm2 long): vectors of rows by their words, of length UNIT but for rounding; rows without a
        known word have none."""
        sent = rows.sparkSession.sparkContext.broadcast((self.idf, self.directions))

        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, directions = sent.value
            for batch in parts:
                row, column, weight = _rows(batch.column(batch.num_columns - 1), idf, len(idf))
                found = _folded(row, column, weight, directions, batch.num_rows)
                length = np.sqrt((found**2).sum(axis=1))
                whole = np.rint(found * (UNIT / np.maximum(length, 1e-12))[:, None]).astype(np.int32)
                real = pa.array(length > 1e-9)
                listed = pa.ListArray.from_arrays(np.arange(0, whole.size + 1, whole.shape[1], dtype=np.int32), pa.array(whole.reshape(-1)))
                yield pa.record_batch([*batch.columns[:-1], listed, pa.array((whole.astype(np.int64) ** 2).sum(axis=1))], [*keys, v, norm2]).filter(real)

        chosen = rows.select(*keys, words)
        schema = ", ".join(f"{name} {kind}" for name, kind in chosen.dtypes[:-1]) + f", {v} array<int>, {norm2} long"
        return chosen.mapInArrow(batches, schema)


def fit(items: DataFrame, words: str = "words", rank: int = RANK, buckets: int = BUCKETS, passes: int = PASSES, seed: int = 5) -> Latent:
    """The leading directions of all items' words (array<string>, without repeats). The seed fixes the first block.

    Without items, or with fewer directions than asked for, the missing ones are zero.
    """
    n = items.count()
    df = _sums(items, words, 1, buckets, lambda w, out: _counted(w, out, buckets))[:, 0]
    idf = np.log1p(n / np.maximum(df, 1))
    q = np.random.default_rng(seed).standard_normal((buckets, rank + MORE))
    for _ in range(passes):
        q, _ = np.linalg.qr(_sums(items, words, q.shape[1], buckets, _squared, idf, q))
    small = q.T @ _sums(items, words, q.shape[1], buckets, _squared, idf, q)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-values)[:rank]
    strengths = np.sqrt(np.maximum(values[best], 0))
    return Latent(idf, np.where(strengths > 1e-9, q @ turn[:, best], 0.0), strengths)
