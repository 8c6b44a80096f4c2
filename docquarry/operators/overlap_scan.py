"""The items that share most words with each question, by one scan over the items' word lists.

Items stream through as Arrow batches, as in dense_scan. The words of a batch that are terms of a block of questions are
looked up once a distinct word. A term that many items of a batch hold is a row of bytes, one an item, and a question adds up
its terms' rows; terms that few hold are counted place by place. A task keeps the best rows of each question and the least
overlap among them, below which an item is passed over; only they leave the task, so no table of all pairs arises.

Of questions with scopes, items' words become numbers of terms before documents' scopes are brought to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.dense_scan import _scoped, _with_bits, by_scope, few_tasks, held_by

#: Questions to a block, items to a batch, and questions whose counts are made at a time: together they bound a task's tables.
BLOCK, STEP, TILE = 16_384, 8_192, 128
#: A term that more than a COMMON-th of a batch's items hold is a row of bytes.
COMMON = 64


def _blocks(questions: DataFrame) -> Iterator[list]:
    held: list = []
    for row in _scoped(questions).select("qid", "terms", "scope").where(F.size("terms") > 0).orderBy("qid").toLocalIterator():
        held.append(row)
        if len(held) == BLOCK:
            yield held
            held = []
    if held:
        yield held


def _coded(column: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of each word that is a term; terms by number."""
    words = column.flatten().dictionary_encode()
    found = pc.index_in(words.dictionary, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
    terms = found[words.indices.to_numpy(zero_copy_only=False)] if len(found) else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return rows[terms >= 0], terms[terms >= 0]


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of all spans, one behind the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class _Best:
    """The k rows of each question that share most terms so far, ties by doc_id and idx."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.fresh = 0
        self.least, self.last = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)  # of the k-th: overlap, doc_id and idx

    def add(self, row: np.ndarray, overlap: np.ndarray, doc_id: np.ndarray, idx: np.ndarray) -> None:
        self.kept.append((row, overlap, doc_id, idx))
        self.fresh += len(row)

    def prune(self) -> None:
        row, overlap, doc_id, idx = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        order = np.lexsort((idx, doc_id, -overlap, row))
        row, overlap, doc_id, idx = row[order], overlap[order], doc_id[order], idx[order]
        counts = np.bincount(row, minlength=len(self.least))
        starts = np.cumsum(counts) - counts
        full = counts >= self.k
        at = starts[full] + self.k - 1
        self.least[full], self.last[full, 0], self.last[full, 1] = overlap[at], doc_id[at], idx[at]
        keep = np.arange(len(row)) - starts[row] < self.k
        self.kept, self.fresh = [(row[keep], overlap[keep], doc_id[keep], idx[keep])], 0


class _Batch:
    """A batch's items in order of doc_id and idx, and for each term of the block the items that hold it."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, doc_id: np.ndarray, idx: np.ndarray, asks: np.ndarray, starts: np.ndarray, n_terms: int, small: type) -> None:
        order = np.lexsort((idx, doc_id))
        self.n, self.order, self.doc_id, self.idx, self.small = len(doc_id), order, doc_id[order], idx[order], small
        self.place = np.empty(self.n, np.int64)
        self.place[order] = np.arange(self.n)
        by_term = np.argsort(terms, kind="stable")
        self.items, counts = self.place[rows[by_term]], np.bincount(terms, minlength=n_terms)
        self.first, self.counts = np.cumsum(counts) - counts, counts
        common = np.flatnonzero(counts * COMMON > self.n)
        number = np.full(n_terms, -1)
        number[common] = np.arange(len(common))
        self.held = np.zeros((len(common), self.n), small)
        spans = _spans(self.first[common], counts[common])
        self.held[np.repeat(np.arange(len(common)), counts[common]), self.items[spans]] = 1
        self.number, self.asks, self.starts = number, asks, starts

    def counted(self, first: int, end: int) -> np.ndarray:
        """How many of its terms each question from first to end shares with each item."""
        out = np.zeros((end - first, self.n), self.small)
        asked = self.asks[self.starts[first] : self.starts[end]]
        of = np.repeat(np.arange(end - first), np.diff(self.starts[first : end + 1]))
        seat = self.number[asked]
        for q, row in zip(of[seat >= 0].tolist(), seat[seat >= 0].tolist(), strict=True):
            np.add(out[q], self.held[row], out=out[q])
        rare, of = asked[seat < 0], of[seat < 0]
        counts = self.counts[rare]
        cells = np.repeat(of * self.n, counts) + self.items[_spans(self.first[rare], counts)]
        np.add.at(out.reshape(-1), cells, self.small(1))
        return out

    def offer(self, best: _Best, first: int, end: int, inside: np.ndarray | None) -> None:
        """Hands over the items that may be among the best of the questions from first to end, at most k of each."""
        counts = self.counted(first, end)
        if inside is not None:
            counts *= inside
        least = best.least[first:end]
        # of equal ones only those before the last one kept
        cut = np.searchsorted(self.doc_id, best.last[first:end, 0], side="left")
        same = np.flatnonzero((least > 0) & (cut < self.n))
        same = same[self.doc_id[cut[same]] == best.last[first:end, 0][same]]
        for q in same.tolist():
            stop = cut[q] + np.searchsorted(self.doc_id[cut[q] :], self.doc_id[cut[q]], side="right")
            cut[q] += np.searchsorted(self.idx[cut[q] : stop], best.last[first + q, 1], side="left")
        near = counts > least.astype(self.small)[:, None]
        for q in np.flatnonzero((least > 0) & (cut > 0)).tolist():
            near[q, : cut[q]] |= counts[q, : cut[q]] == least[q]
        found = near.sum(axis=1)
        for q in np.flatnonzero(found > best.k).tolist():  # the k best of this batch alone
            row = np.where(near[q], counts[q], 0)
            edge = np.partition(row, self.n - best.k)[self.n - best.k]
            near[q] = row > edge
            near[q, np.flatnonzero(row == edge)[: best.k - np.count_nonzero(near[q])]] = True
        q, item = np.divmod(np.flatnonzero(near), self.n)
        if len(q):
            best.add(q + first, counts[q, item].astype(np.int64), self.doc_id[item], self.idx[item].astype(np.int64))


def _coder(names, column: str):
    """A pass that replaces the words of (doc_id, idx, words) by the numbers of those in names(), a column of lists."""

    def coded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names(), pa.string())
        for part in parts:
            rows, terms = _coded(part.column(2), known)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(rows, minlength=part.num_rows))), pa.int32()), pa.array(terms, pa.int32()))
            yield pa.record_batch([part.column(0), part.column(1), lists], ["doc_id", "idx", column])

    return coded


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of the entries of a column of lists of numbers."""
    return np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), column.flatten().to_numpy(zero_copy_only=False)


def held_in(items: DataFrame, names: list[str], scopes: list[str], members: DataFrame) -> DataFrame:
    """(scope, token, df): how many items of each scope hold each of the words in names; '*' among the scopes is all items.

    items(doc_id, idx, words), words without repeats; members(scope, doc_id). A task holds a number for each word and scope.
    """
    spark = items.sparkSession
    sent = spark.sparkContext.broadcast(names)
    kinds = dict(items.dtypes)
    parts_of = sorted(set(scopes) - {"*"})
    places = [0] * ("*" in scopes) + list(range(1, len(parts_of) + 1))

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = sent.value
        totals = np.zeros((len(parts_of) + 1, len(said)), np.int64)
        for part in parts:
            rows, terms = _numbers(part.column(2))
            totals[0] += np.bincount(terms, minlength=len(said))
            first = np.searchsorted(rows, np.arange(part.num_rows + 1))
            for s, inside in held_by(part.column(3)).items() if parts_of else ():
                totals[s] += np.bincount(terms[_spans(first[inside], np.diff(first)[inside])], minlength=len(said))
        for s in places:
            at = np.flatnonzero(totals[s])
            yield pa.record_batch([pa.array(["*" if s == 0 else parts_of[s - 1]] * len(at), pa.string()), pa.array([said[t] for t in at.tolist()], pa.string()), pa.array(totals[s, at])], ["scope", "token", "df"])

    coded = items.select("doc_id", "idx", "words").mapInArrow(_coder(lambda: sent.value, "terms"), f"doc_id {kinds['doc_id']}, idx {kinds['idx']}, terms array<int>")
    return _with_bits(coded, parts_of, members, ("terms",)).mapInArrow(counted, "scope string, token string, df long").groupBy("scope", "token").agg(F.sum("df").alias("df"))


def top_overlap(items: DataFrame, questions: DataFrame, k: int, members: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, idx, overlap, r): the k items of each question's scope that share most of its terms, at least one; ties
    by doc_id and idx.

    items(doc_id, idx, words), questions(qid, terms, scope), terms and words without repeats; members(scope, doc_id).
    Questions without terms have no rows.
    """
    spark = items.sparkSession
    schema = "qid long, doc_id long, idx int, overlap long"
    blocks = list(_blocks(questions))
    out = None
    for block in blocks:
        names = sorted({t for r in block for t in r.terms})
        number = {t: n for n, t in enumerate(names)}
        scopes = sorted({r.scope for r in block if r.scope is not None})
        bit = {s: n + 1 for n, s in enumerate(scopes)}
        block.sort(key=lambda r, bit=bit: bit.get(r.scope, 0))
        asks = [[number[t] for t in set(r.terms)] for r in block]
        starts = np.append(0, np.cumsum([len(a) for a in asks]))
        small = np.uint8 if max(map(len, asks)) < 256 else np.uint32
        sent = spark.sparkContext.broadcast((np.array([r.qid for r in block]), names, np.array([t for a in asks for t in a]), starts, by_scope(np.array([bit.get(r.scope, 0) for r in block])), small))

        def batches(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, names, asks, starts, groups, small = sent.value
            known, best = pa.array(names, pa.string()), _Best(len(qid), k)
            for part in parts:
                for at in range(0, part.num_rows, STEP):
                    some = part.slice(at, STEP)
                    doc_id, idx = (some.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                    if pa.types.is_integer(some.schema.field(2).type.value_type):
                        rows, terms = _numbers(some.column(2))
                    else:
                        rows, terms = _coded(some.column(2), known)
                    batch = _Batch(rows, terms, doc_id, idx, asks, starts, len(names), small)
                    inside = held_by(some.column(3)) if groups[-1][0] else {}
                    for s, first, end in groups:
                        if s and s not in inside:
                            continue
                        mask = None
                        if s:
                            mask = np.zeros(batch.n, small)
                            mask[batch.place[inside[s]]] = 1
                        for f in range(first, end, TILE):
                            batch.offer(best, f, min(f + TILE, end), mask)
                            if 2 * best.fresh > k * len(qid):
                                best.prune()
            if best.kept:
                best.prune()
                row, overlap, doc_id, idx = best.kept[0]
                yield pa.record_batch([pa.array(c) for c in (qid[row], doc_id, idx.astype(np.int32), overlap)], ["qid", "doc_id", "idx", "overlap"])

        chosen = few_tasks(items.select("doc_id", "idx", "words"), len(blocks))
        if scopes:
            chosen = chosen.mapInArrow(_coder(lambda sent=sent: sent.value[1], "terms"), f"doc_id {dict(items.dtypes)['doc_id']}, idx {dict(items.dtypes)['idx']}, terms array<int>")
        found = _with_bits(chosen, scopes, members, chosen.columns[2:]).mapInArrow(batches, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("overlap").desc(), "doc_id", "idx"))).where(F.col("r") <= k)
