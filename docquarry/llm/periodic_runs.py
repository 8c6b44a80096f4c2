"""Periodic run detection: Crochemore's partition refinement over the words of each text.

Positions are kept in classes of equal factors of one length, and classes are refined from a length to the next: two
positions stay together if those after them do. Only the smaller parts of a class that fell apart are looked at to refine
further, so a text of n words takes n log n moves. Two neighbours of a class whose distance is the factors' length are a
square with no smaller period; squares that follow one another are one run.

A run has at least MIN_LENGTH words, so both its beginnings share a factor of half as many: the first lengths are refined
for all positions at once with numpy, and most texts have no class with two members left by then.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import WORD_PATTERN, crc32_sql

# Fixed value of the contract: the least number of words of a run, besides twice its period.
MIN_LENGTH = 12


class _Classes:
    """Classes of positions with two members or more, each a linked list in order; and who has a neighbour how far away."""

    def __init__(self, n: int) -> None:
        self.of, self.before, self.after = [-1] * n, [-1] * n, [-1] * n
        self.head: list[int] = []
        self.size: list[int] = []
        self.gaps: dict[int, set[int]] = defaultdict(set)
        self.links = 0

    def add(self, members: list[int]) -> int:
        """A new class of these positions, in order."""
        name = len(self.head)
        self.head.append(members[0])
        self.size.append(len(members))
        last = -1
        for i in members:
            self.of[i], self.before[i], self.after[i] = name, last, -1
            if last >= 0:
                self.after[last] = i
                self.gaps[i - last].add(last)
            last = i
        self.links += len(members) - 1
        return name

    def remove(self, i: int) -> None:
        name, a, b = self.of[i], self.before[i], self.after[i]
        if a >= 0:
            self.gaps[i - a].discard(a)
            self.after[a] = b
        else:
            self.head[name] = b
        if b >= 0:
            self.gaps[b - i].discard(i)
            self.before[b] = a
            if a >= 0:
                self.gaps[b - a].add(a)
        self.links -= a >= 0 or b >= 0
        self.size[name] -= 1
        self.of[i] = self.before[i] = self.after[i] = -1

    def members(self, name: int) -> list[int]:
        found, i = [], self.head[name]
        while i >= 0:
            found.append(i)
            i = self.after[i]
        return found


def _refine(classes: _Classes, small: list[list[int]], last: int) -> list[list[int]]:
    """The classes for factors one longer. small: those by which they are split. last: the one position whose factor
    would leave the text. Returns the parts of split classes, for each class all but a largest one."""
    parts: dict[int, list[list[int]]] = defaultdict(list)
    of, size = classes.of, classes.size
    for after in small:
        split: dict[int, list[int]] = {}
        for j in after:
            name = of[j - 1] if j else -1
            if name >= 0 and size[name] > 1:
                split.setdefault(name, []).append(j - 1)
        for name, moved in split.items():
            parts[name].append(moved)
    if of[last] >= 0:
        classes.remove(last)
    found = []
    for name, moved in parts.items():
        for part in moved:
            for i in part:
                classes.remove(i)
        if size[name]:
            rest = classes.members(name)
            if len(rest) == 1:  # alone: no class any more, but its predecessor may still be told apart by it
                classes.remove(rest[0])
            moved.append(rest)
        largest = max(range(len(moved)), key=lambda k: len(moved[k]))
        for k, part in enumerate(moved):
            if len(part) > 1 and of[part[0]] < 0:
                classes.add(part)
            if k != largest:
                found.append(part)
    return found


def _merged(squares: list[int], period: int) -> Iterator[tuple[int, int, int]]:
    """Runs (start, length, period) of the places, in order, where squares of this period begin."""
    at = 0
    for k in range(1, len(squares) + 1):
        if k == len(squares) or squares[k] != squares[k - 1] + 1:
            length = squares[k - 1] - squares[at] + 2 * period
            if length >= MIN_LENGTH:
                yield squares[at], length, period
            at = k


def runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of hashable words, by start, then period."""
    n = len(words)
    if n < MIN_LENGTH:
        return []
    seen: dict = {}
    classes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    found: list[tuple[int, int, int]] = []
    length = 1
    while True:
        order = np.argsort(classes, kind="stable")
        ranked = classes[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            return sorted(found, key=lambda r: (r[0], r[2]))
        squares = order[:-1][same & (np.diff(order) == length)]
        found += _merged(np.sort(squares).tolist(), length)
        if length == MIN_LENGTH // 2:
            break
        named = np.empty(len(classes), np.int64)
        named[order] = np.concatenate(([0], np.cumsum(~same)))
        classes = named[:-1] * len(named) + named[1:]
        length += 1
    ends = np.flatnonzero(np.concatenate((~same, [True]))) + 1
    groups = np.split(order, ends[:-1])
    several = np.zeros(len(order) + 1, bool)
    several[order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]] = True
    kept = _Classes(n)
    for group in groups:
        if len(group) > 1:
            kept.add(group.tolist())
    small = [g.tolist() for g in (group[several[group - 1] & (group > 0)] for group in groups) if len(g)]
    while kept.links and length < n // 2:
        small = _refine(kept, small, n - length)
        length += 1
        found += _merged(sorted(kept.gaps.pop(length, ())), length) if length in kept.gaps else ()
    return sorted(found, key=lambda r: (r[0], r[2]))


def _kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def _with_texts(docs: DataFrame, each: Callable[[object, list[bytes]], list[tuple]], schema: pa.Schema, spark_schema: str) -> DataFrame:
    """What each(doc_id, words) makes of the words of every whole text; null texts have none."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = [row for i in range(part.num_rows) for row in each(part.column(0)[i].as_py(), (part.column(1)[i].as_py() or "").encode().split())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*made, strict=True), schema.types, strict=True)], schema=schema) if made else pa.record_batch([pa.array([], t) for t in schema.types], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batches, spark_schema)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period, passage: every run of every text, in words from 0; passage is its first period.

    Texts that are null, empty or without a run give no row; rows that repeat a doc_id are texts of their own; a null
    doc_id stays null. An empty table gives an empty result.
    """

    def each(doc_id: object, words: list[bytes]) -> list[tuple]:
        return [(doc_id, s, n, p, b" ".join(words[s : s + p]).decode()) for s, n, p in runs(words)]

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("passage", pa.string())])
    return _with_texts(docs, each, schema, "doc_id long, start long, length long, period long, passage string")


def repeated(doc_id: int | None, words: list) -> list:
    """The contract's edit: in a tenth of the documents, by the digest of the id, the words from one place on repeat.

    A null doc_id has no digest and its words stay.
    """
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the longest run, runs_sha256, collapsed_sha256.

    The runs are those of the edited texts (repeated). A row for each row of docs: null and empty texts have no words and
    no runs, their digests are those of an empty text. An empty table gives an empty result.
    """

    def each(doc_id: int | None, words: list[bytes]) -> list[tuple]:
        words = repeated(doc_id, words)
        found = runs(words)
        longest = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        exponent = 1000 * longest[1] // longest[2] if found else None
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        stays = b" ".join([words[i] for i in np.flatnonzero(_kept(len(words), found))] if found else words)
        return [(doc_id, len(found), *longest, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(stays).hexdigest())]

    names = "doc_id n_runs start length period exponent_milli".split()
    schema = pa.schema([*[(c, pa.int64()) for c in names], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
    return _with_texts(docs, each, schema, ", ".join(f"{c} long" for c in names) + ", runs_sha256 string, collapsed_sha256 string")


def run_digests_sql() -> str:
    """The result of run_digests stated for DuckDB, by looking at all pairs of equal words of a document.

    Places where words at one distance are equal, without a break, are a stretch with that period; of the stretches with
    the same ends the one of the smallest period is the run.
    """
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}') AS o, {crc32_sql("doc_id::VARCHAR")} AS h FROM documents),
a AS (SELECT *, len(o) AS n, CASE WHEN len(o) > 0 THEN (h // 10) % len(o) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
t AS (SELECT k, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(o[1:a], list_transform(range(a, n), lambda i: o[a + (i - a) % p + 1])) ELSE o END AS w FROM p),
w AS (SELECT k, i, w[i + 1] AS word FROM t, unnest(range(0, n)) AS u(i)),
e AS (SELECT x.k, y.i - x.i AS q, x.i AS i FROM w x JOIN w y ON x.k = y.k AND x.word = y.word AND x.i < y.i),
g AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS g FROM e),
s AS (SELECT k, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY k, q, g HAVING count(*) + q >= greatest({MIN_LENGTH}, 2 * q)),
r AS (SELECT k, start, length, min(q) AS period FROM s GROUP BY k, start, length),
b AS (SELECT k, count(*) AS n_runs, arg_max(struct_pack(start := start, length := length, period := period), (length, -start, -period)) AS best,
        string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY k),
c AS (SELECT w.k, string_agg(word, ' ' ORDER BY i) AS stays FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = w.k AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY w.k)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(stays, '')) AS collapsed_sha256
FROM t LEFT JOIN b ON t.k = b.k LEFT JOIN c ON t.k = c.k"""
