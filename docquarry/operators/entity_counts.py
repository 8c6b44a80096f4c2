"""The entities of items and how many items hold each, without moving the entities: only hashes go out and only counts come back.

Items are dealt into groups by hash, once. A group tells each entity it holds by 96 bits of hash, sorted, and how many of its
items hold it; the hashes go in ranges to buckets, which add up the groups' counts and send back the sums in the order in
which the hashes came. There the group lays them beside its entities, so weights, ranks and the first eight are made where the
items are, and only those become strings. Two entities of equal 96 bits would be counted as one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import words as W
from docquarry.operators import text_scan

#: Items to a group and to a bucket, on average: they bound what a task holds at once, whatever the size of the corpus.
GROUP, BUCKET, LEAST = 8_000, 40_000, 32


def _order(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by both hashes, where each pair of them begins in it, and how often it stands there."""
    order = np.argsort(h)
    if (np.diff(g[order]) != 0)[np.diff(h[order].view(np.int64)) == 0].any():  # unequal in the second hash alone
        order = np.lexsort((g, h))
    a, b = h[order], g[order]
    heads = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    return order, heads, np.diff(np.append(heads, len(a)))


def _lists(table: pa.Table, name: str) -> pa.ListArray:
    column = table.column(name)
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _offsets(lists: pa.ListArray) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))), pa.int32())


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


class _Said:
    """The distinct entities of a group's items: which item's (row), the word they begin with (first) and what follows it (rest,
    -1 for nothing) by number, how often, and their hashes."""

    def __init__(self, column: pa.Array) -> None:
        import xxhash

        if pa.types.is_list(column.type):
            coded = column.flatten().field("entity").dictionary_encode()
            self.row, self.first = np.repeat(np.arange(len(column)), _numbers(column.value_lengths().fill_null(0))), _numbers(coded.indices).astype(np.int64)
            self.rest, self.tf, self.words = np.full(len(self.row), -1), _numbers(column.flatten().field("tf")), coded.dictionary.to_pylist()
        else:
            self.row, self.first, self.rest, self.tf, self.words = text_scan.entities([t or "" for t in column.to_pylist()])
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w.encode()) for w in self.words) + bytes(16), np.uint64).reshape(-1, 2)
        mixed = digests[self.first] * np.uint64(0x9E3779B97F4A7C15) + digests[self.rest]
        self.h, self.g = mixed[:, 0], (mixed[:, 1] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        self.spaced = (self.rest >= 0) | np.array([" " in w for w in self.words] or [False], bool)[self.first]

    def names(self, at: np.ndarray) -> list[str]:
        return [self.words[a] if b < 0 else f"{self.words[a]} {self.words[b]}" for a, b in zip(self.first[at].tolist(), self.rest[at].tolist(), strict=True)]

    def ranks(self) -> np.ndarray:
        """The place of each word among the group's in order, and -1 behind them; a blank stands before all that words hold."""
        ranks = np.full(len(self.words) + 1, -1)
        ranks[sorted(range(len(self.words)), key=self.words.__getitem__)] = np.arange(len(self.words))
        return ranks


def _dealt(items: DataFrame, n: int) -> DataFrame:
    """Items with their group; neighbours stay together, as they share entities. Both readers of the groups share this shuffle."""
    return items.selectExpr(f"pmod(xxhash64(doc_id, idx div 32), {max(n // GROUP, LEAST)}L) AS grp", "doc_id", "idx", "chunk").repartition("grp").sortWithinPartitions("grp")


def _counted(rows: DataFrame, buckets: int, once: bool = False) -> DataFrame:
    """(grp, bucket, df): of rows(grp, doc_id, idx, said), a text or a list of entities each, in how many rows each entity of
    a group stands, in the order of its hashes; once: 0 but in one group."""

    def send(table: pa.Table) -> pa.Table:
        said = _Said(_lists(table, "said"))
        order, heads, times = _order(said.h, said.g)
        h, g = said.h[order][heads], said.g[order][heads]
        at = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        cuts = pa.array(np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64)), pa.int32())
        cut = lambda values, kind: pa.ListArray.from_arrays(cuts, pa.array(values, kind))
        grp = pa.array(np.full(buckets, table.column("grp")[0].as_py()), pa.int64())
        return pa.table({"grp": grp, "bucket": pa.array(np.arange(buckets), pa.int32()), "h": cut(h.view(np.int64), pa.int64()), "g": cut(g, pa.int32()), "n": cut(times, pa.int32())})

    def count(table: pa.Table) -> pa.Table:
        lists = _lists(table, "h")
        order, heads, times = _order(_numbers(lists.flatten()).view(np.uint64), _numbers(_lists(table, "g").flatten()))
        df = np.zeros(len(order), np.int64)
        if len(order):
            sums = np.add.reduceat(_numbers(_lists(table, "n").flatten()).astype(np.int64)[order], heads)
            if once:
                df[order[heads]] = sums
            else:
                df[order] = np.repeat(sums, times)
        return pa.table({"grp": table.column("grp"), "bucket": table.column("bucket"), "df": pa.ListArray.from_arrays(_offsets(lists), pa.array(df))})

    sent = rows.groupBy("grp").applyInArrow(send, "grp long, bucket int, h array<long>, g array<int>, n array<int>")
    return sent.where(F.size("h") > 0).groupBy("bucket").applyInArrow(count, "grp long, bucket int, df array<long>")


def _laid(said: _Said, counts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order, heads, times = _order(said.h, said.g)
    return order, heads, np.repeat(_numbers(_lists(counts.sort_by("bucket"), "df").flatten()), times)


def listed(items: DataFrame, entities: str | None = None) -> DataFrame:
    """(doc_id, idx, said): the first entities of each item by weight, array<struct<entity, tf, df, weight>>; items without any are left out.

    items(doc_id, idx, chunk); entities is an expression over chunk, array<struct<entity, tf>> without repeats. Without it they
    are read from the chunk by text_scan.entities.
    """
    n = items.count()
    rows = _dealt(items, n).selectExpr("grp", "doc_id", "idx", f"coalesce({entities}, array()) AS said" if entities else "chunk AS said")

    def lay(table: pa.Table, counts: pa.Table) -> pa.Table:
        said = _Said(_lists(table, "said"))
        order, _, sums = _laid(said, counts)
        df = np.zeros(len(order), np.int64)
        df[order] = sums
        weight = np.floor(said.tf * np.log(1 + float(n) / np.maximum(df, 1)) * np.where(said.spaced, 1.3, 1.0) * 1e9 + 0.5) / 1e9
        kept = np.flatnonzero((n < W.SMALL_CORPUS) | (df <= W.TOO_COMMON * n))
        ranks = said.ranks()
        kept = kept[np.lexsort((-ranks[said.rest[kept]], -ranks[said.first[kept]], -weight[kept], said.row[kept]))]
        starts = np.flatnonzero(np.append(True, np.diff(said.row[kept]) != 0)[: len(kept)])
        kept = kept[np.arange(len(kept)) - np.repeat(starts, np.diff(np.append(starts, len(kept)))) < W.ENTITIES_PER_ITEM]
        starts = np.flatnonzero(np.append(True, np.diff(said.row[kept]) != 0)[: len(kept)])
        row = pa.array(said.row[kept][starts])
        told = pa.StructArray.from_arrays([pa.array(said.names(kept), pa.string()), pa.array(said.tf[kept], pa.int64()), pa.array(df[kept]), pa.array(weight[kept])], names=["entity", "tf", "df", "weight"])
        return pa.table({"doc_id": table.column("doc_id").take(row), "idx": table.column("idx").take(row), "said": pa.ListArray.from_arrays(pa.array(np.append(starts, len(kept)), pa.int32()), told)})

    kinds = dict(items.dtypes)
    counts = _counted(rows, max(n // BUCKET, LEAST))
    return rows.groupBy("grp").cogroup(counts.groupBy("grp")).applyInArrow(lay, f"doc_id {kinds['doc_id']}, idx {kinds['idx']}, said array<struct<entity: string, tf: bigint, df: bigint, weight: double>>")


def weighed(items: DataFrame, entities: str | None = None) -> DataFrame:
    """(doc_id, idx, entity, tf, df, weight, rank): what listed() gives, a row an entity."""
    rows = listed(items, entities).selectExpr("doc_id", "idx", "posexplode(said) AS (at, e)")
    return rows.selectExpr("doc_id", "idx", "e.entity", "e.tf", "e.df", "e.weight", "at + 1 AS rank")


def counted(items: DataFrame) -> DataFrame:
    """(entity, df): in how many items each entity stands. One of the groups that hold it tells its name."""
    n = items.count()
    rows = _dealt(items, n).selectExpr("grp", "doc_id", "idx", "chunk AS said")

    def tell(table: pa.Table, counts: pa.Table) -> pa.Table:
        said = _Said(_lists(table, "said"))
        order, heads, _ = _order(said.h, said.g)
        df = _numbers(_lists(counts.sort_by("bucket"), "df").flatten())
        mine = np.flatnonzero(df)
        return pa.table({"entity": pa.array(said.names(order[heads[mine]]), pa.string()), "df": pa.array(df[mine], pa.int64())})

    return rows.groupBy("grp").cogroup(_counted(rows, max(n // BUCKET, LEAST), once=True).groupBy("grp")).applyInArrow(tell, "entity string, df bigint")
