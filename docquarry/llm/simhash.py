"""SimHash near-dedup with pivot distance tables.

Fingerprints of 64 bits link where at most MOST bits differ. For every distinct fingerprint the Hamming distances to a
fixed set of reference fingerprints (pivots) are tabled. By the triangle inequality a linked pair's tables differ by MOST
at most everywhere, so pairs meet only in one cell of the tables: a fingerprint is entered under the cells of its
distances to KEYED pivots, cells being 2 * MOST + 1 wide, and asks for its own cell and the neighbour within MOST. The
other coordinates then discard pairs, and the survivors are verified bit by bit.

Distances to pivots of random 64-bit words lie close to 32, so cells alone would be few and full. With the bits cut
into BLOCKS blocks a linked pair is equal in at least BLOCKS - MOST of them; so a meeting is also keyed by two equal
blocks (a block is a coordinate of distance zero), and each link is kept in the first such meeting only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import attach, cut_lineage, row_key
from docquarry.llm.components import connected_components

# Fixed values of the contract: words in a shingle, the hash's seed, and the bits by which linked fingerprints may differ.
SHINGLE, SEED, MOST = 4, 42, 4
BITS = 64
BLOCKS = MOST + 2
PIVOTS = 18
#: Pivots whose distances are keys of the meeting; the others filter the pairs that meet.
KEYED = 2
CELL = 2 * MOST + 1


def _fingerprint(text: str) -> int:
    import xxhash

    digest = xxhash.xxh64_digest
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    k = min(SHINGLE, len(words))
    begins, ends = starts[: len(words) - k + 1].tolist(), (starts[k:] - 1).tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(begins), 1 << 15):
        slices = zip(begins[at : at + (1 << 15)], ends[at : at + (1 << 15)], strict=True)
        hashed = np.frombuffer(b"".join([digest(line[a:b], SEED) for a, b in slices]), np.uint8)
        counts += np.unpackbits(hashed).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(begins)).view(">u8")[0])


def _marked(rows: DataFrame) -> DataFrame:
    """rows, whose last column is text, with fp instead of it: the SimHash of each whole text as a signed long."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.fromiter((_fingerprint(x.as_py() or "") for x in part.column(part.num_columns - 1)), np.uint64, part.num_rows)
            yield pa.record_batch([*part.columns[:-1], pa.array(found.view(np.int64))], [*part.schema.names[:-1], "fp"])

    kept = rows.dtypes[:-1]
    return rows.mapInArrow(batches, ", ".join(f"`{name}` {kind}" for name, kind in kept) + ", fp long")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text as a signed long. Null and empty texts have fingerprint 0."""
    return _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def pivots(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints by rule: bit j of the i-th is the parity of i AND j, so any two differ in half the bits."""
    return [_signed(sum((bin(i & j).count("1") & 1) << j for j in range(BITS))) for i in range(1, count + 1)]


def block_masks() -> list[int]:
    cuts = [round(BITS * i / BLOCKS) for i in range(BLOCKS + 1)]
    return [_signed(((1 << (b - a)) - 1) << a) for a, b in zip(cuts, cuts[1:], strict=False)]


PER_LONG = 9


def _tables(fp: Column) -> list[Column]:
    """Distances to the pivots, 7 bits each, PER_LONG to a long."""
    every = [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long") for p in pivots()]
    packed = []
    for at in range(0, len(every), PER_LONG):
        shifted = [F.shiftleft(d, 7 * k) for k, d in enumerate(every[at : at + PER_LONG])]
        packed.append(reduce(lambda a, b: a.bitwiseOR(b), shifted))
    return packed


def _within(a: Column, b: Column) -> Column:
    """Whether no packed coordinate differs by more than MOST."""
    gaps = [F.abs(F.shiftright(a, 7 * k).bitwiseAND(127) - F.shiftright(b, 7 * k).bitwiseAND(127)) for k in range(PER_LONG)]
    return F.greatest(*gaps) <= MOST


def _met(distinct: DataFrame, keyed: int) -> DataFrame:
    """Pairs a < b of rows that meet: two equal blocks, and neighbouring cells of the distances to `keyed` pivots."""
    masks = block_masks()
    tables = [t.alias(f"t{k}") for k, t in enumerate(_tables(F.col("fp")))]
    away = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))) for p in pivots()[:keyed]]
    cell = lambda d: F.floor((d + MOST) / CELL).cast("int")
    own = F.array(F.array(*[cell(d) for d in away]).cast("array<int>"))
    asked = reduce(lambda found, d: F.flatten(F.transform(found, lambda c: F.array(*[F.array_append(c, cell(d + by)) for by in (-MOST, MOST)]))), away, F.array(F.array().cast("array<int>")))

    def side(cells: Column, name: str) -> DataFrame:
        blocks = F.array(*[
            F.struct(F.lit(n).alias("pair"), F.lit(j).alias("last"), F.col("fp").bitwiseAND(F.lit(_signed((masks[i] | masks[j]) & (1 << BITS) - 1))).alias("shared"))
            for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))
        ])
        spread = distinct.select("fp", *tables, F.explode(F.array_distinct(cells)).alias("cells")).select("*", F.inline(blocks))
        return spread.select("fp", *[f"t{k}" for k in range(len(tables))], "last", F.xxhash64("pair", "shared", "cells").alias("meeting")).alias(name)

    a, b = side(own, "a"), side(asked, "b")
    return a.join(b, (F.col("a.meeting") == F.col("b.meeting")) & (F.col("a.last") == F.col("b.last")) & (F.col("a.fp") < F.col("b.fp")))


def fingerprint_links(distinct: DataFrame, keyed: int = KEYED) -> DataFrame:
    """(a, b), a < b: every pair of different fingerprints in distinct(fp) with at most MOST differing bits, once."""
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    earlier = reduce(lambda x, y: x + y, [F.when((differ.bitwiseAND(F.lit(m)) == 0) & (F.lit(k) < F.col("a.last")), 1).otherwise(0) for k, m in enumerate(block_masks())])
    near = reduce(lambda x, y: x & y, [_within(F.col(f"a.t{k}"), F.col(f"b.t{k}")) for k in range(-(-PIVOTS // PER_LONG))])
    return _met(distinct, keyed).where(near).where((F.bit_count(differ) <= MOST) & (earlier == 1)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def _components(marked: DataFrame, name: Column) -> DataFrame:
    """(fp, named, n): for each fingerprint of marked(..., fp) the least `name` of its component, and how many rows have it."""
    classes = cut_lineage(marked.groupBy("fp").agg(F.min(name).alias("first"), F.count(F.lit(1)).alias("n")))
    found = connected_components(fingerprint_links(classes.select("fp")))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return rooted.join(rooted.groupBy("root").agg(F.min("first").alias("named")), "root").select("fp", "named", "n")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links, itself included.

    Equal fingerprints are linked like any others, so they are brought together before pairs are looked at: pairs are
    between different fingerprints, whatever the number of copies. Null and empty texts share fingerprint 0. Rows with
    a null doc_id keep their place in a component but never name it (a component of such rows alone has a null name).
    Repeated rows stay; an empty table gives an empty result.
    """
    marked = cut_lineage(fingerprints(docs))
    by_fp = _components(marked, F.col("doc_id")).withColumnRenamed("named", "component_id")
    return attach(marked, by_fp, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component of near duplicates, with all columns: the one of the smallest doc_id, null last.

    Rows decide, not ids: rows that share a doc_id but not a text are documents of their own, and of several rows of the
    smallest doc_id in a component one stays, by a digest of all columns. An empty table gives an empty result.
    """
    keyed = docs.withColumn("__row", row_key(docs))
    marked = cut_lineage(_marked(keyed.select("__row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))))
    chosen = _components(marked, F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "__row")).select(F.col("named.__row").alias("__row")).distinct()
    return keyed.join(chosen, "__row", "left_semi").dropDuplicates(["__row"]).select(*[F.col(f"`{c}`") for c in docs.columns])
