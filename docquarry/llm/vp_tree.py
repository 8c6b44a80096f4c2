"""Approximate nearest neighbours by vantage-point trees, one per shard.

Vectors are brought to unit length, where the chord is a metric that orders pairs as the cosine does. A shard's tree
splits its vectors at the median chord from a vantage point; a query leaves out the far side where the triangle
inequality, relaxed by a factor, rules it out: its gap to the split times the factor exceeds the k-th nearest so far.
Factor 1 is exact; larger factors prune more. Queries walk a tree in blocks, so the arithmetic is over matrices.

Each tree is shuffled to its task once, ahead of the blocks of queries that stream through it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import cut_lineage

LEAF = 128
SHARD_ROWS, QUERY_ROWS = 16_384, 512
#: Below so many shards, a tree goes to more than one task.
TASKS = 64


def build(ids: np.ndarray, vectors: np.ndarray, seed: int = 7) -> dict:
    """A tree over unit vectors: arrays in leaf order, and nodes (vantage row, median, near, far) or leaf ranges."""
    order = np.lexsort(vectors.T[::-1])
    order = order[np.argsort(ids[order], kind="stable")]
    rng = np.random.default_rng(seed)
    nodes: list[tuple] = []
    layout: list[np.ndarray] = []
    placed = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal placed
        me = len(nodes)
        nodes.append(())
        if len(rows) <= LEAF:
            nodes[me] = (-1, placed, placed + len(rows), 0)
            layout.append(rows)
            placed += len(rows)
            return me
        vantage = vectors[rows[rng.integers(len(rows))]]
        away = np.sqrt(np.maximum(2 - 2 * (vectors[rows] @ vantage), 0))
        by = np.argsort(away, kind="stable")
        half = len(rows) // 2
        near, far = rows[by[:half]], rows[by[half:]]
        inner, outer = away[by[half - 1]], away[by[half]]
        nodes[me] = (vantage, inner, outer, grow(near), grow(far))
        return me

    grow(order)
    placed_rows = np.concatenate(layout) if layout else np.zeros(0, np.int64)
    return {"nodes": nodes, "rows": placed_rows}


#: Squared chords this close are ties, which the smaller id wins; rounding moves them by less.
TIE = 1e-12


def search(tree: dict, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """(squared chords, rows) of the k nearest rows of each query, ties by the smaller id; infinity and -1 where there are fewer."""
    named_ids = np.append(ids, np.iinfo(np.int64).max)  # row -1 is none
    nodes, rows = tree["nodes"], tree["rows"]
    best = np.full((len(queries), k), np.inf)
    found = np.full((len(queries), k), -1, np.int64)

    def visit(node: int, active: np.ndarray) -> None:
        what = nodes[node]
        if isinstance(what[0], int):
            _, a, b, _ = what
            some = rows[a:b]
            away = np.maximum(2 - 2 * (queries[active] @ vectors[some].T), 0)
            if away.shape[1] > 4 * k:  # those beyond the k-th nearest of this leaf, ties apart, can't be among the answers
                limit = np.partition(away, k - 1, axis=1)[:, k - 1] + 2 * TIE
                seen = np.flatnonzero((away <= np.minimum(limit, best[active].max(axis=1) + 2 * TIE)[:, None]).any(axis=0))
                some, away = some[seen], away[:, seen]
            joined = np.concatenate([best[active], away], axis=1)
            named = np.concatenate([found[active], np.broadcast_to(some, away.shape)], axis=1)
            keep = np.lexsort((named_ids[named], np.rint(joined / TIE)), axis=1)[:, :k]
            best[active] = np.take_along_axis(joined, keep, 1)
            found[active] = np.take_along_axis(named, keep, 1)
            return
        vantage, inner, outer, near, far = what
        away = np.sqrt(np.maximum(2 - 2 * (queries[active] @ vantage), 0))
        nearer = away <= (inner + outer) / 2
        for first, side in ((True, active[nearer]), (False, active[~nearer])):
            if not len(side):
                continue
            d = away[nearer] if first else away[~nearer]
            visit(near if first else far, side)
            gap = outer - d if first else d - inner
            go = np.maximum(gap, 0) * factor <= np.sqrt(best[side].max(axis=1) + TIE)
            if go.any():
                visit(far if first else near, side[go])

    if len(rows) and len(queries):
        visit(0, np.arange(len(queries)))
    return best, found


def _clean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v array<double>) of usable vectors: not null, no null or non-finite component, not zero."""
    # an Arrow-friendly array of doubles; exists() is null-safe because a null component is tested first
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0)
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _answers(kept: tuple, names: np.ndarray, q: np.ndarray, k: int, factor: float) -> pd.DataFrame:
    """(query_id, vec_id, score) of the k nearest in one shard; a point stands for the ids of all rows with its vector."""
    tree, v, ids = kept
    unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
    asked = q / np.sqrt((q * q).sum(axis=1))[:, None]
    _, rows = search(tree, unit, np.array([x[0] for x in ids], np.int64), asked, k + 3, factor)
    who, which = np.nonzero(rows >= 0)
    at = rows[who, which]
    a, b = q[who], v[at]
    score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    counts = np.fromiter((len(ids[i]) for i in at), np.int64, len(at))
    out = pd.DataFrame({
        "query_id": np.repeat(names[who], counts),
        "vec_id": np.concatenate([ids[i] for i in at]) if len(at) else np.zeros(0, np.int64),
        "score": np.repeat(score, counts),
    })
    out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return out.groupby("query_id", sort=False).head(k)


def nearest(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    factor: float = 1.15,
    key: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest other rows by cosine.

    Nearest first, ties by the smaller vec_id; score is the cosine of the original vectors in double precision. A query
    with fewer candidates than k gets them all. Vectors that are null, zero, or hold a null or non-finite component take
    no part, nor do vectors of another length than the query's, nor rows without an id; rows that repeat a vec_id
    with one vector count once. Extra columns are ignored; an empty table gives an empty result.

    Equal vectors are one point of the index that keeps its k + 1 smallest ids, as no answer can hold more of them; so a
    vector that most rows share is one row here. Points whose squared chords from a query are within TIE tie (such as vectors that
    differ by scale) and the smaller ids are taken. Points are spread over shards of about shard_rows by a hash, every
    shard's tree is stored in the checkpoint folder and moves to its task once, and blocks of query_rows queries go to
    every shard: each task holds one tree and one block at a time.
    """
    usable = _clean(vectors, key, vector).dropDuplicates(["vec_id", "v"])
    # a few ids of each vector per slice of ids first, so a vector that most rows share is never gathered in one task
    sliced = usable.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = sliced.groupBy("v", "slice").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    points = few.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    points = cut_lineage(points.withColumn("point", F.xxhash64("v")).withColumn("width", F.size("v")))
    queries = usable.where(F.col("vec_id") % every == 0)
    shards = max(1, -(-points.count() // shard_rows))
    blocks = max(1, -(-queries.count() // query_rows))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("point", kind="stable")
        group = group.assign(first=[x[0] for x in group["ids"]]).sort_values("first", kind="stable")
        v = _matrix(group["v"])
        unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
        tree = build(group["first"].to_numpy(), unit)
        ids = [np.asarray(x, np.int64) for x in group["ids"]]
        kept = pickle.dumps((tree, v, ids), protocol=5)
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "width": [v.shape[1]], "tree": [kept]})

    sharded = points.withColumn("shard", F.pmod("point", F.lit(shards)).cast("int"))
    trees = cut_lineage(sharded.groupBy("shard", "width").applyInPandas(grow, "shard int, width int, tree binary"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        kept = pickle.dumps((group["vec_id"].to_numpy(), _matrix(group["v"])), protocol=5)
        return pd.DataFrame({"width": [int(group["width"].iloc[0])], "block": [int(group["block"].iloc[0])], "queries": [kept]})

    blocked = queries.withColumn("width", F.size("v")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    packed = blocked.groupBy("width", "block").applyInPandas(pack, "width int, block int, queries binary")
    # a tree goes to one task, or to a few where there are fewer shards than tasks; then come its blocks of queries
    copies = min(blocks, max(1, TASKS // shards))
    lane = F.col("shard") * copies + F.col("copy")
    index = trees.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(lane.alias("lane"), "width", F.lit(-1).alias("block"), F.col("tree").alias("data"))
    asked = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("copy", F.col("block") % copies)
    work = index.unionByName(asked.select(lane.alias("lane"), "width", "block", F.col("queries").alias("data")))
    work = work.repartition(min(shards * copies, 20_000), "lane").sortWithinPartitions("lane", "width", "block")

    def answer(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, tree = None, None
        for part in parts:
            for lane, width, block, data in zip(*(part.column(i) for i in range(4)), strict=True):
                here = (lane.as_py(), width.as_py())
                if block.as_py() < 0:
                    place, tree = here, pickle.loads(data.as_py())
                elif place == here:  # a shard without vectors of this width has no tree
                    yield pa.RecordBatch.from_pandas(_answers(tree, *pickle.loads(data.as_py()), k, factor), FOUND, preserve_index=False)

    found = work.mapInArrow(answer, "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("down"), "vec_id"))), 1, k).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.down")).alias("score")
    )
