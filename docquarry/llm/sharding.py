"""Sharding by proportional stratified interleaving.

Rows are ranked in a seeded order within each source; a row of rank r of n gets the fraction (r - 1/2) / n. Sorting by
that fraction spreads every source evenly over the whole order, and cutting the order into equal runs gives shards whose
mixture matches the table's and whose row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import cut_lineage, key_fraction, running, spread_key


def interleave(
    rows: DataFrame, n_shards: int, key: str = "doc_id", source: str = "source", ties: tuple[str, ...] = (), seed: str = "shard:"
) -> DataFrame:
    """Adds shard (int) and slot (long, from 0 without gaps in each shard) to rows.

    key and the columns `ties` decide the seeded order; rows equal in all of them are interchangeable. A null source is
    a source of its own, a null key is ordered like the text 'null'. Ranks come from per-range totals (common.running),
    so a source with most of the rows is still ranked in many tasks. An empty table gives an empty result.
    """
    keyed = rows.withColumn("__key", spread_key(F.col(key), seed))
    counts = keyed.groupBy(source).agg(F.count(F.lit(1)).alias("__n"))
    largest, total = counts.agg(F.max("__n"), F.sum("__n")).first()
    order: list[Column] = [F.col("__key"), *[F.col(c) for c in ties]]
    ranked = running(keyed, [source], order, key_fraction(F.col("__key")), {"__rank": F.lit(1).cast("long")}, largest=largest or 0)
    sized = ranked.join(counts.withColumnRenamed(source, "__source"), F.col(source).eqNullSafe(F.col("__source")))
    spread = sized.withColumn("__fraction", (2 * F.col("__rank") + 1) / (2 * F.col("__n")))
    placed = running(spread, [], order, F.col("__fraction"), {"__at": F.lit(1).cast("long")}, largest=total or 0)
    n = max(total or 0, 1)
    return (
        placed.withColumn("__shard", F.expr(f"(__at * {n_shards}L) div {n}L"))
        .withColumn("slot", F.col("__at") - F.expr(f"(__shard * {n}L + {n_shards - 1}L) div {n_shards}L"))
        .withColumn("shard", F.col("__shard").cast("int"))
        .select(*rows.columns, "shard", "slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard under path, each sorted by slot."""
    n = sharded.agg(F.max("shard")).first()[0]
    (sharded.repartition((n or 0) + 1, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path))


N_SHARDS = 24


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null under this law).

    size is the UTF-8 bytes of the text (null: none) plus 8; text_crc32 is the unsigned CRC-32 of the text (null: 0).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
    )
    return interleave(cut_lineage(rows), n_shards, ties=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def shard_sql(n_shards: int = N_SHARDS) -> str:
    """The result of shard_documents stated for DuckDB; the CRC-32 (its polynomial is a fixed value) bit by bit."""
    return f"""
WITH d AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 8 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) AS text_crc32, md5(concat('shard:', coalesce(doc_id::VARCHAR, 'null'))) AS k FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, text_crc32, size) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * rank + 1)::DOUBLE / (2 * n)::DOUBLE, k, text_crc32, size) - 1 AS pos, count(*) OVER () AS total FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (pos * {n_shards} // total)::INTEGER AS shard,
  (pos - ((pos * {n_shards} // total) * total + {n_shards - 1}) // {n_shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM p"""
