"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII white-space characters (0x09-0x0D and 0x20) that separate words; a fixed value of the contracts.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; sf_dir may be any URI that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only where that is unset and all runs in one machine (tests), a folder of our own.

    RuntimeError on a cluster without the setting: a folder of the driver's machine would be lost to the executors.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="docquarry-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that losing an executor later costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def row_key(df: DataFrame) -> Column:
    """A digest of all columns of a row: rows with the same one are equal and can stand for each other."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(df.columns)])).cast("binary"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale and the other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of WORD_PATTERN matches as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def spread_key(key: Column, seed: str = "") -> Column:
    """A seeded shuffle key that any SQL engine can recompute: md5 of seed and the decimal key, as 32 hex digits.

    A null key counts as the text 'null'.
    """
    return F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))


def running(
    df: DataFrame,
    within: list[str],
    order: list[Column],
    first_order: Column,
    amounts: dict[str, Column],
    rows_per_bucket: int = 4_000,
    largest: int | None = None,
) -> DataFrame:
    """Exclusive running totals over a total order without putting one group into one task.

    Adds, for each name in amounts, the sum of that amount over the rows that precede in the order `first_order`, then
    `order`, separately within the columns `within`. `first_order` is a double in [0, 1) that spreads rows evenly (a
    shuffle key or a rank fraction). Rows are cut into ranges of it, so that a range holds about rows_per_bucket rows
    at most however hot a group is (largest: the rows of the largest group, counted here if it isn't given); totals of ranges are prefix-summed in a small table, and a window then runs inside
    one range at a time. All rows stay.
    """
    if largest is None:
        largest = df.groupBy(*within).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0] or 0
    cells = max(1, -(-largest // rows_per_bucket))
    bucketed = df.withColumn("__b", F.least(F.floor(first_order * cells), F.lit(cells - 1)).cast("long"))
    for name, amount in amounts.items():
        bucketed = bucketed.withColumn(f"__a_{name}", amount)
    keys = [F.col(c) for c in within]
    inner = Window.partitionBy(*keys, "__b").orderBy(first_order, *order).rowsBetween(Window.unboundedPreceding, -1)
    out = bucketed
    for name in amounts:
        out = out.withColumn(name, F.coalesce(F.sum(f"__a_{name}").over(inner), F.lit(0)))
    if cells > 1:
        outer = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        before = bucketed.groupBy(*within, "__b").agg(*[F.sum(f"__a_{n}").alias(f"__s_{n}") for n in amounts])
        for name in amounts:
            before = before.withColumn(f"__p_{name}", F.coalesce(F.sum(f"__s_{name}").over(outer), F.lit(0)))
        renamed = before.select(
            *[F.col(c).alias(f"__k_{c}") for c in within], F.col("__b").alias("__kb"), *[f"__p_{n}" for n in amounts]
        )
        same = F.col("__b") == F.col("__kb")
        for c in within:
            same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        out = out.join(renamed, same, "left")
        for name in amounts:
            out = out.withColumn(name, F.col(name) + F.col(f"__p_{name}"))
    return out.select(*df.columns, *amounts)


#: Keys that hold more than a HEAVY-th of all rows are joined apart; there are fewer than HEAVY of them.
HEAVY = 1_000


def attach(rows: DataFrame, facts: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with facts on key, where facts has one row per key and, as n, how many of rows have that key.

    Keys that hold more than a HEAVY-th of all rows are broadcast (fewer than HEAVY rows of facts, by counting), so the rows
    of a hot key stay where they are and no task gets them all; the others meet in an ordinary join. rows is read twice.
    """
    facts = cut_lineage(facts)
    total = facts.agg(F.sum(n)).first()[0] or 0
    heavy = F.broadcast(facts.where(F.col(n) * HEAVY > total).drop(n))
    light = facts.where(F.col(n) * HEAVY <= total).drop(n)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))


def key_fraction(hex_key: Column) -> Column:
    """The first 52 bits of a hex key as a double in [0, 1)."""
    return F.conv(F.substring(hex_key, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def crc32_sql(text: str) -> str:
    """The CRC-32 of an ASCII text as an unsigned number in DuckDB, which has no such function: bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c_: list_transform(range(0, 8), lambda b_: (ascii(c_) >> b_) & 1)))"
    step = "xor(r_ >> 1, CASE WHEN (r_ + m_) & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_transform({bits}, lambda v_: v_::BIGINT), lambda r_, m_: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"
