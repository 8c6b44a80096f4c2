"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source's documents are put in a seeded order and laid end to end; that line of words, walked at most twice, is cut
into blocks of equal size. Slot n of the schedule maps the golden-ratio point frac(n * phi) through the cumulative
target shares to a source, so each prefix of the schedule is close to the target mixture. The r-th slot of a source
takes the source's r-th block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import SPACE_CLASS, WORD_PATTERN, cut_lineage, key_fraction, row_key, running, spread_key, word_count

# Fixed values of the contract: weights by turns, the total's share of all words, and how often a word may be taken.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
GOLDEN = 0.6180339887498949
CELLS = 1024


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, weight, target for rows with source and size.

    Targets are SHARE of all words by weight; a target stops at PASSES times its source's size, and the excess is
    shared again until none is above. That is min(cap, level * weight) for one level, which is the largest of
    (total - caps before) / (weights from here on) with sources in order of cap / weight. One row per source, so the
    two windows without a partition are over a table that is as long as the list of sources.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = by_source.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("turn") % len(WEIGHTS)) + 1))
    line = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "turn")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    levels = weighed.withColumn(
        "level",
        (F.sum("source_size").over(every) * F.lit(SHARE) - F.lit(PASSES) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    target = F.least(F.col("source_size") * F.lit(float(PASSES)), F.max("level").over(every) * F.col("weight"))
    return levels.withColumn("target", target).select("source", "turn", "weight", "source_size", "n_docs", "target", F.round("target").cast("long").alias("quota"))


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """slot, turn (the source), block, block_end: the block-th block of a source, in words [block * size, block_end).

    As many slots as the quotas need. Where the points give a source more slots than its quota has blocks the last
    ones are left out, and where they give fewer the missing ones follow at the end, so quotas hold to the word.
    """
    spark = targets.sparkSession
    needs = targets.withColumn("blocks", F.ceil(F.col("quota") / block_words)).where("blocks > 0").select("turn", "quota", "blocks")
    total = needs.agg(F.sum("blocks")).first()[0] or 0
    line = Window.orderBy("turn")
    upto = F.sum("blocks").over(line.rowsBetween(Window.unboundedPreceding, 0))
    shares = needs.withColumn("high", upto / F.lit(float(max(total, 1)))).withColumn("low", F.coalesce(F.lag("high").over(line), F.lit(0.0)))
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.col("high") * CELLS))))
    points = spark.range(total).withColumn("x", (F.col("id") * F.lit(GOLDEN)) % F.lit(1.0)).withColumn("cell", F.floor(F.col("x") * CELLS))
    drawn = points.join(cells, "cell").where("x >= low and x < high").select(F.col("id").alias("slot"), "turn")
    ranked = running(drawn, ["turn"], [F.col("slot")], F.col("slot") / F.lit(float(max(total, 1))), {"block": F.lit(1).cast("long")}, largest=total)
    kept = ranked.join(needs, "turn").where("block < blocks").select("slot", "turn", "block", "quota")
    drawn_counts = drawn.groupBy("turn").agg(F.count(F.lit(1)).alias("drawn"))
    short = needs.join(drawn_counts, "turn", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).where("drawn < blocks")
    added = short.withColumn("block", F.explode(F.expr("sequence(drawn, blocks - 1)"))).select(
        (F.lit(total) + F.col("block") * 1_000_003 + F.col("turn")).alias("slot"), "turn", "block", "quota"
    )
    return kept.unionByName(added).select("slot", "turn", "block", F.least((F.col("block") + 1) * block_words, F.col("quota")).alias("block_end"))


BLOCK_WORDS = 256


def mix_pieces(rows: DataFrame, key: str = "doc_id", ties: tuple[str, ...] = (), block_words: int = BLOCK_WORDS, seed: str = "mix:") -> DataFrame:
    """The pieces of the mix for rows with key, source and size (a long; 0 or more).

    Adds source_size, target, ordinal (the row's place in its source's order), and for each piece slot, pass, from_word,
    to_word; a row that the mix leaves out stays with one row of nulls. Rows equal in key and ties are interchangeable.
    """
    targets = source_targets(rows)
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.agg(F.max("n")).first()[0] or 0
    keyed = rows.withColumn("__key", spread_key(F.col(key), seed))
    order = [F.col("__key"), *[F.col(c) for c in ties]]
    laid = running(keyed, ["source"], order, key_fraction(F.col("__key")), {"start": F.col("size"), "ordinal": F.lit(1).cast("long")}, largest=largest)
    named = targets.select(F.col("source").alias("__source"), "turn", "source_size", "target", "quota")
    placed = laid.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "__key")
    passes = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))))
    passes = passes.withColumn("at", F.col("start") + F.col("pass") * F.col("source_size"))
    cut = passes.withColumn(
        "block",
        F.explode_outer(F.when((F.col("size") > 0) & (F.col("at") < F.col("quota")), F.expr(f"sequence(at div {block_words}, (least(at + size, quota) - 1) div {block_words})"))),
    ).where(F.col("block").isNotNull() | (F.col("pass") == 0))
    joined = cut.join(schedule(targets, block_words), ["turn", "block"], "left")
    used = F.col("slot").isNotNull()
    begin = F.when(used, F.greatest(F.col("at"), F.col("block") * block_words))
    end = F.when(used, F.least(F.col("at") + F.col("size"), F.col("block_end")))
    return joined.select(
        *rows.columns, "source_size", "target", "ordinal", "slot", "pass",
        (begin - F.col("at")).alias("from_word"), (end - F.col("at")).alias("to_word"),
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot for each row of docs.

    taken is the words of the blocks' pieces that slots of the schedule take; first_slot is the first such slot.

    size counts the words of the text (null: 0); a null source is a source of its own, last in order. Rows without
    words take none. Repeated rows are rows of their own. An empty table gives an empty result.
    """
    rows = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size")))
    taken = F.coalesce(F.sum(F.col("to_word") - F.col("from_word")), F.lit(0))
    return (
        mix_pieces(rows, ties=("size",))
        .groupBy("source", "ordinal", "doc_id", "size", "source_size", "target")
        .agg(taken.cast("long").alias("taken"), F.min("slot").cast("long").alias("first_slot"))
        .select("doc_id", "size", "source_size", "target", "taken", "first_slot")
    )


def apply_mix(docs: DataFrame) -> DataFrame:
    """The mixed documents with the columns of docs, a row for each document and pass that the mix takes words of, sorted by
    the slot that takes the first of them: any stretch of the result is close to the target mixture.

    Whole documents keep their text; the one document of a source at which its quota ends keeps its first words, with the
    white space before and between them. n_chars follows where there is such a column. Each row is taken with its own
    columns; rows equal in all of them stand for each other and are taken as often as they are there. A null source is a source of its own, a null text has no words and isn't taken.
    """
    text = F.col("text").cast("string")
    keyed = docs.withColumn("__mix_key", row_key(docs))
    plan_rows = cut_lineage(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), "__mix_key"))
    takes = (
        mix_pieces(plan_rows, ties=("__mix_key",))
        .where(F.col("to_word") > F.col("from_word"))
        .groupBy("ordinal", "pass", "__mix_key", "size")
        .agg(F.max("to_word").alias("__mix_words"), F.min("slot").alias("__mix_slot"))
        .select(F.col("__mix_key").alias("__mix_taken"), F.col("size").alias("__mix_size"), "__mix_words", "__mix_slot")
    )
    mixed = keyed.dropDuplicates(["__mix_key"]).join(takes, F.col("__mix_key") == F.col("__mix_taken"))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"{SPACE_CLASS}*{WORD_PATTERN}"), 0), 1, F.col("__mix_words").cast("int")), "")
    mixed = mixed.withColumn("text", F.when(F.col("__mix_words") < F.col("__mix_size"), part).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast("long"))
    return mixed.orderBy("__mix_slot", "__mix_key").select(*docs.columns)


def mix_sql() -> str:
    """The result of mix_documents stated for DuckDB: the taken words in closed form, the slots by walking the schedule."""
    weights = "[" + ", ".join(map(str, WEIGHTS)) + "]"
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn FROM d GROUP BY source),
s1 AS (SELECT *, ({weights})[(turn % {len(WEIGHTS)}) + 1] AS weight FROM s0),
s2 AS (SELECT *, ((SELECT sum(source_size) FROM s1)::DOUBLE * {SHARE}::DOUBLE - {PASSES} * coalesce(sum(source_size) OVER b, 0)::DOUBLE)
          / ((SELECT sum(weight) FROM s1) - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level FROM s1
       WINDOW b AS (ORDER BY source_size::DOUBLE / weight::DOUBLE, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT source, turn, source_size, least(source_size * {float(PASSES)}::DOUBLE, (SELECT max(level) FROM s2) * weight) AS target FROM s2),
n AS (SELECT turn, round(target)::BIGINT AS quota, ceil(round(target) / {BLOCK_WORDS})::BIGINT AS blocks FROM s3 WHERE round(target) > 0),
c AS (SELECT turn, blocks, (sum(blocks) OVER w)::DOUBLE / (SELECT sum(blocks) FROM n)::DOUBLE AS high,
        (sum(blocks) OVER w - blocks)::DOUBLE / (SELECT sum(blocks) FROM n)::DOUBLE AS low, (SELECT sum(blocks) FROM n)::BIGINT AS total FROM n WINDOW w AS (ORDER BY turn)),
p AS (SELECT i AS slot, (i::DOUBLE * {GOLDEN}::DOUBLE) % 1.0::DOUBLE AS x FROM (SELECT unnest(range((SELECT max(total) FROM c))) AS i)),
r AS (SELECT slot, turn, row_number() OVER (PARTITION BY turn ORDER BY slot) - 1 AS block, blocks FROM p JOIN c ON x >= low AND x < high),
k AS (SELECT turn, block, slot FROM r WHERE block < blocks UNION ALL
      SELECT turn, block, total + block * 1000003 + turn FROM (SELECT turn, total, unnest(range(blocks)) AS block FROM c) WHERE (turn, block) NOT IN (SELECT (turn, block) FROM r)),
l AS (SELECT doc_id, size, source_size, target, turn, round(target)::BIGINT AS quota,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(concat('mix:', coalesce(doc_id::VARCHAR, 'null'))), size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(start + size, quota) - start) + greatest(0, least(start + source_size + size, quota) - start - source_size))::BIGINT AS taken,
  CASE WHEN size > 0 AND start < quota THEN k.slot END::BIGINT AS first_slot
FROM l LEFT JOIN k ON k.turn = l.turn AND k.block = l.start // {BLOCK_WORDS}"""
