"""Licence scans by diagonal voting.

All rolling word pairs of a text are joined, by hash and then by their words, to the pairs of a fixed set of templates. A
match of text position p with template position t votes for the diagonal p - t; votes are gathered as a bit mask of
template positions per (text, template, diagonal). Diagonals at most DRIFT apart merge into one span, never a longer
chain of them, so a notice may hold DRIFT words that were put in or left out and its words keep their order. A span is
verified before it counts: the words under its mask must be COVER of the template's, and the phrase that tells the
template from its relatives must stand in it unbroken.

Texts are read once; pairs whose words are in no template leave before anything is shuffled. The templates are
literals of this module, so the broadcast side has a fixed size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import ascii_lower

# Fixed values of the contract: the word pattern, and the base phrases with their labels.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Usual notices in the words of LICENSE_WORD (at most 60 each), their labels, and the phrase that must stand unbroken.
NOTICES = (
    ("released under the mit license", "mit", "mit license"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", "free of charge"),
    ("licensed under the apache license version 2 0", "apache-2.0", "apache license"),
    ("licensed under cc by 4 0", "cc-by-4.0", "cc by 4"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", "cc by sa 4"),
    ("licensed under cc by nd 4 0", "cc-by-nd-4.0", "cc by nd 4"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", "cc by nc 4"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa-4.0", "cc by nc sa 4"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd-4.0", "cc by nc nd 4"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0", "attribution 4 0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", "gnu general public license version 3"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0", "gnu general public license version 2"),
    ("licensed under the gnu lesser general public license", "lgpl", "gnu lesser general public license"),
    ("licensed under the gnu affero general public license", "agpl", "gnu affero general public license"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "source and binary forms"),
    ("licensed under the mozilla public license version 2 0", "mpl-2.0", "mozilla public license"),
    ("this work is dedicated to the public domain", "public-domain", "the public domain"),
)
GRAM = 2
#: The share of a template's words that a span must cover, and how far apart the diagonals of one span may lie.
COVER, DRIFT = 0.8, 2


def templates() -> list[tuple[str, str, bool, int]]:
    """(phrase, label, base, mask of the pairs that must stand on one diagonal): the whole of a base phrase."""
    out = [(phrase, label, True, (1 << len(phrase.split()) - 1) - 1) for phrase, label in BASE]
    for phrase, label, telling in NOTICES:
        words, part = phrase.split(), telling.split()
        at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
        out.append((phrase, label, False, ((1 << len(part) - 1) - 1) << at))
    return out


def template_rows() -> list[tuple[int, str, bool, int, int, int, str, str]]:
    """(template, label, base, words, must, position, first word, second word) for each pair of each template."""
    rows = []
    for number, (phrase, label, base, must) in enumerate(templates()):
        words = phrase.split()
        rows += [(number, label, base, len(words), must, at, words[at], words[at + 1]) for at in range(len(words) - GRAM + 1)]
    return rows


def _templates(spark: SparkSession) -> DataFrame:
    schema = "template int, label string, base boolean, t_words int, must long, t_at int, t_first string, t_second string"
    return spark.createDataFrame(template_rows(), schema).withColumn("gram", F.xxhash64("t_first", "t_second"))


def _scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, pairs): the text's pairs of words, with their places, whose words begin and end pairs of templates."""
    lowered = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    openers, followers = (sorted({row[k] for row in template_rows()}) for k in (6, 7))

    def read(words: Column) -> Column:
        pair = lambda w, i: F.struct(i.cast("int").alias("at"), w.alias("first"), F.get(words, i + 1).alias("second"))
        kept = F.filter(F.transform(words, lambda w, i: F.when(w.isin(openers), pair(w, i))), lambda p: p.isNotNull() & p["second"].isin(followers))
        return F.struct(F.size(words).cast("long").alias("n_words"), kept.alias("pairs"))

    # bound by a lambda, so that the words are taken out of the text once
    told = F.get(F.transform(F.array(F.regexp_extract_all(lowered, F.lit(LICENSE_WORD), 0)), read), F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), told.alias("told")).select("doc_id", "told.n_words", "told.pairs")


def _spans_of(votes: Column) -> Column:
    """Verified spans among a text's votes, an array of structs in the order of (template, diagonal).

    A span opens at each diagonal and takes in those up to DRIFT after it. A base phrase is one diagonal that holds it whole.
    """

    def opened(x: Column, i: Column) -> Column:
        parts = [(F.lit(True), x)]
        for step in range(1, DRIFT + 1):
            y = F.get(votes, i + step)
            parts.append((F.coalesce(~x["base"] & (y["template"] == x["template"]) & (y["diagonal"] - x["diagonal"] <= DRIFT), F.lit(False)), y))
        masks = [F.when(near, y["mask"]).otherwise(F.lit(0).cast("long")) for near, y in parts]
        mask = reduce(lambda a, b: a.bitwiseOR(b), masks)
        told = reduce(lambda a, b: a | b, [m.bitwiseAND(x["must"]) == x["must"] for m in masks])
        first = F.least(*[F.when(near, y["diagonal"] + F.length(F.bin(y["mask"].bitwiseAND(-y["mask"]))) - 1) for near, y in parts])
        last = F.greatest(*[F.when(near, y["diagonal"] + F.length(F.bin(y["mask"])) + (GRAM - 1)) for near, y in parts])
        cover = F.bit_count(mask.bitwiseOR(F.shiftleft(mask, 1))) / x["t_words"]
        return F.struct(
            x["template"].alias("template"), x["label"].alias("label"), x["base"].alias("base"), told.alias("told"),
            first.cast("long").alias("start"), last.cast("long").alias("end"), cover.alias("cover"),
        )

    return F.filter(F.transform(votes, opened), lambda s: s["told"] & (s["cover"] >= COVER))


def license_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, copies, spans): one row for rows of docs with equal doc_id and pairs; copies is their number.

    spans is an array of (template, label, base, told, start, end, cover) in words, end exclusive. For a base phrase a
    span is a place where its words stand consecutively; for a notice, neighbouring diagonals that hold enough of it.
    """
    key = ["doc_id", "n_words", "pairs"]
    rows = _scanned(docs).groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    named = F.broadcast(_templates(docs.sparkSession))
    pair = F.explode_outer("pairs").alias("pair")
    votes = rows.select(*key, "copies", pair).withColumn("v_gram", F.xxhash64("pair.first", "pair.second"))
    same = (F.col("v_gram") == F.col("gram")) & (F.col("pair.first") == F.col("t_first")) & (F.col("pair.second") == F.col("t_second"))
    about = ["template", "label", "base", "t_words", "must"]
    diagonals = votes.join(named, same, "left").groupBy(*key, "copies", *about, (F.col("pair.at") - F.col("t_at")).alias("diagonal")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("t_at"))).alias("mask")
    )
    struct = F.when(F.col("template").isNotNull(), F.struct("template", "diagonal", "label", "base", "t_words", "must", "mask"))
    gathered = diagonals.groupBy(*key, "copies").agg(F.array_sort(F.collect_list(struct)).alias("votes"))
    spans = F.get(F.transform(F.array("votes"), _spans_of), F.lit(0))
    return gathered.select("doc_id", "n_words", "copies", spans.alias("spans"))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the best cover of any template (1 for a base phrase), 0 without a span. A null or empty text has no words
    and no spans: labels are empty strings, first_word and last_word null. Repeated rows and rows without a doc_id stay.
    Extra columns are ignored; an empty table gives an empty result.
    """
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    told = license_spans(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"), "copies",
    )
    once = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return told.withColumn("copy", once).drop("copies", "copy")


def license_scan_sql() -> str:
    """The same result stated for DuckDB: pairs against the templates' pairs, spans by a self join of the diagonals."""
    values = ", ".join(f"({n}, '{label}', {str(base).lower()}, {words}, {must}, {at}, '{a}', '{b}')" for n, label, base, words, must, at, a, b in template_rows())
    return f"""
WITH t(template, label, base, t_words, must, t_at, a, b) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{LICENSE_WORD}') AS w FROM documents),
g AS (SELECT rid, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT rid, w, unnest(range(1, len(w))) AS i FROM d)),
v AS (SELECT rid, template, label, base, t_words, must, pos - t_at AS diagonal, bit_or(1::BIGINT << t_at) AS mask
      FROM g JOIN t USING (a, b) GROUP BY ALL),
u AS (SELECT x.rid, x.label, x.base, x.diagonal, x.t_words, bit_or(y.mask) AS mask, bool_or(y.mask & x.must = x.must) AS told
      FROM v x JOIN v y ON x.rid = y.rid AND x.template = y.template AND y.diagonal - x.diagonal BETWEEN 0 AND CASE WHEN x.base THEN 0 ELSE {DRIFT} END
      GROUP BY x.rid, x.template, x.label, x.base, x.diagonal, x.t_words),
spans AS (SELECT rid, label, base, diagonal AS start, bit_count(mask | (mask << 1))::DOUBLE / t_words AS cover FROM u WHERE told),
s AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
      coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels,
      array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(cover) AS score FROM spans WHERE cover >= {COVER} GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN s USING (rid)"""
