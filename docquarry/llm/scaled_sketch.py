"""Document fingerprints: a threshold-scaled sketch of five-word shingles.

A text's sketch holds the hash of every shingle that falls below a fixed fraction of all hash values. The fraction is the
same for each text, so a sketch grows with its text, the sketch of several texts together is the union of theirs, and the
share of one sketch that lies in another estimates how much of a short document a very long one contains. Built-in
functions only.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import SPACE_CLASS, WORD_PATTERN

WORDS = 5
#: Hex digits of a hash (48 bits), and the first value that isn't retained: a quarter of all shingles is.
DIGITS, LIMIT = 12, "4"
#: Rows in a range of the order of documents, and the ranges at most (looked up by 64 and 64).
RANGE_ROWS, MOST_RANGES = 128, 64 * 64


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shingles(words: Column) -> Column:
    def at(word: Column, i: Column) -> Column:
        after = [part for k in range(1, WORDS) for part in (F.lit(" "), F.get(words, i + k))]
        return F.concat(word, *after)

    whole = F.array(F.array_join(words, " "))
    return F.when(F.size(words) > WORDS, F.transform(F.slice(words, F.lit(1), F.size(words) - (WORDS - 1)), at)).when(F.size(words) > 0, whole).otherwise(F.array().cast("array<string>"))


def sketch(text: Column) -> Column:
    """The sketch of a text: its retained hashes, each once, in order, as hex digits.

    Shingles are five consecutive words between ASCII white space, joined by a space and taken as they are; a text with
    fewer words is one shingle. Where no hash is below the limit the smallest one stands for the text, so that only a
    text without words (or a null) has an empty sketch.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), lambda w: w != "")
    hashes = _bound(words, lambda w: F.transform(_shingles(w), lambda s: F.substring(F.md5(s.cast("binary")), 1, DIGITS)))
    few = lambda h: _bound(F.filter(h, lambda x: x < LIMIT), lambda kept: F.when((F.size(kept) > 0) | (F.size(h) == 0), kept).otherwise(F.array(F.array_min(h))))
    return F.sort_array(F.array_distinct(_bound(hashes, few)))


def merged(rows: DataFrame, by: list[str], column: str = "sketch") -> DataFrame:
    """(by, hash): the sketch of all texts of a group together, a row for each hash, so that no group is gathered anywhere.

    A hash that only stands for a text without retained ones goes if the group has a retained one. Null and empty
    sketches add nothing; repeated rows don't count twice.
    """
    hashes = rows.select(*by, F.explode(column).alias("hash")).distinct()
    retained = hashes.where(F.col("hash") < LIMIT)
    lone = hashes.where(F.col("hash") >= LIMIT).groupBy(*by).agg(F.min("hash").alias("hash"))
    has = retained.select(*[F.col(c).alias(f"__{c}") for c in by]).distinct()
    same = None
    for c in by:
        test = F.col(c).eqNullSafe(F.col(f"__{c}"))
        same = test if same is None else same & test
    return retained.unionByName(lone.join(has, same, "left_anti"))


def likeness(a: Column, b: Column) -> Column:
    """The share of hashes of two sketches that both hold, 0 to 1; two empty sketches are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both).cast("double"))


def containment(a: Column, b: Column) -> Column:
    """The share of a's hashes that b holds, 0 to 1: how much of a's text stands in b's. An empty a is in everything."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a).cast("double"))


KEY = "struct<a:boolean,b:bigint,c:string>"


def _key(doc_id: Column, text: Column) -> Column:
    """Orders rows by doc_id from the largest to the smallest, null last, then by the text's digest."""
    return F.struct(doc_id.isNull().alias("a"), F.coalesce(F.bitwise_not(doc_id), F.lit(0)).cast("long").alias("b"), F.md5(text.cast("binary")).alias("c"))


def _starts(rows: DataFrame, total: int) -> list:
    """Keys at which ranges of about RANGE_ROWS rows begin, in order: keys of a bounded sample, which only decides how
    rows are dealt out. At most 16 * MOST_RANGES keys come to the driver."""
    wanted = min(MOST_RANGES, total // RANGE_ROWS)
    if wanted < 2:
        return []
    some = rows.sample(min(1.0, 16 * wanted / total), seed=11).select(_key(F.col("doc_id"), F.col("text")).alias("k"))
    found = sorted({tuple(r.k) for r in some.toLocalIterator()})
    return found[:: max(1, -(-len(found) // wanted))][1:]


def with_next(rows: DataFrame, columns: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """rows(doc_id, text) with next: a struct of the row that follows in descending order of doc_id (after the last, the first).

    columns adds what is computed of a row alone, such as a sketch; next holds it too. The order is cut into ranges that
    begin at sampled keys; a row at which a range begins is also sent, as a guest, to the range before, and the first
    of all to the last. So a window inside a range sees every successor, and texts are shuffled once. Rows equal in
    doc_id and text can't be told apart and share a range, which a window streams and spills.
    """
    key = _key(F.col("doc_id"), F.col("text"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).first()
    starts = _starts(rows, whole.n)
    groups = [starts[i : i + 64] for i in range(0, len(starts), 64)]
    as_json = lambda v: F.lit(json.dumps(v, separators=(",", ":")))
    named = lambda k: dict(zip("abc", k, strict=True))
    tops = F.from_json(as_json([named(g[0]) for g in groups]), f"array<{KEY}>")
    every = F.from_json(as_json([[named(s) for s in g] for g in groups]), f"array<array<{KEY}>>")
    first = F.from_json(as_json(named(whole.first) if whole.n else None), KEY)
    upto = lambda keys, k: F.size(F.filter(keys, lambda s: s <= k))

    def places(k: Column) -> Column:
        """The ranges that a row of key k goes to: its own, and as a guest those that it follows."""

        def among(group: Column, keys: Column) -> Column:
            def listed(place: Column) -> Column:
                at = F.greatest(group - 1, F.lit(0)) * 64 + place
                to = lambda where, guest: F.array(F.struct(where.alias("range"), F.lit(guest).alias("guest")))
                none = F.slice(to(at, 0), 1, 0)
                before = F.when(F.get(keys, place - 1) == k, to(at - 1, 1)).otherwise(none)
                return F.concat(to(at, 0), before, F.when(k == first, to(F.lit(len(starts)), 1)).otherwise(none))

            return _bound(F.coalesce(upto(keys, k), F.lit(0)), listed)

        return _bound(upto(tops, k), lambda group: _bound(F.get(every, group - 1), lambda keys: among(group, keys)))

    dealt = columns(rows.select("*", F.inline(_bound(key, places))).repartition("range"))
    made = [c for c in dealt.columns if c not in ("range", "guest")]
    line = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.md5(F.col("text").cast("binary")))
    own = dealt.withColumn("next", F.lead(F.struct(*made)).over(line))
    return own.where("guest = 0").select(*made, "next")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, in_edited, in_next.

    Every text is held against its edited form, whose last half (rounded down) is the beginning of the next document's,
    and against the next document. near_* is the likeness, in_* how much of the text the other holds. A null text is
    empty; a null doc_id comes last in the order; rows with one doc_id follow each other by their text's digest, and a row
    repeated is a row of its own. One row alone is its own next; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paired = with_next(rows, lambda df: df.withColumn("sketch", sketch(F.col("text"))))
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    edited = paired.withColumn("edited", F.concat(F.left("text", chars - half), F.left("next.text", half)))
    both = edited.withColumn("edited_sketch", sketch(F.col("edited")))
    own, other, after = F.col("sketch"), F.col("edited_sketch"), F.col("next.sketch")
    return both.select(
        "doc_id", chars.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join(own, "").alias("fingerprint"), F.array_join(other, "").alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"), likeness(own, after).alias("near_next"),
        containment(own, other).alias("in_edited"), containment(own, after).alias("in_next"),
    )


def fingerprints_sql() -> str:
    """The result of document_fingerprints stated for DuckDB."""
    words = lambda t: f"regexp_extract_all({t}, '{WORD_PATTERN}')"
    hashed = f"CASE WHEN len(w) > {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: left(md5(array_to_string(list_slice(w, i, i + {WORDS - 1}), ' ')), {DIGITS})) WHEN len(w) > 0 THEN [left(md5(array_to_string(w, ' ')), {DIGITS})] ELSE []::VARCHAR[] END"
    kept = f"CASE WHEN len(h) = 0 OR len(list_filter(h, lambda x: x < '{LIMIT}')) > 0 THEN list_filter(h, lambda x: x < '{LIMIT}') ELSE [list_min(h)] END"
    near = lambda a, b: f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
    held = lambda a, b: f"CASE WHEN len({a}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len({a}) END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(text)) AS r, count(*) OVER () AS n FROM d),
e AS (SELECT o.*, x.text AS after, left(o.text, o.n_chars - o.n_chars // 2) || left(x.text, o.n_chars // 2) AS edited FROM o JOIN o x ON x.r = o.r % o.n + 1),
t AS (SELECT r, 1 AS kind, text FROM e UNION ALL SELECT r, 2, edited FROM e UNION ALL SELECT r, 3, after FROM e),
w AS (SELECT r, kind, {words('text')} AS w FROM t), h AS (SELECT r, kind, {hashed} AS h FROM w),
s AS (SELECT r, kind, list_sort(list_distinct({kept})) AS s FROM h)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(a.s, '') AS fingerprint, array_to_string(b.s, '') AS edited_fingerprint,
  {near('a.s', 'b.s')} AS near_edited, {near('a.s', 'c.s')} AS near_next, {held('a.s', 'b.s')} AS in_edited, {held('a.s', 'c.s')} AS in_next
FROM e JOIN s a ON a.r = e.r AND a.kind = 1 JOIN s b ON b.r = e.r AND b.kind = 2 JOIN s c ON c.r = e.r AND c.kind = 3"""
