"""Line dedup by a segment-partition edit join, in DataFrame expressions only.

A line goes if the same line, or one within MOST edits of it, came before it; "before" is by (doc_id, place in the text).
Lines within MOST edits are found by cutting every line into MOST + 1 segments: one of them must stand unchanged in the
other line, at a place that the edits left and right of it allow. So each line writes its segments to an index under
(segment number, its own length, characters) and probes the index with the few substrings of its own that could be a
segment of a line up to MOST characters shorter. Of lines that share a segment (versions of one line in many near
copies, say) most are still far apart. So lines that share a segment with another one are found by semi joins first, which
make no pairs; each is marked with the letters it holds an odd number of times. An edit changes two of these parities at
most, so lines with more changes do not meet. Pairs that meet are verified by banded
bit-parallel edit distance.

Texts are shuffled once, by doc_id; which lines come first, the keys and the pairs travel as hashes and places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 2
#: Characters from which a line is compared with nearly equal ones; exact repeats go at any length.
MIN_CHARS = 20
#: Characters trimmed from both ends of a line before it is compared; line ends themselves are \n.
BLANKS = " \t\r\x0b\x0c"
#: Bits of a line's mark: classes of letters (code point modulo CLASSES), and lengths told apart.
CLASSES, LENGTHS = 28, 8


def edit_distance(a: str, b: str, most: int = MOST) -> Column:
    """The edit distance of the string columns a and b where it is `most` at most, else a larger number.

    The band of 2 * most + 1 cells around the diagonal is held as bits of vertical differences (one bit per row), and a
    column of the dynamic programme is a handful of word operations (Myers' recurrence, with the band moving down a
    row per column). Lengths must differ by `most` at most. A common tail of most + 1 characters is put behind both,
    so that the band's last row starts inside the shorter line.
    """
    width = 2 * most + 1
    full = (1 << width) - 1
    tail = "\\u0000" * (most + 1)
    pattern = f"split(concat({a}, '{tail}'), '')"
    text = f"split(concat({b}, '{tail}'), '')"
    bits = " + ".join(f"if(get(p, j - {most} + {r}) <=> c, {1 << r}, 0)" for r in range(width))
    matches = f"transform(array({pattern}), p -> transform({text}, (c, j) -> cast({bits} as bigint)))[0]"
    m = f"(length({a}) + {most + 1})"
    start = full & ~((1 << most) - 1)
    d0 = f"((((x & s.vp) + s.vp) ^ s.vp) | x | s.vn) & {full}L"
    hp = f"((s.vn | ~(d | s.vp)) & {full}L)"
    hn = "(d & s.vp)"
    row = f"({m} - s.j + {most})"
    diagonal = f"(1 - shiftright(d, {width - 1}))"
    bottom = f"((shiftright({hp}, {row}) & 1) - (shiftright({hn}, {row}) & 1))"
    step = (
        f"transform(array({d0}), d -> struct(({hn} | ~(shiftright(d, 1) | {hp})) & {full}L as vp, shiftright(d, 1) & {hp} as vn, "
        f"s.dist + if(s.j <= {m} - {most}, {diagonal}, {bottom}) as dist, s.j + 1 as j))[0]"
    )
    folded = (
        f"aggregate({matches}, struct({start}L as vp, 0L as vn, {most}L as dist, 1 as j), "
        f"(s, x) -> if(s.dist > {3 * most}, s, {step}), s -> s.dist)"
    )
    return F.expr(folded)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _plain(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _cut(lines: DataFrame, most: int) -> DataFrame:
    """lines(line, n) with the shorter segment's length and the number of longer ones, for lines of n to n - most characters.

    As columns of their own they are computed once, and the keys stay so short that the JVM compiles them.
    """
    parts = most + 1
    for gap in range(most + 1):
        lines = lines.withColumn(f"s{gap}", F.expr(f"cast((n - {gap}) div {parts} as int)")).withColumn(f"r{gap}", F.expr(f"n - {gap} - {parts} * cast((n - {gap}) div {parts} as int)"))
    return lines


def _key(k: int, gap: int, most: int, shift: int = 0) -> Column:
    """The hash of what stands, shifted, where the k-th of most + 1 segments of a line `gap` characters shorter does; the last
    segments are the longer ones."""
    start = f"{k} * s{gap} + greatest(r{gap} + {k - most - 1}, 0) + {shift + 1}"
    size = f"s{gap} + greatest(least(r{gap} + {k - most}, 1), 0)"
    return F.expr(f"xxhash64({k}, n - {gap}, substring(line, {start}, {size}))")


def _index_keys(most: int) -> list[Column]:
    return [_key(k, 0, most) for k in range(most + 1)]


def _probe_keys(most: int) -> list[Column]:
    """Substrings that can be the k-th segment of a line of n - gap characters, both ends' edits considered."""
    keys = []
    for gap in range(most + 1):
        for k in range(most + 1):
            low = max(-k, gap - (most - k))
            high = min(k, gap + (most - k))
            keys += [_key(k, gap, most, shift) for shift in range(low, high + 1)]
    return keys


def _mark(most: int) -> Column:
    """Parities of the counts of letters, in CLASSES bits, and above them the length modulo LENGTHS (more than `most`)."""
    if most >= LENGTHS:
        raise ValueError(f"most must be under {LENGTHS}")
    parities = f"aggregate(split(line, ''), 0, (s, c) -> s ^ shiftleft(1, ascii(c) % {CLASSES}))"
    return F.expr(f"{parities} | shiftleft(n % {LENGTHS}, {CLASSES})")


def _may_be_near(most: int) -> Column:
    """Whether two lines that share a key can be within `most` edits; of equal lengths one order is enough.

    Lengths that differ by gap take gap insertions, of one parity each; the other edits change two at most.
    """
    gap = F.pmod(F.shiftright("p_mark", CLASSES) - F.shiftright("mark", CLASSES), F.lit(LENGTHS))
    changed = F.bit_count(F.col("mark").bitwiseXOR(F.col("p_mark")).bitwiseAND(F.lit((1 << CLASSES) - 1)))
    earlier = (F.col("doc_id") < F.col("p_doc_id")) | ((F.col("doc_id") == F.col("p_doc_id")) & (F.col("pos") < F.col("p_pos")))
    return (changed <= 2 * most - gap) & ((gap > 0) | earlier)


def _firsts(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, keepers array<struct<pos, h, long>>): for each document the lines that no earlier line equals, and whether
    they have min_chars characters. Blank lines take no part."""
    occurrences = docs.select("doc_id", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).select("doc_id", "pos", _plain(F.col("line")).alias("line")).where(F.length("line") > 0)
    hashed = occurrences.select("doc_id", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), (F.length("line") >= min_chars).alias("long"))
    first = hashed.groupBy("h", "h2", "long").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    return first.groupBy(F.col("first.doc_id").alias("k_doc_id")).agg(F.collect_list(F.struct(F.col("first.pos").alias("pos"), "h", "long")).alias("keepers"))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, pos, h, line) for wanted(k_doc_id, keepers); a line whose hash differs (another row's) is left out."""
    named = docs.join(wanted, docs["doc_id"] == wanted["k_doc_id"])
    picked = F.get(F.transform(F.array(_lines(F.col("text"))), lambda lines: F.transform(F.filter("keepers", lambda k: k["long"]), lambda k: F.struct(k["pos"].alias("pos"), k["h"].alias("h"), _plain(F.get(lines, k["pos"])).alias("line")))), F.lit(0))
    return named.select("doc_id", F.inline(picked)).where(F.xxhash64("line") == F.col("h"))


def _picked(places: str, pick) -> Column:
    """pick(place, lines) for each of the places. The text is split once, and only what is picked leaves the row."""
    return F.get(F.transform(F.array(_lines(F.col("text"))), lambda lines: F.transform(places, lambda k: pick(k, lines))), F.lit(0))


def near_line_pairs(docs: DataFrame, most: int = MOST, min_chars: int = MIN_CHARS) -> DataFrame:
    """Pairs of different lines within `most` edits: a_doc_id, a_pos, a_h, b_doc_id, b_pos, b_h, distance; each once, by the
    lines' first occurrences, with the later one as b. docs needs doc_id (not null) and text (not null)."""
    firsts = _firsts(docs, min_chars)
    lines = _texts_of(docs, firsts)
    measured = _cut(lines.withColumn("n", F.length("line")), most)
    index = measured.select("doc_id", "pos", F.explode(F.array(*_index_keys(most))).alias("key"))
    renamed = measured.withColumnsRenamed({"doc_id": "p_doc_id", "pos": "p_pos"})  # before the explode, else a semi join moves below it and shuffles anew
    probe = renamed.select("p_doc_id", "p_pos", F.explode(F.array(*_probe_keys(most))).alias("p_key"))
    shared = F.col("key") == F.col("p_key")
    other = (F.col("doc_id") != F.col("p_doc_id")) | (F.col("pos") != F.col("p_pos"))
    seeking = probe.join(index.hint("shuffle_hash"), shared & other, "left_semi")
    sought = index.join(seeking.select("p_key").distinct().hint("shuffle_hash"), shared, "left_semi")
    theirs = _marked(docs, seeking.select(F.col("p_doc_id").alias("doc_id"), F.col("p_pos").alias("pos"), F.col("p_key").alias("key")), most)
    theirs = theirs.select("key", F.col("doc_id").alias("p_doc_id"), F.col("pos").alias("p_pos"), F.col("mark").alias("p_mark"))
    met = _marked(docs, sought, most).join(theirs, "key").where(_may_be_near(most))
    mine, theirs = F.struct("doc_id", "pos"), F.struct(F.col("p_doc_id").alias("doc_id"), F.col("p_pos").alias("pos"))
    pairs = met.select(F.least(mine, theirs).alias("a"), F.greatest(mine, theirs).alias("b")).distinct()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("e")).distinct()
    return _verified(docs, pairs, ends, most)


def _marked(docs: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """rows(doc_id, pos, key) with the mark of the line at that place; texts are asked once for a place."""
    asked = rows.groupBy("doc_id", "pos").agg(F.collect_set("key").alias("keys")).groupBy(F.col("doc_id").alias("k_doc_id")).agg(F.collect_list(F.struct("pos", "keys")).alias("places"))
    picked = _picked("places", lambda k, lines: F.struct(k["pos"].alias("pos"), k["keys"].alias("keys"), _plain(F.get(lines, k["pos"])).alias("line")))
    named = docs.join(asked, docs["doc_id"] == asked["k_doc_id"]).select("doc_id", F.inline(picked)).where(F.col("line").isNotNull())
    return named.withColumn("n", F.length("line")).withColumn("mark", _mark(most)).select("doc_id", "pos", "mark", F.explode("keys").alias("key"))


def _verified(docs: DataFrame, pairs: DataFrame, ends: DataFrame, most: int) -> DataFrame:
    asked = ends.groupBy(F.col("e.doc_id").alias("k_doc_id")).agg(F.collect_list("e.pos").alias("places"))
    named = docs.join(asked, docs["doc_id"] == asked["k_doc_id"])
    picked = _picked("places", lambda k, lines: F.struct(k.alias("pos"), _plain(F.get(lines, k)).alias("line")))
    texts = named.select("doc_id", F.inline(picked)).where(F.col("line").isNotNull())
    a = texts.select(F.col("doc_id").alias("a_doc_id"), F.col("pos").alias("a_pos"), F.col("line").alias("a_line"))
    b = texts.select(F.col("doc_id").alias("b_doc_id"), F.col("pos").alias("b_pos"), F.col("line").alias("b_line"))
    flat = pairs.select(F.col("a.doc_id").alias("a_doc_id"), F.col("a.pos").alias("a_pos"), F.col("b.doc_id").alias("b_doc_id"), F.col("b.pos").alias("b_pos"))
    both = flat.join(a, ["a_doc_id", "a_pos"]).join(b, ["b_doc_id", "b_pos"]).where(F.abs(F.length("a_line") - F.length("b_line")) <= most)
    return both.withColumn("distance", edit_distance("a_line", "b_line", most)).where(F.col("distance") <= most).select(
        "a_doc_id", "a_pos", F.xxhash64("a_line").alias("a_h"), "b_doc_id", "b_pos", F.xxhash64("b_line").alias("b_h"), "distance"
    )


def _decided(docs: DataFrame, most: int, min_chars: int) -> DataFrame:
    """docs with __lines, and __kept: the places of the lines that stay, and counts of lines dropped on either ground."""
    taking_part = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    typed, kinds = docs, dict(docs.dtypes)
    for name, kind in (("doc_id", "bigint"), ("text", "string")):
        if kinds[name] != kind:  # a cast without effect would keep Spark from reusing the shuffled texts
            typed = typed.withColumn(name, F.col(name).cast(kind))
    known = typed.where(taking_part)
    bare = known.select("doc_id", "text")
    firsts = _firsts(bare, min_chars)
    near = near_line_pairs(bare, most, min_chars).groupBy(F.col("b_doc_id").alias("__n_doc_id")).agg(F.collect_set(F.struct(F.col("b_pos").alias("pos"), F.col("b_h").alias("h"))).alias("__near_found"), F.count(F.lit(1)).alias("__links"))
    named = firsts.select(F.col("k_doc_id").alias("__k_doc_id"), F.transform("keepers", lambda k: F.struct(k["pos"].alias("pos"), k["h"].alias("h"))).alias("__keepers"))
    decided = known.join(named, F.col("doc_id") == F.col("__k_doc_id"), "left").join(near, F.col("doc_id") == F.col("__n_doc_id"), "left")
    joined = decided.unionByName(typed.where(~taking_part), allowMissingColumns=True)
    empty = F.expr("cast(array() as array<struct<pos:int,h:bigint>>)")
    marked = joined.withColumn("__lines", _lines(F.col("text"))).withColumn(
        "__placed", F.transform("__lines", lambda x, i: F.struct(i.alias("pos"), F.when(F.length(_plain(x)) > 0, F.xxhash64(_plain(x))).alias("h")))
    )
    eligible = F.filter("__placed", lambda x: x["h"].isNotNull())
    same = F.array_except(eligible, F.coalesce("__keepers", empty))
    counted = marked.withColumn("__same", F.when(F.col("doc_id").isNotNull(), same).otherwise(empty)).withColumn("__near", F.coalesce(F.array_intersect("__near_found", "__placed"), empty))
    return counted.withColumn("__kept", F.transform(F.array_except("__placed", F.concat("__same", "__near")), lambda x: x["pos"]))


def _kept_text() -> Column:
    return F.array_join(F.transform("__kept", lambda p: F.get("__lines", p)), "\n")


def dedup_lines(docs: DataFrame, most: int = MOST, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with repeated and nearly repeated lines taken out of the texts; n_chars follows where there is such a column.

    Lines that equal an earlier one go at any length (blanks at the ends aside), but for blank ones; lines within `most`
    edits of one go from min_chars characters on. Rows with a null doc_id or text are left alone. Rows stay even when no line of theirs does (their text is then empty). Rows that repeat doc_id and
    text are one document and keep the same lines; of equal lines in a text the first stays.
    """
    out = _decided(docs, most, min_chars).withColumn("text", F.when(F.col("text").isNotNull(), _kept_text()))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def line_dedup_report(docs: DataFrame, most: int = MOST, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_kept, n_same, n_near, n_links, kept_sha256 for each row of docs.

    n_same lines equal an earlier line, n_near others are within `most` edits of one, n_links counts the pairs in which
    lines of this document are the later one; kept_sha256 is of the kept lines joined by line feeds. A null text has no
    lines and the digest of nothing. Extra columns are ignored; an empty table gives an empty result.
    """
    decided = _decided(docs.select("doc_id", "text"), most, min_chars)
    return decided.select(
        "doc_id", F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__kept"), F.lit(0)).cast("long").alias("n_kept"), F.coalesce(F.size("__same"), F.lit(0)).cast("long").alias("n_same"),
        F.size("__near").cast("long").alias("n_near"), F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"),
        F.sha2(F.coalesce(_kept_text(), F.lit("")), 256).alias("kept_sha256"),
    )


def line_dedup_sql(most: int = MOST, min_chars: int = MIN_CHARS) -> str:
    """The result of line_dedup_report stated for DuckDB by comparing all lines of like length."""
    return f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS pos, ls[i] AS raw, trim(ls[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
o AS (SELECT *, length(line) > 0 AS eligible, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM l),
f AS MATERIALIZED (SELECT doc_id, pos, line, length(line) AS n FROM o WHERE nth = 1 AND length(line) >= {min_chars}),
g AS (SELECT *, n + unnest(range(-{most}, {most + 1})) AS n2 FROM f),
p AS (SELECT b.doc_id, b.pos FROM g a JOIN f b ON a.n2 = b.n AND (a.doc_id, a.pos) < (b.doc_id, b.pos)
      WHERE levenshtein(a.line, b.line) <= {most}),
q AS (SELECT doc_id, pos, count(*) AS links FROM p GROUP BY ALL),
m AS (SELECT o.*, q.links FROM o LEFT JOIN q ON o.doc_id = q.doc_id AND o.pos = q.pos AND o.nth = 1)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (NOT eligible OR (nth = 1 AND links IS NULL)))::BIGINT AS n_kept,
  (count(*) FILTER (eligible AND nth > 1))::BIGINT AS n_same, (count(*) FILTER (links IS NOT NULL))::BIGINT AS n_near,
  coalesce(sum(links), 0)::BIGINT AS n_links,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT eligible OR (nth = 1 AND links IS NULL)), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
