"""Conversation prefix trie by MSD radix partitioning over dictionary-encoded turns.

A dictionary gives each distinct turn (role and text) a number, so a conversation is an array of numbers and those that are
the same are one row with a count. All rows begin in one bucket, the root. While a bucket holds more than a task should
take, one round deals its rows out by the number that follows their common prefix; buckets that are small enough are
finished in one task each by multikey quicksort, whose recursion emits the nodes. What the rounds left above the small
buckets is a table of few nodes, summed up from the last round to the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import attach, crc32_sql, cut_lineage

# Fixed values of the contract: conversations share beginnings in groups of GROUP, of fewer than HEADS turns.
GROUP, HEADS = 5, 9
#: Rows and turns that a bucket may have to be finished in one task.
LOCAL_ROWS, LOCAL_TURNS = 256, 1 << 16
#: Conversation ids in a block of a node's list of ends.
BLOCK_IDS = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def encoded(conversations: DataFrame) -> DataFrame:
    """conv_id, codes, sizes: each conversation's turns in order, as numbers of the dictionary, and their texts' UTF-8 bytes.

    Ordered by turn, null first, ties by role and text; null role and text are empty; rows without a conv_id belong to no
    conversation and are left out. A conversation is one row of 16 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("said"), F.octet_length(text).cast("long").alias("bytes"),
        role.alias("role"), F.md5(text.cast("binary")).alias("tie"),
    )
    dictionary = turns.groupBy("said").agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.monotonically_increasing_id())
    coded = attach(turns, dictionary, "said", "n")
    listed = F.sort_array(F.collect_list(F.struct("turn", "role", "tie", "code", "bytes")))
    return coded.groupBy("conv_id").agg(listed.alias("t")).select("conv_id", F.col("t.code").alias("codes"), F.col("t.bytes").alias("sizes"))


def with_shared_beginnings(rows: DataFrame) -> DataFrame:
    """The contract's edit of encoded rows: the first h turns of conversation c - c % GROUP stand for c's own first h."""
    keyed = rows.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    bases = rows.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), *[F.slice(c, 1, HEADS).alias(f"first_{c}") for c in ("codes", "sizes")])

    def joined(c: str) -> Column:
        begins = F.coalesce(F.slice(F.col(f"first_{c}"), F.lit(1), F.col("h")), F.array().cast("array<bigint>"))
        return F.concat(begins, F.slice(F.col(c), F.col("h") + 1, F.size(c))).alias(c)

    return keyed.join(bases, "base", "left").select("conv_id", joined("codes"), joined("sizes"))


def _ends(rows: DataFrame) -> DataFrame:
    """own, ends: the digest of the conv_ids of each distinct sequence, ascending and joined by commas.

    A digest is made in one pass over the ids, however many; they come to it in blocks that many tasks have joined.
    """
    blocks = rows.groupBy("own", F.floor(F.col("conv_id") / BLOCK_IDS).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, made = None, None
        for part in parts:
            found = []
            for name, ids in zip(part["own"], part["ids"], strict=True):
                if name != own:
                    if made is not None:
                        found.append((own, made.hexdigest()))
                    own, made = name, hashlib.sha256(ids.encode())
                else:
                    made.update(b"," + ids.encode())
            yield pd.DataFrame(found, columns=["own", "ends"])
        if made is not None:
            yield pd.DataFrame([(own, made.hexdigest())], columns=["own", "ends"])

    return blocks.repartition("own").sortWithinPartitions("own", "block").select("own", "ids").mapInPandas(digests, "own string, ends string")


def _sequences(rows: DataFrame) -> DataFrame:
    """codes, sizes, n, first, ends: the distinct sequences, how many conversations are the same and the smallest of them."""
    named = cut_lineage(rows.withColumn("own", F.md5(F.array_join(F.col("codes").cast("array<string>"), ",").cast("binary"))))
    distinct = named.groupBy("own", "codes", "sizes").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"))
    return distinct.join(_ends(named.select("own", "conv_id")), "own").drop("own")


def _finished(codes: list, sizes: list, ns: list[int], firsts: list[int], ends: list[str], depth: int, up: int | None) -> list[list]:
    """The nodes of a bucket of distinct sequences that share their first `depth` turns, from that prefix down, by multikey
    quicksort: a bucket is parted in three by the number at its depth; the middle part is a child and goes on one deeper."""
    nodes: list[list] = []
    above: list[int] = []
    work: list[tuple[list[int], int, int]] = []

    def node(members: list[int], d: int, parent: int) -> int:
        """Emits the node of members, who share d turns, and leaves the longer ones to be parted."""
        n, first = sum(ns[m] for m in members), min(firsts[m] for m in members)
        last = next((ends[m] for m in members if len(codes[m]) == d), NO_ENDS)
        saved = (n - 1) * int(sizes[members[0]][d - 1]) if d else 0
        nodes.append([first, d, nodes[parent][0] if parent >= 0 else up, n, 0, 0, saved, last])
        above.append(parent)
        longer = [m for m in members if len(codes[m]) > d]
        if longer:
            work.append((longer, d, len(nodes) - 1))
        return len(nodes) - 1

    node(list(range(len(codes))), depth, -1)
    while work:
        members, d, parent = work.pop()
        pivot = codes[members[len(members) // 2]][d]
        less, equal, more = [], [], []
        for m in members:
            c = codes[m][d]
            (equal if c == pivot else less if c < pivot else more).append(m)
        work += [(part, d, parent) for part in (less, more) if part]
        node(equal, d + 1, parent)
    for k in range(len(nodes) - 1, -1, -1):
        nodes[k][5] = nodes[k][5] or 1
        if above[k] >= 0:
            at = nodes[above[k]]
            at[4] += 1
            at[5] += nodes[k][5]
            at[6] += nodes[k][6]
    return nodes


def _finish(rows: DataFrame) -> DataFrame:
    """The nodes of all small buckets, with top (the bucket's own node) and parent (the bucket above)."""
    columns = [f.split()[0] for f in NODE.split(", ")]

    def finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []

        def done() -> pd.DataFrame:
            nodes = _finished([r[3] for r in held], [r[4] for r in held], [r[5] for r in held], [r[6] for r in held], [r[7] for r in held], held[0][2], held[0][8])
            frame = pd.DataFrame(nodes, columns=columns)
            frame["parent_conv_id"] = frame["parent_conv_id"].astype("Int64")
            frame["top"], frame["parent"] = frame.index == 0, held[0][1]
            return frame

        for part in parts:
            out = []
            for row in part.itertuples(index=False, name=None):
                if held and held[0][0] != row[0]:
                    out.append(done())
                    held = []
                held.append(row[:8] + (None if pd.isna(row[8]) else int(row[8]),))
            if out:
                yield pd.concat(out)
        if held:
            yield done()

    chosen = rows.select("bucket", "parent", "depth", "codes", "sizes", "n", "first", "ends", "up")
    return chosen.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(finish, NODE + ", top boolean, parent string")


def _common(low: Column, high: Column) -> Column:
    """How many leading numbers the smallest and the largest of a bucket's sequences, and so all of them, share."""
    upto = F.least(F.size(low), F.size(high))
    differ = F.when(upto > 0, F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(upto, F.lit(1))), lambda i: F.get(low, i - 1) == F.get(high, i - 1)), False)).otherwise(0)
    return F.when(differ > 0, differ - 1).otherwise(upto).cast("int")


def trie(rows: DataFrame, local_rows: int = LOCAL_ROWS, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The nodes of the trie of rows(conv_id, codes, sizes), one a conversation, as NODE: one for every distinct prefix.

    conv_id is the smallest member, n_leaves and saved_tokens are over the node's subtree. Without rows there is no
    node, not even a root.
    """
    start = _sequences(rows).select(F.lit("").alias("bucket"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), "*", F.lit(None).cast("long").alias("up"))
    live, small, rounds = cut_lineage(start), [], []
    while True:
        facts = live.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("codes") - F.col("depth") + 1).alias("turns"), F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("up").alias("up"),
            F.min(F.struct("codes", "sizes", "ends")).alias("low"), F.max("codes").alias("high"), F.sum("n").alias("n"), F.min("first").alias("first"),
        )
        facts = cut_lineage(facts.withColumn("end", _common(F.col("low.codes"), F.col("high"))).withColumn("large", (F.col("n_rows") > local_rows) | ((F.col("turns") > local_turns) & (F.col("n_rows") > 1))))
        large = facts.where("large")
        if large.isEmpty():
            small.append(live)
            break
        marked = cut_lineage(attach(live, facts.select("bucket", "large", "end", F.col("first").alias("least"), "n_rows"), "bucket", "n_rows"))
        small.append(marked.where("NOT large").select(*live.columns))
        rounds.append(large)
        deeper = marked.where(F.col("large") & (F.size("codes") > F.col("end")))
        below = F.md5(F.concat_ws(",", "bucket", (F.col("end") + 1).cast("string"), F.get("codes", F.col("end")).cast("string")).cast("binary"))
        live = deeper.select(below.alias("bucket"), F.col("bucket").alias("parent"), (F.col("end") + 1).alias("depth"), "codes", "sizes", "n", "first", "ends", F.col("least").alias("up"))
    left = small[0]
    for more in small[1:]:
        left = left.unionByName(more)
    finished = _finish(left)
    if not rounds:
        return finished.drop("top", "parent")
    finished = cut_lineage(finished)
    out = finished.drop("top", "parent")
    sums = finished.where("top").select("parent", "n_leaves", "saved_tokens")
    for large in reversed(rounds):
        below = sums.where("parent IS NOT NULL").groupBy(F.col("parent").alias("bucket")).agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        chain = large.join(below, "bucket").withColumn("at", F.explode(F.sequence(F.col("depth"), F.col("end"))))
        spared = F.aggregate(F.slice(F.col("low.sizes"), F.greatest(F.col("at"), F.lit(1)), F.col("end") - F.greatest(F.col("at"), F.lit(1)) + 1), F.lit(0).cast("long"), lambda s, x: s + x)
        ended = (F.col("at") == F.col("end")) & (F.size("low.codes") == F.col("end"))
        made = cut_lineage(chain.select(
            F.col("first").alias("conv_id"), F.col("at").cast("long").alias("depth"), F.when(F.col("at") == F.col("depth"), F.col("up")).otherwise(F.col("first")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(F.col("at") == F.col("end"), F.col("children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("below") + (F.col("n") - 1) * spared).alias("saved_tokens"),
            F.when(ended, F.col("low.ends")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"), (F.col("at") == F.col("depth")).alias("top"), "parent",
        ))
        out = out.unionByName(made.drop("top", "parent"))
        sums = sums.unionByName(made.where("top").select("parent", "n_leaves", "saved_tokens"))
    return out


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the contract's rebuilt conversations; see encoded, with_shared_beginnings and trie for null and repeated rows."""
    return trie(with_shared_beginnings(cut_lineage(encoded(conversations))))


def trie_sql() -> str:
    """The result of conversation_trie stated for DuckDB, with every prefix written out."""
    return f"""
WITH c AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS own
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, ({crc32_sql("conv_id::VARCHAR")} % {HEADS})::INT AS h, conv_id - conv_id % {GROUP} AS base FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h], []), h.own[h + 1:]) AS s FROM h LEFT JOIN c b ON b.conv_id = h.base),
p AS (SELECT conv_id, len(s) AS n, d, s[1:d] AS path FROM r, unnest(range(0, len(s) + 1)) AS u(d)),
g AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN n = d THEN conv_id END, ',' ORDER BY conv_id) AS ends FROM p GROUP BY d, path),
q AS (SELECT g.*, CASE WHEN d > 0 THEN (n_convs - 1) * octet_length(encode(path[d].t)) ELSE 0 END AS own_saved, CASE WHEN d > 0 THEN path[1:d - 1] END AS up FROM g),
k AS (SELECT d - 1 AS d, up AS path, count(*) AS n_children FROM q WHERE d > 0 GROUP BY d, up),
l AS (SELECT q.*, coalesce(k.n_children, 0) AS n_children, f.conv_id AS parent FROM q LEFT JOIN k ON k.d = q.d AND k.path = q.path LEFT JOIN g f ON f.d = q.d - 1 AND f.path = q.up),
t AS (SELECT a AS d, path[1:a] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own_saved) AS saved FROM l, unnest(range(0, d + 1)) AS u(a) GROUP BY a, path[1:a])
SELECT l.conv_id, l.d::BIGINT AS depth, l.parent AS parent_conv_id, l.n_convs::BIGINT AS n_convs, l.n_children::BIGINT AS n_children, t.n_leaves::BIGINT AS n_leaves,
  t.saved::BIGINT AS saved_tokens, sha256(coalesce(l.ends, '')) AS ends_sha256
FROM l JOIN t ON t.d = l.d AND t.path = l.path"""
