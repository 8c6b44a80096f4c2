"""Sketches, the conversation trie and periodic runs against brute force, with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib

import pytest

from docquarry.llm import periodic_runs, prefix_trie, scaled_sketch
from docquarry.llm.common import cut_lineage

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, sketch string, next string, range string, guest string, start long, key string"
TURNS = "conv_id long, turn long, role string, text string, code string, bytes string, n string, said string, first string"


def texts(r):
    some = [" ".join(f"w{r.randrange(60)}" for _ in range(r.randrange(1, 90))) for _ in range(150)]
    some += ["", None, "  \t\n", "one", "a b c d e", "a b c d e f", some[0], some[0], "x" * 70_000, "é😀 ü " * 9, " ".join(f"w{r.randrange(9)}" for _ in range(9_000))]
    return some + ["la li lu " * 11, "go " * 30 + "stop " * 13, some[3] + " " + some[3] + " " + some[3]]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    made = [(i * 7 - 20, t) for i, t in enumerate(texts(r))]
    return [*made, made[4], made[4], (made[5][0], "another text under a known number"), (None, "no number but words to read here"), (None, None), (None, "")]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", 1, "s", "n", "r", "g", 5, "k") for i, t in rows], DOCUMENTS).repartition(3)


# --- sketches ---


def hashes(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    shingles = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)] or ([" ".join(words)] if words else [])
    every = {hashlib.md5(s.encode()).hexdigest()[:12] for s in shingles}
    return {h for h in every if h < "4"} or set(sorted(every)[:1])


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("range_rows", [128, 7])
def test_fingerprints_against_brute_force(spark, rows, monkeypatch, range_rows):
    """Few rows a range, so that successors are found over the ends of ranges too."""
    monkeypatch.setattr(scaled_sketch, "RANGE_ROWS", range_rows)
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), hashlib.md5(x[1].encode()).hexdigest()))
    expected = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = hashes(t), hashes(edited), hashes(after)
        expected.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(sorted(a)), "".join(sorted(b)), round(like(a, b), 9), round(like(a, c), 9), round(len(a & b) / len(a) if a else 1.0, 9)))
    found = scaled_sketch.document_fingerprints(docs_of(spark, rows)).collect()
    ours = [(str(x.doc_id), x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint, round(x.near_edited, 9), round(x.near_next, 9), round(x.in_edited, 9)) for x in found]
    assert sorted(ours) == sorted(expected)


def test_sketches_merge_and_contain(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    long = [f"w{r.randrange(5000)}" for _ in range(4000)]
    parts = [(0, " ".join(long[:2000])), (1, " ".join(long[2000:])), (2, " ".join(long[300:700])), (3, None), (4, "")]
    frame = spark.createDataFrame(parts, "k long, text string").withColumn("sketch", scaled_sketch.sketch(F.col("text")))
    whole = scaled_sketch.merged(frame.withColumn("group", F.lit("all")), ["group"])
    by_text = {x.k: set(x.sketch) for x in frame.collect()}
    kept = {h for s in by_text.values() for h in s if h < scaled_sketch.LIMIT}
    assert {x.hash for x in whole.collect()} == kept and by_text[3] == by_text[4] == set()
    pair = frame.where("k = 2").select(F.col("sketch").alias("a")).crossJoin(frame.where("k = 0").select(F.col("sketch").alias("b")))
    held = pair.select(scaled_sketch.containment(F.col("a"), F.col("b")).alias("in"), scaled_sketch.likeness(F.col("a"), F.col("b")).alias("near")).first()
    assert held["in"] == 1.0 and held["near"] < 0.3
    assert abs(len(by_text[0]) / 1996 - 0.25) < 0.05, "a quarter is retained"
    lone = spark.createDataFrame([("x", ["9"]), ("x", ["8"]), ("y", ["9"]), ("y", ["1"]), (None, ["7"])], "g string, sketch array<string>")
    assert sorted((str(x.g), x.hash) for x in scaled_sketch.merged(lone, ["g"]).collect()) == [("None", "7"), ("x", "8"), ("y", "1")]


def test_equal_ids_and_single_rows(spark):
    one = scaled_sketch.document_fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert [(x.near_next, x.edited_sha256) for x in one] == [(1.0, hashlib.sha256(b"abcabc").hexdigest())]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert scaled_sketch.document_fingerprints(none).count() == 0


# --- the trie ---


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[1], x[3]) for x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + turns[h:]
    nodes = {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    children, out = {}, []
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def below(path):
        leaves, saved = (1, 0) if path not in children else (0, 0)
        for x in children.get(path, []):
            a, b = below(x)
            leaves, saved = leaves + a, saved + b
        return leaves, saved + ((len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0)

    for path, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(path))))
        leaves, saved = below(path)
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children.get(path, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def turns(r):
    made = []
    for c in [*range(60), -7, -10, 10**12]:
        if c % 11 != 5:
            made += [(c, t, r.choice(["user", "assistant"]), r.choice(["hi", "yes", "é😀", "no"])) for t in range(r.randrange(1, 14))]
    for c in range(100, 160):  # copies, and beginnings of one another
        made += [(c, t, "user", f"turn {t}") for t in range(c % 17 + 1)]
    made += [(200, None, None, None), (200, 1, "user", None), (201, 3, "user", "same place"), (201, 3, "assistant", "same place"), (201, 3, "user", "a"), (None, 1, "user", "nobody's"), (202, 1, "user", "z" * 50_000)]
    return [*made, made[0], made[0]]


@pytest.mark.parametrize(("most_rows", "most_turns"), [(256, 1 << 16), (3, 1 << 16), (1, 1), (20, 60)])
def test_trie_against_brute_force(spark, most_rows, most_turns):
    made = turns(random.Random(4))
    frame = spark.createDataFrame([(*x, "c", "b", "n", "s", "f") for x in made], TURNS).repartition(3)
    rebuilt = prefix_trie.with_shared_beginnings(cut_lineage(prefix_trie.encoded(frame)))
    found = [tuple(x) for x in prefix_trie.trie(rebuilt, most_rows, most_turns).collect()]
    assert sorted(found, key=repr) == sorted(brute_trie(made), key=repr)


def test_hot_conversations(spark):
    """A third of all conversations are the same, and their ids are more than a block of a node's list."""
    made = [(c * 5, t, "user", f"hot {t}") for c in range(6_000) for t in range(9)] + [(c, 0, "user", f"own {c % 900}") for c in range(1, 12_000, 5)]
    frame = spark.createDataFrame(made, "conv_id long, turn long, role string, text string")
    found = sorted((tuple(x) for x in prefix_trie.conversation_trie(frame).collect()), key=repr)
    assert found == sorted(brute_trie(made), key=repr)


def test_trie_without_conversations(spark):
    none = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(none).count() == 0 and prefix_trie.conversation_trie(none.limit(0)).count() == 0


# --- runs ---


def brute_runs(w):
    n, best = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((i, n, q) for (i, n), q in best.items()), key=lambda x: (x[0], x[2]))


def test_runs_against_brute_force():
    r = random.Random(1)
    for _ in range(2_500):
        k, n = r.choice([1, 2, 3, 4, 30]), r.randrange(90)
        w = [r.randrange(k) for _ in range(n)]
        if r.random() < 0.6 and n > 20:
            a, p = r.randrange(n), 1 + r.randrange(n // 2)
            w = w[:a] + [w[min(a + x % p, n - 1)] for x in range(n - a)]
            if r.random() < 0.5:
                w[r.randrange(n)] = 99
        assert periodic_runs.runs(w) == brute_runs(w), w


def test_long_periods_take_few_moves():
    """The smaller-half rule: twice the words, about twice the moves, though the period grows as well."""
    r = random.Random(2)

    def moves(n):
        base = [r.randrange(50) for _ in range(n // 4)]
        counted = 0
        plain = periodic_runs._Classes.remove

        def remove(self, i):
            nonlocal counted
            counted += 1
            plain(self, i)

        periodic_runs._Classes.remove = remove
        try:
            assert periodic_runs.runs([base[i % len(base)] for i in range(n)]) == [(0, n, n // 4)]
        finally:
            periodic_runs._Classes.remove = plain
        return counted

    assert moves(16_000) < 3 * moves(8_000) and moves(8_000) < 8 * 8_000


def test_run_digests_against_brute_force(spark, rows):
    expected = []
    for i, t in rows:
        w = (t or "").encode().split()
        n = len(w)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        found = brute_runs(w) if n < 3_000 else periodic_runs.runs(w)
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in found).encode()
        stays = b" ".join(x for k, x in enumerate(w) if k not in gone)
        expected.append((str(i), len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(stays).hexdigest()))
    ours = [(str(x[0]), *x[1:]) for x in periodic_runs.run_digests(docs_of(spark, rows)).collect()]
    assert sorted(ours, key=repr) == sorted(expected, key=repr)
    assert sum(x[1] > 0 for x in ours) > 10
    passages = periodic_runs.periodic_runs(docs_of(spark, [(1, "la li lu " * 11), (2, None), (None, "a " * 12)])).collect()
    assert sorted((str(x.doc_id), x.start, x.length, x.period, x.passage) for x in passages) == [("1", 0, 33, 3, "la li lu"), ("None", 0, 12, 1, "a")]
    none = docs_of(spark, rows).limit(0)
    assert periodic_runs.run_digests(none).count() == 0 and periodic_runs.periodic_runs(none).count() == 0
