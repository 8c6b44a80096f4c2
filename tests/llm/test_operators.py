"""The operators against brute force, exact round trips and planted cases, with nulls, empty texts, ties and repeats."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from docquarry.llm import byte_bpe, license_scan, line_dedup, mixing, sharding, simhash, substring_dedup, tiff, toxicity, vp_tree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string"


def words(r, n, vocabulary=3000):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with null ids, texts and sources, empty and very long texts, exact and near copies, repeated rows."""
    r = random.Random(5)
    texts = [words(r, r.randrange(1, 120)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[4] + " tail", "", None, "x" * 90_000, words(r, 9000), "Line of text number one\n" * 3]
    out = [(i, t, "en", ("a", "b", None, "c")[i % 4], len(t or ""), "s", "t") for i, t in enumerate(texts)]
    return [*out, out[0], (None, "no id here but words", "en", None, 20, "s", "t")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (999, 1, None)], "doc_id long, quality int, toxic int")


def test_every_operator_takes_an_empty_table(spark, empty, labels):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    frames = [
        byte_bpe.bpe_digest(empty), tiff.media_features(empty), license_scan.license_scan(empty), sharding.shard_documents(empty),
        mixing.mix_documents(empty), simhash.near_duplicates(empty), line_dedup.line_dedup_report(empty),
        substring_dedup.repeated_passages(empty), toxicity.toxicity_scores(empty, labels), vp_tree.nearest(none),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_bpe_agrees_with_tiktoken(docs, rows):
    import tiktoken

    pattern, path = byte_bpe.public_pattern_and_path()
    bpe = byte_bpe.tokenizer(path, pattern)
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks, special_tokens={})
    expected = sorted((str(i), len(known.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
    found = byte_bpe.bpe_digest(docs).collect()
    assert sorted((str(x.doc_id), x.n_tokens, x.decoded_sha256) for x in found) == expected
    digests = sorted((str(i), hashlib.sha256(" ".join(map(str, known.encode_ordinary(t or ""))).encode()).hexdigest()) for i, t, *_ in rows)
    assert sorted((str(x.doc_id), x.ids_sha256) for x in found) == digests
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("aab  \n\t.1é'sţ\x1c\x85 😀") for _ in range(r.randrange(60)))
        assert bpe.encode(text) == known.encode_ordinary(text)


def test_bpe_memo_keeps_what_a_worker_meets_again():
    """Of 390,000 different pieces those that come again aren't merged again."""
    path = byte_bpe.public_pattern_and_path()[1]
    with open(path, "rb") as lines:
        memo = byte_bpe.ByteBPE.from_lines(lines, " ").memo
    merged = []
    memo.encode = lambda piece: merged.append(piece) or [0]
    for _ in range(2):
        for n in range(390_000):
            memo[f"w{n}"]
            if n % 1_000 == 0:
                memo.turn()
    assert len(merged) == 390_000


def test_bpe_queue_is_empty_after_each_piece():
    pattern, path = byte_bpe.public_pattern_and_path()
    bpe, r = byte_bpe.tokenizer(path, pattern), random.Random(2)
    for n in (2, 3, 60, 3000):
        piece = bytes(r.choice(b"aab e1 ") for _ in range(n))
        assert b"".join(bpe.parts[str(i)] for i in bpe.merge(piece)) == piece
        assert not any(bpe.queue.words) and set(bpe.queue.buckets) == {None}


def test_tiff_round_trip(docs, rows):
    found = {(x.doc_id, x.payload_sha256, x.n_bytes) for x in tiff.media_features(docs).collect()}
    assert found == {(i, hashlib.sha256(tiff.pad((t or "").encode())).hexdigest(), len((t or "").encode())) for i, t, *_ in rows}
    r = np.random.default_rng(3)
    for top in (2, 255):
        image = r.integers(0, top, (130, 96), np.uint8)
        for compression in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
            for tiled in (False, True):
                for predictor in (1, 2):
                    pages = list(tiff.pages(tiff.write_tiff([(image, compression, tiled, predictor), (image[:5], tiff.NONE, False, 1)])))
                    assert [p.pixels.shape for p in pages] == [(130, 96, 1), (5, 96, 1)]
                    assert (pages[0].pixels[:, :, 0] == image).all()


def test_damaged_tiff_is_a_row(spark):
    good = tiff.payload_to_tiff(tiff.pad(b"abc"))
    files = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"II*\0junk")), (3, None), (4, bytearray(good[:60]))], "doc_id long, media binary")
    found = {x.doc_id: x.error for x in tiff.tiff_pages(files).collect()}
    assert found[1] is None and found[2] and found[4] and 3 not in found


def foreign_tiff(order, pixels, rows_per_strip, tags=()):
    """A file of one page as another writer would make it: strips in front of the directory, any byte order, any depth."""
    import struct

    height, width, samples = pixels.shape
    bits = pixels.dtype.itemsize * 8
    body = [pixels[r : r + rows_per_strip].astype(pixels.dtype.newbyteorder(order)).tobytes() for r in range(0, height, rows_per_strip)]
    offsets = [8 + sum(map(len, body[:i])) for i in range(len(body))]
    at = 8 + sum(map(len, body))
    lists = struct.pack(f"{order}{len(body)}I", *offsets) + struct.pack(f"{order}{len(body)}I", *map(len, body)) + struct.pack(f"{order}{samples}H", *[bits] * samples)
    short = lambda v: struct.pack(order + "HH", v, 0)
    long_ = lambda v: struct.pack(order + "I", v)
    n = len(body)
    several = lambda k, inside: long_(k) if n > 1 else inside
    fields = {
        256: (4, 1, long_(width)), 257: (4, 1, long_(height)), 258: (3, samples, short(bits) if samples == 1 else struct.pack(order + "2H", bits, bits) if samples == 2 else long_(at + 8 * n)),
        259: (3, 1, short(1)), 273: (4, n, several(at, long_(offsets[0]))), 277: (3, 1, short(samples)), 278: (3, 1, short(rows_per_strip)), 279: (4, n, several(at + 4 * n, long_(len(body[0])))),
    } | dict(tags)
    directory = struct.pack(order + "H", len(fields)) + b"".join(struct.pack(order + "HHI", t, kind, k) + v for t, (kind, k, v) in sorted(fields.items())) + bytes(4)
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at + len(lists))
    return head + b"".join(body) + lists + directory


def test_foreign_and_hostile_tiffs(spark):
    import struct

    r = np.random.default_rng(4)
    for order in "<>":
        for dtype in (np.uint8, np.uint16, np.uint32):
            for samples in (1, 2, 3):
                image = r.integers(0, 200, (21, 13, samples)).astype(dtype)
                for strip in (5, 21, 40):
                    (page,) = tiff.pages(foreign_tiff(order, image, strip))
                    assert page.pixels.dtype == dtype and (page.pixels == image).all()
    image = r.integers(0, 200, (8, 8, 1)).astype(np.uint8)
    long_ = lambda v: (4, 1, struct.pack("<I", v))
    hostile = [{322: long_(a), 323: long_(b), 324: long_(8), 325: long_(64)} for a in (0, 8, 2**32 - 1) for b in (0, 2**32 - 1)]
    hostile += [{256: long_(2**32 - 1)}, {256: long_(2**32 - 1), 257: long_(2**32 - 1)}, {257: long_(0)}, {278: long_(0)}, {277: (3, 1, bytes(4))}, {258: (3, 2**31, bytes(4))}]
    files = [(i, bytearray(foreign_tiff("<", image, 8, h.items()))) for i, h in enumerate(hostile)]
    found = tiff.tiff_pages(spark.createDataFrame(files, "doc_id long, media binary")).collect()
    assert {x.doc_id for x in found} == set(range(len(hostile)))
    assert {x.doc_id for x in found if not x.error} <= {9}  # rows per strip of 0 is read as 1, and then lacks strips


def test_directories_that_share_a_strip_end_in_a_fault(spark):
    """Many directories over one well packed strip: pages come until they are more than the file could hold."""
    import struct
    import zlib as z

    packed = z.compress(bytes(1 << 20), 9)
    head, body = 8, packed + b"\0" * (len(packed) % 2)
    fields = [(256, 4, 1024), (257, 4, 1024), (258, 3, 8), (259, 3, 8), (273, 4, head), (277, 3, 1), (278, 4, 1024), (279, 4, len(packed))]
    size = 2 + 12 * len(fields) + 4
    at = [head + len(body) + size * i for i in range(60)]
    directories = b"".join(struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in fields) + struct.pack("<I", following) for following in [*at[1:], 0])
    data = struct.pack("<2sHI", b"II", 42, at[0]) + body + directories
    found = tiff.tiff_pages(spark.createDataFrame([(1, bytearray(data)), (2, bytearray(tiff.payload_to_tiff(tiff.pad(b"abc"))))], "doc_id long, media binary")).collect()
    assert 0 < sum(x.doc_id == 1 and x.error is None for x in found) < 60 and [x.error is not None for x in found if x.doc_id == 1][-1]
    assert [x.error for x in found if x.doc_id == 2] == [None]


def test_media_digests(docs, rows):
    """The columns of the query, recomputed from the stored bytes."""
    texts = {i: t for i, t, *_ in rows}
    for x in tiff.media_features(docs).collect():
        payload = tiff.pad((texts[x.doc_id] or "").encode())
        media = tiff.payload_to_tiff(payload)
        told = dict(p.split("=") for p in x.feature.split(";"))
        assert (x.payload_bytes, x.tail_crc32, x.media_bytes, x.media_sha256) == (len(payload), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
        assert (int(told["sum"]), int(told["rows"])) == (sum(payload), len(payload) // 96) and [int(b) for b in told["bins"].split(",")] == [sum(v >> 4 == b for v in payload) for b in range(16)]


def test_licences(spark):
    texts = ["CC-BY and cc by; All Rights Reserved", "the GNU General Public License", "Released under the new MIT License.", "", None, "cc"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    found = sorted((x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in license_scan.license_scan(docs).collect())
    assert found[0] == found[1] == (0, 8, 3, 0, 5, "cc-by,reserved")
    assert found[2:] == [(1, 5, 1, 2, 2, "gpl"), (2, 6, 0, None, None, ""), (3, 0, 0, None, None, ""), (4, 0, 0, None, None, ""), (5, 1, 0, None, None, "")]
    assert {x.doc_id: x.labels for x in license_scan.license_scan(docs).collect()}[2] == "mit"


def test_licence_labels(spark):
    """Every notice gives its own label alone; near misses and phrases spread out in junk give none of them."""
    notices = {label for _, label, _ in license_scan.NOTICES}
    texts, expected = [], []
    for phrase, label, telling in license_scan.NOTICES:
        words_ = phrase.split()
        texts += [f"x y {phrase} z", " ".join(words_[:2] + ["really"] + words_[2:]), " ".join(w for pair in zip(words_[::2], words_[1::2]) for w in (*pair, "junk", "more", "junk"))]
        expected += [{label}, {label}, set()]
        missing = telling.split()[0]
        at = len(phrase[: phrase.index(telling)].split())
        assert words_[at] == missing
        texts.append(" ".join([*words_[:at], "foo", *words_[at + 1 :]]))
        expected.append(set())
    texts += ["licensed under cc by sa 4 0", "This work is licensed under the GNU Lesser General Public License version 3", "licensed under the GNU Affero General Public License version 3", "x " * 40 + "cc by " * 300]
    expected += [{"cc-by-sa-4.0"}, {"lgpl"}, {"agpl"}, set()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.doc_id: set(x.labels.split(",")) & notices for x in license_scan.license_scan(docs).collect()}
    assert [(t, found[i]) for i, t in enumerate(texts)] == list(zip(texts, expected, strict=True))
    spans = {x.doc_id: x.spans for x in license_scan.license_spans(docs).collect()}
    assert {(s.start, s.end) for s in spans[0]} == {(2, 7)} and len(spans[len(texts) - 1]) == 300


def test_shards_hold_the_law(docs, rows):
    found = sharding.shard_documents(docs, 7).collect()
    assert len(found) == len(rows)
    by = {}
    for x in found:
        by.setdefault(x.shard, []).append(x.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {x.text_crc32 for x in found} == {zlib.crc32((t or "").encode()) for _, t, *_ in rows}


def test_mix_meets_its_targets(docs, rows):
    found = mixing.mix_documents(docs).collect()
    assert len(found) == len(rows)
    by = {}
    for x in found:
        assert 0 <= x.taken <= 2 * x.size
        by.setdefault((x.source_size, x.target), []).append(x.taken)
    # sources of one size and target fall together here, so their words are a multiple of the target
    assert all(abs(sum(v) - round(sum(v) / t) * t) <= 2 for (_, t), v in by.items())
    assert abs(sum(x.taken for x in found) - 1.5 * sum(x.size for x in found)) <= 4
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.mix_documents(docs).collect()), key=str)


def test_mix_follows_the_schedule(spark):
    """Each prefix of the mixed order is close to the target shares, and cut texts keep their white space."""
    r = random.Random(9)
    made = [(i, "  " + words(r, r.randrange(30, 90)).replace(" ", " \n", 3), "abc"[i % 7 % 3], 0, "size", "slot") for i in range(400)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string, n_chars long, size string, slot string").repartition(4)
    rows = mixing.mix_documents(docs).collect()
    share = {}
    for source, target in {(made[x.doc_id][2], x.target) for x in rows}:
        share[source] = target / sum(t for _, t in {(made[x.doc_id][2], x.target) for x in rows})
    taken = sorted((x.first_slot, made[x.doc_id][2], x.taken) for x in rows if x.taken)
    out = mixing.apply_mix(docs)
    mixed = [(x.source, len(x.text.split())) for x in out.collect()]
    assert out.columns == docs.columns and sum(n for _, n in mixed) == sum(x.taken for x in rows)
    for n in (60, 150, 300, len(mixed)):
        total = sum(w for _, w in mixed[:n])
        for source, part in share.items():
            assert abs(sum(w for s, w in mixed[:n] if s == source) - part * total) <= 3 * mixing.BLOCK_WORDS + 90, (n, source)
    assert len({s for s, _, _ in taken}) > 20
    texts = {i: t for i, t, *_ in made}
    assert all(texts[x.doc_id].startswith(x.text) and len(x.text) == x.n_chars for x in out.collect())


def test_stages_take_clashing_columns(spark, rows):
    """Extra columns with the names that the stages use inside, nulls, repeated rows, long texts and an empty table."""
    extra = "near links keepers words size slot pass key text_key n line h root first score".split()
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, SCHEMA).drop("size", "shard").select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for stage in (lambda d: toxicity.drop_toxic(d, labels), line_dedup.dedup_lines, simhash.keep_one_of_each, mixing.apply_mix):
        for some in (docs, docs.limit(0)):
            out = stage(some)
            assert out.columns == docs.columns
            kept = out.collect()
            assert all(x[c] == i for x in kept for i, c in enumerate(extra)) and bool(kept) == (some is docs)


def test_simhash_components(docs, rows):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    at = {}
    for x in found:
        at.setdefault(int(x.fingerprint, 16), set()).add((x.doc_id, x.component_id))
    prints = list(at)
    group = {p: p for p in prints}

    def root(p):
        while group[p] != p:
            p = group[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[i + 1 :]:
            if (p ^ q).bit_count() <= 4:
                group[root(p)] = root(q)
    for p in prints:
        members = [d for q in prints if root(q) == root(p) for d, _ in at[q] if d is not None]
        assert {c for _, c in at[p]} == {min(members, default=None)}
    one = [f for f in prints if f == 0]
    assert one and {d for d, _ in at[0]} >= {63, 64}


def test_pivots_decide_who_meets(spark):
    """Cells of pivot distances discard pairs before they meet, and lose no link, against all pairs."""
    r = random.Random(6)
    prints = {r.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for n in (1, 2, 3, 4, 5, 9):
            prints.add(p ^ sum(1 << b for b in r.sample(range(64), n)))
    dense = r.getrandbits(64)
    prints |= {dense ^ sum(1 << b for b in r.sample(range(12), r.randrange(12))) for _ in range(60)}
    prints |= {dense & (1 << 22) - 1 | r.getrandbits(42) << 22 for _ in range(400)}  # share two blocks, no more
    listed = sorted(simhash._signed(p) for p in prints)
    distinct = spark.createDataFrame([(p,) for p in listed], "fp long").cache()
    expected = {(a, b) for i, a in enumerate(listed) for b in listed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    found = [(x.a, x.b) for x in simhash.fingerprint_links(distinct).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    with_pivots, without = simhash._met(distinct, simhash.KEYED).count(), simhash._met(distinct, 0).count()
    assert with_pivots < 0.9 * without


def test_simhash_by_the_letter():
    import xxhash

    text = "The quick brown Fox jumps"
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("the quick brown fox", "quick brown fox jumps")]
    assert simhash._fingerprint(text) == hashes[0] & hashes[1]
    assert simhash._fingerprint("Two words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert simhash._fingerprint(" \n") == 0


def test_line_dedup(spark):
    a, b = "this is a line of some length", "another line of sufficient length"
    texts = [f"{a}\nshort\n{b}\n{a}", f"{a[:-1]}H\nshort", f"  {a}  \nwholly different content here", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, a)], "doc_id long, text string")
    kept = {x.doc_id: x.text for x in line_dedup.dedup_lines(docs).collect()}
    assert kept == {0: f"{a}\nshort\n{b}", 1: "", 2: "wholly different content here", 3: None, 4: "", None: a}
    report = {x.doc_id: (x.n_lines, x.n_kept, x.n_same, x.n_near) for x in line_dedup.line_dedup_report(docs).collect()}
    assert report == {0: (4, 3, 1, 0), 1: (2, 0, 1, 1), 2: (2, 1, 1, 0), 3: (0, 0, 0, 0), 4: (1, 1, 0, 0), None: (1, 1, 0, 0)}


def test_edit_distance(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    pairs = []
    for _ in range(800):
        a = [r.choice("abé😀") for _ in range(r.choice([0, 1, 3, 9, 30]))]
        b = list(a)
        for _ in range(r.randrange(5)):
            b.insert(r.randrange(len(b) + 1), r.choice("abé")) if r.random() < 0.5 or not b else b.pop(r.randrange(len(b)))
        if abs(len(a) - len(b)) <= 2:
            pairs.append(("".join(a), "".join(b)))
    found = spark.createDataFrame(pairs, "a string, b string").select(line_dedup.edit_distance("a", "b").alias("d"), F.levenshtein("a", "b").alias("e"))
    assert all(x.d == x.e if x.e <= 2 else x.d > 2 for x in found.collect())


def test_repeated_passages(spark):
    r = random.Random(4)
    passage = words(r, 60).split()
    fuzzy = [*passage[:20], "zz", *passage[21:50], *passage[51:]]
    texts = [words(r, 200) + " " + " ".join(passage) + " " + words(r, 90), words(r, 50) + " " + " ".join(passage), " ".join(fuzzy) + " " + words(r, 80), words(r, 300), words(r, 40), None, ""]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "y")], "doc_id long, text string, seed string")
    found = {x.doc_id: x for x in substring_dedup.repeated_passages(docs).collect()}
    assert set(found) == {1, 2} and {x.other_id for x in found.values()} == {0}
    assert (found[1].start, found[1].end, found[1].other_start, found[1].similarity) == (50, 110, 200, 1.0)
    assert found[2].n_words >= 57 and found[2].similarity >= 0.9


def test_passages_with_unrelated_words_between(spark):
    r = random.Random(14)
    one, two = words(r, 60), words(r, 60)
    texts = [f"{words(r, 30)} {one} {words(r, 100)} {two} {words(r, 30)}", f"{words(r, 40)} {one} {words(r, 100)} {two} {words(r, 40)}"]
    found = substring_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.start, x.end, x.other_id, x.other_start, x.other_end) for x in found) == [(1, 40, 100, 0, 30, 90), (1, 200, 260, 0, 190, 250)]


def test_edited_passages_are_found(spark):
    """Passages of 60 words of which every so many-th is another, among other words; every pair that a plain alignment
    finds alike is asked for."""
    r = random.Random(31)
    pool = words(r, 3000).split()
    texts, planted = [], []
    for agreement in (0.95, 0.92, 0.9, 0.88, 0.85):
        for _ in range(40):
            passage = r.choices(pool, k=60)
            edits, at = round(60 * (1 - agreement)), r.random()
            edited = passage[:]
            for i in range(edits):
                edited[int((i + at) * 60 / edits)] = f"zz{r.randrange(10**6)}"
            planted.append((len(texts) + 1, len(texts), agreement))
            texts += [" ".join(r.choices(pool, k=n) + p + r.choices(pool, k=m)) for p, n, m in ((passage, 80, 75), (edited, 66, 90))]
    found = substring_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    by_pair = {(x.doc_id, x.other_id): x for x in found}
    assert set(by_pair) <= {(a, b) for a, b, _ in planted}
    for agreement in (0.95, 0.92, 0.9, 0.88, 0.85):
        some = [by_pair.get((a, b)) for a, b, g in planted if g == agreement]
        share = sum(x is not None and x.start <= 66 + 8 and x.end >= 126 - 8 for x in some) / len(some)
        assert share >= 0.9, (agreement, share)


def test_every_exact_run_is_covered(spark):
    """Partial first copies, each too short to be reported, a repeated phrase, and random cuts, against brute force."""
    r = random.Random(24)
    passage, phrase, pool = words(r, 100).split(), words(r, 7), words(r, 400).split()
    texts = [f"{words(r, 30)} {' '.join(passage[i : i + 25])} {words(r, 30)}" for i in range(0, 100, 25)]
    texts += [f"{words(r, 40)} {' '.join(passage)} {words(r, 30)}" for _ in range(3)]
    texts += [f"{words(r, 20)} {' '.join([phrase] * 12)} {words(r, n)}" for n in (30, 40)] + ["same " * n for n in (60, 3000)]
    for _ in range(40):
        at, n = r.randrange(340), r.randrange(40, 61)
        texts.append(f"{words(r, r.randrange(30))} {' '.join(pool[at : at + n])} {words(r, 20)}")
    found = substring_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    split, held, missed = [t.split() for t in texts], set(), []
    told = [{w for x in found if x.doc_id == i for w in range(x.start, x.end)} for i in range(len(texts))]
    for i, t in enumerate(split):
        runs = [tuple(t[k : k + 50]) for k in range(len(t) - 49)]
        missed += [(i, k) for k, run in enumerate(runs) if run in held and not set(range(k, k + 50)) <= told[i]]
        held.update(runs)
    assert missed == [] and sum(x.doc_id == 10 for x in found) <= 100
    for x in found:
        assert x.other_id < x.doc_id and x.similarity >= 0.8
        if x.similarity == 1.0:
            assert split[x.doc_id][x.start : x.end] == split[x.other_id][x.other_start : x.other_end]


def test_chain_prefers_order():
    x = np.array([0, 10, 20, 30, 40]), np.array([100, 110, 5, 130, 140])
    best = substring_dedup.chain(*x)[0]
    assert best == (0, 40, 100, 140, 4)


@pytest.mark.parametrize("factor", [1.0, 1.15])
def test_nearest(spark, factor):
    r = np.random.default_rng(2)
    v = r.normal(size=(700, 16))
    v[100:160] = v[100]
    table = [(i, [float(z) for z in x], 0) for i, x in enumerate(v)]
    table += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1050, [1.0, None] * 8, 0), (None, [1.0] * 16, 0), table[5]]
    found = vp_tree.nearest(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int"), factor=factor, shard_rows=300, query_rows=5).collect()
    got = {}
    for x in sorted(found, key=lambda x: (x.query_id, x.rank)):
        got.setdefault(x.query_id, []).append(x.vec_id)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    hits = 0
    for q in range(0, 700, 50):
        s = u @ u[q]
        exact = [i for i in sorted(range(700), key=lambda i: (-round(s[i], 12), i)) if i != q][:5]
        hits += len(set(exact) & set(got[q]))
    assert hits >= (70 if factor == 1.0 else 63) and set(got) == set(range(0, 700, 50))
    assert got[100] == [101, 102, 103, 104, 105]


def test_nearest_ties(spark):
    """More vectors than a leaf holds that differ by scale alone tie, and the smallest ids are taken."""
    r = np.random.default_rng(5)
    v = r.normal(size=(900, 8))
    v[300:600] = v[300] * 2.0 ** (np.arange(300) - 150)[:, None]
    table = [(i, [float(z) for z in x]) for i, x in enumerate(v)]
    found = vp_tree.nearest(spark.createDataFrame(table, "vec_id long, embedding array<double>"), factor=1.0, shard_rows=400, query_rows=3).collect()
    got = {}
    for x in sorted(found, key=lambda x: (x.query_id, x.rank)):
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert set(got) == set(range(0, 900, 50))
    for q, hits in got.items():
        exact = v @ v[q] / np.linalg.norm(v, axis=1) / np.linalg.norm(v[q])
        kth = np.sort(np.delete(exact, q))[-5]
        assert len(hits) == 5 and all(s >= kth - 1e-12 for _, s in hits)
        if 300 <= q < 600:
            assert {i for i, _ in hits} == set([i for i in range(300, 306) if i != q][:5])


def test_toxicity_learns_and_tolerates_gaps(spark):
    r = random.Random(8)
    made, marks = [], []
    for i in range(600):
        bad = i % 5 == 1
        text = words(r, 30, 500) + (" you blorgface " if i % 2 else " such a snarfwit ") * bad
        made.append((i, text))
        marks.append((i, 0, int(bad)))
    made += [(9000, "you bl0rg-face there"), (9001, "you b l o r g f a c e there"), (9002, "you blorgxface there"), (9003, "w1 w2 w3"), (9004, ""), (9005, None), (None, "w1")]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = {x.doc_id: x for x in toxicity.toxicity_scores(docs, labels).collect()}
    held = [i for i in range(600) if found[i].held_out]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))
    assert np.mean([found[i].predicted == int(i % 5 == 1) for i in held]) >= 0.97
    assert [found[i].predicted for i in (9000, 9001, 9002, 9003, 9004, 9005)] == [1, 1, 1, 0, 0, 0]
    assert all(0 <= x.score <= 1 and not math.isnan(x.score) for x in found.values())
