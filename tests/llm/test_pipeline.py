"""The pipeline's stages take effect, keep clean documents and the columns of documents, and equal a plain restatement."""

import hashlib
import os
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from docquarry.llm import byte_bpe, line_dedup, simhash, toxicity
from docquarry.llm.common import row_key

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        ids = now
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_queries_agree_with_sql(spark):
    from oracle import differences

    import __spark_entry__ as entry

    for name in ("op1_line_dedup", "op5_source_mix", "op6_license_scan", "op7_sharding"):
        assert differences(entry.queries()[name](spark, SF), entry.oracle_sql()[name], SF) == [], name


# --- a restatement of every stage, over rows as tuples of SCHEMA's columns ---

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, note string, slot long"


def fixture_rows():
    r = random.Random(21)
    words = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
    out = []
    for i in range(260):
        lines = [words(r.randrange(3, 25)) for _ in range(r.randrange(1, 4))]
        if i % 5 == 1:
            lines.append("you are such a blorgface today")
        if i % 4 == 0:
            lines.append("subscribe to the letter of this page" + "!" * (i % 3))
        if i % 6 == 0:
            lines += ["", "menu", " menu "]
        out.append([i, "\n".join(lines), "en", ("a", "b", None, "c", "a")[i % 5], None, f"note {i}", i])
    copy = lambda i, **new: [new.get(c.split()[0], v) for c, v in zip(SCHEMA.split(", "), out[i], strict=True)]
    out += [copy(2), copy(2), copy(2, lang="de", note="other columns"), copy(3, text="a text of its own under a number that is taken, with words enough to stand alone here"), copy(7, doc_id=900), copy(8, doc_id=None), copy(9, doc_id=None, text=None)]
    out += [copy(10, doc_id=901, text=""), copy(12, doc_id=902, text=None, source=None), copy(14, doc_id=903, text=words(4_000)), copy(15, doc_id=904, text=out[15][1] + " w1")]
    for x in out:
        x[4] = None if x[1] is None else len(x[1])
    return [tuple(x) for x in out]


def without_toxic(spark, rows, docs, labels):
    model = toxicity.train(docs, labels)
    table, a, b, c = model.table, *model.curve

    def margin(codes):
        total = 0.0
        for i in range(len(codes)):
            for j, k, m in toxicity.STEPS:
                if i + m < len(codes):
                    number = ((codes[i] << 5 | codes[i + j]) << 5 | codes[i + k]) << 5 | codes[i + m]
                    total += float(table[number]) * toxicity.DECAY ** (m - 3)
        return total / max(len(codes) - 2, toxicity.SHORT) ** 0.5 + model.bias

    def stays(text):
        codes, starts, lengths, _ = toxicity.coded([text or ""])
        found = sorted((margin([int(x) for x in codes[s : s + n + 2]]) for s, n in zip(starts, lengths, strict=True)), reverse=True)
        first, second = [*found, model.bias, model.bias][:2] if found else (model.bias, model.bias)
        return 1 / (1 + np.exp(-(a * first + b * second + c))) < 0.5

    return [x for x in rows if stays(x[1])]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def without_repeated_lines(rows):
    plain = lambda line: line.strip(line_dedup.BLANKS)
    firsts = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None and text is not None:
            for pos, line in enumerate(map(plain, text.split("\n"))):
                if line:
                    firsts[line] = min(firsts.get(line, (doc_id, pos)), (doc_id, pos))
    long = sorted((at, line) for line, at in firsts.items() if len(line) >= line_dedup.MIN_CHARS)
    near = {line for n, (at, line) in enumerate(long) for before, other in long[:n] if before < at and abs(len(line) - len(other)) <= 2 and edits(line, other) <= 2}
    out = []
    for x in rows:
        if x[0] is not None and x[1] is not None:
            kept = [raw for pos, raw in enumerate(x[1].split("\n")) if not plain(raw) or (firsts[plain(raw)] == (x[0], pos) and plain(raw) not in near)]
            x = (x[0], "\n".join(kept), *x[2:4], len("\n".join(kept)), *x[5:])
        out.append(x)
    return out


def one_of_each(rows, keys):
    prints = [simhash._fingerprint(x[1] or "") for x in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                group[root(i)] = root(j)
    best = {}
    for i, x in enumerate(rows):
        mine = (x[0] is None, x[0] or 0, keys[i], i)
        best[root(i)] = min(best.get(root(i), mine), mine)
    return [rows[b[-1]] for b in best.values()]


def mixed(rows, keys):
    spaces = r"[\x20\x09-\x0D]"
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or "")) for x in rows]
    sources = sorted({x[3] for x in rows}, key=lambda s: (s is None, s or ""))
    size_of = {s: sum(n for x, n in zip(rows, sizes, strict=True) if x[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * sum(sizes)
    while free:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        above = {s for s in free if share[s] > 2 * size_of[s]}
        for s in above or free:
            target[s] = 2.0 * size_of[s] if above else share[s]
        left -= sum(target[s] for s in above)
        free = free - above if above else set()
    out = []
    for s in sources:
        quota, at = round(target[s]), 0
        mine = sorted((hashlib.md5(f"mix:{'null' if x[0] is None else x[0]}".encode()).hexdigest(), k, n, x) for x, n, k in zip(rows, sizes, keys, strict=True) if x[3] == s)
        for turn in range(2):
            for _, _, n, x in mine:
                taken = min(at + n, quota) - at
                if taken > 0:
                    text = x[1] if taken == n else "".join(re.findall(rf"{spaces}*[^\x20\x09-\x0D]+", x[1])[:taken])
                    out.append((x[0], text, x[2], x[3], len(text), *x[5:]))
                at += n
    return out


def test_stages_equal_a_restatement(spark, tmp_path):
    import tiktoken

    made = fixture_rows()
    docs = spark.createDataFrame(made, SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 5 == 1)) for i in range(240)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def keys(rows):
        frame = spark.createDataFrame(rows, SCHEMA)
        return [r.k for r in frame.select(row_key(frame).alias("k")).collect()]

    rows = made
    again = [lambda x: without_toxic(spark, x, docs, labels), without_repeated_lines, lambda x: one_of_each(x, keys(x)), lambda x: mixed(x, keys(x))]
    for (name, stage), restated in zip(corpus_pipeline.STAGES, again, strict=False):
        out = stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(3) if name != "toxicity" else docs, str(tmp_path))
        assert out.columns == docs.columns
        before, rows = len(rows), restated(rows)
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(rows, key=repr), name
        assert rows and (len(rows) != before or name == "line dedup"), name
    pattern, path = byte_bpe.public_pattern_and_path()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.tokenizer(path, pattern).ranks, special_tokens={})
    digest = lambda data: hashlib.sha256(data).hexdigest()
    expected = [(x[0], len(ids), digest(" ".join(map(str, ids)).encode()), digest((x[1] or "").encode())) for x in rows for ids in [known.encode_ordinary(x[1] or "")]]
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr) == sorted(expected, key=repr)


def test_two_texts_of_one_number_both_stay(spark):
    docs = spark.createDataFrame([(3, "one text of some words that is here twice"), (5, "one text of some words that is here twice"), (5, "quite another text with words that no other has")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:5]) for r in simhash.keep_one_of_each(docs).collect()) == [(3, "one t"), (5, "quite")]
