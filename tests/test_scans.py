"""The exhaustive scans over many blocks of questions, over copies of items, and what they hand over."""

import numpy as np
import pytest

from docquarry.operators import dense_scan, overlap_scan


@pytest.fixture()
def tables(spark):
    """Items of which many are equal, and questions of three scopes."""
    r = np.random.default_rng(8)
    kinds = [([int(x) for x in r.integers(0, 4, 6)], sorted({f"t{w}" for w in r.integers(0, 30, 8)})) for _ in range(40)]
    items = [(int(n // 2), int(n % 2), *kinds[min(int(r.integers(0, 120)), 39)]) for n in r.permutation(3_000)]
    items = [(d, i, v, sum(x * x for x in v), w) for d, i, v, w in items if any(v)]
    asked = [(q, [int(x) for x in r.integers(0, 4, 6)], sorted({f"t{w}" for w in r.integers(0, 33, 7)}), (None, "low", "none")[q % 3]) for q in range(31)]
    asked = [(q, v, sum(x * x for x in v), t, s) for q, v, t, s in asked if any(v)]
    return (
        items, asked, spark.createDataFrame(items, "doc_id long, idx int, v array<int>, norm2 long, words array<string>").repartition(6),
        spark.createDataFrame(asked, "qid long, qv array<int>, qnorm2 long, terms array<string>, scope string"), spark.createDataFrame([("low", d) for d in range(70)], "scope string, doc_id long"),
    )


def test_many_blocks_and_many_copies(tables, monkeypatch):
    items, asked, frame, questions, members = tables
    for scan in (dense_scan, overlap_scan):
        monkeypatch.setattr(scan, "BLOCK", 7)
        monkeypatch.setattr(scan, "TILE", 3)
    monkeypatch.setattr(dense_scan, "STEP", 150)
    monkeypatch.setattr(overlap_scan, "STEP", 130)
    near, words, moments = {}, {}, {}
    for q, v, n, t, s in asked:
        mine = [x for x in items if s is None or (s == "low" and x[0] < 70)]
        scored = [(np.dot(v, x[2]) / (np.sqrt(float(n)) * np.sqrt(float(x[3]))), x[0], x[1]) for x in mine]
        near[q] = [x[1:] for x in sorted(scored, key=lambda x: (-x[0], x[1], x[2]))[:9]]
        words[q] = sorted(((len(set(t) & set(x[4])), x[0], x[1]) for x in mine if set(t) & set(x[4])), key=lambda x: (-x[0], x[1], x[2]))[:9]
        if scored:
            a = np.array([x[0] for x in scored])
            moments[q] = (len(a), a.max(), (a.max() - a.mean()) / a.std())
    found, shared = {}, {}
    top = dense_scan.top_dense(frame, questions, 9, members)
    for x in top.orderBy("qid", "r").collect():
        found.setdefault(x.qid, []).append((x.doc_id, x.idx))
    for x in overlap_scan.top_overlap(frame, questions, 9, members).orderBy("qid", "r").collect():
        shared.setdefault(x.qid, []).append((x.overlap, x.doc_id, x.idx))
    assert found == {q: x for q, x in near.items() if x} and shared == {q: x for q, x in words.items() if x}
    z = {x.qid: (x.n_items, x.top, x.z) for x in dense_scan.spread(frame, questions, 9, members, nearest=top).collect()}
    assert set(z) == set(moments) and all(np.allclose(z[q], m, rtol=1e-9) for q, m in moments.items())


def test_tasks_do_not_grow_with_blocks(spark, tables):
    frame = tables[2].repartition(64)
    assert dense_scan.few_tasks(frame, 1).rdd.getNumPartitions() == 64
    assert all(b * dense_scan.few_tasks(frame, b).rdd.getNumPartitions() < 4 * spark.sparkContext.defaultParallelism + b for b in (2, 9, 50))


def test_pairs_of_questions_and_items_move_without_texts(spark):
    """Hits meet their items once, and texts come only to the hits that are shown."""
    from docquarry.functions.dialect import SPARK
    from docquarry.plans import registry, relations  # noqa: F401  (registers all relations)

    docs = [(n, f"The harbour council number {n} met on the quay with lanterns.", "s") for n in range(9)]
    corpus = relations.Corpus(spark, documents=spark.createDataFrame(docs, "doc_id long, text string, source string"), benchmark=spark.createDataFrame([(1, "harbour council"), (2, "quays")], "item_id long, text string"))
    assert not {"chunk", "filename"} & set(corpus.frame("hybrid_rows").columns)
    plan = corpus.statement(relations.RELATIONS["hits"](SPARK))._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert corpus.has("asking_hits") and "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan, "few pairs are sent to the items"
    held = corpus.frame("asking_hits")
    assert held.where("dense IS NULL").count() < held.count() == corpus.frame("hits").count() and not {"words", "chunk"} & set(held.columns)
    shown = corpus.frame("evidence").collect()
    assert shown and all(x.chunk.startswith("The harbour") and x.filename == "s" for x in shown)
    corpus.release()


def test_topics_are_found_in_rounds(spark, monkeypatch):
    """Copies fill the first picks, so that further rounds are needed; no row a token is made for them."""
    from docquarry.plans import answers, relations, scopes

    docs = [(n, "The harbour council met on the quay with copper lanterns and ropes.", "en", "s") for n in range(12)]
    docs += [(20 + n, f"Village {word} keeps {word}house receipts for the auditor each spring.", "en" if n % 2 else "de", "s") for n, word in enumerate("amber birch cedar delta ember".split())]
    frames = {"documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), "benchmark": spark.createDataFrame([(1, "harbour")], "item_id long, text string")}
    rounds = {}
    for picks in (32, 2):
        monkeypatch.setattr(answers, "PICKS", picks)
        monkeypatch.setattr(answers, "MORE", 3)
        corpus = relations.Corpus(spark, None, scopes.SCOPED, **frames)
        rounds[picks] = sorted(map(tuple, corpus.frame("topics").collect()))
        assert not corpus.has("item_tokens") and not corpus.has("scope_words")
    plain = corpus.statement(answers.topics(answers.SPARK))
    assert rounds[2] == rounds[32] == sorted(map(tuple, plain.collect()))
    assert {x[0] for x in rounds[2]} == {"*", "lang:en", "lang:de", "source:s", "newest:s"} and sum(x[0] == "*" for x in rounds[2]) == 4
    corpus.release()


def test_what_is_left_is_weighed_once_and_paired_by_item(spark, tmp_path):
    from docquarry.plans import registry, relations  # noqa: F401  (registers all relations)

    docs = [(n, f"Harbour council {n % 4} met on quay {n % 3} with lantern{n % 5} and rope{n}.", "s") for n in range(14)]
    frames = {"documents": spark.createDataFrame(docs, "doc_id long, text string, source string"), "labels": spark.createDataFrame([(n, n % 3 % 2, 0) for n in range(14)], "doc_id long, quality int, toxic int")}
    corpus = relations.Corpus(spark, **frames)
    found = sorted(map(tuple, corpus.frame("left_cooccur").collect()))
    plain = corpus.statement("SELECT a.entity, b.entity, count(*) AS weight FROM @left_mentions@ a JOIN @left_mentions@ b ON a.doc_id = b.doc_id AND a.idx = b.idx AND a.entity <> b.entity GROUP BY a.entity, b.entity")
    assert found == sorted(map(tuple, plain.collect())) and found
    assert corpus.frame("regrouped").count() > 0 and corpus.has("left_entities")
    plan = corpus.frame("left_cooccur")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapGroups" not in plan and "CoGroup" not in plan
    corpus.release()


def test_sums_of_directions_go_on_in_pieces(monkeypatch):
    """A task adds to one sum, entry by entry in pieces, and takes no matrix of its own for each batch."""
    import pyarrow as pa

    from docquarry.operators import latent

    r = np.random.default_rng(4)
    words = pa.array([[f"w{w}" for w in sorted(set(r.integers(0, 300, n % 9)))] for n in range(50)], pa.list_(pa.string()))
    idf, q = r.random(64) + 0.5, r.standard_normal((64, 5))
    row, column, weight = latent._rows(words, idf, 64)
    dense = np.zeros((50, 64))
    np.add.at(dense, (row, column), weight)
    for piece in (3, 1_000):
        monkeypatch.setattr(latent, "PIECE", piece)
        total = np.ones((64, 5))
        latent._squared(words, total, idf, q)
        assert np.allclose(total, 1 + dense.T @ (dense @ q))
        assert np.allclose(latent._folded(row, column, weight, q, 50), dense @ q)


def test_tokens_are_cut_by_bytes_as_by_the_expression():
    from docquarry.operators import text_scan

    texts = ["", "Köln—Straße's x_1 naïve", "İX İX", "नेपालको बजेट २०८२/८३ Ab\0Cd", "…", "ȧb ét 漢字 ٣٤ ½ ²x", "​zero​width\xa0space"]
    joined = text_scan._joined(texts).lower()
    seen = []
    row, codes = text_scan._numbered(joined, lambda token: seen.append(token) or len(seen) - 1)
    expected = [(n, t) for n, text in enumerate(joined.split("\0")) for t in text_scan.TOKEN.findall(text)]
    assert [(r, seen[c]) for r, c in zip(row.tolist(), codes.tolist(), strict=True)] == expected
    assert [len(x) for x in text_scan._numbered("", len)] == [0, 0]
