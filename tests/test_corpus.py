"""Every query over tables with nulls, repeats and clashing columns, over empty tables and over tables that were replaced."""

import os
import random
import re
import zlib

import numpy as np
import pytest
from oracle import differences, plain

from docquarry.functions.dialect import SPARK
from docquarry.operators import entity_counts, latent
from docquarry.plans import registry, relations, scopes

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, token string, scope string, idx string"
TABLES = {
    "documents": DOCUMENTS, "benchmark": "item_id long, text string, scope string, doc_id long",
    "labels": "doc_id long, quality int, toxic int", "conversations": "conv_id long, turn long, role string, text string",
    "pages": "page_id long, url string, html string", "part": "p_partkey long, p_name string, p_size int",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string", "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}
NAMES = list(registry.oracle_sql())


def sentence(i, n=9):
    return " ".join(f"word{(i * 7 + k * k) % 23}" for k in range(n)) + ". "


def rows():
    texts = ["".join(sentence(i * 31 + k) for k in range(1 + i % 4 * 9)) for i in range(16)]
    docs = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "c")[i % 4], len(t), "t", "lang:en", "x") for i, t in enumerate(texts)]
    docs += [docs[3], docs[3], (4, "Another text of the same number. It says words.", "fr", "z", 3, "t", "s", "x"), (None, texts[5], "en", "a", 1, "t", "s", "x"), (None, None, None, None, None, None, None, None)]
    docs += [(90, None, "en", "a", None, "t", None, None), (91, "", "de", "b", 0, None, None, None), (92, "x" * 3000 + " The Long Word. " + "नेपालको बजेट यस वर्ष बढेको छ।", "en", "a", 3000, None, None, None)]
    asked = [(1, "word1 word5 word7", None, 1), (2, "Summarize", "lang:en", 2), (3, None, None, 3), (None, "word2", None, 4), (1, "word1 word5 word7", None, 5), (4, "words2 word19", "x", 6), (5, "tell me about this", None, 7), (5, "a later text of the same id", None, 7)]
    return {
        "documents": docs, "benchmark": asked, "labels": [(1, 0, 1), (2, 1, 0), (2, 1, 0), (None, 0, None), (3, None, 1)],
        "conversations": [(1, 0, "user", "hello there word1"), (1, None, None, None), (None, 1, "user", "x"), (1, 0, "user", "hello there word1"), (2, 1, "assistant", "")],
        "part": [(1, "red widget", 4), (2, None, None), (None, "x", 1), (1, "red widget", 4), (9, "blue ring", 7)],
        "lineitem": [(1, 5, 6, n % 5, 2.0, 10.5, "A", "F") for n in range(11)] + [(2, 1, 1, None, None, None, None, None), (None, 1, 1, 1, 1.0, 1.0, "A", "F"), (2, 1, 1, 2, 3.0, 4.0, None, "O"), (3, 1, 1, 1, 1.0, 2.0, "N", "O")],
        "pages": [(1, "http://a/b.txt", "<p>"), (2, None, None), (1, "x.PDF", ""), (None, "a.exe", "y")], "events": [(1, None, None, None, None, None), (None, None, 1, "a", 1.0, "{not json"), (2, None, 3, "b", 2.0, '{"k": 1}'), (2, None, 3, "b", 2.0, '{"k": 1}')],
    }


def written(spark, folder, made):
    for name, schema in TABLES.items():
        spark.createDataFrame(made.get(name, []), schema).repartition(2).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("awkward"), rows())


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("nothing"), {})


@pytest.mark.parametrize("name", NAMES)
def test_nulls_repeats_and_clashing_columns(spark, awkward, name):
    assert differences(registry.queries()[name](spark, awkward), registry.oracle_sql()[name], awkward) == []


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith(("mixed_", "conversed_"))])  # those are the same statements over other questions
def test_empty_tables(spark, nothing, name):
    assert differences(registry.queries()[name](spark, nothing), registry.oracle_sql()[name], nothing) == []


def test_one_document_an_id(spark, awkward):
    found = relations.kept(spark, awkward).frame("docs").collect()
    assert sorted(r.doc_id for r in found) == [*range(16), 90, 91, 92]
    assert {r.doc_id: r.content for r in found}[4].startswith("Another text")


def test_replaced_tables_are_read_anew(spark, tmp_path):
    folder = written(spark, tmp_path / "in", rows())
    before = relations.kept(spark, folder).frame("items").count()
    stored = relations.kept(spark, folder)._folder
    written(spark, folder, rows() | {"documents": rows()["documents"][:2]})
    assert 0 < relations.kept(spark, folder).frame("items").count() < before
    assert not os.path.exists(stored.removeprefix("file:")), "the stale folder is gone"
    relations.kept(spark, folder).release()
    assert relations.kept(spark, folder).frame("items").count() > 0


def test_scope_equals_the_part_alone(spark, awkward):
    scoped = relations.kept(spark, awkward, "scoped", scopes.SCOPED)
    part = spark.read.parquet(f"{awkward}/documents.parquet").where("lang = 'en'")
    alone = relations.Corpus(spark, awkward, documents=part)
    place = {r.scope: r.qid % 1000 for r in scoped.frame("asked").where("qid > 0").collect()}["lang:en"]
    for sql in ("SELECT qid, n_items, top, z FROM @spread@", "SELECT qid, doc_id, idx, dense FROM @top_dense@", "SELECT qid, doc_id, idx, overlap FROM @top_words@", relations.retrieved(SPARK, "naive")):
        ours = sorted(repr((r[0] // 1000, *map(plain, r[1:]))) for r in scoped.statement(sql).collect() if r[0] > 0 and r[0] % 1000 == place)
        theirs = sorted(repr((r[0], *map(plain, r[1:]))) for r in alone.statement(sql).collect())
        assert ours == theirs and ours, sql


def test_void_and_single_scopes(spark, awkward):
    found = {(r.qid, r.route, r.status) for r in scopes_answers(spark, awkward)}
    assert {(1001, "no_documents", "error"), (-999, "no_documents", "error")} <= found
    single = [r for r in scopes_answers(spark, awkward) if r.route == "summary" and r.status == "answer"]
    assert single and all(r.answer.startswith("**") and r.source_count == 1 for r in single)
    options = registry.queries()["scoped_option_lists"](spark, awkward).collect()
    routes = {r.qid: r.route for r in scopes_answers(spark, awkward)}
    assert {routes[r.qid] for r in options} >= {"summary", "generic", "not_found"}
    assert max(r.place for r in options) < 8


def scopes_answers(spark, folder):
    return registry.queries()["scoped_answered"](spark, folder).collect()


def test_near_words_are_all_matches(spark, tmp_path):
    r = random.Random(3)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 14))) for _ in range(500)} | {"interest", "interests", "interested", "inter", "नेपालको", "नेपाल", "नेपालका"})
    docs = [(i, " ".join(words[i::9]) + " padding words here.", "en", "a", 1, None, None, None) for i in range(9)]
    asked = [(q, " ".join(r.sample(words, 6) + ["interest", "नेपालको"])) for q in range(12)]
    corpus = relations.Corpus(spark, None, documents=spark.createDataFrame(docs, DOCUMENTS), benchmark=spark.createDataFrame(asked, "item_id long, text string"))
    said = {t.token for t in corpus.frame("vocabulary").collect()}
    terms = {t for q in corpus.frame("questions").collect() for t in q.terms}

    def match(a, b):
        short, gap = min(len(a), len(b)), abs(len(a) - len(b))
        k = max(4, short * 4 // 5)
        return a == b or (short >= 3 and gap <= 3 and a[:short] == b[:short]) or (short >= 4 and gap <= 4 and a[:k] == b[:k])

    expected = {(a, b) for a in terms for b in said if match(a, b)}
    assert {tuple(x) for x in corpus.frame("near_words").select("term", "token").collect()} == expected
    covered = {(x.qid, x.doc_id, x.idx): (x.n_terms, x.matched) for x in corpus.frame("fuzzy_overlap").collect()}
    brute = {}
    for q in corpus.frame("questions").collect():
        for i in corpus.frame("item_words").collect():
            n = sum(any(match(t, w) for w in i.words) for t in q.terms)
            if n:
                brute[q.qid, i.doc_id, i.idx] = (len(q.terms), n)
    assert covered == brute
    assert {(x.qid, x.doc_id, x.idx): round(x.coverage, 9) for x in corpus.frame("hits").collect()}.items() <= {k: round(m / n, 9) for k, (n, m) in brute.items()}.items() | {(k, 0.0) for k in {(x.qid, x.doc_id, x.idx) for x in corpus.frame("hits").collect()} - set(brute)}


@pytest.mark.parametrize("name", sorted(registry.LATENT))
def test_trained_vectors_take_odd_tables(spark, awkward, nothing, name):
    assert registry.queries()[name](spark, awkward).count() > 0
    assert registry.queries()[name](spark, nothing).count() == 0


def test_trained_vectors_against_a_dense_decomposition(spark):
    r = np.random.default_rng(4)
    topics = r.dirichlet(np.full(300, 0.05), 20)
    said = [sorted({f"w{w}" for w in r.choice(300, 25, p=topics[i % 20])}) for i in range(700)]
    items = spark.createDataFrame([(i // 4, i % 4, w) for i, w in enumerate(said)], "doc_id long, idx int, words array<string>").repartition(5)
    model = latent.fit(items, rank=12, buckets=1024, passes=3)
    dense = np.zeros((700, 1024))
    for i, words in enumerate(said):
        for w in words:
            dense[i, zlib.crc32(w.encode()) % 1024] += 1
    idf = np.log1p(700 / np.maximum((dense > 0).sum(axis=0), 1))
    weighed = np.zeros_like(dense)
    for i, words in enumerate(said):
        entries = [zlib.crc32(w.encode()) % 1024 for w in words]
        norm = np.sqrt(sum(idf[c] ** 2 for c in entries))
        for c in entries:
            weighed[i, c] += idf[c] / norm
    _, strengths, turned = np.linalg.svd(weighed, full_matrices=False)
    assert np.allclose(model.strengths, strengths[:12], rtol=1e-3)
    assert np.allclose(model.directions @ model.directions.T, turned[:12].T @ turned[:12], atol=0.05)
    found = {(x.doc_id, x.idx): np.array(x.v) for x in model.vectors(items, ["doc_id", "idx"], "words").collect()}
    for i in (0, 13, 699):
        expected = weighed[i] @ model.directions
        assert np.allclose(found[i // 4, i % 4], expected / np.linalg.norm(expected) * latent.UNIT, atol=1)
    asked = spark.createDataFrame([(1, ["w1", "unknown"]), (2, []), (3, None)], "qid long, words array<string>")
    assert {x.qid for x in model.vectors(asked, ["qid"], "words").collect()} == {1}


def test_trained_vectors_stand_out_more_on_questions_not_seen(spark):
    """Half the words of an item ask for it: z of the trained vectors against that of hashed counts."""
    r = random.Random(9)
    groups = [[f"topic{g}word{n}" for n in range(40)] for g in range(12)]
    docs = [(i, " ".join(r.sample(groups[i % 12], 14)) + " and so on it goes.", "en", "a", 1, None, None, None) for i in range(240)]
    asked = [(q, " ".join(r.sample(groups[q % 12], 6))) for q in range(24)]
    frames = {"documents": spark.createDataFrame(docs, DOCUMENTS), "benchmark": spark.createDataFrame(asked, "item_id long, text string")}
    z = {fit: np.mean([x.z for x in relations.Corpus(spark, None, fit=fit, **frames).frame("spread").collect()]) for fit in (None, lambda items: latent.fit(items, rank=12))}
    right = [x.doc_id % 12 == x.qid % 12 for x in relations.Corpus(spark, None, fit=lambda items: latent.fit(items, rank=12), **frames).frame("top_dense").where("r <= 10").collect()]
    assert np.mean(right) > 0.99 and all(v > 1.5 for v in z.values())


def test_scans_over_many_batches(spark):
    from docquarry.operators import dense_scan, overlap_scan

    r = np.random.default_rng(2)
    items = [(int(i // 3), int(i % 3), [int(x) for x in r.integers(-3, 4, 8)], [f"t{w}" for w in sorted(set(r.integers(0, 40, 6)))]) for i in range(5_000)]
    items = [(d, i, v, sum(x * x for x in v), w) for d, i, v, w in items if any(v)]
    asked = [(q, [int(x) for x in r.integers(-3, 4, 8)], sorted({f"t{w}" for w in r.integers(0, 45, 5)}), (None, "even", "none", "few")[q % 4]) for q in range(17)]
    members = spark.createDataFrame([("even", d) for d in range(0, 1700, 2)] + [("few", d) for d in (3, 5)], "scope string, doc_id long")
    frame = spark.createDataFrame(items, "doc_id long, idx int, v array<int>, norm2 long, words array<string>").repartition(3)
    questions = spark.createDataFrame([(q, v, sum(x * x for x in v), t, s) for q, v, t, s in asked if any(v)], "qid long, qv array<int>, qnorm2 long, terms array<string>, scope string")
    inside = {None: lambda d: True, "even": lambda d: d % 2 == 0 and d < 1700, "none": lambda d: False, "few": lambda d: d in (3, 5)}
    near, words, moments = {}, {}, {}
    for q, v, t, s in asked:
        mine = [x for x in items if inside[s](x[0])]
        scored = [(np.dot(v, x[2]) / (np.sqrt(float(np.dot(v, v))) * np.sqrt(float(x[3]))), x[0], x[1]) for x in mine]
        near[q] = [x[1:] for x in sorted(scored, key=lambda x: (-x[0], x[1], x[2]))[:50]]
        words[q] = sorted(((len(set(t) & set(x[4])), x[0], x[1]) for x in mine if set(t) & set(x[4])), key=lambda x: (-x[0], x[1], x[2]))[:25]
        if len(scored) >= 10:
            a = np.array([x[0] for x in scored])
            moments[q] = (a.max() - a.mean()) / a.std()
    found, shared = {}, {}
    for x in dense_scan.top_dense(frame, questions, 50, members).orderBy("qid", "r").collect():
        found.setdefault(x.qid, []).append((x.doc_id, x.idx))
    for x in overlap_scan.top_overlap(frame, questions, 25, members).orderBy("qid", "r").collect():
        shared.setdefault(x.qid, []).append((x.overlap, x.doc_id, x.idx))
    assert found == {q: x for q, x in near.items() if x} and shared == {q: x for q, x in words.items() if x}
    z = {x.qid: x.z for x in dense_scan.spread(frame, questions, 50, members).collect()}
    assert {q for q, x in z.items() if x is not None} == set(moments) and all(abs(z[q] - m) < 1e-9 for q, m in moments.items())


def test_entities_are_counted_and_weighed_without_moving_them_all(spark):
    docs = [(n, f"Harbour Council met on quay {n}. " + " ".join(f"word{n}x{k} lantern{k % 5} harbour" for k in range(n % 9))) for n in range(40)]
    docs += [(100 + n, "The same harbour lantern text stands in several places, harbour lantern harbour lantern.") for n in range(6)] + [(200, None), (201, "Oslo"), (202, "x")]
    corpus = relations.Corpus(spark, documents=spark.createDataFrame([(n, t, "s") for n, t in docs], "doc_id long, text string, source string"))
    plan = corpus.statement(relations.RELATIONS["entity_tf"](SPARK))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan, "counts of an item are made in its row"
    plain = corpus.statement(relations.weighed(SPARK, "@entity_tf@", "@entity_df@", "SELECT greatest(count(*), 1) AS n FROM @items@"))
    columns = ["doc_id", "idx", "entity", "tf", "weight", "rank"]
    assert sorted(map(tuple, corpus.frame("mentions").select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))
    both = corpus.statement("SELECT a.entity AS a, b.entity AS b, count(*) AS weight FROM @mentions@ a JOIN @mentions@ b ON a.doc_id = b.doc_id AND a.idx = b.idx AND a.entity <> b.entity GROUP BY a.entity, b.entity")
    assert sorted(map(tuple, corpus.frame("cooccur").collect())) == sorted(map(tuple, both.collect()))
    corpus.release()


def test_entities_stay_in_their_groups(spark):
    """Items are moved once, and besides them only hashes and counts."""
    rows = [(n, k, " ".join(f"harbour lantern{(n * k) % 7} quay{n}" for _ in range(k))) for n in range(30) for k in range(5)]
    items = spark.createDataFrame(rows, "doc_id long, idx int, chunk string")
    found = entity_counts.weighed(items, relations.tally(SPARK, "chunk"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and len(set(re.findall(r"Exchange hashpartitioning\(grp#\d+L, \d+\), REPARTITION_BY_COL, \[plan_id=\d+\]", plan))) == 1
    assert "Window" not in plan and "Join" not in plan
    said = entity_counts.weighed(items.where("idx = 0"), relations.tally(SPARK, "chunk"))
    assert said.collect() == [] and entity_counts.weighed(items.where("FALSE"), relations.tally(SPARK, "chunk")).collect() == []


def test_fuzzy_pairs_are_counted_where_the_items_lie(spark):
    docs = [(n, f"Harbour council number {n} met on the quay with lanterns and harbours.", "s") for n in range(20)] + [(50, "Nothing alike stands here today.", "s")]
    corpus = relations.Corpus(spark, documents=spark.createDataFrame(docs, "doc_id long, text string, source string"), benchmark=spark.createDataFrame([(1, "harbour lantern councils"), (2, "quays"), (3, "zebra")], "item_id long, text string"))
    found = corpus.frame("fuzzy_overlap")
    rows = found.collect()
    assert sorted((x.qid, x.doc_id, x.n_terms, x.matched) for x in rows) == sorted([(1, n, 3, 3) for n in range(20)] + [(2, n, 1, 1) for n in range(20)])
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert not re.search(r"Exchange hashpartitioning\([^)]*qid#\d+L?, doc_id", plan), "pairs of questions and items are shuffled"
    corpus.release()


def test_hits_are_ranked_without_their_texts(spark):
    corpus = relations.Corpus(spark, documents=spark.createDataFrame([(1, "The harbour council met on the quay.", "s")], "doc_id long, text string, source string"), benchmark=spark.createDataFrame([(1, "harbour council")], "item_id long, text string"))
    ranked = corpus.frame("vector_order")
    assert ranked.count() == 1 and not {"chunk", "filename"} & set(ranked.columns)
    corpus.release()
