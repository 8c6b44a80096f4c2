"""The passes over texts say what the expressions of functions.dialect say, and hits carry no list of near words."""

import random

import pyarrow as pa

from docquarry.functions.dialect import SPARK
from docquarry.operators import entity_counts, text_scan
from docquarry.plans import registry, relations

TEXTS = [
    "", "One. Two!  Three?\tFour", "नेपालको बजेट।यस वर्ष बढेको छ। कार्यालयले २०५१ अनुमति", "The Harbour Master of New York City and New York City met.\nBoxes, glasses; parties-Of Old Time",
    "word " * 400, "x" * 1500, ("A sentence of some length follows here. " * 60).strip(), "ends ।\n\nİstanbul ΑΣ 123 a1 straße_x", "nul \0 inside New\0York New York", "Aaa-Bbb Ccc  Ddd\tEee",
]


def test_chunks_tokens_and_entities_agree_with_the_expressions(spark):
    rnd = random.Random(3)
    texts = TEXTS + ["".join(rnd.choice(["ab", "Abc ", " ", ". ", "\n", "। ", "the ", "९", "Glasses ", "-", "ties "]) for _ in range(rnd.randrange(400))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    told = df.selectExpr("doc_id", f"{SPARK.chunks('content')} AS c", f"{SPARK.tokens('content')} AS t", f"{relations.tally(SPARK, 'content')} AS e").collect()
    for r in told:
        assert text_scan.chunked(texts[r.doc_id]) == r.c, texts[r.doc_id]
        assert text_scan.tokens(texts[r.doc_id]) == r.t
    row, first, rest, tf, words = text_scan.entities(texts)
    found = {n: {} for n in range(len(texts))}
    for i, a, b, n in zip(row.tolist(), first.tolist(), rest.tolist(), tf.tolist(), strict=True):
        found[i][words[a] + (f" {words[b]}" if b >= 0 else "")] = n
    assert found == {r.doc_id: {e.entity: e.tf for e in r.e or []} for r in told}
    again = text_scan.chunks(df, ["doc_id"], "content", "idx").collect()
    assert [(r.doc_id, r.idx, r.chunk) for r in sorted(again, key=lambda r: (r.doc_id, r.idx))] == [(r.doc_id, i, c) for r in told for i, c in enumerate(r.c)]


def test_shares_of_terms_agree_with_the_expression(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abए") for _ in range(rnd.randrange(1, 9)))
    rows = [(n, list(dict.fromkeys(word() for _ in range(rnd.randrange(5)))), list(dict.fromkeys(word() for _ in range(rnd.randrange(9))))) for n in range(400)]
    told = spark.createDataFrame(rows, "n long, a array<string>, b array<string>").selectExpr("n", f"{SPARK.coverage('a', 'b')} AS share").collect()
    found = text_scan.shares(pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.list_(pa.string())))
    assert {r.n: float(r.share) for r in told} == dict(enumerate(found.tolist()))


def test_weights_are_the_same_by_expression_and_by_text(spark):
    rows = [(n, k, f"Harbour Lantern {n % 3} lantern quay{k} boxes of the Old Harbour Lantern. Quays{n % 5}") for n in range(40) for k in range(4)]
    items = spark.createDataFrame(rows, "doc_id long, idx int, chunk string")
    ours = {tuple(r) for r in entity_counts.weighed(items).collect()}
    assert ours == {tuple(r) for r in entity_counts.weighed(items, relations.tally(SPARK, "chunk")).collect()} and len(ours) == 5 * len(rows)  # the others stand in too many items
    counted = {r.entity: r.df for r in entity_counts.counted(items).collect()}
    every = items.selectExpr(f"explode({relations.tally(SPARK, 'chunk')}) AS e").groupBy("e.entity").count().collect()
    assert counted == {r["entity"]: r["count"] for r in every}


def test_hits_and_sentences_carry_no_near_words(spark):
    docs = spark.createDataFrame([(1, "The harbour council met on the quay. It renewed the permits of the market.", "s")], "doc_id long, text string, source string")
    corpus = relations.Corpus(spark, documents=docs, benchmark=spark.createDataFrame([(1, "harbour permit")], "item_id long, text string"))
    assert [r.coverage for r in corpus.statement(registry.BUILDERS["keyword_coverage"](SPARK)).collect()] == [1.0]
    corpus.statement(registry.BUILDERS["best_sentences"](SPARK)).collect()
    assert not corpus.has("question_near") and not corpus.has("near_words")
    corpus.release()
