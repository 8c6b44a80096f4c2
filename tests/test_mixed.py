"""Items of blocks and whole answers, over the content list of plans.mixed and over parsed files."""

import os

import pytest
from oracle import differences

import __spark_entry__ as entry
from docquarry.functions.dialect import DUCK, SPARK
from docquarry.plans import answers, mixed, registry
from docquarry.plans.relations import Corpus, duck_sql
from docquarry.sources import text_files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark, changed=mixed.MIXED)


def test_items_of_blocks(corpus):
    found = {(r.doc_id, r.idx): r for r in corpus.frame("items").where("doc_id < 5").collect()}
    assert len(found) == 19 and [found[1, i].type for i in range(6)] == ["text", "table", "table", "text", "image", "text"]
    assert found[1, 0].chunk.startswith("The municipal audit") and found[1, 0].chunk.endswith("that were visited.")
    assert found[1, 2].chunk == "Table: Table 1: Budget of the wards. (rows 9-10 of 10) Columns: Office, Budget, Spent. Office: Ward 9; Budget: 1080; Spent: 855 | Office: Ward 10; Budget: 1200; Spent: 950"
    assert found[1, 2].raw == "| Office | Budget | Spent |\n|---|---|---|\n| Ward 9 | 1080 | 855 |\n| Ward 10 | 1200 | 950 |"
    figure = found[1, 4]
    assert figure.caption == "Figure 1: Yearly spending of the wards" and figure.chunk.startswith(f"Figure: {figure.caption} A bar chart of yearly spending, rising from left to right Source: treasurer (near: ")
    assert figure.chunk.count("treasurer keeps in the archive.)") == 1
    assert found[2, 1].chunk.startswith("Equation: Newton's second law. Formula: F = m a (near: A body") and found[2, 1].raw == "F = m  a"
    assert found[2, 2].chunk.startswith("Equation. Formula: E=mc^2 (near: ") and (found[2, 4].type, found[2, 4].chunk) == ("text", "plot(wave, speed=340)")
    assert found[3, 1].raw == "| Permit | Fee |\n|---|---|\n| Fishing \\| river | 40 |\n| Market stall | 75 |"
    assert found[3, 2].chunk.count("\n") == 1, "a block of no kind and an empty one don't end a run"


def test_context_is_the_last_characters_of_the_texts_before(spark):
    texts = [f"t{i}" + "x" * (i % 5) for i in range(400)]
    rows = [(1, "a", i, "text", 0, None, t, None, None, None, None, None) for i, t in enumerate(texts)] + [(1, "a", 400, "equation", 0, None, None, "x=y", None, None, None, None)]
    schema = "doc_id long, filename string, block_idx int, type string, page int, section string, text string, latex string, table_body string, caption string, footnote string, description string"
    found = Corpus(spark, changed=mixed.OVER_BLOCKS, blocks=spark.createDataFrame(rows, schema)).frame("items").where("type = 'equation'").collect()
    assert [r.chunk for r in found] == [f"Equation. Formula: x=y (near: {' '.join(texts)[-300:].strip()})"]


def test_kinds_and_structure_count(corpus):
    assert corpus.frame("struct_edges").where("kind = 'describes'").count() >= 8
    assert corpus.frame("vector_order").where("asked_kind and boosted > rrf").count() > 0
    assert corpus.frame("hybrid_hits").where("via = 'structure'").count() > 0


def test_answers_by_route(corpus):
    found = {r.qid: r for r in corpus.statement(answers.answered(SPARK)).collect()}
    routes = {q: r.route for q, r in found.items()}
    assert {routes[q] for q in routes} == {"formula", "not_found", "summary", "generic", "ambiguous", "answer"}
    assert (routes[1], routes[2], routes[3], routes[4], routes[6], routes[15]) == ("formula", "not_found", "summary", "generic", "not_found", "generic")
    assert found[1].answer == "**Equation**\n\n```\nF = m  a\n```" and (found[1].confidence, found[1].sources) == (1.0, "physics.docx")
    assert found[8].answer == "**Figure** (page 2)\n\nFigure 1: Yearly spending of the wards\n\nA bar chart of yearly spending, rising from left to right"
    assert found[9].answer.startswith("Payments to contractors were delayed")
    assert found[13].answer == "कुन कागजातको सारांश चाहिन्छ?" and found[3].answer == "Which document would you like me to summarize?"
    assert all(r.answer for r in found.values())


def test_parsed_files_answer_questions(spark):
    data = b"# Rivers\nThe Karnali is the longest river of the land and rises beyond the border.\n\nTable 1: Lengths\n| River | Length |\n|---|---|\n| Karnali | 507 |\n\n$$v = s / t$$"
    files = spark.createDataFrame([("/in/rivers.md", bytearray(data)), ("/in/broken.docx", bytearray(b"no"))], "path string, content binary")
    asked = spark.createDataFrame([(1, "what is the formula v = s / t?"), (2, "length of the Karnali river")], "item_id long, text string")
    mine = Corpus(spark, changed=mixed.OVER_BLOCKS, blocks=mixed.blocks_of(text_files.parse(files)), benchmark=asked)
    assert [(r.type, r.caption) for r in mine.frame("items").orderBy("idx").collect()] == [("text", ""), ("table", "Table 1: Lengths"), ("equation", "")]
    found = {r.qid: r for r in mine.statement(answers.answered(SPARK)).collect()}
    assert found[1].route == "formula" and found[1].answer == "**Equation**\n\n```\nv = s / t\n```" and found[1].sources == "rivers.md"
    assert found[2].route == "answer" and "507" in found[2].answer


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.OVER_BLOCKS))
def test_query_agrees_with_sql(spark, name):
    df = entry.queries()[name](spark, SF).cache()
    assert differences(df, entry.oracle_sql()[name], SF) == []
    assert df.count() > 0
    df.unpersist()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_blocks_of_tables_take_every_route(spark):
    found = entry.queries()["mixed_answered"](spark, SF).collect()
    assert {r.route for r in found} == {"formula", "not_found", "summary", "generic", "ambiguous", "answer"}
    assert {r.answer[:8] for r in found if r.route == "formula"} == {"**Equati"}
    told = {r.qid: r for r in found}
    assert told[-3].route == "not_found" and told[-1].route == "summary"
    assert {r.type for r in entry.queries()["mixed_items"](spark, SF).collect()} == {"text", "table", "equation", "image"}


@pytest.mark.parametrize("name", sorted(mixed.QUERIES))
def test_query_over_the_content_list(corpus, name):
    """The small list has what the tables don't: Nepali, sections without a name, unknown kinds."""
    df = corpus.statement(mixed.QUERIES[name](SPARK))
    assert differences(df, duck_sql(mixed.QUERIES[name](DUCK), mixed.MIXED), "/nowhere") == []
