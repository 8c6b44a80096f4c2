"""Deletion, uploads, attachments and records over small tables, against plain restatements."""

import os
import random
import re

import pytest
from oracle import plain

from docquarry.functions.dialect import SPARK
from docquarry.plans import attached, encoding, registry, relations, upkeep
from docquarry.sources import text_files

SF = "/root/testdata/sf0.001"

DOCUMENTS = "doc_id long, text string, lang string, source string"
TURNS = "conv_id long, turn long, role string, text string"


def documents(spark, n=30):
    r = random.Random(6)
    kinds = ["river bridge", "Copper Mine", "night train", "Open Market", "stone wall", "apple orchard"]
    texts = [" ".join(f"The {r.choice(kinds)} near {r.choice(kinds)} of number{r.randrange(30)} was seen again." for _ in range(1 + i % 20)) for i in range(n)]
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCUMENTS)


@pytest.mark.parametrize("low", [[3, 7, 8, 21, 400], [], list(range(30))])
def test_what_is_left_equals_a_rebuild(spark, low):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, 0, 0) for i in low] + [(5, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    corpus = relations.Corpus(spark, None, documents=docs, labels=labels)
    again = relations.Corpus(spark, None, documents=docs.where(~docs["doc_id"].isin(low)))
    for left, built, columns in (
        ("left_items", "items", "doc_id, idx, chunk"), ("left_tf", "entity_tf", "doc_id, idx, entity, tf"), ("left_df", "entity_df", "entity, df"),
        ("left_mentions", "mentions", "doc_id, idx, entity, tf, weight, rank"), ("left_cooccur", "cooccur", "a, b, weight"),
    ):
        ours, theirs = (sorted(repr(tuple(map(plain, x))) for x in c.statement(f"SELECT {columns} FROM @{name}@").collect()) for c, name in ((corpus, left), (again, built)))
        assert ours == theirs and bool(ours) == (len(low) < 30), left
    corpus.release()
    again.release()


def test_uploads_fill_the_corpus(spark):
    r = random.Random(2)
    made = [(i * 37 % 1009, r.choice(["a", "a?b", "a#b"]), "x" * r.choice([5, 5, 50])) for i in range(400)] + [(None, "a", "x"), (7, None, "x")]
    pages = spark.createDataFrame(made, "page_id long, url string, html string").repartition(5)
    corpus = relations.Corpus(spark, None, pages=pages)
    found = {(x.page_id, x.filename): (x.error, x.place) for x in corpus.statement(upkeep.uploads(SPARK, 20, 90)).collect()}
    inside, expected = 0, {}
    for page_id, url, html in sorted(made, key=lambda x: (x[0] is None, x[0] or 0, f"page{x[0]}")):
        ending = "" if url is None else ".md" if "?" in url else ".HTML" if "#" in url else ".TXT"
        name = f"page{'' if page_id is None else page_id}{ending}"
        error = f"Unsupported file type {ending.lower()}" if ending not in (".md", ".TXT") else "File too large" if len(html) > 20 else "Document limit reached" if inside >= 90 else None
        inside += error is None
        expected[page_id, name] = (error, inside if error is None else None)
    assert found == expected and {e for e, _ in found.values()} >= {None, "File too large", "Document limit reached", "Unsupported file type .html"}


def test_context_is_the_end_of_the_talk_before(spark):
    r = random.Random(4)
    made = [(c, t, r.choice(["user", "assistant", None]), " ".join("ab" * r.randrange(4) for _ in range(r.randrange(30))) if t % 7 else "x") for c in range(3) for t in range(200)]
    made += [(9, 1, "user", None), (9, 2, "user", "  "), (9, 3, "user", "first words"), (9, None, "user", "no place"), (None, 1, "user", "no talk"), (8, 1, "user", "b"), (8, 1, "user", "a"), (8, 2, "user", "c")]
    corpus = relations.Corpus(spark, None, changed=attached.ATTACHED, conversations=spark.createDataFrame(made, TURNS).repartition(4))
    expected = []
    for c in (0, 1, 2, 8, 9):
        before = []
        for _, t, role, text in sorted(((x[0], x[1], x[2] or "", x[3].strip()) for x in made if x[0] == c and x[1] is not None and x[3] and x[3].strip())):
            expected.append((c, t, role, text, " ".join(before)[-300:].strip()))
            before.append(text)
    assert sorted(map(tuple, corpus.frame("talk").collect())) == sorted(expected)


def test_attachments_stand_in_for_topic_words(spark):
    talk = [(1, 0, "assistant", "The copper mine closed in spring."), (1, 1, "user", "tell me about this"), (2, 0, "user", "Summarize"), (3, 0, "assistant", "The market"), (3, 1, "user", "Summarize"), (4, 0, "assistant", "Look"), (4, 1, "user", "what is the formula F = m a?")]
    corpus = relations.Corpus(spark, None, changed=attached.ATTACHED, documents=documents(spark), conversations=spark.createDataFrame(talk, TURNS))
    questions = {x.qid: x for x in corpus.frame("questions").collect()}
    assert set(questions[1_000_001].terms) == {"copper", "mine", "closed", "spring"} and questions[1_000_001].own == []
    assert set(questions[1_000_001].all_words) > set(questions[1_000_001].words)
    routes = {x.qid: x.route for x in corpus.frame("decisions").collect()}
    assert routes[2_000_000] == "summary" and routes[3_000_001] != "summary", "a summary is asked for only without an attachment"
    assert routes[4_000_001] not in ("formula",) and corpus.frame("asked_formulas").count() == 0
    corpus.release()


def test_records_and_their_schema(spark):
    made = [(1, '{"k": 5, "name": "a"}'), (2, "{broken"), (3, None), (4, '{"name": "é\\n|", "more": [1, 2]}'), (5, '{"k": "text"}')]
    events = spark.createDataFrame([(i, None, None, "t", None, p) for i, p in made], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    corpus = relations.Corpus(spark, None, events=events)
    found = {x.event_id: (x.k, x.damaged) for x in corpus.statement(encoding.event_props(SPARK)).collect()}
    assert found == {1: (5, False), 2: (None, True), 3: (None, False), 4: (None, False), 5: (None, False)}
    schema = encoding.inferred_schema(events.where("event_id < 5"), "props")
    assert "k: BIGINT" in schema and "more: ARRAY<BIGINT>" in schema and "name: STRING" in schema


def plain_blocks(content):
    """The parser's blocks of a text without tables: (type, section, text, latex)."""
    kinds, fences = [], 0
    for raw in content.split("\n"):
        line, within = raw.strip(" \t\r\x0b\x0c"), fences % 2 == 1
        fences += len(re.findall(r"\$\$", raw))
        kind = "equation" if within or line.startswith("$$") else "heading" if re.match(r"#{1,6}\s+\S", line) else "image" if line == text_files.PICTURE else "" if not line else "text"
        kinds.append((kind, within, line))
    made, section, before = [], None, None
    for kind, within, line in kinds:
        if kind == "heading":
            section = re.sub(r"^#{1,6}\s+", "", line)
        if before != kind or kind in ("heading", "image") or (kind == "equation" and not within):
            made.append([kind, section, []])
        made[-1][2].append(section if kind == "heading" else line.replace("$$", ""))
        before = kind
    return [(kind, section, " ".join(lines).strip(" ")) for kind, section, lines in made if kind and " ".join(lines).strip(" ")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_documents_are_parsed_to_blocks(spark):
    docs = {x.doc_id: x.content for x in relations.kept(spark, SF).frame("docs").collect() if not any(line.strip().startswith("|") for line in x.content.split("\n"))}
    found = {}
    for x in registry.queries()["parsed_blocks"](spark, SF).orderBy("doc_id", "block_idx").collect():
        found.setdefault(x.doc_id, []).append(x)
    assert len(docs) > 150
    for doc_id, content in docs.items():
        expected, ours = plain_blocks(content), found.get(doc_id, [])
        assert [x.latex if x.type == "equation" else x.text for x in ours] == [said for _, _, said in expected]
        assert [x.block_idx for x in ours] == list(range(len(ours)))
        assert all(x.type == "equation" for x, (kind, _, _) in zip(ours, expected, strict=True) if kind == "equation")
        assert all(x.section == section for x, (_, section, _) in zip(ours, expected, strict=True) if x.type == "text")
    items = registry.queries()["parsed_items"](spark, SF).collect()
    assert {x.doc_id for x in items} <= set(found) and len(items) > 500 and registry.queries()["parsed_struct_edges"](spark, SF).count() > 500


def test_every_query_of_this_kind_is_registered():
    assert {*upkeep.QUERIES, *upkeep.DELETED, *attached.QUERIES, *encoding.PARSED, *encoding.PLAIN, *encoding.OVER_BLOCKS} <= set(registry.queries())
