"""What the items of blocks move and store: captions alone, one context a figure or formula, tables of documents only."""

from docquarry.plans import derived, mixed, relations


def test_only_what_is_described_keeps_its_context_and_captions_are_stored_once(spark):
    corpus = relations.Corpus(spark, changed=mixed.MIXED)
    placed = corpus.frame("placed_blocks")
    assert placed.where("type NOT IN ('image', 'equation') AND context IS NOT NULL").count() == 0
    assert placed.where("type = 'equation' AND context LIKE '%mass of the body%'").count() == 3
    assert "named_blocks" not in relations.STORED
    corpus.release()


def test_orders_without_a_document_do_not_become_tables(spark):
    lines = spark.createDataFrame([(n, 1, 7, 2.0, 3.5, "N", "O") for n in range(1, 6)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string")
    docs = spark.createDataFrame([(2, "a"), (9, "b")], "doc_id long, filename string")
    corpus = relations.Corpus(spark, changed={"doc_tables": derived.doc_tables, "order_tables": derived.order_tables}, lineitem=lines, source_docs=docs)
    found = {r.doc_id: r.body for r in corpus.frame("doc_tables").collect()}
    assert set(found) == {2} and found[2] == {r.doc_id: r.body for r in corpus.frame("order_tables").collect()}[2]
    corpus.release()


def test_questions_about_orders_do_not_make_all_orders_into_tables(spark):
    corpus = relations.Corpus(spark, "/root/testdata/sf0.001", derived.MIXED)
    assert corpus.frame("asked").where("question like 'show the table%'").count() > 0
    assert not corpus.has("order_tables")
    corpus.release()


def test_items_of_blocks_move_texts_once_and_without_windows(spark):
    corpus = relations.Corpus(spark, changed=mixed.MIXED)
    assert corpus.frame("items").where("type = 'table'").count() > 0
    assert not corpus.has("placed_blocks") and not corpus.has("named_blocks")
    corpus.release()
