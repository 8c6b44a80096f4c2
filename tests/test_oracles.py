"""A spread of queries against their SQL on the smallest tables."""

import os

import pytest
from oracle import differences

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = "sentences chunks token_df stems corpus_stats document_list entity_tf entity_top8 top_entities local_scores markdown_rows table_row_groups caption_attachment modal_answers page_ranges document_summaries".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_query_agrees_with_sql(spark, name):
    assert differences(entry.queries()[name](spark, SF), entry.oracle_sql()[name], SF) == []


def test_every_query_has_a_statement():
    from docquarry.plans import encoding, registry

    assert set(registry.oracle_sql()) == set(registry.queries()) - set(registry.LATENT) - set(encoding.PARSED)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
