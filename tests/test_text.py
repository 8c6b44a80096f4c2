"""Golden values of the text functions."""

import pytest

from docquarry.functions.dialect import SPARK


def one(spark, expression):
    return spark.sql(f"SELECT {expression} AS x").first()["x"]


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [("नेपाल", "नेपालको", True), ("fee", "fees", True), ("cat", "dog", False), ("revenue", "revenues", True), ("ab", "abc", False)],
)
def test_token_match(spark, a, b, expected):
    assert one(spark, SPARK.token_match(f"'{a}'", f"'{b}'")) is expected


@pytest.mark.parametrize(("word", "expected"), [("policies", "policy"), ("boxes", "box"), ("cats", "cat"), ("class", "class"), ("नेपालको", "नेपाल")])
def test_stem(spark, word, expected):
    assert one(spark, SPARK.stem(f"'{word}'")) == expected


def test_digits_of_both_scripts_give_the_same_tokens(spark):
    assert set(one(spark, SPARK.tokens("'२०८२/८३'"))) == set(one(spark, SPARK.tokens("'2082/83'"))) == {"2082", "83"}


def test_danda_ends_a_sentence_without_a_space(spark):
    assert one(spark, SPARK.sentences("'पहिलो वाक्य।दोस्रो वाक्य। One. Two!'")) == ["पहिलो वाक्य।", "दोस्रो वाक्य।", "One.", "Two!"]


def test_long_sentence_is_cut_with_overlap(spark):
    parts = one(spark, SPARK.chunks("repeat('x', 1500)"))
    assert [len(p) for p in parts] == [700, 700, 340]


def test_chunks_carry_whole_sentences(spark):
    parts = one(spark, SPARK.chunks("repeat('abcdefghij klmnopqrst. ', 80)"))
    assert all(len(p) <= 821 for p in parts)
    assert parts[0].split("\n")[-1] == parts[1].split("\n")[0]
