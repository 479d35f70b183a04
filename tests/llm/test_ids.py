"""A null beside ids above 2**53: none of them changes on its way through an operator."""

import random

import pytest

from veridrift.llm import html_extract, pii, quality_classifier, quality_rules, simhash, suffix_dedup
from veridrift.llm.queries import TOKENIZER

LARGE = (1 << 53) + 1
OPERATORS = {
    "packing": lambda df: packed(df),
    "simhash": lambda df: simhash.near_duplicates(df, 4, 4),
    "pii": lambda df: pii.report(df, "k"),
    "suffix": suffix_dedup.deduplicate,
    "rules": quality_rules.judge,
    "classifier": quality_classifier.score,
}


def packed(df):
    import public_tokenizers

    from veridrift.llm.packing import tokenizer_pack

    return tokenizer_pack(df, public_tokenizers.path(TOKENIZER))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(30))
    rows = [(LARGE, text(), "en", "s"), (None, text(), "en", "s"), (LARGE + 2, text(), "en", "s"), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_stay(docs, name):
    got = {r["doc_id"] for r in OPERATORS[name](docs).select("doc_id").collect()}
    assert got == {LARGE, LARGE + 2, None}


def test_components_and_pages(spark, docs):
    got = {r["component_id"] for r in simhash.near_duplicates(docs, 4, 4).where("doc_id is not null").collect()}
    assert got == {LARGE, LARGE + 2}
    pages = spark.createDataFrame([(LARGE, "u", "<p>x</p>"), (None, None, None)], "page_id long, url string, html string").coalesce(1)
    assert {r["page_id"] for r in html_extract.main_texts(pages).collect()} == {LARGE, None}
