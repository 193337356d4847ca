"""Empty tables, long texts and clashing names, for the operators and stages that other tests don't ask this of."""

import pytest

import corpus_pipeline
from tagweft.llm import leaks, pieces, pii, queries, repeats, secrets, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")


def test_operators_on_empty_tables(empty, labels, items):
    path = queries.model_path()
    found = [toxicity.classify(empty, labels), toxicity.accepted(empty, labels), secrets.scan(empty), pii.scan(empty), pii.masked(empty), pieces.digests(empty, path), pieces.encode_column(empty, path), leaks.hits(empty, items), leaks.without_hits(empty, items), repeats.remove_repeats(empty), repeats.remove_reference(empty, items.withColumnRenamed("item_id", "doc_id"))]
    assert [df.count() for df in found] == [0] * len(found)
    assert leaks.hits(items.withColumnRenamed("item_id", "doc_id"), items.where("false")).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_empty_tables(spark, empty, stage):
    found = corpus_pipeline.STAGES[stage][1](spark, empty, SF)
    assert found.count() == 0 and (found.columns == empty.columns or stage == 4)


def test_long_texts(spark, labels, items):
    """A text of megabytes is taken whole: what stands at its end is found."""
    filler = " ".join(f"w{k % 977}" for k in range(300_000))
    text = f"{filler} one two three four five six seven eight nine ten. Reach joe@mail.example.com, password=abcdefgh1"
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, None, None, None, None)], DOCS)
    assert [r.doc_id for r in leaks.hits(docs, items).collect()] == [1]
    assert leaks.without_hits(docs, items).count() == 1
    assert {r.doc_id: (r.n_assign, r.base_sha256) for r in secrets.scan(docs).collect()}[1][0] == 1
    assert {r.doc_id: r.n_email for r in pii.scan(docs).collect()} == {1: 1, 2: 0}
    assert {r.doc_id: 0 <= r.score <= 1 for r in toxicity.classify(docs, labels).collect()} == {1: True, 2: True}
