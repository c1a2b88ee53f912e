"""Keywords counted within rows."""

from mnemolake.operators import similarity
from mnemolake.plans import views

ROWS = [("1", "Cat cat dog the and the"), ("1", "dog dog cow"), ("2", None), ("3", ""), ("4", "b" * 3 + " " + " ".join(c * 4 for c in "zyxwvutsrq")), (None, "some word"), (None, "word")]


def test_repeated_ids_are_counted_together(spark):
    df = spark.createDataFrame(ROWS, "id string, content string")
    got = {tuple(r) for r in similarity.keywords(df).collect()}
    assert got == {("1", "dog", 3), ("1", "cat", 2), ("1", "cow", 1), ("4", "bbb", 1), *[("4", c * 4, 1) for c in "qrstuvw"], (None, "word", 2), (None, "some", 1)}


def test_no_word_of_a_single_row_is_exchanged(spark, sf):
    """Formerly every word of every text was a row that was exchanged by id and word, and again by id."""
    m = views.view(spark, sf, "memory")
    plan = similarity.keywords(m)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
