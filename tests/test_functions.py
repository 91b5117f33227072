import math

import pytest
from pyspark.sql import functions as F

from kgspark.functions import luhmann, scores, text, vectors


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_clean_content(spark):
    assert one(spark, text.clean_content, "a  b\n c", "Done!", "", "why?", None, "  ") == ["a b c.", "Done!", "", "why?", None, ""]


def test_tags(spark):
    got = one(spark, text.normalize_tags, ["A B", "a-b", "", None, " c "], None, [], kind="array<string>")
    assert got == [["a_b", "c"], None, []]
    assert one(spark, text.eval_tag, " Ключ слово! ") == ["ключ_слово"]


def test_preview_and_wrap(spark):
    assert one(spark, lambda c: text.preview(c, 6), "abcdefgh", "abc") == ["abcde…", "abc"]
    assert one(spark, lambda c: text.wrap(c, 7), "one two three", "elephants go", "", None) == ["one two\nthree", "elephants\ngo", "", None]


@pytest.mark.parametrize(("md", "html"), [("# Head\nx", "<b>Head</b>\nx"), ("**b** and *i* `c`", "<b>b</b> and <i>i</i> <code>c</code>"), ("- item", "• item"), ("a < b & c", "a &lt; b &amp; c"), ("[t](https://e.org/x)", '<a href="https://e.org/x">t</a>'), ("2*3*4", "2*3*4")])
def test_markdown(spark, md, html):
    assert one(spark, text.md_to_html, md) == [html]


def test_sentences_and_prices(spark):
    assert one(spark, text.sentence_count, "A. B! C?", "...", "no end") == [3, 0, 1]
    assert one(spark, lambda c: text.price(c, 2), "in 1,5 out 20.25", "none") == [20.25, None]


def test_routes(spark):
    assert one(spark, text.route, "a.PDF", "b.txt", "c.doc", "noext") == ["pdf", "txt", "unsupported", "unsupported"]
    assert one(spark, text.model_key, "/x/linker_GPT-4_results.xlsx") == ["gpt-4"]


def test_luhmann(spark):
    ids = ("1", "1.2", "1.2a", "1.2a3", "12b", "x", None)
    assert one(spark, luhmann.depth, *ids) == [1, 2, 3, 4, 2, 1, 0]
    assert one(spark, luhmann.valid_depth, *ids) == [1, 2, 3, 4, 2, None, None]
    assert one(spark, luhmann.parent, *ids) == [None, "1", "1.2", "1.2a", "12", None, None]


def test_child_ids(spark):
    df = spark.createDataFrame([(None, 3), ("1", 2), ("1.2", 1), ("1.2", 27), ("1.2", 702), ("1.2", 703), ("1.2a", 5), ("1.2aa", 1)], "p string, n int")
    got = [r[0] for r in df.select(luhmann.child_id(F.col("p"), F.col("n"))).collect()]
    assert got == ["3", "1.2", "1.2a", "1.2aa", "1.2zz", "1.2aaa", "1.2a5", "1.2aa1"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([float("nan"), 1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, None, None, None, None]
    assert [r[0] for r in df.select(F.coalesce(vectors.is_usable(F.col("a"), 2), F.lit(False))).collect()] == [True, False, False, False, False]


def test_scores(spark):
    df = spark.createDataFrame([(0.5, 0.0, 1.0), (2.0, 0.0, 1.0), (3.0, 1.0, 1.0)], "x double, lo double, hi double")
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    assert [tuple(r) for r in df.select(scores.bounded(x, lo, hi), scores.inverted(x, lo, hi)).collect()] == [(0.5, 0.5), (1.0, 0.0), (1.0, 1.0)]
    assert math.isclose(df.select(scores.sigmoid(F.lit(0.0), 1.0)).head()[0], 0.5)


def test_codecs(spark):
    assert one(spark, text.coerced_tags, "['a', ' b ']", "a, ,b", "nan", None, "[broken") == [["a", "b"], ["a", "b"], [], [], []]
    assert one(spark, text.text_to_tags, "a, b,,", None) == [["a", "b"], []]
    assert one(spark, text.text_to_flag, "True", "false", None) == [True, False, False]


def test_settings_from_the_environment():
    import pytest

    from kgspark import params

    got = params.settings({"KGSPARK_TOP_K": "7", "KGSPARK_SEARCH_THRESHOLD": "0.4", "KGSPARK_MAX_TAGS": ""})
    assert (got.top_k, got.search_threshold, got.max_tags, got.link_threshold) == (7, 0.4, params.MAX_TAGS, params.LINK_THRESHOLD)
    with pytest.raises(ValueError):
        params.settings({"KGSPARK_TOP_K": "many"})
