"""Published means of three models and the scores that follow from them."""

import pytest

from kgspark.operators.metrics import scorecard

NAMES = [m[0] for m in scorecard.METRICS]
RAW = {
    "model-a": (6854.4632, 0.7256, 5.055, 1.0, 3.995, 2.155, 0.6450, 0.6150, 0.7018, 0.9407, 1.0, 0.0, 0.9502, 0.0592, 0.7976),
    "model-b": (6458.7404, 1.0336, 2.345, 1.0, 2.115, 1.265, 0.6740, 0.5548, 0.9038, 0.9524, 1.0, 0.0, 0.9578, 0.0488, 0.8318),
    "model-c": (9420.8431, 0.7476, 4.665, 1.0, 1.730, 3.345, 0.7663, 0.7915, 0.7617, 0.9405, 1.0, 0.0, 0.9776, 0.0246, 0.8010),
}
CATEGORIES = {
    "model-a": (0.7715, 0.6100, 0.7232, 0.6539, 0.9802, 0.9455, 0.7976, 0.7835),
    "model-b": (0.7847, 0.8660, 0.8452, 0.7109, 0.9841, 0.9545, 0.8318, 0.8585),
    "model-c": (0.6860, 0.6405, 0.7193, 0.7731, 0.9802, 0.9765, 0.8010, 0.8093),
}
COST = {"model-a": 108.0, "model-b": 32.4, "model-c": 16.2}
FINAL = {"model-a": 0.6660, "model-b": 0.8533, "model-c": 0.8379}


@pytest.fixture
def means(spark):
    return spark.createDataFrame([(m, n, v) for m, vs in RAW.items() for n, v in zip(NAMES, vs, strict=True)], "model string, metric string, value double")


def test_published_scores(spark, means):
    cats = scorecard.category_scores(scorecard.normalised(means, scorecard.config(spark)))
    got = {(r.model, r.category): r.score for r in cats.collect()}
    order = list(dict.fromkeys(m[1] for m in scorecard.METRICS)) + ["overall"]
    assert len(order) == 8
    for model, want in CATEGORIES.items():
        for category, score in zip(order, want, strict=True):
            assert got[model, category] == pytest.approx(score, abs=1e-4)
    priced = cats.where("category = 'overall'").select("model", cats.score.alias("quality"))
    priced = priced.join(spark.createDataFrame(list(COST.items()), "model string, cost double"), "model")
    blend = scorecard.cost_blend(priced)
    assert {r.model: r.final for r in blend.collect()} == pytest.approx(FINAL, abs=1e-4)
    assert [(r.model, r.percent, r.bar) for r in scorecard.ranking(blend, "final").orderBy("rank").collect()] == [
        ("model-b", 85, "█" * 17 + "░" * 3), ("model-c", 83, "█" * 16 + "░" * 3), ("model-a", 66, "█" * 13 + "░" * 6),
    ]
    marks = {r.category: r.mark for r in scorecard.strong_and_weak(cats, blend).collect()}
    assert set(marks.values()) == {"strong"} and "Теги" not in marks


def test_targets_count_as_lower_is_better(spark, means):
    got = {r.metric: (r.best, r.worst) for r in scorecard.extremes(means, scorecard.config(spark)).collect()}
    assert got["count_ratio"] == ("model-a", "model-b") and got["depth_mae"] == ("model-b", "model-c")
    assert got["tag_f1"] == ("model-c", "model-a") and got["hallucination_ratio"][0] == "model-a"
