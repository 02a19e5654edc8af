"""Row order of the reports (comparisons with the oracle ignore it), and the slow model families."""

import pytest

from quarry.operators import regression as RG
from quarry.plans import named as N
from quarry.sources import views as V
from oracle import SF_SMALL


def test_report_orders(spark):
    s, v = V.survey(spark, SF_SMALL), V.listings(spark, SF_SMALL)
    rising = lambda rows, *cols: [tuple(r[c] for c in cols) for r in rows] == sorted(tuple(r[c] for c in cols) for r in rows)
    falling = lambda rows, col: [r[col] for r in rows] == sorted((r[col] for r in rows), reverse=True)
    assert rising(N.survey_class_share(s).collect(), "class")
    assert rising(N.survey_means_by_class(s).collect(), "class")
    assert rising(N.survey_rate_by(s, "age").collect(), "age")
    assert rising(N.survey_bmi_by_sex_class(s).collect(), "sex", "class")
    assert falling(N.survey_prevalence(s, V.survey_meta(spark)).collect(), "prevalence_pct")
    assert falling(N.listings_share_by_room_type(v).collect(), "total_listings")
    assert falling(N.listings_price_by_room_type(v).collect(), "price_avg")
    assert falling(N.listings_neighbourhood_activity(v, min_listings=1).collect(), "price_avg")
    assert rising(N.listings_host_profile(v).collect(), "host_profile")


@pytest.fixture(scope="module")
def steps(spark):
    """A target that a tree gets right and a line does not, with a category that matters."""
    rows = [(i, 100.0 + 50.0 * (i % 4 == 0) + 30.0 * (i % 7 > 3), float(i % 7), ("a", "b")[i % 4 == 0]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, price double, x double, kind string")
    return RG.with_folds(RG.with_split(df, "id"), "id").cache()


@pytest.mark.parametrize("name, options", [("tree", {}), ("forest", {"numTrees": 20}), ("boost_depthwise", {}), ("boost_leafwise", {})])
def test_tree_families_fit_steps(steps, name, options):
    m, metrics = RG.holdout_report(steps, name, numeric=["x"], categorical=["kind"], **options)
    assert metrics.first().r2 > 0.98
    table = RG.importance_table(m, RG.predict(m, steps, ["x"]))
    assert {r.feature for r in table.collect()} >= {"x"} and sum(r.importance for r in table.collect()) == pytest.approx(1)


def test_forest_search_scores_the_sampled_grid(steps, monkeypatch):
    monkeypatch.setattr(RG, "FOREST_GRID", {"numTrees": [2, 3], "maxDepth": [2], "min_samples_split": [2, 5]})
    got = RG.forest_random_search(steps, n_iter=3, k=2, numeric=["x"], categorical=["kind"]).collect()
    assert len(got) == 3 and all(r.r2_mean > 0.9 for r in got) and [r.rmse_mean for r in got] == sorted(r.rmse_mean for r in got)
