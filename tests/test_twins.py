"""Every named query against its SQL twin on the smallest tables; those without one must give rows."""

import pytest

from demandloom.plans import registered, registered_sql
from tests.oracle import compare, connect

# Trained or sampled at length, minutes each and not run here: tests/test_learners.py and tests/test_scoring.py cover
# their operators on small frames with known answers.
SLOW = {
    "fc7_boosted_submission",
    "fc4_boosted_test_scores", "fc4_cross_validation", "fc5_boosted_with_skips", "fc6_grid_search", "fc12_what_if",
    "fs5_forest_importances", "fs6_feature_elimination", "xa0_sampled_contributions", "xa8_model_importances",
}
# Too few rows per series on the smallest tables: run on the next larger ones.
THIN = {"win15_pacf", "win16_significant_lags", "jn15_fallback_zero", "fc1_seasonal_by_pair", "fc2_intervals", "fc8_store_models", "imp9_seasonal_fill",
        "fc1_multiplicative_with_weather", "dq4_pair_weekday_means", "jn9_merge_calendars", "fc5_ridge_by_pair", "fc1_fixed_trend_changes"}
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(registered_sql()))
def test_equals_sql(spark, con, small, name):
    build, sql = registered()[name], registered_sql()[name]
    verdict = "empty on both sides" if name in THIN else compare(build(spark, small), con, sql)
    if verdict == "empty on both sides":
        verdict = compare(build(spark, LARGER), connect(LARGER), sql)
    assert verdict is None, verdict


@pytest.mark.parametrize("name", sorted(set(registered()) - set(registered_sql()) - SLOW - THIN))
def test_gives_rows(spark, small, name):
    assert registered()[name](spark, small).count() > 0
