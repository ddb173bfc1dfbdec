"""The registered queries train at the sizes of the library's defaults."""

from riskloom.catalog import models
from riskloom.operators.ensemble import BOOST_DEFAULTS, FOREST_DEFAULTS
from riskloom.plans.training import TrainingPlan


def test_registered_training_is_whole(spark, small, monkeypatch):
    monkeypatch.setattr(models, "_RUNS", {})
    monkeypatch.setattr(TrainingPlan, "run", lambda self, df, **k: self)
    plan = models.training_run(spark, small)
    given = plan.ensemble
    assert plan.n_estimators == 200
    for params in (given.boost_params, given.balanced_boost_params):
        assert BOOST_DEFAULTS | params == BOOST_DEFAULTS
    assert FOREST_DEFAULTS | given.forest_params == FOREST_DEFAULTS
