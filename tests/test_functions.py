"""Inference and stage helpers that need no session."""

import math

import numpy as np
import pytest

from loadweave.functions import inference
from loadweave.plans import stages


def test_tails():
    assert inference.f_tail(4, 1, 10) == pytest.approx(0.0734, abs=1e-4)
    assert inference.chi2_tail(9.488, 4) == pytest.approx(0.05, abs=2e-4)
    assert inference.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and inference.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert inference.beta_ratio(0.3, 2, 3) == pytest.approx(0.3483, abs=1e-4) and inference.beta_ratio(0.5, 0.5, 0.5) == pytest.approx(0.5, abs=1e-3)


def test_linear():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(400), rng.normal(size=400)])
    y = x @ [1.0, 2.0] + rng.normal(size=400) * 0.1
    b, v = inference.clustered_ols(x, y, np.arange(400) // 10)
    assert b == pytest.approx([1, 2], abs=0.05) and (np.diag(v) > 0).all()
    assert inference.wald([0.0, 0.0], np.eye(2))[2] == pytest.approx(1.0)
    assert inference.hotelling(rng.normal(size=(60, 3)))[1] > 0.001 and math.isnan(inference.hotelling(np.ones((2, 3)))[1])
    assert inference.consistency_ratio([[1, 2, 4], [0.5, 1, 2], [0.25, 0.5, 1]]) == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        inference.checked_weights([0.5, 0.6])


def test_stages():
    run = stages.Stages()
    assert run.run(stages.Stage("a", lambda: 1, critical=True)) == 1 and run.run(stages.Stage("b", lambda: 1 / 0)) is None
    with pytest.raises(ZeroDivisionError):
        run.run(stages.Stage("c", lambda: 1 / 0, critical=True))
    assert [(e["stage"], e["status"], e.get("error")) for e in run.log] == [("a", "done", None), ("b", "skipped", "ZeroDivisionError"), ("c", "failed", "ZeroDivisionError")]
    assert stages.merged({"a": {"x": 1, "y": 2}, "_note": 0}, {"a": {"y": 3}, "b": 4}) == {"a": {"x": 1, "y": 3}, "b": 4}
    assert stages.energy_window(90, 28, 4, 120) == 146 and stages.evaluation_window("2025-12-31") == ("2025-12-04", "2025-12-31")
    assert [stages.preregistered(s) for s in (0.06, 0.01, -0.1, None)] == ["keep", "support", "withdraw", "not_computed"]
    assert stages.calendar_warnings("2025-12-20", "2025-12-30", 3) == ["the window touches the turn of the year"]
    assert stages.calendar_warnings("2025-01-30", "2025-02-10", 3, ("2025-01-29",)) == ["the window touches the lunar new year"] and not stages.calendar_warnings("2025-01-31", "2025-02-10", 3, ("2025-01-29",))
    assert stages.missing_months(20, (10, 21), 3) == 3 and stages.missing_months(30, (10, 21), 3) == 0 and stages.clipped_window((10, 21), 20) == (10, 20)
