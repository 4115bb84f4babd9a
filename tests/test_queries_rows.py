"""Queries without a SQL statement (model fitting) run on the smallest tables
and give whole, plausible results."""

import re

import pytest

from conftest import SF_SMALL

from __spark_entry__ import oracle_sql, queries

#: The training-text queries have tests of their own.
ROWS_ONLY = sorted(n for n in set(queries()) - set(oracle_sql()) if not re.match(r"op\d+_|pipeline$", n))
EPOCHS = {"fit_history": 50, "fit_text_history": 25, "fit_message_history": 20, "fit_history_blocks": 5, "fit_image_history": 50,
          "fit_text_script": 25}
#: Fits by local SGD, a job or more an epoch: here with fewer epochs.
FEWER = {"fit_history": 3, "fit_text_history": 4, "fit_message_history": 4}
#: Fits whose loss must have fallen by the last epoch.
LEARN = ("fit_message_history", "fit_text_script")


def test_registered_epochs():
    import inspect

    assert all(inspect.signature(queries()[n]).parameters["epochs"].default == EPOCHS[n] for n in FEWER)


def test_every_fit_is_looked_at():
    assert set(ROWS_ONLY) == set(EPOCHS) | {"sweep_fit_alpha", "sweep_fit_alpha_text", "sweep_fit_beta"}


@pytest.mark.parametrize("name", sorted(EPOCHS))
def test_history_of_a_fit(spark, name):
    rows = [{re.sub("_", "", k).lower(): v for k, v in r.asDict().items()}
            for r in queries()[name](spark, SF_SMALL, **({"epochs": FEWER[name]} if name in FEWER else {})).collect()]
    rows.sort(key=lambda r: r["epoch"])
    assert [r["epoch"] for r in rows] == list(range(1, FEWER.get(name, EPOCHS[name]) + 1))
    for r in rows:
        assert len(r) == 9 and all(v is not None for v in r.values())
        assert all(0 <= r[f"{part}{m}"] <= 1 for part in ("train", "test") for m in ("acc", "avgacc"))
        assert all(r[f"{part}izx"] >= -1e-9 and r[f"{part}izy"] < 3.4 for part in ("train", "test"))
    assert rows[-1] != rows[0]
    if name in LEARN:
        assert rows[-1]["trainizy"] > rows[0]["trainizy"]


@pytest.mark.parametrize("name,config,n", [("sweep_fit_alpha", "config", 5), ("sweep_fit_alpha_text", "alpha", 5), ("sweep_fit_beta", "beta", 17)])
def test_table_of_a_sweep(spark, name, config, n):
    from ibex.operators import sweep as SW

    rows = queries()[name](spark, SF_SMALL).collect()
    want = SW.SCRIPT_ALPHAS if n == 5 else SW.beta_grid(*SW.SCRIPT_BETA_LOG10)
    assert sorted(float(r[config]) for r in rows) == sorted(want)
    for r in rows:
        values = [v for k, v in r.asDict().items() if k not in (config, "n_trials")]
        assert len(values) == 2 and all(0 <= v <= 1 for v in values)
