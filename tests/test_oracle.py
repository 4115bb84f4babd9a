"""Every SQL-expressible query against its plain-SQL statement on DuckDB."""

import re

import pytest

from conftest import SF_SMALL
from oracle_compare import compare, duck

from __spark_entry__ import oracle_sql, queries

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    r = compare(spark, con, name, queries()[name], SQL[name], SF_SMALL)
    assert r["ok"], r
    assert r["spark_rows"] > 0


def test_every_query_has_sql_or_is_model_fitting():
    rows_only = {n for n in set(queries()) - set(SQL) if not re.match(r"op\d+_|pipeline$", n)}
    assert rows_only == {"fit_history", "fit_history_blocks", "fit_image_history", "fit_text_history", "fit_text_script",
                         "fit_message_history", "sweep_fit_alpha", "sweep_fit_alpha_text", "sweep_fit_beta"}


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["token", "n", "id"]
    rows = df.collect()
    assert 0 < len(rows) <= 998
    assert sorted(r["id"] for r in rows) == list(range(2, 2 + len(rows)))
