"""Registered queries against their DuckDB twins on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import registry
from tests.conftest import SMALL

NEED_ALIGNED = 500  # rows that the pooled queries of the bar panel need; the smallest tables have fewer


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5f}".replace("-0.00000", "0.00000")
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


QUICK = [
    "bars_hourly", "bars_daily", "bars_index", "band_event_returns", "src_standardize", "chk_market_validation", "chk_expectations",
    "joi_aligned", "joi_reindex", "set_overlap", "set_missing", "win_returns", "win_scale_range_volume", "win_rsi", "win_bollinger",
    "win_event_persistence", "win_targets", "flt_time_range", "win_gaps", "spl_expanding_folds", "spl_nested_plan", "grid_signal_specs",
    "grid_candidates", "grid_parsed_specs", "grid_structural", "grid_policies", "inf_holm", "joi_unknown_ids", "lim_evenly_spaced",
    "met_loss_brier", "met_ece", "met_auc", "pol_cost_grid", "agg_monthly", "drf_cusum", "gat_family_decision", "win_spec_scores",
    "inf_dm_test", "gat_locked_checks", "joi_fold_assignment", "win_rolling_edge", "gat_robustness_class",
    "sta_parameters", "inf_bootstrap", "inf_superior_ability", "sel_one_standard_error", "mod_isotonic", "mod_spline_basis",
]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cur.fetchall())


def test_entry_is_registered():
    assert registry.FLAGSHIP in registry.queries()
    assert set(registry.oracle_sql()) <= set(registry.queries())
