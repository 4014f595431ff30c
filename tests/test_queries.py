"""Every registered query is documented, and a sample of plans has the wanted shape."""

import re

from terralume.queries import load_all

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_ids_and_columns():
    queries = load_all()
    assert len(queries) > 100
    for q in queries.values():
        assert q.ids and all(re.fullmatch(r"[A-Z]\d+", i) for i in q.ids), q.name


def test_no_cartesian_joins_in_key_plans(spark):
    names = ["latest_operations", "merge_credit_plots", "snapshot_diff", "publish_state_merge", "batch_status"]
    for name in names:
        text = plan(load_all()[name].run(spark, SF))
        assert "CartesianProduct" not in text, name
        assert "BatchEvalPython" not in text, name


def test_grid_join_is_an_equi_join(spark):
    text = plan(load_all()["plots_touching_properties"].run(spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
