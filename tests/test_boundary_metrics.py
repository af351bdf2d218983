"""Boundary metrics where a pair's intervals are both empty."""

import math

import duckdb
import pytest

from tessellar.operators import evaluation
from tessellar.plans import catalog


@pytest.mark.parametrize("values", [(0.0, 2.5, 0.0), (1.0, 2.5, 0.0)])
def test_query_equals_sql_on_empty_intervals(spark, tmp_path, values):
    # event 70 is matched with itself; of value 0 both are empty
    c = duckdb.connect()
    c.execute("create table events as select * from (values (70, timestamp '2024-01-01', 1, 'view', ?), (71, timestamp '2024-01-02', 2, 'click', ?), (72, timestamp '2024-01-03', 3, 'view', ?)) t(event_id, ts, user_id, event_type, value)", values)
    c.execute(f"copy (select event_id::bigint event_id, ts, user_id::bigint user_id, event_type, value::double value from events) to '{tmp_path}/events.parquet' (format parquet)")
    got = catalog.QUERIES["a25_boundary_metrics"](spark, str(tmp_path)).first().asDict()
    c.execute(catalog.ORACLE_SQL["a25_boundary_metrics"])
    want = dict(zip([d[0] for d in c.description], c.fetchone(), strict=True))
    assert math.isnan(got["iou"]) == math.isnan(want["iou"]) == (values[0] == 0)
    assert {k: float(v) for k, v in got.items() if not math.isnan(v)} == {k: float(v) for k, v in want.items() if not math.isnan(v)}


def test_operator_takes_empty_pairs_as_no_overlap(spark):
    pairs = spark.createDataFrame([(5, 5, 5, 5, True), (0, 10, 0, 10, True), (0, 0, 3, 3, False)], "a_start long, a_end long, b_start long, b_end long, same boolean")
    assert evaluation.boundary_metrics(pairs, 1).first().iou == pytest.approx(1 / 3)
