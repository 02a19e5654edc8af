"""Physical-plan checks: column pruning and filter pushdown reach the parquet scan."""
from quarry.operators import filters as FL
from quarry.operators import profile as P
from quarry.sources import tables as TB
from quarry.sources import views as V
from oracle import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_is_read_only_when_profiled(spark):
    for with_text in (False, True):
        plan = _plan(P.null_profile(V.docs(spark, SF_SMALL, with_text)))
        scans = [ln for ln in plan.splitlines() if "documents.parquet" in ln or "ReadSchema" in ln]
        assert any("text:" in ln for ln in scans) == with_text


def test_slice_filter_pushed_to_scan(spark):
    ev = TB.table(spark, SF_SMALL, "events")
    plan = _plan(FL.slice_frame(ev, {"event_type": ["click", "view"]}, {"value": (1.0, 50.0)}).select("event_id"))
    assert "PushedFilters" in plan and "event_type" in plan.split("PushedFilters")[1]


def test_listings_reads_only_needed_lineitem_columns(spark):
    from pyspark.sql import functions as F
    v = V.listings(spark, SF_SMALL)
    # no line-item column used: the optimizer drops the (unique-key) left join entirely
    assert "lineitem" not in _plan(v.groupBy("room_type").count())
    plan = _plan(v.groupBy("room_type").agg(F.sum("number_of_reviews")))
    li = [ln for ln in plan.splitlines() if "lineitem" in ln]
    assert li and all("l_extendedprice" not in ln and "l_discount" not in ln for ln in li)
