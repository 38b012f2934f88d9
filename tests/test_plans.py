"""Plan shape: pruning, pushdown, no Python in native operators, bounded top-k."""

from pyspark.sql import functions as F

from issuelens.functions.embedding import HashingEncoder
from issuelens.operators import comments as cm
from issuelens.operators import index as ix
from issuelens.operators import neighbours as nb
from issuelens.operators import profile as pf
from issuelens.plans.inspect import plan_text
from issuelens.schemas import ISSUE
from issuelens.sources import fixtures as fx
from issuelens.sources.issues import read_issues

from .conftest import SF_SMALL


def _landed(spark, tmp_dir):
    path = f"{tmp_dir}/issues"
    fx.tracker(spark, SF_SMALL).write.parquet(path)
    return path


def test_scan_prunes_and_pushes(spark, tmp_dir):
    path = _landed(spark, tmp_dir)
    issues = read_issues(spark, path)
    plan = plan_text(cm.pending_comments(issues, resume="1996-01-01"))
    assert "PushedFilters" in plan and "IsNull(fields.comments)" in plan
    assert "GreaterThanOrEqual(fields.created,1996-01-01)" in plan
    assert "changelog" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_profile_is_jvm_only_and_uses_group_limit(spark):
    t = fx.tracker_tables(spark, SF_SMALL)
    p = pf.profile_tables(t, fx.repos(spark, SF_SMALL))
    plan = plan_text(p)
    for python_node in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert python_node not in plan
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_encoder_runs_once_per_row(spark):
    idx = ix.build_index(fx.issues_doc(spark, SF_SMALL), HashingEncoder(8))
    plan = plan_text(idx.select("issue_key", F.size("embedding")))
    import re
    assert len(re.findall(r"^\(\d+\) ArrowEvalPython", plan, re.M)) == 1


def test_neighbour_plan_is_bounded(spark):
    v = fx.vectors(spark, SF_SMALL)
    plan = plan_text(nb.similar(v.select(F.col("key").alias("query_id"), "embedding"), v, exclude_self=True))
    assert "WindowGroupLimit" in plan and "MapInPandas" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_narrow_schema_leaves():
    from issuelens.schemas import narrow
    s = narrow(ISSUE, ["key", "fields.issuelinks.id"])
    assert s.simpleString() == "struct<key:string,fields:struct<issuelinks:array<struct<id:string>>>>"
