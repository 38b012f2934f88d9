"""Profile on hand-written issue documents with the edge rows of FIXTURES.md D."""

import json

import pytest
from pyspark.sql import functions as F

from issuelens.operators import profile as pf
from issuelens.plans.inspect import plan_text
from issuelens.sources.issues import read_issues

DOCS = [
    {"repo": "A", "_id": "1", "key": "A-1", "fields": {
        "created": "2001-05-01T00:00:00", "issuetype": {"name": "Task"}, "project": {"name": "P1"},
        "issuelinks": [{"id": "L1", "type": {"name": "Blocks"}}, {"id": "L2", "type": {"name": "Relates"}}],
        "subtasks": [{"id": "s1"}, {"id": "s2"}], "comments": [{"id": "c1"}, {"id": "c2"}],
        "custom_fields": {"cf_A": "E-1"}},
     "changelog": {"histories": [{"items": [{"field": "issuetype", "fromString": "Bug"},
                                            {"field": "status", "fromString": "Open"}]},
                                 {"items": None}]}},
    {"repo": "A", "_id": "2", "key": "A-2", "fields": {
        "created": "2000-01-01T00:00:00", "issuetype": {"name": None}, "project": {"name": "P2"},
        "issuelinks": [{"id": "L1", "type": {"name": "Blocks"}}], "subtasks": [], "comments": None,
        "custom_fields": {"cf_A": None}}},
    {"repo": "A", "_id": "3", "key": "A-3", "fields": {"created": "1999-12-31T00:00:00"},
     "changelog": {"histories": [{"items": [{"field": "issuetype", "fromString": None}]}]}},
    {"repo": "B", "_id": "4", "key": "B-1", "fields": {
        "created": "2010-01-01T00:00:00", "issuetype": {"name": "Bug"}, "project": {"name": "P1"},
        "issuelinks": [{"id": "L1", "type": {"name": "Blocks"}}], "comments": [],
        "custom_fields": {"cf_B": "E-9", "cf_A": "ignored"}},
     "changelog": {"histories": [{"items": [{"field": "project", "fromString": "P0"}]}]}},
    {"repo": "D", "_id": "5", "key": "D-1", "fields": {
        "created": "2005-01-01T00:00:00", "issuelinks": None, "subtasks": None, "comments": None,
        "custom_fields": None},
     "changelog": {"histories": []}},
    {"repo": "D", "_id": "6", "key": "D-2", "fields": {"created": "2004-01-01T00:00:00", "summary": ""},
     "changelog": {"histories": None}},
]


@pytest.fixture(scope="module")
def issues(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("docs")
    (d / "docs.json").write_text("\n".join(json.dumps(x) for x in DOCS))
    return read_issues(spark, str(d), fmt="json")


@pytest.fixture(scope="module")
def repos(spark):
    return spark.createDataFrame([("A", "cf_A", 1), ("B", "cf_B", 0), ("C", "cf_C", 0), ("D", "cf_D", 0)],
                                 "repo string, epic_field string, born_skip int")


def test_profile(issues, repos):
    p = {r["repo"]: r.asDict() for r in pf.profile(issues, repos).collect()}
    a, b, c = p["A"], p["B"], p["C"]
    assert (a["issues"], a["links"], a["ult"], a["uit"], a["up"]) == (3, 5, 2, 2, 2)
    assert (a["changes"], a["comments"], a["born"]) == (3, 2, "2000")
    assert (a["changes_per_issue"], a["comments_per_issue"]) == (1, 1)
    assert (b["issues"], b["links"], b["uit"], b["up"], b["changes"], b["comments"]) == (1, 2, 1, 2, 1, 0)
    assert b["born"] == "2010"
    assert (c["issues"], c["links"], c["dit"], c["dlt"], c["born"], c["changes_per_issue"]) == (0, 0, 0, 0, None, None)
    d = p["D"]   # null and empty arrays, empty and null change logs
    assert (d["issues"], d["links"], d["ult"], d["uit"], d["changes"], d["comments"], d["born"]) == (2, 0, 0, 0, 0, 0, "2004")
    assert (d["changes_per_issue"], d["comments_per_issue"]) == (0, 0)


def test_metric_functions_agree(issues, repos):
    sets = {r["repo"]: r for r in pf.distinct_sets(issues).collect()}

    def nonzero(d):   # a source without members is absent on one side, 0/null on the other
        return {k: v for k, v in d.items() if v}

    for fn, col in ((pf.used_types, "uit"), (pf.unique_projects, "up"), (pf.used_link_types, "ult")):
        assert nonzero({r["repo"]: r[col] for r in fn(issues).collect()}) == \
            nonzero({k: v[col] for k, v in sets.items()})


def test_half_even(spark):
    df = spark.createDataFrame([(1, 2), (3, 2), (5, 2), (7, 2), (1, 0)], "changes long, issues long")
    got = [r[0] for r in df.select(pf.ratio("changes", "issues")).collect()]
    assert got == [0, 2, 2, 4, None]


def test_summary(spark):
    prof = spark.createDataFrame([(1,), (2,), (3,), (10,)], "issues long")
    rows = {r["stat"]: r["issues"] for r in pf.profile_summary(prof, columns=["issues"]).collect()}
    assert rows == {"Sum": 16.0, "Median": 2.5, "Std Dev": round((((1 - 4) ** 2 + (2 - 4) ** 2 + (3 - 4) ** 2 + 36) / 4) ** 0.5, 4)}


def test_narrow_read_schema(spark, tmp_path):
    spark.createDataFrame([], pf_schema()).write.parquet(str(tmp_path / "p"))
    df = read_issues(spark, str(tmp_path / "p"), paths=["repo", "changelog.histories.items.field"])
    items = df.schema["changelog"].dataType["histories"].dataType.elementType["items"].dataType.elementType
    assert [f.name for f in items.fields] == ["field"]
    assert "fromString" not in plan_text(df.select("repo", F.size("changelog.histories")))


def pf_schema():
    from issuelens.schemas import ISSUE
    return ISSUE


def test_born_uses_window_group_limit(issues, repos):
    plan = plan_text(pf.born(issues, repos))
    assert "WindowGroupLimit" in plan


def test_two_level_top_n_equals_single_window(spark):
    from pyspark.sql import Window
    rows = [(f"r{i % 3}", f"k{i:04d}", f"2000-01-{(i * 7) % 28 + 1:02d}") for i in range(600)]
    df = spark.createDataFrame(rows, "repo string, key string, created string").repartition(7)
    got = {(r["repo"], r["rn"], r["key"]) for r in pf.first_n(df, 25, buckets=3).collect()}
    w = Window.partitionBy("repo").orderBy("created", "key")
    want = {(r["repo"], r["rn"], r["key"]) for r in
            df.withColumn("rn", F.row_number().over(w)).where("rn <= 25").collect()}
    assert got == want


def _same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_profile_kept_up_to_date(spark, issues, repos, tmp_path):
    """Equal to the full profile after three landings, one of them with replaced issues, and after compacting."""
    from issuelens.operators import profile_store as ps
    from issuelens.operators import snapshot as sn

    root = str(tmp_path / "p")
    first, second = issues.where("repo = 'A'"), issues.where("repo = 'B'")
    ps.land(spark, root, first, repos, batch="1")
    assert _same(ps.stored_profile(spark, root, repos), pf.profile(first, repos))
    ps.land(spark, root, second, repos, batch="2")
    assert _same(ps.stored_profile(spark, root, repos), pf.profile(first.unionByName(second), repos))
    assert ps.land(spark, root, second, repos, batch="2").version == 2        # a replayed landing adds nothing
    newer = first.where("key = 'A-1'").withColumn("fields", F.col("fields").withField("issuetype.name", F.lit("Story"))
                                                   .withField("issuelinks", F.lit(None).cast(pf_schema()["fields"].dataType["issuelinks"].dataType)))
    ps.land(spark, root, newer.unionByName(issues.where("repo = 'D'")), repos, replaced=first.where("key = 'A-1'"), batch="3")
    now = issues.where("key <> 'A-1'").unionByName(newer)
    assert _same(ps.stored_profile(spark, root, repos), pf.profile(now, repos))
    rows = sn.latest(spark, root).rows()
    assert ps.compact(spark, root).rows() < rows
    assert _same(ps.stored_profile(spark, root, repos), pf.profile(now, repos))
    gone = ps.members(spark, root).where("name = 'Task'")
    assert gone.count() == 0                                                   # its last member was replaced


def test_single_metrics_read_only_their_tables(spark):
    import __spark_entry__ as se
    from .conftest import SF_SMALL

    q = se.queries()
    for name, others in (("agg_01", ("lineitem", "events", "conversations")), ("agg_03", ("lineitem", "conversations")),
                         ("agg_09", ("events", "conversations")), ("agg_14", ("lineitem", "events")), ("set_01", ("lineitem", "conversations"))):
        plan = plan_text(q[name](spark, SF_SMALL))
        assert not any(f"/{t}.parquet" in plan for t in others), name
