"""Catalog readers, definition files, landing pages and triage (hand-written JSON)."""

import json

from pyspark.sql import functions as F

from issuelens.sources import catalogs as cg
from issuelens.sources import landing as ld


def _raw(spark, rows):
    return spark.createDataFrame(rows, "repo string, payload string")


def test_issuetype_last_wins(spark):
    payload = json.dumps([{"id": "1", "name": "Bug", "description": "old"},
                          {"id": "2", "name": "Task", "description": ""},
                          {"id": "3", "name": "Bug", "description": "new"}])
    rows = cg.read_catalog(_raw(spark, [("A", payload), ("B", "[]")]), "issuetype").collect()
    got = {(r["repo"], r["name"]): r["description"] for r in rows}
    assert got == {("A", "Bug"): "new", ("A", "Task"): ""}


def test_linktype_missing_key_keeps_source(spark):
    p1 = json.dumps({"issueLinkTypes": [{"id": "1", "name": "Blocks"}, {"id": "2", "name": "Blocks"}]})
    rows = cg.read_catalog(_raw(spark, [("A", p1), ("B", "{}")]), "linktype").collect()
    got = sorted((r["repo"], r["name"], r["id"]) for r in rows)
    assert got == [("A", "Blocks", "2"), ("B", None, None)]
    counts = {r["repo"]: r["n"] for r in cg.read_catalog(_raw(spark, [("A", p1), ("B", "{}")]), "linktype")
              .groupBy("repo").agg(F.count("name").alias("n")).collect()}
    assert counts == {"A": 1, "B": 0}


def test_definition_files(spark):
    src = json.dumps({"X": {"company_url": "u", "jira_url": "j", "name": "X", "rough_issue_count": "1,015,000"}})
    r = cg.read_sources(spark.createDataFrame([(src,)], "payload string")).collect()[0]
    assert (r["source"], r["rough_issue_count"]) == ("X", "1,015,000")
    th = json.dumps({"X": {"Bug": {"theme": "Defects", "code": "Bug"}, "Epic": {"theme": "Req", "code": "Epic"}}})
    t = {(r["repo"], r["issuetype"]): r["theme"] for r in cg.read_themes(spark.createDataFrame([(th,)], "payload string")).collect()}
    assert t == {("X", "Bug"): "Defects", ("X", "Epic"): "Req"}
    lm = json.dumps({"link types": {"Dependent": "Dependency", "dependent": "Dependency", "Blocks": "Block"}})
    m = cg.read_linktype_map(spark.createDataFrame([(lm,)], "payload string"))
    links = spark.createDataFrame([("Dependent",), ("dependent",), ("DEPENDENT",)], "link_type string")
    got = {r["link_type"]: r["canonical"] for r in cg.with_link_type(links, m).collect()}
    assert got == {"Dependent": "Dependency", "dependent": "Dependency", "DEPENDENT": "DEPENDENT"}


def test_pages_to_issues(spark):
    page = {"total": 2, "startAt": 0, "maxResults": 250, "issues": [
        {"id": "10", "key": "A-1", "fields": {"summary": "s", "issuetype": {"name": "Bug"},
                                               "customfield_100": {"value": "x"}, "customfield_200": None,
                                               "priority": {"name": "P1"}},
         "changelog": {"histories": [{"created": "d", "items": [{"field": "status", "fromString": "Open", "toString": "Done"}]}]}},
        {"id": "11", "key": "A-2", "fields": {"summary": None}}]}
    raw = spark.createDataFrame([("A", json.dumps(page)), ("A", json.dumps({"errorMessages": ["boom"]})),
                                 ("A", "not json")], "repo string, body string")
    issues, rejects = ld.pages_to_issues(raw)
    rows = {r["key"]: r for r in issues.collect()}
    assert set(rows) == {"A-1", "A-2"}
    a1 = rows["A-1"]
    assert a1["fields"]["issuetype"]["name"] == "Bug"
    assert json.loads(a1["fields"]["custom_fields"]["customfield_100"]) == {"value": "x"}
    assert "customfield_200" not in a1["fields"]["custom_fields"]
    assert a1["changelog"]["histories"][0]["items"][0]["toString"] == "Done"
    assert rejects.count() == 2


def test_comment_triage_and_retry(spark):
    bodies = [json.dumps({"total": 1, "comments": [{"id": "1", "created": "t", "body": "b"}]}),
              json.dumps({"errorMessages": ["Login Required"]}),
              json.dumps({"errorMessages": ["Something else"]})]
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "key string, body string")
    got = [r["status"] for r in ld.triage_comment_pages(df).orderBy("key").collect()]
    assert got == ["ok", "skip", "fail"]
    log = spark.createDataFrame([(1, 200), (2, 429), (3, 503), (4, 404)], "req int, status int")
    assert sorted(r["req"] for r in ld.retry_requests(log).collect()) == [2, 3]


def test_plan_pages(spark):
    s = spark.createDataFrame([("X", "https://t.invalid", 501), ("Y", "https://u.invalid", 0)],
                              "source string, jira_url string, total long")
    rows = ld.plan_pages(s).orderBy("source", "start_at").collect()
    assert [(r["start_at"], r["max_results"]) for r in rows] == [(0, 250), (250, 250), (500, 1)]
    assert rows[2]["url"].endswith("startAt=500&maxResults=1&expand=changelog")
    lim = ld.plan_pages(s, limit=300, start=100).collect()
    assert sorted((r["start_at"], r["max_results"]) for r in lim) == [(100, 200)]


def test_read_page_files(spark, tmp_path):
    for repo, n in (("A", 2), ("B", 1)):
        d = tmp_path / f"repo={repo}"
        d.mkdir()
        for i in range(n):
            page = {"total": n, "startAt": i, "issues": [{"id": f"{repo}{i}", "key": f"{repo}-{i}",
                                                           "fields": {"summary": "x\ny"}}]}
            (d / f"page{i}.json").write_text(json.dumps(page, indent=2))
    issues, rejects = ld.pages_to_issues(ld.read_page_files(spark, str(tmp_path)))
    got = sorted((r["repo"], r["key"], r["fields"]["summary"]) for r in issues.collect())
    assert got == [("A", "A-0", "x\ny"), ("A", "A-1", "x\ny"), ("B", "B-0", "x\ny")]
    assert rejects.count() == 0


def test_definition_file_on_disk(spark, tmp_path):
    defs = {"Apache": {"company_url": "c", "jira_url": "j", "name": "Apache", "rough_issue_count": "1,015,000"},
            "Spring": {"company_url": "c2", "jira_url": "j2", "name": "Spring", "rough_issue_count": "69,000"}}
    f = tmp_path / "sources.json"
    f.write_text(json.dumps(defs, indent=2))
    rows = cg.read_sources(cg.read_json_text(spark, str(f))).collect()
    assert sorted((r["source"], r["rough_issue_count"]) for r in rows) == [("Apache", "1,015,000"), ("Spring", "69,000")]


def test_request_texts_and_fixed_rules(spark):
    from issuelens import constants as K
    from issuelens.operators import profile as pf

    s = spark.createDataFrame([("X", "https://t.invalid"), (K.INVALID_SOURCES[0], "https://u.invalid")], "source string, jira_url string")
    valid = ld.exclude_invalid(s, ld.invalid_sources(spark))
    assert {r.catalog: r.url for r in ld.catalog_urls(valid).collect()} == {
        "issuetype": K.ISSUETYPE_URL.format(base="https://t.invalid"), "linktype": K.LINKTYPE_URL.format(base="https://t.invalid"),
        "field": K.FIELD_URL.format(base="https://t.invalid")}
    url = s.where("source = 'X'").select(ld.comment_url(F.col("jira_url"), F.lit("K-1"), F.lit(50), 7).alias("u")).first().u
    assert url == K.COMMENT_URL.format(base="https://t.invalid", key="K-1", start=50, size=7)
    rules = {r.repo: (r.epic_field, r.born_skip) for r in pf.known_repos(spark).collect()}
    assert set(rules) == set(K.EPIC_FIELDS) - set(K.INVALID_SOURCES) and rules["Apache"] == (K.EPIC_FIELDS["Apache"], K.BORN_SKIP["Apache"])
