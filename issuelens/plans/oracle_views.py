"""DuckDB CTE texts that restate the fixture rules of ``sources.fixtures``.

They are written independently of the Spark code (flat joins instead of nested
documents) so an oracle result checks the Spark plan rather than repeating it.
"""

from __future__ import annotations

from ..constants import TASK_DESCRIPTION

NL = "chr(10)"

ISSUES_TEXT = f"""issues_text AS (
  SELECT doc_id AS _id, source AS repo, CAST(doc_id AS VARCHAR) AS key,
         CASE WHEN strpos(text, {NL}) > 0 THEN substr(text, 1, strpos(text, {NL}) - 1) ELSE text END AS summary,
         CASE WHEN strpos(text, {NL}) > 0 THEN substr(text, strpos(text, {NL}) + 1) END AS description,
         lang AS issuetype
  FROM documents)"""

VECTORS = ISSUES_TEXT + """,
vectors AS (
  SELECT CAST(e.vec_id AS VARCHAR) AS key, e.embedding, CAST(e.label AS VARCHAR) AS issuetype,
         coalesce(t.summary, '') || ' ' || coalesce(t.description, '') AS text,
         coalesce(t.summary, '') AS summary
  FROM embeddings e LEFT JOIN issues_text t ON t._id = e.vec_id)"""


def neighbours(k: int = 3, name: str = "nn") -> str:
    """Every vector against all others."""
    return VECTORS + f""",
{name}_pairs AS (
  SELECT q.key AS query_id, c.key AS key, c.issuetype, c.text,
         list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS similarity
  FROM vectors q JOIN vectors c ON q.key <> c.key),
{name} AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key ASC) AS INTEGER) AS rank
    FROM {name}_pairs) WHERE rank <= {k})"""


DIM = 64
TESTSET_SKIP, TESTSET_LIMIT = 60, 120

#: Items of the evaluation: a slice of the issues in their order, those that are usable.
TESTSET = ISSUES_TEXT + f""",
testset AS (
  SELECT key AS query_id, summary, coalesce(description, '') AS description, issuetype AS expected
  FROM (SELECT * FROM issues_text ORDER BY _id OFFSET {TESTSET_SKIP} LIMIT {TESTSET_LIMIT})
  WHERE coalesce(summary, '') <> '' AND coalesce(issuetype, '') <> '')"""

#: Texts of the benchmark as queries.
BENCHMARK = ISSUES_TEXT + """,
testset AS (SELECT 'b' || CAST(item_id AS VARCHAR) AS query_id, coalesce(text, '') AS summary FROM benchmark)"""


def text_neighbours(queries: str, k: int = 3, name: str = "nn") -> str:
    """Texts of ``testset`` (in the CTEs ``queries``) against the index of all documents: word hashes by MD5, unit vectors."""
    task = TASK_DESCRIPTION.replace("'", "''")
    return queries + f""",
index_rows AS (
  SELECT key, coalesce(summary, '') || ' ' || coalesce(description, '') AS text, coalesce(issuetype, '') AS issuetype FROM issues_text),
{name}_texts AS (
  SELECT 'c' AS side, key AS id, text FROM index_rows
  UNION ALL SELECT 'q', query_id, 'Instruct: {task}' || {NL} || 'Query: ' || coalesce(summary, '') FROM testset),
{name}_hashes AS (
  SELECT side, id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h
  FROM (SELECT side, id, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS w FROM {name}_texts)),
{name}_cells AS (
  SELECT side, id, h % {DIM} AS b, sum(CASE WHEN h >= 2147483648 THEN -1.0 ELSE 1.0 END) AS x FROM {name}_hashes GROUP BY ALL),
{name}_norms AS (SELECT side, id, sqrt(sum(x * x)) AS n FROM {name}_cells GROUP BY ALL),
{name}_vectors AS (
  SELECT t.side, t.id, list(CAST(CASE WHEN n.n > 0 THEN coalesce(c.x, 0) / n.n ELSE 0 END AS FLOAT) ORDER BY r.b) AS v
  FROM {name}_texts t CROSS JOIN (SELECT unnest(range({DIM})) AS b) r
       LEFT JOIN {name}_cells c ON c.side = t.side AND c.id = t.id AND c.b = r.b
       LEFT JOIN {name}_norms n ON n.side = t.side AND n.id = t.id
  GROUP BY t.side, t.id),
{name}_pairs AS (
  SELECT q.id AS query_id, c.id AS key, i.issuetype, i.text,
         list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS similarity
  FROM {name}_vectors q JOIN {name}_vectors c ON q.side = 'q' AND c.side = 'c' AND q.id <> c.id JOIN index_rows i ON i.key = c.id),
{name} AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key ASC) AS INTEGER) AS rank
    FROM {name}_pairs) WHERE rank <= {k})"""


TRACKER = """tracker AS (
  SELECT r.r_name AS repo, o.o_orderkey, CAST(o.o_orderkey AS VARCHAR) AS key,
         strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created,
         o.o_orderpriority AS issuetype, c.c_mktsegment AS project,
         o.o_orderstatus, o.o_custkey, r.r_regionkey
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN nation n ON c.c_nationkey = n.n_nationkey
       JOIN region r ON n.n_regionkey = r.r_regionkey)"""

CHANGES_ONLY = """changes AS (
  SELECT t.repo, t.key,
         CASE e.event_type WHEN 'error' THEN 'issuetype' WHEN 'purchase' THEN 'project' ELSE e.event_type END AS field,
         json_extract_string(e.props, '$.k') AS fromString, e.event_type AS toString,
         strftime(e.ts, '%Y-%m-%d') AS day, e.ts, e.event_id
  FROM events e JOIN tracker t ON t.o_orderkey = e.user_id)"""

LINKS_ONLY = """links AS (
  SELECT t.repo, t.key, CAST(l.l_partkey AS VARCHAR) AS link_id, l.l_returnflag AS link_type,
         l.l_linestatus, l.l_linenumber
  FROM lineitem l JOIN tracker t ON t.o_orderkey = l.l_orderkey)"""

COMMENTS_ONLY = """comments AS (
  SELECT t.repo, t.key, CAST(cv.turn AS VARCHAR) AS id, lpad(CAST(cv.turn AS VARCHAR), 4, '0') AS created,
         cv.text AS body, cv.turn
  FROM conversations cv JOIN tracker t ON t.o_orderkey = cv.conv_id)"""

REPOS = """repos AS (
  SELECT r_name AS repo, 'customfield_' || CAST(10000 + r_regionkey AS VARCHAR) AS epic_field,
         CAST(r_regionkey AS INTEGER) AS born_skip
  FROM region)"""


CHANGES = TRACKER + ",\n" + CHANGES_ONLY
LINKS = TRACKER + ",\n" + LINKS_ONLY
COMMENTS = TRACKER + ",\n" + COMMENTS_ONLY


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)
