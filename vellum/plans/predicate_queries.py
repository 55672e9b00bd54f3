"""Predicates and further graph questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import graph
from .registry import query, table


@query("path_domains", """WITH p AS (SELECT p_partkey, (CASE p_size % 4 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'a/tests/' WHEN 2 THEN 'src/' ELSE 'node_modules/test/' END) || p_partkey || '.rs' AS path FROM part)
SELECT p_partkey, CASE WHEN '/' || path LIKE '%/vendor/%' OR '/' || path LIKE '%/node_modules/%' THEN 2 WHEN '/' || path LIKE '%/tests/%' THEN 4 ELSE 1 END::INT AS domain FROM p""")
def path_domains(spark, sf_dir):
    kind = F.col("p_size") % 4
    path = F.concat(F.when(kind == 0, "vendor/").when(kind == 1, "a/tests/").when(kind == 2, "src/").otherwise("node_modules/test/"), "p_partkey", F.lit(".rs"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.domain(path).alias("domain"))


@query("author_kinds", """WITH a AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'app/x' WHEN 1 THEN 'Copilot[bot]' WHEN 2 THEN 'Renovate' ELSE c_name END AS author,
 CASE WHEN c_custkey % 3 = 0 THEN 'text' || chr(10) || 'Co-authored-by: Copilot <x>' WHEN c_custkey % 7 = 0 THEN NULL ELSE '[REFACTOR] x' END AS body FROM customer)
SELECT c_custkey, author LIKE 'app/%' OR author LIKE '%[bot]' OR lower(author) = 'renovate' AS automation, lower(author) = 'copilot[bot]' OR c_custkey % 3 = 0 AS agentic,
 c_custkey % 3 = 0 AND lower(author) <> 'copilot[bot]' AS impersonation, coalesce(contains(body, '[REFACTOR]'), false) AS refactor FROM a""")
def author_kinds(spark, sf_dir):
    k = F.col("c_custkey")
    author = F.when(k % 5 == 0, "app/x").when(k % 5 == 1, "Copilot[bot]").when(k % 5 == 2, "Renovate").otherwise(F.col("c_name"))
    body = F.when(k % 3 == 0, "text\nCo-authored-by: Copilot <x>").when(k % 7 == 0, F.lit(None).cast("string")).otherwise("[REFACTOR] x")
    a = table(spark, sf_dir, "customer").select("c_custkey", author.alias("author"), body.alias("body"))
    author, body = F.col("author"), F.col("body")
    return a.select("c_custkey", scalars.automation_account(author, ("renovate",)).alias("automation"), scalars.agentic_actor(author, body).alias("agentic"), scalars.impersonation(author, body).alias("impersonation"), scalars.refactor(body).alias("refactor"))


@query("glob_matches", "SELECT o_orderkey FROM orders WHERE regexp_matches('a/' || o_orderpriority || '/' || o_orderkey || '.rs', '^a/[^/]*/[^/]*1\\.rs$')")
def glob_matches(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("a/"), "o_orderpriority", F.lit("/"), "o_orderkey", F.lit(".rs")).alias("path"))
    return o.withColumn("re", scalars.glob_regex(F.lit("a/*/*1.rs"))).where("path RLIKE re").select("o_orderkey")


_CHAIN = """WITH RECURSIVE base AS (SELECT DISTINCT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier), head AS (SELECT * FROM base UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
r(src, dst) AS (SELECT src, dst FROM head UNION SELECT r.src, head.dst FROM r JOIN head ON r.dst = head.src)
"""


@query("graph_bloat", _CHAIN + """SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, c.n AS includer_reach, 0::BIGINT AS weight
FROM nation JOIN (SELECT dst, count(DISTINCT src)::BIGINT AS n FROM r GROUP BY 1) c ON c.dst = 'n' || n_nationkey WHERE c.n >= 4""")
def graph_bloat(spark, sf_dir):
    base = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    up = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    return graph.bloat(base, base.union(up), least=4)


_RING = """WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'n' || (r_regionkey * 5 + 1) FROM region)"""


def _ring(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.concat(F.lit("n"), F.col("r_regionkey") * 5 + 1))
    return s.union(n).union(r).distinct()


@query("graph_unvalidated", _RING + """, v AS (SELECT 'n' || n_nationkey AS node FROM nation WHERE n_name < 'G'),
o AS (SELECT * FROM e WHERE src NOT IN (SELECT node FROM v) AND dst NOT IN (SELECT node FROM v)), r(src, dst) AS (SELECT src, dst FROM o WHERE src LIKE 's%' UNION SELECT r.src, o.dst FROM r JOIN o ON r.dst = o.src)
SELECT src AS source, dst AS sink FROM r WHERE dst LIKE 'r%'""")
def graph_unvalidated(spark, sf_dir):
    node = lambda t, prefix, key: table(spark, sf_dir, t).select(F.concat(F.lit(prefix), key).alias("node"))
    guards = table(spark, sf_dir, "nation").where("n_name < 'G'").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return graph.unvalidated(_ring(spark, sf_dir), node("supplier", "s", "s_suppkey"), node("region", "r", "r_regionkey"), guards)


@query("graph_unbounded", _RING + ", r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT DISTINCT src AS node FROM r WHERE src = dst")
def graph_unbounded(spark, sf_dir):
    return graph.unbounded(_ring(spark, sf_dir))


@query("human_sizes", """WITH s AS (SELECT doc_id, unnest([strlen(text), strlen(text) * 1000, strlen(text) * 1000000])::BIGINT AS n FROM documents)
SELECT doc_id, n, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{:.1f} KB', n / 1024.0) ELSE format('{:.1f} MB', n / 1048576.0) END AS size FROM s""")
def human_sizes(spark, sf_dir):
    n = F.octet_length("text").cast("bigint")
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(n, n * 1000, n * 1000000)).alias("n"))
    return d.select("doc_id", "n", scalars.human_bytes(F.col("n")).alias("size"))
