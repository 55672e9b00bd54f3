"""Dependency and graph queries; the order tables play dependencies and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deps, graph, score
from .registry import query, table

_V = "'p' || l_partkey AS name, 'v' || (l_suppkey % 5) AS version, year(l_shipdate) AS y"


def _deps(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("name"), F.concat(F.lit("v"), F.col("l_suppkey") % 5).alias("version"), F.year("l_shipdate").alias("y"))


@query("dep_version_silos", f"""WITH d AS (SELECT {_V} FROM lineitem), g AS (SELECT name, list_sort(list(DISTINCT version)) AS vs FROM d GROUP BY name)
SELECT name, len(vs)::INT AS n_versions, name || ' (' || array_to_string(vs, ' vs ') || ')' AS display FROM g WHERE len(vs) > 1""")
def dep_version_silos(spark, sf_dir):
    return deps.version_silos(_deps(spark, sf_dir))


@query("dep_silo_delta", f"""WITH d AS (SELECT {_V} FROM lineitem), h AS (SELECT name, list_sort(list(DISTINCT version)) AS vs FROM d WHERE y >= 1997 GROUP BY name HAVING count(DISTINCT version) > 1),
b AS (SELECT name FROM d WHERE y < 1997 GROUP BY name HAVING count(DISTINCT version) > 1)
SELECT name, len(vs)::INT AS n_versions, name || ' (' || array_to_string(vs, ' vs ') || ')' AS display FROM h ANTI JOIN b USING (name)""")
def dep_silo_delta(spark, sf_dir):
    d = _deps(spark, sf_dir)
    return deps.silo_delta(d.where("y >= 1997"), d.where("y < 1997"))


@query("dep_phantom", """SELECT DISTINCT 'call_part_' || l_partkey AS name FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) AND l_partkey NOT IN (SELECT s_suppkey FROM supplier)
 AND length('call_part_' || l_partkey) >= 8""")
def dep_phantom(spark, sf_dir):
    named = lambda df, c: df.select(F.concat(F.lit("call_part_"), c).alias("name"))
    return deps.phantom_calls(named(table(spark, sf_dir, "lineitem"), "l_partkey"), named(table(spark, sf_dir, "part").where("p_size < 25"), "p_partkey"), named(table(spark, sf_dir, "supplier"), "s_suppkey"))


@query("dep_fuzzy_name", """WITH a AS (SELECT DISTINCT 'n' || s_suppkey AS name FROM supplier), b AS (SELECT DISTINCT 'n' || c_custkey AS m FROM customer)
SELECT name, m AS match, levenshtein(name, m)::INT AS edits FROM a JOIN b ON abs(length(name) - length(m)) <= 1 AND levenshtein(name, m) <= 1""")
def dep_fuzzy_name(spark, sf_dir):
    named = lambda t, c: table(spark, sf_dir, t).select(F.concat(F.lit("n"), c).alias("name"))
    return deps.fuzzy_names(named("supplier", "s_suppkey"), named("customer", "c_custkey"))


@query("dep_known_vulnerable", """WITH d AS (SELECT DISTINCT p_brand AS name, p_size AS v FROM part), r AS (SELECT DISTINCT p_brand AS name, 10 AS a, 20 AS b, 'CVE-' || p_brand AS cve FROM part WHERE p_size > 45)
SELECT DISTINCT d.name, '1.' || v AS version, cve FROM d JOIN r ON d.name = r.name WHERE v >= a AND v < b""")
def dep_known_vulnerable(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    d = p.select(F.col("p_brand").alias("name"), F.concat(F.lit("1."), "p_size").alias("version"), F.lit("npm").alias("ecosystem"))
    r = p.where("p_size > 45").select(F.upper("p_brand").alias("package"), F.lit("npm").alias("ecosystem"), F.lit("1.10").alias("introduced"), F.lit("1.20").alias("fixed"), F.concat(F.lit("CVE-"), "p_brand").alias("cve")).distinct()
    return deps.known_vulnerable(d, r)


@query("dep_drift", "SELECT DISTINCT 'p' || l_partkey AS name FROM lineitem WHERE year(l_shipdate) >= 1998 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE year(l_shipdate) < 1994)")
def dep_drift(spark, sf_dir):
    d = _deps(spark, sf_dir)
    return deps.drift(d.where("y >= 1998"), d.where("y < 1994"))


_EDGES = "WITH RECURSIVE e AS (SELECT DISTINCT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT DISTINCT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT DISTINCT 'r' || r_regionkey, 'n' || (r_regionkey + 3) FROM region WHERE r_regionkey < 2)"


def _edges(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"))
    r = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.concat(F.lit("r"), "r_regionkey"), F.concat(F.lit("n"), F.col("r_regionkey") + 3))
    return n.union(s).union(r).distinct()


_REACH = _EDGES + ", r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src), nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"


@query("graph_reach", _REACH + "SELECT node, count(r.src)::BIGINT AS reach FROM nodes LEFT JOIN r ON r.dst = node AND r.src <> node GROUP BY node")
def graph_reach(spark, sf_dir):
    return graph.reach(_edges(spark, sf_dir))


@query("graph_silos", _REACH + """, d AS (SELECT dst AS node, count(*)::BIGINT AS in_degree FROM e GROUP BY 1), c AS (SELECT node, count(r.src)::BIGINT AS reach FROM nodes LEFT JOIN r ON r.dst = node AND r.src <> node GROUP BY node)
SELECT c.node, coalesce(in_degree, 0) AS in_degree, reach FROM c LEFT JOIN d ON c.node = d.node ORDER BY reach DESC, c.node LIMIT 10""")
def graph_silos(spark, sf_dir):
    return graph.silos(_edges(spark, sf_dir))


#: Two snapshots of which supplier ships which part, before and after a day.
_BASE_HEAD = "WITH base AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_shipdate < DATE '1995-06-17'), head AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_shipdate >= DATE '1995-06-17')"


def _base_head(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    e = lambda df: df.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    return e(li.where("l_shipdate < DATE '1995-06-17'")), e(li.where("l_shipdate >= DATE '1995-06-17'"))


@query("graph_edge_delta", _BASE_HEAD + "SELECT *, 'added' AS change FROM (SELECT * FROM head EXCEPT SELECT * FROM base) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM base EXCEPT SELECT * FROM head)")
def graph_edge_delta(spark, sf_dir):
    return graph.edge_delta(*_base_head(spark, sf_dir))


#: Suppliers and customers with their nation and region: triangles, and hubs with thousands of neighbours.
_PLACES = "WITH e AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION SELECT 's' || s_suppkey, 'r' || n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'c' || c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


def _places(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("n"), "n_nationkey").alias("n"), F.concat(F.lit("r"), "n_regionkey").alias("r"))
    out = n.select(F.col("n").alias("src"), F.col("r").alias("dst"))
    for t, prefix, key, nation in (("supplier", "s", "s_suppkey", "s_nationkey"), ("customer", "c", "c_custkey", "c_nationkey")):
        of = table(spark, sf_dir, t).select(F.concat(F.lit(prefix), key).alias("src"), F.col(nation).alias("n_nationkey")).join(n, "n_nationkey")
        out = out.union(of.select("src", "n")).union(of.select("src", "r"))
    return out


@query("graph_clustering", _PLACES + """, nb AS (SELECT src AS node, dst AS nb FROM e UNION SELECT dst, src FROM e), k AS (SELECT node, count(*)::BIGINT AS k FROM nb GROUP BY 1 HAVING count(*) >= 2),
l AS (SELECT x.node, count(*)::BIGINT AS links FROM nb x JOIN e ON e.src = x.nb JOIN nb y ON x.node = y.node AND e.dst = y.nb GROUP BY 1)
SELECT k.node, k, coalesce(links, 0) AS links, round(coalesce(links, 0) / (k * (k - 1)), 6) AS coefficient FROM k LEFT JOIN l ON k.node = l.node""")
def graph_clustering(spark, sf_dir):
    return graph.clustering(_places(spark, sf_dir)).withColumn("coefficient", F.round("coefficient", 6))


@query("graph_shortest", """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 1 + n_nationkey % 4 AS cost FROM nation
 UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 1 + s_suppkey % 3 FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'n' || ((n_nationkey * 7 + 3) % 25), 2 FROM nation),
m AS (SELECT src, dst, min(cost) AS cost FROM e GROUP BY ALL),
p(node, cost, hops) AS (SELECT 'r1', 0::BIGINT, 0 UNION SELECT m.dst, p.cost + m.cost, p.hops + 1 FROM p JOIN m ON p.node = m.src WHERE p.hops < 12)
SELECT node, min(cost)::BIGINT AS cost FROM p GROUP BY node""")
def graph_shortest(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    e = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), (1 + F.col("n_nationkey") % 4).cast("bigint").alias("cost"))
    e = e.union(s.select(F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey"), (1 + F.col("s_suppkey") % 3).cast("bigint")))
    e = e.union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("n"), (F.col("n_nationkey") * 7 + 3) % 25), F.lit(2).cast("bigint")))
    return graph.shortest(e, F.lit("r1")).select("node", "cost")


@query("graph_taint", """WITH RECURSIVE c AS (SELECT 's' || s_suppkey AS caller, 'n' || s_nationkey AS callee, s_suppkey % 2 AS la, s_nationkey % 2 AS lb FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey % 2, n_regionkey % 2 FROM nation
 UNION SELECT 'r' || r_regionkey, 'n' || (r_regionkey * 5 + 1), r_regionkey % 2, (r_regionkey + 1) % 2 FROM region),
f(s, function, label) AS (SELECT 's' || s_suppkey, 's' || s_suppkey, 0 FROM supplier UNION SELECT f.s, c.callee, c.lb FROM f JOIN c ON f.function = c.caller AND f.label = c.la)
SELECT s AS seed_function, function, label::INT AS label FROM f WHERE function LIKE 'r%'""")
def graph_taint(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    call = lambda df, a, ka, b, kb, la, lb: df.select(F.concat(F.lit(a), ka).alias("caller"), F.concat(F.lit(b), kb).alias("callee"), (la % 2).cast("int").alias("caller_label"), (lb % 2).cast("int").alias("callee_label"))
    k = F.col("r_regionkey")
    calls = call(s, "s", "s_suppkey", "n", "s_nationkey", F.col("s_suppkey"), F.col("s_nationkey")).union(call(n, "n", "n_nationkey", "r", "n_regionkey", F.col("n_nationkey"), F.col("n_regionkey"))).union(call(r, "r", k, "n", k * 5 + 1, k, k + 1)).distinct()
    seeds = s.select(F.concat(F.lit("s"), "s_suppkey").alias("function"), F.lit(0).alias("label"))
    sinks = r.select(F.concat(F.lit("r"), k).alias("function"), F.explode(F.array(F.lit(0), F.lit(1))).alias("label"), F.lit("sink").alias("sink_label"))
    return graph.taint(calls, sinks, seeds).select("seed_function", "function", "label")


@query("graph_deflation", _BASE_HEAD + """, removed AS (SELECT * FROM base EXCEPT SELECT * FROM head), rb AS (SELECT dst AS node, count(*) AS r FROM base GROUP BY 1), rh AS (SELECT dst AS node, count(*) AS r FROM head GROUP BY 1)
SELECT (SELECT count(*) FROM removed)::BIGINT AS edges_severed, (SELECT coalesce(sum(greatest(coalesce(rb.r, 0) - coalesce(rh.r, 0), 0)), 0) FROM (SELECT DISTINCT dst AS node FROM removed) t LEFT JOIN rb USING (node) LEFT JOIN rh USING (node))::BIGINT AS bonus""")
def graph_deflation(spark, sf_dir):
    return graph.deflation(*_base_head(spark, sf_dir))


@query("graph_inherited", """WITH RECURSIVE a(node, up) AS (SELECT 's' || s_suppkey, 's' || s_suppkey FROM supplier UNION SELECT 'n' || n_nationkey, 'n' || n_nationkey FROM nation UNION SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region
 UNION SELECT a.node, e.dst FROM a JOIN (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation) e ON a.up = e.src)
SELECT node, array_to_string(list_sort(list(DISTINCT 'm' || right(up, 1))), ',') AS middlewares FROM a GROUP BY node""")
def graph_inherited(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    nodes = n.select("src").union(s.select("src")).union(table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey"))).toDF("node")
    own = nodes.select("node", F.concat(F.lit("m"), F.right("node", F.lit(1))).alias("middleware"))
    return graph.inherited(n.union(s), own).select("node", F.array_join("middlewares", ",").alias("middlewares"))


@query("proven_invariants", """SELECT 's' || l_suppkey AS sanitizer_path, l_returnflag AS finding_class, sum(l_linenumber)::BIGINT AS observed, sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber ELSE 0 END)::BIGINT AS clean
FROM lineitem GROUP BY 1, 2 HAVING observed > 0 AND clean * 100 >= 60 * observed""")
def proven_invariants(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("sanitizer_path"), F.col("l_returnflag").alias("finding_class"), F.col("l_linenumber").alias("repos_observed"), F.when(F.col("l_linestatus") == "F", F.col("l_linenumber")).otherwise(0).alias("clean_repos"))
    return score.proven(v, 60).select("sanitizer_path", "finding_class", "observed", "clean")
