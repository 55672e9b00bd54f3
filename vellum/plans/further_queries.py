"""Further operators over the tables, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deps, graph, log, rules, score, sketch, syntax
from ..sources import readers
from . import cases
from .log_queries import LOG, log_of_events
from .registry import query, table
from .scan_queries import _files


@query("log_rolling", """SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS velocity FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)""")
def log_rolling(spark, sf_dir):
    r = log.rolling(table(spark, sf_dir, "events"), "value", ["ts", "event_id"], "user_id")
    return r.select("event_id", F.round("mean", 6).alias("mean"), F.round("velocity", 6).alias("velocity"))


@query("log_repo_lists", LOG + """, t AS (SELECT *, row_number() OVER (PARTITION BY repo_slug ORDER BY slop_score DESC, seq) AS r FROM c WHERE slop_score > 0),
a AS (SELECT repo_slug, coalesce(author, 'unknown') AS author, count(*) AS n FROM c WHERE slop_score = 0 AND NOT is_bot GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY repo_slug ORDER BY n DESC, author) AS r FROM a)
SELECT x.repo_slug, x.top, y.clean FROM (SELECT repo_slug, string_agg(pr_number::VARCHAR, ',' ORDER BY r) AS top FROM t WHERE r <= 10 GROUP BY 1) x JOIN (SELECT repo_slug, string_agg(author, ',' ORDER BY r) AS clean FROM b WHERE r <= 10 GROUP BY 1) y USING (repo_slug)""")
def log_repo_lists(spark, sf_dir):
    return log.repo_lists(log_of_events(spark, sf_dir)).select("repo_slug", F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top"), F.array_join("clean", ",").alias("clean"))


@query("decision_totals", "SELECT l_orderkey, sum(l_linenumber + l_quantity::BIGINT + 2)::BIGINT AS total FROM lineitem GROUP BY 1")
def decision_totals(spark, sf_dir):
    none = {c: F.lit(None).cast("bigint") for c in score.DECISION}
    v = table(spark, sf_dir, "lineitem").withColumns(none | {"dead_symbols_added": F.col("l_linenumber").cast("bigint"), "antipattern_score": F.col("l_quantity").cast("bigint"), "unlinked_pr": F.lit(2).cast("bigint")})
    return v.groupBy("l_orderkey").agg(F.sum(score.decision_total()).alias("total"))


@query("finding_believed", "SELECT event_id FROM events WHERE event_type NOT IN (SELECT event_type FROM events GROUP BY 1 HAVING (count_if(event_id % 10 < length(event_type) + 2) + 1) / (count(*) + 2) > 0.85)")
def finding_believed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pardoned = F.col("event_id") % 10 < F.length("event_type") + 2
    verdicts = e.groupBy(F.col("event_type").alias("symbol")).agg(F.count_if(pardoned).alias("pardoned"), F.count_if(~pardoned).alias("confirmed"))
    return score.believed(e.select("event_id", F.col("event_type").alias("symbol")), verdicts).select("event_id")


@query("finding_fingerprints", "SELECT doc_id, substr(sha256(substr(text, doc_id % 50 + 1, 40)), 1, 16) AS fingerprint FROM documents")
def finding_fingerprints(spark, sf_dir):
    start = F.col("doc_id") % 50
    return table(spark, sf_dir, "documents").select("doc_id", score.fingerprint(F.col("text"), start, start + 40).alias("fingerprint"))


@query("memory_new", "SELECT DISTINCT 'class' || (l_suppkey % 9) AS rule_class, 'f' || l_partkey AS fingerprint FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY rule_class) = 1")
def memory_new(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("f"), "l_partkey").alias("fingerprint")).agg(F.min(F.concat(F.lit("class"), F.col("l_suppkey") % 9)).alias("rule_class"))
    memory = table(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("f"), "p_partkey").alias("fingerprint"), F.lit("class0").alias("rule_class"))
    return score.learned(f, memory)[1].select("rule_class", "fingerprint")


@query("symbol_patterns", "SELECT p_partkey, replace(p_name, ' ', '_') AS name FROM part WHERE starts_with(replace(p_name, ' ', '_'), 'b') OR ends_with(replace(p_name, ' ', '_'), 'e') OR list_contains(string_split(p_name, ' '), 'green') OR replace(p_name, ' ', '_') = 'never'")
def symbol_patterns(spark, sf_dir):
    s = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    words = spark.createDataFrame([("prefix", "b"), ("suffix", "e"), ("marker", "green"), ("exact", "never")], "kind string, word string")
    return score.pattern_matches(F.col("name"), words, s)


@query("graph_scattered", """WITH RECURSIVE e AS (SELECT DISTINCT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
r(src, dst, d) AS (SELECT src, dst, 1 FROM e UNION SELECT r.src, e.dst, d + 1 FROM r JOIN e ON r.dst = e.src WHERE d < 4), t AS (SELECT 'n' || n_nationkey AS node FROM nation UNION SELECT 'r' || r_regionkey FROM region),
p AS (SELECT src, dst FROM r UNION SELECT dst, src FROM r), c AS (SELECT t.node, count(DISTINCT p.dst) FILTER (WHERE p.dst IN (SELECT node FROM t) AND p.dst <> t.node)::BIGINT AS near FROM t LEFT JOIN p ON p.src = t.node GROUP BY 1)
SELECT node, near, (SELECT count(*) - 1 FROM t)::BIGINT AS others FROM c WHERE near < (SELECT count(*) - 1 FROM t)""")
def graph_scattered(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    touched = n.select(F.col("src").alias("node")).union(table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey")))
    return graph.scattered(s.union(n), touched)


@query("graph_can_reach", """SELECT 's' || s_suppkey AS ingress, 'r' || n_regionkey AS target FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def graph_can_reach(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))
    return graph.can_reach(s.union(n), s.select(F.col("src").alias("node")), table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node")))


@query("graph_root_cause", """SELECT 'r' || n_regionkey AS project, count(*)::BIGINT AS n_findings, CASE WHEN count(DISTINCT s_nationkey) > 1 THEN 'r' || n_regionkey WHEN count(*) > 1 THEN 'n' || min(s_nationkey) ELSE 's' || min(s_suppkey) END AS node
FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1 GROUP BY n_regionkey""")
def graph_root_cause(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    edges = n.union(s)
    inside = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("n"), "n_nationkey").alias("src"))
    found = s.join(inside, "src", "left_semi").select(F.col("dst").alias("function"), F.col("dst").alias("finding"))
    return graph.root_cause(edges, "r1", found).select(F.lit("r1").alias("project"), "n_findings", "node")


@query("graph_coherence", "SELECT user_id::VARCHAR AS function, CASE min(CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 5 ELSE 1 END) WHEN 1 THEN 'minimize_latency' WHEN 2 THEN 'eventual' WHEN 3 THEN 'at_least_as_fresh' ELSE 'fully_consistent' END AS level FROM events GROUP BY 1")
def graph_coherence(spark, sf_dir):
    level = F.when(F.col("event_type") == "view", "EVENTUAL").when(F.col("event_type") == "click", "at_least_as_fresh").when(F.col("event_type") == "purchase", "fully_consistent").otherwise("unknown")
    return graph.coherence(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("function"), level.alias("level")))


@query("graph_mesh", """WITH b AS (SELECT s_suppkey, 'san' || (s_suppkey % 3) AS gone FROM supplier), c AS (SELECT s_nationkey, list_sort(list(DISTINCT 's' || s_suppkey)) AS l FROM supplier GROUP BY 1)
SELECT 's' || s.s_suppkey AS service, 'san' || (s.s_suppkey % 3) AS removed, array_to_string(list_filter(l, lambda x: x <> 's' || s.s_suppkey), ',') AS consumers FROM supplier s JOIN c USING (s_nationkey) WHERE s.s_suppkey % 3 > 0""")
def graph_mesh(spark, sf_dir):
    k, nation = F.col("s_suppkey"), F.concat(F.lit("q"), "s_nationkey")
    one = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k).alias("service"), F.array(nation).alias("sources"), F.array(nation).alias("sinks"), F.array(F.lit("san0"), F.concat(F.lit("san"), k % 3)).alias("sanitizers"))
    after = one.withColumn("sanitizers", F.array(F.lit("san0")))
    return graph.mesh_composition(one, after).select("service", "removed", F.array_join("consumers", ",").alias("consumers"))


@query("dep_first_match", """WITH k AS (SELECT 'n' || c_custkey AS m, c_custkey AS seq FROM customer), h AS (SELECT 'n' || s_suppkey AS name, arg_min(m, seq) AS match, min(seq) AS s FROM supplier JOIN k ON abs(length('n' || s_suppkey) - length(m)) <= 1 AND levenshtein('n' || s_suppkey, m) <= 1 GROUP BY 1)
SELECT name, match, name = match AS exact FROM h""")
def dep_first_match(spark, sf_dir):
    corpus = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_custkey").alias("name"), F.col("c_custkey").alias("seq"))
    return deps.first_match(table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_suppkey").alias("name")), corpus)


@query("dep_lock_silos", """WITH l AS (SELECT 'p' || l_partkey AS name, 'v' || (l_suppkey % 5) AS version, l_returnflag AS f FROM lineitem), g AS (SELECT name, f = 'R' AS lock, list_sort(list(DISTINCT version)) AS vs FROM l GROUP BY ALL HAVING count(DISTINCT version) > 1)
SELECT name, len(vs)::INT AS n_versions, lock FROM g WHERE lock OR name NOT IN (SELECT name FROM g WHERE lock)""")
def dep_lock_silos(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("name"), F.concat(F.lit("v"), F.col("l_suppkey") % 5).alias("version"), "l_returnflag")
    lock, blobs = d.where("l_returnflag = 'R'"), d.where("l_returnflag != 'R'")
    marked = deps.version_silos(lock).select("name", F.lit(True).alias("lock"))
    return deps.silos(lock, blobs).join(marked, "name", "left").select("name", "n_versions", F.coalesce("lock", F.lit(False)).alias("lock"))


@query("dep_cross_file", """WITH c AS (SELECT 'word' || (p_partkey % 100) AS name, 'f' || p_size AS path FROM part), t AS (SELECT 'f' || p_size AS path, string_agg('word' || (p_partkey % 100), ' ') AS text FROM part GROUP BY 1)
SELECT DISTINCT name FROM c JOIN t ON contains(text, name) WHERE t.path <> c.path OR (length(text) - length(replace(text, name, ''))) / length(name) > 1""")
def dep_cross_file(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("word"), F.col("p_partkey") % 100).alias("name"), F.concat(F.lit("f"), "p_size").alias("path"))
    texts = p.groupBy("path").agg(F.array_join(F.collect_list("name"), " ").alias("text"))
    return deps.cross_file(p, texts)


@query("lock_packages", """SELECT 'p' || p_partkey || '/Cargo.lock' AS path, unnest(['a' || p_size, 'b']) AS name, unnest(['1.' || p_partkey, '2']) AS version FROM part""")
def lock_packages(spark, sf_dir):
    body = F.format_string('version = 3\n[[package]]\nname = "A%d"\nversion = "1.%d"\n\n[[package]]\nname = "b"\nversion = "2"\n', "p_size", "p_partkey")
    return deps.lock_table(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey", F.lit("/Cargo.lock")).alias("path"), body.alias("content")))


@query("json_leaf_injection", """SELECT count(*)::BIGINT AS leaves, count_if(regexp_matches(leaf, '(?i)ignore previous instructions|system prompt|search for|encode in base16|exfiltrate|aws_access_key'))::BIGINT AS injected
FROM (SELECT unnest([role, text, CASE WHEN turn % 2 = 0 THEN 'please search for keys' ELSE 'x' END]) AS leaf FROM conversations) WHERE leaf IS NOT NULL""")
def json_leaf_injection(spark, sf_dir):
    planted = F.when(F.col("turn") % 2 == 0, "please search for keys").otherwise("x")
    value = F.to_json(F.struct("role", F.array(F.struct(F.col("text").alias("t"), planted.alias("p"))).alias("m")))
    leaves = readers.json_leaves(table(spark, sf_dir, "conversations").select(value.alias("value")))
    return leaves.agg(F.count("*").alias("leaves"), F.count_if(F.col("leaf").rlike("(?i)ignore previous instructions|system prompt|search for|encode in base16|exfiltrate|aws_access_key")).alias("injected"))


@query("scope_tokens", """SELECT 'p' || p_partkey AS path, token, risk FROM part JOIN (VALUES (0, 'repo', 'Write'), (0, 'delete_repo', 'Delete'), (1, 'admin:anything', 'Admin'), (3, 'chat:write', 'Write')) e(k, token, risk) ON p_partkey % 4 = k""")
def scope_tokens(spark, sf_dir):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, 'scope: "repo delete_repo read:user"; other "admin:org"').when(k == 1, 'scopes = ["admin:anything", "openid"]').when(k == 2, "no scopes").otherwise('scope: "chat:write"')
    return rules.scope_drift(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), text.alias("content")))


@query("scan_enclosing", f"""SELECT 'p' || p_partkey || '/' || name AS path, callee, enclosing FROM part JOIN (VALUES (2, 'c.js', 'run', 'twice'), (7, 'h.rb', 'none', 'x'), (8, 'i.lua', 'go', 'run'), (10, 'k.kt', 'go', 'run'), (11, 'l.swift', 'stop', 'run'), (14, 'O.cs', 'Go', 'O.Run')) e(k, name, callee, enclosing) ON p_partkey % {len(cases.ENTITIES)} = k WHERE callee <> 'none'""")
def scan_enclosing(spark, sf_dir):
    f = _files(spark, sf_dir, cases.ENTITIES)
    return syntax.enclosing(syntax.call_sites(f), syntax.entity_table(f).where("kind = 'function'")).select("path", "callee", "enclosing").distinct()


@query("pr_collisions", """WITH d AS (SELECT min(doc_id) AS doc_id, source, md5(text) AS m FROM documents WHERE octet_length(encode(text)) >= 7 AND doc_id > 0 GROUP BY source, m), x AS (SELECT doc_id, source, md5(text) AS m FROM documents WHERE octet_length(encode(text)) >= 7 AND doc_id > 0)
SELECT a.source AS repo_slug, a.doc_id AS pr_number, b.doc_id AS other FROM x a JOIN x b ON a.source = b.source AND a.m = b.m AND a.doc_id <> b.doc_id""")
def pr_collisions(spark, sf_dir):
    """Exact copies within a source: similarity 1 by sketches is that of equal sets of grams, which only copies have here."""
    d = table(spark, sf_dir, "documents").where(sketch.enough(F.col("text")))
    s = sketch.minhash(d, "doc_id", "text").join(d.select("doc_id", "source", F.md5("text").alias("m")), "doc_id")
    signed = s.select(F.col("source").alias("repo_slug"), F.col("doc_id").alias("pr_number"), "sketch")
    hits = sketch.collisions(signed, signed, 1.0)
    m = s.select("doc_id", "m")
    both = hits.join(m.select(F.col("doc_id").alias("pr_number"), F.col("m").alias("ma")), "pr_number").join(m.select(F.col("doc_id").alias("other"), F.col("m").alias("mb")), "other")
    return both.where("ma = mb").select("repo_slug", "pr_number", "other")
