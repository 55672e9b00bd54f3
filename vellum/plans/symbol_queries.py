"""Symbols, sinks, streams: the order tables play symbols and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cascade
from ..sources import sinks
from ..streaming import jobs
from .log_queries import LOG, log_of_events
from .registry import query, table

#: Parts, customers and suppliers are symbols; shipments and orders refer to the first two.
_SYMBOLS = """WITH s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN '__f' || p_partkey || '__' WHEN p_partkey % 7 = 0 THEN 'test_' || p_partkey ELSE 'fn' || p_partkey END AS name,
 CASE WHEN p_size < 5 THEN 'tests/' ELSE 'src/' END || 'm' || (p_size) || '.py' AS file_path FROM part
 UNION ALL SELECT 10000000 + c_custkey, 'cu' || c_custkey, 'src/c' || c_custkey || '.py' FROM customer
 UNION ALL SELECT 30000000 + s_suppkey, 'su' || s_suppkey, 'src/s' || s_nationkey || '.py' FROM supplier),
e AS (SELECT l_suppkey AS src_id, l_partkey AS dst_id FROM lineitem UNION ALL SELECT l_partkey, 10000000 + o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
"""


def _symbols(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 10 == 0, F.concat(F.lit("__f"), k, F.lit("__"))).when(k % 7 == 0, F.concat(F.lit("test_"), k)).otherwise(F.concat(F.lit("fn"), k))
    path = F.concat(F.when(F.col("p_size") < 5, "tests/").otherwise("src/"), F.lit("m"), "p_size", F.lit(".py"))
    c = table(spark, sf_dir, "customer").select((F.lit(10000000) + F.col("c_custkey")).alias("id"), F.concat(F.lit("cu"), "c_custkey").alias("name"), F.concat(F.lit("src/c"), "c_custkey", F.lit(".py")).alias("file_path"))
    s = table(spark, sf_dir, "supplier").select(F.lit(30000000) + F.col("s_suppkey"), F.concat(F.lit("su"), "s_suppkey"), F.concat(F.lit("src/s"), "s_nationkey", F.lit(".py")))
    return table(spark, sf_dir, "part").select(k.alias("id"), name.alias("name"), path.alias("file_path")).union(c).union(s)


def _references(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return li.select(F.col("l_suppkey").alias("src_id"), F.col("l_partkey").alias("dst_id")).union(li.join(orders, "l_orderkey").select("l_partkey", F.lit(10000000) + F.col("o_custkey")))


_STAGE = """, p AS (SELECT s.*, CASE WHEN file_path LIKE 'tests/%' THEN 'Directory' WHEN name LIKE 'test\\_%' ESCAPE '\\' THEN 'Heuristic'
 WHEN id IN (SELECT dst_id FROM e WHERE src_id <> dst_id) THEN 'Referenced' WHEN name LIKE '\\_\\_%\\_\\_' ESCAPE '\\' THEN 'Lifecycle' END AS protected_by FROM s)
"""


@query("dead_symbols", _SYMBOLS + _STAGE + "SELECT id, name, protected_by FROM p")
def dead_symbols(spark, sf_dir):
    return cascade.protect(_symbols(spark, sf_dir), _references(spark, sf_dir)).select("id", "name", "protected_by")


@query("dead_stage_counts", _SYMBOLS + _STAGE + "SELECT coalesce(protected_by, 'Dead') AS stage, count(*)::BIGINT AS n FROM p GROUP BY 1")
def dead_stage_counts(spark, sf_dir):
    return cascade.stage_counts(cascade.protect(_symbols(spark, sf_dir), _references(spark, sf_dir)))


@query("dead_report", _SYMBOLS + _STAGE + "SELECT id, name, (id % 1000 * 3 - 5 * (id % 7) + abs(id % 1000 * 3 - 5 * (id % 7))) // 2 AS byte_size FROM p WHERE protected_by IS NULL ORDER BY byte_size DESC, id LIMIT 50")
def dead_report(spark, sf_dir):
    protected = cascade.protect(_symbols(spark, sf_dir), _references(spark, sf_dir))
    spans = protected.withColumns({"start": 5 * (F.col("id") % 7), "end": F.col("id") % 1000 * 3})
    return cascade.dead_report(spans)[0].select("id", "name", "byte_size")


@query("orphan_files", _SYMBOLS + """SELECT DISTINCT file_path FROM s WHERE file_path NOT IN (SELECT b.file_path FROM e JOIN s a ON a.id = e.src_id JOIN s b ON b.id = e.dst_id WHERE a.file_path <> b.file_path)""")
def orphan_files(spark, sf_dir):
    return cascade.orphan_files(_symbols(spark, sf_dir), _references(spark, sf_dir))


@query("patch_hits", """WITH r AS (SELECT 'f' || p_partkey AS name, p_size::BIGINT AS structural_hash, p_size % 2 = 0 AS open FROM part),
h AS (SELECT structural_hash, bool_or(open) AS o FROM r WHERE structural_hash <> 0 GROUP BY 1),
f AS (SELECT l_orderkey AS patch_id, 'f' || (l_partkey * l_linenumber) AS name, (l_linenumber * 9)::BIGINT AS structural_hash FROM lineitem)
SELECT patch_id, count_if(name IN (SELECT name FROM r))::BIGINT AS dead_symbols_added, coalesce(count_if(o), 0)::BIGINT AS zombies, coalesce(count_if(NOT o), 0)::BIGINT AS clones FROM f LEFT JOIN h USING (structural_hash) GROUP BY patch_id""")
def patch_hits(spark, sf_dir):
    size = F.col("p_size")
    registry = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), "p_partkey").alias("name"), size.cast("bigint").alias("structural_hash"), F.when(size % 2 != 0, "Referenced").alias("protected_by"))
    functions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("patch_id"), F.concat(F.lit("f"), F.col("l_partkey") * F.col("l_linenumber")).alias("name"), (F.col("l_linenumber") * 9).cast("bigint").alias("structural_hash"))
    return cascade.patch_hits(functions, registry)


@query("ghost_collisions", """WITH m AS (SELECT p_partkey, p_partkey * 2654435761 AS a, p_partkey * 40503 AS b FROM part WHERE p_size > 10),
x AS (SELECT o_orderkey, m.p_partkey IS NULL OR (bit_count(xor(m.a, CASE WHEN l_linenumber > 4 THEN xor(l_partkey * 2654435761, 9223372036854775807) ELSE l_partkey * 2654435761 END)) + bit_count(xor(m.b, CASE WHEN l_quantity > 25 THEN xor(l_partkey * 40503, 9223372036854775807) ELSE l_partkey * 40503 END))) > 102.4 AS gone
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN m ON p_partkey = l_partkey)
SELECT o_orderkey AS patch_id, count(*)::BIGINT AS total, count_if(gone)::BIGINT AS decayed, count_if(gone) * 2 > count(*) AS collision FROM x GROUP BY 1""")
def ghost_collisions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    none = F.lit(0).cast("bigint")
    hashed = lambda k: (k * F.lit(2654435761), k * F.lit(40503))
    a, b = hashed(F.col("l_partkey"))
    all_bits = F.lit(9223372036854775807)
    drifted = F.array(F.when(F.col("l_linenumber") > 4, a.bitwiseXOR(all_bits)).otherwise(a), F.when(F.col("l_quantity") > 25, b.bitwiseXOR(all_bits)).otherwise(b), none, none)
    modified = li.select(F.col("l_orderkey").alias("patch_id"), F.col("l_partkey").alias("name"), drifted.alias("hash"))
    a, b = hashed(F.col("p_partkey"))
    master = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("qualified_name"), F.array(a, b, none, none).alias("structural_hash"))
    return cascade.ghost(modified, master)


@query("export_rows", LOG + """SELECT pr_number::VARCHAR AS "PR_Number", coalesce(author, '') AS "Author", slop_score::VARCHAR AS "Score", threat_class AS "Threat_Class", CASE WHEN unlinked_pr > 0 THEN 'TRUE' ELSE 'FALSE' END AS "Unlinked_PR",
 least(logic_clones_found, 50)::VARCHAR AS "Logic_Clones",
 concat_ws('|', CASE WHEN necrotic_flag IS NOT NULL THEN 'backlog:' || necrotic_flag END, CASE WHEN zombie_dep THEN 'architecture:zombie_dependency' END,
 CASE WHEN secure THEN 'security:x (x2)|style:y' WHEN event_type = 'purchase' THEN 'style:y' END) AS "Antipattern_IDs", CASE WHEN collided THEN '7' ELSE '' END AS "Collided_PRs", CASE WHEN necrotic THEN '0.2000' ELSE '0.0000' END AS "Time_Saved_Hours",
 CASE threat_class WHEN 'Critical' THEN '150' WHEN 'Boilerplate' THEN '0' ELSE '20' END AS "Operational_Savings_USD", '' AS "PR_State", CASE WHEN is_bot THEN 'TRUE' ELSE 'FALSE' END AS "Is_Bot", repo_slug AS "Repo_Slug",
 '' AS "Commit_SHA", '' AS "Policy_Hash", format('{:.2f}', agentic_pct) AS "Agentic_Contribution_Pct" FROM c""")
def export_rows(spark, sf_dir):
    return sinks.export_rows(log_of_events(spark, sf_dir)).drop("Timestamp")  # times print as the session does


@query("cef_lines", LOG + """SELECT 'CEF:0|vellum|vellum|1|' || CASE WHEN secure THEN 'security:x' WHEN event_type = 'purchase' THEN 'style:y' ELSE threat_class END || '|' || threat_class || '|' || CASE WHEN critical THEN '8' WHEN slop_score > 0 OR necrotic THEN '5' ELSE '1' END || '|msg='
 || coalesce(nullif(concat_ws(' ; ', CASE WHEN secure THEN 'security:x ; security:x ; style:y' WHEN event_type = 'purchase' THEN 'style:y' END, CASE WHEN zombie_dep THEN 'zombie_deps\\=dep' END, CASE WHEN necrotic_flag IS NOT NULL THEN 'necrotic_flag\\=' || necrotic_flag END), ''), 'no_findings_recorded')
 || ' cs1=' || repo_slug || ' cs2=' || pr_number AS line FROM c""")
def cef_lines(spark, sf_dir):
    return sinks.cef(log_of_events(spark, sf_dir))


@query("sarif_results", LOG + """, r AS (SELECT seq, unnest(CASE WHEN secure THEN ['security:x', 'security:x', 'style:y'] WHEN event_type = 'purchase' THEN ['style:y'] ELSE [] END) AS rule FROM c UNION ALL SELECT seq, 'swarm:structural_collision' FROM c WHERE collided)
SELECT seq, rule, CASE WHEN rule LIKE '%security:%' OR rule LIKE 'swarm:%' THEN 'error' ELSE 'warning' END AS level, count(*)::BIGINT AS n FROM r GROUP BY ALL""")
def sarif_results(spark, sf_dir):
    return sinks.sarif_results(log_of_events(spark, sf_dir)).groupBy("seq", "rule", "level").agg(F.count("*").alias("n"))


@query("sarif_rules", LOG + """, r AS (SELECT unnest(CASE WHEN secure THEN ['security:x', 'security:x', 'style:y'] WHEN event_type = 'purchase' THEN ['style:y'] ELSE [] END) AS rule FROM c UNION ALL SELECT 'swarm:structural_collision' FROM c WHERE collided)
SELECT rule AS "ruleId", CASE WHEN rule LIKE '%security:%' THEN 'error' ELSE 'warning' END AS level, count(*)::BIGINT AS n FROM r GROUP BY 1, 2""")
def sarif_rules(spark, sf_dir):
    return sinks.sarif_rules(log_of_events(spark, sf_dir))


@query("global_report", LOG + """, g AS (SELECT repo_slug, count(*)::BIGINT AS prs, sum(slop_score)::BIGINT AS total_score FROM c GROUP BY 1)
SELECT repo_slug, prs, total_score, repeat('#', floor(total_score * 20 / (SELECT max(total_score) FROM g))::INT) AS bar FROM g UNION ALL SELECT NULL, count(*), sum(slop_score), NULL FROM c""")
def global_report(spark, sf_dir):
    return sinks.global_report(log_of_events(spark, sf_dir)).select("repo_slug", "prs", "total_score", "bar")


@query("stream_hourly_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_hourly_counts(spark, sf_dir):
    stream = jobs.stream_table(spark, sf_dir, "events")
    counts = jobs.windowed_counts(stream, "ts", "event_type")
    return jobs.run_available(counts, "hourly").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
