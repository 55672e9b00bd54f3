"""Review-log queries; the events table plays the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import log, score, swarm
from .registry import query, table


def log_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log columns, derived from events."""
    none = "cast(array() as array<string>)"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq",
        "concat('repo', user_id % 12) AS repo_slug",
        "event_id AS pr_number",
        "CASE WHEN user_id % 11 = 0 THEN NULL ELSE concat('u', user_id) END AS author",
        "ts",
        "CASE WHEN event_type = 'view' THEN 0L ELSE cast(floor(abs(value)) AS bigint) % 200 END AS slop_score",
        "event_id % 3 AS zombie_symbols_added",
        "event_id % 4 AS logic_clones_found",
        "CASE WHEN event_id % 5 = 0 THEN 1L ELSE 0L END AS unlinked_pr",
        f"CASE WHEN event_type = 'error' THEN array('security:x', 'security:x', 'style:y') WHEN event_type = 'purchase' THEN array('style:y') ELSE {none} END AS antipatterns",
        f"CASE WHEN event_id % 17 = 0 THEN array('dep') ELSE {none} END AS zombie_deps",
        "user_id % 13 = 0 AS is_bot",
        "CASE WHEN event_id % 97 = 0 THEN array(7) ELSE cast(array() as array<int>) END AS collided_pr_numbers",
        "CASE WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'SEMANTIC_NULL' END AS necrotic_flag",
        "(event_id % 6) * 10.0D AS agentic_pct",
        "event_id % 5000 AS analysis_duration_ms",
    )


LOG = """WITH log AS (
SELECT event_id AS seq, 'repo' || (user_id % 12) AS repo_slug, event_id AS pr_number,
 CASE WHEN user_id % 11 = 0 THEN NULL ELSE 'u' || user_id END AS author, ts,
 CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor(abs(value)) AS BIGINT) % 200 END AS slop_score,
 event_id % 3 AS zombie_symbols_added, event_id % 4 AS logic_clones_found,
 CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS unlinked_pr,
 CASE WHEN event_type = 'error' THEN 3 WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS n_patterns,
 event_type = 'error' AS secure, event_id % 17 = 0 AS zombie_dep, user_id % 13 = 0 AS is_bot,
 event_id % 97 = 0 AS collided,
 CASE WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'SEMANTIC_NULL' END AS necrotic_flag,
 (event_id % 6) * 10.0::DOUBLE AS agentic_pct, event_id % 5000 AS ms, event_type
FROM events),
c AS (SELECT *, secure OR collided AS critical, necrotic_flag IS NOT NULL OR zombie_dep AS necrotic,
 CASE WHEN secure OR collided THEN 'Critical' WHEN necrotic_flag IS NOT NULL OR zombie_dep THEN 'Necrotic'
  WHEN slop_score > 0 THEN 'StructuralSlop' ELSE 'Boilerplate' END AS threat_class,
 CASE WHEN secure OR collided OR necrotic_flag IS NOT NULL OR zombie_dep OR slop_score > 0
  THEN ms / 1000.0::DOUBLE / 3600.0::DOUBLE * 0.150::DOUBLE * (CASE WHEN secure OR collided THEN 5 ELSE 1 END) ELSE 0 END AS kwh
FROM log)
"""


@query("log_repo_rollup", LOG + """SELECT repo_slug, count(*)::BIGINT AS prs, sum(slop_score)::BIGINT AS total_score, max(slop_score)::BIGINT AS max_score,
 count_if(critical)::BIGINT AS critical, count_if(necrotic_flag IS NOT NULL)::BIGINT AS necrotic,
 sum(n_patterns + (necrotic_flag IS NOT NULL)::INT)::BIGINT AS antipatterns_found, sum(unlinked_pr)::BIGINT AS unlinked,
 sum(zombie_symbols_added)::BIGINT AS zombies, count(DISTINCT author)::BIGINT AS authors,
 (arg_max(pr_number, slop_score * 1000000000000 - seq) FILTER (WHERE slop_score > 0))::BIGINT AS worst_pr, round(sum(CASE WHEN critical OR necrotic OR slop_score > 0 THEN ms * (CASE WHEN critical THEN 5 ELSE 1 END) ELSE 0 END)::BIGINT * 0.150::DOUBLE / 3600000.0::DOUBLE, 6) AS kwh
FROM c GROUP BY ROLLUP (repo_slug)""")
def log_repo_rollup(spark, sf_dir):
    return log.repo_rollup(log_of_events(spark, sf_dir))


@query("log_totals", LOG + """SELECT count(*)::BIGINT AS n, sum(slop_score)::BIGINT AS total_score, count_if(critical)::BIGINT AS critical,
 count_if(necrotic_flag IS NOT NULL AND NOT critical)::BIGINT AS gc,
 count_if(slop_score > 0 AND NOT critical AND necrotic_flag IS NULL)::BIGINT AS structural,
 (count_if(necrotic_flag IS NOT NULL) * 12)::BIGINT AS reclaimed_minutes,
 count_if(critical OR necrotic_flag IS NOT NULL OR slop_score > 0)::BIGINT AS actionable FROM c""")
def log_totals(spark, sf_dir):
    return log.totals(log_of_events(spark, sf_dir))


@query("log_author_stats", LOG + """SELECT author, sum(slop_score)::BIGINT AS total_score, count(*)::BIGINT AS prs, count_if(slop_score = 0)::BIGINT AS clean_prs
FROM c WHERE author IS NOT NULL GROUP BY author ORDER BY total_score DESC, author LIMIT 10""")
def log_author_stats(spark, sf_dir):
    return log.author_stats(log_of_events(spark, sf_dir))


@query("log_threat_class", LOG + "SELECT seq, threat_class FROM c")
def log_threat_class(spark, sf_dir):
    return log.classify(log_of_events(spark, sf_dir)).select("seq", "threat_class")


@query("log_billing", LOG + """SELECT threat_class, count(*)::BIGINT AS n, sum(CASE threat_class WHEN 'Critical' THEN 150.0 WHEN 'Boilerplate' THEN 0.0 ELSE 20.0 END)::DOUBLE AS savings_usd,
 round(sum(CASE WHEN necrotic THEN 0.2 ELSE 0.0 END)::DOUBLE, 4) AS time_saved_h FROM c GROUP BY threat_class""")
def log_billing(spark, sf_dir):
    billed = log.bill(log.classify(log_of_events(spark, sf_dir)))
    return billed.groupBy("threat_class").agg(F.count("*").alias("n"), F.sum("savings_usd").alias("savings_usd"), F.round(F.sum("time_saved_h"), 4).alias("time_saved_h"))


@query("log_energy", LOG + "SELECT seq, round(kwh, 9) AS kwh FROM c")
def log_energy(spark, sf_dir):
    return log_of_events(spark, sf_dir).select("seq", F.round(log.energy(), 9).alias("kwh"))


@query("log_surrender_index", LOG + "SELECT seq, round(CASE WHEN agentic_pct > 0 THEN slop_score / agentic_pct ELSE 0 END, 6) AS surrender_index FROM c")
def log_surrender_index(spark, sf_dir):
    return log_of_events(spark, sf_dir).select("seq", F.round(log.surrender_index(), 6).alias("surrender_index"))


@query("log_antipattern_ids", LOG + """SELECT seq, concat_ws('|', CASE WHEN necrotic_flag IS NOT NULL THEN 'backlog:' || necrotic_flag END, CASE WHEN zombie_dep THEN 'architecture:zombie_dependency' END,
 CASE WHEN secure THEN 'security:x (x2)|style:y' WHEN event_type = 'purchase' THEN 'style:y' END) AS antipattern_ids FROM c""")
def log_antipattern_ids(spark, sf_dir):
    return log_of_events(spark, sf_dir).select("seq", log.antipattern_ids().alias("antipattern_ids"))


@query("log_primary_violation", LOG + """SELECT CASE WHEN n_patterns > 0 THEN 'Language Antipattern' WHEN zombie_symbols_added > 0 THEN 'Zombie Symbol Reintroduction'
 WHEN logic_clones_found > 0 THEN 'Structural Clone' WHEN necrotic_flag IS NOT NULL THEN 'backlog:' || necrotic_flag
 WHEN zombie_dep THEN 'Zombie Dependency' ELSE 'Score Threshold' END AS violation, count(*)::BIGINT AS n FROM c GROUP BY 1""")
def log_primary_violation(spark, sf_dir):
    return log_of_events(spark, sf_dir).groupBy(log.primary_violation().alias("violation")).agg(F.count("*").alias("n"))


@query("log_top_per_group", LOG + """SELECT repo_slug, pr_number, slop_score, threat_class, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_slug ORDER BY slop_score DESC, seq)::INT AS rank
 FROM c WHERE slop_score > 0) WHERE rank <= 10""")
def log_top_per_group(spark, sf_dir):
    return log.classify(log.top_per_repo(log_of_events(spark, sf_dir))).select("repo_slug", "pr_number", "slop_score", "threat_class", "rank")


@query("log_clean_authors", LOG + """SELECT repo_slug, author, clean_prs, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_slug ORDER BY clean_prs DESC, author)::INT AS rank FROM (
 SELECT repo_slug, coalesce(author, 'unknown') AS author, count(*)::BIGINT AS clean_prs FROM c WHERE slop_score = 0 AND NOT is_bot GROUP BY 1, 2)) WHERE rank <= 10""")
def log_clean_authors(spark, sf_dir):
    return log.clean_authors(log_of_events(spark, sf_dir))


@query("log_latest_prior", LOG + """SELECT repo_slug, author, seq, slop_score FROM (SELECT *, row_number() OVER (PARTITION BY repo_slug, author ORDER BY seq DESC) AS r FROM c) WHERE r = 1""")
def log_latest_prior(spark, sf_dir):
    return log.latest(log_of_events(spark, sf_dir), "repo_slug", "author").select("repo_slug", "author", "seq", "slop_score")


@query("log_necrotic_list", LOG + "SELECT seq, slop_score, necrotic_flag FROM c WHERE necrotic_flag IS NOT NULL")
def log_necrotic_list(spark, sf_dir):
    return log.necrotic_list(log_of_events(spark, sf_dir)).select("seq", "slop_score", "necrotic_flag")


@query("log_severity", LOG + """SELECT CASE WHEN contains(d, 'kev') THEN 'KevCritical' WHEN contains(d, 'security:') THEN 'Critical'
 WHEN regexp_matches(d, 'architecture:|backlog:') THEN 'Warning' ELSE 'Informational' END AS severity, split_part(d, ' — ', 1) AS rule, count(*)::BIGINT AS n
FROM (SELECT unnest(CASE WHEN secure THEN ['security:x', 'security:x', 'style:y'] WHEN event_type = 'purchase' THEN ['style:y'] ELSE [] END) AS d FROM c) GROUP BY 1, 2""")
def log_severity(spark, sf_dir):
    one = log_of_events(spark, sf_dir).select(F.explode("antipatterns").alias("d"))
    return one.groupBy(log.siem_severity(F.col("d")).alias("severity"), log.rule_id(F.col("d")).alias("rule")).agg(F.count("*").alias("n"))


@query("log_gate", LOG + "SELECT repo_slug, count_if(slop_score < 100 + CASE WHEN event_type = 'click' THEN 50 ELSE 0 END)::BIGINT AS passed, count(*)::BIGINT AS n FROM c GROUP BY repo_slug")
def log_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("event_type") == "click").alias("refactor")).join(log_of_events(spark, sf_dir), "seq")
    return rows.groupBy("repo_slug").agg(F.count_if(score.passes_gate(F.col("slop_score"), F.col("refactor"), 100, 50)).alias("passed"), F.count("*").alias("n"))


@query("tiebreak_topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def tiebreak_topn(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("slop_score"))
    return log.top_n(o, 100).select("o_orderkey", "o_totalprice")


# --- coordinated authors ------------------------------------------------------------

_FLAGS = "(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 4 WHEN 'purchase' THEN 8 ELSE 0 END)"
_CLUSTERS = f"""WITH g AS (SELECT *, {_FLAGS} AS flags, floor(epoch(ts))::BIGINT AS t FROM events),
n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 604800 OR lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM g),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM n)
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("flags", F.expr(_FLAGS))


@query("author_sessions", _CLUSTERS + "SELECT user_id, cluster, count(*)::BIGINT AS n, min(t)::BIGINT AS first_t, max(t)::BIGINT AS last_t FROM k GROUP BY user_id, cluster")
def author_sessions(spark, sf_dir):
    c = swarm.clusters(_records(spark, sf_dir), swarm.seconds(F.col("ts")), "user_id")
    t = swarm.seconds(F.col("ts"))
    return c.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min(t).alias("first_t"), F.max(t).alias("last_t"))


@query("capability_clusters", _CLUSTERS + """, s AS (SELECT user_id, cluster, count(*)::BIGINT AS size, bit_or(flags)::INT AS flags FROM k GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN flags & 3 = 3 THEN 3 WHEN flags & 6 = 6 THEN 6 WHEN flags & 5 = 5 THEN 5 WHEN flags & 12 = 12 THEN 12 WHEN flags & 10 = 10 THEN 10 END AS pair,
 sum(size) OVER (PARTITION BY user_id)::BIGINT AS total FROM s)
SELECT user_id, cluster, size, flags, pair::INT AS pair, total, round(size / total, 6) AS confidence FROM p WHERE size >= 3 AND pair IS NOT NULL""")
def capability_clusters(spark, sf_dir):
    c = swarm.clusters(_records(spark, sf_dir), swarm.seconds(F.col("ts")), "user_id")
    return swarm.findings(c, "user_id").withColumn("confidence", F.round("confidence", 6))


@query("temporal_pairs", """SELECT least(a.event_id, b.event_id) AS a, greatest(a.event_id, b.event_id) AS b, abs(floor(epoch(a.ts))::BIGINT - floor(epoch(b.ts))::BIGINT) AS apart
FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(floor(epoch(a.ts))::BIGINT - floor(epoch(b.ts))::BIGINT) <= 3600""")
def temporal_pairs(spark, sf_dir):
    return swarm.temporal_pairs(table(spark, sf_dir, "events"), "event_id", swarm.seconds(F.col("ts")), 3600, by="user_id")


@query("finding_dedup", """SELECT event_type AS id, user_id, min(event_id)::BIGINT AS event_id, count(*)::BIGINT AS n_occurrences FROM events GROUP BY 1, 2""")
def finding_dedup(spark, sf_dir):
    f = table(spark, sf_dir, "events").select(F.col("event_type").alias("id"), "user_id", "event_id", F.col("props").alias("file"), F.col("event_id").cast("int").alias("line"))
    return score.structural_dedup(f, ["id", "user_id"], "event_id").select("id", "user_id", "event_id", "n_occurrences")


@query("finding_exact_dedup", "SELECT event_type, user_id, min(event_id)::BIGINT AS event_id FROM events GROUP BY ALL")
def finding_exact_dedup(spark, sf_dir):
    return score.exact_dedup(table(spark, sf_dir, "events"), ["event_type", "user_id"], "event_id").select("event_type", "user_id", "event_id")


@query("score_caps", """SELECT l_orderkey, (least(count(*), 50) * 5 + count_if(l_returnflag = 'R') * 10 + least(sum(l_quantity)::BIGINT, 500) + count_if(l_linestatus = 'O') * 5
 + count_if(l_discount = 0) * 20 + 0 + 0 + (count(DISTINCT l_suppkey) - 1) * 20)::BIGINT AS score FROM lineitem GROUP BY l_orderkey""")
def score_caps(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("c"), F.count_if(F.col("l_returnflag") == "R").alias("z"), F.sum("l_quantity").cast("bigint").alias("p"), F.count_if(F.col("l_linestatus") == "O").alias("m"), F.count_if(F.col("l_discount") == 0).alias("u"), (F.countDistinct("l_suppkey") - 1).alias("s")
    )
    zero = F.lit(0)
    return g.select("l_orderkey", score.score(F.col("c"), F.col("z"), F.col("p"), F.col("m"), F.col("u"), zero, zero, F.col("s")).cast("bigint").alias("score"))


@query("blast_dirs", "SELECT l_orderkey, count(DISTINCT l_suppkey)::BIGINT AS dirs FROM lineitem GROUP BY 1 HAVING dirs > 5")
def blast_dirs(spark, sf_dir):
    paths = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws("/", F.concat(F.lit("s"), "l_suppkey"), F.lit("x.rs")).alias("path"))
    return score.blast_dirs(paths, "l_orderkey", "path")


@query("check_then_act", """WITH e AS (SELECT *, CASE event_type WHEN 'view' THEN 'check' WHEN 'purchase' THEN 'act' WHEN 'signup' THEN 'guard' END AS kind FROM events),
n AS (SELECT *, min(CASE WHEN kind = 'act' THEN event_id END) OVER w AS act_at, min(CASE WHEN kind = 'guard' THEN event_id END) OVER w AS guard_at FROM e
 WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, act_at FROM n WHERE kind = 'check' AND act_at IS NOT NULL AND (guard_at IS NULL OR guard_at > act_at)""")
def check_then_act(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("kind", F.expr("CASE event_type WHEN 'view' THEN 'check' WHEN 'purchase' THEN 'act' WHEN 'signup' THEN 'guard' END"))
    return score.check_then_act(e, ["user_id"], "event_id", "kind").select("user_id", "event_id", "act_at")


@query("ci_thermo", """SELECT event_id FROM events WHERE event_id % 150 < 100 AND (CASE WHEN event_id % 7 = 0 THEN 0 ELSE (event_id % 1000) / (event_id % 7) END > 3 OR 1 > 3)""")
def ci_thermo(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.where(score.thermo(i % 7, i % 1000, F.lit(1), F.lit(1), i % 150)).select("event_id")
