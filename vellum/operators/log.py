"""Review-log analytics: derived columns, rollups, rankings (survey P1-P8, P14, A1-A4, T1, T2, W2, W4, W7, J27).

All functions take and return DataFrames of the ``LOG`` columns they name; ``seq``
is the order of the log (append order), which breaks every tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a log row that the operators read (survey section 1.1).
LOG = """seq bigint, repo_slug string, pr_number bigint, author string, ts timestamp, slop_score bigint,
dead_symbols_added bigint, logic_clones_found bigint, zombie_symbols_added bigint, unlinked_pr bigint,
antipatterns array<string>, comment_violations array<string>, zombie_deps array<string>, state string,
is_bot boolean, collided_pr_numbers array<int>, necrotic_flag string, commit_sha string,
version_silos array<string>, agentic_pct double, analysis_duration_ms bigint"""

# Fixed values of the model: dollars, hours, kilowatts.
CRITICAL_USD, OTHER_USD, NECROTIC_MINUTES, KILOWATT, CRITICAL_FACTOR = 150.0, 20.0, 12, 0.150, 5


def _filled(c: str, kind: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(kind))


def is_critical() -> Column:
    """A security finding, or a collision with another change."""
    return F.exists(_filled("antipatterns", "array<string>"), lambda a: a.contains("security:")) | (F.size(_filled("collided_pr_numbers", "array<int>")) > 0)


def is_necrotic(with_deps: bool = True) -> Column:
    flag = F.col("necrotic_flag").isNotNull()
    return flag | (F.size(_filled("zombie_deps", "array<string>")) > 0) if with_deps else flag


def classify(log: DataFrame, with_deps: bool = True) -> DataFrame:
    """Adds threat_class; the first of Critical, Necrotic, StructuralSlop and Boilerplate that holds.  The global report's class leaves zombie dependencies out (with_deps=False)."""
    c = F.when(is_critical(), "Critical").when(is_necrotic(with_deps), "Necrotic").when(F.col("slop_score") > 0, "StructuralSlop").otherwise("Boilerplate")
    return log.withColumn("threat_class", c)


def bill(classified: DataFrame) -> DataFrame:
    """Hours saved on necrotic changes, and dollars by class."""
    usd = F.when(F.col("threat_class") == "Critical", CRITICAL_USD).when(F.col("threat_class").isin("Necrotic", "StructuralSlop"), OTHER_USD).otherwise(0.0)
    return classified.withColumns({"time_saved_h": F.when(is_necrotic(), NECROTIC_MINUTES / 60).otherwise(0.0), "savings_usd": usd})


def antipattern_ids() -> Column:
    """Labels in the order they were first seen, repeats as ``label (xN)``, joined by a bar."""
    labels = F.concat(
        F.when(F.col("necrotic_flag").isNotNull(), F.array(F.concat(F.lit("backlog:"), "necrotic_flag"))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(_filled("zombie_deps", "array<string>")) > 0, F.array(F.lit("architecture:zombie_dependency"))).otherwise(F.array().cast("array<string>")),
        _filled("antipatterns", "array<string>"),
    )

    def shown(label: Column) -> Column:
        n = F.size(F.filter(labels, lambda x: x == label))
        return F.when(n > 1, F.concat(label, F.lit(" (x"), n.cast("string"), F.lit(")"))).otherwise(label)

    return F.array_join(F.transform(F.array_distinct(labels), shown), "|")


def energy() -> Column:
    """Kilowatt hours of runs that found something, five times over if critical."""
    return _weighted_ms() / F.lit(1000.0) / F.lit(3600.0) * KILOWATT


def _weighted_ms() -> Column:
    """Milliseconds that count for energy: whole numbers, so sums do not depend on their order."""
    actionable = is_critical() | is_necrotic() | (F.col("slop_score") > 0)
    ms = F.coalesce(F.col("analysis_duration_ms"), F.lit(0))
    return F.when(actionable, ms * F.when(is_critical(), CRITICAL_FACTOR).otherwise(1)).otherwise(0)


def surrender_index() -> Column:
    """Score per point of agentic share; 0 where there is none."""
    return F.when(F.col("agentic_pct") > 0, F.col("slop_score") / F.col("agentic_pct")).otherwise(0.0)


def siem_severity(detail: Column) -> Column:
    """Severity of one finding's detail, known exploited vulnerabilities first."""
    low = F.lower(detail)
    return F.when(low.contains("kev"), "KevCritical").when(low.contains("security:"), "Critical").when(low.rlike("architecture:|backlog:"), "Warning").otherwise("Informational")


def rule_id(detail: Column) -> Column:
    """What stands before the dash."""
    return F.element_at(F.split(detail, " — "), 1)


def totals(log: DataFrame) -> DataFrame:
    """A1: one row of totals; critical, necrotic and structural exclude each other in this order."""
    critical, necrotic = is_critical(), is_necrotic(with_deps=False)
    gc = necrotic & ~critical
    structural = (F.col("slop_score") > 0) & ~critical & ~necrotic
    return log.agg(
        F.count("*").alias("n"),
        F.sum("slop_score").alias("total_score"),
        F.count_if(critical).alias("critical"),
        F.count_if(gc).alias("gc"),
        F.count_if(structural).alias("structural"),
        (F.count_if(necrotic) * NECROTIC_MINUTES).alias("reclaimed_minutes"),
        (F.count_if(critical) + F.count_if(gc) + F.count_if(structural)).alias("actionable"),
    )


def author_stats(log: DataFrame, top: int = 10) -> DataFrame:
    """A2: authors by total score; ties by name."""
    stats = log.where("author IS NOT NULL").groupBy("author").agg(F.sum("slop_score").alias("total_score"), F.count("*").alias("prs"), F.count_if(F.col("slop_score") == 0).alias("clean_prs"))
    return stats.orderBy(F.desc("total_score"), "author").limit(top)


def repo_rollup(log: DataFrame) -> DataFrame:
    """A3: measures of each repository and, with a null repo, of all; the worst change is the first with the highest positive score."""
    flagged = log.withColumns({"_critical": is_critical(), "_necrotic": F.col("necrotic_flag").isNotNull(), "_ms": _weighted_ms(), "_patterns": F.size(_filled("antipatterns", "array<string>"))})
    worst = F.max_by("pr_number", F.when(F.col("slop_score") > 0, F.struct("slop_score", -F.col("seq"))))
    return flagged.rollup("repo_slug").agg(
        F.count("*").alias("prs"),
        F.sum("slop_score").alias("total_score"),
        F.max("slop_score").alias("max_score"),
        F.count_if("_critical").alias("critical"),
        F.count_if("_necrotic").alias("necrotic"),
        F.sum(F.col("_patterns") + F.col("_necrotic").cast("int")).alias("antipatterns_found"),
        F.sum("unlinked_pr").alias("unlinked"),
        F.sum("zombie_symbols_added").alias("zombies"),
        F.countDistinct("author").alias("authors"),
        worst.alias("worst_pr"),
        F.round(F.sum("_ms") * F.lit(KILOWATT) / F.lit(3_600_000.0), 6).alias("kwh"),
    )


def top_per_repo(log: DataFrame, top: int = 10) -> DataFrame:
    """The highest positive scores of each repository, log order breaking ties."""
    order = Window.partitionBy("repo_slug").orderBy(F.desc("slop_score"), "seq")
    return log.where("slop_score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def clean_authors(log: DataFrame, top: int = 10) -> DataFrame:
    """A4: authors (not bots) of most changes without a score, for each repository."""
    clean = log.where("slop_score = 0 AND NOT coalesce(is_bot, false)").groupBy("repo_slug", F.coalesce("author", F.lit("unknown")).alias("author")).agg(F.count("*").alias("clean_prs"))
    order = Window.partitionBy("repo_slug").orderBy(F.desc("clean_prs"), "author")
    return clean.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def repo_lists(log: DataFrame, top: int = 10) -> DataFrame:
    """A3: for each repository its worst changes (pr_number) and its cleanest authors, in order, `top` at most."""
    worst = top_per_repo(log, top).groupBy("repo_slug").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "pr_number"))), lambda s: s["pr_number"]).alias("top"))
    clean = clean_authors(log, top).groupBy("repo_slug").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "author"))), lambda s: s["author"]).alias("clean"))
    return worst.join(clean, "repo_slug")


def rolling(samples: DataFrame, value: str, order: list[str], *by: str, ring: int = 16) -> DataFrame:
    """The mean of the last `ring` samples of each key, and the change since the one before."""
    w = Window.partitionBy(*by).orderBy(*order)
    return samples.withColumns({"mean": F.avg(value).over(w.rowsBetween(1 - ring, 0)), "velocity": F.col(value) - F.lag(value).over(w)})


def top_n(log: DataFrame, n: int) -> DataFrame:
    """Highest scores, stable in log order."""
    return log.orderBy(F.desc("slop_score"), "seq").limit(n)


def necrotic_list(log: DataFrame) -> DataFrame:
    """Necrotic changes by score."""
    return log.where("necrotic_flag IS NOT NULL").orderBy(F.desc("slop_score"), "seq")


def latest(log: DataFrame, *key: str) -> DataFrame:
    """The last row of each key; a partial aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*key, "r.*")


def primary_violation() -> Column:
    """P5: what a report says of a change: patterns, then zombie symbols, clones, the backlog flag, zombie dependencies, the mere score."""
    patterns, flag = _filled("antipatterns", "array<string>"), F.concat(F.lit("backlog:"), "necrotic_flag")
    bump = F.exists(patterns, lambda a: a.contains("Unverified Security Bump"))
    return (
        F.when(F.size(patterns) > 0, F.when(bump, "Unverified Security Bump").otherwise("Language Antipattern"))
        .when(F.col("zombie_symbols_added") > 0, "Zombie Symbol Reintroduction")
        .when(F.col("logic_clones_found") > 0, "Structural Clone")
        .when(F.col("necrotic_flag").isNotNull(), flag)
        .when(F.size(_filled("zombie_deps", "array<string>")) > 0, "Zombie Dependency")
        .otherwise("Score Threshold")
    )
