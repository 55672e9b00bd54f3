"""Patch scores, findings and predicates (survey A5, A6, A14, A15, A18, A22, A24, A26, A27, P11-P13, F1, F3, F9, F10, F13, F14, F18, J26, J29, T3, U3, W5, X14, E5, E7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights and caps of the score.
POINTS = {"KevCritical": 150, "Exhaustion": 100, "Critical": 50, "High": 40, "Warning": 10, "Lint": 0}
TRIAGE = (3.0, 1.5, 1.0, -4.0)
SEVERITY_WEIGHTS = {"KevCritical": 5.0, "Exhaustion": 4.0, "Critical": 4.0, "High": 3.0, "Medium": 2.0, "Low": 1.0, "Informational": 1.0}
LOCKFILES = ("Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Gemfile.lock", "poetry.lock", "go.sum", "flake.lock")
PROTECTED_DIRS = ("tests", "test", "examples", "example", "docs_src", "docs", "sandbox", "bin", "scripts", "tutorial", "benchmarks", "fixtures", "migrations")


def score(clones: Column, zombies: Column, antipattern_points: Column, comments: Column, unlinked: Column, hallucinated: Column, agentic: Column, silos: Column) -> Column:
    """A5: the weighted sum, clones capped at 50 and pattern points at 500."""
    return F.least(clones, F.lit(50)) * 5 + zombies * 10 + F.least(antipattern_points, F.lit(500)) + comments * 5 + unlinked * 20 + hallucinated * 100 + agentic + silos * 20


def points(severity: Column) -> Column:
    """Points of a severity; others none."""
    out = F.lit(0)
    for name, n in POINTS.items():
        out = F.when(severity == name, n).otherwise(out)
    return out


def triage(poc: Column, attributed: Column, severity: Column, static_source: Column) -> Column:
    """The weighted sum of a concrete proof, an attributed component, the severity and a source proven static."""
    weight = F.lit(0.0)
    for name, w in SEVERITY_WEIGHTS.items():
        weight = F.when(severity == name, w).otherwise(weight)
    features = (poc.cast("int"), attributed.cast("int"), weight, static_source.cast("int"))
    return sum((w * f for w, f in zip(TRIAGE, features, strict=True)), F.lit(0.0))


def passes_gate(score_: Column, refactor: Column, least: int = 100, bonus: int = 0) -> Column:
    """below the threshold, which refactorings raise."""
    return score_ < F.lit(least) + F.when(refactor, bonus).otherwise(0)


def merge_files(files: DataFrame, patch: str, counters: list[str], lists: list[str]) -> DataFrame:
    """Sums of counters and joined lists of a patch's files, in path order."""

    def in_order(c: str) -> Column:
        return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("path", c))), lambda s: s[c])).alias(c)

    return files.groupBy(patch).agg(*[F.sum(c).alias(c) for c in counters], *[in_order(c) for c in lists])


def structural_dedup(findings: DataFrame, key: list[str], seq: str) -> DataFrame:
    """One finding for each key, the first by seq, with all its files as occurrences in that order."""
    rest = [c for c in findings.columns if c not in key]
    g = findings.groupBy(*key).agg(F.min_by(F.struct(*rest), seq).alias("f"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(seq, "file", "line"))).alias("o"))
    return g.select(*key, "f.*", F.col("n").alias("n_occurrences"), F.transform("o", lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line"))).alias("occurrences"))


def exact_dedup(findings: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The first row of each key; a partial aggregate, not a window."""
    rest = [c for c in findings.columns if c not in key]
    return findings.groupBy(*key).agg(F.min_by(F.struct(*rest), seq).alias("f")).select(*key, "f.*")


def ranked(findings: DataFrame) -> DataFrame:
    """Findings by score, then id, file, line, fingerprint."""
    return findings.orderBy(F.desc("score"), *[F.asc_nulls_first(c) for c in ("id", "file", "line", "fingerprint")])


def top_severity(findings: DataFrame) -> DataFrame:
    """Each rule with its count and highest severity."""
    return findings.groupBy("id").agg(F.count("*").alias("n"), F.max_by("severity", points(F.col("severity"))).alias("severity"))


def blast_dirs(paths: DataFrame, patch: str, path: str, over: int = 5) -> DataFrame:
    """Patches that touch more than `over` top-level directories, lockfiles left out."""
    p = paths.where(~F.element_at(F.split(path, "/"), -1).isin(*LOCKFILES))
    return p.groupBy(patch).agg(F.countDistinct(F.element_at(F.split(path, "/"), 1)).alias("dirs")).where(F.col("dirs") > over)


def proven(vectors: DataFrame, percent: float) -> DataFrame:
    """Sanitizer and class whose share of clean repositories reaches the threshold."""
    g = vectors.groupBy("sanitizer_path", "finding_class").agg(F.sum("repos_observed").alias("observed"), F.sum("clean_repos").alias("clean"))
    return g.where((F.col("observed") > 0) & (F.col("clean") * 100 >= percent * F.col("observed")))


def protected_dir(path: Column) -> Column:
    """a path with a segment that holds no live code of its own."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in PROTECTED_DIRS]))


def unlinked(body: Column) -> Column:
    """no reference to an issue."""
    return ~F.lower(body).rlike(r"(?:closes?|fix(?:es)?|resolves?|related to|refs?) #\s*#?\d")


def thermo(base_ms: Column, run_ms: Column, base_kb: Column, run_kb: Column, diff_lines: Column) -> Column:
    """a small change that more than tripled time or memory; a zero baseline says nothing."""
    ratio = lambda run, base: F.coalesce(F.try_divide(run, base), F.lit(0.0))
    return (diff_lines < 100) & ((ratio(run_ms, base_ms) > 3) | (ratio(run_kb, base_kb) > 3))


def taint_probability(p: Column, hop: Column) -> Column:
    """What is left of a taint after a hop, within 0 and 1."""
    f = F.when(hop == "sanitized", 0.18).when(hop == "unknown", 0.74).otherwise(0.96)
    return F.least(F.greatest(p * f, F.lit(0.0)), F.lit(1.0))


def necrotic_flag(total: Column, decayed: Column, unwired: Column, semantic_null: Column, registry: Column) -> Column:
    """The first of ghost collision (more than half decayed), unwired island and semantic null; the first two need a registry."""
    ghost = registry & (total > 0) & (decayed * 2 > total)
    return F.when(ghost, "GHOST_COLLISION").when(registry & unwired, "UNWIRED_ISLAND").when(semantic_null, "SEMANTIC_NULL")


def suppress(findings: DataFrame, suppressions: DataFrame, now: Column) -> DataFrame:
    """findings without those that an approved, live suppression of their rule and path covers; an unapproved one adds a finding of its own.

    suppressions: rule, path_glob, expires, approved.  The join is an equality on
    the rule; the glob is a filter on it.
    """
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("path_glob"), r"[.+^${}()|\[\]\\]", r"\\$0"), r"\*\*", "\u0001"), r"\*", "[^/]*"), F.lit("$"))
    live = suppressions.where(F.col("expires").isNull() | (F.col("expires") > now)).withColumn("_re", F.regexp_replace(pattern, "\u0001", ".*"))
    hit = findings.join(live.select(F.col("rule").alias("id"), "_re", "approved"), "id").where(F.expr("file RLIKE _re"))
    gone = hit.where("approved").select("id", "file", "line").distinct()
    extra = hit.where("NOT approved").select(F.lit("security:unapproved_suppression").alias("id"), "file", "line", F.lit("KevCritical").alias("severity")).distinct()
    kept = findings.join(gone, ["id", "file", "line"], "left_anti").select("id", "file", "line", "severity")
    return kept.unionByName(extra)


def check_then_act(events: DataFrame, by: list[str], order: str, kind: str) -> DataFrame:
    """Each check whose next act on the same resource comes with no guard in between."""
    after = Window.partitionBy(*by).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    n = events.withColumns({"_act": F.min(F.when(F.col(kind) == "act", F.col(order))).over(after), "_guard": F.min(F.when(F.col(kind) == "guard", F.col(order))).over(after)})
    return n.where((F.col(kind) == "check") & F.col("_act").isNotNull() & (F.col("_guard").isNull() | (F.col("_guard") > F.col("_act")))).withColumnRenamed("_act", "act_at").drop("_guard")


def fingerprint(source: Column, start: Column, end: Column) -> Column:
    """The first 8 bytes, in hexadecimal, of the digest of a finding's span (characters from 0, end exclusive, kept within the text)."""
    first, last = F.least(F.greatest(start, F.lit(0)), F.length(source)), F.least(F.greatest(end, F.lit(0)), F.length(source))
    return F.substring(F.sha2(F.substring(source, first + 1, F.greatest(last - first, F.lit(0))), 256), 1, 16)


DECISION = ("dead_symbols_added", "logic_clones_found", "zombie_symbols_added", "antipattern_score", "comment_violations", "unlinked_pr", "hallucinated_security_fix", "agentic_origin_penalty", "version_silo_count")


def decision_total() -> Column:
    """The sum of a decision's score vector; nulls count as 0."""
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in DECISION), F.lit(0))


def selected(findings: DataFrame, expression: str) -> DataFrame:
    """Findings for which a SQL expression over their columns holds; it must be a condition, so the result is findings again."""
    kind = findings.select(F.expr(expression).alias("c")).schema["c"].dataType.simpleString()
    if kind != "boolean":
        raise ValueError(f"the expression must be a condition, not {kind}")
    return findings.where(expression)


def believed(findings: DataFrame, verdicts: DataFrame, most: float = 0.85) -> DataFrame:
    """findings of symbols whose estimated chance of being false is at most the limit; verdicts: symbol, pardoned, confirmed."""
    p = (F.col("pardoned") + 1) / (F.col("pardoned") + F.col("confirmed") + 2)
    return findings.join(verdicts.where(p > most).select("symbol").distinct(), "symbol", "left_anti")


def learned(findings: DataFrame, memory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings whose rule class the memory (rule_class, fingerprint) knows; and the signatures that it lacks, each once."""
    known = findings.join(memory.select("rule_class").distinct(), "rule_class", "left_semi")
    new = findings.select("rule_class", "fingerprint").distinct().join(memory.select("fingerprint"), "fingerprint", "left_anti")
    return known, new.dropDuplicates(["fingerprint"])


def merged_patterns(a: Column, b: Column) -> Column:
    """Two lists of patterns as one, sorted, repeats kept."""
    return F.sort_array(F.concat(a, b))


def pattern_matches(name: Column, patterns: DataFrame, symbols: DataFrame) -> DataFrame:
    """E5: symbols that a dictionary (kind: exact, prefix, suffix or marker; word) knows.  Exact words join on equality; prefixes and suffixes join on every cut of a name; markers are words between its underscores."""
    s = symbols.withColumn("_name", name)
    cuts = F.sequence(F.lit(1), F.greatest(F.length("_name"), F.lit(1)))
    keys = F.array_distinct(F.concat(
        F.array(F.struct(F.lit("exact").alias("kind"), F.col("_name").alias("word"))),
        F.transform(cuts, lambda i: F.struct(F.lit("prefix").alias("kind"), F.substring("_name", F.lit(1), i).alias("word"))),
        F.transform(cuts, lambda i: F.struct(F.lit("suffix").alias("kind"), F.right("_name", i).alias("word"))),
        F.transform(F.split("_name", "_+"), lambda w: F.struct(F.lit("marker").alias("kind"), w.alias("word"))),
    ))
    each = s.select(*symbols.columns, F.explode(keys).alias("k")).select(*symbols.columns, "k.kind", "k.word")
    return each.join(patterns.select("kind", "word").distinct(), ["kind", "word"], "left_semi").select(*symbols.columns).distinct()
