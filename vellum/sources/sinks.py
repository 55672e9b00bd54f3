"""Sinks (survey K1-K6, K8-K14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import log

#: K2: the columns of the export, in order.
CSV_COLUMNS = (
    "PR_Number", "Author", "Score", "Threat_Class", "Unlinked_PR", "Logic_Clones", "Antipattern_IDs", "Collided_PRs", "Time_Saved_Hours", "Operational_Savings_USD", "Timestamp",
    "PR_State", "Is_Bot", "Repo_Slug", "Commit_SHA", "Policy_Hash", "Agentic_Contribution_Pct",
)
#: Before the header, so that spreadsheets read UTF-8.
BOM = "\ufeff"


def append_log(rows: DataFrame, path: str) -> None:
    """K1: rows as JSON lines, added to a log."""
    rows.write.mode("append").json(path)


def _text(c: str) -> Column:
    """A column as text, empty for null, every line end a space."""
    return F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\r\n", "  ")


def _flag(condition: Column) -> Column:
    return F.when(condition, "TRUE").otherwise("FALSE")


def _seen(rows: DataFrame) -> DataFrame:
    """Rows with null columns for those that a log may lack."""
    wanted = {"state": "string", "commit_sha": "string", "policy_hash": "string", "version_silos": "array<string>", "comment_violations": "array<string>", "dead_symbols_added": "bigint"}
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in rows.columns})


def export_rows(rows: DataFrame) -> DataFrame:
    """K2: the 17 columns of the CSV export."""
    billed = log.bill(log.classify(_seen(rows)))
    clones = F.least(F.coalesce("logic_clones_found", F.lit(0)), F.lit(50)).cast("string")
    collided = F.array_join(F.transform(F.coalesce("collided_pr_numbers", F.array().cast("array<int>")), lambda n: n.cast("string")), "|")
    values = (
        _text("pr_number"), _text("author"), _text("slop_score"), _text("threat_class"), _flag(F.coalesce("unlinked_pr", F.lit(0)) > 0), clones, F.translate(log.antipattern_ids(), "\r\n", "  "), collided,
        F.format_string("%.4f", "time_saved_h"), F.format_string("%.0f", "savings_usd"), _text("ts"), _text("state"), _flag(F.coalesce("is_bot", F.lit(False))), _text("repo_slug"), _text("commit_sha"), _text("policy_hash"),
        F.format_string("%.2f", F.coalesce("agentic_pct", F.lit(0.0))),
    )
    return billed.select(*[v.alias(c) for c, v in zip(CSV_COLUMNS, values, strict=True)])


def export_csv(rows: DataFrame, path: str) -> None:
    """K2, K3: the export as CSV files, each with the mark of UTF-8 and a header; rows of several repositories are told by their slug."""
    out = export_rows(rows)
    out.withColumnRenamed(CSV_COLUMNS[0], BOM + CSV_COLUMNS[0]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


# --- events -----------------------------------------------------------------------


def _none(c: str, kind: str = "array<string>") -> Column:
    return F.coalesce(F.col(c), F.array().cast(kind))


def severity_label() -> Column:
    """K4: severity of a row, by its first finding, then by what it is."""
    first = F.lower(F.coalesce(F.try_element_at(_none("antipatterns"), F.lit(1)), F.lit("")))
    return F.when(first.contains("kevcritical") | first.contains("cisa kev"), "KevCritical").when(log.is_critical(), "Critical").when((F.col("slop_score") > 0) | log.is_necrotic(), "Warning").otherwise("Informational")


def _severity_id() -> Column:
    label = severity_label()
    return F.when(label == "KevCritical", 10).when(label == "Critical", 8).when(label == "Warning", 5).otherwise(1)


def _parts() -> tuple[Column, Column, Column]:
    """Rule id, remediation and message of a row."""
    first = F.coalesce(F.try_element_at(_none("antipatterns"), F.lit(1)), F.lit(""))
    rule = F.trim(F.element_at(F.split(first, " — ", 2), 1))
    kept = lambda name: F.when(F.size(_none(name)) > 0, F.array(F.concat(F.lit(f"{name}="), F.array_join(name, "|")))).otherwise(F.array().cast("array<string>"))
    flag = F.when(F.col("necrotic_flag").isNotNull(), F.array(F.concat(F.lit("necrotic_flag="), "necrotic_flag"))).otherwise(F.array().cast("array<string>"))
    details = F.concat(_none("antipatterns"), _none("comment_violations"), kept("zombie_deps"), kept("version_silos"), flag)
    message = F.when(F.size(details) > 0, F.array_join(details, " ; ")).otherwise("no_findings_recorded")
    advice = F.trim(F.try_element_at(F.split(first, " — ", 2), F.lit(2)))
    return F.when(rule != "", rule).otherwise(F.col("threat_class")), F.when(advice != "", advice).otherwise(message), message


def _cef(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"([\\|=])", r"\\$1"), "\r\n", "  ")


def cef(rows: DataFrame, vendor: str = "vellum", product: str = "vellum", version: str = "1") -> DataFrame:
    """K4: one CEF line for each row."""
    r = log.classify(_seen(rows))
    rule, advice, _ = _parts()
    head = F.lit(f"CEF:0|{vendor}|{product}|{version}|")
    number = F.coalesce(F.col("pr_number").cast("string"), F.lit("0"))
    return r.select(F.concat(head, _cef(rule), F.lit("|"), _cef(F.col("threat_class")), F.lit("|"), _severity_id().cast("string"), F.lit("|msg="), _cef(advice), F.lit(" cs1="), _cef(F.coalesce("repo_slug", F.lit(""))), F.lit(" cs2="), number).alias("line"))


def ocsf(rows: DataFrame, vendor: str = "vellum", product: str = "vellum", version: str = "1") -> DataFrame:
    """K4: one OCSF security finding, as JSON, for each row."""
    r = log.classify(_seen(rows))
    rule, advice, message = _parts()
    open_ = F.col("slop_score") > 0
    lit = lambda v, name: F.lit(v).alias(name)
    uid = F.concat_ws(":", F.coalesce("repo_slug", F.lit("")), F.coalesce("pr_number", F.lit(0)).cast("string"), F.coalesce("commit_sha", F.lit("")))
    event = F.struct(
        F.struct(lit("1.1.0", "version"), F.struct(lit(product, "name"), lit(vendor, "vendor_name"), lit(version, "version")).alias("product")).alias("metadata"),
        lit("Findings", "category_name"), lit(2, "category_uid"), lit("Security Finding", "class_name"), lit(2001, "class_uid"), lit("Create", "activity_name"), lit(1, "activity_id"),
        severity_label().alias("severity"), _severity_id().alias("severity_id"), F.when(open_, "Open").otherwise("Closed").alias("status"), F.when(open_, 1).otherwise(2).alias("status_id"),
        F.col("ts").cast("string").alias("time"), message.alias("message"),
        F.struct(F.concat(F.lit(f"{product} "), rule).alias("title"), advice.alias("desc"), uid.alias("uid"), _none("antipatterns").alias("types")).alias("finding_info"),
        F.array(F.struct(F.col("repo_slug").alias("name"), F.col("commit_sha").alias("uid"), lit("repository", "type"))).alias("resources"),
        F.struct(*[c for c in ("pr_number", "author", "logic_clones_found", "dead_symbols_added", "zombie_symbols_added", "comment_violations", "zombie_deps", "version_silos", "policy_hash", "agentic_pct")]).alias("unmapped"),
    )
    return r.select(F.to_json(event).alias("event"))


# --- SARIF, components ---------------------------------------------------------------


def _uri() -> Column:
    number = F.coalesce("pr_number", F.lit(0)).cast("string")
    return F.when(F.coalesce("repo_slug", F.lit("")) == "", F.concat(F.lit("pr/"), number)).otherwise(F.concat("repo_slug", F.lit("/pr/"), number))


def sarif_results(rows: DataFrame) -> DataFrame:
    """K8: one SARIF result for each finding of each row, and one for each row that collides with others: rule, result."""
    who = F.concat(F.lit("PR #"), F.coalesce("pr_number", F.lit(0)).cast("string"), F.lit(" by "), F.coalesce("author", F.lit("-")), F.lit(": "))
    keep = ["seq", _uri().alias("uri"), who.alias("who"), F.col("slop_score").cast("string").alias("score")]
    found = rows.select(*keep, F.posexplode("antipatterns").alias("at", "rule")).select("seq", "at", "uri", F.concat("who", "rule").alias("text"), "score", "rule", F.when(F.col("rule").contains("security:"), "error").otherwise("warning").alias("level"))
    met = rows.where(F.size(_none("collided_pr_numbers", "array<int>")) > 0)
    others = F.concat(F.lit("["), F.array_join(F.transform("collided_pr_numbers", lambda n: n.cast("string")), ", "), F.lit("]"))
    swarm = met.select(*keep, others.alias("o")).select("seq", F.lit(1 << 30).alias("at"), "uri", F.concat("who", F.lit("structural clone collision with PRs "), "o").alias("text"), "score", F.lit("swarm:structural_collision").alias("rule"), F.lit("error").alias("level"))
    line = F.when(F.col("rule").rlike(r"\(line=\d+\)"), F.regexp_extract("rule", r"\(line=(\d+)\)", 1).cast("int"))
    place = F.struct(F.struct("uri").alias("artifactLocation"), F.when(line.isNotNull(), F.struct(line.alias("startLine"))).alias("region"))
    result = F.struct(F.col("rule").alias("ruleId"), "level", F.struct("text").alias("message"), F.array(F.struct(place.alias("physicalLocation"))).alias("locations"), F.struct(F.col("score").alias("score")).alias("partialFingerprints"))
    return found.unionByName(swarm).select("seq", "at", "rule", "level", F.to_json(result).alias("result"))


def sarif_rules(rows: DataFrame) -> DataFrame:
    """K8: the distinct rules with their level and count."""
    r = sarif_results(rows)
    return r.groupBy(F.col("rule").alias("ruleId")).agg(F.when(F.first("rule").contains("security:"), "error").otherwise("warning").alias("level"), F.count("*").alias("n"))


def grouped_findings(findings: DataFrame, most: int = 1000) -> DataFrame:
    """K9: findings (id, severity, file, line, detail) by rule, in order of the rule: id, n, the first `most` results by file and line, how many more there are."""
    order = Window.partitionBy("id").orderBy("file", "line", "detail")
    first = findings.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    listed = first.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "file", "line", "severity", "detail"))), lambda s: F.struct(s["file"].alias("file"), s["line"].alias("line"), s["severity"].alias("severity"), s["detail"].alias("detail"))).alias("results"))
    counts = findings.groupBy("id").agg(F.count("*").alias("n"))
    return counts.join(listed, "id").select("id", "n", F.to_json("results").alias("results"), (F.col("n") - F.size("results")).alias("more")).orderBy("id")


def cbom(rows: DataFrame) -> DataFrame:
    """Components of changes with a score or a flag, as JSON."""
    kept = rows.where((F.col("slop_score") > 0) | F.col("necrotic_flag").isNotNull())
    return kept.select(F.to_json(F.struct(F.lit("application").alias("type"), F.concat(F.lit("pr-"), "pr_number").alias("name"), F.col("slop_score").alias("score"), "necrotic_flag")).alias("component"))


# --- reports: rendered on the driver from a few aggregated rows ------------------------


def bar(n: Column, most: Column, width: int = 20) -> Column:
    """K6: a bar of at most `width` marks."""
    return F.repeat(F.lit("#"), F.coalesce(F.try_divide(n * width, most), F.lit(0)).cast("int"))


def _table(head: list[str], rows: list) -> list[str]:
    return [f"| {' | '.join(head)} |", f"| {' | '.join('---' for _ in head)} |", *(f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in rows)]


def markdown(totals: DataFrame) -> str:
    """K5: a one-row table of totals as Markdown; the driver sees that row only."""
    row = totals.first().asDict()
    return "\n".join(_table(["measure", "value"], list(row.items()))) + "\n"


def report(rows: DataFrame, top: int = 10) -> dict:
    """K5: the report of one repository: totals, the worst changes, authors, necrotic changes; `top` rows each."""
    listed = lambda df: [r.asDict() for r in df.limit(top).collect()]
    worst = log.classify(log.top_n(rows, top)).withColumn("violation", log.primary_violation())
    return {
        "totals": log.totals(rows).first().asDict(),
        "top": listed(worst.select("pr_number", "author", "slop_score", "threat_class", "violation")),
        "authors": listed(log.author_stats(rows, top)),
        "necrotic": listed(log.necrotic_list(rows).select("pr_number", "slop_score", "necrotic_flag")),
    }


def report_markdown(made: dict, title: str = "Report") -> str:
    """K5: a report as Markdown."""
    out = [f"# {title}", "", *_table(["measure", "value"], list(made["totals"].items()))]
    for part in ("top", "authors", "necrotic"):
        out += ["", f"## {part.capitalize()}", ""]
        rows = made[part]
        out += _table(list(rows[0]), [list(r.values()) for r in rows]) if rows else ["none"]
    return "\n".join(out) + "\n"


def global_report(rows: DataFrame, width: int = 20) -> DataFrame:
    """K6: repositories by total score with a bar, the grand total last."""
    rolled = log.repo_rollup(rows)
    most = rolled.where("repo_slug IS NOT NULL").agg(F.max("total_score").alias("most"))
    return rolled.join(F.broadcast(most)).withColumn("bar", F.when(F.col("repo_slug").isNotNull(), bar(F.col("total_score"), F.col("most"), width))).drop("most").orderBy(F.col("repo_slug").isNull(), F.desc("total_score"), "repo_slug")  # most: one row


def step_summary(rows: DataFrame, least: int = 100, top: int = 5) -> str:
    """What a run's summary says: whether the gate holds, the totals, the worst changes."""
    made = report(rows, top)
    failed = rows.where(F.col("slop_score") >= least).count()
    head = [f"## {'Blocked' if failed else 'Passed'}", "", f"{failed} of {made['totals']['n']} changes reach {least} points.", ""]
    return "\n".join(head) + report_markdown(made, "Summary")


# --- stored state -----------------------------------------------------------------------


def upserted(old: DataFrame, new: DataFrame, key: tuple[str, ...] = ("symbol_name", "file_path"), most_bytes: int = 10 << 20) -> DataFrame:
    """Old records with the new ones in place of those of the same key; the oldest go when the whole is larger than a limit.

    Rows have seq, the order in which they were written.  Sizes are summed by a window
    over the newest rows; the result is as small as the limit, and what cannot be in it
    is cut before by a running sum over hashed ranges of seq.
    """
    whole = new.unionByName(old.join(new.select(*key).distinct(), list(key), "left_anti"))
    sized = whole.withColumn("_size", F.length(F.to_json(F.struct(*whole.columns))))
    step = sized.agg(F.coalesce((F.max("seq") - F.min("seq") + 1) / 1000, F.lit(1.0)).alias("step"), F.max("seq").alias("top")).first()
    width = max(1, int(step["step"] or 1) + 1)
    ranges = sized.withColumn("_range", F.floor((F.lit(step["top"] or 0) - F.col("seq")) / width))  # 1000 at most, newest first
    sums = ranges.groupBy("_range").agg(F.sum("_size").alias("s"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.select("_range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_before")).where(F.col("_before") < most_bytes)
    inside = Window.partitionBy("_range").orderBy(F.desc("seq"))
    kept = ranges.join(F.broadcast(begun), "_range").withColumn("_until", F.col("_before") + F.sum("_size").over(inside))
    return kept.where(F.col("_until") <= most_bytes).drop("_size", "_range", "_before", "_until")


def save(table: DataFrame, path: str) -> None:
    """A registry, catalogue or state as Parquet; readers see the old files or the new ones, by the writer's commit."""
    table.write.mode("overwrite").parquet(path)


# --- who is told ---------------------------------------------------------------------------


def badge(score: Column) -> Column:
    """The colour of a score."""
    return F.when(score == 0, "brightgreen").when(score < 100, "yellow").otherwise("red")


def ticketed(findings: DataFrame) -> DataFrame:
    """Findings that open a ticket: of known exploited vulnerabilities only."""
    return findings.where("severity = 'KevCritical'")


def fires(rows: DataFrame, events: tuple[str, ...], url: str) -> DataFrame:
    """Rows that a webhook with these events is called for; none without an address."""
    condition = F.lit(False)
    for event, holds in (("critical_threat", log.is_critical()), ("necrotic_flag", F.col("necrotic_flag").isNotNull()), ("all", F.lit(True))):
        condition = condition | holds if event in events else condition
    return rows.where(condition & F.lit(bool(url)))
