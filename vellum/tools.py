"""The operations that a tool server offers (survey E8) and the command line (E9): thin functions over the operators.

Each operation is named, takes a session and a path, and says what it may do: all of
them read, none changes what it reads.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import deps, detectors, log, rules, sketch, syntax
from .sources import readers, sinks


def _sources(spark: SparkSession, path: str) -> DataFrame:
    return readers.read_tree(spark, path).where("content IS NOT NULL").select("path", F.col("content").cast("string").alias("content"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Findings of every rule over a tree, suppressed lines left out."""
    files = _sources(spark, path)
    lines = detectors.scan(files).select("path", "id", "severity", "line", F.col("snippet").alias("detail"))
    return detectors.unsuppressed(rules.findings(files).unionByName(lines).dropDuplicates(["path", "id", "line"]), files)


def dedup(spark: SparkSession, path: str) -> DataFrame:
    """Groups of functions of one structure."""
    e = syntax.entity_table(_sources(spark, path)).where("kind = 'function' AND structural_hash != 0")
    return e.groupBy("structural_hash").agg(F.count("*").alias("n"), F.min("path").alias("first_path"), F.min("qualified_name").alias("first_name")).where("n > 1").orderBy(F.desc("n"), "first_path")


def clean(spark: SparkSession, path: str) -> DataFrame:
    """What a clean-up would cut: functions that nothing calls by name; a plan, nothing is changed."""
    files = _sources(spark, path)
    e = syntax.entity_table(files).where("kind = 'function'")
    called = syntax.call_sites(files).select(F.col("callee").alias("name")).distinct()
    return e.join(called, "name", "left_anti").select("path", "qualified_name", "start", "end", F.lit("not called").alias("reason"))


def dep_check(spark: SparkSession, path: str) -> DataFrame:
    """Declared dependencies that no source names."""
    tree = readers.read_tree(spark, path).where("content IS NOT NULL")
    declared = readers.manifests(tree).select(F.col("name"))
    texts = readers.walk(tree, "py", "js", "ts", "tsx", "jsx", "rs", "go", "java").select("path", F.col("content").cast("string").alias("text"))
    return deps.unused(declared, texts)


def silo_audit(spark: SparkSession, path: str) -> DataFrame:
    """Dependencies of more than one version, by lockfiles first."""
    tree = readers.read_tree(spark, path).where("content IS NOT NULL")
    return deps.silos(deps.lock_table(tree).select("name", "version"), readers.manifests(tree).select("name", "version"))


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a review log with their class and what they saved."""
    return log.bill(log.classify(readers.read_log(spark, path)))


def report(spark: SparkSession, path: str) -> DataFrame:
    """Repositories of a log by score."""
    return sinks.global_report(readers.read_log(spark, path))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Notes of Markdown ledgers by urgency."""
    return readers.campaigns(readers.read_tree(spark, path, "*.md").where("content IS NOT NULL"))


def near_texts(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of files whose texts resemble each other."""
    return sketch.lsh_links(_sources(spark, path), "path", "content", 0.7)


#: Operations by name, with what they may touch.
TOOLS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    f.__name__: (f, reads) for f, reads in ((scan, "tree"), (dedup, "tree"), (clean, "tree"), (dep_check, "tree"), (silo_audit, "tree"), (provenance, "log"), (report, "log"), (ledger, "tree"), (near_texts, "tree"))
}


def main(argv: list[str] | None = None) -> None:
    """Run an operation on a path, or a registered query on a folder of tables, and show or write its rows."""
    parser = argparse.ArgumentParser(prog="python -m vellum.tools", description=__doc__)
    parser.add_argument("name", help="an operation, a query, or list")
    parser.add_argument("path", nargs="?", help="what it reads")
    parser.add_argument("--out", help="write Parquet there instead of showing rows")
    parser.add_argument("--where", help="a condition that rows must meet")
    parser.add_argument("--rows", type=int, default=50, help="rows to show")
    given = parser.parse_args(argv)
    from .plans import catalog

    if given.name == "list":
        print("\n".join([*TOOLS, *sorted(catalog.queries())]))
        return
    run = TOOLS[given.name][0] if given.name in TOOLS else catalog.queries()[given.name]
    spark = SparkSession.builder.getOrCreate()
    out = run(spark, given.path)
    out = out.where(given.where) if given.where else out
    if given.out:
        out.write.mode("overwrite").parquet(given.out)
    else:
        out.show(given.rows, truncate=False)


if __name__ == "__main__":
    main()
