"""Scans of source files: small files are dealt over the rows of part, and what they must give is written beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules, shields, syntax
from . import cases
from .registry import query, table


def _files(spark, sf_dir, dealt):
    """A file for each part: the case of its key, in a folder of its own."""
    small = spark.createDataFrame([(k, p, t) for k, (p, t, _) in enumerate(dealt)], "k long, name string, content string")
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(dealt)).alias("k"))
    return part.join(F.broadcast(small), "k").select(F.concat(F.lit("p"), "p_partkey", F.lit("/"), "name").alias("path"), "content")


def _sql(dealt, columns: str, rows) -> str:
    """What the cases of the parts must give, as SQL over the expectations alone."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    values = ", ".join(f"({k}, {quoted(path)}, {', '.join(map(quoted, r))})" for k, (path, _, want) in enumerate(dealt) for r in rows(want))
    return f"SELECT 'p' || p_partkey || '/' || name AS path, {columns} FROM part JOIN (VALUES {values}) e(k, name, {columns}) ON p_partkey % {len(dealt)} = k"


@query("scan_findings", "SELECT path, id, line::INT AS line, count(*)::BIGINT AS n FROM (" + _sql(cases.RULES, "id, line", lambda want: want) + ") GROUP BY ALL")
def scan_findings(spark, sf_dir):
    return rules.findings(_files(spark, sf_dir, cases.RULES)).groupBy("path", "id", "line").agg(F.count("*").alias("n"))


@query("scan_entities", "SELECT path, kind, qualified_name, start_line::INT AS start_line, end_line::INT AS end_line FROM (" + _sql(cases.ENTITIES, "kind, qualified_name, start_line, end_line", lambda want: want) + ")")
def scan_entities(spark, sf_dir):
    return syntax.entity_table(_files(spark, sf_dir, cases.ENTITIES)).select("path", "kind", "qualified_name", "start_line", "end_line")


@query("scan_clones", f"""WITH f AS (SELECT p_partkey, p_partkey % {len(cases.ENTITIES)} AS k FROM part) SELECT 'add' AS name, count(*)::BIGINT AS n FROM f WHERE k IN (0, 1)
UNION ALL SELECT 'sub', count(*)::BIGINT FROM f WHERE k = 0""")
def scan_clones(spark, sf_dir):
    """Groups of Python functions of one structure: add and plus share theirs, sub has its own."""
    e = syntax.entity_table(_files(spark, sf_dir, cases.ENTITIES)).where("kind = 'function' AND name IN ('add', 'plus', 'sub')")
    return e.groupBy("structural_hash").agg(F.min("name").alias("name"), F.count("*").alias("n")).select("name", "n")


def _shielded(path, text):
    """Every predicate that holds, as one array of labels."""
    none = F.array().cast("array<string>")
    one = lambda c, label: F.when(c, F.array(F.lit(label))).otherwise(none)
    told = lambda c, head: F.when(c.isNotNull(), F.array(F.concat(F.lit(head), c))).otherwise(none)
    base = F.element_at(F.split(path, "/"), -1)
    uses = F.transform(shields.mutable_actions(path, text), lambda u: F.concat(F.lit("uses:"), u["line"].cast("string"), F.lit(":"), u["value"]))
    frameworks = F.when(base == "models.py", F.array_compact(F.array(*[F.when(c, f"framework:{n}") for n, c in shields.framework_flags(text).items()]))).otherwise(none)
    return F.concat(
        told(shields.living_off_the_land(text, path), "lotl:"),
        told(shields.ci_injection(shields.string_literals(F.when(base.endswith(".py"), text).otherwise(""))), "ci:"),
        shields.carriers(text),
        one(shields.rag_poisoning(text), "security:rag_context_poisoning"),
        one(shields.financial_leak(text), "security:financial_pii_to_external_llm"),
        F.transform(shields.unpinned_git_dependencies(base, text), lambda d: F.concat(F.lit("git:"), d)),
        uses,
        F.when(path.contains(".github/workflows/"), shields.oidc_findings(text)).otherwise(none),
        F.transform(shields.untrusted_extensions(path, text), lambda d: F.concat(F.lit("ide:"), d)),
        told(shields.generative_build(path, text), "build:"),
        one(shields.build_worm(path, text), "security:cargo_build_worm"),
        frameworks,
    )


@query("scan_shields", _sql(cases.SHIELDS, "label", lambda want: [(w,) for w in want]))
def scan_shields(spark, sf_dir):
    f = _files(spark, sf_dir, cases.SHIELDS)
    return f.select("path", F.explode(_shielded(F.col("path"), F.col("content"))).alias("label"))
