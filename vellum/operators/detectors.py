"""Rule rows over source text as plan expressions, and a Python call-site table function (survey S16, S21, G18, F4, W9, E1, E3; D8, D12, D15, D17, D18, D23, D36, D40-D44, D51, D53, D57).

A rule is a row: id, languages, a pattern that must match a line or span, and one
that must not.  Rules are code, few and fixed, so they are expressions in the plan
and not a join.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    id: str
    languages: tuple[str, ...]
    pattern: str
    severity: str = "Critical"
    unless: str | None = None


RULES: tuple[Rule, ...] = (
    Rule("security:subprocess_shell_injection", ("py",), r"subprocess\.(?:run|call|Popen|check_output)\([^\n]*shell\s*=\s*True"),
    Rule("security:sqli_concatenation", ("py", "js", "ts", "java", "cs", "go", "rb", "php"), r"(?i)(?:execute|query|raw|prepare|CommandText)\s*(?:\(|=)[^\n]*[\"'](?:select|insert|update|delete)\b[^\n]*[\"']\s*(?:\+|\.\s*\$|%)"),
    Rule("security:ssrf_dynamic_url", ("py", "js", "ts", "go"), r"(?:requests\.(?:get|post)|urlopen|fetch|axios\.(?:get|post)|http\.Get)\([^\n]*[\"']\s*\+"),
    Rule("security:path_traversal", ("py", "js", "ts"), r"(?:\bopen|readFile(?:Sync)?)\(\s*[^,)\n]*\+"),
    Rule("security:dom_xss_innerHTML", ("js", "ts", "jsx", "tsx"), r"\.innerHTML\s*=(?!=)"),
    Rule("security:prototype_pollution", ("js", "ts"), r"__proto__|constructor\s*\[\s*[\"']prototype"),
    Rule("security:unsafe_deserialization", ("java", "cs", "php", "rb", "scala", "py"), r"ObjectInputStream\s*\(|readObject\s*\(|TypeNameHandling\.(?:All|Auto|Objects)|BinaryFormatter\s*\(|\bunserialize\s*\(|Marshal\.load|pickle\.loads?\("),
    Rule("security:runtime_exec", ("java", "kt", "scala"), r"Runtime\.getRuntime\(\)\.exec\("),
    Rule("security:eval_injection", ("py", "js", "ts", "rb", "php", "lua", "sh"), r"\beval\s*[\( ]\s*[$\w]", "Critical"),
    Rule("security:banned_libc_call", ("c", "h", "cpp", "cc", "hpp"), r"\b(?:gets|strcpy|strcat|sprintf|vsprintf|system)\s*\("),
    Rule("security:tls_verification_disabled", ("go", "py", "js"), r"InsecureSkipVerify\s*:\s*true|verify\s*=\s*False|rejectUnauthorized\s*:\s*false"),
    Rule("security:open_cidr", ("tf", "hcl"), r"cidr_blocks\s*=\s*\[[^\]]*\"0\.0\.0\.0/0\""),
    Rule("security:iam_wildcard_action", ("tf", "hcl", "json"), r"\"?Action\"?\s*[=:]\s*\[?\s*\"\*\""),
    Rule("security:s3_public_acl", ("tf", "hcl"), r"acl\s*=\s*\"public-read"),
    Rule("security:k8s_wildcard_host", ("yaml", "yml"), r"host:\s*[\"']?\*"),
    Rule("security:docker_remote_add", ("dockerfile",), r"(?im)^\s*ADD\s+https?://"),
    Rule("security:dockerfile_pipe_execution", ("dockerfile", "sh"), r"(?:curl|wget)[^\n|]*\|\s*(?:ba|z)?sh"),
    Rule("security:xxe_external_entity", ("xml", "xsd"), r"<!ENTITY\s+\S+\s+SYSTEM"),
    Rule("security:protobuf_any_type_field", ("proto",), r"google\.protobuf\.Any\s+\w+\s*="),
    Rule("security:bazel_unverified_http_archive", ("bzl", "bazel"), r"http_archive\((?:(?!sha256)[^)])*\)"),
    Rule("security:cmake_execute_process_injection", ("cmake",), r"execute_process\([^)]*\$\{"),
    Rule("security:jwt_validation_bypass", ("py", "js", "ts", "go", "java"), r"(?i)algorithms?\s*[=:]\s*\[?\s*[\"']none[\"']|verify_signature[\"']?\s*:\s*False|ParseUnverified\("),
    Rule("security:oauth_csrf_missing_state", ("py", "js", "ts"), r"(?i)/authorize\?[^\"'\n]*client_id=(?:(?!state=)[^\"'\n])*[\"'\n]"),
    Rule("security:unpinned_ml_model_weights", ("py",), r"from_pretrained\((?:(?!revision)[^)])*\)", "High"),
    Rule("security:non_constant_time_comparison", ("py", "js", "go"), r"(?i)\b(?:hmac|signature|digest|token)\w*\s*===?\s*\w"),
    Rule("security:rust_unsafe_transmute", ("rs",), r"\btransmute(?:::<[^>]*>)?\s*\("),
    Rule("security:solidity_delegatecall", ("sol",), r"\.delegatecall\s*\("),
    Rule("security:swift_dynamic_symbol", ("swift", "m"), r"\bdlopen\s*\(|NSClassFromString\s*\("),
    Rule("security:unpinned_workflow_action", ("yaml", "yml"), r"uses:\s*[\w./-]+@(?![0-9a-f]{40}\b)\S+", "High"),
    Rule("security:llm_prompt_injection", ("py", "js", "ts"), r"(?i)(?:messages|prompt)\s*[=:][^\n]*(?:request\.|req\.body|input\()"),
)


def with_rules(*own: Rule) -> tuple[Rule, ...]:
    """The rules with some of one's own, for `scan`; nothing is kept between calls."""
    return (*RULES, *own)


def language_of(path: Column) -> Column:
    """The extension that names a file's language; Dockerfile and CMakeLists.txt by name."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(name.startswith("dockerfile"), "dockerfile").when(name == "cmakelists.txt", "cmake").otherwise(F.regexp_extract(name, r"\.([a-z0-9]+)$", 1))


def scan(files: DataFrame, path: str = "path", content: str = "content", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """path, id, severity, line, snippet: one row for each match of each rule of the file's language."""
    rules = RULES if rules is None else rules
    lang, text = language_of(F.col(path)), F.col(content)

    def of(rule: Rule) -> Column:
        hits = F.when(lang.isin(*rule.languages) & text.rlike(rule.pattern), F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
        gaps = F.when(lang.isin(*rule.languages) & text.rlike(rule.pattern), F.split(text, rule.pattern, -1)).otherwise(F.array().cast("array<string>"))
        pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.regexp_count(g, F.lit("\n")).alias("before"), F.regexp_count(h, F.lit("\n")).alias("inside"), h.alias("snippet")))
        start = F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<id:string,severity:string,line:int,snippet:string>>").alias("out"))

        def step(a: Column, p: Column) -> Column:
            line = a["line"] + p["before"]
            row = F.struct(F.lit(rule.id).alias("id"), F.lit(rule.severity).alias("severity"), line.alias("line"), p["snippet"].alias("snippet"))
            return F.struct((line + p["inside"]).alias("line"), F.concat(a["out"], F.array(row)).alias("out"))

        found = F.aggregate(pairs, start, step, lambda a: a["out"])
        return F.filter(found, lambda r: ~r["snippet"].rlike(rule.unless)) if rule.unless else found

    return files.select(path, F.explode(F.concat(*[of(r) for r in rules])).alias("f")).select(path, "f.*")


def suppressed_lines(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """lines that a nosec, noqa or nolint comment on them or on the line before silences."""
    lines = files.select(path, F.posexplode(F.split(content, "\n")).alias("n", "line")).where(F.col("line").rlike(r"(?i)(?:#|//)\s*(?:nosec|noqa|nolint|nosemgrep)"))
    here = F.col("n") + 1
    alone = F.ltrim("line").rlike("^(#|//)")
    return lines.select(path, F.when(alone, here + 1).otherwise(here).alias("line"))


def unsuppressed(findings: DataFrame, files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return findings.join(suppressed_lines(files, path, content).distinct(), [path, "line"], "left_anti")


# --- Python source -----------------------------------------------------------------

ENTITIES = "path string, kind string, name string, qualified_name string, start_line int, end_line int, callee string"


def _entities(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, source in zip(frame["path"], frame["content"], strict=True):
            try:
                tree = ast.parse(source or "")
            except (SyntaxError, ValueError, RecursionError):
                continue
            todo = [(tree, "")]
            while todo:
                node, scope = todo.pop()
                for child in ast.iter_child_nodes(node):
                    inner = scope
                    if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        inner = f"{scope}.{child.name}".lstrip(".")
                        rows.append((path, "class" if isinstance(child, ast.ClassDef) else "function", child.name, inner, child.lineno, child.end_lineno, None))
                    elif isinstance(child, ast.Call):
                        f = child.func
                        callee = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                        if callee:
                            rows.append((path, "call", callee, scope, child.lineno, child.end_lineno, callee))
                    todo.append((child, inner))
        yield pd.DataFrame(rows, columns=["path", "kind", "name", "qualified_name", "start_line", "end_line", "callee"])


def python_entities(files: DataFrame) -> DataFrame:
    """Functions, classes and call sites of Python files; files that do not parse give none."""
    return files.where(F.col("path").endswith(".py")).select("path", F.col("content").cast("string").alias("content")).mapInPandas(_entities, ENTITIES)


def call_edges(entities: DataFrame) -> DataFrame:
    """Caller, callee over the functions that the files define."""
    defined = entities.where("kind = 'function'").select(F.col("name").alias("callee")).distinct()
    return entities.where("kind = 'call' AND qualified_name != ''").select(F.col("qualified_name").alias("caller"), "callee").join(defined, "callee", "left_semi").distinct()
