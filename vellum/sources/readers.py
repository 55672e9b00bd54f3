"""Sources (survey S1-S5, S11, S14, S15, S17-S20, S24, F6, T4, X13)."""

from __future__ import annotations

import io
import json
import re
import struct
import tarfile
import tomllib
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators.log import LOG

# Segments and suffixes that a scan leaves out; a tool's own state folder is a parameter.
EXCLUDED = ("__pycache__", ".git", "venv", ".venv", "target", "node_modules", ".pytest_cache", "site", "dist", "build", "compiled", "deps", "vendor", "thirdparty")
EXCLUDED_SUFFIXES = (".pb.go", ".pb.rs", ".min.js")


def scanned(path: Column, state_folder: str = ".state") -> Column:
    """Whether a scan reads a path: no segment of it is excluded, and its name is not that of a generated file."""
    p = F.translate(path, "\\", "/")
    keep = ~F.exists(F.split(p, "/"), lambda s: s.isin(*EXCLUDED, state_folder))
    for suffix in EXCLUDED_SUFFIXES:
        keep = keep & ~p.endswith(suffix)
    return keep


def read_log(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """An NDJSON log; malformed and blank lines are left out, rows without a score are of another kind."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("slop_score IS NOT NULL")


def discover_logs(spark: SparkSession, root: str, name: str = "bounce_log.ndjson", schema: str = LOG) -> DataFrame:
    """The logs one level below root, the folder's name as repo."""
    logs = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{root.rstrip('/')}/*/{name}").where("slop_score IS NOT NULL")
    return logs.withColumn("repo", F.regexp_extract("_metadata.file_path", rf"([^/]+)/{name}$", 1))


def read_tree(spark: SparkSession, root: str, glob: str = "*", largest: int = scalars.FILE_BYTES, state_folder: str = ".state", assets: bool = False) -> DataFrame:
    """Path and content of the files that scans read, one row each; a file that is too large, or a binary asset (unless `assets`, as for `archives`), has a row with null content, so it is not lost without a word."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    name = root.rstrip("/").rsplit("/", 1)[-1] + "/"
    below = F.expr(f"substring(path, instr(path, '{name}') + {len(name)})")  # the root's own place does not count
    kept = files.where(scanned(below, state_folder))
    return kept.select("path", "length", F.when((F.lit(assets) | scalars.scannable(F.col("path"), F.lit(0))) & (F.col("length") <= largest), F.col("content")).alias("content"))


def walk(files: DataFrame, *surfaces: str) -> DataFrame:
    """The files of some surfaces (py; cpp; or any)."""
    return files.where(scalars.surface(F.col("path")).isin(*surfaces))


_APT = re.compile(r"\bapt(?:-get)?\s+(?:-\S+\s+)*install\s+((?:[^\n;&|\\\\]|\\\\\n)+)")


# Extensions that are scanned first.
FIRST_SCANNED = ("rs", "py", "go", "js", "ts", "tsx", "jsx", "cs", "java", "cpp", "cc", "cxx", "c")


def by_priority(files: DataFrame) -> DataFrame:
    """T4: files in the order in which they are scanned: source code first, then by path."""
    return files.orderBy(~F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*FIRST_SCANNED), "path")


def _manifests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, content in zip(frame["path"], frame["content"], strict=True):
            text, base = bytes(content or b"").decode("utf-8", "replace"), path.rsplit("/", 1)[-1]
            try:
                if base == "package.json":
                    data = json.loads(text)
                    for field, dev in (("dependencies", False), ("devDependencies", True)):
                        rows += [(path, k, str(v), "npm", dev) for k, v in (data.get(field) or {}).items()]
                elif base == "Cargo.toml":
                    data = tomllib.loads(text)
                    for field, dev in (("dependencies", False), ("dev-dependencies", True)):
                        rows += [(path, k, v if isinstance(v, str) else str(v.get("version", "*")), "cargo", dev) for k, v in (data.get(field) or {}).items()]
                elif base == "pyproject.toml":
                    for d in (tomllib.loads(text).get("project") or {}).get("dependencies") or []:
                        name = pd.Series([d]).str.extract(r"^\s*([A-Za-z0-9_.-]+)\s*(.*)$").iloc[0]
                        rows.append((path, name[0], name[1] or "*", "pip", False))
                elif base in ("spin.toml", "wrangler.toml"):
                    data = tomllib.loads(text)
                    kind = base.split(".")[0]
                    parts = data.get("component") or [] if kind == "spin" else data.get("services") or []
                    parts = list(parts.values()) if isinstance(parts, dict) else parts
                    rows += [(path, str(p.get("id") or p.get("service") or p.get("binding")), "*", kind, False) for p in parts if isinstance(p, dict)]
                elif base.endswith(".sh"):
                    for m in _APT.finditer(text):
                        rows += [(path, w.partition("=")[0], w.partition("=")[2] or "*", "apt", False) for w in m[1].split() if not w.startswith("-")]
                elif base == "requirements.txt":
                    for line in text.splitlines():
                        name = line.split("#")[0].strip()
                        if name and not name.startswith("-"):
                            head, _, version = name.partition("==")
                            rows.append((path, head.strip(), version.strip() or "*", "pip", False))
            except (ValueError, AttributeError):  # a manifest that does not parse declares nothing
                continue
        yield pd.DataFrame(rows, columns=["path", "name", "version", "ecosystem", "dev"])


def manifests(files: DataFrame) -> DataFrame:
    """Declared dependencies of package.json, Cargo.toml, pyproject.toml, requirements.txt, spin.toml, wrangler.toml and of apt in shell scripts, up to six folders deep."""
    name = F.element_at(F.split("path", "/"), -1)
    named = files.where(name.isin("package.json", "Cargo.toml", "pyproject.toml", "requirements.txt", "spin.toml", "wrangler.toml") | name.endswith(".sh"))
    return named.mapInPandas(_manifests, "path string, name string, version string, ecosystem string, dev boolean")


def _leaves(batches):
    """Every string leaf of JSON values that follow one another in a line."""
    decoder = json.JSONDecoder()
    for batch in batches:
        out = []
        for line in batch.column("value").to_pylist():
            at, line = 0, (line or "").strip()
            while at < len(line):
                try:
                    value, at = decoder.raw_decode(line, at)
                except ValueError:
                    break
                at += len(line[at:]) - len(line[at:].lstrip())
                todo = [value]
                while todo:
                    v = todo.pop()
                    if isinstance(v, str):
                        out.append(v)
                    elif isinstance(v, (list, dict)):
                        todo.extend(v.values() if isinstance(v, dict) else v)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["leaf"])


def json_leaves(lines: DataFrame) -> DataFrame:
    """The string leaves of JSON lines (column value), escapes decoded; what does not parse gives none."""
    return lines.select("value").mapInArrow(_leaves, "leaf string")


def otlp_words(spark: SparkSession, path: str) -> DataFrame:
    """The distinct words of all string leaves of JSON lines, plain or compressed."""
    return json_leaves(spark.read.text(path)).select(F.explode(F.split("leaf", r"\W+")).alias("name")).where("name != ''").distinct()


def _archives(frames: Iterator[pd.DataFrame], largest: int) -> Iterator[pd.DataFrame]:
    """One frame a member, so no archive is held whole beside its own bytes; a member that is too large has a null content."""

    def one(archive, path, content):
        return pd.DataFrame([(archive, path, content)], columns=["archive", "path", "content"])

    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            content = bytes(content or b"")
            data = io.BytesIO(content)
            try:
                if path.endswith(".map"):
                    m = json.loads(content)
                    for name, text in zip(m.get("sources") or [], m.get("sourcesContent") or [], strict=False):
                        yield one(path, name, None if text is None or len(text) > largest else text.encode())
                elif path.endswith(".asar"):
                    for name, raw in _asar(content):
                        yield one(path, name, raw if len(raw) <= largest else None)
                elif zipfile.is_zipfile(data):
                    with zipfile.ZipFile(data) as z:
                        for i in z.infolist():
                            if not i.is_dir():
                                yield one(path, i.filename, z.read(i) if i.file_size <= largest else None)
                else:
                    data.seek(0)
                    with tarfile.open(fileobj=data) as t:
                        for m in t:
                            if m.isfile():
                                raw = t.extractfile(m).read() if m.size <= largest or m.name.endswith((".tar", "/layer.tar")) else None
                                if m.name.endswith(".tar"):  # a layer of an image
                                    with tarfile.open(fileobj=io.BytesIO(raw)) as layer:
                                        for f in layer:
                                            if f.isfile():
                                                yield one(path, f"{m.name}/{f.name}", layer.extractfile(f).read() if f.size <= largest else None)
                                else:
                                    yield one(path, m.name, raw)
            except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, ValueError, AttributeError, TypeError, KeyError, struct.error):
                continue


def _asar(content: bytes):
    """Members of an application archive: a header of JSON with offsets, then the files."""
    size, length = struct.unpack_from("<I", content, 4)[0], struct.unpack_from("<I", content, 12)[0]
    todo = [("", json.loads(content[16 : 16 + length]))]
    while todo:
        name, node = todo.pop()
        if "files" in node:
            todo += [(f"{name}/{k}".lstrip("/"), v) for k, v in node["files"].items()]
        elif "offset" in node:
            at = 8 + size + int(node["offset"])
            yield name, content[at : at + int(node["size"])]


def archives(files: DataFrame, largest: int = scalars.FILE_BYTES) -> DataFrame:
    """Members of zip (wheel, jar, apk, ipa), tar (npm, sdist, image with its layers), asar and source-map files."""
    return files.select("path", "content").mapInPandas(lambda frames: _archives(frames, largest), "archive string, path string, content binary")


# --- feeds, schemas, topology ------------------------------------------------------


def kev_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a catalogue of exploited vulnerabilities (one JSON document)."""
    schema = "vulnerabilities array<struct<cveID:string,vendorProject:string,product:string,dateAdded:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("vulnerabilities").alias("v")).select(F.col("v.cveID").alias("cve"), F.lower("v.vendorProject").alias("vendor"), F.lower("v.product").alias("product"), F.col("v.dateAdded").alias("added"))


def osv_malicious(files: DataFrame) -> DataFrame:
    """Names of malicious packages in a feed's JSON records (content), by ecosystem; ids of the MAL- series only."""
    schema = "struct<id:string,affected:array<struct<package:struct<name:string,ecosystem:string>>>>"
    parsed = files.select(F.from_json(F.col("content").cast("string"), schema).alias("r")).where(F.col("r.id").startswith("MAL-"))
    return parsed.select(F.explode("r.affected.package").alias("p")).select(F.lower("p.ecosystem").alias("ecosystem"), F.col("p.name").alias("name")).distinct()


_INGRESS = "path string, id string, protocol string, method string, route string"


def _schemas(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, content in zip(frame["path"], frame["content"], strict=True):
            text = bytes(content or b"").decode("utf-8", "replace")
            base = path.rsplit("/", 1)[-1].lower()
            if base.endswith(".proto"):
                for service in re.finditer(r"service\s+(\w+)\s*\{((?:[^{}]|\{[^{}]*\})*)\}", text):
                    rows += [(path, f"{service[1]}.{m}", "grpc", "RPC", f"/{service[1]}/{m}") for m in re.findall(r"rpc\s+(\w+)", service[2])]
            elif base.endswith((".graphql", ".gql")):
                for block in re.finditer(r"type\s+(Query|Mutation|Subscription)\b[^{]*\{([^}]*)\}", text):
                    rows += [(path, f"{block[1]}.{m}", "graphql", block[1].upper(), m) for m in re.findall(r"(?m)^\s*(\w+)\s*(?:\([^)]*\))?\s*:", block[2])]
            elif base.endswith((".json", ".yaml", ".yml")):
                rows += [(path, f"{m} {r}", p, m, r) for p, m, r in _routes(text, base.endswith(".json"))]
            elif base.endswith(".fga"):
                kind = None
                for line in text.splitlines():
                    if m := re.match(r"\s*type\s+(\w+)", line):
                        kind = m[1]
                    elif kind and (m := re.match(r"\s*define\s+(\w+)\s*:\s*(.+)", line)):
                        rows.append((path, f"{kind}#{m[1]}", "openfga", "RELATION", m[2].strip()))
        yield pd.DataFrame(rows, columns=["path", "id", "protocol", "method", "route"])


def _routes(text: str, is_json: bool):
    """(protocol, method, route) of OpenAPI paths and AsyncAPI channels, of JSON by its tree, of YAML by its indentation."""
    methods = ("get", "put", "post", "delete", "patch", "head", "options")
    if is_json:
        try:
            data = json.loads(text)
        except ValueError:
            return
        if isinstance(data, dict):
            for route, ops in (data.get("paths") or {}).items() if "openapi" in data or "swagger" in data else ():
                yield from (("http", m.upper(), route) for m in ops if m in methods)
            for route, ops in (data.get("channels") or {}).items() if "asyncapi" in data else ():
                yield from (("async", m.upper(), route) for m in ops if m in ("publish", "subscribe"))
        return
    protocol = "http" if re.search(r"(?m)^(openapi|swagger):", text) else "async" if re.search(r"(?m)^asyncapi:", text) else None
    section, route, deep = None, None, 0
    for line in text.splitlines() if protocol else ():
        indent, word = len(line) - len(line.lstrip()), line.strip()
        if not word or word.startswith("#"):
            continue
        if indent == 0:
            section, route = word.rstrip(":"), None
        elif section in ("paths", "channels") and word.endswith(":"):
            key = word[:-1].strip("\"'")
            if route is None or indent <= deep:
                route, deep = key, indent
            elif key in (methods if protocol == "http" else ("publish", "subscribe")):
                yield protocol, key.upper(), route


def api_schemas(files: DataFrame) -> DataFrame:
    """What services let in: gRPC methods, OpenAPI routes, AsyncAPI channels, GraphQL fields, OpenFGA relations."""
    named = files.where(F.lower("path").rlike(r"\.(?:proto|graphql|gql|json|ya?ml|fga)$"))
    return named.select("path", "content").mapInPandas(_schemas, _INGRESS)


def _mesh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, content in zip(frame["path"], frame["content"], strict=True):
            section = service = field = None
            deep = 0
            for line in bytes(content or b"").decode("utf-8", "replace").splitlines():
                indent, word = len(line) - len(line.lstrip()), line.strip()
                if not word or word.startswith("#"):
                    continue
                if indent == 0:
                    section, service = word.rstrip(":"), None
                elif section == "services":
                    if service is None or indent <= deep:
                        service, deep, field = word.split(":")[0].strip("\"'"), indent, None
                        rows.append((path, service, None))
                    elif word.startswith("depends_on:"):
                        field = "depends_on"
                        rows += [(path, service, x.strip(" \"'")) for x in word[11:].strip(" []").split(",") if x.strip()]
                    elif field and word.startswith("- "):
                        rows.append((path, service, word[2:].strip("\"' ")))
                    elif field and word.endswith(":") and not word.startswith("condition"):
                        rows.append((path, service, word[:-1].strip("\"'")))
                    elif not word.startswith(("- ", "condition")):
                        field = None
        yield pd.DataFrame(rows, columns=["path", "service", "depends_on"])


def mesh(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of compose files: path, service; path, src, dst."""
    named = files.where(F.element_at(F.split("path", "/"), -1).rlike(r"^(?:docker-)?compose.*\.ya?ml$"))
    rows = named.select("path", "content").mapInPandas(_mesh, "path string, service string, depends_on string")
    return rows.select("path", "service").distinct(), rows.where("depends_on IS NOT NULL").select("path", F.col("service").alias("src"), F.col("depends_on").alias("dst")).distinct()


# Words that a ledger's notes are tagged by.
LEDGER_TAGS = ("auth", "xss", "ssrf", "sqli", "rce", "idor", "deserialization", "supply chain", "oauth", "jwt")


def campaigns(files: DataFrame) -> DataFrame:
    """Notes of Markdown ledgers: path, urls, tags, languages, priority_score; most urgent first, then by path."""
    text = F.col("content").cast("string")
    low = F.lower(text)
    urls = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(https?://[^\s)>\]]+)"), F.lit(1)))
    tags = F.array_compact(F.array(*[F.when(low.contains(t), t) for t in LEDGER_TAGS]))
    langs = F.array_distinct(F.regexp_extract_all(low, F.lit(r"\b(python|rust|go|java|javascript|typescript|ruby|php|kotlin|swift)\b"), F.lit(1)))
    notes = files.where(F.col("path").endswith(".md")).select("path", urls.alias("urls"), tags.alias("tags"), langs.alias("languages"))
    return notes.withColumn("priority_score", F.size("tags") * 10 + F.size("urls") * 2 + F.size("languages")).orderBy(F.desc("priority_score"), "path")


# Variables that tell five providers, and where each keeps the change.
PROVIDERS = (("GITHUB_ACTIONS", "github", "GITHUB_SHA", "GITHUB_REF"), ("GITLAB_CI", "gitlab", "CI_COMMIT_SHA", "CI_COMMIT_REF_NAME"), ("CIRCLECI", "circleci", "CIRCLE_SHA1", "CIRCLE_BRANCH"), ("TF_BUILD", "azure", "BUILD_SOURCEVERSION", "BUILD_SOURCEBRANCH"), ("JENKINS_URL", "jenkins", "GIT_COMMIT", "GIT_BRANCH"))


def ci_metadata(environment: dict[str, str]) -> dict[str, str | None]:
    """Provider, commit and ref of a run, from its environment; nulls where none is told."""
    for mark, name, sha, ref in PROVIDERS:
        if environment.get(mark):
            return {"provider": name, "commit_sha": environment.get(sha), "ref": environment.get(ref)}
    return {"provider": None, "commit_sha": None, "ref": None}
