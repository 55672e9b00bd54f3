"""Source files as tokens: entities, structural hashes, imports, calls (survey S21, S22, X7-X9, X12, A8, A12, A20, W3, F15, F16, J3, J4, J10, D93, D94, E6).

No grammar library is at hand, so a small lexer knows comments, strings, numbers, names
and brackets of each language, and a table of patterns knows how definitions begin.  A
body ends with its closing bracket, its indentation, or its ``end``.  Parsing is the one
thing here that plans cannot express; it runs file by file over Arrow batches, and what
it yields are tables.

Structural hashes drop identifiers, strings and comments and keep the rest in order, so
a renamed copy hashes as the original and another operator does not.

Defined results: a file of no known language, an empty or null file gives no rows; text
that is no valid program gives what could be read of it; nested definitions are named
with their outer ones, joined by dots.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SURFACES


@dataclass(frozen=True)
class Language:
    line: tuple[str, ...]  # comments to the end of the line
    block: tuple[str, str] | None
    body: str  # brace, indent or end
    define: str  # pattern of a definition, groups kind and name; its parameters follow
    bring: str = ""  # pattern of an import, group module
    quotes: str = "\"'"


_C_LINE, _C_BLOCK = ("//",), ("/*", "*/")
_CALLED = r"(?P<name>[A-Za-z_$][\w$]*)"
# A function of the C family: a return type, a name, parameters and an opening brace.
_C_FUNCTION = r"^[ \t]*(?:(?P<kind>class|struct|interface|enum|namespace)\s+(?P<type>\w+)|(?:[\w:<>,*&\[\]@]+\s+)+[*&]*(?P<name>~?[A-Za-z_]\w*(?:::~?\w+)*))\s*(?=\([^;{}]*\)[^;{}=]*\{|[^;()=]*\{)"
LANGUAGES: dict[str, Language] = {
    "py": Language(("#",), None, "indent", r"^[ \t]*(?:async\s+)?(?P<kind>def|class)\s+" + _CALLED, r"^[ \t]*(?:from\s+(?P<module>[\w.]+)\s+import|import\s+(?P<module2>[\w.]+))"),
    "gd": Language(("#",), None, "indent", r"^[ \t]*(?:static\s+)?(?P<kind>func|class)\s+" + _CALLED, r"preload\(\"(?P<module>[^\"]+)\"\)"),
    "rs": Language(_C_LINE, _C_BLOCK, "brace", r"\b(?P<kind>fn|struct|enum|trait|impl|mod)\s+(?:<[^>]*>\s*)?" + _CALLED, r"\buse\s+(?P<module>[\w:]+)", "\""),
    "js": Language(_C_LINE, _C_BLOCK, "brace", r"\b(?P<kind>function|class)\s*\*?\s*" + _CALLED + r"|\b(?:const|let|var)\s+(?P<arrow>[A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?=\([^()]*\)\s*=>|\w+\s*=>|function)|^[ \t]+(?:async\s+|static\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(?P<method>[A-Za-z_$][\w$]*)\s*(?=\([^()]*\)\s*\{)", r"(?:import\s[^;\n]*?from\s*|import\s*|require\()\s*[\"'](?P<module>[^\"']+)[\"']", "\"'`"),
    "go": Language(_C_LINE, _C_BLOCK, "brace", r"\b(?P<kind>func|type)\s+(?:\([^)]*\)\s*)?" + _CALLED, r"^\s*(?:import\s+)?(?:\w+\s+)?\"(?P<module>[\w./-]+)\"\s*$", "\"`"),
    "java": Language(_C_LINE, _C_BLOCK, "brace", _C_FUNCTION, r"^\s*import\s+(?:static\s+)?(?P<module>[\w.]+)"),
    "cs": Language(_C_LINE, _C_BLOCK, "brace", _C_FUNCTION, r"^\s*using\s+(?P<module>[\w.]+)\s*;"),
    "cpp": Language(_C_LINE, _C_BLOCK, "brace", _C_FUNCTION, r"^\s*#\s*include\s*[<\"](?P<module>[^>\"]+)[>\"]"),
    "glsl": Language(_C_LINE, _C_BLOCK, "brace", _C_FUNCTION, r"^\s*#\s*include\s*[<\"](?P<module>[^>\"]+)[>\"]"),
    "m": Language(_C_LINE, _C_BLOCK, "brace", r"^[-+]\s*\([^)]*\)\s*" + _CALLED + r"|^@(?P<kind>implementation|interface)\s+(?P<type>\w+)|" + _C_FUNCTION.replace("kind>", "kind2>").replace("type>", "type2>").replace("name>", "name2>"), r"^\s*#\s*import\s*[<\"](?P<module>[^>\"]+)[>\"]"),
    "kt": Language(_C_LINE, _C_BLOCK, "brace", r"\b(?P<kind>fun|class|object|interface)\s+(?:<[^>]*>\s*)?(?:\w+\.)?" + _CALLED, r"^\s*import\s+(?P<module>[\w.]+)"),
    "scala": Language(_C_LINE, _C_BLOCK, "brace", r"\b(?P<kind>def|class|object|trait)\s+" + _CALLED, r"^\s*import\s+(?P<module>[\w.]+)"),
    "swift": Language(_C_LINE, _C_BLOCK, "brace", r"\b(?P<kind>func|class|struct|enum|protocol|extension)\s+" + _CALLED, r"^\s*import\s+(?P<module>\w+)", "\""),
    "zig": Language(_C_LINE, None, "brace", r"\b(?P<kind>fn)\s+" + _CALLED, r"@import\(\"(?P<module>[^\"]+)\"\)", "\""),
    "sol": Language(_C_LINE, _C_BLOCK, "brace", r"\b(?P<kind>function|contract|interface|library|modifier)\s+" + _CALLED, r"import\s[^;\n]*\"(?P<module>[^\"]+)\""),
    "php": Language(("//", "#"), _C_BLOCK, "brace", r"\b(?P<kind>function|class|interface|trait)\s+&?" + _CALLED, r"^\s*use\s+(?P<module>[\w\\]+)"),
    "rb": Language(("#",), None, "end", r"^[ \t]*(?P<kind>def|class|module)\s+(?:self\.)?" + _CALLED, r"\brequire(?:_relative)?\s*\(?[\"'](?P<module>[^\"']+)[\"']"),
    "lua": Language(("--",), ("--[[", "]]"), "end", r"\b(?P<kind>function)\s+(?:\w+[.:])*" + _CALLED, r"\brequire\s*\(?[\"'](?P<module>[^\"']+)[\"']"),
    "sh": Language(("#",), None, "brace", r"^[ \t]*(?:(?P<kind>function)\s+)?(?P<name>[\w-]+)\s*(?=\(\)\s*\{)", r"^\s*(?:source|\.)\s+(?P<module>\S+)"),
    "nix": Language(("#",), ("/*", "*/"), "brace", r"^[ \t]*(?P<name>[\w-]+)\s*=\s*(?=\{[^}=]*\}\s*:|\w+\s*:)", r"\bimport\s+(?P<module>[./\w-]+)", "\""),
}
_ALIASES = {"jsx": "js", "ts": "js", "tsx": "js", "mm": "m", "kts": "kt"}
#: Surfaces whose extension names no language of its own there.
_EXTENSIONS = {"kt": "kt", "kts": "kt", "zig": "zig", "sol": "sol"}
_OPEN, _CLOSE = "([{", ")]}"
_ENDS = re.compile(r"\b(?:def|class|module|do|if|unless|while|until|for|case|begin|function|then|repeat|end)\b")


def language_of(path: str) -> str | None:
    """The language of a file by its extension, as `LANGUAGES` names it."""
    base = path.replace("\\", "/").rsplit("/", 1)[-1]
    ext = base.rsplit(".", 1)[-1].lower() if "." in base else ""
    key = _EXTENSIONS.get(ext) or SURFACES.get(ext, "")
    key = _ALIASES.get(key, key)
    return key if key in LANGUAGES else None


@functools.cache
def _lexer(lang: str) -> re.Pattern:
    spec = LANGUAGES[lang]
    parts = []
    if spec.block:
        parts.append("(?P<block>" + re.escape(spec.block[0]) + r".*?(?:" + re.escape(spec.block[1]) + r"|\Z))")
    parts.append("(?P<line>(?:" + "|".join(map(re.escape, spec.line)) + r")[^\n]*)")
    if lang == "py":
        parts.append(r"(?P<long>[rbfRBF]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)))")
    strings = "|".join(rf"{q}(?:[^{q}\\]|\\.)*(?:{q}|\Z)" if q == "`" else rf"{q}(?:[^{q}\\\n]|\\.)*(?:{q}|(?=\n)|\Z)" for q in spec.quotes)
    parts.append(f"(?P<string>{strings})")
    parts += [r"(?P<number>\d[\w.]*)", r"(?P<word>[A-Za-z_$][\w$]*)", r"(?P<space>\s+)", r"(?P<op>=>|->|::|&&|\|\||[-+*/%&|^<>=!]=|<<|>>|.)"]
    return re.compile("|".join(parts), re.S)


# Words that are no identifiers, of all the languages together.
KEYWORDS = frozenset(
    "and as assert async await break case catch class const continue def default defer del delete do elif else elsif end ensure enum except export extends false finally fn for foreach from func function global go goto guard if impl import in inline instanceof interface is lambda let loop match mod module move mut namespace new nil none nonlocal not null or pass private protected public raise repeat rescue return self static struct super switch template then this throw throws trait true try type typedef typeof unless until use using var virtual void volatile when where while with yield None True False".split()
)


#: Words before brackets that define nothing.
_CONTROL = frozenset("if for while switch return catch else do new case elif unless until with match loop sizeof throw defined function func fun fn def type import var and or not in is await".split())


@dataclass
class Token:
    kind: str  # word, number, string, op, comment
    text: str
    start: int


def tokenize(source: str, lang: str) -> list[Token]:
    out = []
    for m in _lexer(lang).finditer(source):
        kind = m.lastgroup
        if kind == "space":
            continue
        kind = {"block": "comment", "line": "comment", "long": "string"}.get(kind, kind)
        out.append(Token(kind, m[0], m.start()))
    return out


def blanked(source: str, lang: str, strings: bool = False) -> str:
    """The source with comments (and strings) as spaces, so places stay where they are."""
    def blank(m: re.Match) -> str:
        gone = m.lastgroup in ("block", "line") or strings and m.lastgroup in ("string", "long")
        return re.sub(r"[^\n]", " ", m[0]) if gone else m[0]

    return _lexer(lang).sub(blank, source)


@dataclass
class Entity:
    kind: str
    name: str
    qualified: str
    start: int  # of the definition
    body: int  # where its body begins
    end: int
    params: list[str]


def _end_of(code: str, at: int, style: str, start: int) -> tuple[int, int]:
    """Where the body of a definition begins and ends; code has no comments and strings."""
    if style == "indent":
        line = code.rfind("\n", 0, start) + 1
        deep = len(code[line:]) - len(code[line:].lstrip(" \t"))
        head = _closing(code, at) if at < len(code) and code[at] == "(" else at
        body = code.find("\n", max(head, at))
        body = len(code) if body < 0 else body + 1
        end = body
        for m in re.finditer(r"[^\n]*\n?", code[body:]):
            text = m[0]
            if not text:
                break
            if text.strip():
                if len(text) - len(text.lstrip(" \t")) <= deep:
                    break
                end = body + m.end()
        return body, max(end, body)
    if style == "end":
        depth, pos = 1, at
        for m in _ENDS.finditer(code, at):
            word = m[0]
            if word == "end":
                depth -= 1
                if not depth:
                    return at, m.end()
            elif word in ("if", "unless", "while", "until") and code[code.rfind("\n", 0, m.start()) + 1 : m.start()].strip():
                continue  # a modifier at the end of a line
            elif word not in ("then", "repeat") and not (word == "do" and re.search(r"\b(?:while|until|for)\b", code[code.rfind("\n", 0, m.start()) + 1 : m.start()])):
                depth += 1
            pos = m.end()
        return at, max(pos, len(code))
    brace = code.find("{", at)
    if brace < 0:
        return at, at
    return brace, _closing(code, brace)


def _closing(code: str, at: int) -> int:
    """One past the bracket that closes the one at a place."""
    depth = 0
    for m in re.compile(r"[(\[{}\])]").finditer(code, at):
        depth += 1 if m[0] in _OPEN else -1
        if depth <= 0:
            return m.end()
    return len(code)


def _params(code: str, at: int) -> list[str]:
    """Names of the parameters in the brackets that follow a place."""
    m = re.compile(r"\s*(?:<[^>(]*>)?\s*\(").match(code, at)
    if not m:
        return []
    inner = code[m.end() : _closing(code, m.end() - 1) - 1]
    out = []
    for part in re.split(r",(?![^<(\[]*[>)\]])", inner):
        part = re.sub(r"=.*", "", part, flags=re.S).strip()
        if ":" in part:  # name: type
            part = part.split(":")[0]
        names = re.findall(r"[A-Za-z_$][\w$]*", part)
        if names:
            typed = len(names) > 1 and ":" not in part
            out.append(names[-1] if typed else names[0])
    return out


def entities(source: str, lang: str) -> list[Entity]:
    """Definitions of a file, outer before inner."""
    spec, code = LANGUAGES[lang], blanked(source, lang, strings=True)
    found = []
    for m in re.finditer(spec.define, code, re.M):
        g = m.groupdict()
        name = next((g[k] for k in ("name", "arrow", "method", "type", "name2", "type2") if g.get(k)), None)
        if not name or name in _CONTROL:
            continue
        word = g.get("kind") or g.get("kind2") or "function"
        kind = "class" if word in ("class", "struct", "enum", "trait", "interface", "object", "type", "contract", "library", "protocol", "extension", "impl", "namespace", "implementation", "module", "mod") else "function"
        body, end = _end_of(code, m.end(), spec.body, m.start())
        params = _params(code, m.end()) if kind == "function" else []
        if lang == "go" and kind == "function":  # names before types, shared by several
            params = [re.findall(r"\w+", p)[0] for p in code[m.end() :].partition("(")[2].partition(")")[0].split(",") if re.findall(r"\w+", p)]
        if lang == "m" and kind == "function" and ":" in code[m.start() : body]:
            params = re.findall(r":\s*\([^)]*\)\s*(\w+)", code[m.start() : body])
        if lang == "nix":  # an argument or a set of them, then a colon, then the body
            head = re.compile(r"\s*=\s*(?:\{([^}]*)\}|(\w+))\s*:").match(code, m.end("name"))
            params = re.findall(r"[A-Za-z_][\w-]*", head[1] or head[2] or "") if head else []
            body = head.end() if head else body
            stop = re.compile(r";[ \t]*(?:\n|\Z)").search(code, body)
            end = stop.end() if stop else len(code)
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        found.append(Entity(kind, name, name, begin, body, max(end, body), params))
    open_: list[Entity] = []
    for e in found:
        while open_ and open_[-1].end <= e.start:
            open_.pop()
        e.qualified = ".".join([o.name for o in open_] + [e.name])
        open_.append(e)
    return found


# --- hashes -----------------------------------------------------------------------


def _hash(data: bytes) -> int:
    """The first 8 bytes of a SHA-256 as a signed long."""
    return int.from_bytes(hashlib.sha256(data).digest()[:8], "little", signed=True)


def _shape(tokens: list[Token], numbers: bool = True) -> list[str]:
    """Tokens by kind: identifiers, strings and comments dropped, numbers alike."""
    return [("#" if t.kind == "number" else t.text) for t in tokens if t.kind == "op" or (t.kind == "number" and numbers) or (t.kind == "word" and t.text in KEYWORDS)]


def structural_hash(tokens: list[Token]) -> int:
    """Equal for bodies of equal control flow and operators, whatever their names; 0 for none."""
    shape = _shape(tokens)
    return _hash("\n".join(shape).encode()) if shape else 0


def topology_hash(tokens: list[Token]) -> int:
    """Like the structure, but every name, string and number counts as one of its kind."""
    return _hash("\n".join(t.text if t.kind == "op" or t.text in KEYWORDS else t.kind for t in tokens if t.kind != "comment").encode())


#: Fewer tokens than these make no, or a unique, SimHash.
LEAST_TOKENS, TRIVIAL_TOKENS = 5, 7


def simhash(tokens: list[Token], start: int) -> int | None:
    """Votes of (token, depth) features; none under 5 structural tokens, one of its own for trivial bodies."""
    depth, features = 0, []
    for t in tokens:
        if t.kind in ("op", "word") and (t.kind == "op" or t.text in KEYWORDS):
            depth -= t.text in _CLOSE
            features.append((t.text, depth))
            depth += t.text in _OPEN
    if len(features) < LEAST_TOKENS:
        return None
    if len(features) < TRIVIAL_TOKENS:
        value = (start * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    else:
        votes = [0] * 64
        for text, deep in features:
            h = _hash(f"{text}\0{deep}".encode())
            for k in range(64):
                votes[k] += 1 if h >> k & 1 else -1
        value = sum(1 << k for k in range(64) if votes[k] > 0)
    return value - (1 << 64) if value >> 63 else value


def semantic_null(old: str, new: str, lang: str) -> bool:
    """Whether two versions of a file differ in names, strings, comments and layout only."""
    skeletons = [_shape(tokenize(s, lang)) for s in (old, new)]
    balanced = all(_balanced(s) for s in skeletons)
    return balanced and skeletons[0] == skeletons[1]


def _balanced(shape: list[str]) -> bool:
    """A file whose brackets do not pair is no valid program; it is never a semantic null."""
    stack = []
    for t in shape:
        if t in _OPEN:
            stack.append(t)
        elif t in _CLOSE and (not stack or _OPEN.index(stack.pop()) != _CLOSE.index(t)):
            return False
    return not stack


def folded(expression: str, depth: int = 10, most: int = 4096) -> str | None:
    """The string that a chain of quoted strings and plus signs makes, up to a depth and a size; null for any other expression."""
    pieces = re.findall(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|([+()])|(\S)", expression)
    out, level = "", 0
    for a, b, sign, other in pieces:
        if other:
            return None
        level += (sign == "(") - (sign == ")")
        if level > depth:
            return None
        out += a or b
    return out if len(out) <= most else None


# --- tables -----------------------------------------------------------------------

ENTITIES = "path string, kind string, name string, qualified_name string, params array<string>, start long, end long, start_line int, end_line int, structural_hash long, topology_hash long, simhash long"


def _rows(batches: Iterator[pa.RecordBatch], make, schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    names, types = zip(*((c.split()[0], kinds[c.split(" ", 1)[1]]) for c in schema.split(", ")), strict=True)
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            text = content.decode("utf-8", "replace") if isinstance(content, bytes) else content
            if path and text:
                rows += make(path, text)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=list(names))


def per_file(files: DataFrame, make, schema: str) -> DataFrame:
    """The rows that a function of path and text yields for each file."""
    return files.select("path", "content").mapInArrow(functools.partial(_rows, make=make, schema=schema), schema)


def _entity_rows(path: str, text: str) -> list[tuple]:
    lang = language_of(path)
    out = []
    for e in entities(text, lang) if lang else ():
        tokens = tokenize(text[e.body : e.end], lang)
        line = text.count("\n", 0, e.start) + 1
        out.append((path, e.kind, e.name, e.qualified, e.params, e.start, e.end, line, line + text.count("\n", e.start, max(e.start, e.end - 1)), structural_hash(tokens), topology_hash(tokens), simhash(tokens, e.body)))
    return out


def entity_table(files: DataFrame) -> DataFrame:
    """Definitions of the files (path, content) of every language, with their places and hashes."""
    return per_file(files, _entity_rows, ENTITIES)


def _call_rows(path: str, text: str) -> list[tuple]:
    lang = language_of(path)
    if not lang:
        return []
    code = blanked(text, lang, strings=True)
    heads = ((e.start, re.search(rf"\b{re.escape(e.name)}\b", text[e.start : max(e.body, e.start + 1)])) for e in entities(text, lang))
    defined = {start + m.start() for start, m in heads if m}
    return [(path, m[1], m.start(1), text.count("\n", 0, m.start()) + 1) for m in re.finditer(r"([A-Za-z_$][\w$]*)\s*\(", code) if m[1] not in _CONTROL and m.start(1) not in defined]


def call_sites(files: DataFrame) -> DataFrame:
    """Calls by name: path, callee, pos, line."""
    return per_file(files, _call_rows, "path string, callee string, pos long, line int")


def _import_rows(path: str, text: str) -> list[tuple]:
    lang = language_of(path)
    if not lang or not LANGUAGES[lang].bring:
        return []
    code = blanked(text, lang)
    out = []
    for m in re.finditer(LANGUAGES[lang].bring, code, re.M):
        module = m.group("module") or m.groupdict().get("module2")
        names = re.match(r"[ \t]*\(?([\w, \t]+)", code[m.end() :]) if lang == "py" and m.group("module") else None
        out += [(path, lang, module, n.strip()) for n in (names[1].split(",") if names else [""])]
    return out


def imports(files: DataFrame) -> DataFrame:
    """What files import: path, lang, module, name (empty where the whole module is meant)."""
    return per_file(files, _import_rows, "path string, lang string, module string, name string")


def resolved_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """The file that each import means: (path, module, name, target); candidates by kind of path, the first that exists.

    A module's candidates are a few paths, so resolution is an equality join on them.
    """
    folder = F.regexp_replace("path", "[^/]*$", "")
    dotted = F.regexp_replace(F.regexp_replace("module", r"^\.+", ""), r"\.|::", "/")
    here = F.when(F.col("module").startswith("."), folder).otherwise(F.lit(""))
    python = F.array(F.concat(here, dotted, F.lit(".py")), F.concat(here, dotted, F.lit("/__init__.py")), F.concat(folder, dotted, F.lit(".py")))
    relative = F.concat(folder, F.regexp_replace("module", r"^\./", ""))
    script = F.array(relative, *[F.concat(relative, F.lit(e)) for e in (".js", ".ts", ".tsx", ".jsx", "/index.js", "/index.ts")])
    other = F.array(relative, F.col("module"), F.concat(dotted, F.lit(".java")), F.concat(F.lit("include/"), "module"))
    candidates = F.when(F.col("lang") == "py", python).when(F.col("lang") == "js", script).otherwise(other)
    each = found.select("path", "module", "name", F.posexplode(candidates).alias("priority", "target"))
    hit = each.join(files.select(F.col("path").alias("target")).distinct(), "target")
    return hit.groupBy("path", "module", "name").agg(F.min_by("target", "priority").alias("target"))


def enclosing(sites: DataFrame, spans: DataFrame, pos: str = "pos") -> DataFrame:
    """Each place with the innermost span (path, start, end, qualified_name) that holds it; places outside of all have null.

    Spans of a file nest, so the innermost is the last that began and has not ended: the
    events of a file in order, not a join of all spans with all places.
    """
    own = [c for c in sites.columns if c != "path"]
    places = sites.select("path", F.col(pos).alias("_at"), F.lit(2).alias("_kind"), F.struct(*own).alias("_site"), F.lit(None).cast("string").alias("_name"), F.lit(None).cast("long").alias("_end"))
    none = F.lit(None).cast(places.schema["_site"].dataType)
    begins = spans.select("path", F.col("start").alias("_at"), F.lit(1).alias("_kind"), none.alias("_site"), F.col("qualified_name").alias("_name"), F.col("end").alias("_end"))
    order = Window.partitionBy("path").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    events = places.unionByName(begins).withColumn("_open", F.collect_list(F.when(F.col("_kind") == 1, F.struct("_at", "_end", "_name"))).over(order))
    inner = F.filter("_open", lambda s: s["_end"] > F.col("_at"))
    name = F.when(F.size(inner) > 0, F.element_at(inner, -1)["_name"])
    return events.where("_kind = 2").select("path", "_site.*", name.alias("enclosing"))


def call_edges(files: DataFrame) -> DataFrame:
    """(src_path, caller, dst_path, callee): calls resolved in their own file, then through its imports; the caller is the innermost definition around the call."""
    defined = entity_table(files).where("kind = 'function'").select("path", "name", "qualified_name", "start", "end")
    sites = enclosing(call_sites(files), defined)
    own = sites.join(defined.select("path", F.col("name").alias("callee"), F.col("qualified_name").alias("target")), ["path", "callee"]).select(F.col("path").alias("src_path"), "enclosing", F.col("path").alias("dst_path"), "target")
    brought = resolved_imports(imports(files), files)
    named = sites.join(defined.select("path", F.col("name").alias("callee")).distinct(), ["path", "callee"], "left_anti")
    there = defined.select(F.col("path").alias("target"), F.col("name").alias("callee"), F.col("qualified_name").alias("found"))
    through = named.join(brought.select("path", "name", "target").distinct(), "path").where("name = '' OR name = callee").join(there, ["target", "callee"]).select(F.col("path").alias("src_path"), "enclosing", F.col("target").alias("dst_path"), F.col("found").alias("target"))
    return own.unionByName(through).select("src_path", F.col("enclosing").alias("caller"), "dst_path", F.col("target").alias("callee")).where("caller IS NOT NULL").distinct()


def boilerplate(entity_rows: DataFrame, over: int = 5) -> DataFrame:
    """Files in which more than `over` functions share a topology: path, n of the largest group."""
    groups = entity_rows.where("kind = 'function'").groupBy("path", "topology_hash").agg(F.count("*").alias("n"))
    return groups.groupBy("path").agg(F.max("n").alias("n")).where(F.col("n") > over)


def patch_clones(functions: DataFrame, net: DataFrame, global_clones: DataFrame | None = None) -> DataFrame:
    """Clones of each patch: one less than each group of equal structure, pairs in the zombie band (0.85 to 0.95 of the bits), and clones of the whole project; none where a patch deletes more than twice what it adds.

    functions: patch_id, path, structural_hash, simhash; net: patch_id, added, deleted;
    global_clones: patch_id, n.  Pairs are made within one file of one patch.
    """
    exact = functions.where("structural_hash != 0").groupBy("patch_id", "path", "structural_hash").agg((F.count("*") - 1).alias("n")).groupBy("patch_id").agg(F.sum("n").alias("exact"))
    one = functions.where("simhash IS NOT NULL").groupBy("patch_id", "path", "simhash").agg(F.count("*").alias("c"), F.min("structural_hash").alias("h"))
    listed = one.groupBy("patch_id", "path").agg(F.sort_array(F.collect_list(F.struct("simhash", "c", "h"))).alias("m"))
    near = F.expr("aggregate(transform(m, (x, i) -> aggregate(slice(m, i + 2, size(m)), 0L, (a, y) -> a + if(x.h != y.h AND 1 - bit_count(x.simhash ^ y.simhash) / 64 > 0.85 AND 1 - bit_count(x.simhash ^ y.simhash) / 64 <= 0.95, x.c * y.c, 0L))), 0L, (a, b) -> a + b)")
    pairs = listed.select("patch_id", near.alias("n")).groupBy("patch_id").agg(F.sum("n").alias("zombie"))
    out = net.join(exact, "patch_id", "left").join(pairs, "patch_id", "left")
    if global_clones is not None:
        out = out.join(global_clones.select("patch_id", F.col("n").alias("everywhere")), "patch_id", "left")
    else:
        out = out.withColumn("everywhere", F.lit(0).cast("long"))
    total = F.coalesce("exact", F.lit(0)) + F.coalesce("zombie", F.lit(0)) + F.coalesce("everywhere", F.lit(0))
    return out.select("patch_id", F.when(F.col("deleted") > 2 * F.col("added"), 0).otherwise(total).cast("long").alias("logic_clones_found"))


def added_ranges(patch: str) -> Column:
    """(path, first, last) of the runs of lines that a patch (a column's name) adds, numbered as in the new file."""
    runs = "array<struct<path:string,first:int,last:int>>"
    return F.expr(f"""aggregate(split(`{patch}`, '\n'), struct(cast('' AS string) AS path, 0 AS at, cast(array() AS {runs}) AS out), (a, x) -> CASE
        WHEN startswith(x, '+++ ') THEN struct(regexp_replace(substring(x, 5), '^b/', '') AS path, 0 AS at, a.out AS out)
        WHEN startswith(x, '@@') THEN struct(a.path AS path, coalesce(try_cast(regexp_extract(x, '[+]([0-9]+)', 1) AS int), 1) AS at, a.out AS out)
        WHEN startswith(x, '+') AND size(a.out) > 0 AND try_element_at(a.out, -1).path = a.path AND try_element_at(a.out, -1).last = a.at - 1
          THEN struct(a.path AS path, a.at + 1 AS at, concat(slice(a.out, 1, size(a.out) - 1), array(struct(a.path AS path, try_element_at(a.out, -1).first AS first, a.at AS last))) AS out)
        WHEN startswith(x, '+') THEN struct(a.path AS path, a.at + 1 AS at, concat(a.out, array(struct(a.path AS path, a.at AS first, a.at AS last))) AS out)
        WHEN startswith(x, ' ') THEN struct(a.path AS path, a.at + 1 AS at, a.out AS out)
        ELSE a END, a -> a.out)""")


def mutated(entity_rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """The innermost definitions that added ranges (path, first, last) touch: path, qualified_name."""
    spans = entity_rows.select("path", "qualified_name", "start_line", "end_line")
    met = ranges.join(spans, "path").where("first <= end_line AND last >= start_line")
    inner = Window.partitionBy("path", "first", "last").orderBy(F.col("end_line") - F.col("start_line"), F.desc("start_line"), "qualified_name")
    return met.withColumn("_n", F.row_number().over(inner)).where("_n = 1").select("path", "qualified_name").distinct()
