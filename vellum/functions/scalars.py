"""Scalar functions and predicates as column expressions (survey P9, P10, F2, F5, F6, F8, S23, X5, X6, X10, X11, X15-X20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Account names, path parts and suffixes.
COPILOT_ACCOUNTS = ("copilot[bot]", "github-copilot[bot]", "app/copilot", "app/github-copilot")
GENERATED_PARTS = ("/fixtures/", "/testdata/", "/__snapshots__/", "vendor/", "thirdparty/")
GENERATED_ENDS = ("min.js", "min.css", "pb.go", "pb.rs")


def normal_path(path: Column) -> Column:
    """Forward slashes."""
    return F.translate(path, "\\", "/")


def automation_account(author: Column, known: tuple[str, ...] = ()) -> Column:
    """F8: app accounts, and those of a configured list whatever their case."""
    return author.startswith("app/") | author.endswith("[bot]") | F.lower(author).isin(*[k.lower() for k in known])


def agentic_actor(author: Column, body: Column | None = None) -> Column:
    """F8: an agent's own account, or its trailer in the description."""
    own = F.lower(author).isin(*COPILOT_ACCOUNTS)
    return own if body is None else own | F.coalesce(body.rlike(r"(?im)^co-authored-by:.*copilot"), F.lit(False))


def impersonation(author: Column, body: Column) -> Column:
    """F8: an agent's trailer under another account."""
    return agentic_actor(author, body) & ~agentic_actor(author)


def refactor(body: Column) -> Column:
    """F8: a change that its author marks as a refactoring."""
    return F.coalesce(body.contains("[REFACTOR]") | body.contains("[FIXES-DEBT]"), F.lit(False))


def generated_asset(path: Column) -> Column:
    """generated files, by place or compound extension."""
    out = F.lit(False)
    for part in GENERATED_PARTS:
        out = out | path.contains(part)
    for end in GENERATED_ENDS:
        out = out | path.endswith(end)
    return out


def glob_regex(glob: Column) -> Column:
    """A glob as an anchored regular expression; one star stays within a folder."""
    quoted = F.regexp_replace(glob, r"[.+^${}()|\[\]\\]", r"\\$0")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, r"\*\*", "\u0001"), r"\*", "[^/]*"), r"\?", "[^/]"), "\u0001", ".*"), F.lit("$"))


def human_bytes(n: Column) -> Column:
    """B, KB or MB with one decimal, ties to the even digit."""
    scaled = lambda unit, name: F.concat(F.format_string("%.1f", F.bround(n / float(unit), 1)), F.lit(f" {name}"))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, scaled(1 << 10, "KB")).otherwise(scaled(1 << 20, "MB"))


def decoded(payload: Column) -> Column:
    """X11: a base64 or hexadecimal payload of up to 4 KiB as text, null where it is neither."""
    short = F.length(payload) <= 4096
    hexadecimal = payload.rlike("^(?:[0-9A-Fa-f]{2})+$")
    base64 = payload.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$") & (F.length(payload) > 0)
    raw = F.when(short & hexadecimal, F.unhex(payload)).when(short & base64, F.unbase64(payload))
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))


# Domains and the path parts that tell them.
FIRST_PARTY, VENDORED, TEST = 1, 2, 4
VENDORED_PARTS = ("/vendor/", "/thirdparty/", "/third_party/", "/node_modules/", "/external/", "/deps/", "/Pods/", "/Carthage/")
TEST_PARTS = ("/test/", "/tests/", "/spec/", "/specs/", "_test.", "_spec.", "/testdata/", "/fixtures/", "/__tests__/", ".test.", ".spec.")


def domain(path: Column) -> Column:
    """The domain of a path; vendored code before tests before one's own."""
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    anywhere = lambda parts: F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: rooted.contains(p))
    return F.when(anywhere(VENDORED_PARTS), VENDORED).when(anywhere(TEST_PARTS), TEST).otherwise(FIRST_PARTY)


def routed(finding_domain: Column, file_domain: Column, severity: Column) -> Column:
    """a finding counts where its domains include the file's, in tests only if it is severe."""
    severe = severity.isin("KevCritical", "Critical", "Exhaustion")
    return (finding_domain.bitwiseAND(file_domain) != 0) & ((file_domain != TEST) | severe)


# Names and extensions of surfaces.
SURFACE_NAMES = {"Dockerfile": "dockerfile", "CMakeLists.txt": "cmake", "BUILD": "bzl", "WORKSPACE": "bzl", "MODULE.bazel": "bzl"}
SURFACES = {
    "py": "py", "rs": "rs", "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "h": "cpp", "hpp": "cpp", "c": "cpp", "java": "java", "cs": "cs", "go": "go", "js": "js", "mjs": "js", "cjs": "js",
    "jsx": "jsx", "ts": "ts", "tsx": "tsx", "glsl": "glsl", "vert": "glsl", "frag": "glsl", "scala": "scala", "sh": "sh", "bash": "sh", "cmd": "cmd", "zsh": "zsh", "m": "m", "mm": "mm",
    "rb": "rb", "php": "php", "swift": "swift", "lua": "lua", "nix": "nix", "gd": "gd", "tf": "tf", "hcl": "hcl", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "xml": "xml",
    "proto": "proto", "bzl": "bzl", "mod": "mod", "go-version": "go-version", "properties": "properties", "env": "env", "bat": "bat", "ps1": "ps1", "patch": "patch",
    "permitted-images": "permitted-images", "csv": "csv", "md": "md", "rst": "rst", "lock": "lock", "svg": "svg", "map": "map",
}
MEBI = 1 << 20
#: Largest file, largest file of a deep scan, largest patch.
FILE_BYTES, DEEP_BYTES, PATCH_BYTES = MEBI, 32 * MEBI, 64 << 10
# Endings of files that hold no text.
BINARY_ENDS = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".pdf", ".zip", ".gz", ".tar", ".tgz", ".bz2", ".xz", ".7z", ".jar", ".war", ".class", ".so", ".dll", ".dylib", ".exe", ".o",
    ".a", ".wasm", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".mp3", ".mp4", ".avi", ".mov", ".wav",
)


def surface(path: Column) -> Column:
    """The surface of a path: by file name, then by extension; empty when unknown."""
    name = F.element_at(F.split(normal_path(path), "/"), -1)
    table = lambda d: F.create_map(*[F.lit(x) for p in d.items() for x in p])
    extension = F.regexp_extract(name, r".\.([^.]+)$", 1)
    return F.coalesce(F.try_element_at(table(SURFACE_NAMES), name), F.when(name.startswith("BUILD."), "bzl"), F.try_element_at(table(SURFACES), extension), F.lit(""))


def scannable(path: Column, size: Column, deep: bool = False) -> Column:
    """neither a binary asset nor larger than scans read."""
    out = size <= (DEEP_BYTES if deep else FILE_BYTES)
    for end in BINARY_ENDS:
        out = out & ~F.lower(path).endswith(end)
    return out


def byte_length(start: Column, end: Column) -> Column:
    """P10: the length of a span, never below 0."""
    return F.greatest(end - start, F.lit(0))


def expired(stamp: Column, now: Column) -> Column:
    """Whether an expiry (a day, or a time with zone) is not after now; one that does not parse has expired."""
    when = F.coalesce(F.try_to_timestamp(stamp), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd")))
    return F.coalesce(when <= now, F.lit(True))


def humanised(label: Column) -> Column:
    """A label for people: what follows its last colon, underscores as spaces, first letter large."""
    words = F.translate(F.element_at(F.split(label, ":"), -1), "_", " ")
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words)))


def latex_safe(text: Column) -> Column:
    """Characters that LaTeX reads as markup, escaped."""
    return F.regexp_replace(F.regexp_replace(text, r"([&%$#_{}])", r"\\$1"), r"[\^~]", "-")


def html_escaped(text: Column) -> Column:
    """The five characters of HTML markup as references."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for c, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(c), F.lit(name))
    return out


def shortened(text: Column, most: int) -> Column:
    """A text of `most` characters at most, the last one an ellipsis where it was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def line_count(text: Column) -> Column:
    """Lines of a text; a last line without an end counts."""
    return F.regexp_count(text, F.lit("\n")) + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)


def rule_class(rule: Column) -> Column:
    """The class of a rule, without what tells where it fired."""
    return F.lower(F.regexp_extract(rule, r"^([A-Za-z0-9_]+:[A-Za-z0-9_]+)", 1))


def hop(name: Column) -> Column:
    """A step of a flow without names: what it does, not what it is called."""
    low = F.lower(name)
    return (
        F.when(low.rlike("sanit|escape|encode|valid"), "sanitizer")
        .when(low.rlike("request|param|input|query|body|header|argv|env"), "source")
        .when(low.rlike("exec|eval|system|query|write|send|render"), "sink")
        .otherwise("call")
    )


def flow_signature(rule: Column, hops: Column) -> Column:
    """A digest of a rule's class and the kinds of its hops, equal wherever the same flow is found."""
    return F.sha2(F.concat_ws("->", rule_class(rule), F.transform(hops, hop)), 256)


def workers(ram_gib: Column, cores: Column) -> Column:
    """How many workers a machine of so much memory runs."""
    return F.when(ram_gib <= 8, F.least(cores, F.lit(2))).when(ram_gib <= 16, F.least(cores, F.lit(4))).when(ram_gib <= 32, F.least(cores, F.lit(8))).otherwise(cores)


def iso_time(seconds: Column) -> Column:
    """Seconds since 1970 as a time in UTC, whatever the session's zone."""
    return F.date_format(F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def deobfuscated(payload: Column, layers: int = 3) -> Column:
    """X11: a payload without its wrapping: quoted pieces joined by plus signs, a decoder call around it, an array of hexadecimal numbers, base64 or hexadecimal digits, up to some layers."""
    out = payload
    for _ in range(layers):
        joined = F.regexp_replace(out, r"[\"']\s*\+\s*[\"']", "")
        inner = F.regexp_extract(joined, r"^\s*(?:[\w.]+\()*\s*[\"']([^\"']*)[\"']", 1)
        text = F.when(inner != "", inner).otherwise(joined)
        codes = F.regexp_extract_all(text, F.lit(r"0x([0-9A-Fa-f]{2})\b"), F.lit(1))
        array = F.when(F.size(codes) > 1, F.decode(F.unhex(F.array_join(codes, "")), "UTF-8"))
        out = F.coalesce(array, decoded(text), text)
    return out
