"""Personal data by regular expressions, checksum validators and context words.

Everything here is DataFrame expressions; no Python runs on the executors.

A pattern proposes spans: splitting a text at its matches gives the gaps, extracting
gives the matches, and running sums of their lengths give places in code points.
Validators then confirm: parts of an address up to 255, Luhn for cards, mod-97 for
IBANs, digit counts.  A span's score starts from its kind's prior and rises if a
word of its kind's context stands within ``CONTEXT`` code points before it; kinds
that are ambiguous alone (13-digit cards, national ids) are kept only with context.

Base kinds are email, ip, card and phone, leftmost and non-overlapping within each
kind; a match that fails its validator is dropped and not tried again.  Further
kinds are iban (mod-97), card13 (13 digits, Luhn, context) and ssn (context).

Patterns are possessive where nothing follows, so that no input, however long its
runs of digits, makes the engine recurse or go back.

Defined results: a null or empty text has no spans; spans may overlap between
kinds and are all reported; ``redact`` replaces kinds one after another, in the
order of ``KINDS``, leaves null texts null, and leaves other columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import prefix

CONTEXT = 40

_LOCAL = "A-Za-z0-9._%+-"
#: kind -> pattern, cheap test that every text with a match passes, prior, context words.
KINDS = {
    # After \G (the end of the match before) or no character of the class: a start inside a run fails as the run's own start does.
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("contains", "@"), 0.9, "mail|contact|write"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", ("rlike", r"[0-9]\.[0-9]"), 0.6, "ip|host|server|address|login"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", ("rlike", r"(?:[0-9][\x20-]?){13}[0-9]"), 0.7, "card|visa|credit|payment|amex"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", ("contains", "+"), 0.7, "phone|tel|call|mobile|fax"),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", ("rlike", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), 0.9, "iban|bank|account"),
    "card13": (r"(?<![0-9][\x20-]|[0-9])[0-9](?:[\x20-]?[0-9])++", ("rlike", r"(?:[0-9][\x20-]?){12}[0-9]"), 0.3, "card|visa|credit|payment"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ("rlike", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), 0.3, "ssn|social|security"),
}
BASE = ("email", "ip", "card", "phone")
#: Kept when the score reaches this; base kinds always are.
LEAST = 0.5
BOOST = 0.3


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    figures = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    doubled = F.transform(figures, lambda c, i: F.when(i % 2 == 1, F.try_element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's remainder is 1: letters count 10 to 35, the first four characters go last."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    figures = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(a: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (a * F.when(v < 10, 10).otherwise(100) + v) % 97

    return F.aggregate(figures, F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.length(_digits(match))
    if kind == "ip":
        short = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(short, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.when(digits.between(14, 19), luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "card13":
        return F.when(digits == 13, luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return digits.between(10, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(match, " ", "")).between(15, 34), mod97(match)).otherwise(F.lit(False))
    return F.lit(True)


def _test(kind: str, text: Column) -> Column:
    how, what = KINDS[kind][1]
    return text.contains(what) if how == "contains" else text.rlike(what)


_SPAN = "struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>"


def _spans(kind: str, gaps: Column, matches: Column) -> Column:
    """Valid spans of a kind from the gaps between its matches (one more) and the matches."""
    _, _, prior, context = KINDS[kind]
    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("g"), m.alias("m"), F.length(g).cast("bigint").alias("lg"), F.length(m).cast("bigint").alias("lm")))
    # Places as running sums; an accumulator of (place, spans) keeps only the valid ones.
    near = lambda p: F.right(p["g"], F.lit(CONTEXT)).rlike(rf"(?i)\b(?:{context})")
    score = lambda p: F.round(F.lit(prior) + F.when(near(p), BOOST).otherwise(0.0), 3)
    keep = (lambda p: _valid(kind, p["m"])) if kind in BASE else (lambda p: _valid(kind, p["m"]) & (score(p) >= LEAST))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + p["lg"]
        end = start + p["lm"]
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.least(score(p), F.lit(1.0)).alias("score"), F.lit(kind in BASE).alias("base"))
        return F.struct(end.alias("at"), F.when(keep(p), F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.aggregate(pairs, start, step, lambda a: a["out"])


def _cut(df: DataFrame, text: str, kinds, own: str) -> DataFrame:
    """Adds, for each kind, m_kind and g_kind after the prefix: matches and gaps; empty unless the cheap test passes."""
    none = F.array().cast("array<string>")
    t = F.col(text)
    df = df.withColumns({f"{own}m_{k}": F.when(_test(k, t), F.regexp_extract_all(t, F.lit(KINDS[k][0]), F.lit(0))).otherwise(none) for k in kinds})
    return df.withColumns({f"{own}g_{k}": F.when(F.size(f"{own}m_{k}") > 0, F.split(t, KINDS[k][0], -1)).otherwise(none) for k in kinds})


def find(docs: DataFrame, text: str = "text", kinds=tuple(KINDS), into: str = "spans") -> DataFrame:
    """The input's columns with an array of spans (kind, start, end, score, base), by start and then kind as listed; places in code points, end exclusive."""
    names, own = [c for c in docs.columns if c != into], prefix(docs)
    df = docs.select(*names, F.coalesce(F.col(text), F.lit("")).alias(f"{own}t"))
    df = _cut(df, f"{own}t", kinds, own)
    found = F.concat(*(F.when(F.size(f"{own}m_{k}") > 0, _spans(k, F.col(f"{own}g_{k}"), F.col(f"{own}m_{k}"))).otherwise(F.array().cast(f"array<{_SPAN}>")) for k in kinds))
    df = df.select(*names, found.alias(f"{own}all"))
    order = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    ranked = F.sort_array(F.transform(f"{own}all", lambda s: F.struct(s["start"].alias("start"), order(s).alias("k"), s["end"].alias("end"), s.alias("span"))))
    return df.select(*names, F.when(F.size(f"{own}all") > 1, F.transform(ranked, lambda s: s["span"])).otherwise(F.col(f"{own}all")).alias(into))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", kinds=tuple(KINDS)) -> DataFrame:
    """The input with every span that `find` would keep replaced by its kind in brackets; rebuilt from gaps and matches, so in one pass for each kind."""
    names, own = docs.columns, prefix(docs)
    df = docs
    for kind in kinds:
        _, _, prior, context = KINDS[kind]
        df = df.withColumn(f"{own}t", F.coalesce(F.col(text), F.lit("")))
        df = _cut(df, f"{own}t", [kind], own)
        m, g = F.col(f"{own}m_{kind}"), F.col(f"{own}g_{kind}")
        near = lambda p: F.right(p, F.lit(CONTEXT)).rlike(rf"(?i)\b(?:{context})")  # noqa: B023, E731
        keep = lambda gap, match: _valid(kind, match) if kind in BASE else _valid(kind, match) & ((F.lit(prior) + F.when(near(gap), BOOST).otherwise(0.0)) >= LEAST)  # noqa: B023, E731
        parts = F.zip_with(F.slice(g, 1, F.size(m)), m, lambda gap, match: F.concat(gap, F.when(keep(gap, match), F.lit(f"[{kind.upper()}]")).otherwise(match)))  # noqa: B023
        rebuilt = F.concat(F.array_join(parts, ""), F.element_at(g, -1))
        df = df.select(*[F.when(F.size(m) > 0, rebuilt).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in names])
    return df
