"""Scans of text and bytes (survey X1-X3, W1, M2, M6, M10, S6-S8, W6, A23, F12, P15)."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import surface


def entropy_of_counts(counts: Column, n: Column) -> Column:
    """Bits a symbol from an array of counts that sum to n; 0 for none."""
    return F.when(n > 0, F.aggregate(counts, F.lit(0.0), lambda a, c: a - (c / n) * F.log2(c / n))).otherwise(0.0)


def _bits(counts: np.ndarray) -> np.ndarray:
    """Entropy of each row of counts, smallest count first so that equal counts give equal sums."""
    ordered = np.sort(counts, axis=1)
    share = ordered / np.maximum(ordered.sum(axis=1, keepdims=True), 1)
    return -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1) + 0.0


def _entropies(batches, into: str):
    for batch in batches:
        raw = batch.column(1).cast(pa.large_binary())
        counts = np.stack([np.bincount(np.frombuffer(v.as_buffer() if v.is_valid else b"", np.uint8), minlength=256) for v in raw]) if len(raw) else np.zeros((0, 256), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.sum(axis=1)), pa.array(_bits(counts))], names=[batch.schema.names[0], "n_bytes", into])


def byte_entropy(df: DataFrame, key: str, content: Column, into: str = "entropy") -> DataFrame:
    """Shannon entropy of a value's bytes (0 for a null or empty one), one row for each row: counted where the value is, no byte is ever a row."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, content.cast("binary").alias("raw")).mapInArrow(functools.partial(_entropies, into=into), f"`{key}` {kind}, n_bytes long, `{into}` double")


def _windows(batches, size: int, stride: int):
    for batch in batches:
        rows = []
        for v in batch.column(1).cast(pa.large_binary()):
            raw = np.frombuffer(v.as_buffer(), np.uint8)
            n = max(0, -(-(len(raw) - size) // stride)) + 1
            best = 0.0
            for at in range(0, n, _AT_ONCE):
                starts = np.arange(at, min(n, at + _AT_ONCE)) * stride
                part = raw[starts[0] : starts[-1] + size]
                # Counts of each window by one flat bincount over (window, byte).
                place = (starts - starts[0])[:, None] + np.arange(size)
                inside = place < len(part)
                codes = (np.arange(len(starts))[:, None] * 256 + part[np.minimum(place, len(part) - 1)])[inside]
                best = max(best, float(_bits(np.bincount(codes, minlength=256 * len(starts)).reshape(-1, 256)).max()))
            rows.append((n, best))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), batch.column(2)], names=[batch.schema.names[0], "n_windows", "max_entropy", "blob"])


#: Windows that are counted at a time.
_AT_ONCE = 1024


def max_window_entropy(df: DataFrame, key: str, content: Column, threshold: float = 7.0, size: int = 512, stride: int = 256) -> DataFrame:
    """The highest entropy of a value's windows, the last of which may be short, and whether it is over the threshold; nothing of text in UTF-16 (by its mark) is anomalous, and a value with a zero byte is a blob.  Empty values give no row."""
    raw = content.cast("binary")
    head = F.hex(F.substring(raw, 1, 2))
    kind = df.schema[key].dataType.simpleString()
    blob = F.instr(F.decode(raw, "ISO-8859-1"), "\x00") > 0
    rows = df.select(key, raw.alias("raw"), (blob & ~head.isin("FFFE", "FEFF")).alias("blob"), head.isin("FFFE", "FEFF").alias("utf16")).where(F.octet_length("raw") > 0)
    found = rows.select(key, "raw", F.struct("blob", "utf16").alias("blob")).mapInArrow(functools.partial(_windows, size=size, stride=stride), f"`{key}` {kind}, n_windows long, max_entropy double, blob struct<blob:boolean,utf16:boolean>")
    return found.select(key, "n_windows", "max_entropy", ((F.col("max_entropy") > threshold) & ~F.col("blob.utf16")).alias("anomalous"), F.col("blob.blob").alias("blob"))


def long_tokens(text: Column) -> Column:
    """Runs of more than 32 ASCII letters and digits."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9]{33,}"), F.lit(0))


def char_entropy(token: Column) -> Column:
    """Entropy of a short ASCII token, in place."""
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    counts = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.size(F.filter(chars, lambda d: d == c)).cast("double"))
    return entropy_of_counts(counts, F.size(chars))


def high_entropy_tokens(text: Column, threshold: float = 4.5) -> Column:
    """How many long tokens exceed the threshold."""
    return F.size(F.filter(long_tokens(text), lambda t: char_entropy(t) > threshold))


# Fixed values.
CREDENTIALS = r"AKIA[A-Z0-9]{16}|-----BEGIN RSA PRIVATE KEY-----|sk_live_"
INJECTIONS = ("ignore previous instructions", "system prompt", "search for", "encode in base16", "exfiltrate", "aws_access_key")
INJECTION = "(?i)" + "|".join(INJECTIONS)


def credentials(text: Column) -> Column:
    """M2: how many credentials a text shows."""
    return F.regexp_count(text, F.lit(CREDENTIALS))


def hidden_blocks(html: Column) -> Column:
    """M6: contents of comments and of hidden div and span elements."""
    comments = F.regexp_extract_all(html, F.lit(r"(?s)<!--(.*?)-->"), F.lit(1))
    hidden = F.regexp_extract_all(html, F.lit(r"(?is)<(?:div|span)[^>]*(?:\shidden|display\s*:\s*none|visibility\s*:\s*hidden)[^>]*>(.*?)</(?:div|span)>"), F.lit(1))
    return F.concat(comments, hidden)


def injected(blocks: Column) -> Column:
    """M6: how many blocks hold an instruction to a model."""
    return F.size(F.filter(blocks, lambda b: b.rlike(INJECTION)))


def unpinned_scripts(html: Column) -> Column:
    """External scripts without an integrity digest."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<script[^>]+src=[^>]*>"), F.lit(0))
    return F.size(F.filter(tags, lambda t: ~t.rlike("(?i)integrity=")))


def lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row a line: n from 1, line."""
    return df.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).select(*keep, (F.col("pos") + 1).alias("n"), "line")


def is_comment(line: Column) -> Column:
    """a line that starts as a comment."""
    return F.ltrim(line).rlike(r"^(//|#|/\*|\*|\"\"\"|''')")


def line_of(content: Column, offset: Column) -> Column:
    """1-based line of a character offset (from 0)."""
    return F.regexp_count(F.substring(content, F.lit(1), offset), F.lit("\n")) + 1


# --- diffs ------------------------------------------------------------------------


def split_patch(df: DataFrame, patch: str, *keep: str) -> DataFrame:
    """One row for each file section of a unified diff; no boundary gives one section."""
    return df.select(*keep, F.posexplode(F.split(F.col(patch), r"(?m)(?=^diff --git )")).alias("section_no", "section")).where("section != ''")


def section_path(section: Column) -> Column:
    """The new path of a section, null for a deletion."""
    p = F.regexp_extract(section, r"(?m)^\+\+\+ b/(.+)$", 1)
    return F.when(p != "", p)


def changed_files(patch: Column) -> Column:
    """(path, extension, surface) of every file that a patch changes, deletions left out."""
    paths = F.filter(F.regexp_extract_all(patch, F.lit(r"(?m)^\+\+\+ b/(.+)$"), F.lit(1)), lambda p: p != "/dev/null")
    return F.transform(paths, lambda p: F.struct(p.alias("path"), F.lower(F.regexp_extract(p, r"\.([^./]+)$", 1)).alias("extension"), surface(p).alias("surface")))


def patch_lines(df: DataFrame, patch: str, key: str) -> DataFrame:
    """Every line of a patch with the path that it belongs to, carried down from the header before it."""
    lines = df.select(key, F.posexplode(F.split(patch, "\n")).alias("n", "line"))
    header = F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.+)$", 1)
    down = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("path", F.last(F.when(header != "", header), ignorenulls=True).over(down))


def added_text(section: Column) -> Column:
    """Added lines of a section without their sign."""
    added = F.filter(F.split(section, "\n"), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return F.array_join(F.transform(added, lambda x: F.substring(x, F.lit(2), F.length(x))), "\n")


BRANCHES = ("if ", "if(", "match ", "match{", "match(", "switch ", "switch(", "switch{", "case ", "guard ", "elif ", "elsif ", "else if")


def branch_count(lines_: Column) -> Column:
    """Branch words, each counted on its own, over an array of lines."""
    text = F.array_join(lines_, "\n")
    total = F.lit(0)
    for word in BRANCHES:
        total = total + F.regexp_count(text, F.lit("\\Q" + word + "\\E"))
    return total


def erased_logic(base: Column, head: Column, base_lines: Column, head_lines: Column) -> Column:
    """At least 3 branches of which a fifth or more went, while the size stayed within a tenth."""
    return (base >= 3) & (F.abs(base_lines - head_lines) <= F.greatest(F.floor(base_lines / 10), F.lit(1))) & (head * 10 < base * 8)


def compress_ratio(df: DataFrame, key: str, text: str) -> DataFrame:
    """Zstd level 3 size over size, 1.0 under 256 bytes; anomalous below 0.15.  No built-in compresses, so this is an Arrow function."""
    @F.pandas_udf("double")
    def ratio(values: pd.Series) -> pd.Series:
        import zstandard

        c = zstandard.ZstdCompressor(level=3)

        def one(v):
            raw = (v or "").encode()
            return 1.0 if len(raw) < 256 else len(c.compress(raw)) / len(raw)

        return values.map(one)

    out = df.select(key, ratio(F.col(text)).alias("ratio"))
    return out.withColumn("anomalous", F.col("ratio") < 0.15)
