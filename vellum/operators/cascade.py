"""Dead-symbol protection (survey J1, J2, J7, J10, J17, J18, A25, K7, P10, T5, T6, E2): the first stage that holds protects a symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import byte_length
from .score import protected_dir

STAGES = ("Directory", "Heuristic", "Referenced", "Lifecycle", "LibraryMode", "GrepShield")


def is_dunder(name: Column) -> Column:
    return name.rlike("^__.+__$")


def is_private(name: Column) -> Column:
    return name.startswith("_") & ~is_dunder(name)


def protect(symbols: DataFrame, edges: DataFrame, mentions: DataFrame | None = None, library: bool = False, lifecycle: tuple[str, ...] = ("main", "setUp", "tearDown", "__init__", "setup", "teardown"), heuristics: tuple[tuple[str, Column], ...] = ()) -> DataFrame:
    """Symbols with protected_by: the first stage that holds, null for a dead one.

    symbols: id, name, file_path; edges: src_id, dst_id; mentions: name (found in
    texts that are not code); heuristics: (stage, condition) pairs of one's own (E2),
    asked after the parser's.  References and mentions are semi-joins on distinct
    keys, so a symbol that a third of all edges point to is joined once.
    """
    live = edges.where("src_id != dst_id").select(F.col("dst_id").alias("id")).distinct().withColumn("_live", F.lit(True))
    s = symbols.join(live, "id", "left")
    if mentions is not None:
        s = s.join(mentions.select("name").distinct().withColumn("_named", F.lit(True)), "name", "left")
    else:
        s = s.withColumn("_named", F.lit(None).cast("boolean"))
    name = F.col("name")
    stage = F.when(protected_dir(F.col("file_path")), "Directory").when(name.rlike("^(test_|pytest_)"), "Heuristic")
    for label, condition in heuristics:
        stage = stage.when(condition, label)
    stage = (
        stage.when(F.coalesce("_live", F.lit(False)), "Referenced")
        .when(is_dunder(name) | name.isin(*lifecycle), "Lifecycle")
        .when(F.lit(library) & ~is_private(name), "LibraryMode")
        .when(F.coalesce("_named", F.lit(False)), "GrepShield")
    )
    return s.withColumn("protected_by", stage).drop("_live", "_named")


def stage_counts(protected: DataFrame) -> DataFrame:
    """How many symbols each stage keeps, the dead under Dead."""
    return protected.groupBy(F.coalesce("protected_by", F.lit("Dead")).alias("stage")).agg(F.count("*").alias("n"))


def orphan_files(symbols: DataFrame, edges: DataFrame, entries: tuple[str, ...] = ("__init__.py", "main.py", "__main__.py", "setup.py", "manage.py", "conftest.py")) -> DataFrame:
    """Files none of whose symbols another file refers to, entry points left out."""
    at = symbols.select("id", "file_path")
    used = edges.join(at.toDF("src_id", "src_file"), "src_id").join(at.toDF("dst_id", "file_path"), "dst_id").where("src_file != file_path").select("file_path").distinct()
    return at.select("file_path").distinct().where(~F.element_at(F.split("file_path", "/"), -1).isin(*entries)).join(used, "file_path", "left_anti").orderBy("file_path")


def patch_hits(functions: DataFrame, registry: DataFrame) -> DataFrame:
    """Per patch, names that the registry has, and hashes that it has unprotected (zombies) or only protected (clones)."""
    names = registry.select("name").distinct().withColumn("_n", F.lit(1))
    hashes = registry.where("structural_hash != 0").groupBy("structural_hash").agg(F.bool_or(F.col("protected_by").isNull()).alias("_open"))
    j = functions.join(names, "name", "left").join(hashes, "structural_hash", "left")
    return j.groupBy("patch_id").agg(F.count("_n").alias("dead_symbols_added"), F.count_if("_open").alias("zombies"), F.count_if(~F.col("_open")).alias("clones"))


def ghost(modified: DataFrame, master: DataFrame, words: int = 4) -> DataFrame:
    """Per patch, functions touched, and those whose target is gone or has drifted (over 40 % of the hash's bits); a collision over half.

    Hashes are arrays of `words` longs: 256 bits by default.
    """
    m = modified.join(master.select(F.col("qualified_name").alias("name"), F.col("structural_hash").alias("now")), "name", "left")
    bits = F.aggregate(F.zip_with("hash", "now", lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("long")), F.lit(0).cast("long"), lambda a, n: a + n)
    gone = F.col("now").isNull() | (bits > 0.4 * 64 * words)
    g = m.groupBy("patch_id").agg(F.count("*").alias("total"), F.count_if(gone).alias("decayed"))
    return g.withColumn("collision", F.col("decayed") * 2 > F.col("total"))


def bridged(decorators: DataFrame, routes: DataFrame) -> DataFrame:
    """Symbols (id, text of a decorator) that name a route of the pages' scripts: quoted strings of the decorator, joined on equality."""
    quoted = decorators.select("id", F.explode(F.regexp_extract_all("text", F.lit("[\"']([^\"']+)[\"']"), F.lit(1))).alias("route"))
    return quoted.join(routes.select("route").distinct(), "route", "left_semi").select("id").distinct()


def dead_report(protected: DataFrame, top: int = 50) -> tuple[DataFrame, DataFrame]:
    """Dead symbols (id, name, file_path, start, end) by size, the largest `top`; and how many more there are."""
    dead = protected.where("protected_by IS NULL").withColumn("byte_size", byte_length(F.col("start"), F.col("end")))
    listed = dead.orderBy(F.desc("byte_size"), "id").limit(top)
    more = dead.agg(F.greatest(F.count("*") - top, F.lit(0)).alias("more"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"))
    return listed, more


def unwired(functions: DataFrame, calls: DataFrame, lifecycle: tuple[str, ...] = ("main",)) -> DataFrame:
    """Patches all of whose new functions nobody calls and no framework does either."""
    called = calls.select(F.col("callee").alias("name")).distinct().withColumn("_c", F.lit(True))
    j = functions.join(called, "name", "left")
    return j.groupBy("patch_id").agg(F.bool_and(F.col("_c").isNull() & ~F.col("name").isin(*lifecycle)).alias("unwired"))
