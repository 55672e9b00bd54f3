"""Dependency analytics (survey A16, J5, J6, J8, J9, J11-J13, J20, J21, J23, U5, S12, S13, X5)."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import settle


def normal_name(name: Column) -> Column:
    """Trimmed, lower case, hyphens."""
    return F.translate(F.lower(F.trim(name)), "_", "-")


def version_silos(deps: DataFrame) -> DataFrame:
    """Names with more than one distinct version (wildcards aside): name, n_versions, display."""
    v = deps.where("version != '*'").groupBy("name").agg(F.array_sort(F.collect_set("version")).alias("vs")).where(F.size("vs") > 1)
    return v.select("name", F.size("vs").alias("n_versions"), F.concat("name", F.lit(" ("), F.array_join("vs", " vs "), F.lit(")")).alias("display"))


def silo_delta(head: DataFrame, base: DataFrame) -> DataFrame:
    """Silos of the head that the base did not have."""
    return version_silos(head).join(version_silos(base).select("name"), "name", "left_anti")


def _automaton(names: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, name in enumerate(names):
        out.add_word(name, i)
    out.make_automaton()
    return out


#: Names that one task looks for at a time.
NAMES = 200_000


def _present(batches, names: list[str]):
    """Which of the names the task's texts hold, and how often in each file where that is asked."""
    words = _automaton(names)
    for batch in batches:
        rows = []
        for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts: dict[int, int] = {}
            for _, i in words.iter(text or ""):
                counts[i] = counts.get(i, 0) + 1
            rows += [(names[i], path, n) for i, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["name", "path", "n"])


def occurrences(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, path, n): how often each name occurs in each text (path, text), anywhere, within longer words too.

    Names go to the tasks in blocks of a fixed number, each text is read once a block by
    an automaton, and only hits leave the task; no pair of a name and a text is formed.
    """
    spark = names.sparkSession
    distinct = settle(names.select("name").where("name != ''").distinct())
    blocks = max(1, -(-distinct.count() // NAMES))
    read = texts.select("path", "text")
    out = None
    for b in range(blocks):
        part = [r[0] for r in distinct.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b).orderBy("name").toLocalIterator()]
        if part:
            one = read.mapInArrow(functools.partial(_present, names=part), "name string, path string, n long")
            out = one if out is None else out.unionAll(one)
    return out if out is not None else spark.createDataFrame([], "name string, path string, n long")


def unused(declared: DataFrame, texts: DataFrame) -> DataFrame:
    """Declared names that no text (path, text) holds."""
    return declared.select("name").distinct().join(occurrences(declared, texts).select("name").distinct(), "name", "left_anti")


def mentioned(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Names that some text (path, text) holds; a hit protects everything of that name."""
    return occurrences(names, texts).select("name").distinct()


def cross_file(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Names (name, path of their definition) that another file holds, or their own file more than once, or that tests and benchmarks begin with."""
    found = occurrences(candidates, sources).withColumnRenamed("path", "where")
    hit = candidates.select("name", "path").join(found, "name").where("where != path OR n > 1").select("name")
    return hit.union(candidates.where(F.col("name").rlike("^(?:test_|bench_)")).select("name")).distinct()


def phantom_calls(called: DataFrame, registry: DataFrame, defined: DataFrame) -> DataFrame:
    """Calls to names (8 characters or more, with an underscore) that neither the registry nor the change defines."""
    candidates = called.where((F.length("name") >= 8) & F.col("name").contains("_")).select("name").distinct()
    return candidates.join(registry.select("name"), "name", "left_anti").join(defined.select("name"), "name", "left_anti")


def fuzzy_names(candidates: DataFrame, corpus: DataFrame, most: int = 1) -> DataFrame:
    """Corpus names within one edit of a candidate, equal ones included.

    Two names within one edit share, after deletion of at most one character from
    each, a string; joining on those deletion neighbourhoods keeps the join an
    equality.
    """
    if most != 1:
        raise ValueError("the neighbourhood is built for one edit")

    def near(name: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))
        return F.array_distinct(F.concat(F.array(name), cut))

    a = candidates.select("name").distinct().select("name", F.explode(near(F.col("name"))).alias("k"))
    b = corpus.select(F.col("name").alias("match")).distinct().select("match", F.explode(near(F.col("match"))).alias("k"))
    pairs = a.join(b, "k").select("name", "match").distinct()
    return pairs.where(F.levenshtein("name", "match", 1) >= 0).select("name", "match", F.levenshtein("name", "match").alias("edits"))


def first_match(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """For each candidate, the first entry of the corpus (name, seq) within one edit, equal or not: name, match, exact."""
    names = candidates.select(normal_name(F.col("name")).alias("name"), F.col("name").alias("given")).where("name != ''")
    known = corpus.select(normal_name(F.col("name")).alias("name"), F.col("name").alias("entry"), "seq")
    near = fuzzy_names(names, known)
    hits = near.join(known.withColumnRenamed("name", "match"), "match").groupBy("name").agg(F.min_by(F.struct("entry", "edits"), "seq").alias("m"))
    return names.join(hits, "name").select(F.col("given").alias("name"), F.col("m.entry").alias("match"), (F.col("m.edits") == 0).alias("exact")).distinct()


def bloom_members(names: DataFrame, corpus: DataFrame, bits: int = 1 << 20, hashes: int = 7) -> DataFrame:
    """Names that a Bloom filter of the corpus may hold: every member, and few others.  The filter is one array of a fixed size, made by partial aggregation and joined to every row as one value."""
    place = lambda k: F.pmod(F.xxhash64(F.lit(k), normal_name(F.col("name"))), F.lit(bits))
    words = corpus.select(F.explode(F.array(*[place(k) for k in range(hashes)])).alias("bit")).select((F.col("bit") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 AS int))").alias("mask"))
    held = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("filter"))  # bits / 64 entries at most
    test = lambda k: F.coalesce(F.try_element_at("filter", (place(k) / 64).cast("int")), F.lit(0).cast("long")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (place(k) % 64).cast("int"))) != 0
    out = names.select("name").distinct().join(F.broadcast(held))  # one row
    for k in range(hashes):
        out = out.where(test(k))
    return out.select("name")


def silos(lock: DataFrame, blobs: DataFrame) -> DataFrame:
    """Silos of lockfiles, and of manifests where no lockfile names the dependency."""
    from_lock = version_silos(lock)
    return from_lock.unionByName(version_silos(blobs).join(from_lock.select("name"), "name", "left_anti"))


def gadgets(entry_points: DataFrame, deps: DataFrame, atlas: DataFrame) -> DataFrame:
    """Files whose entry point (path, marker) an atlas (marker, package, chain) knows, in projects that depend on the package."""
    there = atlas.join(deps.select(normal_name(F.col("name")).alias("package")).distinct(), "package", "left_semi")
    return entry_points.join(there, "marker").select("path", "marker", "package", "chain").distinct()


def version_key(version: Column) -> Column:
    """Numeric parts of a version for comparison."""
    return F.transform(F.split(F.regexp_replace(version, "[^0-9.].*$", ""), r"\."), lambda p: F.coalesce(F.try_to_number(p, F.lit("999999999999")).cast("long"), F.lit(0).cast("long")))


def known_vulnerable(deps: DataFrame, rules: DataFrame) -> DataFrame:
    """Dependencies in a rule's ecosystem, name and version range [introduced, fixed): distinct (name, version, cve)."""
    d = deps.withColumn("k", F.lower("name"))
    r = rules.select(F.lower("package").alias("k"), "ecosystem", "introduced", "fixed", "cve")
    j = d.join(r, ["k", "ecosystem"])
    v = version_key(F.col("version"))
    hit = (F.col("introduced").isNull() | (v >= version_key(F.col("introduced")))) & (F.col("fixed").isNull() | (v < version_key(F.col("fixed"))))
    return j.where(hit).select("name", "version", "cve").distinct()


def drift(current: DataFrame, known: DataFrame) -> DataFrame:
    """Packages that were not known."""
    return current.select("name").distinct().join(known.select("name"), "name", "left_anti")


_LOCK_ROW = "array<struct<name:string,version:string>>"


def lock_packages(text: Column, base: Column | None = None) -> Column:
    """(name, version) pairs of a lockfile, names in lower case: TOML tables, or the packages of package-lock.json (by the file's name)."""
    tables = F.transform(
        F.regexp_extract_all(text, F.lit(r'(?s)\[\[package\]\]\s*name = "[^"]+"\s*version = "[^"]+"'), F.lit(0)),
        lambda s: F.struct(F.lower(F.regexp_extract(s, 'name = "([^"]+)"', 1)).alias("name"), F.regexp_extract(s, 'version = "([^"]+)"', 1).alias("version")),
    )
    if base is None:
        return tables
    tree = F.from_json(text, "packages map<string,struct<version:string>>, dependencies map<string,struct<version:string>>")
    flat = lambda m: F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,struct<version:string>>"))), lambda e: F.struct(F.lower(F.regexp_replace(e["key"], "^.*node_modules/", "")).alias("name"), e["value"]["version"].alias("version")))
    packages = F.array_distinct(F.filter(F.concat(flat(tree["packages"]), flat(tree["dependencies"])), lambda p: p["name"] != ""))
    return F.when(base == "package-lock.json", packages).otherwise(tables)


def lock_table(files: DataFrame) -> DataFrame:
    """(path, name, version) of the lockfiles among files (path, content)."""
    base = F.element_at(F.split("path", "/"), -1)
    named = files.where(base.isin("Cargo.lock", "package-lock.json", "poetry.lock"))
    return named.select("path", F.explode(lock_packages(F.col("content").cast("string"), base)).alias("p")).select("path", "p.*")
