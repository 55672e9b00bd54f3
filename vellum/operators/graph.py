"""Graph operators over edge tables (survey G1-G12, G14-G17, G19, A21, J19, J22, U4).

Loops keep a frontier and what was seen, join the frontier with the edges and
subtract what was seen; each round is checkpointed, so plans stay small.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import settle


def reachable(edges: DataFrame, starts: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """(src, dst, depth): every node that a start reaches, itself left out, with its least depth; cycles end by themselves.  With rounds, only those within so many steps."""
    e = edges.select("src", "dst").where("src != dst").distinct()
    begin = starts.select(F.col("node").alias("src")).distinct() if starts is not None else e.select("src").distinct()
    frontier = settle(begin.join(e, "src").select("src", "dst", F.lit(1).alias("depth")))
    seen = frontier
    for depth in count(2) if rounds is None else range(2, rounds + 1):
        step = frontier.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").where("src != dst").distinct()
        frontier = settle(step.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = settle(seen.unionAll(frontier))
    return seen


def reach(edges: DataFrame) -> DataFrame:
    """G1: for each node, how many others include it, directly or not (its ancestors): node, reach."""
    nodes = edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node"))).distinct()
    n = reachable(edges).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    return nodes.join(n, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("reach"))


def in_degree(edges: DataFrame) -> DataFrame:
    """Node, in_degree over distinct edges."""
    return edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))


def silos(edges: DataFrame, top: int = 10) -> DataFrame:
    """The nodes of highest reach with their in-degree; ties by name."""
    r = reach(edges).join(in_degree(edges), "node", "left").select("node", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), "reach")
    return r.orderBy(F.desc("reach"), "node").limit(top)


def edge_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """Src, dst, change (added or removed)."""
    b, h = base.select("src", "dst"), head.select("src", "dst")
    return h.subtract(b).withColumn("change", F.lit("added")).unionAll(b.subtract(h).withColumn("change", F.lit("removed")))


def deflation(base: DataFrame, head: DataFrame) -> DataFrame:
    """Edges severed, and the reach that the targets of removed edges lost."""
    removed = edge_delta(base, head).where("change = 'removed'")
    targets = removed.select(F.col("dst").alias("node")).distinct()
    gone = targets.join(reach(base), "node", "left").join(reach(head).withColumnRenamed("reach", "after"), "node", "left")
    bonus = gone.agg(F.coalesce(F.sum(F.greatest(F.coalesce("reach", F.lit(0)) - F.coalesce("after", F.lit(0)), F.lit(0))), F.lit(0)).alias("bonus"))
    return removed.agg(F.count("*").alias("edges_severed")).crossJoin(bonus)  # one row each


def bloat(base: DataFrame, head: DataFrame, least: int = 100) -> DataFrame:
    """Added edges whose includer many others include; weight is the target's reach before."""
    added = edge_delta(base, head).where("change = 'added'")
    wide = reach(head).where(F.col("reach") >= least).select(F.col("node").alias("src"), F.col("reach").alias("includer_reach"))
    before = reach(base).select(F.col("node").alias("dst"), F.col("reach").alias("weight"))
    return added.join(wide, "src").join(before, "dst", "left").select("src", "dst", "includer_reach", F.coalesce("weight", F.lit(0)).alias("weight"))


def clustering(edges: DataFrame) -> DataFrame:
    """Node, k, links, coefficient: directed links among the neighbours (either way) over k (k - 1), for k of 2 or more.

    Triangles are found from the edge side: an edge counts for every node that has
    both its ends as neighbours, which is an equality join of neighbour lists.
    """
    e = edges.select("src", "dst").where("src != dst").distinct()
    near = e.select(F.col("src").alias("node"), F.col("dst").alias("nb")).union(e.select(F.col("dst").alias("node"), F.col("src").alias("nb"))).distinct()
    k = near.groupBy("node").agg(F.count("*").alias("k")).where("k >= 2")
    ends = near.select("node", F.col("nb").alias("src")).join(e, "src").join(near.select("node", F.col("nb").alias("dst")), ["node", "dst"])
    links = ends.groupBy("node").agg(F.count("*").alias("links"))
    return k.join(links, "node", "left").select("node", "k", F.coalesce("links", F.lit(0)).alias("links"), (F.coalesce("links", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).alias("coefficient"))


def entangled(base: DataFrame, head: DataFrame, over: float = 0.75) -> DataFrame:
    """Ends of added edges whose coefficient is over the threshold."""
    added = edge_delta(base, head).where("change = 'added'")
    ends = added.select(F.col("src").alias("node")).unionAll(added.select(F.col("dst").alias("node"))).distinct()
    return clustering(head).join(ends, "node", "left_semi").where(F.col("coefficient") > over)


def shortest(edges: DataFrame, source: Column) -> DataFrame:
    """Node, cost, path (joined by >) of the cheapest way from a source; equal costs take the path that sorts first; a cycle of negative cost that the source reaches is an error."""
    e = edges.groupBy("src", "dst").agg(F.min("cost").alias("step"))
    best = settle(e.sparkSession.range(1).select(source.cast("string").alias("node"), F.lit(0).cast("long").alias("cost"), source.cast("string").alias("path")))
    nodes = e.select("src").union(e.select("dst")).distinct().count()
    for done in count(1):
        longer = best.withColumnRenamed("node", "src").join(e, "src").select(F.col("dst").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), F.concat("path", F.lit(">"), "dst").alias("path"))
        after = settle(best.unionAll(longer).groupBy("node").agg(F.min(F.struct("cost", "path")).alias("b")).select("node", "b.cost", "b.path"))
        if after.exceptAll(best).isEmpty():
            break
        if done > nodes and not after.join(best.select("node", F.col("cost").alias("before")), "node").where("cost < before").isEmpty():
            raise ValueError("a cycle of negative cost has no cheapest way")
        best = after
    return best


def components(edges: DataFrame) -> DataFrame:
    """Node, component (smallest node reachable): every node takes its neighbours' least label, then its label's label."""
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct()
    labels = settle(e.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        near = e.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        moved = labels.join(near, "node").select("node", F.least("component", "m").alias("component"))
        jumped = moved.join(moved.select(F.col("node").alias("component"), F.col("component").alias("up")), "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component"))
        after = settle(jumped)
        if after.exceptAll(labels).isEmpty():
            break
        labels = after
    return labels


def taint(calls: DataFrame, sinks: DataFrame, seeds: DataFrame, passthroughs: DataFrame | None = None) -> DataFrame:
    """Witnesses (seed_function, seed_label, function, label, sink_label, chain) of labels that flow along calls to a sink.

    calls: caller, callee, caller_label, callee_label; sinks: function, label,
    sink_label; seeds: function, label; passthroughs: function, label_in,
    label_out.  A fact is taken once for each seed, by its first chain in order,
    so recursion ends.
    """
    start = seeds.select("function", "label").distinct()
    facts = settle(start.select(F.col("function").alias("seed_function"), F.col("label").alias("seed_label"), "function", "label", F.col("function").alias("chain")))
    frontier = facts
    key = ["seed_function", "seed_label", "function", "label"]
    while True:
        c = calls.select(F.col("caller").alias("function"), F.col("caller_label").alias("label"), "callee", "callee_label")
        step = frontier.join(c, ["function", "label"]).select("seed_function", "seed_label", F.col("callee").alias("function"), F.col("callee_label").alias("label"), F.concat("chain", F.lit(">"), "callee").alias("chain"))
        if passthroughs is not None:
            p = frontier.join(passthroughs.select("function", F.col("label_in").alias("label"), "label_out"), ["function", "label"])
            step = step.unionAll(p.select("seed_function", "seed_label", "function", F.col("label_out").alias("label"), "chain"))
        new = step.groupBy(*key).agg(F.min("chain").alias("chain")).join(facts.select(*key), key, "left_anti")
        frontier = settle(new)
        if frontier.isEmpty():
            break
        facts = settle(facts.unionByName(frontier))
    return facts.join(sinks.select("function", "label", "sink_label"), ["function", "label"]).select("seed_function", "seed_label", "function", "label", "sink_label", "chain")


def unvalidated(edges: DataFrame, sources: DataFrame, sinks: DataFrame, validators: DataFrame) -> DataFrame:
    """(source, sink) pairs joined by a path without any validator."""
    v = validators.select("node").distinct()
    open_ = edges.join(v.withColumnRenamed("node", "src"), "src", "left_anti").join(v.withColumnRenamed("node", "dst"), "dst", "left_anti")
    r = reachable(open_, sources.select("node"))
    return r.join(sinks.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("source"), F.col("dst").alias("sink"))


def inherited(edges: DataFrame, own: DataFrame) -> DataFrame:
    """Node and its middlewares, own and of all ancestors, sorted; edges: child -> parent as (src, dst)."""
    above = reachable(edges).select(F.col("src").alias("node"), F.col("dst").alias("from")).unionAll(own.select("node", F.col("node").alias("from")))
    return above.join(own.select(F.col("node").alias("from"), "middleware"), "from").groupBy("node").agg(F.array_sort(F.collect_set("middleware")).alias("middlewares"))


def scattered(edges: DataFrame, touched: DataFrame, farthest: int = 4) -> DataFrame:
    """For each touched node that is not within reach of all others either way: node, near (how many others are), others.

    Pairs are counted, not formed: a set of touched nodes is scattered where some node's
    near is below others, and no row is made for two nodes that do not meet.
    """
    t = touched.select("node").distinct()
    r = reachable(edges, t, farthest).join(t.withColumnRenamed("node", "dst"), "dst", "left_semi")
    both = r.select("src", "dst").union(r.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("near"))
    total = t.agg((F.count("*") - 1).alias("others"))
    counted = t.join(near, "node", "left").withColumn("near", F.coalesce("near", F.lit(0))).join(F.broadcast(total))  # one row
    return counted.where("near < others")


def distances(edges: DataFrame, touched: DataFrame, farthest: int = 4) -> DataFrame:
    """(a, b, distance) of touched nodes that meet within the limit, the shorter of both ways."""
    t = touched.select("node").distinct()
    r = reachable(edges, t, farthest).join(t.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return r.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "depth").groupBy("a", "b").agg(F.min("depth").alias("distance"))


def prototype_chains(confirmed: DataFrame, sinks: DataFrame) -> DataFrame:
    """A witness for each sink (function, sink_label) where a project (project) has a confirmed global source: joined on the project."""
    return sinks.join(confirmed.select("project").distinct(), "project", "left_semi").select("project", "function", "sink_label", F.concat(F.lit("__global_polluted_prototype>"), "function").alias("chain"))


AUTH_GUARD = r"(?i)auth|guard|jwt|passport|session|login|permission|protect"


def downgraded(findings: DataFrame, middlewares: DataFrame) -> DataFrame:
    """Missing ownership under a recognised guard of its file (node, middlewares) is informational, with the guards named."""
    guards = middlewares.select(F.col("node").alias("file"), F.filter("middlewares", lambda m: m.rlike(AUTH_GUARD)).alias("guards")).where(F.size("guards") > 0)
    j = findings.join(guards, "file", "left")
    hit = (F.col("id") == "security:missing_ownership_check") & F.col("guards").isNotNull()
    return j.withColumn("severity", F.when(hit, "Informational").otherwise(F.col("severity"))).withColumn("auth", F.when(hit, F.array_join("guards", ", "))).drop("guards")


def can_reach(edges: DataFrame, ingress: DataFrame, targets: DataFrame) -> DataFrame:
    """(ingress, target) pairs across a trust boundary: reached, or the same node."""
    r = reachable(edges, ingress.select("node")).select(F.col("src").alias("ingress"), F.col("dst").alias("target"))
    own = ingress.select(F.col("node").alias("ingress"), F.col("node").alias("target"))
    return r.union(own).join(targets.select(F.col("node").alias("target")).distinct(), "target", "left_semi").select("ingress", "target").distinct()


def privileged(edges: DataFrame, grants: DataFrame, privileges: DataFrame) -> DataFrame:
    """Relations that a granted relation delegates to and that are privileged: (grant, privilege), the proof of an escalation."""
    return can_reach(edges, grants, privileges).select(F.col("ingress").alias("grant"), F.col("target").alias("privilege")).where("grant != privilege")


def dominators(edges: DataFrame, root: str) -> DataFrame:
    """(node, dominator) for every node that the root reaches, itself and the root included.

    A node's dominators are itself and what all its predecessors' have in common; sets
    shrink from all nodes until nothing changes.  For the graphs of one project: the
    sets are as many as nodes times their depth in the dominator tree.
    """
    inside = reachable(edges, edges.sparkSession.range(1).select(F.lit(root).alias("node"))).select(F.col("dst").alias("node"))
    nodes = settle(inside.union(edges.sparkSession.range(1).select(F.lit(root).alias("node"))).distinct())
    e = settle(edges.select("src", "dst").where("src != dst").distinct().join(nodes.withColumnRenamed("node", "src"), "src", "left_semi"))
    # Nodes that were not met yet stand for all nodes, so they take no part in what predecessors have in common.
    own = settle(nodes.where(F.col("node") == root).select("node", F.col("node").alias("dominator")))
    known = own
    while True:
        met = known.select(F.col("node").alias("src")).distinct().join(e, "src").where(F.col("dst") != root).groupBy("dst").agg(F.count("*").alias("n"))
        came = known.withColumnRenamed("node", "src").join(e, "src").groupBy("dst", "dominator").agg(F.count("*").alias("c")).join(met, "dst").where("c = n").select(F.col("dst").alias("node"), "dominator")
        after = settle(came.union(met.select(F.col("dst").alias("node"), F.col("dst").alias("dominator"))).union(own).distinct())
        if after.exceptAll(known).isEmpty() and known.count() == after.count():
            return known
        known = after


def root_cause(edges: DataFrame, root: str, findings: DataFrame) -> DataFrame:
    """The deepest function that dominates all located findings (function, finding): node, n_findings, findings; no row if one of them is out of the root's reach."""
    d = settle(dominators(edges, root))
    located = findings.join(d.select(F.col("node").alias("function")).distinct(), "function", "left_semi")
    places = located.select("function").distinct()
    n = F.broadcast(places.agg(F.count("*").alias("places")))  # one row
    known = edges.select(F.col("src").alias("function")).union(edges.select("dst")).distinct()
    lost = findings.join(known, "function", "left_semi").join(d.select(F.col("node").alias("function")).distinct(), "function", "left_anti")
    common = places.join(d.withColumnRenamed("node", "function"), "function").groupBy("dominator").agg(F.count("*").alias("c")).join(n).where("c = places").select(F.col("dominator").alias("node"))
    depth = d.groupBy("node").agg(F.count("*").alias("depth"))
    best = common.join(depth, "node").agg(F.max_by("node", "depth").alias("node")).where("node IS NOT NULL")
    told = located.agg(F.count("*").alias("n_findings"), F.array_sort(F.collect_list("finding")).alias("findings"))
    out = best.join(F.broadcast(told))
    return out.join(F.broadcast(lost.agg(F.count("*").alias("lost"))), F.col("lost") == 0).drop("lost")


def mesh_composition(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sanitizers that a service dropped, and the services whose sources take what it sends: service, removed, consumers.

    before, after: service, sources, sinks, sanitizers (arrays).
    """
    gone = after.join(before.select("service", F.col("sanitizers").alias("had")), "service").select("service", "sinks", F.array_except("had", "sanitizers").alias("removed")).where(F.size("removed") > 0)
    sends = gone.select("service", F.explode("sinks").alias("channel"))
    takes = after.select(F.col("service").alias("consumer"), F.explode("sources").alias("channel"))
    met = sends.join(takes, "channel").where("service != consumer").groupBy("service").agg(F.array_sort(F.collect_set("consumer")).alias("consumers"))
    return gone.join(met, "service", "left").select("service", F.explode("removed").alias("removed"), F.coalesce("consumers", F.array().cast("array<string>")).alias("consumers"))


# Consistency of authorization reads, from the weakest.
LEVELS = ("minimize_latency", "eventual", "at_least_as_fresh", "higher_consistency", "fully_consistent")


def coherence(checks: DataFrame) -> DataFrame:
    """The weakest consistency of each function's checks (function, level): a pessimistic meet; unknown levels count as the weakest."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.lower("level"))
    worst = checks.withColumn("_r", F.greatest(rank, F.lit(1))).groupBy("function").agg(F.min("_r").alias("r"))
    return worst.select("function", F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("r").cast("int")).alias("level"))


def revocation_races(events: DataFrame) -> DataFrame:
    """Writes of relations (path, seq, kind, has_token) that a check follows in the same unit with no token of the write between them."""
    after = Window.partitionBy("path").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    n = events.withColumns({"_check": F.min(F.when(F.col("kind") == "check", F.col("seq"))).over(after), "_token": F.min(F.when(F.col("has_token"), F.col("seq"))).over(after)})
    return n.where((F.col("kind") == "write") & F.col("_check").isNotNull() & (F.col("_token").isNull() | (F.col("_token") > F.col("_check")))).select("path", "seq", F.col("_check").alias("check_seq"))


def unbounded(edges: DataFrame) -> DataFrame:
    """Nodes that delegate to themselves through others."""
    r = reachable(edges).select(F.col("src").alias("b"), F.col("dst").alias("a"))
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(r, ["a", "b"], "left_semi").select(F.col("a").alias("node")).union(edges.where("src = dst").select("src")).distinct()
