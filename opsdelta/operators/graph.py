"""Dependency graphs (resolution, cycles, components) and event graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import finding_id, fixed
from ..session import cut_and_count, cut_lineage, staging_path


def build_edges(dependencies: DataFrame, references: DataFrame) -> DataFrame:
    """DECLARED edges from dependencies, DISCOVERED ones from file references.

    Both inputs are (from, to, line). Runtime constraints and references to
    oneself are no edges; of repeated edges the first line stays.
    """
    declared = dependencies.where(~F.col("to").startswith("/")).withColumn("kind", F.lit("DECLARED"))
    discovered = references.where(F.col("to") != F.col("from")).withColumn("kind", F.lit("DISCOVERED"))
    return declared.unionByName(discovered).groupBy("from", "to", "kind").agg(F.min("line").alias("line"))


def runtime_constraints(dependencies: DataFrame) -> DataFrame:
    return dependencies.where(F.col("to").startswith("/")).select(
        F.col("from").alias("resource"), F.col("to").alias("constraint"), "line"
    )


def providers(provides: DataFrame) -> DataFrame:
    """(alias, provider): the first resource to declare an alias provides it."""
    return provides.groupBy("alias").agg(F.min_by("resource", "ord").alias("provider"))


def resolve_edges(edges: DataFrame, nodes: DataFrame, provided: DataFrame) -> DataFrame:
    """Add `target` and `resolved`; a real resource beats an alias of its name."""
    real = nodes.select(F.col("name").alias("to"), F.lit(True).alias("_real"))
    alias = provided.select(F.col("alias").alias("to"), "provider")
    return (
        edges.join(real, "to", "left")
        .join(alias, "to", "left")
        .withColumn("target", F.when(F.col("_real"), F.col("to")).otherwise(F.col("provider")))
        .withColumn("resolved", F.col("target").isNotNull())
        .select("from", "to", "kind", "line", "target", "resolved")
    )


def unresolved(edges: DataFrame, nodes: DataFrame, provided: DataFrame) -> DataFrame:
    names = nodes.select(F.col("name").alias("to")).unionByName(provided.select(F.col("alias").alias("to")))
    return edges.join(names.distinct(), "to", "left_anti")


def dependents(resolved: DataFrame, name: str | None = None) -> DataFrame:
    """One hop in both directions: (resource, direction, other)."""
    edges = resolved.where("resolved").select("from", "target").distinct()
    both = edges.select(
        F.col("from").alias("resource"), F.lit("DEPENDS_ON").alias("direction"), F.col("target").alias("other")
    ).unionByName(
        edges.select(
            F.col("target").alias("resource"), F.lit("REQUIRED_BY").alias("direction"), F.col("from").alias("other")
        )
    )
    return both if name is None else both.where(F.col("resource") == name)


def _arcs(resolved: DataFrame) -> DataFrame:
    return resolved.where("resolved").select(F.col("from").alias("src"), F.col("target").alias("dst")).distinct()


def _on_paths(arcs: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Drop arcs that start at a node nobody points to or end at one that points nowhere.

    No cycle holds such an arc. Dropping goes on while a round takes at least a tenth
    of the arcs; what is left of long tails is for the labels to settle.
    """
    while size:
        kept, left = cut_and_count(
            arcs.join(arcs.select(F.col("src").alias("dst")), "dst", "left_semi")
            .join(arcs.select(F.col("dst").alias("src")), "src", "left_semi")
            .select("src", "dst")
        )
        done = left * 10 > size * 9
        arcs, size = kept, left
        if done:
            break
    return arcs, size


def _reach_labels(arcs: DataFrame) -> DataFrame:
    """(id, up, down): least node that reaches each node, and least it reaches.

    Both labels spread in the same rounds, and a node starts with its own name. A
    round joins and writes only the labels that fell in the round before: they go
    along the arcs, to every node that carries the fallen node's name as its label,
    and each fallen label is replaced by that node's own label. So the distance
    covered doubles and long chains take few rounds. `known` holds what was ever
    written; the least row of a node is its label. The driver only reads the number
    of labels that fell.
    """
    spark = arcs.sparkSession
    folder = staging_path(spark, "labels")
    along = arcs.select(F.col("src").alias("whom"), F.col("dst").alias("id"), F.lit(True).alias("is_up")).unionByName(
        arcs.select(F.col("dst").alias("whom"), F.col("src").alias("id"), F.lit(False).alias("is_up"))
    )
    least = lambda df: df.groupBy("id", "is_up").agg(F.min("label").alias("label"))
    told = least(along.select("id", "is_up", F.col("whom").alias("label"))).where(F.col("label") < F.col("id"))
    paths: list[str] = []
    while True:
        paths.append(f"{folder}/round-{len(paths)}")
        fell, changed = cut_and_count(told, path=paths[-1])
        known = spark.read.schema(fell.schema).parquet(*paths)
        if not changed:
            break
        carriers = along.unionByName(known.select(F.col("label").alias("whom"), "id", "is_up"))
        sent = carriers.join(fell.select(F.col("id").alias("whom"), "is_up", "label"), ["whom", "is_up"])
        own = known.select(F.col("id").alias("whom"), "is_up", "label")
        jumped = fell.select("id", "is_up", F.col("label").alias("whom")).join(own, ["whom", "is_up"])
        news = least(sent.select("id", "is_up", "label").unionByName(jumped.select("id", "is_up", "label")))
        held = least(known).withColumnRenamed("label", "_held")
        told = (
            news.join(held, ["id", "is_up"], "left")
            .where(F.col("label") < F.coalesce("_held", "id"))
            .select("id", "is_up", "label")
        )
    ends = arcs.select(F.col("src").alias("id")).union(arcs.select("dst")).distinct()
    up, down = (F.coalesce(F.min(F.when(c, F.col("label"))), F.col("id")) for c in (F.col("is_up"), ~F.col("is_up")))
    return ends.join(known, "id", "left").groupBy("id").agg(up.alias("up"), down.alias("down"))


#: A node that reaches at most so many is settled by its own list of them.
REACH = 64


def _small_reach(arcs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(name, component) of the nodes that reach at most REACH others, and the arcs between the rest.

    Each node keeps the list of all it reaches. A round adds the lists of the nodes that
    the round before added, so the distance covered doubles; a list that stays as it is
    is complete, and its node is read but not written again. A node whose list outgrows
    REACH is left to the labels, and so is every node that reaches it. Two nodes on
    cycles share a component if and only if their lists are equal. No list and no join
    of lists holds more than REACH or its square of names.
    """
    spark = arcs.sparkSession
    folder = staging_path(spark, "reach")
    few = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("_n"))
    told = (
        arcs.join(few.where(F.col("_n") <= REACH).select("src"), "src", "left_semi")
        .groupBy(F.col("src").alias("id"))
        .agg(F.array_sort(F.collect_list("dst")).alias("reach"))
        .withColumn("fresh", F.col("reach"))
        .unionByName(few.where(F.col("_n") > REACH).select(F.col("src").alias("id")), allowMissingColumns=True)
    )
    is_open = F.coalesce(F.size("fresh"), F.lit(0)) > 0
    paths: list[str] = []
    while True:
        paths.append(f"{folder}/round-{len(paths)}")
        now, left = cut_and_count(told, is_open, paths[-1])
        known = spark.read.schema(now.schema).parquet(*paths[:-1]).where(~is_open).unionByName(now) if paths[:-1] else now
        if not left:
            break
        more = known.select(F.col("id").alias("via"), F.col("reach").alias("_more"))
        gained = (
            now.where(is_open)
            .select("id", F.explode("fresh").alias("via"))
            .join(more, "via")  # a node without arcs out has no list
            .groupBy("id")
            .agg(F.array_distinct(F.flatten(F.collect_list("_more"))).alias("_more"), F.bool_or(F.col("_more").isNull()).alias("_big"))
        )
        new = F.array_except(F.coalesce("_more", F.array().cast("array<string>")), "reach")
        fits = ~F.coalesce("_big", F.lit(False)) & (F.size("reach") + F.size("_new") <= REACH)
        told = (
            now.where(is_open)
            .join(gained, "id", "left")
            .withColumn("_new", new)
            .select(
                "id",
                F.when(fits, F.array_sort(F.concat("reach", "_new"))).alias("reach"),
                F.when(fits, F.col("_new")).alias("fresh"),
            )
        )
    done = known.where(F.col("reach").isNotNull())
    cyclic = done.where(F.array_contains("reach", F.col("id")))
    groups = cyclic.groupBy("reach").agg(F.min("id").alias("component"), F.collect_list("id").alias("_members"))
    alone = done.where(~F.array_contains("reach", F.col("id"))).select(F.col("id").alias("name"), F.col("id").alias("component"))
    settled = groups.select(F.explode("_members").alias("name"), "component").unionByName(alone)
    big = known.where(F.col("reach").isNull())
    rest, size = cut_and_count(
        arcs.join(big.select(F.col("id").alias("src")), "src", "left_semi").join(big.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    )
    return settled, rest, size


def components(resolved: DataFrame) -> DataFrame:
    """(name, component): strongly connected components, named by least member."""
    return _components(cut_lineage(_arcs(resolved)))


def _components(arcs: DataFrame) -> DataFrame:
    """The components that arcs without repeats form.

    Nodes that reach few others are settled first, by lists. For the rest, a node
    whose two labels agree reaches that node and is reached by it, so it belongs to
    its component. Arcs between nodes with different labels lie on no cycle and are
    dropped; the rest goes into the next phase. Nodes on no cycle end as components
    of their own.
    """
    everyone = arcs.select(F.col("src").alias("name")).union(arcs.select("dst")).distinct()
    found, live, size = _small_reach(arcs.where(F.col("src") != F.col("dst")))
    while True:
        live, size = _on_paths(live, size)
        if not size:
            break
        labels = cut_lineage(_reach_labels(live))
        members = labels.where(F.col("up") == F.col("down")).select(F.col("id").alias("name"), F.col("up").alias("component"))
        found = found.unionByName(members)
        open_ends = labels.where(F.col("up") != F.col("down"))
        live, size = cut_and_count(
            live.join(open_ends.select(F.col("id").alias("src"), F.col("up").alias("_u1"), F.col("down").alias("_d1")), "src")
            .join(open_ends.select(F.col("id").alias("dst"), F.col("up").alias("_u2"), F.col("down").alias("_d2")), "dst")
            .where((F.col("_u1") == F.col("_u2")) & (F.col("_d1") == F.col("_d2")))
            .select("src", "dst")
        )
    found = cut_lineage(found)
    rest = everyone.join(found, "name", "left_anti").withColumn("component", F.col("name"))
    return found.unionByName(rest)


def _inner_arcs(arcs: DataFrame, comp: DataFrame) -> DataFrame:
    """Arcs between different nodes of one component; every one lies on a cycle."""
    return cut_lineage(
        arcs.where(F.col("src") != F.col("dst"))
        .join(comp.select(F.col("name").alias("src"), F.col("component").alias("cs")), "src")
        .join(comp.select(F.col("name").alias("dst"), F.col("component").alias("cd")), "dst")
        .where(F.col("cs") == F.col("cd"))
        .select("src", "dst")
    )


def cycles(resolved: DataFrame, comp: DataFrame | None = None) -> DataFrame:
    """Every elementary directed cycle once: (cycle array, length).

    A cycle starts at its least member: paths only grow through larger names,
    so rotations never arise. Only arcs inside one component are walked, which
    keeps acyclic parts (where paths multiply) out of the search.
    """
    arcs = cut_lineage(_arcs(resolved))
    comp = _components(arcs) if comp is None else comp
    loops = arcs.where(F.col("src") == F.col("dst")).select(F.array("src").alias("cycle"))
    inner = _inner_arcs(arcs, comp)
    frontier = inner.where(F.col("dst") > F.col("src")).select(
        F.col("src").alias("start"), F.col("dst").alias("end"), F.array("src", "dst").alias("path")
    )
    found = loops
    while True:
        grown, size = cut_and_count(
            frontier.join(inner, F.col("end") == F.col("src")).where(
                (F.col("dst") == F.col("start"))
                | ((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst")))
            )
        )
        if not size:
            break
        found = found.unionByName(grown.where(F.col("dst") == F.col("start")).select(F.col("path").alias("cycle")))
        frontier = grown.where(F.col("dst") != F.col("start")).select(
            "start", F.col("dst").alias("end"), F.concat("path", F.array("dst")).alias("path")
        )
    return found.withColumn("length", F.size("cycle").cast("bigint"))


def shortest_cycles(resolved: DataFrame, comp: DataFrame | None = None) -> DataFrame:
    """A shortest cycle through every arc that lies on one: (from, to, cycle, length).

    One row an arc, where the list of all cycles may grow exponentially. The cycle
    starts with the arc; among cycles of one length the least in name order counts.
    Breadth-first search runs from the end of every arc in the same rounds. A search
    keeps its first path to each node and ends when all arcs into its start are closed.
    """
    arcs = cut_lineage(_arcs(resolved))
    comp = _components(arcs) if comp is None else comp
    inner = _inner_arcs(arcs, comp)
    loops = arcs.where(F.col("src") == F.col("dst")).select(
        F.col("src").alias("from"), F.col("dst").alias("to"), F.array("src").alias("cycle")
    )
    spark = inner.sparkSession
    folder = staging_path(spark, "searches")
    steps = inner.select(F.col("src").alias("end"), F.col("dst").alias("next"))
    wanted = inner.select(F.col("src").alias("end"), F.col("dst").alias("start"))
    reached = steps.select(F.col("end").alias("start"), F.col("next").alias("end"), F.array("end", "next").alias("path"))
    paths: list[str] = []
    while True:
        paths.append(f"{folder}/round-{len(paths)}")
        frontier, size = cut_and_count(reached, path=paths[-1])
        seen = spark.read.schema(frontier.schema).parquet(*paths)
        if not size:
            break
        open_starts = wanted.join(seen.select("start", "end"), ["start", "end"], "left_anti").select("start")
        reached = (
            frontier.join(open_starts, "start", "left_semi")
            .join(steps, "end")
            .where(F.col("next") != F.col("start"))
            .groupBy("start", F.col("next").alias("end"))
            .agg(F.min(F.concat("path", F.array("next"))).alias("path"))
            .join(seen.select("start", "end"), ["start", "end"], "left_anti")
            .select("start", "end", "path")
        )
    # the path leads from the arc's end to its start, which comes first in the cycle
    closed = wanted.join(seen, ["start", "end"]).select(
        F.col("end").alias("from"),
        F.col("start").alias("to"),
        F.concat(F.array("end"), F.slice("path", F.lit(1), F.size("path") - 1)).alias("cycle"),
    )
    return loops.unionByName(closed).withColumn("length", F.size("cycle").cast("bigint"))


def missing_dependencies(unresolved_edges: DataFrame) -> DataFrame:
    """A finding per unresolved edge; bundled names (nine, fixed) are only INFO."""
    bundled = F.lower(F.col("to")).isin(fixed.BUNDLED_RESOURCES)
    found = F.col("kind") == "DISCOVERED"
    rule = F.lit("DEP-MISSING-001")
    return unresolved_edges.select(
        finding_id(rule, "from", F.lit(""), "line", F.concat("to", F.lit(":"), "kind")).alias("id"),
        rule.alias("rule_id"),
        F.when(bundled, "INFO").otherwise("HIGH").alias("severity"),
        F.when(bundled, 0.2).when(found, 0.85).otherwise(0.95).alias("confidence"),
        F.col("from").alias("resource"),
        F.col("to").alias("dependency"),
        "kind",
        "line",
    )


def cycle_findings(found: DataFrame) -> DataFrame:
    """One MEDIUM finding per cycle, owned by its first member."""
    c = F.col("cycle")
    rule = F.lit("DEP-CYCLE-001")
    steps = F.transform(
        F.arrays_zip(c.alias("a"), F.concat(F.slice(c, 2, F.size(c) - 1), F.slice(c, 1, 1)).alias("b")),
        lambda p: F.concat(p["a"], F.lit(" depends on "), p["b"]),
    )
    return found.select(
        finding_id(
            rule, F.element_at(c, 1), F.lit(""), F.lit(None).cast("string"), F.array_join(c, ">")
        ).alias("id"),
        rule.alias("rule_id"),
        F.lit("MEDIUM").alias("severity"),
        F.lit(0.9).alias("confidence"),
        F.element_at(c, 1).alias("resource"),
        F.concat(F.array_join(c, " -> "), F.lit(" -> "), F.element_at(c, 1)).alias("rendered"),
        steps.alias("evidence"),
    )


def event_graph(facts: DataFrame) -> DataFrame:
    """Per event name: how often it is registered and triggered, and how."""
    registered = F.col("kind") == "REGISTRATION"
    return (
        facts.where(F.col("event").isNotNull())
        .groupBy("event")
        .agg(
            F.count_if(registered).alias("registrations"),
            F.count_if(~registered).alias("triggers"),
            F.bool_or(F.coalesce("broadcast", F.lit(False))).alias("broadcast"),
            F.bool_or(F.coalesce(F.col("direction").isin("to-server", "to-client"), F.lit(False))).alias("network"),
        )
    )


def event_endpoints(facts: DataFrame) -> DataFrame:
    """The endpoints of the graph, one row each (lists per event stay rows)."""
    return facts.where(F.col("event").isNotNull()).select(
        "event", "kind", "resource", "file", "line", "call", "side"
    )


def dangling_events(graph: DataFrame) -> DataFrame:
    return graph.where((F.col("registrations") == 0) | (F.col("triggers") == 0)).select(
        "event", F.when(F.col("registrations") == 0, "NOT_REGISTERED").otherwise("NOT_TRIGGERED").alias("problem")
    )


def resource_events(facts: DataFrame, graph: DataFrame) -> DataFrame:
    """(resource, event) with the event's totals, for every resource that uses it."""
    return (
        event_endpoints(facts)
        .groupBy("resource", "event")
        .agg(
            F.count_if(F.col("kind") == "REGISTRATION").alias("own_registrations"),
            F.count_if(F.col("kind") == "TRIGGER").alias("own_triggers"),
        )
        .join(graph, "event")
    )


def event_section(facts: DataFrame) -> DataFrame:
    """Totals of the event graph, with usages whose name is computed at run time."""
    graph = event_graph(facts)
    totals = graph.agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.col("registrations") == 0).alias("not_registered"),
        F.count_if(F.col("triggers") == 0).alias("not_triggered"),
        F.count_if("network").alias("network_events"),
        F.count_if("broadcast").alias("broadcast_events"),
    )
    dynamic = facts.agg(F.count_if(F.col("event").isNull()).alias("dynamic_usages"))
    # both sides are one-row aggregates
    return totals.join(F.broadcast(dynamic))


def event_roles(facts: DataFrame) -> DataFrame:
    """Distinct (event, role, resource): who registers and who triggers."""
    return (
        facts.where(F.col("event").isNotNull())
        .select("event", F.when(F.col("kind") == "REGISTRATION", "REGISTERED_BY").otherwise("TRIGGERED_BY").alias("role"), "resource")
        .distinct()
    )


def resource_detail(nodes: DataFrame, resolved: DataFrame, findings: DataFrame, facts: DataFrame) -> DataFrame:
    """Per resource: findings, edges out and in, events used, dynamic usages."""
    out = resolved.groupBy(F.col("from").alias("name")).agg(
        F.count(F.lit(1)).alias("edges_out"), F.count_if(~F.col("resolved")).alias("unresolved_out")
    )
    into = resolved.where("resolved").groupBy(F.col("target").alias("name")).agg(F.count(F.lit(1)).alias("edges_in"))
    found = findings.groupBy(F.col("resource").alias("name")).agg(F.count(F.lit(1)).alias("findings"))
    used = (
        facts.select(F.col("resource").alias("name"), "event")
        .distinct()
        .groupBy("name")
        .agg(F.count("event").alias("events_used"))
    )
    joined = nodes.select("name")
    for part in (out, into, found, used):
        joined = joined.join(part, "name", "left")
    zero = F.lit(0).cast("bigint")
    counts = ["edges_out", "unresolved_out", "edges_in", "findings", "events_used"]
    return joined.select("name", *[F.coalesce(c, zero).alias(c) for c in counts])
