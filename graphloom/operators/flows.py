"""Execution flows: where they start, their steps, importance and rank."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import text
from .graph import PropertyGraph
from .traverse import written

# Limits of flows and of the functions that coordinate others.
DEPTH, BRANCH, LEAST_STEPS, LEAST_CONFIDENCE = 10, 4, 3, 0.5
CALLERS_MAX, CALLEES_MIN, DELEGATE_CALLEES_MIN = 3, 4, 3
ROUNDS, DAMPING = 10, 0.85
#: Callers in tests that are sent to all tasks, and callers of a node that are in one row.
FEW, CHUNK = 100_000, 1_000


def _functions(graph: PropertyGraph, tests: bool) -> DataFrame:
    found = graph.by_label("Function", "Method")
    return found if tests else found.filter(~text.is_test_path(F.col("filePath")))


def _calls(graph: PropertyGraph) -> DataFrame:
    return graph.edges_of(*model.CALL_LIKE).select("src", "dst", "type", "confidence", "edge_id")


def _production_calls(graph: PropertyGraph, *types: str) -> DataFrame:
    """Calls whose caller isn't in a test file; parallel edges stay."""
    tests = graph.nodes.filter(text.is_test_path(F.col("filePath"))).select(F.col("id").alias("src"))
    return _calls(graph).filter(F.col("type").isin(*types or model.CALL_LIKE)).join(tests, "src", "left_anti")


def orchestrators(graph: PropertyGraph, tests: bool = False) -> DataFrame:
    """Functions with 1 to 3 production callers and at least 4 callees: id, callers, callees.

    Edges are counted, not distinct ends; functions that nothing CALLS are
    entry points already.
    """
    callers = _production_calls(graph).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers")).filter(F.col("callers") <= CALLERS_MAX)
    callees = _calls(graph).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("callees")).filter(F.col("callees") >= CALLEES_MIN)
    called = graph.edges_of("CALLS").select(F.col("dst").alias("id"))
    found = _functions(graph, tests).select("id").join(callers, "id").join(callees, "id")
    return found.join(called, "id", "left_semi").select("id", "callers", "callees")


def starts(graph: PropertyGraph, tests: bool = False) -> DataFrame:
    """Functions that begin a flow: id and kind, each once.

    Kinds in order of choice: entry (nothing calls it), orchestrator, spawned,
    delegated (nothing calls it, and it calls or spawns three or more).
    """
    fs = _functions(graph, tests).select("id")
    e, t = graph.edges_of(*model.CALL_LIKE).select("src", "dst", "type"), F.col("type")
    of_tests = graph.nodes.filter(text.is_test_path(F.col("filePath"))).select(F.col("id").alias("src"), F.lit(True).alias("test")).distinct()
    # Callers in tests are few or none as a rule; then no edge moves to meet them.
    few = of_tests.limit(FEW + 1).count() <= FEW
    e = e.join(F.broadcast(of_tests) if few else of_tests, "src", "left")
    one = lambda when: F.when(when, 1).otherwise(0)
    names = ["called", "callers", "spawned", "delegated", "callees", "busy", "known"]
    row = lambda df, key, **own: df.select(F.col(key).alias("id"), *[own.get(n, F.lit(0)).alias(n) for n in names])
    ends = row(e, "dst", called=one(t == "CALLS"), callers=one(F.col("test").isNull()), spawned=one(t == "SPAWNS"), delegated=one(t == "DELEGATES_TO"))
    ends = ends.union(row(e, "src", callees=F.lit(1), busy=one(t.isin("CALLS", "SPAWNS")))).union(row(fs, "id", known=F.lit(1)))
    n = ends.groupBy("id").agg(*[F.sum(x).alias(x) for x in names]).filter("known > 0")
    c = F.col
    kind = (
        F.when(c("called") == 0, "entry")
        .when((c("callers") > 0) & (c("callers") <= CALLERS_MAX) & (c("callees") >= CALLEES_MIN), "orchestrator")
        .when(c("spawned") > 0, "spawned")
        .when((c("delegated") > 0) & (c("called") == 0) & (c("busy") >= DELEGATE_CALLEES_MIN), "delegated")
    )
    return n.select("id", kind.alias("kind")).filter("kind is not null")


def numbered(graph: PropertyGraph) -> tuple[PropertyGraph, DataFrame]:
    """The graph's calls and memberships with numbers for ids, and the numbers: id, n.

    Numbers are in the order of the ids, so what ties by id ties by number.
    """
    sorted_ids = written(graph.nodes.select("id").distinct().orderBy("id").withColumn("_m", F.monotonically_increasing_id()))
    part, row = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    # One row a partition.
    counts = sorted(sorted_ids.groupBy(part.alias("part")).agg(F.max(row) + 1).collect())
    starts_, total = {}, 0
    for k, n in counts:
        starts_[k] = total
        total += n
    kind = "int" if total < 1 << 31 else "bigint"
    before = F.create_map(*[F.lit(x).cast("bigint") for kv in starts_.items() for x in kv]) if starts_ else F.create_map(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    ids = written(sorted_ids.select("id", (F.element_at(before, part.cast("bigint")) + row).cast(kind).alias("n")))
    nodes = graph.nodes.join(ids, "id").drop("id").withColumnRenamed("n", "id")
    e = graph.edges_of(*model.CALL_LIKE, "MEMBER_OF").select("src", "dst", "type", "confidence")
    for end in ("src", "dst"):
        e = e.join(ids.withColumnRenamed("id", end), end, "left").drop(end).withColumnRenamed("n", end)
    e = e.withColumn("edge_id", F.lit(None).cast("string"))
    return PropertyGraph(written(nodes.select("id", "label", "name", "filePath")), written(e)), ids


def named(df: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """Rows with the ids of their numbers."""
    order = df.columns
    for c in columns:
        df = df.join(ids.withColumnsRenamed({"id": "_id", "n": c}), c).drop(c).withColumnRenamed("_id", c)
    return df.select(*order)


def _advance(depth: int, branch: int):
    """One level of all flows: a flow's nodes, then its candidates, give its nodes and levels.

    Rows come by flow, first the one with its nodes and the ends of its levels
    (pos 0), then one for each parent in order with its callees in order. The
    budget of a node counts only children that are new to its flow, so the
    choice runs through a level's nodes in their order. One flow's steps are
    held at a time.
    """
    budget = 2 * branch if depth == 0 else branch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow, nodes, ends, seen = None, [], [], set()
        for rows in batches:
            out: list[list] = [[], [], []]
            for f, pos, to, e in zip(*(rows.column(i).to_pylist() for i in range(4))):
                if pos == 0:
                    if nodes:
                        _put(out, flow, nodes, ends)
                    flow, nodes, ends, seen = f, to, e, set(to)
                    continue
                used = 0
                for x in to:
                    if used == budget:
                        break
                    if x not in seen:
                        seen.add(x)
                        nodes.append(x)
                        used += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, rows.schema.field(i).type) for x, i in zip(out, (0, 2, 3))], ["flow", "nodes", "ends"])
        if nodes:
            out = [[], [], []]
            _put(out, flow, nodes, ends)
            yield pa.RecordBatch.from_arrays([pa.array(x, rows.schema.field(i).type) for x, i in zip(out, (0, 2, 3))], ["flow", "nodes", "ends"])

    return run


def _put(out: list[list], flow, nodes: list, ends: list[int]) -> None:
    """Add a flow; a level that brought nothing isn't one."""
    for x, y in zip(out, (flow, nodes, [*ends, len(nodes)] if len(nodes) > ends[-1] else ends)):
        x.append(y)


def trace(graph: PropertyGraph, begin: DataFrame, depth: int = DEPTH, branch: int = BRANCH, least: int = LEAST_STEPS, confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """Steps of the flow from each start (id): flow, node, pos (from 1), depth.

    Breadth first with a budget of new children per node, twice as wide at the
    root; surer calls first, ties by id. Calls with a confidence between zero
    and ``confidence`` are left out. One join a level, over flows that still
    grow; a task holds one flow at a time, never the graph. Of flows with the
    same set of steps the smallest id stays.
    """
    return steps_of(traced(graph, begin, depth, branch, least, confidence))


def steps_of(flows: DataFrame) -> DataFrame:
    """Steps of flows that are rows: flow, node, pos, depth."""
    s = flows.select("flow", "ends", F.posexplode("nodes").alias("at", "node"))
    return s.select("flow", "node", (F.col("at") + 1).alias("pos"), F.size(F.filter("ends", lambda e: e <= F.col("at"))).alias("depth"))


def traced(graph: PropertyGraph, begin: DataFrame, depth: int = DEPTH, branch: int = BRANCH, least: int = LEAST_STEPS, confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """Flows as rows: flow, its nodes in order, and the ends of its levels among them."""
    sure = F.coalesce("confidence", F.lit(0.0))
    steps = _calls(graph).withColumn("confidence", sure).filter(~((sure > 0) & (sure < confidence)))
    steps = steps.join(graph.nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    # Parallel calls to one child can use its budget once only.
    steps = steps.select("src", F.col("dst").alias("to"), "confidence").repartition("src").groupBy("src", "to").agg(F.max("confidence").alias("confidence"))
    # Of a node's children only so many can be passed over as all the nodes that its flow may have.
    rooms, size, front = [], 1, 1
    for k in range(depth):
        front *= 2 * branch if k == 0 else branch
        size += front
        rooms.append(size)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("confidence"), "to"))
    lists = steps.withColumn("rank", rank).filter(F.col("rank") <= (rooms[-1] if rooms else 0)).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "to"))).alias("to"))
    lists = written(lists.select(F.col("src").alias("node"), F.col("to.to").alias("to")))
    now = written(begin.select("id").distinct().select(F.col("id").alias("flow"), F.array("id").alias("nodes"), F.array(F.lit(1)).alias("ends")))
    kind = dict(now.dtypes)
    done = []
    for k in range(depth):
        last = F.when(F.size("ends") > 1, F.try_element_at("ends", F.lit(-2))).otherwise(0)
        front = now.select("flow", last.alias("before"), F.posexplode(F.slice("nodes", last + 1, F.size("nodes") - last)).alias("at", "node"))
        near = front.join(lists, "node").select("flow", (F.col("at") + F.col("before") + 1).cast("int").alias("pos"), F.slice("to", 1, rooms[k]).alias("to"), F.lit(None).cast("array<int>").alias("ends"))
        rows = now.select("flow", F.lit(0).alias("pos"), F.col("nodes").alias("to"), "ends").union(near)
        ordered = rows.repartition("flow").sortWithinPartitions("flow", "pos")
        level = written(ordered.mapInArrow(_advance(k, branch), f"flow {kind['flow']}, nodes {kind['nodes']}, ends array<int>"))
        done.append(level.filter(F.size("ends") < k + 2))
        now = level.filter(F.size("ends") == k + 2)
        if now.isEmpty():
            break
    done.append(now)
    found = reduce(DataFrame.union, done).filter(F.size("nodes") >= least)
    key = F.sha2(F.array_join(F.transform(F.array_sort("nodes"), lambda x: x.cast("string")), "\n"), 256)
    chosen = found.groupBy(key.alias("key")).agg(F.min("flow").alias("flow")).select("flow")
    return written(found.join(chosen, "flow", "left_semi").select("flow", "nodes", "ends"))


def importance(graph: PropertyGraph, steps: DataFrame, kinds: DataFrame) -> DataFrame:
    """A score per flow: flow, steps, callers, communities, importance.

    Steps that many flows share count less, and so do callers of deep steps;
    an outer caller counts once, at the first step it calls. ``kinds`` is the
    result of :func:`starts`.
    """
    nodes = graph.nodes.select(F.col("id").alias("node"), "name", F.coalesce("filePath", F.lit("")).alias("path"))
    share = steps.groupBy("node").agg(F.count(F.lit(1)).alias("share"))
    package = F.when(text.path_dir(F.col("path")) != "", text.path_dir(F.col("path")))
    member = graph.edges_of("MEMBER_OF").join(graph.nodes.select(F.col("id").alias("dst"), F.col("name").alias("community")), "dst").filter("community <> ''")
    member = member.groupBy(F.col("src").alias("node")).agg(F.collect_set("community").alias("communities"))
    # Callers by node, in rows of a bounded number.
    callers = _calls(graph).select(F.col("src").alias("caller"), F.col("dst").alias("node")).distinct()
    callers = callers.join(graph.nodes.select(F.col("id").alias("caller"), text.is_test_path(F.col("filePath")).alias("test")), "caller")
    some = F.row_number().over(Window.partitionBy("node").orderBy("test", "caller"))
    callers = callers.withColumn("chunk", F.floor((some - 1) / CHUNK).cast("int")).groupBy("node", "chunk")
    callers = callers.agg(F.collect_list(F.when(~F.col("test"), F.col("caller"))).alias("plain"), F.collect_list(F.when(F.col("test"), F.col("caller"))).alias("tests"))
    per = share.join(nodes.select("node", package.alias("package")), "node").join(member, "node", "left").join(callers, "node", "left")
    kind = dict(steps.dtypes)
    first = F.coalesce("chunk", F.lit(0)) == 0
    rows = steps.join(per, "node").select("flow", "pos", "chunk", "depth", "share", F.when(first, F.col("package")).alias("package"), F.when(first, F.col("communities")).alias("communities"), "plain", "tests")
    none = lambda t: F.lit(None).cast(t)
    held = steps.groupBy("flow").agg(F.collect_list("node").alias("plain"))
    held = held.select("flow", F.lit(0).alias("pos"), none("int"), none("int"), none("bigint"), none("string"), none("array<string>"), "plain", none(f"array<{kind['node']}>"))
    ordered = held.toDF(*rows.columns).union(rows).repartition("flow").sortWithinPartitions("flow", "pos", "chunk")
    base = ordered.mapInArrow(_weigh, f"flow {kind['flow']}, steps double, weight double, packages long, communities long, callers long, called double")

    count = lambda df, key, name: df.groupBy(F.col(key).alias("flow")).agg(F.count(F.lit(1)).alias(name))
    fan = count(graph.edges_of("CALLS"), "src", "fan")
    known = count(_production_calls(graph, "CALLS", "SPAWNS"), "dst", "known")
    spawns = graph.edges_of("SPAWNS").select("src", "dst").distinct()
    brood = spawns.join(spawns.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "src").groupBy(F.col("dst").alias("flow")).agg(F.max("n").alias("siblings"))
    own = nodes.withColumnsRenamed({"node": "flow"})
    out = base.join(own, "flow").join(kinds.withColumnRenamed("id", "flow"), "flow")
    for part in (fan, known, brood):
        out = out.join(part, "flow", "left")
    out = out.na.fill(0, ["fan", "known", "siblings"])
    return out.select("flow", F.col("steps").cast("long").alias("steps"), "callers", "communities", _score().alias("importance"))


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a flow from its nodes (pos 0), then its steps with their callers.

    The first step in order that an outer caller calls carries its weight. One
    flow's nodes and callers are held at a time.
    """
    names = ["flow", "steps", "weight", "packages", "communities", "callers", "called"]
    flow, at, met, row, packages, communities = None, 0, set(), None, set(), set()
    kind = None

    def close(out: list[list]) -> None:
        for x, y in zip(out, (flow, row[0], row[1], len(packages), len(communities), row[2], row[3])):
            x.append(y)

    def batch(out: list[list]) -> pa.RecordBatch:
        types = [kind, pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

    for rows in batches:
        kind = rows.schema.field(0).type
        out: list[list] = [[] for _ in names]
        for f, pos, chunk, depth, share, package, groups, plain, tests in zip(*(rows.column(i).to_pylist() for i in range(9))):
            if pos == 0:
                if row is not None:
                    close(out)
                flow, at, met, row, packages, communities = f, 0, set(plain), [0.0, 0.0, 0, 0.0], set(), set()
                continue
            if pos != at:
                at = pos
                row[0] += 1
                row[1] += 1 / np.cbrt(share)
            if package is not None:
                packages.add(package)
            communities.update(groups or ())
            for found, value in ((plain, 1 / ((depth + 1) * math.sqrt(share))), (tests, 0.0)):
                before = len(met)
                met.update(found or ())
                row[2] += len(met) - before
                row[3] += (len(met) - before) * value
        yield batch(out)
    if row is not None:
        out = [[] for _ in names]
        close(out)
        yield batch(out)


def _score() -> Column:
    """The product of a flow's size, callers and bonuses."""
    c, log1p = F.col, F.log1p
    label, command = text.flow_label(c("name")), text.is_command_path(c("path"))
    setup = label.isin("Create operation", "Initialization")
    bonus = lambda when, by: F.when(when, by).otherwise(1.0)
    score = (log1p(c("called")) + 0.3 * log1p(c("steps"))) * log1p(c("weight")) * (1 + 0.3 * F.sqrt(c("weight") / c("steps")))
    for when, by in (
        (c("communities") > 1, F.lit(1.5)),
        (c("packages") > 2, 1 + 0.3 * log1p(F.greatest(c("packages") - 2, F.lit(0)))),
        (c("fan") > 1, 1 + 0.15 * log1p(c("fan"))),
        (c("known") > 1, 1 + 0.2 * log1p(c("known"))),
        (c("siblings") > 0, 1 + 0.5 / F.sqrt(F.greatest(c("siblings"), F.lit(1)))),
        ((c("kind") == "orchestrator") & ~setup & ~command, F.lit(1.5)),
        (setup, F.lit(0.2)),
        (command, F.lit(0.5)),
        (text.is_test_path(c("path")), F.lit(0.1)),
    ):
        score = score * bonus(when, by)
    return score


def page_rank(scores: DataFrame, steps: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Importance (flow, importance) raised for flows that important flows invoke.

    A flow invokes another if its steps hold the other's start. A flow's own
    start counts in its out-degree. Each round is a join and a sum, written so
    that a lost executor doesn't replay the earlier ones.
    """
    ids = scores.select("flow")
    held = steps.join(ids.select(F.col("flow").alias("node")), "node", "left_semi").join(ids, "flow", "left_semi").select("flow", F.col("node").alias("other"))
    outs = held.groupBy("flow").agg(F.count(F.lit(1)).alias("outs"))
    links = written(held.filter("flow <> other").join(outs, "flow"))
    seed = written(scores.select("flow", "importance"))
    rank = seed.withColumnRenamed("importance", "rank")
    for _ in range(rounds):
        given = links.join(rank, "flow").groupBy(F.col("other").alias("flow")).agg(F.sum(F.col("rank") / F.col("outs")).alias("given"))
        rank = written(seed.join(given, "flow", "left").select("flow", ((1 - damping) * F.col("importance") + damping * F.coalesce("given", F.lit(0.0))).alias("rank")))
    ratio = F.when(F.col("importance") > 0, F.col("rank") / F.col("importance")).otherwise(0.0)
    lifted = F.when(ratio > 1, F.col("importance") * (1 + F.log1p(F.greatest(ratio - 1, F.lit(0.0))))).otherwise(F.col("importance"))
    return seed.join(rank, "flow").select("flow", lifted.alias("importance"))


def add_flows(graph: PropertyGraph, tests: bool = False) -> PropertyGraph:
    """The graph with a Process node per flow and numbered steps from its symbols."""
    kinds = written(starts(graph, tests))
    steps = written(trace(graph, kinds))
    scored = written(importance(graph, steps, kinds))
    ranked = page_rank(scored, steps).join(scored.drop("importance"), "flow")
    name = F.concat("name", F.lit("-flow"))
    head = ranked.join(graph.nodes.select(F.col("id").alias("flow"), "name"), "flow")
    key = lambda c: F.concat(F.lit("process:"), c, F.lit("-flow"))
    nodes = head.select(
        key(F.col("flow")).alias("id"), F.lit("Process").alias("label"), F.array(F.lit("Process")).alias("labels"), name.alias("name"), F.col("flow").alias("entryPoint"),
        text.flow_label(F.col("name")).alias("heuristicLabel"), F.col("steps").cast("int").alias("stepCount"), F.col("callers").cast("int").alias("callerCount"),
        "importance", (F.col("communities") > 1).alias("crossCommunity"),
    )
    edges = steps.select(F.col("node").alias("src"), key(F.col("flow")).alias("dst"), F.lit("STEP_IN_PROCESS").alias("type"), F.col("pos").alias("step"))
    return graph.add(nodes, edges.withColumn("edge_id", model.edge_id("src", "dst", "type", F.col("step").cast("string"))))


def call_tree(graph: PropertyGraph, root: str, depth: int = 3, at_root: int = 20, below: int = 10) -> Iterator[dict]:
    """Callees of a node, depth first, each once: dicts of id, depth, parent and pruned.

    Children go by fan-out, then name, path and id. A frontier join a level
    brings at most ``at_root`` children of the root and ``below`` of others,
    beside those already shown higher up, so what reaches the driver has a
    bound in ``depth`` alone; ``pruned`` counts the children from
    the first that is left out.
    """
    e = _calls(graph).select("src", "dst").distinct()
    fan = e.groupBy("src").agg(F.count(F.lit(1)).alias("fan"))
    kids = e.join(graph.nodes.select(F.col("id").alias("dst"), "name", "filePath"), "dst").join(fan.withColumnRenamed("src", "dst"), "dst", "left")
    order = Window.partitionBy("src").orderBy(F.desc(F.coalesce("fan", F.lit(0))), "name", "filePath", "dst")
    rows: dict[str, list[tuple[str, int]]] = {}
    front = {root}
    for k in range(depth):
        width = at_root if k == 0 else below
        # Nodes shown elsewhere in the tree may stand before the ones to show.
        room = width + 1 + len({d for found in rows.values() for d, _ in found})
        ask = graph.nodes.sparkSession.createDataFrame([(x,) for x in sorted(front)], "src string")
        near = kids.join(F.broadcast(ask), "src").withColumns({"n": F.row_number().over(order), "all": F.count(F.lit(1)).over(Window.partitionBy("src"))})
        for r in near.filter(F.col("n") <= room).orderBy("src", "n").toLocalIterator():
            rows.setdefault(r["src"], []).append((r["dst"], r["all"]))
        front = {d for x in front for d, _ in rows.get(x, [])[:room]} - set(rows)
        if not front:
            break
    seen = {root}

    def walk(node: str, level: int) -> Iterator[dict]:
        width = at_root if level == 0 else below
        shown = 0
        for at, (child, total) in enumerate(rows.get(node, []) if level < depth else []):
            if child in seen:
                continue
            if shown == width:
                yield {"id": None, "depth": level + 1, "parent": node, "pruned": total - at}
                return
            seen.add(child)
            shown += 1
            yield {"id": child, "depth": level + 1, "parent": node, "pruned": 0}
            yield from walk(child, level + 1)

    return walk(root, 0)
