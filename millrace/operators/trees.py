"""Trees grown round by round: expansion, closure, and parents that wait for all of their children."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import stage


def expand(roots: DataFrame, step: Callable[[DataFrame], DataFrame], max_depth: int, max_children: int = 8) -> DataFrame:
    """(node, parent, depth, path) of a tree grown from roots (node).

    step: frontier to (node, child), the children of each node; of more than ``max_children`` the least ones stay, which is the
    operator's own rule and not a cap on data. A node without children, or at the greatest depth, is a leaf. Each round is staged.
    """
    level = stage(roots.select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.array("node").alias("path")), "level0")
    levels = [level]
    for depth in range(1, max_depth + 1):
        children = step(level.select("node")).groupBy("node").agg(F.slice(F.array_sort(F.collect_set("child")), 1, max_children).alias("c"))
        grown = level.join(children, "node").select(F.explode("c").alias("child"), "node", "path").where(~F.array_contains("path", F.col("child")))
        level = stage(grown.select(F.col("child").alias("node"), F.col("node").alias("parent"), F.lit(depth).alias("depth"), F.concat("path", F.array("child")).alias("path")), f"level{depth}")
        if level.isEmpty():
            break
        levels.append(level)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(ancestor, descendant) of (parent, child) edges. Each round joins only the newest paths with the edges; cycles end where nothing new is found.

    Raises if paths still grow after max_rounds.
    """
    edges = stage(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).where("ancestor is not null and descendant is not null").distinct(), "edges")
    step = edges.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("next"))
    parts, newest = [edges], edges
    for n in range(max_rounds):
        more = newest.join(step, "descendant").select("ancestor", F.col("next").alias("descendant")).distinct()
        for known in parts:
            more = more.join(known, ["ancestor", "descendant"], "left_anti")
        newest = stage(more, f"paths{n}")
        if newest.isEmpty():
            break
        parts.append(newest)
        if len(parts) > 6:  # deep trees: fewer tables to look through
            parts = [stage(functools.reduce(DataFrame.unionByName, parts), "paths")]
    else:
        raise ValueError(f"paths still grow after {max_rounds} rounds")
    return functools.reduce(DataFrame.unionByName, parts)


def descendant_counts(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(ancestor, descendants) of a tree's (parent, child) edges, added up by distance: no list of descendants is ever made.

    Each node has one parent; raises if there are still nodes after max_rounds, as in a cycle.
    """
    edges = edges.select("parent", "child").where("parent is not null and child is not null").distinct()
    inner = stage(edges.join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_semi"), "inner-edges")
    level = stage(edges.groupBy(F.col("parent").alias("ancestor")).agg(F.count("*").alias("n")), "counts")
    levels = [level]
    for n in range(max_rounds):
        up = inner.join(level.withColumnRenamed("ancestor", "child"), "child").groupBy(F.col("parent").alias("ancestor")).agg(F.sum("n").alias("n"))
        level = stage(up, f"counts{n}")
        if level.isEmpty():
            break
        levels.append(level)
    else:
        raise ValueError(f"there are still nodes after {max_rounds} rounds")
    return functools.reduce(DataFrame.unionByName, levels).groupBy("ancestor").agg(F.sum("n").alias("descendants"))


def next_actions(agents: DataFrame, messages: DataFrame, budget: int, agent: str = "agent_id") -> DataFrame:
    """(agent, action): what each agent does next, by its status and its last message.

    ready: pending, or in progress with a tool's result last; complete: ready, but with as many messages as the budget; else wait.
    agents: (agent, status); messages: (agent, seq, role).
    """
    last = messages.groupBy(agent).agg(F.max_by("role", F.struct("seq", "role")).alias("role"), F.count("*").alias("n"))
    x = agents.join(last, agent, "left")
    ready = (F.col("status") == "pending") | (F.col("status") == "in_progress") & (F.coalesce("role", F.lit("")) == "tool")
    action = F.when(~F.coalesce(ready, F.lit(False)), "wait").when(F.coalesce("n", F.lit(0)) >= budget, "complete").otherwise("ready")
    return x.select(agent, action.alias("action"))


def moved_on(agents: DataFrame, responses: DataFrame, agent: str = "agent_id") -> DataFrame:
    """(agent, status, iteration) after a round's responses (agent, said, n_calls): calls wait, text completes, neither fails; who got none stays as it is."""
    r = responses.select(agent, "said", "n_calls", F.lit(True).alias("_got"))
    x = agents.join(r, agent, "left")
    status = F.when(F.col("_got").isNull(), F.col("status")).when(F.col("n_calls") > 0, "waiting").when(F.coalesce(F.col("said") != "", F.lit(False)), "completed").otherwise("failed")
    return x.select(agent, status.alias("status"), (F.col("iteration") + F.when(F.col("_got"), 1).otherwise(0)).alias("iteration"))


def forced_closing(nodes: DataFrame, done: Column) -> DataFrame:
    """nodes (node, depth, ...) with ``closes``: the round in which an open node is closed by force, the deepest first; null for those that are done."""
    deepest = nodes.where(~F.coalesce(done, F.lit(False))).agg(F.max("depth")).first()[0]
    return nodes.withColumn("closes", F.when(~F.coalesce(done, F.lit(False)), F.lit(deepest) - F.col("depth") + 1).cast("int"))


def ready_parents(children: DataFrame, parent: str, done) -> DataFrame:
    """(parent, children, open, ready): a parent is ready once every one of its children is done."""
    return children.groupBy(parent).agg(F.count("*").alias("children"), F.count_if(~F.coalesce(done, F.lit(False))).alias("open")).withColumn("ready", F.col("open") == 0)


def compiled(children: DataFrame, parent: str, done: Column, finding: str, most: int) -> DataFrame:
    """(parent, children, findings) of the parents of which every child is done; the least ``most`` findings are reported, which is the report's length."""
    near = children.where(F.col(finding).isNotNull()).withColumn("_rank", F.row_number().over(Window.partitionBy(parent).orderBy(finding))).where(F.col("_rank") <= most)
    findings = near.groupBy(parent).agg(F.array_sort(F.collect_list(finding)).alias("findings"))
    return ready_parents(children, parent, done).where("ready").join(findings, parent).select(F.col(parent).alias("parent"), "children", "findings")


def spawned(parents: DataFrame, hits: DataFrame, agent: str = "agent_id", max_depth: int = 3) -> DataFrame:
    """(agent, parent, query, depth, n_hits): a child for each query of a parent that a search answers; queries without hits, and parents at the greatest depth, spawn none.

    parents: (agent, depth, queries); hits: (query, ...). Ids are the parent's with the query's place.
    """
    found = hits.groupBy("query").agg(F.count("*").alias("n_hits"))
    q = parents.where(F.col("depth") < max_depth).select(F.col(agent).alias("parent"), (F.col("depth") + 1).alias("depth"), F.posexplode("queries").alias("_pos", "query"))
    return q.join(found, "query").select(F.concat("parent", F.lit("-"), F.col("_pos").cast("string")).alias(agent), "parent", "query", "depth", "n_hits")


def routed(calls: DataFrame, deferred: list[str]) -> DataFrame:
    """(name, route, n) of tool calls: those that run at once, and those that wait for the round's end."""
    return calls.groupBy("name", F.when(F.col("name").isin(deferred), "deferred").otherwise("immediate").alias("route")).agg(F.count("*").alias("n"))


def context_lines(agents: DataFrame, most: int = 80, prefixes: tuple[str, ...] = ("Research the following topic: ", "Investigate: ")) -> DataFrame:
    """(parent, lines): a line of status and topic for each child, in the order of ids; known prefixes are cut off, topics to a length.

    agents: (agent_id, parent, status, topic). A parent has as many lines as children, so their number is the spawning operator's to bound.
    """
    topic = F.col("topic")
    for p in prefixes:
        topic = F.when(topic.startswith(p), F.substring(topic, len(p) + 1, 1_000_000)).otherwise(topic)
    line = F.concat(F.lit("- ["), "status", F.lit("] "), F.substring(topic, 1, most))
    x = agents.where("parent is not null").groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("agent_id", line.alias("line")))).alias("l"))
    return x.select("parent", F.array_join(F.col("l.line"), "\n").alias("lines"))
