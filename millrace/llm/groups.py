"""Consolidating pairwise matches into groups (connected components).

Union-find runs inside each partition of edges and keeps only a spanning forest: every id once, with its local root.
Ids that occur in forests of several partitions link local roots; those links are a smaller graph, which goes through
the same step, in partitions of at most ``edges_per_task`` links, until no links between partitions remain. Roots are
chosen by a hash that changes with each level, so that long chains shrink by a constant factor a level whatever the
order of their ids. No task ever holds more than ``edges_per_task`` edges plus their forest, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import stage

#: Most edges that a task holds at once; a level with no more links than that is finished by one task.
EDGES_PER_TASK = 500_000
LINKING = ("auto", "high", "medium")
FOREST = "node string, root string, low string"


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Union-find over all edges at once: hook the larger root below the smaller, halve the paths, repeat."""
    parent = np.arange(n)
    while a.size:
        ra, rb = parent[a], parent[b]
        keep = ra != rb
        a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _forest(rows: pa.Table, level: int) -> pa.Table:
    """rows: node a, node b (null: a has no link), low = least id known to be in a's group. One row a node."""
    a, b, low = (rows.column(i).combine_chunks() for i in range(3))
    both = pa.concat_arrays([a, b.drop_null()]).dictionary_encode()
    ids = both.dictionary.to_numpy(zero_copy_only=False)
    code = both.indices.to_numpy()
    linked = ~np.asarray(b.is_null())
    n = len(ids)
    if not n:
        return pa.table({"node": ids.astype(str), "root": ids.astype(str), "low": ids.astype(str)})
    # small ranks become roots: rank by a hash of id and level
    by_rank = np.argsort(pd.util.hash_array(ids, hash_key=f"{level:016d}", categorize=False), kind="stable")
    rank_of = np.empty(n, np.int64)
    rank_of[by_rank] = np.arange(n)
    ca = rank_of[code[: len(a)]]
    parent = _roots(ca[linked], rank_of[code[len(a) :]], n)
    # least known id of every local group
    known = pa.concat_arrays([low, both.dictionary]).dictionary_encode()
    in_order = pc.sort_indices(known.dictionary)
    place = np.empty(len(known.dictionary), np.int64)
    place[in_order.to_numpy()] = np.arange(len(place))
    at = place[known.indices.to_numpy()]
    least = np.full(n, len(place), np.int64)
    np.minimum.at(least, parent[ca], at[: len(low)])
    np.minimum.at(least, parent[rank_of], at[len(low) :])
    roots = parent[rank_of]
    return pa.table({"node": both.dictionary, "root": both.dictionary.take(pa.array(by_rank[roots])), "low": known.dictionary.take(in_order.take(pa.array(least[roots])))})


def _forests(level: int, bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def packed() -> pa.Table:
            return _forest(pa.concat_tables(held), level)

        for batch in batches:
            t = pa.Table.from_batches([batch]).rename_columns(["a", "b", "low"])
            held.append(t.cast(pa.schema([("a", pa.string()), ("b", pa.string()), ("low", pa.string())])))
            size += t.num_rows
            if size > bound:
                f = packed()
                held = [pa.table({"a": f["node"], "b": f["root"], "low": f["low"]})]
                size = f.num_rows
                if size > bound // 2:  # the forest itself is large: hand it on and begin another
                    yield from f.to_batches()
                    held, size = [], 0
        if held:
            yield from packed().to_batches(max_chunksize=100_000)

    return run


def components(edges: DataFrame, a: str | Column, b: str | Column, links: Column | None = None, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(record_id, group_id): every non-null id in a or b, with the least id (as a string) of its group.

    A row links its ids where both are set and ``links`` is true (null is false). Ids without links form their own group; a row
    whose ends are equal links nothing; repeated rows and either direction count once. An empty table gives no rows.
    Other columns of ``edges`` are not read.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    links = F.lit(True) if links is None else F.coalesce(links, F.lit(False))
    raw = edges.select(a.cast("string").alias("x"), b.cast("string").alias("y"), links.alias("k"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("x") != F.col("y")) & F.col("k")
    one = lambda p, q: F.struct(p.alias("a"), q.alias("b"), p.alias("low"))
    none = F.lit(None).cast("string")
    rows = raw.select(F.explode(F.when(both, F.array(one(F.col("x"), F.col("y")))).otherwise(F.array(one(F.col("x"), none), one(F.col("y"), none)))).alias("e")).select("e.*").where("a is not null")
    own = F.array_contains("roots", F.col("node"))
    levels: list[DataFrame] = []
    level = 0
    while True:
        nodes = (
            rows.mapInArrow(_forests(level, edges_per_task), FOREST)
            .groupBy("node")
            .agg(F.min("root").alias("parent"), F.collect_set("root").alias("roots"), F.min("low").alias("low"))
        )
        nodes = stage(nodes, f"forest{level}")
        levels.append(nodes)
        between = nodes.where(F.size("roots") > 1).select("parent", "low", F.explode("roots").alias("root")).where("root != parent")
        n = between.count()
        if not n:
            break
        # every root goes on, with what is known of its group's least id
        rows = between.select(F.col("parent").alias("a"), F.col("root").alias("b"), "low")
        lows = nodes.where(own).select("node", "low")
        touched = between.select(F.explode(F.array("parent", "root")).alias("node")).distinct()
        rows = rows.unionByName(lows.join(touched, "node", "left_semi").select(F.col("node").alias("a"), none.alias("b"), "low"))
        rows = rows.repartition(max(1, -(-n // edges_per_task)), "a") if n > edges_per_task else rows.coalesce(1)
        level += 1
    # from the last level down: a node's group is its parent's, and a root without further links knows its least id
    found = None
    while levels:
        nodes = levels.pop()
        roots = nodes.where(own).select(F.col("node").alias("parent"), F.col("low").alias("own"))
        if found is None:
            top = roots.withColumnRenamed("own", "group_id")
        else:
            up = found.select(F.col("node").alias("parent"), "group_id")
            top = roots.join(up, "parent", "left").select("parent", F.coalesce("group_id", "own").alias("group_id"))
        found = nodes.select("node", "parent").join(top, "parent").select("node", "group_id")
    return found.select(F.col("node").alias("record_id"), "group_id")


def match_groups(pairs: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """Groups of match_pairs: a row links if its confidence, trimmed and lower-cased, is auto, high or medium."""
    p = pairs.select("record_a", "record_b", "confidence")
    return components(p, "record_a", "record_b", F.lower(F.trim("confidence")).isin(*LINKING), edges_per_task)
