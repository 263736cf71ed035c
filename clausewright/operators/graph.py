"""The clause graph: nodes, containment and reference edges, closures, neighbourhoods, contexts.

Keys always carry the document. A document whose graph has at most ``LOCAL_EDGES`` edges is searched
inside tasks, its seeds spread over as many tasks as they need (``SEEDS_PER_TASK``); beyond that bound
the closure is semi-naive over DataFrames: each level joins only the newly reached frontier with the
edges, drops what was visited, and is checkpointed, all seeds advancing together. Both give the same
rows.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.functions import text as tx
from clausewright.operators.skew import join_aggregate
from clausewright.session import cut_lineage

KEY = ["reg_doc", "node"]
LOCAL_EDGES = 500_000
SEEDS_PER_TASK = 64
EDGES_PER_SEED = 500


def clause_nodes(clauses: DataFrame) -> DataFrame:
    """(reg_doc, node): distinct usable clause ids of real clauses."""
    return clauses.filter(~F.col("is_pseudo_clause")).select("reg_doc", tx.canonical_id(F.col("clause_id")).alias("node")).filter(tx.is_clause_id(F.col("node"))).distinct()


def ancestors(nodes: DataFrame) -> DataFrame:
    """(reg_doc, node, ancestor, depth): present ancestors, 1 is the nearest present one. Id-derived, so no recursion."""
    made = nodes.select("reg_doc", "node", F.posexplode(tx.ancestor_ids(F.col("node"))).alias("pos", "ancestor"))
    held = made.join(nodes.withColumnRenamed("node", "ancestor"), ["reg_doc", "ancestor"], "left_semi")
    ranked = held.groupBy("reg_doc", "node").agg(F.array_sort(F.collect_list(F.struct("pos", "ancestor"))).alias("a"))
    return ranked.select("reg_doc", "node", F.posexplode("a").alias("rank", "x")).select("reg_doc", "node", F.col("x.ancestor").alias("ancestor"), (F.col("rank") + 1).alias("depth"))


def contains_edges(anc: DataFrame) -> DataFrame:
    """(reg_doc, src, dst): nearest present parent to child."""
    return anc.filter("depth = 1").select("reg_doc", F.col("ancestor").alias("src"), F.col("node").alias("dst"))


def reference_edges(clauses: DataFrame, nodes: DataFrame) -> DataFrame:
    """(reg_doc, src, dst): distinct references between known clauses, without self-references."""
    refs = clauses.filter(~F.col("is_pseudo_clause")).select("reg_doc", tx.canonical_id(F.col("clause_id")).alias("src"), F.explode("reference_ids").alias("ref"))
    refs = refs.select("reg_doc", "src", tx.canonical_id(F.col("ref")).alias("dst")).filter((F.col("src") != F.col("dst"))).distinct()
    known = nodes.select("reg_doc", F.col("node").alias("dst"))
    return refs.join(known, ["reg_doc", "dst"], "left_semi").join(known.withColumnRenamed("dst", "src"), ["reg_doc", "src"], "left_semi").select("reg_doc", "src", "dst")


def descendants(anc: DataFrame) -> DataFrame:
    return anc.select("reg_doc", F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "depth")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select("reg_doc", F.col("dst").alias("src"), F.col("src").alias("dst"))


def closure(starts: DataFrame, edges: DataFrame, max_hops: int | None = None, both: bool = False, blocked: DataFrame | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(reg_doc, seed, node, hops) reachable from ``starts`` (reg_doc, seed, node), starts at 0 hops.

    ``both`` follows edges either way; nodes in ``blocked`` (reg_doc, node) are neither entered nor left.
    """
    if blocked is not None:
        starts = starts.join(blocked, KEY, "left_anti")
        edges = edges.join(blocked.withColumnRenamed("node", "src"), ["reg_doc", "src"], "left_anti").join(blocked.withColumnRenamed("node", "dst"), ["reg_doc", "dst"], "left_anti")
    if both:
        edges = edges.unionByName(reversed_edges(edges))
    edges = cut_lineage(edges.select("reg_doc", "src", "dst").distinct())
    starts = cut_lineage(starts.select("reg_doc", "seed", "node").distinct())
    large = cut_lineage(edges.groupBy("reg_doc").count().filter(F.col("count") > local_edges).select("reg_doc"))
    if large.isEmpty():
        return _search_in_tasks(starts, edges, max_hops)
    own, there = starts.join(large, "reg_doc", "left_semi"), edges.join(large, "reg_doc", "left_semi")
    return _search_in_tasks(starts.join(large, "reg_doc", "left_anti"), edges.join(large, "reg_doc", "left_anti"), max_hops).unionByName(_search_by_levels(own, there, max_hops))


def _search_in_tasks(starts: DataFrame, edges: DataFrame, max_hops: int | None) -> DataFrame:
    # a task takes more seeds where its copy of the edges is larger
    most = edges.groupBy("reg_doc").agg(F.greatest(F.lit(SEEDS_PER_TASK), F.count("*") / EDGES_PER_SEED).alias("most"))
    parts = starts.groupBy("reg_doc").agg(F.count_distinct("seed").alias("seeds")).join(most, "reg_doc", "left").select("reg_doc", F.ceil(F.col("seeds") / F.coalesce("most", F.lit(SEEDS_PER_TASK))).alias("parts"))
    placed = join_aggregate(starts, parts, ["reg_doc"]).withColumn("part", F.pmod(F.xxhash64("seed"), F.col("parts"))).select("reg_doc", "part", "seed", "node")
    tasks = placed.select(F.col("reg_doc").alias("doc"), F.col("part").alias("task")).distinct()
    copies = edges.join(tasks, F.col("reg_doc") == F.col("doc")).select("doc", "task", "src", "dst")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        after: dict[str, list[str]] = defaultdict(list)
        for s, t in zip(right.column("src").to_pylist(), right.column("dst").to_pylist()):
            after[s].append(t)
        begin: dict[str, list[str]] = defaultdict(list)
        for seed, node in zip(left.column("seed").to_pylist(), left.column("node").to_pylist()):
            begin[seed].append(node)
        doc = left.column("reg_doc")[0].as_py() if left.num_rows else None
        seeds, nodes, hops = [], [], []
        for seed, frontier in begin.items():
            seen = dict.fromkeys(frontier, 0)
            hop = 0
            while frontier and (max_hops is None or hop < max_hops):
                hop += 1
                reached = []
                for n in frontier:
                    for t in after.get(n, ()):
                        if t not in seen:
                            seen[t] = hop
                            reached.append(t)
                frontier = reached
            seeds += [seed] * len(seen)
            nodes += seen.keys()
            hops += seen.values()
        return pa.table([pa.array([doc] * len(seeds), pa.string()), pa.array(seeds, pa.string()), pa.array(nodes, pa.string()), pa.array(hops, pa.int32())], names=["reg_doc", "seed", "node", "hops"])

    return placed.groupBy("reg_doc", "part").cogroup(copies.groupBy("doc", "task")).applyInArrow(search, "reg_doc string, seed string, node string, hops int")


def _search_by_levels(starts: DataFrame, edges: DataFrame, max_hops: int | None) -> DataFrame:
    frontier = cut_lineage(starts)
    visited = frontier.withColumn("hops", F.lit(0))
    hop = 0
    while (max_hops is None or hop < max_hops) and not frontier.isEmpty():
        hop += 1
        step = frontier.join(edges.withColumnRenamed("src", "node"), KEY).select("reg_doc", "seed", F.col("dst").alias("node")).distinct()
        frontier = cut_lineage(step.join(visited, ["reg_doc", "seed", "node"], "left_anti"))
        visited = visited.unionByName(frontier.withColumn("hops", F.lit(hop)))
        if hop % 4 == 0:
            visited = cut_lineage(visited)
    return visited


def neighbourhood(starts: DataFrame, edges: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``hops`` undirected steps, and the edges between them per seed."""
    near = cut_lineage(closure(starts, edges, hops, both=True))
    inside = near.select("reg_doc", "seed", "node")
    induced = edges.join(inside.withColumnRenamed("node", "src"), ["reg_doc", "src"]).join(inside.withColumnRenamed("node", "dst"), ["reg_doc", "seed", "dst"]).select("reg_doc", "seed", "src", "dst")
    return near, induced


def context(seeds: DataFrame, nodes: DataFrame, anc: DataFrame, refs: DataFrame, labels: DataFrame, exclude_testing: bool, transitive: bool = True, both: bool = True, cap: bool = True) -> DataFrame:
    """(reg_doc, seed, node): the generation context of each seed.

    The seed, its ancestors (up to the nearest one labelled formatting if ``cap``), the reference
    closure of those, the seed's descendants and siblings under its nearest ancestor, and, below a
    formatting root, the root's subtree with its own reference closure. With ``exclude_testing``
    testing clauses are neither entered nor returned, except that containment passes through them.
    """
    # each relation is used by several parts
    anc, refs, labels = cut_lineage(anc), cut_lineage(refs), cut_lineage(labels)
    start = cut_lineage(seeds.select("reg_doc", F.col("node").alias("seed"), "node").join(nodes, KEY, "left_semi"))
    blocked = labels.filter(F.col("category").isin(*tx.TESTING)).select(*KEY) if exclude_testing else None
    up = start.join(anc, KEY).select("reg_doc", "seed", F.col("ancestor").alias("node"), "depth")
    roots = up.join(labels.filter("category = 'formatting'").select(*KEY), KEY, "left_semi").groupBy("reg_doc", "seed").agg(F.min_by("node", "depth").alias("root"), F.min("depth").alias("root_depth"))
    up = up.join(roots.select("reg_doc", "seed", "root_depth"), ["reg_doc", "seed"], "left")
    if cap:
        up = up.filter(F.col("root_depth").isNull() | (F.col("depth") <= F.col("root_depth")))
    up = cut_lineage(up)
    chain = start.unionByName(up.select("reg_doc", "seed", "node"))
    part1 = closure(chain, refs, blocked=blocked).select("reg_doc", "seed", "node")
    down = descendants(anc)
    part2 = start.join(down, KEY).select("reg_doc", "seed", F.col("descendant").alias("node"))
    siblings = up.filter("depth = 1").select("reg_doc", "seed", "node").join(contains_edges(anc).withColumnRenamed("src", "node"), KEY).select("reg_doc", "seed", F.col("dst").alias("node"))
    top = roots.select("reg_doc", "seed", F.col("root").alias("node"))
    part3 = top.unionByName(top.join(down, KEY).select("reg_doc", "seed", F.col("descendant").alias("node"))).distinct()
    part4 = closure(part3, refs, None if transitive else 2, both, blocked).select("reg_doc", "seed", "node")
    out = chain.unionByName(part1).unionByName(part2).unionByName(siblings).unionByName(part3).unionByName(part4).distinct()
    return out if blocked is None else out.join(blocked, KEY, "left_anti").select("reg_doc", "seed", "node")


def subtree_order(nodes: DataFrame) -> DataFrame:
    """(reg_doc, node, depth, key): ``key`` sorts a document in pre-order (a parent's key is a prefix of its children's)."""
    n = F.col("node")
    return nodes.select("reg_doc", "node", F.size(tx.ancestor_ids(n)).alias("depth"), tx.natural_key(n).alias("key"))


