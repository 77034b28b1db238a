"""Relations of a family tree held as an edge table ``parent_id, child_id, child_ordinal, branch_length``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from lexloom.plans.scratch import Scratch


def closure(edges: DataFrame, deepest: int = 64) -> DataFrame:
    """``ancestor_id, descendant_id, depth, is_leaf``, every node its own descendant at depth 0.

    Paths are extended one level at a time, each level a saved table, so that no level computes the ones
    before it anew; a tree deeper than ``deepest`` (or with a circle) is an error.
    """
    scratch = Scratch(edges.sparkSession)
    own = scratch.save(edges.select("parent_id", "child_id"))
    nodes = own.select(F.col("parent_id").alias("n")).union(own.select("child_id")).distinct()
    step = own.select(F.col("parent_id").alias("descendant_id"), F.col("child_id").alias("next"))
    levels = [scratch.save(nodes.select(F.col("n").alias("ancestor_id"), F.col("n").alias("descendant_id"), F.lit(0).alias("depth")))]
    for depth in range(1, deepest + 2):
        level = scratch.save(levels[-1].join(step, "descendant_id").select("ancestor_id", F.col("next").alias("descendant_id"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        if depth > deepest:
            raise ValueError(f"the tree is deeper than {deepest}")
        levels.append(level)
    inner = own.select(F.col("parent_id").alias("descendant_id"), F.lit(True).alias("inner")).distinct()
    return reduce(DataFrame.union, levels).join(inner, "descendant_id", "left").select("ancestor_id", "descendant_id", "depth", F.col("inner").isNull().alias("is_leaf"))


def node_levels(edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """``node_id, height, children`` of the inner nodes, for a bottom-up order; a node with one child raises an error."""
    heights = (closure(edges) if paths is None else paths).groupBy(F.col("ancestor_id").alias("node_id")).agg(F.max("depth").alias("height"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("child_ordinal", "child_id"))), lambda c: c["child_id"])
    children = edges.groupBy(F.col("parent_id").alias("node_id")).agg(ordered.alias("children"))
    unary = F.raise_error(F.concat(F.lit("node with one child: "), F.col("node_id")))
    return children.join(heights, "node_id").select("node_id", "height", F.when(F.size("children") > 1, F.col("children")).otherwise(unary.cast("array<string>")).alias("children"))


def assign_node_ids(nodes: DataFrame) -> DataFrame:
    """Add ``node_id`` to ``nodes(node_key, parent_key, label, child_ordinal)``: the label, else ``internal:root.i.j``.

    The path counts children from 0 in their order; ``node_key`` is any unique key. Ids that meet twice are
    not an error here; ``check_tree_leaves`` lists them.
    """
    place = (F.row_number().over(Window.partitionBy("parent_key").orderBy("child_ordinal", "node_key")) - 1).cast("string")
    scratch = Scratch(nodes.sparkSession)
    placed = scratch.save(nodes.withColumn("_at", F.when(F.col("parent_key").isNotNull(), place)))
    level = placed.where("parent_key is null").select("node_key", F.lit("root").alias("_path"))
    paths, step = [scratch.save(level)], placed.select("node_key", F.col("parent_key").alias("_up"), "_at")
    while True:
        up = paths[-1].select(F.col("node_key").alias("_up"), "_path")
        level = scratch.save(step.join(up, "_up").select("node_key", F.concat_ws(".", "_path", "_at").alias("_path")))
        if level.isEmpty():
            break
        paths.append(level)
    label = F.when(F.trim(F.coalesce("label", F.lit(""))) != "", F.col("label"))
    return placed.join(reduce(DataFrame.union, paths), "node_key").select(*nodes.columns, F.coalesce(label, F.concat(F.lit("internal:"), "_path")).alias("node_id"))


def prune_and_collapse(edges: DataFrame, usable: DataFrame) -> DataFrame:
    """Edges of the tree that ``usable(leaf_id)`` span: other leaves go, and nodes left with one child are spliced out.

    The lengths along a spliced path are added; the sum is null if any of them is. A node stays if two or
    more of its children have usable leaves below them; its parent is the nearest node above that stays.
    """
    paths = Scratch(edges.sparkSession).save(closure(edges))
    leaves = usable.select(F.col("leaf_id").alias("descendant_id")).distinct()
    live = paths.where("is_leaf").join(leaves, "descendant_id", "left_semi").select("ancestor_id", "descendant_id")
    branches = edges.join(live.select(F.col("ancestor_id").alias("child_id")).distinct(), "child_id", "left_semi")
    forks = branches.groupBy("parent_id").agg(F.count("*").alias("n")).where("n >= 2").select(F.col("parent_id").alias("node_id"))
    kept = forks.union(live.where("ancestor_id = descendant_id").select(F.col("ancestor_id").alias("node_id"))).distinct()
    above = paths.where("depth > 0").join(kept.withColumnRenamed("node_id", "descendant_id"), "descendant_id", "left_semi").join(forks.withColumnRenamed("node_id", "ancestor_id"), "ancestor_id", "left_semi")
    nearest = above.groupBy(F.col("descendant_id").alias("child_id")).agg(F.min(F.struct("depth", "ancestor_id")).alias("_up"))
    # The edges between a node and its new parent: those into nodes on the path.
    steps = edges.select(F.col("child_id").alias("_on"), "branch_length", "child_ordinal")
    on = paths.select(F.col("descendant_id").alias("child_id"), F.col("ancestor_id").alias("_on"), F.col("depth").alias("_back"))
    path = nearest.join(on, "child_id").where(F.col("_back") < F.col("_up.depth")).join(steps, "_on")
    whole = path.groupBy("child_id").agg(F.first("_up.ancestor_id").alias("parent_id"), F.max_by("child_ordinal", "_back").alias("child_ordinal"), F.when(F.count("branch_length") == F.count("*"), F.sum("branch_length")).alias("branch_length"))
    return whole.select("parent_id", "child_id", "child_ordinal", "branch_length")


def classify_evidence(edges: DataFrame) -> DataFrame:
    """``parent_id, node_id, kind, relation, leaf_ids``: what each inner node sees of the others.

    Leaves are observed and always visible; an inner node is reconstructed and visible once it is done, in
    post-order, before the one that looks. ``relation``: active_child, descendant (its leaves are among the
    parent's) or outgroup.
    """
    scratch = Scratch(edges.sparkSession)
    paths = scratch.save(closure(edges))
    leaf_ids = paths.where("is_leaf").groupBy(F.col("ancestor_id").alias("node_id")).agg(F.array_sort(F.collect_list("descendant_id")).alias("leaf_ids"))
    # Post-order: a node is done before another if it lies below it, or if at their nearest common ancestor
    # its branch comes first. The route of ordinals from the root decides: it is smaller, or it extends.
    order = edges.select(F.col("child_id").alias("_on"), "child_ordinal")
    on = paths.select(F.col("descendant_id").alias("node_id"), F.col("ancestor_id").alias("_on"), "depth")
    route = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "child_ordinal"))), lambda x: x["child_ordinal"])
    routes = on.join(order, "_on").groupBy("node_id").agg(route.alias("route"))
    nodes = paths.where("depth = 0").select(F.col("ancestor_id").alias("node_id"), "is_leaf").join(routes, "node_id", "left").join(leaf_ids, "node_id", "left")
    nodes = scratch.save(nodes.select("node_id", "is_leaf", F.coalesce("route", F.array().cast("array<int>")).alias("route"), "leaf_ids"))
    p, n = nodes.where("not is_leaf").alias("p"), nodes.alias("n")
    # Every inner node looks at every other node, so the result itself is of that size.
    size = F.size("p.route")
    extends = (F.slice("n.route", F.lit(1), size) == F.col("p.route")) & (F.size("n.route") > size)
    inside = F.slice("p.route", F.lit(1), F.size("n.route")) == F.col("n.route")
    before = extends | (~inside & (F.col("n.route") < F.col("p.route")))
    seen = p.join(n, (F.col("p.node_id") != F.col("n.node_id")) & (F.col("n.is_leaf") | before))
    child = edges.select(F.col("parent_id").alias("_p"), F.col("child_id").alias("_c"))
    seen = seen.join(child, (F.col("p.node_id") == F.col("_p")) & (F.col("n.node_id") == F.col("_c")), "left")
    relation = F.when(F.col("_c").isNotNull(), "active_child").when(F.size(F.array_except("n.leaf_ids", "p.leaf_ids")) == 0, "descendant").otherwise("outgroup")
    return seen.select(F.col("p.node_id").alias("parent_id"), F.col("n.node_id").alias("node_id"), F.when(F.col("n.is_leaf"), "observed").otherwise("reconstructed").alias("kind"), relation.alias("relation"), F.col("n.leaf_ids").alias("leaf_ids"))


def outgroups(edges: DataFrame, granularity: str = "sibling") -> DataFrame:
    """``node_id, clade_id, leaf_id``: the sibling subtrees at each ancestor of a node, and their leaves.

    With ``subclade``, a sibling with children is cut into these.
    """
    if granularity not in ("sibling", "subclade"):
        raise ValueError(f"granularity is sibling or subclade, not {granularity}")
    paths = closure(edges)
    above = paths.select(F.col("ancestor_id").alias("parent_id"), F.col("descendant_id").alias("node_id")).where("parent_id <> node_id")
    siblings = above.join(edges.select("parent_id", F.col("child_id").alias("clade_id")), "parent_id").select("node_id", "clade_id")
    own = paths.select(F.col("ancestor_id").alias("clade_id"), F.col("descendant_id").alias("node_id"))
    apart = siblings.join(own, ["clade_id", "node_id"], "left_anti")
    if granularity == "subclade":
        parts = edges.select(F.col("parent_id").alias("clade_id"), F.col("child_id").alias("_part"))
        apart = apart.join(parts, "clade_id", "left").select("node_id", F.coalesce("_part", "clade_id").alias("clade_id"))
    leaves = paths.where("is_leaf").select(F.col("ancestor_id").alias("clade_id"), F.col("descendant_id").alias("leaf_id"))
    return apart.join(leaves, "clade_id").select("node_id", "clade_id", "leaf_id")


def internal_children(steps: DataFrame, trajectories: DataFrame) -> DataFrame:
    """``parent_id, child_id`` of inner nodes below inner nodes: from results where a parent has one, else from its trajectory.

    Both hold ``parent_id, child_ids``. A child is inner if it is a parent itself.
    """
    known = steps.select("parent_id", "child_ids")
    rows = known.unionByName(trajectories.select("parent_id", "child_ids").join(known, "parent_id", "left_anti"))
    pairs = rows.select("parent_id", F.explode("child_ids").alias("child_id")).distinct()
    return pairs.join(rows.select(F.col("parent_id").alias("child_id")), "child_id", "left_semi").select("parent_id", "child_id")
