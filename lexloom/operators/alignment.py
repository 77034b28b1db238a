"""Alignment of token arrays, and correspondences over aligned members."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.operators.progressive import Costs, align_forms
from lexloom.operators.selection import BOUNDARIES, phonetic_segments
from lexloom.plans.scratch import Scratch

#: Pairs whose cost tables a task holds at once.
PAIRS = 2048
GROUP = ["concept_id", "cognate_set_id"]


def align(left: list[str], right: list[str]) -> tuple[list[str | None], list[str | None]]:
    """Global alignment at unit costs; going back, a diagonal step is preferred, then a gap on the right, then one on the left."""
    return align_all([left], [right])[0]


def align_all(lefts: list[list[str]], rights: list[list[str]]) -> list[tuple[list[str | None], list[str | None]]]:
    """Alignments of many pairs: one cost table for all, filled cell by cell with array operations."""
    number: dict[str, int] = {}
    code = lambda rows, width: np.array([[number.setdefault(t, len(number)) for t in r] + [-1] * (width - len(r)) for r in rows], np.int64).reshape(len(rows), width)
    m, n = max(map(len, lefts), default=0), max(map(len, rights), default=0)
    a, b = code(lefts, m), code(rights, n)
    cost = np.zeros((m + 1, n + 1, len(lefts)), np.int32)
    cost[:, 0], cost[0] = np.arange(m + 1)[:, None], np.arange(n + 1)[:, None]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            step = cost[i - 1, j - 1] + (a[:, i - 1] != b[:, j - 1])
            cost[i, j] = np.minimum(step, np.minimum(cost[i - 1, j], cost[i, j - 1]) + 1)
    out = []
    for k, (x, y) in enumerate(zip(lefts, rights, strict=True)):
        table, i, j = cost[:, :, k], len(x), len(y)
        rows: list[tuple[str | None, str | None]] = []
        while i or j:
            if i and j and table[i, j] == table[i - 1, j - 1] + (x[i - 1] != y[j - 1]):
                i, j = i - 1, j - 1
                rows.append((x[i], y[j]))
            elif i and table[i, j] == table[i - 1, j] + 1:
                i -= 1
                rows.append((x[i], None))
            else:
                j -= 1
                rows.append((None, y[j]))
        rows.reverse()
        out.append(([r[0] for r in rows], [r[1] for r in rows]))
    return out


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, PAIRS):
            part = batch.slice(first, PAIRS)
            x, y = part.column("left").to_pylist(), part.column("right").to_pylist()
            rows = align_all([v or [] for v in x], [v or [] for v in y])
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([part.column("left"), part.column("right"), pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind)], ["left", "right", "aligned_left", "aligned_right"])


def each_pair(pairs: DataFrame, solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``pairs`` with what ``solve`` adds to their different ``left, right``."""
    found = solve(pairs.select("left", "right").distinct())
    p, e = pairs.alias("p"), found.alias("e")
    joined = p.join(e, F.col("p.left").eqNullSafe(F.col("e.left")) & F.col("p.right").eqNullSafe(F.col("e.right")), "left")
    return joined.select("p.*", *[F.col(f"e.{c}") for c in found.columns if c not in ("left", "right")])


def align_different(pairs: DataFrame) -> DataFrame:
    """:func:`align_pairs` of ``left, right`` alone, without a look for equal rows."""
    kind = "array<string>"
    return pairs.select("left", "right").mapInArrow(_aligned, f"left {kind}, right {kind}, aligned_left {kind}, aligned_right {kind}")


def align_pairs(pairs: DataFrame) -> DataFrame:
    """Add ``aligned_left, aligned_right`` (gaps are null) to ``pairs(left, right)``; each different pair is aligned once.

    Null arrays count as empty; two empty ones align to nothing.
    """
    return each_pair(pairs, align_different)


def class_pairs(forms: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forms against the gold forms of their concept, by classes of equal ones: pairs of classes, and the members of each.

    Both inputs hold ``form_id, concept_id, segments``. The first table, ``concept_id, class_id, gold_class_id, left,
    right``, has a row for each two different forms; a class is named by its smallest form_id. The second, ``part, form_id,
    concept_id, class_id``, has a row for each form (``form``) and gold form (``gold``). Pairs of forms are both tables
    joined by class.
    """

    def classes(rows: DataFrame, part: str) -> tuple[DataFrame, DataFrame]:
        named = rows.groupBy("concept_id", "segments").agg(F.min("form_id").alias("class_id"))
        r, n = rows.alias("r"), named.alias("n")
        same = F.col("r.concept_id").eqNullSafe(F.col("n.concept_id")) & F.col("r.segments").eqNullSafe(F.col("n.segments"))
        return named, r.join(n, same).select(F.lit(part).alias("part"), "r.form_id", "r.concept_id", "n.class_id")

    (own, members), (right, gold_members) = classes(forms, "form"), classes(gold, "gold")
    right = right.select("concept_id", F.col("class_id").alias("gold_class_id"), F.col("segments").alias("right"))
    pairs = own.withColumnRenamed("segments", "left").join(right, "concept_id")
    return pairs.select("concept_id", "class_id", "gold_class_id", "left", "right"), members.unionByName(gold_members)


def alignment_inputs(forms: DataFrame, memberships: DataFrame, respect: bool = True) -> DataFrame:
    """``form_id, variety_id, concept_id, cognate_set_id, segments``: one row for each judgement, or each form.

    A judgement of a slice gives its segments, one of the whole form all of them; boundaries are left out.
    Forms without any judgement have the set of the form itself. Without ``respect``, sets are null.
    """
    plain = forms.select("form_id", "variety_id", "concept_id", F.lit(None).cast("string").alias("cognate_set_id"), phonetic_segments(F.col("segments")).alias("segments"))
    if not respect:
        return plain.where(F.size("segments") > 0)
    judged = forms.drop("cognate_set_id").join(memberships.select("form_id", "cognate_set_id", "segment_indices"), "form_id")
    chosen = F.when(F.size("segment_indices") > 0, F.transform("segment_indices", lambda i: F.get("segments", i))).otherwise(F.col("segments"))
    rows = judged.select("form_id", "variety_id", "concept_id", "cognate_set_id", phonetic_segments(chosen).alias("segments"))
    rest = forms.join(memberships, "form_id", "left_anti").select("form_id", "variety_id", "concept_id", "cognate_set_id", phonetic_segments(F.col("segments")).alias("segments"))
    return rows.unionByName(rest).where(F.size("segments") > 0)


def align_groups(inputs: DataFrame, anchors: DataFrame | None = None, costs: Costs | None = None) -> DataFrame:
    """Members of each (concept, cognate set) of two varieties or more, aligned to one width.

    Gives ``alignment_id, concept_id, cognate_set_id, form_id, variety_id, is_anchor, aligned``. Where ``inputs`` have
    a column ``alignment`` (tokens and ``-``), and that of every member of a group has one width and the member's tokens, it
    is taken as it is; the other groups are aligned along a guide tree, each different form once, at ``costs`` (units, if
    there are none). ``anchors`` (as inputs, but without a variety) join the groups of their concept whose set is theirs, or
    where either has none; alone they make no group.
    """
    given = F.col("alignment") if "alignment" in inputs.columns else F.lit(None).cast("array<string>")
    own = inputs.select(*GROUP, "form_id", "variety_id", "segments", F.lit(False).alias("is_anchor"), given.alias("_given"))
    names = inputs.agg(F.array_sort(F.collect_set("variety_id")).alias("_names"))
    groups = own.groupBy(*GROUP).agg(F.count_distinct("variety_id").alias("_n")).where("_n >= 2").select(*GROUP)
    same = lambda a, b: F.col(f"{a}.concept_id").eqNullSafe(F.col(f"{b}.concept_id")) & F.col(f"{a}.cognate_set_id").eqNullSafe(F.col(f"{b}.cognate_set_id"))
    members = own.alias("m").join(groups.alias("g"), same("m", "g"), "left_semi")
    if anchors is not None:
        a, g = anchors.alias("a"), groups.alias("g")
        fits = F.col("a.cognate_set_id").isNull() | F.col("g.cognate_set_id").isNull() | (F.col("a.cognate_set_id") == F.col("g.cognate_set_id"))
        none = F.lit(None).cast("array<string>")
        joined = a.join(g, F.col("a.concept_id").eqNullSafe(F.col("g.concept_id")) & fits)
        members = members.unionByName(joined.select("g.concept_id", "g.cognate_set_id", "a.form_id", F.lit(None).cast("string").alias("variety_id"), "a.segments", F.lit(True).alias("is_anchor"), none.alias("_given")))
    tokens = F.filter("_given", lambda t: t != "-")
    fit = F.coalesce(tokens == F.col("segments"), F.lit(False))
    members = Scratch(inputs.sparkSession).save(members.withColumn("_fit", fit))
    sound = members.groupBy(*GROUP).agg(F.bool_and("_fit").alias("_all"), (F.min(F.size("_given")) == F.max(F.size("_given"))).alias("_even")).where("_all and _even")
    m, s = members.alias("m"), sound.alias("s")
    taken = m.join(s, same("m", "s"), "left_semi").withColumn("aligned", F.transform("_given", lambda t: F.when(t != "-", t)))
    rest = m.join(s, same("m", "s"), "left_anti")
    solved = align_forms(rest, costs).alias("f")
    rest = rest.alias("m").join(solved, same("m", "f") & (F.col("m.segments") == F.col("f.segments"))).select("m.*", "f.aligned")
    digest = F.substring(F.sha2(F.array_join("_names", "\0"), 256), 1, 12)
    named = F.concat(F.lit("msa-"), digest, F.lit(":"), "concept_id", F.lit(":"), F.coalesce("cognate_set_id", F.lit("unassigned")))
    # The names are one row, of one entry a variety.
    return taken.unionByName(rest).join(F.broadcast(names)).select(named.alias("alignment_id"), *GROUP, "form_id", "variety_id", "is_anchor", "aligned")


def select_alignments(inputs: DataFrame, concepts: DataFrame | None = None, form_ids: DataFrame | None = None, anchors: DataFrame | None = None, full: bool = True) -> DataFrame:
    """Alignments of chosen concepts or forms; without ``full``, one row an alignment: its width, members and varieties."""
    kept = inputs if concepts is None else inputs.join(concepts, "concept_id", "left_semi")
    kept = kept if form_ids is None else kept.join(form_ids, "form_id", "left_semi")
    rows = align_groups(kept, anchors)
    if full:
        return rows
    return rows.groupBy("alignment_id", *GROUP).agg(F.max(F.size("aligned")).alias("width"), F.count("*").alias("n_members"), F.count_distinct("variety_id").alias("n_varieties"))


def columns(members: DataFrame) -> DataFrame:
    """One row for each member and alignment column; gaps are null."""
    return members.select(*GROUP, "variety_id", "form_id", F.posexplode("aligned").alias("col", "segment"))


def _examples(rows: DataFrame, keys: list[str], example: str, most: int) -> DataFrame:
    """``keys, examples``: the first ``most`` different examples of each; the rank limits rows before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(example))
    first = rows.select(*keys, example).distinct().withColumn("_r", rank).where(F.col("_r") <= most)
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(example)).alias("examples"))


def _by_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    whole = on[0]
    for x in on[1:]:
        whole = whole & x
    return a.alias("a").join(b.alias("b"), whole).select("a.*", "b.examples")


def pairwise_correspondences(members: DataFrame, examples: int = 3) -> DataFrame:
    """Per variety pair and segment pair: aligned columns, those of alignments that hold an anchor, and up to three as examples.

    Members of a column are counted by (variety, segment) before they meet, so copies multiply counts, not
    rows; two gaps are a pair too. Anchors (``is_anchor``, where there is such a column) are no members.
    """
    anchor = F.col("is_anchor") if "is_anchor" in members.columns else F.lit(False)
    held = members.where(anchor).select(*GROUP).distinct().withColumn("_anchored", F.lit(1))
    cells = columns(members.where(~anchor)).groupBy(*GROUP, "col", "variety_id", "segment").agg(F.count("*").alias("n"))
    a, b = cells.alias("a"), cells.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*GROUP, "col")]
    pairs = a.join(b, same[0] & same[1] & same[2] & (F.col("a.variety_id") < F.col("b.variety_id")))
    named = pairs.select(*[F.col(f"a.{c}").alias(c) for c in GROUP], F.col("a.variety_id").alias("variety_a"), F.col("b.variety_id").alias("variety_b"), F.col("a.segment").alias("segment_a"), F.col("b.segment").alias("segment_b"), (F.col("a.n") * F.col("b.n")).alias("n"), F.concat_ws(":", "a.cognate_set_id", F.col("a.col").cast("string")).alias("example"))
    keys = ["variety_a", "variety_b", "segment_a", "segment_b"]
    n, h = named.alias("n"), held.alias("h")
    marked = n.join(h, F.col("n.concept_id").eqNullSafe(F.col("h.concept_id")) & F.col("n.cognate_set_id").eqNullSafe(F.col("h.cognate_set_id")), "left").select("n.*", "h._anchored")
    totals = marked.groupBy(*keys).agg(F.sum("n").alias("n_columns"), F.coalesce(F.sum(F.when(F.col("_anchored") == 1, F.col("n"))), F.lit(0)).alias("n_anchored"))
    return _by_keys(totals, _examples(named, keys, "example", examples), keys)


def correspondence_contexts(members: DataFrame) -> DataFrame:
    """Every cell with the segments before and after it."""
    along = Window.partitionBy(*GROUP, "form_id").orderBy("col")
    return columns(members).withColumns({"previous": F.lag("segment").over(along), "following": F.lead("segment").over(along)})


def correspondence_sets(members: DataFrame, varieties: list[str], examples: int = 3) -> DataFrame:
    """Tuples of segments over ``varieties`` by column: support, number of concepts, example concepts.

    The last member of a variety (by form_id) wins; columns without any segment are skipped. Anchors are left out.
    """
    if "is_anchor" in members.columns:
        members = members.where("not is_anchor")
    # Of members of one width the last decides every column, so that few rows are taken apart.
    each = members.select(*GROUP, "variety_id", "form_id", "aligned", F.size("aligned").alias("_w"))
    keys = [*GROUP, "variety_id", "_w"]
    last = each.groupBy(*keys).agg(F.max("form_id").alias("form_id"))
    on = [F.col(f"m.{c}").eqNullSafe(F.col(f"l.{c}")) for c in (*keys, "form_id")]
    kept = each.alias("m").join(last.alias("l"), reduce(and_, on), "left_semi")
    cells = columns(kept).groupBy(*GROUP, "col", "variety_id").agg(F.max(F.struct("form_id", "segment"))["segment"].alias("segment"))
    tuples = cells.groupBy(*GROUP, "col").pivot("variety_id", varieties).agg(F.first("segment"))
    tuples = tuples.select("concept_id", F.array(*[F.col(f"`{v}`") for v in varieties]).alias("segments")).where(F.exists("segments", lambda s: s.isNotNull()))
    per = tuples.groupBy("segments", "concept_id").agg(F.count("*").alias("n"))
    totals = per.groupBy("segments").agg(F.sum("n").alias("support"), F.count("*").alias("n_concepts"))
    return _by_keys(totals, _examples(per, ["segments"], "concept_id", examples), ["segments"])


def summarize_correspondences(sets: DataFrame, varieties: list[str], segment: str | None = None, variety: str | None = None, least: int = 2, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of the sets that show ``segment`` (at any variety, or one) and have support: with the counts of all, of the too weak and of the matched ones.

    Order: most support first, then segments with a gap as ''. ``-`` asks for a gap. The page is the feature;
    the counts are of the whole.
    """
    seen = F.lit(True)
    if segment is not None:
        wanted = F.lit(None if segment == "-" else segment).cast("string")
        seen = F.exists("segments", lambda s: s.eqNullSafe(wanted)) if variety is None else F.get("segments", F.lit(varieties.index(variety))).eqNullSafe(wanted)
    strong = F.col("support") >= least
    counts = sets.agg(F.count("*").alias("n_sets"), F.count_if(seen & ~strong).alias("n_suppressed"), F.count_if(seen & strong).alias("n_matched"))
    order = [F.desc("support"), F.transform("segments", lambda s: F.coalesce(s, F.lit("")))]
    page = sets.where(seen & strong).orderBy(*order).offset(offset).limit(limit)
    return page.join(F.broadcast(counts))


def inventory_stats(sets: DataFrame, least: int = 2) -> DataFrame:
    return sets.agg(F.count("*").alias("n_sets"), F.count_if(F.col("support") >= least).alias("n_supported"), F.count_if(F.col("support") == 1).alias("n_singletons"))


def matching_columns(members: DataFrame, correspondence: dict[str, str | None], position: str = "any") -> DataFrame:
    """``concept_id, cognate_set_id, col``: columns at which each named child shows its segment (any of its members).

    With ``initial`` or ``final``, that member has no segment before or after the column.
    """
    edge = F.lit(True)
    if position == "initial":
        edge = F.forall(F.slice("aligned", F.lit(1), F.col("col")), lambda s: s.isNull())
    elif position == "final":
        edge = F.forall(F.slice("aligned", F.col("col") + 2, F.size("aligned")), lambda s: s.isNull())
    elif position != "any":
        raise ValueError(f"position is any, initial or final, not {position}")
    cells = members.where(F.col("variety_id").isin(*correspondence)).select(*GROUP, "variety_id", "aligned", F.posexplode("aligned").alias("col", "segment"))
    wanted = F.lit(False)
    for child, segment in correspondence.items():
        wanted = wanted | ((F.col("variety_id") == child) & F.col("segment").eqNullSafe(F.lit(segment).cast("string")))
    shown = cells.where(wanted & edge).groupBy(*GROUP, "col").agg(F.count_distinct("variety_id").alias("_n"))
    return shown.where(F.col("_n") == len(correspondence)).drop("_n")


def polarize(members: DataFrame, evidence: DataFrame, correspondence: dict[str, str | None], position: str = "any", examples: int = 3) -> DataFrame:
    """What other nodes show where the children show a correspondence: counts, and no verdict.

    ``evidence(node_id, kind, relation)`` are the nodes to ask; children are no witnesses. Gives ``node_id,
    kind, relation, columns_covered, segment, count, examples``; a node without members in such columns has
    one row with no segment and count 0.
    """
    found = matching_columns(members, correspondence, position)
    asked = evidence.where(~F.col("node_id").isin(*correspondence))
    on = (F.col("c.concept_id").eqNullSafe(F.col("f.concept_id"))) & (F.col("c.cognate_set_id").eqNullSafe(F.col("f.cognate_set_id"))) & (F.col("c.col") == F.col("f.col"))
    cells = columns(members).alias("c").join(found.alias("f"), on, "left_semi").withColumnRenamed("variety_id", "node_id")
    cells = cells.join(asked.select("node_id"), "node_id", "left_semi").select("node_id", *GROUP, "col", "segment").distinct()
    covered = cells.groupBy("node_id").agg(F.count_distinct(F.struct(*GROUP, "col")).alias("columns_covered"))
    keys = ["node_id", "segment"]
    counts = _by_keys(cells.groupBy(*keys).agg(F.count("*").alias("count")), _examples(cells, keys, "concept_id", examples), keys)
    out = asked.join(covered, "node_id", "left").join(counts, "node_id", "left")
    return out.select("node_id", "kind", "relation", F.coalesce("columns_covered", F.lit(0)).alias("columns_covered"), "segment", F.coalesce("count", F.lit(0)).alias("count"), "examples")


def polarize_candidates(witnesses: DataFrame) -> DataFrame:
    """``segment, observed_node_ids, reconstructed_node_ids`` of :func:`polarize`: who shows each value that is no gap."""
    ids = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("node_id"))))
    return witnesses.where("segment is not null").groupBy("segment").agg(ids("observed").alias("observed_node_ids"), ids("reconstructed").alias("reconstructed_node_ids"))


def segment_map(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, source, target, n``: the gold segment (null: none) that most often stands where a source segment does.

    ``pairs(keys, left, right, ordinal)`` are source and gold forms; of equal counts the one seen first wins. Equal pairs
    are counted before they are taken apart.
    """
    # A null ordinal is the first.
    first = F.when(~F.bool_or(F.col("ordinal").isNull()), F.min("ordinal")).alias("ordinal")
    different = pairs.groupBy(*keys, "left", "right").agg(F.count("*").alias("_n"), first)
    both = F.posexplode(F.arrays_zip(F.col("aligned_left").alias("source"), F.col("aligned_right").alias("target")))
    cells = align_pairs(different).select(*keys, "ordinal", "_n", both.alias("at", "c")).where("c.source is not null")
    counts = cells.groupBy(*keys, F.col("c.source").alias("source"), F.col("c.target").alias("target")).agg(F.sum("_n").alias("n"), F.min(F.struct("ordinal", "at")).alias("_first"))
    best = F.row_number().over(Window.partitionBy(*keys, "source").orderBy(F.desc("n"), "_first"))
    return counts.withColumn("_r", best).where("_r = 1").select(*keys, "source", "target", "n")


def oracle_rules(maps: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, rule_ordinal, source, target``: changes of a segment map in an order in which none feeds another.

    A rule runs before those whose output it would take; rules that do so in a circle are left out, and so are
    boundaries. All branches advance at once: each round takes the rules that nothing left must precede.
    """
    left = maps.where(~F.col("source").eqNullSafe(F.col("target")) & ~F.col("source").isin(*BOUNDARIES) & (F.col("target").isNull() | ~F.col("target").isin(*BOUNDARIES))).select(*keys, "source", "target")
    per = left.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("source", "target"))).alias("_left"))
    # A branch has as many changes as segments, so that its rules fit one row; a rule r must wait while some
    # rule left has its target as source.
    free = lambda rest, r: ~F.exists(rest, lambda o: (o["source"] == F.coalesce(r["target"], F.lit(""))) & (o["source"] != r["source"]))
    kind = "array<struct<source:string,target:string>>"
    state = F.struct(F.col("_left").alias("rest"), F.array().cast(kind).alias("done"))

    def advance(s: Column, _: Column) -> Column:
        return F.struct(F.filter(s["rest"], lambda r: ~free(s["rest"], r)).alias("rest"), F.concat(s["done"], F.filter(s["rest"], lambda r: free(s["rest"], r))).alias("done"))

    steps = F.sequence(F.lit(1), F.size("_left"))
    done = per.withColumn("_done", F.aggregate(steps, state, advance)["done"])
    return done.select(*keys, F.posexplode("_done").alias("rule_ordinal", "r")).select(*keys, "rule_ordinal", F.col("r.source").alias("source"), F.col("r.target").alias("target"))
