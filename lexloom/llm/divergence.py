"""Which sources write unlike each other: chi-square-like divergences of term shares, exact in integers.

The counts of a term in two sources enter the divergence only through the pair of counts, so terms need not be
priced one by one: for each block of terms, an indicator matrix has a column for every (source, count level)
and a one for each term at that level. Its product with its transpose holds, for every two sources, the joint
table of levels (how many terms have this count here and that count there). Each cell of a joint table is
priced once and multiplied by its number of terms. Blocks are dealt by term and by groups of sources, so a
task's work is bounded; terms that neither source holds are added by subtraction at the end.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.plans.scratch import Scratch

#: Terms of a block, and sources of a block, on average.
TERMS, SOURCES = 384, 48
#: Distinct (source, term) counts that a task holds before it passes them on.
HELD = 500_000
#: Shares are integers of this unit.
UNIT = 1_000_000_000
#: Bytes that belong to no term become spaces, A-Z become a-z.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
GROUPS = "lang string, source string"


def _counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, c, docs``: partial counts of occurrences and of documents."""

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def emit():
            for (lang, source), (c, d) in held.items():
                terms = list(c)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(terms), pa.string()),
                        pa.array([source] * len(terms), pa.string()),
                        pa.array([t.decode() for t in terms], pa.string()),
                        pa.array(list(c.values()), pa.int64()),
                        pa.array([d[t] for t in terms], pa.int64()),
                    ],
                    ["lang", "source", "term", "c", "docs"],
                )
            held.clear()

        for batch in batches:
            lang, source, text = (batch.column(n).to_pylist() for n in ("lang", "source", "text"))
            for key, raw in zip(zip(lang, source, strict=True), text, strict=True):
                one = Counter(raw.translate(LETTERS).split())
                c, d = held.setdefault(key, (Counter(), Counter()))
                c.update(one)
                d.update(one.keys())
            if sum(len(c) for c, _ in held.values()) > HELD:
                yield from emit()
        yield from emit()

    return docs.select("lang", "source", F.encode("text", "UTF-8").alias("text")).mapInArrow(run, f"{GROUPS}, term string, c long, docs long")


def _share(c: Column, n: Column, v: Column) -> Column:
    """``1 + floor(UNIT * (c + 1) / (n + v))`` without loss."""
    big = lambda x: x.cast("decimal(20,0)")
    return F.call_function("div", F.lit(UNIT).cast("decimal(18,0)") * big(c + 1), big(n + v)) + 1


def _distance(p: Column, q: Column) -> Column:
    """``floor((p - q)**2 / q)``; shares are at most UNIT + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _prices(levels: np.ndarray, n: int, v: int) -> np.ndarray:
    return np.array([1 + UNIT * (int(c) + 1) // (n + v) for c in levels], np.int64)


def _products():
    """Joint tables of a block of terms for two blocks of sources, priced: ``lang, source, other, n, value``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lang, gb, hb, v = pdf["lang"].iloc[0], pdf["gb"].iloc[0], pdf["hb"].iloc[0], int(pdf["v"].iloc[0])
        named = pdf.drop_duplicates("source").sort_values("source").reset_index(drop=True)
        pdf = pdf[pdf["term"].notna()]
        terms, at = np.unique(pdf["term"].to_numpy(object), return_inverse=True)
        where = {s: i for i, s in enumerate(named["source"])}
        counts = np.zeros((len(terms), len(named)), np.int64)
        counts[at, pdf["source"].map(where).to_numpy()] = pdf["c"].to_numpy()
        # Indicator columns: for each source its levels in this block, 0 among them.
        first, owner, price, ones = [0], [], [], []
        for g, n in enumerate(named["n"]):
            levels, level = np.unique(counts[:, g], return_inverse=True)
            block = np.zeros((len(terms), len(levels)), np.float32)
            block[np.arange(len(terms)), level] = 1
            ones.append(block)
            price.append(_prices(levels, int(n), v))
            owner.append(np.full(len(levels), g))
            first.append(first[-1] + len(levels))
        indicators, owner, price = np.concatenate(ones, axis=1), np.concatenate(owner), np.concatenate(price)
        mine = named["own"].to_numpy()
        left = np.flatnonzero(mine == gb)
        right = np.flatnonzero(mine == hb)
        kept = np.isin(owner, right)
        cols, owner, q_price = indicators[:, kept], owner[kept], price[kept]
        out = []
        for g in left:
            # A cell counts terms of one block, far fewer than 2**24, so 32-bit floats hold it exactly.
            joint = cols.T @ indicators[:, first[g] : first[g + 1]]
            col, row = np.nonzero(joint)
            n, p, q, h = joint[col, row].astype(np.int64), price[first[g] : first[g + 1]][row], q_price[col], owner[col]
            for a, b, turned in [(p, q, False)] if gb == hb else [(p, q, False), (q, p, True)]:
                total = np.zeros(len(named), np.int64)
                # Shares of a source add up to UNIT + v at most, so these sums stay below UNIT * (UNIT + v), within a long.
                np.add.at(total, h, n * ((a - b) * (a - b) // b))
                for i in right:
                    if i != g:
                        s, o = (i, g) if turned else (g, i)
                        out.append((lang, named["source"][s], named["source"][o], len(terms), int(total[i])))
        return pd.DataFrame(out, columns=["lang", "source", "other", "n", "value"])

    return run


def divergences(docs: DataFrame, min_docs: int = 3, top: int = 200, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source differs from the others and from its language.

    ``docs(text, lang, source)``; nulls count as ''. Terms are runs of ASCII letters and of all characters
    beyond ASCII, with only A-Z lower-cased; a language keeps the terms in at least ``min_docs`` of its rows.
    A term's share in a group is ``1 + floor(UNIT * (count + 1) / (N + V))``, with N the group's occurrences of
    kept terms and V the language's number of them. Part ``pair`` has every other source of the language, with
    ``floor((p - q)**2 / q)`` summed over all kept terms (0 where the language has none). Part ``term`` has the
    ``top`` kept terms that the source uses more than the language does. Ranks go by value descending, then item
    in byte order. Repeated rows count each; a source without any kept term has pairs and no terms; an empty
    table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    text = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    docs = docs.select(text("lang"), text("source"), text("text"))
    # One shuffle: counts, document counts and totals all live under the term's key.
    of_term = Window.partitionBy("lang", "term")
    counted = _counted(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))
    counted = counted.withColumn("all_docs", F.sum("docs").over(of_term)).withColumn("all", F.sum("c").over(of_term))
    counted = counted.withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1)
    kept = scratch.save(counted.where(F.col("all_docs") >= min_docs).select("lang", "source", "term", "c", "all", "first"))

    per_group = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    per_lang = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("c").alias("all_n"))
    groups = docs.select("lang", "source").distinct().join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").fillna(0, ["n", "v", "all_n"])
    wide = groups.groupBy("lang").agg(F.ceil(F.count("*") / sources).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("own")
    groups = scratch.save(groups.join(wide, "lang").select("lang", "source", "n", "v", "all_n", "blocks", own))

    with_group = kept.join(groups, ["lang", "source"])
    # A source's counts meet those of every block of sources; the pair of blocks is named smaller first. Each source
    # is in each block of terms, if only with counts of 0: the rows without a term say so.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / terms))
    term_block = with_group.withColumn("tb", F.pmod(F.xxhash64("term"), blocks))
    present = groups.where("v > 0").select("*", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("c"))
    present = present.withColumn("tb", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    columns = ["lang", "source", "term", "c", "n", "v", "own", "blocks", "tb"]
    dealt = term_block.select(columns).unionByName(present.select(columns)).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("lang", "source", "term", "c", "n", "v", "own", "tb", F.least("own", "met").alias("gb"), F.greatest("own", "met").alias("hb"))
    tables = dealt.groupBy("lang", "tb", "gb", "hb").applyInPandas(_products(), f"{GROUPS}, other string, n long, value long")
    tables = tables.groupBy("lang", "source", "other").agg(F.sum("n").alias("seen"), F.sum("value").alias("value"))
    g, h = groups.alias("g"), groups.select("lang", F.col("source").alias("other"), F.col("n").alias("other_n")).alias("h")
    pairs = g.join(h, "lang").where("source <> other").join(tables, ["lang", "source", "other"], "left").fillna(0, ["seen", "value"])
    zero = lambda n: _share(F.lit(0), F.col(n), F.col("v"))
    unseen = F.when(F.col("v") > F.col("seen"), (F.col("v") - F.col("seen")) * _distance(zero("n"), zero("other_n"))).otherwise(0)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), (F.col("value") + unseen).alias("value"))

    p, q = _share(F.col("c"), F.col("n"), F.col("v")), _share(F.col("all"), F.col("all_n"), F.col("v"))
    items = with_group.withColumn("p", p).withColumn("q", q).where("p > q")
    items = items.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(items).where(F.col("rank") <= top))
