"""Mixing sources to target weights, by temperature, in DataFrame operations only.

The share of each source is raised to an exponent between 0 (uniform) and 1 (as found). Bisection finds the
exponent that meets a target: an entropy of the weights, or the largest number of times that any source
may repeat within the budget. The weights are realised as permutations: each pass over a source orders its
documents by a keyed hash, in blocks of that hash, and the last pass stops at the budget.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.functions.binding import let
from lexloom.plans.scratch import Scratch

#: Halvings of the exponent's interval.
HALVINGS = 40
#: Decimal places that exponents are rounded to, so that engines which sum in another order agree.
PLACES = 6
#: Hexadecimal digits of a hash that name its block.
BLOCK_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text, split at spaces and bytes 9 to 13; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weights(sources: DataFrame, budget: float = 1.0, entropy: float | None = None, repeats: float | None = None) -> DataFrame:
    """``source, tokens`` to ``source, tokens, exponent, weight, quota``.

    ``budget`` is the output's tokens as a multiple of the input's. ``entropy`` is a share of the largest
    possible entropy (log of the number of sources); the exponent is the largest that reaches it.
    ``repeats``: the exponent is the smallest for which no source exceeds so many passes (never below
    ``budget`` passes; with exponent 1 every source has exactly ``budget``). Give one of the two.
    Sources without tokens get no quota. Quotas are whole tokens, cut off from the share itself, so a small source
    keeps its own however large the others are; with exponent 1 they are counted in decimals, ``budget`` times the
    source's tokens. The number of sources is that of a configuration, so their shares
    fit one row; the documents behind them are aggregated before.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("give either entropy or repeats")
    some = sources.where("tokens > 0")
    row = some.agg(F.array_sort(F.collect_list("tokens")).alias("all"), F.sum("tokens").alias("total"))
    share = lambda a: F.transform("all", lambda t: F.pow(t / F.col("total"), a))
    added = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)

    def meets(a: Column) -> Column:
        powers = share(a)
        if repeats is not None:
            # The smallest source repeats most: its share of the budget against its tokens.
            least = F.element_at("all", 1)
            return F.pow(least / F.col("total"), a) / added(powers) * F.col("total") * budget / least <= F.lit(float(max(repeats, budget)))
        z = added(powers)
        h = F.log(z) - added(F.transform(powers, lambda p: p * F.log(p))) / z
        return h >= F.lit(float(entropy)) * F.log(F.size("all").cast("double")) - F.lit(1e-12)

    # `good` meets the target: for repeats from above (1 always does), for entropy from below (0 always does).
    good, bad = (1.0, 0.0) if repeats is not None else (0.0, 1.0)
    halved = row.select("all", "total", F.when(meets(F.lit(bad)), F.lit(bad)).otherwise(F.lit(good)).alias("good"), F.lit(bad).alias("bad"))
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(HALVINGS)),
        F.struct(F.col("good").alias("good"), F.col("bad").alias("bad")),
        lambda s, _: F.when(meets((s["good"] + s["bad"]) / 2), F.struct(((s["good"] + s["bad"]) / 2).alias("good"), s["bad"].alias("bad"))).otherwise(F.struct(s["good"].alias("good"), ((s["good"] + s["bad"]) / 2).alias("bad"))),
    )
    both = let(F.round(step["good"], PLACES), lambda a: F.struct(a.alias("exponent"), added(share(a)).alias("z")))
    solved = halved.select("total", both.alias("both")).select("total", "both.exponent", "both.z")
    power = F.pow(F.col("tokens") / F.col("total"), F.col("exponent"))
    as_found = F.floor(F.col("tokens").cast("decimal(19, 0)") * F.lit(Decimal(str(budget))))
    # The product comes first: equal sources divide a budget that is a multiple of their number without a remainder.
    quota = F.when(F.col("exponent") == 1, as_found).otherwise(F.floor(F.col("total") * budget * power / F.col("z"))).cast("long")
    out = some.crossJoin(F.broadcast(solved.select("total", "exponent", "z")))  # solved is one row
    return out.select("source", "tokens", "exponent", (power / F.col("z")).alias("weight"), quota.alias("quota"))


def mix(docs: DataFrame, budget: float = 1.0, entropy: float | None = None, repeats: float | None = None, seed: str = "mix", digits: int = BLOCK_DIGITS) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` in the target proportions: its columns, ``pass`` and ``n_tokens``.

    A source with quota ``q`` and ``t`` tokens appears in ``q div t`` whole passes and in a last one, which
    takes its documents in the order of the pass's permutation as long as their running total stays within
    the rest. Documents of no words are kept in every whole pass of their source, in the last one if their
    place comes before the end; sources without any words are kept once, as nothing can be weighed there.
    A null source is a source of its own; rows without a doc_id go by their texts. Rows of equal doc_id enter
    a last pass together. Columns named pass or n_tokens are replaced. An empty table gives an empty one.

    The running totals are summed in two steps, blocks of a hash first, so a source that holds most rows
    is spread over ``16 ** digits`` groups.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    names = [c for c in docs.columns if c not in ("pass", "n_tokens")]
    key = F.coalesce(F.col("source"), F.lit("\u0000"))
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    lean = docs.select(own.alias("_id"), key.alias("_source"), n_words(F.col("text")).alias("n_tokens"))
    sized = scratch.save(lean)
    totals = sized.groupBy(F.col("_source").alias("source")).agg(F.sum("n_tokens").alias("tokens"))
    plan = scratch.save(weights(totals, budget, entropy, repeats))
    quota = totals.select("source").join(plan.select("source", "quota", "tokens"), "source", "left").select(F.col("source").alias("_source"), F.coalesce("quota", F.lit(1)).alias("quota"), F.coalesce("tokens", F.lit(1)).alias("tokens"))
    # A written table: Spark broadcasts it while its size allows, and else shuffles.
    quota = scratch.save(quota)

    # One entry for each block of the last pass and source: before it lies what earlier blocks hold.
    with_pass = sized.join(quota, "_source").withColumn("pass", F.expr("quota div tokens"))
    hashed = F.md5(F.concat_ws("|", F.lit(seed), F.col("pass").cast("string"), "_id"))
    last = with_pass.where("quota % tokens > 0").withColumn("_h", hashed).withColumn("_block", F.substring("_h", 1, digits))
    blocks = last.groupBy("_source", "_block").agg(F.sum("n_tokens").alias("held"))
    before = F.sum("held").over(Window.partitionBy("_source").orderBy("_block")) - F.col("held")
    blocks = blocks.select("_source", "_block", before.alias("before"), "held")
    ending = blocks.join(quota, "_source").select("_source", "_block", "before", (F.col("before") + F.col("held") <= F.expr("quota % tokens")).alias("whole"), F.expr("quota % tokens").alias("room")).where("before <= room")
    # Whole blocks need no order; only the block in which a source's budget ends is sorted.
    taken = last.join(ending, ["_source", "_block"])
    within = Window.partitionBy("_source", "_block").orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = taken.where("not whole").withColumn("running", F.col("before") + F.sum("n_tokens").over(within)).where("running <= room")
    partial = taken.where("whole").select("_source", "_id", "pass").union(cut.select("_source", "_id", "pass")).distinct()
    partial = scratch.save(partial)

    # Columns that the rows carry through the joins have names that no column of the input has.
    i, k = fresh(docs, "_id"), fresh(docs, "_source")
    rows = docs.drop("pass", "n_tokens").withColumns({i: own, k: key, "n_tokens": n_words(F.col("text"))})
    passes, out = fresh(docs, "_passes"), [*names, F.col("pass").cast("long").alias("pass"), "n_tokens"]
    full = rows.join(quota.select(F.col("_source").alias(k), F.expr("quota div tokens").alias(passes)), k).where(F.col(passes) > 0)
    full = full.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col(passes) - 1))).select(*out)
    return full.union(rows.join(partial.select(F.col("_id").alias(i), F.col("_source").alias(k), "pass"), [i, k]).select(*out))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def positions(mixed: DataFrame, seed: str = "mix", digits: int = BLOCK_DIGITS, digest: str | None = None) -> DataFrame:
    """Rows of :func:`mix` with ``position``: the row's place, from 0, in the permutation of its source's pass.

    Each pass has a permutation of its own: the order of a keyed hash, whose first digits are the block. Blocks are
    counted, a sum over the blocks before it gives a block's first place, and rows are ordered within blocks only. The last
    pass takes its rows from the beginning of its permutation, so its places have no gaps either. Rows of equal doc_id
    follow each other in the order of their texts. A column named position is replaced.
    ``digest`` may name a column with the texts' ``xxhash64``, taken before the mix, so that no text passes through its joins.
    """
    text = F.col(digest) if digest else F.xxhash64("text")
    names = [c for c in mixed.columns if c != "position"]
    h, i, t, k, b, n = (fresh(mixed, c) for c in ("_h", "_id", "_t", "_source", "_block", "_before"))
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), text.cast("string")))
    hashed = F.md5(F.concat_ws("|", F.lit(seed), F.col("pass").cast("string"), own))
    rows = mixed.select(*names, F.coalesce(F.col("source"), F.lit("\u0000")).alias(k), hashed.alias(h), own.alias(i), text.alias(t))
    rows = rows.withColumn(b, F.substring(h, 1, digits))
    block = [k, "pass", b]
    counts = Scratch(mixed.sparkSession).save(rows.groupBy(*block).agg(F.count("*").alias("held")))
    before = F.sum("held").over(Window.partitionBy(k, "pass").orderBy(b)) - F.col("held")
    placed = rows.join(counts.select(*block, before.alias(n)), block)
    within = F.row_number().over(Window.partitionBy(*block).orderBy(h, i, t))
    return placed.select(*names, (F.col(n) + within - 1).alias("position"))
