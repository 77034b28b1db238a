"""URL filters: a blocked Bloom filter of listed canonical keys, then an exact hash join.

The list holds keys of two kinds: canonical URLs, and (host, path) rules. A key sets ``BITS`` bits in one
block of four 64-bit words; the filter is a table with a row for every ``PER_BLOCK`` keys, broadcast while
it is small, which is checked. Keys that pass join the list itself, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Keys a block is meant for: with 256 bits for them, about one stranger in a hundred passes.
PER_BLOCK = 16
#: Rows of a filter that is broadcast, at most (40 bytes each); a larger one is shuffled.
BROADCAST_BLOCKS = 1 << 18
BITS = 6


def blocks_for(keys: int) -> int:
    """Blocks of a filter of so many keys: a power of two."""
    return 1 << max(8, (keys // PER_BLOCK).bit_length())


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^?#]*)", 1)
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.substring(rest, F.length(host) + 1, F.length(rest))


def canonical(url: Column) -> Column:
    """Canonical URL: host lower-cased without ``www.``, path without trailing slash, no scheme, query or fragment."""
    host, path = host_path(url)
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks))


def _words(key: Column) -> list[Column]:
    """The key's bits, as four words."""
    h = F.xxhash64(key, F.lit(1))
    at = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(255)) for i in range(BITS)]
    word = lambda w: [F.when(F.shiftright(a, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), a.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")) for a in at]
    out = []
    for w in range(4):
        bits = word(w)
        total = bits[0]
        for b in bits[1:]:
            total = total.bitwiseOR(b)
        out.append(total)
    return out


def bloom_table(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """``block, w0..w3``: at most ``blocks`` rows, built with map-side combine."""
    bits = keys.where(F.col(column).isNotNull()).select(_block(F.col(column), blocks).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(_words(F.col(column)))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def possible(rows: DataFrame, column: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key may be listed: no listed key is lost, some others pass."""
    marked = rows.withColumn("_block", _block(F.col(column), blocks))
    joined = marked.join(F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom, marked["_block"] == bloom["block"])
    test = F.lit(True)
    for i, w in enumerate(_words(F.col(column))):
        test = test & (w.bitwiseAND(F.col(f"w{i}")) == w)
    return joined.where(test).select(*rows.columns)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """Verdict for each of ``pages(page_id, url)``: ``page_id, host, path, rule, verdict, listed``.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains if the path starts with the
    rule's; the longest wins (host and path together; then by host, path and verdict, block before allow). Without a rule, a page whose
    canonical URL is in ``listed(url)`` is blocked, any other allowed.

    Every page gives one key for each host suffix and each path length that the rules have; the keys that
    pass the filter of all rules join the rules. Null urls and urls without ``://`` have an empty host and path, no rule, and are
    allowed. Rows of equal page_id are judged one by one; other columns are ignored. Empty tables of pages,
    rules or listed URLs are valid.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rules = rules.select(F.lower("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    ruled = rules.select(F.concat_ws("\u001f", "r_host", "r_path").alias("key"), "r_host", "r_path", "r_verdict")
    ruled = ruled.where(F.col("r_host").isNotNull() & F.col("r_path").isNotNull())
    lengths = ruled.agg(F.array_sort(F.collect_set(F.length("r_path"))).alias("lengths"))

    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keyed = base.select("url", "host", "path").where("host <> ''").distinct().crossJoin(F.broadcast(lengths))
    keyed = keyed.select("url", "host", "path", F.explode(suffixes).alias("suffix"), "lengths")
    keyed = keyed.select("url", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"), "path")
    keyed = keyed.select("url", F.concat_ws("\u001f", "suffix", F.expr("substring(path, 1, n)")).alias("key"))
    blocks = blocks_for(ruled.count())
    hits = possible(keyed, "key", bloom_table(ruled, "key", blocks), blocks).join(ruled, "key")
    order = F.struct(F.length("r_host") + F.length("r_path"), F.col("r_host"), F.col("r_path"), F.col("r_verdict"))
    best = hits.groupBy("url").agg(F.max(order).alias("best")).select("url", F.concat("best.r_host", "best.r_path").alias("rule"), F.col("best.r_verdict").alias("r_verdict"))

    names = listed.select(canonical(F.col("url")).alias("canon")).where("canon <> ''").distinct()
    urls = base.select("url", canonical(F.col("url")).alias("canon")).where("canon <> ''").distinct()
    blocks = blocks_for(names.count())
    on_list = possible(urls, "canon", bloom_table(names, "canon", blocks), blocks).join(names, "canon", "left_semi").select("url", F.lit(True).alias("listed"))
    found = best.join(on_list, "url", "full")
    verdict = F.coalesce("r_verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return base.join(found, "url", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed"))
