"""Long texts, wide numbers, clashing columns, missing ids and repeated rows."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import bit_sliced, decontaminate, jaccard_join, mixing, quality, repeats, secrets, url_filter


@pytest.mark.parametrize("text", ["a" * 400_000 + "=", "a=" * 200_000, "x = 'q' + " * 100_000, "k9" * 200_000, "password" + " " * 300_000 + "x", '"' * 300_000 + "=1", "-" * 300_000])
def test_lexing_is_linear(text):
    began = time.process_time()
    secrets.all_spans(text)
    assert time.process_time() - began < 8


def test_constants_are_shared():
    lines = ["v0 = 'Zx81kLmQ9aB'"] + [f"v{i + 1} = v{i} + v{i}" for i in range(300)] + ["secret_key = v300"]
    text = "\n".join(lines)
    began = time.process_time()
    assert [text[a:b] for a, b in secrets.lexed(text)] == ["Zx81kLmQ9aB"]
    assert time.process_time() - began < 5
    chain = "\n".join(["c0 = 'Zx81kLmQ9aB'"] + [f"c{i + 1} = c{i} + 'p{i}'\ntoken{i} = c{i}" for i in range(3000)])
    assert len(secrets.lexed(chain)) == 3000
    assert time.process_time() - began < 10


def test_scan_of_odd_rows(spark):
    rows = [(1, "password = hunter22hunter", 5), (1, "password = hunter22hunter", 5), (None, "", 1), (2, None, 2)]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()
    assert sorted((r.doc_id or 0, r.n_assign) for r in found) == [(0, 0), (1, 1), (1, 1), (2, 0)]


def test_wide_components(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0**40, 1.0]), (2, [-(2.0**40), 3.0]), (3, [1e308, 1.0]), (4, [0.5, float("inf")]), (5, [1.0, 1.0])]
    got = bit_sliced.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=9).orderBy("rank").collect()
    q = (64, 128)
    want = sorted(((q[0] * int(64 * a) + q[1] * int(64 * b), -i) for i, (a, b) in rows if i in (1, 2, 5)), reverse=True)
    assert [(r.score, -r.vec_id) for r in got] == want
    big = spark.createDataFrame([(0, [2.0**60, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="2\\*\\*62"):
        bit_sliced.top_k(big, F.col("vec_id") == 0).collect()


def test_own_columns_of_the_classifier(spark):
    rows = [(i, ("good words of prose " if i % 2 else "!!! $$$ ### ") * 5, 7.5, "mine", i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string, held_out int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    kept = quality.keep_accepted(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [r for r in rows if r[0] % 2]
    scored = quality.classify(docs, labels, docs.columns)
    assert scored.columns == ["doc_id", "text", "score", "held_out", "predicted"] and scored.where("score = 7.5").count() == 0


def test_mixing_without_ids(spark):
    rows = [(None, f"w{i} x y", "a") for i in range(40)] + [(i, "p q r s", "b") for i in range(10)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), budget=0.5, repeats=1.0)
    tokens = {r.source: r.n for r in got.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert tokens == {"a": 39, "b": 40}  # 40 each: the rows without an id enter the last pass of their source


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = [(1, "x" + shared + "1"), (1, "x" + shared + "1"), (2, "y" + shared + "2"), (None, shared), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in repeats.remove_repeats(docs, keep="first").collect())
    assert got == [(1, 0), (1, 0), (2, 900), (3, 0)]
    both = sorted((r.doc_id, r.n_removed) for r in repeats.remove_repeats(docs, keep="none").collect())
    assert both == [(1, 902), (1, 902), (2, 900), (3, 0)]


@pytest.mark.parametrize("group", [1, 2, 2000])
def test_split_groups(spark, monkeypatch, group):
    """The same spans however early groups are split, on a text longer than a piece."""
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = np.random.default_rng(4)
    core = rng.integers(97, 105, 700).astype(np.uint8).tobytes().decode()
    texts = [rng.integers(97, 123, k).astype(np.uint8).tobytes().decode() + core[i % 50 : 700 - i % 30] + "z" * (i % 3) for i, k in enumerate(rng.integers(0, 60, 40))]
    texts.append("ab" * 300_000 + core + "ab" * 300_000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs, keep="none").collect()}
    seen: dict[str, int] = {}
    for t in texts:
        for p in range(len(t) - 399):
            seen[t[p : p + 400]] = seen.get(t[p : p + 400], 0) + 1
            if len(t) > 10_000 and 2000 < p < len(t) - 3000 and not 598_000 < p < 602_000:
                seen[t[p : p + 400]] = 2  # the long run repeats itself
    for i, t in enumerate(texts):
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - 399):
            if seen[t[p : p + 400]] > 1:
                gone[p] += 1
                gone[p + 400] -= 1 if p + 400 <= len(t) else 0
        flags = np.cumsum(gone[:-1]) > 0
        assert got[i] == (int(flags.sum()), int((np.diff(np.concatenate([[0], flags.astype(int)])) == 1).sum())), i


def test_long_rules_and_many_keys(spark):
    path = "/" + "a" * 100
    rules = spark.createDataFrame([("org", path, "block"), ("org", "/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, f"http://x.org{path}/b", 3), (2, "http://x.org/a", 3), (3, None, 3)], "page_id long, url string, verdict int")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules, pages.limit(0).select("url")).collect()}
    assert got == {1: ("org" + path, "block"), 2: ("org/", "allow"), 3: (None, "allow")}
    assert url_filter.blocks_for(10_000_000) * 16 >= 5_000_000
    keys = spark.range(40_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    blocks = url_filter.blocks_for(40_000)
    strangers = spark.range(20_000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("key"))
    bloom = url_filter.bloom_table(keys, "key", blocks)
    assert url_filter.possible(keys, "key", bloom, blocks).count() == 40_000
    assert url_filter.possible(strangers, "key", bloom, blocks).count() < 2_000


def test_long_text_in_the_join(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(300_000)]
    other = words[:150_000] + ["new"] + words[150_000:]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:200_000]))], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(docs, 3, 90).collect()) == [(1, 1), (2, 1), (3, 3)]


CLASHES = "doc_id long, text string, source string, _id string, _source string, _h string, _block string, _row string, _leak string, position string, codes string, seed string, item_id string, n_words int"


def clashing(spark, rows):
    """``(doc_id, text, source)`` with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, *[f"{c}{i}" for c in "abcdefghij"], i) for i, r in enumerate(rows)], CLASHES)


def test_mixing_keeps_clashing_columns(spark):
    rows = [(i, "w " * (1 + i % 5), "a" if i % 3 else None) for i in range(40)] + [(None, "x y z", "b"), (None, "x y z", "b"), (50, None, "a"), (51, "", "c"), (52, "long " * 60_000, "d")]
    docs = clashing(spark, rows)
    mixed = mixing.mix(docs, repeats=2.0)
    assert mixed.columns == [*docs.columns, "pass", "n_tokens"]
    given = {tuple(r) for r in docs.collect()}
    assert {tuple(r)[: len(docs.columns)] for r in mixed.collect()} <= given
    assert mixing.mix(docs.where("false"), repeats=2.0).collect() == []


def test_every_pass_is_a_permutation(spark):
    rows = [(i, "w " * (1 + i % 3), "big") for i in range(60)] + [(100 + i, "p q", "small") for i in range(20)] + [(None, "same", "small")] * 3
    mixed = mixing.positions(mixing.mix(clashing(spark, rows), budget=2.5, repeats=4.0), digits=1)
    passes = {}
    for r in mixed.collect():
        passes.setdefault((r.source, r["pass"]), []).append((r.position, r.doc_id))
    orders = {k: [d for _, d in sorted(p, key=lambda x: x[0])] for k, p in passes.items()}
    assert all(sorted(p for p, _ in v) == list(range(len(v))) for v in passes.values())
    big, small = ([o for (source, _), o in sorted(orders.items()) if source == name] for name in ("big", "small"))
    assert sorted(big[0]) == list(range(60)) and big[0] != list(range(60))
    whole = [o for o in small if len(o) == 23]
    assert len(whole) > 1 and whole[0] != whole[1] and sorted(map(str, whole[0])) == sorted(map(str, whole[1]))
    assert len(orders) == len(passes) and mixing.positions(mixed.where("false")).collect() == []


def test_contaminated_rows_with_clashing_columns(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, f"so {item} it goes", "s"), (2, "clean words here", "s"), (None, f"also {item}", "s"), (None, "clean too", "s"), (3, None, None), (3, None, None), (4, "x " * 300_000 + item, "s")]
    docs = clashing(spark, rows)
    benchmark = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    kept = decontaminate.remove_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect() if r.doc_id) == [tuple(r) for r in docs.collect() if r.doc_id in (2, 3)]
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["clean too"]
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, benchmark).collect()} == {(1, 7), (4, 7)}
    assert decontaminate.remove_contaminated(docs.where("false"), benchmark).collect() == []
    assert decontaminate.remove_contaminated(docs, benchmark.where("false")).count() == len(rows)


def test_items_of_few_words(spark):
    """Items of one to four words are found word for word, as wholes."""
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "b, C; d"), (3, "c b a"), (4, "e"), (5, "b c x")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "e"), (2, "b c"), (3, "B c d"), (4, "a b c d"), (5, "q")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_equal, r.n_words) for r in decontaminate.overlaps(docs, items).collect())
    assert got == [(1, 1, 1, 1), (1, 2, 2, 2), (1, 3, 3, 3), (1, 4, 4, 4), (2, 2, 2, 2), (2, 3, 3, 3), (4, 1, 1, 1), (5, 2, 2, 2)]
