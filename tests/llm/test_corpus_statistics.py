"""Source divergences and collocations: against plain versions, odd inputs, and counts beyond 64 bits."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import collocations, divergence

DOCS = "doc_id long, text string, lang string, source string, n string, term string, reached string, blocks string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def frame(spark, rows, parts=3):
    """``(text, lang, source)`` as documents, with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, *r, "x", "y", "z", "w") for i, r in enumerate(rows)], DOCS).repartition(parts)


def plain_divergences(rows, min_docs=3, top=200):
    rows = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(t)), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == lang]
        docs = Counter(t for words, _, _ in mine for t in set(words))
        kept = {t for t, n in docs.items() if n >= min_docs}
        counts = defaultdict(Counter)
        for words, _, source in mine:
            counts[source].update(w for w in words if w in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in p:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in p if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                best = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(best, 1)]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeéß" for b in ("lo", "MI", "su", "Üx", "")]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", None, "z"])
        line = [rng.choice(words[: rng.choice([4, 12, 35])]) + rng.choice(["", "", "", ",", ".", "\n", "\t", " 3"]) for _ in range(rng.randrange(0, 60))]
        rows.append((" ".join(line), lang, source))
    return rows


ODD = [(None, "en", "s0"), ("", "xx", "only"), ("... 12 !!", "xx", "two"), ("lone words here", "yy", "s"), ("A\x00b İ ı K", "en", "s1"), ("word " * 30_000, "en", "s2")]


@pytest.mark.parametrize("terms, sources", [(384, 48), (3, 2)])
def test_divergences(spark, terms, sources):
    rows = texts(1, 120) + ODD + [("same text again", "en", "s1")] * 40
    found = divergence.divergences(frame(spark, rows), terms=terms, sources=sources)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == plain_divergences(rows)


def test_divergences_top_and_empty(spark):
    rows = texts(2, 60)
    found = divergence.divergences(frame(spark, rows), min_docs=1, top=5)
    assert sorted(map(tuple, found.collect())) == plain_divergences(rows, 1, 5)
    assert divergence.divergences(frame(spark, rows).where("doc_id < 0")).collect() == []


def test_shares_of_large_counts(spark):
    """Products beyond 64 bits stay exact."""
    c, n, v = 9 * 10**15, 10**16 + 7, 12345
    got = spark.range(1).select(divergence._share(F.lit(c), F.lit(n), F.lit(v)).cast("string")).first()[0]
    assert int(got) == 1 + 10**9 * (c + 1) // (n + v)
    assert divergence._prices(np.array([c]), n, v)[0] == int(got)


def plain_collocations(rows, min_count=30, top=2000, absorb=80):
    f, n = defaultdict(Counter), Counter()
    for text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        gone = {p[i : i + k] for p, a in cands.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= absorb * cands[p[i : i + k]]}
        best = []
        for p, a in cands.items():
            if p not in gone:
                score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def test_collocations(spark, monkeypatch):
    rows = texts(3, 400) + ODD + [("one two three four five, six", "en", "s")] * 50 + [("tie, tie tie tie. tie", None, "s")] * 20
    want = plain_collocations(rows)
    assert sum(len(r[2].split()) == 4 for r in want) >= 3
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows)).collect())) == want
    # Filters that let almost anything pass, and tasks that count every few texts, change nothing.
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)
    monkeypatch.setattr(collocations, "HELD", 500)
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows, 5)).collect())) == want


def test_phrases_that_start_late(spark):
    """Words that reach the threshold only in the last shard: their phrases start a cycle after the first ones."""
    rows = [("aa bb cc dd", "en", "s") if i % 40 else ("rare pair of words", "en", "s") for i in range(1240)]
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows, 2)).collect())) == plain_collocations(rows)


def test_collocations_empty(spark):
    assert collocations.collocations(frame(spark, ODD).where("doc_id < 0")).collect() == []
    assert collocations.collocations(frame(spark, [(None, None, None), ("", "en", "s")])).collect() == []


def test_rare_pairs_are_sieved(spark, monkeypatch):
    """Frequent words in rare pairs: only the frequent pair is counted by its words; thresholds above a byte hold."""
    rows = [(f"a{i % 30} b{i // 30}", "en", "s") for i in range(900)] + [("often together", "en", "s")] * 320
    counted, merged = set(), collocations._merged

    def seen(state, found, *more):
        counted.update(r.phrase for r in found.where("words = 2").collect())
        return merged(state, found, *more)

    monkeypatch.setattr(collocations, "_merged", seen)
    for least in (30, 300):
        assert sorted(map(tuple, collocations.collocations(frame(spark, rows, 3), min_count=least).collect())) == plain_collocations(rows, least)
    assert counted == {"often together"}
