"""Progressive alignment: optimal for two forms, near it for three, properties of groups, blocks, costs, source alignments."""

import itertools
import random
from collections import Counter
from functools import cache

import pytest

from lexloom.operators import alignment
from lexloom.operators.progressive import Costs, align_forms, align_profiles, class_costs

FORM = "concept_id string, cognate_set_id string, form_id int, variety_id string, segments array<string>"
VOWELS = class_costs(dict.fromkeys("aei", "V") | dict.fromkeys("ptk", "C"))


def single(form):
    return [{t: 1} for t in form]


def total(rows, costs):
    """Cost of an alignment: of all pairs of its rows, column by column."""
    return sum(costs.of(x or "", y or "") for a, b in itertools.combinations(rows, 2) for x, y in zip(a, b, strict=True))


def least(forms, costs):
    """The least cost of any alignment, by trying all of them."""

    @cache
    def best(*at):
        if all(i == len(f) for i, f in zip(at, forms, strict=True)):
            return 0
        options = []
        for step in itertools.product((0, 1), repeat=len(forms)):
            if any(step) and all(i + s <= len(f) for i, s, f in zip(at, step, forms, strict=True)):
                column = [f[i] if s else None for i, s, f in zip(at, step, forms, strict=True)]
                options.append(total([[c] for c in column], costs) + best(*[i + s for i, s in zip(at, step, strict=True)]))
        return min(options)

    return best(*[0] * len(forms))


def rows_of(forms, costs):
    places, whole = align_profiles([single(f) for f in forms], costs)
    rows = [[f[p] if p >= 0 else None for p in own] for f, own in zip(forms, places, strict=True)]
    assert whole == [dict(Counter(c or "" for c in column)) for column in zip(*rows, strict=True)]
    assert all([t for t in r if t] == list(f) for r, f in zip(rows, forms, strict=True))
    assert all(any(column) for column in zip(*rows, strict=True))
    return rows


@pytest.mark.parametrize("costs", [Costs(), VOWELS, Costs(gap=300, unequal=1000)])
def test_two_and_three_forms(costs):
    rng, near = random.Random(4), 0
    for _ in range(60):
        forms = ["".join(rng.choice("aeptk") for _ in range(rng.randrange(0, 6))) for _ in range(3)]
        assert total(rows_of(forms[:2], costs), costs) == least(forms[:2], costs)
        found, best = total(rows_of(forms, costs), costs), least(forms, costs)
        assert found >= best
        near += found == best
    assert near >= 48


def test_costs_decide():
    assert rows_of(["pat", "et"], VOWELS) == [["p", "a", "t"], [None, "e", "t"]]
    cheap = Costs(table={("p", "e"): 100})
    assert rows_of(["pat", "et"], cheap)[1][0] == "e"
    assert cheap.of("e", "p") == 100 and cheap.of("p", "p") == 0 and cheap.of("", "p") == 1000
    # Neighbours are joined first: the odd one out takes the gaps.
    assert rows_of(["kata", "kta", "kata"], Costs())[1] == ["k", None, "t", "a"]


def test_groups_in_blocks(spark):
    """Groups that take several levels of blocks keep the properties of an alignment."""
    rng = random.Random(9)
    base = "kapitea"
    forms = {"".join(c for c in base if rng.random() < 0.8) + rng.choice(["", "a", "t"]) for _ in range(90)} | {""}
    rows = [(c, s, list(f)) for c, s in (("c", "s"), ("c", None)) for f in (forms if s else list(forms)[:3])]
    df = spark.createDataFrame(rows + rows[:5], "concept_id string, cognate_set_id string, segments array<string>")
    for size in (4, 64):
        got = align_forms(df, size=size).collect()
        assert len(got) == len(rows)
        for key in ("s", None):
            mine = [r for r in got if r.cognate_set_id == key]
            assert len({len(r.aligned) for r in mine}) == 1 and len(mine[0].aligned) <= 16
            assert all([t for t in r.aligned if t is not None] == r.segments for r in mine)
            assert all(any(c) for c in zip(*[r.aligned for r in mine], strict=True))
    assert align_forms(df.where("false")).collect() == []


def test_source_alignments(spark):
    rows = [
        ("c", "given", 1, "a", list("pa"), ["p", "-", "a"]), ("c", "given", 2, "b", list("fa"), ["-", "f", "a"]),
        ("c", "uneven", 3, "a", list("pa"), ["p", "a"]), ("c", "uneven", 4, "b", list("a"), ["-", "-", "a"]),
        ("c", "wrong", 5, "a", list("pa"), ["p", "o"]), ("c", "wrong", 6, "b", list("pa"), ["p", "a"]),
        ("c", "none", 7, "a", list("pa"), None), ("c", "none", 8, "b", list("a"), ["-", "a"]),
    ]
    df = spark.createDataFrame(rows, FORM + ", alignment array<string>")
    got = {r.form_id: r.aligned for r in alignment.align_groups(df).collect()}
    assert got == {
        1: ["p", None, "a"], 2: [None, "f", "a"], 3: ["p", "a"], 4: [None, "a"], 5: ["p", "a"], 6: ["p", "a"], 7: ["p", "a"], 8: [None, "a"],
    }
    anchors = spark.createDataFrame([("c", None, 50, None, list("pfa")), ("c", "none", 51, None, list("po")), ("d", None, 52, None, ["x"])], FORM)
    got = alignment.align_groups(df, anchors).collect()
    assert sorted((r.cognate_set_id, r.form_id) for r in got if r.is_anchor) == [("given", 50), ("none", 50), ("none", 51), ("uneven", 50), ("wrong", 50)]
    assert all(len(r.alignment_id.split(":")[0]) == 16 for r in got)
