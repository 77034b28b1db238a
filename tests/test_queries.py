"""Every query of the wordlist operators against its DuckDB SQL, on the smallest tables."""

import glob
import os

import pytest

from lexloom import catalog, queries as own
from lexloom.sources import views

SF = "/root/testdata/sf0.001"


def normal(value):
    if isinstance(value, float):
        return None if value != value else round(value, 7)
    if isinstance(value, dict):  # a struct
        value = tuple(value.values())
    return tuple(map(normal, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    mine = sorted((tuple(normal(r[c]) for c in names) for r in df.collect()), key=repr)
    other = duck.sql(catalog.ORACLES[name])
    at = [other.columns.index(c) for c in names]
    assert sorted(other.columns) == names
    assert mine == sorted((tuple(normal(r[i]) for i in at) for r in other.fetchall()), key=repr)


def test_sets_and_concepts_over_all_leaves(spark):
    """The tuples and the daughters are all leaves, counted here in Python."""
    forms = views.forms(spark, SF).collect()
    leaves = sorted({f.variety_id for f in forms}, key=lambda v: int(v.split("#")[1]))
    assert len(leaves) == 25
    cells = {}
    for m in sorted(views.aligned(spark, SF).collect(), key=lambda m: m.form_id):
        for col, segment in enumerate(m.aligned):
            cells.setdefault((m.concept_id, m.cognate_set_id, col), {})[m.variety_id] = segment
    found = {}
    for (concept, _, _), by in cells.items():
        if any(by.values()):
            found.setdefault(tuple(map(by.get, leaves)), []).append(concept)
    got = {tuple(r.segments): (r.support, r.n_concepts, r.examples) for r in own.correspondence_sets(spark, SF).collect()}
    assert got == {k: (len(v), len(set(v)), sorted(set(v))[:3]) for k, v in found.items()}
    sizes = [len(v) for v in found.values()]
    assert tuple(own.correspondence_inventory(spark, SF).first()) == (len(sizes), sum(n >= 2 for n in sizes), sizes.count(1))

    gold = {(f.concept_id, f.cognate_set_id) for f in forms if f.variety_id == "Brand#25"}
    daughters = [f for f in forms if f.variety_id != "Brand#25"]
    shared, cognate = {}, {}
    for f in daughters:
        shared.setdefault(f.concept_id, set()).add(f.variety_id)
        cognate.setdefault(f.concept_id, set()).update({f.variety_id} if (f.concept_id, f.cognate_set_id) in gold else ())
    assert {tuple(r) for r in own.benchmark_concepts(spark, SF).collect()} == {(c, len(shared[c]) == 24, len(cognate[c]) == 24) for c in shared}
