"""Reading wordlist files: layouts, quotes, metadata, lines of rejects; bad lines of logs; a stream of files."""

import json

import pytest
from pyspark.errors import PySparkException

from lexloom.sources import files, wordlists
from lexloom.streaming import events


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.fixture
def wordlist(tmp_path):
    root = tmp_path / "all my lists"
    put(root, "one/languages.csv", "ID,Name,Glottocode,Family,historical\nA,Name of A,lang1234,Fixture,false\nB,,lang1235,Fixture,TRUE\n")
    put(root, "one/parameters.csv", "ID,Name,Concepticon_ID,Concepticon_Gloss\nwater,water,948,WATER\nfire,fire,,\n")
    put(root, "one/forms.csv", 'ID,Language_ID,Parameter_ID,Form,Segments\nf1,A,water,pa,p a\nf2,B,water,"fa, ""raw""\nsecond line",f a + t i\nf3,A,fire,x,\nf4,Z,fire,x,x\n')
    put(root, "one/cognates.csv", "ID,Form_ID,Cognateset_ID,Segment_Slice,Alignment\nc1,f1,w1,,p a\n,f2,w1,2,f - a\nc3,f2,w2,9,\nc4,f3,w2,,\n")
    # Other order, other columns, part files, no parameters, and metadata that names the files and the unit of slices.
    put(root, "two+/cldf/varieties.csv", "historical,family,Latitude,ID\nno,F,1.5,A\n")
    put(root, "two+/cldf/forms.csv/part-0.csv", "Phonemic_Segments,Cognateset_ID,Parameter_ID,Language_ID,ID\nk u +  n,s1; s2,dog,A,g1\n")
    put(root, "two+/cldf/forms.csv/part-1.csv", "ID,Language_ID,Parameter_ID,Phonemic_Segments,Segments,Cognateset_ID\ng2,A,dog,b b,,s1\n")
    put(root, "two+/cldf/cognates.csv", "Cognateset_ID,Form_ID,ID,Segment_Slice,Doubt\ns3,g2,d1,2,True\n")
    tables = [{"url": "varieties.csv", "dc:conformsTo": "http://cldf.clld.org/v1.0/terms.rdf#LanguageTable"}]
    slices = {"name": "Segment_Slice", "propertyUrl": files.SEGMENT_SLICE}
    tables += [{"url": "cognates.csv", "dc:conformsTo": "http://cldf.clld.org/v1.0/terms.rdf#CognateTable", "tableSchema": {"columns": [slices]}}]
    put(root, "two+/cldf/cldf-metadata.json", json.dumps({"tables": tables}))
    return root


def test_columns_by_header(spark, wordlist):
    got = wordlists.read_wordlist(spark, str(wordlist))
    assert rows(got["forms"], "form_id", "variety_id", "concept_id", "segments", "cognate_set_id", "segment_source", "source_file", "source_row") == [
        ("one:f1", "one:A", "948", ["p", "a"], "one:w1", "Segments", "one/forms.csv", 2),
        ("one:f2", "one:B", "948", ["f", "a", "+", "t", "i"], None, "Segments", "one/forms.csv", 3),
        ("two+:g1", "two+:A", "two+:dog", ["k", "u", "+", "n"], None, "Phonemic_Segments", "two+/cldf/forms.csv/part-0.csv", 2),
        ("two+:g2", "two+:A", "two+:dog", ["b", "b"], None, "Phonemic_Segments", "two+/cldf/forms.csv/part-1.csv", 2),
    ]
    assert rows(got["varieties"], "variety_id", "name", "family", "is_historical") == [("one:A", "Name of A", "Fixture", False), ("one:B", "B", "Fixture", True), ("two+:A", "A", "F", False)]
    assert rows(got["concepts"], "concept_id", "gloss") == [("948", "WATER")]
    found = rows(got["memberships"], "membership_id", "cognate_set_id", "scope", "interpretation", "segment_indices", "alignment", "doubt", "source_row")
    assert found == [
        ("one:cognate-membership:c1", "one:w1", "whole_form", "asserted", [], ["p", "a"], None, 2),
        ("one:cognate-membership:row-3", "one:w1", "segment_slice", "partial_cognate", [3, 4], ["f", "-", "a"], None, 3),
        ("two+:cognate-membership:d1", "two+:s3", "segment_slice", "partial_cognate", [1], [], True, 2),
        ("two+:form-membership:g1:1", "two+:s1", "whole_form", "alternative_analysis", [], [], None, 2),
        ("two+:form-membership:g1:2", "two+:s2", "whole_form", "alternative_analysis", [], [], None, 2),
        ("two+:form-membership:g2:1", "two+:s1", "whole_form", "asserted", [], [], None, 2),
    ]
    assert rows(got["rejects"], "membership_id", "error", "source_file", "source_row") == [("one:cognate-membership:c3", "outside", "one/cognates.csv", 4)]


@pytest.mark.parametrize(
    "name, text, message",
    [
        ("one/languages.csv", None, "no table of languages"),
        ("one/forms.csv", "ID,Language_ID,Parameter_ID,Form,Cognateset_ID\nf1,A,water,pa,w\n", "raw spelling is not split"),
        ("one/cognates.csv", None, "neither a table of cognates"),
    ],
)
def test_datasets_that_lack_tables(spark, wordlist, name, text, message):
    (wordlist / name).unlink()
    if text:
        put(wordlist, name, text)
    with pytest.raises(ValueError, match=message):
        wordlists.read_wordlist(spark, str(wordlist))


def test_lines_of_large_files(spark, tmp_path):
    """Numbers run on over the blocks in which a file is read, and start anew with each file."""
    for name, n in (("a.txt", 5000), ("b.txt", 3), ("c.txt", 1)):
        put(tmp_path, f"in/{name}", "".join(f"{i} of {name}\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        from pyspark.sql import functions as F

        got = files.numbered(spark.read.text(str(tmp_path / "in")), F.col("_metadata.file_name")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 5004 and all(r.value == f"{r.source_row} of {r.source_file}" for r in got)


def test_bad_lines(spark, tmp_path):
    put(tmp_path, "log/a.jsonl", '{"a": 1}\n\n{"a": \n[2]\n{"a": 3}\n{"a": "x"}\n')
    good, bad = wordlists.read_events(spark, str(tmp_path / "log"), "a long")
    assert rows(good, "a") == [(1,), (3,)]
    assert rows(bad, "source_row", "value") == [(3, '{"a": '), (4, "[2]"), (6, '{"a": "x"}')]
    with pytest.raises(PySparkException, match=r"a\.jsonl line [346]"):
        wordlists.read_trajectories(spark, str(tmp_path / "log"), "a long").collect()


def test_stream_over_three_arrivals(spark, tmp_path):
    """Files that come in three batches are taken in once each, and give what one batch read gives."""
    lines, out = tmp_path / "lines", str(tmp_path / "out")
    for i in range(3):
        put(lines, f"{i}.jsonl", f'{{"kind": "k{i}"}}\n{{"kind": "both"}}\nbroken {i}\n')
        good, bad = events.stream_json_lines(spark, str(lines), "kind string", out)
        again = events.stream_json_lines(spark, str(lines), "kind string", out)[0]
        want, wrong = wordlists.read_events(spark, str(lines), "kind string")
        assert rows(good, "kind") == rows(again, "kind") == rows(want, "kind")
        assert rows(bad, "value") == rows(wrong, "value") and bad.count() == i + 1


def test_runs_without_results(spark, tmp_path):
    put(tmp_path, "runs/r1/trajectories.jsonl", '{"a": 1}\n')
    put(tmp_path, "runs/r2/trajectories.jsonl", '{"a": 2}\n')
    read = lambda: rows(wordlists.read_runs(spark, str(tmp_path / "runs"), "a long", "n long"), "run", "a", "result.n")
    assert read() == [("r1", 1, None), ("r2", 2, None)]
    put(tmp_path, "runs/r2/result.json", '{"n": 5}\n')
    assert read() == [("r1", 1, None), ("r2", 2, 5)]
