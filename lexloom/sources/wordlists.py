"""Readers of wordlist tables: CSV tables of many datasets, lineages, anchors, payloads, and logs.

A dataset is a folder (or its folder ``cldf``) that holds ``languages.csv``, ``parameters.csv``, ``forms.csv`` and
``cognates.csv``, or the files that its metadata names for them (files or folders of part files); its name is the
dataset's id, and all ids are scoped by it. Columns are found by each file's own header.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from lexloom.sources import files

BOUNDARIES = ("+", "-")
# Columns read of each table, with the names that they may have in its header.
LANGUAGES = {"ID": ("ID",), "Name": ("Name",), "Glottocode": ("Glottocode",), "Family": ("Family", "family"), "historical": ("historical", "Historical")}
PARAMETERS = {c: (c,) for c in ("ID", "Name", "Concepticon_ID", "Concepticon_Gloss")}
FORMS = {c: (c,) for c in ("ID", "Language_ID", "Parameter_ID", "Segments", "Phonemic_Segments", "Cognateset_ID", "Source", "Comment")}
COGNATES = {c: (c,) for c in ("ID", "Form_ID", "Cognateset_ID", "Segment_Slice", "Alignment", "Source", "Doubt", "Comment")}
PAYLOAD = (
    "lexicons array<struct<variety_id: string, name: string, forms: array<struct<form_id: string, concept_id: string, segments: array<string>, cognate_set_id: string>>>>, "
    "concepts array<struct<concept_id: string, gloss: string>>"
)
ANCHORS = "schema_version string, anchors map<string, array<struct<form_id: string, concept_id: string, segments: array<string>, provenance: string>>>"


@F.pandas_udf(StringType())
def _nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in texts:
        yield text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def filled(column: str | Column) -> Column:
    """Trimmed text; null where nothing is left."""
    text = F.trim(column)
    return F.when(text != "", text)


def tokens(column: str | Column) -> Column:
    """Tokens between white space, in NFC; an empty array for null."""
    return F.filter(F.split(_nfc(F.coalesce(column, F.lit(""))), r"\s+"), lambda t: t != "")


def scoped(column: str) -> Column:
    """An id within its dataset; null for an empty one."""
    own = filled(column)
    return F.when(own.isNotNull(), F.concat_ws(":", "dataset_id", own))


def tokenize_segments(forms: DataFrame) -> DataFrame:
    """Add ``segments`` and ``segment_source``: ``Segments``, else ``Phonemic_Segments``; raw spelling is never split."""
    both = forms.withColumns({"_own": tokens("Segments"), "_phonemic": tokens("Phonemic_Segments")})
    own = F.size("_own") > 0
    named = F.when(own, "Segments").when(F.size("_phonemic") > 0, "Phonemic_Segments")
    return both.withColumns({"segments": F.when(own, F.col("_own")).otherwise(F.col("_phonemic")), "segment_source": named}).drop("_own", "_phonemic")


def resolve_concepts(parameters: DataFrame) -> DataFrame:
    """``dataset_id, parameter_id, concept_id, concepticon_id, gloss``; rows without an id are left out."""
    own, concepticon = filled("ID"), filled("Concepticon_ID")
    gloss = F.coalesce(filled("Concepticon_Gloss"), filled("Name"), own)
    return parameters.where(own.isNotNull()).select("dataset_id", own.alias("parameter_id"), F.coalesce(concepticon, scoped("ID")).alias("concept_id"), concepticon.alias("concepticon_id"), gloss.alias("gloss"))


def resolve_glottocodes(varieties: DataFrame, overrides: DataFrame) -> DataFrame:
    """Add ``tree_glottocode``, ``compatibility_rule_ids`` and ``error``.

    ``overrides(dataset_id, source_language_id, name, tree_glottocode, rule_id)``: a row fits a variety of its
    dataset with its source id, or (where the row has none) its name. More than one fit is an error, and the
    code stays as the source has it. Overrides are a list written by hand; they are small.
    """
    o = overrides.withColumnsRenamed({"source_language_id": "_id", "name": "_name", "tree_glottocode": "_code", "rule_id": "_rule", "dataset_id": "_dataset"})
    fits = (F.col("dataset_id") == F.col("_dataset")) & F.when(F.col("_id").isNotNull(), F.col("source_language_id") == F.col("_id")).otherwise(F.col("name") == F.col("_name"))
    found = varieties.join(o, fits).groupBy("variety_id").agg(F.min("_code").alias("_code"), F.array_sort(F.collect_list("_rule")).alias("_rules"))
    several = F.size("_rules") > 1
    joined = varieties.join(found, "variety_id", "left")
    code = F.when(several, F.col("source_glottocode")).otherwise(F.coalesce("_code", "source_glottocode"))
    return joined.select(*varieties.columns, code.alias("tree_glottocode"), F.coalesce("_rules", F.array().cast("array<string>")).alias("compatibility_rule_ids"), F.when(several, F.lit("several overrides")).alias("error"))


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _values(column: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), separator), lambda s: F.trim(s)), lambda s: s != "")


def collect_memberships(forms: DataFrame, cognates: DataFrame) -> DataFrame:
    """One row for each cognate judgement: rows of the cognate table, and ids in the form table, split at ``;``.

    ``dataset_id, form_id, membership_id, cognate_set_id, slices, alignment, sources, doubt, comment, source_table,
    source_file, source_row``. Rows without a form or a set are left out. A row of the cognate table without an id is
    named by its line. Columns that an input lacks are null or empty.
    """
    table = cognates.where(filled("Form_ID").isNotNull() & filled("Cognateset_ID").isNotNull())
    doubt = F.lower(F.trim(_optional(table, "Doubt")))
    line = _optional(table, "source_row", "long")
    named = F.concat_ws(":", "dataset_id", F.lit("cognate-membership"), F.coalesce(filled("ID"), F.concat(F.lit("row-"), line.cast("string"))))
    place = lambda df: [_optional(df, "source_file").alias("source_file"), _optional(df, "source_row", "long").alias("source_row")]
    rows = table.select(
        "dataset_id", scoped("Form_ID").alias("form_id"), named.alias("membership_id"), scoped("Cognateset_ID").alias("cognate_set_id"),
        _values(F.col("Segment_Slice"), r"\s+").alias("slices"), tokens(_optional(table, "Alignment")).alias("alignment"),
        _values(_optional(table, "Source"), ";").alias("sources"), F.when(doubt != "", doubt.isin("1", "true", "yes")).alias("doubt"),
        filled(_optional(table, "Comment")).alias("comment"), F.lit("CognateTable").alias("source_table"), *place(table),
    )
    inline = forms.where(filled("ID").isNotNull()).select(
        "dataset_id", scoped("ID").alias("form_id"), filled("ID").alias("_own"), F.posexplode(_values(F.col("Cognateset_ID"), ";")).alias("_at", "_set"),
        _values(_optional(forms, "Source"), ";").alias("sources"), filled(_optional(forms, "Comment")).alias("comment"), *place(forms),
    )
    named = F.concat_ws(":", "dataset_id", F.lit("form-membership"), "_own", (F.col("_at") + 1).cast("string"))
    none = F.array().cast("array<string>")
    inline = inline.select(
        "dataset_id", "form_id", named.alias("membership_id"), F.concat_ws(":", "dataset_id", "_set").alias("cognate_set_id"), none.alias("slices"),
        none.alias("alignment"), "sources", F.lit(None).cast("boolean").alias("doubt"), "comment", F.lit("FormTable").alias("source_table"), "source_file", "source_row",
    )
    return rows.unionByName(inline)


def slice_to_indices(rows: DataFrame, unit: str | Column = "morpheme") -> DataFrame:
    """Add ``segment_indices`` (from 0) and ``error`` to rows with ``segments`` and ``slices``.

    A slice is ``a`` or ``a:b``, from 1 and inclusive, in segments or in morphemes (runs between ``+`` and
    ``-``). ``error`` is malformed, outside or overlapping, else null; the indices are null where it is not.
    ``unit`` is ``segment`` or ``morpheme``, or a column of these.
    """
    boundary = lambda i: F.get("segments", i).isin(*BOUNDARIES)
    every = F.when(F.size("segments") > 0, F.sequence(F.lit(0), F.size("segments") - 1)).otherwise(F.array().cast("array<int>"))
    out = rows.withColumn("_all", every)
    begin = F.filter("_all", lambda i: ~boundary(i) & ((i == 0) | boundary(i - 1)))
    out = out.withColumns({"_begin": begin, "_by_segment": (F.lit(unit) if isinstance(unit, str) else unit) == "segment"})
    number = F.transform("_all", lambda i: F.when(boundary(i), 0).otherwise(F.size(F.filter("_begin", lambda b: b <= i))))
    number = F.when(F.col("_by_segment"), F.transform("_all", lambda i: i + 1)).otherwise(number)
    out = out.withColumns({"_n": F.when(F.col("_by_segment"), F.size("_all")).otherwise(F.size("_begin")), "_unit": number})
    first = lambda s: F.split_part(s, F.lit(":"), F.lit(1)).try_cast("int")
    last = lambda s: F.coalesce(F.nullif(F.split_part(s, F.lit(":"), F.lit(2)), F.lit("")).try_cast("int"), first(s))
    malformed = F.exists("slices", lambda s: ~s.rlike(r"^\d+(:\d+)?$"))
    outside = F.exists("slices", lambda s: ~F.coalesce((first(s) >= 1) & (last(s) >= first(s)) & (last(s) <= F.col("_n")), F.lit(False)))
    chosen = F.flatten(F.transform("slices", lambda s: F.filter("_all", lambda i: F.get("_unit", i).between(first(s), last(s)))))
    out = out.withColumn("_indices", F.when(~malformed & ~outside, chosen))
    overlapping = F.size(F.array_distinct("_indices")) < F.size("_indices")
    error = F.when(malformed, "malformed").when(outside, "outside").when(overlapping, "overlapping")
    return out.withColumn("error", error).withColumn("segment_indices", F.when(F.col("error").isNull(), F.col("_indices"))).drop("_all", "_begin", "_by_segment", "_n", "_unit", "_indices")


def interpret_memberships(memberships: DataFrame) -> DataFrame:
    """Add ``scope`` and ``interpretation``, and ``shorthand``: the form's only set, where it is asserted of the whole form."""
    whole = F.size("slices") == 0
    sets = memberships.groupBy("form_id").agg(
        F.count_distinct(F.when(whole, F.col("cognate_set_id"))).alias("_whole"),
        F.count_distinct("cognate_set_id").alias("_sets"),
        F.count_if(~whole).alias("_partial"),
        F.min("cognate_set_id").alias("_only"),
    )
    joined = memberships.join(sets, "form_id")
    reading = F.when(~whole, "partial_cognate").when(F.col("_whole") > 1, "alternative_analysis").otherwise("asserted")
    single = (F.col("_sets") == 1) & (F.col("_partial") == 0)
    return joined.select(*memberships.columns, F.when(whole, "whole_form").otherwise("segment_slice").alias("scope"), reading.alias("interpretation"), F.when(single, F.col("_only")).alias("shorthand"))


def keep_used(varieties: DataFrame, concepts: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Varieties that have forms and concepts that forms use."""
    return varieties.join(forms, "variety_id", "left_semi"), concepts.join(forms, "concept_id", "left_semi")


def _checked(datasets: list[files.Dataset]) -> list[files.Dataset]:
    for d in datasets:
        if not d.has("LanguageTable"):
            raise ValueError(f"dataset {d.name!r} has no table of languages")
        if not d.has("CognateTable") and not d.has("FormTable", "Cognateset_ID"):
            raise ValueError(f"dataset {d.name!r} has neither a table of cognates nor a column Cognateset_ID in its forms")
        if not d.has("FormTable", "Segments", "Phonemic_Segments"):
            raise ValueError(f"dataset {d.name!r} has neither Segments nor Phonemic_Segments; raw spelling is not split")
    return datasets


def read_wordlist(spark: SparkSession, root: str, overrides: DataFrame | None = None, unit: str | None = None, multi_line: bool = True) -> dict[str, DataFrame]:
    """``varieties, concepts, forms, memberships, rejects`` of all datasets below ``root``.

    Columns go by the header of each file, in any order, with others beside them. A dataset without languages,
    without cognate judgements or without segments is an error that names it. Forms without a known language, an
    id, a parameter, segments or a judgement are left out; memberships whose slice is in error go to ``rejects``.
    Forms, memberships and rejects have the file and line of their row (the header is line 1, and a quoted line break
    starts no new one). Slices count in the unit of a dataset's metadata (morphemes without it), or in ``unit``.
    ``multi_line=False`` reads large files in many tasks, where no value holds a line break.
    """
    found = _checked(files.find_datasets(spark, root))
    read = lambda kind, columns: files.read_tables(spark, root, found, kind, columns, multi_line)
    languages, parameters, raw, cognates = (read(k, c) for k, c in (("LanguageTable", LANGUAGES), ("ParameterTable", PARAMETERS), ("FormTable", FORMS), ("CognateTable", COGNATES)))
    historical = F.lower(F.trim(F.coalesce("historical", F.lit("")))).isin("1", "true", "yes")
    own = filled("ID")
    varieties = languages.where(own.isNotNull()).select(
        "dataset_id", scoped("ID").alias("variety_id"), own.alias("source_language_id"), F.coalesce(filled("Name"), own).alias("name"),
        filled("Glottocode").alias("source_glottocode"), filled("Family").alias("family"), historical.alias("is_historical"),
    )
    if overrides is not None:
        varieties = resolve_glottocodes(varieties, overrides)
    concepts = resolve_concepts(parameters)
    known = tokenize_segments(raw.where(filled("ID").isNotNull() & filled("Parameter_ID").isNotNull())).where(F.size("segments") > 0)
    known = known.select(
        "dataset_id", scoped("ID").alias("form_id"), scoped("Language_ID").alias("variety_id"), filled("Parameter_ID").alias("parameter_id"), "segments",
        "segment_source", "source_file", "source_row",
    )
    known = known.join(varieties.select("variety_id"), "variety_id", "left_semi")
    named = known.join(concepts.select("dataset_id", "parameter_id", "concept_id"), ["dataset_id", "parameter_id"], "left")
    named = named.withColumn("concept_id", F.coalesce("concept_id", F.concat_ws(":", "dataset_id", "parameter_id")))
    judged = interpret_memberships(collect_memberships(raw, cognates))
    by_segment = [d.name for d in found if d.unit == "segment"]
    unit_of = F.lit(unit) if unit else F.when(F.col("dataset_id").isin(by_segment), "segment").otherwise("morpheme")
    judged = slice_to_indices(judged.join(named.select("form_id", "segments"), "form_id"), unit_of).drop("segments")
    sets = judged.groupBy("form_id").agg(F.min("shorthand").alias("cognate_set_id"))
    forms = named.join(sets, "form_id").select("form_id", "variety_id", "concept_id", "segments", "cognate_set_id", "segment_source", "source_file", "source_row")
    varieties, concepts = keep_used(varieties, concepts, forms)
    good = judged.where("error is null").select(
        "form_id", "membership_id", "cognate_set_id", "scope", "interpretation", "segment_indices", "alignment", "sources", "doubt", "comment", "source_table",
        "source_file", "source_row",
    )
    rejects = judged.where("error is not null").select("form_id", "membership_id", "slices", "error", "source_file", "source_row")
    return {"varieties": varieties, "concepts": concepts, "forms": forms, "memberships": good, "rejects": rejects}


def read_payload(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``varieties, forms, concepts`` of nested JSON payloads."""
    read = spark.read.schema(PAYLOAD).option("multiLine", True).option("mode", "FAILFAST").json(path)
    lexicons = read.select(F.explode("lexicons").alias("l"))
    forms = lexicons.select("l.variety_id", F.explode("l.forms").alias("f")).select("variety_id", "f.*")
    return {"varieties": lexicons.select("l.variety_id", "l.name"), "forms": forms, "concepts": read.select(F.explode("concepts").alias("c")).select("c.*")}


def read_lineages(spark: SparkSession, path: str, dataset: str, role: str) -> DataFrame:
    """``target_variety_id, role, relations``: lineage rows of a dataset by their target; each needs all three ids."""
    rows = spark.read.schema("dataset string, target_variety_id string, branch_id string, descendant_variety_id string, evidence string").option("header", True).csv(path)
    needed = [filled(c).isNotNull() for c in ("target_variety_id", "branch_id", "descendant_variety_id")]
    kept = rows.where((F.col("dataset") == dataset) & needed[0] & needed[1] & needed[2])
    relation = F.struct("branch_id", "descendant_variety_id", "evidence")
    return kept.groupBy("target_variety_id").agg(F.lit(role).alias("role"), F.array_sort(F.collect_list(relation)).alias("relations"))


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """``node_id, form_id, concept_id, segments, provenance`` of files that map nodes to forms."""
    read = spark.read.schema(ANCHORS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return read.select(F.explode("anchors").alias("node_id", "forms")).select("node_id", F.explode("forms").alias("f")).select("node_id", "f.*")


def _json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``e`` (the parsed line, null if it is no object of the schema), ``value``, ``source_file``, ``source_row``; blank lines are left out."""
    lines = files.numbered(spark.read.text(path), F.col("_metadata.file_path")).where(F.trim("value") != "")
    return lines.select(parsed_line(F.col("value"), schema).alias("e"), "value", "source_file", "source_row")


def parsed_line(line: Column, schema: str) -> Column:
    """The line as a struct of the schema; null where it is cut short, no object, or has values of other types."""
    parsed = F.from_json(line, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return F.when(F.ltrim(line).startswith("{") & parsed["_bad"].isNull(), parsed.dropFields("_bad"))


def read_trajectories(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; a bad line fails the job with an error that names its file and line."""
    lines = _json_lines(spark, path, schema)
    told = F.concat(F.lit("no record: "), "source_file", F.lit(" line "), F.col("source_row").cast("string"))
    return lines.select(F.when(F.col("e").isNull(), F.raise_error(told).cast(lines.schema["e"].dataType)).otherwise(F.col("e")).alias("e")).select("e.*")


def read_events(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Events of JSON lines, and ``source_file, source_row, value`` of the lines that are none."""
    lines = _json_lines(spark, path, schema)
    return lines.where("e is not null").select("e.*"), lines.where("e is null").select("source_file", "source_row", "value")


def read_runs(spark: SparkSession, root: str, schema: str, result_schema: str) -> DataFrame:
    """Trajectories of all run folders with the run's result, null where a run left none.

    A run is a folder of ``root`` with ``trajectories.jsonl`` and perhaps ``result.json``.
    """
    run = lambda name: F.regexp_extract("_metadata.file_path", rf"([^/]+)/{name}", 1).alias("run")
    logs = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{root}/*/trajectories.jsonl")
    folder = files.Folder(spark, root)
    runs = [f.getPath() for f in folder.children(folder.path) if f.isDirectory()]
    left = [str(f.getPath()) for r in runs for f in folder.children(r) if f.getPath().getName().startswith("result") and f.getPath().getName().endswith(".json")]
    if left:
        results = spark.read.schema(result_schema).option("mode", "FAILFAST").json(left)
        results = results.select(run(r"result[^/]*\.json"), F.struct(*results.columns).alias("result"))
    else:
        results = spark.createDataFrame([], f"run string, result struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in StructType.fromDDL(result_schema))}>")
    return logs.select(run(r"trajectories\.jsonl"), *logs.columns).join(results, "run", "left")


def write_tables(tables: dict[str, DataFrame], path: str, kind: str = "json") -> None:
    """Write each table to a folder of its name below ``path``: JSON lines or Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(kind).save(f"{path}/{name}")
