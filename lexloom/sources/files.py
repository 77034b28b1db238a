"""Files of many layouts: tables found by a folder's metadata, columns by header, rows by file and line."""

from __future__ import annotations

import csv
import json
from collections import defaultdict
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Tables of a wordlist by their type, with the names of their files where no metadata says otherwise.
TABLES = {"LanguageTable": "languages.csv", "ParameterTable": "parameters.csv", "FormTable": "forms.csv", "CognateTable": "cognates.csv"}
# Fixed value: the property of a slice column that counts segments; other slices count morphemes.
SEGMENT_SLICE = "http://cldf.clld.org/v1.0/terms.rdf#segmentSlice"
#: Rows of a scan's partition are numbered in the low bits, whatever the partition.
ROW_BITS = (1 << 33) - 1


@dataclass
class Dataset:
    """A folder of tables: path and header of each of its files, by type, and the unit of its slices."""

    name: str
    unit: str = "morpheme"
    files: dict[str, list[tuple[str, tuple[str, ...]]]] = field(default_factory=lambda: defaultdict(list))

    def has(self, kind: str, *columns: str) -> bool:
        """Whether a table of the type has one of the columns (any, if none is asked for)."""
        return any(not columns or set(columns) & set(header) for _, header in self.files.get(kind, []))


class Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm = spark, spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def children(self, path: JavaObject) -> list[JavaObject]:
        """Visible files and folders directly below, by name."""
        found = [s for s in self.system.listStatus(path) if not s.getPath().getName().startswith(("_", "."))]
        return sorted(found, key=lambda s: s.getPath().getName())

    def files(self, path: JavaObject) -> list[str]:
        """A file, or the part files of a folder; none, if there is nothing."""
        if not self.system.exists(path):
            return []
        return [str(s.getPath()) for s in self.system.listStatus(path) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]

    def text(self, path: str, lines: int | None = None) -> str:
        """The first lines of a small file, or all of it."""
        opened = self.system.open(self.jvm.org.apache.hadoop.fs.Path(path))
        reader = self.jvm.java.io.BufferedReader(self.jvm.java.io.InputStreamReader(opened, "UTF-8"))
        try:
            out: list[str] = []
            while (lines is None or len(out) < lines) and (line := reader.readLine()) is not None:
                out.append(line)
            return "\n".join(out)
        finally:
            reader.close()


def _described(folder: Folder, base: JavaObject) -> tuple[dict[str, str], str]:
    """File names by type of table, and the unit of slices, as the folder's metadata has them."""
    names, unit = dict(TABLES), "morpheme"
    described = [s for s in folder.children(base) if s.isFile() and s.getPath().getName().endswith("metadata.json")]
    for status in described[:1]:
        for table in json.loads(folder.text(str(status.getPath()))).get("tables", []):
            kind = str(table.get("dc:conformsTo", "")).rpartition("#")[2]
            if kind in names and table.get("url"):
                names[kind] = table["url"]
            if kind == "CognateTable":
                columns = table.get("tableSchema", {}).get("columns", [])
                if any(c.get("name") == "Segment_Slice" and c.get("propertyUrl") == SEGMENT_SLICE for c in columns):
                    unit = "segment"
    return names, unit


def find_datasets(spark: SparkSession, root: str) -> list[Dataset]:
    """The datasets below ``root``: each folder, or its folder ``cldf``, that holds a table. Reads headers only."""
    folder = Folder(spark, root)
    out = []
    for status in folder.children(folder.path):
        if status.isDirectory():
            inner = [s.getPath() for s in folder.children(status.getPath()) if s.isDirectory() and s.getPath().getName() == "cldf"]
            base = inner[0] if inner else status.getPath()
            names, unit = _described(folder, base)
            found = Dataset(status.getPath().getName(), unit)
            for kind, name in names.items():
                for path in folder.files(folder.jvm.org.apache.hadoop.fs.Path(base, name)):
                    header = next(csv.reader([folder.text(path, 1).removeprefix("\ufeff")]), [])
                    found.files[kind].append((path, tuple(header)))
            if found.files:
                out.append(found)
    return out


def relative_path(root: str) -> Column:
    """The path of a row's file below the folder of that path."""
    plain = F.regexp_extract("_metadata.file_path", r"^(?:[A-Za-z0-9+.-]+:)?(?://[^/]*)?(/.*)$", 1)
    decoded = F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))
    return F.substring(decoded, len(root) + 2, 1 << 20)


def numbered(rows: DataFrame, file: Column, first: int = 1) -> DataFrame:
    """Add ``source_file`` and ``source_row``, the row's number in its file, from ``first``, to a scan of files.

    A file may be read in many blocks at once: rows are counted for each block, and a sum over the blocks before it gives the
    number of its first row. ``rows`` must come straight from the scan, as another order would number them wrongly.
    """
    block = F.col("_metadata.file_block_start").alias("_block")
    placed = rows.select("*", file.alias("source_file"), block, F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)).alias("_at"))
    blocks = placed.groupBy("source_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.expr("coalesce(sum(_n) over (partition by source_file order by _block rows between unbounded preceding and 1 preceding), 0)")
    starts = blocks.select("source_file", "_block", (before - F.col("_first") + first).alias("_add"))
    return placed.join(starts, ["source_file", "_block"]).withColumn("source_row", F.col("_at") + F.col("_add")).drop("_block", "_at", "_add")


def read_tables(spark: SparkSession, root: str, datasets: list[Dataset], kind: str, wanted: dict[str, tuple[str, ...]], multi_line: bool = True) -> DataFrame:
    """``dataset_id``, the wanted columns, ``source_file`` and ``source_row`` of all tables of one type.

    Columns are found by the names in each file's own header, the first of several names that has text; those that a file
    lacks are null. Files of one header are one scan. Quotes are doubled within quotes; with ``multi_line`` a quoted
    value may hold line breaks, and a file is one task (a large table is a folder of files).
    """
    by_header: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for dataset in datasets:
        for path, header in dataset.files.get(kind, []):
            by_header[header].append(path)
    base = Folder(spark, root).path.toUri().getPath().rstrip("/")
    out = None
    for header, paths in sorted(by_header.items()):
        schema = ", ".join(f"c{i} string" for i in range(len(header)))
        rows = spark.read.schema(schema).options(header=True, multiLine=multi_line, escape='"', enforceSchema=True).csv(paths)
        rows = numbered(rows, relative_path(base), 2)
        at = {name: i for i, name in reversed(list(enumerate(header)))}
        columns = []
        for name, names in wanted.items():
            there = [F.nullif(F.col(f"c{at[n]}"), F.lit("")) for n in names if n in at]
            columns.append((F.coalesce(*there) if there else F.lit(None).cast("string")).alias(name))
        found = rows.select(F.split_part("source_file", F.lit("/"), F.lit(1)).alias("dataset_id"), *columns, "source_file", "source_row")
        out = found if out is None else out.unionByName(found)
    if out is None:
        fields = ", ".join(f"{name} string" for name in wanted)
        return spark.createDataFrame([], f"dataset_id string, {fields}, source_file string, source_row long")
    return out
