"""Sources: filing packages (zip archives) as a Python data source, HTML and JSON tables as cells, registry lookups."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.window import Window


class PackageFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class PackageReader(DataSourceReader):
    """One partition a package. Filters on name and suffix are taken in: other entries aren't inflated."""

    def __init__(self, path: str, pushdown: bool):
        self.path, self.pushdown, self.wanted = path, pushdown, {}

    def _files(self):
        from pyarrow import fs

        if self.path.startswith("file:"):
            return fs.LocalFileSystem(), "/" + self.path.removeprefix("file:").lstrip("/")
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def pushFilters(self, filters):
        for f in filters:
            if self.pushdown and isinstance(f, (EqualTo, In)) and f.attribute in (("name",), ("suffix",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f

    def partitions(self):
        from pyarrow.fs import FileSelector, FileType

        files, root = self._files()
        if files.get_file_info(root).type == FileType.File:
            return [PackageFile(root)]
        return [PackageFile(x.path) for x in sorted(files.get_file_info(FileSelector(root, recursive=True)), key=lambda x: x.path) if x.base_name.lower().endswith(".zip")]

    def read(self, partition):
        if not isinstance(partition, PackageFile):
            return
        files, _ = self._files()
        with files.open_input_file(partition.path) as raw, zipfile.ZipFile(io.BufferedReader(raw) if not hasattr(raw, "seekable") else raw) as package:
            for entry in package.infolist():
                suffix = entry.filename.rpartition(".")[2].lower()
                if entry.is_dir() or entry.filename not in self.wanted.get("name", {entry.filename}) or suffix not in self.wanted.get("suffix", {suffix}):
                    continue
                yield (partition.path, entry.filename, suffix, entry.file_size, package.read(entry))


class PackageSource(DataSource):
    """Format ``filing_package``. Options: path, a zip file or a folder of them; pushdown, for frames that are read once."""

    @classmethod
    def name(cls):
        return "filing_package"

    def schema(self):
        return "package string, name string, suffix string, size long, content binary"

    def reader(self, schema):
        return PackageReader(self.options["path"], self.options.get("pushdown", "false") == "true")


def read_packages(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """Entries of packages; a condition given as where is taken into the scan. (Spark keeps pushed filters with a loaded frame, so frames for general use take none in.)"""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackageSource)
    out = spark.read.format("filing_package").option("path", path).option("pushdown", str(where is not None).lower()).load()
    return out if where is None else out.where(where)


class _Tables(HTMLParser):
    """Rows of cells of every table, nested ones apart."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[list[list[str]]] = []
        self.open: list[list[list[list[str]]]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
        elif self.open and tag == "tr":
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            if not self.open[-1]:
                self.open[-1].append([])
            self.open[-1][-1].append([])

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.done.append([["".join(c).split() and " ".join("".join(c).split()) or "" for c in row] for row in self.open.pop() if row])

    def handle_data(self, data):
        if self.open and self.open[-1] and self.open[-1][-1]:
            self.open[-1][-1][-1].append(data)


def html_tables(html: str) -> list[list[list[str]]]:
    parser = _Tables()
    parser.feed(html or "")
    while parser.open:
        parser.handle_endtag("table")
    return [t for t in parser.done if t]


def html_table_cells(pages: DataFrame, key: str, html: str, least_rows: int = 1, least_columns: int = 1) -> DataFrame:
    """(key, table_index, row_no, col_no, header, text) of every table of at least that size; short rows are filled up with blanks. A null page has no tables."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, page in zip(batch[key], batch[html], strict=True):
                for i, rows in enumerate(html_tables(page)):
                    width = max(map(len, rows))
                    if len(rows) >= least_rows and width >= least_columns:
                        rows = [r + [""] * (width - len(r)) for r in rows]
                        out += [(k, i, r, c, rows[0][c], text) for r, row in enumerate(rows) for c, text in enumerate(row)]
            yield pd.DataFrame(out, columns=[key, "table_index", "row_no", "col_no", "header", "text"])

    return pages.where(F.lower(html).contains("<table")).select(key, html).mapInPandas(run, f"{key} {kind}, table_index int, row_no int, col_no int, header string, text string")


JSON_TABLES = T.StructType([T.StructField("tables", T.ArrayType(T.StructType([T.StructField("headers", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))])))])


def json_table_cells(answers: DataFrame, key: str, text: str) -> DataFrame:
    """Cells of the tables in an answer's first-to-last brace; tables with under two headers or without rows are left out, short rows filled up."""
    body = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), JSON_TABLES)
    found = answers.select(key, F.posexplode(body["tables"]).alias("table_index", "t")).where((F.size("t.headers") >= 2) & (F.size("t.rows") >= 1))
    rows = found.select(key, "table_index", F.col("t.headers").alias("headers"), F.posexplode("t.rows").alias("row_no", "r"))
    filled = F.when(F.size("r") < F.size("headers"), F.concat("r", F.array_repeat(F.lit(""), F.size("headers") - F.size("r")))).otherwise(F.slice("r", F.lit(1), F.size("headers")))
    return rows.select(key, "table_index", (F.col("row_no") + 1).alias("row_no"), F.posexplode(F.arrays_zip(F.col("headers").alias("header"), filled.alias("text"))).alias("col_no", "c")).select(key, "table_index", "row_no", "col_no", "c.header", "c.text")


def ticker_index(raw: DataFrame, body: str = "body") -> DataFrame:
    """(ticker, cik) of a JSON object of objects; a ticker that comes again takes the later number."""
    entry = T.MapType(T.StringType(), T.StructType([T.StructField("ticker", T.StringType()), T.StructField("cik_str", T.LongType())]))
    rows = raw.select(F.posexplode(F.map_entries(F.from_json(body, entry))).alias("ord", "e")).select("ord", F.upper("e.value.ticker").alias("ticker"), F.col("e.value.cik_str").alias("cik"))
    return rows.groupBy("ticker").agg(F.max_by("cik", "ord").alias("cik"))


def resolve_ciks(tickers: DataFrame, index: DataFrame) -> DataFrame:
    """tickers with cik padded to ten digits; unknown ones keep a null and an error."""
    out = tickers.withColumn("ticker", F.upper("ticker")).join(index, "ticker", "left")
    return out.withColumns({"error": F.when(F.col("cik").isNull(), F.concat(F.lit("unknown ticker: "), "ticker")), "cik": F.lpad(F.col("cik").cast("string"), 10, "0")})


def first_by_priority(candidates: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One candidate for each key: explicit before local before downloaded, whatever the order says."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return candidates.withColumn("_n", F.row_number().over(ranked)).where("_n = 1").drop("_n")


def latest_submission(submissions: DataFrame, form: str) -> DataFrame:
    """(entity, accession, document) of the first wanted form in column-oriented arrays (form[], accession[], document[])."""
    rows = submissions.select("entity", F.posexplode(F.arrays_zip("form", "accession", "document")).alias("pos", "s")).where(F.col("s.form") == form)
    best = rows.groupBy("entity").agg(F.min(F.struct("pos", "s")).alias("b"))
    return best.select("entity", "b.s.accession", "b.s.document")


def pick_filing(filings: DataFrame, year: int) -> DataFrame:
    """One filing an entity: of the wanted year if it has any, else of all; English before others, December ends first, French last, then the newest."""
    rows = filings.withColumn("right_year", F.substring("period_end", 1, 4) == str(year))
    any_right = F.max(F.col("right_year").cast("int")).over(Window.partitionBy("entity"))
    kept = rows.withColumn("any", any_right).where((F.col("any") == 0) | F.col("right_year"))
    return first_by_priority(kept, ["entity"], F.desc(F.col("language") == "en"), F.desc(F.substring("period_end", 6, 2) == "12"), F.col("language") == "fr", F.desc("period_end"), F.col("url")).drop("any", "right_year")
