"""Text, Markdown and Word files as blocks: one row per paragraph, heading, table, equation or image.

A file becomes numbered lines (a Word file is first told as Markdown lines), every line gets a kind by its own signs, and
runs of lines become blocks by windows over the file, so all rules are expressions. A file that can't be read gives one
row of type 'error'. PDF, scanned pages and model calls need libraries that aren't here; their plug-in is any DataFrame
with the columns of BLOCK_SCHEMA.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions.dialect import SPARK

BLOCK_SCHEMA = "path string, block_idx int, type string, page_idx int, section string, text string, latex string, table_body string"
KINDS = ("txt", "md", "docx")

# The namespaces of Office documents.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
OFFICE_MATH = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
#: Stands in a line for a picture of a Word file.
PICTURE = "\x01picture"


def _said(element: ElementTree.Element, tag: str) -> str:
    return " ".join("".join(x.text or "" for x in element.iter(tag)).split())


def word_lines(data: bytes) -> list[str]:
    """The body of a Word file as Markdown lines. ValueError, KeyError, BadZipFile or ParseError where it can't be read."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    lines: list[str] = []
    for element in root.iterfind(f"{WORD}body/*"):
        if element.tag == f"{WORD}tbl":
            told = [[_said(cell, f"{WORD}t").replace("|", "\\|") for cell in row.iterfind(f"{WORD}tc")] for row in element.iterfind(f"{WORD}tr")]
            if len(told) > 1 and max(map(len, told)) > 1:
                lines += [f"| {' | '.join(told[0])} |", "|" + "---|" * len(told[0]), *[f"| {' | '.join(cells)} |" for cells in told[1:]], ""]
            continue
        if element.tag != f"{WORD}p":
            continue
        lines += [PICTURE for _ in element.iter(f"{DRAWING}blip")]
        lines += [f"$${said}$$" for said in (_said(x, f"{OFFICE_MATH}t") for x in element.iter(f"{OFFICE_MATH}oMath")) if said]
        style = element.find(f"{WORD}pPr/{WORD}pStyle")
        named = style.get(f"{WORD}val", "").lower() if style is not None else ""
        lines += [("# " if named.startswith(("heading", "title")) else "") + _said(element, f"{WORD}t"), ""]
    return lines


def _lines(files: DataFrame) -> DataFrame:
    """(path, lines, fault) of files(path, content), by the ending of the path."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, content in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                kind, data, lines, fault = (path or "").rpartition(".")[2].lower(), content.as_py() or b"", None, None
                try:
                    if kind not in KINDS:
                        raise ValueError(f"files of kind {kind!r} aren't supported")
                    lines = word_lines(data) if kind == "docx" else data.decode("utf-8", "replace").splitlines()
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as unread:
                    fault = str(unread)
                schema = pa.schema([("path", pa.string()), ("lines", pa.list_(pa.string())), ("fault", pa.string())])
                yield pa.RecordBatch.from_pylist([{"path": path, "lines": lines, "fault": fault}], schema)

    return files.select("path", "content").mapInArrow(batches, "path string, lines array<string>, fault string")


def _cells(line: Column) -> Column:
    """The cells of a table's line; a bar behind a backslash belongs to its cell. White space is squeezed."""
    inner = F.regexp_replace(line, r"^\|+|(?<!\\)\|+$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.btrim(F.regexp_replace(F.regexp_replace(c, "[\\x00\\x{FFFD}]", ""), r"\s+", " ")))


def blocks_of_lines(numbered: DataFrame) -> DataFrame:
    """Blocks of (path, n, line): BLOCK_SCHEMA without errors.

    Kinds of lines: inside an equation set off by $$; of a table (bars, from the line above a rule to the end of the run);
    a heading; a picture; blank; else text. A block is a run of one kind; headings, pictures and one-line equations stand alone.
    """
    line = F.btrim("line", F.lit(" \t\r\x0b\x0c"))
    fences = F.regexp_count("line", F.lit(r"\$\$"))
    whole, before = Window.partitionBy("path").orderBy("n"), Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    signs = numbered.select("path", "n", line.alias("line")).select(
        "*", (F.coalesce(F.sum(fences).over(before), F.lit(0)) % 2 == 1).alias("within"), fences.alias("fences"),
        (F.startswith("line", F.lit("|"))).alias("bar"), F.rlike("line", F.lit(r"^[\s:|-]*-[\s:|-]*\|[\s:|-]*$|^\|[\s:|-]*-[\s:|-]*$")).alias("rule"),
    )
    opens = F.coalesce(F.col("bar") & F.lead("rule").over(whole), F.lit(False))
    runs = signs.withColumn("opens", opens).withColumn("bars", F.sum(F.when(F.col("bar"), 0).otherwise(1)).over(whole))
    in_run = Window.partitionBy("path", "bars").orderBy("n")
    tabled = F.col("bar") & F.max("opens").over(in_run)
    kind = (
        F.when(F.col("within") | F.startswith("line", F.lit("$$")), "equation")
        .when(tabled, "table").when(F.rlike("line", F.lit(r"^#{1,6}\s+\S")), "heading").when(F.col("line") == PICTURE, "image").when(F.col("line") == "", "blank").otherwise("text")
    )
    kinds = runs.withColumn("kind", kind)
    alone = F.col("kind").isin("heading", "image") | ((F.col("kind") == "equation") & ~F.col("within"))
    starts = alone | F.coalesce(F.lag("kind").over(whole) != F.col("kind"), F.lit(True))
    heading = F.when(F.col("kind") == "heading", F.regexp_replace("line", r"^#{1,6}\s+", ""))
    placed = kinds.withColumn("block", F.sum(starts.cast("int")).over(whole)).withColumn("section", F.last(heading, ignorenulls=True).over(whole))
    joined = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", c.alias("x")))), lambda s: s["x"]), by)
    kept = ~F.forall(_cells(F.col("line")), lambda c: F.rlike(c, F.lit(r"^(:?-{2,}:?)?$")))
    row = F.when((F.col("kind") == "table") & kept, _cells(F.col("line")))
    made = placed.where("kind <> 'blank'").groupBy("path", "block", "kind", "section").agg(
        joined(F.coalesce(heading, F.regexp_replace("line", r"\$\$", "")), " ").alias("said"),
        F.transform(F.array_sort(F.collect_list(F.when(row.isNotNull(), F.struct("n", row.alias("x"))))), lambda s: s["x"]).alias("rows"),
    )
    wide = F.array_max(F.transform("rows", F.size))
    told = lambda cells: F.concat(F.lit("| "), F.array_join(F.concat(cells, F.array_repeat(F.lit(""), wide - F.size(cells))), " | "), F.lit(" |"))
    ruled = F.concat(F.array(told(F.get("rows", F.lit(0))), F.concat(F.lit("|"), F.repeat(F.lit("---|"), wide))), F.transform(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))), told))
    said = F.btrim("said")
    formula = (F.col("kind") == "equation") | ((F.col("kind") == "text") & F.expr(SPARK.equation("said")))
    named = made.withColumn("type", F.when(F.col("kind").isin("table", "image"), F.col("kind")).when(formula, "equation").otherwise("text"))
    real = named.where(F.when(F.col("kind") == "table", F.size("rows") >= 2).otherwise((said != "") | (F.col("kind") == "image")))
    return real.select(
        "path", (F.row_number().over(Window.partitionBy("path").orderBy("block")) - 1).cast("int").alias("block_idx"), "type", F.lit(0).alias("page_idx"),
        F.when(F.col("type") == "text", F.col("section")).alias("section"), F.when(F.col("type") == "text", said).when(F.col("type") != "table", F.lit("")).alias("text"),
        F.when(F.col("type") == "equation", said).alias("latex"), F.when(F.col("type") == "table", F.array_join(ruled, "\n")).alias("table_body"),
    )


def parse(files: DataFrame) -> DataFrame:
    """Blocks of files(path, content), by the ending of the path."""
    read = _lines(files)
    nothing = F.lit(None).cast("string")
    faults = read.where("fault is not null").select("path", F.lit(0).alias("block_idx"), F.lit("error").alias("type"), F.lit(0).alias("page_idx"), nothing.alias("section"), F.col("fault").alias("text"), nothing.alias("latex"), nothing.alias("table_body"))
    return blocks_of_lines(read.select("path", F.posexplode("lines").alias("n", "line"))).unionByName(faults)


def attach_csv(blocks: DataFrame, csv: DataFrame, path: str) -> DataFrame:
    """blocks with a table behind them made of the rows of csv (all columns, in their order), as one Markdown table."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"\|", r"\\|")
    head = "| " + " | ".join(c.replace("|", "\\|") for c in csv.columns) + " |\n|" + "---|" * len(csv.columns)
    lines = csv.select(F.monotonically_increasing_id().alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in csv.columns]), F.lit(" |")).alias("x"))
    body = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]), "\n").alias("x"))
    after = blocks.where(F.col("path") == path).agg(F.coalesce(F.max("block_idx") + 1, F.lit(0)).cast("int").alias("block_idx"))
    nothing = F.lit(None).cast("string")
    table = body.crossJoin(after).select(F.lit(path).alias("path"), "block_idx", F.lit("table").alias("type"), F.lit(0).alias("page_idx"), nothing.alias("section"), nothing.alias("text"), nothing.alias("latex"), F.concat(F.lit(head + "\n"), "x").alias("table_body"))
    return blocks.unionByName(table)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all files under path; the same bytes under two names count once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    first = files.withColumn("sha256", F.sha2("content", 256)).groupBy("sha256").agg(F.min("path").alias("path"))
    return parse(files.join(first, "path", "left_semi"))
