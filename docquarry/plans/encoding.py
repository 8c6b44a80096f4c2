"""Documents read by the text parser, and records kept as VARIANT values with their fields, damaged ones apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.dialect import Dialect
from docquarry.plans import mixed
from docquarry.plans.relations import Corpus, kept
from docquarry.sources import text_files


def parsed_blocks(docs: DataFrame) -> DataFrame:
    """@blocks@ of docs(doc_id, filename, content), as the parser of text and Markdown files reads them."""
    lines = docs.select(F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split("content", "\n", -1)).alias("n", "line"))
    found = text_files.blocks_of_lines(lines)
    nothing = F.lit(None).cast("string")
    named = found.withColumn("doc_id", F.col("path").cast("long")).join(docs.select("doc_id", "filename"), "doc_id")
    return named.select("doc_id", "filename", "block_idx", "type", F.col("page_idx").alias("page"), "section", "text", "latex", "table_body", nothing.alias("caption"), nothing.alias("footnote"), nothing.alias("description"))


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus whose items are made of the parsed blocks of the documents."""
    made = kept(spark, sf_dir, "parsed", mixed.OVER_BLOCKS)
    if not made.has("blocks"):
        made.give("blocks", parsed_blocks(kept(spark, sf_dir).frame("docs")))
    return made


def field(d: Dialect, record: str, name: str, kind: str) -> str:
    """A field of a record kept as JSON text, read through VARIANT; null where the record is damaged or lacks it."""
    if d.name == "spark":
        return f"try_variant_get(try_parse_json({record}), '$.{name}', '{kind}')"
    return f"TRY_CAST(CASE WHEN json_valid({record}) THEN json_extract_string({record}, '$.{name}') END AS {'VARCHAR' if kind == 'string' else kind})"


def damaged(d: Dialect, record: str) -> str:
    """Whether a record is no JSON; a null one isn't damaged but absent."""
    return f"({record} IS NOT NULL AND {f'try_parse_json({record}) IS NULL' if d.name == 'spark' else f'NOT json_valid({record})'})"


FIELDS = ("type", "page", "section", "caption", "raw", "description")


def item_records(d: Dialect) -> str:
    """(doc_id, idx, record): the metadata of each item as one JSON text, null fields left out."""
    if d.name == "spark":
        return f"SELECT doc_id, idx, to_json(named_struct({', '.join(f"'{f}', {f}" for f in FIELDS)})) AS record FROM @items@"
    return f"SELECT doc_id, idx, CAST(to_json({{{', '.join(f"'{f}': {f}" for f in FIELDS)}}}) AS VARCHAR) AS record FROM @items@"


def item_metadata(d: Dialect) -> str:
    """Items with their metadata, read back from the records."""
    kinds = {"page": "bigint"}
    return f"SELECT doc_id, idx, {', '.join(f'{field(d, "record", f, kinds.get(f, "string"))} AS {f}' for f in FIELDS)} FROM ({item_records(d)}) r_"


def event_props(d: Dialect) -> str:
    return f"SELECT event_id, event_type, {field(d, 'props', 'k', 'bigint')} AS k, {damaged(d, 'props')} AS damaged FROM @events@"


def props_by_type(d: Dialect) -> str:
    return f"SELECT event_type, count(*) AS n, count(k) AS with_k, sum(k) AS total, sum(CASE WHEN damaged THEN 1 ELSE 0 END) AS damaged FROM ({event_props(d)}) p_ GROUP BY event_type"


def inferred_schema(records: DataFrame, column: str) -> str:
    """The common schema of JSON texts, merged over all of them; damaged and null ones add nothing."""
    return records.agg(F.expr(f"schema_of_variant_agg(try_parse_json({column}))").alias("s")).first()["s"]


#: Over the driver's tables as they are, over derived blocks (metadata of all kinds), and over parsed documents.
PLAIN: dict[str, Callable[[Dialect], str]] = {"event_props": event_props, "event_props_by_type": props_by_type}
OVER_BLOCKS: dict[str, Callable[[Dialect], str]] = {"item_metadata": item_metadata}
PARSED: dict[str, Callable[[Dialect], str]] = {
    "parsed_blocks": lambda d: "SELECT doc_id, filename, block_idx, type, section, text, latex, table_body FROM @blocks@",
    "parsed_items": lambda d: "SELECT doc_id, idx, type, chunk, raw FROM @items@",
    "parsed_struct_edges": lambda d: "SELECT doc_id, src, dst, kind FROM @struct_edges@",
}
