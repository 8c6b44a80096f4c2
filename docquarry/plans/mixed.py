"""Items made of parsed blocks: texts with their sections and pages, tables, equations and figures.

OVER_BLOCKS replaces the relations that read the documents table, so that a Corpus over @blocks@ (of parsed files, a
content list or a stored table) answers questions as one over documents does. The queries here are registered over the blocks
of plans.derived; LIST is a small content list for tests.

@blocks@: doc_id long, filename, block_idx int, type (text, image, table, equation, warning, error or anything else),
page int from 0, section, text, latex, table_body, caption, footnote, description (of a figure, by a model where there is
one). Null type counts as text, null page as 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import words as W
from docquarry.functions.dialect import Dialect
from docquarry.plans import answers, catalog
from docquarry.plans.fixtures import FIGURE, TABLE_NAME, captions, row_groups, rows

COLUMNS = "doc_id, filename, block_idx, type, page, section, text, latex, table_body, caption, footnote, description"


def blocks_of(parsed: DataFrame) -> DataFrame:
    """@blocks@ of what sources.text_files parses; a document's id is the 64-bit hash of its path. Errors become warnings."""
    nothing = F.lit(None).cast("string")
    return parsed.select(
        F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "block_idx", F.when(F.col("type") == "error", F.lit("warning")).otherwise(F.col("type")).alias("type"),
        F.col("page_idx").alias("page"), "section", "text", "latex", "table_body", nothing.alias("caption"), nothing.alias("footnote"), nothing.alias("description"),
    )


def real_blocks(d: Dialect) -> str:
    """Blocks without warnings and empty texts."""
    plain = ", ".join(f"{d.strip(f'coalesce({c}, chr(32))')} AS {name}" for c, name in (("text", "said"), ("caption", "caption"), ("footnote", "footnote"), ("description", "description")))
    every = f"SELECT doc_id, filename, block_idx, coalesce(type, 'text') AS type, coalesce(page, 0) AS page, section, coalesce(latex, '') AS latex, coalesce(table_body, '') AS table_body, {plain} FROM @blocks@"
    return f"SELECT * FROM ({every}) b_ WHERE type NOT IN ('warning', 'error') AND (type <> 'text' OR said <> '')"


def block_captions(d: Dialect) -> str:
    """Which text names which figure or table; those that came with a caption ask for none."""
    body = "said"
    if d.name == "spark":  # texts that can't be captions stay where they are
        body = f"CASE WHEN type = 'text' AND length(said) <= 250 AND ({d.matches('said', FIGURE)} OR {d.matches('said', TABLE_NAME)}) THEN said END"
    asking = f"(SELECT doc_id, block_idx AS idx, CASE WHEN caption <> '' AND type IN ('image', 'table') THEN 'named' ELSE type END AS type, page, {body} AS body FROM @real_blocks@)"
    return captions(d, asking)


def named_blocks(d: Dialect) -> str:
    """Blocks with their captions; the texts that became captions go."""
    if d.name == "spark":  # by document, as the windows behind are, so that texts are shuffled once for both
        listed = "SELECT doc_id, collect_list(named_struct('idx', idx, 'taken', taken, 'caption', caption)) AS every FROM @block_captions@ GROUP BY doc_id"
        return (
            "SELECT r.doc_id, r.filename, r.block_idx, r.type, r.page, r.section, r.said, r.latex, r.table_body, coalesce(get(filter(l.every, e -> e.idx = r.block_idx), 0).caption, r.caption) AS caption, r.footnote, r.description "
            f"FROM @real_blocks@ r LEFT JOIN ({listed}) l ON r.doc_id = l.doc_id WHERE NOT coalesce(exists(l.every, e -> e.taken = r.block_idx), FALSE)"
        )
    return (
        "SELECT r.doc_id, r.filename, r.block_idx, r.type, r.page, r.section, r.said, r.latex, r.table_body, coalesce(c.caption, r.caption) AS caption, r.footnote, r.description FROM @real_blocks@ r "
        "LEFT JOIN @block_captions@ c ON r.doc_id = c.doc_id AND r.block_idx = c.idx LEFT JOIN @block_captions@ t ON r.doc_id = t.doc_id AND r.block_idx = t.taken WHERE t.taken IS NULL"
    )


def placed_blocks(d: Dialect) -> str:
    """Blocks with the run of texts they belong to and the text before them (context).

    A run ends at another page or section and at any other kind of block. Context is the last 300 characters of the texts
    before; as every text has one character at least and a blank, 150 texts hold them, which bounds the window.
    """
    opens = "CASE WHEN type = 'text' AND lag(type) OVER w = 'text' AND lag(page) OVER w = page AND lag(section) OVER w IS NOT DISTINCT FROM section THEN 0 ELSE 1 END"
    marked = f"SELECT *, {opens} AS opens, sum(CASE WHEN type = 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_idx) AS n_texts FROM @named_blocks@ WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)"
    half = W.CONTEXT_CHARS // 2
    before = d.before(f"CASE WHEN type = 'text' THEN right(said, {W.CONTEXT_CHARS}) END", f"PARTITION BY doc_id ORDER BY n_texts RANGE BETWEEN {half} PRECEDING AND CURRENT ROW")
    context = d.strip(f"right(coalesce({before}, chr(32)), {W.CONTEXT_CHARS})")
    if d.name == "spark":  # only what is described with its context keeps one
        context = f"CASE WHEN type IN ('image', 'equation') THEN {context} END"
    return f"SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY block_idx) AS run, {context} AS context FROM ({marked}) m_"


def block_runs(d: Dialect) -> str:
    """(doc_id, filename, run, block_idx, page, section, content): the text of each run."""
    return f"SELECT doc_id, filename, run, min(block_idx) AS block_idx, max(page) AS page, max(section) AS section, {d.gathered('said', 'block_idx', d.newline())} AS content FROM @placed_blocks@ WHERE type = 'text' GROUP BY doc_id, filename, run"


def laid_blocks(d: Dialect) -> str:
    """Spark: blocks, which texts are captions of which, and groups of tables' rows, as rows to be put in order
    (docquarry.operators.block_scan). Of an equation said is the chunk without its context, caption what is said about it."""
    squeezed = d.strip(d.replace("formula", r"\s+", "' '"))
    named = "SELECT r.doc_id, r.block_idx, coalesce(c.caption, r.caption) AS caption, r.table_body AS body FROM @real_blocks@ r LEFT JOIN @block_captions@ c ON r.doc_id = c.doc_id AND r.block_idx = c.idx WHERE r.type = 'table'"
    groups = row_groups(d, f"({named}) t_", "doc_id, block_idx")
    more = lambda *fields: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in zip(("caption", "footnote", "description", "raw"), fields, strict=True)) + ")"
    bare = f"CAST(NULL AS STRUCT<{', '.join(f'{k}: STRING' for k in ('caption', 'footnote', 'description', 'raw'))}>)"
    equation = "SELECT *, CASE WHEN latex <> '' THEN " + d.strip("latex") + " ELSE said END AS formula, CASE WHEN latex <> '' THEN said ELSE '' END AS about FROM @real_blocks@ WHERE type = 'equation'"
    every = [
        f"SELECT doc_id, CAST(block_idx AS INT) AS block_idx, 0 AS sub, filename, type, CAST(page AS INT) AS page, section, CASE WHEN type <> 'table' THEN said END AS said, CASE WHEN type = 'image' THEN {more('caption', 'footnote', 'description', chr(39) * 2)} END AS more FROM @real_blocks@ WHERE type <> 'equation'",
        f"SELECT doc_id, block_idx, 0, filename, type, page, section, CASE WHEN about <> '' THEN 'Equation: ' || about || '. ' ELSE 'Equation. ' END || 'Formula: ' || {squeezed}, {more('about', chr(39) * 2, chr(39) * 2, 'formula')} FROM ({equation}) e_",
        f"SELECT b.doc_id, b.block_idx, g.grp + 1, b.filename, '@group', b.page, b.section, g.text, {more('coalesce(c.caption, b.caption)', chr(39) * 2, chr(39) * 2, 'g.md')} FROM ({groups}) g JOIN (SELECT doc_id, block_idx, filename, page, section, caption FROM @real_blocks@ WHERE type = 'table') b ON g.doc_id = b.doc_id AND g.block_idx = b.block_idx LEFT JOIN @block_captions@ c ON b.doc_id = c.doc_id AND b.block_idx = c.idx",
        f"SELECT doc_id, idx, -1, CAST(NULL AS STRING), '@caption', CAST(NULL AS INT), CAST(NULL AS STRING), caption, {bare} FROM @block_captions@",
        f"SELECT doc_id, taken, -1, CAST(NULL AS STRING), '@taken', CAST(NULL AS INT), CAST(NULL AS STRING), CAST(NULL AS STRING), {bare} FROM @block_captions@",
    ]
    return " UNION ALL ".join(every)


def items(d: Dialect) -> str:
    """Texts as chunks of their run, tables as groups of rows, equations and figures with the text before them, in order.
    In Spark: docquarry.operators.block_scan."""
    if d.name == "spark":
        return "SELECT * FROM @block_items@"
    runs = block_runs(d)
    texts = d.explode(f"({runs}) r_", "doc_id, filename, block_idx, page, section", d.chunks("content"), "sub", "chunk")
    near = "CASE WHEN context <> '' THEN ' (near: ' || context || ')' ELSE '' END"
    squeezed = lambda c: d.strip(d.replace(c, r"\s+", "' '"))
    said = d.join(d.keep(d.array("caption", "description", "footnote"), "p", "p <> ''"), "' '")
    groups = row_groups(d, "(SELECT doc_id, block_idx, caption, table_body AS body FROM @placed_blocks@ WHERE type = 'table') t_", "doc_id, block_idx")
    every = [
        f"SELECT doc_id, filename, block_idx, sub, 'text' AS type, page, section, chunk, '' AS caption, '' AS raw, '' AS description FROM ({texts}) a_",
        "SELECT doc_id, filename, block_idx, 0, 'text', page, section, said, '', '', '' FROM @placed_blocks@ WHERE type NOT IN ('text', 'image', 'table', 'equation') AND said <> ''",
        f"SELECT doc_id, filename, block_idx, 0, 'image', page, section, 'Figure: ' || {said} || {near}, caption, '', description FROM @placed_blocks@ WHERE type = 'image' AND {said} <> ''",
        f"SELECT p.doc_id, p.filename, p.block_idx, g.grp, 'table', p.page, p.section, g.text, p.caption, g.md, '' FROM ({groups}) g JOIN @placed_blocks@ p ON g.doc_id = p.doc_id AND g.block_idx = p.block_idx",
        f"SELECT doc_id, filename, block_idx, 0, 'equation', page, section, CASE WHEN about <> '' THEN 'Equation: ' || about || '. ' ELSE 'Equation. ' END || 'Formula: ' || {squeezed('formula')} || {near}, about, formula, '' "
        f"FROM (SELECT *, CASE WHEN latex <> '' THEN {d.strip('latex')} ELSE said END AS formula, CASE WHEN latex <> '' THEN said ELSE '' END AS about FROM @placed_blocks@ WHERE type = 'equation') e_ WHERE formula <> ''",
    ]
    order = "PARTITION BY doc_id ORDER BY block_idx, sub"
    return f"SELECT doc_id, filename, CAST(row_number() OVER ({order}) - 1 AS INT) AS idx, type, page, section, chunk, caption, raw, description FROM ({' UNION ALL '.join(every)}) u_"


def docs(d: Dialect) -> str:
    """The text of a document: that of its items, a blank line between."""
    return f"SELECT doc_id, filename, {d.gathered('chunk', 'idx', f'{d.newline()} || {d.newline()}')} AS content FROM @items@ GROUP BY doc_id, filename"


OVER_BLOCKS: dict[str, Callable[[Dialect], str]] = {"real_blocks": real_blocks, "block_captions": block_captions, "named_blocks": named_blocks, "placed_blocks": placed_blocks, "block_runs": block_runs, "laid_blocks": laid_blocks, "items": items, "docs": docs}

# --- a content list for tests ---

BUDGET = "| Office | Budget | Spent |\n|---|---:|---:|\n" + "\n".join(f"| Ward {i} | {i * 120} | {i * 95} |" for i in range(1, 11))
FEES = "| Permit | Fee |\n|---|---|\n| Fishing \\| river | 40 |\n| Market stall | 75 |"
# block: doc_id, filename, block_idx, type, page, section, text, latex, table_body, caption, footnote, description
LIST: list[tuple] = [
    (1, "report.pdf", 0, "text", 0, "Overview", "The municipal audit covers ten wards of the valley. Every ward reported its budget to the auditor in spring.", None, None, None, None, None),
    (1, "report.pdf", 1, "text", 0, "Overview", "Spending stayed below the plan in all of the wards that were visited.", None, None, None, None, None),
    (1, "report.pdf", 2, "text", 0, "Budget", "Table 1: Budget of the wards", None, None, None, None, None),
    (1, "report.pdf", 3, "table", 0, "Budget", None, None, BUDGET, None, None, None),
    (1, "report.pdf", 4, "text", 0, "Budget", "The auditor compared these amounts with the receipts that the treasurer keeps in the archive.", None, None, None, None, None),
    (1, "report.pdf", 5, "image", 1, "Budget", None, None, None, None, "Source: treasurer", "A bar chart of yearly spending, rising from left to right"),
    (1, "report.pdf", 6, "text", 1, "Budget", "Figure 1: Yearly spending of the wards", None, None, None, None, None),
    (1, "report.pdf", 7, "image", 1, "Budget", None, None, None, None, None, None),
    (1, "report.pdf", 8, "warning", 1, None, "damaged_text", None, None, None, None, None),
    (1, "report.pdf", 9, "text", 2, "Closing", "Payments to contractors were delayed because the bank changed its forms. The council will review the permits next winter.", None, None, None, None, None),
    (2, "physics.docx", 0, "text", 0, "Motion", "A body keeps its velocity until a force acts on it. The acceleration grows with the force and falls with the mass of the body.", None, None, None, None, None),
    (2, "physics.docx", 1, "equation", 0, "Motion", "Newton's second law", "F = m  a", None, None, None, None),
    (2, "physics.docx", 2, "equation", 0, "Motion", "E=mc^2", None, None, None, None, None),
    (2, "physics.docx", 3, "equation", 0, "Motion", " ", None, None, None, None, None),
    (2, "physics.docx", 4, "text", 0, "Waves", "Sound travels as a wave through air and water. Permits aren't needed to measure it.", None, None, None, None, None),
    (2, "physics.docx", 5, "code", 0, "Waves", "plot(wave, speed=340)", None, None, None, None, None),
    (2, "physics.docx", 6, "image", 0, "Waves", None, None, None, "A standing wave on a string", None, None),
    (2, "physics.docx", 7, "text", 0, "Waves", "The wavelength of a standing wave is twice the distance between two nodes of the string.", None, None, None, None, None),
    (3, "office.md", 0, "text", 0, None, "The office opens at nine on weekdays. Permits are sold at the second window.", None, None, None, None, None),
    (3, "office.md", 1, "table", 0, None, None, None, FEES, "Fees of permits", None, None),
    (3, "office.md", 2, "text", 0, None, "Fishing in the river needs a permit of the office, renewed each spring before the season starts.", None, None, None, None, None),
    (3, "office.md", 3, "text", 0, None, "", None, None, None, None, None),
    (3, "office.md", 4, None, None, None, "Market stalls are handed out by lot on the first Monday of the month.", None, None, None, None, None),
    (3, "office.md", 5, "table", 0, None, None, None, "| only a head |\n|---|", None, None, None),
    (4, "नीति.txt", 0, "text", 0, None, "नेपालको बजेट यस वर्ष बढेको छ। कार्यालयले अनुमति दिन्छ।", None, None, None, None, None),
    (4, "नीति.txt", 1, "text", 1, None, "Mountain weather changes within hours, so guides carry radios and warm clothing for every member.", None, None, None, None, None),
    (4, "नीति.txt", 2, "text", 2, None, "Permits for the mountain are checked by rangers at the gate of the park each morning.", None, None, None, None, None),
]
# a long register, so that not every item is among the 50 hits of a question
LIST += [(5, "register.txt", n, "text", n, None, f"The archive of village {n + 100} keeps its receipts in box {n * 7 + 3}, and the treasurer compares amounts.", None, None, None, None, None) for n in range(60)]
QUESTIONS = [
    (1, "what is the formula F = m a?"), (2, "what is the formula p = q r s?"), (3, "Summarize"), (4, "tell me about this"), (5, "permits?"), (6, "zebra xylophone quarks"),
    (7, "show the table with the budget of the wards"), (8, "show the figure of yearly spending"), (9, "Why were payments to contractors delayed?"), (10, "distance between two nodes of a standing wave on a string"),
    (11, "नेपालको बजेट बढेको"), (12, "fee for a fishing permit on the river"), (13, "सारांश"), (14, "What acts on a body and changes its velocity?"), (15, ""), (16, "फलफूल"),
    (17, "Which amounts does the auditor compare with the receipts that the treasurer keeps in the archive?"),
]


def content_list(d: Dialect) -> str:
    typed = "CAST(doc_id AS BIGINT) AS doc_id, filename, block_idx, type, page, section, text, latex, table_body, caption, footnote, description"
    return f"SELECT {typed} FROM {rows(d, COLUMNS, LIST)} b_"


def asked(d: Dialect) -> str:
    return f"SELECT CAST(item_id AS BIGINT) AS item_id, text FROM {rows(d, 'item_id, text', QUESTIONS)} q_"


MIXED: dict[str, Callable[[Dialect], str]] = OVER_BLOCKS | {"blocks": content_list, "benchmark": asked}

QUERIES: dict[str, Callable[[Dialect], str]] = {
    "mixed_items": lambda d: "SELECT doc_id, filename, idx, type, page, section, chunk, caption, raw, description FROM @items@",
    "mixed_warnings": lambda d: "SELECT doc_id, block_idx, text FROM @blocks@ WHERE type = 'warning'",
    "mixed_document_content": lambda d: "SELECT doc_id, filename, content FROM @docs@",
}
for _name in (
    "item_counts document_pages item_projection corpus_stats struct_edges graph_summary entity_top8 keyword_coverage vector_rrf retrieve_naive retrieve_local retrieve_global retrieve_hybrid "
    "evidence_gate evidence best_sentences decision_route ambiguity_options topic_options summary_picks first_profile_order"
).split():
    QUERIES[f"mixed_{_name}"] = catalog.QUERIES[_name]
for _name, _build in answers.QUERIES.items():
    QUERIES[f"mixed_{_name}"] = _build
