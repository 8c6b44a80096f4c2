"""Queries over blocks: tables, equations, captions, pages, damaged text, scanned words (relations of plans.derived)."""

from __future__ import annotations

from collections.abc import Callable

from docquarry.functions import words as W
from docquarry.functions.dialect import Dialect

QUERIES: dict[str, Callable[[Dialect], str]] = {}


def query(build: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    QUERIES[build.__name__] = build
    return build


def rows(d: Dialect, columns: str, values: list[tuple]) -> str:
    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            parts = [d.text(p) for p in v.split("\n")]
            return f" || {d.newline()} || ".join(parts)
        return str(v)

    said = ", ".join("(" + ", ".join(literal(x) for x in row) + ")" for row in values)
    return f"(SELECT * FROM (VALUES {said}) AS v_({columns}))"


TABLES = "(SELECT doc_id, 'Lines of order ' || CAST(doc_id AS VARCHAR(20)) AS caption, body FROM @order_tables@) t0_"


def table_cells(d: Dialect, source: str = TABLES, key: str = "doc_id") -> str:
    """Rows of Markdown tables, source(key, caption, body), as arrays of cells; separator rows are left out."""
    lines = d.explode(source, f"{key}, caption", d.split("body", "\n" if d.name == "duck" else r"\n"), "line_no", "line")
    stripped = d.strip("line")
    inner = d.replace(d.replace(stripped, r"^\|+|\|+$", "''"), r"\\\|", "chr(1)")
    cells = d.each(d.split(inner, r"\|"), "c", f"replace({d.strip('c')}, chr(1), '|')")
    separator = f"NOT {d.any('cells', 'c', 'c <> \'\' AND NOT ' + d.matches('c', '^:?-{2,}:?$'))}"
    return f"SELECT {key}, caption, line_no, cells FROM (SELECT {key}, caption, line_no, {cells} AS cells FROM ({lines}) l_ WHERE {stripped} LIKE '|%') c_ WHERE NOT ({separator})"


@query
def markdown_rows(d: Dialect) -> str:
    return f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS row_no, {d.join('cells', chr(39) + ';' + chr(39))} AS cells FROM ({table_cells(d)}) t_"


def row_groups(d: Dialect, source: str = TABLES, key: str = "doc_id") -> str:
    """Groups of eight body rows as `header: value` text with a label that names the rows, and as Markdown (md)."""
    numbered = f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY line_no) - 1 AS n FROM ({table_cells(d, source, key)}) c_"
    pair = d.join(
        d.keep(d.each(d.steps("0", f"least({d.size('h.cells')}, {d.size('b.cells')}) - 1", "1"), "i", f"CASE WHEN {d.at('b.cells', 'CAST(i AS INT)')} <> '' THEN {d.at('h.cells', 'CAST(i AS INT)')} || ': ' || {d.at('b.cells', 'CAST(i AS INT)')} ELSE '' END"), "p", "p <> ''"),
        "'; '",
    )
    same = " AND ".join(f"b.{k} = h.{k}" for k in key.split(", "))
    keys = ", ".join(f"b.{k}" for k in key.split(", "))
    body = f"SELECT {keys}, b.caption, b.n, {d.div('b.n - 1', str(W.TABLE_ROWS))} AS grp, h.cells AS head, b.cells AS cells, {pair} AS said, {d.join(d.keep('h.cells', 'c', 'c <> \'\''), chr(39) + ', ' + chr(39))} AS columns_, count(*) OVER (PARTITION BY {keys}) AS total FROM n_ b JOIN n_ h ON {same} AND h.n = 0 WHERE b.n > 0"
    wide = f"SELECT *, max(greatest({d.size('head')}, {d.size('cells')})) OVER (PARTITION BY {key}, grp) AS wide FROM b_"
    shown = lambda c: f"'| ' || {d.join(d.each(c, 'c', f'replace(c, {d.text(chr(124))}, {d.text(chr(92) + chr(124))})'), chr(39) + ' | ' + chr(39))} || repeat(' | ', CAST(wide - {d.size(c)} AS INT)) || ' |'"
    return (
        f"WITH n_ AS ({numbered}), b_ AS ({body}), w_ AS (SELECT *, {shown('head')} AS top_line, {shown('cells')} AS line FROM ({wide}) v_) "
        f"SELECT {key}, CAST(grp AS INT) AS grp, CASE WHEN max(caption) <> '' THEN 'Table: ' || max(caption) || '.' ELSE 'Table.' END || "
        f"CASE WHEN max(total) > {W.TABLE_ROWS} THEN ' (rows ' || CAST(min(n) AS VARCHAR(9)) || '-' || CAST(max(n) AS VARCHAR(9)) || ' of ' || CAST(max(total) AS VARCHAR(9)) || ')' ELSE '' END || "
        f"' Columns: ' || max(columns_) || '. ' || {d.gathered('said', 'n', chr(39) + ' | ' + chr(39))} AS text, "
        f"max(top_line) || {d.newline()} || '|' || repeat('---|', CAST(max(wide) AS INT)) || {d.newline()} || {d.gathered('line', 'n', d.newline())} AS md FROM w_ GROUP BY {key}, grp"
    )


@query
def table_row_groups(d: Dialect) -> str:
    return f"SELECT doc_id, grp, text, md FROM ({row_groups(d)}) g_"


@query
def equation_filter(d: Dialect) -> str:
    """Which texts and formulas of the blocks look like mathematics."""
    return f"SELECT doc_id, block_idx, {d.equation('s')} AS equation FROM (SELECT doc_id, block_idx, coalesce(latex, text) AS s FROM @blocks@) l_ WHERE s IS NOT NULL"


@query
def formula_match(d: Dialect) -> str:
    """The formula that a question asks for and the first equation that holds it."""
    return "SELECT q.qid, q.formula, h.doc_id, h.idx FROM @asked_formulas@ q LEFT JOIN @formula_hits@ h ON q.qid = h.qid"


BLOCKS = "(SELECT doc_id, block_idx AS idx, type, page, coalesce(text, '') AS body FROM @blocks@ WHERE type IN ('text', 'image', 'table'))"


# How a caption begins.
FIGURE = r"(?i)^\s*(figure|fig\.?|chart|diagram|graph|image|photo|चित्र|नक्सा|ग्राफ)\s*[\dIVXivx]+[\.\:\-–)]?"
TABLE_NAME = r"(?i)^\s*(table|तालिका)\s*[\dIVXivx]+[\.\:\-–)]?"


def captions(d: Dialect, source: str) -> str:
    """(doc_id, idx, taken, caption) of source(doc_id, idx, type, page, body): the text at idx taken names the block at idx.

    A figure asks the block below it first, a table the one above. In order of the blocks a text goes to the first that asks
    for it; only blocks two apart can ask for one text, so each run of such blocks is decided alone.
    """
    near = lambda fn: f"CASE WHEN {fn}(type) OVER w = 'text' AND {fn}(page) OVER w = page THEN {fn}(body) OVER w END AS {fn}_body, {fn}(idx) OVER w AS {fn}_idx"
    fits = lambda c: f"length({c}) <= 250 AND CASE WHEN type = 'image' THEN {d.matches(c, FIGURE)} ELSE {d.matches(c, TABLE_NAME)} END"
    around = f"SELECT * FROM (SELECT *, {near('lead')}, {near('lag')}, row_number() OVER w AS nth_ FROM {source} b_ WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) n_ WHERE type IN ('image', 'table')"
    asking = (
        f"SELECT doc_id, nth_, idx, CASE WHEN type = 'image' THEN 1 ELSE 2 END AS choice, lead_idx AS taken, lead_body AS said FROM ar_ WHERE {fits('lead_body')} "
        f"UNION ALL SELECT doc_id, nth_, idx, CASE WHEN type = 'image' THEN 2 ELSE 1 END, lag_idx, lag_body FROM ar_ WHERE {fits('lag_body')}"
    )
    apart = "SELECT *, CASE WHEN nth_ - lag(nth_) OVER (PARTITION BY doc_id ORDER BY nth_, choice) <= 2 THEN 0 ELSE 1 END AS opens FROM as_"
    runs = f"SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY nth_, choice) AS run FROM ({apart}) p_"
    listed = f"SELECT doc_id, run, {d.collect(d.struct('nth_', 'choice', 'idx', 'taken', 'said'), 'nth_, choice')} AS every FROM ({runs}) r_ GROUP BY doc_id, run"
    chosen = d.choose("every", f"NOT {d.any('$c', 'o', 'o.idx = $x.idx OR o.taken = $x.taken')}")
    out = d.explode(f"(SELECT doc_id, {chosen} AS chosen FROM ({listed}) l_) c_", "doc_id", "chosen", "spot", "o")
    return f"WITH ar_ AS ({around}), as_ AS ({asking}) SELECT doc_id, o.idx AS idx, o.taken AS taken, {d.strip('o.said')} AS caption FROM ({out}) e_"


@query
def caption_attachment(d: Dialect) -> str:
    """Each figure or table with the text that names it."""
    return f"SELECT b.doc_id, b.idx, b.type, c.caption, c.taken FROM {BLOCKS} b LEFT JOIN ({captions(d, BLOCKS)}) c ON b.doc_id = c.doc_id AND b.idx = c.idx WHERE b.type <> 'text'"


@query
def text_runs(d: Dialect) -> str:
    """Runs of text blocks on one page, broken by anything else."""
    starts = "SELECT *, CASE WHEN type = lag(type) OVER w AND page = lag(page) OVER w AND type = 'text' THEN 0 ELSE 1 END AS opens FROM {0} b_ WINDOW w AS (PARTITION BY doc_id ORDER BY idx)"
    runs = f"SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM ({starts.format(BLOCKS)}) o_"
    return f"SELECT doc_id, CAST(run AS INT) AS run, min(idx) AS first_block, count(*) AS blocks FROM ({runs}) r_ WHERE type = 'text' GROUP BY doc_id, run"


@query
def page_ranges(d: Dialect) -> str:
    """The pages of a document on which a number is written, as ranges."""
    listed = f"(SELECT DISTINCT doc_id, page FROM @blocks@ WHERE type = 'text' AND {d.matches('text', '[0-9]')})"
    said = "CASE WHEN min(page) = max(page) THEN CAST(min(page) + 1 AS VARCHAR(9)) ELSE CAST(min(page) + 1 AS VARCHAR(9)) || '-' || CAST(max(page) + 1 AS VARCHAR(9)) END"
    islands = f"SELECT doc_id, min(page) AS p, {said} AS said FROM (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS island FROM {listed} p_) i_ GROUP BY doc_id, island"
    return f"SELECT doc_id, {d.gathered('said', 'p', chr(39) + ', ' + chr(39))} AS pages FROM ({islands}) s_ GROUP BY doc_id"


@query
def damaged_text(d: Dialect) -> str:
    """Devanagari with too few joining signs for its consonants, or with glyphs that weren't read."""
    # The consonants, how many are needed to tell, and the two shares.
    consonants = d.size(d.find_all("s", "[\\x{0915}-\\x{0939}\\x{0958}-\\x{095F}]"))
    count = lambda sign: f"(length(s) - length(replace(s, {sign}, '')))"
    joined, unread = count("'्'"), count("chr(0)")
    return f"SELECT doc_id, {consonants} >= 40 AND ({joined} < 0.015 * {consonants} OR {unread} > 0.02 * length(s)) AS damaged FROM @damaged_texts@"


@query
def damaged_match(d: Dialect) -> str:
    """Whether a token can be a question's word that lost letters: a subsequence of it, long enough."""
    bare = lambda c: f"replace({c}, 'ि', '')"
    wild = "'%' || array_join(split(t, ''), '%') || '%'" if d.name == "spark" else "'%' || array_to_string(string_split(t, ''), '%') || '%'"
    # The least lengths, and the shares of the word that must be left.
    rule = f"q = t OR (length(q) >= 4 AND length(t) >= 3 AND q LIKE {wild} AND ((left(q, 1) = left(t, 1) AND length(t) >= 0.35 * length(q)) OR (length(t) >= 4 AND length(t) >= 0.6 * length(q))))"
    script = lambda c: d.matches(c, "[\\x{0900}-\\x{097F}]")
    return f"SELECT term, kind, {script('q')} AND {script('t')} AND ({rule}) AS matched FROM (SELECT term, kind, {bare('q0')} AS q, {bare('t0')} AS t FROM @damaged_pairs@) b_"


@query
def scanned_paragraphs(d: Dialect) -> str:
    """Recognised words, grouped into paragraphs with their place on the page."""
    return f"SELECT doc_id, par, min(y) AS top_, {d.gathered('word', 'n', chr(39) + ' ' + chr(39))} AS text FROM @scanned_words@ WHERE conf >= 0 AND word <> '' GROUP BY doc_id, par"


@query
def outside_boxes(d: Dialect) -> str:
    """Words of a page whose centre lies in no table box: a word is 30 wide and 10 high."""
    inside = "(w.x + w.x + 30) / 2.0 BETWEEN b.x0 AND b.x1 AND (w.y + w.y + 10) / 2.0 BETWEEN b.y0 AND b.y1"
    return f"SELECT w.doc_id, w.par, w.n FROM @scanned_words@ w LEFT JOIN @table_boxes@ b ON w.doc_id = b.doc_id AND {inside} WHERE b.doc_id IS NULL"


def modal_text(d: Dialect) -> str:
    """What is shown of an item that isn't text: of type, page, pages, caption, raw, description, chunk."""
    nl = f"{d.newline()} || {d.newline()}"
    page = "CASE WHEN pages > 1 THEN ' (page ' || CAST(page + 1 AS VARCHAR(9)) || ')' ELSE '' END"
    return (
        f"CASE type WHEN 'table' THEN '**Table**' || {page} || CASE WHEN caption <> '' THEN ': ' || caption ELSE '' END || {nl} || raw "
        f"WHEN 'equation' THEN '**Equation**' || {page} || {nl} || '```' || {d.newline()} || raw || {d.newline()} || '```' "
        f"ELSE '**Figure**' || {page} || CASE WHEN caption <> '' THEN {nl} || caption ELSE '' END || CASE WHEN description <> '' THEN {nl} || description ELSE '' END || "
        f"CASE WHEN caption = '' AND description = '' THEN {nl} || left(chunk, 300) ELSE '' END END"
    )


@query
def modal_answers(d: Dialect) -> str:
    """What is shown of each item that isn't text."""
    pages = "SELECT doc_id, max(page) + 1 AS pages FROM @items@ GROUP BY doc_id"
    return f"SELECT doc_id, idx, {modal_text(d)} AS answer FROM (SELECT i.*, p.pages FROM @items@ i JOIN ({pages}) p ON i.doc_id = p.doc_id WHERE i.type <> 'text') r_"
