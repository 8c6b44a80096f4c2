"""A content list made of the driver's tables, so that tables, equations, figures, captions and damaged text have rows.

The documents hold plain lines only. Here each document also gets what other tables say under its number: the lines of its
order as a table with a caption, the price rule of its part as an equation, its web page as a figure, an event as code, and
a warning where its label is of low quality. Questions ask for all of these besides what the batch asks.
"""

from __future__ import annotations

from collections.abc import Callable

from docquarry.functions.dialect import Dialect
from docquarry.plans import mixed, relations

LINES_A_PAGE, LINES_A_SECTION = 12, 30
#: A block's place is that of its line times STEP; what belongs to a document is put behind its first line.
STEP = 10

# How Latin letters are written in Devanagari here, for texts with and without the sign that joins consonants.
LATIN, DEVANAGARI = "bcdfghjklmnpqrstvwxyzaiou", "बचदफगहजकलमनपखरसतवभषयझािोु"


def text_lines(d: Dialect) -> str:
    """(doc_id, filename, line_no, line) of every document, blank lines among them."""
    return d.explode("@source_docs@", "doc_id, filename", d.split("content", "\n" if d.name == "duck" else r"\n"), "line_no", "line")


def order_tables(d: Dialect) -> str:
    """(doc_id, body): the lines of the order of that number as a Markdown table."""
    said = lambda c: f"coalesce(CAST({c} AS VARCHAR(20)), '')"
    whole = lambda c: said(f"CAST(floor({c}) AS BIGINT)")
    cells = f"'| ' || {said('l_linenumber')} || ' | ' || {whole('l_quantity')} || ' | ' || {whole('l_extendedprice')} || ' | ' || {said('l_returnflag')} || " + d.text("\\|") + f" || {said('l_linestatus')} || ' |'"
    head = f"'| Line | Quantity | Price | Flags |' || {d.newline()} || '|---|---:|---:|---|' || {d.newline()}"
    rows = f"SELECT l_orderkey, coalesce(l_linenumber, -1) AS nth, coalesce(l_partkey, -1) AS part, {cells} AS cells FROM @lineitem@ WHERE l_orderkey IS NOT NULL"
    return f"SELECT CAST(l_orderkey AS BIGINT) AS doc_id, {head} || {d.gathered('cells', 'nth, part, cells', d.newline())} AS body FROM ({rows}) r_ GROUP BY l_orderkey"


def doc_tables(d: Dialect) -> str:
    """Spark: order_tables of the orders that are documents; lines of others go before they become text."""
    return order_tables(d).replace("FROM @lineitem@", "FROM @lineitem@ LEFT SEMI JOIN @source_docs@ s ON l_orderkey = s.doc_id")


def price_rules(d: Dialect) -> str:
    """(doc_id, about, latex): an equation for the part of that number."""
    return "SELECT CAST(p_partkey AS BIGINT) AS doc_id, 'Price rule of the ' || min(p_name) AS about, 'v_' || CAST(p_partkey AS VARCHAR(20)) || ' = ' || CAST(min(p_size) AS VARCHAR(20)) || ' m + ' || CAST(p_partkey AS VARCHAR(20)) AS latex FROM @part@ WHERE p_partkey IS NOT NULL GROUP BY p_partkey"


def web_pages(d: Dialect) -> str:
    """(doc_id, url, host): the page of that number."""
    return f"SELECT page_id AS doc_id, url, {d.at(d.split('url', '/'), '2')} AS host FROM (SELECT CAST(page_id AS BIGINT) AS page_id, min(url) AS url FROM @pages@ WHERE page_id IS NOT NULL AND url IS NOT NULL GROUP BY page_id) p_"


def blocks(d: Dialect) -> str:
    page, section = d.div("line_no", str(LINES_A_PAGE)), d.div("line_no", str(LINES_A_SECTION))
    none = f"CAST(NULL AS {'STRING' if d.name == 'spark' else 'VARCHAR'})"

    def one(source: str, at: int, kind: str, **fields: str) -> str:
        said = ", ".join(f"{fields.get(c, none)}" for c in ("text", "latex", "table_body", "caption", "footnote", "description"))
        return f"SELECT s.doc_id, c.filename, {at}, '{kind}', 0, 'Part 1', {said} FROM ({source}) s JOIN (SELECT doc_id, filename FROM @source_docs@) c ON s.doc_id = c.doc_id"

    number = "CAST(s.doc_id AS VARCHAR(20))"
    events = "@events@ LEFT SEMI JOIN @source_docs@ s_ ON event_id = s_.doc_id" if d.name == "spark" else "@events@"
    tables = "SELECT * FROM @doc_tables@" if d.name == "spark" else "SELECT * FROM @order_tables@"
    every = [
        f"SELECT doc_id, filename, CAST(line_no * {STEP} AS INT) AS block_idx, 'text' AS type, CAST({page} AS INT) AS page, 'Part ' || CAST({section} + 1 AS VARCHAR(20)) AS section, line AS text, {none} AS latex, {none} AS table_body, {none} AS caption, {none} AS footnote, {none} AS description FROM @text_lines@",
        one(tables, 1, "text", text=f"'Table ' || {number} || ': Lines of order ' || {number}"),
        one(tables, 2, "table", table_body="s.body"),
        one("SELECT * FROM @price_rules@", 3, "equation", text="s.about", latex="s.latex"),
        one("SELECT * FROM @web_pages@", 4, "image", description="CASE WHEN s.url LIKE 'https://%' THEN 'A page at ' || s.url END", footnote="CASE WHEN s.url LIKE '%?%' THEN 'Source: ' || s.url END"),
        one("SELECT * FROM @web_pages@ WHERE url LIKE '%.com%'", 5, "text", text=f"'Figure ' || {number} || ': Page of ' || s.host"),
        one(f"SELECT CAST(event_id AS BIGINT) AS doc_id, min(props) AS props FROM {events} WHERE event_id IS NOT NULL GROUP BY event_id", 6, "code", text="s.props"),
        one("SELECT CAST(doc_id AS BIGINT) AS doc_id FROM @labels@ WHERE quality = 0 GROUP BY doc_id", 7, "warning", text="'damaged_text'"),
    ]
    return " UNION ALL ".join(every)


def asked(d: Dialect) -> str:
    """The batch's questions, and for each what is said under its number: the formula, the table, the figure, and two of its
    words alone. qid is the number times 10 and the kind of question."""
    none = f"CAST(NULL AS {'STRING' if d.name == 'spark' else 'VARCHAR'})"
    first = "SELECT item_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(text, '')) AS nth FROM @benchmark@ WHERE item_id IS NOT NULL"
    items = f"(SELECT CAST(item_id AS BIGINT) AS item_id, text FROM ({first}) f_ WHERE nth = 1)"
    words = d.split("text", r"\s+")
    # in Spark the orders of all lines don't become tables for it
    ordered = "LEFT SEMI JOIN @lineitem@ t ON t.l_orderkey = b.item_id" if d.name == "spark" else "JOIN @order_tables@ t ON t.doc_id = b.item_id"
    every = [
        f"SELECT item_id * 10 AS qid, text AS question FROM {items} b",
        f"SELECT b.item_id * 10 + 1, 'what is the formula ' || e.latex || '?' FROM {items} b JOIN @price_rules@ e ON e.doc_id = b.item_id",
        f"SELECT b.item_id * 10 + 2, 'show the table with the lines of order ' || CAST(b.item_id AS VARCHAR(20)) FROM {items} b {ordered}",
        f"SELECT b.item_id * 10 + 3, 'show the figure: page of ' || w.host FROM {items} b JOIN @web_pages@ w ON w.doc_id = b.item_id",
        f"SELECT item_id * 10 + 4, {d.at('words_', '1')} || ' ' || {d.at('words_', '2')} || '?' FROM (SELECT item_id, {words} AS words_ FROM {items} b) w_ WHERE {d.size('words_')} > 2",
        "SELECT CAST(-1 AS BIGINT), 'Summarize'", "SELECT CAST(-2 AS BIGINT), 'tell me about this'", "SELECT CAST(-3 AS BIGINT), 'what is the formula z9 = 12 q9 + 5555?'",
        "SELECT CAST(-4 AS BIGINT), 'लेखापरीक्षणको सूत्र के हो'",
    ]
    return f"SELECT qid, question, {none} AS scope, '' AS aux FROM ({' UNION ALL '.join(every)}) q_"


def devanagari(d: Dialect, text: str) -> str:
    """A text in Devanagari letters."""
    return f"translate(lower({text}), '{LATIN}', '{DEVANAGARI}')"


def damaged_texts(d: Dialect) -> str:
    """(doc_id, s): every document in Devanagari letters, and as reading it from a file can leave it: English ones whole, French
    ones with unmapped glyphs, the others without the joining sign."""
    written = devanagari(d, "coalesce(text, '')")
    whole = f"replace({written}, 'e', '्')"
    by_lang = f"CASE WHEN lang = 'en' THEN {whole} WHEN lang = 'fr' THEN replace({whole}, 'ि', chr(0)) ELSE replace({written}, 'e', 'े') END"
    return f"SELECT doc_id, min(s) AS s FROM (SELECT doc_id, {by_lang} AS s FROM @documents@ WHERE doc_id IS NOT NULL) t_ GROUP BY doc_id"


def damaged_pairs(d: Dialect) -> str:
    """(term, kind, q0, t0): words of the questions in Devanagari letters, beside what is left when every third letter goes, and
    beside their halves in the other order."""
    terms = f"SELECT DISTINCT term FROM ({d.explode('@questions@', 'qid', 'terms', 'spot', 'term')}) t_"
    said = devanagari(d, "term")
    half = d.div("length(q0)", "2")
    shorter = d.replace(said, "(..).", d.group_one("''"))
    return f"SELECT term, 'lost' AS kind, {said} AS q0, {shorter} AS t0 FROM ({terms}) a_ UNION ALL SELECT term, 'swapped', q0, substr(q0, CAST({half} + 1 AS INT)) || left(q0, CAST({half} AS INT)) FROM (SELECT term, {said} AS q0 FROM ({terms}) c_) b_"


def scanned_words(d: Dialect) -> str:
    """(doc_id, par, n, x, y, conf, word): the words of every line as a scan would find them; single letters are noise."""
    words = d.split("line", r"\s+")
    return f"SELECT doc_id, line_no AS par, n, n * 40 AS x, line_no * 12 AS y, CASE WHEN length(word) = 1 THEN -1 ELSE 50 + length(word) END AS conf, word FROM ({d.explode('@text_lines@', 'doc_id, line_no', words, 'n', 'word')}) w_"


def table_boxes(d: Dialect) -> str:
    """(doc_id, x0, y0, x1, y1): where the table of a document would stand on its page: as many lines high as it has rows."""
    return f"SELECT doc_id, 30 AS x0, 6 AS y0, 210 AS x1, 12 * {d.size(d.split('body', chr(10) if d.name == 'duck' else r'\n'))} AS y1 FROM @order_tables@"


MIXED: dict[str, Callable[[Dialect], str]] = mixed.OVER_BLOCKS | {
    "source_docs": relations.docs, "text_lines": text_lines, "order_tables": order_tables, "doc_tables": doc_tables, "price_rules": price_rules, "web_pages": web_pages, "blocks": blocks, "asked": asked,
    "damaged_texts": damaged_texts, "damaged_pairs": damaged_pairs, "scanned_words": scanned_words, "table_boxes": table_boxes,
}
