"""Changes to a stored corpus: documents go, missing vectors are made anew, uploads are let in.

Deleting takes what the removed items added back out of the stored counts. The statements for DuckDB make everything anew
without the removed documents instead, so the two agree only if nothing was left behind.
"""

from __future__ import annotations

from collections.abc import Callable

from docquarry.functions.dialect import Dialect
from docquarry.plans import relations
from docquarry.plans.relations import relation

# Endings of the files that are taken, and the limits of an upload.
KINDS = ("txt", "pdf", "md", "docx", "png", "jpg", "jpeg", "webp", "bmp")
MOST_BYTES, MOST_DOCUMENTS = 52_428_800, 200


@relation
def gone(d: Dialect) -> str:
    """(doc_id): the documents to delete, those whose label is of low quality."""
    return "SELECT DISTINCT CAST(doc_id AS BIGINT) AS doc_id FROM @labels@ WHERE quality = 0 AND doc_id IS NOT NULL"


def _left(name: str) -> str:
    return f"SELECT t.* FROM @{name}@ t LEFT JOIN @gone@ g ON t.doc_id = g.doc_id WHERE g.doc_id IS NULL"


def _taken(name: str) -> str:
    return f"SELECT t.* FROM @{name}@ t JOIN @gone@ g ON t.doc_id = g.doc_id"


@relation
def left_items(d: Dialect) -> str:
    return _left("items")


@relation
def left_tf(d: Dialect) -> str:
    return _left("entity_tf")


@relation
def left_df(d: Dialect) -> str:
    """Document frequencies less those of the removed items; entities without any go."""
    taken = f"SELECT entity, count(*) AS n FROM ({_taken('entity_tf')}) t_ GROUP BY entity"
    return f"SELECT f.entity, f.df - coalesce(t.n, 0) AS df FROM @entity_df@ f LEFT JOIN ({taken}) t ON f.entity = t.entity WHERE f.df > coalesce(t.n, 0)"


@relation
def left_mentions(d: Dialect) -> str:
    """The mentions of the remaining items. Weights change with the number of items, so they are weighed again: in Spark of their
    texts, by docquarry.operators.entity_counts, once for all that reads them (left_entities)."""
    if d.name == "spark":
        return "SELECT doc_id, idx, e.entity, e.tf, e.df, e.weight, at + 1 AS rank FROM @left_entities@ LATERAL VIEW posexplode(said) AS at, e"
    n = f"SELECT greatest((SELECT count(*) FROM @items@) - (SELECT count(*) FROM ({_taken('items')}) t_), 1) AS n"
    return relations.weighed(d, "@left_tf@", "@left_df@", n)


@relation
def regrouped(d: Dialect) -> str:
    """(doc_id, idx): remaining items whose eight entities are others than before."""
    if d.name == "spark":
        return "SELECT doc_id, idx FROM @changed_entities@ WHERE NOT taken"
    old, new = f"SELECT doc_id, idx, entity FROM ({_left('mentions')}) o_", "SELECT doc_id, idx, entity FROM @left_mentions@"
    one_side = lambda a, b: f"SELECT a.doc_id, a.idx FROM ({a}) a LEFT JOIN ({b}) b ON a.doc_id = b.doc_id AND a.idx = b.idx AND a.entity = b.entity WHERE b.entity IS NULL"
    return f"SELECT DISTINCT doc_id, idx FROM ({one_side(old, new)} UNION ALL {one_side(new, old)}) c_"


@relation
def changed_entities(d: Dialect) -> str:
    """Spark: (doc_id, idx, taken, before, after): removed items and remaining ones whose eight entities are others than before, with
    their entities in order; an item without any has none."""
    listed = lambda name: f"SELECT doc_id, idx, array_sort(transform(said, e -> e.entity)) AS every FROM @{name}@"
    old = f"SELECT t.doc_id, t.idx, t.every, g.doc_id IS NOT NULL AS taken FROM ({listed('item_entities')}) t LEFT JOIN @gone@ g ON t.doc_id = g.doc_id"
    both = f"SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.idx, n.idx) AS idx, coalesce(o.taken, FALSE) AS taken, o.every AS before, n.every AS after FROM ({old}) o FULL JOIN ({listed('left_entities')}) n ON o.doc_id = n.doc_id AND o.idx = n.idx"
    return f"SELECT * FROM ({both}) b_ WHERE NOT before <=> after"


@relation
def left_links(d: Dialect) -> str:
    """Spark: what is left of links, each pair once (a < b): less the pairs of removed and regrouped items, with the new ones of the
    latter. An item's pairs are made of its list."""
    pairs = lambda side, sign: f"SELECT x AS a, y AS b, {sign}1L AS weight FROM (SELECT {side} AS every, x FROM @changed_entities@ LATERAL VIEW explode({side}) AS x) x_ LATERAL VIEW explode(filter(every, z -> z > x)) AS y"
    return f"SELECT a, b, sum(weight) AS weight FROM (SELECT a, b, weight FROM @links@ UNION ALL {pairs('before', '-')} UNION ALL {pairs('after', '')}) u_ GROUP BY a, b HAVING sum(weight) > 0"


@relation
def left_cooccur(d: Dialect) -> str:
    """Co-occurrence less the pairs of removed and regrouped items, and with the new pairs of the latter."""
    if d.name == "spark":
        return "SELECT a, b, weight FROM (SELECT inline(array(named_struct('a', a, 'b', b, 'weight', weight), named_struct('a', b, 'b', a, 'weight', weight))) FROM @left_links@) l_"

    def pairs(rows: str, sign: str) -> str:
        return f"SELECT a.entity AS a, b.entity AS b, {sign}count(*) AS weight FROM ({rows}) a JOIN ({rows}) b ON a.doc_id = b.doc_id AND a.idx = b.idx AND a.entity <> b.entity GROUP BY a.entity, b.entity"

    among = lambda name: f"SELECT m.doc_id, m.idx, m.entity FROM @{name}@ m JOIN @regrouped@ r ON m.doc_id = r.doc_id AND m.idx = r.idx"
    before = f"SELECT doc_id, idx, entity FROM ({_taken('mentions')}) t_ UNION ALL {among('mentions')}"
    return f"SELECT a, b, sum(weight) AS weight FROM (SELECT a, b, weight FROM @cooccur@ UNION ALL {pairs(before, '-')} UNION ALL {pairs(among('left_mentions'), '')}) u_ GROUP BY a, b HAVING sum(weight) > 0"


# The same relations made anew, for the statements that check them.
REBUILT: dict[str, Callable[[Dialect], str]] = {
    "docs": lambda d: f"SELECT c.* FROM ({relations.docs(d)}) c LEFT JOIN @gone@ g ON c.doc_id = g.doc_id WHERE g.doc_id IS NULL",
    "left_items": lambda d: "SELECT * FROM @items@", "left_df": lambda d: "SELECT * FROM @entity_df@", "left_mentions": lambda d: "SELECT * FROM @mentions@", "left_cooccur": lambda d: "SELECT * FROM @cooccur@",
}

DELETED: dict[str, Callable[[Dialect], str]] = {
    "deleted_items": lambda d: "SELECT doc_id, idx, chunk FROM @left_items@",
    "deleted_entity_df": lambda d: "SELECT entity, df FROM @left_df@",
    "deleted_mentions": lambda d: "SELECT doc_id, idx, entity, tf, round(weight, 6) AS weight, CAST(rank AS INT) AS place FROM @left_mentions@",
    "deleted_cooccurrence": lambda d: "SELECT a, b, CAST(weight AS BIGINT) AS weight FROM @left_cooccur@",
    "deleted_graph_summary": lambda d: "SELECT (SELECT count(*) FROM @left_items@) AS items, (SELECT count(DISTINCT entity) FROM @left_mentions@) AS entities, CAST((SELECT count(*) FROM @left_cooccur@) / 2 AS BIGINT) AS entity_links",
}


@relation
def kept_vecs(d: Dialect) -> str:
    """Vectors as a store may hold them: those of toxic documents are missing, and some are of documents that are gone."""
    return "SELECT v.doc_id, v.idx, v.v, v.norm2 FROM @vecs@ v LEFT JOIN (SELECT DISTINCT doc_id FROM @labels@ WHERE toxic = 1) t ON v.doc_id = t.doc_id WHERE t.doc_id IS NULL UNION ALL SELECT -1 - doc_id, idx, v, norm2 FROM @vecs@"


@relation
def missing_items(d: Dialect) -> str:
    return "SELECT i.doc_id, i.idx, i.words FROM @item_words@ i LEFT JOIN @kept_vecs@ v ON i.doc_id = v.doc_id AND i.idx = v.idx WHERE v.doc_id IS NULL"


@relation
def restored_vecs(d: Dialect) -> str:
    """Stored vectors of items that are there, and new ones of those that had none: only these are read again."""
    made = f"SELECT doc_id, idx, v, CAST({relations.dot(d, 'v', 'v')} AS BIGINT) AS norm2 FROM ({relations.vector(d, 'doc_id, idx', '@missing_items@')}) n_"
    return f"SELECT v.doc_id, v.idx, v.v, v.norm2 FROM @kept_vecs@ v JOIN @items@ i ON v.doc_id = i.doc_id AND v.idx = i.idx UNION ALL {made}"


def uploads(d: Dialect, most_bytes: int = MOST_BYTES, most_documents: int = MOST_DOCUMENTS) -> str:
    """Each file of an upload, in order of arrival, with what is wrong with it or its number among the documents let in.

    A file is refused for its kind, then for its size, then because the corpus is full: files that passed before it fill
    it. They are counted in a thousand ranges of ids, whose totals give where each begins. A null id arrives last.
    """
    name = "'page' || coalesce(CAST(page_id AS VARCHAR(20)), '') || CASE WHEN url IS NULL THEN '' WHEN url LIKE '%?%' THEN '.md' WHEN url LIKE '%#%' THEN '.HTML' ELSE '.TXT' END"
    ending = f"CASE WHEN {d.matches('filename', '[.][^.]+$')} THEN lower({d.at(d.split('filename', '[.]'), d.size(d.split('filename', '[.]')) + ' - 1')}) ELSE '' END"
    known = ", ".join(f"'{k}'" for k in KINDS)
    files = f"SELECT page_id, filename, CASE WHEN {ending} NOT IN ({known}) THEN 'Unsupported file type ' || CASE WHEN {ending} = '' THEN '' ELSE '.' END || {ending} WHEN n_bytes > {most_bytes} THEN 'File too large' END AS fault FROM (SELECT page_id, {name} AS filename, octet_length({'coalesce(html, chr(32))' if d.name == 'spark' else 'encode(coalesce(html, chr(32)))'}) AS n_bytes FROM @pages@) f_"
    width = f"greatest({d.div('hi - lo', '1000')} + 1, 1)"
    ranged = f"SELECT f.page_id, f.filename, f.fault, CASE WHEN f.fault IS NULL THEN 1 ELSE 0 END AS fits, coalesce({d.div('f.page_id - e.lo', width)}, 1001) AS part FROM ({files}) f CROSS JOIN (SELECT min(page_id) AS lo, max(page_id) AS hi FROM @pages@) e"
    before = "SELECT part, sum(n) OVER (ORDER BY part) - n AS before FROM (SELECT part, sum(fits) AS n FROM r_ GROUP BY part) n_"
    counted = "SELECT r.page_id, r.filename, r.fault, b.before + sum(r.fits) OVER (PARTITION BY r.part ORDER BY r.page_id, r.filename, r.fault ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM r_ r JOIN b_ b ON r.part = b.part"
    return (
        f"WITH r_ AS ({ranged}), b_ AS ({before}) SELECT page_id, filename, CASE WHEN fault IS NOT NULL THEN fault WHEN place > {most_documents} THEN 'Document limit reached' END AS error, "
        f"CASE WHEN fault IS NULL AND place <= {most_documents} THEN CAST(place AS BIGINT) END AS place FROM ({counted}) c_"
    )


QUERIES: dict[str, Callable[[Dialect], str]] = {
    "restored_vectors": lambda d: f"SELECT doc_id, idx, norm2, {d.join(d.each('v', 'x', 'CAST(x AS VARCHAR(20))'), chr(39) + ',' + chr(39))} AS v FROM @restored_vecs@",
    "missing_items": lambda d: "SELECT doc_id, idx FROM @missing_items@",
    "upload_report": uploads,
    "upload_small_limits": lambda d: uploads(d, 12_000, 60),
    "upload_totals": lambda d: f"SELECT coalesce(error, 'ok') AS verdict, count(*) AS n FROM ({uploads(d)}) u_ GROUP BY coalesce(error, 'ok')",
}
