"""The queries over the driver's tables, one statement each, for both dialects."""

from __future__ import annotations

from collections.abc import Callable

from docquarry.functions import words as W
from docquarry.functions.dialect import Dialect, quoted
from docquarry.plans.relations import retrieved
from docquarry.plans.upkeep import KINDS as UPLOADS, MOST_BYTES as UPLOAD_BYTES

QUERIES: dict[str, Callable[[Dialect], str]] = {}


def query(build: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    QUERIES[build.__name__] = build
    return build


def _simple(name: str, sql: str) -> None:
    QUERIES[name] = lambda d: sql


_simple("sentences", "SELECT doc_id, pos, sentence FROM @sentences@")
_simple("chunks", "SELECT doc_id, idx, chunk FROM @items@")
_simple("chunk_stats", "SELECT doc_id, count(*) AS n_chunks, sum(length(chunk)) AS n_chars, max(length(chunk)) AS longest FROM @items@ GROUP BY doc_id")
_simple("item_tokens", "SELECT doc_id, idx, token FROM @item_tokens@")
_simple("token_df", "SELECT token, count(*) AS df FROM @item_tokens@ GROUP BY token")
_simple("item_counts", "SELECT doc_id, type, count(*) AS n FROM @items@ GROUP BY doc_id, type")
_simple("document_pages", "SELECT doc_id, max(page) + 1 AS pages FROM @items@ GROUP BY doc_id")
_simple("document_content", "SELECT doc_id, filename, content FROM @docs@")
_simple("item_projection", "SELECT doc_id, idx, type, page, left(chunk, 300) AS text FROM @items@")
_simple("knn_top50", "SELECT qid, doc_id, idx, round(dense, 6) AS dense, CAST(r AS INT) AS r FROM @top_dense@")
_simple("z_score", "SELECT qid, n_items, round(top, 6) AS top, round(z, 6) AS z FROM @spread@")
_simple("keyword_overlap", "SELECT qid, doc_id, idx, overlap FROM @shared_words@")
_simple("near_words", "SELECT term, token FROM @near_words@")
_simple("fuzzy_coverage", "SELECT qid, doc_id, idx, round(CAST(matched AS DOUBLE) / n_terms, 6) AS coverage FROM @fuzzy_overlap@")
_simple("top_overlap", "SELECT qid, doc_id, idx, overlap, CAST(r AS INT) AS place FROM @top_words@")
_simple("candidates", "SELECT qid, doc_id, idx FROM @candidates@")
_simple("keyword_coverage", "SELECT qid, doc_id, idx, round(coverage, 6) AS coverage FROM @hits@")
_simple("hybrid_score", "SELECT qid, doc_id, idx, round(hybrid, 6) AS hybrid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(hybrid, 9) DESC, doc_id, idx) AS INT) AS place FROM @hits@")
_simple("vector_rrf", "SELECT qid, doc_id, idx, round(rrf, 6) AS rrf, CAST(rrf_rank AS INT) AS rrf_rank, CAST(vec_rank AS INT) AS vec_rank FROM @vector_order@")
_simple("entity_tf", "SELECT doc_id, idx, entity, tf FROM @entity_tf@")
_simple("entity_df", "SELECT entity, df FROM @entity_df@")
_simple("entity_top8", "SELECT doc_id, idx, entity, round(weight, 6) AS weight, CAST(rank AS INT) AS place FROM @mentions@")
_simple("cooccurrence", "SELECT a, b, weight FROM @cooccur@")
_simple("struct_edges", "SELECT doc_id, src, dst, kind FROM @struct_edges@")
_simple("entity_degree", "SELECT a AS entity, sum(weight) AS degree FROM @cooccur@ GROUP BY a")
_simple("graph_summary", "SELECT (SELECT count(*) FROM @items@) AS items, (SELECT count(DISTINCT entity) FROM @mentions@) AS entities, CAST((SELECT count(*) FROM @cooccur@) / 2 AS BIGINT) AS entity_links, CAST((SELECT count(*) FROM @struct_edges@) / 2 AS BIGINT) AS structure_links")
_simple("top_entities", "WITH g_ AS (SELECT a, sum(weight) AS degree FROM @cooccur@ GROUP BY a), t_ AS (SELECT a FROM g_ ORDER BY degree DESC, a LIMIT 40) SELECT c.a AS source, c.b AS target, c.weight FROM @cooccur@ c JOIN t_ x ON c.a = x.a JOIN t_ y ON c.b = y.a WHERE c.a < c.b")
_simple("question_entities", "SELECT qid, entity FROM @question_entities@")
_simple("local_scores", "SELECT qid, doc_id, idx, score FROM @local_scores@")
_simple("global_scores", "SELECT qid, doc_id, idx, score FROM @global_scores@")
_simple("evidence_gate", "SELECT qid, round(cover, 6) AS cover, round(z, 6) AS z, supported, confidence FROM @gate@")
_simple("evidence", "SELECT qid, CAST(place AS INT) AS place, doc_id, idx, filename, left(chunk, 320) AS snippet, round(dense, 3) AS score, via FROM @evidence@")
_simple("best_sentences", "SELECT qid, place, sentence FROM @best_sentences@")
_simple("decision_route", "SELECT qid, route, lang, confidence FROM @decisions@")
_simple("answer_sources", "SELECT qid, filename, CAST(row_number() OVER (PARTITION BY qid ORDER BY first) AS INT) AS place FROM (SELECT qid, filename, min(place) AS first FROM @evidence@ GROUP BY qid, filename) s_")
_simple("missing_vectors", "SELECT i.doc_id, i.idx FROM @items@ i LEFT JOIN @vecs@ v ON i.doc_id = v.doc_id AND i.idx = v.idx WHERE v.doc_id IS NULL")
_simple("delete_document", "SELECT i.doc_id, count(*) AS n FROM @items@ i LEFT JOIN (SELECT DISTINCT doc_id FROM @labels@ WHERE quality = 0) g ON i.doc_id = g.doc_id WHERE g.doc_id IS NULL GROUP BY i.doc_id")
_simple("delete_all", "SELECT (SELECT count(*) FROM @docs@) AS deleted, count(*) AS remaining FROM @docs@ WHERE FALSE")

for _mode in ("naive", "local", "global", "hybrid"):
    QUERIES[f"retrieve_{_mode}"] = lambda d, m=_mode: f"SELECT qid, doc_id, idx, via, round(fused, 6) AS fused, CAST(pos AS INT) AS pos FROM ({retrieved(d, m)}) r_"


@query
def document_list(d: Dialect) -> str:
    """Documents, newest id first. Ranked in a thousand ranges of ids, whose counts give where each begins; null ids come last."""
    width = f"greatest({d.div('hi - lo', '1000')} + 1, 1)"
    ranged = f"SELECT c.doc_id, c.filename, length(c.content) AS size, coalesce({d.div('c.doc_id - e.lo', width)}, -1) AS part FROM @docs@ c CROSS JOIN (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM @docs@) e"
    counts = "SELECT part, sum(n) OVER (ORDER BY part DESC) - n AS before, sum(n) OVER () AS total FROM (SELECT part, count(*) AS n FROM r_ GROUP BY part) n_"
    return (
        f"WITH r_ AS ({ranged}), c_ AS ({counts}) SELECT r.doc_id, r.filename, r.size, CAST(c.before + row_number() OVER (PARTITION BY r.part ORDER BY r.doc_id DESC) AS BIGINT) AS place, CAST(c.total AS BIGINT) AS total "
        "FROM r_ r JOIN c_ c ON r.part = c.part"
    )


@query
def dedup_sha256(d: Dialect) -> str:
    digest = "sha2(content, 256)" if d.name == "spark" else "sha256(content)"
    each = f"SELECT doc_id, {digest} AS digest FROM @docs@"
    return f"SELECT e.doc_id, e.digest, f.first_id, f.first_id <> e.doc_id AS duplicate FROM ({each}) e JOIN (SELECT digest, min(doc_id) AS first_id FROM ({each}) d_ GROUP BY digest) f ON e.digest = f.digest"


@query
def is_nepali(d: Dialect) -> str:
    return f"SELECT doc_id, {d.matches('content', '[\\x{0900}-\\x{097F}]')} AS nepali FROM @docs@"


@query
def corpus_stats(d: Dialect) -> str:
    nepali = d.matches("content", "[\\x{0900}-\\x{097F}]")
    return (
        f"SELECT (SELECT count(*) FROM @docs@) AS documents, (SELECT count(*) FROM @docs@ WHERE {nepali}) AS nepali, count(*) AS chunks, "
        "sum(CASE WHEN type = 'image' THEN 1 ELSE 0 END) AS images, sum(CASE WHEN type = 'table' THEN 1 ELSE 0 END) AS tables, sum(CASE WHEN type = 'equation' THEN 1 ELSE 0 END) AS equations FROM @items@"
    )


@query
def content_tokens(d: Dialect) -> str:
    return f"SELECT qid, token FROM ({d.explode('@questions@', 'qid', 'terms', 'at', 'token')}) t_"


@query
def stems(d: Dialect) -> str:
    return f"SELECT token, {d.stem('token')} AS stem FROM (SELECT DISTINCT token FROM @item_tokens@) t_"


@query
def conversation_terms(d: Dialect) -> str:
    terms = d.content_tokens("text")
    summary = d.any(d.tokens("text"), "t", f"t IN ({quoted(W.SUMMARY)})")
    return f"SELECT conv_id, turn, {d.size(terms)} AS n_terms, {summary} AS wants_summary FROM @conversations@ WHERE role = 'user'"


@query
def distinctive_words(d: Dialect) -> str:
    return "SELECT doc_id, idx, token, CAST(r AS INT) AS place FROM @distinctive@"


@query
def ambiguity_options(d: Dialect) -> str:
    return "SELECT qid, CAST(place_no AS INT) AS place_no, doc_id, idx FROM @ambiguous@"


@query
def topic_options(d: Dialect) -> str:
    """Four topics of the corpus."""
    return "SELECT doc_id, idx, query FROM @topics@ WHERE scope = '*'"


@query
def first_profile_order(d: Dialect) -> str:
    """The earlier profile: hybrid score with an added boost for the kind of item asked for."""
    score = "hybrid + CASE WHEN asked_kind THEN CAST(0.06 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END"
    return f"SELECT qid, doc_id, idx, CAST(row_number() OVER (PARTITION BY qid ORDER BY round({score}, 9) DESC, doc_id, idx) AS INT) AS place FROM @hits@"


@query
def summary_picks(d: Dialect) -> str:
    """The lines of each document's summary."""
    from docquarry.plans import answers

    return answers.summary_lines(d, "SELECT DISTINCT doc_id FROM @items@")


@query
def upload_validation(d: Dialect) -> str:
    """What is wrong with each row of an upload: kind of file, size."""
    ext = "lower(split_part(url, '.', -1))"
    return f"SELECT page_id, CASE WHEN {ext} NOT IN ({quoted(list(UPLOADS))}) THEN 'unsupported' WHEN length(html) > {UPLOAD_BYTES} THEN 'too large' ELSE 'ok' END AS verdict FROM @pages@"
