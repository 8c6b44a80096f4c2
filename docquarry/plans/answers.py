"""Whole answers: what each question of a batch is told, by its route, with choices where the question is too wide."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import words as W
from docquarry.functions.dialect import SPARK, Dialect, quoted
from docquarry.operators import overlap_scan
from docquarry.plans.fixtures import modal_text
from docquarry.plans.relations import MADE, Corpus, relation

QUERIES: dict[str, Callable[[Dialect], str]] = {}


def query(build: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    QUERIES[build.__name__] = build
    return build


def short(d: Dialect, text: str, n: int) -> str:
    """text on one line, cut to n characters."""
    plain = d.strip(d.replace(text, r"\s+", "' '"))
    return f"CASE WHEN length({plain}) <= {n} THEN {plain} ELSE {d.replace(f'left({plain}, {n - 1})', r'\s+$', chr(39) * 2)} || '…' END"


def message(d: Dialect) -> str:
    """The text of a route without an answer, in the language of the question."""
    said = [f"WHEN route = '{route}' AND lang = '{lang}' THEN {d.text(text)}" for route, by_lang in W.MESSAGES.items() for lang, text in by_lang.items()]
    return f"CASE {' '.join(said)} END"


def spaced(d: Dialect, most: int) -> str:
    """Whether place p of n is one of at most `most` places at even spacing, the first and the last among them."""
    n = f"least({most}, CAST(n AS INT))"
    at = f"CAST(floor(CASE WHEN {n} <= 1 THEN 0 ELSE CAST(k AS DOUBLE) * (n - 1) / ({n} - 1) END) AS INT)"
    return d.holds(d.each(d.steps("0", n + " - 1", "1"), "k", at), "CAST(p AS INT)")


@relation
def pool(d: Dialect) -> str:
    """(doc_id, idx, p, n): the text items of a document in order, or all its items if none is a text."""
    marked = "SELECT doc_id, idx, type, max(CASE WHEN type = 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS texts FROM @items@"
    return f"SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM ({marked}) m_ WHERE type = 'text' OR texts = 0"


def summary_lines(d: Dialect, wanted: str) -> str:
    """(doc_id, idx, line): the opening sentences of up to six items at even spacing, cut to 220 characters."""
    firsts = d.at(d.keep(d.sentences("i.chunk"), "s", "length(s) >= 20"), "0")
    picks = f"SELECT o.doc_id, o.idx FROM (SELECT doc_id, idx FROM @pool@ WHERE {spaced(d, W.SUMMARY_LINES)}) o JOIN ({wanted}) w ON o.doc_id = w.doc_id"
    return f"SELECT doc_id, idx, {short(d, 'line', 220)} AS line FROM (SELECT i.doc_id, i.idx, {firsts} AS line FROM ({picks}) p JOIN @items@ i ON p.doc_id = i.doc_id AND p.idx = i.idx) l_ WHERE line IS NOT NULL"


@relation
def shown(d: Dialect) -> str:
    """(qid, doc_id, idx, type, filename, told): the item that answers a question, by formula or by place 1 of the hits."""
    pages = "SELECT doc_id, max(page) + 1 AS pages FROM @items@ GROUP BY doc_id"
    first = "SELECT qid, doc_id, idx FROM @formula_hits@ UNION ALL SELECT h.qid, h.doc_id, h.idx FROM @hybrid_hits@ h LEFT JOIN @formula_hits@ f ON h.qid = f.qid WHERE h.pos = 1 AND f.qid IS NULL"
    return (
        f"SELECT qid, doc_id, idx, type, filename, CASE WHEN type = 'text' THEN chunk ELSE {modal_text(d)} END AS told FROM "
        f"(SELECT f.qid, i.*, p.pages FROM ({first}) f JOIN @items@ i ON f.doc_id = i.doc_id AND f.idx = i.idx JOIN ({pages}) p ON i.doc_id = p.doc_id) s_"
    )


@relation
def answers(d: Dialect) -> str:
    """One row a question: route, status, what is said, confidence, sources (names, in the order of the evidence)."""
    nl = f"{d.newline()} || {d.newline()}"
    said = f"SELECT qid, {d.gathered('sentence', 'place', nl)} AS said FROM @best_sentences@ GROUP BY qid"
    kinds = f"SELECT qid, {d.gathered('type', 'type', chr(39) + ', ' + chr(39))} AS kinds FROM (SELECT DISTINCT qid, type FROM @evidence@ WHERE type <> 'text') k_ GROUP BY qid"
    names = f"SELECT qid, {d.gathered('filename', 'first', chr(39) + '; ' + chr(39))} AS sources, count(*) AS n FROM (SELECT qid, filename, min(place) AS first FROM @evidence@ GROUP BY qid, filename) n_ GROUP BY qid"
    related = f"CASE WHEN k.kinds IS NULL THEN '' ELSE {nl} || '_Related ' || k.kinds || ' from the document is shown in the sources below._' END"
    alone = "SELECT scope, min(doc_id) AS doc_id FROM @scope_all@ GROUP BY scope HAVING count(*) = 1"
    asking = f"SELECT r.qid, o.doc_id FROM @decisions@ r JOIN @asked@ q ON r.qid = q.qid JOIN ({alone}) o ON o.scope = coalesce(q.scope, '*') WHERE r.route = 'summary'"
    titles = " ".join(f"WHEN r.lang = '{lang}' THEN {d.text(title)}" for lang, title in W.SUMMARY_TITLE.items())
    single = f"SELECT a.qid, b.body, c.filename FROM ({asking}) a JOIN ({summary_bodies(d, f'SELECT DISTINCT doc_id FROM ({asking}) w_')}) b ON a.doc_id = b.doc_id JOIN @docs@ c ON a.doc_id = c.doc_id"
    summed = f"'**' || CASE {titles} END || ' ' || u.filename || '**' || {nl} || u.body"
    told = f"CASE WHEN u.qid IS NOT NULL THEN {summed} WHEN r.route = 'formula' THEN s.told WHEN r.route <> 'answer' THEN r.message WHEN s.type <> 'text' THEN s.told ELSE coalesce(a.said, s.told) || {related} END"
    return (
        f"SELECT r.qid, r.route, CASE WHEN r.route IN ('formula', 'answer') OR u.qid IS NOT NULL THEN 'answer' WHEN r.route = 'not_found' THEN 'not_found' WHEN r.route = 'no_documents' THEN 'error' ELSE 'clarify' END AS status, {told} AS answer, "
        "CASE WHEN r.route = 'formula' OR u.qid IS NOT NULL THEN CAST(1.0 AS DOUBLE) WHEN r.route = 'answer' THEN r.confidence ELSE CAST(0.0 AS DOUBLE) END AS confidence, "
        "CASE WHEN r.route = 'formula' THEN s.filename WHEN r.route = 'answer' THEN n.sources WHEN u.qid IS NOT NULL THEN u.filename ELSE '' END AS sources, CASE WHEN r.route = 'formula' OR u.qid IS NOT NULL THEN 1 WHEN r.route = 'answer' THEN n.n ELSE 0 END AS source_count "
        f"FROM (SELECT *, {message(d)} AS message FROM @decisions@) r LEFT JOIN @shown@ s ON r.qid = s.qid LEFT JOIN ({said}) a ON r.qid = a.qid LEFT JOIN ({kinds}) k ON r.qid = k.qid LEFT JOIN ({names}) n ON r.qid = n.qid LEFT JOIN ({single}) u ON r.qid = u.qid"
    )


@query
def answered(d: Dialect) -> str:
    return "SELECT qid, route, status, answer, round(confidence, 2) AS confidence, sources, CAST(source_count AS INT) AS source_count FROM @answers@"


# --- choices, by the question and its scope ---


def telling(d: Dialect) -> str:
    """Which of t.token can tell a place from others."""
    return f"length(t.token) >= 4 AND t.token NOT IN ({quoted([*W.GENERIC, *W.SUMMARY])}) AND NOT {d.matches('t.token', '^[0-9]+$')}"


@relation
def scope_all(d: Dialect) -> str:
    """(scope, doc_id) with '*' for everything, which a question without a scope is asked of."""
    return "SELECT scope, doc_id FROM @scope_docs@ UNION ALL SELECT '*', doc_id FROM @docs@"


@relation
def scope_sizes(d: Dialect) -> str:
    return "SELECT scope, count(*) AS n_docs FROM @scope_all@ GROUP BY scope"


@relation
def scope_words(d: Dialect) -> str:
    """How many items of a scope hold a word."""
    return "SELECT m.scope, t.token, count(*) AS df FROM @item_tokens@ t JOIN @scope_all@ m ON t.doc_id = m.doc_id GROUP BY m.scope, t.token"


@relation
def topic_picks(d: Dialect) -> str:
    """(doc_id, idx, depth): up to four items of each document at even spacing."""
    return f"SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS depth FROM @pool@ WHERE {spaced(d, W.OPTIONS)}"


def topic_queries(d: Dialect, picked: str, words: str) -> str:
    """(scope, doc_id, idx, depth, query): the rarest telling words of each pick of a scope; picked is joined rows with t.token."""
    ranked = (
        "SELECT m.scope, k.doc_id, k.idx, k.depth, t.token, row_number() OVER (PARTITION BY m.scope, k.doc_id, k.idx ORDER BY f.df, length(t.token) DESC, t.token) AS r "
        f"FROM {picked} JOIN {words} f ON f.scope = m.scope AND f.token = t.token WHERE {telling(d)}"
    )
    return f"SELECT scope, doc_id, idx, depth, {d.gathered('token', 'r', chr(39) + ' ' + chr(39))} AS query FROM ({ranked}) r_ WHERE r <= 3 GROUP BY scope, doc_id, idx, depth"


def first_topics(said: str) -> str:
    """The first OPTIONS topics of each scope, no query twice."""
    first = f"SELECT *, row_number() OVER (PARTITION BY scope, query ORDER BY depth, doc_id) AS nth FROM ({said}) s_"
    return f"SELECT scope, CAST(place AS INT) - 1 AS place, doc_id, idx, query FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY depth, doc_id) AS place FROM ({first}) f_ WHERE nth = 1) p_ WHERE place <= {W.OPTIONS}"


@relation
def topics(d: Dialect) -> str:
    """(scope, place, doc_id, idx, query): up to four topics of a scope: even spacing within documents, one depth of all
    documents after the other, no query twice. In Spark: topics_in_rounds."""
    picks = f"SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS depth FROM @pool@ WHERE {spaced(d, W.OPTIONS)}"
    return first_topics(topic_queries(d, f"({picks}) k JOIN @scope_all@ m ON k.doc_id = m.doc_id JOIN @item_tokens@ t ON t.doc_id = k.doc_id AND t.idx = k.idx", "@scope_words@"))


#: Picks of a scope that the first round looks at, by how much a further round looks at more, and scopes to a pass over the words.
PICKS, MORE, SCOPES = 32, 8, 32


def topics_in_rounds(corpus: Corpus) -> DataFrame:
    """The relation topics. Topics come in the order of the picks, so those of a scope's first picks are its topics once there are
    OPTIONS of them. Scopes with fewer get a further round with MORE times as many picks, until none are left. Words are counted
    over all items of a scope, but only those that the picks hold."""
    scopes = sorted(r.scope for r in corpus.frame("scope_all").select("scope").distinct().collect())
    found = [corpus.statement("SELECT CAST(NULL AS STRING) AS scope, 0 AS place, doc_id, idx, '' AS query FROM @topic_picks@ WHERE FALSE")]
    pending, most = [scopes[at : at + SCOPES] for at in range(0, len(scopes), SCOPES)], [PICKS] * -(-len(scopes) // SCOPES)
    while pending:
        some, n = pending.pop(), most.pop()
        wanted = corpus.spark.createDataFrame([(s,) for s in some], "scope string")
        ordered = corpus.statement("SELECT m.scope, k.doc_id, k.idx, k.depth, row_number() OVER (PARTITION BY m.scope ORDER BY k.depth, k.doc_id) AS nth FROM @topic_picks@ k JOIN (SELECT a.* FROM @scope_all@ a JOIN {wanted} w ON a.scope = w.scope) m ON k.doc_id = m.doc_id", wanted=wanted)
        picked = corpus.kept_apart(ordered.where(f"nth <= {n}"))
        held = corpus.kept_apart(corpus.statement("SELECT p.scope, p.doc_id, p.idx, p.depth, t.token FROM {picked} p JOIN @item_words@ i ON i.doc_id = p.doc_id AND i.idx = p.idx LATERAL VIEW explode(i.words) t AS token", picked=picked))
        names = sorted(r.token for r in held.selectExpr("token").distinct().collect())
        words = overlap_scan.held_in(corpus.frame("item_words"), names, some, corpus.frame("scope_docs"))
        said = corpus.kept_apart(corpus.statement(topic_queries(SPARK, "{held} k", "{words}").replace("m.scope", "k.scope").replace("t.token", "k.token"), held=held, words=words))
        told = {r.scope: r.n for r in said.groupBy("scope").agg(F.countDistinct("query").alias("n")).collect()}
        seen = {r.scope: r["count"] for r in picked.groupBy("scope").count().collect()}
        again = [s for s in some if seen.get(s, 0) == n and told.get(s, 0) < W.OPTIONS]
        found.append(corpus.statement(first_topics("SELECT * FROM {said}"), said=said.where(~F.col("scope").isin(again))))
        if again:
            pending.append(again)
            most.append(n * MORE)
    return reduce(DataFrame.unionAll, found)


MADE["topics"] = topics_in_rounds


@relation
def options(d: Dialect) -> str:
    """(qid, place, label, query, doc_id): what to choose from where a question isn't answered.

    Generic: the summaries of a scope of few documents, then its topics. Not found: its topics. A summary of several
    documents: which one. Ambiguous: the places it may mean, with the words that tell each from the documents among the hits.
    """
    first = f"coalesce({d.at(d.sentences('i.chunk'), '0')}, i.chunk)"
    named = f"CASE WHEN z.n_docs > 1 THEN i.filename || ': ' ELSE '' END || {first}"
    routed = "SELECT r.qid, r.route, coalesce(q.scope, '*') AS scope FROM @decisions@ r JOIN @asked@ q ON r.qid = q.qid"
    listed = f"SELECT * FROM (SELECT m.scope, m.doc_id, c.filename, row_number() OVER (PARTITION BY m.scope ORDER BY m.doc_id) - 1 AS place FROM @scope_all@ m JOIN @docs@ c ON m.doc_id = c.doc_id) l_ WHERE place < {W.LISTED_DOCUMENTS}"
    summaries = f"SELECT r.qid, CAST(l.place AS INT) AS place, 'Summary of ' || l.filename AS label, 'summarize' AS query, l.doc_id FROM ({routed}) r JOIN @scope_sizes@ z ON r.scope = z.scope JOIN ({listed}) l ON r.scope = l.scope WHERE r.route = 'generic' AND z.n_docs <= {W.FEW_DOCUMENTS}"
    which = f"SELECT r.qid, CAST(l.place AS INT), l.filename, 'summarize', l.doc_id FROM ({routed}) r JOIN @scope_sizes@ z ON r.scope = z.scope JOIN ({listed}) l ON r.scope = l.scope WHERE r.route = 'summary' AND z.n_docs > 1"
    shift = f"CASE WHEN r.route = 'generic' AND z.n_docs <= {W.FEW_DOCUMENTS} THEN CAST(z.n_docs AS INT) ELSE 0 END"
    topical = (
        f"SELECT r.qid, t.place + {shift}, {short(d, named, 90)}, t.query, t.doc_id FROM ({routed}) r JOIN @scope_sizes@ z ON r.scope = z.scope JOIN @topics@ t ON r.scope = t.scope "
        f"JOIN @items@ i ON t.doc_id = i.doc_id AND t.idx = i.idx WHERE r.route IN ('generic', 'not_found') AND t.place + {shift} < {W.OPTIONS + 3}"
    )
    near = "SELECT DISTINCT h.qid, h.doc_id FROM @hits@ h JOIN (SELECT DISTINCT qid FROM @ambiguous@) a ON h.qid = a.qid"
    counts = f"SELECT n.qid, t.token, count(*) AS df FROM ({near}) n JOIN @item_tokens@ t ON n.doc_id = t.doc_id GROUP BY n.qid, t.token"
    placed = "@item_tokens@ t ON a.doc_id = t.doc_id AND a.idx = t.idx"
    if d.name == "spark":  # items are met before their words become rows, and a word's row moves only with a question
        counts = f"SELECT n.qid, t.token, count(*) AS df FROM ({near}) n JOIN @item_words@ i ON n.doc_id = i.doc_id LATERAL VIEW explode(i.words) t AS token GROUP BY n.qid, t.token"
        placed = "(SELECT doc_id, idx, explode(words) AS token FROM (SELECT i.doc_id, i.idx, i.words FROM @item_words@ i JOIN (SELECT DISTINCT doc_id, idx FROM @ambiguous@) p ON i.doc_id = p.doc_id AND i.idx = p.idx) p_) t ON a.doc_id = t.doc_id AND a.idx = t.idx"
    own = (
        f"SELECT a.qid, a.doc_id, a.idx, t.token, row_number() OVER (PARTITION BY a.qid, a.doc_id, a.idx ORDER BY f.df, length(t.token) DESC, t.token) AS r FROM @ambiguous@ a JOIN @questions@ q ON a.qid = q.qid "
        f"JOIN {placed} JOIN ({counts}) f ON f.qid = a.qid AND f.token = t.token WHERE {telling(d)} AND NOT {d.holds('q.terms', 't.token')}"
    )
    extra = f"SELECT qid, doc_id, idx, {d.gathered('token', 'r', chr(39) + ' ' + chr(39))} AS extra FROM ({own}) o_ WHERE r <= 3 GROUP BY qid, doc_id, idx"
    several = "SELECT qid, count(DISTINCT doc_id) AS n_docs FROM @ambiguous@ GROUP BY qid"
    places = (
        f"SELECT a.qid, CAST(a.place_no AS INT), {short(d, named, 90)}, {d.replace(d.strip('q.question'), '[?]+$', chr(39) * 2)} || CASE WHEN x.extra IS NULL THEN '' ELSE ' ' || x.extra END, a.doc_id "
        f"FROM @ambiguous@ a JOIN @decisions@ r ON a.qid = r.qid JOIN @items@ i ON a.doc_id = i.doc_id AND a.idx = i.idx JOIN @questions@ q ON a.qid = q.qid JOIN ({several}) z ON a.qid = z.qid "
        f"LEFT JOIN ({extra}) x ON a.qid = x.qid AND a.doc_id = x.doc_id AND a.idx = x.idx WHERE r.route = 'ambiguous'"
    )
    return f"{summaries} UNION ALL {which} UNION ALL {topical} UNION ALL {places}"


@query
def option_lists(d: Dialect) -> str:
    return "SELECT qid, place, label, query, doc_id FROM @options@"


@query
def diagnostics(d: Dialect) -> str:
    """What the decision on a question rests on."""
    return (
        f"SELECT q.qid, 'hybrid' AS mode, {d.join(d.sort('q.terms'), chr(39) + ' ' + chr(39))} AS topic_words, s.n_items AS items_searched, round(s.z, 2) AS z_score, round(v.dense, 3) AS best_dense, "
        "round(v.coverage, 2) AS best_coverage, g.supported FROM @questions@ q LEFT JOIN @spread@ s ON q.qid = s.qid LEFT JOIN (SELECT * FROM @vector_order@ WHERE rrf_rank = 1) v ON q.qid = v.qid JOIN @gate@ g ON q.qid = g.qid"
    )


def summary_bodies(d: Dialect, wanted: str) -> str:
    """(doc_id, body): the opening sentences of the text items at even spacing of the documents in wanted(doc_id)."""
    lines = f"SELECT p.doc_id, {d.gathered('p.line', 'p.idx', d.newline())} AS body FROM (SELECT doc_id, idx, '• ' || line AS line FROM ({summary_lines(d, wanted)}) s_) p GROUP BY p.doc_id"
    opening = f"SELECT i.doc_id, {short(d, 'i.chunk', 400)} AS body FROM @items@ i JOIN ({wanted}) n ON i.doc_id = n.doc_id WHERE i.idx = 0"
    return f"SELECT o.doc_id, coalesce(l.body, o.body) AS body FROM ({opening}) o LEFT JOIN ({lines}) l ON o.doc_id = l.doc_id"


@query
def document_summaries(d: Dialect) -> str:
    """The summary of each document."""
    wanted = "SELECT DISTINCT doc_id, filename FROM @items@"
    return f"SELECT i.doc_id, '**{W.SUMMARY_TITLE['en']} ' || i.filename || '**' || {d.newline()} || {d.newline()} || b.body AS summary FROM ({wanted}) i JOIN ({summary_bodies(d, wanted)}) b ON i.doc_id = b.doc_id"
