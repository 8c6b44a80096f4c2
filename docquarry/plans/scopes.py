"""Questions asked of a part of the documents: every question of the batch over scopes by language, source and document.

SCOPED replaces the relations that say what is asked of what. Everything behind them takes the scope along: the vector and
the word scan mask items by the bits of their documents, z and candidates are those of the scope, graph scores, formulas
and choices are cut to it. Weights of the entity graph stay those of the whole corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from docquarry.functions.dialect import Dialect
from docquarry.plans import answers, catalog

# Asked of every scope besides the batch's questions, so that each way to answer is taken.
ALSO = [(-1, "Summarize"), (-2, "tell me about this"), (-3, "सारांश")]


def scope_docs(d: Dialect) -> str:
    """A scope for each language and each source, and one for the newest document of each source. A null names no scope."""
    return (
        "SELECT DISTINCT scope, doc_id FROM (SELECT 'lang:' || lang AS scope, doc_id FROM @documents@ UNION ALL SELECT 'source:' || source, doc_id FROM @documents@ "
        "UNION ALL SELECT 'newest:' || source, max(doc_id) FROM @documents@ GROUP BY source) s_ WHERE scope IS NOT NULL AND doc_id IS NOT NULL"
    )


def asked(d: Dialect) -> str:
    """qid is the question's id times 1,000 and the scope's place. An empty scope (null) is everything, 'none' holds nothing.
    Of one document alone only the questions of ALSO are asked. The cross join is of questions and scopes, not documents."""
    first = "SELECT item_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(text, '')) AS nth FROM @benchmark@ WHERE item_id IS NOT NULL"
    also = " UNION ALL ".join(f"SELECT {n}, {d.text(text)}" for n, text in ALSO)
    names = "SELECT scope, row_number() OVER (ORDER BY scope) + 1 AS place FROM (SELECT DISTINCT scope FROM @scope_docs@) n_ UNION ALL SELECT NULL, 0 UNION ALL SELECT 'none', 1"
    return f"SELECT CAST(q.item_id * 1000 + s.place AS BIGINT) AS qid, q.text AS question, s.scope, '' AS aux FROM (SELECT item_id, text FROM ({first}) f_ WHERE nth = 1 UNION ALL {also}) q CROSS JOIN ({names}) s WHERE q.item_id < 0 OR s.scope IS NULL OR s.scope NOT LIKE 'newest:%'"


SCOPED: dict[str, Callable[[Dialect], str]] = {"scope_docs": scope_docs, "asked": asked}

QUERIES: dict[str, Callable[[Dialect], str]] = {
    "scoped_questions": lambda d: "SELECT q.qid, q.scope, count(m.doc_id) AS n_docs FROM @asked@ q LEFT JOIN @scope_docs@ m ON q.scope = m.scope GROUP BY q.qid, q.scope",
}
for _name in "z_score knn_top50 candidates keyword_coverage retrieve_naive retrieve_hybrid evidence_gate decision_route topic_options".split():
    QUERIES[f"scoped_{_name}"] = catalog.QUERIES[_name]
for _name in "answered option_lists".split():
    QUERIES[f"scoped_{_name}"] = answers.QUERIES[_name]
QUERIES["scoped_topic_options"] = lambda d: "SELECT scope, place, doc_id, idx, query FROM @topics@"
