"""The relations of the engine, each one SQL statement over others, for Spark and for DuckDB.

A relation is a function of a dialect that returns the statement; @name@ in it stands for another relation or one of
the driver's tables. In Spark each becomes a DataFrame (a temporary view over Catalyst's plan); for DuckDB the ones
that a query needs become a chain of common table expressions.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docquarry.functions import words as W
from docquarry.functions.dialect import CAPITALS, DUCK, SPARK, Dialect, quoted
from docquarry.operators import block_scan, dense_scan, entity_counts, latent, overlap_scan, text_scan
from docquarry.sources import store

DIM = 64
RELATIONS: dict[str, Callable[[Dialect], str]] = {}
#: Relations that a deployment stores (the index of the corpus): written once for a folder of tables and read from then on,
#: until release() is called. A query that needs one plans over its files and not over all that led to it.
STORED = {
    "repeated_ids", "items", "item_words", "item_tokens", "vecs", "questions", "question_vecs", "top_dense", "spread", "top_words", "near_words", "question_near", "asking_hits", "asking_graph", "hits", "vector_order",
    "item_entities", "left_entities", "changed_entities", "links", "struct_edges", "question_entities", "local_scores", "global_scores", "hybrid_hits", "hybrid_rows", "sentence_rows",
    "source_docs", "real_blocks", "block_captions", "placed_blocks", "order_tables", "scope_docs", "asked", "decisions", "scope_words", "topics",
}
#: Relations that Spark makes by passes of operators, and of what.
PASSES: dict[str, tuple[Callable[..., DataFrame], str]] = {
    "doc_chunks": (lambda docs: text_scan.chunks(docs, ["doc_id", "filename"], "content", "idx"), "docs"),
    "block_items": (block_scan.items, "laid_blocks"),
    "item_words": (text_scan.with_words, "items"), "vecs": (text_scan.vectors, "item_words"),
    "item_entities": (entity_counts.listed, "items"), "left_entities": (entity_counts.listed, "left_items"),
    "entity_df": (entity_counts.counted, "items"), "left_df": (entity_counts.counted, "left_items"),
}
#: Relations that Spark makes of a corpus in several steps.
MADE: dict[str, Callable[[Corpus], DataFrame]] = {}
REFERENCE = re.compile(r"@(\w+)@")


def relation(build: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    RELATIONS[build.__name__] = build
    return build


class Corpus:
    """The relations over one set of tables: the driver's, those of a deployment, or blocks of parsed files.

    sf_dir holds the tables as Parquet. changed maps names of relations or tables to statements that take their place
    (plans.mixed.OVER_BLOCKS: items made of @blocks@), given maps names to DataFrames that stand for them. fit makes a model of
    item_words (operators.latent.fit, or anything with its vectors()) whose vectors take the place of hashed counts.
    """

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, changed: dict[str, Callable[[Dialect], str]] | None = None, fit: Callable[[DataFrame], latent.Latent] | None = None, **given: DataFrame) -> None:
        self.spark, self.sf_dir, self.relations = spark, sf_dir, RELATIONS | (changed or {})
        self._given, self._made = given, dict(given)
        self._folder: str | None = None
        self._fit, self._model = fit, None
        spark.udf.register("docquarry_covered", text_scan.covered)

    def has(self, name: str) -> bool:
        return name in self._made

    def give(self, name: str, df: DataFrame) -> None:
        """Lets a DataFrame stand for a relation or table from now on."""
        self._given[name] = self._made[name] = df

    def _embedded(self, name: str) -> DataFrame:
        """Vectors of the corpus's own model for items, questions and sentences."""
        if self._model is None:
            self._model = self._fit(self.frame("item_words"))
        if name == "vecs":
            return self._model.vectors(self.frame("item_words"), ["doc_id", "idx"], "words")
        if name == "question_vecs":
            return self._model.vectors(self.frame("questions"), ["qid", "scope"], "all_words", "qv", "qnorm2")
        return self._model.vectors(self.frame("sentence_rows").withColumnRenamed("spot", "sat"), ["qid", "hit", "sat"], "words")

    def frame(self, name: str) -> DataFrame:
        """The relation as a DataFrame."""
        if name not in self._made:
            if name not in self.relations and name not in PASSES:
                return self._table(name)
            if self._fit is not None and name in ("vecs", "question_vecs", "sentence_vecs"):
                df = self._embedded(name)
            elif name in ("top_dense", "spread"):
                scanned = (self.frame("vecs"), self.frame("question_vecs"), W.CANDIDATES, self.frame("scope_docs"))
                df = dense_scan.top_dense(*scanned) if name == "top_dense" else dense_scan.spread(*scanned, self.frame("top_dense"))
            elif name in PASSES and self.relations.get(name) is RELATIONS.get(name):
                make, source = PASSES[name]
                df = make(self.frame(source))
            elif name in MADE and self.relations.get(name) is RELATIONS.get(name):
                df = MADE[name](self)
            elif name == "top_words":
                df = overlap_scan.top_overlap(self.frame("item_words"), self.frame("questions"), W.CANDIDATES // 2, self.frame("scope_docs"))
            else:
                df = self.statement(self.relations[name](SPARK))
            self._made[name] = self.kept_apart(df, name) if name in STORED else df
        return self._made[name]

    def kept_apart(self, df: DataFrame, name: str = "rows") -> DataFrame:
        """df, written to the folder of the stored relations and read back."""
        self._folder = self._folder or store.working_folder(self.spark)
        path = f"{self._folder}/{uuid.uuid4().hex}/{name}"
        df.write.parquet(path, compression="zstd")
        return self.spark.read.parquet(path)

    def _table(self, name: str) -> DataFrame:
        read = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        # a table in fewer splits than cores is dealt out before the work on its texts; larger ones stay as they are
        return read.repartition(cores) if name == "documents" and read.rdd.getNumPartitions() < cores else read

    def statement(self, sql: str, **frames: DataFrame) -> DataFrame:
        """A statement over relations, and over frames where it names them in braces."""
        mark = uuid.uuid4().hex[:12]
        names = sorted(set(REFERENCE.findall(sql)))
        for name in names:
            self.frame(name).createOrReplaceTempView(f"{name}_{mark}")
        for name, df in frames.items():
            df.createOrReplaceTempView(f"{name}_{mark}")
            sql = sql.replace(f"{{{name}}}", f"{name}_{mark}")
        out = self.spark.sql(REFERENCE.sub(lambda m: f"{m[1]}_{mark}", sql))
        for name in (*names, *frames):
            self.spark.catalog.dropTempView(f"{name}_{mark}")
        return out

    def release(self) -> None:
        """Forgets the relations that were made and deletes the folder of the stored ones."""
        self._made, self._model = dict(self._given), None
        if self._folder is not None:
            store.remove(self.spark, self._folder)
            self._folder = None


_KEPT: dict[tuple[str, str, str], tuple[str, Corpus]] = {}


def release() -> None:
    """Forgets the session's stored relations and deletes their folders."""
    for _, corpus in _KEPT.values():
        corpus.release()
    _KEPT.clear()


def kept(spark: SparkSession, sf_dir: str, label: str = "", changed: dict[str, Callable[[Dialect], str]] | None = None, fit: Callable[[DataFrame], latent.Latent] | None = None) -> Corpus:
    """The session's corpus over the tables in sf_dir; a label for each set of changed relations.

    It holds as long as the files of the folder stay as they are: their paths, sizes and times are looked up each time.
    """
    key, state = (spark.sparkContext.applicationId, sf_dir, label), store.state(spark, sf_dir)
    if key in _KEPT and _KEPT[key][0] != state:
        _KEPT.pop(key)[1].release()
    if key not in _KEPT:
        _KEPT[key] = (state, Corpus(spark, sf_dir, changed, fit))
    return _KEPT[key][1]


def duck_sql(sql: str, changed: dict[str, Callable[[Dialect], str]] | None = None) -> str:
    """A statement over relations as one statement for DuckDB."""
    relations = RELATIONS | (changed or {})
    order: list[str] = []

    def need(text: str) -> None:
        for name in REFERENCE.findall(text):
            if name in relations and name not in order:
                need(relations[name](DUCK))
                if name not in order:
                    order.append(name)

    need(sql)
    plain = lambda text: REFERENCE.sub(r"\1", text)
    parts = [f"{n} AS MATERIALIZED ({plain(relations[n](DUCK))})" for n in order]
    body = f"SELECT * FROM ({plain(sql)}) result_" if sql.lstrip().upper().startswith("WITH") else plain(sql)
    return (f"WITH {', '.join(parts)} " if parts else "") + body


# --- the corpus: documents, items, words, vectors ---


@relation
def repeated_ids(d: Dialect) -> str:
    return "SELECT doc_id FROM @documents@ WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING count(*) > 1"


@relation
def docs(d: Dialect) -> str:
    """One document an id: of rows that repeat one, the first by text and source. Rows without an id can't be named and are
    left out; a null text is empty. Only the rows of repeated ids are ranked, so the others aren't shuffled."""
    each = "SELECT d.doc_id, d.source AS filename, coalesce(d.text, '') AS content FROM @documents@ d"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY content, filename) AS nth FROM ({each} JOIN @repeated_ids@ r ON d.doc_id = r.doc_id) a_"
    return f"{each} LEFT JOIN @repeated_ids@ r ON d.doc_id = r.doc_id WHERE d.doc_id IS NOT NULL AND r.doc_id IS NULL UNION ALL SELECT doc_id, filename, content FROM ({ranked}) k_ WHERE nth = 1"


@relation
def sentences(d: Dialect) -> str:
    return d.explode("@docs@", "doc_id", d.sentences("content"), "pos", "sentence")


@relation
def items(d: Dialect) -> str:
    source = "@doc_chunks@" if d.name == "spark" else f"({d.explode('@docs@', 'doc_id, filename', d.chunks('content'), 'idx', 'chunk')}) x_"
    return f"SELECT doc_id, filename, CAST(idx AS INT) AS idx, 'text' AS type, 0 AS page, CAST(NULL AS {'STRING' if d.name == 'spark' else 'VARCHAR'}) AS section, chunk, '' AS caption, '' AS raw, '' AS description FROM {source}"


@relation
def item_words(d: Dialect) -> str:
    """Items with their distinct words. In Spark: docquarry.operators.text_scan."""
    return f"SELECT doc_id, filename, idx, type, page, section, chunk, {d.tokens('chunk')} AS words FROM @items@"


@relation
def item_tokens(d: Dialect) -> str:
    return d.explode("@item_words@", "doc_id, idx", "words", "spot", "token")


def vector(d: Dialect, key: str, relation_name: str, words: str = "words") -> str:
    """(key, v): how many of a row's words fall into each of DIM buckets by digest; rows without words have no vector."""
    buckets = d.array(d.each(words, "t", d.md5_bucket("t", DIM)))  # bound by a lambda, so that digests are taken once
    counted = d.each(buckets, "k", d.each(d.steps("0", str(DIM - 1), "1"), "b", f"CAST({d.size(d.keep('k', 'x', 'x = b'))} AS INT)"))
    return f"SELECT {key}, {d.at(counted, '0')} AS v FROM {relation_name} WHERE {d.size(words)} > 0"


def dot(d: Dialect, a: str, b: str) -> str:
    return d.total(d.each(d.steps("0", str(DIM - 1), "1"), "z", f"CAST({d.at(a, 'CAST(z AS INT)')} AS BIGINT) * {d.at(b, 'CAST(z AS INT)')}"))


@relation
def vecs(d: Dialect) -> str:
    """Hashed counts of an item's words. In Spark: docquarry.operators.text_scan."""
    return f"SELECT doc_id, idx, v, CAST({dot(d, 'v', 'v')} AS BIGINT) AS norm2 FROM ({vector(d, 'doc_id, idx', '@item_words@')}) n_"


# --- questions ---


@relation
def asked(d: Dialect) -> str:
    """(qid, question, scope, aux): one question an id, the first by its text; rows without an id are left out. A null scope is
    all documents; aux is the text of what is attached to the question, empty where nothing is."""
    first = "SELECT item_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(text, '')) AS nth FROM @benchmark@ WHERE item_id IS NOT NULL"
    return f"SELECT item_id AS qid, text AS question, CAST(NULL AS {'STRING' if d.name == 'spark' else 'VARCHAR'}) AS scope, '' AS aux FROM ({first}) f_ WHERE nth = 1"


@relation
def questions(d: Dialect) -> str:
    """Questions with their words. What is attached joins the question's vector, and stands in for its topic words where it has none."""
    kinds = [(k, w) for k, w in (("image", W.IMAGE_WORDS), ("table", W.TABLE_WORDS), ("equation", W.EQUATION_WORDS))]
    raw = d.raw_tokens("lower(question)")
    mods = ", ".join(f"{d.any('raw', 't', f't IN ({quoted(w)})')} AS asks_{k}" for k, w in kinds)
    read = f"SELECT qid, question, scope, aux, {d.tokens('question')} AS words, {d.tokens(f'question || {chr(39)} {chr(39)} || aux')} AS all_words, {d.content_tokens('question')} AS own, {d.content_tokens('aux')} AS attached, {raw} AS raw FROM @asked@"
    return f"SELECT qid, question, scope, aux, words, all_words, own, CASE WHEN {d.size('own')} > 0 THEN own ELSE attached END AS terms, raw, {mods} FROM ({read}) q_"


@relation
def question_vecs(d: Dialect) -> str:
    return f"SELECT qid, scope, v AS qv, CAST({dot(d, 'v', 'v')} AS BIGINT) AS qnorm2 FROM ({vector(d, 'qid, scope', '@questions@', 'all_words')}) n_"


def cosine(d: Dialect, q: str, i: str) -> str:
    return f"CAST({dot(d, f'{q}.qv', f'{i}.v')} AS DOUBLE) / (sqrt(CAST({q}.qnorm2 AS DOUBLE)) * sqrt(CAST({i}.norm2 AS DOUBLE)))"


def _scores(d: Dialect) -> str:
    pairs = "SELECT i.doc_id, i.idx, i.v, i.norm2, q.qid, q.qv, q.qnorm2 FROM @vecs@ i CROSS JOIN @question_vecs@ q WHERE q.scope IS NULL"
    scoped = "SELECT i.doc_id, i.idx, i.v, i.norm2, q.qid, q.qv, q.qnorm2 FROM @question_vecs@ q JOIN @scope_docs@ m ON m.scope = q.scope JOIN @vecs@ i ON i.doc_id = m.doc_id"
    return f"SELECT qid, doc_id, idx, {cosine(d, 'p_', 'p_')} AS dense FROM ({pairs} UNION ALL {scoped}) p_"


@relation
def top_dense(d: Dialect) -> str:
    """The nearest items of each question, of an exhaustive scan. In Spark: docquarry.operators.dense_scan."""
    return f"SELECT qid, doc_id, idx, dense, r FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, doc_id, idx) AS r FROM ({_scores(d)}) s_) a_ WHERE r <= {W.CANDIDATES}"


@relation
def spread(d: Dialect) -> str:
    """The z value of the best score among all scores of a question. In Spark: docquarry.operators.dense_scan."""
    return (
        "SELECT qid, count(*) AS n_items, max(dense) AS top, CASE WHEN count(*) >= 10 AND stddev_pop(dense) > 1e-6 "
        f"THEN (max(dense) - avg(dense)) / stddev_pop(dense) END AS z FROM ({_scores(d)}) s_ GROUP BY qid"
    )


# --- candidates and the vector order ---


@relation
def scope_docs(d: Dialect) -> str:
    """(scope, doc_id): the documents of each scope that questions name; none where all are asked of everything."""
    return f"SELECT CAST(NULL AS {'STRING' if d.name == 'spark' else 'VARCHAR'}) AS scope, CAST(NULL AS BIGINT) AS doc_id WHERE FALSE"


def in_scope(rows: str) -> str:
    """Of rows with qid and doc_id those whose document is in the question's scope."""
    return f"SELECT b_.* FROM ({rows}) b_ JOIN (SELECT qid, scope FROM @asked@) s_ ON b_.qid = s_.qid LEFT JOIN @scope_docs@ m_ ON m_.scope = s_.scope AND m_.doc_id = b_.doc_id WHERE s_.scope IS NULL OR m_.scope IS NOT NULL"


@relation
def shared_words(d: Dialect) -> str:
    """Every item that shares a word with a question: a row for each such pair. Retrieval reads top_words instead."""
    terms = d.explode("@questions@", "qid", "terms", "spot", "term")
    return in_scope(f"SELECT q.qid, t.doc_id, t.idx, count(*) AS overlap FROM ({terms}) q JOIN @item_tokens@ t ON q.term = t.token GROUP BY q.qid, t.doc_id, t.idx")


@relation
def top_words(d: Dialect) -> str:
    """The items that share most words with each question. In Spark: docquarry.operators.overlap_scan."""
    return f"SELECT qid, doc_id, idx, overlap, r FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, doc_id, idx) AS r FROM @shared_words@) b WHERE r <= {W.CANDIDATES // 2}"


@relation
def candidates(d: Dialect) -> str:
    return "SELECT qid, doc_id, idx FROM @top_dense@ UNION SELECT qid, doc_id, idx FROM @top_words@"


@relation
def vocabulary(d: Dialect) -> str:
    if d.name == "spark":  # of the lists, so that retrieval doesn't store a row for each token
        return f"SELECT DISTINCT token FROM ({d.explode('@item_words@', 'doc_id, idx', 'words', 'spot', 'token')}) t_"
    return "SELECT DISTINCT token FROM @item_tokens@"


@relation
def near_words(d: Dialect) -> str:
    """(term, token): every word of the items that a term of a question matches, nearly or exactly.

    Both sides are met by their beginnings (match_keys) in an equi join over distinct words, and verified.
    """
    terms = f"SELECT DISTINCT term FROM ({d.explode('@questions@', 'qid', 'terms', 'spot', 'term')}) t_"
    asked_keys = d.explode(f"({terms}) a_", "term", d.match_keys("term"), "spot", "begin")
    said_keys = d.explode("@vocabulary@", "token", d.match_keys("token"), "spot", "begin")
    return f"SELECT DISTINCT a.term, b.token FROM ({asked_keys}) a JOIN ({said_keys}) b ON a.begin = b.begin WHERE {d.token_match('a.term', 'b.token')}"


@relation
def question_near(d: Dialect) -> str:
    """(qid, near): for each term of a question that items hold, the words that match it."""
    lists = f"SELECT term, {d.collect('token', 'token')} AS tokens FROM @near_words@ GROUP BY term"
    terms = d.explode("@questions@", "qid", "terms", "spot", "term")
    return f"SELECT t.qid, {d.collect('l.tokens', 't.term')} AS near FROM ({terms}) t JOIN ({lists}) l ON t.term = l.term GROUP BY t.qid"


@relation
def fuzzy_overlap(d: Dialect) -> str:
    """Every item that holds a word near a term of a question, with how many of its terms: (qid, doc_id, idx, n_terms, matched)."""
    terms = d.explode("@questions@", "qid, terms", "terms", "spot", "term")
    if d.name == "spark":  # an item's terms are one row, so the pairs with questions are counted where it lies and aren't shuffled
        words = d.explode("@item_words@", "doc_id, idx", "words", "spot", "token")
        numbers = "SELECT term, CAST(row_number() OVER (ORDER BY term) AS INT) AS number FROM (SELECT DISTINCT term FROM @near_words@) d_"  # of the batch's terms
        held = f"SELECT i.doc_id, i.idx, collect_set(n.number) AS held FROM ({words}) i JOIN (SELECT w.token, k.number FROM @near_words@ w JOIN ({numbers}) k ON k.term = w.term) n ON n.token = i.token GROUP BY i.doc_id, i.idx"
        asks = f"SELECT DISTINCT t.qid, k.number, {d.size('t.terms')} AS n_terms FROM ({terms}) t JOIN ({numbers}) k ON k.term = t.term"
        return in_scope(f"SELECT q.qid, i.doc_id, i.idx, q.n_terms, count(*) AS matched FROM (SELECT doc_id, idx, explode(held) AS number FROM ({held}) h_) i JOIN ({asks}) q ON q.number = i.number GROUP BY q.qid, i.doc_id, i.idx, q.n_terms")
    near = f"SELECT t.qid, t.term, {d.size('t.terms')} AS n_terms, n.token FROM ({terms}) t JOIN @near_words@ n ON t.term = n.term"
    return in_scope(f"SELECT n.qid, i.doc_id, i.idx, n.n_terms, count(DISTINCT n.term) AS matched FROM ({near}) n JOIN @item_tokens@ i ON n.token = i.token GROUP BY n.qid, i.doc_id, i.idx, n.n_terms")


def cover(d: Dialect, words: str) -> tuple[str, str]:
    """The share of q.terms that words match, and the join it needs. Spark compares words and terms (operators.text_scan), so that no
    question carries the list of all words near its terms."""
    if d.name == "spark":
        return f"docquarry_covered(q.terms, {words})", ""
    return d.covered("r.near", d.size("q.terms"), words), f"LEFT JOIN @question_near@ r ON {'s' if words.startswith('s.') else 'c'}.qid = r.qid "


def asking(keys: str) -> str:
    """Spark: pairs (qid, doc_id, idx, dense, null where it isn't known) with what their questions ask. It comes to the pairs first, so that no
    pair moves with its item's words or text; stored, so that few pairs are sent to the items and many meet them in a shuffle."""
    return f"SELECT c.qid, c.doc_id, c.idx, c.dense, q.terms, q.asks_image, q.asks_table, q.asks_equation, CASE WHEN c.dense IS NULL THEN w.qv END AS qv, w.qnorm2 FROM ({keys}) c JOIN @questions@ q ON c.qid = q.qid LEFT JOIN @question_vecs@ w ON c.qid = w.qid"


@relation
def asking_hits(d: Dialect) -> str:
    return asking("SELECT qid, doc_id, idx, max(dense) AS dense FROM (SELECT qid, doc_id, idx, dense FROM @top_dense@ UNION ALL SELECT qid, doc_id, idx, NULL FROM @top_words@) b_ GROUP BY qid, doc_id, idx")


@relation
def asking_graph(d: Dialect) -> str:
    """Of the hits of the hybrid mode those that only the graph brought."""
    return asking("SELECT qid, doc_id, idx, CAST(NULL AS DOUBLE) AS dense FROM @hybrid_hits@ WHERE vec_rank IS NULL")


def made_hits(d: Dialect, keys: str) -> str:
    share, near = cover(d, "i.words")
    kinds = " OR ".join(f"(q.asks_{k} AND i.type = '{k}')" for k in ("image", "table", "equation"))
    if d.name == "spark":
        near = f"SELECT v.doc_id, v.idx, v.v, v.norm2 FROM @vecs@ v LEFT SEMI JOIN (SELECT doc_id, idx FROM {keys} WHERE dense IS NULL) k ON v.doc_id = k.doc_id AND v.idx = k.idx"
        return (
            f"SELECT q.qid, q.doc_id, q.idx, i.type, i.page, i.section, coalesce(q.dense, {cosine(d, 'q', 'v')}, 0.0) AS dense, {share} AS coverage, ({kinds}) AS asked_kind "
            f"FROM {keys} q JOIN @item_words@ i ON q.doc_id = i.doc_id AND q.idx = i.idx LEFT JOIN ({near}) v ON q.doc_id = v.doc_id AND q.idx = v.idx"
        )
    return (
        f"SELECT c.qid, c.doc_id, c.idx, i.filename, i.type, i.page, i.section, i.chunk, coalesce({cosine(d, 'w', 'v')}, 0.0) AS dense, {share} AS coverage, ({kinds}) AS asked_kind "
        f"FROM {keys} c JOIN @item_words@ i ON c.doc_id = i.doc_id AND c.idx = i.idx JOIN @questions@ q ON c.qid = q.qid {near}"
        f"LEFT JOIN @question_vecs@ w ON c.qid = w.qid LEFT JOIN @vecs@ v ON c.doc_id = v.doc_id AND c.idx = v.idx"
    )


@relation
def hits(d: Dialect) -> str:
    # in Spark without the items' texts, which would travel through the rankings behind
    columns, keys = "*", "@candidates@"
    if d.name == "spark":
        columns, keys = "qid, doc_id, idx, type, page, section, dense, coverage, asked_kind", "@asking_hits@"
    return f"SELECT {columns}, {W.DENSE_WEIGHT} * dense + {W.WORD_WEIGHT} * coverage AS hybrid FROM ({made_hits(d, keys)}) h_".replace("0.8 *", "CAST(0.8 AS DOUBLE) *").replace("0.2 *", "CAST(0.2 AS DOUBLE) *")


@relation
def vector_order(d: Dialect) -> str:
    one = "CAST(1.0 AS DOUBLE)"
    ranked = (
        "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, doc_id, idx) AS r_dense, "
        "row_number() OVER (PARTITION BY qid ORDER BY coverage DESC, dense DESC, doc_id, idx) AS r_words FROM @hits@"
    )
    rrf = f"SELECT *, {one} / ({W.RRF} + r_dense) + CASE WHEN coverage > 0 THEN ({one} + coverage) / ({W.RRF} + r_words) ELSE 0 END AS rrf FROM ({ranked}) r_"
    boosted = f"SELECT *, rrf * CASE WHEN asked_kind THEN CAST(1.5 AS DOUBLE) ELSE {one} END AS boosted FROM ({rrf}) b_"
    return (
        "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, doc_id, idx) AS rrf_rank, "
        f"row_number() OVER (PARTITION BY qid ORDER BY boosted DESC, doc_id, idx) AS vec_rank FROM ({boosted}) v_"
    )


# --- the entity graph ---


def tally(d: Dialect, text: str) -> str:
    """Spark: the entities of a text and how often each counts, array<struct<entity, tf>>, made in the row: single words, neighbours, and
    capitalised phrases, which count twice. Equal ones are told by sorting, so nothing is shuffled."""
    phrases = d.each(d.keep(d.find_all(text, CAPITALS, 1), "p", "p LIKE '% %'"), "p", f"array_repeat({d.join(d.each(d.split('p', r'\s+'), 'w', d.stem('w')), chr(39) + ' ' + chr(39))}, 2)")
    pairs = "zip_with(slice(s, 1, greatest(size(s) - 1, 0)), slice(s, 2, greatest(size(s) - 1, 0)), (a, b) -> a || ' ' || b)"
    every = d.at(d.each(d.array(d.entity_words(text)), "s", f"sort_array(concat(s, {pairs}, flatten({phrases})))"), "0")
    heads = d.keep("sequence(0, size(t) - 1)", "i", "i = 0 OR get(t, i) <> get(t, i - 1)")
    runs = d.at(d.each(d.array(heads), "h", "transform(h, (a, k) -> named_struct('entity', get(t, a), 'tf', CAST(coalesce(get(h, k + 1), size(t)) - a AS BIGINT)))"), "0")
    return d.at(d.each(d.array(every), "t", f"CASE WHEN size(t) > 0 THEN {runs} END"), "0")


@relation
def entity_tf(d: Dialect) -> str:
    if d.name == "spark":
        return f"SELECT doc_id, idx, e.entity, e.tf FROM @items@ LATERAL VIEW explode({tally(d, 'chunk')}) AS e"
    singles = d.explode("@items@", "doc_id, idx", d.entity_words("chunk"), "spot", "entity")
    caps = d.explode("@items@", "doc_id, idx", d.find_all("chunk", CAPITALS, 1), "spot", "phrase")
    stemmed = d.join(d.each(d.split("phrase", r"\s+"), "w", d.stem("w")), "' '")
    return (
        f"WITH s_ AS ({singles}), p_ AS (SELECT doc_id, idx, entity, lead(entity) OVER (PARTITION BY doc_id, idx ORDER BY spot) AS after FROM s_), "
        f"c_ AS (SELECT doc_id, idx, {stemmed} AS entity FROM ({caps}) k_ WHERE phrase LIKE '% %') "
        "SELECT doc_id, idx, entity, CAST(sum(w) AS BIGINT) AS tf FROM (SELECT doc_id, idx, entity, 1 AS w FROM s_ "
        "UNION ALL SELECT doc_id, idx, entity || ' ' || after, 1 FROM p_ WHERE after IS NOT NULL "
        "UNION ALL SELECT doc_id, idx, entity, 2 FROM c_) u_ GROUP BY doc_id, idx, entity"
    )


@relation
def entity_df(d: Dialect) -> str:
    return "SELECT entity, count(*) AS df FROM @entity_tf@ GROUP BY entity"


def weighed(d: Dialect, tf: str, df: str, n: str) -> str:
    """The eight entities of each item that weigh most, of its counts tf, document frequencies df and the number of items n."""
    weight = "round(tf * ln(1 + CAST(n AS DOUBLE) / df) * CASE WHEN entity LIKE '% %' THEN CAST(1.3 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END, 9)"
    scored = f"SELECT t.doc_id, t.idx, t.entity, t.tf, f.df, c.n FROM {tf} t JOIN {df} f ON t.entity = f.entity CROSS JOIN ({n}) c"
    kept = f"SELECT doc_id, idx, entity, tf, {weight} AS weight FROM ({scored}) s_ WHERE n < {W.SMALL_CORPUS} OR df <= {W.TOO_COMMON} * n"
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, idx ORDER BY weight DESC, entity DESC) AS rank FROM ({kept}) k_) r_ WHERE rank <= {W.ENTITIES_PER_ITEM}"


@relation
def mentions(d: Dialect) -> str:
    """The entities of each item that weigh most. In Spark: of item_entities, lists made by docquarry.operators.entity_counts."""
    if d.name == "spark":
        return "SELECT doc_id, idx, e.entity, e.tf, e.df, e.weight, at + 1 AS rank FROM @item_entities@ LATERAL VIEW posexplode(said) AS at, e"
    return weighed(d, "@entity_tf@", "@entity_df@", "SELECT greatest(count(*), 1) AS n FROM @items@")


@relation
def links(d: Dialect) -> str:
    """Spark: co-occurrence, each pair once (a < b). A pair with an entity of one item is counted by that, the others by grouping."""
    pairs = "SELECT x.entity AS a, y.entity AS b, least(x.df, y.df) AS df FROM (SELECT x, said FROM @item_entities@ LATERAL VIEW explode(said) AS x) x_ LATERAL VIEW explode(filter(said, z -> z.entity > x.entity)) AS y"
    return f"WITH p_ AS ({pairs}) SELECT a, b, 1L AS weight FROM p_ WHERE df = 1 UNION ALL SELECT a, b, count(*) AS weight FROM p_ WHERE df > 1 GROUP BY a, b"


@relation
def cooccur(d: Dialect) -> str:
    if d.name == "spark":
        return "SELECT a, b, weight FROM (SELECT inline(array(named_struct('a', a, 'b', b, 'weight', weight), named_struct('a', b, 'b', a, 'weight', weight))) FROM @links@) l_"
    return "SELECT a.entity AS a, b.entity AS b, count(*) AS weight FROM @mentions@ a JOIN @mentions@ b ON a.doc_id = b.doc_id AND a.idx = b.idx AND a.entity <> b.entity GROUP BY a.entity, b.entity"


@relation
def struct_edges(d: Dialect) -> str:
    """Both directions; describes wins over next."""
    near = "SELECT doc_id, idx AS src, idx + {step} AS dst, type, page, {fn}(type) OVER w AS o_type, {fn}(page) OVER w AS o_page FROM @items@ WINDOW w AS (PARTITION BY doc_id ORDER BY idx)"
    both = f"{near.format(step=1, fn='lead')} UNION ALL {near.format(step=-1, fn='lag')}"
    return f"SELECT doc_id, src, dst, CASE WHEN page = o_page AND ((type <> 'text') <> (o_type <> 'text')) THEN 'describes' ELSE 'next' END AS kind FROM ({both}) e_ WHERE o_type IS NOT NULL"


@relation
def question_entities(d: Dialect) -> str:
    stems = d.each("own", "t", d.stem("t"))
    words_ = d.each("raw", "t", d.stem("t"))
    single = d.explode("@questions@", "qid", stems, "spot", "entity")
    raw = d.explode("@questions@", "qid", words_, "spot", "entity")
    pairs = f"SELECT qid, entity || ' ' || after AS entity FROM (SELECT qid, entity, lead(entity) OVER (PARTITION BY qid ORDER BY spot) AS after FROM ({raw}) w_) p_ WHERE after IS NOT NULL"
    if d.name == "spark":
        return f"SELECT DISTINCT e.qid, e.entity FROM (SELECT DISTINCT qid, entity FROM (SELECT qid, entity FROM ({single}) s_ UNION ALL {pairs}) u_) e JOIN @mentions@ m ON e.entity = m.entity"
    return f"SELECT DISTINCT e.qid, e.entity FROM (SELECT qid, entity FROM ({single}) s_ UNION ALL {pairs}) e JOIN (SELECT DISTINCT entity FROM @mentions@) m ON e.entity = m.entity"


@relation
def local_scores(d: Dialect) -> str:
    return in_scope("SELECT q.qid, m.doc_id, m.idx, round(sum(m.weight), 6) AS score FROM @question_entities@ q JOIN @mentions@ m ON q.entity = m.entity GROUP BY q.qid, m.doc_id, m.idx")


@relation
def global_scores(d: Dialect) -> str:
    around = "@cooccur@"
    if d.name == "spark":  # only entities that are asked for are paired, in their items
        asked_for = "SELECT l.a, l.said FROM (SELECT x.entity AS a, said FROM @item_entities@ LATERAL VIEW explode(said) AS x) l JOIN (SELECT DISTINCT entity FROM @question_entities@) e ON l.a = e.entity"
        around = f"(SELECT a, b, count(*) AS weight FROM (SELECT a, y.entity AS b FROM ({asked_for}) p_ LATERAL VIEW explode(said) AS y) y_ WHERE a <> b GROUP BY a, b) o_"
    top = f"SELECT a, b, weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS r FROM {around}) n_ WHERE r <= {W.NEIGHBOURS}"
    return in_scope(
        f"SELECT q.qid, m.doc_id, m.idx, round(sum(CAST(0.5 AS DOUBLE) * m.weight * ln(1 + CAST(n.weight AS DOUBLE))), 6) AS score FROM @question_entities@ q JOIN ({top}) n ON q.entity = n.a "
        "LEFT JOIN @question_entities@ k ON k.qid = q.qid AND k.entity = n.b JOIN @mentions@ m ON m.entity = n.b WHERE k.entity IS NULL GROUP BY q.qid, m.doc_id, m.idx"
    )


# --- fusion, by mode ---


def retrieved(d: Dialect, mode: str) -> str:
    """(qid, doc_id, idx, via, fused, vec_rank, pos) of at most 50 hits."""
    limit = W.CANDIDATES // 2
    graph = lambda rel: f"SELECT qid, doc_id, idx, CAST(1.0 AS DOUBLE) / ({W.RRF} + r) AS vote, NULL AS vec_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, idx) AS r FROM @{rel}@) g_ WHERE r <= {limit}"
    base = 0.5 if mode in ("local", "global") else 1.0
    votes = [f"SELECT qid, doc_id, idx, CAST({base} AS DOUBLE) / ({W.RRF} + vec_rank) AS vote, vec_rank FROM @vector_order@"]
    votes += [graph("local_scores")] * (mode in ("local", "hybrid")) + [graph("global_scores")] * (mode in ("global", "hybrid"))
    fused = f"SELECT qid, doc_id, idx, round(sum(vote), 9) AS fused, max(vec_rank) AS vec_rank FROM ({' UNION ALL '.join(votes)}) v_ GROUP BY qid, doc_id, idx"
    order = f"CASE WHEN vec_rank <= {W.ANCHORS} THEN vec_rank ELSE {W.ANCHORS + 1} END, CASE WHEN vec_rank <= {W.ANCHORS} THEN 0 ELSE -fused END, doc_id, idx"
    placed = f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS pos0 FROM ({fused}) f_"
    if mode == "naive":
        return f"SELECT qid, doc_id, idx, 'vector' AS via, fused, vec_rank, pos0 AS pos FROM ({placed}) p_ WHERE pos0 <= {W.CANDIDATES}"
    extra = (
        "SELECT p.qid, e.doc_id, e.dst AS idx, round(max(p.fused) * 0.5, 9) AS fused FROM pl_ p JOIN @struct_edges@ e ON e.doc_id = p.doc_id AND e.src = p.idx AND e.kind = 'describes' "
        "LEFT JOIN pl_ k ON k.qid = p.qid AND k.doc_id = e.doc_id AND k.idx = e.dst WHERE p.pos0 <= 3 AND k.qid IS NULL GROUP BY p.qid, e.doc_id, e.dst"
    )
    every = f"SELECT qid, doc_id, idx, CASE WHEN vec_rank IS NULL THEN 'graph' ELSE 'vector' END AS via, fused, vec_rank, pos0 FROM pl_ UNION ALL SELECT qid, doc_id, idx, 'structure', fused, NULL, NULL FROM ({extra}) x_"
    final = f"CASE WHEN pos0 <= {W.ANCHORS} THEN pos0 ELSE {W.ANCHORS + 1} END, CASE WHEN pos0 <= {W.ANCHORS} THEN 0 ELSE -fused END, doc_id, idx"
    return f"WITH pl_ AS ({placed}) SELECT * FROM (SELECT qid, doc_id, idx, via, fused, vec_rank, row_number() OVER (PARTITION BY qid ORDER BY {final}) AS pos FROM ({every}) a_) z_ WHERE pos <= {W.CANDIDATES}"


@relation
def hybrid_hits(d: Dialect) -> str:
    return retrieved(d, "hybrid")


@relation
def hybrid_rows(d: Dialect) -> str:
    """Hits of the hybrid mode with the item's fields; those that only the graph brought are scored here. In Spark without texts."""
    if d.name == "spark":
        columns = "h.qid, h.doc_id, h.idx, h.type, h.page, h.section, h.dense, h.coverage, h.asked_kind, k.via, k.fused, k.vec_rank, k.pos"
        joined = lambda rows, of: f"SELECT {columns} FROM {rows} h JOIN @hybrid_hits@ k ON h.qid = k.qid AND h.doc_id = k.doc_id AND h.idx = k.idx WHERE k.vec_rank IS {of}"
        made = made_hits(d, "@asking_graph@")
        return f"{joined('@hits@', 'NOT NULL')} UNION ALL {joined(f'({made})', 'NULL')}"
    made = made_hits(d, "@hybrid_hits@")
    return f"SELECT h.*, k.via, k.fused, k.vec_rank, k.pos FROM ({made}) h JOIN @hybrid_hits@ k ON h.qid = k.qid AND h.doc_id = k.doc_id AND h.idx = k.idx"


# --- the decision ---


@relation
def gate(d: Dialect) -> str:
    cover = "SELECT qid, max(CASE WHEN rrf_rank <= 3 THEN coverage END) AS cover FROM @vector_order@ GROUP BY qid"
    rule = (
        f"CASE WHEN c.cover IS NULL THEN FALSE WHEN s.z IS NULL THEN c.cover >= {W.COVER_GOOD} WHEN c.cover >= {W.COVER_GOOD} AND s.z >= {W.Z_LEAST} THEN TRUE "
        f"WHEN c.cover >= {W.COVER_SOME} AND s.z >= {W.Z_STRONG} THEN TRUE ELSE s.z >= {W.Z_ALONE} END"
    )
    trust = f"round(CASE WHEN s.z IS NULL THEN c.cover ELSE least(CAST(1.0 AS DOUBLE), greatest(CAST(0.0 AS DOUBLE), s.z / {W.Z_STRONG + 1})) END, 2)"
    return f"SELECT q.qid, c.cover, s.z, {rule} AS supported, {trust} AS confidence FROM @questions@ q LEFT JOIN ({cover}) c ON q.qid = c.qid LEFT JOIN @spread@ s ON q.qid = s.qid"


def with_texts(d: Dialect, rows: str, columns: str) -> str:
    """Spark: rows of hits with columns of their items, brought to those that were chosen."""
    return f"(SELECT t_.*, {columns} FROM ({rows}) t_ JOIN @items@ i ON t_.doc_id = i.doc_id AND t_.idx = i.idx)"


@relation
def evidence(d: Dialect) -> str:
    kept = (
        "SELECT * FROM @hybrid_rows@ WHERE pos <= 10 AND (pos = 1 OR (type = 'text' AND coverage > 0) "
        f"OR (type <> 'text' AND (coverage >= {W.COVER_GOOD} OR via = 'structure')))"
    )
    if d.name == "spark":  # of a text what is shown
        kept = f"SELECT * FROM {with_texts(d, kept, 'i.filename, left(i.chunk, 320) AS chunk')} x_"
    first = f"SELECT *, row_number() OVER (PARTITION BY qid, filename, left(chunk, 60) ORDER BY pos) AS nth FROM ({kept}) k_"
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS place FROM ({first}) f_ WHERE nth = 1) p_ WHERE place <= 5"


@relation
def sentence_rows(d: Dialect) -> str:
    said = "" if d.name == "spark" else ", chunk"
    top = f"SELECT qid, doc_id, idx{said}, row_number() OVER (PARTITION BY qid ORDER BY pos) AS hit FROM @hybrid_rows@ WHERE type = 'text'"
    chosen = f"(SELECT * FROM ({top}) t_ WHERE hit <= 3)"
    if d.name == "spark":
        chosen = with_texts(d, f"SELECT * FROM {chosen} h_", "i.chunk")
    picked = d.explode(f"{chosen} c_", "qid, doc_id, idx, hit", d.sentences("chunk"), "spot", "sentence")
    return f"SELECT p.*, {d.tokens('p.sentence')} AS words FROM ({picked}) p WHERE length(p.sentence) >= 15"


@relation
def sentence_vecs(d: Dialect) -> str:
    return f"SELECT qid, hit, sat, v, CAST({dot(d, 'v', 'v')} AS BIGINT) AS norm2 FROM ({vector(d, 'qid, hit, spot AS sat', '@sentence_rows@')}) n_"


@relation
def best_sentences(d: Dialect) -> str:
    share, near = cover(d, "s.words")
    scored = (
        f"SELECT s.qid, s.hit, s.spot, s.sentence, coalesce(CAST({dot(d, 'w.qv', 'v.v')} AS DOUBLE) / (sqrt(CAST(w.qnorm2 AS DOUBLE)) * sqrt(CAST(v.norm2 AS DOUBLE))), 0.0) AS dense, "
        f"{share} AS coverage FROM @sentence_rows@ s JOIN @questions@ q ON s.qid = q.qid {near}LEFT JOIN @question_vecs@ w ON w.qid = s.qid "
        "LEFT JOIN @sentence_vecs@ v ON v.qid = s.qid AND v.hit = s.hit AND v.sat = s.spot"
    )
    one = "CAST(1.0 AS DOUBLE)"
    return (
        f"WITH a_ AS (SELECT *, max(coverage) OVER (PARTITION BY qid) AS most FROM ({scored}) s_), "
        "b_ AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, hit, spot) AS rd, row_number() OVER (PARTITION BY qid ORDER BY coverage DESC, dense DESC, hit, spot) AS rw FROM a_ WHERE most < 0.25 OR coverage > 0), "
        f"c_ AS (SELECT *, {one} / ({W.RRF} + rd) + CASE WHEN coverage > 0 THEN ({one} + coverage) / ({W.RRF} + rw) ELSE 0 END AS fused FROM b_), "
        "e_ AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, hit, spot) AS r, max(fused) OVER (PARTITION BY qid) AS best FROM c_), "
        "f_ AS (SELECT qid, hit, spot, sentence, row_number() OVER (PARTITION BY qid, sentence ORDER BY hit, spot) AS nth FROM e_ WHERE r <= 3 AND fused >= 0.6 * best) "
        "SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY hit, spot) AS INT) AS place, sentence FROM f_ WHERE nth = 1"
    )


@relation
def asked_formulas(d: Dialect) -> str:
    """(qid, formula): what of a question looks like a formula, for those that hold one."""
    pieces = d.split("replace(question, '?', ' ')", r"\s+")
    formula = d.join(d.keep(pieces, "t", f"length(t) > 0 AND NOT {d.matches('t', '^\\p{L}{2,}$')}"), "' '")
    return f"SELECT qid, formula FROM (SELECT qid, {formula} AS formula FROM @questions@ WHERE aux = '') f_ WHERE formula LIKE '%=%' AND length(replace(formula, ' ', '')) >= 3"


@relation
def formula_places(d: Dialect) -> str:
    """(qid, doc_id, idx): every equation in the question's scope that holds the formula asked for.

    Equations are met by the grams of three characters in them, on the first gram of the formula, and verified.
    """
    plain = lambda c: f"lower({d.replace(c, r'\s+', chr(39) * 2)})"
    grams = d.distinct(d.each(d.steps("1", "length(said) - 2", "1"), "i", "substr(said, CAST(i AS INT), 3)"))
    said = f"SELECT doc_id, idx, {plain('raw')} AS said FROM @items@ WHERE type = 'equation'"
    indexed = d.explode(f"(SELECT * FROM ({said}) r_ WHERE length(said) >= 3) s_", "doc_id, idx, said", grams, "spot", "gram")
    return in_scope(f"SELECT q.qid, e.doc_id, e.idx FROM (SELECT qid, {plain('formula')} AS asked FROM @asked_formulas@) q JOIN ({indexed}) e ON e.gram = left(q.asked, 3) WHERE position(q.asked IN e.said) > 0")


@relation
def formula_hits(d: Dialect) -> str:
    """(qid, doc_id, idx): the first equation that holds the formula asked for."""
    return "SELECT qid, doc_id, idx FROM (SELECT qid, doc_id, idx, row_number() OVER (PARTITION BY qid ORDER BY doc_id, idx) AS r FROM @formula_places@) m_ WHERE r = 1"


@relation
def decisions(d: Dialect) -> str:
    """First match wins: no documents (a scope that holds none), formula, summary, generic, not found, ambiguous, answer.
    A formula that no equation holds isn't found."""
    summary = d.any("q.words", "t", f"t IN ({quoted(W.SUMMARY)})")
    return (
        f"SELECT q.qid, CASE WHEN q.scope IS NOT NULL AND e.scope IS NULL THEN 'no_documents' WHEN f.qid IS NOT NULL AND h.qid IS NOT NULL THEN 'formula' WHEN f.qid IS NOT NULL THEN 'not_found' WHEN {summary} AND {d.size('q.own')} = 0 AND q.aux = '' THEN 'summary' "
        f"WHEN {d.size('q.terms')} = 0 THEN 'generic' WHEN NOT g.supported THEN 'not_found' WHEN a.qid IS NOT NULL THEN 'ambiguous' ELSE 'answer' END AS route, "
        f"CASE WHEN {d.matches('q.question', '[\\x{0900}-\\x{097F}]')} THEN 'ne' ELSE 'en' END AS lang, g.confidence "
        "FROM @questions@ q LEFT JOIN (SELECT DISTINCT scope FROM @scope_docs@) e ON q.scope = e.scope LEFT JOIN @asked_formulas@ f ON q.qid = f.qid LEFT JOIN @formula_hits@ h ON q.qid = h.qid JOIN @gate@ g ON q.qid = g.qid LEFT JOIN (SELECT DISTINCT qid FROM @ambiguous@) a ON q.qid = a.qid"
    )


@relation
def ambiguous(d: Dialect) -> str:
    """Different places that answer a short question about equally well: (qid, place_no, doc_id, idx), two to four each."""
    line = "OVER (PARTITION BY h.qid ORDER BY h.hybrid DESC, h.doc_id, h.idx)"
    ranked = (
        f"SELECT h.qid, h.doc_id, h.idx, h.hybrid, h.coverage, coalesce(h.section, CAST(h.page AS VARCHAR(9))) AS spot, row_number() {line} AS r, first_value(h.hybrid) {line} AS best_h, first_value(h.coverage) {line} AS best_c "
        f"FROM @hits@ h JOIN @questions@ q ON h.qid = q.qid WHERE q.aux = '' AND {d.size('q.terms')} BETWEEN 1 AND {W.AMBIGUOUS_TERMS}"
    )
    close = f"SELECT * FROM ({ranked}) r_ WHERE best_c > 0 AND hybrid >= best_h * {W.AMBIGUOUS_RATIO} AND coverage >= best_c"
    listed = f"SELECT c.qid, {d.collect(d.struct('r', 'doc_id', 'idx', 'spot', 'v', 'norm2'), 'r')} AS every FROM (SELECT k.qid, k.r, k.doc_id, k.idx, k.spot, v.v, v.norm2 FROM ({close}) k JOIN @vecs@ v ON k.doc_id = v.doc_id AND k.idx = v.idx) c GROUP BY c.qid"
    same = "$x.doc_id = o.doc_id AND ($x.spot = o.spot OR abs($x.idx - o.idx) <= 1)"
    alike = f"CAST({dot(d, '$x.v', 'o.v')} AS DOUBLE) > 0.95 * sqrt(CAST($x.norm2 AS DOUBLE)) * sqrt(CAST(o.norm2 AS DOUBLE))"
    chosen = d.choose("every", f"{d.size('$c')} < {W.OPTIONS} AND NOT {d.any('$c', 'o', f'({same}) OR ({alike})')}")
    exploded = d.explode(f"(SELECT qid, {chosen} AS chosen FROM ({listed}) l_) c_", "qid, chosen", "chosen", "place_no", "o")
    return f"SELECT qid, place_no, o.doc_id AS doc_id, o.idx AS idx FROM ({exploded}) e_ WHERE {d.size('chosen')} >= 2"


@relation
def distinctive(d: Dialect) -> str:
    """The three rarest telling words of an item, longer ones first among equals."""
    skip = quoted([*W.GENERIC, *W.SUMMARY])
    digits = d.matches("t.token", "^[0-9]+$")
    return (
        "SELECT doc_id, idx, token, r FROM (SELECT t.doc_id, t.idx, t.token, row_number() OVER (PARTITION BY t.doc_id, t.idx ORDER BY f.df, length(t.token) DESC, t.token) AS r "
        f"FROM @item_tokens@ t JOIN (SELECT token, count(*) AS df FROM @item_tokens@ GROUP BY token) f ON t.token = f.token WHERE length(t.token) >= 4 AND t.token NOT IN ({skip}) AND NOT {digits}) w_ WHERE r <= 3"
    )
