"""Scalar expressions as SQL text, for Spark and for the DuckDB statements that restate the queries.

Relations (docquarry.plans.relations) are written once over these; only what the two engines spell differently is here.
Everything is built-in functions and lambdas over arrays: no Python runs in an executor.
"""

from __future__ import annotations

from docquarry.functions import words as W

TOKEN = r"[\p{L}\p{N}_\x{0900}-\x{097F}]+"
CAPITALS = r"(?:^|[^\p{L}\p{N}_])([A-Z][A-Za-z0-9\-]{2,}(?:\s+[A-Z][A-Za-z0-9\-]{2,})*)"

# Signs and commands that mark mathematics.
MATH = "∑∫√∞≈≠≤≥∂∇∈∀∃±×÷αβγδθλμπσωΔΣΩ^_{}" + chr(92) + "="
LATEX = r"\\(frac|sum|int|sqrt|alpha|beta|gamma|mathbb|mathbf|begin|cdot|times|left|right)|\$\$"


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


class Dialect:
    name = "duck"
    bigint = "BIGINT"

    def text(self, value: str) -> str:
        """A string literal."""
        return "'" + value.replace("'", "''") + "'"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def words(self, values: list[str]) -> str:
        return self.array(*[self.text(v) for v in values])

    def each(self, items: str, var: str, body: str) -> str:
        return f"list_transform({items}, lambda {var}: {body})"

    def keep(self, items: str, var: str, test: str) -> str:
        return f"list_filter({items}, lambda {var}: {test})"

    def keep_at(self, items: str, var: str, at: str, test: str) -> str:
        """at counts from 0."""
        return f"list_filter({items}, lambda {var}, {at}1: {test.replace('@' + at, '(' + at + '1 - 1)')})"

    def any(self, items: str, var: str, test: str) -> str:
        return f"(len({self.keep(items, var, test)}) > 0)"

    def size(self, items: str) -> str:
        return f"len({items})"

    def holds(self, items: str, item: str) -> str:
        return f"list_contains({items}, {item})"

    def overlap(self, a: str, b: str) -> str:
        """Whether two arrays without nulls share an item."""
        return f"list_has_any({a}, {b})"

    def without(self, items: str, others: str) -> str:
        return f"list_filter({items}, lambda w_: NOT list_contains({others}, w_))"

    def common(self, a: str, b: str) -> str:
        return f"list_filter({a}, lambda w_: list_contains({b}, w_))"

    def distinct(self, items: str) -> str:
        return f"list_distinct({items})"

    def join(self, items: str, by: str) -> str:
        return f"array_to_string({items}, {by})"

    def sort(self, items: str) -> str:
        return f"list_sort({items})"

    def total(self, items: str) -> str:
        """The sum of an array of long integers."""
        return f"CAST(list_sum({items}) AS BIGINT)"

    def part(self, items: str, start: str) -> str:
        """From the item at start (from 0) to the end."""
        return f"list_slice({items}, {start} + 1, len({items}))"

    def head(self, items: str, n: str) -> str:
        return f"list_slice({items}, 1, {n})"

    def at(self, items: str, i: str) -> str:
        return f"({items})[({i}) + 1]"

    def concat(self, *arrays: str) -> str:
        out = arrays[0]
        for a in arrays[1:]:
            out = f"list_concat({out}, {a})"
        return out

    def steps(self, start: str, end: str, by: str) -> str:
        return f"range({start}, {end} + 1, {by})"

    def fold(self, items: str, init: str, acc: str, var: str, body: str, kind: str) -> str:
        return f"list_reduce(list_transform({items}, lambda x_: {{'out': NULL::VARCHAR[], 'cur': [x_], 'n': 0}}), lambda {acc}, y_: {body.replace('$' + var, 'y_.cur[1]')}, {init})"

    def choose(self, items: str, test: str) -> str:
        """A greedy choice in order: $x joins the chosen $c if the test holds."""
        body = test.replace("$x", "y_[1]").replace("$c", "acc_")
        return f"list_reduce(list_transform({items}, lambda x_: [x_]), lambda acc_, y_: CASE WHEN {body} THEN list_concat(acc_, y_) ELSE acc_ END, list_slice({items}, 1, 0))"

    def struct(self, *fields: str) -> str:
        return "{" + ", ".join(f"'{f}': {f}" for f in fields) + "}"

    def find_all(self, text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({text}, {self.text(pattern)}, {group})"

    def replace(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, {self.text(pattern)}, {by}, 'g')"

    def group_one(self, suffix: str) -> str:
        return "'\\1' || " + suffix

    def split(self, text: str, pattern: str) -> str:
        return f"regexp_split_to_array({text}, {self.text(pattern)})"

    def matches(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, {self.text(pattern)})"

    def newline(self) -> str:
        return "chr(10)"

    def md5_bucket(self, text: str, n: int) -> str:
        return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % {n})"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def collect(self, item: str, order: str = "") -> str:
        return f"list({item}{' ORDER BY ' + order if order else ''})"

    def explode(self, relation: str, columns: str, items: str, at: str = "pos", value: str = "item") -> str:
        """A row per item with its place from 0."""
        return f"SELECT {columns}, (i_ - 1)::INTEGER AS {at}, l_[i_] AS {value} FROM (SELECT *, {items} AS l_ FROM {relation}) e_, unnest(range(1, len(l_) + 1)) AS u_(i_)"

    def gathered(self, text: str, order: str, by: str) -> str:
        """The texts of a group in order, as one text; nulls are left out."""
        return f"string_agg({text}, {by} ORDER BY {order})"

    def before(self, text: str, over: str) -> str:
        """The texts of a window's frame, one space between; null where there are none."""
        return f"string_agg({text}, ' ') OVER ({over})"

    # --- text functions, the same for both ---

    def strip(self, text: str) -> str:
        return self.replace(text, r"^\s+|\s+$", "''")

    def sentences(self, text: str) -> str:
        marked = self.replace(text, r"।\s*", f"'।' || {self.newline()}")
        marked = self.replace(marked, r"([.!?])\s+", self.group_one(self.newline()))
        trimmed = self.each(self.split(marked, r"\n+"), "s", self.strip("s"))
        return self.keep(trimmed, "s", "length(s) > 2")

    def raw_tokens(self, text: str) -> str:
        return self.find_all(text, TOKEN)

    def digits(self, text: str) -> str:
        return f"translate({text}, '{W.DEVANAGARI_DIGITS}', '{W.ASCII_DIGITS}')"

    def tokens(self, text: str) -> str:
        kept = self.keep(self.raw_tokens(text), "t", f"length(t) > 1 AND lower(t) NOT IN ({quoted(W.STOP)})")
        return self.distinct(self.each(kept, "t", self.digits("lower(t)")))

    def content_tokens(self, text: str) -> str:
        return self.keep(self.tokens(text), "c", f"c NOT IN ({quoted([*W.GENERIC, *W.SUMMARY, *W.KIND_FILLER])})")

    def stem(self, word: str) -> str:
        w = f"lower({word})"
        cases = [f"WHEN {w} LIKE '%{s}' AND length({w}) - {len(s)} >= 3 THEN left({w}, length({w}) - {len(s)})" for s in W.SUFFIXES]
        native = f"CASE {' '.join(cases)} ELSE {w} END"
        latin = (
            f"CASE WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y' "
            f"WHEN length({w}) > 4 AND {w} LIKE '%es' THEN left({w}, length({w}) - 2) "
            f"WHEN length({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1) ELSE {w} END"
        )
        return f"(CASE WHEN {self.matches(w, '[\\x{0900}-\\x{097F}]')} THEN {native} ELSE {latin} END)"

    def token_match(self, a: str, b: str) -> str:
        short, gap = f"least(length({a}), length({b}))", f"abs(length({a}) - length({b}))"
        k = f"greatest(4, {self.div(short + ' * 4', '5')})"
        return (
            f"({a} = {b} OR ({short} >= 3 AND {gap} <= 3 AND left({a}, {short}) = left({b}, {short})) "
            f"OR ({short} >= 4 AND {gap} <= 4 AND left({a}, {k}) = left({b}, {k})))"
        )

    def match_keys(self, word: str) -> str:
        """Beginnings of a word, of which two words that token_match accepts have one in common.

        A word that is the beginning of the other is cut by 3 characters at most; words that share four fifths of the
        shorter one, whose length is within 4 of the word's own, share a beginning of one of the lengths here.
        """
        n = f"length({word})"
        cut = self.keep(self.each(self.steps("0", "3", "1"), "c", f"{n} - c"), "j", f"j >= 3 OR j = {n}")
        fifths = self.each(self.keep(self.each(self.steps("0", "4", "1"), "c", f"{n} - c"), "s", "s >= 4"), "s", f"greatest(4, {self.div('s * 4', '5')})")
        return self.distinct(self.each(self.concat(cut, fifths), "j", f"left({word}, CAST(j AS INT))"))

    def covered(self, near: str, n_terms: str, tokens: str) -> str:
        """coverage by lists, one a term, of the tokens that match it."""
        hit = self.size(self.keep(near, "m", self.overlap("m", tokens)))
        return f"(CASE WHEN {n_terms} = 0 OR {near} IS NULL THEN 0.0 ELSE CAST({hit} AS DOUBLE) / {n_terms} END)"

    def coverage(self, terms: str, tokens: str) -> str:
        hit = self.size(self.keep(terms, "q", self.any(tokens, "t", self.token_match("q", "t"))))
        return f"(CASE WHEN {self.size(terms)} = 0 THEN 0.0 ELSE CAST({hit} AS DOUBLE) / {self.size(terms)} END)"

    def equation(self, s: str) -> str:
        """Whether a line is an equation by its signs; MATH and LATEX are fixed values."""
        strong = f"(length({s}) - length(translate({s}, {self.text(MATH)}, '')))"
        brackets = f"(length({s}) - length(translate({s}, '()/^_*', '')))"
        long_words = self.size(self.find_all(s, "[A-Za-z]{6,}"))
        return (
            f"(CASE WHEN length({s}) < 3 OR length({s}) > 180 THEN FALSE WHEN {self.matches(s, LATEX)} THEN TRUE WHEN {long_words} > 2 THEN FALSE "
            f"WHEN {strong} >= 2 AND {strong} > 0.08 * length({s}) THEN TRUE ELSE {s} LIKE '%=%' AND {brackets} >= 3 AND length({s}) <= 120 END)"
        )

    def entity_words(self, text: str) -> str:
        """Stemmed words from which entities are made, in order."""
        mapped = self.each(self.raw_tokens(f"lower({text})"), "t", self.digits("t"))
        kept = self.keep(mapped, "t", f"length(t) >= 4 AND t NOT IN ({quoted([*W.GENERIC, *W.SUMMARY])}) AND NOT {self.matches('t', '^[0-9]+$')}")
        return self.each(kept, "t", self.stem("t"))

    def chunks(self, text: str) -> str:
        """Sentences packed into chunks with whole sentences carried over."""
        big, over = W.CHUNK_CHARS, W.CHUNK_OVERLAP
        nl = self.newline()
        sents = self.sentences(self.replace(text, r"[ \t]+", "' '"))
        joined = self.join("a.cur", nl)
        done = f"CASE WHEN {self.size('a.cur')} > 0 THEN {self.array(joined)} ELSE {self.empty()} END"
        cuts = self.each(self.steps("0", "length($s) - 1", str(big - over)), "i", self.strip(f"substr($s, CAST(i + 1 AS INTEGER), {big})"))
        kept = self.keep_at("a.cur", "c", "k", f"length({self.join(self.part('a.cur', '@k'), nl)}) <= {over}")
        kept_size = f"(CASE WHEN {self.size(kept)} > 0 THEN length({self.join(kept, nl)}) + 1 ELSE 0 END)"
        body = (
            f"CASE WHEN length($s) > {big} THEN {self.state(self.concat('a.out', done, cuts), self.empty(), '0')} "
            f"WHEN a.n + length($s) + 1 > {big} AND {self.size('a.cur')} > 0 THEN "
            f"{self.state(self.concat('a.out', self.array(joined)), self.concat(kept, self.array('$s')), kept_size + ' + length($s) + 1')} "
            f"ELSE {self.state('a.out', self.concat('a.cur', self.array('$s')), 'a.n + length($s) + 1')} END"
        )
        folded = self.fold(sents, self.state(self.empty(), self.empty(), "0"), "a", "s", body, "")
        every = self.each(self.array(folded), "f", self.concat("f.out", f"CASE WHEN {self.size('f.cur')} > 0 THEN {self.array(self.join('f.cur', nl))} ELSE {self.empty()} END"))
        return self.keep(self.at(every, "0"), "c", f"length({self.strip('c')}) > {W.SHORTEST_CHUNK}")

    def empty(self) -> str:
        return "[]::VARCHAR[]"

    def state(self, out: str, cur: str, n: str) -> str:
        return f"{{'out': {out}, 'cur': {cur}, 'n': CAST({n} AS INTEGER)}}"


class SparkDialect(Dialect):
    name = "spark"

    def text(self, value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def each(self, items: str, var: str, body: str) -> str:
        return f"transform({items}, {var} -> {body})"

    def keep(self, items: str, var: str, test: str) -> str:
        return f"filter({items}, {var} -> {test})"

    def keep_at(self, items: str, var: str, at: str, test: str) -> str:
        return f"filter({items}, ({var}, {at}) -> {test.replace('@' + at, at)})"

    def any(self, items: str, var: str, test: str) -> str:
        return f"exists({items}, {var} -> {test})"

    def size(self, items: str) -> str:
        return f"size({items})"

    def holds(self, items: str, item: str) -> str:
        return f"array_contains({items}, {item})"

    def overlap(self, a: str, b: str) -> str:
        return f"arrays_overlap({a}, {b})"

    def without(self, items: str, others: str) -> str:
        return f"array_except({items}, {others})"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def distinct(self, items: str) -> str:
        return f"array_distinct({items})"

    def join(self, items: str, by: str) -> str:
        return f"array_join({items}, {by})"

    def sort(self, items: str) -> str:
        return f"array_sort({items})"

    def total(self, items: str) -> str:
        return f"aggregate({items}, 0L, (s_, x_) -> s_ + x_)"

    def part(self, items: str, start: str) -> str:
        return f"slice({items}, {start} + 1, size({items}))"

    def head(self, items: str, n: str) -> str:
        return f"slice({items}, 1, {n})"

    def at(self, items: str, i: str) -> str:
        return f"get({items}, {i})"

    def concat(self, *arrays: str) -> str:
        return f"concat({', '.join(arrays)})"

    def steps(self, start: str, end: str, by: str) -> str:
        return f"sequence({start}, {end}, {by})"

    def fold(self, items: str, init: str, acc: str, var: str, body: str, kind: str) -> str:
        return f"aggregate({items}, {init}, ({acc}, {var}) -> {body.replace('$' + var, var)})"

    def find_all(self, text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({text}, {self.text(pattern)}, {group})"

    def replace(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, {self.text(pattern)}, {by})"

    def group_one(self, suffix: str) -> str:
        return "'$1' || " + suffix

    def split(self, text: str, pattern: str) -> str:
        return f"split({text}, {self.text(pattern)})"

    def matches(self, text: str, pattern: str) -> str:
        return f"rlike({text}, {self.text(pattern)})"

    def choose(self, items: str, test: str) -> str:
        body = test.replace("$x", "x_").replace("$c", "acc_")
        return f"aggregate({items}, slice({items}, 1, 0), (acc_, x_) -> CASE WHEN {body} THEN concat(acc_, array(x_)) ELSE acc_ END)"

    def struct(self, *fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{f}', {f}" for f in fields) + ")"

    def md5_bucket(self, text: str, n: int) -> str:
        return f"(CAST(conv(substr(md5({text}), 1, 8), 16, 10) AS BIGINT) % {n})"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def collect(self, item: str, order: str = "") -> str:
        """order is ignored: the item's first field must order it."""
        return f"array_sort(collect_list({item}))"

    def explode(self, relation: str, columns: str, items: str, at: str = "pos", value: str = "item") -> str:
        return f"SELECT {columns}, {at}, {value} FROM {relation} LATERAL VIEW posexplode({items}) AS {at}, {value}"

    def gathered(self, text: str, order: str, by: str) -> str:
        return f"array_join(transform(array_sort(collect_list(struct({order}, {text} AS said_))), x -> x.said_), {by})"

    def before(self, text: str, over: str) -> str:
        return f"array_join(collect_list({text}) OVER ({over}), ' ')"

    def empty(self) -> str:
        return "CAST(array() AS array<string>)"

    def state(self, out: str, cur: str, n: str) -> str:
        return f"named_struct('out', {out}, 'cur', {cur}, 'n', CAST({n} AS INT))"


SPARK, DUCK = SparkDialect(), Dialect()
