"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine over sentences.

A text is cut into sentences. The kernel of two sentences sums, over the subsequences of ORDER letters that both hold
within REACH letters (word edges count as letters), the product of DECAY to the letters skipped, so gaps and inserted
letters only damp a match; it is divided by a positive function of each sentence's length, which keeps it a kernel.
Before that, letters put for others (0 for o) are restored, punctuation inside words goes, and runs of single letters
("i d i o t") are joined. Landmark sentences span the Nyström features, on which a squared-hinge machine is trained.

Labels are of documents. A toxic document is a bag of sentences of which one at least is toxic, so training goes in
rounds: the document's strongest sentence so far stands for it, all sentences of clean documents are clean, and those that
are put most wrongly come into the next round. A text scores by its two strongest sentences, calibrated to 0..1.

The kernel is a product of explicit subsequence counts, so the trained sum over landmarks folds into one weight per
subsequence: scoring looks up the subsequences of a text in a table of fixed size (TABLE floats). The machine is fitted in
one executor task on a bounded sample; the driver gets the table and two numbers per sampled document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import cut_lineage, spread_key

ORDER, REACH, DECAY = 4, 6, 0.5
CODE_BITS = 5
TABLE = 1 << (ORDER * CODE_BITS)
#: (second, third, fourth): where the further letters of a subsequence stand from its first.
STEPS = [(a, b, c) for c in range(3, REACH) for b in range(2, c) for a in range(1, b)]
#: Sentences are read as clauses of so many words at most; an insult of several words may fall on both sides of a cut.
SENTENCE_WORDS = 5
#: Kernels are divided by the root of each length, but by no less than that of SHORT letters.
SHORT = 8.0

#: Bounds of the training sample: documents of each class and sentences of each, evenly spaced; of the documents every
#: CALIBRATE-th calibrates the machine and the others train it. Landmarks, sentences of clean documents in a round, rounds.
TOXIC_DOCS, CLEAN_DOCS, TOXIC_SENTENCES, CLEAN_SENTENCES, CALIBRATE = 2_000, 4_000, 120, 24, 5
LANDMARKS, CLEAN_TRAINED, ROUNDS, RIDGE = 300, 12_000, 3, 1e-4
#: Characters of text worked on at a time.
SLICE = 1 << 19

SPACE, OTHER, END, DROP = 27, 28, 254, 255


def _classes() -> np.ndarray:
    """Codes of characters: a-z 1 to 26 (leet signs with them), white space, four classes of other letters, ends, the rest."""
    known = [chr(i) for i in range(1 << 16)]
    out = np.array([OTHER + i % 4 if c.isalnum() else SPACE if c.isspace() else DROP for i, c in enumerate(known)], np.uint8)
    out[97:123] = np.arange(1, 27)
    for sign, letter in zip("013457@$", "oieastas", strict=True):
        out[ord(sign)] = ord(letter) - 96
    for sign in ".!?\n":
        out[ord(sign)] = END
    return out


CLASSES = _classes()


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, lengths, owners) of the sentences of texts: from starts[i], a word edge, lengths[i] codes, a word
    edge; then zeros, so that no subsequence reaches from one sentence into another. owners[i] is the text's number."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = CLASSES[np.minimum(points, len(CLASSES) - 1)]
    after = np.append(code[1:], END)
    inside = (code == END) & (points != 10) & (after != SPACE) & (after != END)  # a dot within a word
    at = np.flatnonzero((code != DROP) & ~inside)
    code = code[at]
    code = np.where(code == END, 0, code)
    before = np.append(0, code[:-1])
    kept = (code != SPACE) | ((before != SPACE) & (before != 0))
    at, code = at[kept], code[kept]
    letter = (code > 0) & (code != SPACE)
    alone = letter & ~np.append(False, letter[:-1]) & ~np.append(letter[1:], False)
    link = np.zeros(len(code), bool)
    link[1:-1] = (code[1:-1] == SPACE) & alone[:-2] & alone[2:]
    spelled = np.zeros_like(link)
    spelled[2:] |= link[:-2]
    spelled[:-2] |= link[2:]
    at, code = at[~(link & spelled)], code[~(link & spelled)]
    spaces = np.cumsum(code == SPACE)
    since = spaces - np.maximum.accumulate(np.where(code == 0, spaces, 0))
    code = np.where((code == SPACE) & (since % SENTENCE_WORDS == 0), 0, code)
    ends = np.flatnonzero(code == 0)
    lengths = np.diff(np.append(-1, ends)) - 1
    wide = np.where(code == 0, REACH + 2, 1)
    placed = np.cumsum(wide) - wide
    codes = np.repeat(code, wide)
    codes[placed[ends]] = codes[placed[ends] + REACH + 1] = SPACE
    codes = np.append(SPACE, codes).astype(np.int32)
    starts = np.append(0, placed[ends] + REACH + 2)[:-1]
    first = at[np.append(0, ends[:-1] + 1)]
    heads = np.cumsum([0, *[len(t) + 1 for t in lowered]])[:-1]
    owners = np.searchsorted(heads, first, side="right") - 1
    real = lengths > 0
    return codes, starts[real], lengths[real], owners[real]


def _numbers(codes: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """For each step: the subsequence number at every place, and the letters skipped."""
    n = len(codes)
    padded = np.append(codes, np.zeros(REACH, np.int32))
    head, second, third = codes << (3 * CODE_BITS), padded << (2 * CODE_BITS), padded << CODE_BITS
    for a, b, c in STEPS:
        yield head | second[a : a + n] | third[b : b + n] | padded[c : c + n], c - (ORDER - 1)


def _scale(lengths: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(lengths, SHORT))


def _complete(table: np.ndarray) -> np.ndarray:
    """The table without weights for what isn't a subsequence of ORDER letters."""
    by_letter = table.reshape((1 << CODE_BITS,) * ORDER)
    for axis in range(ORDER):
        by_letter[(slice(None),) * axis + (0,)] = 0
    return by_letter.reshape(-1)


@dataclass
class Model:
    """A weight per subsequence, the bias, and the logistic curve through a text's two strongest margins."""

    table: np.ndarray
    bias: float
    curve: tuple[float, float, float] = (1.0, 0.0, 0.0)

    def sentence_margins(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        sums = np.zeros((REACH - ORDER + 1, len(codes)), np.float32)
        for numbers, skipped in _numbers(codes):
            sums[skipped] += self.table[numbers]
        each = sums.T @ (DECAY ** np.arange(len(sums))).astype(np.float32)
        return np.add.reduceat(each, starts, dtype=np.float64) / _scale(lengths) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1.0 / (1.0 + np.exp(-np.clip(a * margins[:, 0] + b * margins[:, 1] + c, -40, 40)))


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of SLICE characters at most; a piece ends with a line, else a word, where there is one."""
    at = 0
    while len(text) - at > SLICE:
        end = max(text.rfind("\n", at, at + SLICE), at) or at
        end = end if end > at else text.rfind(" ", at, at + SLICE)
        end = end + 1 if end > at else at + SLICE
        yield text[at:end]
        at = end
    yield text[at:]


def _top_two(values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """The largest and the second largest value of each of n owners; minus infinity where there is none."""
    out = np.full((n, 2), -np.inf)
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    last = np.flatnonzero(np.append(owners[1:] != owners[:-1], True)) if len(owners) else np.zeros(0, np.int64)
    out[owners[last], 0] = values[last]
    second = last[(last > 0) & (owners[last - 1] == owners[last])]
    out[owners[second], 1] = values[second - 1]
    return out


def text_margins(model: Model, column: pa.Array) -> np.ndarray:
    """The strongest and the second strongest margin among the sentences of each text; the bias where there is none.

    A bounded number of characters is worked on at a time, however long a text is.
    """
    found: list[np.ndarray] = [np.zeros(0)]
    whose: list[np.ndarray] = [np.zeros(0, np.int64)]
    held: list[str] = []
    numbers: list[int] = []

    def settle() -> None:
        codes, starts, lengths, owners = coded(held)
        best = _top_two(model.sentence_margins(codes, starts, lengths), owners, len(held))
        found.append(best.reshape(-1))
        whose.append(np.repeat(np.asarray(numbers, np.int64), 2))
        held.clear()
        numbers.clear()

    size = 0
    for number, value in enumerate(column):
        for piece in _pieces(value.as_py() or ""):
            held.append(piece)
            numbers.append(number)
            size += len(piece)
            if size >= SLICE:
                settle()
                size = 0
    if held:
        settle()
    values, owners = np.concatenate(found), np.concatenate(whose)
    real = np.isfinite(values)
    out = _top_two(values[real], owners[real], len(column))
    return np.where(np.isfinite(out), out, model.bias)


def _kernel(model_rows: np.ndarray, columns: np.ndarray, sentences: list[np.ndarray]) -> np.ndarray:
    """Kernels of sentences (their codes with edges) with the landmarks whose weights by subsequence are columns."""
    out = np.zeros((len(sentences), columns.shape[1]), np.float32)
    gap = np.zeros(REACH, np.int32)
    for at in range(0, len(sentences), 64):
        some = sentences[at : at + 64]
        codes = np.concatenate([x for s in some for x in (s, gap)])
        whose = np.repeat(np.arange(len(some)), [len(s) + REACH for s in some])
        rows, owners, weights = [], [], []
        for numbers, skipped in _numbers(codes):
            hit = np.flatnonzero(model_rows[numbers])
            rows.append(model_rows[numbers[hit]])
            owners.append(whose[hit])
            weights.append(np.full(len(hit), DECAY**skipped, np.float32))
        row, owner, weight = np.concatenate(rows), np.concatenate(owners), np.concatenate(weights)
        order = np.argsort(owner, kind="stable")
        row, owner, weight = row[order], owner[order], weight[order]
        if len(row):
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            out[at + owner[heads]] = np.add.reduceat(columns[row] * weight[:, None], heads, axis=0)
    return out / _scale(np.array([len(s) - 2 for s in sentences], np.int64))[:, None].astype(np.float32)


def _landmarks(chosen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subsequences of the landmarks, their row in the table of columns (0: none), and that table."""
    listed = [(np.concatenate([n for n, _ in parts]), np.concatenate([np.full(len(n), DECAY**k, np.float32) for n, k in parts])) for parts in (list(_numbers(s)) for s in chosen)]
    real = _complete(np.ones(TABLE, bool))
    active = np.unique(np.concatenate([n for n, _ in listed]))
    active = active[real[active]]
    rows = np.zeros(TABLE, np.int32)
    rows[active] = np.arange(1, len(active) + 1)
    columns = np.zeros((len(active) + 1, len(chosen)), np.float32)
    for m, (numbers, weights) in enumerate(listed):
        columns[:, m] = np.bincount(rows[numbers], weights, len(columns)) / _scale(np.array(len(chosen[m]) - 2))
    columns[0] = 0
    return active, rows, columns


def _svm(kernel: np.ndarray, landmarks: np.ndarray, signs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the landmarks and the bias: Nyström features, squared hinge, Newton steps of the primal."""
    square = kernel[landmarks].astype(np.float64)
    values, vectors = np.linalg.eigh((square + square.T) / 2)
    keep = values > values.max(initial=0) * 1e-6
    whiten = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    features = np.append(kernel @ whiten, np.ones((len(kernel), 1), np.float32), axis=1)
    w = np.zeros(features.shape[1])
    penalty = np.eye(len(w)) * RIDGE * weights.sum()
    penalty[-1, -1] = 1e-6
    for _ in range(15):
        held = signs * (features @ w) < 1
        x, c = features[held], weights[held].astype(np.float32)
        new = np.linalg.solve(x.T @ (x * c[:, None]) + penalty, x.T @ (c * signs[held].astype(np.float32)))
        done = np.abs(new - w).max() < 1e-4 * max(1.0, np.abs(new).max())
        w = new
        if done:
            break
    return whiten.astype(np.float64) @ w[:-1], float(w[-1])


def fit(codes: np.ndarray, lengths: np.ndarray, docs: np.ndarray, toxic: np.ndarray, seed: int = 11) -> tuple[np.ndarray, float]:
    """The folded table and the bias, from sentences: their codes (bytes, with edges, a gap of zeros behind each), lengths,
    document's number (ascending) and label (bool).

    At first a sentence's strength is the log odds of its subsequences that stand in clearly more toxic documents. Arrays over
    all sentences are bytes or one number each; whatever is wider is made for some sentences at a time.
    """
    rng = np.random.default_rng(seed)
    starts = np.cumsum(np.append(0, lengths + 2 + REACH))
    sentence = lambda i: codes[starts[i] : starts[i] + lengths[i] + 2].astype(np.int32)
    heads = np.append(np.flatnonzero(np.append(True, docs[1:] != docs[:-1])), len(docs))
    counts = np.zeros((2, TABLE), np.int32)  # documents of either label that hold a subsequence without gaps
    for i, j in zip(heads, heads[1:], strict=False):
        numbers = next(n for n, skipped in _numbers(codes[starts[i] : starts[j]].astype(np.int32)) if skipped == 0)
        counts[int(toxic[i]), np.unique(numbers)] += 1
    b, a = counts
    n1, n0 = int(toxic[heads[:-1]].sum()), int((~toxic[heads[:-1]]).sum())
    telling = (a / n1 - b / n0) / np.sqrt((a + b + 1) / (n1 + n0) / min(n1, n0)) > 3
    table = _complete(np.where(telling, np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)), 0).astype(np.float32))
    bias, clean = 0.0, np.flatnonzero(~toxic)
    for _ in range(ROUNDS):
        model = Model(table, bias)
        chunks = [(i, min(i + 4096, len(lengths))) for i in range(0, len(lengths), 4096)]
        margins = np.concatenate([model.sentence_margins(codes[starts[i] : starts[j]].astype(np.int32), starts[i:j] - starts[i], lengths[i:j]) for i, j in chunks])
        order = np.lexsort((-margins, docs))
        best = order[np.append(True, docs[order][1:] != docs[order][:-1])]
        witness = best[toxic[best]]
        hard = clean[np.argsort(-margins[clean], kind="stable")[: CLEAN_TRAINED // 2]]
        spread = rng.choice(clean, min(len(clean), CLEAN_TRAINED // 2), replace=False)
        strong = witness[np.argsort(-margins[witness], kind="stable")[: -(-len(witness) * 3 // 4)]]
        some = lambda rows, n: rng.choice(rows, min(len(rows), n), replace=False)
        taken = np.unique(np.concatenate([witness, hard, spread]))
        marks = np.unique(np.concatenate([some(strong, LANDMARKS * 2 // 3), some(hard[: 3 * LANDMARKS], LANDMARKS // 6), some(spread, LANDMARKS // 6)]))
        active, rows, columns = _landmarks([sentence(i) for i in marks])
        signs = np.where(toxic[taken], 1.0, -1.0)
        weights = np.where(signs > 0, 0.5 * (signs < 0).sum() / (signs > 0).sum(), 1.0)
        beta, bias = _svm(_kernel(rows, columns, [sentence(i) for i in taken]), np.searchsorted(taken, marks), signs, weights)
        table = np.zeros(TABLE, np.float32)
        table[active] = columns[1:] @ beta.astype(np.float32)
    return table, bias


def _calibrate(margins: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> tuple[float, float, float]:
    """The logistic curve through (margins, class), with smoothed targets and a small ridge."""
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    target = np.where(toxic > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.c_[margins, np.ones(len(margins))]
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weights * (target - p)) - 1e-3 * w
        step = np.linalg.solve((x * (weights * (p * (1 - p) + 1e-6))[:, None]).T @ x + 1e-3 * np.eye(3), gradient)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return float(w[0]), float(w[1]), float(w[2])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _known(labels: DataFrame) -> DataFrame:
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("l_doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, key, text) of at most TOXIC_DOCS and CLEAN_DOCS labelled documents that aren't held out, by hash of the id."""
    known = _known(labels).withColumn("key", spread_key(F.col("l_doc_id"), "toxicity:"))
    chosen = known.where("toxic = 1").orderBy("key").limit(TOXIC_DOCS).unionByName(known.where("toxic = 0").orderBy("key").limit(CLEAN_DOCS))
    rows = docs.select(F.col("doc_id").cast("long").alias("l_doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "l_doc_id").select("toxic", "key", "text")


def _sampled_sentences(sample: DataFrame) -> DataFrame:
    """(toxic, key, number, codes) of evenly spaced sentences of each document; numbers make the order of rows reproducible."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for label, key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                made = [codes[a : a + n + 2] for piece in _pieces(text.as_py()) for codes, starts, lengths, _ in (coded([piece]),) for a, n in zip(starts, lengths, strict=True)]
                most = TOXIC_SENTENCES if label else CLEAN_SENTENCES
                picked = sorted(set(np.linspace(0, len(made) - 1, min(len(made), most)).astype(int).tolist())) if made else []
                yield pa.record_batch(
                    [pa.array([label] * len(picked), pa.int32()), pa.array([key] * len(picked), pa.string()), pa.array(picked, pa.int64()), pa.array([made[i].astype(np.uint8).tobytes() for i in picked], pa.binary())],
                    ["toxic", "key", "number", "codes"],
                )

    return sample.select("toxic", "key", "text").mapInArrow(batches, "toxic int, key string, number long, codes binary")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from documents and their labels(doc_id, toxic). Rows with held_out(doc_id) never take part.

    Without sentences of documents of both classes every text gets the share of toxic ones (0 without any label).
    """
    sample = cut_lineage(_sample(docs, labels).withColumn("fold", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % CALIBRATE))
    sentences = _sampled_sentences(sample.where("fold <> 0"))

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(parts)
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([("key", "ascending"), ("number", "ascending"), ("codes", "ascending")])
        toxic = rows.column("toxic").to_numpy() == 1
        if not toxic.any() or toxic.all():
            return
        numbered = rows.column("key").combine_chunks().dictionary_encode().indices.to_numpy()  # sorted, so ascending
        lengths = pc.binary_length(rows.column("codes")).to_numpy().astype(np.int64) - 2
        gap = bytes(REACH)
        codes = np.frombuffer(gap.join([*rows.column("codes").to_pylist(), b""]), np.uint8)
        del held, rows
        table, bias = fit(codes, lengths, numbered, toxic)
        yield pa.record_batch([pa.array([table.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["weights", "bias"])

    learned = sentences.repartition(1).mapInArrow(learn, "weights binary, bias double").collect()
    sizes = {r["toxic"]: r["n"] for r in _known(labels).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not learned:
        share = min(max(sizes.get(1, 0) / max(sum(sizes.values()), 1), 1e-9), 1 - 1e-9)
        return Model(np.zeros(TABLE, np.float32), 0.0, (0.0, 0.0, float(np.log(share / (1 - share)))))
    model = Model(np.frombuffer(learned[0]["weights"], np.float32).copy(), learned[0]["bias"])
    rows = sample.select((F.col("toxic") + 2 * (F.col("fold") == 0).cast("int")).cast("long").alias("mark"), "text")
    measured = np.array([(r["mark"], r["first"], r["second"]) for r in _margins(rows, model, "mark").collect()])
    apart = measured[measured[:, 0] >= 2]
    if min((apart[:, 0] == 3).sum(), (apart[:, 0] == 2).sum()) >= 20:  # documents that didn't train, if they are enough
        measured = apart
    classes = measured[:, 0] % 2
    share = np.where(classes == 1, sizes[1] / max(classes.sum(), 1), sizes[0] / max((1 - classes).sum(), 1))
    model.curve = _calibrate(measured[:, 1:], classes, share / share.mean())
    return model


def _margins(rows: DataFrame, model: Model, key: str) -> DataFrame:
    """(key, first, second) of rows(key, text): the two strongest margins. The model's fixed-size table is broadcast."""
    sent = rows.sparkSession.sparkContext.broadcast((model.table, model.bias))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = sent.value
        for part in parts:
            found = text_margins(Model(table, bias), part.column(1))
            yield pa.record_batch([part.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], [key, "first", "second"])

    return rows.select(key, "text").mapInArrow(batches, f"{key} long, first double, second double")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0..1), predicted (1 if score >= 0.5) for every row of docs, one narrow pass.

    Null and empty texts score as a text without any striking sentence. A null doc_id has held_out false. Labels that are
    null, not 0 or 1, or for unknown documents are ignored; of several labels for a document the larger holds.
    Repeated rows score alike; extra columns are ignored; an empty table gives an empty result.
    """
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    a, b, c = model.curve
    raw = F.lit(a) * F.col("first") + F.lit(b) * F.col("second") + F.lit(c)
    score = 1.0 / (1.0 + F.exp(-F.greatest(F.least(raw, F.lit(40.0)), F.lit(-40.0))))
    scored = _margins(rows, model, "doc_id").withColumn("score", score)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with their columns; the text decides, row by row.

    Null and empty texts are judged like any other, as texts without a striking sentence; extra columns come through.
    Where the labels don't hold both classes there is nothing to judge by, and all rows stay.
    """
    model = train(docs, labels)
    if not model.table.any():
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = text_margins(sent.value, part.column(part.schema.get_field_index("text")))
            yield part.filter(pa.array(sent.value.scores(found) < 0.5))

    return docs.mapInArrow(batches, docs.schema)
