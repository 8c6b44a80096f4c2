"""Byte-level BPE encoding and decoding by a rank queue over a hierarchical bitmap.

A text is split by a pattern; each piece is merged on its own. The pairs that could merge wait in buckets, one per
merge rank, that hold positions in a doubly linked list of parts. Which buckets hold anything is kept in a bitmap of
two levels (a bit per rank, a bit per word of 256 ranks), so the next rank is two find-first-set steps away. A merge changes the ranks of its two neighbours; their old entries stay where they are and
are skipped as stale when they come up. Work per piece is O(n log n) for n bytes, also for one piece of a whole text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RankQueue:
    """Positions by merge rank: the smallest rank comes first and, within it, the smallest position.

    buckets[rank] is None, one position, or a heap of them. The bitmap says which buckets hold something.
    Draining leaves everything empty, so one queue serves all pieces. ByteBPE.merge enters and takes positions.
    """

    __slots__ = ("buckets", "words")

    def __init__(self, n_ranks: int) -> None:
        self.buckets: list[int | list[int] | None] = [None] * (n_ranks + 1)
        self.words = [0] * ((n_ranks >> 8) + 1)


class PieceMemo(dict):
    """From a piece to its ids in decimal, joined by spaces; a missing piece is encoded on the spot.

    Two generations bound the memory: a full generation becomes the old one, and what is still used moves over.
    """

    def __init__(self, encode: Callable[[bytes], list[int]], entries: int, longest: int) -> None:
        super().__init__()
        self.encode, self.entries, self.longest = encode, entries, longest
        self.old: dict[str, str] = {}

    def __missing__(self, piece: str) -> str:
        said = self.old.get(piece)
        if said is None:
            said = " ".join(map(str, self.encode(piece.encode("utf-8"))))
        if len(piece) <= self.longest:
            self[piece] = said
        return said

    def turn(self) -> None:
        """To be called between texts."""
        if len(self) > self.entries:
            self.old = dict(self)
            self.clear()


class ByteBPE:
    """Encoder and decoder for the ranks of a tiktoken file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_entries: int = 400_000, memo_chars: int = 48) -> None:
        """memo_entries: pieces, of at most memo_chars characters, in a generation of the memo."""
        self.ranks = ranks
        self.parts = {str(i): b for b, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0))
        self.memo = PieceMemo(self.merge, memo_entries, memo_chars)

    @classmethod
    def from_lines(cls, lines: Iterable[bytes], pattern: str) -> ByteBPE:
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        rank_of = ranks.get
        current = [rank_of(piece[i : i + 2], -1) for i in range(n)]
        current[n - 1] = -1
        # entering and taking are written out here: most pieces have a few bytes, and calls would take longer than the work
        queue = self.queue
        buckets, words, top = queue.buckets, queue.words, 0
        waiting = [(rank, i) for i, rank in enumerate(current) if rank >= 0]
        while True:
            for rank, position in waiting:
                bucket = buckets[rank]
                if bucket is None:
                    buckets[rank] = position
                    high = rank >> 8
                    words[high] |= 1 << (rank & 255)
                    top |= 1 << high
                elif type(bucket) is int:
                    buckets[rank] = [bucket, position] if bucket < position else [position, bucket]
                else:
                    heappush(bucket, position)
            if not top:
                break
            first = top & -top
            high = first.bit_length() - 1
            word = words[high]
            low = word & -word
            rank = (high << 8) + low.bit_length() - 1
            i = buckets[rank]
            left_over = None
            if type(i) is not int:
                left_over = i
                i = heappop(left_over)
            if not left_over:
                buckets[rank] = None
                words[high] = word = word ^ low
                if not word:
                    top ^= first
            waiting = []
            if current[i] != rank:
                continue
            gone = after[i]
            end = after[gone]
            after[i] = end
            current[gone] = -1
            if end < n:
                before[end] = i
                current[i] = new = rank_of(piece[i : after[end]], -1)
                if new >= 0:
                    waiting.append((new, i))
            else:
                current[i] = -1
            left = before[i]
            if left >= 0:
                current[left] = new = rank_of(piece[left:end], -1)
                if new >= 0:
                    waiting.append((new, left))
        ids, i = [], 0
        while i < n:
            end = after[i]
            ids.append(ranks[piece[i:end]])
            i = end
        return ids

    def encode_said(self, text: str) -> str:
        """The ids of a text in decimal, joined by one space."""
        self.memo.turn()
        return " ".join(map(self.memo.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.encode_said(text).split()))

    def decode_said(self, said: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, said.split()))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.parts[str(i)] for i in ids)


_loaded: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(path: str, pattern: str) -> ByteBPE:
    """The tokenizer of a rank file, read once in each Python worker. The path is one that every executor has."""
    key = (path, pattern)
    if key not in _loaded:
        with open(path, "rb") as lines:
            _loaded[key] = ByteBPE.from_lines(lines, pattern)
    return _loaded[key]


def public_pattern_and_path(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.PATTERN, public_tokenizers.path(name)


def encode_documents(
    docs: DataFrame, text: str = "text", name: str = "byte_bpe_50k.tiktoken", key: str = "doc_id"
) -> DataFrame:
    """(key, ids array<int>) for each row of docs, in one narrow pass; null text encodes as empty."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, path = public_pattern_and_path(name)
        bpe = tokenizer(path, pattern)
        for part in parts:
            ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    chosen = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return chosen.mapInArrow(batches, "key long, ids array<int>").withColumnRenamed("key", key)


def decode_documents(
    encoded: DataFrame, ids: str = "ids", name: str = "byte_bpe_50k.tiktoken", key: str = "doc_id"
) -> DataFrame:
    """(key, bytes binary): what the ids stand for; null ids decode as empty."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, path = public_pattern_and_path(name)
        bpe = tokenizer(path, pattern)
        for part in parts:
            raw = [bpe.decode(x or ()) for x in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(raw, pa.binary())], ["key", "bytes"])

    chosen = encoded.select(F.col(key).cast("long").alias("key"), F.col(ids).alias("ids"))
    return chosen.mapInArrow(batches, "key long, bytes binary").withColumnRenamed("key", key)


def bpe_digest(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Encode and decode each whole text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One row per input row, in one narrow pass without a shuffle. A null text counts as empty: no tokens, digests of
    nothing. A null doc_id, repeated rows and further columns change nothing in the other rows; an empty table gives
    an empty result. A slice of rows is encoded at a time, so memory holds the ids of one text.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, path = public_pattern_and_path(name)
        bpe = tokenizer(path, pattern)
        sha = hashlib.sha256
        for part in parts:
            counts, encoded, decoded = [], [], []
            for value in part.column(1):
                said = bpe.encode_said(value.as_py() or "")
                counts.append(said.count(" ") + 1 if said else 0)
                encoded.append(sha(said.encode()).hexdigest())
                decoded.append(sha(bpe.decode_said(said)).hexdigest())
            yield pa.record_batch(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
