"""Items of blocks by one pass over the blocks of each document in order.

Blocks are dealt by document and sorted by place, once; runs of texts, the text before a figure or formula, chunks and the
numbers of items follow from that order, so no window, join or second shuffle of the texts is needed. What is held is one
run of texts, as its chunks need it whole, and the last characters before a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docquarry.functions import words as W
from docquarry.operators.text_scan import SPACE, chunked

ITEM = "doc_id long, filename string, idx int, type string, page int, section string, chunk string, caption string, raw string, description string"
#: Items to a batch that is handed on.
STEP = 4_000


class Places:
    """The items of documents whose rows come in order, as columns."""

    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in ITEM.split(", ")]
        self.doc, self.n, self.before = None, 0, ""
        self.run: tuple | None = None
        self.said: list[str] = []
        self.spot, self.taken, self.named = None, False, None

    def add(self, filename, kind, page, section, chunk, caption="", raw="", description="") -> None:
        for column, value in zip(self.columns, (self.doc, filename, self.n, kind, page, section, chunk, caption, raw, description), strict=True):
            column.append(value)
        self.n += 1

    def close(self) -> None:
        """Ends the run of texts."""
        if self.said:
            filename, page, section = self.run
            for chunk in chunked("\n".join(self.said)):
                self.add(filename, "text", page, section, chunk)
        self.run, self.said = None, []

    def take(self, doc, place, filename, kind, page, section, said, more) -> None:
        if doc != self.doc:
            self.close()
            self.doc, self.n, self.before, self.spot = doc, 0, "", None
        if place != self.spot:
            self.spot, self.taken, self.named = place, False, None
        if kind == "@taken":
            self.taken = True
        elif kind == "@caption":
            self.named = said
        elif self.taken:
            return
        elif kind == "text":
            if self.run != (filename, page, section):
                self.close()
                self.run = (filename, page, section)
            self.said.append(said)
            self.before = f"{self.before} {said[-W.CONTEXT_CHARS :]}"[-W.CONTEXT_CHARS :]
        else:
            self.close()
            self.described(filename, kind, page, section, said, more)

    def described(self, filename, kind, page, section, said, more) -> None:
        """An item of a block that isn't text; of a table the items of its groups of rows follow as rows of their own."""
        context = self.before.strip(SPACE)
        near = f" (near: {context})" if context else ""
        if kind == "image":
            caption = more["caption"] if self.named is None else self.named
            if told := " ".join(p for p in (caption, more["description"], more["footnote"]) if p):
                self.add(filename, kind, page, section, f"Figure: {told}{near}", caption, "", more["description"])
        elif kind == "equation":
            if more["raw"]:
                self.add(filename, kind, page, section, said + near, more["caption"], more["raw"])
        elif kind == "@group":
            self.add(filename, "table", page, section, said, more["caption"], more["raw"])
        elif kind != "table" and said:
            self.add(filename, "text", page, section, said)

    def batch(self) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        fields = [f.split() for f in ITEM.split(", ")]
        made = pa.record_batch([pa.array(c, kinds[kind]) for c, (_, kind) in zip(self.columns, fields, strict=True)], [name for name, _ in fields])
        self.columns = [[] for _ in fields]
        return made


def items(laid: DataFrame) -> DataFrame:
    """(doc_id, filename, idx, type, page, section, chunk, caption, raw, description) of laid(doc_id, block_idx, sub, filename,
    type, page, section, said, more): blocks, and about them rows that come before (sub -1: @taken, @caption) or behind (@group)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for part in parts:
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                places.take(*row)
                if len(places.columns[0]) >= STEP:
                    yield places.batch()
        places.close()
        yield places.batch()

    dealt = laid.repartition("doc_id").sortWithinPartitions("doc_id", "block_idx", "sub")
    return dealt.select("doc_id", "block_idx", "filename", "type", "page", "section", "said", "more").mapInArrow(batches, ITEM)
