"""Files to blocks, the store and the folder stream."""

import io
import zipfile
from concurrent.futures import ThreadPoolExecutor

import pytest

from docquarry.plans import relations
from docquarry.sources import store, text_files
from docquarry.streaming import folder

MD = b"# Title\npara one\nmore\n\n| A | B |\n|---|---|\n| 1 | x \\| y |\n\n$$\nE = mc^2\n$$\nlast"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx() -> bytes:
    xml = (
        f'<w:document xmlns:w="{W}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>'
        "<w:p><w:r><w:t>Body text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr>"
        "<w:tr><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def blocks(spark, name, data):
    files = spark.createDataFrame([(name, bytearray(data))], "path string, content binary")
    return text_files.parse(files).orderBy("block_idx").collect()


def test_blocks(spark):
    found = blocks(spark, "a.md", MD)
    assert [b.type for b in found] == ["text", "text", "table", "equation", "text"]
    assert found[1].text == "para one more" and found[1].section == "Title"
    assert found[2].table_body == "| A | B |\n|---|---|\n| 1 | x \\| y |"
    assert found[3].latex == "E = mc^2"
    assert [(b.type, b.section) for b in blocks(spark, "c.docx", docx())] == [("text", "Head"), ("text", "Head"), ("table", None)]
    odd = b"| not | a table\n\n## Two\n$$a+b$$\nx \xe2\x89\xa4 y \xe2\x89\xa5 z\n\nplain\n| h |\n|---|\n\n|a|b|\n|:--|--:|\n| 1 |\n|2|3|4|\nend"
    told = [(b.type, b.text or b.latex or b.table_body) for b in blocks(spark, "b.md", odd)]
    assert told == [
        ("text", "| not | a table"), ("text", "Two"), ("equation", "a+b"), ("equation", "x ≤ y ≥ z"), ("text", "plain"),
        ("table", "| a | b |  |\n|---|---|---|\n| 1 |  |  |\n| 2 | 3 | 4 |"), ("text", "end"),
    ]
    assert blocks(spark, "empty.txt", b"") == []


def test_csv_becomes_a_table(spark):
    files = spark.createDataFrame([("a.md", bytearray(MD))], "path string, content binary")
    csv = spark.createDataFrame([("x|y", None), ("z", 2)], "name string, n int")
    last = text_files.attach_csv(text_files.parse(files), csv, "a.md").orderBy("block_idx").collect()[-1]
    assert (last.block_idx, last.type, last.table_body) == (5, "table", "| name | n |\n|---|---|\n| x\\|y |  |\n| z | 2 |")


def test_files_store_and_stream(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    for name, data in (("a.md", MD), ("b.md", MD), ("c.docx", docx()), ("d.pdf", b"x"), ("e.docx", b"not a zip")):
        (files / name).write_bytes(data)
    found = text_files.read_files(spark, str(files)).collect()
    assert sorted(r["type"] for r in found) == ["equation", "error", "error", "table", "table", "text", "text", "text", "text", "text"]
    folder.ingest(spark, str(files), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15
    rows = spark.createDataFrame([(1, "h1"), (2, "h2")], "doc_id long, sha256 string")
    store.save(rows, str(tmp_path / "store"), "docs")
    again = spark.createDataFrame([(5, "h2"), (6, "h3"), (7, "h3")], "doc_id long, sha256 string")
    assert [r.doc_id for r in store.add_new(store.current(spark, str(tmp_path / "store"), "docs"), again).collect()] == [6]
    assert store.delete_all(spark, str(tmp_path / "store"), "docs").count() == 0
    assert [r.doc_id for r in store.without_documents(rows, rows.where("doc_id = 1")).collect()] == [2]


def test_versions_of_the_store(spark, tmp_path):
    """Two writers from one version: one wins, the other is told and leaves nothing; old versions stay readable."""
    root = str(tmp_path / "store")
    rows = lambda *ids: spark.createDataFrame([(i, f"d{i}") for i in ids], "doc_id long, sha256 string")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    with pytest.raises(FileNotFoundError):
        store.current(spark, root, "docs")
    assert store.save(rows(1), root, "docs", after=0) == 1
    with pytest.raises(store.Outrun):
        store.save(rows(9), root, "docs", after=0)
    assert store.save(rows(1, 2), root, "docs", after=1) == 2 and store.save(rows(), root, "docs") == 3
    assert store.versions(spark, root, "docs") == [1, 2, 3]
    assert [ids(store.read(spark, root, "docs", n)) for n in (1, 2, 3)] == [[1], [1, 2], []] and ids(store.current(spark, root, "docs")) == []
    assert len([p for p in (tmp_path / "store" / "docs").iterdir() if p.name.startswith("v-")]) == 3
    assert not [p for p in (tmp_path / "store" / "docs" / "log").iterdir() if p.name.startswith("_")]


def test_many_writers_each_get_a_version(spark, tmp_path):
    root = str(tmp_path / "store")
    with ThreadPoolExecutor(6) as pool:
        made = list(pool.map(lambda i: store.save(spark.createDataFrame([(i,)], "doc_id long"), root, "t"), range(6)))
    assert sorted(made) == store.versions(spark, root, "t") == [1, 2, 3, 4, 5, 6]
    assert sorted(store.read(spark, root, "t", n).first().doc_id for n in made) == list(range(6))


def test_restored_equals_rebuilt(spark):
    docs = spark.createDataFrame([(i, f"Words of document {i} that are enough for an item, and more of them {i * i}.", "a") for i in range(12)], "doc_id long, text string, source string")
    corpus = relations.Corpus(spark, None, documents=docs)
    words, vecs = corpus.frame("item_words"), corpus.frame("vecs")
    seen = []

    def embed(missing):
        seen.extend(sorted(r.doc_id for r in missing.collect()))
        return relations.Corpus(spark, None, item_words=missing).frame("vecs")

    held = vecs.where("doc_id % 4 <> 1").unionByName(vecs.where("doc_id = 3").selectExpr("99 AS doc_id", "idx", "v", "norm2"))
    found = store.restored(words, held, embed)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, vecs.collect())) and seen == [1, 5, 9]
