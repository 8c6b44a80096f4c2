"""The stored corpus: Parquet tables under one folder, with a log of numbered versions.

A version's files are written aside first. It exists once its entry stands in the table's log: an entry of the next number,
put there by a rename that fails where one is, so of two writers who began from the same version one wins and the other
is told. Readers take the entry of the largest number, or of any earlier one. The rename is atomic on HDFS and on local
disks; on object stores without such a rename one writer at a time is needed.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Outrun(RuntimeError):
    """Another writer has published a version since the one that this writer began from."""


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """The numbers of a table's versions, in order; none if it was never saved."""
    files, path = _place(spark, f"{root}/{name}/log")
    if not files.exists(path):
        return []
    names = [f.getPath().getName() for f in files.listStatus(path)]
    return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def _publish(spark: SparkSession, root: str, name: str, number: int, entry: dict) -> None:
    files, log = _place(spark, f"{root}/{name}/log")
    files.mkdirs(log)
    _, aside = _place(spark, f"{root}/{name}/log/_{uuid.uuid4().hex}")
    out = files.create(aside, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = spark._jvm.java.lang.Enum.valueOf(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), "NONE")
    to = hadoop.Path(f"{root}/{name}/log/{number:020d}.json")
    try:
        hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(aside, to, options)
    except Exception as fault:
        files.delete(aside, False)
        if files.exists(to):
            raise Outrun(f"version {number} of {name} is taken") from fault
        raise


def save(df: DataFrame, root: str, name: str, after: int | None = None) -> int:
    """Writes a new version of a table and makes it the current one. Returns its number.

    after is the number of the version that df was made of (0: none yet); Outrun if another one has come since. Without
    it the version follows whatever is current.
    """
    spark = df.sparkSession
    folder = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}/{folder}")
    while True:
        number = (versions(spark, root, name) or [0])[-1] + 1 if after is None else after + 1
        try:
            _publish(spark, root, name, number, {"folder": folder, "columns": df.columns})
            return number
        except Outrun:
            if after is not None:
                remove(spark, f"{root}/{name}/{folder}")
                raise


def read(spark: SparkSession, root: str, name: str, number: int) -> DataFrame:
    """A version of a table by its number."""
    entry = spark.read.text(f"{root}/{name}/log/{number:020d}.json", wholetext=True).first()["value"]
    return spark.read.parquet(f"{root}/{name}/{json.loads(entry)['folder']}")


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current version. FileNotFoundError if the table was never saved."""
    known = versions(spark, root, name)
    if not known:
        raise FileNotFoundError(f"{root}/{name} has no version")
    return read(spark, root, name, known[-1])


def restored(items: DataFrame, vectors: DataFrame, embed) -> DataFrame:
    """Vectors of all items: the stored ones of items that are there, and embed(items) for those that have none.

    items(doc_id, idx, ...) and vectors(doc_id, idx, ...), one row each for a place; embed gives the columns of vectors.
    """
    place = ["doc_id", "idx"]
    kept = vectors.join(items.select(*place), place, "left_semi")
    return kept.unionByName(embed(items.join(vectors.select(*place), place, "left_anti")).select(*vectors.columns))


def add_new(current_docs: DataFrame, arriving: DataFrame, digest: str = "sha256") -> DataFrame:
    """Arriving rows whose digest is neither stored nor repeated among them (the smallest doc_id stays)."""
    first = arriving.groupBy(digest).agg(F.min("doc_id").alias("doc_id"))
    once = arriving.join(first, [digest, "doc_id"], "left_semi")
    return once.join(current_docs, digest, "left_anti")


def without_documents(df: DataFrame, gone: DataFrame) -> DataFrame:
    """A table without the rows of the documents in gone(doc_id)."""
    return df.join(gone, "doc_id", "left_anti")


def working_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or, in one machine only, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="docquarry-store-")
    return f"{named}/relations-{uuid.uuid4().hex}"


def delete_all(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Makes an empty table the current version, with the columns it had; older versions stay readable by their number."""
    save(current(spark, root, name).limit(0), root, name)
    return current(spark, root, name)


def _place(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def state(spark: SparkSession, folder: str) -> str:
    """A digest of the paths, sizes and times of all files under a folder; it changes when one is replaced."""
    files, path = _place(spark, folder)
    if not files.exists(path):
        return ""
    found, listed = [], files.listFiles(path, True)
    while listed.hasNext():
        one = listed.next()
        found.append(f"{one.getPath()} {one.getLen()} {one.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of ours with all that it holds; one that isn't there is no error."""
    files, path = _place(spark, folder)
    files.delete(path, True)
