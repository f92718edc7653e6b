"""A sink of many small documents: tasks write files aside and rename each whole one into place."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .files import stem_of

#: Name of the data source.
FORMAT = "cadenza_documents"


@dataclass
class Written(WriterCommitMessage):
    """How many documents a task wrote."""

    n: int


class Writer(DataSourceArrowWriter):
    """A task stages its documents in a folder that readers pass over, and renames them once all are written.

    A document is there whole or not at all. A task that is lost before has left nothing to see, one that is lost while it renames has left
    whole documents, which the task that takes its place writes again. What is staged goes with the commit
    or the abort; the driver handles folders of attempts, not files.
    """

    def __init__(self, path: str):
        self.path, self.load = path if "://" in path or path.startswith("file:") else f"file://{path}", uuid.uuid4().hex

    def place(self) -> tuple[fs.FileSystem, str, str]:
        store, root = fs.FileSystem.from_uri(self.path)
        return store, root, f"{root}/_staged-{self.load}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root, staged = self.place()
        folder, names = f"{staged}/{uuid.uuid4().hex}", []
        for batch in iterator:
            for stem, value in zip(batch.column("stem"), batch.column("value")):
                if not names:
                    store.create_dir(folder, recursive=True)
                names.append(f"{stem.as_py()}.json")
                with store.open_output_stream(f"{folder}/{names[-1]}") as out:
                    out.write(value.as_py().encode())
        for name in names:
            store.move(f"{folder}/{name}", f"{root}/{name}")
        return Written(len(names))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _, staged = self.place()
        if store.get_file_info(staged).type == fs.FileType.Directory:
            store.delete_dir(staged)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.commit(messages)


class Documents(DataSource):
    """Rows ``stem, value``: a JSON file each."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "stem string, value string"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def save(rows: DataFrame, path: str) -> int:
    """Write each of the rows ``stem, value`` to its file in ``path``; returns how many."""
    rows.sparkSession.dataSource.register(Documents)
    seen = Observation()
    rows.select("stem", "value").observe(seen, F.count(F.lit(1)).alias("n")).write.format(FORMAT).mode("append").save(path)
    return seen.get["n"]


def stems(spark: SparkSession, path: str) -> DataFrame:
    """``stem`` of the documents of ``path``, without reading them; none if there is no such folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "stem string")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select(stem_of(F.col("path")).alias("stem"))
