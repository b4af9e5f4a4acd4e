"""Documents as a transactional sink: ``write.format("documents").option("path", folder)``.

Rows of name and text become one file each. A task writes its files under a folder of
its attempt within the job's own folder beside the target (``_writing-<job>``), so what a
lost, repeated or speculative task leaves is in nobody's way. Once all tasks are done the
driver gives each file its name, one atomic step a file, from the folders of the attempts
that counted; then, and when the job fails, the job's folder goes. Commit messages hold
one path a task, no names: the driver reads them folder by folder.

Options: ``path``; ``exclusive`` ("false"): "true" leaves files that are there already
as they are, also one that another job wrote meanwhile.

Edge cases: no rows write nothing (and no folder). A null text is empty. A null or empty
name, one with a slash, one that starts with the job folders' mark, and a name that a task
has written before, fail the job, which then writes nothing. Of the same name in different
tasks one counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lectern.sources.shared import workers_see_package
from lectern.sources.stores import Store, open_store, unique

WRITING = "_writing-"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        if set(schema.names) != {"name", "text"}:
            raise ValueError("documents are rows of name and text")
        return DocumentWriter(self.options, schema.names)


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, columns: list[str]):
        if not options.get("path"):
            raise ValueError("documents are written to a path")
        self.path, self.exclusive = options["path"], options.get("exclusive", "false").lower() == "true"
        self.job, self.columns = WRITING + unique(), columns

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, context, seen = open_store(self.path), TaskContext.get(), set()
        folder = store.at(f"{self.job}/{context.partitionId()}-{context.taskAttemptId()}")
        for batch in iterator:
            columns = dict(zip(self.columns, batch.columns))
            for name, text in zip(columns["name"], columns["text"]):
                name = name.as_py()
                if not name or "/" in name or name in (".", "..") or name.startswith(WRITING):
                    raise ValueError(f"{name!r} names no file")
                if name in seen:
                    raise ValueError(f"{name!r} is written twice")
                seen.add(name)
                store.write(f"{folder}/{name}", (text.as_py() or "").encode())
        return Written(folder, len(seen))

    def commit(self, messages: list[Written | None]) -> None:
        store = open_store(self.path)
        for message in messages:
            named = 0
            # a folder that is read while files leave it may pass over some: it is read again until all are named
            while message and named < message.files:
                before = named
                for name, _ in store.each(message.folder):
                    if not store.move(f"{message.folder}/{name}", store.at(name), self.exclusive):
                        store.remove(f"{message.folder}/{name}")
                    named += 1
                if named == before:
                    raise OSError(f"{message.folder} holds {named} of {message.files} files")
        self._leave(store)

    def abort(self, messages: list[Written | None]) -> None:
        self._leave(open_store(self.path))

    def _leave(self, store: Store) -> None:
        """The job's folder goes, one task's files after another's."""
        for folder in store.folders(store.at(self.job)):
            store.drop(folder)
        store.drop(store.at(self.job))


def write_documents(documents: DataFrame, folder: str, exclusive: bool = False) -> None:
    """Writes documents(name, text) to a folder of any file system that tasks reach; all of them or, where the job fails, none."""
    spark = documents.sparkSession
    workers_see_package(spark)
    open_store(folder)  # refuses a scheme that tasks do not reach before any of them runs
    spark.dataSource.register(Documents)
    documents.select("name", "text").write.format("documents").option("path", folder).option("exclusive", str(exclusive).lower()).mode("append").save()
