"""File sinks that a failed or repeated task can't spoil, as Python data sources: final names only ever hold whole files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: The folder of what tasks write before it gets its final name.
ATTEMPTS = "_attempts"


@dataclass
class Written(WriterCommitMessage):
    """What one attempt of a task has written, and where."""

    path: str
    rows: int


def _open(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path)


def _move(fs, source: str, target: str) -> None:
    """A rename that replaces; file systems that refuse to replace are asked to delete first."""
    fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
    try:
        fs.move(source, target)
    except OSError:
        fs.delete_file(target)
        fs.move(source, target)


def _clear(fs, folder: str) -> None:
    import pyarrow.fs as pafs

    if fs.get_file_info(folder).type == pafs.FileType.Directory:
        fs.delete_dir(folder)


class _ArrayWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def _attempts(self, target: str) -> str:
        folder, name = target.rsplit("/", 1)
        return f"{folder}/{ATTEMPTS}-{name}"

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, target = _open(self.path)
        folder, n = self._attempts(target), 0
        fs.create_dir(folder, recursive=True)
        own = f"{folder}/{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as out:
            for row in iterator:
                out.write((",\n" if n else "[\n").encode() + row[0].encode())
                n += 1
            out.write(b"\n]\n" if n else b"[]\n")
        return Written(own, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, target = _open(self.path)
        done = [m for m in messages if m is not None]
        whole = [m for m in done if m.rows] or done[:1]
        if len(whole) > 1:
            self.abort(messages)
            raise ValueError("an array is one file: give it one partition")
        _move(fs, (whole[0] if whole else self.write(iter(()))).path, target)
        _clear(fs, self._attempts(target))

    def abort(self, messages: list[Written | None]) -> None:
        fs, target = _open(self.path)
        _clear(fs, self._attempts(target))


class JsonArraySink(DataSource):
    """One JSON array in the file ``path``, of rows whose only column is an element's JSON, from one partition.

    The task writes to a name of its own attempt, and the driver gives the committed attempt's file its name in the end.
    """

    @classmethod
    def name(cls) -> str:
        return "kgloom_json_array"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _ArrayWriter(self.options["path"])


class _RecordWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = _open(self.path)
        own, names = f"{root}/{ATTEMPTS}/{uuid.uuid4().hex}", []
        for i, (folder, name, body) in enumerate(iterator):
            fs.create_dir(own, recursive=True)
            with fs.open_output_stream(f"{own}/{i}") as out:
                out.write(body.encode() if isinstance(body, str) else bytes(body))
            names.append(f"{root}/{folder}/{name}")
        # All is written: a task that fails before has named nothing, one that is repeated names the same contents again.
        for i, target in enumerate(names):
            _move(fs, f"{own}/{i}", target)
        return Written(own, len(names))

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        _clear(fs, f"{root}/{ATTEMPTS}")
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(f"{sum(m.rows for m in messages if m is not None)}\n".encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        _clear(fs, f"{root}/{ATTEMPTS}")


class RecordSink(DataSource):
    """Rows ``(folder, name, body)`` as files of those names below ``path``; ``_SUCCESS`` holds their number once all are there.

    A task writes its files below a folder of its own attempt and renames them when it has written all; there may be too many files for the driver to rename.
    """

    @classmethod
    def name(cls) -> str:
        return "kgloom_records"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _RecordWriter(self.options["path"])


def write_json_array(bodies: DataFrame, path: str) -> None:
    """The texts of the only column of ``bodies``, in their order, as one JSON array in the file ``path``."""
    bodies.sparkSession.dataSource.register(JsonArraySink)
    bodies.coalesce(1).write.format(JsonArraySink.name()).mode("append").save(path)


def write_records(records: DataFrame, path: str) -> None:
    """``(folder, name, body)`` to files of those names, by tasks and through any file system that Arrow knows."""
    records.sparkSession.dataSource.register(RecordSink)
    records.select("folder", "name", "body").write.format(RecordSink.name()).mode("append").save(path)
