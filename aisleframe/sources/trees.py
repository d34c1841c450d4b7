"""Writing one file per row into class folders, as a Spark data source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    files: int


class _TreeWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, rows: Iterator[Row]) -> Written:
        """A file's name is its row's key, so a task that runs again writes the same files again."""
        from pyarrow import fs

        uri = self.path if "://" in self.path else f"file://{self.path.removeprefix('file:')}"
        store, root = fs.FileSystem.from_uri(uri)
        made, n = set(), 0
        for row in rows:
            place = f"{root}/{row.key}"
            folder = place.rpartition("/")[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            with store.open_output_stream(place) as out:
                out.write(row.content or b"")
            n += 1
        return Written(n)


class FileTree(DataSource):
    """``df(key string, content binary).write.format("filetree").mode("append").save(root)``."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def writer(self, schema, overwrite: bool) -> _TreeWriter:
        return _TreeWriter(self.options["path"])


def write_tree(files: DataFrame, root: str) -> None:
    """Puts ``content`` of every row at ``key`` (a relative path) below ``root``."""
    files.sparkSession.dataSource.register(FileTree)
    files.select("key", "content").write.format("filetree").mode("append").save(root)
