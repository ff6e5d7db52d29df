"""Named files as a Spark data source: written with a commit protocol, read in parallel.

``df.write.format("blobs").save(folder)`` takes (file string, content binary). A task attempt writes into a staging folder
of its own; only when all tasks are done does the driver move each task's folder into place, one move a task, and
drop the staging folder. A run is open while its mark is there: attempts that outlive a failed run see that it is closed and
take their files with them, and what a killed process could not take goes with the next run. ``spark.read.format("blobs").load(folder)`` gives (file, length, content), a task for some ``filesPerTask`` files.
Folders are URIs of a file system that all executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from rasterweave.sources.session import ship

STAGING = "_staging"


def file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


@dataclass
class Files(InputPartition):
    """Files of one read task: paths and what they are called."""

    paths: list[tuple[str, str, int]]

    def __init__(self, paths):
        self.paths = paths


@dataclass
class Written(WriterCommitMessage):
    staged: str
    name: str
    files: int


class BlobReader(DataSourceReader):
    def __init__(self, folder: str, per_task: int):
        self.folder, self.per_task = folder, per_task

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = file_system(self.folder)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=False))
        inside = lambda path: path[len(root) :].strip("/").split("/")
        files = sorted((f.base_name, f.path, f.size) for f in found if f.type == fs.FileType.File and not any(p[0] in "._" for p in inside(f.path)))
        return [Files(files[k : k + self.per_task]) for k in range(0, len(files), self.per_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = file_system(self.folder)
        for name, path, size in partition.paths:
            with system.open_input_file(path) as f:
                yield name, size, f.read()


class BlobWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.run = folder, overwrite, uuid.uuid4().hex
        system, root = file_system(folder)
        system.create_dir(f"{root}/{STAGING}", recursive=True)
        with system.open_output_stream(self.mark(root)):
            pass

    def mark(self, root: str) -> str:
        return f"{root}/{STAGING}/{self.run}.open"

    def is_open(self, system, root: str) -> bool:
        from pyarrow import fs

        return system.get_file_info(self.mark(root)).type == fs.FileType.File

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = file_system(self.folder)
        name = f"part-{task.partitionId():05d}-{self.run}"
        staged = f"{root}/{STAGING}/{self.run}/{name}-{task.taskAttemptId()}"
        system.create_dir(staged, recursive=True)
        files, done = 0, False
        try:
            for row in rows:
                with system.open_output_stream(f"{staged}/{row['file']}") as out:
                    out.write(row["content"])
                files += 1
            done = self.is_open(system, root)
        finally:
            if not done:
                system.delete_dir(staged)
        if not done:
            raise RuntimeError("the run was given up")
        return Written(staged, name, files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = file_system(self.folder)
        before = [f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("part-")]
        for m in messages:
            if m is not None and m.files:
                system.move(m.staged, f"{root}/{m.name}")
        for path in before if self.overwrite else []:
            system.delete_dir(path)
        self.close()

    def abort(self, messages: list[Written | None]) -> None:
        self.close()

    def close(self) -> None:
        """Take the mark away, and what no open run stages."""
        from pyarrow import fs

        system, root = file_system(self.folder)
        if self.is_open(system, root):
            system.delete_file(self.mark(root))
        staging = system.get_file_info(fs.FileSelector(f"{root}/{STAGING}", allow_not_found=True))
        open_ = {f.base_name.removesuffix(".open") for f in staging if f.type == fs.FileType.File}
        for f in staging:
            if f.type == fs.FileType.Directory and f.base_name not in open_:
                system.delete_dir(f.path)


class Blobs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blobs"

    def schema(self) -> str:
        return "file string, length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return BlobReader(self.options["path"], int(self.options.get("filesPerTask", 64)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return BlobWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship(spark)
    spark.dataSource.register(Blobs)


def write_blobs(files, folder: str, mode: str = "append") -> None:
    register(files.sparkSession)
    files.select("file", "content").write.format("blobs").mode(mode).save(folder)


def read_blobs(spark: SparkSession, folder: str, per_task: int = 64):
    register(spark)
    return spark.read.format("blobs").option("filesPerTask", per_task).load(folder)
