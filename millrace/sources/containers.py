"""Containers as a Spark data source: `spark.read.format("millrace_container").load(folder)` and `df.write`.

    register(spark)
    spark.read.format("millrace_container").load("file:///data/containers")                 # image_id, container
    coded.write.format("millrace_container").mode("append").save("file:///data/containers")

Reading lists the folder once and deals files into partitions of about `partition_bytes`; writing leaves a file per
row, moved to its place by the task that wrote it, so a task that runs again leaves the same file.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

ENDING = ".mrc"
PARTITION_BYTES = 64 << 20


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class ContainerReader(DataSourceReader):
    def __init__(self, folder: str, partition_bytes: int) -> None:
        self.folder, self.partition_bytes = folder, partition_bytes

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _opened(self.folder)
        out, size = [], 0
        for f in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda f: f.path):
            if not f.is_file or not f.base_name.endswith(ENDING) or f.base_name.startswith("."):
                continue
            if not out or size >= self.partition_bytes:
                out.append([])
                size = 0
            out[-1].append(f.path)
            size += f.size
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _opened(self.folder)
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                yield path.rsplit("/", 1)[-1][: -len(ENDING)], f.read()


class ContainerWriter(DataSourceWriter):
    def __init__(self, folder: str, columns: list[str]) -> None:
        self.folder, self.columns = folder, columns

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import uuid

        system, root = _opened(self.folder)
        system.create_dir(root, recursive=True)
        name_at, data_at = self.columns.index("image_id"), self.columns.index("container")
        for row in rows:
            name, data = row[name_at], row[data_at]
            if not name or "/" in name or data is None:
                raise ValueError(f"{name!r} is no file name, or has no container")
            before = f"{root}/.{uuid.uuid4().hex}"
            with system.open_output_stream(before) as f:
                f.write(bytes(data))
            system.move(before, f"{root}/{name}{ENDING}")
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        """The tasks have moved their files already."""

    def abort(self, messages: list) -> None:
        """Whole files of tasks that ended stay; another run writes them over."""


class ContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_container"

    def schema(self) -> str:
        return "image_id string, container binary"

    def reader(self, schema) -> ContainerReader:
        return ContainerReader(self.options["path"], int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> ContainerWriter:
        if overwrite:
            raise ValueError("containers are added to a folder: use mode append")
        return ContainerWriter(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContainerSource)
