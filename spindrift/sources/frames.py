"""Frame files as a data source: spark.read.format("spindrift_frames"), and the same for writing.

A file holds frames one after another. Reading gives (file, nth, schema_id, flags, payload); each
file is a partition. Writing takes a binary column `payload` and writes a file for each task, which
appears only when its task has ended.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import frames

SUFFIX = ".spf"


@dataclass
class _File(InputPartition):
    path: str


class FrameReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        found = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.endswith(SUFFIX))
        return [_File(f) for f in found] or [_File("")]

    def read(self, partition):
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            data = f.read()
        for nth, frame in enumerate(frames.read_all(data)):
            yield os.path.basename(partition.path), nth, frame.schema_id, frame.flags, frame.payload


@dataclass
class _Written(WriterCommitMessage):
    path: str


class FrameWriter(DataSourceWriter):
    def __init__(self, path: str, column: int, options: frames.Options):
        self.path, self.column, self.options = path, column, options

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f".{uuid.uuid4().hex}")
        with open(name, "wb") as f:
            for row in iterator:
                if row[self.column] is not None:
                    f.write(frames.write(bytes(row[self.column]), options=self.options))
        return _Written(name)

    def commit(self, messages):
        for i, m in enumerate(m for m in messages if m):
            os.replace(m.path, os.path.join(self.path, f"part-{i:05}-{uuid.uuid4().hex[:8]}{SUFFIX}"))

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class FrameSource(DataSource):
    @classmethod
    def name(cls):
        return "spindrift_frames"

    def schema(self):
        return "file string, nth int, schema_id bigint, flags int, payload binary"

    def reader(self, schema):
        return FrameReader(self.options["path"])

    def writer(self, schema, overwrite):
        on = lambda k: self.options.get(k, "true").lower() == "true"
        return FrameWriter(self.options["path"], schema.fieldNames().index("payload"), frames.Options(on("lz"), on("entropy")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)
