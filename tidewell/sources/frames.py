"""Frame files as a Spark data source: one JSON object a line, with its byte offset.

    spark.dataSource.register(FrameSource)
    spark.read.format("hk_frames").load("/data/hk/*.jsonl")
"""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .hk import FRAMES


def read_at(path: str, offset: int) -> dict:
    """The frame that begins at a byte offset."""
    with open(path, "rb") as f:
        f.seek(offset)
        return json.loads(f.readline())


class _File(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class FrameSource(DataSource):
    """Splits files into byte ranges; a range begins with the first whole line in it.

    Broken lines are left out, or an error with the option mode=FAILFAST.
    """

    @classmethod
    def name(cls) -> str:
        return "hk_frames"

    def schema(self) -> StructType:
        return FRAMES

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(self.options, schema)


class FrameReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.names = schema.fieldNames()

    def partitions(self):
        paths = sorted(p for p in glob.glob(self.path) if os.path.isfile(p)) if not os.path.isdir(self.path) else sorted(os.path.join(d, f) for d, _, fs in os.walk(self.path) for f in fs if not f.startswith(("_", ".")))
        return [_File(p, a, min(a + self.split, os.path.getsize(p))) for p in paths for a in range(0, os.path.getsize(p), self.split)]

    def read(self, partition: _File):
        with open(partition.path, "rb") as f:
            if partition.first:
                f.seek(partition.first - 1)
                f.readline()  # belongs to the range before
            while (at := f.tell()) < partition.last:
                line = f.readline()
                try:
                    frame = json.loads(line)
                except ValueError:
                    if self.strict:
                        raise
                    continue
                frame |= {"filename": partition.path, "byte_offset": at}
                frame["providers"] = [(p.get("prov_id"), p.get("description")) for p in frame.get("providers") or []]
                frame["blocks"] = [(b.get("block_name"), [float(t) for t in b.get("t") or []], {k: [None if x is None else str(x) for x in v] for k, v in (b.get("fields") or {}).items()}) for b in frame.get("blocks") or []]
                yield tuple(frame.get(n) for n in self.names)
