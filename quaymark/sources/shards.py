"""A sharded log as a streaming source: shards that split and merge, positions per shard, parents before children.

A shard is a folder of segment files, named by the sequence number of their first record
(`000000000000.jsonl`, one JSON record a line), beside a `shard.json` with its parents and, once
closed, its end. Old segments may be gone. The source's offset says for each shard which record
comes next; Spark keeps it in the query's checkpoint, so a restart goes on where the last finished
batch ended. Each batch lists the shards anew. A position that is no longer kept falls back to the
initial position: the oldest record kept, or the end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "shard string, sequence bigint, data string"
#: Records of a shard that one batch takes at most, unless an option says otherwise.
MOST = 100_000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class _Slice(InputPartition):
    def __init__(self, path: str, shard: str, start: int, end: int) -> None:
        self.path, self.shard, self.start, self.end = path, shard, start, end


class ShardReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.latest = {"latest": True, "earliest": False}[options.get("initial", "earliest")]
        self.most = int(options.get("maxrecordspershard", MOST))
        self.at: dict[str, int] = {}

    # -- what is there --

    def _names(self, folder: str, kind: fs.FileType) -> list[str]:
        where, path = _open(folder)
        if where.get_file_info(path).type != fs.FileType.Directory:
            return []
        return sorted(i.base_name for i in where.get_file_info(fs.FileSelector(path)) if i.type == kind)

    def _text(self, path: str) -> str:
        where, path = _open(path)
        with where.open_input_stream(path) as f:
            return f.read().decode()

    def _segments(self, shard: str) -> list[int]:
        return [int(n.removesuffix(".jsonl")) for n in self._names(f"{self.path}/{shard}", fs.FileType.File) if n.endswith(".jsonl")]

    def _span(self, shard: str) -> tuple[int, int]:
        """(oldest record kept, one past the newest)."""
        starts = self._segments(shard)
        if not starts:
            end = self._about(shard).get("end") or 0
            return end, end
        last = self._text(f"{self.path}/{shard}/{starts[-1]:012d}.jsonl")
        return starts[0], starts[-1] + sum(1 for line in last.splitlines() if line.strip())

    def _about(self, shard: str) -> dict:
        names = self._names(f"{self.path}/{shard}", fs.FileType.File)
        return json.loads(self._text(f"{self.path}/{shard}/shard.json")) if "shard.json" in names else {}

    # -- Spark's side --

    def initialOffset(self) -> dict:  # noqa: N802
        if not self.latest:
            return {}
        return {s: self._span(s)[1] for s in self._names(self.path, fs.FileType.Directory)}

    def latestOffset(self, start: dict | None = None, limit: object = None) -> dict:  # noqa: N802
        at = dict(start if start is not None else self.at)
        shards = self._names(self.path, fs.FileType.Directory)
        about, span = {s: self._about(s) for s in shards}, {s: self._span(s) for s in shards}

        def finished(s: str) -> bool:
            return s not in about or ("end" in about[s] and at.get(s, 0) >= about[s]["end"])

        out = dict(at)
        for s in shards:
            if all(finished(p) for p in about[s].get("parents", ())):
                out[s] = min(span[s][1], self._from(s, at, span[s]) + self.most)
        self.at = out
        return out

    def _from(self, shard: str, at: dict, span: tuple[int, int]) -> int:
        """Where reading goes on: a position that isn't kept any more, or lies past the end, is the initial one."""
        n = at.get(shard, span[0])
        return n if span[0] <= n <= span[1] else span[1] if self.latest else span[0]

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = dict(end)
        parts = [_Slice(self.path, s, self._from(s, start, self._span(s)), z) for s, z in sorted(end.items()) if start.get(s) != z]
        return [p for p in parts if p.start < p.end]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        starts = self._segments(partition.shard)
        for i, first in enumerate(starts):
            if first >= partition.end or (i + 1 < len(starts) and starts[i + 1] <= partition.start):
                continue
            where, path = _open(f"{partition.path}/{partition.shard}/{first:012d}.jsonl")
            n = first
            with where.open_input_stream(path) as f:
                for line in f.read().decode().splitlines():
                    if line.strip():
                        if partition.start <= n < partition.end:
                            yield partition.shard, n, line
                        n += 1

    def commit(self, end: dict) -> None:
        """Nothing is kept here: the query's checkpoint has the positions."""


class ShardSource(DataSource):
    """spark.dataSource.register(ShardSource), then spark.readStream.format("shards").option("path", ...). Options: initial (earliest or latest), maxRecordsPerShard."""

    @classmethod
    def name(cls) -> str:
        return "shards"

    def schema(self) -> StructType | str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return ShardReader(dict(self.options))
