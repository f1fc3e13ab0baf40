"""A streaming source that follows growing JSON-lines files.

The built-in file source reads each path once. This one keeps, per file, the
identity, a generation and the number of bytes read. Only whole lines are read;
a torn tail waits. A file that shrank or was replaced starts again at 0 under the
next generation, so that readers can discard what they had of it. Each file's
new bytes are one partition, cut into ranges of ``maxBytes``. Only files whose
size has changed are opened to find their last whole line.

Spark asks for the latest offset without telling where a query has stopped. A
restarted reader therefore takes identities and generations from the offset log
of the query's own checkpoint, given as ``checkpoint``. A path that vanishes keeps
its entry, so that it goes on under the next generation if it comes back. Paths
are local to the machine of the driver and the executors, as logs on a shared
mount are.

    spark.dataSource.register(TailSource)
    spark.readStream.format("tail_jsonl").option("path", "/logs/**/*.jsonl").option("checkpoint", c).load()
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, generation int, at_byte long, line string"
_BLOCK = 1 << 16


class Range(InputPartition):
    def __init__(self, path: str, generation: int, start: int, end: int):
        self.path, self.generation, self.start, self.end = path, generation, start, end


def whole_bytes(path: str, size: int, floor: int) -> int:
    """End of the last whole line among the first ``size`` bytes, at least ``floor``."""
    with open(path, "rb") as f:
        end = size
        while end > floor:
            start = max(floor, end - _BLOCK)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return floor


def logged_offset(checkpoint: str | None) -> dict:
    """The newest offset of this source in the offset log of a query's checkpoint; empty if there is none."""
    if not checkpoint:
        return {}
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(checkpoint if "://" in checkpoint or checkpoint.startswith("file:") else os.path.abspath(checkpoint))
    found = system.get_file_info(fs.FileSelector(f"{root}/offsets", allow_not_found=True))
    numbered = sorted((f for f in found if f.base_name.isdigit()), key=lambda f: -int(f.base_name))
    for info in numbered:
        with system.open_input_stream(info.path) as f:
            lines = f.read().decode().split("\n")
        for line in lines[2:]:  # after the version and the query's own figures, one line a source
            try:
                offset = json.loads(line)
            except ValueError:
                continue
            if isinstance(offset, dict) and all(isinstance(x, list) and len(x) == 3 for x in offset.values()):
                return offset
    return {}


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.pattern = options["path"]
        self.max_bytes = int(options.get("maxBytes", 64 << 20))
        self.seen: dict = logged_offset(options.get("checkpoint"))
        self.sizes: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        now = dict(self.seen)
        for path in sorted(glob.glob(self.pattern, recursive=True)):
            try:
                s = os.stat(path)
                inode, generation, done = now.get(path, [s.st_ino, 0, 0])
                if inode != s.st_ino or s.st_size < done:
                    inode, generation, done = s.st_ino, generation + 1, 0
                elif path in now and self.sizes.get(path) == s.st_size:
                    continue
                now[path] = [inode, generation, whole_bytes(path, s.st_size, done)]
                self.sizes[path] = s.st_size
            except FileNotFoundError:
                continue
        self.seen = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, (inode, generation, upto) in end.items():
            was = start.get(path)
            at = was[2] if was and was[0] == inode and was[1] == generation else 0
            while at < upto:
                # a range ends behind a line, or takes one more whole line
                stop = min(upto, at + self.max_bytes)
                if stop < upto:
                    stop = max(whole_bytes(path, stop, at), at)
                    stop = stop if stop > at else upto
                out.append(Range(path, generation, at, stop))
                at = stop
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        try:
            with open(partition.path, "rb") as f:
                f.seek(partition.start)
                data = f.read(partition.end - partition.start)
        except FileNotFoundError:
            return
        at = partition.start
        for line in data.split(b"\n")[:-1]:
            if line:
                yield partition.path, partition.generation, at, line.decode("utf-8", "replace")
            at += len(line) + 1


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail_jsonl"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        return TailReader(self.options)
