"""Lines appended to the files of a folder, as a stream.

``follow_files`` takes each new file once and whole. Here files grow while they are read: a position
holds, for every file, up to which byte its whole lines have been taken, so a line counts once it has its
line feed, and a restart from the checkpoint goes on at the same byte. A file that was truncated or
replaced is read from its beginning again: it became shorter than its position, its first line changed,
or what lies just before the position is no longer what was read there.

Files are reached through ``pyarrow.fs``, from a path or URI that driver and executors share (local
mount, ``file:``, ``hdfs:``, ``s3:``, ``gs:``). The driver lists the folder and reads at most two short
pieces of each file that changed since the last look; the content is read in tasks, long
appends in parts of ``part_bytes``, several of them in a task where they are small.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# ship the classes below with the job, so that executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "appended_lines"
SCHEMA = "path STRING, at BIGINT, value STRING"
PART_BYTES = 32 << 20
#: how many tasks share an append of small parts
TASKS = 64
#: how much of a file's first line, and of the bytes before a position, tells files apart
MARK_BYTES = 1024
BLOCK = 1 << 20
LINE = 4096
ROWS = 10_000


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", folder):
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder


def last_line_end(file, size: int) -> int:
    """The place behind the last line feed in the first ``size`` bytes (0 without one)."""
    end = size
    while end > 0:
        begin = max(0, end - BLOCK)
        found = file.read_at(end - begin, begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        end = begin
    return 0


def _first_line(file, to: int) -> int:
    """Digest of the first line, or of its first ``MARK_BYTES`` bytes."""
    return zlib.crc32(file.read_at(min(to, MARK_BYTES), 0).split(b"\n", 1)[0])


def _before(file, to: int) -> int:
    """Digest of the bytes before ``to``."""
    begin = max(0, to - MARK_BYTES)
    return zlib.crc32(file.read_at(to - begin, begin))


@dataclass
class Part(InputPartition):
    """Lines that begin in ``[begin, end)``; ``first`` is where the file's new bytes begin."""

    path: str
    first: int
    begin: int
    end: int

    @property
    def parts(self) -> list[Part]:
        return [self] if self.begin < self.end else []


@dataclass
class Parts(InputPartition):
    """The parts that one task reads, one after the other."""

    parts: list[Part]


def _dealt(parts: list[Part]) -> list[Parts]:
    """Small parts share tasks: as many as ``TASKS``, or one for each ``PART_BYTES`` if that is more."""
    sizes = [p.end - p.begin for p in parts]
    enough = min(PART_BYTES, -(-sum(sizes) // TASKS))
    out, held = [], enough
    for part, size in zip(parts, sizes, strict=True):
        if held >= enough:
            out.append(Parts([]))
            held = 0
        out[-1].parts.append(part)
        held += size
    return out


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.pattern = options.get("pattern", ".*")
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.seen: dict[str, tuple] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """``path -> [whole lines end here, digest of the first line, digest of what lies before that end]``."""
        fs, folder = _opened(self.folder)
        out, seen = {}, {}
        for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True, recursive=True)):
            if info.type != pafs.FileType.File or info.base_name[:1] in "._" or not re.fullmatch(self.pattern, info.base_name):
                continue
            state = (info.size, info.mtime_ns)
            known = self.seen.get(info.path)
            if known is None or known[0] != state:
                try:
                    with fs.open_input_file(info.path) as file:
                        to = last_line_end(file, min(info.size, file.size()))
                        known = (state, [to, _first_line(file, to), _before(file, to)] if to else [0, 0, 0])
                except FileNotFoundError:  # gone between the listing and now
                    continue
            out[info.path] = known[1]
            seen[info.path] = known
        self.seen = seen
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        fs, _ = _opened(self.folder)
        parts: list[InputPartition] = []
        for path, (to, line, before) in sorted(end.items()):
            begin = self._goes_on_at(fs, path, start.get(path), to, line, before)
            parts += [Part(path, begin, at, min(at + self.part_bytes, to)) for at in range(begin, to, self.part_bytes)]
        return _dealt(parts) or [Parts([])]

    @staticmethod
    def _goes_on_at(fs: pafs.FileSystem, path: str, old: list | None, to: int, line: int, before: int) -> int:
        if old is None or old[0] == 0 or to < old[0] or old[1] != line:
            return 0
        if old[0] == to:
            return to if old[2] == before else 0
        try:
            with fs.open_input_file(path) as file:
                return old[0] if _before(file, old[0]) == old[2] else 0
        except FileNotFoundError:
            return to

    def read(self, partition: Part | Parts) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.folder)
        for part in partition.parts:
            with fs.open_input_file(part.path) as file:
                yield from _lines(file, part)

    def commit(self, end: dict) -> None:
        pass


def _lines(file, part: Part) -> Iterator[pa.RecordBatch]:
    """The part's lines; one that begins in it is read to its end, one that began before is left out."""
    at, rest, places, values = part.begin, b"", [], []
    if part.begin > part.first:
        # step back one byte: if it ends a line, the part begins with a new one
        at = part.begin - 1
        skip = True
    else:
        skip = False
    place = at  # where ``rest`` begins
    # the last line of a short part ends soon behind it; more is read at a time where it does not
    step = min(BLOCK, part.end - at + LINE)
    while place < part.end:
        got = file.read_at(step, at)
        step = min(BLOCK, 2 * step)
        if not got:
            break
        at += len(got)
        pieces = (rest + got).split(b"\n")
        rest = pieces.pop()
        for piece in pieces:
            if skip:
                skip = False
            elif place < part.end:
                places.append(place)
                values.append(piece.removesuffix(b"\r").decode("utf-8", "replace"))
            place += len(piece) + 1
            if len(values) >= ROWS:
                yield _batch(part.path, places, values)
                places, values = [], []
    if values:
        yield _batch(part.path, places, values)


def _batch(path: str, places: list[int], values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(values), pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.string())], names=["path", "at", "value"]
    )


class AppendedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(dict(self.options))


def follow_appended(spark: SparkSession, folder: str, pattern: str = ".*", part_bytes: int = PART_BYTES) -> DataFrame:
    """Stream of ``path, at, value``: each line appended to a file below ``folder`` whose name matches
    ``pattern``, once, with the byte it begins at.

    A line without its line feed waits. A truncated or replaced file starts over; lines it held that
    were never seen are lost with it, as they are to anyone who follows it. Files that are gone are
    forgotten, files that begin with ``.`` or ``_`` are not looked at.
    """
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format(FORMAT).option("pattern", pattern).option("part_bytes", part_bytes).load(folder)
