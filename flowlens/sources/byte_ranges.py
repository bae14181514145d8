"""Files read by byte ranges, so that no file is too large and no more of it is read than is used.

The files are listed by Spark and their ranges are dealt to tasks as rows; a task opens a file through
Arrow's file system of its URI and holds one piece of it at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 8 << 20  # bytes in a task's memory
BLOCK = 64 << 20  # bytes of a range that is hashed on its own
HEAD = 1 << 16  # bytes looked at first for a header line


def opened(path: str):
    """An input stream of a file named as Spark's file listing names it (not percent-encoded)."""
    from pyarrow.fs import FileSystem

    scheme, rest = path.split(":", 1) if ":/" in path else ("file", path)
    rest = rest if rest.startswith("//") else f"//{rest}"
    system, inner = FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{quote(rest, safe='/:@')}")
    return system.open_input_file(inner)


def _digest(path: str, start: int, length: int):
    digest = hashlib.sha256()
    with opened(path) as stream:
        stream.seek(start)
        while length:
            piece = stream.read(min(PIECE, length))
            if not piece:
                raise OSError(f"{path} is shorter than it was when it was listed.")
            digest.update(piece)
            length -= len(piece)
    return digest


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        rows["digest"] = [_digest(p, s, n).digest() for p, s, n in zip(rows["path"], rows["start"], rows["size"], strict=True)]
        yield rows


def _hashed(ranges: DataFrame, tasks: int) -> DataFrame:
    """Add the SHA-256 of each range (path, length, start, size)."""
    return ranges.repartition(tasks).mapInPandas(_digests, "path string, length bigint, start bigint, size bigint, digest binary")


def whole_digests(files: DataFrame) -> DataFrame:
    """The SHA-256 of the bytes of each file (path, length), of any size, as ``digest``. A file is one task's work."""
    ranges = files.select("path", "length", F.lit(0).cast("bigint").alias("start"), F.col("length").alias("size"))
    return _hashed(ranges, max(1, files.count())).select("path", "length", "digest")


def block_digests(files: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """Per file (path, length): number of blocks and ``root``, its blocks hashed side by side.

    ``root`` is the SHA-256 of the blocks' SHA-256 values (32 bytes each) one after the other; an
    empty file has one empty block. One file's blocks are many tasks' work.
    """
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(block_bytes).cast("bigint"))
    ranges = files.select("path", "length", F.explode(starts).alias("start"))
    ranges = ranges.withColumn("size", F.least(F.col("length") - F.col("start"), F.lit(block_bytes)))
    blocks = files.agg(F.sum(F.ceil(F.col("length") / block_bytes))).first()[0] or 1
    tasks = min(int(blocks), 100_000)
    return _hashed(ranges, max(1, tasks)).groupBy("path", "length").agg(
        F.count("*").alias("blocks"), F.array_sort(F.collect_list(F.struct("start", "digest"))).alias("_list")).select(
        "path", "length", "blocks", F.sha2(F.aggregate("_list", F.lit(b""), lambda all_, b: F.concat(all_, b["digest"])), 256).alias("root"))


def first_line(path: str) -> bytes:
    """The first line of a file that is not blank, without its line end."""
    with opened(path) as stream:
        held, size = b"", HEAD
        while True:
            piece = stream.read(size)
            held += piece
            lines = held.splitlines(keepends=True)
            whole = lines if not piece else lines[:-1]
            line = next((x for x in whole if x.strip()), None)
            if line is not None or not piece:
                return (line or b"").rstrip(b"\r\n")
            size *= 2


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def line(path: str) -> bytes | None:
        try:
            return first_line(path)
        except (OSError, ImportError, ValueError, NotImplementedError):  # no such file system in this Python: the caller scans
            return None

    for rows in batches:
        yield pd.DataFrame({"path": rows["path"], "line": [line(p) for p in rows["path"]]})


def first_lines(files: DataFrame, tasks: int) -> DataFrame:
    """(path, line): each file's first line, null where this Python cannot open the file's system."""
    return files.select("path").repartition(tasks).mapInPandas(_first_lines, "path string, line binary")
