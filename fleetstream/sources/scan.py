"""Many files, listed and read by the tasks.

Spark's file sources keep every listed file on the driver: its status, its
place in the index, its part of a task.  That is a kilobyte or two for each, so
some millions of small files need gigabytes there.  Here the glob is expanded
level by level in tasks, which also list the folders that match; the listing is
a table, dealt over tasks that read the files.  The driver holds a pattern and a
number of files.

``files`` and ``logs`` take this way from ``FEW_FILES`` files on; below, Spark's
reader lists them.  Both give the same rows: hidden and empty files are passed
over, folders are listed and not what is below them, text is what Spark's text
reader makes of it (compressed by extension, large files in several tasks).
Stores: local or mounted folders, and those that pyarrow knows by scheme.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cluster_cores, materialize

#: From so many files on the tasks list and read them.
FEW_FILES = 20_000
#: Files that one task reads, about, and bytes that it hands on at a time.
TASK_FILES, CHUNK_BYTES = 2_000, 8 << 20
STORES = ("hdfs", "s3", "gs", "gcs")
_SPECIAL = "*?[{"


def _local(path: str) -> bool:
    return "://" not in path.replace("file://", "", 1) and (path.startswith("/") or path.startswith("file:"))


def reachable(glob: str) -> bool:
    """Whether Python workers can list what the glob names."""
    return "\\" not in glob and (_local(glob) or glob.split("://", 1)[0] in STORES)


def name_pattern(glob: str) -> str:
    """Regular expression of one part of a Hadoop glob: ``*``, ``?``, ``[a-z]``,
    ``[^a]``, ``{a,b}``."""
    import re
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2:]:
            end = glob.index("]", i + 2)
            body = glob[i + 1:end]
            out += "[" + ("^" + body[1:] if body[0] in "^!" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return out


class Store:
    """Folders and files of one store, by URI; used in tasks."""

    def __init__(self, uri: str):
        self.local, self.fs = _local(uri), None
        if not self.local:
            from pyarrow import fs
            self.fs, _ = fs.FileSystem.from_uri(uri)
            self.top = uri[:uri.index("/", uri.index("://") + 3)] if uri.startswith("hdfs") else uri[:uri.index("://") + 3]

    def path(self, uri: str) -> str:
        """What the store itself calls a file."""
        return "/" + uri.split(":", 1)[1].lstrip("/") if self.local else uri[len(self.top):]

    def children(self, uri: str) -> Iterator[tuple[str, bool, int, int]]:
        """(name, is it a folder, modification time in ms, length); nothing where no folder is."""
        import os
        if self.local:
            try:
                found = os.scandir(self.path(uri))
            except (FileNotFoundError, NotADirectoryError):
                return
            with found:
                for e in found:
                    try:
                        at = e.stat()
                        yield e.name, e.is_dir(), at.st_mtime_ns // 1_000_000, at.st_size
                    except FileNotFoundError:  # gone meanwhile, or a link to nothing
                        continue
            return
        from pyarrow import fs
        for f in self.fs.get_file_info(fs.FileSelector(self.path(uri), allow_not_found=True)):
            yield f.base_name, f.type == fs.FileType.Directory, (f.mtime_ns or 0) // 1_000_000, f.size or 0

    def status(self, uri: str) -> tuple[bool, int, int] | None:
        """As ``children``, of the thing itself; None if it isn't there."""
        import os
        import stat
        if self.local:
            try:
                at = os.stat(self.path(uri))
            except (FileNotFoundError, NotADirectoryError):
                return None
            return stat.S_ISDIR(at.st_mode), at.st_mtime_ns // 1_000_000, at.st_size
        from pyarrow import fs
        f = self.fs.get_file_info(self.path(uri))
        return None if f.type == fs.FileType.NotFound else (f.type == fs.FileType.Directory, (f.mtime_ns or 0) // 1_000_000, f.size or 0)

    def stream(self, uri: str):
        """The file's bytes as they are."""
        import io
        return open(self.path(uri), "rb") if self.local else io.BufferedReader(self.fs.open_input_file(self.path(uri)))

    def text(self, uri: str):
        """The file's bytes, decompressed by its extension."""
        import io
        if not compressed(uri):
            return self.stream(uri)
        from pyarrow import fs
        return io.BufferedReader((self.fs or fs.LocalFileSystem()).open_input_stream(self.path(uri), compression="detect"))


def compressed(uri: str) -> bool:
    return uri.endswith((".gz", ".bz2", ".zst", ".lz4"))


def _shown(name: str) -> bool:
    """Names that Spark's file sources don't hide."""
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def _steps(glob: str) -> tuple[str, list[list[str]]]:
    """The folder that all matches are in, and the parts below it, each a glob
    and the plain names that follow it."""
    if _local(glob):
        top, rest = "file:/", "/" + glob.removeprefix("file:").lstrip("/")
    else:
        at = glob.index("/", glob.index("://") + 3)
        top, rest = glob[:at] + "/", glob[at:]
    parts = [p for p in rest.split("/") if p]
    n = next((i for i, p in enumerate(parts) if any(c in p for c in _SPECIAL)), len(parts))
    steps: list[list[str]] = []
    for p in parts[n:]:
        if any(c in p for c in _SPECIAL):
            steps.append([p])
        else:
            steps[-1].append(p)
    return top + "/".join(parts[:n]), steps


def _matched(pattern: str, below: list[str], last: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Folders to what matches in them; a chunk at a time, however many there are."""
    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        name_ok, store, out = re.compile(pattern), None, []
        for pdf in batches:
            for at in pdf["path"].tolist():
                store = store or Store(at)
                for name, folder, _, _ in store.children(at):
                    if name_ok.fullmatch(name) and (folder or last and not below):
                        out.append("/".join([at.rstrip("/"), name, *below]))
                        if len(out) >= 10_000:
                            yield pd.DataFrame({"path": out})
                            out = []
        if out:
            yield pd.DataFrame({"path": out})
    return expand


def _files_of(names: str | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Matches to files: those of a folder, or the match itself."""
    cols = ["path", "mod_ms", "length"]

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        ok, store, out = re.compile(names or ".*", re.S), None, []
        for pdf in batches:
            for at in pdf["path"].tolist():
                store = store or Store(at)
                itself = store.status(at)
                if itself is None:
                    continue
                folder, name = at.rsplit("/", 1)
                found = ((f"{at}/{n}", n, d, mod, size) for n, d, mod, size in store.children(at)) if itself[0] else [
                    (at, name, *itself)]
                for path, name, is_folder, mod, size in found:
                    if not is_folder and size > 0 and _shown(name) and ok.fullmatch(name):
                        out.append((path, mod, size))
                        if len(out) >= 10_000:
                            yield pd.DataFrame(out, columns=cols)
                            out = []
        if out:
            yield pd.DataFrame(out, columns=cols)
    return files


def listed(spark: SparkSession, glob: str, names: str | None = None, modified_after: str | None = None,
           modified_before: str | None = None) -> DataFrame | None:
    """Table ``(path, modificationTime, length)`` of the files that match, with
    the paths of ``binaryFile``; None where they are few (or out of reach), for
    Spark's reader to list.  The table is what was there at the call."""
    if not reachable(glob):
        return None
    root, steps = _steps(glob)
    many = 4 * cluster_cores(spark)
    at = spark.range(0, 1, 1, 1).select(F.lit(root).alias("path"))
    for i, (part, *below) in enumerate(steps):
        # a folder may have millions of children: they are dealt anew at each level
        at = at.mapInPandas(_matched(name_pattern(part), below, i == len(steps) - 1), "path string").repartition(many)
    files = at.mapInPandas(_files_of(names and name_pattern(names)), "path string, mod_ms long, length long").select(
        "path", F.timestamp_millis("mod_ms").alias("modificationTime"), "length")
    if modified_after:
        files = files.filter(F.col("modificationTime") > F.lit(modified_after).cast("timestamp"))
    if modified_before:
        files = files.filter(F.col("modificationTime") < F.lit(modified_before).cast("timestamp"))
    table = materialize(files, "listing")
    return table if table.count() >= FEW_FILES else None


def _dealt(files: DataFrame, cols: list[str]) -> DataFrame:
    """Files over tasks: so many that none has too many files or bytes."""
    spark = files.sparkSession
    most = _bytes(spark, "spark.sql.files.maxPartitionBytes")
    n, size = files.agg(F.count(F.lit(1)), F.sum("length")).first()
    return files.select(*cols).repartition(max(-(-n // TASK_FILES), (size or 0) // most + 1, 1))


def _bytes(spark: SparkSession, key: str) -> int:
    return int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))


def contents(files: DataFrame, text: bool = False) -> DataFrame:
    """``(path, length, content)`` of listed files, never split; ``text``:
    decompressed by the extension."""
    cols = ["path", "length", "content"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, out, held = None, [], 0
        for pdf in batches:
            for path, length in zip(pdf["path"].tolist(), pdf["length"].tolist()):
                store = store or Store(path)
                with (store.text if text else store.stream)(path) as fh:
                    raw = fh.read()
                out.append((path, length, raw))
                held += len(raw)
                if held >= CHUNK_BYTES or len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=cols)
                    out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=cols)

    return _dealt(files, ["path", "length"]).mapInPandas(read, "path string, length long, content binary")


def lines(files: DataFrame) -> DataFrame:
    """``(path, block_start, line)`` of listed files, in file order within a
    block.  A line belongs to the block that it begins in, as in Spark's text
    reader; blocks have ``spark.sql.files.maxPartitionBytes``."""
    most = _bytes(files.sparkSession, "spark.sql.files.maxPartitionBytes")
    cols = ["path", "block_start", "line"]
    codecs = F.col("path").rlike(r"\.(gz|bz2|zst|lz4)$")
    blocks = files.select("path", "length", F.explode(F.when(codecs, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(most)))).alias("block_start"))
    blocks = blocks.withColumn("length", F.least(F.col("length") - F.col("block_start"), F.lit(most)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, out, held = None, [], 0
        for pdf in batches:
            for path, start, length in zip(pdf["path"].tolist(), pdf["block_start"].tolist(), pdf["length"].tolist()):
                store = store or Store(path)
                end = None if compressed(path) else start + length
                with store.text(path) as fh:
                    at = 0
                    if start:
                        fh.seek(start)
                        at = start + len(fh.readline())
                    while end is None or at <= end:  # the next block passes over the line that begins at its start
                        raw = fh.readline()
                        if not raw:
                            break
                        if at == 0 and raw.startswith(b"\xef\xbb\xbf"):
                            raw, at = raw[3:], 3
                        at += len(raw)
                        out.append((path, start, raw[:-1] if raw.endswith(b"\n") else raw))
                        held += len(raw) + 100
                        if held >= CHUNK_BYTES:
                            yield pd.DataFrame(out, columns=cols)
                            out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=cols)

    return _dealt(blocks, ["path", "block_start", "length"]).mapInPandas(read, "path string, block_start long, line binary")
