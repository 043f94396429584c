"""Inputs of the registered queries, derived from the driver's tables.

The reference reads logs of a measured cluster, a directory of image files
and a message source.  Here those inputs are built from the given parquet
tables by fixed recipes (the same recipes appear in ``oracle`` as SQL), so
that every query reads whole tables and its work grows with them.

Recipes (events): run = ``event_type``; worker = ``user_id % 5 + 1``; line
order key = ``event_id``; ``ts_ms`` = epoch milliseconds of ``ts`` (UTC).
"""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats
from ..session import ensure_session_defaults, shared_root, spread_if_narrow, to_local_path

N_WORKERS = 5
WORKERS = list(range(1, N_WORKERS + 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_session_defaults(spark)
    return spread_if_narrow(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def epoch_ms(ts: str = "ts") -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One monitoring sample per event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"),
        (F.col("user_id") % N_WORKERS + 1).cast("int").alias("worker"),
        F.col("event_id").alias("line_id"),
        epoch_ms().alias("ts_ms"),
        "event_id", "user_id", "value",
    )


def _cpu_us() -> Column:
    return (F.col("event_id") % 500).cast("double") / 10


def _cpu_sy() -> Column:
    return (F.col("user_id") % 300).cast("double") / 10


def cpu_lines(spark: SparkSession, sf_dir: str, bursts: bool = True) -> DataFrame:
    """CPU log lines per worker host.  With ``bursts`` every sample is a pair
    as `top -n2` prints it: first line without stamp (``seq`` 0, values since
    boot: us and sy swapped), then the stamped line (``seq`` 1)."""
    s = samples(spark, sf_dir)
    zero = F.lit(0.0)
    stamped = formats.cpu_line(_cpu_us(), _cpu_sy(), zero, zero, zero, zero, zero, zero,
                               F.col("ts_ms"))
    host = F.concat(F.lit("worker"), F.col("worker").cast("string"))
    if not bursts:
        return s.select("run", host.alias("host"), "worker", "line_id",
                        F.lit(1).alias("seq"), stamped.alias("line"))
    first = formats.cpu_line(_cpu_sy(), _cpu_us(), zero, zero, zero, zero, zero, zero)
    pair = F.array(
        F.struct(F.lit(0).alias("seq"), first.alias("line")),
        F.struct(F.lit(1).alias("seq"), stamped.alias("line")),
    )
    return (s.select("run", host.alias("host"), "worker", "line_id",
                     F.explode(pair).alias("l"))
            .select("run", "host", "worker", "line_id", "l.seq", "l.line"))


def core_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executor core count polled on the master: ``event_id % 41``; no count
    (application not running) when ``event_id % 13 = 0``."""
    s = samples(spark, sf_dir)
    return s.select("run", F.lit("master").alias("host"), "line_id", "ts_ms",
                    _core_count().alias("cores"))


def _core_count() -> Column:
    return F.when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise((F.col("event_id") % 41).cast("int"))


def _core_list() -> Column:
    listed = F.transform(F.sequence(F.lit(0), F.lit(N_WORKERS - 1)),
                         lambda i: ((F.col("event_id") + i) % 9).cast("int"))
    return F.when(F.col("event_id") % 13 == 0, F.array().cast("array<int>")).otherwise(listed)


def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three lines of each sample (CPU, core count, core list) from one scan."""
    zero = F.lit(0.0)
    lines = F.array(*[F.struct(F.lit(kind).alias("kind"), line.alias("line")) for kind, line in (
        ("cpu", formats.cpu_line(_cpu_us(), _cpu_sy(), zero, zero, zero, zero, zero, zero, F.col("ts_ms"))),
        ("cores", formats.core_line(_core_count(), F.col("ts_ms"))),
        ("cores_per_worker", formats.core_list_line(_core_list(), F.col("ts_ms"))))])
    return (samples(spark, sf_dir).select("run", "line_id", F.explode(lines).alias("l"))
            .select("run", "l.kind", "line_id", "l.line"))


def core_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = core_counts(spark, sf_dir)
    return c.select("run", "host", "line_id",
                    formats.core_line("cores", "ts_ms").alias("line"))


def core_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Used cores of the five workers: ``(event_id + i) % 9`` for i = 0..4;
    the status page unreachable (empty list) when ``event_id % 13 = 0``."""
    s = samples(spark, sf_dir)
    return s.select("run", F.lit("master").alias("host"), "line_id", "ts_ms",
                    _core_list().alias("cores"))


def core_list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = core_lists(spark, sf_dir)
    return c.select("run", "host", "line_id",
                    formats.core_list_line("cores", "ts_ms").alias("line"))


def executor_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executor list JSON per poll: the driver (0 cores) and
    ``event_id % 6 + 1`` executors with ``(user_id + i) % 9`` cores each.
    The list size is bounded by construction (no collect of a group)."""
    s = samples(spark, sf_dir)
    n = (F.col("event_id") % 6 + 1).cast("int")
    execs = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(i.cast("string").alias("id"),
                           ((F.col("user_id") + i) % 9).cast("int").alias("totalCores")))
    driver = F.array(F.struct(F.lit("driver").alias("id"), F.lit(0).alias("totalCores")))
    return s.select("run", "line_id", "ts_ms",
                    F.to_json(F.concat(driver, execs)).alias("json"))


def completion_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion line of each task: ``cellprofiler completed: <s>``."""
    from ..functions.parsers import completion_line
    s = samples(spark, sf_dir)
    return s.select("run", "line_id", "ts_ms",
                    completion_line(F.expr("ts_ms div 1000")).alias("line"))


def queue_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue-length samples: series = ``event_type``, queue = ``event_id*31 % 25``."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("series"), "event_id",
                    epoch_ms().alias("ts_ms"),
                    ((F.col("event_id") * 31) % 25).cast("int").alias("queue"))


# -- listing and message fixtures from documents -----------------------------

def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File listing replay table: every 7th base name is hidden (starts with
    '.'); ``mod_ms = doc_id*137 % 600000``; ``visible_ms = mod_ms +
    doc_id*7919 % 90000``."""
    d = table(spark, sf_dir, "documents")
    base = F.concat(F.when(F.col("doc_id") % 7 == 0, F.lit(".")).otherwise(F.lit("")),
                    F.lit("d"), F.col("doc_id").cast("string"), F.lit(".tif"))
    mod = (F.col("doc_id") * 137) % 600000
    return d.select(
        F.concat(F.lit("/data/src/"), F.col("source"), F.lit("/"), base).alias("path"),
        mod.alias("mod_ms"),
        (mod + (F.col("doc_id") * 7919) % 90000).alias("visible_ms"),
    )


def rewrite_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing where paths are written many times: one path per (source,
    lang), every document a new version of it (hidden names for ``src0``);
    ``mod_ms``/``visible_ms`` as in ``listing``."""
    d = table(spark, sf_dir, "documents")
    base = F.concat(F.when(F.col("source") == "src0", F.lit(".")).otherwise(F.lit("")),
                    F.col("lang"), F.lit(".tif"))
    mod = (F.col("doc_id") * 137) % 600000
    return d.select(
        F.concat(F.lit("/data/src/"), F.col("source"), F.lit("/"), base).alias("path"),
        mod.alias("mod_ms"),
        (mod + (F.col("doc_id") * 7919) % 90000).alias("visible_ms"),
    )


def doc_name() -> Column:
    return F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".tif"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message payloads: UTF-8 bytes of the text, name ``d<doc_id>.tif``,
    type = ``lang``."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", doc_name().alias("name"), F.col("lang").alias("type"),
                    F.col("text").cast("binary").alias("content"))


# -- fixture files on shared storage -----------------------------------------

_WRITTEN: dict[tuple[str, str, str], str] = {}
_LOCK = threading.RLock()  # each fixture folder is written once, even from several threads


def _fixture_dir(spark: SparkSession, sf_dir: str, kind: str) -> str:
    tag = hashlib.sha1(f"{sf_dir}|{kind}".encode()).hexdigest()[:10]
    return f"{shared_root(spark)}/fixtures/{kind}-{tag}"


def _once(spark: SparkSession, sf_dir: str, kind: str, write) -> str:
    """Write the fixture ``kind`` once per application and shared folder."""
    key = (shared_root(spark), sf_dir, kind)
    with _LOCK:
        if key not in _WRITTEN:
            path = _fixture_dir(spark, sf_dir, kind)
            write(path)
            _WRITTEN[key] = path
        return _WRITTEN[key]


#: Document files of one folder.
FOLDER_FILES = 1000


def document_files(spark: SparkSession, sf_dir: str) -> str:
    """Every document as its own file ``<root>/<folder>/name=d<doc_id>.txt``
    holding the text and a final newline; about ``FOLDER_FILES`` files a folder,
    folders and files in the order of the names.  The tasks write the files
    themselves: a partitioned writer makes a folder for each, and the driver
    moves and lists those one by one.  Documents of one id get files
    ``name=d<doc_id>.<i>.txt``."""
    def write(path: str) -> None:
        d = table(spark, sf_dir, "documents")
        name = F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("__HIVE_DEFAULT_PARTITION__"))
        content = F.concat(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), F.lit(b"\n"))
        files = d.select(name.alias("name"), content.alias("content"))
        folders = max(1, -(-d.count() // FOLDER_FILES))
        _remove(spark, path)
        (files.repartitionByRange(folders, "name").sortWithinPartitions("name", "content")
         .withColumn("folder", F.spark_partition_id()).mapInPandas(_named_files(path), "n long")
         .write.format("noop").mode("overwrite").save())
    return _once(spark, sf_dir, "docs", write)


def doc_file_name(path: str = "path") -> Column:
    """Name of the document that a file of ``document_files`` holds."""
    return F.regexp_extract(path, r"/name=([^/.]*)[^/]*$", 1).alias("name")


def _remove(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def _named_files(root: str):
    """Rows (name, content, folder), sorted by name: a file each."""
    uri = root if "://" in root else f"file://{to_local_path(root)}"

    def write(batches):
        import pandas as pd
        from pyarrow import fs
        store, top = fs.FileSystem.from_uri(uri)
        last, same, made = None, 0, None
        for pdf in batches:
            for name, content, folder in zip(pdf["name"], pdf["content"], pdf["folder"]):
                if folder != made:
                    store.create_dir(f"{top}/{folder:06d}", recursive=True)
                    made = folder
                last, same = name, same + 1 if name == last else 0
                with store.open_output_stream(f"{top}/{folder:06d}/name={name}{f'.{same}' if same else ''}.txt") as fh:
                    fh.write(content)
            yield pd.DataFrame({"n": [len(pdf)]})
    return write


#: Bytes of a language file that one task writes, about.
LANGUAGE_PART = 32 << 20


def language_files(spark: SparkSession, sf_dir: str) -> str:
    """A few large files, ``<root>/name=<lang>/part-00000.txt``: the texts of a
    language one after the other, by id (one of them has most of the bytes).
    Many tasks write a file, each a range of ids at its place in it."""
    def write(path: str) -> None:
        d = table(spark, sf_dir, "documents")
        docs = d.select(F.coalesce("lang", F.lit("none")).alias("name"), "doc_id",
                        F.concat(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), F.lit(b"\n")).alias("content"))
        size = F.octet_length("content").cast("bigint")
        # a row for each language: its bytes, then the ids that part it
        parts = docs.groupBy("name").agg(F.sum(size).alias("bytes")).agg(F.max("bytes")).first()[0] or 0
        n = int(parts // LANGUAGE_PART) + 1
        bounds = docs.groupBy("name").agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n).alias("bounds"))
        ranged = docs.join(F.broadcast(bounds.withColumnRenamed("name", "_name")), F.col("name") == F.col("_name")).select(
            "name", "doc_id", "content",
            F.coalesce(F.size(F.filter("bounds", lambda b: F.col("doc_id") > b)), F.lit(0)).alias("part"))
        sizes = ranged.groupBy("name", "part").agg(F.sum(size).alias("bytes"))  # a row for each task of the writing
        before = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        places = sizes.select("name", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("place"))
        _remove(spark, path)
        (ranged.join(F.broadcast(places), ["name", "part"])
         .repartition(max(1, sizes.count()), "name", "part").sortWithinPartitions("name", "part", "doc_id")
         .select("name", "part", "place", "content").mapInPandas(_placed_texts(to_local_path(path)), "n long")
         .write.format("noop").mode("overwrite").save())
    return _once(spark, sf_dir, "languages", write)


def _placed_texts(root: str):
    """Rows (name, part, place, content) in file order: each part from its place on."""
    def write(batches):
        import os

        import pandas as pd
        fd, now = None, None
        try:
            for pdf in batches:
                for name, part, place, content in zip(pdf["name"], pdf["part"].tolist(), pdf["place"].tolist(), pdf["content"]):
                    if (name, part) != now:
                        if fd is not None:
                            fd.close()
                        os.makedirs(f"{root}/name={name}", exist_ok=True)
                        fd = os.fdopen(os.open(f"{root}/name={name}/part-00000.txt", os.O_WRONLY | os.O_CREAT, 0o644), "wb")
                        fd.seek(place)
                        now = name, part
                    fd.write(content)
                yield pd.DataFrame({"n": [len(pdf)]})
        finally:
            if fd is not None:
                fd.close()
    return write


def write_files(files: DataFrame, root: str) -> int:
    """(name, text, mod_ms): a file each in ``root``, without a final newline;
    ``mod_ms`` NULL: dated now."""
    def write(batches):
        import os
        for pdf in batches:
            for name, text, mod in zip(pdf["name"], pdf["text"], pdf["mod_ms"].tolist()):
                path = os.path.join(root, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as fh:
                    fh.write((text or "").encode())
                if mod == mod and mod is not None:
                    os.utime(path, (mod / 1000, mod / 1000))
            yield pdf[["name"]]
    return files.select("name", "text", "mod_ms").mapInPandas(write, "name string").count()


def _write_logs(lines: DataFrame, path: str) -> None:
    """One folder per run and host, lines in file order."""
    # a host's lines in ranges of their order: as many tasks as there is data for
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (lines.repartitionByRange(n, "run", "host", "line_id", "seq")
     .sortWithinPartitions("run", "host", "line_id", "seq")
     .select("run", "host", "line")
     .write.mode("overwrite").partitionBy("run", "host").text(path))


def cpu_log_files(spark: SparkSession, sf_dir: str) -> str:
    """CPU log lines (with bursts) as ``<root>/run=<run>/host=<host>/*.txt``."""
    return _once(spark, sf_dir, "cpulogs",
                 lambda path: _write_logs(cpu_lines(spark, sf_dir, bursts=True), path))


def telemetry_files(spark: SparkSession, sf_dir: str) -> str:
    """The measured cluster's log folders, as the pollers leave them:
    ``<root>/run=<run>/host=worker<i>/*.txt`` with the CPU lines (bursts
    included), ``<root>/run=<run>/host=master/*.txt`` with core counts and
    ``<root>/run=<run>/host=lists/*.txt`` with per-worker core lists."""
    def write(path: str) -> None:
        cpu = cpu_lines(spark, sf_dir, bursts=True).select("run", "host", "line_id", "seq", "line")
        cores = core_lines(spark, sf_dir).select("run", "host", "line_id",
                                                 F.lit(0).alias("seq"), "line")
        lists = core_list_lines(spark, sf_dir).select("run", F.lit("lists").alias("host"),
                                                      "line_id", F.lit(0).alias("seq"), "line")
        _write_logs(cpu.unionByName(cores).unionByName(lists), path)
    return _once(spark, sf_dir, "telemetry", write)


def sparse_telemetry_files(spark: SparkSession, sf_dir: str) -> str:
    """As ``telemetry_files``, but the run ``click`` has no CPU logs; folder
    names hold a blank."""
    def write(path: str) -> None:
        cpu = cpu_lines(spark, sf_dir, bursts=True).filter("run <> 'click'").select("run", "host", "line_id", "seq", "line")
        cores = core_lines(spark, sf_dir).select("run", "host", "line_id", F.lit(0).alias("seq"), "line")
        _write_logs(cpu.unionByName(cores).withColumn("run", F.concat("run", F.lit(" one"))), path)
    return _once(spark, sf_dir, "sparse telemetry", write)
