"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads whole driver tables (or files Spark writes from them) and
runs one or more operators of the package.  Column names match the SQL in
``oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsers
from ..functions.parsers import keep_parsed
from ..functions import paths
from ..operators import messages as msg
from ..operators import selection as sel
from ..operators import sinks
from ..operators import slices as slc
from ..operators import tasks
from ..operators import timeline as tl
from ..sources import files as srcf
from ..session import materialize, spread, to_local_path
from . import directory
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]

# Query parameters.
# time ranges (seconds after the first sample) for trimmed / viewed series
TRIM_START, TRIM_END = 100000.0, 1000000.0
VIEW_START, VIEW_END = 1.0, 864000.0
# pages hold no worker table cells; the same operator (P5) runs with a link pattern
PAGE_PATTERN = r'href="([^"]*)"'
# messages per catalogue payload
MESSAGE_COPIES = 2
# new-file selection: threshold at start (newFilesOnly)
SELECTION_START_MS = 30000
# external commands: byte count per file; "the" found in a payload
TASK_ARGV = ["sh", "-c", 'wc -c < "$1" | tee "$2/res.csv"', "count", "{path}", "{out_dir}"]
# payloads named *00.tif take too long, those named *1.tif print a byte that is no UTF-8
RECORDED_ARGV = ["sh", "-c", 'case "$1" in *00.tif) exec sleep 30;; *1.tif) printf "\\377";; esac; grep -qF the "$1"',
                 "look", "{file}"]
# files of one batch when listing times are recorded
LISTING_FILES = 200
# files of one listing that wait for the next of these batches; partitions of their state
LISTING_CACHED, LISTING_STATE = 500 * LISTING_FILES, 4
MISSING_ARGV = ["no-such-command-here", "{file}"]
TASK_TIMEOUT_S = 1.0
# commands of a task that run side by side: one in a hundred waits for its timeout
TASKS_AT_ONCE = 4
CPU_COLS = list(parsers.CPU_FIELDS)


# -- parsed series ----------------------------------------------------------

def cpu_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 over the worker CPU logs; unstamped burst lines are dropped."""
    lines = fx.cpu_lines(spark, sf_dir, bursts=True)
    parsed = keep_parsed(lines.withColumn("p", parsers.parse_cpu_line("line")), "p")
    return parsed.select("run", "host", "worker", "line_id",
                         *[F.col(f"p.{c}").alias(c) for c in CPU_COLS],
                         "p.ts_ms", "p.ts", "p.cpu")


def core_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.core_lines(spark, sf_dir)
    parsed = keep_parsed(lines.withColumn("p", parsers.parse_core_line("line")), "p")
    return parsed.select("run", "host", "line_id", "p.ts_ms", "p.ts", "p.cores")


def core_list_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.core_list_lines(spark, sf_dir)
    parsed = keep_parsed(lines.withColumn("p", parsers.parse_core_list_line("line")), "p")
    return parsed.select("run", "host", "line_id", "p.ts_ms", "p.ts", "p.cores")


def _cpu_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed CPU samples, materialized once as a parquet table in the shared
    ``spark.checkpoint.dir``: the bucketed running total reads its input
    three times (quantiles: one column; per-bucket carry; main window), and
    text parsing should not be repeated for each pass."""
    cpu = cpu_samples(spark, sf_dir).select("run", "worker", "line_id", "ts_ms", "ts", "cpu")
    return materialize(cpu, "cpu-series")


def _cluster(spark: SparkSession, sf_dir: str, cpu: DataFrame | None = None) -> DataFrame:
    cpu = _cpu_series(spark, sf_dir) if cpu is None else cpu
    return tl.cluster_running_total(cpu, fx.WORKERS, value_col="cpu", out="cluster_cpu")


# -- queries ------------------------------------------------------------------

def q_cpu_log(spark, sf_dir):
    return cpu_samples(spark, sf_dir).drop("worker")


def q_last_of_burst(spark, sf_dir):
    lines = fx.cpu_lines(spark, sf_dir, bursts=True)
    last = tl.last_of_burst(lines, ["run", "host", "line_id"], "seq")
    parsed = last.withColumn("p", parsers.parse_cpu_line("line"))
    return parsed.select("run", "host", "line_id", "line", "p.ok", "p.ts_ms", "p.cpu")


def q_core_log(spark, sf_dir):
    return core_samples(spark, sf_dir)


def q_core_log_workers(spark, sf_dir):
    return core_list_samples(spark, sf_dir)


def q_metric_lines(spark, sf_dir):
    return fx.metric_lines(spark, sf_dir)


def q_metric_line_files(spark, sf_dir):
    """K2: the metric lines written as text files by run and kind, and read back."""
    from ..session import scratch_path
    path = scratch_path(spark, "metric-lines")
    sinks.write_lines(q_metric_lines(spark, sf_dir), path, partition_cols=["run", "kind"])
    return spark.read.schema("line string, run string, kind string").text(path).select("run", "kind", "line")


def q_splice_workers(spark, sf_dir):
    cpu = cpu_samples(spark, sf_dir)
    return tl.splice_workers(cpu.select("run", "worker", "line_id", "ts_ms", "ts", "cpu"))


def q_cluster_cpu(spark, sf_dir):
    return _cluster(spark, sf_dir)


def q_core_equivalents(spark, sf_dir):
    c = _cluster(spark, sf_dir)
    return c.select("run", "line_id", "ts_ms",
                    tl.core_equivalents(F.col("cluster_cpu")).alias("cores_used"))


def _rebased_cluster_view(spark, sf_dir):
    """Cluster figure: CPU in core equivalents and executor cores, both on the
    clock of the first CPU sample."""
    samples = _cpu_series(spark, sf_dir)
    c = _cluster(spark, sf_dir, samples)
    origin = tl.origins_of(samples)
    cpu = tl.rebase(c, origin).select(
        "run", F.lit("cpu").alias("series"), "line_id", "t",
        tl.core_equivalents(F.col("cluster_cpu")).alias("value"))
    cores = tl.rebase(core_samples(spark, sf_dir), origin).select(
        "run", F.lit("cores").alias("series"), "line_id", "t",
        F.col("cores").cast("double").alias("value"))
    return cpu.unionByName(cores)


def q_rebase_time(spark, sf_dir):
    return _rebased_cluster_view(spark, sf_dir)


def q_trim_series(spark, sf_dir):
    return tl.trim(_rebased_cluster_view(spark, sf_dir), TRIM_START, TRIM_END)


def q_alloc_fraction(spark, sf_dir):
    per_worker = tl.per_worker_cores(core_list_samples(spark, sf_dir))
    return per_worker.select("run", "line_id", "ts_ms", "ts", "worker", "cores",
                             tl.allocated_fraction(F.col("cores")).alias("fraction"))


def _worker_points(spark, sf_dir):
    """Per-worker figure: allocated (cores / 8) and measured CPU per worker,
    on the clock of the first cores sample."""
    lists = materialize(core_list_samples(spark, sf_dir), "core-lists")  # parsed once
    origin = tl.origins_of(lists)
    alloc = tl.rebase(tl.per_worker_cores(lists), origin).withColumn(
        "value", tl.allocated_fraction(F.col("cores")))
    measured = tl.rebase(cpu_samples(spark, sf_dir), origin).withColumn("value", F.col("cpu"))
    return tl.overlay(alloc, measured)


def q_overlay_series(spark, sf_dir):
    """The figure's points in the viewed range."""
    return tl.view_range(_worker_points(spark, sf_dir), VIEW_START, VIEW_END)


def q_executor_cores_sum(spark, sf_dir):
    """The same total, summed over one row for each executor."""
    e = fx.executor_lists(spark, sf_dir)
    return tl.cores_over_executors(e, "json", ["run", "line_id", "ts_ms"])


def q_executor_cores(spark, sf_dir):
    e = fx.executor_lists(spark, sf_dir)
    return e.select("run", "line_id", "ts_ms",
                    parsers.executor_total_cores("json").alias("total_cores"))


def q_makespan(spark, sf_dir):
    lines = fx.completion_lines(spark, sf_dir)
    done = keep_parsed(lines.withColumn("p", parsers.parse_completion_line("line")), "p")
    return tl.makespan(done.select("run", "p.completed_s"), fx.samples(spark, sf_dir))


def q_load_rate(spark, sf_dir):
    return tl.load_rate(fx.queue_lengths(spark, sf_dir))


def q_load_rate_uneven(spark, sf_dir):
    """W3 over the samples' own times."""
    return tl.load_rate(fx.queue_lengths(spark, sf_dir), time_col="ts_ms", unit_s=0.001)


def q_makespan_open(spark, sf_dir):
    """G4 where a run has completions and no start: it stays, without a makespan."""
    lines = fx.completion_lines(spark, sf_dir)
    done = keep_parsed(lines.withColumn("p", parsers.parse_completion_line("line")), "p")
    return tl.makespan(done.select("run", "p.completed_s"), fx.samples(spark, sf_dir).filter("run <> 'click'"))


def q_null_times(spark, sf_dir):
    """W1 and W3 where samples have no time: they come first, as in a sort."""
    cpu = _cpu_series(spark, sf_dir).withColumn("ts_ms", F.when(F.col("line_id") % 7 != 0, F.col("ts_ms")))
    total = tl.cluster_running_total(cpu, fx.WORKERS, value_col="cpu", out="value").select(
        F.lit("total").alias("kind"), "run", "line_id", "value")
    queues = fx.queue_lengths(spark, sf_dir).withColumn("ts_ms", F.when(F.col("event_id") % 7 != 0, F.col("ts_ms")))
    rate = tl.load_rate(queues).select(
        F.lit("rate").alias("kind"), F.col("series").alias("run"), F.col("event_id").alias("line_id"), F.col("rate").alias("value"))
    return total.unionByName(rate)


def q_open_workers(spark, sf_dir):
    """W1 + G3 over 5,000 workers that nobody declares (values in 64ths: sums are exact)."""
    e = fx.table(spark, sf_dir, "events")
    samples = e.select(F.col("event_type").alias("run"), ((F.col("event_id") * 7919) % 5000).cast("int").alias("worker"),
                       F.col("event_id").alias("line_id"), fx.epoch_ms().alias("ts_ms"),
                       F.when(F.col("event_id") % 11 != 0, ((F.col("event_id") * 31) % 129).cast("double") / 64).alias("cpu"))
    return tl.cluster_running_total(samples, None).select("run", "worker", "line_id", "cluster_cpu")


def q_default_share(spark, sf_dir):
    """Requests: one per part, image ``img<p_size>``.  Profiles: every line
    item ran image ``img<l_linenumber>`` and used ``l_discount`` of a core
    (whole cents, so the mean is exact).  Images never run get the default."""
    part = fx.table(spark, sf_dir, "part")
    requests = part.select("p_partkey",
                           F.concat(F.lit("img"), F.col("p_size").cast("string")).alias("image"))
    items = fx.table(spark, sf_dir, "lineitem")
    profiles = items.select(
        F.concat(F.lit("img"), F.col("l_linenumber").cast("string")).alias("image"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("cpu_cents"))
    return tl.default_share(requests, profiles, cpu_col="cpu_cents", units=100.0)


def q_page_counts(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    found = F.regexp_extract_all(F.col("html"), F.lit(PAGE_PATTERN), 1)
    return pages.select("page_id", F.size(found).cast("bigint").alias("n_matches"),
                        parsers.matches_joined("html", PAGE_PATTERN).alias("joined"))



def q_uri_path(spark, sf_dir):
    from ..functions.paths import file_uri, uri_to_path
    d = fx.table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/src/"), F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"),
                    F.lit(".tif"))
    return d.select("doc_id", file_uri(path).alias("uri")).withColumn(
        "path", uri_to_path("uri"))


def q_log_scan(spark, sf_dir):
    from ..sources.logs import scan_logs
    root = fx.cpu_log_files(spark, sf_dir)
    return scan_logs(spark, root, "*/*/*.txt", with_order_key=False).select("run", "host", "line")



# -- messages -----------------------------------------------------------------

def _routes(spark, sf_dir):
    """Route table: one container image per message type (derived from the
    types present in the catalogue)."""
    types = fx.table(spark, sf_dir, "documents").select(F.col("lang").alias("type")).distinct()
    return types.select("type", F.concat(F.lit("fleet/"), F.col("type"), F.lit("-worker:1"))
                        .alias("image"), F.lit(msg.DEFAULT_OS).alias("os"))


def q_message_encode(spark, sf_dir):
    packed = msg.pack(fx.payloads(spark, sf_dir))
    return packed.select("name", "type", F.octet_length("envelope").cast("bigint").alias("n_bytes"),
                         F.md5("envelope").alias("md5"))


def q_message_decode(spark, sf_dir):
    packed = msg.pack(fx.payloads(spark, sf_dir)).select("doc_id", "type", "envelope")
    out = msg.unpack(packed, mode="strict")
    return out.select("name", "size", F.octet_length("data").cast("bigint").alias("n_data"),
                      F.md5("data").alias("md5"),
                      (F.col("size") == F.octet_length("data")).alias("size_ok"))


def q_route_lookup(spark, sf_dir):
    routed = msg.route(fx.payloads(spark, sf_dir).drop("content"), _routes(spark, sf_dir))
    return routed.select("name", "type", "image", "os")


def q_binary_load(spark, sf_dir):
    """Bytes, base name and size of every file."""
    files = srcf.load_binary(spark, _doc_glob(spark, sf_dir))
    return files.select(fx.doc_file_name(), "length", F.md5("content").alias("md5"),
                        F.col("name").endswith(".txt").alias("is_text"))


def q_message_draw(spark, sf_dir):
    """A stated number of messages over the catalogue of payloads."""
    catalogue = fx.payloads(spark, sf_dir).select("doc_id", "name", "type")
    n = 3 * catalogue.count() // 2
    return msg.draw_messages(catalogue, n, ["doc_id"]).select("message_id", "name", "type")


def q_message_load(spark, sf_dir):
    loaded = msg.load_messages(fx.payloads(spark, sf_dir), copies=MESSAGE_COPIES)
    routed = msg.pack(msg.route(loaded, _routes(spark, sf_dir)))
    return routed.select("name", "copy", "type", "image", "os",
                         F.octet_length("envelope").cast("bigint").alias("n_bytes"))



# -- new-file selection (batch replay) ----------------------------------------

def _selection(spark, sf_dir):
    return sel.select_new_files(fx.listing(spark, sf_dir), start_ms=SELECTION_START_MS)


def q_new_file_selection(spark, sf_dir):
    return _selection(spark, sf_dir).select("path", "mod_ms", "visible_ms", "batch_ms",
                                            "threshold_ms", "reason", "selected")


def q_rewritten_files(spark, sf_dir):
    """T2/T4 with paths written many times (stateful per path)."""
    return sel.select_rewritten_files(fx.rewrite_listing(spark, sf_dir),
                                      start_ms=SELECTION_START_MS)


def q_late_files(spark, sf_dir):
    return sel.late_files(_selection(spark, sf_dir)).select(
        "path", "mod_ms", "visible_ms", "batch_ms", "lateness_ms")


def q_batch_counts(spark, sf_dir):
    return sel.batch_counts(_selection(spark, sf_dir))


def q_balanced_slices(spark, sf_dir):
    chosen = _selection(spark, sf_dir).filter("selected").select("path", "mod_ms", "batch_ms")
    return slc.assign_slices(chosen, ["batch_ms"], ["mod_ms", "path"]).select(
        "batch_ms", "path", "n", "p", "slice")


def q_batch_preview(spark, sf_dir):
    chosen = _selection(spark, sf_dir).filter("selected").select("path", "mod_ms", "batch_ms")
    return sinks.preview(chosen, ["batch_ms"], ["path"], n=5).select(
        "batch_ms", "path", F.col("rank").cast("bigint").alias("rank"))


# -- files ------------------------------------------------------------------

def _doc_glob(spark, sf_dir):
    return fx.document_files(spark, sf_dir) + "/*"  # the folders: a listing of each, not of each file


def _name_from_path(c="path"):
    return paths.dir_value(F.col(c)).alias("name")


def q_file_listing(spark, sf_dir):
    files = srcf.list_files(spark, _doc_glob(spark, sf_dir))
    return files.select(fx.doc_file_name(), "length")


def q_whole_file(spark, sf_dir):
    files = srcf.whole_files(spark, _doc_glob(spark, sf_dir))
    return files.select(fx.doc_file_name(),
                        F.octet_length("text").cast("bigint").alias("n_bytes"),
                        F.md5(F.col("text").cast("binary")).alias("md5"))


def q_file_sample(spark, sf_dir):
    files = srcf.sample_files(spark, _doc_glob(spark, sf_dir), path_glob_filter="*.txt", n=20)
    return files.select(fx.doc_file_name(), "length")


def q_named_lines(spark, sf_dir):
    from ..sources.logs import named_lines
    lines = named_lines(spark, fx.document_files(spark, sf_dir), "*")
    return lines.select(fx.doc_file_name(), "line")


def q_by_file_transform(spark, sf_dir):
    """G5 + UF3: a function over each file's lines, in file order."""
    from ..sources.logs import named_lines

    def summary(path, lines):
        n = empty = 0
        last = None
        for n, line in enumerate(lines, 1):
            empty += line == ""
            last = line or last
        yield path, n, empty, len((last or "").encode())

    lines = named_lines(spark, fx.document_files(spark, sf_dir), "*", with_order_key=True)
    done = tasks.apply_per_file(lines, summary, "path string, n_lines long, n_empty long, last_bytes long")
    return done.select(fx.doc_file_name(), "n_lines", "n_empty", "last_bytes")


def q_by_file_merge(spark, sf_dir):
    """G5 + UF3: a function over the lines of few large files, folded split by
    split and merged in file order: lines, and lines unlike the one before."""
    from ..sources.logs import named_lines

    def step(s, line):
        n, changes, first, last = s
        return n + 1, changes + (n > 0 and line != last), line if n == 0 else first, line

    def merge(a, b):
        return a[0] + b[0], a[1] + b[1] + (a[3] != b[2]), a[2], b[3]

    def finish(path, s):
        yield path, s[0], s[1], len(s[2].encode()), len(s[3].encode())

    lines = named_lines(spark, fx.language_files(spark, sf_dir), "*/*", with_order_key=True)
    done = tasks.fold_per_file(lines, lambda: (0, 0, None, None), step, merge, finish,
                               "path string, n_lines long, n_changes long, first_bytes long, last_bytes long")
    return done.select(_name_from_path(), "n_lines", "n_changes", "first_bytes", "last_bytes")


# -- external tasks -----------------------------------------------------------

def q_external_task(spark, sf_dir):
    """UF1: a command that prints a number and writes it into its output
    folder; the files are read back from there."""
    from ..session import scratch_path, to_local_path
    files = srcf.list_files(spark, _doc_glob(spark, sf_dir)).select("path")
    out_root = to_local_path(scratch_path(spark, "task-out"))
    done = materialize(tasks.run_per_file(spread(files), TASK_ARGV, on_error="raise", out_root=out_root), "task-rows")
    written = srcf.whole_files(spark, f"file:{out_root}/*/res.csv").select(
        F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"), F.trim("text").try_cast("bigint").alias("n_written"))
    rows = done.select(fx.doc_file_name(), "status", F.trim("output").try_cast("bigint").alias("n_bytes"),
                       parsers.parse_completion_line("completion", tasks.COMPLETED)["ok"].alias("completion_ok"),
                       F.element_at(F.split("out_dir", "/"), -1).alias("folder"))
    return rows.join(written, "folder", "left").drop("folder")


def q_external_task_recorded(spark, sf_dir):
    """UF2: statuses recorded, also of payloads that take too long, of output
    that is no UTF-8 and of a command that doesn't exist."""
    packed = msg.pack(fx.payloads(spark, sf_dir)).select("doc_id", "envelope")
    decoded = spread(msg.unpack(packed, mode="strict").select("name", "data"))
    looked = tasks.run_per_payload(decoded, RECORDED_ARGV, timeout_s=TASK_TIMEOUT_S, at_once=TASKS_AT_ONCE).withColumn("command", F.lit("look"))
    missing = tasks.run_per_payload(decoded, MISSING_ARGV).withColumn("command", F.lit("missing"))
    return looked.unionByName(missing).select("command", "name", "status", "outcome")


# -- streams ------------------------------------------------------------------

def q_new_file_stream(spark, sf_dir):
    from ..session import scratch_path
    from ..streaming import newfiles as nf
    work = scratch_path(spark, "stream")
    q = nf.start(nf.new_file_stream(spark, _doc_glob(spark, sf_dir), new_files_only=False), f"{work}/out",
                 f"{work}/checkpoint")
    q.awaitTermination()
    res = nf.read_results(spark, f"{work}/out")
    return res.select(fx.doc_file_name(), "length")


def q_timed_trigger(spark, sf_dir):
    """The same files by a stream on a fixed interval, stopped when it has caught up."""
    from ..session import scratch_path
    from ..streaming import newfiles as nf
    work = scratch_path(spark, "timed")
    q = nf.start(nf.new_file_stream(spark, _doc_glob(spark, sf_dir), new_files_only=False), f"{work}/out",
                 f"{work}/checkpoint", available_now=False, interval="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    res = nf.read_results(spark, f"{work}/out", "counts")
    return res.agg(F.sum("n_files").alias("n_files"))


def _waves(spark, sf_dir, src):
    """Documents as files, in two waves by language; about ``FOLDER_FILES`` files a folder."""
    docs = fx.table(spark, sf_dir, "documents").withColumn("wave", F.when(F.col("lang") == "en", 1).otherwise(2))
    folders = max(1, -(-docs.count() // fx.FOLDER_FILES))
    folder = F.lpad(F.pmod(F.xxhash64("doc_id"), F.lit(folders)).cast("string"), 6, "0")
    for wave in (1, 2):
        fx.write_files(docs.filter(F.col("wave") == wave).select(
            F.concat(F.lit(f"wave={wave}/"), folder, F.lit("/name=d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
            F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"), F.lit(None).cast("double").alias("mod_ms")),
            to_local_path(src))
        yield wave


def q_restart_once(spark, sf_dir):
    """T8 + F5: a stream of new files only, started on an empty folder; each
    wave of files comes while it is down.  After each restart from the
    checkpoint every file is processed once, and none is missed."""
    from ..session import scratch_path
    from ..streaming import newfiles as nf
    work = scratch_path(spark, "restart")
    src = f"{work}/src"

    def drain():
        files = nf.new_file_stream(spark, f"{src}/*/*", new_files_only=True, checkpoint=f"{work}/checkpoint")
        nf.start(files, f"{work}/out", f"{work}/checkpoint").awaitTermination()

    nf.ensure_dir(spark, src)
    drain()
    for _ in _waves(spark, sf_dir, src):
        drain()
    res = nf.read_results(spark, f"{work}/out")
    return res.groupBy(fx.doc_file_name()).agg(
        F.first("length").alias("length"), F.count(F.lit(1)).alias("n_seen"))


def q_slow_listing(spark, sf_dir):
    """One row for each batch, recorded while the stream runs.  The batches
    follow one another without a pause, and the one that lists has the time of it."""
    import time

    from ..session import scratch_path
    from ..streaming import newfiles as nf
    work = scratch_path(spark, "progress")
    listener = nf.ProgressTable(spark, f"{work}/progress", query=work)
    spark.streams.addListener(listener)
    try:
        files = nf.new_file_stream(spark, _doc_glob(spark, sf_dir), max_files_per_trigger=LISTING_FILES,
                                   new_files_only=False, max_cached_files=LISTING_CACHED)
        q = nf.start(files, f"{work}/out", f"{work}/checkpoint", available_now=False, interval="0 seconds", name=work,
                     state_partitions=LISTING_STATE)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        want = nf.read_results(spark, f"{work}/out", "counts").count()
        for _ in range(100):  # events come a little later
            rows = nf.progress_rows(spark, f"{work}/progress").filter("num_input_rows > 0")
            if rows.count() >= want:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    return rows.select("batch_id", "num_input_rows", "trigger_ms")


def q_named_line_stream(spark, sf_dir):
    """Lines of arriving files with their name, through a parquet sink."""
    from ..session import scratch_path
    from ..sources.logs import named_line_stream
    work = scratch_path(spark, "lines")
    q = (named_line_stream(spark, _doc_glob(spark, sf_dir)).writeStream.format("parquet")
         .option("path", f"{work}/out").option("checkpointLocation", f"{work}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{work}/out").select(fx.doc_file_name(), "line")


# -- sinks, written and read back --------------------------------------------

def q_series_sink(spark, sf_dir):
    """K3: the per-worker figure's points written as a parquet table
    (partitioned by run) in the shared folder, then read back."""
    from ..session import scratch_path
    path = scratch_path(spark, "series")
    series = _worker_points(spark, sf_dir)
    sinks.write_series(series, path)
    # the written schema, so partition values (run names) keep their type
    return spark.read.schema(series.schema).parquet(path).select(
        "run", "worker", "line_id", "t", "value", "series")


def q_message_table(spark, sf_dir):
    """K4: envelope, target image and OS tag written as parquet, read back."""
    from ..session import scratch_path
    path = scratch_path(spark, "messages")
    routed = msg.pack(msg.route(fx.payloads(spark, sf_dir), _routes(spark, sf_dir)))
    msg.write_messages(routed, path)
    back = spark.read.parquet(path)
    return back.select("image", "os", F.octet_length("envelope").cast("bigint").alias("n_bytes"),
                       F.md5("envelope").alias("md5"))


# -- the analyses on log folders ---------------------------------------------

def q_cluster_timeline(spark, sf_dir):
    """Whole-cluster figure from the log folders (scan -> P3/P1 -> W1 -> W2 -> M3)."""
    from . import analysis
    root = fx.telemetry_files(spark, sf_dir)
    return analysis.cluster_series(spark, root, "*", workers=fx.WORKERS, cpu_files="host=worker*/*.txt",
                                   core_files="host=master/*.txt")


def q_bad_line_counts(spark, sf_dir):
    """Lines, and lines that don't parse (the first of each burst has no
    stamp), counted by the pass that parses them for the figure."""
    from pyspark.sql import Observation

    from . import analysis
    root = fx.telemetry_files(spark, sf_dir)
    counts = Observation("cpu"), Observation("cores")
    analysis.cluster_series(spark, root, "*", cpu_files="host=worker*/*.txt", core_files="host=master/*.txt", counts=counts)
    rows = [(log, c.get["n_lines"], c.get["n_bad"]) for log, c in zip(("cpu", "cores"), counts, strict=True)]
    return spark.createDataFrame(rows, "log string, n_lines long, n_bad long")


def q_worker_timeline(spark, sf_dir):
    """Per-worker figure's points from the log folders (scan -> P2/P3 -> A2 -> M4 -> W2 -> U3)."""
    from . import analysis
    root = fx.telemetry_files(spark, sf_dir)
    return analysis.worker_series(spark, root, "*", cpu_files="host=worker*/*.txt", core_files="host=lists/*.txt")


def q_sparse_timeline(spark, sf_dir):
    """The whole-cluster figure where one run has no CPU log at all: it stays,
    on the clock of its first cores sample."""
    from . import analysis
    root = fx.sparse_telemetry_files(spark, sf_dir)
    return analysis.cluster_series(spark, root, "*", workers=fx.WORKERS, cpu_files="host=worker*/*.txt",
                                   core_files="host=master/*.txt")


def q_null_runs(spark, sf_dir):
    """W1 and W3 where every third worker's run, or series, is NULL: a group like any other."""
    cpu = _cpu_series(spark, sf_dir).withColumn("run", F.when(F.col("worker") != 3, F.col("run")))
    total = tl.cluster_running_total(cpu, fx.WORKERS, value_col="cpu", out="value").select(
        F.lit("total").alias("kind"), "run", "line_id", "value")
    queues = fx.queue_lengths(spark, sf_dir).withColumn("series", F.when(F.col("event_id") % 3 != 0, F.col("series")))
    rate = tl.load_rate(queues).select(
        F.lit("rate").alias("kind"), F.col("series").alias("run"), F.col("event_id").alias("line_id"), F.col("rate").alias("value"))
    return total.unionByName(rate)


QUERIES: dict[str, Query] = {
    "bad_line_counts": q_bad_line_counts,
    "load_rate_uneven": q_load_rate_uneven,
    "makespan_open": q_makespan_open,
    "null_times": q_null_times,
    "open_workers": q_open_workers,
    "by_file_merge": q_by_file_merge,
    "directory_stream": directory.q_directory_stream,
    "future_stream": directory.q_future_stream,
    "rewritten_stream": directory.q_rewritten_stream,
    "listing_errors": directory.q_listing_errors,
    "sparse_timeline": q_sparse_timeline,
    "null_runs": q_null_runs,
    "message_draw": q_message_draw,
    "binary_load": q_binary_load,
    "metric_line_files": q_metric_line_files,
    "executor_cores_sum": q_executor_cores_sum,
    "named_line_stream": q_named_line_stream,
    "timed_trigger": q_timed_trigger,
    "cluster_cpu": q_cluster_cpu,
    "cpu_log": q_cpu_log,
    "last_of_burst": q_last_of_burst,
    "core_log": q_core_log,
    "core_log_workers": q_core_log_workers,
    "metric_lines": q_metric_lines,
    "splice_workers": q_splice_workers,
    "core_equivalents": q_core_equivalents,
    "rebase_time": q_rebase_time,
    "trim_series": q_trim_series,
    "alloc_fraction": q_alloc_fraction,
    "overlay_series": q_overlay_series,
    "executor_cores": q_executor_cores,
    "makespan": q_makespan,
    "load_rate": q_load_rate,
    "default_share": q_default_share,
    "page_counts": q_page_counts,
    "uri_path": q_uri_path,
    "log_scan": q_log_scan,
    "message_encode": q_message_encode,
    "message_decode": q_message_decode,
    "route_lookup": q_route_lookup,
    "message_load": q_message_load,
    "new_file_selection": q_new_file_selection,
    "rewritten_files": q_rewritten_files,
    "late_files": q_late_files,
    "batch_counts": q_batch_counts,
    "balanced_slices": q_balanced_slices,
    "batch_preview": q_batch_preview,
    "file_listing": q_file_listing,
    "whole_file": q_whole_file,
    "file_sample": q_file_sample,
    "named_lines": q_named_lines,
    "by_file_transform": q_by_file_transform,
    "external_task": q_external_task,
    "external_task_recorded": q_external_task_recorded,
    "new_file_stream": q_new_file_stream,
    "restart_once": q_restart_once,
    "slow_listing": q_slow_listing,
    "series_sink": q_series_sink,
    "message_table": q_message_table,
    "cluster_timeline": q_cluster_timeline,
    "worker_timeline": q_worker_timeline,
}
