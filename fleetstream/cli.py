"""Command line: the analyses and the file stream as Spark jobs.

    python -m fleetstream.cli cluster --data data --run 2020-02-18 --start 100 --end 1000 --out out/
    python -m fleetstream.cli workers --data data --run 2020-04-05 --start 1 --end 800 --out out/
    python -m fleetstream.cli stream --watch /mnt/src --out out/ --checkpoint ck/ -- cmd {path}
    python -m fleetstream.cli pack --files '/mnt/src/*' --type daemon_test --image img:1 --out msgs/
    python -m fleetstream.cli work --messages msgs/ --out outcomes/ -- cmd -i {dir}

``--master`` defaults to the session's own setting (spark-submit) when run
on a cluster.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .operators import messages, sinks, tasks
from .sources import files
from .plans import analysis
from .session import release_materialized, spread
from .streaming import newfiles
from .streaming.listing import directory_stream


def _session(master: str | None) -> SparkSession:
    b = SparkSession.builder.appName("fleetstream")
    if master:
        b = b.master(master)
    return b.getOrCreate()


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="fleetstream")
    ap.add_argument("--master")
    sub = ap.add_subparsers(dest="cmd", required=True)
    for name in ("cluster", "workers"):
        p = sub.add_parser(name)
        p.add_argument("--data", required=True)
        p.add_argument("--run", default="*")
        p.add_argument("--start", type=float)
        p.add_argument("--end", type=float)
        p.add_argument("--out", required=True)
        if name == "cluster":
            p.add_argument("--workers", default="auto",
                           help="worker indices in summation order, or 'auto' (from the logs)")
        p.add_argument("--lines", choices=("drop", "strict"), default="drop",
                       help="lines that don't parse: dropped and counted, or an error")
    s = sub.add_parser("stream")
    s.add_argument("--watch", required=True, help="folder or glob of folders to watch")
    s.add_argument("--out", required=True)
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--interval", default="5 seconds")
    s.add_argument("--once", action="store_true", help="drain what is there and stop")
    s.add_argument("--max-slices", type=int, help="most partitions of a batch (default: the cluster's cores)")
    s.add_argument("--all-files", action="store_true", help="also files from before the first start")
    s.add_argument("--name", help="take only files whose name matches this glob, e.g. '*.tif'")
    s.add_argument("--task-out", help="shared folder for {out_dir} (default: <out>/task-out)")
    s.add_argument("--timeout", type=float, help="seconds that a command may take")
    s.add_argument("--on-error", choices=("raise", "record"), default="raise")
    s.add_argument("argv", nargs="*", help="command per file; {path} {uri} {file_list} {out_dir}")
    pk = sub.add_parser("pack", help="files -> routed message envelopes (K4)")
    pk.add_argument("--files", required=True, help="glob of the payload files")
    pk.add_argument("--type", default="default", help="message type of every payload")
    pk.add_argument("--image", required=True, help="container image for that type")
    pk.add_argument("--os", default=messages.DEFAULT_OS)
    pk.add_argument("--copies", type=int, default=1)
    pk.add_argument("--out", required=True)
    wk = sub.add_parser("work", help="message envelopes -> one process per payload (UF2)")
    wk.add_argument("--messages", required=True)
    wk.add_argument("--out", required=True)
    wk.add_argument("--keep", help="shared folder that failed payloads are kept in")
    wk.add_argument("--timeout", type=float, help="seconds that a command may take")
    wk.add_argument("argv", nargs="+", help="command per payload; {dir} {file}")
    a = ap.parse_args(argv)
    spark = _session(a.master)
    if a.cmd == "cluster":
        workers = None if a.workers == "auto" else [int(x) for x in a.workers.split(",")]
        counts = Observation("cpu"), Observation("cores")
        series = analysis.cluster_series(spark, a.data, a.run, workers=workers,
                                         start=a.start, end=a.end, mode=a.lines, counts=counts)
        sinks.write_series(series, a.out)
        if any(c.get["n_bad"] for c in counts):  # a second pass, by host, only where there is something to see
            analysis.bad_lines(spark, a.data, a.run).filter("n_bad > 0").show(truncate=False)
    elif a.cmd == "workers":
        series = analysis.worker_series(spark, a.data, a.run, start=a.start, end=a.end, mode=a.lines)
        sinks.write_series(series, a.out)
        analysis.bad_lines(spark, a.data, a.run, per_worker=True).filter("n_bad > 0").show(truncate=False)
    elif a.cmd == "pack":
        payloads = files.load_binary(spark, a.files).select(
            "name", F.lit(a.type).alias("type"), "content")
        routes = spark.createDataFrame([(a.type, a.image, a.os)], "type string, image string, os string")
        loaded = messages.load_messages(payloads, copies=a.copies)
        messages.write_messages(messages.pack(messages.route(loaded, routes)), a.out)
    elif a.cmd == "work":
        decoded = messages.unpack(spark.read.parquet(a.messages), mode="strict")
        done = tasks.run_per_payload(spread(decoded.select("name", "image", "data")), a.argv,
                                     timeout_s=a.timeout, keep_root=a.keep)
        done.write.mode("overwrite").parquet(a.out)
    else:
        handler = newfiles.task_handler(a.argv, on_error=a.on_error, timeout_s=a.timeout,
                                        out_root=a.task_out or f"{a.out.rstrip('/')}/task-out") if a.argv else None
        files_in = directory_stream(spark, a.watch, name=a.name, new_files_only=not a.all_files, checkpoint=a.checkpoint)
        q = newfiles.start(files_in, a.out, a.checkpoint, handler, available_now=a.once,
                           interval=a.interval, max_slices=a.max_slices, idle_batches=False)
        q.awaitTermination()
    release_materialized(spark)


if __name__ == "__main__":
    main()
