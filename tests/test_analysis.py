"""End-to-end analyses on log folders laid out as the pollers write them.
Lines are literal copies of recorded ones (FIXTURES A1-A3) plus made-up ones."""

import os

from fleetstream.plans import analysis

CPU = [
    "%Cpu(s):  0.8 us,  0.1 sy,  0.0 ni, 99.0 id,  0.1 wa,  0.0 hi,  0.0 si,  0.0 st",
    "%Cpu(s):  0.0 us,  1.1 sy,  0.0 ni, 98.9 id,  0.0 wa,  0.0 hi,  0.0 si,  0.0 st -  1574326357947mS since epoch",
    "%Cpu(s):  0.0 us,  0.0 sy,  0.0 ni,100.0 id,  0.0 wa,  0.0 hi,  0.0 si,  0.0 st -  1574326359577mS since epoch",
]
CPU2 = [
    "%Cpu(s): 50.0 us, 25.0 sy,  0.0 ni, 25.0 id,  0.0 wa,  0.0 hi,  0.0 si,  0.0 st -  1574326358000mS since epoch",
]
CORES = ["2 -  1574326357000mS since epoch", " -  1574326360000mS since epoch"]
LISTS = ["6,7,6,6,6, -  1574326357000mS since epoch", " -  1574326358000mS since epoch"]


def _put(root, rel, lines):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n")


def test_cluster_series(spark, workdir):
    _put(workdir, "r1/worker1/cpu.log", CPU)
    _put(workdir, "r1/worker2/cpu.log", CPU2)
    _put(workdir, "r1/master/cores.log", CORES)
    rows = analysis.cluster_series(spark, workdir, "r1", workers=[1, 2]).collect()
    cpu = sorted((r.t, r.value) for r in rows if r.series == "cpu")
    # t=0: worker1 0.011; t=0.053: + worker2 0.75; t=1.63: worker1 0.0
    assert [round(t, 3) for t, _ in cpu] == [0.0, 0.053, 1.63]
    w1 = (0.0 + 1.1) / 100  # as parsed: (us + sy) / 100
    assert [v for _, v in cpu] == [(w1 + 0.0) / 2 * 16, (w1 + 0.75) / 2 * 16, (0.0 + 0.75) / 2 * 16]  # 8 cores a worker
    cores = sorted((r.t, r.value) for r in rows if r.series == "cores")
    assert cores[0][1] == 2.0 and cores[1][1] is None


def test_open_worker_list(spark, workdir):
    _put(workdir, "r1/worker1/cpu.log", CPU)
    _put(workdir, "r1/worker2/cpu.log", CPU2)
    _put(workdir, "r1/master/cores.log", CORES)
    a = analysis.cluster_series(spark, workdir, "r1", workers=[1, 2]).collect()
    b = analysis.cluster_series(spark, workdir, "r1", workers=None).collect()
    key = lambda r: (r.series, r.t)
    assert sorted(a, key=key) == sorted(b, key=key)


def test_worker_series(spark, workdir):
    _put(workdir, "r1/worker1/cpu.log", CPU)
    _put(workdir, "r1/master/cores.log", LISTS)
    rows = analysis.worker_series(spark, workdir, "r1").collect()
    alloc = sorted((r.worker, r.value) for r in rows if r.series == "allocated")
    assert alloc == [(1, 6 / 8), (2, 7 / 8), (3, 6 / 8), (4, 6 / 8), (5, 6 / 8)]
    measured = sorted(r.t for r in rows if r.series == "measured")
    assert [round(t, 3) for t in measured] == [0.947, 2.577]


def test_cli_cluster(spark, workdir):
    from fleetstream import cli
    _put(workdir, "r1/worker1/cpu.log", CPU)
    _put(workdir, "r1/master/cores.log", CORES)
    out = os.path.join(workdir, "series")
    cli.main(["cluster", "--data", workdir, "--run", "r1", "--out", out])
    assert spark.read.parquet(out).count() == 4  # 2 cpu samples + 2 core samples


def test_cli_message_path(spark, workdir):
    """Flow C: files -> envelopes (K4) -> decode -> one process per payload (UF2)."""
    from fleetstream import cli
    src = os.path.join(workdir, "src")
    os.makedirs(src)
    for i, body in enumerate([b"the cell", b"no match", bytes([0xFF, 0x3B, 0x22, 0x80])]):
        with open(os.path.join(src, f"img{i}.tif"), "wb") as fh:
            fh.write(body)
    msgs, outs = os.path.join(workdir, "msgs"), os.path.join(workdir, "outcomes")
    cli.main(["pack", "--files", src + "/*.tif", "--type", "daemon_test", "--image", "cp:3",
              "--copies", "2", "--out", msgs])
    assert spark.read.parquet(msgs).count() == 6
    cli.main(["work", "--messages", msgs, "--out", outs, "--", "grep", "-rqF", "the", "{dir}"])
    got = sorted((r.name, r.outcome) for r in spark.read.parquet(outs).collect())
    assert got == [("img0.tif", "success")] * 2 + [("img1.tif", "failed")] * 2 + \
        [("img2.tif", "failed")] * 2
