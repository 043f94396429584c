"""Many files are listed and read by the tasks, with the rows of Spark's readers."""

import gzip
import os

import pytest

from fleetstream.sources import files, logs, scan


@pytest.fixture()
def tree(workdir):
    """Folders with hidden, empty, compressed, oddly named and large files."""
    src = os.path.join(workdir, "s rc")
    for folder in ("a 1", "b+2", "_u"):
        at = os.path.join(src, folder)
        os.makedirs(os.path.join(at, "deeper"))
        texts = {"deeper/no.txt": b"no", ".h.txt": b"x", "_h.txt": b"x", "_k=1.txt": b"x", "empty.txt": b"", "x._COPYING_": b"x",
                 "name=é0%41.txt": b"x\n\n\xff last\r\n\n", "one.txt": b"no end",
                 "big.txt": b"\xef\xbb\xbf" + b"".join(b"line %d %s\n" % (i, b"y" * (i % 60)) for i in range(3000)),
                 "z.txt.gz": gzip.compress(b"zip\nped\n")}
        for name, text in texts.items():
            with open(os.path.join(at, name), "wb") as fh:
                fh.write(text)
    os.symlink("/nowhere", os.path.join(src, "dangling"))
    return src


def both(monkeypatch, rows):
    """What Spark's readers give, and what the tasks give."""
    few = rows()
    monkeypatch.setattr(scan, "FEW_FILES", 1)
    monkeypatch.setattr(scan, "TASK_FILES", 3)
    return few, rows()


@pytest.mark.parametrize("glob", ["*", "{a*,b*}/*.txt", "[a-b]*/name=*"])
def test_listings_are_the_same(spark, tree, monkeypatch, glob):
    """Path, date and length, also where the names are filtered."""
    few, many = both(monkeypatch, lambda: [
        sorted(map(tuple, files.list_files(spark, at, name).collect())) for at in (f"{tree}/{glob}", f"file:{tree}/{glob}") for name in (None, "*.txt")]
        + [list(map(tuple, files.sample_files(spark, f"{tree}/{glob}", "*.txt", 3).collect()))])
    assert few == many and few[0]


def test_bytes_are_the_same(spark, tree, monkeypatch):
    """F14"""
    few, many = both(monkeypatch, lambda: sorted(
        (r.path, r.name, r.length, bytes(r.content)) for r in files.load_binary(spark, f"{tree}/*").collect()))
    assert few == many and few


def test_texts_are_the_same(spark, tree, monkeypatch):
    """Whole texts, bytes that are no UTF-8 included."""
    few, many = both(monkeypatch, lambda: sorted(
        (r.path, bytes(r.text)) for r in files.whole_files(spark, f"{tree}/*").selectExpr("path", "cast(text as binary) text").collect()))
    assert few == many and few


def test_lines_are_the_same(spark, tree, monkeypatch):
    """Lines, and the blocks that they begin in."""
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    spark.conf.set(key, "20000")

    def rows():
        df = logs.named_lines(spark, tree, "*", True).selectExpr("path", "block_start", "line_key", "cast(line as binary) line")
        assert logs.named_lines(spark, tree, "*").columns == ["path", "line"]
        return [(r.path, r.block_start, bytes(r.line)) for r in df.orderBy("path", "block_start", "line_key").collect()]
    try:
        few, many = both(monkeypatch, rows)
    finally:
        spark.conf.set(key, was)
    assert few == many and len({r[1] for r in few}) > 3


def test_the_driver_lists_nothing(spark, tree, monkeypatch):
    """No file index over the files; few tasks, whatever a file's opening is said to cost."""
    from test_plans import plan
    monkeypatch.setattr(scan, "FEW_FILES", 1)
    at = f"{tree}/*"
    for df in (files.list_files(spark, at), files.load_binary(spark, at), files.whole_files(spark, at), logs.named_lines(spark, tree, "*")):
        tree_of = plan(df)
        assert "binaryFile" not in tree_of and "Scan text" not in tree_of
        assert df.rdd.getNumPartitions() <= 4


def test_nothing_there_is_still_an_error(spark, workdir, monkeypatch):
    monkeypatch.setattr(scan, "FEW_FILES", 1)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.list_files(spark, os.path.join(workdir, "none", "*")).count()


def test_name_patterns():
    import re
    for glob, yes, no in (("*.t?t", "a.txt", "a.text"), ("{a,b*}c", "bxc", "abc"), ("[^a]x", "bx", "ax"), ("a+(1)", "a+(1)", "aa1")):
        assert re.fullmatch(scan.name_pattern(glob), yes) and not re.fullmatch(scan.name_pattern(glob), no)
    assert scan.reachable("file:/a/*") and scan.reachable("/a") and scan.reachable("hdfs://h:1/a")
    assert not scan.reachable("viewfs://store/a") and not scan.reachable("relative/*")
