"""Line dedup: repeated runs of lines keep their first copy only.

The corpus is one sequence of line ids for each document (lines with a word;
blank lines are passed over and stay).  Suffixes are ranked by distributed
prefix doubling: the rank of depth 1 is the class of the suffix's first line;
the rank of depth 2d is the class of the pair (rank of depth d here, rank of
depth d at the line d further on).  A class of depth d is an interval of the
suffix array in which every two neighbours share a prefix of d lines or more;
its name is the address (id, text hash, line) of its first suffix.  Suffixes
alone in their class share nothing longer, so they leave after each round, and
a round costs as much as what is still repeated.

Doubling ends at depth ``min_lines`` (two overlapping halves where that is no
power of two).  Deeper intervals lie inside these, and a maximal repeated run
is a chain of them: a line belongs to a later copy of some repeated run of at
least ``min_lines`` lines if and only if an interval of exactly that depth, of
which the suffix at hand isn't the first, covers it.  Such lines are deleted.

DataFrame operations only.  A frequent line is one class with many members:
its first address comes from a map-side combined minimum, and members get it
by a join whose large side Spark can split.

Defined cases: a null text has no lines and stays null; a text whose lines all
go becomes empty; lines are compared as they stand, with their blanks; null
ids sort first; rows that repeat an id and a text are one document and get the
same answer; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .quality import BLANKS, let

_ADDRESS = ["id", "key", "pos"]


def _key(text: str):
    return F.xxhash64(F.col(text), F.octet_length(text))


def line_sequence(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, pos, line_no, h1, h2): one row for each line with a word; pos
    counts these lines, line_no all lines, (h1, h2) identifies the line."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))),
                     lambda s: F.trim(s["line"], F.lit(BLANKS)) != "")
    return (docs.select(F.col(id).alias("id"), _key(text).alias("key"), F.posexplode(lines).alias("pos", "s"))
            .select("id", "key", "pos", "s.line_no", F.xxhash64("s.line").alias("h1"),
                    F.xxhash64(F.lit("second"), "s.line").alias("h2")))


def _classes(rows: DataFrame, by: list[str]) -> DataFrame:
    """Members of the classes with two suffixes or more, with the class's name."""
    address = F.struct(*_ADDRESS)
    named = (rows.groupBy(*by).agg(F.min(address).alias("name"), F.max(address).alias("last"))
             .filter("name < last").select(*by, "name"))
    return rows.join(named, by).select(*_ADDRESS, "name")


def _paired(rows: DataFrame, step: int) -> DataFrame:
    """Each suffix with its own rank and that of the suffix ``step`` lines on."""
    ahead = rows.select(F.col("id").alias("id2"), F.col("key").alias("key2"),
                        (F.col("pos") - step).alias("pos2"), F.col("name").alias("next"))
    return rows.join(ahead, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2"))
                     & (F.col("pos") == F.col("pos2"))).select(*_ADDRESS, "name", "next")


def repeated_runs(lines: DataFrame, min_lines: int = 2) -> DataFrame:
    """(id, key, pos, name): suffixes whose first ``min_lines`` lines occur
    elsewhere too, with the address of the first such suffix."""
    ranks = stored(_classes(lines, ["h1", "h2"]).dropDuplicates(_ADDRESS), "line-ranks")
    depth = 1
    while depth < min_lines:
        step = min(depth, min_lines - depth)
        pairs = stored(_paired(ranks, step).withColumnRenamed("name", "here"), "line-pairs")
        ranks = stored(_classes(pairs, ["here", "next"]), "line-ranks")
        depth += step
    return ranks


def removed_lines(docs: DataFrame, *, min_lines: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, gone): for each document with later copies, the numbers of the lines to delete."""
    lines = stored(line_sequence(docs, id=id, text=text), "lines")
    later = repeated_runs(lines, min_lines).filter(F.struct(*_ADDRESS) != F.col("name"))
    covered = (later.select("id", "key", F.explode(F.sequence(F.col("pos"), F.col("pos") + (min_lines - 1))).alias("pos"))
               .distinct())
    own = lines.select("id", "key", "pos", "line_no").withColumnsRenamed({"id": "id2", "key": "key2", "pos": "pos2"})
    return (covered.join(own, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2"))
                         & (F.col("pos") == F.col("pos2")))
            .groupBy("id", "key").agg(F.collect_set("line_no").alias("gone")))


def dedup_lines(docs: DataFrame, *, min_lines: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text less its deleted lines, and
    ``n_lines`` (with a word), ``n_removed``."""
    clash = {"n_lines", "n_removed"} & set(docs.columns)
    if clash:
        docs = docs.drop(*clash)
    gone = stored(removed_lines(docs, min_lines=min_lines, id=id, text=text), "lines-gone").withColumnsRenamed(
        {"id": "__id", "key": "__key", "gone": "__gone"})
    kept = let(F.split(text, "\n"), lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__gone")), lambda i: x[i]), "\n"))
    n_lines = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
                              lambda x: F.trim(x, F.lit(BLANKS)) != "")).cast("long")
    # always a shuffle join: the lists grow with the corpus, and one plan serves every size
    joined = docs.join(gone.hint("shuffle_hash"), F.col(id).eqNullSafe(F.col("__id")) & (_key(text) == F.col("__key")), "left")
    return joined.select(
        *(F.when(F.col("__gone").isNotNull(), kept).otherwise(F.col(c)).alias(c) if c == text else F.col(f"`{c}`")
          for c in docs.columns),
        n_lines.alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"))
