"""Shards of near equal bytes; groups of equal texts stay together.

Longest-processing-time scheduling: groups sorted by size, largest first, each
to the least-loaded shard, found through a heap.  The heap works on a bounded
list.  A group of at least 1 / (shards * fine) of all bytes is scheduled by
itself (there are at most shards * fine such groups); the lighter ones are
hashed into shards * fine bundles, which are scheduled as one item each.  So
loads differ by about one bundle at most, unless one group alone is larger
than a shard's share.

Defined cases: a null or empty text has size 1 and belongs to the group of the
empty text; a null id is kept; repeated rows each get a slot; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, ship, stored


def lpt(items: list[tuple], shards: int) -> list[tuple]:
    """(weight, key) items -> (key, shard); ties go by key and by shard number."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for weight, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out.append((key, shard))
        heapq.heappush(heap, (load + weight, shard))
    return out


def shard_documents(docs: DataFrame, *, shards: int = 16, fine: int = 512,
                    id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard of each row."""
    spark = docs.sparkSession
    ship(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    base = stored(docs.select(
        F.col(id).alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.unhex(F.md5(body)).alias("group")), "shard-rows")
    groups = stored(base.groupBy("group").agg(F.sum("size").alias("weight")), "shard-groups")
    total = groups.agg(F.sum("weight")).first()[0] or 0
    n = shards * fine
    heavy = F.col("weight") * n >= total
    bundle = F.pmod(F.xxhash64("group"), F.lit(n)).cast("int")
    # at most n heavy groups and n bundles reach the driver
    own = [(r["weight"], (0, bytes(r["group"]))) for r in groups.filter(heavy).collect()]
    rest = [(r["weight"], (1, r["bundle"])) for r in groups.filter(~heavy).groupBy(bundle.alias("bundle"))
            .agg(F.sum("weight").alias("weight")).collect()]
    placed = lpt(own + rest, shards)
    groups_at = spark.createDataFrame([(bytearray(k[1]), s) for k, s in placed if k[0] == 0], "`group` binary, own int")
    bundles_at = spark.createDataFrame([(k[1], s) for k, s in placed if k[0] == 1], "bundle int, shared int")
    rows = (base.withColumn("bundle", bundle)
            .join(F.broadcast(groups_at), "group", "left")
            .join(F.broadcast(bundles_at), "bundle", "left")
            .select("id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard")))
    return (ranked(rows, "shard", ["id", "text_crc32"], "shard-slots")
            .select(F.col("id").alias(id), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
