"""Documents that open with one header and then differ."""
import random

import numpy as np
import pyarrow as pa

from fleetstream.llm import substring_dedup as sd

from .conftest import as_multiset, frame
from .test_dedup import substrings_brute


def headed(n, seed=3):
    rng = random.Random(seed)
    header = " ".join(f"h{k}" for k in range(19))
    return [(i, f"{header} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)), "en", "s") for i in range(n)]


def test_no_group_holds_a_header():
    """Suffixes with one prefix and different paths are spread over the groups."""
    rows, buckets = headed(3000), 32
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()),
                                        pa.array([r[1] for r in rows])], names=["part", "id", "text"])
    sent, = sd._send_texts([batch])
    out = sd._suffixes(20, buckets)(pa.Table.from_batches([sent])).to_pylist()
    size = np.bincount([r["bucket"] for r in out if r["kind"] == sd.SUFFIXES],
                       [len(r["body"]) // sd._SUFFIX.itemsize for r in out if r["kind"] == sd.SUFFIXES], buckets)
    assert size.sum() >= len(rows) and size.max() <= 1.5 * size.mean()


def test_header(spark):
    rows = headed(60)
    rows += [(100 + i, t + " " + rows[i + 1][1], "en", "s") for i, t, *_ in rows[:20]]
    got = sd.dedup_substrings(frame(spark, rows)).collect()
    assert as_multiset(got) == as_multiset(substrings_brute(rows, 20))
