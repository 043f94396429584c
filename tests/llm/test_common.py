import os

import numpy as np
import pyarrow as pa
import pytest

from fleetstream.llm import common

from .conftest import LOWER, words


def test_stored_tables_are_released(spark):
    path = common.stored(spark.range(3), "t").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    common.release(spark)
    assert not os.path.exists(path)


def test_ranks(spark):
    """Places among equal values, also where one value fills most partitions."""
    df = spark.range(5000).selectExpr("case when id % 10 < 8 then 7 else cast(id % 5 as int) end as v", "(id * 7919) % 5000 as k")
    got = common.ranked(df.repartition(5), "v", ["k"], "ranks").collect()
    seen = {}
    for r in sorted(got, key=lambda r: (r.v, r.k)):
        assert r.rank == seen.get(r.v, 0)
        seen[r.v] = r.rank + 1
    assert len(got) == 5000 and common.ranked(df.limit(0), "v", ["k"], "ranks").collect() == []


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_word_arrays(rows, step):
    """Words, their hashes and windows do not depend on how texts are cut into steps."""
    texts = [r[1] for r in rows]
    known = {}
    for i, j, buf, off in common.text_steps(pa.array(texts, pa.string()), step):
        w = common.Words(buf, off, common.NOT_SPACE)
        h = common.word_hashes(w, lower=True)
        for k in range(j - i):
            a, z = int(w.first[k]), int(w.first[k + 1])
            want = words(texts[i + k])
            assert w.text(a, z).decode() == " ".join(want)
            for x, v in zip(want, h[a:z].tolist(), strict=True):
                assert known.setdefault(x.translate(LOWER), v) == v
    assert len(set(known.values())) == len(known)


def test_window_hashes():
    h = np.random.default_rng(0).integers(0, 2**63, 50, dtype=np.uint64)
    twice = common.window_hashes(np.concatenate([h, h]), 5)
    assert (twice[:46] == twice[50:]).all() and len(set(twice.tolist())) == 50
    assert len(common.window_hashes(h[:3], 5)) == 0
