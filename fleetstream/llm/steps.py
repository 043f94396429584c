"""Steps and buckets: numpy work over a corpus whose parts exchange sorted keys.

A step is some megabytes of input; it combines its own equal keys and sends
each bucket (a range of the key space) one row with its sorted keys.  A bucket
sees every step that holds a key of its range, and answers each in the order of
the keys sent, so answers need no keys.  With many more buckets than a step has
keys, this is a shuffle of single entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "bucket int, step long, kind int, body binary"
_NAMES = ["bucket", "step", "kind", "body"]


def packed(t: pa.Table) -> bytes:
    """A table as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def unpacked(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all().combine_chunks()


def squeezed(x: np.ndarray) -> bytes:
    """An array of 8-byte values, compressed by byte planes (rare high bytes cost little)."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)
    return np.int64(len(x)).tobytes() + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(x) else b"")


def unsqueezed(body: bytes, dtype=np.int64) -> np.ndarray:
    n = int(np.frombuffer(body, np.int64, 1)[0])
    if not n:
        return np.zeros(0, dtype)
    raw = pa.decompress(body[8:], 8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(dtype).ravel()


def bundle(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def unbundle(body: bytes) -> list[bytes]:
    n = int(np.frombuffer(body, np.int64, 1)[0])
    at = 8 * (n + 1) + np.r_[0, np.cumsum(np.frombuffer(body, np.int64, n, 8))]
    return [body[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]


def deltas(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys."""
    d = keys.copy()
    d[1:] -= keys[:-1]
    return squeezed(d)


def undeltas(body: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(body, np.uint64), dtype=np.uint64)


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of sorted keys begins, and the end."""
    place = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(place, np.arange(buckets + 1, dtype=np.uint64))


def batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=_NAMES)


def bodies(t: pa.Table) -> dict[int, list[tuple[int, int, bytes]]]:
    """kind -> (step, bucket, body), in that order."""
    out: dict[int, list] = {}
    for k, s, b, x in sorted(zip(*(t.column(n).to_pylist() for n in ("kind", "step", "bucket", "body")), strict=True),
                             key=lambda r: r[:3]):
        out.setdefault(k, []).append((s, b, x))
    return out


def apply_by(df: DataFrame, key: str, groups: int, work: Callable[[dict], Iterator[tuple] | list[tuple]], schema: str = SCHEMA) -> DataFrame:
    """``work`` on the rows of each key (as ``bodies`` gives them), over as many
    partitions as there are groups: a task's share stays the same as the corpus grows."""
    def run(t: pa.Table) -> pa.Table:
        from .common import lean
        lean()
        got = work(bodies(t))
        return got if isinstance(got, pa.Table) else pa.Table.from_batches([batch(list(got))])
    return df.repartition(groups, key).groupBy(key).applyInArrow(run, schema)
