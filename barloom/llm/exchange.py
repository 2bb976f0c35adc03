"""Which keys occur more than once in a corpus, found out by packs.

Every pack sends its distinct keys, sorted, cut to a number of bits that grows with the
corpus, and coded as gaps (3 to 4 bytes a key) to range buckets; a bucket adds up the packs'
counts and answers each pack with those of its keys that occur at least twice. A key
that a third of all documents hold costs each pack one entry, so no bucket is hot.
Cutting keys may let a few single ones look repeated; users treat the answer as a filter.
"""
from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import freeing, freeing_groups

#: Bytes of text whose keys make up one bucket (about).
BUCKET_BYTES = 12_000_000


def key_bits(total_bytes: int) -> int:
    """Bits of a cut key: 2^11 times as many values as the corpus has bytes."""
    return min(60, max(40, int(total_bytes).bit_length() + 11))


def bucket_count(total_bytes: int) -> int:
    return max(12, -(-int(total_bytes) // BUCKET_BYTES))


def coded(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def gaps_to_bytes(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct keys and their counts."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    wide = bool(len(gaps)) and int(gaps[1:].max(initial=0)) >= 1 << 32
    body = coded(gaps[1:] if wide else gaps[1:].astype(np.uint32))
    head = struct.pack("<?QQQ", wide, len(keys), int(keys[0]) if len(keys) else 0, len(body))
    return head + body + coded(counts.astype(np.uint32))


def gaps_from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide, n, first, size = struct.unpack_from("<?QQQ", data)
    at = struct.calcsize("<?QQQ")
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    gaps = np.frombuffer(zstandard.decompress(data[at:at + size]), np.uint64 if wide else np.uint32)
    keys = np.cumsum(np.concatenate([np.array([first], np.uint64), gaps.astype(np.uint64)]), dtype=np.uint64)
    return keys, np.frombuffer(zstandard.decompress(data[at + size:]), np.uint32)


def repeated_keys(packs: DataFrame, keys_of: Callable[[bytes], tuple[np.ndarray, np.ndarray]], bits: int, buckets: int) -> DataFrame:
    """pack, body: for every pack its (cut) keys whose counts over all packs sum up to two or more, with the sums.

    ``keys_of`` gives the sorted distinct 64-bit keys of a pack's blob and their counts.
    """
    width = -(-(1 << bits) // buckets)
    sent = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("body", pa.binary())])
    answered = pa.schema([("pack", pa.int64()), ("body", pa.binary())])

    def send(batches):
        for batch in batches:
            for pack, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = keys_of(blob)
                keys = keys >> np.uint64(64 - bits)
                keep = np.flatnonzero(np.diff(keys, prepend=np.uint64(1 << 63)) != 0)
                counts = np.add.reduceat(counts, keep) if len(keep) else counts[:0]
                keys = keys[keep]
                edges = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) * np.uint64(width))
                full = np.flatnonzero(edges[1:] > edges[:-1])
                yield pa.RecordBatch.from_arrays([
                    pa.array(full, pa.int32()), pa.array([pack] * len(full), pa.int64()),
                    pa.array([gaps_to_bytes(keys[edges[b]:edges[b + 1]], counts[edges[b]:edges[b + 1]]) for b in full], pa.binary())], schema=sent)

    def answer(rows: pa.Table) -> pa.Table:
        packs_, got = rows.column("pack").to_pylist(), [gaps_from_bytes(b) for b in rows.column("body").to_pylist()]
        keys, counts = np.concatenate([k for k, _ in got]), np.concatenate([c for _, c in got]).astype(np.int64)
        order = np.argsort(keys, kind="stable")  # runs that are sorted already are merged
        ordered = keys[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        sums = np.add.reduceat(counts[order], first)
        total = np.empty(len(keys), np.int64)
        total[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
        out, at = [], 0
        for k, _ in got:
            t = total[at:at + len(k)]
            at += len(k)
            often = t >= 2
            out.append(gaps_to_bytes(k[often], np.minimum(t[often], 0xFFFFFFFF)) if often.any() else None)
        some = [i for i, b in enumerate(out) if b is not None]
        return pa.table([pa.array([packs_[i] for i in some], pa.int64()), pa.array([out[i] for i in some], pa.binary())], schema=answered)

    keyed = packs.select("pack", "blob").mapInArrow(freeing(send), "bucket int, pack bigint, body binary")
    return keyed.groupBy("bucket").applyInArrow(freeing_groups(answer), "pack bigint, body binary")


def known_keys(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One pack's answers as sorted keys and sums."""
    got = [gaps_from_bytes(b) for b in bodies]
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    keys, sums = np.concatenate([k for k, _ in got]), np.concatenate([c for _, c in got])
    order = np.argsort(keys, kind="stable")
    return keys[order], sums[order]


def sums_of(hashes: np.ndarray, bits: int, keys: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The corpus count of each 64-bit key: the answered sum, or 1."""
    if not len(keys) or not len(hashes):
        return np.ones(len(hashes), np.int64)
    cut = hashes >> np.uint64(64 - bits)
    at = np.minimum(np.searchsorted(keys, cut), len(keys) - 1)
    return np.where(keys[at] == cut, sums[at].astype(np.int64), 1)


def corpus_bytes(packs: DataFrame) -> int:
    return packs.agg(F.sum("n_bytes")).first()[0] or 0
