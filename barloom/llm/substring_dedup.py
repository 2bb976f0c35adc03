"""Exact substring deduplication with range-partitioned, locally sorted suffixes.

A suffix counts by its first ``LENGTH`` bytes (a window). Its leading token is the
25-byte gram of the smallest hash in the window, which is the same wherever the window
occurs. Consecutive windows of one document with the same token form a run; the runs whose token
occurs in two documents or more are the only ones that can repeat.

1. Packs of documents ask which tokens occur in several documents (``exchange``).
2. Runs with such tokens go, as bytes, to buckets: ranges of tokens between sampled
   splitters. Equal runs of a pack go once, under their smallest document. A token found
   very often is split further, by the hash of each window.
3. A bucket sorts its distinct suffixes by multikey quicksort, eight bytes a character
   (three-way splits are done level by level for all groups at once), and knows for every group of
   equal ones its smallest document. Buckets hold whole tokens, so no group crosses a boundary.
4. Each pack learns which of its windows start in a smaller document, and removes what
   those cover.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from barloom.llm.common import freeing, freeing_groups, kept, mix, pack_documents, text_bytes, unpack_table
from barloom.llm.exchange import bucket_count, coded, corpus_bytes, gaps_from_bytes, key_bits, known_keys, repeated_keys, sums_of

LENGTH, GRAM = 50, 25
#: Window starts hashed at a time, and in a run at most (the bits of a mask).
BLOCK, RUN = 1 << 18, 32
#: A token of more documents than this is split by window.
FREQUENT = 20_000
#: Tokens sampled for the splitters (about), and suffix buckets per bucket of tokens.
SAMPLE, FINER = 40_000, 5

_B = np.uint64(0x100000001B3)


def power(k: int) -> np.uint64:
    return np.uint64(pow(int(_B), k, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all 25-byte grams, by doubling, well mixed."""
    h1 = data.astype(np.uint64) + np.uint64(1)
    h2 = h1[:-1] * _B + h1[1:]
    h4 = h2[:-2] * power(2) + h2[2:]
    h8 = h4[:-4] * power(4) + h4[4:]
    h16 = h8[:-8] * power(8) + h8[8:]
    n = len(data) - GRAM + 1
    return mix(h16[:n] * power(9) + h8[16:16 + n] * power(1) + h1[24:24 + n])


def window_tokens(data: np.ndarray) -> np.ndarray:
    """The smallest gram hash of every 50-byte window."""
    m = gram_hashes(data)
    for step in (1, 2, 4, 8):
        m = np.minimum(m[:-step], m[step:])
    span = LENGTH - GRAM + 1 - 16
    return np.minimum(m[:-span], m[span:])


@dataclass
class Runs:
    """Consecutive windows of a document with one token: document, first window start, windows, token."""
    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    token: np.ndarray

    def pick(self, which: np.ndarray) -> Runs:
        return Runs(self.doc[which], self.start[which], self.length[which], self.token[which])


def find_runs(data: np.ndarray, ends: np.ndarray) -> Runs:
    """Runs of all documents of a pack, whose bytes lie one after another up to ``ends``."""
    found = []
    for lo in range(0, len(data) - LENGTH + 1, BLOCK):
        part = data[lo:lo + BLOCK + LENGTH - 1]
        token = window_tokens(part)
        at = np.arange(lo, lo + len(token))
        doc = np.searchsorted(ends, at, "right")
        valid = at + LENGTH <= ends[doc]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])])
        start = np.flatnonzero(new)
        # Windows that reach past their document end a run; they are its last ones.
        length = np.add.reduceat(valid.astype(np.int64), start)
        start, length = start[length > 0], length[length > 0]
        pieces = -(-length // RUN)
        which = np.repeat(np.arange(len(start)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = start[which] + nth * RUN
        # Smallest hashes lie near 0; mixed again they are spread evenly over the buckets.
        found.append(Runs(doc[first], first + lo, np.minimum(length[which] - nth * RUN, RUN), mix(token[first])))
    if not found:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, np.zeros(0, np.uint64))
    return Runs(*(np.concatenate([getattr(r, f) for r in found]) for f in ("doc", "start", "length", "token")))


@dataclass
class Pack:
    """Documents of a pack: ids, texts, joined bytes, ends, and which ids are known."""
    table: pa.Table
    ids: np.ndarray
    known: np.ndarray
    raw: bytes
    data: np.ndarray
    ends: np.ndarray


def open_pack(blob: bytes) -> Pack:
    table = unpack_table(blob)
    texts, ids = text_bytes(table.column("text")), table.column("doc_id").to_pylist()
    raw = b"".join(texts)
    return Pack(table, np.array([i if i is not None else 0 for i in ids], np.int64), np.array([i is not None for i in ids], bool), raw,
                np.frombuffer(raw, np.uint8), np.cumsum([len(t) for t in texts]).astype(np.int64))


def token_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of a pack and in how many of its documents each occurs."""
    pack = open_pack(blob)
    runs = find_runs(pack.data, pack.ends)
    runs = runs.pick(pack.known[runs.doc])
    order = np.lexsort((runs.doc, runs.token))
    token, doc = runs.token[order], runs.doc[order]
    fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])]) if len(token) else np.zeros(0, bool)
    return np.unique(token[fresh], return_counts=True)


@dataclass
class Contents:
    """Distinct run contents of a pack: bytes, smallest document, bucket; and the runs with their content."""
    pieces: list[bytes]
    doc_id: np.ndarray
    bucket: np.ndarray
    runs: Runs
    content: np.ndarray


def candidate_contents(pack: Pack, keys: np.ndarray, sums: np.ndarray, bits: int, splitters: np.ndarray) -> Contents:
    runs = find_runs(pack.data, pack.ends)
    runs = runs.pick(pack.known[runs.doc])
    often = sums_of(runs.token, bits, keys, sums)
    hot = runs.pick(often > FREQUENT)
    runs = runs.pick((often >= 2) & (often <= FREQUENT))
    if len(hot.doc):
        each = np.repeat(np.arange(len(hot.doc)), hot.length)
        start = hot.start[each] + np.arange(len(each)) - np.repeat(np.cumsum(hot.length) - hot.length, hot.length)
        token = np.fromiter((xxhash.xxh3_64_intdigest(pack.raw[s:s + LENGTH]) for s in start.tolist()), np.uint64, len(start))
        single = Runs(hot.doc[each], start, np.ones(len(each), np.int64), token)
        runs = Runs(*(np.concatenate([getattr(runs, f), getattr(single, f)]) for f in ("doc", "start", "length", "token")))
    numbers: dict[bytes, int] = {}
    raw, extra = pack.raw, LENGTH - 1
    content = np.fromiter((numbers.setdefault(raw[s:s + n + extra], len(numbers)) for s, n in zip(runs.start.tolist(), runs.length.tolist(), strict=True)),
                          np.int64, len(runs.doc))
    smallest = np.full(len(numbers), np.iinfo(np.int64).max)
    np.minimum.at(smallest, content, pack.ids[runs.doc])
    token = np.zeros(len(numbers), np.uint64)
    token[content] = runs.token
    return Contents(list(numbers), smallest, np.searchsorted(splitters, token, "right"), runs, content)


def equal_windows(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for every window such that equal windows share it: multikey quicksort, level by level."""
    group = np.zeros(len(starts), np.int64)
    open_ = np.arange(len(starts))
    base = 0
    for depth in (0, 8, 16, 24, 32, 40, LENGTH - 8):
        word = words_at(data, starts[open_] + depth)
        order = np.lexsort((word, group[open_])) if depth else np.argsort(word, kind="stable")
        g, w, members = group[open_][order], word[order], open_[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])]) if len(g) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        group[members] = base + number
        base += len(members)
        # Groups of one are in place; the others are split by the next character.
        size = np.bincount(number) if len(number) else number
        open_ = np.sort(members[size[number] > 1]) if len(number) else members
        if not len(open_):
            break
    return np.unique(group, return_inverse=True)[1]


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes at each place as one big-endian number."""
    word = np.zeros(len(at), np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | data[at + i].astype(np.uint64)
    return word


def settle(bodies: list[bytes]) -> list[bytes]:
    """One bucket: per pack a mask per content, with a bit for each window that starts in a smaller document."""
    got = [read_contents(b) for b in bodies]
    numbers: dict[bytes, int] = {}
    entry = [np.fromiter((numbers.setdefault(p, len(numbers)) for p in pieces), np.int64, len(pieces)) for pieces, _ in got]
    distinct = list(numbers)
    lengths = np.array([len(p) for p in distinct], np.int64)
    first = np.cumsum(lengths) - lengths
    windows = lengths - (LENGTH - 1)
    of = np.repeat(np.arange(len(distinct)), windows)
    slot = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    smallest = np.full(len(distinct), np.iinfo(np.int64).max)
    for e, (_, ids) in zip(entry, got, strict=True):
        np.minimum.at(smallest, e, ids)
    same = equal_windows(np.frombuffer(b"".join(distinct), np.uint8), first[of] + slot)
    least = np.full(int(same.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, same, smallest[of])
    table = np.full((len(distinct), RUN), np.iinfo(np.int64).max)
    table[of, slot] = least[same]
    bit = np.uint32(1) << np.arange(RUN, dtype=np.uint32)
    return [coded(((table[e] < ids[:, None]) * bit).sum(1, dtype=np.uint32)) for e, (_, ids) in zip(entry, got, strict=True)]


def write_contents(pieces: list[bytes], ids: np.ndarray) -> bytes:
    """Lengths, document ids and bytes, compressed."""
    lengths = np.array([len(p) for p in pieces], np.uint8)
    return b"".join([len(pieces).to_bytes(8, "little"), zstandard.compress(lengths.tobytes() + ids.astype(np.int64).tobytes() + b"".join(pieces), 3)])


def read_contents(body: bytes) -> tuple[list[bytes], np.ndarray]:
    n = int.from_bytes(body[:8], "little")
    raw = zstandard.decompress(body[8:])
    ends = np.cumsum(np.frombuffer(raw, np.uint8, n).astype(np.int64)) + 9 * n
    starts = [9 * n, *ends[:-1].tolist()]
    return [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=True)], np.frombuffer(raw, np.int64, n, n)


def covered_bytes(pack: Pack, contents: Contents, masks: np.ndarray) -> np.ndarray:
    """Which bytes of the pack are covered by a window that starts in a smaller document."""
    runs = contents.runs
    later = pack.ids[runs.doc] > contents.doc_id[contents.content]
    mask = np.where(later, np.uint32(0xFFFFFFFF), masks[contents.content])
    steps = np.zeros(len(pack.data) + 1, np.int32)
    for bit in range(RUN):
        at = runs.start[(runs.length > bit) & ((mask >> np.uint32(bit)) & np.uint32(1) == 1)] + bit
        steps[at] += 1
        steps[at + LENGTH] -= 1
    return np.cumsum(steps[:-1]) > 0


def whole_characters(data: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Covered bytes less those of characters that are covered in part only."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(starts):
        return covered
    all_of = np.logical_and.reduceat(covered, starts)
    return np.repeat(all_of, np.diff(np.append(starts, len(data))))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with the kept text and carried columns if asked.

    A byte goes if a 50-byte string over it also starts in a row of a smaller doc_id; all
    strings are judged on the input. Null text is empty; rows of one doc_id do
    not remove each other's bytes; a row with a null id is kept whole and removes nothing; an
    empty table gives no rows. The kept text keeps characters of which a byte is kept,
    so that it stays valid UTF-8; the digest is of the remaining bytes themselves.
    """
    packs = pack_documents(docs, id_col, text_col, carry)
    total = corpus_bytes(packs)
    bits, buckets = key_bits(total), bucket_count(total)
    answers = kept(repeated_keys(packs, token_counts, bits, buckets))
    splitters = sampled_splitters(answers, bits, FINER * buckets, max(1, total // 13 // SAMPLE))
    sent = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("body", pa.binary())])

    def send(pack_rows: pa.Table, told: pa.Table) -> pa.Table:
        keys, sums = known_keys(told.column("body").to_pylist())
        out: list[tuple] = []
        for number, blob in zip(pack_rows.column("pack").to_pylist(), pack_rows.column("blob").to_pylist(), strict=True):
            c = candidate_contents(open_pack(blob), keys, sums, bits, splitters)
            order = np.argsort(c.bucket, kind="stable")
            edges = np.flatnonzero(np.diff(c.bucket[order], prepend=-1))
            for part in np.split(order, edges[1:]) if len(order) else []:
                out.append((int(c.bucket[part[0]]), number, write_contents([c.pieces[i] for i in part.tolist()], c.doc_id[part])))
        return pa.table([pa.array([r[i] for r in out], sent.field(i).type) for i in range(3)], schema=sent)

    def sort_bucket(rows: pa.Table) -> pa.Table:
        return pa.table([rows.column("pack"), rows.column("bucket"), pa.array(settle(rows.column("body").to_pylist()), pa.binary())], names=["pack", "bucket", "masks"])

    by_pack = packs.select("pack", "blob").groupBy("pack")
    suffixes = by_pack.cogroup(answers.groupBy("pack")).applyInArrow(freeing_groups(send), "bucket int, pack bigint, body binary")
    masks = suffixes.groupBy("bucket").applyInArrow(freeing_groups(sort_bucket), "pack bigint, bucket int, masks binary")
    told_all = answers.select("pack", "body", F.lit(None).cast("int").alias("bucket")).unionByName(
        masks.select("pack", F.col("masks").alias("body"), "bucket"))

    fields = [StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("n_removed", LongType()),
              StructField("n_spans", LongType()), StructField("kept_sha256", StringType())]
    if with_text:
        fields += [StructField("kept", BinaryType())] + [StructField(f"_{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    schema = StructType(fields)

    def remove(pack_rows: pa.Table, told: pa.Table) -> pa.Table:
        whole = told.column("bucket").to_pylist()
        bodies = told.column("body").to_pylist()
        keys, sums = known_keys([b for b, w in zip(bodies, whole, strict=True) if w is None])
        by_bucket = {w: np.frombuffer(zstandard.decompress(b), np.uint32) for b, w in zip(bodies, whole, strict=True) if w is not None}
        tables = []
        for blob in pack_rows.column("blob").to_pylist():
            pack = open_pack(blob)
            c = candidate_contents(pack, keys, sums, bits, splitters)
            own = np.zeros(len(c.pieces), np.uint32)
            for bucket in np.unique(c.bucket).tolist():
                own[c.bucket == bucket] = by_bucket[bucket]
            tables.append(documents_table(pack, covered_bytes(pack, c, own), with_text, len(carry)))
        return pa.concat_tables(tables) if tables else None

    done = by_pack.cogroup(told_all.groupBy("pack")).applyInArrow(freeing_groups(remove), schema)
    if not with_text:
        return done
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept").cast("string").alias("kept_text"),
                       *(F.col(f"_{i}").alias(c) for i, c in enumerate(carry)))


def documents_table(pack: Pack, covered: np.ndarray, with_text: bool, carried: int) -> pa.Table:
    starts = np.concatenate([[0], pack.ends[:-1]]).astype(np.int64)
    rising = covered & ~np.concatenate([[False], covered[:-1]])
    rising[starts[(starts < len(covered))]] = covered[starts[starts < len(covered)]]
    cut = whole_characters(pack.data, covered) if with_text else covered
    n_removed, n_spans, digests, kept = [], [], [], []
    for a, b in zip(starts.tolist(), pack.ends.tolist(), strict=True):
        gone = covered[a:b]
        n_removed.append(int(np.count_nonzero(gone)))
        n_spans.append(int(np.count_nonzero(rising[a:b])))
        digests.append(hashlib.sha256(pack.data[a:b][~gone].tobytes() if n_removed[-1] else pack.raw[a:b]).hexdigest())
        if with_text:
            kept.append(pack.data[a:b][~cut[a:b]].tobytes())
    columns = [pack.table.column("doc_id"), pa.array(pack.ends - starts, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if with_text:
        columns += [pa.array(kept, pa.binary())] + [pack.table.column(f"_{i}") for i in range(carried)]
        names += ["kept"] + [f"_{i}" for i in range(carried)]
    return pa.table(columns, names=names)


def sampled_splitters(answers: DataFrame, bits: int, buckets: int, stride: int) -> np.ndarray:
    """Bucket bounds between tokens, from about one in ``stride`` (token, pack) pairs; the driver holds the sample only."""
    def take(batches):
        for batch in batches:
            for pack, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, _ = gaps_from_bytes(body)
                keys = keys[mix(keys ^ np.uint64(pack)) % np.uint64(stride) == 0] << np.uint64(64 - bits)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["token"])

    sample = np.sort(answers.select("pack", "body").mapInArrow(freeing(take), "token bigint").toArrow().column("token").to_numpy().view(np.uint64))
    if not len(sample):
        return np.zeros(0, np.uint64)
    at = np.linspace(0, len(sample) - 1, buckets + 1)[1:-1].astype(np.int64)
    return np.unique(sample[at])
