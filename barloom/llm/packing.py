"""Best-fit decreasing packing of tokenised documents into sequences of fixed capacity.

Lengths are whole numbers up to the capacity, so the packing is decided on counts: how many
pieces have each length, how many open sequences have each remaining capacity. A segment
tree over remaining capacities finds the tightest open one in logarithmic time, and all
sequences of that capacity are filled together. The result is exactly that of placing the
pieces one by one, longest first, each into the tightest sequence that holds it; its cost
depends on the capacity, not on the number of documents. The decision is a small table
of rules (which ranks of a length go where) that every row is then looked up in.
"""
from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.bpe import cut
from barloom.llm.common import map_batches
from barloom.session import cut_lineage

CAPACITY = 2048
#: The id that ends a document.
END_ID = 0
#: Rows of one length that are numbered together.
RANK_ROWS = 2_000

#: Texts of these signs alone are split alike by both tokenizer libraries.
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ɏ]+")


def byte_of_letter() -> dict[str, int]:
    """The byte-level alphabet: visible bytes stand for themselves, the others for letters from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ChunkTokenizer:
    """Ids as little-endian 32-bit bytes.

    A text is split into stretches at safe cuts: those of plain signs go through the same vocabulary's
    ranks in the ``tiktoken`` library, each in one call (a tenth of the time), all others through ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        byte, special = byte_of_letter(), {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(byte[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in special}
        self.plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = []
        other: list[tuple[list[bytes], int, str]] = []
        for text in texts:
            parts: list[bytes] = []
            out.append(parts)
            for stretch, plain in stretches(text):
                if plain:
                    parts.append(self.plain_ids(stretch))
                else:
                    other.append((parts, len(parts), stretch))
                    parts.append(b"")
        for (parts, at, _), e in zip(other, self.tokenizer.encode_batch_fast([s for _, _, s in other], add_special_tokens=False), strict=True):
            parts[at] = np.asarray(e.ids, "<u4").tobytes()
        return [b"".join(parts) for parts in out]

    def plain_ids(self, text: str) -> bytes:
        return np.asarray(self.plain.encode_ordinary(text), "<u4").tobytes()


def stretches(text: str) -> list[tuple[str, bool]]:
    """The text in stretches between safe cuts, and whether each consists of plain signs."""
    if not text:
        return []
    if _PLAIN.fullmatch(text):
        return [(text, True)]
    return [("".join(chunks), plain) for plain, chunks in groupby(cut(text), lambda c: _PLAIN.fullmatch(c) is not None)]


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones at the end, the remainder first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenise_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every row; null text is empty (the end id alone)."""
    end = np.asarray([END_ID], "<u4").tobytes()

    def pieces(batch: pa.RecordBatch):
        tok = chunk_tokenizer(path)
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for lo in range(0, len(texts), 500):
            for doc, ids in zip(doc_ids[lo:lo + 500], tok.encode(texts[lo:lo + 500]), strict=True):
                ids += end
                for piece, (start, length) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                    for key, value in zip(out, (doc, piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])), strict=True):
                        out[key].append(value)
        return out

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(plain, pieces, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: how many open sequences have each."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.sum = [0] * (2 * self.size)

    def add(self, remaining: int, n: int) -> None:
        at = remaining + self.size
        while at:
            self.sum[at] += n
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that some sequence has."""
        at = length + self.size
        if self.sum[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.sum[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.sum[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_rules(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(rules, sequences): a rule is (length, first rank, first sequence, pieces per sequence, offset).

    Ranks of a length from a rule's first one up to the next rule's go, ``pieces per
    sequence`` at a time, to consecutive sequences, side by side from the offset on.
    """
    tree = CapacityTree(capacity)
    # Remaining capacity -> runs of sequences that have it: [first, count].
    open_runs: dict[int, list[list[int]]] = {}
    rules, n_sequences = [], 0

    def put(remaining: int, first: int, count: int) -> None:
        if count:
            open_runs.setdefault(remaining, []).append([first, count])
            tree.add(remaining, count)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                # All that is left opens new sequences, each filled with as many as it holds.
                remaining, per = capacity, capacity // length
                first, have = n_sequences, -(-left // per)
                n_sequences += have
            else:
                first, have = open_runs[remaining].pop()
                tree.add(remaining, -have)
            # A sequence that has taken one piece is the tightest one while it holds more.
            per = remaining // length
            full, rest = divmod(min(left, have * per), per)
            rules.append((length, rank, first, per, capacity - remaining))
            put(remaining - per * length, first, full)
            if rest:
                put(remaining - rest * length, first + full, 1)
            untouched = full + (rest > 0)
            put(remaining, first + untouched, have - untouched)
            rank += full * per + rest
            left -= full * per + rest
    return rules, n_sequences


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, length and ids_crc32.

    The driver holds one count per length (at most ``capacity``) and the rules made of
    them. Ranks come from windows over hashed parts of a length and running sums of the
    parts' counts, so that no length, however frequent, is numbered in one task. Rows
    alike in all columns are told apart by nothing and may swap places.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rules, _ = best_fit_rules(counts, capacity)
    parts = max(1, -(-max(counts.values(), default=0) // RANK_ROWS))
    parted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (parted.groupBy("length", "part").agg(F.count("*").alias("n"))
               .select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (parted.withColumn("inside", F.row_number().over(inside)).join(offsets, ["length", "part"])
              .withColumn("rank", F.col("before") + F.col("inside") - 1))
    # The rules number a few per length, whatever the number of rows.
    shared = pieces.sparkSession.sparkContext.broadcast(np.array(rules or [(0, 0, 0, 1, 0)], np.int64))
    names = ("doc_id", "piece", "start", "length", "ids_crc32")

    def place(batch: pa.RecordBatch):
        table = shared.value
        length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        keys = table[:, 0] * np.int64(-1)  # lengths fall along the table
        lo, hi = np.searchsorted(keys, -length, "left"), np.searchsorted(keys, -length, "right")
        at = lo.copy()
        for i in range(len(length)):
            at[i] = lo[i] + np.searchsorted(table[lo[i]:hi[i], 1], rank[i], "right") - 1
        _, first_rank, first, per, offset = table[at].T
        step, slot = np.divmod(rank - first_rank, per)
        return {n: batch.column(i) for i, n in enumerate(names)} | {"sequence_id": first + step, "offset": offset + slot * length}

    return map_batches(ranked.select(*names, "rank"), place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each row's ids end with the end id; only documents longer than the capacity are cut.
    Null text is empty, repeated rows are packed each, an empty table gives no rows, other
    columns are ignored. The pieces are written once, so texts are tokenised once.
    """
    return pack_pieces(cut_lineage(tokenise_pieces(docs, path, capacity, id_col, text_col)), capacity)
