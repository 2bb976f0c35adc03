"""Chat formatting on the token level.

A turn is ``<s>`` role ``[INST]`` text ``[/INST]`` ``</s>``. The segments between the
control marks are encoded separately and the marks are spliced in as reserved ids above
the vocabulary, so no text can produce one. Control strings inside texts are escaped
reversibly all the same (``<s>`` -> ``<\\s>``, ``<\\s>`` -> ``<\\\\s>``), so the formatted
text can be read back too. The loss mask covers the text of the trained role's turns and is
made of prefix sums over segment lengths.
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import arrow_schema, bound_batches, columns_batch

#: The control strings; their ids follow the vocabulary in this order.
CONTROLS = ("<s>", "[INST]", "[/INST]", "</s>")
BOS, OPEN, CLOSE, EOS = range(4)
TRAINED_ROLE = "assistant"
#: Names of the public vocabulary and of the package that holds it.
VOCABULARY = "byte_bpe_50k.tiktoken"

_ESCAPE = re.compile(r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])")
_UNESCAPE = re.compile(r"(<)\\(\\*)(/?s>)|(\[)\\(\\*)(/?INST\])")


def escape(text: str) -> str:
    """One more backslash inside every control string, with or without backslashes already there."""
    return _ESCAPE.sub(lambda m: f"{m[1] or m[4]}\\{m[2] if m[1] else m[5]}{m[3] or m[6]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: f"{m[1] or m[4]}{m[2] if m[1] else m[5]}{m[3] or m[6]}", text)


@lru_cache(maxsize=4)
def encoder(path: str):
    """(encoding, id of the first control mark) for a rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 2


def format_turn(role: str, text: str, path: str, trained: str) -> tuple[list[int], np.ndarray]:
    """Ids of one turn and its loss mask."""
    encoding, first = encoder(path)
    head, body = encoding.encode_ordinary(escape(role)), encoding.encode_ordinary(escape(text))
    segments = [[first + BOS], head, [first + OPEN], body, [first + CLOSE, first + EOS]]
    ends = np.cumsum([len(s) for s in segments])
    # +1 where the trained text begins and -1 where it ends; the running sum is the mask.
    steps = np.zeros(ends[-1] + 1, np.int8)
    if role == trained:
        steps[ends[2]] += 1
        steps[ends[3]] -= 1
    return [i for s in segments for i in s], np.cumsum(steps[:-1]).astype(np.int8)


def read_turn(ids: list[int], mask: np.ndarray, path: str) -> tuple[str, str, str, int]:
    """(role, text, text under the mask, characters of the formatted turn), from ids and mask alone."""
    encoding, first = encoder(path)
    at = {k: ids.index(first + k) for k in range(len(CONTROLS))}
    plain = lambda a, b: encoding.decode_bytes(ids[a:b]).decode("utf-8", "surrogatepass")
    head, body = plain(at[BOS] + 1, at[OPEN]), plain(at[OPEN] + 1, at[CLOSE])
    under = [i for i, m in zip(ids, mask, strict=True) if m]
    masked = encoding.decode_bytes(under).decode("utf-8", "surrogatepass")
    return unescape(head), unescape(body), unescape(masked), len(head) + len(body) + sum(map(len, CONTROLS))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def format_conversations(turns: DataFrame, path: str | None = None, trained: str = TRAINED_ROLE,
                         conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, role, text, ids, loss_mask (one byte per id).

    Null roles and texts are empty; a null turn comes first; rows of one turn number are kept
    all, ordered by role and text; a null conv_id is a conversation of its own. Other
    columns are ignored and an empty table gives no rows.
    """
    path = path or default_path()
    arrow = arrow_schema(turns.sparkSession, "conv_id bigint, turn bigint, role string, text string, ids array<int>, loss_mask binary")
    bound_batches(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turn(r, t, path, trained) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield columns_batch({n: batch.column(i) for i, n in enumerate(("conv_id", "turn", "role", "text"))}
                                | {"ids": [ids for ids, _ in made], "loss_mask": [m.tobytes() for _, m in made]}, arrow)

    plain = turns.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
                         F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, "conv_id bigint, turn bigint, role string, text string, ids array<int>, loss_mask binary")


def read_back(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """Per conversation, from ids and masks alone: turns, digests of turns and trained text, characters.

    Rows are sorted by conversation and turn within partitions and read as a stream, so a
    conversation of any length needs the memory of one turn and its running digests.
    """
    path = path or default_path()
    schema = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint, n_tokens bigint")
    arrow = arrow_schema(formatted.sparkSession, schema)
    names = [f.name for f in arrow]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for batch in batches:
            done: list[list] = []
            for conv, ids, mask in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        done.append(closed(current, state))
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, text, masked, chars = read_turn(ids, np.frombuffer(mask, np.int8), path)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[2] += len(masked)
                state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += chars
                state[5] += len(ids)
            if done:
                yield columns_batch(dict(zip(names, zip(*done, strict=True), strict=True)), arrow)
        if state is not None:
            yield columns_batch({n: [v] for n, v in zip(names, closed(current, state), strict=True)}, arrow)

    def closed(conv, s) -> list:
        return [conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5]]

    order = ["conv_id", "turn", "role", "text"]
    return (formatted.repartition("conv_id").sortWithinPartitions(*order)
            .select("conv_id", "ids", "loss_mask").mapInArrow(run, schema))
