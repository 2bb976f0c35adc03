"""Byte-level BPE by a lazily determinised transducer, and streaming decode.

The encoding of a text's prefix is unique, and its last token is the one token that ends
there and may follow the encoding of what precedes it. A transducer state therefore
holds, for every place where an unfinished token may have begun, the token's bytes so far
and the tokens of the encoding up to that place. Tokens that all these hypotheses agree on
are emitted at once, which happens after a bounded lookahead (the longest token); the rest
stays in the state. States are made when first reached and remembered, so the transducer
is determinised only where texts lead; the memory for states is bounded.
"""
from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import map_batches, text_bytes

#: States, pairs, and chunks and pieces (together) remembered by one worker.
STATES, PAIRS, CHUNKS = 200_000, 400_000, 800_000


class Vocabulary:
    """Token bytes, ranks and a byte trie."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        # trie[node] maps a byte to the next node; ends[node] is the token that ends there.
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        for token, rank in self.ranks.items():
            node = 0
            for b in token:
                step = self.trie[node].get(b)
                if step is None:
                    step = self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(None)
                node = step
            self.ends[node] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.halves:
            halves = merge_by_rank(self.ranks, self.tokens[token], 2)
            self.halves[token] = (self.ranks[halves[0]], self.ranks[halves[1]]) if len(halves) == 2 else None
        return self.halves[token]

    def stand_apart(self, a: int, b: int) -> bool:
        """Whether a and b side by side stay two tokens.

        Merges are undone from the latest on, on whichever side is younger (the right one if
        both are the same token, as the left was made first). While two neighbours at the
        boundary exist together, a merge of both of a rank before the next event would have
        happened. ``before`` bounds that rank.
        """
        before = len(self.tokens) + 256
        while True:
            crossing = self.ranks.get(self.tokens[a] + self.tokens[b])
            if crossing is not None and crossing < before:
                return False
            of_a, of_b = self.parts(a), self.parts(b)
            if of_a is None and of_b is None:
                return True
            if of_b is None or of_a is not None and a > b:
                before, a = a, of_a[1]
            else:
                before, b = b + 1, of_b[0]


def merge_by_rank(ranks: dict[bytes, int], piece: bytes, until: int = 1) -> list[bytes]:
    """The definition: join the lowest-ranked adjacent pair, leftmost first, until none (or ``until`` parts) is left."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > until:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            break
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


#: Keys of a state's own entries, beside its bytes: its hypotheses, and the tokens due if the piece ends here.
OWN, FINAL = -1, -2


class Transducer:
    """Encodes pieces; a state maps a byte to (next state, tokens emitted)."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.may_follow: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, dict] = {}
        # A hypothesis: (trie node of the unfinished token, last token before it, tokens not yet emitted).
        self.start = self.state(((0, None, ()),))

    def state(self, hypotheses: tuple) -> dict:
        state = self.states.get(hypotheses)
        if state is None:
            # The hypothesis at the trie's root is the encoding of all that was read.
            state = self.states[hypotheses] = {OWN: hypotheses, FINAL: hypotheses[-1][2]}
        return state

    def follows(self, last: int | None, token: int) -> bool:
        """Whether the two tokens' joint bytes are encoded as just these two."""
        if last is None:
            return True
        known = self.may_follow.get((last, token))
        if known is None:
            if len(self.may_follow) > PAIRS:
                self.may_follow.clear()
            known = self.may_follow[last, token] = self.v.stand_apart(last, token)
        return known

    def step(self, state: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        """Work out a transition that has not been taken before."""
        trie, ends = self.v.trie, self.v.ends
        going, ended = [], None
        for node, last, held in state[OWN]:
            node = trie[node].get(byte)
            if node is None:
                continue
            token = ends[node]
            if ended is None and token is not None and self.follows(last, token):
                ended = (0, token, (*held, token))
            if trie[node]:
                going.append((node, last, held))
        if ended is None:
            raise ValueError("the vocabulary lacks a single byte")
        # Emit what all hypotheses agree on.
        agreed = ended[2]
        shared = len(agreed)
        for _, _, held in going:
            shared = min(shared, len(held))
            for i in range(shared):
                if held[i] != agreed[i]:
                    shared = i
                    break
            if not shared:
                break
        going.append(ended)
        if shared:
            going = [(n, last, held[shared:]) for n, last, held in going]
        made = state[byte] = (self.state(tuple(going)), agreed[:shared])
        return made

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > STATES:
            self.reset()
        out: list[int] = []
        state = self.start
        for b in piece:
            made = state.get(b) or self.step(state, b)
            state = made[0]
            if made[1]:
                out += made[1]
                if len(self.states) > 4 * STATES:
                    state = self.renew(state)
        out += state[FINAL]
        return out

    def renew(self, state: dict) -> dict:
        """Forget all states but the current one (in the midst of a very long piece)."""
        self.reset()
        return self.state(state[OWN])


#: A state of the UTF-8 machine: (bytes of the unfinished character, bytes still needed, lowest and highest next byte).
CLEAN = (b"", 0, 0x80, 0xBF)
BAD = "\ufffd"


def utf8_step(state: tuple, chunk: bytes) -> tuple[tuple, str]:
    """Feed bytes to the UTF-8 machine: (next state, characters completed).

    Bytes that cannot be part of a character are replaced as soon as that is known.
    """
    seen, need, low, high = state
    out = []
    for b in chunk:
        if need and not low <= b <= high:
            out.append(BAD)
            seen, need = b"", 0
        if need:
            seen, need, low, high = seen + bytes((b,)), need - 1, 0x80, 0xBF
            if not need:
                out.append(seen.decode("utf-8"))
                seen = b""
        elif b < 0x80:
            out.append(chr(b))
        elif 0xC2 <= b <= 0xF4:
            seen, need = bytes((b,)), 1 if b < 0xE0 else 2 if b < 0xF0 else 3
            low, high = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80), {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
        else:
            out.append(BAD)
    return (seen, need, low, high) if need else CLEAN, "".join(out)


class StreamDecoder:
    """Text from token ids as they come; the machine's moves by (state, token) are remembered.

    Between characters (the usual state) a token has one table entry; other states are few.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.state = tokens, CLEAN
        self.moves: dict[tuple, dict[int, tuple[tuple, str]]] = {}

    def push(self, ids: list[int]) -> str:
        out, state, moves = [], self.state, self.moves
        row = moves.setdefault(state, {})
        for i in ids:
            move = row.get(i)
            if move is None:
                move = row[i] = utf8_step(state, self.tokens[i])
            out.append(move[1])
            if move[0] is not state:
                state = move[0]
                row = moves.setdefault(state, {})
        self.state = state
        return "".join(out)

    def close(self) -> str:
        left, self.state = self.state, CLEAN
        return BAD if left[1] else ""


class Remembered:
    """At most ``limit`` results in two halves: when the new one is full, it becomes the old one."""

    def __init__(self, limit: int, longest: int = 64):
        self.limit, self.longest = limit // 2, longest
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def look(self, key: str) -> tuple[int, ...] | None:
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.keep(key, value)
        return value

    def keep(self, key: str, value: tuple[int, ...]) -> tuple[int, ...]:
        # Long keys are rare and not worth their memory.
        if len(key) <= self.longest:
            if len(self.new) >= self.limit:
                self.old, self.new = self.new, {}
            self.new[key] = value
        return value


#: Chunks that are one piece whatever follows: an optional space and letters.
_ONE_PIECE = re.compile("[ ]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch


class Encoder:
    """Whole texts: chunks between safe cuts, pieces by the pattern, tokens by the transducer.

    A piece standing alone is its own only piece, so chunks and pieces share one memory.
    """

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(path)
        self.transducer = Transducer(self.vocabulary)
        self.pieces = regex.compile(pattern)
        # The short way holds for patterns that keep letters together.
        self.whole = _ONE_PIECE if self.pieces.findall(" aZé") == [" aZé"] else lambda chunk: None
        self.known = Remembered(CHUNKS)
        self.names = {rank: str(rank) for rank in self.vocabulary.tokens}
        self.decoder = StreamDecoder(self.vocabulary.tokens)

    def piece(self, piece: str) -> tuple[int, ...]:
        known = self.known.look(piece)
        return known if known is not None else self.known.keep(piece, tuple(self.transducer.encode(piece.encode("utf-8", "surrogatepass"))))

    def chunk(self, chunk: str) -> tuple[int, ...]:
        if self.whole(chunk):
            return self.piece(chunk)
        known = self.known.look(chunk)
        if known is not None:
            return known
        pieces = self.pieces.findall(chunk)
        if len(pieces) == 1:
            return self.piece(chunk)
        out: list[int] = []
        for piece in pieces:
            out += self.piece(piece)
        return self.known.keep(chunk, tuple(out))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known.new.get
        for chunk in cut(text):
            made = known(chunk)
            if made is None:
                made = self.chunk(chunk)
                known = self.known.new.get
            out += made
        return out


#: White space and what follows up to the next space; white space that ends a chunk belongs to the next one.
_CHUNKS = re.compile(r"\s*[^\s]+(?:[^\S ]+[^\s]+)*|\s+")


def cut(text: str) -> list[str]:
    """The text in chunks that begin at a space after a visible sign; no piece of the pattern crosses such a place."""
    return _CHUNKS.findall(text)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and token ids of every whole text, special tokens excluded.

    Null text is empty and has no ids; repeated rows each keep a row; other columns are ignored.
    """
    def encode(batch):
        made = encoder(path, pattern)
        return {"doc_id": batch.column(0), "ids": [made.encode(t or "") for t in batch.column(1).to_pylist()]}

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(plain, encode, "doc_id bigint, ids array<int>")


def decode_ids(decoder: StreamDecoder, ids: list[int], at_once: int = 65_536) -> bytes:
    """Bytes of a whole id list, decoded as a stream and encoded again."""
    parts = [decoder.push(ids[i:i + at_once]) for i in range(0, len(ids), at_once)]
    return "".join([*parts, decoder.close()]).encode("utf-8")


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, digest of the ids and digest of the decoded bytes, without moving the ids.

    Edge cases as in ``encode_documents``.
    """
    def digest(batch):
        made = encoder(path, pattern)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in batch.column(1).to_pylist():
            ids = made.encode(text or "")
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(" ".join(map(made.names.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decode_ids(made.decoder, ids)).hexdigest())
        return out | {"doc_id": batch.column(0)}

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(plain, digest, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
