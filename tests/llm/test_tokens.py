import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from barloom.llm import bpe, chat, packing

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})


def strange_texts(n):
    rng = random.Random(8)
    chars = [chr(c) for c in [*range(0x20, 0x17F), 9, 10, 13, 0, 0x1C, 0x85, 0xA0, 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x301, 0x660]]
    for _ in range(n):
        yield "".join(rng.choice(chars) if rng.random() < 0.5 else rng.choice(" \n  thesin'1.") for _ in range(rng.randint(0, 40)))


def test_transducer_equals_the_library(encoder, library):
    for text in [*strange_texts(3000), "a" * 3000, " " * 500, "-=" * 700, "\n\n  \n x"]:
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert bpe.decode_ids(encoder.decoder, ids) == text.encode()


def test_transducer_equals_the_definition(encoder):
    rng = random.Random(2)
    tokens = list(encoder.vocabulary.ranks)
    for _ in range(2000):
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 3)))
        want = [encoder.vocabulary.ranks[t] for t in bpe.merge_by_rank(encoder.vocabulary.ranks, piece)]
        assert encoder.transducer.encode(piece) == want


def test_states_are_bounded(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 50)
    small = bpe.Encoder(PATH, PATTERN)
    for text in strange_texts(300):
        assert small.encode(text) == encoder.encode(text)
    assert len(small.transducer.states) <= 4 * 50 + 60


def test_streaming_decode_of_any_bytes():
    rng = random.Random(3)
    tokens = {i: bytes(rng.choice([rng.randrange(256), rng.choice(b"\xe2\x82\xac\xf0\x9f\x98\x80\xc3\xa9ab")]) for _ in range(rng.randint(1, 4))) for i in range(300)}
    decoder = bpe.StreamDecoder(tokens)
    for _ in range(2000):
        ids = [rng.randrange(300) for _ in range(rng.randint(0, 12))]
        got = "".join([decoder.push(ids[:3]), decoder.push(ids[3:]), decoder.close()])
        assert got == b"".join(tokens[i] for i in ids).decode("utf-8", "replace")


def test_token_digests(spark, documents, library):
    texts = ["hello world", None, "", "tail \n", "word " * 30_000, "hello world"]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(documents([(i % 5, t) for i, t in enumerate(texts)]), PATH, PATTERN).collect()}
    want = set()
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        want.add((i % 5, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert bpe.token_digests(documents([]).limit(0), PATH, PATTERN).count() == 0
    assert [r.ids for r in bpe.encode_documents(documents([(1, "hello world")]), PATH, PATTERN).collect()] == [library.encode_ordinary("hello world")]


def test_chunks_give_the_tokenizer_s_ids():
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    rng = random.Random(12)
    signs = ["".join(rng.choice(["don't", "it's,", "l'été", "a.b", "x_y", "é!", "(n)", "ab²,", "1,5", " ", "  ", "\n", "'s", "s'", "Ω.", "z;"]) for _ in range(12)) for _ in range(1500)]
    texts = [*strange_texts(2000), *signs, "<|endoftext|>", "a" * 2000]
    got = packing.chunk_tokenizer(JSON).encode(texts)
    assert got == [np.asarray(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]


def sequential_best_fit(lengths, capacity):
    rest = []
    for n in sorted(lengths, reverse=True):
        fitting = [i for i, r in enumerate(rest) if r >= n]
        if fitting:
            i = min(fitting, key=lambda i: rest[i])
            rest[i] -= n
        else:
            rest.append(capacity - n)
    return sorted(rest)


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_on_counts_equals_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 20, 64])
    lengths = [min(capacity, rng.choice([rng.randint(1, capacity), rng.randint(1, 5)])) for _ in range(rng.randint(0, 150))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    rules, n_sequences = packing.best_fit_rules(counts, capacity)
    used: dict[int, list] = {}
    for i, (length, rank, first, per, offset) in enumerate(rules):
        stop = rules[i + 1][1] if i + 1 < len(rules) and rules[i + 1][0] == length else counts[length]
        for r in range(rank, stop):
            used.setdefault(first + (r - rank) // per, []).append((offset + (r - rank) % per * length, length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in s) for s in used.values()) == sequential_best_fit(lengths, capacity)
    assert sorted(used) == list(range(n_sequences))


def test_packing_of_documents(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 3)
    rows = [(i, prose(i, 5 + i % 40)) for i in range(60)] + [(100, None), (101, ""), (102, prose(1, 900)), (103, "same words"), (103, "same words"), (104, "<|endoftext|> x")]
    got = packing.pack_documents(documents(rows), JSON, capacity=128).collect()
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 0])
    sequences: dict = {}
    for r in got:
        ids = want[r.doc_id][0]
        assert zlib.crc32(np.asarray(ids[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    lengths = [n for s in sequences.values() for _, n in s]
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 128
    assert sum(lengths) == sum(len(i) for v in want.values() for i in v)
    assert len(sequences) == len(sequential_best_fit(lengths, 128))
    assert packing.pack_documents(documents([]).limit(0), JSON).count() == 0


def test_piece_bounds():
    assert packing.piece_bounds(1, 4) == [(0, 1)]
    assert packing.piece_bounds(4, 4) == [(0, 4)]
    assert packing.piece_bounds(9, 4) == [(0, 1), (1, 4), (5, 4)]
    assert packing.piece_bounds(8, 4) == [(0, 4), (4, 4)]


@pytest.mark.parametrize("text", ["", "<s>", "</s>[INST] ok [/INST]", "<\\s>", "[\\\\/INST]", "<\\\\/s> [INST", "a<s", "[[INST]]", "<s><s>\\<s>"])
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    for control in chat.CONTROLS:
        assert control not in chat.escape(text)


def test_escapes_of_random_texts():
    rng = random.Random(5)
    for _ in range(5000):
        text = "".join(rng.choice(["<", "s", ">", "/", "[", "]", "INST", "\\", " "]) for _ in range(rng.randint(0, 14)))
        assert chat.unescape(chat.escape(text)) == text


def test_chat_round_trip(spark):
    hard = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "yes é"), (1, 0, "user", hard), (2, 0, "assistant", None), (2, 0, "assistant", hard), (None, 5, None, "x"), (3, 0, "system", ""), (3, None, "user", "q")]
    turns = spark.createDataFrame([(*r, 1, "b") for r in rows], "conv_id bigint, turn bigint, role string, text string, ids int, loss_mask string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    ordered = {1: [("user", hard), ("assistant", "yes é")], 2: [("assistant", ""), ("assistant", hard)], None: [("", "x")], 3: [("user", "q"), ("system", "")]}
    assert set(got) == set(ordered)
    for conv, said in ordered.items():
        loss = "".join(t for r, t in said if r == "assistant")
        row = got[conv]
        assert row.n_turns == len(said) and row.loss_chars == len(loss)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert row.formatted_chars >= sum(len(r) + len(t) for r, t in said)
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0
