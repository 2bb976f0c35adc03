import hashlib
import random

import numpy as np
import pytest

from barloom.llm import common, components, exchange, jaccard, substring_dedup


def brute_components(rows, words, percent):
    import re

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not w:
            return frozenset()
        return frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1)))

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def near_copies(prose, seed):
    rng = random.Random(seed)
    rows = []
    for base in range(8):
        words = prose(seed * 100 + base, rng.choice([3, 30, 80, 150])).split()
        for _ in range(rng.choice([1, 2, 15])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(["changed", "words", "Here"])
            rows.append((rng.randrange(10_000), " ".join(copy)))
    passage = prose(seed + 7, 60)
    rows += [(20_000 + i, prose(i, rng.randint(5, 60)) + " " + passage) for i in range(12)]
    rows += [(30_000, None), (30_001, ""), (30_002, "  \n "), (30_003, "One Two"), (30_004, "one  two"), (30_005, "one two three"), (None, "one two"), (30_003, "one TWO")]
    return rows


@pytest.mark.parametrize("seed,words,percent", [(1, 4, 85), (2, 5, 80)])
def test_jaccard_components(spark, documents, prose, seed, words, percent):
    rows = near_copies(prose, seed)
    got = jaccard.jaccard_components(documents(rows).repartition(3), words=words, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, words, percent)


def test_jaccard_of_no_rows(spark, documents):
    assert jaccard.jaccard_components(documents([]).limit(0)).count() == 0


def test_exact_threshold(spark, documents):
    """Overlap of 85 of 100 links, 84 of 100 does not (shingles of one word)."""
    base = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:85])), (3, " ".join(f"v{i}" for i in range(100))), (4, " ".join(f"v{i}" for i in range(84)))]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(documents(rows), words=1, percent=85).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {(r.node, r.label) for r in got} == {(n, find(n)) for n in root} and len(got) == len(root)
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_gap_codes():
    rng = np.random.default_rng(1)
    for top, n in ((1 << 40, 500), (1 << 60, 40), (10, 5), (1, 0), (1 << 62, 1)):
        keys = np.unique(rng.integers(0, top, n).astype(np.uint64))
        counts = rng.integers(1, 9, len(keys))
        k, c = exchange.gaps_from_bytes(exchange.gaps_to_bytes(keys, counts))
        assert (k == keys).all() and (c == counts).all()


def test_repeated_keys_over_packs(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(common, "PACK_BYTES", 300)
    rows = [(i, prose(i % 7, 20)) for i in range(30)]
    packs = common.pack_documents(documents(rows).repartition(2), "doc_id", "text")
    assert packs.count() > 5

    def keys_of(blob):
        h = [int.from_bytes(hashlib.sha256(w).digest()[:8], "little") for t in common.unpack(blob)[1] for w in set(t.split())]
        return np.unique(np.array(h, np.uint64), return_counts=True)

    answers = exchange.repeated_keys(packs, keys_of, 44, 5).collect()
    total: dict = {}
    for p in packs.collect():
        keys, counts = keys_of(p.blob)
        for k, c in zip((keys >> np.uint64(20)).tolist(), counts.tolist(), strict=True):
            total[k] = total.get(k, 0) + c
    for p in packs.collect():
        keys, sums = exchange.known_keys([a.body for a in answers if a.pack == p.pack])
        own = {k for k in (keys_of(p.blob)[0] >> np.uint64(20)).tolist() if total[k] >= 2}
        assert dict(zip(keys.tolist(), sums.tolist(), strict=True)) == {k: total[k] for k in own}


def brute_removed(rows):
    first: dict = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        if d is not None:
            for i in range(len(b) - 49):
                first[b[i:i + 50]] = min(first.get(b[i:i + 50], d), d)
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and first[b[i:i + 50]] < d:
                gone[i:i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def shared_passages(prose, seed):
    rng = random.Random(seed)
    passages = [prose(seed * 10 + i, 30) for i in range(3)] + ["é" * 40 + "ü" * 20, "ab" * 90, "x" * 200]
    rows = []
    for i in range(40):
        parts = [prose(1000 + i, rng.randint(0, 20))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts += [p[a:a + rng.randint(20, 300)], prose(5000 + i, rng.randint(0, 3))]
        rows.append((i, rng.choice(["", " ", "-"]).join(parts)))
    rng.shuffle(rows)
    exact = rows[0][1]
    return [*rows, (100, exact), (101, exact), (101, exact), (None, exact), (102, None), (103, ""), (104, "y" * 49), (105, "y" * 49), (106, "z" * 50), (107, "z" * 50)]


@pytest.mark.parametrize("seed,block,frequent,size", [(1, 1 << 20, 20_000, 8_000_000), (2, 64, 3, 900), (3, 100, 20_000, 400)])
def test_removed_bytes(spark, documents, prose, monkeypatch, seed, block, frequent, size):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    monkeypatch.setattr(substring_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(common, "PACK_BYTES", size)
    rows = shared_passages(prose, seed)
    got = substring_dedup.remove_repeats(documents(rows).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_removed(rows)


def test_kept_text_and_carried_columns(spark, documents, prose):
    passage = "ä" * 60
    rows = [(1, "é" + passage), (2, "ũ" + passage), (3, "own words"), (4, None)]
    docs = documents(rows)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, carry=("source", "score", "pack"), with_text=True).collect()}
    assert got[1].kept_text == "é" + passage and got[3].kept_text == "own words" and got[4].kept_text == ""
    # The second byte of the first letter is shared; the letter stays whole in the text.
    assert got[2].n_removed == 121 and got[2].kept_text == "ũ"
    assert (got[2].source, got[2].score, got[2].pack) == ("s", "x", -1)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_multikey_groups():
    rng = random.Random(6)
    data = "".join(rng.choice("ab") * rng.randint(1, 70) for _ in range(60)).encode()
    arr = np.frombuffer(data, np.uint8)
    starts = np.arange(len(data) - 49)
    same = substring_dedup.equal_windows(arr, starts)
    names: dict = {}
    for i in starts.tolist():
        assert names.setdefault(data[i:i + 50], same[i]) == same[i]
    assert len(set(names.values())) == len(names)
