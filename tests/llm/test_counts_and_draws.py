import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from barloom.llm import common, mixing, resampling, spelling


def odd_rows(prose):
    """Documents with a hot source's worth of text, nulls, empty and long texts, repeated rows and copies."""
    rows = [(i, prose(i, random.Random(i).randint(0, 90))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, prose(5, 4000)), (103, prose(5, 4000)), (None, prose(8, 40)), (104, "Éclair ÉCLAIR naïve ÿ Zürich zürich")]
    return rows + [(200 + i, prose(3, 30)) for i in range(30)]


# spelling variants

def brute_groups(words):
    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = (a, b) if len(a) > len(b) else (b, a)
        return any(a[:i] + a[i + 1:] == b for i in range(len(a)))

    forms, out = {}, {}
    for w, n in words.items():
        close = sorted((-words[x], x) for x in words if near(w, x))
        forms[w] = (close[0][1], -close[0][0]) if close and -close[0][0] >= 2 * n else (None, None)
        out[w] = len(close)
    rows = []
    for w, n in words.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        rows.append((w, forms[w][0], root, n, out[w], forms[w][1]))
    return sorted(rows)


def brute_counts(rows):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            words[low] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


def test_word_counts_and_groups(spark, documents, prose):
    rows = odd_rows(prose)
    words = brute_counts(rows)
    got = spelling.spelling_variants(documents(rows).repartition(3)).collect()
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == brute_groups(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_random_words(spark, seed):
    rng = random.Random(seed)
    words = {}
    for _ in range(150):
        # Runs of one sign, accents, lengths around the limit between both ways, and long words.
        word = "".join(rng.choice("abé") for _ in range(rng.choice([5, 6, 7, 8, 46, 47, 48, 49, 50, 120])))
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1:], word[:at] + "b" + word[at:], word[:at] + "z" + word[at + 1:], "a" * len(word)])
            if len(word) >= 5:
                words[word] = rng.choice([3, 3, 6, 12, 50])
    got = spelling.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == brute_groups(words)


def test_long_words_meet_as_short_ones_do(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("ab") for _ in range(rng.choice([6, 7]))) for _ in range(120)}
    table = spark.createDataFrame([(w,) for w in words], "word string")
    pairs = [{tuple(sorted(p)) for p in made.collect() if p[1] in words} for made in (spelling.trie_pairs(table), spelling.long_pairs(table))]
    assert pairs[0] == pairs[1] and pairs[0]


def test_no_words(documents):
    assert spelling.spelling_variants(documents([])).collect() == []
    assert spelling.spelling_variants(documents([(1, None), (2, ""), (3, "abc")])).collect() == []


# importance resampling

def brute_resample(rows, target, longest, buckets=50, percent=30, least=20):
    def features(text):
        words = [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    made = [features(t) for _, t in rows]
    s, t = Counter(b for _, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    scored = []
    for (doc_id, _), (n, f) in zip(rows, made, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        scored.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in scored if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    drawn = fit[:percent * len(fit) // 100]
    rest = list(scored)
    for r in drawn:
        rest.remove(r)
    return sorted([(*r[:4], i + 1) for i, r in enumerate(drawn)] + [(*r[:4], None) for r in rest], key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_resample(spark, documents, prose, longest):
    rows, target = odd_rows(prose), [prose(900, 60), None, "", "river stone river STONE"]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id bigint, text string")
    got = resampling.resample(documents(rows).repartition(3), table, longest=longest, buckets=50, percent=30).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=str) == brute_resample(rows, target, longest)


def test_resample_of_nothing(spark, documents):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(documents([]), none).collect() == []
    (row,) = resampling.resample(documents([(1, None)]), none).collect()
    assert (row.n_features, row.weight, row["rank"]) == (0, 0, None)


def test_places_are_the_order(spark):
    rng = random.Random(3)
    values = [(rng.randint(0, 20), i) for i in range(300)] + [(None, 1)] * 40
    df = spark.createDataFrame(values, "v int, i int").repartition(5)
    got = common.number_in_order(df, [-df.v, df.i], "place", 7).collect()
    assert sorted(r.place for r in got) == list(range(1, 341))
    ordered = [(r.v, r.i) for r in sorted(got, key=lambda r: r.place)]
    assert ordered == sorted(values, key=lambda x: (x[0] is not None, -(x[0] or 0), x[1]))


# mixing

def sized(spark, rows):
    return spark.createDataFrame([(i, " ".join(["w"] * n) if n is not None else None, s, "x", 1) for i, n, s in rows],
                                 "doc_id bigint, text string, source string, key string, size int")


def mix(df, **options):
    got = mixing.mix_sources(df, **options).collect()
    by = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in got:
        x = by[(r.source_size, r.target)]
        x[0], x[1], x[3] = x[0] + r.taken, x[1] + 1, max(x[3], r["size"])
        assert r.taken == r["size"] * r.copies and 0 <= r.taken <= 2 * r["size"]
    return got, by


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([5, 20, 100, 900]), "ab"[i % 3 == 0] if i % 7 else None) for i in range(900)]
    rows += [(None, 30, "a"), (1, 30, "a"), (1, 30, "a"), (5000, None, "a"), (5001, 0, "zero"), (5002, 40_000, "b")]
    got, by = mix(sized(spark, rows).repartition(3))
    total = sum(n or 0 for _, n, _ in rows)
    assert len(got) == len(rows)
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    for (size, target), (taken, *_) in by.items():
        assert target <= 2 * size and abs(taken - target) <= 25
    again, _ = mix(sized(spark, rows).repartition(11))
    assert sorted(got, key=str) == sorted(again, key=str)


def test_targets_stop_and_are_shared_again(spark):
    rows = [(1, 10, "a"), (2, 30, "b"), (3, 1000, "c"), (4, 400, None)]
    got, _ = mix(sized(spark, rows))
    targets = {r.source_size: r.target for r in got}
    # 2160 words in all: a and b stop at 20 and 60, the fourth weight is 5 again and stops at 800, c has the rest.
    assert targets == {10: 20.0, 30: 60.0, 400: 800.0, 1000: 1280.0}


def test_mix_draws_without_bias(spark):
    rows = [(i, 10, "a") for i in range(400)]
    taken = Counter()
    for seed in range(6):
        got, _ = mix(sized(spark, rows), share=30, seed=seed)
        assert sum(r.copies for r in got) == 120
        taken.update(r.doc_id for r in got if r.copies)
    assert max(taken.values()) <= 6 and len(taken) > 250


def test_mix_of_nothing(spark):
    assert mix(sized(spark, []))[0] == []
    (row,) = mix(sized(spark, [(1, None, None)]))[0]
    assert (row["size"], row.source_size, row.target, row.taken) == (0, 0, 0.0, 0)


def test_mixed_documents(spark):
    df = sized(spark, [(i, 10, "a") for i in range(50)])
    mixed = mixing.mix_sources(df, share=150)
    assert mixing.mixed_documents(df, mixed).count() == 75
