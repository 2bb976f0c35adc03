import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import language, licenses, quality
from barloom.llm.licenses import NOTICES, PHRASES, scan_text


def test_ppm_lengths_are_a_code(monkeypatch):
    """Under frozen statistics the code lengths of all bytes after any history obey Kraft's sum."""
    monkeypatch.setattr(language, "CLASSES", 12)
    text = np.random.default_rng(1).integers(1, 9, 3000)
    keys, n = np.unique(language.grams(text, 12), return_counts=True)
    nodes, bits = language.tree_tables(dict(zip(keys.tolist(), n.tolist(), strict=True)), 12, 200)
    sums = np.exp2(-bits[np.unique(nodes)].astype(np.float64)).sum(1)
    assert (sums <= 1.0 + 1e-5).all() and (sums > 0.5).all()
    assert np.isfinite(bits).all() and (bits >= 0).all()


def test_language_ids(spark, documents, prose):
    other = prose(5, 400).translate(str.maketrans("aeiou", "uoaei"))
    rows = [(i, prose(i, 60)) for i in range(20)] + [(100 + i, prose(50 + i, 60).translate(str.maketrans("aeiou", "uoaei"))) for i in range(20)]
    learn = documents(rows).withColumn("lang", F.when(F.col("doc_id") < 100, "aa").otherwise("bb"))
    model = language.fit_languages(learn.unionByName(documents([(7, None), (None, "x y")])))
    assert model.names == ("aa", "bb")
    asked = [(1, prose(900, 40)), (2, other), (3, None), (4, ""), (5, "12 34 !!"), (6, prose(900, 40)), (6, prose(900, 40)), (8, prose(901, 60_000))]
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify_languages(documents(asked), model).collect()]
    assert len(got) == 8
    by = {d: (p, s) for d, p, s in got}
    assert by[1][0] == by[6][0] == by[8][0] == "aa" and by[2][0] == "bb"
    assert by[3] == by[4] == by[5] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in by.values())


def test_language_block_edges_do_not_change_lengths(monkeypatch, prose):
    text = prose(3, 500).encode()
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = language.class_map(counts, language.CLASSES)
    keys, n = np.unique(language.grams(classes[np.frombuffer(text, np.uint8)].astype(np.int64), language.CLASSES), return_counts=True)
    model = language.build_model(["x"], counts, [dict(zip(keys.tolist(), n.tolist(), strict=True))], language.CLASSES, 100)
    whole = language.code_length(model, text)
    monkeypatch.setattr(language, "BLOCK", 17)
    assert np.allclose(whole, language.code_length(model, text))


def plain_code_length(learnt, asked, symbols, contexts):
    """A coder with a dictionary per context, one symbol at a time."""
    counts: list[dict] = [{} for _ in range(4)]
    for text in learnt:
        padded = [0, 0, 0, *text]
        for i in range(3, len(padded)):
            for k in range(4):
                after = counts[k].setdefault(tuple(padded[i - k:i]), {})
                after[padded[i]] = after.get(padded[i], 0) + 1
    frequent = sorted(counts[3], key=lambda c: (-sum(counts[3][c].values()), c))[:contexts]
    counts[3] = {c: counts[3][c] for c in frequent}
    bits, padded = 0.0, [0, 0, 0, *asked]
    for i in range(3, len(padded)):
        excluded, chance = set(), 1.0
        for k in (3, 2, 1, 0):
            after = counts[k].get(tuple(padded[i - k:i]), {})
            left = {c: n for c, n in after.items() if c not in excluded}
            excluded |= after.keys()
            if padded[i] in left:
                chance *= left[padded[i]] / (sum(left.values()) + len(left))
                break
            if left:
                chance *= len(left) / (sum(left.values()) + len(left))
        else:
            chance /= symbols - len(excluded)
        bits -= np.log2(chance)
    return bits


@pytest.mark.parametrize("contexts", [10_000, 40, 0])
def test_ppm_equals_a_plain_coder(prose, contexts):
    learnt = [prose(i, 40) for i in range(6)] + ["", "a", "zz top", "naïve café über"]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in learnt]
    byte_counts = np.bincount(np.concatenate(raw), minlength=256)
    classes = language.class_map(byte_counts, language.CLASSES)
    rows = [classes[r].astype(np.int64) for r in raw]
    keys, n = np.unique(np.concatenate([language.grams(r, language.CLASSES) for r in rows]), return_counts=True)
    model = language.build_model(["x"], byte_counts, [dict(zip(keys.tolist(), n.tolist(), strict=True))], language.CLASSES, contexts)
    for text in (prose(99, 60), "q", "", "Übung 7: XYZ ß 漢字", "aaaa" * 20, learnt[0]):
        asked = classes[np.frombuffer(text.encode(), np.uint8)].astype(int).tolist()
        want = plain_code_length([r.tolist() for r in rows], asked, language.CLASSES, contexts)
        assert language.code_length(model, text.encode())[0] == pytest.approx(want, rel=1e-5, abs=1e-4)


def test_tied_languages_take_the_first_name(spark, documents, prose):
    rows = [(i, prose(i % 5, 30)) for i in range(10)]
    learn = documents(rows).withColumn("lang", F.when(F.col("doc_id") < 5, "bb").otherwise("aa"))
    got = language.identify_languages(documents([(1, prose(2, 30)), (2, "x")]), language.fit_languages(learn)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("aa", 0.5)] * 2


def test_no_labels_teach_nothing(spark, documents):
    model = language.fit_languages(documents([(1, "abc")]))
    assert model.names == ()
    assert [r.lang_pred for r in language.identify_languages(documents([(1, "abc")]), model).collect()] == ["und"]
    assert language.identify_languages(documents([]).limit(0), model).count() == 0


def test_quality_learns_and_scores(spark, documents, prose):
    good = [(i, prose(i, 80)) for i in range(60)]
    bad = [(1000 + i, " ".join(w + "!!" for w in prose(i, 60).upper().split())) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, 9) for i, _ in good] + [(i, 0, 9) for i, _ in bad] + [(None, 1, 9), (5000, None, 9)], "doc_id bigint, quality int, text int")
    w = quality.fit_quality(documents(good + bad), labels)
    asked = [(1, prose(777, 50)), (2, prose(777, 50).upper().replace(" ", "!! ")), (3, None), (4, ""), (1, prose(777, 50))]
    got = [(r.doc_id, r.score) for r in quality.score_quality(documents(asked), w).collect()]
    by = dict(got)
    assert len(got) == 5 and by[1] > 0.8 and by[2] < 0.2 and by[3] == by[4] and 0 <= by[3] <= 1
    assert quality.fit_quality(documents(good), labels.limit(0)) is None
    assert [r.score for r in quality.score_quality(documents([(1, "a")]), None).collect()] == [0.5]


def test_ftrl_matches_a_plain_loop(prose):
    texts = [(prose(i, 6), i % 2) for i in range(12)]
    rows = [(*quality.features(t.encode()), y) for t, y in texts]
    got = quality.ftrl(rows, 1 << quality.BITS)
    z, n = {}, {}
    a, b, l1, l2 = quality.ALPHA, quality.BETA, quality.L1, quality.L2
    weight = lambda i: 0.0 if abs(z.get(i, 0)) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((b + n[i] ** 0.5) / a + l2)
    for _ in range(quality.PASSES):
        for h, words, y in rows:
            x = {}
            for i in h.tolist():
                x[i] = x.get(i, 0) + quality.SCALE / words
            x[1 << quality.BITS] = 1.0
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                s = ((n.get(i, 0) + g * g) ** 0.5 - n.get(i, 0) ** 0.5) / a
                z[i] = z.get(i, 0) + g - s * w[i]
                n[i] = n.get(i, 0) + g * g
    for i in z:
        assert got[i] == pytest.approx(weight(i), abs=1e-9)


def plain_places(text, phrase):
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    p = phrase.split()
    return len(words), [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]


@pytest.mark.parametrize("text", [
    "", "   ", "CC-BY cc by, CC/BY", "All rights reserved", "the GNU General Public License; all rights reserved all rights reserved",
    "cc bye acc by cc by cc by", "ümlaut cc by é", "x" * 50_000 + " cc by", "general  public\nlicense", "a\x80b cc by",
])
def test_license_base_places(text):
    n_words, exact, _ = scan_text(text.encode(), PHRASES, tuple(sorted(NOTICES.items())))
    want = []
    for phrase, label in PHRASES.items():
        n, places = plain_places(text, phrase)
        want += [(i, label) for i in places]
        assert n == n_words
    assert exact == sorted(want)


def test_fuzzy_notices_with_edits():
    notices = tuple(sorted(NOTICES.items()))
    spans = scan_text(b"foo Releosed undr the MIT license. bar", PHRASES, notices)[2]
    assert spans == [("mit", 1, 5, 2)]
    assert scan_text(b"nothing of the kind is said here at all", PHRASES, notices)[2] == []


def test_pigeonhole_finds_what_a_full_search_finds(prose):
    import random

    import regex

    rng = random.Random(4)
    notice = "released under the mit license"
    k = licenses.edits_of(notice)
    full = regex.compile(b"(?be)(?:" + regex.escape(notice.encode()) + b"){e<=%d}" % k)
    for seed in range(60):
        changed = list(notice)
        for _ in range(rng.randint(0, k + 1)):
            at = rng.randrange(len(changed))
            changed[at:at + 1] = rng.choice([[], ["q"], [changed[at], "z"]])
        line = licenses.normal((prose(seed, 8) + " " + "".join(changed) + " " + prose(seed + 99, 8)).encode())
        got = licenses.fuzzy_spans(line, ((notice, "mit"),))
        assert bool(got) == bool(full.search(line))


def test_other_licences_are_not_labelled():
    notices = tuple(sorted(NOTICES.items()))
    spans = lambda text: scan_text(text.encode(), PHRASES, notices)[2]
    for name in "bsd gpl isc mpl zlib cddl epl wtfpl artistic eclipse apple eupl afl summit mint nit".split():
        for text in (f"Licensed under the {name} license", f"released under the {name} license", f"licensed under the {name} license version 2"):
            assert spans(text) == [], text
    for text in ("gnu affero general public license", "gnu general public license", "netscape public license version", "eclipse public license version",
                 "this work isn't in the public domain", "creative commons zero"):
        assert spans(text) == [], text
    assert spans("licenced undr the MIT license") == [("mit", 0, 4, 2)]
    assert spans("licensed under the mitlicense") == [("mit", 0, 3, 1)]
    assert spans("licensed under the bsd licensed under the mit license") == [("mit", 4, 8, 0)]
    assert spans("licensed under the apache licence versoin 2") == [("apache", 0, 5, 3)]


def test_notices_side_by_side_are_all_found():
    for notice, label in NOTICES.items():
        words = len(notice.split())
        edited = notice[:2] + "q" + notice[3:]
        got = scan_text(f"{edited} {edited} {notice}".encode(), {}, ((notice, label),))[2]
        assert [s[1:] for s in got] == [(i * words, (i + 1) * words - 1, e) for i, e in enumerate((1, 1, 0))], notice


def test_license_table(spark, documents):
    rows = [(1, "cc by"), (2, None), (3, ""), (4, "released under the mit licence"), (1, "cc by"), (None, "all rights reserved")]
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
           for r in licenses.license_digest(licenses.scan_licenses(documents(rows))).collect()]
    assert got == [(1, 2, 1, 0, 0, "cc-by", "cc-by", 1.0), (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0),
                   (4, 5, 0, None, None, "", "mit", 0.9), (1, 2, 1, 0, 0, "cc-by", "cc-by", 1.0), (None, 3, 1, 0, 0, "reserved", "reserved", 1.0)]
    assert licenses.license_digest(licenses.scan_licenses(documents([]).limit(0))).count() == 0


def test_held_out_accuracy(spark):
    """The registered queries on documents they have not learnt from."""
    from barloom.llm.queries import op2_quality_classifier, op7_language_id

    sf = "/root/testdata/sf0.01"
    lang = op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in lang) >= 0.98 * len(lang)
    rows = op2_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) >= 0.97 * len(good)
    assert sum(r.predicted for r in bad) <= 0.3 * len(bad)
