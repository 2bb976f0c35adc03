"""License scans: exact phrases and fuzzy short notices over whole texts.

Fuzzy search splits each notice into one more piece than the edits it may carry
(pigeonhole): a copy with at most that many edits holds one piece unchanged. Exact
hits of the pieces locate candidates, and the ``regex`` library's bounded-error
matching verifies the edits and reports the span. Where another licence's name is
within the edits of a notice, the notice's own name must stand unedited: matches are
built around each exact name, with the edits counted in the words on either side.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import map_batches, text_bytes

#: Exact phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices (as words) and the label that a fuzzy match adds.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "licensed under the apache license version": "apache",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version": "mpl",
    "creative commons attribution": "cc-by",
    "this work is in the public domain": "public-domain",
}
#: The words of a notice that tell it from another within its edits ("bsd", "mpl", "apple"; "isn't in").
NAMES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "licensed under the apache license version": "apache",
    "this work is in the public domain": "is in",
}
#: One edit per so many characters of a notice.
CHARS_PER_EDIT = 10

_WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SPANS = "array<struct<label:string,first_word:bigint,last_word:bigint,edits:int>>"


def normal(text: bytes) -> bytes:
    """Words joined by single spaces, with a space at either end; the bytes of non-ASCII letters are word bytes."""
    return b" " + b" ".join(text.translate(_WORD_TABLE).split()) + b" "


def edits_of(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_EDIT)


@lru_cache(maxsize=8)
def compiled(notices: tuple[tuple[str, str], ...]):
    """(bounded-error patterns: first and best match, edits, notice, label, [(piece, offset)]) per notice."""
    out = []
    for notice, label in notices:
        k, raw = edits_of(notice), notice.encode()
        cuts = [round(i * len(raw) / (k + 1)) for i in range(k + 2)]
        pieces = [(raw[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
        near = b"(?:" + regex.escape(raw) + b"){e<=%d}" % k
        out.append((regex.compile(near), regex.compile(b"(?be)" + near), k, raw, label, pieces))
    return out


def all_places(line: bytes, needle: bytes) -> list[int]:
    out, at = [], line.find(needle)
    while at >= 0:
        out.append(at)
        at = line.find(needle, at + 1)
    return out


def free_matches(line: bytes, a: int, b: int, first, best, length: int, k: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of matches of a notice in a window, from left to right.

    The best match is sought only where the first one lies, in a stretch too short
    for two, so a better match further on does not hide it.
    """
    out = []
    while found := first.search(line, a, b):
        m = best.search(line, found.start(), min(b, found.start() + length + 2 * k)) or found
        out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
        a = m.end()
    return out


def edits_to_prefix(part: bytes, text: bytes, k: int) -> tuple[int, int]:
    """Least edits between a part and any prefix of a text, and that prefix's length; over k edits give k + 1."""
    if text.startswith(part):
        return 0, len(part)
    text = text[:len(part) + k]
    row = list(range(len(text) + 1))
    for i, c in enumerate(part, 1):
        diagonal, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            diagonal, row[j] = row[j], diagonal if c == d else 1 + min(diagonal, row[j], row[j - 1])
    edits, _, used = min((e, abs(j - len(part)), j) for j, e in enumerate(row))
    return min(edits, k + 1), used


def named_matches(line: bytes, a: int, b: int, raw: bytes, name: bytes, k: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the matches in a window around the exact name.

    The name is a word of its own, or has only lost the space to a neighbour of the notice.
    """
    at = (b" " + raw + b" ").index(b" " + name + b" ")
    left, right = raw[:at], raw[at + len(name):]
    before, after = left.split()[-1:], right.split()[:1]
    out = []
    for place in all_places(line[a:b], name):
        start, end = a + place, a + place + len(name)
        if not line.endswith((b" ", *before), 0, start) or not line.startswith((b" ", *after), end):
            continue
        d1, n1 = edits_to_prefix(left[::-1], line[max(0, start - len(left) - k):start][::-1], k)
        if d1 <= k:
            d2, n2 = edits_to_prefix(right, line[end:end + len(right) + k], k)
            if d1 + d2 <= k:
                out.append((start - n1, end + n2, d1 + d2))
    return out


def fuzzy_spans(line: bytes, notices: tuple[tuple[str, str], ...], names: dict[str, str] | None = None) -> list[tuple[int, int, str, int]]:
    """(start, end, label, edits) of the fuzzy matches in a normalised line.

    Notices in ``names`` match only with those words unedited. Windows around hits of
    one notice are merged before verification, so a stretch with many hits is matched once.
    """
    found = []
    for first, best, k, raw, label, pieces in compiled(notices):
        name, length = (names or {}).get(raw.decode()), len(raw)
        windows = []
        for piece, offset in pieces:
            windows += [(max(0, at - offset - k), at - offset + length + k) for at in all_places(line, piece)]
        end = -1
        merged: list[list[int]] = []
        for a, b in sorted(windows):
            if a <= end:
                merged[-1][1] = end = max(end, b)
            else:
                merged.append([a, b])
                end = b
        for a, b in merged:
            b = min(b, len(line))
            spans = named_matches(line, a, b, raw, name.encode(), k) if name else free_matches(line, a, b, first, best, length, k)
            found += [(start, stop, label, edits) for start, stop, edits in spans]
    return sorted(found)


def scan_text(text: bytes, phrases: dict[str, str], notices: tuple[tuple[str, str], ...], names: dict[str, str] = NAMES):
    """n_words, exact places [(word, label)] and fuzzy spans [(label, first, last, edits)]."""
    line = normal(text)
    n_words = line.count(b" ") - 1 if len(line) > 2 else 0
    places = [(at, label) for phrase, label in phrases.items() for at in all_places(line, b" " + phrase.encode() + b" ")]
    fuzzy = fuzzy_spans(line, notices, names)
    if not places and not fuzzy:
        return n_words, [], []
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    word_at = lambda at: int(np.searchsorted(spaces, at, "right")) - 1  # noqa: E731  the word that begins at the byte
    exact = sorted((word_at(at), label) for at, label in places)
    spans = []
    for a, b, label, edits in fuzzy:
        # A match may begin with the space before its first word, or inside a changed word.
        a, b = a + (line[a:a + 1] == b" "), b - (line[b - 1:b] == b" ")
        spans.append((label, word_at(a - 1) if line[a - 1:a] == b" " else word_at(a), word_at(b - 1), edits))
    return n_words, exact, spans


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES,
                  names: dict[str, str] = NAMES) -> DataFrame:
    """One row per input row: doc_id, n_words, places (word, label), spans (label, words, edits).

    Null text is empty; empty texts have no words, places or spans; repeated rows each
    get their own row; an empty table gives an empty result; other columns are ignored.
    No text is cut, and no number of places or spans is capped.
    """
    fixed, pairs, words = dict(phrases), tuple(sorted(notices.items())), dict(names)

    def scan(batch):
        out = {"doc_id": batch.column(0), "n_words": [], "places": [], "spans": []}
        for text in text_bytes(batch.column(1)):
            n_words, exact, spans = scan_text(text, fixed, pairs, words)
            out["n_words"].append(n_words)
            out["places"].append([{"word": w, "label": label} for w, label in exact])
            out["spans"].append([dict(zip(("label", "first_word", "last_word", "edits"), s, strict=True)) for s in spans])
        return out

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(plain, scan, f"doc_id bigint, n_words bigint, places array<struct<word:bigint,label:string>>, spans {SPANS}")


def license_digest(found: DataFrame) -> DataFrame:
    """The report columns: base places, base and all labels, and a score from the best span.

    The score is 1 for a document with an exact place or an unedited notice, less by a
    tenth for each edit of its best fuzzy span (not under 0.1), and 0 without either.
    """
    base = F.transform("places", lambda p: p["label"])
    best = F.array_min(F.transform("spans", lambda s: s["edits"]))
    fuzzy = F.when(best.isNull(), 0.0).otherwise(F.greatest(F.lit(0.1), 1.0 - best / 10.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["word"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("spans", lambda s: s["label"]))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(fuzzy).cast("double").alias("score"),
        F.size("spans").cast("bigint").alias("n_fuzzy"),
    )
