"""Language identification by prediction by partial matching over bytes.

Per language a tree of byte contexts (the last 0 to 3 bytes) holds counts. The code
length of a byte is taken from the longest context that has seen it; each context that
has not adds its escape, and the bytes it had seen are excluded further down. Counts
are frozen after learning, so every code length is a constant: they are worked out once
per context and byte, and a text's score is the sum of table entries.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import map_batches, map_texts, share_bound, share_hash, text_bytes

ORDER = 3
#: Bytes of labelled text (about) that each language's tree is learnt from, and the
#: longest contexts kept in a tree (the most frequent ones).
SAMPLE_BYTES = 3_000_000
CONTEXTS = 12_000
#: Byte values told apart; rarer ones share the last class.
CLASSES = 96
#: Bytes scored at a time.
BLOCK = 1_000_000
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """classes: byte -> class; nodes: language x (3 classes) -> context; bits: language x context x class."""
    names: tuple[str, ...]
    classes: np.ndarray
    nodes: tuple[np.ndarray, ...]
    bits: tuple[np.ndarray, ...]


def grams(classes: np.ndarray, a: int) -> np.ndarray:
    """Number of the 4-gram that ends at each byte; a text starts after three zero classes."""
    c = np.concatenate([np.zeros(ORDER, np.int64), classes])
    return ((c[:-3] * a + c[1:-2]) * a + c[2:-1]) * a + c[3:]


def tree_tables(counts4: dict[int, int], a: int, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """(node of each 3-class history, bits of node x class) for one language.

    A class's probability after a context of order k is count / (total + distinct) if it was
    seen there, else the escape distinct / (total + distinct) times that of order k - 1,
    where classes seen at the higher orders are excluded. Below order 0 the classes left
    are equally likely.
    """
    keys = np.fromiter(counts4.keys(), np.int64, len(counts4))
    values = np.fromiter(counts4.values(), np.float64, len(counts4))
    dense = {0: np.zeros((1, a)), 1: np.zeros((a, a)), 2: np.zeros((a * a, a))}
    for k, table in dense.items():
        np.add.at(table.reshape(-1), keys % a ** (k + 1), values)
    history, last = keys // a, keys % a
    which, inverse = np.unique(history, return_inverse=True)
    weight = np.bincount(inverse, weights=values, minlength=len(which))
    kept = which[np.sort(np.argsort(-weight, kind="stable")[:contexts])]
    node3 = np.full(a ** 3, -1, np.int32)
    node3[kept] = np.arange(len(kept))
    top = np.zeros((len(kept), a))
    inside = node3[history] >= 0
    np.add.at(top, (node3[history[inside]], last[inside]), values[inside])

    def backed_off(rows: np.ndarray, ids: np.ndarray, order: int) -> np.ndarray:
        """Bits of each class after contexts ``ids`` of ``order`` with counts ``rows``."""
        bits = np.full(rows.shape, np.nan)
        spent = np.zeros(len(rows))
        excluded = np.zeros(rows.shape, bool)
        current, k, at = rows, order, ids
        while True:
            live = np.where(excluded, 0.0, current)
            total, seen = live.sum(1), np.count_nonzero(live, axis=1)
            whole = np.maximum(total + seen, 1.0)
            hit = (live > 0) & np.isnan(bits)
            with np.errstate(divide="ignore"):
                bits = np.where(hit, spent[:, None] - np.log2(live / whole[:, None]), bits)
                spent = spent + np.where(seen > 0, -np.log2(np.maximum(seen, 1) / whole), 0.0)
            excluded |= current > 0
            if k == 0:
                break
            k -= 1
            at = at % a ** k if k else np.zeros_like(at)
            current = dense[k][at]
        left = np.maximum((~excluded).sum(1), 1)
        return np.where(np.isnan(bits), (spent + np.log2(left))[:, None], bits).astype(np.float32)

    pairs = np.arange(a * a)
    # Histories without a kept order-3 context use the order-2 one, whose row follows the kept rows.
    nodes = np.where(node3 >= 0, node3, len(kept) + np.arange(a ** 3) % (a * a)).astype(np.int32)
    return nodes, np.concatenate([backed_off(top, kept, 3), backed_off(dense[2], pairs, 2)])


def build_model(names: list[str], byte_counts: np.ndarray, counts4: list[dict[int, int]], a: int, contexts: int) -> LanguageModel:
    nodes, bits = zip(*(tree_tables(c, a, contexts) for c in counts4), strict=True) if names else ((), ())
    return LanguageModel(tuple(names), class_map(byte_counts, a), nodes, bits)


def class_map(byte_counts: np.ndarray, a: int) -> np.ndarray:
    """Byte -> class: the most frequent bytes have classes of their own (from 1), the rest share class 0."""
    classes = np.zeros(256, np.uint8)
    order = np.argsort(-byte_counts, kind="stable")[: a - 1]
    order = order[byte_counts[order] > 0]
    classes[order] = np.arange(1, len(order) + 1)
    return classes


def code_length(model: LanguageModel, text: bytes) -> np.ndarray:
    """Bits of the whole text under each language's frozen statistics."""
    a = CLASSES
    total = np.zeros(len(model.names))
    before = np.zeros(ORDER, np.int64)
    for start in range(0, len(text), BLOCK):
        part = model.classes[np.frombuffer(text, np.uint8, min(BLOCK, len(text) - start), start)].astype(np.int64)
        c = np.concatenate([before, part])
        history = (c[:-3] * a + c[1:-2]) * a + c[2:-1]
        for i in range(len(total)):
            total[i] += model.bits[i].reshape(-1)[model.nodes[i][history] * np.int64(a) + part].sum(dtype=np.float64)
        before = c[-ORDER:]
    return total


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  sample_bytes: int = SAMPLE_BYTES) -> LanguageModel:
    """Trees learnt from about ``sample_bytes`` of whole labelled texts per language.

    Texts are taken by the hash of their id. Counting happens in tasks and sums are merged
    by key; the driver receives the counts of the bounded sample only. Rows with a null id,
    text or language teach nothing; without any there are no languages.
    """
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    plain = plain.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    part = share_hash("doc_id")
    held = plain.where(F.octet_length("text") > 0).groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b"), F.min(part).alias("least"))
    sizes = {r["lang"]: (r["b"], r["least"]) for r in held.collect()}
    names = sorted(sizes)
    share = F.lit(False)
    for name, (size, least) in sizes.items():
        # However small the share, a language's row of the smallest hash is taken.
        share = share | ((F.col("lang") == name) & (part < max(share_bound(sample_bytes / size), least + 1)))
    sample = plain.where(share)

    def count_bytes(batch):
        got = np.bincount(np.frombuffer(b"".join(text_bytes(batch.column(0))), np.uint8), minlength=256)
        return {"byte": range(256), "n": got}

    byte_counts = np.zeros(256, np.int64)
    for r in map_batches(sample.select("text"), count_bytes, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        byte_counts[r["byte"]] = r["n"]
    classes, numbers = class_map(byte_counts, CLASSES), {n: i for i, n in enumerate(names)}

    def count_grams(batch):
        out: dict[str, list] = {"lang": [], "gram": [], "n": []}
        by: dict[str, list] = {}
        for text, lang in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(grams(classes[np.frombuffer(text, np.uint8)].astype(np.int64), CLASSES))
        for lang, found in by.items():
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            out["lang"] += [numbers[lang]] * len(keys)
            out["gram"].append(keys)
            out["n"].append(n)
        return out | {k: np.concatenate(out[k]) for k in ("gram", "n")}

    counted = map_batches(sample.select("text", "lang"), count_grams, "lang int, gram bigint, n bigint")
    merged = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = (merged.column(c).to_numpy() for c in ("lang", "gram", "n"))
    counts4 = [dict(zip(gram[lang == i].tolist(), n[lang == i].tolist(), strict=True)) for i in range(len(names))]
    return build_model(names, byte_counts, counts4, CLASSES, CONTEXTS)


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text",
                       carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and bits_per_byte (of the language found) of every whole text.

    The text and other columns are passed on where asked for.

    The score is the posterior of the language under equal priors, exact ties go to the
    first name. A null text, one without a letter, or any text when nothing was learnt is
    ``und`` with score 0. Repeated rows each keep a row, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def identify(batch):
        m = shared.value
        out: dict[str, list] = {"lang_pred": [], "score": [], "bits_per_byte": []}
        for text, raw in zip(batch.column(1).to_pylist(), text_bytes(batch.column(1)), strict=True):
            if not m.names or text is None or not has_letter(text):
                found = (UNKNOWN, 0.0, None)
            else:
                bits = code_length(m, raw)
                best = int(np.argmin(bits))
                found = (m.names[best], float(1.0 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()), float(bits[best] / len(raw)))
            for key, value in zip(out, found, strict=True):
                out[key].append(value)
        return out

    return map_texts(docs, identify, "lang_pred string, score double, bits_per_byte double", id_col, text_col, carry, with_text)
