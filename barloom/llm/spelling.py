"""Spelling variants: words one edit apart, found by a relational walk through tries.

A trie holds the words of one length, once from the left and once from the right; its edges are rows
(side, size, node, sign). A state is (word, position, node, edits). Of two words one
edit apart, either the left or the right half is equal, so a word starts in the middle of itself, in the
trie whose side holds the equal half: all nodes are long prefixes and no node is
met by all words. In every round states are joined with the edges of their node: the sign expected goes
on, another one is the state's only edit, and a sign of the word left out leads to the trie
of the shorter words. States that reach a word with one edit are neighbours.
Near is mutual, so replaced signs are looked for upwards and shorter words from longer ones only.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import arrow_schema, bound_batches, columns_batch, map_batches, mix, text_bytes
from barloom.session import cut_lineage

#: Words with fewer code points, and those seen less often, are left out.
MIN_LENGTH, MIN_COUNT = 5, 3
#: One in so many (document, word) pairs loses a code point.
TYPO = 97
#: Words a task counts before it sends them on.
HELD_WORDS = 200_000
#: From this length on, words meet by hashes of themselves without one sign, so that rounds are at most LONG / 2 + 1.
LONG = 48

_RUNS = re.compile("[a-zÀ-ÿ]+")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, typo: int = TYPO) -> DataFrame:
    """word, n: the corpus's words, misspelt where the hash of document and word says so.

    Null and empty texts have no words; a null id counts as empty text; repeated rows count again.
    """
    bound_batches(docs.sparkSession)
    schema = "word string, n bigint"
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        held: Counter = Counter()

        def rows():
            words = list(held)
            made = columns_batch({"word": words, "n": [held[w] for w in words]}, arrow)
            held.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                # bytes.lower changes A-Z alone.
                found = Counter(_RUNS.findall(text.lower().decode("utf-8", "replace")))
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, times in found.items():
                    if len(word) < min_length:
                        continue
                    h = zlib.crc32(word.encode(), start)
                    if h % typo == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < min_length:
                            continue
                    held[word] += times
                if len(held) > HELD_WORDS:
                    yield rows()
        if held:
            yield rows()

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _sides(words: DataFrame) -> DataFrame:
    """side, word (from the right on side 1), size, start: the words of both tries and their middles."""
    size = F.char_length("word")
    both = words.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("word"), F.floor(size / 2).alias("start")),
                                          F.struct(F.lit(1).alias("side"), F.reverse("word").alias("word"), (size - F.floor(size / 2)).alias("start")))).alias("x"))
    return both.select("x.side", "x.word", F.char_length("x.word").alias("size"), F.col("x.start").cast("int").alias("start"))


def trie_edges(words: DataFrame) -> DataFrame:
    """side, size, node, sign, after: the edges of all words of ``size`` code points, from their middles on.

    ``after`` holds the signs that follow in the trie, an empty one for a word's end.
    """
    steps = _sides(words).withColumn("depth", F.explode(F.expr("sequence(start, size - 1)")))
    sign = lambda at: F.expr(f"substring(word, {at}, 1)")
    return (steps.select("side", "size", F.expr("substring(word, 1, depth)").alias("node"), sign("depth + 1").alias("sign"), sign("depth + 2").alias("next"))
            .groupBy("side", "size", "node", "sign").agg(F.collect_set("next").alias("after")))


def trie_pairs(words: DataFrame) -> DataFrame:
    """a, b: every two of ``words`` one edit apart, at least once; some b may be no word."""
    edges = cut_lineage(trie_edges(words))

    def with_left_out(states: DataFrame) -> DataFrame:
        """The states, and for those without an edit one that leaves out the sign at their position."""
        going = states.where((F.col("edits") == 1) | (F.col("position") < F.char_length("word")))
        both = going.withColumn("less", F.explode(F.sequence(F.lit(0), 1 - F.col("edits"))))
        return both.select("side", "word", (F.col("position") + F.col("less")).alias("position"), (F.col("size") - F.col("less")).alias("size"),
                           "node", (F.col("edits") + F.col("less")).alias("edits"))

    start = _sides(words).select("side", "word", F.col("start").alias("position"), "size", F.expr("substring(word, 1, start)").alias("node"), F.lit(0).alias("edits"))
    live = cut_lineage(with_left_out(start))
    ended = (F.col("edits") == 1) & (F.char_length("node") == F.col("size"))
    pairs = []
    while not live.isEmpty():
        pairs.append(live.where(ended).select("side", "word", "node"))
        s, e = live.where(~ended).alias("s"), edges.alias("e")
        expected, then = F.expr("substring(s.word, s.position + 1, 1)"), F.expr("substring(s.word, s.position + 2, 1)")
        # Once edited, a state must also find the sign after the next.
        goes = (((F.col("s.edits") == 0) & (F.col("e.sign") == expected))
                | ((F.col("e.sign") >= expected) & ((F.col("s.edits") == 0) | (F.col("e.sign") == expected)) & F.array_contains("e.after", then)))
        met = s.join(e, (F.col("s.side") == F.col("e.side")) & (F.col("s.size") == F.col("e.size")) & (F.col("s.node") == F.col("e.node")) & goes)
        stepped = met.select("s.side", "s.word", (F.col("s.position") + 1).alias("position"), "s.size", F.concat("s.node", "e.sign").alias("node"),
                             (F.col("s.edits") + (F.col("e.sign") != expected).cast("int")).alias("edits"))
        live = cut_lineage(with_left_out(stepped))
    if not pairs:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    found = pairs[0]
    for more in pairs[1:]:
        found = found.unionByName(more)
    straight = lambda c: F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c))
    return found.select(straight("word").alias("a"), straight("node").alias("b"))


def long_pairs(words: DataFrame) -> DataFrame:
    """a, b: every two of ``words`` one edit apart, by 64-bit hashes of each word without one of its signs.

    A word sends a row of fixed size per code point. What meets is compared as text, so a hash
    that two texts share adds no pair.
    """
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def hashes(batch):
        ids, places, found = [], [], []
        for key, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            signs = mix(np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, len(signs) - 1), np.uint64(0x9E3779B97F4A7C15))]), dtype=np.uint64)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(signs * powers, dtype=np.uint64)])
            without = sums[:-1] + (sums[-1] - sums[1:]) * inverse
            ids += [key] * (len(signs) + 1)
            places += [*range(len(signs)), -1]
            found += [without, sums[-1:]]
        return {"key": ids, "place": places, "hash": np.concatenate(found).astype(np.int64)}

    keyed = cut_lineage(words.select(F.xxhash64("word").alias("key"), "word"))
    rows = cut_lineage(map_batches(keyed, hashes, "key bigint, place int, hash bigint"))
    less, whole = rows.where("place >= 0"), rows.where("place < 0").select(F.col("key").alias("other"), "hash")
    replaced = less.join(less.select(F.col("key").alias("other"), "place", "hash"), ["hash", "place"]).where(F.col("key") < F.col("other"))
    pairs = replaced.select("key", "other").union(less.join(whole, "hash").select("key", "other")).distinct()
    texts = pairs.join(keyed.select("key", F.col("word").alias("a")), "key").join(keyed.select(F.col("key").alias("other"), F.col("word").alias("b")), "other")
    return texts.where(one_edit("a", "b")).select("a", "b")


def one_edit(a: str, b: str):
    """Whether two strings differ by exactly one code point inserted, deleted or replaced, for long ones too."""
    return F.expr(f"{a} <> {b} AND levenshtein({a}, {b}, 1) = 1")


def spelling_groups(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n).

    A word's form is the near word of largest n (ties: smallest in code-point order) if that
    is at least twice its own; root follows forms to the last. Words without near ones
    have n_near 0, no form, and are their own root. An empty table gives no rows.
    """
    words = cut_lineage(words.select("word", "n"))
    size = F.char_length("word")
    pairs = trie_pairs(words.where(size <= LONG)).union(long_pairs(words.where(size >= LONG)))
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = once.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b")
    near = (both.join(words.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b").join(words.select(F.col("word").alias("a")), "a")
            .groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("b"))).alias("best")))
    told = words.join(near.withColumnRenamed("a", "word"), "word", "left")
    larger = -F.col("best.less") >= 2 * F.col("n")
    told = cut_lineage(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                                   F.when(larger, F.col("best.b")).alias("form"), F.when(larger, -F.col("best.less")).alias("form_n")))
    # Counts double along a chain of forms, so doubling the way per round needs few rounds.
    way = told.where(F.col("form").isNotNull()).select("word", F.col("form").alias("to"))
    while True:
        way = cut_lineage(way)
        on = way.select(F.col("word").alias("to"), F.col("to").alias("onward"))
        longer = cut_lineage(way.join(on, "to", "left").select("word", "to", "onward"))
        if longer.where(F.col("onward").isNotNull()).isEmpty():
            break
        way = longer.select("word", F.coalesce("onward", "to").alias("to"))
    root = way.select("word", F.col("to").alias("root"))
    return told.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups of the words of all whole texts; other columns are ignored."""
    return spelling_groups(word_counts(docs, id_col, text_col))
