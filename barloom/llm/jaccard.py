"""N-gram Jaccard join with prefix filters under several global token orders.

A document is its set of word n-gram hashes. If two sets of a similarity of at least T share so
many tokens, then under any global order of tokens their prefixes (of |x| - ceil(T |x|) + 1
tokens) share one. All orders here put rare tokens first and differ in how equally rare ones are
arranged; a pair is verified only if the prefixes meet under every order.

Equal sets are one class. Only class representatives whose prefix holds a repeated token go
on. A token's list is not joined with itself at once: each document is first held against
the list's pivot (the member whose tokens are the most common, as the source of a
group of near copies is), which links most groups by as many comparisons as documents.
What is left are members of one list that are not in one component yet; these pairs are
enumerated, filtered by size, position and the other orders, and verified. Links inside
a component found already change nothing, so every component is exact.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from barloom.llm.common import WordHashes, freeing, freeing_groups, kept, mix, pack_documents, unpack, unpack_table
from barloom.llm.components import connected_components
from barloom.llm.exchange import bucket_count, corpus_bytes, key_bits, known_keys, repeated_keys, sums_of
from barloom.session import cut_lineage

#: Words in a shingle and the threshold in hundredths.
WORDS, PERCENT = 4, 85

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HASHES = WordHashes(function=xxhash.xxh3_64_intdigest)
_K = np.uint64(0x9E3779B97F4A7C15)
#: Salts of the orders; the first order arranges equally frequent tokens by hash alone.
_SALTS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams (A-Z in lower case); of all words together if fewer."""
    h = mix(_HASHES.of(text.translate(_LOWER).split()))
    if not len(h):
        return h
    size = min(words, len(h))
    # The salt keeps a short text's only shingle apart from full ones.
    out = np.full(len(h) - size + 1, np.uint64(size))
    for i in range(size):
        out = mix(out * _K + h[i:len(h) - size + 1 + i])
    return np.unique(out)


def prefix_length(size, percent: int):
    """Tokens of a prefix: size less the smallest overlap with any partner, plus one."""
    return size - (percent * size + 99) // 100 + 1


def orders(tokens: np.ndarray, sums: np.ndarray) -> list[np.ndarray]:
    """Places of the tokens under each global order, rare ones first."""
    level = np.floor(np.log2(np.maximum(sums, 1))).astype(np.int64)
    return [np.lexsort((tokens, sums)), *(np.lexsort((mix(tokens ^ salt), level)) for salt in _SALTS)]


def meet_sorted(a: np.ndarray, b: np.ndarray) -> int:
    """Elements two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)) if len(b) else 0


SETS = "node bigint, size bigint, common bigint, weight bigint, tokens binary, other_prefixes binary, prefix array<bigint>, places array<int>"


def document_sets(packs: DataFrame, words: int) -> DataFrame:
    """pack, place, doc_id, size and class_key (of the set) per document."""
    out = pa.schema([("pack", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("size", pa.int64()), ("class_key", pa.binary())])

    def run(batches):
        for batch in batches:
            for pack, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, texts = unpack(blob)
                sets = [shingles(t, words) for t in texts]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([pack] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()),
                                                  pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary())], schema=out)

    return packs.select("pack", "blob").mapInArrow(freeing(run), "pack bigint, place int, doc_id bigint, size bigint, class_key binary")


def candidate_sets(packs: DataFrame, representatives: DataFrame, words: int, percent: int) -> DataFrame:
    """One row per representative whose prefix holds a repeated token: its tokens, prefixes and counts.

    ``common`` counts its repeated tokens and ``weight`` says how common they are; ``prefix``
    has the repeated tokens of the first order's prefix and ``places`` where they stand.
    """
    total = corpus_bytes(packs)
    bits = key_bits(total)

    def keys_of(blob):
        sets = {s.tobytes(): s for s in (shingles(t, words) for t in unpack(blob)[1]) if len(s)}
        if not sets:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.unique(np.concatenate(list(sets.values())), return_counts=True)

    answers = repeated_keys(packs, keys_of, bits, bucket_count(total))
    # What a pack is told: its repeated keys, and which of its documents represent a class.
    chosen = representatives.groupBy("pack").agg(F.collect_list("place").alias("places"))
    told = answers.select("pack", "body", F.lit(None).cast("array<int>").alias("places")).unionByName(
        chosen.select("pack", F.lit(None).cast("binary").alias("body"), "places"))
    names = [n.split()[0] for n in SETS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    out = pa.schema(list(zip(names, kinds, strict=True)))

    def prepare(pack_rows: pa.Table, told_rows: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        keys, sums = known_keys([b for b in told_rows.column("body").to_pylist() if b is not None])
        for pack, blob in zip(pack_rows.column("pack").to_pylist(), pack_rows.column("blob").to_pylist(), strict=True):
            _, texts = unpack(blob)
            for place in sorted(p for ps in told_rows.column("places").to_pylist() if ps is not None for p in ps):
                tokens = shingles(texts[place], words)
                counts = sums_of(tokens, bits, keys, sums)
                p = prefix_length(len(tokens), percent)
                common = int(np.count_nonzero(counts >= 2))
                # With fewer repeated tokens than the smallest overlap there is no partner.
                if common < len(tokens) - p + 1:
                    continue
                first, *others = orders(tokens, counts)
                at = np.flatnonzero(counts[first[:p]] >= 2)
                rows.append(((pack << 16) | place, len(tokens), common, int(100 * np.log2(counts).mean()), tokens.tobytes(),
                             np.concatenate([np.sort(tokens[o[:p]]) for o in others]).tobytes(),
                             tokens[first[at]].view(np.int64).tolist(), at.tolist()))
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}, schema=out)

    return (packs.select("pack", "blob").groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(freeing_groups(prepare), SETS))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose prefixes meet under the other orders and whose sets reach the threshold."""
    whole = sets.select(F.col("node"), F.struct("tokens", "other_prefixes").alias("s"))
    joined = (pairs.select("a", "b").join(whole.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")
              .join(whole.select(F.col("node").alias("b"), F.col("s").alias("y")), "b"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = [[np.frombuffer(v, np.uint64) for v in batch.column(f"{side}_{part}").to_pylist()]
                     for part in ("tokens", "prefixes") for side in "xy"]
            keep = [is_similar(*four, percent) for four in zip(*sides, strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=out)

    return joined.select("a", "b", F.col("x.tokens").alias("x_tokens"), F.col("x.other_prefixes").alias("x_prefixes"),
                         F.col("y.tokens").alias("y_tokens"), F.col("y.other_prefixes").alias("y_prefixes")).mapInArrow(freeing(check), "a bigint, b bigint")


def is_similar(x: np.ndarray, y: np.ndarray, x_prefixes: np.ndarray, y_prefixes: np.ndarray, percent: int) -> bool:
    px, py = prefix_length(len(x), percent), prefix_length(len(y), percent)
    for i in range(len(_SALTS)):
        if not meet_sorted(x_prefixes[i * px:(i + 1) * px], y_prefixes[i * py:(i + 1) * py]):
            return False
    shared = meet_sorted(x, y)
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def may_link(x: str, y: str, percent: int):
    """Size, repeated tokens and place leave room for the overlap that the threshold asks for."""
    c = lambda side, name: F.col(f"{side}.{name}")
    need = percent * (c(x, "size") + c(y, "size"))
    room = F.least(c(x, "common"), c(y, "common"), c(x, "size") - c(x, "place"), c(y, "size") - c(y, "place"))
    return (100 * F.least(c(x, "size"), c(y, "size")) >= percent * F.greatest(c(x, "size"), c(y, "size"))) & ((100 + percent) * room >= need)


def similarity_links(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between representatives that give the exact connected components."""
    posts = (sets.select("node", "size", "common", "weight", F.explode(F.arrays_zip("prefix", "places")).alias("t"))
             .select("node", "size", "common", "weight", F.col("t.prefix").alias("token"), F.col("t.places").alias("place")))
    best = F.max(F.struct("weight", (-F.col("node")).alias("less"), "size", "common", "place")).alias("p")
    pivots = (posts.groupBy("token").agg(best, F.count("*").alias("n")).where("n > 1")
              .select("token", F.struct((-F.col("p.less")).alias("node"), "p.size", "p.common", "p.place").alias("p")))
    held = (posts.select("token", F.struct("node", "size", "common", "place").alias("m")).join(pivots, "token")
            .where((F.col("m.node") != F.col("p.node")) & may_link("m", "p", percent)))
    votes = cut_lineage(held.groupBy(F.col("m.node").alias("a"), F.col("p.node").alias("b")).agg(F.count("*").alias("n")))
    # First only the pivot that most of a document's tokens point to.
    main = votes.groupBy("a").agg(F.max(F.struct("n", "b")).alias("v")).select("a", F.col("v.b").alias("b"))
    links = cut_lineage(verified(main, sets, percent))
    labels = connected_components(links)
    label_of = lambda column, name: labels.select(F.col("node").alias(column), F.col("label").alias(name))

    def across(pairs: DataFrame) -> DataFrame:
        return (pairs.join(label_of("a", "x"), "a", "left").join(label_of("b", "y"), "b", "left")
                .where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b"))

    # Then the other pivots, where they would join two components.
    more = cut_lineage(verified(across(votes.join(main, ["a", "b"], "left_anti")), sets, percent))
    links = links.unionByName(more)
    labels = connected_components(links)
    # At last the members of one list that are still apart.
    posted = posts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_lists = posted.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    apart = cut_lineage(posted.join(open_lists, "token").select("token", F.struct("node", "label", "size", "common", "place").alias("m")))
    left, right = apart.select("token", F.col("m").alias("m")), apart.select("token", F.col("m").alias("p"))
    pairs = (left.join(right, "token").where((F.col("m.node") < F.col("p.node")) & (F.col("m.label") != F.col("p.label")) & may_link("m", "p", percent))
             .select(F.col("m.node").alias("a"), F.col("p.node").alias("b")).distinct())
    return links.unionByName(verified(pairs.join(votes.select("a", "b").union(votes.select("b", "a")), ["a", "b"], "left_anti"), sets, percent))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links reach) of every row.

    A null or blank text has no shingles and is linked with nothing. Repeated rows each keep a
    row (and are linked by their equal sets). A null id is reported as null and
    never names a component that has other ids. Other columns are ignored; an empty table
    gives no rows.
    """
    packs = pack_documents(docs, id_col, text_col)
    rows = kept(document_sets(packs, words))
    node = F.shiftleft("pack", 16) + F.col("place")
    classes = cut_lineage(rows.where("size > 0").groupBy("class_key").agg(F.min("doc_id").alias("first_id"), F.min(node).alias("node")))
    places = classes.select(F.shiftright("node", 16).alias("pack"), F.expr("cast(node & 65535 as int)").alias("place"))
    sets = cut_lineage(candidate_sets(packs, places, words, percent))
    labels = connected_components(cut_lineage(similarity_links(sets, percent)))
    grouped = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = grouped.where("label is not null").groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_class = grouped.join(smallest, "label").select("class_key", "component_id")
    return (rows.join(of_class, "class_key", "left")
            .select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest id (null last), of repeated ids the first.

    Rows are told apart by where they stand, so rows that share an id are judged each for
    itself. Null and blank texts have no partner and stay, one row each; all columns stay as they are.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    packs = pack_documents(docs, id_col, text_col, tuple(rest))
    rows = kept(document_sets(packs, words))
    node = F.shiftleft("pack", 16) + F.col("place")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", node.alias("at"))).alias("first")
    classes = cut_lineage(rows.where("size > 0").groupBy("class_key").agg(F.min(node).alias("node"), first))
    places = classes.select(F.shiftright("node", 16).alias("pack"), F.expr("cast(node & 65535 as int)").alias("place"))
    sets = cut_lineage(candidate_sets(packs, places, words, percent))
    labels = connected_components(cut_lineage(similarity_links(sets, percent)))
    grouped = cut_lineage(classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    stays = grouped.groupBy("label").agg(F.min("first").alias("first")).select("label", F.col("first.at").alias("stays"))
    of_class = grouped.select("class_key", "label").join(stays, "label").select("class_key", "stays")
    gone = (rows.join(of_class, "class_key").where(node != F.col("stays")).groupBy("pack").agg(F.collect_list("place").alias("places")))
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), *(StructField(f"_{i}", docs.schema[c].dataType) for i, c in enumerate(rest))])

    def drop(pack_rows: pa.Table, told: pa.Table) -> pa.Table:
        left_out = np.array([p for places in told.column("places").to_pylist() for p in places], np.int64)
        tables = []
        for blob in pack_rows.column("blob").to_pylist():
            inner = unpack_table(blob)
            stay = np.ones(inner.num_rows, bool)
            stay[left_out] = False
            tables.append(inner.filter(pa.array(stay)))
        return pa.concat_tables(tables)

    left = packs.select("pack", "blob").groupBy("pack").cogroup(gone.groupBy("pack")).applyInArrow(freeing_groups(drop), schema)
    named = {id_col: F.col("doc_id").cast(docs.schema[id_col].dataType), text_col: F.col("text").cast(docs.schema[text_col].dataType)} | {c: F.col(f"_{i}") for i, c in enumerate(rest)}
    return left.select(*(named[c].alias(c) for c in docs.columns))
