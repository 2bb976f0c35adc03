"""Importance resampling of a corpus towards a target distribution of hashed n-grams.

Words and n-grams are made by Arrow kernels on whole batches of texts: lower-casing,
splitting and dictionary codes for words; pairs of (code of the first n - 1 words, code of
the next) for longer runs, hashed once per distinct pair. A bucket's gain is the log ratio of
its smoothed shares in target and corpus, a document's weight the mean of its features'
gains, and documents with the highest weight plus repeatable Gumbel noise are drawn: a sample without
replacement in proportion to exp(weight / 1000).
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import arrow_schema, bound_batches, columns_batch, map_batches, number_in_order
from barloom.session import cut_lineage

#: What lies between words, after lower-casing A-Z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows that number_in_order gives one partition.
RANK_ROWS = 200_000


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Codes of all words, the distinct words by code, and each word's row; null texts have none."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(some).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.binary()).to_pylist(), rows.filter(some).to_numpy().astype(np.int64)


def features_of(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of 1 to ``longest`` words: the features' buckets and rows, in text order."""
    codes, distinct, rows = words_of(texts)
    hashes = np.fromiter(map(zlib.crc32, distinct), np.int64, len(distinct))
    runs, crc = codes, hashes
    for n in range(1, longest + 1):
        if n > 1:
            together = rows[n - 1:] == rows[:len(rows) - n + 1]
            pairs = (runs[:len(codes) - n + 1] * max(1, len(distinct)) + codes[n - 1:])
            # Runs that cross into the next text keep a code of their own and are left out below.
            pairs, runs = np.unique(pairs, return_inverse=True)
            first, second = pairs // max(1, len(distinct)), pairs % max(1, len(distinct))
            crc = np.fromiter((zlib.crc32(distinct[b], zlib.crc32(b" ", int(crc[a]))) for a, b in zip(first.tolist(), second.tolist(), strict=True)), np.int64, len(pairs))
            yield (crc % buckets)[runs][together], rows[n - 1:][together]
        else:
            yield (crc % buckets)[runs], rows


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n: features of all texts. A task sends each bucket once."""
    bound_batches(docs.sparkSession)
    schema = "bucket int, n bigint"
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for found, _ in features_of(batch.column(0), longest, buckets):
                total += np.bincount(found, minlength=buckets)
        full = np.flatnonzero(total)
        yield columns_batch({"bucket": full.astype(np.int32), "n": total[full]}, arrow)

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, for every bucket; ``buckets`` numbers in all."""
    spark = corpus.sparkSession
    both = (spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
            .join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0))
    both = cut_lineage(both)
    sums = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = ((F.col("t") + 1.0) * F.lit(float(sums["s"] + buckets))) / ((F.col("s") + 1.0) * F.lit(float(sums["t"] + buckets)))
    out = np.zeros(buckets, np.int64)
    for r in both.select("bucket", F.floor(1000.0 * F.log(ratio)).alias("gain")).collect():
        out[r["bucket"]] = r["gain"]
    return out


def weigh(docs: DataFrame, gains: np.ndarray, longest: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def score(batch):
        gain, n = shared.value, batch.num_rows
        words, features, sums = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for length, (found, rows) in enumerate(features_of(batch.column(1), longest, len(gain)), 1):
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            if len(starts):
                sums[rows[starts]] += np.add.reduceat(gain.take(found), starts)
                counts = np.diff(np.append(starts, len(rows)))
                features[rows[starts]] += counts
                if length == 1:
                    words[rows[starts]] = counts
        return {"doc_id": batch.column(0), "n_words": words, "n_features": features,
                "weight": np.where(features > 0, sums // np.maximum(features, 1), 0)}

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(plain, score, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20,
             seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words of every row; drawn rows have a rank.

    ``percent`` of the rows with ``min_words`` words or more are drawn, highest scores first, ties
    to the smaller id. Null and empty texts have no features, weight 0 and are never drawn; a null id
    is hashed as empty text and comes before all others in a tie. Repeated rows each take part and have
    consecutive ranks. Empty tables (of documents or target) are counted as 0 features. Other columns are ignored.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text, longest, buckets), buckets)
    weighed = weigh(docs, gains, longest, id_col, text_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut_lineage(weighed.withColumn("score", F.col("weight") + noise))
    fit = F.col("n_words") >= min_words
    drawn = percent * scored.where(fit).count() // 100
    cut = None
    if drawn:
        # Scores are whole numbers between about -40,000 and 60,000, so this table has a bounded number of rows.
        sizes = scored.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
        cut = sizes.withColumn("upto", upto).where(F.col("upto") >= drawn).agg(F.max("score")).first()[0]
    high = fit & (F.col("score") >= cut) if cut is not None else F.lit(False)
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = number_in_order(scored.where(high), [-F.col("score"), F.col("doc_id")], "rank", drawn // RANK_ROWS + 1)
    ranked = ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).cast("bigint").alias("rank"), "n_words")
    rest = scored.where(~high).select(*columns, F.lit(None).cast("bigint").alias("rank"), "n_words")
    return ranked.unionByName(rest)
