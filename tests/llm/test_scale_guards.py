"""Shares that very large corpora give, and stretches of many hits."""
import time

import pyarrow as pa
from pyspark.sql import functions as F

from barloom.llm import jaccard, language, licenses, packing, quality


def test_the_smallest_share_still_learns(spark, documents, prose):
    rows = [(i, prose(i, 30)) for i in range(30)]
    docs = documents(rows).drop("lang").selectExpr("doc_id", "text", "if(doc_id % 2 = 0, 'aa', 'bb') AS lang")
    model = language.fit_languages(docs, sample_bytes=1e-9)
    assert model.names == ("aa", "bb")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id bigint, quality int")
    assert quality.fit_quality(docs, labels, sample_rows=1e-9) is not None


def test_a_long_text_of_hits_takes_linear_time():
    def seconds(n):
        start = time.process_time()
        found = licenses.scan_text(b"cc by " * n, licenses.PHRASES, tuple(sorted(licenses.NOTICES.items())))
        assert len(found[1]) == n and found[1][-1][0] == 2 * n - 2
        return time.process_time() - start

    seconds(1000)
    assert seconds(400_000) < 40 * max(seconds(40_000), 0.05)


def test_stretches_are_the_text():
    text = "plain words, here\tand there\n\nЖизнь 中文 more plain's  \n x ünï  中\r\n" * 3
    parts = packing.stretches(text)
    assert "".join(p for p, _ in parts) == text and {p for _, p in parts} == {True, False}
    assert packing.stretches("") == [] and packing.stretches("a\nb") == [("a\nb", True)]


def test_python_workers_forget_the_words_of_finished_tasks(spark, documents, prose):
    """Spark keeps workers for later stages: what one stage remembered must not stay beside the next one's."""
    docs = documents([(i, prose(i, 200)) for i in range(40)])
    docs = docs.withColumn("text", F.concat_ws(" ", "text", F.md5("text"))).repartition(4)
    weights = quality.fit_quality(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int"))
    assert jaccard.keep_one(docs).count() == quality.score_quality(docs, weights).count() == 40

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(jaccard._HASHES) + len(quality._HASHES)] * batch.num_rows, pa.int64())], names=["n"])

    assert {r.n for r in spark.range(0, 64, numPartitions=16).mapInArrow(held, "n bigint").collect()} == {0}
