import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_language_and_quality_keep_clean_documents(spark, stages):
    assert len(ids(stages[1])) >= 0.95 * len(ids(stages[0]))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = ids(labels.where("quality = 1")) & ids(stages[1])
    bad = ids(labels.where("quality = 0")) & ids(stages[1])
    assert len(good & ids(stages[2])) >= 0.97 * len(good)
    assert len(bad & ids(stages[2])) < len(bad)


def test_one_of_each_group_stays(stages):
    from test_dedup import brute_components

    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert ids(stages[3]) == {c for _, _, c in brute_components(rows, 5, 80)}


def test_passages_are_cut_and_all_stay(stages):
    from test_dedup import brute_removed

    assert ids(stages[3]) == ids(stages[4])
    gone = {d: n for d, _, n, _, _ in brute_removed([(r.doc_id, r.text) for r in stages[3].collect()])}
    before, after = ({r.doc_id: len(r.text.encode()) for r in s.collect()} for s in stages[3:5])
    for d, n in before.items():
        assert 0 <= n - after[d] <= gone[d] and gone[d] - (n - after[d]) <= 8 * (gone[d] > 0) + 8 * (gone[d] // 50)


def test_packed_is_all_that_was_kept(stages):
    packed = stages[5].groupBy("doc_id").agg(F.count("*").alias("n"))
    assert {r.doc_id for r in packed.collect()} == ids(stages[4])
    assert stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


@pytest.fixture()
def clashing(spark, prose, tmp_path):
    """Odd rows with columns named like those the operators make, and labels for some of them."""
    rows = [(i, prose(i, 60 + i % 40), "en", 0.5) for i in range(40)]
    rows += [(2, rows[1][1], "en", 0.1), (2, prose(777, 80), "en", 0.2), (None, prose(778, 50), None, 0.3), (50, None, None, 0.4),
             (51, "", None, 0.4), (52, prose(5, 60_000), "en", 0.0), (53, prose(909, 70), "en", 0.0), (53, prose(909, 70), "en", 0.0)]
    names = "doc_id bigint, text string, lang string, score double, kept_text string, n_bytes int, lang_pred string, _0 int, pack int"
    docs = spark.createDataFrame([(*r, "k", 1, "p", 2, 3) for r in rows], names)
    spark.createDataFrame([(i, 1 - (i % 4 == 0), 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return docs, str(tmp_path)


def test_stages_take_odd_rows_and_clashing_columns(spark, clashing):
    docs, folder = clashing
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            assert {(r.lang_pred, r["_0"], r.pack) for r in out.collect()} == {("p", 2, 3)}
        else:
            assert out.count() >= docs.count()
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_rows_that_share_an_id_are_judged_each(spark, clashing):
    docs, folder = clashing
    before, after = docs.collect(), pipeline.jaccard_join(spark, docs.repartition(3), folder).collect()
    texts = lambda rows: sorted((r.text for r in rows if r.text), key=str)
    # The copy of document 1 under id 2 goes, the unrelated text under id 2 stays; of two equal rows one stays.
    assert texts(after) == sorted({r.text for r in before if r.text}, key=str)
    assert {r.doc_id for r in after if r.text == before[1].text} == {1}
    assert sum(r.text in (None, "") for r in after) == 2


def test_documents_without_a_known_language_stay(spark, clashing):
    docs, folder = clashing
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert pipeline.language_id(spark, unlabelled, folder).count() == docs.where("length(text) > 0").count()
