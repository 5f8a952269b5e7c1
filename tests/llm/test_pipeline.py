import pytest

import corpus_pipeline
from notegrove.llm import compression_rules, decontaminate, packing, quality_model, simhash_dedup
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gave, written and read as the driver does it."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_follow_their_operators(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    good, ruled, single, clean, packed = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    assert ids(good) == ids(quality_model.quality_scores(docs, labels).filter("keep"))
    assert ids(ruled) == ids(compression_rules.compression_report(good).filter("keep"))
    assert ids(single) == ids(simhash_dedup.near_duplicate_groups(ruled))
    assert ids(clean) == ids(single) - ids(decontaminate.leaks(single, benchmark))
    assert ids(packed) == ids(clean) and packed.collect() and sorted(packed.collect()) == sorted(packing.pack(clean).collect())
    assert ids(docs) > ids(good) >= ids(ruled) > ids(single) > ids(clean)


def test_every_stage_takes_an_empty_table_and_clashing_names(spark, edge):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        got = stage(spark, edge, SF)
        assert name == "packing" or got.columns == edge.columns
        assert got.count() > 0


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(stages[-1].collect())


def test_labelled_good_documents_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = ids(labels.filter("quality = 1"))
    assert len(ids(stages[1]) & good) >= 0.97 * len(good)


def test_near_dedup_links_a_large_cluster_without_all_its_pairs(spark, monkeypatch):
    """250 versions of one text, no two the same: one stays, and fewer links than versions go into the components."""
    words = prose(1, 400).split(" ")
    rows = [(k, " ".join([*words[:k], f"edit{k}", *words[k + 1 :]])) for k in range(250)] + [(250 + k, prose(50 + k, 200)) for k in range(20)]
    docs, edges, components = spark.createDataFrame(rows, "doc_id long, text string"), [], simhash_dedup.components
    monkeypatch.setattr(simhash_dedup, "components", lambda found: edges.append(found.count()) or components(found))
    assert ids(corpus_pipeline.near_dedup(spark, docs, SF)) == {0, *range(250, 270)}
    assert 0 < edges[0] < 250


def test_without_equals_an_anti_join(spark):
    from pyspark.sql import functions as F

    from notegrove.llm._shared import without

    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("sieve"), F.lit("y").alias("part")).union(spark.createDataFrame([(None, "x", "y"), (7, "x", "y")], "doc_id long, sieve string, part string"))
    gone = spark.range(0, 5000, 7)
    got = without(docs, gone.union(gone).union(spark.createDataFrame([(None,)], "id long")))
    assert got.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in got.collect()) == sorted(r.doc_id or -1 for r in docs.collect() if r.doc_id is None or r.doc_id % 7)
    assert without(docs, gone.limit(0)).count() == 5002
