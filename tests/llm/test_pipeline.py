"""The pipeline stage by stage: which rows stay, whatever their ids and further columns."""

import corpus_pipeline
import pytest
from comptoir.llm import packing, pii, simhash
from comptoir.llm.shared import written
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    line = " ".join(f"mot{i}" for i in range(60))
    odd = [(2**53 + 1, line), (None, line), (2**53 + 3, line + " fin"), (2**62 + 1, "une autre histoire de cette ville, plus courte"), (None, None), (2**53 + 5, ""), (2**53 + 7, "écrire à jean@ex.fr"), (2**53 + 7, "écrire à jean@ex.fr"), (2**53 + 9, "mot " * 4000)]
    more = spark.createDataFrame(odd, "doc_id long, text string").select("doc_id", "text", F.lit("fr").alias("lang"), F.lit("odd").alias("source"), F.length("text").cast("long").alias("n_chars"))
    return written(real.unionByName(more).withColumns({"node": F.lit("clash"), "first": F.lit(7), "expected_grade": F.lit("own"), "n": F.lit(1)}).coalesce(2), "pipeline-test")


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_quality_keeps_columns_and_rows_whole(spark, docs):
    got = corpus_pipeline.quality_stage(spark, docs, SF)
    assert got.columns == docs.columns
    all_, kept = rows(docs), rows(got)
    left = list(all_)
    for r in kept:
        left.remove(r)  # every row that stays is one of docs, as often as there
    assert 0 < len(kept) < len(all_)


def test_near_duplicates_keep_one_of_each_group_and_every_row_without_an_id(spark, docs):
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert got.columns == docs.columns
    first = {(r["doc_id"], r["first"]) for r in simhash.near_duplicate_groups(docs).collect()}
    want = {i for i, f in first if i is not None and i == f}
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    assert {i for i in ids if i is not None} == want and sum(i is None for i in ids) == docs.where("doc_id IS NULL").count()
    assert len([i for i in ids if i is not None]) == len(want)
    large = {i for i in ids if i is not None and i > 2**53}
    assert 2**53 + 1 in large and 2**53 + 3 not in large and {2**62 + 1, 2**53 + 7, 2**53 + 9} <= large


def test_personal_data_and_packing_keep_every_row(spark, docs):
    got = written(corpus_pipeline.pii_stage(spark, docs, SF), "redacted")
    assert got.columns == docs.columns and got.count() == docs.count()
    assert {r["text"] for r in got.where(f"doc_id = {2**53 + 7}").collect()} == {"écrire à [EMAIL]"}
    untouched = {r["doc_id"] for r in pii.detect(docs, pii.Detector()).where("size(base) = 0").select("doc_id").collect()}
    assert {2**62 + 1, 2**53 + 9} <= untouched
    pieces = corpus_pipeline.packing_stage(spark, got, SF)
    per = pieces.where("start = 0").groupBy("doc_id").count()
    assert rows(per) == rows(got.groupBy("doc_id").count())
    assert rows(pieces.drop("ids")) == rows(packing.pack(got).drop("ids"))


def test_empty_documents_go_through_all_stages(spark, docs):
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
        assert none.count() == 0, name


def test_unlike_documents_that_share_a_sixth_make_no_large_family(spark, monkeypatch):
    # any two share a sixth of their shingles, far below 0.8; families within two lanes of sketches held nearly all of them
    common = " ".join(f"mot{i}" for i in range(60))
    docs = spark.createDataFrame([(i, common + " " + " ".join(f"d{i}x{j}" for j in range(130))) for i in range(300)] + [(300, common + " " + " ".join(f"d0x{j}" for j in range(129)))], "doc_id long, text string")
    sizes, links = [], simhash.near_links

    def seen(sets, texts, families, *more):
        sizes.extend(r["count"] for r in families.groupBy("family").count().collect())
        return links(sets, texts, families, *more)

    monkeypatch.setattr(simhash, "near_links", seen)
    got = {r["doc_id"]: r["first"] for r in simhash.near_duplicate_groups(docs, recall=1 - 1e-12).collect()}
    assert got == {i: i % 300 for i in range(301)}
    assert max(sizes) <= 30
