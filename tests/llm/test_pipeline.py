import corpus_pipeline
from pyspark.sql import functions as F
from byteloom.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, SF), f"t{k}")
        if k < 4:
            assert docs.columns == columns, name
            now = {r.doc_id: r for r in docs.collect()}
            assert set(now) <= set(before) and all(r.n_chars == len(r.text) for r in now.values())
            assert len(now) > 0.6 * len(before), name
            if name in ("quality classifier", "MinHash near-dedup"):
                assert all(now[d].text == before[d] for d in now)
            else:
                assert set(now) == set(before)
            before = {d: r.text for d, r in now.items()}
    assert {r.doc_id for r in docs.collect()} == set(before)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_hard_rows_and_clashing_columns(spark):
    """Nulls, repeated rows, and columns of the stages' own names go through all of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    more = docs.limit(3).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(2).withColumn("text", F.lit("")))
    docs = docs.unionByName(more).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    names = ["score", "__hash", "__key", "__tag", "__score", "n_lines", "n_removed", "n_replaced", "pos", "node", "root", "k", "t"]
    docs = docs.withColumns({n: F.lit("mine") for n in names})
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stored(stage(spark, docs, SF), f"h{k}")
        rows = docs.collect()
        assert rows and docs.columns[-len(names) :] == names and all(r[n] == "mine" for r in rows for n in names), name


def test_run_leaves_only_its_result(spark):
    import glob

    from byteloom.llm.common import shared_dir

    here = shared_dir(spark).removeprefix("file:") + "/byteloom/*"
    before = set(glob.glob(here))
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and len(set(glob.glob(here)) - before) == 1
