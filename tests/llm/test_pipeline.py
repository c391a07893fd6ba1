import corpus_pipeline
from tallyforge.llm import quality
from tallyforge.llm.common import fold
from pyspark.sql import functions as F
from test_pairs import brute, hits


def test_stages(spark, docs, labels, benchmark, texts, tmp_path):
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    benchmark.write.parquet(f"{d}/benchmark.parquet")
    own = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    # the same decisions, plainly: classify, take the first of each class, drop what brute force finds
    model = quality.train(own, labels.where(fold(F.col("doc_id"), 5) != 0))
    good = sorted(r.doc_id for r in quality.score(own, model).where("predicted = 1").collect())
    root, _ = brute([texts[i] for i in good])
    first = [i for k, i in enumerate(good) if root[k] == k]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    left = {i for i in first if not hits(texts[i][0], items)[0]}
    stage = own
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, d)
        assert stage.columns == own.columns
    rows = stage.collect()
    assert {r.doc_id for r in rows} == left and len(rows) == len(left)
    assert all(r.n_chars == len(r.text) for r in rows)
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in packed} == left


def test_odd_tables(spark, odd, labels, benchmark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and clashing names go through every stage, columns kept."""
    d = str(tmp_path)
    odd.write.parquet(f"{d}/documents.parquet")
    # without a label every text is taken for a good one
    spark.createDataFrame([(None, None, None), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    benchmark.where("item_id is not null").write.parquet(f"{d}/benchmark.parquet")
    stage = own = spark.read.parquet(f"{d}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, d)
        assert stage.columns == own.columns, name
    # a row for each text but copies: of the equal texts of 6, 6 and 7 one stays
    left = sorted((r.doc_id or 0) for r in stage.collect())
    assert left == [0, 0, 1, 2, 3, 4, 5, 6, 6, 8, 9, 10]
    packed = corpus_pipeline.run(spark, d).collect()
    assert sorted(r.doc_id or 0 for r in packed if r.piece == 0) == left


def test_empty_tables(spark, docs, labels, benchmark, tmp_path):
    d = str(tmp_path)
    docs.limit(0).write.parquet(f"{d}/documents.parquet")
    labels.limit(0).write.parquet(f"{d}/labels.parquet")
    benchmark.limit(0).write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).collect() == []


def test_documents_of_two_columns(spark, docs, labels, benchmark, tmp_path):
    """Stages keep the columns that documents have, n_chars or not."""
    d = str(tmp_path)
    docs.select("doc_id", "text").write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    benchmark.write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() > 0
