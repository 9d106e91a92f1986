"""Rows of a null or repeated id are judged by their own text in the pipeline."""

import corpus_pipeline as C


def test_a_leak_takes_its_own_row_only(spark, tmp_path):
    item = " ".join(f"b{k}" for k in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(None, f"x {item} y", "a"), (None, "clean", "b"), (4, "clean as well", "c"), (4, item, "d"), (5, None, None)]
    kept = C.drop_contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string, source string"), str(tmp_path))
    assert sorted(str(r.source) for r in kept.collect()) == ["None", "b", "c"]
