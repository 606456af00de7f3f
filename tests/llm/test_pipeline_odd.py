"""The pipeline's stages on null ids, names that operators use inside, repeated rows, and no rows."""

import corpus_pipeline
import pytest


@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables(spark, sf, tmp_path, empty):
    d = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    more = ["1L AS uid", "1 AS row", "2 AS piece", "'x' AS kept", "3 AS batch"]
    rows = d.selectExpr("*", *more)
    nobody = d.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat_ws(' ', transform(split(text, ' '), (w, k) -> concat(w, 'e', 'n'))) AS text", "lang", "source", "n_chars", *more)
    blank = d.limit(1).selectExpr("77777L AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars", *more)
    t = rows.unionByName(rows.limit(3)).unionByName(nobody).unionByName(blank)
    t = t.limit(0) if empty else t
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, t, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == t.columns, name
        out.write.parquet(str(tmp_path / name))
        t = spark.read.schema(out.schema).parquet(str(tmp_path / name))
        counts.append(t.count())
    if empty:
        assert counts == [0] * 5
        return
    assert t.filter("doc_id = 77777").isEmpty() and t.filter("doc_id IS NULL").count() >= 1
    assert counts[0] <= 64 and counts[1] <= counts[0] - 3 and counts[2] <= counts[1] and counts[3] <= counts[2]
    assert t.select("doc_id").distinct().count() == counts[3]
