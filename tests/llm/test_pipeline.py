import corpus_pipeline
from fixtures import CLASHING, invented
from pyspark.sql import functions as F

import __spark_entry__
from segmenta.llm import queries


def write(spark, folder):
    texts = {i: invented(i, 60, 5000) for i in range(60)}
    texts |= {100 + i: texts[i].upper() + "!!" for i in range(40)}  # junk
    texts |= {200 + i: texts[i] + " extra" for i in range(5)}  # near copies
    item = invented(777, 20, 5000)
    texts[300] = texts[59] + " " + item
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(not 100 <= i < 200), 0) for i in texts if i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts


def test_stages(spark, tmp_path):
    texts = write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "tokens":
            assert docs.columns == columns
    clean = set(range(60))
    assert set(seen["quality"]) == set(texts) - set(range(100, 200))
    assert clean <= set(seen["near_dup"]) and not set(seen["near_dup"]) & set(range(200, 205))
    assert set(seen["decontaminate"]) == set(seen["near_dup"]) - {300}
    assert set(seen["mix"]) <= set(seen["decontaminate"]) and len(seen["mix"]) >= 55
    assert sorted(seen["tokens"]) == sorted(seen["mix"])


def test_run(spark, tmp_path):
    write(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert out[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:]))


def test_registered():
    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names and sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
