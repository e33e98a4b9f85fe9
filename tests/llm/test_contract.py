import re

import corpus_pipeline
import __spark_entry__ as entry
from strandlake.llm import queries


def test_one_query_for_each_operator_and_the_pipeline():
    names = set(queries.all_queries())
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names - {"pipeline"}} == set(range(1, 14)) and len(names) == 14
    assert names <= set(entry.queries()) and set(queries.all_oracles()) <= names


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]


def test_pipeline_on_planted_documents(spark, tmp_path):
    import random

    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n)) + "."
    item = text(30)
    rows = [(i, text(80), "en", "s", 1) for i in range(300)]
    rows[200:] = [(i, t + " vile slur awful", *x) for i, t, *x in rows[200:]]
    rows[10] = (10, rows[11][1], "en", "s", 1)
    rows[12] = (12, rows[13][1] + " tail", "en", "s", 1)
    rows[14] = (14, text(40) + " " + item + " " + text(40), "en", "s", 1)
    rows[15] = (15, text(30) + " password=abcd1234efgh " + text(30), "en", "s", 1)
    rows[16], rows[17] = (16, None, "en", "s", None), (17, "", None, None, 0)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 200)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert after.columns == docs.columns
            kept[name] = {r.doc_id: r.text for r in after.collect()}
            docs = after
    assert set(kept["toxicity"]) == set(range(200))
    assert set(kept["near_duplicates"]) == set(range(200)) - {11, 13, 17}
    assert set(kept["decontamination"]) == set(kept["near_duplicates"]) - {14}
    assert set(kept["secrets"]) == set(kept["decontamination"]) and "[SECRET]" in kept["secrets"][15] and "abcd1234" not in kept["secrets"][15]
    assert {r.doc_id for r in after.collect()} == set(kept["secrets"])
