"""The pipeline's stages on the small tables: decisions take effect, clean documents stay."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessella.llm import decontaminate, packing, quality_rules, simhash
from tessella.llm.text import words
from tessella.plans.materialize import materialize


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs]
    for name, stage in cp.STAGES:
        out = materialize(stage(spark, seen[-1], sf_dir), "test")
        if name != cp.STAGES[-1][0]:
            assert tuple(out.columns) == cp.COLUMNS and dict(out.dtypes) == dict(docs.dtypes)
        seen.append(out)
    ids = [{r[0] for r in s.select("doc_id").collect()} for s in seen]
    good = {r.doc_id for r in quality_rules.judge(docs.select("doc_id", "text")).filter("kept").collect()}
    assert ids[1] == good and ids[2] == ids[1]
    groups = simhash.similar_groups(seen[2]).collect()
    assert ids[3] == {r.component_id for r in groups}
    bad = {r.doc_id for r in decontaminate.contamination(seen[3], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated").collect()}
    assert ids[4] == ids[3] - bad
    assert seen[5].count() == packing.chunks(seen[4], "doc_id", words(F.col("text")), packing.MAX_LEN).count() and ids[5] == ids[4]
    clean = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    assert len(clean & ids[1]) >= 0.9 * len(clean & ids[0])
    again = cp.run(spark, sf_dir)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, seen[5].collect()))
