"""The pipeline's stages on odd rows and end to end."""

from pathlib import Path

import corpus_pipeline
from framewake.llm import simhash
from framewake.llm.common import placed

from .helpers import documents, empty


def test_each_stage_keeps_the_columns(spark):
    docs = documents(spark)
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, empty(spark), "").count() == 0


def test_stages_leave_no_tables_behind(spark):
    folder = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    before = set(folder.glob("framewake-*")) if folder.exists() else set()
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    new = set(folder.glob("framewake-*")) - before
    assert len(new) == 1 and "simhash_near_dedup" in new.pop().name and packed.count() > 0


def test_places_do_not_depend_on_splits(spark, tmp_path):
    docs = documents(spark, [f"text {i} of some words that go on {i}" for i in range(300)]).repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    seen = []
    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        try:
            rows, names = placed(spark.read.parquet(str(tmp_path / "docs")))
            seen.append((rows.rdd.getNumPartitions(), sorted(map(repr, rows.select("doc_id", "text", *names).collect()))))
            kept = simhash.keep_first(spark.read.parquet(str(tmp_path / "docs")))
            seen[-1] += (sorted(r.doc_id for r in kept.where("doc_id is not null").collect()),)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen[0][0] != seen[1][0] and seen[0][1:] == seen[1][1:]
    joined = docs.join(docs.select("doc_id").distinct(), "doc_id")  # rows of no file are stored first
    assert placed(joined)[0].count() == joined.count()


def test_run_packs_what_the_stages_leave(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = docs
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf).cache()
        counts.append(left.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    packed = corpus_pipeline.run(spark, sf).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in left.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
    stage2 = corpus_pipeline.quality_rules(spark, corpus_pipeline.quality_classifier(spark, docs, sf), sf)
    stay = {r.doc_id for r in stage2.collect()}
    long = {r.doc_id for r in docs.collect() if len((r.text or "").split()) >= 20}
    clean = [i for i in labels.index if labels[i] == 1 and i in long]
    assert sum(i in stay for i in clean) >= 0.98 * len(clean)
