"""The stages on a small table: each takes effect, and what one keeps the next one gets."""

import re

import corpus_pipeline
from tests.llm.data import documents
from tidelog.llm.common import Scratch


def test_stages_in_turn(spark, tmp_path):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars").dropDuplicates(["doc_id"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, counts, scratch = docs, [docs.count()], Scratch(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = scratch.write(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns
        counts.append(now.count())
        if name == "quality_rules":
            assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) >= 50 for r in now.collect())
    assert counts[0] > counts[1] > counts[2] > counts[3] and counts[4] >= counts[3]
    assert now.select("doc_id").distinct().count() == counts[3]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in now.collect())
    assert out.where("not round_trip").isEmpty()


def test_awkward_tables(spark, tmp_path):
    """Null ids, repeated rows, doc_ids with several texts, and columns with the stages' own names."""
    from pyspark.sql import functions as F

    docs = documents(spark).withColumns({c: F.lit(7) for c in ("copy", "epochs", "n_words", "kept", "row", "distance")})
    nulls = docs.where("doc_id in (4, 5, 6)").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat(F.lit("other words first "), F.reverse("text")))
    other = docs.where("doc_id = 7").withColumn("doc_id", F.lit(4).cast("long"))
    for rows, least in ((docs.unionByName(nulls).unionByName(other), 40), (docs.limit(0), 0)):
        path = str(tmp_path / f"t{least}")
        rows.write.parquet(f"{path}/documents.parquet")
        now, scratch = spark.read.parquet(f"{path}/documents.parquet"), Scratch(spark)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = now.count()
            now = scratch.write(stage(spark, now, path), name)
            assert now.columns == rows.columns
            assert name == "source_mixture" or now.count() <= before
            if name == "exact_dedup":
                assert now.groupBy(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).count().where("count > 1").isEmpty()
        assert now.where("doc_id is null").count() == (3 if least else 0)
        assert now.count() >= least and now.where("copy <> 7 or epochs <> 7 or n_words <> 7").isEmpty()
        assert corpus_pipeline.encoded(spark, now, path).count() == now.count()
