"""Training takes every labelled row: counts, filters and cuts by hand."""

import numpy as np
from pyspark.sql import functions as F

from tapeloom.llm import common, toxicity


def test_every_labelled_row_counts(spark, monkeypatch):
    number = F.col("doc_id")
    text = F.concat_ws(" ", F.concat(F.lit("w"), number % 700), F.when(number % 3 == 0, F.lit("vile")), F.when(number % 9 == 1, F.lit("vile thing")), F.concat(F.lit("x"), number % 41))
    docs = spark.range(16_000).withColumnRenamed("id", "doc_id").withColumns({"text": text, "lang": F.when(number % 2 == 0, F.lit("en"))})
    labels = docs.select("doc_id", (number % 3 == 0).cast("int").alias("toxic"))
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", 40_000)
    models = [toxicity.train(docs.repartition(n), labels) for n in (2, 7)]
    assert all((a == b).all() for a, b in zip(models[0].params(), models[1].params())) and models[0].shift == models[1].shift

    check = common.unit_hash(F.lit("check"), "doc_id") < toxicity.CHECK
    rows = docs.join(labels, "doc_id").withColumn("check", check).collect()
    learn, told = ([r for r in rows if r["check"] is v] for v in (False, True))
    seen, total = np.zeros((2, 2, 1 << toxicity.BUCKET_BITS)), np.bincount([r.toxic for r in learn])
    for r in learn:
        for column in (0, 1):
            seen[column, r.toxic, np.unique(toxicity.words(r.text)[:, column])] += 1
    clean, toxic = seen[:, 0] + 0.5, seen[:, 1] + 0.5
    odds = np.log(toxic / (total[1] + 1)) - np.log(clean / (total[0] + 1))
    odds = np.sign(odds) * np.maximum(np.abs(odds) - np.sqrt(1 / toxic + 1 / clean), 0) * (seen.sum(axis=1) >= toxicity.LEAST_SEEN)
    first = toxicity.untrained(odds)
    assert len(learn) > 12_000 and np.allclose(models[0].word, first.word, atol=1e-6) and np.allclose(models[0].stem, first.stem, atol=1e-6)
    assert not np.allclose(models[0].top, first.top)

    for lang in (None, "en"):
        own = [r for r in told if lang is None or r.lang == lang]
        z, y = models[0].all_logits([r.text for r in own]), np.array([r.toxic for r in own])
        tries = sorted(set(z))
        f1 = [2 * (y[z >= t]).sum() / ((z >= t).sum() + y.sum()) for t in tries]
        k = f1.index(max(f1))
        cut = (tries[k] + (tries[k - 1] if k else tries[k] - 2)) / 2
        want = np.log(0.7 / 0.3) - cut if lang is None else 1 / (1 + np.exp(-cut - models[0].shift))
        assert np.isclose(models[0].shift if lang is None else models[0].thresholds[lang], want)


def test_an_id_of_many_rows_counts_once_and_one_label_gives_none(spark):
    docs = spark.range(3000).select(F.lit(5).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionByName(spark.createDataFrame([(6, None, None), (None, "no id", "en"), (7, "a b", "de")], "doc_id bigint, text string, lang string"))
    labels = spark.createDataFrame([(5, 0), (5, 1), (6, 0), (7, 0), (8, 1), (None, 1)], "doc_id bigint, toxic int")
    assert sorted(tuple(r) for r in toxicity.labelled(docs, labels).collect()) == [(5, 1, "text 0", "en"), (6, 0, None, None), (7, 0, "a b", "de")]
    for label in (0, 1):
        model = toxicity.train(docs, labels.where(F.col("doc_id").isin(6, 7)).withColumn("toxic", F.lit(label)))
        assert toxicity.score(docs, model).where("score >= 0.7").isEmpty()
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == docs.count()
