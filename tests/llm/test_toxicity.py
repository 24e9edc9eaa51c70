"""Accuracy on documents held out, and what counterfactuals do for neutral mentions."""

import random
import zlib

import numpy as np
import pytest
from noteql.llm import toxicity
from pyspark.sql import functions as F

TERMS = toxicity.IDENTITY["religion"].split()


def corpus(rnd, n, often=TERMS[:1]):
    """Abuse, often of one group; harmless texts that seldom name any."""
    rows = []
    for i in range(n):
        y = int(rnd.random() < 0.4)
        lines = [" ".join(f"{rnd.choice('abcdefghij')}{rnd.randrange(40)}x" for _ in range(rnd.randint(3, 12))) for _ in range(rnd.randint(1, 30))]
        if y:
            for _ in range(rnd.randint(1, 3)):
                lines[rnd.randrange(len(lines))] += f" {rnd.choice(['dreck', 'drecks', 'fool', 'vermin'])} {rnd.choice(often) if rnd.random() < 0.8 else ''}"
        elif rnd.random() < 0.05:
            lines[0] += f" a {rnd.choice(TERMS)} neighbour"
        rows.append((i, ". ".join(lines), y))
    return rows


def test_counterfactuals_spare_neutral_mentions():
    rnd = random.Random(4)
    rows = corpus(rnd, 500)
    documents, labels = [toxicity.sentences(t) for _, t, _ in rows], [y for _, _, y in rows]
    plain = toxicity.fit(documents, labels, counterfactual=0.0)
    fair = toxicity.fit(documents, labels)
    kind = [fair.word(t) for t in TERMS]
    assert plain.word(TERMS[0]) - plain.word(TERMS[1]) > 0.5
    assert max(kind) - min(kind) < 0.2 * (plain.word(TERMS[0]) - plain.word(TERMS[1]))

    def score(model, text):
        return float(model.score(np.array([toxicity.WordScores(model).highest(text)]))[0])

    neutral = f"the {TERMS[0]} family next door has a garden"
    assert score(fair, neutral) < score(plain, neutral) and score(fair, neutral) < 0.5
    assert score(fair, "what vermin they are") > 0.5


def test_query(spark, tmp_path):
    rows = corpus(random.Random(8), 700)
    texts = [(i, t) for i, t, _ in rows] + [(None, "dreck"), (900, None), (901, ""), (902, "?!\n"), (903, "a1x " * 200_000 + ". such vermin"), (904, "a1x b2x c3x. " * 50_000), (0, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("y", F.lit(None).cast("int"))
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0, y) for i, _, y in rows] + [(None, 0, 1), (5000, 0, 1), (3, 0, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op13_toxicity(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [(by_id[i].predicted, y) for i, _, y in rows if by_id[i].held_out]
    assert len(held) > 100 and sum(p == y for p, y in held) >= 0.97 * len(held)
    assert by_id[None].predicted == 1 and by_id[903].predicted == 1
    assert [by_id[i].predicted for i in (900, 901, 902, 904)] == [0] * 4
    assert len({r.score for r in got if r.doc_id == 0}) == 1


def test_labels_that_are_held_out_teach_nothing(spark):
    rows = corpus(random.Random(9), 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    out = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    flipped = [(i, 1 - y if i in out else y) for i, _, y in rows]
    models = [toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in ([(i, y) for i, _, y in rows], flipped)]
    assert models[0] == models[1]


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)]])
def test_without_both_classes(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.5, 0.5]
    assert toxicity.score(docs.limit(0), model, keep=["text", "score"]).columns == ["text", "score"]


def test_given_data(spark):
    """At most one clean document in a hundred is taken for a toxic one, and most toxic ones are caught."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = toxicity.op13_toxicity(spark, sf).join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("found")).collect()
    n = {r.toxic: (r.found, r.n) for r in got}
    assert n[1][0] >= 0.85 * n[1][1] and n[0][0] <= 0.01 * n[0][1]
