import zlib

import numpy as np
from pyspark.sql import functions as F

from cambium.llm import language_id
from cambium.llm.language_id import Network, document_probabilities, identify_languages, label_positions, loss_and_gradients


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = Network.fresh(["a", "b", "c"], 4, rng)
    for name in ("table", "inner", "shift", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    x, y = rng.integers(0, 256, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = loss_and_gradients(net, x, y)
    for w, g in zip(net.weights(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        w[at] += 1e-5
        up = loss_and_gradients(net, x, y)[0]
        w[at] -= 2e-5
        down = loss_and_gradients(net, x, y)[0]
        w[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_pooling_equals_segment_by_segment():
    rng = np.random.default_rng(1)
    net = Network.fresh(["a", "b"], 5, rng)
    texts = [rng.integers(1, 256, n).astype(np.uint8).tobytes() for n in (1, 255, 256, 257, 3000, 0, 40)]
    got = document_probabilities(net, texts)
    for text, row in zip(texts, got, strict=True):
        total = np.zeros(2)
        for at in range(0, len(text), language_id.SEGMENT):
            part = np.frombuffer(text[at : at + language_id.SEGMENT], np.uint8)
            total += label_positions(net, part[:, None], np.array([len(part)])).sum((0, 1))
        assert np.allclose(row, total / max(1, len(text)), atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("row", F.lit(1)).withColumn("out", F.lit(2))
    rows = identify_languages(docs).collect()
    assert all(r.language.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.language.score <= 1 for r in rows)
    held = [r for r in rows if r.language.held_out]
    assert sum(r.language.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_edge_cases(docs):
    texts = [None, "", "12 34 !?", "\n", "the only text here", "the only text here", "é" * 70_000]
    rows = identify_languages(docs(texts, langs=["en"] * 6 + [None], ids=[0, 1, 2, 3, 4, 4, None]), steps=2).collect()
    assert [r.language.lang_pred for r in rows] == ["und"] * 4 + ["en"] * 3
    assert all(r.language.score == 0 for r in rows[:4]) and rows[6].language.held_out and rows[0].key == 1
    assert identify_languages(docs([])).collect() == []
    unknown = identify_languages(docs(["words"], langs=[None]), keep=["doc_id"]).collect()
    assert [(r.doc_id, r.language.lang_pred, r.language.score) for r in unknown] == [(0, "und", 0.0)]


def test_more_languages_than_are_listed(docs):
    texts, langs = [f"text {i} of some length" for i in range(300)], [f"l{i % 30}" for i in range(300)]
    known = docs(texts, langs=langs).selectExpr("doc_id AS id", "text", "lang AS label")
    few = language_id.training_sample(known, 4, 10, listed=60)
    assert len(few) == 120 and {r["nth"] for r in few} == {1, 2, 3, 4}
    many = language_id.training_sample(known, 4, 10, listed=15)
    assert len(many) == 60 and {r["label"] for r in many} == set(langs)
    assert [r for r in few if r["nth"] <= 2] == many
    assert len(language_id.training_sample(known, 4, 10, listed=2)) == 30
