import zlib

import numpy as np
from pyspark.sql import functions as F

from cambium.llm.quality import BUCKETS, PLACES, REACH, SIZE, add_contexts, calibrated, fit, index_vectors, pooled, score_quality, words


def test_contexts_equal_a_plain_loop():
    texts = ["One two, three!! 12 TWO two", "", "é é é é", "x"]
    data = [t.encode() for t in texts]
    bucket, text = words(data)
    place, value = index_vectors()
    dense = np.zeros((BUCKETS, SIZE))
    np.put_along_axis(dense, place, value, axis=1)
    assert (np.abs(dense).sum(1) == PLACES).all()
    expected = np.zeros((BUCKETS, SIZE), np.int64)
    for i in range(len(bucket)):
        for j in range(max(0, i - REACH), min(len(bucket), i + REACH + 1)):
            if text[i] == text[j]:
                expected[bucket[i]] += dense[bucket[j]].astype(np.int64)
    total = np.zeros((BUCKETS, SIZE), np.int64)
    add_contexts(total, (place, value), bucket, text)
    assert (total == expected).all() and len(bucket) == 8 + 4 + 1
    assert words([b"two"])[0][0] == words([b"Two"])[0][0] != words([b"TWO"])[0][0]


def test_pooling_equals_numpy():
    vectors = np.random.default_rng(0).standard_normal((BUCKETS, SIZE)).astype(np.float32)
    texts = [b"a b c a", b"", b"..", b"word " * 5000]
    for t, row in zip(texts, pooled(vectors, texts), strict=True):
        own = vectors[words([t])[0]]
        if len(own):
            assert np.allclose(row, [*own.mean(0), *own.var(0), np.log1p(len(own))], atol=1e-3)
        else:
            assert not row.any()


def test_fit_and_temperature():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 5))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(3000) < 0.1)).astype(int)
    scores = fit(x, y).scores(x)
    assert ((scores > 0.5) == y).mean() > 0.85
    assert abs(scores.mean() - y.mean()) < 0.03
    logits = rng.standard_normal(20_000) * 2
    truth = (rng.random(20_000) < 1 / (1 + np.exp(-logits))).astype(int)
    assert abs(calibrated(logits * 3, truth) - 3) < 0.3


def test_held_out_ranking(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("features", F.lit(1)).withColumn("row", F.lit(1))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = score_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.quality_of.score <= 1 for r in rows)
    assert all(r.quality_of.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.quality_of.predicted == (r.quality_of.score >= 0.3) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(truth[r.doc_id], r.quality_of.score) for r in rows if r.quality_of.held_out and r.doc_id in truth]
    good, bad = [s for q, s in held if q == 1], [s for q, s in held if q == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.93


def test_edge_cases(docs, spark):
    given = docs([None, "", "word", "word", "long " * 60_000], ids=[1, 2, 3, 3, None])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.quality_of.score for r in score_quality(given, none).collect()] == [0.5] * 5
    one = spark.createDataFrame([(i, 1) for i in range(4)] + [(3, None), (None, 0), (2, 7)], "doc_id long, quality int")
    rows = score_quality(given, one, keep=["doc_id"]).collect()
    assert len({r.quality_of.score for r in rows}) == 1 and rows[0].quality_of.score > 0.5 and rows[0].quality_of.predicted == 1
    assert score_quality(docs([]), one).collect() == []
