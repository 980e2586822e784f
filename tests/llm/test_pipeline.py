from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cambium.llm.common import file_order, running, settle
from cambium.llm.language_id import identify_languages
from cambium.llm.mixing import mix_sources, mixed_order
from cambium.llm.packing import pack
from test_line_dedup import brute as brute_lines
from test_packing import ids_of
from test_simhash import brute as brute_groups


def test_stages_equal_brute_force(spark, docs, prose, tmp_path):
    line = "This is the line that all of these documents share, in one case or other."
    texts = [f"{prose(30, i)}\n{line if i % 2 else line.upper()}\n{prose(10, 50 + i)}" for i in range(14)]
    texts += [prose(40, 3), prose(40, 3), None, "", "12 34", line, prose(5000, 8), prose(40, 3).upper()]
    langs = [("en", "fr")[i % 2] for i in range(len(texts))]
    df = docs(texts, langs=langs, sources=["ab"[i % 2] for i in range(len(texts))])
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]
    rows = [(r.doc_id, r.text) for r in now.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "language_id":
            told = {r.doc_id for r in identify_languages(now).where(F.col("language.score") >= corpus_pipeline.LEAST_SCORE).collect()}
            rows = [(i, t) for i, t in rows if i in told]
            assert told <= {i for i, t in zip(range(len(texts)), texts) if t and any(map(str.isalpha, t))}
        elif name == "line_dedup":
            rows = [(i, t) for i, _, _, t in brute_lines(rows)]
            assert out.where(F.col("n_chars") != F.char_length("text")).isEmpty()
        elif name == "simhash_near_dedup":
            stay = {i for i, _, root in brute_groups(rows) if i == root}
            rows = [(i, t) for i, t in rows if i in stay]
        if name == "best_fit_packing":
            got = Counter()
            for r in out.collect():
                got[r.doc_id] += r.length
            assert got == {i: len(ids_of(t)) + 1 for i, t in rows}
        else:
            assert out.columns == df.columns
            assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted(rows)
        now = out
    assert 0 < len(rows) < len(texts)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, now.select(key).collect()))


def test_empty_documents(spark, docs, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_running_sums_do_not_need_whole_keys(spark):
    rng = np.random.default_rng(0)
    data = [("ak"[i % 3 > 0], i, int(rng.integers(1, 9))) for i in range(200)]
    df = spark.createDataFrame(data, "k string, i int, v long")
    rows = running(df, ["k"], [F.col("i")], F.col("v"), "sum", 200, rows_per_salt=10).collect()
    for k in "ak":
        own = sorted((r for r in rows if r.k == k), key=lambda r: r["sum"])
        assert [r["sum"] for r in own] == list(np.cumsum([0, *(r.v for r in own)])[:-1])
    assert len(rows) == 200


def test_sequences_follow_the_mix(spark, docs, prose, monkeypatch):
    monkeypatch.setattr("cambium.llm.common.ROWS_PER_BLOCK", 3)
    texts = [prose((30, 30, 7, 90)[i % 4], i) for i in range(60)]
    df = docs(texts, sources=["aab"[i % 3] for i in range(60)])

    def sequences(rows, **options):
        out = corpus_pipeline.packing(spark, rows, "") if not options else pack(rows, order=file_order(), **options)
        return {(r.doc_id, r.piece): r.sequence_id for r in out.collect()}

    plain, even, uneven = settle(df), settle(mixed_order(df, weights={"a": 1, "b": 1}, block_bytes=50)), settle(mixed_order(df, weights={"a": 1, "b": 9}, block_bytes=50))
    found = [sequences(rows, capacity=64) for rows in (plain, even, uneven)]
    assert found[0] != found[1] != found[2] != found[0]
    places = {r.doc_id: n for n, r in enumerate(mix_sources(df, {"a": 1, "b": 9}, block_bytes=50).orderBy("mix.slot", "mix.at").select("doc_id").collect())}
    first = {}
    for (doc_id, piece), sequence in found[2].items():
        first[sequence] = min(first.get(sequence, (99, 0)), (places[doc_id], piece))
    assert [first[n] for n in range(len(first))] == sorted(first.values()) and len(first) > 5
    # long documents: no two share a sequence, and the stage itself keeps the order of the mix
    long = docs([prose(3500, i, 3000) for i in range(8)], sources=[*"aaaabbbb"])
    for weights in ({"a": 1, "b": 1}, {"a": 1, "b": 9}):
        rows = settle(mixed_order(long, weights=weights, block_bytes=1000))
        order = [r.doc_id for r in mix_sources(long, weights, block_bytes=1000).orderBy("mix.slot", "mix.at").select("doc_id").collect()]
        got = sequences(rows)
        heads = sorted(range(8), key=lambda i: got[i, 0])
        assert heads == order
    assert set(sequences(plain, capacity=64)) == set(found[1])


def test_near_duplicates_are_rows_and_not_ids(spark, docs, prose, tmp_path):
    one, other, third = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(3, one), (5, one), (5, other), (7, third), (7, third), (None, third), (None, third), (9, one.upper()), (2, other[:-1] + "q " + prose(200, 9))]
    docs([t for _, t in rows], ids=[i for i, _ in rows]).repartition(3).write.parquet(f"{tmp_path}/in")
    out = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/in"), "").collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted([(3, one), (5, other), (7, third), (None, third), (None, third), rows[-1]], key=repr)


def test_the_network_decides_who_stays(spark, docs, monkeypatch):
    """Texts in three sets of letters; a network that has learned nothing rejects what a trained one keeps."""
    texts = [w * 40 for i in range(20) for w in (f"abc{'abc'[i % 3]} ", f"xyz{'xyz'[i % 3]} ", f"klm{'klm'[i % 3]} ")] + ["123", None]
    df = docs(texts, langs=[("en", "fr", "de")[i % 3] for i in range(len(texts))])
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", 0.5)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, df, "").collect()}
    assert kept == set(range(60))
    monkeypatch.setattr(corpus_pipeline, "identify_languages", lambda d: identify_languages(d, steps=1, rate=0.0))
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, df, "").collect()} < kept


def test_shared_folder(spark, monkeypatch):
    from cambium.llm import common

    class Session:
        def __init__(self, **conf):
            self.conf = {k.replace("_", "."): v for k, v in conf.items()}

    warehouse = {"spark_sql_warehouse_dir": "file:/w"}
    assert common.shared_dir(Session(spark_checkpoint_dir="s3://a/b/", **warehouse)).startswith("s3://a/b/cambium-")
    assert common.shared_dir(Session(spark_master="local[4]", **warehouse)).startswith("file:/w/stages/cambium-")
    assert common.shared_dir(Session(spark_master="yarn", spark_sql_warehouse_dir="hdfs://w")).startswith("hdfs://w/stages/")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session(spark_master="spark://host:7077", **warehouse))
