import re
from collections import Counter
from fractions import Fraction
from itertools import permutations
from math import factorial

from pyspark.sql import functions as F

from cambium.llm.filter_audit import filter_audit, shapley_weights

LABELS = "doc_id long, quality int, toxic int, lang string"


def fails(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    found = "A" if len(words) < 100 else ""
    found += "B" if 100 * len(set(words)) < 80 * len(words) else ""
    found += "C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else ""
    return found + ("D" if re.search(r"[#$%&*|]", text) else "")


def brute(rows, labels):
    """Every order run document by document."""
    out = {}
    ids = {}
    for i, text, _ in rows:
        if i is not None:
            ids[text or ""] = min(i, ids.get(text or "", i))
    said = [(i, q == 1, t == 1) for i, q, t in labels if i is not None]
    good, toxic = {i for i, q, _ in said if q}, {i for i, _, t in said if t}
    documents = [(i, fails(t) + ("E" if i is not None and ids[t or ""] < i else ""), lang or "") for i, t, lang in rows]
    for part in {p for *_, p in documents}:
        own = [(i, f) for i, f, p in documents if p == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                failing = sum(f in x for _, x in own)
                out[part, order, step] = [
                    len(left), len(gone), failing - len(gone), sum(x == f for _, x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
                total[f] += len(gone)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(total[f])
    return out


def audited(df, labels):
    rows = filter_audit(df, labels).collect()
    out = {(r.part, r.filter_order, r.step): list(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_equals_brute_force(spark, docs, prose):
    texts = [None, "", "\n", "A" * 50, "a # b", prose(120, 1, 4000), prose(120, 1, 4000), prose(99, 2), prose(300, 3, 40), prose(150, 4, 9000).upper(), f"{prose(200, 5, 9000)} | x"]
    texts = texts + texts[3:] + [prose(9000, 6)] + texts[5:7]
    ids = [None, 3, 3, 9, None, 7, 5, *range(20, 20 + len(texts) - 7)]
    ids[-2:] = [5, 5]
    langs = [("en", None, "fr", "")[i % 4] for i in range(len(texts))]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 30)] + [(None, 1, 1), (5, 0, 0), (6, None, None), (400, 1, 1)]
    frame = spark.createDataFrame([(i, int(q) if q is not None else None, int(t) if t is not None else None, "x") for i, q, t in labels], LABELS)
    got = audited(docs(texts, ids=ids, langs=langs), frame)
    assert got == brute(list(zip(ids, texts, langs, strict=True)), labels)
    assert {p for p, *_ in got} == {"en", "fr", ""}


def test_copies_of_one_text_in_all_parts(spark, docs):
    langs = [("en", "fr", "de")[i % 3] for i in range(300)]
    got = audited(docs(["same"] * 300, langs=langs), spark.createDataFrame([(0, 1, 1, "x"), (1, 1, 0, "x")], LABELS))
    assert got == brute([(i, "same", p) for i, p in enumerate(langs)], [(0, 1, 1), (1, 1, 0)])
    # every row of one part is a copy, and the part is still there
    got = audited(docs(["same"] * 3, langs=["en", "fr", "fr"]), spark.createDataFrame([], LABELS))
    assert got["fr", "EABCD", 1][:2] == [0, 2]


def test_empty_tables(spark, docs):
    assert filter_audit(docs([]), spark.createDataFrame([], LABELS)).collect() == []


def test_least_squares_give_shapley_values():
    for n in (2, 3, 5):
        weights = shapley_weights(n)
        for i in range(n):
            want = [Fraction(0)] * (1 << n)
            for order in permutations(range(n)):
                before = sum(1 << j for j in order[: order.index(i)])
                want[before] -= Fraction(1, factorial(n))
                want[before | 1 << i] += Fraction(1, factorial(n))
            assert weights[i][1:] == want[1:]  # the empty coalition removes nothing


def test_own_filters(spark, docs):
    df = docs(["a", "b", "a", "c"], langs=["x"] * 4)
    rows = filter_audit(df, spark.createDataFrame([], LABELS), {"is_a": F.col("text") == "a"}, copies="copy").collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in rows} == {
        ("is_acopy", 1): (2, 2, 0, 1, 3), ("is_acopy", 2): (2, 0, 1, 0, 1), ("copyis_a", 1): (3, 1, 0, 0, 1), ("copyis_a", 2): (2, 1, 1, 1, 3),
    }
