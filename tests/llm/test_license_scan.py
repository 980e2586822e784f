import re
import string

import pytest
from pyspark.sql import functions as F

from cambium.llm.license_scan import BASE, NOTICES, Template, anchors, license_scan

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(text, base=BASE, notices=NOTICES):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = []
    for number, template in enumerate([*base, *notices]):
        for at in range(-len(template.words), len(words)):
            if all(at + p >= 0 and words[at + p : at + p + len(ph)] == ph for p, ph in template.mandatory()):
                same = sum(0 <= at + i < len(words) and words[at + i] == w for i, w in enumerate(template.words))
                found.append((number, template.label, at, same / len(template.words)))
    places = [at for n, _, at, _ in found if n < len(base)]
    labels = lambda rows: ",".join(sorted({r[1] for r in rows}))
    return (
        len(words), len(places), min(places, default=None), max(places, default=None), labels([r for r in found if r[0] < len(base)]), labels(found), max([r[3] for r in found], default=0.0),
    )


def scanned(df, **options):
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return [tuple(r) for r in license_scan(df, **options).select(*[f"licences.{n}" for n in names]).collect()]


TEXTS = [
    None, "", " \n", "no licence here", "All Rights Reserved", "all rights  reserved. ALL-RIGHTS/RESERVED all rights of reserved", "cc by", "CC BY-NC 4.0", "by cc",
    "This work is licensed under the GNU General Public License, version 3.", "general public license", "eneral public license", "general public  licenseé",
    "Apache License, Version 2.0", "x Apache License, Version 2.0", "the apache license version 2 1",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the “Software”), to deal in the Software without restriction",
    "permission is hereby granted free of charge. And much later: to deal in the software without restriction",
    "Redistribution and use in source and binary forms, with or without any modification are permitted provided that the following conditions are met",
    "K ccK by", "CC\x00BY", "cc by" * 3, "cc by " * 40, "ÀLL rights reserved", "all rights reserved " * 3000 + "cc by", "SPDX-License-Identifier: MIT",
]


def test_equals_brute_force(spark, docs, prose):
    texts = [*TEXTS, *TEXTS[4:8], *[f"{prose(200, i)} {TEXTS[i % len(TEXTS)]} {prose(9, i)}" for i in range(40)]]
    df = docs(texts, ids=[None, 1, 1, *range(3, len(texts))])
    out = license_scan(df)
    assert out.columns == [*df.columns, "licences"]
    assert out.drop("licences").collect() == df.collect()
    assert scanned(df) == [brute(t) for t in texts]


def test_counts_choose_what_is_looked_up_but_not_what_is_found(spark, docs):
    texts = [t for t in TEXTS if t]
    common = {w: n for n, w in enumerate(sorted({w for t in [*BASE, *NOTICES] for w in t.words}))}
    for documents in (common, {w: -n for w, n in common.items()}):
        assert scanned(docs(texts), documents=documents) == [brute(t) for t in texts]
    assert anchors(Template("x", "a b c d", ("a b", "d")), {"a": 5, "b": 2, "c": 0, "d": 9}) == [1, 3]
    assert anchors(Template("x", "a b c"), {"a": 1, "b": 1, "c": 0}) == [0, 2]


def test_own_templates_with_repeated_words(spark, docs):
    own = [Template("aa", "a a b a", ("a a", "a")), Template("one", "solo")]
    texts = ["a a b a a b a", "a a a a", "a a", "b a b a", "solo solo", "a a c a"]
    assert scanned(docs(texts), base=own[1:], notices=own[:1]) == [brute(t, own[1:], own[:1]) for t in texts]


def test_empty_table_and_phrases_that_are_missing(spark, docs):
    assert license_scan(docs([])).collect() == []
    with pytest.raises(StopIteration):
        Template("x", "a b", ("c",)).mandatory()


def test_no_shuffle_of_texts(spark, docs):
    plan = license_scan(docs(["cc by"])).select("doc_id", F.col("licences.score"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
