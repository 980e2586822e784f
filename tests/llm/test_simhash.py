import string

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cambium.llm import simhash
from cambium.llm.simhash import MIN_SHARED, fingerprint, link_postings, posting_masks, shared_bytes, simhash_groups

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    prints = [plain(t) for _, t in rows]
    root = [i for i, _ in rows]
    out = []
    for a, (i, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            x = prints[todo.pop()]
            new = {b for b, y in enumerate(prints) if (x ^ y).bit_count() <= 2 and rows[b][0] is not None} - seen
            seen |= new
            todo += new
        root[a] = None if i is None else min(rows[b][0] for b in seen if rows[b][0] is not None)
        out.append((i, f"{prints[a]:016x}", root[a]))
    return sorted(out, key=repr)


@given(st.text(alphabet="aB é\t\n\x0b\x1c Z.", max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprint_equals_plain_version(text):
    assert fingerprint(text) == plain(text)


def test_hash_is_that_of_spark(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), min_size=1, max_size=2))
@settings(max_examples=100, deadline=None)
def test_linked_prints_meet_in_a_posting(x, bits):
    a, b = np.array([x], np.uint64), np.array([x ^ sum(1 << i for i in bits)], np.uint64)
    masks = [m for m in posting_masks() if (a & m == b & m).all()]
    assert masks and shared_bytes(a, b)[0] >= MIN_SHARED
    moved, root = link_postings(np.zeros(2, np.int64), np.repeat(masks[0], 2), np.concatenate([a, b]))
    assert len(moved) == 1 and {int(moved[0]), int(root[0])} == {int(a[0]), int(b[0])}


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), min_size=1, max_size=2))
@settings(max_examples=100, deadline=None)
def test_linked_prints_meet_in_a_list(x, bits):
    a, b = np.array([x], np.uint64), np.array([x ^ sum(1 << i for i in bits)], np.uint64)
    assert any((a & m == b & m).all() for m in simhash.list_masks())


def prints_in_clusters(n, seed):
    """Fingerprints around few centers, a list of the index with many members, and pairs that share four or five bytes only."""
    rng = np.random.default_rng(seed)
    centers = rng.integers(0, 2**64, 6, np.uint64)
    found = {int(c) for c in centers}
    for _ in range(n):
        x = int(rng.choice(centers)) if rng.random() < 0.5 else int(rng.choice(sorted(found)))
        for bit in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
            x ^= 1 << bit
        found.add(x)
    found |= {int(centers[0]) & ~0xFFFFFFFF | int(v) for v in rng.integers(0, 2**32, n)}
    return np.array(sorted(found), np.uint64)


def groups_of(fp):
    apart = np.bitwise_count(fp[:, None] ^ fp[None]) <= 2
    label = np.arange(len(fp))
    while True:
        new = np.where(apart, label[None], len(fp)).min(1)
        if (new == label).all():
            return {int(x): int(fp[i]) for x, i in zip(fp, label, strict=True)}
        label = new


@pytest.mark.parametrize("short, longest", [(64, 65_536), (3, 65_536), (64, 40), (2, 5)])
def test_lists_of_any_length(spark, monkeypatch, short, longest):
    from cambium.llm.common import components

    monkeypatch.setattr(simhash, "SHORT_LIST", short)
    monkeypatch.setattr(simhash, "LONGEST_LIST", longest)
    fp = prints_in_clusters(150, short)
    members = spark.createDataFrame([(int(v),) for v in fp.view(np.int64)], "fp long")
    found = {r.id % 2**64: r.root for r in components(simhash.posting_links(members)).collect()}
    want = groups_of(fp)
    got = {x: found.get(x, np.array([x], np.uint64).view(np.int64)[0]) for x in want}
    for x, y in zip(want, list(want)[1:]):
        assert (want[x] == want[y]) == (got[x] == got[y])
    assert len(set(got.values())) == len(set(want.values()))


def test_the_tally_rejects_pairs(monkeypatch):
    """Most pairs that meet in a list share too few positional bytes, and are dropped before any bits are compared."""
    fp = prints_in_clusters(60, 1)
    mask = simhash.list_masks()[-1]
    members = fp[(fp & mask) == max(set((fp & mask).tolist()), key=(fp & mask).tolist().count)]
    tallied = []
    monkeypatch.setattr(simhash, "shared_bytes", lambda a, b: tallied.append(shared_bytes(a, b)) or tallied[-1])
    simhash.link_lists(np.array([len(members)]), members)
    assert len(tallied[0]) == len(members) * (len(members) - 1) // 2 > 100
    assert 0 < (tallied[0] >= MIN_SHARED).sum() < len(tallied[0]) / 2


def test_equals_brute_force(docs, prose):
    texts = [prose(60, i) for i in range(40)]
    for i in range(40):
        words = texts[i % 7].split()
        words[i % 50] = "changed"
        texts.append(" ".join(words))
    texts += [texts[1].upper(), texts[1].replace(" ", "\t\n"), None, "", " \n", "one", "ONE", "one two", "one\ttwo", prose(30_000, 99), prose(30_000, 99) + " more"]
    texts += [texts[3]] * 5
    ids = [*range(len(texts) - 4), 3, 3, None, None]
    got = simhash_groups(docs(texts, ids=ids))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(list(zip(ids, texts, strict=True)))
    assert simhash_groups(docs([])).collect() == []


def test_chain_of_prints_is_one_component(spark):
    from cambium.llm.common import components
    from cambium.llm.simhash import posting_links

    rng = np.random.default_rng(0)
    x, chain = int(rng.integers(2**62)), []
    for _ in range(40):
        chain.append(x)
        for bit in rng.choice(64, 2, replace=False).tolist():
            x ^= 1 << bit
    signed = np.array(chain, np.uint64).view(np.int64).tolist()
    found = components(posting_links(spark.createDataFrame([(v, 0) for v in set(signed)], "fp long, rep long"))).collect()
    assert {r.root for r in found} == {min(signed)} and {r.id for r in found} == set(signed) - {min(signed)}
