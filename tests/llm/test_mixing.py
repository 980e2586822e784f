from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cambium.llm.mixing import edf, mix_sources, mixed_order, whole_weights

def size(row):
    return max(1, len((row.text or "").encode()))


def test_documents_come_by_weight(docs):
    texts = ["x" * (1 + i * 7 % 30) for i in range(600)] + [None, "", "y" * 50_000]
    sources = [("a", "a", "a", "b", None, "c")[i % 6] for i in range(len(texts))]
    weights = {"a": 2, "b": 1, None: 1}
    df = mix_sources(docs(texts, sources=sources, ids=[None if i == 5 else i // 2 for i in range(len(texts))]), weights, block_bytes=50)
    rows = df.collect()
    assert len(rows) == len(texts) and Counter(r.text for r in rows) == Counter(texts) and df.columns[:-1] == docs([]).columns
    for s in set(sources):
        own = sorted((r for r in rows if r.source == s), key=lambda r: r.mix.at)
        at = 0
        for r in own:
            assert (r.mix["at"], r.mix.block) == (at, at // 50)
            at += size(r)
    # the slots of the blocks that hold documents are those of the schedule of all blocks: less than one block off the weights
    blocks = {s: -(-sum(size(r) for r in rows if r.source == s) // 50) for s in set(sources)}
    share = whole_weights({s: weights.get(s, 1) for s in blocks})
    slots = {(r.source, r.mix.block): r.mix.slot for r in rows}
    assert len(set(slots.values())) == len(slots)
    for (s, block), slot in slots.items():
        before, after = fluid(blocks, share, slot)[s], fluid(blocks, share, slot + 1)[s]
        assert before - 1 < block < before + 1 and after - 1 < block + 1 < after + 1


def test_blocks_grow_where_they_are_too_many(docs, monkeypatch):
    monkeypatch.setattr("cambium.llm.mixing.MOST_BLOCKS", 25)
    rows = mix_sources(docs(["x" * 10] * 300, sources=["ab"[i % 3 == 0] for i in range(300)]), {"a": 1, "b": 3}, block_bytes=10).collect()
    assert len({(r.source, r.mix.block) for r in rows}) == 26 and all(r.mix.block == r.mix["at"] // 120 for r in rows)


def test_order_and_limits(docs, spark):
    texts = [f"text {i}" for i in range(50)]
    rows = mixed_order(docs(texts, sources=["ab"[i % 2] for i in range(50)]), block_bytes=20).collect()
    assert sorted(r.text for r in rows) == sorted(texts)
    assert mix_sources(docs([])).collect() == []
    with pytest.raises(ValueError, match="more than 3 sources"):
        mix_sources(docs(texts, sources=[str(i % 4) for i in range(50)]), max_sources=3)
    with pytest.raises(ValueError, match="positive"):
        mix_sources(docs(texts), {"s": 0})


def fluid(blocks, weights, slots):
    """What each source has had after ``slots`` slots if all that last are served at once, by weight."""
    had, left = dict.fromkeys(blocks, Fraction(0)), Fraction(slots)
    while left and (lasting := [s for s in blocks if had[s] < blocks[s]]):
        total = sum(weights[s] for s in lasting)
        step = min([left / total] + [(blocks[s] - had[s]) / weights[s] for s in lasting])
        for s in lasting:
            had[s] += step * weights[s]
        left -= step * total
    return had


@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(1, 15), st.floats(1e-3, 1e3)), min_size=1))
@settings(max_examples=100, deadline=None)
def test_deviation_from_the_weights_themselves_is_below_one_block(drawn):
    blocks, weights = {s: b for s, (b, _) in drawn.items()}, whole_weights({s: w for s, (_, w) in drawn.items()})
    had = Counter()
    for t, (s, i) in enumerate(edf(blocks, weights), 1):
        assert i == had[s]
        had[s] += 1
        assert all(abs(had[x] - f) < 1 for x, f in fluid(blocks, weights, t).items())
    assert had == blocks


def test_weights_hold_with_many_sources():
    for n in (1000, 1500, 3000):
        weights = whole_weights({"big": 1 / 3} | {f"s{i}": 2 / 3 / (n - 1) for i in range(n - 1)})
        blocks = {s: 400 if s == "big" else 1 for s in weights}
        big, share = 0, Fraction(weights["big"], sum(weights.values()))
        order = [s for s, _ in edf(blocks, weights)]
        for t, s in enumerate(order[:1000], 1):
            big += s == "big"
            assert abs(big - t * share) < 1
        assert Counter(order) == blocks


def test_more_sources_than_slots_of_a_round(docs):
    texts = ["x" * 10] * 2100 + ["y" * 10] * 300
    rows = mix_sources(docs(texts, sources=[f"s{i}" for i in range(2100)] + ["big"] * 300), {"big": 2100} | {f"s{i}": 2 for i in range(2100)}, block_bytes=10).collect()
    assert len({r.mix.slot for r in rows}) == len(rows) == len(texts)
    own = sorted(r.mix.slot for r in rows if r.source == "big")
    assert all(abs(n - slot / 3) <= 1 for n, slot in enumerate(own))
