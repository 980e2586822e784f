import zlib
from functools import cache
from itertools import combinations

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cambium.llm import packing
from cambium.llm.packing import Plan, pack, plan_packing, text_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@given(st.text(max_size=40) | st.text(alphabet="abZé'sN 12\n\t\x1c\x85\xa0.,!<|>ǅİΣßﬁ日́", max_size=40))
@settings(max_examples=400, deadline=None)
def test_ids_are_those_of_the_whole_tokenizer(text):
    assert text_ids(text, PATH) == np.array(ids_of(text), "<u4").tobytes()


def test_chunks_are_kept_over_a_change(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_CHUNKS", 5)
    packing._chunks.pop(PATH, None)
    text = " ".join(f"word{i % 13} it's <|endoftext|> É" for i in range(60))
    assert text_ids(text, PATH) == np.array(ids_of(text), "<u4").tobytes()


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    for text in ("", None, " Hello  the world\n\nIt's ÉTÉ", "a b" * 50):
        assert text_ids(text, path) == np.array(other.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
    assert packing._chunks[PATH].fits and not packing._chunks[path].fits


def test_long_chunks_are_not_kept():
    text = "x" * 5000 + " " + "yé" * 3000 + " short"
    assert text_ids(text, PATH) == np.array(ids_of(text), "<u4").tobytes()
    assert max(map(len, packing._chunks[PATH])) <= packing.LONGEST_KEPT and b"short" in packing._chunks[PATH]


def bins_of(plan):
    fill, number = np.zeros(plan.bins, int), {}
    places = []
    for length, first, n, per_bin, first_bin, offset in plan.runs:
        assert first == number.get(length, 0)
        number[length] = first + n
        for i in range(n):
            places.append((first_bin + i // per_bin, offset + i % per_bin * length, length))
    at = dict.fromkeys(range(plan.bins), 0)
    for b, offset, length in sorted(places):
        assert at[b] == offset  # gapless
        at[b] += length
    fill = np.array([at[b] for b in range(plan.bins)])
    assert (fill > 0).all() and (fill <= plan.capacity).all()
    return number


def fewest(lengths, capacity):
    lengths = tuple(sorted(lengths))

    @cache
    def need(left):
        if not left:
            return 0
        j, rest = left[-1], left[:-1]
        best = len(left)
        for k in range(len(rest) + 1):
            for part in set(combinations(rest, k)):
                if j + sum(part) <= capacity:
                    after = list(rest)
                    for x in part:
                        after.remove(x)
                    best = min(best, 1 + need(tuple(after)))
        return best

    return need(lengths)


@given(st.lists(st.integers(1, 20), max_size=9))
@settings(max_examples=150, deadline=None)
def test_reduction_keeps_an_optimum(lengths):
    """The dominating bins that are fixed plus an optimal packing of the rest are as few as an optimal packing of all."""
    counts = {x: lengths.count(x) for x in set(lengths)}
    plan = Plan(counts, 20)
    plan.reduce()
    rest = [int(x) for x in np.repeat(np.arange(21), plan.left)]
    assert plan.fixed_bins + fewest(rest, 20) == fewest(lengths, 20)
    plan.best_fit()
    assert bins_of(plan) == counts


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=30))
@settings(max_examples=100, deadline=None)
def test_best_fit_by_lengths_equals_item_by_item(counts):
    plan = Plan(counts, 64)
    plan.best_fit()
    assert bins_of(plan) == counts
    rooms = []
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 64) - x)
    assert plan.bins == len(rooms)


def test_many_pieces_come_near_the_bound():
    rng = np.random.default_rng(0)
    lengths, n = np.unique(rng.integers(1, 4097, 100_000), return_counts=True)
    plan = plan_packing(dict(zip(lengths.tolist(), n.tolist(), strict=True)))
    assert plan.bins <= 1.01 * (lengths @ n) / 4096 and plan.fixed_bins > 0


def test_pieces_and_sequences(docs, prose):
    texts = [prose(n, n) for n in range(1, 200, 3)] + [None, "", "word " * 30, "word " * 30, prose(3000, 5)]
    ids = [*range(len(texts) - 2), 3, None]
    rows = pack(docs(texts, ids=ids), capacity=256).collect()
    expected = []
    for i, text in zip(ids, texts, strict=True):
        all_ids = [*ids_of(text), 1]
        for k, at in enumerate(range(0, len(all_ids), 256)):
            part = all_ids[at : at + 256]
            expected.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted([tuple(r)[:5] for r in rows], key=repr) == sorted(expected, key=repr)
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 256 and len(at) <= 1.05 * sum(at.values()) / 256 + 1
    assert pack(docs([])).collect() == []
