import re

from hypothesis import given, settings
from hypothesis import strategies as st

from cambium.llm.substring_dedup import SuffixAutomaton, leaders, remove_repeats, repeated_starts, units_of


def brute(rows, window=20):
    """Rows under one id that differ in text come in an order of the operator's own, so none are given here."""
    seen, found = set(), {}
    for i, text in sorted({(i, t or "") for i, t in rows if i is not None}):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = set()
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if w in seen:
                gone |= set(range(k, k + window))
            seen.add(w)
        found[i, text] = (i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    out = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        out.append(found[i, text or ""] if i is not None else (None, len(words), 0, " ".join(words)))
    return sorted(out, key=repr)


WORDS = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=25)


@given(st.lists(WORDS, max_size=6), WORDS)
@settings(max_examples=200, deadline=None)
def test_matching_statistics(texts, asked):
    automaton = SuffixAutomaton()
    parts = set()
    for t in texts:
        automaton.add(t)
        parts |= {tuple(t[i:j]) for i in range(len(t)) for j in range(i, len(t) + 1)}
    expected = [max(n for n in range(i + 2) if n == 0 or tuple(asked[i + 1 - n : i + 1]) in parts) for i in range(len(asked))]
    assert automaton.matching(asked) == expected


@given(st.lists(WORDS, max_size=6))
@settings(max_examples=100, deadline=None)
def test_repeated_starts(units):
    seen, expected = set(), []
    for u in units:
        grams = [tuple(u[i : i + 4]) for i in range(len(u) - 3)]
        expected.append([i for i, g in enumerate(grams) if g in seen])
        seen |= set(grams)
    assert repeated_starts(units, 4) == expected


def test_units_cover_every_window_once(prose):
    words = prose(40).encode().split()
    for salts in (1, 2, 7):
        starts = [s + k for _, s, n in units_of(words, 20, salts) for k in range(n)]
        assert sorted(starts) == list(range(21))


def test_leaders_partition_the_windows(prose):
    texts = [prose(n, n).encode() for n in (5, 19, 20, 21, 200)] + [b"", b"a b " * 60]
    found = leaders(texts)
    windows = sorted((int(t), int(lo) + k) for t, lo, n in zip(found["text"], found["lo"], found["windows"], strict=True) for k in range(n))
    assert windows == [(t, i) for t, text in enumerate(texts) for i in range(len(text.split()) - 19)]


def test_equals_brute_force(docs, prose):
    passage, other = prose(70, 1), prose(25, 2)
    texts = [f"{prose(40, 10 + i)} {passage if i % 3 else other} {prose(30, 90 + i)}" for i in range(12)]
    texts += [passage, passage, other.replace(" ", "\t\n "), None, "", " ", "a b " * 50, "a b " * 50 + "c", prose(19, 5), prose(19, 5), prose(3000, 7), prose(3000, 7)]
    texts += [f"x{i} " + " ".join(passage.split()[i : i + 30]) + f" y{i}" for i in range(25)]
    ids = [*range(len(texts))]
    ids[13], ids[3] = ids[12], None
    rows = list(zip(ids, texts, strict=True))
    for limit in (2000, 3):
        got = remove_repeats(docs(texts, ids=ids), shard_fragments=limit)
        assert got.columns == ["doc_id", "n_words", "n_removed", "kept"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_rows_under_one_id(docs, prose):
    a, b = prose(40, 1), prose(50, 2)
    rows = remove_repeats(docs([f"{a} {b}", f"{b} {a}", b], ids=[1, 1, 0])).collect()
    assert sorted(r.n_removed for r in rows) == [0, 50, 90] and remove_repeats(docs([])).collect() == []


def test_windows_of_large_shards_are_units_of_their_own(prose):
    passage = prose(40, 1).split()
    a, b = ([w.encode() for w in [*prose(9, 2 + i).split(), *passage, *prose(9, 5 + i).split()]] for i in range(2))
    keys = [{tuple(x[s : s + 20]): k for k, s, n in units_of(x, 20, 2) if n == 1} for x in (a, b)]
    assert [len(k) for k in keys] == [39, 39] and len({*keys[0].values(), *keys[1].values()}) == 39 + 39 - 21
    assert all(keys[0][w] == keys[1][w] for w in keys[0].keys() & keys[1].keys())


def test_shared_passage_in_other_words(docs, prose, monkeypatch):
    passage = prose(45, 1)
    texts = [f"{prose(25, 10 + i)} {passage} {prose(25, 90 + i)}" for i in range(40)] + [prose(60, 7)] * 2
    rows = list(enumerate(texts))
    for hot in (10_000, 5):
        monkeypatch.setattr("cambium.llm.substring_dedup.HOT_WINDOWS", hot)
        assert sorted(map(tuple, remove_repeats(docs(texts), shard_fragments=4).collect()), key=repr) == brute(rows)
