import string
from collections import defaultdict

from cambium.llm.line_dedup import line_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(holders[key(x)]) < min_docs or doc_id == max(holders[key(x)])]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_equals_brute_force(docs):
    shared, other = "A shared line of more than forty characters, É", "another shared line, which is long enough too"
    texts = [f"own {i}\n {shared} \t\n{other if i % 2 else 'short'}\n{shared.upper().replace('É', 'É')}\n" for i in range(9)]
    texts += [None, "", "\n\n", shared, shared, f"{other}\r\n{other}", "x" * 39, "long " * 50_000 + "\n" + shared]
    ids = [*range(9), 20, 21, 22, 23, 23, 24, None, 25]
    df = line_dedup(docs(texts, ids=ids))
    got = sorted([(r.doc_id, r.lines.n_lines, r.lines.n_dropped, r.lines.kept) for r in df.collect()], key=repr)
    assert got == brute(list(zip(ids, texts, strict=True)))
    assert df.columns[:-1] == docs([]).columns and sum(r[2] for r in got) > 20


def test_empty_table(docs):
    assert line_dedup(docs([])).collect() == []
