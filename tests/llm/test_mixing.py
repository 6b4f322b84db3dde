import re
from collections import defaultdict

import pytest

from terrakiln.llm import mixing as M


def targets(sizes, share=1.5, cap=2, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if cap * sizes[s] <= level * weight[s] + 1e-9]
        if not full:
            out |= {s: level * weight[s] for s in free}
            break
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(df, rows):
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += words(t)
    expected, taken = targets(dict(sizes)), defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(expected[r.source])
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - expected[s]) <= 3
    mixed = M.mix_documents(df)
    assert mixed.columns == df.columns
    out = defaultdict(int)
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        out[r.source] += words(r.text)
    assert {s: n for s, n in out.items() if n} == {s: n for s, n in taken.items() if n}


def test_odd_rows(odd, odd_rows):
    check(odd, odd_rows)


def test_hot_source_and_ties(documents):
    rows = [(i % 50, "some words " * (1 + i % 7), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(300)]
    check(documents(rows), rows)


def test_same_again(documents):
    df = documents([(i, "a b c " * (i % 9), "en", f"s{i % 4}") for i in range(100)])
    assert sorted(M.mix(df).collect()) == sorted(M.mix(df.repartition(3)).collect())


def test_weights_prefer_clean_text(documents):
    df = documents([(i, "plain words of text " * 5 if i % 2 else "#$% *** ||| &&& " * 5, "en", "ab"[i % 3 == 0]) for i in range(600)])
    taken = defaultdict(int)
    for r in M.mix(df, share=0.5).collect():
        taken[r.doc_id % 2] += r.taken
    assert taken[1] > 3 * taken[0]


def test_empty_table(empty):
    assert M.mix(empty).count() == 0
    assert M.mix_documents(empty).count() == 0
