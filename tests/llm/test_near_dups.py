import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from terrakiln.llm import near_dups as N


def classes(rows):
    """By brute force: weighted Jaccard of all pairs that share a shingle, and connected components."""
    own, df = [], Counter()
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        s = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
        own.append(s)
        df.update(s.keys())
    n = len(rows)
    weights = [{s: c * (1 + N.IDF * math.log(n / df[s]) / math.log(max(n, 2))) for s, c in x.items()} for x in own]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, x in enumerate(weights):
        for s in x or [None]:
            holders[s].append(i)
    for a, b in {p for h in holders.values() for p in combinations(h, 2)}:
        both = sum(min(w, weights[b].get(s, 0)) for s, w in weights[a].items())
        total = sum(weights[a].values()) + sum(weights[b].values()) - both
        if not total or both / total >= N.THRESHOLD:
            parent[find(b)] = find(a)
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(rows[i][0])
    out = []
    for g in groups.values():
        least = min((d for d in g if d is not None), default=None)
        out += [(d, least) for d in g]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.class_id) for r in df.collect()), key=str)


def edited(words, r, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_against_all_pairs(documents, odd_rows):
    r = random.Random(4)
    rows = list(odd_rows)
    for g in range(12):
        base = [f"w{r.randrange(4000)}" for _ in range(r.choice([30, 120, 400]))]
        for c in range(r.choice([1, 2, 5, 30])):
            rows.append((100 * (g + 1) + c, edited(base, r, r.choice([0, 0, 1, 1, 2, 8])), "en", "s"))
    assert got(N.classes(documents(rows))) == classes(rows)


def test_one_of_each_class_stays(documents):
    rows = [(i, "the same text of some ten words in every row " * 3, "en", "s") for i in range(50)] + [(100 + i, f"another text {i} " + " ".join(f"x{i}y{j}" for j in range(30)), "en", "s") for i in range(20)]
    df = documents(rows)
    kept = N.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(100, 120)]


def test_rows_are_told_apart_by_text_too(documents):
    a, b = "the same text of some ten words in every row " * 3, " ".join(f"only{i}" for i in range(30))
    rows = [(1, a, "en", "s"), (5, a, "en", "s"), (5, b, "en", "s"), (None, a, "en", "s"), (None, b + " here", "en", "s"), (7, b + " here and there", "fr", "s")]
    got = {(r.doc_id, r.text) for r in N.keep_one(documents(rows)).collect()}
    assert got == {(1, a), (5, b)}


def test_rows_repeated_whole_stay_once(documents, odd_rows):
    rows = [(3, f"{i} " + "some words of a text " * 4, "en", "s") for i in range(3)] * 4 + [(9, None, "en", "s"), (10, "", None, None)]
    clashing = documents(rows).withColumnRenamed("key", "digest2").withColumnRenamed("lang", "first")
    kept = N.keep_one(clashing)
    assert kept.columns == clashing.columns
    found = sorted((r.doc_id, r.text) for r in kept.collect())
    assert len(found) == len(set(found)) and [d for d, _ in found if d > 3] == [9]


def test_empty_table(empty):
    assert N.keep_one(empty).count() == 0
    assert N.classes(empty).count() == 0


def test_samples_agree_as_often_as_weights_do():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    a, b = rng.uniform(0.5, 3, len(keys)), rng.uniform(0.5, 3, len(keys))
    hits = total = 0
    for i in range(40):
        shifted = keys + np.uint64(i * 7919)
        order = np.argsort(shifted)
        hits += (N.sample(shifted[order], a[order]) == N.sample(shifted[order], b[order])).sum()
        total += N.BANDS * N.ROWS
    assert hits / total == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_no_link_of_a_large_bucket_is_missed(spark, monkeypatch):
    """One bucket with nodes that one member or two of a large component are near enough to, while all others come close."""
    r = random.Random(8)
    base = r.sample(range(1 << 62), 100)

    def changed(keys, n):
        return sorted(r.sample(keys, len(keys) - n) + [r.randrange(1 << 62) for _ in range(n)])

    many = [changed(base, 4) for _ in range(300)]
    few = [changed(base, 10) for _ in range(40)]  # 0.75 to 0.79 to nearly all; 0.80 to one or two at most
    nodes = [(np.array(k, np.uint64), np.ones(len(k))) for k in many + few]
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(nodes)), 2):
        if N.jaccard(nodes[a], nodes[b]) >= N.THRESHOLD:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    expected = {i: find(i) for i in range(len(nodes))}
    assert 10 < sum(expected[i] == 0 for i in range(300, 340)) < 40
    rows = [(i.to_bytes(16), [7], (N.sample(k, w) & np.uint64(255)).astype(np.uint8).tobytes(), k.tobytes(), N.B.pack(w.astype(np.float32))) for i, (k, w) in enumerate(nodes)]
    features = spark.createDataFrame(rows, N.FEATURES)
    for chunk in (N.CHUNK, 64):
        monkeypatch.setattr(N, "CHUNK", chunk)
        found = {int.from_bytes(x.node): int.from_bytes(x.component) for x in N.grouped(features).collect()}
        assert {i: found.get(i, i) for i in expected} == expected
