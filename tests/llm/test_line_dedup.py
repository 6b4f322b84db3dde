import re
from collections import defaultdict

import numpy as np

from terrakiln.llm import line_dedup as L


def brute(rows, least=10):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate(table)
    order = lambda d: L.LAST if d is None else d
    held = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(order(d))
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == order(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in df.collect()), key=str)


def test_odd_rows(odd, odd_rows):
    done = L.dedup_lines(odd)
    assert done.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert got(done) == brute(odd_rows)


def test_several_blocks(documents, odd, odd_rows, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_KEYS", 3)
    assert got(L.dedup_lines(odd)) == brute(odd_rows)
    rows = [(i, f"line number {i % 7} of seven\nline number {i % 11} of eleven\nunique {i} " + "x" * 12, "en", "s") for i in range(90)]
    assert got(L.dedup_lines(documents(rows).repartition(5))) == brute(rows)


def test_empty_table(empty):
    assert L.dedup_lines(empty).count() == 0


def test_length_follows(odd):
    rows = L.with_length(L.dedup_lines(odd)).collect()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_columns_named_as_the_counts(odd):
    clashing = odd.withColumnRenamed("digest", "n_dropped").withColumnRenamed("key", "n_lines")
    done = L.with_length(L.dedup_lines(clashing))
    assert done.columns == clashing.columns
    assert {(r.n_dropped, r.n_lines) for r in done.collect()} == {("d", "k")}


def test_many_copies(documents):
    rows = [(i, f"the very same line of text\nunique line number {i} of all\n{'x' * (i % 20)}", "en", "s") for i in range(400)]
    assert got(L.dedup_lines(documents(rows))) == brute(rows)


def test_filters_know_all_that_repeats():
    rng = np.random.default_rng(1)
    seen = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    both = L.Twice(len(seen) + 500)
    both.add(seen)
    both.add(seen[:500])
    assert both.suspected(seen[:500]).all()
    assert both.suspected(seen[500:]).mean() < 0.05
