import math
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from terrakiln.llm import blocks as B
from terrakiln.llm import suffix_tree as S

D = S.DISCOUNT


class Brute:
    """All n-grams counted in dictionaries."""

    def __init__(self, rows, depth=S.DEPTH):
        self.words = [((t or "").encode().lower().split() + [None]) for _, t, *_ in rows]
        self.held = [zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0 for d, *_ in rows]
        self.grams, self.one, self.depth = Counter(), Counter(), depth
        for w, h in zip(self.words, self.held, strict=True):
            if not h:
                self.one.update(w)
                s = ("start", *w)
                self.grams.update(s[i : i + m] for m in range(1, depth + 2) for i in range(len(s) - m + 1))
        self.n, self.v = sum(self.one.values()), len(self.one)
        follow = defaultdict(list)
        for g, c in self.grams.items():
            if len(g) > 1:
                follow[g[:-1]].append((g[-1], c))
        self.rest = {}  # of states: times left to the suffix
        for s in sorted(follow, key=len):
            self.rest[s] = self.state(s, follow[s])

    def root(self, b):
        return (self.one[b] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def state(self, s, follow):
        times, often = self.grams[s], [(b, c) for b, c in follow if c > 1]
        if times < 2 or not often:
            return 0
        gain = sum(c * (math.log((c - 1 - D) / (times - 1)) - math.log(self.p(s[1:], b))) for b, c in often)
        once = times - sum(c for _, c in often)
        if once:
            gain += once * math.log(max(D * (once + len(often) - 1), D / 2) / (times - 1))
        return once + D * len(often) if gain > S.GAIN else 0

    def p(self, s, b):
        if not s:
            return self.root(b)
        rest, t, c = self.rest.get(s, 0), self.grams[s], self.grams[(*s, b)]
        return ((c - D if c > 1 else 0) + rest * self.p(s[1:], b)) / t if rest else self.p(s[1:], b)

    def rows(self, ids):
        for d, w, h in zip(ids, self.words, self.held, strict=True):
            s = ("start", *w)
            score = sum(math.log10(self.p(s[max(0, j - self.depth) : j], s[j])) for j in range(1, len(s)))
            yield d, h, len(w), sum(self.one[b] > 0 for b in w), self.n, sum(math.log10(self.root(b)) for b in w), score


def key(row):
    return str(row[:4])


def check(df, rows, limit=None, monkeypatch=None):
    got = sorted((tuple(r) for r in S.score_documents(df).collect()), key=key)
    expected = sorted(Brute(rows).rows([d for d, *_ in rows]), key=key)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    for g, e in zip(got, expected, strict=True):
        assert g[5:] == pytest.approx(e[5:], rel=1e-9)
    return got


def test_odd_rows(odd, odd_rows, empty):
    check(odd, odd_rows)
    assert S.score_documents(empty).count() == 0


def test_repeated_passages_are_learned(documents):
    r = random.Random(1)
    passage = " ".join(f"p{r.randrange(300)}" for _ in range(60))
    rows = [(i, " ".join(r.choice("the of and to in a is".split()) for _ in range(40)) + (" " + passage if i % 2 else ""), "en", "s") for i in range(120)]
    got = check(documents(rows).repartition(5), rows)
    held = [g for g in got if g[1] and g[0] % 2]
    assert sum(g[6] for g in held) > 0.8 * sum(g[5] for g in held)


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_depth(documents, depth):
    r = random.Random(3)
    lines = [" ".join(f"w{r.randrange(12)}" for _ in range(9)) for _ in range(6)]
    rows = [(i, " ".join(r.choice(lines) for _ in range(r.randrange(5))), "en", "s") for i in range(60)]
    expected = sorted(Brute(rows, depth).rows([d for d, *_ in rows]), key=key)
    got = sorted((tuple(x) for x in S.score_documents(documents(rows).repartition(3), depth).collect()), key=key)
    assert [g[6] for g in got] == pytest.approx([e[6] for e in expected], rel=1e-9)


def test_longer_contexts_tell_more(documents):
    """Two words are ambiguous here, more are not."""
    r = random.Random(5)
    passages = [" ".join(f"w{r.randrange(8)}" for _ in range(80)) for _ in range(12)]
    rows = [(i, passages[i % 12], "en", "s") for i in range(60)]
    scores = [sum(x.score for x in S.score_documents(documents(rows), d).collect() if x.held_out) for d in (2, S.DEPTH)]
    assert scores[1] > 0.8 * scores[0]


def test_states_sum_to_one():
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("a b c d e".split()) for _ in range(50)) + " x y z" * 4, "en", "s") for i in range(30)]
    b = Brute(rows)
    unseen = 0.1 / (b.n + 0.1 * (b.v + 1))

    def mass(s):
        """Of an unknown word after s."""
        if not s:
            return unseen
        return (b.rest[s] / b.grams[s] if b.rest.get(s) else 1) * mass(s[1:])

    states = [s for s, rest in b.rest.items() if rest]
    assert {len(s) for s in states} >= {1, 3}
    for s in states[::7]:
        assert sum(b.p(s, w) for w in b.one) + mass(s) == pytest.approx(1)


def asked_by_block(rounds, blocks, order):
    """What blocks ask, round by round, in the exchange of an order, after those before it."""
    c = S.Corpus(4 * rounds, 45)
    said = defaultdict(list)
    for o in range(1, order + 1):
        now = []
        for i in range(rounds):
            own = S.replace(c, rounds=rounds, round=i)
            f = S._first(own) if o == 1 else S._next(own, o, S.DEPTH)
            asked = [r for b in blocks for r in (f(b) if o == 1 else f(b, said[b.id]))]
            now.append(asked)
            by_shard = defaultdict(list)
            for r in asked:
                by_shard[r["shard"]].append(r)
            for rows in by_shard.values():
                for r in S._answer(rows):
                    said[r["block"]].append(r)
        if o == 1:
            c = S.replace(c, n=sum(r["total"] for r in said[-1]), v=sum(r["seen"] for r in said[-1]))
    return now


@pytest.fixture(scope="module")
def blocks():
    r = random.Random(7)
    texts = [" ".join(f"w{int(r.paretovariate(0.5)) % 20_000}" for _ in range(200)) for _ in range(400)]
    made = []
    for k in range(4):
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(k * 100, k * 100 + 100)), "text": texts[k * 100 : k * 100 + 100]})
        (row,) = [x for out in B._build(S.TOKENS)(iter([batch])) for x in out.to_pylist()]
        made.append(B.Block(row | {"block": k}))
    return made


def size(rows):
    return sum(len(v) for r in rows for v in r.values() if isinstance(v, bytes))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_rounds_share_an_exchange(blocks, order):
    """Each round asks other shards, and all rounds together ask for as much as one would."""
    (whole,), halves = asked_by_block(1, blocks, order), asked_by_block(2, blocks, order)
    assert not {r["shard"] for r in halves[0]} & {r["shard"] for r in halves[1]}

    def keys(rows):
        return Counter({k: sum(len(B.unpack_keys(r["keys"])) for r in rows if r["kind"] == k) for k in {r["kind"] for r in rows}})

    assert keys(halves[0]) + keys(halves[1]) == keys(whole)
    assert max(map(size, halves)) < 0.65 * size(whole)


def test_contexts_travel_by_rank(blocks):
    """A context takes few bytes: 8 for a word's key and 4 sums of 4 would be 24."""
    (asked,) = asked_by_block(1, blocks, 2)
    rows = [r for r in asked if r["kind"] == 3]
    assert size(rows) < 6 * sum(len(B.unpack_keys(r["keys"])) for r in rows)
