"""LM scoring (op1): a probabilistic suffix tree over words, with contexts of up to `depth` words.

Symbols are words (A-Z lower-cased) and one end per text; a text starts after a start mark. The root holds
P(w) = (c + 0.1) / (N + 0.1 (V + 1)). A context s of one word or more is a state of the tree if it passes a divergence
test against its suffix: over the training text, the leave-one-out log-likelihood of what follows s under s's own smoothed
distribution exceeds that under its suffix by more than GAIN. What follows s once only counts against s, what repeats
for it, so the test measures divergence that will be seen again. States are smoothed by absolute discounting, with what
follows once left to the suffix: P(w | s) = (c(sw) - D) / c(s) where c(sw) > 1, plus r(s) / c(s) P(w | suffix), r(s) being
what the first terms leave; it sums to one. A word is scored by the longest suffix of what precedes it that is a state.

All counts cover all training documents. They are kept nowhere as a whole: blocks (see blocks.py) send their distinct
n-grams to shards of the hash space and learn the counts of their own, order by order. An n-gram is asked about only if
its context and its suffix both repeat, as it can't repeat otherwise; the first block that holds it adds it to its
context's test, and the shards decide which contexts are states. So the model is as large as what repeats in the corpus,
and spread over the shards. An n-gram that is in every document travels once per block. Answers are moved once, to their
block's bucket. A block names a context by its rank among what repeats in its shard, which the answer to the context's own
count has told, and adds sums only where it has some. An exchange goes in ROUNDS, each over every ROUNDS-th shard, so that
shuffle files take that much less disk at a time; the last, about contexts only, goes in one.

Words are known by 64-bit hashes, longer n-grams by hashes with SPARE bits more than the corpus has words: one in
2 ** SPARE is taken for another.

Defined cases: a null or empty text is its end alone; a null doc_id is held out; repeated rows count and are scored each;
with no training documents P(w) = 0.1 / 0.1 of an empty vocabulary, 1; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .common import parts, table

ADD, DISCOUNT, GAIN, DEPTH = 0.1, 0.6, 2.0, 3
HELD_OUT, SPARE = 10, 18
ROUNDS = 2  # of an exchange, each over its part of the hash space: shuffle files of one are gone before the next
TOKENS = 2_250_000  # of a block: the larger it is, the fewer n-grams are asked about by several blocks
_ODD = np.uint64(0x9E3779B97F4A7C15)
END, START = np.uint64(0x1234567890ABCDEF), np.uint64(0xFEDCBA0987654321)
_END_KEY, _START_KEY = B.mix64(np.array([END, START]))


@dataclass(frozen=True)
class Corpus:
    """What all blocks know: shards, of which every rounds-th is asked in a round, bits of an n-gram's key, training tokens
    and different ones."""

    shards: int
    bits: int
    n: int = 0
    v: int = 0
    rounds: int = 1
    round: int = 0

    def asked(self, keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
        """(shard, from, to) of ascending keys, for the shards of this round."""
        return [x for x in B.ranges(keys, bits, self.shards) if x[0] % self.rounds == self.round]


def _settle() -> None:
    """Each group's end looks for garbage: what a worker has imported stays, and needn't be looked through each time."""
    if not gc.get_freeze_count():
        gc.freeze()


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT == 0


class Grams:
    """The distinct n-grams of one order that a block asks about. keys: ascending; number: of the n-gram that ends at a
    place, as many as there are keys if none does; found: the counts the block has heard, and 0 of none."""

    def __init__(self, keys: np.ndarray, places: np.ndarray, total: int):
        order, found = B.sorted_order(keys)
        new = np.ones(len(found), bool)
        np.not_equal(found[1:], found[:-1], out=new[1:])
        self.keys = found[new]
        self.number = np.full(total, len(self.keys), np.int32)
        self.number[places[order]] = np.cumsum(new, dtype=np.int32) - 1

    @classmethod
    def of_words(cls, keys: np.ndarray, symbol: np.ndarray) -> Grams:
        """From a key of each symbol, and the symbol at each place."""
        grams = cls.__new__(cls)
        order, grams.keys = B.sorted_order(keys)
        place = np.empty(len(keys), np.int32)
        place[order] = np.arange(len(keys), dtype=np.int32)
        grams.number = place[symbol]
        return grams

    def own(self, train: np.ndarray) -> np.ndarray:
        """Training counts in the block."""
        return np.bincount(self.number[train], minlength=len(self.keys) + 1)[:-1].astype(np.int32)

    def ends(self) -> np.ndarray:
        """A place where each n-gram ends."""
        at = np.empty(len(self.keys) + 1, np.int32)
        at[self.number] = np.arange(len(self.number), dtype=np.int32)
        return at[:-1]


def _pack_mask(mask: np.ndarray) -> bytes:
    return B.pack(np.packbits(mask))


def _unpack_mask(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(B.unpack(packed, np.uint8), count=n).astype(bool)


ASKED = "shard int, kind int, block long, keys binary, own binary, adds binary, kinds binary, mass binary, gain binary"
SAID = "block long, kind int, shard int, tell binary, count binary, flag binary, rank binary, total long, seen long"


def _ask_counts(kind: int, block: int, c: Corpus, bits: int, keys: np.ndarray, own: np.ndarray) -> Iterator[dict]:
    """Requests: ascending keys with the block's own counts."""
    for shard, a, b in c.asked(keys, bits):
        yield {"shard": shard, "kind": kind, "block": block, "keys": B.pack_keys(keys[a:b]), "own": B.pack(own[a:b])}


def _numbered(rows: list[dict]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """How many keys each row has, over all rows the number of each key, and the different keys."""
    keys = [B.unpack_keys(r["keys"]) for r in rows]
    order, found = B.sorted_order(np.concatenate(keys))
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    where = np.empty(len(found), np.int64)
    where[order] = np.cumsum(new) - 1
    return [len(k) for k in keys], where, found[new]


def _counts(rows: list[dict]) -> Iterator[dict]:
    """Answers: counts over 1 of n-grams, of words all that a block can't know by itself; flag: the block is to add this
    n-gram up for all; rank: of the n-gram among the shard's with counts over 1."""
    rows = sorted(rows, key=lambda r: r["block"])
    sizes, where, keys = _numbered(rows)
    n, mine = len(keys), np.concatenate([B.unpack(r["own"], np.int32) for r in rows])
    total = np.bincount(where, mine, n).astype(np.int64)
    holders = np.flatnonzero(mine > 0)
    owner = np.full(n, -1, np.int64)
    owner[where[holders[::-1]]] = holders[::-1]  # the first holder
    words = rows[0]["kind"] == 2
    if words:
        scored = total[keys != _START_KEY]
        yield _said(-1, 2, rows[0]["shard"], total=int(scored.sum()), seen=int((scored > 0).sum()))
    count, rank = total[where], np.maximum(np.cumsum(total > 1) - 1, 0)[where].astype(np.uint64)
    tell = count > 1
    if words:
        tell |= count != mine
    flag = owner[where] == np.arange(len(where))
    a = 0
    for r, size in zip(rows, sizes, strict=True):
        own = slice(a, a + size)
        t = tell[own]
        yield _said(r["block"], r["kind"], r["shard"], _pack_mask(t), B.pack(count[own][t].astype(np.int32)), _pack_mask(flag[own][t]), B.pack_keys(rank[own][t]))
        a += size


def _states(rows: list[dict]) -> Iterator[dict]:
    """Answers: which contexts are states, with the number of repeated words that follow and the times others do."""
    rows = sorted(rows, key=lambda r: r["block"])  # sums of fractions depend on their order
    sizes, where, keys = _numbered(rows)
    n, begin = len(keys), np.cumsum(sizes) - sizes
    added = where[np.concatenate([np.flatnonzero(_unpack_mask(r["adds"], size)) + a for r, size, a in zip(rows, sizes, begin.tolist(), strict=True)])]
    own, kinds, mass, gain = (np.concatenate([B.unpack(r[c], t) for r in rows]) for c, t in (("own", np.int32), ("kinds", np.int32), ("mass", np.int32), ("gain", np.float32)))
    times = np.zeros(n, np.int64)
    times[added] = own  # every block knows the context's count
    kinds, mass, gain = (np.bincount(added, x, n) for x in (kinds, mass, gain))
    once = times - mass
    alone = np.where(once > 0, once * np.log(np.maximum(DISCOUNT * (once + kinds - 1), DISCOUNT / 2) / np.maximum(times - 1, 1)), 0)
    state = ((kinds > 0) & (gain + alone > GAIN))[where]
    kinds, once = kinds[where].astype(np.int32), once[where].astype(np.int32)
    for r, size, a in zip(rows, sizes, begin.tolist(), strict=True):
        own = slice(a, a + size)
        t = state[own]
        yield _said(r["block"], r["kind"], r["shard"], _pack_mask(t), B.pack(kinds[own][t]), B.pack(once[own][t]))


def _said(block: int, kind: int, shard: int, tell: bytes = b"", count: bytes = b"", flag: bytes = b"", rank: bytes = b"", total: int = 0, seen: int = 0) -> dict:
    return {"block": block, "kind": kind, "shard": shard, "tell": tell, "count": count, "flag": flag, "rank": rank, "total": total, "seen": seen}


def _answer(rows: list[dict]) -> Iterator[dict]:
    """Kind 2 n: counts of n-grams; 2 n + 1: contexts of n words."""
    _settle()
    for kind in sorted({r["kind"] for r in rows}):
        own = [r for r in rows if r["kind"] == kind]
        yield from (_states if kind % 2 else _counts)(own)


class Model:
    """A block with what it has heard so far, order by order. Arrays are by place: the start of each text and its symbols."""

    def __init__(self, block: B.Block, said: list[dict], c: Corpus):
        _settle()
        self.block, self.c = block, c
        self.said = defaultdict(list)
        for r in said:
            self.said[r["kind"]].append(r)
        n, lengths = len(block.words), block.sizes + 2
        ends = np.cumsum(lengths)
        firsts, total = ends - lengths, int(ends[-1]) if len(lengths) else 0
        body = np.ones(total, bool)
        body[firsts] = body[ends - 1] = False
        symbol = np.empty(total, np.int32)
        symbol[body], symbol[ends - 1], symbol[firsts] = block.tokens, n, n + 1
        self.total, self.firsts, self.lasts = total, firsts, ends - 1
        self.scored = np.ones(total, bool)
        self.scored[firsts] = False
        self.held = np.array([held_out(d) for d in block.doc_ids], bool)
        self.train = np.repeat(~self.held, lengths)
        keys = B.mix64(np.concatenate([block.words, np.array([END, START])]))
        self.hashed = keys[symbol]
        self.chain = self.hashed  # of the n-gram of this order that ends at a place
        self.order, self.bits = 1, 64
        self.grams = Grams.of_words(keys, symbol)

    def context_bits(self) -> int:
        """Of the keys of contexts."""
        return 64 if self.order == 2 else self.bits

    def hear(self, kind: int, keys: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, dict]]:
        """(places in keys, answer) of each answer of a kind."""
        span = {shard: (a, b) for shard, a, b in B.ranges(keys, bits, self.c.shards)}
        for r in self.said[kind]:
            a, b = span[r["shard"]]
            yield np.flatnonzero(_unpack_mask(r["tell"], b - a)) + a, r

    def heard_counts(self) -> None:
        """Counts of the n-grams of this order: of words all, of others those that repeat, and 0."""
        g = self.grams
        g.found = np.zeros(len(g.keys) + 1, np.int32)
        if self.order == 1:
            g.found[:-1] = g.own(self.train)
        for at, r in self.hear(2 * self.order, g.keys, self.bits):
            g.found[at] = B.unpack(r["count"], np.int32)
        self.count = g.found[g.number]
        if self.order == 1:
            self.p = (self.count + ADD) / (self.c.n + ADD * (self.c.v + 1))  # the root's distribution
            self.root, self.known = self.p.copy(), self.count > 0

    def next_order(self) -> None:
        """The n-grams of the next order that can repeat."""
        self.order += 1
        self.bits = self.c.bits
        if self.order == 2:  # words and pairs are asked about together
            at = np.flatnonzero(self.scored)
        else:
            repeats = self.count > 1
            at = np.flatnonzero(repeats[1:] & repeats[:-1]) + 1
        chain = np.zeros(self.total, np.uint64)
        chain[at] = B.mix64(self.chain[at - 1] * _ODD + self.hashed[at])
        self.chain, self.contexts = chain, self.grams
        self.grams = Grams(chain[at] >> np.uint64(64 - self.bits), at, self.total)

    def asked_contexts(self) -> np.ndarray:
        """Numbers of the contexts that may be states: they repeat, and something follows them."""
        g = self.contexts
        may = g.found > 1
        may[g.number[self.lasts]] = False
        return np.flatnonzero(may[:-1])

    def context_sums(self) -> Iterator[dict]:
        """Requests: contexts by their ranks, and of those that the block adds something to (adds) the count (own), and of
        their repeated n-grams the number, the occurrences and the part of the test; each n-gram is added by one block."""
        g, which = self.contexts, self.asked_contexts()
        rank, flag = np.zeros(len(g.keys), np.uint64), np.zeros(len(self.grams.keys), bool)
        for at, r in self.hear(2 * self.order - 2, g.keys, self.context_bits()):
            rank[at] = B.unpack_keys(r["rank"])
        for at, r in self.hear(2 * self.order, self.grams.keys, self.bits):
            flag[at] = _unpack_mask(r["flag"], len(at))
        some = np.flatnonzero(flag)
        at = self.grams.ends()[some]
        where = g.number[at - 1]
        c, t = self.grams.found[some].astype(float), g.found[where].astype(float)
        gain = c * (np.log((c - 1 - DISCOUNT) / np.maximum(t - 1, 1)) - np.log(self.p[at]))
        kinds, mass, gain = (np.bincount(where, x, len(g.keys))[which] for x in (None, c, gain))
        own, rank, adds = g.found[which], rank[which], kinds > 0
        for shard, a, b in self.c.asked(g.keys[which], self.context_bits()):
            row, t = {"shard": shard, "kind": 2 * self.order - 1, "block": self.block.id, "keys": B.pack_keys(rank[a:b]), "adds": _pack_mask(adds[a:b])}, adds[a:b]
            yield row | {n: B.pack(x[a:b][t].astype(k)) for n, x, k in (("own", own, np.int32), ("kinds", kinds, np.int32), ("mass", mass, np.int32), ("gain", gain, np.float32))}

    def heard_states(self) -> None:
        """P by the states of one word more."""
        g, which = self.contexts, self.asked_contexts()
        rest = np.zeros(len(g.keys) + 1)  # times that a state leaves to its suffix
        for at, r in self.hear(2 * self.order - 1, g.keys[which], self.context_bits()):
            rest[which[at]] = B.unpack(r["flag"], np.int32) + DISCOUNT * B.unpack(r["count"], np.int32)
        context = g.number[:-1]
        at = np.flatnonzero((rest > 0)[context])
        context, at = context[at], at + 1
        self.p[at] = (np.maximum(self.count[at] - DISCOUNT, 0) + rest[context] * self.p[at]) / g.found[context]


def _first(c: Corpus):
    def f(block: B.Block) -> Iterator[dict]:
        m = Model(block, [], c)
        yield from _ask_counts(2, block.id, c, m.bits, m.grams.keys, m.grams.own(m.train))
        m.next_order()
        yield from _ask_counts(4, block.id, c, m.bits, m.grams.keys, m.grams.own(m.train))

    return f


def _heard(block: B.Block, said: list[dict], c: Corpus, order: int) -> Model:
    """All counts up to order, and P by the states of up to order - 2 words."""
    m = Model(block, said, c)
    m.heard_counts()
    m.next_order()
    m.heard_counts()
    while m.order < order:
        m.heard_states()
        m.next_order()
        m.heard_counts()
    return m


def _next(c: Corpus, order: int, depth: int):
    """Puts the contexts of order - 1 words to the test, and asks for the n-grams of order + 1."""

    def f(block: B.Block, said: list[dict]) -> Iterator[dict]:
        m = _heard(block, said, c, order)
        yield from m.context_sums()
        if order <= depth:
            m.next_order()
            yield from _ask_counts(2 * m.order, block.id, c, m.bits, m.grams.keys, m.grams.own(m.train))

    return f


def _score(c: Corpus, depth: int):
    def f(block: B.Block, said: list[dict]) -> Iterator[dict]:
        m = _heard(block, said, c, 1 + depth)
        m.heard_states()
        n_symbols = block.sizes + 1
        doc = np.repeat(np.arange(len(n_symbols)), n_symbols)
        base, score, known = (np.bincount(doc, x[m.scored], len(n_symbols)) for x in (np.log10(m.root), np.log10(m.p), m.known))
        for i, doc_id in enumerate(block.doc_ids):
            yield {"doc_id": doc_id, "held_out": bool(m.held[i]), "n_tokens": int(n_symbols[i]), "n_known": int(known[i]), "train_tokens": c.n, "base_score": float(base[i]), "score": float(score[i])}

    return f


def score_documents(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each of docs (doc_id, text, ...)."""
    held = B.build(docs, TOKENS, by_block=True)
    words = held.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    c = Corpus(ROUNDS * parts(docs.sparkSession), min(64, max(40, int(words).bit_length() + SPARE)))
    told = None

    def step(f: Callable, schema: str) -> DataFrame:
        return B.with_answers(held, told.where("block >= 0"), f, schema)

    for order in range(1, depth + 2):
        rounds = 1 if order > depth else ROUNDS  # the last asks about contexts only
        for own in (replace(c, rounds=rounds, round=i) for i in range(rounds)):
            asked = B.per_block(held, _first(own), ASKED) if order == 1 else step(_next(own, order, depth), ASKED)
            told = B.told(B.per_shard(asked, _answer, SAID), told)
        if order == 1:
            sums = told.where("block = -1").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("seen"), F.lit(0)).alias("v")).first()
            c = replace(c, n=sums.n, v=sums.v)
    return step(_score(c, depth), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
