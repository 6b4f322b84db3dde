"""Quality rules (op9): weak supervision. Rules vote good, bad or abstain; expectation-maximisation weighs them.

Each rule looks at one figure of a text (RULES: a bad and a good range; between them, or where the figure has no
meaning, the rule abstains). A document's votes are one number in base 3. Counting documents per vote pattern (combined
before the shuffle) gives at most 3 ** len(RULES) rows; expectation-maximisation over them estimates how often each
rule votes what on good and on bad documents, with a Dirichlet prior that takes each rule to be right more often than
wrong, and the share of good documents. The posterior of each pattern joins the documents as a table of bounded size.

Texts are read whole, once, where they are; nothing but patterns is shuffled. Defined cases: a null or empty text has no
words and fails the base rule; repeated rows are judged each; an empty table gives an empty result; a corpus of any size
is judged by all its documents. Repeated 8-word windows are found by hashes and confirmed word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, stored, table

SPACE = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACE.encode()
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED, SPAN = 20, 30, 8
FUNCTION_WORDS = frozenset(
    b"the of and to in is that it for with as was on are be this by or from not der die und das ist nicht ein eine zu von mit den auf sich "
    b"le la les de des et est un une que qui dans pour pas sur avec au el los las en y por con para una se del no su lo como".split()
)
CODE = re.compile(r"lorem ipsum|javascript|function\s*\(|</?(?:div|span|script|html)\b|\{[^{}]{0,200};[^{}]{0,200}\}", re.I)
#: Figure, bad if under, good from, good to, bad if over (None: no such bound).
RULES: tuple[tuple[str, float | None, float, float, float | None], ...] = (
    ("n_words", 25, 50, 50_000, 200_000),
    ("mean_word", 2.5, 3, 9, 12),
    ("symbols", None, 0, 0.02, 0.1),
    ("dup_lines", None, 0, 0.1, 0.3),
    ("repeats", None, 0, 0.1, 0.25),
    ("lettered", 0.7, 0.85, 1, None),
    ("ended", 0.1, 0.5, 1, None),
    ("function_words", 0.01, 0.06, 0.7, None),
    ("distinct", 0.1, 0.25, 1, None),
    ("code", None, 0, 0, 0.5),
)
PATTERNS = 3 ** len(RULES)
ROUNDS, KEEP = 200, 0.5
#: The prior's rates of bad votes, among votes on bad and on good documents.
BAD_CAUGHT, GOOD_BLAMED = 0.35, 0.03
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ** 3) % (1 << 64) | 1 for i in range(SPAN)], np.uint64)


def repeated_words(words: list[bytes], span: int = SPAN) -> int:
    """Words inside windows of `span` words that occur at two or more places of the text."""
    n = len(words) - span + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    at = np.zeros(n, np.uint64)
    for i in range(span):
        at += h[i : i + n] * _ODD[i]
    order = np.argsort(at, kind="stable")
    same = at[order][1:] == at[order][:-1]
    if not same.any():
        return 0
    likely = np.zeros(n, bool)
    likely[order[1:][same]] = likely[order[:-1][same]] = True
    places: dict[tuple[bytes, ...], list[int]] = {}
    for i in np.flatnonzero(likely).tolist():
        places.setdefault(tuple(words[i : i + span]), []).append(i)
    covered = np.zeros(len(words) + 1, np.int64)
    for own in places.values():
        if len(own) > 1:
            for i in own:
                covered[i] += 1
                covered[i + span] -= 1
    return int((np.cumsum(covered) > 0).sum())


def base_counts(text: str, raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    seen: set[str] = set()
    lines = again = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            lines += 1
            if line in seen:
                again += 1
            else:
                seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), again, repeated_words(words), lines


def vote(value: float | None, rule: tuple) -> int:
    """0 bad, 1 abstains, 2 good."""
    _, low, a, b, high = rule
    if value is None:
        return 1
    if (low is not None and value < low) or (high is not None and value > high):
        return 0
    return 2 if a <= value <= b else 1


def figures(text: str, raw: bytes, words: list[bytes], base: tuple[int, ...]) -> dict[str, float | None]:
    n, chars, symbols, again, repeats, lines = base
    if not n:
        return {name: (0 if name == "n_words" else None) for name, *_ in RULES}
    low = raw.lower().split()
    lettered = sum(map(bytes.isalpha, re.sub(rb"[^a-z\x80-\xff \n]", b"", b" ".join(low)).replace(b"\xc2\xa0", b"").translate(_LETTERS).split()))
    ended = sum(1 for x in text.split("\n") if x.rstrip(SPACE)[-1:] in ".!?:;\"'”»)…" and x.strip(SPACE))
    return {
        "n_words": n, "mean_word": chars / n, "symbols": symbols / n, "dup_lines": again / lines if lines > 1 else None, "repeats": repeats / n,
        "lettered": lettered / n, "ended": ended / lines, "function_words": sum(map(FUNCTION_WORDS.__contains__, low)) / n if n >= 30 else None,
        "distinct": len(set(low)) / min(n, 1000) if n >= 50 else None, "code": float(bool(CODE.search(text))),
    }


#: Bytes of letters and of all characters beyond ASCII as "a".
_LETTERS = bytes(ord("a") if b >= 0x80 else b for b in range(256))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for raw in batch.column(1).cast(pa.binary()).to_pylist():
            raw = raw or b""
            text, words = raw.decode(errors="replace"), raw.split()
            base = base_counts(text, raw, words)
            found = figures(text, raw, words, base)
            pattern = 0
            for rule in RULES:
                pattern = pattern * 3 + vote(found[rule[0]], rule)
            rows.append((*base[:5], pattern))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "pattern"])


def expectation_maximisation(patterns: dict[int, int], rounds: int = ROUNDS) -> dict[int, float]:
    """The posterior that a document is good, by vote pattern. patterns: documents by pattern."""
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    votes = np.array([[k // 3**j % 3 for j in reversed(range(len(RULES)))] for k in keys])
    one = np.eye(3)[votes]  # pattern, rule, vote
    total = n.sum()
    # pseudo-documents: bad votes are rarely wrong, but a bad document seldom breaks many rules; rules abstain as they do
    strength = 0.2 * total + 10
    abstains = np.einsum("p,pjv->jv", n, one)[:, 1] / max(total, 1)
    prior = np.stack([np.stack([BAD_CAUGHT * (1 - abstains), abstains, (1 - BAD_CAUGHT) * (1 - abstains)], 1), np.stack([GOOD_BLAMED * (1 - abstains), abstains, (1 - GOOD_BLAMED) * (1 - abstains)], 1)])
    good = 1 / (1 + np.exp(-((votes == 2).sum(1) - 2.0 * (votes == 0).sum(1))))
    for _ in range(rounds):
        weight = np.stack([n * (1 - good), n * good])  # class, pattern
        seen = np.einsum("cp,pjv->cjv", weight, one) + strength * prior + 1e-3
        rates = np.log(seen / seen.sum(2, keepdims=True))
        share = (weight.sum(1) + strength * np.array([0.2, 0.8])) / (total + strength)
        said = np.einsum("cjv,pjv->cp", rates, one) + np.log(share)[:, None]
        now = 1 / (1 + np.exp(np.clip(said[0] - said[1], -500, 500)))
        done = np.abs(now - good).max() < 1e-9
        good = now
        if done:
            break
    return dict(zip(keys, good.tolist(), strict=True))


def judge(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """A row for each of docs (doc_id, text, ...): base counts, base_failed, quality (posterior), kept."""
    spark = docs.sparkSession
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, pattern long"
    found = stored(docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(lean(_batches), schema))
    # documents that fail the base rule are decided and would teach the rules nothing
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    counted = found.groupBy("pattern").agg(F.count_if(~failed).alias("taught")).collect()  # at most PATTERNS rows
    posterior = expectation_maximisation({r.pattern: r.taught for r in counted}) if counted else {}
    by = spark.createDataFrame(sorted(posterior.items()) or [(-1, 0.0)], "_pattern long, quality double")
    out = found.join(F.broadcast(by), F.col("pattern") == F.col("_pattern")).drop("_pattern", "pattern")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
