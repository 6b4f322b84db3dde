"""Packing (op5): cutting-stock column generation over the histogram of piece lengths.

A document's ids (byte-level BPE, then END_ID) are cut into full pieces of `size` and one rest. Lengths are counted in
classes of `grain` tokens, rounded up. A linear program over the class histogram asks for the fewest sequences: its
columns are patterns (how many pieces of each class go into one sequence), priced by an unbounded knapsack program over
the duals, until no pattern improves it. The pattern counts are rounded down; what they leave over, a few pieces for
each basic column, fills further sequences, the longest piece first with those that fill the rest best, by exact length. The histogram has at most `size` rows, so
the program's cost does not grow with the corpus.

Pieces are ranked within their length: counts per (length, salt) give each salt its first rank, so that a length with a
third of all rows (copies) is dealt over all salts. The rank finds the pattern, its instance and the slot in a table of
bounded size, and a window over each sequence (at most `size` / `grain` pieces) gives the offsets.

Ids are those of the tokenizers library for the same file: texts of common characters are split by the file's own
pre-tokenization pattern and each part is encoded once per worker (tiktoken ranks of the same vocabulary); texts with
other characters are encoded by tokenizers itself. Strings of special tokens are ordinary text.

Defined cases: a null or empty text is END_ID alone; repeated rows are packed each; a null doc_id stays null; an empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, parts, stored, table

SIZE, GRAIN, END_ID = 2048, 8, 1
#: Encoded parts that a worker remembers.
REMEMBER = 300_000
#: Characters whose kinds all versions of Unicode agree on: white space, letters, numbers, others. With these, PARTS
#: splits as the tokenizer's own pattern does.
_SPACE, _LETTER, _NUMBER = "\t\n\r \xa0", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u045f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_RARE = re.compile("[^\t\n\r -~\xa0-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u045f\u2010-\u2027\u20ac]")
PARTS = re.compile(f" ?[{_LETTER}]+|'(?:[sdmt]|ll|ve|re)| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_encoders: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """Texts to ids, as unsigned 32-bit little-endian bytes."""

    def __init__(self, path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken

        self.path, self.exact = path, None
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if _RARE.search(text):
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.path)
                self.exact.encode_special_tokens = True
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = PARTS.findall(text)
        try:
            return b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            if len(self.known) > REMEMBER:  # parts that are in use come back from the older half
                self.known, self.older = {}, self.known
            known, older, encode = self.known, self.older, self.plain._encode_single_piece
            for p in {*parts}.difference(known):
                known[p] = older.get(p) or array("I", encode(p)).tobytes()
            return b"".join(map(known.__getitem__, parts))


    def forget(self) -> None:
        """The parts kept: the worker may next do something else."""
        self.known, self.older, self.exact = {}, {}, None


def encoder(path: str, ranks_path: str) -> Encoder:
    if (path, ranks_path) not in _encoders:
        _encoders[path, ranks_path] = Encoder(path, ranks_path)
    return _encoders[path, ranks_path]


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _cut(paths: tuple[str, str] | None, size: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(*(paths or tokenizer_paths()))
        encode = own.encode
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (encode(text) if text else b"") + end
                n = len(ids) // 4
                for a in range(0, n, size):
                    piece = ids[4 * a : 4 * (a + size)]
                    rows.append((doc_id, a, len(piece) // 4, zlib.crc32(piece), n, piece))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + ([pa.array(columns[5], pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])
        own.forget()

    return run


def price(duals: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: classes 1.. take as many units each; the best value within room and its counts."""
    best, took = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        options = best[c - 1 :: -1][: len(duals)] + duals[:c]
        k = int(np.argmax(options))
        if options[k] > best[c - 1] + 1e-12:
            best[c], took[c] = options[k], k + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(duals), np.int64), room
    while c > 0:
        if took[c]:
            counts[took[c] - 1] += 1
        c -= max(1, took[c])
    return float(best[room]), counts


def column_generation(demand: np.ndarray, room: int, most: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses each. demand: pieces of class 1, 2, .. room."""
    live = np.flatnonzero(demand)
    if not len(live):
        return []
    units, b = live + 1, demand[live].astype(float)
    n = len(live)
    columns = [np.eye(n)[i] * (room // units[i]) for i in range(n)]
    cost = np.ones(n)
    inverse = np.diag([1 / (room // u) for u in units])
    x = inverse @ b
    for _ in range(most):
        duals = cost @ inverse
        lowest = int(np.argmin(duals))
        if duals[lowest] < -1e-9:  # more of a class than asked for
            entering, entering_cost = -np.eye(n)[lowest], 0.0
        else:
            full = np.zeros(room)
            full[live] = np.maximum(duals, 0)
            value, counts = price(full, room)
            if value <= 1 + 1e-7:
                break
            entering, entering_cost = counts[live].astype(float), 1.0
        step = inverse @ entering
        ok = step > 1e-9
        if not ok.any():
            break
        ratios = np.full(n, np.inf)
        ratios[ok] = x[ok] / step[ok]
        out = int(np.argmin(ratios))
        row = inverse[out] / step[out]
        by = x[out] / step[out]
        x -= step * by
        inverse -= np.outer(step, row)
        x[out], inverse[out] = by, row
        columns[out], cost[out] = entering, entering_cost
    found = []
    for column, c, often in zip(columns, cost, x, strict=True):
        if c > 0 and often > 1e-9:
            counts = np.zeros(room, np.int64)
            counts[live] = column.round().astype(np.int64)
            found.append((counts, float(often)))
    return found


def fullest(left: dict[int, int], size: int) -> list[int]:
    """Of pieces by length: the longest, with those that fill the rest of a sequence best (a knapsack over bit sets)."""
    longest = max(left)
    reached = 1 << longest
    steps = [(reached, 0)]
    mask = (1 << size + 1) - 1
    for length in sorted(left, reverse=True):
        for _ in range(min(left[length] - (length == longest), (size - longest) // length)):
            more = (reached | reached << length) & mask
            if more == reached:
                break
            reached = more
            steps.append((reached, length))
            if reached >> size:
                break
        if reached >> size:
            break
    at, out = reached.bit_length() - 1, [longest]
    for (_, length), (before, _) in zip(steps[:0:-1], steps[-2::-1], strict=True):
        if not before >> at & 1:
            out.append(length)
            at -= length
    return out


def plan_slots(histogram: dict[int, int], size: int = SIZE, grain: int = GRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces go. histogram: pieces by exact length. Returns

    first (by length: the class rank of its first piece; classes rank longer pieces first) and
    slots (class, first class rank, pieces of it in a sequence, first sequence), ordered."""
    room = size // grain
    demand, first = np.zeros(room, np.int64), np.zeros(size + 1, np.int64)
    for length in sorted(histogram, reverse=True):
        k = -(-length // grain) - 1
        first[length] = demand[k]
        demand[k] += histogram[length]
    left, slots, sequence = demand.copy(), [], 0
    patterns = sorted(column_generation(demand, room), key=lambda p: (-p[1], p[0].tolist()))
    # rounded down; then once more where enough pieces are left, those that lost most first
    rounds = [(c, int(often + 1e-6)) for c, often in patterns] + [(c, 1) for c, often in sorted(patterns, key=lambda p: (-(p[1] % 1), p[0].tolist()))]
    for counts, often in rounds:
        at = np.flatnonzero(counts)
        times = min(often, *(int(left[k] // counts[k]) for k in at))
        if times <= 0:
            continue
        for k in at:
            slots.append((k + 1, demand[k] - left[k], counts[k], sequence))
            left[k] -= counts[k] * times
        sequence += times
    exact: dict[int, int] = {}  # what the rounded patterns leave: the last ranks of each class
    ranks: dict[int, int] = {}
    for length, n in histogram.items():
        k = -(-length // grain) - 1
        begin = max(int(first[length]), int(demand[k] - left[k]))
        if (over := int(first[length]) + n - begin) > 0:
            exact[length], ranks[length] = over, begin
    while exact:
        for length in fullest(exact, size):
            slots.append((-(-length // grain), ranks[length], 1, sequence))
            ranks[length] += 1
            exact[length] -= 1
            if not exact[length]:
                del exact[length]
        sequence += 1
    return first, np.array(sorted(slots), np.int64).reshape(-1, 4)


def _place(sent, grain: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, slots = sent.value
        keys = (slots[:, 0] << 48) + slots[:, 1]
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy()
            k = -(-length // grain)
            own = first[length] + rank
            at = np.searchsorted(keys, (k << 48) + own, "right") - 1
            past, each = own - slots[at, 1], slots[at, 2]
            sequence, slot = slots[at, 3] + past // each, past % each
            arrays = [*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array((slots.shape[0] - at) * 4096 + slot, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "_slot"])

    return run


def pack_documents(docs: DataFrame, *, size: int = SIZE, grain: int = GRAIN, end_id: int = END_ID, paths: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece of docs (doc_id, text, ...): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    with_ids the piece's ids (unsigned 32-bit). paths: the tokenizer's file and its ranks, on every executor."""
    spark = docs.sparkSession
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    pieces = stored(docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(lean(_cut(paths, size, end_id, with_ids)), schema))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts(spark))))
    counts = stored(salted.groupBy("length", "_salt").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    sent = spark.sparkContext.broadcast(plan_slots(histogram, size, grain))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_begin"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.join(begins, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).select(
        *names, (F.col("_begin") + F.row_number().over(own) - 1).alias("_rank")
    )
    placed = ranked.mapInArrow(lean(_place(sent, grain, names)), f"{schema}, sequence_id long, _slot long")
    inside = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*names, "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
