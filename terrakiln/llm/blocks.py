"""Tokenized blocks: the corpus as packed arrays, and exchanges of packed keys between blocks and shards.

A block holds up to TOKENS words of the documents that one task read: each word as a number in the block, and the block's
distinct words as 64-bit hashes. Later passes read blocks instead of texts. To learn something of the whole corpus (how
often a word or shingle occurs), blocks send their distinct keys to shards of the hash space; a shard adds up and
answers each block for its own keys only. A block never holds more than its own keys, a shard no more than its share,
and a key that a third of all documents hold travels once per block.
"""

from __future__ import annotations

import itertools
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, give_back, lean, parts, stored, sweep

TOKENS = 1_500_000
SCHEMA = "block long, n_words long, doc_ids array<long>, digests array<binary>, sizes binary, tokens binary, words binary"


def digest(words: list[bytes]) -> bytes:
    """Of a text's words, A-Z lower-cased."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def _build(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

        def fresh():
            return defaultdict(itertools.count().__next__), array("i"), [], [], array("i")

        known, tokens, ids, digests, sizes = fresh()

        def flush() -> pa.RecordBatch:
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
            values = [[uid], [len(tokens)], [ids], [digests], [sizes.tobytes()], [pack(np.frombuffer(tokens, np.int32))], [words.tobytes()]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["block", "n_words", "doc_ids", "digests", "sizes", "tokens", "words"])

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = (raw or b"").lower().split()
                tokens.extend(map(known.__getitem__, words))
                ids.append(doc_id)
                digests.append(digest(words))
                sizes.append(len(words))
                if len(tokens) >= limit:
                    yield flush()
                    uid += 1
                    known, tokens, ids, digests, sizes = fresh()
        if ids:
            yield flush()

    return run


def build(docs: DataFrame, limit: int = TOKENS, by_block: bool = False) -> DataFrame:
    """The blocks of docs (doc_id, text, ...), A-Z lower-cased, as a table in the shared folder; by_block: bucketed by
    block, so that later passes bring answers to blocks without moving the blocks."""
    made = docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(lean(_build(limit)), SCHEMA)
    return bucketed(made, "block") if by_block else stored(made)


_squeeze = zstandard.ZstdCompressor(level=1)


def squeeze(raw: bytes) -> bytes:
    return _squeeze.compress(raw)


def unsqueeze(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers of at least 0 by byte planes, as many as the largest takes, squeezed: planes of small numbers vanish."""
    raw = np.ascontiguousarray(values)
    size = raw.itemsize
    if size > 1 and raw.dtype.kind in "iu" and len(raw):
        size = next(k for k in (1, 2, 4, 8) if int(raw.max()) < 1 << 8 * k)
        raw = raw.astype(f"u{size}")
    planes = raw.view(np.uint8).reshape(len(raw), size)
    return bytes([size]) + _squeeze.compress(b"".join([np.ascontiguousarray(planes[:, i]) for i in range(size)]))


def unpack(packed: bytes, kind: type) -> np.ndarray:
    size, raw = packed[0], zstandard.ZstdDecompressor().decompress(packed[1:])
    planes = np.frombuffer(raw, np.uint8).reshape(size, -1)
    out = np.empty((planes.shape[1], size), np.uint8)
    for i in range(size):
        out[:, i] = planes[i]
    own = np.dtype(kind)
    return out.view(own if size == own.itemsize else f"u{size}").ravel().astype(own, copy=False)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending distinct 64-bit keys, as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, np.uint64), dtype=np.uint64)


def sorted_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts 64-bit keys, and the sorted keys: numbers sort many times faster than their order, so the places
    are sorted along with the keys' high bits, and the few keys that those don't tell apart are put right."""
    if len(keys) < 2:
        return np.arange(len(keys)), keys
    low = np.uint64(len(keys).bit_length())
    lead = np.uint64(64 - int(keys.max()).bit_length())
    mask = np.uint64((1 << int(low)) - 1)
    led = (keys << lead) & ~mask | np.arange(len(keys), dtype=np.uint64)
    led.sort()
    led &= mask
    order = led.view(np.int64)
    found = keys[order]
    for i in np.flatnonzero(found[1:] < found[:-1]).tolist():
        a = b = i
        own = found[i] << lead & ~mask
        while a > 0 and found[a - 1] << lead & ~mask == own:
            a -= 1
        while b < len(found) and found[b] << lead & ~mask == own:
            b += 1
        order[a:b] = order[a:b][np.argsort(keys[order[a:b]], kind="stable")]
        found[a:b] = keys[order[a:b]]
    return order, found


def ranges(keys: np.ndarray, bits: int, shards: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of ascending distinct keys of so many bits: shards are ranges of the key space."""
    if not len(keys):
        return []
    high = keys >> np.uint64(bits - 32) if bits > 32 else keys << np.uint64(32 - bits)
    shard = high * np.uint64(shards) >> np.uint64(32)
    start = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    return list(zip(shard[start].tolist(), start.tolist(), [*start[1:].tolist(), len(keys)], strict=True))


class Block:
    """One row of the block table, unpacked."""

    def __init__(self, row: dict):
        self.id = row["block"]
        self.doc_ids, self.digests = row["doc_ids"], row["digests"]
        self.sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
        self.tokens = unpack(row["tokens"], np.int32)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.ends = np.cumsum(self.sizes)

    def spans(self) -> list[tuple[int, int]]:
        return list(zip((self.ends - self.sizes).tolist(), self.ends.tolist(), strict=True))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def per_block(frame: DataFrame, f, schema: str) -> DataFrame:
    """f(Block) -> rows (dicts), for each block."""

    kind = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = list(f(Block(row)))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    return frame.mapInArrow(lean(run), schema)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}


def _arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (x.strip().split(" ") for x in schema.split(","))])


def per_shard(frame: DataFrame, f, schema: str) -> DataFrame:
    """f(rows of one shard) -> rows, for each shard of what deal() made."""
    kind = _arrow_schema(schema)

    def run(group: pa.Table) -> pa.Table:
        try:
            return pa.Table.from_pylist(list(f(group.to_pylist())), kind)
        finally:
            give_back()

    return frame.groupBy("shard").applyInArrow(run, schema)


def with_answers(frame: DataFrame, answers: DataFrame, f, schema: str) -> DataFrame:
    """f(Block, its answers' rows) -> rows, for each block."""
    kind = _arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            said = right.to_pylist()
            return pa.Table.from_pylist([r for row in left.to_pylist() for r in f(Block(row), said)], kind)
        finally:
            give_back()

    return frame.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def told(answers: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Answers, with those of before, as a table bucketed by block: they are moved once, however often blocks read them."""
    spark = answers.sparkSession
    own = answers.repartition(parts(spark), "block")
    del answers
    if before is None:
        first = bucketed(own, "block")
        del own
        sweep(spark)
        return first
    path, name = before._held
    own.write.bucketBy(parts(spark), "block").option("path", path).format("parquet").mode("append").saveAsTable(name)
    spark.catalog.refreshTable(name)
    del own
    sweep(spark)  # what was asked and answered is written: its shuffle files can go
    out = spark.table(name)
    out._held = before._held
    return out


def members(frame: DataFrame) -> DataFrame:
    """doc_id, digest (of its words), block of each document."""
    both = F.explode(F.arrays_zip("doc_ids", "digests")).alias("x")
    return frame.select("block", both).select(F.col("x.doc_ids").alias("doc_id"), F.col("x.digests").alias("digest"), "block")
