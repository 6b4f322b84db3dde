"""Line dedup (op3): two Bloom filters find suspected repeats; only those are shuffled, confirmed exactly and resolved.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of at least `min_chars` code
points that at least two documents hold keeps its lines in the smallest doc_id that holds it and loses all others.

1. The distinct keys of each document are laid down in blocks with their 64-bit hashes. Blocks send their distinct hashes,
   packed as differences, to segments of the hash space. Per segment, a hash enters the once-seen filter, and the
   twice-seen filter if the first has it already. Filters are sized by what the segment holds (`BITS` a hash), so their
   error is the same at every size, and they stay in their segments: nothing is broadcast.
2. A segment answers each block with one bit for each of its hashes: whether the twice-seen filter has it. Keys that it
   doesn't have stay in their blocks; the blocks are bucketed, so they aren't moved for the answers either.
3. Suspected keys are grouped by their bytes: the smallest and the largest doc_id, combined before the shuffle, tell
   confirmed repeats and their first holder. Each document's list of keys to drop joins it by doc_id.

Defined cases: a null text counts as one empty line and stays null; a null doc_id stands after all others; rows with
the same doc_id are one document (repeated rows all stay); lines repeated inside one document only stay; an empty table
gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .common import bucketed, give_back, lean, parts, release, stored, table

MIN_CHARS = 10
#: Bits of a segment's filters for each hash that it holds, and bits set by a hash.
BITS, PROBES = 12, 3
#: A block ends after so many keys, or bytes of keys.
BLOCK_KEYS, BLOCK_BYTES = 500_000, 24 << 20
SPACE = b" \t\n\x0b\x0c\r"
LAST = (1 << 63) - 1


def line_keys(raw: bytes) -> list[bytes]:
    return [line.strip(SPACE) for line in raw.lower().split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or (len(key) >= least and len(key.decode(errors="replace")) >= least)


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64(bits - 1)
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [((hashes >> np.uint64(7)) + np.uint64(i) * step) & mask for i in range(PROBES)]


class Twice:
    """Two Bloom filters: what was seen, and what was seen again."""

    def __init__(self, n: int):
        self.bits = 1 << max(10, (BITS * max(n, 1) - 1).bit_length())
        self.once, self.twice = np.zeros(self.bits, bool), np.zeros(self.bits, bool)

    def add(self, distinct: np.ndarray) -> None:
        at = _probes(distinct, self.bits)
        seen = np.logical_and.reduce([self.once[x] for x in at])
        for x in at:
            self.twice[x[seen]] = True
            self.once[x] = True

    def add_twice(self, hashes: np.ndarray) -> None:
        for x in _probes(hashes, self.bits):
            self.twice[x] = True

    def suspected(self, hashes: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([self.twice[x] for x in _probes(hashes, self.bits)])


def _distinct_keys(raw: bytes | None, least: int) -> set[bytes]:
    return {k for k in line_keys(raw or b"") if len(k) >= least and long_enough(k, least)}


BLOCKS = "block long, hashes binary, owners binary, sizes binary, keys binary"


def _blocks(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        keys: list[bytes] = []
        owners: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
            own = np.array(owners, np.int64)
            row = [uid, hashes.tobytes(), B.squeeze(own.tobytes()), np.fromiter(map(len, keys), np.int32, len(keys)).tobytes(), B.squeeze(b"".join(keys))]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int64(), *[pa.binary()] * 4), strict=True)], ["block", "hashes", "owners", "sizes", "keys"])

        for batch in batches:
            for o, raw in zip(batch.column(0).to_pylist(), _binary(batch.column(1)), strict=True):
                own = _distinct_keys(raw, least)
                keys.extend(own)
                owners.extend([o] * len(own))
                size += sum(map(len, own))
                if len(keys) >= BLOCK_KEYS or size >= BLOCK_BYTES:
                    yield flush()
                    uid, keys, owners, size = uid + 1, [], [], 0
        if keys:
            yield flush()

    return run


def _deal(segments: int):
    """block, hashes -> segment, block, seen (distinct hashes), again (which of them the block has in several documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes, counts = np.unique(np.frombuffer(raw, np.uint64), return_counts=True)
                rows += [(segment, block, B.pack_keys(hashes[a:b]), np.packbits(counts[a:b] > 1).tobytes()) for segment, a, b in B.ranges(hashes, 64, segments)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["segment", "block", "seen", "again"])

    return run


def _filter(group: pa.Table) -> pa.Table:
    """A segment's filters, and what they say to each block: segment, block, said (a bit for each of its hashes)."""
    seen = [B.unpack_keys(x.as_py()) for x in group.column("seen")]
    both = Twice(sum(map(len, seen)))
    for hashes, again in zip(seen, group.column("again"), strict=True):
        both.add(hashes)
        both.add_twice(hashes[np.unpackbits(np.frombuffer(again.as_py(), np.uint8), count=len(hashes)).astype(bool)])
    said = [np.packbits(both.suspected(hashes)).tobytes() for hashes in seen]
    return pa.table({"segment": group.column("segment"), "block": group.column("block"), "said": pa.array(said, pa.binary())})


def _suspects(segments: int):
    """The keys of a block that its answers don't rule out, with their owners."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        said = dict(zip(answers.column("segment").to_pylist(), answers.column("said").to_pylist(), strict=True))
        keys, owners = pa.array([], pa.binary()), pa.array([], pa.int64())
        for row in blocks.to_pylist():  # one
            hashes, where = np.unique(np.frombuffer(row["hashes"], np.uint64), return_inverse=True)
            keep = np.concatenate([np.unpackbits(np.frombuffer(said[s], np.uint8), count=b - a) for s, a, b in B.ranges(hashes, 64, segments)]).astype(bool)[where]
            ends = np.cumsum(np.frombuffer(row["sizes"], np.int32), dtype=np.int64)
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            raw = B.unsqueeze(row["keys"])
            every = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
            kept = pa.array(keep, pa.bool_())
            keys = every.filter(kept)
            owners = pa.array(np.frombuffer(B.unsqueeze(row["owners"]), np.int64)).filter(kept)
        give_back()
        return pa.table({"key": keys, "owner": owners})

    return run


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(_digest, batch.column(1).to_pylist())), pa.binary())], ["owner", "digest"])


def _drop(text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, dropped = [], [], []
            for raw, gone in zip(_binary(batch.column(text_at)), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                lines = (raw or b"").split(b"\n")
                counts.append(len(lines))
                if gone:
                    gone = set(gone)
                    kept = [line for line, key in zip(lines, line_keys(raw), strict=True) if _digest(key) not in gone]
                    raw = b"\n".join(kept)
                    dropped.append(len(lines) - len(kept))
                else:
                    dropped.append(0)
                texts.append(raw)
            columns = batch.columns[:-1]
            columns[text_at] = pa.array(texts, pa.binary()).cast(batch.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names)

    return run


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """owner (doc_id, LAST if null), digests (of the keys that the document loses)."""
    segments = parts(docs.sparkSession)
    owner = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    blocks = bucketed(docs.select(owner.alias("owner"), "text").mapInArrow(lean(_blocks(min_chars)), BLOCKS), "block")
    dealt = blocks.select("block", "hashes").mapInArrow(lean(_deal(segments)), "segment int, block long, seen binary, again binary")
    said = dealt.groupBy("segment").applyInArrow(_filter, "segment int, block long, said binary")
    suspects = stored(blocks.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(_suspects(segments), "key binary, owner long"))
    release(blocks)
    # stored, so that both sides of the join are plain exchanges: a key in a third of all documents can then be split
    firsts = stored(suspects.groupBy(F.col("key").alias("_key")).agg(F.min("owner").alias("first"), F.max("owner").alias("last")).where("first < last"))
    losses = stored(suspects.join(firsts, F.col("key") == F.col("_key")).where("owner <> first").select("owner", "key"))
    release(suspects, firsts)
    return losses.mapInArrow(lean(_digests), "owner long, digest binary").groupBy("owner").agg(F.collect_set("digest").alias("digests"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs (doc_id, text, ...) with the lines that stay in text, and n_lines (before), n_dropped."""
    names = docs.columns
    id_at, text_at = names.index("doc_id"), names.index("text")
    losses = repeated_lines(docs, min_chars)
    plain = [f"c{i}" for i in range(len(names))]
    rows = docs.toDF(*plain)
    owner = F.coalesce(F.col(plain[id_at]).cast("long"), F.lit(LAST))
    joined = rows.withColumn("_o", owner).join(losses.hint("shuffle_hash"), F.col("_o") == F.col("owner"), "left").select(*plain, "digests")
    fields = [T.StructField(p, f.dataType, True) for p, f in zip(plain, docs.schema.fields, strict=True)]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(lean(_drop(text_at, schema.names)), schema).toDF(*names, "n_lines", "n_dropped")


def with_length(done: DataFrame) -> DataFrame:
    """dedup_lines' rows without its two counts; n_chars, if there, is the length of a text that lost lines."""
    names = done.columns
    plain = done.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: F.col(f"c{i}") for i, n in reversed(list(enumerate(names)))}
    columns = [F.col(f"c{i}") for i in range(len(names) - 2)]
    if "n_chars" in names[:-2]:
        length = F.when(F.col(f"c{len(names) - 1}") > 0, F.length(at["text"])).otherwise(at["n_chars"])
        columns[names.index("n_chars")] = length.cast("long")
    return plain.select(*columns).toDF(*names[:-2])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE first <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE first IS NULL OR first = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN firsts USING (key) GROUP BY doc_id
"""
