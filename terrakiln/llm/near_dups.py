"""MinHash near-dedup (op6): improved consistent weighted sampling over TF-IDF shingles, banded, verified.

A document's shingles are its runs of SHINGLE words (the whole text if shorter), A-Z lower-cased. A shingle weighs its
count in the document times 1 + IDF * ln(N / df) / ln(N): N documents, df of them hold it. IDF is small, so that an edit
in one of a thousand copies, a rare shingle among very common ones, weighs a little more than what it replaced, not
many times more.

1. Blocks send their distinct shingles with document counts to shards, which answer with those of df > 1 (blocks.py).
2. Only shingles of df > 1 can be shared. A document whose share of weight in them is under THRESHOLD has no partner
   (weighted Jaccard similarity is at most that share) and needs no sketch.
3. The others get BANDS * ROWS consistent weighted samples (Ioffe 2010). Documents of one word sequence are one node.
4. In a bucket of a band, all nodes are verified against the least one, by their whole shingle weights; those that pass
   are connected. Each of the others that no other bucket has connected with that head is compared by sketch with all
   nodes of the bucket, in pieces of about CHUNK nodes, and verified against all that the sketches don't rule out (4
   standard deviations under THRESHOLD) and that are of another component, the likest first; a link joins the components
   at once, for the piece, so a pair is passed over only when its nodes are already joined. The features travel with the
   pieces, not with the pairs, and only links come back: at most one less than there are components.
5. Links between nodes make classes (connected components). class_id is the least doc_id of a class.

Defined cases: null and empty texts have no shingle and are one class; repeated rows are of one class; a null doc_id is
ignored in choosing class_id (null where a class has no other); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .common import lean, parts, release, stored, sweep, table
from .components import components

SHINGLE, THRESHOLD, IDF = 5, 0.8, 0.2
BANDS, ROWS = 16, 4
#: For counting documents, shingles keep so many bits more than their number takes: one in 2 ** SPARE is taken for another.
SPARE = 18
#: A bucket's nodes are compared in pieces of about so many nodes and bytes of features.
CHUNK, CHUNK_BYTES = 1024, 8 << 20
_ODD = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) ** 5 % (1 << 64) | 1) for i in range(16)]
_K = BANDS * ROWS
_SEED = [B.mix64(np.arange(1 + j * _K, 1 + (j + 1) * _K, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) for j in range(3)]


def shingles(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each run of `width` words; of the whole text if it is shorter; none if it is empty."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out += B.mix64(words[i : i + len(out)] + np.uint64(i)) * _ODD[i]
    return B.mix64(out)


def weight(df: np.ndarray, n: int) -> np.ndarray:
    return 1 + IDF * np.log(n / df) / math.log(max(n, 2))


def sample(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """_K consistent weighted samples: 64-bit hashes of (shingle, quantised weight)."""
    best, out = np.full(_K, np.inf), np.zeros(_K, np.uint64)
    low, scale = np.uint64(0xFFFFFFFF), 1 / 4294967296.0
    for a in range(0, len(keys), 4096):
        k, lw = keys[a : a + 4096, None], np.log(weights[a : a + 4096, None])
        u = [B.mix64(k ^ s) for s in _SEED]
        r = -np.log(((u[0] >> np.uint64(32)) + 0.5) * scale * (((u[0] & low) + 0.5) * scale))
        lc = np.log(-np.log(((u[1] >> np.uint64(32)) + 0.5) * scale * (((u[1] & low) + 0.5) * scale)))
        beta = ((u[2] >> np.uint64(32)) + 0.5) * scale
        t = np.floor(lw / r + beta)
        la = lc - r * (t - beta + 1)
        at = np.argmin(la, 0)
        column = np.arange(_K)
        better = la[at, column] < best
        chosen = B.mix64(keys[a : a + 4096][at] + t[at, column].astype(np.int64).astype(np.uint64) * _ODD[9])
        out[better] = chosen[better]
        best[better] = la[at, column][better]
    return out


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted keys, weights)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    both = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    total = float(a[1].sum()) + float(b[1].sum()) - both
    return both / total if total else 1.0


def _own_shingles(block: B.Block) -> tuple[list[tuple[bytes, int]], list[np.ndarray]]:
    """(digest, documents) of the block's distinct texts that have words, and the shingles of each."""
    copies: dict[bytes, int] = {}
    first: dict[bytes, tuple[int, int]] = {}
    for digest, span in zip(block.digests, block.spans(), strict=True):
        copies[digest] = copies.get(digest, 0) + 1
        first.setdefault(digest, span)
    hashed = block.words[block.tokens]
    texts = [(d, n) for d, n in copies.items() if first[d][1] > first[d][0]]
    return texts, [shingles(hashed[slice(*first[d])]) for d, _ in texts]


ASKED = "shard int, block long, keys binary, df binary"
SAID = "block long, shard int, at binary, df binary, gone array<binary>"
FEATURES = "digest binary, bands array<long>, sketch binary, keys binary, weights binary"


def _frequencies(texts: list[tuple[bytes, int]], own: list[np.ndarray], drop: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's distinct shingles, without their `drop` lowest bits, and how many of its documents hold each."""
    distinct = [np.unique(s >> np.uint64(drop)) for s in own]
    keys, where = np.unique(np.concatenate(distinct), return_inverse=True)
    return keys, np.bincount(where, np.repeat([n for _, n in texts], list(map(len, distinct)))).astype(np.int32)


def _requests(shards: int, drop: int):
    def f(block: B.Block) -> Iterator[dict]:
        texts, own = _own_shingles(block)
        if texts:
            keys, df = _frequencies(texts, own, drop)
            for shard, a, b in B.ranges(keys, 64 - drop, shards):
                yield {"shard": shard, "block": block.id, "keys": B.pack_keys(keys[a:b]), "df": B.pack(df[a:b])}

    return f


def _document_frequency(rows: list[dict]) -> Iterator[dict]:
    keys = [B.unpack_keys(r["keys"]) for r in rows]
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    df = np.bincount(where, np.concatenate([B.unpack(r["df"], np.int32) for r in rows]))[where].astype(np.int32)
    a = 0
    for r, k in zip(rows, keys, strict=True):
        own = df[a : a + len(k)]
        at = np.flatnonzero(own > 1).astype(np.int32)
        yield {"block": r["block"], "shard": r["shard"], "at": B.pack(at), "df": B.pack(own[at]), "gone": None}
        a += len(k)


def _sketch(shards: int, drop: int, n: int, threshold: float):
    def f(block: B.Block, said: list[dict]) -> Iterator[dict]:
        texts, own = _own_shingles(block)
        if not texts:
            return
        keys, _ = _frequencies(texts, own, drop)
        df = np.ones(len(keys), np.int64)
        start = {shard: a for shard, a, _ in B.ranges(keys, 64 - drop, shards)}
        gone: set[bytes] = set()
        for r in said:
            if r["gone"] is None:
                df[start[r["shard"]] + B.unpack(r["at"], np.int32)] = B.unpack(r["df"], np.int32)
            else:
                gone.update(r["gone"])
        for (digest, _), s in zip(texts, own, strict=True):
            if digest in gone:
                continue
            k, tf = np.unique(s, return_counts=True)
            held = df[np.searchsorted(keys, k >> np.uint64(drop))]
            w = tf * weight(held, n)
            if w[held > 1].sum() >= (threshold - 1e-9) * w.sum():
                drawn = sample(k, w)
                bands = B.mix64((drawn.reshape(BANDS, ROWS) * np.array(_ODD[:ROWS])).sum(1) + np.arange(BANDS, dtype=np.uint64))
                yield {"digest": digest, "bands": bands.view(np.int64).tolist(), "sketch": (drawn & np.uint64(255)).astype(np.uint8).tobytes(), "keys": k.tobytes(), "weights": B.pack(w.astype(np.float32))}

    return f


def _elsewhere(member: DataFrame) -> DataFrame:
    """block, digests that an earlier block holds as well and answers for."""
    pairs = stored(member.select("digest", "block").distinct())
    first = stored(pairs.groupBy(F.col("digest").alias("_d")).agg(F.min("block").alias("first"), F.max("block").alias("last")).where("first < last"))
    later = pairs.join(first, F.col("digest") == F.col("_d")).where("block > first")
    return later.groupBy("block").agg(F.collect_list("digest").alias("gone"))


def _feature(keys: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(keys, np.uint64), B.unpack(weights, np.float32).astype(float)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v, keys, weights, keys2, weights2 -> u, v, similarity."""
    for batch in batches:
        found = []
        for ka, wa, kb, wb in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
            found.append(jaccard(_feature(ka, wa), _feature(kb, wb)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["u", "v", "similarity"])


def verify(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """u, v, similarity of each of pairs (u, v: digests)."""
    one = features.select(F.col("digest").alias("_a"), "keys", "weights")
    two = features.select(F.col("digest").alias("_b"), F.col("keys").alias("keys2"), F.col("weights").alias("weights2"))
    both = pairs.join(one, F.col("u") == F.col("_a")).drop("_a").join(two, F.col("v") == F.col("_b"))
    return both.select("u", "v", "keys", "weights", "keys2", "weights2").mapInArrow(lean(_verified), "u binary, v binary, similarity double")


def _links(threshold: float):
    """u, v: verified links between an odd node and a node of another component, as many as it takes to join all
    components of the group that have one. A pair is passed over only when its nodes are already joined."""
    least = (THRESHOLD - 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / _K)) * _K

    def run(members: pa.Table, odd: pa.Table) -> pa.Table:
        us, vs = [], []
        if members.num_rows and odd.num_rows:
            nodes = members.column("node").to_pylist()
            sketches = np.frombuffer(b"".join(members.column("sketch").to_pylist()), np.uint8).reshape(-1, _K)
            own = [_feature(*f) for f in zip(members.column("keys").to_pylist(), members.column("weights").to_pylist(), strict=True)]
            keys, place = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
            weights = np.concatenate([w for _, w in own])
            starts = np.cumsum([0, *(len(k) for k, _ in own[:-1])])
            totals = np.add.reduceat(weights, starts)
            number: dict[bytes, int] = {}
            component = np.array([number.setdefault(c, len(number)) for c in members.column("component").to_pylist()])
            asked = [number.setdefault(c, len(number)) for c in odd.column("_component").to_pylist()]
            joined = np.arange(len(number))
            held = np.zeros(len(keys))
            for u, sketch, k, w, mine in zip(*(odd.column(c).to_pylist() for c in ("_node", "_sketch", "_keys", "_weights")), asked, strict=True):
                same = (sketches == np.frombuffer(sketch, np.uint8)).sum(1)
                at = np.flatnonzero((same >= least) & (joined[component] != joined[mine]))
                if not len(at):
                    continue
                f = _feature(k, w)
                # all at once, up to rounding; those that pass are verified one by one
                where = np.minimum(np.searchsorted(keys, f[0]), len(keys) - 1)
                shared = keys[where] == f[0]
                held[where[shared]] = f[1][shared]
                both = np.add.reduceat(np.minimum(held[place], weights), starts)[at]
                held[where] = 0
                at = at[both >= (threshold - 1e-6) * (totals[at] + f[1].sum() - both)]
                for i in at[np.lexsort((at, -same[at]))].tolist():
                    a, b = joined[component[i]], joined[mine]
                    if a != b and jaccard(f, own[i]) >= threshold:
                        us.append(max(u, nodes[i]))
                        vs.append(min(u, nodes[i]))
                        joined[joined == a] = b
        return pa.table({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})

    return run


def grouped(features: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, component of the nodes that have a verified link in the buckets."""
    size = (F.length("keys") + F.length("weights")).alias("size")
    rows = stored(features.select(F.explode("bands").alias("bucket"), F.col("digest").alias("node"), size))
    heads = stored(rows.groupBy(F.col("bucket").alias("_bucket")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("node").alias("head")).where("n > 1"))
    joined = stored(rows.join(heads, F.col("bucket") == F.col("_bucket")).drop("_bucket"))
    release(rows, heads)
    judged = stored(verify(joined.where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v")).distinct(), features))
    first = components(judged.where(F.col("similarity") >= threshold).select("u", "v"))

    def named(frame: DataFrame, node: str, name: str) -> DataFrame:
        """frame with the component of its column node (the node itself where it has no link) as name."""
        of = first.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        return frame.join(of, F.col(node) == F.col("_n"), "left").withColumn(name, F.coalesce("_c", node)).drop("_n", "_c")

    under = judged.where(F.col("similarity") < threshold).select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    # the one pair of a bucket of two is judged
    odd = stored(joined.where("n > 2").join(under, (F.col("node") == F.col("_u")) & (F.col("head") == F.col("_v")), "left_semi"))
    # a node that another bucket has connected with this head adds nothing here
    outside = stored(named(odd, "node", "component"))
    release(odd, judged)
    odd = stored(named(outside, "head", "_head").where(F.col("component") != F.col("_head")).drop("head", "_head"))
    release(outside)
    if odd.isEmpty():
        release(odd, joined)
        return first

    def pieces(n: str, size: str):
        return F.ceil(F.greatest(F.col(n) / CHUNK, F.col(size) / CHUNK_BYTES)).cast("int")

    def dealt(frame: DataFrame, own: str, n_own: Column, other: str, n_other: Column) -> DataFrame:
        """frame with features: each row in one piece by its node, for each piece of the other side."""
        held = features.select(F.col("digest").alias("_d"), "sketch", "keys", "weights")
        full = frame.select("bucket", "node", "component", F.pmod(F.xxhash64("node"), n_own).cast("int").alias(own), n_other.alias("_n")).join(held, F.col("node") == F.col("_d"))
        return full.select("bucket", own, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias(other), "node", "sketch", "keys", "weights", "component")

    buckets = stored(odd.groupBy(F.col("bucket").alias("_b")).agg(F.count("*").alias("n_odd"), F.sum("size").alias("odd_bytes")))
    n_chunks, n_parts = pieces("n", "bytes"), pieces("n_odd", "odd_bytes")
    asking = stored(joined.join(buckets, F.col("bucket") == F.col("_b")).drop("_b"))
    release(joined)
    whole = named(asking, "node", "component")
    asked = dealt(odd.join(buckets, F.col("bucket") == F.col("_b")).drop("_b"), "part", n_parts, "chunk", n_chunks)
    asked = asked.toDF(*[f"_{c}" for c in asked.columns])  # of the same lineage as the members: names must differ
    members = dealt(whole, "chunk", n_chunks, "part", n_parts).groupBy("bucket", "chunk", "part")
    more = stored(members.cogroup(asked.groupBy("_bucket", "_chunk", "_part")).applyInArrow(_links(threshold), "u binary, v binary"))
    release(odd, buckets, asking)
    out = components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    release(more)
    return out


def _named(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, digest, name (of its class: a digest) of each row of docs."""
    held = B.build(docs, by_block=True)
    shards = parts(docs.sparkSession)
    member = B.members(held)
    n = member.count()
    words = held.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    drop = 64 - min(64, max(40, int(words).bit_length() + SPARE))
    answers = B.per_shard(B.per_block(held, _requests(shards, drop), ASKED), _document_frequency, SAID)
    gone = _elsewhere(member).select("block", *[F.lit(None).cast(k).alias(c) for c, k in (("shard", "int"), ("at", "binary"), ("df", "binary"))], "gone")
    features = stored(B.with_answers(held, answers.union(gone), _sketch(shards, drop, n, threshold), FEATURES))
    members_ = stored(member)
    release(held)
    sweep(docs.sparkSession)
    linked = grouped(features, threshold)
    release(features)
    # a class is named by the digest that its component has; each document finds it by its own digest
    named = members_.join(linked, F.col("digest") == F.col("node"), "left").select("doc_id", "digest", F.coalesce("component", "digest").alias("name"))
    named = stored(named)
    release(members_, linked)
    return named


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id of each row of docs (doc_id, text, ...)."""
    named = _named(docs, threshold)
    least = stored(named.groupBy(F.col("name").alias("_name")).agg(F.min("doc_id").alias("class_id")))
    return named.join(least, F.col("name") == F.col("_name")).select("doc_id", "class_id")


def _with_digest(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [B.digest((raw or b"").lower().split()) for raw in batch.column(text_at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], [*batch.schema.names, "digest"])

    return run


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class: that of the least doc_id, of its several texts that of the least digest; a row
    without an id only where its class has no other. All columns as they were, whatever their names."""
    named = _named(docs, threshold)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    least = stored(named.groupBy(F.col("name").alias("_name")).agg(first))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    rows = named.join(least, F.col("name") == F.col("_name")).groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    rows = stored(rows.agg(F.max(own).alias("stays"), F.count("*").alias("times")).where("NOT stays OR times > 1"))
    release(named, least)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_at, text_at = names.index("doc_id"), names.index("text")
    full = plain.mapInArrow(lean(_with_digest(text_at)), T.StructType([*plain.schema.fields, T.StructField("digest", T.BinaryType())]))
    same = F.col(f"c{id_at}").cast("long").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    kept = full.join(rows.hint("shuffle_hash"), same, "left_anti").select(*plain.columns)
    again = rows.where("stays")  # rows repeated whole
    if not again.isEmpty():
        one = full.join(again, same).groupBy("_id", "_digest").agg(F.first(F.struct(*plain.columns)).alias("row"))
        kept = kept.unionByName(one.select("row.*"))
    return kept.toDF(*names)


def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
