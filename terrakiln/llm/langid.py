"""Language ID (op7): the language whose dictionary makes zstandard encode a text shortest.

Fit, on a bounded sample: of each label, about SAMPLE documents chosen by a hash of their id, PIECE code points from a
hashed place of each, joined in the order of the hash to a raw-content dictionary of at most DICT_BYTES, or less where
all labels' dictionaries would take more than ALL_BYTES. Every label is learned. Only sampled rows are shuffled.

Prediction reads every text whole: in blocks of BLOCK code points, so that the dictionary weighs as much at the end of
a long text as at its start, each block is encoded with each dictionary; the sums of the sizes are compared. score is
1 - best / second, 0 where there is only one label to choose. A document is rejected where score is under MARGIN, or where
there is nothing to tell (no text, no letter). With fewer than two labels there is no margin to judge: only documents
without letters are rejected then.

Defined cases: null text, empty text or no letter: `und`, score 0, rejected; null lang is not learned from; without any
labelled document all are `und`, and those with letters are kept; repeated rows are predicted each; an empty table gives an empty result; ties go to the
smaller label; other columns pass through `keep_identified`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, small, stored, table

SAMPLE, PIECE, DICT_BYTES, ALL_BYTES = 512, 1024, 512 << 10, 64 << 20
BLOCK, LEVEL, MARGIN = 4096, 3, 0.005
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod `modulus`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def learn(docs: DataFrame, sample: int = SAMPLE, all_bytes: int = ALL_BYTES) -> dict[str, bytes]:
    """A dictionary per label, from docs (doc_id, text, lang)."""
    usable = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = stored(usable.groupBy("lang").agg(F.count("*").alias("n")))
    n_labels = counts.count()
    size = min(DICT_BYTES, all_bytes // max(n_labels, 1))
    sample = min(sample, -(-4 * size // PIECE))  # pieces that the dictionary can't hold are not drawn
    drawn = F.abs(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("langid")))
    at = F.pmod(F.shiftright(drawn, 7), F.greatest(F.length("text") - PIECE, F.lit(1))).cast("int") + 1
    rows = usable.select(F.col("lang").alias("label"), drawn.alias("drawn"), F.substr(F.col("text"), at, F.lit(PIECE)).alias("piece"))
    near = rows.join(small(counts, 4096), F.col("label") == F.col("lang")).where(F.col("drawn") / F.lit(float(1 << 63)) * F.col("n") <= 2 * sample)
    order = Window.partitionBy("label").orderBy("drawn", "piece")
    chosen = near.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= sample).select("label", "rn", "piece").collect()
    pieces: dict[str, dict[str, None]] = {}
    for r in sorted(chosen, key=lambda r: (r.label, r.rn)):
        pieces.setdefault(r.label, {})[letters(r.piece)] = None
    # zstandard finds what lies near the end of a dictionary most cheaply: the order is that of the hash, not of the letters
    return {label: "\n".join(own).encode()[:size] for label, own in sorted(pieces.items())}


def letters(text: str) -> str:
    """The text's words of letters, lower-cased: signs and digits tell no language."""
    return " ".join(_LETTERS.findall(text.lower()))


class Identifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.labels = sorted(dictionaries)
        self.encoders = []
        for label in self.labels:
            held = zstandard.ZstdCompressionDict(dictionaries[label], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.encoders.append(zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.least = [len(e.compress(b"")) - 1 for e in self.encoders]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Label, score, and whether the text is rejected."""
        text = letters(text or "")
        if not text or not self.labels:
            return UNKNOWN, 0.0, not text
        if len(self.labels) == 1:
            return self.labels[0], 0.0, False
        blocks = [text[a : a + BLOCK].encode() for a in range(0, len(text), BLOCK)]
        sizes = [sum(len(e.compress(b)) - low for b in blocks) for e, low in zip(self.encoders, self.least, strict=True)]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        score = 1 - sizes[order[0]] / sizes[order[1]]
        return self.labels[order[0]], score, score < MARGIN


def _predict(sent, text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Identifier(sent.value)
        for batch in batches:
            found = [model.predict(t) for t in batch.column(text_at).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != text_at]
            arrays = [*columns, *(pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_())))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def identify(docs: DataFrame, learn_from: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each of docs (doc_id, text, ...); learn_from: doc_id, text, lang."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(learn_from))
    schema = "doc_id long, lang_pred string, score double, rejected boolean"
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(lean(_predict(sent, 1, ["doc_id", "lang_pred", "score", "rejected"])), schema)


def keep_identified(docs: DataFrame, learn_from: DataFrame) -> DataFrame:
    """docs without the rejected ones, all columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(learn_from))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Identifier(sent.value)
        for batch in batches:
            found = [model.predict(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([not gone for _, _, gone in found], pa.bool_()))

    names, at = docs.columns, docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(lean(run), plain.schema).toDF(*names)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    found = identify(docs, docs.where(~held_out).select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
