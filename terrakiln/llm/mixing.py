"""Mixing sources to target weights (op10): Efraimidis-Spirakis sampling with word budgets.

Every document gets the exponential key ln(u) / w: u is uniform, hashed from its id, w its quality weight. Within a
source, documents stand by falling key. A source's budget buys whole epochs of the source first; what remains goes to
the documents at the front of that order, the one at the border in part.

Only sums by (source, bucket) and the rows of one small bucket per source are ever shuffled: buckets cut the key's range, so
the prefix sum needs no sort of a whole source, and a source with a third of all rows is no single task. The bucket at a
source's border is cut again: with weights from 0.1 to 1 a bucket has at most 0.3 % of a source's rows, a part of it about
1 / BUCKETS of that. The decision is a threshold per source, applied to the documents where they are.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a source of its own, last in order; a null
id hashes as the text "null"; rows with the same source, id and size share what is left at the border evenly; an empty
table gives an empty result; other columns of the input pass through `mix_documents` and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, small, stored, table

SHARE, CAP, SOURCE_WEIGHTS, SEED = 1.5, 2, (3, 1, 2), "mix"
#: Cuts of the key's range, per source, and of the bucket at the border.
BUCKETS = 2048
#: A plan of up to this many sources is broadcast; a larger one is joined by a shuffle.
PLAN_ROWS = 20_000
SYMBOLS = "#*$%&|<>"


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long"), F.lit(0).cast("long"))


def quality_weight(text: Column) -> Column:
    """From 0.1 (every tenth character is a symbol, or no text) to 1."""
    chars = F.length(text)
    symbols = chars - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(10.0) * symbols / F.nullif(chars, F.lit(0))), F.lit(0.1))


def sampling_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    unit = (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.log(unit) / weight


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    """source, doc_id, size and key of each document."""
    text = F.col("text")
    return docs.select("doc_id", "source", n_words(text).alias("size"), quality_weight(text).alias("_w")).select(
        "doc_id", "source", "size", sampling_key(F.col("doc_id"), F.col("_w"), seed).alias("key")
    )


def _targets(cells: DataFrame, share: float, cap: int, weights: tuple[int, ...]) -> DataFrame:
    """A row per source: source_size, target. Water-filling in closed form: sources in order of cap / weight; those that
    the level of all before them fills are full, the others share one level. One row per source in one task."""
    sizes = cells.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1)
    filled = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * cap)
        .withColumn("rn", F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())))
    )
    before = Window.orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("rn").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        filled.withColumn("level", (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("common", F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(every))
    )
    return filled.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("common") * F.col("weight")).alias("target"))


def mix_plan(
    keyed: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple[int, ...] = SOURCE_WEIGHTS, buckets: int = BUCKETS
) -> DataFrame:
    """A row per source: source_size, target, epochs, and the border of the fraction: edge_key, edge_id, edge_size, edge_words."""
    place = -F.col("key") / (F.lit(1.0) - F.col("key")) * buckets  # rises as keys fall; spreads keys of all weights
    dealt = keyed.withColumn("bucket", F.floor(place).cast("int")).withColumn("part", F.floor((place - F.floor(place)) * buckets).cast("int"))
    cells = stored(dealt.groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    targets = _targets(cells, share, cap, weights).withColumn(
        "epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    )
    targets = targets.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = cells.withColumn("ahead", F.coalesce(F.sum("size").over(running), F.lit(0)))
    at = at.withColumnRenamed("source", "_s").join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    borders = at.where((F.col("rest") > 0) & (F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("size") >= F.col("rest")))
    borders = stored(borders.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.col("rest").alias("_rest"), F.col("ahead").alias("_ahead")))
    near = dealt.join(small(borders, PLAN_ROWS), F.col("_s").eqNullSafe(F.col("source")) & (F.col("_b") == F.col("bucket")))
    parted = near.groupBy("source", "bucket", "part", "_rest", "_ahead").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parted = parted.withColumn("_at", F.col("_ahead") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    parted = parted.where((F.col("_at") < F.col("_rest")) & (F.col("_at") + F.col("size") >= F.col("_rest")))
    parted = stored(parted.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.col("part").alias("_p"), "_rest", F.col("_at").alias("_ahead")))
    near = dealt.join(small(parted, PLAN_ROWS), F.col("_s").eqNullSafe(F.col("source")) & (F.col("_b") == F.col("bucket")) & (F.col("_p") == F.col("part")))
    # rows that no order can tell apart count as one, `n` times
    ties = near.groupBy("source", "key", "doc_id", "size", "_rest", "_ahead").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy(F.col("key").desc(), F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("_before", F.col("_ahead") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0)))
    edges = ties.where((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("size") * F.col("n") >= F.col("_rest")))
    edges = edges.select(
        F.col("source").alias("_s"), F.col("key").alias("edge_key"), F.col("doc_id").alias("edge_id"), F.col("size").alias("edge_size"),
        F.floor((F.col("_rest") - F.col("_before")) / F.col("n")).cast("long").alias("edge_words"),
    )
    return stored(targets.join(edges, F.col("_s").eqNullSafe(F.col("source")), "left").drop("_s", "rest"))


def _with_taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target, taken; rows have source, doc_id, size, key."""
    plan = small(plan.withColumnRenamed("source", "_s"), PLAN_ROWS)
    joined = rows.join(plan, F.col("_s").eqNullSafe(F.col("source")))
    key, top = F.col("key"), F.col("edge_key")
    same_id = F.col("doc_id").eqNullSafe(F.col("edge_id"))
    id_first = F.coalesce(F.col("doc_id") < F.col("edge_id"), F.col("doc_id").isNotNull())
    first = (key > top) | ((key == top) & ((~same_id & id_first) | (same_id & (F.col("size") < F.col("edge_size")))))
    extra = (
        F.when(top.isNull(), F.lit(0))
        .when(first, F.col("size"))
        .when((key == top) & same_id & (F.col("size") == F.col("edge_size")), F.col("edge_words"))
        .otherwise(F.lit(0))
    )
    return joined.withColumn("taken", F.col("epochs") * F.col("size") + extra)


def mix(docs: DataFrame, *, share: float = SHARE, cap: int = CAP, weights: tuple[int, ...] = SOURCE_WEIGHTS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each row of docs (doc_id, text, source, ...)."""
    keyed = stored(_keyed(docs, seed))
    out = _with_taken(keyed, mix_plan(keyed, share, cap, weights))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, *, share: float = SHARE, cap: int = CAP, weights: tuple[int, ...] = SOURCE_WEIGHTS, seed: str = SEED) -> DataFrame:
    """The mixed corpus with the columns of docs: a document once for each time it is taken whole, and cut after its last
    word taken where a border falls into it. Texts stay in their partitions; n_chars follows a cut text."""
    columns = docs.columns
    plan = mix_plan(stored(_keyed(docs, seed)), share, cap, weights)
    packed = F.struct(*columns).alias("_doc")
    rows = docs.select(packed, "doc_id", "source", n_words(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("_w"))
    rows = rows.select("_doc", "doc_id", "source", "size", sampling_key(F.col("doc_id"), F.col("_w"), seed).alias("key"))
    taken = _with_taken(rows, plan).select("_doc", "size", "taken").where("taken > 0")
    pieces = F.array_repeat(F.col("size"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    rest = F.col("taken") % F.col("size")
    pieces = F.when(rest > 0, F.concat(pieces, F.array(rest))).otherwise(pieces)
    each = taken.select("_doc", "size", F.explode(pieces).alias("_n"))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("_doc.text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("_n").cast("int")), "")
    text = F.when(F.col("_n") < F.col("size"), head).otherwise(F.col("_doc.text"))
    each = each.withColumn("_text", text)
    made = {"text": F.col("_text"), "n_chars": F.when(F.col("_n") < F.col("size"), F.length("_text")).otherwise(F.col("_doc.n_chars")).cast("long") if "n_chars" in columns else None}
    return each.select(*[made[c].alias(c) if made.get(c) is not None else F.col(f"_doc.`{c}`").alias(c) for c in columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_KEYED_SQL = r"""
keyed AS (
  SELECT doc_id, source, size,
         ln((CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 0.5::DOUBLE)
            / 4503599627370496.0::DOUBLE) / w AS key
  FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
               coalesce(greatest(0.1::DOUBLE, 1.0::DOUBLE - 10.0::DOUBLE * (length(text) - length(translate(text, '#*$%&|<>', '')))
                        / nullif(length(text), 0)::DOUBLE), 0.1::DOUBLE) AS w
        FROM documents)),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM keyed GROUP BY source),
weighted AS (SELECT source, source_size, 2 * source_size AS cap, CASE turn % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM sizes),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
         row_number() OVER w AS rn
  FROM weighted WINDOW w AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
common AS (SELECT arg_min(level, rn) FILTER (WHERE cap > level * weight) AS level FROM levels),
targets AS (SELECT l.source, source_size, CASE WHEN cap <= l.level * weight THEN cap::DOUBLE ELSE c.level * weight END AS target FROM levels l, common c),
spent AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM targets),
placed AS (
  SELECT k.doc_id, k.size, s.source_size, s.target, s.epochs,
         round(s.target - s.epochs * s.source_size)::BIGINT AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key DESC, k.doc_id NULLS LAST, k.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM keyed k JOIN spent s ON k.source IS NOT DISTINCT FROM s.source)
"""
OP10_SQL = f"""WITH {_KEYED_SQL}
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM placed"""
