"""Mixing sources to target weights along a low-discrepancy schedule, in DataFrame expressions only.

Each source's documents are shuffled by a hash and laid end to end as a stream of words, which is cut into blocks of
equal size. Slot i of the schedule is the point frac(i * golden ratio) on the cumulative target weights, and goes to
the source under it; the r-th slot of a source takes its r-th block, starting over when the stream ends. The last
slot of a source takes only what is left of its target; a source whose target the points have not yet filled gets
slots at the end. Running positions and ranks are made in two levels, sums per hash range first, so that no task
sorts a whole source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, checkpoint

BLOCK_WORDS = 1024
#: Hash ranges per source, and slots per chunk: the most rows of a source that one task orders.
RANGES, CHUNK = 1024, 1 << 12
#: Equal cells of the cumulative weights, by which points meet the sources that overlap their cell.
CELLS = 4096
SEED = 7
PATTERN = (5.0, 2.0, 1.0)
GOLDEN = 0.6180339887498949


def source_targets(sizes: DataFrame, pattern: tuple[float, ...] = PATTERN, share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """sizes(source, source_size) with target: share of all sizes dealt by weights that repeat the pattern over the
    sources by code point, null last. A target stops at epochs times its source's size; the excess is dealt among the
    others by weight until none is above.

    Sources fill up in the order of size per weight, so the levels are found with one running sum: the level is the
    least t with sum(min(w * t, cap)) = total. One row per source; sources are few beside documents."""
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weights = F.array(*[F.lit(float(w)) for w in pattern])
    table = sizes.withColumn("_at", F.row_number().over(ordered)).select(
        "source",
        "source_size",
        F.element_at(weights, (F.pmod(F.col("_at") - 1, F.lit(len(pattern))) + 1).cast("int")).alias("_w"),
        (F.col("source_size") * F.lit(float(epochs))).alias("_cap"),
    )
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        table.withColumn("_total", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        # the level if this source is the first that is not full; the first for which that holds is right
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_open"))
        .withColumn("_no", F.row_number().over(full))
        .withColumn("_ok", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_no", "_level")))
        .withColumn("_t", F.min("_ok").over(whole)["_level"])
    )
    return level.select(
        "source",
        "source_size",
        F.when(F.col("_t").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_t"))).alias("target"),
    )


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """targets(source_no, take) to slots (slot, source_no, rank, words): which source each slot draws on, its rank among
    the source's slots from 0, and the words it takes. Slots are numbered from 0; a source's slots sum to its take."""
    need = targets.select("source_no", "take", F.ceil(F.col("take") / F.lit(block_words)).cast("long").alias("_need"))
    bounds = need.withColumn("_hi", F.sum("take").over(Window.orderBy("source_no"))).select(
        "source_no", "take", "_need", (F.col("_hi") - F.col("take")).alias("_lo"), "_hi"
    )
    total = bounds.agg(F.sum("take").alias("t"), F.sum("_need").alias("n"), F.max("source_no").alias("k")).first()
    spark = targets.sparkSession
    # points beyond the number of blocks make up for the few by which a source's share may lag
    points = int((total["n"] or 0) + 4 * ((total["k"] or 0) + 1))
    width = max(1.0, float(total["t"] or 0)) / CELLS
    place = F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1.0)) * F.lit(width * CELLS)
    cell = lambda x: F.floor(x / F.lit(width))
    cells = bounds.filter("take > 0").select(
        "source_no", "_lo", "_hi", F.explode(F.sequence(cell(F.col("_lo")), F.least(cell(F.col("_hi")), F.lit(CELLS - 1)))).alias("_cell")
    )
    drawn = (
        spark.range(points if total["t"] else 0)
        .withColumn("_x", place)
        .withColumn("_cell", F.least(cell(F.col("_x")), F.lit(CELLS - 1)))
        .join(cells, "_cell")
        .filter((F.col("_lo") <= F.col("_x")) & (F.col("_x") < F.col("_hi")))
        .select("id", "source_no", F.expr(f"id div {CHUNK}").alias("_chunk"))
    )
    chunks = drawn.groupBy("source_no", "_chunk").count()
    earlier = Window.partitionBy("source_no").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = chunks.select("source_no", "_chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source_no", "_chunk").orderBy("id")
    ranked = drawn.withColumn("_in", F.row_number().over(inside) - 1).join(base, ["source_no", "_chunk"]).select(
        F.col("id").alias("slot"), "source_no", (F.col("_base") + F.col("_in")).alias("rank")
    )
    have = chunks.groupBy("source_no").agg(F.sum("count").alias("_have"))
    tail = (
        bounds.join(have, "source_no", "left")
        .withColumn("_have", F.coalesce("_have", F.lit(0)))
        .filter("_need > _have")
        .select("source_no", F.explode(F.sequence(F.col("_have"), F.col("_need") - 1)).alias("rank"))
        .select((F.lit(points) + F.col("rank")).alias("slot"), "source_no", "rank")
    )
    return (
        ranked.unionByName(tail)
        .join(bounds.select("source_no", "take", "_need"), "source_no")
        .filter("rank < _need")
        .select("slot", "source_no", "rank", F.least(F.lit(block_words).cast("long"), F.col("take") - F.col("rank") * block_words).alias("words"))
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    pattern: tuple[float, ...] = PATTERN,
    share: float = 1.5,
    epochs: float = 2.0,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """doc_id, size, source, source_size, target, taken: what the mix takes of every document.

    size is the number of words (null text: 0). Every row gives one row, rows with equal ids too; a source that is
    null is a source of its own. Documents without words take nothing. The order within a source is a seeded
    hash of the id and the size, so reruns agree. A document's taken words are at most ceil(epochs) times its size.
    An empty table gives an empty table; other columns are not read."""
    sized = checkpoint(
        docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            F.col(f"`{source}`").alias("source"),
            F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = checkpoint(
        source_targets(sizes, pattern, share, epochs)
        .withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))))
        .withColumn("take", F.round("target").cast("long"))
    )
    slots = schedule(targets.select("source_no", "take"), block_words)

    order = F.xxhash64("doc_id", "size", F.lit(SEED))
    placed = (
        sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("_range", F.shiftright(order, 54))
        .withColumn("_order", order)
    )
    earlier = Window.partitionBy("source_no").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("source_no", "_range").agg(F.sum("size").alias("_sum")).select(
        "source_no", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy("source_no", "_range").orderBy("_order", "doc_id", "size")
    laid = (
        placed.withColumn("_row", F.row_number().over(inside))
        .withColumn("_end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(base, ["source_no", "_range"])
        .withColumn("_start", F.col("_base") + F.col("_end") - F.col("size"))
    )
    # the parts of a document in the blocks of every pass over its source's stream
    passes = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("take") / F.col("source_size")).cast("int") - 1))
    pieces = (
        laid.filter("size > 0 and take > 0")
        .select("source_no", "_range", "_row", "size", F.explode(passes).alias("_pass"), "_start", "source_size")
        .withColumn("_from", F.col("_start") + F.col("_pass") * F.col("source_size"))
        .withColumn("_to", F.col("_from") + F.col("size"))
        .withColumn("rank", F.explode(F.sequence(F.expr(f"_from div {block_words}"), F.expr(f"(_to - 1) div {block_words}"))))
    )
    low = F.greatest(F.col("_from"), F.col("rank") * block_words)
    high = F.least(F.col("_to"), F.col("rank") * block_words + F.col("words"))
    taken = (
        pieces.join(slots, ["source_no", "rank"])
        .select("source_no", "_range", "_row", F.greatest(F.lit(0), high - low).alias("_n"))
        .groupBy("source_no", "_range", "_row")
        .agg(F.sum("_n").alias("taken"))
    )
    return laid.join(taken, ["source_no", "_range", "_row"], "left").select(
        "doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
