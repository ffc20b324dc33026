"""Mixing sources to target weights by a low-discrepancy schedule: golden-ratio points choose the source of each equal-token block.

Only DataFrame operations; nothing runs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesmith.llm.common import save

#: Words of a block, most copies of a document, and the sources' weights in code point order, repeated.
BLOCK, COPIES, WEIGHTS = 256, 3, (5, 2, 1)
#: Slots that one rank counts one by one, and documents that one running sum adds up, about.
CHUNK = 1 << 16
BUCKET_ROWS = 1 << 12
#: Equal pieces of [0, 1) by which points find their source's interval.
CELLS = 1 << 10
#: The golden ratio's fraction in units of 2**-31; point i is i * GOLDEN mod 2**31.
GOLDEN, UNIT = 1_327_217_885, 1 << 31

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """The number of words [^\\x20\\x09-\\x0D]+ (null text: 0)."""
    parts = F.size(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")).cast("long")
    bare = F.rlike(text, F.lit(r"[\x20\x09-\x0D]\z")).cast("long")
    return F.when(text.isNull() | ~F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), 0).otherwise(parts - bare).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES) -> DataFrame:
    """From rows (source, source_size): also weight and target.

    Targets share the sum of all sizes by weight and stop at `copies` times their source's size. Sources stop in the order of size to
    weight, so the level that the others share is the smallest of the levels that open as one more source stops: running sums, no loop.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * copies)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    stopped, freed = F.coalesce(F.sum("cap").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - stopped) / (F.sum("weight").over(everything) - freed))
    # the first source whose cap isn't below the level that opens with it sets the level for itself and all after it
    rows = rows.withColumn("level", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return rows.withColumn("target", target).select("source", "source_size", "weight", "target")


def schedule(plan: DataFrame, total: int, block: int = BLOCK) -> DataFrame:
    """Slots of the mix: slot, source, place (the slot's rank among its source's slots, from 0), until sources have met their targets;
    need, blocks and rest are the source's: slots to its target, blocks in one reading, words of its last, partial reading.

    Point i * golden ratio, mod 1, lies in one source's interval of the cumulative weights; intervals are matched by equal cells. Twice
    as many slots as the blocks of all words are laid out, and a source's slots beyond its target's last block are left out. Where the
    points give a source too few (its blocks are short ones, so it needs more than its share), its last places follow the schedule. Ranks count within runs of 65,536 slots and start from the runs'
    running sums, so no task ranks all slots of a hot source.
    """
    spark = plan.sparkSession
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = plan.where("target > 0").withColumn("high", F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    sources = sources.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0)))
    sources = sources.withColumn("high", F.when(F.lead("source").over(order).isNull() & (F.row_number().over(Window.orderBy(F.col("source").desc_nulls_first())) == 1), 2.0).otherwise(F.col("high")))
    want, blocks = F.round("target").cast("long"), F.ceil(F.col("source_size") / block)
    rest = want % F.col("source_size")  # words of the last, partial reading
    sources = sources.withColumns({"blocks": blocks, "rest": rest, "need": F.floor(want / F.col("source_size")) * blocks + F.ceil(rest / block)})
    cells = sources.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1).cast("long")))))
    n = 2 * (total // block) + 64
    points = spark.range(n).select(F.col("id").alias("slot"), (F.col("id") % UNIT * GOLDEN % UNIT / UNIT).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS))
    slots = points.join(cells, "cell").where("u >= low and u < high").select("slot", "source", "need", "blocks", "rest", F.expr(f"slot div {CHUNK}").alias("run"))
    return _ranked(slots).unionByName(_missing(sources, slots, n))


def _missing(sources: DataFrame, slots: DataFrame, n: int) -> DataFrame:
    """The places that the points leave empty, by source, from slot n on: a few of each source at most."""
    have = slots.groupBy("source").agg(F.count("*").alias("have")).withColumnRenamed("source", "_s")
    short = sources.join(have, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long"))).where("have < need")
    earlier = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("from", F.lit(n) + F.coalesce(F.sum(F.col("need") - F.col("have")).over(earlier), F.lit(0)) - F.col("have"))
    short = short.withColumn("place", F.explode(F.sequence("have", F.col("need") - 1)))
    return short.select((F.col("from") + F.col("place")).alias("slot"), "source", "place", "need", "blocks", "rest")


def _ranked(slots: DataFrame) -> DataFrame:
    runs = slots.groupBy("source", "run").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("source").alias("_s"), F.col("run").alias("_r"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    joined = slots.join(runs, F.col("source").eqNullSafe(F.col("_s")) & (F.col("run") == F.col("_r")))
    place = F.col("before") + F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1
    return joined.withColumn("place", place).where("place < need").select("slot", "source", "place", "need", "blocks", "rest")


def _laid_out(sized: DataFrame, rows: int) -> DataFrame:
    """Each document's first word number in its source's shuffled row of documents (`first`): running sums within hash buckets, which
    start from the buckets' running sums."""
    buckets = max(1, rows // BUCKET_ROWS)
    sized = sized.withColumn("bucket", F.pmod("shuffle", F.lit(buckets)))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    joined = sized.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))).drop("_s", "_b")
    within = Window.partitionBy("source", "bucket").orderBy("shuffle", "rid").rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("first", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))).drop("before", "bucket", "shuffle")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", rid: str | None = None, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: rid, doc_id, source, size, source_size, target, taken.

    A source's documents lie in the order of a seeded hash; block k of the source is its words [k * block, (k + 1) * block). The source's
    slots are joined with its blocks in order, which start over when they end, at most three times in all; the last slot stops at the
    rounded target. taken counts a document's words in the joined blocks. Reruns over the same rows agree.
    Null source: a source of its own, last. Null or empty text: size 0, nothing taken. Repeated rows are separate documents. All texts
    without words, or no rows: all targets 0. Other columns aren't read. docs must be a plain scan, or have row numbers in column `rid`.
    """
    rows = docs if rid else docs.withColumn("rid", F.monotonically_increasing_id())
    sized = save(
        rows.select(F.col(rid or "rid").alias("rid"), F.col(id_col).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text)).alias("shuffle"))
    )
    plan = save(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights).coalesce(1))
    totals = plan.agg(F.sum("source_size").alias("words")).first()
    laid = save(_laid_out(sized, sized.count()).select("rid", "doc_id", "source", "size", "first"))

    slots = schedule(plan, totals.words or 0, block).select(F.col("source").alias("_s"), F.expr("place % blocks").alias("_k"), F.when((F.col("place") == F.col("need") - 1) & (F.col("rest") > 0), F.col("rest")).alias("_until"))
    pieces = laid.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))))
    joined = pieces.join(slots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_k")))
    end = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block, F.col("_until"))
    words = F.greatest(F.lit(0), end - F.greatest(F.col("first"), F.col("block") * block))
    taken = joined.groupBy("rid").agg(F.sum(words).alias("taken"))

    known = plan.select(F.col("source").alias("_s"), "source_size", "target")
    out = laid.join(known, F.col("source").eqNullSafe(F.col("_s"))).join(taken, "rid", "left")
    return out.select("rid", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", chars: str = "n_chars", seed: int = 0) -> DataFrame:
    """docs as mixed: each document as many times as the mix takes it whole, and once more cut to its first words where it takes a part.

    docs' own columns; a cut document's `chars`, if there is such a column, is its new length. Documents that the mix doesn't take go.
    """
    name = "rid"
    while name in docs.columns:
        name += "_"
    numbered = docs.withColumn(name, F.monotonically_increasing_id())
    found = mix(numbered, id_col, text, source, rid=name, seed=seed)
    found = found.where("taken > 0").select(F.col("rid").alias(name), F.expr("taken div size").alias("_copies"), F.expr("taken % size").alias("_part"), F.col("size").alias("_size"))
    joined = numbered.join(found, name).withColumn("_take", F.explode(F.concat(F.array_repeat(F.col("_size"), F.col("_copies").cast("int")), F.filter(F.array("_part"), lambda n: n > 0))))
    cut = F.col("_take") < F.col("_size")
    joined = joined.withColumn(text, F.when(cut, F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), F.lit(1), F.col("_take").cast("int")), " ")).otherwise(F.col(text)))
    if chars in docs.columns:
        joined = joined.withColumn(chars, F.when(cut, F.length(text).cast(docs.schema[chars].dataType)).otherwise(F.col(chars)))
    return joined.select(*docs.columns)
