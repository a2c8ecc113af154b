"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis), in native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eoframe.llm.tables import free_name, materialize, text_hash, unit_hash

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Keys of a source are summed in this many equal intervals before any row is ranked.
INTERVALS = 1024
SEED = "mix"
SYMBOLS = "!\"#$%&*+/<=>@[]^_`{|}~\\"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def symbol_weight(text: Column) -> Column:
    """Quality weight between 0.1 and 1: falls with the share of characters that are symbols; 1 for null or empty text."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    junk = n - F.length(F.translate(t, SYMBOLS, ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(4.0) * junk.cast("double") / F.greatest(n, F.lit(1)).cast("double"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source (source, source_size) gets its target. Sources weigh 5, 2, 1, repeating by code point, null last.

    ``SHARE`` of all words is shared by weight, no target above ``MOST`` times its source. Sources reach their limit in the
    order of limit over weight, so the final level of the rest is the first one that no further source exceeds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place + 1).cast("int"))
    limit = F.lit(MOST) * F.col("source_size").cast("double")
    rows = sizes.select("source", "source_size", weight.alias("w"), limit.alias("top"))
    order = [F.col("top") / F.col("w"), F.col("source").asc_nulls_last()]
    ahead = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(SHARE) * F.sum(F.col("source_size")).over(every).cast("double")
    level = (total - F.coalesce(F.sum("top").over(ahead), F.lit(0.0))) / F.sum("w").over(rest)
    rows = rows.select("*", level.alias("level"))
    fits = F.when(F.col("level") <= F.col("top") / F.col("w"), F.col("level"))
    final = F.max(fits).over(every)  # levels fall from the first that fits on
    target = F.least(F.col("top"), F.coalesce(final, F.lit(float("inf"))) * F.col("w"))
    return rows.select("source", "source_size", target.alias("target"))


def mix(sized: DataFrame, intervals: int = INTERVALS, seed: str = SEED) -> DataFrame:
    """How many words of each document the mix takes. ``sized``: doc_id, source, size (words), weight (quality, above 0).

    Returns those columns with source_size, target and taken. A source gives floor(target / source_size) whole epochs; what is
    missing comes from its documents in the order of the keys -ln(u) / weight, whole documents, up to the one that brings the
    sum nearest to the target. u depends on doc_id alone, so reruns agree. A source is cut into intervals of exp(-key): all but
    the interval where the sum crosses are decided whole, so no task ranks more than one interval of a source. Null sources are
    one source; empty documents take nothing; an empty table gives no rows.
    """
    key = -F.log(unit_hash(F.col("doc_id"), seed)) / F.col("weight")
    rows = sized.withColumn("_key", key)
    rows = rows.withColumn("_cell", F.least(F.floor(F.exp(-F.col("_key")) * intervals), F.lit(intervals - 1)).cast("int"))
    rows = materialize(rows, "mix-rows")
    cells = materialize(rows.groupBy("source", "_cell").agg(F.sum("size").alias("cell_size")), "mix-cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")))
    earlier = Window.partitionBy("source").orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "_cell", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)).alias("before"))
    cells = cells.withColumnRenamed("source", "_s").join(
        targets.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t"))
    )
    size = F.col("source_size").cast("double")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0))
    cells = cells.select("_s", F.col("_cell").alias("_c"), "before", "source_size", "target", epochs.alias("_epochs"))
    joined = rows.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")))
    inside = Window.partitionBy("source", "_cell").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn("_ahead", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    missing = F.col("target") - F.col("_epochs") * size
    after = F.col("_ahead") + F.col("size")
    nearer = (after.cast("double") - missing) <= (missing - F.col("_ahead").cast("double"))
    extra = F.when((F.col("_ahead").cast("double") < missing) & nearer, F.col("size")).otherwise(F.lit(0))
    taken = (F.col("_epochs") * F.col("size") + extra).cast("long")
    return joined.select(*sized.columns, "source_size", "target", taken.alias("taken"))


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), symbol_weight(F.col("text")).alias("weight")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with all their columns, each as many times as the mix takes it.

    A document is told by its id (which may be null) and its text; of rows that repeat both, each is taken as often as one of
    them is in the mix.
    """
    other, other_digest, digest, times, turn, copy = (
        free_name(docs, n) for n in ("_id", "_sha", "_digest", "_times", "_turn", "_copy")
    )
    sized = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), symbol_weight(F.col("text")).alias("weight"),
        text_hash(F.col("text")).alias("digest"),
    )
    often = F.when(F.col("taken") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(0))
    taken = mix(sized).groupBy(F.col("doc_id").alias(other), F.col("digest").alias(other_digest), F.col("source").alias(turn)).agg(
        F.array_sort(F.collect_list(often)).alias(times)
    )
    taken = materialize(taken.where(F.array_max(times) > 0), "mix-taken")
    rows = docs.withColumn(digest, text_hash(F.col("text")))
    same = (
        F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(digest) == F.col(other_digest))
        & F.col("source").eqNullSafe(F.col(turn))
    )
    once = rows.join(taken.where(F.size(times) == 1), same).withColumn(turn, F.lit(1))
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    repeats = Window.partitionBy("doc_id", digest, "source").orderBy(F.xxhash64(*others) if others else F.lit(0))
    several = rows.join(taken.where(F.size(times) > 1), same).withColumn(turn, F.row_number().over(repeats))
    counted = once.unionByName(several).withColumn(times, F.element_at(times, F.col(turn))).where(F.col(times) > 0)
    copies = counted.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy))
    return copies.select(*docs.columns)
