r"""Mixing sources to target weights by hash-threshold histograms, with DataFrame operations only.

Sizes are words.  The targets share the sum of all sizes by weight, stop at `most_copies` times their
source's size, and the excess is shared again by weight until none is above (this is one water level:
target = min(cap, level * weight), found by running sums over the sources).  A source is taken
floor(target / size) times whole; for the rest, its documents are put into buckets by a hash of their
id.  A histogram of words by source and bucket gives the bucket in which the remaining budget ends; only
that bucket is refined, by the next digits of the hash, and again, until it holds no more than the
documents of one hash value.  That last group is taken if this comes nearer to the budget.  Documents
are then filtered by comparing hashes with thresholds: nothing is sorted or gathered by source.

Defined results: null text has size 0, null source is a source of its own (last), null ids hash as
'null'; documents of size 0 follow the thresholds with 0 words taken; repeated rows are taken alike; an
empty table gives an empty result.  Added columns replace input columns of the same names, in upper or lower
case; all others, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, col, cut, held, others, released

#: Hexadecimal digits of the hash that each histogram looks at (the last level sees single hash values).
LEVELS = (3, 4, 8)
#: Sources up to which their thresholds (under 200 bytes each) are broadcast; beyond it, they are joined.
BROADCAST_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "taken", "copies")


def words(text: Column) -> Column:
    """Number of words, null as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], most_copies: int) -> DataFrame:
    """source, source_size -> with target.  One row per source; running sums over sources only."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(ordered) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most_copies)
    # Sources in the order in which a rising level reaches their caps.
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    reached = capped.withColumn("level", level).withColumn("open", F.col("cap") >= F.col("level") * F.col("weight"))
    # The level of the first source whose cap is not reached holds for it and all after it.
    first = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(everything)
    settled = F.coalesce(first["level"], F.lit(float("inf")))
    return reached.withColumn("settled", settled).select("source", "source_size", F.least("cap", F.col("settled") * F.col("weight")).alias("target"))


def sent(per_source: DataFrame) -> DataFrame:
    """A table of one row per source, broadcast if a count shows that it is small."""
    return F.broadcast(per_source) if per_source.count() <= BROADCAST_SOURCES else per_source


def plan_mix(sized: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3) -> DataFrame:
    """sized: id_hash (hexadecimal), source, size -> per source: source_size, target, whole, t1, t2, ...

    t<level> is the digit group in which the budget ends at that level; a document is in if its digit
    groups are below the thresholds in lexicographic order, or, at the last level, equal and `last` holds.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sources, weights, most_copies)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most_copies))).otherwise(0)
    state = goal.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    state = cut(state)
    at = 1
    for level, digits in enumerate(LEVELS):
        last = level == len(LEVELS) - 1
        digit = F.substring("id_hash", at, digits)
        inside = sized.withColumn("digit", digit).select("id_hash", "source", "size", "digit")
        if level:
            marks = sent(state.select(F.col("source").alias("s"), *[F.col(f"t{i}").alias(f"m{i}") for i in range(level)]))
            same = F.col("source").eqNullSafe(F.col("s"))
            start = 1
            for i in range(level):
                same = same & (F.substring("id_hash", start, LEVELS[i]) == F.col(f"m{i}"))
                start += LEVELS[i]
            inside = inside.join(marks, same, "left_semi")
        histogram = inside.groupBy("source", "digit").agg(F.sum("size").alias("n"))
        running = Window.partitionBy("source").orderBy("digit")
        bars = histogram.withColumn("upto", F.sum("n").over(running)).withColumnRenamed("source", "s")
        hit = bars.join(state.select(F.col("source").alias("q"), "rest"), F.col("s").eqNullSafe(F.col("q"))).where(F.col("upto") > F.col("rest"))
        edge = hit.groupBy("s").agg(F.min(F.struct("digit", "n", "upto")).alias("b"))
        joined = state.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
        # No bar beyond the budget: everything at this level is in.
        state = joined.select(
            *[c for c in state.columns if c != "rest"],
            F.coalesce(F.col("b.digit"), F.lit("~")).alias(f"t{level}"),
            F.when(F.col("b").isNull(), F.lit(0.0)).otherwise(F.col("rest") - (F.col("b.upto") - F.col("b.n"))).alias("rest"),
            *([F.coalesce(F.col("b.n").cast("double") - F.col("rest") + (F.col("b.upto") - F.col("b.n")) <= F.col("rest") - (F.col("b.upto") - F.col("b.n")), F.lit(False)).alias("last")] if last else []),
        )
        state = cut(state)
        at += digits
    return state


def mix(df: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Every row of df with size, source_size, target, copies (times it is taken) and taken (words)."""
    kept = [c for c in others(df, ADDED) if keep is None or c in keep]
    id_hash = F.md5(F.encode(F.coalesce(col(id_col).cast("string"), F.lit("null")), "UTF-8"))
    measured = df.select(held(kept), id_hash.alias("id_hash"), col(source_col).alias("source"), words(col(text_col)).alias("size"))
    narrow = set(kept) <= {id_col, source_col}
    if narrow:
        measured = cut(measured)  # the texts are read once
    sized = measured.select("id_hash", "source", "size")
    if not narrow:
        sized = cut(sized)
    thresholds = plan_mix(sized, weights=weights, most_copies=most_copies).withColumnRenamed("source", "s")
    below, start, equal = F.lit(False), 1, F.lit(True)
    for level, digits in enumerate(LEVELS):
        digit = F.substring("id_hash", start, digits)
        below = below | (equal & (digit < F.col(f"t{level}")))
        equal = equal & (digit == F.col(f"t{level}"))
        start += digits
    joined = measured.join(sent(thresholds), F.col("source").eqNullSafe(F.col("s")))
    copies = F.col("whole") + F.when(below | (equal & F.col("last")), 1).otherwise(0)
    return joined.withColumn("copies", copies).select(*released(kept, F.col(ROW)), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
