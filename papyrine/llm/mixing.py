"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Every document gets a rate between 0 and 2, the exponentially tilted mean of two fair coins:
``2 * exp(l * c) / (1 + exp(l * c))`` with ``c`` the document's size over the mean size of its source. Among all such
rates that meet a source's token target, these lie nearest (in relative entropy) to one copy of every document. The
multiplier ``l`` of a source minimises the convex dual ``sum 2 log(1 + exp(l c)) - l * target``; Newton steps, kept
within a bracket, run for all sources at once over the table of (source, size, number of documents). Rates become
copies 0, 1 or 2 by systematic rounding along sizes; of OFFSETS starting points, each source takes that whose words
come nearest to its target.

All sums are of integers (rates count in 2**-40), so reruns agree whatever the order of rows. A source's documents are
rounded in groups of about ROWS rows, or the square root of their number, however large it is. Sources themselves, one row each, are ranked in one task:
there may be many thousands of them, not as many as documents.

Defined cases: null text has size 0; a null source is a source of its own, last in order; documents of size 0 take
nothing and keep one copy; an empty table gives an empty result; repeated rows count each (equal sizes with equal ids
are in no certain order, which changes no sum); other columns are ignored, but for those asked for with ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.common import WORD, dropped, written

ONE = 1 << 40
BINS_PER_OCTAVE = 8
OFFSETS = 32
ROWS = 500


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, target): weights repeat along sources by code point, null last.

    A target stops at ``most`` times its source's size; the excess goes to the sources below, by weight, until none
    is above. In closed form: a source is full when its size per weight is small, so with sources ordered by that, the
    full ones are a prefix; the rest share what remains by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (at + 1).cast("int")).cast("long"))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest_tokens = F.lit(share) * F.sum("source_size").over(all_rows) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rest_weight = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", rest_tokens / rest_weight).withColumn("place", F.row_number().over(fill))
    everyone = Window.partitionBy()
    per = per.withColumn("open", F.min(F.when(F.col("level") * F.col("weight") < F.lit(most) * F.col("source_size"), F.col("place"))).over(everyone))
    level = F.max(F.when(F.col("place") == F.col("open"), F.col("level"))).over(everyone)
    target = F.when(F.col("place") < F.coalesce("open", F.lit(1 << 30)), F.lit(most) * F.col("source_size")).otherwise(level * F.col("weight"))
    return per.select("source", "source_size", "n_docs", "weight", target.cast("double").alias("target"))


def _rate(tilt: Column, c: Column) -> Column:
    return F.lit(2.0) / (F.lit(1.0) + F.exp(-tilt * c))


def solve_tilts(histogram: DataFrame, targets: DataFrame, steps: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(source, tilt) by Newton steps on the dual, one aggregation of the histogram a step.

    A step that would leave the bracket [lo, hi] of the root is replaced by its middle. Sources whose target is
    2 times their size, or 0, need no tilt and are absent. Each step's table (one row a source) is written, so lineage
    stays short. Ends when every source is within ``tolerance`` of its target, or its bracket has closed or reached its end.
    """
    wide = 64.0
    state = targets.select(
        "source", "target", "source_size", (F.col("source_size") / F.col("n_docs")).alias("mean"), F.lit(0.0).alias("tilt"), F.lit(-wide).alias("lo"), F.lit(wide).alias("hi")
    ).filter((F.col("target") > 0) & (F.col("target") < 2.0 * F.col("source_size")))
    state = written(state, "mix-state")
    for _ in range(steps):
        c = F.col("size") / F.col("mean")
        r = _rate(F.col("tilt"), c)
        slope = r * (F.lit(1.0) - r / 2) * c * F.col("size")
        grid = F.lit(float(1 << 20))
        sums = (
            histogram.filter(F.col("size") > 0).join(state, histogram["source"].eqNullSafe(state["source"])).select(state["source"].alias("key"), "n", (r * F.col("size") * grid).cast("long").alias("got"), (slope * grid).cast("long").alias("slope"))
            .groupBy("key").agg(F.sum((F.col("got") * F.col("n")).cast("decimal(38,0)")).alias("got"), F.sum((F.col("slope") * F.col("n")).cast("decimal(38,0)")).alias("slope"))
        )
        gap = F.col("got").cast("double") / grid - F.col("target")
        lo, hi = F.when(gap < 0, F.col("tilt")).otherwise(F.col("lo")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("hi"))
        step = F.col("tilt") - gap / F.greatest(F.col("slope").cast("double") / grid, F.lit(1e-9))
        near = F.abs(gap) <= F.col("target") * F.lit(tolerance)
        old, state = state, written(
            state.join(sums, state["source"].eqNullSafe(sums["key"])).select("source", "target", "source_size", "mean", "tilt", lo.alias("lo"), hi.alias("hi"), step.alias("step"), near.alias("near"))
            .select("source", "target", "source_size", "mean", F.when(F.col("near"), F.col("tilt")).when((F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi")), F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2).alias("tilt"), "lo", "hi", "near"),
            "mix-state",
        )
        if state.filter(~F.col("near") & (F.col("hi") - F.col("lo") > 1e-9) & (F.col("lo") < wide - 1e-6)).isEmpty():
            break
        dropped(old)
        state = state.drop("near")
    else:
        raise RuntimeError(f"tilts have not converged in {steps} steps")
    return state.select("source", "tilt", "mean")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, rows: int = ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken for every row of docs(doc_id, text, source), and its columns ``keep``.

    Rounding runs within (source, size bin, salt) groups of about ``rows`` documents (or the square root of a bin's
    number), so that no source meets in one task; group totals give each group its start. Size bins are an eighth of an
    octave wide.
    """
    size = word_count(F.col("text"))
    sizes = written(docs.select("doc_id", *keep, "source", size.alias("size")).withColumn("bin", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * BINS_PER_OCTAVE)).otherwise(-1).cast("int")), "mix-sizes")
    targets = written(source_targets(sizes, weights, share), "mix-targets")
    histogram = sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    histogram = written(histogram, "mix-histogram")
    tilts = solve_tilts(histogram, targets)
    known = targets.alias("a").join(tilts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.source", "source_size", "target", "tilt", "mean")
    known = written(known, "mix-known")
    groups = written(sizes.groupBy("source", "bin").agg(F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(float(rows)), F.sqrt(F.count(F.lit(1))))).cast("int").alias("salts")), "mix-groups")
    full = F.col("target") >= 2.0 * F.col("source_size")
    rate = F.when(F.col("size") == 0, 1.0).when(full, 2.0).when(F.col("target") <= 0, 0.0).otherwise(_rate(F.col("tilt"), F.col("size") / F.col("mean")))
    rated = (
        sizes.alias("s").join(known.alias("k"), F.col("s.source").eqNullSafe(F.col("k.source")), "left")
        .join(groups.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")) & (F.col("s.bin") == F.col("g.bin")), "left")
        .select("doc_id", *keep, F.col("s.source").alias("source"), "size", "source_size", "target", rate.alias("rate"), F.col("s.bin").alias("bin"), F.pmod(F.xxhash64("doc_id", *keep), F.col("salts")).cast("int").alias("salt"))
        .withColumn("units", F.round(F.col("rate") * F.lit(float(ONE))).cast("long"))
    )
    group = ["source", "bin", "salt"]
    starts = rated.groupBy(*group).agg(F.sum(F.col("units").cast("decimal(38,0)")).alias("total"))
    before = Window.partitionBy("source").orderBy("bin", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*[F.col(x).alias(f"{x}_") for x in group], F.coalesce(F.sum("total").over(before), F.lit(0)).cast("decimal(38,0)").alias("start"))
    inner = Window.partitionBy(*group).orderBy("size", "doc_id", *keep).rowsBetween(Window.unboundedPreceding, 0)
    run = rated.withColumn("upto", F.sum(F.col("units").cast("decimal(38,0)")).over(inner))
    run = run.join(starts, F.col("source").eqNullSafe(F.col("source_")) & (F.col("bin") == F.col("bin_")) & (F.col("salt") == F.col("salt_")), "left")
    run = run.select("doc_id", *keep, F.col("source"), "size", "source_size", "target", "rate", "units", (F.col("start") + F.col("upto")).cast("decimal(38,0)").alias("end"))
    run = written(run, "mix-run")
    trials = run.filter(F.col("size") > 0).groupBy("source", "target").agg(*[F.sum(_copies(F.lit(j * ONE // OFFSETS)) * F.col("size")).alias(f"t{j}") for j in range(OFFSETS)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{j}") - F.col("target")).alias("gap"), F.lit(j).alias("j")) for j in range(OFFSETS)]))
    chosen = trials.select(F.col("source").alias("source_"), (best["j"] * F.lit(ONE // OFFSETS)).cast("long").alias("offset"))
    done = run.join(chosen, F.col("source").eqNullSafe(F.col("source_")), "left").withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(_copies(F.col("offset"))).cast("int"))
    return done.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *keep)


def _copies(offset: Column) -> Column:
    """Whole units passed between the running sums before and after a document, the sums moved by ``offset``."""
    whole = lambda x: F.floor((x + offset.cast("decimal(38,0)")) / F.lit(ONE).cast("decimal(38,0)")).cast("long")
    return F.greatest(F.lit(0), F.least(F.lit(2), whole(F.col("end")) - whole(F.col("end") - F.col("units"))))
