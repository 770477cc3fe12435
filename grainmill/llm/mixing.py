"""Mixing sources to target token weights by entropy balancing, with DataFrame operations only.

Let document i of source s have size_i words. Rates r_i >= 0, how often each document is taken on average, are chosen
to stay as near to "every document once" as the targets allow: they minimise sum r log r - r + 1 under
sum of r_i size_i = target_s for each source, and r_i <= cap. The dual has one variable a source; its solution is
exponentially tilted, r_i = min(cap, exp(lambda_s * size_i / mean size of s)). All sources' Newton steps are taken at
once by sums over (source, size, count) rows. The rates become whole copies by one shift a source of hashed uniform
numbers, found by two rounds of binned weighted sums; then documents of a source are turned the other way, one in each
round, until none would bring the words taken nearer to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm._common import Workspace, small_side, words_of

#: Newton ends when every source's words are within this share of its target, or after ROUNDS.
TOLERANCE, ROUNDS = 1e-10, 60
#: Bins of each of the two rounds that place a source's rounding shift.
BINS = 4096
#: Documents a source whose rounding is turned to meet the target more closely, at most. The shift leaves a source less
#: than one document off, so large sources are done after a few rounds; small ones with a few long texts need more.
FLIPS = 64


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row for each source of sizes(source, size): sid, source, source_size, n, mean, target.

    Sources are numbered by code point, null last; their weights repeat. Targets fill like water, w_s * level, up to
    cap * source_size, and the level is where they sum to share of all sizes. The window has one row for each source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    numbered = by_source.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    limits = numbered.withColumn("w", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy((F.col("limit") / F.col("w")).asc(), "sid")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    w_left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    wanted = F.sum("source_size").over(everything) * F.lit(float(share))
    # The level if this and all later sources are below their limits; the first source for which it holds has it.
    level = limits.withColumn("level", (wanted - before) / w_left).withColumn("open", F.col("level") * F.col("w") <= F.col("limit"))
    final = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("limit"), F.coalesce(F.col("w") * final, F.col("limit")))
    return level.select("sid", "source", "source_size", "n", (F.col("source_size") / F.col("n")).alias("mean"), target.alias("target"))


def _rate(lam: Column, size: Column, mean: Column, cap: float) -> Column:
    return F.when(lam.isNull(), F.lit(float(cap))).otherwise(F.least(F.exp(F.least(lam * size / mean, F.lit(50.0))), F.lit(float(cap))))


def balance(sizes: DataFrame, targets: DataFrame, cap: float, work: Workspace) -> DataFrame:
    """targets with lam, the dual variable of each source; null where every rate is the cap.

    Newton steps, kept inside a bracket that each evaluation narrows; a step that would leave it is halved instead.
    """
    counts = work.stored(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("k")), "sizes")
    n_sources = targets.count()
    ids = small_side(targets.select("sid", F.col("source").alias("_source"), "mean"), n_sources, 100)
    counts = work.stored(counts.join(ids, counts["source"].eqNullSafe(ids["_source"])).select("sid", "size", "k", "mean"), "sizes-by-id")
    full = F.col("target") >= F.col("source_size") * F.lit(float(cap)) * (1 - 1e-12)
    state = targets.select("sid", "target", full.alias("full"), F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(1.0).alias("off"))
    state = work.stored(state, "dual-0")
    for i in range(ROUNDS):
        now = small_side(state.where("not full").select("sid", "lam"), n_sources, 24)
        rate = _rate(F.col("lam"), F.col("size"), F.col("mean"), cap)
        words = F.col("k") * F.col("size") * rate
        slope = F.when(rate < cap, words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = counts.join(now, "sid").groupBy("sid").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        sums = sums.select(F.col("sid").alias("_sid"), "words", "slope")
        step = state.join(small_side(sums, n_sources, 32), state["sid"] == F.col("_sid"), "left").drop("_sid")
        miss = F.col("words") - F.col("target")
        step = step.withColumn("off", F.coalesce(F.abs(miss) / F.greatest(F.col("target"), F.lit(1.0)), F.lit(0.0)))
        step = step.withColumn("lo", F.when(miss < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(miss > 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.when(F.col("slope") > 0, F.col("lam") - miss / F.col("slope"))
        inside = newton.isNotNull() & (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi"))) & (F.abs(newton - F.col("lam")) < 50)
        halved = F.when(F.col("lo").isNull(), F.col("hi") - 8.0).when(F.col("hi").isNull(), F.col("lo") + 8.0).otherwise((F.col("lo") + F.col("hi")) / 2)
        lam = F.when(F.col("off") <= TOLERANCE, F.col("lam")).when(inside, newton).otherwise(F.coalesce(halved, F.col("lam")))
        state = work.stored(step.select("sid", "target", "full", lam.alias("lam"), "lo", "hi", "off"), f"dual-{i + 1}")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            break
    # Nine digits: the order in which doubles were summed must not show in the result of a rerun.
    found = state.select(F.col("sid").alias("_sid"), F.when(~F.col("full"), F.round("lam", 9)).alias("lam"))
    return work.stored(targets.join(small_side(found, n_sources, 24), targets["sid"] == F.col("_sid")).drop("_sid"), "balanced")


def _uniform(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _threshold(size: Column, rate: Column, u: Column, cap: float) -> Column:
    """The shift at which a document gets its next copy: u + shift >= 1 - (rate - floor(rate)). Null if it has no words, or cannot get one more."""
    return F.when((size > 0) & (F.floor(rate) < int(cap)), 1.0 - (rate - F.floor(rate)) - u)


def _copies(rate: Column, threshold: Column, shift: Column, flipped: Column, cap: float) -> Column:
    extra = (F.coalesce(threshold, F.lit(2.0)) < shift) != flipped
    return F.least(F.floor(rate) + extra.cast("int"), F.lit(int(cap))).cast("int")


def flip_best(rows: DataFrame, plan: DataFrame, n_sources: int, cap: float, work: Workspace) -> DataFrame:
    """plan with flips, up to FLIPS hashes of documents whose rounding is turned the other way, and got brought up to date.

    Each time it is the document whose gained or lost copy brings the words of its source nearest to the target, if any
    does. A source without one in a round has none later; the rounds end when no source has one.
    """
    plan = plan.withColumn("flips", F.array().cast("array<double>"))
    for i in range(FLIPS):
        now = small_side(plan.where(F.size("flips") == i).select("sid", "shift", "flips", (F.col("target") - F.col("got")).alias("rest")), n_sources, 64 + 8 * i)
        free = rows.where("threshold is not null").join(now, "sid").where(~F.array_contains("flips", F.col("u")))
        change = F.when(F.col("threshold") < F.col("shift"), -F.col("size")).otherwise(F.col("size"))
        left = F.abs(F.col("rest") - change)
        best = free.where(left < F.abs(F.col("rest"))).groupBy("sid").agg(F.min(F.struct(left.alias("left"), change.alias("change"), "u")).alias("x"))
        best = best.select(F.col("sid").alias("_sid"), F.col("x.change").alias("change"), F.col("x.u").alias("u"))
        plan = plan.join(small_side(best, n_sources, 32), F.col("sid") == F.col("_sid"), "left")
        plan = plan.withColumn("flips", F.when(F.col("u").isNull(), F.col("flips")).otherwise(F.concat("flips", F.array("u"))))
        plan = plan.withColumn("got", F.col("got") + F.coalesce("change", F.lit(0))).drop("_sid", "change", "u")
        plan = work.stored(plan, f"flips-{i}")
        if (plan.agg(F.max(F.size("flips"))).first()[0] or 0) <= i:
            break
    return plan


def place_shifts(rows: DataFrame, plan: DataFrame, n_sources: int, work: Workspace) -> DataFrame:
    """plan with shift: where the words of rows(sid, size, rate, threshold) taken come nearest to the target.

    Two rounds of BINS bins a source: the first finds the bin in which the target is crossed, the second a place in it.
    """
    base = rows.groupBy("sid").agg(F.sum(F.floor("rate") * F.col("size")).alias("least"))
    plan = plan.join(small_side(base.withColumnRenamed("sid", "_sid"), n_sources, 24), F.col("sid") == F.col("_sid"), "left").drop("_sid")
    plan = work.stored(plan.withColumn("from", F.lit(-1.0)).withColumn("width", F.lit(2.0 / BINS)).withColumn("got", F.coalesce("least", F.lit(0)).cast("double")), "shift-0")
    for i in (1, 2):
        now = small_side(plan.select("sid", "from", "width"), n_sources, 32)
        place = F.floor((F.col("threshold") - F.col("from")) / F.col("width")).cast("int")
        within = rows.where("threshold is not null").join(now, "sid").select("sid", "size", place.alias("bin")).where(F.col("bin").between(0, BINS - 1))
        bins = within.groupBy("sid", "bin").agg(F.sum("size").alias("words"))
        ends = plan.select("sid", F.explode(F.array(F.lit(0), F.lit(BINS))).alias("bin"), F.lit(0).cast("long").alias("words"))
        run = Window.partitionBy("sid").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        sums = bins.union(ends).groupBy("sid", "bin").agg(F.sum("words").alias("words"))
        sums = sums.withColumn("below", F.coalesce(F.sum("words").over(run), F.lit(0)))
        told = sums.join(small_side(plan.select(F.col("sid").alias("_sid"), "got", "target"), n_sources, 40), F.col("sid") == F.col("_sid"))
        total = F.col("got") + F.col("below")
        # The last bin that starts at or below the target; in the second round the start nearest to it.
        if i == 1:
            best = told.where((total <= F.col("target")) | (F.col("bin") == 0)).groupBy("sid").agg(F.max(F.struct("bin", "below")).alias("x"))
        else:
            best = told.groupBy("sid").agg(F.min(F.struct(F.abs(total - F.col("target")).alias("d"), "bin", "below")).alias("x"))
        best = best.select(F.col("sid").alias("_sid"), F.col("x.bin").alias("bin"), F.col("x.below").alias("below"))
        plan = plan.join(small_side(best, n_sources, 32), F.col("sid") == F.col("_sid")).drop("_sid")
        plan = plan.withColumn("from", F.col("from") + F.col("bin") * F.col("width")).withColumn("got", F.col("got") + F.col("below")).withColumn("width", F.col("width") / BINS).drop("bin", "below")
        plan = work.stored(plan, f"shift-{i}")
    return plan.withColumnRenamed("from", "shift")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of docs as a struct `row`, and size, source_size, target, rate, copies and taken as a struct `mix`.

    docs needs doc_id, text and source; its other columns stay, whatever their names. size is the number of
    `[^\\x20\\x09-\\x0D]+` in the text (null: 0); a null source is a source, the last. Equal rows get equal copies.
    Rows without words have taken 0, and copies 1 (nothing tells against them). No document has more than cap copies.
    An empty table gives an empty result. Reruns agree: rounding depends on hashes of doc_id and text alone.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    sizes = docs.select(F.col("source").cast("string").alias("source"), words_of(F.col("text")).alias("size"), _uniform(F.lit(8), F.col("doc_id"), F.col("text")).alias("u"))
    sizes = work.stored(sizes, "documents")
    targets = work.stored(source_targets(sizes, weights, share, cap), "targets")
    n_sources = targets.count()
    plan = balance(sizes, targets, cap, work)
    names = small_side(plan.select("sid", F.col("source").alias("_source"), "mean", "lam"), n_sources, 200)
    rate = _rate(F.col("lam"), F.col("size"), F.col("mean"), cap)
    rows = sizes.join(names, sizes["source"].eqNullSafe(F.col("_source"))).withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(1.0))
    rows = rows.select("sid", "size", "rate", "u", _threshold(F.col("size"), F.col("rate"), F.col("u"), cap).alias("threshold"))
    plan = flip_best(rows, place_shifts(rows, plan, n_sources, work), n_sources, cap, work)
    fact = F.struct(F.col("source").alias("name"), "source_size", "target", "mean", "lam", "shift", "flips")
    facts = small_side(plan.select(fact.alias("_fact")), n_sources, 200 + 8 * FLIPS)
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = out.withColumn("_size", words_of(F.col("row.text"))).withColumn("_u", _uniform(F.lit(8), F.col("row.doc_id"), F.col("row.text")))
    out = out.join(facts, F.col("row.source").cast("string").eqNullSafe(F.col("_fact.name")))
    rate = _rate(F.col("_fact.lam"), F.col("_size"), F.col("_fact.mean"), cap)
    out = out.withColumn("_rate", F.when(F.col("_size") > 0, rate).otherwise(1.0))
    copies = _copies(F.col("_rate"), _threshold(F.col("_size"), F.col("_rate"), F.col("_u"), cap), F.col("_fact.shift"), F.array_contains("_fact.flips", F.col("_u")), cap)
    out = out.withColumn("_copies", copies)
    result = F.struct(F.col("_size").alias("size"), F.col("_fact.source_size").alias("source_size"), F.col("_fact.target").alias("target"), F.col("_rate").alias("rate"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).cast("long").alias("taken"))
    return out.select("row", result.alias("mix"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as many times as it has copies, with the columns of docs."""
    rows = mix(docs, **options).where("mix.copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("mix.copies")))).select("row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    from grainmill.llm._common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("row.doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")
