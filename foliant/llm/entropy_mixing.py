"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

The mix takes document d with rate r_d, the expected number of its copies. Over all rates up to the cap that give each
source its target of tokens, those nearest to the prior rates q_d in relative entropy, the least sum of
r log(r / q) - r + q, are r_d = min(cap, q_d exp(l_s size_d)): each document is tilted exponentially by its size, with one
dual variable l_s for each source. Newton's iteration on the dual finds them; a step is one aggregate over the documents'
sizes. Rates are then rounded to whole copies by a hash of the document, and a few exchange passes bring the tokens that
each source gives to the nearest attainable whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import discard, stored

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, n_docs, source_size, target) of a table with source and size.

    Sources in code-point order, null last, get the weights in turn; targets share all tokens by weight,
    but stop at ``most`` times the source's size, and what is over is shared again by weight. The fixed
    point is computed in one pass: in the order of size over weight, sources are capped as long as the
    level of the rest, (tokens left) / (weights left), is above their cap. The windows run over one
    row per source, not over documents; an empty source gets target 0.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    per = per.withColumn("_w", F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (turn + 1).cast("int")).cast("long"))
    full = Window.orderBy((F.col("source_size") * most / F.col("_w")), F.col("source").isNull(), F.col("source"))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("_left", F.sum("source_size").over(rest) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)))
        .withColumn("_weights", F.sum("_w").over(rest) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_open", F.col("source_size") * most * F.col("_weights") >= F.col("_left") * F.col("_w"))
    )
    level = F.min(F.when(F.col("_open"), F.struct(-F.col("_weights"), (F.col("_left") / F.col("_weights")).alias("level"))))
    per = per.withColumn("_level", level.over(rest)["level"])
    cap = (F.col("source_size") * most).cast("double")
    return per.select("source", "n_docs", "source_size", F.when(F.col("_open"), F.least(F.col("_w") * F.col("_level"), cap)).otherwise(cap).alias("target"))


def balance(docs: DataFrame, targets: DataFrame, most: int = 3, steps: int = 80, tolerance: float = 1e-9) -> DataFrame:
    """(source, dual, mean) with min(most, prior * exp(dual * size / mean)) as the rate that meets each source's target.

    ``docs`` has source, size and prior; equal documents are counted once, before the iteration. ``mean`` is the mean size
    of a source's documents, which makes duals of all sources alike. Sums by source are combined before the shuffle. The
    gradient is target - sum(size * rate), the curvature sum(size * size / mean * rate) over rates below the cap. A step
    is damped to at most 1, and where it would leave the interval known to hold the solution, the interval is
    halved instead: beyond the cap the dual bends. Sources with target 0 get a null dual, that is rate 0; those
    whose target needs every document at the cap get ``FULL``.
    """
    kinds = stored(docs.where("size > 0").groupBy("source", "size", "prior").agg(F.count(F.lit(1)).alias("n")), "kinds")
    weight = F.sum(F.when(F.col("prior") > 0, F.col("size") * F.col("n")).otherwise(0))
    whole = kinds.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), weight.alias("_most")).withColumnRenamed("source", "_s")
    both = targets.join(whole, targets["source"].eqNullSafe(F.col("_s")), "left")
    full = F.col("target") >= F.col("_most") * most * (1 - 1e-12)
    dual = F.when((F.col("target") <= 0) | F.col("mean").isNull(), None).when(full, F.lit(FULL)).otherwise(0.0)
    none = F.lit(None).cast("double")
    duals = stored(both.select("source", "target", "mean", dual.alias("dual"), none.alias("low"), none.alias("high"), F.lit(1.0).alias("gap")), "duals")
    for _ in range(steps):
        at = duals.where(F.col("dual") < FULL).select(*(F.col(c).alias(f"_{c}") for c in ("source", "mean", "dual")))
        terms = kinds.join(at, kinds["source"].eqNullSafe(F.col("_source")), "inner").withColumn("_r", _rate(F.col("prior"), F.col("_dual"), F.col("size"), F.col("_mean"), most))
        given = F.col("size") * F.col("n") * F.col("_r")
        sums = terms.groupBy("_source").agg(F.sum(given).alias("_g"), F.sum(F.when(F.col("_r") < most, given * F.col("size") / F.col("_mean")).otherwise(0.0)).alias("_h"), F.lit(True).alias("_there"))
        both = duals.join(sums, duals["source"].eqNullSafe(F.col("_source")), "left")
        left = F.col("target") - F.col("_g")
        low = F.when(left > 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(left < 0, F.col("dual")).otherwise(F.col("high"))
        step = F.coalesce(F.try_divide(left, F.col("_h")), F.signum(left))
        new = F.col("dual") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step))
        inside = (F.coalesce(low, F.lit(-FULL)) < new) & (new < F.coalesce(high, F.lit(FULL)))
        moved = F.when(F.col("_there").isNull() | (left == 0), F.col("dual")).when(inside, new).otherwise((low + high) / 2)
        # Where the interval is as narrow as doubles are, there is nothing left to gain: rates jump to the cap there.
        still = F.col("_there").isNotNull() & (F.col("dual") != moved)
        gap = F.when(still, F.abs(left / F.col("target"))).otherwise(0.0)
        before, duals = duals, stored(both.select("source", "target", "mean", F.coalesce(moved, "dual").alias("dual"), low.alias("low"), high.alias("high"), gap.alias("gap")), "duals")
        discard(before)
        if duals.where(F.col("gap") > tolerance).isEmpty():
            break
    discard(kinds)
    return duals.select("source", "dual", "mean")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, prior: str | None = None, exchanges: int = 4) -> DataFrame:
    """The columns of ``docs`` with size, source_size, target, rate and copies added under the names _mix_*.

    ``docs`` needs doc_id, text and source. The size of a document is its number of words, 0 for a null
    or empty text; documents of size 0 are taken once. A null source is a source of its own, in the last
    place. Rows of equal doc_id, text and source are numbered and rounded apart by the number; which of
    them is taken more often is not stated. ``prior`` names a column of base rates (null or negative: 0), 1 without it.
    The number of copies is at most ``most``. A repeat over the same rows gives the same copies. An empty table gives no rows.
    """
    names = docs.columns
    plain = docs.toDF(*(f"_d{i}" for i in range(len(names))))
    at = {x: F.col(f"_d{next(i for i, n in enumerate(names) if n.lower() == x)}") for x in ("doc_id", "text", "source")}
    base = F.lit(1.0) if prior is None else F.greatest(F.coalesce(F.col(f"_d{names.index(prior)}").cast("double"), F.lit(0.0)), F.lit(0.0))
    mark = F.struct(F.xxhash64(at["doc_id"], at["text"], F.lit(17)).alias("h"), F.crc32(F.coalesce(at["doc_id"].cast("string"), F.lit(""))).alias("c"))
    sized = plain.select("*", at["source"].cast("string").alias("_source"), word_count(at["text"]).alias("_size"), base.alias("_prior"), mark.alias("_mark"))
    bare = lambda rows: rows.select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_prior").alias("prior"), F.col("_mark").alias("mark"))
    light = stored(bare(sized), "sizes")
    repeats = stored(light.where("size > 0").groupBy("source", "mark").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("source").alias("_rs"), F.col("mark").alias("_rm")), "repeats")
    if not repeats.isEmpty():
        of = lambda rows, source, mark, how: rows.join(repeats, F.col(source).eqNullSafe(F.col("_rs")) & (F.col(mark) == F.col("_rm")), how)
        twice = _numbered(stored(of(sized, "_source", "_mark", "left_semi"), "repeated"))
        sized = of(sized, "_source", "_mark", "left_anti").unionByName(twice)
        light = stored(of(light, "source", "mark", "left_anti").unionByName(bare(twice)), "sizes")
    targets = stored(source_targets(light, weights, most), "targets")
    duals = balance(light, targets, most)
    plan = rounding(light, stored(targets.join(duals.withColumnRenamed("source", "_s"), targets["source"].eqNullSafe(F.col("_s")), "left").drop("_s"), "rates"), most, exchanges)
    discard(light)
    plan = plan.select(*(F.col(c).alias(f"_mix_{c}") for c in plan.columns))
    joined = sized.join(plan, sized["_source"].eqNullSafe(F.col("_mix_source")), "left")
    rate = _rate(F.col("_prior"), F.col("_mix_dual"), F.col("_size"), F.col("_mix_mean"), most)
    copies = F.when(F.col("_size") == 0, F.lit(1)).otherwise(_copies(rate, F.col("_mark"), F.col("_mix_shift"), F.col("_mix_added"), F.col("_mix_removed"), most))
    return joined.select(*(F.col(f"_d{i}").alias(n) for i, n in enumerate(names)), F.col("_size").alias("_mix_size"), F.col("_mix_source_size"), F.col("_mix_target"), rate.alias("_mix_rate"), copies.cast("int").alias("_mix_copies"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of a written table, in another one, with marks that a running number of the equal rows makes different.

    Rows are numbered file by file, so that no task holds all rows of one mark.
    """
    place = ["_source", "_mark", "_file"]
    files = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_line"))
    each = files.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_source", "_mark").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    each = each.select(*(F.col(c).alias(f"_b{c}") for c in place), F.coalesce(before, F.lit(0)).alias("_before"))
    own = files.withColumn("_own", F.row_number().over(Window.partitionBy(*place).orderBy("_line")))
    same = F.col("_source").eqNullSafe(F.col("_b_source")) & (F.col("_mark") == F.col("_b_mark")) & (F.col("_file") == F.col("_b_file"))
    mark = F.struct(F.xxhash64(F.col("_mark.h"), F.col("_before") + F.col("_own")).alias("h"), F.col("_mark.c").alias("c"))
    out = own.join(each, same, "left").withColumn("_mark", mark).select(*rows.columns)
    return stored(out, "numbered")


#: The dual of a source all of whose documents are taken at the cap.
FULL = 1e9


def _rate(prior: Column, dual: Column, size: Column, mean: Column, most: int) -> Column:
    """The rate of a document; 0 without a dual. Exponents stay in the range of doubles."""
    tilt = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), dual * size / mean))
    return F.when(dual.isNull() | mean.isNull(), F.lit(0.0)).otherwise(F.least(F.lit(float(most)), prior * F.exp(tilt)))


def _unit(mark: Column) -> Column:
    """A number in [0, 1) from the document's hash."""
    return F.pmod(mark["h"], F.lit(1 << 40)) / F.lit(float(1 << 40))


def _copies(rate: Column, mark: Column, shift: Column, added: Column, removed: Column, most: int) -> Column:
    whole = F.floor(rate)
    first = whole + F.when((rate > 0) & (_unit(mark) - (rate - whole) < shift), 1).otherwise(0)
    changed = first + F.when(F.array_contains(added, mark), 1).otherwise(0) - F.when(F.array_contains(removed, mark), 1).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(most), changed))


#: Bins of the differences, from -1 to 1.
SHIFT_BINS = 4096


def _shifts(docs: DataFrame, rates: DataFrame, most: int) -> DataFrame:
    """``rates`` with the shift of each source. At most one row for each source and bin is exchanged and ordered."""
    p = rates.select(*(F.col(c).alias(f"_{c}") for c in rates.columns))
    rows = docs.where("size > 0").join(p, docs["source"].eqNullSafe(F.col("_source")), "inner")
    rows = rows.withColumn("_r", _rate(F.col("prior"), F.col("_dual"), F.col("size"), F.col("_mean"), most)).withColumn("_w", F.floor("_r"))
    over = F.floor((_unit(F.col("mark")) - (F.col("_r") - F.col("_w")) + 1) * (SHIFT_BINS / 2)).cast("long")
    free = (F.col("_r") > 0) & (F.col("_w") < most)
    bins = rows.groupBy("_source", F.when(free, over).otherwise(-1).alias("_bin")).agg(
        F.sum(F.col("size") * F.col("_w")).alias("_sure"), F.sum(F.when(free, F.col("size")).otherwise(0)).alias("_more"), F.first("_target").alias("_target")
    )
    own = Window.partitionBy("_source")
    bins = bins.withColumn("_taken", F.sum("_sure").over(own) + F.sum("_more").over(own.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)))
    edge = (F.col("_bin") + 1) / (SHIFT_BINS / 2) - 1
    best = bins.groupBy("_source").agg(F.min(F.struct(F.abs(F.col("_target") - F.col("_taken")).alias("gap"), F.abs(edge).alias("far"), edge.alias("shift"))).alias("_b"))
    best = best.select(F.col("_source").alias("_bs"), F.col("_b.shift").alias("_shift"))
    return rates.join(best, rates["source"].eqNullSafe(F.col("_bs")), "left").select(*rates.columns, F.coalesce("_shift", F.lit(0.0)).alias("shift"))


def rounding(docs: DataFrame, rates: DataFrame, most: int = 3, exchanges: int = 4) -> DataFrame:
    """``rates`` with shift, added and removed for each source: how rates become copies.

    A document gets the floor of its rate, and one copy more if its hash lies under the fraction by more than a
    threshold of its source, ``shift``, which is near 0: a histogram of the tokens over that difference shows where it
    has to be for the tokens to come nearest to the target. An exchange pass then finds, for each source, the document whose one copy more or less brings the tokens
    nearest to the target; ``exchanges`` passes choose that many documents at most. Each pass is one
    aggregate with a partial stage. What a source's row lists is bounded by ``exchanges``.
    """
    empty = F.array().cast("array<struct<h:bigint,c:bigint>>")
    plan = stored(_shifts(docs, rates, most), "plan").withColumns({"added": empty, "removed": empty})
    for _ in range(exchanges):
        p = plan.select(*(F.col(c).alias(f"_{c}") for c in plan.columns))
        rows = docs.where("size > 0").join(p, docs["source"].eqNullSafe(F.col("_source")), "inner")
        rows = rows.withColumn("_n", _copies(_rate(F.col("prior"), F.col("_dual"), F.col("size"), F.col("_mean"), most), F.col("mark"), F.col("_shift"), F.col("_added"), F.col("_removed"), most))
        free = ~F.array_contains("_added", F.col("mark")) & ~F.array_contains("_removed", F.col("mark"))
        rows = rows.withColumn("_free", free)
        taken = rows.groupBy("_source").agg(F.sum(F.col("size") * F.col("_n")).alias("_taken"))
        taken = stored(taken.select(F.col("_source").alias("_ts"), "_taken"), "taken")
        rows = rows.join(taken, F.col("_source").eqNullSafe(F.col("_ts")), "inner").withColumn("_gap", F.col("_target") - F.col("_taken"))
        more = F.col("_free") & (F.col("_n") < most) & (F.col("prior") > 0)
        less = F.col("_free") & (F.col("_n") > 0)
        choice = lambda ok, after: F.when(ok, F.struct(F.abs(after).alias("left"), F.col("mark").alias("mark")))
        best = rows.groupBy("_source").agg(
            F.min(choice(more, F.col("_gap") - F.col("size"))).alias("_plus"),
            F.min(choice(less, F.col("_gap") + F.col("size"))).alias("_minus"),
            F.first("_gap").alias("_gap"),
        )
        best = best.select(F.col("_source").alias("_bs"), "_plus", "_minus", "_gap")
        now = F.abs(F.col("_gap"))
        never = F.lit(float("inf"))
        up, down = F.coalesce(F.col("_plus.left"), never), F.coalesce(F.col("_minus.left"), never)
        joined = plan.join(best, plan["source"].eqNullSafe(F.col("_bs")), "left")
        plan = stored(
            joined.select(
                *(c for c in plan.columns if c not in ("added", "removed")),
                F.when((up <= down) & (up < now), F.concat("added", F.array("_plus.mark"))).otherwise(F.col("added")).alias("added"),
                F.when((down < up) & (down < now), F.concat("removed", F.array("_minus.mark"))).otherwise(F.col("removed")).alias("removed"),
            ),
            "plan",
        )
    return plan
