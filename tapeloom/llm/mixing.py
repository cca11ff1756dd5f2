"""Entropy balancing: mix sources to target token shares with exponentially tilted document rates.

For every source the rates r = min(cap, exp(lambda * size / largest size)) minimise the relative entropy to
"every document once" under the token constraint sum(r * size) = target; lambda is the dual variable, found by
safeguarded Newton steps that run for all sources together as one grouped aggregation per step.  Rates become
copies by systematic rounding over sizes in descending order, so that a source misses its target by at most
about half its largest document.  Native DataFrame code only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, ordered_index, stored, sub_groups, table

SOURCE = ["_none", "_source"]


def capped_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """sizes: one row per source with total.  Adds target: shares by weight of the whole total, none above
    cap times the source's own total, what is over shared again by weight."""
    rows = stored(ordered_index(sizes, SOURCE, "_rank").withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))))
    first = rows.agg(F.sum("total").alias("t"), F.sum("_w").alias("w")).first()
    total, level, held = first["t"] or 0, None, -1
    level = total / first["w"] if first["w"] else 0.0
    while True:
        full = F.col("total") * cap <= F.col("_w") * level
        got = rows.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("total") * cap)).alias("t"), F.sum(F.when(~full, F.col("_w"))).alias("w")).first()
        if got["n"] == held or not got["w"]:
            break
        held, level = got["n"], (total - (got["t"] or 0.0)) / got["w"]
    return rows.withColumn("target", F.least(F.col("total") * cap, F.col("_w") * level).cast("double")).drop("_rank", "_w")


def newton(hist: DataFrame, state: DataFrame, cap: float, steps: int = 60, close: float = 1e-9) -> DataFrame:
    """hist: source, size, n.  state: source, total, largest, target.  Returns state with lam, the dual solution."""
    state = state.select(*SOURCE, "total", "largest", "target", F.lit(0.0).alias("lam"), F.lit(-1e7).alias("lo"), F.lit(1e7).alias("hi"))
    easy = (F.col("total") == 0) | (F.col("target") >= F.col("total") * cap * (1 - 1e-12))
    state = state.withColumns({"lam": F.when(easy & (F.col("total") > 0), F.lit(1e7)).otherwise(F.col("lam")), "done": easy}).checkpoint()
    part = F.col("size") / F.col("largest")
    rate = F.exp(F.least(F.col("lam") * part, F.lit(50.0)))
    words = F.col("n") * F.col("size")
    for _ in range(steps):
        sums = hist.join(state.where(~F.col("done")), SOURCE).groupBy(*SOURCE).agg(F.sum(words * F.least(rate, F.lit(cap))).alias("g"), F.sum(F.when(rate < cap, words * part * rate).otherwise(0.0)).alias("h"))
        both = state.join(sums, SOURCE, "left")
        high = F.col("g") > F.col("target")
        both = both.withColumns({"hi": F.when(high, F.col("lam")).otherwise(F.col("hi")), "lo": F.when(high, F.col("lo")).when(F.col("g").isNotNull(), F.col("lam")).otherwise(F.col("lo"))})
        step = F.col("lam") - F.try_divide(F.col("g") * F.ln(F.col("g") / F.col("target")), F.col("h"))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        miss = F.abs(F.col("g") / F.col("target") - 1) <= close
        stuck = F.col("hi") - F.col("lo") <= F.abs(F.col("lam")) * 1e-14
        done = F.col("done") | F.coalesce(miss | stuck, F.lit(True))
        state = both.withColumns({"done": done, "lam": F.when(done, F.col("lam")).when(F.coalesce(inside, F.lit(False)), step).otherwise((F.col("lo") + F.col("hi")) / 2)}).drop("g", "h").checkpoint()
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select(*SOURCE, "lam", "largest")


def _last_word(plan: DataFrame, cap: float) -> DataFrame:
    """One document more or less per source, of the size that best closes what rounding left open."""
    left = plan.groupBy(*SOURCE).agg((F.first("target") - F.sum(F.col("size") * (F.col("n") * F.col("whole") + F.col("_extra")))).alias("_left"))
    more = (F.col("_left") > 0) & (F.col("_extra") < F.col("n")) & (F.col("whole") + 1 <= cap)
    less = (F.col("_left") < 0) & (F.col("_extra") > 0)
    gain = F.abs("_left") - F.abs(F.abs("_left") - F.col("size"))
    best = plan.join(left, SOURCE).where((more | less) & (gain > 0)).groupBy(*SOURCE).agg(F.max_by(F.struct("size", F.signum("_left").cast("long").alias("_fix")), F.struct(gain, F.col("size"))).alias("b"))
    return best.select(*SOURCE, "b.size", "b._fix")


def entropy_mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """Mix documents to target token shares of their sources.

    Size: words of the text (null: 0).  Sources rank by code point, null last, and take *weights* in turn.
    Returns doc_id, size, source_size, target, taken, copies, rate, and the columns *carry* of docs.  Same input and seed: same result.  A
    source without words gets target 0; its documents are taken once, with no words.  Rows of equal size in a
    source tie for the last copies by keyed hash of doc_id and text, then of doc_id, then by *carry*.  Texts count whole.  Columns of *carry* must
    not be named _source, _none, _text or as a column returned.  Empty table: empty result.
    """
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    rows = stored(docs.select("doc_id", F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), size.alias("size"), F.xxhash64("text").alias("_text"), *carry))
    hist = stored(rows.groupBy(*SOURCE, "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = hist.groupBy(*SOURCE).agg(F.sum(F.col("n") * F.col("size")).alias("total"), F.greatest(F.max("size"), F.lit(1)).alias("largest"))
    targets = stored(capped_targets(sizes, weights, cap))
    duals = newton(hist, targets, cap)

    descending = Window.partitionBy(*SOURCE).orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rate = F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("largest"), F.lit(50.0))), F.lit(cap))
    plan = hist.join(duals, SOURCE).withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("long"))
    plan = plan.withColumn("_run", F.sum(F.col("n") * (F.col("rate") - F.col("whole"))).over(descending))
    plan = plan.withColumn("_extra", F.floor(F.col("_run") + 0.5) - F.floor(F.col("_run") - F.col("n") * (F.col("rate") - F.col("whole")) + 0.5))
    plan = stored(plan.join(targets.select(*SOURCE, F.col("total").alias("source_size"), "target"), SOURCE))
    plan = plan.join(_last_word(plan, cap), [*SOURCE, "size"], "left").withColumn("_extra", F.col("_extra") + F.coalesce("_fix", F.lit(0))).drop("_fix")

    key = F.xxhash64(F.lit(seed), "doc_id")
    parts = sub_groups(rows.count(), 1, least=16)
    salted = rows.withColumn("_key", key).withColumn("_sub", F.pmod(F.xxhash64("_key", "_text"), F.lit(parts)).cast("int"))  # the text parts rows of one id, or of none
    group = [*SOURCE, "size"]
    before = Window.partitionBy(*group).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    subs = salted.groupBy(*group, "_sub").agg(F.count(F.lit(1)).alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    subs = subs.join(plan.drop("n"), group)
    place = F.row_number().over(Window.partitionBy(*group, "_sub").orderBy("_key", "doc_id", *carry)) + F.col("_before")
    out = salted.join(subs, [*group, "_sub"]).withColumn("copies", F.col("whole") + (place <= F.col("_extra")).cast("long"))
    return out.select("doc_id", "size", F.col("source_size").cast("long"), "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate", *carry)


def op6_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; nulls, empty and long texts, ties and repeats as in entropy_mix()."""
    return entropy_mix(table(spark, sf_dir, "documents"))
