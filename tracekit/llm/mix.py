"""Mixing sources to target weights by Pareto order sampling.

Method
* Targets: sources in code point order (null last) weigh ``weights``, repeating; together they share
  ``percent`` of all words. A target stops at ``ceiling`` times its source's words and the excess is shared
  again by weight: sorted by words over weight, the sources that stop are a prefix, decided in whole numbers.
* Each document of a source has ``min(ceiling, c * weight)`` expected copies, c solved so that the expected words are the
  target. Its whole part is certain. The fraction p is its inclusion probability for one copy more.
* Pareto order sampling (Rosen): documents are ranked by the odds of a uniform number over the odds of p, and the
  first ones are taken until their words are nearest to what the whole copies leave of the target.
* The cut in this order is found by two histograms of 1,024 cells for each source, then exactly within one
  cell: no source is sorted or gathered. A cut is one row for each source, so texts are never shuffled.

The uniform number comes from the md5 of the doc_id, so reruns agree.

Defined results: null or blank texts have size 0 and never move a target; rows repeating a doc_id are
taken or left together; a null source is a source; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracekit.llm.common import count_words, settle, ship

ship(__name__)

WEIGHTS = (3, 1, 2)
CELLS = 1024
BROADCAST_SOURCES = 100_000
MAX_ROUNDS = 1000
WHOLE = 1e300
LONG_WORDS, LONG_ODDS, SHORT_ODDS = 100, 1.25, 0.75


def uniform(doc_id: str = "doc_id") -> Column:
    """A number strictly between 0 and 1, from the id."""
    key = F.concat(F.lit("mix-"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150, ceiling: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    s = (sizes.withColumn("at", F.row_number().over(by_name))
         .withColumn("w", F.element_at(cycle, ((F.col("at") - 1) % len(weights) + 1).cast("int")).cast("long"))
         .withColumn("cap", ceiling * F.col("source_size")))
    rising = Window.orderBy(F.col("source_size") / F.col("w"), "at")
    before, everything = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = (s.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
         .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("w_left", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0))))
    full = 100 * F.col("cap") * F.col("w_left") <= (percent * F.col("total") - 100 * F.col("cap_before")) * F.col("w")
    s = (s.withColumn("full", full)
         .withColumn("left", (percent * F.col("total") - 100 * F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0))) / F.lit(100.0))
         .withColumn("open_w", F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("left") / F.col("open_w"))
    return s.select("source", "source_size", target.alias("target"))


def _sent(small: DataFrame) -> DataFrame:
    """A table of one row for each source, sent to all tasks if its size allows."""
    return F.broadcast(small) if small.count() <= BROADCAST_SOURCES else small


def _by_source(rows: DataFrame, small: DataFrame) -> DataFrame:
    small = small.withColumnRenamed("source", "_source")
    return rows.join(_sent(small), rows.source.eqNullSafe(F.col("_source")), "left").drop("_source")


def _expected(ceiling: int) -> Column:
    return F.least(F.lit(float(ceiling)), F.col("_c") * F.col("_weight"))


def _ranked(rows: DataFrame, ceiling: int) -> DataFrame:
    """Adds _whole (certain copies), _p (inclusion probability) and _v: the Pareto rank, mapped to (0, 1).

    With odds q = odds(u) / odds(p), v = q * o / (1 + q * o) rises with q; o is the source's mean odds, so
    that v spreads over the whole interval (with equal p it is u itself).
    """
    e = _expected(ceiling)
    rows = rows.withColumn("_whole", F.floor(e)).withColumn("_p", e - F.floor(e))
    u, p = F.col("_u"), F.col("_p")
    v = F.when(p == F.col("_mean"), u).otherwise((q := u / (1 - u) * (1 - p) / p * F.col("_mean") / (1 - F.col("_mean"))) / (1 + q))
    return rows.withColumn("_v", F.when(p > 0, v))


def length_odds(text: str = "text") -> Column:
    """The query's relative inclusion odds: texts of ``LONG_WORDS`` words or more are favoured over shorter ones."""
    return F.when(count_words(text) >= LONG_WORDS, F.lit(LONG_ODDS)).otherwise(F.lit(SHORT_ODDS))


def _prepared(docs: DataFrame, weight: str | None) -> DataFrame:
    return docs.withColumns({"size": count_words("text"), "_u": uniform(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63)),
                             "_weight": F.col(weight).cast("double") if weight else F.lit(1.0)})


def _solve(base: DataFrame, plan: DataFrame, ceiling: int, weighted: bool) -> DataFrame:
    """Adds _c: sum of size * min(ceiling, c * weight) is the target, source by source."""
    if not weighted:
        return plan.withColumn("_c", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    # a source that is to be taken whole as often as allowed has no finite c
    plan = plan.withColumn("_c", F.when((F.col("source_size") > 0) & (F.col("target") >= ceiling * F.col("source_size")), F.lit(WHOLE)).otherwise(0.0))
    last = None
    for _ in range(MAX_ROUNDS):  # each round fixes at least one more document's copies at the ceiling
        at = F.col("_c") * F.col("_weight") >= ceiling
        sums = (_by_source(base, plan.select("source", "_c")).groupBy("source")
                .agg(F.coalesce(F.sum(F.when(at, F.col("size"))), F.lit(0)).alias("_full"),
                     F.sum(F.when(~at, F.col("size") * F.col("_weight"))).alias("_open")))
        plan = settle(_by_source(plan.drop("_c", "_full"), sums)
                      .withColumn("_c", F.when(F.col("_open") > 0, (F.col("target") - ceiling * F.col("_full")) / F.col("_open"))
                                  .otherwise(F.when(F.col("_full") > 0, F.lit(WHOLE)).otherwise(0.0))).drop("_open"))
        now = plan.agg(F.sum("_full")).first()[0]
        if now == last:
            return plan.drop("_full")
        last = now
    raise RuntimeError("expected copies did not settle")


def _cell(level: int) -> Column:
    scaled = F.col("_v") * float(CELLS ** level)
    return F.floor(scaled).cast("long")


def mix_plan(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, percent: int = 150, ceiling: int = 2,
             weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents without their texts, plan): the plan has one row for each source with its target and cut."""
    kept = ["doc_id", "source", "size", "_u", "_id", "_weight"]
    base = settle(_prepared(docs, weight).select(*kept))
    plan = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, ceiling)
    plan = settle(_solve(base, plan, ceiling, weight is not None))
    e = _expected(ceiling)
    sums = (_by_source(base, plan).groupBy("source")
            .agg(F.sum(F.floor(e) * F.col("size")).alias("_sure"), F.sum(F.when(e > F.floor(e), F.col("size"))).alias("_open"),
                 F.sum(F.when(e > F.floor(e), F.col("size") * (e - F.floor(e)))).alias("_share")))
    mean = F.when(F.lit(weight is None), F.col("_c") - F.floor("_c")).otherwise(F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("_share") / F.col("_open"))))
    plan = settle(_by_source(plan, sums).withColumn("_rest", F.col("target") - F.coalesce("_sure", F.lit(0)))
                  .withColumn("_mean", mean).drop("_sure", "_open", "_share"))
    ranked = _ranked(_by_source(base, plan), ceiling).where("_v is not null and size > 0")
    inside, before = ranked, F.lit(0).cast("long")
    plan = plan.withColumn("_before", before).withColumn("_cell", F.lit(None).cast("long"))
    for level in (1, 2):
        cells = inside.withColumn("_at", _cell(level)).groupBy("source", "_at").agg(F.sum("size").alias("n"))
        order = Window.partitionBy("source").orderBy("_at")
        cells = cells.withColumn("to", F.sum("n").over(order))
        cells = _by_source(cells, plan.select("source", "_rest", "_before"))
        cut = (cells.where(F.col("to") + F.col("_before") >= F.col("_rest")).groupBy("source")
               .agg(F.min(F.struct("_at", (F.col("to") - F.col("n") + F.col("_before")).alias("b"))).alias("x"))
               .select("source", F.col("x._at").alias("_at"), F.col("x.b").alias("_b")))
        # a source without such a cell takes all documents: its cut is beyond the last cell
        plan = settle(_by_source(plan, cut).withColumn("_cell", F.coalesce("_at", F.lit(CELLS ** level)))
                      .withColumn("_before", F.coalesce("_b", "_before")).drop("_at", "_b"))
        inside = _by_source(ranked, plan.select("source", F.col("_cell").alias("_in"))).where(_cell(level) == F.col("_in")).drop("_in")
    units = inside.groupBy("source", "_v", "_id").agg(F.sum("size").alias("n"))
    order = Window.partitionBy("source").orderBy("_v", "_id").rowsBetween(Window.unboundedPreceding, -1)
    units = _by_source(units.withColumn("b", F.coalesce(F.sum("n").over(order), F.lit(0))), plan.select("source", "_rest", "_before"))
    last = (units.where(2 * (F.col("_rest") - F.col("_before") - F.col("b")) > F.col("n")).groupBy("source")
            .agg(F.max(F.struct("_v", "_id")).alias("x")).select("source", F.col("x._v").alias("_cut_v"), F.col("x._id").alias("_cut_id")))
    return base, settle(_by_source(plan, last))


def apply_plan(rows: DataFrame, plan: DataFrame, *, ceiling: int = 2) -> DataFrame:
    """Adds source_size, target and copies to rows that have the columns of ``mix_plan``'s first table."""
    r = _ranked(_by_source(rows, plan), ceiling)
    cell = _cell(2)
    within = (F.col("_v") < F.col("_cut_v")) | ((F.col("_v") == F.col("_cut_v")) & (F.col("_id") <= F.col("_cut_id")))
    extra = F.when(F.col("_v").isNull() | (F.col("size") == 0), 0).when(cell < F.col("_cell"), 1) \
        .when((cell == F.col("_cell")) & F.coalesce(within, F.lit(False)), 1).otherwise(0)
    own = {"_u", "_id", "_weight", "_whole", "_p", "_v"} | (set(plan.columns) - {"source", "source_size", "target"})
    return r.withColumn("copies", (F.col("_whole") + extra).cast("long")).drop(*own)


def mixture(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each document."""
    base, plan = mix_plan(docs, **options)
    return apply_plan(base, plan, ceiling=options.get("ceiling", 2))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it (blank documents: their certain copies)."""
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("_row"), "doc_id", "source", "text", *([options["weight"]] if options.get("weight") else []))
    _, plan = mix_plan(rows, **options)
    taken = apply_plan(_prepared(rows, options.get("weight")).drop("text"), plan, ceiling=options.get("ceiling", 2))
    return taken.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_row.*")
