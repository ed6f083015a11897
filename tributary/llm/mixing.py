"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tributary.llm.common import ROW, cut, documents, keep, maybe_broadcast, numbered, renamed, scope

#: A word: anything but space and the five ASCII controls that separate lines and columns.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, cap: float = 3.0, rounds: int = 1000) -> DataFrame:
    """sources (source, source_size, weight) and each one's target.

    The targets share the sum of all sizes by weight, but stop at cap times the source's size; the excess is reshared
    by weight among the others until none is above its cap. A weight that is null, negative or not a number counts as
    0. Where no weight is left, the rest stays undealt. Every round reads sums of the table, whatever its length.
    """
    w = F.col("weight").cast("double")
    base = cut(sources.withColumn("weight", F.when(w > 0, F.when(F.isnan(w), 0.0).otherwise(w)).otherwise(0.0)).withColumn("limit", F.lit(cap) * F.col("source_size")))
    total = base.agg(F.sum("source_size")).first()[0] or 0
    level, target = None, None
    for _ in range(rounds):
        # Above the level a source is at its cap; the rest shares what the capped ones leave.
        capped = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("limit")
        held, weights, n = base.agg(F.coalesce(F.sum(F.when(capped, F.col("limit"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)), F.coalesce(F.sum(capped.cast("int")), F.lit(0))).first()
        if target is not None and n == was:
            break
        was = n
        level = (total - held) / weights if weights else 0.0
        target = F.when(capped, F.col("limit")).otherwise(F.col("weight") * F.lit(level))
    out = base.withColumn("target", F.least(target, F.col("limit")))
    return out.select("source", "source_size", "weight", "target")


def ranked_weights(sources: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), parts: int = 16) -> DataFrame:
    """sources (source, ...) with a weight: by code point, null last, the weights of cycle, repeating.

    The rank is counted in ranges, so no task sorts all sources.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranged = cut(sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())
    before, base = 0, []
    for part, n in sizes:
        base.append((part, before))
        before += n
    offsets = F.create_map(*[F.lit(x) for pair in base for x in pair]) if base else F.create_map(F.lit(0), F.lit(0))
    rank = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1 + offsets[F.col("part")]
    weights = F.array(*[F.lit(float(x)) for x in cycle])
    return ranged.withColumn("weight", F.element_at(weights, (rank % len(cycle) + 1).cast("int"))).drop("part")


def _place(id: Column, text: Column, seed: int) -> Column:
    """What a source's rows are ordered by."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), id.cast("string"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))


def _stops(thin: DataFrame, weights: DataFrame | None, cap: float, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Of thin (__row, source, size, h): (of, source_size, target, whole, extra, last) of each source, and the rows with
    the hash last that are taken once more; of the others those with a smaller one are."""
    sized = cut(thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    if weights is None:
        weighted = ranked_weights(sized.drop("n"))
    else:
        weighted = sized.drop("n").alias("s").join(weights.select(F.col("source").alias("of"), "weight").alias("w"), F.expr("s.source <=> w.of"), "left").select("s.source", "source_size", "weight")
    filled = cut(water_fill(weighted, cap))
    # r's fraction is the share of the source's words that is taken once more.
    r = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(0.0)
    plan = sized.select(F.col("source").alias("of"), "n").join(filled, F.expr("of <=> source")).select("of", "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("n") / bucket)).cast("long").alias("buckets"), F.floor(r).alias("whole"))
    plan = cut(plan.withColumn("extra", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))))
    n = plan.count()
    joined = lambda rows, to: rows.join(maybe_broadcast(to, n), F.expr("source <=> of")).drop("of")
    reach = lambda by: F.coalesce(F.sum("words").over(W.partitionBy("of").orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("before")
    place = F.shiftright(F.conv(F.substring("h", 1, 7), 16, 10).cast("long") * F.col("buckets"), 28)  # by the hash's leading 28 bits
    sums = joined(thin, plan.select("of", "buckets", "extra")).groupBy(F.col("source").alias("of"), place.alias("bucket"), "buckets", "extra").agg(F.sum("size").alias("words"))
    # The first bucket that reaches the fraction, then in it the first hash.
    first = lambda sums, by: sums.select("*", reach(by)).where("before + words >= extra").groupBy("of").agg(F.min(F.struct(by, "before")).alias("x"))
    bucket_of = first(sums, "bucket").select("of", F.col("x.bucket").alias("bucket"), F.col("x.before").alias("start"))
    stop = cut(plan.select("of", "buckets", "extra").alias("p").join(bucket_of.alias("b"), F.expr("p.of <=> b.of")).select("p.of", "buckets", "extra", "bucket", "start"))
    inside = joined(thin, stop).where(place == F.col("bucket")).groupBy(F.col("source").alias("of"), "h", "extra", "start").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("times"))
    inside = inside.select("of", "h", "extra", "words", "times", (F.col("start") + reach("h")).alias("before"))
    last = inside.where("before + words >= extra").groupBy("of").agg(F.min(F.struct("h", "before", "words", "times", "extra")).alias("x")).select("of", "x.*")
    # A row is taken once more if more than half of it lies below the fraction; so many of the equal ones do.
    size, near = F.expr("words / times"), F.expr("floor((extra - before) / nullif(words / times, 0) + 0.5)")
    below = lambda k: F.col("before") + size * k - size / 2.0 < F.col("extra")
    count = F.when(F.col("words") == 0, 0).when(below(near + 1), near + 1).when(below(near), near).otherwise(near - 1)
    last = cut(last.select("of", F.col("h").alias("last"), F.least(F.greatest(count, F.lit(0)), F.col("times")).cast("long").alias("more")))
    ties = joined(thin.select(ROW, "source", "h"), last).where("h = last").withColumn("part", F.shiftright(ROW, 33))
    ahead = ties.groupBy(F.col("source").alias("of"), "part").agg(F.count(F.lit(1)).alias("words"))
    ahead = ahead.select("of", F.col("part").alias("in"), reach("part"))
    number = F.row_number().over(W.partitionBy("source", "part").orderBy(ROW)) + F.col("before")
    chosen = keep(cut(ties.join(ahead, F.expr("source <=> of and part = `in`")).select(ROW, number.alias("number"), "more").where("number <= more").select(F.col(ROW).alias("chosen"))))
    whole = plan.select("of", "source_size", "target", "whole", "extra").alias("p").join(last.alias("l"), F.expr("p.of <=> l.of"), "left").select("p.*", "last")
    return keep(cut(whole)), chosen


def _copies(frame: DataFrame, plan: DataFrame, chosen: DataFrame, cap: float) -> DataFrame:
    """frame (__row, source, h, ...) with source_size, target and copies."""
    out = frame.join(maybe_broadcast(plan, plan.count()), F.expr("source <=> of")).drop("of")
    out = out.join(maybe_broadcast(chosen, chosen.count()), F.col(ROW) == F.col("chosen"), "left")
    # A source without a last row is taken whole: its fraction is more than all its words.
    more = F.when(F.col("last").isNull(), F.col("extra") > 0).otherwise((F.col("h") < F.col("last")) | F.col("chosen").isNotNull()) & (F.col("whole") < cap)
    return out.withColumn("copies", (F.col("whole") + F.when(more, 1).otherwise(0)).cast("long")).drop("whole", "extra", "last", "chosen")


def mix(df: DataFrame, weights: DataFrame | None = None, source: str = "source", text: str = "text", id: str = "doc_id", cap: float = 3.0, seed: int = 42, bucket: int = 4096) -> DataFrame:
    """(__row, id, source, size, source_size, target, copies) of each row; copies is how often the mix takes it.

    size counts the text's words (null: 0). weights is a table (source, weight), or None: then sources by code point,
    null last, weigh 1, 2, 3, repeating. A source that the table lacks has weight 0. Targets come from water_fill().
    Of a source with target = r * size, every row is taken floor(r) times, and rows in the order of a seeded hash of
    their id and text once more until the fraction is reached, so the words taken miss the target by less than a row.

    Where a source's order stops is found in two steps: sums by the hash's leading bits say in which bucket of about
    bucket different rows, and that bucket's sums by the whole hash say at which hash. Only sums are shuffled, so neither
    a hot source nor a hot row is anybody's lot. Rows with that hash are equal in id and text; as many of them as are
    still wanted are taken, numbered within each of their partitions. Reruns agree up to that choice among equal rows. A
    null source is a source, null ids and repeated rows are as good as others; an empty table gives an empty result.
    Other columns are ignored, whatever their names. df is a stored table, read alike each time.
    """
    doc = df.select(F.monotonically_increasing_id().alias(ROW), df[id].alias("id"), df[source].cast("string").alias("source"), word_count(df[text].cast("string")).alias("size"), _place(df[id], df[text], seed).alias("h"))
    with scope():
        thin = keep(cut(doc))
        plan, chosen = _stops(thin, weights, cap, bucket)
    return _copies(thin, plan, chosen, cap).select(ROW, "id", "source", "size", "source_size", "target", "copies")


def mixed(df: DataFrame, weights: DataFrame | None = None, source: str = "source", text: str = "text", id: str = "doc_id", cap: float = 3.0, seed: int = 42, bucket: int = 4096) -> DataFrame:
    """The mix itself: the rows of df, a stored table, with all their columns, as often as mix() takes them.

    Rows that the mix takes no time are left out; null and empty texts have size 0, and are taken as often as the whole
    part of their source's rate says. Null ids, repeated rows, long texts and extra columns of any name are as in mix();
    an empty table gives an empty result. Texts aren't shuffled unless there are too many sources to broadcast.
    """
    size = word_count(df[text].cast("string"))
    with scope():
        thin = cut(df.select(F.monotonically_increasing_id().alias(ROW), df[source].cast("string").alias("source"), size.alias("size"), _place(df[id], df[text], seed).alias("h")))
        plan, chosen = _stops(thin, weights, cap, bucket)
    at = {c: F.col(f"c{df.columns.index(c)}") for c in (id, source, text)}
    frame = numbered(df).withColumn("source", at[source].cast("string")).withColumn("h", _place(at[id], at[text], seed))
    out = _copies(frame, plan, chosen, cap).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return renamed(out, df)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by sources that weigh 1, 2, 3 in turn, at most three times each."""
    out = mix(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


#: The same mix: sources are capped in order of their limit for a weight, until one isn't above its limit.
SQL = f"""with docs as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size, md5(concat_ws(':', '42', doc_id, md5(coalesce(text, '')))) as h from documents),
sized as (select source, sum(size)::bigint as source_size from docs group by source),
ranked as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as weight, 3.0::double * source_size as cap from sized),
levels as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level, row_number() over (order by cap / weight, source nulls last) as n from ranked),
last as (select min_by(level, n) as level from levels where weight * level <= cap),
filled as (select source, source_size, least(cap, case when weight * (select level from last) > cap then cap else weight * (select level from last) end) as target from ranked),
rates as (select *, case when source_size > 0 then floor(least(target / source_size, 3.0)) else 0 end::bigint as whole from filled),
upto as (select d.*, r.source_size, r.target, r.whole, sum(size) over (partition by d.source order by h rows unbounded preceding) as upto from docs d join rates r on d.source is not distinct from r.source)
select doc_id, size, source_size, target, copies * size as taken, copies from (select *, whole + case when upto - size / 2.0 < greatest(0.0, target - whole * source_size) and whole < 3 then 1 else 0 end as copies from upto)"""
