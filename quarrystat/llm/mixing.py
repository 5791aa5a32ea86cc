"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue in a shuffled order, as often as their source may repeat. A copy's virtual finish time is
the tokens its source has sent up to and with it, over the source's target. The copies of all sources are ranged by
finish time, and the mix is cut where the running total reaches the budget. A running total over a whole source, or
over the mix, would put all rows in one task; totals are therefore taken by slices first: of a hash for a source, and
for the mix by ranges of time, coarse ones and then the fine ones of that in which the budget ends. Only the rows of a
slice, and of the last fine range, are ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrystat.llm.common import settle, text_or_empty, words_of

#: Rows of a slice, about.
SLICE = 2_000
#: Slices whose sums are ordered together.
GROUP = 2_000
#: Coarse ranges of a unit of virtual time, and fine ones of a coarse; powers of two, so times are cut without rounding.
COARSE, FINE = 1 << 10, 1 << 12


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target (double) from rows of source and source_size, one for each source.

    Sources by code point, null last, get the weights in turn. The budget is ``share`` times all sizes. Targets stop
    at ``most`` times the source's size, and what is over goes to the others by weight: with sources in the order in
    which they reach their limit (limit over weight), all before the first that can take its share of what is left
    are at their limit. Runs over a row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    rows = rows.withColumn("limit", F.lit(most) * F.col("source_size")).withColumn("turn", F.col("limit") / F.col("w"))
    by_turn = Window.orderBy("turn", F.col("source").asc_nulls_last())
    before, after = by_turn.rowsBetween(Window.unboundedPreceding, -1), by_turn.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after)
    rows = rows.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("turn"), F.col("level"))).over(Window.partitionBy()))
    return rows.select("source", "source_size", F.round(F.least(F.col("limit"), F.coalesce("level", F.lit(float("inf"))) * F.col("w")), 6).alias("target"))


def sliced_total(rows: DataFrame, keys: list[str], slice_: str, order: list[Column], value: str, name: str) -> DataFrame:
    """``rows`` with the running total of ``value`` within ``keys``, by slice and then by ``order``; slices have few rows."""
    named = {k: f"_{k}" for k in [*keys, slice_]}
    sums = rows.groupBy(*[F.col(k).alias(n) for k, n in named.items()]).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*[named[k] for k in keys], "_group").orderBy(named[slice_]).rowsBetween(Window.unboundedPreceding, -1)
    # slices in groups of GROUP, so that no window holds more than the groups or the slices of one
    sums = sums.withColumn("_group", F.floor(F.col(named[slice_]) / GROUP))
    groups = sums.groupBy(*[named[k] for k in keys], "_group").agg(F.sum("_sum").alias("_all"))
    of_groups = Window.partitionBy(*[named[k] for k in keys]).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*[F.col(named[k]).alias(f"_{named[k]}") for k in keys], F.col("_group").alias("__group"), F.coalesce(F.sum("_all").over(of_groups), F.lit(0)).alias("_before"))
    sums = sums.join(groups, [F.col(named[k]).eqNullSafe(F.col(f"_{named[k]}")) for k in keys] + [F.col("_group") == F.col("__group")])
    start = sums.select(*named.values(), (F.col("_before") + F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).alias("_start"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()]
    joined = rows.join(start, same).drop(*named.values())
    within = Window.partitionBy(*keys, slice_).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(name, F.col("_start") + F.sum(value).over(within)).drop("_start")


def placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> tuple[list[Column], Column]:
    """The columns that mixing reads (doc_id, source, size, place, tie), and the order within a source as a struct."""
    text = text_or_empty(text_col)
    columns = [
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.size(words_of(text)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("place"),
        F.xxhash64(text).alias("tie"),
    ]
    return columns, F.struct("place", "doc_id", "tie", "size")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: int = 0,
) -> DataFrame:
    """doc_id, size, source, source_size (long), target (double), copies (int), taken (long), finish (double: the virtual
    finish time of the first copy), place (struct: the order within the source), a row for each row of ``docs``.

    The budget is ``share`` (or ``most``, if less) times all sizes. Every source reaches its target at time 1, so the
    cut lies near it; a copy is taken if at least half of it lies before the budget's end, and a source misses its
    target by about a document. Null texts have size 0, and documents of size 0 are taken like others, with 0 words. A null
    source is a source of its own. Ties in the shuffled order go by id, then by text; rows alike in both may stand in
    either order. Empty tables give no rows. Reruns agree: the order is a hash of seed and id.
    """
    columns, order = placed(docs, id_col, text_col, source_col, seed)
    read = settle(docs.select(*columns))
    sources = read.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    aims = targets(sources.select("source", "source_size"), weights=weights, share=share, most=most)
    counts = sources.select(F.col("source").alias("_s"), F.greatest(F.lit(1), F.ceil(F.col("n") / SLICE)).alias("slices"))
    aims = settle(aims.join(counts, aims["source"].eqNullSafe(counts["_s"])).drop("_s").withColumnRenamed("source", "_source"))
    rows = read.join(aims, read["source"].eqNullSafe(aims["_source"])).drop("_source")
    # the first 8 hexadecimal digits of the place, scaled to the source's slices
    rows = rows.withColumn("slice", (F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.col("slices") / F.lit(1 << 32)).cast("long"))
    rows = sliced_total(rows, ["source"], "slice", [order], "size", "sent")
    rows = settle(rows.select("doc_id", "source", "size", "source_size", "target", "sent", order.alias("place")), read, aims)
    time = lambda c: F.when(F.col("target") > 0, (F.col("sent") + F.lit(c) * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))
    queue = rows.select("source", "size", "place", F.posexplode(F.array(*[time(c) for c in range(most)])).alias("copy", "time"))
    end = cut(queue.select(F.struct("time", F.col("source").isNull().alias("void"), "source", "place", "copy").alias("at"), "size"), min(share, most))
    if end is None:
        copies = F.lit(0)
    else:
        at = lambda c: F.struct(time(c).alias("time"), F.col("source").isNull().alias("void"), "source", "place", F.lit(c).alias("copy"))
        copies = sum(F.when(at(c) <= end, 1).otherwise(0) for c in range(most))
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), time(0).alias("finish"), "place")


def cut(queue: DataFrame, share: float) -> Column | None:
    """The last place of a queue (at: struct that starts with time; size) that the budget reaches, as a literal; None if
    the queue is empty. The queue holds the copies of all documents, and the budget is ``share`` times the sizes of the
    first copies. By powers of two the fine ranges of time nest in the coarse ones."""
    coarse, fine = F.floor(F.col("at.time") * COARSE), F.floor(F.col("at.time") * (COARSE * FINE))
    total = queue.agg(F.sum(F.when(F.col("at.copy") == 0, F.col("size")))).first()[0]
    if total is None:
        return None
    if not total:  # nothing has a size, so all is taken
        return literal(queue.agg(F.max("at").alias("at")).first()["at"], queue.schema["at"].dataType)
    budget, before, part = share * total, 0, queue
    for ranges in (coarse, fine):
        # the coarse ranges up to time 1 and a last one for what is later: the budget ends at about 1
        late = COARSE * 2 if ranges is coarse else None
        step = F.least(ranges, F.lit(late)) if late else ranges
        sums = {r["step"]: r["size"] for r in part.groupBy(step.alias("step")).agg(F.sum("size").alias("size")).collect()}
        last = max(sums)
        for k in sorted(sums):
            if before + sums[k] > budget:
                last = k
                break
            before += sums[k] if k != last else 0
        part = part.where(step == last)
    running = F.sum("size").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    inside = part.withColumn("reached", F.lit(before) + running - F.col("size") / 2 <= budget).where("reached").agg(F.max("at").alias("at")).first()["at"]
    if inside is None:  # the budget ends with the range before
        inside = queue.where(fine < last).agg(F.max("at").alias("at")).first()["at"]
    return literal(inside, queue.schema["at"].dataType)


def literal(value, kind: StructType) -> Column:
    """A row as a literal struct."""
    if value is None:
        return F.lit(None).cast(kind)
    return F.struct(*[(literal(value[f.name], f.dataType) if isinstance(f.dataType, StructType) else F.lit(value[f.name]).cast(f.dataType)).alias(f.name) for f in kind])


def taken(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 2, seed: int = 0, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them; see ``mix``. In a source's order the copies
    taken only fall, so the last place for each number of copies says it all, and the texts need no shuffle: what is
    joined to them is a row for each source. Rows alike in id, text and source are taken alike."""
    mixed = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, most=most, seed=seed, **options)
    cuts = settle(mixed.groupBy(F.col("source").alias("_cut_source")).agg(*[F.max(F.when(F.col("copies") > c, F.col("place"))).alias(f"_cut_{c}") for c in range(most)]))
    columns, order = placed(docs, id_col, text_col, source_col, seed)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *columns).select("_row", "source", order.alias("place"))
    joined = keyed.join(cuts, F.col("source").eqNullSafe(F.col("_cut_source")))
    copies = sum(F.when(F.col("place") <= F.col(f"_cut_{c}"), 1).otherwise(0) for c in range(most))
    return joined.select("_row", copies.alias("copies")).where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def in_order(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each copy taken (doc_id, source, size, copy, time), range-sorted by virtual finish time."""
    copies = mixed.where("copies > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    time = F.col("finish") + F.when(F.col("target") > 0, F.col("copy") * F.col("source_size") / F.col("target")).otherwise(F.lit(0.0))
    return copies.select("doc_id", "source", "size", "copy", time.alias("time")).orderBy("time", "source", "doc_id", "copy")
