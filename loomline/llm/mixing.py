"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a fixed shuffled order (by a hash of their id),
once for each copy that the source's target asks for. A copy's virtual finish
time is the source's words up to and with it, divided by the source's target.
Over all sources, copies stand in one queue by finish time, and the mix is the part of
the queue whose words stay within the total budget. So sources fill at the same
relative rate, and a longer run of the mix starts with a shorter one.

How this stays distributed:

* Running sums within a source are taken in slices of its order of about
  ``SLICE`` rows; slice sums (pre-aggregated) give each slice its offset. A
  source with a third of all rows is many slices.
* The queue is range-partitioned by finish time. Running sums within a range and the
  sums of the ranges before it give each copy the words up to and with it, and the
  queue is truncated where these exceed the budget.
* Sorting and summing move rows of numbers. Texts move only when the mix itself is
  asked for: to their places, then into the queue's ranges, in whose order it is written.
* Shares and targets are computed over one row for each source, in one task.

Defined results: a null source is a source of its own, after the others; a null
text has size 0, takes 0 and isn't in the mix; rows of the same source and id (a
null one too) stand at one place and are taken together; an empty table gives an
empty mix. Other columns of any name pass through.
Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.llm.common import WORD, Workspace, masked, named, size_of, unmasked

SLICE = 1000
#: A source's target is at most so many times its size.
MOST_COPIES = 3
#: Positions in the shuffled order are integers below this.
ORDER = 1 << 60


def order_of(doc_id: Column, seed: str = "mix") -> Column:
    """A document's position in the shuffled order: the first 60 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """Sorts by code point with null last, and is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("z"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """Sources (_key, source_size) with their target: the total size shared by weight, none above ``most`` times its size.

    Weights repeat over the sources in order. The excess of capped sources goes to the
    others by weight until none is above: the targets are least(most * size, level * weight)
    at the level that spends the total.
    """
    ranked = sources.withColumn("_rank", F.row_number().over(W.orderBy("_key")))
    weight = F.element_at(F.lit(list(weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * most)
    by_ratio = W.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_weight").over(after)
    ranked = ranked.withColumn("_level", level).withColumn("_place", F.row_number().over(by_ratio))
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("_weight"), F.struct("_place", "_level"))
    ranked = ranked.withColumn("_at", F.min(fits).over(whole)["_level"])
    target = F.least(F.col("_cap").cast("double"), F.col("_at") * F.col("_weight"))
    return ranked.select("_key", "source_size", target.alias("target"))


class Mix:
    """The mix of a table of documents. ``placed``: a row for each document with its size, source_size, target and running sum; ``queue``: a row for each copy taken; ``last``: the last finish time taken."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix"):
        self.seed, self.space = seed, Workspace(docs.sparkSession, "mix")
        self.parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sized = self.space.table("sizes", docs.select(named(doc_id).alias("_id"), source_key(named(source)).alias("_key"), size_of(named(text)).alias("size")))
        sized = sized.withColumn("_order", order_of(F.col("_id"), seed))
        totals = sized.groupBy("_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
        goals = targets(totals.select("_key", "source_size"), weights).join(totals.select("_key", "_rows"), "_key")
        self.sources = self.space.table("sources", goals.withColumn("_slices", F.ceil(F.col("_rows") / SLICE)))
        self.budget = self.sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).head()[0]
        rows = sized.join(self.sources, "_key").withColumn("_slice", F.floor(F.col("_order") / F.lit(float(ORDER)) * F.col("_slices")))
        sums = rows.groupBy("_key", "_slice").agg(F.sum("size").alias("_sum"))
        offsets = sums.select("_key", "_slice", F.coalesce(F.sum("_sum").over(W.partitionBy("_key").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
        within = W.partitionBy("_key", "_slice").orderBy("_order").rangeBetween(W.unboundedPreceding, W.currentRow)
        placed = rows.withColumn("_run", F.sum("size").over(within)).join(offsets, ["_key", "_slice"])
        self.placed = self.space.table("placed", placed.select("_id", "_key", "_order", "size", "source_size", "target", (F.col("_offset") + F.col("_run")).alias("_run")))
        self.queue = self._queue()
        self.last = self.queue.agg(F.coalesce(F.max("_finish"), F.lit(-1.0))).head()[0]
        self.space.drop("sizes", "sources", "ranged")

    def _finishes(self) -> Column:
        """The finish times of the copies that a document's source asks for."""
        times = [(F.lit(k) * F.col("source_size") + F.col("_run")) / F.col("target") for k in range(MOST_COPIES)]
        return F.slice(F.array(*times), F.lit(1), F.ceil(F.col("target") / F.col("source_size")).cast("int"))

    def _queue(self) -> DataFrame:
        """(_key, _order, size, _finish): copies by finish time, as far as their words stay within the budget."""
        copies = self.placed.where((F.col("target") > 0) & (F.col("size") > 0)).select("_key", "_order", "size", F.explode(self._finishes()).alias("_finish"))
        ranged = copies.repartitionByRange(self.parts, "_finish").sortWithinPartitions("_finish").withColumn("_range", F.spark_partition_id())
        ranged = self.space.table("ranged", ranged)
        sums = ranged.groupBy("_range").agg(F.sum("size").alias("_sum"))  # a row for each range
        before = sums.select("_range", F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        upto = F.col("_before") + F.sum("size").over(W.partitionBy("_range").orderBy("_finish").rangeBetween(W.unboundedPreceding, W.currentRow))
        spent = ranged.join(F.broadcast(before), "_range").withColumn("_upto", upto)
        return self.space.table("queue", spent.where(F.col("_upto") <= self.budget).drop("_range", "_before", "_upto"))

    def report(self) -> DataFrame:
        """A row for each document, in the order of the queue: _id, size, source_size, target, taken (words that the mix takes, repeats counted) and finish (the first copy's finish time; null: none is taken)."""
        n = F.when((F.col("target") > 0) & (F.col("size") > 0), F.size(F.filter(self._finishes(), lambda x: x <= self.last))).otherwise(0)
        finish = F.when(n > 0, F.col("_run") / F.col("target"))
        return self.placed.select("_id", "size", "source_size", "target", (n * F.col("size")).cast("long").alias("taken"), finish.alias("finish")).orderBy(F.asc_nulls_last("finish"), "_id")

    def taken(self, docs: DataFrame, doc_id: str = "doc_id", source: str = "source", finish: str | None = None) -> DataFrame:
        """The documents of the mix, each as often as it is taken, in the order of the queue; ``finish`` names a column for the finish time."""
        docs, names = masked(docs)
        places = self.queue.groupBy("_key", "_order").agg(F.collect_set("_finish").alias("_finishes"))  # at most MOST_COPIES
        keyed = docs.withColumn("_key", source_key(F.col(names[source]))).withColumn("_order", order_of(F.col(names[doc_id]), self.seed))
        copies = keyed.join(places, ["_key", "_order"]).withColumn("_finish", F.explode("_finishes"))
        queue = copies.repartitionByRange(self.parts, "_finish", "_order").sortWithinPartitions("_finish", "_order")
        return queue.select(*unmasked(names, [finish]), *([F.col("_finish").alias(finish)] if finish else []))


#: The same rows by running sums over whole sources and over all finish times.
SQL = rf"""
with d as (
  select doc_id, coalesce('s' || source, 'z') as k, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents),
s as (
  select k, sum(size)::bigint as source_size, 1 + (row_number() over (order by k) - 1) % 3 as w, row_number() over (order by k) as rk from d group by k),
r as (
  select *, 3 * source_size as cap,
    (sum(source_size) over () - coalesce(sum(3 * source_size) over (order by (3 * source_size) / w, rk rows between unbounded preceding and 1 preceding), 0))::double
      / sum(w) over (order by (3 * source_size) / w, rk rows between current row and unbounded following) as level
  from s),
t as (
  select k, source_size, least(cap::double, (select min(level) from (select arg_min(level, (cap / w, rk)) as level from r where level <= cap / w)) * w) as target from r),
p as (
  select doc_id, size, source_size, target,
    sum(size) over (partition by k order by h range between unbounded preceding and current row)::bigint as run
  from d join t using (k)),
c as (
  select doc_id, size, (copy * source_size + run)::double / target as finish
  from p, (values (0), (1), (2)) as n(copy) where target > 0 and size > 0 and copy < ceil(target / source_size)),
l as (
  select max(finish) as last from (select finish, sum(sum(size)) over (order by finish) as spent from c group by finish)
  where spent <= (select sum(size) from d))
select p.doc_id, p.size, p.source_size, p.target,
  coalesce((select sum(c.size) from c where c.doc_id is not distinct from p.doc_id and c.finish <= (select last from l)), 0)::bigint as taken,
  case when p.size > 0 and p.target > 0 and p.run::double / p.target <= (select last from l) then p.run::double / p.target end as finish
from p
"""
