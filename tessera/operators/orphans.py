"""References to records that do not exist, as keyed state advanced batch by batch.

The state holds the versions of parents and the references seen so far. A batch of either touches
some keys; of each of these, only what lies at or after the batch's first time for it can change
(``since``). The history before is carried as one row per key, what lies after it is laid out twice
as events in the order of time, once without and once with the batch: references probe the parent
index, arriving parents resolve the references that wait, and deletions reopen them. The difference
of the two is what the batch did. So batches may cut the rows in any way and come in any order, late
rows included: what they did adds up to what one batch over everything does. In a stream in the order
of time nothing lies after ``since``, and a batch costs what it brings.

A key may be named by a third of all rows, so no key is ever handled whole: its events are split by
time bucket, and a pre-aggregated carry (one row per key and bucket, combined map-side) brings each
bucket the state at its start. The largest unit of work is one key within one bucket.

Defined results: a key that is null is no reference and no parent; a null time sorts before all
others; a null deletion mark means not deleted; repeated references count each; of parent versions
with equal times the one with the largest sequence number holds; a parent recorded at the very time
of a reference counts as there. Empty inputs give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import materialize

VERSIONS = "key bigint, ts timestamp, seq bigint, alive boolean"
REFERENCES = "ref_table string, key bigint, ts timestamp, row_id bigint"
MEASURES = ["n_refs", "n_orphans", "n_resolved", "n_reopened", "delta"]
COUNTED = "ref_table string, period string, " + ", ".join(f"{c} bigint" for c in MEASURES)
_START = "0001-01-01 00:00:00"


def parent_versions(df: DataFrame, key: Column, ts: str, seq: str, deleted: str) -> DataFrame:
    """Versions of parents: (key, ts, seq, alive), one per key and time."""
    rows = df.select(key.alias("key"), F.col(ts).alias("ts"), F.col(seq).alias("seq"), (~F.coalesce(F.col(deleted), F.lit(False))).alias("alive"))
    return _latest(rows.where("key is not null"))


def _latest(versions: DataFrame) -> DataFrame:
    return versions.groupBy("key", "ts").agg(F.max("seq").alias("seq"), F.max_by("alive", "seq").alias("alive"))


def references(df: DataFrame, ref_table: str, key: Column, ts: str, row_id: str) -> DataFrame:
    """References: (ref_table, key, ts, row_id), a row each."""
    return df.select(F.lit(ref_table).alias("ref_table"), key.alias("key"), F.col(ts).alias("ts"), F.col(row_id).alias("row_id")).where("key is not null")


@dataclass
class State:
    """What was seen so far: parents' versions, references, and how each batch changed the counts. All
    three only grow, so a stream appends each batch's own rows to what it keeps."""

    versions: DataFrame
    refs: DataFrame
    counts: DataFrame
    empty: bool = False

    def saved(self) -> State:
        """The state as written tables, so that the next batch doesn't work this one out again."""
        return State(materialize(self.versions, "versions"), materialize(self.refs, "refs"), materialize(self.counts, "counts"))


def empty_state(spark: SparkSession) -> State:
    return State(spark.createDataFrame([], VERSIONS), spark.createDataFrame([], REFERENCES), spark.createDataFrame([], COUNTED), True)


@dataclass
class Advance:
    """What a batch did. ``after`` has the events that it may have changed, each with its key's state
    just after it; ``before`` has the same events as they stood without the batch (None: there were
    none)."""

    after: DataFrame
    before: DataFrame | None
    last: State
    parents: DataFrame
    refs: DataFrame

    @property
    def state(self) -> State:
        old = self.last
        return State(old.versions.unionByName(self.parents), old.refs.unionByName(self.refs), old.counts.unionByName(self.counts()))

    @property
    def changes(self) -> DataFrame:
        """(ref_table, key, ts, row_id, reason, n): what the batch adds to the orphans (n > 0) and what it
        takes back (n < 0), repeated rows counted each. The reason of one may change without a row."""
        by, plus = ["ref_table", "key", "ts", "row_id"], _orphans(self.after).withColumn("n", F.lit(1).cast("bigint"))
        both = plus if self.before is None else plus.unionByName(_orphans(self.before).withColumns({"reason": F.lit(None).cast("string"), "n": F.lit(-1).cast("bigint")}))
        return both.groupBy(by).agg(F.max("reason").alias("reason"), F.sum("n").alias("n")).where("n <> 0").select(*by, "reason", "n")

    @property
    def orphans(self) -> DataFrame:
        """References whose parent wasn't there at their own time and that weren't reported before."""
        return _orphans(self.after) if self.before is None else reported(self.changes)

    @property
    def retracted(self) -> DataFrame:
        """References reported by an earlier batch whose parent turns out to have been there."""
        return reported(self.changes, -1)

    def counts(self, period: str = "yyyy-MM") -> DataFrame:
        """(ref_table, period, …): by how much the batch changes each period's counts. Summed over all
        batches, in any order, they are the counts of everything."""
        now = _counts(self.after, period)
        if self.before is not None:
            was = _counts(self.before, period)
            now = now.unionByName(was.select("ref_table", "period", *((-F.col(c)).alias(c) for c in MEASURES)))
            now = now.groupBy("ref_table", "period").agg(*(F.sum(c).alias(c) for c in MEASURES)).where(" or ".join(f"{c} <> 0" for c in MEASURES))
        return now

    def snapshots(self, period: str = "yyyy-MM") -> DataFrame:
        """Per table and period: references, orphans at their own time, references that arriving
        parents resolved or deletions reopened, and what is open at the period's end; over all batches
        so far, from the first period on that this batch changes."""
        mine = self.counts(period)
        if self.last.empty:
            return totals(mine)
        first = mine.groupBy("ref_table").agg(F.min("period").alias("first"))
        return totals(self.last.counts.unionByName(mine)).join(first, "ref_table").where("period >= first").drop("first")


def totals(counts: DataFrame) -> DataFrame:
    """Snapshots from the counts of any number of batches. A row per table and period, so the running
    sum per table is over few rows."""
    per = counts.groupBy("ref_table", "period").agg(*(F.sum(c).alias(c) for c in MEASURES))
    w = Window.partitionBy("ref_table").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("ref_table", "period", *MEASURES[:4], F.sum("delta").over(w).alias("n_open"))


def _orphans(events: DataFrame) -> DataFrame:
    why = F.when(F.col("alive_now").isNull(), "unrecorded").otherwise("deleted")
    return events.where("kind = 1 and not coalesce(alive_now, false)").select("ref_table", "key", "ts", "row_id", why.alias("reason"))


def reported(changes: DataFrame, sign: int = 1) -> DataFrame:
    """The rows of :attr:`Advance.changes` that are added, or with a sign of -1 taken back, one each."""
    rows = changes.where(F.col("n") * sign > 0)
    return rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.abs("n").cast("int")))).drop("n")


def _counts(events: DataFrame, period: str) -> DataFrame:
    was, now = F.coalesce("alive_before", F.lit(False)), F.coalesce("alive_now", F.lit(False))
    delta = F.when(F.col("kind") == 1, (~now).cast("long")).when(was & ~now, F.col("n_now")).when(~was & now, -F.col("n_now")).otherwise(0)
    return (
        events.where("kind >= 0")
        .groupBy("ref_table", F.date_format("ts", period).alias("period"))
        .agg(
            F.sum((F.col("kind") == 1).cast("long")).alias("n_refs"),
            F.sum(((F.col("kind") == 1) & ~now).cast("long")).alias("n_orphans"),
            F.sum(F.when((F.col("kind") == 0) & ~was & now, F.col("n_now")).otherwise(0)).alias("n_resolved"),
            F.sum(F.when((F.col("kind") == 0) & was & ~now, F.col("n_now")).otherwise(0)).alias("n_reopened"),
            F.sum(delta).alias("delta"),
        )
    )


def _time(c: str = "ts") -> Column:
    return F.coalesce(c, F.lit(_START).cast("timestamp"))


def _events(parents: DataFrame, refs: DataFrame, carry: DataFrame | None, ref_tables: list[str], bucket: str) -> DataFrame:
    """Every event with its key's state just before and after it. ``carry(ref_table, key, alive, n)``
    is the state that keys start from."""
    tables = F.explode(F.array(*map(F.lit, ref_tables)))
    at = F.coalesce(F.date_trunc(bucket, "ts"), F.lit(_START).cast("timestamp")).alias("bucket")
    cols = ["ref_table", "key", at, "ts", "seq", "alive"]
    stream = parents.select(tables.alias("ref_table"), "key", "ts", "seq", "alive").select(*cols, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n")).unionByName(
        refs.select("ref_table", "key", "ts", F.col("row_id").alias("seq"), F.lit(None).cast("boolean").alias("alive")).select(*cols, F.lit(1).alias("kind"), F.lit(1).cast("long").alias("n"))
    )
    version = F.when(F.col("kind") == 0, F.struct(_time().alias("t"), "seq", "alive"))
    # One row per key and bucket: map-side combined, so a hot key shrinks to its number of buckets.
    per = stream.groupBy("ref_table", "key", "bucket").agg(F.max(version).alias("v"), F.sum("n").alias("n"))
    first = F.lit(_START).cast("timestamp") - F.expr("interval 1 day")
    if carry is not None:
        known = F.when(F.col("alive").isNotNull(), F.struct(first.alias("t"), F.lit(-1).cast("bigint").alias("seq"), F.col("alive")))
        per = per.unionByName(carry.select("ref_table", "key", first.alias("bucket"), known.alias("v"), "n"))
    upto = Window.partitionBy("ref_table", "key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begin = per.select("ref_table", "key", "bucket", F.max("v").over(upto).alias("v"), F.sum("n").over(upto).alias("n")).where("n is not null")
    begin = begin.select("ref_table", "key", "bucket", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("bigint").alias("seq"), F.col("v.alive").alias("alive"), F.lit(-1).alias("kind"), "n")
    # Events of equal times: parents first, so that a reference sees a parent of its own moment.
    w = Window.partitionBy("ref_table", "key", "bucket").orderBy(F.expr("if(kind = -1, 0, 1)"), F.col("ts").asc_nulls_first(), "kind", "seq")
    now, until = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    return stream.unionByName(begin).select(
        "ref_table", "key", "ts", F.when(F.col("kind") == 1, F.col("seq")).alias("row_id"), "kind",
        F.last("alive", True).over(now).alias("alive_now"), F.last("alive", True).over(until).alias("alive_before"), F.sum("n").over(now).alias("n_now"),
    )


def advance(state: State, parents: DataFrame, refs: DataFrame, ref_tables: list[str], bucket: str = "day") -> Advance:
    """Bring ``state`` forward by one batch of rows, of any times; of ``parents`` one row per key and
    time, as :func:`parent_versions` gives them."""
    parents = parents.select("key", "ts", "seq", "alive").where("key is not null")
    refs = refs.select("ref_table", "key", "ts", "row_id").where("key is not null")
    if state.empty:
        return Advance(_events(parents, refs, None, ref_tables, bucket), None, state, parents, refs)
    since = parents.select("key", _time().alias("t")).unionByName(refs.select("key", _time().alias("t"))).groupBy("key").agg(F.min("t").alias("since"))
    held_v, held_r = state.versions.join(since, "key"), state.refs.join(since, "key")
    early, late = _time() < F.col("since"), _time() >= F.col("since")
    # What lies before: the last version and the number of references of each touched key.
    tables = F.explode(F.array(*map(F.lit, ref_tables)))
    version = F.struct(_time().alias("t"), "seq", "alive")
    last = held_v.where(early).groupBy("key").agg(F.max(version).alias("v")).select(tables.alias("ref_table"), "key", F.col("v.alive").alias("alive"), F.lit(0).cast("long").alias("n"))
    seen = held_r.where(early).groupBy("ref_table", "key").agg(F.count("*").alias("n")).select("ref_table", "key", F.lit(None).cast("boolean").alias("alive"), "n")
    carry = last.unionByName(seen).groupBy("ref_table", "key").agg(F.max("alive").alias("alive"), F.sum("n").alias("n"))
    old_v, old_r = held_v.where(late).drop("since"), held_r.where(late).drop("since")
    before = _events(_latest(old_v), old_r, carry, ref_tables, bucket)
    after = _events(_latest(old_v.unionByName(parents)), old_r.unionByName(refs), carry, ref_tables, bucket)
    return Advance(after, before, state, parents, refs)


def find_orphans(parents: DataFrame, refs: Mapping[str, DataFrame], bucket: str = "day") -> Advance:
    """All of ``parents`` and ``refs`` as one batch from the empty state."""
    frames = list(refs.values())
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f)
    return advance(empty_state(both.sparkSession), parents, both, list(refs), bucket)
