"""Parent-child rows to full hierarchies by tree contraction.

Each round removes every leaf (rake) and an independent set of nodes with a single child (compress:
those that draw a larger number than both neighbours; the child takes over the removed node's
pointer and remembers whom it passes). The number of rounds
is logarithmic in the number of nodes for any shape, chains included. The recorded removals, taken
back in reverse, give each node its root, depth, path and number of descendants. A core that never
contracts to a root shrinks to a node that points to itself: a cycle.

Every round is one write to the shared folder, and every join is on a node id that is unique on one
side, so a parent with a third of all rows as children only makes a skewed probe side, which
adaptive execution splits; child counts are combined map-side.

Defined results: rows with a null id are left out; a parent that is null or not among the ids ends
the chain, so the node is a root; of repeated rows of an id the caller keeps one; a node on a cycle
or below one has null root, depth and path; a node on a cycle has null ``n_descendants``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import term_number
from tessera.session import discard, materialize


def current_terms(df: DataFrame) -> DataFrame:
    """(id, parent, name) of each term's current row: latest ``recorded_at``, then largest ``row_id``."""
    rows = df.select(term_number("id").alias("id"), term_number("parent").alias("parent"), "name", "recorded_at", "row_id").where("id is not null")
    return rows.groupBy("id").agg(F.max_by(F.struct("parent", "name"), F.struct(F.coalesce("recorded_at", F.lit("0001-01-01").cast("timestamp")), "row_id")).alias("c")).select("id", "c.parent", "c.name")


def hierarchy(nodes: DataFrame, paths: bool = True, max_rounds: int = 200) -> DataFrame:
    """``nodes(id, parent)`` with unique ids to (id, parent, root, depth, cycle, on_cycle,
    n_descendants[, path]).

    ``cycle`` is the smallest id of the cycle that the chain of parents runs into, null if it ends;
    ``path`` lists ids from the root to the node.
    """
    ids = nodes.where("id is not null").select("id", "parent")
    there = ids.select(F.col("id").alias("pid"))
    live = ids.join(there, ids.parent == there.pid, "left").select(
        "id", "parent", F.col("pid").alias("up"), F.lit(0).cast("long").alias("via_n"), F.lit(None).cast("bigint").alias("via_min"),
        F.lit(0).cast("long").alias("inner"), F.lit(0).cast("long").alias("acc"), F.lit(0).cast("long").alias("seed"), F.array().cast("array<bigint>").alias("via"),
    )
    if not paths:
        live = live.drop("via")
    # How many are left to contract is counted as they are written, so a round is one job.
    start = live = materialize(live, "tree", F.count_if(F.col("up") != F.col("id")))
    left, rounds = start._tessera_measure, []
    for _ in range(max_rounds):
        if not left:
            break
        now = materialize(_contract(live, paths), "tree", F.count_if((F.col("fate") == "live") & (F.col("up") != F.col("id"))))
        left = now._tessera_measure
        rounds.append(now)
        live = now.where("fate = 'live'").drop("fate", "kid", "kid_inner")
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    loop = F.col("up").isNotNull()
    done = live.select(
        "id", "parent", F.when(~loop, F.col("id")).alias("root"), F.when(~loop, F.lit(0).cast("long")).alias("depth"),
        F.when(loop, F.least("id", "via_min")).alias("cycle"), loop.alias("on_cycle"), F.when(~loop, F.col("acc")).alias("n_descendants"),
        *([F.when(~loop, F.array("id")).alias("path")] if paths else []),
    )
    parts = [materialize(done, "tree")]
    for now in reversed(rounds):
        parts.append(materialize(_expand(now.where("fate <> 'live'"), _all(parts), paths), "tree"))
    for frame in {id(f): f for f in [start, *rounds]}.values():
        discard(frame)
    return _all(parts)


def _all(parts: list[DataFrame]) -> DataFrame:
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*[p._tessera_path for p in parts])


def _contract(live: DataFrame, paths: bool) -> DataFrame:
    # The round's number stands in the rows, not in the plan: so every round runs the same compiled code.
    kids = live.where("up <> id").groupBy(F.col("up").alias("of")).agg(F.count("*").alias("kids"), F.max("id").alias("kid"))
    known = live.join(kids, live.id == kids.of, "left").drop("of")
    draw = lambda c: F.xxhash64(c, F.col("seed"))
    inner = F.col("up").isNotNull() & (F.col("up") != F.col("id"))
    known = known.withColumn("leaf", inner & F.col("kids").isNull()).withColumn("may", inner & (F.col("kids") == 1) & (draw(F.col("id")) > draw(F.col("up"))) & (draw(F.col("id")) > draw(F.col("kid"))))
    # From the child's side: a child that itself has children takes over a chosen parent's pointer.
    over = known.where("may").select(F.col("id").alias("v"), F.col("up").alias("v_up"), F.col("via_n").alias("v_n"), F.col("via_min").alias("v_min"), F.col("inner").alias("v_inner"), F.col("acc").alias("v_acc"), *([F.col("via").alias("v_via")] if paths else []))
    took = known.where("not leaf and up is not null").select("id", "up", F.col("inner").alias("c_inner")).join(over, F.col("up") == F.col("v")).drop("up")
    gone = took.select(F.col("v").alias("g"), F.col("id").alias("g_kid"), F.col("c_inner").alias("g_inner"))
    raked = known.where("leaf").groupBy(F.col("up").alias("of")).agg(F.sum(F.col("acc") + F.col("inner") + 1).alias("more"))
    took = took.drop("c_inner").withColumnRenamed("id", "t")
    out = known.join(took, known.id == took.t, "left").join(gone, F.col("id") == F.col("g"), "left").join(raked, F.col("id") == F.col("of"), "left")
    has = F.col("v").isNotNull()
    step = lambda a, b: F.when(has, a).otherwise(b)
    # A node that is removed keeps its own pointer as it was: neighbours of a chosen node aren't chosen,
    # and a leaf takes nothing over, so "removed" and "took over" never meet in one node.
    return out.select(
        "id", "parent", step(F.col("v_up"), F.col("up")).alias("up"), step(F.col("via_n") + 1 + F.col("v_n"), F.col("via_n")).alias("via_n"),
        step(F.least("via_min", "v", "v_min"), F.col("via_min")).alias("via_min"), step(F.col("inner") + F.col("v_acc") + 1 + F.col("v_inner"), F.col("inner")).alias("inner"),
        (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc"), (F.col("seed") + 1).alias("seed"), *([step(F.concat("via", F.array("v"), "v_via"), F.col("via")).alias("via")] if paths else []),
        F.when(F.col("leaf"), "rake").when(F.col("g").isNotNull(), "compress").otherwise("live").alias("fate"), F.col("g_kid").alias("kid"), F.col("g_inner").alias("kid_inner"),
    )


def _expand(gone: DataFrame, done: DataFrame, paths: bool) -> DataFrame:
    above = done.select(F.col("id").alias("a"), F.col("root").alias("a_root"), F.col("depth").alias("a_depth"), F.col("cycle").alias("a_cycle"), *([F.col("path").alias("a_path")] if paths else []))
    below = done.select(F.col("id").alias("b"), F.col("n_descendants").alias("b_n"), F.col("on_cycle").alias("b_on"))
    out = gone.join(above, F.col("up") == F.col("a"), "left").join(below, F.col("kid") == F.col("b"), "left")
    raked = F.col("fate") == "rake"
    return out.select(
        "id", "parent", F.col("a_root").alias("root"), (F.col("a_depth") + F.col("via_n") + 1).alias("depth"), F.col("a_cycle").alias("cycle"),
        F.when(raked, False).otherwise(F.col("b_on")).alias("on_cycle"),
        F.when(raked, F.col("acc")).otherwise(F.col("acc") + F.col("kid_inner") + 1 + F.col("b_n")).alias("n_descendants"),
        *([F.concat("a_path", F.reverse("via"), F.array("id")).alias("path")] if paths else []),
    )


def descendants(full: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of all pairs, from the paths of :func:`hierarchy`; its size
    is that of the paths. Nodes on or below a cycle have no path and give no rows."""
    return full.where("path is not null").select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("pos", "ancestor")).where("ancestor <> descendant").select("ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
