import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.functions.ids import term_number
from tessera.operators.orphans import advance, empty_state, find_orphans, parent_versions, references, totals

T0 = datetime(2024, 1, 1)
P, R = "id string, recorded_at timestamp, row_id bigint, obsolete boolean, key string", "cl_id string, recorded_at timestamp, row_id bigint, key string"


def frames(spark, parents, refs):
    p = parent_versions(spark.createDataFrame(parents, P), term_number("id"), "recorded_at", "row_id", "obsolete")
    r = references(spark.createDataFrame(refs, R), "m", term_number("cl_id"), "recorded_at", "row_id")
    return p, r


def brute(parents, refs):
    num = lambda s: int("".join(c for c in s if c.isdigit())) if s and any(c.isdigit() for c in s) else None
    out = set()
    for cl, ts, rid, _ in refs:
        k = num(cl)
        if k is None:
            continue
        rows = [(t, i, o) for p, t, i, o, _ in parents if num(p) == k and t <= ts]
        if not rows or max(rows)[2]:
            out.add(rid)
    return out


def made(seed, n=300):
    rnd = random.Random(seed)
    hot = lambda: 1 if rnd.random() < 0.4 else rnd.randint(1, 12)
    at = lambda: T0 + timedelta(hours=rnd.randint(0, 24 * 90))
    form = lambda k: rnd.choice(["CL:%d", " cl:00%d", "CL_%d", "%d"]) % k
    parents = [(form(hot()), at(), i, rnd.choice([True, False, False]), "x") for i in range(n // 3)]
    refs = [(rnd.choice([form(hot()), form(hot()), None, "n/a"]), at(), 1000 + i, "y") for i in range(n)]
    return parents, refs + refs[:5]


def test_against_brute_force(spark):
    for seed in (1, 2):
        parents, refs = made(seed)
        p, r = frames(spark, parents, refs)
        got = [x.row_id for x in find_orphans(p, {"m": r}).orphans.collect()]
        assert set(got) == brute(parents, refs)
        assert len(got) == sum(x[2] in brute(parents, refs) for x in refs)  # repeated rows count each


def test_batches_give_what_one_batch_gives(spark):
    parents, refs = made(3)
    p, r = frames(spark, parents, refs)
    whole = find_orphans(p, {"m": r})
    state, orphans, snaps = empty_state(spark), [], []
    for lo, hi in ((0, 31), (31, 60), (60, 100)):
        a, b = (F.lit(T0 + timedelta(days=x)) for x in (lo, hi))
        step = advance(state, p.where((F.col("ts") >= a) & (F.col("ts") < b)), r.where((F.col("ts") >= a) & (F.col("ts") < b)), ["m"])
        orphans += [x.row_id for x in step.orphans.collect()]
        snaps += [(x.period, x.n_refs, x.n_orphans, x.n_resolved, x.n_reopened) for x in step.snapshots().collect()]
        state = step.state.saved()
    assert sorted(orphans) == sorted(x.row_id for x in whole.orphans.collect())
    assert sorted(snaps) == sorted((x.period, x.n_refs, x.n_orphans, x.n_resolved, x.n_reopened) for x in whole.snapshots().collect())


def test_arrival_resolves_and_deletion_reopens(spark):
    day = lambda n: T0 + timedelta(days=n)
    p, r = frames(spark, [("CL:7", day(40), 1, False, ""), ("CL:7", day(70), 2, True, "")], [("cl:7", day(1), 10, ""), ("07", day(45), 11, "")])
    done = find_orphans(p, {"m": r})
    assert [(x.row_id, x.reason) for x in done.orphans.collect()] == [(10, "unrecorded")]
    snaps = {x.period: (x.n_resolved, x.n_reopened, x.n_open) for x in done.snapshots().collect()}
    assert snaps == {"2024-01": (0, 0, 1), "2024-02": (1, 0, 0), "2024-03": (0, 2, 2)}


def test_ties_and_same_moment(spark):
    p, r = frames(spark, [("1", T0, 1, True, ""), ("1", T0, 2, False, ""), ("2", T0, 5, None, "")], [("1", T0, 10, ""), ("2", T0, 11, "")])
    assert find_orphans(p, {"m": r}).orphans.count() == 0


def test_empty_tables(spark):
    p, r = frames(spark, [], [])
    done = find_orphans(p, {"m": r})
    assert done.orphans.count() == 0 and done.snapshots().count() == 0 and done.state.versions.count() == 0 and done.state.refs.count() == 0
    p, r = frames(spark, [], [("CL:3", T0, 1, ""), (None, T0, 2, "")])
    assert [x.row_id for x in find_orphans(p, {"m": r}).orphans.collect()] == [1]


def test_stream_keeps_the_state(spark, tmp_path):
    from tessera.streaming.incremental import orphan_stream

    schema = "kind string, ref_table string, key bigint, ts timestamp, row_id bigint, deleted boolean"
    rows = [[("reference", "m", 1, T0, 1, None)], [("parent", None, 1, T0 + timedelta(days=1), 2, False)], [("reference", "m", 1, T0 + timedelta(days=2), 3, None), ("reference", "m", 2, T0 + timedelta(days=2), 4, None)]]
    src = tmp_path / "src"
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{src}")
        events = spark.readStream.schema(schema).parquet(str(src))
        q = orphan_stream(events, str(tmp_path / "out"), str(tmp_path / "cp"), ["m"])
        q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/orphans").select("row_id").collect()
    assert sorted(x.row_id for x in got) == [1, 4]


def test_open_references_continue_over_batches(spark):
    parents, refs = made(5)
    p, r = frames(spark, parents, refs)
    state, snaps = empty_state(spark), []
    for lo, hi in ((0, 31), (31, 60), (60, 100)):
        a, b = (F.lit(T0 + timedelta(days=x)) for x in (lo, hi))
        step = advance(state, p.where((F.col("ts") >= a) & (F.col("ts") < b)), r.where((F.col("ts") >= a) & (F.col("ts") < b)), ["m"])
        snaps += [(x.period, x.n_open) for x in step.snapshots().collect()]
        state = step.state.saved()
    assert sorted(snaps) == sorted((x.period, x.n_open) for x in find_orphans(p, {"m": r}).snapshots().collect())


def test_stream_writes_snapshots(spark, tmp_path):
    from tessera.streaming.incremental import orphan_stream

    schema = "kind string, ref_table string, key bigint, ts timestamp, row_id bigint, deleted boolean"
    for batch in ([("reference", "m", 1, T0, i, None) for i in range(3)], [("parent", None, 1, T0 + timedelta(days=40), 9, False)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
        orphan_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "src")), str(tmp_path / "out"), str(tmp_path / "cp"), ["m"]).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/snapshots").collect()
    assert sorted((x.period, x.n_orphans, x.n_resolved, x.n_open) for x in got) == [("2024-01", 3, 0, 3), ("2024-02", 0, 3, 0)]


def test_any_split_in_any_order_gives_what_one_batch_gives(spark):
    parents, refs = made(7, 150)
    p, r = frames(spark, parents, refs)
    whole = find_orphans(p, {"m": r})
    want, snaps = sorted(x.row_id for x in whole.orphans.collect()), sorted(map(tuple, whole.snapshots().collect()))
    for n, seed in ((3, 2),):
        part = lambda df, i: df.where(F.pmod(F.xxhash64("key", "ts", df.columns[-1], F.lit(seed)), F.lit(n)) == i)  # noqa: B023, E731
        state, got = empty_state(spark), []
        for i in range(n):
            step = advance(state, part(p, i), part(r, i), ["m"])
            got += [x.row_id for x in step.orphans.collect()]
            for x in step.retracted.collect():
                got.remove(x.row_id)
            state = step.state.saved()
        assert sorted(got) == want
        assert sorted(map(tuple, totals(state.counts).collect())) == snaps


def test_late_rows(spark):
    day = lambda n: T0 + timedelta(days=n)
    p1, _ = frames(spark, [("1", day(5), 1, False, "")], [])
    _, r2 = frames(spark, [], [("1", day(0), 10, "")])
    first = advance(empty_state(spark), p1, r2.limit(0), ["m"])
    second = advance(first.state, p1.limit(0), r2, ["m"])
    assert [x.row_id for x in second.orphans.collect()] == [10]  # a reference from before its parent comes late
    p3, _ = frames(spark, [("1", day(-1), 2, False, "")], [])
    third = advance(second.state, p3, r2.limit(0), ["m"])
    assert third.orphans.count() == 0 and [x.row_id for x in third.retracted.collect()] == [10]
    p4, _ = frames(spark, [("1", day(-1), 3, True, "")], [])  # the same moment, a larger number
    fourth = advance(third.state, p4, r2.limit(0), ["m"])
    assert [(x.row_id, x.reason) for x in fourth.orphans.collect()] == [(10, "deleted")]
