"""Queries over the ontology and the marker catalog: references and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ids import term_number
from tessera.operators.hierarchy import current_terms, descendants, hierarchy
from tessera.operators.orphans import Advance, State, advance, empty_state, find_orphans, parent_versions, references
from tessera.session import materialize, table


def _rows(cl: DataFrame, marks: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    parents = parent_versions(cl, term_number("id"), "recorded_at", "row_id", "obsolete")
    refs = {
        "cl_subset": references(cl, "cl_subset", term_number("parent"), "recorded_at", "row_id"),
        "marker_catalog": references(marks, "marker_catalog", term_number("cl_id"), "recorded_at", "row_id"),
    }
    return parents, refs


def _orphans(spark: SparkSession, d: str) -> Advance:
    return find_orphans(*_rows(table(spark, d, "cl_subset"), table(spark, d, "marker_catalog")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).orphans.select("ref_table", F.date_format("ts", "yyyy-MM").alias("period"), "row_id")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).snapshots()


def p1_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The cases of ``p1_found`` from three deliveries that cut the rows across all times, so each
    brings late parents, late deletions and late references to the ones before."""
    cl, marks = table(spark, d, "cl_subset"), table(spark, d, "marker_catalog")
    state, every = empty_state(spark), None
    for no in range(3):
        now = lambda df: df.where(F.pmod("row_id", F.lit(3)) == no)  # noqa: B023, E731
        parents, refs = _rows(now(cl), now(marks))
        done = advance(state, parents, refs["cl_subset"].unionByName(refs["marker_catalog"]), list(refs))
        rows = materialize(done.changes, "changes")
        every = rows if every is None else every.unionByName(rows)
        state = State(done.state.versions, done.state.refs, state.counts)  # parts of the tables; counts aren't asked for
    left = every.groupBy("ref_table", "key", "ts", "row_id").agg(F.sum("n").alias("n")).where("n > 0")
    return left.select("ref_table", F.date_format("ts", "yyyy-MM").alias("period"), "row_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    full = hierarchy(current_terms(table(spark, d, "cl_subset")), paths=False)
    return full.where("cycle is not null").select(F.col("id").alias("term_no"), F.col("cycle").alias("cycle_no"))


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    full = hierarchy(current_terms(table(spark, d, "cl_subset")))
    return full.select(F.col("id").alias("term_no"), F.col("root").alias("root_no"), "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "n_descendants", F.col("cycle").alias("cycle_no"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(hierarchy(current_terms(table(spark, d, "cl_subset"))))


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p1_incremental": p1_incremental, "p4_found": p4_found, "p4_hierarchy": p4_hierarchy, "p4_descendants": p4_descendants}

_NO = "try_cast(nullif(regexp_extract({0}, '([0-9]+)', 1), '') as bigint)"
_REFS = f"""v as (select {_NO.format('id')} as k, recorded_at as ts, row_id, coalesce(obsolete, false) as obs from cl_subset),
 r as (select 'cl_subset' as ref_table, {_NO.format('parent')} as k, recorded_at as ts, row_id from cl_subset
       union all select 'marker_catalog', {_NO.format('cl_id')}, recorded_at, row_id from marker_catalog)"""
_TERMS = f"""n as (select {_NO.format('id')} as id, {_NO.format('parent')} as parent,
   row_number() over (partition by {_NO.format('id')} order by recorded_at desc, row_id desc) as rn from cl_subset),
 c as (select id, parent from n where rn = 1 and id is not null),
 e as (select c.id, p.id as up from c left join c p on c.parent = p.id)"""

SQL = {
    "p1_found": f"""with {_REFS},
 s as (select r.ref_table, r.row_id, r.ts, arg_max(v.obs, (v.ts, v.row_id)) as obs from r left join v on v.k = r.k and v.ts <= r.ts where r.k is not null group by all)
 select ref_table, strftime(ts, '%Y-%m') as period, row_id from s where coalesce(obs, true)""",
    "p1_counts": f"""with {_REFS},
 s as (select r.ref_table, r.row_id, r.ts, r.k, arg_max(v.obs, (v.ts, v.row_id)) as obs from r left join v on v.k = r.k and v.ts <= r.ts where r.k is not null group by all),
 vv as (select k, ts, arg_max(obs, row_id) as obs from v where k is not null group by k, ts),
 f as (select k, ts, obs, coalesce(lag(obs) over (partition by k order by ts), true) as was from vv),
 flips as (select r.ref_table, strftime(f.ts, '%Y-%m') as period, sum(case when was and not obs then 1 else 0 end) as n_resolved, sum(case when obs and not was then 1 else 0 end) as n_reopened
   from f join r on r.k = f.k and r.ts < f.ts where f.obs <> f.was group by all),
 per as (select ref_table, strftime(ts, '%Y-%m') as period, count(*) as n_refs, count(*) filter (coalesce(obs, true)) as n_orphans from s group by all),
 t as (select distinct ref_table from r), months as (select distinct strftime(ts, '%Y-%m') as period from v where k is not null),
 keys as (select ref_table, period from per union select ref_table, period from t, months),
 j as (select k.ref_table, k.period, coalesce(n_refs, 0) as n_refs, coalesce(n_orphans, 0) as n_orphans, coalesce(n_resolved, 0) as n_resolved, coalesce(n_reopened, 0) as n_reopened
   from keys k left join per using (ref_table, period) left join flips using (ref_table, period))
 select ref_table, period, n_refs::bigint as n_refs, n_orphans::bigint as n_orphans, n_resolved::bigint as n_resolved, n_reopened::bigint as n_reopened,
   sum(n_orphans - n_resolved + n_reopened) over (partition by ref_table order by period)::bigint as n_open from j""",
    "p4_found": f"""with recursive {_TERMS},
 w(id, cur, seen) as (select id, up, [id] from e union all select w.id, e.up, list_append(seen, w.cur) from w join e on e.id = w.cur where not list_contains(seen, w.cur))
 select id as term_no, list_min(seen[list_position(seen, cur):]) as cycle_no from w where cur is not null and list_contains(seen, cur)""",
    "p4_hierarchy": f"""with recursive {_TERMS},
 w(id, cur, seen) as (select id, up, [id] from e union all select w.id, e.up, list_append(seen, w.cur) from w join e on e.id = w.cur where not list_contains(seen, w.cur)),
 f as (select id, cur, seen from w where cur is null or list_contains(seen, cur)),
 o as (select id, case when cur is null then list_reverse(seen) end as path, case when cur is not null then list_min(seen[list_position(seen, cur):]) end as cycle_no,
   cur is not null and cur = id as on_cycle, case when cur is null then seen else seen[:list_position(seen, cur) - 1] end as above from f),
 k as (select a as id, count(*) as n from (select id, unnest(above) as a from o) group by 1)
 select o.id as term_no, path[1] as root_no, (len(path) - 1)::bigint as depth, array_to_string(path, '/') as path,
   case when on_cycle then null else k.n - 1 end as n_descendants, cycle_no from o left join k on k.id = o.id""",
    "p4_descendants": f"""with recursive {_TERMS},
 w(id, cur, seen) as (select id, up, [id] from e union all select w.id, e.up, list_append(seen, w.cur) from w join e on e.id = w.cur where not list_contains(seen, w.cur)),
 f as (select id, list_reverse(seen) as path from w where cur is null),
 u as (select id, unnest(path) as a, generate_subscripts(path, 1) as i, len(path) as n from f)
 select a as ancestor, id as descendant, (n - i)::bigint as distance from u where a <> id""",
}
SQL["p1_incremental"] = SQL["p1_found"]
