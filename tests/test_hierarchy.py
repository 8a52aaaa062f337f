import random

from tessera.operators.hierarchy import current_terms, descendants, hierarchy


def brute(nodes):
    up = {i: (p if p in dict(nodes) else None) for i, p in nodes}
    out = {}
    for i in up:
        seen, x = [], i
        while x is not None and x not in seen:
            seen.append(x)
            x = up[x]
        if x is None:
            out[i] = (seen[-1], len(seen) - 1, None, tuple(reversed(seen)))
        else:
            out[i] = (None, None, min(seen[seen.index(x) :]), None)
    below = {i: 0 for i in up}
    for i in up:
        x, seen = up[i], {i}
        while x is not None and x not in seen:
            below[x] += 1
            seen.add(x)
            x = up[x]
    on = {i for i in up if out[i][2] is not None and any_cycle(up, i)}
    return out, {i: None if i in on else below[i] for i in up}


def any_cycle(up, i):
    x, n = up[i], 0
    while x is not None and x != i and n <= len(up):
        x, n = up[x], n + 1
    return x == i


def run(spark, nodes):
    got = hierarchy(spark.createDataFrame(nodes, "id bigint, parent bigint")).collect()
    return {r.id: (r.root, r.depth, r.cycle, tuple(r.path) if r.path else None) for r in got}, {r.id: r.n_descendants for r in got}, len(got)


def test_shapes(spark):
    rnd = random.Random(4)
    shapes = [
        [(i, i - 1 if i else None) for i in range(120)],  # a chain
        [(i, 0 if i else None) for i in range(60)],  # a star: one parent of all
        [(i, (i + 1) % 7) for i in range(7)] + [(i, i - 7) for i in range(7, 30)],  # a cycle with chains below it
        [(5, 5), (6, 5), (8, 99), (9, None)],  # its own parent; a parent that isn't there
        [(i, rnd.choice([None, rnd.randint(0, 79)])) for i in range(80)],
    ]
    for nodes in shapes:
        full, below, n = run(spark, nodes)
        want, want_below = brute(nodes)
        assert n == len(nodes) and full == want and below == want_below


def test_empty_and_null(spark):
    assert run(spark, [])[2] == 0
    assert run(spark, [(None, 1), (1, None)])[0] == {1: (1, 0, None, (1,))}


def test_descendants(spark):
    full = hierarchy(spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 4)], "id bigint, parent bigint"))
    assert sorted(map(tuple, descendants(full).collect())) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]


def test_current_rows(spark):
    rows = [(1, "CL:5", "CL:1", "a", "2024-01-02"), (2, "cl:05", "CL:2", "b", "2024-01-02"), (3, "5", "CL:3", "c", "2024-01-01"), (4, None, "CL:3", "c", "2024-01-01"), (5, "CL:6", "n/a", None, None)]
    df = spark.createDataFrame(rows, "row_id bigint, id string, parent string, name string, recorded_at string").selectExpr("row_id", "id", "parent", "name", "cast(recorded_at as timestamp) recorded_at")
    assert sorted(map(tuple, current_terms(df).select("id", "parent").collect())) == [(5, 2), (6, None)]
