"""Order-dependent operators against plain Python, with cells small enough to split groups."""

import random

import pytest
from pyspark.sql import functions as F

from codestrata.operators import ordered as o, skew

SCHEMA = "k string, ord bigint, tag string, v int"


def make(n=400, seed=3):
    rnd = random.Random(seed)
    out, seen = [], set()
    for _ in range(n):
        key = rnd.choice(["hot", "hot", "hot", "a", "b", None])
        place = rnd.randrange(0, 5000)
        if (key, place) in seen:
            continue
        seen.add((key, place))
        out.append((key, place, rnd.choice(["x", None, "stop" if rnd.random() < 0.1 else "y"]), rnd.randrange(9)))
    return out


@pytest.fixture(scope="module", params=[1, 8])
def data(spark, request):
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    raw = make()
    groups = {}
    for r in raw:
        groups.setdefault(r[0], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: r[1])
    yield spark.createDataFrame(raw, SCHEMA).repartition(4), groups
    spark.conf.set("spark.sql.shuffle.partitions", "4")


CHUNKS = [37, None]
pytestmark = pytest.mark.usefixtures("hotness")


def chunk(size):
    return None if size is None else F.floor(F.col("ord") / size)


@pytest.mark.parametrize("size", CHUNKS)
def test_position_and_batches(data, rows, size):
    df, groups = data
    want = sorted(
        [(k, r[1], i) for k, g in groups.items() for i, r in enumerate(g)], key=lambda t: (t[0] is not None, str(t[0]), t[1])
    )
    got = o.with_position(df, ["k"], ["ord"], chunk=chunk(size)).select("k", "ord", "position").collect()
    assert sorted(map(tuple, got), key=lambda t: (t[0] is not None, str(t[0]), t[1])) == want
    b = o.batches(df, ["k"], ["ord"], 30, chunk=chunk(size))
    assert {(r.k, r.ord): r.batch for r in b.collect()} == {(k, o_): i // 30 for k, o_, i in want}


@pytest.mark.parametrize("size", CHUNKS)
def test_cursor(data, size):
    df, groups = data
    got = {
        (r.k, r.ord): (r.prev_tag, r.next_tag, r.prev_v, r.next_v, r.position)
        for r in o.cursor(df, ["k"], ["ord"], ["tag", "v"], chunk(size)).collect()
    }
    want = {}
    for k, g in groups.items():
        for i, r in enumerate(g):
            p = g[i - 1] if i else (None,) * 4
            n = g[i + 1] if i + 1 < len(g) else (None,) * 4
            want[(k, r[1])] = (p[2], n[2], p[3], n[3], i)
    assert got == want
    held = {(r.k, r.ord): r.prev_v for r in o.cursor(df, ["k"], ["ord"], ["v"], chunk(size), clamp=True).collect()}
    assert held == {(k, r[1]): g[max(i - 1, 0)][3] for k, g in groups.items() for i, r in enumerate(g)}


@pytest.mark.parametrize("size", CHUNKS)
def test_take_while_and_skip_until(data, size):
    df, groups = data
    keep = F.coalesce(F.col("tag") != "stop", F.lit(True))
    taken = {(r.k, r.ord) for r in o.take_while(df, ["k"], ["ord"], keep, chunk=chunk(size)).collect()}
    hit = F.col("tag") == "stop"
    after = {(r.k, r.ord) for r in o.skip_until(df, ["k"], ["ord"], hit, chunk(size)).collect()}
    steps = {r.k: (r.skipped, r.error) for r in o.skipped_steps(df, ["k"], ["ord"], hit, chunk(size)).collect()}
    first3 = {(r.k, r.ord) for r in o.limit_after(df, ["k"], ["ord"], hit, 3, chunk(size)).collect()}
    df.sparkSession.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "2")
    assert first3 == {(r.k, r.ord) for r in o.limit_after(df, ["k"], ["ord"], hit, 3, chunk(size)).collect()}
    df.sparkSession.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    want_t, want_a, want_s, want_3 = set(), set(), {}, set()
    for k, g in groups.items():
        at = next((i for i, r in enumerate(g) if r[2] == "stop"), None)
        want_t |= {(k, r[1]) for r in g[: at if at is not None else len(g)]}
        rest = [] if at is None else g[at + 1 :]
        want_a |= {(k, r[1]) for r in rest}
        want_3 |= {(k, r[1]) for r in rest[:3]}
        want_s[k] = (at, None if at is not None else "CanNotFindFirstCommit")
    assert (taken, after, steps, first3) == (want_t, want_a, want_s, want_3)


def test_take_while_skips_without_stopping(spark, rows):
    df = spark.createDataFrame([("f", 0, "CWE-1"), ("f", 1, ""), ("f", 2, "CWE-2"), ("f", 3, "none"), ("f", 4, "CWE-3")], "f string, n bigint, id string")
    got = o.take_while(df, ["f"], ["n"], F.col("id").rlike(r"CWE-\d+"), skip=F.coalesce(F.col("id"), F.lit("")) == "")
    assert rows(got, "n") == [(0,), (2,)]


@pytest.mark.parametrize("size", CHUNKS)
def test_carry_down(data, size):
    df, groups = data
    got = {(r.k, r.ord): r.last_tag for r in o.carry_down(df, ["k"], ["ord"], {"last_tag": F.col("tag")}, chunk(size)).collect()}
    want = {}
    for k, g in groups.items():
        last = None
        for r in g:
            last = r[2] if r[2] is not None else last
            want[(k, r[1])] = last
    assert got == want


def test_first_and_last_wins(data):
    df, groups = data
    first = {r.k: r.ord for r in o.first_wins(df, ["k"], ["ord"]).collect()}
    last = {r.k: (r.ord, r.tag) for r in o.last_wins(df, ["k"], ["ord", "v"]).collect()}
    assert first == {k: g[0][1] for k, g in groups.items()}
    assert last == {k: (g[-1][1], g[-1][2]) for k, g in groups.items()}


def test_no_keys(spark, rows):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "s string")
    want = [(None, 0), ("a", 1), ("b", 2), ("c", 3)]
    assert rows(o.with_position(df, [], ["s"])) == want
    assert rows(o.with_position(df, [], ["s"], chunk=F.substring("s", 1, 1))) == want


ORDERS = {
    "string": lambda: F.concat(F.lit("id-"), F.col("ord").cast("string")),
    "double": lambda: F.col("ord") / 7.0,
    "decimal": lambda: F.col("ord").cast("decimal(20,3)"),
    "struct": lambda: F.struct((F.col("ord") % 3).alias("a"), F.col("ord").alias("b")),
    "sparse integer": lambda: F.col("ord") * 1_000_000_007,
    "one busy hour": lambda: F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("ord")),
    "with nulls": lambda: F.when(F.col("ord") > 200, F.col("ord")),
}


@pytest.mark.parametrize("kind", ORDERS)
def test_any_order_that_can_be_compared(data, kind):
    df, _ = data
    df = df.withColumn("place", ORDERS[kind]())
    plain = F.row_number().over(o.Window.partitionBy("k").orderBy("place", "ord")) - 1
    want = {(r.k, r.ord): r.p for r in df.withColumn("p", plain).collect()}
    got = {(r.k, r.ord): r.position for r in o.with_position(df, ["k"], ["place", "ord"]).collect()}
    assert got == want


def test_cells_are_even_and_few(spark, monkeypatch):
    """A hot group of sparse ids is cut by rows: parts of about half of what a task may get."""
    monkeypatch.setattr(skew, "HOT_ROWS", 2000)
    df = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") * F.col("id") * 1_000_003).alias("ord"))
    both, _, _ = o._cells(df, ["k"], ["ord"], None, [F.count(F.lit(1)).alias("_n")], lambda along: [o._rows_before(along)])
    sizes = [r["count"] for r in both.where(F.col(o.IS_ROW) == 1).groupBy(o.CELL).count().collect()]
    assert sum(sizes) == 20_000 and 10 <= len(sizes) <= 60 and max(sizes) <= 3000


def test_groups_in_one_cell_carry_nothing(spark, monkeypatch):
    """Small groups beside a hot one are cut at the ends of a range only."""
    monkeypatch.setattr(skew, "HOT_ROWS", 2000)
    df = spark.range(30_000).select(F.when(F.col("id") < 10_000, -1).otherwise(F.col("id") % 5000).alias("k"), F.col("id").alias("ord"))
    both, _, _ = o._cells(df, ["k"], ["ord"], None, [F.count(F.lit(1)).alias("_n")], lambda along: [o._rows_before(along)])
    carried = both.where(F.col(o.IS_ROW) == 0).groupBy("k").count().collect()
    cells = both.select(o.CELL).distinct().count()
    assert 1 < len(carried) <= cells and {r["k"]: r["count"] for r in carried}[-1] > 3


def test_a_null_order_value_is_a_value(spark):
    df = spark.createDataFrame([("a", None, "x"), ("b", None, "y"), ("b", 1, "z")], "k string, ord int, v string")
    assert {r.k: r.v for r in o.first_wins(df, ["k"], ["ord"]).collect()} == {"a": "x", "b": "y"}
    assert {r.k: r.v for r in o.last_wins(df, ["k"], ["ord"]).collect()} == {"a": "x", "b": "z"}


def test_plan_depends_on_the_groups(data, monkeypatch):
    """Hot groups are shuffled by group and cell; without one the plain window is the plan."""
    df, _ = data

    def plan():
        return o.with_position(df, ["k"], ["ord"])._jdf.queryExecution().optimizedPlan().toString()

    monkeypatch.setattr(skew, "HOT_ROWS", 0)
    assert "_cell" in plan() and "Union" in plan()
    assert "_bounds" not in plan() and "Join" not in plan()
    monkeypatch.setattr(skew, "HOT_ROWS", 10**9)
    assert "Union" not in plan() and "Join" not in plan()
