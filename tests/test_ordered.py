"""Sliced running totals and quantiles against plain windows and numpy."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventlens.operators import features, history, ordered, records
from eventlens.operators.skew import join_per_entity
from eventlens.sources.tables import equal_parts


@pytest.fixture(scope="module")
def events(spark):
    """One entity holds a third of the rows, and many rows share an instant."""
    raw = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    return raw.select(
        F.when(F.col("event_id") % 3 == 0, "7").otherwise(F.col("user_id").cast("string")).alias("entity_id"),
        F.lpad(F.col("event_id").cast("string"), 10, "0").alias("event_id"),
        F.date_trunc("day", "ts").cast("timestamp").alias("created_at"),
        F.col("event_type").alias("type"),
        F.col("value").alias("amount"),
    ).cache()


@pytest.mark.parametrize("by", [["entity_id"], []])
@pytest.mark.parametrize("newest_first", [False, True])
@pytest.mark.parametrize("rows_per_task", [40, 700])
def test_ranks_in_slices(events, by, newest_first, rows_per_task):
    kw = dict(newest_first=newest_first)
    plain = ordered.ranks(events, by, ["created_at", "event_id"], "r", heavy=[], **kw)
    sliced = ordered.ranks(events, by, ["created_at", "event_id"], "r", rows_per_task=rows_per_task, **kw)
    assert plain.exceptAll(sliced.select(plain.columns)).count() == 0
    assert sliced.count() == plain.count()


def test_slices_spread_one_instant(spark):
    """All rows of one group at one instant: the second order column still cuts it."""
    df = spark.range(5000).select(F.lit("a").alias("g"), F.lit(0).alias("t"), F.col("id"))
    ranked = ordered.ranks(df, ["g"], ["t", "id"], "r", rows_per_task=100)
    assert ranked.where("r <> id + 1").count() == 0 and ranked.count() == 5000
    assert "slice" in ranked._jdf.queryExecution().toString()


def test_heavy_input_is_read_once(events):
    """With a heavy group the upstream is stored; the plan holds no scan of it again."""
    upstream = events.select("entity_id", "created_at", "event_id", F.rand(1).alias("noise"))
    ranked = ordered.ranks(upstream, ["entity_id"], ["created_at", "event_id"], "r", rows_per_task=50)
    assert "rand(" not in ranked._jdf.queryExecution().optimizedPlan().toString()


def test_running_totals_with_weights(events):
    w = Window.partitionBy("entity_id").orderBy("created_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    cents = F.round(F.col("amount") * 100).cast("bigint")
    want = events.select("event_id", F.sum(cents).over(w).alias("s"))
    got = ordered.running_totals(
        events, ["entity_id"], ["created_at", "event_id"], {"s": cents}, rows_per_task=50
    ).select("event_id", "s")
    assert want.exceptAll(got).count() == 0


def test_every_heavy_group_is_listed(events):
    heavy = ordered.heavy_groups(events, ["entity_id"], 10)
    assert heavy[0][0] == "7" and len(heavy) == events.groupBy("entity_id").count().where("count > 10").count()


@pytest.mark.parametrize("rows_per_task", [60, 10**9])
def test_quantiles_equal_numpy(events, rows_per_task):
    fractions = [i / 16 for i in range(1, 16)]
    q = ordered.quantiles(events, [], "amount", fractions, rows_per_task=rows_per_task)
    got = [r["quantile"] for r in q.orderBy("idx").collect()]
    values = np.array([r["amount"] for r in events.select("amount").collect()])
    assert got == list(np.percentile(values, [f * 100 for f in fractions]))


def test_quantiles_per_group(events):
    got = {
        (r["type"], r["fraction"]): r["quantile"]
        for r in ordered.quantiles(events, ["type"], "amount", [0.25, 0.5], rows_per_task=100).collect()
    }
    pdf = events.select("type", "amount").toPandas()
    for kind, part in pdf.groupby("type"):
        for f in (0.25, 0.5):
            assert got[(kind, f)] == np.percentile(part["amount"], f * 100)


def test_quantiles_of_few_values(spark):
    one = spark.createDataFrame([(1, 5.0), (1, None), (2, 1.0), (2, 2.0)], "g int, v double")
    got = {r["g"]: r["quantile"] for r in ordered.quantiles(one, ["g"], "v", [0.5]).collect()}
    assert got == {1: 5.0, 2: 1.5}


def test_equal_parts_like_ntile(events):
    n = events.count()
    cuts = equal_parts(events, ["amount", "event_id"], 7, n)
    w = Window.orderBy("amount", "event_id")
    both = events.select(
        F.ntile(7).over(w).alias("a"), (ordered.part_of(["amount", "event_id"], cuts) + 1).alias("b")
    )
    assert both.where("a <> b").count() == 0


def test_keep_recent_with_heavy_entity(events):
    plain = history.keep_recent(events, 20, [])
    sliced = history.keep_recent(events, 20, rows_per_task=50)
    cols = ["entity_id", "event_id", "event_ord", "latest_at"]
    assert plain.select(cols).exceptAll(sliced.select(cols)).count() == 0
    assert sliced.groupBy("entity_id").count().where("count > 20").count() == 0


def test_order_and_escalation_with_heavy_entity(events):
    heavy = ordered.heavy_groups(events, ["entity_id"], 50)
    plain = records.order_events(events, [])
    sliced = records.order_events(events, heavy, rows_per_task=50)
    assert plain.exceptAll(sliced.select(plain.columns)).count() == 0
    profile = events.select("entity_id").distinct()
    a = features.escalating_labels(events, profile, [])
    b = features.escalating_labels(events, profile, heavy, rows_per_task=50)
    assert a.exceptAll(b).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_join_with_heavy_entity(events, how):
    side = events.select("entity_id").distinct().where("entity_id <> '8'").withColumn("x", F.length("entity_id"))
    heavy = ordered.heavy_groups(events, ["entity_id"], 90)
    assert heavy
    plain = join_per_entity(events, side, how, [])
    split = join_per_entity(events, side, how, heavy)
    assert plain.exceptAll(split.select(plain.columns)).count() == 0
    assert plain.count() == split.count()


@pytest.mark.parametrize("newest_first", [False, True])
@pytest.mark.parametrize("n", [1, 7, 400])
def test_first_rows_of_heavy_groups_by_a_tree(events, newest_first, n):
    """Shares of one task compete first: with n = 7 a task takes seven shares, so three rounds are run."""
    order = ["created_at", "event_id"]
    plain = ordered.first_rows(events, ["entity_id"], order, n, "r", newest_first=newest_first, heavy=[])
    tree = ordered.first_rows(events, ["entity_id"], order, n, "r", newest_first=newest_first, rows_per_task=50)
    whole = ordered.first_rows(events, [], order, n, "r", newest_first=newest_first, rows_per_task=50)
    assert plain.exceptAll(tree.select(plain.columns)).count() == 0 and plain.count() == tree.count()
    assert [r["r"] for r in whole.orderBy("r").select("r").collect()] == list(range(1, n + 1))


def test_only_heavy_rows_are_written(events, monkeypatch):
    written = {}
    real = ordered.materialize

    def noted(df, label):
        out = real(df, label)
        written[label] = {r[0] for r in out.select("entity_id").distinct().collect()}
        return out

    monkeypatch.setattr(ordered, "materialize", noted)
    heavy = [g for g in ordered.heavy_groups(events, ["entity_id"], 50) if g[0] == "7"]
    ordered.ranks(events, ["entity_id"], ["created_at", "event_id"], "r", heavy=heavy, rows_per_task=50)
    assert written == {"heavy-rows": {"7"}, "ordered-slices": {"7"}}
    written.clear()
    kept = history.keep_recent(events, 20, heavy, rows_per_task=50)
    assert written == {} and kept.where("entity_id = '7'").count() == 20


def test_many_heavy_groups_stay_a_table(events, monkeypatch):
    want = ordered.heavy_groups(events, ["entity_id"], 10)
    monkeypatch.setattr(ordered, "LISTED_GROUPS", 2)
    groups = ordered.heavy_groups(events, ["entity_id"], 10)
    assert isinstance(groups, ordered.HeavyGroups) and len(groups) == len(want) and groups[0] == want[0] and list(groups) == want
    order = ["created_at", "event_id"]
    for step in (lambda h: ordered.ranks(events, ["entity_id"], order, "r", heavy=h, rows_per_task=10),
                 lambda h: ordered.first_rows(events, ["entity_id"], order, 5, "r", heavy=h, rows_per_task=10),
                 lambda h: join_per_entity(events, events.select("entity_id").distinct(), "inner", h)):
        plain, split = step([]), step(groups)
        assert plain.exceptAll(split.select(plain.columns)).count() == 0 and plain.count() == split.count()


def test_running_maxima_in_slices(events):
    """The maximum of an unordered column with nulls, carried over the slices."""
    odd = F.when(F.col("event_id") % 5 == 0, F.col("amount"))
    args = (["entity_id"], ["created_at", "event_id"], {"n": F.lit(1)})
    plain = ordered.running_totals(events, *args, maxima={"top": odd}, heavy=[])
    sliced = ordered.running_totals(events, *args, maxima={"top": odd}, rows_per_task=40)
    assert plain.exceptAll(sliced.select(plain.columns)).count() == 0 and sliced.where("top is not null").count() > 0


@pytest.fixture(scope="module")
def points(events):
    """Many points of the heavy entity, some at the very instants of events; entities without events; no time."""
    own = events.where("entity_id = '7'").select("entity_id", F.col("created_at").alias("evaluation_time")).distinct()
    spread = events.groupBy("entity_id").agg(F.expr("min(created_at) + interval 20 days").alias("a"), F.expr("max(created_at) + interval 1 day").alias("b"))
    others = spread.where("entity_id <> '7' and entity_id <> '9'").select("entity_id", F.explode(F.array("a", "b")).alias("evaluation_time")).distinct()
    early = others.select("entity_id", F.lit("1990-01-01").cast("timestamp").alias("evaluation_time")).distinct()
    odd = events.limit(1).select(F.explode(F.array(F.lit("nobody"), F.lit("9"))).alias("entity_id"), F.when(F.col("entity_id") == "?", F.col("created_at")).alias("evaluation_time"))
    late = events.limit(1).select(F.lit("nobody").alias("entity_id"), F.lit("2030-01-01").cast("timestamp").alias("evaluation_time"))
    return own.unionByName(others).unionByName(early).unionByName(odd).unionByName(late).cache()


def plain_histories(events, points, n):
    by = {}
    for r in events.collect():
        by.setdefault(r["entity_id"], []).append((r["created_at"], r["event_id"]))
    out = {}
    for p in points.where("evaluation_time is not null").collect():
        known = sorted(e for e in by.get(p["entity_id"], []) if e[0] <= p["evaluation_time"])
        out[p["entity_id"], p["evaluation_time"]] = (len(known), known[-n:])
    return out


@pytest.mark.parametrize("rows_per_task", [30, 10**9])
def test_states_and_histories_at_many_points(events, points, rows_per_task):
    want = plain_histories(events, points, 9)
    states = records.states_at(events, points, rows_per_task=rows_per_task).collect()
    got = {(r["entity_id"], r["evaluation_time"]): (r["n_events"], r["latest_at"]) for r in states}
    assert len(states) == len(got)
    assert got == {k: (n, known[-1][0] if known else None) for k, (n, known) in want.items()}
    rows = records.record_events(events, points, 9, rows_per_task=rows_per_task)
    found = {}
    for r in rows.collect():
        found.setdefault((r["entity_id"], r["evaluation_time"]), []).append((r["event_ord"], r["created_at"], r["event_id"], r["latest_at"]))
    assert {k: [(t, e) for _, t, e, _ in sorted(v)] for k, v in found.items()} == {k: known for k, (n, known) in want.items() if known}
    assert all([o for o, *_ in sorted(v)] == list(range(len(v))) and {x[3] for x in v} == {max(x[1] for x in v)} for v in found.values())
    assert tuple(records.history_audit(rows, 9).first())[:3] == (0, 0, 0)


def test_histories_do_not_join_events_with_all_points(events, points):
    """Events meet a point by (entity, run): what the join makes is at most twice what is kept."""
    known = records.states_at(events, points)
    kept = known.agg(F.sum(F.least(F.col("n_events"), F.lit(9)))).first()[0]
    product = events.join(known, "entity_id").where("created_at <= evaluation_time").count()
    assert product > 20 * kept
    plan = records.record_events(events, points, 9)._jdf.queryExecution().optimizedPlan().toString()
    assert "run" in plan and "Cartesian" not in plan


def test_a_point_given_twice_is_refused(events, points):
    twice = points.unionByName(points.where("entity_id = '7'").limit(1))
    with pytest.raises(Exception, match="evaluation point given twice: 7 at"):
        records.states_at(events, twice).collect()


def test_entities_without_points_keep_the_default(events, points):
    profile = events.select("entity_id").distinct().withColumn("signup_at", F.lit("1999-01-01").cast("timestamp"))
    times = records.evaluation_times(events, profile, points).collect()
    want = plain_histories(events, points, 1)
    last = {r["entity_id"]: (r["t"], r["n"]) for r in events.groupBy("entity_id").agg(F.max("created_at").alias("t"), F.count("*").alias("n")).collect()}
    got = {(r["entity_id"], r["evaluation_time"]): r["n_events"] for r in times}
    assert len(got) == len(times) and all(k[0] != "nobody" for k in got)
    with_points = {k[0] for k in want}
    assert "9" not in with_points and got["9", last["9"][0]] == last["9"][1]
    assert {k: n for k, n in got.items() if k[0] in with_points} == {k: n for k, (n, _) in want.items() if k[0] != "nobody"}
    assert {k: n for k, n in got.items() if k[0] not in with_points} == {(e, t): n for e, (t, n) in last.items() if e not in with_points}
    kept = records.events_as_of(events, points)
    assert kept.count() == kept.select("event_id").distinct().count()
