"""Masks, batches, probes: rules and fault injection."""

import random

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from eventlens.operators import batch, cooccurrence, logistic, mask, probes
from eventlens.operators.encode import event_tokens
from eventlens.plans import workspace

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def app(spark):
    return workspace(spark, FOLDER).app


# -- masks ---------------------------------------------------------------------------


def test_no_probability_no_mask(app):
    masked = mask.mask_tokens(app.encoded(), app.bundle, mask.MaskConfig(0.0, 0.0, 0.0, 0.05))
    assert masked.where("origin <> 0 or label <> -100 or input_id <> value_id").count() == 0


def test_full_dropout_leaves_no_label(app):
    masked = mask.mask_tokens(app.encoded(), app.bundle, mask.MaskConfig(1.0, 0.0, 0.0, 1.0))
    assert masked.where("eligible and (input_id <> 1 or label <> -100)").count() == 0


def test_event_and_key_masks_cover_their_group(app):
    masked = mask.mask_tokens(app.encoded(), app.bundle, mask.MaskConfig(0.0, 0.5, 0.0, 0.0))
    per_event = masked.where("eligible").groupBy("event_id").agg(F.countDistinct("origin").alias("n"))
    assert per_event.where("n > 1").count() == 0
    masked = mask.mask_tokens(app.encoded(), app.bundle, mask.MaskConfig(0.0, 0.0, 0.5, 0.0))
    per_key = masked.where("eligible").groupBy("entity_id", "key_id").agg(F.countDistinct("origin").alias("n"))
    assert per_key.where("n > 1").count() == 0 and masked.where("origin = 4").count() > 0


def test_unknown_values_are_never_targets(app):
    masked = mask.mask_tokens(app.encoded(), app.bundle, mask.MaskConfig(1.0, 1.0, 1.0, 0.0))
    assert masked.where("value_id = 1 and origin <> 0").count() == 0
    assert masked.where("value_id <> 1 and origin <> 7").count() == 0


def test_rates(app):
    c = mask.coverage(app.masked()).first()
    assert 0.10 < c["token_rate"] < 0.20 and 0.05 < c["event_rate"] < 0.15


# -- batches ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sizes(spark):
    rows = [(f"r{i:04d}", 1 + (i * 7) % 40, 2 + (i * 13) % 90) for i in range(400)] + [("big", 3000, 9000)]
    return spark.createDataFrame(rows, "entity_id string, n_events bigint, n_event_tokens bigint")


BUDGET = batch.Budget(max_event_tokens=300, max_events=120, max_records=9, n_length_buckets=4, seed=3)


@pytest.mark.parametrize("per_run", [200_000, 20])
def test_budgets_hold_and_all_records_are_there(sizes, per_run):
    plan = batch.plan_batches(sizes, BUDGET, 1, records_per_run=per_run)
    assert plan.count() == 401 and plan.select("entity_id").distinct().count() == 401
    over = batch.batch_sizes(plan).where(
        "n_records > 1 and (n_event_tokens > 300 or n_events > 120 or n_records > 9)"
    )
    assert over.count() == 0
    ids = sorted(r[0] for r in plan.select("batch_id").distinct().collect())
    assert ids == list(range(len(ids)))
    alone = plan.where("entity_id = 'big'").select("batch_id")
    assert plan.join(alone, "batch_id").count() == 1


def test_one_group_packs_greedily(sizes):
    plan = batch.plan_batches(sizes, batch.Budget(300, 120, 9, 1, 3), 0)
    order = sorted(sizes.collect(), key=lambda r: __import__("hashlib").sha256(f"3|0|record|{r['entity_id']}".encode()).hexdigest())
    want, b, t, e, n = {}, 0, 0, 0, 0
    for r in order:
        if n and (t + r["n_event_tokens"] > 300 or e + r["n_events"] > 120 or n + 1 > 9):
            b, t, e, n = b + 1, 0, 0, 0
        want[r["entity_id"]] = (b, n)
        t, e, n = t + r["n_event_tokens"], e + r["n_events"], n + 1
    assert {r["entity_id"]: (r["batch_id"], r["pos"]) for r in plan.collect()} == want


@pytest.mark.parametrize("per_run, fan", [(9, 2), (50, 64), (400, 3)])
def test_packing_does_not_depend_on_runs(sizes, monkeypatch, per_run, fan):
    whole = batch.plan_batches(sizes, BUDGET, 2)
    monkeypatch.setattr(batch, "FAN", fan)
    cut = batch.plan_batches(sizes, BUDGET, 2, records_per_run=per_run)
    assert whole.exceptAll(cut).count() == 0 and cut.count() == 401


def test_nothing_to_pack(sizes):
    assert batch.plan_batches(sizes.where("false"), BUDGET).count() == 0


def test_epochs_differ_and_repeat(sizes):
    a, b = batch.plan_batches(sizes, BUDGET, 0), batch.plan_batches(sizes.repartition(3), BUDGET, 0)
    assert a.exceptAll(b).count() == 0
    assert a.exceptAll(batch.plan_batches(sizes, BUDGET, 1)).count() > 0


@pytest.mark.parametrize("ranks", [1, 3, 7, 1000])
def test_ranks_get_equal_counts(sizes, ranks):
    plan = batch.plan_batches(sizes, BUDGET, 0)
    out = batch.rank_batches(plan, ranks)
    counts = {r["count"] for r in out.groupBy("rank").count().collect()}
    assert len(counts) == 1 and out.select("rank").distinct().count() == ranks
    assert out.select("batch_id").distinct().count() == plan.select("batch_id").distinct().count()
    with pytest.raises(ValueError):
        batch.rank_batches(plan, 0)


def _flat(app):
    counts = app.sizes().select("entity_id", F.col("n_events").alias("n_kept"))
    return batch.flat_batches(app.batches, app.profiles().join(counts, "entity_id"), app.encoded(), app.masked())


def test_tokens_made_in_their_batch_give_the_same_buffers(app):
    counts = app.sizes().select("entity_id", F.col("n_events").alias("n_kept"))
    profiles, events = app.profiles().join(counts, "entity_id"), app.encoded()
    masked = mask.mask_tokens(batch.in_batches(events, app.batches), app.bundle, mask.MaskConfig(), 0, "batch_id", "rec")
    placed, joined = batch.flat_batches(app.batches, profiles, events, masked), _flat(app)
    assert sorted(map(repr, placed.collect())) == sorted(map(repr, joined.collect()))


def test_tampered_batches_are_caught(app):
    flat = _flat(app)
    assert batch.batch_problems(flat).where("size(problems) > 0").count() == 0
    assert batch.require_valid(flat).count() == flat.count()
    broken = {
        "event_offsets": F.concat(F.array(F.lit(5).cast("bigint")), F.slice("event_offsets", F.lit(2), F.size("event_offsets") - 1)),
        "history_offsets": F.slice("history_offsets", F.lit(1), F.size("history_offsets") - 1),
        "event_labels": F.slice("event_labels", F.lit(1), F.size("event_labels") - 1),
        "event_to_record": F.reverse("event_to_record"),
        "profile_token_to_record": F.transform("profile_token_to_record", lambda x: x + 1000),
    }
    for name, col in broken.items():
        bad = flat.withColumn(name, col)
        assert batch.batch_problems(bad).where("size(problems) > 0").count() > 0, name
    with pytest.raises(Exception, match="history offsets do not cover"):
        batch.require_valid(flat.withColumn("history_offsets", broken["history_offsets"])).select("n_records").collect()


def test_padding_waste(spark):
    rows = [("even", 8)] * 50 + [("mixed", 5)] * 200 + [("mixed", 100)] * 10
    got = {r["g"]: r for r in batch.padding_waste(spark.createDataFrame(rows, "g string, n int"), ["g"], "n").collect()}
    assert got["even"]["linear_ratio"] == 1.0 and got["even"]["square_ratio"] == 1.0
    assert got["mixed"]["linear_ratio"] == 210 * 100 / 2000 and got["mixed"]["square_ratio"] == 210 * 10000 / (200 * 25 + 10 * 10000)


def test_published_padding_ratios(spark):
    """200 short and 10 long sequences: 5.4545 and 13.8716 times."""
    import random

    rng = random.Random(0)
    lengths = [rng.randint(1, 6) for _ in range(200)] + [24] * 10
    row = batch.padding_waste(spark.createDataFrame([("a", n) for n in lengths], "g string, n int"), ["g"], "n").first()
    assert row["linear_ratio"] == pytest.approx(5.4545, abs=5e-5)
    assert row["square_ratio"] == pytest.approx(13.8716, abs=5e-5)


def test_context_shuffle_keeps_values_and_targets(app):
    out = batch.shuffle_context(app.masked(), app.batches)
    assert out.count() == event_tokens(app.encoded()).count()
    assert out.where("label <> -100 and new_input_id <> input_id").count() == 0
    a = out.groupBy("batch_id", F.col("input_id").alias("v")).count()
    b = out.groupBy("batch_id", F.col("new_input_id").alias("v")).count()
    assert a.exceptAll(b).count() == 0
    assert out.where("new_input_id <> input_id").count() > 0


# -- probes ------------------------------------------------------------------------------


def test_auc_with_ties_and_one_class(spark):
    rows = [("a", 1.0, True), ("a", 1.0, False), ("a", 2.0, True), ("a", 0.0, False), ("b", 1.0, True)]
    df = spark.createDataFrame(rows, "g string, s double, y boolean")
    got = {r["g"]: r["auc"] for r in probes.rank_auc(df, "s", "y", ["g"]).collect()}
    assert got == {"a": 0.875, "b": None}


def test_auc_equals_the_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(2000).select(
        F.round(F.rand(3) * 50).alias("s"), (F.rand(4) < F.rand(3)).cast("double").alias("y")
    ).cache()
    want = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0).evaluate(df)
    assert abs(probes.rank_auc(df, "s", "y").first()["auc"] - want) < 1e-9


def _vectors(spark, n=300, one_class=False):
    y = F.lit(True) if one_class else F.col("id") % 2 == 0
    return spark.range(n).select(
        F.col("id").cast("string").alias("entity_id"), y.alias("label"), (F.col("id") % 5 == 0).alias("is_val"),
        F.array(
            F.rand(1) + F.when(y, 1.0).otherwise(0.0), F.rand(2)
        ).alias("v"),
    )


def test_probe_finds_the_signal(spark):
    r = probes.linear_probe(_vectors(spark), "v", "label", "probe_v").first()
    assert r["auc"] > 0.9 and r["n_train"] == 240 and r["n_val"] == 60


def _noisy_rows():
    rng = random.Random(5)
    rows = []
    for _ in range(600):
        x = [rng.gauss(0, 1), rng.gauss(2e6, 1e6), rng.gauss(0, 1e-7), 4.0]
        rows.append((x, int(x[0] + x[2] * 1e7 + rng.gauss(0, 1) > 0.2)))
    return rows + rows[:200]


def _plain_newton(rows, l2):
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    std = x.std(axis=0)
    z = np.column_stack((np.ones(len(x)), (x - x.mean(axis=0)) / np.where(std > 0, std, 1)))
    ridge, w = np.diag([0.0] + [l2] * x.shape[1]), np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
    return w


@pytest.mark.parametrize("l2", [1.0, 1e-3])
def test_logistic_weights_and_partitions(spark, monkeypatch, l2):
    """Small blocks, repeated rows, a constant and badly scaled dimensions; any partitioning, one model."""
    monkeypatch.setattr(logistic, "BLOCK_BYTES", 1_000)
    rows = _noisy_rows()
    df = spark.createDataFrame(rows, "v array<double>, y int")
    models = [logistic.fit_logistic(df.repartition(n), "v", "y", l2=l2) for n in (1, 7)]
    assert models[0] == models[1]
    got = np.array([models[0].intercept, *models[0].weights])
    assert np.abs(got - _plain_newton(rows, l2)).max() < 1e-6


@pytest.mark.parametrize(
    "rows", [[], [([1.0], 1)], [([1.0], 1), ([None], 0)], [([1.0], 1), ([float("nan")], 0)], [([1.0], 1), ([1.0, 2.0], 0)], [([1.0], 1), ([2.0], 0), ([3.0], 2)]]
)
def test_logistic_refuses(spark, rows):
    df = spark.createDataFrame(rows, "v array<double>, y int")
    with pytest.raises((ValueError, PythonException)):
        logistic.fit_logistic(df, "v", "y")


def test_probe_with_one_class_has_no_auc(spark):
    r = probes.linear_probe(_vectors(spark, one_class=True), "v", "label").first()
    assert r["auc"] is None and r["n_val"] == 60


def test_baselines_find_the_signal(spark):
    df = spark.range(400).select(
        F.col("id").cast("string").alias("entity_id"), (F.col("id") % 2 == 0).alias("label"),
        (F.col("id") % 4 == 1).alias("odd"), (F.col("id") % 5 == 0).alias("is_val"),
        F.when(F.col("id") % 7 > 0, F.rand(1) + F.when(F.col("id") % 2 == 0, 1.5).otherwise(0.0)).alias("x"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 6)).alias("c"),
    )
    rows = {r["name"]: r["auc"] for r in probes.baselines(df, "label", ["x", "odd"], ["c"]).collect()}
    assert rows["baseline_logreg"] > 0.85 and rows["baseline_gbdt"] > 0.85


def _event_rows(spark, n=120):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        topic = rng.randrange(3)
        ids = [10 * topic + rng.randrange(5) for _ in range(rng.randrange(0, 6))]
        rows.append((f"e{i % 11}", f"v{i}", i // 11, [1] * len(ids), ids))
    return spark.createDataFrame(rows, "entity_id string, event_id string, event_ord int, key_ids array<int>, value_ids array<int>"), rows


def test_token_vectors(spark):
    """Pair counts against a plain count, directions against an exact decomposition, any partitioning."""
    df, rows = _event_rows(spark)
    want = {}
    for *_, ids in rows:
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if i != j:
                    want[a, b] = want.get((a, b), 0) + 1
    low = 2**32 - 1
    pairs = cooccurrence.pair_counts(df)
    assert {(r["a"] & low, r["b"] & low): r["n"] for r in pairs.collect()} == want
    runs = []
    for parts in (2, 20):
        vectors = cooccurrence.word_vectors(cooccurrence.pair_counts(df.repartition(parts)).repartition(parts), 4)
        runs.append(({r["word"]: r["q"] for r in vectors.collect()}, sorted(cooccurrence.record_vectors(df, vectors, 4).collect())))
    assert runs[0] == runs[1]
    names = sorted({a for a, _ in want})
    counts = np.array([[want.get((a, b), 0) for b in names] for a in names], dtype=float)
    margin = counts.sum(axis=1)
    with np.errstate(divide="ignore"):
        info = np.maximum(np.log(counts * counts.sum() / np.outer(margin, margin)), 0)
    got = np.array([runs[0][0][(1 << 32) + a] for a in names]) / cooccurrence.UNIT
    strength = np.sort(np.abs(np.linalg.eigvalsh(info)))[::-1][:3]
    assert np.abs(np.sort((got**2).sum(axis=0))[::-1][:3] / strength - 1).max() < 0.2
    last = max((r for r in rows if r[0] == "e4"), key=lambda r: r[2])
    mine = next(r for r in runs[0][1] if r["entity_id"] == "e4")
    newest = [r for r in rows if r[0] == "e4" and r[4]][-1]
    assert last[2] >= newest[2]
    assert np.allclose(mine["last_event"], np.mean([got[names.index(v)] for v in newest[4]], axis=0))


def test_token_vectors_of_nothing(spark):
    df, _ = _event_rows(spark)
    assert probes.token_vectors(df.where("false"), 4).count() == 0
    alone = df.withColumns({"key_ids": F.array(F.lit(1)), "value_ids": F.array(F.lit(5))})
    assert {tuple(r["usr"]) for r in probes.token_vectors(alone, 2).collect()} == {(0.0, 0.0)}


def test_report_order(spark):
    rows = [("probe_a", 0.7, 5, 2), ("baseline_b", None, 5, 2), ("lora_finetuned", 0.9, 5, 2), ("probe_n", float("nan"), 5, 2)]
    out = probes.comparison_report(spark.createDataFrame(rows, probes.RESULT), "final").collect()
    assert [r["name"] for r in out] == ["lora_finetuned", "probe_a", "baseline_b", "probe_n"]
    assert [r["kind"] for r in out] == ["lora", "probe", "baseline", "probe"]
    assert out[2]["checkpoint"] == "n/a (baseline)" and out[3]["auc"] is None


# -- heavy customers through the whole pipeline ---------------------------------------------


def test_heavy_customers_give_the_same_tokens(spark, app):
    from eventlens.operators import ordered
    from eventlens.plans.workspace import Workspace

    other = Workspace(spark, FOLDER).app
    other.heavy = ordered.heavy_groups(other.events, ["entity_id"], 60)
    assert other.heavy
    other.bundle = app.bundle
    a, b = app.encoded(), other.encoded()
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_large_vocabularies_are_joined_by_shuffle(spark, app, monkeypatch):
    from eventlens.operators import encode, skew

    plain = app.encoded()
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(encode, "BROADCAST_ROWS", 0)
    assert plain.exceptAll(app.encoded()).count() == 0


def test_frequent_values_of_a_large_vocabulary_go_by_broadcast(spark, monkeypatch):
    """One value fills half of the rows and its key is large; the other key stays small."""
    from eventlens.operators import encode
    from eventlens.operators.bundle import Bundle, EncoderConfig
    from eventlens.sources.tables import app_registry

    words = [("view", f"v{i}", 100 + i) for i in range(60)] + [("type", t, 10 + i) for i, t in enumerate("abc")]
    categories = spark.createDataFrame(words, "key string, value string, value_id int")
    bundle = Bundle(app_registry(), EncoderConfig(), {}, categories, len(words))
    rows = [(f"e{i}", None if i % 7 == 0 else "v3" if i % 2 else f"v{i % 90}", "abcd"[i % 4]) for i in range(900)]
    events = spark.createDataFrame(rows, "event_id string, view string, type string").repartition(5)
    ids = {(k, v): i for k, v, i in words}
    want = {e: (None if v is None else ids.get(("view", v), 1), ids.get(("type", t), 1)) for e, v, t in rows}
    for limit in (1000, 10):
        monkeypatch.setattr(encode, "BROADCAST_ROWS", limit)
        found = encode.category_ids(events, ["view", "type"], bundle, rows_per_task=200)
        assert {r["event_id"]: (r["id_view"], r["id_type"]) for r in found.collect()} == want and found.count() == 900
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert ("Union" in plan) == (limit == 10)  # the frequent value apart from the shuffled ones
    monkeypatch.setattr(encode, "BROADCAST_ROWS", 1000)
    monkeypatch.setattr(encode, "BROADCAST_BYTES", 100)
    by_bytes = encode.category_ids(events, ["view", "type"], bundle)
    assert {r["event_id"]: (r["id_view"], r["id_type"]) for r in by_bytes.collect()} == want
