"""Edge rules on small literal frames."""

import datetime as dt
import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from eventlens import registry as R
from eventlens.functions.buckets import bucket_index, length_label, numeric_token
from eventlens.functions.temporal import calendar, soft_log
from eventlens.operators import encode, fit, history, records, split, validate
from eventlens.operators.bundle import EncoderConfig
from eventlens.session import materialize
from eventlens.sources import bundles, shards, tables

T0 = dt.datetime(2024, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


EVENT_SCHEMA = (
    "entity_id string, event_id string, created_at timestamp, type string, amount double, currency string, "
    "direction string, channel string, mcc string, counterparty_id string, merchant_name string, "
    "description string, view string, source_currency string"
)
PROFILE_SCHEMA = (
    "entity_id string, signup_at timestamp, country string, plan string, kyc_level string, age_band string, "
    "balance_quantile string, is_active boolean, first_topup_at timestamp, first_card_payment_at timestamp, "
    "first_p2p_at timestamp, _label boolean"
)


def event(entity, i, when, kind, **values):
    names = [c.split()[0] for c in EVENT_SCHEMA.split(", ")][4:]
    return (entity, f"e{i:03d}", when, kind, *[values.get(n) for n in names])


@pytest.fixture(scope="module")
def bank(spark):
    rows = []
    i = 0
    for n in range(40):
        entity = f"c{n:02d}"
        for k in range(n % 7):
            i += 1
            rows.append(
                event(entity, i, day(k), "card_payment", amount=float(n * k) / 4, currency="EUR", direction="out",
                      mcc=str(5000 + k), merchant_name=f"Corner Shop {k}", description="weekly groceries and more"))
        if n % 5 == 0:
            i += 1
            rows.append(event(entity, i, day(9), "app_event", view="home"))
    events = spark.createDataFrame(rows, EVENT_SCHEMA)
    profile = spark.createDataFrame(
        [(f"c{n:02d}", day(-n), "GB", "plus", "full", None if n % 2 else "18-25", "q1", n % 3 == 0, None,
          day(0) if n % 7 else None, None, True) for n in range(40)],
        PROFILE_SCHEMA,
    )
    return materialize(events, "bank-events"), materialize(profile, "bank-profile")


@pytest.fixture(scope="module")
def bundle(bank):
    return fit.fit(bank[0], bank[1], R.banking(), EncoderConfig(bpe_vocab_size=280))


# -- registry ------------------------------------------------------------------------


def test_declarations_are_checked():
    reg = R.Registry().add_field(R.Field("a", R.NUMERICAL, aliases=("b",)))
    for bad in (R.Field("a", R.TEXT), R.Field("b", R.TEXT), R.Field("c", R.TEXT, aliases=("a",)), R.Field("d", "odd")):
        with pytest.raises(ValueError):
            reg.add_field(bad)
    with pytest.raises(ValueError):
        reg.add_family(R.Family("f", ("zzz",)))
    with pytest.raises(ValueError):
        reg.add_family(R.Family("f", ("a",))).add_family(R.Family("f"))
    with pytest.raises(ValueError):
        reg.add_profile_key("zzz")
    assert reg.resolve("b") == "a" and reg.resolve("x") is None
    with pytest.raises(KeyError):
        reg.field("x")


def test_ids_and_clocks_are_never_masked():
    reg = R.banking()
    assert not reg.field("event_id").can_mask and not reg.field("event_time").can_mask
    assert reg.field("amount").can_mask and reg.field("counterparty_id").regulated


def test_banking_key_ids():
    keys = R.banking().token_keys()
    assert keys[0] == "age_band" and keys[-1] == "view" and len(keys) == 20
    assert "created_at" not in keys and "counterparty_id" not in keys and "signup_at" in keys


def test_two_columns_for_one_key(spark):
    df = spark.createDataFrame([(1, 2)], "type string, event_type string")
    with pytest.raises(ValueError):
        tables.resolve_columns(df, R.banking())


def test_validation_rules(spark):
    rows = [
        event("c", 1, T0, "topup", amount=1.0, currency="EUR", direction="in"),
        event("c", 2, T0, "app_event", view="home", amount=3.0),
        event("c", 3, T0, "lottery"),
        event("c", 4, T0, "atm_withdrawal", amount=1.0, currency=None, direction="out", channel="cash"),
    ]
    df = spark.createDataFrame(rows, EVENT_SCHEMA)
    got = {(r["event_id"], r["issue"]) for r in validate.event_issues(df, R.banking()).collect()}
    assert got == {
        ("e001", "missing required field 'channel' for 'topup'"),
        ("e002", "field 'amount' not allowed on event family 'app_event'"),
        ("e003", "unknown event family: 'lottery'"),
        ("e004", "missing required field 'currency' for 'atm_withdrawal'"),
    }
    kept = validate.event_issues(df.where("event_id = 'e004'"), R.banking(), nulls="keep")
    texts = [r["issue"] for r in kept.collect()]
    assert "missing required field 'currency' for 'atm_withdrawal'" in texts
    assert "null not allowed for field 'currency' on 'atm_withdrawal'" in texts
    with pytest.raises(ValueError):
        validate.event_issues(df, R.banking(), nulls="other")


def test_clean_corpus_passes(bank):
    report = validate.corpus_report(
        bank[0], bank[1], R.banking(), {"first_card_payment_at": "card_payment"}
    ).first()
    assert report["passed"] and report["n_entities"] == 40 and report["n_schema_issues"] == 0


# -- numbers, clocks, labels -------------------------------------------------------------


def test_bucket_search_equals_count(spark):
    bounds = [1.0, 2.0, 2.5, 7.0, 9.0, 11.0, 30.0]
    values = [-5.0, 0.5, 1.0, 2.0, 2.2, 2.5, 8.0, 9.0, 29.9, 30.0, 99.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(bucket_index(F.col("v"), bounds)).collect()]
    assert got == [sum(b <= v for b in bounds) for v in values]


def test_numeric_ids(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (5.0,), (1e9,), (-3.0,), (None,)], "v double")
    ids = [r[0] for r in df.select(numeric_token(F.col("v"), [5.0, 6.0], 10, 3)).collect()]
    assert ids == [10, 10, 12, 13, 11, None]
    assert [r[0] for r in df.select(numeric_token(F.col("v"), [], 10, 3)).collect()] == [10, 10, 11, 11, 11, None]
    assert [r[0] for r in df.select(numeric_token(F.col("v"), [1.0, 2.0], 10, 2)).collect()][3] == 12


def test_length_labels(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 49, 50, 1000)], "n int")
    got = [r[0] for r in df.select(length_label(F.col("n"))).collect()]
    assert got == ["0-0", "1-49", "1-49", "50-499", "500+"]


def test_soft_log(spark):
    df = spark.createDataFrame([(0.0,), (80.0,)], "t double")
    assert [r[0] for r in df.select(soft_log(F.col("t"))).collect()] == [0.0, 8 * math.log1p(10)]
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([(-1.0,)], "t double").select(soft_log(F.col("t"))).collect()


def test_calendar_of_a_monday_midnight(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "t timestamp")
    row = df.select(*[c.alias(n) for n, c in calendar(F.col("t")).items()]).first()
    assert row.asDict() == {"hour_sin": 0.0, "hour_cos": 1.0, "dow_sin": 0.0, "dow_cos": 1.0, "dom_sin": 0.0, "dom_cos": 1.0}


# -- records and splits --------------------------------------------------------------------


def test_split_config():
    for bad in (dict(train_frac=1.0), dict(train_frac=0.9, val_frac=0.1), dict(val_frac=-0.1), dict(train_frac=0.0)):
        with pytest.raises(ValueError):
            split.SplitConfig(**bad)


def test_split_is_stable_and_complete(spark):
    import hashlib

    ids = spark.range(500).select(F.col("id").cast("string").alias("entity_id"))
    got = {r[0]: r[1] for r in ids.select("entity_id", split.split_of(F.col("entity_id"))).collect()}
    for i, name in got.items():
        place = int(hashlib.sha256(f"20260101:{i}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
        assert name == ("train" if place < 0.8 else "val" if place < 0.8 + 0.1 else "test")


def test_fingerprints(spark):
    import hashlib
    from itertools import groupby

    def folded(ids):
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        level = sorted((sha(i), i) for i in ids)
        for width in range(split.DEPTH, -1, -1):
            level = sorted((p[:width], item) for p, item in level)
            level = [(p, sha("|".join(i for _, i in g))) for p, g in groupby(level, key=lambda x: x[0])]
        return level[0][1]

    ids = spark.range(300).select(F.col("id").cast("string").alias("entity_id"))
    got = split.tree_fingerprint(ids).first()[0]
    assert got == folded([str(i) for i in range(300)]) == split.tree_fingerprint(ids.repartition(5)).first()[0]
    assert got != split.tree_fingerprint(ids.where("entity_id <> '7'")).first()[0]
    many = spark.range(120_000).select(F.col("id").cast("string").alias("entity_id"))
    assert split.tree_fingerprint(many).first()[0] == folded([str(i) for i in range(120_000)])


def test_long_ids_keep_all_digits(spark):
    from eventlens.sources import tables

    ids = [123456789012, 123456789013, 9, 2**63 - 1]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "k bigint").select(tables.padded("k")).collect()]
    assert [int(x) for x in got] == ids and sorted(got) == [f"{i:020d}" for i in sorted(ids)]


def test_amounts_are_summed_as_given(spark):
    from eventlens.operators import features

    rows = spark.createDataFrame([("a", "x", 0.004), ("a", "x", 0.004), ("a", "x", 0.004)], "entity_id string, type string, amount double")
    assert float(features.amount_sums(rows).first()["total"]) == pytest.approx(0.012, abs=1e-12)


def test_a_cluster_without_shared_folder_is_refused():
    from types import SimpleNamespace

    from eventlens import session

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    def fake(master, **conf):
        context = SimpleNamespace(master=master, getConf=lambda: Conf(conf), getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=Conf(conf, **{"spark.sql.warehouse.dir": "/w"}), sparkContext=context)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.shared_dir(fake(master))
        assert session.shared_dir(fake(master, **{"spark.checkpoint.dir": "s3://b/c/"})) == "s3://b/c"
    assert session.shared_dir(fake("local[2]")) == "/w"


def test_replaced_files_open_a_new_workspace(spark, tmp_path):
    from eventlens.plans.workspace import workspace

    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    first = workspace(spark, str(tmp_path))
    assert workspace(spark, str(tmp_path)) is first
    spark.range(30).write.mode("overwrite").parquet(str(tmp_path / "a.parquet"))
    assert workspace(spark, str(tmp_path)) is not first


def test_records_keep_entities_without_events(bank):
    rows = {r["entity_id"]: r for r in records.build_records(*bank, R.banking().milestone_keys).collect()}
    assert len(rows) == 40
    assert rows["c07"]["n_events"] == 0 and rows["c07"]["evaluation_time"] == day(-7)
    assert rows["c01"]["evaluation_time"] == day(0) if rows["c01"]["n_events"] else True
    late = bank[1].select("entity_id", F.lit(day(-100)).alias("evaluation_time"))
    early = records.build_records(*bank, R.banking().milestone_keys, points=late)
    assert early.where("n_events > 0 or signup_at is not null or first_card_payment_at is not null").count() == 0


def test_orphan_events_are_left_out(bank):
    few = bank[1].where("entity_id < 'c10'")
    assert records.restrict_to_profile(bank[0], few).where("entity_id >= 'c10'").count() == 0


def test_missing_label_stops(spark, bank):
    labels = bank[1].select("entity_id", F.col("_label").alias("label")).where("entity_id <> 'c03'")
    with pytest.raises(Exception, match="no label for entity c03"):
        records.attach_labels(bank[1].select("entity_id"), labels).collect()


# -- encoding --------------------------------------------------------------------------------


def encoded(bank, bundle):
    return encode.encode_events(history.keep_recent(bank[0], bundle.config.max_history_events), bundle)


def test_caps_must_be_positive(bank):
    for name in ("max_history_events", "max_event_tokens", "max_profile_tokens", "max_within_field_tokens"):
        with pytest.raises(ValueError):
            EncoderConfig(**{name: 0})
    with pytest.raises(ValueError):
        EncoderConfig(n_numeric_buckets=1)
    with pytest.raises(ValueError):
        history.keep_recent(bank[0], 0)


def test_fit_needs_training_records(bank):
    with pytest.raises(ValueError):
        fit.fit(bank[0].limit(0), bank[1], R.banking())


def test_event_tokens(bank, bundle):
    row = encoded(bank, bundle).where("size(key_ids) > 4").orderBy("event_id").first()
    names = {i: k for k, i in bundle.key_ids.items()}
    keys = [names[k] for k in row["key_ids"]]
    assert keys[:4] == ["amount", "currency", "direction", "mcc"]
    assert "counterparty_id" not in keys and "type" not in keys
    # One key id per piece, positions from 0, at most eight pieces a field.
    assert sum(row["field_lengths"]) == len(row["value_ids"]) == len(row["within_field_pos"])
    assert max(row["field_lengths"]) <= 8
    start = 0
    for n in row["field_lengths"]:
        assert row["within_field_pos"][start : start + n] == list(range(n))
        assert len(set(row["key_ids"][start : start + n])) == 1
        start += n
    assert all(i < bundle.total_size for i in row["value_ids"])


def test_whole_fields_are_cut(bank, bundle):
    small = bundle.with_config(max_event_tokens=6)
    rows = encoded(bank, small).where("truncated").collect()
    assert rows
    for r in rows:
        assert len(r["value_ids"]) <= 6 and sum(r["field_lengths"]) == len(r["value_ids"])


def test_empty_text_is_unknown(spark, bundle):
    df = spark.createDataFrame([event("c", 1, T0, "direct_debit", merchant_name="", description="x")], EVENT_SCHEMA)
    row = encode.encode_events(history.keep_recent(df, 5), bundle).first()
    assert row["value_ids"][0] == 1 and row["field_lengths"] == [1, 1]


def test_unseen_category_is_unknown(spark, bundle):
    df = spark.createDataFrame([event("c", 1, T0, "app_event", view="never seen", currency="EUR")], EVENT_SCHEMA)
    row = encode.encode_events(history.keep_recent(df, 5), bundle).first()
    assert row["value_ids"][0] > 1 and row["value_ids"][1] == 1


def test_profile_tokens(bank, bundle):
    recs = records.build_records(*bank, R.banking().milestone_keys)
    rows = {r["entity_id"]: r for r in encode.encode_profile(recs, bundle).collect()}
    names = {i: k for k, i in bundle.key_ids.items()}
    full, sparse = rows["c02"], rows["c01"]
    keys = [names[k] for k in full["profile_key_ids"]]
    assert keys == sorted(keys) and "age_band" in keys
    assert "age_band" not in [names[k] for k in sparse["profile_key_ids"]]
    values = dict(zip(keys, full["profile_value_ids"]))
    times = dict(zip(keys, full["profile_time_coords"]))
    assert values["signup_at"] == 5 and values["first_p2p_at"] == 6 and values["country"] == 1
    assert times["first_p2p_at"] == 0.0 and times["country"] == 0.0 and times["signup_at"] > 0
    capped = encode.encode_profile(recs, bundle.with_config(max_profile_tokens=3)).first()
    assert len(capped["profile_key_ids"]) == 3 == len(capped["profile_time_coords"])


def test_profile_values_can_join_the_fit(bank):
    reg = R.banking()
    config = EncoderConfig(fit_scopes=("event", "profile"), include_type=True, bpe_vocab_size=257)
    wide = fit.fit(*bank, reg, config)
    words = {(r["key"], r["value"]) for r in wide.categories.collect()}
    assert ("country", "GB") in words and ("type", "card_payment") in words and ("is_active", "True") in words
    recs = records.build_records(*bank, reg.milestone_keys)
    row = encode.encode_profile(recs, wide).first()
    assert 1 not in row["profile_value_ids"]


def test_history_cap_keeps_the_newest(bank, bundle):
    kept = history.keep_recent(bank[0], 2)
    best = bank[0].groupBy("entity_id").agg(F.max("created_at").alias("m"))
    assert kept.groupBy("entity_id").agg(F.max("created_at").alias("m")).exceptAll(best).count() == 0
    assert kept.where("event_ord < 0 or event_ord > 1").count() == 0


# -- stored form --------------------------------------------------------------------------------


def nested(bank, bundle):
    recs = records.with_events(records.build_records(*bank, R.banking().milestone_keys))
    return encode.assemble(encode.encode_profile(recs, bundle), encoded(bank, bundle))


def test_blocks_name_what_changed(spark, bank, bundle, tmp_path, monkeypatch):
    """Files too large for one row are held against runs of their records."""
    rows = materialize(nested(bank, bundle), "nested-blocks")
    monkeypatch.setattr(shards, "WHOLE_FILE_BYTES", 0)
    monkeypatch.setattr(shards, "RECORDS_PER_BLOCK", 4)
    path = str(tmp_path / "blocks")
    manifest = shards.write_shards(rows, path).collect()
    assert all(m["sha256"] is None for m in manifest) and shards.checksum_mismatches(spark, path).count() == 0
    stated = spark.read.schema(shards.BLOCK_SCHEMA).parquet(f"{path}/blocks").collect()
    assert sum(b["n_records"] for b in stated) == rows.count() and max(b["block"] for b in stated) > 0
    assert all(b["n_records"] <= 4 for b in stated)
    assert shards.read_shards(spark, path).count() == shards.read_shards(spark, path, verify="content").count() == rows.count()
    victim = max(manifest, key=lambda m: m["n_records"])
    file = tmp_path / "blocks" / "records" / victim["path"]
    (file.parent / f".{file.name}.crc").unlink()
    whole = pq.ParquetFile(file).read()
    changed = [v + (i == 5) for i, v in enumerate(whole["n_events_kept"].to_pylist())]
    pq.write_table(whole.set_column(whole.column_names.index("n_events_kept"), "n_events_kept", pa.array(changed, pa.int64())), file)
    assert [tuple(b) for b in shards.block_mismatches(spark, path).collect()] == [(victim["path"], 1)]
    for asked in ({}, {"split": victim["split"], "verify": "content"}):
        with pytest.raises(ValueError, match="differs in block 1"):
            shards.read_shards(spark, path, **asked)
    raw = file.read_bytes()
    file.write_bytes(raw[: len(raw) // 2])  # cannot be decoded at all
    assert {b["path"] for b in shards.block_mismatches(spark, path).collect()} == {victim["path"]}
    with pytest.raises(ValueError, match="differs in block 0"):
        shards.read_shards(spark, path)
    file.unlink()
    assert shards.block_mismatches(spark, path).count() == len({b["block"] for b in stated if b["path"] == victim["path"]})


def test_shards_round_trip_and_corruption(spark, bank, bundle, tmp_path):
    rows = materialize(nested(bank, bundle), "nested")
    path = str(tmp_path / "shards")
    manifest = shards.write_shards(rows, path, fingerprint="abc").collect()
    assert sum(m["n_records"] for m in manifest) == rows.count()
    assert {m["processor_train_fingerprint"] for m in manifest} == {"abc"}
    back = shards.read_shards(spark, path)
    assert back.drop("length_bucket").exceptAll(rows).count() == 0 and back.count() == rows.count()
    assert back.select("split").distinct().count() > 1
    one = shards.read_shards(spark, path, "val")
    assert {r["split"] for r in one.select("split").distinct().collect()} == {"val"}
    victim = next(m["path"] for m in manifest if m["path"].startswith("split=train/"))
    file = tmp_path / "shards" / "records" / victim
    file.write_bytes(file.read_bytes()[:-1] + b"x")
    # The local file system keeps a checksum of its own, which a shared store does not.
    (file.parent / f".{file.name}.crc").unlink()
    with pytest.raises(ValueError, match="checksum mismatch"):
        shards.read_shards(spark, path)
    assert shards.read_shards(spark, path, "val").count() == one.count()


def test_rewritten_rows_change_the_content_hash(spark, bank, bundle, tmp_path):
    rows = materialize(nested(bank, bundle), "nested")
    a = shards.write_shards(rows, str(tmp_path / "a"))
    b = shards.write_shards(rows.withColumn("n_events_total", F.col("n_events_total") + 1), str(tmp_path / "b"))
    keys = ["split", "length_bucket"]
    sums = [x.groupBy(*keys).agg(F.bit_xor("content_hash").alias("h")) for x in (a, b)]
    assert sums[0].join(sums[1], [*keys, "h"]).count() == 0


def test_field_groups(bank, bundle):
    groups = encode.field_groups(nested(bank, bundle))
    want = encoded(bank, bundle).agg(F.sum(F.size("field_lengths"))).first()[0]
    assert groups.count() == want
    assert groups.where("size(array_distinct(key_ids)) <> 1 or positions[0] <> 0").count() == 0


def test_bundle_round_trip(spark, bank, bundle, tmp_path):
    path = str(tmp_path / "bundle")
    bundles.save_bundle(bundle, spark, path)
    loaded = bundles.load_bundle(spark, path, R.banking())
    assert loaded.merges == bundle.merges and loaded.numeric_bounds == bundle.numeric_bounds
    assert loaded.total_size == bundle.total_size and loaded.config == bundle.config
    a, b = encoded(bank, bundle), encoded(bank, loaded)
    assert a.exceptAll(b).count() == 0
    good = bundles.bundle_hash(bundle, spark)
    bundles.require_same_bundle(loaded, spark, good)
    with pytest.raises(ValueError):
        bundles.require_same_bundle(loaded.with_config(n_numeric_buckets=8), spark, good)


def test_other_schema_version_is_refused(spark, bundle, tmp_path, monkeypatch):
    monkeypatch.setattr(bundles, "SCHEMA_VERSION", 99)
    bundles.save_bundle(bundle, spark, str(tmp_path / "b"))
    monkeypatch.undo()
    with pytest.raises(ValueError):
        bundles.load_bundle(spark, str(tmp_path / "b"), R.banking())
