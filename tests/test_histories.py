"""Histories written once by entity, and events sent to their batch."""

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from eventlens.functions.hashing import below, digest, uniform
from eventlens.operators import batch, encode, features, history, mask
from eventlens.plans.workspace import Workspace
from eventlens.session import OPEN_FILES

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _events(spark):
    rows = [("a", i % 7, f"e{i:03d}") for i in range(40)] + [("b", 1, "f1"), ("b", None, "f2"), ("c", None, "g")]
    df = spark.createDataFrame(rows, "entity_id string, day int, event_id string")
    return df.select("entity_id", "event_id", F.timestamp_seconds(F.col("day") * 86400).alias("created_at"))


def test_placed_history_gives_the_newest_rows(spark):
    events = _events(spark)
    cols = ["entity_id", "event_id", "created_at", "event_ord", "latest_at"]
    for heavy in ([], [("a", 40)]):
        placed = history.placed_history(events, heavy)
        assert placed.count() == 43
        for n in (1, 5, 100):
            got = history.newest_placed(placed, n, heavy, rows_per_task=10).select(*cols).collect()
            assert sorted(got, key=str) == sorted(history.keep_recent(events, n, []).select(*cols).collect(), key=str)


def test_history_is_joined_once_and_read_in_place(spark):
    b = Workspace(spark, FOLDER).commerce
    encoded = b.encoded()
    assert "lineitem" not in _plan(encoded) and "Window" not in _plan(encoded)
    assert "Exchange hashpartitioning" not in _plan(b.stored_history.groupBy("entity_id").count())
    assert b.stored_history.count() == b.history.count()


def test_heavy_entities_are_written_apart_with_the_same_encoding(spark):
    plain, other = Workspace(spark, FOLDER).app, Workspace(spark, FOLDER).app
    top = plain.history.groupBy("entity_id").count().orderBy(F.desc("count"), "entity_id").first()
    other.__dict__["heavy"] = [tuple(top)]
    assert other.stored_history.where("age_rank is null").count() == top["count"]
    a, b = plain.encoded(), other.encoded()
    assert a.exceptAll(b.select(*a.columns)).count() == 0 and a.count() == b.count()


def test_context_is_shuffled_alike_from_events_in_batches(spark):
    b = Workspace(spark, FOLDER).app
    from_tokens = batch.shuffle_context(b.masked(), b.batches)
    placed = mask.mask_tokens(batch.in_batches(b.stored, b.batches), b.bundle, mask.MaskConfig(), 0, "batch_id", "rec")
    from_events = batch.shuffle_context(placed)
    cols = ["batch_id", "event_id", "tok_ord", "label", "new_input_id"]
    assert from_tokens.select(*cols).exceptAll(from_events.select(*cols)).count() == 0
    assert from_tokens.count() == from_events.count() == b.masked().count()
    assert _plan(from_events).count("Join") == 1  # events with their place; tokens meet nothing


def test_token_differences_are_counted_per_token(spark):
    kinds = "entity_id string, event_ord int, key_ids array<int>, value_ids array<int>"
    source = spark.createDataFrame([("a", 0, [1, 2], [5, 6]), ("a", 1, [1], [7]), ("b", 0, [], []), ("c", 0, [1, 1], [9, 9])], kinds)
    again = spark.createDataFrame([("a", 0, [1, 2], [5, 8]), ("a", 1, [1], [7]), ("c", 0, [1], [9]), ("d", 3, [4, 4], [1, 1])], kinds)
    assert batch.token_differences(source, source).first() == (5, 0, 0)
    assert batch.token_differences(source, again).first() == (5, 2, 3)


def test_history_is_sorted_once(spark, monkeypatch):
    b = Workspace(spark, FOLDER).commerce
    plans, open_files, save = [], [], DataFrameWriter.saveAsTable

    def noted(writer, *args, **kw):
        plans.append(_plan(writer._df))
        open_files.append(int(spark.conf.get(OPEN_FILES)))
        return save(writer, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", noted)
    before = spark.conf.get(OPEN_FILES)
    assert b.stored_history.count() == b.history.count()
    assert len(plans) == 1 and plans[0].count("Window [") == 1 and "SortMergeJoin [entity_id" not in plans[0]
    assert open_files[0] > 0 and spark.conf.get(OPEN_FILES) == before  # with files open, rows are not sorted by bucket


def test_heavy_entities_are_named_without_lookups(spark):
    b = Workspace(spark, FOLDER).commerce
    assert "part.parquet" in _plan(b.events)
    assert not any(f"{name}.parquet" in _plan(b.owners) for name in ("part", "supplier"))
    assert sorted(b.owners.groupBy("entity_id").count().collect()) == sorted(b.events.groupBy("entity_id").count().collect())


def test_masks_read_events_once(spark):
    b = Workspace(spark, FOLDER).app
    masked = b.masked()
    assert "stored" not in b.__dict__
    written = mask.mask_tokens(b.stored, b.bundle)
    assert masked.exceptAll(written).count() == 0 and masked.count() == written.count()
    found = mask.marginal_difficulty(masked, encode.event_tokens(b.encoded()), b.bundle)
    assert _plan(found).count("posexplode") == 1  # the training tokens were counted once, before


def test_hex_digits_compare_like_the_uniform(spark):
    rows = spark.range(3000).select(digest(7, F.col("id")).alias("d")).unionByName(spark.createDataFrame([(None,), ("0" * 64,), ("f" * 64,)], "d string"))
    for p in (0.0, 1e-12, 0.05, 0.1, 0.15, 0.5, 0.999, 1.0):
        for word in (0, 1):
            assert rows.where(~below(F.col("d"), p, word).eqNullSafe(uniform(F.col("d"), word) < p)).count() == 0


def test_escalating_labels_read_events_once(spark):
    b = Workspace(spark, FOLDER).commerce
    plain = features.escalating_labels(b.events, b.ws.profile, [])
    heavy = features.escalating_labels(b.events, b.ws.profile, [tuple(b.owners.groupBy("entity_id").count().first())])
    assert _plan(plain).count("lineitem.parquet") == 1
    assert plain.exceptAll(heavy).count() == 0 and plain.count() == heavy.count()
