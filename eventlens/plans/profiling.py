"""Profiling reports over events, records and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.operators import features
from eventlens.operators.profiling import describe, histogram, shares
from eventlens.plans.catalog import query
from eventlens.plans.reference_sql import median_sql
from eventlens.plans.scoring import LONG_FROM
from eventlens.plans.workspace import Workspace
from eventlens.session import materialize, new_path
from eventlens.sources import shards


@query("SELECT type, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share FROM (SELECT type, count(*) AS n FROM ev_app GROUP BY 1)")
def event_type_mix(ws: Workspace) -> DataFrame:
    return shares(ws.app.events, "type")


def describe_sql(source: str, by: str) -> str:
    """``source`` is a named table (by, column, v)."""
    both = f'{by}, "column"'
    quart = " ".join(
        f'LEFT JOIN ({median_sql(source, both, "v", f)}) q{i} USING ({both})'
        for i, f in enumerate(("0.25", "0.5", "0.75"))
    )
    return f"""SELECT {by}, "column", n, round(mean, 6) AS mean, round(std, 6) AS std, lo AS min, hi AS max,
        round(q0.q, 6) AS p25, round(q1.q, 6) AS p50, round(q2.q, 6) AS p75
      FROM (SELECT {both}, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS lo, max(v) AS hi FROM {source} GROUP BY ALL) {quart}"""


@query(f"""WITH long AS (SELECT cohort, 'n_events' AS "column", n_events::DOUBLE AS v FROM cohort_com)
          {describe_sql('long', 'cohort')}""")
def history_lengths(ws: Workspace) -> DataFrame:
    """Events per entity by cohort, entities without events included."""
    rows = materialize(features.cohorts(ws.commerce.events, ws.profile, LONG_FROM), "cohorts")
    return describe(rows, ["cohort"], ["n_events"])


@query("SELECT split, count(*) AS n FROM rec_app GROUP BY 1")
def split_sizes(ws: Workspace) -> DataFrame:
    return ws.app.records.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH long AS (SELECT split, unnest(['n_events', 'n_value_tokens']) AS "column", unnest([n_events, n_value_tokens])::DOUBLE AS v FROM sizes_com)
          {describe_sql('long', 'split')}""")
def record_sizes_by_split(ws: Workspace) -> DataFrame:
    sizes = materialize(ws.commerce.sizes(), "record-sizes")
    return describe(sizes, ["split"], ["n_events", "n_value_tokens"])


@query("""
  WITH e AS (SELECT split, min(n_events)::DOUBLE AS lo, max(n_events)::DOUBLE AS hi FROM sizes_com GROUP BY 1),
  p AS (SELECT split, CASE WHEN hi = lo THEN 0 ELSE least(floor((n_events - lo) / ((hi - lo) / 30)), 29) END::BIGINT AS bin, count(*) AS n
        FROM sizes_com JOIN e USING (split) GROUP BY ALL)
  SELECT split, bin, round(lo + bin * ((hi - lo) / 30), 6) AS low, round(lo + (bin + 1) * ((hi - lo) / 30), 6) AS high, coalesce(n, 0) AS n
  FROM (SELECT *, unnest(range(0, 30)) AS bin FROM e) LEFT JOIN p USING (split, bin)""")
def event_count_histogram(ws: Workspace) -> DataFrame:
    sizes = materialize(ws.commerce.sizes().select("split", "n_events"), "record-sizes")
    return histogram(sizes, "split", "n_events")


@query("""SELECT split, sum(n_value_tokens)::BIGINT AS n_value_tokens, count(*) AS n_records, count(DISTINCT length_bucket) AS n_groups FROM sizes_com GROUP BY 1""")
def split_totals(ws: Workspace) -> DataFrame:
    return ws.commerce.sizes().groupBy("split").agg(
        F.sum("n_value_tokens").alias("n_value_tokens"),
        F.count(F.lit(1)).alias("n_records"),
        F.countDistinct("length_bucket").alias("n_groups"),
    )


@query("""SELECT 'corpus' AS section, 'entities' AS item, count(*) AS n FROM prof UNION ALL SELECT 'corpus', 'events', count(*) FROM ev_com
          UNION ALL SELECT 'family', type, count(*) FROM ev_com GROUP BY type UNION ALL SELECT 'cohort', cohort, count(*) FROM cohort_com GROUP BY cohort
          UNION ALL SELECT 'is_high_value', is_high_value::VARCHAR, count(*) FROM high_com GROUP BY ALL
          UNION ALL SELECT 'is_escalating', is_escalating::VARCHAR, count(*) FROM escal_com GROUP BY ALL""")
def corpus_manifest(ws: Workspace) -> DataFrame:
    b = ws.commerce
    labels = {
        "is_high_value": features.high_value_labels(b.events, ws.profile),
        "is_escalating": features.escalating_labels(b.events, ws.profile, b.heavy),
    }
    return features.corpus_manifest(
        b.events, ws.profile, features.cohorts(b.events, ws.profile, LONG_FROM), labels
    )


@query("SELECT count(*) FILTER (WHERE n_events > 0) AS n_records, 0::BIGINT AS n_without_events FROM rec_app")
def stored_zero_event_records(ws: Workspace) -> DataFrame:
    """Records without events among the shards written and read back."""
    path = new_path(ws.spark, "shards")
    shards.write_shards(ws.app.shards(), path, fingerprint=ws.app.bundle.train_fingerprint)
    return shards.read_shards(ws.spark, path).agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("n_events_kept") == 0).alias("n_without_events")
    )


@query("""
  WITH t AS (SELECT event_id, count(*) AS n FROM tok_com GROUP BY 1)
  SELECT split, (SELECT count(*) FROM rec_com r WHERE r.split = s.split AND n_events = 0) / (SELECT count(*) FROM rec_com r WHERE r.split = s.split)::DOUBLE AS dropped_rate,
         round(avg((n_events > 60)::INT), 6) AS history_truncated_rate, round(sum(cut) / sum(least(n_events, 60))::DOUBLE, 6) AS event_truncated_rate
  FROM (SELECT r.entity_id, r.split, r.n_events, count(*) FILTER (WHERE t.n > 3) AS cut FROM rec_com r
        JOIN (SELECT * FROM capped_com QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_ord DESC) <= 60) c ON c.entity_id = r.entity_id
        LEFT JOIN t ON t.event_id = c.event_id GROUP BY ALL) s GROUP BY split""".replace("AS dropped_rate", "AS dropped"))
def truncation_rates(ws: Workspace) -> DataFrame:
    """Rates of records dropped, histories cut at 60 events and events cut at three tokens."""
    b = ws.commerce
    small = b.bundle.with_config(max_event_tokens=3, max_history_events=60)
    events = b.encoded(small).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("truncated").alias("cut")
    )
    rows = b.records.select("entity_id", "split", "n_events").join(events, "entity_id", "left")
    some = F.col("n_events") > 0
    return rows.groupBy("split").agg(
        F.avg((~some).cast("double")).alias("dropped"),
        F.avg(F.when(some, (F.col("n_events") > 60).cast("double"))).alias("history_truncated_rate"),
        (F.sum("cut") / F.sum("n")).alias("event_truncated_rate"),
    )
