"""Reading, checking and splitting: raw tables, schema rules, records, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens import registry as R
from eventlens.operators import records, split, validate
from eventlens.plans.catalog import query
from eventlens.plans.reference_sql import split_sql, tree_sql
from eventlens.plans.workspace import MILESTONES, Workspace
from eventlens.session import new_path
from eventlens.sources import reports, tables
from eventlens.sources.tables import MILESTONE_FAMILIES

# -- sources ---------------------------------------------------------------------


@query("SELECT entity_id, event_id, epoch_us(created_at) AS created_at, type, round(amount, 6) AS amount, view FROM ev_app")
def read_app_events(ws: Workspace) -> DataFrame:
    return ws.app.events


@query("""SELECT entity_id, event_id, epoch_us(created_at) AS created_at, type, round(amount, 6) AS amount,
          round(discount, 6) AS discount, direction, channel, mcc, merchant_name, description FROM ev_com""")
def read_commerce_events(ws: Workspace) -> DataFrame:
    return ws.commerce.events


@query("""SELECT entity_id, country, plan, balance_quantile, epoch_us(signup_at) AS signup_at,
          epoch_us(first_purchase_at) AS first_purchase_at, epoch_us(first_view_at) AS first_view_at FROM prof""")
def read_profile_state(ws: Workspace) -> DataFrame:
    return ws.profile


@query(f"""SELECT entity_id, split, (i - 1)::BIGINT AS dim, round(embedding[i]::DOUBLE, 6) AS x
          FROM vec, (SELECT unnest(range(1, 65)) AS i) WHERE split IN ('train', 'val')""")
def stacked_embeddings(ws: Workspace) -> DataFrame:
    """Train and val vectors written as two tables, read back and stacked."""
    raw = ws.vectors.withColumn("split", split.split_of(F.col("entity_id")))
    paths = []
    for part in ("train", "val"):
        paths.append(new_path(ws.spark, f"embeddings-{part}"))
        reports.write_embeddings(raw.where(F.col("split") == part).drop("label"), paths[-1])
    both = reports.read_embeddings(ws.spark, *paths)
    return both.select("entity_id", "split", F.posexplode("concat").alias("dim", "x"))


@query("""SELECT type, n, round(share, 6) AS share FROM (
          SELECT type, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM ev_com GROUP BY 1)""")
def report_round_trip(ws: Workspace) -> DataFrame:
    """A report written as CSV and as JSON; the rows both give back."""
    from eventlens.operators.profiling import shares

    report = shares(ws.commerce.events, "type")
    schema = "type string, n bigint, share double"
    csv, json = new_path(ws.spark, "report"), new_path(ws.spark, "report")
    reports.write_report(report, csv, "csv")
    reports.write_report(report, json, "json")
    return reports.read_report(ws.spark, csv, schema, "csv").intersect(
        reports.read_report(ws.spark, json, schema, "json").select("type", "n", "share")
    )


# -- schema ------------------------------------------------------------------------


@query("SELECT user_id AS entity_id, event_id, epoch_us(ts) AS created_at, event_type AS type, round(value, 6) AS amount FROM events")
def resolved_columns(ws: Workspace) -> DataFrame:
    return tables.resolve_columns(ws.table("events"), ws.app.registry)


@query("""SELECT problem, type, key, count(e.event_id) AS n_events FROM (VALUES
            ('undeclared field', 'click', 'clicked_at'), ('undeclared field', 'purchase', 'basket_id'),
            ('duplicate key', NULL, 'amount'), ('ambiguous name', NULL, 'value')) p(problem, type, key)
          LEFT JOIN ev_app e USING (type) GROUP BY ALL""")
def registry_problems(ws: Workspace) -> DataFrame:
    """Problems of a loosely declared schema, with the events each family problem touches."""
    spark = ws.spark
    policies = ws.app.registry.policies(spark).select("key", "kind")
    policies = policies.unionByName(spark.createDataFrame([("amount", R.NUMERICAL)], "key string, kind string"))
    aliases = ws.app.registry.aliases(spark).unionByName(
        spark.createDataFrame([("value", "view")], "source_name string, key string")
    )
    families = ws.app.registry.family_fields(spark).unionByName(
        spark.createDataFrame(
            [("click", "clicked_at", False), ("purchase", "basket_id", True)],
            "type string, key string, required boolean",
        )
    )
    problems = R.integrity_issues(policies, aliases, families)
    touched = ws.app.events.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return problems.join(touched, "type", "left").select(
        "problem", "type", "key", F.coalesce("n", F.lit(0)).alias("n_events")
    )


@query("SELECT entity_id, event_id, type, field_ord::BIGINT AS field_ord, key, round(num, 6) AS num, txt FROM long_com")
def event_fields(ws: Workspace) -> DataFrame:
    return validate.fields_long(ws.commerce.history, ws.commerce.registry).drop("created_at")


@query("""
  SELECT entity_id, event_id, 'unknown event family: ''' || type || '''' AS issue FROM ev_app WHERE type = 'signup'
  UNION ALL SELECT entity_id, event_id, 'missing required field ''country'' for ''purchase''' FROM ev_app WHERE type = 'purchase'
  UNION ALL SELECT entity_id, event_id, 'missing required field ''amount'' for ''' || type || '''' FROM ev_app
            WHERE type IN ('click', 'purchase') AND amount IS NULL
  UNION ALL SELECT entity_id, event_id, 'missing required field ''view'' for ''' || type || '''' FROM ev_app
            WHERE type IN ('error', 'view') AND view IS NULL
  UNION ALL SELECT entity_id, event_id, 'field ''amount'' not allowed on event family ''error''' FROM ev_app
            WHERE type = 'error' AND amount IS NOT NULL
  UNION ALL SELECT entity_id, event_id, 'unmapped source field ''device'' on event ''' || type || '''' FROM ev_app
            WHERE type <> 'signup' AND amount > 20""")
def event_schema_issues(ws: Workspace) -> DataFrame:
    """App events with one unmapped column, against the narrower schema."""
    events = ws.app.events.withColumn("device", F.when(F.col("amount") > 20, "phone"))
    return validate.event_issues(events, tables.strict_app_registry()).select("entity_id", "event_id", "issue")


@query("""
  SELECT event_id, 'missing required field ''channel'' for ''line''' AS issue FROM ev_com WHERE type = 'zzz'
  UNION ALL SELECT event_id, 'field ''discount'' not allowed on event family ''order''' FROM ev_com WHERE type = 'order'
  UNION ALL SELECT event_id, 'field ''mcc'' not allowed on event family ''order''' FROM ev_com WHERE type = 'order'
  UNION ALL SELECT event_id, 'field ''merchant_name'' not allowed on event family ''order''' FROM ev_com WHERE type = 'order'
  UNION ALL SELECT event_id, 'field ''description'' not allowed on event family ''order''' FROM ev_com WHERE type = 'order'
  UNION ALL SELECT event_id, 'field ''channel'' not allowed on event family ''line''' FROM ev_com WHERE type = 'line'""")
def event_schema_issues_null_kept(ws: Workspace) -> DataFrame:
    return validate.event_issues(ws.commerce.events, ws.commerce.registry, nulls="keep").select("event_id", "issue")


@query("""
  SELECT entity_id, 'field ''balance_quantile'' not a registered profile field' AS issue FROM prof WHERE balance_quantile IS NOT NULL
  UNION ALL SELECT entity_id, 'unmapped source field ''segment'' on profile state' FROM prof WHERE plan = 'MACHINERY'""")
def profile_schema_issues(ws: Workspace) -> DataFrame:
    profile = ws.profile.withColumn("segment", F.when(F.col("plan") == "MACHINERY", F.col("plan"))).withColumn(
        "_cohort", F.lit("not an input")
    )
    return validate.profile_issues(profile, tables.strict_app_registry()).select("entity_id", "issue")


@query("""
  WITH issues AS (
    SELECT 0 AS part, entity_id, epoch_us(created_at) AS at_us, event_id, ord, issue FROM (
      SELECT entity_id, created_at, event_id, 0 AS ord, 'unknown event family: ''' || type || '''' AS issue FROM ev_app WHERE type = 'signup'
      UNION ALL SELECT entity_id, created_at, event_id, 3, 'missing required field ''country'' for ''purchase''' FROM ev_app WHERE type = 'purchase'
      UNION ALL SELECT entity_id, created_at, event_id, 4, 'field ''amount'' not allowed on event family ''error''' FROM ev_app WHERE type = 'error')
    UNION ALL SELECT 1, entity_id, 0, '', 2, 'field ''balance_quantile'' not a registered profile field' FROM prof),
  wrong AS (
    SELECT m, f, count(*) AS n FROM (
      SELECT 'signup_at' AS m, 'signup' AS f, p.signup_at AS stated, min(created_at) AS earliest FROM prof p JOIN ev_app e USING (entity_id) WHERE type = 'signup' GROUP BY entity_id, signup_at
      UNION ALL SELECT 'first_purchase_at', 'purchase', p.first_purchase_at, min(created_at) FROM prof p JOIN ev_app e USING (entity_id) WHERE type = 'purchase' GROUP BY entity_id, first_purchase_at
      UNION ALL SELECT 'first_view_at', 'view', p.first_view_at, min(created_at) FROM prof p JOIN ev_app e USING (entity_id) WHERE type = 'view' GROUP BY entity_id, first_view_at)
    WHERE stated <> earliest GROUP BY 1, 2),
  leaks AS (
    SELECT 0 AS ord, count(*) || ' events occur before their entity''s signup_at' AS text
    FROM ev_app JOIN prof USING (entity_id) WHERE created_at < signup_at HAVING count(*) > 0
    UNION ALL SELECT CASE m WHEN 'signup_at' THEN 1 WHEN 'first_purchase_at' THEN 2 ELSE 3 END,
              n || ' entities have a ''' || m || ''' milestone inconsistent with their earliest ''' || f || ''' event' FROM wrong)
  SELECT (SELECT count(*) FROM issues) AS n_schema_issues,
         (SELECT string_agg(issue, '; ' ORDER BY part, entity_id, at_us, event_id, ord)
          FROM (SELECT * FROM issues ORDER BY part, entity_id, at_us, event_id, ord LIMIT 20)) AS schema_issues_sample,
         (SELECT count(*) FROM leaks) AS n_leakage_issues,
         (SELECT coalesce(string_agg(text, '; ' ORDER BY ord), '') FROM leaks) AS leakage_issues,
         (SELECT round(avg((amount IS NULL)::INT), 6) FROM ev_app) AS null_rate_amount,
         (SELECT round(avg((view IS NULL)::INT), 6) FROM ev_app) AS null_rate_view,
         (SELECT count(DISTINCT entity_id) FROM (SELECT entity_id FROM ev_app GROUP BY entity_id, created_at HAVING count(*) > 1))
           AS entities_with_duplicate_event_timestamps,
         (SELECT count(*) FROM ev_app) AS n_events, (SELECT count(*) FROM prof) AS n_entities,
         (SELECT count(*) FROM issues) = 0 AND (SELECT count(*) FROM leaks) = 0 AS passed""")
def corpus_report(ws: Workspace) -> DataFrame:
    return validate.corpus_report(
        ws.app.events, ws.profile, tables.strict_app_registry(), MILESTONE_FAMILIES, ws.app.heavy
    )


@query("SELECT entity_id, count(*) AS n_early FROM ev_com JOIN prof USING (entity_id) WHERE created_at < signup_at GROUP BY 1")
def events_before_signup(ws: Workspace) -> DataFrame:
    early = validate.events_before_signup(ws.commerce.events, ws.profile, ws.commerce.heavy)
    return early.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_early"))


@query("""
  SELECT milestone, count(*) FILTER (WHERE stated IS NOT NULL AND earliest IS NOT NULL) AS n_compared,
         count(*) FILTER (WHERE stated <> earliest) AS n_mismatched,
         count(*) FILTER (WHERE (stated IS NULL) <> (earliest IS NULL)) AS n_one_sided
  FROM (SELECT entity_id, unnest(['signup_at', 'first_purchase_at', 'first_view_at']) AS milestone,
               unnest([signup_at, first_purchase_at, first_view_at]) AS stated, unnest([s, p, v]) AS earliest
        FROM prof LEFT JOIN (SELECT entity_id, min(created_at) FILTER (WHERE type = 'signup') AS s,
                                    min(created_at) FILTER (WHERE type = 'purchase') AS p,
                                    min(created_at) FILTER (WHERE type = 'view') AS v FROM ev_app GROUP BY 1) USING (entity_id))
  GROUP BY 1""")
def milestone_checks(ws: Workspace) -> DataFrame:
    return validate.milestone_checks(ws.app.events, ws.profile, MILESTONE_FAMILIES, both_ways=True)


@query("""SELECT round(avg((amount IS NULL)::INT), 6) AS amount, round(avg((discount IS NULL)::INT), 6) AS discount,
          round(avg((direction IS NULL)::INT), 6) AS direction, round(avg((channel IS NULL)::INT), 6) AS channel,
          round(avg((mcc IS NULL)::INT), 6) AS mcc, round(avg((merchant_name IS NULL)::INT), 6) AS merchant_name,
          round(avg((description IS NULL)::INT), 6) AS description FROM ev_com""")
def null_rates(ws: Workspace) -> DataFrame:
    return validate.null_rates(ws.commerce.events)


@query("SELECT DISTINCT entity_id FROM (SELECT entity_id FROM ev_com GROUP BY entity_id, created_at HAVING count(*) > 1)")
def duplicate_timestamp_entities(ws: Workspace) -> DataFrame:
    return validate.duplicate_timestamp_entities(ws.commerce.events)


@query("""
  SELECT key, key NOT IN ('created_at', 'event_id', 'entity_id', 'signup_at', 'first_purchase_at', 'first_view_at') AS maskable,
         false AS regulated, key IN ('merchant_name', 'description') AS pii_risk, count(l.event_id) AS n_values
  FROM (VALUES ('entity_id'), ('event_id'), ('created_at'), ('type'), ('amount'), ('discount'), ('direction'), ('channel'),
        ('mcc'), ('merchant_name'), ('description'), ('country'), ('plan'), ('balance_quantile'), ('signup_at'),
        ('first_purchase_at'), ('first_view_at')) k(key) LEFT JOIN long_com l USING (key) GROUP BY key""")
def key_eligibility(ws: Workspace) -> DataFrame:
    used = (
        validate.fields_long(ws.commerce.history, ws.commerce.registry)
        .groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    )
    policies = ws.commerce.registry.policies(ws.spark)
    return policies.join(used, "key", "left").select(
        "key", "maskable", "regulated", "pii_risk", F.coalesce("n", F.lit(0)).alias("n_values")
    )


# -- records -------------------------------------------------------------------------


@query("""SELECT entity_id, epoch_us(coalesce(max(created_at), any_value(signup_at))) AS evaluation_time, count(event_id) AS n_events
          FROM prof LEFT JOIN ev_app USING (entity_id) GROUP BY 1""")
def evaluation_times(ws: Workspace) -> DataFrame:
    return records.evaluation_times(ws.app.events, ws.profile)


@query("""SELECT entity_id, split, epoch_us(evaluation_time) AS evaluation_time, n_events, country, plan, balance_quantile,
          epoch_us(signup_at) AS signup_at, epoch_us(first_purchase_at) AS first_purchase_at,
          epoch_us(first_view_at) AS first_view_at FROM rec_app""")
def point_in_time_records(ws: Workspace) -> DataFrame:
    return ws.app.records


@query("""SELECT entity_id, event_id FROM ev_com JOIN prof USING (entity_id)
          WHERE created_at <= signup_at + INTERVAL 1096 DAY""")
def events_as_of_cutoff(ws: Workspace) -> DataFrame:
    return records.events_as_of(ws.commerce.events, ws.cutoffs, ws.commerce.heavy).select("entity_id", "event_id")


POINTS_SQL = """
  SELECT entity_id, signup_at + to_days(d::INTEGER) AS at_eval
  FROM prof, (SELECT unnest([0, 200, 730, 1461, 10227]) AS d)
  WHERE (d <> 730 OR plan <> 'BUILDING') AND (d = 0 OR plan <> 'MACHINERY') AND plan <> 'FURNITURE'"""


@query("""
  SELECT p.entity_id, """ + split_sql("p.entity_id") + """ AS split, epoch_us(at_eval) AS evaluation_time, n_events, country, plan,
         balance_quantile, CASE WHEN signup_at <= at_eval THEN epoch_us(signup_at) END AS signup_at,
         CASE WHEN first_purchase_at <= at_eval THEN epoch_us(first_purchase_at) END AS first_purchase_at,
         CASE WHEN first_view_at <= at_eval THEN epoch_us(first_view_at) END AS first_view_at
  FROM prof p JOIN (
    SELECT q.entity_id, q.at_eval, count(e.event_id) AS n_events
    FROM (""" + POINTS_SQL + """) q LEFT JOIN ev_com e ON e.entity_id = q.entity_id AND e.created_at <= q.at_eval
    GROUP BY ALL
    UNION ALL
    SELECT d.entity_id, coalesce(max(e.created_at), any_value(d.signup_at)), count(e.event_id)
    FROM prof d LEFT JOIN ev_com e ON e.entity_id = d.entity_id WHERE d.plan = 'FURNITURE' GROUP BY 1
  ) r ON r.entity_id = p.entity_id""")
def records_at_points(ws: Workspace) -> DataFrame:
    """Records at several points per entity; one plan has no points and keeps its latest event."""
    return records.build_records(ws.commerce.events, ws.profile, MILESTONES, points=ws.several_points, heavy=ws.commerce.heavy)


HISTORY_CAP = 12


@query("""
  SELECT entity_id, event_id, epoch_us(at_eval) AS evaluation_time, epoch_us(latest_at) AS latest_at, n - age AS event_ord
  FROM (SELECT *, max(created_at) OVER (PARTITION BY entity_id, at_eval) AS latest_at,
               count(*) OVER (PARTITION BY entity_id, at_eval) AS n
        FROM (SELECT q.entity_id, q.at_eval, e.event_id, e.created_at,
                     row_number() OVER (PARTITION BY q.entity_id, q.at_eval ORDER BY e.created_at DESC, e.event_id DESC) AS age
              FROM (""" + POINTS_SQL + f""") q JOIN ev_com e ON e.entity_id = q.entity_id AND e.created_at <= q.at_eval)
        WHERE age <= {HISTORY_CAP})""")
def histories_at_points(ws: Workspace) -> DataFrame:
    """The newest events known at each of several points per entity."""
    found = records.record_events(ws.commerce.events, ws.several_points, HISTORY_CAP, ws.commerce.heavy)
    return found.select("entity_id", "event_id", "evaluation_time", "latest_at", "event_ord")


@query("""
  SELECT 0::BIGINT AS n_late_events, 0::BIGINT AS n_over_cap, 0::BIGINT AS n_with_gaps, count(*) AS n_histories
  FROM (SELECT DISTINCT q.entity_id, q.at_eval FROM (""" + POINTS_SQL + """) q
        JOIN ev_com e ON e.entity_id = q.entity_id AND e.created_at <= q.at_eval)""")
def histories_audit(ws: Workspace) -> DataFrame:
    found = records.record_events(ws.commerce.events, ws.several_points, HISTORY_CAP, ws.commerce.heavy)
    return records.history_audit(found, HISTORY_CAP)


@query("""SELECT entity_id, event_id, row_number() OVER (PARTITION BY entity_id ORDER BY created_at, event_id) - 1 AS event_ord FROM ev_com""")
def ordered_events(ws: Workspace) -> DataFrame:
    return records.order_events(ws.commerce.events, ws.commerce.heavy).select("entity_id", "event_id", "event_ord")


@query("""
  SELECT entity_id, split, epoch_us(at_eval) AS evaluation_time, n_events, country, plan, balance_quantile,
         CASE WHEN signup_at <= at_eval THEN epoch_us(signup_at) END AS signup_at,
         CASE WHEN first_purchase_at <= at_eval THEN epoch_us(first_purchase_at) END AS first_purchase_at,
         CASE WHEN first_view_at <= at_eval THEN epoch_us(first_view_at) END AS first_view_at
  FROM (SELECT p.*, """ + split_sql("p.entity_id") + """ AS split, signup_at + INTERVAL 10227 DAY AS at_eval,
               (SELECT count(*) FROM ev_app e WHERE e.entity_id = p.entity_id AND e.created_at <= p.signup_at + INTERVAL 10227 DAY) AS n_events
        FROM prof p)""")
def clipped_milestones(ws: Workspace) -> DataFrame:
    """Records at 28 years after signup: some first events lie after that and are not known."""
    points = ws.profile.select(
        "entity_id", (F.col("signup_at") + F.expr("interval 10227 days")).alias("evaluation_time")
    )
    return records.build_records(ws.app.events, ws.profile, MILESTONES, points=points)


@query("""SELECT entity_id, epoch_us(min(created_at) FILTER (WHERE type = 'order')) AS first_order_at,
          epoch_us(min(created_at) FILTER (WHERE type = 'line')) AS first_line_at FROM ev_com GROUP BY 1""")
def derived_milestones(ws: Workspace) -> DataFrame:
    return tables.milestone_times(ws.commerce.events, {"first_order_at": "order", "first_line_at": "line"})


@query("""SELECT entity_id, (unnest([0, 1, 2]))::BIGINT AS place, unnest(['signup_at', 'first_purchase_at', 'first_view_at']) AS key,
          unnest([epoch_us(signup_at), epoch_us(first_purchase_at), epoch_us(first_view_at)]) AS at_us FROM rec_com""")
def lifelong_events(ws: Workspace) -> DataFrame:
    pairs = ws.commerce.records.select(
        "entity_id", F.posexplode(records.lifelong_events(MILESTONES)).alias("place", "p")
    )
    return pairs.select("entity_id", "place", F.col("p.key").alias("key"), F.col("p.at").alias("at_us"))


@query("""SELECT split, count(*) FILTER (WHERE n_events > 0) AS n_kept, count(*) FILTER (WHERE n_events = 0) AS n_dropped
          FROM rec_app GROUP BY 1""")
def dropped_records(ws: Workspace) -> DataFrame:
    return records.dropped_counts(ws.app.records)


@query("""SELECT (SELECT count(*) FROM ev_com JOIN rec_com USING (entity_id) WHERE created_at > evaluation_time) AS n_late_events,
          (SELECT count(*) FILTER (WHERE signup_at > evaluation_time) + count(*) FILTER (WHERE first_purchase_at > evaluation_time)
                  + count(*) FILTER (WHERE first_view_at > evaluation_time) FROM rec_com) AS n_future_milestones,
          (SELECT count(*) FROM rec_com) AS n_records""")
def leakage_audit(ws: Workspace) -> DataFrame:
    return records.leakage_audit(ws.commerce.records, ws.commerce.events, MILESTONES, ws.commerce.heavy)


@query("SELECT entity_id, split, n_events FROM rec_app WHERE entity_id IN (SELECT entity_id FROM vec)")
def embedded_records(ws: Workspace) -> DataFrame:
    return records.only_entities_in(ws.app.records, ws.vectors).select("entity_id", "split", "n_events")


@query("SELECT entity_id, n_events, is_high_value FROM rec_com JOIN high_com USING (entity_id)")
def labelled_records(ws: Workspace) -> DataFrame:
    from eventlens.operators.features import high_value_labels

    labels = high_value_labels(ws.commerce.events, ws.profile).select("entity_id", "is_high_value")
    return records.attach_labels(
        ws.commerce.records.select("entity_id", "n_events"), labels, "is_high_value"
    )


# -- splits ----------------------------------------------------------------------------


@query(f"SELECT c_custkey::VARCHAR AS entity_id, {split_sql('c_custkey::VARCHAR')} AS split FROM customer")
def entity_splits(ws: Workspace) -> DataFrame:
    ids = ws.table("customer").select(F.col("c_custkey").cast("string").alias("entity_id"))
    return ids.withColumn("split", split.split_of(F.col("entity_id")))


@query(f"SELECT doc_id::VARCHAR AS entity_id, quality, toxic, {split_sql('doc_id::VARCHAR', 0.5, 0.25, 7)} AS split FROM labels".replace(
    "quality, toxic", "quality::BIGINT AS quality, toxic::BIGINT AS toxic"))
def document_splits(ws: Workspace) -> DataFrame:
    """Labelled documents with other fractions and seed."""
    config = split.SplitConfig(train_frac=0.5, val_frac=0.25, seed=7)
    rows = ws.table("labels").withColumn("entity_id", F.col("doc_id").cast("string"))
    return rows.select("entity_id", "quality", "toxic", split.split_of(F.col("entity_id"), config).alias("split"))


@query("SELECT count(DISTINCT c_custkey) AS n_entities, 0::BIGINT AS n_without_split, 0::BIGINT AS n_in_two_splits FROM customer")
def split_audit(ws: Workspace) -> DataFrame:
    return split.split_audit(ws.commerce.records)


@query(tree_sql(f"(SELECT DISTINCT entity_id FROM hist_com WHERE {split_sql('entity_id')} = 'train')"))
def train_fingerprint(ws: Workspace) -> DataFrame:
    from eventlens.operators.fit import train_rows

    return split.tree_fingerprint(train_rows(ws.commerce.history).select("entity_id").distinct())


@query(tree_sql("(SELECT DISTINCT entity_id FROM hist_com)"))
def tree_fingerprint(ws: Workspace) -> DataFrame:
    return split.tree_fingerprint(ws.commerce.history.select("entity_id").distinct())
