"""Features, labels, probes and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.temporal import CALENDAR, calendar
from eventlens.operators import cooccurrence, features, probes, records
from eventlens.operators.split import split_of
from eventlens.plans.catalog import query
from eventlens.plans.reference_sql import median_sql, split_sql
from eventlens.plans.workspace import ATTRIBUTES, MILESTONES, Binding, Workspace
from eventlens.session import materialize

NUMERIC = (
    "n_events", "n_distinct_event_types", "total_amount", "mean_amount", "days_since_signup",
    "has_first_purchase_at", "has_first_view_at",
)
LONG_FROM = 60


def _features(b: Binding, rows: DataFrame | None = None) -> DataFrame:
    rows = b.records if rows is None else rows
    return features.aggregated_features(rows, b.events, ATTRIBUTES, MILESTONES)


FEATURE_SQL = """entity_id, n_events, n_distinct_event_types, round(total_amount, 6) AS total_amount, round(mean_amount, 6) AS mean_amount,
  round(days_since_signup, 6) AS days_since_signup, has_first_purchase_at, has_first_view_at, country, plan, balance_quantile"""


@query(f"SELECT {FEATURE_SQL} FROM feat_app")
def aggregated_features(ws: Workspace) -> DataFrame:
    return _features(ws.app)


@query(f"SELECT {FEATURE_SQL} FROM feat_com")
def commerce_features(ws: Workspace) -> DataFrame:
    return _features(ws.commerce)


@query("SELECT entity_id, round(total, 6) AS total, is_high_value FROM high_com")
def high_value_labels(ws: Workspace) -> DataFrame:
    return features.high_value_labels(ws.commerce.events, ws.profile)


@query("SELECT entity_id, is_escalating FROM escal_com")
def escalating_labels(ws: Workspace) -> DataFrame:
    return features.escalating_labels(ws.commerce.events, ws.profile, ws.commerce.heavy)


@query("SELECT cohort, count(*) AS n FROM cohort_com GROUP BY 1")
def cohort_counts(ws: Workspace) -> DataFrame:
    rows = features.cohorts(ws.commerce.events, ws.profile, LONG_FROM)
    return rows.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))


# -- preprocessing -----------------------------------------------------------------------


def _labelled(ws: Workspace, label: str) -> DataFrame:
    """Commerce features of train and val records with a label and the part they belong to."""
    b = ws.commerce
    if label == "is_high_value":
        labels = features.high_value_labels(b.events, ws.profile)
    else:
        labels = features.escalating_labels(b.events, ws.profile, b.heavy)
    rows = records.attach_labels(_features(b, b.kept_records), labels.select("entity_id", label), label)
    rows = rows.withColumn("split", split_of(F.col("entity_id"))).where("split in ('train', 'val')")
    rows = materialize(rows, "labelled-rows")
    val = rows.where("split = 'val'").select("entity_id")
    return probes.with_partition(rows, val)


@query(f"""
  WITH long AS (SELECT unnest(['n_events', 'total_amount', 'mean_amount', 'days_since_signup', 'card']) AS "column",
                       unnest([n_events, total_amount, mean_amount, days_since_signup, CASE WHEN n_events > 50 THEN mean_amount END]) AS v
                FROM feat_com WHERE n_events > 0 AND split = 'train'),
  med AS ({median_sql('long', '"column"', 'v')})
  SELECT "column", round(any_value(q), 6) AS median, round(avg(coalesce(v, q)), 6) AS mean, round(stddev_pop(coalesce(v, q)), 6) AS std
  FROM long JOIN med USING ("column") GROUP BY 1""")
def scaling_statistics(ws: Workspace) -> DataFrame:
    """Medians, means and deviations of the training features; ``card`` has missing values."""
    b = ws.commerce
    rows = _features(b, b.kept_records).where(split_of(F.col("entity_id")) == "train")
    rows = materialize(rows.withColumn("card", F.when(F.col("n_events") > 50, F.col("mean_amount"))), "feature-rows")
    return probes.scaling_stats(rows, ["n_events", "total_amount", "mean_amount", "days_since_signup", "card"])


@query(f"""
  WITH train AS (SELECT * FROM prof WHERE {split_sql('entity_id')} = 'train' AND country <> 'NATION_3'),
  slots AS (SELECT (SELECT count(DISTINCT coalesce(country, 'missing')) FROM train) + (SELECT count(DISTINCT coalesce(plan, 'missing')) FROM train) AS n)
  SELECT entity_id, (SELECT n FROM slots) AS n_slots,
         (coalesce(country, 'missing') IN (SELECT coalesce(country, 'missing') FROM train))::BIGINT
         + (coalesce(plan, 'missing') IN (SELECT coalesce(plan, 'missing') FROM train))::BIGINT AS n_set
  FROM prof WHERE {split_sql('entity_id')} <> 'train'""")
def one_hot_slots(ws: Workspace) -> DataFrame:
    """One-hot encoding fitted without one country: its rows get all zeros for that field."""
    split = split_of(F.col("entity_id"))
    train = ws.profile.where((split == "train") & (F.col("country") != "NATION_3"))
    columns = ["country", "plan"]
    model = probes.fit_categories(train, columns)
    return probes.hot_slots(ws.profile.where(split != "train"), model, columns)


# -- models ----------------------------------------------------------------------------------


def _baseline(ws: Workspace, model: str) -> DataFrame:
    rows = _labelled(ws, "is_escalating")
    return probes.baselines(rows, "is_escalating", NUMERIC, ATTRIBUTES, models=(model,))


@query()
def logistic_baseline(ws: Workspace) -> DataFrame:
    return _baseline(ws, "logreg")


@query()
def boosted_tree_baseline(ws: Workspace) -> DataFrame:
    return _baseline(ws, "gbdt")


def _vectors(ws: Workspace) -> DataFrame:
    rows = ws.vectors.withColumn("split", split_of(F.col("entity_id"))).where("split in ('train', 'val')")
    return probes.with_partition(rows, rows.where("split = 'val'").select("entity_id"))


@query()
def linear_probe(ws: Workspace) -> DataFrame:
    return probes.linear_probe(_vectors(ws), "concat", "label")


@query()
def probe_variants(ws: Workspace) -> DataFrame:
    return probes.probe_variants(_vectors(ws), ["usr", "last_event", "concat"], "label")


# Twelve full Newton steps from zero for two scaled features, written out; ``rows`` has name, y, a, b, is_val.
NEWTON_SQL = """
  st AS (SELECT name, avg(a) AS ma, avg(b) AS mb, coalesce(nullif(stddev_pop(a), 0), 1) AS sa, coalesce(nullif(stddev_pop(b), 0), 1) AS sb
         FROM rows WHERE NOT is_val GROUP BY 1),
  z AS (SELECT name, y, is_val, (a - ma) / sa AS a, (b - mb) / sb AS b FROM rows JOIN st USING (name)),
  newton(i, name, w0, w1, w2) AS (
    SELECT 0, name, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM st
    UNION ALL
    SELECT i + 1, name,
           w0 - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det,
           w1 - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
           w2 - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det
    FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM (
      SELECT i, name, w0, w1, w2, sum(p - y) AS g0, sum((p - y) * a) + w1 AS g1, sum((p - y) * b) + w2 AS g2,
             sum(p * (1 - p)) AS h00, sum(p * (1 - p) * a) AS h01, sum(p * (1 - p) * b) AS h02,
             sum(p * (1 - p) * a * a) + 1 AS h11, sum(p * (1 - p) * a * b) AS h12, sum(p * (1 - p) * b * b) + 1 AS h22
      FROM (SELECT i, s.name, w0, w1, w2, y, a, b, 1 / (1 + exp(-(w0 + w1 * a + w2 * b))) AS p
            FROM newton s JOIN z ON z.name = s.name AND NOT is_val WHERE i < 12)
      GROUP BY i, name, w0, w1, w2))),
  fitted AS (SELECT name, w0, w1, w2 FROM newton WHERE i = 12),
  scored AS (SELECT name, y, rank() OVER (PARTITION BY name ORDER BY s) + (count(*) OVER (PARTITION BY name, s) - 1) / 2.0 AS r
             FROM (SELECT name, y, w0 + w1 * a + w2 * b AS s FROM z JOIN fitted USING (name) WHERE is_val)),
  val AS (SELECT name, sum(r) FILTER (WHERE y = 1) AS ranks, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n
          FROM scored GROUP BY 1)
  SELECT name, round(w0, 6) + 0.0 AS intercept, round(w1, 6) + 0.0 AS weight_1, round(w2, 6) + 0.0 AS weight_2,
         round((ranks - p * (p + 1) / 2.0)::DOUBLE / nullif(p * n, 0)::DOUBLE, 6) AS auc
  FROM fitted LEFT JOIN val USING (name)"""


def _two_weights(parts: dict[str, tuple[DataFrame, str]], label: str) -> DataFrame:
    """``(name, intercept, weight_1, weight_2, auc)`` of probes on vectors of two dimensions, as fitted."""
    rows = []
    for name, (vectors, column) in parts.items():
        model, auc = probes.fitted_probe(vectors, column, label)
        rows.append((name, model.intercept, *model.weights, auc))
    spark = next(iter(parts.values()))[0].sparkSession
    out = spark.createDataFrame(rows, "name string, intercept double, weight_1 double, weight_2 double, auc double")
    return out.select("name", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("intercept", "weight_1", "weight_2")], F.round("auc", 6).alias("auc"))


@query(f"""
  WITH RECURSIVE rows AS (SELECT f AS name, is_escalating::INT::DOUBLE AS y, n_events::DOUBLE AS a, CASE WHEN f = 'amount' THEN mean_amount ELSE days_since_signup END::DOUBLE AS b,
    split = 'val' AS is_val FROM feat_com JOIN escal_com USING (entity_id), (VALUES ('amount'), ('tenure')) v(f) WHERE n_events > 0 AND split IN ('train', 'val')),{NEWTON_SQL}""")
def logistic_coefficients(ws: Workspace) -> DataFrame:
    """Weights and validation AUC of the logistic baseline on two features, solved in SQL as well."""
    rows = materialize(_labelled(ws, "is_escalating"), "labelled")
    second = {"amount": "mean_amount", "tenure": "days_since_signup"}
    parts = {
        name: (rows.withColumn("v", F.array(F.col("n_events").cast("double"), F.col(c).cast("double"))), "v")
        for name, c in second.items()
    }
    return _two_weights(parts, "is_escalating")


@query(f"""
  WITH RECURSIVE rows AS (SELECT f AS name, label::INT::DOUBLE AS y, e[at1] AS a, e[at2] AS b, split = 'val' AS is_val
    FROM (SELECT split, label, list_transform(embedding, lambda x: x::DOUBLE) AS e, len(embedding) AS n FROM vec WHERE split IN ('train', 'val')),
    LATERAL (VALUES ('usr', 1, 2), ('last_event', n // 2 + 1, n // 2 + 2), ('concat', 1, n)) v(f, at1, at2)),{NEWTON_SQL}""")
def probe_coefficients(ws: Workspace) -> DataFrame:
    """Weights and AUC of a probe on two dimensions of each variant, solved in SQL as well."""
    rows = _vectors(ws)
    ends = {"usr": (1, 2), "last_event": (1, 2), "concat": (1, -1)}
    parts = {
        name: (rows.withColumn("v", F.array(*[F.element_at(name, at).cast("double") for at in places])), "v")
        for name, places in ends.items()
    }
    return _two_weights(parts, "label")


AUC_SQL = """
  SELECT split, (count(*) FILTER (WHERE y))::BIGINT AS n_pos, (count(*) FILTER (WHERE NOT y))::BIGINT AS n_neg,
         round((sum(r) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0)::DOUBLE
               / nullif(count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y), 0)::DOUBLE, 6) AS auc
  FROM (SELECT split, y, rank() OVER (PARTITION BY split ORDER BY s) + (count(*) OVER (PARTITION BY split, s) - 1) / 2.0 AS r FROM {source})
  GROUP BY 1"""


@query(AUC_SQL.format(source="(SELECT split, n_events AS s, is_escalating AS y FROM feat_com JOIN escal_com USING (entity_id))"))
def rank_auc(ws: Workspace) -> DataFrame:
    """AUC of the event count against the escalating label per split, with many ties."""
    b = ws.commerce
    labels = features.escalating_labels(b.events, ws.profile, b.heavy)
    rows = b.records.select("entity_id", "split", "n_events").join(labels, "entity_id")
    return probes.rank_auc(rows, "n_events", "is_escalating", ["split"])


@query(AUC_SQL.format(source="(SELECT split, list_reduce(list_transform(embedding, lambda x: x::DOUBLE::DECIMAL(38,12)), lambda a, b: a + b)::DOUBLE AS s, label AS y FROM vec)"))
def vector_auc(ws: Workspace) -> DataFrame:
    """Vectors scored by the sum of all their dimensions (as decimals: free of order)."""
    zero = F.lit(0).cast("decimal(38,12)")
    total = F.aggregate(
        "concat", zero, lambda a, x: (a + x.cast("double").cast("decimal(30,12)")).cast("decimal(38,12)")
    )
    rows = ws.vectors.select(
        split_of(F.col("entity_id")).alias("split"), total.cast("double").alias("score"), "label"
    )
    return probes.rank_auc(rows, "score", "label", ["split"])


def _score_sql(name: str, column: str, where: str = "") -> str:
    return f"""SELECT '{name}' AS name, (SELECT auc FROM ({AUC_SQL.format(source=f"(SELECT 'v' AS split, {column} AS s, y FROM rows WHERE split = 'val' {where})")})) AS auc,
      (SELECT count(*) FROM rows WHERE split = 'train' {where}) AS n_train, (SELECT count(*) FROM rows WHERE split = 'val' {where}) AS n_val"""


@query(f"""
  WITH rows AS (SELECT split, is_escalating AS y, n_events > {LONG_FROM} AS many FROM feat_com JOIN escal_com USING (entity_id)
                WHERE n_events > 0 AND split IN ('train', 'val')),
  rate AS (SELECT many, avg(y::INT) AS s FROM rows WHERE split = 'train' GROUP BY 1),
  scored AS (SELECT 'v' AS split, coalesce(s, (SELECT max(s) FROM rate)) AS s, y FROM rows LEFT JOIN rate USING (many) WHERE split = 'val')
  SELECT 'baseline_gbdt' AS name, (SELECT CASE WHEN (SELECT count(DISTINCT y) FROM rows WHERE split = 'train') = 2 THEN auc END
                                   FROM ({AUC_SQL.format(source='scored')})) AS auc,
         (SELECT count(*) FROM rows WHERE split = 'train') AS n_train, (SELECT count(*) FROM rows WHERE split = 'val') AS n_val""")
def tree_on_one_split(ws: Workspace) -> DataFrame:
    """The tree baseline on one yes-or-no feature: its order is that of the training rates of both sides."""
    rows = _labelled(ws, "is_escalating").withColumn("many", F.col("n_events") > LONG_FROM)
    return probes.baselines(rows, "is_escalating", ["many"], [], models=("gbdt",))


@query(f"""
  WITH rows AS (SELECT *, is_escalating AS y FROM feat_com JOIN escal_com USING (entity_id) WHERE n_events > 0),
  results AS ({_score_sql('probe_total', 'total_amount')} UNION ALL {_score_sql('baseline_count', 'n_events')}
              UNION ALL {_score_sql('mean_amount', 'mean_amount')} UNION ALL {_score_sql('probe_rising', 'total_amount', 'AND y')})
  SELECT CASE WHEN name LIKE 'baseline\\_%' ESCAPE '\\' THEN 'n/a (baseline)' ELSE 'final' END AS checkpoint,
         CASE WHEN name LIKE 'probe\\_%' ESCAPE '\\' THEN 'probe' WHEN name LIKE 'baseline\\_%' ESCAPE '\\' THEN 'baseline' ELSE 'lora' END AS kind,
         name, auc, n_train, n_val, row_number() OVER (ORDER BY auc DESC NULLS LAST, name) AS place FROM results""")
def comparison_report(ws: Workspace) -> DataFrame:
    """Single columns as scores, ranked in one report; the last one has a single class."""
    from pyspark.sql import Window

    rows = materialize(_labelled(ws, "is_escalating"), "scored")

    def result(name: str, column: str, part: DataFrame) -> DataFrame:
        sizes = probes.partition_sizes(part)
        auc = probes.rank_auc(part.where("is_val"), column, "is_escalating").select("auc")
        both = sizes.unionByName(auc, allowMissingColumns=True)
        return both.agg(*[F.max(c).alias(c) for c in ("auc", "n_train", "n_val")]).select(
            F.lit(name).alias("name"), "auc", "n_train", "n_val"
        )

    results = [
        result("probe_total", "total_amount", rows),
        result("baseline_count", "n_events", rows),
        result("mean_amount", "mean_amount", rows),
        result("probe_rising", "total_amount", rows.where("is_escalating")),
    ]
    report = probes.comparison_report(reduce(DataFrame.unionByName, results), "final")
    # A report has a row per model, so its places are numbered in one task.
    place = Window.partitionBy().orderBy(F.desc_nulls_last("auc"), "name")
    return report.withColumn("place", F.row_number().over(place))


CLOCK_SQL = """[sin(2 * pi() * hour(created_at) / 24.0), cos(2 * pi() * hour(created_at) / 24.0), sin(2 * pi() * (isodow(created_at) - 1) / 7.0),
  cos(2 * pi() * (isodow(created_at) - 1) / 7.0), sin(2 * pi() * (day(created_at) - 1) / 31.0), cos(2 * pi() * (day(created_at) - 1) / 31.0)]"""


def _last_vectors(ws: Workspace) -> DataFrame:
    clock = calendar(F.col("created_at"))
    vector = F.array(*[clock[n] for n in CALENDAR])
    return probes.last_event_vectors(ws.app.records.select("entity_id", "n_events"), ws.app.events, vector, 6)


@query(f"""SELECT entity_id, (i - 1)::BIGINT AS dim, round(coalesce(v[i], 0.0), 6) + 0.0 AS x FROM rec_app LEFT JOIN (
            SELECT entity_id, max_by({CLOCK_SQL}, (created_at, event_id)) AS v FROM ev_app GROUP BY 1) e USING (entity_id),
          (SELECT unnest(range(1, 7)) AS i)""")
def last_event_vectors(ws: Workspace) -> DataFrame:
    return _last_vectors(ws).select("entity_id", F.posexplode("last_event").alias("dim", "x"))


@query(f"""SELECT entity_id, (i - 1)::BIGINT AS dim, round(list_concat([n_events::DOUBLE, n_value], coalesce(v, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]))[i], 6) + 0.0 AS x
          FROM (SELECT *, ln(1 + n_events) AS n_value FROM rec_app) LEFT JOIN (
            SELECT entity_id, max_by({CLOCK_SQL}, (created_at, event_id)) AS v FROM ev_app GROUP BY 1) e USING (entity_id),
          (SELECT unnest(range(1, 9)) AS i)""")
def joined_vectors(ws: Workspace) -> DataFrame:
    """A record vector and the last event's vector, end to end."""
    usr = F.array(F.col("n_events").cast("double"), F.log1p(F.col("n_events").cast("double")))
    both = _last_vectors(ws).withColumn("concat", F.concat(usr, "last_event"))
    return both.select("entity_id", F.posexplode("concat").alias("dim", "x"))


@query(f"""SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val
          FROM vec WHERE split IN ('train', 'val')""")
def partition_sizes(ws: Workspace) -> DataFrame:
    return probes.partition_sizes(_vectors(ws))


@query("""
  WITH w AS (SELECT event_id, tok_ord, key_id::BIGINT AS key_id, value_id::BIGINT AS value_id FROM tok_com)
  SELECT a.key_id AS key_a, a.value_id AS value_a, b.key_id AS key_b, b.value_id AS value_b, count(*) AS n
  FROM w a JOIN w b ON a.event_id = b.event_id AND a.tok_ord <> b.tok_ord GROUP BY ALL""")
def token_pairs(ws: Workspace) -> DataFrame:
    """How often two tokens stand in one event."""
    names = [
        F.shiftright(side, 32).alias(f"key_{side}") for side in ("a", "b")
    ] + [F.col(side).bitwiseAND(F.lit(2**32 - 1)).alias(f"value_{side}") for side in ("a", "b")]
    return cooccurrence.pair_counts(ws.commerce.stored).select(*names, "n")


@query("""
  WITH w AS (SELECT event_id, tok_ord, key_id::BIGINT AS key_id, value_id::BIGINT AS value_id FROM tok_com),
  p AS (SELECT a.key_id * 4294967296 + a.value_id AS wa, b.key_id * 4294967296 + b.value_id AS wb, count(*) AS n
        FROM w a JOIN w b ON a.event_id = b.event_id AND a.tok_ord <> b.tok_ord GROUP BY 1, 2),
  m AS (SELECT wa, wb, ln(n::DOUBLE * sum(n) OVER () / sum(n) OVER (PARTITION BY wa) / sum(n) OVER (PARTITION BY wb)) AS x FROM p)
  SELECT wa AS a, wb AS b, round(x, 6) AS m FROM m WHERE x > 1e-6""")
def token_information(ws: Workspace) -> DataFrame:
    """Positive mutual information of two tokens of one event."""
    pairs = materialize(cooccurrence.pair_counts(ws.commerce.stored), "pairs")
    found = cooccurrence.mutual_information(pairs).where("m > 1e-6")
    return found.select("a", "b", F.round("m", 6).alias("m"))


@query()
def token_vectors(ws: Workspace) -> DataFrame:
    """Record vectors from token sequences, as (entity, variant, dimension)."""
    vectors = probes.token_vectors(ws.app.stored)
    slots = [F.struct(F.lit(v).alias("variant"), F.col(v).alias("x")) for v in ("usr", "last_event", "concat")]
    long = vectors.select("entity_id", F.explode(F.array(*slots)).alias("s"))
    return long.select("entity_id", F.col("s.variant").alias("variant"), F.posexplode("s.x").alias("dim", "x"))
