"""Raw Parquet tables in, canonical events and profile out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens import registry as R
from eventlens.operators.ordered import part_of, value_at_ranks
from eventlens.session import utc_session


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table with instants as UTC timestamps and NaN read as missing."""
    utc_session(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return clean(df)


def clean(df: DataFrame) -> DataFrame:
    out: list[Column] = []
    for f in df.schema.fields:
        col = F.col(f.name)
        if isinstance(f.dataType, T.TimestampNTZType):
            col = col.cast("timestamp")
        elif isinstance(f.dataType, T.DoubleType | T.FloatType):
            col = F.when(~F.isnan(col), col)
        out.append(col.alias(f.name))
    return df.select(*out)


def resolve_columns(df: DataFrame, registry: R.Registry) -> DataFrame:
    """Rename source columns to canonical keys; leave unknown columns out."""
    found: dict[str, str] = {}
    for name in df.columns:
        key = registry.resolve(name)
        if key is None:
            continue
        if key in found.values():
            raise ValueError(f"two source columns resolve to '{key}'")
        found[name] = key
    return df.select(*[F.col(name).alias(key) for name, key in found.items()])


# -- the app binding -----------------------------------------------------------

PROFILE_FIELDS = (
    R.Field("country", R.CATEGORICAL, nulls=R.FORBIDDEN),
    R.Field("plan", R.CATEGORICAL, nulls=R.FORBIDDEN),
    R.Field("balance_quantile", R.CATEGORICAL),
    R.Field("signup_at", R.TIMESTAMP, nulls=R.FORBIDDEN),
    R.Field("first_purchase_at", R.TIMESTAMP),
    R.Field("first_view_at", R.TIMESTAMP),
)
ATTRIBUTES = ("country", "plan", "balance_quantile")
MILESTONES = ("signup_at", "first_purchase_at", "first_view_at")
# Milestone -> the event family whose earliest event it names.
MILESTONE_FAMILIES = {"signup_at": "signup", "first_purchase_at": "purchase", "first_view_at": "view"}


def app_registry() -> R.Registry:
    fields = (
        R.Field("entity_id", R.IDENTIFIER, aliases=("user_id",)),
        R.Field("event_id", R.IDENTIFIER),
        R.Field("created_at", R.TIMESTAMP, aliases=("event_time", "ts")),
        R.Field("type", R.CATEGORICAL, aliases=("event_type", "source")),
        R.Field("amount", R.NUMERICAL, aliases=("value",), nulls=R.ZERO_BUCKET),
        R.Field("view", R.CATEGORICAL, nulls=R.FORBIDDEN),
        *PROFILE_FIELDS,
    )
    names = ("click", "error", "purchase", "signup", "view")
    families = [R.Family(n, ("amount", "view")) for n in names]
    return R.Registry.declare(fields, families, ATTRIBUTES, MILESTONES)


def strict_app_registry() -> R.Registry:
    """A narrower schema that the app events break in four ways, for validation runs."""
    base = app_registry()
    families = (
        R.Family("click", ("amount",), ("view",)),
        R.Family("error", ("view",)),
        R.Family("purchase", ("amount", "country"), ("view",)),
        R.Family("view", ("view",), ("amount",)),
    )
    return R.Registry.declare(base.fields, families, ATTRIBUTES[:2], MILESTONES)


# No bigint has more characters, so padding never cuts an id and text order is number order.
ID_WIDTH = 20


def padded(name: str) -> Column:
    return F.lpad(F.col(name).cast("string"), ID_WIDTH, "0")


def app_events(spark: SparkSession, folder: str) -> DataFrame:
    raw = read_table(spark, folder, "events").withColumn("view", F.get_json_object("props", "$.k"))
    return resolve_columns(raw, app_registry()).select(
        F.col("entity_id").cast("string").alias("entity_id"),
        padded("event_id").alias("event_id"),
        "created_at", "type", "amount", "view",
    )


# -- the commerce binding --------------------------------------------------------


def commerce_registry(*, with_text: bool = False) -> R.Registry:
    text = R.TEXT if with_text else R.IGNORED
    fields = (
        R.Field("entity_id", R.IDENTIFIER),
        R.Field("event_id", R.IDENTIFIER),
        R.Field("created_at", R.TIMESTAMP, aliases=("event_time",)),
        R.Field("type", R.CATEGORICAL, aliases=("event_type", "source")),
        R.Field("amount", R.NUMERICAL, nulls=R.ZERO_BUCKET),
        R.Field("discount", R.NUMERICAL),
        R.Field("direction", R.CATEGORICAL, nulls=R.FORBIDDEN),
        R.Field("channel", R.CATEGORICAL),
        R.Field("mcc", R.CATEGORICAL),
        R.Field("merchant_name", text, pii_risk=True),
        R.Field("description", text, pii_risk=True),
        *PROFILE_FIELDS,
    )
    families = (
        R.Family("order", ("amount", "direction", "channel")),
        R.Family("line", ("amount", "discount", "direction", "mcc"), ("merchant_name", "description")),
    )
    return R.Registry.declare(fields, families, ATTRIBUTES, MILESTONES)


def commerce_events(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    lines = read_table(spark, folder, "lineitem")
    part = read_table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    supplier = read_table(spark, folder, "supplier").select("s_suppkey", "s_name")

    none = F.lit(None).cast("string")
    order_events = orders.select(
        F.col("o_custkey").cast("string").alias("entity_id"),
        F.concat(F.lit("o"), padded("o_orderkey")).alias("event_id"),
        F.col("o_orderdate").alias("created_at"),
        F.lit("order").alias("type"),
        F.col("o_totalprice").alias("amount"),
        F.lit(None).cast("double").alias("discount"),
        F.col("o_orderstatus").alias("direction"),
        F.col("o_orderpriority").alias("channel"),
        none.alias("mcc"), none.alias("merchant_name"), none.alias("description"),
    )
    line_id = F.concat_ws(
        "-",
        F.concat(F.lit("l"), padded("l_orderkey")),
        padded("l_linenumber"),
        padded("l_partkey"),
        padded("l_suppkey"),
        F.date_format("l_shipdate", "yyyyMMdd"),
        F.lpad(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), ID_WIDTH + 1, "0"),
    )
    line_events = (
        lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .select(
            F.col("o_custkey").cast("string").alias("entity_id"),
            line_id.alias("event_id"),
            F.col("l_shipdate").alias("created_at"),
            F.lit("line").alias("type"),
            F.col("l_extendedprice").alias("amount"),
            F.col("l_discount").alias("discount"),
            F.col("l_returnflag").alias("direction"),
            none.alias("channel"),
            F.col("p_brand").alias("mcc"),
            F.col("s_name").alias("merchant_name"),
            F.col("p_name").alias("description"),
        )
    )
    return order_events.unionByName(line_events)


def commerce_owners(spark: SparkSession, folder: str) -> DataFrame:
    """The entity of each commerce event, before parts and suppliers are looked up."""
    orders = read_table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("entity_id"))
    lines = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.select("entity_id").unionByName(lines.join(orders, "o_orderkey").select("entity_id"))


# -- the profile both bindings share ---------------------------------------------


def equal_parts(df: DataFrame, order: list[str], parts: int, n_rows: int) -> list[tuple]:
    """First order values of part 2, 3, ... when the rows are cut into equal parts
    (earlier parts take the remainder, as ``ntile`` does)."""
    base, extra = divmod(n_rows, parts)
    sizes = [base + (i < extra) for i in range(parts)]
    starts = [1 + sum(sizes[:i]) for i in range(1, parts)]
    return value_at_ranks(df, order, [s for s in starts if s <= n_rows])


def milestone_times(events: DataFrame, families: dict[str, str | None]) -> DataFrame:
    """Earliest event of a family (None: of any) per entity, one column per milestone."""
    in_family = {
        name: F.lit(True) if family is None else F.col("type") == family
        for name, family in families.items()
    }
    return events.groupBy("entity_id").agg(
        *[F.min(F.when(cond, F.col("created_at"))).alias(name) for name, cond in in_family.items()]
    )


def balance_cuts(spark: SparkSession, folder: str) -> list[tuple]:
    accounts = read_table(spark, folder, "customer").select("c_acctbal", "c_custkey")
    return equal_parts(accounts, ["c_acctbal", "c_custkey"], 5, accounts.count())


def profile_state(spark: SparkSession, folder: str, cuts: list[tuple]) -> DataFrame:
    """One row per customer: attributes, signup and first-event milestones."""
    customer = read_table(spark, folder, "customer")
    nation = read_table(spark, folder, "nation").select("n_nationkey", "n_name")
    first_order = (
        read_table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").cast("string").alias("entity_id"))
        .agg(F.min("o_orderdate").alias("first_order_at"))
    )
    events = app_events(spark, folder)
    firsts = milestone_times(
        events, {"first_purchase_at": "purchase", "first_view_at": "view", "first_event_at": None}
    )
    per_entity = [first_order, firsts]
    base = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").cast("string").alias("entity_id"),
        F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("plan"),
        F.concat(
            F.lit("q"), (part_of(["c_acctbal", "c_custkey"], cuts) + 1).cast("string")
        ).alias("balance_quantile"),
    )
    joined = reduce(lambda a, b: a.join(b, "entity_id", "left"), per_entity, base)
    return joined.select(
        "entity_id", "country", "plan", "balance_quantile",
        F.coalesce(
            "first_order_at", "first_event_at", F.lit("1992-01-01").cast("timestamp")
        ).alias("signup_at"),
        "first_purchase_at", "first_view_at",
    )
