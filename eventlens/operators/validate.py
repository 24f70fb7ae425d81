"""Schema and leakage checks over wide event and profile tables.

The registry is small driver data, so every rule becomes a column expression on the
wide row. Finding issues is one narrow pass: no unpivot, no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens import registry as R
from eventlens.functions.values import as_category
from eventlens.operators.skew import join_per_entity

SAMPLE_SIZE = 20


def fields_long(events: DataFrame, registry: R.Registry) -> DataFrame:
    """One row per present, registered value: numbers in ``num``, all else in ``txt``."""
    slots = []
    for i, key in enumerate(registry.value_keys(events.columns)):
        is_number = registry.field(key).kind == R.NUMERICAL
        num = F.col(key).cast("double") if is_number else F.lit(None).cast("double")
        txt = F.lit(None).cast("string") if is_number else as_category(events, key)
        slot = F.struct(
            F.lit(i).alias("field_ord"), F.lit(key).alias("key"), num.alias("num"), txt.alias("txt")
        )
        slots.append(F.when(F.col(key).isNotNull(), slot))
    return events.select(
        "entity_id", "event_id", "created_at", "type",
        F.explode(F.array(*slots)).alias("f"),
    ).where("f is not null").select("entity_id", "event_id", "created_at", "type", "f.*")


def _quoted(*parts: str | Column) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def event_issue_list(
    events: DataFrame, registry: R.Registry, *, nulls: str = "drop"
) -> Column:
    """One text per rule, null where the rule holds.

    ``nulls='drop'`` treats a null as an absent field; ``'keep'`` treats each column as
    present, so a null breaks a rule only where nulls are forbidden.
    """
    if nulls not in ("drop", "keep"):
        raise ValueError("nulls must be 'drop' or 'keep'")
    kind = F.col("type")
    known = kind.isin([f.name for f in registry.families]) if registry.families else F.lit(False)
    rules: list[Column] = [
        F.when(~F.coalesce(known, F.lit(False)), _quoted("unknown event family: '", kind, "'"))
    ]

    def in_families(names: Sequence[str]) -> Column:
        return kind.isin(list(names)) if names else F.lit(False)

    values = [c for c in events.columns if c not in R.STRUCTURAL]
    present = {registry.resolve(c) or c: c for c in values}
    required = list(dict.fromkeys(k for f in registry.families for k in f.required))
    for key in required:
        needing = in_families([f.name for f in registry.families if key in f.required])
        if key not in present:
            broken = F.lit(True)
        elif nulls == "drop" or registry.field(key).nulls == R.FORBIDDEN:
            broken = F.col(present[key]).isNull()
        else:
            broken = F.lit(False)
        rules.append(
            F.when(needing & broken, _quoted(f"missing required field '{key}' for '", kind, "'"))
        )
    for column in values:
        key = registry.resolve(column)
        there = F.col(column).isNotNull() if nulls == "drop" else F.lit(True)
        if key is None:
            rules.append(
                F.when(known & there, _quoted(f"unmapped source field '{column}' on event '", kind, "'"))
            )
            continue
        allowed = in_families([f.name for f in registry.families if key in f.keys])
        rules.append(
            F.when(
                known & there & ~allowed,
                _quoted(f"field '{key}' not allowed on event family '", kind, "'"),
            )
        )
        if nulls == "keep" and registry.field(key).nulls == R.FORBIDDEN:
            rules.append(
                F.when(
                    allowed & F.col(column).isNull(),
                    _quoted(f"null not allowed for field '{key}' on '", kind, "'"),
                )
            )
    return F.array(*rules)


def event_issues(events: DataFrame, registry: R.Registry, *, nulls: str = "drop") -> DataFrame:
    """``(entity_id, event_id, created_at, issue_ord, issue)`` for every broken rule."""
    found = event_issue_list(events, registry, nulls=nulls)
    return events.select(
        "entity_id", "event_id", "created_at", F.posexplode(found).alias("issue_ord", "issue")
    ).where("issue is not null")


def profile_issues(
    profile: DataFrame, registry: R.Registry, *, nulls: str = "drop"
) -> DataFrame:
    """``(entity_id, issue_ord, issue)``; columns starting with ``_`` are not inputs."""
    rules: list[Column] = []
    for column in profile.columns:
        if column == "entity_id" or column.startswith("_"):
            continue
        key = registry.resolve(column)
        there = F.col(column).isNotNull() if nulls == "drop" else F.lit(True)
        if key is None:
            rules.append(F.when(there, F.lit(f"unmapped source field '{column}' on profile state")))
        elif key not in registry.profile_keys:
            rules.append(F.when(there, F.lit(f"field '{key}' not a registered profile field")))
        elif nulls == "keep" and registry.field(key).nulls == R.FORBIDDEN:
            rules.append(
                F.when(F.col(column).isNull(), F.lit(f"null not allowed for profile field '{key}'"))
            )
    rules = rules or [F.lit(None).cast("string")]
    return profile.select(
        "entity_id", F.posexplode(F.array(*rules)).alias("issue_ord", "issue")
    ).where("issue is not null")


def events_before_signup(
    events: DataFrame, profile: DataFrame, heavy: Sequence[tuple] = ()
) -> DataFrame:
    signup = profile.select("entity_id", "signup_at")
    joined = join_per_entity(events.select("entity_id", "event_id", "created_at"), signup, "left", heavy)
    return joined.where("created_at < signup_at")


def milestone_checks(
    events: DataFrame, profile: DataFrame, families: Mapping[str, str], *, both_ways: bool = False
) -> DataFrame:
    """Per milestone: how many entities were compared and how many differ from the earliest
    event of the family. A null milestone, or an entity without such an event, is not
    compared; ``both_ways`` counts those one-sided cases too."""
    mins = events.where(F.col("type").isin(list(families.values()))).groupBy("entity_id").agg(
        *[F.min(F.when(F.col("type") == f, F.col("created_at"))).alias(f"true_{m}") for m, f in families.items()]
    )
    both = profile.select("entity_id", *families).join(mins, "entity_id", "full" if both_ways else "inner")
    slots = [
        F.struct(
            F.lit(m).alias("milestone"), F.col(m).alias("stated"), F.col(f"true_{m}").alias("earliest")
        )
        for m in families
    ]
    rows = both.select(F.explode(F.array(*slots)).alias("c")).select("c.*")
    compared = F.col("stated").isNotNull() & F.col("earliest").isNotNull()
    aggs = [
        F.count_if(compared).alias("n_compared"),
        F.count_if(compared & (F.col("stated") != F.col("earliest"))).alias("n_mismatched"),
    ]
    if both_ways:
        aggs.append(
            F.count_if(F.col("stated").isNull() != F.col("earliest").isNull()).alias("n_one_sided")
        )
    return rows.groupBy("milestone").agg(*aggs)


def null_rates(events: DataFrame) -> DataFrame:
    """One row, one rate per value column."""
    values = [c for c in events.columns if c not in R.STRUCTURAL]
    return events.agg(
        *[F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0)).alias(c) for c in values]
    )


def duplicate_timestamp_entities(events: DataFrame) -> DataFrame:
    """Entities with two events at the same instant."""
    return (
        events.groupBy("entity_id", "created_at").agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("entity_id").distinct()
    )


def corpus_report(
    events: DataFrame,
    profile: DataFrame,
    registry: R.Registry,
    families: Mapping[str, str],
    heavy: Sequence[tuple] = (),
) -> DataFrame:
    """One row: counts, the first issues, null rates and the verdict.

    The parts are one-row aggregates, stacked and folded by one aggregate.
    """
    event_rows = event_issues(events, registry).select(
        F.lit(0).alias("part"), "entity_id", F.unix_micros("created_at").alias("at"),
        "event_id", "issue_ord", "issue",
    )
    profile_rows = profile_issues(profile, registry).select(
        F.lit(1).alias("part"), "entity_id", F.lit(0).cast("bigint").alias("at"),
        F.lit("").alias("event_id"), "issue_ord", "issue",
    )
    issues = event_rows.unionByName(profile_rows)
    order = ["part", "entity_id", "at", "event_id", "issue_ord"]
    first = issues.orderBy(*order).limit(SAMPLE_SIZE)

    n_early = events_before_signup(events, profile, heavy).agg(F.count(F.lit(1)).alias("n"))
    early = n_early.where("n > 0").select(
        F.lit(0).alias("ord"),
        _quoted(F.col("n").cast("string"), " events occur before their entity's signup_at").alias("text"),
    )
    by_name = F.lit(None)
    names = list(families)
    for m, family in families.items():
        by_name = F.when(
            F.col("milestone") == m,
            _quoted(
                F.col("n_mismatched").cast("string"),
                f" entities have a '{m}' milestone inconsistent with their earliest '{family}' event",
            ),
        ).otherwise(by_name)
    wrong = milestone_checks(events, profile, families).where("n_mismatched > 0").select(
        (F.array_position(F.array(*[F.lit(n) for n in names]), F.col("milestone"))).cast("int").alias("ord"),
        by_name.alias("text"),
    )
    leaks = early.unionByName(wrong)

    # Counts and null rates of the events come from one pass.
    values = [c for c in events.columns if c not in R.STRUCTURAL]
    over_events = events.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.coalesce(
            F.sum(F.size(F.array_compact(event_issue_list(events, registry)))), F.lit(0)
        ).alias("n_event_issues"),
        *[
            F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0)).alias(f"null_rate_{c}")
            for c in values
        ],
    )
    parts = [
        over_events,
        profile_rows.agg(F.count(F.lit(1)).alias("n_profile_issues")),
        first.agg(
            F.concat_ws("; ", F.transform(
                F.array_sort(F.collect_list(F.struct(*order, "issue"))), lambda s: s["issue"]
            )).alias("schema_issues_sample")
        ),
        leaks.agg(
            F.count(F.lit(1)).alias("n_leakage_issues"),
            F.concat_ws("; ", F.transform(
                F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]
            )).alias("leakage_issues"),
        ),
        duplicate_timestamp_entities(events).agg(
            F.count(F.lit(1)).alias("entities_with_duplicate_event_timestamps")
        ),
        profile.agg(F.count(F.lit(1)).alias("n_entities")),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    row = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    row = row.withColumn("n_schema_issues", F.col("n_event_issues") + F.col("n_profile_issues"))
    return row.drop("n_event_issues", "n_profile_issues").withColumn(
        "passed", (F.col("n_schema_issues") == 0) & (F.col("n_leakage_issues") == 0)
    )
