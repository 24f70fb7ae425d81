"""The tables of one data folder, and what is derived from them, built on demand."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens import registry as R
from eventlens.operators import encode, fit, history, mask, ordered, records
from eventlens.operators.batch import plan_batches
from eventlens.operators.bundle import Bundle
from eventlens.operators.skew import split_heavy
from eventlens.session import materialize, materialize_by, utc_session
from eventlens.sources import tables
from eventlens.sources.tables import ATTRIBUTES, MILESTONES


class Binding:
    """One pair of event table and schema over the folder's tables."""

    def __init__(self, ws: Workspace, registry: R.Registry, events: DataFrame, owners: DataFrame | None = None):
        self.ws = ws
        self.registry = registry
        self.events = events
        # The entity of each event, where that takes fewer joins than the events. It only names heavy entities.
        self.owners = events if owners is None else owners
        self._texts: dict[int, tuple] = {}

    @cached_property
    def heavy(self) -> list[tuple]:
        """Entities too large for one task; found once per event table."""
        return ordered.heavy_groups(self.owners, ["entity_id"])

    @cached_property
    def history(self) -> DataFrame:
        """Events of entities that have a profile."""
        return records.restrict_to_profile(self.events, self.ws.profile, self.heavy)

    @cached_property
    def stored_history(self) -> DataFrame:
        """The history's encodable columns with their places, written once by entity. Fitting, records and
        encoding start from here, so the source tables are joined once and events are shuffled by
        entity once. Heavy entities are written apart, for reading in many tasks."""
        found = self.registry.value_keys(self.events.columns)
        kept = [k for k in found if self.registry.field(k).kind in R.TOKENIZABLE]
        slim = self.events.select(*dict.fromkeys(["entity_id", "event_id", "created_at", "type", *kept]))
        if self.heavy:
            whole = records.restrict_to_profile(slim, self.ws.profile, self.heavy)
            hot, cold = split_heavy(whole, ["entity_id"], self.heavy)
            placed = materialize_by(history.placed_history(cold, []), "entity_id", "history")
            return placed.unionByName(materialize(hot, "heavy-history"), allowMissingColumns=True)
        buckets = int(self.ws.spark.conf.get("spark.sql.shuffle.partitions"))
        known = self.ws.profile.hint("shuffle_hash")  # a sort-merge join would sort the events twice
        near = records.restrict_to_profile(slim.repartition(buckets, "entity_id"), known)
        return materialize_by(history.placed_history(near, []), "entity_id", "history")

    @cached_property
    def records(self) -> DataFrame:
        # Only events of entities with a profile count, so the written history serves as well.
        known = self.stored_history if "stored_history" in self.__dict__ else self.events
        return records.build_records(known, self.ws.profile, MILESTONES)

    @cached_property
    def kept_records(self) -> DataFrame:
        return records.with_events(self.records)

    @cached_property
    def bundle(self) -> Bundle:
        """Fitted once per folder and schema: the later steps read it, as they would a saved one."""
        return fit.fit(self.stored_history, self.ws.profile, self.registry)

    def capped(self, max_events: int | None = None) -> DataFrame:
        n = max_events or self.bundle.config.max_history_events
        if "stored_history" in self.__dict__:
            return history.newest_placed(self.stored_history, n, self.heavy)
        return history.keep_recent(self.history, n, self.heavy)

    def encoded(self, bundle: Bundle | None = None) -> DataFrame:
        """Encoding from the raw tables."""
        bundle = bundle or self.bundle
        return encode.encode_events(self.capped(bundle.config.max_history_events), bundle, self.texts(bundle))

    def texts(self, bundle: Bundle) -> DataFrame | None:
        """Spelled once per fitted bundle: configurations that only cap events share it."""
        found = self._texts.get(id(bundle.merges))
        if found is None:
            found = self._texts[id(bundle.merges)] = (encode.spelled_texts(self.stored_history, bundle), bundle.merges)
        return found[0]

    @cached_property
    def stored(self) -> DataFrame:
        """Encoded events written once; masks and batches start from there."""
        return materialize_by(self.encoded(), "entity_id", "encoded-events")

    @cached_property
    def stored_profiles(self) -> DataFrame:
        return materialize_by(self.profiles(), "entity_id", "encoded-profiles")

    def profiles(self, bundle: Bundle | None = None) -> DataFrame:
        bundle = bundle or self.bundle
        return encode.encode_profile(self.kept_records, bundle)

    def shards(self) -> DataFrame:
        return encode.assemble(self.profiles(), self.encoded())

    def sizes(self) -> DataFrame:
        return self.stored_sizes

    @cached_property
    def stored_sizes(self) -> DataFrame:
        """One row per record; events are encoded for it without being written, unless they are there."""
        return materialize(encode.record_sizes(self.stored_profiles, self.encoded_once()), "record-sizes")

    def encoded_once(self) -> DataFrame:
        """Encoded events for one pass over them: written ones where they are there, else encoded in place."""
        return self.stored if "stored" in self.__dict__ else self.encoded()

    def masked(self, epoch: int = 0) -> DataFrame:
        return mask.mask_tokens(self.encoded_once(), self.bundle, mask.MaskConfig(), epoch)

    @cached_property
    def batches(self) -> DataFrame:
        return materialize(plan_batches(self.sizes()), "batches")


class Workspace:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = utc_session(spark)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return tables.read_table(self.spark, self.folder, name)

    @cached_property
    def profile(self) -> DataFrame:
        """Written once: every query meets it several times."""
        cuts = tables.balance_cuts(self.spark, self.folder)
        return materialize(tables.profile_state(self.spark, self.folder, cuts), "profile")

    @cached_property
    def app(self) -> Binding:
        return Binding(self, tables.app_registry(), tables.app_events(self.spark, self.folder))

    @cached_property
    def commerce(self) -> Binding:
        events = tables.commerce_events(self.spark, self.folder)
        return Binding(self, tables.commerce_registry(), events, tables.commerce_owners(self.spark, self.folder))

    @cached_property
    def commerce_text(self) -> Binding:
        events = tables.commerce_events(self.spark, self.folder)
        return Binding(self, tables.commerce_registry(with_text=True), events, tables.commerce_owners(self.spark, self.folder))

    @cached_property
    def cutoffs(self) -> DataFrame:
        """Evaluation points other than the latest event: three years after signup."""
        return self.profile.select(
            "entity_id", (F.col("signup_at") + F.expr("interval 1096 days")).alias("evaluation_time")
        )

    @cached_property
    def several_points(self) -> DataFrame:
        """Up to five evaluation points per entity: the signup, 200 days, two and four years, 28 years after it."""
        days = F.explode(F.array(*[F.lit(d) for d in (0, 200, 730, 1461, 10227)])).alias("days")
        spread = self.profile.select("entity_id", "plan", "signup_at", days)
        wanted = spread.where((F.col("days") != 730) | (F.col("plan") != "BUILDING")).where("days = 0 or plan <> 'MACHINERY'")
        return wanted.where("plan <> 'FURNITURE'").select(
            "entity_id", (F.col("signup_at") + F.make_interval(days="days")).alias("evaluation_time")
        )

    @cached_property
    def vectors(self) -> DataFrame:
        """The embedding table in the shape of record embeddings."""
        raw = self.table("embeddings")
        half = F.floor(F.size("embedding") / 2).cast("int")
        return raw.select(
            F.col("vec_id").cast("string").alias("entity_id"),
            F.slice("embedding", F.lit(1), half).alias("usr"),
            F.slice("embedding", half + 1, F.size("embedding") - half).alias("last_event"),
            F.col("embedding").alias("concat"),
            (F.col("label") == 0).alias("label"),
        )


def _state(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of the input files, as the session's own file system reports them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files, found = store.listFiles(path, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


_OPEN: dict[tuple[str, str], tuple[tuple, Workspace]] = {}


def workspace(spark: SparkSession, folder: str) -> Workspace:
    """One workspace per application, folder and state of its files, so the encoders are fitted
    once, and anew when a file was replaced."""
    key, state = (spark.sparkContext.applicationId, folder.rstrip("/")), _state(spark, folder)
    if key not in _OPEN or _OPEN[key][0] != state:
        _OPEN[key] = (state, Workspace(spark, folder))
    return _OPEN[key][1]


__all__ = ["ATTRIBUTES", "MILESTONES", "Binding", "Workspace", "workspace"]
