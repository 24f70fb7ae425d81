"""The fitted encoders and their id space."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens import registry as R

# Special token ids.
PAD, UNK, MASK, USR, EVT, MILESTONE_PRESENT, MILESTONE_ABSENT = range(7)
N_SPECIAL = 7
SCHEMA_VERSION = 1


@dataclass(frozen=True)
class EncoderConfig:
    # Default vocabulary sizes and truncation caps.
    n_numeric_buckets: int = 16
    bpe_vocab_size: int = 512
    bpe_min_frequency: int = 1
    max_within_field_tokens: int = 8
    max_profile_tokens: int = 200
    max_event_tokens: int = 24
    max_history_events: int = 6500
    include_type: bool = False
    fit_scopes: tuple[str, ...] = ("event",)

    def __post_init__(self) -> None:
        if self.n_numeric_buckets < 2:
            raise ValueError("n_numeric_buckets must be at least 2")
        for name in (
            "max_within_field_tokens", "max_profile_tokens", "max_event_tokens", "max_history_events"
        ):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")


def category_sizes(categories: DataFrame) -> dict[str, tuple[int, int]]:
    """Values of each key, and their bytes with ids: one row per key of the schema."""
    sizes = categories.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 12).alias("b")).collect()
    return {r["key"]: (r["n"], r["b"]) for r in sizes}


@dataclass(frozen=True)
class Bundle:
    """``[special][keys][zero + numeric buckets][category blocks][text pieces]``.

    What lives on the driver is bounded by the schema and the config (keys, bounds, merges).
    Category values can be many, so they stay a DataFrame.
    """

    registry: R.Registry
    config: EncoderConfig
    numeric_bounds: dict[str, list[float]]
    categories: DataFrame  # key, value, value_id
    n_categories: int
    merges: list[tuple[int, int, int]] = field(default_factory=list)  # left, right, new (local ids)
    text_fitted: bool = False
    train_fingerprint: str | None = None
    n_train_records: int = 0
    category_sizes: dict[str, tuple[int, int]] = field(default_factory=dict, compare=False)  # values, bytes per key

    @property
    def key_ids(self) -> dict[str, int]:
        return {k: N_SPECIAL + i for i, k in enumerate(self.registry.token_keys())}

    @property
    def numeric_base(self) -> int:
        return N_SPECIAL + len(self.registry.token_keys())

    @property
    def category_base(self) -> int:
        return self.numeric_base + 1 + self.config.n_numeric_buckets

    @property
    def text_base(self) -> int:
        return self.category_base + self.n_categories

    @property
    def text_size(self) -> int:
        """Unknown piece, 256 bytes and the pieces made by merges."""
        return 257 + len({new for _, _, new in self.merges})

    @property
    def total_size(self) -> int:
        return self.text_base + self.text_size

    @property
    def max_pairs(self) -> int:
        """Upper bound of distinct (key, value) token pairs."""
        n_numeric = len(self.numeric_bounds) * (1 + self.config.n_numeric_buckets)
        n_text = len(self.registry.keys_of(R.TEXT)) * self.text_size
        return n_numeric + n_text + self.n_categories + 3 * len(self.key_ids)

    def maskable_key_ids(self) -> list[int]:
        ids = self.key_ids
        return [ids[k] for k in self.registry.token_keys() if self.registry.field(k).can_mask]

    def with_config(self, **changes) -> Bundle:
        return replace(self, config=replace(self.config, **changes))
