"""Benchmark items in documents, found by templates. Spark functions only.

Every word that can be re-parameterised is marked as a slot of its type: numbers, units after a
number, and names (capitalised inside a sentence). Windows of ``WINDOW`` canonical words of the
benchmark are hash-joined with the same windows of all documents, twice: with only the type of a
slot, and as plain lower-case words, which finds verbatim copies of any case and spacing. A hit means that the template
fits; the slots are then compared: in one alignment of document and item every benchmark value must
stand for one document value; several may stand for the same. Equal values are a verbatim copy, a
consistent renaming is a re-parameterised question. A value that stands for several takes away the
windows that hold it, unless they are part of a long verbatim run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import once
from eventlens.session import materialize

WINDOW = 8
MIN_LITERALS = 4
MIN_WINDOWS = 6
MIN_COVERAGE = 0.5
# An item shorter than a window is a common phrase if more than one document and more than this share
# of all documents hold it.
COMMON_SHARE = 0.001
# Windows of a benchmark up to which its side is broadcast (16 bytes of key and place each).
BROADCAST_WINDOWS = 2_000_000

# Unit words that are a slot after a number.
UNITS = (
    "%", "percent", "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "ton", "tons", "oz", "lb", "lbs", "pound", "pounds", "ml", "l", "litre", "litres", "liter",
    "liters", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month",
    "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "meter", "meters", "metre",
    "metres", "degree", "degrees", "kmh", "mph", "hz", "khz", "mhz", "gb", "mb", "kb", "w", "kw", "v",
)
# A slot is marked by a character before its value: number, unit, name.
SLOT_MARKS = {"n": "\x01", "u": "\x02", "p": "\x03"}
# Each pattern first looks at the one character that it can begin with: most places are letters, and fail there.
AMOUNT = r"(?=[-+$€£0-9])(?<![\p{L}\p{N}.,\x01])(?<!\x01[-+$€£])([-+$€£]?[0-9](?:[0-9.,:/]*[0-9])?)"
NAME = r"(?=\p{Lu})(?<=[\p{L}\p{N},;]\s)(\p{Lu}\p{Ll}+)"
# White space other than one plain space.
SPACES = r" [\s\p{Z}]+|[\s\p{Z}&&[^ ]][\s\p{Z}]*"
# Ends of a line, and of a sentence.
LINE_END = r"[\r\n\x{85}\x{2028}\x{2029}]+"
SENTENCE_END = r"(?<=[.!?:;\x{3002}])\s+|" + LINE_END
# Between words: anything but letters and digits; marks inside a number belong to it.
GAP = (
    r"(?=[^\p{L}\p{M}\p{N}\x01-\x03])"
    r"(?:[^\p{L}\p{M}\p{N}\x01-\x03.,:/]+|[.,:/]+(?![0-9])|(?<![0-9])[.,:/]+)"
)


def canonical_words(text: Column) -> Column:
    """Lower-case words; the words of a slot begin with its mark."""
    number, unit, name = (SLOT_MARKS[k] for k in "nup")
    units = "|".join(UNITS)
    spaced = F.regexp_replace(text, SPACES, " ")
    clean = F.regexp_replace(F.translate(text, number + unit + name, "   "), SPACES, " ")
    with_units = F.regexp_replace(clean, AMOUNT + rf"\s?((?i:{units}))(?![\p{{L}}\p{{N}}])", f" {number}$1 {unit}$2 ")
    numbers = F.regexp_replace(with_units, AMOUNT, f" {number}$1")
    marked = F.when(text.rlike("[0-9]"), numbers).otherwise(spaced)
    marked = F.when(text.rlike("[\x01-\x03]") & ~text.rlike("[0-9]"), clean).otherwise(marked)
    return F.array_remove(F.split(F.lower(F.regexp_replace(marked, NAME, f"{name}$1")), GAP, -1), "")


def _is_slot(word: Column) -> Column:
    return word < "\x04"


def canonical(df: DataFrame, text: Column, *keys: str) -> DataFrame:
    """Rows ``*keys, words``."""
    return once(df.select(*keys, text.alias("__text")), "words", canonical_words(F.col("__text"))).drop("__text")


def _pairwise(a: Column, step: int, b: Column | None = None) -> Column:
    """Hash of each value of ``a`` with the one ``step`` later, in ``a`` or ``b``."""
    b = a if b is None else b
    n = F.greatest(F.size(b) - step, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, step + 1, n), lambda x, y: F.xxhash64(x, y))


def _value(word: Column) -> Column:
    """The word without the mark of its slot."""
    return F.when(_is_slot(word), F.substring(word, 2, 1_000_000)).otherwise(word)


def _type(word: Column) -> Column:
    """The word, or only the type of a slot."""
    return F.when(_is_slot(word), F.substring(word, 1, 1)).otherwise(word)


def _shape(words: Column) -> Column:
    """The words with slots reduced to their type."""
    return F.transform(words, _type)


def window_hashes(words: DataFrame, short: Sequence[int] = ()) -> DataFrame:
    """Add ``typed`` and ``plain``: one hash per window of ``WINDOW`` canonical words, in order; slots count
    by their type in the first and by their value, as plain words, in the second. Add ``short<n>``: the
    same as ``plain`` for windows of ``n`` words, for the lengths in ``short`` (below ``WINDOW``)."""
    rows = words
    for name, unit in (("typed", F.transform("words", lambda w: F.xxhash64(_type(w)))),
                       ("plain", F.transform("words", lambda w: F.xxhash64(_value(w))))):
        made, step = {n: None for n in short if name == "plain"}, 1
        rows = once(rows, f"__{name}", unit)
        while step < WINDOW:
            # the powers of two in a length, smallest first
            for n in made:
                if n & step:
                    done = n & (step - 1)
                    longer = F.col(f"__{name}") if made[n] is None else _pairwise(F.col(made[n]), done, F.col(f"__{name}"))
                    rows = once(rows, f"__n{n}_{step}", longer)
                    rows = rows.drop(made[n]) if made[n] else rows
                    made[n] = f"__n{n}_{step}"
            rows = once(rows, f"__{name}{2 * step}", _pairwise(F.col(f"__{name}"), step)).drop(f"__{name}")
            step, rows = 2 * step, rows.withColumnRenamed(f"__{name}{2 * step}", f"__{name}")
        rows = rows.withColumnRenamed(f"__{name}", name)
        for n, column in made.items():
            rows = rows.withColumnRenamed(column, f"short{n}")
    return rows


def _plain_only() -> Column:
    """Hashes of ``plain``, null where the window has no slot and ``typed`` says the same."""
    return F.zip_with("plain", "typed", lambda p, t: F.when(p != t, p))


def _windows(hashed: DataFrame, short: Sequence[int] = ()) -> DataFrame:
    """Explode the hashes into ``pos, h, typed, window`` (the words of the window)."""
    def cut(hashes: Column, typed: bool, length: int) -> Column:
        place = lambda h, i: F.struct(
            i.alias("pos"), h.alias("h"), F.lit(typed).alias("typed"), F.slice("words", i + 1, length).alias("window")
        )
        return F.transform(hashes, place)

    keys = [c for c in hashed.columns if c not in ("words", "typed", "plain", *(f"short{n}" for n in short))]
    cuts = [cut(F.col("typed"), True, WINDOW), cut(F.col("__only"), False, WINDOW), *(cut(F.col(f"short{n}"), False, n) for n in short)]
    rows = once(once(hashed, "__only", _plain_only()), "__cut", F.concat(*cuts))
    fields = [f"x.{c}" for c in ("pos", "h", "typed", "window")]
    return rows.select(*keys, F.explode("__cut").alias("x")).select(*keys, *fields).where(F.col("h").isNotNull())


def _alone(rows: DataFrame, hits: DataFrame, side: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Of the short items in ``side``: the hashes of common phrases, and the pairs of documents where
    such an item is a whole line, sentence or text. None where no item is common.

    ``hits`` are distinct rows ``doc_id, h``; the hashes are bounded by the benchmark.
    """
    n_docs = rows.select("doc_id").distinct().count()
    held = hits.where(F.col("h").isNotNull()).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    phrases = materialize(held.where((F.col("n") > 1) & (F.col("n") > COMMON_SHARE * n_docs)).select("h"), "template-phrases")
    if phrases.isEmpty():
        return None, None
    spoken = lambda words: F.array_join(F.transform(words, _value), " ")
    n_slots = F.size(F.array_distinct(F.filter("iwords", _is_slot))).cast("bigint")
    items = side.join(phrases, "h", "left_semi").select("item_id", spoken("iwords").alias("said"), n_slots.alias("n_slots"))
    parts = F.array_distinct(F.concat(F.array("t"), F.split("t", LINE_END), F.split("t", SENTENCE_END)))
    pieces = canonical(rows.select("doc_id", F.explode(parts).alias("part")), F.col("part"), "doc_id")
    pieces = pieces.where(F.size("words").between(1, WINDOW - 1)).select("doc_id", spoken("words").alias("said")).distinct()
    found = pieces.join(items, "said").select(
        "doc_id", "item_id", F.lit(1).cast("bigint").alias("n_windows"), F.lit(1).cast("bigint").alias("n_item_windows"),
        "n_slots", F.lit(0).cast("bigint").alias("n_renamed"), F.lit(True).alias("verbatim"),
    )
    return phrases, found.dropDuplicates(["doc_id", "item_id"])


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Pairs ``doc_id, item_id, n_windows, n_item_windows, n_slots, n_renamed, verbatim``.

    A window of the item is met typed (at least ``MIN_LITERALS`` literal words, any slot values) or
    plain (the same words whatever their case and spacing). A pair is returned when the document
    holds at least ``MIN_WINDOWS`` windows of the item, or ``MIN_COVERAGE`` of them (or of those
    with enough literals). Windows do not count if they hold an item value that stands for several
    values in this alignment, except plain windows of one unbroken run that is enough by itself. An
    item shorter than ``WINDOW`` words is one plain window of its own length. Where it is a common
    phrase (more than one document and more than ``COMMON_SHARE`` of all hold it), running text is no
    evidence: it must stand alone, as a whole line, sentence or text. Rows with a null document or
    item id, and null or empty texts, match nothing. Repeated rows count once; rows that share an id are one document. Extra
    columns are ignored.
    """
    item_rows = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("t"))
    item_words = canonical(item_rows.where(F.col("item_id").isNotNull()), F.coalesce("t", F.lit("")), "item_id")
    n_words = item_words.select(F.size("words").alias("n")).where(F.col("n").between(1, WINDOW - 1)).distinct()
    short = sorted(r["n"] for r in n_words.collect())  # lengths below WINDOW
    items = window_hashes(item_words, short).withColumn("n_words", F.size("words"))
    # of an item shorter than a window only the whole counts
    whole = F.size("window") == F.least(F.col("n_words"), F.lit(WINDOW))
    literals = F.size(F.filter("window", lambda w: ~_is_slot(w)))
    # a window with few literals is met by its values only
    side = materialize(
        _windows(items, short).where(whole)
        .withColumn("h", F.when(F.col("typed") & (literals < MIN_LITERALS), F.lit(None)).otherwise(F.col("h")))
        .select("item_id", F.col("pos").alias("ipos"), "h", F.col("window").alias("iwords"), (literals >= MIN_LITERALS).alias("open"))
        .where(F.col("h").isNotNull()).dropDuplicates(["item_id", "ipos", "h"]),
        "template-windows",
    )
    n_item = side.groupBy("item_id").agg(
        F.countDistinct("ipos").alias("n_item_windows"), F.countDistinct(F.when(F.col("open"), F.col("ipos"))).alias("n_open")
    )
    brief = F.size("iwords") < WINDOW
    keys = side.select("h", brief.alias("brief")).distinct()
    small = keys.count() <= BROADCAST_WINDOWS
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("t").isNotNull())
    # Only hashes meet the windows of the corpus; the texts of the few documents hit are read again.
    hashed = window_hashes(canonical(rows, F.col("t"), "doc_id"), short)
    hashes = F.concat("typed", _plain_only(), *(f"short{n}" for n in short))
    windows = hashed.select("doc_id", F.explode(hashes).alias("h")).where(F.col("h").isNotNull())
    found = windows.join(F.broadcast(keys) if small else keys, "h").select("doc_id", F.when(F.col("brief"), F.col("h")).alias("h"))
    hits = materialize(found.distinct(), "template-hits")
    phrases, alone = _alone(rows, hits, side.where(brief)) if short else (None, None)
    if phrases is not None:
        hits, side = hits.join(phrases, "h", "left_anti"), side.join(phrases, "h", "left_anti")
    # the documents hit grow with the corpus: never broadcast
    hit = materialize(rows.join(hits.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), "template-texts")
    met = _windows(window_hashes(canonical(hit, F.col("t"), "doc_id"), short), short).select(
        "doc_id", F.col("pos").alias("dpos"), "h", F.col("window").alias("dwords")
    ).join(side, "h")
    # the hash is confirmed on the words themselves
    values = lambda c: F.transform(c, _value)
    met = met.withColumn("exact", values(F.col("dwords")) == values(F.col("iwords")))
    same = met.where(F.col("exact") | (F.col("open") & (_shape(F.col("dwords")) == _shape(F.col("iwords")))))
    # both values of a slot under the item's mark: in a copy of other case a name is a plain word
    pair = lambda a, b: F.struct(a.alias("a"), F.concat(F.substring(a, 1, 1), _value(b)).alias("b"))
    slots = F.filter(F.zip_with("iwords", "dwords", pair), lambda x: _is_slot(x["a"]))
    # one alignment of item and document at a time: a document may hold an item twice, differently filled
    aligned = same.groupBy("doc_id", "item_id", (F.col("dpos") - F.col("ipos")).alias("shift")).agg(
        F.collect_set(F.struct("ipos", "open", "exact", slots.alias("slots"))).alias("met")
    ).join(n_item, "item_id")
    aligned = once(aligned, "pairs", F.array_distinct(F.flatten("met.slots")))
    exact = F.array_sort(F.array_distinct(F.transform(F.filter("met", lambda w: w["exact"]), lambda w: w["ipos"])))
    aligned = once(aligned, "exact", exact)
    # places of unbroken runs of `need` windows or more
    need = F.least(F.lit(MIN_WINDOWS), F.ceil(MIN_COVERAGE * F.col("n_item_windows"))).cast("int")
    at = lambda i: F.get("exact", i)
    unbroken = lambda _, i: F.exists(
        F.sequence(F.lit(0), need - 1), lambda d: F.coalesce(at(i - d + need - 1) - at(i - d) == need - 1, F.lit(False))
    )
    aligned = once(aligned, "runs", F.filter("exact", unbroken))
    # item values that stand for several document values take their windows with them, no others
    aligned = once(aligned, "named", F.transform("pairs", lambda x: x["a"]))
    aligned = once(aligned, "torn", F.array_distinct(F.filter("named", lambda a, i: F.array_position("named", a) != i + 1)))
    agrees = lambda w: ~F.exists(w["slots"], lambda x: F.array_contains("torn", x["a"]))
    counted = F.filter("met", lambda w: agrees(w) | (w["exact"] & F.array_contains("runs", w["ipos"])))
    per_pair = aligned.groupBy("doc_id", "item_id", "n_item_windows", "n_open").agg(F.flatten(F.collect_list(counted)).alias("met"))
    places = lambda c: F.size(F.array_distinct(F.transform(c, lambda w: w["ipos"]))).cast("bigint")
    per_pair = per_pair.select(
        "doc_id", "item_id", places("met").alias("n_windows"), "n_item_windows", "n_open",
        places(F.filter("met", lambda w: w["open"])).alias("n_open_met"), F.array_distinct(F.flatten("met.slots")).alias("slots"),
    )
    renamed = F.size(F.filter("slots", lambda x: x["a"] != x["b"]))
    part = lambda n, of: (F.col(of) > 0) & (F.col(n) >= MIN_COVERAGE * F.col(of))
    enough = (F.col("n_windows") >= MIN_WINDOWS) | part("n_windows", "n_item_windows") | part("n_open_met", "n_open")
    pairs = per_pair.where(enough).select(
        "doc_id", "item_id", "n_windows", "n_item_windows",
        F.size("slots").cast("bigint").alias("n_slots"), renamed.cast("bigint").alias("n_renamed"),
        (renamed == 0).alias("verbatim"),
    )
    return pairs if alone is None else pairs.unionByName(alone)
