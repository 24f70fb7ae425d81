"""Shared byte-level piece vocabulary over all text fields, learned by Spark jobs.

Raw rows are read once, for the counts of distinct words. The counts of adjacent pairs are taken once
too and then kept up by differences: at most one number per pair of pieces, so their table is
bounded by the vocabulary and stays on the driver. A job replays a run of guessed merges on all words:
each batch of words indexes which word holds which pair, a merge touches only the words that hold
its pair, and what it changes in the pair counts comes back per merge. The driver then follows the run
with the exact counts as long as every guess was the best pair, and goes on from the first that was
not. So the merges are those of a full recount after every one, in far fewer jobs; the guesses come
from a bounded number of frequent words and decide nothing but the number of jobs.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.operators.ordered import heavy_groups
from eventlens.operators.skew import join_per_entity
from eventlens.session import materialize

# Fixed value: the pre-token pattern of byte-level BPE (contractions, letters, digits,
# other marks, blanks). Blank means any Unicode white space.
PRETOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+"
    r"| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
N_BYTES = 256
FIRST_MERGE_ID = 1 + N_BYTES
# Guessed merges per job, and merges after which the words are written anew.
GUESSES = 128
MERGES_PER_TABLE = 512
# Words that guesses are made from: the most frequent ones, without very long ones.
GUESS_WORDS = 20_000
GUESS_LENGTH = 64
# A dictionary of distinct texts is broadcast up to this size.
DICTIONARY_BYTES = 32 << 20


def byte_ids() -> list[int]:
    """Local id of each byte: bytes with a printable Latin-1 character first, then the
    others, each in byte order; id 0 is the unknown piece."""
    shown = [b for b in range(N_BYTES) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(N_BYTES) if b not in set(shown)]
    ids = [0] * N_BYTES
    for i, b in enumerate(shown + hidden):
        ids[b] = i + 1
    return ids


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


def word_counts(texts: DataFrame) -> DataFrame:
    """Distinct words with counts, from distinct texts ``(txt, n)``: a text that fills a
    third of the rows is split into words once."""
    words = texts.select(F.explode(pretokens(F.col("txt"))).alias("word"), "n")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def _spell(word: Column) -> Column:
    """Local ids of the word's bytes."""
    table = F.array(*[F.lit(i) for i in byte_ids()])
    raw = F.hex(F.encode(word, "UTF-8"))
    places = F.sequence(F.lit(1), F.length(raw), F.lit(2))
    return F.transform(
        places, lambda p: F.element_at(table, F.conv(F.substr(raw, p, F.lit(2)), 16, 10).cast("int") + 1)
    )


def pair_counts(words: DataFrame) -> dict[tuple[int, int], int]:
    """How often each pair of neighbours stands in the words ``(pieces, n)``."""
    following = F.arrays_zip(
        F.slice("pieces", F.lit(1), F.size("pieces") - 1).alias("l"), F.slice("pieces", F.lit(2), F.size("pieces") - 1).alias("r")
    )
    pairs = words.where(F.size("pieces") > 1).select(F.explode(following).alias("p"), "n")
    counted = pairs.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("n").alias("n"))
    return {(r["l"], r["r"]): r["n"] for r in counted.collect()}


def _replayer() -> Callable:
    """The replay of merges on a list of words. Made anew where it is used, so that it travels to the
    executors with the job."""

    def merged(ids: list[int], left: int, right: int, new: int) -> list[int]:
        out, i = [], 0
        while i < len(ids):
            if ids[i] == left and i + 1 < len(ids) and ids[i + 1] == right:
                out.append(new)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        return out

    def index(words: list[list[int]]) -> dict[tuple[int, int], set[int]]:
        holders: dict[tuple[int, int], set[int]] = {}
        for w, ids in enumerate(words):
            for pair in zip(ids, ids[1:]):
                holders.setdefault(pair, set()).add(w)
        return holders

    def apply(words, weights, holders, merge) -> dict[tuple[int, int], int]:
        """Apply one merge in place; the change of every pair count."""
        left, right, new = merge
        change: dict[tuple[int, int], int] = {}
        for w in holders.pop((left, right), ()):
            ids = words[w]
            after = merged(ids, left, right, new)
            if len(after) == len(ids):
                continue  # it held the pair once, no longer
            for pair in zip(ids, ids[1:]):
                change[pair] = change.get(pair, 0) - weights[w]
            for pair in zip(after, after[1:]):
                change[pair] = change.get(pair, 0) + weights[w]
                holders.setdefault(pair, set()).add(w)
            words[w] = after
        return {p: c for p, c in change.items() if c}

    return index, apply


def _replayed(words: DataFrame, done: Sequence[tuple], guesses: Sequence[tuple]) -> list[dict[tuple[int, int], int]]:
    """Per guess, the change of the pair counts of all words if it follows the guesses before it."""
    index, apply = _replayer()

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, weights = batch.column("pieces").to_pylist(), batch.column("n").to_pylist()
            holders = index(lists)
            for merge in done:
                apply(lists, weights, holders, merge)
            rows = [(i, *pair, c) for i, merge in enumerate(guesses) for pair, c in apply(lists, weights, holders, merge).items()]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3], pa.int64())], ["step", "l", "r", "n"]
            )

    found = words.mapInArrow(changes, "step int, l int, r int, n bigint").groupBy("step", "l", "r").agg(F.sum("n").alias("n"))
    out: list[dict[tuple[int, int], int]] = [{} for _ in guesses]
    for r in found.where(F.col("n") != 0).collect():
        out[r["step"]][r["l"], r["r"]] = r["n"]
    return out


def _rewritten(words: DataFrame, done: Sequence[tuple]) -> DataFrame:
    """The words with merges applied."""
    index, apply = _replayer()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pieces").to_pylist()
            weights, holders = [0] * len(lists), index(lists)
            for merge in done:
                apply(lists, weights, holders, merge)
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), batch.column("n")], ["pieces", "n"])

    return words.mapInArrow(step, "pieces array<int>, n bigint")


class _Ranking:
    """Pair counts with the best pair at hand: the most frequent one, ties by the smaller ids."""

    def __init__(self, counts: dict[tuple[int, int], int]):
        self.counts = dict(counts)
        self.heap = [(-n, pair) for pair, n in counts.items()]
        heapq.heapify(self.heap)

    def change(self, by: dict[tuple[int, int], int]) -> None:
        for pair, n in by.items():
            self.counts[pair] = total = self.counts.get(pair, 0) + n
            heapq.heappush(self.heap, (-total, pair))

    def best(self, at_least: int) -> tuple[int, int] | None:
        while self.heap and self.counts.get(self.heap[0][1]) != -self.heap[0][0]:
            heapq.heappop(self.heap)  # an older count
        return self.heap[0][1] if self.heap and -self.heap[0][0] >= at_least else None


class _Pieces:
    """Names of pieces: a pair that spells a known piece has its id."""

    def __init__(self) -> None:
        self.of_id = {i: f"{b:02x}" for b, i in enumerate(byte_ids())}
        self.spelled = {text: i for i, text in self.of_id.items()}
        self.next_id = FIRST_MERGE_ID

    def copy(self) -> _Pieces:
        other = _Pieces.__new__(_Pieces)
        other.of_id, other.spelled, other.next_id = dict(self.of_id), dict(self.spelled), self.next_id
        return other

    def named(self, pair: tuple[int, int]) -> tuple[int, int, int]:
        text = self.of_id[pair[0]] + self.of_id[pair[1]]
        if text not in self.spelled:
            self.spelled[text], self.of_id[self.next_id] = self.next_id, text
            self.next_id += 1
        return (*pair, self.spelled[text])


def _guessed(
    counts: dict[tuple[int, int], int], frequent: tuple[list[list[int]], list[int]], pieces: _Pieces, vocab_size: int,
    at_least: int, most: int,
) -> list[tuple[int, int, int]]:
    """The merges that would follow if the pair counts changed as they do in the frequent words. The first is right."""
    index, apply = _replayer()
    words, weights = list(frequent[0]), frequent[1]
    holders, ranking, names, out = index(words), _Ranking(counts), pieces.copy(), []
    while len(out) < most and names.next_id < vocab_size:
        pair = ranking.best(at_least)
        if pair is None:
            break
        out.append(names.named(pair))
        ranking.change(apply(words, weights, holders, out[-1]))
        ranking.change({pair: -ranking.counts[pair]})
    return out


def learn_merges(
    words: DataFrame, vocab_size: int, min_frequency: int = 1, *, guesses: int = GUESSES, guess_words: int = GUESS_WORDS
) -> list[tuple[int, int, int]]:
    """Merges in order, as ``(left, right, new)`` local ids. Most frequent pair first, ties
    by the smaller left and then right id; a pair spelling a known piece reuses its id."""
    at_least = max(1, min_frequency)
    state = materialize(words.select(_spell(F.col("word")).alias("pieces"), "n"), "text-words")
    short = state.where(F.size("pieces").between(2, GUESS_LENGTH)).orderBy(F.desc("n"), "pieces").limit(guess_words).collect()
    frequent = [list(r["pieces"]) for r in short], [r["n"] for r in short]
    ranking, pieces = _Ranking(pair_counts(state)), _Pieces()
    index, apply = _replayer()
    holders = index(frequent[0])
    merges: list[tuple[int, int, int]] = []
    written, wanted = 0, guesses
    while pieces.next_id < vocab_size:
        run = _guessed(ranking.counts, frequent, pieces, vocab_size, at_least, wanted)
        if not run:
            break
        right = 0
        for merge, change in zip(run, _replayed(state, merges[written:], run)):
            if ranking.best(at_least) != merge[:2]:
                break
            right += 1
            merges.append(pieces.named(merge[:2]))
            ranking.change(change)
            apply(*frequent, holders, merge)
        wanted = min(guesses, max(4, 2 * right))
        if len(merges) - written >= MERGES_PER_TABLE:
            state, written = materialize(_rewritten(state, merges[written:]), "text-words"), len(merges)
    return merges


def _speller(merges: Sequence[tuple[int, int, int]], base_id: int) -> Callable[[str], list[int]]:
    """The spelling of one word. The helper is nested so that it travels to the executors with the
    job, without an installed package there."""
    ranks: dict[tuple[int, int], tuple[int, int]] = {}
    for i, (left, right, new) in enumerate(merges):
        ranks.setdefault((left, right), (i, new))
    first = byte_ids()
    last = (len(ranks), 0)

    def spell_word(word: str) -> list[int]:
        """Lowest-ranked pair first, all its places from the left, until none is known."""
        ids = [first[b] for b in word.encode("utf-8")]
        while len(ids) > 1:
            best = min(zip(ids, ids[1:]), key=lambda p: ranks.get(p, last)[0])
            if best not in ranks:
                break
            out: list[int] = []
            i = 0
            while i < len(ids):
                if tuple(ids[i : i + 2]) == best:
                    out.append(ranks[best][1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return [base_id + i for i in ids]

    return spell_word


def text_ids(text: Column, merges: Sequence[tuple[int, int, int]], base_id: int, first_words: int | None = None) -> Column:
    """All piece ids of a text (of its first words), in the shared id space.

    Words are cut out by Spark; the merge loop over one word is the only Python. It runs on
    Arrow batches in place (no shuffle on words, so a frequent word is no hot key), and each
    batch spells every distinct word once.
    """
    spell_word = _speller(merges, base_id)

    @F.pandas_udf("array<int>")
    def spell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            rows = []
            for words in batch:
                if words is None:
                    rows.append(None)
                    continue
                for w in words:
                    if w not in seen:
                        seen[w] = spell_word(w)
                rows.append([i for w in words for i in seen[w]])
            yield pd.Series(rows, dtype="object")

    return spell(pretokens(text) if first_words is None else F.slice(pretokens(text), 1, first_words))


def text_dictionary(
    rows: DataFrame, keys: Sequence[str], merges: Sequence[tuple[int, int, int]], base_id: int, cap: int, **kw
) -> DataFrame | None:
    """``(txt, ids)``: the first ``cap`` piece ids of every distinct text of the given columns.

    Each distinct word is spelled once: words keep the text and place that they came from, meet their
    spelling in a join that sends frequent words by broadcast (see ``join_per_entity``), and are put
    together again by text. A word has a piece at least, so the first ``cap`` words of a text are
    enough. Where the distinct texts are too many to be broadcast, the result is None: rows are then
    spelled in place (``text_ids``), as a join on nearly distinct texts would shuffle all of them.
    """
    texts = rows.select(F.explode(F.array(*[F.col(k).cast("string") for k in keys])).alias("txt")).where(F.col("txt").isNotNull())
    rough = texts.agg(F.approx_count_distinct("txt").alias("n"), F.avg(F.octet_length("txt")).alias("bytes")).first()
    if rough["n"] * ((rough["bytes"] or 0) + 4 * cap) > 2 * DICTIONARY_BYTES:
        return None
    distinct = materialize(texts.distinct(), "distinct-texts")
    placed = distinct.select("txt", F.posexplode(F.slice(pretokens(F.col("txt")), 1, cap)).alias("place", "word"))
    spell_word = _speller(merges, base_id)

    @F.pandas_udf("array<int>")
    def spelled(words: pd.Series) -> pd.Series:
        return pd.Series([spell_word(w) for w in words], dtype="object")

    words = materialize(placed.select("word").distinct().withColumn("ids", spelled("word")), "spelled-words")
    met = join_per_entity(placed, words, "inner", heavy_groups(placed, ["word"], **kw), key="word")
    whole = met.groupBy("txt").agg(F.array_sort(F.collect_list(F.struct("place", "ids"))).alias("words"))
    joined = F.slice(F.flatten(F.transform("words", lambda w: w["ids"])), 1, cap)
    found = materialize(distinct.join(whole, "txt", "left").select("txt", F.coalesce(joined, F.array().cast("array<int>")).alias("ids")), "text-dictionary")
    size = found.agg(F.sum(F.octet_length("txt") + 4 * F.size("ids") + 16)).first()[0] or 0
    return found if size <= DICTIONARY_BYTES else None
