"""Unigram token counts of documents with one forward pass per shared prefix.

The distinct pre-tokens (words between white space) that a task has not seen yet are put into a trie,
walked in sorted order: the path to the current word is a stack of forward cells, and a word starts
from the cells it shares with the word before, so every trie node is scored once however many words
run through it. The cell of a node holds the best log probability and the number of tokens of its
best segmentation; the cell at a word's end is its token count. A document's count is the sum over
its words.

The vocabulary is a public one, given by path, in order of frequency; a piece's log probability is
taken from its place (Zipf), and characters without a piece cost one token per UTF-8 byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MAX_KEPT = 400_000
SHIFT = 2.7
BYTE_PENALTY = 10.0


def forward(words: Iterable[str], pieces: dict[str, float], longest: int, unknown: float) -> dict[str, int]:
    """Token count of each distinct word. Of equally likely segmentations the shorter counts."""
    counts: dict[str, int] = {}
    before = ""
    best, tokens = [0.0], [0]  # forward cells along the path, one per character
    for word in sorted(set(words)):
        shared, limit = 0, min(len(before), len(word))
        while shared < limit and before[shared] == word[shared]:
            shared += 1
        del best[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            n_bytes = len(word[end - 1].encode())
            top, count = best[end - 1] + n_bytes * unknown, tokens[end - 1] + n_bytes
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                score = pieces.get(word[start:end])
                if score is not None:
                    score += best[start]
                    if score > top or (score == top and tokens[start] + 1 < count):
                        top, count = score, tokens[start] + 1
            best.append(top)
            tokens.append(count)
        counts[word] = tokens[-1]
        before = word
    return counts


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, float], int, float]:
    """Pieces with log probabilities, the longest piece, and the log probability of a fallback byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    weights = [1.0 / (place + SHIFT) for place in range(len(ids))]
    total = math.log(sum(weights))
    pieces = {model.id_to_piece(i): math.log(w) - total for i, w in zip(ids, weights)}
    return pieces, max(map(len, pieces)), math.log(weights[-1]) - total - BYTE_PENALTY


@lru_cache(maxsize=2)
def kept_counts(path: str) -> dict[str, int]:
    """What this Python worker has counted so far, at most ``MAX_KEPT`` words."""
    return {}


def counted(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` of every row.

    A null, empty or blank text has no token. Repeated rows each get their counts; a null id is kept;
    extra columns are ignored.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, longest, unknown = vocabulary(vocabulary_path)
        known = kept_counts(vocabulary_path)
        for batch in batches:
            texts = [text.as_py().split() for text in batch.column("t")]
            new = {word for words in texts for word in words if word not in known}
            fresh = {w[1:]: n for w, n in forward([MARK + w for w in new], pieces, longest, unknown).items()}
            if len(known) + len(fresh) <= MAX_KEPT:
                known.update(fresh)
                totals = [sum(map(known.__getitem__, words)) for words in texts]
            else:
                totals = [sum([known[w] if w in known else fresh[w] for w in words]) for words in texts]
            columns = [batch.column("doc_id"), pa.array([len(w) for w in texts], pa.int64()), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pretokens", "n_tokens"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(count, f"doc_id {kind}, n_pretokens bigint, n_tokens bigint")
