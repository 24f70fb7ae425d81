"""The text vocabulary against an independent byte-level BPE."""

import pytest
from pyspark.sql import functions as F

from eventlens.operators import textvocab as tv

tokenizers = pytest.importorskip("tokenizers")


def library(texts, vocab_size, min_frequency=1):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    t = Tokenizer(models.BPE(unk_token="<unk>"))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    t.train_from_iterator(
        texts or [""],
        trainer=trainers.BpeTrainer(
            vocab_size=vocab_size, min_frequency=min_frequency, special_tokens=["<unk>"],
            initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False,
        ),
    )
    return t


def learn(spark, texts, vocab_size, min_frequency=1):
    df = spark.createDataFrame([(t, 1) for t in texts], "txt string, n bigint")
    return tv.learn_merges(tv.word_counts(df), vocab_size, min_frequency)


def encode(spark, merges, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", tv.text_ids(F.col("t"), merges, 0).alias("ids")).orderBy("i").collect()
    return [list(r["ids"]) for r in rows]


PARTS = [f"{a} {b}" for a in ("small", "red", "blue", "large", "shiny", "old") for b in ("ring", "widget", "bolt", "gear")]


def test_byte_ids_follow_the_alphabet():
    ids = tv.byte_ids()
    assert sorted(ids) == list(range(1, 257))
    lib = library([], 257)
    assert lib.get_vocab()["a"] == ids[ord("a")]
    assert lib.get_vocab()["Ġ"] == ids[ord(" ")]


def test_merges_and_codes_on_part_names(spark):
    merges = learn(spark, PARTS, 330)
    lib = library(PARTS, 330)
    assert 257 + len({m[2] for m in merges}) == lib.get_vocab_size()
    unseen = [*PARTS, "small bolts, regions & 12 gears!", "it's  re-ringed", "x", ""]
    assert encode(spark, merges, unseen) == [lib.encode(t).ids for t in unseen]


def test_multilingual_documents(spark):
    docs = [
        r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
        .orderBy("doc_id").select(F.col("text")).collect()
    ]
    merges = learn(spark, docs, 300)
    lib = library(docs, 300)
    assert encode(spark, merges, docs) == [lib.encode(t).ids for t in docs]


def test_marks_blanks_and_scripts(spark):
    texts = ["a  b\t\nc ", "naïve café", "日本語 テキスト", "Ω≈ç√", "don't we'll I'd", "emoji 🙂🙂", "1234 x-9", " nbsp em"]
    merges = learn(spark, texts, 290)
    lib = library(texts, 290)
    assert encode(spark, merges, texts) == [lib.encode(t).ids for t in texts]


def test_min_frequency_stops_the_merges(spark):
    merges = learn(spark, PARTS, 512, min_frequency=4)
    lib = library(PARTS, 512, min_frequency=4)
    assert 257 + len({m[2] for m in merges}) == lib.get_vocab_size()


def test_null_text(spark):
    df = spark.createDataFrame([(None,), ("ab",)], "t string")
    rows = df.select(tv.text_ids(F.col("t"), [], 10).alias("ids")).collect()
    assert rows[0]["ids"] is None and len(rows[1]["ids"]) == 2


SERIAL = [f"Supplier#{i:09d}" for i in range(1, 60)] + ["aaaa aaa", "0000000", "ababab abab", "aabaab"]


def recounted(texts, vocab_size):
    """Merges by a full recount after each."""
    from collections import Counter

    import regex

    pattern = regex.compile(tv.PRETOKEN.replace("IsWhite_Space", "White_Space"))
    ids = tv.byte_ids()
    words = Counter(w for x in texts for w in pattern.findall(x))
    state, names, out = [([ids[b] for b in w.encode()], n) for w, n in words.items()], tv._Pieces(), []
    while names.next_id < vocab_size:
        pairs = Counter()
        for word, n in state:
            for p in zip(word, word[1:]):
                pairs[p] += n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        out.append(names.named(best))
        after = []
        for word, n in state:
            new, i = [], 0
            while i < len(word):
                hit = tuple(word[i : i + 2]) == best
                new.append(out[-1][2] if hit else word[i])
                i += 2 if hit else 1
            after.append((new, n))
        state = after
    return out


@pytest.mark.parametrize("settings", [{}, {"guess_words": 0}, {"guess_words": 7, "guesses": 9}, {"guesses": 1}])
def test_merges_do_not_depend_on_the_guesses(spark, settings):
    texts = PARTS + SERIAL
    df = spark.createDataFrame([(t, 1) for t in texts], "txt string, n bigint").repartition(5)
    size = 275 if settings.get("guesses") == 1 or settings.get("guess_words") == 0 else 320
    assert tv.learn_merges(tv.word_counts(df), size, **settings) == recounted(texts, size)


def test_words_are_written_anew_after_some_merges(spark, monkeypatch):
    monkeypatch.setattr(tv, "MERGES_PER_TABLE", 5)
    df = spark.createDataFrame([(t, 2) for t in PARTS + SERIAL], "txt string, n bigint")
    assert tv.learn_merges(tv.word_counts(df), 290, guesses=8) == recounted(PARTS + SERIAL, 290)


def test_right_guesses_need_few_jobs(spark, monkeypatch):
    runs = []
    real = tv._replayed
    monkeypatch.setattr(tv, "_replayed", lambda *a: runs.append(len(a[2])) or real(*a))
    merges = learn(spark, PARTS + SERIAL, 330)
    assert len(merges) > 60 and len(runs) <= 2


def test_repeated_signs_like_the_library(spark):
    merges = learn(spark, SERIAL, 300)
    lib = library(SERIAL, 300)
    assert encode(spark, merges, SERIAL) == [lib.encode(t).ids for t in SERIAL]


TEXTS = [*PARTS, *SERIAL, "", " ", None, "a the the the the the the the the the the", "it's  re-ringed", "naïve café " * 30]


@pytest.mark.parametrize("rows_per_task", [3, 10**9])
@pytest.mark.parametrize("cap", [1, 8, 1000])
def test_dictionary_equals_spelling_in_place(spark, rows_per_task, cap):
    """With three rows a task, frequent words go by broadcast."""
    merges = recounted(PARTS, 300)
    rows = spark.createDataFrame([(t, TEXTS[-1 - i]) for i, t in enumerate(TEXTS)] * 2, "x string, y string").repartition(4)
    found = {r["txt"]: list(r["ids"]) for r in tv.text_dictionary(rows, ["x", "y"], merges, 100, cap, rows_per_task=rows_per_task).collect()}
    in_place = rows.select("x", F.slice(tv.text_ids(F.col("x"), merges, 100, cap), 1, cap).alias("ids")).where("x is not null").collect()
    assert found == {r["x"]: list(r["ids"]) for r in in_place} and found[""] == []


def test_too_many_texts_are_spelled_in_place(spark, monkeypatch):
    rows = spark.createDataFrame([(t,) for t in PARTS], "x string")
    monkeypatch.setattr(tv, "DICTIONARY_BYTES", 100)
    assert tv.text_dictionary(rows, ["x"], [], 0, 8) is None
    assert tv.text_dictionary(rows.limit(0), ["x"], [], 0, 8).count() == 0
