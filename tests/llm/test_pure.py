"""Rules of the training-data operators that need no session."""

import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from eventlens.llm import common, near_dedup, packing, quality_model, repeats, rules, textstats, token_counts, tokens, training_order
from eventlens.llm.queries import VOCABULARIES

WORD_PATH = f"{VOCABULARIES}/word_bpe_49k.json"
BYTE_PATH = f"{VOCABULARIES}/byte_bpe_50k.tiktoken"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 100, 1000, 4097])
def test_permutation_is_one_to_one_and_reversible(n):
    slots = training_order.permuted(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert (training_order.permuted(slots, n, backwards=True) == np.arange(n)).all()


def test_permutation_depends_on_the_key():
    numbers = np.arange(1000)
    assert (training_order.permuted(numbers, 1000, key=1) != training_order.permuted(numbers, 1000, key=2)).mean() > 0.9


def made_documents(seed):
    rng = random.Random(seed)
    base = bytes(rng.choice(b"abc") for _ in range(300))

    def part():
        start = rng.randrange(200)
        return rng.choice([base[start : start + rng.randrange(20, 100)], bytes(rng.choice(b"ab") for _ in range(30))])

    return [b"".join(part() for _ in range(5)) for _ in range(6)]


@pytest.mark.parametrize("seed", range(10))
def test_suffix_order_finds_earlier_matches(seed):
    texts, length = made_documents(seed), repeats.LENGTH
    starts, docs, want, seen, at = [], [], [], [set() for _ in made_documents(seed)], 0
    for d, text in enumerate(texts):
        for s in range(len(text) - length + 1):
            window = text[s : s + length]
            starts.append(at + s)
            docs.append(d)
            want.append(any(window in earlier for earlier in seen[:d]))
            seen[d].add(window)
        at += len(text)
    order = np.random.default_rng(seed).permutation(len(starts))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    got = repeats.repeated(data, np.array(starts)[order], np.array(docs)[order])
    assert (got == np.array(want)[order]).all()


@pytest.mark.parametrize("seed", range(5))
def test_equal_windows_have_equal_anchors(seed):
    named = {}
    for text in made_documents(seed):
        anchors, firsts, ends = repeats.runs(text)
        assert firsts.tolist() == [0, *ends.tolist()[:-1]] and ends[-1] == len(text) - repeats.LENGTH + 1
        for anchor, a, b in zip(anchors.tolist(), firsts.tolist(), ends.tolist()):
            assert all(named.setdefault(text[s : s + repeats.LENGTH], anchor) == anchor for s in range(a, b))


def test_runs_do_not_depend_on_chunks(monkeypatch):
    text = made_documents(1)[0] * 4
    whole = repeats.runs(text)
    monkeypatch.setattr(repeats, "CHUNK", 64)
    cut = repeats.runs(text)
    spread = [np.repeat(a, e - f).tolist() for a, f, e in (whole, cut)]
    assert spread[0] == spread[1]


def test_repeat_words_against_a_plain_count():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice("abc") for _ in range(rng.randrange(0, 40))]
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        counted = dict(zip(textstats.COUNTS, textstats.count_text(" ".join(words).encode())))
        assert counted["n_repeat_words"] == len(covered) and counted["n_words"] == len(words)


def test_counts_of_one_text():
    counted = dict(zip(textstats.COUNTS, textstats.count_text("Aé b#\n \nx|\nAé b#\n".encode())))
    assert (counted["n_words"], counted["word_chars"], counted["n_symbols"], counted["n_dup_lines"]) == (5, 10, 3, 1)


def plain_forward(word, pieces, unknown):
    cells = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n_bytes = len(word[end - 1].encode())
        found = [(cells[end - 1][0] + n_bytes * unknown, -cells[end - 1][1] - n_bytes)]
        found += [(cells[s][0] + pieces[word[s:end]], -cells[s][1] - 1) for s in range(end) if word[s:end] in pieces]
        score, tokens_ = max(found)
        cells.append((score, -tokens_))
    return cells[-1][1]


def test_shared_prefixes_count_like_single_words():
    rng = random.Random(5)
    pieces = {p: -rng.random() * 5 for p in ["a", "b", "ab", "ba", "aba", "▁", "▁a", "▁ab", "bb"]}
    words = {"▁" + "".join(rng.choice("abé") for _ in range(rng.randrange(1, 8))) for _ in range(500)}
    counts = token_counts.forward(words, pieces, 4, -20.0)
    assert counts == {w: plain_forward(w, pieces, -20.0) for w in words}


@pytest.mark.parametrize("width", [2, 5])
def test_shingle_hashes_count_like_sets(width):
    rng = random.Random(7)
    texts = [b"", b"One", b"one TWO three two one two", b"  a b\na b a\tb ", "é à b c é à".encode(), b""]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60))).encode() for _ in range(50)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    hashes, begin = near_dedup.shingle_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets, width)
    for i, text in enumerate(texts):
        n, keys = near_dedup.bands(hashes[begin[i] : begin[i + 1]])
        assert n == len(near_dedup.shingle_set(text, width)) and (keys is None) == (n == 0)


def test_small_sets_borrow_and_still_meet():
    a = np.arange(1, 11, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    met = sum((near_dedup.bands(a[:10])[1] == near_dedup.bands(a[1:])[1]).any() for _ in range(1))
    assert met == 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once_and_nearly_fills(seed):
    rng = random.Random(seed)
    counts = Counter(min(100, int(rng.lognormvariate(3, 1)) + 1) for _ in range(5000))
    plan = packing.plan(dict(counts), 100)
    used = Counter()
    for pattern, repeats_ in plan:
        assert sum(pattern) <= 100 and repeats_ > 0
        for length in pattern:
            used[length] += repeats_
    assert used == counts
    total = sum(k * n for k, n in counts.items())
    assert sum(m for _, m in plan) <= -(-total // 100) * 1.02 + 1


def test_plan_of_nothing():
    assert packing.plan({}, 100) == []


def test_patterns_fill_exactly():
    found = packing.patterns([10, 20, 30, 40, 100], 100)
    assert found and all(sum(p) == 100 and len(p) <= packing.FEW for p in found) and (100,) in found


def test_binomial_tail():
    assert rules.binomial_tail(0, 100, 0.05) == pytest.approx(0.95**100)
    assert rules.binomial_tail(3, 10, 0.5) == pytest.approx(176 / 1024)
    assert rules.binomial_tail(10, 10, 0.5) == 1.0


def test_only_certified_cutoffs_are_chosen():
    bad = np.array([0, 0, 0, 50])
    assert rules.certify(np.array([1000, 0, 0, 0]), bad, 0.01, 0.01) == 2
    assert rules.certify(np.array([50, 0, 0, 0]), bad, 0.01, 0.01) == -1  # too few labels
    assert rules.certify(np.array([900, 0, 0, 100]), bad, 0.01, 0.01) == -1  # too many good ones rejected


def test_isotonic_is_monotone_and_pools_ties():
    knots, values = quality_model.isotonic(np.array([0.1, 0.1, 0.2, 0.3, 0.3, 0.9]), np.array([0, 1, 0, 1, 0, 1]))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all() and 0 < values[0] < values[-1] < 1


def test_word_ids_equal_the_tokenizers():
    encode, whole = tokens.word_encoder(WORD_PATH), Tokenizer.from_file(WORD_PATH)
    rng = random.Random(11)
    parts = [*"aAbB.,'sS 12\n\t\xa0\x85\x1c\x0béÉ́Σσİß ​中😀", "<|endoftext|>", "don't", "'ll", "  "]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 30)))
        ids = whole.encode(text, add_special_tokens=False).ids
        assert encode(text) == np.array(ids, dtype="<u4").tobytes(), repr(text)


def test_a_full_table_changes_no_ids(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_KEPT", 2)
    encode, whole = tokens.WordEncoder(WORD_PATH), Tokenizer.from_file(WORD_PATH)
    for text in ("one two three", "two four", "one two", "", " \n "):
        assert encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_a_worker_keeps_little_after_its_task(monkeypatch):
    assert tokens.MAX_KEPT * 200 <= 128 << 20

    class Pool:
        released = 0

        def release_unused(self):
            self.released += 1

    pool = Pool()
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool)
    step = common.lean(lambda batches: (b * 2 for b in batches))(iter([1, 2, 3]))
    assert next(step) == 2 and pool.released == 0
    assert list(step) == [4, 6] and pool.released == 1
