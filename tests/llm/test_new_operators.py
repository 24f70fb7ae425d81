"""Manifest, SimHash and vector codes against plain versions, and the cases that tables may bring."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventlens.llm import merkle, simhash, vector_codes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, hash string, path int, idx int, tree string, fp bigint, stripe int"


def table(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(i, t, lang, src, None if t is None else len(t), "h", 1, 2, "t", 5, 6) for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


def rough_rows():
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "theta"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))), rng.choice(["en", "de", "é", "", None]), rng.choice(["a", None])) for i in range(70)]
    base = [rng.choice(words) + str(i) for i in range(300)]
    for i in range(25):
        edited = list(base)
        edited[rng.randrange(300)] = f"edit{i}"
        rows.append((200 + i, " ".join(edited), "en", "b"))
    rows += [(100, None, "en", "a"), (101, "", None, None), (102, "  \n\t ", "en", "a"), (103, "long " * 30_000, "en", "a")]
    rows += [(None, "no id at all here", "en", None), (None, rows[5][1], "xx", "a"), (104, rows[3][1], "en", "b"), (105, rows[3][1], "en", "b"), (105, rows[3][1], "en", "b")]
    return rows


@pytest.fixture(scope="module")
def rough(spark):
    return table(spark, rough_rows()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


# manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    values = [row[c] for c in merkle.LEAF_COLUMNS]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """Levels from the leaves to the root, and the siblings of every leaf."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    ways = []
    for i in range(len(leaves)):
        ways.append("".join(level[(i >> k) ^ 1] for k, level in enumerate(levels[:-1]) if (i >> k) ^ 1 < len(level)))
    return levels[-1][0], ways


def plain_proofs(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, beyond = plain_tree([trees[g][0] for g in names])
    out = []
    for g, more in zip(names, beyond):
        for leaf, way in zip(sorted(groups[g]), trees[g][1]):
            out.append((leaf[1] if leaf[0] else None, leaf[2], trees[g][0], root, sha(way + more)))
    return sorted(out, key=str)


def proven(df):
    found = df.select(
        F.col("key"), F.col("hash"), "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("p"),
        merkle.folded(F.col("hash"), F.col("path")).alias("folded"),
    ).collect()
    assert all(r["folded"] == r["root"] for r in found)
    return sorted(((r["key"], r["hash"], r["subroot"], r["root"], r["p"]) for r in found), key=str)


@pytest.mark.parametrize("bits", [2, 9])
def test_manifest_and_proofs_equal_the_plain_tree(rough, bits):
    assert proven(merkle.manifest(rough, bits=bits).prove()) == plain_proofs(rough.collect())


def test_manifest_does_not_depend_on_partitions(rough):
    one, many = (merkle.manifest(rough.repartition(n), bits=2) for n in (1, 9))
    assert one.groups.roots.collect() == many.groups.roots.collect()


def test_proofs_of_some_leaves_equal_those_of_all(spark, rough):
    m = merkle.manifest(rough, bits=2)
    ids = spark.createDataFrame([(3,), (100,), (103,), (215,), (215,), (9999,)], "key bigint")
    few = proven(m.prove(ids))
    assert few == [x for x in proven(m.prove()) if x[0] in (3, 100, 103, 215)]
    assert len(few) == 4


def test_a_changed_row_does_not_verify(rough):
    other = merkle.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")])
    m = merkle.manifest(rough, changed=other)
    rows = m.prove().select("key", (merkle.folded(F.col("changed"), F.col("path")) == F.col("root")).alias("ok"), F.col("changed") == F.col("hash")).collect()
    assert {r["key"] for r in rows if r["ok"]} == {100}  # a null length has nothing to add to
    assert len(rows) == rough.count()


def test_one_row_is_its_own_root_and_an_empty_table_has_none(spark, empty):
    single = merkle.manifest(table(spark, [(7, "x", None, None)])).prove().collect()
    assert [(r["hash"], r["subroot"], r["path"]) for r in single] == [(single[0]["root"], single[0]["root"], [])]
    assert merkle.manifest(empty).prove().count() == 0
    assert merkle.manifest(empty).rows().count() == 0


def test_missing_coordinates_are_the_fewest():
    rng = random.Random(2)
    for n in (1, 2, 5, 8, 13, 31):
        for _ in range(20):
            wanted = set(rng.sample(range(n), rng.randrange(1, n + 1)))
            levels = merkle.height(n)
            gone = merkle.missing(wanted, n, levels)
            under = lambda level, i: set(range(i << level, min(n, (i + 1) << level)))
            covered = [under(*c) for c in gone]
            assert sum(map(len, covered)) + len(wanted) == n  # every other leaf once, under one coordinate
            assert set().union(wanted, *covered) == set(range(n))
            for level, i in gone:  # a coordinate higher up would hold a wanted leaf
                assert under(level + 1, i // 2) & wanted


# simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=3):
    """Smallest reachable place for each of a list of fingerprints, and the number of links."""
    n = len(prints)
    label, links = list(range(n)), 0

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                links += 1
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)], links


def test_simhash_equals_the_plain_version(rough):
    rows = rough.collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    tops, _ = plain_groups(prints)
    smallest = defaultdict(list)
    for r, t in zip(rows, tops):
        smallest[t].append(r["doc_id"])
    want = [(r["doc_id"], p, min((i for i in smallest[t] if i is not None), default=None)) for r, p, t in zip(rows, prints, tops)]
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.simhash_duplicates(rough).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[2] is not None and r[0] is not None and r[2] < r[0] and r[0] > 200 for r in got)


def test_fingerprint_is_the_hash_of_sparks_own_function(rough):
    short = rough.where("doc_id in (101) or size(split(text, ' ')) between 1 and 3 and doc_id < 70").select("doc_id", F.lower("text").alias("t"))
    own = {r["doc"]: r["fp"] for r in simhash.fingerprints(rough).collect()}
    for r in short.select("doc_id", "t", F.xxhash64("t").alias("h")).collect():
        assert own[r["doc_id"]] == (r["h"] if r["t"] else 0)


def scattered(seed, n):
    """Fingerprints in chains and clumps: every radius from 1 to 6 occurs, many share high or low bits."""
    rng = random.Random(seed)
    prints = {0, 2**64 - 1}
    while len(prints) < n:
        p = rng.choice([0, rng.getrandbits(64), rng.getrandbits(64)]) if rng.random() < 0.4 else rng.choice(sorted(prints)[:50])
        for b in rng.sample(range(64), rng.randrange(0, 7)):
            p ^= 1 << b
        prints.add(p)
    return sorted(prints)


@pytest.mark.parametrize("tile", [8, 64, 2048])
@pytest.mark.parametrize("rows", [100, 10**8, 10**12])
def test_no_link_is_lost_by_tiles_or_stripes(spark, tile, rows):
    prints = scattered(tile + rows % 97, 700)
    tops, links = plain_groups(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    found = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp bigint").repartition(4), simhash.stripe_masks(rows), tile=tile)
    got = {r["doc"]: r["comp"] for r in found.collect()}
    parts = defaultdict(set)
    for x, t in zip(signed, tops):
        parts[t].add(x)
    assert links > 500
    assert {frozenset(p) for p in parts.values()} == {frozenset(x for x in signed if got.get(x, x) == c) for c in {got.get(x, x) for x in signed}}


def test_stripes_cover_every_pair_within_the_radius():
    for rows, masks in ((10, 4), (10**8, 10), (10**12, 20)):
        assert len(simhash.stripe_masks(rows)) == masks
        rng = random.Random(rows)
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(flips & (m % 2**64) == 0 for m in simhash.stripe_masks(rows))


def test_a_clump_leaves_its_tiles_as_a_forest():
    values = np.array([p for p in scattered(1, 60)] + [1 << b for b in range(64)] + [(1 << b) | 1 for b in range(1, 64)], dtype=np.uint64)
    a, b = simhash.links_inside(values, np.array([0, 60, len(values)]), 3)
    assert len(a) < len(values) and len(set(a.tolist())) == len(a)
    assert set(a.tolist()) & set(range(60, len(values))) == set(range(61, len(values)))
    x, y = simhash.links_across(values[60:100], values[100:], (np.arange(40), np.arange(40, 40 + len(values) - 100)), 3)
    assert len(x) == len(values) - 60 - 1


def test_simhash_of_an_empty_table(empty):
    assert simhash.simhash_duplicates(empty).collect() == []


# vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """``rows``: (id, label, vector). Codebooks, and (id, codes, error, label error) of every row."""
    kept = [(i, label, [math.floor(4096 * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(r[2], p) for r in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, _, v in kept:
                members[nearest(cut(v, p), books[p])].append(cut(v, p))
            for e, vs in members.items():
                books[p][e] = [sum(xs) // len(vs) for xs in zip(*vs)]
    out, per_label = [], defaultdict(int)
    for i, label, v in kept:
        codes = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(far(cut(v, p), books[p][c]) for p, c in enumerate(codes))
        per_label[label] += error
        out.append((i, label, codes, error))
    return books, sorted(((i, c, e, per_label[label]) for i, label, c, e in out), key=str)


def rough_vectors(width=16, n=150):
    rng = random.Random(8)
    step = lambda: rng.choice([-0.5, -0.25, 0.0, 0.25, rng.uniform(-1, 1)])
    rows = [(i, rng.choice([0, 1, None]), [step() for _ in range(width)]) for i in range(n)]
    rows += [(500 + i, 1, rows[4][2]) for i in range(60)] + [(7, 0, rows[9][2]), (7, 0, rows[9][2]), (None, None, rows[2][2])]
    rows += [(-5, 1, None), (-4, 1, [None] + [0.0] * (width - 1)), (-3, 0, [math.nan] * width), (-2, None, [math.inf] + [1.0] * (width - 1))]
    return rows


VECTORS = "vec_id bigint, label int, embedding array<double>, codes string, error string, v int, x int, id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, label, v, "c", "e", 1, 2, "i") for i, label, v in rows], VECTORS)


@pytest.mark.parametrize("partitions", [1, 7])
def test_codes_equal_the_plain_version(spark, partitions):
    rows = rough_vectors()
    want_books, want = plain_codes(rows)
    found, books = vector_codes.vector_codes(vectors(spark, rows).repartition(partitions))
    assert books.tolist() == want_books
    assert sorted(((r["vec_id"], r["codes"], r["error"], r["label_error"]) for r in found.collect()), key=str) == want


def test_fewer_rows_than_entries_and_none(spark):
    rows = rough_vectors()[:5]
    books, want = plain_codes(rows)
    found, own = vector_codes.vector_codes(vectors(spark, rows))
    assert own.tolist() == books and own.shape == (8, 5, 2)
    assert sorted(((r["vec_id"], r["codes"], r["error"], r["label_error"]) for r in found.collect()), key=str) == want
    found, own = vector_codes.vector_codes(vectors(spark, []))
    assert found.collect() == [] and own.size == 0
    found, own = vector_codes.vector_codes(vectors(spark, [(1, 1, []), (2, 1, None)]))
    assert [(r["vec_id"], r["codes"], r["error"]) for r in found.collect()] == [(1, [0] * 8, 0)]


def test_other_widths_and_large_components(spark):
    wide = [(1, 1, [1e30] * 8), (2, 1, [-1e30] * 8), (3, 1, [0.0] * 16), (4, 1, [5.0] * 8)]
    found, _ = vector_codes.vector_codes(vectors(spark, wide), entries=1)
    rows = {r["vec_id"]: r for r in found.collect()}
    assert set(rows) == {1, 2, 4} and all(r["error"] >= 0 for r in rows.values())
    with pytest.raises(ValueError):
        vector_codes.vector_codes(vectors(spark, [(1, 1, [1.0] * 9)]))


def test_shared_prefixes_are_summed_once_and_right():
    rng = np.random.default_rng(3)
    book = rng.integers(-50, 50, (16, 6))
    parts = np.unique(rng.integers(-2, 3, (4000, 6)), axis=0)
    path = vector_codes.Path(book)
    got = np.concatenate([path.distances(parts[a : a + 97]) for a in range(0, len(parts), 97)])
    assert np.array_equal(got, ((parts[:, None, :] - book[None]) ** 2).sum(axis=2))
    shuffled = rng.permutation(parts)
    assert np.array_equal(vector_codes.Path(book).distances(shuffled), ((shuffled[:, None, :] - book[None]) ** 2).sum(axis=2))


def test_decoded_vectors_have_the_stated_error(spark):
    rows = rough_vectors()
    found, books = vector_codes.vector_codes(vectors(spark, rows))
    back = {r["vec_id"]: (r["vector"], r["error"]) for r in vector_codes.decoded(found, books).collect()}
    for i, _, v in rows[:100]:
        vector, error = back[i]
        assert sum((math.floor(4096 * a) - round(4096 * b)) ** 2 for a, b in zip(v, vector)) == error or i == 7
