"""Every stage of the corpus pipeline against a plain version of it."""

import random
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import ITEM, plain_components, plain_lines

from eventlens.llm import quality_model

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randrange(15, 60))]
        good = i % 5 != 0
        text = " ".join(words if good else [w.upper() + "!!" for w in words])
        if i % 7 == 1:
            text += "\nAll rights reserved by the owner"
        rows.append((i, text))
        labels.append((i, int(good), 0))
    base = " ".join(word() for _ in range(80))
    rows += [(1000 + k, base + (" tail" if k % 2 else "")) for k in range(6)]
    rows += [(2000, f"Intro words. {ITEM}\nOutro words"), (3000, None), (3001, ""), (3002, "All rights reserved by the owner")]
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert sorted(out.columns) == sorted(docs.columns)
            path = f"{folder}/out-{k}"
            out.write.parquet(path)
            out = spark.read.parquet(path)
            now = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality_classifier":
            assert {i for i in range(400) if i % 5} <= set(now) and not {i for i in range(400) if i % 5 == 0} & set(now)
            model = quality_model.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            kept = quality_model.scored(docs, model).where(F.col("score") >= 0.3).select("doc_id").collect()
            assert {r["doc_id"] for r in kept} == set(now)
        elif name == "line_dedup":
            plain = plain_lines([(i, t) for i, t in seen.items()], 10, True)
            want = {i: (kept if dropped else seen[i]) for i, (kept, _, dropped) in plain.items() if kept.strip() or not dropped}
            assert now == want and 3002 not in now
        elif name == "near_dedup":
            comp = plain_components(list(seen.items()), 5)
            assert set(now) == {i for i in seen if comp[i][1] == i} and len(set(now) & set(range(1000, 1006))) == 1
        elif name == "decontamination":
            assert set(seen) - set(now) == {2000}
        else:
            pieces = out.collect()
            assert {p["doc_id"] for p in pieces} == set(seen)
            per = {}
            for p in pieces:
                per.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
            for places in per.values():
                assert sum(n for _, n in places) <= 4096
                assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:j]) for j in range(len(places))]
            return
        docs, seen = out, now


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_share_an_id_or_have_none_count_by_themselves(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(40)) for _ in range(5)]
    leak = f"Intro words. {ITEM}"
    rows = [(1, texts[0])] * 3 + [(None, texts[1])] * 2 + [(2, texts[1]), (3, texts[2]), (3, texts[0]), (None, leak), (4, leak + " x"), (4, texts[3])]
    rows += [(5, "")] * 2 + [(6, None)] * 2
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    clean = [(None, texts[1]), (1, texts[0]), (3, texts[2]), (4, texts[3]), (5, ""), (6, None)]
    single = corpus_pipeline.one_of_each(spark, docs, str(tmp_path))
    assert pairs(single) == sorted([*clean, (None, leak)], key=str)
    assert pairs(corpus_pipeline.without_benchmark(spark, single, str(tmp_path))) == sorted(clean, key=str)
    leaks = corpus_pipeline.without_benchmark(spark, docs, str(tmp_path))
    assert pairs(leaks) == sorted((r for r in rows if r[1] not in (leak, leak + " x")), key=str)


def test_the_last_stage_holds_the_token_ids(spark):
    docs = spark.createDataFrame([(1, "Some words of a text", "en", "s", 20), (2, None, "en", "s", None)], SCHEMA)
    pieces = corpus_pipeline.packed(spark, docs, "").collect()
    assert {p["doc_id"] for p in pieces} == {1, 2}
    assert all(len(p["ids"]) == 4 * p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"] for p in pieces)
