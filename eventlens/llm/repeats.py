"""Repeated passages across documents: suffix order and longest previous factors, in blocks.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller
id. One suffix array of a whole corpus is no Spark job, so the suffixes are dealt into blocks that can
be decided on their own:

1. Every window of ``LENGTH`` bytes is named by the smallest hash of the ``GRAM``-byte strings in it, its
   anchor. Equal windows have equal anchors, so a window can only repeat where its anchor does.
   Neighbouring windows with one anchor form a run, about one run in 16 bytes.
2. Documents are written once in packs, bucketed by pack, so no later step moves a text. Each pack asks
   once per distinct anchor whether another pack has it; most anchors are alone and end here.
3. Runs of shared anchors meet by anchor, as hashes of their bytes. A run whose bytes stand in an
   earlier document is a repeat. Left are anchors with several different runs, one document for each.
4. Only these travel with their bytes, to blocks chosen by anchor. A block puts its windows in suffix
   order; the previous and the next entry with a smaller document in this order have the longest
   earlier matches, and where one of them agrees to the full length the window is a repeat.
5. The repeats go back to their packs as byte intervals and are cut out of the texts.

A place is one number inside a pack: row number times 2^32 plus byte. So a text is named by its row and
not by its id, which only decides what is earlier.

A pack sends equal runs once, for its smallest document, and settles the others itself; an anchor found
in very many documents is sent window by window, to blocks chosen by the window. So neither a passage
in a third of all documents nor what happens to stand beside it gathers in one block.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.session import materialize, new_path

LENGTH = 50
GRAM = 20
PACK_BYTES = 8 << 20
ROW_BYTES = 16  # of a row beside its text, so that a pack of empty texts ends too
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
# Documents with an anchor beyond which its windows are dealt out one by one.
HOT_DOCUMENTS = 20_000
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_WORDS = -(-LENGTH // 8)
_ROW = 32  # bits of a place below the row number


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every string of ``size`` bytes, put together from strings of 1, 2, 4, ... bytes."""
    doubled, width = {1: data.astype(np.uint64) + np.uint64(1)}, 1
    while 2 * width <= size:
        short = doubled[width]
        doubled[2 * width] = short[:-width] * np.uint64(pow(_BASE, width, 2**64)) + short[width:]
        width *= 2
    total, covered = np.zeros(len(data) - size + 1, dtype=np.uint64), 0
    for width in sorted(doubled, reverse=True):
        if covered + width <= size:
            total = total * np.uint64(pow(_BASE, width, 2**64)) + doubled[width][covered : covered + len(total)]
            covered += width
    return _mixed(total)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs(raw: bytes | memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and end (one past the last window) of every run of a text."""
    data = np.frombuffer(raw, dtype=np.uint8)
    anchors, firsts, ends = [], [], []
    for at in range(0, len(data) - LENGTH + 1, CHUNK):
        part = data[at : at + CHUNK + LENGTH - 1]
        name = sliding_minimum(gram_hashes(part, GRAM), LENGTH - GRAM + 1)
        first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        anchors.append(name[first])
        firsts.append(first + at)
        ends.append(np.append(first[1:], len(name)) + at)
    if not anchors:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(anchors), np.concatenate(firsts), np.concatenate(ends)


def _nearest_smaller(docs: np.ndarray, step: int) -> np.ndarray:
    """Index of the nearest entry before (-1) or after (+1) with a smaller document; itself if none."""
    n = len(docs)
    out = np.arange(n) + step
    open_ = np.flatnonzero((out >= 0) & (out < n))
    while len(open_):
        open_ = open_[docs[out[open_]] >= docs[open_]]
        out[open_] = out[out[open_]]  # all that lies between is no smaller either
        open_ = open_[(out[open_] >= 0) & (out[open_] < n)]
    outside = (out < 0) | (out >= n)
    out[outside] = np.flatnonzero(outside)
    return out


def repeated(data: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor at each start reaches ``LENGTH``.

    ``data`` is the block's text, ``docs`` the document of each start. "Previous" is by document.
    """
    if not len(starts):
        return np.zeros(0, dtype=bool)
    long = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    words = []
    for w in range(_WORDS):  # the suffixes' first LENGTH bytes, eight at a time, as numbers
        word = np.zeros(len(starts), dtype=np.uint64)
        for i in range(8 * w, min(8 * w + 8, LENGTH)):
            word = (word << np.uint64(8)) | long[starts + i]
        words.append(word)
    order = np.lexsort(words[::-1])
    differs = np.zeros(len(order), dtype=bool)
    for word in words:
        differs[1:] |= word[order[1:]] != word[order[:-1]]
    group = np.cumsum(differs)  # suffixes that agree for LENGTH bytes
    ranked = docs[order]
    previous, following = _nearest_smaller(ranked, -1), _nearest_smaller(ranked, 1)
    here = np.arange(len(order))
    found = ((previous != here) & (group[previous] == group)) | ((following != here) & (group[following] == group))
    out = np.empty(len(order), dtype=bool)
    out[order] = found
    return out


def packed_documents(docs: DataFrame, id_col: str, text_col: str, n_bytes: int) -> DataFrame:
    """The documents as a table bucketed by pack: ``pack, row, doc, raw``; rows are numbered in each pack."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    slim = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), text.alias("raw")).where(F.col("doc").isNotNull())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, pack, row, filled = TaskContext.get().partitionId() << 32, 0, 0, 0
        for batch in batches:
            packs, rows = [], []
            for text in batch.column("raw"):
                size = len(text.as_buffer()) + ROW_BYTES
                if filled and filled + size > PACK_BYTES:
                    pack, row, filled = pack + 1, 0, 0
                packs.append(task + pack)
                rows.append(row)
                row, filled = row + 1, filled + size
            numbers = [pa.array(packs, pa.int64()), pa.array(rows, pa.int64())]
            yield pa.RecordBatch.from_arrays([*numbers, *batch.columns], ["pack", "row", "doc", "raw"])

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))
    table = f"eventlens_packs_{uuid.uuid4().hex}"
    (
        slim.mapInArrow(number, "pack bigint, row bigint, doc bigint, raw binary").write.format("parquet")
        .option("compression", "zstd").option("path", new_path(spark, "packs"))
        .bucketBy(buckets, "pack").sortBy("pack").saveAsTable(table)
    )
    return spark.table(table)


def _asked(table: pa.Table) -> pa.Table:
    """One row per distinct anchor of a pack, with the number of its documents."""
    found, counts = [], []
    for raw in table.column("raw"):
        found.append(np.unique(runs(raw.as_buffer())[0]))
    anchors, counts = np.unique(np.concatenate(found), return_counts=True)
    pack = np.full(len(anchors), table.column("pack")[0].as_py(), dtype=np.int64)
    return pa.table({"anchor": anchors.view(np.int64), "pack": pack, "n": counts.astype(np.int64)})


# ``key`` is half of the anchor: anchors of one block that share it are only compared more closely.
_SENT = pa.schema([(n, pa.int64()) for n in ("block", "key", "content", "pack", "doc", "start", "size")])
_MET = pa.schema([*[(n, pa.int64()) for n in ("block", "pack", "start", "stop")], ("open", pa.bool_())])
_BYTES = pa.schema([*[(n, pa.int64()) for n in ("block", "pack", "doc", "start")], ("bytes", pa.binary())])


def _fields(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _member(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), dtype=bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def _sent(texts: pa.Table, shared: pa.Table, blocks: int) -> pa.Table:
    """Runs of shared anchors as hashes of their bytes. What the pack settles itself has no key;
    neighbours of it are one row."""
    rows: list[tuple] = []
    if not texts.num_rows:
        return _rows(rows, _SENT)
    pack = texts.column("pack")[0].as_py()
    others = np.sort(shared.column("anchor").to_numpy().view(np.uint64))
    hot = np.sort(shared.column("anchor").to_numpy()[shared.column("hot").to_numpy()].view(np.uint64))
    ids, numbers = texts.column("doc").to_numpy(), texts.column("row").to_numpy()
    order = np.lexsort((numbers, ids))
    raws = texts.column("raw")
    cut = [runs(raws[int(i)].as_buffer()) for i in order]
    # anchors of two documents of this pack count as shared too
    distinct = np.concatenate([np.unique(anchors) for anchors, _, _ in cut])
    anchors, counts = np.unique(distinct, return_counts=True)
    known = np.union1d(others, anchors[counts > 1])
    first_in: dict[bytes, int] = {}
    for i, (anchors, firsts, ends) in zip(order, cut):
        doc, base, raw = int(ids[i]), int(numbers[i]) << _ROW, raws[int(i)].as_py()
        keep = _member(anchors, known)
        split = _member(anchors, hot)
        own: list[int] = []  # the settled stretch so far
        for anchor, a, b, one_by_one in zip(
            anchors[keep].view(np.int64).tolist(), firsts[keep].tolist(), ends[keep].tolist(), split[keep].tolist()
        ):
            for start, stop in ((w, w + 1) for w in range(a, b)) if one_by_one else ((a, b),):
                stop += LENGTH - 1
                content = raw[start:stop]
                if first_in.setdefault(content, doc) < doc:
                    if own and start <= own[1]:
                        own[1] = stop
                        continue
                    if own:
                        rows.append(((doc + own[0]) % blocks, None, None, pack, doc, base + own[0], own[1] - own[0]))
                    own = [start, stop]
                else:
                    name = int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)
                    met = name if one_by_one else anchor
                    rows.append((met % blocks, met >> 32 & 0xFFFFFFFF, name, pack, doc, base + start, stop - start))
        if own:
            rows.append(((doc + own[0]) % blocks, None, None, pack, doc, base + own[0], own[1] - own[0]))
    return _rows(rows, _SENT)


def _met(table: pa.Table) -> pa.Table:
    """What the hashes settle: repeats, and runs that stay open until their bytes are compared."""
    table = table.append_column("stop", pc.add(table.column("start"), table.column("size")))
    own = table.filter(pc.is_null(table.column("key")))
    rest = table.filter(pc.is_valid(table.column("key")))
    out = [own.select(["block", "pack", "start", "stop"]).append_column("open", pa.array(np.zeros(own.num_rows, dtype=bool)))]
    if rest.num_rows:
        key, content, doc = (rest.column(c).to_numpy() for c in ("key", "content", "doc"))
        by = np.lexsort((doc, content, key))
        key, content, doc = key[by], content[by], doc[by]
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        new_content = new_key | np.concatenate(([True], content[1:] != content[:-1]))
        group, run = np.cumsum(new_key) - 1, np.cumsum(new_content) - 1
        repeat = doc > doc[np.flatnonzero(new_content)][run]
        several = np.bincount(group[new_content])[group] > 1
        chosen = by[repeat | several]
        found = rest.take(pa.array(chosen)).select(["block", "pack", "start", "stop"])
        out.append(found.append_column("open", pa.array(~repeat[repeat | several])))
    return pa.concat_tables([t.cast(_MET) for t in out])


def _contents(texts: pa.Table, wanted: pa.Table) -> pa.Table:
    """The bytes of open runs."""
    numbers = texts.column("row").to_numpy()
    where, docs, raws = np.argsort(numbers), texts.column("doc").to_numpy(), texts.column("raw")
    rows, last, doc, raw = [], None, None, b""
    for start, stop, block, pack in sorted(zip(*(wanted.column(c).to_pylist() for c in ("start", "stop", "block", "pack")))):
        row = start >> _ROW
        if row != last:
            i = int(where[np.searchsorted(numbers, row, sorter=where)])
            last, doc, raw = row, int(docs[i]), raws[i].as_py()
        base = row << _ROW
        rows.append((block, pack, doc, start, raw[start - base : stop - base]))
    return _rows(rows, _BYTES)


def _settled(table: pa.Table) -> pa.Table:
    """Byte intervals of one block's repeats."""
    contents = table.column("bytes").to_pylist()
    sizes = np.array([len(c) for c in contents], dtype=np.int64)
    ids, begins = table.column("doc").to_numpy(), table.column("start").to_numpy()
    data = np.frombuffer(b"".join(contents), dtype=np.uint8)
    windows = np.maximum(sizes - LENGTH + 1, 0)
    row = np.repeat(np.arange(len(sizes)), windows)
    base = np.cumsum(sizes) - sizes
    offset = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    hit = np.flatnonzero(repeated(data, base[row] + offset, ids[row]))
    # neighbouring windows of a run make one interval
    fresh = np.ones(len(hit), dtype=bool)
    fresh[1:] = (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(hit)) - 1 if len(hit) else first
    owner = row[hit[first]]
    return pa.table({
        "pack": table.column("pack").to_numpy()[owner],
        "start": begins[owner] + offset[hit[first]], "stop": begins[owner] + offset[hit[last]] + LENGTH,
    })


def _cut(texts: pa.Table, intervals: pa.Table) -> pa.Table:
    """Per document what is left of it."""
    by = np.argsort(intervals.column("start").to_numpy(), kind="stable")
    starts, stops = (intervals.column(c).to_numpy()[by] for c in ("start", "stop"))
    out: dict[str, list] = {"doc": [], "n_bytes": [], "n_removed": [], "spans": [], "kept": []}
    for row, doc, text in zip(*(texts.column(c).to_pylist() for c in ("row", "doc", "raw"))):
        base = row << _ROW
        a, b = np.searchsorted(starts, (base, base + (1 << _ROW)), side="left")
        spans: list[list[int]] = []
        for start, stop in zip((starts[a:b] - base).tolist(), (stops[a:b] - base).tolist()):
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], stop)
            else:
                spans.append([start, stop])
        kept, at = [], 0
        for start, stop in spans:
            kept.append(text[at:start])
            at = stop
        kept.append(text[at:])
        whole = b"".join(kept)
        for name, value in (("doc", doc), ("n_bytes", len(text)), ("n_removed", len(text) - len(whole)), ("spans", spans), ("kept", whole)):
            out[name].append(value)
    kinds = {"doc": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": pa.list_(pa.list_(pa.int64())), "kept": pa.binary()}
    return pa.table({name: pa.array(values, kinds[name]) for name, values in out.items()})


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` of every row: the removed byte ranges (maximal, in
    order) and the remaining bytes.

    Ids are whole numbers. A null text is empty; a text shorter than ``LENGTH`` bytes stays whole. A row
    with a null id has no place in the order: it stays whole and removes nothing elsewhere. Repeated rows
    do not remove each other's bytes (only a smaller id does). Different texts under one id are one
    document of several texts: each is cut at its own places, by smaller ids alone. Repeats inside one
    document stay. Texts are cut at bytes, so ``kept`` may begin or end inside a character. Extra columns
    are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    n_bytes = int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    packs = packed_documents(docs, id_col, text_col, n_bytes)
    asked = packs.groupBy("pack").applyInArrow(_asked, "anchor bigint, pack bigint, n bigint")
    alike = Window.partitionBy("anchor")
    shared = (
        asked.withColumn("packs", F.count(F.lit(1)).over(alike)).withColumn("docs", F.sum("n").over(alike))
        .where(F.col("packs") > 1).select("pack", "anchor", (F.col("docs") > HOT_DOCUMENTS).alias("hot"))
    )
    blocks = max(64, -(-n_bytes // BLOCK_BYTES))
    sent = packs.groupBy("pack").cogroup(shared.groupBy("pack")).applyInArrow(
        lambda texts, anchors: _sent(texts, anchors, blocks), _fields(_SENT)
    )
    met = materialize(sent.groupBy("block").applyInArrow(_met, _fields(_MET)), "met-runs")
    wanted = met.where("open").select("block", "pack", "start", "stop")
    contents = packs.groupBy("pack").cogroup(wanted.groupBy("pack")).applyInArrow(_contents, _fields(_BYTES))
    compared = contents.groupBy("block").applyInArrow(_settled, "pack bigint, start bigint, stop bigint")
    intervals = met.where("not open").select("pack", "start", "stop").unionByName(compared)
    cut = packs.groupBy("pack").cogroup(intervals.groupBy("pack")).applyInArrow(
        _cut, "doc bigint, n_bytes bigint, n_removed bigint, spans array<array<bigint>>, kept binary"
    )
    whole = docs.where(F.col(f"`{id_col}`").isNull()).select(
        F.lit(None).cast("bigint").alias("doc"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"),
        F.array().cast("array<array<bigint>>").alias("spans"), text.cast("binary").alias("kept"),
    )
    return cut.unionByName(whole).withColumnRenamed("doc", id_col)
