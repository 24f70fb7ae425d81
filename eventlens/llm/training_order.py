"""Fixed-stride token records in training order.

Documents become records of ``STRIDE`` token ids. The records are numbered by document id, text and
place in it, whatever task holds them, and a keyed Feistel network permutes the numbers: with an even number of bits it is a bijection on a power
of four, and walking its cycles until the value falls below the number of records makes it one on
exactly those. So every record's global slot comes from its number and the key alone: no sort, no
random state, and the record of any slot can be found again by walking backwards, which is how a run
resumes. Slots are dealt to shards by range, every shard is one task that sorts its records, and
record ``i`` of a shard starts at byte ``i * stride``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.tokens import BYTE_END, byte_encoder
from eventlens.session import materialize

STRIDE = 512
RECORDS_PER_SHARD = 16_384
ROUNDS = 6
# Records of a shard file that are read at a time.
RECORDS_PER_READ = 1_024
KEY = 0x5EED
# Tasks of the writing step up to which the table of their offsets is broadcast (16 bytes each).
BROADCAST_TASKS = 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, half: int, key: int, backwards: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for r in reversed(range(ROUNDS)) if backwards else range(ROUNDS):
        salt = np.uint64((key + (r + 1) * 0x9E3779B97F4A7C15) % 2**64)
        if backwards:
            left, right = right ^ (_mixed(left + salt) & mask), left
        else:
            left, right = right, left ^ (_mixed(right + salt) & mask)
    return (left << np.uint64(half)) | right


def permuted(numbers: np.ndarray, n: int, key: int = KEY, backwards: bool = False) -> np.ndarray:
    """The slots of record numbers below ``n`` (or, backwards, the numbers of slots)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    out = _network(numbers.astype(np.uint64), half, key, backwards)
    while (outside := np.flatnonzero(out >= np.uint64(n))).size:
        out[outside] = _network(out[outside], half, key, backwards)
    return out.astype(np.int64)


def records(
    docs: DataFrame, vocabulary_path: str, *, stride: int = STRIDE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``task, row, doc_id, piece, n_tokens, ids``: a document's ids and the end id, cut at ``stride``.

    ``ids`` are little-endian unsigned 16-bit, not padded yet. The rows of a table ordered by (``task``, ``row``)
    are ordered by id (null first), hash of the text and piece: documents are divided among the tasks by
    range, and where they are cut does not change that order. Rows that are equal in id and text are told
    apart by their place in the input, so they need not share a task; their records are equal.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    order = ["doc_id", "print", "place"]
    slim = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), text.alias("t"), F.xxhash64(text).alias("print"), F.monotonically_increasing_id().alias("place")
    )
    slim = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "t")
    names = ["task", "row", "doc_id", "piece", "n_tokens", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, written = byte_encoder(vocabulary_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, pieces, ids = [], [], []
            for row, text in enumerate(batch.column("t")):
                whole = np.array([*encode(text.as_py()), BYTE_END], dtype="<u2").tobytes()
                for piece, start in enumerate(range(0, len(whole), 2 * stride)):
                    rows.append(row)
                    pieces.append(piece)
                    ids.append(whole[start : start + 2 * stride])
            columns = [
                pa.array(np.full(len(rows), task, dtype=np.int64)), pa.array(np.arange(written, written + len(rows))),
                batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()),
                pa.array([len(x) // 2 for x in ids], pa.int32()), pa.array(ids, pa.binary()),
            ]
            written += len(rows)
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(cut, f"task bigint, row bigint, doc_id {kind}, piece int, n_tokens int, ids binary")


def in_training_order(
    docs: DataFrame,
    vocabulary_path: str,
    *,
    stride: int = STRIDE,
    per_shard: int = RECORDS_PER_SHARD,
    key: int = KEY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``slot, shard, place, doc_id, piece, n_tokens, record``, sorted by slot; one partition per shard.

    ``record`` has exactly ``2 * stride`` bytes, filled up with the end id; ``n_tokens`` says how many
    are the document's. Slots run from 0 without a gap, so ``place`` does in every shard. A null or
    empty text is one record with the end id; repeated rows give records of their own; a null id is
    kept; an empty table gives no rows; extra columns are ignored. The order depends on the key and on
    the ids and texts, nothing else: not on how the input is divided into tasks, so a run that is made
    again goes on at the slot it had reached.
    """
    written = materialize(records(docs, vocabulary_path, stride=stride, id_col=id_col, text_col=text_col), "token-records")
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    per_task = materialize(written.groupBy("task").agg(F.count(F.lit(1)).alias("n")), "records-per-task")
    offsets = per_task.select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    n, tasks = per_task.agg(F.sum("n"), F.count(F.lit(1))).first()
    numbered = written.join(F.broadcast(offsets) if tasks <= BROADCAST_TASKS else offsets, "task")
    numbered = numbered.select((F.col("first") + F.col("row")).alias("number"), "doc_id", "piece", "n_tokens", "ids")
    n = int(n or 0)
    names = ["slot", *numbered.columns[1:]]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permuted(batch.column("number").to_numpy(zero_copy_only=False), n, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), *[batch.column(c) for c in range(1, batch.num_columns)]], names)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields[1:])
    slotted = numbered.mapInArrow(place, f"slot bigint, {fields}")
    shard = F.expr(f"cast(slot div {per_shard} as int)")
    end = F.lit(bytearray(BYTE_END.to_bytes(2, "little")))
    return (
        slotted.repartitionById(max(1, -(-n // per_shard)), shard).sortWithinPartitions("slot")
        .select(
            "slot", shard.alias("shard"), F.expr(f"cast(slot % {per_shard} as int)").alias("place"),
            "doc_id", "piece", "n_tokens", padded(F.col("ids"), end, stride).alias("record"),
        )
    )


def padded(ids: Column, end: Column, stride: int) -> Column:
    """``ids`` filled up with the end id to ``stride`` ids."""
    missing = F.lit(stride) - F.floor(F.octet_length(ids) / 2).cast("int")
    return F.concat(ids, F.unhex(F.repeat(F.hex(end), missing)))


def _store(folder: str):  # noqa: ANN202
    """File system and path of a folder given by path or by URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_shard_files(ordered: DataFrame, folder: str, *, stride: int = STRIDE) -> DataFrame:
    """Write every shard as ``shard-00000.bin`` (records one after the other, no header) and return
    the manifest ``shard, n_records, n_bytes, crc32``.

    A file is written under a name of its own attempt and then renamed, so a task that runs again
    after a lost executor leaves the same whole file. ``folder`` must be reachable by all executors.
    """
    slim = ordered.select("shard", "place", "record")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        context = TaskContext.get()
        current, sink, crc, n, done = None, None, 0, 0, []

        def close() -> None:
            if sink is not None:
                sink.close()
                store.move(temporary(current), f"{root}/shard-{current:05d}.bin")
                done.append((current, n, n * 2 * stride, crc))

        def temporary(shard: int) -> str:
            return f"{root}/.shard-{shard:05d}.{context.taskAttemptId()}"

        store.create_dir(root, recursive=True)
        for batch in batches:
            for shard, record in zip(batch.column("shard").to_pylist(), batch.column("record").to_pylist()):
                if shard != current:
                    close()
                    current, crc, n = shard, 0, 0
                    sink = store.open_output_stream(temporary(shard))
                sink.write(record)
                crc, n = zlib.crc32(record, crc), n + 1
        close()
        rows = list(zip(*done)) or [[], [], [], []]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], ["shard", "n_records", "n_bytes", "crc32"])

    return slim.mapInArrow(write, "shard int, n_records bigint, n_bytes bigint, crc32 bigint")


def read_shard_files(
    manifest: DataFrame, folder: str, *, from_slot: int = 0, stride: int = STRIDE, per_shard: int = RECORDS_PER_SHARD
) -> DataFrame:
    """``slot, shard, place, record`` of the slots from ``from_slot`` on, as ``write_shard_files`` left them.

    Files of earlier shards are not opened and the shard that holds the slot is entered at its place, so a
    run goes on without reading what came before. Slots rise inside every shard; a slot beyond the last gives no
    rows. A file that does not have the bytes of the manifest is an error. Extra columns are ignored.
    """
    first, width = from_slot // per_shard, 2 * stride
    wanted = manifest.where(F.col("shard") >= first).select("shard", "n_records").repartition("shard")
    names = ["slot", "shard", "place", "record"]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for shard, n in zip(batch.column("shard").to_pylist(), batch.column("n_records").to_pylist()):
                with store.open_input_file(f"{root}/shard-{shard:05d}.bin") as source:
                    if source.size() != n * width:
                        raise ValueError(f"shard {shard} has {source.size()} bytes, its manifest says {n * width}")
                    for start in range(max(0, from_slot - shard * per_shard), n, RECORDS_PER_READ):
                        source.seek(start * width)
                        raw = source.read(min(RECORDS_PER_READ, n - start) * width)
                        place = np.arange(start, start + len(raw) // width)
                        records_read = [raw[i : i + width] for i in range(0, len(raw), width)]
                        columns = [place + shard * per_shard, np.full(len(place), shard, np.int32), place.astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(records_read, pa.binary())], names)

    return wanted.mapInArrow(load, "slot bigint, shard int, place int, record binary")
