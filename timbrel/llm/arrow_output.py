"""Token ids as Arrow files of equal-length sequences.

Each shard is an Arrow IPC file whose batches hold fixed-size lists: ``input_ids`` (uint16 or uint32),
``mask`` (which places hold tokens) and ``doc_end`` (last token of a document), beside ``doc_ids``,
the documents that end in the sequence.  Equal lengths make row n of a batch a slice of its buffer,
so a memory-mapped file gives any sequence and mask without a copy.  A shard is one range of doc_id
in ascending order, begins with a new sequence and pads its last one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import public_tokenizer, shared_folder, steps, stored
from .tokens import encoder

SEQUENCE = 1024
END_ID = 1
#: Sequences of a batch.
BATCH = 64
#: Characters that are encoded at once; a word is looked up once in them.
STEP = 4_000_000
#: Characters of a shard, about.
SHARD_CHARS = 16_000_000


def _schema(length: int, width: str) -> pa.Schema:
    kind = pa.uint16() if width == "<u2" else pa.uint32()
    return pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)), ("doc_end", pa.list_(pa.bool_(), length)), ("doc_ids", pa.list_(pa.int64()))])


class ShardWriter:
    """Gathers tokens and writes them batch by batch; at most one batch and one step of documents in memory."""

    def __init__(self, sink, length: int, width: str):
        self.length, self.width, self.schema = length, width, _schema(length, width)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held, self.ends, self.doc_ids, self.n, self.tokens = [], [], [], 0, 0

    def add(self, doc_ids: list[int | None], ids: list[bytes]) -> None:
        """Documents in order, each with its ids (unsigned 32-bit, end id included)."""
        till = np.cumsum([len(x) // 4 for x in ids])
        self.held.append(np.frombuffer(b"".join(ids), "<u4").astype(self.width))
        self.ends += (self.n + till - 1).tolist()
        self.doc_ids += doc_ids
        self.n += int(till[-1])
        self.tokens += int(till[-1])
        size = self.length * BATCH
        if self.n >= size:
            whole = np.concatenate(self.held)
            done = self.n // size
            for i in range(done):
                self._batch(whole[i * size : (i + 1) * size], i * size)
            kept = sum(e < done * size for e in self.ends)
            self.ends, self.doc_ids = [e - done * size for e in self.ends[kept:]], self.doc_ids[kept:]
            self.held, self.n = [whole[done * size :]], self.n - done * size

    def _batch(self, ids: np.ndarray, begin: int) -> None:
        rows = -(-len(ids) // self.length)
        size = rows * self.length
        padded, mask, last = np.zeros(size, self.width), np.zeros(size, bool), np.zeros(size, bool)
        padded[: len(ids)], mask[: len(ids)] = ids, True
        own = [(e - begin, d) for e, d in zip(self.ends, self.doc_ids, strict=True) if begin <= e < begin + len(ids)]
        last[[e for e, _ in own]] = True
        per: list[list] = [[] for _ in range(rows)]
        for e, d in own:
            per[e // self.length].append(d)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask, last)]
        self.file.write_batch(pa.RecordBatch.from_arrays([*lists, pa.array(per, pa.list_(pa.int64()))], schema=self.schema))

    def close(self) -> None:
        if self.n:
            self._batch(np.concatenate(self.held), 0)
        self.file.close()


def write_shards(docs: DataFrame, folder: str, length: int = SEQUENCE, end_id: int = END_ID, vocabulary: str | None = None, wide: bool = False) -> DataFrame:
    """Write shards to folder; returns one row per shard: shard, path, n_docs, n_tokens.

    Null text counts as empty (the end id alone), null doc_ids come first, documents with one doc_id
    stand in the order of their texts, other columns are ignored; no documents give no shards.
    A task writes to a name of its own and then moves the file, so a repeated task is harmless.
    wide: 32-bit ids, for vocabularies of more than 65,536 ids.
    """
    path = vocabulary or public_tokenizer("word_bpe_49k.json")
    width = "<u4" if wide else "<u2"
    total = docs.agg(F.coalesce(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_CHARS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        store, top = fs.FileSystem.from_uri(folder)
        enc, end, writer, n_docs = encoder(path, False), np.array([end_id], "<u4").tobytes(), None, 0
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            for a, b in steps(texts.to_pylist(), STEP):
                if writer is None:
                    store.create_dir(top, recursive=True)
                    draft = f"{top}/.{shard:06d}-{uuid.uuid4().hex}"
                    sink = store.open_output_stream(draft)
                    writer = ShardWriter(sink, length, width)
                writer.add(doc_ids[a:b], [ids + end for ids in enc.encode_words(texts[a:b])])
                n_docs += b - a
        if writer is not None:
            writer.close()
            sink.close()
            store.move(draft, f"{top}/{shard:06d}.arrow")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{top}/{shard:06d}.arrow"], "n_docs": [n_docs], "n_tokens": [writer.tokens]})

    dealt = docs.select("doc_id", "text").repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return stored(dealt.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long"), "shards")


def read_documents(shards: DataFrame, folder: str) -> DataFrame:
    """Read the files back: doc_id, start (tokens of all documents before), n_tokens, ids (binary, unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_file(path) as source:
                    file, rest, start = pa.ipc.open_file(source), [], base
                    for i in range(file.num_record_batches):
                        own = file.get_batch(i)
                        ids, mask, last = (own.column(c).values.to_numpy(zero_copy_only=False) for c in ("input_ids", "mask", "doc_end"))
                        ids, last = ids[mask], last[mask]
                        doc_ids = own.column("doc_ids").flatten().to_pylist()
                        parts = np.split(ids, np.flatnonzero(last) + 1)
                        rows = []
                        for doc_id, part in zip(doc_ids, parts, strict=False):
                            whole = np.concatenate([*rest, part]).astype("<u4")
                            rest = []
                            rows.append((doc_id, start, len(whole), whole.tobytes()))
                            start += len(whole)
                        rest.append(parts[-1])
                        if rows:
                            columns = list(zip(*rows, strict=True))
                            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    before = F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")  # one row per shard
    dealt = shards.select("shard", "path", before.alias("base")).repartition(max(1, shards.count()), "shard")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def sequence(path: str, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number row of a local shard and its mask, as views of the mapped file (the mask is unpacked from bits)."""
    file = pa.ipc.open_file(pa.memory_map(path))
    own = file.get_batch(row // BATCH)
    ids = own.column("input_ids")[row % BATCH].values.to_numpy()
    return ids, own.column("mask")[row % BATCH].values.to_numpy(zero_copy_only=False)


def token_files(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files written for it."""
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    back = read_documents(write_shards(docs, folder), folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
