"""Token ids in Arrow files of fixed-size-list batches.

``write`` sorts documents by id over range partitions and writes two Arrow IPC files per partition into a shared folder:
``ids-*.arrow`` holds sequences of ``length`` token ids (unsigned 16-bit where the ids allow it) with a mask that is
false on the padding of the file's last sequence; ``docs-*.arrow`` holds each document's place. Both are memory-mapped
as they are: a sequence, or any span of ids, is a slice of the file without copies.

A file is written under a name of its own and then renamed, so a task that runs again replaces it whole where the file system's
rename replaces files, and fails otherwise. A null text has no
ids but its end id. Null ids come first; rows that repeat an id keep an order by text. Extra columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path
from .common import bound_batches, partitions, saved
from .tokenizer import encoder

LENGTH = 2048
BATCH_SEQUENCES = 256
MANIFEST = "part int, docs_file string, ids_file string, n_docs bigint, n_ids bigint"


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder or file name, ``file:/...`` and plain paths included."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(uri)


def id_type(path: str) -> pa.DataType:
    """Narrowest unsigned type for the ids of a tokenizer file."""
    from tokenizers import Tokenizer

    return pa.uint16() if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else pa.uint32()


class SequenceFile:
    """Cuts a stream of ids into sequences and writes them in batches of ``BATCH_SEQUENCES``; only the last batch may be smaller."""

    def __init__(self, sink, kind: pa.DataType, length: int):
        self.length, self.total, self.left, self.held = length, 0, [], 0
        self.kind = kind
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.true = pa.array(np.ones(length * BATCH_SEQUENCES, bool))  # of every full batch

    def add(self, ids: np.ndarray) -> None:
        self.left.append(ids.astype(self.kind.to_pandas_dtype()))
        self.total += len(ids)
        self.held += len(ids)
        step = self.length * BATCH_SEQUENCES
        if self.held >= step:
            held = np.concatenate(self.left)
            whole = len(held) // step * step
            for at in range(0, whole, step):
                self._write(held[at : at + step], self.true)
            self.left, self.held = [held[whole:]], len(held) - whole

    def _write(self, ids: np.ndarray, mask: pa.Array) -> None:
        columns = [pa.FixedSizeListArray.from_arrays(values, type=f.type) for values, f in zip((pa.array(ids, self.kind), mask), self.schema)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            padded = np.zeros(-(-self.held // self.length) * self.length, self.kind.to_pandas_dtype())
            padded[: self.held] = np.concatenate(self.left)
            self._write(padded, pa.array(np.arange(len(padded)) < self.held))
        self.writer.close()


def write(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, spaces: bool = True,
    doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
) -> DataFrame:
    """Write the files and return their manifest with each file's ``base``: the ids of all files before it."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind = id_type(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        own = uuid.uuid4().hex
        names = {k: f"{k}-{part:06d}.arrow" for k in ("ids", "docs")}
        temp = {k: os.path.join(base, f".{n}.{own}") for k, n in names.items()}
        encode = encoder(tokenizer, spaces)
        n_docs, end = 0, np.array([end_id], "<u4").tobytes()
        docs_schema = None
        with fs.open_output_stream(temp["ids"]) as ids_sink, fs.open_output_stream(temp["docs"]) as docs_sink:
            ids = SequenceFile(ids_sink, kind, length)
            places = None
            for b in batches:
                if places is None:
                    docs_schema = pa.schema([("doc_id", b.schema.field(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                    places = pa.ipc.new_file(docs_sink, docs_schema)
                encoded = encode.encode(b.column(1).to_pylist())
                counts = np.array([len(data) // 4 + 1 for data in encoded], np.int64)
                starts = ids.total + np.cumsum(counts) - counts
                ids.add(np.frombuffer(end.join([*encoded, b""]), "<u4"))
                places.write_batch(pa.RecordBatch.from_arrays([b.column(0), pa.array(starts), pa.array(counts)], schema=docs_schema))
                n_docs += b.num_rows
            ids.close()
            if places is not None:
                places.close()
        final = {k: os.path.join(base, n) for k, n in names.items()}
        if n_docs == 0:
            for t in temp.values():
                fs.delete_file(t)
            return
        for k in names:
            fs.move(temp[k], final[k])
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "docs_file": [f"{folder}/{names['docs']}"], "ids_file": [f"{folder}/{names['ids']}"],
            "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([ids.total], pa.int64()),
        })

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = saved(ordered.mapInArrow(run, MANIFEST), "manifest")
    # One row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def open_mapped(uri: str) -> pa.ipc.RecordBatchFileReader:
    """Reader of an Arrow file: memory-mapped where the folder is mounted, streamed by range otherwise."""
    fs, path = file_system(uri)
    source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
    return pa.ipc.open_file(source)


def flat_ids(reader: pa.ipc.RecordBatchFileReader, batch: int) -> np.ndarray:
    """Ids of one batch without copies; the mask's false places are padding."""
    return reader.get_batch(batch).column(0).flatten().to_numpy(zero_copy_only=True)


def sequence(uri: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ``number`` of a file with its mask, by its place: all batches but the last are full."""
    reader = open_mapped(uri)
    batch, row = divmod(number, BATCH_SEQUENCES)
    if not 0 <= batch < reader.num_record_batches or row >= (b := reader.get_batch(batch)).num_rows:
        raise IndexError("no such sequence")
    one = b.slice(row, 1)
    return one.column(0).flatten().to_numpy(zero_copy_only=True), one.column(1).flatten().to_numpy(zero_copy_only=False)


def read_documents(manifest: DataFrame, ident: str = "bigint") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files of a manifest.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is of the ids as little-endian unsigned 32-bit integers.
    Files are read batch by batch; one task per file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, places = open_mapped(row["ids_file"]), open_mapped(row["docs_file"])
                have, at, next_batch = np.zeros(0, np.uint32), 0, 0  # ids held, and the place of the first
                for k in range(places.num_record_batches):
                    docs = places.get_batch(k)
                    crcs = []
                    for start, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist()):
                        crc, seen = 0, 0
                        while seen < n:
                            if start + seen >= at + len(have):
                                at += len(have)
                                have, next_batch = flat_ids(ids, next_batch).astype("<u4"), next_batch + 1
                            piece = have[start + seen - at : start + n - at]
                            crc = zlib.crc32(piece, crc)
                            seen += len(piece)
                        crcs.append(crc)
                    starts = pa.array(docs.column(1).to_numpy() + row["base"])
                    yield pa.RecordBatch.from_arrays(
                        [docs.column(0), starts, docs.column(2), pa.array(crcs, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    files = manifest.select("ids_file", "docs_file", F.col("base").cast("bigint").alias("base"), "part")
    files = files.repartitionByRange(partitions(manifest.sparkSession), "part")
    return files.mapInArrow(run, f"doc_id {ident}, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, name: str = "token-files", **options) -> DataFrame:
    """Write the files to the session's shared folder and read every document back."""
    folder = scratch_path(docs.sparkSession, name)
    manifest = write(docs, folder, tokenizer, end_id, **options)
    ident = docs.schema[options.get("doc_id", "doc_id")].dataType.simpleString()
    return read_documents(manifest, ident)
