"""Token ids of documents in binary shards of Simple-8b blocks.

The documents are dealt out by ranges of doc_id, each range becomes one shard, so the
shards in order hold the documents in ascending doc_id order. A shard is written under a
name of its own attempt and then renamed: a task that runs again writes the same bytes.

A shard, little-endian:
    magic, then the blocks' words of 64 bits
    an index of documents: doc_id, null flag, number of ids
    an index of blocks: first word, number of ids, number of escapes
    the escapes of all blocks: word, value
    footer: documents, blocks, escapes, magic

A null text is empty and yields the end id alone. Rows with a null doc_id come first;
repeated rows are kept, ties are ordered by text. Other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quadlake.llm.encode import BYTE_BPE, encoder
from quadlake.llm.simple8b import pack, unpack
from quadlake.llm.tables import map_rows
from quadlake.session import checkpoint_folder

MAGIC = b"QLS8B001"
BLOCK_IDS = 1 << 16
_FOOTER = struct.Struct("<QQQ8s")
_DOCUMENT = np.dtype([("doc_id", "<i8"), ("null", "<i8"), ("n", "<i8")])
_BLOCK = np.dtype([("word", "<i8"), ("n", "<i8"), ("escapes", "<i8")])
_ESCAPE = np.dtype([("word", "<i8"), ("value", "<i8")])


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ShardWriter:
    """Writes documents one after another; holds one block of ids at a time."""

    def __init__(self, out):
        self._out, self._held, self._n_held, self._words = out, [], 0, 0
        self._documents, self._blocks, self._escapes = [], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._documents.append((doc_id or 0, doc_id is None, len(ids)))
        start = 0
        while start < len(ids):
            take = ids[start:start + BLOCK_IDS - self._n_held]
            self._held.append(take)
            self._n_held += len(take)
            start += len(take)
            if self._n_held == BLOCK_IDS:
                self._block()

    def _block(self) -> None:
        if self._n_held:
            words, escapes = pack(np.concatenate(self._held))
            self._out.write(words.astype("<u8").tobytes())
            self._blocks.append((self._words, self._n_held, len(escapes)))
            self._escapes += escapes
            self._words += len(words)
            self._held, self._n_held = [], 0

    def close(self) -> None:
        self._block()
        for rows, kind in ((self._documents, _DOCUMENT), (self._blocks, _BLOCK), (self._escapes, _ESCAPE)):
            self._out.write(np.array(rows, kind).tobytes())
        self._out.write(_FOOTER.pack(len(self._documents), len(self._blocks), len(self._escapes), MAGIC))


def read_shard(f) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of an open shard, one block at a time."""
    size = f.size()
    f.seek(size - _FOOTER.size)
    n_documents, n_blocks, n_escapes, magic = _FOOTER.unpack(f.read(_FOOTER.size))
    index = n_documents * _DOCUMENT.itemsize + n_blocks * _BLOCK.itemsize + n_escapes * _ESCAPE.itemsize
    end = size - _FOOTER.size - index
    f.seek(0)
    if magic != MAGIC or f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a whole shard")
    f.seek(end)
    documents = np.frombuffer(f.read(n_documents * _DOCUMENT.itemsize), _DOCUMENT)
    blocks = np.frombuffer(f.read(n_blocks * _BLOCK.itemsize), _BLOCK)
    escapes = np.frombuffer(f.read(n_escapes * _ESCAPE.itemsize), _ESCAPE)
    bounds = np.append(blocks["word"], (end - len(MAGIC)) // 8)
    escape_at = np.concatenate(([0], np.cumsum(blocks["escapes"])))

    def ids() -> Iterator[np.ndarray]:
        for k, block in enumerate(blocks):
            f.seek(len(MAGIC) + 8 * int(bounds[k]))
            words = np.frombuffer(f.read(8 * int(bounds[k + 1] - bounds[k])), "<u8")
            yield unpack(words, int(block["n"]), escapes[escape_at[k]:escape_at[k + 1]].tolist())

    stream, held = ids(), np.empty(0, np.uint64)
    for doc_id, null, n in documents.tolist():
        parts = []
        while n:
            if not len(held):
                held = next(stream)
            parts.append(held[:n])
            n -= len(parts[-1])
            held = held[len(parts[-1]):]
        yield None if null else doc_id, np.concatenate(parts) if parts else np.empty(0, np.uint64)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = BYTE_BPE, end_id: int = 0,
                      shards: int | None = None) -> list[tuple[str, int]]:
    """Write the ids of all documents; the shards' paths with their number of ids, in order.

    shards: the number of ranges, by default that of the shuffle partitions.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(rows: Iterator[tuple]) -> Iterable[tuple]:
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        number = TaskContext.get().partitionId()
        final = posixpath.join(root, f"shard-{number:08d}.s8b")
        mine = f"{final}.{uuid.uuid4().hex}.tmp"
        ids_of, total, keys = encoder(tokenizer), 0, []

        def texts() -> Iterator[str | None]:
            for doc_id, text in rows:
                keys.append(doc_id)
                yield text

        with fs.open_output_stream(mine, compression=None) as out:
            shard = ShardWriter(out)
            for k, ids in enumerate(ids_of.encode_all(texts())):
                ids = np.append(ids, np.asarray(end_id, ids.dtype))
                shard.add(keys[k], ids)
                total += len(ids)
            shard.close()
        fs.move(mine, final)
        yield number, f"{folder}/shard-{number:08d}.s8b", total

    ordered = (docs.select("doc_id", "text").repartitionByRange(shards, "doc_id")
               .sortWithinPartitions("doc_id", "text"))
    # One row for each file, as a writer's commit messages.
    found = map_rows(ordered, write, "number int, path string, n long").collect()
    return [(r.path, r.n) for r in sorted(found, key=lambda r: r.number)]


def read_token_files(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""
    rows, start = [], 0
    for path, n in files:
        rows.append((path, start))
        start += n

    def read(rows: Iterator[tuple]) -> Iterator[tuple]:
        for path, at in rows:
            fs, name = _fs(path)
            with fs.open_input_file(name) as f:
                for doc_id, ids in read_shard(f):
                    yield doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                    at += len(ids)

    listed = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return map_rows(listed, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, tokenizer: str = BYTE_BPE, end_id: int = 0) -> DataFrame:
    """Write the token files of documents to the shared folder and read them back."""
    spark = docs.sparkSession
    folder = f"{checkpoint_folder(spark).rstrip('/')}/tokens-{uuid.uuid4()}"
    return read_token_files(spark, write_token_files(docs, folder, tokenizer, end_id))
