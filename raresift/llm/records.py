"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A shard is a file of frames. One frame, all numbers little-endian::

    length      8 bytes   bytes of the payload
    check       4 bytes   masked CRC-32 of the length
    payload               document id (8 bytes, signed), bytes per token id (1 byte: 2 or 4; 128 is added where the id is
                          missing, which is then written as 0), token ids (unsigned)
    check       4 bytes   masked CRC-32 of the payload
    line feed   1 byte    end mark, set by Spark's text sink

Masking rotates a checksum right by 15 bits and adds a constant, so that a checksum of data that holds checksums stays
useful. Shards are written by Spark's text sink in ascending document order (shard names sort in that order), so
they go wherever Spark can write and failed or doubled tasks leave nothing behind. The index (Parquet) has one row
per record: ``shard, doc_id, offset, length, n_tokens``.

Defined cases: a null or empty text is the end id alone; rows without an id keep a missing id and come first; equal ids and rows are kept as they are; further columns are
not read; an empty table gives no records and an empty index.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from raresift.llm.encoding import id_width, word_encoder
from raresift.llm.spread import running_sums
from raresift.llm.text import Texts, prepare, slices, tidy
from raresift.session import ensure_checkpoint_dir

_MASK_ADD = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")
_RECORD_HEAD = struct.Struct("<qB")
#: Flag beside the bytes per token id: the document has no id.
_NO_ID = 128
END_MARK = b"\n"
#: Bytes of text per shard, roughly; a shard is read by one task.
SHARD_BYTES = 24_000_000
#: Bytes of text that are encoded together.
ENCODE_BYTES = 8_000_000


def masked(data: bytes) -> int:
    check = zlib.crc32(data)
    return ((check >> 15 | check << 17) + _MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _TAIL.pack(masked(length)), payload, _TAIL.pack(masked(payload))))


def record(doc_id: int | None, width: int, ids: bytes) -> bytes:
    """A payload."""
    if doc_id is None:
        return _RECORD_HEAD.pack(0, width | _NO_ID) + ids
    return _RECORD_HEAD.pack(doc_id, width) + ids


def read_frames(content: memoryview) -> Iterator[tuple[int, memoryview]]:
    """Offset and payload of each frame; raises ValueError where a length or checksum does not fit."""
    at, size = 0, len(content)
    while at < size:
        if size - at < _HEAD.size + _TAIL.size:
            raise ValueError(f"a frame at byte {at} is cut off")
        length, check = _HEAD.unpack_from(content, at)
        if masked(bytes(content[at : at + 8])) != check:
            raise ValueError(f"the length at byte {at} is damaged")
        start = at + _HEAD.size
        end = start + length
        if end + _TAIL.size > size:
            raise ValueError(f"a frame at byte {at} is cut off")
        payload = content[start:end]
        if masked(payload) != _TAIL.unpack_from(content, end)[0]:
            raise ValueError(f"the record at byte {at} is damaged")
        yield at, payload
        at = end + _TAIL.size
        if bytes(content[at : at + 1]) != END_MARK:
            raise ValueError(f"the record before byte {at} has no end mark")
        at += 1


def write_records(
    docs: DataFrame,
    path: str,
    make_encoder: Callable[[], Callable[[Texts], list[bytes]]],
    width: int,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
) -> None:
    """Encode whole documents and write them in ascending order of id as shards below ``path``."""
    spark = docs.sparkSession
    prepare(spark)
    chosen = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    if shards is None:
        total = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(spark.sparkContext.defaultParallelism, -(-total // SHARD_BYTES))
    last = end_id.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch in batches:
            place = 0
            for part in slices(batch.column(1), ENCODE_BYTES):
                ids = batch.column(0).slice(place, len(part)).to_pylist()
                place += len(part)
                coded = encode(part)
                made = [frame(record(doc_id, width, x + last)) for doc_id, x in zip(ids, coded, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    ordered = chosen.repartitionByRange(shards, F.asc_nulls_first("doc_id")).sortWithinPartitions(
        F.asc_nulls_first("doc_id"), "text"
    )
    frames = ordered.mapInArrow(tidy("records", run), "value binary")
    # A cast keeps the bytes as they are; the text sink writes them and its line feed.
    frames.select(F.col("value").cast("string")).write.option("lineSep", "\n").text(path)


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    """Document id, or None, and token ids (unsigned 32-bit) of a record."""
    doc_id, width = _RECORD_HEAD.unpack_from(payload)
    if width & _NO_ID:
        doc_id, width = None, width ^ _NO_ID
    return doc_id, np.frombuffer(payload, f"<u{width}", offset=_RECORD_HEAD.size).astype("<u4")


def read_records(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``shard, doc_id, offset, length, n_tokens, ids_crc32`` and ``ids`` of every record; checks every checksum."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    names = RECORD if with_ids else RECORD[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in range(batch.num_rows):
                shard = batch.column(0)[place].as_py()
                rows: list[tuple] = []
                size = 0
                for offset, payload in read_frames(memoryview(batch.column(1)[place].as_buffer())):
                    doc_id, ids = unpack(payload)
                    content = ids.tobytes()
                    row = (shard, doc_id, offset, len(payload), len(ids), zlib.crc32(content))
                    rows.append((*row, content) if with_ids else row)
                    size += len(content) if with_ids else 100
                    if size > 8_000_000:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    return files.mapInArrow(run, ", ".join(f"{name} {KINDS[name][0]}" for name in names))


KINDS = {name: ("bigint", pa.int64()) for name in ("doc_id", "offset", "length", "n_tokens", "ids_crc32")}
KINDS |= {"shard": ("string", pa.string()), "ids": ("binary", pa.binary())}
RECORD = ("shard", "doc_id", "offset", "length", "n_tokens", "ids_crc32", "ids")


def _batch(rows: list[tuple], names: Sequence[str]) -> pa.RecordBatch:
    columns = [pa.array(column, KINDS[name][1]) for name, column in zip(names, zip(*rows, strict=True), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=list(names))


def write_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """Read all shards back, write the offset index, and return it with the digest of each record's ids."""
    read_records(spark, path, with_ids=False).write.parquet(index)
    return spark.read.parquet(index)


def encode_to_records(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write shards and index, read them back: ``doc_id, start, n_tokens, ids_crc32, shard, offset, length``.

    ``start`` counts the ids of all earlier records. ``tokenizer`` is a ``tokenizers`` file; nodes need it at that path.
    """
    spark = docs.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    write_records(docs, f"{path}/shards", word_encoder(tokenizer), id_width(tokenizer), end_id)
    index = write_index(spark, f"{path}/shards", f"{path}/index")
    summed = running_sums(index, ["doc_id", "shard", "offset"], {"start": "n_tokens"})
    return summed.select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "length")


def record_at(content: bytes | memoryview, offset: int, length: int) -> tuple[int | None, np.ndarray]:
    """One record of a shard by its index entry: document id and token ids."""
    end = offset + _HEAD.size + length + _TAIL.size + 1
    _, payload = next(read_frames(memoryview(content)[offset:end]))
    return unpack(payload)
