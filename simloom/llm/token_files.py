"""Token-ID files: one zstandard frame a document, a checksum a frame, and a seek table at the end.

A file is a seekable zstandard stream, so any zstandard tool unpacks it to the documents' ids as little-endian
unsigned 32-bit integers. Its parts, in order:

* a skippable frame with the index: shard number (u64), documents (u32), then for each document its id (i64),
  a flag for a null id (u8) and its number of ids (u32);
* an independent frame a document, with zstandard's own content checksum;
* a skippable frame with the seek table: for each frame its packed size, unpacked size and the low half of the
  XXH64 of its unpacked bytes, then the number of frames, a descriptor byte and the magic number of seek tables.

The sink is Spark's text writer with one row a file. It stores a string's bytes as they are and ends each row with
the line separator, which here is the seek table's magic number. So files go through Spark's commit protocol to any
store that Spark can write, and a lost executor leaves no half-written file behind.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, settle, slices, table, text_rows, trimmed

# Fixed values of the seekable zstandard format.
INDEX_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = b"\xb1\xea\x92\x8f"
CHECKSUMS = 0x80

#: Entries of a worker's cache from pieces of text to ids. Past that it starts anew, but for what the last one still gives.
CACHE = 250_000
_caches: dict[str, tuple] = {}

#: Words that neither the normalizer nor the pre-tokenizer changes or parts.
_BARE = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: Byte-level vocabularies write a byte as the character of its number; those that don't print follow from 256 up.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


def _pieces(body: bytes) -> list[str]:
    """Pieces that the tokenizer treats alike on their own: white space never lies inside a token."""
    if b"<|" not in body:  # special tokens are matched before letters become lower case
        body = body.lower()
    return body.decode("utf-8", "replace").replace("\n", " ").split(" ")


class Ids:
    """Ids of whole texts by the tokenizers library; a piece that was seen before isn't encoded again."""

    def __init__(self, vocabulary: bytes | str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(vocabulary) if isinstance(vocabulary, bytes) else Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        # The model may be asked for bare words, where text goes through nothing else that could change them.
        self.bare = _BARE if self._byte_level() else lambda _: None
        self.stops = {x: np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in ".,"}
        self.cache: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}

    def _byte_level(self) -> bool:
        def ids(x: str) -> list[int]:
            return self.tokenizer.encode(x, add_special_tokens=False).ids

        asked = ("the", "straße", "çàéîõü", "zyxwvutsrqponmlkjihgfedcba" * 3)
        return all(self._word(x) == ids(x) and ids(x) + ids(".") + ids(",") == ids(x + ".") + ids(",") for x in asked)

    def _word(self, word: str) -> list[int]:
        raw = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
        return [x.id for x in self.model.tokenize(raw)]

    def encode(self, bodies: list[bytes]) -> list[bytes]:
        texts = [_pieces(x) for x in bodies]
        seen = set().union(*texts)
        missing = seen - self.cache.keys()
        if len(self.cache) + len(missing) > CACHE:
            self.last, self.cache, missing = self.cache, {}, seen
        cache, last, bare, rest = self.cache, self.last, self.bare, []

        def packed(word: str) -> bytes:
            found = cache.get(word) or last.get(word)
            if found is None:
                ids = self._word(word)
                found = struct.pack(f"<{len(ids)}I", *ids)
            cache[word] = found
            return found

        for piece in missing:
            if (known := last.get(piece)) is not None:
                cache[piece] = known
            elif bare(piece):
                packed(piece)
            elif piece[-1:] in (".", ",") and bare(piece[:-1]):  # a letter and a stop always part
                cache[piece] = packed(piece[:-1]) + self.stops[piece[-1]]
            else:
                rest.append(piece)
        for i in range(0, len(rest), 20_000):
            part = rest[i : i + 20_000]
            for piece, found in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                cache[piece] = struct.pack(f"<{len(found.ids)}I", *found.ids)
        get = cache.__getitem__
        return [b"".join(map(get, x)) for x in texts]


def encoder(vocabulary: str) -> Ids:
    if vocabulary not in _caches:
        _caches[vocabulary] = Ids(vocabulary)
    return _caches[vocabulary]


def encode_frames(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (ids with the end id), frame (packed), low (half of the XXH64) of every document; no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, pack = encoder(vocabulary), struct.pack("<I", end_id), zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        for batch in batches:
            bodies = batch.column(1)
            for a, b in slices(bodies, 4 << 20):
                raw = [x + end for x in ids.encode(bodies[a:b].to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        pa.array([len(x) // 4 for x in raw], pa.int64()),
                        pa.array([pack.compress(x) for x in raw], pa.binary()),
                        pa.array([xxhash.xxh64_intdigest(x) & 0xFFFFFFFF for x in raw], pa.int64()),
                    ],
                    names=["id", "n", "frame", "low"],
                )

    return text_rows(docs, id_col, text_col).mapInArrow(trimmed(work), f"id {kind}, n bigint, frame binary, low bigint")


def shard_bytes(shard: int, ids: list, counts: list[int], frames: list[bytes], lows: list[int]) -> bytes:
    """A whole file but for the closing magic number."""
    index = struct.pack("<QI", shard, len(ids)) + b"".join(struct.pack("<qBI", x or 0, x is None, n) for x, n in zip(ids, counts, strict=True))
    head = struct.pack("<II", INDEX_MAGIC, len(index)) + index
    entries = struct.pack("<III", len(head), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
    entries += b"".join(struct.pack("<III", len(f), 4 * n, low) for f, n, low in zip(frames, counts, lows, strict=True))
    tail = struct.pack("<II", TABLE_MAGIC, len(entries) + 9) + entries + struct.pack("<IB", len(frames) + 1, CHECKSUMS)
    return head + b"".join(frames) + tail


def parse_index(content: bytes) -> tuple[int, list, list[int], np.ndarray, np.ndarray]:
    """Shard number, ids, counts of ids, the frames' offsets and the seek table's rows (packed, unpacked, checksum)."""
    if content[-4:] != SEEK_MAGIC:
        raise ValueError("no seek table at the end")
    frames, _ = struct.unpack("<IB", content[-9:-4])
    rows = np.frombuffer(content, "<u4", 3 * frames, len(content) - 9 - 12 * frames).reshape(-1, 3)
    shard, n = struct.unpack("<QI", content[8:20])
    index = np.frombuffer(content, np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")]), n, 20)
    ids = [None if null else int(x) for x, null in zip(index["id"], index["null"], strict=True)]
    offsets = np.concatenate([[0], np.cumsum(rows[:, 0], dtype=np.int64)])
    return shard, ids, [int(x) for x in index["n"]], offsets, rows


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_mb: int = 16
) -> None:
    """Encodes every whole text and writes it to files of about shard_mb, in ascending order of ids over the files.

    Documents are encoded where they lie; only packed frames are then dealt out by ranges of ids. Null text is
    empty (just the end id); null ids come first; equal ids follow each other. An empty table gives no files.
    ``id_col`` must be an integer. A document larger than shard_mb gets a file of its own.
    """
    frames = settle(encode_frames(docs, vocabulary, end_id, id_col, text_col), "token-frames")
    packed = frames.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    parts = max(frames.sparkSession.sparkContext.defaultParallelism, -(-packed // (shard_mb << 20)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        rows: tuple[list, list, list, list] = ([], [], [], [])

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard_bytes(part << 32 | seq, *rows)], pa.binary())], names=["value"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for column, x in zip(rows, row, strict=True):
                    column.append(x)
                held += len(row[2])
                if held >= shard_mb << 20:
                    yield flush()
                    seq, held, rows = seq + 1, 0, ([], [], [], [])
        if rows[0]:
            yield flush()

    ranged = frames.repartitionByRange(parts, "id", "low").sortWithinPartitions("id", "low").select(F.col("id").cast("bigint"), "n", "frame", "low")
    files = ranged.mapInArrow(trimmed(work), "value binary").select(F.col("value").cast("string"))
    files.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", SEEK_MAGIC.decode("latin-1")).text(path)


def read_token_files(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """shard, doc_id, at (place in its file), n_tokens, tokens (little-endian u32 bytes) of all documents or of those named.

    The seek table leads to the frames; frames of other documents are not unpacked. Every checksum is verified.
    """
    wanted = None if ids is None else frozenset(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for x in batch.column(0):
                content = x.as_buffer().to_pybytes()
                shard, own, counts, offsets, rows = parse_index(content)
                starts = np.concatenate([[0], np.cumsum(counts)]).tolist()
                take = [i for i, d in enumerate(own) if wanted is None or d in wanted]
                for k in range(0, len(take), 2000):
                    part, out = take[k : k + 2000], []
                    for i in part:
                        raw = unpack.decompress(content[offsets[i + 1] : offsets[i + 2]])
                        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != rows[i + 1, 2]:
                            raise ValueError(f"checksum of document {own[i]}")
                        out.append(raw)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard] * len(part), pa.int64()),
                            pa.array([own[i] for i in part], pa.int64()),
                            pa.array([starts[i] for i in part], pa.int64()),
                            pa.array([counts[i] for i in part], pa.int64()),
                            pa.array(out, pa.binary()),
                        ],
                        names=["shard", "doc_id", "at", "n_tokens", "tokens"],
                    )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(trimmed(work), "shard bigint, doc_id bigint, at bigint, n_tokens bigint, tokens binary")


def op8_token_files(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary)
    rows = settle(
        read_token_files(spark, path).select("shard", "doc_id", "at", "n_tokens", F.crc32("tokens").alias("ids_crc32")), "token-rows"
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = rows.groupBy("shard").agg(F.sum("n_tokens").alias("own")).select("shard", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    return rows.join(files, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


