"""Token ids in fixed-width bit-packed files.

A file is a Parquet table of segments. A segment holds whole documents: their ids, one after another, each in the
minimum number of bits for the vocabulary, in blocks of BLOCK_IDS ids that start at byte offsets kept in the segment.
So numpy unpacks a segment at once, and any document by unpacking only the blocks that it touches.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrolith.llm.bytetext import Chunk, chunks
from ferrolith.llm.known_ids import KNOWN_WORDS, KnownIds
from ferrolith.llm.stages import new_path

BLOCK_IDS = 4096
SEGMENT_IDS = 1 << 19
END_ID = 1

SEGMENT_SCHEMA = "shard int, seq int, ids_before bigint, bits int, n_ids bigint, doc_ids array<bigint>, doc_starts array<bigint>, block_offsets array<bigint>, payload binary"


def bits_for(vocabulary: int) -> int:
    """The minimum width that holds every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> tuple[bytes, np.ndarray]:
    """The packed blocks, and the byte offset of each block."""
    ids = np.ascontiguousarray(ids, "<u4")
    parts, offsets, at = [], [], 0
    for lo in range(0, len(ids), BLOCK_IDS):
        block = ids[lo : lo + BLOCK_IDS]
        flat = np.unpackbits(block.view(np.uint8), bitorder="little").reshape(-1, 32)[:, :bits]
        parts.append(np.packbits(flat.reshape(-1), bitorder="little").tobytes())
        offsets.append(at)
        at += len(parts[-1])
    return b"".join(parts), np.array(offsets, np.int64)


def _unpack_block(data: np.ndarray, count: int, bits: int) -> np.ndarray:
    flat = np.unpackbits(data, count=count * bits, bitorder="little").reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide.reshape(-1), bitorder="little").view("<u4")


def unpack(payload: bytes, block_offsets, n_ids: int, bits: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids start..stop-1 of a segment; only the blocks that hold them are read."""
    stop = n_ids if stop is None else min(stop, n_ids)
    if start >= stop:
        return np.zeros(0, "<u4")
    data = np.frombuffer(payload, np.uint8)
    first, last = start // BLOCK_IDS, (stop - 1) // BLOCK_IDS
    out = []
    for b in range(first, last + 1):
        count = min(BLOCK_IDS, n_ids - b * BLOCK_IDS)
        lo = int(block_offsets[b])
        out.append(_unpack_block(data[lo : lo + (count * bits + 7) // 8], count, bits))
    return np.concatenate(out)[start - first * BLOCK_IDS : stop - first * BLOCK_IDS]


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct word once while it is remembered.

    The tokenizer must treat ASCII white space as a boundary that nothing crosses and that gives no ids, as one that
    splits words and drops spaces does; a text's ids are then those of its words, in order. Words are found and joined
    again in numpy by their 64-bit hashes; only new ones reach the library, many at a time.
    """

    def __init__(self, path: str, limit: int = KNOWN_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        # new words are parted by a word of one NUL, if that has an id of its own
        nul = self._ids(["\0"])[0]
        probe = self._ids(["a. \0 b", "a.", "b"])
        self.nul = nul[0] if len(nul) == 1 and probe[0] == probe[1] + nul + probe[2] else None
        self.known = KnownIds(self.encode_words, limit)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has."""
        flat, sizes = [], []
        for lo in range(0, len(words), 256):
            group = words[lo : lo + 256]
            joined = b" \0 ".join(group)
            if self.nul is not None and joined.count(b"\0") == len(group) - 1:
                ids = np.array(self._ids([joined.decode("utf-8", "replace")])[0], "<u4")
                bounds = np.concatenate([[-1], np.flatnonzero(ids == self.nul), [len(ids)]])
                if len(bounds) == len(group) + 1:
                    flat.append(ids[ids != self.nul])
                    sizes.append(np.diff(bounds) - 1)
                    continue
            found = self._ids([w.decode("utf-8", "replace") for w in group])
            flat.append(np.array([i for x in found for i in x], "<u4"))
            sizes.append(np.array([len(x) for x in found], np.int64))
        return np.concatenate([np.zeros(0, "<u4"), *flat]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def encode(self, chunk: Chunk, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the documents of a chunk, end_id after each, and how many each has."""
        begin, stop, doc = chunk.words()
        ids, sizes = self.known.ids(chunk.data, begin, stop)
        lengths = chunk.per_doc(doc, sizes) + 1
        out = np.full(len(ids) + chunk.n, end_id, "<u4")
        inner = np.ones(len(out), bool)
        inner[np.cumsum(lengths) - 1] = False
        out[inner] = ids
        return out, lengths


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One a Python worker, kept between its tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


@dataclass
class TokenFile:
    """A written file: segments in order of (shard, seq)."""

    spark: SparkSession
    path: str

    def segments(self) -> DataFrame:
        return self.spark.read.schema(SEGMENT_SCHEMA).parquet(self.path)

    def starts(self) -> DataFrame:
        """(shard, shard_start): ids in the shards before; one row a shard, so a file's partitions bound its size."""
        totals = self.segments().groupBy("shard").agg(F.sum("n_ids").alias("n"))
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))

    def documents(self) -> DataFrame:
        """Per document, from the file: doc_id, start, n_tokens, ids_crc32 (of its little-endian 32-bit ids)."""

        def run(batches):
            for batch in batches:
                for s in batch.to_pylist():
                    ids = unpack(s["payload"], s["block_offsets"], s["n_ids"], s["bits"])
                    bounds = [*s["doc_starts"], s["n_ids"]]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "shard": pa.array([s["shard"]] * len(s["doc_ids"]), pa.int32()),
                            "doc_id": pa.array(s["doc_ids"], pa.int64()),
                            "at": pa.array([s["ids_before"] + a for a in bounds[:-1]], pa.int64()),
                            "n_tokens": pa.array([b - a for a, b in zip(bounds, bounds[1:])], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])], pa.int64()),
                        }
                    )

        rows = self.segments().mapInArrow(run, "shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
        return rows.join(F.broadcast(self.starts()), "shard").select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")

    def ids_of(self, doc_id: int) -> np.ndarray:
        """One document's ids by random access: the first of that id, if it is repeated."""
        rows = self.segments().where(F.array_contains("doc_ids", doc_id)).orderBy("shard", "seq").limit(1).collect()
        if not rows:
            raise KeyError(doc_id)
        s = rows[0]
        k = s.doc_ids.index(doc_id)
        return unpack(s.payload, s.block_offsets, s.n_ids, s.bits, s.doc_starts[k], s.doc_starts[k + 1] if k + 1 < len(s.doc_starts) else s.n_ids)


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID) -> TokenFile:
    """Encodes every whole text and writes the ids, with end_id after each document, in ascending order of doc_id.

    The texts are dealt by ranges of doc_id, so that each task writes its own shard and no order is kept elsewhere. A
    null text counts as empty (only end_id); a null doc_id comes first; repeated ids are ordered by text.
    """
    path = path or new_path(docs.sparkSession, "tokens")

    def run(batches):
        coder = encoder(tokenizer)
        bits = bits_for(max(coder.vocabulary, end_id + 1))
        shard, seq, before = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        names: list[int] = []
        sizes: list[int] = []

        def segment():
            nonlocal ids, names, sizes, seq, before
            flat = np.concatenate(ids)
            starts = np.cumsum(sizes) - sizes
            payload, offsets = pack(flat, bits)
            row = {"shard": shard, "seq": seq, "ids_before": before, "bits": bits, "n_ids": len(flat), "doc_ids": names, "doc_starts": starts.tolist(), "block_offsets": offsets.tolist(), "payload": payload}
            seq, before, ids, names, sizes = seq + 1, before + len(flat), [], [], []
            return pa.RecordBatch.from_pylist([row], schema=_SEGMENT_ARROW)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for chunk in chunks(batch.column(1).cast(pa.binary())):
                found, lengths = coder.encode(chunk, end_id)
                ids.append(found)
                names += doc_ids[chunk.lo : chunk.hi]
                sizes += lengths.tolist()
                if sum(map(len, ids)) >= SEGMENT_IDS:
                    yield segment()
        if names:
            yield segment()

    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SEGMENT_SCHEMA).write.option("compression", "uncompressed").parquet(path)
    return TokenFile(docs.sparkSession, path)


_SEGMENT_ARROW = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("ids_before", pa.int64()), ("bits", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("block_offsets", pa.list_(pa.int64())), ("payload", pa.binary())])


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return write_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).documents()
