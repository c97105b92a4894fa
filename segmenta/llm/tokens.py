"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A token table is a folder of Parquet files whose rows are blocks of about ``BLOCK_TOKENS`` ids of whole documents, in
ascending doc_id order.  A block holds

* ``ranks``    the block's distinct ids, the most frequent first, as little-endian unsigned 32-bit integers;
* ``control``  two bits an id, four ids a byte, lowest bits first: the number of bytes of its rank less one;
* ``data``     the ranks' bytes, lowest first, as many as control says;
* ``doc_ids``, ``lengths``  the documents and their number of ids, the end id included;
* ``part``, ``part_offset``  its place: ids of the same part before it; parts ascend with doc_id.

Every block decodes alone, by table lookup: a control byte gives the places of its four ids' bytes.  Writing needs one
exchange (range by doc_id), reading none.

Tokenizing: a byte-level BPE splits before every blank or newline that follows a visible character, and before every
ASCII mark that follows a letter or digit.  So pieces between such places are encoded once per worker process and kept
in a bounded cache; ids are the same as those of the whole text.

Defined cases: NULL or empty text: only the end id.  Repeated rows are separate documents, side by side.  NULL doc_id
sorts first.  An empty table gives an empty token table.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .words import byte_table, per_process, pieces, span_hashes

END_ID = 2
BLOCK_TOKENS = 1 << 19
CACHE_PIECES, TABLE_SLOTS = 1 << 20, 1 << 22
BLOCK_SCHEMA = ("part int, part_offset long, n_tokens long, doc_ids array<bigint>, lengths array<int>, ranks binary, "
                "control binary, data binary")
DOC_SCHEMA = "part int, part_start long, doc_id long, n_tokens long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- the coding -----------------------------------------------------------------------------------------------------

_CODES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3  # of the four ids of a control byte
_SIZES = (_CODES + 1).sum(1)
_AT = np.concatenate([np.zeros((256, 1), np.int64), np.cumsum(_CODES + 1, 1)[:, :3]], 1)
#: For each control byte the 16 places to gather from, and which of them count.
_GATHER = (_AT[:, :, None] + np.minimum(np.arange(4), _CODES[:, :, None])).reshape(256, 16)
_KEEP = (np.arange(4) <= _CODES[:, :, None]).reshape(256, 16).astype(np.uint8)


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranks, control, data) of a block of ids."""
    distinct, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    r = place[inverse]
    code = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    four = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    four[:len(code)] = code
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    data = r.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return distinct[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def decode_block(ranks: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ids of a block."""
    if not n:
        return np.empty(0, np.uint32)
    c = np.frombuffer(control, np.uint8)
    at = np.cumsum(_SIZES[c]) - _SIZES[c]
    # the last control byte may stand for less than four ids: what it would read beyond is padding
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(16, np.uint8)])
    got = raw[np.minimum(at[:, None] + _GATHER[c], len(raw) - 1)] * _KEEP[c]
    return np.frombuffer(ranks, "<u4")[got.reshape(-1).view("<u4")[:n]]


# --- tokenizing -----------------------------------------------------------------------------------------------------

_VISIBLE = byte_table(lambda b: 0x21 <= b <= 0x7E)
_BLANK = byte_table(lambda b: b in (0x20, 0x0A))
_ALNUM = byte_table(lambda b: b < 128 and chr(b).isalnum())
_MARK = byte_table(lambda b: 0x21 <= b <= 0x7E and not chr(b).isalnum())
#: The second bytes of C3 that make a letter (not the signs of multiplication and division).
_LATIN = byte_table(lambda b: 0x80 <= b <= 0xBF and b not in (0x97, 0xB7))
#: Pieces given to the tokenizer in one call.
CALL_PIECES = 4096


class PieceEncoder:
    """Encodes texts piece by piece, each distinct piece once while it stays in the cache."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.forget()

    def forget(self):
        # a table addressed by the low bits of a piece's hash; what it displaces is learnt again when it comes again
        self.key, self.entry = np.zeros(TABLE_SLOTS, np.uint64), np.zeros(TABLE_SLOTS, np.int32)
        self.flat, self.offsets = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encode pieces; their entries."""
        ids = []
        for at in range(0, len(starts), CALL_PIECES):
            some = slice(at, at + CALL_PIECES)
            texts = [raw[s:e].decode() for s, e in zip(starts[some].tolist(), ends[some].tolist())]
            ids += [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        entries = np.arange(len(ids)) + len(self.offsets) - 1
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
        return entries

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each text."""
        n_texts = len(off) - 1
        if not len(raw):
            return np.empty(0, np.uint32), np.zeros(n_texts, np.int64)
        latin = np.zeros(len(raw), bool)
        latin[1:] = (raw[:-1] == 0xC3) & _LATIN[raw[1:]]
        is_start = np.zeros(len(raw), bool)
        is_start[1:] = (_BLANK[raw[1:]] & (_VISIBLE[raw] | latin)[:-1]) | (_MARK[raw[1:]] & (_ALNUM[raw] | latin)[:-1])
        is_start[off[:-1][off[:-1] < off[1:]]] = True
        starts = np.flatnonzero(is_start)
        ends = np.append(starts[1:], len(raw))
        if len(self.offsets) > CACHE_PIECES:
            self.forget()
        keys = span_hashes(raw, starts, ends) | np.uint64(1)  # 0 is an empty place
        place = (keys >> np.uint64(1)) & np.uint64(TABLE_SLOTS - 1)
        slot = self.entry[place]
        new = np.flatnonzero(self.key[place] != keys)
        if len(new):
            distinct, first, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
            entries = self.learn(raw.tobytes(), starts[new[first]], ends[new[first]])
            slot[new] = entries[inverse]
            at = place[new[first]]
            self.key[at], self.entry[at] = distinct, entries
        lengths = self.offsets[slot + 1] - self.offsets[slot]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.arange(total[-1]) - np.repeat(total[:-1] - self.offsets[slot], lengths)]
        return ids, np.diff(total[np.searchsorted(starts, off)])


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    """The same ids with the end id after each text."""
    ends = np.cumsum(counts)
    return np.insert(ids, ends, np.uint32(end_id)) if len(counts) else ids


# --- the jobs -------------------------------------------------------------------------------------------------------

def token_blocks(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The token table of the documents, not written yet."""
    path = tokenizer_path or default_tokenizer()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, n_held, before, part = per_process(("encoder", path), lambda: PieceEncoder(path)), [], 0, 0, 0

        def flush():
            nonlocal held, n_held, before
            ids = np.concatenate([x[2] for x in held])
            ranks, control, data = encode_block(ids)
            row = {"part": [part], "part_offset": [before], "n_tokens": [len(ids)], "doc_ids": [[d for x in held for d in x[0]]],
                   "lengths": [[int(n) for x in held for n in x[1]]], "ranks": [ranks], "control": [control], "data": [data]}
            before, held, n_held = before + len(ids), [], 0
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([
                ("part", pa.int32()), ("part_offset", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                ("lengths", pa.list_(pa.int32())), ("ranks", pa.binary()), ("control", pa.binary()), ("data", pa.binary())]))

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            part = batch.column("part")[0].as_py() if len(batch) else part
            for a, b, raw, off in pieces(batch.column("text")):
                ids, counts = encoder.encode(raw, off)
                ids, counts = with_end(ids, counts, end_id), counts + 1
                held.append((doc_ids[a:b], counts, ids))
                n_held += len(ids)
                if n_held >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")) \
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text") \
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    return ordered.mapInArrow(blocks, BLOCK_SCHEMA)


def write_tokens(docs: DataFrame, path: str, **params) -> None:
    token_blocks(docs, **params).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files at path."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["ranks"], row["control"], row["data"], row["n_tokens"])
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                view = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
                crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["part"], np.int32)), pa.array(row["part_offset"] + ends - lengths),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["part", "part_start", "doc_id", "n_tokens", "ids_crc32"])

    decoded = blocks.mapInArrow(documents, DOC_SCHEMA)
    # one row for each partition that was written, so its number is bounded by the shuffle's partitions
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")) \
        .select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return decoded.join(F.broadcast(parts), F.col("part") == F.col("p")) \
        .select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document, decoded from the files at path."""
    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["ranks"], row["control"], row["data"], row["n_tokens"])
                cuts = np.cumsum(row["lengths"])[:-1]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()),
                                                  "ids": pa.array([x.astype(np.int64) for x in np.split(ids, cuts)], pa.list_(pa.int64()))})

    return spark.read.schema(BLOCK_SCHEMA).parquet(path).mapInArrow(documents, "doc_id long, ids array<bigint>")


def token_digest(docs: DataFrame, path: str, **params) -> DataFrame:
    """Write the token table at path and give its digest as read back."""
    write_tokens(docs, path, **params)
    return read_tokens(docs.sparkSession, path)
