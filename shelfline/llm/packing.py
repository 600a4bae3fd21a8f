"""Packing by power-of-two decomposition.

A document's token ids, closed by END, are cut into full pieces of LIMIT ids and
then into the binary digits of what remains, longest first: 2,725 ids give one
piece of 2,048 and pieces of 512, 128, 32, 4 and 1. Every length is a power of two
and every sequence is one piece: no sequence crosses documents, nothing is padded,
and a training step takes its sequences from one bucket of equal lengths
(`write_buckets` stores one folder a length).

Nothing is shuffled. A sequence's id is made of its bucket, the task that cut it and
a running number of that bucket in the task, so ids are unique and sort by bucket.
Store the result before it is read twice: another division of the input into tasks
gives other (again unique) sequence ids.

Ids come from the library's tokenizer, one white-space word at a time: this
vocabulary drops white space, so no token and no normalisation reaches across an
ASCII blank. A worker remembers words, up to REMEMBERED_BYTES. Texts are
read in slices of SLICE_BYTES that end at a blank, and pieces leave a task in batches
of BATCH_BYTES, so a very long text costs its ids and no list of all its words.

A null or empty text is the single id END. Rows with equal or null doc_id are packed
each for itself. An empty table gives no piece; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import arrow_schema

LIMIT, END = 2048, 1
SLICE_BYTES, BATCH_BYTES, REMEMBERED_BYTES = 1 << 22, 1 << 24, 96 << 20
#: Bits of a sequence id: running number in the task, task, bucket (the power of two).
NUMBER_BITS, TASK_BITS = 34, 24
#: A vocabulary travels to the workers once; larger files are refused.
VOCABULARY_BYTES = 64 << 20

_BLANK = re.compile(rb"[ \t-\r]")
_encoders: dict[int, WordEncoder] = {}


def slices(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        cut = _BLANK.search(text, at + SLICE_BYTES)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class _Known(dict):
    """Ids of words met; words looked up in vain are noted."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> None:
        self.fresh.append(word)


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit numbers."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known = _Known()
        self.size = 0

    def learn(self, fresh: list[bytes]) -> None:
        """Unmet words go to the library as one text; offsets tell which ids are whose."""
        text = b" ".join(fresh).decode("utf-8", "replace")
        found = self.tokenizer.encode(text, add_special_tokens=False)
        count = len(found)
        # Numbers one by one: a list of pairs costs NumPy ten times as much.
        starts = np.maximum.accumulate(np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * count)[::2])
        next_word = np.cumsum(np.fromiter(map(len, text.split(" ")), np.int64, len(fresh)) + 1)
        ends = (4 * np.searchsorted(starts, next_word)).tolist()
        ids = np.fromiter(found.ids, "<u4", count).tobytes()
        self.known.update(zip(fresh, map(ids.__getitem__, map(slice, [0, *ends], ends))))
        self.size += sum(map(len, fresh)) + len(ids) + 150 * len(fresh)

    def __call__(self, text: bytes | None) -> bytes:
        out = bytearray()
        for part in slices(text or b""):
            ids = list(map(self.known.__getitem__, part.split()))
            if fresh := self.known.fresh:
                self.learn(list(dict.fromkeys(fresh)))
                missing = map(self.known.__getitem__, fresh)
                ids = [next(missing) if i is None else i for i in ids]
                self.known.fresh = []
            out += b"".join(ids)
            if self.size > REMEMBERED_BYTES:
                self.known, self.size = _Known(), 0
        return bytes(out)


def encoder(vocabulary: str) -> WordEncoder:
    key = zlib.crc32(vocabulary.encode())
    if key not in _encoders:
        _encoders[key] = WordEncoder(vocabulary)
    return _encoders[key]


def lengths(n: int) -> list[int]:
    """Piece lengths of n ids: full pieces, then the powers of two of the rest, descending."""
    full, rest = divmod(n, LIMIT)
    return [LIMIT] * full + [1 << k for k in reversed(range(LIMIT.bit_length() - 1)) if rest >> k & 1]


def pack(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset: a row per piece."""
    if os.path.getsize(vocabulary_path) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary_path} is larger than {VOCABULARY_BYTES} bytes")
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids binary, " \
             "doc_tokens long, sequence_id long, offset long"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary.value), np.array([END], "<u4").tobytes()
        task, numbers = TaskContext.get().partitionId(), [0] * LIMIT.bit_length()
        if task >> TASK_BITS:
            raise ValueError(f"more than {1 << TASK_BITS} tasks")
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                ids, start = encode(text.as_py()) + end, 0
                total = len(ids) // 4
                for length in lengths(total):
                    bucket = length.bit_length() - 1
                    sequence = (bucket << TASK_BITS | task) << NUMBER_BITS | numbers[bucket]
                    numbers[bucket] += 1
                    rows.append((doc_id, start, length, ids[4 * start:4 * (start + length)], total, sequence, 0))
                    start += length
                    held += 4 * length + 64
                    if held > BATCH_BYTES:
                        yield as_batch(rows)
                        rows, held = [], 0
        if rows:
            yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences as Parquet, one folder for each length."""
    pieces.write.partitionBy("length").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
