"""Byte-level BPE over a whole corpus, with a segment tree for each stretch of text."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from corpusloom.runtime import map_batches

#: Where the public vocabularies lie, and the pattern they cut text by.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern where all characters are ASCII, for the faster matcher.
ASCII_PATTERN = (
    r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t\n\v\f\r A-Za-z0-9]+"
    r"|[\t\n\v\f\r ]+(?![^\t\n\v\f\r ])|[\t\n\v\f\r ]+"
)
KEPT_STRETCHES = 300_000
LONGEST_KEPT = 48


class SegmentTree:
    """Leftmost minimum over positions under point updates."""

    __slots__ = ("size", "node")

    def __init__(self, values: list[int]):
        self.size = size = 1 << max(0, (len(values) - 1).bit_length())
        none = 1 << 62
        self.node = node = [none] * size + values + [none] * (size - len(values))
        for i in range(size - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a <= b else b

    def set(self, i: int, value: int) -> None:
        node = self.node
        i += self.size
        node[i] = value
        while i > 1:
            i >>= 1
            a, b = node[2 * i], node[2 * i + 1]
            low = a if a <= b else b
            if node[i] == low:
                return
            node[i] = low


class BytePairEncoder:
    """Ids by rank: of all neighbouring pairs the one of least rank is joined, the leftmost first."""

    def __init__(self, vocabulary: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        self.kept = _Kept(self)
        self.ascii = re.compile(ASCII_PATTERN).findall
        import regex

        self.any = regex.compile(PATTERN).findall

    def merge(self, data: bytes) -> list[int]:
        """Ids of one stretch. The tree's leaf of a live position holds the rank of its pair
        with the live position to its right, tagged with the position; a merge updates the
        leaves of its two ends and of the neighbour to its left, in logarithmic time."""
        rank, n = self.rank, len(data)
        if n == 1:
            return [rank[data]]
        none = 1 << 62
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        keys = []
        for i in range(n - 1):
            r = rank.get(data[i : i + 2])
            keys.append(none if r is None else r * n + i)
        keys.append(none)
        tree = SegmentTree(keys)
        node = tree.node
        while node[1] < none:
            i = node[1] % n
            gone = after[i]
            end = after[gone]
            after[i] = end
            tree.set(gone, none)
            if end < n:
                before[end] = i
                r = rank.get(data[i : after[end]])
                tree.set(i, none if r is None else r * n + i)
            else:
                tree.set(i, none)
            left = before[i]
            if left >= 0:
                r = rank.get(data[left:end])
                tree.set(left, none if r is None else r * n + left)
        out, i = [], 0
        while i < n:
            out.append(rank[data[i : after[i]]])
            i = after[i]
        return out

    def packed(self, text: str) -> bytes:
        """Ids of a text as native 32-bit integers."""
        return b"".join(map(self.kept.__getitem__, (self.ascii if text.isascii() else self.any)(text)))

    def encode(self, text: str) -> list[int]:
        return list(memoryview(self.packed(text)).cast("i"))


class _Kept(dict):
    """Ids of the stretches met before; a bounded store that starts anew when full."""

    def __init__(self, encoder: BytePairEncoder):
        self.encoder = encoder

    def __missing__(self, stretch: str) -> bytes:
        import array

        ids = array.array("i", self.encoder.merge(stretch.encode("utf-8", "replace"))).tobytes()
        if len(stretch) <= LONGEST_KEPT:
            if len(self) >= KEPT_STRETCHES:
                self.clear()
            self[stretch] = ids
        return ids


_loaded: dict[str, BytePairEncoder] = {}


def _encoder(name: str, vocabulary) -> BytePairEncoder:
    if name not in _loaded:
        _loaded[name] = BytePairEncoder(vocabulary.value)
    return _loaded[name]


def _shared_vocabulary(frame: DataFrame, path: str):
    """The vocabulary file for all executors: of at most some 60,000 lines, whatever the corpus."""
    if os.path.getsize(path) > 16_000_000:
        raise ValueError(f"{path} is too large for a vocabulary")
    with open(path, "rb") as f:
        return frame.sparkSession.sparkContext.broadcast(f.read())


def token_ids(
    documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens, in the text's order.

    Null and empty texts give the empty list, blank ones are encoded as they are; strings
    that look like special tokens are ordinary text. Every row gives a row, repeated ones
    too; further columns are ignored; an empty table gives no rows. There is no shuffle.
    """
    vocabulary = _shared_vocabulary(documents, tokenizer)
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                packed = [encoder.packed(t) if t else b"" for t in batch.column(1).to_pylist()]
                ends = [0]
                for p in packed:
                    ends.append(ends[-1] + len(p) // 4)
                flat = b"".join(packed)
                values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(flat)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    shape = StructType([StructField("key", kind), StructField("ids", ArrayType(IntegerType(), False))])
    return map_batches(source, run, shape).withColumnRenamed("key", key)


def token_counts(
    documents: DataFrame, keep: list[str], text: str = "text", tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
) -> DataFrame:
    """``keep`` columns and n_tokens BIGINT of each text, by the same encoder."""
    vocabulary = _shared_vocabulary(documents, tokenizer)
    source = documents.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, vocabulary)
        for batch in batches:
            sizes = [len(encoder.packed(t)) // 4 if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    shape = StructType([*source.select(*keep).schema.fields]).add("n_tokens", LongType())
    return map_batches(source, run, shape)
