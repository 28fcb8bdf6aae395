"""Bounded-space online best-fit packing of token sequences.

Documents are tokenised whole, closed with an end token and cut only where longer than a
sequence. Each task packs its pieces as they arrive into a fixed number of open bins held in a
bitset keyed by free space: the tightest bin that fits takes the piece; if none fits and the
number of open bins is reached, the fullest bin closes first. Pieces arrive in the order of a hash,
so a task that is run again gives the same sequences.

Defined results: null or empty text is one piece holding the end token; texts of any length are
cut into full pieces and a rest; repeated rows are packed each; no rows give no sequences; other
columns are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

CAPACITY, END = 4096, 1
_loaded: dict = {}


class Lookup(dict):
    """A table that ``make``s what it lacks. Two generations of ``most`` entries are kept, so frequent
    entries stay, memory is bounded, and a hit doesn't leave the interpreter's own lookup."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        self[key] = found = self.make(key) if found is None else found
        return found

    def turn(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()


class WordCache:
    """Ids by the tokenizer, looked up by blank-separated chunk and, for a new chunk, by the
    pre-tokens in it: neither crosses a blank, so equal chunks have equal ids. Texts outside the
    plain Latin range, or with a special token, are encoded whole."""

    def __init__(self, path: str, most: int = 150_000):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.tokenizer = Tokenizer.from_file(path)
        self.chunks, self.tokens = Lookup(self._chunk, most), Lookup(self._token, most)
        self.plain = regex.compile("[\t\n\r\x20-\x7e\xa1-įı-ſ‐-‧]*")
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _token(self, token: str) -> bytes:
        if not token.isalpha():
            ids = self.tokenizer.encode(token, add_special_tokens=False).ids
        else:
            spelt = token if token.isascii() else self.spell(token)[0][0]
            ids = [t.id for t in self.tokenizer.model.tokenize(spelt)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        token = self.tokens.__getitem__
        if chunk.isalpha():
            return token(chunk)
        if (word := chunk[:-1]).isalpha():
            return token(word) + token(chunk[-1])
        return b"".join(map(token, self.split.findall(chunk)))

    def ids(self, text: str) -> np.ndarray:
        if not self.plain.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        found = b"".join(map(self.chunks.__getitem__, text.lower().split()))
        self.chunks.turn(), self.tokens.turn()
        return np.frombuffer(found, "<u4")


def words_of(path: str | None) -> WordCache:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = WordCache(path)
    return _loaded[path]


def tokenise(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType

    def pieces(batches):
        cache, tail = words_of(path), np.array([end], "<u4")
        for batch in batches:
            who, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([cache.ids(text.as_py() or ""), tail])
                for k, i in enumerate(range(0, len(ids), capacity)):
                    part = ids[i : i + capacity]
                    who.append(doc), piece.append(k), start.append(i), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(who, batch.schema.field(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """A fixed number of open bins; bit f of ``free`` is set while a bin with f free places is open."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.open, self.free, self.made = capacity, most, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fitting = self.free >> size
        if fitting:
            f = size + (fitting & -fitting).bit_length() - 1
            b = self.bins[f].pop()
            if not self.bins[f]:
                self.free ^= 1 << f
            self.open -= 1
        else:
            if self.open == self.most:
                f = (self.free & -self.free).bit_length() - 1
                self.bins[f].pop()
                if not self.bins[f]:
                    self.free ^= 1 << f
                self.open -= 1
            f, b = self.capacity, self.made
            self.made += 1
        if f > size:
            self.bins[f - size].append(b)
            self.free |= 1 << (f - size)
            self.open += 1
        return b, self.capacity - f


def pack(pieces: DataFrame, tasks: int, capacity: int = CAPACITY, open_bins: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. Pieces are dealt to ``tasks`` tasks by hash, so each
    task sees a like mix of lengths, and memory holds ``open_bins`` bins of two numbers each."""
    import pyarrow as pa

    def packed(batches):
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            at = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + b for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    order = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32")
    dealt = pieces.repartition(tasks, order).sortWithinPartitions(order, "doc_id", "piece", "length", "ids_crc32")
    return dealt.mapInArrow(packed, StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def pack_documents(docs: DataFrame, path: str | None = None, per_task: int = 200_000) -> DataFrame:
    """Tokenise and pack; one task for every ``per_task`` documents, so that the underfilled
    bins a task ends with stay a small part of its sequences."""
    return pack(tokenise(docs, path), max(1, math.ceil(docs.count() / per_task)))


def op2_packing(spark, sf_dir):
    from viaduct.llm.common import table

    return pack_documents(table(spark, sf_dir, "documents"))
