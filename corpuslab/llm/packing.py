"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of the binary digits of n: as many
pieces of `size` as fit, then one for each bit that is set in the rest, the largest
first. Every piece is a sequence by itself in the bucket of its length, so no sequence crosses
documents and none is padded. Pieces of one bucket are put into batches of equal lengths, of `batch_tokens` tokens each
but for the last of a bucket in a task.

Token ids are those of the tokenizers library for a byte-level BPE file, with no special
tokens put around, and one end id after each document. With `added`, as in the library's default
setting, the file's added tokens are cut out of a text first and give their own ids; else they are ordinary
text. Words are encoded once a batch. The merges run in tiktoken, over the vocabulary of the same file: its ids
rise with the order of its merges (which is checked), so both libraries merge alike (the tests compare them).

Defined results
  null or empty text   one piece: the end id
  null doc_id          packed like any other
  repeated rows        each packed, under sequence ids of its own
  empty table          empty result
  extra columns        ignored
  very long texts      whole; as many full sequences as needed
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.pieces import Splitter, bounded, gather
from corpuslab.llm.shared import arrow_stage


@cache
def byte_names() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte: itself if it is printable in
    Latin-1, else the next code point from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Ids of distinct words by a byte-level BPE vocabulary."""

    def __init__(self, vocabulary: str, pattern: str, added: bool = False):
        import tiktoken

        spec = json.loads(vocabulary)
        special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
        names = byte_names()
        vocab = spec["model"]["vocab"]
        ranks = {bytes(names[c] for c in t): i for t, i in vocab.items() if t not in special}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(made, made[1:], strict=False)):
            raise ValueError("ids must rise with the order of merges")
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.splitter = Splitter(pattern)
        tokens = spec.get("added_tokens", []) if added else []
        if any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at their neighbours are not supported")
        self.added = {t["content"]: t["id"] for t in tokens}
        # the first to start, of these the longest
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and where each text's start."""
        if self.cut is None:
            return self._ordinary(texts)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        has = np.zeros(len(texts), dtype=bool)
        for content in self.added:
            has |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if not has.any():
            return self._ordinary(texts)
        # a text with n added tokens becomes n + 1 ordinary ones
        split = {i: self.cut.split(texts[i].as_py()) for i in np.flatnonzero(has).tolist()}
        parts = [p for i in range(len(texts)) for p in (split[i][::2] if i in split else [texts[i].as_py()])]
        ids, bounds = self._ordinary(pa.array(parts, pa.large_string()))
        out, sizes, at = [ids[:0]], np.zeros(len(texts) + 1, dtype=np.int64), 0
        for i in range(len(texts)):
            tokens = split[i][1::2] if i in split else []
            start = len(out)
            for token in [*tokens, None]:
                out.append(ids[bounds[at] : bounds[at + 1]])
                at += 1
                if token is not None:
                    out.append(np.array([self.added[token]], dtype=ids.dtype))
            sizes[i + 1] = sum(map(len, out[start:]))
        return np.concatenate(out), np.cumsum(sizes)

    def _ordinary(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, codes, bounds = self.splitter.batch(texts)
        encode = self.bpe.encode_ordinary
        ids = [encode(w) for w in words]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((x for w in ids for x in w), dtype="<u4", count=int(sizes.sum()))
        if not len(codes):
            return np.zeros(0, dtype="<u4"), np.zeros(len(texts) + 1, dtype=np.int64)
        out, starts = gather(sizes, flat, codes)
        return out, starts[bounds]


_encoders: dict[int, Encoder] = {}


def encoder(vocabulary: str, pattern: str, added: bool) -> Encoder:
    """One a Python worker, however many tasks it runs."""
    key = hash((vocabulary, pattern, added))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary, pattern, added)
    return _encoders[key]


def binary_lengths(n: int, size: int) -> list[int]:
    """n as size + ... + size + falling powers of two. size is a power of two."""
    rest = n % size
    return [size] * (n // size) + [1 << b for b in reversed(range(size.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, vocabulary: str, pattern: str, size: int = 1024, end_id: int = 0, with_ids: bool = True, added: bool = False, batch_tokens: int = 1 << 16) -> DataFrame:
    """One row per piece, which is one sequence: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, bucket (the power of two), batch_id (of pieces of one bucket), and ids if with_ids.

    vocabulary is the content of a tokenizers file. Sequence and batch ids are unique; they number
    the pieces within each task's range, so no shuffle is needed to give them.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, pattern, added))  # of the vocabulary's fixed size
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset", "bucket", "batch_id"] + ["ids"] * with_ids
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long, bucket int, batch_id long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, counts = encoder(*shared.value), [0] * size.bit_length()  # pieces of each bucket so far
        for whole in batches:
            for part in bounded(whole, 4 << 20):
                yield one(enc, part, counts)

    def one(enc: Encoder, batch: pa.RecordBatch, counts: list[int]) -> pa.RecordBatch:
        ids, bounds = enc.batch(batch.column(1))
        at, start, length, crc, total, group, pieces = [], [], [], [], [], [], []
        end = np.array([end_id], dtype="<u4")
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            doc = np.concatenate((ids[a:b], end)).astype("<u4", copy=False)
            pos = 0
            for n in binary_lengths(len(doc), size):
                piece = doc[pos : pos + n]
                at.append(i)
                start.append(pos)
                length.append(n)
                crc.append(zlib.crc32(piece.tobytes()))
                total.append(len(doc))
                bucket = n.bit_length() - 1
                group.append(counts[bucket] * n // max(batch_tokens, n) * size.bit_length() + bucket)
                counts[bucket] += 1
                if with_ids:
                    pieces.append(piece.astype(np.int32))
                pos += n
        ints = lambda x: pa.array(x, pa.int64())
        arrays = [batch.column(0).take(ints(at)), ints(start), ints(length), ints(crc), ints(total), ints([0] * len(at)), pa.array([n.bit_length() - 1 for n in length], pa.int32()), ints(group)]
        if with_ids:
            values = pa.array(np.concatenate(pieces) if pieces else np.zeros(0, np.int32))
            arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), values))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    out = arrow_stage(docs.select("doc_id", "text"), run, schema)
    out = out.withColumn("batch_id", F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("batch_id"))
    return out.withColumn("sequence_id", F.monotonically_increasing_id())
