"""Byte-level BPE encoding and decoding.

The documents of a task are reduced to their distinct words (Arrow). Every distinct word passes through
Spark as one row, an array of its bytes. There a higher-order function
folds the ranked merges over the array: each step merges the first pair of the lowest rank and
looks up the ranks of the two pairs that it makes in a literal rank map. Decoding
looks up the bytes of each id in a literal array and concatenates them. The next Arrow stage puts words together to
documents. All of it is one narrow stage: nothing but the cache below is shuffled, and a lost task is run again alone.

The literal rank map is a sparse matrix by rows that are shifted until their entries don't meet (`displaced`): the
pair (a, b) can stand at base[a] + b only, and its entry names a and the id that both merge to, which is the rank too.
The map stands once in a fold, as plans carry and print every mention of a literal.

Words that many tasks would fold are folded once: `frequent` counts the words of about SAMPLE documents, folds the
commonest (CACHE at most) in the same way, and a broadcast join finds them. The cache saves time only; a
word that isn't in it is folded by each task that meets it, so ids don't depend on the sample.

A word may be cut between two bytes that no token holds side by side, as no merge reaches over them. `Cutter` cuts words
of over 32 characters there, so a run of Chinese or Japanese, one word to the pattern, becomes short pieces.
A fold's time grows with the square of its piece, so a piece of over LONG bytes that has no such
place (such as one letter repeated a thousand times) is merged through a heap by the same ranks (n log n).

Defined results
  null or empty text   no ids, decodes to nothing
  null doc_id          handled like any other
  repeated rows, ties  each row by itself; equal ranks merge from the left
  empty table          empty result
  extra columns        ignored
  very long texts      whole
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.pieces import Splitter, bounded, gather
from corpuslab.llm.shared import arrow_stage, materialise

#: Bytes of the longest piece that is folded.
LONG = 1024
#: Bytes of text whose words are encoded at once. Two Arrow stages run in each task, so this is kept small.
SLICE = 2 << 20
#: Words that a task remembers at most, so that each is encoded once.
WORDS = 300_000
#: The cache: about so many documents are read for it, and it holds so many words at most.
SAMPLE, CACHE = 20_000, 300_000
#: Words of a document that are put together at once.
CODES = 1 << 18
#: Stands for "no merge" among ranks.
NONE = 1 << 16
#: Before the first and after the last id of a word.
EDGE = NONE - 1
#: An entry of the rank map that no pair has.
FREE = 0


def read_ranks(lines: list[str]) -> dict[bytes, int]:
    """Lines of base64 bytes and rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Every way in which two tokens make a third."""
    return {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


def displaced(merges: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """(base, table): the entry of (a, b) is table[base[a] + b] = (a + 1) << 17 | rank. Rows of many entries are placed first, each
    at the first shift at which its places are free."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for (a, b), r in merges.items():
        rows.setdefault(a, []).append((b, r))
    most = NONE + 2 * len(merges) + 2 * EDGE
    free, base, table, start = np.ones(most, dtype=bool), np.zeros(NONE, np.int64), np.full(most, FREE, np.int64), 0
    for a in sorted(rows, key=lambda x: (-len(rows[x]), x)):
        places = np.array([b for b, _ in rows[a]])
        at, window = max(start, int(places.min())), 512
        while True:
            shifts = np.flatnonzero(free[at : at + window]) + at - int(places.min())
            for b in places.tolist():
                shifts = shifts[free[shifts + b]]
                if not len(shifts):
                    break
            if len(shifts):
                break
            at, window = at + window, min(2 * window, NONE)
        base[a] = shifts[0]
        free[shifts[0] + places] = False
        table[shifts[0] + places] = [(a + 1) << 17 | r for _, r in rows[a]]
        while not free[start]:
            start += 1
    return base, table[: int(base.max()) + NONE]


def _numbers(values: list[int], kind: str) -> Column:
    """A literal array: the cast of a split string is folded once, when the query is planned."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


class RankMap:
    """Literal arrays, read in place.

    A word's state is an array of one number a token, rank << 16 | id: the rank is that of the pair which the token makes with
    the next one. So the least number is the first pair of the lowest rank, and one array holds all that a fold needs.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= EDGE or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must be below 65535 and hold every byte")
        merges = pairs(ranks)
        base, table = displaced(merges)
        self.base, self.table = _numbers(base.tolist(), "int"), _numbers(table.tolist(), "bigint")
        ids = [ranks[bytes([b])] for b in range(256)]
        # the state of each byte before each byte, and before none (256)
        state = [merges.get((a, b), NONE) << 16 | a for a in ids for b in [*ids, -1]]
        self.state = _numbers(state, "bigint")
        by_id = {r: t for t, r in ranks.items()}
        self.pieces = F.split(F.lit(",".join(by_id.get(i, b"").hex() for i in range(max(by_id) + 1))), ",")

    def token(self, a: Column, b: Column) -> Column:
        """The state of the token a before b. An entry's difference in its bits from (a + 1) << 17 is the rank if it is the
        pair's, and over NONE if not."""
        entry = F.get(self.table, F.get(self.base, a.cast("int")) + b.cast("int"))
        return F.shiftleft(F.least(entry.bitwiseXOR(F.shiftleft(a + 1, 17)), _long(NONE)), 16).bitwiseOR(a)

    def encode(self, word: Column) -> Column:
        """word: array of bytes as numbers; returns the array of ids. The fold runs as often as merges are possible at
        most, and does nothing once no pair is left."""
        edge, rest = F.array(_long(NONE << 16 | EDGE)), F.lit(1 << 30)
        after = lambda i: F.coalesce(F.get(word, i + 1).cast("int"), F.lit(256))
        start = F.flatten(F.array(edge, F.transform(word, lambda x, i: F.get(self.state, x.cast("int") * 257 + after(i))), edge))

        def merge(state: Column, at: Column) -> Column:
            """The token at `at`, from 1, merges with the next: what stands before, the two fresh tokens, what stands behind."""
            id_at = lambda i: F.get(state, i).bitwiseAND(_long(EDGE))
            made = F.shiftright(F.get(state, at - 1), 16)
            first = lambda j: F.when(j == 0, id_at(at - 2)).otherwise(made)
            second = lambda j: F.when(j == 0, made).otherwise(id_at(at + 1))
            fresh = F.transform(F.array(F.lit(0), F.lit(1)), lambda j: self.token(first(j), second(j)))
            return F.array(F.slice(state, F.lit(1), at - 2), fresh, F.slice(state, at + 2, rest))

        def step(state: Column, _: Column) -> Column:
            least = F.array_min(state)
            # a transform over one element gives its value a name, so that it is evaluated once
            parts = F.transform(F.array(F.array_position(state, least).cast("int")), lambda at: merge(state, at))
            return F.when(least < _long(NONE << 16), F.flatten(F.flatten(parts))).otherwise(state)

        none = F.array().cast("array<int>")
        rounds = F.when(F.size(word) > 1, F.sequence(F.lit(1), F.size(word) - 1)).otherwise(none)
        ids = lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda e: e.bitwiseAND(_long(EDGE)).cast("int"))
        return F.when(F.size(word) > 0, F.aggregate(rounds, start, step, ids)).otherwise(none)

    def decode(self, ids: Column) -> Column:
        """The bytes of the ids, concatenated."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), ""))


class Cutter:
    """Cuts words between characters whose bytes there stand side by side in no token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.side_by_side = np.zeros((256, 256), dtype=bool)
        for t in ranks:
            of = np.frombuffer(t, np.uint8)
            self.side_by_side[of[:-1], of[1:]] = True

    def __call__(self, word: str) -> list[str]:
        raw = np.frombuffer(word.encode(), np.uint8)
        cut = ~self.side_by_side[raw[:-1], raw[1:]] & (raw[1:] & 0xC0 != 0x80)
        at = np.cumsum(raw & 0xC0 != 0x80)  # characters up to each byte
        ends = [0, *at[:-1][cut].tolist(), len(word)]
        return [word[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges through a heap, for words of any length."""
    n = len(word)
    end = list(range(1, n + 1))  # end of the piece that starts here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def push(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    while heap:
        _, i, upto = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != upto:
            continue
        alive[end[i]] = False
        end[i] = upto
        if upto < n:
            before[upto] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded (binary): the documents' ids and what they decode to."""
    return _stages(docs, ranks, pattern, digests=False)


def digest_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _stages(docs, ranks, pattern, digests=True)


class Pile:
    """Arrays of words, joined, with their lengths."""

    def __init__(self, kind: np.dtype):
        self.kind = kind
        self.parts, self.sizes, self.whole = [], [], None

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.parts.append(flat.astype(self.kind, copy=False))
        self.sizes.append(sizes.astype(np.int64))
        self.whole = None

    def add_lists(self, lists: pa.ListArray) -> None:
        self.add(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()))

    def add_binary(self, texts: pa.Array) -> None:
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        self.add(np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].copy(), np.diff(offsets))

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of all codes, joined, and where each code's start (one more than codes)."""
        if self.whole is None:
            flat = np.concatenate(self.parts) if self.parts else np.zeros(0, self.kind)
            sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
            self.parts, self.sizes = [flat], [sizes]
            self.whole = flat, sizes
        return gather(self.whole[1], self.whole[0], codes)


def _arrays(words: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, words)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(words), np.uint8).astype(np.int16)))


def frequent(docs: DataFrame, rank_map: RankMap, splitter: Callable[[], Splitter]) -> DataFrame:
    """(key, known): the commonest words of about SAMPLE documents, CACHE at most, as arrays of bytes, and their ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for whole in batches:
            for batch in bounded(whole, SLICE):
                words, codes, _ = split.batch(batch.column(1))
                times = np.bincount(codes, minlength=len(words))
                some = [(w, k) for w, k in zip(words, times.tolist(), strict=True) if len(w) <= LONG // 4]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([k for _, k in some], pa.int64())], names=["word", "n"])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_arrays([w.encode() for w in batch.column(0).to_pylist()])], names=["key"])

    share = min(1.0, SAMPLE / max(1, docs.count()))
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    sample = docs.filter(F.col("doc_id").isNotNull() & (mark < int(share * (1 << 20)))).select("doc_id", "text")
    counted = arrow_stage(sample, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialise(counted.filter("n > 1"), "counted")
    # the least count that leaves CACHE words: there are far fewer counts than words
    kept, least = 0, 1 << 62
    for row in sorted(counted.groupBy("n").count().collect(), reverse=True):
        if kept + row["count"] > CACHE:
            break
        kept, least = kept + row["count"], row["n"]
    words = arrow_stage(counted.filter(F.col("n") >= least).select("word"), raw, "key array<smallint>")
    return materialise(words.select("key", rank_map.encode(F.col("key")).alias("known")), "cache")


def _stages(docs: DataFrame, ranks: dict[bytes, int], pattern: str, digests: bool) -> DataFrame:
    rank_map, cutter = RankMap(ranks), Cutter(ranks)
    splitter = lambda: Splitter(pattern, cutter)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # of the vocabulary's fixed size

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of words that are new in this task, then rows of documents as codes of words. A dictionary of over WORDS words is
        dropped before the next slice; code 0 tells the reader."""
        words, known = splitter(), {}
        for whole in batches:
            for batch in bounded(whole, SLICE):
                if len(known) > WORDS:
                    known.clear()
                before = len(known)
                codes, bounds = words.codes(batch.column(1), known)
                raw = [w.encode() for w in islice(known, before, None)]
                for at in range(0, len(raw), 10_000):
                    some = raw[at : at + 10_000]
                    arrays = _arrays([w if len(w) <= LONG else b"" for w in some])
                    merged = [heap_merge(w, shared.value) if len(w) > LONG else None for w in some]
                    yield rows(len(some), range(before + at, before + at + len(some)), arrays, pa.array(merged, pa.list_(pa.int32())))
                del raw
                for at in range(0, batch.num_rows, 1000):
                    n = min(1000, batch.num_rows - at)
                    parts = [codes[bounds[i] : bounds[i + 1]].astype("<i4").tobytes() for i in range(at, at + n)]
                    yield rows(n, doc_id=batch.column(0).slice(at, n), codes=pa.array(parts, pa.large_binary()).cast(pa.binary()))
                pa.default_memory_pool().release_unused()

    kinds = {"code": pa.int32(), "word": pa.list_(pa.int16()), "merged": pa.list_(pa.int32()), "doc_id": pa.int64(), "codes": pa.binary()}

    def rows(n: int, code=None, word=None, merged=None, doc_id=None, codes=None) -> pa.RecordBatch:
        given = [pa.array(code, pa.int32()) if code is not None else None, word, merged, doc_id, codes]
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if x is None else x for x, k in zip(given, kinds.values(), strict=True)], names=list(kinds))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words are kept as joined arrays of ids and of bytes, with their lengths."""
        ids, texts = Pile(np.dtype("<u4")), Pile(np.dtype(np.uint8))
        for batch in batches:
            is_word = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(is_word)) + 1, [len(is_word)])).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if not is_word[a]:
                    yield documents(part.column(1), part.column(2), ids, texts)
                    continue
                if part.column(0)[0].as_py() == 0:
                    ids, texts = Pile(ids.kind), Pile(texts.kind)
                ids.add_lists(part.column(3))
                texts.add_binary(part.column(4))

    def documents(doc_ids: pa.Array, codes: pa.Array, ids: Pile, texts: Pile) -> pa.RecordBatch:
        ends = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1] // 4
        flat = np.frombuffer(codes.buffers()[2] or b"", "<i4")
        rows, at = [], 0
        while at < len(codes):  # as many documents at once as have CODES words, one at least
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + CODES, side="right")) - 1)
            rows += several(flat, ends[at : upto + 1], ids, texts) if digests else [whole(flat[ends[i] : ends[i + 1]], ids, texts) for i in range(at, upto)]
            at = upto
        a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
        if digests:
            arrays, names = [pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"]
        else:
            arrays, names = [pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.binary())], ["ids", "decoded"]
        return pa.RecordBatch.from_arrays([doc_ids, *arrays], names=["doc_id", *names])

    def whole(codes: np.ndarray, ids: Pile, texts: Pile) -> tuple[np.ndarray, bytes, None]:
        return ids.gather(codes)[0].astype(np.int32), texts.gather(codes)[0].tobytes(), None

    def several(flat: np.ndarray, ends: np.ndarray, ids: Pile, texts: Pile) -> list[tuple[int, str, str]]:
        """The digests of documents, a document of more than CODES words in parts."""
        out = [(0, hashlib.sha256(), hashlib.sha256()) for _ in ends[1:]]
        for start in range(ends[0], max(ends[-1], ends[0] + 1), CODES):
            bounds = np.clip(ends, start, start + CODES) - start
            (x, x_ends), (y, y_ends) = ids.gather(flat[start : min(start + CODES, ends[-1])]), texts.gather(flat[start : min(start + CODES, ends[-1])])
            xs, ys = x_ends[bounds].tolist(), y_ends[bounds].tolist()
            for i, (n, h, g) in enumerate(out):
                h.update(x[xs[i] : xs[i + 1]])
                g.update(y[ys[i] : ys[i + 1]])
                out[i] = (n + xs[i + 1] - xs[i], h, g)
        return [(n, h.hexdigest(), g.hexdigest()) for n, h, g in out]

    coded = arrow_stage(docs.select("doc_id", "text"), split, "code int, word array<smallint>, merged array<int>, doc_id long, codes binary")
    coded = coded.join(F.broadcast(frequent(docs, rank_map, splitter)), F.col("word") == F.col("key"), "left")  # CACHE rows at most
    folded = F.when(F.col("code").isNotNull(), F.coalesce("known", "merged", rank_map.encode(F.col("word"))))
    encoded = coded.select("code", "doc_id", "codes", folded.alias("ids"))
    decoded = encoded.withColumn("decoded", F.when(F.col("ids").isNotNull(), rank_map.decode(F.col("ids"))))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded binary"
    return arrow_stage(decoded, join, schema)
