"""Words of the byte-level BPE pre-tokenizer, found once for each distinct stretch between spaces.

A space after a character that isn't white space always starts a new word of
the pattern (it is taken up by the word after it, or starts a run of white space), so a text may be
cut before such spaces and each kind of stretch split by the pattern only once a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex


#: Words of more characters are given to `cut`.
CUT = 32


class Splitter:
    """cut: what a long word may be cut into without a change of its ids."""

    def __init__(self, pattern: str, cut: Callable[[str], list[str]] | None = None):
        self.pattern, self.cut = regex.compile(pattern), cut

    def split(self, text: str) -> list[str]:
        words = self.pattern.findall(text)
        if self.cut is None or max(map(len, words), default=0) <= CUT:
            return words
        return [p for w in words for p in (self.cut(w) if len(w) > CUT else [w])]

    def batch(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words of all texts, and `codes` of them."""
        words: dict[str, int] = {}
        codes, bounds = self.codes(texts, words)
        return list(words), codes, bounds

    def codes(self, texts: pa.Array, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words in order, and where each text starts among them (one more entry than texts). words
        holds the codes so far and gets the new ones. Null is the empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        dictionary, kind_of = coded.dictionary, coded.indices.to_numpy()
        del lists, coded
        kinds = dictionary.to_pylist()
        # a stretch that is empty or ends in white space forbids the cut after it
        open_end = np.fromiter((not k or k[-1].isspace() for k in kinds), dtype=bool, count=len(kinds))
        bad = open_end[kind_of]
        bad[offsets[1:] - 1] = False  # nothing follows the last one
        run = np.concatenate(([0], np.cumsum(bad, dtype=np.int32)))
        odd = np.flatnonzero(run[offsets[1:]] > run[offsets[:-1]])  # texts with such a cut
        del bad, run
        find, code = self.split, lambda ws: [words.setdefault(w, len(words)) for w in ws]
        # letters alone are one word with the space before
        plain = pc.utf8_is_alpha(dictionary).to_numpy(zero_copy_only=False)
        flat: list[int] = []
        sizes = np.ones(len(kinds), dtype=np.int32)
        for i, (k, one) in enumerate(zip(kinds, plain.tolist(), strict=True)):
            k = " " + k
            if one and len(k) <= CUT:
                flat.append(words.setdefault(k, len(words)))
            else:
                some = code(find(k))
                flat.extend(some)
                sizes[i] = len(some)
        values = np.array(flat, dtype=np.int32)
        del flat
        first = [code(find(kinds[kind_of[o]])) for o in offsets[:-1].tolist()]  # no space before it
        out, starts = gather(sizes, values, kind_of)
        bounds = starts[offsets]
        heads = starts[offsets[:-1] + 1]
        again = {int(i): code(find(texts[int(i)].as_py())) for i in odd}
        parts: list[np.ndarray] = []
        lengths = np.zeros(n + 1, dtype=np.int64)
        for i, (h, e) in enumerate(zip(heads.tolist(), bounds[1:].tolist(), strict=True)):
            mine = [np.array(again[i], dtype=np.int32)] if i in again else [np.array(first[i], dtype=np.int32), out[h:e]]
            parts += mine
            lengths[i + 1] = sum(map(len, mine))
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32), np.cumsum(lengths)


def gather(lengths: np.ndarray, flat: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of each code (lengths[c] of them, stored joined in flat) one code after another,
    and where each code's entries start (one more entry than codes)."""
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    reps = lengths[codes]
    bounds = np.concatenate(([0], np.cumsum(reps, dtype=np.int64)))
    at = np.repeat(starts[codes] - bounds[:-1], reps)
    at += np.arange(bounds[-1])
    return flat[at], bounds


def bounded(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most `most` bytes of text in column 1 (one row at least)."""
    raw = batch.column(1).cast(pa.large_binary())
    ends = raw.buffers()[1] and np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    if ends is None or not len(raw):
        if batch.num_rows:
            yield batch
        return
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, min(upto, batch.num_rows) - at)
        at = upto
