"""Language ID by interpolated Kneser-Ney character models.

Each word (a run of letters, lower-cased) is a string of its own between start and end
marks. `train` counts n-grams of every language on a bounded sample, smooths them
(interpolated Kneser-Ney, one discount an order; n-grams that begin at a start mark count how often they occur, the
others of lower orders how many characters stand before them) and stores, for each order, one sorted array of
n-gram hashes with a column of log probabilities a language, and a column of
back-off weights a language for the n-grams that are contexts. A language's score for a text is its
cross-entropy a character; the lowest wins.

Bound (documented parameters): about `sample_docs` documents a language, by a hash of their id, and of
their words of at most SAMPLE_WORD letters the `sample_words` most frequent a language. Prediction reads every whole text.

Rejection is calibrated on documents of the sample that the models have not
seen and that have `least_chars` characters to score, as shorter ones say little of the language: a language's limit is the
`tail` quantile of the cross-entropies of its own documents plus `slack` nats. Documents above the limit of the language chosen, and
documents without a letter, are marked rejected.

The score is the chosen language's share of the likelihoods of a text of the same cross-entropies and SCORED characters at
most; without that bound it would be 1 for any text of some length.

Defined results
  null text, empty text, no letter   lang_pred und, score 0, rejected
  null doc_id          predicted like any other; not in the sample
  null lang            not in the sample
  repeated rows        each predicted; in the sample they count twice
  ties                 the alphabetically first language
  no labelled row      und, score 0, rejected for all
  extra columns        ignored by `predict`, kept by `keep_known`
  very long texts      whole
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.llm.pieces import bounded
from corpuslab.llm.shared import arrow_stage, materialise

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
START, END = 2, 3
#: Longest word that models learn from; with the number of words it bounds the sample.
SAMPLE_WORD = 1000
#: Words that are scored at once.
WORDS = 20_000
#: Characters that the score takes a text to have at most.
SCORED = 50
PRIME = np.uint64(0x9E3779B97F4A7C15)


def _marked(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, each after order - 1 start marks and before an end mark;
    the positions to be scored, and the word of each."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    total = lengths + order
    starts = np.cumsum(total) - total
    out = np.full(int(total.sum()), START, dtype=np.uint64)
    word = np.repeat(np.arange(len(words)), lengths + 1)
    scored = np.arange(len(word)) + (word + 1) * (order - 1)
    out[starts + total - 1] = END
    letters = np.ones(len(word), dtype=bool)
    letters[np.cumsum(lengths + 1) - 1] = False
    out[scored[letters]] = points
    return out, scored, word


def _hashes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """hashes[k][i]: of the k points that end at i."""
    mixed = (points + np.uint64(1)) * PRIME
    mixed ^= mixed >> np.uint64(29)
    out = [np.zeros(len(points), dtype=np.uint64)]
    for k in range(1, order + 1):
        before = np.zeros_like(mixed)
        before[1:] = out[k - 1][:-1]
        h = (before * np.uint64(0xD6E8FEB86659FD93)) ^ mixed
        h *= np.uint64(0xFF51AFD7ED558CCD)
        out.append(h ^ (h >> np.uint64(32)))
    return out


@dataclass
class Model:
    langs: list[str]
    order: int
    floor: float = 0.0  # log probability of each character of an alphabet that holds twice as many and more, known or not
    unseen: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log weight of that alphabet by language
    keys: list[np.ndarray] = field(default_factory=list)  # [k]: sorted hashes of k-grams
    logp: list[np.ndarray] = field(default_factory=list)  # [k]: rows of keys[k], columns of langs
    back: list[np.ndarray] = field(default_factory=list)  # [k]: log back-off weight of a k-gram as context
    limit: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def find(self, k: int, h: np.ndarray) -> np.ndarray:
        keys = self.keys[k]
        if not len(keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, at, -1)

    def steps(self, points: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """Log probability, by language, of the character at each place of `scored` after those before it."""
        h = _hashes(points, self.order)
        out = np.zeros((len(scored), len(self.langs)))
        open_ = np.arange(len(scored))
        for k in range(self.order, 0, -1):
            at = self.find(k, h[k][scored[open_]])
            out[open_[at >= 0]] += self.logp[k][at[at >= 0]]
            open_ = open_[at < 0]
            if k > 1 and len(open_):  # weight of the context that is left
                ctx = self.find(k - 1, h[k - 1][scored[open_] - 1])
                out[open_[ctx >= 0]] += self.back[k - 1][ctx[ctx >= 0]]
        out[open_] += self.unseen + self.floor
        return out

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word: log probability by language, and characters scored."""
        if not words:
            return np.zeros((0, len(self.langs))), np.zeros(0)
        points, scored, word = _marked(words, self.order)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(word)) + 1))
        return np.add.reduceat(self.steps(points, scored), cuts, axis=0), np.bincount(word, minlength=len(words)).astype(float)


def train(counts: list[tuple[str, str, int]], order: int = 4) -> Model:
    """counts: (lang, word, n), one row a language and word."""
    langs = sorted({c[0] for c in counts})
    model, n_langs = Model(langs, order), len(langs)
    grams: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(order + 1)]  # by order, by language
    for lang in langs:
        rows = [(w, n) for x, w, n in counts if x == lang]
        points, scored, word = _marked([w for w, _ in rows], order)
        h, weight = _hashes(points, order), np.array([n for _, n in rows], dtype=float)[word]
        for k in range(1, order + 1):
            key, first, inverse = np.unique(h[k][scored], return_index=True, return_inverse=True)
            at = scored[first]
            grams[k].append((key, np.bincount(inverse, weights=weight), h[k - 1][at - 1] if k > 1 else np.zeros_like(key), h[k - 1][at], points[at - k + 1] == START))
    model.keys = [np.zeros(0, np.uint64)] + [np.unique(np.concatenate([g[0] for g in grams[k]])) for k in range(1, order + 1)]
    # contexts hold start marks too, which are never scored, so they get rows of their own
    for k in range(1, order):
        model.keys[k] = np.unique(np.concatenate([model.keys[k], *[g[2] for g in grams[k + 1]]]))
    model.floor = -np.log(max(2.0, 4.0 * max(len(g[0]) for g in grams[1])))
    model.unseen = np.zeros(n_langs)
    prob = [None] + [np.zeros((len(model.keys[k]), n_langs)) for k in range(1, order + 1)]
    model.back = [np.zeros((len(k), n_langs)) for k in model.keys]
    for i in range(n_langs):
        for k in range(1, order + 1):
            key, raw, context, suffix, first = grams[k][i]
            count = raw
            if k < order:  # continuation counts: distinct characters before the gram
                longer = grams[k + 1][i]
                left, times = np.unique(longer[3], return_counts=True)
                pos = np.searchsorted(left, key)
                pos = np.minimum(pos, len(left) - 1)
                count = np.where(first, raw, np.where(left[pos] == key, times[pos], 1)).astype(float)
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            ctx, inverse = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(inverse, weights=count), np.bincount(inverse)
            lam = discount * kinds / total
            if k == 1:
                lower = np.exp(model.floor)
                rest = np.full(len(model.keys[1]), lam[0] * lower)
                model.unseen[i] = np.log(lam[0])
            else:
                at = np.searchsorted(model.keys[k - 1], ctx)
                weight = np.ones(len(model.keys[k - 1]))
                weight[at] = lam
                model.back[k - 1][:, i] = np.log(weight)
                rest = None
            own = np.zeros(len(model.keys[k]))
            own[np.searchsorted(model.keys[k], key)] = np.maximum(count - discount, 0) / total[inverse]
            prob[k][:, i] = own if rest is None else own + rest
    # interpolate upwards; context and suffix of a gram are the same in every language
    for k in range(2, order + 1):
        allk = [np.concatenate([g[j] for g in grams[k]]) for j in (0, 2, 3)]
        _, first = np.unique(allk[0], return_index=True)
        key, context, suffix = (x[first] for x in allk)
        row = np.searchsorted(model.keys[k], key)
        c = np.searchsorted(model.keys[k - 1], context)
        s = np.minimum(np.searchsorted(model.keys[k - 1], suffix), len(model.keys[k - 1]) - 1)
        prob[k][row] += np.exp(model.back[k - 1][c]) * prob[k - 1][s]
    # rows that are contexts only are never scored: a gram of start marks cannot end at a character
    model.logp = [np.zeros((0, n_langs))] + [np.log(np.maximum(prob[k], np.exp(model.floor) * 1e-3)) for k in range(1, order + 1)]
    return model


def entropies(model: Model, texts: pa.Array, most: int = 3 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy a character by language (rows: texts), and characters scored; in slices of
    about `most` bytes, which bound memory."""
    parts = [_entropies(model, part.column(1)) for part in bounded(pa.RecordBatch.from_arrays([texts, texts], names=["a", "b"]), most)]
    if not parts:
        return np.zeros((0, len(model.langs))), np.zeros(0)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _entropies(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pieces between spaces are looked up once each, however often a slice holds them."""
    pieces = pc.split_pattern(pc.fill_null(pc.utf8_lower(texts.cast(pa.large_string())), ""), " ")
    offsets = pieces.offsets.to_numpy()
    coded = pieces.flatten().dictionary_encode()
    kinds = coded.dictionary.to_pylist()
    found = [LETTERS.findall(x) for x in kinds]
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    words = [w for f in found for w in f]
    parts = [model.words(words[i : i + WORDS]) for i in range(0, max(len(words), 1), WORDS)]
    score, chars = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    del words, parts
    owner = np.repeat(np.arange(len(kinds)), sizes)
    n = len(kinds)
    by_kind = np.stack([*(np.bincount(owner, weights=score[:, i], minlength=n) for i in range(len(model.langs))), np.bincount(owner, weights=chars, minlength=n)], axis=1)
    codes = coded.indices.to_numpy()
    del pieces, coded, kinds, found
    total = np.zeros((len(texts), by_kind.shape[1]))
    for i in range(by_kind.shape[1]):  # a column at a time bounds memory
        run = np.concatenate(([0.0], np.cumsum(by_kind[codes, i])))
        total[:, i] = run[offsets[1:] - offsets[0]] - run[offsets[:-1] - offsets[0]]
    chars = np.round(total[:, -1])
    return -total[:, :-1] / np.maximum(chars, 1)[:, None], chars


def _sample(labelled: DataFrame, sample_docs: int, sample_words: int) -> tuple[list, DataFrame]:
    """Word counts of the sample, and rows to calibrate on. A language's documents are taken by the
    hash of their id: about sample_docs of them, and the rest is never collected."""
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    share = labelled.sparkSession.createDataFrame([(x, min(1.0, sample_docs / n)) for x, n in sizes.items()] or [("", 0.0)], "lang string, share double")
    mark = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.join(F.broadcast(share), "lang").filter(mark < F.col("share")).withColumn("mark", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(10)))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in LETTERS.findall((text or "").lower()):
                    if len(w) <= SAMPLE_WORD:
                        seen[lang, w] = seen.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    counted = arrow_stage(sample.filter("mark > 0").select("lang", "text"), words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "words")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))  # of distinct words, cut short before the shuffle
    top = counted.withColumn("rank", rank).filter(F.col("rank") <= sample_words).select("lang", "word", "n").collect()
    return [tuple(r) for r in sorted(top, key=lambda r: (r["lang"], -r["n"], r["word"]))], sample.filter("mark = 0").select("lang", "text")


def fit(labelled: DataFrame, order: int = 4, sample_docs: int = 600, sample_words: int = 60_000, tail: float = 0.999, slack: float = 1.0, least_chars: int = 100) -> Model | None:
    """labelled(doc_id, text, lang), lang non-null. None if there is no word to learn from."""
    counts, held = _sample(labelled, sample_docs, sample_words)
    if not counts:
        return None
    model = train(counts, order)
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                ent, chars = entropies(m, batch.column(1))
                true = batch.column(0).to_pylist()
                own = [ent[i, m.langs.index(x)] if x in m.langs and chars[i] >= least_chars else None for i, x in enumerate(true)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.float64())], names=["lang", "own"])

    rows = arrow_stage(held, run, "lang string, own double").filter("own is not null").collect()  # a tenth of the sample
    model.limit = np.full(len(model.langs), np.inf)
    if rows:
        overall = np.quantile([r["own"] for r in rows], tail)
        for i, lang in enumerate(model.langs):
            mine = [r["own"] for r in rows if r["lang"] == lang]
            model.limit[i] = (max(overall, np.quantile(mine, tail)) if mine else overall) + slack
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (posterior of the best language by cross-entropies a
    character, sharpened by length), entropy, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            pred, score, entropy, rejected = [UNKNOWN] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, dtype=bool)
            if m is not None and n:
                ent, chars = entropies(m, batch.column(1))
                best = ent.argmin(axis=1)
                low = ent[np.arange(n), best]
                some = chars > 0
                pred = np.where(some, np.array(m.langs, dtype=object)[best], UNKNOWN).tolist()
                odds = np.exp(-(ent - low[:, None]) * np.minimum(chars, SCORED)[:, None])
                score = np.where(some, 1 / odds.sum(axis=1), 0.0)
                entropy = np.where(some, low, np.nan)
                rejected = ~some | ((low > m.limit[best]) & some)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return arrow_stage(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, **fit_args) -> DataFrame:
    """Learn from the labelled documents that are not held out and predict all."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    return predict(docs, fit(labelled, **fit_args)).withColumn("held_out", held_out())


def keep_known(docs: DataFrame, **fit_args) -> DataFrame:
    """The documents that are not rejected, with all their columns. The mark is made beside the rows, so no row is shuffled."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    model = fit(labelled, **fit_args)
    if model is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ent, chars = entropies(m, batch.column(at))
            best = ent.argmin(axis=1)
            low = ent[np.arange(len(ent)), best]
            yield batch.filter(pa.array((chars > 0) & (low <= m.limit[best])))

    return arrow_stage(docs, run, docs.schema)
