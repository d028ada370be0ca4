"""Language of texts by a linear-chain conditional random field over their words.

Every word gets a language, since a text may switch. A word speaks for a language by its ending
and beginning, its letter n-grams, and whether a language's lexicon has it; learned transitions say
how languages follow one another, so that words without evidence take the language around them.
The forward-backward algorithm gives each word's probabilities; a text has the language of the
greatest sum of them, and the share of that sum is its score.

The field is fitted to a bounded sample, ``SAMPLE`` rows of each language whose ids hash lowest,
of texts up to ``SAMPLE_BYTES``: to chains of ``CHAIN`` words, half of which switch to a text of
another language midway. Prediction reads whole texts as one chain each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.llm.batches import id_and_text, id_type, map_arrow, slices
from bough.names import col

SAMPLE = 300
SAMPLE_BYTES = 100_000
FOLDS = 5
BUCKETS = 1 << 16
CHAIN = 40
BATCH = 64
STEPS = 500
#: Words that a lexicon holds: those of at least so many rows of the sample, mostly of its language.
LEXICON_ROWS, LEXICON_SHARE = 3, 0.8
#: Bytes of text that are labelled side by side.
SLICE = 8 << 20

_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(listed: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words: themselves, affixes, n-grams, and the lexicon that has them.

    Returns the features of all words one after another, and where each word's begin and end.
    """
    points = np.frombuffer("".join(listed).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, listed), dtype=np.int64, count=len(listed))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    every = np.arange(len(listed))
    known = np.fromiter((lexicon.get(w, -1) for w in listed), dtype=np.int64, count=len(listed))
    whole = np.fromiter((zlib.crc32(w.encode()) for w in listed), dtype=np.uint64, count=len(listed))
    own, found = [every, every[known >= 0]], [_bucket(0, [whole]), _bucket(1, [known[known >= 0].astype(np.uint64)])]
    for n in range(1, 5):
        has = every[sizes >= n]
        if n > 1:
            own.append(has)
            found.append(_bucket(10 + n, [points[starts[has] + i] for i in range(n)]))
        own.append(has)
        found.append(_bucket(20 + n, [points[ends[has] - n + i] for i in range(n)]))
    grams = np.maximum(sizes - 2, 0)
    at = np.arange(grams.sum()) + np.repeat(starts - (np.cumsum(grams) - grams), grams)
    own.append(np.repeat(every, grams))
    found.append(_bucket(30, [points[at + i] for i in range(3)]))
    owner, hashed = np.concatenate(own), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return hashed[order], np.cumsum(np.bincount(owner, minlength=len(listed)))


def _bucket(kind: int, columns: list[np.ndarray]) -> np.ndarray:
    x = np.full(len(columns[0]), kind, dtype=np.uint64)
    for c in columns:
        x = (x ^ c) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    return (x % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, int]
    _rows: dict[str, int] = field(default_factory=dict)
    _scores: np.ndarray | None = None

    def _learn(self, met: set[str]) -> np.ndarray:
        """The scores of all words met so far, ``_rows`` telling which row is whose."""
        new = list(met.difference(self._rows))
        self._rows.update(zip(new, range(len(self._rows), len(self._rows) + len(new))))
        flat, ends = features(new, self.lexicon)
        sums = np.add.reduceat(self.weights[flat], np.concatenate([[0], ends[:-1]])) if new else self.weights[:0]
        known = sums if self._scores is None else np.concatenate([self._scores, sums])
        self._scores = known.astype(np.float32, copy=False)
        return self._scores

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        chains = [words(t) for t in texts]
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self._rows) > 400_000:  # a cache, not a limit
            self._rows, self._scores = {}, None
        # Longest first, so that the chains that go on at a step are the first ones.
        order = sorted((i for i, c in enumerate(chains) if c), key=lambda i: -len(chains[i]))
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not order:
            return out
        sizes = np.array([len(chains[i]) for i in order])
        scores = self._learn(set().union(*chains))
        going = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        starts = np.cumsum([0, *going])
        places = np.empty(starts[-1], dtype=np.int64)
        for rank, i in enumerate(order):
            places[starts[: sizes[rank]] + rank] = list(map(self._rows.__getitem__, chains[i]))
        sums = marginal_sums(scores[places], going, starts, self.transitions)
        best = sums.argmax(axis=1)
        for rank, i in enumerate(order):
            share = float(sums[rank, best[rank]] / sums[rank].sum())
            out[i] = (self.languages[best[rank]], min(max(share, 0.0), 1.0))
        return out


def marginal_sums(scores: np.ndarray, going: np.ndarray, starts: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The sum over each chain of its words' label probabilities.

    ``scores`` holds the words step by step, at every step those of the ``going`` first chains.
    """
    step = np.exp(transitions)
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    forward = np.empty_like(emit)
    scale = np.empty(len(emit))
    alpha = np.ones((going[0], emit.shape[1])) / emit.shape[1]
    for t, n in enumerate(going):
        at = slice(starts[t], starts[t + 1])
        alpha = (alpha[:n] @ step if t else alpha[:n]) * emit[at]
        total = alpha.sum(axis=1)
        alpha /= total[:, None]
        forward[at], scale[at] = alpha, total
    sums = np.zeros((going[0], emit.shape[1]))
    beta = np.ones_like(sums)
    for t in range(len(going) - 1, -1, -1):
        n, at = going[t], slice(starts[t], starts[t + 1])
        if t + 1 < len(going):
            m, after = going[t + 1], slice(starts[t + 1], starts[t + 2])
            beta[:m] = (beta[:m] * emit[after]) @ step.T / scale[after][:, None]
        both = forward[at] * beta[:n]
        sums[:n] += both / both.sum(axis=1, keepdims=True)
    return sums


def chain_gradients(emissions: np.ndarray, labels: np.ndarray, transitions: np.ndarray):
    """Gradients of the log-likelihood of a batch of chains of one length, by forward-backward."""
    b, t, k = emissions.shape
    step, emit = np.exp(transitions), np.exp(emissions - emissions.max(axis=2, keepdims=True))
    alpha, beta, scale = np.empty((b, t, k)), np.ones((b, t, k)), np.empty((b, t))
    for i in range(t):
        now = (alpha[:, i - 1] @ step if i else np.full((b, k), 1 / k)) * emit[:, i]
        scale[:, i] = now.sum(axis=1)
        alpha[:, i] = now / scale[:, i, None]
    for i in range(t - 2, -1, -1):
        beta[:, i] = (beta[:, i + 1] * emit[:, i + 1]) @ step.T / scale[:, i + 1, None]
    marginals = alpha * beta
    own = np.eye(k)[labels]
    pairs = np.einsum("bti,btj->ij", alpha[:, :-1], beta[:, 1:] * emit[:, 1:] / scale[:, 1:, None]) * step
    seen = np.einsum("bti,btj->ij", own[:, :-1], own[:, 1:])
    return own - marginals, seen - pairs


def train(texts: list[str], langs: list[str]) -> LanguageModel:
    """A field fitted to whole texts that are each of one language."""
    languages = sorted(set(langs))
    k = len(languages)
    chains = [(words(t), languages.index(x)) for t, x in zip(texts, langs)]
    chains = [(c, x) for c, x in chains if c]
    rows = [Counter() for _ in languages]
    for chain, x in chains:
        rows[x].update(set(chain))
    lexicon: dict[str, int] = {}
    sizes = [max(1, sum(x == i for _, x in chains)) for i in range(k)]
    for x in range(k):
        for word, n in rows[x].items():
            shares = [rows[i][word] / sizes[i] for i in range(k)]
            if n >= LEXICON_ROWS and shares[x] >= LEXICON_SHARE * sum(shares):
                lexicon[word] = x
    weights, transitions = np.zeros((BUCKETS, k), dtype=np.float64), np.zeros((k, k))
    if k < 2 or not chains:
        return LanguageModel(languages if chains else [], weights, transitions, lexicon)

    rng = np.random.default_rng(7)
    by_language = [[c for c, x in chains if x == i] for i in range(k)]
    present = [i for i in range(k) if by_language[i]]
    numbers = {w: i for i, w in enumerate(sorted({w for c, _ in chains for w in c}))}
    by_language = [[np.array([numbers[w] for w in c]) for c in own] for own in by_language]
    hashed, ends = features(list(numbers), lexicon)
    begins = np.concatenate([[0], ends[:-1]])

    def piece(x: int, n: int) -> list[np.ndarray]:
        own: list[np.ndarray] = []
        while n > 0:
            chain = by_language[x][rng.integers(len(by_language[x]))]
            at = rng.integers(max(1, len(chain) - n))
            own.append(chain[at : at + n])
            n -= len(own[-1])
        return own

    squares, steps_squared = np.full(BUCKETS, 1e-6), np.full((k, k), 1e-6)
    for _ in range(STEPS):
        batch, labels = [], np.zeros((BATCH, CHAIN), dtype=np.int64)
        for row in range(BATCH):
            a, b = rng.choice(present), rng.choice(present)
            cut = CHAIN if row % 2 else int(rng.integers(1, CHAIN))
            batch += piece(a, cut) + piece(b, CHAIN - cut)
            labels[row, :cut], labels[row, cut:] = a, b
        ids = np.concatenate(batch)
        many = ends[ids] - begins[ids]
        owner = np.repeat(np.arange(len(ids)), many)
        flat = hashed[np.arange(many.sum()) + np.repeat(begins[ids] - (np.cumsum(many) - many), many)]
        emissions = np.add.reduceat(weights[flat], np.cumsum(many) - many)
        up, move = chain_gradients(emissions.reshape(BATCH, CHAIN, k), labels, transitions)
        gradient = np.zeros_like(weights)
        np.add.at(gradient, flat, up.reshape(-1, k)[owner])
        touched = np.unique(flat)
        squares[touched] += (gradient[touched] ** 2).sum(axis=1)
        weights[touched] += 0.3 * gradient[touched] / np.sqrt(squares[touched])[:, None] - 1e-4 * weights[touched]
        steps_squared += move**2
        transitions += 0.3 * move / np.sqrt(steps_squared)
    return LanguageModel(languages, weights.astype(np.float32), transitions, lexicon)


def fit_language(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> LanguageModel:
    """A model from rows with a language whose id as text has no crc32 that five divides.

    Rows without an id, text or language teach nothing; without any such row every prediction is
    ``und``.
    """
    rows = df.select(col(id_col).alias("id"), col(text_col).alias("text"), col(lang_col).alias("lang"))
    rows = rows.where("id is not null and lang is not null")
    rows = rows.where((F.octet_length("text") <= SAMPLE_BYTES) & (F.crc32(F.col("id").cast("string")) % FOLDS != 0))
    # The rank is limited in every task before rows of one language meet.
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("id").cast("string")), "id")
    chosen = rows.select("id", "lang").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE)
    sample = rows.join(F.broadcast(chosen.select("id", "lang").distinct()), ["id", "lang"]).collect()
    sample.sort(key=lambda r: (str(r["id"]), r["lang"], r["text"]))
    return train([r["text"] for r in sample], [r["lang"] for r in sample])


def languages(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` of every row.

    A text that is null or has no letter is ``und`` with score 0. Equal texts get the same answer,
    an empty table gives no rows, and other columns are neither read nor returned.
    """
    source = id_and_text(df, id_col, text_col)
    schema = T.StructType(
        [
            T.StructField(id_col, id_type(source)),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    held = df.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for piece in slices(batches, most=SLICE):
            found = held.value.predict(piece.column("text").to_pylist())
            langs, scores = zip(*found)
            yield {id_col: piece.column("id"), "lang_pred": list(langs), "score": list(scores)}

    return map_arrow(source, work, schema)
