"""Toxicity scores by weak supervision.

Many simple voters look at a text: lexicons of whole words, beginnings and endings of words, mined
from labelled rows, a fixed list of common insults, and patterns such as shouting, density of hits
or the absence of any. Each says toxic, clean or nothing. A generative model with the hidden label
as its root explains their votes: it estimates by expectation maximization how each voter votes
given the label, and which voters depend on one another beyond it (a tree over the voters with the
greatest mutual information given the label), so that voters that copy one another do not count
twice. Human labels take part as one more voter. The model's posteriors are the labels on which a
linear classifier of the words and word parts of a text is trained.

Fitting uses a bounded sample: ``LABELLED`` labelled rows of either class and ``UNLABELLED`` others,
those whose ids hash lowest, of texts up to ``SAMPLE_BYTES`` each. Scoring reads whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.llm.batches import give_back, id_and_text, id_type, map_arrow, slices
from bough.names import col

LABELLED = 2_500
UNLABELLED = 1_500
SAMPLE_BYTES = 100_000
#: Share of rows that are never learnt from.
FOLDS = 5

ABSTAIN, TOXIC, CLEAN = 0, 1, 2
#: Insults that most lists of abusive English hold.
INSULTS = (
    "asshole bastard bitch clown coward creep disgusting dumb dumbass fool freak garbage idiot idiotic imbecile "
    "jerk liar loser moron moronic pathetic pig psycho scum scumbag shit slut stupid trash ugly vermin whore worthless"
).split()
_INSULTS = frozenset(INSULTS)
PREFIXES, SUFFIXES = (3, 4, 5, 6), (4, 6)
_WORD = re.compile(r"\w+")
_SHOUT = re.compile(r"\b[^\W\d_a-z]{3,}!{1,}")
#: How purely a term of a lexicon or the classifier occurs in toxic rows, and how much more often, as
#: twice the log of the likelihood ratio: so high that hardly any of the many terms of a sample gets
#: there by chance.
PURITY, SIGNIFICANT = 0.98, 20.0
#: What pulls the classifier's weights towards zero.
SPARSE = 3e-4


def held_out(id_: Column) -> Column:
    """Rows that are never learnt from: those whose id as text has a crc32 that five divides."""
    return F.crc32(id_.cast("string")) % FOLDS == 0


def distinct_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def parts(word: str) -> list[tuple[str, str]]:
    """A word and its beginnings and endings, each with its kind."""
    found = [("word", word)]
    if word in _INSULTS:
        found.append(("insult", "any"))
    found += [(f"start{n}", word[:n]) for n in PREFIXES if len(word) > n]
    found += [(f"end{n}", word[-n:]) for n in SUFFIXES if len(word) > n]
    return found


@dataclass
class Voters:
    """Lexicons by kind; what they and the patterns say of a text."""

    lexicons: dict[str, set[str]]

    @property
    def names(self) -> list[str]:
        return ["insults", *self.lexicons, "several", "dense", "shouting", "quiet", "long and quiet"]

    def votes(self, text: str) -> list[int]:
        words = distinct_words(text)
        insults = words & _INSULTS
        hits = {kind: set() for kind in self.lexicons}
        for word in words:
            for kind, part in parts(word):
                if part in self.lexicons.get(kind, ()):
                    hits[kind].add(word)
        hit = insults.union(*hits.values())
        share = len(hit) / max(1, len(words))
        quiet = CLEAN if not hit else ABSTAIN
        return [
            TOXIC if insults else ABSTAIN,
            *(TOXIC if hits[kind] else ABSTAIN for kind in self.lexicons),
            TOXIC if len(hit) > 1 else ABSTAIN,
            TOXIC if share > 0.02 else ABSTAIN,
            TOXIC if hit and _SHOUT.search(text) else ABSTAIN,
            quiet,
            quiet if len(words) > 100 else ABSTAIN,
        ]


class Terms:
    """The words of texts and their parts, numbered; each text as its distinct term numbers.

    Every term is held as short as it can be, since the driver holds those of the whole sample.
    """

    def __init__(self, texts: list[str]):
        numbers: dict[str, dict[str, int]] = {}
        known: dict[str, bytes] = {}
        self.kinds: list[str] = []
        self.parts: list[str] = []
        self.rows: list[np.ndarray] = []
        for text in texts:
            words = sorted(distinct_words(text))
            for word in words:
                if word not in known:
                    own = []
                    for kind, part in parts(word):
                        number = numbers.setdefault(kind, {}).setdefault(part, len(self.parts))
                        if number == len(self.parts):
                            self.kinds.append(kind)
                            self.parts.append(part)
                        own.append(number)
                    known[word] = np.array(own, dtype=np.int32).tobytes()
            self.rows.append(np.unique(np.frombuffer(b"".join(map(known.__getitem__, words)), dtype=np.int32)))

    def counts(self, weights: np.ndarray) -> np.ndarray:
        """The sum over texts that have a term of the texts' weights."""
        out = np.zeros(len(self.parts))
        for row, weight in zip(self.rows, weights.tolist()):
            if weight:
                out[row] += weight
        return out


def mine(terms: Terms, marked: np.ndarray, labels: np.ndarray) -> Voters:
    """Lexicons of terms that occur in toxic rows and hardly in clean ones."""
    lexicons: dict[str, set[str]] = {
        kind: set() for kind in ("word", *(f"start{n}" for n in PREFIXES), *(f"end{n}" for n in SUFFIXES))
    }
    one, nought = marked & (labels == 1), marked & (labels == 0)
    toxic, clean = terms.counts(one.astype(float)), terms.counts(nought.astype(float))
    n1, n0 = max(1, int(one.sum())), max(1, int(nought.sum()))
    p1, p0 = toxic / n1, clean / n0
    for i in np.flatnonzero((p1 >= PURITY * (p1 + p0)) & (excess(toxic, clean, n1, n0) >= SIGNIFICANT)):
        kind, part = terms.kinds[i], terms.parts[i]
        if kind in lexicons:
            lexicons[kind].add(part)
    return Voters(lexicons)


def excess(toxic: np.ndarray, clean: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Twice the log-likelihood ratio of terms that are more frequent in toxic rows, else 0."""
    p = (toxic + clean) / (n1 + n0)
    out = np.zeros(len(p))
    for seen, expected in (
        (toxic, n1 * p), (n1 - toxic, n1 * (1 - p)), (clean, n0 * p), (n0 - clean, n0 * (1 - p))
    ):
        some = (seen > 0) & (expected > 0)
        out[some] += 2 * seen[some] * np.log(seen[some] / expected[some])
    return np.where(toxic * n0 > clean * n1, out, 0.0)


class LabelModel:
    """A hidden label and a tree of voters under it, fitted by expectation maximization."""

    def __init__(self, rounds: int = 2, steps: int = 25, least_information: float = 0.005):
        self.rounds, self.steps, self.least = rounds, steps, least_information

    def fit(self, votes: np.ndarray) -> np.ndarray:
        """``votes`` holds a row for each text and a column for each voter. Returns the posterior
        of the label toxic; ``accuracies`` and ``parents`` say what was found."""
        n, m = votes.shape
        toxic, clean = (votes == TOXIC).sum(1), (votes == CLEAN).sum(1)
        q = np.clip(0.5 + 0.4 * np.sign(toxic - clean), 0.1, 0.9)
        self.parents = [-1] * m
        for _ in range(self.rounds):
            for _ in range(self.steps):
                q = self._posterior(votes, self._tables(votes, q), q.mean())
            self.parents = self._tree(votes, q)
        for _ in range(self.steps):
            q = self._posterior(votes, self._tables(votes, q), q.mean())
        weights = np.stack([1 - q, q])
        self.accuracies = []
        for j in range(m):
            right = weights[1][votes[:, j] == TOXIC].sum() + weights[0][votes[:, j] == CLEAN].sum()
            self.accuracies.append(float((right + 1) / ((votes[:, j] != ABSTAIN).sum() + 2)))
        return q

    def _tables(self, votes: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
        """P(vote | label, parent's vote) of every voter, smoothed."""
        tables = []
        for j, parent in enumerate(self.parents):
            given = votes[:, parent] if parent >= 0 else np.zeros(len(votes), dtype=np.int64)
            table = np.full((2, 3, 3), 0.1)
            for label, weight in enumerate((1 - q, q)):
                np.add.at(table[label], (given, votes[:, j]), weight)
            tables.append(table / table.sum(axis=2, keepdims=True))
        return tables

    def _posterior(self, votes: np.ndarray, tables: list[np.ndarray], prior: float) -> np.ndarray:
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        log = np.tile(np.log([1 - prior, prior]), (len(votes), 1))
        for j, (parent, table) in enumerate(zip(self.parents, tables)):
            given = votes[:, parent] if parent >= 0 else 0
            for label in (0, 1):
                log[:, label] += np.log(table[label][given, votes[:, j]])
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))

    def _tree(self, votes: np.ndarray, q: np.ndarray) -> list[int]:
        """Each voter's parent: the spanning forest of the greatest information given the label."""
        m = votes.shape[1]
        edges = []
        for i in range(m):
            for j in range(i + 1, m):
                gain = 0.0
                for weight in (1 - q, q):
                    joint = np.full((3, 3), 1e-9)
                    np.add.at(joint, (votes[:, i], votes[:, j]), weight)
                    joint /= len(votes)
                    rows, columns = joint.sum(1, keepdims=True), joint.sum(0, keepdims=True)
                    gain += float((joint * np.log(joint * joint.sum() / (rows * columns))).sum())
                if gain > self.least:
                    edges.append((gain, i, j))
        tree = {i: {i} for i in range(m)}
        near: dict[int, list[int]] = {i: [] for i in range(m)}
        for _, i, j in sorted(edges, reverse=True):
            if tree[i] is not tree[j]:
                tree[i] |= tree[j]
                for x in tree[j]:
                    tree[x] = tree[i]
                near[i].append(j)
                near[j].append(i)
        parents = [-1] * m
        seen: set[int] = set()
        for root in range(m):
            stack = [] if root in seen else [root]
            seen.add(root)
            while stack:
                i = stack.pop()
                for j in near[i]:
                    if j not in seen:
                        seen.add(j)
                        parents[j] = i
                        stack.append(j)
        return parents


@dataclass
class ToxicityModel:
    """A linear classifier over the distinct words of a text and their parts."""

    weights: dict[str, float]
    bias: float
    accuracies: dict[str, float]
    parents: dict[str, str | None]

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f"{kind}:{part}", 0.0) for kind, part in parts(word))

    def scores(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        """``known`` remembers the weights of words from call to call."""
        sums = np.empty(len(texts))
        for i, text in enumerate(texts):
            words = distinct_words(text)
            for word in words.difference(known):
                known[word] = self.word_weight(word)
            # Summed in one order, whatever the order of the set.
            sums[i] = self.bias + sum(sorted(x for x in map(known.__getitem__, words) if x))
            if len(known) > 500_000:  # a cache, not a limit
                known.clear()
        return 1 / (1 + np.exp(-np.clip(sums, -500, 500)))


def train(texts: list[str], labels: list[int | None]) -> ToxicityModel:
    """A model from texts of which some are labelled 1 or 0 and the others None."""
    marked = np.array([x is not None for x in labels], dtype=bool)
    given = np.array([0 if x is None else int(x) for x in labels], dtype=np.int64)
    terms = Terms(texts)
    give_back()  # the tables by which terms were numbered
    voters = mine(terms, marked, given)
    votes = np.array([voters.votes(t) for t in texts], dtype=np.int64).reshape(len(texts), len(voters.names))
    human = np.where(marked, np.where(given == 1, TOXIC, CLEAN), ABSTAIN)
    names = [*voters.names, "labels"]
    if not len(texts):
        return ToxicityModel({}, -4.0, {}, {})
    # People vote three times, so that the hidden classes are the ones they mean.
    model = LabelModel()
    posterior = model.fit(np.column_stack([votes, human, human, human]))
    # Where all voters together overturn a person, neither teaches the classifier anything.
    posterior = np.where(marked & (np.abs(posterior - given) > 0.99), 0.5, posterior)
    weights, bias = _linear(terms, posterior)
    keep = range(len(names))
    return ToxicityModel(
        weights, bias,
        {names[j]: model.accuracies[j] for j in keep},
        {names[j]: names[min(model.parents[j], len(names) - 1)] if model.parents[j] >= 0 else None for j in keep},
    )


def _linear(terms: Terms, target: np.ndarray, steps: int = 300, rate: float = 0.5) -> tuple[dict, float]:
    """Logistic regression on soft labels over the terms that set the classes apart."""
    n, n1 = len(target), float(target.sum())
    n0 = n - n1
    toxic = terms.counts(target)
    clean = terms.counts(np.ones(n)) - toxic
    p1, p0 = toxic / max(n1, 1), clean / max(n0, 1)
    chosen = np.flatnonzero((p1 >= PURITY * (p1 + p0)) & (excess(toxic, clean, n1, n0) >= SIGNIFICANT))
    chosen = sorted(chosen.tolist(), key=lambda i: (terms.kinds[i], terms.parts[i]))
    index = {f"{terms.kinds[i]}:{terms.parts[i]}": k for k, i in enumerate(chosen)}
    place = np.full(len(terms.parts), -1)
    place[chosen] = np.arange(len(chosen))
    kept = [place[row][place[row] >= 0] for row in terms.rows]
    at = np.repeat(np.arange(n), [len(x) for x in kept])
    term = np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64)
    w, bias = np.zeros(len(index)), float(np.log((n1 + 1) / (n0 + 1)))
    # Adam on the mean loss of classes that weigh the same.
    balance = np.where(target > 0.5, 0.5 / max(n1, 1), 0.5 / max(n0, 1))
    state = np.zeros((2, len(w) + 1))
    for step in range(1, steps + 1):
        z = bias + np.bincount(at, weights=w[term], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) * balance
        gradient = np.append(np.bincount(term, weights=error[at], minlength=len(w)) + SPARSE, error.sum())
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient**2
        move = rate / step**0.5 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        # The terms were chosen because they speak for toxic, so none gets a weight against it.
        w, bias = np.maximum(w - move[:-1], 0), bias - move[-1]
    return {t: float(w[i]) for t, i in index.items()}, float(bias)


def fit_toxicity(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """A model from the labelled rows of ``df`` that are not held out, and others without labels.

    Rows without an id or text are not learnt from, a null label is none, and an id with labels of
    both kinds is left out. Without labels every text scores low.
    """
    texts = df.select(col(id_col).alias("id"), col(text_col).alias("text"))
    texts = texts.where((F.octet_length("text") <= SAMPLE_BYTES) & ~held_out(F.col("id")))
    known = (
        labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("label"))
        .where("id is not null and label in (0, 1)")
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
    )
    order = F.xxhash64(F.col("id").cast("string")), F.col("id")
    ids = texts.select("id").distinct()
    marked = ids.join(known.where("label = other").drop("other"), "id")
    # Three bounded lists of ids: a task keeps so many at most, and so does the driver.
    chosen = [marked.where(F.col("label") == x).orderBy(*order).limit(LABELLED) for x in (0, 1)]
    others = ids.join(known, "id", "left_anti").orderBy(*order).limit(UNLABELLED)
    sample = chosen[0].union(chosen[1]).union(others.select("id", F.lit(None).cast("int").alias("label")))
    rows = texts.join(F.broadcast(sample), "id").dropDuplicates(["id"]).collect()
    rows.sort(key=lambda r: (str(r["id"]), r["text"]))
    held, marks = [r["text"] for r in rows], [r["label"] for r in rows]
    rows.clear()
    model = train(held, marks)
    held.clear()
    give_back()  # the driver outlives its models
    return model


def toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every row; a null text scores as an empty one. Equal
    texts score the same, an empty table gives no rows, other columns are left out."""
    source = id_and_text(df, id_col, text_col)
    schema = T.StructType([T.StructField(id_col, id_type(source)), T.StructField("score", T.DoubleType())])
    held = df.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        known: dict[str, float] = {}
        for piece in slices(batches):
            yield {id_col: piece.column("id"), "score": held.value.scores(piece.column("text").to_pylist(), known)}

    return map_arrow(source, work, schema)


def score_of(text: Column | str, model: ToxicityModel) -> Column:
    """The score of a column of texts, to filter rows by."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in batches:
            yield pd.Series(model.scores([t or "" for t in texts], known))
        known.clear()
        give_back()

    return score(text)
