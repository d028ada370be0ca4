"""Language, toxicity and main text: accuracy on rows that were not learnt from, and edges."""

import random
import tracemalloc
import zlib

import numpy as np
import pytest

from bough.llm import language, main_text, toxicity
from bough.llm.html_blocks import leaf_blocks

FOLDER = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


# ---- language -----------------------------------------------------------------------------------


def documents(spark, rows):
    return spark.createDataFrame(
        [(i, t, x, "q", 0.5) for i, t, x in rows], "doc_id long, text string, lang string, lang_pred string, score double"
    )


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_held_out_languages(spark, corpus):
    model = language.fit_language(corpus)
    got = {r.doc_id: r for r in language.languages(corpus, model).collect()}
    rows = [r for r in corpus.collect() if held(r.doc_id) and r.lang and len(r.text or "") > 40]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in rows)
    assert right >= 0.97 * len(rows) and len(rows) > 100
    # Transitions were learnt: a language is likelier to go on than to change.
    assert (np.diag(model.transitions)[:, None] >= model.transitions).all()


def test_language_edges(spark):
    rows = [(i, "alpha beta gamma delta " * 5, "aa") for i in range(1, 30)] + [(i + 50, "uno dos tres cuatro " * 5, "bb") for i in range(30)]
    odd = [(900, None, "aa"), (901, "123 !! ...", None), (902, "Alpha BETA", None), (None, "dos tres", "aa"), (900, "tres", None)]
    docs = documents(spark, rows + odd)
    model = language.fit_language(docs)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.languages(docs, model).collect()]
    assert len(got) == len(rows) + len(odd)
    assert (900, "und", 0.0) in got and (901, "und", 0.0) in got
    assert ("aa" in [x for i, x, _ in got if i == 902]) and ["bb"] == [x for i, x, _ in got if i is None]
    assert all(0 <= s <= 1 for _, _, s in got)
    nothing = language.fit_language(docs.where("lang is null"))
    assert {r.lang_pred for r in language.languages(docs, nothing).collect()} == {"und"}
    assert language.languages(docs.limit(0), model).count() == 0


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(1)
    k, t = 3, 4
    scores, moves = rng.normal(size=(t, k)), rng.normal(size=(k, k))
    paths = np.array(np.meshgrid(*[range(k)] * t)).reshape(t, -1)
    weight = np.exp(sum(scores[i, paths[i]] for i in range(t)) + sum(moves[paths[i], paths[i + 1]] for i in range(t - 1)))
    want = sum(np.bincount(paths[i], weights=weight, minlength=k) for i in range(t)) / weight.sum()
    going, starts = np.ones(t, dtype=int), np.arange(t + 1)
    assert np.allclose(language.marginal_sums(scores, going, starts, moves)[0], want)
    labels = rng.integers(0, k, (1, t))

    def likelihood(s, m):
        own = sum(s[i, labels[0, i]] for i in range(t)) + sum(m[labels[0, i], labels[0, i + 1]] for i in range(t - 1))
        every = np.exp(sum(s[i, paths[i]] for i in range(t)) + sum(m[paths[i], paths[i + 1]] for i in range(t - 1)))
        return own - np.log(every.sum())

    up, move = language.chain_gradients(scores[None], labels, moves)
    for place in ((0, 1), (2, 2)):
        step = np.zeros((t, k))
        step[place] = 1e-5
        slope = (likelihood(scores + step, moves) - likelihood(scores - step, moves)) / 2e-5
        assert abs(up[0][place] - slope) < 1e-6
    step = np.zeros((k, k))
    step[1, 2] = 1e-5
    assert abs(move[1, 2] - (likelihood(scores, moves + step) - likelihood(scores, moves - step)) / 2e-5) < 1e-6


# ---- toxicity -----------------------------------------------------------------------------------


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    corpus, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit_toxicity(corpus, labels)
    given = {r.doc_id: r.toxic for r in labels.collect()}
    scored = [(r.score, given[r.doc_id]) for r in toxicity.toxicity(corpus, model).collect() if r.doc_id in given and held(r.doc_id)]
    toxic, clean = [s for s, y in scored if y == 1], [s for s, y in scored if y == 0]
    area = np.mean([(np.array(clean) < s).mean() + (np.array(clean) == s).mean() / 2 for s in toxic])
    assert area > 0.93 and np.mean(np.array(clean) >= 0.5) < 0.02 and np.mean(np.array(toxic) >= 0.5) > 0.8


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(3)
    y = rng.random(6000) < 0.3
    accuracies = [0.95, 0.85, 0.75, 0.9, 0.65]
    votes = []
    for a in accuracies:
        right = rng.random(len(y)) < a
        vote = np.where(right == y, toxicity.TOXIC, toxicity.CLEAN)
        votes.append(np.where(rng.random(len(y)) < 0.25, toxicity.ABSTAIN, vote))
    votes.append(votes[4])  # a voter that copies a weak one
    model = toxicity.LabelModel()
    q = model.fit(np.column_stack(votes))
    assert all(abs(x - a) < 0.05 for x, a in zip(model.accuracies, accuracies))
    assert model.parents[5] == 4 or model.parents[4] == 5
    assert ((q > 0.5) == y).mean() > 0.95


def test_toxicity_edges(spark):
    rng = random.Random(5)
    vocabulary = [f"wort{i}" for i in range(50)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(400)]
    rows = [(i, t + (" glorp" if i % 4 == 0 else ""), None) for i, t in enumerate(texts)]
    docs = documents(spark, [*rows, (1000, None, None), (1001, "", None), (None, "glorp", None), (0, rows[0][1], None)])
    labels = spark.createDataFrame(
        [(i, int(i % 4 == 0), "x") for i in range(0, 400)] + [(5, None, "x"), (None, 1, "x"), (7, 1, "x")],
        "doc_id long, toxic int, text string",
    )
    model = toxicity.fit_toxicity(docs, labels)
    got = [(r.doc_id, r.score) for r in toxicity.toxicity(docs, model).collect()]
    assert len(got) == len(rows) + 4
    for i, score in got:
        toxic = i is None or (i < 400 and i % 4 == 0)
        assert (score >= 0.5) == toxic and 0 <= score <= 1
    blank = toxicity.fit_toxicity(docs, labels.limit(0))
    assert all(r.score < 0.5 for r in toxicity.toxicity(docs, blank).collect())
    assert toxicity.toxicity(docs.limit(0), model).count() == 0
    empty = toxicity.fit_toxicity(docs.limit(0), labels)
    assert toxicity.toxicity(docs.limit(3), empty).count() == 3


# ---- main text ----------------------------------------------------------------------------------


def test_leaf_blocks():
    html = (
        "<html><head><title>no</title></head><body>a &lt; b&nbsp;c<br>x<b>y</b>z<p>q<ul><li>1<li>2</ul>"
        "<script>if(a<b){'</p>'}</script><!-- <p>x --><div title='>'>t 5 < 6 <a href=x>k</a></div>"
        "<style>p{}</style><button>no</button><noscript>no</noscript><table><tr><td>u<td>v</table></body>"
    )
    blocks = leaf_blocks(html)
    assert [b.text for b in blocks] == ["a < b c xyz", "q", "1", "2", "t 5 < 6 k", "u", "v"]
    assert [b.linked for b in blocks] == [0, 0, 0, 0, 1, 0, 0]
    assert leaf_blocks("") == [] and leaf_blocks("<p>open <b>end")[0].text == "open end"
    assert leaf_blocks("<" * 5000 + "a='")[0].text.startswith("<<<")


def test_gradients_of_the_labeller():
    model = main_text.BlockLabeller.new()
    pages = [leaf_blocks("<nav><a>x</a></nav><article><p>one two. three<p>four</article>"), leaf_blocks("<p>a b</p>")]
    batch = [(model.seen(p), np.arange(len(p)) % 2.0) for p in pages]

    def loss(name, at, by):
        model.weights[name][at] += by
        x, mask = model._padded([model.inputs(s) for s, _ in batch])
        p = model._forward(x, mask)[0]
        model.weights[name][at] -= by
        y = np.zeros(mask.shape)
        for row, (_, labels) in enumerate(batch):
            y[row, : len(labels)] = labels
        return -(np.log(np.where(y > 0, p, 1 - p)) * mask).sum() / mask.sum()

    before = {k: v.copy() for k, v in model.weights.items()}
    wanted = {}
    places = {"ahead in": (3, 5), "back again": (2, 40), "out": (4,), "ahead bias": (20,), "path": (int(batch[0][0][0][0]), 1)}
    for name, at in places.items():
        wanted[name] = (loss(name, at, 1e-5) - loss(name, at, -1e-5)) / 2e-5
    adam = {}
    model.step(batch, adam, 0.0)
    for name, at in places.items():
        assert abs(adam[name][0][at] / 0.1 - wanted[name]) < 1e-6, name
    assert all(np.array_equal(before[k], v) for k, v in model.weights.items())


def test_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    model = main_text.fit_labeller(pages)
    wrong = 0
    got = {r.page_id: r.text for r in main_text.main_text(pages, model).collect()}
    for r in pages.collect():
        want = "\n".join(b.text for b in leaf_blocks(r.html) if main_text.by_markup(b))
        wrong += got[r.page_id] != want
    assert wrong <= 0.02 * len(got)
    odd = spark.createDataFrame(
        [(1, None, "u"), (1, "", None), (None, "<nav><a href=x>menu</a></nav>", "t"), (3, "  \n", "u")],
        "page_id long, html string, text string",
    )
    assert {r.text for r in main_text.main_text(odd, model).collect()} == {""}
    assert main_text.main_text(odd.limit(0), model).count() == 0
    assert main_text.fit_labeller(odd.limit(0)) is not None
    rng = np.random.default_rng(77)
    texts = [" ".join(f"Word{i}" for i in rng.integers(0, 99, 20)) + "." for _ in range(200)]
    made = [main_text.random_page(texts, texts[0].split(), rng) for _ in range(150)]
    found = model.probabilities([b for b, _ in made])
    right = np.concatenate([(p >= 0.5) == np.array(y) for p, (_, y) in zip(found, made)])
    assert right.mean() > 0.93


def test_terms_of_a_sample_are_held_short():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("etaoinshrd"), 9)) for _ in range(30_000)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
    tracemalloc.start()
    terms = toxicity.Terms(texts)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert list(zip(terms.kinds, terms.parts))[:2] == toxicity.parts(min(words[:100]))[:2]
    assert held < 130 * len(terms.parts) and most < 225 * len(terms.parts)
