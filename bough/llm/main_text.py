"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each is seen as a vector of its tag path, a vector of its hashed
words and a few measures, and a bidirectional LSTM reads the whole sequence, so that every block is
labelled in the light of all others. The blocks labelled as content make up the main text.

The labeller is fitted to pages that are built from the texts of a bounded sample of the given
ones (``SAMPLE`` pages, those whose text hashes lowest, of up to ``SAMPLE_BYTES``): in the layout they
have, where semantic tags tell content apart, and in many random other layouts, in which it is known
what each part is.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from html import escape
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough.llm.batches import id_type, map_arrow, slices
from bough.llm.html_blocks import Block, leaf_blocks, path_words
from bough.names import col

SAMPLE = 150
SAMPLE_BYTES = 100_000
LAYOUTS = 4
BUCKETS = 2048
PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN = 16, 8, 7, 16
EPOCHS = 14
#: Pages that are labelled side by side.
TOGETHER = 256

#: Names that sites give to parts that are not their article, and to those that are.
OTHER_NAMES = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs".split(),
    "header": "header masthead site-header topbar page-header".split(),
    "footer": "footer site-footer page-footer bottom copyright".split(),
    "aside": "sidebar side aside rail widget related recommended".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner".split(),
    "notice": "cookie cookies notice consent gdpr alert popup modal newsletter subscribe".split(),
    "comments": "comments comment-list comment replies discussion responses".split(),
    "form": "search login signup contact-form form".split(),
    "share": "share social sharing tags meta byline pagination".split(),
}
CONTENT_NAMES = "content main article post entry story post-content entry-content article-body text body-copy".split()
_OTHER = {word for names in OTHER_NAMES.values() for name in names for word in name.split("-")} - {
    "body", "text", "page", "site", "list", "top",
}


def by_markup(block: Block) -> bool:
    """Whether semantic markup puts a block into a page's article."""
    inside = False
    for tag, attributes in block.path:
        words = set(path_words([(tag, attributes)]))
        if tag in ("article", "main"):
            inside = True
        if tag in ("nav", "footer", "aside", "form") or (words & _OTHER and tag != "body"):
            return False
    return inside


def random_page(texts: list[str], short: list[str], rng: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """A page of random layout around some paragraphs, and which of its blocks are content."""

    def pick(names):
        return names[rng.integers(len(names))]

    def words(n: int) -> str:
        return " ".join(pick(short) for _ in range(n))

    def named(kind: str, inside: str, tags: tuple[str, ...]) -> str:
        tag = pick(tags)
        if tag != "div" and rng.random() < 0.5:
            return f"<{tag}>{inside}</{tag}>"
        where = pick(("class", "class", "id"))
        return f'<{tag} {where}="{pick(OTHER_NAMES[kind])}">{inside}</{tag}>'

    def links(n: int) -> str:
        items = [f'<li><a href="/{i}">{escape(words(int(rng.integers(1, 4))))}</a></li>' for i in range(n)]
        return f"<ul>{''.join(items)}</ul>"

    def prose(n: int) -> str:
        return "".join(f"<{t}>{escape(pick(texts))}</{t}>" for t in [pick(("p", "div"))] * n)

    def other(kind: str) -> str:
        n = int(rng.integers(1, 5))
        if kind == "nav":
            return named(kind, links(n + 2), ("nav", "div", "ul"))
        if kind == "header":
            return named(kind, f"<h1>{escape(words(2))}</h1>" + (links(n) if n > 2 else f"<p>{escape(words(6))}</p>"), ("header", "div"))
        if kind == "footer":
            return named(kind, pick((f"&copy; {escape(words(4))}", links(n), f"<p>{escape(words(8))}</p>" + links(n))), ("footer", "div"))
        if kind == "aside":
            return named(kind, f"<h3>{escape(words(2))}</h3>" + pick((links(n + 1), prose(1))), ("aside", "div"))
        if kind == "comments":
            return named(kind, "".join(f'<div class="comment"><b>{escape(words(1))}</b>{prose(1)}</div>' for _ in range(n)), ("section", "div"))
        if kind == "form":
            return f'<form class="{pick(OTHER_NAMES[kind])}"><label>{escape(words(2))}</label><input><p>{escape(words(4))}</p><button>{escape(words(1))}</button></form>'
        if kind == "share":
            return named(kind, links(n) if n > 2 else f"<span>{escape(words(3))}</span>", ("div", "p"))
        return named(kind, pick((escape(words(9)), f"<p>{escape(pick(texts))}</p>")), ("div", "section") if kind == "ad" else ("div",))

    mark = 'data-y="1"'
    body = [f"<h1 {mark}>{escape(words(6))}</h1>"] if rng.random() < 0.7 else []
    for _ in range(int(rng.integers(1, 12))):
        kind = rng.random()
        if kind < 0.08:
            body.append(f"<h2 {mark}>{escape(words(3))}</h2>")
        elif kind < 0.14:
            body.append(f"<ul>{''.join(f'<li {mark}>{escape(pick(texts))}</li>' for _ in range(3))}</ul>")
        elif kind < 0.18:
            body.append(f"<blockquote {mark}>{escape(pick(texts))}</blockquote>")
        elif kind < 0.26:
            body.append(other(pick(("ad", "share", "aside", "notice"))))
        else:
            text = pick(texts) if rng.random() < 0.85 else words(int(rng.integers(1, 5)))
            body.append(f"<p {mark}>{'<b>' if rng.random() < 0.2 else ''}{escape(text)}")
    tag = pick(("article", "article", "main", "div", "div", "section", "td"))
    name = f' {pick(("class", "id"))}="{pick(CONTENT_NAMES)}"' if tag not in ("article", "main") or rng.random() < 0.3 else ""
    article = f"<{tag}{name}>{''.join(body)}</{tag}>"
    before = [other(k) for k in ("notice", "header", "nav", "share", "form", "ad") if rng.random() < 0.45]
    after = [other(k) for k in ("share", "comments", "aside", "ad", "form", "notice", "footer") if rng.random() < 0.45]
    html = f"<html><body>{''.join(before)}{article}{''.join(after)}</body></html>"
    if rng.random() < 0.5:
        html = html.replace("<body>", '<body><div class="wrapper">').replace("</body>", "</div></body>")
    blocks = leaf_blocks(html)
    return blocks, [any(mark in attributes for _, attributes in b.path) for b in blocks]


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


@dataclass
class BlockLabeller:
    """A bidirectional LSTM over the blocks of pages."""

    weights: dict[str, np.ndarray]
    _known: dict[str, int] = field(default_factory=dict)

    @classmethod
    def new(cls, seed: int = 3) -> BlockLabeller:
        rng = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + MEASURES
        w = {
            "path": rng.normal(0, 0.3, (BUCKETS, PATH_SIZE)),
            "word": rng.normal(0, 0.1, (BUCKETS, WORD_SIZE)),
            "out": rng.normal(0, 0.3, 2 * HIDDEN),
            "bias": np.zeros(1),
        }
        for way in ("ahead", "back"):
            w[f"{way} in"] = rng.normal(0, size**-0.5, (size, 4 * HIDDEN))
            w[f"{way} again"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            w[f"{way} bias"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # the gates that forget start open
        return cls(w)

    def seen(self, blocks: list[Block]) -> tuple:
        """What the labeller sees of blocks: path and word buckets with their owners, and measures."""
        if len(self._known) > 400_000:  # a cache, not a limit
            self._known.clear()
        out = []
        for listed in ([path_words(b.path) for b in blocks], [b.text.lower().split() for b in blocks]):
            for word in set().union(*listed).difference(self._known):
                self._known[word] = _bucket(word)
            sizes = np.fromiter(map(len, listed), dtype=np.int64, count=len(listed))
            flat = np.fromiter(
                map(self._known.__getitem__, chain.from_iterable(listed)), dtype=np.int64, count=sizes.sum()
            )
            out += [flat, sizes]
        n = np.array([len(b.text) for b in blocks], dtype=np.float64)
        words = out[3]
        measures = np.column_stack(
            [
                np.log1p(n) / 5,
                np.log1p(words) / 4,
                np.array([b.linked for b in blocks]) / n,
                np.array([b.text[-1] in ".!?…\"”" for b in blocks]),
                np.array([sum(map(b.text.count, ".,;")) for b in blocks]) / np.maximum(words, 1),
                np.arange(len(blocks)) / len(blocks),
                np.array([len(b.path) for b in blocks]) / 10,
            ]
        )
        return (*out, measures)

    def inputs(self, seen: tuple) -> np.ndarray:
        path, path_sizes, words, word_sizes, measures = seen
        vectors = []
        for flat, sizes, table in ((path, path_sizes, self.weights["path"]), (words, word_sizes, self.weights["word"])):
            ends = np.cumsum(sizes)
            sums = np.zeros((len(sizes), table.shape[1]))
            has = sizes > 0
            if has.any():
                sums[has] = np.add.reduceat(table[flat], (ends - sizes)[has])
            vectors.append(sums / np.maximum(sizes, 1)[:, None] ** 0.5)
        return np.hstack([*vectors, measures])

    def probabilities(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Of every block of every page how likely it is content."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        for begin in range(0, len(order), TOGETHER):
            own = order[begin : begin + TOGETHER]
            x, mask = self._padded([self.inputs(self.seen(pages[i])) for i in own])
            p = self._forward(x, mask)[0]
            for row, i in enumerate(own):
                out[i] = p[row, : len(pages[i])]
        return out

    @staticmethod
    def _padded(listed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        longest = max(map(len, listed))
        x = np.zeros((len(listed), longest, listed[0].shape[1]))
        mask = np.zeros((len(listed), longest))
        for row, own in enumerate(listed):
            x[row, : len(own)], mask[row, : len(own)] = own, 1
        return x, mask

    def _forward(self, x: np.ndarray, mask: np.ndarray):
        states, tapes = [], []
        for way in ("ahead", "back"):
            steps = range(x.shape[1]) if way == "ahead" else range(x.shape[1] - 1, -1, -1)
            drive = x @ self.weights[f"{way} in"] + self.weights[f"{way} bias"]
            h = np.zeros((len(x), HIDDEN))
            c = np.zeros_like(h)
            all_h = np.zeros((*x.shape[:2], HIDDEN))
            tape = {}
            for t in steps:
                gates = drive[:, t] + h @ self.weights[f"{way} again"]
                i, f, o = (1 / (1 + np.exp(-gates[:, k * HIDDEN : (k + 1) * HIDDEN])) for k in range(3))
                g = np.tanh(gates[:, 3 * HIDDEN :])
                m = mask[:, t, None]
                new = f * c + i * g
                tape[t] = (h, c, i, f, o, g, np.tanh(new), m)
                c = m * new + (1 - m) * c
                h = m * (o * tape[t][6]) + (1 - m) * h
                all_h[:, t] = h
            states.append(all_h)
            tapes.append((way, list(steps), tape))
        both = np.concatenate(states, axis=2)
        p = 1 / (1 + np.exp(-(both @ self.weights["out"] + self.weights["bias"][0])))
        return p, both, tapes

    def step(self, batch: list[tuple[tuple, np.ndarray]], adam: dict, rate: float) -> float:
        """One step of Adam on the log-loss of a batch of pages, by backpropagation through time."""
        x, mask = self._padded([self.inputs(seen) for seen, _ in batch])
        y = np.zeros(mask.shape)
        for row, (_, labels) in enumerate(batch):
            y[row, : len(labels)] = labels
        p, both, tapes = self._forward(x, mask)
        error = (p - y) * mask / mask.sum()
        grads = {k: np.zeros_like(v) for k, v in self.weights.items()}
        grads["out"] = np.einsum("bt,bth->h", error, both)
        grads["bias"][0] = error.sum()
        d_both = error[:, :, None] * self.weights["out"]
        d_x = np.zeros_like(x)
        for n, (way, steps, tape) in enumerate(tapes):
            d_out = d_both[:, :, n * HIDDEN : (n + 1) * HIDDEN]
            again = self.weights[f"{way} again"]
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            d_drive = np.zeros((*x.shape[:2], 4 * HIDDEN))
            for t in reversed(steps):
                h, c, i, f, o, g, squashed, m = tape[t]
                dh = dh + d_out[:, t]
                inner = dh * m
                d_new = dc * m + inner * o * (1 - squashed**2)
                d_gates = np.hstack(
                    [d_new * g * i * (1 - i), d_new * c * f * (1 - f), inner * squashed * o * (1 - o), d_new * i * (1 - g**2)]
                )
                d_drive[:, t] = d_gates
                grads[f"{way} again"] += h.T @ d_gates
                dh = d_gates @ again.T + dh * (1 - m)
                dc = d_new * f + dc * (1 - m)
            grads[f"{way} in"] += np.einsum("bti,btj->ij", x, d_drive)
            grads[f"{way} bias"] += d_drive.sum(axis=(0, 1))
            d_x += d_drive @ self.weights[f"{way} in"].T
        for row, (seen, labels) in enumerate(batch):
            for name, flat, sizes, part in (
                ("path", seen[0], seen[1], d_x[row, : len(labels), :PATH_SIZE]),
                ("word", seen[2], seen[3], d_x[row, : len(labels), PATH_SIZE : PATH_SIZE + WORD_SIZE]),
            ):
                scaled = part / np.maximum(sizes, 1)[:, None] ** 0.5
                np.add.at(grads[name], flat, np.repeat(scaled, sizes, axis=0))
        adam["t"] = adam.get("t", 0) + 1
        for k, gradient in grads.items():
            first, second = adam.setdefault(k, [np.zeros_like(gradient), np.zeros_like(gradient)])
            first += 0.1 * (gradient - first)
            second += 0.01 * (gradient**2 - second)
            scale = rate * (1 - 0.99 ** adam["t"]) ** 0.5 / (1 - 0.9 ** adam["t"])
            self.weights[k] -= scale * first / (np.sqrt(second) + 1e-8)
        return float(-(np.log(np.where(y > 0, p, 1 - p) + 1e-12) * mask).sum() / mask.sum())


def train(pages: list[str], layouts: int = LAYOUTS, epochs: int = EPOCHS, seed: int = 5) -> BlockLabeller:
    """A labeller fitted to the given pages as they are and in random other layouts."""
    rng = np.random.default_rng(seed)
    model = BlockLabeller.new()
    parsed = [b for b in map(leaf_blocks, pages) if b]
    examples: list[tuple[list[Block], list[bool]]] = []
    for blocks in parsed:
        labels = [by_markup(b) for b in blocks]
        if any(labels):
            examples += [(blocks, labels)] * 2
    texts = [b.text for blocks in parsed for b in blocks if len(b.text.split()) >= 5] or ["A few words of text."]
    short = [w for t in texts[:400] for w in t.split()[:20]]
    for _ in range(layouts * max(len(parsed), 1)):
        blocks, labels = random_page(texts, short, rng)
        if blocks:
            examples.append((blocks, labels))
    ready = [(model.seen(b), np.array(y, dtype=np.float64)) for b, y in examples]
    ready.sort(key=lambda e: len(e[1]))
    batches = [ready[i : i + 32] for i in range(0, len(ready), 32)]
    adam: dict = {}
    for epoch in range(epochs):
        for i in rng.permutation(len(batches)):
            model.step(batches[i], adam, 0.01 if epoch < epochs // 2 else 0.003)
    model._known.clear()
    return model


def fit_labeller(pages: DataFrame, html_col: str = "html") -> BlockLabeller:
    """A labeller for pages like the given ones; an empty table gives one for random layouts."""
    html = pages.select(col(html_col).alias("html")).where(F.octet_length("html") <= SAMPLE_BYTES)
    hashed = html.select("html", F.xxhash64("html").alias("h"))
    lowest = hashed.select("h").distinct().orderBy("h").limit(SAMPLE)
    rows = hashed.join(F.broadcast(lowest), "h").dropDuplicates(["h"]).collect()
    return train([r["html"] for r in sorted(rows, key=lambda r: r["h"])])


def main_text(
    pages: DataFrame, model: BlockLabeller, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``id_col``, the columns in ``keep``, and ``text``: the content blocks, one to a line.

    Character references are decoded and white space inside a block is one space. A null or
    empty page, or one without content, has the empty text. Repeated rows are kept; an empty table
    gives no rows.
    """
    source = pages.select(
        col(id_col).alias("id"), *[col(c).alias(f"keep{i}") for i, c in enumerate(keep)],
        F.coalesce(col(html_col), F.lit("")).alias("html"),
    )
    schema = T.StructType(
        [T.StructField(id_col, id_type(source))]
        + [T.StructField(c, source.schema[f"keep{i}"].dataType) for i, c in enumerate(keep)]
        + [T.StructField("text", T.StringType())]
    )
    held = pages.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for piece in slices(batches, "html"):
            parsed = [leaf_blocks(h) for h in piece.column("html").to_pylist()]
            likely = held.value.probabilities(parsed)
            texts = [
                "\n".join(b.text for b, p in zip(blocks, own) if p >= 0.5) for blocks, own in zip(parsed, likely)
            ]
            kept = {c: piece.column(f"keep{i}") for i, c in enumerate(keep)}
            yield {id_col: piece.column("id"), **kept, "text": texts}

    return map_arrow(source, work, schema)
