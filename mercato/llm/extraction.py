"""Main text of web pages: a recurrent labeller over the sequence of a page's blocks.

Each block is a vector of the hashed names on its tag path, its hashed words and a few shapes (length, share of links,
punctuation). A bidirectional LSTM in numpy reads the blocks of a page in both directions, so every block is judged
with the whole page in view, and says which belong to the article.

It is trained on ``SAMPLE`` pages, those with the smallest hashes of their ids. Their blocks get weak labels from what
tags and class names say; further training pages are made from them by changing the article's container and adding
menus, notices, adverts, forms and reader comments under many names, so that the labeller does not lean on one layout.
Prediction covers every block of every page.

Defined results: null or empty html has empty text. Pages without an article block have empty text. Repeated rows
have equal results. A page is read by one task, block by block; pages do not meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import need, small_batches
from mercato.llm.markup import Block, blocks

#: Pages that the labeller is trained on, and made pages for each of them.
SAMPLE, MADE = 160, 2
#: Characters of a training page at most: they pass through the driver.
SAMPLE_CHARS = 1 << 17
PATHS, WORDS, SHAPES = 512, 128, 6
DENSE, HIDDEN = 24, 20
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: Words remembered by a worker.
REMEMBERED = 1 << 18
#: Blocks that are labelled at once.
AT_ONCE = 1 << 14
#: Blocks whose vectors are held at once.
STRETCH = 1 << 12

#: Names that speak against the article or for it. Fixed values.
ASIDE = frozenset(
    "ad ads advert advertisement alert aside banner breadcrumb breadcrumbs button comment comments commentlist consent"
    " cookie cookies copyright dialog disclaimer discussion footer form gdpr hidden legal login masthead menu modal nav"
    " navbar navigation newsletter notice overlay pager pagination popup promo promoted recommended related reply"
    " replies respond responses search select share sharing sidebar signup skip social sponsor sponsored subscribe"
    " tags toolbar topbar widget".split()
)
ARTICLE = frozenset("article main content contents entry post story body text maincontent".split())

#: Containers of made articles and surroundings of made other blocks; each list is a path. Fixed values.
CONTAINERS = (
    "article;main;main article;div.content;div.main div.article;div.post;section.entry.content;div.story.body;"
    "main div.post.content;div.page div.text;article.post;div.article.body;div;section;body div.wrapper"
).split(";")
BEFORE = (
    "nav ul li;header;header h1;header p;div.header;div.header div.logo;ul.menu li;div.menu;div.nav a;div.navbar ul li;"
    "div.cookie.notice;div.cookie p;div.notice;div.notice p;section.alert p;div.banner;div.breadcrumb;ol.breadcrumbs li;"
    "form;form label;form.search;div.topbar;div.login form;div.ad;aside;div.consent p;dialog p;div.masthead"
).split(";")
WITHIN = "div.ad;aside;div.advert;aside p;figure.ad;div.promo;div.share;div.newsletter form;div.related ul li;div.sponsored p".split(";")
AFTER = (
    "footer;footer p;div.footer;div.footer p;aside;aside p;aside ul li;div.sidebar;div.sidebar p;div.sidebar ul li;"
    "section.comments div.comment p;div.comments p;div.comment;ol.commentlist li;ul.comments li p;div.comments h3;"
    "div.discussion p;section.responses p;div.related;div.related ul li;div.share;div.newsletter p;form;form p;"
    "form.subscribe label;div.legal;div.copyright;div.ad;div.widget;div.social a;div.replies div.reply p"
).split(";")


def _names(path: str) -> tuple[str, ...]:
    found = []
    for element in path.split():
        tag, *classes = element.split(".")
        found += [tag, *[f".{c}" for c in classes]]
    return tuple(found)


def weak_label(block: Block) -> bool:
    """What the names on a block's path say: something of the article around it and nothing against."""
    names = [n.lstrip(".") for n in block.path]
    inside = [i for i, n in enumerate(names) if n in ARTICLE and block.path[i] != "body"]
    against = [i for i, n in enumerate(names) if n in ASIDE or n == "header" and not (inside and inside[0] < i)]
    return not against and (bool(inside) or bool({"p", "h1", "h2", "blockquote", "pre"} & set(names)))


def _made(page: list[Block], others: list[str], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A page with the article of ``page`` in another container and other blocks around and within it."""
    root = ("html", "body")
    pick = lambda names: _names(names[rng.integers(len(names))])
    container = pick(CONTAINERS)
    out, labels = [], []

    def add(paths: list[str], most: int) -> None:
        for _ in range(rng.integers(0, most + 1)):
            path = pick(paths)
            for _ in range(rng.integers(1, 5)):
                text = others[rng.integers(len(others))]
                words = text.split()
                long = path[-1] == "p" or ".comment" in path or rng.random() < 0.2
                cut = len(words) if long else int(rng.integers(1, 9))
                text = " ".join(words[:cut])
                linked = len(text) if "li" in path and rng.random() < 0.7 else 0
                inner = path if paths is not WITHIN else (*container, *path)
                out.append(Block(text, (*root, *inner, *(("a",) if linked else ())), linked))
                labels.append(False)

    add(BEFORE, 4)
    article = [b for b in page if weak_label(b)]
    for k, block in enumerate(article):
        tag = "h1" if k == 0 and rng.random() < 0.7 else ("p", "p", "p", "p", "h2", "li", "blockquote")[rng.integers(7)]
        tail = () if rng.random() < 0.05 else (("ul", "li") if tag == "li" else (tag,))
        out.append(Block(block.text, (*root, *container, *tail), 0))
        labels.append(True)
        if rng.random() < 0.15:
            add(WITHIN, 1)
    add(AFTER, 5)
    return out, np.array(labels, bool)


class _Places(dict):
    """The hashed place of each word; a worker remembers a bounded number."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = place = crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        return place


_PLACES = _Places()


def vectors(page: list[Block]) -> np.ndarray:
    """One row for each block: path names, words, shapes."""
    out = np.zeros((len(page), PATHS + WORDS + SHAPES), np.float32)
    for row, block in zip(out, page):
        for name in block.path:
            row[crc32(name.encode()) % PATHS] = 1
        split = block.text.lower().split()
        at = np.fromiter(map(_PLACES.__getitem__, split), np.int64, len(split))
        row[PATHS : PATHS + WORDS] = np.bincount(at, minlength=WORDS) / max(len(split), 1)
        n = max(len(block.text), 1)
        row[-SHAPES:] = (
            np.log1p(n) / 5,
            block.linked / n,
            sum(map(block.text.count, ".,;:!?")) / n * 10,
            min(len(split), 50) / 50,
            block.text[-1:] in ".!?",
            1,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over dense projections of block vectors, with a logistic output for each block."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        size = PATHS + WORDS + SHAPES
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": draw(size, DENSE) * 4, "V": draw(2 * HIDDEN, 1), "v": np.zeros(1, np.float32)}
        for way in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p |= {f"W{way}": draw(DENSE, 4 * HIDDEN), f"U{way}": draw(HIDDEN, 4 * HIDDEN), f"b{way}": bias}

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict]:
        """Log odds (pages, blocks) for vectors (pages, blocks, size), and what the gradient needs."""
        return self.odds(np.tanh(x @ self.p["E"]), mask, kept={})

    def odds(self, dense: np.ndarray, mask: np.ndarray, kept: dict | None = None) -> tuple[np.ndarray, dict | None]:
        """Log odds for projected vectors; masked blocks leave the state as it is. Only ``kept`` remembers each step."""
        p, (pages, steps) = self.p, mask.shape
        states = np.zeros((pages, steps, 2 * HIDDEN), np.float32)
        for k, way in enumerate("fb"):
            inputs = dense @ p[f"W{way}"] + p[f"b{way}"]
            h = c = np.zeros((pages, HIDDEN), np.float32)
            trail = []
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                z = inputs[:, t] + h @ p[f"U{way}"]
                i, f, o = (_sigmoid(z[:, n * HIDDEN : (n + 1) * HIDDEN]) for n in range(3))
                g = np.tanh(z[:, 3 * HIDDEN :])
                m = mask[:, t, None]
                after = f * c + i * g
                tanh = np.tanh(after)
                if kept is not None:
                    trail.append((t, h, c, i, f, o, g, tanh, m))
                c, h = m * after + (1 - m) * c, m * o * tanh + (1 - m) * h
                states[:, t, k * HIDDEN : (k + 1) * HIDDEN] = h
            if kept is not None:
                kept[way] = trail
        if kept is not None:
            kept |= {"dense": dense, "states": states}
        return (states @ p["V"] + p["v"])[:, :, 0], kept

    def dense(self, page: list[Block]) -> np.ndarray:
        """The projected vectors of a page, worked out some blocks at a time."""
        parts = [page[n : n + STRETCH] for n in range(0, len(page), STRETCH)]
        return np.concatenate([np.tanh(vectors(part) @ self.p["E"]) for part in parts])

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict:
        p = self.p
        odds, kept = self.forward(x, mask)
        error = ((_sigmoid(odds) - labels) * mask / mask.sum())[:, :, None].astype(np.float32)
        out = {"V": np.einsum("ptk,pto->ko", kept["states"], error), "v": error.sum(axis=(0, 1))}
        states = error @ p["V"].T
        dense = np.zeros_like(kept["dense"])
        for k, way in enumerate("fb"):
            dz_all = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            du = np.zeros_like(p[f"U{way}"])
            dh = dc = np.zeros((len(mask), HIDDEN), np.float32)
            for t, h, c, i, f, o, g, tanh, m in reversed(kept[way]):
                dh = dh + states[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                after = m * dh * o * (1 - tanh**2) + m * dc
                parts = (after * g * i * (1 - i), after * c * f * (1 - f), m * dh * tanh * o * (1 - o), after * i * (1 - g**2))
                dz = np.concatenate(parts, axis=1)
                dz_all[:, t] = dz
                du += h.T @ dz
                dh, dc = dz @ p[f"U{way}"].T + (1 - m) * dh, after * f + (1 - m) * dc
            out[f"U{way}"], out[f"b{way}"] = du, dz_all.sum(axis=(0, 1))
            out[f"W{way}"] = np.einsum("ptd,ptz->dz", kept["dense"], dz_all, optimize=True)
            dense += dz_all @ p[f"W{way}"].T
        dense *= 1 - kept["dense"] ** 2
        out["E"] = x.reshape(-1, x.shape[2]).T @ dense.reshape(-1, DENSE)
        return out

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 5) -> Labeller:
        """Adam over batches of pages of like length."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        order = sorted(range(len(pages)), key=lambda n: len(pages[n][1]))
        batches = [order[n : n + BATCH] for n in range(0, len(order), BATCH)]
        for _ in range(epochs):
            for b in rng.permutation(len(batches)):
                x, mask, labels = padded([pages[n][0] for n in batches[b]], [pages[n][1] for n in batches[b]])
                step += 1
                for key, grad in self.gradients(x, mask, labels).items():
                    first[key] += 0.1 * (grad - first[key])
                    second[key] += 0.001 * (grad**2 - second[key])
                    rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    self.p[key] = self.p[key] - rate * first[key] / (np.sqrt(second[key]) + 1e-8)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Which blocks of each page belong to the article."""
        out = [np.zeros(0, bool)] * len(pages)
        waiting = sorted((n for n in range(len(pages)) if pages[n]), key=lambda n: len(pages[n]))
        while waiting:
            # Pages of like length share a batch of AT_ONCE blocks at most, or one page.
            longest = len(pages[waiting[-1]])
            part = waiting[-max(AT_ONCE // longest, 1) :]
            del waiting[-len(part) :]
            dense, mask, _ = padded([self.dense(pages[n]) for n in part])
            odds, _ = self.odds(dense, mask)
            for n, row in zip(part, odds):
                out[n] = row[: len(pages[n])] > 0
        return out


def padded(pages: list[np.ndarray], labels: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((len(pages), steps, pages[0].shape[1]), np.float32)
    mask, truth = np.zeros((2, len(pages), steps), np.float32)
    for n, page in enumerate(pages):
        x[n, : len(page)], mask[n, : len(page)] = page, 1
        if labels is not None:
            truth[n, : len(page)] = labels[n]
    return x, mask, truth


def trained(htmls: list[str]) -> Labeller:
    """A labeller trained on pages and on pages made from them."""
    rng = np.random.default_rng(1)
    parsed = [p for p in map(blocks, htmls) if p]
    texts = [b.text for p in parsed for b in p] or ["-"]
    pages = [(vectors(p), np.array([weak_label(b) for b in p])) for p in parsed]
    for page in parsed:
        for _ in range(MADE):
            made, labels = _made(page, texts, rng)
            if made:
                pages.append((vectors(made), labels))
    return Labeller().train(pages) if pages else Labeller()


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url and text of every row of ``pages``."""
    rows = need(small_batches(pages), page_id="bigint", url="string", html="string")
    usable = rows.where(F.length("html").between(1, SAMPLE_CHARS) & F.col("page_id").isNotNull())
    chosen = usable.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()
    ids = [r["page_id"] for r in chosen]
    htmls = usable.where(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min("html").alias("html"))
    model = trained([r["html"] for r in htmls.orderBy("page_id").collect()])
    shared = pages.sparkSession.sparkContext.broadcast(model.p)

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller()
        labeller.p = shared.value
        for batch in batches:
            parsed = [blocks(h) for h in batch["html"]]
            found = [
                "\n\n".join(b.text for b, kept in zip(page, labels) if kept)
                for page, labels in zip(parsed, labeller.label(parsed))
            ]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": found}).astype(
                {"page_id": "Int64"}
            )

    return rows.mapInPandas(texts, "page_id bigint, url string, text string")
