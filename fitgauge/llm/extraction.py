"""Main text of web pages: a linear-chain conditional random field over the blocks of a page.

A block's features are the elements around it, words of their class, id and role, and properties of its text. The model is
trained by maximum likelihood on labelled pages and decoded by Viterbi. Labelled pages come from a generator: it builds pages
of many layouts around given texts and knows which of their blocks belong to the article.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fitgauge.llm.markup import Block, blocks

#: Labelled pages for training, and texts that they are made from: the bounds of what the driver holds.
TRAINING_PAGES, TRAINING_TEXTS = 600, 400
ROUNDS, STEP, PENALTY = 150, 0.3, 1e-3


def features(page: list[Block]) -> list[list[str]]:
    """Feature names of each block of a page."""
    out = []
    for b in page:
        names = ["bias"]
        inside = [tag for tag, _ in b.path]
        names += [f"in {tag}" for tag in set(inside)]
        names.append(f"parent {inside[-1]}" if inside else "parent none")
        words = {w for _, ws in b.path for w in ws}
        names += [f"word {w}" for w in words]
        size, text = len(b.text), b.text
        names.append(f"size {min(size.bit_length(), 11)}")
        names.append(f"linked {round(4 * b.linked / size)}")
        names.append("sentence" if text[-1] in ".!?:;\"'”»…" else "no sentence")
        if text[0] in "©®":
            names.append("copyright")
        out.append(names)
    return out


@dataclass(frozen=True)
class Model:
    """Weights of each feature for both labels, of label pairs, and of first labels."""

    weights: dict[str, tuple[float, float]]
    pairs: np.ndarray
    start: np.ndarray

    def labels(self, page: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi: 1 for blocks of the article."""
        if not page:
            return []
        none = (0.0, 0.0)
        (a00, a01), (a10, a11) = self.pairs.tolist()
        s0, s1 = self.start.tolist()
        back = []
        for i, names in enumerate(features(page)):
            e0 = e1 = 0.0
            for f in names:
                w = self.weights.get(f, none)
                e0 += w[0]
                e1 += w[1]
            if i == 0:
                v0, v1 = s0 + e0, s1 + e1
                continue
            from0, from1 = v1 + a10 > v0 + a00, v1 + a11 > v0 + a01
            back.append((from0, from1))
            v0, v1 = (v1 + a10 if from0 else v0 + a00) + e0, (v1 + a11 if from1 else v0 + a01) + e1
        label = int(v1 > v0)
        out = [label]
        for choice in reversed(back):
            label = int(choice[label])
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = ROUNDS, step: float = STEP, penalty: float = PENALTY) -> Model:
    """Maximum likelihood with a Gaussian penalty, by gradient steps of adaptive size over all pages at once."""
    pages = [(b, y) for b, y in pages if b]
    vocabulary: dict[str, int] = {}
    rows, cols, ends = [], [], []
    length = max(len(b) for b, _ in pages)
    labels = np.zeros((len(pages), length), np.int64)
    valid = np.zeros((len(pages), length), bool)
    for p, (page, y) in enumerate(pages):
        for i, names in enumerate(features(page)):
            for f in names:
                rows.append(p * length + i)
                cols.append(vocabulary.setdefault(f, len(vocabulary)))
        labels[p, : len(y)] = y
        valid[p, : len(y)] = True
        ends.append(len(y) - 1)
    rows, cols, ends = np.array(rows), np.array(cols), np.array(ends)
    gold = np.zeros((len(pages), length, 2))
    np.put_along_axis(gold, labels[..., None], 1, 2)
    gold *= valid[..., None]
    gold_pairs = np.einsum("pia,pib->ab", gold[:, :-1], gold[:, 1:])
    w, pairs, start = np.zeros((len(vocabulary), 2)), np.zeros((2, 2)), np.zeros(2)
    seen = [np.full_like(x, 1e-8) for x in (w, pairs, start)]

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for _ in range(rounds):
        scores = np.stack([np.bincount(rows, w[cols, k], len(pages) * length) for k in (0, 1)], 1).reshape(len(pages), length, 2)
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = start + scores[:, 0]
        for i in range(1, length):
            forward[:, i] = total(forward[:, i - 1, :, None] + pairs, 1) + scores[:, i]
        for i in range(length - 2, -1, -1):
            ahead = total(pairs + (scores[:, i + 1] + backward[:, i + 1])[:, None, :], 2)
            backward[:, i] = np.where(valid[:, i + 1, None], ahead, 0)
        whole = total(forward[np.arange(len(pages)), ends], 1)
        single = np.exp(forward + backward - whole[:, None, None]) * valid[..., None]
        joint = forward[:, :-1, :, None] + pairs + (scores + backward)[:, 1:, None, :] - whole[:, None, None, None]
        joint = (np.exp(np.minimum(joint, 0)) * valid[:, 1:, None, None]).sum(axis=(0, 1))
        error = (gold - single).reshape(-1, 2)
        grads = [
            np.stack([np.bincount(cols, error[rows, k], len(vocabulary)) for k in (0, 1)], 1) / len(pages) - penalty * w,
            (gold_pairs - joint) / len(pages) - penalty * pairs,
            (gold[:, 0] - single[:, 0]).sum(axis=0) / len(pages) - penalty * start,
        ]
        for x, g, s in zip((w, pairs, start), grads, seen):
            s += g * g
            x += step * g / np.sqrt(s)
    return Model({f: (float(w[i, 0]), float(w[i, 1])) for f, i in vocabulary.items()}, pairs, start)


#: Names that sites give to the parts of a page.
PARTS = {
    "menu": (["nav", "div", "ul", "div"], "nav navbar menu navigation breadcrumb breadcrumbs mainmenu topnav sitenav links pagination pager".split()),
    "header": (["header", "div", "div"], "header masthead topbar banner sitehead pagehead branding logo tagline".split()),
    "footer": (["footer", "div", "div"], "footer copyright legal bottom colophon sitefoot imprint credits".split()),
    "sidebar": (["aside", "div", "section"], "sidebar side rail widget related recommended popular trending teaser more tags archive".split()),
    "advert": (["div", "aside", "ins", "section"], "ad ads advert advertisement adbox sponsor sponsored promo promotion banner commercial".split()),
    "notice": (["div", "section", "aside", "p"], "cookie cookies consent notice gdpr alert privacy warning disclaimer message popup modal overlay banner".split()),
    "form": (["form", "div", "form"], "form newsletter subscribe signup login search contact register".split()),
    "comments": (["section", "div", "ol", "article"], "comments comment reply replies respond discussion disqus feedback responses reader user".split()),
    "share": (["div", "ul"], "share social sharing follow buttons tools toolbar".split()),
}
ARTICLE = [("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("div", "entry content"), ("div", "article body"), ("section", "story"),
           ("div", "main text"), ("article", "post"), ("div", "page"), ("section", ""), ("div", "")]


class Generator:
    """Builds labelled pages. Equal seeds and texts give equal pages."""

    def __init__(self, texts: list[str], seed: int = 7) -> None:
        self.random = random.Random(seed)
        self.lines = [line for t in texts for line in t.split("\n") if line.strip()] or ["Text."]
        self.words = [w for line in self.lines for w in line.split()]

    def some(self, low: int, high: int) -> str:
        r = self.random
        return " ".join(r.choice(self.words) for _ in range(r.randint(low, high)))

    def sentence(self) -> str:
        r = self.random
        kind = r.random()
        if kind < 0.05:
            return " ".join(r.choice(self.lines) for _ in range(r.randint(10, 60)))
        if kind < 0.6:
            return " ".join(r.choice(self.lines) for _ in range(r.randint(1, 4)))
        if kind < 0.75:
            return self.some(1, 6) + r.choice(["", ".", "!"])
        if kind < 0.85:
            return " | ".join(self.some(1, 1) for _ in range(r.randint(3, 20)))
        return self.some(5, 60) + r.choice(["", ".", "."])

    def named(self, tags: list[str], names: list[str]) -> tuple[str, str]:
        r = self.random
        tag = r.choice(tags)
        plain = tag in ("nav", "header", "footer", "aside", "form")
        if plain and r.random() < 0.5:
            return tag, ""
        name = r.choice(names)
        if r.random() < 0.3:
            name += r.choice(["-", "_", " "]) + r.choice([*names, "box", "wrapper", "list", "item", "container", "inner", "block", "area"])
        return tag, f' {r.choice(["class", "class", "id"])}="{name}"'

    def part(self, kind: str) -> tuple[str, int]:
        """Markup of a part of the page that is not its article, and its number of text blocks."""
        r = self.random
        tag, attributes = self.named(*PARTS[kind])
        if kind in ("menu", "share") or kind in ("sidebar", "footer", "header") and r.random() < 0.4:
            n = r.randint(1, 8)
            cells = "".join(f'<li><a href="/{i}">{self.escaped(self.some(1, 3))}</a></li>' for i in range(n))
            inner = cells if tag in ("ul", "ol") else f"<ul>{cells}</ul>"
        elif kind == "form":
            n = r.randint(1, 3)
            inner = "".join(f"<p><label>{self.escaped(self.some(1, 4))}</label><input name=x></p>" for _ in range(n))
            if r.random() < 0.5:
                inner, n = inner + f"<button>{self.escaped(self.some(1, 2))}</button>", n + 1
        elif kind == "comments":
            n = r.randint(1, 5)
            inner = "".join(f"<{c}>{self.escaped(self.sentence())}</{c}>" for c in (r.choice(["p", "li", "div"]) for _ in range(n)))
        elif kind == "footer":
            n, inner = 1, self.escaped(r.choice(["©", "(c)", ""]) + " " + self.some(1, 2) + " · " + r.choice([self.some(1, 8), self.sentence()]))
        else:
            n = r.randint(1, 2)
            inner = self.escaped(r.choice(self.lines)) if n == 1 else "".join(f"<p>{self.escaped(self.sentence())}</p>" for _ in range(n))
        return f"<{tag}{attributes}>{inner}</{tag}>", n

    def escaped(self, text: str) -> str:
        return html.escape(text, quote=self.random.random() < 0.3)

    def article(self) -> tuple[str, list[int]]:
        r = self.random
        tag, name = r.choice(ARTICLE)
        out, labels = [f"<{tag}" + (f' class="{name}">' if name else ">")], []
        if r.random() < 0.7:
            title = f"<h1>{self.escaped(self.some(1, 9))}</h1>"
            out.append(f"<header>{title}</header>" if r.random() < 0.1 else title)
            labels.append(1)
        for i in range(r.choice([1, 1, 2, 3, 5, 8, 13, 25])):
            chance = r.random()
            if chance < 0.8:
                text = self.escaped(self.sentence())
                if r.random() < 0.1:
                    text = f'{text} <a href="/x">{self.escaped(self.some(1, 4))}</a> {self.escaped(self.some(1, 4))}'
                # the last of these is what unclosed markup looks like
                out.append(r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>"]))
                labels.append(1)
            elif chance < 0.86:
                out.append(f"<{r.choice(['h2', 'h3'])}>{self.escaped(self.some(1, 6))}</h2>")
                labels.append(1)
            elif chance < 0.9:
                n = r.randint(1, 5)
                out.append("<ul>" + "".join(f"<li>{self.escaped(self.sentence())}</li>" for _ in range(n)) + "</ul>")
                labels += [1] * n
            elif chance < 0.93:
                out.append(f"<blockquote>{self.escaped(self.sentence())}</blockquote>")
                labels.append(1)
            else:
                part, n = self.part(r.choice(["advert", "share", "notice", "sidebar", "form"]))
                out.append(part)
                labels += [0] * n
        if r.random() < 0.15:
            part, n = self.part("comments")
            out.append(part)
            labels += [0] * n
        return "".join([*out, f"</{tag}>"]), labels

    def page(self) -> tuple[str, list[int]]:
        r = self.random
        before = [k for k in ("header", "menu", "notice", "advert", "sidebar", "form") if r.random() < 0.45]
        after = [k for k in ("advert", "comments", "sidebar", "form", "share", "menu", "notice", "footer") if r.random() < 0.4]
        r.shuffle(before)
        # some pages are little but their article
        before, after = (before if r.random() < 0.75 else []), (after if r.random() < 0.75 else [])
        out, labels = ["<!DOCTYPE html><html><head><title>x</title><script>var t='</p>';</script></head><body>"], []
        wrapper = r.choice(["", "", "<div id=\"wrapper\">", "<div class=\"container\">"])
        out.append(wrapper)
        for kind in before:
            part, n = self.part(kind)
            out.append(part)
            labels += [0] * n
        article, own = self.article()
        out.append(article)
        labels += own
        for kind in after:
            part, n = self.part(kind)
            out.append(part)
            labels += [0] * n
        return "".join(out) + r.choice(["</body></html>", ""]), labels


def labelled_pages(texts: list[str], pages: int = TRAINING_PAGES, seed: int = 7) -> list[tuple[list[Block], list[int]]]:
    """Pages with a label for each block."""
    generator, out = Generator(texts, seed), []
    while len(out) < pages:
        page, labels = generator.page()
        found = blocks(page)
        if len(found) == len(labels):  # else a text was empty
            out.append((found, labels))
    return out


def training_texts(texts: DataFrame, bound: int = TRAINING_TEXTS) -> list[str]:
    """At most ``bound`` texts, those with the least hash, and no null."""
    rows = texts.select("text").where("text is not null").orderBy(F.xxhash64("text"), "text").limit(bound).collect()
    return [r.text for r in rows]


def main_text(page: str | None, model: Model) -> str:
    found = blocks(page) if page else []
    return "\n".join(b.text for b, label in zip(found, model.labels(found)) if label)


def extracted(pages: DataFrame, model: Model) -> DataFrame:
    """``page_id``, ``url``, ``text``: the article of each row of ``pages`` (``page_id``, ``url``, ``html``), its blocks joined by line
    breaks. A null, empty or textless page gives an empty text; ids and urls may be null; repeated rows repeat; other
    columns are ignored; an empty table gives an empty result. Whole pages are read and no block is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, model) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
