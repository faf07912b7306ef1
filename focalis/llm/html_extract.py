"""Main text of web pages by a recurrent block labeller (operator 6).

A page is cut into leaf blocks. Each block is a vector: the mean of hashed vectors of the tags
and class names on its path, the mean of hashed vectors of its words, and a few numbers (length,
share of links, punctuation, depth, place). A bidirectional LSTM in numpy reads the whole
sequence of a page, both ways, and a logistic output tells for every block whether it belongs to
the article.

The labeller is trained here, on pages that ``training_pages`` writes: articles in many layouts,
with and without speaking element and class names, among menus, headers, footers, sidebars,
notices, adverts, forms and reader comments. Training is deterministic, bounded by
``TRAINING_PAGES`` and kept for the life of the process.

Pages are labelled in batches of at most ``CELLS`` places, padding included; a page of more blocks
is read alone, in windows of that many, each direction carrying its state from window to window, so
the network's memory does not grow with a page.

Defined results: a null or empty page, one without blocks, or one without a block labelled as
article gives the empty string; malformed markup is read as far as it goes; pages and texts of any
length are read whole; a block of probability one half is article; repeated rows are treated alike;
other columns, whatever their names, are not read; no rows give no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, blocks
from .words import slices, words

PATH_BUCKETS, WORD_BUCKETS, VECTOR, NUMBERS = 4096, 2048, 16, 9
HIDDEN = 20
TRAINING_PAGES, EPOCHS, SEED = 1200, 5, 7
SLICE = 1 << 19
CELLS = 8192

# --- features


class Features:
    """Blocks of many pages: for each its path buckets, word buckets and numbers."""

    def __init__(self, pages: list[list[Block]], first: int = 0, whole: int = 0, _cache: dict[str, int] = {}):  # noqa: B006  path names recur
        """``first`` and ``whole``: where the blocks of a single page begin, and how many it has, if these are a part of them."""
        flat = [b for p in pages for b in p]
        self.sizes = np.array([len(p) for p in pages], np.int64)
        paths, at = [], [0]
        for b in flat:
            # the nearest elements tell most; all count
            for name in b.path:
                if name not in _cache:
                    if len(_cache) > 200_000:
                        _cache.clear()
                    _cache[name] = crc32(name.encode()) % PATH_BUCKETS
                paths.append(_cache[name])
            last = next((x for x in reversed(b.path) if x[0] != "."), "")
            paths.append(crc32(f"last {last}".encode()) % PATH_BUCKETS)
            at.append(len(paths))
        self.path, self.path_at = np.array(paths, np.int64), np.array(at, np.int64)
        hashes, self.word_at = words(pa.array([b.text for b in flat], pa.string()))
        self.word = (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64)
        n = np.array([len(b.text) for b in flat], np.float64)
        marks = np.array([sum(b.text.count(c) for c in ".,;:!?") for b in flat], np.float64)
        count = np.diff(self.word_at)
        place = first + np.concatenate([np.arange(k) for k in self.sizes]) if len(flat) else np.zeros(0)
        total = np.repeat(np.maximum(self.sizes, whole), self.sizes)
        self.numbers = np.stack((
            np.log1p(n) / 5,
            np.array([b.linked for b in flat]) / np.maximum(n, 1),
            marks / np.maximum(count, 1),
            np.log1p(count) / 4,
            np.array([sum(x[0] != "." for x in b.path) for b in flat]) / 10,
            place / np.maximum(total, 1),
            np.minimum(place, 10) / 10,
            np.array([b.text[-1] in ".!?" for b in flat], float),
            np.array([any(x[0] == "h" and x[1:].isdigit() for x in b.path) for b in flat], float),
        ), axis=1).reshape(len(flat), NUMBERS)


def _means(table: np.ndarray, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros((len(at) - 1, table.shape[1]))
    rows = np.flatnonzero(np.diff(at) > 0)
    if len(rows):
        out[rows] = np.add.reduceat(table[buckets], at[rows], axis=0) / np.diff(at)[rows, None]
    return out


# --- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Weights, the forward pass, and the gradients for training."""

    def __init__(self, seed: int = SEED):
        r, size = np.random.default_rng(seed), 2 * VECTOR + NUMBERS
        self.w = {"path": r.normal(0, 0.3, (PATH_BUCKETS, VECTOR)), "word": r.normal(0, 0.1, (WORD_BUCKETS, VECTOR))}
        for d in ("f", "b"):
            self.w[f"x{d}"] = r.normal(0, size**-0.5, (size, 4 * HIDDEN))
            self.w[f"h{d}"] = r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            self.w[f"c{d}"] = np.zeros(4 * HIDDEN)
            self.w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.w["out"], self.w["bias"] = r.normal(0, 0.2, 2 * HIDDEN + size), np.zeros(1)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool, state: tuple | None = None) -> tuple[np.ndarray, list]:
        """Hidden states of one direction, from a state given; x: steps x pages x size. Beyond a page's end its state stays zero.

        Without ``keep`` the last state comes back in place of the trace.
        """
        steps, pages, _ = x.shape
        h, c = state or (np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN)))
        out, trace = np.zeros((steps, pages, HIDDEN)), []
        given = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ self.w[f"h{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            last_h, last_c = h, c
            c = (f * c + i * g) * m
            y = np.tanh(c)
            h = o * y * m
            out[t] = h
            if keep:
                trace.append((t, i, f, o, g, y, last_h, last_c))
        return out, trace if keep else (h, c)

    def _back(self, d: str, x: np.ndarray, mask: np.ndarray, trace: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN))
        dh, dc = np.zeros(dout.shape[1:]), np.zeros(dout.shape[1:])
        for t, i, f, o, g, y, last_h, last_c in reversed(trace):
            m = mask[t][:, None]
            dh = (dh + dout[t]) * m
            dc = dc + dh * o * (1 - y * y)
            dc = dc * m
            dz = np.concatenate((dc * g * i * (1 - i), dc * last_c * f * (1 - f), dh * y * o * (1 - o), dc * i * (1 - g * g)), axis=1)
            grad[f"h{d}"] += last_h.T @ dz
            dz_all[t] = dz
            dh, dc = dz @ self.w[f"h{d}"].T, dc * f
        grad[f"x{d}"] += np.einsum("tps,tpz->sz", x, dz_all, optimize=True)
        grad[f"c{d}"] += dz_all.sum(axis=(0, 1))
        return dz_all @ self.w[f"x{d}"].T

    def _padded(self, f: Features, drop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, tuple]:
        word = _means(self.w["word"], f.word, f.word_at)
        if drop is not None:
            word = word * drop[:, None]
        flat = np.concatenate((_means(self.w["path"], f.path, f.path_at), word, f.numbers), axis=1)
        steps = int(f.sizes.max(initial=0))
        t = np.concatenate([np.arange(k) for k in f.sizes]) if len(flat) else np.zeros(0, np.int64)
        p = np.repeat(np.arange(len(f.sizes)), f.sizes)
        x, mask = np.zeros((steps, len(f.sizes), flat.shape[1])), np.zeros((steps, len(f.sizes)))
        x[t, p], mask[t, p] = flat, 1
        return x, mask, (t, p)

    def predict(self, f: Features) -> np.ndarray:
        """For each block the probability of being part of the article."""
        x, mask, at = self._padded(f)
        states = np.concatenate((self._run("f", x, mask, False)[0], self._run("b", x, mask, False)[0], x), axis=2)
        return _sigmoid(states @ self.w["out"] + self.w["bias"])[at]

    def predict_long(self, page: list[Block]) -> np.ndarray:
        """The same for one page of any length, window by window."""
        logit, out = np.zeros(len(page)), self.w["out"]
        begins = range(0, len(page), CELLS)
        for d, order, at in (("f", begins, 0), ("b", reversed(begins), HIDDEN)):
            state = None
            for low in order:
                x, mask, _ = self._padded(Features([page[low : low + CELLS]], low, len(page)))
                h, state = self._run(d, x, mask, False, state)
                logit[low : low + CELLS] += h[:, 0] @ out[at : at + HIDDEN]
                if d == "f":
                    logit[low : low + CELLS] += x[:, 0] @ out[2 * HIDDEN :]
        return _sigmoid(logit + self.w["bias"])

    def gradients(self, f: Features, labels: np.ndarray, drop: np.ndarray | None = None) -> tuple[float, dict]:
        x, mask, at = self._padded(f, drop)
        hf, tf = self._run("f", x, mask, True)
        hb, tb = self._run("b", x, mask, True)
        states = np.concatenate((hf, hb, x), axis=2)
        p = _sigmoid(states @ self.w["out"] + self.w["bias"])
        n = len(labels)
        err = np.zeros_like(p)
        err[at] = (p[at] - labels) / n
        loss = -np.log(np.where(labels > 0, p[at], 1 - p[at]) + 1e-12).mean()
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["out"], grad["bias"] = np.einsum("tps,tp->s", states, err), np.array([err.sum()])
        dstates = err[:, :, None] * self.w["out"]
        dx = dstates[:, :, 2 * HIDDEN :] + self._back("f", x, mask, tf, dstates[:, :, :HIDDEN], grad) + self._back("b", x, mask, tb, dstates[:, :, HIDDEN : 2 * HIDDEN], grad)
        flat = dx[at]
        for name, part, buckets, begins in (("path", flat[:, :VECTOR], f.path, f.path_at), ("word", flat[:, VECTOR : 2 * VECTOR] * (1 if drop is None else drop[:, None]), f.word, f.word_at)):
            count = np.diff(begins)
            np.add.at(grad[name], buckets, np.repeat(part / np.maximum(count, 1)[:, None], count, axis=0))
        return float(loss), grad


# --- pages to learn from

#: Fixed vocabulary of element names and words that layouts use.
OUTSIDE = {
    "nav": "nav menu navbar navigation topnav mainmenu breadcrumb breadcrumbs pagination pager tabs toolbar links skip sitemap",
    "header": "header masthead topbar branding logo site-header page-header hero-bar",
    "footer": "footer copyright colophon site-footer legal bottom page-footer credits imprint",
    "aside": "sidebar aside widget rail related recommended popular trending more-stories teaser tags author-box side secondary",
    "notice": "cookie consent notice banner gdpr alert popup modal overlay paywall announcement privacy-notice warning newsletter",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense dfp commercial teaser-ad outbrain affiliate",
    "form": "form search login signup subscribe subscription contact-form newsletter-form feedback register",
    "comments": "comments comment comment-list replies reply discussion responses disqus user-comments thread reader-comments guestbook",
    "share": "share social sharing follow buttons social-links actions",
}
INSIDE = "article main content post entry story body text article-body post-content entry-content story-text main-content single copy prose page-content"
PLAIN = "wrapper container row col inner outer box wrap grid section group layout block panel holder module unit"
SAYINGS = {
    "nav": "home about contact news sport menu next previous login help index archive startseite kontakt accueil inicio",
    "notice": "we use cookies accept all reject settings your privacy this site uses cookies consent agree dismiss wir verwenden nous utilisons usamos",
    "ad": "advertisement sponsored buy now sale offer discount shop deal free limited anzeige publicité publicidad",
    "form": "email password name send submit search sign up subscribe your address message remember me",
    "comments": "says reply posted comment ago likes report user wrote answer great thanks",
    "footer": "copyright all rights reserved terms privacy policy imprint contact impressum",
    "share": "share tweet facebook email print follow us",
}
MARK = ""  # put before the text of article blocks; taken out before anything is learned


class _Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.hides = random.Random(seed + 1)

    def unseen(self, element: str) -> str:
        """Some of what surrounds an article is hidden."""
        x = self.hides.random()
        return element if x > 0.08 else element.replace(">", " hidden>" if x < 0.04 else ' style="display:none">', 1)

    def word(self) -> str:
        r = self.r
        if not hasattr(self, "lexicon") or r.random() < 0.002:
            parts = ["".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiouéäöüñ") + r.choice(["", "n", "s", "r"]) for _ in range(1)) for _ in range(40)]
            self.lexicon = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(400)]
        return r.choice(self.lexicon)

    def sentence(self, low: int = 4, high: int = 24) -> str:
        r = self.r
        w = [self.word() for _ in range(r.randint(low, high))]
        w = [x + ("," if r.random() < 0.08 else "") for x in w]
        return " ".join(w).capitalize() + r.choice("....!?")

    def saying(self, kind: str) -> str:
        own = SAYINGS.get(kind, "").split()
        return " ".join(self.r.choice(own) if own and self.r.random() < 0.6 else self.word() for _ in range(self.r.randint(1, 5)))

    def paragraph(self) -> str:
        r = self.r
        n = 1 if r.random() < 0.25 else r.randint(1, 9)
        text = " ".join(self.sentence(1, 24) for _ in range(n))
        if r.random() < 0.25:  # odd texts: tables of words, marks after words, capitals, repeats, bare words
            mark = r.choice([" | ", "*** ", "!! ", "&amp;&amp;&amp; ", ", ", " "])
            text = mark.join(text.split()) if r.random() < 0.6 else " ".join(self.word() for _ in range(r.randint(1, 6)))
            text = text.upper().replace("&AMP;", "&amp;") if r.random() < 0.2 else text
            text = " ".join([text] * r.randint(2, 4)) if r.random() < 0.2 else text
        return text

    def named(self, names: str, tag: str = "div", inner: str = "", speaking: float = 0.85) -> str:
        r = self.r
        if r.random() < speaking:
            label = r.choice(names.split())
            if r.random() < 0.25:
                label = f"{label}{r.choice('-_')}{r.choice(PLAIN.split())}"
            if r.random() < 0.15:
                label = f"{r.choice(PLAIN.split())} {label}"
        else:
            label = "".join(r.choice("abcdefghijkmnpqrstuvwxyz") for _ in range(r.randint(3, 8)))
        return f'<{tag} {r.choice(["class", "class", "class", "id"])}="{label}">{inner}</{tag}>'

    def outside(self, kind: str) -> str:
        r = self.r
        if kind in ("nav", "share") or (kind in ("footer", "header", "aside") and r.random() < 0.4):
            items = [f'<a href="/{self.word()}">{self.saying("nav" if kind != "share" else kind)}</a>' for _ in range(r.randint(2, 9))]
            inner = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.6 else " ".join(items)
        elif kind == "comments":
            inner = r.choice(["", f"<h3>{self.saying(kind)}</h3>"])
            for _ in range(r.randint(1, 6)):
                body = "".join(f"<p>{self.sentence(3, 20) if r.random() < 0.6 else self.paragraph()}</p>" for _ in range(r.randint(1, 3)))
                who = f"<span>{self.saying(kind)}</span>" if r.random() < 0.5 else f"<h4>{self.word()}</h4>"
                t = r.choice(["div", "li", "section"])
                inner += r.choice([self.named("comment reply user-comment response message", r.choice([t, "article"]), who + body, 0.9), f"<{t}>{who}{body}</{t}>"])
        elif kind == "form":
            inner = f"<label>{self.saying(kind)}</label><input name='q'><p>{self.sentence(2, 9)}</p><button>{self.saying(kind)}</button>"
            if r.random() < 0.3:
                inner += "<select>" + "".join(f"<option>{self.word()}" for _ in range(4)) + "</select>"
            return f"<form>{inner}</form>" if r.random() < 0.75 else self.named(OUTSIDE[kind], "div", f"<form>{inner}</form>")
        else:
            lines = [self.saying(kind) if r.random() < 0.4 else self.sentence(2, 18) for _ in range(r.randint(1, 3))]
            shape = r.random()
            inner = " ".join(lines) if shape < 0.5 else "".join(f"<p>{x}</p>" for x in lines)
            if kind in ("aside", "header") and r.random() < 0.6:
                inner = f"<h{r.choice('1234')}>{self.saying(kind)}</h{1}>".replace("</h1>", "</h2>") + inner
            if kind == "footer" and r.random() < 0.6:
                inner = "&copy; " + inner
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside"}.get(kind)
        if tag and r.random() < 0.6:
            return f"<{tag}>{inner}</{tag}>" if r.random() < 0.6 else self.named(OUTSIDE[kind], tag, inner)
        return self.named(OUTSIDE[kind], r.choice(["div", "div", "section", "p" if inner[:1] != "<" else "div"]), inner, 0.93)

    def content(self) -> str:
        r = self.r
        parts = []
        title = f"<h1>{MARK}{self.sentence(2, 12).rstrip('.')}</h1>" if r.random() < 0.8 else ""
        for k in range(r.randint(1, 12)):
            x, text = r.random(), MARK + self.paragraph()
            if x < 0.06:
                parts.append(f"<h{r.choice('234')}>{MARK}{self.sentence(1, 7).rstrip('.')}</h2>")
            if x < 0.72:
                if r.random() < 0.15:
                    text = text.replace(" ", ' <a href="#">', 1) + "</a>"
                if r.random() < 0.15:
                    text = text.replace(MARK, MARK + "<b>", 1)
                parts.append(f"<p>{text}" + r.choice(["</p>", "</p>", "<br>", ""]))
            elif x < 0.8:
                parts.append("<ul>" + "".join(f"<li>{MARK}{self.sentence(1, 14)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.86:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif x < 0.9:
                parts.append("<table>" + "".join(f"<tr><td>{MARK}{self.word()}<td>{MARK}{self.word()}</tr>" for _ in range(2)) + "</table>")
            elif x < 0.93:
                parts.append(f"<pre>{text}</pre>")
            elif x < 0.96:
                parts.append(f"<figure><img src=x><figcaption>{MARK}{self.sentence(2, 9)}</figcaption></figure>")
            else:
                parts.append(f"<div>{text}</div>")
            if r.random() < 0.06:
                parts += [parts[-1]] * r.randint(2, 25)
            if r.random() < 0.05:
                parts.append(self.outside(r.choice(["ad", "aside", "form", "notice", "share"])))
        if r.random() < 0.1:
            parts.append(self.outside("comments"))
        return title + "".join(parts)

    def page(self) -> str:
        r = self.r
        body = self.content()
        x = r.random()
        if x < 0.4:
            body = f"<article>{body}</article>" if r.random() < 0.6 else self.named(INSIDE, "article", body, 0.6)
        elif x < 0.55:
            body = f"<main>{body}</main>"
        elif x < 0.95:
            body = self.named(INSIDE, r.choice(["div", "div", "section", "td"]), body, 0.8)
        for _ in range(r.choice([0, 0, 1, 2])):
            body = self.named(PLAIN if r.random() < 0.7 else INSIDE, r.choice(["div", "div", "main", "section"]), body, 0.9)
        before = [k for k in ("nav", "header", "notice", "ad", "form", "share", "aside") if r.random() < (0.6 if k in ("nav", "header", "ad") else 0.25)]
        after = [k for k in ("footer", "aside", "comments", "ad", "nav", "form", "share", "notice") if r.random() < (0.6 if k in ("footer", "aside") else 0.25)]
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.7 and "footer" in after:
            after.remove("footer")
            after.append("footer")
        inner = "".join(self.unseen(self.outside(k)) for k in before) + body + "".join(self.unseen(self.outside(k)) for k in after)
        if r.random() < 0.3:
            inner = self.named(PLAIN, "div", inner, 0.9)
        return f"<html><head><title>{self.sentence(2, 9)}</title></head><body>{inner}</body></html>"


def training_pages(n: int, seed: int = SEED) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of n made pages."""
    made, out = _Pages(seed), []
    for _ in range(n):
        found = blocks(made.page())
        labels = [int(MARK in b.text) for b in found]
        out.append(([b._replace(text=b.text.replace(MARK, "").strip() or "-") for b in found], labels))
    return [x for x in out if x[0]]


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """A labeller fitted by Adam on made pages; the same arguments give the same weights."""
    data = training_pages(pages, seed)
    model, r = Labeller(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for epoch in range(epochs):
        order = sorted(range(len(data)), key=lambda i: len(data[i][0]) + r.uniform(0, 6))
        batches = [order[i : i + 24] for i in range(0, len(order), 24)]
        for k in r.permutation(len(batches)):
            some = [data[i] for i in batches[k]]
            f = Features([b for b, _ in some])
            labels = np.concatenate([x for _, x in some])
            f.numbers *= np.repeat(r.random(len(some)) < 0.7, f.sizes)[:, None]  # the path has to do without words and numbers at times
            _, grad = model.gradients(f, labels, (r.random(len(labels)) < 0.5).astype(float))
            step += 1
            rate = 0.02 * (1 - 0.9 * epoch / epochs)
            for name, g in grad.items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                model.w[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return model


# --- the operator


def _batches(sizes: list[int], most: int) -> Iterator[list[int]]:
    """Pages by number of blocks, in batches of at most ``most`` pages and CELLS places, one page at least."""
    own: list[int] = []
    for i in sorted((i for i, n in enumerate(sizes) if n), key=sizes.__getitem__):
        if own and (len(own) == most or (len(own) + 1) * sizes[i] > CELLS):
            yield own
            own = []
        own.append(i)
    if own:
        yield own


def main_texts(pages: list[str | None], model: Labeller, batch: int = 64) -> list[str]:
    """The article text of each page, blocks joined by two line feeds."""
    found = [blocks(p) if p else [] for p in pages]
    out = [""] * len(pages)
    for own in _batches([len(b) for b in found], batch):
        p = model.predict(Features([found[i] for i in own])) if len(found[own[0]]) <= CELLS else model.predict_long(found[own[0]])
        at = 0
        for i in own:
            n = len(found[i])
            out[i] = "\n\n".join(b.text for b, x in zip(found[i], p[at : at + n]) if x >= 0.5)
            at += n
    return out


def extract(pages: DataFrame, model: Labeller | None = None, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text of every page."""
    held = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part in slices(rows, "html", SLICE):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(main_texts(part.column(2).to_pylist(), held.value), pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
