"""Main text of web pages: a bidirectional LSTM in numpy labels every block of a page with the whole page in view.

A page becomes the sequence of its text blocks; a block is a vector of hashed tag-path steps (tags, classes, ids), hashed
words and a few sizes. The network is trained here, on pages built from layouts with known labels and on a bounded sample
of the given pages whose landmarks (article, nav, footer, ...) label their blocks.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgate.llm.common import slices

#: Given pages that the network sees in training at most, and pages built from layouts.
SAMPLE_PAGES, BUILT_PAGES = 120, 360
PATH_DIMS, WORD_DIMS, SIZE_DIMS, HIDDEN = 64, 32, 5, 16
EPOCHS, BATCH, STEPS, RATE = 7, 32, 48, 0.02
#: Blocks of several pages that are labelled at once, with their padding; a page with more is labelled alone.
CELLS = 1 << 14
#: Words that built pages are made of: so many of each sample block, and so many distinct ones.
BLOCK_WORDS, BUILT_WORDS = 50, 5000

#: Elements that begin and end a block, that have no end tag, and whose content is no text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot "
    "th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object textarea".split())
#: Landmarks that label a given page's blocks.
KEEP_MARKS = frozenset("article main content post entry story body-text article-body post-body entry-content".split())
DROP_MARKS = frozenset(
    "nav header footer aside form ad ads advert advertisement banner sponsored promo sidebar menu breadcrumb breadcrumbs comment comments "
    "respond reply cookie cookies consent notice alert newsletter subscribe share social related recommended widget pagination login "
    "button select option title copyright legal disclaimer popup modal tags meta byline-links toolbar search".split()
)

_OPEN = re.compile(r"<!--|<[!?]|<(/?)([A-Za-z][A-Za-z0-9:-]*)")
#: The rest of a tag: a quote behind `=` hides what is in it, of any length; a quote without its other end hides nothing.
_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, float]]:
    """The page's text blocks in order: the steps of its tag path, its text, and the share of the text inside links.

    A slash before `>` closes no element, as in HTML, `svg` apart; what a raw element holds is skipped up to its end tag, or to
    the page's end without one. A tag that has an opening quote but no end ends at the next `>`, and from there on quotes hide
    nothing, so that a page of such tags is read once.
    """
    page = page or ""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked = size = links = 0
    path: tuple[str, ...] = ()

    def close() -> None:
        nonlocal linked, size
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((path, text, linked / max(1, size)))
            held.clear()
        linked = size = 0

    def add(piece: str) -> None:
        nonlocal linked, size, path
        if piece:
            if not held or not size:
                path = tuple(step for _, steps in stack for step in steps)
            held.append(piece)
            length = len(piece.strip())
            size += length
            linked += length if links else 0

    at, opened, quotes = 0, Counter(), True
    while (m := _OPEN.search(page, at)) is not None:
        if m[0] == "<!--":
            add(page[at : m.start()])
            stop = page.find("-->", m.end())
            at = stop + 3 if stop >= 0 else len(page)
            continue
        rest = _REST.match(page, m.end()) if m[2] and quotes else None
        stop = rest.end() - 1 if rest else page.find(">", m.end())
        if stop < 0:
            break
        quotes = quotes and bool(rest or not m[2])
        add(page[at : m.start()])
        at = stop + 1
        name = (m[2] or "").lower()
        if not name:
            continue
        ends, attributes = bool(m[1]), page[m.end() : stop]
        if name in RAW:
            # The slash of `<script/>` ends nothing in HTML; only foreign content closes by it.
            if not ends and not (name == "svg" and attributes.endswith("/")):
                stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if name in BLOCK:
            close()
        elif name == "br":
            held.append(" ")
        if name in VOID:
            continue
        if ends:
            if opened[name]:
                while stack:
                    tag, _ = stack.pop()
                    opened[tag] -= 1
                    links -= tag == "a"
                    if tag == name:
                        break
        else:
            if name in BLOCK and any(tag == "p" for tag, _ in stack[-4:]):
                while stack and stack[-1][0] not in BLOCK:
                    tag = stack.pop()[0]
                    opened[tag] -= 1
                    links -= tag == "a"
                if stack and stack[-1][0] == "p":
                    opened[stack.pop()[0]] -= 1
            marks = re.findall(r"[a-z0-9_-]+", " ".join(a or b or c for a, b, c in _MARK.findall(attributes)).lower())
            stack.append((name, (name, *(f".{x}" for x in marks))))
            opened[name] += 1
            links += name == "a"
    add(page[at:])
    close()
    return out


def _bucket(step: str, n: int, salt: int) -> tuple[int, float]:
    h = zlib.crc32(step.encode("utf-8", "surrogatepass"), salt)
    return (h >> 1) % n, 1.0 if h & 1 else -1.0


class _Vectors:
    """Block vectors; remembers the buckets of steps and words it has met, up to a bound."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, tuple[int, float]] = {}

    def path(self, steps: tuple[str, ...]) -> np.ndarray:
        if (v := self.paths.get(steps)) is None:
            v = np.zeros(PATH_DIMS, np.float32)
            # The last two steps have buckets of their own kind, so that a block's own tag and its parent's count.
            for step in {*steps, *(f"last:{s}" for s in steps[-1:]), *(f"next:{s}" for s in steps[-2:-1])}:
                for part in {step, *re.split("[-_]", step)}:
                    i, sign = _bucket(part.lstrip("."), PATH_DIMS, 11)
                    v[i] += sign
            v = np.clip(v, -2, 2)
            if len(self.paths) < 20_000:
                self.paths[steps] = v
        return v

    def of(self, found: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
        x = np.zeros((len(found), PATH_DIMS + WORD_DIMS + SIZE_DIMS), np.float32)
        for k, (steps, text, link) in enumerate(found):
            x[k, :PATH_DIMS] = self.path(steps)
            words = text.lower().split()
            row = x[k, PATH_DIMS : PATH_DIMS + WORD_DIMS]
            for w in words:
                if (b := self.words.get(w)) is None:
                    b = _bucket(w, WORD_DIMS, 13)
                    if len(self.words) < 100_000:
                        self.words[w] = b
                row[b[0]] += b[1]
            row *= 0.5 / max(1.0, float(np.sqrt(row @ row)))
            n = len(words)
            x[k, -SIZE_DIMS:] = (link, min(1.0, np.log1p(n) / 5), min(1.0, len(text) / 400), text[-1] in ".!?…\"", min(1.0, k / max(1, len(found))))
        return x


class Network:
    """A bidirectional LSTM and a logistic output over its two states, for padded batches of sequences."""

    def __init__(self, width: int, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for way in "fb":
            self.p[f"w{way}"] = (rng.normal(size=(width, 4 * hidden)) / np.sqrt(width)).astype(np.float32)
            self.p[f"u{way}"] = (rng.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.p[f"b{way}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        self.p["o"] = (rng.normal(size=2 * hidden) / np.sqrt(hidden)).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, learning: bool = True):
        """States of one direction; padding leaves the state as it is. For learning also what the backward pass needs."""
        pre, u, h = x @ self.p[f"w{way}"] + self.p[f"b{way}"], self.p[f"u{way}"], self.hidden
        n, t, _ = x.shape
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        states, kept = np.zeros((n, t, h), np.float32), []
        for k in range(t) if way == "f" else range(t - 1, -1, -1):
            z = pre[:, k] + state @ u
            gate = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            g = np.tanh(z[:, 3 * h :])
            i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
            m = mask[:, k, None]
            new_cell = f * cell + i * g
            bent = np.tanh(new_cell)
            if learning:
                kept.append((k, state, cell, i, f, o, g, bent, m))
            cell = m * new_cell + (1 - m) * cell
            state = m * (o * bent) + (1 - m) * state
            states[:, k] = state
        return states, kept

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        forward, backward = self._run(x, mask, "f", False)[0], self._run(x, mask, "b", False)[0]
        z = np.concatenate([forward, backward], axis=2) @ self.p["o"] + self.p["c"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {way: self._run(x, mask, way) for way in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.p["o"] + self.p["c"], -30, 30)))
        off = (p - y) * mask / max(1.0, float(mask.sum()))
        grads = {"o": np.einsum("nt,nth->h", off, both), "c": off.sum(keepdims=True)[0]}
        h = self.hidden
        for way, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            out = off[:, :, None] * self.p["o"][part]
            u, d_pre = self.p[f"u{way}"], np.zeros((*x.shape[:2], 4 * h), np.float32)
            d_state, d_cell = np.zeros_like(out[:, 0]), np.zeros_like(out[:, 0])
            d_u = np.zeros_like(u)
            for k, state, cell, i, f, o, g, bent, m in reversed(runs[way][1]):
                d_state = d_state + out[:, k]
                d_new = m * d_state
                d_c = m * d_cell + d_new * o * (1 - bent * bent)
                dz = np.concatenate([d_c * g * i * (1 - i), d_c * cell * f * (1 - f), d_new * bent * o * (1 - o), d_c * i * (1 - g * g)], axis=1)
                d_pre[:, k] = dz
                d_u += state.T @ dz
                d_cell = d_c * f + (1 - m) * d_cell
                d_state = dz @ u.T + (1 - m) * d_state
            grads[f"w{way}"] = np.einsum("ntd,ntg->dg", x, d_pre, optimize=True)
            grads[f"u{way}"], grads[f"b{way}"] = d_u, d_pre.sum(axis=(0, 1))
        return grads

    def fit(self, sequences: list[np.ndarray], labels: list[np.ndarray], seed: int = 5) -> Network:
        """Adam over batches; sequences longer than STEPS are cut into pieces for training only."""
        cut = [(x[k : k + STEPS], y[k : k + STEPS]) for x, y in zip(sequences, labels, strict=True) for k in range(0, len(x), STEPS) if len(x)]
        rng = np.random.default_rng(seed)
        first, second, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(cut))
            for start in range(0, len(order), BATCH):
                x, mask = padded([cut[i][0] for i in order[start : start + BATCH]])
                y = np.zeros(mask.shape, np.float32)
                for row, i in enumerate(order[start : start + BATCH]):
                    y[row, : len(cut[i][1])] = cut[i][1]
                step += 1
                rate = RATE * (1 - 0.8 * epoch / EPOCHS)
                for k, g in self.gradients(x, mask, y).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(s) for s in sequences)
    x = np.zeros((len(sequences), longest, sequences[0].shape[1]), np.float32)
    mask = np.zeros((len(sequences), longest), np.float32)
    for k, s in enumerate(sequences):
        x[k, : len(s)], mask[k, : len(s)] = s, 1
    return x, mask


def landmark_labels(found: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    """1 for blocks under a landmark of the article and under none of the page's other parts."""
    labels = []
    for steps, _, _ in found:
        names = {s.lstrip(".") for s in steps} | {part for s in steps for part in re.split("[-_]", s.lstrip("."))}
        labels.append(float(bool(names & KEEP_MARKS) and not names & DROP_MARKS))
    return np.array(labels, np.float32)


#: Phrases of the parts that pages have beside their article.
PHRASES = {
    "nav": "Home|About|Contact|News|Products|Sign in|Blog|Archive|Help|Search|Kontakt|Accueil|Inicio".split("|"),
    "notice": "We use cookies to improve this site.|Accept all|By using this site you agree to our terms.|This site uses cookies|Important notice".split("|"),
    "ad": "Advertisement|Sponsored content|Buy now and save|Limited offer, order today|Anzeige|Publicité".split("|"),
    "side": "Related articles|Most read|Popular posts|Tags|Categories|Recent posts|You may also like".split("|"),
    "form": "Your email|Subscribe to our newsletter|Search|Send|Name|Sign up".split("|"),
    "comments": "3 comments|Leave a reply|Great article, thanks for sharing!|I disagree with this.|Reply|Posted by reader".split("|"),
    "footer": "© 2024 All rights reserved.|Privacy policy|Terms of use|Imprint|Follow us|Contact us".split("|"),
}


def built_page(rng: Random, words: list[str]) -> tuple[str, set[str]]:
    """A page of a random layout, made of the given words, and the texts of its article's blocks."""

    def said(low: int, high: int) -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(low, high))) + rng.choice([".", ".", "", "!"])

    def filler(kind: str) -> str:
        return rng.choice(PHRASES[kind]) if rng.random() < 0.5 else said(1, 25 if kind in ("comments", "ad", "notice", "side", "footer") else 3)

    def wrap(kind: str, inner: str) -> str:
        tag, mark = rng.choice(
            {
                "nav": [("nav", ""), ("div", "menu"), ("ul", "nav"), ("div", "breadcrumbs"), ("header", "")],
                "notice": [("div", "cookie-notice"), ("div", "alert"), ("div", "consent"), ("section", "notice"), ("div", "banner")],
                "ad": [("div", "ad"), ("div", "advert"), ("aside", "sponsored"), ("div", "ads-box"), ("div", "promo")],
                "side": [("aside", ""), ("div", "sidebar"), ("div", "related"), ("section", "widget"), ("aside", "recommended")],
                "form": [("form", ""), ("form", "newsletter"), ("div", "subscribe"), ("form", "search")],
                "comments": [("div", "comments"), ("section", "comments"), ("div", "comment"), ("ol", "comment-list"), ("div", "respond")],
                "footer": [("footer", ""), ("div", "footer"), ("footer", "copyright"), ("div", "legal")],
            }[kind]
        )
        where = f' {rng.choice(["class", "id"])}="{mark}"' if mark else ""
        return f"<{tag}{where}>{inner}</{tag}>"

    def part(kind: str) -> str:
        if kind in ("nav", "side") and rng.random() < 0.7:
            return wrap(kind, "<ul>" + "".join(f'<li><a href="#">{filler(kind)}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>")
        if kind == "form":
            return wrap(kind, f"<label>{filler(kind)}</label><input><button>{filler(kind)}</button>")
        return wrap(kind, "".join(rng.choice([f"<p>{filler(kind)}</p>", f"<div>{filler(kind)}</div>", filler(kind) + "<br>"]) for _ in range(rng.randint(1, 4))))

    tag, mark = rng.choice([("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "post-body"), ("div", "entry-content"), ("section", "story"), ("div", "article-body")])
    kept: list[str] = []
    body = []
    if rng.random() < 0.8:
        kept.append(said(2, 9))
        body.append(f"<h1>{kept[-1]}</h1>")
    for _ in range(rng.randint(1, 9)):
        text = said(1, 5) if rng.random() < 0.25 else said(6, 70)
        kept.append(" ".join(text.split()))
        body.append(rng.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<h2>{text}</h2>", f"<ul><li>{text}</li></ul>", f"<blockquote>{text}</blockquote>", f"<p><b>{text}<br>", f"<p>{text}"]))
        if rng.random() < 0.12:
            body.append(part(rng.choice(["ad", "form", "side", "notice"])))
    if rng.random() < 0.25:
        body.append(part("comments"))
    where = f' {rng.choice(["class", "id"])}="{mark}"' if mark else ""
    before = [part(k) for k in ("nav", "notice", "ad", "side", "form") if rng.random() < 0.55]
    after = [part(k) for k in ("comments", "side", "form", "ad") if rng.random() < 0.45]
    rng.shuffle(before)
    main = f"<{tag}{where}>{''.join(body)}</{tag}>"
    if rng.random() < 0.3:
        main = f'<div class="{rng.choice(["wrapper", "container", "page", "row"])}">{main}{"".join(after)}</div>'
        after = []
    head = f"<head><title>{said(2, 8)}</title></head>"
    return f"<html>{head}<body>{''.join(before)}{main}{''.join(after)}{part('footer')}</body></html>", set(kept)


def train(pages: list[str], seed: int = 17) -> Network:
    """The network, from the given sample of pages (at most SAMPLE_PAGES are used) and BUILT_PAGES built ones.

    The built ones are made of the sample's words, the first BLOCK_WORDS of a block and BUILT_WORDS in all.
    """
    pages, rng, vectors = pages[:SAMPLE_PAGES], Random(seed), _Vectors()
    found = [blocks(p) for p in pages]
    words = sorted({w for f in found for _, text, _ in f for w in text.split()[:BLOCK_WORDS]})[:BUILT_WORDS] or "the of and to in is that for it as was with be on".split()
    x, y = [], []
    for f in found:
        marked = landmark_labels(f)
        if marked.any():
            x.append(vectors.of(f))
            y.append(marked)
    for _ in range(BUILT_PAGES):
        page, kept = built_page(rng, words)
        f = blocks(page)
        x.append(vectors.of(f))
        # A text may stand in the article and beside it; its path tells which one this is.
        drop = 1 - np.array([bool({s.lstrip(".") for s in steps} & DROP_MARKS) for steps, _, _ in f], np.float32)
        y.append(np.array([text in kept for _, text, _ in f], np.float32) * drop)
    return Network(x[0].shape[1]).fit(x, y)


def main_text(network: Network, pages: list[str | None], vectors: _Vectors | None = None) -> list[str]:
    """The article's blocks of each page, joined by blank lines; pages are labelled together up to CELLS padded blocks."""
    vectors = vectors or _Vectors()
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
    start = 0
    while start < len(order):
        longest, stop = len(found[order[start]]), start
        while stop < len(order) and stop - start < 64 and (n := len(found[order[stop]])) <= 1.3 * longest + 8 and (stop == start or n * (stop - start + 1) <= CELLS):
            stop += 1
        group = order[start:stop]
        x, mask = padded([vectors.of(found[i]) for i in group])
        for i, p in zip(group, network.probabilities(x, mask), strict=True):
            out[i] = "\n\n".join(text for k, (_, text, _) in enumerate(found[i]) if p[k] >= 0.5)
        start = stop
    return out


def _extract(network: Network):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        vectors = _Vectors()
        for part in slices(batches, 128):
            texts = main_text(network, part.column("html").to_pylist(), vectors)
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema
            )

    return run


def extract_main_text(pages: DataFrame, network: Network | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page: its main text, blocks joined by two line ends.

    Null and empty pages, and pages without an article, have the empty text. Pages of any length are read whole. Repeated
    rows give repeated results; other columns are ignored. An empty table gives no rows. Without a network one is trained
    on SAMPLE_PAGES of the pages, those with the lowest hash of page_id (of rows that repeat one, the one with the least
    hash of its html), and on built ones.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    if network is None:
        ids = rows.where("html is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES)
        held = rows.where("html is not null").join(F.broadcast(ids.distinct()), "page_id")
        sample = held.groupBy("page_id").agg(F.min_by("html", F.xxhash64("html")).alias("html")).orderBy("page_id").collect()
        network = train([r["html"] for r in sample])
    return rows.mapInArrow(_extract(network), "page_id long, url string, text string, n_chars long")
