"""Main text of web pages by a tree-structured graphical model over the DOM.

Block elements and runs of text are nodes with a label: 1 if the node is or holds main text. A node's
potential comes from its tag, names in its attributes, length and share of links; an edge's 2 x 2
potential from the child's kind. Sum-product messages, up and then down the tree, give exact marginals, and the
weights climb the likelihood of labelled pages (written by `labelled_pages`, since no table has such labels).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

# Element groups of the HTML standard.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strong sub sup time tt u var wbr br".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title")
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KINDS = {"#text": 0, "p": 1, "h1": 1, "h2": 1, "h3": 1, "h4": 1, "blockquote": 1, "pre": 1, "li": 2, "ul": 2, "ol": 2, "dl": 2, "table": 3, "tr": 3, "td": 3, "th": 3, "tbody": 3, "article": 4, "main": 4, "div": 5, "section": 5}
KIND_COUNT, OTHER_KIND, BUCKETS, DENSE = 7, 6, 4096, 8
NAMES = "nav menu side ad ads advert promo sponsor cookie notice banner consent comment respons discuss repl footer header head masthead share social related recommend subscribe newsletter login search form breadcrumb widget popup modal alert toolbar pager tag meta author content article post entry story body main text".split()

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


@dataclass
class Tree:
    """Nodes in document order, parents before children; runs of text have a text."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, names: str = "", text: str | None = None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


def parse(page: str) -> Tree:
    """The block elements and text runs of a page. Tags that were never closed end with their parent."""
    tree = Tree()
    stack: list[tuple[str, int]] = [("#root", tree.add(-1, "#root"))]
    run: list[str] = []
    links, at, linked = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if run:
            if text := " ".join("".join(run).split()):
                node = next(n for _, n in reversed(stack) if n >= 0)
                tree.add(node, "#text", "", text, min(linked, len(text)))
            run.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal links
        if any(n >= 0 for _, n in stack[k:]):
            flush()
        links -= sum(t == "a" for t, _ in stack[k:])
        del stack[k:]

    while True:
        m = TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            run.append(html.unescape(piece) if "&" in piece else piece)
            if links:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            k = len(stack) - 1
            while k and stack[k][0] != name:
                k -= 1
            if k:
                close(k)
            elif name == "p":
                flush()
            continue
        if name == "br" or name == "wbr":
            run.append(" " if name == "br" else "")
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[^>]*>", re.I).search(page, at)
            if name not in ("script", "style"):
                flush()
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            if name not in INLINE:
                flush()
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][1] >= 0 and stack[k][0] not in ("#text",):
                    break
        for old in ENDS.get(name, ()):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == old:
                    close(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        if name in INLINE:
            stack.append((name, -1))
            links += name == "a"
        else:
            flush()
            names = " ".join(x.strip("\"'") for x in ATTRIBUTE.findall(m[3])).lower() if m[3] else ""
            node = next(n for _, n in reversed(stack) if n >= 0)
            stack.append((name, tree.add(node, name, names)))
    flush()
    return tree


@dataclass
class Forest:
    """Many trees as arrays. `levels`: nodes by depth, roots first."""

    parent: np.ndarray
    kind: np.ndarray
    owner: np.ndarray
    bucket: np.ndarray
    dense: np.ndarray
    levels: list[np.ndarray]
    leaves: np.ndarray


_KNOWN: dict[tuple[str, str, str], tuple[int, ...]] = {}


def _names(tag: str, names: str, above: str) -> tuple[int, ...]:
    """Buckets of a node's tag, its parent's tag, and words and known parts in its attributes."""
    key = (tag, names, above)
    if key not in _KNOWN:
        if len(_KNOWN) > 100_000:
            _KNOWN.clear()
        words = re.findall(r"[a-z]+", names)
        found = {"t=" + tag, "u=" + tag + "<" + above, *("w=" + w for w in words), *("k=" + k for k in NAMES if any(w.startswith(k) for w in words))}
        _KNOWN[key] = tuple(sorted(crc32(x.encode()) % BUCKETS for x in found))
    return _KNOWN[key]


def forest(trees: list[Tree]) -> Forest:
    parent, kind, owner, bucket, size, linked, words, stops, place, is_text = [], [], [], [], [], [], [], [], [], []
    for tree in trees:
        base, n = len(parent), len(tree.tag)
        parent.extend(p + base if p >= 0 else -1 for p in tree.parent)
        for k, (tag, text) in enumerate(zip(tree.tag, tree.text, strict=True)):
            p = tree.parent[k]
            found = _names(tag, tree.names[k], tree.tag[p] if p >= 0 else "")
            bucket.extend(found)
            owner.extend([base + k] * len(found))
            kind.append(KINDS.get(tag, OTHER_KIND))
            size.append(len(text) if text else 0)
            words.append(text.count(" ") + 1 if text else 0)
            stops.append(text.count(".") + text.count("!") + text.count("?") + text.count("。") if text else 0)
            place.append(k / n)
            is_text.append(text is not None)
        linked.extend(tree.linked)
    parent, size, linked, words = np.array(parent, np.int64), np.array(size, float), np.array(linked, float), np.array(words, float)
    depth = np.zeros(len(parent), np.int64)
    for k in range(len(parent)):  # parents come first
        if parent[k] >= 0:
            depth[k] = depth[parent[k]] + 1
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1 if len(depth) else 0)]
    total, links, runs = size.copy(), linked.copy(), np.array(is_text, float)
    for level in levels[:0:-1]:
        for x in (total, links, runs):
            np.add.at(x, parent[level], x[level])
    place, leaf = np.array(place), np.array(is_text, bool)
    dense = np.stack([np.ones(len(parent)), leaf, np.log1p(np.minimum(total, 400)) / 5, links / np.maximum(total, 1), np.log1p(np.minimum(words, 40)) / 3 * leaf, np.minimum(np.array(stops, float), 5) / 5, place, np.log1p(np.minimum(runs, 20)) / 3], axis=1) if len(parent) else np.zeros((0, DENSE))
    return Forest(parent, np.array(kind, np.int64), np.array(owner, np.int64), np.array(bucket, np.int64), dense, levels, np.flatnonzero(leaf))


@dataclass
class Model:
    names: np.ndarray
    dense: np.ndarray
    edges: np.ndarray  # by kind of the child, parent's label, child's label

    def potentials(self, f: Forest) -> np.ndarray:
        return np.bincount(f.owner, self.names[f.bucket], len(f.parent)) + f.dense @ self.dense

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """P(label 1) of each node, and the 2 x 2 table of each node with its parent (roots: unused)."""
        n = len(f.parent)
        score = np.zeros((n, 2))
        score[:, 1] = self.potentials(f)
        inward, up = score.copy(), np.zeros((n, 2))
        for level in f.levels[:0:-1]:
            up[level] = np.logaddexp.reduce(self.edges[f.kind[level]] + inward[level][:, None, :], axis=2)
            np.add.at(inward, f.parent[level], up[level])
        outward = np.zeros((n, 2))
        joint = np.zeros((n, 2, 2))
        for level in f.levels[1:]:
            p = f.parent[level]
            above = outward[p] + inward[p] - up[level]
            both = above[:, :, None] + self.edges[f.kind[level]]
            outward[level] = np.logaddexp.reduce(both, axis=1)
            joint[level] = both + inward[level][:, None, :]
        belief = inward + outward
        one = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -40, 40)))
        flat = joint.reshape(n, 4)
        joint = np.exp(flat - np.logaddexp.reduce(flat, axis=1, keepdims=True)).reshape(n, 2, 2)
        return one, joint


def fit(pages: list[tuple[str, set[str]]], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Adam on the exact likelihood of the labels of all nodes."""
    trees = [parse(p) for p, _ in pages]
    f = forest(trees)
    y = np.array([text is not None and text in wanted for tree, (_, wanted) in zip(trees, pages, strict=True) for text in tree.text], float)
    for level in f.levels[:0:-1]:
        np.maximum.at(y, f.parent[level], y[level])
    model = Model(np.zeros(BUCKETS), np.zeros(DENSE), np.zeros((KIND_COUNT, 2, 2)))
    child = np.flatnonzero(f.parent >= 0)
    cell = f.kind[child] * 4 + (y[f.parent[child]] * 2 + y[child]).astype(np.int64)
    seen = np.bincount(cell, minlength=KIND_COUNT * 4).reshape(KIND_COUNT, 2, 2)
    values = [model.names, model.dense, model.edges]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, rounds + 1):
        one, joint = model.marginals(f)
        miss = one - y
        expected = np.zeros((KIND_COUNT, 2, 2))
        np.add.at(expected, f.kind[child], joint[child])
        grads = [np.bincount(f.bucket, miss[f.owner], BUCKETS), f.dense.T @ miss, expected - seen]
        for k, g in enumerate(grads):
            g = g / len(pages) + decay * values[k]
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
            values[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, set[str]]]:
    """Pages of many layouts with the set of their main text's blocks. Words are invented, so that only structure can be learnt."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    letters = "etaoinshrdlucmfwypvbgk"
    word = lambda: "".join(pick(letters) for _ in range(int(rng.integers(2, 9))))

    def sentence(low: int, high: int) -> str:
        return " ".join(word() for _ in range(int(rng.integers(low, high)))).capitalize() + pick([".", ".", ".", "!", "?", ""])

    def paragraph(style: int = 0) -> str:
        if style:  # lines of a list-like or poem-like page
            return sentence(1, 4)
        if rng.random() < 0.08:  # long, without stops, or one word again and again
            one = [word()] * int(rng.integers(3, 90)) if rng.random() < 0.5 else [word() for _ in range(int(rng.integers(30, 120)))]
            return " ".join(one)
        return " ".join(sentence(1, 14) for _ in range(int(rng.integers(1, 7))))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k))

    def some(tag: str, names: list[str], inner: str) -> str:
        return f'<{tag}{pick([" class", " id"])}="{pick(names)}">{inner}</{tag}>'

    def aside_part() -> str:
        kind, said = int(rng.integers(12)), lambda: pick([sentence(3, 12), paragraph(), f"<p>{sentence(2, 20)}</p>", f"<p>{paragraph()}</p><p>{paragraph()}</p>"])
        return [
            lambda: f"<nav><ul>{links(int(rng.integers(2, 9)))}</ul></nav>",
            lambda: some(pick(["div", "ul"]), ["menu", "main-menu", "navbar", "nav-links", "breadcrumbs", "topnav"], links(int(rng.integers(2, 9)))),
            lambda: some(pick(["div", "aside", "section", "p"]), ["ad", "ads", "advert", "ad-banner", "advertisement", "sponsored", "promo"], sentence(3, 25)),
            lambda: some(pick(["div", "section", "aside", "p"]), ["notice", "cookie-notice", "cookie-banner", "consent", "alert", "gdpr-banner"], said()),
            lambda: pick(["<aside>", '<aside class="sidebar">', '<div class="sidebar">', '<div id="side-bar">']) + pick([f"<h3>{sentence(1, 4)}</h3>", ""]) + pick([f"<ul>{links(5)}</ul>", said()]) + "</aside></div>",
            lambda: f"<form>{pick(['', '<p>' + sentence(2, 9) + '</p>'])}<label>{word()}</label><input name=q><button>{word()}</button></form>",
            lambda: some(pick(["div", "section"]), ["comments", "comment-list", "reader-comments", "responses", "discussion"], pick(["", f"<h2>{sentence(1, 3)}</h2>", f"<h3>{word()}</h3>"]) + "".join(pick([f'<div class="comment"><p>{paragraph()}</p></div>', f"<p>{paragraph()}</p>", f"<li>{paragraph()}</li>", f'<article class="comment"><p>{paragraph()}</p></article>']) for _ in range(int(rng.integers(1, 5))))),
            lambda: some(pick(["div", "section"]), ["related", "related-posts", "recommended", "share", "social-share", "newsletter", "subscribe", "widget"], pick([f"<ul>{links(4)}</ul>", said()])),
            lambda: some("div", ["popup", "modal", "toolbar", "pagination", "tags", "login-box", "search"], pick([sentence(1, 6), links(3)])),
            lambda: f"<script>var {word()} = '<p>{word()}</p>';</script>",
            lambda: f"<noscript>{sentence(3, 8)}</noscript><!-- {word()} -->",
            lambda: f"<select><option>{word()}<option>{word()}</select>",
        ][kind]()

    pages = []
    for _ in range(n):
        wanted: set[str] = set()
        style, count = int(rng.random() < 0.15), int(rng.integers(1, 14)) if rng.random() < 0.75 else int(rng.integers(10, 70))

        def block(tag: str | None = None, wanted=wanted, style=style) -> str:
            text = sentence(1, 8) if tag in ("h1", "h2", "h3") else paragraph(style)
            wanted.add(text)
            shown = text
            if rng.random() < 0.2:
                w = text.split(" ")
                k = int(rng.integers(len(w)))
                w[k] = pick(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>"]).format(w[k])
                shown = " ".join(w)
            tag = tag or pick(["p"] * 14 + ["blockquote", "pre", "h2", "h3", "li", "td", "div", "dd", "figcaption"])
            shape = {"li": "<ul><li>{}</li></ul>", "td": "<table><tr><td>{}</td></tr></table>", "dd": "<dl><dd>{}</dd></dl>", "figcaption": "<figure><img src=a><figcaption>{}</figcaption></figure>", "p": pick(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>"])}.get(tag, "<" + tag + ">{}</" + tag + ">")
            return shape.format(shown)

        inner = [block("h1") if rng.random() < 0.8 else ""] + [block() for _ in range(count)]
        if rng.random() < 0.35:
            inner.insert(int(rng.integers(1, len(inner) + 1)), aside_part())
        body = "".join(inner)
        body = pick([
            "<article>{}</article>", "<article>{}</article>", "<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main-content">{}</div>', '<div class="post-body entry">{}</div>',
            '<section class="article-body">{}</section>', '<div class="story"><div class="text">{}</div></div>', '<div class="article">{}</div>', '<div id="content"><article class="post">{}</article></div>', "<div>{}</div>", '<main><div class="entry-content">{}</div></main>', "<section>{}</section>",
        ]).format(body)
        before = [aside_part() for _ in range(int(rng.integers(0, 4)))]
        after = [aside_part() for _ in range(int(rng.integers(0, 4)))]
        if rng.random() < 0.6:
            before.insert(0, pick(["<header>{}</header>", '<div class="header">{}</div>', '<div id="masthead">{}</div>']).format(pick([f"<h1>{sentence(1, 4)}</h1>", f"<p>{sentence(2, 7)}</p>", f'<a href="/">{word()}</a><p>{sentence(2, 6)}</p>'])))
        if rng.random() < 0.75:
            after.append(pick(["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer">{}</div>']).format(pick([f"&copy; {word()}.com &middot; {sentence(3, 12)}", f"<p>{sentence(3, 14)}</p>", f"<ul>{links(4)}</ul>", f"<p>{paragraph()}</p>"])))
        whole = "".join(before) + body + "".join(after)
        if rng.random() < 0.3:
            whole = some("div", ["page", "wrapper", "container", "site", "layout"], whole)
        pages.append((f"<!DOCTYPE html><html><head><title>{sentence(1, 6)}</title><style>p{{}}</style></head><body>{whole}" + pick(["</body></html>", ""]), wanted))
    return pages


def extract(model: Model, pages: list[str]) -> list[str]:
    """The blocks whose marginal is at least a half, in page order."""
    trees = [parse(p) for p in pages]
    f = forest(trees)
    one = model.marginals(f)[0] if len(f.parent) else np.zeros(0)
    out, base = [], 0
    for tree in trees:
        out.append("\n\n".join(t for k, t in enumerate(tree.text) if t is not None and one[base + k] >= 0.5))
        base += len(tree.tag)
    return out


def main_text(pages: DataFrame, most_pages: int = 400) -> DataFrame:
    """page_id, url, text (main text, '' if none) and n_chars for every row of (page_id, url, html).

    The whole html is read. Null or empty html gives empty text; repeated rows give the same text; an empty table
    gives no rows. The model is fitted on `most_pages` labelled pages, whatever the table.
    """
    bound_batches(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(fit(labelled_pages(most_pages)))
    kinds = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                part = batch.slice(a, 100)
                texts = extract(model.value, [h or "" for h in part.column("html").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    found = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, ", ".join([*kinds, "text string"]))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
