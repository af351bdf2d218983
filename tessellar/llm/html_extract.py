"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: the text between one block-level tag and the
next.  Each block is a vector of its tag path (hashed tags, class, id and role
words), its hashed words and a few measures.  A bidirectional LSTM reads the
blocks of the whole page in order and labels each as article or not, so that a
block is judged by its whole page.  Training and scoring are plain numpy.
"""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_fields

#: Pages of the table that are learnt from, at most; pages of invented layouts beside them.
SAMPLE, INVENTED = 192, 320
#: Widths of the path, word and measure parts of a block's vector; units a direction.
PATH, WORDS, MEASURES, UNITS = 64, 32, 8, 24
#: Open elements around a block that its path tells, the innermost ones.
DEEP = 48
EPOCHS, RATE, SEED = 6, 0.01, 515151

#: Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template svg textarea select iframe object".split())
OUTSIDE = frozenset("head nav footer aside form header menu dialog button fieldset".split())
INSIDE = frozenset("article main".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*|[^>]*)>|<[!?][^>]*>", re.S)
_OPEN = re.compile(r"<!--.*", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"\w+")


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


@lru_cache(maxsize=20_000)
def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    """A tag as path words: its name, and it with each class, id and role word."""
    found = [w.lower() for _, *v in _NAMES.findall(attributes) for w in _WORD.findall("".join(v).replace("-", " ").replace("_", " "))]
    return (tag, *[f".{w}" for w in dict.fromkeys(found)])


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order; broken markup is read leniently."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = in_link = 0
    open_: Counter[str] = Counter()
    at = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(tuple(w for _, m in stack[-DEEP:] for w in m), text, linked))
            parts.clear()
        linked = 0

    size = len(page)
    last = page.rfind(">") + 1  # no tag ends after it: what follows is text, but for an open comment
    while at < size:
        m = (_TAG.search(page, at, last) if at < last else None) or _OPEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if m.re is _OPEN or m[0].startswith("<!--") and not m[0].endswith("-->"):
            break
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in INLINE:
            if tag == "a":
                in_link = not m[1]
            elif tag == "br":
                parts.append(" ")
            continue
        close()
        in_link = 0
        if m[1]:
            if open_[tag]:  # else a look through a deep stack is in vain
                while stack[-1][0] != tag:
                    open_[stack.pop()[0]] -= 1
                open_[stack.pop()[0]] -= 1
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at) if not m[3].endswith("/") else None
            at = end.end() if end else (at if m[3].endswith("/") else size)
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        # a new item or paragraph ends an open one
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or tag[0] == "h" and tag[1:].isdigit():
            same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            barrier = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",)}.get(tag, ("div", "section", "article", "li", "td", "blockquote"))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in barrier:
                    break
                if stack[i][0] in same:
                    open_.subtract(t for t, _ in stack[i:])
                    del stack[i:]
                    break
        elif stack and stack[-1][0] == "p":
            open_[stack.pop()[0]] -= 1
        open_[tag] += 1
        stack.append((tag, _marks(tag, m[3].strip())))
    close()
    return out


@lru_cache(maxsize=200_000)
def _slot(word: str, width: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % width


def vectors(found: list[Block]) -> np.ndarray:
    """(blocks, PATH + WORDS + MEASURES)."""
    n = len(found)
    x = np.zeros((n, PATH + WORDS + MEASURES), np.float32)
    for i, b in enumerate(found):
        deep = len(b.path)
        for k, w in enumerate(b.path):
            x[i, _slot(w, PATH)] += 1 if w[0] == "." else 0.5 + 0.5 * (k + 1) / deep
        words = _WORD.findall(b.text.lower())
        if words:
            h = np.bincount([_slot(w, WORDS) for w in words], minlength=WORDS)
            x[i, PATH : PATH + WORDS] = np.sqrt(h / len(words))
        size = len(b.text)
        x[i, PATH + WORDS :] = (
            math.log1p(size) / 8, min(1.0, b.linked / size), min(1.0, 10 * sum(map(b.text.count, ".,;:!?")) / size), math.log1p(len(words)) / 6,
            b.text[-1] in ".!?…", i / n, (n - 1 - i) / n, 1.0,
        )
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Weights of a bidirectional LSTM with one output a block."""

    def __init__(self, width: int = PATH + WORDS + MEASURES, units: int = UNITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.units = units
        self.w: dict[str, np.ndarray] = {"out": rng.normal(0, 0.1, 2 * units).astype(np.float32), "bias": np.zeros(1, np.float32)}
        for d in ("f", "b"):
            self.w[f"x{d}"] = rng.normal(0, 1 / math.sqrt(width), (width, 4 * units)).astype(np.float32)
            self.w[f"h{d}"] = rng.normal(0, 1 / math.sqrt(units), (units, 4 * units)).astype(np.float32)
            self.w[f"c{d}"] = np.concatenate([np.zeros(units), np.ones(units), np.zeros(2 * units)]).astype(np.float32)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """Hidden states (time, batch, units) in one direction; padding leaves states as they are."""
        time, n, _ = x.shape
        u = self.units
        z_x = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = np.zeros((n, u), np.float32), np.zeros((n, u), np.float32)
        out, held = np.zeros((time, n, u), np.float32), []
        for t in range(time) if d == "f" else range(time - 1, -1, -1):
            z = z_x[t] + h @ self.w[f"h{d}"]
            s = _sigmoid(z[:, : 3 * u])
            i, f, o, g = s[:, :u], s[:, u : 2 * u], s[:, 2 * u :], np.tanh(z[:, 3 * u :])
            m = mask[t][:, None]
            c_new = np.where(m, f * c + i * g, c)
            tanh = np.tanh(c_new)
            h_new = np.where(m, o * tanh, h)
            if keep:
                held.append((t, h, c, i, f, o, g, tanh, m))
            h, c = h_new, c_new
            out[t] = h
        return out, held

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            longest = len(pages[order[min(len(order), at + 128) - 1]])
            some = order[at : at + max(1, min(128, 40_000 // longest))]
            at += len(some)
            x, mask = _padded([pages[i] for i in some])
            hf, hb = self._pass(x, mask, "f", False)[0], self._pass(x, mask, "b", False)[0]
            p = _sigmoid(np.concatenate([hf, hb], axis=2) @ self.w["out"] + self.w["bias"])
            for j, i in enumerate(some):
                out[i] = p[: len(pages[i]), j]
        return out

    def gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, mask = _padded(pages)
        y = np.zeros(mask.shape, np.float32)
        for j, v in enumerate(labels):
            y[: len(v), j] = v
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        ran = {d: self._pass(x, mask, d, True) for d in ("f", "b")}
        both = np.concatenate([ran["f"][0], ran["b"][0]], axis=2)
        off = np.where(mask, _sigmoid(both @ self.w["out"] + self.w["bias"]) - y, 0) / mask.sum()
        grads["out"] = np.tensordot(off, both, ((0, 1), (0, 1)))
        grads["bias"][:] = off.sum()
        u = self.units
        for k, d in enumerate(("f", "b")):
            back = off[:, :, None] * self.w["out"][k * u : (k + 1) * u]
            dh, dc = np.zeros((x.shape[1], u), np.float32), np.zeros((x.shape[1], u), np.float32)
            for t, h, c, i, f, o, g, tanh, m in reversed(ran[d][1]):
                dh = dh + back[t]
                on = dh * m
                dcell = dc + on * o * (1 - tanh**2) * m
                live = dcell * m
                dz = np.concatenate([live * g * i * (1 - i), live * c * f * (1 - f), on * tanh * o * (1 - o), live * i * (1 - g**2)], axis=1)
                grads[f"x{d}"] += x[t].T @ dz
                grads[f"h{d}"] += h.T @ dz
                grads[f"c{d}"] += dz.sum(axis=0)
                dh = np.where(m, dz @ self.w[f"h{d}"].T, dh)
                dc = np.where(m, live * f, dc)
        return grads

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS) -> None:
        """Adam over batches of pages of like length, in a fixed order."""
        rng = np.random.default_rng(SEED)
        first, second, step = {}, {}, 0
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        groups = [order[k : k + 16] for k in range(0, len(order), 16)]
        for _ in range(epochs):
            for j in rng.permutation(len(groups)):
                step += 1
                g = self.gradients([pages[i] for i in groups[j]], [labels[i] for i in groups[j]])
                for k, v in g.items():
                    v = np.clip(v, -1, 1)
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * v
                    second[k] = 0.999 * second.get(k, 0) + 0.001 * v * v
                    self.w[k] -= (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    time = max(map(len, pages))
    x = np.zeros((time, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((time, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
        mask[: len(p), j] = True
    return x, mask


def weak_labels(found: list[Block]) -> np.ndarray | None:
    """1 inside an article or main element but in no menu, footer, form or
    advert there; None for a page that marks no article."""
    inside = [not INSIDE.isdisjoint(b.path) for b in found]
    if not any(inside):
        return None
    shut = OUTSIDE | {f".{w}" for w in _BESIDE}
    return np.array([i and shut.isdisjoint(b.path) for i, b in zip(inside, found, strict=True)], np.float32)


#: Class and id words by which sites mark what is and isn't the article.
_BESIDE = tuple("ad ads advert advertisement banner promo sponsored sidebar widget comment comments reply respond disqus cookie consent notice alert popup modal newsletter subscribe signup share social related recommended breadcrumb breadcrumbs pagination menu nav navbar navigation toolbar footer copyright login search form tags meta".split())
_ARTICLE = tuple("content post entry article story body main text".split())


def invent(texts: list[str], rng: random.Random) -> tuple[str, list[bool]]:
    """A page of an invented layout around given texts, and whether each of its
    blocks, in order, is of the article."""
    page, truth = [], []

    def words(a: int, b: int) -> str:
        w = rng.choice(texts).split() or ["x"]
        n = rng.randint(a, b)
        s = rng.randrange(max(1, len(w) - n))
        return " ".join(w[s : s + n]) or "x"

    def put(before: str, text: str, after: str, good: bool) -> None:
        page.append(f"{before}{html.escape(text)}{after}")
        truth.append(good)

    def links(outer: str, inner: str, n: int) -> None:
        page.append(f"<{outer}>")
        if inner == "li":
            page.append("<ul>")
        for _ in range(n):
            put(f'<{inner}><a href="/{rng.randrange(99)}">', words(1, 3), f"</a></{inner}>", False)
        page.append(("</ul>" if inner == "li" else "") + f"</{outer.split()[0]}>")

    def named(tag: str, pool: tuple[str, ...]) -> str:
        return f'{tag} {rng.choice(("class", "id"))}="{rng.choice(("", "", "site-", "page-", "block "))}{rng.choice(pool)}{rng.choice(("", "", "-wrap", "-box", " col"))}"'

    def beside(tag: str = "div") -> None:
        kind = rng.choice(_BESIDE)
        page.append(f"<{named(tag, (kind,))}>")
        for _ in range(rng.randint(1, 4 if "comment" in kind or "repl" in kind else 2)):
            t = rng.choice(("p", "div", "span", ""))
            put(f"<{t}>" if t else "", words(2, 40), f"</{t}>" if t else "<hr>", False)
            if t == "span":
                page.append("<hr>")
        page.append(f"</{tag}>")

    page.append("<html><head>")
    put("<title>", words(4, 9), "</title>", False)
    page.append("</head><body>")
    if rng.random() < 0.6:
        page.append("<header>")
        put(rng.choice(("<h1>", "<div>", "<p>")), words(1, 5), "<hr>", False)
        page.append("</header>")
    if rng.random() < 0.9:
        links(rng.choice(("nav", named("div", ("menu", "nav", "navbar", "toolbar", "breadcrumb")))), rng.choice(("li", "p", "div")), rng.randint(2, 9))
    for _ in range(rng.randint(0, 3)):
        beside(rng.choice(("div", "div", "aside", "section")))
    shell = rng.choice(("article", "article", "article", "main", "main", named("div", _ARTICLE), named("div", _ARTICLE), named("section", _ARTICLE)))
    page.append(f"<{shell}>")
    if rng.random() < 0.8:
        put("<h1>", words(3, 12), "</h1>", True)
    for _ in range(rng.randint(1, 12)):
        kind = rng.random()
        if kind < 0.75:
            put("<p>" + "<b>" * (rng.random() < 0.2), words(4, 120), rng.choice(("</p>", "</p>", "<br>")), True)
        elif kind < 0.83:
            put("<h2>", words(2, 8), "</h2>", True)
        elif kind < 0.9:
            page.append("<ul>")
            for _ in range(rng.randint(1, 4)):
                put("<li>", words(3, 20), "</li>", True)
            page.append("</ul>")
        elif kind < 0.94:
            put("<blockquote>", words(5, 40), "</blockquote>", True)
        else:
            beside(rng.choice(("div", "aside", "form")))
    page.append(f"</{shell.split()[0]}>")
    for _ in range(rng.randint(0, 3)):
        beside(rng.choice(("div", "section", "aside", "form")))
    if rng.random() < 0.9:
        page.append("<footer>" if rng.random() < 0.7 else '<div class="footer">')
        for _ in range(rng.randint(1, 3)):
            put("<p>" if rng.random() < 0.5 else "<div>", rng.choice(("© ", "")) + words(2, 20), "<hr>", False)
    return "".join(page), truth


def fit(pages: DataFrame, *, key: str = "url", page: str = "html") -> Labeller:
    """A labeller trained on at most SAMPLE pages of the table, those whose key
    hashes lowest, labelled by the article elements they mark, and on INVENTED
    pages of invented layouts around their texts.  The same at every run."""
    rows = pages.select(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{page}`")).alias("_h"), F.col(f"`{page}`").alias("_p")).filter("_p is not null")
    # hashes alone are sorted; SAMPLE of them fetch their pages, one of each
    picked = F.broadcast(rows.select("_h").distinct().orderBy("_h").limit(SAMPLE))
    got = sorted(r["_p"] for r in rows.join(picked, "_h").groupBy("_h").agg(F.min("_p").alias("_p")).collect())
    parsed = [blocks(p) for p in got]
    texts = [b.text for found in parsed for b in found] or ["a page without any text"]
    held = [(vectors(found), y) for found in parsed if found and (y := weak_labels(found)) is not None]
    rng = random.Random(SEED)
    for _ in range(INVENTED):
        made, truth = invent(texts, rng)
        found = blocks(made)
        if len(found) == len(truth):
            held.append((vectors(found), np.array(truth, np.float32)))
    model = Labeller()
    model.train([x for x, _ in held], [y for _, y in held])
    return model


def extract(pages: DataFrame, model: Labeller, *, page: str = "html", spans: bool = False) -> DataFrame:
    """pages with text, the article's blocks joined by newlines, and n_chars,
    its code points; with spans, also n_blocks and kept, each block's label.

    Character references are decoded and white space inside a block becomes
    one space.  A null or empty page, and one without an article, gives an
    empty text.  Whole pages are read; repeated rows give a text each; columns
    pass through, but those of the added names are replaced; an empty table
    gives an empty table.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def fn(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for t in tables:
            texts, labels = [], []
            given = t.column("page").to_pylist()
            for at in range(0, len(given), 512):
                found = [blocks(p) for p in given[at : at + 512]]
                for own, p in zip(found, held.value.probabilities([vectors(f) for f in found]), strict=True):
                    keep = p >= 0.5
                    texts.append("\n".join(b.text for b, k in zip(own, keep, strict=True) if k))
                    labels.append(keep.tolist())
            out = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())}
            if spans:
                out |= {"n_blocks": pa.array([len(x) for x in labels], pa.int32()), "kept": pa.array(labels, pa.list_(pa.bool_()))}
            yield pa.table(out)

    more = [("n_blocks", T.IntegerType()), ("kept", T.ArrayType(T.BooleanType()))] if spans else []
    return with_fields(pages, fn, {"page": page}, [("text", T.StringType()), ("n_chars", T.LongType()), *more])
