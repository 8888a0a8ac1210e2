"""Main text of web pages: a recurrent labeller over the blocks of a page.

A page is cut into leaf blocks, runs of text between block-level tags. Each block
becomes a vector of its whole tag path (elements, class and id words; summed from
element to element, so that deep pages stay linear) and one of all its hashed words. A bidirectional LSTM reads the blocks of the whole page in order
and back again, and labels each block as main text or not from everything around
it. The model is numpy only; it is trained from a seed on made-up pages
(``html_pages``) whose labels are known, once per driver process.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm._shared import with_columns
from marketloom.llm.html_pages import PageMaker

#: Elements inside which text runs on.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr img br input".split())
#: Formulae run on too; what annotates one is no text of the page.
ANNOTATIONS = frozenset("annotation annotation-xml".split())
INLINE |= ANNOTATIONS | frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
DROPPED = frozenset("script style noscript template title svg iframe object textarea select option canvas audio video head".split())
#: Of these, the ones that leave a sentence whole around them; the content of buttons is left out likewise.
PASSED_OVER = DROPPED - {"head"} | {"button"}
DROPPED |= PASSED_OVER
#: Those whose content isn't markup.
RAW = frozenset("script style title textarea iframe".split())
#: Elements that may stand in a head; any other one, or a text, ends it.
_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements that end an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())

_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
_ATTRIBUTES = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_CLASS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PLAIN = re.compile(r"[a-z]+")

#: Rows of the table of learned vectors; words and path parts are hashed to them.
TABLE = 4096
#: Width of a vector, of a direction's state.
VECTOR, STATE = 24, 20
#: Made-up pages, passes over them and pages per step of training.
TRAIN_PAGES, PASSES, STEP_PAGES = 900, 3, 12
#: Blocks times pages that are labelled at once, and words whose vectors are summed at once.
AT_ONCE, WORDS_AT_ONCE = 1 << 15, 1 << 17


@dataclass(slots=True, eq=False)
class Element:
    """An open element: the tokens that no element around it has, and the last two of its path."""

    parent: "Element | None"
    tokens: tuple[str, ...]
    tail: tuple[str, ...]


@dataclass(slots=True)
class Block:
    """A text, the element that it stands in, and whether most of it is links."""

    inside: Element | None
    linked: bool
    text: str


def blocks_of(html: str | None) -> list[Block]:
    """Leaf blocks of a page in order: texts with single spaces, character references decoded."""
    html = html or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], Element]] = []
    opened: Counter[str] = Counter()  # how often each element is on the stack
    known: Counter[str] = Counter()  # and each token
    held: list[str] = []
    linked = plain = dropped = 0
    inside: Element | None = None
    quoted, annotated = True, True

    def flush() -> None:
        nonlocal linked, plain
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            if text:
                out.append(Block(inside, linked > plain, text))
            held.clear()
        linked = plain = 0

    def push(tag: str, tokens: tuple[str, ...]) -> None:
        nonlocal dropped
        parent = stack[-1][2] if stack else None
        new = tuple(t for t in dict.fromkeys(tokens) if not known[t])
        known.update(tokens)
        stack.append((tag, tokens, Element(parent, new, ((parent.tail if parent else ()) + tokens)[-2:])))
        opened[tag] += 1
        dropped += tag in DROPPED

    def pop() -> str:
        nonlocal dropped
        tag, tokens, _ = stack.pop()
        opened[tag] -= 1
        known.subtract(tokens)
        dropped -= tag in DROPPED
        return tag

    def text_run(a: int, b: int) -> None:
        nonlocal linked, plain, inside
        if dropped and stack[-1][0] == "head" and html[a:b].strip():
            pop()
        if b > a and not dropped:
            if not held:
                inside = stack[-1][2] if stack else None
            held.append(html[a:b])
            n = len(html[a:b].strip())
            if links:
                linked += n
            else:
                plain += n

    at, links, n = 0, 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text_run(at, n)
            break
        follow = html[lt + 1 : lt + 2]
        if follow in ("!", "?"):
            text_run(at, lt)
            if html.startswith("<!--", lt):
                # the dashes that open a comment can close it
                end = html.find("-->", lt + 2)
                at = n if end < 0 else end + 3
            else:
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        name = _NAME.match(html, lt + 1)
        if not name:
            text_run(at, lt + 1)
            at = lt + 1
            continue
        text_run(at, lt)
        rest = _ATTRIBUTES.match(html, name.end()) if quoted else None
        if rest:
            end = rest.end()
        else:  # an unclosed quote: tags end at the next bracket from here on
            quoted = False
            end = html.find(">", name.end()) + 1 or n
        tag, at = name.group().lower(), end
        if tag[0] == "/":
            tag = tag[1:]
            if tag == "a" and not dropped:
                links = max(0, links - 1)
            if tag not in INLINE and opened[tag]:
                while pop() != tag:
                    pass
            if tag not in INLINE and tag not in PASSED_OVER and not dropped:
                flush()
            continue
        if dropped and stack[-1][0] == "head" and tag not in _HEAD:
            pop()
        if tag == "br":
            if not dropped and held:
                held.append(" ")
            continue
        if tag in ANNOTATIONS and annotated and html[end - 2 : end] != "/>":
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, end)
            at, annotated = (close.end(), True) if close else (end, False)  # an unclosed one hides nothing
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b", re.I).search(html, end)
            at = n if not close else (html.find(">", close.end()) + 1 or n)
            continue
        if tag == "a" and not dropped:
            links += 1
        if tag in INLINE:
            continue
        if tag == "body" and dropped:
            kept = [s[:2] for s in stack if s[0] not in DROPPED]
            while stack:
                pop()
            for own in kept:
                push(*own)
        if tag not in PASSED_OVER and not dropped:
            flush()
            links = 0
        if tag in _ENDS_P:
            while stack and stack[-1][0] == "p":
                pop()
        if tag in ("li", "dd", "dt", "tr", "td", "th") and stack and stack[-1][0] == tag:
            pop()
        if tag in ("option", "optgroup"):
            while stack and stack[-1][0] in ("option", tag):
                pop()
        if tag in VOID or html[end - 2 : end] == "/>":
            continue
        names = [a or b or c for a, b, c in _CLASS.findall(html[name.end() : end - 1])]
        push(tag, (tag, *(f".{w}" for x in names for w in _PLAIN.findall(x.lower()))))
    flush()
    return out


_CODES: dict[str, int] = {}


def _code(token: str) -> int:
    known = _CODES.get(token)
    if known is None:
        if len(_CODES) > 200_000:
            _CODES.clear()
        known = _CODES[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % TABLE
    return known


def block_codes(block: Block) -> tuple[list[int], list[int]]:
    """Rows of the table for the end of the path and for the words of a block; the shape of the text counts as words."""
    words = block.text.lower().split()
    tail = block.inside.tail if block.inside else ()
    path = [_code("<a"), *(_code(f"<<{p}") for p in (*tail[-1:], "a"))] if block.linked else [_code(f"<<{p}") for p in tail]
    shape = [_code(f"#long{len(words).bit_length()}"), _code(f"#end{block.text[-1]}" if block.text[-1] in ".?!:" else "#end")]
    # the shape keeps its share of the mean however many words there are
    return path, [*map(_code, words), *shape * max(3, len(words) // 13)]


def page_codes(blocks: list[Block]):
    """Flat codes of all blocks of a page with their lengths, for ends of paths and for words; then the elements.

    Of the elements, outer ones first, there are codes and lengths, the place of
    each one's parent and that of each block's element (-1: none).
    """
    places: dict[int, int] = {}
    parents: list[int] = []
    opened: list[list[int]] = []
    for block in blocks:
        above, node = [], block.inside
        while node is not None and id(node) not in places:
            above.append(node)
            node = node.parent
        for node in reversed(above):
            places[id(node)] = len(parents)
            parents.append(places[id(node.parent)] if node.parent else -1)
            opened.append([_code(f"<{t}") for t in node.tokens])
    paths, words = zip(*map(block_codes, blocks), strict=True) if blocks else ((), ())
    flat = lambda lists: np.fromiter((c for x in lists for c in x), np.int64)
    sizes = lambda lists: np.array([len(x) for x in lists], np.int64)
    inside = np.array([places[id(b.inside)] if b.inside else -1 for b in blocks], np.int64)
    return flat(paths), sizes(paths), flat(words), sizes(words), flat(opened), sizes(opened), parents, inside


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _sums(table: np.ndarray, codes: np.ndarray, sizes: np.ndarray, mean: bool) -> np.ndarray:
    """Sums (or means) of table rows over runs of codes, some codes at a time."""
    out, owner = np.zeros((len(sizes), table.shape[1])), np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(codes), WORDS_AT_ONCE):
        part, own = codes[at : at + WORDS_AT_ONCE], owner[at : at + WORDS_AT_ONCE]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        out[own[first]] += np.add.reduceat(table[part], first, axis=0)
    return out / sizes[:, None] if mean else out


class Labeller:
    """A bidirectional LSTM over block vectors with a logistic label per block."""

    def __init__(self, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        width = 2 * VECTOR
        self.p = {"table": r.normal(0, 0.3, (TABLE, VECTOR))}
        for d in "fb":
            self.p[f"w{d}"] = r.normal(0, 1 / np.sqrt(width + STATE), (width + STATE, 4 * STATE))
            self.p[f"c{d}"] = np.concatenate([np.ones(STATE), np.zeros(3 * STATE)])
        self.p["out"] = r.normal(0, 0.1, 2 * STATE + width)
        self.p["bias"] = np.zeros(1)

    def vectors(self, codes) -> np.ndarray:
        paths, path_sizes, words, word_sizes, opened, opened_sizes, parents, inside = codes
        # the last row stands for no element
        whole = np.vstack([_sums(self.p["table"], opened, opened_sizes, False), np.zeros((1, VECTOR))])
        for at, parent in enumerate(parents):
            whole[at] += whole[parent]
        return np.hstack([_sums(self.p["table"], paths, path_sizes, False) + whole[inside], _sums(self.p["table"], words, word_sizes, True)])

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States of one direction over x (time, pages, width); padded steps pass the state on."""
        w, c = self.p[f"w{d}"], self.p[f"c{d}"]
        steps, pages = x.shape[:2]
        given = x @ w[: x.shape[2]] + c
        h = cell = np.zeros((pages, STATE))
        states, saved = np.empty((steps, pages, STATE)), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = given[t] + h @ w[x.shape[2] :]
            gates = _sigmoid(g[:, : 3 * STATE])
            f, i, o, new = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :], np.tanh(g[:, 3 * STATE :])
            m = mask[t][:, None]
            next_cell = m * (f * cell + i * new) + (1 - m) * cell
            squashed = np.tanh(next_cell)
            next_h = m * o * squashed + (1 - m) * h
            if keep:
                saved.append((t, h, cell, f, i, o, new, squashed, m))
            h, cell = next_h, next_cell
            states[t] = h
        return states, saved

    def _pad(self, pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        longest = max(map(len, pages))
        x, mask = np.zeros((longest, len(pages), 2 * VECTOR)), np.zeros((longest, len(pages)))
        for k, v in enumerate(pages):
            x[: len(v), k], mask[: len(v), k] = v, 1
        return x, mask

    def probabilities(self, pages: list) -> list[np.ndarray]:
        """P(main) of every block of each page, from the pages' codes."""
        vectors = [self.vectors(c) for c in pages]
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(vectors[k])), key=lambda k: len(vectors[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(vectors[order[end]]) <= AT_ONCE:
                end += 1
            own = order[at:end]
            x, mask = self._pad([vectors[k] for k in own])
            hf, hb = self._run(x, mask, "f", False)[0], self._run(x, mask, "b", False)[0]
            p = _sigmoid(np.concatenate([hf, hb, x], axis=2) @ self.p["out"] + self.p["bias"])
            for j, k in enumerate(own):
                out[k] = p[: len(vectors[k]), j]
            at = end
        return out

    def gradients(self, pages: list, labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of a few pages and its gradients."""
        vectors = [self.vectors(c) for c in pages]
        x, mask = self._pad(vectors)
        y = np.zeros(mask.shape)
        for k, v in enumerate(labels):
            y[: len(v), k] = v
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        z = np.concatenate([runs["f"][0], runs["b"][0], x], axis=2)
        p = _sigmoid(z @ self.p["out"] + self.p["bias"])
        n = mask.sum()
        loss = -float((mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n)
        dz = (mask * (p - y) / n)[:, :, None]
        g = {"out": (dz * z).sum((0, 1)), "bias": np.array([dz.sum()])}
        back = dz * self.p["out"]
        dx = back[:, :, 2 * STATE :].copy()
        width = x.shape[2]
        for d, part in (("f", slice(0, STATE)), ("b", slice(STATE, 2 * STATE))):
            w, dh, dc = self.p[f"w{d}"], np.zeros((x.shape[1], STATE)), np.zeros((x.shape[1], STATE))
            dgates = np.zeros((*x.shape[:2], 4 * STATE))
            dw = np.zeros_like(w)
            for t, h, cell, f, i, o, new, squashed, m in reversed(runs[d][1]):
                dh = dh + back[t][:, part]
                inner = m * (dc + dh * o * (1 - squashed**2))
                grown = np.hstack([inner * cell * f * (1 - f), inner * new * i * (1 - i), m * dh * squashed * o * (1 - o), inner * i * (1 - new**2)])
                dgates[t] = grown
                dw[width:] += h.T @ grown
                dc = inner * f + (1 - m) * dc
                dh = grown @ w[width:].T + (1 - m) * dh
            dw[:width] = np.einsum("tpi,tpj->ij", x, dgates, optimize=True)
            g[f"w{d}"], g[f"c{d}"] = dw, dgates.sum((0, 1))
            dx += dgates @ w[:width].T
        table = np.zeros_like(self.p["table"])
        for k, (paths, path_sizes, words, word_sizes, opened, opened_sizes, parents, inside) in enumerate(pages):
            own = dx[: len(path_sizes), k]
            np.add.at(table, paths, np.repeat(own[:, :VECTOR], path_sizes, axis=0))
            whole = np.zeros((len(parents) + 1, VECTOR))
            np.add.at(whole, inside, own[:, :VECTOR])
            for at in range(len(parents) - 1, -1, -1):
                whole[parents[at]] += whole[at]
            np.add.at(table, opened, np.repeat(whole[:-1], opened_sizes, axis=0))
            np.add.at(table, words, np.repeat(own[:, VECTOR:] / word_sizes[:, None], word_sizes, axis=0))
        g["table"] = table
        return loss, g


def made_up_pages(n: int, seed: int) -> list[tuple[tuple, np.ndarray]]:
    """Codes and labels of made-up pages."""
    maker, out = PageMaker(seed), []
    while len(out) < n:
        blocks = blocks_of(maker.page())
        if blocks:
            labels = np.array([float(PageMaker.MARK in b.text) for b in blocks])
            clean = [Block(b.inside, b.linked, b.text.replace(PageMaker.MARK, "").strip() or "x") for b in blocks]
            out.append((page_codes(clean), labels))
    return out


@lru_cache(1)
def trained(pages: int = TRAIN_PAGES, passes: int = PASSES, seed: int = 3) -> Labeller:
    """A labeller trained by Adam steps from a seed; always the same one."""
    model, data = Labeller(seed), made_up_pages(pages, seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    rng, step = np.random.default_rng(seed), 0
    total = passes * (len(data) // STEP_PAGES)
    for _ in range(passes):
        order = rng.permutation(len(data))
        for at in range(0, len(order) - STEP_PAGES + 1, STEP_PAGES):
            own = [data[k] for k in order[at : at + STEP_PAGES]]
            _, g = model.gradients([c for c, _ in own], [y for _, y in own])
            step += 1
            rate = 0.012 * (1 - 0.9 * step / total)
            for k, v in g.items():
                v = np.clip(v, -0.5, 0.5)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                model.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    model.p = {k: v.astype(np.float32).astype(np.float64) for k, v in model.p.items()}
    return model


def main_texts(pages: list[str | None], model: Labeller) -> list[tuple[str, int, int]]:
    """``(main text, number of blocks, number of main blocks)`` of each page."""
    blocks = [blocks_of(h) for h in pages]
    out = []
    for own, p in zip(blocks, model.probabilities([page_codes(b) for b in blocks]), strict=True):
        main = [b.text for b, q in zip(own, p, strict=True) if q >= 0.5]
        out.append(("\n\n".join(main), len(own), len(main)))
    return out


def extract_text(pages: DataFrame, *, html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """All columns of ``pages`` plus ``text, n_chars, n_blocks, n_main``.

    ``text`` is the page's main text: its main blocks in order, joined by empty
    lines, each with single spaces and decoded character references. Pages are
    read whole and independently; nothing is shuffled. A null or empty page, or
    one without a main block, has the empty text; rows that repeat give the same
    text each. Input columns named like an added one give way; empty tables stay
    empty.
    """
    shared = pages.sparkSession.sparkContext.broadcast((model or trained()).p)

    @F.pandas_udf("text string, n_blocks int, n_main int")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Labeller()
        own.p = shared.value
        for batch in batches:
            held = batch.tolist()
            rows = [row for at in range(0, len(held), 256) for row in main_texts(held[at : at + 256], own)]
            yield pd.DataFrame(rows, columns=["text", "n_blocks", "n_main"])

    found = with_columns(pages, __found=extract(F.col(html_col)))
    return with_columns(found, text=F.col("__found.text"), n_chars=F.char_length("__found.text").cast("long"), n_blocks=F.col("__found.n_blocks"), n_main=F.col("__found.n_main")).drop("__found")
