"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut at block-level tags into leaf blocks, each with the elements around it. Features are the
ancestors' tags and the words of their class, id and role, and length, links, punctuation and digits of the text. The field
(states: boilerplate, main) is trained on labelled pages by gradient ascent of the likelihood and
decoded by Viterbi. The main blocks' texts make the page's text.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sphera.llm import labelled_pages
from sphera.llm.kernels import slices, table

#: A tag steps over quoted attribute values, which may hold a ">".
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)>", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-zA-Z]+")
#: Elements whose content is not text, and the inline ones; every other tag ends a block.
_RAW = {"script", "style", "noscript", "template", "title", "textarea", "svg", "iframe", "object", "select"}
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of these.
_ENDS = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_IN_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Block(NamedTuple):
    text: str  # white space is one blank, trimmed
    features: list[str]


def _around(tag: str, attributes: str) -> list[str]:
    out = [f"<{tag}"]
    for m in _ATTRIBUTE.finditer(attributes):
        out += [f".{w.lower()}" for w in _NAME.findall(m[1] or m[2] or m[3] or "")]
    return out


def _of_text(text: str, linked: int) -> list[str]:
    n = len(text)
    out = [f"len{min(6, n.bit_length() // 2)}", "all"]
    if linked * 10 >= n * 8:
        out.append("linked")
    elif linked:
        out.append("links")
    if text[-1] in ".!?:":
        out.append("end")
    if any(c in text for c in ".,;"):
        out.append("marks")
    if text[0] == "©" or "©" in text:
        out.append("copyright")
    if any(c.isdigit() for c in text):
        out.append("digits")
    return out


def blocks(page: str | None) -> tuple[list[Block], list[int]]:
    """Leaf blocks in page order, and the place in the page where each begins. Null or empty pages have none."""
    page = page or ""
    out: list[Block] = []
    begins: list[int] = []
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    linked, in_link, at, begin = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            path = dict.fromkeys(f for _, fs in stack for f in fs)
            if stack:
                path[f"in{stack[-1][0]}"] = None
            out.append(Block(text, [*path, *_of_text(text, linked)]))
            begins.append(begin)
        linked = 0

    last = page.rfind(">") + 1
    for m in iter(lambda: _TAG.search(page, at, last), None):
        if m.start() > at:
            if not parts:
                begin = at
            parts.append(html.unescape(page[at : m.start()]))  # each by itself: a reference ends where a tag begins
            if in_link:
                linked += m.start() - at
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        closing = bool(m[1])
        if tag in _RAW and not closing:
            if (end := _RAW_END[tag].search(page, at)) is None:
                if tag != "title":
                    at = len(page)
            else:
                at = end.end()
            if tag not in ("svg", "select"):
                continue
            parts.append(" ")
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = max(0, in_link + (-1 if closing else 1))
            continue
        flush()
        in_link = 0
        if tag in _VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in _IN_P and stack and stack[-1][0] == "p":
            stack.pop()
        while stack and stack[-1][0] in _ENDS.get(tag, ()):
            stack.pop()
        stack.append((tag, _around(tag, m[3])))
    if at < len(page):
        if not parts:
            begin = at
        parts.append(page[at:])
    flush()
    return out, begins


class Model(NamedTuple):
    weights: dict[str, tuple[float, float]]  # of a feature for the two states
    step: np.ndarray  # 2 x 2
    start: np.ndarray


def _forward_backward(unary: np.ndarray, mask: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of states (pages x blocks x 2) and of steps (2 x 2, summed), and the log partition; padded blocks are masked at the end."""
    pages, n, _ = unary.shape
    fore, back = np.zeros_like(unary), np.zeros_like(unary)
    fore[:, 0] = unary[:, 0] + start
    for t in range(1, n):
        new = np.logaddexp.reduce(fore[:, t - 1, :, None] + step, 1) + unary[:, t]
        fore[:, t] = np.where(mask[:, t, None], new, fore[:, t - 1])
    for t in range(n - 2, -1, -1):
        new = np.logaddexp.reduce(step + (unary[:, t + 1] + back[:, t + 1])[:, None], 2)
        back[:, t] = np.where(mask[:, t + 1, None], new, back[:, t + 1])
    z = np.logaddexp.reduce(fore[:, -1], 1)
    state = np.exp(fore + back - z[:, None, None]) * mask[..., None]
    steps = np.zeros((2, 2))
    for t in range(1, n):
        joint = fore[:, t - 1, :, None] + step + (unary[:, t] + back[:, t])[:, None] - z[:, None, None]
        steps += (np.exp(joint) * mask[:, t, None, None]).sum(0)
    return state, steps, float(z.sum())


def fit(training: list[tuple[list[Block], list[bool]]], rounds: int = 120, rate: float = 0.2, l2: float = 0.02, least: int = 3) -> Model:
    """Maximum likelihood with an L2 penalty, by Adam over all pages at once. Features of fewer than `least` blocks are left out."""
    training = [t for t in training if t[0]]
    seen: dict[str, int] = {}
    for page, _ in training:
        for b in page:
            for f in b.features:
                seen[f] = seen.get(f, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    width = max((len(p) for p, _ in training), default=1)
    mask, gold = np.zeros((len(training), width), bool), np.zeros((len(training), width), int)
    at, what = [], []
    for i, (page, labels) in enumerate(training):
        mask[i, : len(page)] = True
        gold[i, : len(page)] = labels
        for j, b in enumerate(page):
            ids = [names[f] for f in b.features if f in names]
            at += [i * width + j] * len(ids)
            what += ids
    at, what = np.array(at, int), np.array(what, int)
    target = np.eye(2)[gold] * mask[..., None]
    gold_steps = np.zeros((2, 2))
    np.add.at(gold_steps, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
    flat = np.zeros(2 * len(names) + 6)
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for turn in range(1, rounds + 1):
        w, step, start = flat[:-6].reshape(-1, 2), flat[-6:-2].reshape(2, 2), flat[-2:]
        unary = np.stack([np.bincount(at, w[what, s], mask.size) for s in (0, 1)], 1).reshape(*mask.shape, 2)
        state, steps, _ = _forward_backward(unary, mask, step, start)
        error = (target - state).reshape(-1, 2)
        g = np.concatenate([
            np.stack([np.bincount(what, error[at, s], len(names)) for s in (0, 1)], 1).ravel(), (gold_steps - steps).ravel(), (target - state)[:, 0].sum(0)
        ]) - l2 * flat
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        flat = flat + rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    w = flat[:-6].reshape(-1, 2)
    return Model({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}, flat[-6:-2].reshape(2, 2), flat[-2:])


def decode(model: Model, page: list[Block]) -> list[bool]:
    """The best state sequence, by Viterbi."""
    get = model.weights.get
    (s00, s01), (s10, s11) = model.step.tolist()
    back: list[tuple[int, int]] = []
    a = b = 0.0
    for t, block in enumerate(page):
        u = v = 0.0
        for f in block.features:
            if (w := get(f)) is not None:
                u += w[0]
                v += w[1]
        if not t:
            a, b = model.start[0] + u, model.start[1] + v
            continue
        to_a, to_b = (0 if a + s00 >= b + s10 else 1), (0 if a + s01 >= b + s11 else 1)
        a, b = (b + s10 if to_a else a + s00) + u, (b + s11 if to_b else a + s01) + v
        back.append((to_a, to_b))
    if not page:
        return []
    state = int(b > a)
    out = [state]
    for step in reversed(back):
        state = step[state]
        out.append(state)
    return [bool(s) for s in out[::-1]]


def extract(model: Model, page: str | None) -> str:
    found, _ = blocks(page)
    return "\n".join(b.text for b, main in zip(found, decode(model, found), strict=True) if main)


def labelled(n: int, seed: int = 3) -> list[tuple[list[Block], list[bool]]]:
    """Blocks and labels of n made-up pages: a block has the label of the piece in which it begins."""
    out = []
    for pieces in labelled_pages.pages(n, seed):
        text, ends, labels = "", [], []
        for piece, label in pieces:
            text += piece
            ends.append(len(text))
            labels.append(label)
        found, begins = blocks(text)
        at = np.searchsorted(ends, begins, "right")
        out.append((found, [bool(labels[i]) for i in at]))
    return out


def train(n: int = 600, seed: int = 3) -> Model:
    return fit(labelled(n, seed))


def text_of(pages: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """pages with the main text of `html` in `column` (replaced if there); empty for null, empty and textless pages. Repeated rows stay."""
    held = pages.sparkSession.sparkContext.broadcast(model)  # as large as the feature names
    kept = pages.drop(column)
    names = kept.columns

    def run(batches):
        for rows, _, _ in slices(batches, "html"):
            texts = [extract(held.value, p) for p in rows.column(names.index("html")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*names, column])

    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField(column, T.StringType())]))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: page_id, url, text and its length in code points of every page."""
    pages = text_of(table(spark, sf_dir, "pages").select("page_id", "url", "html"), train())
    return pages.selectExpr("page_id", "url", "text", "cast(length(text) as bigint) as n_chars")
