"""HTML extraction (operator 4): a linear-chain conditional random field.

A page is read as a stream of tags and text; each stretch of text between
block-level tags is a leaf block.  Every block has two labels, article or not,
and a score from its features (``features``): its ancestors' tags and the
words of their class and id attributes, link density, length, punctuation,
position.  Neighbouring labels are scored too; Viterbi decoding gives the best
labelling of the whole page, and the article blocks are joined by line breaks.

Script, style and other raw elements (``_RAW``, not custom elements such as
svg-icon), forms, comments and markup are never text; formulas and the
fallback of an object are.  Character references are decoded, white space inside a block becomes
one space.  Unclosed or stray tags are handled as browsers do in the plain
cases: a paragraph ends where a block begins, a closing tag closes up to its
opening one, markup cut off by the end of the page is dropped.

The field is trained where the query starts (``train``): on labelled pages
given by the caller or on ``labelled_pages``, a fixed number of pages
composed from layout parts with known labels (navigation, notices, adverts,
side bars, forms, footers, reader comments around articles in different
containers).  Weights maximise the regularised likelihood (forward-backward,
Adam).  The weights (a few hundred numbers) go to the tasks.

Null and empty pages give an empty text.  Pages are independent rows, so
repeats, ties and extra columns need nothing special.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm.tables import read_table
from loanscope.llm.textbatch import slices

# Element classes of the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre "
    "search section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK_TAGS - {"body", "button", "head", "html", "option", "title"}

_RAW = "script|style|noscript|template|textarea|svg|iframe|canvas"
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})(?=[\s/>])[^>]*(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\s[^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*|[^>]*))>"
    r"|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z",
    re.S | re.I)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]      # ancestor tags, outermost first
    names: frozenset[str]      # words of the ancestors' class, id and role
    link_chars: int


def _names(attrs: str) -> frozenset[str]:
    if "=" not in attrs:
        return frozenset()
    return frozenset(w for m in _NAMED.finditer(attrs) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower()))


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    parts: list[str] = []
    links = 0
    in_link = 0

    def flush():
        nonlocal links
        if parts:
            text = _SPACES.sub(" ", html_lib.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, tuple(t for t, _ in stack), frozenset().union(*[n for _, n in stack]), links))
            parts.clear()
        links = 0

    def pop_to(tag: str):
        nonlocal in_link
        while stack:
            t, _ = stack.pop()
            in_link -= t == "a"
            if t == tag:
                break

    def add(text: str):
        nonlocal links
        if text:
            parts.append(text)
            if in_link:
                links += len(text)

    at = 0
    for m in _MARKUP.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            if tag in BLOCK_TAGS:
                flush()
            if any(t == tag for t, _ in stack):
                pop_to(tag)
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag in BLOCK_TAGS:
            flush()
            if tag in CLOSES_P and any(t == "p" for t, _ in stack):
                pop_to("p")
            if tag == "li" and any(t == "li" for t, _ in stack) and not any(t in ("ul", "ol") for t, _ in stack[-1:]):
                pop_to("li")
        if tag in VOID_TAGS or m["attrs"].rstrip().endswith("/"):
            continue
        stack.append((tag, _names(m["attrs"])))
        in_link += tag == "a"
    add(page[at:])
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    """Feature names of every block of a page."""
    out = []
    n = len(found)
    for i, b in enumerate(found):
        words = b.text.split(" ")
        size = len(words)
        f = ["bias", "size" + str(min(6, size.bit_length())), "pos" + str(4 * i // n)]
        f += ["in_" + t for t in set(b.path)]
        f += ["name_" + w for w in b.names]
        if b.path:
            f.append("leaf_" + next((t for t in reversed(b.path) if t in BLOCK_TAGS), "none"))
        share = b.link_chars / max(1, len(b.text))
        f.append("links" + str(min(3, int(4 * share))))
        last = b.text[-1]
        f.append("end_" + (last if last in ".!?:" else "other"))
        if size >= 8 and "." in b.text:
            f.append("sentences")
        if "©" in b.text or "(c)" in b.text.lower():
            f.append("copyright")
        if size < 8 and last not in ".!?":
            f.append("short_open")
        out.append(f)
    return out


class Field:
    """A linear-chain conditional random field with labels 0 and 1."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, step: np.ndarray, first: np.ndarray):
        self.index, self.weights, self.step, self.first = index, weights, step, first

    def decode(self, page: list[list[str]]) -> list[int]:
        """Viterbi: the best labels of a page's blocks."""
        if not page:
            return []
        w = self.table
        (s00, s01), (s10, s11) = self.steps
        b0, b1 = self.firsts
        back = []
        for t, names in enumerate(page):
            u0 = u1 = 0.0
            for f in names:
                x = w.get(f)
                if x is not None:
                    u0 += x[0]
                    u1 += x[1]
            if t == 0:
                b0, b1 = b0 + u0, b1 + u1
                continue
            from0 = (b0 + s00) < (b1 + s10)
            from1 = (b0 + s01) < (b1 + s11)
            back.append((from0, from1))
            b0, b1 = (b1 + s10 if from0 else b0 + s00) + u0, (b1 + s11 if from1 else b0 + s01) + u1
        label = int(b1 > b0)
        out = [label]
        for from0, from1 in reversed(back):
            label = int(from1 if label else from0)
            out.append(label)
        out.reverse()
        return out

    @property
    def table(self) -> dict[str, tuple[float, float]]:
        if not hasattr(self, "_table"):
            self._table = {f: tuple(self.weights[i].tolist()) for f, i in self.index.items()}
            self.steps, self.firsts = self.step.tolist(), self.first.tolist()
        return self._table


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 80, rate: float = 0.15,
          penalty: float = 0.02) -> Field:
    """Maximum-likelihood weights by Adam on full batches; pages are padded
    to one length so that a round is a few array steps."""
    index: dict[str, int] = {}
    for page, _ in pages:
        for names in page:
            for f in names:
                index.setdefault(f, len(index))
    longest = max(len(p) for p, _ in pages)
    x = np.zeros((len(pages), longest, len(index)), np.float32)
    y = np.zeros((len(pages), longest), np.int64)
    real = np.zeros((len(pages), longest), bool)
    for i, (page, labels) in enumerate(pages):
        for t, names in enumerate(page):
            x[i, t, [index[f] for f in names]] = 1
        y[i, :len(labels)] = labels
        real[i, :len(labels)] = True
    size = len(index) * 2
    theta = np.zeros(size + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    flat = x.reshape(-1, len(index))
    gold = np.eye(2)[y] * real[..., None]
    gold_step = np.einsum("ita,itb->ab", gold[:, :-1], gold[:, 1:])
    for k in range(1, rounds + 1):
        w, step, first = theta[:size].reshape(-1, 2), theta[size:size + 4].reshape(2, 2), theta[size + 4:]
        u = (flat @ w.astype(np.float32)).reshape(len(pages), longest, 2).astype(float)
        alpha = np.zeros_like(u)
        alpha[:, 0] = u[:, 0] + first
        for t in range(1, longest):
            a = np.logaddexp.reduce(alpha[:, t - 1, :, None] + step, axis=1) + u[:, t]
            alpha[:, t] = np.where(real[:, t, None], a, alpha[:, t - 1])
        beta = np.zeros_like(u)
        for t in range(longest - 2, -1, -1):
            b = np.logaddexp.reduce(step + (u[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(real[:, t + 1, None], b, beta[:, t + 1])
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + step + (u + beta)[:, 1:, None, :] - z[:, None, None, None])
        pair *= real[:, 1:, None, None]
        grad = np.concatenate((
            (flat.T @ (gold - p).reshape(-1, 2)).ravel(), (gold_step - pair.sum((0, 1))).ravel(),
            (gold[:, 0] - p[:, 0]).sum(0))) / len(pages) - penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return Field(index, theta[:size].reshape(-1, 2), theta[size:size + 4].reshape(2, 2), theta[size + 4:])


def labelled_pages(n: int = 160, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Composed pages with the label of each of their blocks."""
    rnd = random.Random(seed)
    syllables = "ba co du fe gi ha jo ku la me ni po ra se ti vo wa xe yu zo ".split()

    def word():
        return "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3)))

    def phrase(lo, hi):
        return " ".join(word() for _ in range(rnd.randint(lo, hi)))

    def sentences(n):
        return " ".join(phrase(3, 16).capitalize() + rnd.choice("....?!") for _ in range(n))

    def tagged(tag, text, names=""):
        return f"<{tag}{names}>{text}</{tag}>"

    def menu():
        items = [phrase(1, 2) for _ in range(rnd.randint(2, 8))]
        links = [tagged("a", t, ' href="/x"') for t in items]
        if rnd.random() < 0.75:
            inner, count = tagged("ul", "".join(tagged("li", x) for x in links)), len(items)
        else:
            inner, count = " ".join(links), 1
        return rnd.choice([tagged("nav", inner), tagged("div", inner, ' class="menu"'),
                           tagged("header", tagged("nav", inner))]), [0] * count

    def extra():
        kind = rnd.choice(["ad", "promo", "cookie-notice", "banner", "notice", "sidebar", "related", "newsletter",
                           "share", "comments"])
        texts = [sentences(rnd.randint(1, 3)) for _ in range(rnd.randint(1, 4) if kind in ("sidebar", "comments")
                                                              else 1)]
        inner = "".join(tagged("p", t) for t in texts) if rnd.random() < 0.5 else "".join(
            tagged("div", t) for t in texts)
        if len(texts) == 1 and rnd.random() < 0.6:
            inner = texts[0]
        tag = {"sidebar": "aside", "comments": "section"}.get(kind, "div") if rnd.random() < 0.6 else "div"
        return tagged(tag, inner, f' {rnd.choice(["class", "id"])}="{kind}"'), [0] * len(texts)

    def form():
        return tagged("form", tagged("label", phrase(1, 3)) + "<input name=q>" + tagged("button", phrase(1, 2))), [0, 0]

    def article():
        body, labels = [], []
        if rnd.random() < 0.8:
            body.append(tagged("h1", phrase(3, 12).capitalize() + rnd.choice(["", "."])))
        for _ in range(rnd.randint(1, 14)):
            r = rnd.random()
            if r < 0.1:
                body.append(tagged("h2", phrase(2, 6)))
            elif r < 0.2:
                body.append("<p><b>" + sentences(rnd.randint(1, 2)) + "<br>")
            elif r < 0.25:
                body.append(tagged("p", sentences(1) + " " + tagged("a", phrase(1, 3), ' href="/y"') + "."))
            elif r < 0.3:
                body.append(tagged("blockquote", sentences(1)))
            elif r < 0.35:
                body.append(tagged("ul", tagged("li", sentences(1))))
            else:
                body.append(tagged("p", sentences(rnd.randint(1, 9))))
        labels = [1] * len(body)
        box = rnd.choice([("article", ""), ("article", ""), ("main", ""), ("div", ' class="content"'),
                          ("div", ' id="post-body"'), ("section", ' class="story"'), ("div", ' class="x7"')])
        return tagged(box[0], "".join(body), box[1]), labels

    def footer():
        text = rnd.choice(["&copy; ", "Copyright (c) "]) + phrase(1, 2) + " &middot; " + sentences(1)
        return rnd.choice([tagged("footer", text), tagged("div", text, ' class="footer"')]), [0]

    out = []
    for _ in range(n):
        title = phrase(2, 9)
        parts = [menu()] if rnd.random() < 0.9 else []
        parts += [extra() for _ in range(rnd.randint(0, 2))]
        parts += [form()] if rnd.random() < 0.2 else []
        parts += [article()]
        parts += [extra() for _ in range(rnd.randint(0, 2))]
        parts += [form()] if rnd.random() < 0.15 else []
        parts += [footer()] if rnd.random() < 0.9 else []
        page = f"<!DOCTYPE html><html><head>{tagged('title', title)}</head><body>" + "".join(p for p, _ in parts)
        out.append((page + "</body></html>", [0] + [x for _, ls in parts for x in ls]))
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field trained on the composed pages."""
    pages = []
    for page, labels in labelled_pages():
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError("a composed page does not have the blocks it was labelled with")
        pages.append((features(found), labels))
    return train(pages)


def extract(field: Field, page: str | None) -> str:
    """The main text of one page."""
    found = blocks(page or "")
    return "\n".join(b.text for b, label in zip(found, field.decode(features(found))) if label)


def extract_pages(pages: DataFrame, field: Field, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """page_id, url, text of every page."""
    def run(batches):
        for b in slices(batches, "html"):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([extract(field, h) for h in b.column(2).to_pylist()], pa.string())],
                names=["page_id", "url", "text"])

    return pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[url_col].alias("url"),
                        pages[html_col].alias("html")).mapInArrow(run, "page_id bigint, url string, text string")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"), default_field()).withColumn(
        "n_chars", F.char_length("text").cast("bigint"))


QUERIES = {"op4_html_extract": op4_html_extract}
ORACLE = {}
