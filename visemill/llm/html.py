"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

Blocks are described by their ancestors' tags and name tokens and by their text; the field is trained on labelled pages
and decoded by Viterbi's algorithm, page by page, inside the tasks.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo mrow mfrac msup msub msqrt mtext svg text tspan g object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not shown as text of the page.
HIDDEN = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "select", "button", "datalist")
#: Of these, those that run to the end of the page where no tag closes them, and those that do not nest.
TO_END, FLAT = frozenset("script style title textarea noscript iframe".split()), frozenset({"select", "button"})
#: Opening the first closes an open one of the second.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|(?P<data><!\[CDATA\[)|<(?P<raw>%s)(?=[\s/>])(?P<rest>[^>]*)(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>|<[!?][^>]*(?:>|\Z)|(?P<text>[^<]+|<)" % "|".join(HIDDEN), re.S | re.I)
ENDS = {n: re.compile(rf"<{n}(?=[\s/>])|</{n}\s*>" if n in FLAT else rf"</{n}\s*>", re.I) for n in HIDDEN}
NAMES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # feature strings of the ancestors
    tag: str
    linked: int  # characters inside links
    around: int = 0  # number of the element that its own block element is a child of


def tokens_of(page: str) -> Iterator[re.Match]:
    """Tags and texts of a page in order, hidden elements as their opening tag. Where one is not closed only its tag is passed over."""
    at, unclosed = 0, set()
    while m := TOKEN.match(page, at):
        if m["data"]:  # to its end, or else to the next >
            end = -1 if "data" in unclosed else page.find("]]>", m.end())
            if end < 0:
                unclosed.add("data")
                end = page.find(">", m.end()) - 2
            if end < 0:
                return
            at = end + 3
            continue
        yield m
        at = m.end()
        name = (m["raw"] or "").lower()
        if not name or name in unclosed:
            continue
        if end := ENDS[name].search(page, at):
            at = end.end() if end[0].startswith("</") else at
        elif name in TO_END:
            return
        else:
            unclosed.add(name)  # nor is a later one: no second search


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order, white space collapsed, references decoded; hidden elements left out."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []
    parts: list[str] = []
    links, linked, elements = 0, 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            path: list[str] = []
            for _, features, _ in stack:
                path += features
            blocks = [(name, k) for name, _, k in stack if name not in INLINE]
            out.append(Block(text, tuple(dict.fromkeys(path)), blocks[-1][0] if blocks else "", linked, blocks[-2][1] if len(blocks) > 1 else 0))
        parts.clear()
        linked = 0

    for m in tokens_of(page or ""):
        if (text := m["text"]) is not None:
            parts.append(text)
            if links:
                linked += len(text)
            continue
        name = (m["name"] or "").lower()
        if not name:
            if m["raw"]:
                parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            close()
        if m["close"]:
            if any(n == name for n, _, _ in stack):
                while stack:
                    gone = stack.pop()[0]
                    links -= gone == "a"
                    if gone == name:
                        break
            continue
        if name in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[name]:
                    links -= sum(n == "a" for n, _, _ in stack[i:])
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        if name not in VOID and not m["attrs"].endswith("/"):
            features = [f"in={name}"] if name not in ("html", "body", "p", "b", "i") else []
            for x in NAMES.finditer(m["attrs"]):
                features += [f"named={w.lower()}" for w in WORDS.findall(x[1] or x[2] or x[3] or "")]
            elements += 1
            stack.append((name, tuple(features), elements))
            links += name == "a"
    close()
    return out


def features_of(blocks: list[Block]) -> list[list[str]]:
    """Feature strings of each block: ancestors, own tag, text shape, its neighbours' shape, and how much of the page's
    text outside of links stands beside it, in children of the same element."""
    said = [len(b.text) - b.linked for b in blocks]
    beside: dict[int, int] = {}
    for b, n in zip(blocks, said):
        beside[b.around] = beside.get(b.around, 0) + n
    whole = max(1, sum(said))
    size = [min(7, (b.text.count(" ") + 1).bit_length()) for b in blocks]
    linked = [min(4, 5 * b.linked // max(len(b.text), 1)) for b in blocks]
    out = []
    for k, b in enumerate(blocks):
        share = min(4, 5 * beside[b.around] // whole)
        f = ["any", f"tag={b.tag}", f"words={size[k]}", f"linked={linked[k]}", f"stops={min(3, b.text.count('.') + b.text.count('!') + b.text.count('?'))}", f"beside={share}", f"alone={min(4, 5 * said[k] // whole)}"]
        for name, j in (("before", k - 1), ("after", k + 1)):
            f.append(f"{name}={size[j] // 2},{linked[j] > 1}" if 0 <= j < len(blocks) else f"{name}=none")
        if b.text[-1] in ".!?\"'”»。！？…":
            f.append("ends")
        if "©" in b.text or "opyright" in b.text:
            f += ["rights", "short rights"] if size[k] < 5 else ["rights"]
        out.append(f + list(b.path))
    return out


@dataclass
class Field:
    """Log-linear weights: emission[feature] and transition[before, after] for the labels 0 (other) and 1 (main text)."""

    emission: dict[str, float]  # score of label 1 over label 0
    transition: np.ndarray
    start: np.ndarray

    def scores(self, features: list[list[str]]) -> np.ndarray:
        get = self.emission.get
        return np.array([sum([get(f, 0.0) for f in fs]) for fs in features])

    def decode(self, features: list[list[str]]) -> list[int]:
        """The most likely labels, by Viterbi."""
        (t00, t01), (t10, t11) = self.transition.tolist()
        back: list[tuple[int, int]] = []
        zero, one = self.start.tolist()
        for k, s in enumerate(self.scores(features).tolist()):
            if k:
                a, b = zero + t00, one + t10
                c, d = zero + t01, one + t11
                back.append((int(b > a), int(d > c)))
                zero, one = max(a, b), max(c, d)
            one += s
        label = int(one > zero)
        out = [label] if features else []
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train_field(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.3, ridge: float = 1e-4) -> Field:
    """Maximise the conditional likelihood by AdaGrad steps, page by page; gradients by forward-backward sums."""
    number: dict[str, int] = {}
    coded = [([np.array([number.setdefault(f, len(number)) for f in fs]) for fs in x], np.array(y)) for x, y in pages if y]
    w, trans, start = np.zeros(len(number)), np.zeros((2, 2)), np.zeros(2)
    gw, gt, gs = np.full(len(number), 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(coded)):
            x, y = coded[i]
            n = len(y)
            emit = np.zeros((n, 2))
            emit[:, 1] = [w[f].sum() for f in x]
            alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
            alpha[0] = start + emit[0]
            for k in range(1, n):
                alpha[k] = np.logaddexp(alpha[k - 1, 0] + trans[0], alpha[k - 1, 1] + trans[1]) + emit[k]
            for k in range(n - 2, -1, -1):
                ahead = emit[k + 1] + beta[k + 1]
                beta[k] = np.logaddexp(trans[:, 0] + ahead[0], trans[:, 1] + ahead[1])
            total = np.logaddexp(*alpha[-1])
            p = np.exp(alpha + beta - total)
            pairs = np.zeros((2, 2))
            if n > 1:
                pairs = np.exp(alpha[:-1, :, None] + trans + (emit[1:] + beta[1:])[:, None, :] - total).sum(axis=0)
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:-1], y[1:]), 1)
                pairs = seen - pairs
            gap = y - p[:, 1]
            at = np.concatenate(x)
            step = np.repeat(gap, [len(f) for f in x])
            grad = np.bincount(at, weights=step, minlength=len(w))
            hit = np.unique(at)
            g = grad[hit] - ridge * w[hit]
            gw[hit] += g**2
            w[hit] += rate * g / np.sqrt(gw[hit])
            gt += pairs**2
            trans += rate * pairs / np.sqrt(gt)
            first = np.eye(2)[y[0]] - p[0]
            gs += first**2
            start += rate * first / np.sqrt(gs)
    return Field({f: float(w[i]) for f, i in number.items()}, trans, start)


# ---------------------------------------------------------------- labelled pages
#: Fixed words for furniture in labelled pages.
FURNITURE = {
    "nav": ["Home", "News", "About us", "Contact", "Archive", "Sign in", "Next page", "Topics", "Accueil", "Kontakt", "Inicio"],
    "notice": ["We use cookies to improve your visit. Accept all.", "This site is in maintenance tonight.", "Subscribe to our newsletter!", "Please enable notifications."],
    "footer": ["© 2024 Example. All rights reserved.", "Terms of use", "Privacy", "Imprint", "Powered by example.com"],
    "thread": ["Comments", "Reader comments", "Replies", "Responses", "Discussion", "Kommentare", "Commentaires", "Comentarios"],
    "form": ["Your name", "Your e-mail address", "Search", "Send", "Leave a reply"],
}


#: Fixed openings of the threads that readers write below an article.
THREADS = [
    'section class="comments"', 'div id="comments"', 'ol class="comment-list"', 'div class="reader-comments"', 'section id="discussion"', 'div class="discussion"', 'div id="disqus_thread"',
    'section class="responses"', 'ul class="replies"', 'div id="respond"', 'div class="user-feedback"', 'section class="talkback"', 'div class="thread"', 'section',
]


#: Private characters that mark text as furniture or main text.
MARKS = ("\ue000", "\ue001")


def labelled_page(rng: np.random.Generator, sentences: list[str]) -> list[tuple[str, int]]:
    """A page of random layout as (markup, label) pieces; label 1 is main text, 0 furniture, -1 markup without text."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p

    def said(k: int) -> str:
        return entities.escape(" ".join(pick(sentences) for _ in range(k)), quote=False)

    def linked(words: list[str]) -> list[tuple[str, int]]:
        out = [("<ul>", -1)]
        for w in words:
            out += [('<li><a href="/x">', -1), (w, 0), ("</a></li>", -1)]
        return [*out, ("</ul>", -1)]

    def words() -> list[str]:
        some = [pick(FURNITURE["nav"]) for _ in range(int(rng.integers(2, 8)))]
        return some if chance(0.5) else [w for w in pick(sentences).split()[:8]] or some

    def wrap(tag: str, body: list[tuple[str, int]]) -> list[tuple[str, int]]:
        return [(f"<{tag}>", -1), *body, (f"</{tag.split()[0]}>", -1)]

    def text(k: int, label: int, tag: str = "p") -> list[tuple[str, int]]:
        return wrap(tag, [(said(k), label)])

    def unheard() -> str:
        """An element whose name tells nothing."""
        word = "".join(pick("abcdefghiklmnoprstuvw") for _ in range(int(rng.integers(2, 8))))
        return pick(["div", "section", "div", "td"]) + pick(["", f' class="{word}"', f' id="{word}"', f' class="{word} {pick(["wrap", "box", "txt", "page", "inner", "row", "col"])}"'])

    page: list[tuple[str, int]] = []
    if chance(0.8):
        page += wrap(pick(["nav", 'div class="nav"', 'div id="menu"', 'ul class="menu"', 'div role="navigation"', "div", unheard()]), linked(words()))
    if chance(0.5):
        page += wrap(pick(["header", 'div id="header"', 'div class="site-header"', 'div class="masthead"']), text(1, 0, pick(["h1", "p", "div"])) + (linked(words()) if chance(0.4) else []))
    if chance(0.4):
        page += wrap(pick(['div class="cookie-notice"', 'div class="notice"', 'div role="alert"', 'div id="banner"', 'div class="popup"']), [(pick(FURNITURE["notice"]) if chance(0.6) else said(1), 0)])
    if chance(0.6):
        page += wrap(pick(['div class="ad"', 'div class="advert"', 'aside class="ads"', 'div id="sponsored"', 'div class="promo"']), [(said(int(rng.integers(1, 4))), 0)])
    side = wrap(pick(["aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="related"', 'div class="widget"']), text(1, 0, "h3") + (linked(words()) if chance(0.6) else text(int(rng.integers(1, 4)), 0)))
    if chance(0.3):
        page += side
    body: list[tuple[str, int]] = text(1, 1, pick(["h1", "h2", "h1 class=\"title\""])) if chance(0.8) else []
    paragraph = pick(["p"] * 7 + ["div", "div", ""])  # without an element, lines are parted by breaks
    for _ in range(int(rng.integers(1, 9))):
        kind = rng.random()
        if kind < 0.7 and not paragraph:
            body += [(said(int(rng.integers(1, 8))), 1), (pick(["<br>", "<br><br>"]), -1)]
        elif kind < 0.7:
            body += text(int(rng.integers(1, 8)), 1, paragraph)
        elif kind < 0.8:
            body += [("<p><b>", -1), (said(1), 1), ("<br><p>", -1), (said(int(rng.integers(1, 6))), 1), ("</p>", -1)]
        elif kind < 0.88:
            body += wrap(pick(["blockquote", "ul", "pre", "div"]), text(1, 1, pick(["li", "p"])))
        elif kind < 0.94:
            body += [("<p>", -1), (said(1).split()[0], 1), ("</p>", -1)]
        else:
            body += text(1, 1, pick(["h2", "h3"]))
        if chance(0.06):
            body += wrap(pick(['div class="ad"', "aside", 'div class="share"']), [(said(1), 0)])
    comments = [("<h3>", -1), (pick([*FURNITURE["thread"], f"{int(rng.integers(2, 200))} {pick(FURNITURE['thread']).lower()}", said(1)]), 0), ("</h3>", -1)]
    for _ in range(int(rng.integers(1, 5))):
        reply = [(said(int(rng.integers(1, 5))), 0)]
        if chance(0.3):
            reply = wrap(pick(["div class=\"author\"", "b", "span class=\"user\""]), [(pick(sentences).split()[0], 0)]) + wrap("p", reply)
        comments += wrap(pick(['div class="comment"', 'li class="comment"', "article class=\"comment\"", "p", "p", 'div class="reply"', "li", 'div class="response"']), reply)
    comments = wrap(pick(THREADS), comments)
    inside = chance(0.3)
    if chance(0.35) and inside:
        body += comments
    place = rng.random()
    if place < 0.5:
        body = wrap(pick(["article", "article", "main", 'div class="content"', 'div id="main"', 'div class="post"', 'div class="article-body"', 'section class="story"', 'div id="content"']), body)
    elif place < 0.85:
        body = wrap(unheard(), wrap(unheard(), body) if chance(0.3) else body)
    if chance(0.1):
        return body  # a page of nothing else
    page += body
    if chance(0.35) and not inside:
        page += comments
    if chance(0.3):
        page += wrap(pick(["form", 'form class="search"', 'div class="form"']), [(pick(FURNITURE["form"]), 0)])
    if chance(0.3):
        page += side
    if chance(0.6):
        page += wrap(pick(["footer", 'div id="footer"', 'div class="site-footer"', 'div class="imprint"']), [(pick(FURNITURE["footer"]) + (" " + said(1) if chance(0.4) else ""), 0)])
    elif chance(0.8):  # only its words tell an imprint
        owner = f"{int(rng.integers(1995, 2026))} {pick(sentences).split()[0]}"
        page += wrap(pick(["div", "p", "p", "address", "small"]), [(pick(FURNITURE["footer"][:1] + [f"© {owner}", f"Copyright {owner}", f"© {owner}. All rights reserved.", f"{owner} ©"]), 0)])
    return page


def labelled_blocks(pieces: list[tuple[str, int]], nameless: bool = False) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a labelled page's blocks, the names of classes and ids left out of a ``nameless`` one. Marks in
    the text carry the labels through the block splitter."""
    page = "".join(f"{MARKS[label]}{text}" if label >= 0 else text for text, label in pieces)
    blocks = blocks_of(f"<html><body>{page}</body></html>")
    labels = []
    for b in blocks:
        labels.append(int(MARKS[1] in b.text))
        b.text = b.text.replace(MARKS[0], "").replace(MARKS[1], "") or "."
    features = features_of(blocks)
    if nameless:
        features = [[f for f in fs if not f.startswith("named=")] for fs in features]
    return features, labels


def learn_field(pages: DataFrame, sample: int = 200, layouts: int = 900, page_chars: int = 20_000, block_sentences: int = 20, sentences_in_all: int = 5_000) -> Field:
    """Train on ``layouts`` labelled pages of random layout, filled with sentences of at most ``sample`` pages.

    Which page lends sentences is decided by a hash of its id. A lending page gives its first ``page_chars`` characters, a
    block of it ``block_sentences`` sentences, all pages ``sentences_in_all``: these bounds hold for the training sample
    alone, and what reaches the driver stays under ``sample`` times ``page_chars``.
    """
    ids = [r[0] for r in pages.select("page_id").filter("page_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()]
    lending = pages.filter(F.col("page_id").isin(ids)).limit(sample)
    rows = lending.select("page_id", F.substring("html", 1, page_chars).alias("html")).collect()
    rows.sort(key=lambda r: (r.page_id, r.html or ""))
    sentences = []
    for r in rows:
        for b in blocks_of(r.html):
            sentences += [s for s in re.split(r"(?<=[.!?]) ", b.text) if s][:block_sentences]
    rng = np.random.default_rng(11)
    sentences = sentences[:sentences_in_all] or ["A short line of text.", "Another one follows it, somewhat longer than the first!", "Menu"]
    return train_field([labelled_blocks(labelled_page(rng, sentences), nameless=rng.random() < 0.1) for _ in range(layouts)])


def main_text(page: str | None, field: Field) -> str:
    blocks = blocks_of(page)
    labels = field.decode(features_of(blocks))
    return " ".join(b.text for b, label in zip(blocks, labels) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages(page_id, url, html)``.

    ``text`` joins the blocks labelled main text, in page order, by one space; white space within a block is one space.
    It is empty where no block is main text, and for null or empty html. Ids and urls pass through, nulls included;
    repeated rows are returned as often as they occur.
    """
    field = field or learn_field(pages)
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                text = [main_text(h.as_py(), shared.value) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
