"""Main text of web pages: a linear-chain CRF over the leaf blocks of the markup."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages and training steps; both are fixed, whatever the corpus.
PAGES, STEPS = 500, 150

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?>=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|[^>])*+)>"
    r"|</?[A-Za-z][^>]*(?:>|\Z)",
    re.DOTALL,
)
#: Their text is no markup, or never shown: skipped to the close tag, or to the end of the page.
_RAW = frozenset("script style textarea title iframe template".split())
#: Not shown, but only where their close tag comes before their parent's.
_UNSEEN = frozenset("svg select noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr input button picture source object math mi mn mo ms mtext "
    "mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd mstyle mpadded mphantom "
    "menclose mfenced mspace merror maction semantics annotation annotation-xml".split()
)
#: Opening one of these ends an open element of the second list, up to the nearest of the third.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr",)),
    "th": (("td", "th"), ("tr",)),
    "option": (("option",), ("select",)),
}
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")
#: An unquoted value at the end of a tag; a slash there belongs to it.
_UNQUOTED = re.compile(r"=\s*[^\s\"'>][^\s>]*$")


class Block:
    """Text between two block boundaries, with the elements around it."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[tuple[str, frozenset[str]], ...], text: str, linked: int) -> None:
        self.path, self.text, self.linked = path, text, linked


def _closed(rest: str) -> bool:
    """Whether a tag closes its own element."""
    return rest.endswith("/") and not _UNQUOTED.search(rest)


@lru_cache(maxsize=4096)
def _names(rest: str) -> frozenset[str]:
    """Words of the class, id and role of a tag."""
    found: set[str] = set()
    for _, a, b, c in _ATTRIBUTE.findall(rest):
        found.update(_NAME.findall((a or b or c).lower()))
    return frozenset(found)


def _raw_end(html: str, tag: str, at: int) -> int:
    stop = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(html, at)
    return stop.end() if stop else len(html)


def _unseen(html: str) -> dict[int, int]:
    """Ends of the open and close tags of the unseen elements that are closed inside their parent."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    at = 0
    while m := _TOKEN.search(html, at):
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag or tag in _INLINE or tag in _VOID:
            continue
        if m["close"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if tag in _UNSEEN:
                        out[stack[depth][1]] = at
                    del stack[depth:]
                    break
        elif not _closed(m["rest"]):
            if tag in _RAW:
                at = _raw_end(html, tag, at)
            else:
                stack.append((tag, at))
    return out


_ANY_UNSEEN = re.compile(rf"<(?:{'|'.join(sorted(_UNSEEN))})\b", re.IGNORECASE)


def blocks(html: str) -> list[Block]:
    """Leaf blocks with text in page order.

    White space inside a block is one space and character references are
    decoded. Text of scripts, styles, the head and other unseen elements is
    dropped; unclosed elements end with their parent or the page.
    """
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    parts: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(tuple(stack), text, linked))
            parts.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if links:
                linked += len(piece)

    unseen = _unseen(html) if _ANY_UNSEEN.search(html) else {}
    at = 0
    end = len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        say(html[at : m.start()] if m else html[at:])
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "head":
            continue
        if tag in _RAW:
            if not m["close"] and not _closed(m["rest"]):
                at = _raw_end(html, tag, at)
            continue
        if tag in _UNSEEN:
            at = unseen.get(at, at) if not m["close"] else at
            continue
        if tag in _INLINE:
            if tag == "a":
                links = 0 if m["close"] else 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if m["close"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
            links = 0
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()  # a paragraph holds no other block
        if tag in _IMPLIED:
            ended, within = _IMPLIED[tag]
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in within:
                    break
                if stack[depth][0] in ended:
                    del stack[depth:]
                    break
        if tag not in _VOID and not _closed(m["rest"]):
            stack.append((tag, _names(m["rest"])))
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    """Names of the features of each block."""
    out = []
    n = len(found)
    for k, block in enumerate(found):
        text, size = block.text, len(block.text)
        words = text.count(" ") + 1
        tags = {tag for tag, _ in block.path}
        named = set().union(*(names for _, names in block.path)) if block.path else set()
        fs = ["all", f"in {block.path[-1][0] if block.path else 'none'}"]
        fs += [f"under {t}" for t in tags]
        fs += [f"called {c}" for c in named]
        fs.append(f"words {min(8, words.bit_length())}")
        fs.append(f"linked {min(4, 4 * block.linked // size)}")
        fs.append("stops" if text[-1] in ".!?:;”\"…" else "no stop")
        fs.append(f"sentences {min(3, text.count('. '))}")
        if "©" in text or "copyright" in text.lower():
            fs.append("rights")
        fs.append(f"place {min(3, 4 * k // n)}")
        out.append(fs)
    return out


# --- labelled pages ----------------------------------------------------------

_SYLLABLES = "an be con de er fi ga hol in ju ko lan mi no or pe qua re sta ti un ver wo xi yo za".split()

#: Places around an article, as openings that mark them; the first are plain elements, the rest say it by name only.
_AROUND = {
    "menu": ("<nav>", '<div class="nav">', '<div id="menu">', '<ul class="navigation menu">', '<div role="navigation">', '<div class="breadcrumb">', '<div class="pagination">', '<div class="toolbar">'),
    "head": ("<header>", '<div class="header">', '<div id="masthead">', '<div class="site-header top">', '<div class="banner">'),
    "foot": ("<footer>", '<div class="footer">', '<div id="foot">', '<div class="copyright legal">', '<div class="bottom">'),
    "side": ("<aside>", '<div class="sidebar">', '<div id="side">', '<div class="related">', '<div class="widget">', '<section class="recommended more">', '<div class="trending popular">', '<div class="tags">'),
    "notice": ('<div class="notice">', '<div class="cookie consent">', '<div id="gdpr">', '<div class="alert">', '<div class="popup modal">', '<div class="privacy">', "<dialog>", '<div class="subscribe">', '<div class="newsletter signup">', '<div class="paywall">'),
    "ad": ('<div class="ad">', '<div class="ads">', '<div class="advert">', '<div id="sponsored">', '<div class="promo">', '<aside class="advertisement">', '<div class="sponsor">', '<section class="promotion">'),
    "form": ("<form>", '<form class="search">', '<div class="login"><form>', '<form class="contact">', "<form><fieldset>"),
    "comments": ('<div class="comments">', '<section id="comments">', '<ol class="commentlist">', '<div class="comment">', '<div class="discussion replies">', '<div id="disqus">', '<div class="reviews responses">', '<section class="reader comments">'),
    "share": ('<div class="share">', '<div class="social">', '<ul class="follow">'),
}
_MAIN = ("<article>", "<main>", '<div class="content">', '<div id="main">', '<div class="post">', '<div class="article-body">', '<div class="entry">', '<section class="story text">', '<div role="main">', "<div>")


def _closing(opening: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z0-9]+)", opening)))


def labelled_page(draw: random.Random) -> tuple[str, list[str]]:
    """A made page and the texts of its main blocks."""
    main: list[str] = []

    def sentence(low: int, high: int) -> str:
        text = " ".join("".join(draw.choices(_SYLLABLES, k=draw.randint(1, 3))) for _ in range(draw.randint(low, high)))
        return text.capitalize()

    def prose() -> str:
        return " ".join(sentence(3, 16) + draw.choice("..!?.") for _ in range(draw.randint(1, 6)))

    def around(kind: str) -> str:
        opening = draw.choice(_AROUND[kind])
        if kind in ("menu", "share") or (kind in ("side", "foot", "head") and draw.random() < 0.5):
            items = [f'<a href="#">{sentence(1, 3)}</a>' for _ in range(draw.randint(1, 7))]
            body = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if draw.random() < 0.7 else " ".join(items)
        elif kind == "foot":
            body = f"&copy; {sentence(1, 2)} &middot; " + prose()
        elif kind == "form":
            body = f"<label>{sentence(1, 3)}</label><input name=q><p>{sentence(2, 8)}</p><button>{sentence(1, 1)}</button>"
        elif kind == "comments":
            body = f"<h3>{sentence(1, 2)}</h3>" + "".join(
                draw.choice(("<p>{}</p>", "<div><p>{}</p></div>", "<li>{}</li>", "<div><b>{}</b></div>")).format(prose())
                for _ in range(draw.randint(1, 5))
            )
        else:
            body = draw.choice(("{}", "<p>{}</p>", "<h3>Ad</h3><p>{}</p>", "<p>{}</p><p>More</p>")).format(prose())
        return opening + body + _closing(opening)

    def article() -> str:
        title = sentence(3, 10)
        main.append(title)
        out = draw.choice(("<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>")).format(title)
        for _ in range(draw.randint(1, 9)):
            kind = draw.random()
            if kind < 0.72:
                text = prose()
                main.append(text)
                out += draw.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}", "<div>{}</div>")).format(text)
            elif kind < 0.8:
                text = sentence(1, 6)
                main.append(text)
                out += f"<h2>{text}</h2>"
            elif kind < 0.88:
                items = [sentence(1, 14) + draw.choice(("", ".")) for _ in range(draw.randint(1, 5))]
                main.extend(items)
                out += "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
            elif kind < 0.93:
                text = prose()
                main.append(text)
                out += draw.choice(("<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>")).format(text)
            elif kind < 0.96:
                items = [sentence(1, 4) for _ in range(4)]
                main.extend(items)
                out += "<table><tr><td>{}</td><td>{}</td></tr><tr><td>{}</td><td>{}</td></tr></table>".format(*items)
            else:
                out += around(draw.choice(("ad", "side", "share", "notice", "form")))
        return out

    def some(kinds: tuple[str, ...], chance: float) -> str:
        return "".join(around(k) for k in kinds if draw.random() < chance)

    before = some(("notice", "head", "menu", "ad", "form"), 0.5)
    opening = draw.choice(_MAIN)
    body = opening + article()
    inside = some(("share", "comments"), 0.25)
    body += inside + _closing(opening)
    after = some(("side", "ad", "comments", "form", "menu", "notice", "foot"), 0.45)
    if draw.random() < 0.2:
        before, after = before + some(("side",), 0.8), after
    return f"<html><head><title>x</title></head><body>{before}{body}{after}</body></html>", main


class Chain:
    """Two labels (0 around, 1 main), a weight for each feature, and transitions."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.move = np.zeros((2, 2))

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], steps: int, rate: float = 0.15, penalty: float = 1e-3) -> list[float]:
        """Penalised maximum likelihood by Adam over all pages; losses by step."""
        number: dict[str, int] = {}
        longest = max(len(y) for _, y in pages)
        where, which = [], []
        truth = np.zeros((longest, len(pages)), np.int64)
        real = np.zeros((longest, len(pages)), bool)
        for p, (fs, y) in enumerate(pages):
            real[: len(y), p] = True
            truth[: len(y), p] = y
            for t, names in enumerate(fs):
                for f in names:
                    where.append(t * len(pages) + p)
                    which.append(number.setdefault(f, len(number)))
        where, which = np.array(where), np.array(which)
        w, move = np.zeros(len(number)), np.zeros((2, 2))
        first, second, losses = np.zeros(len(w) + 4), np.zeros(len(w) + 4), []
        cells, last = longest * len(pages), real.sum(0) - 1
        rows = np.arange(len(pages))
        for step in range(1, steps + 1):
            score = np.zeros((longest, len(pages), 2))
            score[:, :, 1] = np.bincount(where, w[which], cells).reshape(longest, -1)
            ahead, behind = np.zeros_like(score), np.zeros_like(score)
            ahead[0] = score[0]
            for t in range(1, longest):
                ahead[t] = score[t] + np.logaddexp(ahead[t - 1][:, :1] + move[0], ahead[t - 1][:, 1:] + move[1])
            for t in range(longest - 2, -1, -1):
                onward = score[t + 1] + behind[t + 1]
                now = np.logaddexp(move[:, 0] + onward[:, :1], move[:, 1] + onward[:, 1:])
                behind[t] = np.where(real[t + 1][:, None], now, 0)
            whole = np.logaddexp(*ahead[last, rows].T)
            chance = np.exp(ahead + behind - whole[:, None])
            pair = np.exp(ahead[:-1, :, :, None] + move + (score[1:] + behind[1:])[:, :, None, :] - whole[:, None, None])
            both = real[1:]
            expected = (pair * both[:, :, None, None]).sum((0, 1))
            seen = np.zeros((2, 2))
            np.add.at(seen, (truth[:-1][both], truth[1:][both]), 1)
            reached = (score[:, :, 1] * truth)[real].sum() + (seen * move).sum()
            losses.append((whole.sum() - reached) / len(pages))
            over = np.where(real, chance[:, :, 1] - truth, 0).ravel()
            grad = np.concatenate([np.bincount(which, over[where], len(w)) / len(pages) + penalty * w, ((expected - seen) / len(pages)).ravel()])
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
            change = rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            w, move = w - change[:-4], move - change[-4:].reshape(2, 2)
        self.weights, self.move = dict(zip(number, w.tolist(), strict=True)), move
        return losses

    def decode(self, fs: list[list[str]]) -> list[int]:
        """Best labels, by Viterbi. Features never seen in training weigh nothing."""
        weight = self.weights.get
        (m00, m01), (m10, m11) = self.move.tolist()
        zero = one = 0.0
        back = []
        for k, names in enumerate(fs):
            emit = sum(weight(f, 0.0) for f in names)
            if k:
                to_zero, to_one = zero + m00 < one + m10, zero + m01 < one + m11
                zero, one = max(zero + m00, one + m10), max(zero + m01, one + m11)
                back.append((to_zero, to_one))
            one += emit
        label = int(one > zero)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1] if fs else []


def labelled(count: int, seed: int) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of the blocks of made pages."""
    draw, out = random.Random(seed), []
    for _ in range(count):
        page, main = labelled_page(draw)
        found = blocks(page)
        wanted = set(main)
        out.append((features(found), [int(b.text in wanted) for b in found]))
    return out


@lru_cache(maxsize=1)
def trained() -> Chain:
    """The model, trained on labelled pages; the same in every process."""
    chain = Chain()
    chain.fit(labelled(PAGES, seed=5), STEPS)
    return chain


def main_text(chain: Chain, html: str | None) -> str:
    """Texts of the main blocks, in page order, an empty line between two."""
    found = blocks(html) if html else []
    kept = chain.decode(features(found))
    return "\n\n".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """Main text of each row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null and empty pages, and pages without text, give an empty text. Repeated
    rows give equal texts; other columns are ignored.
    """
    chain = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(chain, html.as_py()) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
