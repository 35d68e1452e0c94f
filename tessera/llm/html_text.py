"""Main text of web pages by a linear-chain conditional random field over blocks.

A page is cut into leaf blocks: runs of text between tags that open or close a block. Each
block has features of its ancestor tags, of words in their class and id, and of its text. A
linear-chain CRF with the labels boilerplate and content is trained on labelled pages (made by
``labelled_pages`` from layouts with known roles; no labelled pages are given) by gradient ascent on the exact
log-likelihood, and Viterbi decoding gives each block's label.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

#: Tags that open or close a block, tags whose content is never text, tags without end.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
SKIPPED_TAGS = frozenset("script style noscript template iframe textarea head title select canvas video audio noframes noembed".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title iframe noembed noframes".split())
INLINE_KEPT = frozenset("a b i em strong span u small sup sub code q cite mark font label abbr".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)", re.S)
#: The rest of a tag; a quoted value may hold the tag's end.
REST = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
#: So far an end of a tag is sought once a page has had one whose quotes don't match.
NEAR = 1 << 10
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
MARK = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
SPACE = re.compile(r"\s+")
FEATURES = 1 << 12


class Node:
    """An open tag: its parent, its name, the words of its attributes; ``inside`` are the features of it and all its ancestors, shared with the parent if it adds none."""

    __slots__ = ("fixed", "inside", "marks", "parent", "tag")

    def __init__(self, parent: Node | None, tag: str, marks: tuple):
        self.parent, self.tag, self.marks, self.inside, self.fixed = parent, tag, marks, None, None

    def features(self) -> list[int]:
        """Of a block that stands here."""
        if self.fixed is None:
            path, node = [], self
            while node is not None and node.inside is None:
                path.append(node)
                node = node.parent
            inside = node.inside if node is not None else frozenset()
            for x in reversed(path):
                own = {numbered(f"mark:{w}") for w in x.marks}
                if x.tag not in INLINE_KEPT:
                    own.add(numbered(f"in:{x.tag}"))
                inside = inside if own <= inside else inside | own
                x.inside = inside
            leaf = self
            while leaf is not None and leaf.tag in INLINE_KEPT:
                leaf = leaf.parent
            self.fixed = sorted(inside | {numbered("bias"), numbered(f"leaf:{leaf.tag if leaf is not None else ''}")})
        return self.fixed


class Block:
    __slots__ = ("links", "node", "pieces", "text")

    def __init__(self, node: Node | None):
        self.node, self.pieces, self.links, self.text = node, [], 0, ""


def hidden(attributes: str) -> bool:
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower().replace(" ", "")
        if (name := name.lower()) == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value:
            return True
    return False


def leaf_blocks(page: str) -> list[Block]:
    """The page's blocks of text, in page order. The work is in proportion to the page, however its tags are nested or left open."""
    out: list[Block] = []
    stack: list[Node] = []
    block_at: list[int] = []  # places of block tags in the stack
    opened: Counter = Counter()  # open block tags by name
    scopes: list[Counter] = [Counter()]  # open inline tags by name, since each open block tag
    raw_end: dict[str, re.Pattern] = {}
    current: Block | None = None
    at, skip, n, last_end, matched = 0, 0, len(page), page.rfind(">"), True

    def text(piece: str) -> None:
        nonlocal current
        if skip or not piece:
            return
        if current is None:
            if piece.isspace():
                return
            current = Block(stack[-1] if stack else None)
            out.append(current)
        piece = html.unescape(piece) if "&" in piece else piece
        current.pieces.append(piece)
        if any(x.tag == "a" for x in stack[-3:]):
            current.links += len(piece)

    def close(to: int) -> None:
        """The tags from this place on are no longer open."""
        nonlocal skip
        while len(stack) > to:
            tag = stack.pop().tag
            skip -= tag in SKIPPED_TAGS
            if tag in BLOCK_TAGS:
                block_at.pop()
                scopes.pop()
                opened[tag] -= 1
            else:
                scopes[-1][tag] -= 1

    while at < n:
        found = TOKEN.search(page, at) if at <= last_end or "<!" in page[at:] else None
        if not found:
            text(page[at:])
            break
        start, attributes = found.start(), ""
        if found[2] is not None:
            rest = REST.match(page, found.end()) if matched else REST.match(page, found.end(), min(n, found.end() + NEAR))
            if rest:
                attributes, end = rest[1], rest.end()
            else:
                matched = False  # a quote that is never closed: the tag ends at the next sign for it
                end = page.find(">", found.end()) + 1 if found.end() <= last_end else 0
                if not end:
                    text(page[at:])
                    break
                attributes = page[found.end() : end - 1]
        else:
            end = found.end()
        text(page[at:start])
        at = end
        if found[2] is None:
            if found[0].startswith("<![CDATA["):
                text(found[0][9:-3] if found[0].endswith("]]>") else found[0][9:])
            continue
        tag, closing = found[2].lower(), bool(found[1])
        if tag == "br" or tag not in BLOCK_TAGS and tag in VOID_TAGS:
            if current is not None and tag == "br":
                current.pieces.append(" ")
            continue
        if tag in BLOCK_TAGS:
            current = None
        if tag in VOID_TAGS:
            continue
        if not closing:
            if tag in BLOCK_TAGS and block_at and ((nearest := stack[block_at[-1]].tag) == "p" or nearest == tag == "li"):
                close(block_at[-1])  # an open paragraph or item ends here, with what is open inside it
            if tag in RAW_TAGS:
                done = raw_end.setdefault(tag, re.compile(rf"</{tag}\b[^>]*>", re.I)).search(page, at)
                at = done.end() if done else n
                continue
            if attributes.endswith("/") and tag not in BLOCK_TAGS:
                continue
            marks: tuple = ()
            if "=" in attributes:
                marks = tuple(w.lower() for m in MARK.findall(attributes) for w in WORD.findall(m[0] or m[1] or m[2]))
            if ("hidden" in attributes or "none" in attributes) and hidden(attributes):
                marks += ("(hidden)",)
            if tag in BLOCK_TAGS:
                block_at.append(len(stack))
                scopes.append(Counter())
                opened[tag] += 1
            else:
                scopes[-1][tag] += 1
            stack.append(Node(stack[-1] if stack else None, tag, marks))
            skip += tag in SKIPPED_TAGS
        elif opened[tag] if tag in BLOCK_TAGS else scopes[-1][tag]:  # an inline tag ends one that was opened in the same block tag
            to = len(stack) - 1
            while stack[to].tag != tag:
                to -= 1
            close(to)
    for b in out:
        b.text = SPACE.sub(" ", "".join(b.pieces)).strip()
    return [b for b in out if b.text]


_NUMBERS: dict[str, int] = {}


def numbered(name: str) -> int:
    """A feature's number; the names met are remembered, up to 20,000."""
    if (found := _NUMBERS.get(name)) is None:
        if len(_NUMBERS) > 20_000:
            _NUMBERS.clear()
        found = _NUMBERS[name] = zlib.crc32(name.encode("utf-8", "surrogatepass")) % FEATURES
    return found


def describe(blocks: list[Block]) -> list[list[int]]:
    """Indices of each block's binary features."""
    out = []
    for i, b in enumerate(blocks):
        fixed = b.node.features() if b.node is not None else [numbered("bias"), numbered("leaf:")]
        size = len(b.text)
        words = b.text.count(" ") + 1
        ends = b.text.count(".") + b.text.count("!") + b.text.count("?")
        extra = [numbered(f"words:{min(words.bit_length(), 8)}"), numbered(f"links:{4 * b.links // max(size, 1)}"), numbered(f"stops:{min(ends, 3)}")]
        if b.text[-1] in ".!?":
            extra.append(numbered("ends"))
        if "©" in b.text or "http" in b.text or "@" in b.text:
            extra.append(numbered("sign"))
        extra.append(numbered("first") if i == 0 else numbered("last") if i == len(blocks) - 1 else numbered("between"))
        out.append(fixed + extra)
    return out


class Crf:
    """Two labels, 0 boilerplate and 1 content; weights of the features for each, and of the transitions."""

    def __init__(self, features: int = FEATURES):
        self.w, self.t = np.zeros((features, 2)), np.zeros((2, 2))

    def scores(self, page: list[list[int]]) -> np.ndarray:
        return np.stack([self.w[f].sum(0) for f in page])

    def viterbi(self, emit: np.ndarray) -> list[int]:
        """The best labels; of equal ones boilerplate."""
        back, best = [], emit[0].tolist()
        (t00, t01), (t10, t11) = self.t.tolist()
        for e0, e1 in emit[1:].tolist():
            a, b, c, d = best[0] + t00, best[1] + t10, best[0] + t01, best[1] + t11
            back.append((int(b > a), int(d > c)))
            best = [max(a, b) + e0, max(c, d) + e1]
        label = [int(best[1] > best[0])]
        for step in reversed(back):
            label.append(step[label[-1]])
        return label[::-1]

    def marginals(self, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Label and transition expectations and the log partition, by forward-backward."""
        n = len(emit)
        f, b = np.zeros((n, 2)), np.zeros((n, 2))
        f[0] = emit[0]
        for i in range(1, n):
            f[i] = np.logaddexp(f[i - 1, 0] + self.t[0], f[i - 1, 1] + self.t[1]) + emit[i]
        for i in range(n - 2, -1, -1):
            ahead = emit[i + 1] + b[i + 1]
            b[i] = np.logaddexp(self.t[:, 0] + ahead[0], self.t[:, 1] + ahead[1])
        z = float(np.logaddexp(*f[-1]))
        pairs = np.zeros((2, 2))
        for i in range(n - 1):
            pairs += np.exp(f[i][:, None] + self.t + (emit[i + 1] + b[i + 1])[None] - z)
        return np.exp(f + b - z), pairs, z

    def fit(self, pages: list[list[list[int]]], labels: list[list[int]], rounds: int = 12, l2: float = 1e-3, rate: float = 0.3) -> Crf:
        """AdaGrad on the L2-penalised log-likelihood, page by page in a fixed shuffled order."""
        gw, gt, order, rng = np.full_like(self.w, 1e-2), np.full((2, 2), 1e-2), list(range(len(pages))), random.Random(7)
        for _ in range(rounds):
            rng.shuffle(order)
            for i in order:
                page, truth = pages[i], labels[i]
                if not page:
                    continue
                seen, pairs, _ = self.marginals(self.scores(page))
                truth_ = np.eye(2)[truth]
                for a, b in zip(truth, truth[1:]):
                    pairs[a, b] -= 1
                rows = np.concatenate([np.array(f) for f in page])
                diff = np.repeat(truth_ - seen, [len(f) for f in page], axis=0)
                used, back = np.unique(rows, return_inverse=True)
                step = np.stack([np.bincount(back, diff[:, k], len(used)) for k in (0, 1)], 1) - l2 * self.w[used]
                gw[used] += step**2
                self.w[used] += rate * step / np.sqrt(gw[used])
                gt += pairs**2
                self.t -= rate * pairs / np.sqrt(gt)
        return self


def labelled_pages(n: int = 240, seed: int = 11) -> Iterator[tuple[str, list[int]]]:
    """Training pages with the label of each block, over layouts with semantic tags and with classed divisions only."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzäéñ"
    vocabulary = ["".join(rng.choices(letters, k=rng.randint(1, 10))) for _ in range(600)]

    def sentence(low: int, high: int) -> str:
        return " ".join(rng.choices(vocabulary, k=rng.randint(low, high))).capitalize() + rng.choice([".", ".", ".", "!", "?"])

    def phrase(k: int) -> str:
        return " ".join(rng.choices(vocabulary, k=k))

    def prose() -> str:
        return " ".join(sentence(1, 20) for _ in range(rng.randint(1, 9)))

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{phrase(rng.randint(1, 3))}</a></li>' for i in range(k)) + "</ul>"

    def around(names: list[str], tags: list[str], inner: str) -> str:
        name, tag = rng.choice(names), rng.choice(tags)
        form = rng.choice(['class="{}"', 'id="{}"', 'class="x {} y"', 'class="{}-box"'])
        return f"<{tag} {form.format(name)}>{inner}</{tag}>"

    def boiler() -> str:
        kind = rng.randrange(10)
        if kind == 0:
            return rng.choice(["<nav>{}</nav>", '<div class="menu">{}</div>', '<div id="nav">{}</div>', '<div class="navbar">{}</div>', '<nav class="breadcrumb">{}</nav>']).format(links(rng.randint(2, 9)))
        if kind == 1:
            return around(["ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner"], ["div", "aside", "section"], f"<p>{prose()}</p>" if rng.random() < 0.5 else prose())
        if kind == 2:
            return around(["cookie", "notice", "consent", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe"], ["div", "section", "aside"], f"<p>{prose()}</p><button>{phrase(1)}</button>" if rng.random() < 0.5 else prose())
        if kind == 3:
            return around(["sidebar", "side", "widget", "related", "recommended", "trending", "popular"], ["aside", "aside", "div"], f"<h3>{phrase(2)}</h3>" + (links(rng.randint(2, 6)) if rng.random() < 0.5 else f"<p>{prose()}</p>"))
        if kind in (4, 5):
            inner = "".join(rng.choice(['<div class="comment"><p>{}</p></div>', "<li><p>{}</p></li>", "<p><b>{}</b></p>"]).format(prose()) for _ in range(rng.randint(1, 5)))
            return around(["comments", "comment-list", "discussion", "replies", "responses", "disqus"], ["section", "div", "div"], f"<h2>{phrase(2)}</h2>{inner}")
        if kind == 6:
            return f"<form{rng.choice(['', ' class=search', ' id=login'])}><label>{phrase(2)}</label><input name=q><p>{sentence(2, 9)}</p><button>{phrase(1)}</button></form>"
        if kind == 7:
            return f"<aside>{prose() if rng.random() < 0.5 else '<p>' + prose() + '</p>'}</aside>"
        if kind == 8:
            return around(["share", "social", "tags", "byline", "meta", "breadcrumbs", "pagination"], ["div", "ul", "p"], " ".join(f"<a href=#>{phrase(1)}</a>" for _ in range(3)))
        return rng.choice(["<noscript>{}</noscript>", "<script>var a = '<p>{}</p>';</script>", "<style>p{{}}</style><!-- {} -->"]).format(phrase(4))

    def content() -> str:
        out = []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.72:
                out.append(f"<p>{rng.choice(['', '', '<b>'])}{prose()}{rng.choice(['', '<br>'])}{rng.choice(['</p>', '</p>', ''])}")
            elif kind < 0.8:
                out.append(f"<h2>{phrase(rng.randint(1, 6))}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{sentence(3, 12)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{prose()}</p></blockquote>")
            elif kind < 0.94:
                out.append("<table><tr>" + "".join(f"<td>{phrase(2)}</td>" for _ in range(3)) + "</tr></table>")
            elif kind < 0.97:
                out.append(f"<pre><code>{phrase(6)}</code></pre>")
            else:
                out.append(f"<figure><img src=x><figcaption>{sentence(3, 8)}</figcaption></figure>")
        return "".join(out)

    for _ in range(n):
        parts: list[tuple[str, int]] = []
        title = phrase(rng.randint(2, 10))
        if rng.random() < 0.4:
            parts.append((f"<header><div class=logo>{phrase(2)}</div>{links(3) if rng.random() < 0.5 else ''}<h1>{phrase(2)}</h1></header>" if rng.random() < 0.6 else f'<div class="header top">{phrase(3)}</div>', 0))
        parts += [(boiler(), 0) for _ in range(rng.randint(0, 4))]
        opening, closing = rng.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="article-body">', "</div>"), ('<div id="content">', "</div>"), ('<div class="post entry">', "</div>"), ('<section class="story">', "</section>"), ('<div role="main">', "</div>"), ("<div>", "</div>")])
        body: list[tuple[str, int]] = [(opening, 1), (f"<h1>{title}</h1>", 1)]
        for _ in range(rng.randint(1, 3)):
            body.append((content(), 1))
            if rng.random() < 0.35:
                body.append((boiler(), 0))
        body.append((closing, 1))
        parts += body
        parts += [(boiler(), 0) for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.8:
            parts.append((rng.choice(["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="copyright">{}</div>', "<footer><p>{}</p></footer>"]).format(f"&copy; {phrase(2)} &middot; {prose()}"), 0))
        # a mark before each part; blocks are labelled by the last mark before them
        page = "".join(f"<!--{role}-->{part}" for part, role in parts)
        whole = f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{page}</body></html>"
        yield whole, block_roles(whole)


def block_roles(page: str) -> list[int]:
    """The role of each block of a labelled page: that of the mark which came last."""
    pieces = re.split(r"<!--([01])-->", page)
    so_far = pieces[0]
    out = [0] * len(leaf_blocks(so_far))
    for i in range(1, len(pieces), 2):
        so_far += pieces[i + 1]
        out += [int(pieces[i])] * (len(leaf_blocks(so_far)) - len(out))
    return out


def trained(pages: int = 240) -> Crf:
    xs, ys = [], []
    for page, roles in labelled_pages(pages):
        xs.append(describe(leaf_blocks(page)))
        ys.append(roles)
    return Crf().fit(xs, ys)


def main_blocks(page: str | None, model: Crf) -> list[str]:
    blocks = leaf_blocks(page or "")
    if not blocks:
        return []
    labels = model.viterbi(model.scores(describe(blocks)))
    return [b.text for b, y in zip(blocks, labels) if y]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Crf | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page: the blocks decoded as content, joined by line feeds.

    White space in a block becomes one space; character references are decoded. A null or empty
    page, and one without content, has the empty text. A block that scores alike as either is boilerplate. Long pages, deep nesting and
    tags without end take time in proportion to the page. What a browser shows only instead of something else (noscript, template, iframe, canvas,
    video, audio) and form fields is no text; hidden elements, math and drawings are blocks like others. Repeated rows and null ids each get a row, a table
    without rows gives none; other columns are not read.
    """
    known = pages.sparkSession.sparkContext.broadcast(model or trained())  # FEATURES rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = ["\n".join(main_blocks(p, known.value)) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(tidy(run), T.StructType(kinds))
