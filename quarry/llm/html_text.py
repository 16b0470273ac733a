"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks: runs of text between block-level tags, each with the path of
elements around it. Every block has a vector of hashed path tokens (tags, classes, ids), hashed
words and a few counts. A bidirectional LSTM in numpy reads a page's whole sequence and labels every
block as main text or not.

It is trained on the driver from a bounded sample of the pages themselves. Their labels come from
pages' own structure: semantic elements and telling class names (``told``). So that the network
doesn't rest on a single tag or on names in English, path tokens are left out at random, blocks of
menus, sidebars, notices, adverts, forms and comments are put between a page's own blocks, and each
page is also read without its telling tags and with names that say nothing.
"""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table

#: Different pages trained on at most (drawn by a hash), and the blocks of each that count there.
PAGES, PAGE_BLOCKS = 280, 200
PATHS, WORDS, COUNTS, HIDDEN = 96, 48, 6, 24
WIDTH = PATHS + WORDS + COUNTS
EPOCHS = 12
#: Blocks of one padded group of pages.
GROUP = 20_000

# Names of HTML elements, and words that tell what an element is for.
UNSEEN = {"template", "datalist"}
BLOCKS = set("address article aside blockquote body button caption center datalist dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td template tfoot th thead tr ul".split())
RAW = set("script style textarea title iframe noembed noframes noscript".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = set("nav header footer aside form head menu dialog button select search".split())
OUTSIDE_WORDS = set("ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies footer form header menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
INSIDE = {"article", "main"}
INSIDE_WORDS = set("article content entry main post story".split())
OUTSIDE_NAMES, INSIDE_NAMES = sorted(OUTSIDE_WORDS), sorted(INSIDE_WORDS)

LEAD = re.compile(r"<!--|<!\[CDATA\[|</([a-zA-Z][^\s/>]*)|<([a-zA-Z][^\s/>]*)|<[!?/]")
STOP = re.compile("[>\"']")
VEILED = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|style\s*=\s*["'][^"']*\b(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PARTS = re.compile(r"[^\W_]+")
ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


class Element(NamedTuple):
    """An open element with what it and all elements around it are: nothing of a path is left out."""

    around: Element | None
    name: tuple[str, ...]  # its tag, then words of its class, id and role
    bits: int  # hashed path tokens
    outside: bool
    inside: bool
    unseen: bool


def element(around: Element | None, tag: str, *words: str, unseen: bool = False) -> Element:
    bits = around.bits if around else 0
    for token in (f"<{tag}", *words, *(f"{tag}.{w}" for w in words)):
        bits |= 1 << bucket(token) % PATHS
    outside = tag in OUTSIDE or not OUTSIDE_WORDS.isdisjoint(words) or bool(around and around.outside)
    inside = tag in INSIDE or not INSIDE_WORDS.isdisjoint(words) or bool(around and around.inside)
    return Element(around, (tag, *words), bits, outside, inside, unseen or bool(around and around.unseen))


def path(inner: Element | None) -> list[tuple[str, ...]]:
    """Names of the elements around a block, outermost first."""
    names = []
    while inner:
        names.append(inner.name)
        inner = inner.around
    return names[::-1]


class Block(NamedTuple):
    inner: Element | None
    text: str
    linked: int  # characters within links


class Scanner:
    """Finds the tags of a page in one pass: what a failed search has read is never read again."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.dead: set[int] = set()  # opening quotes from which no tag ends
        self.endless: set[str] = set()  # elements of raw text without a further end tag

    def tag_end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` ends: at the next > outside quotes; where quotes don't pair, at the next > at all."""
        i, seen = at, []
        while (m := STOP.search(self.page, i)) and m[0] != ">" and m.start() not in self.dead:
            seen.append(m.start())
            i = self.page.find(m[0], m.end()) + 1
            if not i:
                break
        else:
            if m and m[0] == ">":
                return m.start()
        self.dead.update(seen)
        return self.page.find(">", at)

    def raw_end(self, tag: str, at: int) -> int | None:
        """Behind the end tag of an element of raw text; None without one."""
        if tag in self.endless:
            return None
        end = ENDS[tag].search(self.page, at)
        if end is None:
            self.endless.add(tag)
        return end and end.end()

    def tags(self) -> Iterator[tuple[int, str, str, str, int]]:
        """(start, kind, name, rest, end); kinds are open, close, data and none. Send a place to go on from."""
        page, at = self.page, 0
        while m := LEAD.search(page, at):
            start = m.start()
            if m[0] in ("<!--", "<![CDATA["):
                close = "-->" if m[0] == "<!--" else "]]>"
                end = page.find(close, m.end())
                stop = len(page) if end < 0 else end + len(close)
                found = (start, "data" if m[0] == "<![CDATA[" else "none", "", page[m.end() : len(page) if end < 0 else end] if m[0] == "<![CDATA[" else "", stop)
            elif start > self.last:  # no tag ends any more
                at = min([p for p in (page.find("<!--", start), page.find("<![CDATA[", start)) if p >= 0], default=len(page))
                continue
            elif m[2]:
                end = self.tag_end(m.end())
                found = (start, "open", m[2].lower(), page[m.end() : end], end + 1)
            else:
                end = page.find(">", m.end() if m[1] else start + 2)
                if end < 0:
                    at = start + 1
                    continue
                found = (start, "close" if m[1] else "none", (m[1] or "").lower(), "", end + 1)
            skip = yield found
            at = skip if skip is not None else found[4]


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order; scripts, styles, comments and hidden elements are left out.

    Only elements of raw text hide all up to their end tag; without one, scripts, styles and the like
    reach to the end of the page, as in browsers, and a lone noscript tag hides nothing.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[Element] = []
    open_tags: Counter[str] = Counter()
    run: list[str] = []
    veil: list[str] = []  # open inline elements within a hidden one
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append(Block(stack[-1] if stack else None, text, min(linked, len(text))))
            run.clear()
        linked = 0

    def close(tag: str) -> None:
        veil.clear()
        while stack:
            top = stack.pop().name[0]
            open_tags[top] -= 1
            if top == tag:
                break

    def add(text: str) -> None:
        nonlocal linked
        if text and not veil and not (stack and stack[-1].unseen):
            text = html.unescape(text) if "&" in text else text
            run.append(text)
            linked += len(text) * (links > 0)

    scanner = Scanner(page)
    tags = scanner.tags()
    found = next(tags, None)
    while found:
        start, kind, tag, rest, end = found
        add(page[at:start])
        at = end
        if kind == "data":
            add(rest)
        elif kind == "close":
            if veil and tag == veil[-1]:
                veil.pop()
            elif tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                flush()
                if open_tags[tag]:
                    close(tag)
        elif kind == "open":
            if tag in RAW:
                if not rest.endswith("/"):
                    behind = scanner.raw_end(tag, at)
                    at = behind or (at if tag == "noscript" else len(page))
            elif tag == "br":
                run.append(" ")
            elif tag in BLOCKS:
                flush()
                if open_tags["p"]:
                    close("p")
                elif tag in ("li", "option", "dt", "dd", "tr", "td", "th") and stack and stack[-1].name[0] == tag:
                    close(tag)
                if tag not in VOID:
                    words = [w for v in NAMED.findall(rest) for w in PARTS.findall("".join(v).lower())] if "=" in rest else []
                    stack.append(element(stack[-1] if stack else None, tag, *words, unseen=tag in UNSEEN or VEILED.search(rest) is not None))
                    open_tags[tag] += 1
                    links = 0
                    veil.clear()
            elif tag not in VOID and not rest.endswith("/") and (tag == veil[-1] if veil else VEILED.search(rest)):
                veil.append(tag)
            elif tag == "a":
                links += 1
        try:
            found = tags.send(at)
        except StopIteration:
            found = None
    add(page[at:])
    flush()
    return out


def told(found: list[Block]) -> list[int]:
    """Labels from a page's own structure: 1 for main text. Without telling elements, long unlinked text."""
    outside = [bool(b.inner and b.inner.outside) for b in found]
    inside = [bool(b.inner and b.inner.inside) for b in found]
    if any(i and not o for i, o in zip(inside, outside, strict=True)):
        return [int(i and not o) for i, o in zip(inside, outside, strict=True)]
    return [int(not o and len(b.text) >= 80 and b.linked < 0.3 * len(b.text)) for b, o in zip(found, outside, strict=True)]


#: What articles hold besides headings and paragraphs: elements from the outermost, and how many blocks in a row.
PARTS_OF_ARTICLES = [(("ul",), ("li",), 6), (("ol",), ("li",), 6), (("table", "tbody", "tr"), ("td",), 8), (("table", "tr"), ("th",), 4), (("dl",), ("dd",), 4), ((), ("pre",), 2), (("blockquote",), ("p",), 2), ((), ("blockquote",), 1), (("figure",), ("figcaption",), 1), (("div",), ("p",), 3), ((), ("h2",), 1), ((), ("h3",), 1)]


def enriched(page: list[tuple[Block, int]], texts: list[str], rng: random.Random) -> list[tuple[Block, int]]:
    """A page whose main text also holds lists, tables, code, quotes and captions, between and behind its own blocks."""
    own = [i for i, (b, y) in enumerate(page) if y and b.inner]
    for at in sorted(rng.sample(own, min(len(own), rng.randint(1, 4))), reverse=True):
        around, (leaf,), most = rng.choice(PARTS_OF_ARTICLES)
        inner = page[at][0].inner.around
        for tag in around:
            inner = element(inner, tag)
        new = []
        for _ in range(rng.randint(1, most)):
            words = rng.choice(texts).split()
            start = rng.randrange(len(words))
            part = " ".join(words[start : start + rng.choice([1, 2, 4, 8, 16])])
            linked = len(part) * (rng.random() < 0.1)
            new.append((Block(element(inner, leaf), part, linked), 1))
        page[at + 1 : at + 1] = new
    return page


def varied(found: list[Block], labels: list[int], texts: list[str], rng: random.Random, unknown: bool) -> tuple[list[Block], list[int]]:
    """A page with foreign blocks put in; if ``unknown``, with no telling tag and with names that say nothing.

    Where names say nothing, foreign blocks are short or linked, so that texts and their order must tell.
    """
    kinds = [("aside",), ("div", "sidebar"), ("div", "cookie", "notice"), ("form",), ("section", "comments"), ("div", "comment"), ("header",), ("div", "ad"), ("div", "advert"), ("ul", "menu"), ("footer",), ("nav",), ("div", "related"), ("div", "share"), ("div", "newsletter", "signup")]
    out = enriched(list(zip(found, labels, strict=True)), texts, rng)
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(out) + 1)
        near = out[max(0, at - 1)][0].inner if out else None
        kind = rng.choice(kinds) if rng.random() < 0.5 else (rng.choice(["div", "section"]), rng.choice(OUTSIDE_NAMES))
        inner = element(near.around if near else None, *kind)
        if listed := rng.random() < 0.25:
            inner = element(element(inner, "ul"), "li")
        elif rng.random() < 0.7:
            inner = element(inner, rng.choice(["p", "li", "div"]))
        new = []
        for _ in range(rng.randint(1, 6 if listed else 3)):
            text = rng.choice(texts)
            part = text if not unknown and rng.random() < 0.5 else " ".join(text.split()[: rng.randint(1, 5 if unknown else 12)])
            new.append((Block(inner, part, len(part) * (rng.random() < (0.7 if unknown else 0.3))), 0))
        out[at:at] = new
    if unknown or rng.random() < 0.5:
        alias: dict[str, str] = {}
        main = ("div", *rng.choice([(), (rng.choice(INSIDE_NAMES),)]))

        def renamed(name: tuple[str, ...]) -> tuple[str, ...]:
            if not unknown:
                return main if name[0] in INSIDE else name
            tag = "div" if name[0] in INSIDE or name[0] in OUTSIDE else name[0]
            return (tag, *(alias.setdefault(w, f"{rng.randrange(1 << 30):x}") for w in (name if tag != name[0] else name[1:])))

        made: dict[int, Element] = {}

        def moved(e: Element | None) -> Element | None:
            new = []
            while e is not None and id(e) not in made:
                new.append(e)
                e = e.around
            top = made[id(e)] if e is not None else None
            for x in reversed(new):
                top = made[id(x)] = element(top, *renamed(x.name))
            return top

        out = [(b._replace(inner=moved(b.inner)), y) for b, y in out]
    return [b for b, _ in out], [y for _, y in out]


_BUCKET: dict[str, int] = {}


def bucket(word: str) -> int:
    n = _BUCKET.get(word)
    if n is None:
        if len(_BUCKET) > 300_000:
            _BUCKET.clear()
        n = _BUCKET[word] = zlib.crc32(word.encode("utf-8", "replace"))
    return n


def vectors(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), WIDTH), dtype=np.float32)
    last = max(1, len(found) - 1)
    for i, b in enumerate(found):
        bits = (b.inner.bits if b.inner else 0).to_bytes(PATHS // 8, "little")
        x[i, :PATHS] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        words = b.text.split()
        hashed = np.bincount([bucket(w) % WORDS for w in words], minlength=WORDS)
        x[i, PATHS : PATHS + WORDS] = hashed / math.sqrt(float(hashed @ hashed))
        heading = bool(b.inner) and b.inner.name[0] in ("h1", "h2", "h3", "h4", "h5", "h6")
        x[i, PATHS + WORDS :] = (math.log1p(len(b.text)) / 8, b.linked / len(b.text), math.log1p(len(words)) / 6, b.text[-1] in ".!?", i / last, heading)
    return x


class Labeller:
    """Bidirectional LSTM over a page's block vectors, one logit per block."""

    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        init = lambda *s: rng.standard_normal(s) / math.sqrt(s[0])
        self.p = {f"{n}{d}": v for d in "fb" for n, v in (("x", init(WIDTH, 4 * HIDDEN)), ("h", init(HIDDEN, 4 * HIDDEN)), ("c", np.zeros(4 * HIDDEN)))}
        for d in "fb":
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
        self.p |= {"o": init(2 * HIDDEN, 1)[:, 0], "v": np.zeros(WIDTH), "k": np.zeros(1)}

    def run(self, d: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states [time, page, HIDDEN] in one direction; states pass padding unchanged."""
        z_in = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h = c = np.zeros((x.shape[1], HIDDEN))
        out, memory = np.zeros((*x.shape[:2], HIDDEN)), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = z_in[t] + h @ self.p[f"h{d}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            m = mask[t][:, None]
            memory.append((t, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
            out[t] = h
        return out, memory

    def logits(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, list]:
        f, mf = self.run("f", x, mask)
        b, mb = self.run("b", x, mask)
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["o"] + x @ self.p["v"] + self.p["k"], both, mf, mb

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, both, mf, mb = self.logits(x, mask)
        dz = (1 / (1 + np.exp(-z)) - y) * mask / mask.sum()
        g = {"o": np.einsum("tb,tbh->h", dz, both), "v": np.einsum("tb,tbd->d", dz, x), "k": np.array([dz.sum()])}
        d_both = dz[..., None] * self.p["o"]
        for d, memory, d_out in (("f", mf, d_both[..., :HIDDEN]), ("b", mb, d_both[..., HIDDEN:])):
            wh = self.p[f"h{d}"]
            dh = dc = np.zeros((x.shape[1], HIDDEN))
            d_in, d_wh = np.zeros((*x.shape[:2], 4 * HIDDEN)), np.zeros_like(wh)
            for t, h, c, i, f, o, gg, tc, m in reversed(memory):
                dh = dh + d_out[t]
                live, dcl = np.where(m, dh, 0), np.where(m, dc, 0)
                dcl = dcl + live * o * (1 - tc * tc)
                za = np.concatenate([dcl * gg * i * (1 - i), dcl * c * f * (1 - f), live * tc * o * (1 - o), dcl * i * (1 - gg * gg)], axis=1)
                d_in[t] = za
                d_wh += h.T @ za
                dh, dc = np.where(m, za @ wh.T, dh), np.where(m, dcl * f, dc)
            g |= {f"h{d}": d_wh, f"x{d}": np.einsum("tbd,tbk->dk", x, d_in, optimize=True), f"c{d}": d_in.sum((0, 1))}
        return g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 4) -> None:
        """Adam over padded groups of pages; path tokens are left out at random."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for s in range(0, len(order), 32):
                x, mask, y = padded([pages[k] for k in order[s : s + 32]])
                x[..., :PATHS] *= rng.random((1, x.shape[1], PATHS)) > np.where(rng.random((1, x.shape[1], 1)) < 0.3, 0.6, 0.1)
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages are padded in groups of like length."""
        out = [np.empty(0, dtype=bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            n, longest = 0, 0
            while n < len(order) and (n == 0 or (n + 1) * len(pages[order[n]]) <= GROUP):
                longest = len(pages[order[n]])
                n += 1
            group, order = order[:n], order[n:]
            assert longest
            x, mask, _ = padded([(vectors(pages[i]), np.zeros(len(pages[i]))) for i in group])
            z = self.logits(x, mask)[0]
            for k, i in enumerate(group):
                out[i] = z[: len(pages[i]), k] >= 0
        return out


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = max(len(x) for x, _ in pages)
    xs, mask, ys = np.zeros((t, len(pages), WIDTH)), np.zeros((t, len(pages)), dtype=bool), np.zeros((t, len(pages)))
    for k, (x, y) in enumerate(pages):
        xs[: len(x), k], mask[: len(x), k], ys[: len(x), k] = x, True, y
    return xs, mask, ys


def learn(pages: DataFrame, html_col: str = "html", limit: int = PAGES) -> Labeller:
    """A labeller trained on the ``limit`` different pages of smallest hash; untrained if there are none.

    Pages beyond twice the share that is needed are left out before equal pages are merged.
    """
    n = pages.count()
    draw = F.xxhash64("html")
    drawn = pages.select(F.col(html_col).alias("html")).where(F.col("html").isNotNull() & (F.pmod(draw, F.lit(1 << 30)) < F.lit(2 * limit / max(n, 1) * (1 << 30))))
    drawn = drawn.groupBy("html").agg(F.count("*").alias("_n")).orderBy(F.pmod(draw, F.lit(1 << 30)), "html").limit(limit).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["Read more"]
            xs, ys = [], []
            for page in batch.column(0).to_pylist():
                found = blocks(page)
                texts = [*texts, *(b.text for b in found)][-200:]
                rng = random.Random(zlib.crc32(page.encode("utf-8", "replace")))
                own = told(found)
                for b, y in ((found, own), varied(found, own, texts, rng, False), varied(found, own, texts, rng, True)):
                    if b:
                        xs.append(vectors(b[:PAGE_BLOCKS]).tobytes())
                        ys.append(bytes(y[:PAGE_BLOCKS]))
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], ["x", "y"])

    rows = sorted(tuple(r) for r in drawn.mapInArrow(run, "x binary, y binary").collect())  # three rows a page drawn
    made = Labeller()
    if rows:
        made.train([(np.frombuffer(x, np.float32).reshape(-1, WIDTH), np.frombuffer(y, np.uint8).astype(float)) for x, y in rows])
    return made


def extract(df: DataFrame, labeller: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every row: its main blocks, joined by blank lines. Narrow.

    Null and empty pages, and pages without main text, have an empty text; repeated rows stay;
    other columns are ignored; an empty table gives an empty table.
    """
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    shared = df.sparkSession.sparkContext.broadcast(labeller)  # a few thousand numbers
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [blocks(p) for p in part.column(2).to_pylist()]
                texts = ["\n\n".join(b.text for b, ok in zip(f, y, strict=True) if ok) for f, y in zip(found, shared.value.label(found), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.mapInArrow(run, f"page_id {kind}, url string, text string")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn(pages)).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
