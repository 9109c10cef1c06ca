"""Main-text extraction: a linear-chain conditional random field over the DOM's leaf blocks.

A page is parsed into leaf blocks: runs of text between the tags of block elements, each with its chain of open
elements.  Comments, scripts, styles, form fields and other elements without page text are no blocks; what stands
in for scripts, drawings and media is a block like others, and formulas belong to their line.  Blocks carry
features of their ancestors (tags, words of class, id and role), of their own tag and of their text (length, link
share, sentence marks, signs of legal lines); the chain adds label pairs.  The weights are trained on
TRAIN_PAGES generated labelled pages of many layouts (no page of the input is needed, and no label but the
generator's), by gradient ascent on the conditional likelihood, with the seed SEED.  Viterbi decodes each page.

The text of a block has its character references decoded, its white space made one space and its ends trimmed;
the blocks labelled content are joined by a line feed.  Null html is an empty page: empty text.  Pages that
break off or are ill-formed are parsed as far as they go: a quote in a tag counts only where it opens a value and
another one ends it before a space or the tag's end, so a lone one hides no text; end tags without a start are skipped, open elements end
with an ancestor, an open head at the first start tag that cannot stand in one.  Repeated rows give equal rows; an empty table stays empty.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import arrow_bounds, distinct_name, read

SEED, TRAIN_PAGES, EPOCHS, RATE, L2 = 7, 500, 12, 0.3, 1e-4

# Classes of HTML elements.
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIP = set("script style template iframe head title textarea noembed noframes select option datalist".split())
#: What stands in for scripts, drawings and media: blocks of their own, decided by label; math stays in its line.
STAND_IN = set("noscript object svg canvas audio video xmp".split())
BLOCK |= STAND_IN
RAW = set("script style textarea title iframe noembed noframes xmp".split())
#: Elements that may stand in a head; the start of another one ends it.
IN_HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: An opening tag of the first ends open ones of the second, up to an element of the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
P_ENDS = BLOCK - {"body", "html", "button", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend", "select", "frameset"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"(?=[\s/>]|\Z)|=\s*'[^']*'(?=[\s/>]|\Z)|=)*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LEGAL = re.compile(r"©|\(c\)|copyright|all rights reserved|privacy|cookie|subscribe|sign in|log in|newsletter|share|advert|sponsor", re.I)


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple, linked: int):
        self.text, self.path, self.linked = text, path, linked


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = skipping = anchors = 0

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, tuple(stack), linked))
        parts, linked = [], 0

    def close(upto: int):
        nonlocal skipping, anchors
        while len(stack) > upto:
            if stack[-1][0] in BLOCK:
                flush()
            tag, _ = stack.pop()
            skipping -= tag in SKIP
            anchors -= tag == "a"

    page, at = page or "", 0
    size = len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else size
        if stop > at and not skipping:
            piece = entities.unescape(page[at:stop])
            parts.append(piece)
            if anchors:
                linked += len(piece.strip())
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            else:
                if tag in BLOCK:
                    flush()
            continue
        if skipping and tag not in IN_HEAD:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "head":
                    close(k)
                    break
                if stack[k][0] in SKIP or stack[k][0] in STAND_IN:
                    break
        if tag == "br":
            if not skipping:
                parts.append(" ")
            continue
        if tag in P_ENDS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if tag in CLOSES:
            ends, border = CLOSES[tag]
            cut = None
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in border:
                    break
                if stack[k][0] in ends:
                    cut = k
            if cut is not None:
                close(cut)
        if tag in BLOCK:
            flush()
        if tag in VOID or found[3].endswith("/") and tag not in BLOCK and tag not in SKIP:
            continue
        words = tuple(sorted({w.lower() for m in _ATTR.finditer(found[3]) for w in _PART.findall(next(x for x in m.groups() if x is not None))})) if found[3] else ()
        stack.append((tag, words))
        skipping += tag in SKIP
        anchors += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            at = end.start() if end else size
    close(0)
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out, n = [], len(page)
    for i, b in enumerate(page):
        f = ["any"]
        chain = [t for t, _ in b.path if t in BLOCK and t not in ("html", "body", "div")]
        f += {f"in:{t}" for t in chain}
        own = next((t for t, _ in reversed(b.path) if t in BLOCK), "none")
        f.append(f"own:{own}")
        words = {w for _, ws in b.path for w in ws}
        f += [f"word:{w}" for w in words]
        if not chain:
            f.append("bare")
        size = len(b.text)
        level = size.bit_length()
        f.append(f"len:{min(level, 11)}")
        share = b.linked / size
        f.append(f"link:{0 if not share else 1 if share < 0.5 else 2 if share < 0.9 else 3}")
        f.append(f"stop:{b.text[-1] in '.!?…。:;'}")
        commas = b.text.count(",") + b.text.count(". ")
        f.append(f"marks:{min(commas, 3)}")
        if _LEGAL.search(b.text) and size < 200:
            f.append("legal")
        f.append("first" if i == 0 else "last" if i == n - 1 else "mid")
        out.append(f)
    return out


class Crf:
    """Two labels (0: other, 1: content), binary features, label pairs."""

    def __init__(self, index: dict[str, int], state: np.ndarray, pair: np.ndarray):
        self.index, self.state, self.pair = index, state, pair

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        get = self.index.get
        return np.array([self.state[[k for k in map(get, f) if k is not None]].sum(axis=0) for f in feats])

    def decode(self, feats: list[list[str]]) -> list[int]:
        """Viterbi; ties go to label 0."""
        if not feats:
            return []
        (p00, p01), (p10, p11) = self.pair.tolist()
        scores = self.scores(feats).tolist()
        a, b = scores[0]
        back = []
        for s0, s1 in scores[1:]:
            from0, from1 = int(b + p10 > a + p00), int(b + p11 > a + p01)
            back.append((from0, from1))
            a, b = (b + p10 if from0 else a + p00) + s0, (b + p11 if from1 else a + p01) + s1
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = RATE, l2: float = L2) -> Crf:
    """AdaGrad on the log likelihood, a page at a time; marginals by forward and backward sums."""
    index = {f: k for k, f in enumerate(sorted({f for feats, _ in pages for fs in feats for f in fs}))}
    state, pair = np.zeros((len(index), 2)), np.zeros((2, 2))
    state_sq, pair_sq = np.full_like(state, 1e-6), np.full_like(pair, 1e-6)
    coded = [([np.array([index[f] for f in fs]) for fs in feats], np.array(labels)) for feats, labels in pages if feats]
    rng = np.random.default_rng(SEED)
    for _ in range(epochs):
        for at in rng.permutation(len(coded)):
            feats, gold = coded[at]
            n = len(feats)
            s = np.exp(np.clip(np.array([state[f].sum(axis=0) for f in feats]), -30, 30))
            t = np.exp(np.clip(pair, -30, 30))
            fwd, bwd = np.empty((n, 2)), np.ones((n, 2))
            fwd[0] = s[0] / s[0].sum()
            for k in range(1, n):
                v = fwd[k - 1] @ t * s[k]
                fwd[k] = v / v.sum()
            for k in range(n - 2, -1, -1):
                v = t @ (s[k + 1] * bwd[k + 1])
                bwd[k] = v / v.sum()
            own = fwd * bwd
            own /= own.sum(axis=1, keepdims=True)
            want = np.zeros((n, 2))
            want[np.arange(n), gold] = 1
            off = want - own
            flat, where = np.concatenate(feats), np.repeat(np.arange(n), [len(f) for f in feats])
            rows, inv = np.unique(flat, return_inverse=True)
            g = np.zeros((len(rows), 2))
            np.add.at(g, inv, off[where])
            g -= l2 * state[rows]
            state_sq[rows] += g * g
            state[rows] += rate * g / np.sqrt(state_sq[rows])
            if n > 1:
                joint = fwd[:-1, :, None] * t[None] * (s[1:] * bwd[1:])[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                gp = np.zeros((2, 2))
                np.add.at(gp, (gold[:-1], gold[1:]), 1)
                gp -= joint.sum(axis=0) + l2 * pair
                pair_sq += gp * gp
                pair += rate * gp / np.sqrt(pair_sq)
    return Crf(index, state, pair)


# --- labelled pages ---------------------------------------------------------------------------

# Names that pages give to parts, by what the part is.
PARTS = {
    "menu": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "toc"],
    "head": ["header", "masthead", "banner", "site-header", "logo", "branding"],
    "foot": ["footer", "site-footer", "colophon", "copyright", "bottom", "legal"],
    "side": ["sidebar", "aside", "widget", "related", "recommended", "trending", "more-stories", "tags", "author-bio"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "adsense", "banner-ad", "sponsor"],
    "notice": ["cookie", "cookie-banner", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "paywall", "gdpr"],
    "form": ["search", "login", "signup", "contact-form", "search-form"],
    "talk": ["comments", "comment", "comment-list", "responses", "disqus", "replies", "reader-comments", "discussion"],
    "share": ["share", "social", "share-buttons", "sharing", "follow"],
    "main": ["content", "main", "post", "entry", "article", "article-body", "story", "post-content", "entry-content", "text", "main-content", "body-text", "page", "prose"],
}
_SOUNDS = ["th", "an", "er", "in", "on", "re", "ed", "ti", "es", "or", "st", "en", "al", "ch", "ge", "eau", "ión", "ou", "lich", "ado", "qu", "é", "ü", "ñ"]


class _Writer:
    """A random page; said keeps (text, label) of each block in order."""

    def __init__(self, rng):
        self.rng, self.out, self.said = rng, [], []
        self.rest = np.random.default_rng([SEED, int(rng.bit_generator.state["state"]["state"]) & 0xFFFFFFFF])  # for what was added later

    def pick(self, items):
        return items[int(self.rng.integers(len(items)))]

    def chance(self, p):
        return self.rng.random() < p

    def words(self, low, high):
        n = int(self.rng.integers(low, high + 1))
        return ["".join(self.pick(_SOUNDS) for _ in range(int(self.rng.integers(1, 5)))) for _ in range(n)]

    def sentence(self, low=4, high=18):
        style = self.style if hasattr(self, "style") else 0
        text = " ".join(self.words(low, high)).capitalize()
        if style == 1:
            text = "!! ".join(text.upper().split())
        elif style == 2:
            text = "*** ".join(text.split()) + "###"
        return text + self.pick([".", ".", ".", "?", "!", ""])

    def prose(self):
        return " ".join(self.sentence() for _ in range(int(self.rng.integers(1, 7))))

    def add(self, tag, text, label, attr="", inner=None):
        shown = entities.escape(text, quote=False)
        self.out.append(f"<{tag}{attr}>{inner(shown) if inner else shown}" + (f"</{tag}>" if tag not in ("p", "li") or self.chance(0.9) else ""))
        self.said.append((text, label))

    def named(self, kind):
        name = self.pick(PARTS[kind])
        return f' {self.pick(["class", "class", "id"])}="{name}{self.pick(["", "", " box", " wide", "-1"])}"'

    def links(self, n):
        for _ in range(n):
            self.add("li", " ".join(self.words(1, 3)), 0, inner=lambda t: f'<a href="/{len(t)}">{t}</a>')

    def part(self, kind):
        tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind, "div")
        if self.chance(0.4):
            tag = self.pick(["div", "section", "div"]) if kind != "form" or self.chance(0.3) else tag
        attr = self.named(kind) if tag in ("div", "section") or self.chance(0.4) else ""
        self.out.append(f"<{tag}{attr}>")
        if kind == "menu" or kind == "share" or kind == "side" and self.chance(0.5):
            if kind == "side":
                self.add(self.pick(["h3", "h4", "div"]), " ".join(self.words(1, 3)), 0)
            self.out.append("<ul>")
            self.links(int(self.rng.integers(2, 8)))
            self.out.append("</ul>")
        elif kind == "head":
            self.add(self.pick(["h1", "div", "p", "h2"]), " ".join(self.words(1, 4)), 0)
            if self.chance(0.4):
                self.add("p", self.sentence(), 0)
        elif kind == "foot":
            text = self.pick(["© ", "Copyright ", "", "All rights reserved. "]) + self.prose()
            if self.chance(0.5):
                self.out.append(entities.escape(text, quote=False))
                self.said.append((text, 0))
            else:
                self.add("p", text, 0)
        elif kind == "form":
            self.add(self.pick(["label", "p", "div"]), " ".join(self.words(1, 5)), 0)
            self.out.append('<input type="text">')
            self.add("button", self.pick(self.words(1, 2)), 0)
        elif kind == "talk":
            self.add(self.pick(["h3", "h2"]), " ".join(self.words(1, 2)), 0)
            for _ in range(int(self.rng.integers(1, 5))):
                self.add(self.pick(["p", "div", "li"]), self.prose(), 0)
        else:
            if self.chance(0.5):
                text = self.sentence(5, 25) if self.chance(0.7) else self.prose()
                self.out.append(entities.escape(text, quote=False))
                self.said.append((text, 0))
            else:
                self.add("p", self.sentence(5, 25), 0)
        self.out.append(f"</{tag}>")

    def stand_in(self):
        """A line for readers without scripts, drawings or media; drawn apart, so that the rest of the page stays."""
        self.rng, own = self.rest, self.rng
        if self.chance(0.15):
            tag = self.pick(["noscript", "noscript", "canvas", "object", "video", "audio", "svg"])
            self.add(tag, self.sentence(), 0)
        self.rng = own

    def article(self):
        form = self.pick(["article", "article", "main", "div", "div", "section", "both", "bare"])
        opened = []
        if form != "bare":
            for tag in {"both": ["main", "article"]}.get(form, [form]):
                opened.append(tag)
                self.out.append(f"<{tag}{self.named('main') if tag in ('div', 'section') or self.chance(0.3) else ''}>")
        if self.chance(0.85):
            self.add(self.pick(["h1", "h1", "h2"]), self.sentence(3, 10), 1)
        if self.chance(0.15):
            self.part("share")
        for _ in range(int(self.rng.integers(1, 12))):
            roll = self.rng.random()
            if roll < 0.72:
                text = self.prose() if self.chance(0.85) else self.sentence(1, 3)
                self.add("p", text, 1, inner=(lambda t: f"<b>{t}<br>") if self.chance(0.1) else (lambda t: t.replace(" ", ' <a href="/x">', 1) + "</a>") if self.chance(0.1) and " " in text else None)
            elif roll < 0.8:
                self.add(self.pick(["h2", "h3"]), self.sentence(2, 7), 1)
            elif roll < 0.86:
                self.out.append("<ul>")
                for _ in range(int(self.rng.integers(2, 5))):
                    self.add("li", self.sentence(2, 14), 1)
                self.out.append("</ul>")
            elif roll < 0.9:
                self.add(self.pick(["blockquote", "pre", "figcaption"]), self.sentence(), 1)
            elif roll < 0.93:
                self.out.append("<table><tr>")
                for _ in range(3):
                    self.add("td", " ".join(self.words(1, 4)), 1)
                self.out.append("</tr></table>")
            else:
                self.part(self.pick(["ad", "ad", "side", "notice", "share", "form"]))
        if self.chance(0.1):
            self.part("talk")
        for tag in reversed(opened):
            self.out.append(f"</{tag}>")

    def page(self):
        self.style = self.pick([0, 0, 0, 1, 2])
        self.out.append('<!DOCTYPE html><html><head><meta charset="utf-8"><title>x</title><style>p{margin:0}</style></head><body>')
        for kind, p in (("notice", 0.2), ("head", 0.4), ("menu", 0.75), ("form", 0.15), ("ad", 0.4)):
            if self.chance(p):
                self.part(kind)
        self.stand_in()
        self.article()
        self.stand_in()
        for kind, p in (("share", 0.15), ("talk", 0.3), ("side", 0.35), ("ad", 0.2), ("notice", 0.15), ("foot", 0.8)):
            if self.chance(p):
                self.part(kind)
        self.out.append("</body></html>" if self.chance(0.9) else "")
        return "".join(self.out), [(" ".join(t.split()), y) for t, y in self.said]


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[tuple[str, int]]]]:
    """(html, [(block text, label)]) of generated pages."""
    rng = np.random.default_rng(seed)
    return [_Writer(rng).page() for _ in range(n)]


def _aligned(page: list[Block], said: list[tuple[str, int]]) -> list[int] | None:
    """Labels of the parsed blocks; None where the parser saw other blocks than the writer."""
    return [y for _, y in said] if [b.text for b in page] == [t for t, _ in said] else None


@lru_cache(maxsize=1)
def model(n_pages: int = TRAIN_PAGES, seed: int = SEED) -> Crf:
    """Trained once in a process, on generated pages only."""
    data = []
    for page, said in labelled_pages(n_pages, seed):
        parsed = blocks(page)
        labels = _aligned(parsed, said)
        if labels is not None:
            data.append((features(parsed), labels))
    return train(data)


def main_text(page: str | None, crf: Crf) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, y in zip(found, crf.decode(features(found)), strict=True) if y)


def extract(df: DataFrame, html: str = "html", text: str = "text", crf: Crf | None = None) -> DataFrame:
    """``df`` without its html and with the page's main text (name made distinct if taken)."""
    spark = df.sparkSession
    arrow_bounds(spark)
    keep = [c for c in df.columns if c != html]
    text = distinct_name(keep, text)
    sent = spark.sparkContext.broadcast(crf or model())  # weights of a few hundred features
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(text, T.StringType(), False)])
    n_keep = len(keep)

    def run(batches):
        crf = sent.value
        for batch in batches:
            texts = [main_text(h, crf) for h in batch.column(n_keep).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n_keep)), pa.array(texts, pa.string())], names=[*keep, text])

    return df.select(*keep, F.col(html).alias(distinct_name(keep, html))).mapInArrow(run, schema)


def op2_html_crf(spark, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op2_html_crf": op2_html_crf}
SQL: dict[str, str] = {}
