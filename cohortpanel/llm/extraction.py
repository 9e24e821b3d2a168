"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import bisect
import html as entities
import random
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_slices, table

#: Elements that end a block; all others are inline.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section summary table"
    " tbody td textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no text of the page, up to their end tag or else the page's end; foreign ones may close themselves.
RAW_TAGS = frozenset("script style template svg iframe noembed noframes object math canvas audio video textarea".split())
FOREIGN_TAGS = frozenset(("svg", "math"))
#: Controls and fallbacks, likewise; without an end tag their tag alone is skipped.
CONTROL_TAGS = frozenset("button datalist noscript select".split())
#: A start tag ends an open element of these, up to the scope's edge.
ENDS = {
    "li": ({"li", "p"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head", "title"}, {"html"}),
}
#: Words that mark a block's purpose in running text.
CUES = frozenset("cookie cookies subscribe newsletter privacy comments comment reply share login signin sponsored advertisement related menu copyright rights terms".split())

#: The rest of a tag from its name on, quoted values as wholes.
_TAG_END = re.compile(r"""[^'">]*+(?:"[^"]*"[^'">]*+|'[^']*'[^'">]*+)*+>""")
_SPECIAL = re.compile("""['">]""")
#: Characters in which a tag's end is looked for before the ends of all tags of the page are worked out.
TAG_LOOK = 4096
_TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACES = re.compile(r"[\t\n\x0b\f\r ]+")
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW_TAGS | CONTROL_TAGS}
_ZEROS, _HUGE = re.compile("&#0+(?=[0-9])"), re.compile("&#[0-9]{8,};?")


@dataclass(eq=False)
class Element:
    """An open element. ``fresh`` are the ancestor features that no element around it has, so those of a path are found
    once each along its elements; ``score`` is for decoding."""

    tag: str
    parent: Element | None
    names: frozenset
    fresh: list[str]
    score: float | None = None

    def path(self) -> list[Element]:
        out, at = [], self
        while at is not None:
            out.append(at)
            at = at.parent
        return out


@dataclass
class Block:
    """A run of text between two block boundaries, the element it stands in and the characters in links."""

    text: str
    element: Element | None
    linked: int


class Tags:
    """Where the tags of a page end, in linear time altogether: ends are looked for nearby, and where one lies far off the
    ends of all possible tags are worked out once, from the page's last character to its first."""

    def __init__(self, page: str):
        self.page, self.last, self.ends = page, page.rfind(">"), None

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose name ends at ``at``: the first outside of quotes, else the first; or -1."""
        if at > self.last:
            return -1
        if self.ends is None:
            found = _TAG_END.match(self.page, at, at + TAG_LOOK)
            if found:
                return found.end() - 1
            self._work_out()
        k = bisect.bisect_left(self.places, at)
        return self.ends[k] if self.ends[k] >= 0 else self.page.find(">", at)

    def _work_out(self):
        self.places = [m.start() for m in _SPECIAL.finditer(self.page)]
        self.ends = [-1] * (len(self.places) + 1)
        following = {"'": len(self.places), '"': len(self.places)}
        for k in range(len(self.places) - 1, -1, -1):
            sign = self.page[self.places[k]]
            if sign == ">":
                self.ends[k] = self.places[k]
                continue
            if following[sign] < len(self.places):
                self.ends[k] = self.ends[following[sign] + 1]
            following[sign] = k


class Stack:
    """Open elements, with the places of each tag and counts of ancestor features."""

    def __init__(self):
        self.items: list[Element] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.names: Counter = Counter()

    def top(self) -> Element | None:
        return self.items[-1] if self.items else None

    def push(self, tag: str, names: frozenset):
        fresh = [f"name:{n}" for n in names if not self.names[n]]
        if not self.places[tag]:
            fresh.append(f"in:{tag}")
        self.names.update(names)
        self.places[tag].append(len(self.items))
        self.items.append(Element(tag, self.top(), names, fresh))

    def cut(self, size: int):
        while len(self.items) > size:
            gone = self.items.pop()
            self.places[gone.tag].pop()
            self.names.subtract(gone.names)

    def end(self, tag: str):
        """An end tag ends the innermost element of its name and all within; without one it is skipped."""
        if self.places[tag]:
            self.cut(self.places[tag][-1])

    def begin(self, tag: str, names: frozenset):
        """A start tag first ends what HTML says it does: a p on top, or elements of ENDS up to the scope's edge."""
        if tag in ENDS:
            ended, edge = ENDS[tag]
            outer = max((self.places[t][-1] for t in edge if self.places[t]), default=-1)
            for t in ended:
                at = bisect.bisect_right(self.places[t], outer)
                if at < len(self.places[t]):
                    self.cut(self.places[t][at])
        elif self.items and self.items[-1].tag == "p":
            self.cut(len(self.items) - 1)
        self.push(tag, names)


def decoded(raw: str) -> str:
    """Character references as characters; numbers out of all range as U+FFFD."""
    if "&" not in raw:
        return raw
    if "&#" in raw:
        raw = _HUGE.sub("�", _ZEROS.sub("&#", raw))
    return entities.unescape(raw)


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks with text in page order, in time linear in the page. Markup need not be well-formed: unknown end tags are
    skipped, p, li, cells and head end where HTML says so, an unclosed comment or raw element takes the rest of the page,
    controls and what stands in for scripts have no text, and a ``<`` that begins no tag is text."""
    page = page or ""
    blocks: list[Block] = []
    stack, tags = Stack(), Tags(page)
    parts: list[str] = []
    linked, in_link, at, done = 0, False, 0, 0  # done: what stands before is read
    unended: set[str] = set()  # controls that no later end tag closes

    def add(raw: str):
        nonlocal linked
        text = decoded(raw)
        parts.append(text)
        if in_link:
            linked += len(text)

    def close():
        nonlocal linked
        if parts:
            text = _SPACES.sub(" ", "".join(parts)).strip(" ")
            if text:
                blocks.append(Block(text, stack.top(), linked))
            parts.clear()
        linked = 0

    while (at := page.find("<", at)) >= 0:
        found = None
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            end = end + 3 if end >= 0 else len(page)
        elif at > tags.last:  # no tag ends any more, but a comment may begin
            comment = page.find("<!--", at)
            if comment < 0:
                break
            at = comment
            continue
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) + 1
        elif found := _TAG_NAME.match(page, at + 1):
            end = tags.end(found.end()) + 1
        else:
            end = 0
        if not end:
            at += 1
            continue
        if done < at:
            add(page[done:at])
        at = done = end
        if found is None:
            continue
        slash, name = found[1], found[2].lower()
        attributes = page[found.end() : end - 1]
        if name in RAW_TAGS:
            if not slash and not (name in FOREIGN_TAGS and attributes.endswith("/")):
                over = _RAW_ENDS[name].search(page, at, tags.last + 1)
                at = done = over.end() if over else len(page)
        elif name in CONTROL_TAGS:
            close()
            if not slash and name not in unended:
                if over := _RAW_ENDS[name].search(page, at, tags.last + 1):
                    at = done = over.end()
                else:
                    unended.add(name)
        elif name == "a":
            in_link = not slash
        elif name == "br":
            parts.append(" ")
        elif name == "hr":
            close()
        elif name in BLOCK_TAGS:
            close()
            if slash:
                stack.end(name)
            else:
                names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if attributes else ""
                stack.begin(name, frozenset(_WORDS.findall(names.lower())))
    if done < len(page):
        add(page[done:])
    close()
    return blocks


def text_features(block: Block) -> list[str]:
    """Features of a block but those of its ancestors."""
    found = [f"leaf:{block.element.tag if block.element else ''}"]
    text = block.text
    words = text.count(" ") + 1
    found.append("words:" + ("1" if words < 2 else "2" if words < 4 else "4" if words < 10 else "10" if words < 30 else "30"))
    share = block.linked / len(text)
    found.append("links:" + ("none" if share == 0 else "some" if share < 0.5 else "most"))
    if text[-1] in ".!?:;\"')”":
        found.append("ends")
    if "©" in text:
        found.append("sign")
    if words < 40:
        found += [f"cue:{w}" for w in CUES.intersection(_WORDS.findall(text.lower()))]
    return found


def features(block: Block) -> list[str]:
    """Ancestor-tag and text features of a block."""
    path = block.element.path() if block.element else []
    return [f for e in path for f in e.fresh] + text_features(block)


@dataclass
class Chain:
    """Weights of the field: ``emission`` of each feature for a content block, ``move[a][b]`` from label a to b,
    ``begin`` and ``end`` of each label. Label 1 is content."""

    emission: dict
    bias: float
    move: list
    begin: list
    end: list

    def emitted(self, block: Block) -> float:
        """Score of the block as content. Elements keep the score of their path, so shared paths are summed once."""
        get, unknown, at = self.emission.get, [], block.element
        while at is not None and at.score is None:
            unknown.append(at)
            at = at.parent
        path = at.score if at is not None else 0.0
        for element in reversed(unknown):
            path = element.score = path + sum(get(f, 0.0) for f in element.fresh)
        return self.bias + path + sum(get(f, 0.0) for f in text_features(block))

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most likely labels (Viterbi). Blocks are those of one page and belong to this field alone."""
        if not blocks:
            return []
        (m00, m01), (m10, m11) = self.move
        back, s0, s1 = [], 0.0, 0.0
        for k, block in enumerate(blocks):
            e = self.emitted(block)
            if k == 0:
                s0, s1 = self.begin[0], self.begin[1] + e
                continue
            a0, b0, a1, b1 = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((b0 > a0, b1 > a1))
            s0, s1 = max(a0, b0), max(a1, b1) + e
        label = s1 + self.end[1] > s0 + self.end[0]
        labels = [label]
        for came0, came1 in reversed(back):
            label = came1 if label else came0
            labels.append(label)
        return labels[::-1]

    def text(self, page: str | None) -> str:
        blocks = leaf_blocks(page)
        return "\n".join(b.text for b, keep in zip(blocks, self.decode(blocks)) if keep)


@dataclass
class Labelled:
    """Labelled pages as arrays, padded to the longest: places of features and true labels."""

    rows: np.ndarray
    cols: np.ndarray
    names: dict[str, int]
    truth: np.ndarray
    valid: np.ndarray = field(repr=False)


def arrays(pages: list[tuple[list[Block], list[bool]]]) -> Labelled:
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    size, longest = len(pages), max(len(b) for b, _ in pages)
    rows, cols = [], []
    truth, valid = np.zeros((size, longest), dtype=int), np.zeros((size, longest), dtype=bool)
    for i, (blocks, labels) in enumerate(pages):
        truth[i, : len(labels)], valid[i, : len(labels)] = labels, True
        for t, block in enumerate(blocks):
            for f in features(block):
                rows.append(i * longest + t)
                cols.append(names.setdefault(f, len(names)))
    return Labelled(np.array(rows), np.array(cols), names, truth, valid)


def likelihood(w: np.ndarray, data: Labelled) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of all pages and its gradient, by forward-backward. ``w``: emissions, bias, moves (4), begin
    (2), end (2)."""
    k, (size, longest), at = len(data.names), data.truth.shape, np.arange(len(data.truth))
    truth, valid, last = data.truth, data.valid, data.valid.sum(axis=1) - 1
    move, begin, end = w[k + 1 : k + 5].reshape(2, 2), w[k + 5 : k + 7], w[k + 7 :]
    e = np.zeros((size, longest, 2))
    e[:, :, 1] = (w[k] + np.bincount(data.rows, w[data.cols], minlength=size * longest)).reshape(size, longest)
    fore, aft = np.zeros_like(e), np.zeros_like(e)
    fore[:, 0] = begin + e[:, 0]
    for t in range(1, longest):
        fore[:, t] = np.logaddexp(fore[:, t - 1, :1] + move[0], fore[:, t - 1, 1:] + move[1]) + e[:, t]
    for t in range(longest - 1, -1, -1):
        if t + 1 < longest:
            onward = e[:, t + 1] + aft[:, t + 1]
            aft[:, t] = np.logaddexp(move[:, 0] + onward[:, :1], move[:, 1] + onward[:, 1:])
        aft[last == t, t] = end
    total = np.logaddexp(*(fore[at, last] + end).T)
    marginal = np.where(valid[:, :, None], np.exp(np.minimum(0, fore + aft - total[:, None, None])), 0)
    error = np.where(valid, marginal[:, :, 1] - truth, 0)
    g = np.zeros_like(w)
    g[:k], g[k] = np.bincount(data.cols, error.reshape(-1)[data.rows], minlength=k), error.sum()
    pair = valid[:, 1:]
    for a in (0, 1):
        for b in (0, 1):
            p = np.exp(np.minimum(0, fore[:, :-1, a] + move[a, b] + e[:, 1:, b] + aft[:, 1:, b] - total[:, None]))
            g[k + 1 + 2 * a + b] = (p[pair] - ((truth[:, :-1] == a) & (truth[:, 1:] == b))[pair]).sum()
        g[k + 5 + a] = (marginal[:, 0, a] - (truth[:, 0] == a)).sum()
        g[k + 7 + a] = (marginal[at, last, a] - (truth[at, last] == a)).sum()
    gold = begin[truth[:, 0]] + end[truth[at, last]] + np.where(valid, np.take_along_axis(e, truth[:, :, None], 2)[:, :, 0], 0).sum(axis=1)
    gold = gold + np.where(pair, move[truth[:, :-1], truth[:, 1:]], 0).sum(axis=1)
    return float((total - gold).sum()), g


def fit(pages: list[tuple[list[Block], list[bool]]], steps: int = 250, rate: float = 0.1, ridge: float = 1e-4) -> Chain:
    """Maximum likelihood by Adam over all pages at once."""
    data = arrays(pages)
    k = len(data.names)
    w = np.zeros(k + 9)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = likelihood(w, data)[1] / data.valid.sum() + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Chain({f: float(w[c]) for f, c in data.names.items()}, float(w[k]), w[k + 1 : k + 5].reshape(2, 2).tolist(), w[k + 5 : k + 7].tolist(), w[k + 7 :].tolist())


#: Marks content words of the labelled pages; it is taken out before features are made.
MARK = "\ue000"


class PageMaker:
    """Labelled pages: layouts, wrappers and boilerplate of many sites are drawn at random; labels come with them."""

    ROOTS = ("<article>", "<article class=post>", "<main>", "<main><article>", '<div class="content">', '<div id="main-content">', '<div class="entry post-body">', "<section class=story>", '<div role="main">', "<table><tr><td class=text>", "<div>", "<div><div>", "")
    BOILER = (
        ("<nav>", "menu"), ('<div class="menu">', "menu"), ("<ul id=navigation>", "menu"), ("<header>", "short"), ('<div id="header">', "short"), ("<footer>", "legal"), ('<div class="footer">', "legal"),
        ("<aside>", "mixed"), ('<div class="sidebar">', "mixed"), ('<div id="sidebar" class="widget">', "menu"), ('<div class="ad">', "prose"), ('<div class="advert banner">', "short"), ('<div class="sponsored promo">', "prose"),
        ('<div class="notice cookie">', "prose"), ('<div id="cookie-notice">', "short"), ('<section class="comments">', "prose"), ('<div id="comments"><div class="comment">', "prose"), ('<ol class="comment-list">', "items"),
        ("<form>", "short"), ('<div class="newsletter subscribe"><form>', "short"), ('<div class="related">', "menu"), ('<div class="share social">', "menu"), ('<div class="breadcrumb">', "menu"), ('<div role="alert">', "prose"), ("<dialog>", "prose"),
        ('<section id="disqus_thread">', "thread"), ('<div class="responses">', "thread"), ('<div id="respond">', "thread"), ('<ul class="discussion">', "items"), ('<div class="replies">', "thread"), ("<div>", "thread"), ("<section>", "thread"),
        ("<div>", "menu"), ("<div>", "legal"), ("<noscript>", "prose"), ("<select>", "options"), ("<form>", "controls"),
    )
    THREADS = ("Leave a reply", "Comments", "3 comments", "Join the discussion", "Responses", "12 replies", "Leave a comment", "What do you think?")
    LETTERS = ("etaoinshrdlucm", "enisratdhulcgmäöüß", "esaitnrulodcpmvéèçê", "eaosrnidlctumpñóíá")

    def __init__(self, seed: int, roots=ROOTS, boiler=BOILER):
        self.r, self.roots, self.boilers = random.Random(seed), roots, boiler
        among = ("ad", "aside", "comment", "share", "related", "form", "sponsored", "notice")
        self.inside = tuple(b for b in boiler if any(x in b[0] for x in among) and "header" not in b[0]) or boiler

    def word(self) -> str:
        return "".join(self.r.choices(self.letters, k=self.r.randint(1, 9)))

    def prose(self, mark: str) -> str:
        r, style = self.r, self.r.random()
        words = [self.word() for _ in range(min(r.choice((1, 2, 4, 8, 15, 30, 60)), r.randint(1, 60)))]
        if style < 0.15:
            words = [w.upper() + "!!" for w in words]
        elif style < 0.25:
            words = [w + r.choice(("***", "###", "%%%", "&amp;&amp;")) for w in words]
        elif style < 0.3:
            words = [w + " |" for w in words]
        text = " ".join(words).capitalize() if style >= 0.15 else " ".join(words)
        return mark + text + r.choice((".", ".", ".", "", "!", "?"))

    def content(self) -> str:
        r = self.r
        open_ = r.random() < 0.2
        parts = [f"<h{r.choice('112')}>{self.prose(MARK)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice((1, 1, 2, 3, 5, 8))):
            kind = r.random()
            if kind < 0.75:
                parts.append(f"<p>{'<b>' * (r.random() < 0.2)}{self.prose(MARK)}" + ("" if open_ else "</p>"))
            elif kind < 0.82:
                parts.append("<ul>" + "".join(f"<li>{self.prose(MARK)}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif kind < 0.88:
                parts.append(f"<h{r.choice('23')}>{self.prose(MARK)}</h2>")
            elif kind < 0.94:
                parts.append(f"<blockquote>{self.prose(MARK)}</blockquote>")
            else:
                parts.append(f'<p>{self.prose(MARK)} <a href="/{self.word()}">{self.word()}</a> {self.word()}</p>')
            if r.random() < 0.12:
                parts.append(self.boiler(self.inside))
        return "".join(parts)

    def boiler(self, kinds) -> str:
        r = self.r
        start, kind = r.choice(kinds)
        link = lambda: f'<a href="/{self.word()}">{self.word()} {self.word() if r.random() < 0.3 else ""}</a>'
        head, item = r.choice(("h2", "h3", "h4", "p", "div")), r.choice(("p", "div", "li"))
        body = {
            "menu": lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8))) + "</ul>",
            "short": lambda: "".join(f"<div>{self.word()} {r.choice(sorted(CUES))}</div>" for _ in range(r.randint(1, 3))),
            "legal": lambda: f"&copy; {self.word()} &middot; {self.prose('')}",
            "prose": lambda: r.choice(("", "<p>")) + self.prose(""),
            "items": lambda: "".join(f"<li>{self.prose('')}</li>" for _ in range(r.randint(1, 4))),
            "thread": lambda: f"<{head}>{r.choice(self.THREADS)}{r.choice(('', '.', ':'))}</{head}>"
            + "".join(f"<{item}>{self.word().capitalize()} {r.choice(('says:', 'wrote:', 'said'))} {self.prose('')}{r.choice(('', ' <a href=#>Reply</a>'))}</{item}>" for _ in range(r.randint(1, 4))),
            "options": lambda: "".join(f"<option>{self.prose('')}" for _ in range(r.randint(2, 5))),
            "controls": lambda: f"<label>{self.word()}</label><textarea>{self.prose('')}</textarea><button>{self.word()}</button>",
            "mixed": lambda: f"<h3>{self.word()}</h3><p>{self.prose('')}</p>{link()}",
        }[kind]()
        tags = re.findall(r"<(\w+)", start)
        return start + body + "".join(f"</{t}>" for t in reversed(tags))

    def page(self) -> str:
        r = self.r
        self.letters = r.choice(self.LETTERS)
        if r.random() < 0.04:  # no markup at all
            return " ".join(self.prose(MARK if k == 0 else "") for k in range(r.randint(1, 4)))
        root = r.choice(self.roots)
        before = "".join(self.boiler(self.boilers) for _ in range(r.randint(0, 4)))
        after = "".join(self.boiler(self.boilers) for _ in range(r.randint(0, 4)))
        ends = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", root)))
        head = f"<html><head><title>{self.prose('')}</title></head>" if r.random() < 0.75 else r.choice(("", "<html>"))
        return f"{head}<body>{before}{root}{self.content()}{ends}{after}</body></html>"


def labelled_pages(n: int, seed: int, roots=PageMaker.ROOTS, boiler=PageMaker.BOILER) -> list[tuple[list[Block], list[bool]]]:
    maker, out = PageMaker(seed, roots, boiler), []
    for _ in range(n):
        blocks = leaf_blocks(maker.page())
        labels = [MARK in b.text for b in blocks]
        for b in blocks:
            b.text = b.text.replace(MARK, "") or "-"
        out.append((blocks, labels))
    return out


def trained(n_pages: int = 600, seed: int = 5) -> Chain:
    return fit(labelled_pages(n_pages, seed))


def unseen_layouts(fold: int, folds: int = 4, n_pages: int = 600, seed: int = 5) -> float:
    """Share of blocks labelled wrongly on pages all of whose roots and boilerplate elements are of a fold that no page of
    the training set has: what to expect of sites that the generator doesn't know."""
    kept = lambda items, own: tuple(x for k, x in enumerate(items) if (k % folds == fold) == own)
    chain = fit(labelled_pages(n_pages, seed, kept(PageMaker.ROOTS, False), kept(PageMaker.BOILER, False)))
    pages = labelled_pages(n_pages, seed + 1, kept(PageMaker.ROOTS, True), kept(PageMaker.BOILER, True))
    wrong = sum(a != b for blocks, labels in pages for a, b in zip(chain.decode(blocks), labels))
    return wrong / sum(len(labels) for _, labels in pages)


def extract(pages: DataFrame, chain: Chain, html: str = "html") -> DataFrame:
    """``pages`` with text (content blocks joined by newlines; empty for null or empty pages) and n_chars, replacing
    columns of those names. Rows stay as they are, repeated or not; an empty table gives no rows. Very long pages take time
    and memory linear in their length, whatever their markup. Text without markup has no ancestors; only its own
    features judge it."""
    shared = pages.sparkSession.sparkContext.broadcast(chain)

    @F.arrow_udf("string")
    def main_text(column: pa.Array) -> pa.Array:
        text, batch = shared.value.text, pa.RecordBatch.from_arrays([column], ["html"])
        return pa.array([text(x) for part in arrow_slices(batch, "html") for x in part["html"].to_pylist()], pa.string())

    return pages.withColumn("text", main_text(F.col(html))).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), trained()).select("page_id", "url", "text", "n_chars")
