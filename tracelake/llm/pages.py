"""Main text of web pages by tag-path ratios.

A page's text belongs to the paths of its block elements (tags with their class or id, from the root).  Over the page every path
gets its text length, its punctuation marks, its characters in links and its number of runs.  The ratios of length and of
punctuation to runs, less the share in links, are fused by multiplication, smoothed (by the geometric mean with those of the paths
before and after in page order and of the path above) and weighed with the evidence of the tags: nothing for what is never shown
and for menus, forms and the like, more below article and main.  Paths whose fused score is under a share of the page's standard deviation are no content.
Content nodes are the elements (but not html and body) whose text is mostly on content paths, with all of their text, and
elsewhere the blocks on content paths; so that the headings, lists and short paragraphs of an article stay, and every article of
a page does.

Class names, ids and roles count as evidence where most parts of one are words of `MARKS`, but not on an element that holds most
of what would be content without them.  A header within article or main is the article's own.

Rows: a null page counts as empty and gives an empty text; repeated rows are each treated; an empty table gives no rows; further
columns are ignored; time grows linearly with a page, however deep, long or broken it is: a tag whose quotes never end, ends at
the next >, and from there on quotes are not looked at."""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_slices

#: Tags whose text never shows or is never content.
HIDDEN = frozenset("script style noscript template head title iframe object svg canvas audio video map select datalist".split())
SIDE = frozenset("nav header footer aside form button menu dialog input textarea fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre "
    "blockquote figure figcaption address details summary nav header footer aside form fieldset hr menu dialog center".split()
)
#: Words in class names, ids and roles that mark what is no article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar side header footer masthead cookie cookies consent notice gdpr popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations comment comments reply replies disqus "
    "respond widget pagination pager toolbar search complementary contentinfo hidden".split()
)
#: Those of them that also name parts of articles; there they lower a score less.
SOFT = frozenset("side header footer banner menu share sharing social related recommended recommendations widget search respond hidden subscription toolbar promoted".split())
#: Open tag -> tags that end it by opening.
CLOSES = {"p": BLOCK - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: Elements that an end tag of something else does not close.
KEEPS = frozenset(("article", "main", "body", "td"))
OUTER = frozenset(("html", "body"))
NAME = re.compile(r"[A-Za-z][^\s/>]*")
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
GONE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
PUNCTUATION = re.compile(r"[.,;:!?¡¿。、，！？؛،…]")
END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title")}  # their text holds no tags
#: What is known of an element and all in it: never shown, no content by its tag, by a class name, in an article, in a link.
HID, SIDED, MARKED, IN_ARTICLE, LINKED, SOFTLY = 1, 2, 4, 8, 16, 32
#: What such evidence makes of a path's score.
FACTOR = {SIDED: 0.005, MARKED: 0.005, SOFTLY: 0.25, IN_ARTICLE: 4.0}


def attributes(text: str) -> dict[str, str]:
    """Name -> value of a tag's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def marked(has: dict[str, str]) -> int:
    """MARKED where half the parts of one class name, id or role are words of MARKS, SOFTLY where these are some of SOFT beside a word
    of their own, else 0; what an element only has or goes with says nothing."""
    out = 0
    for x in ("class", "id", "role"):
        for name in has.get(x, "").lower().split():
            parts = [w for w in re.split(r"[^a-z0-9]+", name) if w]
            hits = [w for w in parts if w in MARKS]
            if hits and parts[0] not in ("has", "with", "no", "without") and 2 * len(hits) >= len(parts):
                if len(hits) == len(parts) or not all(w in SOFT for w in hits):
                    return MARKED
                out = SOFTLY
    return out


class Page:
    """Elements as parallel lists (parent, tag, state bits, path of the nearest block, whether a class name marks it), and runs
    (text, element, block)."""

    def __init__(self, page: str):
        self.parent, self.tag, self.state, self.path, self.named = [-1], [""], [0], [0], [0]
        self.runs: list[tuple[str, int, int]] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.above = [0]  # path -> the path above
        self.parse(page)

    def parse(self, page: str) -> None:
        open_ = [0]  # elements from the root
        depths: dict[str, list[int]] = {}  # tag -> where it stands in open_
        blocks, keeps = [], []  # where blocks and KEEPS stand
        block, at, n, quotes = 0, 0, len(page), True

        def close(to: int) -> None:
            while len(open_) > to:
                tag = self.tag[open_.pop()]
                depths[tag].pop()
                if tag in BLOCK:
                    blocks.pop()
                if tag in KEEPS:
                    keeps.pop()

        def text(end: int) -> None:
            if end > at:
                self.runs.append((page[at:end], open_[-1], block))

        start = 0
        while True:
            start = page.find("<", start)
            if start < 0:
                break
            after = page[start + 1 : start + 2]
            ending = after == "/"
            m = NAME.match(page, start + 1 + ending)
            if not m and after not in ("!", "?"):
                start += 1  # a sign, no tag
                continue
            if not m:
                comment = page.startswith("<!--", start)
                end = page.find("-->" if comment else ">", start + 2)
                text(start)
                at = start = n if end < 0 else end + (3 if comment else 1)
                continue
            q = QUOTED.match(page, m.end()) if quotes else None
            if not q:
                quotes = False
                end = page.find(">", m.end())
                if end < 0:
                    break  # no more tags
            else:
                end = q.end() - 1
            text(start)
            inside, tag = page[m.end() : end], m[0].lower()
            at = start = end + 1
            if tag in BLOCK:
                block += 1
            if ending:
                if (where := depths.get(tag)) and (not keeps or keeps[-1] <= where[-1] or tag in OUTER or tag in ("article", "main", "table")):
                    close(where[-1])
                continue
            if tag in VOID:
                if tag == "br":
                    self.runs.append((" ", open_[-1], block))
                continue
            if blocks and tag in CLOSES.get(self.tag[open_[blocks[-1]]], ()):
                close(blocks[-1])
            self.add(tag, open_[-1], attributes(inside))
            if tag in END:
                e = END[tag].search(page, at)
                start = e.start() if e else n
            depths.setdefault(tag, []).append(len(open_))
            if tag in BLOCK:
                blocks.append(len(open_))
            if tag in KEEPS:
                keeps.append(len(open_))
            open_.append(len(self.tag) - 1)
        text(n)

    def add(self, tag: str, up: int, has: dict[str, str]) -> None:
        state = self.state[up]
        if tag in ("article", "main"):
            state |= IN_ARTICLE
        if tag in HIDDEN:
            state |= HID
        if tag in SIDE and not (tag == "header" and state & IN_ARTICLE):
            state |= SIDED
        if tag == "a":
            state |= LINKED
        path = self.path[up]
        if has and tag not in OUTER:
            if has.get("hidden", "false").lower() != "false" or has.get("aria-hidden", "").strip().lower() == "true" or GONE.search(has.get("style", "")):
                state |= HID
        if tag in BLOCK:
            key = path, f"{tag}.{has['class']}" if has.get("class") else f"{tag}#{has['id']}" if has.get("id") else tag
            if key not in self.paths:
                self.paths[key] = len(self.above)
                self.above.append(path)
            path = self.paths[key]
        named = marked(has) if has and tag not in OUTER and tag not in ("article", "main") else 0
        for column, value in ((self.parent, up), (self.tag, tag), (self.state, state), (self.path, path), (self.named, named)):
            column.append(value)

    def content_paths(self, share: float, out: int) -> set[int]:
        """The paths whose fused score passes; `out`: the state bits that take text out."""
        stats: dict[int, list[float]] = {}
        for text, e, _ in self.runs:
            if not self.state[e] & out and (t := text.strip()):
                s = stats.setdefault(self.path[e], [0, 0, 0, 0, 0])
                s[0] += len(t)
                s[1] += len(PUNCTUATION.findall(t))
                s[2] += 1
                s[3] += len(t) if self.state[e] & LINKED else 0
                s[4] |= self.state[e]
        if not stats:
            return set()
        raw = {p: chars / runs * (0.5 + marks / runs) * (1 - 0.9 * links / chars) for p, (chars, marks, runs, links, _) in stats.items()}
        total: dict[int, list[float]] = {}  # of what is right below a path, and of its own
        for p, s in stats.items():
            for g in {p, self.above[p]}:
                t = total.setdefault(g, [0.0, 0.0])
                t[0] += raw[p] * s[0]
                t[1] += s[0]
        order = list(stats)
        near = dict(zip(order, ([raw[p] for p in order[max(0, i - 1) : i + 2]] for i in range(len(order))), strict=True))
        fused = {}
        for p, s in stats.items():
            up = total[self.above[p]]
            smooth = sum(near[p]) / len(near[p]) / 2 + up[0] / up[1] / 2
            fused[p] = math.sqrt(raw[p] * smooth) * math.log1p(s[0]) * math.prod(f for bit, f in FACTOR.items() if s[4] & bit)
        mean = sum(fused.values()) / len(fused)
        limit = share * math.sqrt(sum((v - mean) ** 2 for v in fused.values()) / len(fused))
        return {p for p, v in fused.items() if v >= limit}

    def spread(self, good: set[int], out: int) -> tuple[list[int], list[int]]:
        """Characters of content, and of all that is not out, in each element."""
        held, all_ = [0] * len(self.tag), [0] * len(self.tag)
        for text, e, _ in self.runs:
            if not self.state[e] & out and (size := len(text.strip())):
                all_[e] += size
                held[e] += size if self.path[e] in good else 0
        for e in range(len(self.tag) - 1, 0, -1):  # children come after their parents
            all_[self.parent[e]] += all_[e]
            held[self.parent[e]] += held[e]
        return held, all_

    def mark(self, share: float) -> None:
        """Marks what class names mark.  Where all the sentences of the articles (of the page, if it has none) stand in such
        elements, those that hold most of what would be content without marks are spared."""
        if not any(self.named):
            return
        under = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            under[e] = under[self.parent[e]] or self.named[e]
        rest = any(
            self.state[e] & IN_ARTICLE and not self.state[e] & (HID | SIDED) and not under[e] and (len(t.strip()) >= 80 or PUNCTUATION.search(t))
            for t, e, _ in self.runs
        )
        held, _ = self.spread(self.content_paths(share, HID | SIDED), HID | SIDED)
        for e in range(1, len(self.tag)):
            self.state[e] |= self.state[self.parent[e]] & (MARKED | SOFTLY)
            if self.named[e] and (rest or 2 * held[e] <= held[0]):
                self.state[e] |= self.named[e]


def main_text(page: str | None, share: float = 0.2) -> str:
    """The article's blocks, joined by line ends; empty if there is none."""
    p = Page(page or "")
    p.mark(share)
    good = p.content_paths(share, HID)
    held, all_ = p.spread(good, HID)
    whole = [False] * len(p.tag)
    for e in range(1, len(p.tag)):
        own = p.tag[e] not in OUTER and held[e] > 0 and 2 * held[e] >= all_[e]
        # What evidence speaks against is no part of the content around it unless its own paths pass.
        against = p.state[e] & ~p.state[p.parent[e]] & (SIDED | MARKED | SOFTLY)
        whole[e] = own or whole[p.parent[e]] and not against
    blocks: dict[int, list[str]] = {}
    for text, e, block in p.runs:
        if not p.state[e] & HID and (whole[e] or p.path[e] in good):
            blocks.setdefault(block, []).append(text)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


def extract_text(pages: DataFrame, share: float = 0.2) -> DataFrame:
    """One row per page: page_id, url, text and n_chars."""

    def run(b):
        texts = [main_text(p, share) for p in b.column("html").to_pylist()]
        return {"page_id": b.column("page_id"), "url": b.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_slices(pages.select("page_id", F.col("url").cast("string"), "html"), run, f"page_id {kind}, url string, text string, n_chars long")
