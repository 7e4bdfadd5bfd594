"""HTML into leaf blocks: runs of text between block-level tags, with the features of what they stand in."""

import html
import re
from typing import NamedTuple

START = re.compile(r"<!--|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)|<[!?/]")
EVENT = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

# HTML's own element groups.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noframes xmp".split())
HIDDEN = frozenset("template svg iframe canvas audio video select button datalist noscript".split())
RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE) for tag in RAW}

#: Words in class, id and role values, by what they usually mark.
MARKS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar tabs pagination pager skip",
    "head": "header masthead banner logo topbar branding hero site-header",
    "foot": "footer foot copyright legal colophon contentinfo bottom",
    "side": "sidebar side aside rail related recommended recommendations widget complementary trending popular more teaser",
    "advert": "ad ads advert advertisement adverts adsense adslot banner-ad sponsor sponsored promo promotion promoted",
    "remark": "comment comments commentlist reply replies respond discussion disqus feedback reviews",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay newsletter subscribe signup paywall warning message",
    "share": "share sharing social follow tags tag byline-share tools print",
    "form": "form login search signin register input field",
    "text": "article content post entry story main body text prose markdown post-content entry-content article-body story-body",
}
MARK_OF = {word: mark for mark, words in MARKS.items() for word in words.split()}
REGION = ("article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "table", "figure", "blockquote", "details", "dialog", "fieldset")
OWN = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "div", "section", "article", "blockquote", "pre", "dt", "dd", "figcaption", "body", "nav", "footer", "header", "aside", "label", "legend")
TEXT = ("words:1", "words:4", "words:9", "words:24", "words:more", "ends", "links:none", "links:some", "links:most", "links:all", "rights", "symbol",
        "digits", "capitals", "commas", "first", "last", "bias", "under-region", "no-region")
NAMES = [f"in:{t}" for t in REGION] + [f"mark:{m}" for m in MARKS] + [f"own:{t}" for t in OWN] + list(TEXT)
NUMBER = {name: k for k, name in enumerate(NAMES)}

Features = frozenset


class Block(NamedTuple):
    text: str
    inside: Features  # numbers of the ancestors' features
    own: str
    linked: int  # characters in links


class _Node(NamedTuple):
    tag: str
    features: Features


def node_features(tag: str, attributes: str) -> Features:
    out = {NUMBER[f"in:{tag}"]} if f"in:{tag}" in NUMBER else set()
    for match in ATTRIBUTE.finditer(attributes):
        value = (match[2] or match[3] or match[4] or "").lower()
        for name in value.split():
            for word in (name, *re.split(r"[-_:]+", name)):
                if word in MARK_OF:
                    out.add(NUMBER[f"mark:{MARK_OF[word]}"])
    return frozenset(out)


class Token(NamedTuple):
    start: int
    end: int
    tag: str  # empty for comments and declarations
    closes: bool
    rest: str  # attributes


class Scanner:
    """Tags and comments of a page. A tag ends at the first `>` outside quoted values, or at the first one if a quote stays open."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.open: set[int] = set()  # quotes from which on no tag ends: each is walked once, so the work stays linear

    def next(self, at: int) -> Token | None:
        page = self.page
        match = START.search(page, at) if at <= self.last else None
        if match is None or match.start() > self.last:
            start = page.find("<!--", at)
            return None if start < 0 else Token(start, self._comment_end(start), "", False, "")
        start = match.start()
        if match[0] == "<!--":
            return Token(start, self._comment_end(start), "", False, "")
        if match["tag"] is None:
            return Token(start, page.index(">", match.end()) + 1, "", False, "")
        end = self._tag_end(match.end())
        return Token(start, end + 1, match["tag"].lower(), bool(match["end"]), page[match.end(): end])

    def _comment_end(self, start: int) -> int:
        end = self.page.find("-->", start + 4)
        return len(self.page) if end < 0 else end + 3

    def _tag_end(self, at: int) -> int:
        page, spot, passed = self.page, at, []
        while (event := EVENT.search(page, spot)) is not None:
            here = event.start()
            if page[here] == ">":
                return here
            if here in self.open:
                break
            passed.append(here)
            close = page.find(page[here], here + 1)
            if close < 0:
                break
            spot = close + 1
        self.open.update(passed)
        return page.index(">", at)


def leaf_blocks(page: str, known: dict | None = None) -> list[Block]:
    """Blocks that have text, in page order. `known` keeps node features between pages."""
    known = {} if known is None else known
    blocks: list[Block] = []
    stack = [_Node("", frozenset())]
    parts: list[str] = []
    linked, in_link, hidden, in_head, at = 0, False, 0, False, 0

    def text(piece: str) -> None:
        nonlocal linked
        if hidden or in_head or not piece:
            return
        parts.append(html.unescape(piece) if "&" in piece else piece)
        if in_link:
            linked += len(piece)

    def flush() -> None:
        nonlocal linked
        if parts:
            joined = " ".join("".join(parts).split())
            if joined:
                top = stack[-1]
                blocks.append(Block(joined, top.features, top.tag, min(linked, len(joined))))
            parts.clear()
        linked = 0

    scanner = Scanner(page)
    while True:
        token = scanner.next(at)
        if token is None:
            text(page[at:])
            break
        text(page[at: token.start])
        at, tag, rest = token.end, token.tag, token.rest
        if not tag:
            continue
        if token.closes:
            if tag == "head":
                in_head = False
            elif tag in HIDDEN:
                hidden = max(0, hidden - 1)
            elif tag == "a":
                in_link = False
            elif tag in BLOCK:
                flush()
                depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
                if depth:
                    del stack[depth:]
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = len(page) if end is None else end.start()
        elif tag == "head":
            in_head = True
        elif tag in HIDDEN:
            if not rest.endswith("/"):
                hidden += 1
        elif tag == "a":
            in_link = True
        elif tag in BLOCK:
            in_head = False
            flush()
            if tag == "hr":
                continue
            if stack[-1].tag == "p" or tag == "li" and stack[-1].tag == "li" or tag in ("dt", "dd") and stack[-1].tag in ("dt", "dd"):
                stack.pop()
            if tag == "li" and stack[-1].tag == "li":
                stack.pop()
            node = known.get((tag, rest))
            if node is None:
                node = known[tag, rest] = node_features(tag, rest)
                if len(known) > 50_000:
                    known.clear()
            stack.append(_Node(tag, stack[-1].features | node if node else stack[-1].features))
        elif tag in VOID:
            parts.append(" ")
    flush()
    return blocks


REGION_NUMBERS = frozenset(NUMBER[f"in:{t}"] for t in ("article", "main"))
RIGHTS = re.compile(r"©|\(c\)\s*\d{4}|copyright|all rights reserved", re.IGNORECASE)


def block_features(blocks: list[Block]) -> list[list[int]]:
    """Numbers of the features of each block."""
    some_region = any(b.inside & REGION_NUMBERS for b in blocks)
    out, n = [], len(blocks)
    for k, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        share = b.linked / len(b.text)
        names = ["bias",
                 "words:1" if words < 2 else "words:4" if words < 5 else "words:9" if words < 10 else "words:24" if words < 25 else "words:more",
                 "links:none" if not b.linked else "links:some" if share < 0.3 else "links:most" if share < 0.8 else "links:all"]
        if b.own in _OWN:
            names.append(f"own:{b.own}")
        if b.text[-1] in ".!?…\"”»)":
            names.append("ends")
        if "," in b.text:
            names.append("commas")
        if RIGHTS.search(b.text):
            names.append("rights")
        if "|" in b.text or "·" in b.text or "»" in b.text:
            names.append("symbol")
        if words < 10 and any(c.isdigit() for c in b.text):
            names.append("digits")
        if b.text.isupper():
            names.append("capitals")
        if k == 0:
            names.append("first")
        if k == n - 1:
            names.append("last")
        if some_region:
            names.append("under-region" if b.inside & REGION_NUMBERS else "no-region")
        out.append([*b.inside, *(NUMBER[x] for x in names)])
    return out


_OWN = frozenset(OWN)
