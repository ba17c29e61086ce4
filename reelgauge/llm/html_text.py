"""Main text of web pages by tag-path ratios.

Every block of text hangs on a root-to-leaf path of block tags.  Text length and
punctuation are aggregated per path, the ratios smoothed along the page, fused and
thresholded; blocks on the chosen paths, and their neighbours in the same container,
are the article.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html import unescape
from itertools import pairwise

from pyspark.sql import DataFrame

from reelgauge.llm.common import map_rows

# Tags by their role in a page, as the HTML standard defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg canvas object title xmp noframes noembed".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
NEVER = frozenset("head nav footer aside form button select option datalist dialog menu search map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An opening tag ends these open ones, up to the given container.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
# Words of a class or id that mark what is not the article ...
CLUTTER = frozenset(
    "ad ads adv advert adverts advertisement advertisements sponsor sponsored promo banner sidebar menu nav navbar breadcrumb breadcrumbs "
    "cookie cookies popup comment comments commentlist disqus footer masthead topbar newsletter widget widgets toolbar pagination pager".split()
)
# ... those that also name a part of an article, which count only beside another word ...
AMBIGUOUS = frozenset(
    "advertising promotion aside navigation consent gdpr notice notices modal overlay alert respond reply replies discussion share sharing "
    "social related recommended subscribe signup login search contentinfo complementary dialog".split()
)
# ... and the words beside them that change nothing.  Any other word leaves it to the ratios.
FURNITURE = frozenset(
    "area bar block bottom box button buttons container footer form global header holder icons inner item items left link links list "
    "outer panel post posts primary right section secondary site slot sticky sub top unit wrap wrapper".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؛،]")

#: Share of the standard deviation of the fused ratio that a content path must reach.
THRESHOLD = 1.0
#: Weights of a block and its neighbours in smoothing, by distance.
SMOOTHING = (1.0, 0.6, 0.25)


class _Open:
    """An open element: its tag, the number of its path, and whether it lies outside the article.

    ``out`` is final; ``mark`` is that of the innermost element, itself or around it, that
    is out by its words alone: a list of whether it still is, and of the mark around it.
    """

    __slots__ = ("article", "mark", "nested", "out", "path", "tag")

    def __init__(self, tag: str, path: int, out: bool, article: int, mark: list | None, nested: bool):
        self.tag, self.path, self.out, self.article, self.mark, self.nested = tag, path, out, article, mark, nested


def _attributes(attrs: str) -> dict[str, str]:
    """Name and value pairs, both in lower case; of a repeated name the first counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attrs):
        found.setdefault(name.lower(), "".join(values).lower())
    return found


def _hidden(tag: str, attrs: dict[str, str], parent: _Open) -> bool:
    """Never part of an article, whatever it holds."""
    return (
        (tag in NEVER and tag != "form")
        or (tag == "header" and not parent.article)
        or "hidden" in attrs
        or attrs.get("aria-hidden") == "true"
        or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")) is not None
    )


def _clutter(tag: str, attrs: dict[str, str]) -> bool:
    """Whether a form, the role or a whole name in class or id tells that it is not the article."""
    if tag in ("html", "body", "main"):
        return False
    if tag == "form" or not ROLES.isdisjoint(attrs.get("role", "").split()):
        return True
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = _WORD.findall(name)
        sure, other = not CLUTTER.isdisjoint(words), not AMBIGUOUS.isdisjoint(words) and len(words) > 1
        if (sure or other) and all(w in CLUTTER or w in AMBIGUOUS or w in FURNITURE for w in words):
            return True
    return False


def blocks(html: str) -> tuple[list[dict], list[int]]:
    """Blocks of text in page order, each with its path, link share and place; the path above each path.

    Paths are numbers, 0 that of the page; a path is above those with higher numbers only.
    ``out`` blocks are never the article; ``soft`` ones are out by words.  An element that
    holds ``main`` is not soft, nor one that holds an article while all articles are in such.
    """
    stack = [_Open("", 0, False, 0, None, False)]
    paths: dict[tuple[int, str], int] = {}
    above = [0]
    # how many elements of a tag are open, so that nothing is looked for in vain
    opened: dict[str, int] = defaultdict(int)
    found: list[dict] = []
    made: list[list] = []
    holders: dict[str, list] = {"main": [], "article": []}
    parts: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        if text:
            top = stack[-1]
            found.append(
                {
                    "text": text, "tag": top.tag, "path": top.path, "out": top.out, "soft": top.mark, "article": top.article,
                    "parent": stack[-2].path if len(stack) > 1 else 0, "links": min(linked, len(text)),
                }
            )
        parts.clear()
        linked = 0

    def close(depth: int) -> None:
        for e in stack[depth:]:
            opened[e.tag] -= 1
        del stack[depth:]

    at = 0
    while True:
        token = _TOKEN.search(html, at)
        piece = html[at : token.start() if token else len(html)]
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece)
        if not token:
            break
        at = token.end()
        if not token["tag"]:
            continue
        tag, closing = token["tag"].lower(), bool(token["close"])
        if tag in RAW:
            if not closing and not token["attrs"].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                parts.append(" " if tag == "br" else "")
            continue
        if tag not in BLOCKS and tag not in NEVER:
            continue
        flush()
        if closing:
            if opened[tag]:
                close(next(d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == tag))
            continue
        ends, until = IMPLIED.get(tag, (set(), set()))
        depth = len(stack) - 1
        while depth and any(opened[t] for t in (*ends, "p")):
            if stack[depth].tag in ends or (stack[depth].tag == "p" and tag in BLOCKS):
                close(depth)
            elif stack[depth].tag in until or not ends:
                break
            depth -= 1
        links = 0
        parent = stack[-1]
        path = paths.setdefault((parent.path, tag), len(above))
        if path == len(above):
            above.append(parent.path)
        attrs = _attributes(token["attrs"])
        out, mark = parent.out or _hidden(tag, attrs, parent), parent.mark
        article = parent.article or (path if tag in ("article", "main") else 0)
        kind = tag if tag in holders else attrs.get("role", "")
        # an article of its own is not judged by its words; one among comments or in another one is
        if kind != "main" and (kind != "article" or parent.nested or mark) and _clutter(tag, attrs):
            mark = [True, mark]
            made.append(mark)
        elif kind in holders and not out and not (kind == "article" and parent.nested):
            holders[kind].append(mark)
        stack.append(_Open(tag, path, out, article, mark, parent.nested or tag == "article"))
        opened[tag] += 1
    flush()
    for kind, marks in holders.items():
        if kind == "main" or all(m and m[0] for m in marks):
            for mark in marks:
                while mark and mark[0]:
                    mark[0], mark = False, mark[1]
    # from the outside in; what is around a mark was made before it
    for mark in made:
        mark[0] = mark[0] or bool(mark[1] and mark[1][0])
    return [b | {"soft": bool(b["soft"] and b["soft"][0])} for b in found], above


def _smoothed(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        weight = total = 0.0
        for distance, w in enumerate(SMOOTHING):
            for j in {i - distance, i + distance}:
                if 0 <= j < len(values):
                    total += w * values[j]
                    weight += w
        out.append(total / weight)
    return out


def content(found: list[dict], above: list[int], threshold: float = THRESHOLD) -> list[dict]:
    """The blocks of the article, chosen by their paths; ``above`` has the path above each path."""
    kept = [b for b in found if not b["out"] and not b["soft"]]
    if all(b["links"] == len(b["text"]) for b in kept):
        # nothing else is left: words alone do not empty a page
        kept = [b for b in found if not b["out"]]
    if not kept:
        return []
    length, marks, count = defaultdict(float), defaultdict(float), defaultdict(int)
    for b in kept:
        length[b["path"]] += len(b["text"]) - b["links"]
        marks[b["path"]] += len(_PUNCTUATION.findall(b["text"])) * (1 - b["links"] / len(b["text"]))
        count[b["path"]] += 1
    by_length = _smoothed([length[b["path"]] / count[b["path"]] for b in kept])
    by_marks = _smoothed([marks[b["path"]] / count[b["path"]] for b in kept])
    fused = [math.sqrt(a * (1 + m)) for a, m in zip(by_length, by_marks, strict=True)]
    mean = sum(fused) / len(fused)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    path_score: dict[int, float] = defaultdict(float)
    for b, x in zip(kept, fused, strict=True):
        path_score[b["path"]] = max(path_score[b["path"]], x)
    limit = min(threshold * deviation, max(path_score.values()))
    chosen = {p for p, x in path_score.items() if x >= limit and length[p] > 0}
    if not chosen:
        return []
    # the containers of the chosen paths' blocks, and all that lies in them
    containers = {b["article"] or b["parent"] for b in kept if b["path"] in chosen and b["links"] < len(b["text"])}
    within = [False] * len(above)
    for path, parent in enumerate(above):
        within[path] = path in containers or within[parent]
    inside = [within[b["path"]] for b in kept]
    # a heading right before the article belongs to it
    for before, after in pairwise(range(len(kept))):
        if inside[after] and not inside[before] and kept[before]["tag"] in HEADINGS:
            inside[before] = True
    return [
        b
        for b, yes in zip(kept, inside, strict=True)
        if yes and (b["path"] in chosen or b["links"] < 0.6 * len(b["text"]))
    ]


def main_text(html: str | None) -> str:
    """The article's blocks, joined by an empty line; null and pages without text give ''."""
    return "\n\n".join(b["text"] for b in content(*blocks(html))) if html else ""


def extract_pages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text, n_chars (code points) of every page; rows stay where they are.

    Null and empty pages give an empty text, repeated rows are repeated, and other
    columns are ignored.  Pages cut off inside a tag or reference are read as far as they go.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def make():
        def run(batch):
            texts = [main_text(h) for h in batch.column(len(keep)).to_pylist()]
            out = {k: batch.column(i) for i, k in enumerate(keep)}
            return out | {"text": texts, "n_chars": [len(t) for t in texts]}

        return run

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep)
    return map_rows(pages.select(*keep, html), f"{schema}, text string, n_chars bigint", make)
