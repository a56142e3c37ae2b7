"""Main text of web pages by tag-path ratios.

The text of a page is gathered per root-to-leaf tag path: how many characters and how many
punctuation marks it has per text node, and how much of it is link text.  Both ratios are
smoothed over paths that share a prefix, fused into one score, raised within ``article`` and
``main`` elements, and paths above the page's threshold are content.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotspark.llm.texts import small_batches

# Fixed values of HTML: elements without content, raw text, blocks, and what ends an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "template", "noscript", "svg", "iframe", "xmp", "noembed", "noframes")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p "
    "pre section select summary table tbody td tfoot th thead title tr ul".split()
)
ENDS_P = BLOCKS - {"body", "head", "html", "td", "th", "tr", "caption", "tbody", "thead", "tfoot", "option", "optgroup"}
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "body": {"head", "title"},
}
SCOPES = frozenset("html body table ul ol dl td th select article section div main aside nav".split())

#: Elements and class words of page parts that are not the article.
APART = frozenset("nav header footer aside form menu button select option head title dialog label fieldset".split())
APART_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|side-?bars?|nav\w*|menus?|bread-?crumbs?|"
    r"head(?:er)?s?|foot(?:er)?s?|cookies?|consent|notices?|alerts?|popups?|modals?|overlay|comments?|respond|"
    r"replies|disqus|share|sharing|social|subscri\w*|newsletter|sign-?up|login|search|related|recommend\w*|"
    r"widgets?|toolbar|pager|pagination|legal|copyright|skip|hidden)(?=$|[\s_-])",
    re.IGNORECASE,
)
APART_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
ARTICLE = frozenset(("article", "main"))
MARKS = "!~?"

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b", re.IGNORECASE)
DIGITS = re.compile(r"\d+")
SPACE = re.compile(r"\s+")
POINTS = re.compile(r"[.,;:!?。，；：！？…]")
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)|\Z", re.IGNORECASE) for tag in RAW}


def text_nodes(page: str) -> tuple[list[tuple[int, int, str]], list[tuple[str, ...]]]:
    """(block number, path number, text) of every text node, and the tag paths.

    A path step is the element's name, after ``!`` where the element stands apart from
    articles by name or role; ``~`` by a whole class or id, ``?`` by a part of one, the words following.
    """
    stack: list[str] = []
    names: list[str] = []
    nodes: list[tuple[int, int, str]] = []
    numbers: dict[tuple[str, ...], int] = {}
    block, at, path = 0, 0, -1
    end = len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            if path < 0:
                path = numbers.setdefault(tuple(stack), len(numbers))
            nodes.append((block, path, text))
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, rest = tag.lower(), m["rest"] or m["rest2"] or ""
        if m["close"] or m["close2"]:
            if tag in BLOCKS or tag == "br":
                block += 1
            if tag in names:
                while names.pop() != tag:
                    pass
                del stack[len(names) :]
                path = -1
            continue
        if tag == "br":
            block += 1
        if tag in VOID:
            block += tag == "hr"
            continue
        if tag in RAW:
            if not rest.endswith("/") or tag not in ("svg",):
                at = RAW_END[tag].search(page, at).end()
            continue
        if tag in BLOCKS:
            block += 1
            path = -1
            if tag in ENDS_P and stack and "p" in names[-8:]:
                for i in range(len(stack) - 1, -1, -1):
                    name = names[i]
                    if name == "p":
                        del stack[i:], names[i:]
                        break
                    if name in SCOPES:
                        break
            closes = SIBLINGS.get(tag)
            if closes:
                for i in range(len(stack) - 1, -1, -1):
                    name = names[i]
                    if name in closes:
                        del stack[i:], names[i:]
                        break
                    if name in SCOPES:
                        break
        mark, said = "!" if tag in APART else "", ""
        if rest and not mark and tag not in ("html", "body"):
            for a in ATTRIBUTE.finditer(rest):
                name, value = (a[1] or a[5]).lower(), a[2] or a[3] or a[4] or ""
                if name == "hidden" or (name == "role" and value.lower() in APART_ROLES):
                    mark = "!"
                elif name != "role" and mark != "!" and tag not in ARTICLE and APART_WORDS.search(value):
                    whole = any(APART_WORDS.fullmatch(word) for word in value.split())
                    mark = "~" if whole or mark == "~" else "?"
                    said += " " + DIGITS.sub("", value)
        # Elements under different words are different paths.
        stack.append(mark + tag if mark == "!" else mark + tag + said)
        names.append(tag)
        path = -1
    return nodes, list(numbers)


def held_text(live: list[int], paths: list[tuple[str, ...]], chars: list[int]) -> dict[tuple[str, ...], list[int]]:
    """Characters, and those of article elements, below every marked step and (key ``()``) in all."""
    held: dict[tuple[str, ...], list[int]] = {(): [0, 0]}
    for i in live:
        inner = chars[i] * (not ARTICLE.isdisjoint(paths[i]))
        for prefix in [(), *(paths[i][: d + 1] for d, step in enumerate(paths[i]) if step[0] in MARKS)]:
            own = held.setdefault(prefix, [0, 0])
            own[0] += chars[i]
            # Of an article around the element nothing is held by it.
            own[1] += inner * (ARTICLE.isdisjoint(prefix))
    return held


def named_parts(path: tuple[str, ...], held: dict[tuple[str, ...], list[int]]) -> tuple[bool, bool]:
    """Whether the path lies below an element set apart by a whole word, and by a part of one.

    Elements that hold most of the page's text, or of its articles, are what the page is about.
    """
    marks = {
        step[0] for d, step in enumerate(path)
        if step[0] in MARKS and 4 * held[path[: d + 1]][0] < 3 * held[()][0]
        and (not held[()][1] or 2 * held[path[: d + 1]][1] < held[()][1])
    }
    return "~" in marks, "?" in marks


def content_paths(nodes: list[tuple[int, int, str]], paths: list[tuple[str, ...]], spread: float = 0.5) -> set[int]:
    """Numbers of the paths that hold the article."""
    n = len(paths)
    chars, points, count = [0] * n, [0] * n, [0] * n
    for _, path, text in nodes:
        size = len(text) - text.count(" ") - text.count("\n")
        if size:
            chars[path] += size
            points[path] += len(POINTS.findall(text))
            count[path] += 1
    live = [i for i in range(n) if count[i] and not any(step[0] == "!" for step in paths[i])]
    if not live:
        return set()
    named = [named_parts(paths[i], held) for held in [held_text(live, paths, chars)] for i in live]
    # Where whole words leave nothing, the ratios decide alone.
    parted = {i for i, (whole, _) in zip(live, named, strict=True) if whole}
    lowered = {i for i, (_, part) in zip(live, named, strict=True) if part}
    if len(parted) < len(live):
        live = [i for i in live if i not in parted]
    paths = [tuple(step.lstrip(MARKS).split(" ")[0] for step in p) for p in paths]
    total = sum(chars[i] for i in live)
    within = {i for i in live if not ARTICLE.isdisjoint(paths[i])}
    # Ratios per text node, then a mean over paths weighted by the shared part of their steps.
    text_ratio = {i: chars[i] / count[i] for i in live}
    point_ratio = {i: (points[i] + 1) / count[i] for i in live}
    steps = {i: [s for s in paths[i] if s in BLOCKS] for i in live}
    score = {}
    for i in live:
        weight = text = point = 0.0
        for j in live:
            shared = 0
            for a, b in zip(steps[i], steps[j], strict=False):
                if a != b:
                    break
                shared += 1
            near = math.exp(-(max(len(steps[i]), len(steps[j])) - shared) / spread / 2) if i != j else 1.0
            w = near * count[j]
            weight += w
            text += w * text_ratio[j]
            point += w * point_ratio[j]
        score[i] = math.sqrt(text / weight * point / weight)
    # Links lower a path: menus and teasers are anchors almost throughout.
    for i in live:
        parent = steps[i]
        same = [j for j in live if steps[j] == parent]
        linked = sum(chars[j] for j in same if "a" in paths[j])
        score[i] *= 1 - linked / max(1, sum(chars[j] for j in same))
    # An article element raises its paths, the more of the page's text it holds: it may mark mere teasers.
    raised = 1 + 3 * sum(chars[i] for i in within) / total
    for i in within:
        score[i] *= raised
    for i in lowered.intersection(live):
        score[i] /= 8
    mean = sum(score[i] * chars[i] for i in live) / total
    return {i for i in live if score[i] >= mean / 4}


def main_text(page: str) -> str:
    """Blocks of content in page order, one per line; an empty page or one without content gives ''."""
    nodes, paths = text_nodes(page)
    wanted = content_paths(nodes, paths)
    blocks: list[str] = []
    last, held = -1, []

    def close() -> None:
        text = SPACE.sub(" ", html.unescape("".join(held))).strip()
        if text:
            blocks.append(text)

    for block, path, text in nodes:
        if path not in wanted:
            continue
        if block != last:
            close()
            last, held = block, []
        held.append(text)
    close()
    return "\n".join(blocks)


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """The article of every page: ``key, url, text STRING, n_chars BIGINT``.

    The project keeps no web pages of its own, so the operator is general: any table with a
    key, an address and a page will do.  The whole page is read; null counts as empty and
    gives an empty text.  Scripts, styles, menus, headers, footers, sidebars, notices,
    adverts, forms and comments are left out, character references decoded, white space
    within a block made one space, and blocks joined by a line end.  Repeated rows give
    repeated rows; further columns are ignored.
    """
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, {url} string, text string, n_chars bigint"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, page):
            texts = [main_text(p) if p else "" for p in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[key, url, "text", "n_chars"],
            )

    return pages.select(F.col(key), F.col(url).cast("string"), F.col(page).cast("string")).mapInArrow(extract, schema)
