"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one a block element, each with the length of its
own text (link text does not count). Elements that are never article text are
dropped first: by tag, or by a name in their class, id or role that consists of
such words alone. An element so named is a wrapper, and stays, if it holds the
main element, most of the articles' text, or the page's only h1 with its text;
or, on a page that has no text elsewhere, if it holds most. Comments, replies,
consent, adverts and the like are wrappers only of a main element.

Lengths are summed over sliding windows of WINDOW lines; text starts where the
sum surges to THRESHOLD and ends where it dives to nothing; lines between the
two are kept, but for short ones behind the last full window. A page that names
its text, by main or article elements of some length, has lines beside it: they
weigh nothing; lines inside count BONUS more, which is less than a surge.
Several articles without a main element that hold less than half of the text
are teasers and name nothing. Where no element names the text, the densest
container does: from the body down, to the part that holds most of the text, as
long as what stands beside it has no window of BESIDE_SURGE. Where nothing
surges, as in a text of a few words, the named lines stay, or a page's few lines.

Defined cases: null, empty or text-free html gives an empty text; unclosed
elements end at the article or the end; character references are decoded once;
white space inside a block becomes one blank; equal lines stay; very long pages
are one pass; ties cannot arise; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posekit.llm.common import arrow_slices, hold, small_batches

WINDOW = 3
THRESHOLD = 40
#: Characters that a line of the named text counts more.
BONUS = 20
#: A window sum that no single notice or advert reaches; also the least text of an article that names itself.
BESIDE_SURGE = 3 * THRESHOLD
#: Nested wrappers and containers that are looked into.
DEEPEST = 12
#: Elements that hold text together.
CONTAINERS = {"div", "section", "td", "center", "body"}

# Element names of HTML.
RAW = "script style noscript template svg math iframe object canvas textarea select".split()
DROPPED = {*RAW, *"head title nav footer aside form button label dialog menu audio video".split()}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Words of class, id or role that mark what is not article text.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|disqus|replies|respond|cookies?|consent|gdpr|notice|notification|alert|disclaimer|copyright|footer|masthead|menu|nav|navbar|navigation|newsletter|pager|pagination|popup|modal|overlay|promo\w*|related|recommend\w*|share|sharing|sidebar|sidenav|site-header|page-header|social|sponsor\w*|subscribe|subscription|tags|toolbar|widget|contentinfo|complementary|search|login|signup)(?:$|[\s_-])",
    re.I,
)
#: Of these words, those that no wrapper of a page's text is named by.
NEVER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|comments?|commentlist|disqus|replies|respond|cookies?|consent|gdpr|notice|notification|alert|disclaimer|copyright|newsletter|promo\w*|related|recommend\w*|sponsor\w*|subscribe|subscription|login|signup)(?:$|[\s_-])", re.I)
#: Names that tell of a part elsewhere on the page.
TELLS = re.compile(r"(?:no|has|with|without)[_-]", re.I)
#: Words that stand beside marking ones in the name of a part, as in sidebar-left or related-posts.
BESIDE = re.compile(
    r"(?:[\s_-]|^)(?:area|bar|block|bottom|box|buttons?|card|center|column|container|content|cookie|first|form|group|holder|icons?|inner|items?|left|links?|list|media|modules?|news|outer|panel|posts?|primary|right|secondary|section|site|slot|stories|strip|text|thread|title|top|unit|wrap|wrapper|zone|\d+)(?=$|[\s_-])",
    re.I,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kind is text, open or close; raw elements are left out whole."""
    at, never = 0, set()  # ends that do not come any more, so that none is looked for twice
    last = html.rfind(">")
    while at <= last and (m := TAG.search(html, at)):
        if m.start() > at:
            yield "text", html[at : m.start()], ""
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if html.startswith("<![CDATA[", m.start()) and "]]>" not in never:
                end = html.find("]]>", m.start())
                at = end + 3 if end >= 0 else at
                never |= set() if end >= 0 else {"]]>"}  # then it is a comment up to its first >
            continue
        if m[1] or m[4]:
            yield "close", name, ""
        elif name in RAW_END and not (m[3] or m[6] or "").endswith("/"):
            end = None if name in never else RAW_END[name].search(html, at)
            at = end.end() if end else at
            never |= set() if end else {name}
        else:
            yield "open", name, m[3] or m[6] or ""
    if at < len(html):
        yield "text", html[at:], ""


def ends(seq: list[tuple[str, str, str]]) -> dict[int, int]:
    """By the number of an opening token, that behind its closing one; unclosed elements are not there."""
    stacks: dict[str, list[int]] = {}
    out = {}
    for k, (kind, name, attributes) in enumerate(seq):
        if kind == "open" and name not in VOID and not attributes.endswith("/"):
            stacks.setdefault(name, []).append(k)
        elif kind == "close" and stacks.get(name):
            out[stacks[name].pop()] = k + 1
    return out


def next_bodies(seq: list[tuple[str, str, str]]) -> tuple[list[int], list[int]]:
    """By token: the next opening article, main or body from here on (else the end), and the next opening main."""
    body, main = [len(seq)], [len(seq)]
    for k in range(len(seq) - 1, -1, -1):
        opens = seq[k][0] == "open"
        body.append(k if opens and seq[k][1] in ("article", "main", "body") else body[-1])
        main.append(k if opens and seq[k][1] == "main" else main[-1])
    return body[::-1], main[::-1]


def unwanted(name: str, attributes: str) -> bool:
    if name in DROPPED:
        return True
    if name in ("html", "body", "article", "main") or "=" not in attributes:
        return False
    return marking(attributes)


def marking(attributes: str) -> bool:
    """A name in class, id or role consists of marking words, and words beside them."""
    return any(marks(name) for a, b, c in ATTRIBUTE.findall(attributes) for name in (a or b or c).split())


@lru_cache(maxsize=10_000)
def marks(name: str) -> bool:
    if not MARKS.search(name) or TELLS.match(name):
        return False
    rest, last = name, None
    while rest != last:  # a separator serves the words on both of its sides
        last, rest = rest, BESIDE.sub("-", MARKS.sub("-", rest))
    return not rest.strip("_-")


def held_text(seq: list[tuple[str, str, str]]) -> tuple[list[int], list[int]]:
    """Characters outside links before each token: of all, and of articles that no name marks."""
    every, inside = [0], [0]
    link = depth = 0
    for kind, name, attributes in seq:
        n = 0
        if kind == "text":
            n = 0 if link else len(" ".join(name.split()))
        elif name == "a":
            link = kind == "open"
        elif name == "article":
            if kind == "close":
                depth = max(0, depth - 1)
            elif depth or not marking(attributes):
                depth += 1
        every.append(every[-1] + n)
        inside.append(inside[-1] + (n if depth else 0))
    return every, inside


def survey(seq: list[tuple[str, str, str]], closed: dict[int, int], a: int, b: int) -> tuple[int, int, bool]:
    """Of tokens a to b: characters outside links and unwanted elements, the opening token of the marked element with most text, and whether a heading or body element stands outside."""
    plain = best = link = 0
    at, largest, named = a, -1, False
    inside, until, n = -1, -1, 0
    while at < b:
        kind, name, attributes = seq[at]
        if inside >= 0 and at >= until:
            if n > best:
                best, largest = n, inside
            inside = -1
        if kind == "text":
            size = 0 if link else len(" ".join(name.split()))
            plain, n = (plain, n + size) if inside >= 0 else (plain + size, n)
        elif name == "a":
            link = kind == "open"
        elif kind == "open" and inside < 0:
            marked = at in closed and unwanted(name, attributes)
            if marked and (name in DROPPED or never_wraps(attributes)):
                at = closed[at]
                continue
            if marked:
                inside, until, n = at, closed[at], 0
            elif name in ("article", "main", "h1"):
                named = True
        at += 1
    if inside >= 0 and n > best:
        largest = inside
    return plain, largest, named


def lines(html: str) -> list[tuple[str, int, int]]:
    """(text, length without links, which article: 0 for none, -1 for main) of every block line; without such elements, 1 is the densest container."""
    seq = list(tokens(html))
    closed, (body, main_at) = ends(seq), next_bodies(seq)
    headings = [0]
    for kind, name, _ in seq:
        headings.append(headings[-1] + (kind == "open" and name == "h1"))
    held: tuple[list[int], list[int]] | None = None
    around: tuple[int, int, bool] | None = None
    span, deep = (0, len(seq)), 0
    out: list[tuple[str, int, int]] = []
    where: list[int] = []  # the container of each line
    parent, stack = [0], [(0, "")]
    text: list[str] = []
    linked = article = link = at = which = n_articles = 0

    def end_line() -> None:
        nonlocal linked
        line = " ".join(unescape("".join(text)).split())
        if line:
            out.append((line, max(0, len(line) - linked), which if article else 0))
            where.append(stack[-1][0])
        text.clear()
        linked = 0

    while at < len(seq):
        kind, name, attributes = seq[at]
        at += 1
        if kind == "text":
            text.append(name)
            linked += len(name) if link else 0
            continue
        if kind == "open" and name not in VOID and not attributes.endswith("/") and unwanted(name, attributes):
            k = closed.get(at - 1, len(seq))
            depth, stop, main = at - 1 not in closed, body[at] if body[at] < k else None, main_at[at] < k
            wrapper = False
            if name not in DROPPED and (not depth or stop is None):
                held = held or held_text(seq)
                (n, _), (n_articles_in, in_articles) = [(h[k] - h[at], h[-1]) for h in held]
                wrapper = main or stop is not None and 2 * n_articles_in > in_articles
                if not wrapper and n >= THRESHOLD and not never_wraps(attributes):
                    if deep < DEEPEST:
                        around = around or survey(seq, closed, *span)
                        plain, largest, named = around
                        alone = largest == at - 1 and plain < THRESHOLD
                        titled = headings[k] - headings[at] == headings[-1] > 0 and not in_articles
                        wrapper = alone if article else not named and (alone or titled)
                        if wrapper:  # what stands inside is looked at anew
                            span, around, deep = (at, k), None, deep + 1
            if not wrapper:
                end_line()
                at = k if not depth else (stop if stop is not None else len(seq))
                continue
        if name in BLOCKS:
            end_line()
        elif name in ("br", "td", "th"):
            text.append(" ")
        if name in CONTAINERS:
            if kind == "open":
                parent.append(stack[-1][0])
                stack.append((len(parent) - 1, name))
            elif len(stack) > 1 and stack[-1][1] == name:
                stack.pop()
        if name in ("article", "main"):
            if not article and kind == "open":
                span, around, deep = (at, closed.get(at - 1, len(seq))), None, 0
            elif article == 1 and kind == "close":
                span, around, deep = (0, len(seq)), None, 0
            if kind == "open" and name == "main":
                which = -1
            elif kind == "open" and not article:
                which = n_articles = n_articles + 1
            article = max(0, article + (1 if kind == "open" else -1))
        elif name == "a":
            link = 1 if kind == "open" else 0
        elif name == "header" and kind == "open" and not article:
            at = closed.get(at - 1, at)
    end_line()
    if named_text(out):
        return out
    densest = densest_container(out, where, parent)
    return [(line, n, int(k in densest)) for (line, n, _), k in zip(out, where, strict=True)]


def never_wraps(attributes: str) -> bool:
    return any(NEVER.search(name) for a, b, c in ATTRIBUTE.findall(attributes) for name in (a or b or c).split())


def named_text(found: list[tuple[str, int, int]]) -> bool:
    """Whether main or article elements name the page's text."""
    kinds = {inside for _, _, inside in found if inside}
    own, every = sum(n for _, n, inside in found if inside), sum(n for _, n, _ in found)
    return bool(kinds) and (2 * own >= every or own >= BESIDE_SURGE and (len(kinds) == 1 or -1 in kinds))


def densest_container(found: list[tuple[str, int, int]], where: list[int], parent: list[int]) -> set[int]:
    """The containers in and under the deepest one that holds the text, if what stands beside it nowhere surges; none if that is the page itself."""
    total = [0] * len(parent)
    for (_, n, _), k in zip(found, where, strict=True):
        total[k] += n
    for k in range(len(parent) - 1, 0, -1):
        total[parent[k]] += total[k]
    children: dict[int, list[int]] = {}
    for k in range(1, len(parent)):
        children.setdefault(parent[k], []).append(k)
    node, last = 0, len(parent)  # containers are numbered as they open: those under a node are node to last - 1
    for _ in range(DEEPEST):
        inner = max(children.get(node, []), key=lambda k: total[k], default=None)
        if inner is None or 2 * total[inner] <= total[node]:
            break
        after = [k for k in children[node] if k > inner]
        end = after[0] if after else last
        beside = [0 if inner <= k < end else n for (_, n, _), k in zip(found, where, strict=True) if node <= k < last]
        if any(sum(beside[j : j + WINDOW]) >= BESIDE_SURGE for j in range(len(beside))):
            break
        node, last = inner, end
    return set(range(node, last)) if node else set()


def weights(found: list[tuple[str, int, int]]) -> list[int]:
    """What each line counts in the window sums."""
    marked = any(inside for _, _, inside in found) and named_text(found)
    return [n if not marked else n + BONUS if inside else 0 for _, n, inside in found]


def main_lines(found: list[tuple[str, int, int]]) -> list[str]:
    """Lines between surges and dives of the window sums, without the ends that carry no window."""
    weight = weights(found)
    sums = [sum(weight[k : k + WINDOW]) for k in range(len(weight))]
    before = [sum(weight[max(0, k - WINDOW + 1) : k + 1]) for k in range(len(weight))]
    out, k = [], 0
    named = any(inside for _, _, inside in found) and named_text(found)
    while k < len(sums):
        if sums[k] < THRESHOLD:
            k += 1
            continue
        dive = k
        while dive < len(sums) and sums[dive]:
            dive += 1
        own = [j for j in range(k, dive) if weight[j]]
        last = max(j for j in own if before[j] >= THRESHOLD)
        out += [found[j][0] for j in range(own[0], last + 1) if weight[j] or not named]
        k = dive
    few = [j for j, w in enumerate(weight) if w]
    return out or ([found[j][0] for j in few] if named or len(few) <= WINDOW else [])


def main_text(html: str | None) -> str:
    return "\n\n".join(main_lines(lines(html))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.col("html").alias("html"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("pages")
        for batch in arrow_slices(batches, "html"):
            got = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
