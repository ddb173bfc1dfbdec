"""Main text of pages by wrapper induction.

Each page becomes a small tree: runs of like siblings fold into one node, leaves are the text blocks.
The trees of a host are aligned by simple tree matching and merged into its wrapper, whose nodes count
pages and keep the most frequent texts of their slot (Misra-Gries counters, so wrappers merge in any
order and stay bounded). A text that fills its slot on most pages of the host is template, the
varying slots are content. Parts whose element or class says what they are (menus, adverts, forms,
comments and so on) are never content, and an article or main element, where a page has one,
bounds it.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import OWN, map_arrow
from riskloom.session import pin

COUNTERS = 16  # most frequent texts kept for each slot
LEAST_PAGES = 3  # pages of a host before anything counts as constant
CONSTANT = 0.6  # share of a host's pages from which a text of a slot is template
SALT = 64  # parts in which the wrappers of one host are merged first

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rt rtc rp s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
        "nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}
# Elements and words in class, id or role that mark a part as no content.
ASIDE = frozenset(
    "nav footer aside form script style noscript template iframe object embed svg canvas button select textarea input dialog menu head "
    "title".split()
)
MARKS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|footer|masthead|topbar|sidebar|side|aside|widget|ads?|advert\w*|adbox|"
    r"sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"share|sharing|social|related|recommend\w*|comments?|commentlist|discussion|replies|reply|respond|disqus|pagination|pager|toolbar|"
    r"search|skip|legal|copyright|complementary|contentinfo|hidden)(?:$|[\s_-])", re.I,
)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?", re.I)


DEEPEST = 150  # elements inside each other that have nodes of their own


class Node:
    __slots__ = ("label", "off", "children", "texts")

    def __init__(self, label: str, off: bool) -> None:
        self.label, self.off, self.children, self.texts = label, off, [], []


@lru_cache(maxsize=65_536)
def _kind(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Label of an element, whether it is no content, and whether it bounds the content."""
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    words = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".strip()
    body = tag in ("html", "body", "article", "main")
    off = tag in ASIDE or (not body and bool(words) and MARKS.search(words) is not None)
    off = off or "hidden" in found or found.get("aria-hidden") == "true"
    bound = not off and (tag in ("article", "main") or found.get("role") == "main")
    return f"{tag}.{found.get('class', '').lower()}" if found.get("class") else tag, off, bound


def parse(page: str) -> tuple[Node, list[tuple[str, str, str, bool, bool]]]:
    """The folded tree and the blocks in page order: slot, text, element, in a bound, linked text only.

    Blocks of parts that are no content belong to the tree but are not listed.
    """
    root = Node("", False)
    stack: list[tuple[str, Node, bool, bool, bool]] = [("", root, False, False, False)]  # tag, node, off, bound, header
    blocks: list = []
    pieces: list[str] = []
    linked = plain = 0
    in_link = 0

    def flush() -> None:
        nonlocal pieces, linked, plain
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                tag, node, off, bound, header = stack[-1]
                node.texts.append(text)
                if not off and not (header and (not bound or tag not in ("h1", "h2", "h3"))):
                    blocks.append((node, text, tag, bound, linked > 0 and plain == 0))
        pieces, linked, plain = [], 0, 0

    at, end = 0, len(page)
    for m in iter(lambda: TOKEN.search(page, at), None):
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(piece)
            if not piece.isspace():
                linked, plain = (linked + 1, plain) if in_link else (linked, plain + 1)
        at = m.end() if m.end() > m.start() else m.start() + 1
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE and not (m[3] and MARKS.search(m[3])):
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                in_link = 0 if m[1] else 1
            continue
        if m[1]:
            if tag in INLINE and all(t != tag for t, *_ in stack):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    flush()
                    del stack[i:]
                    break
            continue
        flush()
        if tag in VOID:
            continue
        while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1][0], ()):
            stack.pop()
        label, off, bound = _kind(tag, m[3] or "")
        _, parent, p_off, p_bound, p_header = stack[-1]
        last = parent.children[-1] if parent.children else None
        if len(stack) > DEEPEST:  # what lies deeper keeps its blocks, but its node is that of its ancestor here
            node = parent
        elif last is not None and last.label == label:
            node = last
        else:
            node = Node(label, off)
            parent.children.append(node)
        if tag in RAW or tag in ("svg", "template", "noscript"):
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else (end if tag != "title" else at)
            continue
        if (m[3] or "").rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        stack.append((tag, node, p_off or off, p_bound or bound, p_header or tag == "header"))
    if at < end:
        pieces.append(page[at:])
        plain += 1
    flush()
    _name(root, "")
    return root, blocks


def _name(node: Node, path: str) -> None:
    """Slots are paths of labels, with a count among siblings of one label that others part."""
    seen: dict[str, int] = {}
    for child in node.children:
        k = seen[child.label] = seen.get(child.label, -1) + 1
        child.label = f"{child.label}" if not k else f"{child.label}~{k}"
        _name(child, path)


def text_hash(text: str) -> int:
    x = xxhash.xxh64_intdigest(text)
    return x - (1 << 64) if x >> 63 else x


# A wrapper node is [label, pages, {text hash: pages}, children].


def _wrap(node: Node) -> list:
    texts = {str(text_hash(t)): 1 for t in node.texts} if not node.off else {}
    out = [node.label, 1, texts, [] if node.off else [_wrap(c) for c in node.children]]
    _trim(out[2])
    return out


def _trim(counts: dict) -> None:
    """Misra-Gries: beyond the counters every count falls by what the first one too many has."""
    if len(counts) > COUNTERS:
        cut = sorted(counts.values(), reverse=True)[COUNTERS]
        for k in [k for k, v in counts.items() if v <= cut]:
            del counts[k]
        for k in counts:
            counts[k] -= cut


def match(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size of the largest order-keeping match of two trees of like roots,
    and the pairs of children in it."""
    if a[0] != b[0]:
        return 0, []
    xs, ys = a[3], b[3]
    if [x[0] for x in xs] == [y[0] for y in ys] and len({x[0] for x in xs}) == len(xs):
        return 1 + sum(match(x, y)[0] for x, y in zip(xs, ys)), [(i, i) for i in range(len(xs))]
    w = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    score = [[match(x, y)[0] for y in ys] for x in xs]
    for i in range(len(xs)):
        for j in range(len(ys)):
            w[i + 1][j + 1] = max(w[i][j + 1], w[i + 1][j], w[i][j] + score[i][j])
    pairs, i, j = [], len(xs), len(ys)
    while i and j:
        if score[i - 1][j - 1] and w[i][j] == w[i - 1][j - 1] + score[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif w[i][j] == w[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + w[-1][-1], pairs[::-1]


def merge(a: list, b: list) -> list:
    """Adds the wrapper ``b`` to ``a``; children without a partner join in their place."""
    a[1] += b[1]
    for k, v in b[2].items():
        a[2][k] = a[2].get(k, 0) + v
    _trim(a[2])
    _, pairs = match(a, b)
    partner = {j: i for i, j in pairs}
    out, at = [], 0
    for j, y in enumerate(b[3]):
        if (i := partner.get(j)) is None:
            out.append(y)
            continue
        out += a[3][at:i]
        out.append(merge(a[3][i], y))
        at = i + 1
    a[3] = out + a[3][at:]
    return a


def template_texts(wrapper: list) -> set[int]:
    """Hashes of the texts that fill a slot on most pages of the host, unless whole pages are that alike.

    Where one text of the varying slots is as frequent as others, the pages are copies of one article,
    and nothing tells its text from template.
    """
    pages = wrapper[1]
    if pages < LEAST_PAGES:
        return set()
    found: list[tuple[int, float]] = []
    varied = False
    stack = [wrapper]
    while stack:
        _, n, texts, children = stack.pop()
        stack += children
        top = max(texts.values(), default=0)
        # A slot that most pages fill without a frequent text holds what differs between them.
        varied = varied or (n >= CONSTANT * pages and top < 0.3 * pages and n > 0 and not (top == 0 and not texts and not children) and _fills(texts, n))
        found += [(int(k), v / pages) for k, v in texts.items() if v >= CONSTANT * pages]
    return {k for k, _ in found} if varied else set()


def _fills(texts: dict, pages: int) -> bool:
    """Whether a slot holds text on its pages: counters that cancelled out also show that it did."""
    return bool(texts) or pages > COUNTERS


def content(page: str, template: set[int]) -> str:
    """The blocks of the page that are content, one to a line."""
    blocks = parse(page)[1]
    if any(b[3] for b in blocks):
        blocks = [b for b in blocks if b[3]]
    else:  # without a bound, lists and blocks of links alone are navigation
        blocks = [b for b in blocks if not b[4]]
    return "\n".join(t for _, t, *_ in blocks if text_hash(t) not in template)


def _slots(node: Node, slot: int = 0) -> Iterator[tuple[int, set[int]]]:
    """Each slot of a page that holds text, named by its path of labels, with the hashes of its texts."""
    if node.off:
        return
    slot = text_hash(f"{slot}/{node.label}")
    if node.texts:
        yield slot, {text_hash(t) for t in node.texts}
    for child in node.children:
        yield from _slots(child, slot)


def _common_slots(wrapper: list) -> list[int]:
    """Slots on ``CONSTANT`` of the pages of a merged wrapper; matched nodes have one label, so a path names a slot."""
    pages: dict[int, int] = {}
    stack = [(wrapper, 0)]
    while stack:
        (label, n, _, children), above = stack.pop()
        slot = text_hash(f"{above}/{label}")
        pages[slot] = pages.get(slot, 0) + n
        stack += [(c, slot) for c in children]
    return [k for k, n in pages.items() if n >= CONSTANT * wrapper[1]]


TEXT, WHOLE = 0, 1  # kinds of counted items: one text of a slot, all texts of a slot together
HELD = 200_000  # counts held before a task hands them on


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Wrappers of hosts, and on how many pages each text and each whole content fills each slot."""
    by_host: dict[str, list] = {}
    counts: Counter = Counter()

    def flush() -> dict:
        keys, none = [*counts], [None] * len(by_host)
        host, slot, kind, item = ([k[i] for k in keys] for i in range(4))
        return {
            "host": [*by_host, *host], "wrapper": [*[json.dumps(w) for w in by_host.values()], *[None] * len(keys)],
            "slot": [*none, *slot], "kind": [*none, *kind], "item": [*none, *item], "n": [*none, *counts.values()],
        }

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            root = parse(page)[0]
            together: dict[int, set[int]] = {}
            for slot, texts in _slots(root):
                together.setdefault(slot, set()).update(texts)
            for slot, texts in together.items():
                counts.update((host, slot, TEXT, t) for t in texts)
                counts[host, slot, WHOLE, text_hash(",".join(map(str, sorted(texts))))] += 1
            new = _wrap(root)
            by_host[host] = merge(by_host[host], new) if host in by_host else new
            if len(by_host) > 2_000 or len(counts) > HELD:
                yield flush()
                by_host = {}
                counts.clear()
    if by_host:
        yield flush()


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Merges neighbouring wrappers of one host; the input is sorted by host."""
    host, held = None, None
    for batch in batches:
        names, wrappers = [], []
        for name, text in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist()):
            new = json.loads(text)
            if held is not None and name == host:
                held = merge(held, new)
                continue
            if held is not None:
                names.append(host)
                wrappers.append(json.dumps(held))
            host, held = name, new
        yield {"host": names, "wrapper": wrappers}
    if held is not None:
        yield {"host": [host], "wrapper": [json.dumps(held)]}


def induce_templates(pages: DataFrame) -> DataFrame:
    """``host`` and ``template``, hashes of its template texts, from ``host`` and ``html`` of distinct pages.

    Wrappers are built where the pages lie, merged in ``SALT`` parts of each host and then by host,
    so a host with very many pages neither meets in one task nor sends its pages anywhere. The pages of
    each text in each slot are counted exactly, by sums that start where the pages lie. Template is what
    fills a slot on ``CONSTANT`` of the pages, unless no slot of most pages varies: then pages are copies.
    """
    learned = pin(map_arrow(
        pages.where(F.col("html").isNotNull()).select("host", "html"), _learn, "host string, wrapper string, slot bigint, kind int, item bigint, n bigint"
    ))
    wrappers = learned.where("wrapper is not null").select("host", "wrapper")
    wrappers = wrappers.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(SALT)))
    wrappers = map_arrow(wrappers.repartition("host", "part").sortWithinPartitions("host").select("host", "wrapper"), _join, "host string, wrapper string")
    wrappers = map_arrow(wrappers.repartition("host").sortWithinPartitions("host"), _join, "host string, wrapper string")

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [json.loads(w) for w in batch.column("wrapper").to_pylist()]
            yield {"host": batch.column("host"), "pages": [w[1] for w in found], "slots": [_common_slots(w) for w in found]}

    slots = map_arrow(wrappers, common, "host string, pages bigint, slots array<bigint>").where(F.col("pages") >= LEAST_PAGES)
    slots = pin(slots.select("host", "pages", F.explode("slots").alias("slot")))
    # Summed by item first: a host with very many pages is spread by its texts.
    counts = learned.where("wrapper is null").groupBy("host", "slot", "kind", "item").agg(F.sum("n").alias("n"))
    counts = counts.join(slots, ["host", "slot"])
    # Narrow again: one row a slot, the most frequent whole content and the texts on most of the pages.
    often = (F.col("kind") == TEXT) & (F.col("n") >= CONSTANT * F.col("pages"))
    whole = F.when(F.col("kind") == WHOLE, F.col("n"))
    by_slot = counts.groupBy("host", "slot", "pages").agg(
        F.sum(whole).alias("filled"), F.max(whole).alias("top"), F.collect_set(F.when(often, F.col("item"))).alias("texts")
    )
    varied = (F.col("filled") >= CONSTANT * F.col("pages")) & ((F.col("top") < 0.3 * F.col("pages")) | (F.col("top") == 1))
    by_host = by_slot.groupBy("host").agg(F.max(varied).alias("varied"), F.flatten(F.collect_list("texts")).alias("texts"))
    return by_host.where("varied").select("host", F.array_sort(F.array_distinct("texts")).alias("template"))


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, with the main text of each row in ``base.OWN`` + "text".

    Hosts are the authority part of the url; null and malformed urls share the empty host. A null html
    gives the empty text. Copies of a page weigh as one host page each time they occur; rows stay as
    they are, repeated or not. Deeply broken markup is read as far as its tags go.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url}`").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    body = F.col(f"`{html}`").cast("string")
    known = induce_templates(pages.select(host.alias("host"), body.alias("html")))
    given = pages.withColumns({f"{OWN}host": host, f"{OWN}html": body}).drop(html)
    known = known.where(F.size("template") > 0).select(F.col("host").alias(f"{OWN}host"), F.col("template").alias(f"{OWN}template"))
    joined = given.join(known, f"{OWN}host", "left")
    own = [f"{OWN}host", f"{OWN}html", f"{OWN}template"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows = zip(batch.column(f"{OWN}html").to_pylist(), batch.column(f"{OWN}template").to_pylist())
            found = [content(page, set(template or ())) if page else "" for page, template in rows]
            yield {n: batch.column(n) for n in batch.schema.names if n not in own} | {f"{OWN}text": found}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in own)
    return map_arrow(joined, run, f"{schema}, {OWN}text string")
