"""Main text by wrapper induction.

Every host has a reference page.  Each page's tree is aligned with it by simple tree
matching (largest order-preserving match of nodes with equal labels), which names every
node by the reference's slot: the labels on the way, with the place among its equals for
containers; repeated leaves such as paragraphs share a slot.  Over all pages of a host,
slots that keep repeating the same texts are template, and slots whose texts vary are
content.  Hosts with few pages are judged by the slots of all hosts.

A declared article (``article``, ``main``) is evidence, not the answer: it is taken whole if
the leaves inside hold at least half of what varies over the host's pages, as slots
find it.  Otherwise, and on pages that declare none, all leaves of varying slots are
content.  Navigation, headers and footers of the page, sidebars, notices, adverts, forms,
scripts, styles and reader comments are recognised by tag or class and are never content;
inside an article a class that only resembles such a word excludes nothing by itself: its
leaves go if their slot is template.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquarry.llm.common import written
from dataquarry.llm.urlfilter import host_of

#: Tags by role (fixed values).
RAW = frozenset("script style noscript template textarea title iframe svg math select object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body head div p ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 section article main "
    "header footer nav aside form fieldset blockquote pre figure figcaption address details summary dialog hr center button".split()
)
REPEATED = frozenset("p li td th tr dt dd h1 h2 h3 h4 h5 h6 blockquote pre figcaption #text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("nav aside footer form button dialog fieldset head menu".split()) | RAW
DECLARED = frozenset(["article", "main"])
#: An open paragraph ends before these; an open item of one kind before another.
CLOSES_P = BLOCK - {"html", "body", "head", "button"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table div section article main body form nav aside header footer".split())
#: Words of classes, ids and roles that mark what is not content (fixed values).
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice\w*|alert|popup|modal|overlay|"
    r"side-?bar|menu|nav|navbar|navigation|breadcrumbs?|masthead|header|footer|comments?|respond|replies|share|social|"
    r"related|newsletter|subscribe|widget|disclaimer|legal|complementary|contentinfo|search)(?:$|[\s_-])"
)
#: Whole classes that are never content inside an article either.
PLAIN_HINTS = re.compile(
    r"(?:^|\s)(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|popup|modal|overlay|side-?bar|menu|nav|"
    r"navbar|navigation|breadcrumbs?|footer|comments?|respond|replies|newsletter|subscribe)(?=\s|$)"
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(>|$)", re.S
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

#: Pages of a host (or of all hosts) that a slot must be seen on before it is judged.
LEAST_PAGES = 8
#: A slot is template if its different texts are at most this share of the pages.
VARYING = 0.5
#: The reference of a host is its smallest page of at least so many bytes;
REFERENCE_BYTES = 500
#: tables by host are sent to every task if they have no more bytes than this, else pages are shuffled to them.
BROADCAST_BYTES = 32_000_000
#: In children lists whose product is larger, equal texts count only in subtrees that are equal as a whole.
MOST_CELLS = 40_000
#: Rows of the table of sizes up to this length are lists, which are faster then.
SHORT_ROW = 64
#: A declared article holds at least this share of the varying text, or it is not the article.
ARTICLE_SHARE = 0.5


class Node:
    __slots__ = ("children", "declared", "excluded", "kind", "label", "shape", "size", "slot", "tag", "text", "weak")

    def __init__(self, tag: str, label: str, excluded: bool = False, weak: bool = False, declared: bool = False):
        self.tag, self.label, self.excluded, self.weak, self.declared = tag, label, excluded, weak, declared
        self.children: list[Node] = []
        self.text: list[str] = []
        self.slot = self.kind = self.shape = 0
        self.size = 0.0


def _attributes(tag: str, rest: str, inside: bool) -> tuple[str, bool, bool]:
    """The label (tag and first class or id), whether the element is never content, and whether it may be none."""
    if not rest.strip(" /\t\r\n"):
        return tag, tag in NEVER, False
    found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "").lower() for m in ATTRIBUTE.finditer(rest)}
    names = " ".join(found.get(k, "") for k in ("class", "id", "role")).strip()
    first = names.split()[0] if names else ""
    hidden = "hidden" in found or found.get("aria-hidden") == "true"
    hinted = tag not in DECLARED | HEADINGS and tag not in ("body", "html") and bool(HINTS.search(names))
    certain = hinted and (not inside or bool(PLAIN_HINTS.search(names)))
    return f"{tag}.{first}" if first else tag, tag in NEVER or hidden or certain, hinted and not certain


def parse(page: str | None) -> Node:
    """The tree of block elements; runs of text between them are ``#text`` leaves."""
    page = page or ""
    root = Node("#root", "#root")
    stack = [root]
    run: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text:
            leaf = Node("#text", "#text")
            leaf.text.append(text)
            stack[-1].children.append(leaf)

    def close(tags: set[str] | frozenset[str], scope: frozenset[str]) -> None:
        """Close the innermost open element of these tags that lies in scope."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                flush()
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            run.append(page[at:])
            break
        run.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if not m[4]:
            break  # cut off inside a tag
        if m[1]:
            if tag == "br":
                run.append(" ")
            elif tag in BLOCK:
                close({tag}, frozenset())
            continue
        if tag in RAW and not m[3].endswith("/"):
            close_at = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close_at.end() if close_at else end
            run.append(" ")
            continue
        if tag in VOID and tag != "hr":
            if tag in ("br", "wbr", "img", "input"):
                run.append("" if tag == "wbr" else " ")
            continue
        label, excluded, weak = _attributes(tag, m[3], stack[-1].declared)
        if tag not in BLOCK:
            if excluded and not m[3].endswith("/"):
                at = _matching_end(page, at, tag)
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in SIBLINGS:
            close(SIBLINGS[tag], SCOPE)
        flush()
        node = Node(tag, label, excluded, weak, stack[-1].declared or tag in DECLARED)
        stack[-1].children.append(node)
        if tag != "hr" and not m[3].endswith("/"):
            stack.append(node)
    flush()
    return root


def _matching_end(page: str, at: int, tag: str) -> int:
    """Behind the end tag of an inline element that opened before ``at``; ``at`` itself if it is never closed."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return at


def _order(root: Node) -> list[Node]:
    """All nodes, parents before their children."""
    nodes = [root]
    for node in nodes:
        nodes.extend(node.children)
    return nodes


def _classify(roots: list[Node]) -> None:
    """Number the subtrees: ``kind`` is equal for equal ones, ``shape`` for those equal but for their texts.

    ``size`` is what a subtree gains when it is matched with an equal one.
    """
    kinds: dict[tuple, int] = {}
    shapes: dict[tuple, int] = {}
    for root in roots:
        for node in reversed(_order(root)):
            below = node.children
            node.kind = kinds.setdefault((node.label, *node.text, None, *[c.kind for c in below]), len(kinds))
            node.shape = shapes.setdefault((node.label, *[c.shape for c in below]), len(shapes))
            node.size = 1.0 + sum(c.size for c in below) if below else 2.0


def _run(step: Generator):
    """The result of a generator that yields the generators it waits for; depth costs no stack."""
    waiting, result = [step], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(result))
            result = None
        except StopIteration as end:
            waiting.pop()
            result = end.value
    return result


def match(a: Node, b: Node, found: dict[int, Node]) -> float:
    """Simple tree matching of two nodes with equal labels: the size of the largest match.

    Leaves with equal texts count double.  ``found`` gets the partner of every child of ``a`` that is matched.
    """
    _classify([a, b])
    sizes: dict[tuple[int, int, bool], float] = {}
    result = _run(_size(a, b, sizes))
    todo = [(a, b, False)]
    while todo:
        x, y, plain = todo.pop()
        if x.kind == y.kind:
            pairs = [(one, two, plain) for one, two in zip(x.children, y.children)]
        elif len(x.children) == len(y.children) == 1:
            pairs = [(x.children[0], y.children[0], plain)] if x.children[0].label == y.children[0].label else []
        else:
            pairs = _run(_partners(x, y, sizes, plain))
        for one, two, below in pairs:
            found[id(one)] = two
            if one.children and two.children:
                todo.append((one, two, below))
    return result


def _ends(one: list[Node], two: list[Node]) -> tuple[int, int]:
    """How many equal children two lists have at their start and at their end; a largest match pairs them."""
    least, head, tail = min(len(one), len(two)), 0, 0
    while head < least and one[head].kind == two[head].kind:
        head += 1
    while tail < least - head and one[-1 - tail].kind == two[-1 - tail].kind:
        tail += 1
    return head, tail


def _known(a: Node, b: Node, sizes: dict) -> float | None:
    """What two nodes of one label gain, if no list has to be matched for it."""
    if a.kind == b.kind:
        return a.size
    one, two = a.children, b.children
    if not one or not two:
        return 2.0 if a.text == b.text else 1.0
    if len(one) == len(two) == 1:
        x, y = one[0], two[0]
        if x.label != y.label:
            return 1.0
        if not x.children or not y.children:
            return 3.0 if x.text == y.text else 2.0
    return sizes.get((a.kind, b.kind, False))


def _size(a: Node, b: Node, sizes: dict) -> Generator:
    """What two nodes of one label gain."""
    size = _known(a, b, sizes)
    if size is None:
        size = sizes[a.kind, b.kind, False] = yield _rows(a, b, sizes, False, None)
    return size


def _next_row(above, gains):
    """The next row of the table of sizes: its running maximum; short rows are lists."""
    if isinstance(gains, list):
        row, most = [0.0], 0.0
        for j, gain in enumerate(gains):
            if above[j + 1] > most:
                most = above[j + 1]
            if gain and above[j] + gain > most:
                most = above[j] + gain
            row.append(most)
        return row
    return np.concatenate(([0.0], np.maximum.accumulate(np.maximum(above[1:], above[:-1] + gains))))


def _rows(a: Node, b: Node, sizes: dict, plain: bool, keep: list | None) -> Generator:
    """The size of the match of two children lists; ``keep`` gets what a traceback needs.

    One row of the table of sizes is one running maximum, and only every few rows stay in memory.
    """
    head, tail = (0, 0) if plain and keep is None else _ends(a.children, b.children)
    one, two = a.children[head : len(a.children) - tail], b.children[head : len(b.children) - tail]
    same = 0.0
    if head or tail:
        same = sum(c.size for c in a.children[:head]) + sum(c.size for c in a.children[len(a.children) - tail :])
    below = plain or len(one) * len(two) > MOST_CELLS
    labels: dict[str, list[int]] = {}
    for j, y in enumerate(two):
        labels.setdefault(y.label, []).append(j)
    short = len(two) <= SHORT_ROW
    kinds = None if short else np.array([y.kind for y in two])
    gains: dict = {}

    def gain(x: Node) -> Generator:
        """What a child of ``a`` gains with every child of ``b``."""
        of = x.shape if below else x.kind
        row = gains.get(of)
        if row is None:
            row = [0.0] * len(two) if short else np.zeros(len(two))
            by_shape: dict[int, float] = {}
            for j in labels.get(x.label, ()):
                y = two[j]
                if below:
                    if y.shape not in by_shape:
                        by_shape[y.shape] = yield _plain_size(x, y, sizes)
                    row[j] = by_shape[y.shape]
                else:
                    size = _known(x, y, sizes)
                    row[j] = size if size is not None else (yield _size(x, y, sizes))
            gains[of] = row
        if below and not (plain and keep is None):
            row = [x.size if y.kind == x.kind else r for y, r in zip(two, row)] if short else np.where(kinds == x.kind, x.size, row)
        return row

    every = 1 if short else max(1, int(len(one) ** 0.5))
    last = [0.0] * (len(two) + 1) if short else np.zeros(len(two) + 1)
    stored = {0: last}
    for i, x in enumerate(one):
        row = None if below else gains.get(x.kind)
        last = _next_row(last, (yield gain(x)) if row is None else row)
        if keep is not None and (i + 1) % every == 0:
            stored[i + 1] = last
    if keep is not None:
        keep.extend((head, tail, one, two, below, gain, every, stored))
    return 1.0 + same + float(last[-1])


def _plain_size(a: Node, b: Node, sizes: dict) -> Generator:
    """What two subtrees gain by their labels alone."""
    if not a.children or not b.children:
        return 1.0
    key = (a.shape, b.shape, True)
    if key not in sizes:
        sizes[key] = yield _rows(a, b, sizes, True, None)
    return sizes[key]


def _partners(a: Node, b: Node, sizes: dict, plain: bool) -> Generator:
    """The matched children of two nodes, last ones first, and whether their own children are matched by labels alone."""
    keep: list = []
    yield _rows(a, b, sizes, plain, keep)
    head, tail, one, two, below, gain, every, stored = keep
    pairs = [(x, y, plain) for x, y in zip(a.children[:head], b.children[:head])]
    pairs += [(x, y, plain) for x, y in zip(a.children[len(a.children) - tail :], b.children[len(b.children) - tail :])]
    i, j, block = len(one), len(two), {}
    while i and j:
        if i - 1 not in block or i not in block:
            start = (i - 1) // every * every
            block = {start: stored[start]}
            for k in range(start, i):
                block[k + 1] = _next_row(block[k], (yield gain(one[k])))
        if block[i][j] == block[i - 1][j]:
            i -= 1
        elif block[i][j] == block[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((one[i], two[j], below))
    return pairs


def _slot(above: int, step: str) -> int:
    """A slot below another one: as long at any depth."""
    return int.from_bytes(hashlib.blake2b(f"{above}/{step}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def name_slots(root: Node) -> None:
    """Slots of a reference page: labels from the root, numbered among equal containers."""
    todo = [root]
    while todo:
        node = todo.pop()
        seen: dict[str, int] = {}
        for child in node.children:
            n = seen[child.label] = seen.get(child.label, -1) + 1
            child.slot = _slot(node.slot, child.label + ("" if child.tag in REPEATED or not n else f"#{n}"))
            todo.append(child)


def leaves(page: Node, reference: Node | None) -> list[tuple[int, bool, bool, str]]:
    """``(slot, declared, weak, text)`` of every leaf that may be content, in page order."""
    found: dict[int, Node] = {}
    if reference is not None:
        match(page, reference, found)
    out, todo = [], [(page, 0, False, False)]
    while todo:
        node, slot, declared, weak = todo.pop()
        if node.text:
            out.append((slot, declared, weak, node.text[0]))
        below = []
        for child in node.children:
            if child.excluded or (child.tag == "header" and not declared):
                continue
            partner = found.get(id(child))
            own = partner.slot if partner is not None else _slot(slot, child.label + ("" if child.tag in REPEATED else "#+"))
            below.append((child, own, declared or child.tag in DECLARED, weak or child.weak))
        todo.extend(reversed(below))
    return out


LEAVES = "array<struct<slot:bigint,declared:boolean,weak:boolean,text:string>>"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of each page, aligned with its host's reference page."""
    references: dict[str, Node] = {}
    names = ("slot", "declared", "weak", "text")
    kind = pa.list_(pa.struct(list(zip(names, (pa.int64(), pa.bool_(), pa.bool_(), pa.string())))))
    for batch in batches:
        found = []
        for host, page, reference in zip(batch.column(2), batch.column(3), batch.column(4)):
            host = host.as_py()
            if host not in references:
                if len(references) >= 500:
                    references.clear()
                references[host] = parse(reference.as_py())
                name_slots(references[host])
            found.append([dict(zip(names, leaf)) for leaf in leaves(parse(page.as_py()), references[host])])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(found, kind)], ["key", "url", "host", "leaves"]
        )


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(key, url, text, n_chars)`` per row: blocks of main text, one per line.

    White space inside a block becomes one space.  A null page is empty and has an empty
    text; pages without a URL form a host of their own; equal pages of a host are
    evidence once; repeated rows are rows of their own; other columns are left out.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    size = F.octet_length("html")
    order = F.struct((F.coalesce(size, F.lit(0)) < REFERENCE_BYTES).alias("small"), size.alias("size"), F.xxhash64("html").alias("hash"))
    references = written(rows.groupBy("host").agg(F.min_by("html", order).alias("reference")), "page-references")
    if (references.agg(F.sum(F.octet_length("host") + F.coalesce(F.octet_length("reference"), F.lit(0)))).first()[0] or 0) <= BROADCAST_BYTES:
        references = F.broadcast(references)
    aligned = written(
        rows.join(references, "host").select("key", "url", "host", "html", "reference").mapInArrow(
            _extract,
            f"key {pages.schema[key].dataType.simpleString()}, url {pages.schema[url].dataType.simpleString()}, host string, leaves {LEAVES}",
        ),
        "page-leaves",
    )

    digest = F.transform("leaves", lambda x: F.struct(x["slot"].alias("slot"), F.xxhash64(x["text"]).alias("text")))
    evidence = aligned.select("host", F.xxhash64(F.transform("leaves", lambda x: x["text"])).alias("page"), F.explode(F.array_distinct(digest)).alias("_l"))
    counted = evidence.select("host", "page", "_l.*").distinct().groupBy("host", "slot", "text").agg(F.count("*").alias("n"))

    def judged(by: list[str], name: str) -> DataFrame:
        return counted.groupBy(*by).agg((F.count_distinct("text") / F.sum("n")).alias(f"{name}_share"), F.sum("n").alias(f"{name}_pages"))

    own, everywhere = judged(["host", "slot"], "own"), judged(["slot"], "all")
    share = F.when(F.col("own_pages") >= LEAST_PAGES, F.col("own_share")).when(F.col("all_pages") >= LEAST_PAGES, F.col("all_share"))
    verdicts = own.join(everywhere, "slot").where(share <= VARYING).select("host", "slot")
    found = written(verdicts.groupBy("host").agg(F.collect_list("slot").alias("templates")), "page-verdicts")
    # Slots that many pages repeat, so a few for each host; sent to the pages or joined to them, by their size.
    size_of = F.octet_length("host") + 8 * F.size("templates")
    if (found.agg(F.sum(size_of)).first()[0] or 0) <= BROADCAST_BYTES:
        found = F.broadcast(found)
    none = F.array().cast("array<bigint>")
    full = aligned.join(found, "host", "left").withColumn("templates", F.coalesce("templates", none))
    varying = F.filter("leaves", lambda x: ~F.array_contains("templates", x["slot"]))
    mass = lambda chosen: F.aggregate(chosen, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x["text"]))
    inside = F.exists("leaves", lambda x: x["declared"])
    weighed = full.where(inside).groupBy("host").agg(
        F.count("*").alias("pages"), F.sum(mass(varying)).alias("all"), F.sum(mass(F.filter(varying, lambda x: x["declared"]))).alias("within")
    )
    # Hosts, though not their pages, whose declared parts are not the article; few pages of a host prove nothing.
    doubted = weighed.where((F.col("pages") >= LEAST_PAGES) & (F.col("within") < ARTICLE_SHARE * F.col("all")))
    doubted = written(doubted.select("host", F.lit(True).alias("doubted")), "page-doubts")
    full = full.join(doubted, "host", "left")
    article = F.filter("leaves", lambda x: x["declared"] & ~(x["weak"] & F.array_contains("templates", x["slot"])))
    chosen = F.when(inside & F.col("doubted").isNull(), article).otherwise(varying)
    text = F.array_join(F.transform(chosen, lambda x: x["text"]), "\n")
    return full.select(F.col("key").alias(key), F.col("url").alias(url), text.alias("text")).withColumn(
        "n_chars", F.length("text").cast("bigint")
    )
