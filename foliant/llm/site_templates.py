"""Main text of web pages by removal of site templates.

Every page is parsed to a tree; the subtree of each element gets two hashes: one of its tag, text and children,
and a frame, of its tag, names and children without the text.  Spark counts on how many different pages of a
host each subtree stands (exact copies of a page count once), before anything is deleted.  Subtrees with the same
text on many pages go wherever they stand.  Subtrees whose frame is on most pages of the host go too (menus whose
links differ, footers whose lines differ) if they stand outside its content: the place, given by the tags and
names from the root down, that holds more than half of the host's text and stands once a page; the deepest one.
Where a host has no such place, articles and main parts stand for it.

What does not recur is left to fixed rules: elements that say what they are (menus, footers, forms, adverts,
notices, reader comments and so on, by tag, role, class or id) go, and of pages with articles or a main part
these are kept.  ``rules=False`` switches all of these off.  What is left is written as blocks.

Parsing takes time linear in the page, however long or malformed it is; a page is one row and its tree must fit
in a worker.  After a tag whose quotes never close, quotes of later tags of that page are ordinary characters.

The recurring subtrees are broadcast as sorted 64-bit hashes up to ``BROADCAST_ROWS`` of them (8 bytes each);
beyond that each page gets its own by a join.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialise, small_batches

#: A subtree is a template when it stands on that many different pages of a host, and on that share of them.
MIN_PAGES = 10
MIN_SHARE = 0.3
#: The same for frames outside the article.
MIN_FRAME_PAGES = 3
MIN_FRAME_SHARE = 0.5
#: The content of a host: the deepest place with more than this share of its text, on that share of its pages, and
#: not more often than so many times a page.
CONTENT_SHARE = 0.5
CONTENT_TIMES = 1.2
BROADCAST_ROWS = 1_000_000
#: Kinds of keys, in their lowest two bits.
TEXT, FRAME, PLACE = 0, 1, 2

# Names of the HTML standard, and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
GONE = frozenset(
    "head nav footer aside form script style noscript template textarea title iframe noembed noframes xmp svg object"
    " button select dialog menu canvas audio video map".split()
)
#: Those without text of their own; the others are furniture.
_NO_TEXT = GONE - {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu"}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
FURNITURE = re.compile(
    r"(?:nav|navbar|navigation|menu|breadcrumbs?|masthead|header|footer|sidebar|sidenav|ads?|adverts?|advertisement"
    r"|advertising|adsense|adslot|banner|sponsor|sponsored|promo|promotion|cookies?|consent|gdpr|notices?|newsletter|subscribe"
    r"|subscription|signup|popup|modal|overlay|share|sharing|social|related|recommended|recommendations|comments?|disqus"
    r"|respond|reply|replies|login|search|widget|pagination|pager|toolbar|skip|copyright|disclaimer|alert|toast)"
)
#: Words that go with those in a compound class name, and name no content of their own.
PLAIN = frozenset(
    "site page global main top bottom left right box block wrapper wrap container inner outer list section area bar button buttons"
    " link links item items post primary secondary unit slot form policy message text title row col js icon icons group panel".split()
)
#: A start tag of one of these ends an open one of those.
_P_ENDS = BLOCK - {"li", "tr", "tbody", "tfoot", "thead", "caption", "dd", "dt", "html", "body", "legend", "summary"}
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}

_BARRIERS = ("article", "main", "table")
_PAST_BARRIERS = frozenset("body html article main section div".split())
_STOPS_P = BLOCK | {"td", "th", "button"}

_MARK = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_COMMENT_END = re.compile("--!?>")
_TAG_END = re.compile(r"(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_DIGITS = re.compile(r"\d+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


def _is_furniture(name: str) -> bool:
    """Whether a class or id names page furniture: a furniture word, alone or with plain words only."""
    parts = [x for x in re.split(r"[_\-]+", name) if x]
    named = [x for x in parts if FURNITURE.fullmatch(x)]
    return bool(named) and all(x in PLAIN or x in named for x in parts)


class Element:
    __slots__ = ("tag", "kids", "hash", "frame", "size", "core", "names", "named", "drop")

    def __init__(self, tag: str, attributes: str, rules: bool = True):
        self.tag = tag
        self.kids: list[Element | str] = []
        self.hash = self.frame = self.size = 0
        #: holds an article, the main part or a first heading
        self.core = rules and tag in ("article", "main", "h1")
        self.names = ""
        self.named = False
        self.drop = tag in (GONE if rules else _NO_TEXT)
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name == "role":
                    self.drop |= rules and value.strip() in ROLES
                    self.core |= rules and value.strip() in ("main", "article")
                    self.names += f" role={value}"
                elif name in ("class", "id"):
                    if rules:
                        self.named |= any(map(_is_furniture, value.split())) and not (tag == "p" and value.strip() == "alert")
                    self.names += " " + _DIGITS.sub("0", value)
                elif name == "hidden" or name == "aria-hidden" and value == "true":
                    self.drop = True
                elif name == "style":
                    self.drop |= "display:none" in value.replace(" ", "")

    def close(self) -> None:
        parts, frames = [self.tag], [self.tag + self.names]
        for k in self.kids:
            if isinstance(k, str):
                t = " ".join(k.split())
                self.size += len(t)
                parts.append(t)
            else:
                self.size += 0 if k.drop else k.size
                self.core |= k.core and not k.drop
                parts.append(f"\0{k.hash:x}")
                own = f"\0{k.frame:x}"
                if frames[-1] != own:  # a run of like children counts as one
                    frames.append(own)
        self.drop |= self.named and not self.core
        self.hash = xxhash.xxh64_intdigest("\1".join(parts).encode("utf-8", "surrogatepass"), 42)
        self.frame = xxhash.xxh64_intdigest("\1".join(frames).encode("utf-8", "surrogatepass"), 42)


def parse(source: str, rules: bool = True) -> Element:
    """Tree of a page, however malformed; text is decoded, raw elements keep no text."""
    root = Element("html", "")
    stack, at, n, last = [root], 0, len(source), source.rfind(">")
    # where the open elements of a tag are in the stack, those that stop a paragraph, and those that stop end tags
    places: dict[str, list[int]] = {}
    blockish: list[int] = []
    barriers: list[int] = []
    quotes = True

    def shut(k: int) -> None:
        while len(stack) > k:
            e = stack.pop()
            e.close()
            if stack:
                places[e.tag].pop()
                if e.tag in _STOPS_P:
                    blockish.pop()
                if e.tag in _BARRIERS:
                    barriers.pop()

    def open_at(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else 0

    def text(t: str) -> None:
        if t:
            stack[-1].kids.append(entities.unescape(t) if "&" in t else t)

    while at < n:
        m = _MARK.search(source, at)
        if m is None or (not m[1] and m.end() > last):  # nothing, or nothing that ends
            text(source[at:])
            break
        text(source[at : m.start()])
        if m[1]:
            end = _COMMENT_END.search(source, m.end())
            at = end.end() if end else n
            continue
        end = _TAG_END.match(source, m.end()) if m[3] and quotes else None
        if m[3] and end is None:
            quotes = False
        at = end.end() if end else source.index(">", m.end()) + 1
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            k = open_at(tag)
            # a stray end tag inside an article does not end what is around it
            if k and (tag in _PAST_BARRIERS or not barriers or barriers[-1] <= k):
                shut(k)
            continue
        if tag in ("html", "body"):
            continue
        if tag in _P_ENDS:
            if blockish and stack[blockish[-1]].tag == "p":
                shut(blockish[-1])
        elif tag in _ENDS:
            own, stop = _ENDS[tag]
            least = max(map(open_at, stop))
            k = max(map(open_at, own))
            while k > least:
                shut(k)
                k = max(map(open_at, own)) if tag == "tr" else 0
        attributes = source[m.end() : at - 1]
        e = Element(tag, attributes, rules)
        stack[-1].kids.append(e)
        if tag in RAW:
            end = _RAW_END[tag].search(source, at)
            at = end.end() if end else n
            e.close()
        elif tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            e.close()
        else:
            places.setdefault(tag, []).append(len(stack))
            if tag in _STOPS_P:
                blockish.append(len(stack))
            if tag in _BARRIERS:
                barriers.append(len(stack))
            stack.append(e)
    shut(0)
    return root


def walk(root: Element) -> Iterator[Element]:
    """Elements in page order that are not deleted, none below a deleted one."""
    todo = [root]
    while todo:
        e = todo.pop()
        if not e.drop:
            yield e
            todo.extend(k for k in reversed(e.kids) if isinstance(k, Element))


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def tops(root: Element) -> list[Element]:
    """The outermost articles and main parts with text, in page order; those named as furniture only if all are."""
    found, todo = [], [root]
    while todo:
        e = todo.pop()
        if e.drop:
            continue
        if e.tag in ("article", "main") and e.size:
            found.append(e)
        else:
            todo.extend(k for k in reversed(e.kids) if isinstance(k, Element))
    return [e for e in found if not e.named] or found


def _key(host: str, kind: int, value: int) -> int:
    return _signed(xxhash.xxh64_intdigest(f"{host}\0{kind}{value:x}", 42) & ~3 | kind)


def _placed(root: Element) -> Iterator[tuple[Element, int, int]]:
    """(element, hash of the tags and names from the root down to it, depth) of elements with text, none below a deleted one."""
    todo = [(root, 0, 0)]
    while todo:
        e, place, depth = todo.pop()
        if e.size:
            yield e, place, depth
        if not e.drop:
            for k in e.kids:
                if isinstance(k, Element):
                    todo.append((k, xxhash.xxh64_intdigest(f"{place:x}{k.tag}{k.names}".encode("utf-8", "surrogatepass"), 42), depth + 1))


def keys_of(root: Element, host: str) -> list[tuple[int, Element]]:
    """(key, element) of the subtrees that are counted, by text anywhere and by frame outside articles and main parts:
    elements with text that hold no main part; below one that names itself as furniture none are looked at."""
    out = []
    inside = set(map(id, tops(root)))
    todo = [(root, False)]
    while todo:
        e, within = todo.pop()
        within = within or id(e) in inside
        if e.size and not e.core and e is not root:
            out.append((_key(host, TEXT, e.hash), e))
            if not within:
                out.append((_key(host, FRAME, e.frame), e))
        if not e.drop:
            todo.extend((k, within) for k in e.kids if isinstance(k, Element))
    return out


def _delete_templates(root: Element, removed, host: str, rules: bool) -> int:
    """Mark the subtrees whose key is in ``removed`` as deleted; their number.

    The host's content, what holds it, and where rules hold the articles are safe from frames; so is a page
    without any of these.
    """
    content = {id(e) for e, place, depth in _placed(root) if depth and _key(host, PLACE, place) in removed}
    content |= set(map(id, tops(root))) if rules else set()
    texts, frames = set(), set()
    for key, e in keys_of(root, host):
        if key in removed:
            (frames if key & 3 == FRAME else texts).add(id(e))
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo.extend(k for k in e.kids if isinstance(k, Element))
    around = set(content)  # of the content: itself and its ancestors
    for e in reversed(order):
        if id(e) not in around and any(id(k) in around for k in e.kids if isinstance(k, Element)):
            around.add(id(e))
    n, todo = 0, [(root, not content)]
    while todo:
        e, safe = todo.pop()
        safe = safe or id(e) in content
        if id(e) in texts and (rules or id(e) not in around) or not safe and id(e) not in around and id(e) in frames:
            e.drop = True
            n += 1
        else:
            todo.extend((k, safe) for k in e.kids if isinstance(k, Element))
    return n


def blocks(root: Element, removed=frozenset(), host: str = "", rules: bool = True) -> tuple[list[str], int]:
    """Blocks of the main text, and the number of subtrees deleted as templates: those whose key is in ``removed``."""
    n = _delete_templates(root, removed, host, rules) if host and len(removed) else 0
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        t = " ".join("".join(run).split())
        run.clear()
        if t:
            out.append(t)

    for top in (tops(root) if rules else None) or [root]:
        todo, kinds = [iter(top.kids)], [top.tag]
        while todo:
            k = next(todo[-1], None)
            if k is None:
                todo.pop()
                if kinds.pop() in BLOCK:
                    end()
            elif isinstance(k, str):
                run.append(k)
            elif k.drop or rules and k.tag == "header" and top.tag not in ("article", "main") and not k.core:
                if k.tag in BLOCK or k.tag in GONE:
                    end() if k.tag in BLOCK else run.append(" ")
            elif k.tag in ("br", "td", "th", "img", "wbr"):
                run.append("" if k.tag == "wbr" else " ")
                todo.append(iter(k.kids))
                kinds.append(k.tag)
            else:
                if k.tag in BLOCK:
                    end()
                todo.append(iter(k.kids))
                kinds.append(k.tag)
        end()
    return out, n


_FOUND = "rid long, host long, page long, keys array<long>, places array<struct<key: long, size: long, times: long, depth: long>>"


def _subtrees(rules: bool):
    """Per page: hashes of its host and text, the keys of its subtrees, and its places with their text and times.

    Key 0 stands for the page itself.
    """
    of_place = pa.list_(pa.struct([(k, pa.int64()) for k in ("key", "size", "times", "depth")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, urls, pages = (batch.column(i).to_pylist() for i in range(3))
            hosts, prints, keys, places = [], [], [], []
            for url, source in zip(urls, pages, strict=True):
                host = host_of(url)
                root = parse(source or "", rules)
                hosts.append(_signed(xxhash.xxh64_intdigest(host, 42)))
                text = "\n".join(blocks(root, rules=rules)[0])
                prints.append(_signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)))
                keys.append([0, *dict.fromkeys(key for key, _ in keys_of(root, host))] if host else [])
                own: dict[int, dict] = {}
                for e, place, depth in _placed(root) if host else ():
                    key = _key(host, PLACE, place) if depth else 0
                    at = own.setdefault(key, {"key": key, "size": 0, "times": 0, "depth": depth})
                    at["size"] += e.size
                    at["times"] += 1
                places.append(list(own.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rids, pa.int64()), pa.array(hosts, pa.int64()), pa.array(prints, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(places, of_place)],
                names=["rid", "host", "page", "keys", "places"],
            )

    return run


def _contents(found: DataFrame) -> DataFrame:
    """(key): the place of each host's content."""
    on = found.select("host", "page", F.inline("places")).distinct()
    sums = on.groupBy("host", "key").agg(
        F.sum("size").alias("size"), F.sum("times").alias("times"), F.count("*").alias("pages"), F.max("depth").alias("depth")
    )
    sums = materialise(sums, "places")
    whole = sums.where("key = 0").select("host", F.col("size").alias("of"), F.col("pages").alias("all"))
    one = sums.where("key <> 0").join(whole, "host").where(
        (F.col("size") > CONTENT_SHARE * F.col("of")) & (F.col("pages") > CONTENT_SHARE * F.col("all")) & (F.col("times") <= CONTENT_TIMES * F.col("pages"))
    )
    return one.groupBy("host").agg(F.max(F.struct("depth", "key")).alias("m")).select("m.key")


def _recurring(found: DataFrame, min_pages: int, min_share: float, min_frame_pages: int, min_frame_share: float) -> DataFrame:
    """(key): subtrees that stand on many different pages of their host, and the places of the hosts' contents."""
    on = found.select("host", "page", F.explode("keys").alias("key")).distinct()
    by_frame = F.col("key").bitwiseAND(F.lit(3)) == FRAME
    least = F.when(F.col("key") == 0, 1).when(by_frame, min_frame_pages).otherwise(min_pages)
    counts = on.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    counts = materialise(counts, "subtrees")
    size = counts.where("key = 0").select("host", F.col("n").alias("of"))
    share = F.when(by_frame, min_frame_share).otherwise(min_share)
    often = counts.where("key <> 0").join(size, "host").where(F.col("n") >= share * F.col("of")).select("key")
    return often.union(_contents(found)).distinct()


def templates(
    pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_frame_pages: int = MIN_FRAME_PAGES,
    min_frame_share: float = MIN_FRAME_SHARE, rules: bool = True,
) -> DataFrame:
    """(key) of the recurring subtrees and contents of ``pages`` (rid, url, html)."""
    found = materialise(pages.mapInArrow(_subtrees(rules), _FOUND), "page_subtrees")
    return _recurring(found, min_pages, min_share, min_frame_pages, min_frame_share)


class _Sorted:
    """Membership in sorted hashes."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def __len__(self) -> int:
        return len(self.keys)

    def __contains__(self, key: int) -> bool:
        i = np.searchsorted(self.keys, key)
        return i < len(self.keys) and self.keys[i] == key


def _texts(held, rules: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = _Sorted(held.value) if held is not None else None
        for batch in batches:
            column = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n in ("url", "html", "gone")}
            gone = column.get("gone") or [None] * batch.num_rows
            out, counts = [], []
            for url, source, own in zip(column["url"], column["html"], gone, strict=True):
                removed = shared if shared is not None else frozenset(own or ())
                parts, n = blocks(parse(source or "", rules), removed, host_of(url), rules)
                out.append("\n\n".join(parts))
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(counts, pa.int64())],
                names=["page_id", "url", "text", "n_templates"],
            )
        give_back()

    return run


def main_text(
    pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_frame_pages: int = MIN_FRAME_PAGES,
    min_frame_share: float = MIN_FRAME_SHARE, broadcast_rows: int = BROADCAST_ROWS, rules: bool = True,
) -> DataFrame:
    """page_id, url, text, n_chars, n_templates: one row for each row of ``pages`` (page_id, url, html).

    n_templates counts the subtrees deleted because they recur on the host.  A null or blank page has an empty
    text.  A page without a host has no templates.  Repeated rows come back as often as they came in.  Other
    columns are ignored.  ``rules=False``: templates alone, no tag, role, class or id names furniture or content.
    """
    small_batches(pages.sparkSession)
    own = pages.select(
        F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("long").alias("page_id"), "url", "html"
    )
    known = materialise(own.select("rid", "url", "html").mapInArrow(_subtrees(rules), _FOUND), "page_subtrees")
    found = materialise(_recurring(known, min_pages, min_share, min_frame_pages, min_frame_share), "templates")
    n = found.count()
    schema = "page_id long, url string, text string, n_templates long"
    if n <= broadcast_rows:
        keys = np.sort(found.toArrow()["key"].to_numpy()) if n else np.zeros(0, np.int64)
        held = pages.sparkSession.sparkContext.broadcast(keys)
        out = own.select("page_id", "url", "html").mapInArrow(_texts(held, rules), schema)
    else:
        own = materialise(own, "pages")  # the same row numbers on both sides of the join
        on = own.select("rid", "url", "html").mapInArrow(_subtrees(rules), _FOUND)
        on = on.select("rid", F.explode(F.concat("keys", "places.key")).alias("key"))
        gone = on.join(found, "key").groupBy("rid").agg(F.collect_set("key").alias("gone"))  # at most the elements of one page
        out = own.join(gone, "rid", "left").select("page_id", "url", "html", "gone").mapInArrow(_texts(None, rules), schema)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_templates")
