"""Main text of web pages by site template removal.

Every block element of a page gives hashes of its subtree: one of its content (tag, class, words and the
hashes of its children) and, where no heading or paragraph is in it, one of its frame (the path to it, and the tags and
classes in it, like children once, without the words). Spark counts the different main texts of a host
whose pages hold each hash (copies of one main text count once). Subtrees that recur across many
of them are the host's template and are deleted:

* content without headings or paragraphs on MIN_SHARE of the host's pages, with them on FRAME_SHARE;
* frames on FRAME_SHARE, if they hold at most FRAME_WORDS of the words of the pages they are on and either their page has an
  article or main element and they stand outside, or most of their words are links;
* never what holds more than half of the words of its pages, so that mirrors of a page don't vanish.

What stands in single pages, or in hosts of few pages, is told by its tag, role or class (rules): menus, page headers and footers,
side bars, notices, adverts, forms and comments. A compound name tells only if all its words do (popular-science says nothing), and within an
article a name deletes headings or paragraphs only if it can't be a subject (comments, but not search or popular). n_template and n_ruled tell how many subtrees each way deleted.

Where a page has an article, its headings and paragraphs are content even if other pages of the host
repeat them (copies of an article are no template); inside it only blocks without any of these are
deleted, and what lies in a list, table or figure only with the whole of it. Items and cells always go only with their
list or table.

A page's hashes are written once, so html is parsed twice in all. A host's template holds at most 1 / MIN_SHARE as many hashes
as its pages have on average, as each is on that share of them. It goes to SALTS parts of the host's pages, and the html is
shuffled by page, so that a host with a third of all pages isn't gathered.

Defined results: null or empty html gives empty text; a page without an article or main element is
read as a whole; broken markup is closed as browsers do; a null id comes last; repeated rows of
one html, and pages of one main text, count once and get equal results; a very long page is read whole, in time
that grows with its length; an empty table gives no row.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import batch_of, cut, key_of, salted_join, struct, text_of

#: A template subtree is on at least so many different pages of its host, and on this share of them.
MIN_PAGES, MIN_SHARE = 4, 0.1
#: The share for frames and for content with headings or paragraphs, and the share of words that a frame holds at most.
FRAME_SHARE, FRAME_WORDS = 0.5, 0.25
#: Parts that a host's pages are dealt to where they meet its template.
SALTS = 32

NAME = re.compile(r"[A-Za-z][^\s/>]*")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Attributes that say what an element is for; tags without any of these words have none.
TELLING = re.compile("class|id|role|hidden", re.I)

# Fixed values of HTML: elements without an end tag, elements whose text is no markup, block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote dd dt".split())
#: Parts of a list, table or figure, and these.
ITEM = frozenset("li dt dd tr td th thead tbody tfoot caption figcaption".split())
GROUP = frozenset("ul ol dl dir table figure".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup legend summary".split()) | {"summary"}
#: What an opening tag ends, and where looking for it stops.
ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"), "option": ("option", "select optgroup datalist"), "optgroup": ("option optgroup", "select")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
SCOPE = frozenset("table td th caption html object template button".split())

JUNK_TAGS = frozenset("head nav footer aside form script style noscript template iframe button select textarea svg canvas object menu dialog title noembed noframes xmp audio video map math datalist input".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
JUNK_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion promoted banner banners"
    " cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login"
    " sidebar sidebars sidenav rail menu menus nav navbar navigation topnav breadcrumb breadcrumbs toc pagination pager"
    " header masthead topbar footer foot colophon copyright legal disclaimer"
    " comment comments commentlist respond replies reply discussion disqus reviews"
    " share sharing social socials related recommended recommendations trending popular teaser teasers widget widgets toolbar search tags tagcloud skip".split()
)
#: Names that can't be a subject, whatever they hold.
SURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors cookie cookies consent gdpr newsletter subscribe"
    " sidebar sidebars sidenav nav navbar navigation topnav breadcrumb breadcrumbs pagination pager footer"
    " comment comments commentlist respond replies disqus share sharing related teaser teasers widget widgets".split()
)
#: Words that a compound name may hold beside these.
PART_WORDS = frozenset("site page main global top bottom left right middle first last upper lower inner outer content area box block bar container wrapper wrap holder section panel list item items links link group row col column unit slot space form button buttons icons text title body post posts article articles news story stories thread feed js is has".split())
KEPT = frozenset("html body main article p h1 h2 h3 h4 h5 h6".split())
#: No content whatever the rules.
MARKUP = frozenset("head title script style noscript template iframe noembed noframes object svg math audio video canvas map datalist".split())
#: By opening tag the place of its rule, and what each tag does to the open elements that a rule would end.
RULES = {tag: i for i, tag in enumerate(ENDS)}
TOUCHED = frozenset().union(*(a | b for a, b in ENDS.values()))


class Node:
    __slots__ = ("tag", "names", "role", "hidden", "parts", "up", "p", "open", "texted")

    def __init__(self, tag: str, attributes: str, up: Node | None):
        self.tag, self.up, self.parts = tag, up, []
        self.names: list[str] = []
        self.role, self.hidden = "", False
        #: Whether it is or holds a heading or paragraph.
        self.texted = False
        if tag in TEXT_BLOCK:
            x = self
            while x is not None and not x.texted:
                x.texted, x = True, x.up
        #: The open p of this scope, and for each of RULES the outermost element that its tag would end.
        self.p = self if tag == "p" else None if up is None or tag in SCOPE else up.p
        self.open = (None,) * len(ENDS) if up is None else up.open
        if tag in TOUCHED:
            self.open = tuple(None if tag in stops else old or (self if tag in ended else None) for old, (ended, stops) in zip(self.open, ENDS.values()))
        if attributes and TELLING.search(attributes):
            for m in ATTRIBUTE.finditer(attributes):
                what, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if what == "role":
                    self.role = value
                elif what == "hidden" or what == "aria-hidden" and value == "true":
                    self.hidden = True
                elif what in ("class", "id"):
                    self.names += value.split()

    def junk(self, inside: bool) -> bool:
        """Not content by tag, role or name; inside: within the article, where a header is its own.

        There a name deletes headings or paragraphs only where it can mean nothing else (SURE_NAMES).
        """
        if self.tag in JUNK_TAGS or self.hidden or self.role in JUNK_ROLES:
            return True
        if self.tag == "header":
            return not inside
        if self.tag in KEPT and self.tag not in ("article", "p"):
            return False
        return any(told(n, SURE_NAMES if inside and self.texted else JUNK_NAMES) for n in self.names if not (inside and n == "header"))


@lru_cache(1 << 16)
def told(name: str, names: frozenset[str]) -> bool:
    """Whether a class or id is one of names, or made of some of them and words for places and parts alone."""
    if name in names:
        return True
    words = [w for w in re.split("[-_]+", name) if not w.isdigit()]
    return any(w in names for w in words) and all(w in names or w in PART_WORDS for w in words)


class Ends:
    """Where tags end, found in one pass forward."""

    def __init__(self, text: str):
        self.text = text
        #: Quotes that are never closed count as plain characters from the first on that swallows the rest of the page.
        self.quotes = True

    def of(self, at: int) -> int:
        """The place of the > that ends the tag whose attributes begin at at, or -1."""
        text, p = self.text, at
        while self.quotes:
            m = STOP.search(text, p)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            close = text.find(m[0], m.end())
            if close < 0:
                break
            p = close + 1
        self.quotes = False
        return text.find(">", at)


def parse(text: str) -> Node:
    """The element tree; parts of a node are nodes and strings (character references decoded)."""
    root = here = Node("", "", None)
    at, end, ends = 0, len(text), Ends(text)
    counts: Counter[str] = Counter()  # open elements by tag

    def close(node: Node) -> Node:
        """Ends node and what is open in it."""
        x = here
        while True:
            counts[x.tag] -= 1
            if x is node:
                return node.up
            x = x.up

    seen = 0  # text up to here is in the tree, or is a tag
    while at < end:
        lt = text.find("<", at)
        if lt < 0:
            break
        follows = text[lt + 1 : lt + 2]
        if follows == "!" or follows == "?":
            if text.startswith("<!--", lt):
                stop = text.find("-->", lt + 4)
                at = end if stop < 0 else stop + 3
            elif text.startswith("<![CDATA[", lt) and (stop := text.find("]]>", lt + 9)) >= 0:
                at = stop + 3
            else:
                stop = text.find(">", lt)
                at = end if stop < 0 else stop + 1
            if lt > seen:
                here.parts.append(entities.unescape(text[seen:lt]))
            if text.startswith("<![CDATA[", lt) and text.endswith("]]>", lt, at):
                here.parts.append(text[lt + 9 : at - 3])
            seen = at
            continue
        ending = follows == "/"
        m = NAME.match(text, lt + 1 + ending)
        stop = ends.of(m.end()) if m else -1
        if stop < 0:
            if m:  # no tag ends after here, but a comment may still come
                at = text.find("<!", lt)
                if at < 0:
                    break
            else:
                at = lt + 1
            continue
        if lt > seen:
            here.parts.append(entities.unescape(text[seen:lt]))
        at = seen = stop + 1
        tag, attributes = m[0].lower(), text[m.end() : stop]
        if ending:
            if counts[tag] > 0:
                node = here
                while node.tag != tag:
                    node = node.up
                here = close(node)
            continue
        if tag in CLOSES_P and here.p is not None:
            here = close(here.p)
        if tag in ENDS and (last := here.open[RULES[tag]]) is not None:
            here = close(last)
        node = Node(tag, attributes, here)
        here.parts.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            shut = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, at)
            node.parts.append(text[at : shut.start() if shut else end])
            stop = text.find(">", shut.end()) if shut else -1
            at = seen = end if stop < 0 else stop + 1
        elif not attributes.endswith("/") or tag not in ("svg", "math", "path"):
            counts[tag] += 1
            here = node
    if seen < end:
        here.parts.append(entities.unescape(text[seen:]))
    return root


def containers(root: Node) -> list[Node]:
    """The outermost articles, or else main elements, outside of junk; the whole page if there is none."""
    for tag in ("article", "main"):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.tag == tag or tag == "main" and node.role == "main":
                if not node.junk(False):
                    found.append(node)
                continue
            if node.tag and node.tag != "header" and node.junk(False):
                continue
            stack += [p for p in reversed(node.parts) if type(p) is Node]
        if found:
            return found
    return [root]


#: What a hash is of: content without headings and paragraphs, content with them, a frame.
BARE, TEXTED, FRAME = range(3)


class Subtrees:
    """By id of the node: how many words it has, and the hashes by which it may be template, with what they are of."""

    def __init__(self, root: Node, holders: list[Node], rules: bool = True):
        order, stack, inside_of = [], [(root, False, False, 0)], {id(n) for n in holders if n is not root}
        while stack:
            node, inside, grouped, path = stack.pop()
            inside = inside or id(node) in inside_of
            order.append((node, inside, grouped, path))
            grouped = inside and (grouped or node.tag in GROUP or node.tag in ITEM)
            below = hash64("path", str(path), node.tag, *node.names) if node.tag in BLOCK else path
            stack += [(p, inside, grouped, below) for p in node.parts if type(p) is Node]
        self.words: dict[int, int] = {}
        self.may: dict[int, tuple[tuple[int, int], ...]] = {}
        own, shape, texted, mere, linked = {}, {}, {}, {}, {}
        for node, inside, grouped, path in reversed(order):
            i, parts, has, bare, words, links, kinds = id(node), [node.tag, *node.names], node.tag in TEXT_BLOCK, True, 0, 0, set()
            for p in node.parts:
                if type(p) is Node:
                    x = id(p)
                    if p.tag not in RAW:
                        parts.append(str(own[x]))
                    has = has or texted[x]
                    bare = bare and mere[x] and p.tag != "a" and (p.tag not in BLOCK or p.tag in ITEM)
                    words, links = words + self.words[x], links + linked[x]
                    kinds.add(shape[x])
                else:
                    split = p.split()
                    parts += split
                    words += len(split)
            if node.tag in MARKUP or node.tag in RAW:
                words = links = 0
            self.words[i], linked[i], texted[i], mere[i] = words, words if node.tag == "a" else links, has, bare
            own[i] = hash64(*parts)
            shape[i] = hash64(node.tag, *node.names, *sorted(map(str, kinds)))
            if not words or node.tag not in BLOCK or node.tag in ITEM or node.tag in ("html", "body", "main", "article", "head"):
                continue
            found = []
            if inside:  # a plain div of mere text is a paragraph
                if not (has or grouped or node.tag == "div" and bare and not node.names):
                    found.append((own[i], BARE))
            else:
                found.append((own[i], TEXTED if has else BARE))
                if not has and (inside_of or not rules or 2 * links > words):
                    found.append((hash64("frame", str(path), str(shape[i])), FRAME))
            if found:
                self.may[i] = tuple(found)
        self.total = self.words[id(root)]

    def template(self, node: Node, template: frozenset[int]) -> bool:
        return any(h in template for h, _ in self.may.get(id(node), ()))


def hash64(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(parts)) - (1 << 63)


def template_hashes(html: str, rules: bool = True) -> tuple[int, int, list[tuple[int, int, int]]]:
    """A hash of the main text with nothing deleted as template, the page's words, and hash, kind and words of the subtrees that may be template."""
    root = parse(html)
    holders = containers(root) if rules else [root]
    subtrees = Subtrees(root, holders, rules)
    found: dict[tuple[int, int], int] = {}
    sizes = subtrees.words
    for i, kinds in subtrees.may.items():
        for key in kinds:
            found[key] = found.get(key, 0) + sizes[i]
    text, _, _ = rendered(root, holders, None, frozenset(), rules)
    return hash64(*text.split()), subtrees.total, [(h, kind, n) for (h, kind), n in found.items()]


def main_text(html: str, template: frozenset[int] = frozenset(), rules: bool = True) -> str:
    """The blocks of the article, joined by newlines, without junk and subtrees of the template."""
    return extracted(html, template, rules)[0]


def extracted(html: str, template: frozenset[int] = frozenset(), rules: bool = True) -> tuple[str, int, int]:
    """The main text, and how many subtrees with words were deleted as template and by rules."""
    if not html:
        return "", 0, 0
    root = parse(html)
    holders = containers(root) if rules else [root]
    return rendered(root, holders, Subtrees(root, holders, rules) if template else None, template, rules)


def rendered(root: Node, holders: list[Node], subtrees: Subtrees | None, template: frozenset[int], rules: bool) -> tuple[str, int, int]:
    blocks: list[str] = []
    line: list[str] = []
    by_template = by_rules = 0
    empty = lambda x: subtrees is not None and not subtrees.words[id(x)]

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            blocks.append(text)

    if holders[0] is not root:  # what stands outside of the articles goes, as template if it is one
        inner, way = {id(h) for h in holders}, set()
        for h in holders:
            while h is not None and id(h) not in way:
                way.add(id(h))
                h = h.up
        stack = [root]
        while stack:
            x = stack.pop()
            if id(x) in inner or x.tag in MARKUP or empty(x):
                continue
            if id(x) in way:
                stack += [p for p in x.parts if type(p) is Node]
            elif subtrees is not None and subtrees.template(x, template):
                by_template += 1
            else:
                by_rules += 1
    for holder in holders:
        whole = holder is root
        stack: list = [holder]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif type(x) is str:
                line.append(x)
            elif x is not holder and ((was := subtrees is not None and subtrees.template(x, template)) or (x.junk(not whole) if rules else x.tag in MARKUP)):
                if x.tag not in MARKUP and not empty(x):
                    by_template, by_rules = by_template + was, by_rules + (not was)
                if x.tag in BLOCK:
                    flush()
                else:
                    line.append(" ")
            elif x.tag == "br":
                line.append(" ")
            else:
                if x.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack += reversed(x.parts)
        flush()
    return "\n".join(blocks), by_template, by_rules


def host_of(url: Column) -> Column:
    """The host in lower case; an address without one is its own host."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")), url, F.lit(""))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, rules: bool = True) -> DataFrame:
    """For each row: id, url, the main text, and the numbers of subtrees deleted as template and by rules.

    Without rules, tags, roles and classes say nothing (but for markup) and the template alone decides.
    """
    source = pages.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), key_of(id_col).alias("key"), F.xxhash64(text_of(html_col), F.col(f"`{url_col}`")).alias("mark"), F.xxhash64(host_of(F.col(f"`{url_col}`").cast("string"))).alias("host"), text_of(html_col).alias("html")
    )
    once = struct(("key", "long"), ("mark", "long"), ("host", "long"), ("main", "long"), ("total", "int"), ("hash", "array<long>"), ("info", "array<int>"))
    # info: words of the subtree * 4 + kind

    def run(batches):
        for batch in batches:
            found = [template_hashes(h, rules) for h in batch.column(3).to_pylist()]
            columns = {n: batch.column(i) for i, n in enumerate(("key", "mark", "host"))} | {"main": [m for m, _, _ in found], "total": [t for _, t, _ in found]}
            yield batch_of(columns | {"hash": [[h for h, _, _ in own] for _, _, own in found], "info": [[n << 2 | kind for _, kind, n in own] for _, _, own in found]}, once)

    found = cut(source.select("key", "mark", "host", "html").mapInArrow(run, once))
    each = found.select("host", "main", "total", F.explode(F.arrays_zip("hash", "info")).alias("x")).groupBy("host", F.col("x.hash").alias("hash"), "main").agg(F.max("x.info").alias("info"), F.max("total").alias("total"))
    each = each.select("host", "hash", F.col("info").bitwiseAND(3).alias("kind"), F.shiftright("info", 2).alias("words"), "total")
    counts = each.groupBy("host", "hash", "kind").agg(F.count("*").alias("pages"), F.sum("words").alias("words"), F.sum("total").alias("total")).where(F.col("pages") >= min_pages)
    sizes = found.select(F.col("host").alias("of"), "main").distinct().groupBy("of").agg(F.count("*").alias("all"))
    kind, share = F.col("kind"), F.col("words") / F.col("total")
    recurring = counts.join(sizes, F.col("host") == F.col("of")).where(
        (F.col("pages") >= F.col("all") * F.when(kind == BARE, min_share).otherwise(max(FRAME_SHARE, min_share))) & (share <= F.when(kind == FRAME, FRAME_WORDS).otherwise(0.5))
    )
    templates = recurring.groupBy("host").agg(F.collect_set("hash").alias("template"))
    known = salted_join(found.select("key", "mark", "host", "hash"), templates, "host", SALTS, merge=True)
    own = known.select("key", "mark", F.array_intersect("hash", "template").alias("template")).where(F.size("template") > 0)
    own = own.groupBy("key", "mark").agg(F.first("template").alias("template"))  # of repeated rows one; dealt as the join below wants it
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    schema = struct((id_col, kinds[0]), (url_col, kinds[1]), ("text", "string"), ("n_template", "long"), ("n_ruled", "long"))

    def final(batches):
        for batch in batches:
            out = [extracted(h, frozenset(t or ()), rules) for h, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch_of({id_col: batch.column(0), url_col: batch.column(1), "text": [t for t, _, _ in out], "n_template": [n for _, n, _ in out], "n_ruled": [n for _, _, n in out]}, schema)

    return source.join(own, ["key", "mark"], "left").select("id", "url", "html", "template").mapInArrow(final, schema)
