"""HTML extraction: site templates found by subtree hashes counted per host, then main text."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, tune

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/<>]*)[^<>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ROLE = re.compile(r"\brole\s*=\s*[\"']?main\b")

# Element names by their role in HTML, and names that sites give to page furniture.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("html body div article section main aside nav header footer table ul ol dl td th form blockquote button".split())
_DROPPED = frozenset(
    "head script style noscript template nav footer aside form button input select option textarea iframe svg canvas object embed video audio map menu dialog title noembed noframes".split()
)
_UNCOUNTED = _INLINE | _DROPPED | {"#root", "html", "body", "br", "hr", "img"}  # no templates of their own
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist".split())
_FURNITURE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside widget ad ads adv advert adverts advertisement advertisements adsense banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations "
    "comment comments disqus replies reply respond search searchform login pagination pager skip copyright disclaimer paywall".split()
)
_HEADERS = frozenset(["header", "topbar"])
# Elements that group others, and words that a site adds to the name of a group.
_GROUPS = frozenset("article div section ul ol dl table details figure center".split())
_GROUP_WORDS = frozenset("area bar block blocks box buttons container form group icons items links list panel section slot thread tools unit widget wrap wrapper".split())
_PLACES = frozenset("bottom desktop entry global inner left lower main mobile outer page post primary reader right secondary site top upper user".split())
#: Pages on which a subtree may recur by chance or copying before it counts as recurring.
CHANCE = 2


class Page:
    """Elements of a page in document order: a parent always comes before its children."""

    def __init__(self, source: str):
        self.tag, self.attributes, self.parent = ["#root"], [""], [-1]
        self.items: list[list[str | int]] = [[]]
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, opened = [0], Counter()
        at, size = 0, len(source)

        def close_to(tags: set | frozenset, scope: frozenset) -> None:
            if not any(opened[t] for t in tags):
                return
            for k in range(len(stack) - 1, 0, -1):
                name = self.tag[stack[k]]
                if name in tags:
                    for node in stack[k:]:
                        opened[self.tag[node]] -= 1
                    del stack[k:]
                    return
                if name in scope:
                    return

        while at < size:
            m = _TOKEN.search(source, at)
            if m is None or m.start() > at:
                self.items[stack[-1]].append(source[at : m.start() if m else size])
                if m is None:
                    break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                close_to({name}, frozenset())
                continue
            if name in _CLOSES_P:
                close_to({"p"}, _SCOPE)
            if name in _SAME:
                close_to(_SAME[name], _SCOPE - _SAME[name] - {"td", "th"} if name == "tr" else _SCOPE - _SAME[name])
            node = len(self.tag)
            self.tag.append(name)
            self.attributes.append(m[3] or "")
            self.parent.append(stack[-1])
            self.items[stack[-1]].append(node)
            self.items.append([])
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
                at = end.start() if end else size
                close = source.find(">", at)
                at = close + 1 if end and close >= 0 else size
            elif name not in _VOID and not (m[3] or "").endswith("/"):
                stack.append(node)
                opened[name] += 1

    def hashes(self) -> list[int]:
        """A hash per element of its name and content, from the innermost out."""
        return self.digests()[0]

    def digests(self) -> tuple[list[int], list[int]]:
        """hashes(), and per element the sum of the hashes of all texts in it."""
        out, sums = [0] * len(self.tag), [0] * len(self.tag)
        for i in range(len(self.tag) - 1, -1, -1):
            h = xxhash.xxh64(self.tag[i])
            for x in self.items[i]:
                if isinstance(x, int):
                    h.update(out[x].to_bytes(8, "little"))
                    sums[i] += sums[x]
                elif words := x.split():
                    h.update(text := " ".join(words))
                    sums[i] += xxhash.xxh64_intdigest(text)
            out[i] = h.intdigest()
        return out, sums

    def _hidden(self, i: int) -> bool:
        """Whether an element's role or style says that it is no main text."""
        for m in _ATTRIBUTE.finditer(self.attributes[i]):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                return True
            if key == "role" and value.lower() in _DROPPED_ROLES:
                return True
        return False

    def _names(self, i: int) -> Iterator[str]:
        """Class and id names of an element."""
        for m in _ATTRIBUTE.finditer(self.attributes[i]):
            if m[1].lower() in ("class", "id"):
                yield from (m[2] or m[3] or m[4] or "").split()

    def _named(self, i: int) -> bool:
        """Whether a group bears a furniture name as a whole: ad, user-comments, share-buttons; not share-price."""
        for name in self._names(i):
            words = [w.lower() for w in _WORDS.findall(name)]
            own = [w for w in words if w not in _PLACES]
            if own and own[0] in _FURNITURE and all(w in _FURNITURE | _GROUP_WORDS for w in own[1:]):
                return True
        return False

    def wrapping_forms(self) -> set[int]:
        """Forms that hold the main text: an article or main element or, where the page has none, most of its text."""
        if "form" not in self.tag:
            return set()
        n = len(self.tag)
        holds, weight = [t in ("article", "main") for t in self.tag], [0] * n
        for i in range(n - 1, -1, -1):
            if self.tag[i] in _DROPPED and self.tag[i] != "form":
                continue
            weight[i] += sum(len(x.strip()) for x in self.items[i] if isinstance(x, str))
            if i:
                weight[self.parent[i]] += weight[i]
                holds[self.parent[i]] |= holds[i]
        return {i for i, t in enumerate(self.tag) if t == "form" and (holds[i] or (not holds[0] and 2 * weight[i] > weight[0]))}

    def _furniture(self, i: int, inside: bool) -> bool:
        """Whether an element is no main text by itself.

        Inside an article or main element only roles, styles and groups with a furniture name
        prove it; outside, a furniture word in a class or id does.
        """
        tag = self.tag[i]
        if tag in _DROPPED or (tag == "header" and not inside):
            return True
        if not self.attributes[i] or tag in ("html", "body"):
            return False
        if self._hidden(i):
            return True
        if inside or tag in ("main", "article"):
            return tag in _GROUPS and self._named(i)
        words = {w.lower() for name in self._names(i) for w in _WORDS.findall(name)}
        return bool(words & _FURNITURE or words & _HEADERS)

    def text(self, template: dict[int, float], outside: float, within: float) -> str:
        """Main text. ``template`` has the share of the host's pages that hold a subtree."""
        n = len(self.tag)
        named = [t == "article" and self._furniture(i, True) for i, t in enumerate(self.tag)]
        some = any(t == "article" and not named[i] for i, t in enumerate(self.tag))
        aside = [False] * n  # in an article that its name sets apart from another one
        for i in range(1, n):
            aside[i] = aside[self.parent[i]] or (named[i] and some)
        holds = [t in ("article", "main") and not a for t, a in zip(self.tag, aside)]  # elements that hold the main text
        bears = [h or (t == "h1" and not a) for h, t, a in zip(holds, self.tag, aside)]
        for i in range(n - 1, 0, -1):
            bears[self.parent[i]] |= bears[i]
            holds[self.parent[i]] |= holds[i]
        gone, inside, forms = [False] * n, [False] * n, self.wrapping_forms()
        for i in range(1, n):
            up = self.parent[i]
            inside[i] = inside[up] or self.tag[up] in ("article", "main")
            gone[i] = gone[up] or (i not in forms and self._furniture(i, inside[i]) and (not bears[i] or self.tag[i] in _DROPPED))
        regions = [i for i in range(1, n) if self.tag[i] == "article" and not gone[i]] or [
            i for i in range(1, n) if not gone[i] and (self.tag[i] == "main" or _ROLE.search(self.attributes[i]))
        ]
        whole = not regions
        chosen = set(regions) or {0}
        if template:
            own = self.hashes()
            for i in range(1, n):
                share = template.get(own[i], 0.0) if self.tag[i] not in _UNCOUNTED else 0.0
                gone[i] = gone[i] or gone[self.parent[i]] or (share >= (outside if whole else within) and not holds[i])  # a heading that recurs is the site's
        out: list[str] = []
        stack: list[tuple[str | int, bool]] = [(0, False)]
        while stack:
            x, taken = stack.pop()
            if isinstance(x, str):
                if taken:
                    out.append(x)
                continue
            if gone[x]:
                out.append(" " if self.tag[x] not in _INLINE else "")
                continue
            taken = taken or x in chosen
            edge = "" if self.tag[x] in _INLINE else " "
            if edge and taken:
                out.append(" ")
                stack.append((" ", True))
            stack.extend((y, taken) for y in reversed(self.items[x]))
        return " ".join(html.unescape("".join(out)).split())


def host_of(url):
    """Lower-case host of a URL column; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _signed(h: int) -> int:
    h &= 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >= 1 << 63 else h


def subtrees(pages: DataFrame) -> DataFrame:
    """Subtrees of block elements of each page: (host, print, hash, rest).

    ``rest`` names the page's text without the subtree; the row with hash 0 names all of it.
    Subtrees of elements that never are main text (menus, forms, ...) go with these.
    """

    def list_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, name, source in zip(*(batch.column(c).to_pylist() for c in ("host", "print", "html"))):
                page = Page(source or "")
                hashes, sums = page.digests()
                forms = page.wrapping_forms()
                out_of = [t in _DROPPED and i not in forms for i, t in enumerate(page.tag)]
                for i in range(1, len(out_of)):
                    out_of[i] |= out_of[page.parent[i]]
                held = {h: s for h, s, t, o in zip(hashes, sums, page.tag, out_of) if not o and t not in _UNCOUNTED} | {0: 0}
                out += [(host, name, _signed(h), _signed(sums[0] - s)) for h, s in held.items()]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["host", "print", "hash", "rest"])

    return pages.select("host", "print", "html").mapInArrow(list_all, "host string, print long, hash long, rest long")


def template_shares(held: DataFrame, share: float) -> DataFrame:
    """Subtrees (host, hash, share) on ``share`` of a host's pages or more.

    Pages are told apart by their text without the subtree, so copies of a page count once; of
    the pages that hold a subtree, CHANCE count for nothing on hosts of every size.
    """
    counts = held.select("host", "hash", "rest").distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    totals = counts.where("hash = 0").select("host", F.col("n").alias("pages"))
    shares = counts.where("hash <> 0").join(totals, "host").select("host", "hash", ((F.col("n") - CHANCE) / F.greatest("n", "pages")).alias("share"))
    return shares.where(F.col("share") >= share)


def extract_text(pages: DataFrame, *, outside: float = 0.3, within: float = 0.6) -> DataFrame:
    """Main text of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Pass one hashes every block element's subtree; pages that hold it are counted per host by
    their remaining text. A subtree is site template if it is on a share of ``outside`` of the
    host's pages, or of ``within`` where the page has an article or main element. Templates are
    joined to the subtrees of pages by host and hash, so no row holds a host's templates. Pass
    two drops template subtrees and page furniture, and joins what is left of the article: inside
    it, elements are furniture by their role, style or name as a group, never by a word in a name.
    A form is furniture unless it holds the main text. A recurring heading goes with its subtree.

    Null or empty html gives an empty text, an empty table no rows. A null url, or one without
    a host, has no template removal. Repeated rows are rows of their own and count as one page.
    A share equal to the bound is template. Very long pages take memory in proportion to their
    length. Extra columns are ignored.
    """
    spark = tune(pages.sparkSession)
    scratch = Scratch(spark, "html")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of("url").alias("host"), F.xxhash64("html").alias("print"))
    held = scratch.save(subtrees(pages.where("host IS NOT NULL")))
    templates = scratch.save(template_shares(held, min(outside, within)))
    known = scratch.save(  # so that Spark knows its size, and moves no html where it is small
        held.select("host", "print", "hash").distinct().join(templates, ["host", "hash"])
        .groupBy("host", "print").agg(F.collect_list(F.struct("hash", "share")).alias("template"))
    )  # a list holds the templates of one page
    scratch.drop(held, templates)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist()):
                shares = {t["hash"] & 0xFFFFFFFFFFFFFFFF: t["share"] for t in template or ()}
                texts.append(Page(source).text(shares, outside, within) if source else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    joined = pages.join(known, ["host", "print"], "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
