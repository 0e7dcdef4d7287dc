"""Main text of web pages by consensus host paths.

Every page's containers are scored by the text they hold; the best one's
generalised tag-class path is a vote.  Spark adds up the votes of each host, and
pages are extracted again with their host's winning paths, so that a page whose
own scores mislead (a short article, a long comment list) follows its siblings.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# Element names of HTML by their role here.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre tr caption figcaption summary hr ul ol dl table thead tbody tfoot blockquote figure address center details hgroup td th".split())
DROPPED = frozenset("nav header footer aside form button menu dialog fieldset".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar rail widget widgets footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus reply replies respond related recommended recommendations teaser teasers pagination pager toolbar copyright legal skip".split())
#: Words that make the name of a container speak of what it holds or lacks: no-sidebar, has_banner.
QUALIFIERS = frozenset("no non without with has have enabled disabled".split())
#: Of articles, only names that begin so are dropped: an article may well be called comments-open.
ASIDES = frozenset("comment reply teaser related recommended promo".split())
#: Words for what stands beside the main text however long it is; the other WORDS also name layouts.
BESIDE = ASIDES | frozenset("comments commentlist disqus replies respond recommendations teasers ad ads adv advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr newsletter".split())
#: Inside an article only whole names count, as related-work or share-price are its own.
KNOWN = frozenset("comment comments comment-list commentlist comments-list comments-area comment-section comments-section disqus disqus-thread replies respond related related-posts related-articles related-stories related-content related-links recommended recommendations recommended-posts recommended-articles ad ads advert adverts advertisement advertisements adsense ad-container ad-slot ad-banner ad-unit ad-box ad-wrapper sponsored sponsored-content promo promo-box share share-buttons share-bar share-links sharing social social-share social-links social-buttons newsletter newsletter-signup newsletter-form newsletter-box subscribe subscribe-box signup login cookie-notice cookie-banner cookie-consent cookies gdpr consent breadcrumb breadcrumbs nav navbar pagination pager post-nav post-navigation sidebar widget teaser teasers popup modal overlay notice toolbar post-footer entry-footer skip-link".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: An attribute as HTML reads it; a quote that is never closed is part of a name, so the tag ends at the next ">".
ONE = r"""[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+"""
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[|\]\]>|</>|<(?:[!?]|/[^A-Za-z>])[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?>[\s/]++|{ONE}|=)*+)>|</?[A-Za-z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))?+)?+""")
NAMING = re.compile("class|id|role", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")


def words_of(name: str) -> list[list[str]]:
    return [[p.lower() for p in PART.findall(one)] for one in name.split()]


def aside(tag: str, names: list[str]) -> str:
    """Whether a container's class or id says that it is no main text: BESIDE,
    LAYOUT (it may after all be what the main text is laid out in) or nothing."""
    found = ""
    for name in names:
        for parts in words_of(name):
            if tag in ("article", "main"):
                if parts and parts[0] in ASIDES:
                    return "beside"
            elif not QUALIFIERS.intersection(parts) and not WORDS.isdisjoint(parts):
                # a word of a longer name is no more than a hint: comment-free, share-story
                if "-".join(parts) in KNOWN and not BESIDE.isdisjoint(parts):
                    return "beside"
                found = "layout"
    return found


def aside_within(tag: str, names: list[tuple[str, str]]) -> str:
    """The same inside an article, by whole names; ids of its headings,
    paragraphs, lists and cells are its own."""
    return "beside" if any("-".join(parts) in KNOWN for name, v in names if name == "class" or tag not in TEXT for parts in words_of(v)) else ""


class Page:
    """Blocks of text with the containers they stand in.

    What is dropped by its tag is gone; of a header inside an article its headings
    stay, as they are the article's own.  A container that would be dropped by its
    name or role, or a form, stays if it holds an article or most of the page's
    unlinked text; if its name says that it stands beside the main text, only if
    it holds articles that are most of what the page has."""

    def __init__(self, html: str):
        #: container, text, characters inside links
        self.blocks: list[tuple[int, str, int]] = []
        #: of what may be dropped: what it lies in, its kind, whether it lies in an article, whether it holds one
        self.wraps: list[list] = [[-1, "", False, False]]
        self._decide(self._read(html))

    def within(self, container: int) -> bool:
        """Whether a container lies in an article or is one."""
        while container > 0 and self.tags[container] not in ("article", "main"):
            container = self.parents[container]
        return container > 0

    def _decide(self, read: list[tuple[int, str, int, int]]) -> None:
        """The blocks that aren't in anything dropped."""
        wraps = self.wraps
        size = len(wraps)
        if size == 1:
            self.blocks = [r[:3] for r in read]
            return
        hard, beside = [False] * size, [False] * size
        for w in range(1, size):
            up, kind = wraps[w][:2]
            hard[w] = hard[up] or kind == "hard"
            beside[w] = beside[up] or kind == "beside"
        held, total = [0] * size, 0
        for _, text, linked, w in read:
            if not beside[w] and not hard[w]:
                worth = max(0, len(text) - linked)
                total += worth
                while w > 0:
                    held[w] += worth
                    w = wraps[w][0]

        def kept(sure: bool):
            out = [False] * size
            for w in range(1, size):
                up, kind, inside, article = wraps[w]
                if kind == "layout":
                    gone = not article and (inside or 2 * held[w] <= total)
                else:
                    gone = kind == "hard" or not sure or not article
                out[w] = out[up] or gone
            return [r for r in read if not out[r[3]]]

        blocks = kept(False)
        if any(x[1] == "beside" and x[3] for x in wraps) and not any(self.within(c) for c, *_ in blocks):
            more = kept(True)
            own = lambda rows: sum(max(0, len(t) - n) for _, t, n, _ in rows)
            if own([r for r in more if self.within(r[0])]) > own(blocks):
                blocks = more
        self.blocks = [r[:3] for r in blocks]

    def _read(self, html: str) -> list[tuple[int, str, int, int]]:
        read: list[tuple[int, str, int, int]] = []  # container, text, characters inside links, wrap
        self.paths = [""]
        self.parents = [-1]
        self.tags = ["body"]
        stack: list[tuple[str, int, int]] = []  # tag, container, wrap
        heads = 0  # headers inside articles that are open
        inside = [False]  # of containers: in an article
        words: list[str] = []
        linked = 0
        anchors = 0
        at = 0
        container, wrap = 0, 0
        size = len(html)

        def block():
            nonlocal words, linked
            if words:
                text = SPACE.sub(" ", unescape("".join(words))).strip()
                if text and (not heads or any(t in HEADINGS for t, *_ in stack)):
                    read.append((container, text, linked, wrap))
                words, linked = [], 0

        while at < size:
            m = TOKEN.search(html, at)
            if m is None:
                words.append(html[at:])
                break
            if m.start() > at:
                words.append(html[at : m.start()])
                if anchors:
                    linked += m.start() - at
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    anchors = 0
                if tag in INLINE:
                    continue
                k = len(stack) - 1
                while k >= 0 and stack[k][0] != tag and not (tag == "header" and stack[k][0] == "own header"):
                    k -= 1
                block()
                if k >= 0:
                    heads -= sum(t == "own header" for t, *_ in stack[k:])
                    del stack[k:]
                    container, wrap = stack[-1][1:] if stack else (0, 0)
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                if tag != "head" or end is not None:  # an unclosed head is only a tag
                    at = end.end() if end else size
                continue
            if tag == "a":
                anchors = 1
            if tag in INLINE:
                if tag == "br":
                    words.append(" ")
                continue
            block()
            if tag in VOID or m[3].endswith("/") and tag not in TEXT:
                continue
            # a block ends an open paragraph, a list item the one before it
            if stack and stack[-1][0] == "p":
                stack.pop()
            elif tag in CLOSES:
                k = len(stack) - 1
                while k >= 0 and stack[k][0] in TEXT and stack[k][0] not in CLOSES[tag] and stack[k][0] not in ("ul", "ol", "dl", "table"):
                    k -= 1
                if k >= 0 and stack[k][0] in CLOSES[tag]:
                    del stack[k:]
            container, wrap = stack[-1][1:] if stack else (0, 0)
            if tag in ("html", "body"):
                continue
            names, role = [], ""
            if m[3] and NAMING.search(m[3]):
                for name, x, y, z in ATTRIBUTE.findall(m[3]):
                    name, value = name.lower(), unescape(x or y or z)
                    if name == "role":
                        role = value.strip().lower()
                    elif name in ("class", "id"):
                        names.append((name, value))
            if tag == "header" and inside[container]:
                heads += 1
                stack.append(("own header", container, wrap))
                continue
            kind = ""
            if self.wraps[wrap][1] != "hard":
                whole = "main" if role == "main" else tag
                if tag in DROPPED:
                    kind = "layout" if tag in ("form", "fieldset") else "hard"
                if kind != "hard" and names:
                    of = aside_within(tag, names) if inside[container] and whole not in ("article", "main") else aside(whole, [v for _, v in names])
                    kind = of or kind
                if not kind and whole not in ("article", "main") and role in ROLES:
                    kind = "layout"
                if whole in ("article", "main") and not kind:
                    w = wrap
                    while w > 0 and not self.wraps[w][3]:
                        self.wraps[w][3] = True
                        w = self.wraps[w][0]
                if kind:
                    self.wraps.append([wrap, kind, inside[container], False])
                    wrap = len(self.wraps) - 1
            if tag not in TEXT:
                kinds = sorted({DIGITS.sub("0", c) for name, v in names if name == "class" for c in v.split()})
                self.paths.append(self.paths[container] + "/" + ".".join([tag, *kinds]))
                self.parents.append(container)
                self.tags.append("main" if role == "main" else tag)
                inside.append(inside[container] or self.tags[-1] in ("article", "main"))
                container = len(self.paths) - 1
            stack.append((tag, container, wrap))
        block()
        return read

    def best(self) -> int:
        """The container that scores highest (ties to the outer, earlier one), or
        what it lies in while that adds mostly unlinked text; of an article, all."""
        score = [0.0] * len(self.paths)
        for container, text, linked in self.blocks:
            worth = max(0, len(text) - 2 * linked)
            while container >= 0:
                score[container] += worth
                worth *= 0.7
                container = self.parents[container]
        weight = {"article": 3.0, "main": 2.0}
        score = [s * weight.get(t, 1.0) for s, t in zip(score, self.tags)]
        return self._climb(max(range(len(score)), key=lambda k: (score[k], -k)))

    def _climb(self, at: int) -> int:
        own, links = [0] * len(self.paths), [0] * len(self.paths)
        for container, text, linked in self.blocks:
            own[container] += len(text)
            links[container] += min(linked, len(text))
        for k in range(len(own) - 1, 0, -1):
            own[self.parents[k]] += own[k]
            links[self.parents[k]] += links[k]
        k = at
        while k > 0 and self.tags[k] != "article":
            k = self.parents[k]
        if k > 0:
            return k
        k = at
        while k > 0 and self.tags[k] != "main":
            k = self.parents[k]
            added, linked = own[k] - own[at], links[k] - links[at]
            if added:
                if 2 * linked > added:
                    break
                at = k
        return at

    def text(self, path: str) -> str:
        """The blocks in containers of this path, in page order."""
        inside = []
        for k, p in enumerate(self.paths):
            inside.append(p == path or k > 0 and inside[self.parents[k]])
        return "\n".join(t for c, t, _ in self.blocks if inside[c])


def host_of(column):
    """The host of a URL in lower case; null and unreadable URLs share ''."""
    return F.coalesce(F.lower(F.regexp_extract(column, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _vote(batches):
    for b in batches:
        hosts, paths = [], []
        for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            page = Page(html or "")
            if page.blocks:
                hosts.append(host)
                paths.append(page.paths[page.best()])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], names=["host", "path"])


def _extract(batches):
    for b in batches:
        texts, used = [], []
        for html, paths in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            page = Page(html or "")
            path = next((p for p in paths or () if p in page.paths and page.text(p)), None)
            if path is None:
                path = page.paths[page.best()]
            used.append(path)
            texts.append(page.text(path))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(used, pa.string())], names=["page_id", "url", "text", "n_chars", "path"])


def extract_main_text(pages: DataFrame, share: float = 0.1, broadcast_bytes: int = 16_000_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, path: the main text of every row's whole html.

    A host's winning paths are those that got at least `share` of its votes (so
    at most 1 / share), most votes first; a page takes the first one it has text
    under, and its own best container if it has none of them.

    Null and empty html gives an empty text; null URLs share a host.  Null ids
    and repeated rows return a row each (and a vote each); other columns are left
    out.  Hosts may be skewed: votes are pre-aggregated; the winners are measured
    and broadcast up to broadcast_bytes, so that pages stay where they are read;
    beyond it Spark joins by host and splits hot ones.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    votes = rows.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_vote, "host string, path string")
    votes = votes.groupBy("host", "path").agg(F.count("*").alias("n"))
    totals = votes.groupBy("host").agg(F.sum("n").alias("total"))
    winners = votes.join(totals, "host").where(F.col("n") >= share * F.col("total"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))
    winners = winners.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))
    winners = written(winners, "winners")
    size = winners.agg(F.sum(F.octet_length("host") + F.aggregate("paths", F.lit(0), lambda n, p: n + F.octet_length(p)) + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        winners = F.broadcast(winners)
    found = rows.withColumn("host", host_of(F.col("url"))).join(winners, "host", "left").select("page_id", "url", "html", "paths")
    return found.mapInArrow(_extract, "page_id long, url string, text string, n_chars long, path string")
