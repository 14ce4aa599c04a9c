"""Main text of pages by consensus container paths of their host.

Each page's containers are scored by the text that lies in them, links and
boilerplate counting against them; a container is known by its generalised path
of tags and classes (digits made alike), as a digest chained from the outermost
container on. Every page votes for the path of its best container; votes are
counted by host in Spark, and a host's winners are the paths with at least
``SHARE`` of its votes. Every page is then extracted by the best winner that it
has, or by its own best container where it has none of them. An inner box with
most of an article beats the box around the whole, so a page climbs from its
container to those around it while these add little-linked text (or headings
directly in them, linked or not); to the body only while what it adds lies
directly in it, as other boxes there are other things.

Dropped everywhere: scripts, styles, comments, templates, forms, menus,
headers, footers, sidebars, notices, adverts and reader comments, known by tag,
role or the words of a class or id. Names don't overrule the text: an element
that is boilerplate by name only, but has all of the page's articles, main
elements and first headings and half of its text, is a box around the article
(on a page without any of these three it takes three quarters of the text, and
not to be named as an advert or comments). A block is the text between
boundaries of block-level tags; its white space is turned into one space and
trimmed, character references are decoded, and blocks are joined by one
newline. Nothing else is dropped.

Pages are read in one forward pass, so time and memory grow with a page's
length whatever its markup. A quoted attribute without its closing quote ends
where its tag does; a tag that never ends is dropped.

Defined results: null or empty html has no text (an empty string, 0
characters); text without any container is taken as it is; a null URL or one
without host votes under an empty host; repeated pages vote each and come out
each; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, materialise
from .url_filter import host_and_path

#: Least share of a host's votes that makes a path a winner; a host has 1 / SHARE winners at most.
SHARE = 0.05
#: A container above another one counts its text so many times for each level between.
FADE = 0.9
SEMANTIC = 1.2
#: Share of links in what a page may climb for.
LINKED = 0.5

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt html legend li summary tbody td tfoot th thead tr".split())
CONTAINER = frozenset("article div main section td center".split())
SEMANTIC_TAGS = frozenset("article main".split())
DROPPED = frozenset(
    "head script style title noscript template nav header footer aside form iframe textarea select button input svg canvas object dialog menu search audio video noembed noframes xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
ALIKE = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert dialog alertdialog".split())
#: Words of class names and ids that mark what isn't the article, whatever stands beside them.
JUNK = frozenset(
    "ads advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar widget widgets masthead topbar footer cookie cookies consent gdpr newsletter subscribe popup disqus commentlist pager pagination login signup".split()
)
ADS_AND_COMMENTS = frozenset("ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo comment comments commentlist disqus reply replies respond".split())
#: Words that mark it where the name has no other words but these and FILLER.
WEAK_JUNK = frozenset(
    "ad adv promotion side aside header foot head notice notices notification alert modal overlay subscription share sharing social related recommended recommendations "
    "comment comments respond reply replies skip".split()
)
FILLER = frozenset(
    "area bar block bottom box button buttons by container content entry footer form global icon icons inner inline item items left line link links list main media mid middle module news "
    "note page panel post posts primary reader readers right row secondary section site slot stories story tag teaser text title tools top unit user users wrap wrapper".split()
)

SAYS_OF = frozenset("has with without no is not".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTR = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*+)))?")
TAG_END = re.compile(r"[\s/]*+>")
WORDS_OF_NAME = re.compile(r"[a-z]+")
DIGITS = re.compile(r"[0-9]+")
HINTS = frozenset("article main h1".split())


def _attrs(html: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes from here to the end of the tag, and where it ends (-1: never)."""
    out: dict[str, str] = {}
    while True:
        if m := TAG_END.match(html, at):
            return out, m.end()
        m = ATTR.match(html, at)
        if m is None:
            return out, -1
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name not in out:
            out[name] = entities.unescape(value) if "&" in value else value
        at = m.end()


def _is_junk(tag: str, attrs: dict[str, str]) -> bool:
    """By tag or role."""
    return tag in DROPPED or (bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in JUNK_ROLES))


def _named_junk(tag: str, attrs: dict[str, str]) -> set[str]:
    """The words by which the classes or the id mark an element as boilerplate."""
    found: set[str] = set()
    if tag in ("html", "body", "main") or not ("class" in attrs or "id" in attrs):
        return found
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = WORDS_OF_NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        # names that say what an element has or lacks (has-sidebar) don't count
        if words and words[0] not in SAYS_OF:
            found.update(w for w in words if w in JUNK)
            if all(w in JUNK or w in WEAK_JUNK or w in FILLER for w in words):
                found.update(w for w in words if w in WEAK_JUNK)
    return found & ADS_AND_COMMENTS if tag == "article" else found


def _step(tag: str, attrs: dict[str, str]) -> str:
    """A tag with its classes, digits made alike."""
    names = sorted({DIGITS.sub("#", c) for c in attrs.get("class", "").lower().split()})
    return ".".join([tag, *names])


def path_digest(*steps: str) -> bytes:
    """The digest of a path below the body."""
    out = BODY_PATH
    for step in steps:
        out = blake2b(step.encode("utf-8", "surrogatepass"), digest_size=16, key=out).digest()
    return out


BODY_PATH = blake2b(b"body", digest_size=16).digest()


class Page:
    """Blocks of a page in order and the tree of containers that they lie in."""

    def __init__(self, html: str):
        # containers: parent, path digest, whether article or main; 0 is the body, which is there even if its tag isn't
        self.parent, self.path, self.semantic = [-1], [BODY_PATH], [False]
        # elements that are boilerplate by name: parent, whether an advert or comments, characters of text, hints
        self.region_up: list[int] = []
        self.region_strict: list[bool] = []
        self.blocks: list[tuple[str, int, int, int, bool, bool]] = []  # text, characters in links, container, region, boilerplate for sure, heading
        self._hints: list[int] = []  # regions (or -1) of the articles, main elements and first headings
        self._text: list[str] = []
        self._linked = 0
        # open elements: tag, and what held outside of them (container, region, boilerplate, dropped text, links, headings, the nearest block)
        self._stack: list[tuple] = []
        self._where: dict[str, list[int]] = defaultdict(list)
        self._now = (0, -1, False, False, 0, 0, -1)
        self._read(html)
        self._flush()
        self._judge()

    def _read(self, html: str) -> None:
        at = 0
        while (to := html.find("<", at)) >= 0:
            if to > at:
                self._say(html[at:to])
            at = to + 1
            if m := NAME.match(html, at):
                attrs, at = _attrs(html, m.end())
                if at < 0:
                    return
                tag = m[0].lower()
                self._start(tag, attrs)
                if tag in RAW:
                    done = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>", re.I).search(html, at)
                    at = done.end() if done else len(html)
                    self._end(tag)
                continue
            if html.startswith("!--", at):
                end, skip = html.find("-->", at + 3), 3
            elif html.startswith("![CDATA[", at):
                end, skip = html.find("]]>", at + 8), 3
                self._say(html[at + 8 : end if end >= 0 else len(html)], raw=True)
            elif html.startswith(("!", "?", "/"), at):
                end, skip = html.find(">", at), 1
                if m := NAME.match(html, at + 1) if html[at] == "/" else None:
                    if end >= 0:
                        self._end(m[0].lower())
            else:
                self._say("<")
                continue
            if end < 0:
                return
            at = end + skip
        self._say(html[at:])

    def _say(self, text: str, raw: bool = False) -> None:
        _, _, _, mute, links, _, _ = self._now
        if mute or not text:
            return
        if "&" in text and not raw:
            text = entities.unescape(text)
        self._text.append(text)
        if links:
            self._linked += len(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                container, region, junk, _, _, headings, _ = self._now
                self.blocks.append((text, min(self._linked, len(text)), container, region, junk, headings > 0))
            self._text, self._linked = [], 0

    def _pop_to(self, k: int) -> None:
        while len(self._stack) > k:
            tag, self._now = self._stack.pop()
            self._where[tag].pop()

    def _innermost(self, tags: tuple[str, ...]) -> int:
        return max((self._where[t][-1] for t in tags if self._where[t]), default=-1)

    def _close(self, tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        """Closes the innermost of these elements if it is open within the nearest of the stops."""
        k = self._innermost(tags)
        if k >= 0 and k > self._innermost(tuple(s for s in stops if s not in tags)):
            self._pop_to(k)

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        block = tag in BLOCK
        if block:
            self._flush()
            if tag in CLOSES_P:
                self._close(("p",), ("button", "table", "td", "th", "article", "section", "div"))
            if tag in SIBLINGS:
                self._close(ALIKE.get(tag, (tag,)), SIBLINGS[tag])
            if tag == "body":
                self._close(("head",), ())
        if tag in VOID:
            return
        before = container, region, junk, mute, links, headings, inner = self._now
        if not (junk or mute):
            own = _is_junk(tag, attrs)
            named = frozenset() if own else _named_junk(tag, attrs)
            if not block:
                mute = own or bool(named)
            elif own:
                junk = True
            elif named:
                self.region_up.append(region)
                self.region_strict.append(bool(named & ADS_AND_COMMENTS))
                region = len(self.region_up) - 1
            if not junk and not named and tag in HINTS:
                self._hints.append(region)
            if not junk and tag in CONTAINER:
                self.parent.append(container)
                self.path.append(blake2b(_step(tag, attrs).encode("utf-8", "surrogatepass"), digest_size=16, key=self.path[container]).digest())
                self.semantic.append(tag in SEMANTIC_TAGS)
                container = len(self.parent) - 1
        self._where[tag].append(len(self._stack))
        self._stack.append((tag, before))
        self._now = (container, region, junk, mute, links + (tag == "a"), headings + (tag in HEADINGS), len(self._stack) - 1 if block else inner)

    def _end(self, tag: str) -> None:
        block = tag in BLOCK
        if block:
            self._flush()
        if self._where[tag]:
            k = self._where[tag][-1]
            if block or k > self._now[6]:
                self._pop_to(k)

    def _judge(self) -> None:
        """Which blocks are boilerplate, once the whole page is known."""
        n = len(self.region_up)
        size, hints, total = [0] * n, [0] * n, 0
        strict = [False] * n  # within an advert or comments
        for r in range(n):
            strict[r] = self.region_strict[r] or (self.region_up[r] >= 0 and strict[self.region_up[r]])
        told = [r for r in self._hints if r < 0 or not strict[r]] or self._hints
        for text, _, _, region, junk, _ in self.blocks:
            if not junk:
                total += len(text)
                if region >= 0:
                    size[region] += len(text)
        for region in told:
            if region >= 0:
                hints[region] += 1
        for r in range(n - 1, -1, -1):
            if self.region_up[r] >= 0:
                size[self.region_up[r]] += size[r]
                hints[self.region_up[r]] += hints[r]
        held = []
        for r in range(n):
            if told:
                around = hints[r] == len(told) and 2 * size[r] >= total
            else:
                around = not self.region_strict[r] and 4 * size[r] >= 3 * total
            held.append(around and size[r] > 0 and (self.region_up[r] < 0 or held[self.region_up[r]]))
        self.junk = [junk or (region >= 0 and not held[region]) for _, _, _, region, junk, _ in self.blocks]

    def scores(self) -> dict[bytes, float]:
        """Path of a container -> the text that speaks for it."""
        n = len(self.parent)
        good, bad = [0.0] * n, [0] * n
        for (text, linked, c, _, _, _), junk in zip(self.blocks, self.junk, strict=True):
            if junk:
                bad[c] += len(text)
            else:
                good[c] += len(text) - linked
        for c in range(n - 1, 0, -1):
            good[self.parent[c]] += FADE * good[c]
            bad[self.parent[c]] += bad[c]
        out: dict[bytes, float] = defaultdict(float)
        for c in range(n):
            if good[c] or bad[c]:
                out[self.path[c]] += good[c] * (SEMANTIC if self.semantic[c] else 1) - bad[c]
        return out

    def best(self) -> bytes | None:
        """The best path of a container with text, if there is text."""
        have = self._have()
        scores = self.scores()
        return max(sorted(have), key=lambda p: scores.get(p, 0.0)) if have else None

    def _have(self) -> set[bytes]:
        """Paths of the containers that hold text of the article."""
        holds = [False] * len(self.parent)
        for (_, _, c, _, _, _), junk in zip(self.blocks, self.junk, strict=True):
            if not junk:
                holds[c] = True
        for c in range(len(holds) - 1, 0, -1):
            if holds[c]:
                holds[self.parent[c]] = True
        return {p for p, h in zip(self.path, holds, strict=True) if h}

    def climbed(self, path: bytes) -> bytes:
        """The outermost container around this one that only adds text of the article."""
        n = len(self.parent)
        inside = [False] * n
        for c in range(n):
            inside[c] = self.path[c] == path or (c > 0 and inside[self.parent[c]])
        first = next((b[2] for b, junk in zip(self.blocks, self.junk, strict=True) if not junk and inside[b[2]]), None)
        if first is None:
            return path
        while self.path[first] != path or (first and inside[self.parent[first]]):
            first = self.parent[first]
        chain = [first]
        while self.parent[chain[-1]] >= 0:
            chain.append(self.parent[chain[-1]])
        chain.reverse()
        place = {c: k for k, c in enumerate(chain)}
        depth = [0] * n  # of the innermost of the chain around each container
        for c in range(n):
            depth[c] = place.get(c, depth[self.parent[c]] if c else 0)
        added: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])  # by depth: characters, those in links, blocks in other boxes
        for (text, linked, c, _, _, heading), junk in zip(self.blocks, self.junk, strict=True):
            if not junk and depth[c] < len(chain) - 1:
                sums, direct = added[depth[c]], c in place
                sums[0] += len(text)
                sums[1] += 0 if direct and heading else linked
                sums[2] += not direct
        top = len(chain) - 1
        for k in range(len(chain) - 2, -1, -1):
            size, linked, others = added.get(k, (0, 0, 0))
            if linked > LINKED * size or (k == 0 and others):
                break
            if size:
                top = k
        return self.path[chain[top]]

    def text(self, winners: list[bytes]) -> str:
        """Blocks within the first winner that the page has, else within its own best container."""
        have = self._have()
        path = next((w for w in winners if w in have), None) or self.best()
        inside = [False] * len(self.parent)
        if path is not None:
            path = self.climbed(path)
            for c in range(len(inside)):
                inside[c] = self.path[c] == path or (c > 0 and inside[self.parent[c]])
        return "\n".join(b[0] for b, junk in zip(self.blocks, self.junk, strict=True) if not junk and inside[b[2]])


def _decoded(value: bytes | None) -> str:
    return value.decode("utf-8", "replace") if value else ""


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best = [Page(_decoded(html.as_py())).best() for html in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(best, pa.binary())], ["host", "container"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(_decoded(html.as_py())).text(winners or []) for html, winners in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def host_paths(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """host, winners: the paths (digests) with their share of its votes, the best first."""
    host, _ = host_and_path(F.col("url"))
    votes = pages.select(host.alias("host"), F.col("html").cast("binary").alias("html")).mapInArrow(_votes, "host string, container binary")
    counted = scratch.table(votes.where("container is not null").groupBy("host", "container").agg(F.count(F.lit(1)).alias("votes")), "host-votes")
    every = scratch.table(counted.groupBy("host").agg(F.sum("votes").alias("every")), "host-totals")
    winners = counted.join(every, "host").where(F.col("votes") >= F.lit(SHARE) * F.col("every"))
    best = winners.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("votes", "container")), asc=False).alias("best"))  # 1 / SHARE at most
    return best.select("host", F.transform("best", lambda b: b["container"]).alias("winners"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    host, _ = host_and_path(F.col("url"))
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"), host.alias("host"))
    # the hosts' paths as a table of their own, so that a hot host's pages can be split among join tasks
    with Scratch(pages.sparkSession) as scratch:
        paths = materialise(host_paths(pages, scratch), "host-paths")
    joined = known.join(paths, "host", "left").select("page_id", "url", "html", "winners")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
