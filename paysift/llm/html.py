"""Main text of web pages by container paths on which the pages of a host agree."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.llm.common import write_table

#: A broadcast table of host paths has at most so many bytes; a larger one is joined.
BROADCAST_BYTES = 32 << 20
#: A path this long goes on from a hash of what came before, so deep pages take no quadratic space.
_LONG_PATH = 400
#: So many characters a form field are little text.
_FIELD_TEXT = 200
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template noscript svg iframe object canvas textarea title select annotation annotation-xml".split())
#: Elements that start and end a block of text; all others, unknown ones too, are part of the line they stand in.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li listing main menu nav noframes ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
_FIELDS = frozenset("input textarea select button".split())
_CONTAINERS = frozenset("body main article section div td".split())
_DROPPED = frozenset("nav aside footer form button menu dialog head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_SAFE = frozenset("html body main article".split())
_WHOLE = frozenset("main article".split())
#: Words of class and id names that mark menus, adverts, notices, side matter and reader comments.
_MARKS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "sidebar comment comments reply replies respond disqus notice notices cookie cookies consent gdpr "
    "newsletter subscribe subscription signup login paywall popup modal overlay alert footer masthead toolbar".split()
)
#: Words of place and layout: a name of these and marking words alone marks an element as the marking word does.
_LAYOUT = frozenset(
    "list lists item items box boxes block blocks wrap wrapper container content inner outer body area section panel row col column left right top bottom center main primary "
    "secondary header title head foot group set unit slot holder placeholder bar strip link links button buttons btn icon icons form field thread text message desktop mobile fixed "
    "sticky small large post posts article articles entry page site user users reader readers blog story count meta info".split()
)
#: Words that mark link lists, which an article may also have as names of its own parts.
_LISTS = frozenset("widget related recommended share sharing social".split())
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_TAG_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*>""")
_SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
_HOST = re.compile(r"^\s*[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}


@dataclass(slots=True)
class _Node:
    """An element; what it takes from those around it is kept with it, so nothing walks up to the root."""

    tag: str
    parent: int
    step: str
    dropped: bool  # never text of the article: a tag, role or style says so
    mark: int  # 0 none, 1 a marking word in a longer name, 2 a marking name, 3 a name of link lists
    link: bool  # in a link
    aside: bool  # in an element with a mark
    depth: int  # in the stack of open elements
    container: int  # nearest container, itself included; 0 if none
    outside: int  # the nearest container around that one
    block: int  # nearest element that is not inline, itself included
    near: int  # nearest article or main, itself included; 0 if none
    top: int  # outermost article or main


@dataclass(slots=True)
class Page:
    nodes: list[_Node] = field(default_factory=lambda: [_Node("", -1, "", False, 0, False, False, 0, 0, 0, 0, 0, 0)])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, characters in links
    fields: list[int] = field(default_factory=list)  # the elements around form fields
    known: dict[int, str] = field(default_factory=dict)

    def add(self, tag: str, attributes: dict[str, str], parent: int, depth: int) -> int:
        at, above = len(self.nodes), self.nodes[parent]
        mark = _mark(tag, attributes)
        holds, whole = tag in _CONTAINERS, tag in _WHOLE
        self.nodes.append(_Node(
            tag, parent, _step(tag, attributes.get("class", "").split()), above.dropped or _boilerplate(tag, attributes, above.near > 0), mark, above.link or tag == "a", above.aside or mark > 1, depth,
            at if holds else above.container, above.container if holds else above.outside, at if tag in _BLOCK else above.block, at if whole else above.near, above.top or (at if whole else 0),
        ))
        return at

    def path(self, node: int) -> str:
        """The generalised steps from the root."""
        chain = []
        while node > 0 and node not in self.known:
            chain.append(node)
            node = self.nodes[node].parent
        for n in reversed(chain):
            before = self.known.get(self.nodes[n].parent, "")
            if len(before) > _LONG_PATH:
                before = f"~{xxhash.xxh3_64_hexdigest(before)}"
            self.known[n] = f"{before}>{self.nodes[n].step}" if before else self.nodes[n].step
            node = n
        return self.known.get(node, "")

    def scores(self) -> dict[int, float]:
        """Characters outside links in a container's own blocks, and half of those one container below. Marked elements count
        only if what is outside them is less than a tenth of their text."""
        found: dict[int, float] = {}
        plain = [b for b in self.blocks if not self.nodes[b[0]].aside]
        if 11 * sum(len(b[1]) for b in plain) < sum(len(b[1]) for b in self.blocks):
            plain = self.blocks
        for node, text, linked in plain:
            share = float(max(0, len(text) - linked))
            inner, outer = self.nodes[node].container, self.nodes[node].outside
            if inner:
                found[inner] = found.get(inner, 0.0) + share
            if outer:
                found[outer] = found.get(outer, 0.0) + share / 2
        return found

    def votes(self) -> list[tuple[str, float]]:
        """Paths of the containers that score at least half the best, with their shares of one vote."""
        scored = self.scores()
        best = max(scored.values(), default=0.0)
        strong: dict[str, float] = {}
        for node, s in scored.items():
            if best > 0 and s >= best / 2:
                path = self.path(node)
                strong[path] = max(strong.get(path, 0.0), s)
        total = sum(strong.values())
        return [(p, s / total) for p, s in strong.items()]

    def around(self, inside: set[int]) -> int:
        """The innermost element that holds all of inside: that of the first and the last in page order."""
        first, last = min(inside), max(inside)
        while last > first:
            last = self.nodes[last].parent
            if last < first:
                first, last = last, first
        return first

    def widened(self, chosen: set[int], voted: set[int]) -> set[int]:
        """Chosen containers as whole articles: each as its nearest article or main, with what the page votes for in the
        same one. Without any, the innermost element around them and what the page votes for below its body."""
        nodes = self.nodes
        tops = {nodes[n].top for n in chosen if nodes[n].top}
        if tops:
            return {nodes[n].near or n for n in chosen | {v for v in voted if nodes[v].top in tops}}
        inside = chosen | {v for v in voted if nodes[v].tag != "body" and not nodes[v].top}
        return chosen if inside == chosen else {self.around(inside)}

    def sizes(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """Of every element with all inside it: characters, those in links, those outside inner elements of marking names, and form fields."""
        size, linked, plain, fields = ([0] * len(self.nodes) for _ in range(4))
        for node in self.fields:
            fields[node] += 1
        for node, text, in_links in self.blocks:
            size[node] += len(text)
            plain[node] += len(text)
            linked[node] += in_links
        for n in range(len(self.nodes) - 1, 0, -1):
            parent = self.nodes[n].parent
            size[parent] += size[n]
            linked[parent] += linked[n]
            fields[parent] += fields[n]
            plain[parent] += 0 if self.nodes[n].mark == 2 else plain[n]
        return size, linked, plain, fields

    def text(self, paths: list[str] | None) -> str:
        """Blocks of the article around the first of the host's paths that the page has, or around its own best container.

        The article decides what a name means: in it an element goes if its whole name marks it and the article has text besides (a
        tenth of the element's), or if it is named as a link list and is mostly links. A marking word in a longer name, such as
        newsletter-history, takes the element away only if it is mostly links or holds form fields and little else.
        """
        size, linked, plain, fields = self.sizes()

        def goes(n: int, article: int) -> bool:
            mark = self.nodes[n].mark
            if mark == 2:
                return 10 * plain[article] >= size[n]
            return mark > 0 and (2 * linked[n] > size[n] or mark == 1 and size[n] < _FIELD_TEXT * fields[n])

        here: dict[str, set[int]] = {}
        for n, node in enumerate(self.nodes):
            if node.container == n > 0 and size[n]:
                here.setdefault(self.path(n), set()).add(n)
        chosen = next((here[p] for p in paths or [] if p in here), None)
        strong = {p for p, _ in self.votes()}
        if chosen is None:
            own = self.scores()
            chosen = {max(own, key=lambda n: (own[n], -n))} if own else {0}
        else:
            strong &= set(paths or [])
        chosen = self.widened(chosen, {n for p in strong for n in here.get(p, ())})
        within = [0 if 0 in chosen else -1] + [-1] * (len(self.nodes) - 1)  # the article that an element is in; -1 for none
        for n, node in enumerate(self.nodes[1:], 1):
            if n in chosen and within[node.parent] < 0:
                within[n] = n
            elif (article := within[node.parent]) >= 0:
                within[n] = -2 if goes(n, article) else article
            elif within[node.parent] == -2:
                within[n] = -2
        return "\n".join(text for node, text, _ in self.blocks if within[node] >= 0)


def _step(tag: str, classes: list[str]) -> str:
    return ".".join([tag, *sorted({re.sub(r"\d+", "#", c.lower()) for c in classes})]) if classes else tag


def _boilerplate(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """What a tag, a role or a style says is not text of an article, whatever is around it."""
    if tag in _DROPPED or tag == "header" and not in_article:
        return True
    if not attributes or tag in _SAFE:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in _ROLES:
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I))


def _mark(tag: str, attributes: dict[str, str]) -> int:
    if not attributes or tag in _SAFE or not ("class" in attributes or "id" in attributes):
        return 0
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    found = 0
    for name in names:
        parts = {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w}
        marks, lists = parts & _MARKS, parts & _LISTS
        named = parts <= _MARKS | _LISTS | _LAYOUT
        if name.lower() in _MARKS or marks and named:
            return 2
        if lists and named:
            found = 3
        elif marks or lists:
            found = found or 1
    return found


def parse(source: str) -> Page:
    """One pass over the tags: elements with generalised steps, and text blocks outside what is dropped."""
    page = Page()
    nodes, stack = page.nodes, [0]
    open_tags: Counter[str] = Counter()
    buffer: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            if text := " ".join(entities.unescape("".join(buffer)).split()):
                page.blocks.append((nodes[stack[-1]].block, text, min(linked, len(text))))
            buffer.clear()
        linked = 0

    def pop(depth: int) -> None:
        """Ends the open elements from this depth on."""
        while len(stack) > depth:
            open_tags[nodes[stack.pop()].tag] -= 1

    def close(tag: str) -> None:
        """Ends the innermost open element of the tag, and what is open inside it; what it looks at, it ends."""
        if open_tags[tag]:
            depth = len(stack) - 1
            while nodes[stack[depth]].tag != tag:
                depth -= 1
            pop(depth)

    def implied(tag: str) -> None:
        """Ends the innermost block if the start of this one does so by itself."""
        block = nodes[nodes[stack[-1]].block]
        if block.tag == "p" or block.tag in _CLOSES.get(tag, "").split():
            pop(block.depth)

    def keep(text: str) -> None:
        nonlocal linked
        if text and not nodes[stack[-1]].dropped:
            buffer.append(text)
            if nodes[stack[-1]].link:
                linked += len(text)

    while at < len(source):
        start = source.find("<", at)
        if start < 0:
            keep(source[at:])
            break
        keep(source[at:start])
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = len(source) if end < 0 else end + 3
            continue
        name = _NAME.match(source, start + 1)
        if source[start + 1 : start + 2] in ("!", "?") or source.startswith("</", start) and name is None:
            end = source.find(">", start)
            at = len(source) if end < 0 else end + 1
            continue
        if name is None:
            keep("<")
            at = start + 1
            continue
        tail = _TAG_END.match(source, name.end())
        end = tail.end() if tail else source.find(">", name.end()) + 1 or len(source)
        tag, inside, at = name[1].lower(), source[name.end() : end - 1], end
        block = tag in _BLOCK
        if block:
            flush()
        if source[start + 1] == "/":
            close(tag)
            continue
        if tag == "br":
            keep(" ")
        if block:
            implied(tag)
        if tag == "a":
            close(tag)  # links don't nest
        if tag in _FIELDS:
            page.fields.append(stack[-1])
        if tag in _VOID:
            continue
        if tag in _RAW:
            if not _SELF_CLOSED.search(inside):
                stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
                at = stop.end() if stop else len(source)
            continue
        attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(inside)} if inside.strip() else {}
        added = page.add(tag, attributes, stack[-1], len(stack))
        if not _SELF_CLOSED.search(inside):
            stack.append(added)
            open_tags[tag] += 1
    flush()
    return page


def host(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))


def host_paths(pages: DataFrame, least_share: float = 0.05, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, paths): the container paths with at least least_share of a host's votes, most votes first.

    Pages of a host without such a path agree on nothing and are read by their own best containers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[tuple[str, str], float] = {}
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for url, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for path, share in parse(source or "").votes():
                        key = host(url), path
                        tally[key] = tally.get(key, 0.0) + share
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in tally], pa.string()), pa.array([k[1] for k in tally], pa.string()), pa.array(list(tally.values()), pa.float64())], names=["host", "path", "votes"]
            )

    votes = _rows(pages, id_col, url_col, html_col).select("url", "html").mapInArrow(run, "host string, path string, votes double")
    votes = write_table(votes.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes")), "votes")
    least = votes.groupBy("host").agg((F.sum("votes") * least_share).alias("least"))
    kept = votes.join(least, "host").where("votes >= least").groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("order"), "path"))).alias("r"))
    return kept.select("host", F.col("r.path").alias("paths"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: the id, the url, text, n_chars.

    Pages vote for container paths by host, and each is read again by the first path of its host that it has, or by its own
    best container, either widened to the article it is in. Pages stay where they are while the paths are a small table; else
    both are joined by host, which adaptive execution splits for large hosts. Null and empty html and pages without text have an
    empty text; a null url is a host of its own; repeated rows vote as often as they come. Other columns are ignored; no rows
    give no rows.
    """
    rows = _rows(pages, id_col, url_col, html_col)
    paths = write_table(host_paths(pages, id_col=id_col, url_col=url_col, html_col=html_col), "paths")
    name = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1))
    size = paths.agg(F.coalesce(F.sum(F.octet_length("host") + F.aggregate("paths", F.lit(64), lambda n, p: n + F.octet_length(p) + 16)), F.lit(0))).first()[0]
    joined = rows.withColumn("host", name).join(F.broadcast(paths) if size <= BROADCAST_BYTES else paths, "host", "left").select("html", "paths", "page", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                text = [parse(source or "").text(own) for source, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(text, pa.string())], names=["page", "url", "text"])

    found = joined.mapInArrow(run, f"page {rows.schema['page'].dataType.simpleString()}, url string, text string")
    return found.select(F.col("page").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
