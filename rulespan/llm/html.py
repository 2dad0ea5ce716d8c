"""HTML extraction by equivalence-class template deduction.

Pages of one host come from one template. A token is a tag or a block's text in its
place (the path of the elements around it), and its occurrence vector counts it on each
page of a group of same-host pages. Tokens that share a vector form an equivalence class; a
class is valid if its tokens come in the same order on every page, and nests in
another if it lies in one gap between that one's tokens on every page. The valid
classes from the one around the whole page inwards are the template; what is between
its tokens are slots. The main text is what fills the slots, without boxes that are not
content; of pages with text in slots of an article or main element, it is what fills
those. On pages without, it is what fills all slots, in page order.

A text is the template's only if most kinds of pages have it. Pages with few words that
the texts of most pages lack are one kind, as near copies share their content as well.

A host's pages are dealt into groups of about ``GROUP`` pages, each with its own
template, so a host with a third of all pages is many tasks.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import materialize

#: Hosts of several groups whose list is broadcast; beyond that it is joined by a shuffle.
LISTED = 100_000
#: Pages of a group, about.
GROUP = 48
# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
NOT_CONTENT = frozenset("aside button canvas datalist dialog footer form head iframe input label menu nav noscript object script select style svg template textarea".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSES_P = BLOCK - frozenset("body html option optgroup".split())
#: Words of class, id and role attributes that name boxes other than the article.
BOXES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|disqus|disclaimer|footer|header|masthead|menu|modal|nav|navigation|newsletter|notices?|pagination|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget|contentinfo|complementary|search|alert)(?:$|[\s_-])", re.I)
#: An article of this class is a comment.
COMMENT = re.compile(r"(?:^|\s)comments?(?:\s|$)", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|</?[a-zA-Z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Page:
    """A page's tokens and blocks outside of boxes: (path, text, in article, token)."""

    def __init__(self, source: str):
        self.tokens: list[str] = []
        self.blocks: list[tuple[str, str, bool, str]] = []
        #: By block number and whether in a box: place among the tokens, path, in article, texts.
        texts: dict[tuple[int, bool], list] = {}
        stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]
        block = 0
        for m in self._pieces(source):
            if m[0] == "text":
                _, path, article, box = stack[-1]
                if m[1].strip() and (block, box) not in texts:
                    texts[block, box] = [len(self.tokens), path, article, []]
                    self.tokens.append("")
                if (block, box) in texts:
                    texts[block, box][3].append(entities.unescape(m[1]))
                continue
            tag = m[1]
            name = NAME.match(tag)[1].lower()
            if tag[1] == "/":
                if name in BLOCK:
                    block += 1
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        self.tokens.append("/" + stack[i][1])
                        del stack[i:]
                        break
                continue
            if name in BLOCK:
                block += 1
            if name == "br":
                for box in (False, True):
                    if (block, box) in texts:
                        texts[block, box][3].append(" ")
            # A block closes an open paragraph, and list items and cells close their like.
            if name in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCK:
                        break
            if name in ("li", "tr", "td", "th", "dd", "dt", "option"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                    if stack[i][0] in ("ul", "ol", "table", "dl", "select", "tr" if name in ("td", "th") else "table"):
                        break
            _, path, article, box = stack[-1]
            path = f"{path}/{name}"
            if name not in VOID:
                attrs = ATTR.findall(tag[1 + len(name) :]) if len(tag) > len(name) + 2 else ()
                words = " ".join(a or b or c for key, a, b, c in attrs if key.lower() in ("class", "id", "role"))
                hidden = any(k.lower() == "hidden" or k.lower() == "aria-hidden" and (a or b or c).lower() == "true" for k, a, b, c in attrs)
                # Within an article, its own header is content; elsewhere it is the site's.
                mine = box or name in NOT_CONTENT or hidden or bool(words and BOXES.search(words)) and name not in ("article", "main", "body", "html") or name == "article" and bool(COMMENT.search(words)) or name == "header" and not article
                if words:
                    path += f".{words}"
                stack.append((name, path, article or (name in ("article", "main") or "main" in words.lower().split()) and not mine, mine))
                if tag.endswith("/>") and name not in BLOCK:
                    stack.pop()
            self.tokens.append(path)
        for (_, box), (at, path, article, parts) in texts.items():
            text = " ".join("".join(parts).split())
            self.tokens[at] = f"{path}#{text}"
            if text and not box:
                self.blocks.append((path, text, article, self.tokens[at]))

    @staticmethod
    def _pieces(source: str) -> Iterator[tuple[str, str]]:
        at, n = 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            if m is None:
                yield "text", source[at:]
                return
            if m.start() > at:
                yield "text", source[at : m.start()]
            at = m.end()
            tag = m[0]
            if tag[1] in "!?":
                continue
            yield "tag", tag
            name = NAME.match(tag)
            if tag[1] != "/" and name and name[1].lower() in RAW and not tag.endswith("/>"):
                end = re.compile(f"</{name[1]}\\b", re.I).search(source, at)
                stop = end.start() if end else n
                if stop > at and name[1].lower() == "textarea":
                    yield "text", source[at:stop]
                at = stop


def _kinds(pages: list[Page]) -> list[int]:
    """The kind of each page: 0 for those that have little but texts of most pages."""
    seen = Counter(t for p in pages for t in {b[3] for b in p.blocks})
    common = {t for t, n in seen.items() if n > max(1, len(pages) // 2)}
    if not common:
        return list(range(1, len(pages) + 1))
    shared = {w for p in pages for b in p.blocks if b[3] in common for w in b[1].split()}
    kinds = []
    for i, p in enumerate(pages):
        own = {w for b in p.blocks if b[3] not in common for w in b[1].split()} - shared
        held = {w for b in p.blocks if b[3] in common for w in b[1].split()}
        # The more pages tell, the fewer words of its own does each need.
        kinds.append(i + 1 if own and len(own) * min(len(pages), 10) >= len(held) else 0)
    return kinds


def _chain(tokens: list[str], place: list[dict], have: list[int]) -> list[str]:
    """The most tokens that come in the same order on every page."""
    at = np.array([[x for i in have for x in place[i][t]] for t in tokens])
    length, before = np.ones(len(tokens), int), np.full(len(tokens), -1)
    for j in range(1, len(tokens)):
        fits = np.flatnonzero((at[:j] < at[j]).all(axis=1))
        if len(fits):
            before[j] = fits[np.argmax(length[fits])]
            length[j] = length[before[j]] + 1
    out, j = [], int(np.argmax(length))
    while j >= 0:
        out.append(tokens[j])
        j = int(before[j])
    return out[::-1]


def deduce(pages: list[Page]) -> set[str]:
    """Tokens of the template of a group of pages."""
    if not pages:
        return set()
    vectors: dict[str, list[int]] = defaultdict(lambda: [0] * len(pages))
    for i, p in enumerate(pages):
        for t, n in Counter(p.tokens).items():
            vectors[t][i] = n
    kinds = _kinds(pages)
    most = max(1, len(set(kinds)) // 2)
    classes: dict[tuple, list[str]] = defaultdict(list)
    for t, v in vectors.items():
        # A text of few kinds of pages is content; tags are the template's even there.
        if "#" not in t or len({k for k, x in zip(kinds, v) if x}) > most:
            classes[tuple(v)].append(t)
    place = [defaultdict(list) for _ in pages]
    for i, p in enumerate(pages):
        for k, t in enumerate(p.tokens):
            place[i][t].append(k)
    template: set[str] = set()
    # From the class of the whole page inwards: by how many pages and how often.
    fences: list[list[int]] = [[] for _ in pages]
    for vector, tokens in sorted(classes.items(), key=lambda c: (-sum(1 for x in c[0] if x), sum(c[0]), -len(c[1]))):
        have = [i for i, n in enumerate(vector) if n]
        tokens.sort(key=lambda t: place[have[0]][t][0])
        valid = _chain(tokens, place, have)
        # Nested: the first instance of the class lies in the same gap of what is there already.
        if template and have:
            gaps = set()
            for i in have:
                fence = fences[i]
                gaps.add(sum(1 for x in fence if x < place[i][valid[0]][0]))
            if len(gaps) > 1:
                continue
        template.update(valid)
        if all(n == 1 for n in vector):
            for i in have:
                fences[i] = sorted([*fences[i], *(place[i][t][0] for t in valid)])
    return template


def main_text(page: Page, template: set[str]) -> str:
    """The text in the page's slots, blocks joined by an empty line. An article's slots
    come before others."""
    free = [b for b in page.blocks if b[3] not in template]
    return "\n\n".join(b[1] for b in [b for b in free if b[2]] or free)


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's texts compressed, as they are shuffled and spilled whole."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        last = batch.num_columns - 1
        packed = pa.array([None if x is None else pack(x.encode()) for x in batch.column(last).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:last], packed], names=batch.schema.names)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order (host, group): the main text of each page."""
    group, held = None, []
    unpack = zstandard.ZstdDecompressor().decompress

    def done(rows):
        pages = [Page(r[2]) for r in rows]
        # Copies of a page would make its content look like the template.
        distinct = list({tuple(p.tokens): p for p in pages}.values())
        template = deduce(distinct)
        return [(r[0], r[1], main_text(p, template)) for r, p in zip(rows, pages)]

    def flush(rows):
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array([len(x) for x in cols[2]], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    for batch in batches:
        out = []
        for host, part, page, url, source in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if group != (host, part):
                if held:
                    out += done(held)
                group, held = (host, part), []
            held.append((page, url, unpack(source).decode() if source is not None else ""))
        yield flush(out)
    if held:
        yield flush(done(held))


def extract(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """The main text of every row of ``pages(page_id, url, html)``.

    Returns page_id, url, text ("" if there is none) and n_chars (code points). Null and
    empty html give no text; pages without a host, and null urls, are grouped by
    themselves; rows that repeat are extracted each; an empty table gives no rows; other
    columns are ignored."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(host.alias("host"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    # Hosts of one group need no entry, so the table holds a row for each ``group`` pages at most.
    sizes = rows.groupBy(F.col("host").alias("of")).agg(F.ceil(F.count("*") / group).cast("int").alias("groups")).where("groups > 1")
    sizes = materialize(sizes, "html-hosts")
    if sizes.count() <= LISTED:
        sizes = F.broadcast(sizes)
    rows = rows.join(sizes, rows["host"] == sizes["of"], "left")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("page_id"), F.coalesce("groups", F.lit(1))).cast("int"))
    rows = rows.select("host", "part", "page_id", "url", "html").mapInArrow(_squeeze, "host string, part int, page_id long, url string, html binary")
    rows = rows.repartition("host", "part").sortWithinPartitions("host", "part", "page_id")
    return rows.mapInArrow(_groups, "page_id long, url string, text string, n_chars long")
