"""Wrapper induction: templates for each host's layouts, from its pages' DOM trees.

1. Each page is parsed once into a tree, kept as key, subtree size and text hash of each
   node in document order. A key is the tag with its class; a text is a node of its own.
   Scripts, styles and comments are no nodes. Tags left open close as in HTML: a new p,
   li, td and the like ends the one before, an end tag ends what is open inside.
2. A seed is the page with the most kinds of nodes (then the least page_id) of its group.
   Pages are aligned with it by simple tree matching: two nodes match if their
   keys do, and their children are matched in order for the greatest number of pairs.
   Children of equal shape at either end are paired at once, which loses nothing.
3. A page is of the seed's layout if FITS of its kinds of edges (a node's key below
   another's) have a matched node. The groups are first the hosts; pages that don't fit
   their host's seed are grouped once more, by host and a MinHash of their kinds, and those
   that fit no seed there by host and all their kinds, where they count as fitting.
4. For each text node of a seed, the texts that the pages of its layout put there are counted.
   If one of them makes up CONSTANT of at least MIN_PAGES pages, the node is template; else
   it is a slot.
5. Each page is aligned once more, with the seeds in the same order: a text at a template
   node that is the template's is dropped, what stands in slots or has no counterpart in
   the seed is content.

Only trees are shuffled, not pages, and the largest host is spread over all tasks. The
wrappers are broadcast if they are counted to be few, else joined by group.

Rows: a null or empty html has null or empty content. A url without a host counts as
host "". Rows that repeat count again. With fewer than MIN_PAGES pages all text is content.
Ids may be of any type that has an order.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CONSTANT = 0.8
MIN_PAGES = 2
FITS = 0.8
#: Hosts whose wrappers (about 1 kB each) are broadcast.
BROADCAST_HOSTS = 20_000
CACHE = 20_000

_split = re.compile(
    r"""(<!--.*?(?:-->|\Z)|<(?:script|style)\b.*?(?:</(?:script|style)\s*>|\Z)|</?[a-zA-Z](?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+>|<[!?][^>]*>)""", re.S | re.I
).split
_name = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)").match
_class = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I).search
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BORDER = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "p": {"div", "article", "section", "td", "li", "body"}, "option": {"select"}}
TEXT = 1
_keys: dict[str, tuple[str, int]] = {}


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _tag(raw: str) -> tuple[str, int]:
    """Name and key of a start tag."""
    got = _keys.get(raw)
    if got is None:
        name = _name(raw)[1].lower()
        c = _class(raw)
        key = xxhash.xxh32_intdigest(name + "." + next((x for x in c.groups() if x is not None), "") if c else name) >> 1 | 2
        if len(_keys) > 50_000:
            _keys.clear()
        got = _keys[raw] = (name, key)
    return got


def parse(source: str) -> tuple[list[int], list[int], list[str | None]]:
    """Keys, subtree sizes and texts (None for elements) in document order, under one root."""
    keys, sizes, texts = [0], [1], [None]
    open_at, open_names = [0], [""]

    def close(to: int) -> None:
        while len(open_at) > to:
            at = open_at.pop()
            open_names.pop()
            sizes[at] = len(keys) - at

    for k, part in enumerate(_split(source)):
        if not k & 1:
            if part and (text := " ".join(part.split())):
                keys.append(TEXT)
                sizes.append(1)
                texts.append(text)
            continue
        if part[1] == "/":
            name = _name(part)[1].lower()
            if name in open_names:
                close(len(open_names) - 1 - open_names[::-1].index(name))
        elif part[1] not in "!?" and (name := _tag(part)[0]) not in ("script", "style"):
            ends, border = _CLOSES.get(name), _BORDER.get(name, ())
            if ends:
                for i in range(len(open_names) - 1, 0, -1):
                    if open_names[i] in ends:
                        close(i)
                        break
                    if open_names[i] in border:
                        break
            keys.append(_tag(part)[1])
            sizes.append(1)
            texts.append(None)
            if name not in _VOID and not part.endswith("/>"):
                open_at.append(len(keys) - 1)
                open_names.append(name)
    close(1)
    sizes[0] = len(keys)
    return keys, sizes, texts


def edges(keys, sizes) -> list[tuple[int, int]]:
    """For each node its parent's key and its own."""
    out, ends = [], []
    for i, key in enumerate(keys):
        while ends and ends[-1][0] <= i:
            ends.pop()
        out.append((ends[-1][1] if ends else -1, key))
        ends.append((i + sizes[i], key))
    return out


def marks(keys, sizes) -> tuple[int, int]:
    """A MinHash of a tree's kinds of edges, and a hash of all of them."""
    found = sorted(_hash(f"{a},{b}") for a, b in set(edges(keys, sizes)))
    return found[0], _hash(",".join(map(str, found)))


class Matcher:
    """Simple tree matching, with what it found kept by the trees' shapes."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sizes: list[int] = []
        self.parts: list[tuple] = []
        self.weights: dict[tuple[int, int], int] = {}
        self.found: dict[tuple[int, int], tuple[list[tuple[int, int]], bool]] = {}

    def shape(self, keys, sizes) -> int:
        """Number of a tree's shape; equal trees of keys have one number."""
        ids = self.ids
        done = [0] * len(keys)
        for i in range(len(keys) - 1, -1, -1):
            end, j, below = i + sizes[i], i + 1, []
            while j < end:
                below.append(done[j])
                j += sizes[j]
            what = (keys[i], *below)
            got = ids.get(what)
            if got is None:
                got = ids[what] = len(ids)
                self.sizes.append(sizes[i])
                self.parts.append(what)
            done[i] = got
        return done[0]

    def weight(self, a: int, b: int) -> int:
        """Pairs in the best matching of two shapes. Children come before their parents,
        without recursion, so trees may be of any depth."""
        if a == b:
            return self.sizes[a]
        if self.parts[a][0] != self.parts[b][0]:
            return 0
        weights, parts, todo = self.weights, self.parts, [(a, b)]
        while todo:
            s, t = todo[-1]
            if (s, t) in weights:
                todo.pop()
                continue
            x, y = parts[s], parts[t]
            head, tail = self._ends(x[1:], y[1:])
            inner_x, inner_y = x[1 + head : len(x) - tail], y[1 + head : len(y) - tail]
            open_ = [(i, j) for i in inner_x for j in inner_y if i != j and parts[i][0] == parts[j][0] and (i, j) not in weights]
            if open_:
                todo += dict.fromkeys(open_)
                continue
            table = self._table(x[1:], y[1:])[2]
            weights[s, t] = 1 + table[-1][-1] + sum(self.sizes[k] for k in x[1 : 1 + head]) + sum(self.sizes[k] for k in x[len(x) - tail :])
            todo.pop()
        return weights[a, b]

    def _ends(self, x: tuple, y: tuple) -> tuple[int, int]:
        head, most = 0, min(len(x), len(y))
        while head < most and x[head] == y[head]:
            head += 1
        tail = 0
        while tail < most - head and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        return head, tail

    def _table(self, x: tuple, y: tuple) -> tuple[int, int, list[list[int]]]:
        head, tail = self._ends(x, y)
        x, y = x[head : len(x) - tail], y[head : len(y) - tail]
        rows = [[0] * (len(y) + 1)]
        if x and y:
            for s in x:
                last, row = rows[-1], [0]
                for j, t in enumerate(y):
                    w = last[j] + self.weight(s, t)
                    up, left = last[j + 1], row[j]
                    row.append(w if w > up and w > left else up if up > left else left)
                rows.append(row)
        return head, tail, rows

    def align(self, keys, sizes, other_keys, other_sizes) -> list[tuple[int, int]]:
        """Pairs of places of two trees."""
        return self.fit(keys, sizes, other_keys, other_sizes)[0]

    def fit(self, keys, sizes, other_keys, other_sizes) -> tuple[list[tuple[int, int]], bool]:
        """Pairs of places of a page's tree and a seed's, and whether the page fits it."""
        if len(self.ids) > 40 * CACHE:
            self.clear()
        a, b = self.shape(keys, sizes), self.shape(other_keys, other_sizes)
        got = self.found.get((a, b))
        if got is None:
            pairs: list[tuple[int, int]] = []
            self._pairs(a, b, 0, 0, pairs)
            if len(self.found) > CACHE:
                self.found.clear()
            kinds = edges(keys, sizes)
            met = {kinds[i] for i, _ in pairs}
            got = self.found[a, b] = (pairs, len(met) >= FITS * len(set(kinds)))
        return got

    def _pairs(self, a: int, b: int, i: int, j: int, out: list) -> None:
        todo = [(a, b, i, j)]
        while todo:
            a, b, i, j = todo.pop()
            if a == b:
                out += zip(range(i, i + self.sizes[a]), range(j, j + self.sizes[a]))
                continue
            x, y = self.parts[a], self.parts[b]
            if x[0] != y[0]:
                continue
            out.append((i, j))
            x, y = x[1:], y[1:]
            at_x, at_y = self._places(x, i), self._places(y, j)
            head, tail, rows = self._table(x, y)
            pairs = [(k, k) for k in range(head)] + [(len(x) - k, len(y) - k) for k in range(1, tail + 1)]
            m, n = len(x) - head - tail, len(y) - head - tail
            while m and n:
                w = self.weight(x[head + m - 1], y[head + n - 1])
                if w and rows[m][n] == rows[m - 1][n - 1] + w:
                    m, n = m - 1, n - 1
                    pairs.append((head + m, head + n))
                elif rows[m][n] == rows[m - 1][n]:
                    m -= 1
                else:
                    n -= 1
            todo += [(x[k], y[l], at_x[k], at_y[l]) for k, l in pairs]

    def _places(self, parts: tuple, at: int) -> list[int]:
        out, at = [], at + 1
        for s in parts:
            out.append(at)
            at += self.sizes[s]
        return out


_matcher = Matcher()


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.withColumn("__host", F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url}`").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")))


LIGHT = ["host", "page_id", "keys", "sizes", "texts", "kinds", "mark", "sign"]
#: What groups pages in step 3, in turn.
LEVELS = [[], ["mark"], ["sign"]]


def trees(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(host, page_id, keys, sizes, texts, kinds, mark, sign) of every page that has an html."""

    def run(batches):
        for whole in batches:
            for batch in C.slices(whole, "html"):
                rows = []
                for source in batch.column(2).to_pylist():
                    k, s, t = parse(source)
                    rows.append((k, s, [0 if x is None else _hash(x) for x in t], len(set(k)), *marks(k, s)))
                kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=LIGHT)

    rows = with_host(pages, url).select(F.col("__host").alias("host"), F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{html}`").cast("string").alias("html"))
    return rows.filter("html IS NOT NULL").mapInArrow(run, C.schema_of(rows, ["host", "page_id"], "keys array<int>, sizes array<int>, texts array<bigint>, kinds int, mark bigint, sign bigint"))


def seeds(made: DataFrame, by: list[str]) -> DataFrame:
    """(host, by.., seed_keys, seed_sizes): each group's seed tree."""
    rank = F.struct((-F.col("kinds")).alias("k"), "page_id", F.xxhash64("keys", "sizes").alias("h"))
    seed = made.groupBy("host", *by).agg(F.min_by(F.struct("keys", "sizes"), rank).alias("s"))
    return seed.select("host", *by, F.col("s.keys").alias("seed_keys"), F.col("s.sizes").alias("seed_sizes"))


def _few(df: DataFrame) -> DataFrame:
    return C.sized(df, BROADCAST_HOSTS)


def fitted(made: DataFrame, seed: DataFrame, by: list[str], last: bool) -> DataFrame:
    """Rows of made with fits, and the places in the seed (nodes) and hashes (values) of the
    page's texts that have a counterpart there. Trees are left out where they fit."""

    def run(batches):
        for batch in batches:
            rows = []
            for *own, seed_keys, seed_sizes in zip(*(c.to_pylist() for c in batch.columns[2:])):
                keys, sizes, texts = own[:3]
                pairs, fits = _matcher.fit(keys, sizes, seed_keys, seed_sizes)
                if fits or last:
                    at = [(j, texts[i]) for i, j in pairs if texts[i]]
                    rows.append((None, None, None, *own[3:], True, [j for j, _ in at], [t for _, t in at]))
                else:
                    rows.append((*own, False, [], []))
            if rows:
                kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[*LIGHT, "fits", "nodes", "values"])

    rows = made.join(_few(seed), ["host", *by]).select(*LIGHT, "seed_keys", "seed_sizes")
    return rows.mapInArrow(run, C.schema_of(rows, LIGHT, "fits boolean, nodes array<int>, values array<bigint>"))


def template(done: DataFrame, seed: DataFrame, by: list[str], constant: float, min_pages: int) -> DataFrame:
    """(host, by.., seed_keys, seed_sizes, nodes, values): the template's nodes and their texts."""
    votes = done.filter("fits").select("host", *by, F.explode(F.arrays_zip("nodes", "values")).alias("v"))
    counts = votes.groupBy("host", *by, F.col("v.nodes").alias("node"), F.col("v.values").alias("text")).agg(F.count("*").alias("n"))
    nodes = counts.groupBy("host", *by, "node").agg(F.sum("n").alias("total"), F.max(F.struct("n", "text")).alias("top"))
    fixed = nodes.filter((F.col("total") >= min_pages) & (F.col("top.n") >= constant * F.col("total")))
    made = fixed.groupBy("host", *by).agg(F.array_sort(F.collect_list(F.struct("node", F.col("top.text").alias("text")))).alias("t"))
    return seed.join(made, ["host", *by], "left").select("host", *by, "seed_keys", "seed_sizes", F.col("t.node").alias("nodes"), F.col("t.text").alias("values"))


def wrappers(made: DataFrame, constant: float = CONSTANT, min_pages: int = MIN_PAGES) -> list[DataFrame]:
    """The templates of each level, as far as pages are left for it."""
    out, rest = [], made
    for k, by in enumerate(LEVELS):
        seed, _path = C.written(seeds(rest, by), "seeds")
        done, _path = C.written(fitted(rest, seed, by, k == len(LEVELS) - 1), "fitted")
        out.append(C.written(template(done, seed, by, constant, min_pages), "wrappers")[0])
        rest = done.filter("NOT fits").select(*LIGHT)
        if rest.isEmpty():
            break
    return out


def _content(keys, sizes, texts, seed_keys, seed_sizes, nodes, values) -> tuple[bool, tuple]:
    """Whether the page fits the seed, and its content, if so."""
    gone, fits = set(), False
    if seed_keys is not None:
        pairs, fits = _matcher.fit(keys, sizes, seed_keys, seed_sizes)
        fixed = dict(zip(nodes or (), values or ()))
        gone = {i for i, j in pairs if j in fixed and texts[i] is not None and _hash(texts[i]) == fixed[j]} if fixed else gone
    kept = [t for i, t in enumerate(texts) if t is not None and i not in gone]
    text = "\n".join(kept)
    return fits, (_html.unescape(text) if "&" in text else text, len(gone), len(kept))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", constant: float = CONSTANT, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, host, content, n_template, n_content): texts in document order, a line
    each, and how many text nodes were template and content."""
    made, _path = C.written(trees(pages, page_id, url, html), "trees")
    levels = wrappers(made, constant, min_pages)
    more = "content string, n_template int, n_content int, html string, mark bigint, sign bigint"
    names = ["page_id", "host", "content", "n_template", "n_content", "html", "mark", "sign"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]

    def level(rows: DataFrame, k: int) -> DataFrame:
        last = k == len(levels) - 1

        def run(batches):
            for whole in batches:
                for batch in C.slices(whole, "html"):
                    out = []
                    for source, *wrapper in zip(*(c.to_pylist() for c in batch.columns[2:])):
                        if source is None:
                            out.append((None, 0, 0, None, None, None))
                            continue
                        tree = parse(source)
                        fits, what = _content(*tree, *wrapper)
                        out.append((*what, None, None, None) if fits or last else (None, 0, 0, source, *marks(*tree[:2])))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=names)

        joined = rows.join(_few(levels[k]), ["host", *LEVELS[k]], "left").select("page_id", "host", "html", "seed_keys", "seed_sizes", "nodes", "values")
        return joined.mapInArrow(run, C.schema_of(joined, ["page_id", "host"], more))

    rows = with_host(pages, url).select(F.col(f"`{page_id}`").alias("page_id"), F.col("__host").alias("host"), F.col(f"`{html}`").cast("string").alias("html"))
    if len(levels) == 1:
        return level(rows, 0).select(*names[:5])
    out = None
    for k in range(len(levels)):
        done, _path = C.written(level(rows, k), "content")
        settled = done.filter("html IS NULL").select(*names[:5])
        out = settled if out is None else out.unionByName(settled)
        rows = done.filter("html IS NOT NULL").select("page_id", "host", "html", "mark", "sign")
    return out


def op2_wrapper_induction(spark, sf_dir: str) -> DataFrame:
    """The content of every page, by its host's wrapper."""
    return extract(C.read(spark, sf_dir, "pages"))
