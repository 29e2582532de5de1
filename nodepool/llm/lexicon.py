"""Toxicity lexicon: random walks over a word graph, from labelled seed terms.

1. Count, over all documents, in how many segments (runs of SEGMENT words of a text) each
   word stands, and how many documents labelled toxic and clean hold it.
2. Seeds of the toxic pole are words that toxic documents hold more often than clean ones:
   by smoothed log-odds of SEED_ODDS at least, and by a likelihood ratio so great that
   of all words tested FALSE_WORDS are expected to reach it by chance. Copies of one
   document are one witness: a word has as many as there are different signatures (a
   MinHash of the text's pairs of words) among its documents, estimated from LEASTS
   minima, less the share CHANGED of the root of the sum of the squares of the numbers of
   documents with one signature, estimated from SIGNS random signs; that takes off what
   copies with small changes add. The other pole is the NEUTRAL words that stand in most
   segments, of those that the labels don't tie to toxic documents.
3. Nodes don't need labels: every word that stands in SUPPORT segments or more is tested in
   the same way (JOIN_ODDS), with "stands in a segment with a node" in place of "labelled toxic".
   Words that pass join the graph if a share of BESIDE of their witnesses does so (a word
   of the language that has the seeds doesn't); HOPS such steps are taken, or less when no
   word joins.
   Words that are not reached have no edge into the walk and weigh nothing.
4. Edges are the positive pointwise mutual information of nodes over segments, each node's
   NEIGHBOURS strongest ones. Two walks with restart, one from each pole, give each node
   a probability at each; its weight is their normalised difference, from -1 to 1, times
   b / (b + PRIOR) for a word that joined by b witnesses.
5. A document's score is the sum of the weights of its distinct words, positive and negative;
   the words of the neutral pole itself, which stand in every document alike, are left
   out. It is toxic from the threshold on: the least score, LEAST_SCORE or more, that at
   most MAX_FALSE of the labelled clean documents reach which were held out (one in
   HELD_OUT by the hash of doc_id; their labels choose no seed).

Words are runs of ASCII letters, digits and other letters' bytes of the lowered text, and
go by 64-bit hashes. All texts are read whole, in each pass.

Rows: a null or empty text scores 0 and isn't toxic. Labels that are null or whose
doc_id is null don't count. Rows that repeat count again. With no labels there are no
seeds, all weights are 0 and no document is toxic. Ids may be of any type.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SEGMENT = 256
SUPPORT = 3
#: Least log-odds of a seed, and of a word that joins.
SEED_ODDS, JOIN_ODDS = math.log(16.0), math.log(4.0)
FALSE_WORDS = 1.0
NEUTRAL = 256
HOPS = 2
BESIDE = 0.4
NEIGHBOURS = 32
SIGNS, LEASTS = 8, 16
CHANGED = 0.25
PRIOR = 5.0
RESTART = 0.3
STEPS = 30
MAX_FALSE = 0.003
LEAST_SCORE = 0.1
HELD_OUT = 5

#: Stands for the documents or segments themselves.
ALL = 0
#: Numbers (rows times columns) that a worker holds before it adds up equal keys, and after which it gives them out.
_HOLD, _GIVE = 4_000_000, 3_000_000
_signs, _leasts = [f"x{k}" for k in range(SIGNS)], [f"m{k}" for k in range(LEASTS)]
_salts = C.mix64(np.arange(7, 7 + LEASTS, dtype=np.uint64))


# words


def words(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of each word, and where each text's words begin. Signs that UTF-8
    writes in two or three bytes part words as ASCII ones do."""
    if len(flat) > 2:
        gap = np.flatnonzero((flat[:-2] == 0xE2) & ((flat[1:-1] & 0xFE) == 0x80) | (flat[:-2] == 0xE3) & (flat[1:-1] == 0x80))
        two = np.flatnonzero((flat[:-1] == 0xC2) & ~np.isin(flat[1:], (0xAA, 0xB5, 0xBA)))
        if len(gap) or len(two):
            flat = flat.copy()
            for k in range(3):
                flat[gap + k] = 32
            for k in range(2):
                flat[two + k] = 32
    h, row, starts = C.words(flat, at)
    return h.view(np.int64), row, starts


def word_hash(word: str) -> int:
    data = np.frombuffer(word.lower().encode(), np.uint8)
    return int(words(data, np.array([0, len(data)]))[0][0])


class Slice:
    """The words of some texts: names (different ones), code (each word's place in names),
    row (its text), seg (its segment, over all texts), n_seg."""

    def __init__(self, column: pa.Array) -> None:
        h, self.row, starts = words(*C.flat_text(column))
        self.names, self.code = np.unique(h, return_inverse=True)
        lens = np.diff(starts)
        per = -(-lens // SEGMENT)
        first = np.cumsum(per) - per
        self.seg = first[self.row] + (np.arange(len(h)) - starts[self.row]) // SEGMENT
        self.n_seg = int(per.sum())
        self.h, self.starts = h, starts

    def distinct(self, group: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(group, code) pairs, each once, of the words that keep marks."""
        group, code = (group, self.code) if keep is None else (group[keep], self.code[keep])
        key = group.astype(np.int64) << 32 | code
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        return key >> 32, key & 0xFFFFFFFF

    def signatures(self) -> np.ndarray:
        """A MinHash of each text's pairs of words."""
        full = np.flatnonzero(np.diff(self.starts))
        least = np.zeros(len(self.starts) - 1, np.uint64)
        if len(full):
            h = self.h.view(np.uint64)
            after = np.where(self.row[:-1] == self.row[1:], h[1:], np.uint64(0))
            least[full] = np.minimum.reduceat(C.mix64(h * np.uint64(0x9E3779B97F4A7C15) + np.append(after, np.uint64(0))), self.starts[full])
        return least

    def witnesses(self, keep: np.ndarray) -> list[np.ndarray]:
        """Of the words of keep: names' places, how many texts hold each, and of those
        texts' signatures the sums of SIGNS random signs and the least of LEASTS hashes."""
        row, code = self.distinct(self.row, keep)
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        cut = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else code
        mark = self.signatures()
        signs = C.mix64(mark + np.uint64(1))
        out = [code[cut], np.diff(np.append(cut, len(code)))]
        for k in range(SIGNS if len(cut) else 0):
            out.append(np.add.reduceat(1 - 2 * ((signs >> np.uint64(k)) & np.uint64(1)).astype(np.int64)[row], cut))
        for k in range(LEASTS if len(cut) else 0):
            out.append(np.minimum.reduceat((C.mix64(mark ^ _salts[k]) >> np.uint64(33)).astype(np.int64)[row], cut))
        return out


def slices_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Slice, pa.RecordBatch]]:
    for whole in batches:
        for batch in C.slices(whole, "text"):
            yield Slice(batch.column(batch.schema.get_field_index("text"))), batch
    C.trim()


def _lowered(docs: DataFrame, *more: str | Column) -> DataFrame:
    return docs.select(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"), *more)


class Sums:
    """Adds up columns by keys, in bounded memory; of columns named m.. the least is kept."""

    def __init__(self, names: list[str], n_keys: int) -> None:
        self.names, self.n_keys = names, n_keys
        self.parts: list[list[np.ndarray]] = []
        self.held = 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append([c.astype(np.int64, copy=False) for c in columns])
        self.held += len(columns[0]) * len(columns)
        if self.held > _HOLD:
            self._reduce()
            if self.held > _GIVE:
                yield from self.out()

    def _reduce(self) -> None:
        """One column after another, so that the others aren't held twice."""
        columns, self.parts = [list(c) for c in zip(*self.parts)], []
        keys = [np.concatenate(c) for c in columns[: self.n_keys]]
        order = np.lexsort(keys)
        keys = [c[order] for c in keys]
        new = np.append(True, np.zeros(max(len(order) - 1, 0), bool))[: len(order)]
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        cut = np.flatnonzero(new)
        made = [k[cut] for k in keys]
        for i in range(self.n_keys, len(columns)):
            c, columns[i] = np.concatenate(columns[i])[order], []
            made.append((np.minimum if self.names[i][0] == "m" else np.add).reduceat(c, cut) if len(cut) else c)
        self.parts, self.held = [made], len(cut) * len(made)

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._reduce()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in self.parts[0]], names=self.names)
        self.parts, self.held = [], 0
        C.trim()


# what is counted


def marked_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label), a row for each labelled document: toxic if any row says so."""
    return labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))


def _marked(docs: DataFrame, marked: DataFrame, how: str) -> DataFrame:
    rows = _lowered(docs.select("text", F.col("doc_id").cast("string").alias("doc_id")), "doc_id")
    return rows.join(C.sized(marked), "doc_id", how).select("text", "label")


def term_counts(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(word, n, toxic, clean): segments that hold each word, and documents of each label
    that do. The word ALL stands for the segments and documents themselves."""

    def run(batches):
        sums = Sums(["word", "n", "toxic", "clean"], 1)
        for s, batch in slices_of(batches):
            label = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            v = len(s.names)
            n, toxic, clean = (np.bincount(g, minlength=v) for g in (s.distinct(s.seg)[1], *(s.distinct(s.row, k)[1] for k in (label[s.row] > 0, label[s.row] == 0))))
            some = (ALL, s.n_seg, (label > 0).sum(), (label == 0).sum())
            yield from sums.add(*(np.append(a, b) for a, b in zip((s.names, n, toxic, clean), some)))
        yield from sums.out()

    counted = _marked(docs, marked, "left").mapInArrow(run, "word bigint, n bigint, toxic bigint, clean bigint")
    return counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "toxic", "clean")))


def near_counts(rows: DataFrame, source: np.ndarray | None) -> DataFrame:
    """(word, near, docs, x0.., m0..) over lowered texts: segments that hold the word and a
    word of source (None: all), how many documents have them, and what tells how many of
    these are witnesses. The word ALL stands for all segments with a source."""
    names = ["word", "near", "docs", *_signs, *_leasts]
    held = rows.sparkSession.sparkContext.broadcast(None if source is None else np.sort(source))

    def run(batches):
        sums = Sums(names, 1)
        for s, _ in slices_of(batches):
            if not len(s.seg):
                continue
            has = np.ones(s.n_seg, bool) if held.value is None else np.bincount(s.seg, np.isin(s.names, held.value)[s.code], s.n_seg) > 0
            if has.any():
                keep = has[s.seg]
                near = np.bincount(s.distinct(s.seg, keep)[1], minlength=len(s.names))
                at, *more = s.witnesses(keep)
                some = [ALL, has.sum(), 0] + [0] * SIGNS + [(1 << 31) - 1] * LEASTS
                yield from sums.add(*(np.append(a, b) for a, b in zip((s.names[at], near[at], *more), some)))
        yield from sums.out()

    counted = rows.select("text").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))
    return counted.groupBy("word").agg(*((F.min if c[0] == "m" else F.sum)(c).alias(c) for c in names[1:]))


def spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = end - start
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


def pair_counts(docs: DataFrame, node: np.ndarray, neutral: np.ndarray) -> DataFrame:
    """(i, j, n), i < j: segments that hold both nodes, by their places in node."""
    order = np.argsort(node)
    held = docs.sparkSession.sparkContext.broadcast((node[order], order, neutral))
    v, poles = len(node), np.flatnonzero(neutral)

    def run(batches):
        names, place, neutral = held.value
        slot = np.full(v, -1)
        slot[poles] = np.arange(len(poles))
        both = np.zeros((len(poles), len(poles)))
        sums = Sums(["i", "j", "n"], 2)
        for s, _ in slices_of(batches):
            at = np.minimum(np.searchsorted(names, s.names), v - 1)
            node_of = np.where(names[at] == s.names, place[at], -1)
            seg, code = s.distinct(s.seg, (node_of >= 0)[s.code])
            k = node_of[code]
            thick = neutral[k]
            matrix = np.zeros((s.n_seg, len(poles)), np.float32)
            matrix[seg[thick], slot[k[thick]]] = 1
            both += matrix.T @ matrix
            seg, k = seg[~thick], k[~thick]
            if len(seg):
                n = np.searchsorted(seg, seg, "right")
                left = np.repeat(np.arange(len(seg)), n - np.arange(len(seg)) - 1)
                right = spans(np.arange(len(seg)) + 1, n)
                yield from sums.add(np.minimum(k[left], k[right]), np.maximum(k[left], k[right]), np.ones(len(left)))
                by = np.argsort(k, kind="stable")
                cut = np.flatnonzero(np.append(True, k[by][1:] != k[by][:-1]))
                beside = np.add.reduceat(matrix[seg[by]], cut, axis=0)
                a, b = np.nonzero(beside)
                i, j = k[by][cut][a], poles[b]
                yield from sums.add(np.minimum(i, j), np.maximum(i, j), beside[a, b])
        a, b = np.nonzero(np.triu(both, 1))
        yield from sums.add(poles[a], poles[b], both[a, b])
        yield from sums.out()

    return _lowered(docs).mapInArrow(run, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n"))


# seeds and nodes


def effective() -> Column:
    """How many witnesses docs documents are: how many signatures they have, less what
    copies with small changes add to the signature that they share."""
    docs = F.col("docs").cast("double")
    square = F.sqrt(sum((F.col(c).cast("double") * F.col(c) for c in _signs), F.lit(0.0)) / SIGNS)
    different = (LEASTS - 1) / sum(((F.col(c) + 1) / 2.0**31 for c in _leasts), F.lit(0.0))
    return F.greatest(F.lit(1.0), F.least(docs, different) - CHANGED * F.greatest(square, F.sqrt(docs)))


def log_odds(a: Column, b: Column, all_a: float, all_b: float) -> Column:
    return F.log((a + 0.5) / (F.lit(float(all_a)) - a + 0.5)) - F.log((b + 0.5) / (F.lit(float(all_b)) - b + 0.5))


def likelihood_ratio(a: Column, b: Column, all_a: float, all_b: float) -> Column:
    """G of a word that a of all_a things on one side and b of all_b on the other hold."""
    p = (a + b) / float(max(all_a + all_b, 1))

    def term(k: Column, q: Column) -> Column:
        return F.when(k > 0, k * F.log(k / q)).otherwise(0.0)

    n_a, n_b = F.lit(float(all_a)), F.lit(float(all_b))
    return 2 * (term(a, n_a * p) + term(n_a - a, n_a * (1 - p)) + term(b, n_b * p) + term(n_b - b, n_b * (1 - p)))


def least_ratio(tested: int) -> float:
    """The G that FALSE_WORDS of so many words are expected to reach by chance on one side."""
    lo, hi = 0.0, 400.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tested * 0.5 * math.erfc(math.sqrt(mid / 2)) > FALSE_WORDS else (lo, mid)
    return hi


def _tied(rows: DataFrame, a: Column, b: Column, all_a: float, all_b: float, odds: float) -> DataFrame:
    """The rows whose words side a holds more often, beyond doubt."""
    tested = rows.count()
    return rows.filter((log_odds(a, b, all_a, all_b) >= odds) & (likelihood_ratio(a, b, all_a, all_b) >= least_ratio(tested)))


@dataclass
class Lexicon:
    """Words' hashes in order, and their weights."""

    names: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def of(self, word: str) -> float:
        at = np.flatnonzero(self.names == word_hash(word))
        return float(self.weights[at[0]]) if len(at) else 0.0


def seeds(counts: DataFrame, toxic: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[int, float]], int]:
    """Words of the toxic pole and of the neutral one, segments and witnesses of each, and
    all segments."""
    none = np.zeros(0, np.int64)
    total = counts.filter(F.col("word") == ALL).first()
    if total is None or not total.toxic or not total.clean:
        return none, none, {}, 0
    own = counts.filter(F.col("word") != ALL)
    tested, path = C.written(own.filter(f"toxic >= {SUPPORT}").join(toxic.select("word", effective().alias("t")), "word"), "tested")
    t, c = F.col("t"), F.col("clean").cast("double")
    positive = _tied(tested, t, c, total.toxic, total.clean, SEED_ODDS).select("word", "n", t.alias("by")).collect()
    C.remove_path(counts.sparkSession, path)
    plain = log_odds(F.col("toxic").cast("double"), c, total.toxic, total.clean) < SEED_ODDS / 4
    negative = own.filter(plain & (F.col("clean") >= SUPPORT)).orderBy(F.desc("n"), "word").limit(NEUTRAL).select("word", "n").collect()
    n = {r.word: (r.n, r.by) for r in positive} | {r.word: (r.n, 0.0) for r in negative}
    return np.array(sorted(r.word for r in positive), np.int64), np.array(sorted(r.word for r in negative), np.int64), n, total.n


def joining(counts: DataFrame, near: DataFrame, known: np.ndarray, n_seg: int) -> list:
    """Rows (word, n, by) that aren't known and stand beside the source beyond doubt."""
    near, path = C.written(near, "near")
    total = near.filter(F.col("word") == ALL).first()
    found = []
    if total is not None and total.near < n_seg:
        tested, tested_path = C.written(near.filter((F.col("word") != ALL) & (F.col("near") >= SUPPORT)).join(counts.select("word", "n"), "word"), "tested")
        a = F.least(F.col("near").cast("double"), effective())
        b = (F.col("n") - F.col("near")).cast("double")
        rows = _tied(tested, a, b, total.near, n_seg - total.near, JOIN_ODDS).filter(a >= BESIDE * (a + b)).select("word", "n", a.alias("by")).collect()
        old = set(known.tolist())
        found = [r for r in rows if r.word not in old]
        C.remove_path(near.sparkSession, tested_path)
    C.remove_path(near.sparkSession, path)
    return found


# the walk


def edges(i: np.ndarray, j: np.ndarray, n: np.ndarray, size: np.ndarray, total: int, most: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges i, j and their weights: those that are among the strongest `most` of either end."""
    ppmi = np.log(np.maximum(n * float(total), 1) / (size[i] * size[j].astype(float))) * (n / (n + 1.0))
    ok = ppmi > 0
    i, j, ppmi = i[ok], j[ok], ppmi[ok]
    end, other, at = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((other, -np.tile(ppmi, 2), end))
    nth = np.arange(len(order)) - np.searchsorted(end[order], end[order])
    keep = np.unique(at[order[nth < most]])
    return i[keep], j[keep], ppmi[keep]


def walk(i: np.ndarray, j: np.ndarray, weight: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Weights from -1 to 1 of the nodes, by two walks with restart over the edges."""
    v = len(positive)
    if not v or not positive.any():
        return np.zeros(v)
    out = np.bincount(i, weight, v) + np.bincount(j, weight, v)

    def run(seeds: np.ndarray) -> np.ndarray:
        start = seeds / max(seeds.sum(), 1)
        p = start.copy()
        for _ in range(STEPS):
            flow = p / np.where(out > 0, out, 1)
            p = RESTART * start + (1 - RESTART) * (np.bincount(j, flow[i] * weight, v) + np.bincount(i, flow[j] * weight, v) + p * (out <= 0))
        return p

    p, q = run(positive.astype(float)), run(negative.astype(float))
    both = p + q
    return np.where(both > 0, (p - q) / np.where(both > 0, both, 1), 0.0)


def induce(docs: DataFrame, marked: DataFrame) -> Lexicon:
    """The lexicon, without the words of the neutral pole. What comes to the driver is the
    words that pass a test, and their pairs."""
    counts, path = C.written(term_counts(docs, marked), "terms")
    positive, negative, n, n_seg = seeds(counts, near_counts(_marked(docs, marked.filter("label > 0"), "inner"), None))
    if not len(positive):
        C.remove_path(docs.sparkSession, path)
        return Lexicon()
    node = positive
    for _ in range(HOPS):
        rows = joining(counts, near_counts(_lowered(docs), node), np.concatenate([node, negative]), n_seg)
        if not rows:
            break
        n |= {r.word: (r.n, r.by) for r in rows}
        node = np.concatenate([node, np.array(sorted(r.word for r in rows), np.int64)])
    C.remove_path(docs.sparkSession, path)
    names = np.concatenate([node, negative])
    neutral = np.arange(len(names)) >= len(node)
    table = pair_counts(docs, names, neutral).toArrow()
    i, j, k = (table.column(c).to_numpy() for c in ("i", "j", "n"))
    order = np.lexsort((j, i))
    size, by = (np.array(x) for x in zip(*(n[w] for w in names.tolist())))
    graph = edges(i[order], j[order], k[order], size, n_seg)
    weights = walk(*graph, np.arange(len(names)) < len(positive), neutral) * by / (by + PRIOR)
    weights = weights[: len(node)].round(9)
    order = np.argsort(node)
    return Lexicon(node[order], weights[order])


# scores


def with_score(df: DataFrame, lexicon: Lexicon, text: str = "text", name: str = "score") -> DataFrame:
    """df with the score of each text, rounded to six places."""
    df = df.drop(name)
    held = df.sparkSession.sparkContext.broadcast((lexicon.names, lexicon.weights))
    n = len(df.columns)

    def run(batches):
        names, weights = held.value
        for whole in batches:
            for batch in C.slices(whole, "low"):
                score = np.zeros(batch.num_rows)
                if len(names):
                    h, row, _ = words(*C.flat_text(batch.column(n)))
                    at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                    found = np.flatnonzero(names[at] == h)
                    key = np.unique(row[found] * len(names) + at[found])
                    score = np.bincount(key // len(names), weights[key % len(names)], batch.num_rows).astype(float).round(6)
                yield C.batch_of(batch, n, pa.array(score))
        C.trim()

    return C.with_columns(df, run, f"`{name}` double", {"low": F.lower(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))})


def threshold(scores: DataFrame, marked: DataFrame) -> float:
    """The least score that at most MAX_FALSE of the clean documents of marked reach."""
    clean = C.sized(marked.filter("label = 0").select("doc_id"))
    by_score = scores.join(clean, "doc_id").groupBy("score").count().collect()
    left = sum(r["count"] for r in by_score)
    allowed = MAX_FALSE * left
    least = LEAST_SCORE
    for r in sorted(by_score, key=lambda r: r.score):
        if left <= allowed:
            break
        left -= r["count"]
        least = max(LEAST_SCORE, r.score + 1e-6)
    return least


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score and toxic; columns of those names are replaced."""
    docs = docs.drop("score", "toxic")
    with C.small_batches(docs.sparkSession):
        marked, _path = C.written(marked_labels(labels).withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0), "marked")
        lexicon = induce(docs, marked.filter("NOT held").drop("held"))
        held = marked.filter("held").drop("held")
        clean = C.sized(held.filter("label = 0").select("doc_id"))
        some = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").join(clean, "doc_id")
        light, _path = C.written(with_score(some, lexicon).drop("text"), "scores")
        least = threshold(light, held)
    C.trim()
    return with_score(docs, lexicon).withColumn("toxic", F.col("score") >= F.lit(least))


def op7_toxicity_lexicon(spark, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    return score_documents(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")).select("doc_id", "score", "toxic")
