"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The text is cut into pre-tokens by a pattern; each distinct pre-token is encoded once
per worker. Pairs that can merge wait in buckets, one for each merge rank, that hold
positions of a linked list of tokens. A bitmap of three levels of 64-bit words says
which buckets hold anything, so that find-first-set on each level gives the next rank
in constant time; entries that an earlier merge made stale are skipped when they come
up. The cost follows the number of merges, whatever the length of a pre-token, where
the usual scan for the least rank takes quadratic time.

`encode_one` is the plain form, one pre-token and one entry at a time. `encode_many`
puts many pre-tokens in one linked list with borders and takes a bucket's entries at
once with array operations.

Rows: a null text gives null token ids, 0 tokens and a round trip of true; an empty
text an empty list. Repeated rows are encoded alike. Long texts are never cut.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces of text whose ids a worker keeps.
CACHE = 800_000
#: Bytes of text that are cut before what is new in them is encoded, and new pieces after
#: which it is encoded anyway.
GROUP_BYTES = 40 << 20
PENDING = 400_000
#: Bytes of new words in the linked list at a time.
QUEUE_BYTES = 2 << 20
NONE = np.int32(2**31 - 1)
#: Bytes up to which words may be encoded in step.
SHORT = 32
MADE = ["token_ids", "n_tokens", "n_bytes", "round_trip"]


class RankQueue:
    """Ranks that have waiting entries, as a bitmap of three levels."""

    def __init__(self) -> None:
        self.top = 0
        self.mid: list[int] = [0] * 64
        self.low: list[int] = [0] * 4096
        self.buckets: dict[int, list] = {}

    def push(self, rank: int, entry) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [entry]
            a, b = rank >> 6, rank >> 12
            self.low[a] |= 1 << (rank & 63)
            self.mid[b] |= 1 << (a & 63)
            self.top |= 1 << b
        else:
            bucket.append(entry)

    def first(self) -> int:
        """The least rank that waits, or -1."""
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        a = (b << 6) | ((self.mid[b] & -self.mid[b]).bit_length() - 1)
        return (a << 6) | ((self.low[a] & -self.low[a]).bit_length() - 1)

    def take(self, rank: int) -> list:
        a, b = rank >> 6, rank >> 12
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        return self.buckets.pop(rank)


class Vocabulary:
    def __init__(self, raw: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        if max(ranks.values()) >= 64**3:
            raise ValueError("the queue holds ranks below 262144")
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.size = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pairs = pairs
        self._table(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32))
        by_id = [b""] * self.size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.token_len = np.array([len(t) for t in by_id], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])[:-1]
        self.token_bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def _table(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing: a key stands in the first free slot from its own on."""
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.merged = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free, first = np.unique(slot, return_index=True)
            first = first[self.keys[free] == -1]
            self.keys[slot[first]], self.merged[slot[first]] = keys[first], ranks[first]
            left = self.keys[slot] != keys
            keys, ranks, slot = keys[left], ranks[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        slot = self._slot(key)
        got, out = self.keys[slot], self.merged[slot]
        wrong = np.flatnonzero(got != key)
        out[wrong] = NONE
        on = wrong[got[wrong] != -1]
        slot = slot[on]
        while len(on):
            slot = (slot + 1) & self.mask
            got = self.keys[slot]
            hit = got == key[on]
            out[on[hit]] = self.merged[slot[hit]]
            go = ~hit & (got != -1)
            on, slot = on[go], slot[go]
        return out

    def encode_one(self, word: bytes) -> list[int]:
        """The plain form: entries one by one, leftmost first within a rank."""
        import heapq

        n = len(word)
        tok = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        queue = RankQueue()

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (r := self.pairs.get(tok[i] * self.size + tok[j])) is not None:
                queue.push(r, i)

        for i in range(n):
            offer(i)
        while (r := queue.first()) >= 0:
            bucket = queue.take(r)
            heapq.heapify(bucket)
            while bucket:
                i = heapq.heappop(bucket)
                j = nxt[i] if alive[i] else n
                if j >= n or self.pairs.get(tok[i] * self.size + tok[j]) != r:
                    continue  # stale
                tok[i], alive[j], nxt[i] = r, False, nxt[j]
                if nxt[j] < n:
                    prv[nxt[j]] = i
                if prv[i] >= 0:
                    offer(prv[i])
                offer(i)
                if 0 <= queue.first() < r:  # a lower rank came up: it goes first
                    for k in bucket:
                        queue.push(r, k)
                    bucket = []
        return [t for t, a in zip(tok, alive) if a]

    def encode_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after another, and how many each has."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        n = int(lens.sum())
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        tok = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)].copy()
        ends = np.cumsum(lens)
        starts = ends - lens
        nxt = np.arange(1, n + 1, dtype=np.int32)
        prv = np.arange(-1, n - 1, dtype=np.int32)
        filled = lens > 0
        nxt[ends[filled] - 1] = -1
        prv[starts[filled]] = -1
        alive = np.ones(n, bool)
        rank_at = np.full(n, NONE, np.int32)
        has = np.flatnonzero(nxt >= 0)
        rank_at[has] = self.rank(tok[has], tok[has + 1])
        queue = RankQueue()
        odd: list[np.ndarray] = []

        def offer(at: np.ndarray) -> None:
            r = rank_at[at]
            at, r = at[r != NONE], r[r != NONE]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            begin = 0
            for end, rank in zip([*cuts.tolist(), len(r)], r[np.append(0, cuts)].tolist()):
                queue.push(rank, at[begin:end])
                begin = end

        offer(has)
        while (r := queue.first()) >= 0:
            bucket = queue.take(r)
            at = bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))
            at = at[rank_at[at] == r]  # the others are stale
            if not len(at):
                continue
            if len(at) > 1:
                # neighbours overlap: of a run, every other one merges, from the left
                linked = np.zeros(len(at), bool)
                linked[1:] = nxt[at[:-1]] == at[1:]
                if linked.any():
                    idx = np.arange(len(at))
                    head = np.maximum.accumulate(np.where(linked, 0, idx))
                    at = at[(idx - head) % 2 == 0]
            gone = nxt[at]
            tok[at] = r
            after = nxt[gone]
            nxt[at] = after
            alive[gone] = False
            rank_at[gone] = NONE
            more = after >= 0
            prv[after[more]] = at[more]
            rank_at[at] = NONE
            here = at[more]
            rank_at[here] = self.rank(tok[here], tok[after[more]])
            before = prv[at]
            before = before[before >= 0]
            rank_at[before] = self.rank(tok[before], tok[nxt[before]])
            touched = np.concatenate([here, before])
            low = touched[rank_at[touched] < r]
            if len(low):
                odd.append(low)  # the order within a word matters there: done over below
            offer(np.unique(touched))
        ids = tok[alive]
        word_of = np.repeat(np.arange(len(words)), lens)
        counts = np.bincount(word_of[alive], minlength=len(words))
        if odd:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for w in np.unique(word_of[np.concatenate(odd)]).tolist():
                parts[w] = np.array(self.encode_one(words[w]), np.int32)
            counts = np.array([len(p) for p in parts], np.int64)
            ids = np.concatenate(parts)
        return ids, counts

    def encode_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As encode_many, for words that are short: those of one length are a matrix, of
        which each step merges the first least pair of every row. The cost follows the
        words, not the number of ranks, so few words are encoded fast as well."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        flat = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        at = np.cumsum(lens) - lens
        counts = np.zeros(len(words), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(lens[lens > 0]).tolist():
            who = np.flatnonzero(lens == n)
            tok = flat[at[who][:, None] + np.arange(n)]
            rank = self.rank(tok[:, :-1].ravel(), tok[:, 1:].ravel()).reshape(len(who), n - 1)
            while True:
                if tok.shape[1] == 1:
                    ends = np.ones(len(who), bool)
                else:
                    first = rank.argmin(1)
                    low = rank[np.arange(len(who)), first]
                    ends = low == NONE
                if ends.any():
                    counts[who[ends]] = tok.shape[1]
                    done.append((np.repeat(who[ends], tok.shape[1]), tok[ends].ravel()))
                    if ends.all():
                        break
                    go = ~ends
                    who, tok, rank, first, low = who[go], tok[go], rank[go], first[go], low[go]
                rows, wide = np.arange(len(who)), tok.shape[1] - 1
                tok[rows, first] = low
                tok = np.take_along_axis(tok, np.arange(wide) + (np.arange(wide) > first[:, None]), 1)
                rank = np.take_along_axis(rank, np.arange(wide - 1) + (np.arange(wide - 1) >= first[:, None]), 1)
                left, right = first > 0, first < wide - 1
                rank[rows[left], first[left] - 1] = self.rank(tok[rows[left], first[left] - 1], tok[rows[left], first[left]])
                rank[rows[right], first[right]] = self.rank(tok[rows[right], first[right]], tok[rows[right], first[right] + 1])
        if not done:
            return np.zeros(0, np.int32), counts
        word, ids = (np.concatenate(x) for x in zip(*done))
        return ids[np.argsort(word, kind="stable")].astype(np.int32), counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all token lists, one after another, and how many each has."""
        lens = self.token_len[ids]
        out = gather(self.token_bytes, self.token_at[ids], lens)
        row = np.concatenate([[0], np.cumsum(counts)])
        total = np.concatenate([[0], np.cumsum(lens)])
        return out, np.diff(total[row])


def gather(values: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """values[a : a + n] for each a and n, one after another."""
    ends = np.cumsum(lens)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(at - (ends - lens), lens) + np.arange(ends[-1])]


class Encoder:
    """Texts to token ids, with a cache of what stands between spaces.

    A space between two characters that aren't white space always begins a pre-token, so
    such a text may be cut there and each piece be cut by the pattern once. Pieces are cut,
    hashed to 64 bits and looked up with array operations; only new ones become strings.
    Keys of the cache: a piece's hash, which says whether a space stands before it or it
    begins a text; two spaces and a pre-token, for texts with other white space."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN, cache: int = CACHE, queue: bool = True) -> None:
        """queue: every word goes through the rank queue; else only those over SHORT bytes."""
        import regex

        self.vocabulary, self.find, self.most, self.queue = vocabulary, regex.compile(pattern).findall, cache, queue
        self.by_space = pattern == PATTERN
        self.clear()

    def clear(self) -> None:
        self.index: dict[str | int, int] = {}
        self.ids, self.at, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.places, self.pending = 0, []

    def _place(self, words: list[str]) -> np.ndarray:
        """Places in the cache of pre-tokens, after two spaces; new ones get theirs at once,
        and are encoded by learn()."""
        index = self.index
        which = np.fromiter(map(index.get, words, repeat(-1)), np.int32, len(words))
        missing = np.flatnonzero(which == -1).tolist()
        if missing:
            own = [words[i] for i in missing]
            new = list(dict.fromkeys(own))
            index.update(zip(new, range(self.places, self.places + len(new))))
            self.places += len(new)
            self.pending += new
            which[missing] = np.fromiter(map(index.__getitem__, own), np.int32, len(own))
        return which

    def learn(self) -> None:
        """Encodes what is pending, much at a time: the queue's steps follow the number of
        ranks, not of words."""
        keys, self.pending = self.pending, []
        if not keys:
            return
        alone = [i for i, k in enumerate(keys) if k[-1] == " " or k[:2] == "  "]
        apart = set(alone)
        inner = [k for i, k in enumerate(keys) if i not in apart] if alone else keys
        # pieces put together are a text that is cut at each space, as where they came from
        tokens = self.find(" " + " ".join(inner)) if inner else []
        sizes = np.diff(np.append(np.flatnonzero(np.array([t[0] == " " for t in tokens], bool)), len(tokens)))
        more = [[keys[i][2:]] if keys[i][:2] == "  " else self.find(keys[i][:-1]) for i in alone]
        tokens += [t for own in more for t in own]
        sizes = np.append(sizes, np.array([len(own) for own in more], np.int64))
        known = dict.fromkeys(tokens)
        known.update(zip(known, range(len(known))))
        ids, counts = self._encode([t.encode() for t in known])
        at = np.cumsum(counts) - counts
        each = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        lens = counts[each]
        total = np.concatenate([[0], np.cumsum(lens)])
        count = np.diff(total[np.concatenate([[0], np.cumsum(sizes)])])
        begin = len(self.ids) + np.cumsum(count) - count
        if alone:  # back to the order of places
            order = np.argsort(np.append(np.setdiff1d(np.arange(len(keys)), alone), alone))
            count, begin = count[order], begin[order]
        self.at, self.count = np.append(self.at, begin), np.append(self.count, count)
        self.ids = np.append(self.ids, gather(ids, at[each], lens))

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.queue:
            return self._queued(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        long = np.flatnonzero(lens > SHORT).tolist()
        if not long:
            return self.vocabulary.encode_short(words)
        few = set(long)
        ids, counts = self.vocabulary.encode_short([w for i, w in enumerate(words) if i not in few])
        more, of_long = self._queued([words[i] for i in long])
        order = np.argsort(np.append(np.flatnonzero(lens <= SHORT), long))
        counts, begin = np.append(counts, of_long), np.append(np.cumsum(counts) - counts, len(ids) + np.cumsum(of_long) - of_long)
        return gather(np.append(ids, more), begin[order], counts[order]), counts[order]

    def _queued(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum([len(w) for w in words])
        cuts = [0, *np.searchsorted(ends, np.arange(QUEUE_BYTES, ends[-1], QUEUE_BYTES)).tolist(), len(words)]
        ids, counts = zip(*(self.vocabulary.encode_many(words[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b))
        return np.concatenate(ids), np.concatenate(counts)

    def _cut(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which texts may be cut at spaces (no two white spaces together there, none at
        either end), and where their pieces begin and end."""
        space = flat == 32
        white = space | (flat == 10)
        bad = np.flatnonzero(white[:-1] & white[1:] & (space[:-1] | space[1:]))
        row = np.searchsorted(at, bad, "right") - 1
        lens = np.diff(at)
        plain = (lens > 0) & self.by_space
        plain[row[bad + 1 < at[row + 1]]] = False
        full = np.flatnonzero(lens)
        plain[full[space[at[full]] | space[at[full + 1] - 1]]] = False
        inner = np.flatnonzero(space)
        inner = inner[plain[np.searchsorted(at, inner, "right") - 1]]
        heads = at[:-1][plain]
        starts, ends = np.concatenate([heads, inner + 1]), np.concatenate([inner, at[1:][plain]])
        starts.sort()
        ends.sort()
        return plain, starts, ends

    def probe(self, flat: np.ndarray, at: np.ndarray, texts: Callable[[], list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the cache of all texts' pieces, and how many each text has."""
        plain, starts, ends = self._cut(flat, at)
        which = np.zeros(0, np.int32)
        n_words = np.zeros(len(at) - 1, np.int64)
        if len(starts):
            up, down = C._powers(len(flat))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)])])
            first = np.zeros(len(flat) + 1, bool)
            first[at[:-1][plain]] = True
            h = C.mix64(C.mix64((total[ends] - total[starts]) * down[starts]) + ((ends - starts) << 1 | first[starts]).astype(np.uint64))
            order = np.argsort(h)
            new = np.append(True, np.diff(h[order]) != 0)
            where = order[new]
            names, of = h[where], np.empty(len(h), np.int64)
            of[order] = np.cumsum(new) - 1
            places = np.fromiter(map(self.index.get, names.tolist(), repeat(-1)), np.int32, len(names))
            missing = np.flatnonzero(places == -1)
            if len(missing):
                data = flat.tobytes()
                for i, key, s, e in zip(missing.tolist(), names[missing].tolist(), starts[where[missing]].tolist(), ends[where[missing]].tolist()):
                    core = data[s:e].decode()
                    if core[0].isspace() or core[-1].isspace():
                        places[i] = self.index[key] = -2
                        continue
                    self.pending.append(core + " " if first[s] else core)
                    places[i] = self.index[key] = self.places
                    self.places += 1
            which = places[of]
            n_words = np.diff(np.searchsorted(starts, at))
        rest = np.flatnonzero(~plain & (np.diff(at) > 0)).tolist()
        if rest:
            own, parts = texts(), np.split(which, np.cumsum(n_words)[:-1])
            for i in rest:
                parts[i] = self._place(["  " + t for t in self.find(own[i])])
            which, n_words = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        if len(self.pending) > PENDING:
            self.learn()
        return which, n_words

    def finish(self, probe: tuple, texts: Callable[[], list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after another, and how many each has."""
        which, n_words = probe
        if (which == -2).any():
            # texts whose white space shows only at a piece's end are cut by the pattern
            whole = np.unique(np.repeat(np.arange(len(n_words)), n_words)[which == -2]).tolist()
            own, parts = texts(), np.split(which, np.cumsum(n_words)[:-1])
            for i in whole:
                parts[i] = self._place(["  " + t for t in self.find(own[i])])
            self.learn()
            which, n_words = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        lens = self.count[which]
        total = np.concatenate([[0], np.cumsum(lens)])
        return gather(self.ids, self.at[which], lens), np.diff(total[np.concatenate([[0], np.cumsum(n_words)])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.forget()
        probe = self.probe(*C.flat_text(pa.array(texts, pa.string())), lambda: texts)
        self.learn()
        return self.finish(probe, lambda: texts)

    def forget(self) -> None:
        """Empties a cache that is full; not between probe and finish."""
        if len(self.index) > self.most:
            self.clear()


def same_bytes(decoded: np.ndarray, sizes: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the decoded texts are the texts of flat."""
    same_size = sizes == np.diff(at)
    good = same_size.copy()
    if same_size.all():
        good[np.searchsorted(at, np.flatnonzero(decoded != flat), "right") - 1] = False
    else:
        d = np.concatenate([[0], np.cumsum(sizes)])
        for i in np.flatnonzero(same_size):
            good[i] = np.array_equal(decoded[d[i] : d[i + 1]], flat[at[i] : at[i + 1]])
    return good


_ready: dict[int, Encoder] = {}


def _encoder(raw: bytes, pattern: str, queue: bool = True) -> Encoder:
    key = hash((raw, pattern, queue))
    if key not in _ready:
        _ready[key] = Encoder(Vocabulary(raw), pattern, queue=queue)
    return _ready[key]


def encode(df: DataFrame, text: str = "text", vocab_path: str = DEFAULT_VOCAB, pattern: str = PATTERN, check: bool = True, queue: bool = True) -> DataFrame:
    """df with token_ids, n_tokens, n_bytes (of the UTF-8 text) and round_trip (whether
    decoding the ids gives the text's bytes again; null without check). Columns of those
    names are replaced. Without queue, short words are encoded in step (the ids are the same).
    One narrow pass; the vocabulary file is read on the driver and broadcast (its size
    is that of the file, whatever the data)."""
    with open(vocab_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(df.columns) if c == text or c not in MADE])
    n = len(df.columns)

    def one(batch, texts, ids, counts, encoder):
        flat, at = C.flat_text(texts)
        good = pa.array(same_bytes(*encoder.vocabulary.decode(ids, counts), flat, at)) if check else pa.nulls(len(texts), pa.bool_())
        lists = C.list_array(ids, counts, pa.int32(), texts.is_null() if texts.null_count else None)
        return C.batch_of(batch, n, lists, pa.array(counts, pa.int32()), pa.array(np.diff(at), pa.int64()), good)

    def run(batches):
        encoder = _encoder(shared.value, pattern, queue)
        for whole in batches:
            for group in C.slices(whole, "text", GROUP_BYTES):
                encoder.forget()
                parts = list(C.slices(group, "text"))
                probes = [encoder.probe(*C.flat_text(p.column(n)), p.column(n).to_pylist) for p in parts]
                encoder.learn()
                for batch, probe in zip(parts, probes):
                    yield one(batch, batch.column(n), *encoder.finish(probe, batch.column(n).to_pylist), encoder)

    done = C.with_columns(df, run, "token_ids array<int>, n_tokens int, n_bytes bigint, round_trip boolean", {"text": F.col(f"`{text}`").cast("string")})
    return done.toDF(*df.columns, *MADE) if text not in MADE else done.toDF(*[f"__{i}" for i in range(n)], *MADE).select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(df.columns) if c != text], *MADE)


def decode(df: DataFrame, ids: str = "token_ids", vocab_path: str = DEFAULT_VOCAB) -> DataFrame:
    """df with decoded, the text of its token ids; bytes that aren't UTF-8 become U+FFFD.
    A null list gives null, as does one with an id that the vocabulary lacks or a null."""
    with open(vocab_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    df = df.drop("decoded")
    n = len(df.columns)

    def run(batches):
        v = _encoder(shared.value, PATTERN).vocabulary
        for batch in batches:
            out = []
            for row in batch.column(n).to_pylist():
                if row is None or any(i is None or not 0 <= i < v.size for i in row):
                    out.append(None)
                else:
                    out.append(v.decode(np.array(row, np.int64), np.array([len(row)]))[0].tobytes().decode("utf-8", "replace"))
            yield C.batch_of(batch, n, pa.array(out, pa.string()))

    return C.with_columns(df, run, "decoded string", {"ids": F.col(f"`{ids}`")})


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's token ids under a public 50k byte-level vocabulary, decoded again."""
    return encode(C.read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
