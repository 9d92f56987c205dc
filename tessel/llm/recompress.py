"""Substring deduplication by recompression.

Rounds of recompression turn each document into fewer and longer symbols, whose names Spark agrees on globally: words and
runs of one word first, then, round by round, pairs of neighbours of which the first has a 0 and the second a 1 as a coin,
a function of its name. Equal phrases so get equal symbols inside, whatever stands around them. Each symbol knows its
context, the words that its place in the parse depends on: every window of words that holds the context holds the symbol.

A symbol that only one place of the corpus has gets no name, and windows that hold its context can't repeat. So each round
looks at less, and in the end all symbols of the windows left are shared. Then each window has an anchor, the longest
symbol whose context it holds. Equal windows have equal anchors at equal places, so they are verified at their anchor:
the symbol by its name, what stands left and right of it in the window word by word. Hashes route and sort, they decide
nothing: names stand for one content each, as owners number the distinct contents themselves.

Each block of documents (some MB) is one row of words and numbers, shuffled once. For each round a block asks the owners of its distinct contents for their names (see owners.py for the exchange);
a phrase that a third of all documents hold costs one entry for each block. Windows that a block holds several times are
settled there first, and one of each kind is sent to the owner of its anchor, consecutive ones of one anchor together;
windows whose anchor is a single word or a symbol of more than `many` blocks go to owners by a hash of the window instead.

Defined cases: a null or blank text has no words; a text of fewer words than a window loses nothing; rows that share a
doc_id don't remove each other's words; a null doc_id counts as larger than all others; columns beyond id and text
aren't read; a text of any length is one block's, whose arrays take some 100 bytes for each word; an empty table gives an
empty result.
"""

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import owners as own
from .lineage import slices
from .textarrays import U64, between, covered, mix, prefix_sums, runs, span_hash, word_names

#: Rounds that name pairs, after the one that names words and runs.
ROUNDS = 4
#: Before this round the symbols and windows that are left are put aside, so that later rounds don't begin with the words.
CARRY = 2
#: Text for each owner, in blocks. Each block sends each owner a message in each round, so fewer owners are fewer messages.
OWNER_BLOCKS = 2
STATE = "size long, doc_ids binary, n_words binary, vocabulary binary, words binary"
ASK = "block long, owner int, asked binary"
ANSWER = "block long, owner int, answer binary"
#: In a name: the symbol is in several blocks, in very many blocks; then the round, the owner and the number.
ELSEWHERE, OFTEN = U64(1 << 63), U64(1 << 62)


class Numbers(dict):
    """A number for each key that is asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def in_halves(x: np.ndarray) -> bytes:
    """Numbers below 2**32, of which many sequences repeat."""
    return own.bundle((x & 0xFFFF).astype("<u2").tobytes(), (x >> 16).astype("<u2").tobytes())


def from_halves(data: bytes) -> np.ndarray:
    low, high = (np.frombuffer(x, "<u2").astype(np.int64) for x in own.unbundle(data))
    return high << 16 | low


def packed(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of whole documents of about block_bytes of text: ids, numbers of words, distinct words, and the words as numbers of these."""

    def block(rows: list[tuple], numbers: Numbers, size: int) -> pa.RecordBatch:
        ids = pa.array([r[0] for r in rows], pa.int64())
        data = [
            own.bundle(np.asarray(ids.is_null()).tobytes(), np.asarray(ids.fill_null(0)).astype("<i8").tobytes()), own.bundle(own.planes(np.array([len(r[1]) for r in rows]))),
            own.squeezed(b" ".join(numbers)), in_halves(np.concatenate([r[1] for r in rows])),
        ]
        return pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), *(pa.array([x], pa.binary()) for x in data)], ["size", "doc_ids", "n_words", "vocabulary", "words"])

    def run(batches):
        rows, numbers, size = [], Numbers(), 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = (text or b"").split()
                rows.append((doc_id, np.fromiter(map(numbers.__getitem__, words), dtype=np.uint32, count=len(words))))
                size += len(text or b"") + 64
                if size >= block_bytes:
                    yield block(rows, numbers, size)
                    rows, numbers, size = [], Numbers(), 0
        if rows:
            yield block(rows, numbers, size)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # In this order a task that is run again makes the same blocks, whatever order its rows come in.
    rows = rows.sortWithinPartitions(F.asc_nulls_last("doc_id"), F.xxhash64("text"), "text")
    return rows.mapInArrow(run, STATE).select(F.monotonically_increasing_id().alias("block"), "*")


def runs_of_words(words: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one word within a document. edge: where a document starts or all end."""
    head = np.ones(len(words), dtype=bool)
    head[1:] = (words[1:] != words[:-1]) | edge[1:-1]
    start = np.flatnonzero(head).astype(np.int32)
    return start, np.append(start[1:], np.int32(len(words))) if len(start) else start


class Symbols:
    """A level of the parse: names, first and end word, and the context's; only symbols that windows in question hold."""

    def __init__(self, name, start, end, left, right):
        self.name, self.start, self.end, self.left, self.right = name, start, end, left, right

    def pick(self, which: np.ndarray) -> "Symbols":
        if which.dtype == bool:  # places are found once for all columns
            which = np.flatnonzero(which)
        return Symbols(self.name[which], self.start[which], self.end[which], self.left[which], self.right[which])


def coins(name: np.ndarray, round_number: int) -> np.ndarray:
    return (mix((name & ~(ELSEWHERE | OFTEN)) + U64(0x632BE59BD9B4E019 * round_number & (2**64 - 1))) & U64(1)).astype(bool)


def pairs(s: Symbols, edge: np.ndarray, round_number: int) -> tuple[np.ndarray, Symbols]:
    """Places of the symbols that begin a pair, and the symbols that stay alone, with their contexts."""
    n = len(s.name)
    one = coins(s.name, round_number)
    near = np.zeros(n, dtype=bool)  # the next symbol follows at once, in the same document
    near[:-1] = (s.end[:-1] == s.start[1:]) & ~edge[s.start[1:]]
    pair = np.zeros(n, dtype=bool)
    pair[:-1] = near[:-1] & ~one[:-1] & one[1:]
    second = np.concatenate([[False], pair[:-1]])
    # A 0 stays alone because of what follows, a 1 because of what stands before; the context takes that in. If it's
    # unknown there, no window in question holds the context.
    after, before = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
    alone = ~pair & ~second & np.where(one, np.concatenate([[False], near[:-1]]), near)
    left = np.where(one, np.minimum(s.left, s.left[before]), s.left)
    right = np.where(one, s.right, np.maximum(s.right, s.right[after]))
    return np.flatnonzero(pair), Symbols(s.name, s.start, s.end, left, right).pick(alone)


def route(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Owner keys of pairs of names."""
    return mix(mix(a) + b)


class Parse:
    """A block's documents, parsed as far as names are known."""

    total: np.ndarray | None = None  # see so_far()

    def __init__(self, row: dict, window: int):
        self.heads = row["doc_ids"], row["n_words"]
        self.vocabulary = own.spread(row["vocabulary"]).split()
        self.words = from_halves(row["words"])
        self._documents(window, len(self.words))
        # Windows in question, by start: all within a document; later those whose symbols are all shared. elsewhere: by other blocks.
        self.open = np.zeros(self.n, dtype=bool)
        ends = np.arange(window, self.n + 1)
        self.open[: len(ends)] = self.doc[ends - 1] == self.doc[: len(ends)]
        self.elsewhere = self.open.copy()
        self.kinds: list[Symbols] = []  # symbols as each round has formed them
        self.now: Symbols | None = None

    def _documents(self, window: int, n: int) -> None:
        null, ids = own.unbundle(self.heads[0])
        self.ids = pa.array(np.frombuffer(ids, "<i8"), mask=np.frombuffer(null, bool))
        self.rank = own.doc_ranks(self.ids)
        self.n_words = own.from_planes(own.unbundle(self.heads[1])[0]).astype(np.int64)
        self.n, self.window = n, window
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        self.doc = np.repeat(np.arange(len(self.n_words), dtype=np.int32), self.n_words)
        self.edge = np.zeros(n + 1, dtype=bool)
        self.edge[self.first] = True

    def carried(self) -> bytes:
        """What later rounds need: the symbols and windows left, far less than the words."""
        parts = [*self.heads, self.n.to_bytes(8, "little"), np.packbits(self.open).tobytes(), np.packbits(self.elsewhere).tobytes()]
        for s in (self.now, *self.kinds[:-1]):  # the last kind is among the symbols of now
            s = s.pick(self.held(s))
            parts += [own.planes(s.name), own.planes(np.diff(s.start, prepend=0)), own.planes(s.end - s.start), own.planes(s.start - s.left), own.planes(s.right - s.end)]
        return own.bundle(*parts)

    @classmethod
    def resumed(cls, data: bytes, window: int) -> "Parse":
        p = cls.__new__(cls)
        parts = own.unbundle(data)
        p.heads = parts[0], parts[1]
        p._documents(window, int.from_bytes(parts[2], "little"))
        p.open, p.elsewhere = (np.unpackbits(np.frombuffer(x, np.uint8), count=p.n).astype(bool) for x in parts[3:5])
        symbols = []
        for i in range(5, len(parts), 5):
            name, step, size, left, right = map(own.from_planes, parts[i : i + 5])
            start = np.cumsum(step.astype(np.int32), dtype=np.int32)
            end = start + size.astype(np.int32)
            symbols.append(Symbols(name, start, end, start - left.astype(np.int32), end + right.astype(np.int32)))
        p.now, *p.kinds = symbols
        p.kinds.append(p.now.pick((p.now.name >> U64(58) & U64(15)) == CARRY))  # names tell their round, counted from 1
        return p

    def close(self, mask: np.ndarray, s: Symbols, which: np.ndarray) -> None:
        """Takes the windows that hold these symbols' contexts out of the mask."""
        which = np.flatnonzero(which)
        left, right = s.left[which], s.right[which]
        fits = right - left <= self.window
        if not fits.any():
            return
        steps = np.zeros(self.n + 1, dtype=np.int32)
        np.add.at(steps, np.maximum(right[fits] - self.window, 0).astype(np.intp), 1)
        np.add.at(steps, left[fits].astype(np.intp) + 1, -1)
        np.cumsum(steps, out=steps)
        mask &= steps[:-1] == 0
        if mask is self.open:
            self.total = None

    def so_far(self) -> np.ndarray:
        """How many windows in question start before each place; counted again only after some were closed."""
        if self.total is None:
            self.total = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(self.open, out=self.total[1:], dtype=np.int32)
        return self.total

    def held(self, s: Symbols) -> np.ndarray:
        """Which symbols' contexts some window in question holds."""
        total = self.so_far()
        out = (s.right - s.left <= self.window) & (s.left >= 0) & (s.right <= self.n)
        some = np.flatnonzero(out)
        low, high = np.maximum(s.right[some] - self.window, 0), s.left[some] + 1
        out[some] = total[np.maximum(high, low)] > total[low]
        return out

    def word_question(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words and runs: owner keys (sorted), numbers of words, lengths of runs (1: the word), whether there are several."""
        self.run_start, self.run_end = runs_of_words(self.words, self.edge)
        size = self.run_end - self.run_start
        long = size > 1
        word_count = np.bincount(self.words, minlength=len(self.vocabulary))
        both, self.run_kind, count = np.unique(self.words[self.run_start[long]] << 32 | size[long], return_inverse=True, return_counts=True)
        word = np.concatenate([np.arange(len(self.vocabulary)), both >> 32])
        length = np.concatenate([np.ones(len(self.vocabulary), np.int64), both & 0xFFFFFFFF])
        sizes = np.fromiter(map(len, self.vocabulary), dtype=np.int64, count=len(self.vocabulary))
        ends = np.cumsum(sizes + 1) - 1
        key = mix(word_names(np.frombuffer(b" ".join(self.vocabulary), np.uint8), ends - sizes, ends)[word] + length.astype(np.uint64) * U64(0x8CB92BA72F3D8DD7))
        order = np.argsort(key, kind="stable")
        self.places = np.empty(len(order), dtype=np.int64)
        self.places[order] = np.arange(len(order))
        return key[order], word[order], length[order], (np.concatenate([word_count, count]) > 1)[order]

    def learn_words(self, name: np.ndarray) -> None:
        """name: for what word_question() has asked; 0 for what is nowhere else."""
        name = name[self.places]
        word, run = name[: len(self.vocabulary)], name[len(self.vocabulary) :]
        self.word = word[self.words] if self.n else np.zeros(0, np.uint64)
        if self.now is not None:  # resumed: only the words' names were missing
            return
        at = np.arange(self.n, dtype=np.int32)
        single = Symbols(self.word, at, at + 1, at, at + 1)
        self.close(self.open, single, self.word == 0)
        self.close(self.elsewhere, single, (self.word & ELSEWHERE) == 0)
        start, end = self.run_start, self.run_end
        long = end - start > 1
        # A run is maximal because of its neighbours; at a document's edge no window tells.
        left, right = np.where(self.edge[start], start - 1 - self.window, start - 1), np.where(self.edge[end], end + 1 + self.window, end + 1)
        s = Symbols(run[self.run_kind], *(x[long] for x in (start, end, left, right)))
        self.formed(s)
        total = self.so_far()
        keep = (self.word[start] != 0) & (total[start] > total[np.maximum(end + 1 - self.window, 0)])  # in a window that goes on at both sides
        named = self.word[start]
        named[long] = s.name
        now = Symbols(*(x[keep] for x in (named, start, end, left, right)))
        self.now = now.pick((now.name != 0) & self.held(now))

    def formed(self, s: Symbols) -> None:
        """New symbols with their names: windows that hold nameless ones are closed."""
        self.close(self.open, s, s.name == 0)
        self.close(self.elsewhere, s, (s.name & ELSEWHERE) == 0)
        self.kinds.append(s.pick(s.name != 0))

    def pair_question(self, round_number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs: owner keys (sorted), first and second name, whether there are several."""
        s = self.now
        at, self.alone = pairs(s, self.edge, round_number)
        new = Symbols(np.zeros(len(at), np.uint64), s.start[at], s.end[at + 1], np.minimum(s.left[at], s.left[at + 1]), np.maximum(s.right[at], s.right[at + 1])) if len(at) else s.pick(at)
        keep = self.held(new)
        self.new, at = new.pick(keep), at[keep]
        a, b = s.name[at], s.name[at + 1] if len(at) else s.name[at]
        key = route(a, b)
        order = np.argsort(key)
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        if (~same & (key[order][1:] == key[order][:-1])).any():  # one key for several pairs
            order = np.lexsort((b, a, key))
            same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        head = np.concatenate([[True], ~same]) if len(at) else np.zeros(0, bool)
        self.kind = np.empty(len(at), dtype=np.int64)
        self.kind[order] = np.cumsum(head) - 1
        first = order[head]
        return key[first], a[first], b[first], np.bincount(self.kind, minlength=len(first)) > 1

    def learn_pairs(self, name: np.ndarray) -> None:
        self.new.name = name[self.kind]
        self.formed(self.new)
        both, alone = self.kinds[-1], self.alone
        order = np.argsort(np.concatenate([both.start, alone.start]), kind="stable")
        now = Symbols(*(np.concatenate([getattr(both, k), getattr(alone, k)])[order] for k in ("name", "start", "end", "left", "right")))
        self.now = now.pick(self.held(now))

    def question(self, round_number: int, n_owners: int) -> Callable[[int, int], bytes]:
        """Finds what a round asks; returns what packs a part of it."""
        if round_number == 0:
            key, word, length, several = self.word_question()
            part = lambda i, j: own.bundle(b"\n".join([self.vocabulary[k] if n == 1 else b"%b %d" % (self.vocabulary[k], n) for k, n in zip(word[i:j].tolist(), length[i:j].tolist(), strict=True)]), np.packbits(several[i:j]).tobytes())
        else:
            key, a, b, several = self.pair_question(round_number)
            part = lambda i, j: own.bundle(own.planes(a[i:j]), own.planes(b[i:j]), np.packbits(several[i:j]).tobytes())
        self.cuts = own.cuts(key, n_owners)
        return part

    def asked(self, round_number: int, n_owners: int) -> list[tuple[int, bytes]]:
        """What the block asks in a round, by owner."""
        part = self.question(round_number, n_owners)
        return [(i, part(self.cuts[i], self.cuts[i + 1])) for i in np.flatnonzero(np.diff(self.cuts)).tolist()]

    def learn(self, round_number: int, n_owners: int, answers: dict[int, bytes]) -> None:
        """Takes in the names that a round has given."""
        self.question(round_number, n_owners)
        name = np.zeros(self.cuts[-1], dtype=np.uint64)
        for owner, data in answers.items():
            name[self.cuts[owner] : self.cuts[owner + 1]] = own.from_planes(own.unbundle(data)[0])
        if round_number == 0:
            self.learn_words(name)
        else:
            self.learn_pairs(name)

    def with_words(self, row: dict, answers: dict[int, bytes], n_owners: int) -> None:
        """Gives a resumed parse its words' names."""
        self.vocabulary, self.words = own.spread(row["vocabulary"]).split(), from_halves(row["words"])
        self.learn(0, n_owners, answers)

    def windows(self) -> "Windows":
        """The windows in question at their anchors: the longest symbol that each holds with its context, of these the one of the largest mixed name, then the leftmost."""
        at = np.flatnonzero(self.open)
        s = Symbols(*(np.concatenate([getattr(x, k) for x in self.kinds]) for k in ("name", "start", "end", "left", "right")))
        s = s.pick(self.held(s))
        key = ((s.end - s.start).astype(np.uint64) << U64(58)) | mix(s.name) >> U64(6)
        s = s.pick(len(key) - 1 - np.argsort(key[::-1], kind="stable"))  # by length, then mixed name, then from right to left: the best last
        low = np.maximum(s.right - self.window, 0)
        size = s.left + 1 - low
        which = np.repeat(np.arange(len(size)), size)
        best = np.full(self.n, -1)
        best[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(len(which))] = which  # of several, the last one stays
        best = best[at]
        name, begin, end = np.zeros(len(at), np.uint64), at.copy(), at + 1
        some = best >= 0
        name[some], begin[some], end[some] = s.name[best[some]], s.start[best[some]], s.end[best[some]]
        bare = np.flatnonzero(~some)  # no symbol but single words
        if len(bare):
            mixed, first = mix(self.word), at[bare]
            top, place = mixed[first], first.copy()
            for k in range(1, self.window):
                better = mixed[first + k] > top
                top, place = np.where(better, mixed[first + k], top), np.where(better, first + k, place)
            name[bare], begin[bare], end[bare] = self.word[place], place, place + 1
        return Windows(self.word, at, name, begin - at, end - begin, self.window)

    def settled(self) -> tuple[np.ndarray, "Windows", np.ndarray, np.ndarray]:
        """Starts of windows that an earlier document of this block holds. Of each kind of windows that other blocks may hold one,
        of the smallest doc_id; and further ones of that doc_id: which of those they equal, and their starts."""
        w = self.windows()
        kind, rank = w.kinds(), self.rank[self.doc[w.at]]
        first = np.full(kind.max(initial=-1) + 1, len(kind))
        np.minimum.at(first, kind, np.arange(len(kind)))  # documents come in the order of their ids
        later = rank > rank[first][kind]
        send = np.sort(first[self.elsewhere[w.at[first]]])
        place = np.full(len(first), -1)
        place[kind[send]] = np.arange(len(send))
        more = np.flatnonzero(~later & (place[kind] >= 0))
        more = more[send[place[kind[more]]] != more]
        return w.at[later], w.pick(send), place[kind[more]], w.at[more]


class Windows:
    """Windows of words around their anchors. word: names of all words; at: starts; name, skip, size: the anchor's name, words before it and its length."""

    def __init__(self, word, at, name, skip, size, window):
        self.word, self.at, self.name, self.skip, self.size, self.window = word, at, name, skip, size, window

    def pick(self, which: np.ndarray) -> "Windows":
        return Windows(self.word, self.at[which], self.name[which], self.skip[which], self.size[which], self.window)

    def hashes(self) -> np.ndarray:
        """Of the anchor and the words beside it."""
        sums, middle = prefix_sums(self.word), self.at + self.skip
        left, right = span_hash(sums, self.at, middle), span_hash(sums, middle + self.size, self.at + self.window)
        return mix(mix(self.name + self.skip.astype(np.uint64) * U64(0x9E3779B97F4A7C15)) + left + right * U64(0xD6E8FEB86659FD93))

    def same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which windows are equal in pairs: the anchor by its name and place, what stands beside it word by word."""
        out = (self.name[i] == self.name[j]) & (self.skip[i] == self.skip[j])
        for k in range(self.window):
            beside = (k < self.skip[i]) | (k >= self.skip[i] + self.size[i])
            out &= ~beside | (self.word[self.at[i] + k] == self.word[self.at[j] + k])
        return out

    def kinds(self) -> np.ndarray:
        """A number for each kind of equal windows."""
        n = len(self.at)
        h = self.hashes()
        order = np.argsort(h)
        tie = h[order][1:] == h[order][:-1]
        equal = np.zeros(max(0, n - 1), dtype=bool)
        at = np.flatnonzero(tie)
        equal[at] = self.same(order[at], order[at + 1])
        if (tie & ~equal).any():  # one hash for several kinds: they are sorted by what they hold
            columns = [np.where((k < self.skip) | (k >= self.skip + self.size), self.word[self.at + k], U64(0)) for k in range(self.window)]
            order = np.lexsort((*columns, self.skip, self.name))
            equal = self.same(order[:-1], order[1:])
        out = np.empty(n, dtype=np.int64)
        out[order] = np.cumsum(np.concatenate([[0], ~equal])) if n else 0
        return out


def names(asked: DataFrame, round_number: int, many: int) -> DataFrame:
    """Owners number the distinct contents that are asked for, if more than one place has them; a name is 0 for all others."""

    def answer(t: pa.Table) -> pa.Table:
        owner = t.column("owner")[0].as_py()
        t = t.sort_by("block")  # names don't depend on the order of messages
        parts = [own.unbundle(x) for x in t.column("asked").to_pylist()]
        if round_number == 0:  # a word, or a word and the length of its run
            number = Numbers().__getitem__
            kind = [np.fromiter(map(number, p[0].split(b"\n")), dtype=np.int64) for p in parts]
        else:
            a, b = (np.concatenate([own.from_planes(p[k]) for p in parts]) for k in range(2))
            order = np.lexsort((b, a))
            head = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
            every = np.empty(len(a), dtype=np.int64)
            every[order] = np.cumsum(head) - 1
            kind = np.split(every, np.cumsum([len(own.from_planes(p[0])) for p in parts])[:-1])
        blocks = np.bincount(np.concatenate(kind))
        several = np.zeros(len(blocks), dtype=bool)
        for k, p in zip(kind, parts, strict=True):
            several[k[np.unpackbits(np.frombuffer(p[-1], np.uint8), count=len(k)).astype(bool)]] = True
        name = U64(round_number + 1 << 58 | owner << 30) + np.arange(len(blocks), dtype=np.uint64)
        name |= np.where(blocks > 1, ELSEWHERE, U64(0)) | np.where(blocks > many, OFTEN, U64(0))
        name[(blocks < 2) & ~several] = 0
        return pa.table({"block": t.column("block"), "owner": t.column("owner"), "answer": pa.array([own.bundle(own.planes(name[k])) for k in kind], pa.binary())})

    return asked.groupBy("owner").applyInArrow(answer, ANSWER)


class Sent(NamedTuple):
    order: np.ndarray  # the windows, as they go out
    cuts: np.ndarray  # where each owner's begin
    first: np.ndarray  # runs of consecutive windows, as they go out: start of the first, and how many
    count: np.ndarray
    messages: list[tuple[int, bytes]]  # what each owner gets


def sent(p: Parse, w: Windows, n_owners: int) -> Sent:
    """What goes to owners of windows: runs of consecutive ones of one anchor, as the anchor's name and the words beside it."""
    alone = (w.size == 1) | ((w.name & OFTEN) != 0)
    key = mix(w.name)
    key[alone] = w.pick(alone).hashes()
    begin = w.at + w.skip
    head = np.ones(len(w.at), dtype=bool)
    head[1:] = alone[1:] | alone[:-1] | (w.at[1:] != w.at[:-1] + 1) | (begin[1:] != begin[:-1]) | (w.size[1:] != w.size[:-1])
    run = np.cumsum(head) - 1
    owner = own.owner_of(key[head], n_owners)
    by = np.argsort(owner, kind="stable")  # of one owner, in order of position
    place = np.empty(len(by), dtype=np.int64)
    place[by] = np.arange(len(by))
    first, count = np.flatnonzero(head)[by], np.bincount(run, minlength=len(by))[by]
    run_cuts = np.searchsorted(owner[by], np.arange(n_owners + 1))
    messages = []
    for i in np.flatnonzero(np.diff(run_cuts)).tolist():
        f, c = first[run_cuts[i] : run_cuts[i + 1]], count[run_cuts[i] : run_cuts[i + 1]]
        docs, doc = np.unique(p.doc[w.at[f]], return_inverse=True)
        beside, start = around(w.skip[f], w.size[f], c, w.window)
        words = p.word[np.repeat(w.at[f] - start, c - 1 + w.window) + np.arange(len(beside))][beside]
        messages.append((i, own.bundle(p.rank[docs].astype("<u8").tobytes(), *map(own.planes, (doc, w.name[f], w.skip[f], w.size[f], c, words)))))
    return Sent(np.argsort(place[run], kind="stable"), np.concatenate([[0], np.cumsum(count)])[run_cuts], w.at[first], count, messages)


def around(skip: np.ndarray, size: np.ndarray, count: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the words of runs of windows, one run after another, those beside the anchors; and where each run begins."""
    length = count - 1 + window
    start = np.cumsum(length) - length
    steps = np.zeros(length.sum() + 1, dtype=np.int32)
    np.add.at(steps, start + skip, 1)
    np.add.at(steps, start + skip + size, -1)
    return np.cumsum(steps[:-1]) == 0, start


def earlier(asked: DataFrame, window: int) -> DataFrame:
    """For each window of each message, whether another block has an equal one of a smaller doc_id. A block's message to itself comes back as it is."""

    def answer(t: pa.Table) -> pa.Table:
        if t.column("owner")[0].as_py() < 0:
            return t.rename_columns(["block", "owner", "answer"])
        ranks, columns, n_docs = [], [], 0
        for m in t.column("asked").to_pylist():
            rank, *parts = own.unbundle(m)
            ranks.append(np.frombuffer(rank, dtype="<u8"))
            doc, name, *parts = map(own.from_planes, parts)
            columns.append((doc.astype(np.int64) + n_docs, name, *(x.astype(np.int64) for x in parts[:3]), parts[3]))
            n_docs += len(ranks[-1])
        rank = np.concatenate(ranks)
        doc, name, skip, size, count, words = (np.concatenate(x) for x in zip(*columns, strict=True))
        beside, start = around(skip, size, count, window)
        word = np.zeros(len(beside), dtype=np.uint64)
        word[beside] = words
        run = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        w = Windows(word, start[run] + step, name[run], skip[run] - step, size[run], window)
        kind, who = w.kinds(), rank[doc[run]]
        least = np.full(kind.max() + 1, ~U64(0))
        np.minimum.at(least, kind, who)
        ends = np.cumsum([c[4].sum() for c in columns])
        bits = [np.packbits(x).tobytes() for x in np.split(who > least[kind], ends[:-1])]
        return pa.table({"block": t.column("block"), "owner": t.column("owner"), "answer": pa.array(bits, pa.binary())})

    return asked.groupBy("owner").applyInArrow(answer, ANSWER)


def blockwise(state: DataFrame, answered: list[DataFrame], f: Callable[[dict, list[dict[int, bytes]]], pa.RecordBatch], schema: str) -> DataFrame:
    """f(a block's row, its answers of each round by owner) for each block."""
    columns = [f"answers_{k}" for k in range(len(answered))]
    for c, a in zip(columns, answered, strict=True):
        a = a.groupBy("block").agg(F.collect_list(F.struct("owner", "answer")).alias(c))
        state = state.join(a, "block", "left")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                yield f(row, [{x["owner"]: x["answer"] for x in row[c] or ()} for c in columns])

    return state.mapInArrow(run, schema)


def removed_words(docs: DataFrame, window: int = 13, block_bytes: int = own.BLOCK_BYTES, many: int = 256) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: documents without the words of windows that start in one with a smaller doc_id."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    n_owners = max(1, -(-size // (OWNER_BLOCKS * block_bytes)))
    state = packed(docs, block_bytes).repartition("block")  # one exchange, which all rounds share

    def parsed(row: dict, answers: list[dict[int, bytes]]) -> Parse:
        """From a block's words and the answers of all rounds."""
        p = Parse(row, window)
        for k, a in enumerate(answers):
            p.learn(k, n_owners, a)
        return p

    def carry(row: dict, answers: list[dict[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([parsed(row, answers).carried()], pa.binary())], ["block", "carried"])

    def resumed(row: dict, answers: list[dict[int, bytes]]) -> Parse:
        """From what a block has carried along, and the answers since."""
        p = Parse.resumed(row["carried"], window)
        for k, a in enumerate(answers, CARRY):
            p.learn(k, n_owners, a)
        return p

    def messages(row: dict, asked: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(asked), pa.int64()), pa.array([i for i, _ in asked], pa.int32()), pa.array([x for _, x in asked], pa.binary())], ["block", "owner", "asked"])

    def ask_names(k: int, start: Callable[[dict, list[dict[int, bytes]]], Parse]):
        return lambda row, answers: messages(row, start(row, answers).asked(k, n_owners))

    def ask_windows(row: dict, answers: list[dict[int, bytes]]) -> pa.RecordBatch:
        p = resumed(row, answers[1:])
        p.with_words(row, answers[0], n_owners)
        later, w, kind, more = p.settled()
        out = sent(p, w, n_owners)
        place = np.empty(len(w.at), dtype=np.int64)
        place[out.order] = np.arange(len(w.at))
        # What it has found itself comes back with the answers, so that nothing is parsed again.
        findings = (*runs(covered(later, window, p.n)), out.cuts, np.diff(out.first, prepend=0), out.count, place[kind], more)
        return messages(row, [*out.messages, (-1 - (row["block"] ^ row["block"] >> 33) % n_owners, own.bundle(*map(own.planes, findings)))])

    def remove(row: dict, answers: list[dict[int, bytes]]) -> pa.RecordBatch:
        p, answer = Parse(row, window), dict(answers[0])
        lo, hi, at, first, count, kind, more = (own.from_planes(x).astype(np.int64) for x in own.unbundle(answer.pop(min(answer))))
        first = np.cumsum(first)
        start = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        hit = np.zeros(len(start), dtype=bool)
        for owner, bits in answer.items():
            hit[at[owner] : at[owner + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=at[owner + 1] - at[owner]).astype(bool)
        gone = between(lo, hi, p.n) | covered(np.concatenate([start[hit], more[hit[kind]]]), window, p.n)
        total = np.concatenate([[0], np.cumsum(gone)])
        n_gone = total[p.first[1:]] - total[p.first[:-1]]
        words = np.array([*p.vocabulary, b""], dtype=object)[p.words[~gone]].tolist()
        ends = np.cumsum(p.n_words - n_gone)
        kept = [b" ".join(words[i:j]).decode() for i, j in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        return pa.RecordBatch.from_arrays([p.ids, pa.array(p.n_words), pa.array(n_gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    answered: list[DataFrame] = []
    for k in range(CARRY):
        answered.append(names(blockwise(state, answered, ask_names(k, parsed), ASK), k, many))
    left = blockwise(state, answered, carry, "block long, carried binary").repartition("block")
    for k in range(CARRY, ROUNDS + 1):
        answered.append(names(blockwise(left, answered[CARRY:], ask_names(k, resumed), ASK), k, many))
    found = earlier(blockwise(left.join(state, "block", "left"), [answered[0], *answered[CARRY:]], ask_windows, ASK), window)
    return blockwise(state, [found], remove, "doc_id long, n_words long, n_removed long, kept_text string")
