"""Exact substring deduplication with suffix arrays.

A suffix array is sorted in two stages: only the suffixes smaller than their successors are sorted directly, all others
are induced by one scan over the buckets of first bytes. Common prefixes of neighbours then show which strings of
`length` bytes are equal. Order counts up to `length` bytes only.

Every removal is read off such arrays, that is, decided on bytes; hashes only route. Spark runs over blocks of whole
documents (see owners.py):

1. Every string of `length` bytes has a least GRAM-byte substring by hash, its anchor. Consecutive strings with one anchor
   make a stretch. Which anchors do other blocks have too? Strings around an anchor that occurs at one place only can't repeat.
2. A block sorts the strings of all other stretches: of equal ones, all but the first go. The first ones, if other blocks
   have their anchor, are sent as bytes to the anchor's owner, stretch by stretch. Where more than `many` blocks share an
   anchor, its strings are sent one by one to owners by their own hash, so no owner gets all contexts of a frequent phrase.
3. An owner sorts the strings of all blocks in a suffix array and answers for each whether an earlier one is equal.

So a passage that a third of all documents hold reaches its owner once for each block.

Defined cases: a null or empty text has no bytes; a text shorter than `length` loses nothing; rows that share a doc_id
count as separate texts in the order of a hash of their text; a null doc_id counts as larger than all others; columns
beyond id and text aren't read; a text of any length is one block's, whose arrays take some 40 bytes for each of its bytes
that may repeat; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import owners as own
from .textarrays import INVERSE, U64, between, byte_sums, covered, flat, mix, powers, runs, span_hash

GRAM = 48
PIECE = 1 << 18
PLACE = U64((1 << 30) - 1)
EVERY_BIT = U64((1 << 64) - 1)


def next_words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """At these positions, the next eight bytes as a big-endian number; data ends with eight zeros at least."""
    return np.ndarray((len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))[at].astype(np.uint64)


def padded(data: np.ndarray, more: int) -> np.ndarray:
    return np.concatenate([data, np.zeros(more + 8, np.uint8)])


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the empty suffix at the end is the smallest of all."""
    n = len(data)
    change = np.flatnonzero(data[1:] != data[:-1])  # the last place of each run of equal bytes
    out = np.zeros(n, dtype=bool)
    if len(change):
        size = np.diff(np.concatenate([[-1], change]))
        out[: change[-1] + 1] = np.repeat(data[change] < data[change + 1], size)
    return out


def sort_directly(at: np.ndarray, data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes at these positions by their first `depth` bytes at least. data: padded by depth and eight bytes."""
    key = next_words(data, at)
    by = np.argsort(key)
    order, key = at[by], key[by]
    tie = key[1:] == key[:-1]
    place = np.arange(len(order))
    done = 8
    while done < depth and tie.any():
        # Only members of groups that are tied so far are looked at again; place: where in the order they stand.
        member = np.concatenate([[False], tie]) | np.concatenate([tie, [False]])
        head = member & ~np.concatenate([[False], tie])
        place, head = place[member], head[member]
        pos = order[place]
        key = next_words(data, pos + done)
        group = np.cumsum(head) - 1
        differs = ~head[1:] & (key[1:] != key[:-1])
        if differs.any():
            uneven = np.zeros(group[-1] + 1, dtype=bool)
            uneven[group[1:][differs]] = True
            some = np.flatnonzero(uneven[group])
            by = np.lexsort((key[some], group[some]))
            pos[some], key[some] = pos[some][by], key[some][by]
            order[place] = pos
        tie = ~head[1:] & (key[1:] == key[:-1])
        done += 8
    return order


def closed(wanted: np.ndarray, small: np.ndarray) -> np.ndarray:
    """The wanted suffixes and those whose order induces theirs: of each, the successors up to the first small one."""
    # Only the places after the last wanted one of a run can be missing.
    out = wanted.copy()
    more = np.flatnonzero(wanted[:-1] & ~wanted[1:])
    while len(more):
        more = more[~small[more]] + 1
        more = more[more < len(out)]
        more = more[~out[more]]
        out[more] = True
    return out


def suffix_array(data: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The wanted (else all) suffixes in the order of their first `depth` bytes.

    Zeros count as following the end, so a suffix that reaches it may stand beside one that goes on with zeros."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    small = smaller_than_next(data)
    place = np.int32 if n + depth + 8 < 1 << 31 else np.int64
    needed = np.ones(n, bool) if wanted is None else closed(wanted, small)
    directly = sort_directly(np.flatnonzero(small & needed).astype(place), padded(data, depth), depth)
    by_byte = np.searchsorted(data[directly], np.arange(257))
    turn = np.flatnonzero((data[1:] != data[:-1]) | (needed[1:] != needed[:-1])) + 1
    begin = np.zeros(n, dtype=place)  # where each place's run of one needed byte begins
    begin[turn] = turn
    np.maximum.accumulate(begin, out=begin)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[n - 1]:
        waiting[data[n - 1]].append(np.array([n - 1], dtype=place))  # the empty suffix comes first and induces the last one
    out = []
    for c in range(256):
        found = directly[by_byte[c] : by_byte[c + 1]]
        if waiting[c]:
            # A suffix that starts with the same byte comes after its successor: runs are entered by distance from their ends.
            wave = np.concatenate(waiting[c])
            size = wave - begin[wave] + 1
            if size.max() > 1:
                steps = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                wave = (np.repeat(wave, size) - steps.astype(place))[np.argsort(steps, kind="stable")]
            found = np.concatenate([wave, found])
            waiting[c] = []
        if len(found):
            before = found[found > 0] - 1
            before = before[needed[before] & (data[before] > c)]
            if len(before):
                first = data[before]
                by = np.argsort(first, kind="stable")
                before, first = before[by], first[by]
                at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])).tolist()
                for i, j in zip(at, [*at[1:], len(before)], strict=True):
                    waiting[first[i]].append(before[i:j])
            out.append(found)
    sa = np.concatenate(out) if out else np.zeros(0, place)
    return sa if wanted is None else sa[wanted[sa]]


def equal_neighbours(sa: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """For each place but the first: whether the common prefix with the place before has `length` bytes."""
    whole = sa + length <= len(data)
    same = whole[1:] & whole[:-1]
    live, ahead = np.flatnonzero(same), padded(data, length)
    for done in range(0, length, 8):
        keep = EVERY_BIT if done + 8 <= length else EVERY_BIT ^ U64((1 << 8 * (8 - (length - done))) - 1)
        eq = ((next_words(ahead, sa[live] + done) ^ next_words(ahead, sa[live + 1] + done)) & keep) == 0
        same[live[~eq]] = False
        live = live[eq]
    return same


def groups(data: np.ndarray, wanted: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The wanted starts in the order of their strings of `length` bytes, and the number of each one's group of equals."""
    sa = suffix_array(data, length, wanted)
    if not len(sa):
        return sa, sa
    return sa, np.cumsum(np.concatenate([[0], ~equal_neighbours(sa, data, length)]))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values."""
    n = len(values)
    pad = (-n) % width
    x = np.concatenate([values, np.full(pad, ~U64(0))]).reshape(-1, width)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def stretches_of(data: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """First and end start of each run of valid strings of `length` bytes with one anchor, the anchor's place and its hash.

    Grams are compared by the upper 34 bits of their hash, the leftmost of equal ones first: a choice by content alone.
    Works through the bytes in pieces that stay in the cache; a stretch may be cut where a piece ends.
    """
    gram, n = min(GRAM, length), len(data) - length + 1
    out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
    for lo in range(0, n, PIECE):
        piece, ok = data[lo : min(lo + PIECE, n) + length - 1], valid[lo : min(lo + PIECE, n)]
        sums = byte_sums(piece)
        grams = (sums[gram:] - sums[:-gram]) * powers(len(piece), INVERSE)[: len(piece) - gram + 1]
        packed = grams * U64(0xD6E8FEB86659FD93)
        packed &= ~PLACE
        packed |= np.arange(len(packed), dtype=np.uint64)
        place = (sliding_least(packed, length - gram + 1) & PLACE).astype(np.int64)
        head = ok.copy()
        head[1:] &= ~ok[:-1] | (place[1:] != place[:-1])
        tail = ok.copy()
        tail[:-1] &= ~ok[1:] | head[1:]
        start = np.flatnonzero(head)
        out.append((start + lo, np.flatnonzero(tail) + 1 + lo, place[start] + lo, mix(grams[place[start]])))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


class Block:
    """One block's documents as bytes, in order, and its stretches: first and end start, and their anchors' place and hash."""

    def __init__(self, t: pa.Table, length: int):
        self.table, self.rank = own.ordered(t)
        self.data, self.rows = flat(self.table.column("text"))
        self.n, self.length = len(self.data), length
        valid = np.ones(max(0, self.n - length + 1), dtype=bool)  # strings within one document
        valid[between(np.maximum(self.rows[1:] - length + 1, self.rows[:-1]), self.rows[1:], self.n)[: len(valid)]] = False
        self.start, self.end, self.place, self.anchor = stretches_of(self.data, valid, length)

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.rows, at, side="right") - 1

    def keys(self) -> np.ndarray:
        x = np.sort(self.anchor)
        return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x

    def local(self, answered: pa.Table, n_owners: int) -> tuple[np.ndarray, np.ndarray]:
        """After the first answer: starts of strings that an earlier one in this block equals, and of those that have to be asked about."""
        keys, inverse = np.unique(self.anchor, return_inverse=True)
        low, high = np.full(len(keys), self.n), np.zeros(len(keys), np.int64)
        np.minimum.at(low, inverse, self.place)
        np.maximum.at(high, inverse, self.place)
        again, elsewhere = (low < high)[inverse], own.told(keys, n_owners, answered)[0][inverse]
        asked = between(self.start[elsewhere], self.end[elsewhere], self.n)
        inside = between(self.start[again], self.end[again] + self.length - 1, self.n)
        origin = np.flatnonzero(inside)
        at, group = groups(self.data[inside], between(self.start[again], self.end[again], self.n)[inside], self.length)
        if len(at):
            at = origin[at]
            first = np.minimum.reduceat(at, np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])))
            at = at[at != first[group]]
            asked[at] = False
        return at, np.flatnonzero(asked)

    def items(self, first: np.ndarray, answered: pa.Table, n_owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What to send of these strings, in order of keys: key, first start and number of strings of each run of a stretch."""
        stretch = np.searchsorted(self.start, first, side="right") - 1
        keys, inverse = np.unique(self.anchor, return_inverse=True)
        often = own.told(keys, n_owners, answered)[1][inverse][stretch] if len(first) else np.zeros(0, bool)
        head = np.ones(len(first), dtype=bool)
        head[1:] = (first[1:] != first[:-1] + 1) | (stretch[1:] != stretch[:-1]) | often[1:]
        at = np.flatnonzero(head)
        key, start, count = self.anchor[stretch[at]], first[at], np.diff(np.concatenate([at, [len(first)]]))
        alone = np.flatnonzero(often[at])
        for lo in range(0, len(alone), PIECE):
            some = alone[lo : lo + PIECE]
            begin = int(start[some[0]])
            s = start[some] - begin
            key[some] = span_hash(byte_sums(self.data[begin : int(start[some[-1]]) + self.length]), s, s + self.length)
        by = np.argsort(key, kind="stable")
        return key[by], start[by], count[by]


def message(b: Block, start: np.ndarray, count: np.ndarray) -> bytes:
    """Runs of strings as bytes, with the ranks of their documents."""
    docs, doc = np.unique(b.doc(start), return_inverse=True)
    size = count + b.length - 1
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return own.bundle(b.rank[docs].astype("<u8").tobytes(), own.planes(doc), own.planes(count), b.data[at].tobytes())


def earlier(asked: DataFrame, length: int) -> DataFrame:
    """For each string of each message, whether another block has an equal one of an earlier document."""

    def answer(t: pa.Table) -> pa.Table:
        if t.column("owner")[0].as_py() < 0:  # a block's message to itself
            return t.rename_columns(["block", "owner", "bits"])
        ranks, docs, counts, datas, n_docs = [], [], [], [], 0
        for m in t.column("items").to_pylist():
            rank, doc, count, data = own.unbundle(m)
            ranks.append(np.frombuffer(rank, dtype="<u8").reshape(-1, 2))
            docs.append(own.from_planes(doc).astype(np.int64) + n_docs)
            counts.append(own.from_planes(count).astype(np.int64))
            datas.append(np.frombuffer(data, dtype=np.uint8))
            n_docs += len(ranks[-1])
        rank, doc, count, data = (np.concatenate(x) for x in (ranks, docs, counts, datas))
        by = np.lexsort((rank[:, 1], rank[:, 0]))
        new = np.concatenate([[True], (rank[by][1:] != rank[by][:-1]).any(axis=1)])
        place = np.empty(n_docs, dtype=np.int64)
        place[by] = np.cumsum(new)
        size = count + length - 1
        start = np.cumsum(size) - size
        wanted = between(start, start + count, len(data))
        at, group = groups(data, wanted, length)
        who = np.repeat(place[doc].astype(np.int32), size)[at]
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        hit = np.zeros(len(data), dtype=bool)
        hit[at] = who > np.minimum.reduceat(who, heads)[group]
        hit = hit[wanted]
        ends = np.cumsum([c.sum() for c in counts])
        bits = [np.packbits(x).tobytes() for x in np.split(hit, ends[:-1])]
        return pa.table({"block": t.column("block"), "owner": t.column("owner"), "bits": pa.array(bits, pa.binary())})

    return asked.groupBy("owner").applyInArrow(answer, own.ANSWER)


def questions(docs: DataFrame, length: int, block_bytes: int, many: int, *keep: str) -> tuple[DataFrame, DataFrame]:
    """The blocks, and the answers to both questions."""
    blocks, n = own.blocks_of(docs, block_bytes, *keep)
    n_owners = n, 4 * n  # strings that may repeat are several times as long as the texts they stand in

    def first_ask(block: int, t: pa.Table, _: list) -> pa.Table:
        return own.ask(block, n_owners[0], Block(t, length).keys())

    def second_ask(block: int, t: pa.Table, answered: list) -> pa.Table:
        b = Block(t, length)
        again, first = b.local(answered[0], n_owners[0])
        key, start, count = b.items(first, answered[0], n_owners[0])
        at = own.cuts(key, n_owners[1])
        owner = np.flatnonzero(np.diff(at))
        items = [message(b, start[at[i] : at[i + 1]], count[at[i] : at[i + 1]]) for i in owner]
        # What it has found itself comes back with the answers, so no array is sorted twice.
        gone = runs(covered(again, length, b.n))
        items.append(own.bundle(*map(own.planes, (*gone, at, start, count))))
        return pa.table({"block": pa.array([block] * len(items), pa.int32()), "owner": pa.array([*owner.tolist(), -1 - block], pa.int32()), "items": pa.array(items, pa.binary())})

    first = own.shared(own.with_answers(blocks, [], first_ask, own.ASK), many)
    second = earlier(own.with_answers(blocks, [first], second_ask, "block int, owner int, items binary"), length)
    return blocks, second


def repeats(answered: pa.Table, length: int, n: int) -> np.ndarray:
    """After all answers: which of a block's bytes stand in strings that start earlier too."""
    owners, bits = answered.column("owner").to_pylist(), answered.column("bits").to_pylist()
    lo, hi, at, start, count = (own.from_planes(x).astype(np.int64) for x in own.unbundle(bits[owners.index(min(owners))]))
    hit = [np.zeros(0, np.int64)]
    for owner, b in zip(owners, bits, strict=True):
        if owner >= 0:
            s, c = start[at[owner] : at[owner + 1]], count[at[owner] : at[owner + 1]]
            strings = np.repeat(s - (np.cumsum(c) - c), c) + np.arange(c.sum())
            hit.append(strings[np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=len(strings)).astype(bool)])
    return covered(np.concatenate(hit), length, n) | between(lo, hi, n)


def removed_bytes(docs: DataFrame, length: int = 100, block_bytes: int = own.BLOCK_BYTES, many: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans, kept (binary): documents without the bytes of strings that start earlier too.

    spans: the maximal removed runs as start and end byte.
    """
    blocks, answered = questions(docs, length, block_bytes, many)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(block: int, t: pa.Table, answered: list) -> pa.Table:
        t, _ = own.ordered(t)
        data, rows = flat(t.column("text"))
        gone = repeats(answered[0], length, len(data))
        spans, kept, removed = [], [], []
        for lo, hi in zip(rows, rows[1:], strict=False):
            flags, text = gone[lo:hi], data[lo:hi]
            n = int(flags.sum())
            removed.append(n)
            kept.append((text[~flags] if n else text).tobytes())
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(*runs(flags), strict=True)] if n else [])
        return pa.table({"doc_id": t.column("doc_id"), "n_bytes": pa.array(np.diff(rows), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary())})

    return own.with_answers(blocks, [answered], remove, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")


def shortened(docs: DataFrame, length: int = 100, keep: str = "other", block_bytes: int = own.BLOCK_BYTES, many: int = 256) -> DataFrame:
    """doc_id, text and a column to keep: documents without repeats; a character that loses a byte goes as a whole. A null text becomes empty."""
    blocks, answered = questions(docs, length, block_bytes, many, keep)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), blocks.schema[keep]])

    def shorten(block: int, t: pa.Table, answered: list) -> pa.Table:
        t, _ = own.ordered(t)
        data, rows = flat(t.column("text"))
        gone = repeats(answered[0], length, len(data))
        texts = []
        for lo, hi in zip(rows, rows[1:], strict=False):
            flags, text = gone[lo:hi], data[lo:hi]
            if flags.any():
                character = np.cumsum((text & 0xC0) != 0x80) - 1
                text = text[(np.bincount(character, weights=flags) == 0)[character]]
            texts.append(text.tobytes().decode())
        return pa.table({"doc_id": t.column("doc_id"), "text": pa.array(texts, pa.string()), keep: t.column(keep)})

    return own.with_answers(blocks, [answered], shorten, schema)
