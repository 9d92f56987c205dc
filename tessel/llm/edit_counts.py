"""Token counts that follow edits without encoding a text anew.

built() splits and encodes each document once and keeps its segment tree as two arrays, the characters and the tokens of
each pre-token. edited() takes such trees with edits and returns them updated, so batches of edits follow one another; a
document without edits isn't encoded again. In a tree the pre-tokens are leaves, LEAF to a node, and nodes above hold sums.

An edit is located by descending the tree. Splitting restarts at the pre-token that holds the character `context` before
the edit, and stops at the first boundary behind the edit that the old text has too: what follows is the same, as a match
depends on nothing before it. Only new pre-tokens are encoded; the sums of the touched leaves' ancestors are updated.
context: how many characters behind its end may decide where a pre-token ends. 4 holds for the patterns of the common
byte-pair tokenizers; a pattern that looks further ahead, as over a whole run of spaces, needs a larger one.

Defined cases: a null is an empty text of 0 tokens; null or no edits change nothing; edits apply one after another, each
to the text that the earlier ones left; bounds beyond the text are cut to it, an end before its start counts as the
start, a null bound counts as 0, a null replacement as empty; equal rows give equal rows; a long text is held with some
20 bytes for each pre-token; columns beyond those named aren't read; an empty table gives no rows.
"""

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import slices

CONTEXT = 4
LEAF = 32
_loaded: dict[tuple[str, str], "Counter"] = {}


class Counter:
    """Splits texts and counts the tokens of pre-tokens, with a bounded memory of counts."""

    def __init__(self, ranks: str, pattern: str, remember: int = 500_000):
        with open(ranks, "rb") as f:
            pairs = [line.split() for line in f]
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.pattern, self.remember, self.known = regex.compile(pattern), remember, {}

    def counts(self, pieces: list[str]) -> list[int]:
        out = list(map(self.known.get, pieces))
        if None in out:
            if len(self.known) >= self.remember:
                self.known.clear()
            for k, n in enumerate(out):
                if n is None:
                    out[k] = self.known.get(pieces[k])
                    if out[k] is None:
                        out[k] = len(self.encoding.encode_ordinary(pieces[k]))
                        if len(pieces[k]) <= 64:
                            self.known[pieces[k]] = out[k]
        return out


def counter(ranks: str, pattern: str) -> Counter:
    if (ranks, pattern) not in _loaded:
        _loaded[ranks, pattern] = Counter(ranks, pattern)
    return _loaded[ranks, pattern]


class CountTree:
    """A text, its pre-tokens in leaves of about LEAF, and sums over a binary tree of the leaves."""

    def __init__(self, text: str, counter: Counter, kept: tuple[list[int], list[int]] | None = None, context: int = CONTEXT):
        """kept: characters and tokens of the pre-tokens, from an earlier tree of this text."""
        self.text, self.counter, self.encoded, self.context = text, counter, 0, context
        if kept is None:
            pieces = counter.pattern.findall(text)
            kept = list(map(len, pieces)), counter.counts(pieces)
        self._build(*kept)

    def leaves(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of all pre-tokens."""
        return [c for x in self.chars for c in x], [c for x in self.tokens for c in x]

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.chars = [chars[i : i + LEAF] for i in range(0, len(chars), LEAF)] or [[]]
        self.tokens = [tokens[i : i + LEAF] for i in range(0, len(tokens), LEAF)] or [[]]
        self.width = 1 << (len(self.chars) - 1).bit_length()
        pad = [0] * (self.width - len(self.chars))
        self.char_sums = [0] * self.width + list(map(sum, self.chars)) + pad
        self.token_sums = [0] * self.width + list(map(sum, self.tokens)) + pad
        for k in range(self.width - 1, 0, -1):
            self.char_sums[k] = self.char_sums[2 * k] + self.char_sums[2 * k + 1]
            self.token_sums[k] = self.token_sums[2 * k] + self.token_sums[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.token_sums[1]

    @property
    def n_pieces(self) -> int:
        return sum(map(len, self.chars))

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf, place in it and start of the pre-token that holds a character; beyond the text, the end."""
        if at >= self.char_sums[1]:
            return len(self.chars) - 1, len(self.chars[-1]), self.char_sums[1]
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if at >= start + self.char_sums[k]:
                start += self.char_sums[k]
                k += 1
        leaf, place = k - self.width, 0
        while at >= start + self.chars[leaf][place]:
            start += self.chars[leaf][place]
            place += 1
        return leaf, place, start

    def _sum_up(self, leaf: int) -> None:
        k = self.width + leaf
        self.char_sums[k], self.token_sums[k] = sum(self.chars[leaf]), sum(self.tokens[leaf])
        while k > 1:
            k //= 2
            self.char_sums[k] = self.char_sums[2 * k] + self.char_sums[2 * k + 1]
            self.token_sums[k] = self.token_sums[2 * k] + self.token_sums[2 * k + 1]

    def edit(self, start: int, end: int, replacement: str) -> None:
        size = len(self.text)
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        self.text = self.text[:start] + replacement + self.text[end:]
        shift = len(replacement) - (end - start)
        leaf, place, begin = self._find(max(0, start - self.context))
        last, stop, old = self._find(end)  # the first old boundary not before the edit's end
        if old < end:
            old += self.chars[last][stop]
            stop += 1
        pieces, at = [], begin
        if at != old + shift or at < start + len(replacement):
            for m in self.counter.pattern.finditer(self.text, begin):
                pieces.append(m.group())
                at = m.end()
                while old + shift < at and (last < len(self.chars) - 1 or stop < len(self.chars[last])):
                    while stop == len(self.chars[last]):
                        last, stop = last + 1, 0
                    old += self.chars[last][stop]
                    stop += 1
                    while stop == len(self.chars[last]) and last < len(self.chars) - 1:
                        last, stop = last + 1, 0
                if at == old + shift and at >= start + len(replacement):
                    break
        counts = self.counter.counts(pieces)
        self.encoded += len(pieces)
        tail_chars, tail_tokens = self.chars[last][stop:], self.tokens[last][stop:]
        touched = range(leaf, last + 1)
        self.chars[leaf] = self.chars[leaf][:place] + list(map(len, pieces)) + tail_chars
        self.tokens[leaf] = self.tokens[leaf][:place] + counts + tail_tokens
        for k in touched:
            if k > leaf:
                self.chars[k], self.tokens[k] = [], []
        if len(self.chars[leaf]) > 4 * LEAF or len(touched) > 8:
            self._build([c for x in self.chars for c in x], [c for x in self.tokens for c in x])
        else:
            for k in touched:
                self._sum_up(k)


def built(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, text, n_tokens, chars, tokens: the tree of each document, its pre-tokens' characters and tokens as arrays of 32-bit numbers.

    ranks: path of the rank file on every worker."""

    def run(batches):
        c = counter(ranks, pattern)
        for b in slices(batches):
            n_tokens, chars, tokens = [], [], []
            for text in b.column("text").to_pylist():
                pieces = c.pattern.findall(text or "")
                count = c.counts(pieces)
                n_tokens.append(sum(count))
                chars.append(np.fromiter(map(len, pieces), dtype="<u4", count=len(pieces)).tobytes())
                tokens.append(np.array(count, dtype="<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(n_tokens, pa.int64()), pa.array(chars, pa.binary()), pa.array(tokens, pa.binary())], ["doc_id", "text", "n_tokens", "chars", "tokens"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.mapInArrow(run, "doc_id long, text string, n_tokens long, chars binary, tokens binary")


def edited(trees: DataFrame, ranks: str, pattern: str, edits: str = "edits", context: int = CONTEXT) -> DataFrame:
    """The columns of built() after the edits; n_tokens_before, n_chars, n_pieces (pre-tokens), n_encoded (pre-tokens encoded for the edits).

    edits: a column of arrays of (start, end, replacement), in characters.
    """

    def run(batches):
        c = counter(ranks, pattern)
        for b in slices(batches):
            out = []
            for doc_id, text, n_tokens, chars, tokens, changes in zip(*(b.column(k).to_pylist() for k in ("doc_id", "text", "n_tokens", "chars", "tokens", "edits")), strict=True):
                changes = [e for e in changes or () if e is not None]
                if not changes:
                    out.append((doc_id, text, n_tokens, chars, tokens, n_tokens, len(text), len(chars) // 4, 0))
                    continue
                tree = CountTree(text, c, tuple(np.frombuffer(x, "<u4").tolist() for x in (chars, tokens)), context)
                for e in changes:
                    tree.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
                out.append((doc_id, tree.text, tree.n_tokens, *(np.array(x, dtype="<u4").tobytes() for x in tree.leaves()), n_tokens, len(tree.text), tree.n_pieces, tree.encoded))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "text", "n_tokens", "chars", "tokens", "n_tokens_before", "n_chars", "n_pieces", "n_encoded"])

    trees = trees.select("doc_id", "text", "n_tokens", "chars", "tokens", F.col(edits).cast("array<struct<start: long, end: long, replacement: string>>").alias("edits"))
    return trees.mapInArrow(run, "doc_id long, text string, n_tokens long, chars binary, tokens binary, n_tokens_before long, n_chars long, n_pieces long, n_encoded long")
