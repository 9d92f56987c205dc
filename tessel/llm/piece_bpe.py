"""SentencePiece encoding and decoding of merge-type (BPE) models in one pass over each text.

The encoding of a prefix has one last token; it tells all others, as the encoding up to where it starts ends in another
last token. So a table of one token for each prefix is filled from left to right: an Aho-Corasick automaton gives the
pieces that end at a position, and the one that is compatible with the last token before it is the entry (two tokens are
compatible if merging their joined text gives just the two). Ids are then recovered backwards. No merge queue is kept.

Pieces of such models hold the space mark in front only, so a text falls apart into stretches that start with space
marks, encoded alone and remembered for each worker: the latest `remember` at least, twice as many at most. A character without a piece becomes the
byte pieces of its UTF-8 form; nothing merges across it.

Defined cases: a null is an empty text; an empty text has no ids; the space mark itself in a text is read as a space, as
the library does; equal rows give equal rows; columns beyond id and text aren't read; an empty table gives no rows.
"""

import re

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .lineage import slices

MARK = "▁"
_loaded: dict[str, "Codec"] = {}


def foreign(proto) -> str | None:
    """What a model asks for that this codec doesn't do, or None."""
    own, normal = proto.trainer_spec, proto.normalizer_spec
    if own.model_type != own.BPE:
        return "a model type other than merges"
    if own.treat_whitespace_as_suffix:
        return "space marks behind words"
    if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not normal.escape_whitespaces:
        return "a normaliser"
    if any(p.type == p.USER_DEFINED for p in proto.pieces):
        return "pieces defined by a user"
    return None


class Codec:
    def __init__(self, model: str, remember: int = 200_000):
        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        reason = foreign(sentencepiece_model_pb2.ModelProto.FromString(lib.serialized_model_proto()))
        if reason:
            raise ValueError(f"this model asks for {reason}, which is not done here")
        self.pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i) for i in range(len(self.pieces))]
        self.bytes_at = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if lib.is_byte(i)}
        self.value = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.ids = {p: i for i, (p, s) in enumerate(zip(self.pieces, special, strict=True)) if not s}
        self.score = {p: lib.get_score(i) for p, i in self.ids.items()}
        if len(self.bytes_at) != 256 or any(MARK in p.lstrip(MARK) for p in self.ids) or any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("this model is not of the merge type with byte pieces and leading space marks")
        self.sizes, self.names = list(map(len, self.pieces)), list(map(str, range(len(self.pieces))))
        self.automaton, self.tables = ahocorasick.Automaton(), {}
        for p, i in self.ids.items():
            if self.merged(p) == [i]:  # other pieces never come out
                self.tables[i] = {-1: True}  # by the last token before: whether the two are compatible
                self.automaton.add_word(p, (i, len(p), self.tables[i].get))
        self.automaton.make_automaton()
        self.n_pairs, self.remember, self.known, self.older = 0, remember, {}, {}

    def merged(self, text: str) -> list[int]:
        """The definition: join the neighbours whose joined text is the piece of the best score, the leftmost first, until none is left. For short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return [self.ids[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: int, b: int) -> bool:
        if self.n_pairs >= 3 * self.remember:
            for t in self.tables.values():
                t.clear()
                t[-1] = True
            self.n_pairs = 0
        self.n_pairs += 1
        ok = self.tables[b][a] = self.merged(self.pieces[a] + self.pieces[b]) == [a, b]
        return ok

    def stretch(self, text: str) -> list[int]:
        """Ids of a text that has space marks in front only."""
        last = [-1] * (len(text) + 1)  # last token of the prefix up to each place; -1: it ends in a character without a piece. The entry behind the end stands for the empty prefix
        settled = -1
        for end, (piece, size, compatible) in self.automaton.iter(text):
            if end != settled:
                before = last[end - size]
                ok = compatible(before)
                if ok or ok is None and self.fits(before, piece):
                    last[end] = piece
                    settled = end
        out, at, sizes = [], len(text) - 1, self.sizes
        while at >= 0:
            piece = last[at]
            if piece < 0:
                out.extend(self.bytes_at[b] for b in reversed(text[at].encode()))
                at -= 1
            else:
                out.append(piece)
                at -= sizes[piece]
        out.reverse()
        return out

    def decoded(self, ids: list[int]) -> bytes:
        return b"".join([self.value[i] for i in ids])

    def encode(self, text: str) -> list[tuple[str, str]]:
        """For each stretch of the text: its ids as text, and the stretch decoded from its ids."""
        if not text:
            return []
        parts = re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
        out = list(map(self.known.get, parts))
        if None in out:
            for k, x in enumerate(out):
                if x is None:
                    out[k] = self.known.get(parts[k]) or self.learnt(parts[k])
        return out

    def learnt(self, part: str) -> tuple[str, str]:
        """Two generations are remembered: what is asked for again moves to the new one, the rest goes with the old one."""
        x = self.older.get(part)
        if x is None:
            ids, names = self.stretch(part), self.names
            x = (",".join([names[i] for i in ids]), self.decoded(ids).decode(errors="replace"))
            if len(part) > 64:
                return x
        if len(self.known) >= self.remember:
            self.older, self.known = self.known, {}
        self.known[part] = x
        return x


def codec(model: str) -> Codec:
    """One for each worker process and model."""
    if model not in _loaded:
        _loaded[model] = Codec(model)
    return _loaded[model]


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by commas), decoded (the text from these ids). model: path of the model file on every worker."""

    def run(batches):
        c = codec(model)
        for b in slices(batches):
            n, ids, decoded = [], [], []
            for text in b.column("text").to_pylist():
                parts = c.encode(text or "")
                ids.append(",".join([p[0] for p in parts]))
                n.append(ids[-1].count(",") + 1 if parts else 0)
                decoded.append("".join([p[1] for p in parts])[1:])  # the mark in front is not the text's
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")
