"""SentencePiece encoding and decoding by streaming Viterbi.

The lattice has a node after every character and an edge for every piece. Two
kinds of model are read:

* unigram: an edge weighs its piece's score, and the best path is the
  encoding;
* BPE: an edge is open only where its piece and the piece before it are
  stable side by side, that is, if merging their text by the model's ranks
  gives the two pieces back. A sequence is the model's encoding exactly if
  all its neighbours are stable, and each node is then reached by one path.

Either way only the last ``longest`` nodes (the longest piece's length) can
still be extended. Whenever all their backpointer paths meet in one node, the
ids up to it are final: they leave the window, which therefore stays short
however long the text is.

Pieces never continue over certain characters (a line break has no piece, a
word mark only begins pieces), so paths always meet there. Texts are cut at
such places first and the ids of recent parts are kept in a bounded memory.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, mapped, quoted, slices, spare, without

SPACE = "▁"
#: Parts whose ids a task remembers (two generations of half this size).
REMEMBERED = 400_000
#: Nodes after which the window looks for a common boundary.
CHECK_EVERY = 64


class Model:
    """Pieces, scores and kind of a SentencePiece model file.

    Models with an identity normalizer are supported, as those alone decode
    to the text they were given.
    """

    def __init__(self, source: str | bytes):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        raw = source if isinstance(source, bytes) else open(source, "rb").read()
        spec = proto.ModelProto.FromString(raw)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        kinds = proto.ModelProto.SentencePiece
        self.bpe = spec.trainer_spec.model_type == proto.TrainerSpec.BPE
        if spec.trainer_spec.model_type not in (proto.TrainerSpec.BPE, proto.TrainerSpec.UNIGRAM):
            raise ValueError("only unigram and BPE models")
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("the model's normalizer changes texts")
        self.prefix = norm.add_dummy_prefix
        self.unk = next(i for i, p in enumerate(spec.pieces) if p.type == kinds.UNKNOWN)
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.fallback = spec.trainer_spec.byte_fallback and len(self.byte_ids) == 256
        self.pieces = {p.piece: i for i, p in enumerate(spec.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        if any(p.type == kinds.USER_DEFINED for p in spec.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.scores = [p.score for p in spec.pieces]
        normal = [p.score for p in spec.pieces if p.type == kinds.NORMAL]
        self.unk_score = min(normal, default=0.0) - 10.0
        self.text = {i: p for p, i in self.pieces.items()}
        self.longest = max(map(len, self.pieces), default=1)
        order = {score: k for k, score in enumerate(sorted(set(normal), reverse=True))}
        self.rank = {i: order[self.scores[i]] for i in self.pieces.values()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.pieces.items():
            if not self.bpe or self.merged(piece, self.halves) == [i]:  # else no merge leads to this piece
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        inner = {c for p in self.pieces for c in p[1:]} | {c for p in self.pieces if len(p) > 1 for c in p}
        #: characters that are in no piece of two or more characters: paths meet on both sides of them
        self.alone = "\n" if "\n" not in inner else ""
        #: whether the word mark only occurs at the start of pieces
        self.marks_lead = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.stable = lru_cache(maxsize=300_000)(self._stable)

    def merged(self, text: str, halves: dict | None = None) -> list[int]:
        """Ids of a short text by repeated merging, best score first, then
        leftmost; ``halves`` gets the parts of a merge that makes the whole."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.pieces.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.rank[i] < best):
                    best, at = self.rank[i], k
            if at < 0:
                return [self.pieces.get(p, -1) for p in parts]
            if len(parts) == 2 and halves is not None:
                halves[self.pieces[text]] = (self.pieces[parts[0]], self.pieces[parts[1]])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _stable(self, left: int, right: int) -> bool:
        """Whether merging the text of two pieces gives the two pieces back.

        Merges are undone from the last one on, at the inner edge of either
        piece: if what meets there could have merged before (better rank, or
        the same rank further left), the two pieces would not have come out.
        """
        text, pieces, rank, halves = self.text, self.pieces, self.rank, self.halves
        bound, tie = len(rank), False
        while True:
            both = pieces.get(text[left] + text[right])
            if both is not None and (rank[both] < bound or tie and rank[both] == bound):
                return False
            made_left = rank[left] if left in halves else -1
            made_right = rank[right] if right in halves else -1
            if made_left < 0 and made_right < 0:
                return True
            if made_right >= made_left:
                bound, tie, right = made_right, True, halves[right][0]
            else:
                bound, tie, left = made_left, False, halves[left][1]

    def unknown(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.fallback else [self.unk]


def viterbi(model: Model, text: str) -> list[int]:
    """Ids of ``text`` (already with word marks) by streaming Viterbi.

    Edges come from a multi-pattern automaton over the pieces: at each node
    the pieces that end there, longest first. ``best``, ``last`` and ``back``
    hold the nodes still in the window, from node ``done`` on: score, id of
    the last piece (-1: an unknown character) and the node before it.
    """
    ids: list[int] = []
    best, last, back, done = [0.0], [-2], [0], 0
    n, bpe, scores, stable, unk = len(text), model.bpe, model.scores, model.stable, model.unk_score

    def path(end: int) -> list[int]:
        nodes = [end]
        while end > done:
            end = back[end - done]
            nodes.append(end)
        return nodes

    def commit(boundary: int) -> None:
        nonlocal done
        for at in path(boundary)[-2::-1]:
            piece = last[at - done]
            if piece >= 0:
                ids.append(piece)
            else:
                known = model.unknown(text[at - 1])
                if known != [model.unk] or ids[-1:] != known:  # a run of unknown characters is one unknown
                    ids.extend(known)
        del best[:boundary - done], last[:boundary - done], back[:boundary - done]
        done = boundary

    def settle() -> None:
        """Commit up to the last node that all paths have in common."""
        ends = range(max(done, done + len(last) - model.longest), done + len(last))
        common = set(path(ends[0]))
        for end in ends[1:]:
            common.intersection_update(path(end))
        if max(common) > done:
            commit(max(common))

    at, piece_at, from_at, score_at = 1, -1, 0, 0.0  # the node whose edges are being read
    for end, (piece, length) in model.automaton.iter(text):
        while at <= end:
            if piece_at < 0:  # no piece ends here: over an unknown character
                from_at, score_at = at - 1, best[-1] + unk
            best.append(score_at)
            last.append(piece_at)
            back.append(from_at)
            at, piece_at = at + 1, -1
            if not at % CHECK_EVERY:
                settle()
        before = at - length
        if bpe:
            if piece_at < 0:
                left = last[before - done]
                if left < 0 or stable(left, piece):
                    piece_at, from_at = piece, before
        else:
            score = best[before - done] + scores[piece]
            if piece_at < 0 or score > score_at:
                piece_at, from_at, score_at = piece, before, score
    while at <= n:
        if piece_at < 0:
            from_at, score_at = at - 1, best[-1] + unk
        best.append(score_at)
        last.append(piece_at)
        back.append(from_at)
        at, piece_at = at + 1, -1
        if not at % CHECK_EVERY:
            settle()
    commit(n)
    return ids


class Encoder:
    """Encodes whole texts; one for each task.

    ``new`` and ``old`` remember ids (little-endian 4-byte numbers) of words
    after a single blank, by the bare word, in two generations.
    """

    def __init__(self, model: Model, part_ids=None):
        self.model = model
        self.part_ids = part_ids or (lambda part: viterbi(model, part))
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.splits = model.marks_lead and model.fallback
        self.line_break = self._ids("\n") if model.alone else b""

    def _ids(self, part: str) -> bytes:
        return array("i", self.part_ids(part)).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word after a single blank that ``new`` does not have."""
        got = self.old.get(word) or self._ids(SPACE + word)
        if len(word) <= 64:
            if len(self.new) >= REMEMBERED // 2:
                self.old, self.new = self.new, {}
            self.new[word] = got
        return got

    def _parts(self, line: str) -> Iterable[str]:
        """``line`` (with word marks) cut where paths meet: before word marks."""
        words = line.split(SPACE)
        if words[0]:
            yield words[0]
        marks = ""
        for w in words[1:]:
            marks += SPACE
            if w:
                yield marks + w
                marks = ""
        if marks:
            yield marks

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.model.prefix:
            text = " " + text
        if not self.splits:
            return self._ids(text.replace(" ", SPACE))
        out = []
        for k, line in enumerate(text.split("\n") if self.model.alone else [text]):
            if k:
                out.append(self.line_break)
            if "  " in line or line.endswith(" ") or SPACE in line:
                out += map(self._ids, self._parts(line.replace(" ", SPACE)))
                continue
            words = line.split(" ")
            if words[0]:
                out.append(self._ids(words[0]))
            get, learn = self.new.get, self._word
            out += [get(w) or learn(w) for w in words[1:]]
        return b"".join(out)


@lru_cache(maxsize=4)
def _encoder(source: str, by_library: bool) -> Encoder:
    model = Model(source)
    return Encoder(model, library_ids(model) if by_library else None)


def library_ids(model: Model):
    """Ids of a part by the sentencepiece library instead of the lattice: for
    operators that need ids but are not about finding them."""
    lead = model.library.encode("\n" if model.prefix else "")

    def ids(part: str) -> list[int]:
        if part == SPACE:  # the library gives no ids for an empty text
            return viterbi(model, part)
        if model.prefix and part.startswith(SPACE):
            return model.library.encode(part[1:].replace(SPACE, " "))
        if model.prefix:
            return model.library.encode("\n" + part)[len(lead):]
        return model.library.encode(part)

    return ids


def encode(docs: DataFrame, model_file: str, column: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as array<int>; null texts have null
    ids, empty texts no ids. The model file must be readable under its path
    on every executor (it comes with the Python environment). Clashing names
    are replaced."""
    def compute():
        encoder = _encoder(model_file, False)
        return lambda texts: {column: id_lists([_encoded(encoder, t) for t in texts])}

    return add_columns(docs, "text", T.StructType([T.StructField(column, T.ArrayType(T.IntegerType()))]), compute)


def _encoded(encoder: Encoder, text: bytes | None) -> bytes | None:
    return None if text is None else encoder.encode(text.decode("utf-8", "replace"))


def id_lists(rows: list[bytes | None]):
    """Rows of ids as an Arrow list array, without Python numbers."""
    import pyarrow as pa
    ends = np.cumsum([0] + [len(r) // 4 if r else 0 for r in rows]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(r for r in rows if r), "<i4"))
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([r is None for r in rows]))


def decode(docs: DataFrame, model_file: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``docs`` with the text that ``ids`` stand for. Null ids give null;
    bytes that are no UTF-8 become U+FFFD, control pieces nothing. Ids
    outside the model stop the job."""
    src = spare(docs, "__ids")
    rest = without(docs, column)
    out = T.StructType(rest.schema.fields + [T.StructField(column, T.StringType())])
    picked = docs.select(*[quoted(c) for c in rest.columns], quoted(ids).alias(src))

    def run(batches):
        import pyarrow as pa
        table, prefix = _pieces(model_file)
        for batch in slices(batches):
            lists = batch.column(batch.num_columns - 1)
            texts = [joined(table, x.values.to_pylist(), prefix) if x.is_valid else None for x in lists]
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return mapped(picked, run, out)


@lru_cache(maxsize=4)
def _pieces(source: str) -> tuple[list[bytes], bool]:
    """What decoding needs of a model; it builds no lattice."""
    from sentencepiece import sentencepiece_model_pb2 as proto
    spec = proto.ModelProto.FromString(open(source, "rb").read())
    return piece_bytes(spec), spec.normalizer_spec.add_dummy_prefix


def piece_bytes(spec) -> list[bytes]:
    """UTF-8 text of every id of a model, word marks as blanks."""
    kinds = type(spec).SentencePiece

    def text(p) -> bytes:
        if p.type == kinds.BYTE:
            return bytes([int(p.piece[1:-1], 16)])
        if p.type in (kinds.NORMAL, kinds.USER_DEFINED):
            return p.piece.replace(SPACE, " ").encode()
        return " ⁇ ".encode() if p.type == kinds.UNKNOWN else b""

    return [text(p) for p in spec.pieces]


def joined(table: list[bytes], ids: list[int], prefix: bool) -> str:
    if ids and min(ids) < 0:
        raise ValueError("negative id")
    text = b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if prefix and text.startswith(" ") else text


ROUND_TRIP = T.StructType([
    T.StructField("n_ids", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("decoded_chars", T.LongType()), T.StructField("lossless", T.BooleanType())])


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_ids, ids, the length of the text decoded from the ids, and
    whether it is the text (it is not where a text holds the word mark
    itself, which decodes to a blank). Encoding and decoding share one pass;
    null texts have null ids."""
    def compute():
        encoder, (table, prefix) = _encoder(model_file, False), _pieces(model_file)

        def batch(texts: list) -> dict[str, list]:
            rows = [_encoded(encoder, t) for t in texts]
            back = [None if r is None else joined(table, np.frombuffer(r, "<i4").tolist(), prefix) for r in rows]
            return {"n_ids": [len(r or b"") // 4 for r in rows], "ids": id_lists(rows),
                    "decoded_chars": [len(b or "") for b in back],
                    "lossless": [b == (None if t is None else t.decode("utf-8", "replace")) for b, t in zip(back, texts)]}
        return batch

    return add_columns(docs.select(quoted("doc_id").alias("doc_id"), quoted("text").alias("text")), "text", ROUND_TRIP,
                       compute).drop("text")
