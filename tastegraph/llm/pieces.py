"""SentencePiece encoding and decoding with a given model file (nothing is trained, no file is copied), by a streaming Viterbi search.

A lattice is kept over a window of the longest piece's length: every boundary has a back pointer to the start of its last piece, and ids are committed
whenever the back pointers of all positions that a later piece could still start from meet in one boundary.

* Unigram models: the back pointer of the best sum of scores.
* BPE models: a best sum of scores isn't what such a model means (scores there are merge ranks; a search for the best sum gives other
  pieces than the model for 45 in 100 words of the tables here). The survivor is found from the merges instead: a sequence of pieces is
  what merging gives exactly if each piece merges to itself and no two neighbours, merged together, give anything but themselves. So every
  boundary has exactly one survivor, the piece that gets along with the survivor at its start, and ids equal the library's.

Texts are cut at spaces that follow another character, which no piece crosses (checked against the vocabulary when the model is loaded; otherwise a text
is one unit); the ids of short units are kept for reuse.

Encoding is lossless: it always works on a space and the text (``add_dummy_prefix``), characters without a piece become bytes, and a literal
U+2581, which the library would turn into a space, is written as its three bytes. Decoding joins the pieces' bytes and drops the first space.

Defined cases: a null or empty text has no ids and decodes to an empty text; repeated rows get equal ids; lone surrogates cannot occur in Spark strings; columns
with the names of outputs are replaced, others pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import words as W
from .frames import position, with_arrays

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MODEL_LIMIT = 64 << 20
MARK = "▁"
#: Units up to this length are remembered, and so many of them.
UNIT_LIMIT, UNITS = 48, 1 << 19


class StreamingViterbi:
    """Segmentation in a window. scores: piece -> (id, score); other characters become ``fallback(character)``.

    An automaton over all pieces names those that end at each boundary, the longest first."""

    def __init__(self, scores: dict[str, tuple[int, float]], fallback):
        self.scores, self.fallback = scores, fallback
        self.longest = max(map(len, scores), default=1)
        self.widest = 0  # boundaries in the window at most, over all texts
        self.names: list[str] = []  # pieces by number
        self.sizes: list[int] = []
        self.ids: list[list[int]] = []
        self.numbers: dict[str, int] = {}
        self.inside = {p[k : k + 2] for p in scores for k in range(len(p) - 1)}  # other two characters can be parted: no piece holds them
        self.automaton = ahocorasick.Automaton()
        for piece in scores:
            if self.usable(piece):
                self.automaton.add_word(piece, self.number(piece, [scores[piece][0]]))
        self.automaton.make_automaton()

    def number(self, piece: str, ids: list[int]) -> int:
        self.numbers[piece] = len(self.names)
        self.names.append(piece)
        self.sizes.append(len(piece))
        self.ids.append(ids)
        return self.numbers[piece]

    def single(self, character: str) -> int:
        """The number of a character, which may have no piece."""
        known = self.numbers.get(character)
        return self.number(character, self.fallback(character)) if known is None else known

    def usable(self, piece: str) -> bool:
        return True

    def extend(self, text: str, at: int, stop: int, base: int, back: list[int], last: list[int], best: list[float]) -> None:
        """Finds the survivors at the boundaries after ``at`` up to ``stop``; the window's first boundary is ``base``.

        back, last, best: of each boundary the start, number and sum of scores of its survivor (number -2: none yet, -1: a text's start)."""
        raise NotImplementedError

    def hits(self, text: str, at: int, stop: int) -> Iterator[tuple[int, int]]:
        """(last character, number) of pieces that end in the window, in order; some end before it."""
        return self.automaton.iter(text, max(0, at - self.longest + 1), stop)

    def stream(self, text: str) -> Iterator[list[int]]:
        """Lists of ids, each committed as soon as it is certain; their concatenation is the result."""
        n, longest = len(text), self.longest
        at = base = 0
        back, last, best = [0], [-1], [0.0]
        while at < n:
            stop = min(at + longest, n)
            back += [0] * (stop - at)
            last += [-2] * (stop - at)
            best += [-np.inf] * (stop - at)
            self.extend(text, at, stop, base, back, last, best)
            at = stop
            if at < n:
                self.widest = max(self.widest, len(last))
                # A later piece starts from one of the last ``longest`` boundaries; the last is followed back until all meet.
                open_ = set(range(max(0, at - longest + 1 - base), at - base + 1))
                while len(open_) > 1:
                    top = max(open_)
                    open_.remove(top)
                    open_.add(back[top])
                if meet := open_.pop():
                    yield self._path(back, last, meet)
                    back, last, best = [max(0, b - meet) for b in back[meet:]], last[meet:], best[meet:]
                    base += meet
        yield self._path(back, last, n - base)

    def encode(self, text: str) -> list[int]:
        if (n := len(text)) <= self.longest:  # one window: all that the stream would do
            back, last = [0] * (n + 1), [-1] + [-2] * n
            self.extend(text, 0, n, 0, back, last, [0.0] + [-np.inf] * n)
            return self._path(back, last, n)
        return [i for part in self.stream(text) for i in part]

    def _path(self, back: list[int], last: list[int], at: int) -> list[int]:
        out: list[int] = []
        ids = self.ids
        while at:
            out += ids[last[at]][::-1]
            at = back[at]
        out.reverse()
        return out


class BestSum(StreamingViterbi):
    """Unigram models; a character without a piece costs ``penalty``; of equal sums the path whose last piece is longest wins."""

    def __init__(self, scores, fallback, penalty: float):
        super().__init__(scores, fallback)
        self.penalty = penalty

    def extend(self, text, at, stop, base, back, last, best):
        ended: dict[int, list[int]] = {}
        for end, piece in self.hits(text, at, stop):
            ended.setdefault(end + 1, []).append(piece)
        for e in range(at + 1, stop + 1):
            here, c = e - base, text[e - 1]
            if c not in self.scores:
                back[here], last[here], best[here] = here - 1, self.single(c), best[here - 1] + self.penalty
            for piece in ended.get(e, ()):
                start = here - self.sizes[piece]
                if (score := best[start] + self.scores[self.names[piece]][1]) > best[here]:
                    back[here], last[here], best[here] = start, piece, score


class Merges(StreamingViterbi):
    """BPE models."""

    def __init__(self, scores, fallback):
        least = min((x for _, x in scores.values()), default=0.0)
        self.rank = {p: x - least + 1.0 for p, (_, x) in scores.items() if len(p) > 1}
        self.stay: dict[int, bool] = {}  # two numbers in one -> whether the pieces stay as they are side by side
        super().__init__(scores, fallback)
        self.known = {p for p in self.numbers if len(p) == 1}

    def usable(self, piece):
        """Pieces that merging gives."""
        return self.merged(piece) == [piece]

    def merged(self, text: str) -> list[str]:
        """The definition: the best-scored pair of neighbours that is a piece is merged (the first of equals) until there is none."""
        out, get = list(text), self.rank.get
        ranks = [get(a + b, 0.0) for a, b in zip(out, out[1:])]  # above 0: mergeable, the more the better
        while ranks and (top := max(ranks)):
            at = ranks.index(top)
            out[at : at + 2] = [out[at] + out[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(out[at - 1] + out[at], 0.0)
            if at < len(ranks):
                ranks[at] = get(out[at] + out[at + 1], 0.0)
        return out

    def extend(self, text, at, stop, base, back, last, best):
        if not self.known.issuperset(text[at:stop]):
            for p in range(at, stop):
                if text[p] not in self.known:  # no merging gives anything else there
                    back[p + 1 - base], last[p + 1 - base] = p - base, self.single(text[p])
        stay, sizes, shift = self.stay.get, self.sizes, 1 - base
        for end, piece in self.hits(text, at, stop):
            e = end + shift
            if last[e] == -2:
                start = e - sizes[piece]
                ahead = last[start]
                if ahead < 0 or (known := stay(ahead << 32 | piece)) or known is None and self._stays(ahead, piece):
                    back[e], last[e] = start, piece

    def _stays(self, ahead: int, piece: int) -> bool:
        if len(self.stay) >= UNITS:
            self.stay.clear()
        a, b = self.names[ahead], self.names[piece]
        known = self.stay[ahead << 32 | piece] = self.rank.get(a + b, 0.0) == 0.0 and self.merged(a + b) == [a, b]
        return known


class Units:
    """Unit -> its ids as bytes of int32. Two generations of UNITS / 2 units are kept: what was asked for lately stays."""

    def __init__(self, search: StreamingViterbi):
        self.search, self.new, self.old = search, _Unit(self), {}

    def make(self, unit: str) -> bytes:
        if (ids := self.old.get(unit)) is None:
            inside, parts, at = self.search.inside, [], 0
            for k in range(1, len(unit)):
                if unit[k - 1 : k + 1] not in inside:
                    parts.append(self.new[unit[at:k]])
                    at = k
            if at:
                ids = b"".join([*parts, self.new[unit[at:]]])
            else:
                ids = array("i", self.search.encode(unit)).tobytes()
        if len(unit) <= UNIT_LIMIT:
            self.new[unit] = ids
        return ids

    def encode(self, units: list[str]) -> bytes:
        if len(self.new) >= UNITS // 2:
            self.new, self.old = _Unit(self), dict(self.new)
        return b"".join(map(self.new.__getitem__, units))


class _Unit(dict):
    def __init__(self, owner: Units):
        super().__init__()
        self.owner = owner

    def __missing__(self, unit: str) -> bytes:
        return self.owner.make(unit)


class Pieces:
    """A model made ready from its file's bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave the text as it is can be decoded exactly")
        self.prefixed = spec.normalizer_spec.add_dummy_prefix
        kinds = proto.ModelProto.SentencePiece
        bytes_of, byte_ids, scores = [], {}, {}
        for i, p in enumerate(spec.pieces):
            if p.type == kinds.BYTE:
                byte_ids[int(p.piece[3:5], 16)] = i
                bytes_of.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                scores[p.piece.replace(MARK, " ")] = (i, p.score)
                bytes_of.append(p.piece.replace(MARK, " ").encode())
            else:
                bytes_of.append(b"")
        if len(byte_ids) < 256:
            raise ValueError("the model has no byte pieces: not every text could be decoded")
        fallback = lambda text: [byte_ids[b] for b in text.encode()]
        if spec.trainer_spec.model_type == proto.TrainerSpec.UNIGRAM:
            search = BestSum(scores, fallback, min((s for _, s in scores.values()), default=0.0) - 10.0)
        elif spec.trainer_spec.model_type == proto.TrainerSpec.BPE:
            search = Merges(scores, fallback)
        else:
            raise ValueError("neither a unigram nor a BPE model")
        self.bytes_of, self.units = bytes_of, Units(search)
        cuttable = not any(" " in p.lstrip(" ") for p in scores)
        self.cut = re.compile(r" *[^ ]+| +" if cuttable else r"(?s).+").findall

    def encode(self, text: str) -> np.ndarray:
        """int32 ids."""
        if not text:
            return np.zeros(0, np.int32)
        return np.frombuffer(self.units.encode(self.cut(" " + text if self.prefixed else text)), np.int32)

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefixed and text.startswith(" ") else text


_READY: dict[str, Pieces] = {}


def ready(model: bytes) -> Pieces:
    """The model, made once in each worker process."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _READY:
        _READY.clear()
        _READY[key] = Pieces(model)
    return _READY[key]


def load(spark: SparkSession, path: str = MODEL) -> bytes:
    """The model's bytes (at most MODEL_LIMIT): a local path by the driver, any other by Spark's reader."""
    if "://" in path:
        model = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    else:
        with open(path, "rb") as file:
            model = file.read(MODEL_LIMIT + 1)
    if len(model) > MODEL_LIMIT:
        raise ValueError(f"{path} is larger than {MODEL_LIMIT} bytes")
    return model


def encode(docs: DataFrame, text_column: str = "text", path: str = MODEL, check: bool = True) -> DataFrame:
    """docs with ids (array of int), n_ids and, with ``check``, round_trip (whether decoding gives back the text): one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(load(docs.sparkSession, path))
    at = position(docs, text_column)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
        model = ready(shared.value)
        for batch in batches:
            column = W.texts(batch.column(at))
            for lo, hi, _, _ in W.chunks(column):  # short output batches
                these = column.slice(lo, hi - lo).to_pylist()
                ids = [model.encode(t) for t in these]
                size = np.array([len(x) for x in ids], np.int64)
                got = {"ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32())), "n_ids": pa.array(size)}
                if check:
                    got["round_trip"] = pa.array([model.decode(x.tolist()) == t for x, t in zip(ids, these, strict=True)], pa.bool_())
                yield batch.slice(lo, hi - lo), got

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType())]
    return with_arrays(docs, fields + [T.StructField("round_trip", T.BooleanType())] * check, compute)


def decode(rows: DataFrame, ids_column: str = "ids", output: str = "text", path: str = MODEL) -> DataFrame:
    """rows with the text of their ids (null ids: null)."""
    shared = rows.sparkSession.sparkContext.broadcast(load(rows.sparkSession, path))
    at = position(rows, ids_column)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
        model = ready(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield part, {output: pa.array([None if x is None else model.decode(x) for x in part.column(at).to_pylist()], pa.string())}

    return with_arrays(rows, [T.StructField(output, T.StringType())], compute)
