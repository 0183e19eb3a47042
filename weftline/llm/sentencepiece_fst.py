"""SentencePiece encoding and decoding as shortest paths through a weighted finite-state transducer.

A model file is compiled to three machines: the normaliser (white space), the lexicon (a trie of pieces with weights, and for
any other character the chain of its byte pieces), and a machine over pieces that says which may stand next to each other. An
input is composed with them as it is read, and the path of least weight in the tropical semiring (weights add along a path, the
least of all paths counts) is the encoding.

Unigram models: a piece weighs its negated score, any two pieces may be neighbours. Byte-pair models: all pieces weigh nothing,
and two pieces may be neighbours only if merging the characters of both ends in just these two; a path of allowed neighbours
is unique and is the encoding that merging in the order of scores gives (known from finite-state constructions of byte-pair
tokenisers). The machine of neighbours is built lazily and kept.

No path crosses a place that no piece spans, so an input is cut there and the parts are composed once each and kept.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.shared import KEPT, released, small_batches

BLANK = "▁"
#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: A character that no path covers weighs so much more than the worst piece (a fixed value of the library).
UNKNOWN_PENALTY = 10.0
#: Parts of inputs that a worker keeps with their ids, and pairs of neighbours; beyond it starts anew.
CACHE, NEIGHBOURS = 450_000, 400_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message; 4- and 8-byte values as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Transducer:
    """A compiled model: encode() and decode()."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        scores, kinds, spec, norm = [], [], {}, {}
        for number, value in proto_fields(model):
            if number == 1:
                f = dict(proto_fields(value))
                self.pieces.append(f[1].decode())
                scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                kinds.append(f.get(3, NORMAL))
            elif number == 2:
                spec = dict(proto_fields(value))
            elif number == 3:
                norm = dict(proto_fields(value))
        self.bpe = spec.get(3, UNIGRAM) == BPE
        if spec.get(3, UNIGRAM) not in (UNIGRAM, BPE) or norm.get(2) or spec.get(24) or USER in kinds:
            raise ValueError("only unigram and byte-pair models without a character map, user symbols or suffix white space")
        self.prefix, self.squeeze, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        self.unknown = kinds.index(UNKNOWN)
        own = [i for i, k in enumerate(kinds) if k in (NORMAL, UNUSED)]
        self.id_of = {self.pieces[i]: i for i in own}
        self.score = {self.pieces[i]: scores[i] for i in own}
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i, k in enumerate(kinds) if k == BYTE}
        self.out = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.heavy = UNKNOWN_PENALTY - min(self.score.values(), default=0.0)
        self.trie: dict = {}
        for p in self.id_of:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.neighbours: dict[tuple[str, str], bool] = {}
        self._cuts()
        self.clear()

    def _cuts(self) -> None:
        """The pattern of an input's parts, cut only where no piece spans the place."""
        near = {(a, b) for p in self.id_of for a, b in zip(p, p[1:])}
        if any(b == BLANK != a for a, b in near):
            self.parts, self.rare, self.parts_if_rare = re.compile(r"(?s).+"), (), re.compile(r"(?s).+")
            return
        lone = [c for c in "\n\t" if not any(c in x for x in near)]
        word = re.compile(r"\w")
        before = {c: {a for a, b in near if b == c and word.match(a)} for c in ".,"}
        ends = "".join(c for c, found in before.items() if len(found) < 3)
        self.rare = tuple({x for c in ends for x in before[c]})
        plain = f"{BLANK}*[^{BLANK}{''.join(lone)}]+|{BLANK}+" + (f"|[{''.join(lone)}]" if lone else "")
        self.parts_if_rare = re.compile(plain)
        self.parts = re.compile(f"{BLANK}*\\w++(?=[{re.escape(ends)}])|{plain}") if ends else self.parts_if_rare

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.pool, self.lengths, self.starts = array("i"), array("q"), array("q")

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", BLANK) if self.escape else text

    def merged(self, text: str) -> list[str]:
        """The characters of text, merged in the order of scores (the leftmost of equals first)."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(-np.inf, 0))
            if best[0] == -np.inf:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, a: str, b: str) -> bool:
        """The arc of the neighbour machine from a to b ("" as a: the start)."""
        key = (a, b)
        got = self.neighbours.get(key)
        if got is None:
            if len(self.neighbours) > NEIGHBOURS:
                self.neighbours.clear()
            got = self.neighbours[key] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def path(self, text: str) -> list[str]:
        """The pieces, and characters that are none, on the shortest path over a normalised text."""
        n = len(text)
        cost, last = [np.inf] * (n + 1), [""] * (n + 1)
        cost[0] = 0.0
        known, score, bpe, follow = self.neighbours.get, self.score, self.bpe, self.may_follow
        for i in range(n):
            c = cost[i]
            if c == np.inf:
                continue
            node, k, prior, first = self.trie, i, last[i], text[i]
            alone = first not in score
            while True:
                if k > i and ("" in node or alone and k == i + 1):
                    piece = text[i:k]
                    w = c - (0.0 if bpe else score.get(piece, -self.heavy))
                    if w < cost[k]:
                        if bpe:
                            ok = known((prior, piece))
                            if ok is None:
                                ok = follow(prior, piece)
                            if not ok:
                                piece = ""
                        if piece:
                            cost[k], last[k] = w, piece
                if k == n:
                    break
                node = node.get(text[k])
                if node is None:
                    if alone and k == i:
                        node = _NOTHING
                    else:
                        break
                k += 1
        out, k = [], n
        while k:
            out.append(last[k])
            k -= len(last[k])
        return out[::-1]

    def ids_of(self, text: str) -> list[int]:
        """The ids of a normalised text."""
        out: list[int] = []
        for p in self.path(text):
            i = self.id_of.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _numbers(self, text: str) -> list[int]:
        """The places in the store of the parts of a text."""
        text = self.normalise(text)
        pattern = self.parts_if_rare if any(c in text for c in self.rare) else self.parts
        index, parts = self.index, pattern.findall(text)
        found, k = list(map(index.get, parts)), -1
        for _ in range(found.count(None)):
            k = found.index(None, k + 1)
            i = index.get(parts[k])
            if i is None:
                ids = self.ids_of(parts[k])
                i = index[parts[k]] = len(self.starts)
                self.starts.append(len(self.pool))
                self.lengths.append(len(ids))
                self.pool.extend(ids)
            found[k] = i
        return found

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, the place after each text's last id)."""
        if len(self.index) > CACHE:
            self.clear()
        found = [self._numbers(t) if t else [] for t in texts]
        at = np.fromiter(chain.from_iterable(found), np.int64)
        starts, lengths = np.frombuffer(self.starts, np.int64), np.frombuffer(self.lengths, np.int64)
        n = lengths[at] if len(at) else np.empty(0, np.int64)
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(upto) else 0
        ids = np.frombuffer(self.pool, np.int32)[np.repeat(starts[at] - (upto - n), n) + np.arange(total)] if total else np.empty(0, np.int32)
        ends = np.cumsum([len(x) for x in found])
        return ids, np.concatenate([[0], upto])[ends]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes put together, white space restored. Bytes that aren't UTF-8 become U+FFFD."""
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        if self.escape:
            text = text.replace(BLANK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_NOTHING: dict = {}
_KEPT: dict[int, Transducer] = {}


def _transducer(model: bytes) -> Transducer:
    """The worker's transducer for a model, kept between tasks."""
    key = hash(model)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Transducer(model)
    KEPT["sentencepiece"] = _KEPT.clear
    return _KEPT[key]


def encode_documents(docs: DataFrame, model: bytes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ids (array<int>), n_ids and round_trip (decoding gives the normalised text again) to the columns `keep` (all if None).

    model: the content of a model file (under a MB or so, sent with the tasks). A null or empty text has no ids. Columns of these
    names are replaced, others stay whatever their names. One row out for each row in; an empty table gives an empty result.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "n_ids", "round_trip")]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col(f"`{text}`").cast("string").alias("text"))
    schema = docs.select(*(F.col(f"`{c}`") for c in keep)).schema.add("ids", T.ArrayType(T.IntegerType())).add("n_ids", T.IntegerType()).add("round_trip", T.BooleanType())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(sent.value)
        plain = lambda t: machine.normalise(t).replace(BLANK, " ") if machine.escape else t
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                texts = some.column(some.num_columns - 1).to_pylist()
                ids, ends = machine.encode_batch(texts)
                all_ids, same = ids.tolist(), []
                for t, a, b in zip(texts, [0, *ends.tolist()], ends.tolist()):
                    want = plain(t) if t else ""
                    same.append(machine.decode(all_ids[a:b]) == (want[1:] if machine.prefix and want.startswith(" ") else want))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
                counts = pa.array(np.diff(ends, prepend=0), pa.int32())
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], lists, counts, pa.array(same)], [*keep, "ids", "n_ids", "round_trip"])

    small_batches(docs.sparkSession)
    return rows.mapInArrow(released(encode, "sentencepiece"), schema)
