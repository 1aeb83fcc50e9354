"""SentencePiece BPE encoding by backtracking over longest matches, and decoding.

Merging greedily by score gives the one segmentation in which every two neighbours stay apart when their
joined text is merged again. So the encoder walks forward: an Aho-Corasick automaton over the reversed text
gives the longest piece that starts at each position; a piece is taken if its end isn't known to fail and
its pair with the piece before is compatible (re-merged and remembered); else the next shorter prefix piece
is tried, and where none is left the position is marked in a bitfield of failed ends and the last piece is
taken back. Each position fails once at most, so the time is linear in the text.

No piece has a space after another character, and a character that is no piece itself is in no longer piece
(both are checked on loading). Text is therefore cut, exactly, before runs of spaces and around unknown
characters, and what lies between is encoded once per worker while it stays in a bounded cache. What some
texts need and the cache lacks is encoded together: the same walk, a step of all units at a time; a unit
that is long, has unknown characters or is among the last few on the way is walked by itself.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import prepare, settle

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNITS = re.compile(r" *[^ \n]+|\n| +")
#: Units held by a worker, the longest of them (under 63), bits of the slots of remembered pairs, characters cut together, units too few to walk together.
UNITS_HELD, LONGEST, PAIR_BITS, TOGETHER, FEW = 170_000, 48, 21, 1 << 19, 100
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one protocol-buffer message: number, and an integer or bytes."""
    at, end = 0, len(raw)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


class PieceCodec:
    """Encodes and decodes as the sentencepiece library does with a BPE model with byte fallback."""

    def __init__(self, path: str):
        pieces, self.dummy_prefix, squeeze, charsmap = [], True, True, b""
        with open(path, "rb") as f:
            model = f.read()
        for number, value in _fields(model):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                pieces.append((piece, score, kind))
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        squeeze = bool(v)
        if squeeze or charsmap or not self.dummy_prefix:
            raise ValueError("only models with identity normalisation, a dummy prefix and kept spaces are supported")
        if any(kind in (USER, UNUSED) for _, _, kind in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.digest = hashlib.sha256(model).hexdigest()
        self.kinds = [kind for _, _, kind in pieces]
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.eos = next(i for i, (p, _, k) in enumerate(pieces) if k == CONTROL and p == "</s>")
        self.text = {i: p.replace(SPACE, " ") for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.score = {self.text[i]: pieces[i][1] for i in self.text}
        self.id = {t: i for i, t in self.text.items()}
        self.letters = {t for t in self.id if len(t) == 1}
        if any(" " in t.lstrip(" ") or not self.letters.issuperset(t) for t in self.id):
            raise ValueError("a piece has an inner space or a character that is no piece")
        if len(self.byte_id) < 256:
            raise ValueError("the model has no byte fallback")
        # a piece that merging its own characters doesn't give is in no result
        alive = {t: i for t, i in self.id.items() if len(t) < 3 or self._merge(t) == [t]}
        self.shorter = {i: next((alive[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in alive), -1) for t, i in alive.items()}
        self.apart = next(c for c in map(chr, range(0x110000)) if c not in self.letters)
        self.automaton = ahocorasick.Automaton()
        self.automaton.add_word(self.apart, -1)  # between units encoded together; first, as the automaton looks through a node's characters in turn
        self.single = np.full(max(map(ord, self.letters)) + 2, -1, np.int32)  # by character; single characters match directly
        for t, i in alive.items():
            if len(t) > 1:
                self.automaton.add_word(t[::-1], i)
            else:
                self.single[ord(t)] = i
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.surfaces = np.empty(len(pieces), object)
        for i, (p, _, k) in enumerate(pieces):
            self.surfaces[i] = bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else self.text[i].encode()
        self.decimals = np.array([str(i) for i in range(len(pieces))], object)
        self.units: dict[str, str] = {}
        self.lengths, self.shorter_of = np.zeros(len(pieces), np.int32), np.full(len(pieces), -1, np.int32)
        for i, n in self.shorter.items():
            self.lengths[i], self.shorter_of[i] = len(self.text[i]), n
        self.known = np.full(1 << PAIR_BITS, -1, np.int32 if len(pieces) <= 1 << 15 else np.int64)  # by a hash of the pair: twice its number, plus 1 if compatible

    def _merge(self, text: str) -> list[str]:
        """The plain definition: the best-scored neighbours join, the leftmost first, until none can."""
        parts, score = list(text), self.score
        while True:
            best, where = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, k
            if where < 0:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces stay apart when their joined text is merged again."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 50_000:
                self.pairs.clear()
            known = self.pairs[key] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        a, b = self.text[left], self.text[right]
        return self._merge(a + b) == [a, b]

    def _compatible_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """As compatible, of many pairs."""
        count = len(self.decimals)
        pair = left.astype(np.int64) * count + right
        slot = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)
        held = self.known[slot]
        answer, new = (held & 1).astype(bool), np.flatnonzero(held >> 1 != pair)
        if len(new):
            pairs, first, back = np.unique(pair[new], return_index=True, return_inverse=True)
            found = np.array([self._stay_apart(*divmod(p, count)) for p in pairs.tolist()])
            self.known[slot[new][first]] = pairs * 2 + found
            answer[new] = found[back]
        return answer

    def _longest(self, text: str) -> np.ndarray:
        """The longest piece that starts at each character, or -1."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        longest = self.single[np.minimum(points, len(self.single) - 1)]
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text[::-1])), np.int32).reshape(-1, 2)
        found = found[np.flatnonzero(np.diff(found[:, 0], prepend=-1))]  # of the pieces that end at a position the automaton gives the longest first
        longest[len(text) - 1 - found[:, 0]] = found[:, 1]
        return longest

    def _backtrack(self, run: str) -> list[int]:
        """The ids of a run of characters that are all pieces."""
        size, longest = len(run), self._longest(run).tolist()
        failed, ids, at = bytearray((size >> 3) + 1), [], 0
        text, shorter, compatible, token = self.text, self.shorter, self.compatible, longest[0]
        while at < size:
            last = ids[-1] if ids else -1
            while token >= 0:
                end = at + len(text[token])
                if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or compatible(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at = end
                token = longest[at] if at < size else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                token = ids.pop()
                at -= len(text[token])
        return ids

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of text in which spaces stand for themselves, without a dummy prefix."""
        letters = self.letters
        if letters.issuperset(unit):
            return self._backtrack(unit)
        ids, start = [], 0
        for k, ch in enumerate(unit):
            if ch not in letters:
                if k > start:
                    ids += self._backtrack(unit[start:k])
                ids += [self.byte_id[b] for b in ch.encode()]
                start = k + 1
        if start < len(unit):
            ids += self._backtrack(unit[start:] if start else unit)
        return ids

    def _encode_units(self, units: list[str]) -> list[str]:
        """The ids of each unit as decimals joined by one space."""
        out = [""] * len(units)
        short = [k for k, u in enumerate(units) if len(u) <= LONGEST] if len(units) >= FEW else []
        if short:
            text = self.apart.join([units[k] for k in short]) + self.apart
            longest = self._longest(text)
            size = np.array([len(units[k]) for k in short])
            stop = np.cumsum(size + 1) - 1
            unknown = np.diff(np.cumsum(longest < 0)[stop], prepend=0) > 1  # the separator is one
            row, taken = np.flatnonzero(~unknown), np.zeros((len(short), LONGEST), np.int32)
            begin, depth, failed = stop - size, np.zeros(len(short), np.int64), np.zeros(len(short), np.int64)
            at = begin[row]
            token = longest[at]
            while len(row) >= FEW:
                end = at + self.lengths[token]
                fits = failed[row] >> (end - begin[row]) & 1 == 0
                later = np.flatnonzero(fits & (depth[row] > 0))
                fits[later] = self._compatible_all(taken[row[later], depth[row[later]] - 1], token[later])
                on, off = np.flatnonzero(fits), np.flatnonzero(~fits)
                taken[row[on], depth[row[on]]] = token[on]
                depth[row[on]] += 1
                at[on] = end[on]
                token[on] = longest[end[on]]
                token[off] = self.shorter_of[token[off]]
                back = off[token[off] < 0]
                failed[row[back]] |= 1 << (at[back] - begin[row[back]])
                depth[row[back]] -= 1
                token[back] = taken[row[back], depth[row[back]]]  # tried again, and as its end fails the next shorter one follows
                at[back] -= self.lengths[token[back]]
                rest = np.flatnonzero(at < stop[row])
                row, at, token = row[rest], at[rest], token[rest]
            depth[row] = 0
            tokens = self.decimals[taken[np.arange(LONGEST) < depth[:, None]]].tolist()
            ends = np.cumsum(depth).tolist()
            for k, first, last in zip(short, [0, *ends], ends):
                out[k] = " ".join(tokens[first:last])
        return [o or " ".join(map(str, self.encode_unit(u))) for o, u in zip(out, units)]

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[list[str]]:
        """For each text the ids of each unit, as decimals joined by one space; null counts as the empty text, which has none."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text or "")
            if size >= TOGETHER:
                yield from self._encode_together(group)
                group, size = [], 0
        yield from self._encode_together(group)

    def _encode_together(self, texts: list[str | None]) -> Iterator[list[str]]:
        cut = [UNITS.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        needed = set().union(*cut)
        new = list(needed.difference(self.units))
        if len(self.units) + len(new) > UNITS_HELD:
            self.units = {u: self.units[u] for u in needed.intersection(self.units)}
        found = dict(zip(new, self._encode_units(new)))
        self.units.update((u, d) for u, d in found.items() if len(u) <= LONGEST)
        long = {u: d for u, d in found.items() if len(u) > LONGEST}
        del needed, new, found
        for units in cut:
            yield [long.get(u) or self.units[u] for u in units] if long else list(map(self.units.__getitem__, units))
        if len(self.units) > UNITS_HELD:
            self.units = {}

    def encode_parts(self, text: str | None) -> list[str]:
        """As encode_many, of one text."""
        return list(self.encode_many([text]))[0]

    def encode_decimal(self, text: str | None, eos: bool = False) -> str:
        """All ids as decimals joined by one space."""
        return " ".join([*self.encode_parts(text), str(self.eos)] if eos else self.encode_parts(text))

    def encode(self, text: str | None, eos: bool = False) -> list[int]:
        return [int(i) for i in self.encode_decimal(text, eos).split()]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text of ids: one leading space goes, bytes that are no character become U+FFFD each."""
        raw = b"".join(self.surfaces[ids].tolist())
        try:
            raw.decode()
        except UnicodeDecodeError:
            out, text = b"", raw
            while text:
                try:
                    text.decode()
                    out, text = out + text, b""
                except UnicodeDecodeError as e:
                    out, text = out + text[: e.start] + "�".encode(), text[e.start + 1 :]
            raw = out
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        return raw[1:] if first is not None and self.kinds[first] == NORMAL and raw[:1] == b" " else raw

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.array(ids, np.int32)).decode()


_LOADED: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The worker's codec for a model file, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = PieceCodec(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, all token ids and the text they decode to.

    Null text is the empty text: no ids. Null and repeated ids pass through; other columns are ignored. An
    empty table gives an empty table. A row's text, ids and decoded text are in memory at a time.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            ids = [np.fromstring(" ".join(p), np.int32, sep=" ") for p in c.encode_many(t.as_py() for t in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode_bytes(i).decode() for i in ids])], ["doc_id", "ids", "decoded"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode_documents(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: the id and the text of its ids; null ids give the empty text."""
    prepare(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select(tokens[id_col].cast("long").alias("doc_id"), tokens[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """As encode_documents with an end id, but the ids and the decoded text leave the worker as digests.

    Returns doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256 (UTF-8) and, if asked
    for, the ids themselves.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(model_path), hashlib.sha256
        for batch in batches:
            counts, ids, decoded, arrays = [], [], [], []
            for parts in c.encode_many(t.as_py() for t in batch.column(1)):
                decimal = " ".join([*parts, str(c.eos)]).encode()
                array = np.fromstring(decimal, np.int32, sep=" ")
                counts.append(len(array))
                ids.append(sha(decimal).hexdigest())
                decoded.append(sha(c.decode_bytes(array)).hexdigest())
                if with_ids:
                    arrays.append(array)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(arrays, pa.list_(pa.int32()))] if with_ids else columns, [*names, "ids"] if with_ids else names)
        settle()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA + ", ids array<int>" if with_ids else SCHEMA)
