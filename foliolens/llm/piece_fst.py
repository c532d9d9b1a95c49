"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a model file: the normaliser (character map,
user-defined pieces, blanks to the blank mark, dummy prefix), the pieces (a trie whose
states are prefixes; at the end of a piece an arc leads back to the start and carries the
piece's weight), and the byte fallback (a character without a piece to its UTF-8 bytes).
For a merge model a fourth, over neighbouring pieces, holds the merge order: weight 0
where merging leaves the two side by side, infinity elsewhere, told from the ranks of the
merges that made them. The piece weights of such a model are merge ranks, not
log-probabilities, and alone would pick other paths.

The input is composed with the machines on the way, place by place: a state is a place
and, in a merge model, the piece that ends there. The encoding is the shortest path in
the tropical semiring (sums along a path, minimum over paths). Stretches between which
the piece machine is back in its start state are composed apart and remembered. Decoding
runs the machines backwards.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import map_batches

BLANK = "▁"
INFINITY = float("inf")
#: Segments and pairs that a worker remembers; beyond, it starts afresh.
CACHE_SEGMENTS, CACHE_PAIRS = 600_000, 1_000_000

# Fixed values of the public model format: field numbers and piece types.
_PIECES, _TRAINER, _NORMALISER = 1, 2, 3
_MODEL_TYPE, _SUFFIX, _UNKNOWN_SURFACE, _CHARSMAP, _DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE = 3, 24, 44, 2, 3, 4, 5
_NORMAL, _UNKNOWN_TYPE, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _MERGES = 1, 2


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes):
    """(field number, value) of a message in protocol-buffer wire format."""

    def varint(i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if raw[i - 1] < 128:
                return n, i

    i = 0
    while i < len(raw):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if key & 7 == 2 else ((4 if key & 7 == 5 else 8), i)
            value, i = raw[i : i + size], i + size
        yield key >> 3, value


class Normaliser:
    """The transducer from a text to what pieces are read from.

    Its arcs take blanks to the blank mark, the keys of a character map to their
    replacements and user-defined pieces to themselves, the longest first; any other
    character is an arc to itself, and runs of those are taken at once. Where extra blanks
    go, two states tell whether a blank would be one (at the start, and after a blank).
    Without a map and with all blanks kept there is one state, whose one arc that changes
    anything is applied as a replacement.
    """

    def __init__(self, charsmap: dict[str, str], user: list[str], dummy_prefix: bool, trim: bool, escape: bool, suffix: bool) -> None:
        self.trim, self.blank, self.at_end = trim, BLANK if escape else " ", suffix
        self.affix = self.blank if dummy_prefix else ""
        self.arcs: dict = {}
        for key, out in [*charsmap.items(), *((u, None) for u in user)]:  # None: itself, before any map
            node = self.arcs
            for c in key:
                node = node.setdefault(c, {})
            node[""] = out
        self.one_state = not self.arcs and not trim
        self.special = re.compile("[" + "".join(map(re.escape, {" ", *self.arcs})) + "]")

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        body = text if self.one_state else self._mapped(text)
        body = (self.affix if not self.at_end else "") + body.replace(" ", self.blank)
        if self.trim:  # marks that stood in the text go like blanks
            body = body.rstrip(self.blank)
        return body + self.affix if self.at_end and body else body

    def _mapped(self, text: str) -> str:
        out, at, after_blank = [], 0, self.trim
        while at < len(text):
            found = self.special.search(text, at)
            start = found.start() if found else len(text)
            if start > at:
                out.append(text[at:start])
                after_blank, at = False, start
                continue
            piece, end = text[at], at + 1
            node, k, own = self.arcs, at, False
            while k < len(text) and (node := node.get(text[k])) is not None:
                k += 1
                if "" in node and (node[""] is None or not own):
                    own = own or node[""] is None
                    piece, end = text[at:k] if node[""] is None else node[""], k
            if after_blank:
                piece = piece.lstrip(" ")
            if piece:
                out.append(piece)
                after_blank = self.trim and piece.endswith(" ")
            at = end
        return "".join(out)


def read_charsmap(raw: bytes) -> dict[str, str]:
    """Keys and replacements of a compiled character map: a double-array trie, then strings that end in a zero byte."""
    size = int.from_bytes(raw[:4], "little")
    units, strings = np.frombuffer(raw[4 : 4 + size], "<u4").astype(np.int64), raw[4 + size :]
    offsets = (units >> 10) << ((units & 512) >> 6)
    labels = units & 0x800000FF
    found, bytes_ = {}, np.arange(1, 256)
    open_ = [(int(offsets[0]), b"")]
    while open_:
        node, key = open_.pop()
        places = node ^ bytes_
        places, own = places[places < len(units)], bytes_[places < len(units)]
        for c in own[labels[places] == own].tolist():
            child = int(node ^ c ^ offsets[node ^ c])
            if units[node ^ c] >> 8 & 1:
                at = int(units[child] & 0x7FFFFFFF)
                found[(key + bytes([c])).decode("utf-8", "replace")] = strings[at : strings.index(b"\0", at)].decode("utf-8", "replace")
            open_.append((child, key + bytes([c])))
    return found


class PieceTransducer:
    """The compiled machines of one model file, and their composition with an input."""

    def __init__(self, model: str | bytes) -> None:
        raw = model if isinstance(model, bytes) else open(model, "rb").read()  # noqa: SIM115
        self.pieces: list[str] = []
        self.weights: list[float] = []
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.arcs: dict[str, int] = {}
        self.unused: set[str] = set()
        self.user: list[str] = []
        self.unknown = 0
        trainer: dict[int, object] = {}
        normaliser: dict[int, object] = {}
        for number, value in _fields(raw):
            if number == _PIECES:
                own = dict(_fields(value))
                piece, kind = own.get(1, b"").decode("utf-8"), own.get(3, _NORMAL)
                score = float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0
                i = len(self.pieces)
                self.pieces.append(piece)
                self.weights.append(-score)
                self.bytes_of.append(b"" if kind in (_CONTROL, _UNKNOWN_TYPE) else bytes([int(piece[3:5], 16)]) if kind == _BYTE else piece.replace(BLANK, " ").encode())
                if kind == _BYTE:
                    self.byte_ids[int(piece[3:5], 16)] = i
                elif kind == _UNKNOWN_TYPE:
                    self.unknown = i
                elif kind in (_NORMAL, _USER, _UNUSED):
                    self.arcs[piece] = i
                    if kind == _USER:
                        self.user.append(piece)
                    elif kind == _UNUSED:
                        self.unused.add(piece)
            elif number == _TRAINER:
                trainer = dict(_fields(value))
            elif number == _NORMALISER:
                normaliser = dict(_fields(value))
        self.merges = trainer.get(_MODEL_TYPE, _UNIGRAM) == _MERGES
        self.bytes_of[self.unknown] = trainer.get(_UNKNOWN_SURFACE, " \u2047 ".encode()) if self.pieces else b""
        self.dummy_prefix, self.trim_spaces = bool(normaliser.get(_DUMMY_PREFIX, 1)), bool(normaliser.get(_EXTRA_SPACES, 1))
        self.suffix = bool(trainer.get(_SUFFIX, 0))
        self.normalised = Normaliser(
            read_charsmap(normaliser[_CHARSMAP]) if normaliser.get(_CHARSMAP) else {}, self.user,
            self.dummy_prefix, self.trim_spaces, bool(normaliser.get(_ESCAPE, 1)), self.suffix)
        normal = [self.weights[k] for p, k in self.arcs.items() if p not in self.unused and p not in self.user]
        #: Weight of the arc that takes a character without a piece of its own.
        self.fallback_weight = 10.0 + max(normal, default=0.0)
        if not self.merges:
            for u in self.user:  # a fixed light weight, lighter by length only where scores are above zero
                self.weights[self.arcs[u]] = len(u.encode()) * min([0.0, *normal]) + 0.1
            self.arcs = {p: k for p, k in self.arcs.items() if p not in self.unused}
        #: In a merge model a user-defined piece is cut out before pieces are read.
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.user, key=len, reverse=True))) + ")") if self.merges and self.user else None
        #: Neighbours inside some piece; between any others the machine is back in its start state.
        self.inside = {p[i : i + 2] for p in self.arcs for i in range(len(p) - 1)}
        # A blank mark begins a piece and never follows another character in one, and a line break is in none:
        # then the machine is back in its start state at each, and segments are independent.
        inner = any(BLANK in p.lstrip(BLANK) for p in self.arcs)
        self.segment = None if inner else re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n" if not any("\n" in p for p in self.arcs) else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+").findall
        #: What is composed on the way: states of the piece machine, weights of neighbours, how a piece was merged.
        self.trie: list[dict[str, int]] = []
        self.ends: list[bool] = []
        self.longest = 1
        self.pairs: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.known: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}
        self.dtype = np.dtype("<u2" if len(self.pieces) <= 65_536 else "<u4")

    # Piece machine: a trie whose states are prefixes; where a piece ends, an arc leads back to the start.
    def _compile(self) -> None:
        self.trie, self.ends, self.longest = [{}], [False], max(map(len, self.arcs), default=1)
        for piece in self.arcs:
            if self.merges and (len(piece) > 1 and not self.merged_from(piece)):
                continue  # merging never makes it
            state = 0
            for c in piece:
                nxt = self.trie[state].get(c)
                if nxt is None:
                    nxt = self.trie[state][c] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(False)
                state = nxt
            self.ends[state] = True

    # Merge order, as weights of neighbours.
    def _rank(self, piece: str) -> float:
        k = self.arcs.get(piece)
        return INFINITY if k is None else self.weights[k]

    def _meet(self, left: str, right: str, whole: bool) -> bool:
        """Whether merging leaves two pieces side by side (``whole``: until it merges the two).

        The last merges of both are undone, latest first. Pieces that face each other on
        the way were neighbours until the piece just undone was merged; a merge of the two
        that ranks before it would have come first. Of equal ranks the left one is first.
        """
        limit, ties = INFINITY, False
        while True:
            if not whole:
                k = self._rank(left + right)
                if k < limit or ties and k == limit:
                    return False
            whole = False
            made_left = self._rank(left) if len(left) > 1 else -INFINITY
            made_right = self._rank(right) if len(right) > 1 else -INFINITY
            if made_left == made_right == -INFINITY:
                return True
            if made_left > made_right:
                limit, ties, left = made_left, False, self.merged_from(left)[1]
            else:
                limit, ties, right = made_right, True, self.merged_from(right)[0]

    def merged_from(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes a piece from its characters; None if none does."""
        if piece not in self.halves:
            self.halves[piece] = next((
                (piece[:i], piece[i:]) for i in range(1, len(piece))
                if all(len(x) == 1 or x in self.arcs and x not in self.user and self.merged_from(x) for x in (piece[:i], piece[i:])) and self._meet(piece[:i], piece[i:], True)), None)
        return self.halves[piece]

    def pair_weight(self, left: str, right: str) -> float:
        """0 where merging leaves the two pieces side by side (the first may be empty), infinity elsewhere."""
        if not left or not self.merges:
            return 0.0
        ok = self.pairs.get((left, right))
        if ok is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            ok = self.pairs[left, right] = self._meet(left, right, False)
        return 0.0 if ok else INFINITY

    # Composition and shortest path.
    def _piece_ends(self, text: str, at: int) -> list[int]:
        """Where the pieces end that can be read from a place: the arcs of the piece machine composed with the input."""
        trie, ends, found, state, k = self.trie, self.ends, [], 0, at
        while k < len(text):
            state = trie[state].get(text[k])
            if state is None:
                break
            k += 1
            if ends[state]:
                found.append(k)
        return found

    def shortest_path(self, text: str) -> list[str]:
        """The pieces (or characters without one) on the path of least weight over a normalised segment."""
        if not self.trie:
            self._compile()
        return self._merge_path(text) if self.merges else self._score_path(text)

    def _score_path(self, text: str) -> list[str]:
        """States are places: the least weight to each, by arcs in the order of their starts."""
        best = [0.0] + [INFINITY] * len(text)
        back = array("q", [0]) * (len(text) + 1)
        for start in range(len(text)):
            here, ends = best[start], self._piece_ends(text, start)
            for end in ends:
                weight = here + self.weights[self.arcs[text[start:end]]]
                if weight < best[end]:
                    best[end], back[end] = weight, start
            if (not ends or ends[0] != start + 1) and here + self.fallback_weight < best[start + 1]:
                best[start + 1], back[start + 1] = here + self.fallback_weight, start
        out, at = [], len(text)
        while at:
            out.append(text[back[at] : at])
            at = back[at]
        return out[::-1]

    def _merge_path(self, text: str) -> list[str]:
        """States are places and the piece that ends there, so that the weights of neighbours are arcs' weights.

        Least weight first, and of equal weights the state last reached, by longer pieces
        before shorter ones: weights being 0 or infinity, the first complete path is a
        shortest one, and no state is entered twice.
        """
        n, pairs, arcs_from = len(text), self.pairs, self._arcs_from
        path: list[str] = []
        entered: set[tuple[int, int]] = set()
        open_ = [(0, "", arcs_from(text, 0))]
        while open_:
            at, last, ends = open_[-1]
            while ends:
                end = ends.pop()
                piece = text[at:end]
                ok = pairs.get((last, piece)) if last else True
                if ok is None:
                    ok = self.pair_weight(last, piece) == 0.0
                if ok and (end, end - at) not in entered:
                    path.append(piece)
                    if end == n:
                        return path
                    entered.add((end, end - at))
                    open_.append((end, piece, arcs_from(text, end)))
                    break
            else:
                open_.pop()
                if path:
                    path.pop()
        return self._least_unfit_path(text)

    def _arcs_from(self, text: str, at: int) -> list[int]:
        """Ends of the arcs from a place, the shortest first; the first character's own is always among them."""
        ends = self._piece_ends(text, at)
        return ends if ends and ends[0] == at + 1 else [at + 1, *ends]

    def _least_unfit_path(self, text: str) -> list[str]:
        """Where no path is of finite weight (no such text is known for the default model), an unfit pair weighs one."""
        n, wide = len(text), self.longest + 1
        live: dict[int, dict[int, float]] = {0: {0: 0.0}}  # place: {length of the last piece: weight}
        back = array("H", [0]) * ((n + 1) * wide)
        for at in range(n):
            here = live.pop(at, {})
            for end in self._arcs_from(text, at):
                weights = {size: weight + (self.pair_weight(text[at - size : at], text[at:end]) > 0) for size, weight in here.items()}
                size = min(weights, key=weights.get)
                live.setdefault(end, {})[end - at] = weights[size]
                back[end * wide + end - at] = size
        out, at, size = [], n, min(live[n], key=live[n].get)
        while at:
            out.append(text[at - size : at])
            at, size = at - size, back[at * wide + size]
        return out[::-1]

    # Byte fallback.
    def ids_of(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if (k := self.arcs.get(p)) is not None:
                if p in self.unused:  # merged and then taken apart again
                    out += self.ids_of(list(self.merged_from(p)) if len(p) > 1 else [])
                else:
                    out.append(k)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def encode_packed(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian numbers of ``dtype``; null counts as empty."""
        line = self.normalised(text or "")
        if not line:
            return b""
        if self.cut:
            packed = b"".join(
                np.array([self.arcs[part]], dtype=self.dtype).tobytes() if i % 2 else self._segments(part)
                for i, part in enumerate(self.cut.split(line)) if part)
        else:
            packed = self._segments(line)
        if not self.byte_ids:  # unknown characters side by side are one unknown piece
            ids = np.frombuffer(packed, dtype=self.dtype)
            again = np.zeros(len(ids), bool)
            again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
            packed = ids[~again].tobytes()
        return packed

    def _segments(self, line: str) -> bytes:
        segments = self.segment(line) if self.segment else [line]
        known = self.known
        try:
            return b"".join(map(known.__getitem__, segments))
        except KeyError:
            pass
        if len(known) > CACHE_SEGMENTS:
            known.clear()
        for s in segments:
            if s not in known:
                known[s] = self._segment_ids(s)
        return b"".join(map(known.__getitem__, segments))

    def _segment_ids(self, segment: str) -> bytes:
        """Ids of a segment, stretch by stretch between neighbours that are in no piece."""
        out, inside, known, start = [], self.inside, self.stretches, 0
        for i in range(1, len(segment) + 1):
            if i == len(segment) or segment[i - 1 : i + 1] not in inside:
                part = segment[start:i]
                ids = known.get(part)
                if ids is None:
                    if len(known) > CACHE_SEGMENTS:
                        known.clear()
                    ids = known[part] = np.array(self.ids_of(self.shortest_path(part)), dtype=self.dtype).tobytes()
                out.append(ids)
                start = i
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype=self.dtype).tolist()

    def decode_packed(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 come out as replacement characters."""
        table, rest = self.bytes_of, np.frombuffer(ids, dtype=self.dtype).tolist()
        head, at = b"", 0
        while at < len(rest) and not head and (self.dummy_prefix or self.trim_spaces):  # the mark that the normaliser put first
            k = rest[at]
            head, at = table[k], at + 1
            if self.pieces[k].startswith(BLANK):
                head = head[1:]
                if not self.trim_spaces:
                    break
        return (head + b"".join([table[k] for k in rest[at:]])).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.decode_packed(np.array(ids, dtype=self.dtype).tobytes())


@cache
def transducer(model: str) -> PieceTransducer:
    return PieceTransducer(model)


def encode(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row; null and empty texts have no ids."""
    path = model or default_model()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fst = transducer(path)
        ids = [np.frombuffer(fst.encode_packed(t), dtype=fst.dtype).astype(np.int32) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), text), run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None, ids: str = "ids") -> DataFrame:
    """(doc_id, text) of each row of ids; null ids give a null text."""
    path = model or default_model()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fst = transducer(path)
        texts = [None if x is None else fst.decode(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_batches(encoded.select("doc_id", ids), run, f"doc_id {kind}, text string")


def digest(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pieces, n_bytes (byte-fallback ids), ids_crc32 (ids as little-endian unsigned 32-bit numbers), round_trip.

    round_trip says whether decoding the ids gives the text again.
    """
    path = model or default_model()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fst = transducer(path)
        is_byte = np.zeros(len(fst.pieces), bool)
        is_byte[list(fst.byte_ids.values())] = True
        n, fallback, crc, same = [], [], [], []
        for t in batch.column(1).to_pylist():
            packed = fst.encode_packed(t)
            ids = np.frombuffer(packed, dtype=fst.dtype)
            n.append(len(ids))
            fallback.append(int(is_byte[ids].sum()))
            crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            same.append(fst.decode_packed(packed) == (t or ""))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, fallback, crc)), pa.array(same)],
            names=["doc_id", "n_pieces", "n_bytes", "ids_crc32", "round_trip"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), text), run, f"doc_id {kind}, n_pieces bigint, n_bytes bigint, ids_crc32 bigint, round_trip boolean")
