"""The transducer against the published library: merge and score models, character maps, user-defined pieces, the query."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest
import sentencepiece

from foliolens.llm import piece_fst, queries
from foliolens.llm.common import table

SF = "/root/testdata/sf0.001"


def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number: int, value: int | bytes | float) -> bytes:
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model(pieces: list[tuple[str, float, int]], kind: int, charsmap: bytes = b"", byte_fallback: bool = False, prefix: bool = True, trim: bool = True, suffix: bool = False) -> bytes:
    """A model file of given pieces (text, score, type); nothing is trained."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *([(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] if byte_fallback else []), *pieces]
    out = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, t)) for p, s, t in rows)
    out += field(2, field(3, kind) + (field(24, 1) if suffix else b"") + (field(35, 1) if byte_fallback else b""))
    return out + field(3, field(1, b"own") + (field(2, charsmap) if charsmap else b"") + field(3, int(prefix)) + field(4, int(trim)) + field(5, 1))


def nfkc(rule: str = "nmt_nfkc_cf") -> bytes:
    """The library's own compiled character map."""
    proto = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    return dict(piece_fst._fields(dict(piece_fst._fields(proto))[3]))[2]


def score_pieces(rng: random.Random) -> list[tuple[str, float, int]]:
    texts = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(40)} | set("abd") | {"▁", "▁a", "▁ab", "▁b", "fi"}
    return [(t, -rng.randint(8, 80) / 8, 1) for t in sorted(texts)]


def texts(rng: random.Random, alphabet: list[str], n: int = 1500) -> list[str]:
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(n)]


ALPHABET = ["a", "b", "c", "ab", "d", " ", "  ", "z", "é", "\u00a0", "ﬁ", "Ａ", "①", "\t", "\n", "中", "\u3000", "e\u0301", "<x>", "<x", "a b", "▁", "\x01", "…"]


@pytest.mark.parametrize("byte_fallback", [False, True])
@pytest.mark.parametrize("prefix,trim", [(True, True), (False, False), (True, False)])
@pytest.mark.parametrize("mapped", [False, True])
def test_score_models_equal_the_library(byte_fallback, prefix, trim, mapped):
    rng = random.Random(11)
    raw = model(score_pieces(rng), 1, nfkc() if mapped else b"", byte_fallback, prefix, trim)
    fst, library = piece_fst.PieceTransducer(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for text in texts(rng, ALPHABET):
        ids = library.encode(text)
        assert fst.encode(text) == ids, text
        assert fst.decode(ids) == library.decode(ids), text


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("trim", [True, False])
def test_user_defined_and_unused_pieces(kind, trim):
    rng = random.Random(12)
    pieces = [("<x>", 0.0, 4), ("a b".replace(" ", "▁"), 0.0, 4)]
    if kind == 1:
        pieces += score_pieces(rng)
    else:
        merges = ["ab", "▁a", "bc", "abc", "▁ab", "cc", "▁▁", "abcc"]
        pieces += [(m, -float(i), 5 if m in ("bc", "abc") else 1) for i, m in enumerate(merges)] + [(c, -100.0 - i, 1) for i, c in enumerate("▁abcd")]
    raw = model(pieces, kind, nfkc("nfkc") if trim else b"", kind == 2, True, trim)
    fst, library = piece_fst.PieceTransducer(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for text in texts(rng, ALPHABET):
        assert fst.encode(text) == library.encode(text), text


def test_character_map_is_read_whole():
    found = piece_fst.read_charsmap(nfkc())
    assert found["ﬁ"] == "fi" and found["Ａ"] == "a" and found["①"] == "1" and len(found) > 5000


def test_merges_of_the_default_model_equal_the_library():
    fst, library = piece_fst.transducer(piece_fst.default_model()), sentencepiece.SentencePieceProcessor(model_file=piece_fst.default_model())
    rng = random.Random(13)
    made = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(0, 60))) for _ in range(1500)]
    made += ["".join(rng.choices("=-_*#./\\ 0123456789\t\n", k=rng.randint(0, 40))) for _ in range(1500)]
    made += [c * k for c in "ae 0=-.*\n▁x" for k in range(1, 70)]
    for text in made:
        assert fst.encode(text) == library.encode(text), text


def test_the_path_is_the_lightest_of_all():
    rng = random.Random(14)
    fst = piece_fst.PieceTransducer(model(score_pieces(rng), 1))

    def all_paths(text):
        if not text:
            yield 0.0, []
        for i in range(1, len(text) + 1):
            piece = text[:i]
            weight = fst.weights[fst.arcs[piece]] if piece in fst.arcs else fst.fallback_weight if i == 1 else None
            if weight is not None:
                yield from ((weight + w, [piece, *p]) for w, p in all_paths(text[i:]))

    for _ in range(200):
        text = "".join(rng.choices("▁abcz", k=rng.randint(1, 9)))
        path = fst.shortest_path(text)
        assert "".join(path) == text
        assert sum(fst.weights[fst.arcs[p]] if p in fst.arcs else fst.fallback_weight for p in path) == min(w for w, _ in all_paths(text))


def test_columns_of_the_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_fst.default_model())
    rows = table(spark, SF, "documents").select("doc_id", "text").toPandas()
    got = queries.op3_pieces(spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(rows)
    for i, text in zip(rows.doc_id, rows.text, strict=True):
        ids = library.encode(text or "")
        own = got.loc[i]
        assert (own.n_pieces, own.n_bytes) == (len(ids), sum(library.is_byte(k) for k in ids))
        assert own.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert own.round_trip == (library.decode(ids) == (text or ""))


def test_where_no_path_fits_the_fewest_unfit_pairs_are_taken(monkeypatch):
    fst = piece_fst.PieceTransducer(model([("ab", -1.0, 1), ("abc", -2.0, 1), *((c, -9.0, 1) for c in "abcd")], 2, prefix=False))
    assert fst.shortest_path("abcd") == ["abc", "d"]
    fst.pairs.clear()
    monkeypatch.setattr(fst, "pair_weight", lambda left, right: 0.0 if not left else piece_fst.INFINITY)
    assert fst.shortest_path("abcd") == ["abc", "d"] and fst.shortest_path("ab") == ["ab"] and fst.shortest_path("dd") == ["d", "d"]
