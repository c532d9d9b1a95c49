"""Packing: concatenate all documents' tokens and cut the row of tokens into fixed windows.

The first pass tokenises every document once, numbers its tokens inside its partition,
and writes that as a table. Totals of the partitions (one number each) give every
partition its place in the whole row of tokens. The second pass reads the table and cuts
each document at the windows' borders; a piece carries its place on both sides.
"""

from __future__ import annotations

import re
import zlib
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import map_batches, written

WINDOW = 2048
END_ID = 1
#: Words whose ids a worker remembers; beyond, it starts afresh.
CACHE_WORDS = 800_000

# Fixed values of the published vocabulary: how its pre-tokeniser divides a text (letters, numbers, other, blanks),
# once for any text and once for texts within Latin-1. Alternatives that begin alike keep their order.
_BLANKS = r"\t-\r \x85\xa0"
_LATIN = {"L": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "N": "0-9\xb2\xb3\xb9\xbc-\xbe", "S": _BLANKS}
_ANY = {"L": r"\p{L}", "N": r"\p{N}", "S": _BLANKS + "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"}
_WORDS = " ?[{L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordEncoder:
    """Ids of whole texts as packed little-endian numbers, word by word, each new word tokenised once.

    A byte-level BPE never merges across the words of its pre-tokeniser, so the ids of a
    text are those of its words in a row. Strings of special tokens in a text are
    ordinary text.
    """

    def __init__(self, vocabulary: str, width: int = 2) -> None:
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(vocabulary).model
        self.latin = re.compile(_WORDS.format(**_LATIN)).findall
        self.any = regex.compile(_WORDS.format(**_ANY)).findall
        self.dtype = np.dtype(f"<u{width}")
        self.known: dict[str, bytes] = {}
        # Byte-level alphabet: printable Latin-1 stands for itself, other bytes for the letters from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.alphabet = {b: b if b in plain else next(others) for b in range(256)}

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any(text)
        return self.latin(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        known, tokenize, alphabet, dtype = self.known, self.model.tokenize, self.alphabet, self.dtype
        for text in texts:
            words = self.split(text)
            try:
                out.append(b"".join(map(known.__getitem__, words)))
                continue
            except KeyError:
                pass
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = np.array([t.id for t in tokenize(w.encode("utf-8", "replace").decode("latin-1").translate(alphabet))], dtype=dtype).tobytes()
            out.append(b"".join(map(known.__getitem__, words)))
        return out


@cache
def encoder(vocabulary: str) -> WordEncoder:
    return WordEncoder(vocabulary)


def tokenised(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part, before, n, ids): the partition, the tokens before the document there, its own, its ids and the end id.

    Ids take two bytes each, so the vocabulary has at most 65,536 entries.
    """
    end = np.array([END_ID], dtype="<u2").tobytes()

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            # Small slices: the ids of many long texts never lie in memory together.
            for k in range(0, batch.num_rows, 500):
                piece = batch.slice(k, 500)
                ids = [x + end for x in encoder(vocabulary).encode([t or "" for t in piece.column(1).to_pylist()])]
                before = list(accumulate((len(x) // 2 for x in ids), initial=at))
                at = before.pop()
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "before", "n", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, part int, before bigint, n bigint, ids binary")


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
         keep_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a window of at most ``window`` tokens.

    Columns: doc_id, start (the document's ids before the piece), length, ids_crc32 (of
    the piece's ids as little-endian unsigned 32-bit numbers), doc_tokens (with the end
    id), sequence_id, offset (in the sequence, gapless from 0), and the ids themselves
    (``ids``, array<int>) if ``keep_ids``. Only the last sequence may be short. Null and
    empty texts are an end id alone. Rows that repeat a document are packed each.

    The ids of a very long text are cut over as many windows as it fills. The token table
    is written once and fixes the order; a lost executor only makes a task read it again.
    It stays until ``common.clear``. The totals broadcast are one number per partition.
    """
    tokens = written(tokenised(docs, vocabulary or default_vocabulary(), doc_id, text), "tokens")
    totals = tokens.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("n")).orderBy("part").collect()
    places = list(accumulate((r["n"] for r in totals), initial=0))
    base = {r["part"]: at for r, at in zip(totals, places, strict=False)}

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, part, before = (batch.column(i).to_pylist() for i in (4, 1, 2))
        row, start, length, crc, whole, sequence, offset, kept = [], [], [], [], [], [], [], []
        for i, (raw, p, b) in enumerate(zip(ids, part, before, strict=True)):
            n, place, done = len(raw) // 2, base[p] + b, 0
            wide = np.frombuffer(raw, dtype="<u2").astype("<u4")
            while done < n:
                at = (place + done) % window
                size = min(n - done, window - at)
                row.append(i)
                start.append(done)
                length.append(size)
                crc.append(zlib.crc32(wide[done : done + size].tobytes()))
                whole.append(n)
                sequence.append((place + done) // window)
                offset.append(at)
                if keep_ids:
                    kept.append(wide[done : done + size].astype(np.int32))
                done += size
        arrays = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, whole, sequence, offset))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if keep_ids:
            arrays.append(pa.array(kept, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return map_batches(tokens, cut, schema + (", ids array<int>" if keep_ids else ""))
