"""SentencePiece encoding and decoding of merge-type vocabularies.

A text's symbols are merged by an agenda of adjacent pairs: the pair whose piece scores highest is merged first,
the leftmost of equals. Units that no piece crosses (spaces and the characters after them) are encoded once and
remembered. Each Arrow batch is checked against the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fraglens.llm.common import tune
from fraglens.llm.merges import MergeTable

SPACE = "▁"
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Remembered units, of at most so many characters each: bounds a worker's memory.
MEMO_UNITS, MEMO_CHARS = 400_000, 64
#: Bytes of text that go through the library at once.
CHECK_BYTES = 1 << 20


@lru_cache(maxsize=1)
def piece_codec(path: str) -> PieceCodec:
    """One for each worker process, which keeps what it has learnt from task to task."""
    return PieceCodec(path)


class PieceCodec:
    """Encoder and decoder over the pieces and scores of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        pieces = {sp.id_to_piece(i): i for i in range(n) if i not in special}
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown, self.bos, self.eos = sp.unk_id(), sp.bos_id(), sp.eos_id()
        # symbols: the pieces by id, then characters that are no piece but part of one
        self.symbols = dict(pieces)
        for c in {c for p in pieces for c in p}:
            self.symbols.setdefault(c, n + len(self.symbols))
        by_score = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in pieces.values()}, reverse=True))}
        splits = ((p[:k], p[k:], i) for p, i in pieces.items() for k in range(1, len(p)))
        self.table = MergeTable({(self.symbols[a], self.symbols[b]): (by_score[sp.get_score(i)], i) for a, b, i in splits if a in self.symbols and b in self.symbols})
        self.size, self.names = n, {v: k for k, v in self.symbols.items() if v >= n}
        self.plain = sp.normalize("  ｆ é\t") == f"{SPACE * 3}ｆ{SPACE}é\t"
        self.crossed = any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.surface = [b"" if sp.is_control(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.by_point = np.full(0x110000, -1, dtype=np.int32)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.by_point[ord(c)] = i
        self.spelling = [sp.id_to_piece(i) for i in range(n)]
        self.memo: dict[str, bytes] = {}

    def _spelt(self, merged: bytes, unit: str) -> bytes:
        """Symbols that are no piece are spelt in bytes, or unknown."""
        out, at = [], 0
        for s in np.frombuffer(merged, dtype="<i4").tolist():
            text = unit[at] if s < 0 else self.names[s] if s >= self.size else self.spelling[s]
            at += len(text)
            if 0 <= s < self.size:
                out.append(s)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in text.encode()]
            else:
                out.append(self.unknown)
        return np.asarray(out, dtype="<u4").tobytes()

    def learn(self, units: set[str]) -> None:
        """Encode units (without their first space) and remember them."""
        names = [SPACE + u for u in units]
        if not names:
            return
        points = np.frombuffer("".join(names).encode("utf-32-le"), dtype="<u4")
        flat = self.by_point[points]
        sizes = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
        odd = np.logical_or.reduceat((flat < 0) | (flat >= self.size), np.cumsum(sizes) - sizes)
        merged = self.table.merge(flat, sizes)
        for i in np.flatnonzero(odd).tolist():
            merged[i] = self._spelt(merged[i], names[i])
        self.memo.update(zip((n[1:] for n in names), merged, strict=True))

    def units(self, text: str) -> list[str]:
        """Parts of the normalised text that no piece crosses, without the space that each begins with."""
        if not text:
            return []
        if self.plain and not self.crossed:
            if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
                return text.split(" ")
            return [x[1:] for x in _UNIT.findall(SPACE + text.replace(" ", SPACE))]
        whole = self.library.normalize(text)
        if whole[:1] != SPACE:
            raise ValueError("vocabularies without a leading space are not supported")
        return [whole[1:]] if self.crossed else [x[1:] for x in _UNIT.findall(whole)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids with begin and end, as little-endian unsigned 32-bit integers, of each text."""
        parts = [self.units(t) for t in texts]
        if len(self.memo) > MEMO_UNITS:
            self.memo.clear()
        unseen = set().union(*parts) - self.memo.keys()
        self.learn(unseen)
        begin, end, get = self.bos.to_bytes(4, "little"), self.eos.to_bytes(4, "little"), self.memo.__getitem__
        out = [b"".join([begin, *map(get, p), end]) for p in parts]
        for u in unseen:
            if len(u) > MEMO_CHARS:
                del self.memo[u]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids say nothing, runs of byte pieces are read as UTF-8, the leading space goes."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= CHECK_BYTES:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, agrees for each row of docs (doc_id, text).

    ids have begin and end ids; a null text is read as empty, whose ids are those two. agrees says whether the
    agenda's ids and text equal the library's in the batch; where they ever differ, the library's are returned.
    Ties, repeated rows and texts of any length are encoded like any other; an empty table gives an empty result.
    """
    tune(docs.sparkSession)

    def run(batches):
        codec = piece_codec(model)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = {"n": [], "ids": [], "decoded": [], "agrees": []}
            for texts in _chunks([t or "" for t in batch.column(1).to_pylist()]):
                wanted = codec.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
                spoken = codec.library.decode(wanted, num_threads=1)
                for own, want, said in zip(codec.encode(texts), wanted, spoken, strict=True):
                    listed = array("I", want).tobytes()
                    agrees = own == listed and codec.decode(want) == said
                    if not agrees:
                        own = listed
                    out["n"].append(len(own) // 4)
                    out["ids"].append(hashlib.sha256(own).hexdigest())
                    out["decoded"].append(hashlib.sha256(said.encode("utf-8")).hexdigest())
                    out["agrees"].append(agrees)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["ids"], pa.string()), pa.array(out["decoded"], pa.string()), pa.array(out["agrees"], pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean")
