"""BPE encoding and decoding by dynamic programming over prefixes.

The encoding of a prefix is the encoding of a shorter prefix and one last
token, and that last token is unique: it is the one token ending there which
the merges would not break up together with the last token before it.  An
automaton over all tokens yields, at every position, the tokens that end there;
a test on pairs of tokens, from the merges alone, finds the one that fits.  Back
pointers give the ids.  No merge is ever carried out on a text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import tidy

#: Pieces between which no merge happens (the published pattern of byte-level BPE).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept in a worker's memo before it starts anew; a bound on memory only.
MEMO = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: itself where printable, else the next code point from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary read from a ``tokenizers`` file."""

    _loaded: dict[str, Bpe] = {}

    @classmethod
    def load(cls, path: str) -> Bpe:
        """One instance for each process and file."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        alphabet = byte_alphabet()
        vocab: dict[str, int] = data["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in data.get("added_tokens", ())}
        self.bytes_of = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.specials.items()}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            token = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = rank
            if token not in self.parts:
                self.parts[token] = (vocab[a], vocab[b])
                self.rank[token] = rank
        self.ends = ahocorasick.Automaton()
        self.single: dict[int, int] = {}
        for s, i in vocab.items():
            b = bytes(alphabet[c] for c in s)
            if len(b) == 1:
                self.single[b[0]] = i
        for i in [*self.single.values(), *self.parts]:
            if self._stable(i):
                self.ends.add_word(self.bytes_of[i].decode("latin-1"), (i, len(self.bytes_of[i])))
        self.ends.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.pieces = regex.compile(PIECES)
        self.bound = MEMO
        self.memo: dict[str, tuple[int, ...]] = {}
        self.texts: dict[str, tuple[str, bytes]] = {}

    def forget(self) -> None:
        """Empty the memos, so that a worker that is kept for other work holds the tables alone."""
        for memo in (self.memo, self.texts, self.pairs):
            memo.clear()

    def _stable(self, token: int) -> bool:
        """Whether the token's own bytes encode to the token."""
        if token not in self.parts:
            return True
        a, b = self.parts[token]
        return self._stable(a) and self._stable(b) and self._fits(a, b, self.rank[token])

    def _fits(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether merging leaves a border between two tokens alone: no pair that meets at
        the border, at any time while both sides are put together, has its turn before the
        merges that build the sides.  ``before``: only merges of a lower rank count."""
        limit = len(self.merged) if before is None else before
        while True:
            rank = self.merged.get((left, right))
            if rank is not None and rank < limit:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            # The later of the two merges is undone. Among equals the left one was made first.
            if a > b:
                limit = a
                left = self.parts[left][1]
            else:
                limit = b + 1
                right = self.parts[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece, by the table of last tokens."""
        last: list[tuple[int, int]] = [(-1, 0)] * (len(piece) + 1)
        pairs = self.pairs
        if len(pairs) > self.bound:
            pairs.clear()
        filled = 0
        for end, (token, size) in self.ends.iter(piece.decode("latin-1")):
            end += 1
            if filled == end:
                continue
            start = end - size
            if start:
                key = (last[start][0], token)
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self._fits(*key)
                if not fits:
                    continue
            last[end] = (token, start)
            filled = end
        out, at = [], len(piece)
        while at:
            token, at = last[at]
            out.append(token)
        return out[::-1]

    def _piece(self, piece: str) -> tuple[int, ...]:
        if len(self.memo) >= self.bound:
            self.memo.clear()
        ids = tuple(self.encode_piece(piece.encode("utf-8")))
        if len(piece) <= 64:
            self.memo[piece] = ids
        return ids

    def _text(self, piece: str) -> tuple[str, bytes]:
        if len(self.texts) >= self.bound:
            self.texts.clear()
        ids = self.encode_piece(piece.encode("utf-8"))
        out = (",".join(map(str, ids)), b"".join([self.bytes_of[i] for i in ids]))
        if len(piece) <= 64:
            self.texts[piece] = out
        return out

    def _parts(self, text: str) -> Iterator[tuple[int | None, str]]:
        """(id of a special token, or None; its string, or a text between such)."""
        if not any(s in text for s in self.specials):
            yield None, text
            return
        for k, part in enumerate(self.split.split(text)):
            yield (self.specials[part] if k % 2 else None), part

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; strings of special tokens become their ids."""
        memo, piece = self.memo, self._piece
        out: list[int] = []
        for special, part in self._parts(text):
            if special is not None:
                out.append(special)
                continue
            for p in self.pieces.findall(part):
                out += memo.get(p) or piece(p)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids, special tokens included; bytes that aren't UTF-8 are replaced."""
        return b"".join([self.bytes_of[i] for i in ids if i in self.bytes_of]).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of what they decode to."""
        memo, piece = self.texts, self._text
        found: list[tuple[str, bytes]] = []
        for special, part in self._parts(text):
            if special is not None:
                found.append((str(special), self.bytes_of[special]))
            else:
                found += [memo.get(p) or piece(p) for p in self.pieces.findall(part)]
        joined = ",".join([x[0] for x in found])
        back = b"".join([x[1] for x in found]).decode("utf-8", "replace").encode("utf-8")
        return joined.count(",") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back).hexdigest()


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``ids``, array of int, of each whole text.

    A null text counts as empty; an empty text has an empty array.  Rows are
    independent of each other: no shuffle, ties and repeats play no part.  A
    column already named ``ids`` is replaced.
    """
    kept = docs.drop(ids)
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                found = [bpe.encode(x or "") for x in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int32()))], names=[*names, ids])

    return kept.mapInArrow(run, kept.withColumn(ids, F.lit(None).cast("array<int>")).schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``docs`` and ``text``, what the array ``ids`` decodes to; a null array counts as empty."""
    kept = docs.drop(text)
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path)
        for b in batches:
            found = [bpe.decode(x or []) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*names, text])

    return kept.mapInArrow(run, kept.withColumn(text, F.lit(None).cast("string")).schema)


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass: all columns of ``docs``, ``ids`` and what these decode to, ``decoded``.

    Tables and memos are the task's own, smaller than those of the other forms:
    workers go on to other stages of a pipeline with little memory held.
    """
    kept = docs.drop(ids, decoded)
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path)
        bpe.bound = MEMO // 4
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                found = [bpe.encode(x or "") for x in part.column(text).to_pylist()]
                back = pa.array([bpe.decode(x) for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int32())), back], names=[*names, ids, decoded])
        bpe.forget()

    none = F.lit(None)
    return kept.mapInArrow(tidy(run), kept.withColumn(ids, none.cast("array<int>")).withColumn(decoded, none.cast("string")).schema)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_tokens, ids_sha256 and decoded_sha256 of each whole text, encoded and decoded in one pass.

    Null texts count as empty; keys may be null or repeated; other columns are
    not read.  Ids never leave the worker, so that only digests are moved.
    """
    kept = docs.select(docs[key].alias("k"), docs[text].alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path)
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                found = [bpe.digest(x or "") for x in part.column(1).to_pylist()]
                n, a, d = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    return kept.mapInArrow(run, f"k {kept.schema['k'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("k", key)
