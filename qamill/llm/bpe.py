"""Byte-level BPE: a backtracking encoder with exact merges in linear time, and a decoder.

A text is cut at special tokens and then into pieces by the public pattern. In each piece the
encoder takes the longest token at every position (Aho-Corasick over the reversed piece gives all
of them in one pass) and keeps it if it may stand after the token before: a pair is compatible if
encoding the two tokens' bytes as one string would give back these very tokens. If not, the next
shorter token is tried, then the token before is taken back. Dead ends are remembered by position,
so the work is linear. Decoding reads all bytes from one blob through a table of offsets.

Token numbers inside are merge ranks (bytes first, then the merges in order), so that the earlier
merge is always the smaller number, whatever the ids of the vocabulary.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qamill.llm.common import text_batches

#: Fixed value: the pattern that cuts text before the merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 400_000  # pieces whose ids a worker remembers; the table is emptied when full


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones stand for themselves, the others follow 255."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Coder:
    """Tables of one vocabulary file (``tokenizers`` JSON, byte-level BPE)."""

    def __init__(self, content: str):
        spec = json.loads(content)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        names = [c for c in letters if c in vocab]
        rank = {c: i for i, c in enumerate(names)}
        self.pair: dict[int, int] = {}  # left * 2^20 + right -> merged
        self.split = [(i, i) for i in range(len(names))]
        for merge in merges:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pair[rank[left] << 20 | rank[right]] = len(names)
            if left + right not in rank:
                rank[left + right] = len(names)
                self.split.append((rank[left], rank[right]))
                names.append(left + right)
        self.ids = np.array([vocab[n] for n in names], dtype=np.int32)
        self.length = [len(n) for n in names]
        search = ahocorasick.Automaton()
        for number, name in enumerate(names):
            search.add_word(name[::-1], number)
        search.make_automaton()
        self.search = search
        prefixes = ahocorasick.Automaton()
        for number, name in enumerate(names):
            prefixes.add_word(name, number)
        self.shorter = []  # the longest token that is a proper prefix
        for name in names:
            cut = len(name) - 1
            while cut and name[:cut] not in prefixes:
                cut -= 1
            self.shorter.append(prefixes.get(name[:cut]) if cut else -1)
        self.to_letters = {b: letters[b] for b in range(256)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut_special = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")"
        ) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.cache: dict[str, bytes] = {}  # ids as bytes: compact, and nothing for the garbage collector
        self.fits: dict[int, bool] = {}
        to_byte = {c: b for b, c in enumerate(letters)}
        pieces = {vocab[n]: bytes(to_byte[c] for c in n) for n in names}
        pieces |= {number: name.encode() for name, number in self.special.items()}
        lengths = np.zeros(max(pieces) + 2, dtype=np.int64)
        for number, piece in pieces.items():
            lengths[number + 1] = len(piece)
        self.offsets = np.cumsum(lengths)
        self.blob = np.frombuffer(b"".join(pieces[n] for n in sorted(pieces)), dtype=np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens before both of them are complete.

        Both tokens are taken apart at the border, the later merge first; a pair at the border
        that would merge earlier than the pieces it takes apart were made breaks them.
        """
        known = self.fits.get(left << 20 | right)
        if known is not None:
            return known
        a, b, limit, good = left, right, len(self.split), None
        while good is None:
            merged = self.pair.get(a << 20 | b)
            if merged is not None and merged < limit:
                good = False
            elif a > b:
                whole, a = a, self.split[a][1]
                limit = whole
                if a == whole:  # a byte: go on with the other side
                    limit, whole, b = b + 1, b, self.split[b][0]
                    good = True if b == whole else None
            else:
                whole, b = b, self.split[b][0]
                limit = whole + 1
                if b == whole:
                    limit, whole, a = a, a, self.split[a][1]
                    good = True if a == whole else None
        if len(self.fits) >= CACHE:
            self.fits.clear()
        self.fits[left << 20 | right] = good
        return good

    def merge(self, letters: str) -> list[int]:
        """Ranks of the tokens of one piece."""
        size = len(letters)
        longest = [-1] * size
        length, compatible, shorter = self.length, self.compatible, self.shorter
        for end, number in self.search.iter(letters[::-1]):
            start = size - 1 - end
            if longest[start] < 0 or length[number] > length[longest[start]]:
                longest[start] = number
        open_at = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if open_at[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == size:
                    return out
                token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= length[token]

    def _piece(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.to_letters)
        found = self.ids[self.merge(letters)].tobytes()
        if len(piece) <= 64:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; none for null or empty."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        runs: list[bytes] = []
        known, make = self.cache.get, self._piece
        for part in self.cut_special.split(text) if self.cut_special else [text]:
            if part in self.special:
                runs.append(np.int32(self.special[part]).tobytes())
            elif part:
                runs += [known(p) or make(p) for p in self.pieces.findall(part)]
        return np.frombuffer(b"".join(runs), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are not UTF-8 become the replacement character."""
        if ids is None or not len(ids):
            return ""
        starts = self.offsets[ids]
        lengths = self.offsets[np.asarray(ids) + 1] - starts
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)
        return self.blob[at].tobytes().decode("utf-8", "replace")


_CODERS: dict[str, Coder] = {}


def _coder(content: str) -> Coder:
    """The tables of a vocabulary, built once per worker."""
    if content not in _CODERS:
        _CODERS.clear()
        _CODERS[content] = Coder(content)
    return _CODERS[content]


def encode_documents(docs: DataFrame, path: str, keep: list[str] | None = None, decode: bool = True) -> DataFrame:
    """Columns ``keep`` (doc_id), ids, and with ``decode`` the decoded text of every row of ``docs``.

    The driver reads the vocabulary file at ``path``, whose size does not depend on the data, and
    broadcasts it. A null or empty text has no ids and decodes to an empty text. Texts are encoded
    whole, a few rows at a time; equal texts get equal ids. Other columns are ignored.
    """
    keep = keep or ["doc_id"]
    with open(path, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    names = [*(f"k{i}" for i in range(len(keep))), "ids", *(["decoded"] if decode else [])]
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("text"))
    fields = [*rows.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*fields, *([T.StructField("decoded", T.StringType())] if decode else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(content.value)
        for batch in text_batches(batches):
            found = [coder.encode(t) for t in batch["text"].to_pylist()]
            ends = np.cumsum([0, *map(len, found)])
            columns = [*batch.columns[:-1], pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))]
            if decode:
                columns.append(pa.array([coder.decode(ids) for ids in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names[len(keep):])


def digest_columns(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    listed: Column = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(listed).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"))
