"""SentencePiece BPE: offset-preserving encoding, and decoding.

Text is normalised by the model's compiled character map: at each position the
longest prefix that the map knows is replaced, and every byte written notes the
byte it came from.  Pieces of the normalised text are then projected through
these notes to byte spans of the original.

Merges never cross a boundary that no piece spans (before a run of word
marks, and around a line break), so a text is encoded as the sequence of its
segments, and segments repeat: each worker keeps their ids, within bounds.  What
ids read as, and how many bytes they cover, comes from one table of all pieces.

Defined results: null and the empty text have no pieces and decode to the empty
text; rows are independent, so repeats and further columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm.common import tokenizer_file

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
KEPT = 200_000
#: Segments longer than this are not kept; from LONGER on, merges use a heap.
LONG, LONGER = 64, 512
_NONE = float("inf")
#: Characters of text that are encoded before their rows are passed on.
AT_ONCE = 2 << 20


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes, whose
    values are places in a block of NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.out = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix at ``at``, and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        node = _offset(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.out[value:self.out.index(b"\0", value)])
        return found


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 1 << 9) >> 6)


class PieceCodec:
    """Encoder and decoder for a BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with word marks in front is needed")
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.tidy, self.escape = (
            spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.pieces = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.unk_surface = model.trainer_spec.unk_surface
        self.unk = self.types.index(UNKNOWN)
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
        self.rank = {p: -model.pieces[i].score for p, i in self.id_of.items()}
        self.byte_ids = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
        self.fallback = model.trainer_spec.byte_fallback
        if any(t == USER for t in self.types):
            raise ValueError("user-defined pieces are not supported")
        self.names = [str(i) for i in range(len(self.pieces))]
        self.shown = [self.unk_surface if t == UNKNOWN else "" if t == CONTROL else p.replace(MARK, " ")
                      for p, t in zip(self.pieces, self.types, strict=True)]
        self.is_byte = np.array(self.types) == BYTE
        self.values = np.zeros(len(self.pieces), np.uint8)
        self.values[self.byte_ids] = np.arange(256) * self.fallback
        # Bytes of the original under each id, where only blanks were replaced.
        self.width = np.array([1 if t == BYTE else len(p.encode()) - 2 * p.count(MARK) * self.escape
                               for p, t in zip(self.pieces, self.types, strict=True)], np.int32)
        inner = any(MARK in p.lstrip(MARK) for p in self.rank)
        breaks = any("\n" in p for p in self.rank)
        self.segment = re.compile("(?s).+" if inner else
                                  f"{MARK}*[^{MARK}]+|{MARK}+" if breaks else
                                  f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and for each byte of it (and its end) the byte
        of the original that it came from."""
        raw = text.encode("utf-8", "replace")
        space = MARK.encode() if self.escape else b" "
        out, source, at = bytearray(), [], 0
        if self.tidy:
            while at < len(raw):
                n, new = self._step(raw, at)
                if new != b" ":
                    break
                at += n
        if at == len(raw):
            return "", [at]
        if self.dummy:
            out += space
            source += [at] * len(space)
        blank = self.tidy
        while at < len(raw):
            n, new = self._step(raw, at)
            if blank:
                new = new.lstrip(b" ")
            own = new == raw[at:at + n]  # bytes that stay are their own source
            for k, byte in enumerate(new):
                add = space if byte == 0x20 else bytes((byte,))
                out += add
                source += [at + k * own] * len(add)
            if new:
                blank = self.tidy and new.endswith(b" ")
            at += n
        if self.tidy:
            while out.endswith(space):
                at = source[len(out) - len(space)]
                del out[len(out) - len(space):], source[len(out):]
        return out.decode("utf-8", "replace"), [*source, at]

    def _step(self, raw: bytes, at: int) -> tuple[int, bytes]:
        found = self.map.longest(raw, at)
        if found:
            return found
        lead = raw[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, raw[at:at + n]

    def _quick(self, text: str) -> str:
        """The normalised text where no alignment is asked for."""
        if self.map.units or self.tidy:
            return self.normalise(text)[0]
        if not text:
            return ""
        text = (" " if self.dummy else "") + text
        return text.replace(" ", MARK) if self.escape else text

    def merge(self, segment: str) -> list[str]:
        """Pieces of a segment: the best-scored adjacent pair first, the leftmost
        of equals, until none is a piece."""
        get = self.rank.get
        parts = list(segment)
        if len(segment) < LONGER:
            ranks = [get(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
            while ranks and (best := min(ranks)) != _NONE:
                i = ranks.index(best)
                parts[i] += parts.pop(i + 1)
                del ranks[i]
                if i:
                    ranks[i - 1] = get(parts[i - 1] + parts[i], _NONE)
                if i < len(ranks):
                    ranks[i] = get(parts[i] + parts[i + 1], _NONE)
            return parts
        after = list(range(1, len(parts))) + [-1]
        before = list(range(-1, len(parts) - 1))
        heap = []

        def offer(i: int, j: int) -> None:
            r = get(parts[i] + parts[j])
            if r is not None:
                heapq.heappush(heap, (r, i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p]

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            known = self.id_of.get(p)
            if known is not None:
                out.append(known)
            elif self.fallback:
                out.extend(self.byte_ids[b] for b in p.encode("utf-8", "replace"))
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for s in self.segment.findall(self._quick(text or "")) for i in self.ids_of(self.merge(s))]

    def encode_spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(id, begin, end): each piece with its bytes of the original text."""
        norm, source = self.normalise(text or "")
        out, at = [], 0
        for segment in self.segment.findall(norm):
            for piece in self.merge(segment):
                n = len(piece.encode("utf-8", "replace"))
                if piece in self.rank or not self.fallback:
                    out.append((self.ids_of([piece])[0], source[at], source[at + n]))
                else:
                    out.extend((self.byte_ids[b], source[at + k], source[at + k + 1])
                               for k, b in enumerate(piece.encode("utf-8", "replace")))
                at += n
        return out

    def decode(self, ids: list[int]) -> str:
        parts, run, first = [], bytearray(), True
        for i in ids:
            if self.types[i] == BYTE:
                run.append(int(self.pieces[i][1:-1], 16))
                first = False
                continue
            if run:
                parts.append(_read(bytes(run)))
                run.clear()
            if self.types[i] == CONTROL:
                continue
            piece = self.unk_surface if self.types[i] == UNKNOWN else self.pieces[i]
            if first and (self.dummy or self.tidy):
                piece = piece.lstrip(MARK) if self.tidy else piece.removeprefix(MARK)
            parts.append(piece.replace(MARK, " "))
            first = False
        if run:
            parts.append(_read(bytes(run)))
        return "".join(parts)

    def _segment(self, segment: str) -> bytes:
        """Ids of a segment as 32-bit numbers."""
        entry = self.older.get(segment)
        if entry is None:
            pieces = self.merge(segment)
            try:
                ids = [self.id_of[p] for p in pieces]
            except KeyError:
                ids = self.ids_of(pieces)
            entry = array("i", ids).tobytes()
        if len(segment) <= LONG:
            if len(self.kept) >= KEPT:  # what was used lately stays one round longer
                self.older, self.kept = self.kept, {}
            self.kept[segment] = entry
        return entry

    def forget(self) -> None:
        self.kept, self.older = {}, {}

    def ends(self, text: str | None, widths: np.ndarray) -> np.ndarray:
        """Where each piece ends in the bytes of the original text: projected by
        the widths where nothing but blanks was replaced, else by the notes that
        normalisation takes."""
        text = text or ""
        if self.map.units or self.tidy or MARK in text or not self.fallback or (self.escape and not self.dummy):
            return np.array([e for _, _, e in self.encode_spans(text)], np.int32)
        out = np.cumsum(widths, dtype=np.int32)
        return out - 1 if self.dummy else out

    def numbers(self, text: str | None) -> np.ndarray:
        """The ids of a text."""
        get, new = self.kept.get, self._segment
        return np.frombuffer(b"".join([get(s) or new(s) for s in self.segment.findall(self._quick(text or ""))]), np.intc)

    def read(self, ids: np.ndarray) -> str:
        """``decode`` for the ids of a text, run by run of bytes or of pieces."""
        kinds, parts, at = self.is_byte[ids], [], self.shown.__getitem__
        edges = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(ids)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            run = ids[lo:hi]
            parts.append(_read(self.values[run].tobytes()) if lo < hi and kinds[lo] else "".join(map(at, run.tolist())))
        shown = "".join(parts)
        first = (self.dummy or self.tidy) and len(ids) and not kinds[0]
        return shown[1:] if first and shown.startswith(" ") else shown

    def coded(self, text: str | None) -> tuple[str, np.ndarray, str, np.ndarray]:
        """The ids as text and as numbers, the text that they decode to, and how
        many bytes each covers."""
        ids = self.numbers(text)
        return ",".join(map(self.names.__getitem__, ids.tolist())), ids, self.read(ids), self.width[ids]

    def digests(self, text: str | None) -> tuple[int, str, str, str]:
        """Number of ids, and SHA-256 of the ids, of the decoded text and of the
        byte positions where pieces end (32-bit little-endian)."""
        names, ids, shown, widths = self.coded(text)
        ends = self.ends(text, widths).astype("<i4").tobytes()
        return len(ids), _sha(names), _sha(shown), hashlib.sha256(ends).hexdigest()


def _read(run: bytes) -> str:
    """Bytes as text; each that begins no whole character becomes U+FFFD."""
    parts = []
    while True:
        try:
            return "".join([*parts, run.decode()])
        except UnicodeDecodeError as e:
            parts += [run[:e.start].decode(), "�"]
            run = run[e.start + 1:]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One per Python worker; it outlives a task, as the worker does."""
    return PieceCodec(path)


def piece_digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ends_sha256) for every row."""
    path = tokenizer_file(model)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, ends_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        of = codec(path).digests
        return pd.DataFrame([of(t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256", "ends_sha256"])

    return docs.select("doc_id", digest("text").alias("d")).select(
        "doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256", "d.ends_sha256")


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each batch in slices of moderate text, with the texts."""
    for batch in batches:
        texts, lo, size = batch.column("text").to_pylist(), 0, 0
        for hi, t in enumerate(texts, 1):
            size += len(t or "")
            if size >= AT_ONCE or hi == len(texts):
                yield batch.slice(lo, hi - lo), texts[lo:hi]
                lo, size = hi, 0


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows), pa.int32()))


def encode_pieces(docs: DataFrame, model: str = MODEL, spans: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``ids`` and ``decoded``, what the ids decode
    to; with ``spans`` also ``ends``, where every piece ends in the bytes of the
    original text (each begins where the one before ends)."""
    path = tokenizer_file(model)
    more = [("ids", "array<int>"), ("decoded", "string")] + [("ends", "array<int>")] * spans
    taken = {name for name, _ in more}
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path)
        for part, texts in _in_parts(batches):
            ids, decoded, ends = [], [], []
            for t in texts:
                ids.append(of.numbers(t))
                decoded.append(of.read(ids[-1]))
                if spans:
                    ends.append(of.ends(t, of.width[ids[-1]]))
            columns = [*part.columns, _lists(ids), pa.array(decoded, pa.string())] + ([_lists(ends)] if spans else [])
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, *(name for name, _ in more)])
        # The worker goes on to other stages: it keeps the codec, not what this task's texts left in it.
        of.forget()
        pa.default_memory_pool().release_unused()

    fields = T.StructType([*kept.schema.fields, *(T.StructField(name, T.StringType() if kind == "string" else
                                                               T.ArrayType(T.IntegerType())) for name, kind in more)])
    return kept.mapInArrow(encode, fields)


def decode_pieces(rows: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """All columns of ``rows`` but ``decoded``, and the text of ``ids`` as that."""
    path = tokenizer_file(model)

    @F.pandas_udf(T.StringType())
    def decode(lists: pd.Series) -> pd.Series:
        of = codec(path).decode
        return pd.Series([of([int(i) for i in x]) if x is not None else "" for x in lists], dtype=object)

    return rows.withColumn("decoded", decode(ids))
