"""SentencePiece encoding with spans, and decoding.

``encode`` normalises every whole text the way the model's normaliser
specification says (compiled character map, longest prefix first; dummy
prefix; white space to U+2581) while it records, for each normalised byte, the
source byte it comes from.  The installed library cuts the text into ids; the
byte lengths of the pieces cut the normalised text into the same parts, and
the alignment projects every part to a span of the original bytes.

Defined results: null text counts as empty; an empty text has no ids but the
end id (if asked for), whose span is empty at the end of the text; invalid
UTF-8 bytes count as U+FFFD each, as in the library.  Rows are independent, so
repeated rows and empty tables need nothing special, and only the id and the
text are read.  Texts are worked on in blocks of ``BLOCK_BYTES``, a longer text
alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import lean

BLOCK_BYTES = 1 << 18
SPACE_MARK = "▁".encode()
SCHEMA = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"


def _wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message."""
    at = 0

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value, at

    while at < len(data):
        key, at = varint(at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ((4, at) if kind == 5 else (8, at))
            value, at = data[at:at + size], at + size
        yield number, value


@dataclass
class Normaliser:
    """A model's normaliser with source alignment."""

    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    mark_spaces: bool = True
    _units: tuple = field(default=(), init=False)
    _strings: bytes = field(default=b"", init=False)
    _seen: dict = field(default_factory=dict, init=False)

    def __post_init__(self) -> None:
        if self.charsmap:
            size = struct.unpack_from("<I", self.charsmap)[0]
            self._units = struct.unpack_from(f"<{size // 4}I", self.charsmap, 4)
            self._strings = self.charsmap[4 + size:]

    @classmethod
    def of_model(cls, model: bytes) -> Normaliser:
        """Read the specification (field 3 of a model); its fields: 2 character
        map, 3 dummy prefix, 4 remove extra spaces, 5 mark spaces."""
        spec = dict(_wire(next((v for n, v in _wire(model) if n == 3), b"")))
        return cls(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))

    @property
    def plain(self) -> bool:
        """Nothing to do but the prefix and the space marks."""
        return not self.charsmap and not self.trim_spaces and self.mark_spaces

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry of the map that starts
        at ``at``.  The map is a double array: a unit holds the offset to its
        children (bits 10 up, times 256 if bit 9 is set), bit 8 says that a
        value follows, bits 0-7 (and 31) are the label."""
        if not self._units:
            return None

        def offset(unit: int) -> int:
            return (unit >> 10) << ((unit & 0x200) >> 6)

        node, best = offset(self._units[0]), None
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(self._units):
                break
            unit = self._units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= offset(unit)
            if unit & 0x100:
                best = (k + 1 - at, self._units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        start = best[1]
        return best[0], self._strings[start:self._strings.index(0, start)]

    def steps(self, text: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(start, length, replacement) of each prefix that is consumed."""
        at = 0
        while at < len(text):
            found = self.longest(text, at)
            if found is not None:
                yield at, *found
                at += found[0]
                continue
            width = 1 + sum(text[at] >= x for x in (0xC0, 0xE0, 0xF0))
            piece = text[at:at + width]
            try:
                piece.decode()
            except UnicodeDecodeError:
                width, piece = 1, "�".encode()
            yield at, width, piece
            at += width

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and for the end) the
        source byte where its part starts."""
        mark = SPACE_MARK if self.mark_spaces else b" "
        out, source = bytearray(), []

        def put(piece: bytes, at: int) -> None:
            out.extend(piece)
            source.extend([at] * len(piece))

        parts = self.steps(text)
        last_space = self.trim_spaces
        end = 0
        started = False
        for at, width, piece in parts:
            if not started:
                if self.trim_spaces and not piece.strip(b" "):
                    continue
                if self.dummy_prefix:
                    put(mark, at)
                    last_space = last_space or False
                started = True
            if self.trim_spaces and last_space:
                piece = piece.lstrip(b" ")
            for byte in piece:
                put(mark if byte == 0x20 else bytes((byte,)), at)
            if piece:
                last_space = self.trim_spaces and piece.endswith(b" ")
            end = at + width
        if self.trim_spaces:
            while out.endswith(mark) and out:
                del out[-len(mark):]
                end = source[-len(mark)]
                del source[-len(mark):]
        return bytes(out), np.array([*source, end if started else 0], dtype=np.int64)

    def cut(self, text: bytes, bounds: np.ndarray) -> np.ndarray:
        """Source bytes of the given bounds in the normalised text."""
        if self.plain:
            widths = np.where(np.frombuffer(text, np.uint8) == 0x20, len(SPACE_MARK), 1)
            starts = np.cumsum(widths) - widths + len(SPACE_MARK) * self.dummy_prefix
            return np.searchsorted(starts, bounds)
        source = self(text)[1]
        return source[np.minimum(bounds, len(source) - 1)]


class Codec:
    """The library's processor with the normaliser and the piece lengths."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=model)
        self.normaliser = Normaliser.of_model(model)
        n = self.library.vocab_size()
        self.widths = np.array([0 if self.library.is_control(i) else 1 if self.library.is_byte(i)
                                else len(self.library.id_to_piece(i).encode()) for i in range(n)], dtype=np.int64)

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one source byte of every id."""
        bounds = np.concatenate(([0], np.cumsum(self.widths[ids])))
        try:
            text.decode()
            at = self.normaliser.cut(text, bounds)
        except UnicodeDecodeError:   # U+FFFD is longer than the byte it stands for
            source = self.normaliser(text)[1]
            at = source[np.minimum(bounds, len(source) - 1)]
        return at[:-1], at[1:]


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def _blocks(texts: list[bytes]) -> Iterator[slice]:
    """Slices of about BLOCK_BYTES of text."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > BLOCK_BYTES:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if texts:
        yield slice(start, len(texts))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _encode_batches(model: bytes, end_id: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(model)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in _blocks(texts):
                raw = texts[part]
                ids = work.library.encode([t.decode("utf-8", "replace") if _valid(t) else t for t in raw],
                                          add_eos=end_id)
                decoded = work.library.decode(ids)
                arrays = [np.array(x, dtype=np.int64) for x in ids]
                spans = [work.spans(t, x) for t, x in zip(raw, arrays, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(part.start, part.stop - part.start), _lists(arrays),
                     _lists([s[0] for s in spans]), _lists([s[1] for s in spans]), pa.array(decoded, pa.string())],
                    names=["doc_id", "ids", "begins", "ends", "decoded"])
    return run


def _valid(text: bytes) -> bool:
    try:
        text.decode()
        return True
    except UnicodeDecodeError:
        return False


def encode(docs: DataFrame, model: str | bytes, id_col: str = "doc_id", text_col: str = "text",
           end_id: bool = True) -> DataFrame:
    """Per row: doc_id, ids, the span of original bytes of each id, and the
    text that the ids decode to.  ``model``: the file or its bytes (they go to
    the tasks with the code; a model has a fixed size)."""
    data = model if isinstance(model, bytes) else Path(model).read_bytes()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(lean(_encode_batches(data, end_id)), SCHEMA)


def decode(ids: DataFrame, model: str | bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded text of each list of ids (null: empty)."""
    data = model if isinstance(model, bytes) else Path(model).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = codec(data).library
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = library.decode([x or [] for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = ids.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                      F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return rows.mapInArrow(lean(run), "doc_id long, text string")
