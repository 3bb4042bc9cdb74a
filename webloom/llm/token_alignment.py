"""Alignment of two tokenizers over the same texts, and how often their ids
meet across the corpus.

A (byte-level BPE) encodes a space and the text, B (pieces with byte fallback,
which adds the space itself) the text.  Both then cover the same bytes, and a
token's end is a byte offset.  The ends of the two are intersected by
galloping: the shorter list drives, and for each of its ends a search of
doubling steps and then by halves goes on in the longer list.  The common ends
cut the tokens into groups; from one common end to the next the ranks in either
list give the range of tokens that overlap.  Two tokens with the same end are a
link.

No token of either can pass a single space between two printing ASCII
characters (checked on the models, else texts stay whole).  So texts are cut
there into parts.  Parts met first are joined by spaces, encoded and aligned
together, and what they have is remembered; a text is made up of its parts,
since the end of a part is a common end.  This changes no token and no group.

Counts of links per pair of ids cover the corpus.  Documents hold each pair
once with its count, which Spark adds up with partial aggregates; a pair that
all documents share is one row a task.

Defined results: a null or empty text, one that is not valid UTF-8, and one
whose tokens do not give back its bytes (it holds U+2581) have no tokens.
Repeated rows and ids are rows of their own (``row`` tells them apart).  Only
the named columns are read, whatever the others are called.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from itertools import accumulate, chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import joined, lean, written

#: Parts of a text that are aligned at once, characters of texts whose parts
#: are looked up together, and parts that a Python worker remembers before it
#: starts anew.
STRETCH, BATCH, KNOWN = 100_000, 1 << 20, 500_000
#: Pairs of ids that are broadcast; more are joined by their hash.
PAIRS_AT_HAND = 2_000_000
_BORDER = re.compile(r"(?<=[!-~]) (?=[!-~])")
_PLAIN = re.compile(r"[!-~](?:.*[!-~])?", re.DOTALL)
#: A pair of ids as one number: A's id times this, plus B's.
PAIR = 1 << 32


def byte_of() -> dict[str, int]:
    """Byte that a character of a byte-level entry stands for: printing Latin-1
    characters are their own, the others follow from U+0100 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A from its JSON."""

    def __init__(self, spec: bytes) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec.decode())
        self.library.encode_special_tokens = True
        table = byte_of()
        entries = self.library.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes[i] = bytes(table[c] for c in entry)
        told = json.loads(spec)
        before = told.get("pre_tokenizer") or {}
        self.cuts = (told.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                     and not before.get("add_prefix_space", True))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Tokenizer B from its model."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=model)
        names = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        self.bytes = [b"" if self.library.is_control(i) else bytes([int(p[3:5], 16)]) if self.library.is_byte(i)
                      else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


def gallop(short: list[int], long: list[int]) -> tuple[list[int], list[int]]:
    """Indexes in either list of the values that both ascending lists hold."""
    at_short, at_long, j, n = [], [], 0, len(long)
    for i, x in enumerate(short):
        if j == n:
            break
        if long[j] < x:
            low, step = j, 1
            while low + step < n and long[low + step] < x:
                low += step
                step += step
            j = bisect_left(long, x, low + 1, min(low + step, n))
            if j == n:
                break
        if long[j] == x:
            at_short.append(i)
            at_long.append(j)
            j += 1
    return at_short, at_long


def _grown(room: np.ndarray, size: int, more: np.ndarray) -> np.ndarray:
    """``room`` with ``more`` after its first ``size`` numbers, twice as large
    where it is too small."""
    if size + len(more) > len(room):
        room = np.concatenate((room[:size], np.empty(size + 2 * len(more), dtype=np.int64)))
    room[size:size + len(more)] = more
    return room


class Pool:
    """Numbers of the parts known, end to end."""

    def __init__(self) -> None:
        self.values, self.starts, self.parts, self.size = np.empty(0, dtype=np.int64), np.zeros(1, dtype=np.int64), 0, 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.values = _grown(self.values, self.size, values)
        self.starts = _grown(self.starts, self.parts + 1, self.size + np.cumsum(counts))
        self.size += len(values)
        self.parts += len(counts)

    def count(self, known: np.ndarray) -> int:
        return int((self.starts[known + 1] - self.starts[known]).sum())

    def of(self, known: np.ndarray) -> np.ndarray:
        """Those of the parts of these numbers, in their order."""
        first, counts = self.starts[known], self.starts[known + 1] - self.starts[known]
        ends = np.cumsum(counts)
        return self.values[np.repeat(first - ends + counts, counts) + np.arange(ends[-1])]


class Aligner:
    """Both tokenizers, and the aligned parts met lately."""

    def __init__(self, a: bytes, b: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # a task has one core
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.cuts = self.a.cuts and self.b.cuts
        self.widths = [np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (self.a, self.b)]
        names = [str(i) for i in range(max(map(len, self.widths)))]
        self.named = {after: np.array([n + after for n in names], dtype=object) for after in ",|;"}
        self.forget()

    def forget(self) -> None:
        """``ids`` of A and B, ``ranks``: tokens of A and B in each group,
        ``links`` and the groups written out, by the number of a part."""
        self.known: dict[str, int] = {}
        self.ids, self.ranks, self.links, self.texts_out = (Pool(), Pool()), (Pool(), Pool()), Pool(), []

    def parts(self, text: str) -> list[str]:
        """The text without the spaces between its parts, which both encoders
        put back before each."""
        return _BORDER.split(text) if self.cuts else [text]

    def numbers(self, parts: list[str]) -> np.ndarray:
        """Each part's number among those known; -1 where the tokens of either
        do not give back a space and the part."""
        if len(self.known) > KNOWN:
            self.forget()
        found = list(map(self.known.get, parts))
        if None not in found:
            return np.array(found, dtype=np.int64)
        for group in self._together(list(dict.fromkeys(p for p, n in zip(parts, found, strict=True) if n is None))):
            if not self.learn(group):
                for part in group:                                     # told apart: few have other bytes
                    if not (len(group) > 1 and self.learn([part])):
                        self.known[part] = -1
        return np.fromiter(map(self.known.__getitem__, parts), dtype=np.int64, count=len(parts))

    def learn(self, parts: list[str]) -> bool:
        """Encode and align parts that a space may join; False where the tokens
        of either do not give back their bytes."""
        text = " ".join(parts)
        want, ids = b" " + text.encode(), [t.encode([text])[0] for t in (self.a, self.b)]
        if any(b"".join(map(t.bytes.__getitem__, i)) != want for t, i in zip((self.a, self.b), ids, strict=True)):
            return False
        ids = [np.array(i, dtype=np.int64) for i in ids]
        ends = [np.cumsum(w[i]) for w, i in zip(self.widths, ids, strict=True)]
        short = int(len(ends[1]) < len(ends[0]))
        at = [np.array(x, dtype=np.int64) for x in gallop(ends[short].tolist(), ends[1 - short].tolist())]
        at = at[::-1] if short else at
        borders = np.cumsum([len(p.encode()) + 1 for p in parts])
        last = np.searchsorted(ends[0][at[0]], borders)                # a part's last group
        if not np.array_equal(ends[0][at[0]][np.minimum(last, len(at[0]) - 1)], borders):
            return False
        for k in (0, 1):
            self.ids[k].add(ids[k], np.diff(at[k][last] + 1, prepend=0))
            self.ranks[k].add(np.diff(at[k], prepend=-1), np.diff(last + 1, prepend=0))
        self.links.add(ids[0][at[0]] * PAIR + ids[1][at[1]], np.diff(last + 1, prepend=0))
        self.texts_out += self.written_out(ids, at, last)
        self.known.update(zip(parts, range(len(self.texts_out) - len(parts), len(self.texts_out)), strict=True))
        return True

    def written_out(self, ids: list[np.ndarray], at: list[np.ndarray], last: np.ndarray) -> list[str]:
        """The groups of each part as ``a1,a2|b1;``: the ranks from the end of
        one group to the next say which tokens of either it has."""
        (a, b), (a_at, b_at) = ids, at
        a_ranks, b_ranks = np.diff(a_at, prepend=-1), np.diff(b_at, prepend=-1)
        out = np.empty(len(a) + len(b), dtype=object)
        a_to = np.arange(len(a)) + np.repeat(b_at + 1 - b_ranks, a_ranks)         # after B's tokens of the groups before
        b_to = np.arange(len(b)) + np.repeat(a_at + 1, b_ranks)                   # after A's, this group's included
        out[a_to], out[b_to] = self.named[","][a], self.named[","][b]
        out[a_to[a_at]], out[b_to[b_at]] = self.named["|"][a[a_at]], self.named[";"][b[b_at]]
        ends = (b_to[b_at[last]] + 1).tolist()
        return ["".join(out[i:j]) for i, j in zip([0, *ends], ends)]

    @staticmethod
    def _together(parts: list[str]) -> Iterator[list[str]]:
        """Groups of parts that a space may join, and the others alone."""
        group, size = [], 0
        for part in parts:
            if "\u2581" in part or not _PLAIN.fullmatch(part):
                yield [part]
                continue
            group.append(part)
            size += len(part)
            if size > BATCH:
                yield group
                group, size = [], 0
        if group:
            yield group

    def texts(self, texts: list[str | None], outputs: tuple[str, ...]) -> Iterator[dict | None]:
        """The asked outputs of every text, None for those without tokens."""
        parts = [self.parts(t) if t else [] for t in texts]
        i = 0
        while i < len(parts):
            j, size = i, 0
            while j < len(parts) and (j == i or size + len(texts[j] or "") <= BATCH):
                size += len(texts[j] or "")
                j += 1
            if size <= BATCH:
                found, at = self.numbers(list(chain.from_iterable(parts[i:j]))), 0
                for own in parts[i:j]:
                    yield self.merge([found[at:at + len(own)]] if own else [], outputs)
                    at += len(own)
            else:                                                     # one very long text
                yield self.merge((self.numbers(parts[i][k:k + STRETCH]) for k in range(0, len(parts[i]), STRETCH)), outputs)
            i = j

    def merge(self, stretches: Iterable[np.ndarray], outputs: tuple[str, ...]) -> dict | None:
        """Outputs of one text from the numbers of its parts."""
        out = {"n_a": 0, "n_b": 0, "n_groups": 0} | {name: [] for name in outputs}
        before = 0
        for known in stretches:
            if (known < 0).any():
                return None
            ids = [cache(lambda k=k: self.ids[k].of(known)) for k in (0, 1)]
            ends = [cache(lambda k=k: np.cumsum(self.widths[k][ids[k]()])) for k in (0, 1)]
            at = [cache(lambda k=k: np.cumsum(self.ranks[k].of(known)) - 1) for k in (0, 1)]
            values = {"a_ids": ids[0], "b_ids": ids[1], "a_ends": lambda: before + ends[0](), "b_ends": lambda: before + ends[1](),
                      "a_cuts": lambda: out["n_a"] + at[0]() + 1, "b_cuts": lambda: out["n_b"] + at[1]() + 1,
                      "groups": lambda: "".join(map(self.texts_out.__getitem__, known.tolist())),
                      "links": lambda: self.links.of(known)}
            for name in outputs:
                out[name].append(values[name]())
            if "a_ends" in outputs or "b_ends" in outputs:
                before += int(ends[0]()[-1])
            for name, pool in (("n_a", self.ids[0]), ("n_b", self.ids[1]), ("n_groups", self.ranks[0])):
                out[name] += pool.count(known)
        if not out["n_a"]:
            return None
        for name in outputs:
            out[name] = "".join(out[name])[:-1] if name == "groups" else np.concatenate(out[name])
        if "links" in outputs:
            out["links"] = np.unique(out["links"], return_counts=True)
        return out


TYPES = {"a_ids": ("array<int>", pa.list_(pa.int32())), "b_ids": ("array<int>", pa.list_(pa.int32())),
         "a_ends": ("array<long>", pa.list_(pa.int64())), "b_ends": ("array<long>", pa.list_(pa.int64())),
         "a_cuts": ("array<int>", pa.list_(pa.int32())), "b_cuts": ("array<int>", pa.list_(pa.int32())),
         "groups": ("string", pa.string()),
         "links": ("array<struct<pair:long,n:long>>", pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())])))}


@lru_cache(maxsize=1)
def _aligner(key: tuple[str, str], a: bytes, b: bytes) -> Aligner:
    return Aligner(a, b)


def align(docs: DataFrame, a: str | bytes, b: str | bytes, outputs: tuple[str, ...] = tuple(TYPES), id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups and the asked outputs: ids and byte
    ends of the tokens (offsets into a space and the text), the number of tokens
    of either up to the end of each group (``a_cuts``, ``b_cuts``), the groups
    written out, and the links as distinct pairs with their count.

    ``a``, ``b``: the models' files or bytes (they go to the tasks with the
    code; a model has a fixed size)."""
    data = [m if isinstance(m, bytes) else Path(m).read_bytes() for m in (a, b)]
    key = tuple(hashlib.sha256(d).hexdigest() for d in data)
    none = np.empty(0, dtype=np.int64)
    empty = {"n_a": 0, "n_b": 0, "n_groups": 0} | {n: "" if n == "groups" else (none, none) if n == "links" else none for n in outputs}
    numbers = ("n_a", "n_b", "n_groups")

    def emit(ids: list, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r[n] for r in rows], pa.int64()) for n in numbers),
                                           *(_column(n, [r[n] for r in rows]) for n in outputs)], names=["doc_id", *numbers, *outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _aligner(key, *data)
        for batch in batches:
            texts = [_decoded(t.as_py()) for t in batch.column(1)]
            ids, rows, size = [], [], 0
            for doc_id, text, got in zip(batch.column(0).to_pylist(), texts, work.texts(texts, outputs), strict=True):
                ids.append(doc_id)
                rows.append(got or empty)
                size += len(text or "")
                if size >= BATCH:
                    yield emit(ids, rows)
                    ids, rows, size = [], [], 0
            if ids:
                yield emit(ids, rows)

    schema = "doc_id long, n_a long, n_b long, n_groups long" + "".join(f", {n} {TYPES[n][0]}" for n in outputs)
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("binary")).mapInArrow(lean(run), schema)


def _decoded(text: bytes | None) -> str | None:
    try:
        return text.decode() if text else None
    except UnicodeDecodeError:
        return None


def _column(name: str, rows: list) -> pa.Array:
    if name == "groups":
        return pa.array(rows, pa.string())
    kind = TYPES[name][1].value_type
    sizes = [len(r[0]) if name == "links" else len(r) for r in rows]
    if name == "links":
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate([r[k] for r in rows]), pa.int64()) for k in (0, 1)], names=["pair", "n"])
    else:
        flat = pa.array(np.concatenate(rows)).cast(kind)
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), flat)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count over the corpus, and whether no other A id has a higher count
    with its B id; ``aligned`` has ``links``."""
    counts = written(aligned.select(F.explode("links").alias("link")).groupBy(F.col("link.pair").alias("pair"))
                     .agg(F.sum("link.n").alias("count")), "align-pairs")
    b_id = (F.col("pair") % PAIR).alias("b_id")
    highest = written(counts.groupBy(b_id).agg(F.max("count").alias("highest")), "align-highest")
    return joined(counts.withColumn("b_id", b_id), highest, "b_id", "inner").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def with_counts(aligned: DataFrame, at_hand: int = PAIRS_AT_HAND) -> DataFrame:
    """``aligned`` (a written table that has ``row``, unique, and ``links``)
    without its links, and with n_links, n_best (links whose pair is a best one
    of its B id) and count_sum (their corpus counts added up)."""
    pairs = written(pair_counts(aligned), "align-counts")
    links = aligned.select("row", F.explode("links").alias("link")).select("row", "link.pair", "link.n")
    sums = (joined(links, pairs, "pair", "inner", at_hand).groupBy("row")
            .agg(F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
                 F.sum(F.col("n") * F.col("count")).alias("count_sum")).withColumnRenamed("row", "of"))
    out = aligned.drop("links").join(sums, F.col("row") == F.col("of"), "left").drop("of")
    return out.fillna(0, ["n_links", "n_best", "count_sum"])
