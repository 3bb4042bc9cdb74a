"""Alignment against whole texts encoded by the libraries, pair by pair."""
import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from webloom.llm import token_alignment as A
from webloom.llm.common import written
from webloom.llm.queries import QUERIES

FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(FILES[0])
LIBRARY.encode_special_tokens = True
PIECES = SentencePieceProcessor(model_file=FILES[1])
LATIN = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
BYTE = LATIN | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in LATIN)}


def plain(text):
    """(A's ids, ends, B's ids, ends) of a whole text, or None."""
    if not text:
        return None
    a, b = LIBRARY.encode(" " + text, add_special_tokens=False).ids, PIECES.encode(text)
    a_bytes = [bytes(BYTE[c] for c in LIBRARY.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(p[3:5], 16)]) if PIECES.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, PIECES.id_to_piece(i)) for i in b)]
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return None
    ends = [[sum(map(len, x[:i + 1])) for i in range(len(x))] for x in (a_bytes, b_bytes)]
    return a, ends[0], b, ends[1]


def groups_of(text):
    got = plain(text)
    if got is None:
        return [], "", Counter()
    a, a_ends, b, b_ends = got
    common = sorted(set(a_ends) & set(b_ends))
    groups, links, low = [], Counter(), 0
    for end in common:
        left, right = [i for i, e in zip(a, a_ends) if low < e <= end], [i for i, e in zip(b, b_ends) if low < e <= end]
        groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
        links[left[-1], right[-1]] += 1
        low = end
    return groups, ";".join(groups), links


def corpus():
    rng = random.Random(8)
    pieces = ["word", "the", "Über", "naïve", "x=1;", "  ", "\n", "\t", "don't", "日本語", "①", "<|endoftext|>", "<0x41>", "</s>", "1234567",
              "é", " ", "🙂🙂", "a.b", "'s", "!!", "\x00", "\r\n", "ﬁ", "A" * 30, "　", " ", "​"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randrange(1, 40))) for _ in range(250)]
    texts += [texts[3]] * 120 + [None, "", " ", "a▁b c", "plain words only", " lead", "trail ", "▁"]
    return [(i, t) for i, t in enumerate(texts)] + [(3, "plain words only"), (None, "plain words only")]


@pytest.mark.parametrize("batch, stretch, known, cuts", [(A.BATCH, A.STRETCH, A.KNOWN, True), (200, 3, 20, True), (A.BATCH, 5, 10, False)])
def test_outputs_equal_whole_texts(monkeypatch, batch, stretch, known, cuts):
    for name, value in (("BATCH", batch), ("STRETCH", stretch), ("KNOWN", known)):
        monkeypatch.setattr(A, name, value)
    work = A.Aligner(*(open(f, "rb").read() for f in FILES))
    assert work.cuts
    work.cuts = cuts
    texts = [t for _, t in corpus()]
    for text, got in zip(texts, work.texts(texts, tuple(A.TYPES)), strict=True):
        want = plain(text)
        if want is None:
            assert got is None
            continue
        groups, joined, links = groups_of(text)
        assert [got[n].tolist() for n in ("a_ids", "a_ends", "b_ids", "b_ends")] == list(want)
        assert got["groups"] == joined and (got["n_a"], got["n_b"], got["n_groups"]) == (len(want[0]), len(want[2]), len(groups))
        assert [want[1][i - 1] for i in got["a_cuts"]] == [want[3][j - 1] for j in got["b_cuts"]] == sorted(set(want[1]) & set(want[3]))
        assert dict(zip(*(x.tolist() for x in got["links"]), strict=True)) == {a * A.PAIR + b: n for (a, b), n in links.items()}


def test_gallop_is_the_intersection():
    rng = random.Random(2)
    for _ in range(300):
        short, long = (sorted(rng.sample(range(400), rng.randrange(0, 200))) for _ in range(2))
        i, j = A.gallop(short, long)
        assert [short[x] for x in i] == [long[x] for x in j] == sorted(set(short) & set(long))


@pytest.mark.parametrize("at_hand", [0, A.PAIRS_AT_HAND])
def test_counts_over_the_corpus(spark, docs_of, at_hand):
    from pyspark.sql import functions as F

    rows = corpus()
    found = A.align(docs_of(rows).repartition(4), *FILES, outputs=("links", "groups")).withColumn("row", F.monotonically_increasing_id())
    got = [r.asDict() for r in A.with_counts(written(found, "test-align"), at_hand).collect()]
    per_doc = [(d, groups_of(t)) for d, t in rows]
    counts = Counter()
    for _, (_, _, links) in per_doc:
        counts.update(links)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    want = [(d, len(g), joined, sum(ln.values()), sum(n for p, n in ln.items() if counts[p] == highest[p[1]]),
             sum(n * counts[p] for p, n in ln.items())) for d, (g, joined, ln) in per_doc]
    have = [(r["doc_id"], r["n_groups"], r["groups"], r["n_links"], r["n_best"], r["count_sum"]) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_very_long_text(monkeypatch, long_text):
    work = A.Aligner(*(open(f, "rb").read() for f in FILES))
    got = next(work.texts([long_text], ("a_ids", "b_ids", "groups")))
    assert got["a_ids"].tolist() == LIBRARY.encode(" " + long_text, add_special_tokens=False).ids
    assert got["b_ids"].tolist() == PIECES.encode(long_text)


def test_query_and_empty_table(spark, docs_of, tmp_path):
    rows = corpus()[:60]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op11_token_alignment"](spark, str(tmp_path)).collect()}
    for d, t in rows:
        joined = groups_of(t)[1]
        assert got[d]["groups_sha256"] == (hashlib.sha256(joined.encode()).hexdigest() if joined else "")
    docs_of(rows).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op11_token_alignment"](spark, f"{tmp_path}/none").collect() == []
