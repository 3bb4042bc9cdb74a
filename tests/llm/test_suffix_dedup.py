"""op 5: against all 200-byte windows; the merge against a plain count."""
import collections
import random

import numpy as np
import pytest

from webloom.llm import suffix_dedup as S


def brute(rows):
    data = [(t or "").encode() for _, t in rows]
    windows = collections.Counter(b[i:i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for (doc_id, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if windows[b[i:i + 200]] > 1:
                gone[i:i + 200] = True
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(b) else 0
        out.append((doc_id, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()))
    return out


def run(docs_of, rows):
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(docs_of(rows)).collect()]


def same(docs_of, rows):
    assert sorted(run(docs_of, rows), key=str) == sorted(brute(rows), key=str)


def noise(rng, n, letters="abcdefgh ä"):
    return "".join(rng.choice(letters) for _ in range(n))


def corpus(rng, n=40):
    passages = [noise(rng, rng.randint(190, 700)) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [noise(rng, rng.randint(0, 400))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                k = rng.randrange(len(p))
                p = p[:k] + "Z" + p[k + 1:]
            parts += [p, noise(rng, rng.randint(0, 300))]
        rows.append((i, "".join(parts)))
    return rows


def test_planted_passages(docs_of):
    same(docs_of, corpus(random.Random(1)))


def test_hot_cores_and_joins(docs_of, monkeypatch):
    monkeypatch.setattr(S, "CORE_SLICES", 3)
    monkeypatch.setattr(S, "BUCKET_SLICES", 4)
    monkeypatch.setattr(S, "BROADCAST_TEXTS", 1)
    same(docs_of, corpus(random.Random(2)))


def test_odd_rows(docs_of):
    rng = random.Random(3)
    t = noise(rng, 500)
    rows = [(1, None), (2, ""), (3, t[:199]), (4, t[:199]), (5, t), (6, t), (6, t), (None, t[100:420]), (7, "a" * 450), (8, "ab" * 150),
            (9, t + "x" + t), (10, noise(rng, 200)), (None, None), (11, "é" * 260), (12, "x" + "é" * 120)]
    same(docs_of, rows)
    assert run(docs_of, []) == []


def test_very_long_text(docs_of, monkeypatch):
    monkeypatch.setattr(S, "PART_BYTES", 1000)      # scanned in parts
    rng = random.Random(4)
    t = noise(rng, 6000)
    same(docs_of, [(1, t), (2, noise(rng, 900) + t[3000:3900] + noise(rng, 500)), (3, t[950:1250])])


def test_stretches_tile_all_windows():
    rng = random.Random(5)
    for n in (199, 200, 201, 900, 5000):
        b = noise(rng, n, "ab").encode()
        anchors, at, lo, hi = S.stretches(b)
        starts = [s for a, z in zip(lo, hi, strict=True) for s in range(a, z + 1)]
        assert starts == list(range(max(0, len(b) - 199)))
        assert all(a <= p <= b_ + S.LENGTH for p, a, b_ in zip(at, lo, hi, strict=True))
        for p, a, z in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
            assert S._unpack(int(S._pack(np.int64(p), np.int64(a), np.int64(z)))) == (p, a, z)


@pytest.mark.parametrize("shard", [250, 1500, 1 << 15])
def test_merge_of_transforms(monkeypatch, shard):
    monkeypatch.setattr(S, "SHARD_BYTES", shard)
    rng = random.Random(shard)
    for letters in ("ab", "abcdefgh"):
        base = noise(rng, 1500, letters).encode()
        strings = []
        for _ in range(rng.randint(2, 40)):
            s = bytearray(base[(a := rng.randint(0, 1200)):a + rng.randint(200, 300)])
            if rng.random() < 0.5:
                s[rng.randrange(len(s))] = 122
            strings.append(bytes(s))
        count = collections.Counter(s[i:i + 200] for s in strings for i in range(len(s) - 199))
        assert [w.tolist() for w in S.repeated_windows(strings)] == \
            [[i for i in range(len(s) - 199) if count[s[i:i + 200]] > 1] for s in strings]


def test_text_keeps_whole_characters(docs_of):
    out = S.remove_repeats(docs_of([(1, "xé" + "ab" * 150), (2, "yé" + "ab" * 150)]), keep=("lang",), as_text=True).collect()
    assert all("�" not in r.kept and r.lang == "en" for r in out)
