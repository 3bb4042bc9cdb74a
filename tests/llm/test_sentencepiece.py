"""op 2: ids equal the library's, spans tile the text, maps equal the library's."""
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from webloom.llm import sentencepiece_codec as C

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = list("aZ  \t\n0ﬁＡ①がガ゙́é½㌀ß\xa0​😀▁ｱﾞ\x01\xad﻿")


def random_text(rng, most=14):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most)))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("trim", [True, False])
def test_normaliser_equals_the_library(rule, trim):
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True,
                                                   remove_extra_whitespaces=trim)
    ours = C.Normaliser.of_model(theirs.serialized_model_proto())
    rng = random.Random(5)
    for _ in range(800):
        text = random_text(rng)
        normal, source = ours(text.encode())
        assert normal.decode() == theirs.normalize(text), text
        assert len(source) == len(normal) + 1 and all(a <= b for a, b in zip(source, source[1:], strict=False))
        assert not len(normal) or source[-1] <= len(text.encode())


def test_ids_spans_round_trip(docs_of, long_text):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(6)
    texts = [None, "", " ", "  a  b ", "Hello wörld\t\n日本 \x00 😀 ▁a  ", long_text] + [random_text(rng) for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, "x y"), (3, "  a  b ")]
    out = {(r.doc_id, r.decoded): r for r in C.encode(docs_of(rows), MODEL).collect()}
    for i, text in rows:
        ids = library.encode(text or "", add_eos=True)
        r = out[i, library.decode(ids)]
        assert r.ids == ids
        raw = (text or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(r.begins, r.ends, strict=True)) == raw
        for k, piece in enumerate(ids[:200]):
            if not library.is_byte(piece) and not library.is_control(piece):
                own = raw[r.begins[k]:r.ends[k]].decode().replace(" ", "▁")
                name = library.id_to_piece(piece)
                assert own == name or "▁" + own == name and k == 0


def test_blocks_and_general_path_agree():
    codec = C.codec(open(MODEL, "rb").read())
    text = "a  b ▁ é\n c".encode()
    ids = C.np.array(codec.library.encode(text.decode()))
    bounds = C.np.concatenate(([0], C.np.cumsum(codec.widths[ids])))
    source = codec.normaliser(text)[1]
    assert (codec.normaliser.cut(text, bounds) == source[C.np.minimum(bounds, len(source) - 1)]).all()
    big = [b"x" * 10, b"y" * C.BLOCK_BYTES, b"z"]
    assert [big[s] for s in C._blocks(big)] == [[b"x" * 10], [b"y" * C.BLOCK_BYTES], [b"z"]]


def test_decode_and_empty(docs_of, spark):
    assert C.encode(docs_of([]), MODEL).count() == 0
    ids = spark.createDataFrame([(1, [22557, 2]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in C.decode(ids, MODEL).collect()} == {1: "Hello", 2: "", 3: ""}


def test_invalid_utf8(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    r = C.encode(df, MODEL).first()
    assert r.decoded == "a�b" and r.ends[-1] == 3
    assert hashlib.sha256(r.decoded.encode()).hexdigest()
