"""Token counts and encoding against the libraries, on whole texts and awkward strings."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from samples import clashing, frame, prose
from tokenizers import Tokenizer

from trailworks.llm.pieces_bpe import PieceModel, decoded, encoded, round_trip
from trailworks.llm.token_counts import PairCounter, token_counts

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def awkward():
    rng = random.Random(7)
    texts = [None, "", " ", "  a  b ", "▁x ▁▁ y", "<s> hi </s> <unk> <0x41>", "日本語\U0010ffff😀👩‍👩", "a" * 3000, " " * 100, "\n\t\x00x",
             "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>x", "ſ K don't I'LL é̂ ೧೨ 𝟘", "​ \x85", "!" * 500 + "1" * 500,
             prose(rng, 20_000), "same", "same"]
    return texts + ["".join(rng.choice("ab ▁é😀\n<s>'.1|") for _ in range(rng.randrange(60))) for _ in range(500)]


def test_counts_equal_the_library(spark):
    texts = awkward()
    library = Tokenizer.from_file(BYTES)
    want = {k: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(texts)}
    rows = token_counts(clashing(frame(spark, texts)), BYTES).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert token_counts(frame(spark, []), BYTES).count() == 0
    assert [tuple(r) for r in token_counts(frame(spark, [(None, "a b"), (None, "a b")]), BYTES).collect()] == [(None, 3, 2, False)] * 2


def test_merges_take_the_lowest_rank_first():
    counter = PairCounter(BYTES)
    library = Tokenizer.from_file(BYTES)
    rng = random.Random(8)
    for _ in range(300):
        piece = "".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 60)))
        assert counter.count_piece(piece) == len(library.encode(piece, add_special_tokens=False).ids)


def test_encoding_equals_the_library(spark):
    texts = awkward()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = clashing(frame(spark, texts))
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    want = {}
    for k, t in enumerate(texts):
        ids = [1, *library.encode(t or ""), 2]
        want[k] = (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids).encode()))
    assert {r[0]: tuple(r)[1:4] for r in round_trip(docs, PIECES).collect()} == want
    back = {r.doc_id: r.text for r in decoded(encoded(docs, PIECES), PIECES).collect()}
    assert back == {k: library.decode(library.encode(t or "")) for k, t in enumerate(texts)}
    assert round_trip(frame(spark, []), PIECES).count() == 0


def test_spans_project_to_source_bytes(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = awkward()
    for r in encoded(frame(spark, texts), PIECES).collect():
        own = library.encode(texts[r.doc_id] or "", return_type="proto")
        assert list(zip(r.begins, r.ends)) == [(p.begin, p.end) for p in own.pieces]


def test_decoding_of_any_ids():
    rng = random.Random(9)
    own, library = PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(259, 32000), 29871]) for _ in range(rng.randrange(9))]
        assert own.decode(np.array(ids, int)).decode() == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_character_maps_equal_the_library(rule, prefix, squeeze):
    library = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    own = PieceModel.of_bytes(library.serialized_model_proto())
    for text in [t or "" for t in awkward()] + ["ＡＢＣ　ｄ ﬁ ½ ㍍ é Å  　", "​ a  b\x85", "ﷺ  x", " ̈ a"]:
        made, source = own.normalise(text)
        assert made.decode() == library.normalize(text)
        assert len(source) == len(made) + 1
        assert source == sorted(source) and source[-1] <= len(text.encode())
