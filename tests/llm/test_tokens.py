"""Token counts and SentencePiece against the libraries."""

import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from siftwork.llm import sentencepieces, token_counts
from siftwork.llm.common import tokenizer_file
from .conftest import ODD

PARTS = [" ", "  ", "a", "the", "\n", "é", "▁", "😀", "\t", "12", " t", "<s>", ".", "!!", "'s", "\r\n", "\x1f",
         "<|endoftext|>", "日本", "́", "​", "<0x0A>", "</s>"]


def texts():
    rng = random.Random(3)
    mixed = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    wild = ["".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(20))
            for _ in range(150)]
    return [t or "" for t in ODD] + mixed + wild


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_counts_equal_the_library():
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own = token_counts.PrefixCounter(P.path("byte_bpe_50k.json"))
    some = texts()
    want = [len(e.ids) for e in lib.encode_batch(some, add_special_tokens=False)]
    assert own.count_all(some) == want
    assert [own.count(t) for t in some[:20]] == want[:20]


def test_prefix_table_holds_every_prefix():
    own = token_counts.PrefixCounter(P.path("byte_bpe_50k.json"))
    for word in (b" thereafter", b"aaaaaaaaaaaaa", "straße日本".encode()):
        counts = own.prefix_counts(word)
        assert counts == [0] + [len(own.merged(word[:i])) for i in range(1, len(word) + 1)]
    ends, n = own.table("two words<|endoftext|> more")
    assert ends[-1] == len(b"two words<|endoftext|> more") and n[-1] == own.count("two words<|endoftext|> more")


def test_counts_of_a_table(spark, docs_of):
    rows = {r.doc_id: r for r in token_counts.token_counts(docs_of(ODD), limit=100).collect()}
    assert rows[0].n_tokens == rows[1].n_tokens == 0 and rows[0].n_bytes == 0
    assert rows[6].n_bytes == 25_000 and rows[6].over_limit and not rows[3].over_limit
    assert token_counts.token_counts(docs_of([])).count() == 0
    cut = token_counts.within_budget(docs_of(["one two three four"]), 2).first()
    assert cut.n_tokens == 4 and cut.kept_bytes == 7


def test_pieces_equal_the_library():
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    own = sentencepieces.PieceCodec(P.path("piece_bpe_32k.model"))
    for t in texts():
        ids = lib.encode(t)
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids)
        assert own.digests(t)[:3] == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
        assert own.ends(t, own.coded(t)[3]).tolist() == [e for _, _, e in own.encode_spans(t)]


def test_spans_cover_the_text():
    own = sentencepieces.PieceCodec(P.path("piece_bpe_32k.model"))
    for t in ("two words", " a\n日本😀  b", "x", "▁ y"):
        spans, raw = own.encode_spans(t), t.encode()
        assert [i for i, _, _ in spans] == own.encode(t)
        assert spans[-1][2] == len(raw) and all(a <= b for _, a, b in spans)
        assert all(x[2] == y[1] for x, y in zip(spans, spans[1:], strict=False))


def test_character_map_equals_the_library():
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    from sentencepiece import sentencepiece_model_pb2 as pb
    model = pb.ModelProto()
    model.ParseFromString(normalizer.serialized_model_proto())
    codec = object.__new__(sentencepieces.PieceCodec)
    spec = model.normalizer_spec
    codec.map = sentencepieces.CharMap(spec.precompiled_charsmap)
    codec.dummy, codec.tidy, codec.escape = (
        spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
    assert codec.map.units
    for t in ("ﬁne ①② ＡＢＣ", "é Å ㌔", "plain", "㍿ x"):
        norm, source = codec.normalise(t)
        assert norm == normalizer.normalize(t)
        assert source[-1] == len(t.encode()) and source == sorted(source)


def test_pieces_of_a_table(docs_of):
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in sentencepieces.piece_digests(docs_of(ODD)).collect()}
    assert all(rows[i].n_tokens == len(lib.encode(t or "")) for i, t in enumerate(ODD))
    out = sentencepieces.encode_pieces(docs_of(ODD), spans=True)
    assert {"rest", "ids", "ends", "decoded"} <= set(out.columns)
    again = sentencepieces.decode_pieces(out.drop("decoded"))
    assert all(r.decoded == lib.decode(lib.encode(ODD[r.doc_id] or "")) for r in again.collect())
    assert sentencepieces.piece_digests(docs_of([])).count() == 0


def test_other_models_are_refused(tmp_path):
    assert tokenizer_file("/x/y.model") == "/x/y.model"
    with pytest.raises(FileNotFoundError):
        sentencepieces.PieceCodec(str(tmp_path / "none.model"))


def test_stray_bytes_without_end():
    assert sentencepieces._read(b"\xff" * 3000 + b"a\xc3") == "\ufffd" * 3000 + "a\ufffd"
