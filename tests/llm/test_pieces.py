import hashlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from finstat.llm.pieces import Encoder, Normalizer, default_model, encode_pieces, op8
from tests.llm.conftest import MESSY, prose

TEXTS = [
    "",
    " ",
    "   ",
    "a",
    " a  b   c ",
    "one two\nthree\t four\r\n",
    "▁ literal ▁▁ marks",
    "ünïcode ça — 漢字 🙂 ​　x",
    "<s> </s> <unk> <0x41>",
    "\x00\x01 control",
    "x" * 3000,
    "word " * 2000,
    prose(3000),
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def test_ids_are_the_librarys(library):
    encoder = Encoder(default_model())
    for text in TEXTS:
        assert encoder.ids(text) == library.encode(text)


def test_unknown_pieces_are_as_long_as_what_they_stand_for():
    encoder = Encoder(default_model())
    text = "one two"
    pieces = encoder.library.encode(text)
    encoder.unknown = pieces[1]
    encoder.lengths[pieces[1]] = 999
    begins, ends = encoder.spans(text, pieces)
    assert ends.tolist()[-1] == len(text) and begins[1] == ends[0]


def test_spans_stand_for_their_pieces(library):
    encoder = Encoder(default_model())
    for text in TEXTS:
        raw, ids = text.encode(), encoder.ids(text)
        begins, ends = encoder.spans(text, ids)
        assert len(begins) == len(ends) == len(ids)
        assert b"".join(raw[a:b] for a, b in zip(begins, ends)) == raw
        for piece, a, b in zip(library.encode(text, out_type=str), begins, ends):
            span = raw[a:b]
            if piece.startswith("<0x") and len(span) == 1:
                assert span[0] == int(piece[3:5], 16)
            else:
                assert piece.replace("▁", " ").encode().lstrip() == span.replace("▁".encode(), b" ").lstrip()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("trim", [False, True])
def test_normalizer_equals_the_library(rule, trim):
    theirs = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=trim
    )
    model = model_pb2.ModelProto()
    model.ParseFromString(theirs.serialized_model_proto())
    ours = Normalizer(model.normalizer_spec)
    for text in ["ｆｕｌｌ　width Ⅷ ﬁne", "é ça ㍿ ½", "  two  blanks  ", "ÀB 漢字 🙂", "tab\tand\nline", "plain", *TEXTS[:7]]:
        raw = text.encode()
        form, source = ours(raw)
        want, offsets = theirs.normalize(text, with_offsets=True)
        assert form.decode() == want, text
        # The library counts characters; ours are bytes.
        starts = np.cumsum([0] + [len(c.encode()) for c in want])
        chars = [len(raw[:at].decode(errors="ignore")) for at in source[starts].tolist()]
        assert chars == list(offsets), text


def test_rows(messy, library):
    rows = encode_pieces(messy, default_model()).collect()
    assert len(rows) == len(MESSY)
    assert sorted(r.decoded for r in rows) == sorted(library.decode(library.encode(t or "")) for _, t, *_ in MESSY)
    by_id = {i: t or "" for i, t, *_ in MESSY if i is not None}
    for r in rows:
        assert r.ids[-1] == library.eos_id() and r.begins[-1] == r.ends[-1]
        if r.id is not None:
            assert r.ids[:-1] == library.encode(by_id[r.id])
            assert r.decoded == library.decode(r.ids)
    assert encode_pieces(messy.limit(0), default_model()).collect() == []


def test_query_spans_equal_brute_force(spark, library):
    """Piece after piece from its own spelling; the model's map is empty, so lengths add up to the text."""
    frame = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in op8(frame).collect()}
    for number, text in [*enumerate(TEXTS), (99, "")]:
        begins, ends, at = [], [], 0
        for place, piece in enumerate(library.id_to_piece(library.encode(text))):
            byte = len(piece) == 6 and piece.startswith("<0x")
            raw = text.encode()[at:]
            if byte:
                length = 1
            else:
                # A mark stands for a blank, or for a mark of the text itself; the first may stand for nothing.
                length = 0
                for n, char in enumerate(piece):
                    if char == "▁" and not (place == 0 and n == 0):
                        length += 1 if raw[length : length + 1] == b" " else len(char.encode())
                    elif char != "▁":
                        length += len(char.encode())
            begins.append(at)
            at += length
            ends.append(at)
        assert at == len(text.encode())
        joined = " ".join(map(str, [*begins, at, *ends, at]))
        assert got[number].spans_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        assert got[number].text_bytes == at


def test_batches_of_results_are_small(spark):
    """Three lists of numbers outweigh the text they are of; a batch of them is held by the worker and by the executor."""

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, function, schema):
            self.function = function
            return self

    docs = Docs()
    encode_pieces(docs, default_model())
    texts = [prose(400, n) for n in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    out = list(docs.function([batch]))
    assert max(b.nbytes for b in out) < 4 << 20
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(len(texts)))
    assert [t for b in out for t in b.column(4).to_pylist()] == texts
