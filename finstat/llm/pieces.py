"""SentencePiece encoding with byte spans in the original text, and decoding."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from finstat.llm.common import or_empty

SPACE = "▁"  # fixed value: how a blank is written inside pieces
OUT_BYTES = 2 << 20  # size of a batch of results, beyond which the next one begins: both ends of the pipe hold it whole


class CharMap:
    """The compiled character map of a model: a double-array trie and the strings it points to."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """What the longest key that starts at ``at`` maps to, and the key's length."""
        units, found = self.units, None
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for length, byte in enumerate(text[at:], 1):
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                found = (units[node] & 0x7FFFFFFF, length)
        if found is None:
            return None
        start = found[0]
        return self.strings[start : self.strings.index(b"\0", start)], found[1]


class Normalizer:
    """Text to the form a model cuts into pieces, with the source offset of every byte."""

    def __init__(self, spec: model_pb2.NormalizerSpec) -> None:
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy = spec.add_dummy_prefix
        self.trim = spec.remove_extra_whitespaces
        self.space = SPACE.encode() if spec.escape_whitespaces else b" "
        self.plain = not self.map.units and not self.trim and spec.escape_whitespaces

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normal form and, for each of its bytes and its end, the byte of ``text`` it comes from."""
        if not text:
            return b"", np.zeros(1, dtype=np.int32)
        return self._plain(text) if self.plain else self._mapped(text)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        raw = np.frombuffer(text, dtype=np.uint8)
        source = np.repeat(np.arange(len(raw), dtype=np.int32), np.where(raw == 0x20, 3, 1))
        lead = [0] * (3 if self.dummy else 0)
        form = text.replace(b" ", self.space)
        return (self.space if self.dummy else b"") + form, np.concatenate((lead, source, [len(raw)])).astype(np.int32)

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        out, source = bytearray(), []
        at, after_blank = 0, self.trim
        if self.dummy and not self.trim:
            out += self.space
            source += [0] * len(self.space)
        while at < len(text):
            match = self.map.longest(text, at)
            form, length = match if match else (text[at : at + _char(text[at])], _char(text[at]))
            if self.trim and after_blank:
                form = form.lstrip(b" ")
            if form and self.dummy and self.trim and not out:
                out += self.space
                source += [at] * len(self.space)
            if form:
                piece = form.replace(b" ", self.space)
                out += piece
                source += [at] * len(piece)
                after_blank = form.endswith(b" ")
            at += length
        source.append(len(text))
        if self.trim:
            while out.endswith(self.space):
                del out[-len(self.space) :]
                end = source[len(out)]
                source = [*source[: len(out)], end]
        return bytes(out), np.array(source if out else [0], dtype=np.int32)


def _char(first: int) -> int:
    """Bytes of the UTF-8 character that starts with this byte."""
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Encoder:
    """Encodes as the library does, and projects every piece to bytes of the original text."""

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        self.normalize = Normalizer(model.normalizer_spec)
        kinds = model_pb2.ModelProto.SentencePiece
        self.lengths = np.array(
            [1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in model.pieces], dtype=np.int32
        )
        self.unknown = self.library.unk_id()
        self.end = self.library.eos_id()

    def ids(self, text: str) -> list[int]:
        """The ids of the whole text, without an end id."""
        return self.library.encode(text)

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-end byte of each piece in the UTF-8 text."""
        form, source = self.normalize(text.encode())
        lengths = self.lengths[np.array(ids, dtype=np.int32)]
        if self.unknown in ids:  # an unknown piece is as long as what it stands for
            pieces = self.library.encode(text, out_type=str)
            lengths = np.array([len(p.encode()) if i == self.unknown else n for p, i, n in zip(pieces, ids, lengths, strict=True)])
        ends = np.cumsum(lengths, dtype=np.int64)
        if (ends[-1] if len(ends) else 0) != len(form):
            raise ValueError("the pieces do not cover the normalised text")
        starts = ends - lengths
        return source[starts], source[ends]


def encode_pieces(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", add_end: bool = True
) -> DataFrame:
    """One row per document: id, ids, begins, ends, decoded.

    ``ids`` are those of the library, with an end id if asked for; ``begins`` and ``ends``
    give each piece's bytes in the original text (a byte piece has its own byte, the
    blank put in front of a text has none); ``decoded`` is the library's decoding of the ids.

    - A null text counts as empty: no pieces but the end id.
    - Texts of any length are encoded whole; one text is held at a time.
    - Repeated rows and null ids keep their rows. An empty table gives no rows.
    - Other columns are not read, whatever their names.

    ``model`` is read on the executors, so it must be a path they all have, as the library itself is.
    """

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        end = [encoder.end] if add_end else []
        for batch in batches:
            rows, size = [], 0
            for number, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                ids = encoder.ids(text)
                begins, ends = encoder.spans(text, ids)
                last = np.full(len(end), len(text.encode()), dtype=np.int32)
                begins, ends = (np.concatenate(x) for x in ((begins, last), (ends, last)))
                ids += end
                decoded = encoder.library.decode(ids)
                rows.append((number, np.array(ids, dtype=np.int32), begins.astype(np.int32), ends.astype(np.int32), decoded))
                size += 12 * len(ids) + len(decoded)
                if size >= OUT_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), or_empty(text_col).alias("text"))
    return texts.mapInArrow(encoded, "id long, ids array<int>, begins array<int>, ends array<int>, decoded string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    numbers, *lists, decoded = zip(*rows, strict=True)
    columns = [pa.array([n.as_py() for n in numbers], pa.int64())]
    for values in lists:
        offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values))))
    return pa.RecordBatch.from_arrays([*columns, pa.array(decoded)], names=["id", "ids", "begins", "ends", "decoded"])


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op8(documents: DataFrame, model: str | None = None) -> DataFrame:
    pieces = encode_pieces(documents, model or default_model())
    return pieces.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        # First bytes of all pieces, then their ends: the end id stands at the end of the text, which is the text's length.
        F.sha2(F.concat_ws(" ", F.col("begins").cast("array<string>"), F.col("ends").cast("array<string>")), 256).alias("spans_sha256"),
        F.element_at("ends", -1).cast("long").alias("text_bytes"),
    )
