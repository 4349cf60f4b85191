"""SentencePiece encoding with the byte span of every piece in the original text.

Normalisation is done here: at each position the longest key of the model's
compiled character map (a double-array trie in the model file) is replaced, spaces
become U+2581, a dummy prefix is put in front, and for every byte of the result the
byte of the original that it came from is recorded. Pieces are laid over the
normalised bytes and projected through that record, so that the spans tile the
original text, whatever was replaced.

Merges never reach across some borders: no piece of the vocabulary has a space
after something else, and none holds a line break. Both are checked when a model is
loaded; between such borders segments are encoded alone, by the library, and kept
in a bounded cache for the length of a task. A model without that property, or with other
switches than an added prefix and escaped spaces, is encoded whole.

Nulls count as empty: begin and end id only. Repeated rows each get a row. Empty
tables are fine; columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import arrays as A
from .common import documents, in_arrow, narrow

SPACE = "▁"
#: Bytes that the cache of segments may take, the objects themselves included; it is dropped when a task ends.
CACHED, ENTRY = 48 << 20, 400
_kept: dict = {}


class CharacterMap:
    """The longest-prefix replacements of a compiled character map.

    The blob is a length, the trie's 32-bit units, and the replacements, each ended by
    a zero byte. A unit holds a label in its low byte, whether a value follows in bit 8,
    and the offset to its children above bit 10 (shifted by 8 more if bit 9 is set).
    """

    def __init__(self, blob: bytes):
        self.replacements: dict[str, str] = {}
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist()
            self._fill(units, blob[4 + size :])
        self.longest = max(map(len, self.replacements), default=0)
        starts = "".join(sorted({k[0] for k in self.replacements}))
        self.start = re.compile("[" + re.escape(starts) + "]") if starts else None

    def _fill(self, units: list[int], texts: bytes) -> None:
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        stack = [(offset(units[0]), b"")]
        while stack:
            base, key = stack.pop()
            for label in range(1, 256):
                at = base ^ label
                if at < len(units) and units[at] & 0x800000FF == label:
                    below, longer = at ^ offset(units[at]), key + bytes([label])
                    if units[at] >> 8 & 1:
                        value = units[below] & 0x7FFFFFFF
                        self.replacements[longer.decode()] = texts[value : texts.index(b"\0", value)].decode()
                    stack.append((below, longer))

    def parts(self, text: str) -> Iterator[tuple[str, str]]:
        """(original, normalised) pairs that make up the text; unchanged stretches stay whole."""
        at = done = 0
        while self.start and (m := self.start.search(text, at)):
            at = m.start()
            key = next((text[at : at + n] for n in range(self.longest, 0, -1) if text[at : at + n] in self.replacements), None)
            if key is None:
                at += 1
                continue
            if done < at:
                yield text[done:at], text[done:at]
            yield key, self.replacements[key]
            at = done = at + len(key)
        if done < len(text):
            yield text[done:], text[done:]


class Encoder:
    """Ids, spans and decoded texts by one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix = spec.add_dummy_prefix
        pieces = [p.piece for p in model.pieces]
        plain = [p.piece for p in model.pieces if p.type in (1, 4)]
        self.cuts = (
            self.prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
            and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in plain) and not any(p.type == 4 for p in model.pieces)
        )
        self.bytes_of = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else p.piece.encode() for p in model.pieces]
        self.width = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == 2}
        self.begin, self.end = (struct.pack("<I", pieces.index(x)) for x in ("<s>", "</s>"))
        self.in_front = len(self.library.encode("\n"))  # ids of the prefix and a line break
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.held = 0  # bytes of the cached segments
        self.segment = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the byte of the original."""
        out, origin, at = [], [], 0
        if self.prefix and text:
            out.append(SPACE)
            origin.append(np.zeros(3, np.int64))
        for old, new in self.map.parts(text):
            raw = np.frombuffer(old.encode(), np.uint8)
            if old == new:  # byte by byte, a space taking three
                each = np.where(raw == 32, 3, 1)
                origin.append(at + np.repeat(np.arange(len(raw)), each))
            else:
                origin.append(np.full(len(new.replace(" ", SPACE).encode()), at, np.int64))
            out.append(new.replace(" ", SPACE))
            at += len(raw)
        return "".join(out), np.concatenate([*origin, [at]])

    def _segments(self, new: list[str]) -> None:
        """Encode segments alone. One without a leading space is put behind a line break, which nothing merges with."""
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            asked = [s[1:].replace(SPACE, " ") if s[0] == SPACE else "\n" if s == "\n" else "\n" + s for s in part]
            skip = [0 if s[0] == SPACE else self.in_front - (s == "\n") for s in part]
            bare = [k for k, s in enumerate(part) if s == SPACE]  # the prefix alone: the library gives nothing for an empty text
            for k, (s, ids, n) in enumerate(zip(part, self.library.encode(asked, num_threads=1), skip)):
                if k in bare:
                    ids = [self.library.piece_to_id(SPACE)]
                self.cache[s] = self._entry(ids[n:])

    def _entry(self, ids: list[int]) -> tuple[bytes, bytes]:
        raw = b"".join([self.bytes_of[i] if i not in self.unknown else " ⁇ ".encode() for i in ids])
        return struct.pack(f"<{len(ids)}I", *ids), raw.decode(errors="replace").replace(SPACE, " ").encode()

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray, str]]:
        """Per text: ids as little-endian uint32, byte offsets of the pieces' borders, and what the ids decode to."""
        normal = [self.normalise(t) for t in texts]
        if not self.cuts:
            for text, (_, origin) in zip(texts, normal):
                ids = self.library.encode(text)
                yield self._framed(np.array(ids, dtype="<u4").tobytes(), origin, self.library.decode(ids))
            return
        split = [self.segment.findall(n) for n, _ in normal]
        if self.held > CACHED:
            self.forget()
        new = list({s for ss in split for s in ss if s not in self.cache})
        self.held += sum(12 * len(s) + ENTRY for s in new)
        self._segments(new)
        for ss, (_, origin) in zip(split, normal):
            got = [self.cache[s] for s in ss]
            decoded = b"".join([g[1] for g in got]).decode()
            yield self._framed(b"".join([g[0] for g in got]), origin, decoded[1:] if decoded.startswith(" ") else decoded)

    def forget(self) -> None:
        self.cache, self.held = {}, 0

    def _framed(self, ids: bytes, origin: np.ndarray, decoded: str) -> tuple[bytes, np.ndarray, str]:
        all_ids = self.begin + ids + self.end
        borders = np.concatenate([[0], np.cumsum(self.width[np.frombuffer(all_ids, dtype="<u4")])])
        return all_ids, origin[np.minimum(borders, len(origin) - 1)], decoded


def encoder(path: str) -> Encoder:
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch, lo, hi, texts in _parts(model, batches):
            ids, borders, decoded = [], [], []
            for i, b, d in model.encode(texts):
                ids.append(np.frombuffer(i, dtype="<u4").astype(np.int64))
                borders.append(b)
                decoded.append(d)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), pa.array(ids, kind), pa.array([b[:-1] for b in borders], kind), pa.array([b[1:] for b in borders], kind), pa.array(decoded)],
                names=["doc_id", "ids", "begins", "ends", "decoded"],
            )

    return run


def _digests(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch, lo, hi, texts in _parts(model, batches):
            rows = [(i, len(i) // 4, sha(i), sha(d.encode()), int((b[1:] - b[:-1]).sum())) for i, b, d in model.encode(texts)]
            raw, n, ids, decoded, covered = zip(*rows)
            out = [batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded), pa.array(covered, pa.int64())]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4"))))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes", "ids"][: len(out)])

    return run


def _parts(model: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, list[str]]]:
    for batch in batches:
        texts = batch.column("text").fill_null("")
        for lo, hi, _, _ in A.slices(texts):
            yield batch, lo, hi, texts.slice(lo, hi - lo).to_pylist()
    model.forget()


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, begins, ends, decoded): pieces with the bytes of the original they stand for.

    Begin and end id and the added prefix have empty spans; spans are ascending and tile the text.
    """
    docs = narrow(df, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs, _encoded(model), f"doc_id {kind}, ids array<long>, begins array<long>, ends array<long>, decoded string")


def digests(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes[, ids]) of the same, made where the pieces are."""
    docs = narrow(df, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs, _digests(model, with_ids), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long{', ids array<int>' if with_ids else ''}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return digests(documents(spark, sf_dir), path("piece_bpe_32k.model"))
