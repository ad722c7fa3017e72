"""SentencePiece encoding with source offsets, and decoding.

The normaliser follows the compiled character map of the model by longest prefix and records, for
every byte of the normalised text, the byte of the source that it came from; pieces are then
projected back to byte spans of the source. Segmentation itself is the sentencepiece library's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .common import map_arrow

#: The mark that stands for a space in pieces.
MARK = "▁"
#: Distinct words whose pieces a task remembers before it starts anew; bounds its memory.
REMEMBERED = 150_000
#: Documents, and characters of text, that are encoded together; a longer text goes alone.
SLICE_DOCS, SLICE_CHARS = 512, 4_000_000


class CharacterMap:
    """The precompiled character map: a double-array trie of byte strings with replacements."""

    def __init__(self, blob: bytes):
        self.units, self.texts = np.zeros(0, np.uint32), b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4")
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of ``data[start:]`` and what it becomes."""
        if not len(self.units):
            return None

        def step(unit: int) -> int:
            return (unit >> 10) << ((unit & 0x200) >> 6)

        node, found = step(int(self.units[0])), None
        for i in range(start, len(data)):
            node ^= data[i]
            unit = int(self.units[node]) if node < len(self.units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node ^= step(unit)
            if unit & 0x100:
                at = int(self.units[node]) & 0x7FFFFFFF
                found = i + 1 - start, self.texts[at : self.texts.index(b"\0", at)]
        return found


class Encoder:
    """Pieces of one model with spans in the source; built once in each Python worker."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.spec = proto.normalizer_spec
        self.map = CharacterMap(self.spec.precompiled_charsmap)
        pieces = [p.piece for p in proto.pieces]
        byte = proto.trainer_spec.byte_fallback
        is_byte = np.array([byte and p.type == 6 for p in proto.pieces])
        #: Bytes of normalised text that a piece covers, with each space mark as one byte.
        self.width = np.where(is_byte, 1, [len(p.replace(MARK, " ").encode()) for p in pieces]).astype(np.int64)
        #: Words can be encoded apart when no piece holds a mark after another character, unknown
        #: characters become bytes and normalisation leaves the text as it is.
        self.apart = byte and not any(MARK in p.lstrip(MARK) for p in pieces) and not self.spec.precompiled_charsmap
        self.apart &= self.spec.add_dummy_prefix and self.spec.escape_whitespaces and not self.spec.remove_extra_whitespaces
        self.apart &= not proto.trainer_spec.treat_whitespace_as_suffix and proto.trainer_spec.model_type == 2
        self.apart &= not any(p.type == 4 for p in proto.pieces)
        self.known: dict[str, list[int]] = {}

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes (a space stays one byte) and the source byte of each; one more at the end.

        A dummy prefix is aligned with the first source byte, as is what spaces collapse into.
        """
        data = text.encode("utf-8", "surrogatepass")
        if len(self.map.units):
            out, source, i = bytearray(), [], 0
            while i < len(data):
                hit = self.map.longest(data, i)
                if hit:
                    used, new = hit
                else:
                    used = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
                    new = data[i : i + used]
                out += new
                source += [i] * len(new) if hit else range(i, i + used)
                i += used
            data, place = bytes(out), np.array([*source, i], np.int64)
        else:
            place = np.arange(len(data) + 1, dtype=np.int64)
        data = data.replace(MARK.encode(), b" ") if not len(self.map.units) and MARK in text else data
        if len(data) + 1 != len(place):  # a literal mark shrank from three bytes to one
            marks = [m.start() for m in re.finditer(MARK.encode(), text.encode("utf-8", "surrogatepass"))]
            gone = np.array([x for m in marks for x in (m + 1, m + 2)])
            place = np.delete(place, gone)
        if self.spec.remove_extra_whitespaces:
            raw = np.frombuffer(data, np.uint8)
            keep = (raw != 32) | np.r_[False, raw[:-1] != 32]
            last = len(raw) - len(data.rstrip(b" "))
            keep[len(raw) - last :] = False
            data, place = raw[keep].tobytes(), np.r_[place[:-1][keep], place[-1]]
        if self.spec.add_dummy_prefix and data:
            data, place = b" " + data, np.r_[place[:1], place]
        return data, place

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of every text, exactly as the library's encode() gives them."""
        if not self.apart:
            return self.lib.encode(texts, num_threads=1)
        split, whole = [], []
        for t in texts:
            if "  " in t or MARK in t or t[:1] == " " or t[-1:] == " " or "\0" in t:
                split.append(None)
                whole.append(t)
            else:
                split.append(t.split(" ") if t else [])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = list({w for ws in split if ws for w in ws if w not in known})
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            known.update(zip(part, self.lib.encode(part, num_threads=1), strict=True))
        rest = iter(self.lib.encode(whole, num_threads=1) if whole else [])
        return [next(rest) if ws is None else list(chain.from_iterable(map(known.__getitem__, ws))) for ws in split]

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one source byte of every piece."""
        edges = np.r_[0, np.cumsum(self.width[ids])] if len(ids) else np.zeros(1, np.int64)
        if self.apart and MARK not in text:  # normalisation only adds the prefix: one byte
            edges = np.maximum(edges - 1, 0)
            return edges[:-1], edges[1:]
        data, place = self.normalise(text)
        if int(edges[-1]) == len(data):
            return place[edges[:-1]], place[edges[1:]]
        # unknown pieces have no width of their own: take the library's surfaces
        pieces = self.lib.encode(text, return_type="proto").pieces
        return np.array([p.begin for p in pieces], np.int64), np.array([p.end for p in pieces], np.int64)


@lru_cache(maxsize=2)
def _encoder(path: str, added: str | None) -> Encoder:
    with open(SparkFiles.get(added) if added else path, "rb") as f:
        return Encoder(f.read())


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    start, held, size = 0, [], 0
    for i, t in enumerate(x.as_py() or "" for x in batch.column(column)):
        held.append(t)
        size += len(t)
        if len(held) >= SLICE_DOCS or size >= SLICE_CHARS:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def encode_documents(docs: DataFrame, model_path: str, column: str = "text", keep: tuple[str, ...] = ("doc_id",), spans: bool = True) -> DataFrame:
    """Encode ``column`` of every row and decode the ids again.

    Returns the kept columns and ids (array of int), begins and ends (arrays of int: bytes of the
    source that each piece covers; null with ``spans=False``) and decoded (string). Null and empty
    texts have no ids and decode to an empty string. Repeated rows are encoded each; columns that
    are not kept may have any name. The model file is read on the driver's path or, where it
    exists on the driver only, sent along with the job.
    """
    added = _ship(docs, model_path)
    base = docs.select(*keep, column)
    kept = pa.schema([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(model_path, added)
        try:
            for batch in batches:
                for start, texts in _slices(batch, column):
                    ids = enc.encode(texts)
                    offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in ids])], pa.int32())
                    flat = np.fromiter(chain.from_iterable(ids), np.int32, offsets[-1].as_py())
                    own = batch.slice(start, len(texts))
                    cols = [own.column(k) for k in keep] + [pa.ListArray.from_arrays(offsets, pa.array(flat))]
                    if spans:
                        both = [enc.spans(t, x) for t, x in zip(texts, ids, strict=True)]
                        for k in (0, 1):
                            v = np.concatenate([b[k] for b in both]).astype(np.int32)
                            cols.append(pa.ListArray.from_arrays(offsets, pa.array(v)))
                    else:
                        cols += [pa.nulls(len(texts), pa.list_(pa.int32()))] * 2
                    cols.append(pa.array(enc.lib.decode(ids, num_threads=1), pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, names=[*keep, "ids", "begins", "ends", "decoded"])
        finally:  # the worker goes on to other work: words are remembered for one task
            enc.known.clear()

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*keep).schema)
    del kept
    return map_arrow(base, run, f"{types}, ids array<int>, begins array<int>, ends array<int>, decoded string")


def _ship(docs: DataFrame, path: str) -> str | None:
    """Name under which executors find the file, sent to them once per session."""
    import os

    sc = docs.sparkSession.sparkContext
    if sc.master.startswith("local["):
        return None
    name = os.path.basename(path)
    if name not in {os.path.basename(x) for x in sc.listFiles}:
        sc.addFile(path)
    return name


def decode_ids(encoded: DataFrame, model_path: str, column: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Text of an array of ids for every row; null and empty arrays give an empty string."""
    added = _ship(encoded, model_path)
    base = encoded.select(*keep, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(model_path, added)
        for batch in batches:
            texts = enc.lib.decode([x or [] for x in batch.column(column).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string())], names=[*keep, "decoded"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*keep).schema)
    return map_arrow(base, run, f"{types}, decoded string")
