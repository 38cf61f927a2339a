"""SentencePiece encoding and decoding that keeps, for every piece, its span in the original bytes.

The text is normalised here: at each place the longest prefix that the model's compiled character map knows is
replaced (longest-prefix match in the map's double-array trie), and every normalised byte records the original bytes it
came from. White space becomes the model's mark, with the dummy prefix it asks for. The library splits the text into
pieces (it applies the same normalisation); the pieces' lengths lay them over the normalised bytes, and the alignment
projects them to spans of the original.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from cairnspark.llm import kernels as K
from cairnspark.llm.shared import small_batches

MARK = "▁".encode()


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while i < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(tag & 7)
        n = varint() if n is None else n
        yield tag >> 3, raw[i : i + n]
        i += n


class CharacterMap:
    """The compiled character map: a double-array trie of prefixes over a pool of replacements."""

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + n], "<u4").tolist()
        self.pool = blob[4 + n :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of text[at:] and its replacement."""
        if not self.units:
            return None
        found, node = None, 0
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if (unit >> 8) & 1:
                found = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.pool.index(b"\0", found[1])
        return found[0], self.pool[found[1] : end]


class Codec:
    """A model with its normaliser; one per worker process."""

    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = dict(next((v for f, v in ((f, dict(_fields(v))) for f, v in _fields(model) if f == 3)), {}))
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy_prefix = bool(spec.get(3, 1))
        self.squeeze = bool(spec.get(4, 1))
        self.escape = bool(spec.get(5, 1))
        n = self.sp.get_piece_size()
        size = np.array([len(self.sp.id_to_piece(i).encode()) for i in range(n)], np.int64)
        for i in range(n):
            if self.sp.is_control(i) or self.sp.is_unknown(i):
                size[i] = 0
            elif self.sp.is_byte(i):
                size[i] = 1
        self.piece_bytes = size

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and for the end, the original byte at which its source begins."""
        if not self.map.units and not self.squeeze:
            raw = np.frombuffer(text, np.uint8)
            width = np.where(raw == 0x20, len(MARK) if self.escape else 1, 1)
            at = np.repeat(np.arange(len(raw)), width)
            out = text.replace(b" ", MARK) if self.escape else text
        else:
            pieces, at_list, i = [], [], 0
            while i < len(text):
                known = self.map.longest(text, i)
                if known is None:
                    step = 1
                    while i + step < len(text) and text[i + step] & 0xC0 == 0x80:
                        step += 1
                    known = step, text[i : i + step]
                for byte in known[1]:
                    pieces.append(byte)
                    at_list.append(i)
                i += known[0]
            if self.squeeze:  # blanks at either end go, and of several the first stays
                blank = np.array([c == 0x20 for c in pieces], bool)
                inner = np.flatnonzero(~blank)
                first, last = (inner[0], inner[-1]) if len(inner) else (len(blank), -1)
                place = np.arange(len(blank))
                stays = ~blank | ((place > first) & (place < last) & ~np.concatenate([[False], blank[:-1]]))
                pieces, at_list = [pieces[j] for j in np.flatnonzero(stays)], [at_list[j] for j in np.flatnonzero(stays)]
            joined, wide = [], []
            for c, j in zip(pieces, at_list, strict=True):
                new = MARK if c == 0x20 and self.escape else bytes([c])
                joined.append(new)
                wide += [j] * len(new)
            out, at = b"".join(joined), np.array(wide, np.int64)
        if self.dummy_prefix and out:
            head = MARK if self.escape else b" "
            out, at = head + out, np.concatenate([np.zeros(len(head), np.int64), at])
        return out, np.append(at, len(text))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, with begin and end ids, without sampling."""
        for ids in self.sp.encode(texts, add_bos=True, add_eos=True, num_threads=1):
            yield np.array(ids, np.uint32)

    def project(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end byte of each id in the UTF-8 text; begin, end and marker ids have empty spans.

        A character that is spelled in byte pieces gives each of them its own byte.
        """
        out, at = self.normalise(text.encode())
        sizes = self.piece_bytes[ids].copy()
        if int(sizes.sum()) != len(out):  # unknown pieces cover what no other piece does
            self._unknown_sizes(out, ids, sizes)
        ends = np.cumsum(sizes)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return at[np.minimum(starts, len(out))], at[np.minimum(ends, len(out))]

    def _unknown_sizes(self, out: bytes, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Sizes of unknown pieces: each reaches to the next place where the piece after it stands."""
        unknown, at, listed = self.sp.unk_id(), 0, ids.tolist()
        after, follows = b"", [b""] * len(listed)
        for i in range(len(listed) - 1, -1, -1):
            follows[i] = after
            if self.piece_bytes[listed[i]]:
                after = self.sp.id_to_piece(listed[i]).encode()
        for i, x in enumerate(listed):
            if x == unknown:
                end = out.find(follows[i], at + 1) if follows[i] else len(out)
                sizes[i] = (end if end >= 0 else len(out)) - at
            at += int(sizes[i])

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def text_slices(column: pa.Array, rows: int = 64) -> Iterator[tuple[int, list[str]]]:
    column = pc.fill_null(column, "")
    for a in range(0, len(column), rows):
        yield a, column.slice(a, rows).to_pylist()


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id") -> DataFrame:
    """(id, ids, begins, ends) of every row; a null text counts as empty and gets the begin and end ids alone.

    Repeated rows stay repeated, an empty table stays empty, other columns are left out.
    """
    with open(model_path, "rb") as f:
        model = f.read()  # a vocabulary file: its size is fixed, well under a megabyte

    def run(batches):
        c = codec(model)
        for batch in batches:
            for a, texts in text_slices(batch.column(1)):
                ids = list(c.encode(texts))
                spans = [c.project(t, i) for t, i in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, len(texts)),
                        pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                        pa.array([x[0].astype(np.int32) for x in spans], pa.list_(pa.int32())),
                        pa.array([x[1].astype(np.int32) for x in spans], pa.list_(pa.int32())),
                    ],
                    ["id", "ids", "begins", "ends"],
                )

    rows = docs.select(docs[id_column].alias("id"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(K.tidy(run), f"id {kind}, ids array<int>, begins array<int>, ends array<int>").withColumnRenamed(
        "id", id_column
    )


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and spans_sha256 over the projected spans.

    One row out for each row in, whatever its doc_id; null and empty texts have the begin and end ids alone. A text of
    any length is encoded whole. Columns other than doc_id and text are left out, so their names cannot clash.

    ids are digested as little-endian unsigned 32-bit integers, spans as pairs of them, decoded text as UTF-8.
    """
    import hashlib

    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches):
        c = codec(model)
        for batch in batches:
            for a, texts in text_slices(batch.column(1)):
                n, h, d, s = [], [], [], []
                for text, ids in zip(texts, c.encode(texts), strict=True):
                    begin, end = c.project(text, ids)
                    n.append(len(ids))
                    h.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    d.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                    s.append(hashlib.sha256(np.stack([begin, end], 1).astype("<u4").tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(texts)), pa.array(n, pa.int64()), pa.array(h), pa.array(d), pa.array(s)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        K.tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    )
