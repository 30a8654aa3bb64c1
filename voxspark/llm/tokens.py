"""Token ids in a binary format of patched frame-of-reference blocks.

Documents are dealt by ranges of their id; each range becomes one file, written document by document
and block by block. A block of up to ``BLOCK`` ids stores its minimum, the differences packed at the
width that makes it smallest among those at which a percentile of them fits, and the rest of each
outlier, with its place, in an exception list. The file ends with the starts of its blocks and of its
documents, so that any document can be read without the others.

Layout, little-endian: magic ``VXPF2\\0``, blocks, then the footer: block starts (u8 each), document
table (id i8, first id u8, count u8, u1 that is 0 for a null id, each), and the trailer (number of blocks u8, of documents u8, of
ids u8, end of blocks u8). A block: count u4, minimum u4, width u1, exceptions u4, packed bits,
places u2, high parts u4.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import in_blocks

BLOCK = 4096
MAGIC = b"VXPF2\x00"
#: Bytes of text that a task encodes at a time.
BLOCK_BYTES = 6_000_000
PERCENTILES = (50, 75, 90, 95, 99, 100)
_HEAD, _TRAILER, _DOC = struct.Struct("<IIBI"), struct.Struct("<QQQQ"), np.dtype([("id", "<i8"), ("first", "<u8"), ("count", "<u8"), ("known", "u1")])


# --- blocks -----------------------------------------------------------------------------------------


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after the other, lowest bit first."""
    if not width:
        return b""
    if width in (8, 16, 32):
        return values.astype(f"<u{width // 8}").tobytes()
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(count, dtype=np.uint32)
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * width, bitorder="little").reshape(count, width)
    padded = np.zeros((count, 32), dtype=np.uint8)
    padded[:, :width] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


def encode_block(ids: np.ndarray) -> bytes:
    """A block of 1 to ``BLOCK`` ids below 2**32."""
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    fit = np.bincount(np.frexp(rest.astype(np.float64))[1], minlength=33).cumsum()  # how many fit into each width
    best = None
    for p in PERCENTILES:
        width = int(np.searchsorted(fit, max(1, -(-len(rest) * p // 100))))
        over = len(rest) - int(fit[width])
        cost = -(-len(rest) * width // 8) + 6 * over
        if best is None or cost < best[0]:
            best = cost, width
    width = best[1]
    places = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    high = (rest[places] >> np.uint32(width)) if len(places) else np.zeros(0, np.uint32)
    return b"".join([_HEAD.pack(len(ids), low, width, len(places)), pack(rest, width), places.astype("<u2").tobytes(), high.astype("<u4").tobytes()])


def decode_block(data: bytes) -> np.ndarray:
    count, low, width, n = _HEAD.unpack_from(data)
    at = _HEAD.size
    size = -(-count * width // 8)
    rest = unpack(data[at : at + size], count, width)
    if n:
        places = np.frombuffer(data, "<u2", n, at + size)
        high = np.frombuffer(data, "<u4", n, at + size + 2 * n)
        rest[places] |= high << np.uint32(width)
    return rest + np.uint32(low)


class Writer:
    """Writes ids document by document to an open binary file; holds one block at a time."""

    def __init__(self, out):
        self.out, self.at, self.held, self.n_held, self.total = out, 0, [], 0, 0
        self.starts: list[int] = []
        self.docs: list[tuple[int, int, int, bool]] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        full = len(ids) if last else len(ids) - len(ids) % BLOCK
        for a in range(0, full, BLOCK):
            self.starts.append(self.at)
            self._put(encode_block(ids[a : min(a + BLOCK, full)]))
        self.held, self.n_held = [ids[full:]], len(ids) - full

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, self.total, len(ids), doc_id is not None))
        self.held.append(ids.astype(np.uint32))
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= 16 * BLOCK:
            self._flush(last=False)

    def close(self) -> None:
        self._flush(last=True)
        end = self.at
        self._put(np.array(self.starts, "<u8").tobytes())
        self._put(np.array(self.docs, _DOC).tobytes())
        self._put(_TRAILER.pack(len(self.starts), len(self.docs), self.total, end))


class Reader:
    """Reads documents of a file by its index."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - _TRAILER.size)
        blocks, docs, self.total, self.end = _TRAILER.unpack(source.read(_TRAILER.size))
        source.seek(self.end)
        self.starts = np.append(np.frombuffer(source.read(8 * blocks), "<u8"), np.uint64(self.end)).astype(np.int64)
        self.docs = np.frombuffer(source.read(_DOC.itemsize * docs), _DOC)
        source.seek(0)
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a file of this format")
        self._block: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def block(self, i: int) -> np.ndarray:
        if self._block[0] != i:
            self.source.seek(int(self.starts[i]))
            self._block = i, decode_block(self.source.read(int(self.starts[i + 1] - self.starts[i])))
        return self._block[1]

    def ids(self, row: int) -> np.ndarray:
        """All ids of the document in a row of ``docs``."""
        first, count = int(self.docs[row]["first"]), int(self.docs[row]["count"])
        parts, at = [], first
        while at < first + count:
            i, inside = divmod(at, BLOCK)
            part = self.block(i)[inside : inside + first + count - at]
            parts.append(part)
            at += len(part)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


# --- encoding ---------------------------------------------------------------------------------------

# The normaliser and the pattern of the tokenizers whose words may be encoded one by one. They drop
# white space, so a text's ids are those of its words, and those are the ids of the pieces that the pattern cuts.
_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Words of these characters alone are unchanged by NFC and have the same lower case everywhere.
_PLAIN = re.compile("[ !-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-z0-9ß-öø-ÿ]+| ")
#: Stands between words where their ids are joined; ids have 24 bits at most, so no part of them looks like it.
_BETWEEN = b"\xff\xff\xff\xff"


def _by_words(tokenizer) -> bool:
    """Whether a tokenizer is of the kind whose words may be encoded one by one."""
    made = json.loads(tokenizer.to_str())
    cut = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
    return made["normalizer"] == _NORMALISER and (cut.get("pattern"), cut.get("behavior"), cut.get("invert")) == ({"Regex": _PATTERN}, "Removed", True) and tokenizer.get_vocab_size() < 1 << 24


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level models put for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Recent(dict):
    """A table in two generations, so that what is used often survives; results do not depend on its size."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def missing(self, keys: set) -> list:
        """Those of ``keys`` that are in neither generation; those of the older one move to the newer."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        new = keys.difference(self)
        again = new.intersection(self.old) if self.old else ()
        self.update((k, self.old[k]) for k in again)
        return list(new.difference(again))


class WordEncoder:
    """Encodes texts with a file of the tokenizers library.

    Where the tokenizer drops white space (``_by_words``), each distinct word is worked out once: new words
    are cut into pieces as the tokenizer's pattern does, and new pieces go to its model. Words beyond plain
    Latin letters, and those that hold a special token, go through the whole tokenizer; so do all texts
    with any other tokenizer.
    """

    def __init__(self, path: str, limit: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words, self.letters = _by_words(self.tokenizer), _byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.pieces = _Recent(limit), _Recent(limit)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn_pieces(self, new: list[str]) -> None:
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        for piece in new:
            text = piece if piece.isascii() else "".join([letters[b] for b in piece.encode()])
            self.pieces[piece] = array("I", [t.id for t in tokenize(text)]).tobytes()

    def _learn(self, new: list[bytes]) -> None:
        text = b" ".join(new).decode()
        if not _PLAIN.fullmatch(text) or ("<|" in text and any(s in text for s in self.special)):
            odd = [w for w in new if not _PLAIN.fullmatch(t := w.decode()) or any(s in t for s in self.special)]
            self.words.update((w, self._whole(w.decode()).tobytes()) for w in odd)
            new = list(set(new).difference(odd))
            text = b" ".join(new).decode()
        if new:
            pieces = _PIECE.findall(text.lower())
            self._learn_pieces(self.pieces.missing(set(pieces) - {" "}))
            self.pieces[" "] = _BETWEEN
            self.words.update(zip(new, b"".join(map(self.pieces.__getitem__, pieces)).split(_BETWEEN)))

    def encode_all(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin (and the last one's end)."""
        if not self.by_words:
            found = [self._whole(t or "") for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, "<u4"), *found]), np.cumsum([0, *map(len, found)])
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        new = self.words.missing(set(distinct) - {b""})
        if new:
            self._learn(new)
        self.words[b""] = b""  # stands beside white space at a text's ends
        values = [self.words[w] for w in distinct]
        starts = np.cumsum([0, *map(len, values)]) // 4
        by_word = pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), pa.array(np.frombuffer(b"".join(values), "<u4")))
        taken = by_word.take(coded.indices)
        at = taken.offsets.to_numpy()
        return taken.flatten().to_numpy(), (at - at[0])[split.offsets.to_numpy() - split.offsets[0].as_py()]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One for each tokenizer in a Python worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# --- tables -----------------------------------------------------------------------------------------

MANIFEST = "part int, file string, bytes long, n_docs long, n_ids long"


def write_tokens(docs: DataFrame, scratch: Scratch, tokenizer: str, folder: str, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes files in ``folder``; returns the manifest.

    Ids rise from file to file and within each; null ids come first, null texts are empty, and each
    document ends with ``end_id``. Rows that share an id stand side by side, by a hash of their text. ``folder`` is
    a URI that Arrow's file systems open on every executor. A file gets its name when it is complete,
    and a repeated task writes under another name; the manifest, itself a table, names those that count.
    Very long texts are encoded whole, in blocks. An empty table gives an empty manifest. Other columns are left alone.

    Texts go through the one shuffle, not ids: compressed they take less than 16 bits an id would.
    """
    # the keys are small, as the ranges come from a sample of them on the driver
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, system = _encoder(tokenizer), None, None
        end = np.array([end_id], np.uint32)
        for batch in batches:
            if out is None and batch.num_rows:
                system, base = fs.FileSystem.from_uri(folder)
                system.create_dir(base, recursive=True)
                number = batch.column("part")[0].as_py()
                path = f"{base}/part-{number:06d}-{uuid.uuid4().hex}.vxpf"
                stream = system.open_output_stream(path + ".open", buffer_size=1 << 20)
                out = Writer(stream)
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.string())
            for a, b in in_blocks(pc.binary_length(texts).fill_null(0).to_pylist(), int, BLOCK_BYTES):
                ids, at = encoder.encode_all(texts[a:b])
                for doc_id, i, j in zip(doc_ids[a:b], at[:-1], at[1:]):
                    out.add(doc_id, np.append(ids[i:j], end))
                pa.default_memory_pool().release_unused()
        if out is not None:
            out.close()
            stream.close()
            system.move(path + ".open", path)
            made = {"part": [number], "file": [os.path.basename(path)], "bytes": [out.at], "n_docs": [len(out.docs)], "n_ids": [out.total]}
            yield pa.RecordBatch.from_pydict(made, pa.schema([("part", pa.int32()), ("file", pa.string()), ("bytes", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return scratch.keep(dealt.mapInArrow(run, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame, folder: str, visit: Callable[[np.ndarray], object], schema: str) -> DataFrame:
    """``doc_id, start, n_tokens, value`` for each document in the files of ``manifest``, a task for each file.

    ``value`` is ``visit(ids)``, of type ``schema``; ``start`` counts the ids of all documents before.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.withColumn("offset", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))
    spread = files.repartitionByRange(max(1, manifest.count()), "part")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, size, offset in zip(frame["file"], frame["bytes"], frame["offset"]):
                system, base = fs.FileSystem.from_uri(folder)
                with system.open_input_file(f"{base}/{file}") as source:
                    reader = Reader(source, int(size))
                    for a in range(0, len(reader.docs), 2000):
                        part = reader.docs[a : a + 2000]
                        yield pd.DataFrame(
                            {
                                "doc_id": pd.arrays.IntegerArray(part["id"].astype(np.int64), part["known"] == 0),
                                "start": part["first"].astype(np.int64) + int(offset),
                                "n_tokens": part["count"].astype(np.int64),
                                "value": [visit(reader.ids(a + i)) for i in range(len(part))],
                            }
                        )

    return spread.mapInPandas(run, f"doc_id long, start long, n_tokens long, value {schema}")


def crc32_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
