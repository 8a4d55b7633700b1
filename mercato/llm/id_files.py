"""Token ids of a dataset as binary files: blocks of ids turned into planes, each plane compressed.

A file holds whole documents. Its ids, as unsigned 32-bit integers, are cut into blocks of ``BLOCK``; a block is
transposed into 4 byte planes or 32 bit planes, and each plane is one zstandard frame. Planes of the high bits are
almost constant and shrink to nothing. Behind the blocks stand

    chunk index   for each block: place in the file, ids, crc32 of the ids, bytes of each plane; zstandard
    documents     doc_id, whether it is null, ids with the end id; zstandard
    tail          places and lengths of both, block size, number of planes, ``MAGIC``

so that a reader that has the tail finds any id with one read of the index and one of a block (``IdFile``).

Documents are dealt into ranges of (doc_id, hash of the text, arrival) and sorted there; a task encodes its range and
starts a new file once one has ``FILE_IDS`` ids. A file has the attempt that wrote it in its name, and the index of
files, itself a written table, names only files of attempts that succeeded, so lost executors and repeated attempts
leave files that nothing reads, but never a wrong one. Files are written through pyarrow, which needs a folder it can
reach, and read through Spark.

Memory: a batch of texts, which Spark bounds in bytes, the words of ``GROUP`` or pieces of ``STRETCH`` characters,
``REMEMBERED`` of them and those of one group, one compressed file, and the ids of one document; a piece is a word, and one
without an end is as long as its text.

Defined results: null and empty texts are the end id alone. A null doc_id comes first; rows that share a doc_id stand in
order of their texts' hashes. Repeated rows are written each. An empty table has an index without files. Only doc_id and
text are read. The names of special tokens inside a text become those tokens, as the library does it by default.
"""

from __future__ import annotations

import io
import os
import re
import struct
import zlib
from codecs import charmap_decode
from collections.abc import Callable, Iterator, Sequence
from functools import cache, lru_cache
from itertools import batched
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mercato.llm.common import fingerprint, need, partitions
from mercato.session import written

MAGIC = b"IDPLANE1"
#: Ids of a block, ids after which a file ends, and zstandard's level.
BLOCK, FILE_IDS, LEVEL = 1 << 16, 1 << 22, 3
END_ID = 0
#: Characters of a text whose pieces are listed at once, and words and pieces that a worker remembers (some 200 MB).
STRETCH, REMEMBERED = 1 << 20, 1_000_000
#: Characters of the longest word that is remembered.
WORD = 40
#: Characters of the texts whose words are looked up together, and how many are worth it.
GROUP, LEAST = 1 << 22, 1 << 16
# How the library describes byte-level tokenizers that cut by the pattern, and the pattern.
BYTE_LEVEL = (
    "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)",
    "ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)",
)
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts that are all ASCII.
ASCII_PIECE = re.compile(
    r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
# Byte-level models write a byte as a letter: itself where Latin-1 has a visible one, else the next one from 256 on.
_HIDDEN = [*range(33), 127, *range(128, 161), 173]
BYTE_LETTERS = {byte: 256 + n for n, byte in enumerate(_HIDDEN)}
_LETTERS = "".join(chr(BYTE_LETTERS.get(byte, byte)) for byte in range(256))
BYTE, BIT = 4, 32
_TAIL = struct.Struct("<QQQQII8s")
_INDEX = "part int, file int, name string, n_docs bigint, n_ids bigint, n_bytes bigint"


def to_planes(ids: np.ndarray, planes: int) -> np.ndarray:
    """Ids as rows of bytes: one row for each byte or each bit of an id, lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == BYTE:
        return np.ascontiguousarray(raw.T)
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")


def from_planes(rows: np.ndarray, n: int, planes: int) -> np.ndarray:
    if planes == BYTE:
        raw = np.ascontiguousarray(rows.T)
    else:
        bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
        raw = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


class IdWriter:
    """One file in memory: documents go in, ``close`` returns its bytes."""

    def __init__(self, planes: int = BYTE, block: int = BLOCK):
        if planes not in (BYTE, BIT):
            raise ValueError(f"planes must be {BYTE} or {BIT}, not {planes}")
        self.planes, self.block = planes, block
        self.out, self.zip = io.BytesIO(), zstandard.ZstdCompressor(level=LEVEL)
        self.rest, self.waiting = [], 0
        self.chunks, self.docs, self.n_ids = [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.rest.append(ids)
        self.waiting += len(ids)
        self.n_ids += len(ids)
        if self.waiting >= self.block:
            ids = np.concatenate(self.rest)
            whole = len(ids) - len(ids) % self.block
            for start in range(0, whole, self.block):
                self._chunk(ids[start : start + self.block])
            self.rest, self.waiting = [ids[whole:]], len(ids) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        frames = [self.zip.compress(row.tobytes()) for row in to_planes(ids, self.planes)]
        crc = zlib.crc32(ids.astype("<u4").tobytes())
        self.chunks.append([self.out.tell(), len(ids), crc, *map(len, frames)])
        self.out.write(b"".join(frames))

    def close(self) -> bytes:
        if self.waiting:
            self._chunk(np.concatenate(self.rest))
        at = self.out.tell()
        index = self.zip.compress(np.array(self.chunks, "<u8").tobytes())
        docs = self.zip.compress(np.array(self.docs, "<i8").tobytes())
        self.out.write(index + docs)
        self.out.write(
            _TAIL.pack(at, len(index), at + len(index), len(docs), self.block, self.planes, MAGIC)
        )
        return self.out.getvalue()


class IdFile:
    """Ids and documents of one file, which can be sought in; only the blocks asked for are read."""

    def __init__(self, source):
        self.source = source
        source.seek(-_TAIL.size, io.SEEK_END)
        at, size, docs_at, docs_size, self.block, self.planes, magic = _TAIL.unpack(source.read(_TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids, or one that was cut off")
        unzip = zstandard.ZstdDecompressor()
        source.seek(at)
        index = unzip.decompress(source.read(size))
        self.chunks = np.frombuffer(index, "<u8").reshape(-1, 3 + self.planes)
        source.seek(docs_at)
        self.docs = np.frombuffer(unzip.decompress(source.read(docs_size)), "<i8").reshape(-1, 3)
        self.ends = np.cumsum(self.docs[:, 2])
        self.n_ids = int(self.chunks[:, 1].sum())

    def chunk(self, number: int) -> np.ndarray:
        place, n, crc, *sizes = map(int, self.chunks[number])
        self.source.seek(place)
        raw, unzip, rows, at = self.source.read(sum(sizes)), zstandard.ZstdDecompressor(), [], 0
        for size in sizes:
            rows.append(np.frombuffer(unzip.decompress(raw[at : at + size]), np.uint8))
            at += size
        ids = from_planes(np.stack(rows), n, self.planes)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {number} of the file is damaged")
        return ids

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop`` of the whole file."""
        start, stop = max(start, 0), min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, "<u4")
        first = start // self.block
        found = np.concatenate([self.chunk(k) for k in range(first, (stop - 1) // self.block + 1)])
        return found[start - first * self.block : stop - first * self.block]


class _Pieces(dict):
    """The ids, as bytes, of the pieces met so far; a new one is encoded by the tokenizer's model."""

    def __init__(self, model):
        self.tokenize = model.tokenize

    def __missing__(self, piece: str) -> bytes:
        letters, _ = charmap_decode(piece.encode("utf-8"), "strict", _LETTERS)
        ids = [token.id for token in self.tokenize(letters)]
        found = self[piece] = _packer(len(ids))(*ids)
        return found


@lru_cache(1024)
def _packer(n: int) -> Callable[..., bytes]:
    return struct.Struct(f"<{n}I").pack


class _Words(dict):
    """The ids, as bytes, of what stood between two blanks, with the blank before it.

    A blank between characters that are no white space begins a piece, and no piece goes on over it: what follows it,
    up to the next one, has the same ids everywhere. Where white space stands beside a blank this is not so, and there
    is no value.
    """

    def __init__(self, pieces: _Pieces):
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        if not _between_blanks(word):
            raise KeyError(word)
        pattern, met = ASCII_PIECE if word.isascii() else PIECE, len(self.pieces)
        found = b"".join(map(self.pieces.__getitem__, pattern.findall(" " + word)))
        # A word with a piece never met before may be one that never comes again.
        if len(word) <= WORD and len(self.pieces) == met:
            self[word] = found
        return found

    def of(self, words: list[str]) -> list[bytes | None]:
        """The ids of different words, None where there is no value; those not known are cut together."""
        values = list(map(self.get, words))
        new = [(k, word) for k, word in enumerate(words) if values[k] is None and _between_blanks(word)]
        for ascii, pattern in ((True, ASCII_PIECE), (False, PIECE)):
            some = [(k, word) for k, word in new if word.isascii() is ascii]
            pieces = pattern.findall("".join([" " + word for _, word in some]))
            found = list(map(self.pieces.get, pieces))
            # No piece of a word but its first begins with a blank.
            first = [n for n, piece in enumerate(pieces) if piece[0] == " "]
            for (k, word), begin, end in zip(some, first, [*first, len(pieces)][1:], strict=True):
                ids = found[begin:end]
                if None in ids:
                    values[k] = b"".join(map(self.pieces.__getitem__, pieces[begin:end]))
                    continue
                values[k] = b"".join(ids)
                if len(word) <= WORD:
                    self[word] = values[k]
        return values


def _between_blanks(word: str) -> bool:
    """Whether the blanks around a word stand beside no other white space."""
    return word != "" and not word[0].isspace() and not word[-1].isspace()


def _groups(texts: Sequence[str]) -> Iterator[list[str]]:
    """Consecutive texts that have ``GROUP`` characters, the last one's beyond it aside."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= GROUP:
            yield group
            group, size = [], 0
    yield group


class Encoder:
    """The ids of texts, each word and each piece of a text encoded once.

    A byte-level tokenizer cuts a text into pieces by a fixed pattern and encodes each on its own, so pieces can be
    remembered: words come again. Other tokenizers, and texts that name a special token, take whole texts.
    """

    def __init__(self, path: str):
        # A task has one core; the library would take all of the machine.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.known = _Pieces(self.library.model)
        self.words = _Words(self.known)
        self.special = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.by_pieces = self.library.normalizer is None and str(self.library.pre_tokenizer) in BYTE_LEVEL

    def encode(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        for group in _groups(texts):
            has_words = list(map(self._has_words, group))
            some = [text for text, has in zip(group, has_words) if has]
            # Few words are looked up sooner than sorted out.
            found = self._together(some) if sum(map(len, some)) >= LEAST else map(self._by_words, some)
            for text, has in zip(group, has_words):
                if len(self.known) + len(self.words) > REMEMBERED:
                    self.known.clear()
                    self.words.clear()
                ids = next(found) if has else None
                if ids is None and self._has_pieces(text):
                    ids = self._by_pieces(text)
                if ids is not None:
                    yield np.frombuffer(ids, "<u4")
                    continue
                whole = self.library.encode_batch_fast([text], add_special_tokens=False)[0]
                yield np.array(whole.ids, "<u4")

    def _has_pieces(self, text: str) -> bool:
        return self.by_pieces and not any(token in text for token in self.special)

    def _has_words(self, text: str) -> bool:
        """Not where the text is too long to list its words, or blanks stand side by side."""
        return len(text) <= STRETCH and "  " not in text and self._has_pieces(text)

    def _together(self, texts: list[str]) -> Iterator[bytes | None]:
        """``_by_words`` of each text, where each different word of them all is looked up once."""
        cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = cut.values.dictionary_encode()
        found = self.words.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ends, at = cut.offsets.to_pylist(), coded.indices.to_numpy()
        for text, begin, end in zip(texts, ends, ends[1:]):
            first, words = text.split(" ", 1)[0], list(map(found.__getitem__, at[begin + 1 : end].tolist()))
            if not first or first[-1].isspace() or None in words:
                yield None
            else:
                yield self._by_pieces(first) + b"".join(words)

    def _by_words(self, text: str) -> bytes | None:
        """None where a blank has white space beside it."""
        first, *words = text.split(" ")
        if not first or first[-1].isspace():
            return None
        try:
            return self._by_pieces(first) + b"".join(map(self.words.__getitem__, words))
        except KeyError:
            return None

    def _by_pieces(self, text: str) -> bytes:
        pattern = ASCII_PIECE if text.isascii() else PIECE
        if len(text) <= STRETCH:
            return b"".join(map(self.known.__getitem__, pattern.findall(text)))
        pieces = map(itemgetter(0), pattern.finditer(text))
        return b"".join([b"".join(map(self.known.__getitem__, some)) for some in batched(pieces, STRETCH)])


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write_ids(
    docs: DataFrame, folder: str, tokenizer: str, planes: int = BYTE, block: int = BLOCK, file_ids: int = FILE_IDS
) -> DataFrame:
    """Write the ids of all documents, in ascending order of doc_id, and return the index of files.

    ``tokenizer`` is the path of a tokenizer file on every executor, ``folder`` one that all of them can write.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = need(docs, doc_id="bigint", text="string").withColumns(
        {"_print": fingerprint(text), "_tie": F.monotonically_increasing_id()}
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("_print"), F.col("_tie")]
    ranges = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    flat = ranges.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        number, out, end = 0, None, np.array([END_ID], "<u4")
        for batch in batches:
            encoded = _encoder(tokenizer).encode([t or "" for t in batch["text"]])
            for doc_id, none, ids in zip(batch["doc_id"], batch["none"], encoded):
                out = out or IdWriter(planes, block)
                out.add(None if none else int(doc_id), np.concatenate([ids, end]))
                if out.n_ids >= file_ids:
                    yield _save(out, folder, part, number, attempt)
                    number, out = number + 1, None
        if out:
            yield _save(out, folder, part, number, attempt)

    return written(flat.mapInPandas(encode, _INDEX), "id-files-index")


def _save(out: IdWriter, folder: str, part: int, number: int, attempt: int) -> pd.DataFrame:
    content, name = out.close(), f"ids-{part:06d}-{number:06d}-{attempt}.idp"
    store, path = _folder(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as stream:
        stream.write(content)
    row = (part, number, name, len(out.docs), out.n_ids, len(content))
    return pd.DataFrame([row], columns=[c.split()[0] for c in _INDEX.split(", ")])


def _folder(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if "://" not in folder else folder)
    return fs.LocalFileSystem(), folder


def read_ids(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian, binary) of each document.

    Files are decoded where they are read; where a file starts is the sum over earlier ranges and over
    earlier files of its range, so the one window over everything has a row for each range.
    """
    names = index.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ranges = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = names.select("part", F.coalesce(F.sum("n").over(ranges), F.lit(0)).alias("_part_start"))
    files = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    within = index.withColumn("_file_start", F.coalesce(F.sum("n_ids").over(files), F.lit(0)))
    starts = within.join(parts, "part").select("name", (F.col("_part_start") + F.col("_file_start")).alias("_start"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                yield from _documents(name, IdFile(io.BytesIO(content)))

    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.idp")
    if index.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids binary")
    found = reader.load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = found.mapInPandas(decode, "name string, doc_id bigint, none boolean, at bigint, ids binary")
    return rows.join(starts, "name").select(
        F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"),
        (F.col("_start") + F.col("at")).alias("start"),
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        "ids",
    )


def _documents(name: str, file: IdFile, ids_at_once: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """The documents of a file, some at a time: as many as have ``ids_at_once`` ids, one at least."""
    first = 0
    while first < len(file.docs):
        begin = int(file.ends[first] - file.docs[first, 2])
        last = max(int(np.searchsorted(file.ends, begin + ids_at_once, "right")), first + 1)
        ids = file.ids(begin, int(file.ends[last - 1]))
        ends = file.ends[first:last] - begin
        starts = ends - file.docs[first:last, 2]
        raw = [ids[a:b].tobytes() for a, b in zip(starts, ends)]
        docs = file.docs[first:last]
        yield pd.DataFrame(
            {"name": name, "doc_id": docs[:, 0], "none": docs[:, 1] == 1, "at": starts + begin, "ids": raw}
        )
        first = last
