"""Token-id files of independent zstandard frames with a trailing seek table.

A file holds documents in ascending id order. Each frame is a whole zstandard frame over the ids of
some neighbouring documents (unsigned 16- or 32-bit, little-endian), so a reader decompresses only
the frames of the documents it wants. Two skippable frames follow, which plain zstandard tools pass
over: the documents (per document the id, the frame, the place in it and the number of ids, and a CRC-32 of
that list), and at the end of the file the seek table in the published seekable format: per frame its
compressed and plain size and the low half of the XXH64 of its plain bytes.

Files go to the folder that the cluster shares; every task attempt writes a name of its own and
only the names of finished tasks enter the manifest, so a task that runs twice does no harm.

Edge cases: a null or empty text is the end id alone; null document ids come first and are stored as
null; repeated ids are stored each for itself, in order of text; an empty table gives no files and an
empty result; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids as ids_of
from .common import new_path, written
from .tokens import encoder, in_slices

# fixed values of the zstandard formats: magic numbers of skippable frames, seek table descriptor (with checksums) and mark
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
CHECKSUMS = 0x80
SEEK_MARK = 0x8F92EAB1
FRAME_IDS = 1 << 17
FILE_IDS, FILE_DOCS = 1 << 26, 1 << 20  # a file that holds so many ids or documents is closed, and the task begins another
ROWS_AT_ONCE = 20_000

_FRAME = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("sum", "<u4")])
_DOC = np.dtype([("known", "u1"), ("id", "<i8"), ("frame", "<u4"), ("first", "<u4"), ("n", "<u8")])
_DOCS = struct.Struct("<QBI")  # documents, bytes an id, CRC of their list
_HEAD = struct.Struct("<II")  # magic number and size of a skippable frame
_FOOTER = struct.Struct("<IBI")  # frames, descriptor, mark


def _checksum(plain: bytes) -> int:
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class TokenFileWriter:
    def __init__(self, uri: str, width: int = 4, level: int = 3):
        self.files, path = opened(uri)
        self.uri, self.path, self.width = uri, path, width
        self.out = self.files.open_output_stream(path, compression=None)
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[bool, int, int, int, int]] = []
        self.held: list[bytes] = []
        self.n_held = self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """A document larger than a frame gets a frame of its own."""
        self.docs.append((doc_id is not None, doc_id or 0, len(self.frames), self.n_held, len(ids)))
        self.held.append(ids.astype(f"<u{self.width}").tobytes())
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= FRAME_IDS:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            plain = b"".join(self.held)
            packed = self.zip.compress(plain)
            self.out.write(packed)
            self.frames.append((len(packed), len(plain), _checksum(plain)))
            self.held, self.n_held = [], 0

    def close(self) -> None:
        self._flush()
        docs = np.array(self.docs, _DOC).tobytes()
        body = _DOCS.pack(len(self.docs), self.width, zlib.crc32(docs)) + docs
        self.frames.append((_HEAD.size + len(body), 0, _checksum(b"")))
        table = np.array(self.frames, _FRAME).tobytes() + _FOOTER.pack(len(self.frames), CHECKSUMS, SEEK_MARK)
        self.out.write(_HEAD.pack(SKIPPABLE, len(body)) + body + _HEAD.pack(SEEK_TABLE, len(table)) + table)
        self.out.close()


class TokenFileReader:
    """Reads the seek table, then only the frames that are asked for; checks every checksum."""

    def __init__(self, uri: str):
        files, path = opened(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        frames, descriptor, mark = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        length = frames * _FRAME.itemsize
        if (descriptor, mark) != (CHECKSUMS, SEEK_MARK):
            raise ValueError(f"{uri}: no seek table")
        self.frames = np.frombuffer(self.file.read_at(length, size - _FOOTER.size - length), _FRAME)
        self.at = np.concatenate(([0], np.cumsum(self.frames["packed"].astype(np.int64))))
        body = self.file.read_at(int(self.frames["packed"][-1]), int(self.at[-2]))[_HEAD.size :]
        n, self.width, crc = _DOCS.unpack(body[: _DOCS.size])
        if zlib.crc32(body[_DOCS.size :]) != crc:
            raise ValueError(f"{uri}: the list of documents is damaged")
        self.docs = np.frombuffer(body, _DOC, n, _DOCS.size)
        self.unzip = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> np.ndarray:
        plain = self.unzip.decompress(self.file.read_at(int(self.frames["packed"][k]), int(self.at[k])), max_output_size=int(self.frames["plain"][k]))
        if _checksum(plain) != self.frames["sum"][k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(plain, f"<u{self.width}")

    def read(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id, ids) in file order, of all documents or of the wanted ids."""
        rows = self.docs if wanted is None else self.docs[np.isin(self.docs["id"], np.fromiter(wanted, np.int64)) & (self.docs["known"] == 1)]
        last, ids = -1, np.empty(0)
        for row in rows:
            if row["frame"] != last:
                last, ids = int(row["frame"]), self.frame(int(row["frame"]))
            yield int(row["id"]) if row["known"] else None, ids[row["first"] : row["first"] + row["n"]]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Write all documents by id ranges; returns the manifest (path, first_id, n_docs, n_ids).

    Files are bounded, however few partitions there are; those of a task are named in order, as first ids may be equal.
    """
    folder = new_path(docs.sparkSession, "tokens")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, out, first, n_files = uuid.uuid4().hex, None, None, 0
        tail = np.asarray([end_id], "<u4")

        def closed() -> pd.DataFrame:
            out.close()
            return pd.DataFrame([(out.uri, first, len(out.docs), out.n_ids)], columns=["path", "first_id", "n_docs", "n_ids"]).astype({"first_id": "Int64"})

        for pdf in batches:
            names = ids_of(pdf["id"])
            for at, texts in in_slices(pdf["text"].tolist()):
                for k, ids in enumerate(encoder(tokenizer).encode(texts), at):
                    if out is None:
                        files, path = opened(folder)
                        files.create_dir(path, recursive=True)
                        out, first, n_files = TokenFileWriter(f"{folder}/{name}-{n_files:06d}.ids.zst"), names[k], n_files + 1
                    out.add(names[k], np.concatenate((np.frombuffer(ids, "<u4"), tail)))
                    if out.n_ids >= file_ids or len(out.docs) >= file_docs:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    return written(ordered.mapInPandas(write, "path string, first_id long, n_docs long, n_ids long"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32.

    The manifest has one row per file; a window over it gives each file the ids before it.
    """
    before = F.sum("n_ids").over(Window.orderBy(F.asc_nulls_first("first_id"), "path").rowsBetween(Window.unboundedPreceding, -1))
    files = written(manifest.select("path", F.coalesce(before, F.lit(0)).alias("base")), "files")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri, start in zip(pdf["path"], pdf["base"], strict=True):
                out = []
                for doc, ids in TokenFileReader(uri).read():
                    out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == ROWS_AT_ONCE:
                        yield pd.DataFrame(out, columns=["id", "start", "n_tokens", "ids_crc32"]).astype({"id": "Int64"})
                        out = []
                yield pd.DataFrame(out, columns=["id", "start", "n_tokens", "ids_crc32"]).astype({"id": "Int64"})

    return files.repartition(max(1, files.count()), "path").mapInPandas(read, "id long, start long, n_tokens long, ids_crc32 long")
