"""Token ids in wavelet-matrix files.

Texts are range-partitioned by doc_id and encoded; every task writes its ids, in ascending
doc_id order, as files of a few million tokens.  A file holds one wavelet matrix: the ids
are numbered by the file's own alphabet, and one bit-plane per binary digit of that
number, most significant first, with all zeros of a plane moved before its ones.  A
directory of ones per 512 bits gives rank in constant time; access, rank, select, counts
and occurrences of an id come from the one file without decoding it.

Files are written under a temporary name and moved, so a repeated task replaces its own
files by equal ones.
"""

from __future__ import annotations

import re
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import stage, table, text_of
from tickloom.sources.sinks import work_folder

MAGIC = b"TLWAVE01"
HEADER = "<8sIIQQII"
FILE_TOKENS = 1 << 22
BLOCK = 512
CACHE = 600_000


# --- encoding ---------------------------------------------------------------------------

# The vocabulary's own pre-tokenisation, for texts of these letters, ASCII digits, ASCII marks and ASCII white space only.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = re.compile(rf"[\t-\r -~{LETTERS}]*")
PIECE = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{LETTERS}]+| ?[0-9]+| ?[^\t-\r {LETTERS}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes.

    Ids of a piece do not depend on its neighbours, so pieces are kept, up to a bound.  A
    text with other characters than PLAIN's, or with the content of an added token, goes
    through the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")

    def __missing__(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        ids = struct.pack(f"<{len(tokens)}I", *(t.id for t in tokens))
        if len(self) < CACHE:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) and not self.added.search(text):
            return b"".join(map(self.__getitem__, PIECE.findall(text)))
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def worker_encoder(path: str) -> Encoder:
    """One encoder per Python worker and tokenizer, kept for the worker's later tasks."""
    kept = sys.modules.setdefault("_tickloom_worker", types.ModuleType("_tickloom_worker")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


# --- the file format --------------------------------------------------------------------

def pack(part: int, seq: int, docs: list[tuple[int | None, int]], ids: np.ndarray) -> bytes:
    """A file's bytes: header, alphabet, doc ids with null flags, token counts, planes with zeros and directory."""
    flags = np.zeros(int(ids.max(initial=0)) + 1, bool)
    flags[ids] = True
    alphabet = np.flatnonzero(flags).astype("<u4")
    number = np.zeros(len(flags), np.uint32)
    number[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    planes = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    seqn = number[ids].astype(np.uint16 if planes <= 16 else np.uint32)
    out = [struct.pack(HEADER, MAGIC, part, seq, len(ids), len(docs), len(alphabet), planes), alphabet.tobytes(),
           np.array([d or 0 for d, _ in docs], "<i8").tobytes(), np.array([d is None for d, _ in docs], "u1").tobytes(), np.array([n for _, n in docs], "<u8").tobytes()]
    for k in range(planes - 1, -1, -1):
        ones = (seqn & seqn.dtype.type(1 << k)) != 0
        # Positions are several times faster to take by than a mask.
        low, high = seqn.take(np.flatnonzero(~ones)), seqn.take(np.flatnonzero(ones))
        bits = np.packbits(ones)
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        per = np.bitwise_count(bits.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
        out += [struct.pack("<Q", len(low)), (np.cumsum(per) - per).astype("<u8").tobytes(), bits.tobytes()]
        seqn = np.concatenate([low, high])
    return b"".join(out)


class Wavelet:
    """Reader of one file."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, self.part, self.seq, self.n, n_docs, n_symbols, n_planes = struct.unpack_from(HEADER, view)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize(HEADER)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(view, kind, count, at)
            at += got.nbytes
            return got

        self.alphabet = take("<u4", n_symbols)
        self.doc_ids, self.doc_null, self.doc_tokens = take("<i8", n_docs), take("u1", n_docs).astype(bool), take("<u8", n_docs).astype(np.int64)
        blocks = -(-self.n // BLOCK)
        self.planes = []
        for _ in range(n_planes):
            zeros = int(take("<u8", 1)[0])
            self.planes.append((zeros, take("<u8", blocks), take("u1", blocks * BLOCK // 8)))

    def _ones(self, plane: int, i: int) -> int:
        """Ones before position i."""
        _, directory, bits = self.planes[plane]
        if i >= self.n:
            return self.n - self.planes[plane][0]
        block = i // BLOCK
        byte = i // 8
        inside = int(np.bitwise_count(bits[block * BLOCK // 8:byte]).sum())
        return int(directory[block]) + inside + (int(bits[byte]) >> (8 - i % 8)).bit_count() * (i % 8 > 0)

    def _bit(self, plane: int, i: int) -> int:
        return int(self.planes[plane][2][i // 8]) >> (7 - i % 8) & 1

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        symbol = 0
        for p, (zeros, _, _) in enumerate(self.planes):
            bit, ones = self._bit(p, i), self._ones(p, i)
            symbol = symbol << 1 | bit
            i = zeros + ones if bit else i - ones
        return int(self.alphabet[symbol])

    def _symbol(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        """Where the symbol's occurrences before ``end`` stand after the last plane."""
        low, high = 0, end
        for p, (zeros, _, _) in enumerate(self.planes):
            a, b = self._ones(p, low), self._ones(p, high)
            low, high = (zeros + a, zeros + b) if symbol >> (len(self.planes) - 1 - p) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, i: int) -> int:
        """Occurrences of an id before position i."""
        symbol = self._symbol(token)
        if symbol is None:
            return 0
        low, high = self._range(symbol, min(max(i, 0), self.n))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) zero or one of a plane."""
        _, directory, _ = self.planes[plane]
        before = directory.astype(np.int64) if bit else np.arange(len(directory), dtype=np.int64) * BLOCK - directory.astype(np.int64)
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[plane][2][block * BLOCK // 8:(block + 1) * BLOCK // 8])[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        symbol = self._symbol(token)
        if symbol is None or not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(symbol, self.n)[0] + k
        for p in range(len(self.planes) - 1, -1, -1):
            bit = symbol >> (len(self.planes) - 1 - p) & 1
            i = self._select_bit(p, bit, i - self.planes[p][0] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids in order, rebuilt plane by plane from the last one."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for k, (zeros, _, bits) in enumerate(reversed(self.planes)):
            ones = np.unpackbits(bits, count=self.n).view(bool)
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~ones)] = out[:zeros]
            up[np.flatnonzero(ones)] = out[zeros:] | kind(1 << k)
            out = up
        return self.alphabet[out] if self.n else np.zeros(0, "<u4")


# --- Spark jobs -------------------------------------------------------------------------

def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, also where the cluster's default file system is implied."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def put(folder: str, name: str, data: bytes) -> None:
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as out:
        out.write(data)
    store.move(temporary, f"{base}/{name}")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) below ``folder``; one row per file: part, seq, tokens, docs.

    Ascending doc_id, null first; equal ids by a hash of the text.  A null text is empty and
    has its end id only.  A document never spans two files.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seq, encoder = TaskContext.get().partitionId(), 0, None
        held: list[bytes] = []
        rows: list[tuple[int | None, int]] = []
        tokens = 0

        def flush() -> pd.DataFrame:
            put(folder, f"{part:06d}-{seq:06d}.wm", pack(part, seq, rows, np.frombuffer(b"".join(held), "<u4")))
            return pd.DataFrame({"part": [part], "seq": [seq], "tokens": [tokens], "docs": [len(rows)]})

        for batch in batches:
            encoder = encoder or worker_encoder(tokenizer)
            for doc, missing, text in zip(batch["doc_id"], batch["no_id"], batch["text"]):
                ids = encoder.encode(text)
                held += [ids, b"\0\0\0\0"]
                rows.append((None if missing else int(doc), len(ids) // 4 + 1))
                tokens += len(ids) // 4 + 1
                if tokens >= file_tokens:
                    yield flush()
                    held, rows, tokens, seq = [], [], 0, seq + 1
        if rows:
            yield flush()

    texts = docs.select(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), text_of().alias("text"))
    order = [F.desc("no_id"), F.asc("doc_id"), F.xxhash64("text")]
    placed = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(placed.mapInPandas(files, "part int, seq int, tokens long, docs long"))


def read_tokens(spark: SparkSession, folder: str, written: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone; ``written`` says where each file starts."""
    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                file = Wavelet(content)
                ids = memoryview(file.ids().astype("<u4", copy=False).tobytes())
                ends = np.cumsum(file.doc_tokens)
                starts = ends - file.doc_tokens
                yield pd.DataFrame({
                    "part": np.int32(file.part), "seq": np.int32(file.seq), "no_id": file.doc_null, "doc_id": file.doc_ids, "within": starts, "n_tokens": file.doc_tokens,
                    "ids_crc32": np.fromiter((zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())), np.int64, len(ends))})

    before = Window.partitionBy().orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = written.select(F.col("part").alias("p"), F.col("seq").alias("s"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("content")
    rows = content.mapInPandas(documents, "part int, seq int, no_id boolean, doc_id long, within long, n_tokens long, ids_crc32 long")
    out = rows.join(stage(starts), (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")))
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op10_wavelet_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place, length and checksum as read back from the files.  An empty table gives no files and no rows."""
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    target = work_folder(spark)
    written = write_tokens(docs, target, public_tokenizers.path("byte_bpe_50k.json"))
    if written.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(spark, target, written)
