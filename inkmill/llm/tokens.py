"""Operator 1: token-ID files.

A data set of token files is one folder. Each non-empty part is a pair of files,
numbered in ascending order of document id:

part-NNNNNN.bin  token ids of all its documents, one after the other, as flat
                 little-endian unsigned integers of the width in the index header
part-NNNNNN.idx  header (8 bytes magic, u32 id width in bytes, u32 zero, u64 number
                 of documents n), n i64 document ids, n u8 flags (1: id is null),
                 padding to 8 bytes, n+1 u64 offsets, counted in ids from the part's start

A part's base, the number of ids in all parts before it, is a prefix sum over the
parts' totals: one number per part meets in the driver, never one per document.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm._shared import Scratch, frugal

MAGIC = b"INKTOK01"
#: White space at which every text may be cut before tokenization (see encoder()), and such
#: as str.split() cuts at too but the tokenizer may not.
CUT = re.compile(r"[ \n\t\r]+")
OTHER_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The word-end vocabulary's own rule for pieces, on lower-cased text.
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Texts of Latin letters, digits and signs, whose lower case and normal form go character by
#: character, and PIECES for these once they are lower-cased.
LATIN = re.compile(r"[\t\n\r\x20-\x7e\u00a1-\u012f\u0131-\u017f]*")
_L, _N = r"a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f", r"0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
LATIN_PIECES = re.compile(f"[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_N}]|[^\\s{_L}{_N}]+")


@dataclass(frozen=True)
class TokenFiles:
    """A written data set: its folder and (part number, first id's position, documents, ids) per part."""

    folder: str
    width: int
    parts: list[tuple[int, int, int, int]]


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 bytes
    by themselves, the others by the letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Cache(dict):
    """A cache of two generations of at most `most` entries each, filled by make()."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def rest(self) -> None:
        """Between texts: a full generation becomes the old one."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


@dataclass(frozen=True)
class Rules:
    """What encode() must know of a tokenizer's rules: whether they drop white space and never
    join across it, as those of the word-end vocabulary, and how its special tokens begin."""

    words_apart: bool
    special: tuple[str, ...]
    size: int


def read_rules(tokenizer_path: str) -> Rules:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    rules = json.loads(tokenizer.to_str())
    steps = [[x["type"] for x in rules[k]["normalizers" if k == "normalizer" else "pretokenizers"]] if (rules[k] or {}).get("type") == "Sequence" else None for k in ("normalizer", "pre_tokenizer")]
    apart = steps == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] and rules["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": PIECES}
    special = tuple(sorted({t["content"][:2] for t in rules["added_tokens"]}))
    return Rules(apart, special, tokenizer.get_vocab_size(with_added_tokens=True))


def encoder(tokenizer_path: str, width: int, most: int = 60_000, rules: Rules | None = None):
    """text -> its ids as bytes.

    A tokenizer whose rules drop white space and never join across it sees each distinct piece
    of Latin text once; a text is the concatenation of its pieces' ids. Texts with other
    letters or special tokens are cut at white space only, and each distinct run goes through
    the whole tokenizer. Any other tokenizer gets whole texts. Caches are bounded and live as
    long as the encoder, which is a task's, so memory grows neither with texts nor with tasks.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    rules = rules or read_rules(tokenizer_path)
    tokenizer = Tokenizer.from_file(tokenizer_path)
    kind = np.dtype(f"<u{width}")
    whole = lambda text: np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, kind).tobytes()
    if not rules.words_apart:
        return whole
    model, letters, special = tokenizer.model, _byte_letters(), rules.special
    packed = [i.to_bytes(width, "little") for i in range(rules.size)]

    def piece(text: str) -> bytes:
        if not text.isascii():
            text = "".join([letters[b] for b in text.encode()])
        return b"".join([packed[t.id] for t in model.tokenize(text)])

    pieces, runs = _Cache(piece, most), _Cache(whole, most // 4)

    def encode(text: str) -> bytes:
        if LATIN.fullmatch(text) is None or any(t in text for t in special):
            cut = text.split() if OTHER_SPACE.search(text) is None else CUT.split(text)
            data = b"".join(map(runs.__getitem__, cut))
            runs.rest()
        else:
            data = b"".join(map(pieces.__getitem__, LATIN_PIECES.findall(text.lower())))
            pieces.rest()
        return data

    return encode


def _store(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def _names(folder: str, part: int) -> tuple[str, str]:
    return f"{folder}/part-{part:06d}.bin", f"{folder}/part-{part:06d}.idx"


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2) -> TokenFiles:
    """Encodes every whole text of docs (doc_id, text), appends end_id to each document
    and writes token files in ascending doc_id order.

    Null text: empty, so the document is its end id alone. Null doc_id: first of all.
    Repeated rows and repeated ids: each row is a document; ties are ordered by text.
    Empty table: no parts. Texts of any length are encoded whole. Other columns are not read. A task that runs again writes the
    same bytes under the same names; files are renamed into place, so a lost executor
    leaves no torn part. Memory: one batch of texts and 17 bytes per document of a part.
    """
    rules = read_rules(tokenizer_path)
    width = 2 if max(rules.size, end_id + 1) <= 1 << 16 else 4

    def encode_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        encode = None
        end = np.asarray([end_id], np.dtype(f"<u{width}")).tobytes()
        store, at = _store(folder)
        ids: list[int] = []
        null: list[int] = []
        ends = [0]
        out = None
        for batch in batches:
            if batch.num_rows and out is None:
                store.create_dir(at, recursive=True)
                temporary = f"{at}/.{part:06d}-{attempt}"
                out = store.open_output_stream(temporary + ".bin")
            if batch.num_rows and encode is None:
                encode = encoder(tokenizer_path, width, rules=rules)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encode(text.as_py())
                out.write(data)
                out.write(end)
                ids.append(0 if doc_id is None else doc_id)
                null.append(doc_id is None)
                ends.append(ends[-1] + len(data) // width + 1)
        if out is None:
            return
        out.close()
        n = len(ids)
        with store.open_output_stream(temporary + ".idx") as index:
            index.write(MAGIC + struct.pack("<IIQ", width, 0, n))
            index.write(np.asarray(ids, "<i8").tobytes())
            index.write(np.asarray(null, "<u1").tobytes() + bytes(-n % 8))
            index.write(np.asarray(ends, "<u8").tobytes())
        for kind, name in zip((".bin", ".idx"), _names(at, part)):
            store.move(temporary + kind, name)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "docs": pa.array([n], pa.int64()), "ids": pa.array([ends[-1]], pa.int64())}
        )

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    # One row per part: bounded by the number of partitions, not by the documents.
    totals = sorted(ordered.mapInArrow(frugal(encode_part), "part int, docs long, ids long").collect())
    parts, base = [], 0
    for part, n, ids_ in totals:
        parts.append((part, base, n, ids_))
        base += ids_
    return TokenFiles(folder, width, parts)


def _open(store, path: str) -> pa.NativeFile:
    """Memory-mapped on a local or mounted file system, else a file read by ranges."""
    return pa.memory_map(path, "r") if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(path)


def read_part(folder: str, part: int, base: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, position of its first id in the data set, its ids) of a part's documents."""
    store, at = _store(folder)
    tokens, index = _names(at, part)
    with _open(store, index) as f:
        head = bytes(f.read_at(24, 0))
        if head[:8] != MAGIC:
            raise ValueError(f"{index} is not a token index")
        width, _, n = struct.unpack("<IIQ", head[8:])
        ids = np.frombuffer(f.read_at(8 * n, 24), "<i8")
        null = np.frombuffer(f.read_at(n, 24 + 8 * n), "<u1")
        offsets = np.frombuffer(f.read_at(8 * (n + 1), 24 + 8 * n + n + (-n % 8)), "<u8").astype(np.int64)
    with _open(store, tokens) as f:
        for i in range(n):
            a, b = int(offsets[i]), int(offsets[i + 1])
            data = np.frombuffer(f.read_at((b - a) * width, a * width), f"<u{width}")
            yield None if null[i] else int(ids[i]), base + a, data


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers) of every document, from the files alone; one task per part."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    rows = [(p, b) for p, b, _, _ in files.parts]
    if not rows:
        return spark.createDataFrame([], schema)
    folder = files.folder

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(*(c.to_pylist() for c in batch.columns)):
                found: list[tuple] = []
                for doc_id, start, ids in read_part(folder, part, base):
                    found.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(found) == 50_000:
                        yield _batch(found)
                        found = []
                if found:
                    yield _batch(found)

    return (
        spark.createDataFrame(rows, "part int, base long").repartition(len(rows)).mapInArrow(frugal(digest), schema)
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows))})


def token_file_digests(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """write_token_files() into the shared folder, then read_token_files() from there: see these
    for nulls, ties, repeated rows and empty tables."""
    files = write_token_files(docs, Scratch(spark, "tokens").root, tokenizer_path, end_id)
    return read_token_files(spark, files)
