"""Token-ID / binary output: one wavelet matrix per shard.

Texts go through a public tokenizer in ascending id order and are written as shards of about SHARD_TOKENS ids. A shard
file holds a wavelet matrix: one bit-plane for each bit of the ids, most significant first, where each plane stably
sorts the sequence by its bit for the next. With the count of ones before every block of 512 bits as directory, a file answers access(i),
rank(id, i), count(id) and select(id, k) on the planes, once these are unpacked; decode() gives all ids. Document ids and offsets are in the
file too, and every section is compressed with zstandard.

Null texts are empty and get the end id alone, null ids come first, equal ids are ordered by their text, an empty
table gives no files and no rows. Files are written under a temporary name and renamed, so a task that runs
again leaves the same file. The place of a shard in the whole is a sum over the manifest, which has a row for each file.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_path, settle, table, whole_text

MAGIC = b"TQWM0001"
VOCABULARY, END_ID = "word_bpe_49k.json", 1
SHARD_TOKENS = 1 << 20
#: Bits between two entries of a plane's directory.
RANK_BLOCK = 512
#: Distinct bases of runs whose ids a worker remembers.
REMEMBERED = 1_000_000


class WaveletMatrix:
    """planes: packed bits, most significant first; ranks: ones before each block; zeros: zeros in each plane."""

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.ranks, self.zeros = n, planes, ranks, zeros

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max(initial=0)).bit_length())
        planes, ranks, zeros, seq = [], [], [], ids.astype(np.uint16 if bits <= 16 else np.uint32)
        spare = np.empty_like(seq)
        for b in range(bits - 1, -1, -1):
            one = (seq & seq.dtype.type(1 << b)).astype(bool)
            planes.append(np.packbits(one, bitorder="little"))
            ranks.append(cls.directory(planes[-1]))
            zeros.append(len(seq) - int(np.count_nonzero(one)))
            np.compress(~one, seq, out=spare[: zeros[-1]])
            np.compress(one, seq, out=spare[zeros[-1] :])
            seq, spare = spare, seq
        return cls(len(ids), planes, ranks, zeros)

    @staticmethod
    def directory(plane: np.ndarray) -> np.ndarray:
        step = RANK_BLOCK // 8
        ones = np.bitwise_count(np.pad(plane, (0, -len(plane) % step))).reshape(-1, step).sum(1)
        return np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    def bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // RANK_BLOCK
        plane, at = self.planes[level], block * RANK_BLOCK // 8
        total = int(self.ranks[level][block]) + int(np.bitwise_count(plane[at : i >> 3]).sum())
        return total + (int(plane[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else total

    def access(self, i: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            one = self.bit(level, i)
            value = value << 1 | one
            i = zeros + self.ones(level, i) if one else i - self.ones(level, i)
        return value

    def interval(self, symbol: int, upto: int) -> tuple[int, int]:
        """Where the last plane's order holds the occurrences of symbol among the first upto ids."""
        low, high = 0, upto
        for level, zeros in enumerate(self.zeros):
            a, b = self.ones(level, low), self.ones(level, high)
            low, high = (zeros + a, zeros + b) if symbol >> (len(self.zeros) - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, symbol: int, upto: int) -> int:
        """Occurrences of symbol among the first upto ids."""
        if symbol >> len(self.zeros):
            return 0
        low, high = self.interval(symbol, upto)
        return high - low

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def place(self, level: int, one: int, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a plane: by its directory, then within the block."""
        starts = self.ranks[level].astype(np.int64)
        starts = starts if one else np.arange(len(starts)) * RANK_BLOCK - starts
        block = int(np.searchsorted(starts, k, "right")) - 1
        at = block * RANK_BLOCK
        bits = np.unpackbits(self.planes[level][at // 8 : (at + RANK_BLOCK) // 8], bitorder="little")
        return at + int(np.flatnonzero(bits == one)[k - starts[block]])

    def select(self, symbol: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of symbol."""
        if not 0 <= k < self.count(symbol):
            raise IndexError(k)
        i = self.interval(symbol, self.n)[0] + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one = symbol >> (len(self.zeros) - 1 - level) & 1
            i = self.place(level, one, i - self.zeros[level] if one else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids: the planes undone from the last to the first."""
        seq = np.zeros(self.n, np.uint32 if len(self.zeros) > 16 else np.uint16)
        for level in range(len(self.zeros) - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            zeros, back = self.zeros[level], np.empty_like(seq)
            back[~one] = seq[:zeros]
            back[one] = seq[zeros:] | seq.dtype.type(1 << (len(self.zeros) - 1 - level))
            seq = back
        return seq


def pack(ids: np.ndarray, doc_ids: list, counts: list[int]) -> bytes:
    """The file of a shard: magic, header length, header (JSON), compressed sections."""
    matrix, squeeze = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1)
    known = np.array([d is not None for d in doc_ids], bool)
    sections = [np.packbits(known), np.array([d if d is not None else 0 for d in doc_ids], "<i8"), np.array(counts, "<i8")]
    sections += [x for plane, ranks in zip(matrix.planes, matrix.ranks, strict=True) for x in (plane, ranks.astype("<u4"))]
    data = [squeeze.compress(x.tobytes()) for x in sections]
    header = json.dumps({"ids": len(ids), "docs": len(doc_ids), "zeros": matrix.zeros, "sections": [len(d) for d in data]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *data])


def unpack(data: bytes) -> tuple[WaveletMatrix, list, np.ndarray]:
    """The matrix, the document ids and the ids in each document."""
    if data[:8] != MAGIC:
        raise ValueError("not a shard file")
    size = struct.unpack("<I", data[8:12])[0]
    header, at, sections = json.loads(data[12 : 12 + size]), 12 + size, []
    for n in header["sections"]:
        sections.append(zstandard.ZstdDecompressor().decompress(data[at : at + n]))
        at += n
    known = np.unpackbits(np.frombuffer(sections[0], np.uint8), count=header["docs"]).astype(bool)
    doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(sections[1], "<i8"), known, strict=True)]
    planes = [np.frombuffer(s, np.uint8) for s in sections[3::2]]
    ranks = [np.frombuffer(s, "<u4") for s in sections[4::2]]
    return WaveletMatrix(header["ids"], planes, ranks, header["zeros"]), doc_ids, np.frombuffer(sections[2], "<i8")


def put(path: str, data: bytes) -> None:
    """Writes a file in the shared folder under another name first."""
    mark = f".tmp-{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}-"
    folder, _, name = path.rpartition("/")
    if path.startswith("file:") or "://" not in path:
        folder = "/" + folder.removeprefix("file:").lstrip("/")
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{mark}{name}", "wb") as f:
            f.write(data)
        os.replace(f"{folder}/{mark}{name}", f"{folder}/{name}")
        return
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(folder)
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/{mark}{name}") as f:
        f.write(data)
    system.move(f"{folder}/{mark}{name}", f"{folder}/{name}")


#: Punctuation that, behind a letter or digit, is a token of its own run whatever follows or precedes.
TRAILING = ".,;:!?#$%&*"
#: Such a letter or digit: it stays one letter or digit in lower case and NFC (U+0130 doesn't, nor do many beyond U+017F).
CLOSED = "[0-9A-Za-zÀ-ÖØ-öø-įı-ſ]$"
#: The steps of the vocabulary file that allow encoding runs between ASCII white space one by one. They drop white
#: space, lower-case character by character, and part runs of letters, single digits and runs of other signs.
BY_RUNS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "end_of_word_suffix": "</w>",
}
#: Bases encoded at once.
LEARNED_AT_ONCE = 50_000
#: Bytes of texts that are split at once.
SPLIT_BYTES = 8 << 20


def by_runs(path: str) -> bool:
    """Whether the file's steps are those of BY_RUNS; any other file's texts go to the tokenizer whole."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    found = {k: file.get(k) for k in ("normalizer", "pre_tokenizer", "post_processor")} | {"end_of_word_suffix": file["model"].get("end_of_word_suffix")}
    return found == BY_RUNS and not any(set(t["content"]) & set(" \t\n\r\x0b\x0c") or t["lstrip"] or t["rstrip"] for t in file["added_tokens"])


class Encoder:
    """The tokenizer; where its file allows it, asked once for each distinct run between ASCII white space.

    A run of ASCII letters has the ids of its lower case, and punctuation behind a CLOSED letter or digit its own ids; runs of letters
    are encoded many at a time, and told apart by the tokens that end a word. The ids of a batch are then gathered by its distinct runs.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_runs = Tokenizer.from_file(path), by_runs(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        """numbers: base to its number; ids, starts: the ids of all bases, and where each begins."""
        self.numbers: dict[str, int] = {"": 0}
        self.ids_of, self.starts = np.empty(0, np.uint32), np.zeros(2, np.int64)

    def ids(self, runs: list[str]) -> list[list[int]]:
        return [got.ids for got in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]

    def learn(self, bases: list[str]) -> None:
        for a in range(0, len(bases), LEARNED_AT_ONCE):
            part = bases[a : a + LEARNED_AT_ONCE]
            plain = [w for w in part if w.isalpha()]
            ids = np.array(self.ids([" ".join(plain)])[0] if plain else [], np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(plain):
                rest = [w for w in part if not w.isalpha()]
            else:  # a run of letters that the tokenizer parts or joins
                plain, rest, ids, stops = [], part, ids[:0], stops[:0]
            got = self.ids(rest)
            first = len(self.numbers)
            self.numbers.update(zip([*plain, *rest], range(first, first + len(part)), strict=True))
            sizes = np.concatenate([np.diff(stops, prepend=0), np.array([len(x) for x in got], np.int64)])
            self.ids_of = np.concatenate([self.ids_of, ids, np.array([i for x in got for i in x], np.uint32)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def numbered(self, bases: pa.Array) -> np.ndarray:
        """The number of each base, those not seen before encoded first."""
        coded = bases.dictionary_encode()
        names, numbers = coded.dictionary.to_pylist(), self.numbers
        self.learn([w for w in names if w not in numbers])
        return np.fromiter(map(numbers.__getitem__, names), np.int32, len(names))[coded.indices.to_numpy()]

    def parts(self, runs: pa.Array) -> np.ndarray:
        """(n, 2) numbers of what each run is made of: a base and the punctuation behind it."""
        base = pc.utf8_rtrim(runs, TRAILING)
        cut = pc.and_(pc.not_equal(pc.binary_length(base), pc.binary_length(runs)), pc.match_substring_regex(base, CLOSED))
        base = pc.if_else(cut, base, runs)
        behind = np.zeros(len(runs), np.int32)
        at = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        pairs = zip(runs.take(pa.array(at)).to_pylist(), base.take(pa.array(at)).to_pylist(), strict=True)
        behind[at] = self.numbered(pa.array([r[len(b) :] for r, b in pairs], pa.large_string()))
        return np.stack([self.numbered(pc.if_else(pc.ascii_is_alpha(base), pc.ascii_lower(base), base)), behind], 1)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has."""
        if not self.by_runs:
            got = self.ids(texts.to_pylist())
            return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)
        if len(self.numbers) > REMEMBERED:
            self.forget()
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        bases = self.parts(coded.dictionary)
        stops = 2 * (split.offsets.to_numpy() - split.offsets[0].as_py())
        bases = bases[coded.indices.to_numpy()].ravel()
        sizes = np.diff(self.starts).astype(np.int32)[bases]
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        # The places of a base's ids: from its start on, as far as the next.
        some = np.flatnonzero(sizes)
        steps = np.ones(int(ends[-1]), np.int32)
        begin, last = self.starts[bases[some]], (self.starts[1:] - 1)[bases[some]]
        steps[ends[some]] = begin - np.concatenate([[0], last[:-1]])
        return self.ids_of[np.cumsum(steps, dtype=np.int32)], np.diff(ends[stops])


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process: what it remembers serves its later tasks too."""
    return Encoder(path)


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def writer(folder: str, vocabulary_path: str | None, end_id: int, shard_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, made = TaskContext.get().partitionId(), []
        encode_all = encoder(vocabulary_path or vocabulary()).encode_all
        held: list[np.ndarray] = []
        docs: list = []
        counts: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            name = f"shard-{partition:06d}-{len(made):06d}.wm"
            put(f"{folder}/{name}", pack(np.concatenate(held), docs, counts))
            made.append((name, partition, len(made), len(docs), size))
            held.clear()
            docs.clear()
            counts.clear()
            size = 0

        for batch in batches:
            texts, sizes = batch.column("text"), np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
            names = [d if known else None for d, known in zip(batch.column("doc_id").to_pylist(), batch.column("known").to_pylist(), strict=True)]
            a = 0
            while a < len(names):
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + SPLIT_BYTES, "right")))
                ids, many = encode_all(texts.slice(a, b - a))
                stops = np.cumsum(many)
                ids, many, stops = np.insert(ids, stops, np.uint32(end_id)), many + 1, stops + np.arange(1, len(many) + 1)
                c, begin = 0, 0
                while c < len(many):  # a shard ends with the document that fills it
                    d = min(len(many), int(np.searchsorted(stops, begin + shard_tokens - size, "left")) + 1)
                    end = int(stops[d - 1])
                    held.append(ids[begin:end])
                    docs.extend(names[a + c : a + d])
                    counts.extend(many[c:d].tolist())
                    size, c, begin = size + end - begin, d, end
                    if size >= shard_tokens:
                        flush()
                a = b
        if docs:
            flush()
        columns = zip(*made, strict=True) if made else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["file", "partition", "nth", "n_docs", "n_ids"])

    return write


def write_token_shards(docs: DataFrame, folder: str, vocabulary_path: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shard files and returns their manifest: file, partition, nth, n_docs, n_ids."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.coalesce("doc_id", F.lit(-(2**63))).cast("long")
    rows = docs.select(at.alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), whole_text().alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "known", "text")
    return settle(rows.mapInArrow(writer(folder, vocabulary_path, end_id, shard_tokens), "file string, partition int, nth int, n_docs long, n_ids long"), "token-manifest")


def read_token_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: from the files that the manifest names."""
    spark = manifest.sparkSession
    schema = "file string, doc_id long, inside long, n_tokens long, ids_crc32 long"
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                matrix, doc_ids, counts = unpack(content)
                ids, ends = matrix.decode().astype("<u4"), np.cumsum(counts)
                checks = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, counts, strict=True)]
                yield pd.DataFrame({"file": path.rpartition("/")[2], "doc_id": pd.array(doc_ids, "Int64"), "inside": ends - counts, "n_tokens": counts, "ids_crc32": checks})

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    before = Window.orderBy("partition", "nth").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each file
    starts = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    return files.mapInPandas(read, schema).join(starts, "file").select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op6_tokens(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-shards")
    return read_token_shards(write_token_shards(table(spark, sf_dir, "documents"), folder), folder)
