"""Token-id output in sorted-string-table shards.

Documents are range-partitioned and sorted by identifier; each task tokenizes its range and streams it into one shard:

    block*   zstd of entries (shared, rest, value length as varints, rest of the key, value), then crc32 of the packed bytes
    index    per block: first key, offset, packed length, entries, ids before the block; every block begins with a whole key
    bloom    bits set by double hashing of each key
    footer   fixed size: places of index and bloom, documents, ids, bits, hashes, width, magic

Keys are prefix-compressed inside a block and sort as bytes the way identifiers sort: null, then integers, then strings. Values
are the document's ids, little-endian, in 2 bytes where the vocabulary allows it, else in 4. A lookup asks the manifest for the
shard, the Bloom filter, then searches the sparse index by bisection and reads one block.

Shards are written under a name of their own per attempt and then renamed, so a task that is run again leaves one whole shard. The
manifest is written last, so tables can be opened again from their folder.

Defined results: a null or empty text is the end id alone; null identifiers come first; equal identifiers stand in the order of
their text's hash, and a lookup returns all of them; texts of any length are encoded whole; an empty table gives no shard; other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import uuid
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import chain
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm._common import chunks, map_arrow, scratch_path, texts_of, worker_cache

MAGIC = b"TLSST001"
FOOTER = struct.Struct("<QQQQQQIIII8s")
INDEX = struct.Struct("<QIIQ")
BLOCK_BYTES = 64 << 10
#: What a worker's caches of words may hold; results are the same with any.
CACHE_BYTES = 288 << 20
BITS_PER_KEY, HASHES = 10, 7


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Bytes as the symbols of byte-level models: printable Latin-1 characters stand for themselves, the others for 256 and up in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SYMBOLS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_MARKS = b".,!?;:()*#$%&|\""


class Recent:
    """A cache under a budget of bytes: entries move through two generations, and those that nobody asked for go with the older one."""

    #: What an entry costs beside its bytes: two objects and its place in the table.
    ENTRY = 180

    def __init__(self, most_bytes: int, longest: int = 64):
        self.half, self.longest = most_bytes // 2, longest
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0

    def put(self, entries: dict[bytes, bytes]) -> None:
        entries = {k: v for k, v in entries.items() if len(k) <= self.longest}
        self.size += sum(map(len, entries)) + sum(map(len, entries.values())) + self.ENTRY * len(entries)
        if self.size > self.half:
            self.old, self.young, self.size = self.young, {}, 0
        self.young.update(entries)


class WordEncoder:
    """Encodes texts as the tokenizer does, but each word once.

    Its normaliser and splitter never look across ASCII white space, and they part a run of letters from the marks around it, so
    a text's ids are those of its words, and a word's are those of its marks and letters. Caches under budgets of bytes keep them.
    Whether the tokenizer is of this build is read from its own settings; any other encodes each text whole.
    """

    #: Words counted before the most frequent ones get a table of their own.
    COUNTED = 250_000
    MOST_HOT = 30_000

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.hot: dict[bytes, bytes] = {}
        self.words, self.pieces = Recent(cache_bytes * 11 // 18), Recent(cache_bytes * 7 // 18)
        self.marks: dict[bytes, bytes] = {b"": b""}
        self.tally: Counter | None = Counter()
        self.plain = splits_words(self.tokenizer.to_str())

    @staticmethod
    def latin(core: bytes) -> str:
        """The normalised letters as the model's byte symbols; empty if they aren't all Latin letters."""
        letters = unicodedata.normalize("NFC", core.decode()).lower()
        return letters.encode().decode("latin-1").translate(_SYMBOLS) if letters.isalpha() and max(letters) < "\u0250" else ""

    def run(self, marks: bytes) -> bytes:
        """The ids of a run of marks: the library's model alone, as normaliser and splitter leave it whole."""
        x = self.marks.get(marks)
        if x is None:
            x = array(self.kind, [t.id for t in self.model.tokenize(marks.decode())]).tobytes()
            if len(marks) <= 8 and len(self.marks) < 20_000:
                self.marks[marks] = x
        return x

    def learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words: marks, letters and marks are put together, words of another build are encoded as they are."""
        young, old, fresh = self.pieces.young.get, self.pieces.old.get, {}
        tokenize, kind, run, out, odd = self.model.tokenize, self.kind, self.run, {}, []
        for w in new:
            tail = w.lstrip(_MARKS)
            core = tail.rstrip(_MARKS)
            x = young(core) or fresh.get(core)
            if x is None:
                x = old(core)
                if x is None:
                    symbols = core.lower().decode() if core.isalpha() else "" if core.isascii() else self.latin(core)
                    if not symbols:
                        odd.append(w)
                        continue
                    x = array(kind, [t.id for t in tokenize(symbols)]).tobytes()
                fresh[core] = x
            if len(core) != len(w):
                x = run(w[: len(w) - len(tail)]) + x + run(tail[len(core) :])
            out[w] = x
        self.pieces.put(fresh)
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False)
        out.update((w, array(kind, e.ids).tobytes()) for w, e in zip(odd, encoded, strict=True))
        return out

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        if not self.plain:
            encoded = self.tokenizer.encode_batch_fast([(t or b"").decode() for t in texts], add_special_tokens=False)
            return [array(self.kind, e.ids).tobytes() for e in encoded]
        # Lower case first, as the normaliser does for A-Z, except where special tokens might be meant.
        lists = [(t.lower() if b"<|" not in t else t).split() if t else [] for t in texts]
        flat = list(chain.from_iterable(lists))
        found = list(map(self.hot.get, flat))
        young, old = self.words.young.get, self.words.old.get
        new, again = [], {}
        for i, x in enumerate(found):
            if x is None:
                w = flat[i]
                x = young(w)
                if x is None:
                    x = old(w)
                    if x is None:
                        new.append(i)
                        continue
                    again[w] = x
                found[i] = x
        if again:
            self.words.put(again)
        if new:
            fresh = self.learn({flat[i] for i in new})
            for i in new:
                found[i] = fresh[flat[i]]
            self.words.put(fresh)
        if self.tally is not None:
            self.tally.update(zip(flat, found, strict=True))
            if self.tally.total() > self.COUNTED:
                # The most frequent words again, side by side in memory, in a table that fits the processor's cache.
                self.hot = {bytes(bytearray(w)): bytes(bytearray(x)) for (w, x), _ in self.tally.most_common(self.MOST_HOT) if len(w) <= 64}
                self.tally = None
        out, at = [], 0
        for x in lists:
            out.append(b"".join(found[at : at + len(x)]))
            at += len(x)
        return out


def splits_words(settings: str) -> bool:
    """Whether a tokenizer's JSON says: NFC, white space to a space, lower case; runs of letters, single digits, runs of marks; bytes; merges."""
    s = json.loads(settings)
    kinds = [x["type"] for x in (s.get("normalizer") or {}).get("normalizers", [])]
    cuts = (s.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if kinds != ["NFC", "Replace", "Lowercase"] or s["normalizer"]["normalizers"][1] != {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}:
        return False
    if [x["type"] for x in cuts] != ["Split", "ByteLevel"] or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"] or not cuts[0]["invert"] or cuts[0]["behavior"] != "Removed":
        return False
    pattern = cuts[0]["pattern"].get("Regex", "")
    plain_tokens = all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in s.get("added_tokens", []))
    return pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and set(pattern[: -len(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")]) <= set("'|abcdefghijklmnopqrstuvwxyz") and s["model"]["type"] == "BPE" and plain_tokens


def encoder(path: str, cache_bytes: int = CACHE_BYTES) -> WordEncoder:
    """Loaded once per Python worker, while it encodes."""
    return worker_cache(("encoder", path, cache_bytes), lambda: WordEncoder(path, cache_bytes))


def key_of(identifier: int | str | None) -> bytes:
    if identifier is None:
        return b""
    if isinstance(identifier, str):
        return b"\x02" + identifier.encode()
    return b"\x01" + struct.pack(">Q", identifier + (1 << 63))


def identifier_of(key: bytes) -> int | str | None:
    if not key:
        return None
    return key[1:].decode() if key[0] == 2 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[i]
        i += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, i
        shift += 7


def bloom_places(key: bytes, bits: int, hashes: int):
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [((a + i * b) & (1 << 64) - 1) % bits for i in range(hashes)]


class ShardWriter:
    """Streams sorted entries into a shard; keeps one block, the sparse index and the keys' hashes in memory."""

    def __init__(self, stream, width: int, block_bytes: int = BLOCK_BYTES):
        import zstandard

        self.stream, self.width, self.block_bytes = stream, width, block_bytes
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.at = self.docs = self.ids = self.block_ids = 0
        self.block, self.entries, self.last, self.first = [], 0, b"", b""
        self.size = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.low = self.high = None

    def add(self, key: bytes, value: bytes) -> None:
        if self.entries and key < self.last:
            raise ValueError("keys must ascend")
        if not self.entries:
            self.first, self.last, self.block_ids = key, b"", self.ids
        shared = len(os.path.commonprefix([self.last, key]))
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.low = key if self.docs == 0 else self.low
        self.last = self.high = key
        self.entries += 1
        self.docs += 1
        self.ids += len(value) // self.width
        if self.size >= self.block_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.entries:
            return
        packed = self.pack(b"".join(self.block))
        self.stream.write(packed + struct.pack("<I", zlib.crc32(packed)))
        self.index.append(varint(len(self.first)) + self.first + INDEX.pack(self.at, len(packed), self.entries, self.block_ids))
        self.at += len(packed) + 4
        self.block, self.entries, self.size = [], 0, 0

    def close(self) -> None:
        self.flush()
        index = b"".join(self.index)
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = np.zeros(bits, np.uint8)
        for k in self.keys:
            bloom[bloom_places(k, bits, HASHES)] = 1
        filter_ = np.packbits(bloom).tobytes()
        self.stream.write(index + filter_)
        self.stream.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(filter_), self.docs, self.ids, bits, HASHES, self.width, zlib.crc32(index + filter_), MAGIC))


class ShardReader:
    """Reads the footer, the index and the Bloom filter once, and blocks as they are asked for."""

    def __init__(self, path: str):
        import pyarrow.fs as fs

        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        end = self.file.size()
        f = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        if f[-1] != MAGIC:
            raise ValueError(f"{path} is no shard")
        index, self.bloom = self.file.read_at(f[1], f[0]), self.file.read_at(f[3], f[2])
        if zlib.crc32(index + self.bloom) != f[9]:
            raise ValueError(f"{path}: its index is damaged")
        self.docs, self.ids, self.bits, self.hashes, self.width = f[4:9]
        self.firsts, self.places, i = [], [], 0
        while i < len(index):
            n, i = read_varint(index, i)
            self.firsts.append(index[i : i + n])
            self.places.append(INDEX.unpack_from(index, i + n))
            i += n + INDEX.size

    def block(self, k: int):
        """(key, value) of a block's entries."""
        import zstandard

        at, length, entries, _ = self.places[k]
        raw = self.file.read_at(length + 4, at)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block is damaged")
        b, i, last = zstandard.ZstdDecompressor().decompress(raw[:-4]), 0, b""
        for _ in range(entries):
            shared, i = read_varint(b, i)
            rest, i = read_varint(b, i)
            n, i = read_varint(b, i)
            last = last[:shared] + b[i : i + rest]
            yield last, b[i + rest : i + rest + n]
            i += rest + n

    def entries(self):
        for k in range(len(self.places)):
            yield from self.block(k)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of all documents under a key: Bloom filter, then bisection of the sparse index."""
        if any(not self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in bloom_places(key, self.bits, self.hashes)):
            return []
        out = []
        for k in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            out += [np.frombuffer(v, "<u2" if self.width == 2 else "<u4") for x, v in self.block(k) if x == key]
        return out


class Shard(NamedTuple):
    number: int
    path: str
    docs: int
    ids: int
    low: bytes
    high: bytes


def write(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE_BYTES) -> list[Shard]:
    """Writes docs as shards under path and returns the manifest, a row for each shard. The texts move once; their ids never return to Spark."""
    name = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    if dict(rows.dtypes)["id"] not in ("string", "tinyint", "smallint", "int", "bigint"):
        raise ValueError("identifiers must be integers or strings")
    placed = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def work(batches):
        import pyarrow as pa
        import pyarrow.fs as fs
        from pyspark import TaskContext

        e, number = encoder(name, cache_bytes), TaskContext.get().partitionId()
        end = struct.pack("<H" if e.width == 2 else "<I", end_id)
        system, folder = fs.FileSystem.from_uri(path)
        writer = stream = part = None
        for batch in batches:
            # Asked for again, so that the cache counts as used.
            e = encoder(name, cache_bytes)
            ids, texts = batch.column(0).to_pylist(), texts_of(batch)
            for a, b in chunks([len(t or b"") for t in texts], 1 << 20):
                for key, value in zip(ids[a:b], e.encode(texts[a:b]), strict=True):
                    if writer is None:
                        system.create_dir(folder, recursive=True)
                        part = f"{folder}/.part-{number:06d}-{uuid.uuid4().hex}"
                        stream = system.open_output_stream(part)
                        writer = ShardWriter(stream, e.width)
                    writer.add(key_of(key), value + end)
        if writer is not None:
            writer.close()
            stream.close()
            system.move(part, f"{folder}/shard-{number:06d}.sst")
            row = Shard(number, f"{path}/shard-{number:06d}.sst", writer.docs, writer.ids, writer.low, writer.high)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row[:4]] + [pa.array([x], pa.binary()) for x in row[4:]], names=list(Shard._fields))

    found = map_arrow(placed, work, "number long, path string, docs long, ids long, low binary, high binary", ("encoder", name, cache_bytes)).collect()
    shards = sorted(Shard(r.number, r.path, r.docs, r.ids, bytes(r.low), bytes(r.high)) for r in found)
    finish(path, shards)
    return shards


def finish(path: str, shards: list[Shard]) -> None:
    """Removes what lost attempts left and writes the manifest, last and by rename: where there is one, the tables are whole."""
    import pyarrow.fs as fs

    system, folder = fs.FileSystem.from_uri(path)
    system.create_dir(folder, recursive=True)
    for f in system.get_file_info(fs.FileSelector(folder)):
        if f.base_name.startswith(".part-"):
            system.delete_file(f.path)
    rows = [s._asdict() | {"path": s.path.rsplit("/", 1)[1], "low": s.low.hex(), "high": s.high.hex()} for s in shards]
    part = f"{folder}/.part-manifest-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(json.dumps(rows).encode())
    system.move(part, f"{folder}/manifest.json")


def manifest(path: str) -> list[Shard]:
    """The shards of tables that are on disk."""
    import pyarrow.fs as fs

    system, folder = fs.FileSystem.from_uri(path)
    with system.open_input_file(f"{folder}/manifest.json") as f:
        rows = json.loads(f.read())
    return [Shard(**r | {"path": f"{path}/{r['path']}", "low": bytes.fromhex(r["low"]), "high": bytes.fromhex(r["high"])}) for r in rows]


def read(spark: SparkSession, shards: list[Shard], *, with_ids: bool = True, id_type: str = "long") -> DataFrame:
    """One row for each document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32 and ids."""
    rows, before = [], 0
    for s in sorted(shards):
        rows.append((s.path, before))
        before += s.ids
    schema = f"id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    listed = spark.createDataFrame(rows, "path string, before long")
    if len(rows) > 1:
        listed = listed.repartition(min(len(rows), 4096))

    def work(batches):
        import pyarrow as pa

        kind = pa.string() if id_type == "string" else pa.int64()
        for batch in batches:
            for path, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out: list[tuple] = []
                reader = ShardReader(path)
                for key, value in reader.entries():
                    ids = np.frombuffer(value, "<u2" if reader.width == 2 else "<u4")
                    out.append((identifier_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.tolist() if with_ids else None))
                    at += len(ids)
                    if len(out) >= 2000:
                        yield rows_of(out, kind, with_ids)
                        out = []
                yield rows_of(out, kind, with_ids)

    def rows_of(out, kind, with_ids):
        import pyarrow as pa

        columns = list(zip(*out, strict=True)) if out else [()] * 5
        arrays = [pa.array(columns[0], kind)] + [pa.array(c, pa.int64()) for c in columns[1:4]]
        names = ["id", "start", "n_tokens", "ids_crc32"]
        if with_ids:
            arrays, names = [*arrays, pa.array(columns[4], pa.list_(pa.int64()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return map_arrow(listed, work, schema)


def lookup(shards: list[Shard], identifier: int | str | None) -> list[np.ndarray]:
    """The ids of the documents with this identifier: manifest, Bloom filter, index, one block."""
    key = key_of(identifier)
    return [x for s in sorted(shards) if s.low <= key <= s.high for x in ShardReader(s.path).get(key)]


def written(docs: DataFrame, **options) -> DataFrame:
    """Writes docs to the shared folder and reads the digest of each back from the files."""
    spark = docs.sparkSession
    shards = write(docs, scratch_path(spark, "token-tables"), **options)
    id_type = "string" if dict(docs.dtypes)[options.get("id_col", "doc_id")] == "string" else "long"
    return read(spark, shards, with_ids=False, id_type=id_type).withColumnRenamed("id", options.get("id_col", "doc_id"))


def op4(spark, sf_dir) -> DataFrame:
    return written(spark.read.parquet(f"{sf_dir}/documents.parquet"))
