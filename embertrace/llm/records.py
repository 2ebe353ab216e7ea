"""Token ids of documents in length-delimited binary records with an index beside them.

A record is its length (unsigned 64 bits), the masked checksum of those eight bytes, the payload
and the masked checksum of the payload, all little-endian.  The checksum is zlib's crc32, rotated
by 15 bits and shifted by a constant so that checksums of checksums stay useful.  The payload is
the ids as 16 or 32 bits, whichever the vocabulary needs.  The index of a file has an entry of
fixed size per record (id, offset, length, tokens), so that readers can jump to any record in any
order.

Tasks write files under names of their own attempt through the file system of the folder's URI;
only the files named by finished tasks count, so lost and repeated tasks leave no duplicates.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace.llm.shingles import _BACK, _BASE, _power, mixed
from embertrace.session import scratch_path, ship_package

INDEX = np.dtype([("has_id", "<u1"), ("id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("tokens", "<u8")])
_MASK = 0xA282EAD8


@dataclass(frozen=True)
class Coding:
    """``tokenizer`` is the file of a byte-level BPE; ``memo`` bounds the words a worker keeps encoded, about 40 bytes each."""

    tokenizer: str
    end_id: int = 2
    memo: int = 2_000_000
    batch: int = 256


@dataclass(frozen=True)
class RecordFile:
    number: int
    path: str
    index: str
    records: int
    tokens: int
    width: int


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def unframed(read) -> bytes:
    """The next payload of ``read(n)``; raises if a checksum differs."""
    head = read(12)
    (size,), (crc,) = struct.unpack("<Q", head[:8]), struct.unpack("<I", head[8:])
    if masked_crc(head[:8]) != crc:
        raise ValueError("the length of a record is damaged")
    body = read(size + 4)
    if len(body) != size + 4 or masked_crc(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
        raise ValueError("the content of a record is damaged")
    return body[:-4]


#: Values of bytes for the hashes of words.
_VALUES = np.random.default_rng(41).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Longer texts are taken in parts of about this many bytes, cut before a word.
_PART = 1 << 21


class WordEncoder:
    """Encodes texts with a ``tokenizers`` model, remembering words.

    The model splits text before a single space or around a single line break between other
    characters, so the ids of a text are those of its words in turn.  Texts with any other white
    space between words, and texts that hold a special token, are given to the model whole.

    All words of a batch are hashed at once (64 bits of hash and the length stand for a word), the
    distinct ones looked up in sorted arrays, and their ids gathered by offsets.
    """

    def __init__(self, coding: Coding):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(coding.tokenizer)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.coding = coding
        self.end = np.array([coding.end_id], self.kind).tobytes()
        self.break_id = self.model.encode("\n", add_special_tokens=False).ids[0]
        self._forget()

    def _forget(self) -> None:
        self.words = np.empty(0, np.uint64)
        self.starts, self.counts = np.empty(0, np.int64), np.empty(0, np.int32)
        self.ids = np.empty(0, self.kind)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, words: list[str], heads: np.ndarray) -> None:
        """Remember the ids of new words: those at the start of a line as they are, the others behind a space.

        What is no single word gets the count -1.
        """
        counts = np.full(len(words), -1, np.int32)
        starts = np.zeros(len(words), np.int64)
        parts, at = [self.ids], len(self.ids)
        for head, before in ((True, ""), (False, " ")):
            plain = [k for k in np.flatnonzero(heads == head) if words[k].split() == [words[k]]]
            runs = [plain[k : k + 512] for k in range(0, len(plain), 512)]
            # A line break between words is a token of its own and occurs in none of them.
            for run, ids in zip(runs, self._encoded(["\n".join([before + words[k] for k in run]) for run in runs])):
                breaks = np.flatnonzero(ids == self.break_id)
                ends = np.append(breaks, len(ids))
                first = np.concatenate([[0], breaks + 1])
                starts[run], counts[run] = at + first, ends - first
                parts.append(ids)
                at += len(ids)
        self.ids = np.concatenate(parts)
        place = np.searchsorted(self.words, hashes)
        self.words = np.insert(self.words, place, hashes)
        self.starts, self.counts = np.insert(self.starts, place, starts), np.insert(self.counts, place, counts)

    def _known(self, raw: bytes, data: np.ndarray, begin: np.ndarray, n: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """The place of each word among the remembered ones; new words are learnt."""
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * _power(_BASE, len(data)), out=sums[1:])
        own = mixed((sums[begin + n] - sums[begin]) * _power(_BACK, len(data) + 1)[begin])
        own = mixed(own + n.astype(np.uint64) * _VALUES[7] + heads * _VALUES[9])
        distinct, inverse = np.unique(own, return_inverse=True)
        if len(self.words) + len(distinct) > self.coding.memo:
            self._forget()
        new = np.ones(len(distinct), bool)
        if len(self.words):
            new = self.words[np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)] != distinct
        if new.any():
            some = np.empty(len(distinct), np.int64)
            some[inverse] = np.arange(len(own))
            some = some[new]
            self._learn(distinct[new], [raw[a : a + k].decode("utf-8", "surrogatepass") for a, k in zip(begin[some].tolist(), n[some].tolist())], heads[some])
        return np.searchsorted(self.words, distinct)[inverse]

    def _batch(self, parts: list[tuple[bytes, bytes]]) -> list[bytes | None]:
        """Packed ids of parts, each with what stands before it (nothing, a space, a line break); None for one that is not plain."""
        raw = b"".join([(before or b"\n") + part for before, part in parts])
        data = np.frombuffer(raw, np.uint8)
        sizes = np.array([len(part) + 1 for _, part in parts])
        separators = np.flatnonzero((data == 10) | (data == 32))
        first = np.searchsorted(separators, np.cumsum(sizes) - sizes)
        owner = np.repeat(np.arange(len(parts)), np.diff(np.append(first, len(separators))))
        begin = separators + 1
        n = np.append(separators[1:], len(data)) - begin
        heads = data[separators] == 10
        breaks = heads.copy()
        breaks[first] = [before == b"\n" for before, _ in parts]
        blank = n == 0
        whole = (sizes == 1) & np.array([not before for before, _ in parts])  # an empty text is plain
        odd = np.zeros(len(parts), bool)
        odd[owner[blank]] = True
        odd &= ~whole
        at, counts = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        full = np.flatnonzero(~blank)
        if len(full):
            at[full] = self._known(raw, data, begin[full], n[full], heads[full])
            counts[full] = self.counts[at[full]]
        odd[owner[counts < 0]] = True
        counts[odd[owner]] = 0
        breaks &= ~odd[owner]
        total = counts + breaks
        ends = np.cumsum(total)
        out = np.empty(ends[-1], self.kind)
        out[(ends - total)[breaks]] = self.break_id
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        if len(inside):
            out[np.repeat(ends - counts, counts) + inside] = self.ids[np.repeat(self.starts[at], counts) + inside]
        bounds = np.concatenate([[0], ends])[np.append(first, len(n))]
        return [None if odd[k] else out[bounds[k] : bounds[k + 1]].tobytes() for k in range(len(parts))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, with the end id."""
        found: list[list[bytes | None]] = [[] for _ in texts]
        waiting: list[tuple[int, bytes, bytes]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if waiting:
                for (k, _, _), ids in zip(waiting, self._batch([(b, p) for _, b, p in waiting])):
                    found[k].append(ids)
            waiting.clear()
            held = 0

        for k, text in enumerate(texts):
            if any(s in text for s in self.special):
                found[k].append(None)
                continue
            for before, part in _parts(text.encode("utf-8", "surrogatepass")):
                waiting.append((k, before, part))
                held += len(part)
                if held >= _PART:
                    flush()
        flush()
        rest = [k for k, ids in enumerate(found) if None in ids]
        whole = dict(zip(rest, self._encoded([texts[k] for k in rest]))) if rest else {}
        return [(whole[k].tobytes() if k in whole else b"".join(ids)) + self.end for k, ids in enumerate(found)]


def _parts(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """A text cut before a space or line break into parts of about ``_PART`` bytes, each with that character apart."""
    at, before = 0, b""
    while len(raw) - at > _PART:
        cut = max(raw.rfind(b" ", at, at + _PART), raw.rfind(b"\n", at, at + _PART))
        if cut < 0:
            ends = [x for x in (raw.find(b" ", at + _PART), raw.find(b"\n", at + _PART)) if x >= 0]
            if not ends:
                break
            cut = min(ends)
        yield before, raw[at:cut]
        at, before = cut + 1, raw[cut : cut + 1]
    yield before, raw[at:]


#: Encoders of this worker process, kept from task to task with the words they know.
_ENCODERS: dict[Coding, WordEncoder] = {}


def _encoder(coding: Coding) -> WordEncoder:
    if coding not in _ENCODERS:
        _ENCODERS[coding] = WordEncoder(coding)
    return _ENCODERS[coding]


def write_records(docs: DataFrame, folder: str, coding: Coding, text: str = "text", key: str = "doc_id") -> list[RecordFile]:
    """Writes the texts in ascending key order (nulls first) and returns the files in that order.

    Every row becomes a record, also of a null or empty text (the end id alone) and repeated rows;
    rows of one key are ordered by their text's hash and text.  Keys are integers.  The list has
    an entry per task that had rows: it is small, the tokens never pass through the driver.
    """
    ship_package(docs.sparkSession)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, store, files = None, None, None
        number, entries, at, records, tokens = TaskContext.get().partitionId(), [], 0, 0, 0
        try:
            for batch in batches:
                for k in range(0, batch.num_rows, coding.batch):
                    part = batch.slice(k, coding.batch)
                    if encoder is None:
                        encoder = _encoder(coding)
                        store, root = fs.FileSystem.from_uri(folder)
                        store.create_dir(root, recursive=True)
                        name = f"{root}/part-{number:06d}-{uuid.uuid4().hex}"
                        files = store.open_output_stream(f"{name}.records"), store.open_output_stream(f"{name}.index")
                    payloads = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                    out, rows = [], np.zeros(len(payloads), INDEX)
                    for j, (own, payload) in enumerate(zip(part.column(0).to_pylist(), payloads)):
                        frame = framed(payload)
                        n = len(payload) // encoder.width
                        rows[j] = (own is not None, own or 0, at, len(frame), n)
                        out.append(frame)
                        at += len(frame)
                        tokens += n
                    files[0].write(b"".join(out))
                    files[1].write(rows.tobytes())
                    records += len(payloads)
        finally:
            for f in files or ():
                f.close()
        if records:
            yield pa.RecordBatch.from_pylist(
                [{"number": number, "path": f"{name}.records", "index": f"{name}.index", "records": records, "tokens": tokens, "width": encoder.width}]
            )

    ordered = (
        docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange("id", "h")
        .sortWithinPartitions("id", "h", "text")
        .select("id", "text")
    )
    done = ordered.mapInArrow(write, "number bigint, path string, index string, records bigint, tokens bigint, width bigint").collect()
    return [RecordFile(*r) for r in sorted(done, key=lambda r: r["number"])]


def read_records(spark: SparkSession, folder: str, files: list[RecordFile], seed: int | None = None) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every record, read back and checked.

    ``start`` counts the ids of all records before it.  With a ``seed`` the records of each file
    are read through the index in a shuffled order, else from first to last.
    """
    ship_package(spark)
    rows, start = [], 0
    for f in files:
        rows.append((f.path, f.index, f.width, start))
        start += f.tokens
    table = spark.createDataFrame(rows, "path string, index string, width bigint, start bigint")
    if rows:
        table = table.repartition(len(rows))
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                store, _ = fs.FileSystem.from_uri(folder)
                with store.open_input_stream(f["index"]) as stream:
                    entries = np.frombuffer(stream.read(), INDEX)
                starts = f["start"] + np.concatenate([[0], np.cumsum(entries["tokens"].astype(np.int64))])
                order = np.arange(len(entries))
                if seed is not None:
                    order = np.random.default_rng([seed, zlib.crc32(f["path"].rsplit("-", 1)[0].encode())]).permutation(order)
                with store.open_input_file(f["path"]) if seed is not None else store.open_input_stream(f["path"], buffer_size=1 << 20) as data:
                    for k in range(0, len(order), 4096):
                        out = []
                        for j in order[k : k + 4096]:
                            entry = entries[j]
                            if seed is not None:
                                data.seek(int(entry["offset"]))
                            ids = np.frombuffer(unframed(data.read), f"<u{f['width']}").astype("<u4")
                            if len(ids) != entry["tokens"]:
                                raise ValueError(f"record {j} of {f['path']} does not fit its index")
                            own = int(entry["id"]) if entry["has_id"] else None
                            out.append((own, int(starts[j]), len(ids), zlib.crc32(ids.tobytes())))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return table.mapInArrow(read, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, coding: Coding, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes ``docs`` into a new folder of the shared scratch space and reads the records back."""
    folder = scratch_path(docs.sparkSession, "records")
    return read_records(docs.sparkSession, folder, write_records(docs, folder, coding, text, key))
