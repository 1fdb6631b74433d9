"""Token ids in binary files: every document a zstandard frame of its own under one shared dictionary, found by an offset index.

A file holds a header (MAGIC, SHA-256 of the dictionary, bytes an id), the frames in ascending order of ids, then the index: a
(doc_id, offset, ids) triple of 64-bit integers for each document, and last the index's place and MAGIC again. The dictionary lies
beside the files under the name of its hash.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paysift.llm.common import LAST_ID, new_path, ordered_id, pieces, raw_texts, write_table
from paysift.llm.warc import _filesystem

MAGIC = b"PSTOKEN1"
DICTIONARY_BYTES = 112_640
#: The dictionary is trained on so many documents at most, and so many ids of each.
SAMPLE_DOCS, SAMPLE_IDS = 2048, 4096
#: A worker remembers the ids of so many words at most.
CACHED_WORDS = 1 << 20
#: What may follow the last letter of a word.
_STOPS = (b".", b",")
_HEAD, _TAIL = "<8s32sB", "<QQ8s"
_FILES = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_READ_TYPES = "doc_id long, start long, n_tokens long, ids binary"


@dataclass(frozen=True)
class Encoding:
    """A tokenizer as its file's text, the id that ends a document, and whether it can be applied word by word.

    by_words is right only for tokenizers that lower-case, drop white space and cut between letters and punctuation, with nothing
    reaching across a cut and words of a-z left whole to the merges; then a worker encodes a word between ASCII white space once, and knows it again in capitals or
    before a full stop or comma. Others encode the whole text.
    """

    tokenizer: str
    end_id: int
    by_words: bool = False
    special_tokens_are_text: bool = False

    @classmethod
    def from_file(cls, path: str, end_id: int, **options: bool) -> Encoding:
        return cls(Path(path).read_text(encoding="utf-8"), end_id, **options)


class _Encoder:
    """Serialized ids of texts: little-endian, two bytes an id where the vocabulary allows, else four."""

    def __init__(self, encoding: Encoding) -> None:
        self.tokenizer = Tokenizer.from_str(encoding.tokenizer)
        self.tokenizer.encode_special_tokens = encoding.special_tokens_are_text
        most = max(self.tokenizer.get_vocab_size(), encoding.end_id + 1)
        self.kind = np.dtype("<u2" if most <= 1 << 16 else "<u4")
        self.end = np.array([encoding.end_id], self.kind).tobytes()
        self.by_words, self.known = encoding.by_words, {}
        if self.by_words:
            (self.between,) = self.tokenizer.encode("\x7f", add_special_tokens=False).ids
            self.model, self.serial = self.tokenizer.model, [i.to_bytes(self.kind.itemsize, "little") for i in range(most)]

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Encodes words of a-z by the merges alone, and the others in one text, with a character between them that is one id and in none of them."""
        known, tokenize, serial = self.known, self.model.tokenize, self.serial
        others = []
        for w in words:
            if w.isalpha():
                known[w] = b"".join([serial[t.id] for t in tokenize(w.decode())])
            else:
                others.append(w)
        words = others
        text = b" \x7f ".join([*words, b""])
        if b"<|" in text or text.count(b"\x7f") > len(words):  # the string of a special token, or the character, in a word
            apart = [w for w in words if b"<|" in w or b"\x7f" in w]
            known.update(zip(apart, self._bytes([w.decode() for w in apart])))
            words = [w for w in words if b"<|" not in w and b"\x7f" not in w]
            text = b" \x7f ".join([*words, b""])
        if not words:
            return
        (encoded,) = self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)
        ids = np.array(encoded.ids, self.kind)
        ends = (np.flatnonzero(ids == self.between) * self.kind.itemsize).tolist()
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not keep words apart")
        raw, at = ids.tobytes(), 0
        for word, end in zip(words, ends):
            known[word] = raw[at:end]
            at = end + self.kind.itemsize

    def _words(self, words: list[bytes]) -> bytes:
        known = self.known
        missing = set(words).difference(known)
        if missing:
            if len(known) + 2 * len(missing) > CACHED_WORDS:
                known.clear()
                missing = set(words)
            fresh, derived = [], []
            for w in missing:
                plain = w.lower()  # ASCII letters only
                if plain.endswith(_STOPS) and plain[-2:-1].isalpha() and b"<|" not in w:
                    derived.append((w, plain[:-1], plain[-1:]))
                elif plain != w and b"<|" not in w:
                    derived.append((w, plain, b""))
                else:
                    fresh.append(w)
            if derived:
                parts = {core for _, core, _ in derived}.union({stop for _, _, stop in derived if stop})
                fresh += parts.difference(known, fresh)
            self._learn(fresh)
            for w, core, stop in derived:
                known[w] = known[core] + known[stop] if stop else known[core]
        return b"".join(map(known.__getitem__, words))

    def document(self, raw: bytes) -> bytes:
        """The ids of a text and the id that ends it."""
        body = b"".join([self._words(piece.split()) for piece in pieces(raw)]) if self.by_words else self._bytes([raw.decode()])[0]
        return body + self.end


@lru_cache(maxsize=2)
def _encoder(encoding: Encoding) -> _Encoder:
    return _Encoder(encoding)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(ordered_id(id_col).alias("_did"), F.xxhash64(text).alias("_key"), text.alias("_text"))


def train_dictionary(docs: DataFrame, encoding: Encoding, size: int = DICTIONARY_BYTES, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A zstandard dictionary of at most size bytes from serialized ids of documents drawn by hash, SAMPLE_DOCS of them at most.

    Repeated rows are drawn once. Where there is too little to train on, the ids themselves are the dictionary; it is
    empty if there are none.
    """
    share = min(1.0, 2 * SAMPLE_DOCS / max(1, docs.count()))
    draw = F.shiftrightunsigned(F.xxhash64("_did", "_key", F.lit(12)), 11)
    drawn = _rows(docs, id_col, text_col).withColumn("_draw", draw).where(F.col("_draw") <= int(share * 2**53))
    kept = drawn.dropDuplicates(["_did", "_key"]).orderBy("_draw", "_did").limit(SAMPLE_DOCS)
    given = docs.sparkSession.sparkContext.broadcast(encoding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(given.value)
        for batch in batches:
            ids = [encoder.document(raw)[: SAMPLE_IDS * encoder.kind.itemsize] for raw in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["draw", "ids"])

    found = kept.select("_draw", "_text").mapInArrow(run, "draw long, ids binary").orderBy("draw", "ids").toArrow()
    samples = found.column("ids").to_pylist()
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes, level: int | None = None) -> zstandard.ZstdCompressionDict | None:
    """The dictionary; for a level its tables are built once and not for each document."""
    found = zstandard.ZstdCompressionDict(raw) if raw else None
    if found and level is not None:
        found.precompute_compress(level=level)
    return found


def write_tokens(docs: DataFrame, encoding: Encoding, path: str | None = None, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of every text to path (a new folder of the shared one by default) and lists the files.

    Columns shard, path, docs, tokens, first_id, last_id, and start: the ids in all files before. Documents are dealt to files by
    ranges of ids, null ids last; documents of one id follow each other in the order of a hash of their texts, so
    rows that share an id may lie in several files. Null and empty texts are the end id alone. Repeated rows are written as
    often as they come. Other columns are ignored; no rows give no files. A task streams its documents into one file and holds one
    of them, and the index. A file's name has the task attempt's id: of repeated attempts only the one whose row is kept is listed.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    raw = train_dictionary(docs, encoding, id_col=id_col, text_col=text_col)
    digest = hashlib.sha256(raw)
    system, where = _filesystem(path)
    system.create_dir(where, recursive=True)
    with system.open_output_stream(f"{where}/dictionary-{digest.hexdigest()}", compression=None) as out:
        out.write(raw)
    given, shared, head = spark.sparkContext.broadcast(encoding), spark.sparkContext.broadcast(raw), digest.digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = _encoder(given.value), None
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(shared.value, level), write_checksum=False, write_dict_id=False)
        index: list[int] = []
        for batch in batches:
            for did, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                if out is None:
                    task = TaskContext.get()
                    name = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.tok"
                    system, where = _filesystem(name)
                    out = system.open_output_stream(where, compression=None)
                    out.write(struct.pack(_HEAD, MAGIC, head, encoder.kind.itemsize))
                    at = struct.calcsize(_HEAD)
                ids = encoder.document(raw)
                frame = squeeze.compress(ids)
                out.write(frame)
                index += did, at, len(ids) // encoder.kind.itemsize
                at += len(frame)
        if out is not None:
            table = np.array(index, "<i8").reshape(-1, 3)
            out.write(table.tobytes())
            out.write(struct.pack(_TAIL, at, len(table), MAGIC))
            out.close()
            row = (task.partitionId(), name, len(table), int(table[:, 2].sum()), int(table[0, 0]), int(table[-1, 0]))
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _FILES)], schema=_FILES)

    # The row's number splits equal rows over ranges; what lies where among equal rows does not matter.
    dealt = _rows(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("_did", "_key", "_row")
    ordered = dealt.sortWithinPartitions("_did", "_key").select("_did", "_text")
    files = write_table(ordered.mapInArrow(run, "shard long, path string, docs long, tokens long, first_id long, last_id long"), "token-files")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


class _File:
    """A file of documents, read by its index."""

    def __init__(self, path: str) -> None:
        system, where = _filesystem(path)
        self.stream = system.open_input_file(where)
        size = self.stream.size()
        magic, digest, width = struct.unpack(_HEAD, self._read(0, struct.calcsize(_HEAD)))
        at, docs, again = struct.unpack(_TAIL, self._read(size - struct.calcsize(_TAIL), struct.calcsize(_TAIL)))
        if magic != MAGIC or again != MAGIC:
            raise ValueError(f"{path} is no whole file of token ids")
        index = np.frombuffer(self._read(at, docs * 24), "<i8").reshape(-1, 3)
        self.ids, self.counts, self.bounds = index[:, 0], index[:, 2], np.append(index[:, 1], at)
        self.kind = np.dtype(f"<u{width}")
        with system.open_input_stream(f"{where.rpartition('/')[0]}/dictionary-{digest.hex()}", compression=None) as source:
            raw = source.read()
        if hashlib.sha256(raw).digest() != digest:
            raise ValueError(f"the dictionary of {path} is not the one it was written with")
        self.open = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))

    def _read(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def documents(self, places: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(place, serialized ids) of the documents at places, in order; neighbours are read together, about 4 MB at a time."""
        at = 0
        while at < len(places):
            stop = at + 1
            while stop < len(places) and places[stop] == places[stop - 1] + 1 and self.bounds[places[stop] + 1] - self.bounds[places[at]] <= 1 << 22:
                stop += 1
            low = int(self.bounds[places[at]])
            data = memoryview(self._read(low, int(self.bounds[places[stop - 1] + 1]) - low))
            for p in places[at:stop].tolist():
                ids = self.open.decompress(data[int(self.bounds[p]) - low : int(self.bounds[p + 1]) - low])
                if len(ids) != self.counts[p] * self.kind.itemsize:
                    raise ValueError(f"document {p} of the file does not have the ids that its index counts")
                yield p, ids
            at = stop


def read_tokens(files: DataFrame, doc_ids: Iterable[int | None] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files that columns path and start list, or of those with the
    given ids, a short list.

    start counts the ids of all documents before it; ids are little-endian unsigned 32-bit integers, the end id included. Every
    file is a task of its own. For given ids only files whose range has one are opened, and of them the index and the documents'
    own frames are read.
    """
    wanted = None if doc_ids is None else sorted({LAST_ID if i is None else i for i in doc_ids})
    if wanted is not None:
        files = files.where(F.exists(F.lit(wanted).cast("array<long>"), lambda i: i.between(F.col("first_id"), F.col("last_id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = _File(path)
                before = start + np.cumsum(file.counts) - file.counts
                places = np.arange(len(file.ids)) if wanted is None else np.flatnonzero(np.isin(file.ids, wanted))
                held, size = [], 0
                for p, ids in file.documents(places):
                    held.append((p, ids if file.kind.itemsize == 4 else np.frombuffer(ids, file.kind).astype("<u4").tobytes()))
                    size += len(held[-1][1])
                    if size > 1 << 22 or len(held) >= 4096:
                        yield rows(file, before, held)
                        held, size = [], 0
                if held:
                    yield rows(file, before, held)

    def rows(file: _File, before: np.ndarray, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        at = np.array([p for p, _ in held])
        ids = pa.array(file.ids[at], pa.int64(), mask=file.ids[at] == LAST_ID)
        return pa.RecordBatch.from_arrays([ids, pa.array(before[at]), pa.array(file.counts[at]), pa.array([x for _, x in held], pa.binary())], schema=_READ)

    return files.select("path", "start").repartition(max(1, files.count())).mapInArrow(run, _READ_TYPES)
