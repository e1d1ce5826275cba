"""Token ids in seekable Zstandard shards.

Documents are dealt into ranges of doc_id, sorted, encoded and written, each range to one shard:
frames of whole documents' ids (little-endian, 16 bits wide where the vocabulary allows it), then an
index (per document: doc_id, frame, ids) and the seek table. A reader takes one document by its
frame alone. The start of a document among all ids is its shard's start, a prefix sum over one row a
shard, plus what precedes it in the shard.

Byte-level vocabularies are encoded piece by piece: their pre-tokenizer always begins a new token at
a space between other characters, so the pieces between single spaces have ids of their own, and the
library is asked for those that are not remembered, many at once: of their ids, those whose token
begins with a space begin a piece. Texts with a space between white space or at the end, and other
vocabularies, are encoded as a whole.

Defined results: null and empty texts have the end id only; rows follow doc_id, then text, null ids
last; rows that repeat a doc_id are documents of their own; strings of special tokens in a text are
encoded as the tokenizer file says; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import seekable
from .common import partitions, released, table, text_batches, work_path

#: Ids a frame holds at least, unless the shard ends.
FRAME_IDS = 1 << 18
#: Bytes of pieces and their ids that a worker remembers before it forgets those it has not met since it last forgot some.
REMEMBERED = 32 << 20
#: What Python itself takes for a piece that is remembered, about; and the longest piece that is.
PIECE_BYTES, LONGEST = 140, 64
#: Characters that go to the library at once.
BATCH_CHARS = 1 << 20
END_ID = 2
#: A piece that begins with white space, as Python tells it.
_BLANK = r"^[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_HEAD = struct.Struct("<BQ")
#: Bytes of texts that are encoded together.
GROUP_BYTES = 1 << 22
#: Bytes of texts a shard holds on average, at most.
SHARD_BYTES = 1 << 26
#: Rows that leave a reader at once.
READ_ROWS = 1 << 16


def vocabulary() -> str:
    """Path of the default tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Texts to ids with the tokenizers library, as bytes of ``dtype``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.lib.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        told = json.loads(self.lib.to_str())
        pre = told.get("pre_tokenizer") or {}
        model = told.get("model") or {}
        self.by_piece = not told.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not model.get("dropout") and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in told.get("added_tokens", []))
        self.forget()
        self.marks = dict(zip(",.", (x.tobytes() for x in self._library([",", "."]))))
        self.starts = np.array([(t or "").startswith("\u0120") for t in map(self.lib.id_to_token, range(self.lib.get_vocab_size()))])

    def forget(self) -> None:
        """Forget all pieces."""
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        out, i = [], 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j]) <= BATCH_CHARS):
                chars += len(texts[j])
                j += 1
            out += [np.array(e.ids, self.dtype) for e in self.lib.encode_batch_fast(texts[i:j], add_special_tokens=False)]
            i = j
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Remember pieces, each encoded as it stands after a space.

        A comma or full stop after a letter or digit is a token sequence of its own, so only what
        stands before it is asked for.
        """
        known, marks = self.known, self.marks
        marked = [x for x in pieces if x[-1] in ",." and x[-2:-1].isalnum() and x[-2].isascii()]
        asked = pieces.difference(marked)
        asked.update([x[:-1] for x in marked])
        pieces = list(asked.difference(known))
        for i in range(0, len(pieces), 200):
            part = pieces[i : i + 200]
            ids = self._library([" " + " ".join(part)])[0]
            at = np.nonzero(self.starts[ids])[0]
            if len(at) != len(part) or (len(at) and at[0]):
                self.known.update(zip(part, (x.tobytes() for x in self._library([f" {x}" for x in part]))))
                continue
            width = self.dtype.itemsize
            raw, cuts = ids.tobytes(), [*(at * width).tolist(), len(ids) * width]
            self.known.update(zip(part, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        known.update([(x, known[x[:-1]] + marks[x[-1]]) for x in marked])

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each as it stands after a space."""
        if self.held > REMEMBERED:
            self.known, self.older, self.held = {}, self.known, 0
        known, older = self.known, self.older
        new = set(pieces).difference(known)
        before = len(known)
        if older:
            kept = [x for x in new if x in older]
            known.update(zip(kept, map(older.__getitem__, kept)))
            new.difference_update(kept)
        self._learn(new)
        out = list(map(known.__getitem__, pieces))
        for x in [x for x in new if len(x) > LONGEST]:
            known.pop(x, None)
            known.pop(x[:-1], None)
        self.held += (len(known) - before) * PIECE_BYTES
        return out

    def encode(self, texts: pa.StringArray, end_id: int | None = None) -> list[bytes]:
        """Ids of each text, with an end id if one is given.

        Texts are split and their pieces numbered by Arrow; Python sees each distinct piece once, and
        the ids of all texts are gathered by numpy.
        """
        end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        n = len(texts)
        whole = np.ones(n, bool)
        out: list[bytes] = [b""] * n
        if self.by_piece:
            whole = pc.or_(pc.match_substring(texts, "  "), pc.ends_with(texts, " ")).to_numpy(zero_copy_only=False).astype(bool)
        for _ in range(2):
            plain = np.nonzero(~whole)[0]
            if not len(plain):
                break
            lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            offsets = offsets - offsets[0]
            numbered = flat.dictionary_encode()
            words = numbered.dictionary
            pieces, at = words.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy().copy()
            blank = np.nonzero(pc.match_substring_regex(words, _BLANK).to_numpy(zero_copy_only=False))[0]
            if len(blank):  # a space before other white space need not begin a token: such texts go to the library
                hit = np.unique(np.searchsorted(offsets, np.nonzero(np.isin(at, blank))[0], side="right") - 1)
                whole[plain[hit]] = True
                continue
            heads = self._library(pc.list_element(lists, 0).to_pylist())
            at[offsets[:-1]] = len(pieces) + np.arange(len(plain))
            later = self._pieces([x or "x" for x in pieces])  # an empty piece can only be a text's first
            parts = later + [h.tobytes() for h in heads]
            size = np.fromiter(map(len, parts), np.int32, len(parts)) // self.dtype.itemsize
            start = np.concatenate(([0], np.cumsum(size)))[:-1]
            pool = np.frombuffer(b"".join(parts), self.dtype)
            each = size[at]
            ends = np.cumsum(each)
            ids = pool[np.repeat((start[at] - (ends - each)).astype(np.int32), each) + np.arange(ends[-1], dtype=np.int32)]
            raw, cuts = ids.tobytes(), np.concatenate(([0], ends))[offsets] * self.dtype.itemsize
            for k, a, b in zip(plain.tolist(), cuts.tolist(), cuts[1:].tolist()):
                out[k] = raw[a:b] + end
            break
        rest = np.nonzero(whole)[0].tolist()
        for k, ids in zip(rest, self._library([texts[k].as_py() for k in rest])):
            out[k] = ids.tobytes() + end
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Forget what this process's encoders remember of texts."""
    for e in _encoders.values():
        e.forget()


class ShardWriter:
    """Documents' ids into one shard, in the order given."""

    def __init__(self, uri: str, dtype: np.dtype):
        self.out, self.dtype = seekable.Writer(uri, level=1), dtype
        self.held: list[bytes] = []
        self.n_held = 0
        #: doc_id, whether it is null, frame and number of ids of each document.
        self.index = (array("q"), array("B"), array("I"), array("Q"))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        for column, value in zip(self.index, (doc_id or 0, doc_id is None, len(self.out.entries), n)):
            column.append(value)
        self.held.append(ids)
        self.n_held += n
        if self.n_held >= FRAME_IDS:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.out.frame(b"".join(self.held))
            self.held, self.n_held = [], 0

    def close(self) -> tuple[int, int]:
        self._flush()
        n = len(self.index[0])
        body = b"".join(np.asarray(c).astype(t).tobytes() for c, t in zip(self.index, ("<i8", "u1", "<u4", "<u8")))
        self.out.close(_HEAD.pack(self.dtype.itemsize, n) + body)
        return n, sum(self.index[3])


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, uri: str):
        self.file = seekable.Reader(uri)
        raw = self.file.index()
        width, n = _HEAD.unpack_from(raw)
        self.dtype = np.dtype(f"<u{width}")
        at, cols = _HEAD.size, []
        for t in ("<i8", "u1", "<u4", "<u8"):
            cols.append(np.frombuffer(raw, t, n, at))
            at += cols[-1].nbytes
        self.doc_ids, self.nulls, self.frames, self.lengths = cols
        self.starts = np.concatenate(([0], np.cumsum(self.lengths))).astype(np.int64)
        change = np.concatenate(([True], self.frames[1:] != self.frames[:-1])) if n else np.zeros(0, bool)
        self.frame_start = self.starts[:-1][change][np.cumsum(change) - 1] if n else self.starts[:0]

    def ids(self, i: int, frame: bytes | None = None) -> np.ndarray:
        """The ids of the i-th document; decompresses its frame only."""
        data = self.file.frame(int(self.frames[i])) if frame is None else frame
        a = int(self.starts[i] - self.frame_start[i])
        return np.frombuffer(data, self.dtype, int(self.lengths[i]), a * self.dtype.itemsize)

    def find(self, doc_id: int) -> list[np.ndarray]:
        return [self.ids(int(i)) for i in np.nonzero((self.doc_ids == doc_id) & (self.nulls == 0))[0]]

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start in the shard, ids; each frame is decompressed once."""
        at, data = -1, b""
        for i in range(len(self.doc_ids)):
            if self.frames[i] != at:
                at, data = int(self.frames[i]), self.file.frame(int(self.frames[i]))
            yield None if self.nulls[i] else int(self.doc_ids[i]), int(self.starts[i]), self.ids(i, data)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about GROUP_BYTES of texts, or of one longer text."""
    held, size = [], 0
    for b in batches:
        at = 0
        for i, n in enumerate(pc.binary_length(b.column("text")).to_pylist()):
            size += n
            if size >= GROUP_BYTES:
                held.append(b.slice(at, i + 1 - at))
                yield pa.concat_batches(held)
                held, size, at = [], 0, i + 1
        if at < b.num_rows:
            held.append(b.slice(at))
    if held:
        yield pa.concat_batches(held)


def write_shards(docs: DataFrame, folder: str, path: str | None = None, shards: int | None = None, end_id: int = END_ID) -> list[dict]:
    """Write ``docs`` as shards into ``folder``. Returns a manifest, one entry a shard in order: path, n_docs, n_tokens, start.

    There are as many shards as shuffle partitions, and more where one would hold over SHARD_BYTES of text.
    """
    path = path or vocabulary()
    text_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out = encoder(path), None
        part = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{part:06d}.zst"
        try:
            for b in _groups(batches):
                out = out or ShardWriter(uri, enc.dtype)
                for d, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text"), end_id)):
                    out.add(d, ids)
        except BaseException:
            if out:
                out.out.abandon()
            raise
        if out:
            n, tokens = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([uri]), pa.array([n], pa.int64()), pa.array([tokens], pa.int64())], ["part", "path", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc()]
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        shards = max(partitions(docs.sparkSession), -(-size // SHARD_BYTES))
    dealt = rows.repartitionByRange(shards, order[0]).sortWithinPartitions(*order)
    found = dealt.mapInArrow(released(write, forget), "part int, path string, n_docs long, n_tokens long").collect()  # one row a shard
    manifest, start = [], 0
    for r in sorted(found, key=lambda r: r["part"]):
        manifest.append({"path": r["path"], "n_docs": r["n_docs"], "n_tokens": r["n_tokens"], "start": start})
        start += r["n_tokens"]
    return manifest


def read_shards(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                rows = ((d, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, at, ids in ShardReader(uri))
                while part := list(islice(rows, READ_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], schema=schema)

    files = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start long")
    return files.repartition(max(1, len(manifest))).mapInArrow(released(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "tokens")
    return read_shards(spark, write_shards(table(spark, sf_dir, "documents"), folder))
