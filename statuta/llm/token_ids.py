"""Operator 12: token ids as binary shards, each a wavelet matrix in a compressed file.

Texts are dealt to tasks by ranges of their id, so shards follow ascending ids; each task encodes
its texts and writes shards of bounded size. A shard is one row of a zstd-compressed Parquet
file: bit-planes, their rank directories, and its documents' ids and ends. Readers get whole
documents back, single tokens, counts or occurrences without encoding anything again.
"""

from __future__ import annotations

import functools
import math
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import _written, bounded_broadcast, stage_dir
from .wavelet import WaveletMatrix

TOKENIZER = "byte_bpe_50k.json"
END = 2
#: Planes of a shard: ids are below 2^BITS.
BITS = 16
#: Bytes of text that a task gets on average, and tokens after which it closes a shard.
TASK_BYTES, SHARD_TOKENS = 32 << 20, 1 << 21
#: Bytes of text encoded at a time; bytes of a string of pieces, and strings in a call.
SLICE_BYTES, STRING_BYTES, STRINGS = 8 << 20, 4096, 64
#: Shards are summed by groups of so many first, then by group.
GROUP = 1024
_TASK = 1 << 24

# A byte that a single blank may stand beside to be a safe cut: neither white space nor control.
_SOLID = np.ones(256, dtype=bool)
_SOLID[:0x21] = _SOLID[0x7F] = False
_LETTER, _POINT = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_POINT[[ord(c) for c in ",.;:!?"]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Encoder:
    """Ids of texts, by distinct pieces that are encoded once a slice.

    A byte-level BPE splits text before it merges, and no split reaches across a single blank
    between two characters that are no white space, nor from a letter to a point or comma: what
    starts there has the same ids wherever it stands. So pieces of a slice are encoded once each, many in one string,
    and told apart by the bytes of their tokens.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        from tokenizers import Tokenizer

        self.codec = Tokenizer.from_file(path)
        special = {i: len(t.content.encode()) for i, t in self.codec.get_added_tokens_decoder().items()}
        names = self.codec.get_vocab()
        self.bytes = np.zeros(max(names.values(), default=0) + 1, dtype=np.int64)
        for name, i in names.items():
            self.bytes[i] = special.get(i, len(name))  # a name has a character for each byte
        # distinct pieces of the slice before, where their ids start, how many they are, and the ids
        self.known = pa.array([], pa.large_string()), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def _joined(self, pieces: pa.Array) -> Iterator[np.ndarray]:
        """Ids of consecutive pieces, some strings at a time."""
        off, data = _buffers(pieces)
        at = np.unique(off[np.searchsorted(off, np.arange(off[0], off[-1], STRING_BYTES))])
        at = np.r_[at, off[-1]].tolist()
        for k in range(0, len(at) - 1, STRINGS):
            some = at[k : k + STRINGS + 1]
            yield self._ids([data[i:j].tobytes().decode() for i, j in zip(some[:-1], some[1:], strict=True)])

    def _ids(self, strings: list[str]) -> np.ndarray:
        return np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.codec.encode_batch_fast(strings, add_special_tokens=False)])

    def encode(self, data: np.ndarray, off: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with ``end`` after each, where each text's ids stop). Text i is data[off[i]:off[i + 1]]."""
        cut = cuts(data)
        first = off[:-1][np.diff(off) > 0]
        fresh = first[~cut[first]]
        cut[first] = True
        begins = np.flatnonzero(cut)
        edges = np.r_[begins, len(data)].astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(edges), pa.py_buffer(data)).dictionary_encode()
        # pieces that may not stand behind others, or others behind them, are encoded by themselves
        names = pieces.dictionary
        alone = ~pc.starts_with(names, " ").to_numpy(zero_copy_only=False)
        number = pieces.indices.to_numpy() if len(begins) else np.zeros(0, dtype=np.int64)
        alone[number[np.searchsorted(begins, fresh)]] = True
        alone[number[np.r_[np.searchsorted(begins, first[1:]) - 1, len(begins) - 1]] if len(begins) else number] = True
        # those of the slice before keep their ids
        found = pc.fill_null(pc.index_in(names, value_set=self.known[0]), -1).to_numpy(zero_copy_only=False)
        old = found >= 0
        order = np.r_[np.flatnonzero(~old & ~alone), np.flatnonzero(~old & alone)]
        safe = int((~old & ~alone).sum())
        parts = list(self._joined(names.take(pa.array(order[:safe])))) if safe else []
        for a in range(safe, len(order), STRINGS):
            parts.append(self._ids(names.take(pa.array(order[a : a + STRINGS])).to_pylist()))
        ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
        # ids of each distinct piece, by the bytes they stand for
        size = pc.binary_length(names).to_numpy()[order]
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(size)) + 1
        start, per_piece = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
        start[order], per_piece[order] = np.r_[0, ends[:-1]][: len(order)], np.diff(ends, prepend=0)
        start[old], per_piece[old] = self.known[1][found[old]] + len(ids), self.known[2][found[old]]
        # brought into the order of the names, so that a slice's pieces alone are remembered
        begin = np.r_[0, np.cumsum(per_piece)]
        ids = np.concatenate([ids, self.known[3]])[np.repeat(start - begin[:-1], per_piece) + np.arange(begin[-1])]
        start = begin[:-1]
        self.known = names, start, per_piece, ids
        per = per_piece[number]
        # one more piece, the end, behind the last piece of every text
        total = np.r_[0, np.cumsum(per)]
        stops = total[np.searchsorted(begins, off[1:])] + np.arange(1, len(off))
        out = np.empty(int(total[-1]) + len(off) - 1, dtype=np.uint32)
        out[stops - 1] = end
        inner = np.ones(len(out), dtype=bool)
        inner[stops - 1] = False
        shift = (start[number] - total[:-1]).astype(np.int32)  # a slice has fewer ids than 2 ** 31
        out[np.flatnonzero(inner)] = ids.take(np.repeat(shift, per) + np.arange(total[-1], dtype=np.int32))
        return out, stops


@functools.lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """The tokenizer of a worker, read once for all of its tasks."""
    return Encoder(path)


def cuts(data: np.ndarray) -> np.ndarray:
    """Mask of the bytes before which a text may be cut without a change of its ids: a point or comma
    after a letter, a blank between two bytes that belong to no white space. Characters of three bytes that start as
    Unicode's blanks do, and those that start as the no-break space does, count as white space."""
    out = np.zeros(len(data), dtype=bool)
    out[1:] = _LETTER[data[:-1]] & _POINT[data[1:]]
    at = np.flatnonzero(data[1:-1] == 0x20) + 1 if len(data) > 2 else np.zeros(0, dtype=np.int64)
    before, after = data[at - 1], data[at + 1]
    odd = lambda b: (b >= 0xE1) & (b <= 0xE3)
    unsafe = odd(data[np.maximum(at - 3, 0)]) & (before >= 0x80) | (data[np.maximum(at - 2, 0)] == 0xC2) & (before >= 0x80) | odd(after) | (after == 0xC2)
    out[at[_SOLID[before] & _SOLID[after] & ~unsafe]] = True
    return out


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = pa.concat_arrays([texts])
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return off, data


def _shards(path: str, bits: int, shard_tokens: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first, nth = encoder_of(path), TaskContext.get().partitionId() * _TASK, 0
        ids, keys, lens, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            nonlocal ids, keys, lens, held, nth
            m = WaveletMatrix.of(np.concatenate(ids), bits)
            doc = pa.concat_arrays(keys)
            stops = np.cumsum(np.concatenate(lens))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            out = pa.record_batch(
                [
                    pa.array([first + nth]), pa.array([m.n], pa.int64()), one(doc), one(pa.array(stops, pa.int64())), one(pa.array(m.zeros, pa.int64())),
                    one(pa.array([p.tobytes() for p in m.planes], pa.binary())), one(pa.array([o.astype("<u4").tobytes() for o in m.ones], pa.binary())),
                ],
                ["shard", "n", "doc_ids", "stops", "zeros", "planes", "ones"],
            )
            nth, ids, keys, lens, held = nth + 1, [], [], [], 0
            return out

        for batch in batches:
            off, data = _buffers(batch.column(1))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(off, off[a] + SLICE_BYTES, "right")) - 1)
                got, stops = encoder.encode(data[off[a] : off[b]], off[a : b + 1] - off[a], end)
                if len(got) and int(got.max()) >= 1 << bits:
                    raise ValueError(f"an id of {int(got.max())} does not fit {bits} bits")
                got, lower, at = got.astype(np.uint16 if bits <= 16 else np.uint32), 0, 0
                while at < len(stops):  # as many documents as close the shard, or all
                    to = min(len(stops), int(np.searchsorted(stops, lower + shard_tokens - held)) + 1)
                    ids.append(got[lower : stops[to - 1]])
                    keys.append(batch.column(0).slice(a + at, to - at))
                    lens.append(np.diff(stops[at:to], prepend=lower))
                    held, lower, at = held + int(stops[to - 1]) - lower, int(stops[to - 1]), to
                    if held >= shard_tokens:
                        yield row()
                a = b
        if held:
            yield row()
        pa.default_memory_pool().release_unused()  # the worker lives on

    return run


def write(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, bits: int = BITS, end: int = END, task_bytes: int = TASK_BYTES, shard_tokens: int = SHARD_TOKENS, to: str | None = None) -> str:
    """Writes the ids of all texts of docs, ``end`` after each, and returns the folder of the shards.

    path: the tokenizer's file, which every executor needs at the same place. Special tokens' names in
    a text are what the tokenizer makes of them. Rows follow ascending keys, null first; rows that
    repeat a key follow a hash of their text, so that a key of any number of rows is dealt to several tasks
    and reruns agree. Null and empty texts are the end alone. A shard closes at ``shard_tokens``; a text
    longer than that is a shard of its own. An empty table gives a folder without shards. Other
    columns are not read. to: the folder; without it one in the shared folder is taken.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    held = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(1)), F.lit(0))).first()[0]
    tasks = max(1, math.ceil(held / task_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order, "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    shards = rows.mapInArrow(_shards(path or default_path(), bits, shard_tokens, end), f"shard long, n long, doc_ids array<{kind}>, stops array<long>, zeros array<long>, planes array<binary>, ones array<binary>")
    if to is None:
        to = f"{stage_dir(spark)}/token-shards-{uuid.uuid4().hex}"
        _written.setdefault(spark, []).append(to)
    shards.write.option("compression", "zstd").parquet(to)
    return to


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shards of a folder that write() has filled; one row each."""
    return spark.read.parquet(folder)


def starts(store: DataFrame) -> DataFrame:
    """(shard, first): ids in all shards before each. Summed over GROUP shards at a time, then over the groups."""
    sizes = store.select("shard", "n")
    rank = sizes.withColumn("part", F.expr(f"shard div {_TASK} div {GROUP}"))
    inner = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = rank.groupBy("part").agg(F.sum("n").alias("held")).select("part", F.coalesce(F.sum("held").over(outer), F.lit(0)).alias("before"))
    inside = rank.select("shard", "part", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("within"))
    return inside.join(groups, "part").select("shard", (F.col("before") + F.col("within")).cast("long").alias("first"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, WaveletMatrix]]:
    """(batch, row, its matrix), one row at a time."""
    for batch in batches:
        c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            yield batch, i, WaveletMatrix.read(c["n"][i].as_py(), c["zeros"][i].as_py(), [p.as_buffer() for p in c["planes"][i].values], [p.as_buffer() for p in c["ones"][i].values])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, i, m in _matrices(batches):
        ids = m.decode().astype("<u4")
        doc = batch.column("doc_ids")[i].values
        stops = batch.column("stops")[i].values.to_numpy()
        begins = np.r_[0, stops[:-1]]
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
        yield pa.record_batch([pa.array(np.full(len(doc), batch.column("shard")[i].as_py())), doc, pa.array(begins, pa.int64()), pa.array(stops - begins, pa.int64()), pa.array(crc, pa.int64())], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, i, m in _matrices(batches):
        stops = batch.column("stops")[i].values.to_numpy()
        ids = pa.ListArray.from_arrays(pa.array(np.r_[0, stops], pa.int32()), pa.array(m.decode().astype(np.int32)))
        yield pa.record_batch([batch.column("doc_ids")[i].values, ids], ["doc_id", "ids"])


def _key_type(store: DataFrame) -> str:
    return store.schema["doc_ids"].dataType.elementType.simpleString()


def documents(store: DataFrame) -> DataFrame:
    """(doc_id, ids) of every document of the shards, the end included."""
    return store.mapInArrow(_decoded, f"doc_id {_key_type(store)}, ids array<int>")


def digests(store: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards alone: the ids in all
    documents before it, its own, and the crc32 of these as little-endian unsigned 32-bit numbers."""
    rows = store.mapInArrow(_digests, f"shard long, doc_id {_key_type(store)}, at long, n_tokens long, ids_crc32 long")
    before, _ = bounded_broadcast(starts(store))
    return rows.join(before, "shard").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def counts(store: DataFrame, ids: list[int]) -> DataFrame:
    """(shard, id, n) for some ids: two ranks a plane and shard, no decoding."""

    def run(batches):
        for batch, i, m in _matrices(batches):
            yield pa.record_batch([pa.array([batch.column("shard")[i].as_py()] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array([m.count(x) for x in ids], pa.int64())], ["shard", "id", "n"])

    return store.mapInArrow(run, "shard long, id long, n long")


def occurrences(store: DataFrame, ids: list[int]) -> DataFrame:
    """(id, doc_id, place): every occurrence of some ids, the place counted within the document."""

    def run(batches):
        for batch, i, m in _matrices(batches):
            stops, doc = batch.column("stops")[i].values.to_numpy(), batch.column("doc_ids")[i].values
            for x in ids:
                at = m.occurrences(x)
                of = np.searchsorted(stops, at, side="right")
                yield pa.record_batch([pa.array(np.full(len(at), x), pa.int64()), doc.take(pa.array(of)), pa.array(at - np.r_[0, stops][of], pa.int64())], ["id", "doc_id", "place"])

    return store.mapInArrow(run, f"id long, doc_id {_key_type(store)}, place long")


def access(store: DataFrame, places: DataFrame) -> DataFrame:
    """(place, id): the token at each distinct place of ``places`` (place: counted over all shards);
    places outside are left out.

    Places meet the shards that share their stretch of SHARD_TOKENS, so a shard is read once,
    whatever is asked of it, and is asked for no more places than it holds.
    """
    sized = starts(store).join(store.select("shard", "n"), "shard").where("n > 0")
    sized = sized.withColumn("stretch", F.explode(F.expr(f"sequence(first div {SHARD_TOKENS}, (first + n - 1) div {SHARD_TOKENS})")))
    asked = places.select(F.col("place").cast("long").alias("place")).withColumn("stretch", F.expr(f"place div {SHARD_TOKENS}")).join(sized, "stretch")
    asked = asked.where((F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("n")))
    asked = asked.groupBy("shard", "first").agg(F.collect_set("place").alias("places"))

    def run(batches):
        for batch, i, m in _matrices(batches):
            at = batch.column("places")[i].values.to_numpy()
            yield pa.record_batch([pa.array(at), pa.array(m.access(at - batch.column("first")[i].as_py()))], ["place", "id"])

    return store.drop("doc_ids", "stops").join(asked, "shard").mapInArrow(run, "place long, id long")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the shards of docs and reads every document's digest back; cases as in write()."""
    return digests(shards(docs.sparkSession, write(docs, path=path)))
