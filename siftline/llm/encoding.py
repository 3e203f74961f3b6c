"""Encoding a corpus with a public byte-level tokenizer, reusing content-defined chunks.

Texts are cut where a rolling hash of the preceding bytes says so, so equal passages of different
documents give equal chunks.  A chunk is encoded once, per task or in the whole corpus, and documents are
put together from the ids of their chunks.  Most cuts lie between a visible ASCII character and a blank, which the
tokenizer's own splitting never crosses, so the ids simply follow each other.  A stretch without
such a place is cut at a hashed character boundary instead, and the ids around that join are
repaired: the splitting is run again from the last place that the left part settles alone, until
it agrees with a boundary of the right part's own splitting; from there on both are the same.

Hot chunks are what the cache is for; where chunks are exchanged, they are counted with a partial
aggregation and the join back is salted for the heaviest.  A task holds one batch of documents and the cache.

Defined results: null and empty texts give an empty list; strings of special tokens are ordinary
text; rows with equal doc_id are encoded each; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.skew import hot_keys, salted_join
from siftline.runtime import materialise

#: The splitting pattern of the public vocabulary; white space is written out as Unicode has it.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"

VOCABULARY = "byte_bpe_50k.tiktoken"
WINDOW = 12
MEAN_WORDS = 10
LONGEST = 4096


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Path of an installed vocabulary file; pass another path to the operators to use another one."""
    root = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(root, name)


def ship_vocabulary(spark: SparkSession, path: str) -> str:
    """Send a rank file of the driver to the executors, once per context, so that they need no copy at the same place."""
    sent = getattr(spark.sparkContext, "_siftline_vocabularies", None)
    if sent is None:
        sent = spark.sparkContext._siftline_vocabularies = set()
    if path not in sent and os.path.exists(path):
        spark.sparkContext.addFile(path)
        sent.add(path)
    return path


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a rank file, one per Python worker; where the path does not exist the file that was sent is read."""
    import tiktoken

    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """For every byte a hash of the WINDOW bytes that end there."""
    wide = data.astype(np.uint32)
    h = np.zeros(len(wide), dtype=np.uint32)
    for j in range(min(WINDOW, len(wide))):
        h[j:] += wide[: len(wide) - j] * np.uint32(pow(31, j + 1, 2**32))
    return (h * np.uint32(2654435761)) >> np.uint32(16)


def cut_places(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, safe): where to cut concatenated texts that begin at ``starts``; text starts are safe places.

    Content decides all places, forced ones too: in a stretch of more than LONGEST bytes without a safe
    place they are the hashed character starts.
    """
    n = len(data)
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)
    h = rolling_hash(data)
    before = np.concatenate([[np.uint8(0)], data[:-1]])
    hb = np.concatenate([[np.uint32(1)], h[:-1]])
    seam = ((data == 32) | (data == 10)) & (before > 32) & (before < 127)
    good = seam & (hb % MEAN_WORDS == 0)
    places = np.flatnonzero(good)
    places = np.union1d(places, starts[starts < n])
    gaps = np.flatnonzero(np.diff(np.append(places, n)) > LONGEST)
    extra = []
    for g in gaps:
        lo, hi = places[g], places[g + 1] if g + 1 < len(places) else n
        inside = np.flatnonzero(seam[lo + 1 : hi]) + lo + 1  # any safe seam first, spaced out
        walls = np.concatenate([[lo], inside, [hi]])
        keep = []
        at = lo
        for x in inside:
            if x - at >= LONGEST // 2:
                keep.append(x)
                at = x
        extra.extend((int(x), True) for x in keep)
        for a, b in zip(walls, walls[1:]):
            if b - a > LONGEST:
                lead = (data[a + 1 : b] & 0xC0) != 0x80
                forced = np.flatnonzero(lead & (hb[a + 1 : b] % (LONGEST // 4) == 0)) + a + 1
                extra.extend((int(x), False) for x in forced)
    safe = {int(p): True for p in places}
    for p, s in extra:
        safe.setdefault(p, s)
    out = np.fromiter(sorted(safe), dtype=np.int64, count=len(safe))
    return out, np.fromiter((safe[int(p)] for p in out), dtype=bool, count=len(out))


def _texts(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a batch of strings, and start and end of each non-empty one with its row."""
    a = column.cast(pa.large_string())
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    body = a.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if a.buffers()[2] is not None and len(a) else b""
    offsets = offsets - offsets[0]
    valid = np.asarray(a.is_valid())
    lo, hi = offsets[:-1], offsets[1:]
    rows = np.flatnonzero(valid & (hi > lo))
    return body, lo[rows], hi[rows], rows


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, bool, bytes]]:
    """(row, position, safe, chunk) of a batch of texts."""
    body, lo, hi, rows = _texts(column)
    places, safe = cut_places(np.frombuffer(body, dtype=np.uint8), lo)
    ends = np.append(places[1:], len(body))
    owner = np.searchsorted(lo, places, side="right") - 1
    position = np.arange(len(places)) - np.searchsorted(places, lo)[owner]
    for o, k, s, a, b in zip(owner.tolist(), position.tolist(), safe.tolist(), places.tolist(), ends.tolist()):
        yield int(rows[o]), k, s, body[a:b]


def _distinct_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[bytes, int] = {}
        for _, _, _, chunk in _chunks(batch.column(0)):
            counts[chunk] = counts.get(chunk, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["chunk", "n"]
        )


def _digest(chunk: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(chunk)


def _encoder_of(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_digest(t.encode()) for t in texts], pa.binary()), batch.column(1),
                    pa.array([enc.encode_ordinary(t) for t in texts], pa.list_(pa.int32())),
                ],
                names=["h", "n", "ids"],
            )

    return encode


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        docs, at, safe, h = [], [], [], []
        for row, k, s, chunk in _chunks(batch.column(1)):
            docs.append(ids[row])
            at.append(k)
            safe.append(s)
            h.append(_digest(chunk))
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(at, pa.int32()), pa.array(safe, pa.bool_()), pa.array(h, pa.binary())],
            names=["row", "at", "safe", "h"],
        )


class JoinRepair:
    """Puts chunks together whose joins are not safe, until the ids agree with encoding them as one text."""

    def __init__(self, path: str):
        import regex

        self.enc = encoder(path)
        self.split = regex.compile(SPLIT)

    def pieces(self, ids: list[int]) -> list[tuple[str, list[int]]]:
        """The chunk's own splitting, each piece with its ids."""
        lengths = [len(self.enc.decode_single_token_bytes(i)) for i in ids]
        text = self.enc.decode_bytes(ids).decode()
        out, at = [], 0
        for m in self.split.finditer(text):
            need, first = len(m.group().encode()), at
            while need > 0:
                need -= lengths[at]
                at += 1
            out.append((m.group(), ids[first:at]))
        return out

    def join(self, left: list[tuple[str, list[int]]], right: list[tuple[str, list[int]]]) -> list[tuple[str, list[int]]]:
        # a piece of the left part is settled when two more characters follow it
        k, tail = len(left), 0
        while k and tail < 2:
            k -= 1
            tail += len(left[k][0])
        start = "".join(p for p, _ in left[k:])
        text = start + "".join(p for p, _ in right)
        own, at = {}, len(start)
        for i, (p, _) in enumerate(right):
            own[at] = i
            at += len(p)
        out = left[:k]
        for m in self.split.finditer(text):
            if m.start() >= len(start) and m.start() in own:
                out.extend(right[own[m.start()] :])
                return out
            out.append((m.group(), self.enc.encode_ordinary(m.group())))
        return out

    def whole(self, chunks: list[tuple[bool, list[int]]]) -> list[int]:
        done: list[int] = []
        held: list[tuple[str, list[int]]] = []
        for safe, ids in chunks:
            if safe:
                done.extend(i for _, p in held for i in p)
                held = self.pieces(ids)
            else:
                held = self.join(held, self.pieces(ids))
        done.extend(i for _, p in held for i in p)
        return done


def _repairer_of(path: str):
    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = JoinRepair(path)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            out = [fix.whole([(c["safe"], c["ids"]) for c in chunks]) for chunks in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["row", "ids"])

    return repair


CACHED_BYTES = 48_000_000


class ChunkCache:
    """Ids of the chunks a worker has seen, bounded by the size of their texts."""

    def __init__(self, path: str):
        self.enc, self.ids, self.held = encoder(path), {}, 0

    def __getitem__(self, chunk: bytes) -> np.ndarray:
        found = self.ids.get(chunk)
        if found is None:
            found = np.array(self.enc.encode_ordinary(chunk.decode()), dtype=np.int32)
            if self.held > CACHED_BYTES:
                self.ids, self.held = {}, 0
            self.ids[chunk] = found
            self.held += len(chunk)
        return found


def _in_place_of(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, fix = ChunkCache(path), JoinRepair(path)
        for batch in batches:
            column, n = batch.column(1), len(batch)
            body, lo, hi, rows = _texts(column)
            places, safe = cut_places(np.frombuffer(body, dtype=np.uint8), lo)
            ends = np.append(places[1:], len(body))
            parts = [cache[body[a:b]] for a, b in zip(places.tolist(), ends.tolist())]
            owner = rows[np.searchsorted(lo, places, side="right") - 1] if len(places) else np.empty(0, dtype=np.int64)
            for row in np.unique(owner[~safe]):  # texts with a join that needs repair
                at = np.flatnonzero(owner == row)
                whole = fix.whole([(bool(safe[i]), parts[i].tolist()) for i in at])
                for i in at:
                    parts[i] = np.empty(0, dtype=np.int32)
                parts[at[0]] = np.array(whole, dtype=np.int32)
            sizes = np.bincount(owner, weights=[len(p) for p in parts], minlength=n).astype(np.int64) if parts else np.zeros(n, dtype=np.int64)
            values = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return run


def encode_corpus(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of every text, null and empty ones as empty lists; one narrow pass.

    A chunk shared by documents of one task is encoded once, within a bounded cache; nothing is shuffled.
    """
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(_in_place_of(ship_vocabulary(docs.sparkSession, vocabulary or vocabulary_path())), "doc_id long, ids array<int>")


def encode_corpus_once(docs: DataFrame, work: str, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The same with every distinct chunk encoded once in the whole corpus: chunks and ids go through exchanges.

    For tokenizers so slow that moving ids costs less than encoding a chunk once per task.
    """
    path = ship_vocabulary(docs.sparkSession, vocabulary or vocabulary_path())
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    full = texts.where("text is not null and text <> ''")
    counted = (
        full.select("text").mapInArrow(_distinct_chunks, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    )
    dictionary = materialise(counted.select("chunk", "n").mapInArrow(_encoder_of(path), "h binary, n long, ids array<int>"), f"{work}/dictionary")
    hot = hot_keys(dictionary, "h", "n")
    refs = full.mapInArrow(_references, "row long, at int, safe boolean, h binary")
    joined = salted_join(refs, dictionary.select("h", "ids"), "h", hot, F.xxhash64("row", "at"), "inner")
    by_doc = joined.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("at", "safe", "ids"))).alias("chunks"), F.min("safe").alias("all_safe")
    )
    plain = by_doc.where("all_safe").select("row", F.flatten(F.transform("chunks", lambda c: c["ids"])).alias("ids"))
    repaired = (
        by_doc.where("not all_safe").select("row", "chunks").mapInArrow(_repairer_of(path), "row long, ids array<int>")
    )
    empty = texts.where("text is null or text = ''").select(F.col("doc_id").alias("row"), F.array().cast("array<int>").alias("ids"))
    return plain.unionByName(repaired).unionByName(empty).select(F.col("row").alias("doc_id"), "ids")


def token_counts(docs: DataFrame, text_column: str = "text", vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, the text's 128-bit hash and its number of tokens, in one pass without a shuffle."""
    path = ship_vocabulary(docs.sparkSession, vocabulary or vocabulary_path())
    names = list(keep or [])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
            h = [_digest((t or "").encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(h, pa.binary()), pa.array(n, pa.int64())], names=[*names, "h", "tokens"])

    chosen = docs.select(*names, F.col(text_column))
    types = dict(docs.dtypes)
    return chosen.mapInArrow(count, ", ".join([*(f"{n} {types[n]}" for n in names), "h binary, tokens long"]))


def decoded_digests(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, digest): the sha256 of the bytes that a document's ids decode to, for checks of an encoded corpus."""
    path = ship_vocabulary(encoded.sparkSession, vocabulary or vocabulary_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        enc = encoder(path)
        for batch in batches:
            digests = [hashlib.sha256(enc.decode_bytes(ids)).hexdigest() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests)], names=["doc_id", "digest"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, digest string")
