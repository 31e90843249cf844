"""Encoding of a whole corpus with a public byte-level BPE, sharing work between documents.

Method: content-defined chunk reuse. A rolling hash over the last ``WINDOW`` bytes cuts
every text, at any character, into chunks of ``AVERAGE`` bytes on the mean; where it cuts
depends on nearby content only, so equal passages of different documents fall into equal
chunks. Chunks are shuffled by content: each distinct chunk is encoded once for the whole
corpus, and its ids go to every place it occurs. Then every document is put together
and its joins are repaired: unless a join happens to be a place where the tokenizer's
pre-split must break, the stretch between the nearest such places (seams) on both sides
of it is encoded again and replaces the ids there. The pre-split breaks at seams whatever
stands around them, so the result is exactly the encoding of the whole text.

A task sends one row per distinct chunk of each piece of its input, with the places where
it occurs, so frequent chunks are pre-aggregated before the shuffle; chunks frequent
within a piece are also salted, which spreads them over tasks and lets them be encoded
at most ``SALTS`` times. Between tasks ids travel as 16-bit numbers where the vocabulary
allows it, without the text: the bytes around a join are those of its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.words import VOCABULARY, Vocabulary, WordEncoder, pieces, seams, token_bytes, worker

WINDOW = 16
#: Mean bytes of a chunk.
AVERAGE = 384
#: A chunk met so often in one piece of input is frequent.
FREQUENT = 8
SALTS = 64


def _gear() -> np.ndarray:
    """256 numbers spread by a multiplicative rule."""
    k = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    k ^= k >> np.uint64(29)
    return (k * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear()


def rolling_hash(b: np.ndarray) -> np.ndarray:
    """Hash of the ``WINDOW`` bytes up to each position: every byte's number, doubled once per byte since."""
    h, reach = _GEAR[b], 1
    while reach < WINDOW:
        older = np.zeros_like(h)
        older[reach:] = h[:-reach] if reach < len(h) else 0
        h = h + (older << np.uint32(reach))
        reach *= 2
    return h


def chunk_starts(b: np.ndarray, limits: np.ndarray, average: int = AVERAGE) -> np.ndarray:
    """Starts of the chunks of many texts laid end to end; limits: start of every text. A cut falls on the next start of
    a character; within a window of a text's start there is none, as the hash would reach into the text before."""
    n = len(b)
    mark = np.zeros(n + 1, bool)
    if n:
        h = rolling_hash(b)
        # The upper bits mix all bytes of the window; the lowest are those of the last bytes only.
        at = np.flatnonzero(h * np.uint32(0x9E3779B1) < np.uint32(0xFFFFFFFF // average)) + 1
        for _ in range(3):
            at = at + ((at < n) & ((b[np.minimum(at, n - 1)] & 0xC0) == 0x80))
        own = limits[np.searchsorted(limits, at, side="right") - 1]
        mark[at[(at - own >= WINDOW) & (at < n)]] = True
        mark[limits[limits < n]] = True
    return np.flatnonzero(mark)


def assemble(ids: np.ndarray, chunk: np.ndarray, document: np.ndarray, encoder: WordEncoder, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int]]:
    """Exact ids of documents from the ids of their chunks, laid end to end. chunk: number of ids of every chunk; document:
    number of chunks of every document. Returns (ids, number of ids of every document, (joins, joins repaired, bytes
    encoded again))."""
    flat, limits = token_bytes(vocabulary)
    size = limits[ids + 1] - limits[ids]
    byte_at = np.concatenate([[0], np.cumsum(size)])
    b = flat[np.repeat(limits[ids] - byte_at[:-1], size) + np.arange(byte_at[-1])]
    chunk_at = np.concatenate([[0], np.cumsum(chunk)])
    doc_at = chunk_at[np.concatenate([[0], np.cumsum(document)])]  # in ids
    doc_byte = byte_at[doc_at]
    joins = np.setdiff1d(byte_at[chunk_at], doc_byte)
    seam = seams(b) if len(b) else np.zeros(0, bool)
    bad = joins[~seam[joins]]
    if not len(bad):
        return ids, np.diff(doc_at), (len(joins), 0, 0)
    stop = np.union1d(np.flatnonzero(seam), doc_byte)
    right = np.searchsorted(stop, bad, side="right")
    lo, hi = np.unique(np.stack([stop[right - 1], stop[right]]), axis=1)
    # Encode the stretches again and put them in the place of the ids that lie in them.
    length = hi - lo
    take = np.repeat(lo - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    new, count = encoder.texts(b[take], np.concatenate([[0], np.cumsum(length)]))
    first, last = np.searchsorted(byte_at, lo), np.searchsorted(byte_at, hi)
    gone = np.zeros(len(ids) + 1, np.int64)
    gone[first] += 1
    np.subtract.at(gone, last, 1)
    keep = np.cumsum(gone[:-1]) == 0
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    out = np.insert(ids[keep], np.repeat(kept_before[first], count), new)
    change = np.zeros(len(doc_at), np.int64)
    np.add.at(change, np.searchsorted(doc_at, first, side="right"), count - (last - first))
    return out, np.diff(doc_at + np.cumsum(change)), (len(joins), len(bad), int(length.sum()))


def chunks(documents: DataFrame, key: str = "doc_id", text: str = "text", average: int = AVERAGE) -> DataFrame:
    """Distinct chunks per piece of input: (k1, k2, salt, chunk, doc_ids, rows, seqs); the last three say in which
    documents and as which chunk of them it occurs. A NULL or empty text is one empty chunk. ``rows`` numbers the rows of
    the table, so that repeated ids are told apart."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        part = TaskContext.get().partitionId()
        base, number = part << 33, 0
        for batch in batches:
            for row, end, b, limits in pieces(batch.column(1)):
                start = chunk_starts(b, limits[:-1], average)
                raw = b.tobytes()
                seen: dict[bytes, int] = {}
                stop = np.append(start[1:], len(b)).tolist()
                code = [seen.setdefault(raw[s:e], len(seen)) for s, e in zip(start.tolist(), stop, strict=True)]
                doc = np.searchsorted(limits, start, side="right") - 1
                # Of texts without bytes the limits coincide: the search gives the last, which has the bytes.
                empty = np.flatnonzero(np.diff(limits) == 0)
                if len(empty):
                    code += [seen.setdefault(b"", len(seen))] * len(empty)
                    doc = np.concatenate([doc, empty])
                code = np.array(code, np.int64)
                seq = np.arange(len(doc)) - np.searchsorted(doc[: len(start)], doc)
                seq[len(start) :] = 0
                order = np.argsort(code, kind="stable")
                count = np.bincount(code, minlength=len(seen))
                at = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                lists = [
                    pa.ListArray.from_arrays(at, batch.column(0).slice(row, end - row).take(pa.array(doc[order])).cast(pa.int64())),
                    pa.ListArray.from_arrays(at, pa.array(base + doc[order])),
                    pa.ListArray.from_arrays(at, pa.array(seq[order].astype(np.int32))),
                ]
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(c) for c in seen), np.int64).reshape(-1, 2)
                salt = np.where(count >= FREQUENT, (part * 31 + number) % SALTS, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(salt), pa.array(list(seen), pa.binary()), *lists], names=["k1", "k2", "salt", "chunk", "doc_ids", "rows", "seqs"])
                base += end - row
                number += 1

    return documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        scan, "k1 bigint, k2 bigint, salt int, chunk binary, doc_ids array<bigint>, rows array<bigint>, seqs array<int>"
    )


def encoded(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text", average: int = AVERAGE) -> DataFrame:
    """(doc_id, ids) of every document: no special tokens, their spellings being ordinary text; an empty list for an
    empty and for a NULL text. Repeated rows each come out; other columns are ignored."""
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary))
    wide = max(shared.value.ranks().values()) >= 1 << 16
    kind = np.dtype("<u4" if wide else "<u2")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker(shared.value)
        known: dict[bytes, bytes] = {}  # of the chunk at the end of the batch before
        for batch in batches:
            if not batch.num_rows:
                continue
            listed = batch.column("chunk").to_pylist()
            new = [c for c in dict.fromkeys(listed) if c not in known]
            if new:
                ids, n = encoder.texts(np.frombuffer(b"".join(new), np.uint8), np.concatenate([[0], np.cumsum([len(c) for c in new])]))
                raw, at = ids.astype(kind).tobytes(), (np.concatenate([[0], np.cumsum(n)]) * kind.itemsize).tolist()
                known |= {c: raw[at[k] : at[k + 1]] for k, c in enumerate(new)}
            rows, seqs, docs = (batch.column(c) for c in ("rows", "seqs", "doc_ids"))
            which = pa.array(np.repeat(np.arange(batch.num_rows), rows.value_lengths().to_numpy()))
            yield pa.RecordBatch.from_arrays([rows.flatten(), seqs.flatten(), docs.flatten(), pa.array([known[c] for c in listed], pa.binary()).take(which)], names=["row", "seq", "doc_id", "ids"])
            known = {listed[-1]: known[listed[-1]]}

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held = worker(shared.value), []

        def put(tab: pa.Table) -> pa.RecordBatch:
            row = tab.column("row").to_numpy()
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            parts = tab.column("ids").combine_chunks()
            size = np.asarray(pa.compute.binary_length(parts)).astype(np.int64) // kind.itemsize
            ids = np.frombuffer(b"".join(parts.to_pylist()), kind).astype(np.int64)
            out, n, _ = assemble(ids, size, np.diff(np.append(first, len(row))), encoder, shared.value)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(out.astype(np.int32)))
            return pa.RecordBatch.from_arrays([tab.column("doc_id").take(pa.array(first)).combine_chunks(), lists], names=["doc_id", "ids"])

        for batch in batches:  # sorted by row: a document is complete once another one begins
            if not batch.num_rows:
                continue
            row = batch.column("row").to_numpy()
            cut = int(np.searchsorted(row, row[-1]))
            if held and (cut or held[-1].column("row")[-1].as_py() != row[0]):
                yield put(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield put(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield put(pa.Table.from_batches(held))

    by_content = chunks(documents, key, text, average).repartition("k1", "k2", "salt").sortWithinPartitions("k1", "k2", "salt")
    placed = by_content.mapInArrow(encode, "row bigint, seq int, doc_id bigint, ids binary")
    return placed.repartition("row").sortWithinPartitions("row", "seq").mapInArrow(join, "doc_id bigint, ids array<int>")


def reuse_report(documents: DataFrame, key: str = "doc_id", text: str = "text", average: int = AVERAGE) -> DataFrame:
    """One row: chunks, distinct chunks, bytes, bytes of distinct chunks and the share of bytes that are not encoded for
    themselves but reused."""
    c = chunks(documents, key, text, average).select("k1", "k2", F.size("rows").cast("long").alias("n"), F.octet_length("chunk").cast("long").alias("b"))
    per = c.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.first("b").alias("b"))
    total = per.agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("distinct_chunks"), F.sum(F.col("n") * F.col("b")).alias("bytes"), F.sum("b").alias("distinct_bytes"))
    return total.withColumn("reused_share", 1 - F.try_divide(F.col("distinct_bytes").cast("double"), F.col("bytes").cast("double")))
