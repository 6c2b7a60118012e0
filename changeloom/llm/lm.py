"""Stupid-backoff language-model scores of every document, computed relationally.

Each scan task cuts its rows into chunks of bounded text, which are stored compressed in the shared folder, so that the
texts of a chunk stay the same whatever is computed anew. N-grams are exploded and counted within a chunk; the chunks'
counts are summed into count tables partitioned by the n-grams' hash, which are joined back to the chunks' n-grams and
summed per document. Rows between the steps are sorted, delta-coded blocks of n-grams, as single rows would take several
times the input's disk. A chunk sends a block to each range. Beyond FLAT chunks, whose blocks would be too many and too
small, they travel in two levels, so that P chunks and P hash ranges need P * sqrt(P) blocks, not P * P: a chunk sends
a block for each of sqrt(P) groups of ranges; a group of sqrt(P) chunks merges its blocks (a frequent n-gram is then one
entry) and sends one for each range; the table of a range sums these and answers them, and the answers go back the same
way. A very frequent n-gram is one entry a block, so no range is hot.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, stored
from .textops import word_hashes

#: Bytes of text of a chunk, and of the text whose n-grams a hash range holds.
CHUNK = 8 << 20
#: Rows of a chunk at most.
ROWS = 100_000
#: Chunks up to which each sends a block to each range. Two levels write the n-grams about twice.
FLAT = 4096
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pack(a: np.ndarray) -> bytes:
    """Byte planes of an unsigned array, compressed: planes of zeros vanish."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _chunks(batches):
    """Rows (doc_id, text) as chunks of about CHUNK bytes and ROWS rows at most; a longer text is in a chunk of its own.

    A chunk is its number (the task's, then its own), its words, its bytes and a compressed stream of its rows.
    """
    first, number, held, size, rows, words = TaskContext.get().partitionId() << 32, 0, [], 0, 0, 0

    def closed():
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
            w.write_table(pa.Table.from_batches(held).combine_chunks())
        return pa.RecordBatch.from_pylist([{"chunk": first + number, "n_words": words, "n_bytes": size, "docs": out.getvalue().to_pybytes()}])

    for batch in batches:
        start = 0
        for i, text in enumerate(batch.column("text")):
            b = text.as_py().encode("utf-8", "surrogatepass")
            if rows and (size + len(b) > CHUNK or rows == ROWS):
                held.append(batch.slice(start, i - start))
                yield closed()
                start, number, held, size, rows, words = i, number + 1, [], 0, 0, 0
            size, rows, words = size + len(b), rows + 1, words + len(b.split())
        held.append(batch.slice(start))
    if rows:
        yield closed()


def _docs(chunk: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(chunk).read_all().to_pandas()


def _grams(texts, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the hash of the n-gram that ends at each word; the words' positions in their text; offsets."""
    h, ends = word_hashes(texts)
    at = np.arange(len(h)) - np.repeat(ends[:-1], np.diff(ends))
    out, g = [mix64(h ^ _B)], h
    for o in range(2, order + 1):
        n = np.zeros(len(h), np.uint64)
        n[1:] = mix64(g[:-1] * _A + h[1:] + np.uint64(o))
        g = n
        out.append(n)
    return out, at, ends


def _distinct(grams, at) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([g[at >= o] for o, g in enumerate(grams)]), return_counts=True)


def _range_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def spread(parts: int) -> int:
    """Chunks (and ranges) of a group: the root of their number, rounded up."""
    return math.isqrt(max(parts, 1) - 1) + 1


def stupid_backoff(docs: DataFrame, order: int = 3, alpha: float = 0.4) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, n_backoff, log_score, mean_log_score.

    Words are runs without white space, A-Z lower-cased, of whole texts. Counts are of all documents less the scored
    document's own (the texts of a row are never their own evidence; copies in other rows are). The score of a word
    is the first of: f(n-gram) / f(its context), for the longest n-gram seen elsewhere, times ``alpha`` for each
    order that was given up; f(word) / N; and 1 / (N + 1) for a word seen nowhere else. N counts the other
    documents' words. n_backoff counts the words, but a text's first, whose longest n-gram (of ``order`` words) is seen
    nowhere else or does not fit before them. Null or empty texts have 0 tokens, a log_score of 0 and a null mean.
    Repeated rows are separate documents. Other columns are ignored; an
    empty table gives no rows.
    """
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = stored(d.mapInArrow(_chunks, "chunk long, n_words long, n_bytes long, docs binary"), "chunks")
    total, words, chunks = d.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_bytes", "n_words")), F.count("*")).first()
    parts = max(1, math.ceil(total / CHUNK))
    wide = 1 if max(parts, chunks) <= FLAT else spread(max(parts, chunks))

    def cut(keys: np.ndarray, counts: np.ndarray, by: int):
        """(number, keys, counts) of the runs of ranges, or of groups of ``by`` ranges, that sorted keys fall in."""
        if not len(keys):
            return
        part = _range_of(keys, parts) // by
        at = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(keys)]])
        for s, e in zip(at[:-1], at[1:]):
            yield int(part[s]), keys[s:e], counts[s:e]

    def packed(k: np.ndarray, c: np.ndarray) -> tuple[bytes, bytes]:
        return _pack(np.diff(k, prepend=np.uint64(0))), _pack(c.astype(np.uint32 if c.max() < 1 << 32 else np.uint64))

    def opened(pdf: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Each block's keys, and the distinct keys of all with their summed counts."""
        keys = [np.cumsum(_unpack(b, np.uint64), dtype=np.uint64) for b in pdf["grams"]]
        n = [_unpack(b, np.uint32 if w == 4 else np.uint64) for b, w in zip(pdf["n"], pdf["width"])]
        table, at = np.unique(np.concatenate(keys), return_inverse=True)
        return keys, table, np.bincount(at, np.concatenate(n)).astype(np.uint64)

    def row(*head_and_arrays):
        *head, k, c = head_and_arrays
        return (*head, *packed(k, c), 4 if c.max() < 1 << 32 else 8)

    def ask(frames):
        for pdf in frames:
            for chunk, docs in zip(pdf["chunk"], pdf["docs"]):
                grams, at, _ = _grams(_docs(docs)["text"].tolist(), order)
                keys, n = _distinct(grams, at)
                group = int(mix64(np.array([chunk], np.uint64))[0] % np.uint64(wide))
                yield pd.DataFrame([row(group if wide > 1 else chunk, g, chunk, k, c) for g, k, c in cut(keys, n, wide)], columns=["chunks", "ranges", "chunk", "grams", "n", "width"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        _, table, n = opened(pdf)
        at = int(pdf["chunks"].iloc[0]), int(pdf["ranges"].iloc[0])
        return pd.DataFrame([row(p, *at, k, c) for p, k, c in cut(table, n, 1)], columns=["part", "chunks", "ranges", "grams", "n", "width"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, table, n = opened(pdf)
        counts = [_pack(n[np.searchsorted(table, k)]) for k in keys]
        return pd.DataFrame({"chunks": pdf["chunks"], "ranges": pdf["ranges"], "part": pdf["part"], "counts": counts})

    def divide(asked: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame(columns=["chunk", "ranges", "counts"])
        keys, table, _ = opened(asked)
        n = np.concatenate([_unpack(b, np.uint64) for b in got.sort_values("part")["counts"]])
        return pd.DataFrame({"chunk": asked["chunk"], "ranges": asked["ranges"], "counts": [_pack(n[np.searchsorted(table, k)]) for k in keys]})

    block = "grams binary, n binary, width int"
    asked = d.select("chunk", "docs").mapInPandas(ask, f"chunks long, ranges long, chunk long, {block}")
    answered = "chunks long, ranges long, part long, counts binary"
    if wide == 1:
        table = asked.withColumn("part", F.col("ranges")).groupBy("part").applyInPandas(answer, answered)
        answers = table.select(F.col("chunks").alias("chunk"), "ranges", "counts")
    else:
        merged = asked.groupBy("chunks", "ranges").applyInPandas(merge, f"part long, chunks long, ranges long, {block}")
        table = merged.groupBy("part").applyInPandas(answer, answered)
        answers = asked.groupBy("chunks", "ranges").cogroup(table.groupBy("chunks", "ranges")).applyInPandas(divide, "chunk long, ranges long, counts binary")

    def score(chunk: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        texts = _docs(chunk["docs"].iloc[0])
        grams, at, ends = _grams(texts["text"].tolist(), order)
        sizes = [int((at >= o).sum()) for o in range(order)]
        keys, places = np.unique(np.concatenate([g[at >= o] for o, g in enumerate(grams)]), return_inverse=True)
        places = np.split(places, np.cumsum(sizes)[:-1])
        counts = np.concatenate([_unpack(b, np.uint64) for b in got.sort_values("ranges")["counts"]]) if len(got) else np.zeros(0, np.uint64)
        n = np.diff(ends)
        doc, seen = np.repeat(np.arange(len(n)), n), []
        for o in range(order):
            f, at_o, place = np.zeros(len(doc), np.int64), at >= o, places[o]
            _, of, tf = np.unique(doc[at_o] * len(keys) + place, return_inverse=True, return_counts=True)
            f[at_o] = counts[place].astype(np.int64) - tf[of]
            seen.append(f)
        others, most = words - n[doc], np.minimum(at, order - 1)
        p = np.where(seen[0] > 0, seen[0] / np.maximum(others, 1), 1.0 / (others + 1)) * alpha**most
        for o in range(1, order):
            ok = np.flatnonzero(seen[o] > 0)  # these have o words before them, and their context is the n-gram at the last
            p[ok] = seen[o][ok] / np.maximum(seen[o - 1][ok - 1], 1) * alpha ** (most[ok] - o)
        some = n > 0
        first, back, total = ends[:-1][some], np.zeros(len(n), np.int64), np.zeros(len(n))
        if len(first):
            back[some] = np.add.reduceat((at > 0) & (seen[-1] == 0), first, dtype=np.int64)
            total[some] = np.add.reduceat(np.log(p), first)
        mean = np.where(some, total / np.maximum(n, 1), np.nan)
        return pd.DataFrame({"doc_id": texts["doc_id"].to_numpy(), "n_tokens": n, "n_backoff": back, "log_score": total, "mean_log_score": mean})

    answers = stored(answers, "answers")  # the blocks' shuffle files go before texts move
    out = d.select("chunk", "docs").groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return out.applyInPandas(score, "doc_id long, n_tokens long, n_backoff long, log_score double, mean_log_score double")
