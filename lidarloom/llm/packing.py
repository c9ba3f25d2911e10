"""Packing: concatenate and cut into sequences of a fixed number of tokens."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SEQUENCE = 1024
SEPARATOR = 0
#: Partitions up to which their totals are broadcast (16 bytes each); beyond it tokens are shuffled to them.
FEW_PARTS = 200_000
#: What the vocabulary's byte-level BPE splits a text by before it merges; a fixed value.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a byte-level BPE tokenizers file, without special tokens added.

    The merging is done by tiktoken with ranks read from the same file, which gives the same ids at several times the
    speed; texts that hold one of the file's special tokens go through tokenizers itself, which knows them as tokens.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable}
        letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        ranks = {bytes(letters[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.path, self.slow = path, None

    def __call__(self, text: str) -> list[int]:
        if any(x in text for x in self.special):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast._core_bpe.encode_ordinary(text)


def tokenised(docs: DataFrame, path: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, part, at, n, ids: each document's ids and the separator as 4-byte or 2-byte numbers; `at` counts the ids
    before it within its partition. The order of a partition is the order of its rows, which is written down with it."""
    where = path or vocabulary()

    def encode(batches):
        encoder, at, part = Encoder(where), 0, TaskContext.get().partitionId()
        wide = "<u2" if len(encoder.fast._mergeable_ranks) < 65536 else "<u4"
        for pdf in batches:
            ids = [np.array([*encoder(t or ""), separator], dtype=wide) for t in pdf["text"]]
            n = np.array([len(x) for x in ids], dtype=np.int64)
            before = at + np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
            at += int(n.sum())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "part": np.int32(part), "at": before, "n": n, "ids": [x.tobytes() for x in ids], "width": np.int32(int(wide[-1]))})

    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return out.mapInPandas(encode, "doc_id string, part int, at long, n long, ids binary, width int")


PIECE = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(placed: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, first: ids before it in the whole, n, ids) -> the pieces that the multiples of `sequence` cut it into."""

    def pieces(batches):
        for pdf in batches:
            rows = []
            for doc_id, first, n, ids, width in zip(pdf["doc_id"], pdf["first"], pdf["n"], pdf["ids"], pdf["width"], strict=True):
                data = np.frombuffer(ids, dtype=f"<u{width}").astype("<u4").tobytes()
                start = 0
                while start < n:
                    at = first + start
                    stop = min(n, start + sequence - at % sequence)
                    rows.append((doc_id, start, stop - start, zlib.crc32(data[4 * start : 4 * stop]), n, at // sequence, at % sequence))
                    start = stop
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PIECE.split(", ")])

    return placed.select("doc_id", "first", "n", "ids", "width").mapInPandas(pieces, PIECE)


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, separator: int = SEPARATOR) -> DataFrame:
    """Pieces of the documents' ids in sequences of `sequence`: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    Pass one tokenises and counts within each partition; prefix sums over the partitions' totals (a row each) give
    every document its place in the one long run of ids; pass two cuts that run at the multiples of `sequence`, a
    document that lies across one becoming several pieces. Only the last sequence can be short, so padding is less
    than one sequence in all. Tokens are made once: they are written to the shared folder, which also fixes the order.

    Null and empty texts have the separator only. A null doc_id stays null. Repeated rows are packed each on its own.
    An empty table gives no rows. Columns besides doc_id and text don't take part.
    """
    kind = docs.schema["doc_id"].dataType
    t = stored(tokenised(docs, path, separator))
    totals = t.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    few = totals.count() <= FEW_PARTS
    placed = t.join(F.broadcast(base) if few else base, "part").withColumn("first", F.col("base") + F.col("at"))
    return cut(placed, sequence).withColumn("doc_id", F.col("doc_id").cast(kind))
