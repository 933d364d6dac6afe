"""Best-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LENGTH = 2048
OPEN_BINS = 1024
#: Documents that one packing task takes, on average: enough for good fits, few enough to spread the work.
DOCS_PER_TASK = 200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Fixed value: the pre-tokenizer pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_chars() -> dict[str, int]:
    """Byte-level vocabularies spell each byte as one printable character; this is that spelling, reversed."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of a ``tokenizers`` file; byte-level BPE files whose ids follow the order of their merges run several times
    faster in ``tiktoken`` with the same vocabulary and merge order. Texts that spell an added token always go through
    the tokenizer itself, and so does everything under other kinds of files.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.fast = self._same_in_tiktoken(path)

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast(text), "<u4").tobytes()

    @staticmethod
    def _same_in_tiktoken(path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        pre, model = file.get("pre_tokenizer") or {}, file["model"]
        plain = file.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or model.get("type") != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("ignore_merges"):
            return None
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ids = [model["vocab"].get(m, -1) for m in merged]
        if ids != sorted(set(ids)) or min(ids, default=0) < 256:
            return None
        try:
            import tiktoken
        except ImportError:
            return None
        chars, added = _byte_chars(), {t["content"] for t in file.get("added_tokens", [])}
        ranks = {bytes(chars[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker, loaded once."""
    return Encoder(path)


def pieces_of(ids: bytes, length: int) -> Iterator[tuple[int, int, int]]:
    """``(start, length, crc32)`` of each piece: pieces are ``length`` long but for the first, which may be shorter."""
    n = len(ids) // 4
    head = n % length or min(n, length)
    start, size = 0, head
    while start < n:
        yield start, size, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + size)])
        start, size = start + size, length


class BestFit:
    """Online best-fit over at most ``open_bins`` open bins, kept in a bitset keyed by free space.

    Bit f of ``free`` is set while some open bin has exactly f tokens left, so the tightest bin that takes a piece is the
    lowest set bit from the piece's length up, and the fullest bin, which closes when a new one needs its place, is
    the lowest set bit of all.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.free, self.count, self.made = 0, 0, 0
        self.bins: dict[int, list[int]] = {}

    def _take(self, space: int) -> int:
        stack = self.bins[space]
        found = stack.pop()
        if not stack:
            del self.bins[space]
            self.free ^= 1 << space
        self.count -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """Bin number and offset for a piece of ``size`` tokens."""
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            found = self._take(space)
        else:
            if self.count >= self.limit and size < self.capacity:
                self._take((self.free & -self.free).bit_length() - 1)
            found, space = self.made, self.capacity
            self.made += 1
        left = space - size
        if left:
            self.bins.setdefault(left, []).append(found)
            self.free |= 1 << left
            self.count += 1
        return found, self.capacity - space


def tokenised_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """One row per piece of each document (``_id``, ``_text`` of ``docs``); the ids themselves stay in the worker."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for part in parts:
            ids, texts, rows = part.column(0), part.column(1), []
            for i, text in enumerate(texts):
                rows += [(i, k, *piece) for k, piece in enumerate(pieces_of(encode(text.as_py() or "") + tail, length))]
            at = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at[:, 0])), pa.array(at[:, 1].astype(np.int32)), pa.array(at[:, 2]), pa.array(at[:, 3]), pa.array(at[:, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = T.StructType([T.StructField("doc_id", docs.schema["_id"].dataType), T.StructField("piece", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]])
    return docs.mapInArrow(batches, schema)


def pack(pieces: DataFrame, tasks: int, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``length``.

    Pieces are dealt by hash over ``tasks`` tasks, which pack their own in a seeded random order (best fit
    over a bounded number of open bins wants sizes mixed, not sorted). A task streams its pieces and holds only its open
    bins, so its memory doesn't depend on the input; the order is fixed by a sort, so a task that runs again gives
    the same sequences.
    """

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, fit = TaskContext.get().partitionId() << 40, BestFit(length, open_bins)
        for part in parts:
            at = np.array([fit.place(n) for n in part.column("length").to_pylist()], np.int64).reshape(-1, 2)
            columns = [*part.columns, pa.array(at[:, 0] + base), pa.array(at[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "sequence_id", "offset"])

    key = F.xxhash64("doc_id", "piece", F.lit(11))
    dealt = pieces.repartition(tasks, "doc_id", "piece").sortWithinPartitions(key, "doc_id", "piece", "length", "ids_crc32")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    length: int = LENGTH,
    end_id: int = 0,
    open_bins: int = OPEN_BINS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenise every document, end it with ``end_id``, and pack the pieces into sequences of at most ``length`` tokens.

    Returns per piece ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``; offsets within a sequence are
    gapless from zero. Null and empty texts have the end id alone. Only documents over ``length`` tokens are cut, into
    full pieces after a first one that may be shorter. Repeated rows are packed each on their own, a null id stays
    null, other columns are ignored whatever their names, and an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    tasks = max(1, round(docs.count() / DOCS_PER_TASK))
    return pack(tokenised_pieces(slim, tokenizer or default_tokenizer(), length, end_id), tasks, length, open_bins)


