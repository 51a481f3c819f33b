"""Best-fit packing by exact-complement hashing.

What is packed depends on lengths only, so the plan is made from the histogram of
piece lengths, which never has more entries than a sequence has tokens: a small
table, whatever the corpus. Combinations of one, two and three lengths are looked up by their sum and
consumed while there are pieces of them, what is left goes best-fit. The plan says, for each length, which ranks go to
which sequences; pieces get their rank within their length by salted parts.
"""

from __future__ import annotations

import array
import bisect
import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, slices, kept_by_worker, salted_rank, stored

CAPACITY = 2048
END_ID = 0
#: Documents that are packed together where their order counts.
RUN_DOCS = 8_192

# --- token ids ------------------------------------------------------------

#: How byte-level BPE splits a text into words.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of which both libraries are sure to know the same classes, and runs of blanks that both can read.
_UNSURE = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\u024f]|\\s{1000}")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed, else the next one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, more = {}, 256
    for byte in range(256):
        letters[chr(byte if byte in shown else more)] = byte
        more += byte not in shown
    return letters


class Encoder:
    """Ids of texts as little-endian 32-bit bytes.

    The tokenizer file rules. Where it is a plain byte-level BPE, tiktoken with the
    same vocabulary gives the same ids several times faster, so it takes all texts of
    ordinary characters without special tokens; the others go to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._same_by_ranks()

    def _same_by_ranks(self):
        import tiktoken

        told = json.loads(self.tokenizer.to_str())
        model, split = told["model"], told["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and told["normalizer"] is None
        options = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        ids = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", ())]
        if not plain or model["type"] != "BPE" or options or None in ids or ids != sorted(ids):
            return None
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in self.special}
        return tiktoken.Encoding("ranks", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or _UNSURE.search(text) or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return array.array("I", ids).tobytes()


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, position: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and position if named: each document's ids and the end id, cut only where longer than capacity.

    The first piece of a longer document is the shorter one. A null text is empty;
    rows with null or repeated ids are documents of their own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_by_worker(f"encoder {tokenizer_path}", lambda: Encoder(tokenizer_path))
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in slices(batches, "text"):
            out: list[list[int | None]] = [[] for _ in names]
            places = batch.column(position).to_pylist() if position else [None] * len(batch)
            for doc_id, text, place in zip(batch.column("doc_id").to_pylist(), column_bytes(batch, "text"), places, strict=True):
                ids = encoder.encode((text or b"").decode("utf-8", "replace")) + end
                size = len(ids) // 4
                stops = range(size % capacity or capacity, size + 1, capacity) if size > capacity else (size,)
                start = 0
                for piece, stop in enumerate(stops):
                    row = (doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), place)
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
                    start = stop
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *([position] if position else [])]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *names[5:])
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + (f", {position} long" if position else ""))


# --- the plan -------------------------------------------------------------


class SumIndex:
    """Single, pair and triple combinations of the lengths that are there, by their sum.

    A combination is listed once, its longest length first, the most even ones before the others: those use up the fewest
    short pieces, which alone can fill the gaps that are left in the end. What is listed under a sum is
    found when it is first asked for; `left` says what is still available of each length.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            if not 1 <= length <= capacity:
                raise ValueError(f"no piece of length {length} fits {capacity}")
            self.left[length] = n
        self.lengths = np.nonzero(self.left)[0]
        self._there = self.left > 0
        self._pairs: dict[int, np.ndarray] = {}

    def pairs(self, total: int, longest: int) -> list[int]:
        """The longer lengths a <= longest of the available pairs (a, total - a)."""
        if total not in self._pairs:
            low, high = np.searchsorted(self.lengths, ((total + 1) // 2, total))
            a = self.lengths[low:high]
            self._pairs[total] = a[self._there[total - a]]
        a = self._pairs[total]
        a = a[: np.searchsorted(a, longest, side="right")]
        return a[(self.left[a] > 0) & (self.left[total - a] > 0)].tolist()

    def fillers(self, gap: int, longest: int) -> Iterator[tuple[int, ...]]:
        """Combinations of one, two and three lengths up to `longest` that fill the gap exactly, of what is available when they are asked for."""
        if gap <= longest and self.left[gap]:
            yield (gap,)
        for a in self.pairs(gap, longest):
            yield a, gap - a
        low, high = np.searchsorted(self.lengths, (-(-gap // 3), min(gap - 2, longest) + 1))
        for a in self.lengths[low:high].tolist():
            if self.left[a]:
                for b in self.pairs(gap - a, a):
                    yield a, b, gap - a - b


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, copies) of the sequences that hold `counts` pieces of each length.

    Lengths from the longest: its gap is filled exactly by one, two or three
    available lengths, found by their sums, as many copies at once as there are; what
    has no exact partner is packed best-fit, longest first. Exact fillings can do harm where lengths are
    spread evenly up to the capacity and each long piece has just one partner: should best fit for all pieces need
    fewer sequences, it is taken.
    """
    exact = _exact_bins(counts, capacity)
    plain = _best_fit(SumIndex(counts, capacity).left, capacity)
    return min(exact, plain, key=lambda bins: sum(copies for _, copies in bins))


def _exact_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    index = SumIndex(counts, capacity)
    left = index.left
    bins: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> None:
        need = Counter(lengths)
        copies = min(int(left[x]) // n for x, n in need.items())
        if copies:
            bins.append((lengths, copies))
            for x, n in need.items():
                left[x] -= n * copies

    for length in index.lengths[::-1].tolist():
        if length == capacity:
            take((length,))
            continue
        for filler in index.fillers(capacity - length, length) if left[length] else ():
            take((length, *filler))
            if not left[length]:
                break
    return bins + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    gaps: list[int] = []

    def put(gap: int, lengths: tuple[int, ...], copies: int) -> None:
        if not open_bins[gap]:
            bisect.insort(gaps, gap)
        open_bins[gap].append((lengths, copies))

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, (length,) * each, n // each)
                if n % each:
                    put(capacity - n % each * length, (length,) * (n % each), 1)
                break
            gap = gaps[at]
            lengths, copies = open_bins[gap].pop()
            if not open_bins[gap]:
                gaps.pop(at)
            used = min(n, copies)
            if copies > used:
                put(gap, lengths, copies - used)
            put(gap - length, (*lengths, length), used)
            n -= used
    return [group for groups in open_bins.values() for group in groups]


def _places(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset) in the order of ranks."""
    used: dict[int, int] = defaultdict(int)
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    base = 0
    for lengths, copies in bins:
        offset = 0
        for length in lengths:
            rows[length].append((used[length], base, offset))
            used[length] += copies
            offset += length
        base += copies
    return {length: np.array(r, dtype=np.int64) for length, r in rows.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of docs.

    No row is dropped: null texts, null and repeated ids are packed as
    documents of their own (repeated rows give rows that differ in their place only).
    Sequences are numbered from 0. An empty table gives an empty result; other
    columns are not read.
    """
    pieces = stored(token_pieces(docs, tokenizer_path, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(plan_bins(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for one in np.unique(length):
                at, rows = np.nonzero(length == one)[0], places[int(one)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                sequence[at], offset[at] = row[:, 1] + rank[at] - row[:, 0], row[:, 2]
            columns = [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    if not counts:
        return docs.sparkSession.createDataFrame([], schema)
    sizes = F.element_at(F.array(*[F.lit(counts.get(n, 0)) for n in range(1, capacity + 1)]), F.col("length").cast("int"))
    ranked = salted_rank(pieces, "length", ["doc_id", "piece", "ids_crc32"], "rank", sizes)
    return ranked.select(*names, "rank").mapInArrow(place, schema)


def pack_in_order(docs: DataFrame, tokenizer_path: str, position: str, capacity: int = CAPACITY, run_docs: int = RUN_DOCS) -> DataFrame:
    """What pack gives, with sequences in the order of `position`, a whole number from 0 without gaps.

    Each run of run_docs positions is packed by a plan of its own, in one task's memory, and its sequences
    come after those of the run before. Within a run pieces of equal length fill their places in the order of
    position, and sequences are numbered by the smallest position in them.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(table: pa.Table) -> pa.Table:
        length, at, piece = (table.column(c).to_numpy() for c in ("length", position, "piece"))
        values, n = np.unique(length, return_counts=True)
        places = _places(plan_bins(dict(zip(values.tolist(), n.tolist(), strict=True)), capacity))
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.lexsort((piece, at, length))
        for one, rows in zip(values.tolist(), np.split(order, np.cumsum(n)[:-1]), strict=True):
            rank, table_of = np.arange(len(rows)), places[one]
            row = table_of[np.searchsorted(table_of[:, 0], rank, side="right") - 1]
            sequence[rows], offset[rows] = row[:, 1] + rank - row[:, 0], row[:, 2]
        first = np.full(sequence.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, sequence, at)
        number = np.empty(len(first), np.int64)
        number[np.argsort(first, kind="stable")] = np.arange(len(first))
        columns = [*(table.column(c) for c in ("run", *names)), pa.array(number[sequence]), pa.array(offset)]
        return pa.Table.from_arrays(columns, names=["run", *names, "own", "offset"])

    pieces = token_pieces(docs, tokenizer_path, capacity, position).withColumn("run", F.expr(f"{position} div {int(run_docs)}"))
    schema = "run long, doc_id long, piece int, start long, length long, ids_crc32 long, own long, offset long"
    placed = stored(pieces.groupBy("run").applyInArrow(place, schema), "placed")
    base, bases = 0, []
    for r in sorted(placed.groupBy("run").agg((F.max("own") + 1).alias("n")).collect()):
        bases.append((r["run"], base))
        base += r["n"]
    before = F.broadcast(docs.sparkSession.createDataFrame(bases, "run long, base long"))
    return placed.join(before, "run").select(*names, (F.col("base") + F.col("own")).alias("sequence_id"), "offset")
