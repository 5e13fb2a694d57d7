"""Byte-level BPE: texts to token ids and back, in numpy.

A text is cut at single spaces into pieces that can't share a token with their neighbours, pieces are looked up in a cache, and
only unseen ones are split by the pattern and merged. Their byte sequences lie as rows of padded matrices, one matrix per band
of lengths. Each round, every row merges its leftmost pair of least rank and is compacted by one column; ranks of pairs come
from an open-addressed hash table.
"""
from __future__ import annotations

import base64
import hashlib
import itertools
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.llm.batches import over_texts, ragged
from braid.llm.common import documents, text_or_empty

NO_RANK = np.int32(2**31 - 1)
#: Columns of a matrix at most; a longer row gets a matrix of its own, with a row for each block of so many bytes.
BLOCK_BYTES = 512
#: Pieces, and characters of them, that a worker remembers before it starts anew.
CACHE_PIECES, CACHE_CHARS = 250_000, 16_000_000
#: The characters with the White_Space property.
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


class PairTable:
    """Ranks of pairs of ids by hash; collisions go to the next free slot."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(8 * len(rank) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NO_RANK, np.int32)
        keys = self.key(left, right)
        slots, todo, self.probes = self.slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = self.keys[slots[todo]] == -1
            _, first = np.unique(slots[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[slots[put]], self.ranks[slots[put]] = keys[put], rank[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slots[todo] = (slots[todo] + 1) & self.mask

    @staticmethod
    def key(left, right):
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def slot(self, keys):
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NO_RANK where the pair has none or an id is below 0."""
        keys = np.where((left < 0) | (right < 0), np.int64(-2), self.key(left, right))
        slots = self.slot(keys)
        out = np.full(keys.shape, NO_RANK, np.int32)
        for _ in range(self.probes):
            found = self.keys[slots]
            hit = found == keys
            out[hit] = self.ranks[slots[hit]]
            if not ((found != -1) & ~hit).any():
                break
            slots = (slots + 1) & self.mask
        return out


class Vocabulary:
    """The ranks of a tiktoken file: bytes of each id, ids of bytes and of pairs."""

    def __init__(self, file: bytes):
        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line)}
        size = max(self.ids.values()) + 1
        tokens = [b""] * size
        for token, i in self.ids.items():
            tokens[i] = token
        self.tokens = tokens
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ids[t[:k]], self.ids[t[k:]], i) for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids]
        left, right, rank = np.array(pairs, np.int32).reshape(-1, 3).T
        self.pair = PairTable(left, right, rank)
        self.pool, self.starts, self.lengths = pooled(tokens)
        self.decimals = pooled([b"%d," % i for i in range(size)])


def pooled(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


@lru_cache(4)
def vocabulary(file: bytes) -> Vocabulary:
    return Vocabulary(file)


def merged_matrix(rows: np.ndarray, pair: PairTable) -> list[np.ndarray]:
    """The merged ids of each row; rows are padded at their ends with -1."""
    out: list = [None] * len(rows)
    where = np.arange(len(rows))
    ranks = pair(rows[:, :-1], rows[:, 1:])
    while True:
        at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)  # the leftmost of equals
        best = np.take_along_axis(ranks, at[:, None], 1)[:, 0] if ranks.shape[1] else np.full(len(rows), NO_RANK)
        going = best != NO_RANK
        if not going.all():
            for i in np.flatnonzero(~going):
                row = rows[i]
                out[where[i]] = row[row >= 0]
            rows, ranks, where, at, best = rows[going], ranks[going], where[going], at[going], best[going]
            if not len(rows):
                return out
        n = np.arange(len(rows))
        columns = np.arange(rows.shape[1] - 1)
        rows = np.take_along_axis(rows, columns + (columns > at[:, None]), 1)
        rows[n, at] = best
        columns = columns[:-1]
        ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), 1)
        if ranks.shape[1]:
            before, after = at > 0, at < ranks.shape[1]
            ranks[n[before], at[before] - 1] = pair(rows[n[before], at[before] - 1], best[before])
            ranks[n[after], at[after]] = pair(best[after], rows[n[after], at[after] + 1])


def merged_blocks(ids: np.ndarray, pair: PairTable, width: int) -> np.ndarray:
    """The same rounds for one long row, whose matrix has a row for each block of it: a round finds the block of least rank, then
    the pair, and compacts the one block that loses a token. A pair over two blocks belongs to the left one."""
    blocks = -(-len(ids) // width)
    rows, ranks = np.full((blocks, width), -1, np.int32), np.full((blocks, width), NO_RANK, np.int32)
    rows.ravel()[: len(ids)] = ids
    ranks.ravel()[: len(ids) - 1] = pair(ids[:-1], ids[1:])
    least = ranks.min(axis=1)
    size = [min(width, len(ids) - i * width) for i in range(blocks)]
    after, before = list(range(1, blocks + 1)), list(range(-1, blocks - 1))  # neighbours that aren't empty
    while (best := least[(b := int(least.argmin()))]) != NO_RANK:
        at = int(ranks[b].argmin())  # the leftmost of equals, in the leftmost block of equals
        c, k = (b, at + 1) if at + 1 < size[b] else (after[b], 0)
        size[c] -= 1
        n = size[c]
        for x, none in ((rows, -1), (ranks, NO_RANK)):
            x[c, k:n] = x[c, k + 1 : n + 1]
            x[c, n] = none
        rows[b, at] = best
        if not n:
            if before[c] >= 0:
                after[before[c]] = after[c]
            if after[c] < blocks:
                before[after[c]] = before[c]
        right = rows[b, at + 1] if at + 1 < size[b] else rows[after[b], 0] if after[b] < blocks else -1
        d, j = (b, at - 1) if at else (before[b], size[before[b]] - 1)
        left = rows[d, j] if d >= 0 else -1
        ranks[b, at], new = pair(np.array([best, left]), np.array([right, best]))
        if d >= 0:
            ranks[d, j] = new
        for i in {b, c, d} - {-1}:
            least[i] = ranks[i].min()
    return rows[rows >= 0]


def merged(parts: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    """Ids of each part: the part's own if it is a token, else by merges of its bytes."""
    out: list = [None] * len(parts)
    bands: dict[int, list[int]] = {}
    for i, p in enumerate(parts):
        whole = v.ids.get(p)
        if whole is not None:
            out[i] = np.array([whole], np.int32)
        elif len(p) > BLOCK_BYTES:
            out[i] = merged_blocks(v.byte_ids[np.frombuffer(p, np.uint8)], v.pair, BLOCK_BYTES)
        else:
            bands.setdefault(-(-len(p) // 4) if len(p) <= 32 else 8 + (len(p) - 1).bit_length(), []).append(i)
    for members in bands.values():
        flat, starts, lengths = pooled([parts[i] for i in members])
        wide = int(lengths.max())
        column = np.arange(wide)
        rows = np.full((len(members), wide), -1, np.int32)
        rows[column < lengths[:, None]] = v.byte_ids[flat]
        for i, ids in zip(members, merged_matrix(rows, v.pair)):
            out[i] = ids
    return out


class Pieces(dict):
    """Numbers of pieces, given in the order they are first met; -1 for those that white space ties to their neighbours."""

    def __init__(self, lead: str, new: list[str], numbers):
        super().__init__()
        self.lead, self.new, self.numbers = lead, new, numbers

    def __missing__(self, piece: str) -> int:
        if not piece or self.lead and (piece[0] in WHITE or piece[-1] in WHITE):
            return -1
        self.new.append(self.lead + piece)
        n = self[piece] = next(self.numbers)
        return n


class Encoder:
    """encode() of lists of texts, decode() of ids."""

    def __init__(self, file: bytes, pattern: str):
        import regex

        self.v, self.split = vocabulary(file), regex.compile(pattern).findall
        self.reset()

    def reset(self) -> None:
        self.new: list[str] = []
        self.chars, numbers = 0, itertools.count()
        self.spaced, self.plain = Pieces(" ", self.new, numbers), Pieces("", self.new, numbers)
        self.flat, self.starts, self.lengths = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def numbered(self, text: str) -> list[int]:
        first, *rest = text.split(" ")
        if first and (not rest or first[-1] not in WHITE):
            spaced = self.spaced
            out = [self.plain[first]]
            out += [spaced[p] for p in rest]
            if -1 not in out:
                return out
        return [self.plain[c] for c in CHUNK.findall(text)]

    def learned(self) -> None:
        """Encodes the pieces met since the last call."""
        new = self.new
        if not new:
            return
        numbers: dict[str, int] = {}
        picks, counts = [], []
        for piece in new:
            parts = self.split(piece)
            counts.append(len(parts))
            picks += [numbers.setdefault(p, len(numbers)) for p in parts]
        ids = merged([p.encode("utf-8", "replace") for p in numbers], self.v)
        lengths = np.array([len(x) for x in ids], np.int64)
        flat, n = ragged(np.concatenate(ids), np.cumsum(lengths) - lengths, lengths, np.array(picks, np.int64))
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)]
        starts = np.concatenate([[0], ends[:-1]])
        self.starts = np.concatenate([self.starts, starts + len(self.flat)])
        self.lengths = np.concatenate([self.lengths, ends - starts])
        self.flat = np.concatenate([self.flat, flat])
        self.chars += sum(map(len, new))
        new.clear()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of each text. Texts that are null are empty."""
        numbers = [self.numbered(t) if t else [] for t in texts]
        self.learned()
        pick = np.array([x for n in numbers for x in n], np.int64)
        ids, n = ragged(self.flat, self.starts, self.lengths, pick)
        sums = np.concatenate([[0], np.cumsum(n)])
        ends = sums[np.cumsum([len(x) for x in numbers])] if numbers else np.empty(0, np.int64)
        counts = np.diff(ends, prepend=0)
        if len(self.starts) > CACHE_PIECES or self.chars > CACHE_CHARS:
            self.reset()
        return ids, counts

    def _joined(self, ids, counts, pool) -> list[memoryview]:
        flat, n = ragged(*pool, ids)
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        view = memoryview(flat)
        return [view[a:b] for a, b in zip(ends, ends[1:])]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[memoryview]:
        return self._joined(ids, counts, (self.v.pool, self.v.starts, self.v.lengths))

    def decimal(self, ids: np.ndarray, counts: np.ndarray) -> list[memoryview]:
        """Decimal ids joined by commas."""
        return [x[:-1] for x in self._joined(ids, counts, self.v.decimals)]


@lru_cache(2)
def encoder(file: bytes, pattern: str) -> Encoder:
    """One per worker and vocabulary, so that its cache serves the tasks to come."""
    return Encoder(file, pattern)


def rank_file(path: str | None = None) -> tuple[bytes, str]:
    """A vocabulary file, read on the driver and sent along with the tasks (its size is fixed), and the pattern."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, digests: bool = False, ids: bool = True) -> DataFrame:
    """One row per input row: id_col, n_tokens, ids (if asked for), ids_sha256 and decoded_sha256 (if asked for).

    decoded_sha256 is that of the bytes which the ids decode to. Null texts are empty and have no ids. Texts of any length are
    encoded whole. Rows are encoded one by one, so repeated rows and null ids stay; an empty table gives an empty result; other
    columns are ignored. Nothing is shuffled. Texts are cut at spaces before the pattern is applied, which only the default
    pattern allows; another one is refused.
    """
    file, own = rank_file(path)
    if pattern not in (None, own):
        raise ValueError("only public_tokenizers.PATTERN may be applied to texts that are cut at spaces")
    pattern = own

    def make():
        coder = encoder(file, pattern)

        def f(batch):
            flat, counts = coder.encode(batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array(counts, pa.int64())]
            if ids:
                columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), flat.astype(np.int32)))
            if digests:
                columns += [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (coder.decimal(flat, counts), coder.decode(flat, counts))]
            return pa.RecordBatch.from_arrays(columns, names)

        return f

    names = [id_col, "n_tokens", *["ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests]
    rows = df.select(F.col(id_col), text_or_empty(text_col).alias("__text"))
    kinds = {"ids": "array<int>", "n_tokens": "long", id_col: rows.schema[0].dataType.simpleString()}
    return over_texts(rows, "__text", make, ", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names))


def decoded(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id_col, decoded binary): the bytes of each row's ids. A null list gives no bytes; an unknown id is an error."""
    file, pattern = rank_file(path)

    def run(batches):
        coder = encoder(file, pattern)
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            flat = np.array([i for x in lists for i in x], np.int64)
            if len(flat) and not (0 <= flat.min() and flat.max() < len(coder.v.tokens)):
                raise ValueError("an id outside the vocabulary")
            out = coder.decode(flat, np.array([len(x) for x in lists], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bytes(x) for x in out], pa.binary())], [id_col, "decoded"])

    rows = df.select(id_col, F.col(ids_col).alias("__ids"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, decoded binary")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir), digests=True, ids=False)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded(docs, digests=True)
