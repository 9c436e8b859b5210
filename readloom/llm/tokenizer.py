"""Byte-level BPE of a public vocabulary, without a regular expression.

Texts of a batch are read as one array of code points. Each code point gets a class from a table; looking one or two
characters ahead turns classes into the symbols of a small automaton whose states say which kind of piece is open.
Every symbol is a function from states to states. These functions form a finite monoid, so the states at all
positions come from an associative scan: rows of the text are composed side by side, row totals are scanned, and the
entry state of each row is applied to its prefixes. A piece starts where state and symbol say so; its bytes go
through the pair merges once and then come from a cache. Byte offsets of the pieces are kept.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from readloom.plans.runtime import spread

#: Where the public vocabularies lie; a parameter of every function, never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Text bytes worked on at once (a longer document is worked on alone, as a whole).
CHUNK_BYTES = 2 << 20
#: Distinct pieces whose ids a worker remembers; when full it starts anew, which costs time only.
CACHE_PIECES = 400_000

# Symbols: letter, number, other, quote of a contraction with one or two letters, inner space, last blank, last other space.
L, N, P, A1, A2, W, SP, WX = range(8)
# States: open piece of letters, numbers, others, spaces, a blank that takes what follows, nothing; letters left of a contraction.
S_L, S_N, S_P, S_W, S_SP, S_NONE, S_C2, S_C1 = range(8)
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, sym: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts at this character."""
    if sym == W:
        return S_W, state != S_W
    if sym == SP:
        return S_SP, True
    if sym == WX:
        return S_NONE, True
    if state == S_C2:
        return S_C1, False
    if state == S_C1:
        return S_NONE, False
    if sym == L:
        return S_L, state not in (S_L, S_SP)
    if sym == N:
        return S_N, state not in (S_N, S_SP)
    if state in (S_P, S_SP):
        return S_P, False
    return (S_P if sym == P else S_C1 if sym == A1 else S_C2), True


@lru_cache(1)
def _classes() -> np.ndarray:
    t = np.full(0x110000, P, np.uint8)
    kind = {"L": L, "N": N}
    t[:] = [kind.get(unicodedata.category(chr(i))[0], P) for i in range(0x110000)]
    t[_SPACES] = W
    return t


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each symbol (8..15: first of a text), composition table, image of each state, piece starts."""
    fn = [tuple(_step(s, y)[0] for s in range(8)) for y in range(8)]
    fn += [(_step(S_NONE, y)[0],) * 8 for y in range(8)]
    ids: dict[tuple, int] = {tuple(range(8)): 0}
    for f in fn:
        ids.setdefault(f, len(ids))
    todo = list(ids)
    while todo:
        f = todo.pop()
        for g in fn:
            h = tuple(g[x] for x in f)
            if h not in ids:
                ids[h] = len(ids)
                todo.append(h)
    k = len(ids)
    every = list(ids)
    assert k < 256
    mul = np.array([[ids.get(tuple(g[x] for x in f), 0) for g in every] for f in every], np.uint8)
    image = np.array(every, np.uint8)
    starts = np.array([[_step(s, y)[1] for y in range(8)] for s in range(8)] + [[True] * 8] * 8, bool)
    return np.array([ids[f] for f in fn], np.uint8), mul.reshape(-1), image.reshape(-1), starts.reshape(-1)


def _scan(f: np.ndarray) -> np.ndarray:
    """State after each character: prefixes of composed functions, applied to the state at the very start."""
    _, mul, image, _ = _monoid()
    k = int(len(mul) ** 0.5)
    n = len(f)
    width = max(1, int(n**0.5) // 2)
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint8)
    grid[:n] = f
    cols = np.ascontiguousarray(grid.reshape(rows, width).T)
    for j in range(1, width):
        cols[j] = mul[cols[j - 1].astype(np.intp) * k + cols[j]]
    # Inclusive scan of the row totals by doubling; composition is associative.
    total = cols[-1].copy()
    d = 1
    while d < rows:
        total[d:] = mul[total[:-d].astype(np.intp) * k + total[d:]]
        d *= 2
    entry = np.full(rows, S_NONE, np.intp)
    entry[1:] = image[total[:-1].astype(np.intp) * 8 + S_NONE]
    return image[cols.astype(np.intp) * 8 + entry].T.reshape(-1)[:n]


def piece_starts(points: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point; ``text_at`` are the positions where (non-empty) texts start."""
    n = len(points)
    sym = _classes()[points]
    last = np.zeros(n, bool)
    last[-1] = True
    last[text_at[text_at > 0] - 1] = True
    space = sym == W
    final = np.zeros(n, bool)
    final[:-1] = space[:-1] & ~space[1:]
    final &= ~last
    at = np.flatnonzero(final)
    sym[at] = np.where(points[at] == 32, SP, WX)
    at = np.flatnonzero(points == 39)
    if len(at):
        ends = np.append(np.flatnonzero(last), n)
        room = ends[np.searchsorted(ends, at)] - at  # characters of the same text behind the quote
        c1 = np.where(room >= 1, points[np.minimum(at + 1, n - 1)], 0)
        c2 = np.where(room >= 2, points[np.minimum(at + 2, n - 1)], 0)
        sym[at[np.isin(c1, [ord(x) for x in "stmd"])]] = A1
        two = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (c1 == ord(a)) & (c2 == ord(b))
        sym[at[two]] = A2
    fn, _, _, starts = _monoid()
    first = sym.copy()
    first[text_at] += 8
    state = _scan(fn[first])
    before = np.empty(n, np.intp)
    before[0], before[1:] = S_NONE, state[:-1]
    out = starts[before * 8 + sym]
    out[text_at] = True
    return out


class Merger(dict):
    """Ids of a piece by pair merging, remembered.

    Two neighbours merge if their bytes together are a token; which pairs do is worked out once from the vocabulary,
    so that a merge looks up a number and never builds bytes. Merged pieces keep the ranks of their neighbours up to date
    instead of looking at all pairs again.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pairs = {
            a << 20 | b: r for t, r in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None
        }
        self.singles = [ranks[bytes([b])] for b in range(256)]

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE_PIECES:
            self.clear()
        r = self.ranks.get(piece)
        out = self[piece] = (r,) if r is not None else self.merge(piece)
        return out

    def merge(self, piece: bytes) -> tuple[int, ...]:
        if len(piece) > 200:
            return self.merge_long(piece)
        get, none = self.pairs.get, 1 << 60
        single = self.singles
        ids = [single[b] for b in piece]
        near = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while near:
            r = min(near)
            if r == none:
                break
            i = near.index(r)
            ids[i] = r
            del ids[i + 1], near[i]
            if i:
                near[i - 1] = get(ids[i - 1] << 20 | r, none)
            if i < len(near):
                near[i] = get(r << 20 | ids[i + 1], none)
        return tuple(ids)

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges from a heap, for pieces of any length."""
        n, ranks = len(piece), self.ranks
        end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = right[i] if end[i] else n
            if not end[i] or j >= n or end[j] != e:
                continue
            end[i], end[j] = e, 0
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (h := left[i]) >= 0 and (r := ranks.get(piece[h:e])) is not None:
                heapq.heappush(heap, (r, h, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = right[i]
        return tuple(out)


@lru_cache(4)
def merger(path: str) -> Merger:
    return Merger(path)


def encode_bytes(raw: bytes, offsets: np.ndarray, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as one UTF-8 buffer with ``offsets``: ids, id counts per text, piece byte offsets, id counts per piece."""
    n_texts = len(offsets) - 1
    if not raw:
        none = np.zeros(0, np.int64)
        return none.astype(np.int32), np.zeros(n_texts, np.int64), none, none
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    size = np.frombuffer(raw, np.uint8)
    byte_at = np.arange(len(size)) if len(points) == len(size) else np.flatnonzero((size & 0xC0) != 0x80)
    full = np.flatnonzero(np.diff(offsets) > 0)
    text_at = np.searchsorted(byte_at, offsets[full])
    at = byte_at[piece_starts(points, text_at)]
    cut = at.tolist()
    cut.append(len(size))
    got = list(map(merger(path).__getitem__, [raw[a:b] for a, b in itertools.pairwise(cut)]))
    per = np.fromiter(map(len, got), np.int64, len(got))
    ids = np.fromiter(itertools.chain.from_iterable(got), np.int32, int(per.sum()))
    piece_text = np.searchsorted(at, offsets)  # pieces before each text
    before = np.concatenate([[0], np.cumsum(per)])
    return ids, np.diff(before[piece_text]), at, per


def _chunks(col: pa.Array):
    """Runs of texts of about CHUNK_BYTES: first row, row after the last, bytes and offsets from 0. Nulls are empty."""
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, 8 * col.offset)
    data = col.buffers()[2]
    ok = col.is_valid().to_numpy(zero_copy_only=False)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, "right")) - 1)
        size = np.where(ok[i:j], np.diff(off[i : j + 1]), 0)
        raw = data[int(off[i]) : int(off[j])].to_pybytes() if data is not None else b""
        if size.sum() != len(raw):  # bytes under a null slot
            raw = b"".join(raw[a - off[i] : b - off[i]] for a, b, v in zip(off[i:j], off[i + 1 : j + 1], ok[i:j]) if v)
        yield i, j, raw, np.concatenate([[0], np.cumsum(size)])
        i = j


def encode_text(text: str, path: str = VOCABULARY) -> list[int]:
    raw = text.encode()
    return encode_bytes(raw, np.array([0, len(raw)]), path)[0].tolist()


def decode_ids(ids: list[int], path: str = VOCABULARY) -> str:
    by_id = _by_id(path)
    return b"".join(by_id[i] for i in ids).decode("utf-8", "replace")


@lru_cache(2)
def _by_id(path: str) -> dict[int, bytes]:
    return {v: k for k, v in merger(path).ranks.items()}


def encode(df, id_col: str, text: str, path: str = VOCABULARY, offsets: bool = False):
    """``id, ids`` (and with ``offsets`` also ``id_starts``, the byte where each id's piece starts) of every row.

    Null and empty texts both come out with an empty list; the row is never dropped. Strings that look like special
    tokens are ordinary text. A text of any length is encoded whole. Other columns are not read.
    """
    cols = spread(df.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t")))

    def run(batches):
        for b in batches:
            for i, j, raw, off in _chunks(b.column(1)):
                ids, n, at, per = encode_bytes(raw, off, path)
                bounds = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                out = [b.column(0).slice(i, j - i), pa.ListArray.from_arrays(bounds, pa.array(ids))]
                if offsets:
                    where = np.repeat(at, per) - np.repeat(off[:-1], n)
                    out.append(pa.ListArray.from_arrays(bounds, pa.array(where, pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "ids", "id_starts"][: len(out)])

    kind = cols.schema["i"].dataType.simpleString()
    return cols.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", id_starts array<int>" * offsets)


def lengths(df, id_col: str, text: str, path: str = VOCABULARY):
    """``id, n_ids`` of every row; null and empty texts have 0. The ids themselves never leave the worker."""
    cols = spread(df.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t")))

    def run(batches):
        for b in batches:
            for i, j, raw, off in _chunks(b.column(1)):
                n = encode_bytes(raw, off, path)[1]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64())], names=[id_col, "n_ids"])

    return cols.mapInArrow(run, f"`{id_col}` {cols.schema['i'].dataType.simpleString()}, n_ids bigint")
