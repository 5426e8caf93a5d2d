"""SentencePiece encoding and decoding of whole texts by a table of distinct chunks.

A model whose pieces never go on past a white-space marker that follows another character cuts every text into chunks
``markers + other characters`` that are segmented without looking at their neighbours. A task takes the chunks of a batch,
looks each up in its table of distinct chunks, segments the ones it has not met, and joins the ids back by position. The
segmentation itself is the model's own: the best-scored neighbouring pair, leftmost first, merges until none is a piece.
"""
from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .hashing import slices

MARK = "▁"               # the marker that stands for a space
KNOWN_BYTES = 128_000_000      # bytes of chunks and ids that a task's table may hold before it starts afresh
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6    # fixed values of the model format: kinds of pieces
OTHER = 1 << 21                # symbols from here on are characters that are no pieces
NONE = 1 << 62                 # what two symbols that do not merge become
GONE = -1
LONG = 64                      # symbols of a chunk that is segmented in step with others of its length; longer ones by a queue
TOGETHER = 8192                # chunks of one length taken in step
CHUNK, WHOLE = re.compile(rb" +[^ ]*"), re.compile(rb".+", re.DOTALL)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at:at + size]
        at += size


class Model:
    """The vocabulary of a model file: pieces, their scores and kinds.

    Only pair-merging models with byte fallback, a leading marker and texts taken as they are can be read; others raise
    ``ValueError``."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        rows = [dict(_fields(v)) for k, v in fields if k == 1]
        trainer = dict(x for k, v in fields if k == 2 for x in _fields(v))
        normal = dict(x for k, v in fields if k == 3 for x in _fields(v))
        # fixed field numbers of the model format: 3 kind of model, 24 white space as suffix, 35 byte fallback; 2 character map,
        # 3 leading marker, 4 removal of extra spaces, 5 spaces as markers
        if (trainer.get(3, 1) != 2 or trainer.get(24, 0) or not trainer.get(35, 0) or normal.get(2, b"") or not normal.get(3, 1)
                or normal.get(4, 1) or not normal.get(5, 1)):
            raise ValueError(f"{path}: this kind of model is not supported")
        self.pieces = [r.get(1, b"").decode() for r in rows]
        self.kinds = np.array([r.get(3, NORMAL) for r in rows], np.int8)
        if not set(self.kinds.tolist()) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: user-defined and unused pieces are not supported")
        scores = np.array([struct.unpack("<f", r.get(2, bytes(4)))[0] for r in rows], np.float32)
        _, order = np.unique(-scores, return_inverse=True)       # equal scores share a rank
        self.ids = {self.pieces[i]: i for i in np.flatnonzero(self.kinds == NORMAL).tolist()}
        self.ranks = {p: int(order[i]) for p, i in self.ids.items()}
        self.of_byte = np.zeros(256, np.int32)
        for i in np.flatnonzero(self.kinds == BYTE).tolist():
            self.of_byte[int(self.pieces[i][3:5], 16)] = i
        self.apart = not any(MARK in p.lstrip(MARK) for p in self.ids)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Every two neighbouring symbols that merge, as one number, and ``rank << 32 | piece`` of what they become."""
        def code(part: str) -> int | None:
            return self.ids.get(part, OTHER + ord(part) if len(part) == 1 else None)

        found = [(code(p[:i]), code(p[i:]), self.ranks[p] << 32 | n) for p, n in self.ids.items() for i in range(1, len(p))]
        table = np.array([((x << 23) + y, v) for x, y, v in found if x is not None and y is not None], np.int64).reshape(-1, 2)
        return table[:, 0], table[:, 1]


class Merges:
    """A hash table from pairs of symbols to what they merge into; ``NONE`` for pairs that do not."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1), np.full(1 << self.bits, NONE)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 23) + right
        at = self._slot(keys)
        out, met = self.values[at], self.keys[at]
        open_ = np.flatnonzero((met != keys) & (met != -1))
        out[met != keys] = NONE
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            met = self.keys[at[open_]]
            hit = met == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (met != -1)]
        return out


def lockstep(symbols: np.ndarray, merges: Merges) -> list[tuple[np.ndarray, np.ndarray]]:
    """Segments chunks of equally many symbols, a row each: every round merges each row's best pair, leftmost first, so the
    rows still open stay equally long. ``(row numbers, their final symbols)`` by the round they ended in."""
    rows, out = np.arange(len(symbols)), []
    value = merges(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(symbols), -1)
    while len(rows) and symbols.shape[1] > 1:
        at = (value >> 32).argmin(axis=1)
        best = value[np.arange(len(rows)), at]
        live = best != NONE
        if not live.all():
            out.append((rows[~live], symbols[~live]))
            rows, symbols, value, at, best = rows[live], symbols[live], value[live], at[live], best[live]
            if not len(rows):
                break
        width, line = symbols.shape[1], np.arange(len(rows))
        stay = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])          # all but the right one of the pair
        symbols = np.take_along_axis(symbols, stay, axis=1)
        symbols[line, at] = best & 0xFFFFFFFF
        value = np.take_along_axis(value, np.arange(width - 2) + (np.arange(width - 2) >= at[:, None]), axis=1)
        led = np.flatnonzero(at > 0)
        value[led, at[led] - 1] = merges(symbols[led, at[led] - 1], symbols[led, at[led]])
        followed = np.flatnonzero(at < width - 2)
        value[followed, at[followed]] = merges(symbols[followed, at[followed]], symbols[followed, at[followed] + 1])
    if len(rows):
        out.append((rows, symbols))
    return out


def queued(symbols: list[int], merges: Merges) -> np.ndarray:
    """The same for one chunk of any length, with a queue of its pairs."""
    n = len(symbols)
    known = dict(zip(merges.keys.tolist(), merges.values.tolist(), strict=True))
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = []

    def meet(i: int, j: int) -> None:
        value = known.get((symbols[i] << 23) + symbols[j])
        if value is not None:
            heapq.heappush(queue, (value >> 32, i, j, symbols[i], symbols[j], value & 0xFFFFFFFF))

    for i in range(n - 1):
        meet(i, i + 1)
    while queue:
        _, i, j, left, right, new = heapq.heappop(queue)
        if after[i] != j or symbols[i] != left or symbols[j] != right:
            continue
        symbols[i], symbols[j] = new, GONE
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            meet(i, k)
        if before[i] >= 0:
            meet(before[i], i)
    return np.array([x for x in symbols if x != GONE], np.int64)


class Table:
    """The distinct chunks a task has segmented, and the ids of each."""

    def __init__(self, model: Model):
        self.model, self.cut = model, (CHUNK if model.apart else WHOLE).findall
        self.merges = Merges(*model.pairs())
        self.of_char = np.arange(OTHER, OTHER + 0x110000)
        for p, i in model.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.flat = np.empty(0, np.int32)
        self.start, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.bytes = 0

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and where each chunk's ids start and how many they are."""
        symbols = self.of_char[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        cuts = np.searchsorted(sizes[order], np.arange(LONG + 2))
        done = []
        for n in range(1, LONG + 1):
            for a in range(cuts[n], cuts[n + 1], TOGETHER):
                these = order[a:min(a + TOGETHER, cuts[n + 1])]
                done += [(these[r], s) for r, s in lockstep(symbols[begin[these][:, None] + np.arange(n)], self.merges)]
        for i in order[cuts[LONG + 1]:]:
            done.append((np.array([i]), queued(symbols[begin[i]:begin[i] + sizes[i]].tolist(), self.merges)[None, :]))
        final = np.concatenate([s.ravel() for _, s in done])
        counts = np.empty(len(chunks), np.int64)
        place = np.empty(len(chunks), np.int64)
        at = 0
        for r, s in done:
            counts[r], place[r] = s.shape[1], at + np.arange(len(r)) * s.shape[1]
            at += s.size
        return self._bytes_for_others(final, place, counts)

    def _bytes_for_others(self, final: np.ndarray, place: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters that are no pieces become the ids of their bytes."""
        other = np.flatnonzero(final >= OTHER)
        if not len(other):
            return final.astype(np.int32), place, counts
        spelt = [chr(c).encode() for c in (final[other] - OTHER).tolist()]
        wide = np.ones(len(final), np.int64)
        wide[other] = [len(x) for x in spelt]
        to = np.concatenate([[0], np.cumsum(wide)])
        out = np.empty(to[-1], np.int32)
        out[to[:-1]] = np.where(final < OTHER, final, 0)
        n = wide[other]
        out[np.repeat(to[other] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = self.model.of_byte[np.frombuffer(b"".join(spelt), np.uint8)]
        return out, to[place], to[place + counts] - to[place]

    def learn(self, chunks: set[bytes]) -> None:
        ids, start, size = self.segment([c.decode("utf-8", "replace").replace(" ", MARK) for c in chunks])
        self.row.update(zip(chunks, range(len(self.row), len(self.row) + len(chunks)), strict=True))
        self.start, self.size = np.append(self.start, start + len(self.flat)), np.append(self.size, size)
        self.flat = np.append(self.flat, ids)
        self.bytes += sum(map(len, chunks)) + ids.nbytes + 120 * len(chunks)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, and where each text's ids start (one more entry than texts)."""
        if self.bytes > KNOWN_BYTES:
            self.clear()
        chunks, per_text = [], [0]
        for t in texts:
            if t:
                chunks += self.cut(b" " + t.replace(MARK.encode(), b" "))
            per_text.append(len(chunks))
        rows = list(map(self.row.get, chunks))
        if missing := {c for c, r in zip(chunks, rows, strict=True) if r is None}:
            self.learn(missing)
            rows = [self.row[c] if r is None else r for c, r in zip(chunks, rows, strict=True)]
        rows = np.array(rows, np.int64)
        a, n = self.start[rows], self.size[rows]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(a - ends[:-1], n)]
        return ids, ends[np.array(per_text)]


def _mapped(df: DataFrame, old: str, new: T.StructField, work, weight) -> DataFrame:
    """``df`` with column ``old`` left out and ``new`` made from it, batch by batch in pieces of about a megabyte."""
    others = [c for c in df.columns if c not in (old, new.name)]
    schema = T.StructType([df.schema[c] for c in others] + [new])
    frame = df.select(*others, old)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for batch in batches:
            column = batch.column(len(others))
            for a, b in slices(np.concatenate([[0], np.cumsum(weight(column))])):
                made = step(column.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(others))] + [made], names=schema.names)

    return frame.mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the text replaced by its ids, without begin and end ids.

    Nulls and empty texts have no ids. Any text is taken whole: a single chunk of megabytes is segmented like any other.
    A column already called ``ids_col`` is replaced; all other columns and all rows stay. An empty table gives no rows."""
    model = Model(path)

    def work():
        table = Table(model)

        def step(column: pa.Array) -> pa.Array:
            ids, starts = table.encode([(t or b"") for t in column.cast(pa.binary()).to_pylist()])
            return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
        return step

    return _mapped(docs, text_col, T.StructField(ids_col, T.ArrayType(T.IntegerType())), work,
                   lambda column: pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))


class Decoder:
    """Text of id lists: surfaces are laid end to end, a leading marker goes, bytes that spell no character become U+FFFD."""

    def __init__(self, model: Model):
        surface = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE
                   else p.replace(MARK, " ").encode() for p, k in zip(model.pieces, model.kinds.tolist(), strict=True)]
        self.kinds, self.size = model.kinds, np.array([len(s) for s in surface])
        self.starts = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(surface), np.uint8)
        self.marked = np.array([k == NORMAL and p.startswith(MARK) for p, k in zip(model.pieces, model.kinds.tolist(), strict=True)])

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of lists that end at ``ends`` of ``ids``."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or (self.kinds[ids] == CONTROL).any()):
            return pa.array([self.text(x) for x in np.split(ids, ends[:-1])], pa.string())
        n = self.size[ids]
        to = np.concatenate([[0], np.cumsum(n)])
        data = self.data[np.arange(to[-1]) + np.repeat(self.starts[ids] - to[:-1], n)]
        begin = np.concatenate([[0], ends[:-1]])
        lead = np.zeros(len(data), bool)
        some = begin[ends > begin]
        lead[to[some[self.marked[ids[some]]]]] = True
        at = np.concatenate([[0], to[ends]])
        at -= np.concatenate([[0], np.cumsum(lead)])[at]
        data = data[~lead]
        inner = at[at < len(data)]
        try:
            str(data.data, "utf-8")
            whole = not ((data[inner] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if not whole:
            return pa.array([self.text(x) for x in np.split(ids, ends[:-1])], pa.string())
        return pa.StringArray.from_buffers(len(ends), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))

    def text(self, ids: np.ndarray) -> str:
        """One list of any ids: those outside the vocabulary spell nothing, and the bytes on the two sides of a control piece
        never make one character together."""
        ids = ids[(ids >= 0) & (ids < len(self.size))]
        runs = [x[self.kinds[x] != CONTROL] for x in np.split(ids, np.flatnonzero(self.kinds[ids] == CONTROL))]
        runs = [x for x in runs if len(x)]
        out = []
        for i, x in enumerate(runs):
            n = self.size[x]
            to = np.cumsum(n)
            raw = self.data[np.arange(to[-1]) + np.repeat(self.starts[x] - to + n, n)].tobytes()
            out.append(_each_replaced(raw[1:] if i == 0 and self.marked[x[0]] else raw))
        return "".join(out)


def _each_replaced(raw: bytes) -> str:
    """UTF-8 with every single byte that starts no character replaced by U+FFFD."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as bad:
            out.append(raw[:bad.start].decode() + "�")
            raw = raw[bad.start + 1:]
    return "".join(out)


def decoded(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``df`` with the ids replaced by the text they spell. A null list, or one without ids, spells the empty text; null ids and
    ids outside the vocabulary spell nothing. A column already called ``text_col`` is replaced."""
    model = Model(path)

    def work():
        decode = Decoder(model)

        def step(column: pa.Array) -> pa.Array:
            flat, size = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            if not flat.null_count:
                return decode.texts(flat.to_numpy(), np.cumsum(size))
            return pa.array([decode.text(x.values.drop_null().to_numpy()) if x.is_valid else "" for x in column], pa.string())
        return step

    return _mapped(df, ids_col, T.StructField(text_col, T.StringType()), work,
                   lambda column: 4 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
