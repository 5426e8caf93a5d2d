"""Packing documents into sequences with a grouping genetic algorithm on islands.

Documents become token runs; only those longer than a sequence are cut, so that all pieces but the first fill one. The
other pieces are dealt by a hash to cells of bounded size. In each cell several islands evolve packings: crossover
injects whole well-filled sequences of one parent into the other, removes the sequences that hold a piece twice, and
places the displaced pieces best-fit; mutation dissolves badly filled sequences. After each round an island hands its
elite to the next one of its cell. Sequences that stay badly filled are dissolved in the end and their pieces packed
again in cells of the next level, until one cell is left.
"""
from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stored
from .hashing import slices, text_bytes

CELL = 4096          # pieces in a cell, on average
ISLANDS = 2          # islands of a cell
ROUNDS = 2           # rounds of evolution, with migration between them
POPULATION = 4       # packings on an island
GENERATIONS = 6      # crossovers of an island in a round
FULL = 0.995         # sequences filled less are packed again on the next level


# ---- tokens ---------------------------------------------------------------------------------------------------------

def far_texts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the texts laid end to end hold a character beyond U+027F. Slices of texts keep the work's memory small."""
    far = np.zeros(len(starts) - 1, bool)
    for a, b in slices(starts):
        places = np.flatnonzero(data[starts[a]:starts[b]] >= 0xCA) + starts[a]
        far[np.searchsorted(starts, places, "right") - 1] = True
    return far


def token_runs(docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, capacity: int, end_id: int) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: the pieces of every document's ids followed by ``end_id``.

    A faster library with the same vocabulary encodes texts of characters up to U+027F, for which both give the same
    ids (tests/llm/test_packing.py); all others, and texts with a '<|', go to the tokenizer itself."""
    with open(tokenizer_path) as f:
        tokenizer = f.read()
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    files = docs.sparkSession.sparkContext.broadcast((tokenizer, ranks))       # of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        exact = None            # few texts need it, and it is large
        known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in files.value[1].splitlines())}
        quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            far = far_texts(data, starts)
            rows = []
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                text = text.as_py() or ""
                if far[i] or "<|" in text:
                    exact = exact or Tokenizer.from_str(files.value[0])
                    ids = exact.encode(text, add_special_tokens=False).ids
                else:
                    ids = quick.encode_ordinary(text)
                blob = np.array([*ids, end_id], "<u4").tobytes()
                n = len(blob) // 4
                first = n % capacity or min(n, capacity)
                at, piece = 0, 0
                while at < n:
                    length = first if piece == 0 else capacity
                    rows.append((doc, piece, at, length, zlib.crc32(blob[4 * at:4 * (at + length)])))
                    at, piece = at + length, piece + 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---- one packing: the sequence number of every piece ----------------------------------------------------------------

class Open:
    """Sequences by free room; the best fit is the lowest set bit at or above a size."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.mask, self.made = capacity, {}, 0, 0

    def add(self, number: int, room: int) -> None:
        if room:
            self.rooms.setdefault(room, []).append(number)
            self.mask |= 1 << room

    def place(self, size: int) -> int:
        fit = self.mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            numbers = self.rooms[room]
            number = numbers.pop()
            if not numbers:
                self.mask &= ~(1 << room)
        else:
            number, room = self.made, self.capacity
            self.made += 1
        self.add(number, room - size)
        return number


def fill(sizes: np.ndarray, packing: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """Place the pieces in ``order`` best-fit beside those already placed (others are -1); sequences are renumbered."""
    placed = packing >= 0
    out = packing.copy()
    room = Open(capacity)
    if placed.any():
        _, out[placed] = np.unique(packing[placed], return_inverse=True)
        loads = np.bincount(out[placed], sizes[placed]).astype(np.int64)
        room.made = len(loads)
        for number in np.flatnonzero(loads < capacity):
            room.add(int(number), int(capacity - loads[number]))
    for piece, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        out[piece] = room.place(size)
    return out


def fitness(sizes: np.ndarray, packing: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then fuller ones."""
    loads = np.bincount(packing, sizes)
    return -len(loads), float(((loads / capacity) ** 2).sum())


def start(sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The packing of the descending order and some of nearly descending ones."""
    none = np.full(len(sizes), -1)
    noise = [np.ones(len(sizes))] + [rng.uniform(0.9, 1.0, len(sizes)) for _ in range(POPULATION - 1)]
    return [fill(sizes, none, np.argsort(-sizes * x, kind="stable"), capacity) for x in noise]


def crossed(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject some of the best-filled sequences of ``b`` into ``a`` and place the displaced pieces again."""
    loads = np.bincount(b, sizes)
    best = np.flatnonzero(loads >= np.quantile(loads, 0.5))
    chosen = best[rng.random(len(best)) < 0.3]
    injected = np.isin(b, chosen)
    hit = np.isin(a, np.unique(a[injected]))          # sequences of a that hold an injected piece
    child = np.where(hit, -1, a)
    child[injected] = a.max() + 1 + b[injected]
    return fill(sizes, child, order_of(sizes, np.flatnonzero(child < 0)), capacity)


def mutated(sizes: np.ndarray, a: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Dissolve the worst-filled sequences and a few others."""
    loads = np.bincount(a, sizes)
    worst = np.argsort(loads, kind="stable")[:max(2, len(loads) // 50)]
    gone = np.union1d(worst, rng.choice(len(loads), min(len(loads), max(2, len(loads) // 50)), replace=False))
    child = np.where(np.isin(a, gone), -1, a)
    return fill(sizes, child, order_of(sizes, np.flatnonzero(child < 0)), capacity)


def order_of(sizes: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    return pieces[np.argsort(-sizes[pieces], kind="stable")]


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Some generations; the best packing comes first. Stops early at the bound that no packing can beat."""
    bound = -(-int(sizes.sum()) // capacity)
    ranked = sorted(population, key=lambda p: fitness(sizes, p, capacity), reverse=True)
    for _ in range(GENERATIONS):
        if -fitness(sizes, ranked[0], capacity)[0] <= bound:
            break
        i, j = rng.choice(len(ranked), 2, replace=False) if len(ranked) > 1 else (0, 0)
        child = mutated(sizes, crossed(sizes, ranked[i], ranked[j], capacity, rng), capacity, rng)
        ranked = sorted([*ranked, child], key=lambda p: fitness(sizes, p, capacity), reverse=True)[:POPULATION]
    return ranked


# ---- islands --------------------------------------------------------------------------------------------------------

def evolve_cells(cells: DataFrame, capacity: int, level: int) -> DataFrame:
    """``cells (cell, n, sizes)``, sizes packed as 16-bit numbers, with the ``packing`` of each, as 32-bit numbers."""
    def island(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cell, number, turn = (k.as_py() for k in key)
        sizes = np.frombuffer(table.column("sizes")[0].as_py(), np.uint16).astype(np.int64)
        rng = np.random.default_rng([level, turn, number, cell & 0xFFFFFFFF])
        population = [np.frombuffer(p, np.int32).astype(np.int64) for p in table.column("packing").to_pylist() if p is not None]
        if not population:
            population = start(sizes, capacity, rng)
        ranked = evolve(sizes, population, capacity, rng)
        # the elite also goes to the next island; it is the first row there as here
        rows = [(number, p) for p in ranked] + [((number + 1) % ISLANDS, ranked[0])]
        blob = sizes.astype(np.uint16).tobytes()
        return pa.table({"cell": pa.array([cell] * len(rows), pa.int64()), "island": pa.array([i for i, _ in rows], pa.int32()),
                         "sizes": pa.array([blob] * len(rows), pa.binary()),
                         "packing": pa.array([p.astype(np.int32).tobytes() for _, p in rows], pa.binary())})

    schema = "cell long, island int, sizes binary, packing binary"
    state = cells.select("cell", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "sizes",
                         F.lit(None).cast("binary").alias("packing"))
    for turn in range(ROUNDS):
        state = state.groupBy("cell", "island", F.lit(turn).alias("turn")).applyInArrow(island, schema)

    def choose(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sizes = np.frombuffer(table.column("sizes")[0].as_py(), np.uint16).astype(np.int64)
        packings = sorted(set(table.column("packing").to_pylist()))
        best = max(packings, key=lambda p: fitness(sizes, np.frombuffer(p, np.int32), capacity))
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "packing": pa.array([best], pa.binary())})

    return state.groupBy("cell").applyInArrow(choose, "cell long, packing binary")


def pack_level(pieces: DataFrame, count: int, capacity: int, level: int, last: bool) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; both null where a badly filled sequence was dissolved."""
    cells = max(1, -(-count // CELL))
    columns = pieces.columns
    dealt = stored(pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "start", F.lit(level)), F.lit(cells))))

    def ordered(table: pa.Table) -> pa.Table:
        return table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "length", "ids_crc32")])

    def sizes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blob = ordered(table).column("length").to_numpy().astype(np.uint16).tobytes()
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "sizes": pa.array([blob], pa.binary())})

    best = evolve_cells(dealt.groupBy("cell").applyInArrow(sizes, "cell long, sizes binary"), capacity, level)

    def deal(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        table, cell = ordered(left), key[0].as_py()
        packing = np.frombuffer(right.column("packing")[0].as_py(), np.int32)
        length = table.column("length").to_numpy()
        order = np.argsort(packing, kind="stable")
        ends = np.cumsum(length[order])
        first = np.searchsorted(packing[order], packing[order], "left")
        offset = np.empty(len(order), np.int64)
        offset[order] = ends - length[order] - (ends - length[order])[first]
        keep = np.ones(len(order), bool) if last else (np.bincount(packing, length) >= FULL * capacity)[packing]
        number = (np.int64(level) << 56) + (np.int64(cell) << 20) + packing
        out = table.select(columns)
        out = out.append_column("sequence_id", pa.array(number, pa.int64(), mask=~keep))
        return out.append_column("offset", pa.array(offset, pa.int64(), mask=~keep))

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return dealt.groupBy("cell").cogroup(best.groupBy("cell")).applyInArrow(deal, schema)


def packed(docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``: every piece and its place in a sequence.

    A null or empty text is its ``end_id`` alone. Rows with a null or repeated id are packed like any other; columns
    beside ``doc_id`` and ``text`` are ignored, and an empty table gives no rows.
    """
    pieces = stored(token_runs(docs, tokenizer_path, ranks_path, pattern, capacity, end_id))
    whole = pieces.filter(F.col("length") == capacity).select(
        "*", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = pieces.filter(F.col("length") < capacity)
    done, level = [whole], 0
    while True:
        count = left.count()
        last = count <= 2 * CELL or level == 60
        got = stored(pack_level(left, count, capacity, level, last))
        done.append(got.filter("sequence_id is not null"))
        if last:
            break
        left = got.filter("sequence_id is null").drop("sequence_id", "offset")
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
