"""Byte-level BPE encoding and decoding with recursive queries.

Each task has an in-process DuckDB with the merge table. The distinct words of its texts become rows
``(word, position, token)``; a recursive query joins neighbouring tokens with the merge table and contracts each word's
leftmost pair of the smallest rank, until no pair of the word is in the table. An ordered aggregation then lists the
ids and puts the bytes together again. Texts are read off the words, so their decoding is that of all their ids.

A word of any length is contracted in overlapping windows (a short one is a single window), so the work grows with its
length and not with its square. Tokens are a word's encoding if and only if each two neighbours are the encoding of
their own bytes: no pair across their border was ever the next to contract, whatever lies around them. So the tokens of
one window up to a token that the next window has at the same place, and that window's tokens from there on, are the
encoding of both. If two windows of a word have no token in common, its windows are made twice as long.
"""
from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from .hashing import slices, text_bytes

KNOWN = 350_000      # encoded words that a task remembers before it starts afresh
STEP = 96            # a word is contracted in windows of one and a half steps, one step apart
CHUNK = 200_000      # bytes of windows contracted by one query
TOGETHER = 2_000_000  # bytes of text whose new words are encoded together
STEPS = 48           # contractions in one recursive query; unfinished words go on in the next


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


def merge_table(ranks: dict[bytes, int]) -> np.ndarray:
    """Rows ``(left id, right id, merged id)``: a pair merges when its bytes together are a token; the rank is that token's."""
    rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return np.array(rows, np.int32).reshape(-1, 3)


def windows(size: int, step: int) -> list[tuple[int, int]]:
    """Where the windows of a word of ``size`` bytes start and end; neighbours share half a step."""
    return [(a, min(a + step + step // 2, size)) for a in range(0, max(size - step // 2, 1), step)]


def joined(parts: list[tuple[int, list[tuple[str, str, str]]]]) -> list[tuple[str, str, str]] | None:
    """Tokens of a word from its windows' starts and tokens; ``None`` if two windows have no token in common."""
    _, out = parts[0]
    ends = _ends(0, out)
    for start, tokens in parts[1:]:
        more = _ends(start, tokens)
        here = dict(zip(more, range(len(more)), strict=True))
        at = len(out) - 1
        while at >= 0 and ends[at] > start:       # a token of both starts and ends at the same bytes
            j = here.get(ends[at])
            if j is not None and out[at] == tokens[j]:
                break
            at -= 1
        else:
            return None
        del out[at + 1:], ends[at + 1:]
        out += tokens[j + 1:]
        ends += more[j + 1:]
    return out


def _tokens(line: str) -> list[tuple[str, str, str]]:
    """Id, colon and bytes of each token in a line of ``_READ``."""
    return [c.partition(":") for c in line.split(" ")]


def _ends(start: int, tokens: list[tuple[str, str, str]]) -> list[int]:
    return list(accumulate((len(x[2]) // 2 for x in tokens), initial=start))[1:]


# One step for words still open: neighbouring tokens meet the merge table, each word's leftmost pair of the smallest rank
# is found, and its left token becomes the merged one while its right token goes. A word without a pair is done.
# {window} is empty as long as the engine hands rows on in the order of their words and positions, which every row
# checks; if one ever finds otherwise, the words are encoded again with the order spelt out.
_LEFTMOST = """
WITH RECURSIVE t(step, w, p, id, done) AS (
  SELECT 0, w, p, id, false FROM _start
  UNION ALL
  SELECT step + 1, w, p, CASE WHEN p = at_p THEN merged ELSE id END, merged IS NULL
  FROM (
    SELECT t.step, t.w, t.p, t.id, b.merged, b.at_p, b.gone
    FROM t LEFT JOIN (
      SELECT w, (min(k) >> 32)::INT AS merged, (min(k) & 4294967295)::INT AS at_p, arg_min(np, k) AS gone
      FROM (SELECT n.w, n.np, (m.merged::BIGINT << 32) + n.p AS k
            FROM (SELECT w, p, nw, np, CASE WHEN nw < w OR nw = w AND np <= p THEN error('rows out of order')::INT ELSE nid END AS nid, id
                  FROM (SELECT w, p, id, lead(id) OVER o AS nid, lead(w) OVER o AS nw, lead(p) OVER o AS np
                        FROM t WHERE NOT done AND step < {steps} WINDOW o AS ({window}))) n
            JOIN merges m ON m.a = n.id AND m.b = n.nid WHERE n.nw = n.w)
      GROUP BY w) b ON b.w = t.w
    WHERE NOT t.done AND t.step < {steps}
  ) WHERE gone IS NULL OR p <> gone
)
SELECT w, p, id, done FROM t WHERE done OR step = {steps}
"""
# ids and bytes of every window, in order: 'id:hex id:hex'
_READ = "SELECT w, string_agg(code, ' ' ORDER BY p) AS codes FROM _done JOIN vocabulary USING (id) GROUP BY w"


class Encoder:
    """Encodes words by a vocabulary; lives in one task."""

    def __init__(self, vocabulary: tuple[list[bytes], bytes]):
        import duckdb
        self.out_of_order = duckdb.InvalidInputException
        tokens, merges = vocabulary
        merges = np.frombuffer(zlib.decompress(merges), np.int32).reshape(-1, 3)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.register("_m", pa.table({c: merges[:, i] for i, c in enumerate(("a", "b", "merged"))}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM _m")
        self.db.register("_v", pa.table({"id": pa.array(range(len(tokens)), pa.int32()), "code": [f"{i}:{t.hex()}" for i, t in enumerate(tokens)]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM _v")
        self.of_byte = np.zeros(256, np.int32)
        for i, t in enumerate(tokens):
            if len(t) == 1:
                self.of_byte[t[0]] = i
        self.ids: dict[str, str] = {}
        self.plain: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Encode words and remember the ids and the decoded bytes of each."""
        step, open_ = STEP, [(w, w.encode()) for w in words]
        while open_:
            cut = [windows(len(raw), step) if len(raw) > step else None for _, raw in open_]
            pieces = []
            for (_, raw), c in zip(open_, cut, strict=True):
                if c is None:
                    pieces.append(raw)
                else:
                    pieces += [raw[a:b] for a, b in c]
            read, again = self._encode(pieces), []
            for (w, raw), c in zip(open_, cut, strict=True):
                found = _tokens(next(read)) if c is None else joined([(a, _tokens(next(read))) for a, _ in c])
                if found is None:
                    again.append((w, raw))
                    continue
                self.ids[w] = " ".join([x[0] for x in found])
                self.plain[w] = bytes.fromhex("".join([x[2] for x in found]))
            step, open_ = 2 * step, again

    def _encode(self, raw: list[bytes], query: str = _LEFTMOST) -> Iterator[str]:
        """The line of ``_READ`` for each byte string."""
        ends = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        for a, b in slices(ends, CHUNK):
            yield from self._contracted(raw[a:b], query)

    def _contracted(self, raw: list[bytes], query: str) -> list[str]:
        sizes = np.array([len(r) for r in raw])
        ends = np.cumsum(sizes)
        start = pa.table({"w": np.repeat(np.arange(len(raw), dtype=np.int32), sizes),
                          "p": (np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)).astype(np.int32),
                          "id": self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]})
        finished = []
        while len(start):
            self.db.register("_start", start)
            try:
                got = self.db.sql(query.format(steps=STEPS, window="")).to_arrow_table()
            except self.out_of_order:
                got = self.db.sql(query.format(steps=STEPS, window="ORDER BY w, p")).to_arrow_table()
            done = got.column("done").combine_chunks()
            finished.append(got.filter(done).select(["w", "p", "id"]))
            start = got.filter(pa.compute.invert(done)).select(["w", "p", "id"])
        self.db.register("_done", pa.concat_tables(finished))
        rows = self.db.sql(_READ).to_arrow_table()
        out = [""] * len(raw)
        for w, codes in zip(rows.column("w").to_pylist(), rows.column("codes").to_pylist(), strict=True):
            out[w] = codes
        return out

    def texts(self, texts: list[str], find) -> Iterator[tuple[int, str, str]]:
        """For each text the number of ids and the digests of the ids and of the decoded bytes."""
        cut = [find(t) for t in texts]
        need = set().union(*cut) if cut else set()
        if len(self.ids) > KNOWN:
            self.ids.clear()
            self.plain.clear()
        self.learn([w for w in need if w not in self.ids])
        for words in cut:
            ids = " ".join(map(self.ids.__getitem__, words))
            plain = b"".join(map(self.plain.__getitem__, words))
            yield ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(plain).hexdigest()


def encoded(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` without the text but with ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by blanks) and
    ``decoded_sha256`` (of the bytes that the ids decode to).

    Every match of ``pattern`` in the whole text is a word of its own; there are no special tokens. A null text counts
    as empty: no ids, digests of nothing. Columns of the input with the names of the new ones are replaced.
    """
    ranks = load_ranks(ranks_path)
    tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    vocabulary = docs.sparkSession.sparkContext.broadcast((tokens, zlib.compress(merge_table(ranks).tobytes())))   # the vocabulary's size
    new = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    at = docs.columns.index(text_col)
    kept = [i for i, c in enumerate(docs.columns) if c != text_col and c not in dict(new)]
    schema = docs.drop(text_col, *dict(new)).schema
    for c, kind in new:
        schema = schema.add(c, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        find = regex.compile(pattern).findall
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            column = batch.column(at).fill_null("")
            _, starts = text_bytes(column)
            out = [row for a, b in slices(starts, TOGETHER) for row in encoder.texts(column.slice(a, b - a).to_pylist(), find)]
            n, ids, plain = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())],
                [*(batch.schema.names[i] for i in kept), *dict(new)])

    return docs.mapInArrow(run, schema)
