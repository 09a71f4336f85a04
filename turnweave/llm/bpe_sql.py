"""Byte-level BPE by recursive queries: encoding and decoding of texts inside Spark tasks.

Spark deals out the documents. A task splits its texts into pieces by the tokenizer's pattern and keeps the ids of
distinct pieces, also for the next tasks of its Python worker; of too many, those that come up again and again stay.
Pieces it does not know are encoded by a recursive DuckDB query over token-position rows: neighbouring
tokens join the merge table, and the leftmost pair of the smallest rank of each piece is contracted, until no pair of any
piece merges. Decoding joins ids with their bytes and aggregates them in order.

The recursion returns to Python after ``ROUNDS`` contractions and goes on with the pieces that are left, so the rows it keeps stay
in proportion to its input, also for a piece of many thousand bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnweave.llm.tables import slices, worker_cache

SLICE_BYTES = 1 << 21
MOST_PIECES = 1 << 19  # distinct pieces whose ids a Python worker remembers
QUERY_BYTES = 1 << 19  # bytes of new pieces per query
ROUNDS = 48
MEMORY = "600MB"

# Rows know their next token, so a contraction is a matter of joins. A rank is also the id of the merged token. Rank and
# place in one number order pairs by rank, then from the left.
CONTRACT = f"""
with recursive state as (
  select piece, place, id, lead(place) over line as next_place, lead(id) over line as next_id, 0 as round
  from tokens window line as (partition by piece order by place)
  union all
  select piece, place, id, next_place, next_id, round from (
    with pairs as (
      select s.piece, s.place, s.id, s.next_place, s.next_id, s.round, m.rank
      from state s left join merges m on m.first_id = s.id and m.second_id = s.next_id
      where s.round < {ROUNDS}),
    best as (
      select piece, min(rank * 4294967296 + place) as pair, arg_min(next_place, rank * 4294967296 + place) as gone
      from pairs where rank is not null group by piece),
    chosen as (
      select b.piece, b.pair // 4294967296 as merged, b.pair % 4294967296 as cut, b.gone, g.next_place, g.next_id
      from best b join pairs g on g.piece = b.piece and g.place = b.gone)
    select p.piece, p.place, p.round + 1 as round,
      case when p.place = c.cut then c.merged else p.id end as id,
      case when p.place = c.cut then c.next_place else p.next_place end as next_place,
      case when p.place = c.cut then c.next_id when p.next_place = c.cut then c.merged else p.next_id end as next_id
    from pairs p join chosen c on c.piece = p.piece and p.place <> c.gone))
select piece, place, id, round = {ROUNDS} as going from state
qualify round = max(round) over (partition by piece)
order by piece, place
"""

DECODE = """
select doc, string_agg(hex, '' order by place) as hex from ids join vocabulary using (id) group by doc
"""


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a file of lines ``base64 rank``."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


class RankTokens:
    """Encoder and decoder of one rank file, on an in-process database of its own."""

    def __init__(self, content: bytes, pattern: str):
        import duckdb
        import regex

        self.split = regex.compile(pattern).findall
        self.ranks = read_ranks(content)
        self.db = duckdb.connect()
        self.db.execute(f"set threads = 1; set memory_limit = '{MEMORY}'; set preserve_insertion_order = false")
        names = list(self.ranks)
        ids = np.array([self.ranks[n] for n in names], np.int64)
        vocabulary = pa.table({"id": ids, "hex": [n.hex() for n in names]})
        self.db.execute("create table vocabulary as select * from vocabulary")
        self.bytes = np.array([self.ranks.get(bytes([k]), -1) for k in range(256)], np.int64)
        self.ready = False
        self._clear()

    def _prepare(self) -> None:
        """The merge table: every way to split a token into two tokens."""
        if self.ready:
            return
        self.ready = True
        found = [
            (self.ranks[a], self.ranks[b], rank)
            for whole, rank in self.ranks.items()
            for k in range(1, len(whole))
            if (a := whole[:k]) in self.ranks and (b := whole[k:]) in self.ranks
        ]
        first, second, merged = (np.array(x, np.int64) for x in zip(*found, strict=True))
        merges = pa.table({"first_id": first, "second_id": second, "rank": merged})
        self.db.execute("create table merges as select * from merges")

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.begin = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int32)  # slices that a piece came up in, halved whenever pieces are forgotten

    def _forget(self) -> None:
        """Keeps the pieces that came up in several slices, at most half of ``MOST_PIECES``, by their number of slices."""
        often = np.flatnonzero(self.uses > 1)
        stay = np.sort(often[np.argsort(-self.uses[often], kind="stable")[: MOST_PIECES // 2]])
        names, flat, begin, size = list(self.place), self.flat, self.begin[stay], self.sizes[stay]
        self.place = {names[k]: n for n, k in enumerate(stay.tolist())}
        self.sizes, self.uses = size, self.uses[stay] // 2
        self.begin = np.cumsum(size) - size
        self.flat = flat[np.repeat(begin - self.begin, size) + np.arange(size.sum())]

    def merged(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, by contraction to the fixpoint."""
        self._prepare()
        # A piece that is a token as a whole needs no merging.
        done = [np.array([self.ranks[p]]) if p in self.ranks else None for p in pieces]
        size = np.array([len(p) for p in pieces], np.int64)
        group = np.cumsum(size) // QUERY_BYTES
        left = np.array([d is None for d in done], bool)
        for at in np.unique(group[left]):
            which = np.flatnonzero((group == at) & left)
            flat = np.frombuffer(b"".join(pieces[k] for k in which), np.uint8)
            length = size[which]
            piece = np.repeat(which, length)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
            ids = self.bytes[flat]
            while len(piece):
                tokens = pa.table({"piece": piece, "place": place, "id": ids})  # noqa: F841  (read by the query)
                found = self.db.sql(CONTRACT).to_arrow_table()
                piece, place, ids, going = (found.column(k).to_numpy() for k in range(4))
                edge = np.flatnonzero(np.diff(piece, prepend=-1))
                ended = ~going[edge]
                for a, b, stop in zip(edge, np.append(edge[1:], len(piece)), ended, strict=True):
                    if stop:
                        done[piece[a]] = ids[a:b]
                piece, place, ids = piece[going], place[going], ids[going]
        return done

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids per text."""
        split = [self.split(t) for t in texts]
        words = set(chain.from_iterable(split))
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > MOST_PIECES:
            self._forget()
            new = [w for w in words if w not in self.place]
        if new:
            found = self.merged([w.encode("utf-8") for w in new])
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.sizes = np.concatenate([self.sizes, [len(x) for x in found]]).astype(np.int64)
            self.flat = np.concatenate([self.flat, *found]).astype(np.uint32)
            self.begin = np.cumsum(self.sizes) - self.sizes
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
        count = np.array([len(p) for p in split], np.int64)
        look = map(self.place.__getitem__, chain.from_iterable(split))
        word = np.fromiter(look, np.int64, int(count.sum()))
        self.uses[word] += 1  # once a slice, however often the piece is in it
        size = self.sizes[word]
        total = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(self.begin[word] - total[:-1], size) + np.arange(total[-1])
        return self.flat[source], np.diff(total[np.concatenate([[0], np.cumsum(count)])])

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each run of ids."""
        ids = pa.table(  # noqa: F841  (read by the query)
            {"doc": np.repeat(np.arange(len(counts)), counts), "place": np.arange(len(flat)), "id": flat.astype(np.int64)}
        )
        out = [b""] * len(counts)
        for doc, text in self.db.execute(DECODE).fetchall():
            out[doc] = bytes.fromhex(text)
        return out


@worker_cache
def rank_tokens(content: bytes, pattern: str) -> RankTokens:
    """The encoder of a Python worker, which serves one task after another until the worker does other work."""
    return RankTokens(content, pattern)


def _encode(content: bytes, pattern: str):
    schema = pa.schema([("_row_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in slices(batches, "_text", SLICE_BYTES, rank_tokens):
            tokens = rank_tokens(content, pattern)
            texts = [t or "" for t in part.column(part.schema.get_field_index("_text")).to_pylist()]
            ids, counts = tokens.encode(texts)
            edge = (4 * np.concatenate([[0], np.cumsum(counts)])).astype(np.int32)
            raw = pa.BinaryArray.from_buffers(
                pa.binary(), len(counts), [None, pa.py_buffer(edge), pa.py_buffer(ids.astype("<u4").tobytes())]
            )
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), raw], schema=schema)

    return run, "_row_id long, n_tokens long, ids binary"


def _decode(content: bytes, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "ids", 4 * SLICE_BYTES // 4, rank_tokens):
            tokens = rank_tokens(content, pattern)
            ids = np.frombuffer(data.tobytes(), "<u4")
            decoded = tokens.decode(ids, np.diff(offsets) // 4)
            yield part.append_column("decoded", pa.array(decoded, pa.binary()))

    return run


def encoded(docs: DataFrame, content: bytes, pattern: str) -> DataFrame:
    """(_row_id, n_tokens, ids) for rows (_row_id, _text): ids as little-endian unsigned 32-bit numbers.

    ``content`` is a rank file that holds all 256 single bytes, ``pattern`` splits a text before the merges. Special tokens are
    ordinary text. Null and empty texts have no ids.
    """
    run, kind = _encode(content, pattern)
    return docs.select("_row_id", "_text").mapInArrow(run, kind)


def decoded(ids: DataFrame, content: bytes, pattern: str) -> DataFrame:
    """``ids`` (_row_id, n_tokens, ids) with a column ``decoded``: the bytes that the ids stand for."""
    return ids.mapInArrow(_decode(content, pattern), "_row_id long, n_tokens long, ids binary, decoded binary")
