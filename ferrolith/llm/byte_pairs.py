"""Byte-level byte-pair encoding and decoding as relations, in DuckDB within each task.

A word's bytes are rows (position, word, token). A recursive query joins each row and the next one with the table of
merges, takes the leftmost pair of minimum rank of each word and contracts it, until no word has a pair left. Decoding
joins ids with the vocabulary and aggregates the pieces in order.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.llm.bytetext import Chunk
from ferrolith.llm.columns import with_text_columns
from ferrolith.llm.known_ids import KnownIds

#: Words up to this length go through _SHORT, whose rounds are all kept until its end; longer ones through _LONG.
SHORT_BYTES = 64
#: Bytes of words, and ids, that one query takes at most; a longer word is a query alone.
QUERY_BYTES, QUERY_IDS = 1 << 20, 1 << 20

#: Rows of all words that still change go from round to round; a word's last round is its result.
_SHORT = """
with recursive state(round, pos, word, tok) as (
  select 0, pos, word, tok from fresh
  union all
  (with pairs as (
     select pos, word, tok, lead(pos) over w as pos2, lead(word) over w as word2, lead(tok) over w as tok2 from state window w as (order by pos)),
   least as (
     select word, min(id::bigint * 4294967296 + pos) as hit, arg_min(pos2, id::bigint * 4294967296 + pos) as gone
     from pairs join merges on l = tok and r = tok2 where word = word2 group by word)
   select round + 1, pos, word, case when pos = (hit & 4294967295) then (hit >> 32)::int else tok end
   from state join least using (word) where pos <> gone))
select word, tok from state join (select word, max(round) as round from state group by word) using (word, round) order by pos
"""

#: One row a position is kept and replaced by key, with -1 for what a contraction takes away. All places of the minimum
#: pair that don't overlap, from the left, are contracted in one round; only the first one where some contraction makes
#: a pair of lower rank, which would come before the others.
_LONG = """
with recursive state(pos, word, tok) using key (pos) as (
  select pos, word, tok from fresh
  union
  (with live as (
     select pos, word, tok, lead(pos) over w as pos2, lead(tok) over w as tok2, lead(tok, 2) over w as tok3, lag(tok) over w as tok0, row_number() over w as nr
     from recurring.state where tok >= 0 and word in (select word from state) window w as (partition by word order by pos)),
   pairs as (select live.*, id from live join merges on l = tok and r = tok2),
   least as (select word, min(id) as least from pairs group by word),
   hits as (select pairs.*, nr - row_number() over (partition by word order by pos) as island from pairs join least using (word) where id = least),
   apart as (select * from (select *, row_number() over (partition by word, island order by pos) as k from hits) where k % 2 = 1),
   taken as (
     select *, row_number() over w as nth, lag(nr) over w as nr0, count(*) over (partition by word) as many
     from apart window w as (partition by word order by pos)),
   early as (
     select distinct taken.word from taken
       left join merges a on a.l = case when nr0 = nr - 2 then taken.id else tok0 end and a.r = taken.id
       left join merges b on b.l = taken.id and b.r = tok3
     where many > 1 and (a.id < taken.id or b.id < taken.id)),
   done as (select * from taken where nth = 1 or word not in (select word from early))
   select pos, word, id from done union all select pos2, word, -1 from done))
select word, tok from state where tok >= 0 order by pos
"""

_DECODE = "select string_agg(piece, '' order by pos) as text from given join vocabulary using (id)"


class BytePairs:
    """Encoder and decoder over a file of ranks (base64 piece and rank on each line)."""

    def __init__(self, path: str, pattern: str, limit: int = 1_000_000):
        import duckdb
        import regex

        self.pattern = regex.compile(pattern)
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.sizes[list(self.ranks.values())] = [len(piece) for piece in self.ranks]
        # every way to make a piece of two: ranks go by the joined bytes, whatever the parts
        merges = [(self.ranks[p[:k]], self.ranks[p[k:]], rank) for p, rank in self.ranks.items() for k in range(1, len(p)) if p[:k] in self.ranks and p[k:] in self.ranks]
        # nothing is spilt to a folder of the machine
        self.con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        l, r, rank = np.array(merges, np.int32).reshape(-1, 3).T
        self._table("merges", l=l, r=r, id=rank)
        # a piece's bytes as characters 0 to 255, which DuckDB's strings can hold
        self._table("vocabulary", id=list(self.ranks.values()), piece=[p.decode("latin-1") for p in self.ranks])
        self.known = KnownIds(self.encode_words, limit)

    def _table(self, name: str, **columns) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"create table {name} as select * from given")
        self.con.unregister("given")

    def _merged(self, words: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        self.con.register("fresh", pa.table({"pos": np.arange(len(data), dtype=np.int32), "word": word, "tok": self.bytes[data]}))
        found = self.con.sql(query).to_arrow_table()
        self.con.unregister("fresh")
        return found.column("tok").to_numpy(), np.bincount(found.column("word").to_numpy(), minlength=len(words))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has. A word that is a piece is that piece alone."""
        whole = [self.ranks.get(w) for w in words]
        sizes = np.array([0 if w == b"" else 1 for w in words], np.int64)
        parts = {}
        for query, kind in ((_SHORT, lambda w: len(w) <= SHORT_BYTES), (_LONG, lambda w: len(w) > SHORT_BYTES)):
            held, size = [], 0
            for i in [i for i, (w, rank) in enumerate(zip(words, whole)) if rank is None and w and kind(w)] + [None]:
                if held and (i is None or size + len(words[i]) > QUERY_BYTES):
                    ids, counts = self._merged([words[k] for k in held], query)
                    sizes[held] = counts
                    parts |= zip(held, np.split(ids, np.cumsum(counts)[:-1]))
                    held, size = [], 0
                if i is not None:
                    held.append(i)
                    size += len(words[i])
        flat = np.zeros(int(sizes.sum()), "<u4")
        ends = np.cumsum(sizes).tolist()
        for i, (end, rank) in enumerate(zip(ends, whole)):
            if rank is not None:
                flat[end - 1] = rank
        for i, ids in parts.items():
            flat[ends[i] - len(ids) : ends[i]] = ids
        return flat, sizes

    def words(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each match of the pattern. A byte that is not UTF-8 is a symbol of its own."""
        body = chunk.data.tobytes()
        text = body.decode("utf-8", "surrogateescape")
        at = np.flatnonzero((chunk.data & 0xC0) != 0x80)
        if len(at) != len(text) or "\udc80" <= max(text, default="") <= "\udcff":
            at = np.cumsum([0] + [len(c.encode("utf-8", "surrogateescape")) for c in text])[:-1]
        at = np.append(at, len(body))
        edges = np.searchsorted(at, chunk.offsets).tolist()
        begin, stop, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for lo, hi in zip(edges, edges[1:]):
            sizes = np.fromiter(map(len, self.pattern.findall(text, lo, hi)), np.int64)
            ends = lo + np.cumsum(sizes)
            starts = ends - sizes
            if hi > lo and (not len(ends) or ends[-1] != hi):  # a pattern that leaves gaps
                spans = np.array([m.span() for m in self.pattern.finditer(text, lo, hi)], np.int64).reshape(-1, 2)
                starts, ends = spans[:, 0], spans[:, 1]
            begin.append(starts)
            stop.append(ends)
            counts.append(len(starts))
        return at[np.concatenate(begin)], at[np.concatenate(stop)], np.repeat(np.arange(chunk.n), counts)

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the documents of a chunk, one after another, and how many each has."""
        begin, stop, doc = self.words(chunk)
        ids, sizes = self.known.ids(chunk.data, begin, stop)
        return ids, chunk.per_doc(doc, sizes)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each document, of ids one after another."""
        if len(ids) and (int(ids.max()) >= len(self.sizes) or not self.sizes[ids].all()):
            raise ValueError("an id that the vocabulary doesn't hold")
        parts = []
        for lo in range(0, len(ids), QUERY_IDS):
            held = ids[lo : lo + QUERY_IDS].astype(np.int32)
            self.con.register("given", pa.table({"pos": np.arange(len(held), dtype=np.int32), "id": held}))
            parts.append(self.con.sql(_DECODE).to_arrow_table().column(0)[0].as_py().encode("latin-1"))
            self.con.unregister("given")
        body = b"".join(parts)
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [body[a:b] for a, b in zip(ends, ends[1:])]


_coders: dict[tuple[str, str], BytePairs] = {}


def coder(path: str, pattern: str) -> BytePairs:
    """One a Python worker, kept between its tasks."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = BytePairs(path, pattern)
    return _coders[path, pattern]


def byte_pair_ids(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, text: str = "text", decode: bool = False) -> DataFrame:
    """docs (or its columns in keep) with n_tokens and token_ids, the ids of the whole text as little-endian unsigned
    32-bit integers, and with decode also decoded, the bytes that those ids stand for.

    Each match of pattern is encoded alone by the ranks in path, which every machine has at that place. A null or empty
    text has no ids; rows stay as they are; columns of the names that are added are replaced. No shuffle.
    """

    def compute():
        pairs = coder(path, pattern)

        def run(chunk: Chunk) -> dict[str, object]:
            ids, counts = pairs.encode(chunk)
            ends = np.cumsum(counts)
            out = {"n_tokens": counts, "token_ids": [x.tobytes() for x in np.split(ids, ends[:-1])]}
            return out | ({"decoded": pairs.decode(ids, counts)} if decode else {})

        return run

    return with_text_columns(docs, compute, {"n_tokens": "bigint", "token_ids": "binary"} | ({"decoded": "binary"} if decode else {}), keep, text)


def byte_pair_bytes(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, ids: str = "token_ids") -> DataFrame:
    """docs (or its columns in keep) with decoded, the bytes of the ids of byte_pair_ids. No ids, or null: no bytes."""

    def compute():
        pairs = coder(path, pattern)
        return lambda chunk: {"decoded": pairs.decode(chunk.data.view("<u4") if len(chunk.data) else np.zeros(0, "<u4"), np.diff(chunk.offsets) // 4)}

    return with_text_columns(docs, compute, {"decoded": "binary"}, keep, ids)


def op11_byte_pairs(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = byte_pair_ids(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"], decode=True)
    return found.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
