"""Problem 5: token ids of every document by a public byte-level BPE vocabulary.

Words are cut out of the text and deduplicated; the ones not yet known are encoded by a recursive
DuckDB query in which token-position rows join the merge table and each word's pair of least rank
is contracted until no pair is left. Python workers keep a bounded table of known words.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary files lie.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Cuts text into words (fixed value: what the ByteLevel pre-tokenizer of the vocabulary file stands for). White space is
#: Unicode's property of that name; letters and numbers stand first, as no contraction begins like them.
WORD = r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts that are all ASCII.
ASCII_WORD = r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: A worker keeps this many known words of at most this many characters.
KNOWN, KNOWN_CHARS = 200_000, 64
#: Bytes of the words in one query; a word beyond this goes step by step.
QUERY_BYTES, STEP_BYTES = 120_000, 4_096
#: Tokens in one output batch; rows and characters whose new words go into one round of queries.
BATCH_TOKENS, ROUND_ROWS, ROUND_CHARS = 2_000_000, 4_000, 4_000_000
#: Characters of a text whose words are handled part by part.
LONG_TEXT = 1_000_000

# One round: rows of live words are joined with the merge table; in each word the pairs of least
# rank are contracted, of overlapping ones the leftmost (odd places of a chain); a word without a
# pair is done and leaves.
_ROUND = """
  WITH p AS (SELECT w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM {source}),
  q AS (SELECT p.w, p.pos, p.tok, m.rank, m.made FROM p LEFT JOIN merges m ON p.tok = m.l AND p.nxt = m.r),
  b AS (SELECT w, min(rank) AS best FROM q GROUP BY w),
  c AS (SELECT q.w, q.pos, q.tok, q.made, b.best, coalesce(q.rank = b.best, false) AS hit, row_number() OVER (PARTITION BY q.w ORDER BY q.pos) AS i FROM q JOIN b ON q.w = b.w),
  d AS (SELECT *, hit AND (i - coalesce(max(CASE WHEN NOT hit THEN i END) OVER (PARTITION BY w ORDER BY i), 0)) % 2 = 1 AS contract FROM c),
  e AS (SELECT *, lag(contract, 1, false) OVER (PARTITION BY w ORDER BY i) AS swallowed FROM d)
  SELECT w, pos, CASE WHEN contract THEN made ELSE tok END AS tok, best IS NOT NULL AS live FROM e WHERE NOT swallowed
"""
_QUERY = f"""
WITH RECURSIVE s(w, pos, tok, live) AS (
  SELECT w, pos, tok, true FROM words
  UNION ALL
  ({_ROUND.format(source="s WHERE live")})
)
SELECT w, list(tok ORDER BY pos) AS ids FROM s WHERE NOT live GROUP BY w ORDER BY w
"""


def read_model(path: str) -> dict:
    """The vocabulary and merges of a tokenizer file; one that cuts or changes text in another way raises.

    Its special tokens are ordinary text here.
    """
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, before = whole["model"], whole.get("pre_tokenizer") or {}
    wrong = [
        name
        for name, bad in (
            ("model", model.get("type", "BPE") != "BPE"),
            ("pre_tokenizer", before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True)),
            ("normalizer", whole.get("normalizer")),
            ("added_tokens", any(not t.get("special") for t in whole.get("added_tokens") or ())),
            *((key, model.get(key)) for key in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        )
        if bad
    ]
    if wrong:
        raise ValueError(f"{path} is no plain byte-level BPE: {', '.join(wrong)}")
    return model


class Known(dict):
    """Words with their ids; ``extra`` holds those of the round that are too long to be kept."""

    extra: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        return self.extra[word]


class Encoder:
    """Encodes texts with one vocabulary; made once in a worker."""

    def __init__(self, folder: str, vocabulary: str) -> None:
        import duckdb

        model = read_model(f"{folder}/{vocabulary}")
        ids, merges = model["vocab"], [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        spelled = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(shown))}
        back = {c: b for b, c in spelled.items()}
        self.spelled = {i: bytes(back[c] for c in token) for token, i in ids.items() if all(c in back for c in token)}
        self.byte_ids = np.array([ids[spelled[b]] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        table = pa.table({k: pa.array(v, pa.int32()) for k, v in {"l": [ids[a] for a, _ in merges], "r": [ids[b] for _, b in merges], "rank": range(len(merges)), "made": [ids[a + b] for a, b in merges]}.items()})
        self.db.register("given", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.unregister("given")
        # byte pairs that occur in no token are never merged across, so words may be cut there
        self.inside = np.zeros((256, 256), dtype=bool)
        for token in ids:
            if len(token) > 1 and all(c in back for c in token):
                held = [back[c] for c in token]
                self.inside[held[:-1], held[1:]] = True
        self.word, self.ascii_word = regex.compile(WORD), re.compile(ASCII_WORD)
        self.known = Known()

    def _pieces(self, word: bytes) -> list[bytes]:
        a = np.frombuffer(word, np.uint8)
        cuts = np.flatnonzero(~self.inside[a[:-1], a[1:]]) + 1
        if not len(cuts):
            return [word]
        ends = [0, *cuts.tolist(), len(word)]
        return [word[i:j] for i, j in zip(ends, ends[1:])]

    def _rows(self, pieces: list[bytes]) -> pa.Table:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        w = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        pos = np.arange(len(flat), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
        return pa.table({"w": w, "pos": pos, "tok": self.byte_ids[flat]})

    def _query(self, pieces: list[bytes]) -> list[list[int]]:
        self.db.register("words", self._rows(pieces))
        ids = self.db.sql(_QUERY).to_arrow_table().column("ids").to_pylist()
        self.db.unregister("words")
        return ids

    def _steps(self, piece: bytes) -> list[int]:
        """The same rounds one by one, so that only the last state of a very long word is held."""
        self.db.register("words", self._rows([piece]))
        self.db.execute("CREATE OR REPLACE TABLE state AS SELECT w, pos, tok, true AS live FROM words")
        self.db.unregister("words")
        while self.db.execute("SELECT live FROM state LIMIT 1").fetchone()[0]:
            self.db.execute(f"CREATE OR REPLACE TABLE state AS {_ROUND.format(source='state')}")
        return [x for (x,) in self.db.execute("SELECT tok FROM state ORDER BY pos").fetchall()]

    def _encode_pieces(self, pieces: list[bytes]) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {p: [int(self.byte_ids[p[0]])] for p in pieces if len(p) == 1}
        todo = sorted((p for p in pieces if len(p) > 1), key=len)
        chunk, size = [], 0
        for p in todo:
            if len(p) > STEP_BYTES:
                out[p] = self._steps(p)
                continue
            # a query holds the rows of all its rounds: about half the square of a word's bytes
            cost = len(p) * max(4, len(p) // 8)
            if chunk and size + cost > QUERY_BYTES * 4:
                out.update(zip(chunk, self._query(chunk)))
                chunk, size = [], 0
            chunk.append(p)
            size += cost
        if chunk:
            out.update(zip(chunk, self._query(chunk)))
        return out

    def learn(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of ``words``; the short ones become known."""
        if not words:
            return {}
        cut = {w: self._pieces(w.encode()) for w in words}
        done = self._encode_pieces(list(dict.fromkeys(chain.from_iterable(cut.values()))))
        new = {w: tuple(chain.from_iterable(done[p] for p in pieces)) for w, pieces in cut.items()}
        if len(self.known) + len(new) > KNOWN:
            self.known = Known(new)  # what is at work goes on with the old table
        else:
            self.known.update((w, x) for w, x in new.items() if len(w) <= KNOWN_CHARS)
        return new

    def words(self, text: str) -> list[str]:
        return (self.ascii_word if text.isascii() else self.word).findall(text)

    def _looked_up(self, words: set[str]) -> Known:
        """A table that holds the ids of ``words``."""
        known = self.known
        extra = self.learn(words.difference(known))
        if self.known is not known:  # forgotten: a table of its own for this round
            table = Known((w, known[w]) for w in words if w in known)
            table.update(extra)
            return table
        known.extra = extra
        return known

    def encode_batch(self, texts: list[str | None]) -> Iterator[Iterator[tuple[int, ...]]]:
        """For each text the ids of its words, to be taken before the next text; none for an empty or null one."""
        parts: list[list[str]] = []
        for text in texts:
            if text and len(text) > LONG_TEXT:
                yield from self._short(parts)
                parts = []
                yield self._long(text)
            else:
                parts.append(self.words(text) if text else [])
        yield from self._short(parts)

    def _long(self, text: str) -> Iterator[tuple[int, ...]]:
        words = self.word.finditer(text)
        while some := [m[0] for m in islice(words, 100_000)]:
            yield from map(self._looked_up(set(some)).__getitem__, some)

    def _short(self, texts: list[list[str]]) -> Iterator[Iterator[tuple[int, ...]]]:
        table = self._looked_up(set(chain.from_iterable(texts)))
        for words in texts:
            yield map(table.__getitem__, words)


    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Encoder:
    """The worker's encoder for a vocabulary."""
    if (folder, vocabulary) not in _ENCODERS:
        _ENCODERS[folder, vocabulary] = Encoder(folder, vocabulary)
    return _ENCODERS[folder, vocabulary]


def _batches(rows: Iterator[pa.RecordBatch], id_type: pa.DataType, folder: str, vocabulary: str, only_count: bool) -> Iterator[pa.RecordBatch]:
    name = "n_tokens" if only_count else "ids"
    enc = encoder(folder, vocabulary)

    def made(keys: list, lists: list) -> pa.RecordBatch:
        if only_count:
            column = pa.array(lists, pa.int64())
        else:
            flat = np.concatenate([np.frombuffer(x, np.int32) for x in lists if len(x)] or [np.zeros(0, np.int32)])
            column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array(keys, id_type), column], names=["doc_id", name])

    for batch in rows:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        chars = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        keys, lists, held, at = [], [], 0, 0
        while at < len(ids):
            # as many rows as one round of queries gets, at least one
            until = int(np.searchsorted(chars, (chars[at - 1] if at else 0) + ROUND_CHARS, side="right"))
            until = min(max(until, at + 1), at + ROUND_ROWS)
            for key, words in zip(ids[at:until], enc.encode_batch(texts.slice(at, until - at).to_pylist())):
                keys.append(key)
                if only_count:
                    lists.append(sum(map(len, words)))
                    continue
                lists.append(array("i", chain.from_iterable(words)))
                held += len(lists[-1])
                if held > BATCH_TOKENS:
                    yield made(keys, lists)
                    keys, lists, held = [], [], 0
            at = until
        if keys:
            yield made(keys, lists)


def _map(documents: DataFrame, only_count: bool, folder: str, vocabulary: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    rows = spread(documents.select("doc_id", "text"))
    kind = rows.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    out = f"doc_id {kind.simpleString()}, " + ("n_tokens bigint" if only_count else "ids array<int>")
    return rows.mapInArrow(lambda it: _batches(it, id_type, folder, vocabulary, only_count), out)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` in at least as many partitions as there are cores, so that few input files don't leave cores idle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores * 2) if rows.rdd.getNumPartitions() < cores else rows


def encode(documents: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row; the list is empty for an empty or null text. No special tokens.

    Blank text has the tokens of its spaces. Repeated rows stay; other columns are ignored.
    """
    return _map(documents, False, folder, vocabulary)


def count_tokens(documents: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row, 0 for an empty or null text."""
    return _map(documents, True, folder, vocabulary)


def decode(encoded: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the tokens' bytes one after the other; '' for an empty list, null stays null."""
    rows = encoded.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, vocabulary)
        for batch in batches:
            texts = [None if x is None else enc.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
