"""Byte-pair encoding of a corpus by a public tokenizer, as recursive DuckDB queries per partition."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ship

#: Fixed value: the pattern by which byte-level tokenizers cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Token rows that one recursive query may pile up before it is continued in a further one.
ROWS_PER_QUERY = 4_000_000
#: Distinct words whose ids a task remembers.
WORDS_KEPT = 300_000

# One round contracts, in every unfinished word, its pair of least rank: from the left, all places of
# it that do not overlap. A merged pair never has a lesser rank than the merge that made its parts, so this
# equals contracting the leftmost place again and again. Only rows of unfinished words go on;
# a word is finished in the round in which no pair of it is in the merge table.
_ROUNDS = """
WITH RECURSIVE step AS (
  SELECT word, pos, tok, 0 AS round FROM seed
  UNION ALL
  SELECT word, pos, CASE WHEN starts THEN merged ELSE tok END, round + 1
  FROM (
    SELECT *, coalesce(lag(starts) OVER w, false) AS swallowed
    FROM (
      SELECT *, hit AND (row_number() OVER (PARTITION BY word, island, hit ORDER BY pos)) % 2 = 1 AS starts
      FROM (
        SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER w2 AS island
        FROM (
          SELECT p.*, coalesce(p.rank = p.least, false) AS hit
          FROM (
            SELECT n.word, n.pos, n.tok, n.round, m.rank, m.merged, min(m.rank) OVER (PARTITION BY n.word) AS least
            FROM (SELECT word, pos, tok, round, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS next FROM step WHERE round < $rounds) n
            LEFT JOIN merges m ON m.l = n.tok AND m.r = n.next
          ) p
          WHERE p.least IS NOT NULL
        )
        WINDOW w2 AS (PARTITION BY word ORDER BY pos)
      )
    )
    WINDOW w AS (PARTITION BY word ORDER BY pos)
  )
  WHERE NOT swallowed
)
SELECT word, round, list(tok ORDER BY pos) AS ids FROM (
  SELECT *, max(round) OVER (PARTITION BY word) AS last FROM step
) WHERE round = last GROUP BY word, round
"""


def merge_table(path: str) -> tuple[np.ndarray, pa.Table]:
    """Ids of the 256 bytes and the merge table (l, r, rank, merged) of a tokenizer file.

    The file spells bytes as printable characters by a fixed rule: printable ones stand for themselves, the others
    for the code points from 256 on, in order.
    """
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spelled = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in spelled):
        spelled[b] = chr(256 + k)
    vocab = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    table = pa.table(
        {
            "l": pa.array([vocab[a] for a, _ in pairs], pa.int32()),
            "r": pa.array([vocab[b] for _, b in pairs], pa.int32()),
            "rank": pa.array(np.arange(len(pairs), dtype=np.int32)),
            "merged": pa.array([vocab[a + b] for a, b in pairs], pa.int32()),
        }
    )
    return np.array([vocab[spelled[b]] for b in range(256)], np.int32), table


class Encoder:
    """Encodes words by recursive queries; remembers the words it has seen. Nothing is spilled to a local disk: a query's rows are
    bounded by ``ROWS_PER_QUERY``."""

    def __init__(self, path: str, pattern: str = PATTERN, memory: str = "800MB") -> None:
        self.byte_ids, merges = merge_table(path)
        self.cut = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "preserve_insertion_order": False, "temp_directory": ""})
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.known: dict[str, np.ndarray] = {}

    def learn(self, words: list[str]) -> None:
        """Adds the ids of new words. Each query runs a bounded number of rounds, so that the rows it
        piles up stay below ``ROWS_PER_QUERY``; words that are not finished seed the next one."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        # Words of about the same length need about the same number of rounds.
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        at = 0
        while at < len(order):
            size, group = 0, []
            while at < len(order) and (not group or size + len(raw[order[at]]) <= ROWS_PER_QUERY // 16):
                group.append(order[at])
                size += len(raw[order[at]])
                at += 1
            self._fixpoint(words, raw, group)

    def _fixpoint(self, words: list[str], raw: list[bytes], group: list[int]) -> None:
        lengths = [len(raw[i]) for i in group]
        flat = np.frombuffer(b"".join(raw[i] for i in group), np.uint8)
        seed = pa.table(
            {
                "word": pa.array(np.repeat(np.array(group, np.int64), lengths)),
                "pos": pa.array(np.concatenate([np.arange(n) for n in lengths]).astype(np.int32) if lengths else []),
                "tok": pa.array(self.byte_ids[flat]),
            }
        )
        while seed.num_rows:
            rounds = max(4, min(64, ROWS_PER_QUERY // seed.num_rows))
            self.db.register("seed", seed)
            out = self.db.sql(_ROUNDS, params={"rounds": rounds}).to_arrow_table()
            self.db.unregister("seed")
            done = out["round"].to_numpy() < rounds
            ids = out["ids"].combine_chunks()
            values = ids.values.to_numpy().astype(np.int32)
            bounds = ids.offsets.to_numpy()
            word = out["word"].to_numpy()
            for k in np.flatnonzero(done):
                self.known[words[word[k]]] = values[bounds[k] : bounds[k + 1]]
            rest = np.flatnonzero(~done)
            parts = [values[bounds[k] : bounds[k + 1]] for k in rest]
            sizes = [len(p) for p in parts]
            seed = pa.table(
                {
                    "word": pa.array(np.repeat(word[rest], sizes).astype(np.int64)),
                    "pos": pa.array(np.concatenate([np.arange(n) for n in sizes]).astype(np.int32) if sizes else np.zeros(0, np.int32)),
                    "tok": pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)),
                }
            )

    def encode(self, texts: list[str | None]) -> pa.Array:
        """Lists of ids; an empty list for null and empty texts."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        cut = [self.cut.findall(t) if t else [] for t in texts]
        new = {w for words in cut for w in words if w not in self.known}
        if new:
            self.learn(list(new))
        known = self.known
        parts = [known[w] for words in cut for w in words]
        sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
        per_text = np.fromiter((len(words) for words in cut), np.int64, len(cut))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(per_text)] if len(cut) else np.zeros(0, np.int64)
        values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values, pa.int32()))


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer: str, chars_at_once: int = 4_000_000) -> DataFrame:
    """The token ids of every text by a byte-level BPE tokenizer, without special tokens.

    Output: ``key`` and ``ids`` (array of int), one row per input row. ``tokenizer`` is the path of the
    tokenizer's file on the executors.

    Semantics
    - Null and empty texts have an empty list, never null. Strings that spell special tokens are ordinary text.
    - Repeated keys and texts come out as often as they come in. Whole texts are encoded, however long.

    Method: a task cuts its texts into words by the tokenizer's pattern; the distinct words it has not
    seen become token-position rows in DuckDB. A recursive query joins them with the merge table
    and contracts each word's pair of least rank until no pair is left; an ordered aggregation gives
    the word's ids, and a text's ids are those of its words.

    Scale: no shuffle and nothing on the driver. A text is encoded where it is read; a task
    holds ``chars_at_once`` characters of text (one text at least) and a bounded memory of words.
    """
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or Encoder(tokenizer)
            texts = b.column(1).to_pylist()
            begin, count = 0, 0
            for i, t in enumerate(texts):
                count += len(t or "")
                if count >= chars_at_once or i == len(texts) - 1:
                    ids = encoder.encode(texts[begin : i + 1])
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, i + 1 - begin), ids], names=[key, "ids"])
                    begin, count = i + 1, 0

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(encoded, f"`{key}` {kind}, ids array<int>")
