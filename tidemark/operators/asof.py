"""Attributes as known at event time, by path-copied persistent search trees."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import ship


class PersistentTree:
    """A search tree over the ranks ``0 .. ranks-1`` that keeps every version of itself.

    Version ``j`` puts a leaf at rank ``order[j]``, or replaces the one that stands there. This copies the nodes on
    the path from root to leaf and shares all others with the version before, so
    a version is one root. The shape is the balanced binary tree over the
    ranks; a version makes exactly one node per level, so node ``j`` of a
    level belongs to version ``j`` and whole levels are built by array operations:
    the untouched child of a new node is the latest earlier node whose path
    runs through the sibling.
    """

    def __init__(self, order: np.ndarray) -> None:
        n = len(order)
        ranks = int(order.max()) + 1 if n else 1
        self.depth = max(1, (ranks - 1).bit_length())
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.count: list[np.ndarray] = [None] * (self.depth + 1)  # type: ignore[list-item]
        version = np.arange(n)
        for level in range(self.depth):
            prefix = order >> (self.depth - level - 1)  # position on the level below
            by_place = np.lexsort((version, prefix))
            code = prefix[by_place] * (n + 1) + version[by_place]
            sibling = (prefix ^ 1) * (n + 1) + version
            at = np.searchsorted(code, sibling) - 1
            hit = (at >= 0) & (prefix[by_place][np.maximum(at, 0)] == (prefix ^ 1))
            other = np.where(hit, by_place[np.maximum(at, 0)], -1)
            is_right = (prefix & 1).astype(bool)
            self.left.append(np.where(is_right, other, version))
            self.right.append(np.where(is_right, version, other))
        self.count[self.depth] = np.ones(n, np.int64)
        for level in range(self.depth - 1, -1, -1):
            self.count[level] = self._size(level + 1, self.left[level]) + self._size(level + 1, self.right[level])

    def _size(self, level: int, node: np.ndarray) -> np.ndarray:
        return np.where(node >= 0, self.count[level][np.maximum(node, 0)], 0) if len(node) else node

    def floor(self, root: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest rank at most ``key`` in version ``root`` and the version that put its leaf, -1 where there is none.

        ``root`` -1 is the empty version. One descent counts the ranks at most
        ``key``, a second walks to the last of them.
        """
        node, below = root.copy(), np.zeros(len(root), np.int64)
        for level in range(self.depth):
            bit = (key >> (self.depth - level - 1)) & 1
            safe = np.maximum(node, 0)
            left = np.where(node >= 0, self.left[level][safe], -1)
            right = np.where(node >= 0, self.right[level][safe], -1)
            below += np.where(bit == 1, self._size(level + 1, left), 0)
            node = np.where(bit == 1, right, left)
        below += (node >= 0).astype(np.int64)
        found = (below > 0) & (key >= 0)
        node, rest, rank = np.where(found, root, -1), below.copy(), np.zeros(len(root), np.int64)
        for level in range(self.depth):
            safe = np.maximum(node, 0)
            left = np.where(node >= 0, self.left[level][safe], -1)
            right = np.where(node >= 0, self.right[level][safe], -1)
            size = self._size(level + 1, left)
            go_right = rest > size
            rest = np.where(go_right, rest - size, rest)
            node = np.where(go_right, right, left)
            rank = rank * 2 + go_right
        return np.where(found, rank, -1), np.where(found, node, -1)


def _ranks(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Dense rank of the rows by the tuple of columns, null lowest."""
    n = table.num_rows
    order = pc.sort_indices(
        table.select(columns), sort_keys=[(c, "ascending") for c in columns], null_placement="at_start"
    ).to_numpy()
    new = np.zeros(n, bool)
    for c in columns:
        v = table[c].combine_chunks().dictionary_encode(null_encoding="encode")
        code = v.indices.to_numpy(zero_copy_only=False)[order]
        new[1:] |= code[1:] != code[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    return rank


def known_as_of(
    events: DataFrame,
    attributes: DataFrame,
    entity: list[str],
    event_day: str,
    known_day: str,
    valid: list[str],
    payload: list[str],
    valid_limit: str | None = None,
    shards: int | None = None,
    per_shard: int = 200_000,
    asked_from: DataFrame | None = None,
) -> DataFrame:
    """Each event with the attributes of its entity that were known on its day.

    An attribute row is known from ``known_day`` on. Among the rows known on
    the event's day (``known_day <= event_day``), the one with the greatest ``valid`` tuple
    is taken; with ``valid_limit`` (an event column of the type of ``valid[0]``), the
    greatest one whose ``valid[0]`` is at most it. Output: all event columns, and
    ``payload`` columns, null where nothing was known. Rows that become known later
    never count, whatever time they are valid for.

    Semantics
    - Repeated events stay; every event row comes out exactly once. An event
      with a null entity or day has null payload. Attribute rows with a null entity or known
      day are never known. Null is the lowest value of ``valid``.
    - Attribute rows equal in entity and ``valid`` are versions of one fact: the one known last
      by the event's day counts, so a correction is seen from its own day on and not before. Of versions known on the
      same day the greatest ``payload`` tuple counts; put a delivery time first in it to
      take the last delivery of a day. Give a full key in ``valid`` to keep rows apart.
    - Clashing names: events may have any columns; payload columns that the events
      already have are refused with ``ValueError``.

    - ``asked_from``: a frame with the entity, day and limit columns of the events, such as the events
      before other attributes were joined to them; it is read instead to see which days are asked.

    Method: per shard of entities, the versions of the attributes are put in known order into a
    persistent search tree keyed by (entity, valid); a later version of a fact replaces its leaf on a copied path. An event picks the root
    of its known time by binary search over the versions, then searches that version
    for the greatest key of its entity.

    Scale: one pass over the entity columns counts the rows of each entity, from which the number of shards (about ``per_shard`` rows each) is
    derived. Events are first reduced to distinct (entity, day[, limit]), which a hot entity
    bounds by the calendar, and met again by the joined pair, so no task gets one
    entity's events. Attributes are made distinct map-side. Where an entity has more than
    ``per_shard`` attribute rows it is split into salts, each with its own trees; its
    distinct days are asked in every salt and the best answer counts. Without such an entity the plan has
    no salts.
    """
    if clash := set(payload) & set(events.columns):
        raise ValueError(f"payload columns that events already have: {sorted(clash)}")
    ship(events.sparkSession)
    ent = [F.col(f"`{e}`") for e in entity]
    en = [f"e{i}" for i in range(len(entity))]
    present = lambda cols: reduce(and_, [c.isNotNull() for c in cols])
    keys = [e.cast("string").alias(n) for e, n in zip(ent, en)]
    names = [f"v{i}" for i in range(len(valid))]
    known_rows = attributes.where(present([*ent, F.col(f"`{known_day}`")]))
    events_asked = (events if asked_from is None else asked_from).where(present([*ent, F.col(f"`{event_day}`")]))
    sizes = known_rows.groupBy(*keys).agg(F.count("*").alias("n"))
    rows, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    salted = (largest or 0) > per_shard
    if shards is None:
        ask = events_asked.select(*keys).count()
        shards = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-max(rows or 0, ask) // per_shard))
    facts = (
        known_rows.groupBy(
            *keys,
            *[F.col(f"`{v}`").alias(n) for v, n in zip(valid, names)],
            F.unix_date(F.col(f"`{known_day}`").cast("date")).alias("known"),
        )
        .agg(F.max(F.struct(*[F.col(f"`{p}`") for p in payload])).alias("payload"))
    )
    asked = events_asked.select(
        *keys,
        F.unix_date(F.col(f"`{event_day}`").cast("date")).alias("day"),
        (F.col(f"`{valid_limit}`") if valid_limit else F.lit(None).cast("int")).alias("top"),
    ).distinct()
    if salted:
        hot = sizes.where(F.col("n") > per_shard).select(*en, F.ceil(F.col("n") / per_shard).cast("int").alias("salts"))
        many = F.coalesce(F.col("salts"), F.lit(1))
        facts = facts.join(hot, en, "left").withColumn("salt", F.pmod(F.xxhash64(*names), many).cast("int"))
        asked = asked.join(hot, en, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1)))
    who = [*en, "salt"] if salted else en
    shard = F.pmod(F.xxhash64(*who), F.lit(shards)).cast("int").alias("shard")
    facts = facts.select(shard, *who, *names, "known", "payload")
    asked = asked.select(shard, *who, "day", "top")
    out_type = T.StructType([asked.schema[c] for c in [*en, "day", "top"]] + [facts.schema[c] for c in [*names, "payload"]])

    def answer(q: pa.Table, a: pa.Table) -> pa.Table:
        if not a.num_rows or not q.num_rows:
            return pa.Table.from_batches([], schema=answer_schema(a, q))
        joint = pa.concat_tables([a.select(who), q.select(who)])
        owner = _ranks(joint, who)
        of_fact, of_event = owner[: a.num_rows], owner[a.num_rows :]
        a = a.append_column("owner", pa.array(of_fact))
        rank = _ranks(a, ["owner", *names])  # versions of one fact share a rank
        known = a["known"].to_numpy()
        order = np.lexsort((rank, known))
        tree = PersistentTree(rank[order])
        root = np.searchsorted(known[order], q["day"].to_numpy(), "right") - 1
        # The greatest rank that may answer: the last of the owner, or the last within the limit.
        by_rank = np.empty(int(rank.max()) + 1, np.int64)
        by_rank[rank] = of_fact
        key = np.searchsorted(by_rank, of_event, "right") - 1
        if valid_limit:
            first = a[names[0]].combine_chunks()
            top = q["top"].combine_chunks()
            both = pa.chunked_array([first, top.cast(first.type)]).combine_chunks()
            value = _ranks(pa.table({"x": both}), ["x"])
            big = int(value.max()) + 2
            code = np.empty(len(by_rank), np.int64)
            code[rank] = of_fact * big + value[: a.num_rows]  # rises with the rank
            key = np.searchsorted(code, of_event * big + value[a.num_rows :], "right") - 1
            key = np.where(top.is_null().to_numpy(zero_copy_only=False), -1, key)
        got, version = tree.floor(root, key)
        own = (got >= 0) & (by_rank[np.maximum(got, 0)] == of_event)
        pick = pa.array(order[version[own]])
        hit = q.filter(pa.array(own))
        cols = {c: hit[c] for c in [*en, "day", "top"]} | {c: a[c].take(pick) for c in [*names, "payload"]}
        return pa.table(cols)

    def answer_schema(a: pa.Table, q: pa.Table) -> pa.Schema:
        return pa.schema(
            [q.schema.field(c) for c in [*en, "day", "top"]] + [a.schema.field(c) for c in [*names, "payload"]]
        )

    best = asked.groupBy("shard").cogroup(facts.groupBy("shard")).applyInArrow(answer, out_type)
    if salted:
        best = best.groupBy(*en, "day", "top").agg(F.max(F.struct(*names, "payload")).alias("best"))
        best = best.select(*en, "day", "top", "best.payload")
    keyed = events.withColumns(
        {f"__{n}": k for n, k in zip(en, keys)}
        | {
            "__day": F.unix_date(F.col(f"`{event_day}`").cast("date")),
            "__top": F.col(f"`{valid_limit}`") if valid_limit else F.lit(None).cast("int"),
        }
    )
    best = best.select(
        *[F.col(n).alias(f"__{n}") for n in en],
        F.col("day").alias("__day"),
        *([F.col("top").alias("__top")] if valid_limit else []),
        F.col("payload").alias("__payload"),
    )
    on = [f"__{n}" for n in en] + ["__day"] + (["__top"] if valid_limit else [])
    out = keyed.join(best, on, "left")
    return out.select(
        *[F.col(f"`{c}`") for c in events.columns], *[F.col(f"__payload.`{p}`").alias(p) for p in payload]
    )
