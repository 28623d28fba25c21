"""Evaluation items inside training text: suffix arrays over the corpus, searched with every item suffix."""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ship

#: Words of one shard's suffix array; bounds a task's memory. A longer text is a shard of its own.
WORDS_AT_ONCE = 1_500_000
#: Bytes of item text beyond which the items are searched in several blocks, each with its own pass.
ITEM_BLOCK_BYTES = 8_000_000
#: Cells of the table of texts by item words that is looked at at once.
PRESENCE_CELLS = 16_000_000
#: Pairs of text and item whose verbatim matches are looked up at once.
PAIRS_AT_ONCE = 1_000

_ASCII_WORD = regex.compile(r"[a-z0-9]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}\p{Me}\p{Cc}&&[^\t\n\r\x0b\x0c\x1c-\x1f\x85]]", regex.V1)
#: Scripts that are written without blanks between words.
_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\u30fc"
_UNSPACED_ONE = regex.compile(f"[{_UNSPACED}]")
_UNIT = regex.compile(f"[{_UNSPACED}]|[\\p{{L}}\\p{{N}}--[{_UNSPACED}]]+", regex.V1)
_ESCAPE = regex.compile(r"\\[nrt\"']")


def words_of(text: str | None) -> list[str]:
    """The words of a text without the differences that do not count: letter case, punctuation,
    spacing, line breaks, quoting, character form (width, ligatures, styles, accents) and
    invisible characters. In scripts without blanks, whose words can't be told apart by their looks, every two neighbouring
    letters are a word (a lone letter is one by itself)."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    plain = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text))
    plain = plain.casefold()
    if not _UNSPACED_ONE.search(plain):
        return _WORD.findall(plain)
    units = _UNIT.findall(plain)
    alone = [len(u) > 1 or not _UNSPACED_ONE.match(u) for u in units]
    out = []
    for k, u in enumerate(units):
        if alone[k]:
            out.append(u)
        elif k + 1 < len(units) and not alone[k + 1]:
            out.append(u + units[k + 1])
        elif k == 0 or alone[k - 1]:
            out.append(u)
    return out


@dataclass(frozen=True)
class Rule:
    """What counts as a leak. The stretch spans ``share`` of an item's words, in order; at most ``item_gap - 1`` words
    of it in a row are replaced or lost and at most ``text_gap - 1`` foreign words stand in between; ``dense``: the least part
    of the stretch that is matched; ``matched``: the least part of the item that is. ``few``: that many shared words
    are no stretch yet, unless they are the whole item."""

    share: float = 0.39
    item_gap: int = 4
    text_gap: int = 80
    dense: float = 0.75
    few: int = 2
    matched: float = 0.0

    def least_words(self, size: int) -> int:
        """Words of an item of ``size`` words that a stretch matches at the least."""
        least = max(1, math.ceil(self.share * size - 1e-9))
        return math.ceil(max(self.dense * least, self.matched * size) - 1e-9)


#: A stretch of the least length may lose one word in four. Of a text that shares more of the item every second
#: word may be replaced: 100,000 texts of the items' own domain share 0.41 of an item by chance at most.
RULES = (Rule(), Rule(share=0.48, dense=0.48, matched=0.48))


class ItemIndex:
    """The items' words as one coded sequence, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids: list[int] = []
        self.codes: list[np.ndarray] = []
        self.vocabulary: dict[str, int] = {}
        for item_id, text in items:
            words = words_of(text)
            if words:
                self.ids.append(item_id)
                self.codes.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32))
        self.longest = max((len(c) for c in self.codes), default=0)
        # All items in a row, each ended by a 0; a suffix is a place in it.
        sizes = np.array([len(c) for c in self.codes], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        self.flat = np.concatenate([x for c in self.codes for x in (c, [0])]).astype(np.int32) if self.codes else np.zeros(1, np.int32)
        self.first, self.sizes = first, sizes


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``codes`` sorted by their first ``depth`` codes, by prefix doubling. Code 0 (a word of no
    item, or a text's end) ends a comparison: suffixes that begin with it are left out."""
    n = len(codes)
    live = np.flatnonzero(codes)
    rank = codes.astype(np.int64)
    step = 1
    while step < depth and len(live):
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:]
        pair = rank[live] * (int(rank.max()) + 1) + ahead[live]
        _, dense = np.unique(pair, return_inverse=True)
        rank = np.zeros(n, np.int64)
        rank[live] = dense + 1
        if dense.max() + 1 == len(live):
            break
        step *= 2
    return live[np.argsort(rank[live], kind="stable")]


def _compare(codes: np.ndarray, at: np.ndarray, flat: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Sign of text suffix minus item suffix; a 0 is below everything and ends both."""
    out = np.zeros(len(at), np.int8)
    idx, k = np.arange(len(at)), 0
    while len(idx):
        t = codes[at[idx] + k]
        d = np.sign(t - flat[query[idx] + k]).astype(np.int8)
        out[idx] = d
        idx = idx[(d == 0) & (t != 0)]
        k += 1
    return out


def search(codes: np.ndarray, sa: np.ndarray, flat: np.ndarray, query: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Binary search of item suffixes among the sorted text suffixes ``sa[low:high]``, each in its own part, all at once: the first one not below
    the item suffix."""
    lo, hi = low.copy(), high.copy()
    while (lo < hi).any():
        idx = np.flatnonzero(lo < hi)
        mid = (lo[idx] + hi[idx]) // 2
        go = _compare(codes, sa[mid], flat, query[idx]) < 0
        lo[idx[go]] = mid[go] + 1
        hi[idx[~go]] = mid[~go]
    return lo


def verbatim_matches(codes: np.ndarray, sa: np.ndarray, flat: np.ndarray, query: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, text position) of the longest verbatim match of every item suffix ``flat[query:]`` among the text suffixes ``sa[low:high]``.

    The place of a suffix among the sorted text suffixes is found by binary search; its longest match begins
    at one of the two text suffixes next to it. Of matches of one length one of the two counts, the earlier in the text. Both sequences end with a 0.
    """
    best, place = np.zeros(len(query), np.int64), np.full(len(query), -1)
    at = search(codes, sa, flat, query, low, high)
    for side in (at - 1, at):
        going = np.flatnonzero((side >= low) & (side < high))
        begin, length = np.full(len(query), -1), np.zeros(len(query), np.int64)
        begin[going] = sa[side[going]]
        while len(going):
            k = length[going]
            word = flat[query[going] + k]  # 0 ends an item
            going = going[(codes[begin[going] + k] == word) & (word > 0)]
            length[going] += 1
        better = (length > best) | ((length == best) & (length > 0) & (begin < place))
        best, place = np.where(better, length, best), np.where(better, begin, place)
    return best, place


def longest_stretch(item: np.ndarray, text: np.ndarray, rule: Rule) -> tuple[int, int]:
    """(span, matched) of the best in-order stretch of ``item`` in ``text``, (0, 0) if there is none: the most matched words in a chain
    whose neighbours are at most ``item_gap`` apart in the item and ``text_gap`` in the text, which spans ``share`` of the item and
    is ``dense``.

    Of the chains that end at a pair of places those are kept that no other one beats both in span and in surplus, matched - dense * span;
    so chance matches in front of a stretch don't hide it. A chain that can't become long or dense any more is dropped.
    Where words are both lost and foreign ones put in, the text may be another one that shares ``few`` words by chance: a stretch
    doesn't begin or end with no more than that beyond such a break. Inside it they count.
    """
    places: dict[int, list[int]] = defaultdict(list)
    wanted = set(item.tolist())
    for j, w in enumerate(text.tolist()):
        if w in wanted:
            places[w].append(j)
    n, dense, full = len(item), rule.dense, rule.few + 1
    needed = rule.matched * n - 1e-9
    least = max(1, int(np.ceil(rule.share * n - 1e-9)))
    best = (0, 0)
    recent: list[tuple[list[int], list[list[tuple[int, int]]]]] = []  # of the last item words: text positions, chains as (kind, first item word, matched)
    for i, w in enumerate(item.tolist()):
        here = []
        hope = dense * (i + 1) - (1 - dense) * (n - 1 - i) - 1e-9  # the least matched + dense * first that can still become dense
        for j in places.get(w, ()):
            # Kinds: words since the break, negative; without a break, words so far; full with more than few.
            most = {(min(1, full), i): 1} if i <= n - least else {}
            for back, (positions, chains) in enumerate(reversed(recent), 1):
                for x in range(bisect_left(positions, j - rule.text_gap), bisect_left(positions, j)):
                    broken = back > 1 and j - positions[x] > back
                    for kind, first, matched in chains[x]:
                        if broken:
                            if 0 < kind < full:
                                continue
                            kind = -1 if full > 1 else full
                        else:
                            kind = min(kind + 1, full) if kind > 0 else kind - 1 if 1 - kind < full else full
                        if matched >= most.get((kind, first), 0):
                            most[kind, first] = matched + 1
            kept, top, last = [], hope, None
            for kind, first in sorted(most):
                matched = most[kind, first]
                if kind != last:
                    top, last = hope, kind
                if matched + dense * first < top or matched + n - 1 - i < needed:
                    continue
                top = matched + dense * first + 1e-9
                kept.append((kind, first, matched))
                span = i - first + 1
                if kind > 0 and span >= least and matched >= max(dense * span - 1e-9, needed) and (matched, span) > best[::-1]:
                    best = (span, matched)
            here.append(kept)
        recent.append((places.get(w, []), here))
        if len(recent) > rule.item_gap:
            recent.pop(0)
    return best


def candidates(codes: np.ndarray, start: np.ndarray, index: ItemIndex, rules: tuple[Rule, ...]) -> Iterator[tuple[int, int, Rule]]:
    """All (text, item, rule) where the text can hold a stretch of the item by the rule, and few others.

    A stretch spans at least ``share`` of the item's words and at least ``dense`` of those it spans are matched, each
    by the same word of the text, in whatever places. So a run of that many item words exists of which that part is in the text at all.
    Whether one exists is told by the running sum of (word is in the text) - ``dense``: it doesn't fall over the run.
    """
    at = np.flatnonzero(codes)  # every place of an item's word is a seed of one word
    doc = np.searchsorted(start, at, "right") - 1
    docs = len(start) - 1
    least = [np.maximum(1, np.ceil(r.share * index.sizes - 1e-9)).astype(np.int64) for r in rules]
    need = [np.array([r.least_words(int(n)) for n in index.sizes]) for r in rules]
    fewest = np.min(need, axis=0)
    step = max(1, PRESENCE_CELLS // max(len(index.flat), len(index.vocabulary) + 1))
    for low in range(0, docs, step):
        rows = min(step, docs - low)
        mine = slice(*np.searchsorted(doc, [low, low + rows]))
        has = np.zeros((rows, len(index.vocabulary) + 1), bool)
        has[doc[mine] - low, codes[at[mine]]] = True
        present = has[:, index.flat]
        count = np.add.reduceat(present, index.first, axis=1, dtype=np.int32)
        for i in np.flatnonzero((count >= fewest).any(axis=0)):
            for rule, long_, words in zip(rules, least, need):
                some = np.flatnonzero(count[:, i] >= words[i])
                if not len(some):
                    continue
                run = np.zeros((len(some), index.sizes[i] + 1))
                np.cumsum(present[some, index.first[i] : index.first[i] + index.sizes[i]] - rule.dense, axis=1, out=run[:, 1:])
                lowest = np.minimum.accumulate(run[:, : -long_[i]], axis=1)
                for k in some[(run[:, long_[i] :] >= lowest - 1e-6).any(axis=1)]:
                    yield low + int(k), int(i), rule


def common_words(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, by the bit-parallel recurrence: one addition per word of the text."""
    mask: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        mask[w] = mask.get(w, 0) | 1 << i
    every = (1 << len(item)) - 1
    row = every
    for w in text[text > 0].tolist():
        if m := mask.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & every
    return len(item) - row.bit_count()


def shard_leaks(
    docs: list[tuple[object, np.ndarray]], index: ItemIndex, rules: tuple[Rule, ...] = RULES
) -> Iterator[tuple[object, int, int, int, int, float]]:
    """(key, item_id, longest verbatim words, its first word in the text, matched words, share) of a shard's leaks."""
    if not index.codes or not docs:
        return
    sizes = np.array([len(c) + 1 for _, c in docs])
    start = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.zeros(start[-1], np.int32)
    for k, (_, c) in enumerate(docs):
        codes[start[k] : start[k] + len(c)] = c
    best: dict[tuple[int, int], tuple[int, int]] = {}
    common: dict[tuple[int, int], int] = {}
    for d, i, rule in candidates(codes, start, index, rules):
        if (d, i) in best:  # by an earlier rule
            continue
        # A stretch is a common subsequence.
        if (d, i) not in common:
            common[d, i] = common_words(index.codes[i], docs[d][1])
        if common[d, i] < rule.least_words(len(index.codes[i])):
            continue
        # The whole text: a chain may go on from gap to gap, however far from its verbatim matches.
        span, matched = longest_stretch(index.codes[i], docs[d][1], rule)
        if matched > min(rule.few, len(index.codes[i]) - 1):
            best[d, i] = (matched, span)
    if not best:
        return
    sa = suffix_array(codes, index.longest)
    doc = np.searchsorted(start, sa, "right") - 1
    by_doc = np.argsort(doc, kind="stable")
    part = np.searchsorted(doc[by_doc], np.arange(len(docs) + 1))
    pairs = sorted(best)
    for low in range(0, len(pairs), PAIRS_AT_ONCE):
        some = np.array(pairs[low : low + PAIRS_AT_ONCE])
        n = index.sizes[some[:, 1]]
        of = np.repeat(np.arange(len(some)), n)
        query = np.arange(len(of)) - np.repeat(np.cumsum(n) - n - index.first[some[:, 1]], n)
        d = some[of, 0]
        length, place = verbatim_matches(codes, sa[by_doc], index.flat, query, part[d], part[d + 1])
        order = np.lexsort((place, -length, of))
        for (d, i), top in zip(some.tolist(), order[np.searchsorted(of[order], np.arange(len(some)))]):
            matched, span = best[d, i]
            yield docs[d][0], index.ids[i], int(length[top]), int(place[top] - start[d]), matched, float(span / index.sizes[i])


def leaked_items(
    docs: DataFrame,
    key: str,
    text: str,
    items: DataFrame,
    item_key: str,
    item_text: str,
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """Texts that contain evaluation items, wholly or by a stretch of their words.

    Output: ``key``, ``item_key``, ``longest`` (words of the longest verbatim match), ``position`` (its first word
    in the text), ``matched`` words and ``share`` of the item's words that the stretch spans. One row
    per text row and item.

    Semantics
    - Null, empty and blank texts and items match nothing. An empty side gives no rows. Repeated texts come out each.
    - Words are compared as ``words_of`` gives them; ``rules`` say what a stretch is; one of them must hold.
    - Texts are searched whole, however long.

    Method: each task holds a shard of texts as one sequence of word codes. A text and an item whose words can make a stretch
    (``candidates``: seeds of one word, as a stretch need not hold two neighbouring words) are aligned exactly. The shard's suffix array is then searched for every suffix of
    the item, which gives its longest verbatim matches and their places in the text.

    Scale: the corpus is read once and not shuffled; a shard has a bounded number of words. The items, a stated query set,
    are sent to the tasks in blocks of ``ITEM_BLOCK_BYTES``; more items mean more passes, not larger tasks.
    """
    spark = docs.sparkSession
    ship(spark)
    sized = items.where(F.col(f"`{item_text}`").isNotNull()).select(
        F.col(f"`{item_key}`").cast("long").alias("id"), F.col(f"`{item_text}`").cast("string").alias("t")
    ).distinct()
    total = sized.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-int(total) // ITEM_BLOCK_BYTES))
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"))
    schema = f"`{key}` {kind}, `{item_key}` long, longest int, position int, matched int, share double"
    out = None
    for block in range(blocks):
        part = sized if blocks == 1 else sized.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        index = spark.sparkContext.broadcast(ItemIndex([(r[0], r[1]) for r in part.orderBy("id").collect()]))

        def leaks(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known, held, count = index.value, [], 0

            def flush() -> Iterator[pa.RecordBatch]:
                rows = list(shard_leaks(held, known, rules))
                if rows:
                    k, i, l, p, m, s = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k, key_type), pa.array(i, pa.int64()), *[pa.array(x, pa.int32()) for x in (l, p, m)], pa.array(s)],
                        names=[key, item_key, "longest", "position", "matched", "share"],
                    )

            get = known.vocabulary.get
            for b in batches:
                key_type = b.schema.field(0).type
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    words = words_of(t)
                    codes = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
                    if not codes.any():
                        continue
                    held.append((k, codes))
                    count += len(codes)
                    if count >= WORDS_AT_ONCE:
                        yield from flush()
                        held, count = [], 0
            if held:
                yield from flush()

        found = source.mapInArrow(leaks, schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, key: str, leaks: DataFrame) -> DataFrame:
    """The texts that no item leaked into. ``key`` must be unique; rows with a null key stay."""
    return docs.join(leaks.select(F.col(f"`{key}`")).distinct(), key, "left_anti")
