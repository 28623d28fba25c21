"""Text decoded with the wrong character encoding: learned from near-twins, found and restored."""

from __future__ import annotations

import math
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ship

#: The encodings among which an alignment is looked for, the commonest first.
WRONG = (
    "cp1252", "latin-1", "mac_roman", "cp437", "cp850", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "koi8-r",
    "cp1254", "iso8859-9", "cp1257", "cp852", "cp1253", "iso8859-7", "cp866", "iso8859-5", "mac_cyrillic",
)
RIGHT = (
    "utf-8", "cp1252", "cp850", "cp437", "cp1250", "iso8859-2", "cp1251", "koi8-r", "mac_roman", "cp852", "cp866",
    "cp1253", "iso8859-7", "cp1254", "iso8859-9", "iso8859-5", "gb18030", "shift_jis", "euc_jp", "big5", "euc_kr",
)
_SEVERAL = frozenset(("utf-8", "gb18030", "shift_jis", "euc_jp", "big5", "euc_kr"))
REPLACEMENT = "�"
_NEVER = "\uffff"  #: a code point that is no character
SLOTS = 1 << 20  #: counters of the character model; its size is fixed, whatever the corpus
CHARS = 1 << 16
#: Tokens that a task remembers, and the longest that it does: a bound of its memory, never of what is looked at.
TOKENS_KEPT, LONGEST_KEPT = 200_000, 200

_TOKEN = regex.compile(r"(?<![A-Za-z])[A-Za-z]*+[^\x00-\x7f](?:[A-Za-z]|[^\x00-\x7f])*+")
_RUN = regex.compile(r"[^\x00-\x7f]+")
#: Sentences end by ASCII alone, so that a text and its garbled twin fall into the same parts.
_SENTENCE = r"(?<=[.?!])[ \t]+|[\r\n]+"
_BEYOND = r"[^\x00-\x7f]+"
_EAST = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
#: A replacement character that stands for something lost: next to a letter, a digit or another one, or alone between blanks.
_LOST = regex.compile("[\\p{L}\\p{N}\ufffd]\ufffd|\ufffd[\\p{L}\\p{N}]")
_LONE = regex.compile("(?:^|\\s)\ufffd(?:\\s|$)")
#: How texts name the replacement character.
_NAMED = regex.compile(r"U\+FFFD|replacement character|&#xFFFD|&#65533|\\uFFFD", regex.IGNORECASE)


@lru_cache(maxsize=None)
def encode_table(codec: str) -> dict[str, int]:
    """Character to byte of a single-byte encoding. Bytes that it leaves undefined stand
    for the control character of the same number, as lenient decoders give them."""
    table: dict[str, int] = {}
    for b, c in enumerate(_decode_table(codec)):
        table.setdefault(c, b)
    return table


@lru_cache(maxsize=None)
def _sequence(wrong: str) -> regex.Pattern:
    """What a UTF-8 sequence of several bytes looks like when it is read as ``wrong``."""
    decode = _decode_table(wrong)
    some = lambda a, b: "[" + "".join(map(regex.escape, decode[a:b])) + "]"
    on = some(0x80, 0xC0)
    return regex.compile(f"{some(0xC2, 0xE0)}{on}|{some(0xE0, 0xF0)}{on}{{2}}|{some(0xF0, 0xF5)}{on}{{3}}")


@lru_cache(maxsize=None)
def _mapping(wrong: str, right: str) -> dict[int, str] | None:
    """Character to character between two single-byte encodings; a character that ``right`` lacks becomes
    ``_NEVER``. None where ``right`` has sequences of bytes."""
    if right in _SEVERAL:
        return None
    out = {}
    for c, b in encode_table(wrong).items():
        if c > "\x7f":
            try:
                new = bytes([b]).decode(right)
            except UnicodeDecodeError:
                new = _NEVER
            if new != c:
                out[ord(c)] = new
    return out


def undo(text: str, wrong: str, right: str) -> str | None:
    """The text before it was decoded as ``wrong`` instead of ``right``; None where that cannot be.

    Characters that ``wrong`` cannot give, and for UTF-8 bytes outside of
    a multi-byte sequence, stay as they are.
    """
    table = encode_table(wrong)
    if right == "utf-8":

        def read(m: regex.Match) -> str:
            try:
                return bytes([table[c] for c in m.group()]).decode("utf-8")
            except UnicodeDecodeError:
                return m.group()

        new = _sequence(wrong).sub(read, text)
    elif (mapping := _mapping(wrong, right)) is not None:
        new = text.translate(mapping)
        if _NEVER in new:
            return None
    else:
        # Pieces that ``wrong`` can give, and what stands between them.
        out: list[str] = []
        for inside, piece in groupby(text, lambda c: c in table):
            part = "".join(piece)
            try:
                out.append(bytes([table[c] for c in part]).decode(right) if inside else part)
            except UnicodeDecodeError:
                return None
        new = "".join(out)
    return None if new == text else new


@lru_cache(maxsize=None)
def _decode_table(codec: str) -> list[str]:
    """Byte to character; the control character of the same number where the encoding has none."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def explain(garbled: str, clean: str, rights: tuple[str, ...] = RIGHT) -> tuple[str, list[str]] | None:
    """Fits the aligned runs. The right encoding, and the wrong ones, that turn every non-ASCII run of ``garbled`` into the aligned run of
    ``clean``; runs that are the same in both say nothing. Both texts agree outside of these runs.

    The first right encoding that fits is taken. Encodings share characters, so several wrong ones may fit.
    """
    a, b = _RUN.findall(garbled), _RUN.findall(clean)
    pairs = [(x, y) for x, y in zip(a, b) if x != y]
    if not pairs or len(a) != len(b):
        return None
    same = all(len(x) == len(y) for x, y in pairs)
    fewer = all(len(x) > len(y) for x, y in pairs)
    by_char = frozenset.intersection(*(_fitting(c, d) for c, d in set(zip("".join(x for x, _ in pairs), "".join(y for _, y in pairs))))) if same else frozenset()
    for right in rights:
        if right in _SEVERAL:  # a character has several bytes
            fits = [w for w in WRONG if all(undo(x, w, right) == y for x, y in pairs)] if fewer else []
        else:
            fits = [w for w in WRONG if w != right and (w, right) in by_char]
        if fits:
            return right, fits
    return None


@lru_cache(maxsize=100_000)
def _fitting(garbled: str, clean: str) -> frozenset[tuple[str, str]]:
    """The pairs of single-byte encodings that turn one character into the other."""
    single = [r for r in RIGHT if r not in _SEVERAL]
    return frozenset((w, r) for w in WRONG for r in single if _mapping(w, r).get(ord(garbled), garbled) == clean)


def choose(seen: list[tuple[str, list[str], int]], least: int) -> list[tuple[str, str]]:
    """The fewest transformations that account for the alignments ``(right, fitting wrongs, count)``.

    For each right encoding the wrong one that fits most alignments is taken, then the one that fits most of the rest, and so on
    while it fits ``least`` (one for UTF-8, where whole byte sequences must agree). UTF-8 is then combined with
    every other wrong encoding that fits one of its alignments: encodings share characters, and its sequences tell by themselves whether they are meant.
    """
    out: list[tuple[str, str]] = []
    for right in RIGHT:
        rest = [(set(ws), n) for r, ws, n in seen if r == right]
        while rest:
            count = {w: sum(n for ws, n in rest if w in ws) for w in WRONG}
            best = max(WRONG, key=lambda w: count[w])
            if count[best] < (1 if right == "utf-8" else least):
                break
            out.append((best, right))
            rest = [(ws, n) for ws, n in rest if best not in ws]
    fitting = {w for right, ws, _ in seen if right == "utf-8" for w in ws}
    return out + [(w, "utf-8") for w in WRONG if w in fitting and (w, "utf-8") not in out]


def sentences(df: DataFrame, text: str) -> DataFrame:
    """Distinct sentences and lines with a non-ASCII character (``s``), and how often each stands in the corpus (``n``).
    Counts are combined map-side, so copies of a text, however many, shrink before the shuffle."""
    beyond_ascii = lambda c: F.octet_length(c) > F.length(c)
    whole = F.col(f"`{text}`").cast("string")
    parts = df.where(beyond_ascii(whole)).select(F.explode(F.split(whole, _SENTENCE)).alias("s")).where(beyond_ascii(F.col("s")))
    return parts.groupBy("s").agg(F.count("*").alias("n"))


def _twins(keyed: DataFrame) -> DataFrame:
    """Of rows (``k``, ``s``, ``n``), each ``s`` that shares a key with a commoner one, with the commonest (``rep``)."""
    best = (
        keyed.groupBy("k")
        .agg(F.max(F.struct("n", F.col("s").alias("rep"))).alias("m"), F.count("*").alias("variants"))
        .where("variants > 1")
        .select("k", F.col("m.rep").alias("rep"))
    )
    return keyed.join(best, "k").where("s != rep").select("s", "rep")


def _shape(units) -> bytes:
    """Which units of a sequence are the same; ASCII stands for itself. The shape of a garbled text equals that of the
    bytes, or characters, that it was garbled from."""
    seen: dict[int, int] = {}
    return array("I", [u if u < 128 else 128 + seen.setdefault(u, len(seen)) for u in units]).tobytes()


def shape_keys(text: str) -> set[int]:
    """Hashes of the shapes of a text's characters and of its bytes in UTF-8 and, for East Asian text, in the other encodings of several bytes."""
    shapes = {_shape(map(ord, text)), _shape(text.encode("utf-8", "surrogatepass"))}
    if _EAST.search(text):
        for codec in RIGHT[-5:]:
            try:
                shapes.add(_shape(text.encode(codec)))
            except UnicodeEncodeError:
                pass
    return {int.from_bytes(blake2b(x, digest_size=8).digest(), "little", signed=True) for x in shapes}


def _keyed(variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sentences (``s``, ``n``) by a key ``k`` that one and its garbled twin have in common: the text without its non-ASCII
    characters if that has six letters. If it has fewer, as in scripts other than Latin, it says little; eight or more
    non-ASCII characters then give ``shape_keys``. The former and the latter apart."""
    skeleton = F.regexp_replace("s", _BEYOND, "")
    lettered = skeleton.rlike(r"(?:[A-Za-z][^A-Za-z]*){6}")

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys = [], []
            for i, t in enumerate(b.column(0).to_pylist()):
                new = shape_keys(t)
                at += [i] * len(new)
                keys += new
            rows = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), rows.column(0), rows.column(1)], names=["k", "s", "n"])

    others = variants.where(~lettered & (F.char_length("s") - F.char_length(skeleton) >= 8)).select("s", "n")
    plain = variants.where(lettered).select(F.xxhash64(skeleton).alias("k"), "s", "n")
    return plain, others.mapInArrow(shaped, "k long, s string, n long")


def learn_transformations(variants: DataFrame, least: int = 2) -> list[tuple[str, str]]:
    """Transformations (wrong, right) found between near-twins among ``sentences``.

    Twins are sentences or lines that are the same once their non-ASCII characters are taken
    out (``_keyed``), and words of four ASCII letters that are. Each variant is set against the commonest of its skeleton: the ASCII
    characters anchor the two, so the runs between them align one to one, and the alignment
    shows the encodings (``explain``); ``choose`` picks those that account for all. Single words show UTF-8 only, whose
    byte sequences don't fit by chance.

    Scale: distinct sentences are joined with one representative per skeleton; a skeleton with many variants yields one
    pair per variant, not all pairs. Only counts of sets of the catalogue's encodings reach the driver.
    """
    token = r"((?<![A-Za-z])[A-Za-z]*+[^\x00-\x7f][A-Za-z[^\x00-\x7f]]*+)"
    words = variants.select(F.explode(F.regexp_extract_all("s", F.lit(token), F.lit(1))).alias("s"), "n").groupBy("s").agg(F.sum("n").alias("n"))
    plain = F.regexp_replace("s", _BEYOND, "")
    words = words.where(F.char_length(plain) >= 4)

    def shown(rights: tuple[str, ...]):
        def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count: Counter[tuple[str, str]] = Counter()
            for b in batches:
                for s, rep in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if _RUN.sub("", s) == _RUN.sub("", rep) and (found := explain(s, rep, rights) or explain(rep, s, rights)):
                        # An alignment of many different characters is no chance.
                        count[found[0], " ".join(found[1])] += 2 if len(set("".join(_RUN.findall(s)))) >= 8 else 1
            if count:
                r, w = zip(*count)
                yield pa.RecordBatch.from_pydict({"right": list(r), "wrongs": list(w), "n": list(count.values())})

        return explained

    schema = "right string, wrongs string, n long"
    lettered, shaped = _keyed(variants)
    # Both are read twice, for the commonest of a key and for the others.
    shaped, words = (x.persist(StorageLevel.MEMORY_AND_DISK) for x in (shaped, words.select(F.xxhash64(plain).alias("k"), "s", "n")))
    try:
        whole = _twins(lettered.unionByName(shaped)).mapInArrow(shown(RIGHT), schema)
        single = _twins(words).mapInArrow(shown(("utf-8",)), schema)
        rows = whole.unionByName(single).groupBy("right", "wrongs").agg(F.sum("n").alias("n"))
        return choose(sorted((r[0], r[1].split(" "), r[2]) for r in rows.collect()), least)
    finally:
        shaped.unpersist()
        words.unpersist()


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _units(token: str) -> str:
    """A token with its edges marked and its ASCII letters in lower case."""
    return "\x02" + token.translate(_LOWER) + "\x03"


def _slots(a: str, b: str) -> tuple[int, int]:
    """The pair's counters in the two rows of a count-min sketch."""
    x, y = ord(a), ord(b)
    return (x * 0x9E3779B1 ^ y * 0x85EBCA77) % SLOTS, SLOTS + ((x * 0xC2B2AE3D + y * 0x27D4EB2F) >> 7) % SLOTS


@dataclass
class CharacterModel:
    """An interpolated character-bigram model; its pairs are counted in a sketch of fixed size."""

    pairs: np.ndarray
    chars: np.ndarray

    def __post_init__(self) -> None:
        self.total = max(1, int(self.chars.sum()))
        self.kinds = max(1, int((self.chars > 0).sum()))
        self.known: dict[str, float] = {}

    def pair(self, pair: str) -> float:
        """Negative log probability of the second character after the first; 0 for two ASCII characters."""
        if pair.isascii():
            return 0.0
        if (cost := self.known.get(pair)) is None:
            a, b = pair
            ca, cb = int(self.chars[ord(a) % CHARS]), int(self.chars[ord(b) % CHARS])
            # Pairs may share counters; a pair is never commoner than the rarer of its counters and characters.
            i, j = _slots(a, b)
            n = min(int(self.pairs[i]), int(self.pairs[j]), ca, cb)
            cost = -math.log(0.7 * n / (ca + 1) + 0.299 * cb / self.total + 0.001 / self.kinds)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[pair] = cost
        return cost

    def surprise(self, token: str) -> float:
        """Negative log probability of the token's pairs that touch a non-ASCII character."""
        u = _units(token)
        return sum([self.pair(u[i : i + 2]) for i in range(len(u) - 1)])


def character_model(variants: DataFrame) -> CharacterModel:
    """Counts of all character pairs in the non-ASCII tokens of ``sentences``. A sentence counts with its number to the power 0.75,
    so that copies of one garbled text, were they a third of the corpus, do not outweigh a language. The result has 2 * ``SLOTS`` + ``CHARS``
    counters at most, whatever the corpus; partial counts are added per task before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, chars = np.zeros(2 * SLOTS, np.int64), np.zeros(CHARS, np.int64)
        for b in batches:
            tokens: Counter[str] = Counter()
            for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                weight = max(1, round(n**0.75))
                for token in _TOKEN.findall(t):
                    tokens[token] += weight
            two: Counter[str] = Counter()
            for token, n in tokens.items():
                u = _units(token)
                for i in range(len(u) - 1):
                    two[u[i : i + 2]] += n
            for u, n in two.items():
                i, j = _slots(u[0], u[1])
                pairs[i] += n
                pairs[j] += n
                chars[ord(u[0]) % CHARS] += n
                if u[1] == "\x03":
                    chars[3] += n
        at, ac = np.flatnonzero(pairs), np.flatnonzero(chars)
        yield pa.RecordBatch.from_pydict(
            {"slot": np.r_[at, -1 - ac].astype(np.int64), "n": np.r_[pairs[at], chars[ac]].astype(np.int64)}
        )

    rows = variants.select("s", "n").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    table = rows.toArrow()
    slot, n = table["slot"].to_numpy(), table["n"].to_numpy()
    pairs, chars = np.zeros(2 * SLOTS, np.int64), np.zeros(CHARS, np.int64)
    pairs[slot[slot >= 0]] = n[slot >= 0]
    chars[-1 - slot[slot < 0]] = n[slot < 0]
    return CharacterModel(pairs, chars)


_CONTROL = regex.compile("[\x80-\x9f\ufffd]")
_BLANK = regex.compile("[\xa0\xad\u200b\ufeff]+")
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Cutoffs:
    """Gains in nats from which a transformation is taken.

    ``multi``: a token whose bytes form UTF-8 sequences; ``byte`` is added for each byte that does. ``single``: a token between single-byte
    encodings, to be restored at all. A document is a case by single-byte tokens if ``several`` different
    ones gain ``together`` in sum, or one alone gains ``alone`` (or ``single`` where it holds a control
    character next to letters).
    """

    multi: float = 2.5
    byte: float = 2.0
    single: float = 3.0
    several: int = 2
    together: float = 8.0
    alone: float = 6.5


@dataclass
class Verdict:
    """What was found in one text: the restored text, and why it is a case ('' where it is none)."""

    text: str
    reason: str = ""
    gain: float = 0.0


class Repairer:
    """Applies learned transformations where the character model prefers what comes out."""

    def __init__(self, transformations: list[tuple[str, str]], model: CharacterModel, cut: Cutoffs = Cutoffs()) -> None:
        self.transformations, self.model, self.cut = transformations, model, cut
        self.known: dict[str, tuple[str, float, bool, tuple[str, str] | None]] = {}

    def cost(self, token: str) -> float:
        return self.model.surprise(token) + 6.0 * len(_CONTROL.findall(token))

    def token(self, token: str) -> tuple[str, float, bool, tuple[str, str] | None]:
        """The restored token, what it gains in nats, whether UTF-8 was involved and the transformation, where it is a single one; the
        token, 0 where nothing fits."""
        if (hit := self.known.get(token)) is not None:
            return hit
        # Text may be garbled as UTF-8 more than once; a step in between need not look better than the text.
        reached: dict[str, tuple[bool, tuple[str, str] | None]] = {}
        front = [token]
        first, depth = True, 0
        while front:  # every step after the first makes the token shorter
            after = []
            depth += 1
            if depth > 3:  # by now one reading leads
                front = [min(front, key=lambda t: (len(t), t))]
            for now in front:
                for w, r in self.transformations:
                    if not first and r != "utf-8":
                        continue
                    new = undo(now, w, r)
                    if new is not None and new not in reached and new.count(REPLACEMENT) <= token.count(REPLACEMENT):
                        reached[new] = r == "utf-8", (w, r) if first else None
                        if r == "utf-8":
                            after.append(new)
            front, first = after, False
        now, total, multi, how = token, 0.0, False, None
        if reached:
            before = self.cost(token)
            # A UTF-8 reading also has its sequences in its favour: each character fewer is a byte that fitted.
            gains = {t: before - self.cost(t) + (self.cut.byte * (len(token) - len(t)) if m else 0.0) for t, (m, _) in reached.items()}
            new, gain = max(gains.items(), key=lambda x: (x[1], x[0]))
            if gain >= (self.cut.multi if reached[new][0] else self.cut.single):
                now, total, (multi, how) = new, gain, reached[new]
        if len(token) <= LONGEST_KEPT:
            if len(self.known) > TOKENS_KEPT:
                self.known.clear()
            self.known[token] = (now, total, multi, how)
        return now, total, multi, how

    def text(self, text: str) -> Verdict:
        """Judges a whole text and restores what can be restored."""
        utf8, single, control = 0.0, {}, False
        new_of: dict[str, str] = {}
        gained: Counter[tuple[str, str]] = Counter()
        unsure = []
        for token in set(_TOKEN.findall(text)):
            new, gain, multi, how = self.token(token)
            if gain <= 0:
                unsure.append(token)
                continue
            new_of[token] = new
            if how:
                gained[how] += gain
            if multi:
                utf8 = max(utf8, gain)
            elif _LETTER.search(token) and _RUN.sub("", token) != token and _RUN.search(_BLANK.sub("", token)):
                shown = [c for c, d in zip(token, new) if c != d] if len(token) == len(new) else list(token)
                if any(not _BLANK.match(c) for c in shown):
                    single[token] = gain
                    control |= bool(_CONTROL.search(token))
        by_single = bool(single) and (
            (len(single) >= self.cut.several and sum(single.values()) >= self.cut.together)
            or max(single.values()) >= self.cut.alone
            or control
        )
        lost = REPLACEMENT in text and bool(_LOST.search(text) or (_LONE.search(text) and not _NAMED.search(text)))
        if not (utf8 or by_single or lost):
            return Verdict(text)
        reason = "multi" if utf8 else "single" if by_single else "lost"
        if by_single and gained:
            # Words too short to tell alone follow the transformation of the text.
            how = max(gained, key=lambda x: (gained[x], x))
            for token in unsure:
                if how[1] != "utf-8" and (new := undo(token, *how)) is not None and self.cost(new) < self.cost(token):
                    new_of[token] = new
        restored = _TOKEN.sub(lambda m: new_of.get(m.group(), m.group()), text) if utf8 or by_single else text
        return Verdict(restored, reason, utf8 + sum(single.values()))


#: The repairer of the query that a worker process served last; its tokens serve the next partition too.
_LAST: tuple[str, Repairer] | None = None


def _repairer(query: str, learned, cut: Cutoffs) -> Repairer:
    global _LAST
    if _LAST is None or _LAST[0] != query:
        _LAST = (query, Repairer(*learned.value, cut))
    return _LAST[1]


def garbled_texts(df: DataFrame, key: str, text: str, cut: Cutoffs = Cutoffs(), least: int = 2) -> DataFrame:
    """Records with text decoded by the wrong encoding, and their text restored where it can be.

    Output: ``key``, ``restored`` (the text with every recognised token restored), ``reason`` (``multi``:
    UTF-8 read as something else; ``single``: one single-byte encoding read as another;
    ``lost``: only replacement characters, which cannot be undone), ``complete`` (nothing garbled is left that is known to be).

    Semantics
    - Null, empty and pure ASCII texts are no case. Repeated keys and texts come out as often as they come in.
    - A replacement character is a case, restorable or not, where it stands next to a letter, a digit or another one, or alone between blanks in
      a text that doesn't name the character; one that is quoted or in brackets is not.
    - Correct text is kept: a token changes only where the corpus's own character statistics prefer the
      result by ``cut``. In a corpus without near-twins nothing is learned, and only ``lost`` is found.

    Method: ``learn_transformations`` joins near-twins on text without its non-ASCII characters, aligns
    them and infers the encodings; these mappings are then applied to all records.

    Scale: two passes over the column. The first counts distinct sentences, which the two learning steps share; they are kept only until both
    are done, and a lost part is computed again. The second pass has no shuffle. The model has a fixed number of
    counters and the transformations are a subset of the catalogue, so what tasks receive does not grow.
    """
    spark = df.sparkSession
    ship(spark)
    variants = sentences(df, text).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        learned = spark.sparkContext.broadcast((learn_transformations(variants, least), character_model(variants)))
    finally:
        variants.unpersist()
    query = uuid.uuid4().hex

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = _repairer(query, learned, cut)
        for b in batches:
            keep, restored, reason, complete = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if not t or t.isascii():
                    continue
                v = repairer.text(t)
                if v.reason:
                    keep.append(i)
                    restored.append(v.text)
                    reason.append(v.reason)
                    complete.append(REPLACEMENT not in v.text)
            if keep:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(keep)), pa.array(restored), pa.array(reason), pa.array(complete)],
                    names=[key, "restored", "reason", "complete"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(
        repaired, f"`{key}` {kind}, restored string, reason string, complete boolean"
    )
