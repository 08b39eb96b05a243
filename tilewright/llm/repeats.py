"""Periodic runs of word sequences, found by Crochemore's partition refinement.

Positions of a text are classed by the factor of ``length`` words that begins there. Classes of one more
word come from splitting: two positions of a class part if their successors have parted. Of the children
of a split class all but the largest are looked at in the next step (smaller half), so a position is looked
at O(log n) times. Each class keeps its positions in a linked list; neighbours whose distance equals the
length begin a square with a primitive root, and consecutive such positions are one run.

All texts of a batch are refined together, each in classes of its own, as arrays: a step costs what
it touches, and the texts share the steps.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, crc_sql, slices, words_of

#: Text that is refined together.
TOGETHER = 16_000_000

_RUNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Classes:
    """Classes of equal factors, refined by one word at a time.

    ``members`` holds the positions so that each class (``start``, ``size``) is one piece of it, ``place``
    is its inverse; ``after`` and ``before`` link a class's positions in ascending order (-1: none).
    ``most`` is the longest period of interest for each position; beyond it a text is left alone.
    """

    def __init__(self, symbols: np.ndarray, most: np.ndarray):
        n = len(symbols)
        self.most, self.length = most, 1
        self.members = np.argsort(symbols, kind="stable")
        ordered = symbols[self.members]
        same = ordered[1:] == ordered[:-1]
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        self.n_classes = len(first)
        self.start = np.zeros(2 * n + 2, np.int64)
        self.size = np.zeros(2 * n + 2, np.int64)
        self.start[: len(first)] = first
        self.size[: len(first)] = np.diff(np.append(first, n))
        self.of = np.empty(n, np.int64)
        self.of[self.members] = np.repeat(np.arange(len(first)), self.size[: len(first)])
        self.place = np.empty(n, np.int64)
        self.place[self.members] = np.arange(n)
        self.after, self.before = np.full(n, -1), np.full(n, -1)
        left, right = self.members[:-1][same], self.members[1:][same]
        self.after[left], self.before[right] = right, left
        self.touched = np.zeros(n + 1, bool)  # one more, so that -1 is untouched
        self.due: defaultdict[int, list[np.ndarray]] = defaultdict(list)  # distance to positions that had it
        self._note(left, right)
        self.small = np.arange(n)

    def _note(self, left: np.ndarray, right: np.ndarray) -> None:
        """Keeps new neighbours for the step whose length is their distance."""
        apart = right - left
        ok = (apart >= self.length) & (apart <= self.most[left])
        left, apart = left[ok], apart[ok]
        if len(left):
            order = np.argsort(apart, kind="stable")
            left, apart = left[order], apart[order]
            cuts = np.flatnonzero(apart[1:] != apart[:-1]) + 1
            for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(left)], strict=True):
                self.due[int(apart[at])].append(left[at:end])

    def squares(self) -> np.ndarray:
        """Ascending positions where a square of two factors of the present length begins."""
        held = self.due.pop(self.length, None)
        if held is None:
            return np.empty(0, np.int64)
        found = np.concatenate(held)
        return np.unique(found[self.after[found] - found == self.length])

    def refine(self) -> bool:
        """Goes on to factors of one more word; False if no class can split any more."""
        ask = self.small - 1
        ask = ask[ask >= 0]
        ask = ask[(self.size[self.of[ask]] > 1) & (self.most[ask] > self.length)]
        self.length += 1
        if not len(ask):
            return False
        # Positions whose successor lies in a small class, by (class, successor's class, position).
        key = self.of[ask] * self.n_classes + self.of[ask + 1]
        order = np.argsort(key, kind="stable")
        ask, key = ask[order], key[order]
        part = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        sizes = np.diff(np.append(part, len(ask)))
        old = self.of[ask[part]]  # of each part
        lead = np.concatenate([[0], np.flatnonzero(old[1:] != old[:-1]) + 1])  # the first part of each class
        n_parts = np.diff(np.append(lead, len(part)))
        rest = self.size[old[lead]] - np.add.reduceat(sizes, lead)
        splits = (rest > 0) | (n_parts > 1)
        if not splits.all():
            part_splits = np.repeat(splits, n_parts)
            ask = ask[np.repeat(part_splits, sizes)]
            sizes, old, rest, n_parts = sizes[part_splits], old[part_splits], rest[splits], n_parts[splits]
            lead = np.cumsum(n_parts) - n_parts
        self.small = ask[:0]
        if not len(ask):
            return True
        self._split(ask, sizes, old, lead, n_parts, rest)
        return True

    def _split(self, ask: np.ndarray, sizes: np.ndarray, old: np.ndarray, lead: np.ndarray, n_parts: np.ndarray, rest: np.ndarray) -> None:
        classes, moved = old[lead], np.add.reduceat(sizes, lead)
        largest = np.maximum.reduceat(sizes, lead)
        at = np.flatnonzero(sizes == np.repeat(largest, n_parts))
        owner = np.repeat(np.arange(len(lead)), n_parts)[at]
        main = at[np.concatenate([[True], owner[1:] != owner[:-1]])]  # the first largest part of each class
        tail = self.start[classes] + rest

        # Moved positions fill the end of their class's piece, in order of parts; what was there fills their places.
        slots = _ranges(tail, moved)
        self.touched[ask] = True
        there = self.members[slots]
        stay = there[~self.touched[there]]
        free = self.place[ask]
        free = free[free < np.repeat(tail, moved)]
        self.members[free], self.place[stay] = stay, free
        self.members[slots], self.place[ask] = ask, slots

        # Links: over the gaps that moved positions leave in their old lists, then within the parts.
        was_after = self.after[ask]
        is_first, is_last = ~self.touched[self.before[ask]], ~self.touched[was_after]
        by_position = np.repeat(classes, moved) * len(self.of) + ask
        firsts, lasts = ask[is_first], ask[is_last]
        left = self.before[firsts[np.argsort(by_position[is_first])]]
        right = self.after[lasts[np.argsort(by_position[is_last])]]
        has_left, has_right = left >= 0, right >= 0
        self.after[left[has_left]] = right[has_left]
        self.before[right[has_right]] = left[has_right]
        self.touched[ask] = False
        both = has_left & has_right
        self._note(left[both], right[both])
        begins = np.zeros(len(ask) + 1, bool)
        begins[np.cumsum(sizes) - sizes] = begins[-1] = True
        self.after[ask] = np.where(begins[1:], -1, np.append(ask[1:], -1))
        self.before[ask] = np.where(begins[:-1], -1, np.append(-1, ask[:-1]))
        new = (self.after[ask] >= 0) & (self.after[ask] != was_after)
        self._note(ask[new], self.after[ask[new]])

        # The rest keeps the class's number, else the largest part does; all other parts get new numbers.
        fresh = np.ones(len(sizes), bool)
        fresh[main[rest == 0]] = False
        numbers = old.copy()
        numbers[fresh] = self.n_classes + np.arange(fresh.sum())
        self.n_classes += int(fresh.sum())
        while self.n_classes > len(self.size):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.size[classes] = rest
        begin = np.repeat(tail, n_parts) + np.cumsum(sizes) - sizes - np.repeat((np.cumsum(sizes) - sizes)[lead], n_parts)
        self.start[numbers], self.size[numbers] = begin, sizes
        self.of[ask] = np.repeat(numbers, sizes)

        # All children but the largest one are small.
        small = np.ones(len(sizes), bool)
        small[main[rest < largest]] = False
        held = (rest > 0) & (rest < largest)
        self.small = np.sort(np.concatenate([ask[np.repeat(small, sizes)], self.members[_ranges(self.start[classes[held]], rest[held])]]))


def _stretches(symbols: np.ndarray, times: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the stretches that can hold runs: a run has each of its words ``times`` times at least.

    Positions of rarer words part a text; what is left is counted again by itself, a few times over.
    """
    begin, length = np.zeros(1, np.int64), np.array([len(symbols)])
    for _ in range(8):
        at = _ranges(begin, length)
        if not len(at):
            return begin[:0], length[:0]
        _, back, n = np.unique(np.repeat(np.arange(len(begin)), length) * (len(symbols) + 1) + symbols[at], return_inverse=True, return_counts=True)
        often = n[back] >= times
        edge = np.zeros(len(at), bool)
        edge[np.cumsum(length) - length] = True  # no stretch goes over the end of a former one
        opens = often & (edge | np.concatenate([[True], ~often[:-1]]))
        shuts = often & np.concatenate([edge[1:] | ~often[1:], [True]])
        first, last = np.flatnonzero(opens), np.flatnonzero(shuts)
        long = last - first + 1 >= least
        first, last = first[long], last[long]
        settled = len(first) == len(begin) and (last - first + 1).sum() == len(at)
        begin, length = at[first], last - first + 1
        if settled:
            break
    return begin, length


def find_runs(texts: list[list[bytes]], least: int = 24, times: int = 3) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each word list, by start, then period.

    A run has length of at least ``least`` and of ``times`` (2 or more) its smallest period, and no
    neighbouring word extends it. Memory is about 100 bytes for each word of all lists, and another 150 for
    each word in a stretch where all words are frequent enough for a run.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lengths = np.array([len(t) for t in texts], np.int64)
    if not lengths.sum():
        return out
    number: dict[bytes, int] = defaultdict(count(0).__next__)
    words = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum()))
    ends = np.cumsum(lengths)
    # No text shares a word's number with another.
    _, words = np.unique(words + np.repeat(np.arange(len(texts)), lengths) * len(number), return_inverse=True)
    begin, length = _stretches(words, times, least)
    if not len(begin):
        return out
    # The stretches one after the other, each with an end of its own; none shares a class with another.
    stops = np.cumsum(length + 1)
    symbols = np.full(int(stops[-1]), -1)
    symbols[_ranges(stops - length - 1, length)] = words[_ranges(begin, length)]
    symbols += np.repeat(np.arange(len(begin)), length + 1) * (len(words) + 1)
    classes = _Classes(symbols, np.repeat(length // times, length + 1))
    shift = begin - (stops - length - 1)
    while True:
        period, at = classes.length, classes.squares()
        if len(at):
            cuts = np.flatnonzero(np.diff(at) > 1) + 1
            first, last = at[np.concatenate([[0], cuts])], at[np.append(cuts, len(at)) - 1]
            size = last - first + 2 * period
            ok = size >= max(least, times * period)
            first, size = first[ok], size[ok]
            place = first + shift[np.searchsorted(stops, first, side="right")]
            of = np.searchsorted(ends, place, side="right")
            for d, s, n in zip(of.tolist(), (place - ends[of] + lengths[of]).tolist(), size.tolist(), strict=True):
                out[d].append((s, n, period))
        if not classes.refine():
            return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def _digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = words
    if runs:
        drops = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            drops[s + q] += 1
            drops[s + n] -= 1
        kept = [words[i] for i in np.flatnonzero(np.cumsum(drops[:-1]) == 0)]
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return len(runs), *head, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def _finder(least: int, times: int, schema: pa.Schema, n_others: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", TOGETHER):
            texts = [words_of(t) for t in batch.column("_text").to_pylist()]
            rows = [_digest(w, r) for w, r in zip(texts, find_runs(texts, least, times), strict=True)]
            made = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[n_others:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_others], *made], schema=schema)

    return run


def periodic_runs(docs: DataFrame, text: Column | str = "text", least: int = 24, times: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row with its text's runs: how many, the one of the greatest exponent
    (ties: smallest start, then period), and digests of the list of runs and of the text without repeats.

    One pass without a shuffle; every row gives one row, equal rows equal ones. Null, empty and blank texts
    have no words and no run: four nulls and the digests of nothing. A very long text is refined as a whole
    in its task, about 250 bytes of memory a word. An empty table gives an empty one. Columns that are not
    in ``keep`` are not looked at, whatever their names; null ids are kept.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    text = F.col(text) if isinstance(text, str) else text
    rows = docs.select(*keep, text.alias("_text"))
    out = StructType([*rows.schema.fields[:-1], *StructType.fromDDL(_RUNS).fields])
    return rows.mapInArrow(_finder(least, times, to_arrow_schema(out), len(keep)), out)


def looped(doc_id: Column, text: Column) -> Column:
    """The text with a planted loop, where crc32 of the id's decimal digits ends in 0: from word a on it repeats p words.

    With g = crc32 / 10 and n words, a = g % n and p = 1 + (n - a) / (3 + g % 8), whole numbers all. Other
    texts, and those without words, stay as they are; a null id counts as the empty text.
    """
    crc = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(crc / 10)
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))

    def repeated(state: Column) -> Column:
        w = state["w"]
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        at = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(F.transform(at, lambda i: F.element_at(w, F.when(i < a, i + 1).otherwise(a + (i - a) % p + 1).cast("int"))), " ")

    # The words are computed once: a one-element array carries them into the expression.
    planted = F.element_at(F.transform(F.array(F.struct(words.alias("w"))), repeated), 1)
    return F.when((crc % 10 == 0) & text.rlike(WORD_PATTERN), planted).otherwise(text)


#: The query's rows by pairs of equal words: stretches of pairs q apart are the runs.
RUNS_SQL = rf"""
with split as (
  select doc_id, coalesce(regexp_extract_all(text, '{WORD_PATTERN}'), []) as given, {crc_sql("coalesce(doc_id::varchar, '')")} as crc from documents
), placed as (
  select *, len(given) as n, crc // 10 as g, case when len(given) > 0 then (crc // 10) % len(given) end as a from split
), texts as (
  select row_number() over () as d, doc_id, n, case when crc % 10 = 0 and n > 0 then
    list_transform(range(n), lambda i: given[(case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end) + 1]) else given end as w
  from placed
), words as materialized (
  select d, n, unnest(w) as w, unnest(range(n)) as i from texts
), pairs as (
  select x.d, x.i, y.i - x.i as q from words x join words y on x.d = y.d and x.w = y.w and y.i > x.i and 3 * (y.i - x.i) <= x.n
), islands as (
  select d, q, i, i - row_number() over (partition by d, q order by i) as island from pairs
), stretches as materialized (
  select d, min(i) as s, count(*) + q as len, q from islands group by d, q, island having count(*) + q >= greatest(24, 3 * q)
), runs as materialized (
  select * from stretches r where not exists (select 1 from stretches o where o.d = r.d and o.q < r.q and o.s <= r.s and o.s + o.len >= r.s + r.len)
), listed as (
  select d, count(*) as n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as runs,
    first({{'s': s, 'len': len, 'q': q}} order by len::double / q desc, s, q) as best
  from runs group by d
), kept as (
  select d, string_agg(w, ' ' order by i) as text from words x
  where not exists (select 1 from runs r where r.d = x.d and x.i >= r.s + r.q and x.i < r.s + r.len) group by d
)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.s::bigint as start, best.len::bigint as length, best.q::bigint as period,
  (1000 * best.len // best.q)::bigint as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(text, '')) as collapsed_sha256
from texts left join listed using (d) left join kept using (d)
"""
