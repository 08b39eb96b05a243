"""Win patterns over 5 x 5 grids: a small language of masks and rules, compiled to column expressions.

A mask is an integer whose bit 5 * row + column stands for a cell. A pattern is a tree of masks,
AtLeast / AtMost rules, AND and OR. It compiles to a boolean column over a bitmask of marked cells, to the first
call position at which it holds, given each cell's position, or, as AtMost can stop holding, to all spans of
positions in which it holds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE, FREE_BIT = 5, 12
CELLS = SIDE * SIDE
#: Position of a cell that is never called.
NEVER = 1 << 40


class PatternError(ValueError):
    """The text of a pattern is wrong."""


@dataclass(frozen=True)
class Mask:
    bits: int


@dataclass(frozen=True)
class AtLeast:
    bits: int
    n: int


@dataclass(frozen=True)
class AtMost:
    bits: int
    n: int


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


def row_mask(r: int) -> int:
    return 31 << (SIDE * r)


def col_mask(c: int) -> int:
    return sum(1 << (SIDE * r + c) for r in range(SIDE))


DIAGONALS = (sum(1 << (6 * i) for i in range(SIDE)), sum(1 << (4 * i + 4) for i in range(SIDE)))
FULL = (1 << CELLS) - 1


def window_masks(high: int, wide: int) -> list[int]:
    """All windows of a size, as masks."""
    return [
        sum(1 << (SIDE * (r + i) + c + j) for i in range(high) for j in range(wide))
        for r in range(SIDE - high + 1)
        for c in range(SIDE - wide + 1)
    ]


def cells_of(bits: int) -> list[int]:
    return [i for i in range(CELLS) if bits >> i & 1]


_LINES = [*map(row_mask, range(SIDE)), *map(col_mask, range(SIDE))]


def _any(masks: list[int]) -> Any:
    return Any(tuple(map(Mask, masks)))


#: The named patterns: lines with or without diagonals, two rows, six-packs, and the whole grid.
PATTERNS = {
    "standard": _any([*_LINES, *DIAGONALS]),
    "hardway": _any(_LINES),
    "top_or_bottom": _any([row_mask(0), row_mask(4)]),
    "six_pack": _any(window_masks(2, 3) + window_masks(3, 2)),
    "diagonals": _any([*DIAGONALS]),
    "both_diagonals": All(tuple(map(Mask, DIAGONALS))),
    "top3_and_bottom3": All((AtLeast(row_mask(0), 3), AtLeast(row_mask(4), 3))),
    "blackout": Mask(FULL),
}


def holds(pattern, marked: Column) -> Column:
    """Whether a pattern holds for a bitmask. An empty mask or AND holds, an empty OR does not."""
    match pattern:
        case Mask(bits):
            return marked.bitwiseAND(F.lit(bits)) == bits
        case AtLeast(bits, n):
            return F.bit_count(marked.bitwiseAND(F.lit(bits))) >= n
        case AtMost(bits, n):
            return F.bit_count(marked.bitwiseAND(F.lit(bits))) <= n
        case All(parts):
            return reduce(lambda a, b: a & b, [holds(p, marked) for p in parts], F.lit(True))
        case Any(parts):
            return reduce(lambda a, b: a | b, [holds(p, marked) for p in parts], F.lit(False))
    raise PatternError(f"no pattern: {pattern!r}")


def holds_for(pattern, marked: int) -> bool:
    """``holds`` for one number, on the driver."""
    match pattern:
        case Mask(bits):
            return marked & bits == bits
        case AtLeast(bits, n):
            return (marked & bits).bit_count() >= n
        case AtMost(bits, n):
            return (marked & bits).bit_count() <= n
        case All(parts):
            return all(holds_for(p, marked) for p in parts)
    return any(holds_for(p, marked) for p in pattern.parts)


def first_win(pattern, positions: list[Column], start: Column | None = None, never: Column | None = None) -> Column:
    """The first position at which a pattern without AtMost holds; ``never`` if it never does. Positions must not be null.

    Positions are of any type with an order; ``start`` is before and ``never`` after all others (0 and NEVER by default).
    """
    start = F.lit(0).cast("long") if start is None else start
    never = F.lit(NEVER) if never is None else never
    match pattern:
        case Mask(bits):
            cells = [positions[i] for i in cells_of(bits)]
            return F.greatest(*cells) if len(cells) > 1 else cells[0] if cells else start
        case AtLeast(bits, n):
            cells = cells_of(bits)
            if n <= 0:
                return start
            if n > len(cells):
                return never
            return F.element_at(F.array_sort(F.array(*[positions[i] for i in cells])), n)
        case All(parts) | Any(parts):
            found = [first_win(p, positions, start, never) for p in parts]
            if not found:
                return start if isinstance(pattern, All) else never
            return found[0] if len(found) == 1 else (F.greatest if isinstance(pattern, All) else F.least)(*found)
    raise PatternError("AtMost can stop holding: take holding or first_hold instead")


def _has_at_most(pattern) -> bool:
    return isinstance(pattern, AtMost) or any(map(_has_at_most, getattr(pattern, "parts", ())))


def holding(pattern, positions: list[Column], start: Column | None = None, never: Column | None = None) -> Column:
    """When a pattern holds, as an array of (since, until): ascending, apart, with until the first position at which it no longer does.

    Any pattern, AtMost included: a part without AtMost holds from its first win on (until ``never``), an AtMost until
    one cell too many is called, AND leaves what all parts share, OR unites what touches. ``positions``, ``start``
    and ``never`` are as in ``first_win``.
    """
    start = F.lit(0).cast("long") if start is None else start
    never = F.lit(NEVER) if never is None else never
    span = lambda since, until: F.filter(F.array(F.struct(since.alias("since"), until.alias("until"))), _is_some)
    if not _has_at_most(pattern):
        return span(first_win(pattern, positions, start, never), never)
    if isinstance(pattern, AtMost):
        cells = cells_of(pattern.bits)
        if pattern.n < 0:
            return span(never, never)
        if pattern.n >= len(cells):
            return span(start, never)
        return span(start, F.element_at(F.array_sort(F.array(*[positions[i] for i in cells])), pattern.n + 1))
    joined = _shared if isinstance(pattern, All) else _united
    return reduce(joined, [holding(part, positions, start, never) for part in pattern.parts])


def _is_some(span: Column) -> Column:
    return span["since"] < span["until"]


def _shared(a: Column, b: Column) -> Column:
    both = lambda x, y: F.struct(F.greatest(x["since"], y["since"]).alias("since"), F.least(x["until"], y["until"]).alias("until"))
    return F.filter(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: both(x, y)))), _is_some)


def _united(a: Column, b: Column) -> Column:
    """Spans in order of their begin; each joins the one before if it begins no later than that ends."""

    def add(held: Column, x: Column) -> Column:
        last = F.element_at(held, -1)
        longer = F.struct(last["since"].alias("since"), F.greatest(last["until"], x["until"]).alias("until"))
        touches = (F.size(held) > 0) & (F.try_element_at(held, F.lit(-1))["until"] >= x["since"])
        return F.when(touches, F.concat(F.slice(held, 1, F.size(held) - 1), F.array(longer))).otherwise(F.concat(held, F.array(x)))

    ordered = F.array_sort(F.concat(a, b))
    return F.aggregate(ordered, F.slice(ordered, 1, 0), add)


def first_hold(pattern, positions: list[Column], first: Column, start: Column | None = None, never: Column | None = None) -> Column:
    """The first call after which a pattern holds, AtMost included; ``never`` if there is none. ``first`` is the position of the first call of all."""
    never = F.lit(NEVER) if never is None else never
    if not _has_at_most(pattern):
        return F.greatest(first_win(pattern, positions, start, never), first)
    after = F.filter(F.transform(holding(pattern, positions, start, never), lambda x: F.struct(F.greatest(x["since"], first).alias("since"), x["until"].alias("until"))), _is_some)
    return F.coalesce(F.get(after, F.lit(0))["since"], never)


_RULE = re.compile(r"(AtLeast|AtMost)\(\s*([A-Za-z0-9_-]+)\s*,\s*(-?[0-9]+)\s*\)")


def _rule(word: str, masks: dict[str, int]):
    """A line of a pattern's body that is neither AND nor OR: a count rule, or the name of a mask, which may hold any characters."""
    name, n = word, None
    if word.startswith(("AtLeast(", "AtMost(")):
        found = _RULE.fullmatch(word)
        if not found:
            raise PatternError(f"bad rule: {word}")
        name, n = found[2], int(found[3])
    if name not in masks:
        raise PatternError(f"unknown mask: {name}")
    if n is None:
        return Mask(masks[name])
    if not 0 <= n <= CELLS:
        raise PatternError(f"number outside 0..{CELLS}: {n}")
    return (AtLeast if word.startswith("AtLeast") else AtMost)(masks[name], n)


def _closed(node: tuple):
    """An operator's list of parts, and those within it, as All and Any."""
    word, parts = node
    return (All if word == "AND" else Any)(tuple(_closed(x) if isinstance(x, tuple) else x for x in parts))


def parse(text: str) -> dict[str, object]:
    """Patterns by name from text: MASK blocks of five rows, then PATTERN blocks.

    A block begins at a line's start. The first line of a pattern's body is AND or OR, its parts are the
    lines below that are indented more than it (by spaces, and among themselves as they like): rules, names
    of masks, or AND and OR again; one without parts is allowed. Blank lines and lines that begin with # are left
    out, and so are lines that belong to no block. Raises PatternError for a row that is not five of X, x and -,
    a mask that ends early, a name that comes twice, a mask after the first pattern, a body that begins
    otherwise or is missing, a malformed rule, an unknown mask, and a number that is not in 0..25.
    """
    lines = [x for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    masks: dict[str, int] = {}
    patterns: dict[str, object] = {}
    at = 0
    while at < len(lines):
        kind, _, name = lines[at].partition(" ")
        name, at = name.strip(), at + 1
        if kind == "MASK" and " " in lines[at - 1]:
            if patterns:
                raise PatternError("a mask after a pattern")
            rows, at = [x.strip() for x in lines[at : at + SIDE]], at + SIDE
            if name in masks:
                raise PatternError(f"mask twice: {name}")
            if len(rows) < SIDE:
                raise PatternError(f"mask ends early: {name}")
            for row in rows:
                if not re.fullmatch(r"[Xx-]{5}", row):
                    raise PatternError(f"not five of X and -: {row!r}")
            masks[name] = sum(1 << i for i, x in enumerate("".join(rows)) if x != "-")
        elif kind == "PATTERN" and " " in lines[at - 1]:
            if at >= len(lines) or lines[at].strip() not in ("AND", "OR"):
                raise PatternError(f"a body begins with AND or OR: {name}")
            if name in patterns:
                raise PatternError(f"pattern twice: {name}")
            root: tuple = (lines[at].strip(), [])
            open_nodes = [(_indent(lines[at]), root)]
            for line in lines[at + 1 :]:
                while open_nodes and _indent(line) <= open_nodes[-1][0]:
                    open_nodes.pop()
                if not open_nodes:
                    break
                at, word = at + 1, line.strip()
                parts = open_nodes[-1][1][1]
                if word in ("AND", "OR"):
                    parts.append((word, []))
                    open_nodes.append((_indent(line), parts[-1]))
                else:
                    parts.append(_rule(word, masks))
            patterns[name], at = _closed(root), at + 1
    return patterns


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))
