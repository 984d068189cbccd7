"""Places along a space-filling curve, so that rows near each other are stored near each other.

A place's number interleaves the bits of its latitude and longitude (Z-order). A rectangle
is a few stretches of the curve: a quarter of the world after another is kept, split or left
out, the largest split first, until there are as many stretches as asked for."""

from __future__ import annotations

import heapq

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of each coordinate: cells of some 10 by 20 metres.
BITS = 21
_MASKS = [(32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)]


def _cell(part: Column) -> Column:
    """The cell of a part (0 to 1) of the way along one coordinate."""
    return F.greatest(F.least(F.floor(part * (1 << BITS)), F.lit((1 << BITS) - 1)), F.lit(0)).cast("long")


def _spread(c: Column) -> Column:
    """Two free bits after every bit (one is all that is needed; the masks are for 21 bits)."""
    for shift, mask in _MASKS:
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def place(lat: Column, lon: Column) -> Column:
    """The number of a place; null unless both coordinates are present."""
    north, east = _spread(_cell((lat + 90) / 180)), _spread(_cell((lon + 180) / 360))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.shiftleft(north, 1).bitwiseOR(east))


def _number(row: int, column: int) -> int:
    out = 0
    for bit in range(BITS):
        out |= (row >> bit & 1) << (3 * bit + 1) | (column >> bit & 1) << 3 * bit
    return out


def stretches(south: float, north: float, west: float, east: float, most: int = 16) -> list[tuple[int, int]]:
    """First and last numbers of at most `most` stretches of the curve that hold a rectangle (west <= east)."""
    size = 1 << BITS
    cell = lambda x, low, span: min(size - 1, max(0, int((x - low) / span * size)))
    rows, columns = (cell(south, -90, 180), cell(north, -90, 180)), (cell(west, -180, 360), cell(east, -180, 360))
    todo, done = [(-size, 0, 0)], []  # squares that are partly inside, the largest first
    while todo and len(todo) + len(done) < 4 * most:
        side, row, column = heapq.heappop(todo)
        half = -side // 2
        if not half:
            done.append((row, column, 1))
            continue
        for r in (row, row + half):
            for c in (column, column + half):
                if r > rows[1] or r + half - 1 < rows[0] or c > columns[1] or c + half - 1 < columns[0]:
                    continue
                if rows[0] <= r and r + half - 1 <= rows[1] and columns[0] <= c and c + half - 1 <= columns[1]:
                    done.append((r, c, half))
                else:
                    heapq.heappush(todo, (-half, r, c))
    squares = done + [(r, c, -s) for s, r, c in todo]
    found = sorted((_number(r, c), _number(r + s - 1, c + s - 1)) for r, c, s in squares)
    joined: list[list[int]] = []
    for a, b in found:
        if joined and a <= joined[-1][1] + 1:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    while len(joined) > most:  # close the smallest gap
        i = min(range(1, len(joined)), key=lambda k: joined[k][0] - joined[k - 1][1])
        joined[i - 1][1] = joined.pop(i)[1]
    return [(a, b) for a, b in joined]


def in_stretches(number: str, found: list[tuple[int, int]]) -> Column:
    """Whether a stored number is in one of them, in a form by which scans skip files and row groups."""
    out = F.lit(False)
    for a, b in found:
        out = out | F.col(number).between(a, b)
    return out
