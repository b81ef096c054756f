"""Ordered comparison of two texts line by line: matching runs, hunks with context, counts."""

from __future__ import annotations

#: In a text of so many lines, one that stands more often than once in a hundred starts no match; matches only grow over it.
LONG, POPULAR = 200, 100


def runs_in_common(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """(place in a, place in b, lines): the longest common run, of equally long ones that which ends first in a, then in b; and so on before and
    behind it. Thus a line that moved is common at one of its places only."""
    places: dict[int, list[int]] = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    if len(b) >= LONG:
        places = {line: at for line, at in places.items() if len(at) <= len(b) // POPULAR + 1}
    open_, out = [(0, len(a), 0, len(b))], []
    while open_:
        a1, a2, b1, b2 = open_.pop()
        if a1 == a2 or b1 == b2:
            continue
        size, at_a, at_b, ending = 0, a1, b1, {}
        for i in range(a1, a2):
            longer = {}
            for j in places.get(a[i], ()):
                if b1 <= j < b2:
                    longer[j] = n = ending.get(j - 1, 0) + 1
                    if n > size:
                        size, at_a, at_b = n, i + 1 - n, j + 1 - n
            ending = longer
        while at_a > a1 and at_b > b1 and a[at_a - 1] == b[at_b - 1]:
            size, at_a, at_b = size + 1, at_a - 1, at_b - 1
        while at_a + size < a2 and at_b + size < b2 and a[at_a + size] == b[at_b + size]:
            size += 1
        if size:
            out.append((at_a, at_b, size))
            open_ += [(a1, at_a, b1, at_b), (at_a + size, a2, at_b + size, b2)]
    return sorted(out)


def changes(before: list[str], after: list[str]) -> list[tuple[int, int, int, int]]:
    """(first, past, first, past): lines of before that lines of after replace, either of them perhaps none."""
    number: dict[str, int] = {}
    a, b = ([number.setdefault(x, len(number)) for x in lines] for lines in (before, after))
    out, at_a, at_b = [], 0, 0
    for i, j, size in [*runs_in_common(a, b), (len(a), len(b), 0)]:
        if i > at_a or j > at_b:
            out.append((at_a, i, at_b, j))
        at_a, at_b = i + size, j + size
    return out


def hunks(before: str, after: str, context: int = 3) -> tuple[int, int, list[dict]]:
    """(lines added, lines removed, hunks) of two texts. Lines keep what ends them, so a last line without an end differs from one that has it.

    A hunk has changes and up to `context` common lines about them: its first lines, from 1, and numbers of lines in both texts (a range
    without a line begins at the one before it) and its lines, marked ' ', '-' and '+'.
    """
    x, y = before.splitlines(keepends=True), after.splitlines(keepends=True)
    groups: list[list[tuple[int, int, int, int]]] = []
    found = changes(x, y) if before != after else []
    for c in found:
        if groups and c[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(c)
        else:
            groups.append([c])
    out = []
    for group in groups:
        lead, tail = min(context, group[0][0], group[0][2]), min(context, len(x) - group[-1][1], len(y) - group[-1][3])
        at, lines = group[0][0] - lead, []
        for a1, a2, b1, b2 in group:
            lines += [" " + s for s in x[at:a1]] + ["-" + s for s in x[a1:a2]] + ["+" + s for s in y[b1:b2]]
            at = a2
        lines += [" " + s for s in x[at : at + tail]]
        a, b = (group[0][0] - lead, at + tail), (group[0][2] - lead, group[-1][3] + tail)
        out.append({"old_first": a[0] + (a[1] > a[0]), "old_lines": a[1] - a[0], "new_first": b[0] + (b[1] > b[0]), "new_lines": b[1] - b[0], "lines": lines})
    return sum(c[3] - c[2] for c in found), sum(c[1] - c[0] for c in found), out
