"""Slips in typed words: characters dropped, added, replaced or swapped with a neighbour."""

from __future__ import annotations


def distance(a: str, b: str, most: int) -> int:
    """The number of slips between two words (each part is changed once at most), or ``most + 1`` if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        if min(new) > most and min(row) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def within(a: str, b: str, most: int) -> bool:
    return distance(a, b, most) <= most


def deletions(word: str, most: int) -> set[str]:
    """The word with up to ``most`` characters dropped.  Words at most ``most`` slips apart share one of these: a slip
    is undone by dropping a character in one or in both."""
    out, last = {word}, {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out
