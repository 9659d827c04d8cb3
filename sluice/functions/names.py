"""Column names that do not clash (names compare without case, as Spark resolves them)."""

from __future__ import annotations


def fresh_name(taken, base: str) -> str:
    """``base``, with a number behind it if ``taken`` has the name already."""
    used, name, k = {t.lower() for t in taken}, base, 2
    while name.lower() in used:
        name, k = f"{base}_{k}", k + 1
    return name


def stored_names(names, technical=()) -> list[str]:
    """Names under which columns are stored, in order: a name that equals a
    technical one or an earlier column's (without case) gets a number behind it."""
    taken, out = list(technical), []
    for n in names:
        # a number must not take the name of a later column either
        free = fresh_name([*taken, *[x for x in names if x != n]], n) if n.lower() in {t.lower() for t in taken} else n
        taken.append(free)
        out.append(free)
    return out
