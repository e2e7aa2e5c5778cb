"""Boolean trigram queries from regular expressions.

`query` walks a pattern's parse tree on the driver and returns alternatives, each a set of
lower-case trigrams that any matching text holds.  No alternatives bind: a pattern without mandatory
trigrams gives one empty set, which every text satisfies.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

#: Strings that an exact part may stand for before it is closed, and alternatives that a query may have.
MOST = 64

Query = frozenset  # of frozensets of trigrams


def _trigrams(text: str) -> frozenset:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _absorb(alternatives) -> Query:
    """Alternatives without those that another one implies."""
    sets = sorted(set(alternatives), key=len)
    out: list[frozenset] = []
    for s in sets:
        if not any(o <= s for o in out):
            out.append(s)
    return Query(out)


def _both(a: Query, b: Query) -> Query:
    both = _absorb(x | y for x in a for y in b)
    return both if len(both) <= MOST else (a if len(a) <= len(b) else b)


ANY: Query = Query([frozenset()])


def _exact(node) -> set[str] | None:
    """The strings a node stands for, if they are few."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                chars.add(chr(value).lower())
            elif kind is C.RANGE and value[1] - value[0] < 4:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return chars if len(chars) <= 5 else None
    if op is C.SUBPATTERN:
        return _exact_all(arg[-1])
    if op is C.BRANCH:
        parts = [_exact_all(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, body = arg
        if high is C.MAXREPEAT or high > 8:
            return None
        once, out, power = _exact_all(body), set(), {""}
        if once is None:
            return None
        for n in range(int(high) + 1):
            if n >= low:
                out |= power
            power = {x + y for x in power for y in once}
            if len(power) > MOST:
                return None
        return out
    return None


def _exact_all(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        one = _exact(node)
        if one is None or len(out) * len(one) > MOST:
            return None
        out = {x + y for x in out for y in one}
    return out


def _inside(node) -> Query:
    """What a node that is not exact demands."""
    op, arg = node
    if op is C.SUBPATTERN:
        return _walk(arg[-1])
    if op is C.BRANCH:
        return _absorb(x for part in arg[1] for x in _walk(part))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
        return _walk(arg[2])
    return ANY


def _walk(nodes) -> Query:
    found, run = ANY, {""}
    for node in nodes:
        one = _exact(node)
        if one is not None and len(run) * len(one) <= MOST:
            run = {x + y for x in run for y in one}
            continue
        found = _both(found, _absorb(map(_trigrams, run)))
        if one is not None:
            run = one
        else:
            found, run = _both(found, _inside(node)), {""}
    return _both(found, _absorb(map(_trigrams, run)))


def query(pattern: str) -> Query:
    return _walk(_parser.parse(pattern))
