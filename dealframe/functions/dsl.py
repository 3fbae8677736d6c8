"""The criteria language compiled to Spark columns.

``& and`` bind looser than comparisons, ``| or`` looser still. ``not`` denies the
comparison (or the name, or the parenthesis) that follows it, before ``&`` and ``|``.
Decimals, ``//`` and ``**`` work, and a # starts a comment. ``on_missing`` says what
a name without a column means for the comparison it stands in.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(\d+\.\d+|\d+|[A-Za-z_]\w*|\*\*|//|==|!=|<=|>=|[-+*/%<>&|()])")
COMPARE = {"==", "!=", "<=", ">=", "<", ">"}


class CriteriaError(ValueError):
    pass


class Missing(Exception):
    pass


def scan(text: str) -> list[str]:
    text, out, pos = text.split("#", 1)[0].rstrip(), [], 0
    while pos < len(text):
        m = TOKEN.match(text, pos)
        if not m:
            raise CriteriaError(f"unexpected {text[pos:]!r}")
        out.append(m[1])
        pos = m.end()
    return out


def parse(text: str) -> tuple:
    """A tree of (operator, operands) with names and numbers as leaves."""
    toks, at = scan(text), 0

    def peek() -> str | None:
        return toks[at] if at < len(toks) else None

    def take() -> str:
        nonlocal at
        at += 1
        return toks[at - 1]

    def binary(ops: dict[str, str], below):
        def run():
            left = below()
            while peek() in ops:
                op = ops[take()]
                left = (op, left, below())
            return left

        return run

    def atom():
        t = peek()
        if t is None:
            raise CriteriaError("unexpected end")
        take()
        if t == "(":
            inner = either()
            if peek() != ")":
                raise CriteriaError("missing )")
            take()
            return inner
        if t == "-":
            return ("neg", atom())
        if re.match(r"\d", t):
            return ("num", float(t) if "." in t else int(t))
        if re.match(r"[A-Za-z_]", t) and t not in ("and", "or", "not"):
            return ("name", t)
        raise CriteriaError(f"unexpected {t!r}")

    def power():
        left = atom()
        if peek() == "**":
            take()
            return ("**", left, power())
        return left

    product = binary({x: x for x in ("*", "/", "//", "%")}, power)
    summed = binary({x: x for x in "+-"}, product)

    def compared():
        left = summed()
        out = None
        while peek() in COMPARE:
            op, right = take(), None
            right = summed()
            this = (op, left, right)
            out = this if out is None else ("&", out, this)
            left = right
        return left if out is None else out

    def denied():
        if peek() == "not":
            take()
            return ("not", denied())
        return compared()

    both = binary({"&": "&", "and": "&"}, denied)
    either = binary({"|": "|", "or": "|"}, both)
    tree = either()
    if peek() is not None:
        raise CriteriaError(f"unexpected {peek()!r}")
    return tree


def names(text: str) -> list[str]:
    return sorted({t for t in scan(text) if re.match(r"[A-Za-z_]", t) and t not in ("and", "or", "not")})


def compile_filter(text: str, columns: list[str], rename=lambda n: n, on_missing: str = "false") -> Column:
    """A condition for ``where``: null where a comparison is unknown, plain enough to reach the scan."""
    known = set(columns)

    def value(t: tuple) -> Column:
        kind = t[0]
        if kind == "num":
            return F.lit(t[1])
        if kind == "name":
            n = rename(t[1])
            if n not in known:
                raise Missing(n)
            return F.col(n)
        if kind == "neg":
            return -value(t[1])
        a, b = value(t[1]), value(t[2])
        return {
            "+": lambda: a + b,
            "-": lambda: a - b,
            "*": lambda: a * b,
            "/": lambda: F.try_divide(a, b),
            "//": lambda: F.floor(F.try_divide(a, b)),
            "%": lambda: F.when(b != 0, F.pmod(a, b)),
            "**": lambda: F.pow(a, b),
        }[kind]()

    def truth(t: tuple) -> Column:
        kind = t[0]
        if kind in ("&", "|"):
            a, b = truth(t[1]), truth(t[2])
            return a & b if kind == "&" else a | b
        if kind == "not":
            return ~F.coalesce(truth(t[1]), F.lit(False))
        try:
            if kind in COMPARE:
                a, b = value(t[1]), value(t[2])
                out = {"==": a == b, "!=": a != b, "<=": a <= b, ">=": a >= b, "<": a < b, ">": a > b}[kind]
            else:
                out = value(t).cast("boolean") if kind == "name" else value(t) != 0
        except Missing as e:
            if on_missing == "error":
                raise CriteriaError(f"no column {e}") from None
            return F.lit(on_missing == "true")
        return out

    return truth(parse(text))


def compile_criteria(text: str, columns: list[str], rename=lambda n: n, on_missing: str = "false") -> Column:
    """A boolean column, never null. on_missing: false, true (pass) or error."""
    return F.coalesce(compile_filter(text, columns, rename, on_missing), F.lit(False))


def fault(text: str, columns: list[str]) -> str | None:
    """What is wrong with a text of criteria over these columns; null where it is valid."""
    try:
        compile_criteria(text, columns, on_missing="error")
    except CriteriaError as e:
        return str(e)
    return None


def failed(criteria: list[str], columns: list[str], **kw) -> Column:
    """The criteria that a row fails, in order."""
    return F.array_compact(F.array(*[F.when(~compile_criteria(c, columns, **kw), F.lit(c)) for c in criteria]))


BOUND = re.compile(r"^\s*([A-Za-z_]\w*)\s*(<=|>=|==|<|>)\s*(-?\d+(?:\.\d+)?)\s*$")


def dedupe_least_restrictive(criteria: list[str]) -> list[str]:
    """One bound for each name and operator, the loosest; a name whose bounds contradict loses all of them."""
    loosest: dict[tuple[str, str], float] = {}
    other: list[str] = []
    bad: set[str] = set()
    for c in criteria:
        m = BOUND.match(c)
        if not m:
            if c not in other:
                other.append(c)
            continue
        key, v = (m[1], m[2]), float(m[3])
        if key not in loosest:
            loosest[key] = v
        elif m[2] in (">=", ">"):
            loosest[key] = min(loosest[key], v)
        elif m[2] in ("<=", "<"):
            loosest[key] = max(loosest[key], v)
        elif v != loosest[key]:
            bad.add(m[1])
    for name in {n for n, _ in loosest}:
        low = max([loosest.get((name, ">="), float("-inf")), loosest.get((name, ">"), float("-inf")) + 1])
        high = min([loosest.get((name, "<="), float("inf")), loosest.get((name, "<"), float("inf")) - 1])
        eq = loosest.get((name, "=="))
        if low > high or (eq is not None and not low <= eq <= high):
            bad.add(name)
    kept = [f"{n} {o} {v:g}" for (n, o), v in loosest.items() if n not in bad]
    return sorted(kept) + other
