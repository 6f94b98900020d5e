"""Expressions over a dense (date, stock) panel, each a value with the mask under which it is valid.

A value without a mask of its own is a plain function of panel fields. A primitive runs under the mask of its
arguments, or under the panel's mask M where they have none, and brings the mask that its rule gives. Arithmetic
joins the masks of its operands. Equal expressions are one object, so that a plan computes each once.
"""

from __future__ import annotations

from functools import reduce

TIME, SECTION, ROW = "time", "section", "row"

_known: dict[tuple, Node] = {}


class Node:
    """A column: kind and parameters, with the columns that it reads."""

    __slots__ = ("axis", "inputs", "kind", "name", "params")

    def __init__(self, kind, inputs, params, axis):
        self.kind, self.inputs, self.params, self.axis = kind, inputs, params, axis
        self.name = f"c{len(_known)}"


def node(kind: str, *inputs: Node, axis: str = ROW, params: tuple = ()) -> Node:
    key = (kind, tuple(id(x) for x in inputs), params)
    if key not in _known:
        _known[key] = Node(kind, inputs, params, axis)
    return _known[key]


M = node("field", params=("mask",))


def both(*masks: Node | None) -> Node | None:
    found = list(dict.fromkeys(m for m in masks if m is not None))
    return reduce(lambda a, b: node("and", a, b), found) if found else None


def numeric(x) -> Value:
    return x if isinstance(x, Value) else Value(node("constant", params=(float(x),)))


class Value:
    def __init__(self, value: Node, mask: Node | None = None):
        self.value, self.mask = value, mask

    def under(self) -> Node:
        return self.mask or M

    def on(self, *others: Value | Node) -> Value:
        """The same value, valid only where the others are, too."""
        return Value(self.value, both(self.mask, *(x if isinstance(x, Node) else x.mask for x in others)))

    def _with(self, kind, *others, params=()):
        others = [numeric(x) for x in others]
        return Value(node(kind, self.value, *(x.value for x in others), params=params), both(self.mask, *(x.mask for x in others)))

    def __add__(self, x):
        return self._with("add", x)

    def __radd__(self, x):
        return numeric(x)._with("add", self)

    def __sub__(self, x):
        return self._with("subtract", x)

    def __rsub__(self, x):
        return numeric(x)._with("subtract", self)

    def __mul__(self, x):
        return self._with("multiply", x)

    def __rmul__(self, x):
        return numeric(x)._with("multiply", self)

    def __truediv__(self, x):
        return self._with("divide", x)

    def __rtruediv__(self, x):
        return numeric(x)._with("divide", self)

    def __neg__(self):
        return self._with("negate")

    def __lt__(self, x):
        return self._with("less", x)

    def __le__(self, x):
        return self._with("at_most", x)

    def __gt__(self, x):
        return numeric(x)._with("less", self)

    def __pow__(self, x):
        return self._with("power", x)


def field(name: str) -> Value:
    return Value(node("field", params=(name,)))


def absolute(x):
    return x._with("abs")


def sign(x):
    return x._with("sign")


def log(x):
    return x._with("log")


def log2(x):
    return x._with("log2")


def sqrt(x):
    return greatest(x, 0)._with("sqrt")


def greatest(x, y):
    return numeric(x)._with("greatest", y)


def least(x, y):
    return numeric(x)._with("least", y)


def clamp(x, low, high):
    return least(greatest(x, low), high)


def over(x, y, floor=1e-9):
    """x / max(y, floor): what is not above floor counts as floor."""
    return numeric(x) / greatest(y, floor)


def safe_divide(x, y, eps=1e-12):
    """x over y, whose magnitude is at least eps and whose sign is that of y + eps."""
    return numeric(x)._with("safe_divide", y, params=(eps,))


def signed_power(x, p):
    return sign(x) * (greatest(absolute(x), 1e-12) ** numeric(p))


# -- masks over time -----------------------------------------------------------------------------------------


def mask_window(m: Node, k: int, rule: str) -> Node:
    """At least one, at least two or all of the last k rows; false in the first k - 1 rows."""
    if k < 1:
        raise ValueError(f"a window has at least one row, not {k}")
    return node("mask_window", m, axis=TIME, params=(k, rule))


def mask_lag(m: Node, p: int) -> Node:
    return node("mask_lag", m, axis=TIME, params=(p,)) if p else m


# -- primitives over time ------------------------------------------------------------------------------------


def _time(kind, rule, k, *xs, params=()):
    m = both(*(x.mask for x in xs)) or M
    window = mask_window(m, k, rule)
    return Value(node(kind, m, *(x.value for x in xs), axis=TIME, params=(k, *params)), window)


def ts_sum(x, k):
    return _time("ts_sum", "all", k, x)


def ts_mean(x, k):
    return _time("ts_mean", "any", k, x)


def ts_std(x, k):
    return _time("ts_std", "two", k, x)


def ts_min(x, k):
    return _time("ts_min", "any", k, x)


def ts_max(x, k):
    return _time("ts_max", "any", k, x)


def ts_rank(x, k):
    return _time("ts_rank", "all", k, x)


def ts_corr(x, y, k):
    return _time("ts_corr", "two", k, x, y)


def ts_cov(x, y, k):
    return _time("ts_cov", "two", k, x, y)


def ts_argmax(x, k):
    return _time("ts_argmax", "any", k, x)


def ts_argmin(x, k):
    return _time("ts_argmin", "any", k, x)


def ts_product(x, k):
    return _time("ts_product", "all", k, x)


def decay_linear(x, k, newest_first=False):
    """Weighted mean with weights 1..k; the oldest row has the largest, unless newest_first."""
    return _time("decay_linear", "all", k, x, params=(newest_first,))


def ewma(x, alpha):
    if not 0 < alpha <= 1:
        raise ValueError(f"alpha is over 0 and at most 1, not {alpha}")
    return Value(node("ewma", x.under(), x.value, axis=TIME, params=(float(alpha),)), x.under())


def delay(x, p):
    if p < 0:
        raise ValueError(f"a delay of {p} rows would look ahead")
    m = x.under()
    return Value(node("delay", m, x.value, axis=TIME, params=(p,)), mask_lag(m, p))


def delta(x, p):
    """x minus its delayed self, where both are valid."""
    past = delay(x, p)
    m = both(x.under(), past.mask)
    return Value(node("where", m, node("subtract", x.value, past.value)), m)


# -- primitives over a date ----------------------------------------------------------------------------------


def cs_rank(x, descending=False):
    return Value(node("cs_rank", x.under(), x.value, axis=SECTION, params=(descending,)), x.under())


def cs_zscore(x):
    return Value(node("cs_zscore", x.under(), x.value, axis=SECTION), x.under())


def cs_scale(x, a=1.0):
    return Value(node("cs_scale", x.under(), x.value, axis=SECTION, params=(float(a),)), x.under())


# -- order of evaluation -------------------------------------------------------------------------------------


def stages(roots: list[Node]) -> list[tuple[str, list[Node]]]:
    """Window nodes in passes over alternating axes, each in as many steps as windows nest: a pass is one exchange."""
    placed: dict[int, tuple[int, int]] = {}
    order: list[Node] = []

    def place(x: Node) -> tuple[int, int]:
        """Pass and step after which x is known; passes alternate, times are even."""
        if id(x) in placed:
            return placed[id(x)]
        at = max((place(y) for y in x.inputs), default=(-1, 0))
        if x.axis != ROW:
            parity = 0 if x.axis == TIME else 1
            if at[0] % 2 == parity and at[0] >= 0:
                at = (at[0], at[1] + 1)
            else:
                at = (at[0] + 1 if (at[0] + 1) % 2 == parity else at[0] + 2, 0)
            order.append(x)
        placed[id(x)] = at
        return at

    for root in roots:
        place(root)
    steps: dict[tuple[int, int], list[Node]] = {}
    for x in order:
        steps.setdefault(placed[id(x)], []).append(x)
    return [(TIME if at[0] % 2 == 0 else SECTION, steps[at]) for at in sorted(steps)]
