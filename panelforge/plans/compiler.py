"""Compiles panel expressions into a DataFrame plan of few exchanges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.plans import sections
from panelforge.plans.expr import SECTION, TIME, Node, Value, both, node, stages

#: Inputs of comparisons between windows' results are equal up to this many decimals.
EQUAL_DECIMALS = 9
#: What a masked cell counts as where the largest or the smallest is sought.
LARGE = 1.7e308


def rounded(a: str) -> str:
    """a to EQUAL_DECIMALS, by arithmetic: round() goes by way of decimal numbers."""
    scale = f"{10.0**EQUAL_DECIMALS!r}D"
    return f"IF(abs({a}) < 1e6D, rint({a} * {scale}) / {scale}, {a})"


def doubled(kind: str, values: tuple[Node, ...], k: int) -> tuple[Node, ...]:
    """Columns over the last k rows, in steps that double: each joins a column with itself so many rows before, log2 k times."""
    known, size = values, 1
    whole: tuple[Node, ...] | None = None
    done = 0
    while True:
        if k & size:  # the newest rows of this size come before what is done
            whole = known if whole is None else joined(kind, whole, known, done)
            done += size
        if done == k:
            return whole
        known, size = joined(kind, known, known, size), 2 * size


def joined(kind: str, newer: tuple[Node, ...], older: tuple[Node, ...], rows: int) -> tuple[Node, ...]:
    """Both stretches as one: the older one ends so many rows before."""
    before = tuple(node("shift", x, axis=TIME, params=(rows,)) for x in older)
    if kind == "product":
        return (node("multiply", newer[0], before[0]),)
    value = node("greatest" if kind == "argmax" else "least", newer[0], before[0])
    # of equal values the older one's place stays
    older_is = node("at_most", newer[0], before[0]) if kind == "argmax" else node("at_most", before[0], newer[0])
    return value, node("choose", older_is, before[1], newer[1])


def window_count(m: Node, k: int) -> Node:
    """How many of the last k rows are valid."""
    whole = node("count_so_far", m, axis=TIME)
    return node("counted", whole, node("shift", whole, axis=TIME, params=(k,)))


_lowered: dict[int, Node] = {}


def lowered(x: Node) -> Node:
    """The same column by nodes that have a window each: counts by counts so far, extrema's places and products by doubling."""
    if id(x) not in _lowered:
        inputs = tuple(lowered(y) for y in x.inputs)
        k = x.params[0] if x.params else None
        m, a = (*inputs, None, None)[:2]
        if x.kind == "ts_product":
            found = doubled("product", (node("fill", m, a, params=(1.0,)),), k)[0]
        elif x.kind in ("ts_argmax", "ts_argmin"):
            filled = node("fill", m, a, params=(-LARGE if x.kind == "ts_argmax" else LARGE,))
            found = node("place", doubled(x.kind[3:], (filled, node("date")), k)[1], params=x.params)
        elif x.kind == "mask_window":
            found = node("enough", window_count(m, k), params=x.params)
        else:
            found = x if inputs == x.inputs else node(x.kind, *inputs, axis=x.axis, params=x.params)
        _lowered[id(x)] = found
    return _lowered[id(x)]


#: Kinds of one row each that are columns of their own: others read them more than once.
KEPT = frozenset(("counted", "enough", "choose", "greatest", "least"))


class Compiler:
    """known: window columns that earlier steps have made. Columns are SQL text, so that a step of many is one call."""

    def __init__(self, n_dates: int, date: str = "t", stock: str = "n", at: str | None = None):
        """date: what a section is of; stock: what a history is of, one or more columns; at: a row's number in its history, by default the date."""
        self.n_dates, self.t, self.n, self.at = n_dates, date, stock, at or date
        self.known: set[str] = set()
        self.time = f"PARTITION BY {stock} ORDER BY {self.at}"

    def column(self, x: Node) -> str:
        if x.name in self.known:
            return x.name
        if x.axis != "row":
            raise ValueError(f"{x.kind} isn't computed yet")
        return getattr(self, f"row_{x.kind}")(x, *(self.column(y) for y in x.inputs))

    # -- row by row

    def row_field(self, x):
        return x.params[0]

    def row_constant(self, x):
        return f"({x.params[0]!r}D)"

    def row_date(self, x):
        return self.at

    def row_and(self, x, a, b):
        return f"({a} AND {b})"

    def row_where(self, x, m, a):
        return f"IF({m}, {a}, 0D)"

    def row_fill(self, x, m, a):
        return f"IF({m}, {a}, {x.params[0]!r}D)"

    def row_choose(self, x, m, a, b):
        return f"IF({m} = 1D, {a}, {b})"

    def row_place(self, x, a):
        """The place in a window of k rows of the date a, from 1."""
        return f"CAST({a} - {self.at} + {x.params[0]} AS DOUBLE)"

    def row_counted(self, x, whole, before):
        return f"({whole} - coalesce({before}, 0))"

    def row_enough(self, x, n):
        k, rule = x.params
        return f"({self.at} >= {k - 1} AND {n} >= {({'any': 1, 'two': 2, 'all': k})[rule]})"

    def row_add(self, x, a, b):
        return f"({a} + {b})"

    def row_subtract(self, x, a, b):
        return f"({a} - {b})"

    def row_multiply(self, x, a, b):
        return f"({a} * {b})"

    def row_divide(self, x, a, b):
        return f"coalesce(try_divide({a}, {b}), 0D)"

    def row_negate(self, x, a):
        return f"(-{a})"

    def row_less(self, x, a, b):
        return f"IF({a} < {b}, 1D, 0D)"

    def row_at_most(self, x, a, b):
        return f"IF({a} <= {b}, 1D, 0D)"

    def row_power(self, x, a, b):
        return f"pow({a}, {b})"

    def row_abs(self, x, a):
        return f"abs({a})"

    def row_sign(self, x, a):
        return f"signum({a})"

    def row_log(self, x, a):
        return f"coalesce(ln({a}), 0D)"

    def row_log2(self, x, a):
        return f"coalesce(log2({a}), 0D)"

    def row_sqrt(self, x, a):
        return f"sqrt({a})"

    def row_greatest(self, x, a, b):
        return f"greatest({a}, {b})"

    def row_least(self, x, a, b):
        return f"least({a}, {b})"

    def row_safe_divide(self, x, a, b):
        eps = f"{x.params[0]!r}D"
        return f"({a} / (greatest(abs({b}), {eps}) * IF({b} + {eps} < 0D, -1D, 1D)))"

    # -- over time

    def frame(self, k):
        return f"OVER ({self.time} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"

    def lag(self, a, rows, default="NULL"):
        return f"lag({a}, {rows}, {default}) OVER ({self.time})" if rows else a

    def time_count_so_far(self, x, m):
        return f"count(IF({m}, 1, NULL)) OVER ({self.time} ROWS UNBOUNDED PRECEDING)"

    def time_mask_lag(self, x, m):
        return self.lag(m, x.params[0], "false")

    def time_shift(self, x, a):
        return self.lag(a, x.params[0])

    def valid(self, m, a):
        return f"IF({m}, {a}, NULL)"

    def zeroed(self, m, a):
        return f"IF({m}, {a}, 0D)"

    def time_ts_sum(self, x, m, a):
        return f"sum({self.zeroed(m, a)}) {self.frame(x.params[0])}"

    def time_ts_mean(self, x, m, a):
        return f"coalesce(avg({self.valid(m, a)}) {self.frame(x.params[0])}, 0D)"

    def time_ts_std(self, x, m, a):
        return f"coalesce(stddev_samp({self.valid(m, a)}) {self.frame(x.params[0])}, 0D)"

    def time_ts_min(self, x, m, a):
        return f"coalesce(min({self.valid(m, a)}) {self.frame(x.params[0])}, 0D)"

    def time_ts_max(self, x, m, a):
        return f"coalesce(max({self.valid(m, a)}) {self.frame(x.params[0])}, 0D)"

    def time_ts_rank(self, x, m, a):
        # comparisons with each row before: no array is made, and no function runs over one
        k = x.params[0]
        last = f"IF({m}, {rounded(a)}, {-LARGE!r}D)"
        at_most = [f"coalesce(CAST({self.lag(last, j)} <= {last} AS INT), 0)" for j in range(1, k)]
        return f"(1 + {' + '.join(at_most)}) / {float(k)!r}D" if at_most else "1D"

    def time_ts_corr(self, x, m, a, b):
        # moments, not sums of products: a window of hardly any spread would lose it to rounding
        w = self.frame(x.params[0])
        a, b = self.valid(m, a), self.valid(m, b)
        n = f"count({a}) {w}"
        spread = f"{n} * stddev_pop({a}) {w} * stddev_pop({b}) {w}"
        return f"coalesce({n} * covar_pop({a}, {b}) {w} / greatest({spread}, 1e-12D), 0D)"

    def time_ts_cov(self, x, m, a, b):
        return f"coalesce(covar_samp({self.valid(m, a)}, {self.valid(m, b)}) {self.frame(x.params[0])}, 0D)"

    def time_decay_linear(self, x, m, a):
        k, newest_first = x.params
        total = k * (k + 1) / 2
        terms = [f"{self.lag(self.zeroed(m, a), j, '0D')} * {float(k - j if newest_first else j + 1)!r}D" for j in range(k)]
        return f"({' + '.join(terms)}) / {total!r}D"

    def time_ewma(self, x, m, a):
        alpha = x.params[0]
        if alpha == 1:
            return self.zeroed(m, a)
        keep, t, zeroed = f"{1 - alpha!r}D", self.at, self.zeroed(m, a)
        rate = -math.log(1 - alpha)
        if rate * self.n_dates <= 600:  # no power overflows
            return f"{alpha!r}D * pow({keep}, {t}) * sum({zeroed} * pow({keep}, -{t})) OVER ({self.time} ROWS UNBOUNDED PRECEDING)"
        # a row's weight is below 1e-17 after a block: the block itself and the end of the one before make up the whole
        size = math.ceil(40 / rate)
        place, inside = f"({t} % {size})", f"PARTITION BY {self.n}, floor({t} / {size}) ORDER BY {t}"
        part = f"{alpha!r}D * pow({keep}, {place}) * sum({zeroed} * pow({keep}, -{place})) OVER ({inside} ROWS UNBOUNDED PRECEDING)"
        before = f"coalesce(last_value(IF({place} = {size - 1}, {x.name}, NULL)) IGNORE NULLS OVER ({self.time} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D)"
        return part, f"{x.name} + {before} * pow({keep}, {place} + 1)"

    def time_delay(self, x, m, a):
        return self.lag(self.zeroed(m, a), x.params[0], "0D")

    # -- over a date

    def section_cs_rank(self, x, m, a):
        # what isn't valid comes last, so that all windows of a date share its exchange
        ordered = f"PARTITION BY {self.t} ORDER BY {self.valid(m, rounded(a))} {'DESC' if x.params[0] else 'ASC'} NULLS LAST"
        # the mean of an equal run's first and last rank: only frames that grow
        last = f"count(1) OVER ({ordered} RANGE UNBOUNDED PRECEDING)"
        n = f"count(IF({m}, 1, NULL)) OVER (PARTITION BY {self.t})"
        return f"IF({m}, (rank() OVER ({ordered}) + {last}) / 2D / {n}, 0D)"

    def section_cs_zscore(self, x, m, a):
        w, v = f"OVER (PARTITION BY {self.t})", self.valid(m, a)
        n = f"count({v}) {w}"
        spread = f"sqrt(var_pop({v}) {w} * {n} / greatest({n}, 2))"
        return f"IF({m}, ({a} - avg({v}) {w}) / greatest({spread}, 1e-12D), 0D)"

    def section_cs_scale(self, x, m, a):
        return f"{x.params[0]!r}D * {self.zeroed(m, a)} / greatest(sum(abs({self.zeroed(m, a)})) OVER (PARTITION BY {self.t}), 1e-12D)"

    # -- over a date whose stocks are too many for one task

    def split_section(self, panel: DataFrame, nodes: list[Node], store) -> DataFrame:
        """panel, which is stored, with a column for each of these nodes of one step."""
        wanted, finished, keyed = {}, {}, {}
        for x in nodes:
            m, a = (self.column(y) for y in x.inputs)
            if x.kind == "cs_rank":
                keyed[x.name] = m, rounded(a), x.params[0]
            elif x.kind == "cs_scale":
                wanted[f"{x.name}_sum"] = f"sum(abs({self.zeroed(m, a)}))"
                finished[x.name] = f"{x.params[0]!r}D * {self.zeroed(m, a)} / greatest({x.name}_sum, 1e-12D)"
            else:
                n, mean, var = (f"{x.name}_{part}" for part in ("n", "mean", "var"))
                wanted |= {n: f"count({self.valid(m, a)})", mean: f"avg({self.valid(m, a)})", var: f"var_pop({self.valid(m, a)})"}
                finished[x.name] = f"IF({m}, ({a} - {mean}) / greatest(sqrt({var} * {n} / greatest({n}, 2)), 1e-12D), 0D)"
        if finished:
            panel = sections.figures(panel, self.t, wanted, finished, store)
        return sections.ranks(panel, self.t, self.n, keyed, store) if keyed else panel

    def row_finite(self, x, a):
        return f"IF(isnan({a}) OR abs({a}) = double('inf'), 0D, coalesce({a}, 0D))"

    def step(self, panel: DataFrame, axis: str, nodes: list[Node]) -> DataFrame:
        """panel with a column for each of these window nodes, whose inputs are known."""
        made, more = [], {}
        for x in nodes:
            prefix = "section" if axis == SECTION else "time"
            found = getattr(self, f"{prefix}_{x.kind}")(x, *(self.column(y) for y in x.inputs))
            found, after = found if isinstance(found, tuple) else (found, None)
            made.append(f"{found} AS {x.name}")
            if after:
                more[x.name] = F.expr(after)
        panel = panel.selectExpr("*", *made)
        panel = panel.withColumns(more) if more else panel
        self.known.update(x.name for x in nodes)
        return self.kept(panel)

    def plan(self, roots: list[Node]) -> list[tuple[str, list[Node]]]:
        """The steps, and, for kept(), the row nodes that become columns, each after those it reads."""
        found, seen = [], set()

        def visit(x: Node) -> None:
            if id(x) not in seen:
                seen.add(id(x))
                for y in x.inputs:
                    visit(y)
                if x.kind in KEPT:
                    found.append(x)

        for root in roots:
            visit(root)
        self.waiting = found
        return stages(roots)

    def kept(self, panel: DataFrame) -> DataFrame:
        """panel with the waiting columns that can be made, those that read others one step later."""
        while True:
            ready = [x for x in self.waiting if all(self.readable(y) for y in x.inputs)]
            if not ready:
                return panel
            panel = panel.selectExpr("*", *[f"{self.column(x)} AS {x.name}" for x in ready])
            self.known.update(x.name for x in ready)
            self.waiting = [x for x in self.waiting if x.name not in self.known]

    def readable(self, x: Node) -> bool:
        """x is a column, or by row from columns, none of which is waiting."""
        return x.name in self.known or (x.axis == "row" and x.kind not in KEPT and all(self.readable(y) for y in x.inputs))

    def run(self, panel: DataFrame, roots: list[Node]) -> DataFrame:
        """panel with a column for every window node that roots need."""
        for axis, nodes in self.plan(roots):
            panel = self.step(panel, axis, nodes)
        return panel

    def read_by(self, nodes: list[Node], known: set[str]) -> set[str]:
        """The columns that nodes read when those known are made."""
        found, todo, seen = set(), list(nodes), set()
        while todo:
            x = todo.pop()
            if id(x) in seen:
                continue
            seen.add(id(x))
            if x.name in known:
                found.add(x.name)
            elif x.kind == "field":
                found.add(x.params[0])
            else:
                todo += x.inputs
        return found

    def run_stored(self, panel: DataFrame, roots: list[Node], store, keep: tuple[str, ...], split: bool) -> DataFrame:
        """As run(), but each pass ends in a table of what later ones read, so that no plan has more than a pass and nothing is computed twice."""
        steps = self.plan(roots)
        last = len(steps) - 1
        if split:
            panel = store(panel)
        for i, (axis, nodes) in enumerate(steps):
            if split and axis == SECTION:
                panel = self.split_section(panel, nodes, store)
                self.known.update(x.name for x in nodes)
                panel = self.kept(panel)
            else:
                panel = self.step(panel, axis, nodes)
            if i < last and (steps[i + 1][0] != axis or split):
                later = [x for _, more in steps[i + 1 :] for x in more]
                inputs = [y for x in (*later, *self.waiting) for y in x.inputs]
                columns = self.read_by([*inputs, *roots], self.known) | set(keep) | {self.t, self.at, *self.n.split(", ")}
                panel = store(panel.select(*sorted(columns)))
        return panel


def finite(x: Value) -> Value:
    return Value(node("finite", x.value), x.mask)


def evaluate(panel: DataFrame, values: dict[str, Value], n_dates: int, masks: bool = False, keep: tuple[str, ...] = ("t", "n"), joint: bool = False, store=None, split: bool = False, date: str = "t", stock: str = "n", at: str | None = None) -> DataFrame:
    """keep and a column for each value, null where it isn't valid; with masks, also its mask, as name__m.

    joint: all values are null where one isn't valid. store: what a pass is written and read again by; any number of
    values can share one graph then. split (with store): the stocks of a date are too many for one task, see sections.
    date, stock, at: see Compiler.
    """
    compiler = Compiler(n_dates, date, stock, at)
    roots = {name: (lowered(v.value), lowered(v.under())) for name, v in values.items()}
    every = [r for both_of in roots.values() for r in both_of]
    wide = compiler.run_stored(panel, every, store, keep, split) if store else compiler.run(panel, every)
    names = {under.name: f"m{i}" for i, under in enumerate(dict.fromkeys(under for _, under in roots.values()))}
    found = wide.selectExpr(*keep, *[f"{compiler.column(value)} AS {name}" for name, (value, _) in roots.items()], *[f"{compiler.column(under)} AS {names[under.name]}" for under in dict.fromkeys(under for _, under in roots.values())])
    whole = " AND ".join(names.values())
    out = [f"IF({whole if joint else names[under.name]}, {name}, NULL) AS {name}" for name, (_, under) in roots.items()]
    return found.selectExpr(*keep, *out, *[f"{names[under.name]} AS {name}__m" for name, (_, under) in roots.items() if masks])


def joint_mask(values: dict[str, Value]) -> Node:
    return both(*(v.under() for v in values.values()))
