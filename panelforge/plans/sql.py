"""Writes panel expressions as SQL for an independent engine: the oracle of the compiled plans."""

from __future__ import annotations

from panelforge.plans.expr import Node, Value, stages

BINARY = {"add": "+", "subtract": "-", "multiply": "*"}
CALLS = {"abs": "abs", "sign": "sign", "sqrt": "sqrt", "greatest": "greatest", "least": "least", "power": "pow"}
#: Added before rounding: results that lie in the middle between two decimals would go either way.
OFF_TIES = 3.1e-7
LARGE = "1.7e308::DOUBLE"


class Writer:
    def __init__(self, date: str = "t", stock: str = "n", at: str | None = None):
        self.t, self.n, self.at = date, stock, at or date
        self.known: set[str] = set()

    def text(self, x: Node) -> str:
        if x.name in self.known:
            return x.name
        args = [self.text(y) for y in x.inputs]
        if x.kind == "field":
            return x.params[0]
        if x.kind == "constant":
            return f"({x.params[0]!r}::DOUBLE)"
        if x.kind == "and":
            return f"({args[0]} AND {args[1]})"
        if x.kind == "where":
            return f"(CASE WHEN {args[0]} THEN {args[1]} ELSE 0 END)"
        if x.kind in BINARY:
            return f"({args[0]} {BINARY[x.kind]} {args[1]})"
        if x.kind in CALLS:
            return f"{CALLS[x.kind]}({', '.join(args)})::DOUBLE"
        if x.kind == "divide":
            return f"(CASE WHEN {args[1]} = 0 THEN 0 ELSE {args[0]} / {args[1]} END)"
        if x.kind == "safe_divide":
            eps = x.params[0]
            return f"({args[0]} / (greatest(abs({args[1]}), {eps!r}) * CASE WHEN {args[1]} + {eps!r} < 0 THEN -1 ELSE 1 END))"
        if x.kind == "negate":
            return f"(-{args[0]})"
        if x.kind in ("less", "at_most"):
            return f"(CASE WHEN {args[0]} {'<' if x.kind == 'less' else '<='} {args[1]} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
        if x.kind in ("log", "log2"):
            return f"(CASE WHEN {args[0]} > 0 THEN {'ln' if x.kind == 'log' else 'log2'}({args[0]}) ELSE 0 END)"
        if x.kind == "finite":
            return f"(CASE WHEN isfinite({args[0]}) THEN {args[0]} ELSE 0 END)"
        raise ValueError(f"{x.kind} has no SQL")

    def window(self, x: Node) -> str:
        m, *a = [self.text(y) for y in x.inputs]
        line = f"PARTITION BY {self.n} ORDER BY {self.at}"
        k = x.params[0] if x.params else None
        frame = f"({line} ROWS BETWEEN {k - 1 if isinstance(k, int) and not isinstance(k, bool) else 0} PRECEDING AND CURRENT ROW)"
        valid = [f"(CASE WHEN {m} THEN {y} END)" for y in a]
        zero = [f"(CASE WHEN {m} THEN {y} ELSE 0.0::DOUBLE END)" for y in a]
        simple = {"ts_mean": "avg", "ts_std": "stddev_samp", "ts_min": "min", "ts_max": "max"}
        if x.kind == "mask_window":
            need = {"any": 1, "two": 2, "all": k}[x.params[1]]
            return f"({self.at} >= {k - 1} AND sum(CASE WHEN {m} THEN 1 ELSE 0 END) OVER {frame} >= {need})"
        if x.kind == "mask_lag":
            return f"coalesce(lag({m}, {k}) OVER ({line}), FALSE)"
        if x.kind == "ts_sum":
            return f"sum({zero[0]}) OVER {frame}"
        if x.kind in simple:
            return f"coalesce({simple[x.kind]}({valid[0]}) OVER {frame}, 0)"
        if x.kind == "ts_cov":
            return f"coalesce(covar_samp({valid[0]}, {valid[1]}) OVER {frame}, 0)"
        if x.kind == "ts_corr":
            n = f"count({valid[0]}) OVER {frame}"
            return f"coalesce({n} * covar_pop({valid[0]}, {valid[1]}) OVER {frame} / greatest({n} * stddev_pop({valid[0]}) OVER {frame} * stddev_pop({valid[1]}) OVER {frame}, 1e-12), 0)"
        if x.kind == "ts_rank":
            key = f"(CASE WHEN {m} THEN round({a[0]}, 9) ELSE -{LARGE} END)"
            return f"len(list_filter(list({key}) OVER {frame}, lambda v: v <= {key})) / {float(k)!r}"
        if x.kind in ("ts_argmax", "ts_argmin"):
            top = x.kind == "ts_argmax"
            seen = f"(list(CASE WHEN {m} THEN {a[0]} ELSE {'-' if top else ''}{LARGE} END) OVER {frame})"
            return f"list_position({seen}, list_{'max' if top else 'min'}({seen}))::DOUBLE"
        if x.kind == "ts_product":
            return f"list_product(list(CASE WHEN {m} THEN {a[0]} ELSE 1.0::DOUBLE END) OVER {frame})"
        if x.kind == "decay_linear":
            terms = [f"coalesce(lag({zero[0]}, {j}) OVER ({line}), 0) * {float(k - j if x.params[1] else j + 1)!r}::DOUBLE" for j in range(k)]
            return f"({' + '.join(terms)}) / {k * (k + 1) / 2!r}::DOUBLE"
        if x.kind == "ewma":
            keep = f"{1 - k!r}::DOUBLE"
            if k == 1:
                return zero[0]
            return f"{k!r}::DOUBLE * pow({keep}, {self.at}) * sum({zero[0]} * pow({keep}, -{self.at})) OVER ({line} ROWS UNBOUNDED PRECEDING)"
        if x.kind == "delay":
            return f"coalesce(lag({zero[0]}, {k}) OVER ({line}), 0)" if k else zero[0]
        if x.kind == "cs_rank":
            key = f"round({a[0]}, 9)"
            order = "DESC" if x.params[0] else "ASC"
            part = f"PARTITION BY {self.t}, {m}"
            return f"CASE WHEN {m} THEN (rank() OVER ({part} ORDER BY {key} {order}) + (count(*) OVER ({part}, {key}) - 1) / 2.0::DOUBLE) / count(*) OVER ({part}) ELSE 0 END"
        if x.kind == "cs_zscore":
            n, v = f"count({valid[0]}) OVER (PARTITION BY {self.t})", valid[0]
            return f"CASE WHEN {m} THEN ({a[0]} - avg({v}) OVER (PARTITION BY {self.t})) / greatest(sqrt(var_pop({v}) OVER (PARTITION BY {self.t}) * {n} / greatest({n}, 2)), 1e-12) ELSE 0 END"
        if x.kind == "cs_scale":
            return f"{x.params[0]!r}::DOUBLE * {zero[0]} / greatest(sum(abs({zero[0]})) OVER (PARTITION BY {self.t}), 1e-12)"
        raise ValueError(f"{x.kind} has no SQL")


def query(panel_ctes: str, panel: str, values: dict[str, Value], keep: tuple[str, ...] = ("t", "n"), decimals: int | None = None, masks: bool = False, joint: bool = False, date: str = "t", stock: str = "n", at: str | None = None) -> str:
    """The SQL of compiler.evaluate over the relation panel, which panel_ctes (without WITH) define."""
    writer, ctes, last = Writer(date, stock, at), [panel_ctes], panel
    for i, (_, nodes) in enumerate(stages([r for v in values.values() for r in (v.value, v.under())])):
        made = ", ".join(f"{writer.window(x)} AS {x.name}" for x in nodes)
        ctes.append(f"step{i} AS (SELECT *, {made} FROM {last})")
        last = f"step{i}"
        writer.known.update(x.name for x in nodes)
    every = " AND ".join(dict.fromkeys(writer.text(v.under()) for v in values.values())) if joint else ""
    out = []
    for name, v in values.items():
        mask, value = writer.text(v.under()), writer.text(v.value)
        out.append(f"CASE WHEN {'together' if joint else mask} THEN {f'round({value} + {OFF_TIES!r}::DOUBLE, {decimals}) + 0.0::DOUBLE' if decimals is not None else value} END AS {name}")
        if masks:
            out.append(f"{mask} AS {name}__m")
    if joint:
        ctes.append(f"masked AS (SELECT *, {every} AS together FROM {last})")
        last = "masked"
    return f"WITH {', '.join(ctes)} SELECT {', '.join([*keep, *out])} FROM {last}"
