"""The factor registry: 213 named expressions over panel fields."""

from __future__ import annotations

from collections.abc import Callable

from panelforge.plans.expr import (
    M,
    Value,
    absolute,
    clamp,
    cs_rank,
    cs_zscore,
    delay,
    delta,
    ewma,
    field,
    greatest,
    least,
    log,
    log2,
    over,
    safe_divide,
    sign,
    sqrt,
    ts_corr,
    ts_max,
    ts_mean,
    ts_min,
    ts_rank,
    ts_std,
    ts_sum,
)

REGISTRY: dict[str, Value] = {}

opened, high, low, close, volume, vwap, amount = map(field, "open high low close volume vwap amount".split())
span = high - low
place = over(2.0 * close - high - low, span)  # where in the day's range it closes
vwap_place = over(2.0 * vwap - low - high, span)
before = delay(close, 1)
step = over(delta(close, 1), close)  # the day's move over today's close
gap = over(opened, before) - 1.0
discount = vwap - close
premium = over(vwap, close)
rank, z, mean, std, total, corr, tmin, tmax, tsrank = cs_rank, cs_zscore, ts_mean, ts_std, ts_sum, ts_corr, ts_min, ts_max, ts_rank


def register(name: str, value: Value) -> None:
    if name in REGISTRY:
        raise ValueError(f"factor {name} is registered twice")
    REGISTRY[name] = value


def series(prefix: str, start: int, build: Callable, choices) -> None:
    """Factors with running numbers that differ in parameters."""
    for i, choice in enumerate(choices, start):
        register(f"{prefix}_{i:03d}", build(*choice) if isinstance(choice, tuple) else build(choice))


def momentum(x: Value, p: int) -> Value:
    """x over its value p days ago, less one."""
    return over(x, delay(x, p)) - 1.0


def away(x: Value, k: int, floor: float = 1e-9) -> Value:
    """Relative distance of x from its mean over k days."""
    average = mean(x, k)
    return over(x - average, average, floor)


def slower(x: Value, k: int, p: int, alpha: float, floor: float = 1e-9) -> Value:
    """Smoothed change over p days of the distance from a mean."""
    distance = away(x, k, floor)
    return ewma(distance - delay(distance, p), alpha)


def share(x: Value, flag: Value, k: int) -> Value:
    """Sum of x where flag holds, over how often it does, in k days."""
    return over(total(x * flag, k), total(flag, k), 1.0)


def scarcity(price: Value, base: Value) -> Value:
    """Size of a relative move, over the logarithm of the traded amount."""
    return over(absolute(over(price, base) - 1.0), log(amount + 1.0))


def under(x: Value, y: Value, k: int) -> Value:
    return share(scarcity(x, y), x < y, k)


def spread(x: Value, k: int, floor: float = 1e-9) -> Value:
    return over(std(x, k), mean(x, k), floor)


# -- best
series("best", 1, lambda k: tsrank(-place, k), (5, 10, 20))
series("best", 4, lambda p: delta(-place, p), (3, 5))
register("best_006", ewma(-place, 1 / 10))
register("best_007", rank(-place))
register("best_008", mean(premium, 3))
register("best_009", over(ewma(vwap, 1 / 5), ewma(close, 1 / 5)))
register("best_010", (premium - 1.0) * volume)
register("best_011", rank(gap))
register("best_012", mean(gap, 5))
register("best_013", ewma(gap, 1 / 5))
register("best_014", corr(tsrank(over(span, close), 7), tsrank(volume, 7), 5))
register("best_015", rank(over(span, close)))
register("best_016", over(span, close) / (1.0 + sqrt(volume)))
series("best", 17, lambda a: delta(ewma(close, 1 / a), 1), (5, 10, 20))
register("best_020", ewma(-discount * volume, 1 / 5))
register("best_021", tmax(discount * volume, 3) + tmin(discount * volume, 3) * delta(volume, 3))

# -- stock
series("stock", 1, lambda k: corr(delta(log(volume + 1.0), 1), over(close - opened, opened), k), (4, 6))
fallen = rank(close - tmax(vwap, 15))
register("stock_003", sign(fallen) * greatest(absolute(fallen), 1e-12) ** clamp(absolute(over(delta(close, 5), close)), 0, 2))
register("stock_004", slower(close, 6, 3, 1 / 12))
register("stock_005", over(close - delay(close, 6), delay(close, 6)) * (volume + 1.0))
register("stock_006", away(close, 12))
register("stock_007", (delay(tmin(low, 5), 5) - tmin(low, 5)) * rank((total(step, 60) - total(step, 20)) / 40.0) * rank(volume))
push = total(opened, 5) * total(step, 5)
register("stock_008", rank(-(push - delay(push, 10))))
averages = mean(close, 3) + mean(close, 6) + mean(close, 12) + mean(close, 24)
register("stock_009", over(averages * 0.25, close))
register("stock_010", std(log(amount + 1.0), 6))
typical = (high + low + close) / 3.0
register("stock_011", (typical - mean(typical, 12)) / (0.015 * greatest(mean(absolute(close - mean(typical, 12)), 12), 1e-9)))
register("stock_012", over(ewma(greatest(delta(volume, 1), 0), 1 / 6) * 100.0, ewma(absolute(delta(volume, 1)), 1 / 6)))
register("stock_013", over(delta(vwap - close, 1), absolute(delta(vwap + close, 1))))
register("stock_014", momentum(close, 12) * volume)
register("stock_015", under(close, before, 20))


def williams(k: int) -> Value:
    floor, ceiling = least(low, before), greatest(high, before)
    return over(close - total(floor, k), total(ceiling - floor, k))


register("stock_016", (williams(6) * 288.0 + williams(12) * 144.0 + williams(24) * 72.0) * 100.0 / 504.0)
register("stock_017", -step * mean(volume, 20) * vwap * (high - close))
register("stock_018", over(close - delay(close, 5), delay(close, 5)) - over(close - delay(close, 20), delay(close, 20)))
register("stock_019", safe_divide(-(low - close) * opened ** 5.0, (close - high) * close ** 5.0))
register("stock_020", over(close - before, before) * volume)
register("stock_021", over(span - ewma(span, 2 / 11), ewma(span, 2 / 11)) * 100.0)
register("stock_022", corr(mean(volume, 20), low, 5) + (high + low) / 2.0 - close)

# -- extra
register("extra_001", delta(-place, 1))
swing = [tmax(discount, 3), tmin(discount, 3), delta(volume, 3)]
first, second, third = (rank(x.on(*swing)) for x in swing)
register("extra_002", first + second * third)
register("extra_003", gap)
register("extra_004", ewma(volume * place, 2 / 9) - ewma(volume * place, 2 / 4))
register("extra_005", over(amount, mean(amount, 20), 1.0) - 1.0)
register("extra_006", rank(over(volume, mean(volume, 20), 1.0)))
register("extra_007", over(ewma(span, 2 / 5), ewma(ewma(span, 2 / 5), 2 / 20)))
register("extra_008", over(total(greatest(high - before, 0), 5) * 100.0, total(greatest(before - low, 0), 10)))
downward = std(close, 20) * (close <= before)
register("extra_009", ewma(downward, 1 / 5) - ewma(downward, 1 / 20))
register("extra_010", over(close, delay(close, 5)))
register("extra_011", amount)
register("extra_012", over(high, opened))
register("extra_013", premium)
register("extra_014", over(span, close))

# -- add
register("add_001", rank(delta(close, 5)) * rank(delta(volume, 5)))
register("add_002", -away(close, 10) * rank(volume))
register("add_003", sign(delta(close, 1)) * (1.0 + absolute(step)) * over(delta(volume, 1), volume, 1.0))
register("add_004", tsrank(volume, 20) * tsrank(-place, 10))
register("add_005", total(close > before, 12) - total(close < before, 12))
register("add_006", ewma(momentum(close, 1), 1 / 12) - momentum(close, 12))
register("add_007", corr(rank(close), rank(volume), 5))
register("add_008", std(momentum(close, 1), 20))
middle = (high + low) * 0.5
register("add_009", middle - delay(middle, 3))
register("add_010", over(tmax(high, 5) - tmin(low, 5), close))
register("add_011", corr(vwap, volume, 10))
register("add_012", rank(opened - mean(opened, 10)) * rank(absolute(close - vwap)))
register("add_013", sqrt(high * low) - vwap)
register("add_014", over(close - delay(close, 5), delay(close, 5)))
register("add_015", rank(gap))
register("add_016", tmax(vwap, 10) - vwap)
register("add_017", vwap - tmin(vwap, 10))
register("add_018", mean(over(absolute(close - opened), span), 5))
register("add_019", total(close > opened, 5) / 5.0)
register("add_020", spread(close, 10))
register("add_021", rank(corr(close, volume, 20)))
register("add_022", over(ewma(volume, 2 / 6), ewma(volume, 2 / 24), 1.0))
series("add", 23, lambda k: over(close - mean(close, k), close), (5, 20))
register("add_025", over(mean(close, 5), mean(close, 20)))
register("add_026", spread(volume, 5, 1.0))
register("add_027", rank(-delta(close, 3) * delta(volume, 3)))
register("add_028", over(close - opened, span))
register("add_029", mean(over(close - opened, span), 10))
week, month = total(step, 5), total(step, 20)
register("add_030", rank(week.on(month)) * rank(month.on(week)))

# -- change
register("change_001", step - mean(step, 5))
register("change_002", over(delta(delta(close, 1), 1), close))
register("change_003", rank(volume - mean(volume, 20)))
register("change_004", over(span, mean(span, 20)) - 1.0)
register("change_005", total(sign(delta(close, 1)), 5))

# -- original
register("original_001", z(std(step, 20)))
series("original", 2, lambda extreme: rank(over(close, extreme(close, 20)) - 1.0), (tmax, tmin))
series("original", 4, lambda x: tsrank(x, 60), (close, volume))
register("original_006", corr(close, volume, 20))
series("original", 7, lambda x: tsrank(x, 20), (close, volume))
series("original", 9, lambda k: corr(close, volume, k), (10, 5))
series("original", 11, tsrank, ((close, 10), (volume, 10), (close, 5), (volume, 5)))
series("original", 15, lambda k: std(step, k), (10, 5))
series("original", 17, lambda extreme, k: over(close, extreme(close, k)) - 1.0, ((tmax, 10), (tmin, 10), (tmax, 5), (tmin, 5)))
series("original", 21, lambda p: momentum(close, p), (10, 5, 3, 1))
series("original", 25, lambda p: rank(momentum(close, p)), (10, 5, 1, 20))

# -- old
ranked_volume, ranked_vwap = rank(volume), rank(vwap)
register("old_027", ranked_volume * rank(discount))
register("old_028", corr(rank(opened), ranked_volume, 10))
register("old_029", tmin(rank(corr(close, volume, 5)), 12))
register("old_030", sign(delta(close, 5)) * (1.0 - rank(delta(volume, 5))))
register("old_031", rank(delta(close, 10)) * rank(over(delta(volume, 10), volume, 1.0)))
register("old_032", mean(close, 7) - close + corr(vwap, delay(close, 5), 20))
register("old_033", rank(-1.0 + over(opened, close)))
register("old_034", rank(2.0 - rank(over(std(step, 2), std(step, 5))) - rank(delta(close, 1))))
register("old_035", tsrank(volume, 32) * (1.0 - tsrank(close + high - low, 16)))
register("old_036", rank(corr(delay(opened - close, 1), close, 20)) + rank(opened - close))
register("old_037", -(rank(opened - delay(high, 1)) * rank(opened - before) * rank(opened - delay(low, 1))))
register("old_038", -(greatest(absolute(rank(opened)), 1e-12) ** clamp(rank(over(close, vwap)), 0.01, 2)))
register("old_039", -rank(delta(close, 7)) * (1.0 - rank(ewma(volume * step, 1 / 20))))
register("old_040", -rank(std(high, 10)) * corr(high, volume, 10))
register("old_041", sqrt(high * low) - vwap)
register("old_042", over(rank(discount), absolute(rank(vwap + close))))
register("old_043", tsrank(over(volume, mean(volume, 20), 1.0), 20) * tsrank(-delta(close, 7), 20))
register("old_044", -corr(high, ranked_volume, 5))
register("old_045", -rank(mean(delay(close, 5), 20)) * corr(close, volume, 2))
register("old_046", averages / (4.0 * greatest(close, 1e-9)) - 1.0)
register("old_047", over(tmax(high, 6) - close, tmax(high, 6) - tmin(low, 6)) * 100.0)
register("old_048", over(-delta(close, 1) * volume, ewma(volume, 1 / 20), 1.0))
loss = (close - before) * (close - before < 0)
register("old_049", total(loss, 20))
together = rank(corr(ranked_volume, ranked_vwap, 5))
register("old_050", -tmax(together, 5))
register("old_051", total(loss, 12))
register("old_052", (over(total(greatest(high - before, 0), 26), total(greatest(before - low, 0), 26)) - 1.0) * 100.0)
register("old_053", total(close > before, 12) / 12.0 * 100.0)
candle = absolute(close - opened)
register("old_054", -rank(std(candle, 10) + candle) + rank(corr(close, opened, 10)))
register("old_055", corr(rank(over(close - tmin(low, 12), tmax(high, 12) - tmin(low, 12))), ranked_volume, 6))
register("old_056", -(rank(total(step, 10)) * rank(corr(close, volume, 5)) * rank(std(step, 20))))
register("old_057", over(close, ewma(close, 1 / 30)) - 1.0)
register("old_058", -volume * (close - before))
register("old_059", rank(mean(volume * absolute(step), 20)))
register("old_060", 2.0 * (rank(opened - tmin(opened, 12)) - rank((mean(step, 60) + 1.0) ** 2.0)))
register("old_061", rank(vwap - tmin(vwap, 16)))
register("old_062", rank(corr(vwap, total(mean(volume, 20), 23), 5)))
register("old_063", tmax(rank(corr(ranked_vwap, ranked_volume, 4)), 8))
register("old_064", rank(corr(total(opened * 0.178 + low * 0.822, 15), total(mean(volume, 60), 9), 11)))
register("old_065", rank(corr((opened * 0.147 + vwap * 0.853).on(M), total(mean(volume, 6), 2), 6)))
register("old_066", rank(delta(vwap, 4)))
register("old_067", over(high - tmax(high, 6), tmax(high, 6)) * rank(corr(vwap, mean(volume, 20), 4)))
register("old_068", rank(corr(high, mean(volume, 15), 9)) * rank(corr(close, volume, 4)))
register("old_069", total(greatest(rank(corr(tsrank(close, 5), tsrank(volume, 5), 4)), 0), 3))
register("old_070", rank(delta(vwap, 2)))
register("old_071", tsrank(corr(tsrank(close, 3), tsrank(volume, 3), 18), 4))
register("old_072", rank(ewma(corr(mean(volume, 40), low, 4), 1 / 20)) + rank(ewma(corr(ranked_vwap, ranked_volume, 4), 1 / 7)))
register("old_073", -tsrank(ewma(delta(vwap, 5), 1 / 2), 3))
register("old_074", rank(corr(close, total(mean(volume, 30), 37), 15)))
register("old_075", rank(corr(ranked_vwap, ranked_volume, 5)) - rank(corr(rank(close), ranked_volume, 5)))
register("old_076", rank(delta(corr(vwap, volume, 4), 3)))

# -- better
register("better_001", (gap * log2(volume + 1.0)).on(M))
register("better_002", (over(gap * volume, mean(volume, 5), 1.0)).on(M))
register("better_003", (gap * over(discount * span, close)).on(M))
series("better", 4, lambda p: -(vwap_place - delay(vwap_place, p)), (1, 5))
register("better_006", mean(vwap_place, 5))
register("better_007", over(span, close) * delta(volume, 1))
register("better_008", over(over(span, close), log2(volume + 1.0)))
series("better", 9, lambda k: under(vwap, delay(vwap, 1), k), (20, 10))


def support(x: Value, floor: Value, ceiling: Value) -> Value:
    """Mean over 6, 12 and 24 days of where x lies between floor and ceiling."""
    inside = over(x - floor, ceiling - floor)
    return (total(inside, 6) / 6.0 + total(inside, 12) / 12.0 + total(inside, 24) / 24.0) / 3.0


register("better_011", support(close, least(low, delay(low, 1)), greatest(high, delay(high, 1))))
register("better_012", support(vwap, least(low, delay(vwap, 1)).on(M), greatest(high, delay(vwap, 1))))
register("better_013", (premium - 1.0) * log2(amount + 1.0))
register("better_014", mean((premium - 1.0) * log2(amount + 1.0), 4))
series("better", 15, slower, ((vwap, 10, 5, 1 / 20), (vwap, 6, 3, 1 / 12), (amount, 6, 3, 1 / 12, 1.0), (amount, 10, 5, 1 / 20, 1.0)))
smooth = ewma(ewma(ewma(log(volume + 1.0), 2 / 13), 2 / 13), 2 / 13)
register("better_019", momentum(smooth, 1))
register("better_020", spread(over(absolute(momentum(close, 1)), volume, 1.0), 10))
register("better_021", over(vwap, before))
surprise = ((over(vwap, before) - 1.0) * log2(amount + 1.0)).on(M)
register("better_022", surprise)
register("better_023", mean(surprise, 4))
pressure = tmax(discount, 5) + tmin(discount, 5)
register("better_024", pressure * delta(volume, 5))
register("better_025", pressure * (volume - mean(volume, 5)))
register("better_026", over(ewma(over(span, close), 2 / 5), ewma(ewma(over(span, close), 2 / 5), 2 / 20)))
register("better_027", under(vwap, before, 20))
register("better_028", under(vwap, close, 20))

# -- market
register("cs_rank_close", rank(clamp(momentum(close, 1), -0.1, 0.1)))
register("cs_rank_open", rank(clamp(gap, -0.1, 0.1)))
for price_name, price in (("high", high), ("low", low), ("avg", vwap)):
    register(f"cs_rank_{price_name}", rank(over(price, before) - 1.0))
register("cs_rank_amount", rank(amount))

# -- alpha
register("alpha_001", rank(tsrank(close, 5)) - 0.5)
register("alpha_002", -corr(rank(delta(log(greatest(volume, 1.0)), 2)), rank(over(close - opened, opened)), 6))
register("alpha_003", -corr(rank(opened), ranked_volume, 10))
register("alpha_004", -tsrank(rank(low), 9))
register("alpha_006", -corr(opened, volume, 10))
register("alpha_007", z(close - total(close, 20) / 20.0))
register("alpha_012", sign(delta(volume, 1)) * -delta(close, 1))
register("alpha_053", -delta((close - low - (high - close)) / (close - low + 1e-12), 9))
register("alpha_101", (close - opened) / (high - low + 0.001))

#: Sets by family, in order of registration.
FAMILIES: dict[str, list[str]] = {}
for factor_name in REGISTRY:
    FAMILIES.setdefault("market" if factor_name.startswith("cs_rank") else factor_name.rpartition("_")[0], []).append(factor_name)
#: The set by other names without underscores.
ALPHA_SET = {name.replace("_", ""): name for name in FAMILIES["alpha"]}
