"""SQL of the panels, for an independent engine over the same tables."""

from __future__ import annotations

BARS = """
raw AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_suppkey AS stock, l_extendedprice / l_quantity AS price, l_quantity, l_extendedprice,
  row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity) AS pos FROM lineitem WHERE l_quantity > 0 AND l_shipdate IS NOT NULL),
bars AS (SELECT date, stock, arg_min(price, pos) AS open, max(price) AS high, min(price) AS low, arg_max(price, pos) AS close, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount FROM raw GROUP BY date, stock),
days AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS t FROM (SELECT DISTINCT date FROM bars)),
names AS (SELECT stock, CAST(row_number() OVER (ORDER BY stock) - 1 AS INTEGER) AS n FROM (SELECT DISTINCT stock FROM bars)),
panel AS (SELECT t, d.date, n, s.stock, coalesce(open, 0) AS open, coalesce(high, 0) AS high, coalesce(low, 0) AS low, coalesce(close, 0) AS close, coalesce(volume, 0) AS volume,
  coalesce(amount / volume, 0) AS vwap, coalesce(amount, 0) AS amount, close IS NOT NULL AS mask
  FROM days d CROSS JOIN names s LEFT JOIN bars b ON b.date = d.date AND b.stock = s.stock)
"""
