"""SQL fragments for the twins of neighbourhood operators on 8x8 frames."""

from __future__ import annotations

import math


def mirrored(e: str) -> str:
    """Coordinate ``e`` folded back into 0..7 without repeating the border."""
    m = f"((({e}) % 14 + 14) % 14)"
    return f"(CASE WHEN {m} > 7 THEN 14 - {m} ELSE {m} END)"


def kernel(weights: list[float]) -> str:
    r = len(weights) // 2
    rows = ", ".join(f"({i - r}, {w!r}::DOUBLE)" for i, w in enumerate(weights))
    return f"(VALUES {rows})"


def gauss(sigma: float) -> list[float]:
    n = int(round(sigma * 8 + 1)) | 1
    raw = [math.exp(-((i - n // 2) ** 2) / (2 * sigma * sigma)) for i in range(n)]
    return [v / sum(raw) for v in raw]


def separable(name: str, src: str, value: str, wy: list[float], wx: list[float]) -> str:
    """CTEs for a mirrored separable filter: ``name(scene_id, y, x, v)``."""
    return f"""
{name}_r AS MATERIALIZED (SELECT a.scene_id, a.y, a.x, sum(k.c * b.{value}) AS v
  FROM {src} a CROSS JOIN {kernel(wx)} k(d, c)
  JOIN {src} b ON b.scene_id = a.scene_id AND b.y = a.y AND b.x = {mirrored('a.x + k.d')}
  GROUP BY 1, 2, 3),
{name} AS MATERIALIZED (SELECT a.scene_id, a.y, a.x, sum(k.c * b.v) AS v
  FROM {name}_r a CROSS JOIN {kernel(wy)} k(d, c)
  JOIN {name}_r b ON b.scene_id = a.scene_id AND b.x = a.x AND b.y = {mirrored('a.y + k.d')}
  GROUP BY 1, 2, 3)"""


def gradient(name: str, src: str, value: str) -> str:
    return f"""{separable(name + '_gx', src, value, [1, 2, 1], [-1, 0, 1])},
{separable(name + '_gy', src, value, [-1, 0, 1], [1, 2, 1])},
{name} AS MATERIALIZED (SELECT a.scene_id, a.y, a.x, sqrt(a.v * a.v + b.v * b.v) AS v
  FROM {name}_gx a JOIN {name}_gy b USING (scene_id, y, x))"""


def local_sd(name: str, src: str, value: str, size: int = 7) -> str:
    one = [1.0] * size
    n = size * size
    return f"""{name}_sq AS MATERIALIZED (SELECT scene_id, y, x, {value} AS u, {value} * {value} AS uu FROM {src}),
{separable(name + '_s', name + '_sq', 'u', one, one)},
{separable(name + '_q', name + '_sq', 'uu', one, one)},
{name} AS MATERIALIZED (SELECT a.scene_id, a.y, a.x,
  sqrt(greatest(b.v / {n} - (a.v / {n}) * (a.v / {n}), 0)) AS v
  FROM {name}_s a JOIN {name}_q b USING (scene_id, y, x))"""


ELLIPSE = ("((abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 2) "
           "OR (abs(a.y - b.y) = 2 AND a.x = b.x))")


def box(r: int) -> str:
    return f"(abs(a.y - b.y) <= {r} AND abs(a.x - b.x) <= {r})"


def morph(name: str, src: str, grow: bool, shape: str = ELLIPSE, col: str = "m",
          solid: bool = True, key: str = "scene_id") -> str:
    f = "max" if grow else "min"
    v = f"{f}(b.{col})"
    if not solid:
        v = f"CASE WHEN a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 THEN {v} ELSE 0 END"
    keys = [k.strip() for k in key.split(",")]
    sel = ", ".join(f"a.{k}" for k in keys)
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    return f"""{name} AS MATERIALIZED (SELECT {sel}, a.y, a.x, {v} AS {col}
  FROM {src} a JOIN {src} b ON {on} AND {shape} GROUP BY {sel}, a.y, a.x)"""


def chain(name: str, src: str, grows: list[bool], **kw) -> str:
    """Several erosions and dilations in a row."""
    parts, at = [], src
    for i, g in enumerate(grows):
        nxt = name if i == len(grows) - 1 else f"{name}_{i}"
        parts.append(morph(nxt, at, g, **kw))
        at = nxt
    return ",\n".join(parts)


def fill(name: str, src: str) -> str:
    return f"""{name}_out AS (SELECT scene_id, y, x FROM {src}
    WHERE m = 0 AND (y IN (0, 7) OR x IN (0, 7))
  UNION SELECT b.scene_id, b.y, b.x FROM {name}_out a JOIN {src} b
    ON a.scene_id = b.scene_id AND b.m = 0 AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
{name} AS MATERIALIZED (SELECT s.scene_id, s.y, s.x,
    CASE WHEN s.m = 1 OR o.y IS NULL THEN 1 ELSE 0 END AS m
  FROM {src} s LEFT JOIN {name}_out o USING (scene_id, y, x))"""


def comps(name: str, src: str, conn: int = 8, where: str = "m = 1", same: str = "TRUE",
          key: str = "scene_id") -> str:
    near = ("abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1" if conn == 8
            else "abs(a.y - b.y) + abs(a.x - b.x) = 1")
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in key.split(","))
    bk = ", ".join(f"b.{k.strip()}" for k in key.split(","))
    return f"""{name}_set AS MATERIALIZED (SELECT * FROM {src} WHERE {where}),
{name}_reach AS (SELECT {key}, y, x, y * 8 + x AS lab FROM {name}_set
  UNION SELECT {bk}, b.y, b.x, a.lab FROM {name}_reach a JOIN {name}_set b
    ON {on} AND {near} AND b.y * 8 + b.x > a.lab AND {same}),
{name} AS MATERIALIZED (SELECT {key}, y, x, min(lab)::BIGINT AS comp FROM {name}_reach GROUP BY ALL)"""


def otsu(name: str, src: str, key: str) -> str:
    """``src`` has key columns, v and n. Exact integer score parts."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in key.split(","))
    return f"""{name}_c AS (SELECT {key}, v, n,
    sum(n) OVER (PARTITION BY {key} ORDER BY v) AS n0, sum(v * n) OVER (PARTITION BY {key} ORDER BY v) AS s0,
    sum(n) OVER (PARTITION BY {key}) AS nn, sum(v * n) OVER (PARTITION BY {key}) AS ss,
    sum(v * v * n) OVER (PARTITION BY {key}) AS qq FROM {src}),
{name}_s AS (SELECT *, CASE WHEN nn > n0 THEN
    ((nn * s0 - n0 * ss)::DOUBLE * (nn * s0 - n0 * ss)::DOUBLE) / (n0::DOUBLE * (nn - n0)::DOUBLE)
    ELSE 0 END AS score FROM {name}_c),
{name} AS MATERIALIZED (SELECT {key}, v::INT AS cut,
    score / (nn::DOUBLE * nn) / (qq / nn::DOUBLE - (ss / nn::DOUBLE) * (ss / nn::DOUBLE) + 1e-6) AS sep
  FROM {name}_s QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY score DESC, v) = 1)"""


def unit(v: str, lo: str, hi: str) -> str:
    return f"(CASE WHEN {hi} > {lo} THEN greatest(0.0, least(1.0, ({v} - {lo}) / ({hi} - {lo}))) ELSE 0.0 END)"
