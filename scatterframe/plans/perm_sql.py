"""Oracle side of the reorder rules: source cells laid out in a grid and sorted in reading order."""

from __future__ import annotations

from ..operators import shapes as sh
from ..operators.reorder import ARP_TABLE, RULES, listed

H = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def hash_sql(*parts: str) -> str:
    return H.format("concat_ws('|', " + ", ".join(parts) + ")")


def _mod(x: str, k) -> str:
    return f"(((({x}) % {k}) + {k}) % {k})"


def _sorted(n_out: int, order: str, where: str = "true", extra: str = "") -> str:
    return (f"SELECT row_number() OVER (ORDER BY {order}) AS pos, v AS src FROM "
            f"(SELECT v, v - 1 AS z FROM range(1, {n_out + 1}) r(v)) c {extra} WHERE {where}")


def _direct(n_out: int, src: str) -> str:
    return f"SELECT q + 1 AS pos, CAST({src} AS BIGINT) AS src FROM range(0, {n_out}) r(q)"


def perm_sql(rule: str, n: int, **kw) -> str:
    made = RULES[rule](n, **kw)
    p, m = made.params, made.n_out
    if rule == "identity":
        return _direct(n, "q + 1")
    if rule in ("block", "blockCM"):
        return _sorted(m, f"z % {p['width']}, z // {p['width']}")
    if rule == "matrix":
        return _sorted(m, f"z % {p['k']}, z // {p['k']}")
    if rule == "snake":
        return _sorted(m, f"z % {p['k']}, CASE WHEN z % {p['k']} % 2 = 1 THEN -(z // {p['k']}) ELSE z // {p['k']} END")
    if rule == "helical":
        return _sorted(m, f"{_mod(f'z // {p['l']} - z % {p['l']}', p['k'])}, z % {p['l']}")
    if rule == "helicalScan":
        return _sorted(m, f"{_mod(f'z // {p['c']} - z % {p['c']}', p['r'])}, z % {p['c']}")
    if rule == "diagonal":
        return _sorted(m, f"z // {p['c']} + z % {p['c']}, z % {p['c']}")
    if rule == "spiral":
        l, k = p["l"], p["k"]
        r, c = f"(z % {l})", f"(z // {l})"
        g = f"least({r}, {c}, {l - 1} - {r}, {k - 1} - {c})"
        side = f"CASE WHEN {r} = {g} THEN 0 WHEN {c} = {k - 1} - {g} THEN 1 WHEN {r} = {l - 1} - {g} THEN 2 ELSE 3 END"
        along = f"CASE {side} WHEN 0 THEN {c} WHEN 1 THEN {r} WHEN 2 THEN -{c} ELSE -{r} END"
        return _sorted(m, f"{g}, {side}, {along}")
    if rule == "hierarchical":
        q_, r_, s = p["q"], p["r"], p["stride"]
        return _sorted(m, "q", extra=f"JOIN range(0, {n}) s(q) ON (z % {r_}) * {q_} + z // {r_} = "
                                     f"(q // {r_}) * {r_} + ((q % {r_}) * {s}) % {r_}")
    if rule == "multiDim":
        d = list(p.values())
        keys, w = [], 1
        for x in d:
            keys.append(f"(z // {w}) % {x}")
            w *= x
        return _sorted(m, ", ".join(keys))
    if rule == "latinSquare":
        k = p["k"]
        h = "(CASE WHEN j % 2 = 1 THEN -1 ELSE 1 END) * ((j + 1) // 2)"
        return _sorted(m, f"j, z // {k}", f"v <= {n}",
                       f"JOIN range(0, {k}) s(j) ON {_mod(f'z // {k} - {h}', k)} = z % {k}")
    if rule == "time":
        sc, sym, d = p["sc"], p["sym"], p["depth"]
        return _sorted(m, f"{_mod(f'z // {sc} - (z % {sc}) * {d}', sym)}, z % {sc}")
    if rule == "freqDeterm":
        sc, a = p["sc"], p["stride"]
        return _sorted(m, f"z // {sc}, b", extra=f"JOIN range(0, {sc}) s(b) ON (b * {a}) % {sc} = {_mod(f'z % {sc} - z // {sc}', sc)}")
    if rule == "freqRandom":
        sc = p["sc"]
        sub = _mod(f"z % {sc} - z // {sc}", sc)
        return _sorted(m, f"z // {sc}, {hash_sql(str(p['seed']), f'{sub} + 1')}, {sub}")
    if rule == "random":
        return _sorted(m, f"{hash_sql(str(p['seed']), str(kw.get('draw', 0)), 'v')}, v")
    if rule == "goldenRP":
        return _direct(m, f"({kw.get('offset', 0)} + q * {p['stride']}) % {n} + 1")
    if rule == "prime":
        return (f"WITH RECURSIVE g(pos, src) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL "
                f"SELECT pos + 1, src * {p['g']} % {p['p']} FROM g WHERE pos < {m}) SELECT pos, src FROM g")
    if rule in ("algebraic", "turbo"):
        return _direct(m, f"({p['f1']} * q + {p['f2']} * q * q) % {n} + 1")
    if rule in ("convolutional", "convCM"):
        b, r, d = p["branches"], p["rows"], p["depth"]
        return _sorted(m, f"{_mod(f'z // {b} + (z % {b}) * {d}', r)}, z % {b}")
    if rule == "arp":
        p0, p1, p2, p3 = next(r for r in ARP_TABLE if r[0] == n)[1:]
        return _direct(m, f"({p0} * q + [0, {n // 2 + p1}, {p2}, {n // 2 + p3}][q % 4 + 1] + 1) % {n} + 1")
    if rule == "drp":
        r_, w_ = kw["read"], kw["write"]
        k = len(r_)
        ib = f"(({p['s']} + ({k} * (q // {k}) + {w_}[q % {k} + 1]) * {p['p']}) % {n})"
        return _direct(m, f"{k} * ({ib} // {k}) + {r_}[{ib} % {k} + 1] + 1")
    if rule == "S":
        l, k = p["l"], p["k"]

        def lane(size):
            xs = list(range(size))
            h, f = (size + 1) // 2, size // 2
            for y in range(1, f + 1, 2):
                xs[y - 1], xs[y + h - 1] = y + h - 1, y - 1
            return xs

        return _direct(m, f"{lane(l)}[q % {l} + 1] * {k} + {lane(k)}[q // {l} + 1] + 1")
    raise ValueError(rule)


def perms_sql(items, n: int, name: str = "perm") -> str:
    items = [(r, {}) if isinstance(r, str) else r for r in items]
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT '{r}' AS method, pos, src FROM ({perm_sql(r, n, **kw)})" for r, kw in items) + ")"


def perms_by_length(items, lengths, name: str = "perm") -> str:
    """The same for several frame lengths, with n_rows; a rule without parameters for a length has no rows there."""
    items = [(r, {}) if isinstance(r, str) else r for r in items]
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT '{r}' AS method, CAST({n} AS BIGINT) AS n_rows, pos, src FROM ({perm_sql(r, n, **kw)})" for n in lengths for r, kw in items if listed(r, n)) + ")"


__all__ = ["hash_sql", "perm_sql", "perms_by_length", "perms_sql", "sh"]
