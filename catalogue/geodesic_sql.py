"""WGS 84 geodesics in plain SQL, to check the Arrow functions with another engine.

The longitude equation is iterated a fixed number of times and the integrals use a
short Gauss-Legendre rule: enough for the few hundred kilometres these tables span.
"""

from __future__ import annotations

import numpy as np

_F = "(1 / 298.257223563::DOUBLE)"
_A = "6378137.0::DOUBLE"
_B = f"({_A} * (1 - {_F}))"
_E2 = f"({_F} * (2 - {_F}))"
_EP2 = f"({_E2} / (1 - {_E2}))"
_NODES = [(float(x), float(w)) for x, w in zip(*np.polynomial.legendre.leggauss(6))]


def _integral(body: str, start: str, arc: str) -> str:
    """``body`` may use ``{s}``, the running arc."""
    terms = " + ".join(
        "{w!r} * {f}".format(w=w, f=body.format(s=f"({start} + {arc} * {(1 + x) / 2!r})"))
        for x, w in _NODES)
    return f"({arc} / 2 * ({terms}))"


_LENGTH = "sqrt(1 + k2 * pow(sin({s}), 2))"
_TURN = (f"(2 - {_F}) / (1 + (1 - {_F}) * " + _LENGTH + ")")
_T = "({x} + sqrt(1 / {x} + 1) * asinh(sqrt({x})))"


def _leg(omega: str) -> str:
    return (
        f"sin({omega}) AS so, pow(sin({omega} / 2), 2) AS hv, cb2 * so AS p1, "
        "sb2 * cb1 - cb2 * sb1 + 2 * sb1 * cb2 * hv AS q1, "
        "atan2(sqrt(p1 * p1 + q1 * q1), sb1 * sb2 + cb1 * cb2 * (1 - 2 * hv)) AS arc, "
        "atan2(p1, q1) AS a1, sin(a1) * cb1 AS sa0, atan2(sb1, cos(a1) * cb1) AS s1, "
        f"{_EP2} * (1 - sa0 * sa0) AS k2")


def inverse(source: str, keys: str, with_area: bool = False) -> str:
    """Adds ``distance_m``, ``bearing_deg`` (and ``edge_area``) to ``source``.

    ``source`` is a query with ``lon1, lat1, lon2, lat2``; ``keys`` are columns to keep.
    """
    layers = [
        f"l0 AS (SELECT {keys}, radians(lon2 - lon1) AS lam, "
        f"atan((1 - {_F}) * tan(radians(lat1))) AS b1, atan((1 - {_F}) * tan(radians(lat2))) AS b2,"
        f" sin(b1) AS sb1, cos(b1) AS cb1, sin(b2) AS sb2, cos(b2) AS cb2, lam AS w "
        f"FROM ({source}))"]
    for i in range(7):
        layers.append(
            f"l{i + 1} AS (SELECT {keys}, lam, sb1, cb1, sb2, cb2, "
            f"lam + {_F} * sa0 * {_integral(_TURN, 's1', 'arc')} AS w "
            f"FROM (SELECT *, {_leg('w')} FROM l{i}))")
    area = ""
    if with_area:
        y = "(k2 * pow(sin({s}), 2))"
        body = (f"-(({_T.format(x=_EP2)}) - ({_T.format(x=y)})) / ({_EP2} - {y}) * sin({{s}}) / 2")
        c2 = f"(({_A} * {_A} + {_B} * {_B} * atanh(sqrt({_E2})) / sqrt({_E2})) / 2)"
        area = (
            f", {c2} * 2 * atan2(sin(w) * (sb1 * (1 + cb2) + sb2 * (1 + cb1)), (1 + cos(w)) * "
            f"(sb1 * sb2 + (1 + cb1) * (1 + cb2))) + {_E2} * {_A} * {_A} * sa0 * "
            f"sqrt(1 - sa0 * sa0) * {_integral(body, 's1', 'arc')} AS edge_area")
    return (
        f"WITH {', '.join(layers)} SELECT {keys}, {_B} * {_integral(_LENGTH, 's1', 'arc')} AS "
        "distance_m, CASE WHEN arc = 0 THEN 0 ELSE (degrees(a1) + 360) % 360 END AS bearing_deg"
        f"{area} FROM (SELECT *, {_leg('w')} FROM l7)")


def direct(source: str, keys: str) -> str:
    """Adds ``far_lon`` and ``far_lat`` from ``lon1, lat1, bearing, distance_m``."""
    layers = [
        f"d0 AS (SELECT {keys}, lon1, distance_m / {_B} AS target, "
        f"atan((1 - {_F}) * tan(radians(lat1))) AS b1, radians(bearing) AS a1, "
        "sin(a1) * cos(b1) AS sa0, sqrt(1 - sa0 * sa0) AS ca0, "
        f"atan2(sin(b1), cos(a1) * cos(b1)) AS s1, {_EP2} * (1 - sa0 * sa0) AS k2, "
        f"target AS arc FROM ({source}))"]
    for i in range(4):
        layers.append(
            f"d{i + 1} AS (SELECT * EXCLUDE (arc), arc - ({_integral(_LENGTH, 's1', 'arc')} "
            f"- target) / sqrt(1 + k2 * pow(sin(s1 + arc), 2)) AS arc FROM d{i})")
    return (
        f"WITH {', '.join(layers)} SELECT {keys}, lon1 + degrees("
        "atan2(sa0 * sin(s1 + arc), cos(s1 + arc)) - atan2(sa0 * sin(s1), cos(s1)) "
        f"- {_F} * sa0 * {_integral(_TURN, 's1', 'arc')}) AS far_lon, "
        f"degrees(atan2(ca0 * sin(s1 + arc), (1 - {_F}) * "
        "sqrt(sa0 * sa0 + pow(ca0 * cos(s1 + arc), 2)))) AS far_lat FROM d4")
