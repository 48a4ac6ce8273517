"""The geodesic solvers, without Spark."""

import numpy as np
import pytest

from geocairn.functions import geodesy, planar


def dist(lon1, lat1, lon2, lat2):
    d, a, _ = geodesy.inverse([lon1], [lat1], [lon2], [lat2])
    return d[0], np.degrees(a[0]) % 360


def test_known_lines():
    assert dist(0, 0, 1, 0) == pytest.approx((111319.490793, 90.0), abs=1e-6)
    assert dist(-82.5, 36.5, -82.0, 36.0) == pytest.approx((71398.317, 140.84515), abs=1e-3)
    # published reference line for geodesic solvers
    assert dist(-73.8, 40.6, -0.5, 51.6) == pytest.approx((5551759.400, 51.198883), abs=1e-3)
    assert dist(0, -30, 179.8, 29.9) == pytest.approx((19989832.827610, 161.890524736), abs=1e-5)
    assert dist(5, 5, 5, 5)[0] == 0.0
    assert dist(0, 90, 123, -90)[0] == pytest.approx(20003931.458625, abs=1e-5)


def test_direct_and_inverse_agree():
    rng = np.random.default_rng(7)
    n = 4000
    lon, lat = rng.uniform(-180, 180, n), rng.uniform(-89, 89, n)
    azi, s = rng.uniform(-180, 180, n), rng.uniform(0, 19.9e6, n)
    far_lon, far_lat = geodesy.direct(lon, lat, azi, s)
    d, a, _ = geodesy.inverse(lon, lat, far_lon, far_lat)
    assert np.abs(d - s).max() < 1e-6
    assert np.abs((np.degrees(a) - azi + 180) % 360 - 180).max() < 1e-5


def test_nearly_antipodal_is_symmetric():
    rng = np.random.default_rng(8)
    n = 300
    lat, off = rng.uniform(-60, 60, n), rng.uniform(-0.5, 0.5, (2, n))
    a = geodesy.inverse(np.zeros(n), lat, 180 + off[0], -lat + off[1])[0]
    b = geodesy.inverse(180 + off[0], -lat + off[1], np.zeros(n), lat)[0]
    assert np.abs(a - b).max() < 1e-6
    assert a.max() < 20003931.5


def ring(points):
    lon, lat = np.array(points, float).T
    area, length = geodesy.ring_measures(lon, lat, [0, len(lon)])
    return area[0], length[0]


def test_ring_area_and_length():
    box = [(0, 0), (1, 0), (1, 1), (0, 1)]
    area, length = ring(box)
    assert area == pytest.approx(12308778361.47, abs=1.0)
    assert length == pytest.approx(443770.917, abs=1e-3)
    for other in (box[::-1], box + box[:1], box[2:] + box[:2]):
        assert ring(other) == pytest.approx((area, length), rel=1e-12)
    across = [(179.5, 0), (-179.5, 0), (-179.5, 1), (179.5, 1)]
    assert ring(across)[0] == pytest.approx(area, rel=1e-9)


def test_ring_around_a_pole():
    lon = np.arange(0, 360, 0.25)
    area, _ = geodesy.ring_measures(lon, np.full(lon.size, 80.0), [0, lon.size])
    e = np.sqrt(geodesy._E2)
    s = np.sin(np.radians(80))
    q = lambda x: (1 - e * e) * (x / (1 - e * e * x * x) + np.arctanh(e * x) / e)
    cap = np.pi * geodesy.EQUATORIAL_RADIUS_M**2 * (q(1.0) - q(s))
    assert area[0] == pytest.approx(cap, rel=1e-5)


def brute_hull(points):
    points = sorted(set(points))
    corners = set()
    for a in points:
        for b in points:
            if a == b:
                continue
            side = [(b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for c in points]
            on = [c for c, d in zip(points, side) if d == 0]
            if min(side) >= 0 and {min(on), max(on)} == {a, b}:
                corners |= {a, b}
    return corners


def test_hull_against_brute_force():
    rng = np.random.default_rng(9)
    for size in (3, 10, 40, 300):
        pts = [tuple(map(float, p)) for p in rng.integers(0, 12 if size < 300 else 40, (size, 2))]
        x, y = np.array(pts).T
        assert set(planar.hull(x, y)) == brute_hull(pts)


def test_hull_exact_on_decimal_grids():
    # a slanted line of decimal positions is collinear only up to rounding
    x = np.array([0.1, 0.2, 0.3, 0.4, 0.2])
    y = np.array([0.1, 0.2, 0.3, 0.4, 0.9])
    assert len(planar.hull(x, y)) >= 3
    assert planar.hull(np.array([]), np.array([])) == []


def test_simplify_rules():
    x, y = np.array([0, 0.5, 1.0]), np.array([0, 0.01, 0])
    assert planar.douglas_peucker(x, y, 0.1, 2).tolist() == [0, 2]
    assert planar.douglas_peucker(x, y, 0.001, 2).tolist() == [0, 1, 2]
    assert planar.visvalingam(x, y, 0.01).tolist() == [0, 2]
    # a closed ring keeps four points however large the tolerance
    rx, ry = np.array([0, 1, 1, 0, 0.0]), np.array([0, 0, 1, 1, 0.0])
    assert len(planar.douglas_peucker(rx, ry, 100.0, 4)) >= 4


def brute_visvalingam(x, y, threshold):
    keep = list(range(len(x)))
    while len(keep) > 2:
        areas = [abs((x[b] - x[a]) * (y[c] - y[a]) - (x[c] - x[a]) * (y[b] - y[a])) / 2
                 for a, b, c in zip(keep, keep[1:], keep[2:])]
        if min(areas) > threshold:
            break
        del keep[1 + int(np.argmin(areas))]
    return keep


def brute_dp(x, y, tol):
    def run(i, j):
        if j - i < 2:
            return [i]
        d = np.array([x[j] - x[i], y[j] - y[i]])
        gaps = []
        for m in range(i + 1, j):
            v = np.array([x[m] - x[i], y[m] - y[i]])
            t = np.clip(v @ d / (d @ d), 0, 1)
            gaps.append(np.hypot(*(v - t * d)))
        m = int(np.argmax(gaps))
        return [i] if gaps[m] <= tol else run(i, i + 1 + m) + run(i + 1 + m, j)

    return run(0, len(x) - 1) + [len(x) - 1]


def test_simplify_against_brute_force():
    rng = np.random.default_rng(10)
    for _ in range(20):
        x, y = np.cumsum(rng.normal(size=(2, 60)), axis=1)
        assert planar.visvalingam(x, y, 0.8).tolist() == brute_visvalingam(x, y, 0.8)
        assert planar.douglas_peucker(x, y, 1.0, 2).tolist() == brute_dp(x, y, 1.0)


def one_by_one(x, y, tolerance, min_points):
    """Runs split depth first, left to right, with plain arithmetic."""
    left, kept, stack = x.size, set(range(x.size)), [(0, x.size - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        dx, dy = x[j] - x[i], y[j] - y[i]
        norm = dx * dx + dy * dy
        gaps = []
        for m in range(i + 1, j):
            t = min(1.0, max(0.0, ((x[m] - x[i]) * dx + (y[m] - y[i]) * dy) / norm)) if norm else 0.0
            gaps.append(((x[m] - x[i] - t * dx) ** 2 + (y[m] - y[i] - t * dy) ** 2) ** 0.5)
        if max(gaps) > tolerance:
            split = i + 1 + gaps.index(max(gaps))
            stack += [(split, j), (i, split)]
        elif left - (j - i - 1) >= min_points:
            kept -= set(range(i + 1, j))
            left -= j - i - 1
    return sorted(kept)


def test_all_paths_at_once_as_one_by_one():
    rng = np.random.default_rng(4)
    sizes = np.concatenate([[0, 1, 2, 3, 300], rng.integers(0, 40, 200), [0]])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    x, y = (np.round(rng.normal(size=offsets[-1]).cumsum(), 2) for _ in "xy")
    least = rng.integers(2, 7, sizes.size)
    for tolerance in (0.0, 0.5, 2.0, 50.0):
        keep = planar.douglas_peucker_all(x, y, offsets, tolerance, least)
        small = planar.visvalingam_all(x, y, offsets, tolerance)
        for p, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            assert np.flatnonzero(keep[a:b]).tolist() == one_by_one(x[a:b], y[a:b], tolerance, least[p])
            assert np.flatnonzero(small[a:b]).tolist() == planar.visvalingam(x[a:b], y[a:b], tolerance).tolist()
