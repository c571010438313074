"""The evaluation run against a plain loop over points."""

import numpy as np
import pytest

from gridloom.operators import evaluation
from gridloom.operators.detectors import detect
from gridloom.sources import readers, writers


def brute(points, sizes, h, radius, n_curve, n_ap, n_cover):
    """Precision, coverage and repeatability curve of one pair from lists of (x, y, response)."""
    one, two = (sorted(p, key=lambda r: (-r[2], r[0], r[1])) for p in points)
    put = lambda m, p: tuple((m @ [p[0], p[1], 1])[:2] / (m @ [p[0], p[1], 1])[2])
    ok = lambda p, s: 0 <= p[0] <= s[0] and 0 <= p[1] <= s[1]
    m, back = np.array(h, dtype=float).reshape(3, 3), np.linalg.inv(np.array(h, dtype=float).reshape(3, 3))
    a = [(p[:2], put(m, p)) for p in one if ok(put(m, p), sizes[1])]
    b = [(p[:2], put(back, p)) for p in two if ok(put(back, p), sizes[0])]
    near = lambda p, q: (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= radius**2
    hits, precision = 0, []
    for i, (p, _) in enumerate(a):
        j = next((j for j, (_, q) in enumerate(b) if near(p, q)), None)
        if j is not None and j <= i:
            hits += 1
            precision.append(hits / (i + 1))
    ap = sum(precision[:n_ap]) / n_ap if len(precision) >= n_ap else 0.0
    c = two[:n_cover]
    cover = None
    if len(c) == n_cover:
        inv = sum(sum(1 / np.hypot(p[0] - q[0], p[1] - q[1]) for q in c if q is not p) / (n_cover - 1) for p in c)
        cover = n_cover / inv
    curve = []
    for k in range(1, min(n_curve, len(a), len(b)) + 1):
        r1 = sum(any(near(p, q) for _, q in b[:k]) for p, _ in a[:k])
        r2 = sum(any(near(p, q) for _, q in a[:k]) for p, _ in b[:k])
        curve.append((r1 + r2) / 2 / k)
    return ap, cover, curve


@pytest.mark.parametrize("kind", ["vgg", "webcam"])
def test_evaluation_of_a_folder(spark, tmp_path, kind):
    rng = np.random.default_rng(4)
    shift = {2: [1, 0, 4, 0, 1, -3, 0, 0, 1], 3: [1.02, 0.01, -3, -0.015, 0.99, 4, 1e-5, 2e-5, 1]}
    if kind == "webcam":
        shift = {2: [1, 0, 0, 0, 1, 0, 0, 0, 1], 3: [1, 0, 0, 0, 1, 0, 0, 0, 1]}
    for scene in ("graf", "wall"):
        folder = tmp_path / scene
        folder.mkdir()
        base = np.kron(rng.integers(0, 255, (8, 9)), np.ones((6, 6)))
        for number in (1, 2, 3):
            picture = np.roll(base, (3 * (number - 1), -4 * (number - 1)), (0, 1)) if number == 2 else base + rng.integers(0, 9, base.shape)
            (folder / f"img{number}.pgm").write_bytes(writers.encode_pgm(np.clip(picture, 0, 255)))
        if kind == "webcam":
            (folder / "H").write_text("1 0 0\n0 1 0\n0 0 1\n")
        elif scene == "graf":
            for number, h in shift.items():
                (folder / f"H1to{number}p").write_text(" ".join(map(str, h[:3])) + "\n" + " ".join(map(str, h[3:6])) + "\n" + " ".join(map(str, h[6:])) + "\n")
    sizes = {"curve_points": 12, "precision_points": 2, "coverage_points": 6, "radius": 5.0}
    got = evaluation.evaluate_folder(spark, str(tmp_path), "harris", kind, **sizes)
    found = {}
    for r in detect(readers.read_images(spark, str(tmp_path), "*.pgm"), "harris", 8).collect():
        found.setdefault(tuple(r.image_id.split("/")[-2:]), []).append((r.x, r.y, r.response))
    metrics = {(r.scene, r.pair_no): r for r in got.pairs.collect()}
    curves = {}
    for r in got.curves.collect():
        curves.setdefault((r.scene, r.pair_no), {})[r.k] = r.repeated
    assert set(metrics) == {(s, n) for s in ("graf", "wall") for n in (1, 2)} and "matched" not in got.curves.columns
    aps, total = {}, []
    for (scene, pair), m in metrics.items():
        ap, cover, curve = brute([found[scene, "img1.pgm"], found[scene, f"img{pair + 1}.pgm"]], [(54, 48), (54, 48)], shift[pair + 1], 5.0, 12, 2, 6)
        assert m.coverage is None if cover is None else abs(m.coverage - cover) < 1e-9
        if kind == "vgg" and scene == "wall":  # no homographies
            assert m.ap is None and (scene, pair) not in curves
            total.append(0.0)
            continue
        assert abs(m.ap - ap) < 1e-9 and len(curve) > 3
        assert all(abs(curves[scene, pair][k + 1] - v) < 1e-9 for k, v in enumerate(curve)), (scene, pair)
        aps.setdefault(scene, []).append(ap)
        total.append(ap)
    assert max(total) > 0
    whole = got.overall.first()
    assert whole.pairs == 4 and whole.failed == (2 if kind == "vgg" else 0) and abs(whole.map - sum(total) / 4) < 1e-9
    summary = {r.scene: r.map for r in got.summary.collect()}
    assert all(abs(summary[s] - sum(v) / 2) < 1e-9 for s, v in aps.items()) and "Total" in summary
    assert got.mean_curve.count() == 12 and got.scene_curves.select("scene").distinct().count() == len(aps)
