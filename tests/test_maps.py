"""Phase maps, cosine transforms, hulls and lag filters against numpy, planted shapes and known values."""

import math

import numpy as np
import pandas as pd
import pytest

from weirflow.operators import cosine, hull, lagmodel, phasemap


def grid(spark, frames):
    return spark.createDataFrame([(f, r, c, float(v)) for f, a in frames.items() for (r, c), v in np.ndenumerate(a)], "frame string, row long, col long, value double")


def back(df, frame):
    rows = df.where(df.frame == frame).toPandas()
    out = np.full((rows["row"].max() + 1, rows["col"].max() + 1), np.nan)
    out[rows["row"], rows["col"]] = rows["value"]
    return out


def vortices(shape, places):
    y, x = np.mgrid[: shape[0], : shape[1]].astype(float)
    return sum(s * np.angle((x - b) + 1j * (y - a)) for a, b, s in places) if places else np.zeros(shape)


def test_rotations_are_found_where_they_were_planted(spark):
    places = {"pair": [(3.3, 4.6, 1), (8.7, 9.2, -1)], "one": [(5.25, 5.5, -1)], "none": []}
    df = grid(spark, {f: vortices((13, 14), p) + 0.02 * np.arange(14) for f, p in places.items()})
    got = phasemap.critical_points(df, by=["frame"]).collect()
    for frame, planted in places.items():
        found = [(r.y, r.x, 1 if r.kind == "clockwise" else -1) for r in got if r.frame == frame and "wise" in r.kind]
        assert len(found) == len(planted)
        for y, x, s in planted:
            assert any(math.hypot(y - a, x - b) < 0.25 and s == t for a, b, t in found)


def test_extrema_and_saddles(spark):
    y, x = np.mgrid[:11, :11] - 5.0
    wave = {"maximum": -0.02 * (x**2 + y**2), "minimum": 0.02 * (x**2 + y**2), "saddle": 0.02 * (x**2 - y**2)}
    got = phasemap.critical_points(grid(spark, wave), by=["frame"]).collect()
    for kind in wave:
        here = [r for r in got if r.frame == kind]
        assert {r.kind for r in here} == {kind} and all(abs(r.y - 5) <= 1 and abs(r.x - 5) <= 1 for r in here)
    one = phasemap.merged(phasemap.critical_points(grid(spark, wave), by=["frame"]), 2.0, ["frame"]).collect()
    assert len(one) == 3 and all(abs(r.y - 5) <= 1 and abs(r.x - 5) <= 1 for r in one)
    assert phasemap.critical_points(grid(spark, wave), by=["frame"], edge=6).collect() == []


def test_missing_pixels_and_merging(spark):
    df = grid(spark, {"f": vortices((8, 8), [(3.5, 3.5, 1)])})
    holes = df.where("not (row = 3 and col = 3)")
    assert phasemap.winding(phasemap.cells(holes, by=["frame"])).where("winding != 0").count() == 0
    assert phasemap.winding(phasemap.cells(df, by=["frame"])).where("winding != 0").count() == 1
    points = spark.createDataFrame([("a", "k", 0.0, float(i)) for i in range(6)] + [("a", "k", 0.0, 9.0), ("b", "k", 0.0, 0.5), ("a", "other", 0.0, 0.5), ("a", "k", 0.0, 9.0)], "frame string, kind string, y double, x double")
    got = sorted((r.frame, r.kind, r.x, r.n) for r in phasemap.merged(points, 1.5, ["frame"]).collect())
    assert got == [("a", "k", 2.5, 6), ("a", "k", 9.0, 1), ("a", "other", 0.5, 1), ("b", "k", 0.5, 1)]


def matrix(n):
    k, i = np.mgrid[:n, :n]
    return np.sqrt(np.where(k == 0, 1, 2) / n) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))


def test_cosine_transforms(spark):
    rng = np.random.default_rng(1)
    frames = {"a": rng.normal(size=(6, 9)), "b": rng.normal(size=(4, 5)), "line": rng.normal(size=(1, 7))}
    df = grid(spark, frames)
    for f, a in frames.items():
        c, d = matrix(a.shape[0]), matrix(a.shape[1])
        assert np.allclose(back(cosine.transform(df, ["frame"]), f), c @ a @ d.T)
        # the mirrored grid's Fourier transform, cut by a circle
        kr, kc = np.abs(np.fft.fftfreq(2 * a.shape[0])), np.abs(np.fft.fftfreq(2 * a.shape[1]))
        mirror = np.block([[a, a[:, ::-1]], [a[::-1], a[::-1, ::-1]]])
        cut = np.fft.ifft2(np.fft.fft2(mirror) * (np.hypot(kr[:, None], kc[None]) <= 1 / 2.9)).real[: a.shape[0], : a.shape[1]]
        assert np.allclose(back(cosine.low_pass(df, 2.9, fine=1, by=["frame"]), f), cut)
        up = back(cosine.up_sample(df, 3, ["frame"]), f)
        assert up.shape == tuple((n - 1) * 3 + 1 for n in a.shape) and np.allclose(up[::3, ::3], a)
    smooth = grid(spark, {"c": np.add.outer(np.cos(np.pi * np.arange(9) / 8), np.cos(np.pi * 2 * np.arange(5) / 4))})
    assert np.allclose(back(cosine.up_sample(smooth, 4, ["frame"]), "c"), np.add.outer(np.cos(np.pi * np.arange(33) / 32), np.cos(np.pi * 2 * np.arange(17) / 16)))


def test_softened_cut_and_compact_form(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(8, 10))
    df = grid(spark, {"a": a})
    offsets = (np.arange(7) - 3) / 7
    mask = np.array([[np.mean([[np.hypot((r + p) / 16, (c + q) / 20) <= 1 / 4.0 for q in offsets] for p in offsets]) for c in range(10)] for r in range(8)])
    c, d = matrix(8), matrix(10)
    assert np.allclose(back(cosine.low_pass(df, 4.0, by=["frame"]), "a"), c.T @ (mask * (c @ a @ d.T)) @ d)
    small = back(cosine.compact(df, 4.0, by=["frame"]), "a")
    assert small.shape == (5, 6)
    # a wave that fits is the same wave at the places of the fewer samples
    wave = np.cos(np.pi * (2 * np.arange(8) + 1) / 16)[:, None] * np.ones(10)
    few = back(cosine.compact(grid(spark, {"w": wave}), 4.0, by=["frame"]), "w")
    assert np.allclose(few, np.cos(np.pi * (2 * np.arange(5) + 1) / 10)[:, None] * np.ones(6))
    with pytest.raises(ValueError, match="odd"):
        cosine.share(1.0, 1.0, 2)


def test_hulls(spark, monkeypatch):
    """Each hull is convex, has all points on its left and only corners; degenerate sets keep what they have."""
    monkeypatch.setattr(hull, "HELD", 20)
    rng = np.random.default_rng(3)
    data = {"cloud": rng.normal(size=(500, 2)), "grid": np.stack(np.meshgrid(np.arange(5.0), np.arange(4.0)), -1).reshape(-1, 2), "line": np.array([[i, 2 * i] for i in range(6)], float), "twice": np.ones((3, 2)), "one": np.array([[2.0, 3.0]])}
    df = spark.createDataFrame([(s, float(x), float(y)) for s, p in data.items() for x, y in p] + [("cloud", None, 1.0)], "s string, x double, y double").repartition(7)
    made = hull.hulls(df, "s")
    found = {s: g.sort_values("i")[["x", "y"]].to_numpy() for s, g in made.toPandas().groupby("s")}
    cross = lambda a, b, p: (b - a)[0] * (p - a)[..., 1] - (b - a)[1] * (p - a)[..., 0]
    p = found["cloud"]
    for a, b in zip(p, np.roll(p, -1, axis=0), strict=True):
        assert (cross(a, b, data["cloud"]) >= -1e-12).all() and (cross(a, b, p[~((p == a).all(1) | (p == b).all(1))]) > 0).all()
    assert found["grid"].tolist() == [[0, 0], [4, 0], [4, 3], [0, 3]] and found["line"].tolist() == [[0, 0], [5, 10]]
    assert found["twice"].tolist() == [[1, 1]] and found["one"].tolist() == [[2, 3]]
    square = made.where("s = 'grid'")
    ring = hull.resampled(square, "s", 8).orderBy("i").toPandas()
    r, angle = np.hypot(ring["x"] - 2, ring["y"] - 1.5), np.arctan2(ring["y"] - 1.5, ring["x"] - 2)
    assert np.allclose(r, 2.5) and np.allclose(np.sort(np.mod(angle, 2 * np.pi)), np.arange(8) * np.pi / 4, atol=1e-9)
    assert hull.resampled(made, "s", 36, 30.0).count() == 36 * 5
    with pytest.raises(ValueError, match="angles"):
        hull.resampled(square, "s", 3)


def signals(seed, sizes, filters, noise=0.0, dense=False):
    """Series of several channels, and what filters make of them: (frame, {trial: (x, y)})."""
    rng, rows, kept = np.random.default_rng(seed), [], {}
    for trial, (start, n) in sizes.items():
        x = rng.normal(size=(len(filters), n)) if dense else (rng.random((len(filters), n)) < 0.1).astype(float)
        first = -2
        y = 5 + noise * rng.normal(size=n)
        for xi, h in zip(x, filters, strict=True):
            full = np.convolve(xi, h)
            y += np.pad(full, (4, 4))[4 - first : 4 - first + n]
        rows += [(trial, f"c{k}", start + t, float(v)) for k, xi in enumerate(x) for t, v in enumerate(xi) if v] + [(trial, "y", start + t, float(v)) for t, v in enumerate(y)]
        kept[trial] = x, y
    return pd.DataFrame(rows, columns=["trial", "channel", "t", "value"]), kept


FILTERS = np.array([[0.5, 1.0, -0.5, 0.25], [0.0, -1.0, 0.75, 0.0]])


@pytest.mark.parametrize("length", [8, 37, 4096])
def test_lag_products_of_chunks(spark, length):
    frame, kept = signals(1, {"a": (3, 200), "b": (-50, 90)}, FILTERS)
    df = spark.createDataFrame(frame).repartition(5)
    means = lagmodel.channel_means(df, ["c0", "c1", "y"])
    every = {t: np.vstack([x, y]) for t, (x, y) in kept.items()}
    assert np.allclose(means, np.hstack(list(every.values())).mean(axis=1))
    got = lagmodel.lag_products(df, ["c0", "c1", "y"], 5, means, length)
    for d in range(6):
        want = sum((z - means[:, None])[:, : z.shape[1] - d] @ (z - means[:, None])[:, d:].T for z in every.values())
        assert np.allclose(got[:, :, d], want)


def test_filters_are_recovered_and_applied(spark):
    frame, kept = signals(2, {"a": (0, 3000), "b": (7, 2500), "silent": (0, 40)}, FILTERS)
    frame = frame[(frame["trial"] != "silent") | (frame["channel"] == "y")]
    df = spark.createDataFrame(frame)
    model = lagmodel.fit(df.where("trial != 'silent'"), "y", -2, 1)
    assert model.inputs == ("c0", "c1") and np.allclose(model.weights, FILTERS, atol=0.02)
    wide = lagmodel.fit(df.where("trial != 'silent'"), "y", -4, 3)
    assert np.allclose(wide.weights[:, 2:6], FILTERS, atol=0.03) and np.abs(wide.weights[:, [0, 1, 6, 7]]).max() < 0.03
    fitted = {n: lagmodel.apply(df, model, n).toPandas() for n in (4, 50, 100000)}
    for n, rows in fitted.items():
        rows = rows.set_index(["trial", "t"])["fitted"].sort_index()
        assert np.allclose(rows, fitted[50].set_index(["trial", "t"])["fitted"].sort_index()), n
        assert len(rows) == 5540 and np.abs(rows["a"].to_numpy() - kept["a"][1])[5:-5].max() < 0.2
    x, _ = kept["a"]
    means = model.means[:, None]
    whole = model.target_mean + sum(np.pad(np.convolve(z, h), 4)[6 : 6 + 3000] for z, h in zip(x - means, model.weights, strict=True))
    assert np.allclose(fitted[4][fitted[4]["trial"] == "a"].sort_values("t")["fitted"], whole)


def test_spectral_filters(spark):
    frame, kept = signals(3, {"a": (0, 6000)}, FILTERS, noise=0.1, dense=True)
    model = lagmodel.spectral_fit(spark.createDataFrame(frame), "y", 64)
    assert model.first == -32 and np.allclose(model.weights[:, 30:34], FILTERS, atol=0.05)
    assert np.abs(np.delete(model.weights, range(30, 34), axis=1)).max() < 0.05
    made = lagmodel.apply(spark.createDataFrame(frame), model).orderBy("t").toPandas()["fitted"].to_numpy()
    assert np.std(made - kept["a"][1]) < 0.2 * np.std(kept["a"][1])


def test_filters_need_channels(spark):
    df = spark.createDataFrame([("a", "y", 0, 1.0)], "trial string, channel string, t long, value double")
    with pytest.raises(ValueError, match="input"):
        lagmodel.fit(df, "y", 0, 1)
    with pytest.raises(ValueError, match="no lag"):
        lagmodel.fit(df, "y", 1, 0)
