"""Diagnostic files: round trip with an encoder, pieces, conversion and counts."""

import numpy as np
import pytest

from nimbogrid.sources import diag


def groups(rng):
    out = []
    for kind, n, width in ((" uv", 40, 23), ("  t", 25, 20), ("  q", 1, 19), (" ps", 12, 19), ("gps", 5, 30), ("  t", 0, 19)):
        a = rng.normal(size=(n, width)).astype("f4")
        if n:
            a[:, 0] = rng.choice([120, 222, 181, 170, 290, 999, 240], n)
            a[:, 8] = rng.choice([0, 1, 2, 3, -1], n)
            a[:, 15] = rng.choice([0.5, 2.0, 0.0, 1e-8], n)
        out.append((kind, [f"S{k}" for k in range(n)], a))
    return out


@pytest.mark.parametrize("endian", "<>")
def test_round_trip_in_pieces(spark, tmp_path, endian):
    g = groups(np.random.default_rng(1))
    (tmp_path / "d.bin").write_bytes(diag.encode(2021073006, g, endian))
    path = str(tmp_path / "d.bin")
    want = [(n, k, kind, names[k], a[k].tolist()) for n, (kind, names, a) in enumerate(g) for k in range(len(names))]
    for d in (diag.read_diag(spark, path, endian), diag.read_diag(spark, path, endian, split=200, rows_at_once=3)):
        got = d.collect()
        assert sorted((r["group"], r["nth"], r["kind"], r["station"], r["numbers"]) for r in got) == sorted(want) and {r["date"] for r in got} == {2021073006}
    assert diag.read_diag(spark, path, endian, split=200).rdd.getNumPartitions() > 5


def test_observations_and_counts(spark, tmp_path):
    g = groups(np.random.default_rng(2))
    (tmp_path / "d.bin").write_bytes(diag.encode(1, g))
    obs = diag.diag_observations(diag.read_diag(spark, str(tmp_path / "d.bin")))
    number = {120: (1, True), 222: (1, False), 181: (8, True), 170: (14, False), 290: (20, True), 999: (diag.OTHER, True), 240: (4, False)}
    want, counts = {}, {}
    for n, (kind, names, a) in enumerate(g):
        elements = {" uv": [(2819, 17, 18), (2820, 20, 21)], "  t": [(3073, 17, 18)], "  q": [(3330, 17, 18)], " ps": [(14593, 17, 18)]}.get(kind, [])
        for k in range(len(names)):
            x = a[k].astype(float)
            typ, used = number[int(x[0])]
            used = used and x[15] >= 1e-7 and 0 <= x[8] <= 2
            for elm, v, dep in elements:
                hx = (x[v - 1] - x[dep - 1]) * (100 if kind == " ps" else 1)
                want[n, k, elm] = (x[3], x[2], x[4] if kind == " ps" else x[5], x[v - 1], 1 / x[15] if x[15] >= 1e-7 else 1e10, typ, x[7], hx, bool(used))
                c = counts.setdefault((elm, typ), [0, 0])
                c[0], c[1] = c[0] + 1, c[1] + bool(used)
    got = {(r["group"], r["nth"], r["elm"]): tuple(r[c] for c in ("lon", "lat", "lev", "dat", "err", "typ", "dif", "hx", "used")) for r in obs.collect()}
    assert set(got) == set(want) and all(got[c] == pytest.approx(want[c]) for c in want)
    assert {(r["elm"], r["typ"]): [r["n_all"], r["n_used"]] for r in diag.diag_counts(obs).collect()} == counts


def test_broken_files_are_errors(spark, tmp_path):
    (tmp_path / "d.bin").write_bytes(diag.encode(1, groups(np.random.default_rng(3)))[:-9])
    with pytest.raises(Exception, match="ends at byte|broken body|no header"):
        diag.read_diag(spark, str(tmp_path / "d.bin")).collect()
