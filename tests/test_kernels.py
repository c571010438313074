"""Kernels and expressions against worked examples, brute force and round trips."""

import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.operators import bytes as strings
from gridloom.operators import arithmetic, codecs, components, distance, lanes, marching, match, raster, signal, stencil, trace
from gridloom.sources import readers, writers


def line(spark, values, schema="image_id string, x int, y int, v double"):
    return spark.createDataFrame([("a", i, 0, float(v)) for i, v in enumerate(values)], schema)


def values(df):
    return [r.v for r in sorted(df.collect(), key=lambda r: (r.y, r.x))]


def test_worked_examples(spark):
    r = line(spark, [0, 5, 9])
    assert values(raster.threshold(r, 5)) == [255, 0, 0] and values(raster.threshold_inverse(r, 5)) == [0, 255, 255]
    levels = spark.createDataFrame([("a", 2), ("a", 6)], "image_id string, level int")
    assert values(raster.snap_levels(line(spark, [0, 4, 5, 9]), levels)) == [2, 2, 6, 6]
    flags = spark.createDataFrame([(0, True), (1, False), (2, True)], "i int, repeated boolean").withColumn("s", F.lit(1))
    assert math.isclose(match.average_precision(flags, 2, ["s"]).first().ap, (1 + 2 / 3) / 2)
    assert match.average_precision(flags, 3, ["s"]).first().ap == 0
    two = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0)], "s int, i int, x double, y double")
    assert math.isclose(match.coverage(two, 2, ["s"]).first().coverage, 5) and match.coverage(two, 3, ["s"]).first().coverage is None
    assert codecs.rle_encode(b"AAAAB") == bytes([0, 0, 3, 65, 66])
    assert signal.persistence([1, 3, 2, 4]) == ([(2, 1, 1)], 0)
    got = spark.range(1).select(scalar.adler32(F.array(F.lit(97), F.lit(98), F.lit(99))), scalar.buffer_size(F.lit(512), F.lit(1)), scalar.buffer_size(F.lit(500), F.lit(1)), scalar.wrap_distance(F.lit(7), F.lit(10))).first()
    assert tuple(got) == (0x024D0127, 1024, 512, 3)


def test_suppression_modes(spark):
    at = lambda v, mode: [r.x for r in sorted(stencil.suppress(line(spark, v), 3, 1, mode).collect(), key=lambda r: r.x)]
    assert at([5, 3, 5], "reference") == [0, 2]
    assert at([5, 3], "reference") == [0, 1] and at([5, 3], "strict") == [0]


def test_homography_inverse(spark):
    h = [1.02, 0.01, -3, -0.015, 0.99, 4, 0.00001, 0.00002, 1]
    x, y = scalar.project(h, F.lit(12.5), F.lit(-7.0))
    df = spark.range(1).select(x.alias("x"), y.alias("y"))
    bx, by = scalar.project(scalar.inverse_homography(h), F.col("x"), F.col("y"))
    r = df.select(bx, by).first()
    assert math.isclose(r[0], 12.5, abs_tol=1e-9) and math.isclose(r[1], -7, abs_tol=1e-9)


@given(st.integers(0, 2**31), st.integers(1, 12), st.integers(1, 12), st.booleans())
@settings(max_examples=60, deadline=None)
def test_labels_equal_flood_fill(seed, ny, nx, eight):
    a = np.random.default_rng(seed).integers(0, 3, (ny, nx))
    got = components.label_array(a, eight)
    want, n = np.full((ny, nx), -1), 0
    for y in range(ny):
        for x in range(nx):
            if want[y, x] < 0:
                todo, want[y, x] = [(y, x)], n
                while todo:
                    p, q = todo.pop()
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            u, v = p + dy, q + dx
                            if (eight or dx == 0 or dy == 0) and 0 <= u < ny and 0 <= v < nx and want[u, v] < 0 and a[u, v] == a[p, q]:
                                want[u, v] = n
                                todo.append((u, v))
                n += 1
    assert (got == want).all()


@given(st.integers(0, 2**31), st.integers(2, 10), st.integers(2, 10))
@settings(max_examples=40, deadline=None)
def test_islands_by_distinct_levels_equal_all_levels(seed, ny, nx):
    a = np.random.default_rng(seed).choice([0, 3, 90, 200, 255], (ny, nx)).astype(float)
    want = np.zeros_like(a)
    for level in range(255):
        fg = a >= level
        lab = components.label_array(fg)
        kept = np.where((np.bincount(lab.ravel()) >= 0.1 * a.size)[lab], fg, ~fg)
        want[kept] = np.maximum(want[kept], level)
    assert (components.without_islands(a, 10) == want).all()


@given(st.integers(0, 2**31), st.integers(1, 9), st.integers(1, 9))
@settings(max_examples=40, deadline=None)
def test_nearest_sites(seed, ny, nx):
    sites = np.random.default_rng(seed).random((ny, nx)) < 0.3
    sites[0, 0] = True
    d2, sx, sy = trace.nearest(sites)
    ys, xs = np.nonzero(sites)
    for y in range(ny):
        for x in range(nx):
            assert d2[y, x] == ((ys - y) ** 2 + (xs - x) ** 2).min() == (sx[y, x] - x) ** 2 + (sy[y, x] - y) ** 2 and sites[sy[y, x], sx[y, x]]


def test_nearest_site_query_equals_kernel(spark):
    fg = np.random.default_rng(3).random((14, 9)) < 0.6
    rows = [("a", 1, x, y, bool(fg[y, x])) for y in range(14) for x in range(9)]
    got = distance.nearest_site(distance.boundary(spark.createDataFrame(rows, "image_id string, level int, x int, y int, fg boolean"))).collect()
    d2, _, _ = trace.nearest(trace.edge_pixels(fg))
    assert all(r.d2 == d2[r.y, r.x] for r in got)


def test_arc_lengths_go_round():
    fg = np.zeros((9, 9), dtype=bool)
    fg[2:7, 2:7] = True
    lengths, most = trace.arc_lengths(fg)
    assert (lengths > 0).sum() == 16 and lengths[lengths > 0].min() == 1 and 8 <= most <= 16
    both = np.zeros((9, 20), dtype=bool)
    both[2:7, 2:7] = both[2:7, 12:17] = True
    assert trace.arc_lengths(both)[1] > 1000


def test_trace_of_drawn_skeletons():
    plus = np.zeros((15, 15), dtype=bool)
    plus[7, 2:13] = plus[2:13, 7] = True
    ends, edges = trace.trace(plus, [(2, 7)])
    assert {(x, y) for kind, x, y, _ in ends if kind == 1} == {(12, 7), (7, 2), (7, 12)} and any(kind == 0 for kind, *_ in ends)
    stick = np.zeros((5, 20), dtype=bool)
    stick[2, 3:17] = True
    ends, _ = trace.trace(stick, [(10, 2)])
    assert {(x, y) for kind, x, y, _ in ends if kind == 1} == {(3, 2), (16, 2)}


def test_persistence_properties():
    rng = random.Random(5)
    for _ in range(50):
        v = [rng.randrange(12) for _ in range(rng.randrange(1, 40))]
        pairs, low = signal.persistence(v)
        assert v[low] == min(v) and low == v.index(min(v))
        mins, maxs = [p[0] for p in pairs], [p[1] for p in pairs]
        assert len(set(mins)) == len(mins) and len(set(maxs)) == len(maxs) and not set(mins) & set(maxs) and low not in mins
        assert all(v[b] - v[a] == p >= 0 for a, b, p in pairs) and [p[2] for p in pairs] == sorted(p[2] for p in pairs)
    assert signal.persistence([]) == ([], -1)


def test_peaks():
    v = [0, 3, 1, 5, 0, 0, 4, 0]
    assert signal.peaks(v, 2.5) == [3, 6] and signal.peaks(v, 1.5) == [1, 3, 6]
    assert len(signal.peaks_of_count([math.sin(i / 5) for i in range(200)], 6)) == 6
    assert signal.layers_by_drop([1.0, 0.9, 0.5, 0.45, 0.1], 0.3, 2) == [2, 4]


def zigzag(v, delta, up):
    """Maxima of the zigzag from its definition: a leg ends at its first extremum once a later sample is more than delta away from it."""
    out, at = [], 0
    while True:
        sign = 1 if up else -1
        end = next((i for i in range(at, len(v)) if sign * v[i] < max(sign * x for x in v[at : i + 1]) - delta), None)
        if end is None:
            return out
        leg = [sign * x for x in v[at : end + 1]]
        at += leg.index(max(leg))
        out += [at] if up else []
        up = not up


@given(v=st.lists(st.integers(0, 12), max_size=200), delta=st.sampled_from([0.0, 0.5, 1.0, 3.0, 7.5]), up=st.booleans())
@settings(max_examples=300, deadline=None)
def test_peaks_are_the_maxima_of_a_zigzag(v, delta, up):
    assert signal.peaks(v, delta, up) == zigzag(v, delta, up)
    assert signal.peaks(v * 7, delta, up) == zigzag(v * 7, delta, up)


@given(data=st.binary(max_size=120), longest=st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_runs_and_rice_words(data, longest):
    data = bytes(b % 3 for b in data)
    want, at = [], 0
    for byte, group in itertools.groupby(data):
        n = len(list(group))
        while n:
            want.append((at, byte, min(n, longest)))
            at, n = at + min(n, longest), n - min(n, longest)
    a = np.frombuffer(data, dtype=np.uint8)
    assert list(zip(*(x.tolist() for x in strings.run_table(a, longest)), strict=True)) == want
    nbits, k = strings.rice_words(a, 4)
    bits = [b.bit_length() for b in data]
    start = max(1, (sum(bits[:4]) + min(4, len(data)) // 2) // max(1, min(4, len(data))))
    assert nbits.tolist() == bits and k.tolist() == [start if i < 4 else (sum(bits[i - 4 : i]) + 2) // 4 for i in range(len(data))]


def test_byte_strings(spark):
    rows = [(1, bytearray(b"aaab\x00")), (2, bytearray(b"")), (3, None), (4, bytearray(range(256)) * 3)]
    df = spark.createDataFrame(rows, "doc_id long, data binary")
    hist = {}
    for r in strings.histogram(df).collect():
        hist.setdefault(r.doc_id, {})[r.byte] = r.n
    assert all(len(h) == 256 and h == {b: bytes(d or b"").count(b) for b in range(256)} for (_, d), h in zip(rows, [hist[i] for i in (1, 2, 3, 4)], strict=True))
    assert {(r.doc_id, r.start, r.byte, r.length) for r in strings.runs(df).filter("doc_id < 4").collect()} == {(1, 0, 97, 3), (1, 3, 98, 1), (1, 4, 0, 1)}
    assert {r.doc_id: r.byte for r in strings.least_common(df).collect()} == {1: 1, 2: 0, 3: 0, 4: 0}
    assert {r.doc_id: r.adler for r in strings.adler32(df).collect()} == {i: zlib.adler32(bytes(d or b"")) for i, d in rows}
    assert abs({r.doc_id: r.entropy for r in strings.entropy(df).collect()}[4] - 8) < 1e-9
    assert strings.rice_parameters(df).count() == 5 + 768


@pytest.mark.parametrize("name", sorted(codecs.CODECS))
@given(data=st.binary(max_size=300))
@settings(max_examples=25, deadline=None)
def test_codecs_round_trip(name, data):
    encode, decode = codecs.CODECS[name]
    for d in (data, data * 3, b"\0" * len(data)):
        assert decode(encode(d)) == d


@given(symbols=st.lists(st.integers(0, 6), max_size=300), bits=st.lists(st.tuples(st.integers(0, 2**40), st.integers(0, 40)), max_size=40))
@settings(max_examples=60, deadline=None)
def test_arithmetic_models_and_raw_bits(symbols, bits):
    models = lambda: [arithmetic.StaticSymbols([5, 1, 0.001, 2, 0, 1, 1]), arithmetic.AdaptiveSymbols(7, 900), arithmetic.StaticBit(0.99), arithmetic.AdaptiveBit()]
    coder = arithmetic.Encoder()
    for s in symbols:
        for m in (used := models())[:2]:
            coder.symbol(m, s)
    used = models()
    for s in symbols:
        coder.symbol(used[1], s)
        coder.symbol(used[2], s & 1)
        coder.symbol(used[3], s & 1)
    for value, n in bits:
        coder.raw(value, n)
    back = arithmetic.Decoder(coder.finish())
    for s in symbols:
        for m in models()[:2]:
            assert back.symbol(m) == s
    used = models()
    for s in symbols:
        assert (back.symbol(used[1]), back.symbol(used[2]), back.symbol(used[3])) == (s, s & 1, s & 1)
    assert [back.raw(n) for _, n in bits] == [value & (1 << n) - 1 for value, n in bits]


@pytest.mark.parametrize("eight", [True, False])
def test_sparse_components_within_and_across_tiles(spark, eight, monkeypatch):
    monkeypatch.setattr(components, "TILE_BITS", 3)
    rng = np.random.default_rng(3)
    a = rng.integers(0, 3, (37, 45))
    a[20, :] = 1  # one long line through many tiles
    lab = components.label_array(a, eight)
    first = {}
    for (y, x), c in np.ndenumerate(lab):
        first.setdefault(c, (y - 13) * 1048576 + x - 9)
    rows = [("a", x - 9, y - 13, float(v)) for (y, x), v in np.ndenumerate(a) if v]  # also left of and above 0
    points = spark.createDataFrame([*rows, rows[0], ("b", 5, 5, 2.0), ("b", 6, 5, 1.0), ("b", 5, 5, 1.0), ("b", 0, 0, None)], "image_id string, x int, y int, v double")
    got = components.propagate(points, eight)
    assert got.dtypes == [("image_id", "string"), ("x", "int"), ("y", "int"), ("v", "double"), ("component", "bigint")]
    want = [("a", x, y, v, first[lab[y + 13, x + 9]]) for _, x, y, v in [*rows, rows[0]]]
    want += [("b", 5, 5, 2.0, 5 * 1048576 + 5), ("b", 6, 5, 1.0, 5 * 1048576 + 5), ("b", 5, 5, 1.0, 5 * 1048576 + 5)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_sparse_components_take_no_round_per_pixel(spark, monkeypatch):
    rounds, durable = [], components.durable
    monkeypatch.setattr(components, "durable", lambda df: rounds.append(1) or durable(df))
    line = spark.range(40).select(F.lit("a").alias("image_id"), F.col("id").cast("int").alias("x"), F.lit(0).alias("y"), F.lit(1.0).alias("v"))
    assert {r.component for r in components.propagate(line).collect()} == {0} and len(rounds) <= 3


def many_strings(n, size):
    rng = random.Random(size)
    words = [bytes(rng.choices(range(97, 123), k=rng.randrange(2, 9))) for _ in range(300)]
    return [b" ".join(rng.choices(words, k=rng.randrange(size // 3))) for _ in range(n)]


@pytest.mark.parametrize("codec", sorted(codecs.BATCHES))
def test_strings_coded_together(codec, monkeypatch):
    monkeypatch.setattr(lanes, "BYTES", 40_000)
    encode, decode = codecs.CODECS[codec]
    rng = random.Random(7)
    odd = [b"", None, b"a", b"\0" * 6000, b"\xff" * 5000, bytes(range(256)) * 20, rng.randbytes(7000), b"ab" * 4000, b"a" * 3000 + b"b" * 3000]
    data = odd * 2 + many_strings(60, 300) + [rng.randbytes(rng.randrange(40)) for _ in range(60)]
    rng.shuffle(data)
    codes = codecs.code_all(data, codec, 0)
    assert codes == [None if b is None else encode(b) for b in data]
    assert codecs.code_all(codes, codec, 1) == data
    run, back, size, _ = codecs.BATCHES[codec]
    pairs = sorted(((b, c) for b, c in zip(data, codes, strict=True) if b is not None), key=lambda p: -len(p[0]))
    assert run([b for b, _ in pairs]) == [c for _, c in pairs]  # the longest too, in lanes
    assert back([c for _, c in pairs]) == [b for b, _ in pairs] and all(size(c) == len(b) for b, c in pairs)
    with_cut = [c and c[:-1] for c in codes]
    try:
        want = [None if c is None else decode(c) for c in with_cut]
    except ValueError:
        want = None
    if want is None:
        with pytest.raises(ValueError):
            codecs.code_all(with_cut, codec, 1)
    else:
        assert codecs.code_all(with_cut, codec, 1) == want


def cpu_seconds(codec, data):
    codecs.code_all(data[:2], codec, 0)
    began = time.process_time()
    assert codecs.code_all(codecs.code_all(data, codec, 0), codec, 1) == data
    return time.process_time() - began


# one by one: 50e-6 a byte for bits, 14e-6 to 23e-6 for the others
@pytest.mark.parametrize(("codec", "seconds"), [("arithmetic_bits", 6e-6), ("arithmetic", 4e-6), ("arithmetic_context", 4e-6), ("arithmetic_static", 2e-6)])
def test_many_strings_in_time(codec, seconds):
    data = many_strings(5000, 140)
    assert cpu_seconds(codec, data) < seconds * sum(map(len, data)) + 2


def test_codes_of_different_models_are_decoded_together():
    data = many_strings(40, 60)
    codes = [codecs.arithmetic_encode(b, 1 << i % 3) for i, b in enumerate(data)]
    assert codecs.code_all(codes, "arithmetic", 1) == data
    at = sorted(range(len(data)), key=lambda i: -len(data[i]))
    assert lanes.decode_bytes([codes[i] for i in at]) == [data[i] for i in at]


@pytest.mark.parametrize("channels", [1, 2, 3])
def test_wave_files_round_trip(channels):
    rng = np.random.default_rng(channels)
    for frames in (0, 1, 3, 700):
        wave = np.clip(9000 * np.sin(np.arange(frames)[:, None] / (5 + np.arange(channels))) + rng.normal(0, 40, (frames, channels)), -32768, 32767).astype("<i2")
        if frames > 5:
            wave[:4] = [-32768], [32767], [-32768], [0]
        head = b"RIFF" + (36 + wave.nbytes).to_bytes(4, "little") + b"WAVEfmt " + bytes([16, 0, 0, 0, 1, 0]) + channels.to_bytes(2, "little") + bytes(8) + (2 * channels).to_bytes(2, "little") + bytes([16, 0]) + b"data" + wave.nbytes.to_bytes(4, "little")
        data = head + wave.tobytes() + b"x" * (channels * 2 - 1)
        code = codecs.wav_encode(data)
        assert len(head) == 44 and code[0] == 1 and codecs.wav_decode(code) == data
        assert frames < 700 or len(code) < 0.8 * len(data)


@given(st.lists(st.integers(-5000, 5000), max_size=200))
@settings(max_examples=50, deadline=None)
def test_wavelet_is_reversible(x):
    assert codecs.wavelet_inverse(codecs.wavelet_forward(np.array(x, dtype=np.int64))).tolist() == x


def test_arithmetic_detects_damage():
    code = bytearray(codecs.arithmetic_encode(b"some bytes to code" * 5))
    code[20] ^= 255
    with pytest.raises((ValueError, IndexError)):
        codecs.arithmetic_decode(bytes(code))


def test_marching_is_close_to_exact():
    fg = np.zeros((30, 40), dtype=bool)
    fg[4:26, 5:35] = True
    exact = np.sqrt(trace.nearest(trace.edge_pixels(fg))[0])
    for method, tolerance in (("star", 0.01), ("one_point", 0.6), ("averaging", 0.6)):
        d, origin = marching.march(fg, method)
        assert np.abs(d - exact)[fg].max() <= tolerance and (origin[fg] >= 0).all() and (origin[~fg] == -1).all()


def test_decoders(tmp_path, spark):
    a = np.arange(12.0).reshape(3, 4) * 20
    assert (readers.decode_png(writers.encode_png(a)) == a).all() and (readers.decode_pgm(writers.encode_pgm(a)) == a).all()
    assert (readers.decode_pgm(b"P5 # note\n4 3\n# more\n255\n" + bytes(int(v) for v in a.ravel())) == a).all()
    rgb = np.stack([a, a / 2, a * 0], axis=2)
    assert (readers.decode_png(writers.encode_png(rgb)) == np.floor(rgb)).all()
    bmp = b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (3).to_bytes(4, "little") + (2).to_bytes(4, "little") + b"\1\0" + (24).to_bytes(2, "little") + bytes(24)
    bmp += bytes([3, 6, 9] * 3 + [0] * 3 + [30, 60, 90] * 3 + [0] * 3)
    assert readers.decode_bmp(bmp).tolist() == [[6] * 3, [60] * 3]
    wav = bytes(22) + (2).to_bytes(2, "little") + bytes(20) + np.array([1, -1, 2, -2], "<i2").tobytes()
    files = spark.createDataFrame([("w", bytearray(b"RIFF" + wav[4:]))], "path string, content binary")
    assert {(r.series_id, r.idx, r.v) for r in readers.decode_wav(files).collect()} == {("w:0", 0, 1), ("w:0", 1, 2), ("w:1", 0, -1), ("w:1", 1, -2)}
    one = spark.createDataFrame([("img1", bytearray(writers.encode_png(a)))], "image_id string, content binary")
    for target in (str(tmp_path / "plain"), f"file://{tmp_path}/uri"):
        writers.save(one, target, ".png")
        back = readers.read_images(spark, target, "*.png").collect()
        assert len(back) == 12 and sum(r.v for r in back) == a.sum()
    with pytest.raises(Exception, match="nosuch"):
        writers.save(one, "nosuch://host/folder", ".png")


def test_config():
    assert readers.config("# c\na = 1\ngrp = (\nb = %a%x\n)\nhome = %H%\n", {"H": "/h"}) == {"a": "1", "grp.b": "1x", "home": "/h"}


def test_crc_table_has_one_entry_per_byte():
    t = scalar.crc_table()
    assert len(t) == 256 and t[0] == 0 and t[3] == t[1] ^ t[2]
