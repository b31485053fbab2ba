"""Operators on odd inputs, codecs and files, and retrieval against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import physics
from quillstone.operators import kernels as K
from quillstone.operators import neighbours as N
from quillstone.operators import network, raster, rules, signals, texts
from quillstone.sources import images as I
from quillstone.streaming import events as S


def image(spark, array, key=0):
    rows = [(key, y, x, *map(int, p)) for y, line in enumerate(array) for x, p in enumerate(line)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int")


def back(df):
    rows = df.collect()
    out = np.zeros((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1, 3), dtype=int)
    for r in rows:
        out[r["y"], r["x"]] = r["r"], r["g"], r["b"]
    return out


def test_turns_undo_each_other(spark):
    a = np.random.default_rng(0).integers(0, 256, (3, 5, 3))
    px = image(spark, a)
    assert (back(raster.transform(raster.transform(px, "rotate_90"), "rotate_270")) == a).all()
    assert (back(raster.transform(px, "rotate_90")) == np.rot90(a, -1)).all()
    assert (back(raster.auto_orient(px, 6)) == np.rot90(a, -1)).all()


def test_kernels_match_numpy(spark):
    a = np.random.default_rng(1).integers(0, 256, (6, 7, 3))
    k = [[1, 2, 1], [0, 0, 0], [-1, -2, -1]]
    padded = np.pad(a, ((1, 1), (1, 1), (0, 0)), mode="edge")
    want = sum(k[i][j] * padded[i : i + 6, j : j + 7] for i in range(3) for j in range(3))
    assert (back(raster.convolve(image(spark, a), k)) == np.clip(want, 0, 255)).all()


def test_nearest_matches_brute_force_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "QUERY_BLOCK", 5)
    monkeypatch.setattr(N, "MEMORY_BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2], rng.integers(0, 4, 3).tolist()) for i in range(120)]
    memory = spark.createDataFrame(rows, "id long, key string, v array<long>")
    got = {}
    for r in N.nearest(memory.where("id < 20"), memory, 4, 3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["d2"], r["id"])
    for i, key, v in rows[:20]:
        want = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, k, w in rows if k == key and j != i)[:4]
        assert [got[i][n] for n in range(1, 5)] == want


def test_lexical_finds_what_brute_force_finds(spark):
    rng = random.Random(3)
    rows = [(i, "ab"[i % 2], sorted({f"t{rng.randrange(12)}" for _ in range(rng.randrange(1, 7))}), 1000) for i in range(60)] + [(99, "a", [], 1000)]
    memory = spark.createDataFrame(rows, "id long, domain string, tokens array<string>, weight int")
    got = {(r["query_id"], r["id"]) for r in N.lexical(memory, memory, k=100, num=34).collect()}
    want = {(i, j) for i, d, s, _ in rows for j, e, t, _ in rows if i != j and d == e and set(s) & set(t) and len(set(s) & set(t)) * 100 >= 34 * len(set(s) | set(t))}
    assert got == want


def test_hamming_bands_lose_nothing(spark):
    rng = random.Random(4)
    base = [rng.randrange(2**63) for _ in range(20)]
    hashes = [(i, (b ^ sum(1 << k for k in rng.sample(range(63), rng.randrange(6))))) for i, b in enumerate(base * 3)]
    df = spark.createDataFrame(hashes, "id long, hash long")
    got = {(r["query_id"], r["id"]) for r in N.hamming_neighbours(df, df).collect()}
    assert got == {(i, j) for i, a in hashes for j, b in hashes if i != j and (a ^ b).bit_count() <= 3}


def test_network_activations(spark):
    layers = (([[1.0, -1.0], [0.5, 2.0]], [0.0, 1.0], "sigmoid"), ([[2.0, 1.0], [1.0, -3.0]], [0.0, 0.0], "softmax"))
    out = spark.createDataFrame([([0.3, -0.7],)], "x array<double>").select(network.forward(F.col("x"), layers).alias("o")).first()["o"]
    h = 1 / (1 + np.exp(-np.array([0.3 + 0.7, 0.15 - 1.4 + 1.0])))
    z = np.array([2 * h[0] + h[1], h[0] - 3 * h[1]])
    assert np.allclose(out, np.exp(z) / np.exp(z).sum()) and network.parameters(layers) == 12
    with pytest.raises(ValueError):
        network.forward(F.col("x"), (([[1.0]], [0.0, 1.0], "relu"),))


def test_units_refuse_other_dimensions():
    with pytest.raises(ValueError):
        physics.convert(None, "m", "kg")


def test_odd_series(spark):
    s = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 0, 5), (3, 0, -4), (3, 1, 3)], "series int, place int, v long")
    assert {(r["series"], r["verdict"]) for r in signals.easing(signals.progress(s)).collect()} >= {(2, "linear")}
    assert {r["variation"] for r in signals.variation(s).where("series in (1, 3)").collect()} == {0}
    assert signals.holds(s.limit(0)).count() == 0 and signals.period(signals.autocorrelation(s.limit(0), 3)).count() == 0


def test_json_repair(spark):
    raw = ["```json\n{\"k\": 5,}\n```", '{"k": "7"}', '{"k": "x"}', "{}", "none", 'so {"k": 500} there', '{"k": 1.5}', None]
    rows = texts.enforce_int(spark.createDataFrame([*enumerate(raw)], "i int, raw string"), "raw", "k", 6, 100, default=None).orderBy("i").collect()
    assert [(r["valid"], r["value"], r["error"]) for r in rows] == [(True, 6, ""), (True, 7, ""), (False, None, "type"), (False, None, "missing"), (False, None, "syntax"), (True, 100, ""), (False, None, "type"), (False, None, "syntax")]


def test_latest_keeps_the_last(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "k string, t int, v int")
    assert sorted(r["v"] for r in rules.latest(rows, ["k"], ["t"]).collect()) == [6, 7]


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=300))
def test_packets_round_trip(data):
    packet = K.pack(data)
    assert K.unpack(packet) == data
    if data:
        with pytest.raises(Exception):
            K.unpack(packet[:-1] + bytes([packet[-1] ^ 1]))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.randoms(use_true_random=False))
def test_image_files_round_trip(h, w, rng):
    a = np.array([[[rng.randrange(256) for _ in range(3)] for _ in range(w)] for _ in range(h)])
    assert (I.decode_png(I.encode_png(a)) == a).all()
    assert (I.decode_ppm(I.encode_ppm(a)) == a).all() and (I.decode_ppm(I.encode_ppm(a, "P3")) == a).all()


def test_png_inspection_names_what_is_wrong():
    data = I.encode_png(np.zeros((2, 2, 3)))
    assert I.inspect_png(data)[0] == []
    assert "checksum:IDAT" in I.inspect_png(data[:45] + bytes([data[45] ^ 1]) + data[46:])[0]
    assert I.inspect_png(b"no")[0] == ["signature"] and "missing:IEND" in I.inspect_png(data[:-12])[0]


def test_headers_from_files(spark, tmp_path):
    a = np.zeros((4, 7, 3))
    (tmp_path / "a.png").write_bytes(I.encode_png(a))
    (tmp_path / "b.ppm").write_bytes(I.encode_ppm(a))
    (tmp_path / "c.gif").write_bytes(b"GIF89a" + bytes([7, 0, 4, 0]) + b"\0" * 20)
    (tmp_path / "d.bin").write_bytes(b"nothing at all")
    got = {(r["path"].rsplit("/", 1)[1], r["format"], r["width"], r["height"]) for r in I.headers(I.read_images(spark, str(tmp_path))).collect()}
    assert got == {("a.png", "png", 7, 4), ("b.ppm", "ppm", 7, 4), ("c.gif", "gif", 7, 4), ("d.bin", None, None, None)}


def test_memories(spark, tmp_path):
    good = tmp_path / "m.json"
    good.write_text('{"schema": "s/v1", "items": [{"id": "a", "label": "x"}, {"id": "b", "label": "y"}, {"id": "a", "label": "x"}]}')
    rows = I.read_memory(spark, str(good), "id: string, label: string", "s/v1").collect()
    assert {(r["id"], r["ordinal"]) for r in rows} == {("a", 0), ("b", 1)}
    with pytest.raises(Exception, match="another schema"):
        I.read_memory(spark, str(good), "id: string, label: string", "s/v2").collect()
    good.write_text('{"schema": "s/v1", "items": [{"id": "a", "label": "x"}, {"id": "a", "label": "y"}]}')
    with pytest.raises(Exception, match="different items"):
        I.read_memory(spark, str(good), "id: string, label: string", "s/v1").collect()


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for i in range(3):
        I.append_ledger(spark.createDataFrame([(i, "v")], "seq long, verdict string"), path)
    (tmp_path / "ledger" / "part-bad.txt").write_text("not json\n{\"seq\": \n")
    assert sorted(r["seq"] for r in I.read_ledger(spark, path, "seq long, verdict string", "seq").collect()) == [0, 1, 2]
    assert sorted(r["seq"] for r in I.read_ledger(spark, path, "seq long, verdict string", "seq", tail=2).collect()) == [1, 2]
    with pytest.raises(Exception, match="too long"):
        I.append_ledger(spark.createDataFrame([(1, "x" * 20_000)], "seq long, verdict string"), path)


def test_sequences():
    assert K.warp([1, 2, 3], [1, 2, 2, 3]) == 0 and K.warp([], [1]) == float("inf")
    assert K.edits("kitten", "sitting").count("keep") == 4 and len([s for s in K.edits("kitten", "sitting") if s != "keep"]) == 3
    assert K.simplify([(0, 0), (1, 0.01), (2, 0), (3, 5)], 0.1) == [(0, 0), (2, 0), (3, 5)] and K.simplify([], 1) == []


def test_packing_reports_frames_that_cannot_fit(spark):
    frames = spark.createDataFrame([("a", "big", 500, 5), ("a", "x", 10, 10), ("a", "y", 10, 10)], "atlas string, name string, w int, h int")
    plan = K.pack_atlas(frames, 16, 16)
    assert {(r["name"], r["page"]) for r in plan.collect()} == {("big", -1), ("x", 0), ("y", 1)}
    assert {r["problem"]: r["n"] for r in K.plan_violations(frames, plan.withColumn("x", F.lit(9)), 16, 16).collect()}["out_of_bounds"] == 2


def test_streams_leave_out_repeats(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.unionByName(events.limit(50)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    assert S.drain(S.once(stream, late="3650 days"), "once").count() == events.count()


@pytest.mark.parametrize("num", [15, 34])
def test_lexical_in_small_blocks_makes_no_pairs(spark, monkeypatch, num):
    for name, n in (("LEXICAL_QUERIES", 7), ("LEXICAL_MEMORY", 16), ("LEXICAL_STEP", 3), ("LEXICAL_CHUNK", 4)):
        monkeypatch.setattr(N, name, n)
    rng = random.Random(5)
    words = ["a", "b", "\x00", "\x01", "\x01b", "é", *(f"w{i}" for i in range(24))]
    rows = [(i, rng.choice(["x", "x", "y", None]), sorted(set(rng.choices(words, k=rng.choice([0, 1, 4, 12])))), rng.choice([1000, 400, 200])) for i in range(150)]
    rows += [(150, "x", [f"v{i}" for i in range(700)], 1000), (151, "x", [f"v{i}" for i in range(20, 720)], 200)]
    memory = spark.createDataFrame(rows, "id long, domain string, tokens array<string>, weight long")
    found = N.lexical(memory, memory, k=4, num=num)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "explode(tokens" not in plan
    got = sorted(map(tuple, found.collect()))
    want = []
    for i, d, t, _ in rows:
        best = []
        for j, e, u, w in rows:
            if d is not None and d == e and i != j and (s := len({*t} & {*u})) and s * 100 >= (a := len({*t} | {*u})) * num:
                best.append((-(s * 1000 * w // a), -(s * 1_000_000 // a), j))
        want += [(i, r, j, -v, -s) for r, (s, v, j) in enumerate(sorted(best)[:4], 1)]
    assert got == sorted(want) and any(r[0] == 150 for r in got)


@pytest.mark.parametrize("num, dense, many", [(15, 0.3, 200_000), (34, 2, 200_000), (34, 0.05, 20)])
def test_lexical_where_every_row_asks(spark, monkeypatch, num, dense, many):
    for name, n in (("EACH_BLOCK", 40), ("EACH_STEP", 7), ("EACH_HELD", 20), ("EACH_DENSE", dense), ("EACH_TOKENS", 9), ("EACH_ROWS", many)):
        monkeypatch.setattr(N, name, n)
    rng = random.Random(6)
    words = ["", "a", "\x00", "\x01b", "é", *(f"w{i}" for i in range(24))]
    rows = [(i, rng.choice(["x", "x", "y", None]), sorted(set(rng.choices(words, k=rng.choice([0, 1, 4, 12])))) + [f"own{i}"] * (i % 5 == 0)) for i in range(200)]
    rows += [(200, "x", [f"v{i}" for i in range(700)]), (201, "x", [f"v{i}" for i in range(20, 720)]), (202, "x", None), (None, "x", ["a"]), (203, "z", ["a"])]
    weight = {i: rng.choice([1000, 400]) for i in range(0, 202, 2)}
    found = N.lexical_each(spark.createDataFrame(rows, "id long, domain string, tokens array<string>"), spark.createDataFrame(list(weight.items()), "id long, weight int"), 200, k=4, num=num)
    want = []
    for i, d, t in rows:
        best = []
        for j, e, u in rows:
            if None not in (i, j, d, t, u) and d == e and i != j and (s := len({*t} & {*u})) and s * 100 >= (a := len({*t} | {*u})) * num:
                best.append((-(s * 1000 * weight.get(j, 200) // a), -(s * 1_000_000 // a), j))
        want += [(i, r, j, -v, -s) for r, (s, v, j) in enumerate(sorted(best)[:4], 1)]
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 80


def test_packing_looks_at_sizes_and_not_at_boxes(monkeypatch):
    def plain(boxes, width, height):
        line, placed, rest = [(0, 0, width)], {}, []
        for name, w, h in boxes:
            fits = [(max(y for sx, y, sw in line if sx < x + w and sx + sw > x), x) for x, _, _ in line if x + w <= width]
            fits = [(y, x) for y, x in fits if y + h <= height]
            if not fits:
                rest.append((name, w, h))
                continue
            y, x = min(fits)
            placed[name] = (x, y)
            line = sorted(s for s in [(x, y + h, w), *((sx, sy, min(sw, x - sx)) for sx, sy, sw in line if sx < x), *((max(sx, x + w), sy, sx + sw - max(sx, x + w)) for sx, sy, sw in line if sx + sw > x + w)] if s[2] > 0)
        return placed, rest

    rng = random.Random(3)
    boxes = [(f"b{i}", rng.randint(1, 12), rng.randint(1, 9)) for i in range(300)]
    for given in (boxes, sorted(boxes, key=lambda b: (-b[2], -b[1], b[0]))):
        assert K.skyline(given, 32, 16) == plain(given, 32, 16)
    # a full page costs a look at each of two sizes, not at each of 200,000 boxes
    runs = [(8, 4, [f"a{i}" for i in range(100_000)]), (4, 4, [f"c{i}" for i in range(100_000)])]
    tries = []
    monkeypatch.setattr(K, "max", lambda *a: tries.append(1) or max(*a), raising=False)
    placed, rest = K.skyline_runs(runs, 32, 16)
    assert len(placed) == 16 and [len(n) for _, _, n in rest] == [100_000 - 16, 100_000] and len(tries) < 500


def test_perceptual_hash_of_any_size_without_cells(spark):
    import math

    from quillstone.operators import perception

    rng = np.random.default_rng(8)
    shapes, rows = [(1, 1), (10, 10), (32, 32), (40, 7), (70, 33), (3, 97)], []
    for key, (h, w) in enumerate(shapes):
        a = rng.integers(0, 256, (h, w, 3))
        rows += [(key, y, x, *map(int, a[y, x])) for y in range(h) for x in range(w) if (y, x) != (2, 3)]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int")
    found = perception.perceptual_hash(px)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["image_id"]: (r["hash"], r["hex"]) for r in found.collect()}
    cosine = [[round((1 << 15) * math.cos((2 * i + 1) * u * math.pi / 64)) for i in range(32)] for u in range(8)]
    for key, (h, w) in enumerate(shapes):
        own = {(r[1], r[2]): r[3:] for r in rows if r[0] == key}
        span = lambda i, n: range(i * n // 32, max(i * n // 32 + 1, (i + 1) * n // 32))
        sums = [[0] * 8 for _ in range(8)]
        for y in range(32):
            for x in range(32):
                if cells := [own[s, t] for s in span(y, h) for t in span(x, w) if (s, t) in own]:
                    luma = sum(k * round(sum(p[i] for p in cells) / len(cells)) for i, k in enumerate((2126, 7152, 722)))
                    for u in range(8):
                        for v in range(8):
                            sums[u][v] += luma * cosine[u][y] * cosine[v][x]
        zero = lambda n: 1 / math.sqrt(2) if n == 0 else 1.0
        ks = [zero(i // 8) * zero(i % 8) * float(sums[i // 8][i % 8]) for i in range(1, 64)]
        want = sum(1 << (62 - i) for i, k in enumerate(ks) if k > sorted(ks)[31])
        assert got[key] == (want, f"{want:016x}"), (h, w)
