"""Model files, temperatures, phones, cases and chosen operators on odd inputs."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillstone.operators import cases, choosing, material, models, neighbours, network, phones, preview
from quillstone.plans import models as plan
from quillstone.sources import models as M


@pytest.mark.parametrize("key, value", [("layers", [2]), ("layers", [2, True]), ("weights", [[1.0]]), ("biases", [[math.nan, 0.0]]), ("activations", ["tanh"]), ("weights", [])])
def test_model_refusals(key, value):
    good = {"layers": [2, 2], "weights": [[1, 2, 3, 4]], "biases": [[0, 1]], "activations": ["softmax"]}
    M.validate(good)
    with pytest.raises(ValueError):
        M.validate(good | {key: value})
    with pytest.raises(ValueError):
        M.validate({k: v for k, v in good.items() if k != key})


def test_model_files(spark, tmp_path):
    M.save(spark, str(tmp_path / "m"), plan.ESCALATION)
    assert M.load(spark, str(tmp_path / "m")) == plan.ESCALATION
    size = M.measured(plan.ESCALATION, 64, 8192)
    assert size["parameters"] == 7 * 4 + 4 + 4 * 3 + 3
    with pytest.raises(ValueError, match="budget"):
        M.measured(plan.ESCALATION, 10, 8192)
    folder = tmp_path / "named"
    folder.mkdir()
    name = "cloud_escalation_predictor"
    (folder / f"{name}.json").write_text(json.dumps(plan.ESCALATION))
    digest = hashlib.sha256((folder / f"{name}.json").read_bytes()).hexdigest()
    assert M.load_imported(spark, str(folder), name, {f"{name}.json": digest}) == plan.ESCALATION
    with pytest.raises(ValueError, match="provenance"):
        M.load_imported(spark, str(folder), name, {f"{name}.json": "0" * 64})
    with pytest.raises(ValueError, match="provenance"):
        M.load_imported(spark, str(folder), name, {})
    with pytest.raises(ValueError, match="unknown"):
        M.load_imported(spark, str(folder), "none", {})


def test_layers_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.random((20, 7))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>")
    found = {r["id"]: r["o"] for r in network.layered(rows, F.col("x"), M.layers(plan.ESCALATION), "o").collect()}
    w1, w2 = np.reshape(plan.ESCALATION["weights"][0], (4, 7)), np.reshape(plan.ESCALATION["weights"][1], (3, 4))
    z = np.maximum(x @ w1.T + plan.ESCALATION["biases"][0], 0) @ w2.T + plan.ESCALATION["biases"][1]
    want = np.exp(z - z.max(1, keepdims=True))
    want /= want.sum(1, keepdims=True)
    assert np.allclose([found[i] for i in range(20)], want)


def test_temperature_is_the_least_loss(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(300, 3)) * 4
    label = np.where(rng.random(300) < 0.6, z.argmax(1), rng.integers(0, 3, 300))
    rows = spark.createDataFrame([([float(v) for v in r], int(k)) for r, k in zip(z, label)], "z array<double>, label int")
    found = models.fit_temperature(rows, 3)

    def loss(t):
        s = z / t
        return float(np.mean(np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(300), label]))

    grid = np.exp(np.linspace(math.log(0.1), math.log(10), 20001))
    best = grid[np.argmin([loss(t) for t in grid])]
    assert abs(found["temperature"] / best - 1) < 1e-3 and math.isclose(found["after"], loss(found["temperature"]), rel_tol=1e-9)
    assert found["after"] <= found["before"]
    with pytest.raises(ValueError, match="every class"):
        models.fit_temperature(rows.where("label < 2"), 3)
    with pytest.raises(ValueError, match="ends"):
        models.fit_temperature(rows, 3, 2.0, 10.0)
    with pytest.raises(ValueError, match="another model"):
        models.calibrated(rows, F.col("z"), plan.ESCALATION, {"fingerprint": "x", "classes": 3, "temperature": 1.0})


def test_unknown_features_stop(spark):
    rows = spark.createDataFrame([(0.5, None)], "a double, b double")
    with pytest.raises(PySparkException, match="feature b"):
        rows.select(models.checked(["a", "b"]).alias("x")).collect()


def test_phone_inventory(spark):
    kind = "id string, language_id string, ipa string, evidence string, source string, features map<string,double>"
    rows = [("a", "x", "p", "attested", "s", {"f1": 0.5}), ("b", "x", "", "attested", "s", {"f1": 0.5}), ("c", "x", "p", "rumour", "s", {"f1": 0.5}), ("d", "x", "p", "attested", "s", {"pitch": 0.5}), ("e", "x", "p", "attested", "s", {"f1": None}), ("f", "x", "p", "attested", "s", {"f1": 1.5}), ("g", "x", "p", None, "s", {"f1": 0.5}), ("h", "x", "p", "attested", "s", None)]
    found = {r["id"]: r["problem"] for r in phones.problems(spark.createDataFrame(rows, kind)).collect()}
    assert found == {"b": "needs id, ipa, language_id and source", "c": "unknown evidence", "g": "unknown evidence", "d": "unknown feature", "e": "no feature", "f": "feature out of range", "h": "no feature"}


def test_phones_abstain(spark):
    kind = "id string, language_id string, ipa string, evidence string, features map<string,double>"
    full = {"voicing": 1.0, "manner": 0.2, "place": 0.3, "height": 0.4}
    memory = spark.createDataFrame([("1", "x", "b", "attested", full), ("2", "x", "d", "attested", full | {"place": 0.5}), ("3", "x", "g", "inferred", full | {"place": 0.9}), ("4", "y", "b", "attested", full), ("5", "x", "m", "attested", {"voicing": 1.0, "manner": 0.2})], kind)
    queries = spark.createDataFrame([("q", "x", full), ("few", "y", full), ("none", "z", full), ("thin", "x", {"voicing": 1.0})], "id string, language_id string, features map<string,double>")
    found = {r["id"]: r for r in phones.retrieve(queries, memory).collect()}
    assert (found["q"]["ipa"], found["q"]["evidence"], found["q"]["certified"], found["q"]["neighbours"]) == ("b", "inferred", False, 3)
    assert all(found[k]["reason"] == "too_few_similar_phones" for k in ("few", "none", "thin"))
    twin = memory.unionByName(memory.where("id = '1'").withColumn("ipa", F.lit("p")).withColumn("id", F.lit("6")))
    assert {r["id"]: r["reason"] for r in phones.retrieve(queries, twin).collect()}["q"] == "ambiguous_nearest_phones"


def test_records_of_other_lengths_stop(spark):
    q = spark.createDataFrame([(1, "x", [0.1, 0.2])], "id int, language string, v array<double>")
    m = spark.createDataFrame([(1, "x", "b", "attested", [0.1])], "record int, language string, symbol string, evidence string, v array<double>")
    with pytest.raises(PySparkException, match="different lengths"):
        phones.nearest_records(q, m).collect()
    found = phones.reconstruct(q.withColumn("language", F.lit("y")), m).collect()
    assert [tuple(r) for r in found] == [(1, "?", "speculative", 0)]


def test_cases(spark):
    table = [((0.0, 0.0), 1.0), ((1.0, 0.0), 1.0), ((0.0, 1.0), 1.0), ((1.0, 1.0), 1.0)]
    rows = spark.createDataFrame([(0, 0.5, 0.5), (1, 0.0, 0.0), (2, 11.0, 0.0), (3, None, 0.0), (4, 9.0, 9.0)], "id int, a double, b double")
    found = {r["id"]: r for r in cases.inverse_distance(rows, ["a", "b"], [10.0, 10.0], table, [(0, 10), (0, 10)]).collect()}
    assert found[0]["value"] == pytest.approx(1.0) and found[0]["confidence"] == pytest.approx(0.9) and found[1]["value"] == pytest.approx(1.0)
    assert [found[i]["reason"] for i in (2, 3, 4)] == ["out_of_domain", "out_of_domain", "insufficient_neighbor_support"]
    odd = {r["id"]: r for r in cases.inverse_distance(rows, ["a", "b"], [10.0, 10.0], [((0.0, 0.0), 2.0), *table[1:]], [(0, 10), (0, 10)]).collect()}
    assert odd[1]["reason"] == "neighbors_inconsistent"
    with pytest.raises(ValueError):
        cases.inverse_distance(rows, ["a"], [10.0], table, [(0, 10)])


def test_profiles(spark):
    row = spark.createDataFrame([("the cat is un chat",)], "text string").select(neighbours.content(neighbours.tokens(F.col("text")), "fr-en").alias("t")).first()
    assert sorted(row["t"]) == ["cat", "chat"]
    with pytest.raises(ValueError, match="profile"):
        neighbours.content(F.col("t"), "de")


def test_choosing_odd_images(spark):
    kind = "image_id long, y int, x int, r int, g int, b int"
    flat = spark.createDataFrame([(1, y, x, 9, 9, 9) for y in range(6) for x in range(6)], kind)
    assert choosing.cutout_verdict(flat).first()["reason"] == "implausible_foreground"
    many = spark.createDataFrame([(1, y, x, (y * 160 + x) % 12, (y * 160 + x) // 12 % 12, (y * 160 + x) // 144 % 12) for y in range(160) for x in range(160)], kind)
    assert choosing.cutout(many).count() == 0 and choosing.cutout_verdict(many).first()["reason"] == "too_many_border_colors"
    with pytest.raises(ValueError):
        choosing.cutout(flat, 0.0)
    line = spark.createDataFrame([(1, 0, x, 60 * x, 0, 0) for x in range(4)], kind)
    assert choosing.resample_by_pattern(line, 2, 2, [((0.1,) * 4, (0.25,) * 4)]).where("matched").count() == 0
    assert choosing.resample_by_pattern(flat, 3, 3, []).where("r = 9").count() == 9
    none = spark.createDataFrame([], "image_id long, preset string")
    assert sorted(choosing.filtered(flat, none).collect()) == sorted(flat.collect())
    assert choosing.region_features(flat).first()["area"] == 36


def test_photometric_fit(spark):
    lights = material.light_directions(6)
    a = material.checked_lights(lights)
    normal = np.array([0.2, -0.1, 0.97])
    normal /= np.linalg.norm(normal)
    v = [float(x) for x in 0.7 * (a @ normal) + 0.05]
    rows = spark.createDataFrame([(1, 0, 0, v), (1, 0, 1, [0.0] * 6)], "image_id long, y int, x int, v array<double>")
    found = {r["x"]: r for r in material.photometric_fit(rows, lights).collect()}
    assert np.allclose([found[0]["nx"], found[0]["ny"], found[0]["nz"]], normal) and math.isclose(found[0]["albedo"], 0.7) and math.isclose(found[0]["ambient"], 0.05)
    assert found[0]["residual"] < 1e-9 and found[1]["nx"] is None and found[1]["residual"] == 1.0
    same = material.photometric_fit(rows, [(0, 0, 1)] * 6).collect()
    assert all(r["nz"] is None and r["residual"] == 1.0 and r["albedo"] == 0.0 for r in same)
    for bad in ([(0, 0, 1)] * 3, [(0, 0, 0)] * 4, [(0, 1)] * 4, [(0, 0, math.inf)] * 4):
        with pytest.raises(ValueError):
            material.checked_lights(bad)
    with pytest.raises(PySparkException, match="intensities"):
        material.photometric_fit(rows.withColumn("v", F.array(F.lit(2.0))), lights).collect()
    colours = material.encode_normals(material.photometric_fit(rows, lights)).where("x = 1").first()
    assert tuple(colours)[3:] == (128, 128, 255)


def test_previews(spark):
    kind = "image_id long, y int, x int, r int, g int, b int"
    px = spark.createDataFrame([(1, y, x, 10 * x, 10 * y, 0) for y in range(8) for x in range(16)] + [(2, 0, 0, 5, 6, 7)], kind)
    found = sorted(tuple(r) for r in preview.reduced(px, 4).collect())
    assert len([r for r in found if r[0] == 1]) == 8 and found[0] == (1, 0, 0, 15, 15, 0) and found[-1] == (2, 0, 0, 5, 6, 7)
    for bad in (3, True, 4.0):
        with pytest.raises(ValueError):
            preview.report(px, bad)


def test_equal_phones_are_compared_once_and_all_counted(spark):
    vectors = [{"voicing": 1.0, "manner": 0.5, "place": 0.25}, {"voicing": 1.0, "manner": 0.5, "place": None, "height": 0.5}, {"voicing": 0.9, "manner": 0.5, "place": 0.25}, {"voicing": 0.9, "manner": 0.4, "place": 0.25}]
    schema = "id long, language_id long, ipa string, evidence string, features map<string,double>"
    items = [(i, i % 2, "x" if i == 399 else f"p{i % 4}", ("attested", "reconstructed")[i == 4], vectors[i % 4]) for i in range(400)]
    inventory = spark.createDataFrame(items, schema)
    asks = spark.createDataFrame([(q, q % 2, vectors[q % 4]) for q in range(60)] + [(60, None, vectors[0]), (61, 7, vectors[0])], "id long, language_id long, features map<string,double>")
    assert phones._pairs(asks, inventory, 0.5, 5).count() <= 8
    got = {r["id"]: r for r in phones.retrieve(asks, inventory).collect()}
    assert len(got) == 62 and all(got[q]["status"] == "abstain" and got[q]["neighbours"] == 0 for q in (60, 61))
    for q in range(60):
        own = [(i, ipa, e) for i, lang, ipa, e, _ in items if lang == q % 2 and i % 4 == q % 4]
        alone = q % 4 == 1  # its vector has two features that others know
        r = got[q]
        if len({ipa for _, ipa, _ in own}) > 1:
            assert (r["status"], r["reason"], r["ipa"]) == ("abstain", "ambiguous_nearest_phones", None)
        else:
            assert (r["status"], r["ipa"], r["neighbours"]) == ("suggest", f"p{q % 4}", 5)
            assert r["certified"] == (not any(e == "reconstructed" for _, _, e in own[:5])) or alone
