"""Small networks as JSON: layer sizes, weights by rows, biases and activations, checked before use, measured and told apart by a digest.

A model is a dict with ``layers``, ``weights``, ``biases`` and ``activations``; files hold one each and may carry more keys. A model is bounded by its
budget, so it is read by the driver and its weights become constants of a plan.
"""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

from pyspark.sql import SparkSession

from quillstone.operators.network import Layer

KEYS = ("layers", "weights", "biases", "activations")
ACTIVATIONS = ("relu", "sigmoid", "softmax", "linear")
# Labels of the imported models in the order of their outputs.
LABELS = {
    "anomaly_detector": ("normal", "anomaly"),
    "binary_router": ("local", "cloud"),
    "cloud_escalation_predictor": ("local_small", "local_big", "cloud"),
    "compressibility_predictor": ("none", "delta", "heavy"),
    "context_pruning_predictor": ("keep", "prune"),
    "effort_classifier": ("easy (local)", "medium (hybrid)", "hard (cloud)"),
    "error_classifier": ("syntax", "runtime", "network", "permission", "timeout", "resource"),
    "response_length_predictor": ("short", "medium", "long"),
    "semantic_cache_hit_predictor": ("miss", "hit"),
    "skip_agent_predictor": ("execute", "skip"),
    "tool_call_predictor": ("llm_only", "use_tool"),
}


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def validate(model: Any) -> dict[str, Any]:
    """``model`` if its sizes fit and all its numbers are finite; else a ValueError that names what is wrong."""
    if not isinstance(model, dict) or any(k not in model for k in KEYS):
        raise ValueError(f"a model is an object with {', '.join(KEYS)}")
    sizes = model["layers"]
    if not isinstance(sizes, list) or len(sizes) < 2 or not all(isinstance(n, int) and not isinstance(n, bool) and n > 0 for n in sizes):
        raise ValueError("layers must be two or more positive sizes")
    for k in KEYS[1:]:
        if not isinstance(model[k], list) or len(model[k]) != len(sizes) - 1:
            raise ValueError(f"{k} don't fit the layers")
    for i, (before, after) in enumerate(zip(sizes, sizes[1:])):  # noqa: B905
        for k, n in (("weights", before * after), ("biases", after)):
            if not isinstance(model[k][i], list) or len(model[k][i]) != n or not all(map(_number, model[k][i])):
                raise ValueError(f"{k} of layer {i} must be {n} finite numbers")
        if model["activations"][i] not in ACTIVATIONS:
            raise ValueError(f"unknown activation {model['activations'][i]}")
    return model


def layers(model: dict[str, Any]) -> list[Layer]:
    """What ``network.forward`` takes: rows of weights, biases and the activation of each layer."""
    sizes = validate(model)["layers"]
    rows = lambda flat, n: [[float(w) for w in flat[j : j + n]] for j in range(0, len(flat), n)]
    return [(rows(w, n), [float(b) for b in bias], act) for w, n, bias, act in zip(model["weights"], sizes[:-1], model["biases"], model["activations"], strict=True)]


def text_of(model: dict[str, Any]) -> str:
    return json.dumps(validate(model), indent=2, allow_nan=False)


def measured(model: dict[str, Any], most_parameters: int, most_bytes: int) -> dict[str, int]:
    """Parameters and bytes of the file of a model; more than the budget allows is a ValueError."""
    if most_parameters <= 0 or most_bytes <= 0:
        raise ValueError("a budget must be positive")
    size = {"parameters": sum(len(w) + len(b) for w, b in zip(model["weights"], model["biases"], strict=True)), "model_bytes": len(text_of(model).encode())}
    if size["parameters"] > most_parameters or size["model_bytes"] > most_bytes:
        raise ValueError(f"over the budget of {most_parameters} parameters and {most_bytes} bytes: {size}")
    return size


def fingerprint(model: dict[str, Any]) -> str:
    """The SHA-256 of a model's JSON without spaces and with sorted keys; only for models that end in a softmax of two classes or more."""
    if validate(model)["activations"][-1] != "softmax" or model["layers"][-1] < 2:
        raise ValueError("a calibration needs a softmax of two classes or more")
    return hashlib.sha256(json.dumps(model, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def save(spark: SparkSession, path: str, model: dict[str, Any]) -> None:
    """Writes a folder with one file of the model; Spark's commit makes it appear as a whole or not at all."""
    spark.createDataFrame([(text_of(model),)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def load(spark: SparkSession, path: str, digest: str | None = None) -> dict[str, Any]:
    """The model of a file or of a folder that ``save`` wrote. With ``digest``, a file of other bytes is refused."""
    files = spark.read.format("binaryFile").load(path).select("content").where("length > 0").take(2)
    if len(files) != 1:
        raise ValueError(f"{path} must hold one model")
    content = bytes(files[0][0])
    if digest is not None and hashlib.sha256(content).hexdigest() != digest:
        raise ValueError(f"{path} does not match its provenance")
    return validate(json.loads(content))


def load_imported(spark: SparkSession, folder: str, name: str, provenance: dict[str, str]) -> dict[str, Any]:
    """An imported model by name; ``provenance`` is its file's SHA-256 by file name. Unknown names, files without provenance and other bytes are refused."""
    if name not in LABELS:
        raise ValueError(f"unknown model {name}; known are {', '.join(sorted(LABELS))}")
    if f"{name}.json" not in provenance:
        raise ValueError(f"{name}.json has no provenance")
    model = load(spark, f"{folder}/{name}.json", provenance[f"{name}.json"])
    if model["layers"][-1] != len(LABELS[name]):
        raise ValueError(f"{name} has {model['layers'][-1]} outputs for {len(LABELS[name])} labels")
    return model
