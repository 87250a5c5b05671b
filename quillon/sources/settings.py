"""Settings of experiments and personas: small YAML files, read on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quillon.schema import DIMENSIONS

#: What a persona's file weighs, by the dimensions that it is for.
WEIGHT_KEYS = {
    "clarity_and_comprehensibility": ("clarity",), "workflow_fit": ("workflow_fit",), "friction_and_frustration": ("friction_loss_of_control",), "reliability": ("reliability_user_trust",), "anthropomorphism": ("anthropomorphism",),
    "persona_consistency_and_context_awareness": ("persona_consistency", "context_awareness"), "plus_correctness": ("plus_correctness",), "correctness": ("correctness",),
}


def read_yaml(path: str) -> dict:
    """A YAML file as a dictionary; PyYAML is needed for anything but ``key: value`` lines."""
    try:
        import yaml
    except ModuleNotFoundError:
        return _plain_yaml(Path(path).read_text(encoding="utf-8"))
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def _plain_yaml(text: str) -> dict:
    """Nested ``key: value`` lines and lists of scalars, which is what these files hold."""
    out: dict = {}
    stack: list[tuple[int, dict | list, dict | None, str]] = [(-1, out, None, "")]

    def scalar(x: str):
        x = x.strip()
        if x[:1] in "'\"" and x[-1:] == x[:1] and len(x) > 1:
            return x[1:-1]
        for kind in (int, float):
            try:
                return kind(x)
            except ValueError:
                pass
        return {"true": True, "false": False, "null": None, "": None, "~": None}.get(x.lower(), x)

    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.strip().startswith("#"):
            continue
        indent = len(body) - len(body.lstrip())
        while stack[-1][0] >= indent and not (body.lstrip().startswith("- ") and stack[-1][0] == indent and isinstance(stack[-1][1], list)):
            stack.pop()
        holder = stack[-1][1]
        if body.lstrip().startswith("- "):
            if isinstance(holder, dict) and not holder and stack[-1][2] is not None:
                fresh: list = []
                stack[-1][2][stack[-1][3]] = fresh
                stack[-1] = (stack[-1][0], fresh, stack[-1][2], stack[-1][3])
                holder = fresh
            holder.append(scalar(body.lstrip()[2:]))
            continue
        key, _, value = body.strip().partition(":")
        if value.strip().startswith("["):
            holder[key] = [scalar(x) for x in value.strip()[1:-1].split(",") if x.strip()]
        elif value.strip():
            holder[key] = scalar(value)
        else:
            holder[key] = {}
            stack.append((indent, holder[key], holder, key))
    return out


def persona_weights(paths: Sequence[str]) -> list[tuple[str, str, float]]:
    """(user_id, dimension, weight) of persona files: 1 where a file gives no number. No file, no user, no weights, a weight of 0 or less and a second file of a user are errors."""
    if not paths:
        raise ValueError("no persona files")
    out: dict[str, dict[str, float]] = {}
    for path in paths:
        held = read_yaml(path)
        user, given = str(held.get("user_id") or "").strip(), held.get("output_dimensions")
        if not user or not isinstance(given, dict) or not given:
            raise ValueError(f"{path} has no user_id or no output_dimensions")
        if user in out:
            raise ValueError(f"{user} has two files")
        weights = dict.fromkeys(DIMENSIONS, 1.0)
        for key, dims in WEIGHT_KEYS.items():
            if isinstance(given.get(key), (int, float)) and not isinstance(given.get(key), bool):
                weights |= dict.fromkeys(dims, float(given[key]))
        if bad := sorted(d for d, w in weights.items() if w <= 0):
            raise ValueError(f"{path} has weights of 0 or less for {bad}")
        out[user] = weights
    return [(u, d, w) for u, ws in out.items() for d, w in ws.items()]


def weights_table(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(persona_weights(paths), "user_id string, dimension string, weight double")


def experiment(path: str) -> dict:
    """An experiment's settings: name, base_dir and generator are required; files under ``include`` are read first, later ones win; models and judges of pairs must be defined."""
    held, out = read_yaml(path), {"n_samples": 20, "n_variations": 2}
    for other in held.pop("include", None) or []:
        out |= read_yaml(str(Path(path).parent / other))
    out |= held
    if missing := [k for k in ("name", "base_dir", "generator") if not out.get(k)]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    known = set(out.get("models") or ())
    if unknown := sorted(set(out.get("evaluate") or ()) - known):
        raise ValueError(f"{path} evaluates models that it doesn't define: {unknown}")
    return out


def preferred_dimensions(profile: dict) -> list[str]:
    """Dimensions that a profile weighs above 3 of 5, or speaks of in words."""
    out = []
    for key, dims in WEIGHT_KEYS.items():
        value = (profile.get("output_dimensions") or {}).get(key)
        if isinstance(value, (int, float)) and value > 3 or isinstance(value, str) and any(x in value.lower() for x in ("high", "important", "prefer", "strong")):
            out += [d for d in dims if d in DIMENSIONS]
    return sorted(set(out))
