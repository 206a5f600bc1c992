"""The status hook's JSON object."""

from __future__ import annotations

import json

_NUMBER = (int, float)


def _need(data: dict, path: str, kinds: tuple, optional: bool = False):
    value, parts = data, path.split(".")
    for k, part in enumerate(parts):
        if not isinstance(value, dict):
            raise ValueError(f"{'.'.join(parts[:k])} is no object")
        if part not in value:
            if optional:
                return None
            raise ValueError(f"{path} is missing")
        value = value[part]
    if isinstance(value, bool) or not isinstance(value, kinds):
        raise ValueError(f"{path} has the wrong type")
    return value


def parse(text: str) -> dict:
    """Checked hook input with flat keys; ValueError if it doesn't fit. Unknown keys are ignored."""
    data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError("the hook input is no object")
    out = {k: _need(data, k, (str,)) for k in ("session_id", "transcript_path", "cwd", "workspace.current_dir", "workspace.project_dir")}
    out |= {"model_id": _need(data, "model.id", (str,)), "model_name": _need(data, "model.display_name", (str,)), "version": _need(data, "version", (str,), optional=True), "cost": None, "context_tokens": None, "context_size": None}
    if "cost" in data:
        out["cost"] = _need(data, "cost.total_cost_usd", _NUMBER)
    if "context_window" in data:
        out["context_tokens"] = _need(data, "context_window.total_input_tokens", _NUMBER)
        out["context_size"] = _need(data, "context_window.context_window_size", _NUMBER)
    return out
