"""Path conventions of results, metrics and summaries."""

from __future__ import annotations

import posixpath
import re

UNKNOWN = "U"


def prompt_id(path: str, trailing: bool = True) -> str:
    """The driver-side form of ``exprs.prompt_id_of``."""
    tries = [(r"/prompt(\d+)/", path), *([(r"/prompt(\d+)$", path)] if trailing else []), (r"_prompt(\d+)", posixpath.basename(path))]
    return next((m[1] for pattern, text in tries if (m := re.search(pattern, text))), UNKNOWN)


def metric_paths(root: str, prompt: str, model: str, metric: str, mode: str = "", ignore_all_false: bool = False) -> tuple[str, str]:
    """Where a metric's table and its error report go."""
    suffix = "_all_false_ignored" if ignore_all_false and metric != "ich_size" else ""
    folder = "/".join(filter(None, [root, f"prompt{prompt}", model, metric, mode]))
    name = "_".join(filter(None, [model, f"prompt{prompt}", metric, mode])) + suffix
    return f"{folder}/metrics_{name}.csv", f"{folder}/errors_{name}.txt"


#: What each step adds to a results table's name; the spelling is part of the convention.
POSTPROCESSED, FORMATTED = "_postprocessed", "_formated"


def results_path(root: str, prompt: str, model: str, kind: str = "") -> str:
    """Where a model's results table goes; a name that readers take prompt and model from (a slash is no part of a name)."""
    model = model.replace("/", "_")
    return f"{root}/prompt{prompt}/results_{model}_prompt{prompt}{kind}.csv"


def _renamed(path: str, root: str, kind: str) -> str:
    stem, end = posixpath.splitext(posixpath.basename(path))
    return f"{root}/prompt{prompt_id(path, trailing=False)}/{stem}{kind}{end or '.csv'}"


def postprocessed_path(path: str, root: str) -> str:
    return _renamed(path, root, POSTPROCESSED)


def formatted_path(path: str, root: str) -> str:
    stem, end = posixpath.splitext(path)
    return _renamed(stem.removesuffix(POSTPROCESSED) + end, root, FORMATTED)
