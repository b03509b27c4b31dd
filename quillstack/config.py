"""Settings, from YAML where there is a file; a missing or broken file leaves the defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Settings:
    batch_size: int = 1000
    workers: int = 0  #: 0 leaves it to Spark
    commit_containers: int = 64  #: containers that are read side by side and committed together
    retry_max_attempts: int = 3
    retry_backoff_seconds: tuple[float, ...] = (0.5, 1.0, 2.0)
    readpst_tmp_dir: str | None = None
    relevance_candidates: int = 5000
    snippet_len: int = 300
    strip_quoted_replies: bool = True
    max_raw_bytes: int = 256 * 1024
    db_path: str = "data/mails"
    state_path: str = "data/state.json"
    errors_path: str = "data/errors"


#: Where each setting stands in the YAML file.
PLACES = {
    "batch_size": ("indexing", "batch_size"),
    "workers": ("indexing", "workers"),
    "commit_containers": ("indexing", "commit_containers"),
    "retry_max_attempts": ("indexing", "retry", "max_attempts"),
    "retry_backoff_seconds": ("indexing", "retry", "backoff_seconds"),
    "readpst_tmp_dir": ("indexing", "readpst_tmp_dir"),
    "relevance_candidates": ("search", "relevance_candidates"),
    "snippet_len": ("search", "snippet_len"),
    "strip_quoted_replies": ("search", "strip_quoted_replies"),
    "max_raw_bytes": ("encoding", "max_raw_bytes"),
    "db_path": ("paths", "db"),
    "state_path": ("paths", "state"),
    "errors_path": ("paths", "errors"),
}


def _scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] in "\"'" and text[:1]:
        return text[1 : text.index(text[0], 1)]
    text = text.split(" #")[0].strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text in ("", "null", "~", "Null", "NULL"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def parse_yaml_subset(text: str) -> dict[str, Any]:
    """Nested maps by indentation, scalars, flow lists and block lists of scalars; comments are skipped."""
    root: dict[str, Any] = {}
    stack: list[tuple[int, Any, str | None]] = [(-1, root, None)]  # indent, container, key that is still empty
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent, content = len(line) - len(line.lstrip()), line.strip()
        while len(stack) > 1 and indent <= stack[-1][0] and not (content.startswith("- ") and indent == stack[-1][0]):
            stack.pop()
        if content.startswith("- "):
            _, container, key = stack[-1]
            if key is not None and not isinstance(container[key], list):
                container[key] = []
            if key is not None:
                container[key].append(_scalar(content[2:]))
            continue
        name, colon, value = content.partition(":")
        if not colon:
            raise ValueError(f"not a line of the supported subset: {line!r}")
        _, container, key = stack[-1]
        if key is not None:
            if not isinstance(container[key], dict):
                container[key] = {}
            container = container[key]
        plain = value.split(" #")[0].strip()
        container[name.strip()] = _scalar(value) if plain else None
        if not plain:
            stack.append((indent, container, name.strip()))
    return root


def _load(path: Path) -> dict[str, Any]:
    text = path.read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:
        return parse_yaml_subset(text)
    return yaml.safe_load(text) or {}


def load_settings(path: str | Path | None = None) -> Settings:
    """Settings of a YAML file; relative paths are taken from the file's folder's parent."""
    if path is None:
        return Settings()
    try:
        tree = _load(Path(path))
    except Exception:  # a broken file must not stop indexing or search
        return Settings()
    found: dict[str, Any] = {}
    for name, place in PLACES.items():
        node: Any = tree
        for key in place:
            node = node.get(key) if isinstance(node, dict) else None
        if node is not None:
            found[name] = tuple(float(x) for x in node) if name == "retry_backoff_seconds" else node
    known = {f.name for f in fields(Settings)}
    settings = replace(Settings(), **{k: v for k, v in found.items() if k in known})
    base = Path(path).resolve().parent.parent
    anchored = {n: str(base / getattr(settings, n)) for n in ("db_path", "state_path", "errors_path") if not Path(getattr(settings, n)).is_absolute()}
    return replace(settings, **anchored)
