from __future__ import annotations

import pytest

from quillstack.config import Settings, load_settings, parse_yaml_subset

TEXT = """
# comment
indexing:
  batch_size: 10
  retry:
    max_attempts: 5
    backoff_seconds: [0.1, 2]
  readpst_tmp_dir: null
search:
  strip_quoted_replies: false   # no
  names:
    - a
    - "b: c"
paths:
  db: "x/db"
"""


def test_subset():
    tree = parse_yaml_subset(TEXT)
    assert tree["indexing"] == {"batch_size": 10, "retry": {"max_attempts": 5, "backoff_seconds": [0.1, 2]}, "readpst_tmp_dir": None}
    assert tree["search"] == {"strip_quoted_replies": False, "names": ["a", "b: c"]}
    yaml = pytest.importorskip("yaml")
    assert tree == yaml.safe_load(TEXT)


def test_load(tmp_path):
    (tmp_path / "config").mkdir()
    path = tmp_path / "config" / "settings.yaml"
    path.write_text(TEXT)
    got = load_settings(path)
    assert (got.batch_size, got.retry_max_attempts, got.retry_backoff_seconds, got.strip_quoted_replies) == (10, 5, (0.1, 2.0), False)
    assert got.db_path == str(tmp_path / "x/db") and got.snippet_len == 300


def test_broken_or_missing_files_leave_the_defaults(tmp_path):
    (tmp_path / "bad.yaml").write_text("a: [1\n  b")
    assert load_settings(tmp_path / "bad.yaml") == load_settings(tmp_path / "none.yaml") == Settings()
