from __future__ import annotations

import json

from quillstack.cli import main


def test_all_commands(spark, tmp_path, capsys):
    (tmp_path / "a.pst").write_text("FAKE:6")
    run = lambda *a: main(["--store", str(tmp_path / "store"), "--plugins", "fake_reader", *a], spark)
    assert run("index", str(tmp_path), "--dry-run") == 0
    assert "a.pst" in capsys.readouterr().out
    assert run("index", str(tmp_path), "--reader", "fake") == 0
    assert json.loads(capsys.readouterr().out)["written"] == 6
    assert run("search", "계약서", "--from", "user1", "--json") == 0
    got = json.loads(capsys.readouterr().out)
    assert len(got["hits"]) == 2 and not got["more_available"]
    assert run("search", "nothing-like-this") == 0
    assert "! nothing-like-this: 0건" in capsys.readouterr().out
    assert run("search", "검토", "--csv", str(tmp_path / "hits.csv")) == 0
    assert len((tmp_path / "hits.csv").read_text(encoding="utf-8-sig").splitlines()) == 7
    assert run("export", "--out", str(tmp_path / "x.csv")) == 2
    assert run("export", "--all", "--out", str(tmp_path / "x.csv")) == 0
    assert run("export", "subject:검토", "--format", "eml", "--out", str(tmp_path / "eml")) == 0
    assert len(list((tmp_path / "eml").glob("*.eml"))) == 6
    capsys.readouterr()
    assert run("folders") == 0 and capsys.readouterr().out.split() == ["Inbox"]
    message = f"{tmp_path}/a.pst-0"
    assert run("show", message) == 0 and "계약서 검토 0" in capsys.readouterr().out
    assert run("show", message, "--highlight", "검토 from:user") == 0 and "계약서 <em>검토</em> 0" in capsys.readouterr().out
    assert run("show", "none") == 1
    assert run("attach", message, "--out", str(tmp_path / "out")) == 0
    assert (tmp_path / "out" / "계약서.pdf").read_bytes() == b"content 0"
