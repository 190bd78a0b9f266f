"""Quotes and braces are summed in short runs of pieces, so what one task holds does not follow the size of a byte range."""

import json

from tallyloom.sources import tables


def test_short_runs_give_the_same_elements(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "RUN", 1)
    rows = [{"id": k, "text": 'a } \\" { b' * (k % 3), "inner": {"x": {"y": "}{"}}} for k in range(60)]
    (tmp_path / "a.json").write_text(json.dumps(rows[:40]))
    (tmp_path / "b.json").write_text(json.dumps(rows[40:], indent=1) + "\n{ broken")
    found = tables.array_texts(spark, str(tmp_path / "*.json")).orderBy("place").collect()
    assert [json.loads(r.text) for r in found if r.whole] == rows
    assert [r.text.strip().endswith("{ broken") for r in found if not r.whole] == [True]
