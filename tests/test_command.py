"""Settings and the command line."""

import base64

import pytest

from folio import __main__ as command
from folio.config import Settings


def test_settings_come_from_defaults_environment_and_arguments():
    assert Settings.of({}) == Settings() and Settings.of({}).client() is None
    own = Settings.of({"FOLIO_URL": "http://a:1", "FOLIO_MODEL": "m", "FOLIO_TIMEOUT": "2.5"}, url="http://b:2", model=None)
    assert (own.url, own.model, own.timeout) == ("http://b:2", "m", 2.5)
    assert own.client().base_url == "http://b:2" and own.client().model == "m"


@pytest.fixture
def pages(spark, tmp_path):
    rows = [(1, 1, "# Intro\nThis is the intro."), (1, 2, "## Method\nWe weigh terms by rank.\nFig 1: the weights of all terms"), (2, 1, "# Other\nRivers flow.\n## More\nHills.")]
    spark.createDataFrame(rows, "doc_id long, page long, md string").write.parquet(str(tmp_path / "pages"))
    content = bytes(range(256)) * 20
    spark.createDataFrame([(1, 2, 0, "png", content, 80.0, 90.0, 842.0)], "doc_id long, page long, img_idx long, ext string, content binary, y0 double, y1 double, height double").write.parquet(str(tmp_path / "placed"))
    return tmp_path, content


def test_command_line(spark, pages, capsys, monkeypatch):
    at, content = pages
    assert command.main([str(at / "pages"), "-q", "how are terms weighed by rank", "--doc", "1"]) == 0
    assert "[1] We weigh terms by rank." in capsys.readouterr().out
    assert command.main([str(at / "pages"), str(at / "placed"), "--images", str(at / "out")]) == 0
    files = [p for p in (at / "out").rglob("*.png")]
    assert len(files) == 1 and base64.b64encode(files[0].read_bytes()) == base64.b64encode(content) and "1 images" in capsys.readouterr().out
    assert command.main([str(at / "pages"), "--export", str(at / "texts")]) == 0 and (at / "texts/doc_id=1").is_dir()
    assert command.main([str(at / "pages"), "--kind", "pdf", "-q", "x"]) == 1
    assert command.main([str(at / "pages"), "-q", "x", "--model", "m", "--url", "http://127.0.0.1:9"]) == 1
    typed = iter(["", "rivers", "quit"])
    monkeypatch.setattr("builtins.input", lambda prompt: next(typed))
    assert command.main([str(at / "pages"), "-i", "--doc", "2"]) == 0
