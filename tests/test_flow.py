"""The audit from files to report, the stream, the command line, and the driver's entry."""

import json
import threading
import time
import urllib.error
import urllib.request

import pytest

import __spark_entry__
from sieveline import cli
from sieveline.operators import records
from sieveline.plans import audit, catalog, web
from sieveline.plans.runner import StageRunner, status_counts
from sieveline.sources import providers, tables
from sieveline.streaming import ingest

VERDICT = {"verdicts": [{"some_field": "Photometry Data", "verdict": "match", "confidence": "high"}]}


def test_audit_end_to_end(spark, tmp_path):
    papers = tmp_path / "papers"
    papers.mkdir()
    (papers / "AIM-1.txt").write_text("Some text about cats")
    (papers / "copy.txt").write_text("doi 10.1234/one more on cats")
    (papers / "other.txt").write_text("zz")
    (papers / "README.md").write_text("no")
    (tmp_path / "r.csv").write_text(
        '"Reference ID","DOI","Title","Photometry Data"\n"AIM-1","10.1234/one","Quite another title","flat"\n"AIM-2","","Second",""\n'
    )
    reg = tables.read_registry(spark, str(tmp_path / "r.csv"))
    manifest, cache = audit.scrape(spark, f"file://{papers}", reg)
    state = {r.file.rsplit("/", 1)[1]: r.status for r in manifest.collect()}
    assert state == {"AIM-1.txt": "matched", "copy.txt": "duplicate_match", "other.txt": "unmatched"}
    work = audit.pairs(audit.chosen_papers(reg, limit=1), cache, ["photometry"])
    assert [(r.paper_id, r.text_source) for r in work.collect()] == [("AIM-1", "local_txt")]
    none = spark.createDataFrame([], "paper_id string, modality string")
    prompts = spark.createDataFrame([("photometry", "look")], "modality string, prompt string")
    model = providers.recorded_model(
        {"recorded_values": json.dumps(VERDICT), "cats": json.dumps({"rows": [], "summary_paragraph": "seen"})}
    )
    flat = records.flatten_extractions(audit.reextract(work, none, prompts, model))
    assert flat.first().summary_paragraph == "seen" and audit.reextract(work, work, prompts, model).count() == 0
    verdicts = records.flatten_verdicts(audit.verify(work, none, reg, flat, model))
    assert verdicts.first().field_name == "Photometry Data"
    assert "1/2 papers" in audit.reliability_report(verdicts, reg)


def test_stream(spark, tmp_path):
    folder, table, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.txt").write_text("A title that is long enough\nAnn A, Bob B\n")
        ingest.keep(ingest.article_stream(spark, folder), table, mark).awaitTermination()
    assert spark.read.parquet(table).count() == 2


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_text("A title that is long enough\nAnn A, Bob B\n")
    (folder / "sub" / "b.md").write_text("Another title, long enough too\n")
    assert cli.main([f"file://{folder}/a.txt"]) == 0
    shown = capsys.readouterr().out
    assert json.loads(shown)["authors"] == ["Ann A", "Bob B"] and "\n  " in shown
    assert cli.main([f"file://{folder}/a.txt", "-o", f"file://{tmp_path}/one.json"]) == 0
    assert json.loads((tmp_path / "one.json").read_text())["title"] == "A title that is long enough"
    assert cli.main([f"file://{folder}", "-o", f"file://{tmp_path}/out", "--summary-csv", f"file://{tmp_path}/s"]) == 0
    assert {p.name for p in (tmp_path / "out").glob("*.json")} == {"a.json", "b.json"}
    assert [r.authors for r in tables.read_csv(spark, f"file://{tmp_path}/s").orderBy("source_file").collect()] == ["Ann A; Bob B", ""]
    (folder / "c.pdf").write_bytes(b"no pdf")
    assert cli.main([f"file://{folder}", "-o", f"file://{tmp_path}/out"]) == 1 and "c.pdf" in capsys.readouterr().err
    assert cli.main([f"file://{tmp_path}/none"]) == 1


def test_front_end(spark):
    gate, seen = threading.Event(), []
    runner = StageRunner(spark)
    stages = {"scrape": lambda limit: seen.append(limit) or gate.wait(20), "verify": lambda limit: 1}
    front = web.FrontEnd(runner, {"/": lambda: "<h1>é</h1>"}, lambda: {"cached": 3}, stages)
    serving = web.server(front)
    threading.Thread(target=serving.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{serving.server_port}"
    try:
        with urllib.request.urlopen(f"{at}/?x=1") as answer:
            assert answer.read().decode() == "<h1>é</h1>" and "html" in answer.headers["Content-Type"]
        post = lambda name: json.load(urllib.request.urlopen(f"{at}/api/run/{name}", data=b"limit=5"))
        assert post("scrape") == {"started": True} and post("verify") == {"started": False}
        while not seen:  # the stage starts in a thread of its own
            time.sleep(0.01)
        status = json.load(urllib.request.urlopen(f"{at}/api/status"))
        assert status["running"] == "scrape" and status["cached"] == 3 and "scrape: started" in status["log"][0]
        gate.set()
        runner.wait()
        assert seen == [5] and post("verify") == {"started": True}
        for path in ("/none", "/api/run/none"):
            with pytest.raises(urllib.error.HTTPError):
                urllib.request.urlopen(f"{at}{path}", data=b"" if "run" in path else None)
    finally:
        serving.shutdown()
        serving.server_close()


def test_entry_and_names(spark):
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and set(catalog.queries()) <= set(found)
    assert __spark_entry__.entry(spark).count() == 1


def test_one_stage_at_a_time(spark):
    gate = threading.Event()
    runner = StageRunner(spark)
    assert runner.start("scrape", gate.wait) and not runner.start("verify", lambda: 1) and runner.current == "scrape"
    gate.set()
    runner.wait()
    assert runner.current is None and runner.start("verify", lambda: 1 / 0)
    runner.wait()
    assert "division" in runner.recent()[-1]
    for k in range(400):
        runner.log(str(k))
    assert len(runner.recent()) == 80


def test_status_and_prompts(spark, tmp_path):
    cache = spark.createDataFrame([("A", "t"), ("B", None)], "paper_id string, text string")
    assert tuple(status_counts(cache, cache, cache.limit(0)).first()) == (1, 2, 0)
    (tmp_path / "ephys.txt").write_text(" look\nhere \n")
    (tmp_path / "other.txt").write_text("no")
    assert [tuple(r) for r in tables.read_prompts(spark, str(tmp_path)).collect()] == [("ephys", "look\nhere")]
