"""Matching, claims, records, scores, dashboard, sources and providers."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sieveline.operators import dashboard, matching, records, score
from sieveline.operators.article import parse_articles
from sieveline.plans import audit
from sieveline.sources import files, providers, tables

REGISTRY = "ord long, paper_id string, doi string, title string"
FILES = "file string, stem string, text string"


def registry(spark):
    return spark.createDataFrame(
        [
            (0, "AIM-1", "10.1/a", "Zebra pathways in the quiet brain"),
            (1, "AIM-11", "10.1/b", "Unrelated words entirely elsewhere"),
            (2, "aim 1", None, ""),
            (3, "X-9", "10.1/b", "Zebra pathways in the quiet brain")
        ],
        REGISTRY
    )


def matched(spark, *rows):
    return {
        r.file: (r.paper_id, r.match_method, r.confidence, r.status) for r in matching.match_files(
            spark.createDataFrame(rows, FILES), registry(spark)
        ).collect()
    }


def test_cascade(spark):
    far = "x " * 1600 + "10.1/a"
    got = matched(
        spark, ("1", "aim_1", "any"), ("2", "AIM-1(1)", "no words"), (
            "3", "s", "see 10.1234/zz and https://doi.org/10.1/b"
        ), ("4", "s", "About ZEBRA pathways: brain, quiet."), ("5", "s", " \n"), ("6", "s", None), ("7", "", "zz"), ("8", "s", far),
    )
    assert got["1"] == ("AIM-1", "filename", 1.0, "matched")
    assert got["2"] == ("", "unmatched", 0.0, "unmatched")
    assert got["3"][1] == "unmatched"  # DOIs of four digits at least are looked for
    assert got["4"] == ("AIM-1", "title", 0.667, "matched")
    assert got["5"] == got["6"] == ("", "extraction_failed", 0.0, "failed")
    assert got["7"][3] == got["8"][3] == "unmatched"


def test_first_doi_wins_and_last_row_of_equal_dois(spark):
    reg = spark.createDataFrame([(0, "A", "10.1111/a", ""), (1, "B", "10.2222/b", ""), (2, "C", "10.2222/b", "")], REGISTRY)
    rows = [("1", "s", "cites 10.9999/q, 10.2222/b). and 10.1111/a"), ("2", "s", "y" * 2996 + " 10.1111/a")]
    got = {r.file: r.paper_id for r in matching.by_doi(spark.createDataFrame(rows, FILES), reg).collect()}
    assert got == {"1": "C"}


def test_titles_equal_a_plain_loop(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(25)]
    reg = [(i, f"P{i}", None, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 7)))) for i in range(40)]
    texts = [(str(i), "s", " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 12)))) for i in range(60)]
    want = {}
    for f, _, t in texts:
        best, top = None, 0.0
        for _, p, _, title in reg:
            words = set(title.split())
            value = len(words & set(t.split())) / len(words) if words else 0
            if value > top:
                best, top = p, value
        if top >= 0.5:
            want[f] = (best, top)
    got = {
        r.file: (r.paper_id, r.score) for r in matching.by_title(
            spark.createDataFrame(texts, FILES), spark.createDataFrame(reg, REGISTRY)
        ).collect()
    }
    assert got == want


def test_claims_equal_a_plain_loop(spark):
    rnd = random.Random(3)
    rows = [
        (f"f{i:03}", f"P{rnd.randrange(9)}", "title", rnd.choice([0.5, 0.667, 0.95, 1.0]), "matched") for i in range(120)
    ] + [("zz", "", "unmatched", 0.0, "unmatched")]
    state, best = {}, {}
    for f, p, _, c, s in rows:
        state[f] = s
        if s == "matched":
            if p in best and best[p][1] >= c:
                state[f] = "duplicate_match"
                continue
            if p in best:
                state[best[p][0]] = "superseded"
            best[p] = (f, c)
    df = spark.createDataFrame(rows, "file string, paper_id string, match_method string, confidence double, status string")
    assert {r.file: r.status for r in matching.settle_claims(df).collect()} == state


def test_flatten_and_render(spark):
    raw = spark.createDataFrame(
        [
            (
                "P",
                "ephys",
                json.dumps(
                    {
                        "rows": [{"row_label": "g", "fields": {"a": "1", "b": "2"}}, {"row_label": "h", "fields": {}}],
                        "summary_paragraph": " s "
                    }
                )
            ),
            ("Q", "ephys", '{"rows": []}'),
            ("R", "ephys", "{}"),
            ("S", "ephys", "broken")
        ],
        "paper_id string, modality string, json string"
    )
    flat = records.flatten_extractions(raw)
    got = sorted((r.paper_id, r.row_index, r.row_label, r.fields, r.summary_paragraph) for r in flat.collect())
    assert got[:2] == [("P", 0, "g", {"a": "1", "b": "2"}, "s"), ("P", 1, "h", {}, "s")]
    assert all(r[2] == records.SUMMARY_ONLY for r in got[2:]) and len(got) == 5
    assert [
        r.v for r in flat.where("paper_id = 'P'").orderBy("row_index").select(records.rendered("row_label", "fields").alias("v")).collect()
    ] == ["g — a: 1; b: 2", "h"]
    sums = {r.paper_id: r.summary for r in records.modality_summaries(flat).collect()}
    assert sums["P"] == "Overall summary: s\n- g: a: 1; b: 2" and sums["Q"] == "(model returned no itemized data)"


def test_verdict_rows(spark):
    body = {"verdicts": [{"thing_field": "Photometry Data", "verdict": "match", "confidence": "high"}, {"thing_field": "X"}]}
    raw = spark.createDataFrame(
        [("P", "ephys", json.dumps(body)), ("Q", "ephys", '{"verdicts": []}')], "paper_id string, modality string, json string"
    )
    got = [(r.field_name, r.verdict, r.confidence, r.evidence_quote) for r in records.flatten_verdicts(raw).orderBy("ord").collect()]
    assert got == [("Photometry Data", "match", "high", ""), ("X", "unverifiable", "", "")]


def test_side_by_side(spark):
    reg = spark.createDataFrame(
        [(0, "P", "T", "traced", "x")], "ord long, paper_id string, title string, `Anatomical connections` string, `Photometry Data` string"
    )
    raw = spark.createDataFrame(
        [
            ("P", "anatomical", json.dumps({"rows": [{"row_label": "r", "fields": {"k": "v"}}], "summary_paragraph": "sum"})),
            ("P", "ephys", '{"rows": []}')
        ],
        "paper_id string, modality string, json string"
    )
    out = records.side_by_side(reg, records.flatten_extractions(raw)).orderBy("ord", "mod_ord", "field_ord", "kind", "row_index").collect()
    assert len({r.field_name for r in out}) == 6
    assert [
        (r.row_label, r.found_value) for r in out if r.field_name == "Anatomical connections"
    ] == [("(overall summary)", "sum"), ("r", "r — k: v")]
    assert [r.found_value for r in out if r.modality == "ephys"] == [records.NO_DATA] and [
        r.found_value for r in out if r.modality == "photometry"
    ] == [records.NOT_YET]
    with pytest.raises(ValueError):
        records.audited_fields(spark, ["nope"])


VERDICTS = "paper_id string, modality string, field_name string, verdict string, confidence string"


def scored(spark, rows):
    return score.reliability(spark.createDataFrame([("P", "m", "f", v, c) for v, c in rows], VERDICTS)).first()


def test_reliability(spark):
    none = scored(spark, [])
    assert (none.raw_score_10, none.shrunk_score_10) == (None, 5.0)
    assert scored(spark, [("match", "high")] * 50).shrunk_score_10 == 9.5 and scored(spark, [("mismatch", "high")] * 50).raw_score_10 == 0.0
    assert scored(spark, [("partial", "low")]).shrunk_score_10 == 5.0
    odd = scored(spark, [("unverifiable", ""), ("odd", "high"), ("match", "sure")])
    assert (odd.n_field_verdicts, odd.n_scored_verdicts, odd.raw_fraction) == (3, 0, None)
    few, many = scored(spark, [("match", "high")] * 2), scored(spark, [("match", "high")] * 200)
    assert few.shrunk_score_10 < many.shrunk_score_10 <= 10
    text = score.report(
        few,
        [
            Row(field_name="f", match=2, partial=0, mismatch=0, unverifiable=0),
            Row(field_name="g", match=0, partial=0, mismatch=0, unverifiable=0)
        ],
        71
    )
    assert "CAUTION" in text and "f: match=2" in text and "g:" not in text


def test_breakdown_keeps_zeros_and_unknowns(spark):
    df = spark.createDataFrame(
        [("P", "m", "a", "match", "high"), ("P", "m", "b", "odd", "high"), ("P", "m", None, "match", "high")], VERDICTS
    )
    assert {
        r.field_name: (r.match, r.mismatch) for r in score.verdict_counts(df, "field_name").collect()
    } == {"a": (1, 0), "b": (0, 0), "unknown": (1, 0)}


def test_registry_csv_and_dashboard(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        '﻿"Reference ID","Title","Authors","DOI","Authors and Publication Year","Anatomical connections","Photometry Data"\n"AIM-10","T ""q"" x\nline","A","https://doi.org/10.1/z","A; B; 2019"," yes ",""\n" ","gone","","","","",""\n"AIM-2","U <b>","B","","","",""\n',
        encoding="utf-8"
    )
    reg = tables.read_registry(spark, str(tmp_path / "r.csv"))
    assert [(r.paper_id, r.doi_key) for r in reg.orderBy("ord").collect()] == [("AIM-10", "10.1/z"), ("AIM-2", None)]
    manifest = spark.createDataFrame(
        [(0, "AIM-10", "title", 0.5, "matched"), (1, "AIM-10", "filename", 0.4, "duplicate_match"), (2, "", "unmatched", 0.0, "unmatched")],
        "ord long, paper_id string, match_method string, confidence double, status string"
    )
    rows = dashboard.paper_rows(reg, dashboard.last_claims(manifest))
    first = dashboard.ordered(rows).collect()
    assert [r.id for r in first] == ["AIM-2", "AIM-10"]
    top = first[1]
    assert (
        top.title, top.year, top.anatomical_text, top.has_anatomical, top.has_photometry, top.matched, top.confidence, top.match_method
    ) == ('T "q" x\nline', "2019", "yes", True, False, True, 0.4, "filename")
    assert dashboard.last_claims(manifest, matched_only=True).first().confidence == 0.5
    assert [r.id for r in dashboard.searched(rows, "YES").collect()] == ["AIM-10"] and dashboard.with_status(rows, "missing").count() == 1
    assert [r.id for r in dashboard.ordered(rows, "confidence", True).collect()] == ["AIM-10", "AIM-2"]
    page = dashboard.overview_page(first, [Row(x="</script>__DATA_JSON__")], "<s>__DATA_JSON__</s><s>__VERIFICATION_JSON__</s>")
    assert page.count("</script>") == 0 and page.count("__DATA_JSON__") == 1


def test_pages_escape(spark):
    v = spark.createDataFrame(
        [("P", "m", "f", "match", "high", "<i>", "q", "T&", "r"), ("P", "m", "f", "mismatch", "high", "e", "q", "T", "r")],
        VERDICTS + ", explanation string, evidence_quote string, title string, recorded_value string"
    )
    page = dashboard.triage_page(v)
    assert "&lt;i&gt;" in page and "T&amp;" in page and page.index("mismatch") < page.index(">match<")


def test_files(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.TXT").write_bytes(b"one\r\ntwo\rthree \xff")
    (folder / "sub" / "b.md").write_bytes(b"")
    (folder / "README.md").write_text("no")
    (folder / "c.pdf").write_bytes(b"not a pdf")
    (folder / "d.doc").write_bytes(b"x")
    got = {r.stem: (r.suffix, r.text) for r in files.load_texts(spark, f"file://{folder}", True).collect()}
    assert got == {"a": ("txt", "one\ntwo\nthree �"), "b": ("md", ""), "c": ("pdf", None)}
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, f"file://{folder}/none")
    with pytest.raises(files.UnsupportedFileType):
        files.list_files(spark, f"file://{folder}/d.doc")


def test_csv_round_trip(spark, tmp_path):
    flat = records.flatten_extractions(
        spark.createDataFrame(
            [("P", "ephys", json.dumps({"rows": [{"row_label": 'a "b", c', "fields": {"k": "v\nw"}}]}))],
            "paper_id string, modality string, json string"
        )
    )
    tables.write_flat(flat, str(tmp_path / "flat"))
    back = tables.read_flat(spark, str(tmp_path / "flat")).first()
    assert (back.row_label, back.fields, back.row_index) == ('a "b", c', {"k": "v\nw"}, 0)
    assert tables.read_table(spark, str(tmp_path / "none"), tables.VERDICTS).count() == 0


XML = "<article><front><p>no</p></front><body><sec><title>One</title><p>A <italic>b</italic>\n c</p><fig><caption><p>Cap</p></caption></fig></sec><title> </title></body></article>"


def test_xml():
    assert files.flat_xml_text(XML) == "## One\nA b c\nCap"
    assert files.flat_xml_text("<a/>") is None and files.flat_xml_text("<a") is None and files.flat_xml_text(None) is None


class Answer:
    def __init__(self, data=None, text=""):
        self.data, self.text = data, text

    def raise_for_status(self):
        pass

    def json(self):
        return self.data


class Web:
    def __init__(self, *answers):
        self.answers, self.calls = list(answers), []

    def get(self, url, params, timeout):
        self.calls.append((url, params))
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def client(*answers, **more):
    return providers.Literature(Web(*answers), sleep=lambda s: None, **more)


def test_fetch_cascade():
    long = XML.replace("Cap", "word " * 210)
    ok = client(Answer({"records": [{"pmid": "1", "pmcid": "PMC7"}]}), Answer(text=long), api_key="k")
    row = ok.fetch("P", "10.1/a")
    assert (
        row["status"], row["text_source"], ok.session.calls[1][1]["id"], ok.session.calls[0][1]["api_key"]
    ) == ("ok", "pmc_fulltext", "7", "k")
    short = client(Answer({"records": [{"pmid": "1", "pmcid": "PMC7"}]}), Answer(text=XML), Answer(text=" abstract ")).fetch("P", "10.1/a")
    assert (short["text_source"], short["text"]) == ("pubmed_abstract", "abstract")
    none = client(Answer({"records": [{"status": "error"}]}), Answer({"esearchresult": {"idlist": []}})).fetch("P", "10.1/a")
    assert none["status"] == "unavailable" and client().fetch("P", None)["status"] == "no_doi"
    assert client(OSError("down")).fetch("P", "10.1/a")["error"] == "down"


def test_rate_limit():
    now, slept = [0.0], []
    c = providers.Literature(Web(*[Answer({"esearchresult": {"idlist": ["5"]}})] * 3), clock=lambda: now[0], sleep=slept.append)
    assert [c.search("d") for _ in range(3)] == ["5"] * 3 and [round(s, 3) for s in slept] == [0.333, 0.333]


def test_retries():
    slept, tries = [], []

    def flaky(message):
        tries.append(message)
        if len(tries) < 4:
            raise providers.Overloaded("busy")
        return "{}"

    assert providers.asked(flaky, "m", slept.append) == "{}" and slept == [1, 2, 4]
    with pytest.raises(RuntimeError):
        providers.asked(lambda m: (_ for _ in ()).throw(providers.Overloaded("x")), "m", slept.append)
    with pytest.raises(KeyError):
        providers.asked(lambda m: {}["x"], "m", slept.append)


def test_model_answers_keep_errors_apart(spark):
    messages = spark.createDataFrame(
        [("P", "ephys", "about cats"), ("Q", "ephys", "about dogs")], "paper_id string, modality string, message string"
    )
    got = {r.paper_id: (r.json, r.error) for r in providers.answers(messages, providers.recorded_model({"cats": '{"rows": []}'})).collect()}
    assert got["P"] == ('{"rows": []}', None) and got["Q"][0] is None and "no recorded reply" in got["Q"][1]


def test_messages_and_cache(spark):
    df = spark.createDataFrame(
        [("t", "local_pdf"), ("t", ""), ("t", "else"), ("t", None)], "text string, src string"
    ).select(providers.extraction_message("text", "src", F.lit("do")).alias("m"))
    got = [r.m for r in df.collect()]
    assert "locally supplied PDF" in got[0] and "UNKNOWN SOURCE" in got[1] and 'source="else"' in got[2] and "UNKNOWN SOURCE" in got[3]
    cache = spark.createDataFrame([("A", "ok"), ("B", "failed"), ("C", "no_doi")], "paper_id string, status string")
    papers = spark.createDataFrame([("A",), ("B",), ("D",)], "paper_id string")
    assert sorted(
        r[0] for r in providers.to_do(papers, cache).collect()
    ) == ["B", "D"] and providers.to_do(papers, cache, True).count() == 3


class Block:
    def __init__(self, **own):
        self.__dict__.update(own)


class RateLimitError(Exception):
    """Named as a client library names it."""


class Client:
    """Stands in for a client library: fails twice, then answers with the form that it was forced to use."""

    def __init__(self, given, failures=2):
        self.messages, self.given, self.failures, self.requests = self, given, failures, []

    def create(self, **request):
        self.requests.append(request)
        if len(self.requests) <= self.failures:
            raise RateLimitError("slow down")
        return Block(content=[Block(type="text", text="hm"), Block(type="tool_use", name=request["tool_choice"]["name"], input=self.given)])


@pytest.mark.parametrize(
    "contract,given,most",
    [(providers.EXTRACTION, {"rows": [], "summary_paragraph": "é"}, 8000), (providers.VERIFICATION, {"verdicts": []}, 4000)]
)
def test_model_contract(contract, given, most):
    client, slept = Client(given), []
    ask = providers.client_model(lambda: client, contract, "some-model")()
    assert json.loads(providers.asked(ask, "the message", slept.append)) == given and slept == [1, 2]
    request = client.requests[-1]
    assert (request["model"], request["max_tokens"], request["messages"]) == (
        "some-model", most, [{"role": "user", "content": "the message"}]
    )
    assert request["tool_choice"] == {"type": "tool", "name": contract.name} and [t["name"] for t in request["tools"]] == [contract.name]
    assert request["system"] == f"Answer with {contract.name}." and set(request["tools"][0]["input_schema"]["required"]) == set(given)
    for bad in ({}, {"other": 1}):
        with pytest.raises(ValueError, match="lacks"):
            providers.asked(providers.client_model(lambda: Client(bad, 0), contract, "m")(), "x", slept.append)
    with pytest.raises(ValueError, match="no .* form"):
        contract.answer([{"type": "text"}])
    with pytest.raises(RuntimeError, match="5 attempts"):
        providers.asked(providers.client_model(lambda: Client(given, 9), contract, "m")(), "x", slept.append)


def test_answers_that_break_the_contract_are_errors(spark):
    messages = spark.createDataFrame([("P", "ephys", "cats"), ("Q", "ephys", "dogs")], "paper_id string, modality string, message string")
    model = providers.recorded_model({"cats": '{"rows": [], "summary_paragraph": ""}', "dogs": "[1]"})
    got = {r.paper_id: r for r in providers.answers(messages, model, contract=providers.EXTRACTION).collect()}
    assert got["P"].error is None and got["Q"].json is None and "lacks" in got["Q"].error and "rows" in got["Q"].error


def test_odd_answers_of_services_stay_in_their_row():
    odd = client(Answer({"records": [{"pmcid": 7}]}), Answer({"esearchresult": {"idlist": []}})).fetch("P", "10.1/a")
    assert odd["status"] == "failed" and odd["error"]
    assert client(Answer({"records": "x"})).fetch("P", "10.1/a")["status"] == "failed"


class Page:
    def __init__(self, text):
        self.text = text

    def extract_text(self):
        return self.text


class Pdf:
    def __init__(self, *texts):
        self.pages = [Page(t) for t in texts]

    def __enter__(self):
        return self

    def __exit__(self, *why):
        return False


def test_readable_pdf(monkeypatch):
    """With stand-ins for both readers, as neither is installed here: the second is asked where the first finds nothing."""
    import sys
    from types import SimpleNamespace

    first = SimpleNamespace(open=lambda raw: Pdf("page one", None, "page three"))
    monkeypatch.setitem(sys.modules, "pdfplumber", first)
    monkeypatch.setitem(sys.modules, "pypdf", SimpleNamespace(PdfReader=lambda raw: Pdf("from the second")))
    assert files._pdf_text(b"%PDF") == "page one\n\npage three"
    first.open = lambda raw: Pdf(" ", None)
    assert files._pdf_text(b"%PDF") == "from the second"
    first.open = lambda raw: 1 / 0
    assert files._pdf_text(b"%PDF") == "from the second" and files._pdf_text(b"") is None


def test_contents_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    plan = files.load_texts(spark, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "content" not in line, line
    assert plan.count("content#") and sum("ReadSchema" in x and "content" in x.split("ReadSchema")[1] for x in plan.splitlines()) == 1


def test_stages_write_their_tables(spark, tmp_path):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    (folder / "AIM-1.txt").write_text("text of one")
    (folder / "other.txt").write_text("nothing known")
    (tmp_path / "r.csv").write_text("Reference ID,Title,DOI,Photometry Data\nAIM-1,One,10.1/a,seen\nAIM-2,Two,,\n")
    registry = f"file://{tmp_path}/r.csv"
    totals = audit.scrape_stage(spark, f"file://{folder}", registry, out)
    assert (totals.matched, totals.unmatched_files, totals.missing) == (1, 1, 1)
    assert sorted(r.status for r in tables.read_table(spark, f"{out}/manifest", tables.MANIFEST).collect()) == ["matched", "unmatched"]
    assert audit.local_log(spark, f"{out}/cache").state().first().text == "text of one"

    def literature():
        return client(Answer({"records": [{}]}), Answer({"esearchresult": {"idlist": ["5"]}}), Answer(text="an abstract"))

    counts = {r.outcome: r.n for r in audit.fetch_stage(spark, registry, f"{out}/texts", out, literature)}
    assert counts == {"pubmed_abstract": 1, "no_doi": 1}
    again = {r.outcome: r.n for r in audit.fetch_stage(spark, registry, f"{out}/texts", out, lambda: 1 / 0)}
    assert again == counts  # nothing is asked twice
    manifest = tables.read_csv(spark, f"{out}/fetch_manifest")
    assert manifest.columns == [
        "paper_id", "doi", "pmid", "pmcid", "text_source", "status", "fetched_at", "error"
    ] and manifest.count() == 2
    flat = records.flatten_extractions(
        spark.createDataFrame(
            [("AIM-1", "photometry", '{"rows": [], "summary_paragraph": " s "}')], "paper_id string, modality string, json string"
        )
    )
    tables.write_flat(flat, f"{out}/flat")
    audit.compare_stage(spark, registry, f"{out}/flat", out)
    side = tables.read_csv(spark, f"{out}/side_by_side")
    assert side.count() == 12 and [
        (r.recorded_value, r.reextracted_value) for r in side.where("paper_id = 'AIM-1' AND modality = 'photometry'").collect()
    ] == [("seen", "s")]
    assert audit.score_stage(spark, registry, f"{out}/none").startswith("Reliability score: 5.0/10")


def test_articles_in_files_of_their_own(spark, tmp_path):
    texts = spark.createDataFrame(
        [("in/a.txt", "A title that is long enough\n\nAbstract\nÉté."), ("in/z/a.md", "Another title of the same stem")],
        "f string, text string"
    )
    tables.write_articles(parse_articles(texts, source_file="f"), f"file://{tmp_path}/out")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a.json"]
    raw = (tmp_path / "out" / "a.json").read_text()
    body = json.loads(raw)
    assert body["title"] == "Another title of the same stem" and "\n" in raw and body["sections"] == {} and body["doi"] is None
    tables.write_articles(parse_articles(texts.limit(1), source_file="f"), f"file://{tmp_path}/one")
    assert "Été." in (tmp_path / "one" / "a.json").read_text()
