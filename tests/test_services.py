"""The fetch cascade and structured model calls against services that fail, are busy, or answer in odd forms."""

from sieveline.plans import audit
from sieveline.sources import providers, tables


class Reply:
    def __init__(self, data=None, text=""):
        self.data, self.text = data, text

    def raise_for_status(self):
        pass

    def json(self):
        return self.data


class Library:
    """A lookup service that knows a paper by the number at its DOI's end."""

    def get(self, url, params, timeout):
        if url == providers.ID_SERVICE:
            n = int(params["ids"].rsplit("/", 1)[1])
            if n % 5 == 4:
                raise ConnectionError("down")
            found = {0: {"status": "error"}, 3: {"pmid": str(n)}}.get(n % 5, {"pmid": str(n), "pmcid": f"PMC{n}"})
            return Reply({"records": [found]})
        if url.endswith("esearch.fcgi"):
            n = int(params["term"].removesuffix("[DOI]").rsplit("/", 1)[1])
            return Reply({"esearchresult": {"idlist": [] if n % 10 == 0 else [str(n)]}})
        n = int(params["id"])
        if params["db"] == "pubmed":
            return Reply(text=f" abstract of {n}\n")
        return Reply(text=f"<article><body><title>Paper {n}</title><p>{'word ' * (250 if n % 5 == 1 else 20)}</p></body></article>")


def test_fetch_cascade(spark):
    """Full text, else abstract, else nothing; a lost connection is the paper's own failure."""
    papers = [(f"ST-{n}", None if n % 7 == 6 else f"10.1/{n}") for n in range(70)]
    frame = spark.createDataFrame(papers, "paper_id string, doi string")
    rows = providers.fetch_texts(frame, lambda: providers.Literature(Library(), interval=0.0), 4).collect()
    assert len(rows) == 70
    for r in rows:
        n = int(r.paper_id[3:])
        full = f"## Paper {n}\n" + ("word " * 250).strip()
        want = {1: ("ok", "pmc_fulltext", full), 4: ("failed", None, None)}.get(n % 5, ("ok", "pubmed_abstract", f"abstract of {n}"))
        want = ("unavailable", None, None) if n % 10 == 0 else want
        want = ("no_doi", None, None) if n % 7 == 6 else want
        assert (r.status, r.text_source, r.text) == want
        assert r.error == ("down" if want[0] == "failed" else None)


class Busy(providers.Overloaded):
    pass


class Client:
    """A model's client that is busy as often as the message says, then fills in the form."""

    def __init__(self):
        self.messages, self.asked = self, {}

    def create(self, **request):
        message, name = request["messages"][0]["content"], request["tool_choice"]["name"]
        self.asked[message] = self.asked.get(message, 0) + 1
        if self.asked[message] <= int(message.split(" ")[0]):
            raise Busy("busy")
        given = {"rows": [], "summary_paragraph": f"{self.asked[message]} {name} {request['max_tokens']} {message}"}
        form = {"type": "tool_use", "name": name, "input": given}
        return type("Answer", (), {"content": [] if message.endswith("odd") else [{"type": "text"}, form]})


def test_model_calls(spark):
    """Retries, the forced form, replies without it, and errors that stay in their rows."""
    messages = [(str(i), "ephys", f"{i % 7} item {i}{' odd' if i % 4 == 0 else ''}") for i in range(56)]
    frame = spark.createDataFrame(messages, "paper_id string, modality string, message string")
    model = providers.client_model(Client, providers.EXTRACTION, "any")
    for r in providers.answers(frame, model, lambda seconds: None, providers.EXTRACTION).collect():
        i = int(r.paper_id)
        if i % 7 >= 5:
            assert (r.json, r.error) == (None, "no answer after 5 attempts: busy")
        elif i % 4 == 0:
            assert (r.json, r.error) == (None, "the reply has no record_extraction form")
        else:
            assert f"{i % 7 + 1} record_extraction 8000 {i % 7} item {i}" in r.json and r.error is None


def test_reextraction_keeps_failures_apart(spark):
    def model():
        def ask(message):
            if " the " not in message.lower():
                raise LookupError("no reply")
            return '{"rows": [], "summary_paragraph": "of the paper"}'

        return ask

    work = spark.createDataFrame([(f"p{i}", "ephys", "of the kind" if i % 3 else "other", "") for i in range(30)], "paper_id string, modality string, text string, text_source string")
    prompts = spark.createDataFrame([("ephys", "Ask.")], "modality string, prompt string")
    got = audit.reextract(work, spark.createDataFrame([], "paper_id string, modality string"), prompts, model).collect()
    assert {(r.json is None, r.error) for r in got if int(r.paper_id[1:]) % 3 == 0} == {(True, "no reply")} and len(got) == 30


def test_form_comes_from_the_schema():
    """Notes and role are the caller's; what can't be null is required."""
    asked = providers.VERIFICATION.told("Be brief.", {"verdict": "What you think."}).request("m", "text")
    assert asked["system"] == "Be brief." and asked["max_tokens"] == 4000
    form = asked["tools"][0]["input_schema"]["properties"]["verdicts"]["items"]
    assert form["required"] == ["field_name", "verdict", "confidence", "explanation"]
    assert form["properties"]["verdict"] == {"type": "string", "description": "What you think.", "enum": ["match", "partial", "mismatch", "unverifiable"]}
    assert form["properties"]["evidence_quote"] == {"type": "string"}
    rows = providers.EXTRACTION.request("m", "text")["tools"][0]["input_schema"]["properties"]["rows"]["items"]
    assert rows["properties"]["fields"] == {"type": "object", "additionalProperties": {"type": "string"}}
    assert rows["required"] == ["row_label", "fields"]


def test_prompts_from_files(spark, tmp_path):
    for name in ("anatomical", "ephys", "else"):
        (tmp_path / f"{name}.txt").write_text(f"\n Ask about {name}.\n\n")
    got = {tuple(r) for r in tables.read_prompts(spark, str(tmp_path)).collect()}
    assert got == {("anatomical", "Ask about anatomical."), ("ephys", "Ask about ephys.")}


def test_local_cache_deals_texts_out_once(spark):
    """However large all sides are, texts pass through one exchange; of a paper's registry rows each gives a row, and a paper may have none."""
    files = spark.createDataFrame([("a", "txt", "one"), ("b", "pdf", "two"), ("c", "txt", "three")], "file string, suffix string, text string")
    claims = [("a", "P1", "doi", 0.95, "matched"), ("b", "P2", "title", 0.5, "matched"), ("c", "P1", "doi", 0.95, "superseded")]
    manifest = spark.createDataFrame(claims, "file string, paper_id string, match_method string, confidence double, status string")
    registry = spark.createDataFrame([("P1", "10.1/a"), ("P1", "10.1/b")], "paper_id string, doi string")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        rows = providers.local_cache(files, manifest, registry)
        plan = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        nodes = [node for node in plan.split("\n\n") if ") Exchange\n" in node]
        assert sum("text#" in node for node in nodes) == 1
        got = {tuple(r) for r in rows.select("source_file", "paper_id", "doi", "text_source", "text", "match_confidence").collect()}
    finally:
        spark.conf.set(limit, before)
    assert got == {
        ("a", "P1", "10.1/a", "local_txt", "one", 0.95), ("a", "P1", "10.1/b", "local_txt", "one", 0.95), ("b", "P2", None, "local_pdf", "two", 0.5)
    }
