"""Article fields on an invented article, and the column rules against plain Python on awkward strings."""

import random
import re

from pyspark.sql import functions as F

from sieveline.functions.text import is_upper, lines, normal_doi, strip, words
from sieveline.operators import article
from sieveline.operators.article import parse_articles, summary_rows

ARTICLE = """Annals of Sample Journal, Vol. 3
A Careful Study of Invented Things
Ada Bee1, Cy Dee*, and Eff G. Gee
University of Nowhere
ada.bee@nowhere.example, cy@x.example; ada.bee@nowhere.example
Received: 2 May 2021; first draft 1999
DOI: 10.1234/inv.2021.00042.

Abstract
We study invented things
with care.
Keywords: things, invention; care.

1. Introduction
Things exist. They were first seen in 1987.

II. Materials and Methods
We looked.

Results
It works.

Discussion
Indeed.

Results
Again it works.

References
[1] First, A. Paper one.
[2] Second, B.
Paper two.
3. Third, C. Paper three.
"""


def one(spark, text):
    return parse_articles(spark.createDataFrame([("a.txt", text)], "source_file string, text string")).first()


def test_invented_article(spark):
    got = one(spark, ARTICLE)
    assert got.title == "A Careful Study of Invented Things"
    assert got.authors == ["Ada Bee", "Cy Dee", "Eff G. Gee"]
    assert got.emails == ["ada.bee@nowhere.example", "cy@x.example"]
    assert (got.doi, got.publication_year, got.journal) == ("10.1234/inv.2021.00042", "2021", "Annals of Sample Journal, Vol. 3")
    assert got.abstract == "We study invented things\nwith care." and got.keywords == ["things", "invention", "care"]
    sections = {s.name: s.body for s in got.sections}
    assert list(sections) == ["abstract", "introduction", "methods", "results", "discussion"]
    assert sections["results"] == "It works.\nAgain it works." and sections["abstract"] == got.abstract
    assert got.references == ["First, A. Paper one.", "Second, B. Paper two.", "Third, C. Paper three."]
    assert got.word_count == len(ARTICLE.split()) and got.affiliations == []


def test_without_headers(spark):
    got = one(spark, "A title that is long enough\nAda & Bob\n\nAbstract: This is it.\nKeywords: a\nIntroduction here")
    assert (got.title, got.authors, got.abstract, got.sections, got.references) == (
        "A title that is long enough", ["Ada", "Bob"], "This is it.", [], []
    )
    empty = one(spark, None)
    assert (empty.title, empty.doi, empty.publication_year, empty.keywords, empty.word_count) == (None, None, None, [], 0)


def test_references_without_markers(spark):
    got = one(spark, "References\nA first long entry\nshort\n  Another entry here\n")
    assert got.references == ["A first long entry", "Another entry here"] and got.title is None


def test_summary_columns(spark):
    df = parse_articles(spark.createDataFrame([("a.txt", ARTICLE)], "source_file string, text string"))
    assert summary_rows(df).columns == ["source_file", "title", "authors", "doi", "journal", "publication_year", "word_count"]
    assert summary_rows(df).first().authors == "Ada Bee; Cy Dee; Eff G. Gee"


def test_text_rules_equal_python(spark):
    rnd = random.Random(7)
    alphabet = ["a", "B", "é", " ", "\t", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", "1", ".", "ß"]
    texts = ["", "\n", "a\n", "\r\n\r\n"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = df.select("t", strip("t").alias("s"), lines("t").alias("l"), words("t").alias("w"), is_upper(F.col("t")).alias("u")).collect()
    for r in got:
        assert r.s == r.t.strip() and r.l == r.t.splitlines() and r.w == r.t.split(), repr(r.t)
        assert r.u == r.t.isupper(), repr(r.t)


def test_doi_forms(spark):
    rows = [
        ("https://doi.org/10.1/X ", "10.1/X"),
        ("HTTP://DX.doi.org/10.1/x/", "10.1/x"),
        (" ", None),
        (None, None),
        ("/ /", None),
        ("10.1/y", "10.1/y")
    ]
    got = spark.createDataFrame(rows, "t string, want string").select(normal_doi("t").alias("d"), "want").collect()
    assert all(r.d == r.want for r in got)


def test_parser_equals_python_on_random_documents(spark):
    """Sections, title and journal against a plain restatement of the rules."""
    rnd = random.Random(11)
    pool = [
        "Abstract",
        "1. Introduction",
        "iv. results",
        "RESULTS:",
        "references",
        "The journal of x",
        "An ordinary line of text",
        "SHOUTED WORDS HERE",
        "x@y.zz is a mail",
        "doi: 10.1234/abc",
        "",
        "  ",
        "short",
        "2. Methods and more",
        "Conclusions and future work",
        "© 2001 someone",
        "University of A, and B",
        "Ann A, Bob B"
    ]
    texts = [rnd.choice(["\n", "\r\n"]).join(rnd.choice(pool) for _ in range(rnd.randrange(14))) for _ in range(300)]
    aliases = __import__("sieveline.operators.article", fromlist=["SECTION_ALIASES"]).SECTION_ALIASES

    def plain(text):
        ls = text.splitlines()
        heads = []
        for i, line in enumerate(ls):
            clean = re.sub(r"(?i)^\s*(?:[0-9]+(?:\.[0-9]+)*\.?|[ivxlc]+\.?)\s+", "", line.strip()).strip(" :\t").lower()
            if line.strip() and len(line.strip()) <= 60 and clean in aliases:
                heads.append((i, aliases[clean]))
        bodies = {}
        for k, (i, name) in enumerate(heads):
            body = "\n".join(ls[i + 1 : heads[k + 1][0] if k + 1 < len(heads) else len(ls)]).strip()
            bodies[name] = f"{bodies[name]}\n{body}".strip() if name in bodies else body
        front = [x.strip() for x in ls[: heads[0][0] if heads else 40] if x.strip()]
        title = next(
            (
                x for x in front if not (
                    re.search(r"@y|10\.1234", x) or x.lower().startswith(("doi", "©")) or "journal" in x.lower()
                ) and 15 <= len(x) and not (x.isupper() and len(x.split()) <= 3)
            ),
            None
        )
        return title, {k: v for k, v in bodies.items() if k != "references" and k != "abstract"}

    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source_file string, text string")
    for r in parse_articles(df).collect():
        title, bodies = plain(texts[int(r.source_file)])
        assert r.title == title, repr(texts[int(r.source_file)])
        assert {s.name: s.body for s in r.sections if s.name != "abstract"} == bodies


def plain_sections(text):
    """Line by line: what a header is, and the bodies between headers."""
    heads = []
    own = text.splitlines()
    for at, line in enumerate(own):
        bare = line.strip()
        name = re.sub(r"^\s*(?:[0-9]+(?:\.[0-9]+)*\.?|[IVXLC]+\.?)\s+", "", bare, flags=re.I).strip(" :\t").lower()
        if bare and len(bare) <= 60 and name in article.SECTION_ALIASES:
            heads.append((at, article.SECTION_ALIASES[name]))
    out = {}
    for (at, name), (end, _) in zip(heads, [*heads, (len(own), "")][1:], strict=True):
        body = "\n".join(own[at + 1 : end]).strip()
        out[name] = f"{out[name]}\n{body}".strip() if name in out else body
    return list(out.items()), heads[0][0] if heads else None


def test_headers_in_one_scan_equal_line_by_line(spark):
    rnd = random.Random(12)
    names = [*article.SECTION_ALIASES, "BacKgo", "bacKground", "reſults", "abstracts", "the results"]
    ends = ["\n", "\n", "\r\n", "\r", "\x0b", "\x1d", "\x85", " ", "\n\n"]
    rows = []
    for i in range(1500):
        parts = []
        for _ in range(rnd.randint(0, 9)):
            kind, name = rnd.random(), rnd.choice(names)
            name = rnd.choice([name, name.upper(), name.title()])
            if kind < 0.5:
                lead = rnd.choice(["", "", "1. ", "2.1\t", "IV ", "iv.\xa0", "1.", "  ", "\xa0", "1. 2. ", ": ", "1 :", " " * 40 + "3 " + " " * 20, "\x1f"])
                line = lead + name + rnd.choice(["", "", ":", " :\t", "\xa0", ":\xa0", "\xa0:", " " * 70, " x", "."])
            else:
                line = rnd.choice(["", " ", "some words", "1. one", "\x1c", name + " of it", "é　"])
            parts.append(line + rnd.choice(ends))
        text = "".join(parts)
        rows.append((i, text.rstrip() if rnd.random() < 0.3 else text))
    frame = spark.createDataFrame(rows, "source_file int, text string")
    got = {r.source_file: r for r in article.parse_articles(frame).select("source_file", "sections", "references", "emails").collect()}
    for i, text in rows:
        want = [x for x in plain_sections(text)[0] if x[0] != "references"]
        assert [(s.name, s.body) for s in got[i].sections if s.name != "abstract"] == [x for x in want if x[0] != "abstract"], text


def test_emails_and_years_equal_plain_patterns(spark):
    rnd = random.Random(13)
    pieces = ["a@b.c", "+", "x", "@", ".", "d_e@f-g.h.i", " ", "\n", "é@ü.ö", "-", "1999", "2021 ", "Received ", "copyright", "(c) 1850", "2005"]
    rows = [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14)))) for i in range(1500)]
    frame = spark.createDataFrame(rows, "source_file int, text string")
    for r in article.parse_articles(frame).join(frame, "source_file").select("text", "emails", "publication_year").collect():
        assert r.emails == list(dict.fromkeys(re.findall(r"[\w.+-]+@[\w-]+\.[\w.-]+", r.text))), r.text
        year = re.compile(r"\b(?:19|20)\d{2}\b")
        dated = [x for x in r.text.splitlines() if re.search("received|accepted|published|copyright|©", x, re.I) and year.search(x)]
        first = year.search(dated[0]) if dated else year.search(r.text)
        assert r.publication_year == (first.group() if first else None), r.text
