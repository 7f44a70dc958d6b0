"""Fields of research articles as column expressions: no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_END, ODD_END, WS, first_match, is_upper, lines, matches, rx, starts_with_any, strip, words

# Section headers seen in articles and the sections they open.
SECTION_ALIASES = {
    "abstract": "abstract",
    "summary": "abstract",
    "introduction": "introduction",
    "background": "introduction",
    "related work": "related_work",
    "literature review": "related_work",
    "materials and methods": "methods",
    "material and methods": "methods",
    "methods": "methods",
    "methodology": "methods",
    "experimental setup": "methods",
    "experiments": "methods",
    "results": "results",
    "results and discussion": "results_and_discussion",
    "findings": "results",
    "discussion": "discussion",
    "conclusion": "conclusion",
    "conclusions": "conclusion",
    "conclusion and future work": "conclusion",
    "conclusions and future work": "conclusion",
    "limitations": "limitations",
    "acknowledgments": "acknowledgments",
    "acknowledgements": "acknowledgments",
    "references": "references",
    "bibliography": "references",
}
# Patterns of the fields.
NUMBERING = rf"^{WS}*(?:[0-9]+(?:\.[0-9]+)*\.?|[IVXLC]+\.?){WS}+"
DOI = r"\b10\.\d{4,9}/[^\s\x1C-\x1F\"'<>,;]+"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
#: The same matches, each run of characters looked at once: it starts where no other does, or behind the last match.
EMAILS = r"(?:(?<![\w.+-])|\G)[\w.+-]++@[\w-]++\.[\w.-]+"
YEAR = r"\b(?:19|20)\d{2}\b"
KEYWORDS = rf"^{WS}*(?:key{WS}*words|keywords|index{WS}+terms){WS}*[:\-]{WS}*(.+)$"
JOURNAL = r"\bjournal\b|\bproceedings\b|\btransactions\b"
CITATION = rf"^{WS}*(?:\[\d+\]|\d{{1,3}}\.){WS}+"
ABSTRACT = rf"\babstract\b{WS}*[:\-]?{WS}*(.+?)(?=\n{WS}*(?:keywords|key{WS}*words|1\.?{WS}*introduction|introduction)\b|\z)"
DATED = r"received|accepted|published|copyright|©"
METADATA_HEADS = ["issn", "doi", "http", "www.", "vol.", "volume", "©"]
PLACE_HEADS = ["university", "department", "institute", "school of"]
NAME_EDGES = " .*0123456789"

SECTION = "array<struct<name: string, body: string>>"

#: What ends a line, and white space inside one, spelled out so that no flag widens them.
_END = r"\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029"
_GAP = r"[\t \x1F\xA0\u1680\u2000-\u200A\u202F\u205F\u3000]"
_LINE_START = rf"(?<![^{_END}])"
_NUMBER = rf"(?:(?:[0-9]+(?:\.[0-9]+)*\.?|[IVXLC]+\.?){_GAP}+)?"
_NAMES = "|".join(sorted(SECTION_ALIASES, key=len, reverse=True)).replace("k", r"[k\u212A]")  # that sign is a k in lower case
#: A section header with the line end before it: alone on its line of 60 characters at most, numbered or not.
HEADER = (
    rf"(?i)[{_END}]{_GAP}*+(?={_NUMBER}[ :\t]*({_NAMES})[ :\t]*{_GAP}*(?:[{_END}]|\z))"
    rf"(?=[^{_END}]{{1,60}}?{_GAP}*(?:[{_END}]|\z))[^{_END}]*+"
)


def looks_like_metadata(line: Column) -> Column:
    low = F.lower(line)
    return matches(line, EMAIL) | matches(line, DOI, "iu") | starts_with_any(low, METADATA_HEADS) | (
        matches(low, JOURNAL, "iu") & (F.length(line) < 120)
    )


def without_keywords(text: Column) -> Column:
    return strip(F.regexp_replace(text, rx(KEYWORDS, "ium"), ""))


def doi_of(text: Column | str) -> Column:
    return F.rtrim(first_match(text, DOI, flags="iu"), F.lit(").,;"))


def emails_of(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rx(EMAILS)), 0))


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def keywords_of(text: Column) -> Column:
    parts = F.split(strip(first_match(text, KEYWORDS, 1, "ium")), "[;,]")
    kept = F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" ."))), lambda p: p != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def year_of(text: Column) -> Column:
    """The first year of the first dated line near the top that has one, else the first year there."""
    head = F.substring(text, 1, 2000)
    dated = rf"{_LINE_START}(?=[^{_END}]*(?:{DATED}))[^{_END}]*?({YEAR})"
    return F.coalesce(first_match(head, dated, 1, "iu"), first_match(head, YEAR))


def _sections(names: Column, bodies: Column) -> Column:
    """(name, body) in order of first appearance; bodies of one name are joined by line ends. Names are a few, whatever the hits."""
    hits = F.zip_with(names, bodies, lambda n, b: F.struct(n.alias("name"), b.alias("body")))
    return F.transform(
        F.array_distinct(names),
        lambda name: F.struct(
            name.alias("name"),
            F.array_join(F.transform(F.filter(hits, lambda h: (h["name"] == name) & (h["body"] != "")), lambda h: h["body"]), "\n").alias("body")
        )
    )


def _body(sections: str, name: str) -> Column:
    return F.get(F.filter(F.col(sections), lambda s: s["name"] == name), F.lit(0))["body"]


def _authors(candidates: Column, title_at: Column) -> Column:
    state = F.struct(F.lit(False).alias("stop"), F.array().cast("array<string>").alias("names"))

    def names_in(line: Column) -> Column:
        parts = F.transform(F.split(line, rx(r",|\band\b|&")), lambda p: F.btrim(p, F.lit(NAME_EDGES)))
        return F.filter(parts, lambda p: (p != "") & F.size(words(p)).between(1, 5))

    def step(so_far: Column, line: Column) -> Column:
        low = F.lower(line)
        halt = (looks_like_metadata(line) & ~matches(line, EMAIL)) | starts_with_any(low, PLACE_HEADS)
        listed = line.contains(",") | low.contains(" and ") | line.contains("&")
        kept = lambda stop, names: F.struct(stop.alias("stop"), names.alias("names"))
        return F.when(so_far["stop"], so_far).when(halt, kept(F.lit(True), so_far["names"])).when(
            listed, kept(F.lit(True), names_in(line))
        ).otherwise(so_far)

    return F.when(title_at.isNull(), F.array().cast("array<string>")).otherwise(
        F.aggregate(F.slice(candidates, F.coalesce(title_at, F.lit(0)) + 2, F.lit(3)), state, step)["names"]
    )


def parse_articles(texts: DataFrame, text: str = "text", source_file: str = "source_file") -> DataFrame:
    """source_file and the fields of each text, a row for each row.

    sections is an array of (name, body) in order of first appearance, without the references. A null text is an
    empty one. affiliations is always empty, as the rules have none for it.
    """
    given = texts.select(F.col(source_file).alias("source_file"), F.coalesce(F.col(text), F.lit("")).alias("txt"))
    # one scan for the headers, one for what stands between them; the line of each is never looked at by itself
    alias = F.create_map(*[F.lit(x) for pair in SECTION_ALIASES.items() for x in pair])
    led = given.withColumn("led", F.concat(F.lit("\n"), "txt"))
    cut = led.select(
        "source_file", "txt", F.regexp_extract_all("led", F.lit(HEADER), 1).alias("hds"), F.split("led", HEADER, -1).alias("parts")
    )
    plain = lambda p: F.when(F.rlike(p, F.lit(ODD_END)), F.regexp_replace(p, LINE_END, "\n")).otherwise(p)
    bodies = F.transform(F.slice("parts", F.lit(2), F.size("parts")), lambda p: strip(plain(p)))
    named = cut.select(
        "source_file", "txt", F.substring(F.get("parts", F.lit(0)), 2, 2**31 - 1).alias("front"), (F.size("hds") > 0).alias("headed"), bodies.alias("bodies"),
        F.transform("hds", lambda h: F.try_element_at(alias, F.lower(h))).alias("names")
    )
    # of a text without headers the first lines are looked at, the rest stays whole behind them
    top = F.when(F.col("headed"), lines("front")).otherwise(F.slice(F.split("front", LINE_END, 41), F.lit(1), F.lit(40)))
    parted = named.select(
        "source_file", "txt", "headed", _sections(F.col("names"), F.col("bodies")).alias("secs"), top.alias("lns")
    )
    fronted = parted.withColumn("cds", F.filter(F.transform("lns", strip), lambda c: c != ""))
    titled = lambda c: ~looks_like_metadata(c["line"]) & F.length(c["line"]).between(15, 300) & ~(
        is_upper(c["line"]) & (F.size(words(c["line"])) <= 3)
    )
    pick = F.get(F.filter(F.transform("cds", lambda c, i: F.struct(i.alias("at"), c.alias("line"))), titled), F.lit(0))
    named = fronted.withColumn("tit", pick).withColumn("own_abstract", _body("secs", "abstract"))
    found = F.nullif(without_keywords(strip(first_match("txt", ABSTRACT, 1, "ius"))), F.lit(""))
    told = named.withColumn(
        "abstract", F.when(F.coalesce("own_abstract", F.lit("")) != "", without_keywords(F.col("own_abstract"))).otherwise(found)
    ).withColumn("refs", F.coalesce(_body("secs", "references"), F.lit("")))
    cited = F.filter(
        F.transform(F.split("refs", rx(CITATION, "m")), lambda r: F.replace(strip(r), F.lit("\n"), F.lit(" "))), lambda r: r != ""
    )
    listed = F.filter(F.transform(lines("refs"), strip), lambda r: F.length(r) > 5)
    kept = F.transform(
        F.filter("secs", lambda s: s["name"] != "references"),
        lambda s: F.struct(
            s["name"].alias("name"),
            F.when(
                (s["name"] == "abstract") & (F.coalesce("abstract", F.lit("")) != ""), F.col("abstract")
            ).otherwise(s["body"]).alias("body")
        )
    )
    early = F.when(F.col("headed"), F.col("lns")).otherwise(F.slice("lns", F.lit(1), F.lit(15)))
    journal = F.get(F.filter(F.transform(early, strip), lambda j: (j != "") & matches(j, JOURNAL, "iu") & (F.length(j) < 150)), F.lit(0))
    return told.select(
        "source_file", F.col("tit")["line"].alias("title"), _authors(
            F.col("cds"), F.col("tit")["at"]
        ).alias("authors"), F.array().cast("array<string>").alias("affiliations"), emails_of("txt").alias("emails"),
        "abstract", keywords_of(F.col("txt")).alias("keywords"), doi_of("txt").alias("doi"), journal.alias("journal"), year_of(F.col("txt")).alias("publication_year"), kept.alias("sections"),
        F.when(matches("refs", CITATION, "m"), cited).otherwise(listed).alias("references"), word_count("txt").alias("word_count"),
    )


def summary_rows(articles: DataFrame) -> DataFrame:
    """The seven columns of the summary table."""
    return articles.select(
        "source_file", "title", F.array_join("authors", "; ").alias("authors"), "doi", "journal", "publication_year", "word_count"
    )
