"""Quality rules of a text alone, and lines that too many documents of a host share; DataFrame functions only.

Texts are read once, into counts and a list of line hashes for each row. A line is compared as its hash after case,
white space and digits are levelled. Its documents are counted in each host, equal texts once: copies of a whole
text are for deduplication to find, not for this rule. Lines above both limits are removed, and a document that
keeps too few of its words is rejected.

Where one line, host or text holds a great part of all rows: counts are combined before they are shuffled; equal texts
are reduced to one before their lines are spread out; and the two joins with what was found are plain inner or left
joins, whose hot side Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WHITE = " \t\n\x0b\f\r"
#: A line of more documents of its host than this, and of more than this share of them, is removed.
MAX_DOCS, MAX_SHARE = 10, 0.05
#: A document keeps at least this share of its words.
LEAST_LEFT = 0.5
WINDOW = 5


def normalised(line: Column) -> Column:
    """Lower case, single spaces, digits as 0."""
    spaced = F.regexp_replace(F.btrim(line, F.lit(WHITE)), r"[\x20\x09-\x0D]+", " ")
    return F.translate(F.lower(spaced), "123456789", "000000000")


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def measured(documents: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, text_hash, the counts of ``line_rules`` and lines: hash and number of words of each line with a word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id"), F.col(host).cast("string").alias("host"), text.alias("body"))
    kept = F.filter(F.split("body", "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    # one select a step: what a step uses more than once is computed in the one before
    rows = rows.select("doc_id", "host", "body", _words(F.col("body")).alias("words"), kept.alias("own"))
    rows = rows.select(
        "doc_id",
        "host",
        F.xxhash64("body").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("body", WHITE, "")).cast("long").alias("word_chars"),
        (F.char_length("body") - F.char_length(F.translate("body", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("own") - F.size(F.array_distinct("own"))).cast("long").alias("n_dup_lines"),
        F.transform("own", lambda line: F.struct(F.xxhash64(normalised(line)).alias("line"), F.size(_words(line)).alias("n"))).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashed")
    )
    at = lambda i, k: F.get("hashed", i + k)
    windows = F.transform(
        F.slice("hashed", F.lit(1), F.greatest(F.size("hashed") - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[at(i, k) for k in range(1, WINDOW)])
    )
    own = ["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "lines"]
    rows = rows.select(*own, windows.alias("windows"))
    # only texts that repeat a window have theirs put in order
    placed = F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    rows = rows.select(*own, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).alias("placed"))
    same = lambda x, j: F.get("placed", j)["w"] == x["w"]
    twice = F.transform(
        "placed", lambda x, j: F.when(((j > 0) & same(x, F.greatest(j - 1, F.lit(0)))) | F.coalesce(same(x, j + 1), F.lit(False)), x["i"])
    )
    rows = rows.select(*own, F.array_sort(F.filter(twice, lambda i: i.isNotNull())).alias("starts"))
    covered = F.aggregate(
        F.zip_with("starts", F.slice("starts", F.lit(2), F.greatest(F.size("starts"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), b - a)),
        F.lit(0),
        lambda total, n: total + n
    )
    return rows.select(*own, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def frequent_lines(texts: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """host, line and n_docs of the lines above both limits; ``texts`` has host and lines, a row for each different text."""
    each = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    common = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > max_docs)
    hosts = texts.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    both = common.alias("c").join(hosts.alias("h"), F.expr("c.host <=> h.host"))
    return both.where(F.col("n_docs") > F.col("docs") * max_share).select("c.host", "line", "n_docs")


def line_rules(
    documents: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, least_left: float = LEAST_LEFT
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_line_words of each row.

    n_line_words: the words in removed lines. kept: false if base_failed (fewer than 10 words, or over 20 % of them in
    windows of five words that the text has twice), or if less than ``least_left`` of the words are left. A removed
    line goes wherever it stands in the document. A null text is empty, and fails for want of words; a null host is a
    host like any other. Repeated rows give equal result rows and count once, as all equal texts of a host do. A very
    long text is handled whole in its row: its task holds its words as numbers. An empty table gives an empty
    result. Windows and lines are compared as 64-bit hashes.
    """
    base = stored(measured(documents, host), "op11-base")
    text = ["host", "text_hash", "n_words"]
    texts = stored(base.groupBy(*text).agg(F.first("lines").alias("lines")), "op11-texts")
    common = stored(frequent_lines(texts, max_docs, max_share), "op11-lines")
    spread = texts.select(*text, F.explode("lines").alias("x")).select(*text, F.col("x.line").alias("line"), F.col("x.n").alias("n"))
    found = spread.alias("s").join(common.alias("c"), F.expr("s.host <=> c.host AND s.line = c.line"))
    gone = found.groupBy("s.host", "s.text_hash", "s.n_words").agg(F.sum("s.n").alias("n_line_words"))
    match = F.expr("b.host <=> g.host AND b.text_hash = g.text_hash AND b.n_words = g.n_words")
    rows = base.drop("lines").alias("b").join(gone.alias("g"), match, "left").select(
        *[f"b.{c}" for c in base.columns if c != "lines"], F.coalesce("g.n_line_words", F.lit(0)).cast("long").alias("n_line_words")
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_line_words") >= F.lit(least_left) * F.col("n_words")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & left).alias("kept"), "n_line_words"
    )
