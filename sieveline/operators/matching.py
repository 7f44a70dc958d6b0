"""Matching article files to a registry of studies, and settling who may claim a study.

A registry has ord (its order, for first and last row rules), paper_id, doi and title; files have file, stem, text.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, normal_doi, nonblank, rx
from ..tables import stored
from .article import DOI

DOI_WINDOW, TITLE_WINDOW, THRESHOLD = 3000, 4000, 0.5


def file_key(c: Column | str) -> Column:
    """Lower case, without dashes, underscores and white space; all else stays."""
    return F.regexp_replace(F.lower(c), rx(f"(?:[-_]|{WS})+"), "")


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0))


def by_file_name(files: DataFrame, registry: DataFrame) -> DataFrame:
    """file and paper_id where the stem is the paper's ID; of equal IDs the first row of the registry."""
    keys = registry.select(
        file_key("paper_id").alias("key"), "paper_id", "ord"
    ).groupBy("key").agg(F.min_by("paper_id", "ord").alias("paper_id"))
    return files.select("file", file_key("stem").alias("key")).where("key <> ''").join(keys, "key").select("file", "paper_id")


def head_dois(text: Column | str, window: int = DOI_WINDOW) -> Column:
    """All DOIs near the top of a text, in order."""
    found = F.regexp_extract_all(F.substring(text, 1, window), F.lit(rx(DOI, "iu")), 0)
    return F.transform(found, lambda d: normal_doi(F.rtrim(d, F.lit(").,;"))))


def head_words(text: Column | str, window: int = TITLE_WINDOW) -> Column:
    """The distinct words near the top of a text, as numbers: 64-bit hashes, so that no word is shuffled."""
    return F.transform(word_set(F.substring(text, 1, window)), lambda w: F.xxhash64(w))


def by_doi(files: DataFrame, registry: DataFrame, window: int = DOI_WINDOW) -> DataFrame:
    """file and paper_id of the first DOI near the top of the text that the registry has; of equal DOIs its last row."""
    return _cited(files.select("file", head_dois("text", window).alias("dois")), registry)


def _cited(heads: DataFrame, registry: DataFrame) -> DataFrame:
    known = registry.where(F.coalesce("doi", F.lit("")) != "").groupBy("doi").agg(F.max_by("paper_id", "ord").alias("paper_id"))
    found = heads.select("file", F.posexplode("dois").alias("at", "doi")).join(known, "doi")
    return found.groupBy("file").agg(F.min_by("paper_id", "at").alias("paper_id"))


def by_title(files: DataFrame, registry: DataFrame, threshold: float = THRESHOLD, window: int = TITLE_WINDOW) -> DataFrame:
    """file, paper_id and score: the title of which most words stand near the top of the text, if half of them do.

    Of equal scores the first row of the registry wins. See ``TitleIndex`` for how it is found without a product of
    files and titles. Files' words are made once and stored, as each level uses them.
    """
    return TitleIndex(stored(files.select("file", head_words("text", window).alias("words")), "title-heads"), registry).best(threshold)


def title_sets(registry: DataFrame) -> DataFrame:
    """title_words, ord and paper_id: titles of the same words are one, the first of them."""
    hashed = F.array_sort(F.transform(word_set(F.col("title")), lambda w: F.xxhash64(w)))
    titles = registry.select("ord", "paper_id", hashed.alias("title_words")).where(F.size("title_words") > 0)
    return titles.groupBy("title_words").agg(F.min("ord").alias("ord"), F.min_by("paper_id", "ord").alias("paper_id"))


#: Shares of a title's words that are asked for one after another, behind all of them.
LEVELS = (0.8, 0.65)
#: Words of a title's front that a candidate has, if it needs as many: one makes few lookups and many candidates.
FRONT_WORDS = 4
#: Titles of the first block of whole ones, and how many times as many come with the blocks behind it.
FIRST_TITLES, STEP = 1 << 12, 8


class TitleIndex:
    """A positional prefix index of titles' words and of the files' words that any title has.

    Words are put in one order, by how many pairs of a title and a file they would join: the rarest first, those
    that no file has before them. A file that has enough of a title's n words has k of its first n - needed + k, its front,
    for any k up to needed; and behind the last of them that both have, the file must be long enough for the rest. So only
    fronts are looked up, and only k shared words that leave room for enough make a candidate, whose words are then counted
    once.

    Levels go down from all of a title's words to the threshold. A file leaves with the first level that finds
    something, as all titles of that share were looked at; fronts are short at high levels, and low ones see few files.
    All that is shuffled is numbers; no title or file is compared with all others.

    At the level of whole titles the first row of the registry wins, so titles come in blocks by ord, and a file leaves
    with the first block that has one: what later blocks have doesn't matter to it. The level's work therefore follows
    how far down the registry files have to look, not the product of both. Words are only put in order for what is left.
    """

    def __init__(self, heads: DataFrame, registry: DataFrame, titles: DataFrame | None = None) -> None:
        self.heads, self.titles = heads, stored(title_sets(registry), "titles") if titles is None else titles
        self.registry = registry

    @cached_property
    def _placed(self) -> tuple[DataFrame, DataFrame]:
        each = self.titles.select("ord", F.size("title_words").alias("n"), F.explode("title_words").alias("word"))
        owned = each.groupBy("word").agg(F.count(F.lit(1)).alias("titles"))
        there = self.heads.select("file", F.explode("words").alias("word")).join(owned, "word")
        there = stored(there.select("file", "word", "titles"), "title-words-there")
        pairs = there.groupBy("word").agg((F.count(F.lit(1)) * F.first("titles")).alias("pairs"))
        pairs = stored(pairs, "title-word-pairs")
        place = lambda key: (F.row_number().over(Window.partitionBy(key).orderBy("pairs", "word")) - 1).alias("at")
        rare = F.coalesce("pairs", F.lit(0)).alias("pairs")
        ranked = each.join(pairs, "word", "left").select("ord", "n", "word", rare).select("ord", "n", "word", place("ord"))
        fronts = stored(ranked, "title-fronts")
        placed = there.join(pairs, "word").select("file", "word", "pairs").select("file", "word", place("file"))
        # words of a file from here on, counted from the back
        behind = F.count(F.lit(1)).over(Window.partitionBy("file")) - 1 - F.col("at")
        return fronts, stored(placed.select("file", "word", behind.alias("behind")), "title-places")

    @property
    def fronts(self) -> DataFrame:
        return self._placed[0]

    @property
    def places(self) -> DataFrame:
        return self._placed[1]

    def blocks(self) -> list[DataFrame]:
        """The titles by ord: about the first FIRST_TITLES, then STEP times as many up to the end of each further block."""
        total, ends, n = self.titles.count(), [], FIRST_TITLES
        while n < total:
            ends.append(n / total)
            n = n * STEP
        cuts = self.titles.agg(F.percentile_approx("ord", ends)).first()[0] if ends else []
        bounds = [None, *sorted(set(cuts)), None]
        below = lambda cut: F.lit(True) if cut is None else F.col("ord") <= cut
        above = lambda cut: F.lit(True) if cut is None else F.col("ord") > cut
        return [self.titles.where(above(a) & below(b)) for a, b in zip(bounds, bounds[1:], strict=False)]

    @staticmethod
    def first_whole(heads: DataFrame, titles: DataFrame) -> DataFrame:
        """file and ord of the first of these titles of which a file has all words; titles are looked up by their rarest."""
        each = titles.select("ord", F.explode("title_words").alias("word"))
        words = heads.select("file", F.explode("words").alias("word"))
        known = words.join(each.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("files"))
        rare = F.min(F.struct(F.coalesce("files", F.lit(0)).alias("files"), "word")).alias("rare")
        rarest = each.join(stored(known, "title-word-files"), "word", "left").groupBy("ord").agg(rare).where("rare.files > 0")
        fronts = stored(rarest.select("ord", "rare.word").join(titles.select("ord", "title_words"), "ord"), "title-rarest")
        pairs = words.join(fronts, "word").select("file", "ord", "title_words").join(heads, "file")
        whole = pairs.where(F.forall("title_words", lambda w: F.array_contains("words", w)))
        return whole.groupBy("file").agg(F.min("ord").alias("ord"))

    def candidates(self, share: float, open_files: DataFrame | None = None) -> DataFrame:
        """Pairs (file, ord) among which are all of at least this share of the title's words."""
        needed = F.greatest(F.lit(1), F.ceil(F.col("n") * share - 1e-9)).cast("int")
        fronts = self.fronts.withColumn("needed", needed).withColumn("least", F.least("needed", F.lit(FRONT_WORDS)))
        fronts = fronts.where(F.col("at") < F.col("n") - F.col("needed") + F.col("least"))
        places = self.places if open_files is None else self.places.join(open_files, "file", "left_semi")
        shared = places.join(fronts, "word").groupBy("file", "ord", "needed", "least")
        shared = shared.agg(F.count(F.lit(1)).alias("n"), F.min("behind").alias("behind"))
        return shared.where("n >= least AND n + behind >= needed").select("file", "ord")

    def scored(self, pairs: DataFrame) -> DataFrame:
        """The pairs with score, the share of the title's words that the file has."""
        both = pairs.join(self.titles.select("ord", "title_words"), "ord").join(self.heads, "file")
        shared = F.size(F.array_intersect("title_words", "words"))
        return both.select("file", "ord", (shared / F.size("title_words")).alias("score"))

    def best(self, threshold: float = THRESHOLD) -> DataFrame:
        """file, paper_id and score of the best title of each file, if it has the threshold's share; of equals the first."""
        found, left = [], self.heads
        for block in self.blocks():
            whole = self.first_whole(left, block).select("file", "ord", F.lit(1.0).alias("score"))
            found.append(stored(whole, "title-whole"))
            left = stored(left.join(found[-1], "file", "left_anti"), "title-open")
            if left.isEmpty():
                break
        else:
            found += TitleIndex(left, self.registry, self.titles)._partly(threshold)
        return reduce(DataFrame.unionByName, found).join(self.titles.select("ord", "paper_id"), "ord").select("file", "paper_id", "score")

    def _partly(self, threshold: float) -> list[DataFrame]:
        """file, ord and score by levels below whole titles, down to the threshold, for files that have no whole one."""
        found, left = [], None
        for share in (*[x for x in LEVELS if x > threshold], *([threshold] if threshold < 1 else [])):
            scored = self.scored(self.candidates(share, left)).where(F.col("score") >= share - 1e-9)
            best = scored.groupBy("file").agg(F.max_by(F.struct("ord", "score"), F.struct("score", -F.col("ord"))).alias("best"))
            found.append(stored(best.select("file", "best.ord", "best.score"), "title-best"))
            if share > threshold:
                left = stored((self.heads if left is None else left).select("file").join(found[-1], "file", "left_anti"), "title-open")
                if left.isEmpty():
                    break
        return found


def match_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """file, paper_id, match_method, confidence and status: by file name, else DOI, else title, else unmatched.

    Files without any text failed. Later ways only see the files that earlier ones left. Each text is read once: what
    the three ways need of it goes to a small table.
    """
    readable = nonblank("text").isNotNull()
    heads = files.select(
        "file",
        readable.alias("readable"),
        file_key("stem").alias("key"),
        F.when(readable, head_dois("text")).alias("dois"),
        F.when(readable, head_words("text")).alias("words")
    )
    heads = stored(heads, "match-heads")
    names = registry.select(
        file_key("paper_id").alias("key"), "paper_id", "ord"
    ).groupBy("key").agg(F.min_by("paper_id", "ord").alias("named")).where("key <> ''")
    named = stored(heads.where("readable").select("file", "key").join(names, "key").select("file", "named"), "match-named")
    rest = heads.where("readable").join(named, "file", "left_anti")
    cited = stored(_cited(rest.select("file", "dois"), registry).withColumnRenamed("paper_id", "cited"), "match-cited")
    rest = rest.join(cited, "file", "left_anti").select("file", "words")
    rest = stored(rest, "match-rest")
    titled = TitleIndex(rest, registry).best().withColumnRenamed("paper_id", "titled")
    joined = heads.select("file", "readable").join(named, "file", "left").join(cited, "file", "left").join(titled, "file", "left")
    ways = [
        (~F.col("readable"), "extraction_failed", 0.0),
        (F.col("named").isNotNull(), "filename", 1.0),
        (F.col("cited").isNotNull(), "doi", 0.95)
    ]
    ways.append((F.col("titled").isNotNull(), "title", F.bround("score", 3)))
    method, confidence = F.lit("unmatched"), F.lit(0.0)
    for holds, name, value in reversed(ways):
        method, confidence = F.when(holds, name).otherwise(method), F.when(holds, value).otherwise(confidence)
    paper = F.coalesce("named", "cited", "titled")
    status = F.when(~F.col("readable"), "failed").when(paper.isNull(), "unmatched").otherwise("matched")
    return joined.select(
        "file",
        F.coalesce(paper, F.lit("")).alias("paper_id"),
        method.alias("match_method"),
        confidence.alias("confidence"),
        status.alias("status")
    )


def settle_claims(matches: DataFrame, *order: Column | str) -> DataFrame:
    """Sets status where files claim one paper, in file order.

    A file that comes after one of at least its confidence is a duplicate_match; one that a later file beats is
    superseded; the last to stand is matched. Of rows of one file the one of the highest confidence comes first.
    """
    order = order or (F.split("file", "/"),)
    matched = matches.where("status = 'matched'")
    place, again = F.struct(*order).alias("place"), Window.partitionBy("paper_id", *order).orderBy(F.desc("confidence"))
    claimed = matched.select(*matches.columns, place, (F.row_number().over(again) > 1).alias("again"))
    # of a paper only the first and the last file of each confidence count, so that no window holds all of its files
    ends = matched.select("paper_id", "confidence", place).groupBy("paper_id", "confidence")
    ends = ends.agg(F.min("place").alias("first"), F.max("place").alias("last"))
    falling = Window.partitionBy("paper_id").orderBy(F.desc("confidence"))
    known = ends.select(
        F.col("paper_id").alias("paper"),
        F.col("confidence").alias("level"),
        F.min("first").over(falling.rowsBetween(Window.unboundedPreceding, 0)).alias("first_as_good"),
        F.max("last").over(falling.rowsBetween(Window.unboundedPreceding, -1)).alias("last_better")
    )
    late = F.col("again") | (F.col("first_as_good") < F.col("place"))
    settled = F.when(late, "duplicate_match").when(F.col("last_better") > F.col("place"), "superseded").otherwise("matched")
    both = claimed.join(known, F.expr("paper_id = paper AND confidence = level"))
    told = both.select(*[settled.alias(c) if c == "status" else F.col(c) for c in matches.columns])
    return told.unionByName(matches.where("status <> 'matched'"))


def missing_papers(registry: DataFrame, manifest: DataFrame) -> DataFrame:
    return registry.join(manifest.where("status = 'matched'").select("paper_id").distinct(), "paper_id", "left_anti")


def scrape_totals(registry: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: papers with a file, papers without one, files without a paper."""
    state = manifest.agg(
        F.count_distinct(F.when(F.col("status") == "matched", F.col("paper_id"))).alias("matched"),
        F.count_if(F.col("status").isin("unmatched", "failed")).alias("unmatched_files")
    )
    return state.join(missing_papers(registry, manifest).agg(F.count(F.lit(1)).alias("missing")))
