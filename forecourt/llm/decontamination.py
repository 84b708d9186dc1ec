"""Benchmark decontamination by a distributed positional inverted index.

The index holds, for each word that the benchmark uses, the places where
training documents have it. A phrase is looked up from its two rarest words:
their lists, each moved back by the word's place in the phrase, are
intersected, and only common starts are checked against the other words' lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forecourt.llm.common import lowered, stored

WINDOW = 13

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def term_array(text) -> F.Column:
    """Words of a text: A-Z lower-cased, split at ASCII signs and white space. Null has none."""
    return F.array_remove(F.split(lowered(F.coalesce(text.cast("string"), F.lit(""))), _BREAKS), "")


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (item_id, phrase, length, words): each run of ``window`` words of an item, or its fewer words."""
    rows = items.select(F.col("item_id").cast("string"), term_array(F.col("text")).alias("all"))
    rows = rows.filter(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))
    rows = rows.select("item_id", "all", F.explode(starts).alias("from"))
    words = F.slice("all", F.col("from") + 1, window)
    return rows.select("item_id", words.alias("words")).distinct().select(
        "item_id", "words", F.xxhash64("words").alias("phrase"), F.size("words").alias("length")
    )


class Index:
    """Positional inverted index of ``docs`` (doc_id, text) for the words of some phrases.

    ``postings`` has (term, row, pos); ``rows`` each document's row number, id
    and word count. Rows of one doc_id are told apart by their row number.
    """

    def __init__(self, docs: DataFrame, wanted: DataFrame) -> None:
        """``wanted`` holds the phrases' words (phrase, length, words)."""
        phrases_ = wanted.select("phrase", "length", "words").dropDuplicates(["phrase"])
        spelled = phrases_.select("phrase", "length", F.posexplode("words").alias("place", "word"))
        terms = spelled.groupBy("word").agg(F.xxhash64("word").alias("term"))
        self.terms = stored(terms)
        self.spelled = stored(spelled.join(self.terms, "word").select("phrase", "length", "place", "term"))
        numbered = docs.select(
            F.col("doc_id").cast("long"),
            F.monotonically_increasing_id().alias("row"),
            term_array(F.col("text")).alias("words"),
        )
        # One pass over the texts. Place 0 is no word and keeps the document's count.
        places = F.concat(F.array(F.lit(None).cast("string")), F.col("words"))
        flat = numbered.select("doc_id", "row", F.size("words").alias("n"), F.posexplode(places).alias("at", "word"))
        found = flat.join(self.terms, "word", "left").filter("term is not null or at = 0")
        table = stored(
            found.select("doc_id", "row", (F.col("at") - 1).alias("pos"), "term", F.expr("if(at = 0, n, null) as n_words"))
        )
        self.rows = table.filter("pos = -1").select("doc_id", "row", "n_words")
        self.postings = table.filter("pos >= 0").select("term", "row", "pos")

    def anchors(self) -> DataFrame:
        """For each phrase its places from rarest word to commonest, numbered from 1."""
        counted = self.postings.groupBy("term").agg(F.count("*").alias("n"))
        order = W.partitionBy("phrase").orderBy(F.coalesce("n", F.lit(0)), "place")
        return self.spelled.join(counted, "term", "left").withColumn("rank", F.row_number().over(order))

    def exact(self) -> DataFrame:
        """Occurrences of the phrases, as rows (row, phrase, start, length)."""
        ranked = stored(self.anchors())
        rare = stored(ranked.filter("rank <= 2").select("term", "phrase", "length", "place"))
        rest = ranked.filter("rank > 2").select("term", "phrase", "place")
        starts = self.postings.join(rare, "term").withColumn("start", F.col("pos") - F.col("place"))
        starts = starts.filter("start >= 0").groupBy("row", "phrase", "start", "length").agg(F.count("*").alias("n"))
        starts = starts.filter(F.col("n") == F.least(F.col("length"), F.lit(2))).drop("n")
        starts = stored(starts)
        # Each remaining word must stand at its place.
        due = starts.join(rest, "phrase").withColumn("pos", F.col("start") + F.col("place"))
        nearby = self.postings.join(stored(starts.select("row").distinct()), "row", "left_semi")
        met = due.join(nearby, ["term", "row", "pos"], "left_semi")
        met = met.groupBy("row", "phrase", "start").agg(F.count("*").alias("n"))
        return (
            starts.join(met, ["row", "phrase", "start"], "left")
            .filter(F.coalesce("n", F.lit(0)) == F.greatest(F.col("length") - 2, F.lit(0)))
            .drop("n")
        )

    def near(self, span: int) -> DataFrame:
        """Proximity matches: (row, phrase, around) where ``span`` words hold all different words of the phrase.

        ``around`` is the place of the rarest word; the others lie in the
        ``span`` words that start or end there, or around it.
        """
        ranked = stored(self.anchors())
        different = ranked.groupBy("phrase", "term").agg(F.min("rank").alias("rank"))
        total = different.groupBy("phrase").agg(F.count("*").alias("terms"))
        centre = self.postings.join(different.filter("rank = 1"), "term")
        centre = centre.select("row", "phrase", F.col("pos").alias("around"))
        # Places are met by cells of span words: each place of a word looks into its own cell and both neighbours.
        cells = F.array(*[F.expr(f"around div {span} + {k}") for k in (-1, 0, 1)])
        cells = centre.join(different, "phrase").withColumn("cell", F.explode(cells))
        at = self.postings.withColumn("cell", F.expr(f"pos div {span}"))
        hits = cells.join(at, ["row", "term", "cell"]).filter(F.abs(F.col("pos") - F.col("around")) < span)
        # A window of span words that holds the anchor starts at one of the hits before it, or at it.
        lows = hits.filter("pos <= around").select("row", "phrase", "around", F.col("pos").alias("low")).distinct()
        held = hits.join(lows, ["row", "phrase", "around"]).filter(f"pos >= low and pos < low + {span}")
        held = held.groupBy("row", "phrase", "around", "low").agg(F.count_distinct("term").alias("n"))
        return (
            held.groupBy("row", "phrase", "around")
            .agg(F.max("n").alias("n"))
            .join(total, "phrase")
            .filter("n = terms")
            .select("row", "phrase", "around")
        )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` the words that lie in an item's phrase, and the items found.

    Columns: doc_id, row, n_words, n_hit, n_items, items_sha256, contaminated
    (at least one word in twenty is hit). Null and empty texts have no words;
    items without words are ignored; repeated items count once by their id.
    """
    wanted = stored(phrases(items, window))
    index = Index(docs, wanted)
    found = stored(index.exact())
    # Words covered: each occurrence adds what reaches beyond the furthest end before it.
    places = found.select("row", "start", (F.col("start") + F.col("length")).alias("end"))
    places = places.groupBy("row", "start").agg(F.max("end").alias("end"))
    order = W.partitionBy("row").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    places = places.withColumn("reached", F.coalesce(F.max("end").over(order), F.lit(0)))
    fresh = F.greatest(F.col("end") - F.greatest("start", "reached"), F.lit(0))
    hit = places.groupBy("row").agg(F.sum(fresh).alias("n_hit"))
    names = found.select("row", "phrase").distinct().join(wanted.select("phrase", "item_id"), "phrase")
    names = names.select("row", "item_id").distinct().groupBy("row")
    names = names.agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    none = F.array().cast("array<string>")
    rows = index.rows.join(hit, "row", "left").join(names, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_ = F.coalesce("items", none)
    return rows.select(
        "doc_id",
        "row",
        F.col("n_words").cast("long"),
        n_hit.alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not contaminated; columns as they are.

    Rows of one doc_id go together, those without an id too.
    """
    found = contamination(docs, items, window).filter("contaminated")
    found = stored(found.select(F.col("doc_id").alias("found_id")).distinct())
    return docs.join(found, docs["doc_id"].eqNullSafe(found["found_id"]), "left_anti")
