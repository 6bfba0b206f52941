"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index holds a row (at, term, pos) for every occurrence in the documents of a word that the
benchmark uses; ``at`` tells documents apart.  It is written by the tasks that read the documents and
lies in their order, so building it moves no row.  A phrase is found from its rarest words: the
postings of its rarest and of its second rarest word, each less the word's place in the phrase, are
intersected by (phrase, document, start); most phrases end there.  The places that are left are
looked up in the lists of all other words, and those in which every list agrees are the matches.

Terms, phrases and the documents that still have a candidate are broadcast only while counted and small;
beyond that they are shuffled (``session.join_keys``).  Hit words are counted as the union of the
matches' ranges, within blocks of positions, so one long document is many groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysift.llm.common import materialize, read_table, with_place
from keysift.session import join_keys, key_filter

WINDOW = 10
#: Words of lower-cased text: ASCII letters and digits, and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# What stands between words; cutting there costs a tenth of finding all words.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Lists that are intersected before the others are looked at.
RARE = 2
# Positions of a block in which hit words are counted.
BLOCK = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(low, _GAPS), "")


def phrases(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(phrase, n, offset, word) and (phrase, item_id) of ``items`` (item_id, text).

    A phrase is ``size`` consecutive words of an item, or all words of a shorter one; an item
    without words has none.  Equal phrases are one, and so are rows with one item_id.
    """
    found = items.select("item_id", words(F.col("text")).alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    cut = found.select("item_id", "words", F.explode(starts).alias("s")).select(
        "item_id", F.slice("words", F.col("s"), F.lit(size)).alias("words"))
    cut = materialize(cut.distinct(), "cut")
    numbered = materialize(cut.select("words").distinct().withColumn(
        "phrase", F.monotonically_increasing_id()), "phrases")
    owners = materialize(cut.join(numbered, "words").select("phrase", "item_id"), "owners")
    return numbered.select(
        "phrase", F.size("words").alias("n"), F.posexplode("words").alias("offset", "word")), owners


def terms(occurrences: DataFrame) -> DataFrame:
    """(word, term): a number for every distinct word."""
    return materialize(occurrences.select("word").distinct().withColumn(
        "term", F.monotonically_increasing_id()), "terms")


def index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings (at, term, pos) of the vocabulary's words in ``docs`` (at, text); positions count
    from 0 over all words of a text."""
    placed = docs.select("at", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    found = join_keys(placed, vocabulary, "word", "inner", ["at", "pos"])
    return materialize(found.select("at", "term", "pos"), "postings")


def by_rarity(occurrences: DataFrame, vocabulary: DataFrame, postings: DataFrame) -> DataFrame:
    """(phrase, n, offset, term, rank): each phrase's places from the rarest word on.

    Phrases with a word that the index doesn't hold are left out: they occur nowhere.
    """
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("held"))
    known = occurrences.join(vocabulary.join(counts, "term"), "word")
    place = Window.partitionBy("phrase").orderBy("held", "offset")
    ranked = known.withColumn("rank", F.row_number().over(place)).withColumn(
        "found", F.count(F.lit(1)).over(Window.partitionBy("phrase")))
    return materialize(ranked.where("found = n").select(
        "phrase", "n", "offset", "term", "rank"), "ranked")


def phrase_matches(postings: DataFrame, ranked: DataFrame) -> DataFrame:
    """(phrase, n, at, start) of every place where all words of a phrase stand in a row."""
    rare = ranked.where(F.col("rank") <= RARE)
    lists = join_keys(postings, rare, "term", "inner", ["at", "pos"]).select(
        "phrase", "n", "at", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    agreeing = lists.groupBy("phrase", "n", "at", "start").agg(F.count(F.lit(1)).alias("k"))
    open_ = materialize(agreeing.where(F.col("k") == F.least(F.col("n"), F.lit(RARE))).drop("k"),
                        "candidates")
    wanted = join_keys(open_.where(F.col("n") > RARE), ranked.where(F.col("rank") > RARE).drop("n"),
                       "phrase", "inner", ["at", "start"]).select(
        "phrase", "n", "at", "start", "term", (F.col("start") + F.col("offset")).alias("pos"))
    # The hash only rules documents out; the join below is by at.
    near = key_filter(postings.withColumn("document", F.xxhash64("at")),
                      open_.select(F.xxhash64("at").alias("document")), "document", "left_semi",
                      ["pos"]).select("at", "term", "pos")
    agreed = wanted.join(near, ["at", "pos", "term"]).groupBy("phrase", "n", "at", "start").agg(
        F.count(F.lit(1)).alias("k")).where(F.col("k") == F.col("n") - RARE).drop("k")
    return open_.where(F.col("n") <= RARE).unionByName(agreed)


def near_matches(postings: DataFrame, ranked: DataFrame, within: int) -> DataFrame:
    """(phrase, at, start) where all distinct words of a phrase stand, in any order, among the
    ``within`` words from ``start`` on, which is one of them.

    Only documents that hold the rarest word can match; of those, only postings less than ``within``
    places from one of its postings are taken, found by blocks of that size.
    """
    once = ranked.groupBy("phrase", "term").agg(F.min("rank").alias("rank"))
    once = once.withColumn("kinds", F.count(F.lit(1)).over(Window.partitionBy("phrase"))).withColumn(
        "first", F.row_number().over(Window.partitionBy("phrase").orderBy("rank")) == 1)
    once = materialize(once.drop("rank"), "kinds")
    lists = join_keys(postings, once, "term", "inner", ["at", "pos"]).withColumn(
        "block", F.floor(F.col("pos") / within))
    anchors = lists.where("first").select(
        "phrase", "at", F.explode(F.sequence(F.col("block") - 1, F.col("block") + 1)).alias("block"))
    close = lists.join(anchors.distinct(), ["phrase", "at", "block"], "left_semi")
    ahead = Window.partitionBy("phrase", "at").orderBy("pos").rangeBetween(0, within - 1)
    return close.withColumn("seen", F.size(F.collect_set("term").over(ahead))).where(
        "seen = kinds").select("phrase", "at", F.col("pos").alias("start"))


def hit_words(matches: DataFrame) -> DataFrame:
    """(at, n_hit): the words of a document that lie in a match, each counted once."""
    end = F.col("start") + F.col("n")
    first, last = F.floor(F.col("start") / BLOCK), F.floor((end - 1) / BLOCK)
    ranges = matches.select("at", "start", end.alias("end"),
                            F.explode(F.sequence(first, last)).alias("block")).select(
        "at", "block", F.greatest(F.col("start"), F.col("block") * BLOCK).alias("start"),
        F.least(F.col("end"), (F.col("block") + 1) * BLOCK).alias("end")).distinct()
    before = Window.partitionBy("at", "block").orderBy("start", "end").rowsBetween(
        Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    return ranges.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("at").agg(
        F.sum("fresh").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs`` (id, text).

    ``items`` has item_id and text.  A null text has no words.  Rows of ``docs`` are told apart by
    place, so repeated ids and texts are rows of their own; an item whose id is null counts but
    is not among the hashed ids.  Without items, or without documents, nothing is hit.
    """
    rows = with_place(docs.select("id", "text"))
    occurrences, owners = phrases(items, size)
    vocabulary = terms(occurrences)
    postings = index(rows.select("at", "text"), vocabulary)
    ranked = by_rarity(occurrences, vocabulary, postings)
    matches = materialize(phrase_matches(postings, ranked), "matches")
    named = join_keys(matches.select("at", "phrase").distinct(), owners, "phrase", "inner", ["at"])
    of_items = named.select("at", "item_id").distinct().groupBy("at").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hits = hit_words(matches).join(of_items, "at")
    counted = rows.select("at", "id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    listed = F.concat_ws(",", F.coalesce(F.col("items"), F.array().cast("array<string>")))
    return counted.join(hits, "at", "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a passage of the benchmark, and the passages' items."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    return contamination(docs, items).withColumnRenamed("id", "doc_id")


# The same by comparing all runs of words.
SQL = rf"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS spot, regexp_extract_all(translate(coalesce(text, ''),
    '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '{WORD}') AS w FROM benchmark),
cut AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + {WINDOW - 1}], ' ') AS phrase,
    least(len(w), {WINDOW}) AS n
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s FROM item
        WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM cut),
placed AS (
  SELECT spot, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT spot, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc JOIN sizes ON len(w) >= n)),
matches AS (SELECT spot, s, p.n, item_id FROM placed p JOIN cut c ON p.phrase = c.phrase AND p.n = c.n),
hit AS (
  SELECT spot, count(DISTINCT pos) AS n_hit
  FROM (SELECT spot, unnest(range(s, s + n)) AS pos FROM matches) GROUP BY spot),
named AS (
  SELECT spot, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT spot, CAST(item_id AS VARCHAR) AS item FROM matches) GROUP BY spot)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit USING (spot) LEFT JOIN named USING (spot)
"""
