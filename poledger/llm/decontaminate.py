"""Benchmark decontamination with a distributed positional inverted index.

1. Index: every word of every document that any benchmark text uses, as postings (document,
   position, term), written once. Words that no benchmark text uses can be in no match. The join with the
   benchmark's terms is broadcast by Spark only when their written table is small enough.
2. Alignment: each window of a benchmark text is looked up by its rarest terms in the index. Their
   posting lists, each shifted by the term's place in the text, meet on (document, text, shift).
3. Verification: documents with a surviving shift compare all words of the windows at that shift
   (phrase), or, with a slop, look for every word of a window close to its place (proximity).

Defined cases: null texts have no words and no hits; a text without words is no window; texts of
fewer than `width` words are one window; equal benchmark texts are searched once and reported under
each item_id; rows equal in doc_id and text are answered alike, rows that share only a doc_id each
for itself; empty tables on either side give no hits; other columns are not read. Texts of any
length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poledger.plans.staging import settle

WIDTH = 10  # words in a window
RAREST = 2  # terms that every window is looked up by
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased words (A-Z only): runs of digits, letters a-z and everything beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), "")


@dataclass(frozen=True)
class Index:
    """postings: doc_id, sum (hash of the text), pos, term. Term -1 at the end holds the length.
    windows: seq, start, need (places of its rarest terms). anchors: seq, p, term.
    texts: seq, words, width. items: item_id, seq."""

    postings: DataFrame
    windows: DataFrame
    anchors: DataFrame
    texts: DataFrame
    items: DataFrame


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("sum"), words(F.col(text)).alias("words"))


def build_index(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> Index:
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("words")).where("size(words) > 0")
    listed = settle(items.withColumn("seq", F.sha2(F.array_join("words", " ").cast("binary"), 256)), "items")
    texts = settle(
        listed.dropDuplicates(["seq"]).select("seq", "words", F.least(F.lit(width), F.size("words")).alias("width")), "texts"
    )
    used = texts.select(F.explode("words").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id())
    end = texts.sparkSession.createDataFrame([("", -1)], "word string, term long")
    terms = settle(used.unionByName(end), "terms")

    each = _keyed(docs, doc_id, text).select("doc_id", "sum", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
    postings = settle(each.join(terms, "word").select("doc_id", "sum", "pos", "term"), "postings")

    often = settle(postings.groupBy("term").agg(F.count("*").alias("often")), "often")
    placed = texts.select("seq", "width", F.posexplode("words").alias("p", "word")).join(terms, "word").join(often, "term", "left")
    places = placed.groupBy("seq", "width").agg(
        F.array_sort(F.collect_list(F.struct("p", F.coalesce("often", F.lit(0)).alias("often"), "term"))).alias("places")
    )
    each_window = places.select("seq", "places", "width", F.explode(F.expr("sequence(0, size(places) - width)")).alias("start"))
    # rarest first; among equals by place within the width, so that neighbouring windows choose the same places
    ranked = F.array_sort(
        F.transform(
            F.slice("places", F.col("start") + 1, F.col("width")),
            lambda x: F.struct(x["often"].alias("often"), (x["p"] % F.col("width")).alias("turn"), x["p"].alias("p"), x["term"].alias("term")),
        )
    )
    windows = settle(
        each_window.withColumn("rare", F.slice(ranked, 1, RAREST)).where("rare[0].often > 0").select("seq", "start", F.array_sort("rare.p").alias("need"), "rare"),
        "windows",
    )
    anchors = settle(windows.select("seq", F.explode("rare").alias("r")).select("seq", "r.p", "r.term").distinct(), "anchors")
    return Index(postings, windows.drop("rare"), anchors, texts, listed.select("item_id", "seq"))


def alignments(index: Index) -> DataFrame:
    """(doc_id, sum, seq, shift): where both rarest terms of some window stand at their places."""
    met = index.postings.join(index.anchors, "term").select("doc_id", "sum", "seq", (F.col("pos") - F.col("p")).alias("shift"), "p")
    found = met.groupBy("doc_id", "sum", "seq", "shift").agg(F.collect_set("p").alias("at"))
    needs = settle(index.windows.select("seq", "need").distinct().groupBy("seq").agg(F.collect_list("need").alias("needs")), "needs")
    return found.join(needs, "seq").where(F.exists("needs", lambda n: F.size(F.array_except(n, F.col("at"))) == 0)).select("doc_id", "sum", "seq", "shift")


def near_matches(index: Index, docs: DataFrame, slop: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sum, seq, start): windows whose words all stand at most `slop` words away from their
    places relative to each other, in any order: for some shift x every word of the window is in the
    document between x and x + slop words after its place. Each word is looked for by itself, so one
    word of the document can stand for two equal ones of the window.

    The rarest terms meet in bands of shifts, a band holding 2 * (slop + 1) of them; documents with
    such a band then compare all words of the window at each shift of the band.
    """
    band = slop + 1
    met = index.postings.join(index.anchors, "term").select("doc_id", "sum", "seq", (F.col("pos") - F.col("p")).alias("shift"), "p")
    met = met.withColumn("band", F.explode(F.array(F.expr(f"cast(floor(shift / {band}) as long)"), F.expr(f"cast(floor(shift / {band}) as long) + 1"))))
    needs = index.windows.select("seq", "start", F.size("need").alias("asked"), F.explode("need").alias("p"))
    tied = met.join(needs, ["seq", "p"]).groupBy("doc_id", "sum", "seq", "start", "asked", "band").agg(
        F.collect_list(F.struct("shift", "p")).alias("at")
    )
    close = F.exists("at", lambda x: F.size(F.array_distinct(F.transform(F.filter("at", lambda y: (y["shift"] >= x["shift"]) & (y["shift"] <= x["shift"] + slop)), lambda y: y["p"]))) == F.col("asked"))
    tries = settle(tied.where(close).select(F.col("doc_id").alias("in_doc"), F.col("sum").alias("in_sum"), "seq", "start", "band"), "near")
    # one text is read once: its tries travel as one list
    listed = tries.groupBy("in_doc", "in_sum").agg(F.collect_list(F.struct("seq", "start", "band")).alias("tries"))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("sum"), F.col(text).alias("text")).distinct()
    read = own.join(listed, own["doc_id"].eqNullSafe(listed["in_doc"]) & (own["sum"] == listed["in_sum"]))
    each = read.select("doc_id", "sum", words(F.col("text")).alias("words"), "tries")
    each = each.select("doc_id", "sum", "words", F.inline("tries")).join(index.texts.withColumnRenamed("words", "wanted"), "seq")

    def stands(x: Column, i: Column) -> Column:
        """Whether word i of the text is at most `slop` words after its place at shift x."""
        first, last = x + i, x + i + slop
        part = F.slice("words", (F.greatest(first, F.lit(0)) + 1).cast("int"), F.greatest(last - F.greatest(first, F.lit(0)) + 1, F.lit(0)).cast("int"))
        return F.array_contains(part, F.get("wanted", i))

    shifts = F.sequence((F.col("band") - 1) * band - slop, F.col("band") * band + slop)
    places = F.sequence(F.col("start"), F.col("start") + F.col("width") - 1)
    near = F.exists(shifts, lambda x: F.forall(places, lambda i: stands(x, i)))
    return each.where(near).select("doc_id", "sum", "seq", "start").distinct()


def phrase_matches(index: Index, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sum, seq, at): each text with the word positions of the document that its windows
    cover there, one row per alignment."""
    texts = index.texts.withColumnRenamed("words", "wanted")
    held = alignments(index).groupBy("doc_id", "sum").agg(F.collect_list(F.struct("seq", "shift")).alias("tries"))
    held = settle(held, "alignments").select(F.col("doc_id").alias("in_doc"), F.col("sum").alias("in_sum"), "tries")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("sum"), F.col(text).alias("text"))
    read = own.join(held, own["doc_id"].eqNullSafe(held["in_doc"]) & (own["sum"] == held["in_sum"]))
    each = read.select("doc_id", "sum", words(F.col("text")).alias("words"), "tries")
    each = each.select("doc_id", "sum", "words", F.explode("tries").alias("t")).select("doc_id", "sum", "words", "t.seq", "t.shift")
    starts = F.filter(
        F.expr("sequence(0, size(wanted) - width)"),
        lambda s: (F.col("shift") + s >= 0)
        & (F.slice("words", F.greatest(F.lit(1), F.col("shift") + s + 1), F.col("width")) == F.slice("wanted", s + 1, F.col("width"))),
    )
    at = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(F.col("shift") + s, F.col("shift") + s + F.col("width") - 1))))
    return each.join(texts, "seq").withColumn("starts", starts).where("size(starts) > 0").select("doc_id", "sum", "seq", at.alias("at"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted as strings), n_items,
    contaminated, sum (hash of the text)."""
    index = build_index(docs, benchmark, width, doc_id, text, item_id, item_text)
    hits = settle(phrase_matches(index, docs, doc_id, text), "hits")
    key = ["doc_id", "sum"]
    words_hit = hits.select(*key, F.explode("at").alias("pos")).distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
    texts_hit = hits.select(*key, "seq").distinct().join(index.items, "seq").select(*key, "item_id").distinct()
    items_hit = texts_hit.groupBy(*key).agg(
        F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items")
    )
    found = words_hit.join(items_hit, (words_hit["sum"] == items_hit["sum"]) & words_hit["doc_id"].eqNullSafe(items_hit["doc_id"])).select(
        words_hit["doc_id"].alias("in_doc"), words_hit["sum"].alias("in_sum"), "n_hit", "n_items", "items"
    )
    lengths = index.postings.where("term = -1").select(*key, F.col("pos").cast("long").alias("n_words"))
    return lengths.join(found, lengths["doc_id"].eqNullSafe(found["in_doc"]) & (lengths["sum"] == found["in_sum"]), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.col("n_hit").isNotNull().alias("contaminated"), "sum",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns."""
    bad = contamination(docs, benchmark, doc_id=doc_id, text=text, **how).where("contaminated").select(F.col("doc_id").alias("bad_doc"), F.col("sum").alias("bad_sum")).distinct()
    bad = settle(bad, "contaminated")
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["bad_doc"]) & (F.xxhash64(docs[text]) == bad["bad_sum"]), "left_anti")
