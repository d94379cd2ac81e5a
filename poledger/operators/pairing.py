"""Rows of a document paired by content, best score first.

Rows with the same code, quantity and description are one class, and classes with the same edges and
scores are one as well, so look-alike rows are not multiplied out. Classes meet on the rarest words or
letter pairs they would have to share; pairs are then taken in rounds, every pair of a round being the
best one for both of its sides. Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poledger.functions.fuzzy import token_set_ratio
from poledger.functions.normal import as_identifier, as_number, as_text
from poledger.plans.staging import settle

ROW_TEXT_MIN = 80  # description similarity that alone makes two rows a pair
KEY = ["doc_id", "code", "qty", "text"]


def row_keys(rows: DataFrame, matched: DataFrame, side: str) -> DataFrame:
    """(doc_id, code, qty, text, idx) of the rows without a match; absent or blank parts are ''."""
    left = rows.join(matched.select("doc_id", F.col(side).alias("idx")), ["doc_id", "idx"], "left_anti")
    part = lambda c: F.coalesce(c, F.lit(""))
    return left.select(
        "doc_id", part(as_identifier(F.col("item_code").cast("string"))).alias("code"),
        part(as_number(F.col("quantity").cast("string"))).alias("qty"),
        part(as_text(F.col("description").cast("string"))).alias("text"), "idx",
    )


def _words(keys: DataFrame, side: str) -> DataFrame:
    each = F.explode(F.array_distinct(F.split("text", " ")))
    return keys.filter("text <> ''").select("doc_id", side, each.alias("word")).filter("word <> ''")


def _by_words(x: DataFrame, xs: str, y: DataFrame, ys: str) -> DataFrame:
    """Pairs whose shared words make up two thirds of x's text, and some more.

    With weight W (letters and a space for each word) of x, the shared words weigh (2W + 1) / 3 at
    least; so one of them stands before the point of x's words, rarest in y first, from where less
    than that is left. Words that y does not have use up that part for nothing.
    """
    ours, theirs = _words(x, xs), _words(y, ys)
    known = theirs.groupBy("doc_id", "word").agg(F.count("*").alias("uses"))
    weight = F.length("word") + 1
    row = Window.partitionBy("doc_id", xs)
    order = row.orderBy(F.coalesce("uses", F.lit(0)), "word").rowsBetween(Window.unboundedPreceding, -1)
    rare = (
        ours.join(known, ["doc_id", "word"], "left")
        .withColumns({"weight": F.sum(weight).over(row), "before": F.coalesce(F.sum(weight).over(order), F.lit(0))})
        .filter("uses is not null and 3 * (weight - before) >= 2 * weight")
    )
    return rare.select("doc_id", xs, "word").join(theirs, ["doc_id", "word"]).select("doc_id", "t_idx", "p_idx")


def _letter_pairs(keys: DataFrame, side: str) -> DataFrame:
    """(doc_id, side, piece, nth): letter pairs of the distinct words with a space at both ends."""
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    piece = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substr(padded, i, F.lit(2))))
    counted = _words(keys, side).select("doc_id", side, piece.alias("piece")).groupBy("doc_id", side, "piece").count()
    return counted.select("doc_id", side, "piece", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("nth"))


def _by_letters(t: DataFrame, p: DataFrame) -> DataFrame:
    """Pairs whose texts, each with its shared words first, may have an indel ratio of 80.

    At most a fifth of both lengths is edited and an edit breaks one letter pair, so of the n letter
    pairs of either text (n + 2) / 3 are shared. The rarest n - ceil((n + 2) / 3) + 1 of both, in one
    order, then have one in common. Neither text is over 1.5 times as long as the other.
    """
    sides = {"t_idx": _letter_pairs(t, "t_idx"), "p_idx": _letter_pairs(p, "p_idx")}
    at = ["doc_id", "piece", "nth"]
    uses = [s.groupBy(*at).agg(F.count("*").alias(f"n_{name}")) for name, s in sides.items()]
    meets = uses[0].join(uses[1], at).select(*at, (F.col("n_t_idx") * F.col("n_p_idx")).alias("meets"))
    first = {}
    for name, pieces in sides.items():
        row = Window.partitionBy("doc_id", name)
        rank = F.row_number().over(row.orderBy(F.coalesce("meets", F.lit(0)), "piece", "nth"))
        size = F.count("*").over(row)
        first[name] = (
            pieces.join(meets, at, "left").withColumns({"rank": rank, "size": size})
            .filter("meets is not null and rank <= size - ceil((size + 2) / 3) + 1")
            .select(*at, name, F.col("size").alias(f"{name}_size"))
        )
    near = "2 * (t_idx_size - 1) <= 3 * (p_idx_size - 1) and 2 * (p_idx_size - 1) <= 3 * (t_idx_size - 1)"
    return first["t_idx"].join(first["p_idx"], at).filter(near).select("doc_id", "t_idx", "p_idx")


def candidates(t: DataFrame, p: DataFrame) -> DataFrame:
    """(doc_id, t_idx, p_idx, score) of plausible pairs between classes of rows (KEY, t_idx | p_idx):
    equal code and quantity, or a token-set similarity of 80. Exact: the filters lose no pair."""
    full = lambda keys: keys.filter("code <> '' and qty <> ''").drop("text")
    by_code = full(t).join(full(p), ["doc_id", "code", "qty"]).select("doc_id", "t_idx", "p_idx")
    pairs = (
        by_code.unionByName(_by_words(t, "t_idx", p, "p_idx")).unionByName(_by_words(p, "p_idx", t, "t_idx"))
        .unionByName(_by_letters(t, p)).distinct()
    )
    named = lambda keys, s: keys.withColumnsRenamed({c: f"{s}_{c}" for c in KEY[1:]})
    wide = pairs.join(named(t, "t"), ["doc_id", "t_idx"]).join(named(p, "p"), ["doc_id", "p_idx"])
    text = (F.col("t_text") != "") & (F.col("p_text") != "")
    alike = text & (F.col("t_text") == F.col("p_text"))
    differ = text & ~alike
    similarity = F.when(alike, F.lit(100.0)).otherwise(
        F.coalesce(token_set_ratio(F.when(differ, F.col("t_text")), F.when(differ, F.col("p_text"))), F.lit(0.0))
    )
    same = lambda c: (F.col(f"t_{c}") != "") & (F.col(f"t_{c}") == F.col(f"p_{c}"))
    return (
        wide.select("doc_id", "t_idx", "p_idx", similarity.alias("similarity"), same("code").alias("code"), same("qty").alias("qty"))
        .filter((F.col("similarity") >= ROW_TEXT_MIN) | (F.col("code") & F.col("qty")))
        .select("doc_id", "t_idx", "p_idx",
                (F.col("code").cast("int") + F.col("qty").cast("int") + F.col("similarity") / 100).alias("score"))
    )


def _merged(edges: DataFrame, rows: DataFrame, side: str, other: str) -> tuple[DataFrame, DataFrame]:
    """Classes with the same edges and scores become the one with the smallest number. Their edge sets
    are compared by size and two 64-bit digests inside one document."""
    digest = lambda *c: F.bit_xor(F.xxhash64(*c))
    shape = edges.groupBy("doc_id", side).agg(
        F.count("*").alias("n"), digest(other, "score").alias("d1"), digest(F.lit(side), "score", other).alias("d2")
    )
    leader = F.min(side).over(Window.partitionBy("doc_id", "n", "d1", "d2"))
    to = shape.select("doc_id", side, leader.alias("leader"))
    moved = lambda df: df.join(to, ["doc_id", side]).drop(side).withColumnRenamed("leader", side)
    return moved(edges).distinct(), moved(rows)


def _ranked(rows: DataFrame, side: str) -> DataFrame:
    """(doc_id, side, idx, rank): a class's rows in their order, from 0."""
    rank = F.row_number().over(Window.partitionBy("doc_id", side).orderBy("idx")) - 1
    return rows.select("doc_id", side, "idx", rank.alias("rank"))


def _best(side: str, other: str) -> tuple[Column, Column]:
    """Whether an edge is the best of its class, and the next row of the other side that ties with it."""
    w = Window.partitionBy("doc_id", side).orderBy(F.desc("score"), f"{other}_next")
    tied = F.when(F.lead("score").over(w) == F.col("score"), F.lead(f"{other}_next").over(w))
    return F.row_number().over(w) == 1, tied


def greedy(edges: DataFrame, t_rows: DataFrame, p_rows: DataFrame) -> DataFrame:
    """(doc_id, t_idx, p_idx): pairs by falling score, then truth and prediction order; each row once.

    edges: (doc_id, t_idx, p_idx, score) between classes; t_rows, p_rows: (doc_id, t_idx | p_idx, idx),
    the rows of each class. An edge that is the best of both its classes can be taken at once, with
    all following rows of both up to the first row of a class that ties with it. So a round settles
    every document's best edges, and the number of rounds is the longest chain of edges of which each
    waits for the one before. Only open edges go to the next round.
    """
    spark = edges.sparkSession
    edges = settle(edges, "row-edges")
    edges, t_rows = _merged(edges, t_rows, "t_idx", "p_idx")
    edges, p_rows = _merged(edges, p_rows, "p_idx", "t_idx")
    ranked = {"t_idx": settle(_ranked(t_rows, "t_idx"), "row-ranks"), "p_idx": settle(_ranked(p_rows, "p_idx"), "row-ranks")}
    for s, rows in ranked.items():
        size = rows.groupBy("doc_id", s).agg(F.count("*").alias(f"{s}_size"), F.lit(0).cast("long").alias(f"{s}_used"))
        edges = edges.join(size, ["doc_id", s])
    edges = settle(edges, "row-edges")
    types = {c: edges.schema[c].dataType.simpleString() for c in ("doc_id", "t_idx", "p_idx")}
    found = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in types.items()))
    while not edges.isEmpty():
        open_ = edges
        for s, rows in ranked.items():
            head = rows.select("doc_id", s, F.col("rank").cast("long").alias(f"{s}_used"), F.col("idx").alias(f"{s}_next"))
            open_ = open_.join(head, ["doc_id", s, f"{s}_used"])
        t_best, p_tied = _best("t_idx", "p_idx")  # ties of a truth class are prediction rows
        p_best, t_tied = _best("p_idx", "t_idx")
        sure = (
            open_.withColumns({"t_best": t_best, "p_tied": p_tied}).withColumns({"p_best": p_best, "t_tied": t_tied})
            .filter("t_best and p_best").select("doc_id", "t_idx", "p_idx", "t_idx_used", "p_idx_used", "t_tied", "p_tied")
        )
        sure = settle(sure, "row-sure")
        taken = None
        for s, rows in ranked.items():
            tied = F.col(f"{s[0]}_tied")
            part = (
                sure.join(rows, ["doc_id", s]).filter(F.col("rank") >= F.col(f"{s}_used"))
                .filter(tied.isNull() | (F.col("idx") < tied))
                .select("doc_id", "t_idx", "p_idx", (F.col("rank") - F.col(f"{s}_used")).alias("nth"), F.col("idx").alias(s[0]))
            )
            taken = part if taken is None else taken.join(part, ["doc_id", "t_idx", "p_idx", "nth"])
        taken = settle(taken.select("doc_id", "t_idx", "p_idx", "t", "p"), "row-pairs")
        found = found.unionByName(taken.select("doc_id", F.col("t").alias("t_idx"), F.col("p").alias("p_idx")))
        for s in ranked:
            more = taken.groupBy("doc_id", s).agg(F.count("*").alias("more"))
            used = F.col(f"{s}_used") + F.coalesce("more", F.lit(0))
            edges = edges.join(more, ["doc_id", s], "left").withColumn(f"{s}_used", used).drop("more")
        edges = settle(edges.filter("t_idx_used < t_idx_size and p_idx_used < p_idx_size"), "row-edges")
    return found


def match_by_content(truth: DataFrame, pred: DataFrame, matched: DataFrame) -> DataFrame:
    """(doc_id, t_idx, p_idx): greedy pairs of the rows that `matched` leaves."""
    keys, classes, rows = {}, {}, {}
    for s, df in (("t_idx", truth), ("p_idx", pred)):
        keys[s] = settle(row_keys(df, matched, s), "row-keys")
        classes[s] = keys[s].groupBy(*KEY).agg(F.min("idx").alias(s))
        rows[s] = keys[s].join(classes[s], KEY).select("doc_id", s, "idx")
    return greedy(candidates(classes["t_idx"], classes["p_idx"]), rows["t_idx"], rows["p_idx"])
