"""Benchmark decontamination: a prefix-filtered set join with exact verification. DataFrame functions only.

A window of an item is contained in a document when all its shingles are, so one shingle is a sufficient
prefix: the rarest by count over all documents. Candidate positions are the document's occurrences of such
shingles; the position within the window fixes where the window would start (positional bound), and it must
fit in the document (length bound). What is left is compared word by word, with all windows of a prefix token at once, so that a
token with many windows multiplies no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork.llm.common import hot_bound, meet, save, tidied

#: What stands between words: they are runs of digits, lower-case ASCII letters and characters beyond ASCII, after A-Z are lowered.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A vocabulary of up to this many words is broadcast (some 20 MB); so are up to this many windows of common prefix tokens.
BROADCAST_WORDS, BROADCAST_WINDOWS = 1_000_000, 100_000


def words(text: Column) -> Column:
    """Words of a text; null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), BETWEEN), "")


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """``item_id, window array<string>``, distinct: ``width`` consecutive words; a shorter item is one window."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("window")).distinct()


def prefixes(windows: DataFrame, tokens: DataFrame) -> DataFrame:
    """By the rarest word of each distinct window: ``token, n, k, ws``, its count in documents and its ``k`` windows.

    A window has its words, their number, the 0-based place of the token's first occurrence, and the items it is of.
    """
    w = windows.groupBy("window").agg(F.collect_set("item_id").alias("items"))
    ranked = w.select("window", "items", F.posexplode("window").alias("at", "token")).join(tokens, "token", "left")
    first = ranked.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at")).alias("m"), F.any_value("items").alias("items"))
    entry = F.struct("window", F.size("window").alias("size"), F.col("m.at").alias("at"), "items")
    return first.groupBy("m.token").agg(F.max("m.n").alias("n"), F.count("*").alias("k"), F.collect_list(entry).alias("ws"))


def _member(vocabulary: DataFrame, limit: int) -> set[str] | None:
    """The words of a small vocabulary; None if it has more than ``limit``."""
    got = vocabulary.limit(limit + 1).collect()
    return None if len(got) > limit else {r[0] for r in got}


def document_counts(docs: DataFrame, vocabulary: DataFrame, limit: int) -> DataFrame:
    """``token, n``: occurrences of the vocabulary's words in all documents."""
    known = _member(vocabulary, limit)
    w = docs.select(words(F.col("text")).alias("w"))
    if known is None:
        # each word of a document once, with its count: Spark broadcasts the vocabulary while it is small, else words meet it aggregated
        t = w.select(F.explode("w").alias("token"))
        if vocabulary.count() <= BROADCAST_WORDS:
            t = t.join(F.broadcast(vocabulary.toDF("token")), "token", "left_semi")
            return t.groupBy("token").agg(F.count("*").alias("n"))
        return t.groupBy("token").agg(F.count("*").alias("n")).join(vocabulary.toDF("token"), "token", "left_semi")
    if not known:
        return docs.sparkSession.createDataFrame([], "token string, n long")
    kept = w.select(F.explode(F.filter("w", lambda x: x.isin(*known))).alias("token"))
    return kept.groupBy("token").agg(F.count("*").alias("n"))


@tidied
def decontaminate(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20, inline_tokens: int = 50_000) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items, contaminated, text_hash`` (``items``: their ids, sorted).

    ``n_hit`` counts the document words inside any occurrence of a window; contaminated when ``n_hit > 0`` and
    ``share * n_hit >= n_words``. Item words and prefix tokens are put into the plan as a set when there are at
    most ``inline_tokens`` of them; beyond it they are joined, and only texts that hold a prefix token are looked at. Null and
    empty texts and items have no words. Repeated rows each return a row; an empty table returns none; other columns are ignored.
    """
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    windows = save(item_windows(items, width), "windows")
    vocabulary = save(windows.select(F.explode("window").alias("token")).distinct(), "vocabulary")
    prefix = save(prefixes(windows, document_counts(docs, vocabulary, inline_tokens)), "prefix")
    known = _member(prefix.select("token"), inline_tokens)
    text = F.col("text").cast("string")
    w = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words(text).alias("w"))
    if known is None:
        # the prefix tokens of each text, by its hash, which may only add tokens where two texts share one
        mine = w.select("text_hash", F.explode(F.array_distinct("w")).alias("token")).join(prefix.select("token"), "token", "left_semi")
        w = w.join(save(mine.groupBy("text_hash").agg(F.collect_set("token").alias("mine")), "tokens"), "text_hash", "left")
        of_prefix = lambda t: F.array_contains("mine", t)
    else:
        of_prefix = lambda t: t.isin(*known) if known else F.lit(False)
    places = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("token"), i.alias("pos"))), lambda p: F.coalesce(of_prefix(p["token"]), F.lit(False)))
    reach = width - 1
    near = F.transform(places, lambda p: F.struct(p["token"].alias("token"), p["pos"].alias("pos"), F.slice("w", F.greatest(p["pos"] - reach + 1, F.lit(1)), F.least(p["pos"], F.lit(reach)) + width).alias("near")))
    base = save(w.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), near.alias("near")), "candidates")
    c = base.select("uid", F.explode("near").alias("c")).select("uid", "c.token", "c.pos", "c.near")
    bound = hot_bound(prefix.agg(F.sum("n")).first()[0] or 0)
    if (prefix.where(F.col("n") > bound).agg(F.sum("k")).first()[0] or 0) > BROADCAST_WINDOWS:
        bound = 2**62
    c = meet(c, prefix.select("token", "n", "ws"), "token", bound)
    # the token's place in `near` is `before`; a window starts `at` words earlier
    before = F.least("pos", F.lit(reach))

    def fits(x):
        inside = before - x["at"] + 1
        return F.when((inside >= 1) & (inside - 1 + x["size"] <= F.size("near")), F.slice("near", F.greatest(inside, F.lit(1)), x["size"]) == x["window"]).otherwise(False)

    hits = c.select("uid", "pos", F.explode(F.filter("ws", fits)).alias("x")).select("uid", (F.col("pos") - F.col("x.at")).alias("start"), "x.size", "x.items")
    hits = save(hits, "hits")
    earlier = Window.partitionBy("uid").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("uid", "start", "size").distinct().withColumn("end", F.col("start") + F.col("size"))
    spans = spans.withColumn("done", F.greatest("start", F.coalesce(F.max("end").over(earlier), F.col("start"))))
    covered = spans.groupBy("uid").agg(F.sum(F.greatest(F.col("end") - F.col("done"), F.lit(0))).cast("long").alias("n_hit"))
    named = hits.select("uid", F.explode("items").alias("item_id")).groupBy("uid").agg(F.collect_set("item_id").alias("items"))
    out = base.select("uid", "doc_id", "text_hash", "n_words").join(covered.join(named, "uid"), "uid", "left")
    found = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.array_sort(found).alias("items"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), "text_hash")
