"""Benchmark passages in documents, through a positional inverted index.

Words of benchmark items form windows. Terms of the index are pairs of neighbouring words (the
word itself in items of one word). Documents are cut into words once, and the postings (term,
document, position) of all terms that the benchmark has are stored; a term is told by its words
and not by a hash alone, so postings are exact. For each window its two rarest terms, by the
counts of the stored postings, come first: their lists, each shifted by the term's place in the
window, are intersected. The starts left over are then intersected with the lists of all other
terms of the window, which leaves the exact phrase matches. Proximity searches read postings of
the same kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.scratch import ascii_lower, cut, small_or_not

# Fixed value: a word of the contract, A-Z being lower-cased afterwards. The signs that end a word are
# listed one by one, which Java looks up in a table, while ranges are tried one after another.
_ENDS = [c for c in range(0x80) if not chr(c).isalnum()]
WORD = "[^" + "".join(f"\\x{c:02X}" for c in _ENDS) + "]+"
SMALL_ROWS = 500_000


def raw_words(text: Column) -> Column:
    """Words as they are written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def postings(docs: DataFrame, key: list[str], terms: DataFrame) -> DataFrame:
    """*key, position, term for each place of a document where one of ``terms`` stands.

    terms: term (a number), first, second; second is null in a term of one word. A hash finds
    a term, and its words decide.
    """
    placed = docs.select(*key, raw_words(F.col("text")).alias("_w")).select(*key, "_w", F.posexplode("_w").alias("position", "_word"))
    words = placed.select(*key, "position", ascii_lower(F.col("_word")).alias("_a"), ascii_lower(F.get("_w", F.col("position") + 1)).alias("_b"))
    pairs = terms.where("second is not null").select(F.xxhash64("first", "second").alias("_pair"), F.col("first").alias("_first"), F.col("second").alias("_second"), F.col("term").alias("_t"))
    same = (F.xxhash64("_a", "_b") == F.col("_pair")) & (F.col("_a") == F.col("_first")) & (F.col("_b") == F.col("_second"))
    alone = terms.where("second is null").select(F.xxhash64("first").alias("_single"), F.col("first").alias("_only"), F.col("term").alias("_s"))
    if alone.isEmpty():
        return words.join(small_or_not(pairs, SMALL_ROWS), same).select(*key, "position", F.col("_t").alias("term"))
    both = words.join(small_or_not(pairs, SMALL_ROWS), same, "left").join(small_or_not(alone, SMALL_ROWS), (F.xxhash64("_a") == F.col("_single")) & (F.col("_a") == F.col("_only")), "left")
    found = both.where("_t is not null or _s is not null")
    return found.select(*key, "position", F.explode(F.array_compact(F.array("_t", "_s"))).alias("term"))


def lowered_words(text: Column) -> Column:
    return F.transform(raw_words(text), ascii_lower)


def benchmark_windows(items: DataFrame, size: int) -> DataFrame:
    """``window, words`` and the sorted ``items`` that have it: ``size`` words each, or all of a shorter item's."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), lowered_words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    each = w.where(F.size("w") > 0).select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("words"))
    grouped = each.groupBy("words").agg(F.collect_set("item_id").alias("items"))
    return grouped.select(F.sha2(F.concat_ws(" ", "words"), 256).alias("window"), "words", F.array_sort("items").alias("items"))


def window_terms(windows: DataFrame) -> DataFrame:
    """window, n_words, shift, first, second: each place of each window; a word alone where it is all."""
    n = F.size("words")
    last = F.when(n > 1, n - 2).otherwise(F.lit(0))
    each = windows.select("window", n.alias("n_words"), "words", F.explode(F.sequence(F.lit(0), last)).alias("shift"))
    return each.select("window", "n_words", "shift", F.get("words", F.col("shift")).alias("first"), F.get("words", F.col("shift") + 1).alias("second"))


def ranked_terms(places: DataFrame, counts: DataFrame) -> DataFrame:
    """``places`` (window, n_words, shift, term) with n_terms (places of the window) and rank: 1 at its rarest term.

    A window with a term that no document has can't occur, and isn't returned.
    """
    of_window = Window.partitionBy("window")
    known = places.join(small_or_not(counts, SMALL_ROWS), "term", "left").withColumn("_least", F.min(F.coalesce("n", F.lit(0))).over(of_window)).where("_least > 0")
    # The first place of each term counts before its further places, as one list rules out nothing twice.
    known = known.withColumn("_again", F.row_number().over(Window.partitionBy("window", "term").orderBy("shift")))
    known = known.withColumn("rank", F.row_number().over(of_window.orderBy("_again", "n", "shift")))
    return known.withColumn("n_terms", F.count(F.lit(1)).over(of_window)).select("window", "n_words", "shift", "term", "rank", "n_terms")


def phrase_matches(index: DataFrame, terms: DataFrame, key: list[str], lists: int = 2) -> DataFrame:
    """Starts where all terms of a window stand at their places: window, n_words, *key, start.

    index: postings; terms: as of ``ranked_terms``. Both should be written tables.
    """
    rare = small_or_not(cut(terms.where(F.col("rank") <= lists), "rare"), SMALL_ROWS)
    shifted = index.join(rare, "term").select(*key, "window", "n_words", "n_terms", "rank", (F.col("position") - F.col("shift")).alias("start")).where("start >= 0")
    met = shifted.groupBy(*key, "window", "start").agg(F.count_distinct("rank").alias("_n"), F.first("n_words").alias("n_words"), F.first("n_terms").alias("n_terms"))
    met = cut(met.where(F.col("_n") == F.least("n_terms", F.lit(lists))), "candidates")
    done = met.where(F.col("n_terms") <= lists).select("window", "n_words", *key, "start")
    open_ = met.where(F.col("n_terms") > lists)
    rest = small_or_not(cut(terms.where(F.col("rank") > lists).select("window", "shift", "term"), "rest"), SMALL_ROWS)
    wanted = open_.join(rest, "window").select(*key, "window", "n_words", "n_terms", "start", "term", (F.col("start") + F.col("shift")).alias("position"))
    near = index.join(small_or_not(cut(open_.select(*key).distinct(), "near"), SMALL_ROWS), key, "left_semi")
    full = wanted.join(near, [*key, "position", "term"]).groupBy(*key, "window", "start").agg(F.count_distinct("position").alias("_n"), F.first("n_words").alias("n_words"), F.first("n_terms").alias("n_terms"))
    return done.unionByName(full.where(F.col("_n") == F.col("n_terms") - lists).select("window", "n_words", *key, "start"))


def exact_matches(docs: DataFrame, items: DataFrame, key: list[str], size: int = 10) -> DataFrame:
    """Every place of ``docs`` (``*key``, text) where a window of ``items`` stands: *key, start, n, items.

    Rows of equal key must have equal texts; they count as one. Null texts have no words.
    """
    windows = cut(benchmark_windows(items, size), "windows")
    places = cut(window_terms(windows), "places")
    vocabulary = cut(places.select("first", "second").distinct().withColumn("term", F.monotonically_increasing_id()), "vocabulary")
    same = F.col("p.first").eqNullSafe(F.col("v.first")) & F.col("p.second").eqNullSafe(F.col("v.second"))
    numbered = cut(places.alias("p").join(vocabulary.alias("v"), same).select("p.window", "p.n_words", "p.shift", "v.term"), "terms")
    index = cut(postings(docs, key, vocabulary), "index")
    counts = cut(index.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "counts")
    found = phrase_matches(index, cut(ranked_terms(numbered, counts), "ranked"), key)
    return found.join(small_or_not(windows.select("window", "items"), SMALL_ROWS // 10), "window").select(*key, "start", F.col("n_words").alias("n"), "items")


def ascii_lowered(term: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in term)


def proximity_matches(docs: DataFrame, terms: list[str], within: int, key: str = "doc_id") -> DataFrame:
    """Places where all ``terms`` stand, in any order, in at most ``within`` words: key, start, stop (inclusive).

    One row for each posting that ends such a stretch; the latest posting of each other term is
    its start. Terms are single words, lower-cased as the texts are (A-Z). ``key`` should tell
    documents apart; rows without one are left out.
    """
    wanted = sorted({ascii_lowered(t) for t in terms})
    if not wanted:
        raise ValueError("no terms")
    named = docs.sparkSession.createDataFrame([(i, t, None) for i, t in enumerate(wanted)], "term long, first string, second string")
    index = cut(postings(docs.select(key, "text").where(F.col(key).isNotNull()), [key], named), "index")
    so_far = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    latest = [F.last(F.when(F.col("term") == i, F.col("position")), ignorenulls=True).over(so_far).alias(f"_p{i}") for i in range(len(wanted))]
    places = [F.col(f"_p{i}") for i in range(len(wanted))]
    whole = index.select(key, "position", *latest).where(F.greatest(*[p.isNull().cast("int") for p in places], F.lit(0)) == 0)
    first = F.least(*places, F.col("position"))
    return whole.withColumn("start", first).where(F.col("position") - F.col("start") < within).select(key, "start", F.col("position").alias("stop"))


def covered(matches: DataFrame, key: list[str]) -> DataFrame:
    """*key, n_hit (words inside any match), items (sorted, of all matches)."""
    spans = matches.groupBy(*key, "start").agg(F.max("n").alias("n"))
    before = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("start") + F.col("n")
    new = stop - F.greatest(F.col("start"), F.coalesce(F.max(stop).over(before), F.lit(0)))
    hits = spans.withColumn("_new", F.greatest(new, F.lit(0))).groupBy(*key).agg(F.sum("_new").alias("n_hit"))
    of = matches.select(*key, F.explode("items").alias("item")).distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items"))
    return hits.join(of, key, "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` (with doc_id, text and any others) with n_words, n_hit and items (null: none) added.

    Repeated rows get a row each; an empty table of items hits nothing; an item without words
    gives no window, and one without id isn't listed. Null doc_ids are kept and matched as any other. Columns of ``docs`` named
    as the new ones are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_hit", "items")]
    keyed = docs.select(*names, F.xxhash64("doc_id").alias("_id"), F.xxhash64("text").alias("_fp"))
    hits = cut(covered(exact_matches(keyed.select("_id", "_fp", "text").where("text is not null"), items, ["_id", "_fp"], size), ["_id", "_fp"]), "hits")
    n_words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    joined = keyed.withColumn("n_words", n_words).join(small_or_not(hits, SMALL_ROWS // 5), ["_id", "_fp"], "left")
    return joined.select(*names, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "items")
