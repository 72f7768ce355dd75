"""Fuzzy line deduplication over the whole corpus, with DataFrame functions alone.

A line, lower-cased and trimmed, is a set of character shingles, one from each character on.
Equal lines fall together by their hash. MinHash signatures are minima of an aggregation over
exploded shingles, so they stay in generated code. Twelve bands of four of 24 minima give buckets.
A bucket needs four equal minima, so that lines that share nothing but common words rarely meet.

Every line is compared with the leader (least id) of each of its buckets, and what is alike is
linked. In buckets that then still hold several components, all pairs of different components are
compared, however large the bucket is. Sketches rule out most: a sketch has the bits, of 1024, on which a
line's shingles fall, so the bits in which two differ are at most the shingles that only one line has. In a
large bucket the lines go along, and what sketches leave is verified
where it meets; only links come out of that join. Pairs
are verified by the Jaccard similarity of all their shingles (told apart by 64-bit hashes), and
union-find over the verified pairs gives components, of which the first line in document order is kept.

Signatures of long lines are minima over a quarter of their shingles, chosen by hash. Lines
near the length from which on that holds are signed both ways, so that any two lines alike
enough have a signature of one kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.components import connected_components
from codeloom.llm.scratch import cut, drop_table, drop_tables, small_or_not

SHINGLE, MINIMA, PERCENT = 8, 24, 80
LONG, FIRST = 160, 16
SMALL_BUCKET, DEALT = 32, 1024
SKETCH = 16  # longs of a line's sketch, a power of two
SMALL_ROWS = 2_000_000  # what may be broadcast, within the bytes that small_or_not allows
_WORDS = 4  # hashes of a shingle; each gives minima under orders that differ in their first bits
_ORDERS = MINIMA // _WORDS
# A band has a minimum of each hash; no two bands share more than one minimum.
_BANDS = [[_WORDS * ((i + step * w) % _ORDERS) + w for w in range(_WORDS)] for step in (0, 1) for i in range(_ORDERS)]
_HAS = r"[\p{L}\p{N}]"


def normalized(line: Column) -> Column:
    return F.lower(F.trim(line))


def wide(line: Column) -> Column:
    """A line as two bytes a character (UTF-16), so that a shingle is reached by its place at once."""
    return F.encode(line, "UTF-16BE")


def _starts(units: Column, size: int) -> Column:
    """1-based byte places of a line's shingles; a shorter line is one shingle."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(units) - 2 * size + 1, F.lit(1)), F.lit(2))


def _shingle(units: Column, start: Column, size: int) -> Column:
    return F.xxhash64(F.substring(units, start, F.lit(2 * size)))


def shingle_hashes(line: Column, size: int = SHINGLE) -> Column:
    """Hashes of the shingles, with repeats. As the outer transform's variable the units are read in place, not copied for each shingle."""
    each = F.transform(F.array(wide(line)), lambda u: F.transform(_starts(u, size), lambda i: _shingle(u, i, size)))
    return F.get(each, F.lit(0))


def text_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, fp (hash of the text), line_no (from 0), line, id (of the normalized line); lines without letters and digits aren't given."""
    split = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("fp"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return split.where(F.col("line").rlike(_HAS)).withColumn("line", normalized(F.col("line"))).withColumn("id", F.xxhash64("line"))


def signatures(lines: DataFrame, size: int = SHINGLE) -> DataFrame:
    """id, long, m0, m1, ...: MinHash of each distinct line, once or twice."""
    units = lines.select("id", wide(F.col("line")).alias("_u")).withColumn("_n", F.expr("octet_length(_u) div 2"))
    kinds = F.when(F.col("_n") >= LONG, F.array(F.lit(True))).when(100 * F.col("_n") >= PERCENT * LONG - 1000, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    units = units.select("id", "_u", F.explode(kinds).alias("long"))
    placed = units.select("id", "long", "_u", F.explode(_starts(F.col("_u"), size)).alias("_p"))
    each = placed.select("id", "long", "_p", _shingle(F.col("_u"), F.col("_p"), size).alias("_s"))
    # A long line's chosen shingles have negative hashes, which sort first and are no short line's; its first ones are there in case that none is chosen.
    chosen = F.col("_s").bitwiseAND(F.lit(3)) == 0
    each = each.where(~F.col("long") | chosen | (F.col("_p") <= 2 * FIRST))

    def word(j: int) -> Column:
        h = F.hash("_s", F.lit(j))
        return F.when(F.col("long") & chosen, h.bitwiseOR(F.lit(-0x80000000))).otherwise(h.bitwiseAND(F.lit(0x7FFFFFFF)))

    each = each.select("id", "long", *[word(j).alias(f"_w{j}") for j in range(_WORDS)])
    return each.groupBy("id", "long").agg(*[F.min(F.col(f"_w{k % _WORDS}").bitwiseXOR(F.lit((k // _WORDS) << 28))).alias(f"m{k}") for k in range(MINIMA)]).drop("long")


def meetings(signed: DataFrame) -> DataFrame:
    """bucket, id, leader: each line in each bucket that it shares, with the bucket's least id; a written table."""
    keys = F.array(*[F.xxhash64(F.lit(n), *[f"m{k}" for k in band]) for n, band in enumerate(_BANDS)])
    bucket = Window.partitionBy("bucket")
    rows = signed.select("id", F.explode(keys).alias("bucket")).select("bucket", "id", F.min("id").over(bucket).alias("leader"), F.max("id").over(bucket).alias("_last"))
    return cut(rows.where("leader < _last").select("bucket", "id", "leader"), "inside")


def mixed(inside: DataFrame, component: DataFrame) -> DataFrame:
    """bucket, id, component of the lines of each bucket that holds several components; a written table."""
    labelled = inside.select("bucket", "id").distinct().join(component.select(F.col("node").alias("id"), "component"), "id", "left")
    labelled = labelled.select("bucket", "id", F.coalesce("component", "id").alias("component"))
    bucket = Window.partitionBy("bucket")
    labelled = labelled.withColumn("_lo", F.min("component").over(bucket)).withColumn("_hi", F.max("component").over(bucket))
    return cut(labelled.where("_lo < _hi").select("bucket", "id", "component"), "labelled")


def rest_pairs(apart: DataFrame, lines: DataFrame, known: DataFrame, percent: int = PERCENT, own: DataFrame | None = None) -> DataFrame:
    """a < b: the alike pairs of lines of ``apart`` (bucket, id, component; without bucket: of one) of one bucket and different components; a written table.

    ``lines`` has each line once, ``own`` their sketches. All pairs are looked at; what sketches rule out can't be alike. Pairs of small
    buckets are verified once each, without those in ``known``. Those of large ones, dealt by hash, are verified where they
    meet first: the lines outside a bucket's largest component with all lines of others.
    """
    if "bucket" not in apart.columns:
        apart = apart.withColumn("bucket", F.lit(0))
    used = [] if own is not None else [cut(sketches(lines), "sketches")]
    own = used[0] if used else own
    of = apart.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("_n")).groupBy("bucket")
    of = cut(of.agg(F.sum("_n").alias("size"), F.max(F.struct("_n", "component"))["component"].alias("most")), "sizes")
    sized = apart.join(small_or_not(of, SMALL_ROWS), "bucket")
    different = (F.col("_ca") != F.col("_cb")) & can_be_alike("_na", "_wa", "_nb", "_wb", percent)

    few = sized.where(F.col("size") <= SMALL_BUCKET).join(own, "id")
    left, right = (few.select("bucket", F.col("id").alias(x), F.col("component").alias(f"_c{x}"), F.col("n").alias(f"_n{x}"), F.col("w").alias(f"_w{x}")) for x in "ab")
    near = left.join(right, "bucket").where((F.col("a") < F.col("b")) & different).select("a", "b").distinct()
    near = cut(near.join(known, ["a", "b"], "left_anti"), "near")

    many = cut(sized.where(F.col("size") > SMALL_BUCKET), "large")
    ids = cut(many.groupBy("id").agg(F.sort_array(F.collect_set("bucket")).alias("all")), "ids")
    texts = lines.join(small_or_not(ids, SMALL_ROWS), "id").select("id", "all", "line")
    rows = cut(many.join(own.join(texts, "id"), "id").withColumn("parts", F.ceil(F.col("size") / DEALT).cast("int")), "dealt")
    outer = rows.where("component != most").select("bucket", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("_p"), F.col("id").alias("_a"), F.col("component").alias("_ca"), F.col("n").alias("_na"), F.col("w").alias("_wa"), F.col("line").alias("_la"), F.col("all").alias("_alla"))
    every = rows.select("bucket", "most", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_p"), F.col("id").alias("_b"), F.col("component").alias("_cb"), F.col("n").alias("_nb"), F.col("w").alias("_wb"), F.col("line").alias("_lb"), F.col("all").alias("_allb"))
    # Lines are exchanged, and made sets after that, as sets are several times as large.
    outer = outer.repartition("bucket", "_p").withColumn("_sa", F.array_distinct(shingle_hashes(F.col("_la")))).drop("_la")
    every = every.repartition("bucket", "_p").withColumn("_sb", F.array_distinct(shingle_hashes(F.col("_lb")))).drop("_lb")
    once = (F.col("_a") < F.col("_b")) | (F.col("_cb") == F.col("most"))
    first = every["bucket"] == F.get(F.array_intersect("_alla", "_allb"), F.lit(0))  # of the large buckets that both are in
    on = (every["bucket"] == outer["bucket"]) & (every["_p"] == outer["_p"]) & once & different & first & sets_alike("_sa", "_sb", percent)
    met = every.join(outer, on).select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))

    out = cut(alike(near, lines, percent).unionByName(met.distinct()), "links")
    drop_tables([*used, of, near, many, ids, rows])
    return out


def sketches(lines: DataFrame) -> DataFrame:
    """id, n (places of shingles), w (SKETCH longs): the bits on which shingles fall. ``lines`` has each line once."""
    placed = lines.select("id", wide(F.col("line")).alias("_u")).select("id", "_u", F.explode(_starts(F.col("_u"), SHINGLE)).alias("_p"))
    each = placed.select("id", _shingle(F.col("_u"), F.col("_p"), SHINGLE).alias("_s"))
    each = each.select("id", F.expr("shiftleft(1L, cast(_s & 63 as int))").alias("_bit"), F.expr(f"cast(shiftright(_s, 6) & {SKETCH - 1} as int)").alias("_word"))
    words = [F.bit_or(F.when(F.col("_word") == k, F.col("_bit")).otherwise(F.lit(0).cast("long"))).alias(f"_w{k}") for k in range(SKETCH)]
    return each.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"), *words).select("id", "n", F.array(*[f"_w{k}" for k in range(SKETCH)]).alias("w"))


def can_be_alike(na: str, wa: str, nb: str, wb: str, percent: int = PERCENT) -> Column:
    """False only for lines that aren't alike: each bit that differs is a shingle of one line alone, and like lines have few of these for their places."""
    differ = [F.bit_count(F.get(wa, F.lit(k)).bitwiseXOR(F.get(wb, F.lit(k)))) for k in range(SKETCH)]
    return (100 + percent) * sum(differ[1:], differ[0]) <= (100 - percent) * (F.col(na) + F.col(nb))


def lines_of(ids: DataFrame, lines: DataFrame) -> DataFrame:
    """id, line of the lines of ``ids`` (a written table of id), each once; a written table."""
    return cut(lines.select("id", "line").join(small_or_not(ids, SMALL_ROWS), "id", "left_semi").groupBy("id").agg(F.first("line").alias("line")), "met-lines")


def verified(pairs: DataFrame, lines: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The ``pairs`` (a written table) whose lines' shingle sets have a Jaccard similarity of percent / 100 or more; a written table."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    met = lines_of(ids, lines)
    own = cut(sketches(met), "sketches")
    out = verified_by(pairs, met, own, percent)
    drop_tables([ids, met, own])
    return out


def verified_by(pairs: DataFrame, met: DataFrame, own: DataFrame, percent: int = PERCENT) -> DataFrame:
    """As ``verified``, with the lines (each once) and their sketches at hand. Sketches alone rule many pairs out; lines are exchanged and made sets after that."""
    near = pairs.join(own.toDF("a", "_na", "_wa"), "a").join(own.toDF("b", "_nb", "_wb"), "b").where(can_be_alike("_na", "_wa", "_nb", "_wb", percent))
    near = cut(near.select("a", "b"), "near")
    out = cut(alike(near, met, percent), "links")
    drop_table(near)
    return out


def sets_alike(a: str, b: str, percent: int) -> Column:
    """Whether two columns of sets have a Jaccard similarity of percent / 100 or more."""
    return (100 + percent) * F.size(F.array_intersect(a, b)) >= percent * (F.size(a) + F.size(b))


def alike(pairs: DataFrame, met: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The ``pairs`` whose lines (of ``met``, each once) are alike, by all their shingles."""
    both = pairs.join(met.select(F.col("id").alias("a"), F.col("line").alias("_la")), "a").join(met.select(F.col("id").alias("b"), F.col("line").alias("_lb")), "b")
    both = both.select("a", "b", F.array_distinct(shingle_hashes(F.col("_la"))).alias("_sa"), F.array_distinct(shingle_hashes(F.col("_lb"))).alias("_sb"))
    return both.where(sets_alike("_sa", "_sb", percent)).select("a", "b")


def duplicate_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, fp, line_no of every line that isn't the first, by key and place, of its component."""
    lines = cut(text_lines(docs, key, text), "lines")
    places = lines.select("key", "fp", "line_no", "id")
    inside = meetings(signatures(lines))
    ids = cut(inside.select("id").distinct(), "ids")
    met = lines_of(ids, lines)
    own = cut(sketches(met), "sketches")
    pairs = cut(inside.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = verified_by(pairs, met, own)
    component = connected_components(links)
    apart = mixed(inside, component)
    drop_tables([inside, ids])
    if not apart.isEmpty():
        rest = rest_pairs(apart, met, pairs, own=own)
        if not rest.isEmpty():
            component = connected_components(links.unionByName(rest))
    drop_tables([met, own, pairs, apart])
    # Lines that stand once and have no like line need no decision.
    counted = places.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    groups = counted.join(component.withColumnRenamed("node", "id"), "id", "left").where("_n > 1 or component is not null")
    groups = small_or_not(cut(groups.select("id", F.coalesce("component", "id").alias("component")), "groups"), SMALL_ROWS)
    standing = cut(places.join(groups, "id").select("component", "key", "fp", "line_no"), "standing")
    drop_table(lines)
    first = standing.groupBy("component").agg(F.min(F.struct("key", "fp", "line_no")).alias("_first"))
    first = small_or_not(cut(first, "first"), SMALL_ROWS)
    return standing.join(first, "component").where(F.struct("key", "fp", "line_no") != F.col("_first")).select("key", "fp", "line_no")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with duplicate lines taken out of ``text``, and n_lines and n_removed added.

    Lines without letters or digits stay, as does a null text (of no lines). Of a component
    of equal or similar lines the first stays, by key, then (among texts of one key) by a hash
    of the text, then by place. Null keys come first. Rows of equal key and text are one
    document and lose the same lines. Columns of ``docs`` named as the new ones are replaced; an
    empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    lost = duplicate_lines(docs, key, text).distinct().groupBy(F.col("key").alias("_key"), F.col("fp").alias("_fp")).agg(F.sort_array(F.collect_list("line_no")).alias("_lost"))
    # A mark for each line up to the last that goes: 1 if it goes.
    marks = F.array_join(F.transform("_lost", lambda x, j: F.concat(F.repeat(F.lit("0"), x - F.coalesce(F.get("_lost", j - 1), F.lit(-1)) - 1), F.lit("1"))), "")
    lost = small_or_not(cut(lost.select("_key", "_fp", F.size("_lost").alias("_n_lost"), marks.cast("binary").alias("_marks")), "lost"), SMALL_ROWS)
    rows = docs.select(*names).join(lost, F.col(key).eqNullSafe(F.col("_key")) & (F.xxhash64(text) == F.col("_fp")), "left")
    split = F.split(text, "\n")
    stays = lambda i: F.substring(F.col("_marks"), i + 1, F.lit(1)) != F.lit(bytearray(b"1"))
    kept = F.array_join(F.filter(split, lambda line, i: stays(i)), "\n")
    out = F.when(F.col("_marks").isNull(), F.col(text)).otherwise(kept)
    n_lines = F.coalesce(F.when(F.col(text).isNotNull(), F.size(split)), F.lit(0)).cast("long")
    return rows.select(
        *[out.alias(text) if c == text else F.col(c) for c in names],
        n_lines.alias("n_lines"), F.coalesce(F.col("_n_lost"), F.lit(0)).cast("long").alias("n_removed"),
    )
