"""Benchmark decontamination by a distributed positional inverted index.

Test items are cut into windows of ``WINDOW`` words. The index stores postings of training tokens: (term,
document, position) with the words around it. Only test terms can take part, and of these only the two
rarest of each window are needed to find it, so a first pass counts how often every test term occurs in the
corpus (windows with a term that never occurs are dropped), and a second stores the postings of the rarest.
A phrase is found by intersecting the lists of its rarest terms, each shifted by its offset in the window,
and is exact when the words stored around the rarest one equal it. Proximity matches (:func:`proximity`) start from
either of the rarest two terms and are tested over all words of the window: each stands within ``slack`` words
of its place, all but one in a window of ``WINDOW`` words. So a word that was put in, left out or replaced
doesn't hide a passage, even where the replaced word occurs in no document.

Every document also gets one posting of an end mark at its number of words, so that one pass over the texts
gives postings and documents alike. The index is a checkpoint in the shared folder. Nothing runs Python.

Tables made from the test items are broadcast only while they have at most ``BROADCAST_ROWS`` rows; beyond
that Spark joins by shuffle. A term, passage or document may hold any share of the corpus: counts are
combined before they are shuffled, and no group is gathered that is larger than one document's words.

Edge cases: null and empty texts have no words; a null item id is no item; items with equal windows are all
reported; repeated rows and null ids are judged one by one; with no items nothing is hit; an empty table
gives no rows; other columns are ignored by :func:`report` and carried by :func:`drop_contaminated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, fresh, query, table
from tidegauge.llm.common import small as few

WINDOW = 10
#: Words that a word of a proximity match may be off its place.
SLACK = 1
BROADCAST_ROWS = 200_000
END = "\u0001"  # no word: the end mark's term
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of digits, a-z and anything beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BREAKS), "")


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for tables whose counted size is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows(items: DataFrame, key: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(item_id string, window text, len) of every item; an item of fewer words is one window."""
    own = items.select(F.col(key).cast("string").alias("item_id"), words(F.col(text)).alias("w")).filter("item_id is not null and size(w) > 0")
    starts = F.when(F.size("w") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("w") - size))
    cuts = own.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("w"))
    return cuts.select("item_id", F.array_join("w", " ").alias("window"), F.size("w").alias("len")).distinct()


def anchors(docs: DataFrame, wins: DataFrame, text: str = "text", missing: int = 0) -> DataFrame:
    """(window, len, a1, o1, a2, o2): the rarest two terms of each window that can occur, and their offsets.

    With ``missing`` = 1 a window of ``WINDOW`` words or more may have one word that never occurs.
    """
    terms = wins.select("window", "len").distinct().select("window", "len", F.posexplode(F.split("window", " ")).alias("off", "term"))
    vocabulary = cut(terms.select("term").distinct())
    tokens = docs.select(F.explode(words(F.col(text))).alias("term"))
    counts = tokens.join(small(vocabulary, vocabulary.count()), "term").groupBy("term").agg(F.count("*").alias("n"))
    rarest = F.sort_array(F.collect_list(F.struct("n", "off", "term"))).alias("r")  # at most WINDOW entries
    found = terms.join(counts, "term").groupBy("window", "len").agg(rarest).filter(F.size("r") >= F.col("len") - _missing(missing))
    first, second = F.col("r")[0], F.get("r", F.lit(1))
    return cut(found.select("window", "len", first["term"].alias("a1"), first["off"].alias("o1"), second["term"].alias("a2"), second["off"].alias("o2")))


def _missing(most: int) -> Column:
    """How many words of a window needn't be found: none of one shorter than ``WINDOW``."""
    return F.when(F.col("len") >= WINDOW, F.lit(most)).otherwise(F.lit(0))


def index(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Postings (_row, doc_id, mark, term, pos, around, lead) of the given terms and of each document's end mark.

    ``mark`` is a hash of the text, ``around`` are the words from ``lead`` words before the posting to ``size`` - 1 words behind it.
    """
    listed = cut(terms.select("term").union(docs.sparkSession.range(1).select(F.lit(END).alias("term"))).distinct())
    n = listed.count()
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), F.xxhash64(F.col(text).cast("string")).alias("mark"), F.array_append(words(F.col(text)), END).alias("w"))
    each = own.select("_row", "doc_id", "mark", "w", F.posexplode("w").alias("pos", "term"))
    lead = F.least(F.col("pos"), F.lit(size - 1))
    around = F.when(F.col("term") != END, F.array_join(F.slice("w", F.col("pos") - lead + 1, lead + size), " "))
    posting = ["_row", "doc_id", "mark", "term", "pos", around.alias("around"), lead.alias("lead")]
    if n <= BROADCAST_ROWS:
        return cut(each.join(F.broadcast(listed), "term").select(*posting))
    # many terms: the join shuffles, so the words around are cut out first and no text travels with each of its words
    return cut(each.select(*posting).join(listed, "term").select("_row", "doc_id", "mark", "term", "pos", "around", "lead"))


def candidates(postings: DataFrame, rare: DataFrame) -> DataFrame:
    """Intersect the offset-adjusted lists of the rarest two terms: (_row, window, len, start, around, from_word)."""
    rare = small(rare, rare.count())
    a = postings.filter(F.col("term") != END).join(rare, F.col("term") == F.col("a1")).withColumn("start", F.col("pos") - F.col("o1"))
    one = a.filter("len = 1")
    b = postings.filter(F.col("term") != END).select(F.col("_row").alias("r2"), F.col("term").alias("t2"), F.col("pos").alias("p2"))
    same = (F.col("_row") == F.col("r2")) & (F.col("a2") == F.col("t2"))
    two = a.filter("len > 1 and start >= 0").join(b, same & (F.col("p2") == F.col("start") + F.col("o2")))
    cols = ["_row", "window", "len", "start", "around", (F.col("lead") - F.col("o1")).alias("from_word")]
    return two.select(*cols).unionByName(one.select(*cols))


def phrases(postings: DataFrame, rare: DataFrame) -> DataFrame:
    """Exact matches (_row, window, len, start)."""
    here = F.array_join(F.slice(F.split("around", " "), F.col("from_word") + 1, F.col("len")), " ")
    return candidates(postings, rare).filter("from_word >= 0").filter(here == F.col("window")).select("_row", "window", "len", "start")


def proximity(postings: DataFrame, rare: DataFrame, slack: int, missing: int = 1) -> DataFrame:
    """Matches (_row, window, gap) where the words of a window stand within ``slack`` words of their places.

    A window of ``WINDOW`` words or more may lack ``missing`` (0 or 1) of them, so one of its rarest two terms is always
    there to start from. ``gap`` is the least slack that is enough. The postings need ``size`` + 2 ``slack`` words around.
    """
    both = F.array(F.struct(F.col("a1").alias("a"), F.col("o1").alias("o")), F.struct(F.col("a2").alias("a"), F.col("o2").alias("o")))
    starts = rare.select("window", "len", F.inline(both)).filter("a is not null")
    held = postings.filter(F.col("term") != END).join(small(starts, starts.count()), F.col("term") == F.col("a"))
    held = held.select("_row", "window", "len", F.split("window", " ").alias("w"), F.split("around", " ").alias("near"), (F.col("lead") - F.col("o")).alias("first"))
    least = F.col("len") - _missing(missing)

    def found(g: int, d: int) -> Column:
        """Whether enough words stand within g words of their places, for a window that starts d words before ``first``."""

        def there(k: Column) -> Column:
            low = F.col("first") - d + k - g
            return F.array_contains(F.slice("near", F.greatest(low, F.lit(0)) + 1, F.greatest(F.least(low, F.lit(0)) + 2 * g + 1, F.lit(0))), F.get("w", k))

        return F.size(F.filter(F.sequence(F.lit(0), F.col("len") - 1), there)) >= least

    common = F.size(F.array_intersect("near", "w")) >= F.size(F.array_distinct("w")) - _missing(missing)
    gap = F.coalesce(*(F.when(found(g, d), F.lit(g)) for g in range(slack + 1) for d in range(-g, g + 1)))
    return held.filter(common).withColumn("gap", gap).filter("gap is not null").groupBy("_row", "window").agg(F.min("gap").alias("gap"))


def report(docs: DataFrame, items: DataFrame, slack: int | None = None, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items and mark of every document, by exact matches.

    With ``slack`` also n_near, near_items and near_gap (the least, null without a match), from the same postings: the
    items with a window that the document holds exactly or nearly.
    """
    wins = cut(windows(items, size=size))
    rare = anchors(docs, wins, text, missing=0 if slack is None else 1)
    terms = rare.select(F.col("a1").alias("term")).union(rare.filter("a2 is not null").select("a2"))
    postings = index(docs, terms, key, text, size + 2 * (slack or 0))
    found = phrases(postings, rare).withColumn("end", F.col("start") + F.col("len"))
    before = Window.partitionBy("_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    covered = found.withColumn("fresh", fresh)
    per = covered.groupBy("_row").agg(F.sum("fresh").cast("long").alias("n_hit"), F.collect_set("window").alias("windows"))
    names = small(wins.groupBy("window").agg(F.collect_set("item_id").alias("ids")), wins.count())
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids"))))
    listed = per.select("_row", F.explode("windows").alias("window")).join(names, "window").groupBy("_row").agg(merged.alias("items"))
    hits = per.select("_row", "n_hit").join(listed, "_row")
    ends = postings.filter(F.col("term") == END).select("_row", "doc_id", "mark", F.col("pos").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    out = ends.join(hits, "_row", "left").withColumn("items", F.coalesce("items", none))
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    columns = ["doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n > 0).alias("contaminated"), "items", "mark"]
    if slack is not None:
        close = proximity(postings, rare, slack).join(names, "window").groupBy("_row").agg(merged.alias("near_items"), F.min("gap").alias("near_gap"))
        out = out.join(close, "_row", "left").withColumn("near_items", F.coalesce("near_items", none))
        columns += [F.size("near_items").cast("long").alias("n_near"), "near_items", "near_gap"]
    return out.select(*columns)


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, whose text holds no window of an item.

    Equal texts fall alike, so documents are found again by a hash of the text and the number of words.
    """
    m, n = fresh(docs, "_mark", "_n")
    bad = report(docs, items, key=key, text=text).filter("contaminated").select(F.col("mark").alias(m), F.col("n_words").alias(n)).distinct()
    same = (F.xxhash64(F.col(text).cast("string")) == F.col(m)) & (F.size(words(F.col(text))) == F.col(n))
    return docs.join(few(bad), same, "left_anti")


SQL = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[s + 1:s + {WINDOW}], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - {WINDOW - 1}))) AS s FROM i WHERE len(w) > 0) x),
grams AS (SELECT r, n, s, array_to_string(w[s + 1:s + n], ' ') AS g
    FROM (SELECT r, w, n, unnest(range(greatest(0, len(w) - n + 1))) AS s FROM t, (SELECT DISTINCT n FROM win) k) x),
hit AS (SELECT r, item_id, s, grams.n AS n FROM grams JOIN win USING (n, g)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) x GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY r),
place AS (SELECT g, n, unnest(v) AS word, generate_subscripts(v, 1) - 1 AS o FROM (SELECT DISTINCT g, n, string_split(g, ' ') AS v FROM win) x),
word AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM t),
often AS (SELECT word, count(*) AS c FROM word GROUP BY word),
anchor AS (SELECT g, word, o FROM place LEFT JOIN often USING (word) QUALIFY row_number() OVER (PARTITION BY g ORDER BY coalesce(c, 0), o) <= 2),
off AS (SELECT unnest(range(-{SLACK}, {SLACK + 1})) AS d),
start AS (SELECT DISTINCT r, g, p - o + d AS s FROM word JOIN anchor USING (word), off),
there AS (SELECT r, g, s, n, o, min(abs(d)) AS gap FROM (SELECT r, g, s, n, o, word, d, s + o + d AS p FROM start JOIN place USING (g), off) x JOIN word USING (r, word, p) GROUP BY r, g, s, n, o),
near AS (SELECT r, g, CASE WHEN count(*) FILTER (gap = 0) >= n - (n = {WINDOW})::INT THEN 0 ELSE 1 END AS gap FROM there GROUP BY r, g, s, n HAVING count(*) >= n - (n = {WINDOW})::INT),
close AS (SELECT r, count(DISTINCT item_id) AS n_near, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS near_items, min(gap) AS near_gap FROM near JOIN win USING (g) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
    coalesce(n_near, 0)::BIGINT AS n_near, coalesce(near_items, '') AS near_items, coalesce(near_gap, -1)::INTEGER AS near_gap
FROM t LEFT JOIN pos USING (r) LEFT JOIN its USING (r) LEFT JOIN close USING (r)
"""


@query("op6_decontamination", SQL)
def op6(spark, sf_dir):
    out = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slack=SLACK)
    return out.withColumn("near_items", F.array_join("near_items", ",")).withColumn("near_gap", F.coalesce("near_gap", F.lit(-1))).drop("items", "mark")
