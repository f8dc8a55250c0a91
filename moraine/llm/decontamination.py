"""Operator 7: benchmark passages in documents, by winnowed word fingerprints; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words once A-Z are lower case: every ASCII character but digits and lower-case letters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BREAK_CHARACTERS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: Bits of a packed fingerprint that hold its position: as many as an array's index has.  The hash's upper bits above them
#: order fingerprints, equal ones by position; the fingerprint itself is the whole hash.
_POSITION_BITS = 31


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once a row, also where ``use`` reads it in a lambda."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Words of a text; none for a null text.  ``lower`` stands in for the slower folding of A-Z where all is ASCII."""
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    parts = F.split(F.btrim(folded, F.lit(_BREAK_CHARACTERS)), BREAKS)
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def _steps(n: Column, width: int) -> Column:
    """0 .. n - width; empty if the span doesn't fit."""
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def _grams(h: Column, k: int) -> Column:
    """Hashes of every ``k`` consecutive words, from the words' hashes."""
    return F.transform(_steps(F.size(h), k), lambda i: F.xxhash64(*[h[i + j] for j in range(k)]))


def _winnowed(h: Column, k: int, window: int) -> Column:
    """(fingerprint, position, word hashes from window - 1 before the k-gram to window - 1 after it) of each k-gram that is the
    first smallest of some ``window`` consecutive ones."""
    reach, low = window - 1, (1 << _POSITION_BITS) - 1

    def pick(g: Column) -> Column:
        packed = F.transform(g, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
        least = bound(packed, lambda c: F.transform(_steps(F.size(c), window), lambda i: F.least(*[c[i + j] for j in range(window)]) if window > 1 else c[i]))
        at = F.transform(F.array_distinct(least), lambda x: x.bitwiseAND(F.lit(low)).cast("int"))
        padded = F.concat(F.array_repeat(F.lit(None).cast("long"), reach), h, F.array_repeat(F.lit(None).cast("long"), reach))
        return bound(padded, lambda p: F.transform(at, lambda i: F.struct(g[i].alias("fp"), i.alias("at"), F.slice(p, i + 1, k + 2 * reach).alias("near"))))

    return bound(_grams(h, k), pick)


def _whole(h: Column, m: int) -> Column:
    """Every m-gram as a fingerprint of its own, for items of ``m`` words."""
    empty = F.array().cast("array<bigint>")
    return bound(_grams(h, m), lambda g: F.transform(g, lambda x, i: F.struct(F.xxhash64(x, F.lit(m)).alias("fp"), i.alias("at"), empty.alias("near"))))


def contamination(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", span: int = 10, gram: int = 5, broadcast_rows: int = 200_000,
) -> DataFrame:
    """Words of each document inside any occurrence of ``span`` consecutive words of an item.

    Winnowing keeps, of every ``span - gram + 1`` consecutive ``gram``-word hashes, the smallest.  Any ``span`` shared words
    hold one kept hash on either side, so joining kept hashes finds every shared span; a joined pair is then extended over
    the words around it, and each ``span`` equal words become a hit.  An item of fewer than ``span`` words is one window and
    is looked up whole.  Words are compared by 64-bit hashes of the whole word.

    Returns one row for each row of ``docs``: ``id``, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted text ids),
    ``items_sha256``, ``contaminated`` and ``text_md5`` (of a null text as of an empty one).  Null and empty texts have no words; items without words never occur; items with
    equal ids count once, a null id as ``null``; repeated rows of ``docs`` each keep a row.  No items, or no documents, give
    no hits, or no rows.  Other columns are ignored.

    The items' fingerprints are broadcast up to ``broadcast_rows`` (counted first; about 200 bytes each); beyond it the same
    join is shuffled.  All else is one scan of the documents and one aggregation by document.
    """
    reach = span - gram
    own = items.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("null")).alias("item"), F.transform(words(F.col(item_text_col)), lambda x: F.xxhash64(x)).alias("h")).where(F.size("h") > 0).distinct()
    sizes = own.agg(F.collect_set(F.when(F.size("h") < span, F.size("h"))).alias("short"), F.sum(F.size("h")).alias("words")).first()
    short = sorted(sizes["short"])
    long_prints = own.where(F.size("h") >= span).select("item", F.lit(span).alias("width"), F.explode(_winnowed(F.col("h"), gram, reach + 1)).alias("x"))
    short_prints = [own.where(F.size("h") == m).select("item", F.lit(m).alias("width"), F.explode(_whole(F.col("h"), m)).alias("x")) for m in short]
    prints = long_prints
    for more in short_prints:
        prints = prints.unionByName(more)
    prints = prints.select(F.col("x.fp").alias("fp"), "item", "width", F.col("x.near").alias("item_near")).distinct()
    prints = F.broadcast(prints) if (sizes["words"] or 0) <= broadcast_rows else prints

    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    own_prints = lambda h: F.concat(_winnowed(h, gram, reach + 1), *[_whole(h, m) for m in short])
    row_mark = lambda h: F.array(F.struct(F.xxhash64(F.lit("row"), h).alias("fp"), (-1 - F.size(h)).alias("at"), F.array().cast("array<bigint>").alias("near")))
    scanned = rows.select("id", F.md5(F.coalesce(text, F.lit(""))).alias("sum"), text.isNull().alias("none"), bound(words(text), lambda w: bound(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.concat(row_mark(h), own_prints(h)))).alias("prints"))
    each = scanned.select("id", "sum", "none", F.explode("prints").alias("x")).select("id", "sum", "none", F.col("x.fp").alias("fp"), F.col("x.at").alias("at"), F.col("x.near").alias("near"))
    joined = each.join(prints, "fp", "left").where((F.col("at") < 0) | F.col("item").isNotNull())

    # starts of equal windows around a joined pair; the pair itself for a whole short item
    equal = lambda i: F.forall(F.sequence(i, i + span - 1), lambda j: F.coalesce(F.col("near")[j] == F.col("item_near")[j], F.lit(False)))
    around = F.transform(F.filter(F.sequence(F.lit(0), F.lit(reach)), equal), lambda i: F.col("at") + i - reach)
    starts = F.when(F.col("at") < 0, F.array().cast("array<int>")).when(F.size("item_near") == 0, F.array("at")).otherwise(around)
    hits = joined.withColumn("starts", starts).where((F.col("at") < 0) | (F.size("starts") > 0))
    found = hits.groupBy("id", "sum", "none").agg(
        F.max(F.when(F.col("at") < 0, -1 - F.col("at"))).alias("n_words"),
        F.count(F.when(F.col("at") < 0, True)).cast("int").alias("copies"),
        F.collect_set(F.when(F.col("at") >= 0, F.struct("starts", "width"))).alias("spans"),
        F.array_sort(F.collect_set(F.when(F.col("at") >= 0, F.col("item")))).alias("items"),
    )
    places = F.array_distinct(F.flatten(F.flatten(F.transform("spans", lambda s: F.transform(s["starts"], lambda a: F.sequence(a, a + s["width"] - 1))))))
    return (
        found.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("id", F.col("n_words").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), F.col("sum").alias("text_md5"))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def clean_documents(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, with no word in an occurrence of an item's window."""
    found = contamination(docs, items, id_col=id_col, text_col=text_col, **options)
    bad = found.where("contaminated").select(F.col("id").alias("_id"), F.col("text_md5").alias("_md5")).distinct()
    own = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("_id")) & (own == F.col("_md5")), "left_anti")


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bp AS (
  SELECT item, w, least(10, len(w)) AS m, unnest(range(1, CAST(len(w) - least(10, len(w)) + 2 AS BIGINT))) AS p FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item, m, array_to_string(list_slice(w, p, p + m - 1), ' ') AS g FROM bp
), dp AS (
  SELECT rid, w, m, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS p FROM d, (SELECT DISTINCT m FROM bw) AS lengths WHERE len(w) >= m
), dw AS (
  SELECT rid, m, p, array_to_string(list_slice(w, p, p + m - 1), ' ') AS g FROM dp
), hit AS (
  SELECT rid, item, p, dw.m AS m FROM dw JOIN bw USING (m, g)
), place AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + m)) AS q FROM hit) AS x GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) AS x GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN place USING (rid) LEFT JOIN named USING (rid)
"""
