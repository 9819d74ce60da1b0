"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame operations only.

Items are cut into windows of ten consecutive words (a shorter item is one
window). The tokens of the join are shingles of three words, ordered by how
often they occur in all documents. A window that occurs in a document has all
its shingles there, so one is a sufficient prefix: its rarest. Documents'
shingles are joined with these, places that leave no room for the window before
or after are dropped, and the rest is compared word by word.

One pass over the texts finds all places of the items' shingles, compared word
by word, and writes them down; counts, prefixes and windows come from there, and
a window is exact if the shingles that cover its words follow each other.
Shingles are broadcast in blocks of at most BLOCK_SHINGLES rows; a larger
benchmark takes more blocks, each a pass over the documents. Up to
BROADCAST_PREFIXES windows that occur are broadcast too, more are joined by a shuffle. No document text
is shuffled: what is dealt out is one row a document and one a found shingle.

Nulls and edge cases: a null or empty text has no words. Items with null id are
ignored; items that share an id count as one; items without words have no
window. Rows that agree in id and text are counted once and given back as often
as they came; rows of the same id and different texts are separate documents.
Extra columns are ignored, or kept by `clean`. Empty tables: no rows, or none
contaminated.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, fresh, written

WINDOW_WORDS, SHINGLE_WORDS = 10, 3
BLOCK_SHINGLES, BROADCAST_PREFIXES = 200_000, 50_000
#: What separates words, and letters other than A-Z that have a lower case.
CUT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OTHER_CAPITALS = r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]"


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only. lower() does it, and fast, unless other capitals occur."""
    plain = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(text.rlike(OTHER_CAPITALS), plain).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), CUT), "")


def kept(column: Column) -> Column:
    """As it is, but computed once: without this the optimizer may write a split into lambdas, where it runs once a word."""
    return F.explode(F.array(column))


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: (window, n, size, items); size is the words in its shingles."""
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), kept(words(F.col(text_col))).alias("w"))
    rows = rows.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(WINDOW_WORDS)))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    rows = rows.select("item", "n", F.slice("w", F.col("at"), F.col("n")).alias("window"))
    grouped = rows.groupBy("window", "n").agg(F.collect_set("item").alias("items"))
    return grouped.withColumn("size", F.least("n", F.lit(SHINGLE_WORDS)))


def tokens(found: DataFrame) -> DataFrame:
    """The windows' shingles: (window, n, size, items, at, shingle), shingle an array of words."""
    rows = found.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))))
    return rows.withColumn("shingle", F.slice("window", F.col("at") + 1, F.col("size")))


def _hashes(size: int) -> Column:
    """Hashes of all runs of size words of the column w, by place."""
    heads = F.slice("w", F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(0)))
    return F.transform(heads, lambda x, i: F.xxhash64(x, *(F.get(F.col("w"), i + j) for j in range(1, size))))


def occurrences(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Where the shingles occur in docs (id, text): (id, mark, n_words, pos, shingle).

    Each row of docs also gives a row whose shingle is null.
    """
    got = []
    sizes = [r["size"] for r in shingles.select("size").distinct().orderBy("size").collect()] or [SHINGLE_WORDS]
    for size in sizes:
        own = shingles.where(F.col("size") == size).select(F.xxhash64(*(F.col("shingle")[k] for k in range(size))).alias("h"), F.array_join("shingle", " ").alias("shingle"), F.col("shingle").alias("words"))
        n = max(1, -(-own.count() // BLOCK_SHINGLES))
        for k in range(n):
            block, first = own.where(F.pmod("h", F.lit(n)) == k), not got
            hashes = _hashes(size)
            if first:  # the last place in each row stands for the row itself
                hashes = F.concat(hashes, F.array(F.lit(0).cast("long")))
                block = block.unionByName(docs.sparkSession.sql("select 0L h, cast(null as string) shingle, cast(null as array<string>) words"))
            rows = docs.select("id", F.xxhash64("text").alias("mark"), kept(words(F.col("text"))).alias("w"))
            rows = rows.withColumn("h", hashes).select("id", "mark", "w", F.posexplode("h").alias("pos", "h"))
            last = F.greatest(F.size("w") - (size - 1), F.lit(0))
            right = (F.slice("w", F.col("pos") + 1, F.lit(size)) == F.col("words")) if not first else F.coalesce(F.slice("w", F.col("pos") + 1, F.lit(size)) == F.col("words"), F.col("pos") == last)
            got.append(rows.join(F.broadcast(block), "h").where(right).select("id", "mark", F.size("w").alias("n_words"), "pos", "shingle"))
    return reduce(DataFrame.union, got)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    grouped = hits(docs, items, id_col, text_col, item_col, item_text)
    out = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    ids = F.array_sort("items")
    return out.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, mark, copies, n_words, n_hit, items) for each distinct id and text; mark is the text's hash."""
    found = written(windows(items, item_col, item_text), "bench-windows")
    each = tokens(found)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    seen = written(occurrences(rows, each.select("shingle", "size").distinct()), "occurrences")
    whole = seen.where("shingle is null").groupBy("id", "mark").agg(F.max("n_words").alias("n_words"), F.count("*").alias("copies"))
    seen = seen.where("shingle is not null")

    # The rarest shingle is the prefix; those at every third word, and the last, cover the window's words.
    each = each.select("window", "n", "items", "at", F.array_join("shingle", " ").alias("shingle"), ((F.col("at") % F.col("size") == 0) | (F.col("at") == F.col("n") - F.col("size"))).alias("covers"))
    ranked = each.join(seen.groupBy("shingle").agg(F.count("*").alias("count")), "shingle", "left")
    need = F.collect_list(F.when(F.col("covers"), F.struct("at", "shingle"))).alias("need")
    prefix = ranked.groupBy("window", "n", "items").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "at")).alias("best"), need)
    prefix = written(prefix.where("best.count > 0").select("best.shingle", "best.at", "n", F.array_join("window", " ").alias("window"), "items", "need"), "prefixes")

    if prefix.count() <= BROADCAST_PREFIXES:  # a frequent word that is an item, or a much-shared shingle, is then no hot key
        prefix = F.broadcast(prefix)
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    near = seen.join(prefix, "shingle").where(fits).select("id", "mark", start.alias("start"), "n", "window", "items", "need")
    parts = near.select(F.col("id").alias("id1"), F.col("mark").alias("mark1"), "start", "n", "window", "items", F.size("need").alias("parts"), F.explode("need").alias("part"))
    parts = parts.select("*", (F.col("start") + F.col("part.at")).alias("pos1"), F.col("part.shingle").alias("shingle1"))
    same = F.col("id").eqNullSafe(F.col("id1")) & (F.col("mark") == F.col("mark1")) & (F.col("pos") == F.col("pos1")) & (F.col("shingle") == F.col("shingle1"))
    exact = seen.join(parts, same).groupBy("id", "mark", "start", "n", "window", "parts").agg(F.count_distinct("pos").alias("got"), F.first("items").alias("items")).where("got = parts")

    spans = exact.groupBy("id", "mark").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop")))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(a["to"], x["start"]))).alias("n"), F.greatest(a["to"], x["stop"]).alias("to"))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step)["n"].cast("long")
    spans = spans.select(F.col("id").alias("id2"), F.col("mark").alias("mark2"), n_hit.alias("n_hit"), "items")
    both = whole.join(spans, F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2")), "left")
    return both.select("id", "mark", "copies", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no window of an item, with docs' columns."""
    bad = hits(docs, items, id_col, text_col, item_col, item_text).where("n_hit > 0")
    a, b, c = fresh(docs, "bad_id"), fresh(docs, "bad_mark"), fresh(docs, "mark")
    bad = checked(written(bad.select(F.col("id").alias(a), F.col("mark").alias(b)), "contaminated"))  # few, so that texts need no shuffle
    marked = docs.withColumn(c, F.xxhash64(text_col))
    return marked.join(bad, F.col(id_col).eqNullSafe(F.col(a)) & (F.col(c) == F.col(b)), "left_anti").drop(c)


ORACLE = r"""
with d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select cast(item_id as varchar) as item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null),
bw as (
  select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as win
  from (select item, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (
  select r, n, i, array_to_string(w[i : i + n - 1], ' ') as win
  from (select d.r, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) as i from d, sizes s where len(d.w) >= s.n)),
m as (select dw.r, dw.i, dw.n, bw.item from dw join bw on dw.n = bw.n and dw.win = bw.win),
hit as (select r, count(*) as n_hit from (select distinct r, p from (select r, unnest(range(i, i + n)) as p from m)) group by r),
it as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from m) group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(hit.n_hit, 0) as bigint) as n_hit,
  cast(coalesce(it.n_items, 0) as bigint) as n_items, sha256(coalesce(it.items, '')) as items_sha256, coalesce(hit.n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join it using (r)
"""
