"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The benchmark's items are cut into windows of consecutive words. Collection frequencies of the
benchmark's terms tell each window's two rarest ones; postings (term, document, position) are stored for those
terms. Subtracting a term's place in its window from its position gives the place where the window would
start, so the two lists are intersected by an equi-join on (document, window, start), rarest term first.
What is left is confirmed on all words of the documents themselves.

Words are runs of ASCII letters, digits and any non-ASCII characters, after lower-casing A-Z. Null and empty
texts have no words and no hits; items without a word have no windows. A posting names a row by a hash of its id and text, so rows
that repeat an id or have none are rows by themselves: places are confirmed, and items listed, on each row's own words. A very long text is one
row of postings like others. An empty table of documents gives none, an empty benchmark no hits.
Further columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.llm.workspace import Workspace, small

_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # between words, upper case not yet folded
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tables of terms up to this many rows are broadcast (about 100 bytes a row); larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Up to this many places that are to be confirmed go to the documents by broadcast (24 bytes each); more meet them by shuffle.
BROADCAST_PLACES = 1_000_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAPS), "")


def _fold(word: Column) -> Column:
    """Lower-case A-Z; a word with other letters goes the slower way that leaves those alone."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def _folded(text: Column) -> Column:
    return F.transform(_words(text), _fold)


def windows(items: DataFrame, size: int = 13) -> DataFrame:
    """item_id, wid, terms: the runs of `size` words of each item; an item of fewer words is one window."""
    words = items.select("item_id", _folded(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (size - 1)))
    cut = words.select("item_id", F.explode(F.transform(starts, lambda k: F.slice("words", k, size))).alias("terms"))
    return cut.select("item_id", F.xxhash64("terms").alias("wid"), "terms").distinct()


class Index:
    """Postings of the terms that the benchmark's windows are looked up by."""

    def __init__(self, work: Workspace, docs: DataFrame, items: DataFrame, size: int = 13):
        """docs: k (long), text."""
        self.work = work
        self.windows = work.save(windows(items, size), "windows")
        placed = self.windows.dropDuplicates(["wid"]).select("wid", F.posexplode("terms").alias("place", "term"))
        terms = work.save(placed.select("term").distinct(), "terms")
        tokens = docs.select("k", F.posexplode(_words(F.col("text"))).alias("pos", "word")).select("k", "pos", _fold(F.col("word")).alias("term"))
        self.frequency = work.save(tokens.join(small(terms, BROADCAST_ROWS), "term").groupBy("term").agg(F.count("*").alias("n")), "frequency")
        ranked = placed.join(small(self.frequency, BROADCAST_ROWS), "term").groupBy("wid").agg(F.sort_array(F.collect_list(F.struct("n", "place", "term"))).alias("by"))
        full = placed.groupBy("wid").agg(F.count("*").cast("int").alias("length"))
        # a window with a term that no document has can't occur
        ranked = ranked.join(full, "wid").where(F.size("by") == F.col("length"))
        rare, next_ = F.col("by")[0], F.when(F.size("by") > 1, F.col("by")[1]).otherwise(F.col("by")[0])
        self.keys = work.save(ranked.select("wid", "length", *(c[f].alias(f"{f}{k}") for k, c in ((1, rare), (2, next_)) for f in ("term", "place"))), "keys")
        wanted = work.save(self.keys.select(F.col("term1").alias("term")).union(self.keys.select("term2")).distinct(), "wanted")
        self.postings = work.save(tokens.join(small(wanted, BROADCAST_ROWS), "term").select("term", "k", "pos"), "postings")

    def candidates(self, slop: int = 0) -> DataFrame:
        """k, wid, start (from 0), length: where the two rarest terms stand at their distance, or within slop of it."""
        keys = small(self.keys, BROADCAST_ROWS)
        lists = [self.postings.join(keys.withColumnRenamed(f"term{k}", "term"), "term").select("k", "wid", "length", (F.col("pos") - F.col(f"place{k}")).alias("start"), F.lit(k).alias("list")) for k in (1, 2)]
        if not slop:  # what is on both lists, however often a row is repeated
            met = lists[0].unionAll(lists[1]).where("start >= 0").groupBy("k", "wid", "length", "start").agg(F.bit_or("list").alias("lists"))
            return met.where("lists = 3").drop("lists")
        first, second = (x.drop("list").distinct() for x in lists)
        second = second.select(F.col("k").alias("k2"), F.col("wid").alias("wid2"), F.col("start").alias("start2"))
        near = (F.col("k") == F.col("k2")) & (F.col("wid") == F.col("wid2")) & (F.abs(F.col("start") - F.col("start2")) <= slop)
        return first.join(second, near).select("k", "wid", "start", "length").distinct()


def _key(doc_id: Column, text: Column) -> Column:
    """Of a row of documents. Should two rows ever share it, each still confirms all places on its own words."""
    return F.xxhash64(doc_id, text)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key(F.col("doc_id"), F.col("text")).alias("k"), "text")


def _hits(work: Workspace, docs: DataFrame, items: DataFrame, size: int) -> tuple[Index, DataFrame]:
    """k, doc (the whole row), n_words, n_hit, wids: of every row of docs."""
    keyed = docs.select(F.struct("*").alias("doc"), _key(F.col("doc_id"), F.col("text")).alias("k"))
    index = Index(work, _keyed(docs), items, size)
    met = work.save(index.candidates(), "candidates")
    places = met.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("start", "length", "wid"))).alias("places"))
    places = work.save(places, "places")
    few = met.limit(BROADCAST_PLACES + 1).count() <= BROADCAST_PLACES
    work.keep(index.windows, places)
    joined = keyed.join(F.broadcast(places) if few else places, "k", "left")
    joined = joined.select("k", "doc", _words(F.col("doc.text")).alias("words"), "places")

    def there(p: Column) -> Column:
        return F.xxhash64(F.transform(F.slice("words", p["start"] + 1, p["length"]), _fold)) == p["wid"]

    found = joined.select("k", "doc", F.size("words").cast("long").alias("n_words"), F.when(F.col("places").isNotNull(), F.filter("places", there)).alias("found"))
    none = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))

    def cover(acc: Column, p: Column) -> Column:
        end = p["start"] + p["length"]
        return F.struct((acc["hit"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], p["start"]))).alias("hit"), F.greatest(acc["end"], end).alias("end"))

    n_hit = F.coalesce(F.aggregate("found", none, cover, lambda acc: acc["hit"]), F.lit(0)).cast("long")
    return index, found.select("k", "doc", "n_words", n_hit.alias("n_hit"), F.array_distinct(F.transform("found", lambda p: p["wid"])).alias("wids"))


def _contaminated(percent: int) -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, percent: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted, as strings), contaminated: for every row of docs."""
    work = Workspace(docs.sparkSession, "decontam")
    index, rows = _hits(work, docs.select("doc_id", "text"), items, size)
    rows = work.save(rows.select("k", F.col("doc.doc_id").alias("doc_id"), "n_words", "n_hit", "wids"), "hits")
    # the wids are part of the group, so that each row lists its own items
    met = rows.where("n_hit > 0").select("k", "wids").distinct().select("k", "wids", F.explode("wids").alias("wid"))
    met = met.join(small(index.windows.select("wid", F.col("item_id").cast("string").alias("item_id")), BROADCAST_ROWS), "wid")
    named = met.groupBy("k", "wids").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = rows.join(named, ["k", "wids"], "left")
    items_ = F.when(F.col("n_hit") > 0, F.col("items")).otherwise(F.array().cast("array<string>"))
    out = out.select("doc_id", "n_words", "n_hit", items_.alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", _contaminated(percent).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 13, percent: int = 5) -> DataFrame:
    """The rows of docs, with their columns, that are not contaminated."""
    work = Workspace(docs.sparkSession, "decontam")
    _, rows = _hits(work, docs, items, size)
    return rows.where(~_contaminated(percent)).select("doc.*")


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 3, size: int = 13) -> DataFrame:
    """doc_id, item_id, start: stretches of a window's length plus 2 * slop words that hold all its terms in any order.

    The window's two rarest terms stand within `slop` words of their distance. slop = 0 gives exact phrases.
    """
    work = Workspace(docs.sparkSession, "proximity")
    index = Index(work, _keyed(docs), items, size)
    places = work.save(index.candidates(slop), "places").join(small(index.windows, BROADCAST_ROWS), "wid")
    near = docs.select("doc_id", "text").join(places, _key(F.col("doc_id"), F.col("text")) == F.col("k"))
    low = F.greatest(F.lit(1), F.col("start") + 1 - slop)
    part = F.slice(_words(F.col("text")), low, F.col("start") + 1 + F.col("length") + slop - low)
    near = near.select("doc_id", "item_id", "start", "terms", F.transform(part, _fold).alias("part"))
    inside = F.col("part") == F.col("terms") if not slop else F.forall("terms", lambda t: F.array_contains("part", t))
    return near.where(inside).select("doc_id", "item_id", "start").distinct()
