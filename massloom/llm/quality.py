"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Words and pairs of neighbouring words are hashed into 2 ** bits buckets. Two multinomials over the buckets, one
of the trusted target (texts marked good, smoothed by the raw shares), one of the whole raw corpus, give a
log ratio per bucket, held as an integer of ten-thousandths. A document's score is the mean over
its n-grams. The model is 2 ** bits integers, whatever the size of the
corpus, and is a constant of the scan: scoring joins and shuffles nothing. (Published selection by hashed n-gram ratios uses 10,000 buckets.)

The threshold follows from the corpus: trusted texts of every `folds`-th fold are no part of the target model, and the threshold is the
score that all but `miss` per mille of them reach (the lowest one's at least; a text at the threshold passes). So it moves along with
the scores as tables grow. Without such a text it is 0.

Null and empty texts have no words and fail the base rules. Without a trusted text every log ratio counts as 0.
Repeated rows count as often as they occur, null ids are never trusted but are judged like
others, a text of any length is one row's arrays, an empty table gives none, and further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.llm.folds import remainder
from massloom.llm.workspace import Workspace, small

SPACE = r"[\x09-\x0D\x20]+"
SYMBOLS = "#*$%&|<>"
SCALE = 10_000
#: Ids of trusted texts up to this many are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _without(text: Column, characters: str) -> Column:
    """text without these characters; one search of its bytes for each, which is much faster than translate."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def hashes(text: Column) -> Column:
    """The words' 64-bit hashes: text is split once, and what follows handles numbers only."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _joined(column: str, shift: int) -> Column:
    """A hash of each element and the one `shift` places on."""
    n = F.greatest(F.size(column) - shift, F.lit(0))
    return F.zip_with(F.slice(column, F.lit(1), n), F.slice(column, F.lit(1 + shift), n), lambda a, b: F.xxhash64(a, b))


def base_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, hashes (of the words), pairs (of neighbours), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of docs (keep, text)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x09-\x0D\x20]"))
    out = docs.select(*keep, _without(text, " \n\t\r\x0b\x0c").alias("solid"), hashes(text).alias("hashes"), lines.alias("lines"))
    # a window of eight words is two of four, and so on: three passes over numbers
    out = out.withColumn("pairs", _joined("hashes", 1)).withColumn("fours", _joined("pairs", 2))
    windows = _joined("fours", 4)
    out = out.select(
        *keep,
        "hashes",
        "pairs",
        F.size("hashes").cast("long").alias("n_words"),
        F.char_length("solid").cast("long").alias("word_chars"),
        (F.char_length("solid") - F.char_length(_without(F.col("solid"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # only a text with equal windows pays for finding where they are
    equal = F.size(F.array_distinct("windows")) < F.size("windows")
    by_hash = F.when(equal, F.sort_array(F.transform("windows", lambda h, k: F.struct(h.alias("h"), k.alias("k")))))
    out = out.withColumn("by_hash", by_hash)
    twice = F.filter("by_hash", lambda x, i: ((i > 0) & (F.get("by_hash", i - 1)["h"] == x["h"])) | (F.coalesce(F.get("by_hash", i + 1)["h"] == x["h"], F.lit(False))))
    starts = F.sort_array(F.transform(twice, lambda x: x["k"]))

    def cover(acc: Column, k: Column) -> Column:
        return F.struct((acc["n"] + F.least(F.lit(8), k + 8 - acc["end"])).alias("n"), (k + 8).alias("end"))

    repeated = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), cover, lambda acc: acc["n"])
    return out.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)).cast("long")).drop("windows", "by_hash")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def _buckets(bits: int) -> Column:
    mask = F.lit((1 << bits) - 1)
    return F.transform(F.concat("hashes", "pairs"), lambda w: w.bitwiseAND(mask).cast("int"))


def log_ratios(work: Workspace, docs: DataFrame, trusted: DataFrame, bits: int, smoothing: float) -> list[int]:
    """The buckets' log ratios. trusted: doc_id. A bucket's target share is smoothed by its raw share, of weight smoothing * 2 ** bits."""
    ids = work.save(trusted.select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null").distinct(), "trusted")
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(small(ids, BROADCAST_ROWS), F.col("doc_id") == F.col("trusted_id"), "left")
    marked = marked.select(F.col("trusted_id").isNotNull().cast("int").alias("good"), hashes(F.col("text")).alias("hashes")).withColumn("pairs", _joined("hashes", 1))
    grams = marked.select("good", F.explode(_buckets(bits)).alias("bucket"))
    counts = work.save(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target")), "counts")
    total = counts.agg(F.sum("raw").alias("r"), F.sum("target").alias("t")).first()
    share, weight = F.col("raw") / F.lit(float(total["r"] or 1)), smoothing * (1 << bits)
    ratio = (F.col("target") + share * weight) / F.lit(float(total["t"] or 0) + weight) / share
    model = [0] * (1 << bits)
    for r in counts.select("bucket", F.round(F.log(ratio) * SCALE).cast("int").alias("v")).toLocalIterator():  # at most 2 ** bits rows
        model[r["bucket"]] = r["v"]
    return model


def quality(docs: DataFrame, trusted: DataFrame, bits: int = 16, smoothing: float = 4.0, folds: int = 5, miss: int = 20) -> DataFrame:
    """doc_id, the base counts, base_failed, score (mean log ratio, null without words), kept."""
    work = Workspace(docs.sparkSession, "quality")
    model = log_ratios(work, docs, trusted.where(remainder("doc_id", folds) != 0), bits, smoothing)
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")  # folds to one constant in the plan
    held = work.save(trusted.select(F.col("doc_id").alias("trusted_id")).where((remainder("trusted_id", folds) == 0) & F.col("trusted_id").isNotNull()).distinct(), "held")
    own = docs.join(small(held, BROADCAST_ROWS), F.col("doc_id") == F.col("trusted_id"), "left_semi")
    # written first: a filter moved into the counts would compute them again and again
    least = _threshold(work.save(_scored(own, table, bits).drop("doc_id"), "held-scores"), miss)
    scored = _scored(docs, table, bits)
    good = F.col("sum") >= F.col("n_grams") * least
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (F.col("sum") / F.nullif("n_grams", F.lit(0)) / SCALE).alias("score"), (~base_failed() & good).alias("kept"))


def _scored(docs: DataFrame, table: Column, bits: int) -> DataFrame:
    """doc_id, the base counts, sum of ten-thousandths and number of n-grams."""
    counted = base_counts(docs.select("doc_id", "text"), "doc_id").withColumn("buckets", _buckets(bits)).drop("hashes", "pairs")
    value = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, k: acc + F.get(table, k))
    return counted.withColumn("sum", value).withColumn("n_grams", F.size("buckets"))


def _threshold(held: DataFrame, miss: int) -> int:
    """In whole ten-thousandths, rounded down: what all but `miss` per mille of the texts that pass the base rules reach."""
    scores = held.where(~base_failed()).groupBy(F.floor(F.col("sum") / F.col("n_grams")).cast("int").alias("v")).agg(F.count("*").alias("n"))
    rows = sorted((r["v"], r["n"]) for r in scores.collect())  # at most one row for each ten-thousandth of a log ratio
    left = sum(n for _, n in rows) * miss // 1000
    for v, n in rows:
        if n > left:
            return v
        left -= n
    return 0
