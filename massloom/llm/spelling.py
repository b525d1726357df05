"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

A word of l code points is cut into two segments, the first of l // 2. One edit leaves one of them as it is, so a word of as many or one fewer code points that
is one edit away holds the first segment at its beginning or the second at its end, which is where an edit before it would have
shifted it to. Each word is indexed under its two segments and probes with four substrings; the join on (length, segment, substring) checks
each candidate by its edit distance before it becomes a row, and a candidate that both segments find is taken from the first one. Segments that very many
words share are split on the index side, so that no join task holds them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.llm.workspace import Workspace, small

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def corpus_words(docs: DataFrame, least_length: int = 6, least_n: int = 5, every: int = 199) -> DataFrame:
    """word, n: the words of whole texts with their number of occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; of a run whose CRC-32 (of `<doc_id>:<run>`) `every` divides, the code point at that
    CRC modulo the run's length is deleted. Shorter results and rarer ones don't count. A null text has no words, a null id counts as empty text.
    """
    # a run of fewer code points can't come to be a longer one, so only these are cut out of the text
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    own = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("of"), F.explode(runs).alias("run"))
    own = own.select("of", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.crc32(F.encode(F.concat("of", "run"), "UTF-8"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(h % every == 0, cut).otherwise(F.col("run"))
    return own.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least_n) & (F.length("word") >= least_length))


def _key(length: Column, segment: int, text: Column) -> Column:
    return F.struct(length.alias("length"), F.lit(segment).alias("segment"), text.alias("text"))


def near_words(work: Workspace, words: DataFrame, group: int = 1000, most_hot: int = 100_000) -> DataFrame:
    """a, n_a, b, n_b: each pair of different words one insertion, deletion or replacement of a code point apart, once; b is the longer one, or the later one of equal length.

    words: word (distinct, 2 code points at least), n. A segment's words are met in groups of about `group`.
    """
    length, half = F.length("word"), F.floor(F.length("word") / 2)
    index = words.select("word", "n", F.explode(F.array(_key(length, 0, F.substring("word", F.lit(1), half.cast("int"))), _key(length, 1, F.substring("word", (half + 1).cast("int"), length)))).alias("key"))
    probes = []
    for more in (0, 1):  # the other word has as many code points, or one more
        first = F.floor((length + more) / 2).cast("int")
        probes += [_key(length + more, 0, F.substring("word", F.lit(1), first)), _key(length + more, 1, F.substring("word", first + 1 - more, length))]
    probe = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(F.array(*probes)).alias("key"))
    hot = work.save(index.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > group).select("key", F.ceil(F.col("many") / group).alias("groups")), "hot")
    groups = F.coalesce("groups", F.lit(1))
    index = index.join(small(hot, most_hot), "key", "left").select("key", F.pmod(F.xxhash64("word"), groups).alias("part"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    probe = probe.join(small(hot, most_hot), "key", "left").select("key", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)).alias("part"), "a", "n_a")
    first = F.floor(F.length("b") / 2).cast("int")
    again = (F.col("key.segment") == 1) & (F.substring("a", F.lit(1), first) == F.substring("b", F.lit(1), first))
    one = (F.col("key.length") > F.length("a")) | (F.col("a") < F.col("b"))
    pairs = probe.join(index, ["key", "part"]).where(one & ~again & (F.levenshtein("a", "b", 1) == 1))
    return pairs.select("a", "n_a", "b", "n_b")


def _roots(work: Workspace, forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain of forms; the part of a chain that is known doubles in each round."""
    now = work.save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = work.save(now.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        work.drop(now)
        now = after.drop("moved")
        now._massloom_path = after._massloom_path
        if not after.where("moved").limit(1).count():
            return now


def spelling_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n, root for each row of words (word, n; distinct words).

    n_near: words one edit away. form: of these the one of largest n (ties: the first in code-point order), if its n is at least `times` that of the word; else null,
    as is form_n. root: the last of the chain of forms, the word itself if it has none (n grows along a chain, so it ends). An empty table gives an empty one.
    """
    work = Workspace(words.sparkSession, "spelling")
    words = work.save(words.select("word", "n"), "words")
    pairs = work.save(near_words(work, words), "pairs")
    both = pairs.select(F.col("a").alias("of"), "n_a", F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("near")).alias("other"))
    both = both.unionAll(pairs.select("b", "n_b", F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("near"))))
    near = both.groupBy("of").agg(F.count("*").alias("n_near"), F.min("other").alias("best"), F.first("n_a").alias("own"))
    good = -F.col("best.less") >= times * F.col("own")
    near = work.save(near.select("of", "n_near", F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")), "near")
    roots = _roots(work, near.where("form is not null").select(F.col("of").alias("word"), "form"))
    near = near.join(roots, F.col("of") == F.col("word"), "left").drop("word")
    out = words.join(near, F.col("word") == F.col("of"), "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
