"""Queries over the driver's tables, each beside the SQL that gives the same rows.

Tables of other domains stand in for spectra and sequences: letters of texts are residues, users are spectra.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions import chemistry as ch
from massloom.functions.modifications import MODIFICATIONS as _MODS
from massloom.functions.text import CODONS, trigrams
from massloom.functions.tolerance import Tolerance, signed_ppm
from massloom.operators import digest as dg
from massloom.operators import fragments as fr
from massloom.operators import generate, joins, ranking, spectra
from massloom.operators import modifications as md
from massloom.operators import statistics as stats
from massloom.session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _residues(text: str) -> Column:
    return F.upper(F.regexp_replace(text, "[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]", ""))


_SQL_RESIDUES = "upper(regexp_replace({}, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '', 'g'))"
_TRYPSIN = "(?:[KR]P|[^KR])*[KR]?"


@_query("""SELECT l.p_partkey AS left_key, r.p_partkey AS right_key, round((l.p_retailprice - r.p_retailprice) / l.p_retailprice * 1e6, 4) AS ppm
FROM part l JOIN part r ON abs(l.p_retailprice - r.p_retailprice) <= 0.0002 * abs(l.p_retailprice) WHERE l.p_partkey <> r.p_partkey""")
def ppm_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    left = part.select(F.col("p_partkey").alias("left_key"), F.col("p_retailprice").alias("a"))
    right = part.select(F.col("p_partkey").alias("right_key"), F.col("p_retailprice").alias("b"))
    out = joins.band_join_of_values(left, right, ("a", "b"), Tolerance(0.0002), ppm=F.round(signed_ppm(F.col("a"), F.col("b")), 4))
    return out.where("left_key <> right_key").select("left_key", "right_key", "ppm")


@_query("""WITH p AS (SELECT p_retailprice / 100 AS mz, min(p_partkey) AS p_partkey FROM part GROUP BY 1),
m AS (SELECT event_id, p_partkey, mz, abs(value - mz) AS d FROM events JOIN p ON abs(value - mz) <= 0.05)
SELECT event_id, p_partkey, round(d, 6) AS difference FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, mz, p_partkey) AS k FROM m) WHERE k = 1""")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _table(spark, sf_dir, "part").groupBy((F.col("p_retailprice") / 100).alias("mz")).agg(F.min("p_partkey").alias("p_partkey"))
    events = _table(spark, sf_dir, "events").select("event_id", "value")
    met = joins.nearest_join(events, prices, ("value", "mz"), Tolerance.absolute(0.05), ["event_id"], [F.col("mz"), F.col("p_partkey")])
    return met.select("event_id", "p_partkey", F.round(F.abs(F.col("value") - F.col("mz")), 6).alias("difference"))


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - 1e-5) AS lo, l_extendedprice * (1 + 1e-5) AS hi, l_quantity - 0.02 AS abs_lo, l_quantity + 0.02 AS abs_hi FROM lineitem""")
def tolerance_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = Tolerance.parse("10ppm").bounds(F.col("l_extendedprice"))
    alo, ahi = Tolerance.parse("0.02 da").bounds(F.col("l_quantity"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", lo.alias("lo"), hi.alias("hi"), alo.alias("abs_lo"), ahi.alias("abs_hi"))


@_query("""WITH cents AS (SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS intensity FROM events),
a AS (SELECT *, sum(intensity) OVER (PARTITION BY user_id) AS t FROM cents), b AS (SELECT * FROM a WHERE intensity > t * 0.005),
c AS (SELECT *, max(intensity) OVER (PARTITION BY user_id) AS m FROM b)
SELECT event_id, user_id, intensity FROM c WHERE intensity > m * 0.1 AND intensity > 500""")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = _table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("intensity"))
    return spectra.noise_filter(peaks, "user_id", tic=0.005, base=0.1, absolute=500)


@_query("""WITH p AS (SELECT user_id, value AS mz, CAST(event_id % 997 AS BIGINT) AS intensity FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY intensity DESC, mz) AS k FROM p)
SELECT user_id, count(*) AS n_peaks, CAST(sum(intensity) AS BIGINT) AS tic, max(intensity) AS base_intensity, max(CASE WHEN k = 1 THEN mz END) AS base_mz, min(mz) AS min_mz, max(mz) AS max_mz FROM b GROUP BY user_id""")
def spectrum_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = _table(spark, sf_dir, "events").select("user_id", F.col("value").alias("mz"), (F.col("event_id") % 997).alias("intensity"))
    return spectra.spectrum_summary(peaks, "user_id")


def _cut_fragments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Peaks: events of a user. Fragments: b and y ions of part names, dealt to users by the part's key."""
    peaks = _table(spark, sf_dir, "events").select(F.col("user_id").alias("spectrum_id"), F.col("event_id").alias("peak_idx"), (F.col("value") * 8 + 60).alias("mz"), (F.col("event_id") % 997 + 1).alias("intensity"))
    parts = _table(spark, sf_dir, "part").select((F.col("p_partkey") % 150).alias("spectrum_id"), "p_partkey", _residues("p_name").alias("peptide"))
    model = fr.FragmentModel((fr.Series("b"), fr.Series("y")), (1, 2))
    ions = fr.fragments(parts, model, ["spectrum_id", "p_partkey"])
    name = F.concat_ws(":", F.col("p_partkey").cast("string"), "ion", F.col("index").cast("string"), F.col("charge").cast("string"))
    return ions.withColumn("fragment_id", name), peaks


_MASSES = "(VALUES " + ", ".join(f"('{a}', {ch.MONO[a]!r}::DOUBLE)" for a in ch.STANDARD) + ") AS aa(a, m)"
_SQL_LADDER = f"""names AS (SELECT p_partkey, {_SQL_RESIDUES.format("p_name")} AS s FROM part),
res AS (SELECT p_partkey, length(s) AS n, k, m FROM (SELECT p_partkey, s, unnest(range(1, length(s) + 1)) AS k FROM names) JOIN {_MASSES} ON a = substr(s, k, 1)),
sums AS (SELECT p_partkey, n, k, sum(m) OVER (PARTITION BY p_partkey ORDER BY k ROWS UNBOUNDED PRECEDING) AS p, sum(m) OVER (PARTITION BY p_partkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS t FROM res),
neutral AS (SELECT p_partkey, 'b' AS ion, k AS index, k AS position, p + {fr.N_TERMINAL["b"]!r} AS neutral FROM sums WHERE k < n
UNION ALL SELECT p_partkey, 'y', n - k, k + 1, t - p + {fr.C_TERMINAL["y"]!r} FROM sums WHERE k < n),
ions AS (SELECT p_partkey, ion, CAST(index AS INTEGER) AS index, CAST(position AS INTEGER) AS position, z AS charge, (neutral + z * {ch.PROTON!r}::DOUBLE) / z AS mz FROM neutral, (VALUES (1), (2)) AS c(z))"""


@_query(f"WITH {_SQL_LADDER} SELECT p_partkey, ion, index, position, charge, round(mz, 5) AS mz FROM ions")
def fragment_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    ions, _ = _cut_fragments(spark, sf_dir)
    return ions.select("p_partkey", "ion", "index", "position", "charge", F.round("mz", 5).alias("mz"))


_SQL_MET = f"""{_SQL_LADDER}, f AS (SELECT p_partkey % 150 AS spectrum_id, concat_ws(':', p_partkey, ion, index, charge) AS fragment_id, * FROM ions),
p AS (SELECT user_id AS spectrum_id, event_id AS peak_idx, value * 8 + 60 AS mz, event_id % 997 + 1 AS intensity FROM events),
met AS (SELECT * FROM (SELECT f.spectrum_id, fragment_id, ion, position, peak_idx, intensity, row_number() OVER (PARTITION BY f.spectrum_id, fragment_id ORDER BY abs(f.mz - p.mz), p.mz, peak_idx) AS k
FROM f JOIN p ON f.spectrum_id = p.spectrum_id AND abs(f.mz - p.mz) <= 0.05) WHERE k = 1)"""


@_query(f"""WITH {_SQL_MET}, a AS (SELECT spectrum_id, count(*) AS n_fragments, count(DISTINCT position) AS n_positions FROM f GROUP BY 1),
b AS (SELECT spectrum_id, count(*) AS n_peaks, CAST(sum(intensity) AS BIGINT) AS intensity FROM p GROUP BY 1),
c AS (SELECT spectrum_id, count(*) AS fragments_found, count(DISTINCT position) AS positions_found FROM met GROUP BY 1),
d AS (SELECT spectrum_id, count(*) AS peaks_found, CAST(sum(intensity) AS BIGINT) AS intensity_found FROM (SELECT DISTINCT spectrum_id, peak_idx, intensity FROM met) GROUP BY 1)
SELECT spectrum_id, n_peaks, intensity, coalesce(n_fragments, 0) AS n_fragments, coalesce(n_positions, 0) AS n_positions, coalesce(fragments_found, 0) AS fragments_found,
coalesce(positions_found, 0) AS positions_found, coalesce(peaks_found, 0) AS peaks_found, coalesce(intensity_found, 0) AS intensity_found FROM b LEFT JOIN a USING (spectrum_id) LEFT JOIN c USING (spectrum_id) LEFT JOIN d USING (spectrum_id)""")
def annotate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ions, peaks = _cut_fragments(spark, sf_dir)
    return spectra.scores(ions, peaks, spectra.annotate(ions, peaks, Tolerance.absolute(0.05)))


@_query(f"""WITH {_SQL_MET}, t AS (SELECT spectrum_id, ion, count(DISTINCT position) AS total FROM f GROUP BY ALL), g AS (SELECT spectrum_id, ion, count(DISTINCT position) AS found FROM met GROUP BY ALL)
SELECT spectrum_id, ion, coalesce(found, 0) AS found, total FROM t LEFT JOIN g USING (spectrum_id, ion)""")
def series_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ions, peaks = _cut_fragments(spark, sf_dir)
    return spectra.series_scores(ions, spectra.annotate(ions, peaks, Tolerance.absolute(0.05)))


@_query(f"""WITH {_SQL_LADDER}, f AS (SELECT DISTINCT p_partkey % 150 AS spectrum_id, mz FROM ions),
p AS (SELECT user_id AS spectrum_id, event_id AS peak_idx, value * 8 + 60 AS mz FROM events),
s AS (SELECT * FROM (SELECT NULL::INTEGER AS k UNION ALL SELECT CAST(unnest(range(-25, 26)) AS INTEGER))),
q AS (SELECT spectrum_id, peak_idx, k, coalesce(mz + {math.pi!r}::DOUBLE + k, mz) AS mz FROM p, s),
h AS (SELECT q.spectrum_id, k, count(DISTINCT peak_idx) AS hits FROM q JOIN f ON q.spectrum_id = f.spectrum_id AND abs(q.mz - f.mz) <= 0.05 GROUP BY ALL),
t AS (SELECT spectrum_id, sum(CASE WHEN k IS NULL THEN hits ELSE 0 END) AS a, sum(CASE WHEN k IS NOT NULL THEN hits ELSE 0 END) AS s, sum(CASE WHEN k IS NOT NULL THEN hits * hits ELSE 0 END) AS q FROM h GROUP BY 1)
SELECT spectrum_id, n_peaks, round(coalesce(a, 0) / n_peaks, 9) AS actual, round(coalesce(s, 0) / (n_peaks * 51), 9) AS average, round(sqrt(coalesce(q, 0) * 51 - coalesce(s, 0) * coalesce(s, 0)) / (n_peaks * 51), 9) AS deviation
FROM (SELECT spectrum_id, count(*) AS n_peaks FROM p GROUP BY 1) LEFT JOIN t USING (spectrum_id)""")
def shift_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    ions, peaks = _cut_fragments(spark, sf_dir)
    out = spectra.shift_fdr(ions, peaks, Tolerance.absolute(0.05))
    return out.select("spectrum_id", "n_peaks", *(F.round(c, 9).alias(c) for c in ("actual", "average", "deviation")))


@_query(f"""WITH {_SQL_LADDER}, f AS (SELECT DISTINCT p_partkey % 150 AS spectrum_id, mz FROM ions),
p AS (SELECT user_id AS spectrum_id, event_id AS peak_idx, value * 8 + 60 AS mz, event_id % 997 + 1 AS i FROM events),
q AS (SELECT spectrum_id, peak_idx, i, k, coalesce(mz + {math.pi!r}::DOUBLE + k, mz) AS mz FROM p, (SELECT NULL::INTEGER AS k UNION ALL SELECT CAST(unnest(range(-25, 26)) AS INTEGER))),
h AS (SELECT spectrum_id, k, sum(i) AS i FROM (SELECT DISTINCT q.spectrum_id, k, peak_idx, i FROM q JOIN f ON q.spectrum_id = f.spectrum_id AND abs(q.mz - f.mz) <= 0.05) GROUP BY ALL),
t AS (SELECT spectrum_id, sum(CASE WHEN k IS NULL THEN i ELSE 0 END) AS a, sum(CASE WHEN k IS NOT NULL THEN i ELSE 0 END) AS s, sum(CASE WHEN k IS NOT NULL THEN i * i ELSE 0 END) AS q FROM h GROUP BY 1)
SELECT spectrum_id, round(coalesce(a, 0) / total, 9) AS actual, round(coalesce(s, 0) / (total * 51), 9) AS average, round(sqrt(coalesce(q, 0) * 51 - coalesce(s, 0) * coalesce(s, 0)) / (total * 51), 9) AS deviation
FROM (SELECT spectrum_id, sum(i) AS total FROM p GROUP BY 1) LEFT JOIN t USING (spectrum_id)""")
def intensity_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the intensity that fragments explain, and that they explain in shifted spectra."""
    ions, peaks = _cut_fragments(spark, sf_dir)
    out = spectra.shift_fdr(ions, peaks, Tolerance.absolute(0.05), intensity="intensity")
    return out.select("spectrum_id", *(F.round(f"intensity_{c}", 9).alias(c) for c in ("actual", "average", "deviation")))


_SQL_PIECES = f"""pieces AS (SELECT doc_id, list_filter(regexp_extract_all({_SQL_RESIDUES.format("text")}, '{_TRYPSIN}'), lambda x: x <> '') AS p FROM documents),
spread AS (SELECT doc_id, p, CAST(unnest(range(0, len(p))) AS INTEGER) AS first_piece FROM pieces),
cut AS (SELECT doc_id, first_piece, 0 AS missed, p[first_piece + 1] AS peptide FROM spread UNION ALL
SELECT doc_id, first_piece, 1, p[first_piece + 1] || p[first_piece + 2] FROM spread WHERE first_piece + 2 <= len(p)),
peptides AS (SELECT * FROM cut WHERE length(peptide) BETWEEN 6 AND 30)"""


def _peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    proteins = _table(spark, sf_dir, "documents").select("doc_id", _residues("text").alias("sequence"))
    return dg.digest(proteins, dg.PROTEASES["trypsin_not_before_proline"])


@_query(f"WITH {_SQL_PIECES} SELECT doc_id, first_piece, missed, peptide FROM peptides")
def digest_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _peptides(spark, sf_dir)


@_query(f"WITH {_SQL_PIECES} SELECT doc_id, first_piece, missed, round({ch.sql_residue_sum('peptide')} + {ch.WATER!r}::DOUBLE, 5) AS mass FROM peptides")
def peptide_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _peptides(spark, sf_dir).select("doc_id", "first_piece", "missed", F.round(ch.peptide_mass(F.col("peptide")), 5).alias("mass"))


@_query(f"""WITH {_SQL_PIECES}, m AS (SELECT DISTINCT peptide, {ch.sql_residue_sum('peptide')} + {ch.WATER!r}::DOUBLE AS mass FROM peptides),
o AS (SELECT p_partkey, p_retailprice AS observed FROM part),
j AS (SELECT p_partkey, peptide, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(observed - mass), peptide) AS rank FROM o JOIN m ON abs(observed - mass) <= 1e-5 * abs(observed))
SELECT p_partkey, CAST(rank AS INTEGER) AS rank, peptide FROM j WHERE rank <= 3""")
def mass_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("observed"))
    # equal observed masses have equal peptides: each is searched once, and keeps three before it meets its parts
    met = joins.mass_join(observed.select("observed").distinct(), _peptides(spark, sf_dir).select("peptide"), "observed", ch.peptide_mass(F.col("peptide")), Tolerance.ppm(10))
    order = [F.abs(F.col("observed") - F.col("mass")), F.col("peptide")]
    best = ranking.top_k(met, ["observed"], order, 3).drop("rank")
    return ranking.top_k(observed.hint("merge").join(best, "observed"), ["p_partkey"], order, 3).select("p_partkey", "rank", "peptide")


@_query("""WITH n AS (SELECT DISTINCT lower(p_name) AS name FROM part), q AS (SELECT DISTINCT lower(p_type || ' ' || p_brand) AS query FROM part UNION SELECT DISTINCT lower(p_name) || 's' FROM part),
g AS (SELECT DISTINCT query, substr(query, k, 3) AS t FROM (SELECT query, unnest(range(1, length(query) - 1)) AS k FROM q)), h AS (SELECT DISTINCT name, substr(name, k, 3) AS t FROM (SELECT name, unnest(range(1, length(name) - 1)) AS k FROM n)),
c AS (SELECT DISTINCT query, name FROM g JOIN h USING (t) WHERE query NOT IN (SELECT name FROM n)), d AS (SELECT query, name, levenshtein(query, name) AS distance FROM c UNION ALL SELECT query, name, 0 FROM q JOIN n ON query = name)
SELECT query, name, CAST(distance AS INTEGER) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, name) AS rank FROM d WHERE distance <= 6) WHERE rank <= 5""")
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    asked = part.select(F.concat_ws(" ", "p_type", "p_brand").alias("query")).union(part.select(F.concat("p_name", F.lit("s"))))
    return joins.fuzzy_join(asked, part.select(F.col("p_name").alias("name")))


@_query("""SELECT t AS gram, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, substr(p_name, k, 3) AS t FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) - 1)) AS k FROM part)) GROUP BY 1""")
def trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = _table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(trigrams(F.col("p_name")))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@_query("""WITH q AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'N:' || c_nationkey WHEN 1 THEN upper(n_name) WHEN 2 THEN lower(replace(n_name, 'NATION', 'country')) ELSE 'none' END AS query FROM customer JOIN nation ON c_nationkey = n_nationkey),
d AS (SELECT 'N:' || n_nationkey AS id, n_name AS name, replace(n_name, 'NATION', 'Country') AS synonym FROM nation)
SELECT query, id, name, CASE WHEN id IS NULL THEN NULL WHEN query = id THEN 'id' WHEN lower(query) = lower(name) THEN 'name' ELSE 'synonym' END AS matched
FROM q LEFT JOIN d ON query = id OR lower(query) = lower(name) OR lower(query) = lower(synonym)""")
def cv_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation")
    id_ = F.concat(F.lit("N:"), F.col("n_nationkey").cast("string"))
    terms = nation.select(id_.alias("id"), F.col("n_name").alias("name"))
    also = nation.select(id_.alias("id"), F.replace("n_name", F.lit("NATION"), F.lit("Country")).alias("synonym"))
    both = _table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.col("c_custkey") % 4
    query = F.when(kind == 0, id_).when(kind == 1, F.upper("n_name")).when(kind == 2, F.lower(F.replace("n_name", F.lit("NATION"), F.lit("country")))).otherwise("none")
    return joins.lookup(both.select(query.alias("query")), terms, also)


@_query("""SELECT o_orderkey, CASE WHEN bool_or(l_returnflag <> 'R') IS NULL THEN 'Unknown' WHEN bool_or(l_returnflag <> 'R') THEN 'Target' ELSE 'Decoy' END AS class FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def decoy_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("decoy"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    return ranking.target_or_decoy(orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left"), ["o_orderkey"])


@_query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, max(l_quantity) OVER (PARTITION BY l_orderkey) AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, count(*) OVER (PARTITION BY l_orderkey) = 1 AS "unique" FROM r WHERE l_quantity >= m - 1e-9""")
def best_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return ranking.best_with_ties(lines, ["l_orderkey"], "l_quantity")


@_query("""SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(_table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@_query("""WITH a AS (SELECT s_suppkey, s_name, n_name, r_name, row_number() OVER (PARTITION BY r_name, n_name ORDER BY s_suppkey) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT s_suppkey, r_name AS species, n_name AS gene FROM a WHERE k = 1""")
def germline_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    alleles = every.select("s_suppkey", F.col("r_name").alias("species"), F.lit("H").alias("chain"), F.lit("V").alias("gene_kind"), F.col("n_name").alias("gene"), F.col("s_suppkey").alias("number"))
    return ranking.select_germlines(alleles, chains=["H"], genes=["V"], allele="first").select("s_suppkey", "species", "gene")


@_query("""WITH w AS (SELECT vec_id, list_transform(embedding, lambda x, i: sqrt(greatest(x::DOUBLE, 0.0)) * i) AS v, list_transform(list_reverse(embedding), lambda x, i: sqrt(greatest(x::DOUBLE, 0.0)) * i) AS u FROM embeddings)
SELECT vec_id, round(list_dot_product(v, u) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(u, u))), 6) AS cosine FROM w""")
def cosine_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.reverse("embedding").alias("other"))
    return vectors.select("vec_id", F.round(spectra.weighted_cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def _sql_formulas() -> str:
    c, h, n, o = (repr(ch.ELEMENTS[e]) for e in "CHNO")
    return f"""WITH t AS (SELECT DISTINCT p_size, 60.0 + p_size * 2.013 AS mass FROM part)
SELECT p_size, CAST(a AS INTEGER) AS "n_C", CAST(b AS INTEGER) AS "n_N", CAST(d AS INTEGER) AS "n_O", CAST(e AS INTEGER) AS "n_H" FROM t, range(0, 13) AS x(a), range(0, 5) AS y(b), range(0, 7) AS z(d), range(0, 25) AS w(e)
WHERE a * {c}::DOUBLE + b * {n}::DOUBLE + d * {o}::DOUBLE + e * {h}::DOUBLE BETWEEN mass - 0.02 AND mass + 0.02"""


@_query(_sql_formulas())
def find_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _table(spark, sf_dir, "part").select("p_size", (F.lit(60.0) + F.col("p_size") * 2.013).alias("mass")).distinct()
    found = generate.find_formulas(targets, "mass", {"C": (0, 12), "N": (0, 4), "O": (0, 6), "H": (0, 24)}, Tolerance.absolute(0.02))
    return found.select("p_size", "n_C", "n_N", "n_O", "n_H")


def _sql_isobaric() -> str:
    order = sorted("ARNDCQEGHLKMFPSTWYV", key=lambda x: (ch.MONO[x], x))
    rows = ", ".join(f"({k}, '{a}', {ch.MONO[a]!r}::DOUBLE)" for k, a in enumerate(order))
    return f"""WITH aa AS (SELECT * FROM (VALUES {rows}) AS v(k, a, m)), t AS (SELECT DISTINCT p_size, 150.0 + p_size * 7.0 AS mass FROM part),
s AS (SELECT a AS residues, m FROM aa UNION ALL SELECT x.a || y.a, x.m + y.m FROM aa x JOIN aa y ON x.k <= y.k UNION ALL SELECT x.a || y.a || z.a, x.m + y.m + z.m FROM aa x JOIN aa y ON x.k <= y.k JOIN aa z ON y.k <= z.k)
SELECT p_size, residues FROM t JOIN s ON m BETWEEN mass - 0.1 - {ch.WATER!r}::DOUBLE AND mass + 0.1 - {ch.WATER!r}::DOUBLE"""


@_query(_sql_isobaric())
def isobaric_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _table(spark, sf_dir, "part").select("p_size", (F.lit(150.0) + F.col("p_size") * 7.0).alias("mass")).distinct()
    return generate.isobaric_sets(targets, "mass", Tolerance.absolute(0.1)).select("p_size", "residues")


@_query(f"""WITH d AS (SELECT doc_id, translate(upper(regexp_replace(text, '[^ACGTUacgtu]', '', 'g')), 'U', 'T') AS s FROM documents),
c AS (SELECT doc_id, substr(s, 3 * k + 1, 3) AS codon, k FROM (SELECT doc_id, s, unnest(range(0, length(s) // 3)) AS k FROM d)),
t AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in CODONS.items())}) AS v(codon, aa))
SELECT doc_id, count(*) AS n_codons, count(*) FILTER (WHERE aa = '*') AS n_stops, md5(string_agg(aa, '' ORDER BY k)) AS protein_md5 FROM c JOIN t USING (codon) GROUP BY 1""")
def codon_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.functions.text import translate

    dna = F.upper(F.regexp_replace("text", "[^ACGTUacgtu]", ""))
    protein = _table(spark, sf_dir, "documents").select("doc_id", translate(dna).alias("p")).where("length(p) > 0")
    stops = F.length("p") - F.length(F.replace("p", F.lit("*"), F.lit("")))
    return protein.select("doc_id", F.length("p").cast("long").alias("n_codons"), stops.cast("long").alias("n_stops"), F.md5("p").alias("protein_md5"))


@_query("""WITH l AS (SELECT p_partkey, substr(p_name, k, 1) AS c FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS k FROM part)), n AS (SELECT p_partkey, c, count(*) AS n FROM l WHERE c <> ' ' GROUP BY ALL)
SELECT p_partkey, string_agg(c || n, ' ' ORDER BY c) AS composition FROM n GROUP BY 1""")
def composition_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a part's letters are counted where the part is, so a task holds those of its share of parts only
    letters = spread(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").select("p_partkey", F.explode(F.split("p_name", "")).alias("element"), F.lit(1).alias("n")).where("element not in (' ', '')")
    return joins.composition_key(letters, ["p_partkey"])


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(_residues("p_name").alias("s")).distinct()


@_query(None)
def mass_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.operators.alignment import align_to_templates

    names = _names(spark, sf_dir)
    return align_to_templates(names.select(F.col("s").alias("query_id"), F.col("s").alias("query")), names.select(F.col("s").alias("template_id"), F.col("s").alias("template")))


@_query(None)
def align_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = mass_align(spark, sf_dir).where("query_id <> template_id")
    return ranking.best_with_ties(others, ["query_id"], "normalised").select("query_id", "template_id", "normalised", "cigar", "unique")


@_query(None)
def consecutive_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.operators.alignment import consecutive

    part = _table(spark, sf_dir, "part")
    words = F.split(F.upper("p_name"), " ")
    genes = [part.select(F.regexp_replace(words[k], "[^ACDEFGHIKLMNPQRSTVWY]", "").alias("template")).distinct().select(F.col("template").alias("template_id"), "template") for k in (0, 1)]
    names = _names(spark, sf_dir)
    return consecutive(names.select(F.col("s").alias("query_id"), F.col("s").alias("query")), genes)


def _families(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from massloom.operators.profiles import multiple_alignment

    names = _table(spark, sf_dir, "part").select(F.split("p_name", " ")[1].alias("noun"), _residues("p_name").alias("s")).distinct()
    return multiple_alignment(names.withColumn("key", F.col("s")), "noun", "key", "s")


@_query(None)
def multiple_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _families(spark, sf_dir)[0]


@_query(None)
def merge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _families(spark, sf_dir)[1]


@_query(None)
def align_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best part names of each word of eight residues or more in the documents."""
    from massloom.operators.alignment_index import best_templates

    words = _table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[^A-Za-z]+")).alias("word")).select(_residues("word").alias("query")).where("length(query) >= 8").distinct()
    names = _names(spark, sf_dir)
    return best_templates(words.select(F.col("query").alias("query_id"), "query"), names.select(F.col("s").alias("template_id"), F.col("s").alias("template")), keep=3)


def _sql_modifications() -> str:
    rows = ", ".join("('{}', {!r}::DOUBLE, '{}')".format(n.replace("'", "''"), ch.formula_mass(ch.parse_formula(f)), r) for _, n, f, r in _MODS)
    return f"(VALUES {rows}) AS m(name, delta, residues)"


@_query(f"""WITH t AS (SELECT p_partkey, substr('KMSTCRNQEY', CAST(p_partkey % 10 AS INTEGER) + 1, 1) AS residue, p_size * 1.9958 + 0.0001 * (p_partkey % 7) AS d FROM part),
j AS (SELECT p_partkey, name, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(d - delta), name) AS k FROM t JOIN {_sql_modifications()} ON abs(d - delta) <= 0.3 AND contains(residues, residue))
SELECT t.p_partkey, residue, name FROM t LEFT JOIN j ON t.p_partkey = j.p_partkey AND k = 1""")
def modification_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.substring(F.lit("KMSTCRNQEY"), (F.col("p_partkey") % 10).cast("int") + 1, F.lit(1))
    shifts = _table(spark, sf_dir, "part").select("p_partkey", letter.alias("residue"), (F.col("p_size") * 1.9958 + 0.0001 * (F.col("p_partkey") % 7)).alias("delta_mass"))
    return md.replace_mass_shifts(shifts, md.modification_table(spark), Tolerance.absolute(0.3)).select("p_partkey", "residue", "name")


def _sql_glycans() -> str:
    hex_, nac = (repr(ch.formula_mass(ch.parse_formula(f))) for f in ("C6H10O5", "C8H13NO5"))
    return f"""WITH t AS (SELECT DISTINCT p_size % 6 AS h, p_size % 4 AS n FROM part WHERE p_size % 6 > 0 AND p_size % 4 > 0),
p AS (SELECT h, n, a, b FROM t, range(0, 6) AS x(a), range(0, 4) AS y(b) WHERE a <= h AND b <= n AND a + b > 0)
SELECT 'Hex' || h || 'HexNAc' || n AS glycan, CASE WHEN a > 0 THEN 'Hex' || a ELSE '' END || CASE WHEN b > 0 THEN 'HexNAc' || b ELSE '' END AS part, ion,
round(CASE ion WHEN 'B' THEN a * {hex_}::DOUBLE + b * {nac}::DOUBLE ELSE 1000.0 + (h - a) * {hex_}::DOUBLE + (n - b) * {nac}::DOUBLE END, 6) AS neutral FROM p, (VALUES ('B'), ('Y')) AS i(ion)"""


@_query(_sql_glycans())
def glycan_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, n = F.col("p_size") % 6, F.col("p_size") % 4
    glycans = _table(spark, sf_dir, "part").where((h > 0) & (n > 0)).select(F.concat(F.lit("Hex"), h, F.lit("HexNAc"), n).alias("glycan")).distinct().withColumn("mass", F.lit(1000.0))
    return md.glycan_fragments(glycans, peptide_mass="mass").select("glycan", "part", "ion", F.round("neutral", 6).alias("neutral"))


@_query("""SELECT l_returnflag, l_linestatus, CAST(floor((l_extendedprice - 1000.0) / 250.0) AS BIGINT) AS bin, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY ALL""")
def offset_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").withColumn("offset", F.col("l_extendedprice") - 1000.0)
    halves = [stats.offset_histogram(rows.where(F.col("l_orderkey") % 2 == k), ["l_returnflag", "l_linestatus"], "offset", 250.0, "l_linenumber") for k in (0, 1)]
    return stats.merge_histograms(halves, ["l_returnflag", "l_linestatus"])


@_query("""WITH s AS (SELECT n_nationkey, count(*) AS n FROM nation GROUP BY 1), e AS (SELECT event_id, 'f' || user_id % 5 AS file, event_id % 3 AS k FROM events),
p AS (SELECT o_orderkey, 'f' || o_orderkey % 5 AS file, CASE o_orderkey % 3 WHEN 0 THEN 'index' WHEN 1 THEN 'number' ELSE 'native' END AS kind, o_orderkey // 3 AS idx FROM orders)
SELECT o_orderkey, event_id FROM p JOIN e ON p.file = e.file AND e.event_id = CASE kind WHEN 'number' THEN idx - 1 ELSE idx END""")
def psm_spectrum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 3
    idx = F.floor(key / 3).cast("long")
    psms = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("f"), key % 5).alias("file"), F.when(kind == 0, "index").when(kind == 1, "number").otherwise("native").alias("kind"), idx.alias("idx"), F.concat(F.lit("scan="), idx).alias("native"))
    events = _table(spark, sf_dir, "events").select(F.concat(F.lit("f"), F.col("user_id") % 5).alias("file"), F.col("event_id").alias("idx"), F.concat(F.lit("scan="), F.col("event_id")).alias("native"))
    return joins.spectrum_join(psms, events).select("o_orderkey", F.col("spectrum_idx").alias("event_id"))


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_name FROM lineitem LEFT JOIN (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier) ON l_suppkey % 25 = s_nationkey AND k = 1""")
def protein_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_suppkey") % 25).cast("int").alias("key"))
    proteins = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), "s_suppkey", "s_name")
    return joins.first_by_key(lines, proteins, "key", [F.col("s_suppkey")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s_name")


@_query("""SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN CASE c_custkey % 3 WHEN 0 THEN 'swissprot' ELSE 'trembl' END ELSE 'undefined' END AS kind,
CASE WHEN c_custkey % 3 < 2 THEN 'P' || c_custkey ELSE c_name END AS accession, CASE WHEN c_custkey % 3 < 2 THEN c_mktsegment END AS name, c_custkey % 5 = 0 AS decoy FROM customer""")
def fasta_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.sources.sequences import identifier

    key = F.col("c_custkey")
    text = F.when(key % 3 < 2, F.concat_ws("|", F.when(key % 3 == 0, "sp").otherwise("TR"), F.concat(F.lit("P"), key), "c_mktsegment")).otherwise(F.col("c_name"))
    full = F.concat(F.lit(">"), F.when(key % 5 == 0, "rev_").otherwise(""), text)
    return _table(spark, sf_dir, "customer").select("c_custkey", identifier(full).alias("i")).select("c_custkey", "i.kind", "i.accession", "i.name", "i.decoy")


@_query("""SELECT CAST(o_orderkey AS VARCHAR) AS scan, CASE WHEN o_orderkey % 2 = 0 THEN 'metamorpheus' ELSE 'sage' END AS format, CAST(o_custkey % 4 AS INTEGER) AS charge,
greatest(-1.0, least(1.0, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS DOUBLE) / 100 ELSE CAST(o_custkey AS DOUBLE) END)) AS confidence FROM orders""")
def format_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.sources.psm import FORMATS, common, union_formats

    orders = _table(spark, sf_dir, "orders")
    parts = []
    for k, name in enumerate(("metamorpheus", "sage")):
        own, version = FORMATS[name], FORMATS[name].versions[0]
        texts = {"scan": F.col("o_orderkey"), "charge": F.col("o_custkey") % 4, "score": F.col("o_custkey"), "peptide": F.lit("PEPK")}
        pairs = [x for c, h in version.headers.items() for x in (F.lit(h.lower()), texts.get(c, F.lit("")).cast("string"))]
        rows = orders.where(F.col("o_orderkey") % 2 == k).select(F.create_map(*pairs).alias("values"), F.lit(None).cast("string").alias("error"))
        parts.append(common(rows, own, version))
    return union_formats(parts).select("scan", "format", "charge", "confidence")


@_query(f"""SELECT p_partkey, z AS charge, round((p_retailprice + z * {ch.PROTON!r}::DOUBLE) / z, 6) AS mz FROM part, (VALUES (1), (2), (3)) AS c(z) WHERE z <= greatest(1, p_size // 10)""")
def charge_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.col("p_size") / 10).cast("int"))).alias("top"))
    return generate.charge_states(part, "p_retailprice", 1, F.col("top")).select("p_partkey", "charge", F.round("mz", 6).alias("mz"))


@_query(f"""WITH s AS (SELECT doc_id, {_SQL_RESIDUES.format("text")} AS s FROM documents) SELECT doc_id, length(s) AS n, round({ch.sql_residue_sum("s")} + {ch.WATER!r}::DOUBLE, 3) AS mass FROM s""")
def protein_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    proteins = _table(spark, sf_dir, "documents").select("doc_id", _residues("text").alias("s"))
    return proteins.select("doc_id", F.length("s").cast("long").alias("n"), F.round(ch.peptide_mass(F.col("s")), 3).alias("mass"))


@_query("""SELECT a.n_regionkey AS region, a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey > b.n_nationkey""")
def triangular_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return joins.triangular_pairs(nations, "n_nationkey", ["n_regionkey"]).select(F.col("a_n_regionkey").alias("region"), F.col("a_n_nationkey").alias("a_key"), F.col("b_n_nationkey").alias("b_key"))


@_query(None)
def alignment_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.operators.alignment import sequence_variance

    return sequence_variance(multiple_align(spark, sf_dir), ["noun", "cluster"])
