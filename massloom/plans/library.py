"""More queries over the driver's tables: files written and read back, chemistry, residues, rules and the plain relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions import chemistry as ch
from massloom.functions.residues import CLASSES, STANDS_FOR, class_table, mass_difference, same_residue
from massloom.functions.text import curie
from massloom.functions.tolerance import Tolerance
from massloom.operators import digest as dg
from massloom.operators import fragments as fr
from massloom.operators import generate, spectra
from massloom.operators import modifications as md
from massloom.operators import statistics as stats
from massloom.plans.queries import _SQL_RESIDUES, _cut_fragments, _query, _residues, _SQL_LADDER, _table
from massloom.session import scratch

_NAMES = f"SELECT p_partkey, {_SQL_RESIDUES.format('p_name')} AS s FROM part"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", _residues("p_name").alias("s"))


def _lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)


# Files


@_query("""SELECT s_suppkey AS key, s_name AS name, 'a' || s_nationkey || CASE WHEN s_suppkey % 3 = 0 THEN ',b' || '''' ELSE '' END AS note, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS error FROM supplier
UNION ALL SELECT NULL, NULL, NULL, NULL, '4 columns expected, found 2' UNION ALL SELECT -1, 'bad', 'x', NULL, NULL""")
def delimited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as delimited text, with separators and quotes inside, and read back; lines of another width and numbers that are none."""
    from massloom.sources import delimited as d

    path = scratch(spark) + "/rows.csv"
    note = F.concat(F.lit("a"), "s_nationkey", F.when(F.col("s_suppkey") % 3 == 0, F.lit(',b"')).otherwise(""))
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("Key"), F.col("s_name").alias("name"), note.alias("note"), F.col("s_acctbal").alias("balance"))
    d.write_delimited([rows.drop("balance").where("Key < 0"), rows], path)
    _lines(spark.createDataFrame([("1,two",), ("-1,bad,x,no number",)], "value string"), path)
    back = d.read_delimited(spark, path)
    return back.select(d.number_column("values", "key", kind="bigint").alias("key"), d.text_column("values", "name").alias("name"), d.text_column("values", "note").alias("note"), d.number_column("values", "balance").alias("balance"), "error")


@_query("""WITH t AS (SELECT c_custkey, '[' || c_custkey || ';' || c_nationkey || ';' || CASE WHEN c_custkey % 4 = 0 THEN '-' ELSE c_mktsegment END || ']' AS x FROM customer)
SELECT c_custkey, CAST(c_custkey AS BIGINT) AS first, string_split(substr(x, 2, length(x) - 2), ';')[2] AS middle, CASE WHEN c_custkey % 4 <> 0 THEN string_split(substr(x, 2, length(x) - 2), ';')[3] END AS last,
CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE string_split(substr(x, 2, length(x) - 2), ';')[3] END AS unless_dash, substr(x, 3) AS skipped, substr(x, 2, position(';' IN x) - 2) AS before FROM customer JOIN t USING (c_custkey)""")
def location_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.sources import delimited as d

    text = F.concat(F.lit("["), "c_custkey", F.lit(";"), "c_nationkey", F.lit(";"), F.when(F.col("c_custkey") % 4 == 0, "-").otherwise(F.col("c_mktsegment")), F.lit("]"))
    inner = d.trim_matches(text, "[", "]")
    a, b, c = d.between(inner, ";", ";")
    own = _table(spark, sf_dir, "customer").select("c_custkey", a.cast("long").alias("first"), b.alias("middle"), d.or_empty(c).alias("last"), d.ignore(c, "-").alias("unless_dash"), d.skip(text, 2).alias("skipped"), d.split_once(inner, ";")[0].alias("before"))
    return own


@_query("""SELECT conv_id, turn, CASE WHEN contains(t, ',') OR regexp_matches(t, '^["'']') THEN replace(t, '"', '''') ELSE rtrim(t) END AS text FROM (SELECT conv_id, turn, ltrim(regexp_replace(coalesce(text, ''), '[\\n\\r]', ' ', 'g')) AS t FROM conversations)""")
def csv_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, with the quotes that they have, written as lines and read back by the tokenizer."""
    from massloom.sources.delimited import to_lines, tokenize

    turns = _table(spark, sf_dir, "conversations")
    turns = turns.select("conv_id", "turn", F.ltrim(F.regexp_replace("text", r"[\n\r]", " ")).alias("text"))
    back = to_lines(turns).select(tokenize(F.col("value"), ",").alias("t"))
    return back.select(F.col("t.fields")[0].cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("t.fields")[1].cast(turns.schema["turn"].dataType).alias("turn"), F.col("t.fields")[2].alias("text"))


@_query(f"""WITH n AS ({_NAMES}) SELECT CASE WHEN p_partkey % 3 = 0 THEN 'integrated' ELSE 'swissprot' END AS id_kind, 'P' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '|x' ELSE '' END AS accession, CASE WHEN p_partkey % 3 <> 0 THEN 'N_' || p_partkey END AS name,
p_partkey % 7 = 0 AS decoy, 'protein ' || p_partkey AS description, 'Homo sapiens' AS species, s AS sequence, CAST(2 AS INTEGER) AS n_regions, CASE WHEN p_partkey % 5 = 0 THEN 'Cys:0;Other:' || (length(s) - 1) ELSE '' END AS annotations,
CASE WHEN p_partkey % 11 = 0 THEN 'regions do not fill the sequence' END AS error FROM n WHERE length(s) > 3""")
def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with tags, regions and annotations, written as FASTA text in lines of four residues and read back."""
    from massloom.sources.sequences import read_fasta

    key, n = F.col("p_partkey"), F.length("s")
    code = F.when(key % 3 == 0, F.concat(F.lit("gi|P"), key, F.lit("|x"))).otherwise(F.concat(F.lit("sp|P"), key, F.lit("|N_"), key))
    regions = F.concat(F.lit(" REGIONS=FR1:2;CDR1:"), n - 2 + F.when(key % 11 == 0, 1).otherwise(0))
    notes = F.when(key % 5 == 0, F.concat(F.lit(" ANNOTATIONS=Cys:0;Other:"), n - 1)).otherwise("")
    head = F.concat(F.lit(">"), F.when(key % 7 == 0, "rev_").otherwise(""), code, F.lit(" protein "), key, F.lit(" OS=Homo sapiens"), regions, notes)
    path = scratch(spark) + "/records.fasta"
    _lines(_named(spark, sf_dir).where(n > 3).select(F.concat_ws("\n", head, F.regexp_replace("s", "(.{4})", "$1\n")).alias("value")), path)
    found = F.array_join(F.transform("annotations", lambda a: F.concat(a["annotation"], F.lit(":"), a["position"])), ";")
    return read_fasta(spark, path).select("id_kind", "accession", "name", "decoy", "description", F.element_at("tags", "OS").alias("species"), "sequence", F.size("regions").alias("n_regions"), found.alias("annotations"), "error")


@_query("""SELECT 'N:' || n_nationkey AS id, n_name AS name, 'Land ' || n_nationkey AS synonym, 'R:' || n_regionkey AS parent, n_nationkey % 6 = 0 AS obsolete, CAST(n_nationkey AS VARCHAR) AS value FROM nation""")
def obo_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms written as OBO text, read by the second of two sources (the first fails) and from the cache after that."""
    from massloom.sources import vocabulary as v

    root = scratch(spark)
    n = F.col("n_nationkey")
    lines = F.concat_ws("\n", F.lit("[Term]"), F.concat(F.lit("id: N:"), n), F.concat(F.lit("name: "), "n_name"), F.concat(F.lit('synonym: "Land '), n, F.lit('" EXACT []')), F.concat(F.lit("is_a: R:"), "n_regionkey", F.lit(" ! a region")),
                        F.concat(F.lit("is_obsolete: "), F.when(n % 6 == 0, "true").otherwise("false")), F.concat(F.lit('property_value: size "'), n, F.lit('" xsd:int')), F.lit(""))
    _lines(spark.createDataFrame([("format-version: 1.2\n",)], "value string").unionAll(_table(spark, sf_dir, "nation").select(lines)).coalesce(1), f"{root}/terms.obo")
    sources = [lambda: v.read_obo(spark, f"{root}/none.obo"), lambda: v.read_obo(spark, f"{root}/terms.obo")]
    v.load_cached(spark, f"{root}/cache", sources)
    terms, _ = v.load_cached(spark, f"{root}/cache", [])
    values = v.property_values(terms).select("id", "value")
    own = terms.where("stanza = 'Term'").select("id", "name", F.col("synonyms")[0].alias("synonym"), F.split(F.col("parents")[0], " ")[0].alias("parent"), "obsolete")
    return own.join(values, "id")


@_query("""SELECT 'PEPK' AS sequence, CAST(o_orderkey AS VARCHAR) AS scan_index, 'run.raw' AS raw_file, CAST(o_custkey % 4 AS INTEGER) AS z, CAST(NULL AS DOUBLE) AS score, 'Unknown' AS class FROM orders""")
def converted_psms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifications written as a file, opened by the format's name and converted."""
    from massloom.sources.delimited import write_delimited
    from massloom.sources.psm import read_psms

    path = scratch(spark) + "/found.csv"
    rows = _table(spark, sf_dir, "orders")
    write_delimited([rows.select(F.col("o_orderkey").alias("scan_index"), F.lit("PEPK").alias("sequence"), F.lit("run.raw").alias("raw_file"), (F.col("o_custkey") % 4).alias("z"))], path)
    return stats.convert(read_psms(spark, path, format="basic_csv"))


# Masses and patterns


def _sql_points() -> str:
    table = generate.PKA["lide"]

    def pick(place: int, which: str) -> str:
        return "CASE " + which + " " + " ".join(f"WHEN '{a}' THEN {v[place]!r}" for a, v in table.items()) + " END::DOUBLE"

    counts = ", ".join(f"(length(s) - length(replace(s, '{a}', '')))::DOUBLE AS n_{a}" for a in generate.CHARGED)
    middle = "((lo + hi) / 2)"
    charge = f"1 / (1 + pow(10, {middle} - first)) - 1 / (1 + pow(10, last - {middle}))"
    charge += "".join(f" + {sign} * n_{a} / (1 + pow(10, {sign} * ({middle} - {table[a][1]!r})))" for a, sign in generate.CHARGED.items())
    parts = [f"n AS ({_NAMES}), s0 AS (SELECT p_partkey, s, {pick(0, 'substr(s, 1, 1)')} AS first, {pick(2, 'substr(s, length(s), 1)')} AS last, {counts}, 0.0::DOUBLE AS lo, 14.0::DOUBLE AS hi FROM n WHERE s <> '')"]
    for k in range(18):
        parts.append(f"c{k} AS (SELECT *, {charge} AS charge FROM s{k}), s{k + 1} AS (SELECT * EXCLUDE (charge) REPLACE (CASE WHEN charge > 0 THEN {middle} ELSE lo END AS lo, CASE WHEN charge > 0 THEN hi ELSE {middle} END AS hi) FROM c{k})")
    return f"WITH {', '.join(parts)} SELECT p_partkey, s AS peptide, round({middle}, 2) AS pi FROM s18"


@_query(_sql_points())
def isoelectric_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    peptides = _named(spark, sf_dir).select("p_partkey", F.col("s").alias("peptide")).where("peptide <> ''")
    return generate.isoelectric_points(peptides, "peptide").select("p_partkey", "peptide", F.round("pi", 2).alias("pi"))


def _sql_patterns() -> str:
    """Chances of 0 to 3 more neutrons: binomial terms of each isotope, multiplied out."""
    parts = []
    for name, n, (step, share) in (("c", "4 * p_size", ch.ISOTOPES["C"][0]), ("h", "8 * p_size", ch.ISOTOPES["H"][0]), ("n", "p_size", ch.ISOTOPES["N"][0]), ("o", "2 * p_size", ch.ISOTOPES["O"][0]), ("p", "2 * p_size", ch.ISOTOPES["O"][1])):
        ways = f"CASE k WHEN 0 THEN 1 WHEN 1 THEN {n} WHEN 2 THEN {n} * ({n} - 1) / 2 ELSE {n} * ({n} - 1) * ({n} - 2) / 6 END"
        parts.append(f"{name} AS (SELECT p_size, k * {step} AS k, ({ways})::DOUBLE * pow({share!r}::DOUBLE, k) * pow(1 - {share!r}::DOUBLE, {n} - k) AS p FROM t, range(0, 4) AS r(k) WHERE k <= {n} AND k * {step} < 4)")
    joined = "c JOIN h USING (p_size) JOIN n USING (p_size) JOIN o USING (p_size) JOIN p USING (p_size)"
    return f"""WITH t AS (SELECT DISTINCT p_size::BIGINT AS p_size FROM part), {', '.join(parts)},
q AS (SELECT p_size, c.k + h.k + n.k + o.k + p.k AS k, sum(c.p * h.p * n.p * o.p * p.p) AS p FROM {joined} GROUP BY ALL),
w AS (SELECT p_size, max(p) FILTER (WHERE k = 0) AS p0, max(p) FILTER (WHERE k = 1) AS p1, max(p) FILTER (WHERE k = 2) AS p2, max(p) FILTER (WHERE k = 3) AS p3 FROM q WHERE k < 4 GROUP BY 1)
SELECT CAST(p_size AS INTEGER) AS p_size, 'C' || 4 * p_size || 'H' || 8 * p_size || 'N' || p_size || 'O' || 2 * p_size AS formula, round(p0, 4) AS p0, round(p1, 4) AS p1, round(p2, 4) AS p2, round(p3, 4) AS p3,
CAST(CASE greatest(p0, p1, p2, p3) WHEN p3 THEN 3 WHEN p2 THEN 2 WHEN p1 THEN 1 ELSE 0 END AS INTEGER) AS neutrons FROM w"""


@_query(_sql_patterns())
def isotope_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of C 4n H 8n N n O 2n by part size: the first four peaks and the highest one."""
    sizes = _table(spark, sf_dir, "part").select("p_size").distinct()
    n = F.col("p_size")
    text = F.concat(F.lit("C"), n * 4, F.lit("H"), n * 8, F.lit("N"), n, F.lit("O"), n * 2)
    out = sizes.withColumn("formula", text).withColumn("pattern", generate.isotope_patterns("formula"))
    peaks = (F.round(F.coalesce(F.get("pattern", F.lit(k)), F.lit(0.0)), 4).alias(f"p{k}") for k in range(4))
    return out.select("p_size", "formula", *peaks, generate.most_abundant(F.col("pattern")).alias("neutrons"))


_COUNTS = "length(s) - length(replace(s, '{}', ''))"


@_query(f"""WITH n AS (SELECT p_partkey, translate(s, 'NQ', 'BZ') AS s FROM ({_NAMES})), w AS (SELECT *, {_COUNTS.format('B')} AS b, {_COUNTS.format('Z')} AS z, {ch.sql_residue_sum('s')} + {ch.WATER!r}::DOUBLE AS m FROM n)
SELECT p_partkey, CAST((b + 1) * (z + 1) AS INTEGER) AS n_options, round(m + b * {ch.MONO['N']!r}::DOUBLE + z * {ch.MONO['Q']!r}::DOUBLE, 6) AS lo, round(m + b * {ch.MONO['D']!r}::DOUBLE + z * {ch.MONO['E']!r}::DOUBLE, 6) AS hi, b + z = 0 AS single FROM w""")
def ambiguous_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All masses of sequences with B and Z: their number, bounds, and whether there is one only."""
    masses = _named(spark, sf_dir).select("p_partkey", ch.mass_options(F.translate("s", "NQ", "BZ"), ch.STANDARD).alias("m"))
    both = ch.mass_bounds(F.col("m"))
    return masses.select("p_partkey", F.size("m").alias("n_options"), F.round(both["lo"], 6).alias("lo"), F.round(both["hi"], 6).alias("hi"), (F.size("m") == 1).alias("single"))


@_query("""SELECT event_id, round(least(abs(value - 20) / 20, abs(value - 30) / 30) * 1e6, 4) AS ppm, round(least(abs(value - 20), abs(value - 30)), 6) AS da FROM events""")
def mass_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.array(F.lit(20.0), F.lit(30.0))
    return _table(spark, sf_dir, "events").select("event_id", F.round(stats.mass_error(F.col("value"), options), 4).alias("ppm"), F.round(stats.mass_error(F.col("value"), options, False), 6).alias("da"))


@_query("""SELECT p_partkey, round(least(abs(p_retailprice - 900), abs(p_retailprice - p_size)), 6) AS da, round(least(abs(p_retailprice - 900), abs(p_retailprice - p_size)) / p_retailprice * 1e6, 3) AS ppm FROM part""")
def mass_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.array("p_retailprice"), F.array(F.lit(900.0), F.col("p_size").cast("double"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(mass_difference(a, b), 6).alias("da"), F.round(mass_difference(a, b, True), 3).alias("ppm"))


# Residues, texts and rules


@_query("WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{c}', '{own}')" for k, kind in CLASSES.items() for c, own in kind.items()) + f""") AS v(kind, class, letters)), l AS (SELECT p_partkey, unnest(string_split(s, '')) AS aa FROM ({_NAMES}))
SELECT kind, class, count(*) AS n FROM l JOIN c ON contains(letters, aa) WHERE aa <> '' GROUP BY ALL""")
def residue_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = _named(spark, sf_dir).select(F.explode(F.split("s", "")).alias("aa")).where("aa <> ''").groupBy("aa").count()
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("class")) for k in CLASSES)))
    table = class_table(spark).select("aa", kinds.alias("k")).select("aa", "k.kind", "k.class").where("class <> 'unknown'")
    return letters.join(F.broadcast(table), "aa").groupBy("kind", "class").agg(F.sum("count").alias("n"))


_SAME = " OR ".join(["a = b", "a = 'X'", "b = 'X'"] + [f"(a = '{w}' AND b IN ('{o[0]}', '{o[1]}')) OR (b = '{w}' AND a IN ('{o[0]}', '{o[1]}'))" for w, o in STANDS_FOR.items()])


@_query(f"""WITH l AS (SELECT regexp_extract_all(upper(text), '[A-Z]') AS s FROM documents WHERE text IS NOT NULL),
e AS (SELECT s[k] AS a, s[k + 1] AS b FROM (SELECT s, unnest(range(1, len(s))) AS k FROM l))
SELECT a, b, ({_SAME}) AS same, count(*) AS n FROM e GROUP BY ALL""")
def same_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring letters of the documents, whether they can be the same residue, and how often they stand together."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    pairs = F.regexp_extract_all("s", F.lit("(?=(..))"), F.lit(1))
    both = _table(spark, sf_dir, "documents").select(letters.alias("s")).select(F.explode(pairs).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    both = both.select(F.substring("p", 1, 1).alias("a"), F.substring("p", 2, 1).alias("b"), "n")
    return both.select("a", "b", same_residue(F.col("a"), F.col("b")).alias("same"), "n")


@_query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE upper(c_mktsegment) END AS cv, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'x' || c_custkey || ':y' END AS accession FROM customer""")
def curies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    text = F.when(key % 3 == 0, F.concat(F.lit("none "), key)).otherwise(F.concat(F.lower("c_mktsegment"), F.lit(": x"), key, F.lit(":y")))
    return _table(spark, sf_dir, "customer").select("c_custkey", curie(text).alias("c")).select("c_custkey", "c.cv", "c.accession")


@_query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CASE s_suppkey % 4 WHEN 0 THEN 'H' WHEN 1 THEN 'K' WHEN 2 THEN 'L' ELSE 'H' END END AS chain, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CASE s_suppkey % 4 WHEN 3 THEN 'CG' WHEN 1 THEN 'J' ELSE 'V' END END AS kind,
CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_nationkey || '-' || s_suppkey END AS gene, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 2 = 0 THEN CAST(s_nationkey AS INTEGER) END AS number FROM supplier""")
def gene_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.sources.vocabulary import gene_parts

    key = F.col("s_suppkey")
    code = F.when(key % 4 == 0, "HV").when(key % 4 == 1, "KJ").when(key % 4 == 2, "LV").otherwise("HG")
    name = F.when(key % 5 == 0, F.lit("XYZ")).otherwise(F.concat(F.lit("IG"), code, "s_nationkey", F.lit("-"), key, F.when(key % 2 == 0, F.concat(F.lit("*0"), "s_nationkey")).otherwise("")))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", gene_parts(name).alias("g")).select("s_suppkey", "g.chain", "g.kind", "g.gene", "g.number")


@_query(f"""WITH n AS ({_NAMES}) SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE substr(s, greatest(p_size % 5 - 2, 0) + 1, least(2, p_size % 5)) END AS before, substr(s, p_size % 5 + 3 + 1, 2) AS behind FROM n JOIN (SELECT p_partkey, p_size FROM part) USING (p_partkey)""")
def flanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two residues on both sides of a stretch of three."""
    part = _table(spark, sf_dir, "part").select("p_partkey", _residues("p_name").alias("s"), (F.col("p_size") % 5).alias("start"))
    return part.select("p_partkey", stats.flanking(F.col("s"), F.col("start"), F.lit(3), 2).alias("f")).select("p_partkey", "f.before", "f.behind")


@_query("""WITH r AS (SELECT n_regionkey, CASE n_nationkey % 3 WHEN 0 THEN 'anywhere' WHEN 1 THEN 'any_n_term' ELSE 'any_c_term' END AS position, substr('KMSTCRNQEY', CAST(n_nationkey % 10 AS INTEGER) + 1, 1) AS residue FROM nation)
SELECT n_regionkey, position, string_agg(DISTINCT residue, '' ORDER BY residue) AS residues, bool_and(contains('KMST', residue)) AS within FROM r GROUP BY ALL""")
def merged_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a region merged by position, and whether each is covered by the residues K, M, S, T anywhere."""
    n = F.col("n_nationkey")
    rule = F.struct(F.array(F.substring(F.lit("KMSTCRNQEY"), (n % 10).cast("int") + 1, F.lit(1))).alias("residues"), F.when(n % 3 == 0, "anywhere").when(n % 3 == 1, "any_n_term").otherwise("any_c_term").alias("position"))
    rules = _table(spark, sf_dir, "nation").select("n_regionkey", rule.alias("r")).groupBy("n_regionkey").agg(F.collect_list("r").alias("rules"))
    each = rules.select("n_regionkey", F.explode(md.merge_rules(F.col("rules"))).alias("r"))
    wide = F.array(F.struct(F.array(*map(F.lit, "KMST")).alias("residues"), F.lit("anywhere").alias("position")))
    return each.select("n_regionkey", "r.position", F.array_join("r.residues", "").alias("residues"), md.rules_within(F.array("r"), wide).alias("within"))


@_query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'O' WHEN 1 THEN 'C2H2O' WHEN 2 THEN 'H-2O-1' ELSE 'C9' END AS formula FROM part),
m AS (SELECT * FROM (VALUES ('Oxidation', 'O'), ('Acetyl', 'C2H2O'), ('Dehydrated', 'H-2O-1'), ('Glu->pyro-Glu', 'H-2O-1')) AS v(name, formula)) SELECT p_partkey, name FROM t JOIN m USING (formula)""")
def formula_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey") % 4
    asked = _table(spark, sf_dir, "part").select("p_partkey", F.when(key == 0, "O").when(key == 1, "C2H2O").when(key == 2, "H-2O-1").otherwise("C9").alias("formula"))
    return md.find_by_formula(asked, md.modification_table(spark)).select("p_partkey", F.col("mod_name").alias("name"))


_CUTS = {"trypsin_any": "[^KR]*[KR]|[^KR]+", "chymotrypsin": "[^FWYLM]*[FWYLM]|[^FWYLM]+", "pepsin": "[^FWYL]*[FWYL]|[^FWYL]+", "gluc": "[^E]*E|[^E]+", "aspn": "D[^D]*|[^D]+", "lysc": "[^K]*K|[^K]+", "argc": "[^R]*R|[^R]+", "trypsin_not_before_proline": "(?:[KR]P|[^KR])*[KR]?"}


@_query(f"WITH n AS ({_NAMES}) " + " UNION ALL ".join(f"SELECT p_partkey, '{k}' AS protease, array_to_string(list_filter(regexp_extract_all(s, '{v}'), lambda x: x <> ''), ' ') AS pieces FROM n" for k, v in _CUTS.items()))
def all_proteases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.explode(F.array(*(F.struct(F.lit(k).alias("protease"), F.array_join(dg.pieces(F.col("s"), p), " ").alias("pieces")) for k, p in dg.PROTEASES.items())))
    return _named(spark, sf_dir).select("p_partkey", cut.alias("c")).select("p_partkey", "c.protease", "c.pieces")


# Spectra


@_query(f"""WITH {_SQL_LADDER} SELECT p_partkey, ion || index || CASE WHEN charge > 1 THEN '^' || charge ELSE '' END AS label FROM ions WHERE mz BETWEEN 100.0 AND 400.0""")
def fragment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the fragments in a window of m/z."""
    ions, _ = _cut_fragments(spark, sf_dir)
    return spectra.mz_window(ions, 100.0, 400.0).select("p_partkey", fr.label().alias("label"))


@_query("""WITH g AS (SELECT user_id, count(*) FILTER (WHERE value > 60) AS found, count(*) FILTER (WHERE value > 30) AS total FROM events GROUP BY 1)
SELECT user_id, found, total, CASE WHEN total = 0 THEN CASE WHEN found = 0 THEN -1.0 ELSE -2.0 END ELSE round(found / total, 9) END AS fraction FROM g""")
def found_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 60).alias("found"), F.count_if(F.col("value") > 30).alias("total"))
    share = spectra.fraction(F.col("found"), F.col("total"))
    return counts.select("user_id", "found", "total", F.when(F.isnan(share), -1.0).when(share == float("inf"), -2.0).otherwise(F.round(share, 9)).alias("fraction"))


@_query("""WITH l AS (SELECT user_id, event_id, value, 's' || event_id % 3 AS site, CASE WHEN event_id % 2 = 0 THEN 'I' ELSE 'L' END AS option FROM events)
SELECT user_id, site, option, count(*) FILTER (WHERE value > 20) AS found, count(*) AS total FROM l GROUP BY ALL""")
def ambiguous_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.array(F.struct(F.concat(F.lit("s"), F.col("event_id") % 3).alias("site"), F.when(F.col("event_id") % 2 == 0, "I").otherwise("L").alias("option")))
    every = _table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("fragment_id"), "value", label.alias("labels"))
    return stats.ambiguity(every.where("value > 20"), every, ["user_id"])


# Plain relational operators


@_query("""WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_suppkey % 2 = 0)
SELECT 'both' AS part, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'first' AS part, k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'any', k FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    b = _table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("k"))
    parts = {"both": a.intersect(b), "first": a.exceptAll(b).join(b, "k", "left_anti").distinct(), "any": a.union(b).distinct()}
    out = [t.select(F.lit(name).alias("part"), "k") for name, t in parts.items()]
    return out[0].unionAll(out[1]).unionAll(out[2])


@_query("""SELECT 'f' || user_id % 5 AS file, count(*) AS n, count(DISTINCT user_id) AS spectra, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def grouped_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.concat(F.lit("f"), F.col("user_id") % 5).alias("file")
    return _table(spark, sf_dir, "events").groupBy(file).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("spectra"), F.round(F.sum("value"), 4).alias("total"))


@_query("""SELECT user_id, array_to_string(list(CAST(event_id AS VARCHAR) ORDER BY value DESC, event_id), ' ') AS by_intensity, array_to_string(list(CAST(event_id AS VARCHAR) ORDER BY value, event_id), ' ') AS by_mz FROM events GROUP BY 1""")
def ordered_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of each spectrum in two orders."""
    def ids(first: Column) -> Column:
        order = F.array_sort(F.collect_list(F.struct(first.alias("v"), "event_id")))
        return F.array_join(F.transform(order, lambda x: x["event_id"].cast("string")), " ")

    return _table(spark, sf_dir, "events").groupBy("user_id").agg(ids(-F.col("value")).alias("by_intensity"), ids(F.col("value")).alias("by_mz"))


@_query("""SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN 'a charge of 0' END AS error, CASE WHEN o_custkey % 9 <> 0 THEN round(o_totalprice / (o_custkey % 9), 6) END AS mz FROM orders""")
def good_and_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows parted by their error and put together again."""
    from massloom.sources.delimited import good_and_bad as part

    z = F.col("o_custkey") % 9
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.when(z == 0, "a charge of 0").alias("error"), F.round(F.col("o_totalprice") / F.nullif(z, F.lit(0)), 6).alias("mz"))
    good, bad = part(rows)
    return good.select("o_orderkey", F.lit(None).cast("string").alias("error"), "mz").unionAll(bad.select("o_orderkey", "error", "mz"))


@_query("""SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.value = b.value AND a.event_id < b.event_id""")
def exact_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a spectrum's peaks at a tolerance of 0."""
    from massloom.operators.joins import band_join

    events = _table(spark, sf_dir, "events")
    left = events.select(F.col("event_id").alias("a_id"), F.col("user_id").alias("a_user"), F.col("value").alias("a_value"))
    right = events.select(F.col("event_id").alias("b_id"), F.col("user_id").alias("b_user"), F.col("value").alias("b_value"))
    return band_join(left, right, ("a_value", "b_value"), Tolerance.absolute(0.0), (["a_user"], ["b_user"])).where("a_id < b_id").select("a_id", "b_id")


@_query("""WITH o AS (SELECT * FROM orders) SELECT CAST(o_orderkey AS VARCHAR) AS psm_id, 'PEPK' AS peptide, CAST(o_custkey % 4 + 1 AS INTEGER) AS charge, round(o_totalprice, 2) AS mz, 'P' || o_custkey % 7 AS protein, 'ms_run[' || (o_orderkey // 10 % 3 + 1) || ']:scan=' || o_orderkey AS scan,
CASE WHEN o_custkey % 7 < 5 THEN 'protein ' || o_custkey % 7 END AS description, CAST(NULL AS VARCHAR) AS error FROM o""")
def mztab_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of three files and their proteins, some of which are missing and some written twice, as mzTab and back."""
    from massloom.sources import mztab
    from massloom.sources.psm import read_psms

    path = scratch(spark) + "/found.mztab"
    orders = _table(spark, sf_dir, "orders")
    key = F.col("o_custkey") % 7
    proteins = orders.select(F.concat(F.lit("P"), key).alias("accession"), F.concat(F.lit("protein "), key).alias("description")).where("accession not in ('P5', 'P6')").distinct()
    proteins = proteins.unionAll(proteins.select("accession", F.concat("description", F.lit(" again"))))
    psms = orders.select(F.lit("PEPK").alias("sequence"), F.col("o_orderkey").alias("psm_id"), F.concat(F.lit("P"), key).alias("accession"), (F.col("o_custkey") % 4 + 1).alias("charge"), F.round("o_totalprice", 2).alias("exp_mass_to_charge"),
                         F.concat(F.lit("run"), F.floor(F.col("o_orderkey") / 10) % 3).alias("spectra_file"), F.concat(F.lit("scan="), "o_orderkey").alias("spectra_id"))
    mztab.write_mztab([("description", "matches")], proteins, psms, path)
    _, _, back = mztab.read_mztab(spark, path)
    rows = read_psms(spark, path).join(back.select("psm_id", F.col("protein.description").alias("description")), "psm_id")
    return rows.select("psm_id", "peptide", "charge", F.round("mz", 2).alias("mz"), "protein", "scan", "description", "error")


@_query(f"""WITH n AS ({_NAMES}), r AS (SELECT p_partkey, k, length(s) AS n, substr(s, k + 1, 1) AS aa FROM (SELECT p_partkey, s, CAST(unnest(range(0, length(s))) AS INTEGER) AS k FROM n))
SELECT p_partkey, k AS index, aa, contains('KR', aa) OR (k = 0 AND p_partkey % 2 = 0) OR (k = n - 1 AND aa = 'E') OR (k = n - 1 AND aa = 'T' AND p_partkey % 3 = 0) AS allowed FROM r""")
def placed_modifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues that a modification of K and R, of protein starts, of E at any end and of T at protein ends may be on."""
    rule = lambda residues, position: F.struct(F.array(*map(F.lit, residues)).cast("array<string>").alias("residues"), F.lit(position).alias("position"))
    rules = F.array(rule("KR", "anywhere"), rule("", "protein_n_term"), rule("E", "any_c_term"), rule("T", "protein_c_term"))
    each = _named(spark, sf_dir).select("p_partkey", F.length("s").alias("n"), F.posexplode(F.filter(F.split("s", ""), lambda x: x != "")).alias("index", "aa"))
    key = F.col("p_partkey")
    return each.select("p_partkey", "index", "aa", md.placed(rules, F.col("aa"), F.col("index"), F.col("n"), key % 2 == 0, key % 3 == 0).alias("allowed"))


@_query(f"""WITH n AS ({_NAMES}), t AS (SELECT * FROM (VALUES ('GCN', 'A'), ('RAY', 'B'), ('SAR', 'Z'), ('MTT', 'J'), ('TAR', '*'), ('YTN', 'X'), ('AUG', 'M')) AS v(codon, aa)),
c AS (SELECT p_partkey, k, ['GCN', 'RAY', 'SAR', 'MTT', 'TAR', 'YTN', 'AUG'][(p_partkey + k) % 7 + 1] AS codon FROM part, range(0, 3) AS r(k)) SELECT p_partkey, string_agg(aa, '' ORDER BY k) AS protein FROM c JOIN t USING (codon) GROUP BY 1""")
def ambiguous_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.functions.text import translate

    codons = F.array(*map(F.lit, ("GCN", "RAY", "SAR", "MTT", "TAR", "YTN", "AUG")))
    dna = F.concat(*(F.get(codons, ((F.col("p_partkey") + k) % 7).cast("int")) for k in range(3)))
    return _table(spark, sf_dir, "part").select("p_partkey", translate(dna).alias("protein"))


@_query("""SELECT 'scan=' || l_orderkey AS id, CAST(1 + l_orderkey % 3 AS INTEGER) AS ms_level, CAST(CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END AS INTEGER) AS polarity, l_orderkey * 0.5::DOUBLE AS rt_s,
CASE WHEN l_orderkey % 3 > 0 THEN 100 + l_orderkey / 7.0::DOUBLE END AS precursor_mz, CAST(CASE WHEN l_orderkey % 3 > 0 AND l_orderkey % 5 > 0 THEN l_orderkey % 5 END AS INTEGER) AS charge,
count(*) AS n_peaks, round(min(l_extendedprice), 4) AS first_mz, round(max(l_extendedprice), 4) AS last_mz, round(sum(l_quantity), 4) AS total, CAST(NULL AS VARCHAR) AS error FROM lineitem GROUP BY l_orderkey""")
def mzml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as spectra whose lines are peaks, written as mzML, half of them compressed, and read back."""
    from massloom.sources.mzml import read_mzml, write_mzml

    key, root = F.col("l_orderkey"), scratch(spark)
    line = F.struct(F.col("l_extendedprice").cast("double").alias("mz"), F.col("l_quantity").cast("double").alias("intensity"))
    orders = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("peaks"))
    rows = orders.select(F.concat(F.lit("scan="), key).alias("id"), (1 + key % 3).cast("int").alias("ms_level"), F.when(key % 2 == 0, 1).otherwise(-1).alias("polarity"), (key * 0.5).alias("rt_s"),
                         F.when(key % 3 > 0, 100 + key / 7.0).alias("precursor_mz"), F.when(key % 5 > 0, key % 5).cast("int").alias("charge"), "peaks")
    rows.write.parquet(f"{root}-orders")  # grouped once for both halves
    rows = spark.read.schema(rows.schema).parquet(f"{root}-orders")
    for half in (0, 1):
        write_mzml(rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == half), f"{root}/{half}", compress=bool(half))
    back = read_mzml(spark, f"{root}/*")
    of = lambda name: F.transform("peaks", lambda p: p[name])
    total = F.aggregate(of("intensity"), F.lit(0.0), lambda a, x: a + x)
    return back.select("id", "ms_level", "polarity", "rt_s", "precursor_mz", "charge", F.size("peaks").cast("long").alias("n_peaks"), F.round(F.array_min(of("mz")), 4).alias("first_mz"), F.round(F.array_max(of("mz")), 4).alias("last_mz"), F.round(total, 4).alias("total"), "error")
