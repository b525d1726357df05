"""Queries on structures that rows of the tables stand for: glycan trees, ontology graphs, chemical bonds, linked chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions import chemistry as ch
from massloom.functions.modifications import SUGARS, modification_mass
from massloom.functions.tolerance import Tolerance
from massloom.operators import fragments as fr
from massloom.operators import generate
from massloom.plans.queries import _SQL_RESIDUES, _query, _residues, _table

_TREE_SUGARS = ("Man", "GlcNAc", "Fuc")
_TREE_KINDS = ("Hex", "HexNAc", "dHex")


def _sql_structures() -> str:
    masses = [f"{ch.formula_mass(ch.parse_formula(SUGARS[k]))!r}::DOUBLE" for k in _TREE_KINDS]
    return f"""WITH RECURSIVE t AS (SELECT p_partkey AS id, 3 + p_size % 6 AS n, k, CASE WHEN k > 0 THEN (p_partkey * (k + 3) + p_size) % k ELSE -1 END AS parent, (p_partkey + k * k) % 3 AS sugar FROM part, range(0, 8) AS r(k) WHERE k < 3 + p_size % 6),
r AS (SELECT id, n, k AS root, k AS spot, CAST(1 << k AS BIGINT) AS mask, 0 AS breaks FROM t
UNION ALL SELECT r.id, r.n, root, spot + 1, CASE WHEN choice = 1 THEN mask | (1 << (spot + 1)) ELSE mask END, breaks + CASE WHEN choice = 0 THEN 1 ELSE 0 END
FROM r JOIN t ON t.id = r.id AND t.k = r.spot + 1 JOIN (VALUES (0), (1), (2)) AS c(choice) ON (choice = 2) = (t.parent < r.root OR (mask >> t.parent) & 1 = 0)),
f AS (SELECT id, root, breaks, mask FROM r WHERE spot = n - 1),
c AS (SELECT f.id, root, breaks, mask, sum(CASE WHEN sugar = 2 THEN 1 ELSE 0 END) AS d, sum(CASE WHEN sugar = 0 THEN 1 ELSE 0 END) AS h, sum(CASE WHEN sugar = 1 THEN 1 ELSE 0 END) AS x FROM f JOIN t ON t.id = f.id AND (mask >> k) & 1 = 1 GROUP BY ALL),
i AS (SELECT id, 'B' AS ion, breaks, h, x, d FROM c UNION ALL SELECT id, 'Y', breaks, h, x, d FROM c WHERE root = 0 AND breaks > 0 UNION ALL SELECT DISTINCT id, 'Y', 1, 0, 0, 0 FROM t)
SELECT id AS p_partkey, ion, CAST(breaks AS INTEGER) AS breaks, CASE WHEN h > 0 THEN 'Hex' || h ELSE '' END || CASE WHEN x > 0 THEN 'HexNAc' || x ELSE '' END || CASE WHEN d > 0 THEN 'dHex' || d ELSE '' END AS part,
count(*) AS ways, round(CASE ion WHEN 'Y' THEN 1000.0 ELSE 0.0 END + h * {masses[0]} + x * {masses[1]} + d * {masses[2]}, 4) AS neutral FROM i GROUP BY id, ion, breaks, h, x, d"""


@_query(_sql_structures())
def glycan_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of sugars, one for each part, written as texts, read back and broken in every way."""
    from massloom.operators import glycans as gl

    key, k = F.col("p_partkey"), lambda x: x.cast("long")
    n = (3 + F.col("p_size") % 6).cast("int")

    def node(x):
        parent = F.when(x > 0, (key * (k(x) + 3) + F.col("p_size")) % F.greatest(k(x), F.lit(1))).otherwise(-1)
        sugar = F.get(F.array(*map(F.lit, _TREE_SUGARS)), ((key + k(x) * k(x)) % 3).cast("int"))
        return F.struct(sugar.alias("sugar"), parent.cast("int").alias("parent"))

    trees = _table(spark, sf_dir, "part").select("p_partkey", gl.structure_texts(F.transform(F.sequence(F.lit(0), n - 1), node)).alias("glycan"), F.lit(1000.0).alias("peptide"))
    out = gl.structure_fragments(trees, "glycan", "peptide", by_node=False)
    return out.select("p_partkey", "ion", "breaks", "part", "ways", F.round("neutral", 4).alias("neutral"))


_LETTER_MASSES = "(VALUES " + ", ".join(f"('{a}', {ch.MONO[a]!r}::DOUBLE)" for a in ch.STANDARD) + ") AS w(aa, m)"
_SERIES = [(i, "n" if i in fr.N_TERMINAL else "c", loss, (fr.N_TERMINAL | fr.C_TERMINAL)[i] - fr.LOSSES[loss]) for i in "abcxyz" for loss in ("", "-H2O")]
_RULES = "(VALUES " + ", ".join(f"('{i}', '{s}', '{x}', {o!r}::DOUBLE)" for i, s, x, o in _SERIES) + ") AS u(ion, side, loss, off)"
_MODEL = fr.FragmentModel(tuple(fr.Series(i, losses=("", "-H2O")) for i in "abcxyz"), (1, 2))
_ENDS = f"""SELECT p_partkey, ion, index, inside, loss, CAST(z AS INTEGER) AS charge, round(((mass + off) + z * {ch.PROTON!r}::DOUBLE) / z, 4) AS mz FROM p JOIN {_RULES} USING (side), (VALUES (1), (2)) AS c(z) WHERE mass + off > 0"""


@_query(f"""WITH n AS (SELECT p_partkey, {_SQL_RESIDUES.format("p_name")} AS s FROM part),
r AS (SELECT p_partkey, length(s) AS n, k, m + CASE WHEN aa = 'M' THEN {modification_mass("Oxidation")!r}::DOUBLE ELSE 0.0 END + CASE WHEN k = 1 AND p_partkey % 2 = 0 THEN {modification_mass("Acetyl")!r}::DOUBLE ELSE 0.0 END AS m, contains('STY', aa) AS c
FROM (SELECT p_partkey, s, k, substr(s, k, 1) AS aa FROM (SELECT p_partkey, s, unnest(range(1, length(s) + 1)) AS k FROM n)) JOIN {_LETTER_MASSES} USING (aa)),
q AS (SELECT p_partkey, k AS q FROM r WHERE c UNION ALL SELECT p_partkey, 0 FROM r GROUP BY 1 HAVING NOT bool_or(c)),
t AS (SELECT p_partkey, n, k, sum(m) OVER (PARTITION BY p_partkey ORDER BY k) AS up, sum(m) OVER (PARTITION BY p_partkey ORDER BY k DESC) AS down FROM r),
p AS (SELECT DISTINCT p_partkey, 'n' AS side, CAST(k AS INTEGER) AS index, CASE WHEN q BETWEEN 1 AND k THEN '#p1' ELSE '' END AS inside, round(up + CASE WHEN q BETWEEN 1 AND k THEN {modification_mass("Phospho")!r}::DOUBLE ELSE 0.0 END, 7) AS mass FROM t JOIN q USING (p_partkey) WHERE k < n
UNION ALL SELECT DISTINCT p_partkey, 'c', CAST(n - k + 1 AS INTEGER), CASE WHEN q >= k THEN '#p1' ELSE '' END, round(down + CASE WHEN q >= k THEN {modification_mass("Phospho")!r}::DOUBLE ELSE 0.0 END, 7) FROM t JOIN q USING (p_partkey) WHERE k > 1) {_ENDS}""")
def modified_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six series of peptides with oxidised M, an acetylated start on every second one, and a phospho group on one of all S, T and Y."""
    text = F.regexp_replace(_residues("p_name"), "M", "M[Oxidation]")
    text = F.regexp_replace(F.regexp_replace(text, r"^([^STY]*[STY])", "$1[Phospho#p1]"), r"([STY])(?!\[)", "$1[#p1]")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("[Acetyl]-"), text)).otherwise(text)
    out = fr.modified_fragments(_table(spark, sf_dir, "part").select("p_partkey", text.alias("peptide")), _MODEL, ["p_partkey"])
    return out.select("p_partkey", "ion", "index", "inside", "loss", "charge", F.round("mz", 4).alias("mz"))


_WORD = "(SELECT p_partkey, {} AS s FROM part)"


@_query(f"""WITH a AS {_WORD.format(_SQL_RESIDUES.format("split_part(p_name, ' ', 1)"))}, b AS {_WORD.format(_SQL_RESIDUES.format("split_part(p_name, ' ', 2)"))},
c AS (SELECT p_partkey, 0 AS chain, s FROM a UNION ALL SELECT p_partkey, 1, s FROM b), r AS (SELECT p_partkey, chain, length(s) AS n, k, m FROM (SELECT *, substr(s, k, 1) AS aa FROM (SELECT *, unnest(range(1, length(s) + 1)) AS k FROM c)) JOIN {_LETTER_MASSES} USING (aa)),
w AS (SELECT p_partkey, chain, sum(m) AS whole FROM r GROUP BY ALL), t AS (SELECT p_partkey, chain, n, k, sum(m) OVER o AS up, sum(m) OVER (PARTITION BY p_partkey, chain ORDER BY k DESC) AS down FROM r WINDOW o AS (PARTITION BY p_partkey, chain ORDER BY k)),
p AS (SELECT t.p_partkey, t.chain, 'n' AS side, CAST(k AS INTEGER) AS index, '' AS inside, up + CASE WHEN t.chain = 0 THEN 138.068 + w.whole + {ch.WATER!r}::DOUBLE ELSE 0.0 END AS mass FROM t JOIN w ON w.p_partkey = t.p_partkey AND w.chain <> t.chain WHERE k < n
UNION ALL SELECT t.p_partkey, t.chain, 'c', CAST(n - k + 1 AS INTEGER), '', down + CASE WHEN t.chain = 1 THEN 138.068 + w.whole + {ch.WATER!r}::DOUBLE ELSE 0.0 END FROM t JOIN w ON w.p_partkey = t.p_partkey AND w.chain <> t.chain WHERE k > 1)
SELECT p_partkey, CAST(chain AS INTEGER) AS chain, ion, index, loss, CAST(z AS INTEGER) AS charge, CAST(round(((mass + off) + z * {ch.PROTON!r}::DOUBLE) / z * 1000) AS BIGINT) // 10 AS centi FROM p JOIN {_RULES} USING (side), (VALUES (1), (2)) AS c(z) WHERE mass + off > 0""")
def linked_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six series of two chains whose first and last residue are linked: what holds the link has the other chain on it."""
    word = lambda k: _residues(F.split("p_name", " ")[k])
    own = _table(spark, sf_dir, "part").select("p_partkey", word(0).alias("a"), word(1).alias("b"))
    text = F.concat(F.substring("a", 1, 1), F.lit("[+138.068#XL1]"), F.substring("a", F.lit(2), F.length("a")), F.lit("//"), "b", F.lit("[#XL1]"))
    out = fr.modified_fragments(own.select("p_partkey", text.alias("peptide")), _MODEL, ["p_partkey"])
    return out.select("p_partkey", "chain", "ion", "index", "loss", "charge", F.expr("CAST(floor(round(mz * 1000) / 10) AS BIGINT)").alias("centi"))


_MOLECULES = """CASE p_partkey % 6 WHEN 0 THEN 'C' || (n) || 'H' || (2 * n + 2) || 'O' WHEN 1 THEN 'C' || (n + 2) || 'H' || (2 * n + 4) WHEN 2 THEN 'C' || (n + 6) || 'H' || (2 * n + 6)
WHEN 3 THEN 'C' || (n + 1) || 'H' || (2 * n + 2) || 'O2' WHEN 4 THEN 'C' || (n + 5) || 'H' || (2 * n + 5) || 'N' END"""


@_query(f"""WITH t AS (SELECT p_partkey, 2 + p_size % 9 AS n FROM part) SELECT p_partkey, {_MOLECULES} AS formula, CAST(CASE p_partkey % 6 WHEN 0 THEN n WHEN 1 THEN n + 2 WHEN 2 THEN n + 6 WHEN 3 THEN n + 2 WHEN 4 THEN n + 6 END AS INTEGER) AS bonds,
CAST(CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 3 THEN 0 WHEN 5 THEN NULL ELSE 1 END AS INTEGER) AS rings, p_partkey % 6 = 5 AS bad FROM t""")
def smiles_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alcohols, rings, aromatic chains, acids and texts that are no molecule, one for each part."""
    from massloom.functions.smiles import molecules

    n, key = (2 + F.col("p_size") % 9).cast("int"), F.col("p_partkey") % 6
    chain = F.repeat(F.lit("C"), n)
    text = F.when(key == 0, F.concat(chain, F.lit("O"))).when(key == 1, F.concat(F.lit("C1"), chain, F.lit("C1"))).when(key == 2, F.concat(F.lit("c1ccccc1"), chain))
    text = text.when(key == 3, F.concat(chain, F.lit("C(=O)O"))).when(key == 4, F.concat(F.lit("c1cc("), chain, F.lit(")cnc1"))).otherwise(F.concat(chain, F.lit("(")))
    out = _table(spark, sf_dir, "part").select("p_partkey", molecules(text).alias("m"))
    return out.select("p_partkey", "m.formula", F.when(F.col("m.bonds").isNotNull(), F.size("m.bonds")).alias("bonds"), "m.rings", F.col("m.error").isNotNull().alias("bad"))


@_query("""WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 0 UNION SELECT c_custkey, c_custkey * 2 // 3 FROM customer WHERE c_custkey > 0 AND c_custkey % 3 > 0),
r AS (SELECT child AS id, parent AS ancestor, 1 AS distance FROM e UNION SELECT r.id, e.parent, r.distance + 1 FROM r JOIN e ON e.child = r.ancestor)
SELECT 'N:' || id AS id, 'N:' || ancestor AS ancestor, CAST(min(distance) AS INTEGER) AS distance FROM r GROUP BY ALL""")
def ontology_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as terms with one or two parents, written as OBO text, and all that they descend from."""
    from massloom.session import scratch
    from massloom.sources import ontology as on
    from massloom.sources.vocabulary import read_obo

    key, path = F.col("c_custkey"), f"{scratch(spark)}/terms"
    line = lambda p: F.concat(F.lit("is_a: N:"), F.floor(p).cast("string"), F.lit(" ! parent"))
    second = F.when(key % 3 > 0, line(key * 2 / 3))
    text = F.concat_ws("\n", F.lit("[Term]"), F.concat(F.lit("id: N:"), key), F.concat(F.lit("name: customer "), key), F.when(key > 0, line(key / 2)), F.when(key > 0, second), F.lit(""))
    _table(spark, sf_dir, "customer").select(text).write.text(path)
    return on.closure(on.edges(read_obo(spark, path)))


def _sql_larger_sets() -> str:
    blocks = generate._blocks("ARNDCQEGHLKMFPSTWYV", [("Carbamidomethyl", 57.021464, "C")], [("Oxidation", 15.994915, "M")])
    rows = ", ".join(f"({k}, '{t}', {m!r}::DOUBLE)" for k, (t, _, m) in enumerate(blocks))
    return f"""WITH RECURSIVE b AS (SELECT * FROM (VALUES {rows}) AS v(k, a, m)), t AS (SELECT DISTINCT p_size, 250.125::DOUBLE + p_size * 9.0045::DOUBLE AS mass FROM part),
s AS (SELECT a AS residues, m, k, 1 AS n FROM b UNION ALL SELECT s.residues || b.a, s.m + b.m, b.k, n + 1 FROM s JOIN b ON b.k >= s.k WHERE n < 5),
x AS (SELECT * FROM (VALUES (NULL, 0.0::DOUBLE), ('Acetyl', 42.010565::DOUBLE)) AS v(n_term, extra))
SELECT p_size, residues, n_term FROM t, x JOIN s ON m BETWEEN mass - 0.02 - {ch.WATER!r}::DOUBLE - extra AND mass + 0.02 - {ch.WATER!r}::DOUBLE - extra WHERE n_term IS NULL OR regexp_matches(regexp_replace(residues, '\\[[^\\]]*\\]', '', 'g'), '[AGK]')"""


@_query(_sql_larger_sets())
def larger_isobaric_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of up to five residues, with carbamidomethylated C, M with and without oxidation, and an acetyl group at starts that A, G or K can be."""
    targets = _table(spark, sf_dir, "part").select("p_size", (F.lit(250.125) + F.col("p_size") * 9.0045).alias("mass")).distinct()
    out = generate.isobaric_sets(targets, "mass", Tolerance.absolute(0.02), 5, fixed=[("Carbamidomethyl", 57.021464, "C")], variable=[("Oxidation", 15.994915, "M")], n_term=[("Acetyl", 42.010565, "AGK")])
    return out.select("p_size", "residues", "n_term")


@_query(f"""WITH n AS (SELECT p_partkey, p_partkey % 8 AS k, {_SQL_RESIDUES.format("p_name")} AS s FROM part), t AS (SELECT p_partkey, k, CASE k WHEN 0 THEN s WHEN 1 THEN s || 'B' WHEN 2 THEN '[Acetyl]-' || s || '/2' WHEN 3 THEN s || '[U:Oxidation|INFO:late#g1(0.75)]'
WHEN 4 THEN '(?' || s[1:2] || ')' || s[3:] WHEN 5 THEN '<[Oxidation]@M>' || s WHEN 6 THEN s || '+' || s ELSE s || '[' END AS text FROM n)
SELECT p_partkey, CASE WHEN k < 7 THEN text END AS text, CASE k WHEN 0 THEN 'unambiguous' WHEN 1 THEN 'semi_ambiguous' WHEN 2 THEN 'unambiguous' WHEN 3 THEN 'simple_linear' WHEN 4 THEN 'simple_linear' WHEN 5 THEN 'linear' WHEN 6 THEN 'chimeric' END AS complexity,
CASE WHEN k < 7 THEN k <= 4 END AS simple, CASE k WHEN 2 THEN 'name:Acetyl' WHEN 3 THEN 'name:Oxidation,info:late' WHEN 5 THEN 'name:Oxidation' WHEN 7 THEN NULL ELSE '' END AS typed, CASE k WHEN 3 THEN 0.75::DOUBLE END AS score, k = 7 AS bad FROM t""")
def proforma_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of every complexity and some that are none: read, typed and written again."""
    from massloom.functions.proforma import narrowest, report

    s, key = F.col("s"), F.col("p_partkey") % 8
    text = F.when(key == 0, s).when(key == 1, F.concat(s, F.lit("B"))).when(key == 2, F.concat(F.lit("[Acetyl]-"), s, F.lit("/2"))).when(key == 3, F.concat(s, F.lit("[U:Oxidation|INFO:late#g1(0.75)]")))
    text = text.when(key == 4, F.concat(F.lit("(?"), F.substring(s, 1, 2), F.lit(")"), F.substring(s, F.lit(3), F.length(s)))).when(key == 5, F.concat(F.lit("<[Oxidation]@M>"), s)).when(key == 6, F.concat(s, F.lit("+"), s)).otherwise(F.concat(s, F.lit("[")))
    out = _table(spark, sf_dir, "part").select("p_partkey", _residues("p_name").alias("s")).select("p_partkey", report(text).alias("r"))
    options = F.flatten(F.transform("r.modifications", lambda m: m["options"]))
    typed = F.array_join(F.transform(options, lambda o: F.concat_ws(":", o["kind"], o["value"])), ",")
    score = F.array_max(F.transform(options, lambda o: o["score"]))
    return out.select("p_partkey", "r.text", "r.complexity", narrowest(F.col("r.complexity"), "simple_linear").alias("simple"), typed.alias("typed"), score.alias("score"), F.col("r.error").isNotNull().alias("bad"))


@_query(f"""WITH t AS (SELECT p_partkey, 1 + p_size % 9 AS c, 1 + p_partkey % 4 AS o FROM part) SELECT p_partkey, 'C' || CASE WHEN c > 1 THEN CAST(c AS VARCHAR) ELSE '' END || 'H' || (2 * c) || 'O' || CASE WHEN o > 1 THEN CAST(o AS VARCHAR) ELSE '' END AS formula,
CAST(CASE p_partkey % 5 WHEN 3 THEN 2 ELSE 0 END AS INTEGER) AS charge, round(c * 12.0::DOUBLE + 2 * c * {ch.ELEMENTS["H"]!r}::DOUBLE + o * {ch.ELEMENTS["O"]!r}::DOUBLE, 5) AS mass FROM t""")
def formula_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One formula a part, written in five notations and read."""
    from massloom.functions.formulas import formulas

    key = F.col("p_partkey") % 5
    c, h, o = (1 + F.col("p_size") % 9).cast("string"), (2 * (1 + F.col("p_size") % 9)).cast("string"), (1 + F.col("p_partkey") % 4).cast("string")
    kinds = [("proforma", "C{}H{}O{}"), ("psi_mod", "C {} H {} N 0 O {}"), ("xl_mod", "C{} H{} O{}"), ("resid", "C {} H {} O {} 2+"), ("unimod", "H(0) C({}) H({}) O({})")]
    out = None
    for k, (notation, form) in enumerate(kinds):
        a, b, d, e = form.split("{}")
        own = _table(spark, sf_dir, "part").where(key == k).select("p_partkey", formulas(F.concat(F.lit(a), c, F.lit(b), h, F.lit(d), o, F.lit(e)), notation).alias("f"))
        out = own if out is None else out.unionAll(own)
    one = F.col("f.formulas")[0]
    return out.select("p_partkey", one["hill"].alias("formula"), one["charge"].alias("charge"), F.round(one["mass"], 5).alias("mass"))
