"""Delimited and JSON tables, coordinate-map documents and hashed manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HITS = "query string, target string, pident double, alnlen int, qlen int, tlen int, qcov double, tcov double, bits double, evalue double"
ENTRIES = "route string, tier string, family string, query_label string, accession string, entry_name string, taxid string, organism string, gene_primary string, gene_names string, length int, reviewed int, protein_existence string"
MAPS = "map<string, struct<columns: int, references: map<string, struct<canonical_to_column: map<string, int>, column_to_canonical: map<string, int>>>>>"


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", header: bool = True) -> DataFrame:
    """A delimited table; without a schema types are inferred, which reads the file twice."""
    r = spark.read.option("header", header).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Similarity hits without a header line; identities given in percent become fractions."""
    from gridstat.operators.ranking import normalised_fraction

    return normalised_fraction(read_csv(spark, path, HITS, sep="\t", header=False), "pident")


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.option("header", True).option("sep", sep).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """JSON documents, one a file, or with ``lines`` one a line, as ``write_json`` writes them and large files need it."""
    r = spark.read.option("multiLine", not lines)
    return (r.schema(schema) if schema else r).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def coordinate_maps(spark: SparkSession, path: str) -> DataFrame:
    """(family, reference, residue, col_ix) of a nested coordinate-map document."""
    text = spark.read.text(path, wholetext=True)
    fam = text.select(F.explode(F.from_json("value", MAPS)).alias("family", "m"))
    ref = fam.select("family", F.explode("m.references").alias("reference", "r"))
    return ref.select("family", "reference", F.explode("r.canonical_to_column").alias("residue", "col_ix")).withColumn("residue", F.col("residue").cast("int"))


def feature_ranges(entries: DataFrame, labels: dict[str, str], prefix: str = "SH2") -> DataFrame:
    """(accession, feature, start, end, description) from nested entries: labels by description, or the prefix itself."""
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)) if labels else None
    f = entries.select("accession", F.explode("features").alias("f"))
    d = F.col("f.description")
    label = F.when(d.startswith(prefix), F.lit(prefix))
    if table is not None:
        label = F.coalesce(table[d], label)
    return f.select("accession", label.alias("feature"), F.col("f.start").alias("start"), F.col("f.end").alias("end"), d.alias("description")).filter("feature is not null")


def entries(raw: DataFrame) -> DataFrame:
    """Retrieved rows with lengths as integers (0 if none) and the reviewed flag as 0 or 1."""
    size = F.when(F.col("length").cast("string").rlike("^[0-9]+$"), F.col("length").cast("int")).otherwise(0)
    flag = F.lower(F.col("reviewed").cast("string")).startswith("reviewed").cast("int")
    return raw.withColumns({"length": size, "reviewed": F.coalesce(flag, F.lit(0))})


def fan_out(spark: SparkSession, tiers: list[str], routes: dict[str, list[str]]) -> DataFrame:
    """(query_no, route, label, tier): every query of a survey, in order."""
    rows = [(i, r, x, t) for i, (t, r, x) in enumerate((t, r, x) for t in tiers for r, xs in routes.items() for x in xs)]
    return spark.createDataFrame(rows, "query_no int, route string, label string, tier string")


def lookup(keys: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the wanted keys, each once, and the keys that the table lacks."""
    wanted = keys.select(key).dropDuplicates()
    return wanted.join(table, key), wanted.join(table, key, "left_anti")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256_16) of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.substring(F.sha2("content", 256), 1, 16).alias("sha256_16"))


def read_ragged(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """Pages of delimited rows under one header, as a paginated service gives them: short rows are padded with empty strings, headers repeated by later pages dropped."""
    parts = F.split("value", sep)
    t = spark.read.text(path).filter(F.col("value") != "").select(parts.alias("p"))
    out = t.select(*(F.coalesce(F.when(F.size("p") > i, F.col("p")[i]), F.lit("")).alias(c) for i, c in enumerate(columns)))
    return out.filter(F.col(columns[0]) != columns[0])


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """(file, chain, residue, code, atom, element, x, y, z) of the first model of mmCIF files: rows of the atom_site loop, one file a row group."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = files.select("file", F.split("value", r"\r?\n").alias("l"))
    names = F.transform(F.filter("l", lambda x: x.startswith("_atom_site.")), lambda x: F.trim(F.regexp_replace(x, r"^_atom_site\.", "")))
    rows = F.filter("l", lambda x: x.startswith("ATOM ") | x.startswith("HETATM "))
    cut = lines.select("file", names.alias("names"), F.explode(rows).alias("row")).select("file", "names", F.split(F.trim("row"), r"\s+").alias("v"))
    at = lambda n: F.element_at("v", F.array_position("names", F.lit(n)).cast("int"))
    out = cut.select("file", at("auth_asym_id").alias("chain"), at("auth_seq_id").cast("int").alias("residue"), at("label_comp_id").alias("code"), at("label_atom_id").alias("atom"), at("type_symbol").alias("element"), *(at(f"Cartn_{c}").cast("double").alias(c) for c in "xyz"), at("pdbx_PDB_model_num").alias("model"))
    first = out.groupBy("file").agg(F.min(F.col("model").cast("int")).alias("first"))
    return out.join(F.broadcast(first), "file").filter(F.col("model").cast("int") == F.col("first")).drop("model", "first")


def read_substitution(spark: SparkSession, path: str) -> dict[tuple[str, str], float]:
    """The scores of a substitution table as public ones are laid out: comment lines, a line of column letters, then a letter and its scores a line.

    A table has a row for each letter of an alphabet, so it is read whole.
    """
    text = spark.read.text(path, wholetext=True).first()[0]
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    return {(a, b): float(v) for a, *row in lines[1:] for b, v in zip(lines[0], row, strict=True)}


def pages(fetch, first: str):
    """What ``fetch(address) -> (rows, next address or None)`` gives for an address and all that follow it, a page at a time; a service that links back to a page stops it."""
    seen, at = set(), first
    while at and at not in seen:
        seen.add(at)
        rows, at = fetch(at)
        yield rows


def retried(fetch, attempts: int = 4, pause: float = 2.0, sleep=None):
    """The result of ``fetch()``, tried again after pauses that grow linearly; an error that says the request itself is wrong (4xx) is final."""
    import time

    for i in range(attempts):
        try:
            return fetch()
        except Exception as e:
            code = getattr(e, "code", None)
            if (code is not None and 400 <= code < 500) or i == attempts - 1:
                raise
            (sleep or time.sleep)(pause * (i + 1))
