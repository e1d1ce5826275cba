"""Molecule and structure files as DataFrames, and back."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K

#: What stands for a missing value in delimited files (fixed values).
MISSING = ("", "NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "<NA>", "#N/A", "-NaN", "-nan")
EXTENSIONS = {".sdf": "sdf", ".sdf.gz": "sdf", ".smi": "smi", ".smiles": "smi", ".csv": "csv", ".tsv": "tsv", ".pdb": "pdb", ".parquet": "parquet"}
EXPORT_COLUMNS = ("record_id", "smiles", "MolWt", "LogP", "QED", "drug_likeness", "sa_score", "composite_score", "admet_score", "admet_class", "rank")


class FormatError(ValueError):
    """A file format, or a column, that a reader or writer does not have."""


def detect(path: str) -> str:
    low = path.lower().rstrip("/")
    for ext in sorted(EXTENSIONS, key=len, reverse=True):
        if low.endswith(ext):
            return EXTENSIONS[ext]
    raise FormatError(f"no known format for {path!r}")


def load(spark: SparkSession, path: str, format: str = "auto", **how) -> DataFrame:
    """The reader of the format, by name or by extension. Formats without a reader (mol, mol2, json) raise."""
    kind = detect(path) if format == "auto" else format
    readers = {"csv": load_csv, "tsv": lambda s, p, **k: load_csv(s, p, sep="\t", **k), "smi": load_smiles, "smiles": load_smiles, "sdf": load_sdf, "pdb": load_pdb, "parquet": lambda s, p, **k: s.read.parquet(p)}
    if kind not in readers:
        raise FormatError(f"no reader for {kind!r}")
    return readers[kind](spark, path, **how)


def smiles_column(columns: list[str], wanted: str = "smiles") -> str:
    """The column asked for, in any case, or else the first known name."""
    if wanted in columns:
        return wanted
    low = {c.lower(): c for c in reversed(columns)}
    found = low.get(wanted.lower()) or next((c for c in K.SMILES_COLUMNS if c in columns), None)
    if found is None:
        raise FormatError(f"no SMILES column among {columns}")
    return found


def load_csv(spark: SparkSession, path: str, smiles: str = "smiles", id_column: str | None = None, sep: str = ",", limit: int | None = None) -> DataFrame:
    """smiles, source_id, source_index and the other columns (inferred types); the usual marks of missing values are null."""
    raw = spark.read.csv(path, sep=sep, header=True, inferSchema=False, quote='"', escape='"', multiLine=True)
    raw = raw.limit(limit) if limit is not None else raw
    clean = raw.select(*[F.when(~F.col(f"`{c}`").isin(list(MISSING)), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    s = smiles_column(clean.columns, smiles)
    ident = id_column or next((c for c in clean.columns if c.lower() in ("id", "name", "source_id")), None)
    rest = [c for c in clean.columns if c not in (s, ident)]
    numeric = clean.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).alias(f"n{i}") for i, c in enumerate(rest)]).first() if rest else ()
    typed = [(F.col(f"`{c}`").cast("double") if not bad else F.col(f"`{c}`")).alias(c) for c, bad in zip(rest, numeric)]
    return clean.select(F.col(f"`{s}`").alias("smiles"), (F.col(f"`{ident}`") if ident else F.lit(None).cast("string")).alias("source_id"), *typed).withColumn("source_index", F.monotonically_increasing_id())


def load_smiles(spark: SparkSession, path: str, sep: str = "\t", header: bool = False, limit: int | None = None) -> DataFrame:
    """smiles and source_id of a .smi file; blank lines and those that begin with # are skipped. ``limit`` counts raw lines."""
    lines = spark.read.text(path)
    lines = lines.limit(limit) if limit is not None else lines
    lines = lines.withColumn("source_index", F.monotonically_increasing_id())
    line = F.trim("value")
    rows = lines.where((line != "") & ~line.startswith("#"))
    parts = F.split(line, sep, 2)
    out = rows.select(F.trim(parts[0]).alias("smiles"), F.trim(F.get(parts, F.lit(1))).alias("source_id"), "source_index")
    if header:
        first = out.agg(F.min("source_index")).first()[0]
        out = out.where(F.col("source_index") != first) if first is not None else out
    return out


def load_sdf(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """source_id, molblock, tags (map), atoms and bonds of each record, and its status.

    Records are split by Spark's text reader, one row each, compressed files too; the fixed columns of
    the counts line, atoms and bonds are read with string functions.
    """
    raw = spark.read.text(path, lineSep="$$$$").withColumn("source_index", F.monotonically_increasing_id())
    text = F.regexp_replace(F.regexp_replace("value", r"\r", ""), r"^\n", "")
    rows = raw.select("source_index", text.alias("record")).where(F.trim("record") != "")
    rows = rows.limit(limit) if limit is not None else rows
    lines = F.split("record", "\n")
    rows = rows.withColumn("lines", lines).withColumn("counts", F.get("lines", F.lit(3)))
    count = lambda a: F.trim(F.substring("counts", a, 3)).try_cast("int")
    rows = rows.withColumns({"n_atoms": count(1), "n_bonds": count(4)})
    field = lambda x, a, n: F.trim(F.substring(x, a, n))
    atom = lambda x: F.struct(field(x, 1, 10).try_cast("double").alias("x"), field(x, 11, 10).try_cast("double").alias("y"), field(x, 21, 10).try_cast("double").alias("z"), field(x, 32, 3).alias("element"))
    bond = lambda x: F.struct(field(x, 1, 3).try_cast("int").alias("a"), field(x, 4, 3).try_cast("int").alias("b"), field(x, 7, 3).try_cast("int").alias("order"))
    tags = F.regexp_extract_all("record", F.lit(r"(?s)> *<([^>]*)>[^\n]*\n(.*?)(?=\n\n|\n>|\z)"), F.lit(0))
    name = lambda t: F.regexp_extract(t, r"<([^>]*)>", 1)
    value = lambda t: F.regexp_replace(t, r"(?s)^[^\n]*\n", "")
    ok = F.col("n_atoms").isNotNull() & (F.size("lines") >= 4 + F.col("n_atoms") + F.coalesce("n_bonds", F.lit(0)))
    return rows.select(
        "source_index", F.trim(F.get("lines", F.lit(0))).alias("source_id"), F.when(ok, "raw").otherwise("failed").alias("status"),
        F.when(ok, F.transform(F.slice("lines", F.lit(5), F.col("n_atoms")), atom)).alias("atoms"), F.when(ok, F.transform(F.slice("lines", F.col("n_atoms") + 5, F.coalesce("n_bonds", F.lit(0))), bond)).alias("bonds"),
        F.map_from_entries(F.transform(F.array_distinct(F.transform(tags, name)), lambda k: F.struct(k, value(F.get(F.filter(tags, lambda t: name(t) == k), F.lit(0)))))).alias("tags"), F.split_part("record", F.lit("M  END"), F.lit(1)).alias("molblock"),
    )


def load_pdb(spark: SparkSession, path: str) -> DataFrame:
    """One row an ATOM or HETATM line: file, serial, name, residue, chain, residue_number, x, y, z, element, hetero."""
    line = F.col("value")
    part = lambda a, n: F.trim(F.substring(line, a, n))
    rows = spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value").where(F.substring("value", 1, 6).isin("ATOM  ", "HETATM"))
    guessed = F.regexp_replace(part(13, 4), r"[0-9]", "")
    return rows.select(
        "file", part(7, 5).try_cast("int").alias("serial"), part(13, 4).alias("name"), part(18, 3).alias("residue"), part(22, 1).alias("chain"), part(23, 4).try_cast("int").alias("residue_number"),
        part(31, 8).try_cast("double").alias("x"), part(39, 8).try_cast("double").alias("y"), part(47, 8).try_cast("double").alias("z"),
        F.initcap(F.when(part(77, 2) != "", part(77, 2)).otherwise(F.substring(guessed, 1, 1))).alias("element"), (F.substring("value", 1, 6) == "HETATM").alias("hetero"),
    )


def without_water(atoms: DataFrame) -> DataFrame:
    return atoms.where(~F.col("residue").isin(list(K.WATERS)))


def without_hetero(atoms: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The atoms of the twenty standard residues, and of those to keep."""
    return atoms.where(F.col("residue").isin([*K.RESIDUES, *keep]))


def prepare_protein(spark: SparkSession, path: str, waters: bool = True, hetero: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    atoms = load_pdb(spark, path)
    atoms = without_water(atoms) if waters else atoms
    return without_hetero(atoms, keep) if hetero else atoms


#: Atom types of the docking format by element (fixed values); others are written as carbon.
DOCKING_TYPES = {"C": "C", "N": "NA", "O": "OA", "S": "SA", "H": "HD", "F": "F", "CL": "Cl", "BR": "Br", "I": "I", "P": "P", "FE": "Fe", "ZN": "Zn", "MG": "Mg", "CA": "Ca", "MN": "Mn"}


def pdbqt_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines of a PDB file as lines for docking: columns 1 to 66, a charge of 0, the atom type; TER and END pass."""
    c = F.col(line)
    element = F.upper(F.when(F.trim(F.substring(c, 77, 2)) != "", F.trim(F.substring(c, 77, 2))).otherwise(F.substring(F.regexp_replace(F.trim(F.substring(c, 13, 4)), r"[0-9]", ""), 1, 1)))
    kind: Column = F.when(F.lit(False), F.lit(""))
    for k, v in DOCKING_TYPES.items():
        kind = kind.when(element == k, v)
    atom = F.substring(c, 1, 6).isin("ATOM  ", "HETATM")
    made = F.concat(F.rpad(F.substring(c, 1, 66), 66, " "), F.lit("    +0.000 "), F.rpad(kind.otherwise("C"), 2, " "))
    return lines.select(F.when(atom, made).otherwise(c).alias(line)).where(atom | c.startswith("TER") | c.startswith("END"))


def docking_poses(output: DataFrame, text: str = "stdout") -> DataFrame:
    """mode, affinity, rmsd_lower, rmsd_upper from the table a docking program prints; other lines are skipped."""
    line = F.explode(F.split(text, "\n")).alias("line")
    rest = [c for c in output.columns if c != text]
    rows = output.select(*rest, line).where(F.col("line").rlike(r"^\s*\d+\s+-?\d+(\.\d+)?\s+-?\d+(\.\d+)?\s+-?\d+(\.\d+)?\s*$"))
    p = F.split(F.trim("line"), r"\s+")
    return rows.select(*rest, p[0].cast("int").alias("mode"), p[1].cast("double").alias("affinity"), p[2].cast("double").alias("rmsd_lower"), p[3].cast("double").alias("rmsd_upper"))


def activities(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages of the activity service (JSON files with page_meta and activities): the eleven fields, numbers as doubles beside their text."""
    item = ", ".join(f"{f}: string" for f in (*K.ACTIVITY_FIELDS, "canonical_smiles"))
    pages = spark.read.schema(f"activities array<struct<{item}>>").json(path, multiLine=True)
    rows = pages.select(F.explode("activities").alias("a")).select("a.*").withColumn("source_index", F.monotonically_increasing_id())
    return rows.withColumnRenamed("canonical_smiles", "smiles").withColumn("pchembl_number", F.col("pchembl_value").try_cast("double")).withColumn("standard_number", F.col("standard_value").try_cast("double"))


def compounds(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages of the compound service: cid, smiles, name and weight."""
    schema = "PropertyTable struct<Properties: array<struct<CID: long, CanonicalSMILES: string, IUPACName: string, MolecularWeight: string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("PropertyTable.Properties").alias("p")).select("p.*")
    return rows.select(F.col("CID").alias("cid"), F.col("CanonicalSMILES").alias("smiles"), F.col("IUPACName").alias("name"), F.col("MolecularWeight").try_cast("double").alias("MolWt"))


# --- writers ----------------------------------------------------------------------------------


def flat(df: DataFrame) -> DataFrame:
    """Maps and arrays as text, for delimited files."""
    out = []
    for c, kind in df.dtypes:
        out.append(F.concat_ws("; ", F.col(c).cast("array<string>")).alias(c) if kind.startswith("array") else F.to_json(c).alias(c) if kind.startswith(("map", "struct")) else F.col(c))
    return df.select(*out)


def save(df: DataFrame, path: str, format: str = "auto") -> None:
    """The writer of the format; json must be named. Each is a folder of part files."""
    kind = detect(path) if format == "auto" else format
    if kind in ("csv", "tsv"):
        flat(df).write.mode("overwrite").csv(path, header=True, sep="," if kind == "csv" else "\t", escape='"')
    elif kind in ("smi", "smiles"):
        name = F.coalesce(*[F.col(c).cast("string") for c in ("source_id", "record_id", "id") if c in df.columns], F.lit(""))
        df.where("smiles IS NOT NULL").select(F.concat_ws("\t", "smiles", name).alias("value")).write.mode("overwrite").text(path)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif kind == "sdf":
        save_sdf(df, path)
    else:
        raise FormatError(f"no writer for {kind!r}")


def sdf_text(df: DataFrame) -> DataFrame:
    """Rows as SD records in column value; other columns become tags.

    A row without a molblock gets one with flat coordinates from its SMILES; rows whose SMILES cannot
    be read, too, have no structure and are left out.
    """
    from ..operators.molecules import molblock

    held = F.col("molblock") if "molblock" in df.columns else F.lit(None).cast("string")
    made = molblock(F.when(held.isNull(), F.col("smiles"))) if "smiles" in df.columns else F.lit(None).cast("string")
    rest = [c for c, kind in df.dtypes if c not in ("molblock", "atoms", "bonds", "tags", "source_index", "status") and not kind.startswith(("array", "map", "struct"))]
    tag = F.concat_ws("", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"> <{c}>\n"), F.col(c).cast("string"), F.lit("\n\n"))) for c in rest])
    rows = df.select(F.coalesce(held, made).alias("block"), tag.alias("tag"))
    return rows.where("block IS NOT NULL").select(F.concat(F.rtrim("block"), F.lit("M  END\n"), "tag", F.lit("$$$$")).alias("value"))


def save_sdf(df: DataFrame, path: str) -> None:
    sdf_text(df).write.mode("overwrite").text(path)


def export_results(df: DataFrame, path: str, columns: tuple[str, ...] = EXPORT_COLUMNS) -> None:
    """The columns present of those asked for, numbers rounded to 4, values quoted where they need it."""
    have = [c for c in columns if c in df.columns]
    kinds = dict(df.dtypes)
    df.select(*[F.round(c, 4).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in have]).write.mode("overwrite").csv(path, header=True, escape='"')


def save_report(spark: SparkSession, report: dict, path: str) -> None:
    """A report as one line of JSON; values that JSON lacks as text."""
    spark.createDataFrame([(json.dumps(report, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def stem(path: str) -> str:
    return posixpath.basename(path.rstrip("/")).split(".")[0]
