"""Three-dimensional structures that other programs made: energies, geometry checks, superposition, shape scores.

A conformer is a row with mol, conf and coords (an array of structs x, y, z), and optionally energy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Conformers closer than this (angstroms, after superposition) count as one; bounds of bond lengths; nearest atoms (fixed values).
PRUNE_RMSD = 0.5
BOND_BOUNDS = (0.5, 5.0)
CLASH = 0.5
#: Van der Waals radii in angstroms (fixed values); others count as carbon.
RADII = {"H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "F": 1.47, "P": 1.80, "S": 1.80, "Cl": 1.75, "Br": 1.85, "I": 1.98}
#: Step of the grid on which volumes are counted, in angstroms.
GRID = 0.2


def with_strain(df: DataFrame, energy: str = "energy", mol: str = "mol") -> DataFrame:
    """``df`` with each conformer's energy above its molecule's lowest; missing and infinite energies give null."""
    e = F.when(F.abs(F.col(energy)) != float("inf"), F.nanvl(F.col(energy).cast("double"), F.lit(None).cast("double")))
    low = df.groupBy(mol).agg(F.min(e).alias("_low"))
    return df.join(low, mol).withColumn("strain", e - F.col("_low")).drop("_low")


def lowest(df: DataFrame, energy: str = "energy", mol: str = "mol", conf: str = "conf") -> DataFrame:
    """mol, best_conformer_id, lowest_energy and n_conformers; ties by conformer."""
    return df.groupBy(mol).agg(F.min_by(conf, F.struct(energy, conf)).alias("best_conformer_id"), F.min(energy).alias("lowest_energy"), F.count("*").alias("n_conformers"))


def geometry_checks(df: DataFrame, coords: str = "coords", bonds: str | None = None) -> DataFrame:
    """is_flat (no extent in z), n_clashes (pairs of atoms nearer than CLASH) and, with bonds (structs a, b from 1), n_odd_bonds."""
    p = F.col(coords)
    z = F.transform(p, lambda a: a["z"])
    far = lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]) + (a["z"] - b["z"]) * (a["z"] - b["z"]))

    def clashes(a: Column, i: Column) -> Column:
        return F.size(F.filter(F.slice(p, i + 2, F.size(p)), lambda b: far(a, b) < CLASH))

    out = df.withColumn("is_flat", F.coalesce(F.array_max(z) - F.array_min(z) < 1e-3, F.lit(True)))
    out = out.withColumn("n_clashes", F.aggregate(F.transform(p, clashes), F.lit(0), lambda s, x: s + x))
    if bonds:
        lo, hi = BOND_BOUNDS
        length = lambda b: far(F.get(p, b["a"] - 1), F.get(p, b["b"] - 1))
        out = out.withColumn("n_odd_bonds", F.size(F.filter(bonds, lambda b: ~F.coalesce(length(b).between(lo, hi), F.lit(False)))))
    return out


def volume_of(xyz: np.ndarray, elements: list[str], step: float = GRID) -> float:
    """Volume of the union of the atoms' spheres, by the grid points inside; 0 without atoms."""
    if not len(xyz):
        return 0.0
    radius = np.array([RADII.get(e, RADII["C"]) for e in elements])
    low = (xyz - radius[:, None]).min(axis=0)
    size = np.ceil(((xyz + radius[:, None]).max(axis=0) - low) / step).astype(int) + 1
    inside = np.zeros(size, bool)
    for p, r in zip(xyz, radius):  # only the grid points around an atom are looked at
        a = np.maximum(np.floor((p - r - low) / step).astype(int), 0)
        b = np.minimum(np.ceil((p + r - low) / step).astype(int) + 1, size)
        axes = [(np.arange(i, j) * step + low[k] - p[k]) ** 2 for k, (i, j) in enumerate(zip(a, b))]
        near = axes[0][:, None, None] + axes[1][None, :, None] + axes[2][None, None, :] <= r * r
        inside[a[0] : b[0], a[1] : b[1], a[2] : b[2]] |= near
    return float(inside.sum() * step**3)


def with_volume(df: DataFrame, coords: str = "coords", elements: str = "elements", out: str = "volume") -> DataFrame:
    """``df`` with the van der Waals volume of each conformer (arrays of structs x, y, z and of symbols); null where either is null."""

    @F.pandas_udf("double")
    def of(c: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else volume_of(np.array([[p["x"], p["y"], p["z"]] for p in x], float).reshape(-1, 3), list(y)) for x, y in zip(c, e)], dtype="float64")

    return df.withColumn(out, of(coords, elements))


def superposed_rmsd(a: np.ndarray, b: np.ndarray) -> float:
    """Smallest root mean square distance of two equally long point lists over all rotations and shifts (Kabsch)."""
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    u, s, vt = np.linalg.svd(a.T @ b)
    s[-1] *= np.sign(np.linalg.det(u @ vt)) or 1
    return float(np.sqrt(max(0.0, ((a**2).sum() + (b**2).sum() - 2 * s.sum()) / len(a))))


def pruned(df: DataFrame, threshold: float = PRUNE_RMSD, mol: str = "mol", conf: str = "conf", coords: str = "coords") -> DataFrame:
    """The conformers of each molecule, in order, that lie farther than the threshold from all kept before; a molecule's conformers fit one task."""

    def of(batch: pd.DataFrame) -> pd.DataFrame:
        kept: list[np.ndarray] = []
        take = []
        batch = batch.sort_values(conf)
        for c in batch[coords]:
            points = np.array([[p["x"], p["y"], p["z"]] for p in c], float)
            new = all(len(k) != len(points) or superposed_rmsd(k, points) >= threshold for k in kept)
            take.append(new)
            if new:
                kept.append(points)
        return batch[np.array(take, bool)]

    return df.groupBy(mol).applyInPandas(of, df.schema)


def rmsd_to(df: DataFrame, reference: list[tuple[float, float, float]], coords: str = "coords", out: str = "rmsd") -> DataFrame:
    """``df`` with the superposed distance to a reference of as many atoms; null for other sizes."""
    ref = np.array(reference, float)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            points = [np.array([[p["x"], p["y"], p["z"]] for p in c], float) if c is not None else None for c in b[coords]]
            b[out] = [superposed_rmsd(p, ref) if p is not None and len(p) == len(ref) else None for p in points]
            b[out] = b[out].astype("Float64")
            yield b

    return df.mapInPandas(of, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, {out} double")


def combo_score(shape: Column, pharmacophore: Column, weight: float = 0.5) -> Column:
    return weight * shape + (1 - weight) * F.least(pharmacophore, F.lit(1.0))


def screen_by_shape(df: DataFrame, metric: str = "shape_tanimoto", threshold: float = 0.5) -> DataFrame:
    """Rows whose shape score, computed elsewhere, reaches the threshold. Protrusion is a distance and is refused here."""
    if metric not in ("shape_tanimoto", "combo"):
        raise ValueError("metric must be shape_tanimoto or combo")
    return df.where(F.col(metric) >= threshold)
