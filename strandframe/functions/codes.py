"""Category codes and per-category properties, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- Fixed values -----------------------------------------------------------
# They must equal the published encodings for results to agree.

RESIDUE_CODES = {
    "UNK": 0, "ALA": 1, "ARG": 2, "ASN": 3, "ASP": 4, "CYS": 5, "GLN": 6, "GLU": 7,
    "GLY": 8, "HSD": 9, "HSE": 10, "HSP": 11, "HIS": 12, "ILE": 13, "LEU": 14, "LYS": 15,
    "MET": 16, "PHE": 17, "SER": 18, "THR": 19, "TRP": 20, "TYR": 21, "VAL": 22, "PRO": 23,
}
UNKNOWN_RESIDUE_CODE = 0

STRUCTURE_CODES = {"H": 0, "G": 0, "I": 0, "E": 1, "B": 1, "T": 2, "S": 2, "C": 2, "-": 2}
UNKNOWN_STRUCTURE_CODE = 2

# code: (hydropathy, volume, charge, group)
RESIDUE_PROPERTIES = {
    "ALA": (1.8, 88.6, 0.0, "hydrophobic"),
    "ARG": (-4.5, 173.4, 1.0, "positive"),
    "ASN": (-3.5, 111.1, 0.0, "polar"),
    "ASP": (-3.5, 111.1, -1.0, "negative"),
    "CYS": (2.5, 108.5, 0.0, "polar"),
    "GLN": (-3.5, 143.8, 0.0, "polar"),
    "GLU": (-3.5, 138.4, -1.0, "negative"),
    "GLY": (-0.4, 60.1, 0.0, "special"),
    "HIS": (-3.2, 153.2, 0.5, "positive"),
    "HSD": (-3.2, 153.2, 0.5, "positive"),
    "HSE": (-3.2, 153.2, 0.5, "positive"),
    "HSP": (-3.2, 153.2, 1.0, "positive"),
    "ILE": (4.5, 166.7, 0.0, "hydrophobic"),
    "LEU": (3.8, 166.7, 0.0, "hydrophobic"),
    "LYS": (-3.9, 168.6, 1.0, "positive"),
    "MET": (1.9, 162.9, 0.0, "hydrophobic"),
    "PHE": (2.8, 189.9, 0.0, "hydrophobic"),
    "PRO": (-1.6, 112.7, 0.0, "special"),
    "SER": (-0.8, 89.0, 0.0, "polar"),
    "THR": (-0.7, 116.1, 0.0, "polar"),
    "TRP": (-0.9, 227.8, 0.0, "hydrophobic"),
    "TYR": (-1.3, 193.6, 0.0, "polar"),
    "UNK": (0.0, 0.0, 0.0, "unknown"),
    "VAL": (4.2, 140.0, 0.0, "hydrophobic"),
}

ONE_LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E",
    "GLY": "G", "HIS": "H", "HSD": "H", "HSE": "H", "HSP": "H", "ILE": "I", "LEU": "L",
    "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W",
    "TYR": "Y", "UNK": "X", "VAL": "V",
}
UNKNOWN_LETTER = "X"

BOND_STRUCTURE_WEIGHTS = {
    "H": 1.0, "G": 0.8, "I": 0.9, "E": 0.9, "B": 0.7, "T": 0.4, "S": 0.3, "C": 0.1,
}
DEFAULT_BOND_STRUCTURE_WEIGHT = 0.1
BOND_RESIDUE_FACTORS = {
    "ASN": 1.2, "GLN": 1.2, "GLY": 0.9, "PRO": 0.7, "SER": 1.2, "THR": 1.2, "TYR": 1.1,
}
DEFAULT_BOND_RESIDUE_FACTOR = 1.0

STRUCTURE_LABELS = {0: "Helix", 1: "Sheet", 2: "Loop/Other"}
STRUCTURE_NAMES = {0: "helix", 1: "sheet", 2: "loop"}
SURFACE_LABELS = {0: "Core", 1: "Surface"}
POSITION_LABELS = ("N-term", "N-quarter", "Middle", "C-quarter", "C-term")
# -----------------------------------------------------------------------------


def lookup(column: Column, table: Mapping, default=None) -> Column:
    """Value of ``table`` at ``column``; ``default`` (or null) for unknown and null keys."""
    literal = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    found = F.try_element_at(literal, column)
    return found if default is None else F.coalesce(found, F.lit(default))


def residue_code(column: Column) -> Column:
    return lookup(column, RESIDUE_CODES, UNKNOWN_RESIDUE_CODE)


def structure_code(column: Column) -> Column:
    return lookup(column, STRUCTURE_CODES, UNKNOWN_STRUCTURE_CODE)


def surface_code(column: Column, core_names: tuple[str, ...] = ("core",)) -> Column:
    """0 for a core name in any letter case, 1 for everything else, null included."""
    return F.when(F.lower(column).isin(*core_names), 0).otherwise(1)


def angle_sine(column: Column) -> Column:
    return F.sin(F.radians(F.coalesce(column, F.lit(0.0))))


def label(column: Column, labels: Mapping) -> Column:
    """Display name of a code; an unknown code shows as its own text."""
    return F.coalesce(lookup(column, labels), column.cast("string"))


def is_special_backbone(column: Column) -> Column:
    """Glycine or proline, the two residues with unusual backbone freedom."""
    return F.coalesce(column.isin("GLY", "PRO"), F.lit(False))


def bond_stability(structure: Column, residue: Column) -> Column:
    weight = lookup(structure, BOND_STRUCTURE_WEIGHTS, DEFAULT_BOND_STRUCTURE_WEIGHT)
    factor = lookup(residue, BOND_RESIDUE_FACTORS, DEFAULT_BOND_RESIDUE_FACTOR)
    return F.least(F.lit(1.0), weight * factor)


def one_letter(column: Column) -> Column:
    return lookup(column, ONE_LETTER, UNKNOWN_LETTER)


def with_residue_properties(df: DataFrame, category: str) -> DataFrame:
    """Add hydropathy, volume, charge and property group of each residue name.

    The dimension holds 24 rows, so the broadcast has a fixed size.
    """
    rows = [(name, *values) for name, values in RESIDUE_PROPERTIES.items()]
    dimension = df.sparkSession.createDataFrame(
        rows, f"`{category}` string, hydropathy double, volume double, charge double, property_group string"
    )
    return df.join(F.broadcast(dimension), category, "left")
