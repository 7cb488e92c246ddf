"""Column names of the data model, name templates and the known input schema."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import types as T

GROUP = "domain_id"
POSITION = "resid"
CATEGORY = "resname"
CONDITION = "condition"
KEYS = (GROUP, POSITION, CATEGORY)

STRUCTURE = "secondary_structure_encoded"
SURFACE = "core_exterior_encoded"
ACCESSIBILITY = "relative_accessibility"
SCALED_POSITION = "normalized_resid"
GROUP_SIZE = "protein_size"
EXTERNAL_PREDICTIONS = ("esm_rmsf", "voxel_rmsf")
TARGET_TEMPLATE = "rmsf_{temperature}"
REQUIRED_TEMPLATES = (GROUP, POSITION, CATEGORY, TARGET_TEMPLATE)

# Features describing the position itself, identical under every condition.
BASE_FEATURES = (STRUCTURE, SURFACE, ACCESSIBILITY, SCALED_POSITION)

_KNOWN_TYPES = {
    GROUP: T.StringType(),
    POSITION: T.IntegerType(),
    CATEGORY: T.StringType(),
    GROUP_SIZE: T.IntegerType(),
    SCALED_POSITION: T.DoubleType(),
    "core_exterior": T.StringType(),
    ACCESSIBILITY: T.DoubleType(),
    "dssp": T.StringType(),
    "phi": T.DoubleType(),
    "psi": T.DoubleType(),
    "resname_encoded": T.IntegerType(),
    SURFACE: T.IntegerType(),
    STRUCTURE: T.IntegerType(),
    "phi_norm": T.DoubleType(),
    "psi_norm": T.DoubleType(),
    "esm_rmsf": T.DoubleType(),
    "voxel_rmsf": T.DoubleType(),
}


def for_condition(template: str, condition: int | str) -> str:
    """Fill the ``{temperature}`` placeholder of a column or file name."""
    return template.replace("{temperature}", str(condition))


def target_for(condition: int | str) -> str:
    return for_condition(TARGET_TEMPLATE, condition)


def offset_name(feature: str, offset: int) -> str:
    return f"{feature}_offset_{offset}"


def offsets(k: int) -> list[int]:
    return [i for i in range(-k, k + 1) if i != 0]


def input_schema(conditions: Iterable[int | str], columns: Sequence[str] | None = None) -> T.StructType:
    """Explicit schema of a position table; ``columns`` fixes a file's column order."""
    known = dict(_KNOWN_TYPES)
    known.update({target_for(c): T.DoubleType() for c in conditions})
    names = list(columns) if columns is not None else list(known)
    return T.StructType([T.StructField(n, known.get(n, T.StringType())) for n in names])


def active_features(
    enabled: dict[str, bool], *, use_esm: bool = False, use_voxel: bool = False, external: bool = False
) -> list[str]:
    """Enabled feature names; the external-prediction mode switches its two columns on."""
    switches = dict(enabled)
    if external and use_esm:
        switches["esm_rmsf"] = True
    if external and use_voxel:
        switches["voxel_rmsf"] = True
    return [name for name, on in switches.items() if on]


def is_numeric_condition(condition: int | str) -> bool:
    return isinstance(condition, int) or str(condition).isdigit()


def numeric_conditions(conditions: Iterable[int | str]) -> list[int]:
    return sorted(int(c) for c in conditions if is_numeric_condition(c))
