"""Sources, projections, filters, windows, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.columns import offset_name
from strandframe.functions import codes, numeric
from strandframe.operators import clean, features, filters, reports, sequence, splits
from strandframe.operators.groups import errors_by_category
from strandframe.operators.metrics import add_errors
from strandframe.sources import checks, profile, readers, sinks

from .base import (
    CELLS, POSITIONS, RESULTS, ROW_KEYS, YEARS, cells, fix,
    positions, query, r, ra, results, scratch, table, with_,
)

TABLES = ("benchmark conversations customer documents embeddings events labels lineitem nation "
          "orders pages part region supplier").split()

# ---- sources -----------------------------------------------------------------


@query("s1_read_file", f"SELECT c_custkey, c_name, c_nationkey, {ra('c_acctbal', 'c_acctbal', 2)}, c_mktsegment FROM customer")
def _(spark, folder):
    return fix(readers.read_file(spark, f"{folder}/customer.parquet"), 2)


@query(
    "s1_read_text_formats",
    " UNION ALL ".join(
        f"SELECT '{f}' AS fmt, CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, {ra('s_acctbal', 's_acctbal', 2)} FROM supplier"
        for f in ("csv", "tsv", "json")
    ),
)
def _(spark, folder):
    source = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    out = scratch(spark)
    source.write.option("header", True).csv(f"{out}/s.csv")
    source.write.option("header", True).option("sep", "\t").csv(f"{out}/s.tsv")
    # one JSON value per line is read line by line, so the file stays splittable
    source.write.json(f"{out}/s.json")
    parts = []
    for fmt in ("csv", "tsv", "json"):
        path = f"{out}/s.{fmt}"
        read = readers.read_file(spark, path, schema=source.schema)
        parts.append(read.select(F.lit(fmt).alias("fmt"), "s_suppkey", "s_name", "s_acctbal"))
    return fix(readers.union_tables(parts), 2)


@query("s2_list_files", " UNION ALL ".join(f"SELECT '{t}.parquet' AS file_name, count(*) AS n FROM {t}" for t in TABLES))
def _(spark, folder):
    """Matching files, each with its row count."""
    # one scan of all files; a column that none of them has costs no reading
    rows = spark.read.schema("__none int").option("pathGlobFilter", "*.parquet").parquet(folder)
    counts = rows.select(F.col("_metadata.file_name").alias("file_name")).groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))
    listed = readers.list_files(spark, folder, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file_name"))
    return listed.join(counts, "file_name", "left").select("file_name", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


@query(
    "s3_condition_of_file",
    """
    SELECT condition, TRY_CAST(condition AS INTEGER) AS condition_k, count(*) AS n FROM (
      SELECT CASE WHEN o_orderstatus = 'P' THEN 'average' WHEN o_orderstatus = 'F'
                  THEN CAST(year(o_orderdate) AS VARCHAR) END AS condition FROM orders)
    GROUP BY 1, 2
    """,
)
def _(spark, folder):
    middle = F.when(F.col("o_orderstatus") == "P", "average").when(
        F.col("o_orderstatus") == "F", F.year("o_orderdate").cast("string")
    ).otherwise("other")
    names = table(spark, folder, "orders").select(
        F.concat(F.lit("temperature_"), middle, F.lit("_train.csv")).alias("file_name")
    )
    condition, number = readers.condition_of_file(F.col("file_name"))
    return (
        names.select(condition.alias("condition"), number.alias("condition_k"))
        .groupBy("condition", "condition_k")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "s4_merge_files",
    "SELECT n_nationkey, n_name, n_regionkey, NULL::INTEGER AS r_regionkey, NULL::VARCHAR AS r_name FROM nation "
    "UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region",
)
def _(spark, folder):
    return readers.merge_files(
        spark, [f"{folder}/nation.parquet", f"{folder}/not_there.parquet", f"{folder}/region.parquet"]
    )


@query("s4_part_files", "SELECT o_orderkey, o_custkey, o_totalprice, NULL::BIGINT AS s_suppkey FROM orders UNION ALL SELECT NULL, NULL, NULL, s_suppkey FROM supplier")
def _(spark, folder):
    """Two tables written as many part files, merged by the names of the files: two scans."""
    path = scratch(spark)
    table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice").repartition(60).write.parquet(f"{path}/orders")
    table(spark, folder, "supplier").select("s_suppkey").repartition(40).write.parquet(f"{path}/supplier")
    parts = [f.path for t in ("orders", "supplier") for f in readers.list_files(spark, f"{path}/{t}", "*.parquet").select("path").collect()]
    return readers.merge_files(spark, parts)


@query("s4_left_out", "SELECT 'not_there.parquet' AS name, n AS merged_rows FROM (SELECT count(*) AS n FROM nation)")
def _(spark, folder):
    """What a merge could not read, beside the rows it did read."""
    failed = []
    merged = readers.merge_files(spark, [f"{folder}/nation.parquet", f"{folder}/not_there.parquet"], failed=failed)
    names = readers.failure_table(spark, failed).select(F.element_at(F.split("name", "/"), -1).alias("name"))
    return names.join(merged.agg(F.count(F.lit(1)).alias("merged_rows")))


@query(
    "s5_required_columns",
    with_(POSITIONS, "SELECT resname, count(*) AS n FROM positions GROUP BY 1"),
)
def _(spark, folder):
    checked = checks.require_columns(positions(spark, folder), 320)
    return checked.groupBy("resname").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s5_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS \"count\" FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(spark, folder):
    return checks.duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


def _stored_cells(spark, folder):
    return sinks.write_results(cells(spark, folder), f"{scratch(spark)}/cells")


def _condition_folders(spark, folder, years):
    """A folder of part files per condition, named by the rule of the files."""
    out, rows = scratch(spark), cells(spark, folder)
    for year in years:
        rows.filter(F.col("condition") == str(year)).select(
            "domain_id", "resid", "resname", F.col("actual").alias(f"rmsf_{year}"), "alpha_predicted"
        ).write.option("header", True).csv(f"{out}/temperature_{year}_train.csv")
    return out


@query(
    "s6_one_condition",
    with_(CELLS, f"SELECT domain_id, resid, resname, condition, {ra('actual', 'actual')} FROM cells WHERE condition = '1998'"),
)
def _(spark, folder):
    read = readers.read_condition(spark, _condition_folders(spark, folder, [1998]), 1998, [1998])
    kinds = {f.name: f.dataType for f in cells(spark, folder).schema.fields}
    return fix(read.select(*[F.col(c).cast(kinds[c]) for c in ("domain_id", "resid", "resname")], "condition", F.col("rmsf_1998").alias("actual")))


@query(
    "s7_all_conditions",
    with_(CELLS, f"SELECT domain_id, resid, resname, condition, {ra('actual', 'actual')}, {ra('alpha_predicted', 'alpha_predicted')} FROM cells"),
)
def _(spark, folder):
    read = readers.read_all_conditions(spark, _condition_folders(spark, folder, YEARS), YEARS)
    kinds = {f.name: f.dataType for f in cells(spark, folder).schema.fields}
    return fix(read.select(*[F.col(c).cast(kinds[c]) for c in ("domain_id", "resid", "resname")], "condition", F.col("target").alias("actual"), "alpha_predicted"))


_PROFILED = ["domain_id", "resid", "resname", "dssp", "core_exterior", "relative_accessibility", "esm_rmsf", "rmsf_320"]
_TYPES = dict(zip(_PROFILED, ["bigint", "bigint", "string", "string", "string", "double", "double", "double"], strict=True))


@query(
    "s8_column_profile",
    with_(
        POSITIONS,
        " UNION ALL ".join(
            f"SELECT count(*) AS num_rows, '{c}' AS \"column\", '{_TYPES[c]}' AS \"type\", count(*) - count({c}) AS null_count, "
            f"{ra(f'(count(*) - count({c})) * 100.0::DOUBLE / count(*)', 'null_percentage')}, "
            f"{str(c.startswith('rmsf_')).lower()} AS is_target, {str(c == 'esm_rmsf').lower()} AS is_external_prediction FROM positions"
            for c in _PROFILED
        ),
    ),
)
def _(spark, folder):
    return fix(profile.column_profile(positions(spark, folder).select(*_PROFILED)))


@query(
    "s8_group_profile",
    f"SELECT count(*) AS num_groups, min(n) AS min_size, max(n) AS max_size, {ra('avg(n)', 'mean_size')}, "
    f"{ra('quantile_cont(n, 0.5)', 'median_size')} FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)",
)
def _(spark, folder):
    return fix(profile.group_profile(positions(spark, folder)))


@query("s8_example_groups", "SELECT DISTINCT user_id AS domain_id FROM events ORDER BY 1 LIMIT 5")
def _(spark, folder):
    return profile.example_groups(positions(spark, folder))


@query(
    "s9_write_csv",
    with_(RESULTS, f"SELECT domain_id, count(*) AS num_residues, {ra('avg(actual)', 'mean_actual')} FROM results GROUP BY 1"),
)
def _(spark, folder):
    summary = results(spark, folder).groupBy("domain_id").agg(
        F.count(F.lit(1)).alias("num_residues"), F.avg("actual").alias("mean_actual")
    )
    path = sinks.write_csv(summary, f"{scratch(spark)}/domain_metrics.csv")
    return fix(readers.read_file(spark, path, "csv", summary.schema))


@query(
    "s10_read_results",
    with_(CELLS, f"SELECT condition, count(*) AS n, {ra('avg(alpha_predicted - actual)', 'mean_error')} FROM cells "
                 "WHERE condition IN ('1996', '2000') GROUP BY 1"),
)
def _(spark, folder):
    read = sinks.read_results(spark, _stored_cells(spark, folder), [1996, 2000])
    error = F.avg(F.col("alpha_predicted") - F.col("actual")).alias("mean_error")
    return fix(read.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), error))


# ---- projections -------------------------------------------------------------

@query(
    "p1_fill_constants",
    with_(POSITIONS, "SELECT resid, COALESCE(dssp, 'C') AS dssp, " + ra("COALESCE(relative_accessibility, 0.5)", "relative_accessibility")
          + ", COALESCE(core_exterior, 'core') AS core_exterior, " + ra("COALESCE(phi, 0)", "phi") + ", " + ra("COALESCE(psi, 0)", "psi") + " FROM positions"),
)
def _(spark, folder):
    filled = clean.fill_constants(positions(spark, folder))
    return fix(filled.select("resid", "dssp", "relative_accessibility", "core_exterior", "phi", "psi"))


@query(
    "p2_fill_with_means",
    with_(POSITIONS, "SELECT resid, " + ra("COALESCE(esm_rmsf, (SELECT avg(esm_rmsf) FROM positions))", "esm_rmsf") + ", "
          + ra("COALESCE(voxel_rmsf, (SELECT avg(voxel_rmsf) FROM positions))", "voxel_rmsf") + " FROM positions"),
)
def _(spark, folder):
    return fix(clean.fill_with_means(positions(spark, folder)).select("resid", "esm_rmsf", "voxel_rmsf"))


@query("p3_numeric_coercion", with_(POSITIONS, "SELECT resid, TRY_CAST(measured AS DOUBLE) AS measured FROM positions"))
def _(spark, folder):
    return positions(spark, folder).select("resid", numeric.to_number("measured").alias("measured"))


@query("p4_target", with_(POSITIONS, "SELECT resid, " + ra("COALESCE(rmsf_320, 0)", "rmsf_320") + " FROM positions"))
def _(spark, folder):
    return fix(clean.prepare_target(positions(spark, folder), "rmsf_320").select("resid", "rmsf_320"))


_CODE_SQL = {
    "resname_encoded": "CASE resname WHEN 'GLY' THEN 8 WHEN 'PRO' THEN 23 WHEN 'ALA' THEN 1 WHEN 'HSD' THEN 9 ELSE 0 END",
    "core_exterior_encoded": "CASE WHEN lower(core_exterior) = 'core' THEN 0 ELSE 1 END",
    "secondary_structure_encoded": "CASE WHEN dssp IN ('H', 'G', 'I') THEN 0 WHEN dssp IN ('E', 'B') THEN 1 ELSE 2 END",
    "phi_norm": r("sin(radians(COALESCE(phi, 0)))", 6),
    "psi_norm": r("sin(radians(COALESCE(psi, 0)))", 6),
}
for _name, _columns in {
    "p5_residue_code": ["resname_encoded"],
    "p6_surface_code": ["core_exterior_encoded"],
    "p7_structure_code": ["secondary_structure_encoded"],
    "p8_angle_sine": ["phi_norm", "psi_norm"],
}.items():
    def _run(spark, folder, columns=tuple(_columns)):
        return fix(features.add_codes(positions(spark, folder)).select("resid", *columns), 6)

    query(_name, with_(POSITIONS, "SELECT resid, " + ", ".join(f"{_CODE_SQL[c]} AS {c}" for c in _columns) + " FROM positions"))(_run)


@query(
    "p9_scaled_position",
    with_(POSITIONS, "SELECT domain_id, resid, " + ra(
        "CAST(resid - min(resid) OVER g AS DOUBLE) / CASE WHEN max(resid) OVER g = min(resid) OVER g THEN 1 "
        "ELSE max(resid) OVER g - min(resid) OVER g END", "normalized_resid", 6)
          + " FROM positions WINDOW g AS (PARTITION BY domain_id)"),
)
def _(spark, folder):
    return fix(features.add_group_columns(positions(spark, folder)).select("domain_id", "resid", "normalized_resid"), 6)


@query(
    "p10_group_size",
    with_(POSITIONS, "SELECT domain_id, resid, count(resid) OVER (PARTITION BY domain_id) AS protein_size FROM positions"),
)
def _(spark, folder):
    return features.add_group_columns(positions(spark, folder)).select("domain_id", "resid", "protein_size")


@query(
    "p11_model_inputs",
    with_(POSITIONS, "SELECT resid, " + ", ".join(
        ra(e, f"x{i}") for i, e in enumerate([
            "CAST(k AS DOUBLE)", "COALESCE(TRY_CAST(measured AS DOUBLE), 0)", "COALESCE(rmsf_320, 0)",
            "CAST(lag(k, 1, 0) OVER w AS DOUBLE)", "CAST(lead(k, 1, 0) OVER w AS DOUBLE)"]))
          + ", " + ra("COALESCE(rmsf_320, 0)", "label")
          + " FROM positions WINDOW w AS (PARTITION BY domain_id ORDER BY resid)"),
)
def _(spark, folder):
    from pyspark.ml.functions import vector_to_array

    ready = clean.prepare_target(positions(spark, folder), "rmsf_320")
    ready = features.neighbor_columns(ready, ["k"], 1)
    names = features.feature_names(ready, ["rmsf_320", "k", "measured"], 1)
    vectors = features.assemble(ready, names, "rmsf_320").withColumn("x", vector_to_array("features"))
    return fix(vectors.select("resid", *[F.col("x")[i].alias(f"x{i}") for i in range(len(names))], "label"))


@query(
    "p12_condition_columns",
    with_(POSITIONS, "SELECT domain_id, " + ra("avg(rmsf_320)", "mean_target") + ", " + ra("avg(esm_rmsf)", "mean_esm")
          + " FROM positions GROUP BY 1"),
)
def _(spark, folder):
    from strandframe.columns import active_features, target_for

    switched = active_features({"esm_rmsf": False, "voxel_rmsf": False}, use_esm=True, external=True)
    target = target_for(320)
    return fix(positions(spark, folder).groupBy("domain_id").agg(
        F.avg(target).alias("mean_target"), *[F.avg(c).alias("mean_esm") for c in switched]))


_ROW_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    "p13_errors",
    with_(RESULTS, f"SELECT {_ROW_SQL}, {ra('alpha_error', 'alpha_error', 2)}, {ra('alpha_abs_error', 'alpha_abs_error', 2)} FROM results"),
)
def _(spark, folder):
    scored = add_errors(results(spark, folder).drop("alpha_error", "alpha_abs_error"), ["alpha"], "actual")
    return fix(scored.select(*ROW_KEYS, "alpha_error", "alpha_abs_error"), 2)


@query(
    "p14_z_score",
    with_(RESULTS, f"SELECT {_ROW_SQL}, {ra('abs(beta_predicted - actual) / NULLIF(beta_uncertainty, 0)', 'z', 6)} FROM results"),
)
def _(spark, folder):
    z = numeric.z_score(F.col("beta_predicted"), F.col("actual"), F.col("beta_uncertainty")).alias("z")
    return fix(results(spark, folder).select(*ROW_KEYS, z), 6)


def _case(column: str, table_of: dict, default: str = "NULL") -> str:
    quoted = {k: f"'{v}'" if isinstance(v, str) else v for k, v in table_of.items()}
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in quoted.items()) + f" ELSE {default} END"


_USED = {n: codes.RESIDUE_PROPERTIES[n] for n in ("GLY", "PRO", "ALA", "HSD")}


@query(
    "p15_residue_properties",
    with_(POSITIONS, "SELECT resid, resname, " + ", ".join(
        f"CAST({_case('resname', {k: v[i] for k, v in _USED.items()})} AS DOUBLE) AS {n}"
        for i, n in enumerate(["hydropathy", "volume", "charge"]))
          + f", {_case('resname', {k: v[3] for k, v in _USED.items()})} AS property_group FROM positions"),
)
def _(spark, folder):
    return codes.with_residue_properties(positions(spark, folder).select("resid", "resname"), "resname").select(
        "resid", "resname", "hydropathy", "volume", "charge", "property_group")


@query("p16_special_backbone", with_(POSITIONS, "SELECT resid, resname IN ('GLY', 'PRO') AS special FROM positions"))
def _(spark, folder):
    return positions(spark, folder).select("resid", codes.is_special_backbone(F.col("resname")).alias("special"))


@query(
    "p17_bond_stability",
    with_(POSITIONS, "SELECT resid, " + ra(
        f"least(1.0::DOUBLE, CAST({_case('dssp', codes.BOND_STRUCTURE_WEIGHTS, '0.1')} AS DOUBLE) * "
        f"CAST({_case('resname', codes.BOND_RESIDUE_FACTORS, '1.0')} AS DOUBLE))", "stability", 6) + " FROM positions"),
)
def _(spark, folder):
    return fix(positions(spark, folder).select(
        "resid", codes.bond_stability(F.col("dssp"), F.col("resname")).alias("stability")), 6)


def _entropy_sql(size: int) -> str:
    half = size // 2
    letters = [
        "letter" if i == 0 else f"{'lead' if i > 0 else 'lag'}(letter, {abs(i)}, 'X') OVER w" for i in range(-half, half + 1)
    ]
    names = [f"s{i}" for i in range(len(letters))]
    counts = [" + ".join(f"CAST({a} = {b} AS INTEGER)" for b in names) for a in names]
    total = " + ".join(f"(-1.0::DOUBLE / {size}) * log2(({c}) / {size}.0::DOUBLE)" for c in counts)
    return with_(
        POSITIONS + ", lettered AS (SELECT domain_id, resid, "
        + _case("resname", {"GLY": "G", "PRO": "P", "ALA": "A", "HSD": "H"}, "'X'") + " AS letter FROM positions), around AS (SELECT domain_id, resid, "
        + ", ".join(f"{x} AS {n}" for x, n in zip(letters, names, strict=True))
        + " FROM lettered WINDOW w AS (PARTITION BY domain_id ORDER BY resid))",
        f"SELECT domain_id, resid, {ra(f'({total}) / log2({size})', 'complexity', 6)} FROM around",
    )


for _size in (5, 4):
    def _complexity(spark, folder, size=_size):
        return fix(sequence.sequence_complexity(positions(spark, folder), size).select("domain_id", "resid", "complexity"), 6)

    query(f"p18_sequence_complexity_{_size}", _entropy_sql(_size))(_complexity)

# ---- filters -----------------------------------------------------------------

_BUSY_SQL = "SELECT domain_id FROM positions WHERE resname = 'PRO' AND rmsf_320 > 150"


def _busy(spark, folder):
    """Groups with a purchase-like outlier: a data-driven group list."""
    return positions(spark, folder).filter((F.col("resname") == "PRO") & (F.col("rmsf_320") > 150)).select("domain_id")


@query("f1_include_groups", with_(POSITIONS, f"SELECT domain_id, resid FROM positions WHERE domain_id IN ({_BUSY_SQL})"))
def _(spark, folder):
    return filters.include_groups(positions(spark, folder), _busy(spark, folder)).select("domain_id", "resid")


@query("f2_exclude_groups", with_(POSITIONS, f"SELECT domain_id, resid FROM positions WHERE domain_id NOT IN ({_BUSY_SQL})"))
def _(spark, folder):
    return filters.exclude_groups(positions(spark, folder), _busy(spark, folder)).select("domain_id", "resid")


@query(
    "f3_group_size",
    with_(POSITIONS, f"SELECT domain_id, resid FROM (SELECT *, count(*) OVER (PARTITION BY domain_id) AS n FROM positions "
                     f"WHERE domain_id NOT IN ({_BUSY_SQL})) WHERE n BETWEEN 60 AND 75"),
)
def _(spark, folder):
    kept = filters.filter_groups(positions(spark, folder), exclude=_busy(spark, folder), minimum=60, maximum=75)
    return kept.select("domain_id", "resid")


@query("f4_complete_pairs", with_(POSITIONS, "SELECT resid FROM positions WHERE esm_rmsf IS NOT NULL AND rmsf_320 IS NOT NULL"))
def _(spark, folder):
    return filters.complete_pairs(positions(spark, folder), "esm_rmsf", "rmsf_320").select("resid")


@query("f5_positive_pairs", with_(POSITIONS, "SELECT resid FROM positions WHERE phi > 0 AND psi > 0"))
def _(spark, folder):
    return filters.positive_pairs(positions(spark, folder), "phi", "psi").select("resid")


@query(
    "f6_around_position",
    with_(POSITIONS, "SELECT domain_id, resid FROM positions JOIN (SELECT domain_id, arg_max(resid, value) AS anchor FROM raw_positions "
                     "GROUP BY 1) USING (domain_id) WHERE resid BETWEEN greatest(0, anchor - 500) AND anchor + 500"),
)
def _(spark, folder):
    rows = positions(spark, folder)
    anchors = table(spark, folder, "events").groupBy(F.col("user_id").alias("domain_id")).agg(
        F.max_by("event_id", "value").alias("anchor"))
    return rows.join(anchors, "domain_id").filter(filters.around_position(F.col("anchor"), 500)).select("domain_id", "resid")


# ---- joins -------------------------------------------------------------------


@query(
    "j2_members",
    with_(RESULTS, f"SELECT {_ROW_SQL} FROM results WHERE domain_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"),
)
def _(spark, folder):
    chosen = table(spark, folder, "supplier").filter(F.col("s_acctbal") > 0).select(F.col("s_suppkey").alias("domain_id"))
    return splits.members(results(spark, folder), chosen).select(*ROW_KEYS)


@query(
    "j3_labels",
    with_(RESULTS, "SELECT CASE p_size % 5 WHEN 0 THEN 'Helix' WHEN 1 THEN 'Sheet' WHEN 2 THEN 'Loop/Other' ELSE CAST(p_size % 5 AS VARCHAR) END AS name, "
                   "count(*) AS n FROM results GROUP BY 1"),
)
def _(spark, folder):
    named = codes.label(F.col("p_size") % 5, codes.STRUCTURE_LABELS).alias("name")
    return results(spark, folder).groupBy(named).agg(F.count(F.lit(1)).alias("n"))


# ---- windows -----------------------------------------------------------------

_W_FEATURES = {"rmsf_320": "NULL", "resname": "NULL", "k": "0"}
_OFFSETS = [-2, -1, 1, 2]


def _shift_sql(feature: str, i: int) -> str:
    default = "" if _W_FEATURES[feature] == "NULL" else f", {_W_FEATURES[feature]}"
    return f"{'lead' if i > 0 else 'lag'}({feature}, {abs(i)}{default}) OVER w"


def _neighbors_sql(filled: bool) -> str:
    columns = []
    for f in _W_FEATURES:
        for i in _OFFSETS:
            e = _shift_sql(f, i)
            if filled:
                e = f"COALESCE({e}, (SELECT v FROM fill_{f}))"
            columns.append(ra(e, f"{f}_offset_{i}") if f == "rmsf_320" else f'{e} AS "{f}_offset_{i}"')
    fills = (
        ", fill_rmsf_320 AS (SELECT quantile_cont(rmsf_320, 0.5) AS v FROM positions), "
        + ", ".join(
            f"fill_{f} AS (SELECT {f} AS v FROM positions WHERE {f} IS NOT NULL GROUP BY {f} ORDER BY count(*) DESC, {f} LIMIT 1)"
            for f in ("resname", "k")
        )
        if filled
        else ""
    )
    return with_(
        POSITIONS + fills,
        "SELECT domain_id, resid, " + ", ".join(columns) + " FROM positions WINDOW w AS (PARTITION BY domain_id ORDER BY resid)",
    )


def _offset_columns():
    return [f"{f}_offset_{i}" for f in _W_FEATURES for i in _OFFSETS]


@query("w1_neighbor_columns", _neighbors_sql(False))
def _(spark, folder):
    around = features.neighbor_columns(positions(spark, folder), list(_W_FEATURES), 2)
    return fix(around.select("domain_id", "resid", *_offset_columns()))


@query("w1_neighbor_columns_in_blocks", _neighbors_sql(False))
def _(spark, folder):
    """The plan for groups too large for one task, forced by a low limit."""
    around = features.neighbor_columns(positions(spark, folder), list(_W_FEATURES), 2, max_group_rows=65, block_rows=16)
    return fix(around.select("domain_id", "resid", *_offset_columns()))


@query(
    "w1_null_positions_in_blocks",
    "SELECT l_suppkey AS domain_id, CASE WHEN l_linenumber <> 3 THEN l_linenumber END AS resid, l_orderkey, l_partkey, "
    "lag(l_partkey, 1, 0) OVER g AS before, lead(l_partkey, 1, 0) OVER g AS after FROM lineitem "
    "WINDOW g AS (PARTITION BY l_suppkey ORDER BY CASE WHEN l_linenumber <> 3 THEN l_linenumber END NULLS FIRST, l_orderkey, l_linenumber, l_partkey)",
)
def _(spark, folder):
    """Rows without a position stay, and come first, in the plan for large groups too."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("domain_id"), F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).alias("resid"),
        "l_orderkey", "l_linenumber", "l_partkey")
    order = ("resid", "l_orderkey", "l_linenumber", "l_partkey")
    around = features.neighbor_columns(rows, ["l_partkey"], 1, order=order, max_group_rows=50, block_rows=16)
    return around.select("domain_id", "resid", "l_orderkey", "l_partkey",
                         F.col(offset_name("l_partkey", -1)).alias("before"), F.col(offset_name("l_partkey", 1)).alias("after"))


@query("w2_filled_neighbors", _neighbors_sql(True))
def _(spark, folder):
    around = features.add_neighbors(positions(spark, folder), list(_W_FEATURES), 2)
    return fix(around.select("domain_id", "resid", *_offset_columns()))


@query(
    "w3_group_statistics",
    with_(POSITIONS, "SELECT domain_id, resid, " + ra("min(rmsf_320) OVER g", "low") + ", " + ra("max(rmsf_320) OVER g", "high")
          + ", count(rmsf_320) OVER g AS known, count(*) OVER g AS size FROM positions WINDOW g AS (PARTITION BY domain_id)"),
)
def _(spark, folder):
    stats = {"low": F.min("rmsf_320"), "high": F.max("rmsf_320"), "known": F.count("rmsf_320"), "size": F.count(F.lit(1))}
    return fix(features.with_group_statistics(positions(spark, folder), stats).select("domain_id", "resid", *stats))


@query(
    "w4_positional_profile",
    with_(RESULTS, "SELECT domain_id, resid, resname, " + ra("actual", "actual", 2) + ", " + ra("alpha_predicted", "alpha_predicted", 2)
          + ", secondary_structure_encoded, core_exterior_encoded FROM results WHERE domain_id = "
            "(SELECT domain_id FROM results GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"),
)
def _(spark, folder):
    return fix(reports.group_profile_rows(results(spark, folder), "actual", ["alpha"]), 2)


_FLAGSHIP_SQL = with_(
    POSITIONS + ", target AS (SELECT domain_id, resid, resname, COALESCE(rmsf_320, 0) AS y FROM positions), "
    "fill AS (SELECT quantile_cont(y, 0.5) AS v FROM target), "
    "around AS (SELECT *, COALESCE(lag(y, 2) OVER w, (SELECT v FROM fill)) AS a, COALESCE(lag(y, 1) OVER w, (SELECT v FROM fill)) AS b, "
    "COALESCE(lead(y, 1) OVER w, (SELECT v FROM fill)) AS c, COALESCE(lead(y, 2) OVER w, (SELECT v FROM fill)) AS d "
    "FROM target WINDOW w AS (PARTITION BY domain_id ORDER BY resid)), "
    "errors AS (SELECT resname, abs((a + b + c + d) / 4 - y) AS e FROM around)",
    "SELECT resname, count(*) AS \"count\", " + ra("avg(e)", "neighbors_mean_error") + ", " + ra("quantile_cont(e, 0.5)", "neighbors_median_error")
    + ", " + ra("stddev_samp(e)", "neighbors_std_error") + " FROM errors GROUP BY 1",
)


@query("flagship_neighbor_errors", _FLAGSHIP_SQL)
def flagship(spark, folder):
    """Clean, encode, group columns, neighbours, then errors of the neighbour mean by category."""
    from strandframe.plans.preparation import process_features

    prepared = process_features(positions(spark, folder), "rmsf_320", ["rmsf_320"], 2)
    mean = sum((F.col(f"rmsf_320_offset_{i}") for i in _OFFSETS[1:]), F.col("rmsf_320_offset_-2")) / 4
    scored = add_errors(prepared.withColumn("neighbors_predicted", mean), ["neighbors"], "rmsf_320")
    return fix(errors_by_category(scored, ["neighbors"]))


# ---- splits ------------------------------------------------------------------


def _hash_sql(text: str) -> str:
    return f"CAST('0x' || substring(md5({text}), 1, 13) AS BIGINT)"


_GROUP_HASH = _hash_sql("CAST(user_id AS VARCHAR) || '-42'")
_LINE_HASH = _hash_sql("CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-42'")
_TWO52 = "4503599627370496.0::DOUBLE"


def _named_sql(place: str, test: str, validation: str) -> str:
    return f"CASE WHEN {place} < {test} THEN 'test' WHEN {place} < {test} + {validation} THEN 'validation' ELSE 'train' END"


def _exact_split_sql(keys: str, source: str, hashed: str, order: str) -> str:
    return (
        f"WITH keyed AS (SELECT *, {hashed} AS h FROM ({source})), placed AS (SELECT *, row_number() OVER (ORDER BY h, {order}) - 1 AS place, "
        "count(*) OVER () AS n FROM keyed), sized AS (SELECT *, ceil(n * 0.2::DOUBLE) AS t FROM placed), "
        "named AS (SELECT *, " + _named_sql("place", "t", "ceil((n - t) * (0.15::DOUBLE / (1 - 0.2::DOUBLE)))") + f" AS split FROM sized) SELECT {keys}"
    )


@query(
    "sp1_split_groups",
    _exact_split_sql("e.event_id AS resid, split FROM events e JOIN named USING (user_id)", "SELECT DISTINCT user_id FROM events", _GROUP_HASH, "user_id"),
)
def _(spark, folder):
    return splits.split_groups(positions(spark, folder)).select("resid", "split")


@query(
    "sp1_split_groups_by_threshold",
    f"SELECT event_id AS resid, {_named_sql(f'{_GROUP_HASH} / {_TWO52}', '0.2::DOUBLE', '0.15::DOUBLE')} AS split FROM events",
)
def _(spark, folder):
    return splits.split_groups(positions(spark, folder), exact=False).select("resid", "split")


@query(
    "sp2_split_rows",
    f"SELECT {_ROW_SQL}, {_named_sql(f'{_LINE_HASH} / {_TWO52}', '0.2::DOUBLE', '0.15::DOUBLE')} AS split FROM lineitem",
)
def _(spark, folder):
    return splits.split_rows(table(spark, folder, "lineitem"), ROW_KEYS).select(*ROW_KEYS, "split")


@query(
    "sp2_split_rows_exact",
    _exact_split_sql(f"{_ROW_SQL}, split FROM named", "SELECT * FROM lineitem", _LINE_HASH, _ROW_SQL),
)
def _(spark, folder):
    return splits.split_rows(table(spark, folder, "lineitem"), ROW_KEYS, exact=True).select(*ROW_KEYS, "split")


@query("sp3_group_folds", f"SELECT event_id AS resid, CAST({_GROUP_HASH} % 5 AS INTEGER) AS fold FROM events")
def _(spark, folder):
    return splits.hash_folds(positions(spark, folder), 5).select("resid", "fold")


@query(
    "sp3_even_group_folds",
    f"WITH placed AS (SELECT user_id, CAST((row_number() OVER (ORDER BY {_GROUP_HASH}, user_id) - 1) % 5 AS INTEGER) AS fold "
    "FROM (SELECT DISTINCT user_id FROM events)) SELECT event_id AS resid, fold FROM events JOIN placed USING (user_id)",
)
def _(spark, folder):
    return splits.even_folds(positions(spark, folder), 5).select("resid", "fold")


@query(
    "sp3_range_group_folds",
    f"WITH placed AS (SELECT user_id, row_number() OVER (ORDER BY {_GROUP_HASH}, user_id) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)) "
    "SELECT event_id AS resid, CAST((place * 5 - 1) // n AS INTEGER) AS fold FROM events JOIN placed USING (user_id)",
)
def _(spark, folder):
    return splits.range_folds(positions(spark, folder), 5).select("resid", "fold")


@query("sp4_row_folds", f"SELECT {_ROW_SQL}, CAST({_LINE_HASH} % 5 AS INTEGER) AS fold FROM lineitem")
def _(spark, folder):
    return splits.hash_folds(table(spark, folder, "lineitem"), 5, ROW_KEYS).select(*ROW_KEYS, "fold")


@query("sp5_sample_rows", f"SELECT {_ROW_SQL} FROM lineitem ORDER BY {_LINE_HASH}, {_ROW_SQL} LIMIT 5000")
def _(spark, folder):
    return splits.sample_rows(table(spark, folder, "lineitem"), 5000, ROW_KEYS).select(*ROW_KEYS)


@query("sp6_chunks", "SELECT count(*) AS n, true AS within_limit FROM orders")
def _(spark, folder):
    path = sinks.write_chunks(table(spark, folder, "orders"), f"{scratch(spark)}/chunks", 4000)
    sizes = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("c"))
    return sizes.agg(F.sum("c").alias("n"), (F.max("c") <= 4000).alias("within_limit"))
