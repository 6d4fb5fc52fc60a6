"""Validation, quality and missing-data reports of sequences and tables, and the rules of recommendation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe import constants as C
from helixframe.functions import protein as P
from helixframe.functions import sequence as S
from helixframe.operators import profile


def fasta_validation(records: DataFrame) -> DataFrame:
    """One row: records, warnings of each kind, and the status (invalid, valid, valid_with_warnings)."""
    n = F.length("sequence")
    other = F.length(F.translate(F.upper("sequence"), C.IUPAC, "")) > 0
    one = records.agg(
        F.count("*").alias("sequence_count"), F.count_if(n == 0).alias("empty"), F.count_if(n < 10).alias("very_short"), F.count_if(other).alias("invalid_characters")
    )
    warned = F.col("empty") + F.col("very_short") + F.col("invalid_characters")
    status = F.when(F.col("sequence_count") == 0, "invalid").when(warned > 0, "valid_with_warnings").otherwise("valid")
    return one.withColumn("status", status).withColumn("is_valid", F.col("sequence_count") > 0)


def type_validation(records: DataFrame, expected: str, order: str = "seq_idx") -> DataFrame:
    """The type of the first record against the expected one, beside the FASTA validation."""
    first = records.agg(F.min_by("sequence", order).alias("first")).select(F.coalesce(S.sequence_type(F.col("first")), F.lit("unknown")).alias("detected"))
    out = fasta_validation(records).crossJoin(F.broadcast(first))
    return out.withColumn("type_matches", F.col("detected") == expected)


def nucleotide_quality(seqs: DataFrame) -> DataFrame:
    """One row of totals, affected sequences and percentages for ambiguous letters, gaps, other letters and shortness."""
    u = F.upper("sequence")
    rows = seqs.select(
        S.count_of(u, C.AMBIGUOUS_BASES).alias("ambiguous"), S.count_of(u, "-").alias("gaps"),
        F.length(F.translate(u, C.DNA + C.AMBIGUOUS_BASES + "-", "")).alias("other"), F.length("sequence").alias("n"),
    )
    some = (F.col("ambiguous") > 0) | (F.col("gaps") > 0) | (F.col("other") > 0) | (F.col("n") < 50)
    return rows.agg(
        F.count("*").alias("sequences"), F.count_if(some).alias("with_issues"), F.sum("ambiguous").alias("ambiguous"),
        F.count_if(F.col("ambiguous") > 0).alias("with_ambiguous"), (F.count_if(F.col("ambiguous") > 0) * 100 / F.count("*")).alias("ambiguous_percent"),
        F.sum("gaps").alias("gaps"), F.count_if(F.col("gaps") > 0).alias("with_gaps"), (F.count_if(F.col("gaps") > 0) * 100 / F.count("*")).alias("gaps_percent"),
        F.sum("other").alias("invalid"), F.count_if(F.col("n") < 50).alias("too_short"),
    )


def issue_list(seqs: DataFrame, first: int = 10) -> DataFrame:
    """seq_idx, problems of the sequences with issues among the first ``first`` by seq_idx, which is the feature."""
    rows = seqs.where(F.col("seq_idx") < first).select("seq_idx", S.quality_issues(F.col("sequence")).alias("problems"))
    return rows.where(F.size("problems") > 0)


def protein_quality(proteins: DataFrame) -> DataFrame:
    u = F.upper("sequence")
    odd = S.count_of(u, C.AMBIGUOUS_RESIDUES)
    return proteins.agg(F.count("*").alias("sequences"), F.sum(odd).alias("ambiguous"), F.count_if(odd > 0).alias("with_ambiguous"), F.count_if(F.contains(u, F.lit("-"))).alias("with_gaps"))


def missing_sequences(seqs: DataFrame) -> DataFrame:
    """Empty sequences, those of N and gaps only, and those of over half gaps."""
    u, n = F.upper("sequence"), F.length("sequence")
    some = n > 0
    return seqs.agg(
        F.count_if(F.col("sequence").isNull() | (n == 0)).alias("empty"), F.count_if(some & (F.length(F.translate(u, "N-", "")) == 0)).alias("all_n"),
        F.count_if(some & (S.count_of(u, "-") * 2 > n)).alias("mostly_gaps"),
    )


def falsy(c: str, kind: T.DataType) -> Column:
    """Whether a value is missing, empty, zero or false."""
    empty = F.col(c) == "" if isinstance(kind, T.StringType) else F.col(c) == 0 if isinstance(kind, T.NumericType) else ~F.col(c) if isinstance(kind, T.BooleanType) else F.lit(False)
    return F.col(c).isNull() | F.coalesce(empty, F.lit(False))


def missing_metadata(df: DataFrame) -> DataFrame:
    """field, missing, percentage of the fields with missing or falsy values."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    stats = {c: {"missing": F.count_if(falsy(c, k)), "percentage": F.count_if(falsy(c, k)) * 100 / F.count("*")} for c, k in kinds.items()}
    return profile.long_form(df, stats, "field").where("missing > 0")


def sequence_report(seqs: DataFrame) -> DataFrame:
    """One row: set statistics, quality, missing data and the recommendations that follow."""
    n = F.length("sequence")
    base = seqs.agg(F.sum(n).alias("total_length"), F.avg(n).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))
    one = base.crossJoin(nucleotide_quality(seqs)).crossJoin(missing_sequences(seqs))
    advice = F.array_compact(
        F.array(
            F.when(F.col("empty") > 0, F.concat(F.lit("Remove "), F.col("empty"), F.lit(" empty sequences"))),
            F.when(F.col("all_n") > 0, F.concat(F.lit("Review "), F.col("all_n"), F.lit(" sequences with all N bases"))),
            F.when(F.col("with_issues") > F.col("sequences") * 0.1, "More than 10% of sequences have quality issues - consider data cleaning"),
        )
    )
    return one.withColumn("recommendations", F.array_join(advice, "; "))


def table_shape(df: DataFrame) -> DataFrame:
    """One row for the rules: rows, columns, numeric and text columns, missing cells, mean missing percentage of the columns that miss any."""
    miss = [F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    one = df.agg(F.count("*").alias("rows"), *miss)
    each = F.filter(F.array(*[F.col(f"m{i}") for i in range(len(df.columns))]), lambda m: m > 0)
    total = F.aggregate(each, F.lit(0).cast("long"), lambda a, m: a + m)
    return one.select(
        "rows", F.lit(len(df.columns)).alias("columns"), F.lit(len(profile.numeric_columns(df))).alias("numeric"), F.lit(len(profile.text_columns(df))).alias("categorical"),
        total.alias("missing_cells"), F.when(F.size(each) > 0, total * 100.0 / F.col("rows") / F.size(each)).alias("mean_missing_percent"),
    )


def analysis_advice(df: DataFrame) -> DataFrame:
    """The recommendations of the general analysis of a table, one a row, in order."""
    numeric = profile.numeric_columns(df)
    one = table_shape(df)
    if numeric:
        far = profile.iqr_outliers(df, numeric).agg(F.count_if(F.col("percentage") > 5).alias("outlier_columns"))
        one = one.crossJoin(far)
    else:
        one = one.withColumn("outlier_columns", F.lit(0))
    m = F.col("mean_missing_percent")
    rules = [
        F.when(m > 20, "High percentage of missing data detected - consider imputation or removal").when(m > 5, "Some missing data present - review data collection process")
        .when(m.isNotNull(), "Missing data is minimal and manageable"),
        F.when(F.col("columns") > 100, "High dimensionality detected - consider feature selection or dimensionality reduction")
        .when(F.col("columns") > 50, "Moderate number of features - feature selection may improve model performance"),
        F.when(F.col("numeric") == 0, "No numeric columns detected - consider feature encoding for categorical variables"),
        F.when(F.col("outlier_columns") > 0, F.concat(F.lit("Significant outliers detected in "), F.col("outlier_columns"), F.lit(" columns - consider outlier treatment"))),
        F.when(F.col("rows") < 1000, "Small dataset size - consider data augmentation or collecting more samples")
        .when(F.col("rows") > 100_000, "Large dataset - consider sampling for faster prototyping"),
    ]
    return one.select(F.posexplode(F.array_compact(F.array(*rules))).alias("position", "recommendation"))


def quality_advice(df: DataFrame) -> DataFrame:
    """The recommendations of the quality report, one a row, in order."""
    one = table_shape(df).crossJoin(profile.duplicate_rows(df))
    percent = F.col("missing_cells") * 100.0 / (F.col("rows") * F.col("columns"))
    rules = [
        F.when(percent > 10, "Consider handling missing values (>10% missing data detected)"),
        F.when(F.col("duplicates") > 0, F.concat(F.lit("Remove "), F.col("duplicates"), F.lit(" duplicate rows"))),
        F.when(F.col("numeric") == 0, "No numeric columns detected - consider feature engineering"),
        F.when(F.col("categorical") > F.col("numeric") * 2, "High number of categorical columns - consider encoding strategies"),
    ]
    return one.select(F.posexplode(F.array_compact(F.array(*rules))).alias("position", "recommendation"))


def preprocessing_suggestions(df: DataFrame) -> DataFrame:
    """kind (recommended, optional) and name of the steps suggested for a table."""
    numeric = profile.numeric_columns(df)
    one = table_shape(df)
    spans = [(F.max(c) - F.min(c)).cast("double") for c in numeric]
    ranges = df.agg(*[s.alias(f"r{i}") for i, s in enumerate(spans)]) if len(numeric) > 1 else None
    ratio = F.lit(False)
    if ranges is not None:
        one = one.crossJoin(ranges)
        cols = [F.col(f"r{i}") for i in range(len(numeric))]
        least, most = F.least(*cols), F.greatest(*cols)
        ratio = F.when(least == 0, most > 0).otherwise(most / F.when(least != 0, least) > 10)
    step = lambda yes, kind, name: F.when(yes, F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name")))
    steps = [
        step(F.col("missing_cells") > 0, "recommended", "handle_missing_values"), step(ratio, "recommended", "feature_scaling"),
        step(F.lit(len(numeric) > 50), "optional", "dimensionality_reduction"), step(F.lit(len(numeric) > 0), "optional", "outlier_removal"),
        step(F.lit("sequence" in df.columns), "recommended", "biological_features"),
    ]
    return one.select(F.explode(F.array_compact(F.array(*steps))).alias("x")).select("x.*")


def file_hashes(files: DataFrame) -> DataFrame:
    """path, sha256, md5, sha1 of files read by Spark's binary reader."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), F.sha1("content").alias("sha1"))


# What configurations may name, and the longest texts that they may have.
DATASET_KINDS = ("dna", "rna", "protein", "general")
MODEL_KINDS = ("classification", "regression", "clustering")
MODEL_ALGORITHMS = ("random_forest", "logistic_regression", "svm", "linear_regression", "xgboost", "neural_network")
MOST_NAME, MOST_DESCRIPTION = 255, 1000


def config_errors(config: dict, required: dict[str, type]) -> list[str]:
    """What is wrong with a configuration: fields that are missing or of another type."""
    return [f"{k} is missing" if k not in config else f"{k} is no {t.__name__}" for k, t in required.items() if k not in config or not isinstance(config[k], t)]


def _whole(value, least: int) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= least


def dataset_config(config: dict) -> tuple[list[str], list[str]]:
    """Errors and warnings of a dataset's configuration: kind, name, description, largest file."""
    errors = [f"Missing required field: {k}" for k in ("dataset_type", "name") if k not in config]
    if config.get("dataset_type", DATASET_KINDS[0]) not in DATASET_KINDS:
        errors.append(f"Invalid dataset type. Must be one of: {', '.join(DATASET_KINDS)}")
    name = config.get("name", "x")
    errors += ["Dataset name cannot be empty"] * (len(name) < 1) + [f"Dataset name too long (max {MOST_NAME} characters)"] * (len(name) > MOST_NAME)
    if not _whole(config.get("max_file_size", 1), 1):
        errors.append("max_file_size must be a positive integer")
    return errors, [f"Description is very long (>{MOST_DESCRIPTION} characters)"] * (len(config.get("description", "")) > MOST_DESCRIPTION)


def model_config(config: dict) -> list[str]:
    """Errors of a model's configuration: kind, algorithm, a forest's parameters, test share, folds, target."""
    errors = [f"Missing required field: {k}" for k in ("model_type", "algorithm") if k not in config]
    for field, known, what in (("model_type", MODEL_KINDS, "model type"), ("algorithm", MODEL_ALGORITHMS, "algorithm")):
        if field in config and config[field] not in known:
            errors.append(f"Invalid {what}. Must be one of: {', '.join(known)}")
    given = config.get("hyperparameters", {})
    if not isinstance(given, dict):
        errors.append("Hyperparameters must be a dictionary")
    elif config.get("algorithm") == "random_forest":
        errors += ["n_estimators must be a positive integer"] * (not _whole(given.get("n_estimators", 1), 1))
        errors += ["max_depth must be a positive integer or None"] * (given.get("max_depth") is not None and not _whole(given["max_depth"], 1))
    test = config.get("test_size", 0.5)
    errors += ["test_size must be a float between 0 and 1"] * (not isinstance(test, (int, float)) or not 0 < test < 1)
    errors += ["cv_folds must be an integer >= 2"] * (not _whole(config.get("cv_folds", 2), 2))
    target = config.get("target_column", "x")
    return errors + ["target_column must be a non-empty string"] * (not isinstance(target, str) or not target)


def upload_errors(name: str, size: int, allowed: tuple[str, ...], most_mb: int = 100) -> list[str]:
    """Errors of a file to be uploaded: its name, extension and size."""
    end = name.lower().rpartition(".")[2] if "." in name else ""
    errors = ["Filename cannot be empty"] * (not name.strip())
    errors += [f"File type not allowed. Allowed types: {', '.join(allowed)}"] * (bool(name) and end not in [a.lower() for a in allowed])
    errors += [f"File size ({size / (1 << 20):.1f}MB) exceeds maximum allowed size ({most_mb}MB)"] * (size > most_mb << 20)
    return errors + ["File appears to be empty"] * (size <= 0)


def json_errors(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """``rows`` with ``fault``: why a JSON text does not fit a schema of Spark (``a int not null, b array<string>``): it is no JSON object,
    a field that must be there is missing, or a field is of another kind; null where it fits."""
    kind = T.StructType.fromDDL(schema)
    broken = T.StructType([*[T.StructField(f.name, f.dataType) for f in kind.fields], T.StructField("__broken", T.StringType())])
    parsed = F.from_json(column, broken, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"})
    fields = F.json_object_keys(F.col(column))
    needed = [f.name for f in kind.fields if not f.nullable]
    lacking = F.filter(F.array(*map(F.lit, needed)).cast("array<string>"), lambda n: ~F.array_contains(fields, n))
    other = F.array_compact(F.array(*[F.when(F.array_contains(fields, f.name) & parsed[f.name].isNull(), F.lit(f.name)) for f in kind.fields]))
    fault = F.when(fields.isNull(), "no JSON object").when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", ")))
    return rows.withColumn("fault", fault.when(F.size(other) > 0, F.concat(F.lit("of another kind: "), F.array_join(other, ", "))).when(parsed["__broken"].isNotNull(), "of another kind"))


def composition(seqs: DataFrame) -> DataFrame:
    """letter, n, percentage of all letters (upper case) of all sequences; long sequences are counted where they are."""
    chars = seqs.select(F.explode(S.letters(F.upper("sequence"))).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))
    return chars.crossJoin(F.broadcast(chars.agg(F.sum("n").alias("total")))).select("letter", "n", (F.col("n") * 100 / F.col("total")).alias("percentage"))


def first_composition(seqs: DataFrame, first: int = 10) -> DataFrame:
    """Shares of A, T, G, C and N and the skews over the first ``first`` sequences, which is the feature."""
    u = F.upper("sequence")
    n = {x: F.coalesce(F.sum(S.count_of(u, x)), F.lit(0)) for x in "ATGCN"}
    total = F.greatest(F.coalesce(F.sum(F.length("sequence")), F.lit(0)), F.lit(1))
    one = lambda a, b: (n[a] - n[b]) / F.greatest(F.lit(1), n[a] + n[b])
    return seqs.where(F.col("seq_idx") < first).agg(
        *[n[x].alias(f"{x.lower()}_count") for x in "ATGCN"], *[(n[x] / total).alias(f"{x.lower()}_share") for x in "ATGCN"], one("G", "C").alias("gc_skew"), one("A", "T").alias("at_skew")
    )


def gc_range(seqs: DataFrame, first: int = 100) -> DataFrame:
    """Least, mean and largest GC fraction of the first ``first`` sequences, which is the feature."""
    gc = S.gc_unambiguous(F.col("sequence"))
    return seqs.where(F.col("seq_idx") < first).agg(F.min(gc).alias("min"), F.avg(gc).alias("avg"), F.max(gc).alias("max"))


# The quality that a new dataset is given.
GIVEN_QUALITY = {"quality_score": 0.95, "completeness": 0.98, "contamination": 0.01}


def metadata(seqs: DataFrame, kind: str, name: str, size: int) -> DataFrame:
    """One row about an upload of sequences: its file, their number and lengths (the median is the upper one), for nucleotides the GC
    percentages and the composition of the first ones, which is the feature, and the quality that new datasets are given.

    Without sequences numbers and shares are 0 and extremes null.
    """
    n = F.length("sequence")
    end = f".{name.rpartition('.')[2].lower()}" if "." in name else ""
    one = seqs.agg(
        F.count("*").alias("total_sequences"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(n).alias("mean_length"),
        F.expr("percentile_disc(0.5) within group (order by length(sequence) desc)").cast("int").alias("median_length"),
    ).withColumns({"file_name": F.lit(name), "file_size_mb": F.lit(round(size / (1 << 20), 2)), "file_extension": F.lit(end), "dataset_type": F.lit(kind)})
    if kind in ("dna", "rna"):
        gc = gc_range(seqs, 1000).select(*[(F.col(c) * 100).alias(f"gc_{to}") for c, to in (("min", "min"), ("avg", "mean"), ("max", "max"))])
        one = one.crossJoin(gc).crossJoin(first_composition(seqs))
    return one.withColumns({k: F.lit(v) for k, v in GIVEN_QUALITY.items()})


def dataset_summary(told: DataFrame) -> DataFrame:
    """What a list of datasets shows of ``metadata``: records, size in words, kind, number and lengths of sequences."""
    mb = F.col("file_size_mb")
    words = F.when(mb >= 1024, F.concat(F.format_number(mb / 1024, 2), F.lit(" GB"))).otherwise(F.concat(F.format_number(mb, 2), F.lit(" MB")))
    lengths = [F.coalesce(F.col(f"{c}_length"), F.lit(0)).alias(f"{to}_sequence_length") for c, to in (("mean", "avg"), ("min", "min"), ("max", "max"))]
    return told.select(F.col("total_sequences").alias("total_records"), words.alias("file_size"), "dataset_type", F.col("total_sequences").alias("sequence_count"), *lengths)


def protein_statistics(proteins: DataFrame, first: int = 100) -> DataFrame:
    """Mean, population deviation and extremes of masses and isoelectric points of the first proteins (seq_idx, sequence), of those with
    standard residues only; the number is the feature."""
    s = F.upper("sequence")
    some = proteins.where((F.col("seq_idx") < first) & P.is_standard(s)).select(P.molecular_weight(s).alias("mass"), P.isoelectric_point(s).alias("point"))
    return some.agg(*[f(c).alias(f"{c}_{n}") for c in ("mass", "point") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


def columns_overview(df: DataFrame) -> DataFrame:
    """column, kind and missing values of each column of a table."""
    stats = {f.name: {"kind": F.lit(f.dataType.simpleString()), "missing": F.count_if(F.col(f.name).isNull())} for f in df.schema.fields}
    one = profile.long_form(df, {c: {"missing": s["missing"]} for c, s in stats.items()})
    kinds = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    return one.withColumn("kind", kinds[F.col("column")])


def missing_rollup(df: DataFrame) -> DataFrame:
    """Sums of missing cells and missing percentages, and the largest number of distinct values of a column."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns])).alias("x")
    kinds = df.select(cells).select("x.*").groupBy("column", "v").agg(F.count("*").alias("n"))
    per = kinds.groupBy("column").agg(F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("missing"), F.sum("n").alias("rows"), F.count("v").alias("distinct"))
    return per.agg(F.sum("missing").alias("missing"), F.sum(F.col("missing") * 100 / F.col("rows")).alias("missing_percent"), F.max("distinct").alias("most_distinct"))
