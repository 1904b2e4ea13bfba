"""Ops A4-A9: ad-hoc SQL, preview, sample, counts, profile, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardflow import constants as K

# Hash buckets of the sampler: the per-bucket count table has at most this
# many rows, which bounds its window and its broadcast.
_SAMPLE_BUCKET_HEX = 4
_SAMPLE_BUCKETS = 16 ** _SAMPLE_BUCKET_HEX


def adhoc_sql(spark: SparkSession, df: DataFrame, query: str, args: dict | None = None,
              view: str = "patients") -> DataFrame:
    """A4: run a query against the patient table, which it names ``view``.

    The name is bound for this statement alone (a common table expression over
    the DataFrame): no view of the session is made or replaced, and one of the
    caller's that has the same name is as it was. The text must be a query: it
    is parsed as a subquery, where the grammar knows no statement that changes
    or drops anything, so ``DROP``, ``INSERT`` and the like are syntax errors
    before anything runs. Errors surface to the caller.
    """
    # Braces of the text are not placeholders; a closing comment ends with its line.
    text = query.strip().rstrip(";").replace("{", "{{").replace("}", "}}")
    bound = f"WITH `{view}` AS (SELECT * FROM {{_wf_table}}) SELECT * FROM (\n{text}\n)"
    return spark.sql(bound, args, _wf_table=df) if args else spark.sql(bound, _wf_table=df)


def preview_rows(df: DataFrame, n: int = K.PREVIEW_ROWS, key: str = "patient_id") -> DataFrame:
    """A5: the first ``n`` rows by ``key`` (a top-k: each task keeps n rows)."""
    return df.orderBy(F.asc(key)).limit(n)


def sample_rows(df: DataFrame, n: int = K.SAMPLE_ROWS, seed: int = K.SAMPLE_SEED,
                key: str = "patient_id") -> DataFrame:
    """Exactly ``min(n, N)`` rows chosen by a seeded hash of ``key``
    (the ``n`` smallest ``md5('<seed>:<key>')``, ties by key).

    A sort-and-limit would send up to ``n`` rows from every task to one
    task. Instead rows are counted per hash bucket (at most 65,536 buckets),
    a running sum over that small table gives each bucket its quota, and
    only the rows of buckets with a quota are ranked within their bucket
    (a bucket holds about N / 65,536 rows; hash values are uniform because
    the key is unique).
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    tagged = df.select(key, h.alias("_wf_h")).withColumn(
        "_wf_b", F.conv(F.substring("_wf_h", 1, _SAMPLE_BUCKET_HEX), 16, 10).cast("int"))
    counts = tagged.groupBy("_wf_b").agg(F.count(F.lit(1)).alias("_wf_n"))
    upto = Window.orderBy("_wf_b").rowsBetween(Window.unboundedPreceding, 0)
    quota = (counts.withColumn("_wf_cum", F.sum("_wf_n").over(upto))
                   .withColumn("_wf_quota", F.least(F.col("_wf_n"), F.greatest(
                       F.lit(0), F.lit(n) - (F.col("_wf_cum") - F.col("_wf_n")))))
                   .filter(F.col("_wf_quota") > 0)
                   .select("_wf_b", "_wf_quota"))
    # Only kept buckets pass the join (at most _SAMPLE_BUCKETS rows are sent),
    # so the rank below shuffles keys of the sample, and the other columns are
    # derived for the sample alone.
    kept = tagged.join(F.broadcast(quota), "_wf_b")
    rank = Window.partitionBy("_wf_b").orderBy("_wf_h", key)
    keys = (kept.withColumn("_wf_r", F.row_number().over(rank))
                .filter(F.col("_wf_r") <= F.col("_wf_quota")).select(key))
    return df.join(keys, key, "left_semi")


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def table_profile(df: DataFrame, sample: int = 0, key: str = "patient_id") -> DataFrame:
    """One row per column: position, name, type, non-null and row count;
    with ``sample``, also ``sample_values``: the column's values, as text, in
    the first so many rows by ``key`` (doubles to 6 places).

    One aggregation over the table, then unpivoted. The sample is a bounded
    array from a top-k, attached as a scalar subquery.
    """
    names = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_wf_rows"),
                 *[F.count(F.col(f"`{c}`")).alias(f"_wf_c{i}") for i, c in enumerate(names)])
    extra = [[] for _ in names]
    if sample:
        text = [F.round(F.col(f"`{c}`"), 6) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
        first = (preview_rows(df, sample, key).select(F.col(key).alias("_wf_k"), *[
            t.cast("string").alias(f"_wf_s{i}") for i, t in enumerate(text)])
            .agg(F.sort_array(F.collect_list(F.struct("*"))).alias("rows")))
        agg = agg.select("*", first.scalar().alias("_wf_sample"))
        # A field of an array of structs is the array of that field.
        extra = [[F.col("_wf_sample")[f"_wf_s{i}"].alias("sample_values")] for i in range(len(names))]
    items = [F.struct(F.lit(i + 1).alias("ordinal"), F.lit(c).alias("column_name"),
                      F.lit(t).alias("data_type"), F.col(f"_wf_c{i}").alias("non_null_count"), *extra[i])
             for i, (c, t) in enumerate(df.dtypes)]
    return (agg.select(F.col("_wf_rows").alias("row_count"), F.explode(F.array(*items)).alias("p"))
               .select("p.*", "row_count"))


def _verdict(df: DataFrame, required: Sequence[str]) -> Column:
    """``is_valid``, ``status`` (``ok``, ``empty`` or ``missing``) and
    ``missing_columns`` of a column list, given the row count ``_wf_n``."""
    missing = [c for c in required if c not in df.columns]
    status = (F.when(F.col("_wf_n") == 0, F.lit("empty"))
               .when(F.lit(bool(missing)), F.lit("missing")).otherwise(F.lit("ok")))
    return F.struct((status == "ok").alias("is_valid"), status.alias("status"),
                    F.array(*[F.lit(c) for c in missing]).cast("array<string>").alias("missing_columns"))


def validate_columns(df: DataFrame, required: Sequence[str] | None = None) -> DataFrame:
    """(is_valid, status, missing_columns) as one row: the table must
    have rows and every required column (default: the core eight)."""
    required = list(K.REQUIRED_COLUMNS if required is None else required)
    has_rows = df.limit(1).agg(F.count(F.lit(1)).alias("_wf_n"))
    return has_rows.select(_verdict(df, required).alias("v")).select("v.*")


PAGE_COLUMNS = {
    "core": K.REQUIRED_COLUMNS,
    "overview": K.OVERVIEW_COLUMNS,
    "specialty": K.SPECIALTY_PAGE_COLUMNS,
    "risk": K.RISK_PAGE_COLUMNS,
    "seasonal": K.SEASON_PAGE_COLUMNS,
}


def validate_pages(df: DataFrame) -> DataFrame:
    """A9 for every page list: one row per page with ``is_valid``,
    ``status`` and ``missing_columns``; one bounded emptiness check."""
    has_rows = df.limit(1).agg(F.count(F.lit(1)).alias("_wf_n"))
    pages = [F.struct(F.lit(page).alias("page"), _verdict(df, cols).alias("v"))
             for page, cols in PAGE_COLUMNS.items()]
    return has_rows.select(F.explode(F.array(*pages)).alias("p")).select("p.page", "p.v.*")
