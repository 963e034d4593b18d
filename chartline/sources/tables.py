"""Sources and sinks: tables by extension, headered shards, code maps, partitioned snapshots."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import skew
from ..functions import scalar as x
from ..operators import cohort
from ..session import cut_lineage


def _read(spark: SparkSession, path: str, schema: StructType | str | None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if path.endswith(".csv"):
        return reader.option("header", True).option("enforceSchema", False).csv(path)
    return reader.parquet(path)


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet or CSV by extension; if the path is not there, its sibling with the other extension."""
    stem, _, ext = path.rpartition(".")
    try:
        return _read(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) or ext not in ("parquet", "csv"):
            raise
        return _read(spark, f"{stem}.{'csv' if ext == 'parquet' else 'parquet'}", schema)


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> str:
    """Write by extension or forced format."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def read_shards(spark: SparkSession, glob: str, schema: StructType | str) -> DataFrame:
    """Many headered CSV files as one table. A file whose header differs from the schema fails the job."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(glob)


def lifetime_events(ev: DataFrame, spine: DataFrame, path: str, years: int = 100, months: int = 1) -> DataFrame:
    """Events inside the widest window, written once and read back; narrower windows are slices of it.

    Files are laid out by (entity, year), which keeps an entity's rows
    together and still spreads an entity with very many of them.
    """
    out = cohort.anchored(ev, spine, years, months)
    out = out.repartition("entity", F.year("event_date")).sortWithinPartitions("entity", "event_date")
    write_table(out, path)
    return ev.sparkSession.read.parquet(path)


def append_partition(df: DataFrame, path: str, run_date: str) -> str:
    """Add a snapshot under its run date. A repeated run replaces its own date and nothing else."""
    (df.withColumn("partition_date", F.lit(run_date).cast("date")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("partition_date").parquet(path))
    return path


def latest_partition(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest snapshot; the date is a literal, so other partitions are not listed for reading."""
    df = spark.read.parquet(path)
    newest = df.agg(F.max("partition_date").alias("d")).first()["d"]
    return df.where(F.col("partition_date") == F.lit(newest))


# --- code maps --------------------------------------------------------------
def load_code_map(spark: SparkSession, path: str) -> DataFrame:
    """(event_type, code, category, term) from JSON {obs: {code: category}, med: {...}}, CSV Code/Name/Category
    (all types) or TSV code_type/category/code_id/term. Codes become exact 64-bit numbers."""
    if path.endswith(".json"):
        doc = spark.read.schema("obs map<string,string>, med map<string,string>").option("multiLine", True).json(path)
        parts = [doc.select(F.lit(k).alias("event_type"), F.explode(k).alias("code", "category")) for k in ("obs", "med")]
        out = parts[0].unionByName(parts[1]).withColumn("term", F.lit(None).cast("string"))
    elif path.endswith(".tsv"):
        t = spark.read.schema("code_type string, category string, code_id string, term string").option("header", True).option("sep", "\t").csv(path)
        out = t.select(F.col("code_type").alias("event_type"), F.col("code_id").alias("code"), "category", "term")
    else:
        t = spark.read.schema("Code string, Name string, Category string").option("header", True).option("enforceSchema", False).csv(path)
        out = t.select(F.explode(F.array(F.lit("obs"), F.lit("med"))).alias("event_type"), F.col("Code").alias("code"), F.col("Category").alias("category"), F.col("Name").alias("term"))
    return out.withColumn("code", x.exact_long("code")).where(F.col("code").isNotNull())


def map_qc(ev: DataFrame, cmap: DataFrame) -> DataFrame:
    """Coverage of a map as (check, n): events, mapped events, codes, categories, single-code categories, mapped codes without events."""
    m = cmap.select("event_type", "code", "category").distinct()
    per = ev.groupBy("event_type", "code").agg(F.count(F.lit(1)).alias("n"))
    j = per.join(m, ["event_type", "code"], "full_outer")
    a = j.agg(F.sum("n").alias("events"), F.sum(F.when(F.col("category").isNotNull(), F.col("n"))).alias("mapped_events"),
              x.count_where(F.col("category").isNotNull()).alias("mapped_codes"), x.count_where(F.col("n").isNull()).alias("codes_without_events"))
    c = m.groupBy("category").agg(F.count_distinct("code").alias("k")).agg(F.count(F.lit(1)).alias("categories"), x.count_where(F.col("k") == 1).alias("single_code_categories"))

    def rows(df):
        return df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias("n")) for n in df.columns])).alias("r")).select("r.*")
    return rows(a).unionByName(rows(c))


# --- joining and packing ----------------------------------------------------
def load_keep(spark: SparkSession, path: str) -> list[str]:
    """A feature list from a JSON list, {"features": [...]} or one name per line."""
    text = spark.read.option("wholetext", True).text(path).first()[0]
    try:
        doc = json.loads(text)
        return list(doc["features"] if isinstance(doc, dict) else doc)
    except json.JSONDecodeError:
        return [ln.strip() for ln in text.splitlines() if ln.strip()]


def combine(spine: DataFrame, *mats: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Feature tables left-joined to the spine; a repeated column name keeps its first table; numbers missing become 0."""
    out = spine
    for m in mats:
        cols = [c for c in m.columns if c == "entity" or c not in out.columns]
        if keep is not None:
            cols = [c for c in cols if c == "entity" or c in keep]
        new = m.select(*cols)
        out = out.join(new, "entity", "left").na.fill(0, [c for c in cols if c != "entity"])
    return out


def pack_json(wide: DataFrame, front: Sequence[str], trailing: Sequence[str] = (), name: str = "transformed_features") -> DataFrame:
    """Contract row: front columns, one JSON object of all other columns (NULLs kept, NaN as NULL, ISO dates), trailing columns."""
    rest = [(c, t) for c, t in wide.dtypes if c not in (*front, *trailing)]
    cols = [x.finite(c, None).alias(c) if t in ("double", "float") else F.col(c) for c, t in rest]
    return wide.select(*front, F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(name), *trailing)


def feature_catalog(wide: DataFrame, features: Sequence[str], max_levels: int = 20) -> DataFrame:
    """Per feature: type, known levels of text features, filled values, entities. One row per feature."""
    kinds = dict(wide.dtypes)
    texts = [f for f in features if kinds[f] == "string"]
    aggs = [F.count(f).alias(f"n|{f}") for f in features]
    base = wide.agg(F.count_distinct("entity").alias("_e"), *aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(kinds[f]).alias("dtype"), F.col(f"n|{f}").alias("non_null"), F.col("_e").alias("entities")) for f in features])
    out = base.select(F.explode(rows).alias("r")).select("r.*")
    if not texts:
        return out.withColumn("levels", F.lit(None).cast("string"))
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in texts])).alias("s")).select("s.*").where(F.col("v").isNotNull()).distinct()
    # one level more than can be listed tells that there are too many; the others are cut off before the shuffle
    few = skew.top_by(long, ["feature"], [F.col("v")], max_levels + 1, "_rn")
    lv = few.groupBy("feature").agg(F.count(F.lit(1)).alias("_k"), F.array_join(F.sort_array(F.collect_list("v")), "|").alias("levels"))
    lv = lv.select("feature", F.when(F.col("_k") <= max_levels, F.col("levels")).alias("levels"))
    return out.join(lv, "feature", "left")


def unpack_json(df: DataFrame, schema: str, c: str = "transformed_features", max_card: int = 20) -> DataFrame:
    """JSON back to numeric columns; text fields with at most ``max_card`` levels become indicators, others are dropped."""
    df = cut_lineage(df)  # read for the levels and for the rows
    p = df.withColumn("_j", F.from_json(c, schema)).select(*[k for k in df.columns if k != c], "_j.*")
    kinds = {k: t for k, t in p.dtypes if k not in df.columns}
    texts = [k for k, t in kinds.items() if t == "string"]
    levels = {}
    if texts:
        card = p.agg(*[F.count_distinct(k).alias(k) for k in texts]).first()
        for k in [k for k in texts if card[k] <= max_card]:
            levels[k] = sorted(r[0] for r in p.select(k).where(F.col(k).isNotNull()).distinct().collect())
    nums = [F.col(k).cast("double").alias(k) for k, t in kinds.items() if t != "string"]
    hot = [x.flag(F.col(k) == v).cast("double").alias(f"{k}_{v}") for k, vs in levels.items() for v in vs]
    return p.select(*[k for k in df.columns if k != c], *nums, *hot)


def partition_counts(store: DataFrame) -> DataFrame:
    return store.groupBy("partition_date").agg(F.count_distinct("entity").alias("entities"))


def json_feature(name: str, c: str = "transformed_features") -> Column:
    return F.get_json_object(c, f"$.{name}").try_cast("double")


def drift(store: DataFrame, feature: str, by: Sequence[str] = ("partition_date",)) -> DataFrame:
    """Exact median of one packed feature per snapshot day."""
    from .. import skew

    v = store.select(*by, json_feature(feature).alias("v"))
    n = v.groupBy(*by).agg(F.count("v").alias("n"))
    return n.join(skew.quantiles(v, list(by), "v", {"median": 0.5}), list(by), "left")
