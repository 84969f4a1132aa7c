"""Readers, writers and id lists of record tables."""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ENTITY = StructType([StructField(c, StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = StructType([StructField(c, StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
PREDICTION = "source1_entity_id string, candidate_entity_id string, model_score double, predicted_match_label tinyint"
OOF = "source1_entity_id string, candidate_entity_id string, target_source string, fold tinyint, score float, label tinyint"


def read_tsv(spark: SparkSession, path: str | list[str], schema: StructType | str = ENTITY, null_values: tuple[str, ...] = (), columns: list[str] | None = None, first: int | None = None, order: str | None = None) -> DataFrame:
    """Tab-separated records under a fixed schema. Empty fields are null; ``null_values`` names more
    texts that mean null. ``first`` rows are those smallest by ``order``, so a smoke scan repeats."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", "PERMISSIVE").csv(path)
    for c in df.columns if null_values else ():
        df = df.withColumn(c, F.when(~F.col(c).isin(*null_values), F.col(c)))
    df = df.select(*columns) if columns else df
    return df if first is None else df.orderBy(order or df.columns[0]).limit(first)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge_parts(parts: list[str], to: str) -> str:
    """One file of parts in name order, byte for byte: a record may straddle two parts."""
    with open(to, "wb") as out:
        for p in sorted(parts):
            with open(p, "rb") as f:
                shutil.copyfileobj(f, out, 1 << 20)
    return to


def write_tsv(df: DataFrame, path: str, quote: bool = True, single: bool = False) -> None:
    w = (df.coalesce(1) if single else df).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "")
    (w if quote else w.option("quote", "\u0000").option("escape", "\u0000")).csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, sort: str | None = None) -> None:
    df = df.sortWithinPartitions(sort) if sort else df
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def resume(df: DataFrame, path: str, rows: int | None = None) -> DataFrame:
    """The table at ``path`` if it is there in full (with ``rows`` rows, when given), else ``df`` written
    there. The committer renames only complete output into place."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
    if not there or (rows is not None and spark.read.parquet(path).count() != rows):
        write_parquet(df, path)
    return spark.read.parquet(path)


def sniff(path: str) -> dict:
    """Kind, separator and header of a file or folder, from its name and first bytes."""
    p = Path(path)
    if p.is_dir() or p.suffix == ".parquet":
        return {"kind": "parquet"}
    head = p.open(encoding="utf-8", errors="replace").readline().rstrip("\r\n")
    sep = "\t" if "\t" in head else ","
    cells = head.split(sep)
    ident = __import__("re").compile(r"S[123]-\d+")
    return {"kind": "tsv" if sep == "\t" else "csv", "sep": sep, "header": not any(ident.fullmatch(c.strip('"')) for c in cells), "columns": cells}


def find_columns(df: DataFrame, sample: int = 5000) -> dict[str, list[str]]:
    """Which columns hold S1 ids, target ids and scores, by most of a sample."""
    some = df.limit(sample)
    kinds = {"s1": r"^S1-[0-9]+\z", "target": r"^S[23]-[0-9]+\z"}
    aggs = [F.avg(F.coalesce(F.col(c).cast("string").rlike(p), F.lit(False)).cast("double")).alias(f"{k}/{c}") for c in df.columns for k, p in kinds.items()]
    row = some.agg(*aggs).first().asDict()
    out = {k: [c for c in df.columns if (row[f"{k}/{c}"] or 0) > 0.5] for k in kinds}
    out["score"] = [c for c, t in df.dtypes if t in ("double", "float") or (t == "string" and any(x in c.lower() for x in ("score", "prob")))]
    return out


def id_list(text) -> Column:
    """Target ids of any list spelling: commas, bars, brackets, quotes, or one character a cell; other
    text between them is passed over."""
    return F.regexp_extract_all(_joined_cells(text), F.lit(TARGET_ID), F.lit(0))


def id_list_junk(text) -> Column:
    """What an id list holds besides target ids and separators, empty for a clean one."""
    return F.regexp_replace(_joined_cells(text), TARGET_ID, "")


TARGET_ID = r"S[23]-\d+"


def _joined_cells(text) -> Column:
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, "[^A-Za-z0-9-]", "")


def truth_pairs(truth: DataFrame, text: str = "matched_entity_ids") -> DataFrame:
    """A row for each id of a comma list; empty lists give none."""
    pair = F.explode(F.split(text, ",")).alias("m")
    return truth.select("source1_entity_id", pair).select("source1_entity_id", F.trim("m").alias("matched_entity_id")).where("matched_entity_id <> ''").withColumn("match_source", F.substring("matched_entity_id", 1, 2))


def truth_lists(truth: DataFrame, text: str = "matched_entity_ids") -> DataFrame:
    """Lists as sets, empty ones kept."""
    items = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), F.trim), lambda x: x != ""))
    return truth.select("source1_entity_id", items.alias("matched"))


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One row ``rows, digest``: the same for the same rows in any order, summed from row hashes. Every
    value carries its length and a null its mark, so that no two rows read alike."""
    cells = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("N")) for c in columns]
    h = F.conv(F.substring(F.sha2(F.concat(*cells), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))


def with_position(df: DataFrame, order: str) -> DataFrame:
    """``row_pos`` from 0 in the order of a column: files have no stable order of their own."""
    rows = df.orderBy(order).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    return df.sparkSession.createDataFrame(rows, StructType([*df.schema.fields, StructField("row_pos", __import__("pyspark.sql.types", fromlist=["LongType"]).LongType())]))


def only_known(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def read_inferred(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A delimited file with a header, its types inferred by a pass over all of it."""
    return spark.read.option("header", True).option("inferSchema", True).option("sep", sep).csv(path)


def write_manifest(spark: SparkSession, path: str, facts: dict[str, str | int | float]) -> None:
    """One line of JSON about how a table came to be, beside it."""
    import json

    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
