"""Examples, corpora, e-mails and splits on files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EMAIL_FIELDS = ("sender", "from", "subject", "body", "link_display_text", "link_url")


def _required(row: Column, name: str) -> Column:
    """A string member of a variant row; anything else fails the job."""
    kind = F.schema_of_variant(F.try_variant_get(row, f"$.{name}", "variant"))
    return F.when(kind == "STRING", F.variant_get(row, f"$.{name}", "string")).otherwise(
        F.raise_error(F.concat(F.lit(f'missing or non-string "{name}" in '), F.to_json(row))).cast("string")
    )


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of ``input`` and ``label``, both strings; a bad row is fatal.

    Rows are read as variants: a string schema would turn a number into text
    and a missing field into null.
    """
    rows = spark.read.option("singleVariantColumn", "v").option("mode", "FAILFAST").json(path)
    return rows.select(_required(F.col("v"), "input").alias("input"), _required(F.col("v"), "label").alias("label"))


def read_corpus(spark: SparkSession, path: str, text_field: str, others: str = "") -> DataFrame:
    """Files that each hold one JSON array of objects: the chosen field as
    ``text``, plus the columns of the DDL string ``others``.

    A JSON array cannot be split, so each file is one task. A text that is no
    string comes as JSON text; an object without the field is fatal.
    """
    ddl = f"`{text_field}` string" + (f", {others}" if others else "")
    rows = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(ddl).json(path)
    absent = F.raise_error(F.lit(f'object without "{text_field}"')).cast("string")
    return rows.withColumn(text_field, F.coalesce(text_field, absent)).withColumnRenamed(text_field, "text")


def read_emails(spark: SparkSession, path: str, n_rows: int | None = None) -> DataFrame:
    """CSV with ``id``, ``phish_label`` and a JSON ``email_content`` column.

    All six e-mail fields must be there, and ``n_rows`` rows when it is given.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .schema("id string, email_content string, phish_label int")
        .option("enforceSchema", False)
        .csv(path)
    )
    if n_rows is not None:
        found = raw.count()
        if found != n_rows:
            raise ValueError(f"expected {n_rows} rows, got {found}")
    content = F.try_parse_json("email_content")

    def member(name: str) -> Column:
        v = F.try_variant_get(content, f"$.{name}", "string")
        return F.coalesce(
            v, F.raise_error(F.concat(F.lit(f'e-mail without "{name}": '), F.coalesce("id", F.lit("?")))).cast("string")
        )

    return raw.select(
        "id",
        F.col("phish_label").alias("y"),
        F.when(F.col("phish_label") == 1, "phishing").otherwise("legitimate").alias("label"),
        F.struct(*[member(n).alias(n) for n in EMAIL_FIELDS]).alias("email"),
    )


def email_text(email: str = "email") -> list[tuple[str, str]]:
    """Field list that serialises an e-mail struct."""
    return [
        ("from", f"{email}.from"),
        ("sender", f"{email}.sender"),
        ("subject", f"{email}.subject"),
        ("link_text", f"{email}.link_display_text"),
        ("link_url", f"{email}.link_url"),
        ("body", f"{email}.body"),
    ]


def write_splits(df: DataFrame, path: str, split: str = "split", mode: str = "errorifexists") -> None:
    """JSON lines of ``input`` and ``label``, one folder per split."""
    df.select(split, "input", "label").write.mode(mode).partitionBy(split).json(path)


def read_split(spark: SparkSession, path: str, name: str, split: str = "split") -> DataFrame:
    return read_examples(spark, f"{path}/{split}={name}")
