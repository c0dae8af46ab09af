"""Typed CSV and Parquet input, the choice of tables, the feature cache and the score file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256
from math import ceil

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.types import StructType

from ledgerlens.operators.codes import clean_codes
from ledgerlens.sources.records import breaks_in_quotes, whole_records
from ledgerlens.sources.schemas import TABLES, TRANSACTIONS


# No text of a database holds this character, so no field is mistaken for an empty one.
NEVER = "\0"
CSV_READING = {"mode": "FAILFAST", "escape": '"', "nullValue": NEVER, "emptyValue": ""}


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header and fixed types; a malformed row stops the job.

    An empty field is NULL, a quoted one (``""``) the empty text. Quotes inside quoted fields are
    doubled, backslashes are plain text, and quoted fields may hold line breaks; columns go by
    position, so the header's names do not matter. Files are read in splits: where a line ends inside
    quotes, records are first put together from the quotes counted in each split.
    """
    if not breaks_in_quotes(spark, path):
        return spark.read.schema(schema).option("header", True).options(**CSV_READING).csv(path)
    records = whole_records(spark, path)
    row = F.from_csv("record", schema.simpleString(), CSV_READING)
    return records.select(row.alias("row")).select("row.*")


# Spark writes milliseconds unless told otherwise; reading takes any fraction.
CSV_FORMATS = {
    "header": True,
    "escape": '"',
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV_FORMATS).csv(path)


@dataclass(frozen=True)
class DatasetSpec:
    """Which tables a run reads; the small variant exists only for training."""

    training: bool = True
    lite: bool = False

    @property
    def suffix(self) -> str:
        if not self.training:
            return "_predict"
        return "_train_lite" if self.lite else "_train"

    @property
    def transactions(self) -> str:
        return f"datos_transaccionales{self.suffix}"

    @property
    def labels(self) -> str:
        return f"datos_var_rpta{self.suffix}" if self.training else "ids_predict"

    @property
    def features(self) -> str:
        return f"features{self.suffix}"


DIMENSION = "maestro_cdgtrn_cdgrpta"


@dataclass(frozen=True)
class Inputs:
    transactions: DataFrame
    labels: DataFrame
    dimension: DataFrame


def load_inputs(spark: SparkSession, folder: str, spec: DatasetSpec, fmt: str = "parquet") -> Inputs:
    """Read the tables of ``spec`` from ``folder``; CSV files end in ``.csv``."""

    def read(table: str) -> DataFrame:
        if fmt == "csv":
            return read_csv(spark, f"{folder}/{table}.csv", TABLES[table])
        return spark.read.format(fmt).load(f"{folder}/{table}")

    dimension = read(DIMENSION)
    return Inputs(read(spec.transactions), read(spec.labels), clean_codes(dimension))


CLUSTER_KEYS = ("id", "fecha_trxn", "sesion")
ROWS_PER_FILE = 5_000_000


def cluster_by_id(trxn: DataFrame, files: int | None = None) -> DataFrame:
    """Order transactions so that a file holds a range of ids.

    The rows of an id then meet in one or two tasks, and combining before the
    shuffle shrinks every later pass to about one row per group. Ranges follow
    id, time and session, so a busy id takes as many files as it needs. Without ``files``
    a range has about ``ROWS_PER_FILE`` rows.
    """
    files = files or max(1, ceil(trxn.count() / ROWS_PER_FILE))
    ranged = trxn.repartitionByRange(files, *CLUSTER_KEYS)
    return ranged.sortWithinPartitions(*CLUSTER_KEYS)


def import_tables(
    spark: SparkSession, csv_paths: dict[str, str], folder: str, files: int | None = None
) -> None:
    """Load CSV files once as Parquet: dimension cleaned, transactions clustered by id."""
    for table, path in csv_paths.items():
        df = read_csv(spark, path, TABLES[table])
        if table == DIMENSION:
            df = clean_codes(df)
        elif TABLES[table] is TRANSACTIONS:
            df = cluster_by_id(df, files)
        df.write.mode("overwrite").parquet(f"{folder}/{table}")


def _stored_print(spark: SparkSession, path: str) -> str | None:
    """What the cache was built from; None if it was never finished."""
    try:
        row = spark.read.schema("fingerprint string").json(path).first()
    except AnalysisException:
        return None
    return row and row["fingerprint"]


def cached_features(
    spark: SparkSession,
    folder: str,
    spec: DatasetSpec,
    build: Callable[[], DataFrame],
    cache: bool = True,
    fmt: str = "parquet",
    fingerprint: str = "",
) -> DataFrame:
    """The stored feature matrix if it is complete, else build, store and read it.

    ``fingerprint`` tells the inputs apart; a matrix of other inputs is built anew. It is
    written last, so a matrix without it was not finished.
    """
    path = f"{folder}/{spec.features}.{fmt}"
    mark = f"{folder}/{spec.features}.print"
    if not (cache and _stored_print(spark, mark) == fingerprint):
        build().write.mode("overwrite").option("header", True).format(fmt).save(path)
        spark.createDataFrame([(fingerprint,)], "fingerprint string").write.mode("overwrite").json(mark)
    stored = spark.read.option("header", True).format(fmt).load(path)
    if fmt != "csv":
        return stored
    # The columns depend on the dimension, their types only on the name.
    types = {"id": "bigint", "var_rpta": "int"}
    schema = ", ".join(f"`{c}` {types.get(c, 'double')}" for c in stored.columns)
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def inputs_fingerprint(inputs: Inputs) -> str:
    """The data files that the inputs are read from; every import writes new names."""
    names = sorted(f for df in (inputs.transactions, inputs.labels, inputs.dimension) for f in df.inputFiles())
    return sha256("\n".join(names).encode()).hexdigest()


def split_columns(matrix: DataFrame) -> tuple[list[str], str | None]:
    """Feature columns and the label column (None without one), by name."""
    label = "var_rpta" if "var_rpta" in matrix.columns else None
    return [c for c in matrix.columns if c not in ("id", "var_rpta")], label


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores per id as CSV files with a header, one file per partition."""
    write_csv(scores.select("id", "probabilidad"), path)
