"""Declarative table catalogue with a build policy, tolerant scans and change tokens."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Forbidden(PermissionError):
    """The build may not read this path."""


@dataclass(frozen=True)
class TableSpec:
    """A table: path below the root (may be a glob), format, the builds that may read it, reader options."""

    path: str
    kind: str = "parquet"
    builds: tuple[str, ...] = ("open", "research")
    options: dict = field(default_factory=dict)


class Catalog:
    """Tables under ``root`` as a build sees them. Paths may lie in any file system that Spark reads."""

    RESTRICTED = "research"

    def __init__(self, spark: SparkSession, root: str, specs: dict[str, TableSpec], build: str = "open"):
        self.spark, self.root, self.specs, self.build = spark, root.rstrip("/"), specs, build

    def path(self, key: str) -> str:
        spec = self.specs[key]
        full = f"{self.root}/{spec.path}"
        parts = spec.path.split("/")
        if ".." in parts or self.build not in spec.builds or (self.build == "open" and self.RESTRICTED in parts):
            raise Forbidden(f"the {self.build} build may not read {key}")
        return full

    def _statuses(self, key: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(key))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(path)
        out = []
        for s in found or []:
            out += list(fs.listStatus(s.getPath())) if s.isDirectory() else [s]
        return [s for s in out if not s.getPath().getName().startswith(("_", "."))]

    def exists(self, key: str) -> bool:
        return bool(self._statuses(key))

    def signature(self, key: str) -> tuple[int, int]:
        """(newest modification time in ms, number of files): changes when the table does."""
        found = self._statuses(key)
        return max((s.getModificationTime() for s in found), default=0), len(found)

    def read(self, key: str, columns: list[str] | None = None) -> DataFrame:
        """The table; wanted columns that it lacks are skipped."""
        spec, path = self.specs[key], self.path(key)
        reader = self.spark.read.options(**spec.options)
        if spec.kind == "parquet":
            df = reader.option("mergeSchema", "*" in spec.path).parquet(path)
        elif spec.kind == "csv":
            df = reader.csv(path, header=True, inferSchema=False, nullValue="")
        elif spec.kind == "jsonl":
            df = reader.json(path, mode="PERMISSIVE")
        elif spec.kind == "json":
            df = reader.json(path, multiLine=True)
        elif spec.kind == "text":
            df = reader.text(path)
        else:
            raise ValueError(f"unknown kind {spec.kind}")
        return df.select(*[c for c in columns if c in df.columns]) if columns else df

    def rows(self, key: str) -> int:
        """Row count; Parquet answers from its footers."""
        return self.read(key).count()

    def register(self) -> list[str]:
        """Temporary views of all tables that exist and may be read; their names."""
        names = []
        for key in self.specs:
            try:
                if self.exists(key):
                    self.read(key).createOrReplaceTempView(key)
                    names.append(key)
            except Forbidden:
                continue
        return names


def geojson_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Point features of a GeoJSON document: lon, lat and ``properties`` (a DDL string)."""
    shape = f"features array<struct<geometry: struct<type: string, coordinates: array<double>>, properties: struct<{properties}>>>"
    doc = spark.read.schema(shape).json(path, multiLine=True)
    f = doc.select(F.explode("features").alias("f")).where("f.geometry.type = 'Point'")
    return f.select(F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"), "f.properties.*")


def replay(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Recorded JSON lines, gzip or not; lines that do not parse are kept in _bad with null fields."""
    lines = spark.read.text(path)
    return lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")


def decimal_comma_csv(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """Semicolon CSV whose numbers have decimal commas."""
    df = spark.read.csv(path, sep=";", header=True, inferSchema=False, nullValue="")
    return df.withColumns({c: F.regexp_replace(F.col(c), ",", ".").try_cast("double") for c in numbers})


def write_parts(df: DataFrame, path: str, rows: int) -> None:
    """Parquet in files of at most ``rows`` rows."""
    df.write.option("maxRecordsPerFile", rows).mode("overwrite").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append to a JSON-lines log."""
    df.write.mode("append").json(path)


def merge_partition(df: DataFrame, path: str, keys: list[str], order: list[str], partitions: list[str]) -> None:
    """Merge rows into a partitioned table: of equal keys the last in order stays, and only the partitions that ``df`` touches are replaced, each as a whole."""
    spark = df.sparkSession
    touched = df.select(*partitions).distinct()
    try:
        old = spark.read.schema(df.schema).option("basePath", path).parquet(path).join(touched, partitions, "left_semi")
        both = old.select(*df.columns).unionByName(df)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        both = df
    merged = both.groupBy(*keys, *(p for p in partitions if p not in keys)).agg(F.max_by(F.struct(*(c for c in df.columns if c not in keys and c not in partitions)), F.struct(*order)).alias("_r"))
    rest = [c for c in df.columns if c not in keys and c not in partitions]
    out = merged.select(*keys, *(p for p in partitions if p not in keys), *(F.col(f"_r.{c}") for c in rest)).select(*df.columns)
    from pelagos.storage import discard, materialise

    staged = materialise(out, "merged")  # the table is read and replaced, so what replaces it is written first
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
    discard(staged)


def load_static(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All static messages, each content once, with its latest time."""
    df = spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path)
    return df.groupBy(*(c for c in df.columns if c != "seen")).agg(F.max("seen").alias("seen"))


def export_table(df: DataFrame, path: str, kind: str, notes: dict[str, str]) -> None:
    """Records with the caveat and licence as constant columns, as CSV, JSON lines or an HTML page of at most 10,000 rows (more are an error)."""
    out = df.withColumns({k: F.lit(x) for k, x in notes.items()})
    if kind == "csv":
        out.write.mode("overwrite").csv(path, header=True)
    elif kind == "jsonl":
        out.write.mode("overwrite").json(path)
    elif kind == "html":
        if out.limit(10_001).count() > 10_000:
            raise ValueError("too many rows for a page")
        safe = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "&", "&amp;"), "<", "&lt;")
        rows = out.select(F.concat(F.lit("<tr>"), *(x for c in out.columns for x in (F.lit("<td>"), safe(c), F.lit("</td>"))), F.lit("</tr>")).alias("value"))
        head = df.sparkSession.createDataFrame([("<table><tr>" + "".join(f"<th>{c}</th>" for c in out.columns) + "</tr>",)], "value string")
        head.unionByName(rows).coalesce(1).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown kind {kind}")
