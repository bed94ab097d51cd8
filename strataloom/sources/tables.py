"""Tables of texts: scans and sinks by format, with options inside file names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.operators.columns import project, renames

SUFFIXES = {
    "tsv": "tsv", "tab": "tsv", "txt": "tsv", "dat": "tsv", "csv": "csv", "parquet": "parquet", "json": "json", "orc": "orc",
    "db": "sqlite", "sqlite": "sqlite", "xls": "excel", "xlsx": "excel", "dta": "stata", "bed": "tsv",
}
_PACKED = ("gz", "bz2", "zst")
#: Options of delimited formats and the reader's own names for them.
_DIALECT = {"delimiter": "sep", "quotechar": "quote", "escapechar": "escape", "skipinitialspace": "ignoreLeadingWhiteSpace"}


def parse_name(name: str) -> tuple[str, dict[str, str]]:
    """``path:key=value:flag`` as the path and its options; a scheme's colon is no option."""
    scheme, mark, rest = name.partition("://")
    head, *options = (rest if mark else name).split(":")
    pairs = [o.partition("=") for o in options]
    return (f"{scheme}://{head}" if mark else head), {k: v for k, eq, v in pairs if k or eq}


def guess_format(path: str, default: str = "tsv") -> str:
    parts = path.rsplit("/", 1)[-1].lower().split(".")[1:]
    while parts and parts[-1] in _PACKED:
        parts.pop()
    return SUFFIXES.get(parts[-1], default) if parts else default


def related(path: str, extension: str) -> str:
    """The path with another extension, compression removed."""
    return re.sub(r"(\.(?:gz|bz2|zst))?$", "", re.sub(r"\.[^./]+((?:\.(?:gz|bz2|zst))?)$", rf".{extension}\1", path))


def _unescape(value: str) -> str:
    return value.encode().decode("unicode_escape") if "\\" in value else value


def _clean(df: DataFrame) -> DataFrame:
    """All cells as trimmed texts, blank where absent."""
    return df.select(*[F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c.strip()) for c in df.columns])


def read_table(spark: SparkSession, name: str, header: bool = True, clean: bool = True, **options) -> DataFrame:
    """Scan by format (option or suffix, tab-separated by default) with columns, drop, rename, header and skip applied in the scan."""
    path, inline = parse_name(name)
    o = {**inline, **{k: v for k, v in options.items() if v is not None}}
    kind = o.pop("format", None) or guess_format(path)
    names, skip = o.pop("header", None), int(o.pop("skip", 0))
    wanted = {k: o.pop(k, None) for k in ("columns", "drop", "rename")}
    if kind in ("tsv", "csv"):
        extra = {_DIALECT.get(k, k): _unescape(v) for k, v in o.items()}
        extra.setdefault("sep", "\t" if kind == "tsv" else ",")
        df = spark.read.options(header=str(header and not names), enforceSchema="false", **extra).csv(path)
    elif kind in ("parquet", "json", "orc"):
        df = getattr(spark.read, kind)(path)
    else:
        df = _local(spark, path, kind, o)
    if skip:
        numbered = df.withColumn("__at", F.monotonically_increasing_id())  # the first rows of the first file's first split
        df = numbered.where(F.col("__at") >= skip).drop("__at")
    if names:
        df = df.toDF(*(names.split(",") if isinstance(names, str) else names))
    df = _clean(df) if clean else df
    return project(df, **wanted)


def _local(spark: SparkSession, path: str, kind: str, o: dict) -> DataFrame:
    """Small single-file formats, read on the driver by pandas where its engine is installed."""
    import pandas as pd

    local = path.removeprefix("file://")
    if kind == "sqlite":
        import sqlite3

        if ("table" in o) == ("query" in o):
            raise ValueError("a SQLite source needs either a table or a query")
        with sqlite3.connect(f"file:{local}?mode=ro", uri=True) as con:
            sql = o["query"] if "query" in o else 'SELECT * FROM "' + o["table"].replace('"', '""') + '"'
            pdf = pd.read_sql_query(sql, con)
    elif kind == "excel":
        sheet = o.get("sheet", 0)
        pdf = pd.read_excel(local, sheet_name=int(sheet) - 1 if str(sheet).isdigit() else sheet, dtype=str)
    elif kind == "stata":
        pdf = pd.read_stata(local, convert_categoricals=False)
    else:
        raise ValueError(f"no table format named {kind!r}")
    texts = pdf.astype(object).where(pdf.notna(), None).map(lambda x: None if x is None else str(x))
    schema = ", ".join(f"`{c}` string" for c in pdf.columns)
    return spark.createDataFrame(texts.values.tolist(), schema)


def write_table(df: DataFrame, name: str, **options) -> None:
    """Sink by format, with the scan's projection options. Delimited sinks write a folder of parts."""
    path, inline = parse_name(name)
    o = {**inline, **options}
    kind = o.pop("format", None) or guess_format(path)
    df = project(df, **{k: o.pop(k, None) for k in ("columns", "drop", "rename")})
    if "maxrows" in o:
        o["maxRecordsPerFile"] = o.pop("maxrows")
    if kind in ("tsv", "csv"):
        sep = _unescape(o.pop("delimiter", "\t" if kind == "tsv" else ","))
        df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]).write.options(header="true", sep=sep, emptyValue="", **o).csv(path)
    elif kind in ("parquet", "json", "orc"):
        getattr(df.write.options(**o), kind)(path)
    elif kind == "sqlite":
        import sqlite3

        table = o.get("table", "data").replace('"', '""')
        quoted = ", ".join('"' + c.replace('"', '""') + '"' for c in df.columns)
        with sqlite3.connect(path.removeprefix("file://")) as con:
            con.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({quoted})')
            con.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(df.columns))})', (tuple(r) for r in df.toLocalIterator()))
    elif kind == "excel":
        df.toPandas().to_excel(path.removeprefix("file://"), index=False)
    else:
        raise ValueError(f"no table format named {kind!r}")


def read_list(spark: SparkSession, name: str, **options) -> DataFrame:
    """One column of values that are not blank; ``:a,b,c`` is the list itself."""
    if name.startswith(":"):
        return spark.createDataFrame([(v.strip(),) for v in name[1:].split(",") if v.strip()], "value string")
    df = read_table(spark, name, **options)
    return df.select(F.col(f"`{df.columns[0]}`").alias("value")).where("value <> ''")


def read_map(spark: SparkSession, name: str, default: str | None = None, **options) -> DataFrame:
    """Two columns key, value; a blank value is the default, or the key. ``:k=v,k2=v2`` is the map itself."""
    if name.startswith(":"):
        df = spark.createDataFrame(list(renames(name[1:]).items()), "key string, value string")
    else:
        t = read_table(spark, name, **options)
        df = t.select(F.col(f"`{t.columns[0]}`").alias("key"), F.col(f"`{t.columns[1]}`").alias("value"))
    return df.where("key <> ''").withColumn("value", F.when(F.col("value") == "", F.lit(default) if default is not None else F.col("key")).otherwise(F.col("value")))


def read_sections(spark: SparkSession, path: str, keep: list[str] | None = None, drop: list[str] = ()) -> DataFrame:
    """(section, number, at, fields) of a text in ``[heading]`` sections. Such files are small; their lines are numbered in one task."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    w = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.nullif(F.regexp_extract("line", r"^\s*\[([^\]]+)\]\s*$", 1), F.lit(""))
    marked = lines.withColumn("heading", heading).withColumns({
        "section": F.last("heading", True).over(w), "number": F.sum(F.when(F.col("heading").isNotNull(), 1).otherwise(0)).over(w),
    })
    body = marked.where("heading IS NULL AND section IS NOT NULL AND trim(line) <> ''").select("section", "number", "at", F.split("line", "\t").alias("fields"))
    if keep is not None:
        body = body.where(F.col("section").isin(list(keep)))
    return body.where(~F.col("section").isin(list(drop))) if drop else body
