"""Readers, writers and sources.  Everything is read by Spark, so that any store that Spark knows will do."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillon.operators.facets import row_numbers


def read_json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON document a file, with a stated schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of files that hold a map from key to value of the given type."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_shards(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Shards by glob; documents that can't be read are skipped and named in ``_corrupt``."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    kind = T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])
    df = spark.read.schema(kind).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.withColumn("shard", F.col("_metadata.file_name"))


def write_atomically(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Overwrite by Spark's committer: readers see the old files or the new ones."""
    df.write.mode("overwrite").format(fmt).save(path)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(line, title, year) of lines ``Title (Year)``; blank lines and # comments don't count."""
    x = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' AND NOT line LIKE '#%'")
    return parse_seed(x)


def parse_seed(lines: DataFrame) -> DataFrame:
    pattern = r"^(.*?)\s*\((\d{4})\)\s*$"
    year = F.regexp_extract("line", pattern, 2)
    return lines.select("line", F.when(year != "", F.regexp_extract("line", pattern, 1)).otherwise(F.col("line")).alias("title"), F.when(year != "", year.cast("int")).alias("year"))


def read_tsv(spark: SparkSession, path: str, schema: str, comment: str = "#") -> DataFrame:
    """Tab-separated rows, gzip or plain."""
    return spark.read.schema(schema).option("sep", "\t").option("comment", comment).option("quote", "\u0000").csv(path)


def read_cohort(spark: SparkSession, path: str) -> DataFrame:
    """(key) of a file with a key a line."""
    return spark.read.text(path).select(F.trim("value").alias("key")).where("key <> '' AND NOT key LIKE '#%'").distinct()


def write_cohort(df: DataFrame, key: str, path: str) -> None:
    df.select(F.col(key).cast("string")).distinct().write.mode("overwrite").text(path)


def property_rows(claims: DataFrame, properties: list[str]) -> DataFrame:
    """Rows of a long claim table for some properties."""
    return claims.where(F.col("property").isin(properties))


MINUTES = {"minute": 1.0, "hour": 60.0, "second": 1 / 60.0}


def durations(claims: DataFrame, units: dict[str, float] = MINUTES) -> DataFrame:
    """(entity, minutes): deprecated claims out, units to minutes, preferred rank first, lower median of distinct values."""
    unit = F.create_map(*(F.lit(x) for kv in units.items() for x in kv))
    x = claims.where("rank <> 'deprecated'").withColumn("minutes", F.round(F.col("amount") * unit[F.col("unit")], 3)).where("minutes > 0")
    best = x.withColumn("top", F.max(F.when(F.col("rank") == "preferred", 1).otherwise(0)).over(Window.partitionBy("entity"))).where("top = 0 OR rank = 'preferred'")
    s = F.array_sort(F.collect_set("minutes"))
    return best.groupBy("entity").agg(F.element_at(s, (F.floor((F.size(s) - 1) / 2) + 1).cast("int")).alias("minutes"))


def extend(known: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Known rows with new columns filled from a fresh scan where they have none yet."""
    have = [c for c in columns if c in known.columns]
    f = fresh.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = known.join(f, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_{c}")) if c in have else F.col(f"_{c}"))
    return out.drop(*(f"_{c}" for c in columns))


def stamped_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """(key, batch): distinct keys in order, ``size`` to a batch."""
    return row_numbers(df.select(key).distinct(), key).select(key, F.floor(F.col("row") / size).alias("batch"))


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """(batch, keys): requests of ``size`` keys."""
    return stamped_batches(df, key, size).groupBy("batch").agg(F.array_sort(F.collect_list(key)).alias("keys"))


def best_counts(titles: DataFrame, title: str, variants: Column, counts: DataFrame) -> DataFrame:
    """(title, variant, n): of a title's spelling variants the one with most hits in (query, n), ties to the first; titles without hits are left out."""
    tried = titles.select(title).distinct().select(title, F.posexplode(variants).alias("place", "query"))
    hits = tried.join(counts, "query")
    return hits.groupBy(title).agg(F.max_by(F.struct(F.col("query").alias("variant"), "n"), F.struct("n", -F.col("place"))).alias("x")).select(title, "x.*")


def follow_redirects(names: DataFrame, redirects: DataFrame, hops: int = 5) -> DataFrame:
    """(name, target): aliases followed for up to ``hops`` steps."""
    out = names.select("name", F.col("name").alias("target"))
    for _ in range(hops):
        out = out.join(redirects.select(F.col("source").alias("target"), "to"), "target", "left").select("name", F.coalesce("to", "target").alias("target"))
    return out


def summed_views(views: DataFrame, start: str, days: int) -> DataFrame:
    """(title, views): daily counts summed over a window of days that begins at ``start``."""
    first = F.to_date(F.lit(start))
    return views.where((F.col("day") >= first) & (F.col("day") < F.date_add(first, days))).groupBy("title").agg(F.sum("views").alias("views"))


def modal_window(windows: DataFrame) -> DataFrame:
    """(start, n): the most common start of cached windows, ties to the latest."""
    n = windows.groupBy("start").agg(F.count("*").alias("n"))
    return n.agg(F.max_by("start", F.struct("n", "start")).alias("start"), F.max("n").alias("n"))


# First bytes of image files, in hexadecimal; for webp also those from the ninth on.
MAGIC = {"jpeg": ("ffd8ff", ""), "png": ("89504e470d0a1a0a", ""), "gif87a": ("474946383761", ""), "gif89a": ("474946383961", ""), "webp": ("52494646", "57454250"), "bmp": ("424d", "")}


def image_kind(content: Column) -> Column:
    """Kind of an image by its first bytes, or null."""
    h, out = F.lower(F.hex(F.substring(content, 1, 12))), F.lit(None).cast("string")
    for name, (first, ninth) in MAGIC.items():
        out = F.when(h.startswith(first) & F.substring(h, 17, 8).startswith(ninth), name[:3] if name.startswith("gif") else name).otherwise(out)
    return out


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, kind) of files that are images by content."""
    return spark.read.format("binaryFile").load(path).select("path", "content", image_kind(F.col("content")).alias("kind")).where("kind IS NOT NULL")


def read_passages(spark: SparkSession, path: str, gate: str, schema: str) -> DataFrame:
    """A table that may only be read if the gate before it passed; raises otherwise."""
    passed = spark.read.schema("passed boolean").option("multiLine", True).json(gate).agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("ok")).first()["ok"]
    if not passed:
        raise ValueError(f"the gate at {gate} did not pass")
    return spark.read.schema(schema).json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Chunk vectors (entity, chunk_no, vector) as Parquet."""
    df.select("entity", "chunk_no", F.col("vector").cast("array<float>")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("entity string, chunk_no int, vector array<float>").parquet(path)


def parse_safetensors(content: bytes) -> dict[str, tuple[list[int], bytes]]:
    """Names, shapes and raw data of a safetensors file."""
    n = int.from_bytes(content[:8], "little")
    head = json.loads(content[8 : 8 + n])
    return {k: (v["shape"], content[8 + n + v["data_offsets"][0] : 8 + n + v["data_offsets"][1]]) for k, v in head.items() if k != "__metadata__"}


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    """Pages of a remote source, a few to a task, each retried."""

    def __init__(self, options: dict, fetch: Callable[[int], Iterable[tuple[str, str]]]):
        self.options, self.fetch = options, fetch

    def partitions(self):
        n, each = int(self.options.get("pages", 1)), int(self.options.get("pages_per_task", 4))
        return [Pages(i, min(i + each, n)) for i in range(0, n, each)]

    def read(self, partition):
        for page in range(partition.first, partition.last):
            yield from with_retry(lambda p=page: list(self.fetch(p)), int(self.options.get("retries", 3)), float(self.options.get("wait", 0.0)))


def with_retry(call: Callable, times: int = 3, wait: float = 1.0):
    """The call's result; it is tried again after growing waits, and the last failure is raised."""
    for i in range(times):
        try:
            return call()
        except (OSError, ValueError):
            if i == times - 1:
                raise
            time.sleep(wait * 2**i)


def paged_source(name: str, fetch: Callable[[int], Iterable[tuple[str, str]]]) -> type[DataSource]:
    """A data source named ``name`` whose rows (key, payload) come from ``fetch(page)``: remote entity, label, wikitext, page and search APIs are such functions."""
    source = name

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return source

        def schema(self):
            return "key string, payload string"

        def reader(self, schema):
            return PagedReader(dict(self.options), fetch)

    return Paged


def fenced_json(reply: Column, schema: str) -> Column:
    """The JSON of a reply that may stand in a code fence or in prose."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract(reply, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(bare), schema)


def html_artifact(template: str, parts: dict[str, str]) -> str:
    """A page with markers ``<!--name-->`` replaced; raises on markers that are missing."""
    for name, text in parts.items():
        marker = f"<!--{name}-->"
        if marker not in template:
            raise ValueError(f"no marker {marker}")
        template = template.replace(marker, text)
    return template


