"""Readers of exports, lexicons, gazetteers, caches and boundaries, and careful writers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from terralex.functions.geo import read_wkb

#: Columns of a gazetteer file.
GAZETTEER = ["geonameid", "name", "asciiname", "alternatenames", "latitude", "longitude", "feature_class", "feature_code", "country_code", "cc2", "admin1_code", "admin2_code", "admin3_code", "admin4_code", "population", "elevation", "dem", "timezone", "modification_date"]
_CONTROL = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+)\s?\??|\\([a-z]+)(-?\d+)? ?|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
_SKIPPED = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "themedata", "listtable", "generator", "header", "footer"}


def rtf_text(data: bytes) -> str:
    """The text of an RTF file: groups of tables and pictures skipped, paragraphs and tabs kept."""
    source = decoded(data)
    out: list[str] = []
    stack: list[bool] = []
    skip = False
    for code, point, word, _, sign, brace, plain in _CONTROL.findall(source):
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif sign == "*" or word in _SKIPPED:
            skip = True
        elif skip:
            continue
        elif code:
            out.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif point:
            out.append(chr(int(point) % 65536))
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif sign:
            out.append(sign if sign in "\\{}" else " " if sign == "~" else "")
        else:
            out.append(plain)
    return "".join(out)


def decoded(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252")


#: Turns the content of a PDF into the texts of its pages; none comes with this package.
Pages = Callable[[bytes], list[str]]


def pdf_text(data: bytes, pages: Pages) -> str:
    """Pages without lines that only count them, with an empty line between."""
    kept = ("\n".join(line for line in page.splitlines() if not re.fullmatch(r"(?i)\s*page \d+ of \d+\s*", line)).strip() for page in pages(data))
    return "\n\n".join(p for p in kept if p)


def exports(spark: SparkSession, folder: str, pages: Pages | None = None) -> DataFrame:
    """path, source_id, relative path and folder, text of all .rtf files below a folder (and .pdf files, given a reader of pages), without document lists."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.where(F.lower("path").rlike(r"\.(rtf|pdf)$" if pages else r"\.rtf$") & ~F.lower("path").rlike("doclist[^/]*$"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "text": [pdf_text(bytes(c), pages) if p.lower().endswith(".pdf") else rtf_text(bytes(c)) for p, c in zip(f["path"], f["content"], strict=True)]})

    rows = files.select("path", "content").mapInPandas(run, "path string, text string")
    return rows.select("path", source_id(F.col("path")).alias("source_id"), *source_parts(F.col("path"), folder), "text")


def source_parts(path: Column, folder: str) -> list[Column]:
    """relative_path and folder of a path below a root; the root itself is an empty folder."""
    root = re.sub(r"^file:/*", "/", folder).rstrip("/")
    relative = F.regexp_replace(F.regexp_replace(path, "^file:/*", "/"), "^" + re.escape(root) + "/+", "")
    return [relative.alias("relative_path"), F.regexp_extract(relative, r"^(.*)/[^/]*$", 1).alias("folder")]


def source_id(path):
    """A safe stem of at most 90 characters and ten of the path's hash."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1), r"[^A-Za-z0-9._-]+", "_")
    return F.concat(F.substring(stem, 1, 90), F.lit("-"), F.substring(F.sha1(path.cast("binary")), 1, 10))


def csv_files(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of CSV files of one declared schema."""
    return spark.read.csv(paths, schema=schema, header=True, multiLine=True, escape='"')


def sniffed_separator(head: str) -> str:
    return max(";,\t", key=lambda c: (head.count(c), -";,\t".index(c)))


def keyword_table(spark: SparkSession, data: bytes) -> DataFrame:
    """frame, frame_pos, keyword, keyword_pos of a ragged CSV with a column for each frame."""
    text = decoded(data)
    wide = pd.read_csv(io.StringIO(text), sep=sniffed_separator(text.split("\n", 1)[0]), dtype=str)
    rows = []
    for i, c in enumerate(c for c in wide.columns if not c.startswith("Unnamed")):
        words = list(dict.fromkeys(w.strip() for w in wide[c].dropna() if w.strip()))
        rows += [(c.strip(), i, w, j) for j, w in enumerate(words)]
    return spark.createDataFrame(rows, "frame string, frame_pos int, keyword string, keyword_pos int")


def lexicon(data: str) -> dict[str, list[str]]:
    """A YAML lexicon with exactly the lists strong, contextual and competing; trimmed, first of equals kept."""
    v = yaml.safe_load(data)
    if not isinstance(v, dict) or set(v) != {"strong", "contextual", "competing"} or not all(isinstance(x, list) and all(isinstance(w, str) for w in x) for x in v.values()):
        raise ValueError("a lexicon holds the lists strong, contextual and competing")
    return {k: list(dict.fromkeys(w.strip() for w in x if w.strip())) for k, x in v.items()}


def gazetteer(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Entries of gazetteer zips (tab separated) that have coordinates."""
    files = spark.read.format("binaryFile").load(paths)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for c in f["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(c))) as z:
                    for name in z.namelist():
                        if name.endswith(".txt") and "readme" not in name.lower():
                            for part in pd.read_csv(z.open(name), sep="\t", names=GAZETTEER, dtype=str, quoting=3, keep_default_na=False, chunksize=50_000):
                                yield part

    rows = files.select("content").mapInPandas(run, ", ".join(f"{c} string" for c in GAZETTEER))
    numbers = {"latitude": "double", "longitude": "double", "population": "long"}
    return rows.withColumns({c: F.col(c).try_cast(t) for c, t in numbers.items()}).where("latitude is not null and longitude is not null")


def json_cache(spark: SparkSession, paths: list[str], value: str) -> DataFrame:
    """key, value of JSON lines; malformed lines are skipped."""
    rows = spark.read.text(paths).select(F.from_json("value", f"key string, value {value}", {"mode": "PERMISSIVE"}).alias("j"))
    return rows.select("j.key", "j.value").where("key is not null and value is not null")


def boundaries(spark: SparkSession, paths: list[str], level_three: tuple[str, ...] = ("ITA",), supplement: str = "_italian_nuts3.parquet") -> DataFrame:
    """Land regions of the level that each country uses, with rings; fails if a country that needs level 3 has none.

    Beside each path a supplement of its name and the given ending is read too, if there is one.
    """
    more = [p.rstrip("/").removesuffix(".parquet") + supplement for p in paths]
    rows = spark.read.parquet(*paths, *existing(spark, more)).where("shape_class = 'land' and parent = 'nuts'")
    wanted = F.when(F.col("country_id").isin(*level_three), "3").otherwise("2")
    have = [r[0] for r in rows.where("parent_subtype = '3'").select("country_id").distinct().collect()]
    need = [r[0] for r in rows.where(F.col("country_id").isin(*level_three)).select("country_id").distinct().collect()]
    if missing := set(need) - set(have):
        raise ValueError(f"no level 3 boundaries of {sorted(missing)}")

    @F.pandas_udf("array<array<array<double>>>")
    def rings(data: pd.Series) -> pd.Series:
        return data.map(lambda b: [[list(p) for p in ring] for ring in read_wkb(bytes(b))])

    return rows.where(F.col("parent_subtype") == wanted).select("country_id", "parent_id", "parent_name", "parent_subtype", rings("geometry").alias("rings"))


def write_finished(df: DataFrame, path: str, status: str) -> None:
    """Writes CSV unless any row is unfinished, and puts it in place of what was there before by renaming.

    The rows are computed once, into a folder beside the path; a failed or refused write leaves the old result.
    """
    spark = df.sparkSession
    path, new, old = path.rstrip("/"), path.rstrip("/") + ".new", path.rstrip("/") + ".old"
    open_ = F.col(status).isNull() | ~F.col(status).isin("ok", "empty")
    seen = Observation()
    df.observe(seen, F.count(F.when(open_, 1)).alias("unfinished")).write.mode("overwrite").csv(new, header=True)
    at = {p: spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old)}
    files = at[path].getFileSystem(spark._jsc.hadoopConfiguration())
    if n := seen.get["unfinished"]:
        files.delete(at[new], True)
        raise ValueError(f"{n} rows are unfinished")
    files.delete(at[old], True)
    if files.exists(at[path]):
        files.rename(at[path], at[old])
    files.rename(at[new], at[path])
    files.delete(at[old], True)


def features(spark: SparkSession, paths: list[str], country: str = "IT", level: int = 3, expected: int | None = None) -> DataFrame:
    """id, name, rings of the areas of one country and level in GeoJSON files; without geometry they go. Fails on repeated ids, or another number than expected."""
    shape = "struct<type: string, coordinates: string>"
    rows = spark.read.schema(f"features array<struct<properties: struct<CNTR_CODE: string, LEVL_CODE: int, NUTS_ID: string, NUTS_NAME: string>, geometry: {shape}>>").json(paths, multiLine=True)
    rows = rows.select(F.explode("features").alias("f")).where((F.col("f.properties.CNTR_CODE") == country) & (F.col("f.properties.LEVL_CODE") == level))
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("f.geometry.type") == "Polygon", one).when(F.col("f.geometry.type") == "MultiPolygon", many)
    out = rows.select(F.col("f.properties.NUTS_ID").alias("id"), F.col("f.properties.NUTS_NAME").alias("name"), rings.alias("rings")).where("size(rings) > 0")
    n, distinct = out.agg(F.count("*"), F.countDistinct("id")).first()
    if n != distinct or (expected is not None and n != expected):
        raise ValueError(f"{n} areas, {distinct} distinct; expected {expected}")
    return out


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the files that exist and aren't empty."""
    conf = spark._jsc.hadoopConfiguration()
    at = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return [p for p, x in zip(paths, at, strict=True) if (fs := x.getFileSystem(conf)).exists(x) and (fs.getFileStatus(x).isDirectory() or fs.getFileStatus(x).getLen())]


def many_csv(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of those of the CSV files that exist and hold anything."""
    found = existing(spark, paths)
    return csv_files(spark, found, schema) if found else spark.createDataFrame([], schema)


def override_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV as text with all the given columns; missing ones are empty, a missing or empty file has no rows."""
    if not existing(spark, [path]):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns))


def geocoder_cache(spark: SparkSession, paths: list[str]) -> DataFrame:
    """key, lat, lon, name, provider of JSON lines of a geocoder's answers: malformed lines and other statuses than ok are skipped, of a key the last counts."""
    kind = "key string, query string, country_codes string, provider string, status string, result struct<lat: string, lon: string, disp: string, provider: string>"
    rows = spark.read.text(paths).select(F.monotonically_increasing_id().alias("seq"), F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("j"))
    rows = rows.where("j.status = 'ok' and j.result is not null")
    key = F.coalesce(F.nullif(F.col("j.key"), F.lit("")), F.concat(F.trim(F.coalesce("j.query", F.lit(""))), F.lit("||"), F.coalesce("j.country_codes", F.lit(""))))
    rows = rows.select(key.alias("key"), "seq", F.struct(F.col("j.result.lat").try_cast("double").alias("lat"), F.col("j.result.lon").try_cast("double").alias("lon"), F.col("j.result.disp").alias("name"), F.coalesce("j.result.provider", "j.provider", F.lit("geocoder")).alias("provider")).alias("v"))
    return rows.groupBy("key").agg(F.max_by("v", "seq").alias("v")).select("key", "v.*")


def merged_patterns(defaults: list[str], file_text: str = "", configured: list[str] | None = None) -> list[str]:
    """Patterns of the defaults, a file (a line each, # begins a comment) and a configuration; the first of equals stays."""
    lines = (line.strip() for line in file_text.splitlines())
    return list(dict.fromkeys([*defaults, *(x for x in lines if x and not x.startswith("#")), *(x.strip() for x in configured or [] if x.strip())]))


def checked_documents(spark: SparkSession, path: str, key: str, columns: list[str], sha256: str | None = None) -> DataFrame:
    """Chosen columns of a table of documents, one row for each key; fails if the ids aren't those that a checksum was taken of."""
    rows = spark.read.parquet(path).select(key, *columns).dropDuplicates([key])
    if sha256 is not None:
        found = rows.agg(F.sha2(F.bit_xor(F.xxhash64(key)).cast("string"), 256)).first()[0]
        if found != sha256:
            raise ValueError(f"the documents of {path} have changed: {found}")
    return rows


def write_layers(df: DataFrame, path: str, point: str, polygon: str) -> None:
    """Two tables below a path: rows with a polygon, and rows with a point only; rows with neither are in none."""
    says = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    df.where(says(polygon)).write.mode("overwrite").parquet(f"{path.rstrip('/')}/polygons")
    df.where(says(point) & ~says(polygon)).write.mode("overwrite").parquet(f"{path.rstrip('/')}/points")


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def decimal_comma(df: DataFrame) -> DataFrame:
    """Floating-point columns written with a decimal comma; write with sep=';'."""
    return df.select(*(F.translate(F.col(c).cast("string"), ".", ",").alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
