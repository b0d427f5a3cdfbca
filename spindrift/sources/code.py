"""Import scans of source trees: relative imports resolved to files, and the packages that manifests name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of source files, and folders that a scan skips beside those that begin with a dot.
EXTENSIONS = ("ts", "js", "tsx", "jsx", "py", "java", "kt", "rs")
SKIPPED = ("node_modules", "dist", "build")
#: Folders below the root that are looked into.
DEPTH = 5
#: What an import may leave out, in the order in which it is tried.
ENDINGS = ("ts", "tsx", "js", "jsx", "py")
#: An import of compiled output may mean its source.
COMPILED = {"js": ("ts", "tsx"), "jsx": ("tsx",)}
IMPORT = r"(?:\bimport\b[^'\";]*?\bfrom\s*|\bimport\s*\(?\s*|\bexport\b[^'\";]*?\bfrom\s*|\brequire\s*\(\s*)['\"](\.[^'\"\n]*)['\"]"


def folded(path: Column) -> Column:
    """A path without empty and . segments and with each .. taken back; those that would leave the root stay at its front."""
    def step(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        back = (part == "..") & (F.size(done) > 0) & (F.when(F.size(done) > 0, last).otherwise("") != "..")
        return F.when((part == "") | (part == "."), done).when(back, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def files(spark: SparkSession, root: str, depth: int = DEPTH, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, from the root, and value of source files outside skipped folders. Spark reads no file without bytes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(where).toString().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(extensions)}}}").load(root)
    rows = found.select(F.col("path").substr(F.lit(len(top) + 1), F.length("path")).alias("path"), F.col("content").cast("string").alias("value"))
    parts = F.split("path", "/")
    skipped = F.exists(parts, lambda p: p.startswith(".") | p.isin(*SKIPPED))
    return rows.filter(~skipped & (F.size(parts) <= depth + 1))


def candidates(target: Column) -> Column:
    """Files that an import may mean, best first."""
    named = [F.concat(target, F.lit(f".{e}")) for e in ENDINGS]
    inside = [F.concat(target, F.lit(f"/index.{e}")) for e in ENDINGS]
    ending = F.regexp_extract(target, r"\.(\w+)$", 1)
    source = [F.when(ending == old, F.regexp_replace(target, r"\.\w+$", f".{new}")) for old, news in COMPILED.items() for new in news]
    return F.array_compact(F.array(target, *named, *source, *inside))


def imports(sources: DataFrame) -> DataFrame:
    """(path, written, target, resolved) for each distinct relative import of (path, value) rows.

    target is the file that it means, the first candidate that is among the rows, or the folded path where none is.
    """
    written = F.array_distinct(F.regexp_extract_all("value", F.lit(IMPORT), F.lit(1)))
    rows = sources.select("path", F.explode(written).alias("written"))
    folder = F.regexp_replace("path", "[^/]*$", "")
    rows = rows.withColumn("_aim", folded(F.concat(folder, "written")))
    tried = rows.select("path", "written", "_aim", F.posexplode(candidates(F.col("_aim"))).alias("_place", "_file"))
    known = sources.select(F.col("path").alias("_file"))
    hits = tried.join(known, "_file", "left_semi").groupBy("path", "written").agg(F.min_by("_file", "_place").alias("_found"))
    return rows.join(hits, ["path", "written"], "left").select("path", "written", F.coalesce("_found", "_aim").alias("target"), F.col("_found").isNotNull().alias("resolved"))


def packages(docs: DataFrame) -> DataFrame:
    """(project, package) of manifests in a column doc: their dependencies of both kinds. A manifest that is no JSON object gives none."""
    names = [F.coalesce(F.map_keys(F.from_json(F.get_json_object("doc", f"$.{k}"), "map<string,string>")), F.array().cast("array<string>"))
             for k in ("dependencies", "devDependencies")]
    project = F.coalesce(F.get_json_object("doc", "$.name"), F.lit("project"))
    return docs.select(project.alias("project"), F.explode(F.array_union(*names)).alias("package"))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "doc")
