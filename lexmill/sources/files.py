"""Directories of text and code as tables of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal_path, suffix

_SUFFIXES = {
    "bash": "fish zsh bash sh", "batch": "cmd bat", "c": "h c", "clojure": "clj", "cpp": "hpp cpp", "csharp": "csx cs", "css": "css", "dart": "dart", "docker": "dockerfile", "elixir": "exs ex", "elm": "elm",
    "erlang": "erl", "go": "go", "graphql": "gql graphql", "groovy": "gradle groovy", "haskell": "hs", "hcl": "hcl tf", "html": "htm html", "image": "webp png jpeg jpg gif", "java": "java", "javascript": "jsx cjs mjs js",
    "json": "avsc json", "kotlin": "kts kt", "less": "less", "lisp": "lisp", "lua": "lua", "markdown": "mdx md", "objc": "mm m", "pdf": "pdf", "perl": "pm pl", "php": "php", "powershell": "ps1", "protobuf": "proto",
    "python": "pyw pyi py", "r": "r", "ruby": "rb", "rust": "rs", "sass": "sass", "scala": "scala", "scss": "scss", "sql": "sql", "svelte": "svelte", "swift": "swift", "thrift": "thrift", "toml": "toml",
    "typescript": "tsx ts", "vue": "vue", "xml": "xml", "yaml": "yml yaml",
    "asciidoc": "adoc", "ini": "conf cfg ini", "latex": "tex", "properties": "properties", "rst": "rst",
}
LANGUAGES = {f".{s}": name for name, suffixes in _SUFFIXES.items() for s in suffixes.split()}
MULTIMODAL = [f".{s}" for s in "bmp gif jpeg jpg pdf png tiff webp".split()]
OTHER_TEXT = [f".{s}" for s in "env log txt".split()]
SUPPORTED = sorted({*LANGUAGES, *OTHER_TEXT})
SKIPPED = sorted("vendor obj bin target build dist env venv coverage eggs node_modules __pycache__ *.egg-info".split())
DOCUMENTS = "content string, filepath string, language string, metadata map<string,string>"


def supported(path: Column) -> Column:
    return suffix(path).isin(SUPPORTED)


def language(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(known[suffix(path)], F.lit("text"))


def multimodal(path: Column) -> Column:
    return suffix(path).isin(MULTIMODAL)


def pruned(path: Column) -> Column:
    """Whether a folder on a relative path is hidden or one of those that hold no documents."""
    folders = F.slice(F.split(normal_path(path), "/"), F.lit(1), F.size(F.split(normal_path(path), "/")) - 1)
    return F.exists(folders, lambda p: p.isin(SKIPPED) | F.startswith(p, F.lit(".")))


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^file:/+", "/"), "^" + "\\Q" + root.rstrip("/") + "\\E/*", "")


def as_documents(files: DataFrame, root: str, keep_blank: bool = False) -> DataFrame:
    """Documents of (path, content BINARY, length, modificationTime); bytes that aren't UTF-8 are replaced."""
    named = files.withColumn("filepath", normal_path(relative(F.col("path"), root)))
    fit = named.where(supported(F.col("filepath")) & ~pruned(F.col("filepath")) & ~multimodal(F.col("filepath")))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    rows = fit.select(text.alias("content"), "filepath", language(F.col("filepath")).alias("language"), F.create_map(F.lit("size"), F.col("length").cast("string")).alias("metadata"))
    return rows if keep_blank else rows.where(F.trim(F.regexp_replace("content", r"\s+", " ")) != "")


def load_documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents of all supported files below ``root``; an absent folder has none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], DOCUMENTS)
    return as_documents(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root), root)


def load_file(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """One file as a document, blank or not."""
    return as_documents(spark.read.format("binaryFile").load(path), base or path.rsplit("/", 1)[0], keep_blank=True)


def document_id(path: Column, length: Column, modified: Column) -> Column:
    return F.concat(F.lit("local-"), F.substring(F.sha2(F.concat_ws(":", path, length.cast("string"), modified.cast("string")), 256), 1, 16))


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page, text, char_count) from a table of pages that a reader of the paged format wrote."""
    return spark.read.parquet(path).select("doc_id", "page", F.trim("text").alias("text")).withColumn("char_count", F.length("text"))


def load_trees(spark: SparkSession, path: str, doc_id: str | None = None) -> DataFrame:
    """Stored section trees, a JSON object per line; lines that don't parse are left out."""
    rows = spark.read.option("mode", "DROPMALFORMED").json(path)
    return rows if doc_id is None else rows.where(F.col("doc_id") == doc_id)
