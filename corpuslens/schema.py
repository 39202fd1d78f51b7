"""Schemas, defaults and the options a search takes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

CATALOGUE = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("extension", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("created_time", T.TimestampType()),
    T.StructField("modified_time", T.TimestampType()),
    T.StructField("is_directory", T.BooleanType(), False),
])

QUERIES = T.StructType([
    T.StructField("query_id", T.LongType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("case_sensitive", T.BooleanType(), False),
    T.StructField("fuzzy", T.BooleanType(), False),
    T.StructField("phrase", T.BooleanType(), False),
    T.StructField("k", T.IntegerType(), False),
])

HITS = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("path", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("source", T.StringType()),
])

SEARCH_STATS = T.StructType([
    T.StructField("files_scanned", T.LongType()),
    T.StructField("matches_found", T.LongType()),
    T.StructField("files_skipped", T.LongType()),
])

# Field names, result labels, limits and defaults that results depend on.
FIELD = "content"
FIELD_CASE = "content_case"
SOURCE_SCAN = "scan"
SOURCE_INDEX = "index"
MODES = ("auto", "index", "scan")
MAX_FILE_BYTES = 25 * 1024 * 1024
DEFAULT_HITS = 20
COORDINATOR_HITS = 200
DEFAULT_EXTENSIONS = (
    ".txt", ".md", ".log", ".json", ".yaml", ".yml",
    ".cs", ".java", ".py", ".js", ".ts", ".tsx", ".jsx", ".cpp", ".c", ".h", ".hpp",
    ".go", ".rs", ".rb", ".php", ".swift", ".kt", ".scala", ".sql", ".html", ".css",
    ".scss", ".xml", ".xaml", ".sh", ".bat", ".ps1", ".ini", ".cfg", ".toml",
)


@dataclass(frozen=True)
class SearchOptions:
    """What one search asks for; the defaults are those of the command line."""

    search_term: str | None = None
    root_directory: str = "."
    search_content: bool = False
    use_regex: bool = False
    case_sensitive: bool = False
    exact_phrase: bool = False
    fuzzy_search: bool = False
    content_search_mode: str = "auto"
    content_index_path: str | None = None
    include_extensions: tuple[str, ...] = ()
    exclude_extensions: tuple[str, ...] = ()
    min_size: int = 0
    max_size: int = MAX_FILE_BYTES

    def mode(self) -> str:
        """The content search mode; text that names no mode means ``auto``."""
        wanted = (self.content_search_mode or "").lower()
        return wanted if wanted in MODES else "auto"
