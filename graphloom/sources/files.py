"""A folder of source files as a table; which paths are read; file contents."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What isn't read.
MAX_BYTES = 10 * 1024 * 1024
BINARY = (
    "exe bin o so dll dylib class jar zip tar gz rar png jpg jpeg gif svg ico webp pdf wasm pyc doc docx mp4 mp3 wav woff woff2 ttf db sqlite pem key crt csv parquet pkl"
).split()
SKIPPED_ENDINGS = "map lock".split()
SKIPPED_DIRS = (
    ".git .svn .hg .bzr .idea .vscode .vs node_modules vendor venv .venv __pycache__ site-packages .mypy_cache .pytest_cache dist build out output bin obj target "
    ".next .nuxt .vercel .parcel-cache .turbo coverage __tests__ __mocks__ .nyc_output"
).split()
SKIPPED_NAMES = (
    "package-lock.json yarn.lock pnpm-lock.yaml composer.lock Cargo.lock go.sum .gitignore .gitattributes .npmrc .editorconfig .prettierrc .eslintignore .dockerignore "
    "LICENSE LICENSE.md CHANGELOG.md .env .env.local .env.production"
).split()
GENERATED = (
    ".min.js .bundle.js .chunk.js .min.css .generated.ts .generated.js .generated.go .d.ts .pb.go .pb.gw.go _generated.go _gen.go _string.go .zz_generated.go .deepcopy.go "
    "_enumer.go .twirp.go _easyjson.go _ffjson.go .mock.go _mock.go .pb.scala"
).split()

# Languages by the ending of a file's name.
LANGUAGES = {
    "go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "java": "java", "rs": "rust", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "rb": "ruby", "php": "php", "kt": "kotlin", "swift": "swift", "scala": "scala", "cs": "csharp",
}


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def file_ending(path: Column) -> Column:
    """Lower-case ending after the last dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def is_skipped(path: Column) -> Column:
    """Whether the fixed rules leave a path out; false for null."""
    p = F.coalesce(F.regexp_replace(path, r"\\", "/"), F.lit(""))
    name = file_name(p)
    dirs = F.split(F.regexp_extract(p, r"^(.*)/", 1), "/")
    tests = [F.arrays_overlap(dirs, F.array(*map(F.lit, SKIPPED_DIRS))), file_ending(p).isin(*BINARY, *SKIPPED_ENDINGS), name.isin(*SKIPPED_NAMES)]
    return reduce(Column.__or__, [*tests, *[F.lower(name).endswith(e) for e in GENERATED]])


def language(path: Column) -> Column:
    """Language by the file's ending; empty if unknown, null for null."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(path.isNotNull(), F.coalesce(F.try_element_at(table, file_ending(path)), F.lit("")))


def git_import_path(url: Column) -> Column:
    """Host, owner and repository of a git address, joined by slashes."""
    s = F.regexp_replace(url, r"^(https://)?(http://)?(ssh://)?", "")
    s = F.when(s.startswith("git@"), F.regexp_replace(F.regexp_replace(s, "^git@", ""), r"^([^:]*):", "$1/")).otherwise(s)
    return F.regexp_replace(F.regexp_replace(s, r"\.git$", ""), r"/+$", "")


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """Regular expression over relative paths of one ignore line, and whether it brings paths back.

    Null for blank lines and comments. Understands ``*``, ``?``, ``[...]``,
    ``**``, a leading ``!``, anchoring by an inner slash and folders by a last one.
    """
    line = line.rstrip()
    if not line or line.startswith("#"):
        return None
    back, line = line.startswith("!"), line.removeprefix("!")
    folder, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.removeprefix("/")
    rules = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    tokens = re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]+\]|.", line)
    body = "".join(rules.get(t) or (t.replace("[!", "[^") if len(t) > 2 and t[0] == "[" else re.escape(t)) for t in tokens)
    return f"^{'' if anchored else '(?:.*/)?'}{body}{'/.*' if folder else '(?:/.*)?'}$", back


def is_ignored(path: Column, lines: list[str]) -> Column:
    """Whether ignore lines leave a path out; the last line that matches decides."""
    out = F.lit(False)
    for found in filter(None, map(ignore_pattern, lines)):
        out = F.when(path.rlike(found[0]), not found[1]).otherwise(out)
    return out


def file_tree(spark: SparkSession, root: str, ignore: list[str] = (), hidden: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files under a folder: filePath, name, size, language, content.

    The size filter reaches the scan, so large files aren't read; bytes that
    aren't UTF-8 become U+FFFD. ``ignore`` holds the lines of an ignore file.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.col("length") <= max_bytes)
    base = re.sub(r"^[a-z0-9]+:/*", "/", root.rstrip("/")) if "://" in root or root.startswith("file:") else root.rstrip("/")
    full = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    path = F.substring_index(full, base + "/", -1)
    rows = rows.withColumn("filePath", path).filter(~is_skipped(F.col("filePath")) & ~is_ignored(F.col("filePath"), list(ignore)))
    if not hidden:
        rows = rows.filter(~F.col("filePath").rlike(r"(^|/)\."))
    return rows.select("filePath", file_name(F.col("filePath")).alias("name"), F.col("length").alias("size"), language(F.col("filePath")).alias("language"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def line_range(lines: str | None) -> tuple[int, int] | None:
    """First and last line of ``first-last``; null for an empty string."""
    if not lines:
        return None
    found = re.match(r"\s*([+-]?\d+)-([+-]?\d+)", lines)
    if not found:
        raise ValueError(f"invalid line range {lines!r} (expected format: start-end)")
    first, last = int(found[1]), int(found[2])
    if first < 1 or last < first:
        raise ValueError(f"invalid line range {first}-{last}")
    return first, last


def cat(files: DataFrame, lines: str | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Contents of files (filePath, content): filePath, content, lineCount, error.

    A range is cut to each file on its own. ``paths`` (filePath) asks for some
    files; those that aren't there, or have no content, get an error.
    """
    span, asked = line_range(lines), paths.select("filePath").distinct().join(files.select("filePath", "content"), "filePath", "left") if paths is not None else files.select("filePath", "content")
    c = F.col("content")
    parts = F.split(c, "\n", -1)
    count = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + F.when((c != "") & ~c.endswith("\n"), 1).otherwise(0)
    text = c
    if span:
        first, last = (F.least(F.lit(x), F.size(parts)) for x in span)
        text = F.array_join(F.slice(parts, first, last - first + 1), "\n")
    error = F.when(c.isNull(), F.concat(F.lit("file not found: "), "filePath"))
    return asked.select("filePath", text.alias("content"), count.cast("long").alias("lineCount"), error.alias("error"))


class ContentStore:
    """File contents by path, as zstd Parquet; a put or delete writes a new version."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        # A version counts once its write has been committed.
        done = [s.getPath() for s in fs.listStatus(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    def all(self) -> DataFrame:
        found = self._versions()
        if not found:
            return self.spark.createDataFrame([], "filePath string, content string")
        return self.spark.read.schema("filePath string, content string").parquet(f"{self.folder}/v{found[-1]}")

    def _replace(self, rows: DataFrame) -> None:
        found = self._versions()
        rows.write.option("compression", "zstd").parquet(f"{self.folder}/v{(found or [0])[-1] + 1}")

    def put(self, files: DataFrame) -> None:
        """Add files (filePath, content); a path's old content goes. Of repeats the greatest content stays."""
        new = files.filter("filePath is not null").groupBy("filePath").agg(F.max("content").alias("content"))
        self._replace(self.all().join(new, "filePath", "left_anti").unionByName(new))

    def get(self, path: str) -> str | None:
        row = self.all().filter(F.col("filePath") == path).first()
        return row["content"] if row else None

    def has(self, path: str) -> bool:
        return not self.all().filter(F.col("filePath") == path).isEmpty()

    def delete(self, *paths: str) -> None:
        self._replace(self.all().filter(~F.col("filePath").isin(*paths)))

    def count(self) -> int:
        return self.all().count()
