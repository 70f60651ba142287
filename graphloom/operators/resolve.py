"""Resolution of names: calls to symbols, imports to files, references to spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# What a candidate of a call gains.
CALLABLE, SAME_FILE, IMPORTED_FILE, IMPORTED_DIR, SAME_DIR, SAME_OWNER = 10, 100, 50, 45, 40, 200
CALLABLE_LABELS = ("Function", "Method", "Constructor")


def calls(found: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """The best symbol for each call: call, id, score; calls without a candidate give no row.

    ``found`` is (call, callee, original, file, receiver, receiverType),
    ``symbols`` (id, name, label, file, owner), ``imports`` (file, target).
    Candidates share the callee's name or, under an alias, the original one.
    Ties go to the smallest id.

    Calls that ask the same are answered once, and candidates that differ in
    nothing but their id stand for the smallest. A candidate scores above its
    label's share only by its file, folder or owner; so those join on the name
    and that key, and of each folder, owner and name just the best competes: a
    frequent name doesn't meet all its symbols.
    """
    ask = ["callee", "original", "file", "receiver", "receiverType"]
    c = found.select("call", "callee", "original", "file", F.coalesce("receiver", F.lit("")).alias("receiver"), "receiverType")
    # One row a question, whatever its nulls.
    c = c.withColumn("ask", F.sha2(F.to_json(F.struct(*ask)), 256))
    asked = c.groupBy("ask").agg(*[F.first(x).alias(x) for x in ask]).withColumn("dir", text.path_dir(F.col("file")))
    key = asked.withColumn("name", F.explode(F.array_distinct(F.array_compact(F.array("callee", F.nullif("original", F.lit(""))))))).select("ask", "name", "file", "dir", "receiverType")
    base = F.when(F.coalesce("callable", F.lit(False)), CALLABLE).otherwise(0)
    s = symbols.select("id", "name", F.col("label").isin(*CALLABLE_LABELS).alias("callable"), F.col("file").alias("at"), F.coalesce("owner", F.lit("")).alias("owner")).withColumn("base", base)
    s = s.groupBy("name", "at", "owner").agg(F.min(F.struct((-F.col("base")).alias("less"), "id")).alias("b"))
    s = s.select("name", "at", text.path_dir(F.col("at")).alias("at_dir"), "owner", "b")
    imp = imports.select("file", F.col("target").alias("at"), text.path_dir(F.col("target")).alias("at_dir")).distinct()
    dirs = imp.select("file", "at_dir").distinct()

    def best(*by: str) -> DataFrame:
        """Of each key the best symbol, and the best one of another file, which the caller's own may stand for."""
        per = s.groupBy(*by, "at").agg(F.min("b").alias("b"))
        n = F.row_number().over(Window.partitionBy(*by).orderBy("b"))
        return per.withColumn("_n", n).filter("_n <= 2").select(*by, F.col("b.id").alias("id"))

    one = lambda *by: s.groupBy(*by).agg(F.min("b").alias("b")).select(*by, F.col("b.id").alias("id"))
    each = s.select("name", "at", F.col("b.id").alias("id"))
    owned = key.withColumnRenamed("receiverType", "owner").filter("owner <> ''")
    row = lambda df: df.select("ask", "id")
    rows = row(key.join(one("name"), "name"))
    for more in (
        key.withColumnRenamed("file", "at").join(each, ["name", "at"]),
        key.withColumnRenamed("dir", "at_dir").join(best("name", "at_dir"), ["name", "at_dir"]),
        owned.join(one("name", "owner"), ["name", "owner"]),
        owned.withColumnRenamed("dir", "at_dir").join(best("name", "at_dir", "owner"), ["name", "at_dir", "owner"]),
        key.join(imp.select("file", "at"), "file").join(each, ["name", "at"]),
        key.join(dirs, "file").join(best("name", "at_dir"), ["name", "at_dir"]),
        owned.join(dirs, "file").join(best("name", "at_dir", "owner"), ["name", "at_dir", "owner"]),
    ):
        rows = rows.union(row(more))
    whole = s.select(F.col("b.id").alias("id"), (-F.col("b.less")).alias("base"), "at", "at_dir", "owner")
    full = rows.distinct().join(asked, "ask").join(whole, "id")
    full = full.join(imp.select("file", "at", F.lit(IMPORTED_FILE).alias("of_file")), ["file", "at"], "left").join(dirs.withColumn("of_dir", F.lit(IMPORTED_DIR)), ["file", "at_dir"], "left")
    r, o = F.lower("receiver"), F.lower("owner")
    near = (r == "") | (o == "") | (F.char_length("receiver") <= 2) | o.startswith(r)
    score = (
        F.col("base")
        + F.when((F.col("at") == F.col("file")) & near, SAME_FILE).otherwise(0)
        + F.coalesce("of_file", "of_dir", F.lit(0))
        + F.when((F.col("at_dir") == F.col("dir")) & (F.col("at") != F.col("file")), SAME_DIR).otherwise(0)
        + F.when((F.col("owner") != "") & (F.col("owner") == F.col("receiverType")), SAME_OWNER).otherwise(0)
    )
    chosen = F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), F.col("id")))
    answer = full.withColumn("score", score).groupBy("ask").agg(chosen.alias("b"))
    return c.select("call", "ask").join(answer, "ask").groupBy("call").agg(F.min(F.struct((-F.col("b.score")).alias("less"), "b.id")).alias("b")).select("call", "b.id", (-F.col("b.less")).alias("score"))


def by_suffix(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Files (path) that end in a wanted suffix (want, suffix), on a path boundary: want, path.

    The join is on the last part of the path, the rest is compared.
    """
    w = wanted.withColumn("base", text.path_base(F.col("suffix")))
    f = files.select("path", text.path_base(F.col("path")).alias("base"))
    whole = (F.col("path") == F.col("suffix")) | F.expr("endswith(path, concat('/', suffix))")
    return w.join(f, "base").filter(whole).select("want", "path")


def imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """File of each import: imp, path. ``found`` is (imp, file, source, language), ``files`` (path).

    Candidates in order of choice: the source as a path beside the importing
    file, from the root, then as a suffix; each with the language's endings
    and package files. The shortest path, then the smallest, breaks ties.
    """
    # Endings and package files of the languages.
    endings = {
        "python": [".py", "/__init__.py"], "javascript": ["", ".js", ".jsx", ".mjs", ".ts", ".tsx", "/index.js", "/index.ts"], "typescript": ["", ".ts", ".tsx", ".d.ts", ".js", "/index.ts", "/index.tsx", "/index.js"],
        "java": [".java"], "kotlin": [".kt", ".java"], "scala": [".scala", ".java"], "rust": [".rs", "/mod.rs"], "ruby": ["", ".rb"], "php": ["", ".php"], "c": [""], "cpp": [""], "csharp": [".cs"], "swift": [".swift"], "go": [""],
    }
    dotted = ("python", "java", "kotlin", "scala", "csharp")
    up = F.char_length(F.regexp_extract("source", r"^(\.+)", 1))
    src = F.col("source")
    plain = F.when(F.col("language").isin(*dotted), F.regexp_replace(F.regexp_replace(src, r"^\.+", ""), r"\.", "/")).when(F.col("language") == "rust", F.regexp_replace(F.regexp_replace(src, r"^(crate|self|super)::", ""), "::", "/")).when(F.col("language") == "php", F.regexp_replace(src, r"\\", "/")).otherwise(F.regexp_replace(src, r"^(\./)+", ""))
    folders = F.split(text.path_dir(F.col("file")), "/")
    climbs = F.when((F.col("language") == "python") & (up > 1), up - 1).when(plain.startswith("../"), F.floor(F.char_length(F.regexp_extract(plain, r"^((?:\.\./)+)", 1)) / 3).cast("int")).otherwise(F.lit(0))
    folder = F.array_join(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - climbs, F.lit(0))), "/")
    tail = F.regexp_replace(plain, r"^(\.\./)+", "")
    ends = F.create_map(*[x for k, v in endings.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = found.withColumns({"tail": tail, "folder": folder, "end": F.explode(F.coalesce(F.element_at(ends, F.col("language")), F.array(F.lit(""))))})
    rows = rows.withColumn("rest", F.concat("tail", "end")).filter("tail <> ''")
    f = files.select("path").distinct()
    beside = rows.withColumn("path", F.when(F.col("folder") == "", F.col("rest")).otherwise(F.concat_ws("/", "folder", "rest"))).join(f, "path").select("imp", "path", F.lit(0).alias("tier"))
    rooted = rows.withColumn("path", F.col("rest")).join(f, "path").select("imp", "path", F.lit(1).alias("tier"))
    ended = by_suffix(rows.select(F.col("imp").alias("want"), F.col("rest").alias("suffix")), f).select(F.col("want").alias("imp"), "path", F.lit(2).alias("tier"))
    # A Go import names a folder, by the end of its path; Swift ones name one, too.
    # The folder stands for its first file outside tests.
    here = f.withColumn("at", text.path_dir(F.col("path"))).filter(F.col("path").rlike(r"\.(go|swift)$") & ~text.is_test_path(F.col("path")))
    first = here.groupBy("at", F.regexp_extract("path", r"([a-z]+)$", 1).alias("language")).agg(F.min("path").alias("path"))
    parts = F.split("source", "/")
    ends_ = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    named = found.filter("language in ('go', 'swift') and source <> ''").select("imp", "language", F.posexplode(ends_).alias("n", "at"))
    # A name of one part is of the standard library; settings write the project's own as './name'.
    own = found.filter("language = 'go' and startswith(source, './')").select("imp", "language", F.lit(0).alias("n"), F.substring("source", 3, 10_000).alias("at"))
    inside = named.filter(F.col("at").contains("/") & ~F.col("at").startswith("./")).unionByName(own).join(first, ["at", "language"]).select("imp", "path", (F.lit(3) + F.col("n")).alias("tier"))
    every = beside.union(rooted).union(ended).union(inside)
    return every.groupBy("imp").agg(F.min_by("path", F.struct("tier", F.char_length("path"), "path")).alias("path"))


def folder_imports(pairs: DataFrame) -> DataFrame:
    """Distinct pairs of different folders among file imports (file, target): src, dst."""
    d = pairs.select(text.path_dir(F.col("file")).alias("src"), text.path_dir(F.col("target")).alias("dst"))
    return d.filter("src <> dst").distinct()


def first_by_name(refs: DataFrame, symbols: DataFrame, *labels: str) -> DataFrame:
    """The smallest id among symbols (id, name, label) with a reference's name: ref, id."""
    s = symbols.filter(F.col("label").isin(*labels)) if labels else symbols
    return refs.join(s.groupBy("name").agg(F.min("id").alias("id")), "name").select("ref", "id")


# Names of built-in functions, which calls leave out.
BUILT_IN = (
    "log warn error info debug setTimeout setInterval clearTimeout clearInterval parseInt parseFloat isNaN isFinite parse stringify resolve reject then catch finally require map filter reduce forEach find "
    "findIndex some every includes indexOf slice splice concat join split push pop shift unshift sort reverse keys values entries assign freeze hasOwnProperty toString useState useEffect useCallback useMemo "
    "useRef useContext useReducer createElement createContext forwardRef memo print len range str int float list dict set tuple open read write close append extend update super type isinstance issubclass "
    "getattr setattr hasattr enumerate zip sorted reversed min max sum abs printf fprintf sprintf snprintf scanf fscanf sscanf malloc calloc realloc free memcpy memmove memset memcmp strlen strcpy strncpy "
    "strcat strcmp sizeof assert abort exit fopen fclose fread fwrite make new panic recover copy delete puts p pp raise fail lambda proc each select detect collect inject flat_map any? all? none? count first "
    "last sort_by group_by partition compact flatten uniq attr_accessor attr_reader attr_writer public private protected include prepend require_relative likely unlikely printk kfree kmalloc kzalloc"
).split()


def kept_calls(met: DataFrame) -> DataFrame:
    """Resolved calls (kind, name, dst, ...) of other than built-in names."""
    return met.filter((F.col("kind") == "call") & ~F.col("name").isin(*BUILT_IN))


def kept_delegates(met: DataFrame) -> DataFrame:
    """Resolved function values: (kind, name, receiver, src, dst, label, of, score).

    Only functions and methods that score as in the same file or owner count; a
    method with an owner needs a receiver, and nothing delegates to itself.
    """
    sure = (F.col("kind") == "delegate") & (F.col("score") >= SAME_FILE) & F.col("label").isin("Function", "Method") & ~F.col("name").isin(*BUILT_IN)
    bare = (F.coalesce("receiver", F.lit("")) == "") & (F.col("label") == "Method") & (F.coalesce("of", F.lit("")) != "")
    return met.filter(sure & ~bare & (F.col("src") != F.col("dst")))
