"""Repositories as fact tables: listing, reading, extraction and assembly."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.functions.storage import is_local, shared_dir
from factloom.operators import imports, markdown, mutate, resolve, structure
from factloom.sources.extract import FIELDS, facts

MAX_BYTES = 2 * 1024 * 1024
#: Bytes of source text that the driver holds at once for a cluster.
SHIPPED = 64 * 1024 * 1024
# Folders that are never entered.
SKIPPED = frozenset("node_modules .git vendor third_party __pycache__ .venv venv target build dist .next .nuxt .output .cache".split())

_TYPES = {"start_line": "int", "end_line": "int", "start_column": "int", "end_column": "int", "exported": "boolean", "constructor": "boolean", "handlers": "array<string>", "match_index": "long", "names": "array<string>", "reexport": "boolean"}
RAW_SCHEMA = "file_path string, language string, " + ", ".join(f"{f} {_TYPES.get(f, 'string')}" for f in FIELDS)
NODE_COLUMNS = ["id", "kind", "name", "qualified_name", "file_path", "start_line", "end_line", "start_column", "end_column", "language", "doc_comment", "body", "exported", "name_tokens", "is_test"]
EDGE_COLUMNS = ["source_id", "target_id", "kind", "file_path", "line", "target_name", "confidence", "resolution", "candidate_count", "truncated", "call_form"]


def _glob(rule: str) -> str:
    """A rule of an ignore file as a regular expression: only ** crosses folders."""
    out, i = "", 0
    while i < len(rule):
        c = rule[i]
        if rule.startswith("**/", i) and (i == 0 or rule[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i) and i + 2 == len(rule) and (i == 0 or rule[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := rule.find("]", i + 2)) > 0:
            inside = rule[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        elif c == "\\" and i + 1 < len(rule):
            out, i = out + re.escape(rule[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


class _Ignore:
    """The rules of one ignore file, for paths below its folder; the last that fits decides."""

    def __init__(self, folder: str, text: str):
        self.folder, self.rules = folder, []
        for raw in text.splitlines():
            rule = re.sub(r"(?<!\\)\s+$", "", raw)
            if not rule or rule.startswith("#"):
                continue
            keep = rule.startswith("!")
            rule = rule[1:] if keep else rule
            only_dirs = rule.endswith("/")
            rule = rule.rstrip("/")
            anywhere = "" if "/" in rule else "(?:.*/)?"
            try:
                self.rules.append((re.compile(anywhere + _glob(rule.removeprefix("/"))), only_dirs, keep))
            except re.error:
                continue  # a rule that no path can fit

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        rest = os.path.relpath(path, self.folder)
        found = [not keep for fits, only_dirs, keep in self.rules if (is_dir or not only_dirs) and fits.fullmatch(rest)]
        return found[-1] if found else None


def _ignores(folder: str) -> list[_Ignore]:
    out = []
    for name in (".git/info/exclude", ".gitignore", ".ignore"):
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                out.append(_Ignore(folder, f.read()))
        except OSError:
            pass
    return out


def listed_files(root: str) -> list[tuple[str, int, int]]:
    """(relative path, bytes, time of change in ns) of source files, sorted: no hidden, ignored, skipped or large ones.

    Ignore files of the folders above count up to the one that holds .git.
    """
    out: list[tuple[str, int, int]] = []
    root = os.path.realpath(root)
    above, at = [], root
    while not os.path.exists(os.path.join(at, ".git")) and os.path.dirname(at) != at:
        at = os.path.dirname(at)
        above.append(at)
    if not above or os.path.exists(os.path.join(at, ".git")):
        above = above[::-1]
    else:
        above = []  # no repository around the folder

    def visit(folder: str, ignores: list[_Ignore]):
        here = os.path.join(root, folder)
        ignores = [*ignores, *_ignores(here)]
        for entry in sorted(os.scandir(here), key=lambda e: e.name):
            path = f"{folder}/{entry.name}" if folder else entry.name
            is_dir = entry.is_dir(follow_symlinks=False)
            if entry.name.startswith(".") or entry.is_symlink() or is_dir and entry.name in SKIPPED:
                continue
            if [v for i in ignores if (v := i.verdict(os.path.join(root, path), is_dir)) is not None][-1:] == [True]:
                continue
            if is_dir:
                visit(path, ignores)
            elif N.language_of(entry.name) and (stat := entry.stat()).st_size <= MAX_BYTES:
                out.append((path, stat.st_size, stat.st_mtime_ns))

    visit("", [i for folder in above for i in _ignores(folder)])
    return out


def list_files(root: str) -> list[str]:
    return [path for path, _, _ in listed_files(root)]


def read_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(file_path, language, text, content_hash); files that aren't UTF-8 are left out.

    A local session reads them in its tasks. On a cluster only the driver sees the folder, so it reads them and
    writes them, SHIPPED bytes at a time, into the shared folder.
    """
    schema = "file_path string, language string, text string, content_hash string"
    if not paths:
        return spark.createDataFrame([], schema)
    if is_local(spark):
        base = "file:" + os.path.abspath(root).rstrip("/") + "/"
        read = spark.read.format("binaryFile").load([base + quoted(p) for p in paths])
        # the path comes back as a URI
        rel = F.expr(f"substring(url_decode(replace(path, '+', '%2B')), {len(base) + 1})") if "%" not in base else F.substring("path", len(base) + 1, 10_000)
        raw = read.select(rel.alias("file_path"), F.col("content").cast("string").alias("text"))
    else:
        raw = _shipped(spark, root, paths)
    valid = raw.where(F.is_valid_utf8("text"))
    return valid.select("file_path", N.by_extension(F.col("file_path")).alias("language"), "text", F.sha2("text", 256).alias("content_hash"))


def quoted(path: str) -> str:
    """A path for a reader that takes glob patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _shipped(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    folder, rows, size, made = f"{shared_dir(spark)}/sources-{uuid.uuid4().hex}", [], 0, False
    schema = "file_path string, content binary"
    for k, path in enumerate(paths):
        try:
            with open(os.path.join(root, path), "rb") as f:
                rows.append((path, bytearray(f.read())))
            size += len(rows[-1][1])
        except OSError:
            pass
        if rows and (size >= SHIPPED or k + 1 == len(paths)):
            spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
            rows, size, made = [], 0, True
    stored = spark.read.schema(schema).parquet(folder) if made else spark.createDataFrame([], schema)
    return stored.select("file_path", F.col("content").cast("string").alias("text"))


def raw_facts(files: DataFrame) -> DataFrame:
    """Declarations and references of each file on its own, in one pass."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split(" ", 1) for x in RAW_SCHEMA.split(", "))])

    def run(batches):
        for batch in batches:
            rows = []
            for path, language, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if language != "markdown":
                    rows += [f | {"file_path": path, "language": language} for f in facts(language, text)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("file_path", "language", "text").mapInArrow(run, RAW_SCHEMA)


def markdown_facts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the headings of Markdown files."""
    docs = files.where("language = 'markdown'")
    of_lines = markdown.lines(docs.select("file_path", F.regexp_replace("text", "\r?\n$", "").alias("text")))
    heads = markdown.anchors(markdown.parents(markdown.headings(of_lines)))
    totals = of_lines.groupBy("file_path").agg(F.max("i").alias("n"))
    ends = markdown.sections(heads.select("file_path", "i", "level"), totals)
    heads = heads.join(ends, ["file_path", "i", "level"]).withColumn("id", N.node_id(F.lit("heading"), F.col("file_path"), F.col("title"), F.col("i")))
    chain = heads.select("file_path", "i", "title", "parent_line", F.col("title").alias("qualified_name"), F.col("parent_line").alias("up"))
    above = heads.select("file_path", F.col("i").alias("up"), F.col("title").alias("_t"), F.col("parent_line").alias("_u"))
    for _ in range(5):  # six levels at most
        chain = chain.join(above, ["file_path", "up"], "left").select("file_path", "i", "title", "parent_line", F.concat_ws(" > ", "_t", "qualified_name").alias("qualified_name"), F.col("_u").alias("up"))
    body = of_lines.join(heads.select("file_path", F.col("i").alias("_s"), "end_line"), "file_path").where("i > _s and i <= end_line")
    body = body.groupBy("file_path", F.col("_s").alias("i")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("_b"))
    trimmed = F.regexp_replace("_b", r"^\s+|\s+$", "")
    bounded = lambda c: F.when(c != "", F.when(F.octet_length(c) <= 4096, c).otherwise(F.concat(N.truncated(c, 4096), F.lit("..."))))
    nodes = heads.join(chain.select("file_path", "i", "qualified_name"), ["file_path", "i"]).join(body, ["file_path", "i"], "left")
    nodes = nodes.select("id", F.lit("heading").alias("kind"), F.col("title").alias("name"), "qualified_name", "file_path", F.col("i").alias("start_line"), "end_line", F.lit(0).alias("start_column"), F.lit(0).alias("end_column"), F.lit("markdown").alias("language"), bounded(trimmed).alias("doc_comment"), bounded(trimmed).alias("body"), F.lit(None).cast("boolean").alias("exported"))
    up = heads.select("file_path", F.col("i").alias("parent_line"), F.col("id").alias("source_id"))
    tree = heads.join(up, ["file_path", "parent_line"]).select("source_id", F.col("id").alias("target_id"), F.lit("contains").alias("kind"), "file_path", F.col("i").alias("line"), F.col("title").alias("target_name"))
    links = markdown.links(of_lines)
    from_head = links.join(heads.select("file_path", F.col("i").alias("_h"), F.col("id").alias("source_id")), "file_path").where("_h <= i")
    from_head = from_head.groupBy("file_path", "i", "target").agg(F.max_by("source_id", "_h").alias("source_id"))
    to = heads.select("file_path", F.col("anchor").alias("target"), F.col("id").alias("target_id"))
    refs = from_head.join(to, ["file_path", "target"]).select("source_id", "target_id", F.lit("references").alias("kind"), "file_path", F.col("i").alias("line"), F.concat(F.lit("#"), "target").alias("target_name"))
    return nodes, tree.unionByName(refs)


def assemble(raw: DataFrame, files: DataFrame, old: tuple[DataFrame, DataFrame] | None = None, paths: DataFrame | None = None, store: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, unresolved) of a whole repository from stored raw facts and files, by joins alone.

    raw has a column `key` that tells its rows apart. With old, the (nodes, edges) of the last snapshot, and paths
    (file_path), the files that came, went or changed since, only these files are read anew, only sites in them or
    on names that they declare or declared are resolved again, and the result is that of a whole build. store(table,
    name) may keep a table that is read more than once.
    """
    fresh = raw if old is None else raw.join(paths, "file_path", "left_semi")
    nodes, head_edges = _nodes(fresh, files if old is None else files.join(paths, "file_path", "left_semi"))
    kept_edges, names = None, None
    if old is not None:
        nodes = store(nodes, "new-nodes")
        names = store(mutate.changed_names(old[0].join(paths, "file_path", "left_semi"), nodes), "names")
        nodes = mutate.delete_keep_incoming(old[0], paths).unionByName(nodes).select(NODE_COLUMNS)
        # what other files emit and no changed name can move; imports and endpoints are joined anew, as any file may be their target
        still = (F.col("kind") != "imports") & (F.coalesce("resolution", F.lit("")) != "endpoint_handler_candidate")
        by = F.when((F.col("kind") != "contains") & ~F.col("target_name").startswith("#"), F.col("target_name"))
        kept_edges = mutate.delete_keep_incoming(old[1], paths).where(still).withColumn("_by", by).join(names.select(F.col("name").alias("_by")), "_by", "left_anti").select(EDGE_COLUMNS)
    nodes = store(nodes, "nodes")
    code = nodes.where("kind <> 'heading'")

    sites = raw.where("tag <> 'node'").select("key", "tag", "file_path", F.col("start_line").alias("line"), F.col("name").alias("target_name"), "parent", "object", "constructor", "names", "reexport")
    plain = ["source_id", "target_id", "kind", "file_path", "line", "target_name"]

    def touched(tag: str) -> DataFrame:
        found = sites.where(tag)
        if old is None:
            return found
        inside, outside = found.join(paths, "file_path", "left_semi"), found.join(paths, "file_path", "left_anti")
        return inside.unionByName(outside.join(names.select(F.col("name").alias("target_name")), "target_name", "left_semi").select(inside.columns))

    def scoped(found: DataFrame) -> DataFrame:
        return found.join(structure.enclosing_scope(found, code, "key"), "key")

    calls = sites.where("tag = 'call'").withColumn("call_form", F.when(F.col("object").isNotNull(), "member"))
    if old is None:
        bound = resolve.bound(store(scoped(calls), "calls"), code, "key")
    else:
        own, others = calls.join(paths, "file_path", "left_semi"), calls.join(paths, "file_path", "left_anti")
        others = others.join(names.select(F.col("name").alias("target_name")), "target_name", "left_semi").select(own.columns)
        bound = resolve.bound(store(scoped(own), "calls"), code, "key").unionByName(resolve.rebind(store(scoped(others), "other-calls"), names, code, "key"))
    label = F.when(~F.col("resolution").isin("static", "unresolved"), F.col("resolution"))
    call_edges = bound.withColumn("resolution", label).withColumn("kind", F.lit("calls")).select(*plain, "confidence", "resolution", "candidate_count", "truncated", "call_form")

    up = touched("tag in ('extends', 'implements')")
    owner = code.where(F.col("kind").isin("class", "interface", "struct")).select("file_path", F.col("name").alias("parent"), F.col("id").alias("source_id"), F.col("start_line").alias("_l"))
    up = structure.first_of(up.join(owner, ["file_path", "parent"]), ["key"], "_l", "source_id").drop("_l")
    kinds_up = resolve.best_targets(up, code.where(~F.col("kind").isin("endpoint", "variable")), "key").withColumn("kind", F.col("tag")).select(*plain)

    types = scoped(touched("tag = 'type'"))
    type_edges = resolve.best_targets(types, code.where(F.col("kind").isin("class", "interface", "struct", "enum", "type_alias", "trait")), "key").where("source_id <> target_id").withColumn("kind", F.lit("references")).select(*plain)

    ends = raw.where("tag = 'node' and kind = 'endpoint' and size(handlers) > 0").select(N.node_id(F.col("kind"), F.col("file_path"), F.col("name"), F.col("start_line")).alias("id"), "handlers", "file_path", "start_line")
    handled = structure.endpoint_handlers(ends, code).join(ends.select(F.col("id").alias("source_id"), "file_path", F.col("start_line").alias("line")), "source_id").join(code.select(F.col("id").alias("target_id"), F.col("name").alias("target_name")), "target_id")
    handled = handled.select("source_id", "target_id", F.lit("references").alias("kind"), "file_path", "line", "target_name", "confidence", F.lit("endpoint_handler_candidate").alias("resolution"))

    holders = code if old is None else code.join(paths, "file_path", "left_semi")
    within = structure.containment(holders).join(holders.select(F.col("id").alias("target_id"), F.col("name").alias("target_name")), "target_id")

    edges = call_edges
    imported, unresolved = _import_edges(sites, files, nodes, store)
    more = [kinds_up, type_edges, handled, within.select(*plain), head_edges, imported, *([kept_edges] if old is not None else [])]
    for part in more:
        edges = edges.unionByName(part, allowMissingColumns=True)
    edges = structure.first_of(edges, ["source_id", "target_id", "kind", "file_path", "line"], F.col("call_form").asc_nulls_last(), "target_name", "confidence")
    return nodes, store(edges.select(EDGE_COLUMNS), "edges"), store(unresolved, "unresolved")


def _nodes(raw: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of these files and the edges of their headings."""
    first = structure.kind_dedup(raw.where("tag = 'node'")).withColumn("id", N.node_id(F.col("kind"), F.col("file_path"), F.col("name"), F.col("start_line")))
    inside_rust = F.when(F.col("module").isNotNull(), F.concat_ws(".", "module", "name"))
    code = first.join(structure.qualified_names(first), "id", "left").withColumn("qualified_name", F.coalesce("qualified_name", inside_rust))
    code = code.withColumn("exported", F.when(F.col("kind") == "endpoint", None).otherwise(F.col("exported")))
    heads, head_edges = markdown_facts(files)
    nodes = code.withColumnRenamed("doc", "doc_comment").select(*[c for c in NODE_COLUMNS if c not in ("name_tokens", "is_test")]).unionByName(heads)
    test = N.is_test(F.col("name"), F.col("file_path"), F.col("language"), F.col("kind"))
    test = test | (F.col("language") == "rust") & N.rust_test_marks(F.col("body"), F.col("qualified_name"))
    nodes = nodes.withColumn("name_tokens", N.name_tokens(F.col("name"), F.col("qualified_name"))).withColumn("is_test", F.coalesce(test, F.lit(False))).select(NODE_COLUMNS)
    return nodes, head_edges


def _import_edges(sites: DataFrame, files: DataFrame, nodes: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Imports as they stand and as they resolve, by name or whole, through one re-exporting file; and those that find no file."""
    wanted = sites.where("tag = 'import'").select("key", "file_path", "line", F.col("target_name").alias("specifier"), "names", "reexport").withColumn("source_id", F.concat(F.lit("file:"), "file_path"))
    modules = wanted.select("source_id", F.concat(F.lit("module:"), "specifier").alias("target_id"), "file_path", "line")
    probed = store(imports.probed(wanted, files.select("file_path"), "key"), "probed")
    listed = F.size(F.coalesce("names", F.array().cast("array<string>"))) > 0
    hops = store(imports.barrels(probed.where("reexport"), nodes), "hops")
    parts = [imports.wildcard(probed.where(~listed), nodes), imports.named(probed.where(listed), nodes, "key", hops), hops]
    out = modules
    for part in parts:
        out = out.unionByName(part.select("source_id", "target_id", "file_path", "line"))
    unresolved = probed.where("resolved is null").select("source_id", "specifier", F.lit("import").alias("ref_type"), "file_path", "line")
    return out.distinct().withColumn("kind", F.lit("imports")), unresolved
