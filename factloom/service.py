"""The five workflows over one repository, and the registry of repositories.

A snapshot is a folder of Parquet tables; manifest.json names the current one and is replaced last, so a
reader never sees half a refresh. A refresh reads only files whose size or time of change is new, extracts those
whose hash changed, and resolves again what they or the names that they declare can move, so that it equals a cold
build. The search index is stored with the snapshot, each file sorted by term.
"""

from __future__ import annotations

import hashlib
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.functions.storage import delete, is_local, read_text, shared_dir, write_text
from factloom.operators import graph, mutate, page, scan, structure, text
from factloom.semantic import Semantic, path_of
from factloom.sources import repository as repo

EXTRACTOR = "2"
SOURCE_BYTES, SECTION_BYTES = 4096, 2048
CONTEXT_MOST, CONTEXT_EDGES, SAMPLES = 3, 5, 20
SEARCHED = ["name", "qualified_name", "body", "doc_comment", "file_path", "name_tokens"]
FILES = ["file_path", "language", "text", "content_hash", "size", "changed"]


class FactsError(ValueError):
    pass


def default_state(spark: SparkSession, root: str) -> str:
    """On a cluster a folder of the shared one, else one of the user's."""
    name = hashlib.sha256(root.encode()).hexdigest()[:24]
    if not is_local(spark):
        return f"{shared_dir(spark)}/factloom/{name}"
    base = os.environ.get("XDG_STATE_HOME") or os.path.join(os.path.expanduser("~"), ".local", "state")
    return os.path.join(base, "factloom", name)


class Repository:
    def __init__(self, spark: SparkSession, root: str, state: str | None = None, lsp: str = "off"):
        if not os.path.isdir(root):
            raise FactsError(f"not a folder: {root}")
        self.semantic = Semantic(lsp)
        self.spark, self.root = spark, os.path.realpath(root)
        state = state or default_state(spark, self.root)
        if ":" not in state.split("/", 1)[0]:
            if not is_local(spark):
                raise FactsError("state must be on a storage that driver and executors share")
            state = "file:" + os.path.abspath(state)
        self.state = state.rstrip("/")
        self.tables: dict[str, DataFrame] = {}

    # snapshots

    def manifest(self) -> dict:
        """Which snapshot is the current one, and what made it; extractor is None where the next refresh must build all anew."""
        found = read_text(self.spark, f"{self.state}/manifest.json")
        if not found:
            return {"generation": 0, "extractor": None, "folder": None}
        try:
            made = json.loads(found)
        except ValueError as e:
            raise FactsError("the manifest can't be read") from e
        number = made.get("generation") if isinstance(made, dict) else None
        if isinstance(number, bool) or not isinstance(number, int) or number < 0:
            raise FactsError("the manifest has no valid generation")
        return {"extractor": None, "folder": None} | made

    def require_rebuild(self) -> None:
        """Makes the next refresh build everything anew, whatever changed; that refresh takes the mark away."""
        write_text(self.spark, f"{self.state}/manifest.json", json.dumps(self.manifest() | {"extractor": None}))

    def _stored(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.spark.read.parquet(f"{self.state}/{self.manifest()['folder']}/{name}").cache()
        return self.tables[name]

    @property
    def index(self) -> text.Index:
        return text.Index(*(self._stored(f"index-{t}") for t in text.Index._fields))

    @property
    def nodes(self) -> DataFrame:
        return self._stored("nodes")

    @property
    def edges(self) -> DataFrame:
        return self._stored("edges")

    def refresh(self) -> dict:
        began = time.monotonic()
        old = self.manifest()
        usable = old["extractor"] == EXTRACTOR
        listed = self.spark.createDataFrame(repo.listed_files(self.root), "file_path string, size long, changed long")
        place = ["file_path", "size", "changed"]
        if usable:
            suspect = [r["file_path"] for r in listed.join(self._stored("files").select(place), place, "left_anti").select("file_path").collect()]
        else:
            suspect = [r["file_path"] for r in listed.select("file_path").collect()]
        read = repo.read_files(self.spark, self.root, sorted(suspect)).join(listed, "file_path").select(FILES).cache()
        try:
            kept = self._stored("files") if usable else read.limit(0)
            states = mutate.snapshot_states(kept.join(listed.select("file_path"), "file_path", "left_semi"), read)
            changed = [r["file_path"] for r in states.where("state in ('added', 'changed')").collect()]
            gone = [r["file_path"] for r in kept.join(listed.select("file_path"), "file_path", "left_anti").select("file_path").collect()]
            counts = {"files_indexed": len(changed), "files_skipped": listed.count() - len(changed), "relationships_rebound": 0}
            generation = old["generation"]
            if changed or gone or not usable:
                generation += 1
                counts["relationships_rebound"] = self._write(read, changed, gone, usable, generation)
        finally:
            read.unpersist()
        return {"status": "fresh", "repository_root": self.root, "generation": generation, **counts, "duration_ms": int((time.monotonic() - began) * 1000)}

    def _write(self, read: DataFrame, changed: list[str], gone: list[str], usable: bool, generation: int) -> int:
        folder = f"gen={generation}"
        path = f"{self.state}/{folder}"
        delete(self.spark, path)
        schema = "file_path string"
        new_paths = self.spark.createDataFrame([(p,) for p in changed], schema)
        paths = self.spark.createDataFrame([(p,) for p in [*changed, *gone]], schema)
        raw, files = repo.raw_facts(read.join(new_paths, "file_path", "left_semi")), read
        if usable:
            raw = mutate.delete_keep_incoming(self._stored("raw").drop("key"), paths).unionByName(raw)
            other = self._stored("files").join(read.select("file_path"), "file_path", "left_anti").join(paths, "file_path", "left_anti")
            files = other.select(FILES).unionByName(read)
        raw.withColumn("key", F.monotonically_increasing_id()).write.parquet(f"{path}/raw")
        files.write.parquet(f"{path}/files")
        raw, stored = (self.spark.read.parquet(f"{path}/{t}") for t in ("raw", "files"))

        def store(table: DataFrame, name: str) -> DataFrame:
            table.write.parquet(f"{path}/{name}")
            return self.spark.read.schema(table.schema).parquet(f"{path}/{name}")

        nodes, _, _ = repo.assemble(raw, stored, (self.nodes, self.edges) if usable else None, paths, store)
        text.stored(text.index(nodes, "id", SEARCHED), lambda table, name: store(table, f"index-{name}"))
        rebound = 0
        if usable:
            same = ["source_id", "target_id", "file_path", "line", "target_name"]
            calls = lambda df: df.where("kind = 'calls'").join(paths, "file_path", "left_anti").select(same)
            now = calls(self.spark.read.parquet(f"{path}/edges"))
            site = ["file_path", "line", "target_name"]
            rebound = now.join(calls(self.edges), same, "left_anti").select(site).distinct().count()
        for t in self.tables.values():
            t.unpersist()
        self.tables.clear()
        for name in ("new-nodes", "names", "calls", "other-calls", "probed", "hops"):
            delete(self.spark, f"{path}/{name}")
        old = self.manifest()["folder"]
        write_text(self.spark, f"{self.state}/manifest.json", json.dumps({"generation": generation, "extractor": EXTRACTOR, "folder": folder}))
        if old and old != folder:
            delete(self.spark, f"{self.state}/{old}")
        return rebound

    # facts

    def _hashes(self, paths) -> dict[str, str]:
        rows = self._stored("files").where(F.col("file_path").isin(sorted(set(paths)))).select("file_path", "content_hash").collect()
        return {r["file_path"]: r["content_hash"] for r in rows}

    @staticmethod
    def _symbol(n, hashes: dict) -> dict:
        kind = n["kind"]
        extractor = N.extractor_of(kind, n["language"])
        evidence = {"file_path": n["file_path"], "start_line": n["start_line"], "end_line": n["end_line"], "source_hash": hashes.get(n["file_path"]), "extractor": extractor, "confidence": "heuristic" if kind == "endpoint" else "static"}
        return {"id": n["id"], "name": n["name"], "qualified_name": n["qualified_name"], "kind": kind, "language": n["language"], "evidence": evidence}

    def _symbols(self, rows) -> list[dict]:
        hashes = self._hashes(r["file_path"] for r in rows)
        return [self._symbol(r, hashes) for r in rows]

    def _relationships(self, node_id: str, limit: int) -> dict[str, list[dict]]:
        """Callers, callees and references both ways, by one plan."""
        near = graph.neighbourhood(self.edges, self.nodes, node_id).join(self.edges, mutate.EDGE_KEY)
        rows = near.orderBy("source_id", "target_id", "line").collect()
        ids = sorted({r["source_id"] for r in rows} | {r["target_id"] for r in rows})
        ends = {s["id"]: s for s in self._symbols(self.nodes.where(F.col("id").isin(ids)).collect())}
        hashes = self._hashes(r["file_path"] for r in rows)
        out: dict[str, list[dict]] = {"callers": [], "callees": [], "inbound": [], "outbound": []}
        for r in rows:
            inward = r["direction"] == "in"
            part = out[("callers" if inward else "callees") if r["kind"] == "calls" else ("inbound" if inward else "outbound")]
            if len(part) < limit:
                evidence = {"file_path": r["file_path"], "start_line": r["line"], "end_line": r["line"], "source_hash": hashes.get(r["file_path"]), "extractor": N.extractor_of("", N.language_of(r["file_path"])), "confidence": r["confidence"] or "static"}
                fact = {"kind": r["kind"], "from": ends[r["source_id"]], "to": ends[r["target_id"]], "evidence": evidence}
                part.append(fact | ({"resolution": r["resolution"]} if r["resolution"] else {}))
        return out

    def _tests(self, n, limit: int) -> list[dict]:
        found = graph.related_tests(self.edges, self.nodes, n["id"], n["name"], n["file_path"])
        return self._symbols(found.orderBy(F.desc("by_name"), F.desc("same_file"), "file_path", "start_line", "id").limit(limit).collect())

    def _source(self, n) -> dict:
        try:
            with open(os.path.join(self.root, n["file_path"]), encoding="utf-8", newline="") as f:
                content = f.read()
        except (OSError, UnicodeDecodeError):
            return {"status": "unavailable", "message": "The source of this definition can't be read."}
        if hashlib.sha256(content.encode()).hexdigest() != self._hashes([n["file_path"]]).get(n["file_path"]):
            return {"status": "changed_during_query", "message": "The source changed since the refresh; ask again."}
        out, size, last = [], 0, n["start_line"] - 1
        for i, line in enumerate(content.splitlines(keepends=True)[n["start_line"] - 1 : n["end_line"]], n["start_line"]):
            if size + len(line.encode()) > SOURCE_BYTES:
                if not out:
                    out, size, last = [N.bounded(line, SOURCE_BYTES, "")], SOURCE_BYTES, i
                break
            out.append(line)
            size, last = size + len(line.encode()), i
        body = "".join(out)
        return {"status": "ok", "start_line": n["start_line"], "end_line": last, "definition_end_line": n["end_line"], "text": body, "byte_length": len(body.encode()), "truncated": last < n["end_line"] or size >= SOURCE_BYTES}

    # workflows

    def map(self) -> dict:
        fresh = self.refresh()
        count = lambda df, c: {r[c]: r["n"] for r in df.groupBy(c).agg(F.count("*").alias("n")).orderBy(c).collect()}
        lost = self._stored("unresolved")
        total = lost.count()
        samples = lost.orderBy("file_path", "line", "specifier").limit(SAMPLES).collect()
        hashes = self._hashes(r["file_path"] for r in samples)
        facts = [{"specifier": r["specifier"], "kind": r["ref_type"], "evidence": {"file_path": r["file_path"], "start_line": r["line"], "end_line": r["line"], "source_hash": hashes.get(r["file_path"]), "extractor": N.extractor_of("", N.language_of(r["file_path"])), "confidence": "unresolved"}} for r in samples]
        files = count(self._stored("files"), "language")
        return {
            "freshness": fresh,
            "files_with_facts": self.nodes.select("file_path").distinct().count(),
            "indexed_files": sum(files.values()),
            "files_indexed_this_refresh": fresh["files_indexed"],
            "symbols": self.nodes.count(),
            "relationships": self.edges.count(),
            "language_file_counts": files,
            "language_symbol_counts": count(self.nodes, "language"),
            "symbol_kinds": count(self.nodes, "kind"),
            "unresolved_references": {"count": total, "samples": facts, "truncated": total > SAMPLES},
            "lsp": self.semantic.report(files),
        }

    def _prefix(self, prefix: str | None) -> str | None:
        if prefix is None:
            return None
        out = N.normalized(prefix)
        if os.path.isabs(prefix) or ".." in prefix.split("/"):
            raise FactsError("path_prefix must stay inside the repository")
        return out or None

    def _stale(self, fresh: dict) -> dict:
        return {"freshness": fresh, "status": "stale_cursor", "message": "The repository changed since this cursor was made; start again."}

    def search(self, query: str, kind: str | None = None, path_prefix: str | None = None, scope: str = "top_level", detail: str = "facts", context_limit: int = 1, offset: int = 0, cursor: str | None = None, limit: int | None = None) -> dict:
        fresh = self.refresh()
        limit, prefix = page.bounded_limit(limit), self._prefix(path_prefix)
        bound = page.scope_hash("search", self.root, query, kind, prefix, scope, detail, context_limit)
        try:
            offset = page.offset_of(cursor, offset, fresh["generation"], bound)
        except page.StaleCursor:
            return self._stale(fresh)
        rows, more = [], False
        if text.query_tokens(query):
            found = text.search(self.nodes, self.index, query)
            found = scan.nodes_where(found, kind=kind, prefix=prefix)
            if scope == "top_level":
                found = structure.top_level(found, self.nodes)
            rows, more = page.page(found.orderBy("block", "place", "file_path", "start_line", "id"), offset, limit)
        out = {"freshness": fresh, "query": query, "scope": scope, "results": self._symbols(rows), "offset": offset, "next_cursor": page.cursor(fresh["generation"], offset + limit, bound) if more else None, "next_offset": offset + limit if more else None, "bounded_by": limit}
        if not text.query_tokens(query):
            out["message"] = "The query has no searchable words."
        if detail == "context":
            few = max(1, min(CONTEXT_MOST, context_limit))
            out["context_entries"] = [self._context(r) for r in rows[:few]]
            out["context_entries_truncated"] = len(rows) > few
            out["context_bounded_by"] = {"entries": few, "relationships_per_entry": CONTEXT_EDGES, "source_bytes_per_entry": SOURCE_BYTES}
        return out

    def _context(self, n) -> dict:
        near = self._relationships(n["id"], CONTEXT_EDGES)
        return {"symbol": self._symbols([n])[0], "source": self._source(n), "callers": near["callers"], "callees": near["callees"], "references": {"inbound": near["inbound"], "outbound": near["outbound"]}, "tests": self._tests(n, CONTEXT_EDGES)}

    def outline(self, file_path: str, kind: str | None = None, scope: str = "top_level", offset: int = 0, cursor: str | None = None, limit: int | None = None) -> dict:
        fresh = self.refresh()
        limit = page.bounded_limit(limit)
        at = os.path.join(self.root, file_path)
        rel = os.path.relpath(os.path.realpath(at) if os.path.exists(at) else os.path.normpath(at), self.root)
        if rel.split(os.sep)[0] == "..":
            raise FactsError("file_path must stay inside the repository")
        bound = page.scope_hash("outline", self.root, rel, kind, scope)
        try:
            offset = page.offset_of(cursor, offset, fresh["generation"], bound)
        except page.StaleCursor:
            return self._stale(fresh)
        found = scan.nodes_where(self.nodes, file_path=rel, kind=kind)
        if scope == "top_level":
            found = structure.top_level(found, scan.nodes_where(self.nodes, file_path=rel))
        rows, more = page.page(scan.in_order(found), offset, limit)
        return {"freshness": fresh, "file_path": rel, "kind": kind, "scope": scope, "symbols": self._symbols(rows), "offset": offset, "next_cursor": page.cursor(fresh["generation"], offset + limit, bound) if more else None, "next_offset": offset + limit if more else None, "truncated": more, "bounded_by": limit}

    def _resolve(self, symbol: str, file_path: str | None) -> list:
        rows = scan.nodes_where(self.nodes, node_id=symbol).limit(1).collect()
        return rows or scan.in_order(scan.nodes_where(self.nodes, name=symbol, file_path=file_path)).limit(page.MOST).collect()

    def expand(self, symbol: str, file_path: str | None = None, limit: int | None = None) -> dict:
        fresh = self.refresh()
        limit = page.bounded_limit(limit)
        rows = self._resolve(symbol, file_path)
        if not rows:
            return {"freshness": fresh, "status": "not_found", "symbol": symbol, "message": "No symbol of this name or id."}
        if len(rows) > 1:
            return {"freshness": fresh, "status": "ambiguous", "symbol": symbol, "matches": self._symbols(rows), "message": "Several symbols have this name; give an id or a file."}
        n = rows[0]
        near = self._relationships(n["id"], limit)
        section = None
        if n["kind"] == "heading":
            section = {"text": N.bounded(n["body"] or "", SECTION_BYTES, ""), "truncated": len((n["body"] or "").encode()) > SECTION_BYTES}
        return {"freshness": fresh, "status": "ok", "definition": self._symbols([n])[0], "source": self._source(n), "section": section, "callers": near["callers"], "callees": near["callees"], "references": {"inbound": near["inbound"], "outbound": near["outbound"], "semantic": self._semantic(n, limit)}, "tests": self._tests(n, limit), "bounded_by": limit}

    def _semantic(self, n, limit: int) -> dict:
        """A language server's references as facts; places outside the stored files, or past the limit, are only counted."""
        got = self.semantic.references(self.root, n)
        if got["status"] != "ok":
            return got
        inside = lambda p: os.path.relpath(os.path.realpath(p), self.root) if p else ".."
        paths = [inside(path_of(x["uri"])) for x in got["locations"]]
        hashes = self._hashes(p for p in paths if not p.startswith(".."))
        facts = [{"evidence": {"file_path": p, "start_line": x["start_line"] + 1, "end_line": x["end_line"] + 1, "source_hash": hashes[p], "extractor": f"lsp:{got['provider']}", "confidence": "semantic"}, "start_column": x["start_column"], "end_column": x["end_column"]} for p, x in zip(paths, got["locations"]) if p in hashes][:limit]
        omitted = len(paths) - len(facts)
        return {"status": "ok", "provider": got["provider"], "position_encoding": "utf-16", "locations": facts, "truncated": omitted > 0, "omitted_locations": omitted}

    def path(self, start: str, goal: str, from_file_path: str | None = None, to_file_path: str | None = None, limit: int | None = None) -> dict:
        fresh = self.refresh()
        limit = page.bounded_limit(limit)
        ends = []
        for parameter, symbol, file in (("from", start, from_file_path), ("to", goal, to_file_path)):
            rows = self._resolve(symbol, file)
            if not rows:
                return {"freshness": fresh, "status": "not_found", "parameter": parameter, "message": "No symbol matches this end."}
            if len(rows) > 1:
                return {"freshness": fresh, "status": "ambiguous", "parameter": parameter, "matches": self._symbols(rows), "message": "An end of a path must be one symbol."}
            ends.append(rows[0])
        a, b = self._symbols(ends)
        steps = graph.shortest_path(self.edges, self.nodes, a["id"], b["id"])
        if steps is None:
            return {"freshness": fresh, "status": "no_static_path", "from": a, "to": b, "message": "No static path of calls was found; at run time there may be one."}
        if len(steps) + 1 > limit:
            return {"freshness": fresh, "status": "path_too_long", "from": a, "to": b, "path_length": len(steps) + 1, "maximum_path_length": limit, "relationship_kind": "calls", "message": "The shortest static path is longer than the limit."}
        ids = [a["id"], *(s["target_id"] for s in steps)]
        facts = {s["id"]: s for s in self._symbols(self.nodes.where(F.col("id").isin(ids)).collect())}
        hashes = self._hashes(s["file_path"] for s in steps)
        evidence = [{"evidence": {"file_path": s["file_path"], "start_line": s["line"], "end_line": s["line"], "source_hash": hashes.get(s["file_path"]), "extractor": N.extractor_of("", N.language_of(s["file_path"])), "confidence": "static"}} for s in steps]
        return {"freshness": fresh, "status": "ok", "path": [facts[i] for i in ids], "relationships": evidence, "relationship_kind": "calls"}


class Registry:
    """One store for each real root; results of roots are never merged."""

    def __init__(self, spark: SparkSession, root: str | None = None, state: str | None = None, lsp: str = "off"):
        self.spark, self.stores, self.default, self.lsp = spark, {}, None, lsp
        if root:
            store = Repository(spark, root, state, lsp)
            self.stores[store.root] = store
            self.default = store.root

    def project(self, root: str | None) -> Repository:
        if root is None and self.default is None:
            raise FactsError("repository_root is required")
        real = os.path.realpath(root) if root else self.default
        if real not in self.stores:
            self.stores[real] = Repository(self.spark, real, lsp=self.lsp)
        return self.stores[real]
