"""Repositories end to end: refresh, the five workflows and the protocol."""

import json
import os
import random

import pytest

from factloom import rpc
from factloom.functions import storage
from factloom.operators.page import CursorError
from factloom.service import FactsError, Registry, Repository


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    write(root, "src/lib.rs", "fn helper() {}\nfn entry() {\n    helper();\n    helper();\n}\nmod tests {\n    #[tokio::test]\n    async fn works() { entry(); }\n}\nstruct Point;\n")
    write(root, "src/provider.ts", "export interface Provider { detect(): void }\nexport class A implements Provider {\n  detect() { return 1; }\n}\nexport class B implements Provider {\n  detect() { return 2; }\n}\nexport function run(provider) {\n  provider.detect();\n}\nconst topValue = 1;\nfunction outer() {\n  const innerValue = 2;\n  return innerValue;\n}\n")
    write(root, "src/routes.ts", "function auth() {}\nfunction show() {}\napp.get('/users/:id', auth, show);\nurl.searchParams.get('x');\n")
    write(root, "src/use.ts", "import { x } from './config.js';\nimport './gone';\nfirst();\n")
    write(root, "src/config.ts", "export const x = 1;\nexport function first() { second(); }\nexport function second() { third(); }\nexport function third() {}\n")
    write(root, "src/dup.ts", "export function handle() {}\n")
    write(root, "src/dup2.ts", "export function handle() {}\nfunction caller() { handle2(); }\n")
    write(root, "README.md", "# Overview\nText with a [link](#install).\n## Install\nRun it.\n```\n# not a heading [no](#overview)\n```\nSee [top](#overview).\n# Overview\nEnd.\n")
    write(root, ".gitignore", "ignored.ts\n")
    write(root, "ignored.ts", "function hidden() {}\n")
    write(root, "node_modules/a.ts", "function hidden() {}\n")
    store = Repository(spark, str(root), str(tmp_path_factory.mktemp("state")))
    store.refresh()
    return store


def write(root, path, text):
    at = os.path.join(root, path)
    os.makedirs(os.path.dirname(at), exist_ok=True)
    with open(at, "w") as f:
        f.write(text)


def names(facts):
    return [f["name"] for f in facts]


def test_map(project):
    got = project.map()
    assert got["indexed_files"] == 8 and got["language_file_counts"] == {"markdown": 1, "rust": 1, "typescript": 6}
    assert got["freshness"]["files_skipped"] == 8 and got["freshness"]["generation"] == 1
    assert got["unresolved_references"]["count"] == 1 and got["unresolved_references"]["samples"][0]["specifier"] == "./gone"
    assert got["symbol_kinds"]["heading"] == 3 and got["symbol_kinds"]["endpoint"] == 1 and got["symbol_kinds"]["struct"] == 1


def test_expand_has_both_call_sites_and_tests(project):
    got = project.expand("helper")
    assert [c["evidence"]["start_line"] for c in got["callers"]] == [3, 4] and names([c["from"] for c in got["callers"]]) == ["entry", "entry"]
    assert got["source"]["text"] == "fn helper() {}\n" and got["status"] == "ok"
    assert names(project.expand("entry")["tests"]) == ["works"]
    assert project.expand("nothing")["status"] == "not_found" and project.expand("handle")["status"] == "ambiguous"
    assert project.expand("handle", "src/dup.ts")["status"] == "ok"


def test_polymorphic_calls_stay_out_of_paths(project):
    got = project.expand("run")
    assert {c["resolution"] for c in got["callees"]} == {"polymorphic"} and len(got["callees"]) == 2
    target = got["callees"][0]["to"]["id"]
    assert project.path("run", target)["status"] == "no_static_path"


def test_path(project):
    got = project.path("first", "third")
    assert names(got["path"]) == ["first", "second", "third"] and len(got["relationships"]) == 2
    short = project.path("first", "third", limit=1)
    assert short["status"] == "path_too_long" and short["path_length"] == 3
    assert project.path("handle", "third")["parameter"] == "from" and project.path("first", "nope")["status"] == "not_found"
    assert len(project.path("first", "first")["path"]) == 1


def test_endpoints(project):
    got = project.search("users", kind="endpoint")
    assert names(got["results"]) == ["GET /users/:id"]
    out = project.expand(got["results"][0]["id"])["references"]["outbound"]
    assert sorted(names([r["to"] for r in out])) == ["auth", "show"] and {r["evidence"]["confidence"] for r in out} == {"heuristic"}


def test_markdown(project):
    got = project.outline("README.md")["symbols"]
    assert [(s["qualified_name"], s["evidence"]["start_line"], s["evidence"]["end_line"]) for s in got] == [("Overview", 1, 2 + 6), ("Overview > Install", 3, 8), ("Overview", 9, 10)]
    install = project.expand(got[1]["id"])
    assert names([r["to"] for r in install["references"]["outbound"]]) == ["Overview"] and len(install["references"]["inbound"]) == 1


def test_scope_and_filters(project):
    assert "innerValue" not in names(project.search("Value")["results"]) and names(project.search("innerValue", scope="all")["results"]) == ["innerValue", "outer"]  # the exact name, then the body that holds it
    assert names(project.search("Point", kind="struct")["results"]) == ["Point"] and project.search("Point", kind="class")["results"] == []
    assert project.search("hidden")["results"] == [] and project.search("??")["results"] == []
    assert names(project.search("topValue", path_prefix="src")["results"]) == ["topValue"] and project.search("topValue", path_prefix="other")["results"] == []
    with pytest.raises(FactsError):
        project.search("x", path_prefix="../up")


def test_pages_and_cursors(project):
    seen, cursor = [], None
    for _ in range(4):
        got = project.outline("src/config.ts", limit=1, cursor=cursor)
        seen += names(got["symbols"])
        cursor = got["next_cursor"]
    assert seen == ["x", "first", "second", "third"] and cursor is None
    made = project.outline("src/config.ts", limit=1)["next_cursor"]
    for bad in (lambda: project.outline("src/dup.ts", cursor=made), lambda: project.outline("src/config.ts", cursor="zz"), lambda: project.outline("src/config.ts", cursor=made, offset=1)):
        with pytest.raises(CursorError):
            bad()


def test_context(project):
    got = project.search("helper", detail="context")
    assert got["context_entries"][0]["symbol"]["name"] == "helper" and got["context_entries_truncated"]  # bodies that call it match, too
    assert got["context_bounded_by"]["source_bytes_per_entry"] == 4096


def test_refresh_rebinds_and_prunes(spark, tmp_path):
    root = str(tmp_path / "r")
    write(root, "caller.ts", "export function caller() {\n  target();\n}\n")
    write(root, "other.ts", "export function other() {}\n")
    store = Repository(spark, root, str(tmp_path / "s"))
    assert store.refresh()["files_indexed"] == 2
    made = store.outline("other.ts", limit=1)
    assert store.expand("caller")["callees"] == []
    write(root, "target.ts", "export function target() {}\n")
    fresh = store.refresh()
    assert (fresh["files_indexed"], fresh["files_skipped"], fresh["relationships_rebound"]) == (1, 2, 1)
    assert names([c["to"] for c in store.expand("caller")["callees"]]) == ["target"] and made["next_cursor"] is None
    cold = Repository(spark, root, str(tmp_path / "cold"))
    cold.refresh()
    key = ["source_id", "target_id", "kind", "file_path", "line", "confidence"]
    assert sorted(map(str, store.edges.select(key).collect())) == sorted(map(str, cold.edges.select(key).collect()))
    os.remove(os.path.join(root, "target.ts"))
    fresh = store.refresh()
    assert fresh["relationships_rebound"] == 1 and fresh["generation"] == 3 and store.expand("target")["status"] == "not_found"


def request(registry, method, params=None, request_id=1):
    return rpc.handle(registry, {"jsonrpc": "2.0", "id": request_id, "method": method, "params": params or {}})


def test_protocol(spark, project):
    registry = Registry(spark)
    registry.stores[project.root] = project
    assert request(registry, "initialize")["result"]["serverInfo"]["name"] == "factloom"
    assert [t["name"] for t in request(registry, "tools/list")["result"]["tools"]] == ["map", "search", "outline", "expand", "path"]
    assert request(registry, "nope")["error"]["code"] == -32601 and rpc.handle(registry, {"id": 1})["error"]["code"] == -32600
    assert rpc.handle(registry, {"method": "notifications/initialized"}) is None
    call = lambda name, **a: request(registry, "tools/call", {"name": name, "arguments": a})["result"]
    assert call("map")["isError"] and call("search", repository_root=project.root, query=" ")["isError"]
    assert call("search", repository_root=project.root, query="x", kind="field")["isError"] and call("outline", repository_root=project.root, file_path="a", limit=0)["isError"]
    assert call("search", repository_root=project.root, query="x", context_limit=2)["isError"]
    good = call("path", repository_root=project.root, **{"from": "first", "to": "second"})
    assert good["structuredContent"]["status"] == "ok" and json.loads(good["content"][0]["text"]) == good["structuredContent"]
    meta = {rpc.VERSION_KEY: rpc.MODERN, rpc.ABILITIES_KEY: {}}
    assert request(registry, "server/discover", {"_meta": meta})["result"]["resultType"] == "complete"
    assert request(registry, "server/discover")["error"]["code"] == -32602
    assert request(registry, "tools/list", {"_meta": {rpc.VERSION_KEY: "1999"}})["error"]["code"] == -32022
    out = []

    class Out:
        write = staticmethod(out.append)
        flush = staticmethod(lambda: None)

    rpc.serve(registry, ["\n", "{bad\n", json.dumps({"id": 2, "method": "tools/list"}) + "\n"], Out)
    assert json.loads(out[0])["error"]["code"] == -32700 and json.loads(out[1])["id"] == 2


def test_command_line():
    from factloom.__main__ import main, parse

    assert parse(["mcp", "--root", "a", "--lsp", "off"]) == {"root": "a", "lsp": "off"}
    for bad in ([], ["x"], ["mcp", "--state", "s"], ["mcp", "--lsp", "maybe"], ["mcp", "--root"]):
        assert main(bad) == 2


def test_named_imports_and_barrels(spark, tmp_path):
    root = str(tmp_path / "r")
    write(root, "lib/one.ts", "export function pick() {}\nexport function other() {}\n")
    write(root, "lib/two.ts", "export function pick() {}\n")
    write(root, "lib/index.ts", "export { pick } from './two';\nexport * from './three';\n")
    write(root, "lib/three.ts", "export const depth = 1;\n")
    write(root, "a.ts", "import { pick } from './lib/one';\n")
    write(root, "b.ts", "import { pick } from './lib';\n")
    write(root, "c.ts", "import * as all from './lib/one';\n")
    store = Repository(spark, root, str(tmp_path / "s"))
    store.refresh()
    made = {}
    for r in store.edges.where("kind = 'imports' and target_id not like 'module:%'").collect():
        made.setdefault(r["file_path"], set()).add(":".join(r["target_id"].split(":")[1:3]))
    assert made == {"a.ts": {"lib/one.ts:pick"}, "b.ts": {"lib/two.ts:pick"}, "c.ts": {"lib/one.ts:pick", "lib/one.ts:other"}, "lib/index.ts": {"lib/two.ts:pick", "lib/three.ts:depth"}}


def test_refresh_equals_a_cold_build(spark, tmp_path):
    r = random.Random(5)
    root, names_ = str(tmp_path / "r"), [f"fn{i}" for i in range(6)]

    def body():
        lines = [f"import {{ {r.choice(names_)} }} from './f{r.randrange(5)}';"] if r.random() < 0.5 else []
        for n in r.sample(names_, r.randint(1, 3)):
            lines.append(f"export function {n}() {{ {r.choice(names_)}(); thing.{r.choice(names_)}(); }}")
        if r.random() < 0.4:
            lines.append(f"class Box{r.randrange(3)} extends Box{r.randrange(3)} {{\n  {r.choice(names_)}(a: Box{r.randrange(3)}) {{ return 1; }}\n}}")
        if r.random() < 0.3:
            lines.append(f"app.get('/x', {r.choice(names_)});")
        return "\n".join(lines) + "\n"

    for i in range(4):
        write(root, f"f{i}.ts", body())
    write(root, "R.md", "# A\n[b](#b)\n## B\n")
    store = Repository(spark, root, str(tmp_path / "s"))
    store.refresh()
    for step in range(2):
        write(root, f"f{r.randrange(5)}.ts", body())
        if step == 1:
            os.remove(os.path.join(root, "f1.ts")) if os.path.exists(os.path.join(root, "f1.ts")) else None
            write(root, "R.md", "# A\n## C\n[c](#c) [b](#b)\n")
        store.refresh()
        cold = Repository(spark, root, str(tmp_path / f"cold{step}"))
        cold.refresh()
        every = lambda df: sorted(map(str, df.collect()))
        assert every(store.nodes) == every(cold.nodes) and every(store.edges) == every(cold.edges)
        assert every(store._stored("unresolved")) == every(cold._stored("unresolved"))


def test_undecodable_files_are_skipped(spark, tmp_path):
    root = str(tmp_path / "r")
    write(root, "good.py", "def good():\n    pass\n")
    with open(os.path.join(root, "bad.py"), "wb") as f:
        f.write(b"def bad(): pass  # \xff\xfe\n")
    fresh = Repository(spark, root, str(tmp_path / "s")).refresh()
    assert (fresh["files_indexed"], fresh["files_skipped"]) == (1, 1)


def test_manifest_is_validated(spark, tmp_path):
    store = Repository(spark, str(tmp_path), str(tmp_path / "s"))
    assert store.manifest() == {"generation": 0, "extractor": None, "folder": None}
    put = lambda text: storage.write_text(spark, f"{store.state}/manifest.json", text)
    put('{"generation": 3, "extractor": "2", "folder": "gen=3"}')
    assert store.manifest()["generation"] == 3
    store.require_rebuild()
    assert store.manifest() == {"generation": 3, "extractor": None, "folder": "gen=3"}
    for bad in ("no json", "[]", "{}", '{"generation": -1}', '{"generation": true}', '{"generation": "4"}'):
        put(bad)
        with pytest.raises(FactsError):
            store.manifest()
