"""Registered queries over the projections, each beside its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.operators import aggregate, graph, imports, markdown, mutate, page, resolve, rows, scan, structure, text
from factloom.plans.projection import oracle, view

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a reader of views as a query."""

    def register(f):
        _QUERIES[name] = lambda spark, sf_dir: f(lambda v: view(spark, sf_dir, v))
        if sql:
            _ORACLES[name] = oracle(sql)
        return f

    return register


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


NODE = ["id", "kind", "name", "file_path", "start_line", "end_line"]
_NODE = ", ".join(NODE)
_EDGE = "source_id, target_id, kind, file_path, line"
EDGE = _EDGE.split(", ")

# --- scans -------------------------------------------------------------------


@query("s03_sha256", "select concat('docs/', cast(doc_id as varchar(20)), '.md') as file_path, sha256(text) as content_hash, 'markdown' as language from documents")
def _(t):
    return scan.fingerprints(t("documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), "text"))


_EXT = "case p_partkey % 9 when 0 then '.ts' when 1 then '.PY' when 2 then '.py' when 3 then '.kts' when 4 then '.tar.hpp' when 5 then '' when 6 then '.R' when 7 then '.md' else '.h' end"


@query(
    "s04_language_detect",
    f"select path, case when path like '%.ts' then 'typescript' when path like '%.py' then 'python' when path like '%.kts' then 'kotlin' when path like '%.hpp' then 'cpp' when path like '%.R' then 'r' when path like '%.md' then 'markdown' when path like '%.h' then 'c' end as language from (select concat('a.b/f', cast(p_partkey as varchar(20)), {_EXT}) as path from part) x",
)
def _(t):
    path = F.expr(f"concat('a.b/f', cast(p_partkey as string), {_EXT})")
    return t("part").select(path.alias("path")).withColumn("language", N.by_extension(F.col("path")))


@query("s05_all_nodes", f"select {_NODE} from p_node order by file_path, start_line, id")
def _(t):
    return scan.in_order(t("p_node").select(NODE))


@query("s06_all_edges", f"select {_EDGE} from p_edge order by 1, 2, 3, 4, 5")
def _(t):
    return scan.edges_in_order(t("p_edge").select(EDGE))


@query("s07_node_by_id", f"select {_NODE} from p_node where id = 'class:src/n1/automobile.ts:Box1:31' or id = (select min(id) from p_sym)")
def _(t):
    first = t("p_sym").agg(F.min("id").alias("id"))
    return scan.nodes_where(t("p_node"), node_id="class:src/n1/automobile.ts:Box1:31").unionByName(t("p_node").join(first, "id", "left_semi")).select(NODE).distinct()


@query("s08_nodes_by_file", f"select {_NODE} from p_node where file_path = 'src/n3/building.ts' order by start_line, id")
def _(t):
    return scan.in_order(scan.nodes_where(t("p_node"), file_path="src/n3/building.ts")).select(NODE)


@query("s09_nodes_by_name", f"select {_NODE} from p_node where name = 'handleBuilding13'")
def _(t):
    return scan.in_order(scan.nodes_where(t("p_node"), name="handleBuilding13")).select(NODE)


@query("s10_nodes_by_kind", f"select {_NODE} from p_node where kind = 'class'")
def _(t):
    return scan.in_order(scan.nodes_where(t("p_node"), kind="class")).select(NODE)


@query("s11_raw_imports", f"select {_EDGE} from p_edge where kind = 'imports' and target_id like 'module:%'")
def _(t):
    return scan.raw_imports(t("p_edge")).select(EDGE)


@query("s12_unresolved", "select source_id, substr(target_id, 8, 100) as specifier, file_path, line from p_edge where kind = 'imports' and target_id like 'module:%' order by file_path, line, specifier")
def _(t):
    return scan.unresolved(t("p_edge")).orderBy("file_path", "line", "specifier")


# --- projections and filters ---------------------------------------------------


@query("p01_symbol_fact", f"select {_NODE.replace('file_path', 'n.file_path')}, h.content_hash as source_hash, 'declaration-pattern' as extractor, 'static' as confidence from p_node n left join p_hash h on h.file_path = n.file_path")
def _(t):
    return scan.symbol_facts(t("p_node"), t("p_hash")).select(*NODE, "source_hash", "extractor", "confidence")


@query(
    "p02_relationship_fact",
    "select e.source_id, e.target_id, e.kind, e.file_path, e.line, s.name as source_name, d.name as target_name, h.content_hash as source_hash, coalesce(e.confidence, 'static') as confidence from p_edge e join p_node s on s.id = e.source_id join p_node d on d.id = e.target_id left join p_hash h on h.file_path = e.file_path",
)
def _(t):
    return scan.relationship_facts(t("p_edge").drop("target_name"), t("p_node"), t("p_hash")).select(*EDGE, "source_name", "target_name", "source_hash", "confidence")


@query("p06_path_prefix", f"select {_NODE} from p_node where file_path = 'src/n1' or starts_with(file_path, 'src/n1/')")
def _(t):
    return scan.nodes_where(t("p_node"), prefix="src/n1/").select(NODE)


@query("p07_scope_top_level", f"select {_NODE} from p_node v where kind <> 'variable' or not exists (select 1 from p_sym s where s.file_path = v.file_path and s.id <> v.id and s.start_line <= v.start_line and s.end_line >= v.end_line)")
def _(t):
    return structure.top_level(t("p_node"), t("p_sym")).select(NODE)


@query("p09_non_heuristic", f"select {_EDGE} from p_edge where coalesce(confidence, 'static') <> 'heuristic'")
def _(t):
    return scan.static_only(t("p_edge")).select(EDGE)


@query("p10_name_exclusion", f"select {_NODE} from p_node where name not in ('handleBuilding13', 'Box1', 'Box2')")
def _(t):
    return scan.excluded(t("p_node"), ["handleBuilding13", "Box1", "Box2"]).select(NODE)


@query("p12_excerpt_lines", "select key, i, bytes_so_far from (select doc_id as key, i, cast(sum(octet_length(encode(line)) + 1) over (partition by doc_id order by i) as bigint) as bytes_so_far from p_lines) x where bytes_so_far <= 4096")
def _(t):
    of_lines = markdown.lines(t("documents"), "doc_id").withColumnRenamed("doc_id", "key")
    return structure.excerpt_lines(of_lines, 4096).select("key", "i", "bytes_so_far")


# --- changes -------------------------------------------------------------------

@query(
    "m01_upsert_last_wins",
    "with old as (select k as slot, name, start_line from p_sym), new as (select slot, name, start_line from (select k % 50 as slot, name, start_line + 1 as start_line, row_number() over (partition by k % 50 order by k desc) as n from p_sym where k % 3 = 1) x where n = 1) select slot, name, start_line from old where slot not in (select slot from new) union all select slot, name, start_line from new",
)
def _(t):
    old = t("p_sym").select(F.col("k").alias("slot"), "name", "start_line")
    new = t("p_sym").where("k % 3 = 1").select((F.col("k") % 50).alias("slot"), "name", (F.col("start_line") + 1).alias("start_line"), "k")
    return mutate.upsert(old, new, ["slot"], "k")


@query(
    "m02_edge_upsert",
    f"with new as (select source_id, target_id, kind, file_path, line, 'new' as label from p_edge where line % 20 = 1 and kind = 'calls') select {_EDGE}, label from new union all select {_EDGE.replace('source_id', 'e.source_id').replace('target_id', 'e.target_id').replace(' kind', ' e.kind').replace('file_path', 'e.file_path').replace(' line', ' e.line')}, coalesce(e.confidence, 'none') as label from p_edge e left join new n on n.source_id = e.source_id and n.target_id = e.target_id and n.kind = e.kind and n.file_path = e.file_path and n.line = e.line where n.line is null",
)
def _(t):
    new = t("p_edge").where("line % 20 = 1 and kind = 'calls'").select(*EDGE, F.lit("new").alias("label"))
    return mutate.upsert(t("p_edge").select(*EDGE, F.coalesce("confidence", F.lit("none")).alias("label")), new, mutate.EDGE_KEY)


_PATHS = "select distinct file_path from p_sym where k % 17 = 3"


def _paths(t):
    return t("p_sym").where("k % 17 = 3").select("file_path").distinct()


@query("m03_replace_file", f"select {_NODE} from p_node where file_path not in ({_PATHS}) union all select {_NODE} from p_sym where k % 17 = 3")
def _(t):
    return mutate.replace_file(t("p_node").select(NODE), _paths(t), t("p_sym").where("k % 17 = 3").select(NODE))


@query("m04_delete_incident", f"with gone as (select id from p_node where file_path in ({_PATHS})) select {_EDGE} from p_edge where source_id not in (select id from gone) and target_id not in (select id from gone)")
def _(t):
    return mutate.delete_incident(t("p_edge"), t("p_node"), _paths(t)).select(EDGE)


@query("m05_delete_keep_incoming", f"select {_EDGE} from p_edge where file_path not in ({_PATHS})")
def _(t):
    return mutate.delete_keep_incoming(t("p_edge"), _paths(t)).select(EDGE)


@query("m06_drop_resolved", f"select {_EDGE} from p_edge where kind <> 'imports' or target_id like 'module:%'")
def _(t):
    return mutate.drop_resolved_imports(t("p_edge")).select(EDGE)


@query("m07_replace_occurrences", f"select {_EDGE} from p_edge where not (kind = 'calls' and line % 3 = 0) union all select source_id, target_id, 'references', file_path, line from p_edge where kind = 'calls' and line % 30 = 0")
def _(t):
    e = t("p_edge").select(EDGE)
    calls = e.where("kind = 'calls'")
    return mutate.replace_occurrences(e, calls.where("line % 3 = 0"), calls.where("line % 30 = 0").withColumn("kind", F.lit("references")))


@query("m11_prune", f"select file_path, content_hash from p_hash where file_path not in ({_PATHS})")
def _(t):
    return mutate.vanished(t("p_hash"), _paths(t)).select("file_path", "content_hash")


# --- structure -----------------------------------------------------------------


@query(
    "x03_kind_dedup",
    "with c as (select file_path, name, start_line, case k % 4 when 0 then 'variable' when 1 then 'function' when 2 then 'class' else 'interface' end as kind, k as match_index from p_sym union all select file_path, name, start_line, case k % 3 when 0 then 'variable' when 1 then 'method' else 'function' end, k + 1000000 from p_sym), r as (select *, row_number() over (partition by file_path, name, start_line order by case kind when 'variable' then 0 when 'function' then 2 when 'interface' then 4 else 3 end desc, match_index) as n from c) select file_path, name, start_line, kind from r where n = 1",
)
def _(t):
    base = t("p_sym")
    one = base.select("file_path", "name", "start_line", F.expr("case k % 4 when 0 then 'variable' when 1 then 'function' when 2 then 'class' else 'interface' end").alias("kind"), F.col("k").alias("match_index"))
    two = base.select("file_path", "name", "start_line", F.expr("case k % 3 when 0 then 'variable' when 1 then 'method' else 'function' end").alias("kind"), (F.col("k") + 1000000).alias("match_index"))
    return structure.kind_dedup(one.unionByName(two)).drop("match_index")


@query(
    "x04_qualified_name",
    "select m.id, concat(string_agg(c.name, '.' order by c.end_line - c.start_line desc, c.start_line, c.id), '.', m.name) as qualified_name from p_sym m join p_class c on c.file_path = m.file_path and c.start_line <= m.start_line and c.end_line >= m.end_line where m.kind = 'method' group by m.id, m.name",
)
def _(t):
    return structure.qualified_names(t("p_node"))


@query(
    "x06_containment",
    "select source_id, target_id, 'contains' as kind, file_path, line from (select c.id as source_id, m.id as target_id, m.file_path, m.start_line as line, row_number() over (partition by m.id order by c.start_line desc, c.id) as n from p_sym m join p_class c on c.file_path = m.file_path and c.start_line <= m.start_line and c.end_line >= m.end_line where m.kind = 'method') x where n = 1",
)
def _(t):
    return structure.containment(t("p_node")).select(EDGE)


@query(
    "x13_enclosing_scope",
    "select okey, coalesce(id, concat('file:', file_path)) as source_id from (select c.okey, c.file_path, n.id, row_number() over (partition by c.okey order by n.end_line - n.start_line nulls last, n.start_line, n.id) as r from p_call c left join p_node n on n.file_path = c.file_path and n.kind in ('function','method','class') and n.start_line <= c.line and n.end_line >= c.line) x where r = 1",
)
def _(t):
    return structure.enclosing_scope(t("p_call"), t("p_node"), "okey")


@query("x09_first_enclosing", "select okey, id as owner_id from (select c.okey, n.id, row_number() over (partition by c.okey order by n.start_line, n.id) as r from p_call c join p_class n on n.file_path = c.file_path and n.start_line <= c.line and n.end_line >= c.line) x where r = 1")
def _(t):
    return structure.first_enclosing(t("p_call"), t("p_node"), "okey", ["class", "interface", "struct"])


@query(
    "x12_type_references",
    "select file_path, line, target_name from (select file_path, line, case when okey % 5 = 0 then 'string' when okey % 5 = 1 then 'Promise' else target_name end as target_name from p_call) x where target_name not in ('string', 'Promise')",
)
def _(t):
    name = F.expr("case when okey % 5 = 0 then 'string' when okey % 5 = 1 then 'Promise' else target_name end")
    return structure.type_references(t("p_call").select("file_path", "line", name.alias("target_name")))


@query("x22_endpoint_handlers", "select distinct concat('endpoint:', cast(e.event_id as varchar(20))) as source_id, s.id as target_id, 'heuristic' as confidence from events e join p_sym s on s.name in (concat('handleBuilding', cast(e.event_id % 97 as varchar(20))), concat('handleMachinery', cast(e.user_id % 97 as varchar(20))))")
def _(t):
    handlers = F.array(F.concat(F.lit("handleBuilding"), (F.col("event_id") % 97).cast("string")), F.concat(F.lit("handleMachinery"), (F.col("user_id") % 97).cast("string")))
    ends = t("events").select(F.concat(F.lit("endpoint:"), F.col("event_id").cast("string")).alias("id"), handlers.alias("handlers"))
    return structure.endpoint_handlers(ends, t("p_node"))


_MD = "case when lvl is not null then concat(repeat('#', lvl), ' ', line) when i % 31 = 7 then '```' else line end"
_MD_HEADS = f"""with m as (select doc_id, i, {_MD} as line from p_md), f as (select *, ltrim(line, ' ') as t, sum(case when starts_with(ltrim(line, ' '), '```') then 1 else 0 end) over (partition by doc_id order by i) as fences from m),
h as (select doc_id, i, length(regexp_extract(t, '^(#+) ', 1)) as level, trim(rtrim(trim(regexp_replace(t, '^#+ ', '')), '#')) as title from f where fences % 2 = 0 and not starts_with(t, '```') and regexp_matches(t, '^#{{1,6}} '))"""


def _heads(t):
    of_lines = t("p_md").select("doc_id", "i", F.expr(_MD).alias("line"))
    return markdown.headings(of_lines, "doc_id")


@query("x23_headings", _MD_HEADS + " select doc_id, i, cast(level as int) as level, title from h where title <> ''")
def _(t):
    return _heads(t)


@query(
    "x24_sections",
    "select h.doc_id, h.i, h.lvl as level, coalesce(min(n.i) - 1, max(l.n)) as end_line from p_md h join (select doc_id, max(i) as n from p_md group by doc_id) l on l.doc_id = h.doc_id left join p_md n on n.doc_id = h.doc_id and n.i > h.i and n.lvl <= h.lvl where h.lvl is not null group by h.doc_id, h.i, h.lvl",
)
def _(t):
    md = t("p_md")
    heads = md.where("lvl is not null").select("doc_id", "i", F.col("lvl").alias("level"))
    return markdown.sections(heads, md.groupBy("doc_id").agg(F.max("i").alias("n")), "doc_id")


@query("x25_hierarchy", "select c.doc_id, c.i, max(p.i) as parent_line from p_md c left join p_md p on p.doc_id = c.doc_id and p.i < c.i and p.lvl < c.lvl where c.lvl is not null group by c.doc_id, c.i")
def _(t):
    heads = t("p_md").where("lvl is not null").select("doc_id", "i", F.col("lvl").alias("level"))
    return markdown.parents(heads, "doc_id").select("doc_id", "i", "parent_line")


@query(
    "x26_anchors",
    "select doc_id, i, case when n = 0 then a else concat(a, '-', cast(n as varchar(20))) end as anchor from (select doc_id, i, a, row_number() over (partition by doc_id, a order by i) - 1 as n from (select doc_id, i, case when i % 8 = 0 then 'intro-part' else concat('part-', cast(i as varchar(20)), 'é') end as a from p_md where lvl is not null) y) x",
)
def _(t):
    title = F.expr("case when i % 8 = 0 then ' Intro  Part!' else concat('Part ', cast(i as string), 'É?') end")
    heads = t("p_md").where("lvl is not null").select("doc_id", "i", title.alias("title"))
    return markdown.anchors(heads, "doc_id").select("doc_id", "i", "anchor")


# --- joins ---------------------------------------------------------------------


def _start(t):
    return t("p_sym").agg(F.min("id")).first()[0]


@query("j01_frontier", "select e.source_id, e.target_id, e.file_path, e.line from p_edge e join p_node a on a.id = e.source_id join p_node b on b.id = e.target_id where e.kind = 'calls' and coalesce(e.confidence, 'static') <> 'heuristic' and e.source_id in (select id from p_sym)")
def _(t):
    return graph.frontier(t("p_edge"), t("p_node"), t("p_sym").select("id"))


@query("j05_out_edges", f"select {_EDGE} from p_edge where kind = 'calls' and source_id in (select id from p_sym)")
def _(t):
    return scan.out_edges(t("p_edge"), t("p_sym"), "calls").select(EDGE)


@query("j06_in_edges", f"select {_EDGE} from p_edge where target_id in (select id from p_sym)")
def _(t):
    return scan.in_edges(t("p_edge"), t("p_sym")).select(EDGE)


_J10 = "select e.okey, e.source_id, e.target_name, e.file_path, e.call_form, n.id as cand, n.file_path as cfp, count(*) over (partition by e.okey) as n_c, sum(case when n.file_path = e.file_path then 1 else 0 end) over (partition by e.okey) as n_s, row_number() over (partition by e.okey order by n.file_path, n.start_line, n.id) as rn from p_call e join p_node n on n.name = e.target_name and case when e.constructor then n.kind in ('class','struct') else n.kind in ('function','method') end"


@query("j10_candidates", f"select okey, cand as target_id, cast(rn as int) as rn, n_c as candidate_count, cast(n_s as bigint) as same_file from ({_J10}) c")
def _(t):
    return resolve.callable_candidates(t("p_call"), t("p_node"), "okey").select("okey", "target_id", "rn", "candidate_count", "same_file")


_J11 = f"select *, case when call_form = 'member' and n_c > 1 then 'polymorphic' when n_s = 1 then 'static' when n_c <= 1 then 'static' else 'ambiguous_name' end as resolution from ({_J10}) c"
_J11_KEEP = "(resolution = 'polymorphic' and rn <= {n}) or (resolution = 'static' and (n_c = 1 or (n_s = 1 and cfp = file_path))) or (resolution = 'ambiguous_name' and rn = 1)"


@query("j11_call_choice", f"select okey, source_id, cand as target_id, resolution, n_c as candidate_count from ({_J11}) k where {_J11_KEEP.format(n=32)}")
def _(t):
    return resolve.chosen(t("p_call"), t("p_node"), "okey").select("okey", "source_id", "target_id", "resolution", "candidate_count")


@query("j12_fanout", f"select okey, cand as target_id, resolution = 'polymorphic' and n_c > 2 as truncated from ({_J11}) k where {_J11_KEEP.format(n=2)}")
def _(t):
    return resolve.chosen(t("p_call"), t("p_node"), "okey", 2).select("okey", "target_id", "truncated")


@query(
    "j14_target_resolve",
    "select okey, coalesce(id, concat('unresolved:', target_name)) as target_id from (select e.okey, e.target_name, n.id, row_number() over (partition by e.okey order by case when n.file_path = e.file_path then 0 when n.id is null then 2 else 1 end, case when n.exported then 0 else 1 end, n.file_path, n.start_line, n.id) as r from (select okey, file_path, case when okey % 9 = 0 then concat(target_name, 'X') else target_name end as target_name from p_call) e left join p_node n on n.name = e.target_name) x where r = 1",
)
def _(t):
    refs = t("p_call").select("okey", "file_path", F.expr("case when okey % 9 = 0 then concat(target_name, 'X') else target_name end").alias("target_name"))
    return resolve.best_targets(refs, t("p_node"), "okey").select("okey", "target_id")


@query(
    "j15_rebind",
    f"with k as ({_J11}), found as (select okey, cand as target_id, resolution from k where ({_J11_KEEP.format(n=32)}) and target_name in (select name from p_sym where k % 6 = 0)) select okey, target_id, resolution from found union all select okey, concat('unresolved:', target_name), 'unresolved' from p_call where target_name in (select name from p_sym where k % 6 = 0) and okey not in (select okey from found)",
)
def _(t):
    return resolve.rebind(t("p_call"), t("p_sym").where("k % 6 = 0"), t("p_node"), "okey").select("okey", "target_id", "resolution")


_IMPORT = "select okey, file_path, case when okey % 3 = 0 and raw like '%.ts' then concat(substr(raw, 1, length(raw) - 3), '.js') when okey % 3 = 1 and raw like '%.ts' then substr(raw, 1, length(raw) - 3) else raw end as specifier from p_import"
_BASE = "case when specifier like './%' then concat(substr(file_path, 1, length(file_path) - strpos(reverse(file_path), '/')), '/', substr(specifier, 3, 1000)) when specifier like '../%' then concat('src/', substr(specifier, 4, 1000)) when specifier like '@/%' then concat('src/', substr(specifier, 3, 1000)) end"
_PROBED = f"with q as ({_IMPORT}), b as (select *, {_BASE} as base from q), l as (select * from b where base is not null), f as (select distinct file_path as fp from p_sym), r as (select okey, file_path, specifier, coalesce((select fp from f where fp = base), (select fp from f where base like '%.js' and fp = concat(substr(base, 1, length(base) - 3), '.ts')), (select fp from f where strpos(substr(base, length(base) - strpos(reverse(base), '/') + 2, 1000), '.') = 0 and fp = concat(base, '.ts'))) as resolved from l)"


def _probed(t):
    found = t("p_import").select("okey", "file_path", F.expr(_IMPORT.split("file_path, ", 1)[1].split(" as specifier")[0]).alias("specifier"))
    return imports.probed(found, t("p_sym").select("file_path").distinct(), "okey")


@query("j16_import_probe", _PROBED + " select okey, specifier, resolved from r")
def _(t):
    return _probed(t).select("okey", "specifier", "resolved")


@query("j17_wildcard", _PROBED + " select r.okey, n.id as target_id from r join p_node n on n.file_path = r.resolved and n.exported")
def _(t):
    return imports.wildcard(_probed(t), t("p_node")).select("okey", "target_id")


_NAMED = "concat('handleBuilding', cast(okey % 97 as varchar(20)))"


@query(
    "j18_named",
    _PROBED + f", w as (select okey, resolved, {_NAMED} as name from r where resolved is not null union all select okey, resolved, 'Box1' from r where resolved is not null) select okey, name, id as target_id from (select w.okey, w.name, n.id, row_number() over (partition by w.okey, w.name order by case when n.file_path = w.resolved then 0 else 1 end, n.file_path, n.start_line, n.id) as k from w join p_node n on n.name = w.name) x where k = 1",
)
def _(t):
    wanted = F.array(F.concat(F.lit("handleBuilding"), (F.col("okey") % 97).cast("string")), F.lit("Box1"))
    return imports.named(_probed(t).withColumn("names", wanted), t("p_node"), "okey").select("okey", "name", "target_id")


@query("j19_barrel", _PROBED + " select distinct r.file_path, n.id as target_id, n.name from r join p_node n on n.file_path = r.resolved and n.exported")
def _(t):
    return imports.barrels(_probed(t).select("file_path", "resolved").distinct(), t("p_node")).select("file_path", "target_id", "name")


_SNAP = "select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.h is null then 'added' when b.h is null then 'removed' when a.h <> b.h then 'changed' else 'same' end as state from (select doc_id, sha256(text) as h from documents where doc_id % 10 <> 0) a full outer join (select doc_id, sha256(case when doc_id % 7 = 0 then concat(text, '!') else text end) as h from documents where doc_id % 13 <> 0) b on a.doc_id = b.doc_id"


@query("j20_changed", _SNAP)
def _(t):
    docs = t("documents")
    old = docs.where("doc_id % 10 <> 0").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    new = docs.where("doc_id % 13 <> 0").select("doc_id", F.sha2(F.expr("case when doc_id % 7 = 0 then concat(text, '!') else text end"), 256).alias("content_hash"))
    return mutate.snapshot_states(old, new, "doc_id")


# --- aggregates ----------------------------------------------------------------


@query("a04_stats", "select (select count(*) from p_node) as nodes, (select count(distinct file_path) from p_node) as files, (select count(*) from p_edge) as edges")
def _(t):
    return aggregate.stats(t("p_node"), t("p_edge"))


@query("a05_lang_files", "select language, count(*) as n from p_hash group by language")
def _(t):
    return aggregate.counted(t("p_hash"), "language")


@query("a07_kinds", "select kind, count(*) as n from p_node group by kind")
def _(t):
    return aggregate.counted(t("p_node"), "kind")


@query("a09_unresolved_report", "with u as (select source_id, substr(target_id, 8, 100) as specifier, file_path, line from p_edge where kind = 'imports' and target_id like 'module:%') select source_id, specifier, file_path, line, (select count(*) from u) as total, (select count(*) from u) > 20 as truncated from u order by file_path, line, specifier limit 20")
def _(t):
    return aggregate.unresolved_report(scan.unresolved(t("p_edge")))


@query("a11_candidate_counts", "select c.okey, c.target_name, n.n as candidate_count from p_call c join (select name, count(*) as n from p_node where kind in ('function','method') group by name) n on n.name = c.target_name")
def _(t):
    return aggregate.candidate_counts(t("p_call"), t("p_node"), "okey")


@query("a12_distinct_names", "select distinct name from p_node")
def _(t):
    return t("p_node").select("name").distinct()


def _docs_index(t):
    return text.stored(text.index(t("documents"), "doc_id", ["text"]))


_TOK = "select doc_id, w from (select doc_id, unnest(regexp_split_to_array(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+')) as w from documents) z where w <> ''"


@query("a13_corpus_stats", f"with tok as ({_TOK}) select w as term, count(distinct doc_id) as df, count(*) as tf from tok group by w")
def _(t):
    return text.term_counts(t("documents"), "doc_id", "text")


@query("a15_p95", "select event_type, min(value) as least, quantile_disc(value, 0.5) as median, quantile_disc(value, 0.95) as p95, max(value) as most from events group by event_type")
def _(t):
    return aggregate.nearest_rank(t("events"), "event_type", "value")


# --- text ----------------------------------------------------------------------


@query("t01_tokens", f"with tok as ({_TOK}) select doc_id, count(*) as n, count(distinct w) as n_distinct, min(w) as least from tok group by doc_id")
def _(t):
    posted = text.postings(t("documents"), "doc_id", ["text"])
    return posted.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("term").alias("n_distinct"), F.min("term").alias("least"))


_SPLIT = "regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
_NAMES = "select k, case k % 4 when 0 then name when 1 then replace(name, 'handle', 'HTTPHandle') when 2 then concat(lower(name), '_part_', cast(k as varchar(20))) else upper(name) end as name from p_sym"


@query("t03_split_identifier", f"select k, case when strpos(trim(replace({_SPLIT}, '_', ' ')), ' ') > 0 then concat(name, ' ', lower(trim(replace({_SPLIT}, '_', ' ')))) else name end as tokens from ({_NAMES}) x")
def _(t):
    name = F.expr("case k % 4 when 0 then name when 1 then replace(name, 'handle', 'HTTPHandle') when 2 then concat(lower(name), '_part_', cast(k as string)) else upper(name) end")
    return t("p_sym").select("k", N.split_identifier(name).alias("tokens"))


@query("t05_match", f"with tok as ({_TOK}) select distinct a.doc_id from tok a join tok b on b.doc_id = a.doc_id where a.w like 'token%' and b.w like 'en%'")
def _(t):
    return text.ranked(_docs_index(t), "token en", "doc_id").select("doc_id")


def _bm25(prefix: str) -> str:
    return f"with tok as ({_TOK}), dl as (select d.doc_id, count(tok.w) as l from documents d left join tok on tok.doc_id = d.doc_id group by d.doc_id), n as (select count(*) as nn, avg(l) as av from dl), tf as (select doc_id, count(*) as f from tok where w like '{prefix}%' group by doc_id), df as (select count(*) as k from tf) select tf.doc_id, round(-greatest(ln((n.nn - df.k + 0.5)/(df.k + 0.5)), 1e-6) * tf.f * 2.2 / (tf.f + 1.2*(0.25 + 0.75*dl.l/n.av)), 6) as score from tf join dl on dl.doc_id = tf.doc_id cross join n cross join df"


@query("t06_bm25_common", _bm25("the"))
def _(t):
    return text.ranked(_docs_index(t), "the", "doc_id")


@query("t06_bm25_rare", _bm25("token"))
def _(t):
    return text.ranked(_docs_index(t), "Token", "doc_id")


@query("t07_exact_first", f"select {_NODE}, cast(case name when 'handleBuilding13 Box1' then 1 when 'handleBuilding13' then 2 else 3 end as double) as place from p_node where name in ('handleBuilding13 Box1', 'handleBuilding13', 'Box1')")
def _(t):
    return text.exact(t("p_node"), "handleBuilding13 Box1").select(*NODE, "place")


_PAGE_TOK = "select id, w from (select id, unnest(regexp_split_to_array(lower(concat(name, ' ', file_path)), '[^\\p{L}\\p{N}]+')) as w from p_node) z where w <> ''"


@query(
    "t08_page",
    f"with tok as ({_PAGE_TOK}), dl as (select id, count(*) as l from tok group by id), n as (select count(*) as nn, avg(l) as av from dl), tf as (select id, count(*) as f from tok where w like 'handlebuilding1%' group by id), df as (select count(*) as k from tf), s as (select tf.id, round(-greatest(ln((n.nn - df.k + 0.5)/(df.k + 0.5)), 1e-6) * tf.f * 2.2 / (tf.f + 1.2*(0.25 + 0.75*dl.l/n.av)), 6) as score from tf join dl on dl.id = tf.id cross join n cross join df), b as (select id, name, file_path, start_line, 0 as block, 1.0 as place from p_node where name = 'handleBuilding1' union all select p.id, p.name, p.file_path, p.start_line, 1, s.score from s join p_node p on p.id = s.id where p.name <> 'handleBuilding1') select id, name, block, cast(place as double) as place from b order by block, place, file_path, start_line, id limit 20 offset 3",
)
def _(t):
    found = text.search(t("p_node"), text.stored(text.index(t("p_node"), "id", ["name", "file_path"])), "handleBuilding1")
    return found.orderBy("block", "place", "file_path", "start_line", "id").offset(3).limit(20).select("id", "name", "block", "place")


_BODIES = "select concat('method:docs.ts:Doc', cast(doc_id as varchar(20)), ':1') as id, concat('Doc', cast(doc_id as varchar(20))) as name, 'docs.ts' as file_path, text as body from documents"


@query(
    "t09_body_search",
    f"with d as ({_BODIES}), tok as (select id, w from (select id, unnest(regexp_split_to_array(lower(strip_accents(concat(name, ' ', coalesce(body, ''), ' ', file_path))), '[^\\p{{L}}\\p{{N}}]+')) as w from d) z where w <> ''), dl as (select id, count(*) as l from tok group by id), n as (select count(*) as nn, avg(l) as av from dl), tf as (select id, count(*) as f from tok where w like 'contact%' group by id), df as (select count(*) as k from tf) select d.name, d.file_path, 1 as block, round(-greatest(ln((n.nn - df.k + 0.5)/(df.k + 0.5)), 1e-6) * tf.f * 2.2 / (tf.f + 1.2*(0.25 + 0.75*dl.l/n.av)), 6) as place from tf join dl on dl.id = tf.id join d on d.id = tf.id cross join n cross join df",
)
def _(t):
    key = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    number = F.col("doc_id").cast("string")
    nodes = t("documents").select(key("method:docs.ts:Doc", number, ":1").alias("id"), key("Doc", number).alias("name"), F.lit("docs.ts").alias("file_path"), F.col("text").alias("body"))
    return text.search(nodes, text.stored(text.index(nodes, "id", ["name", "body", "file_path"])), "contact").select("name", "file_path", "block", "place")


# --- graph ---------------------------------------------------------------------

_LEVELS = "with recursive e as (select distinct x.source_id, x.target_id from p_edge x join p_node n on n.id = x.target_id where x.kind = 'calls' and coalesce(x.confidence, 'static') <> 'heuristic'), b as (select min(id) as id, 0 as level from p_sym union select e.target_id, b.level + 1 from b join e on e.source_id = b.id where b.level < 6)"


@query("g01_bfs_levels", _LEVELS + " select id, min(level) as level from b group by id")
def _(t):
    edges, start = t("p_edge"), _start(t)
    return graph.levels(edges, t("p_node"), start, depth=6, most=None).select("id", "level")


def _path(t, start):
    """The path from start to the last node of the third level."""
    found = graph.levels(t("p_edge"), t("p_node"), start, depth=3, most=None)
    goal = found.where("level = 3").agg(F.max("id")).first()[0]
    return graph.shortest_path(t("p_edge"), t("p_node"), start, goal, most=None) if goal else None


@query("g02_path", _LEVELS + " select min(level) as length, count(*) as ends from b where id = (select max(id) from b where level = 3 and id not in (select id from b where level < 3)) group by level order by level limit 1")
def _(t):
    edges, start = t("p_edge"), _start(t)
    path = _path(t, start)
    rows = [(len(path), 1)] if path is not None else []
    return edges.sparkSession.createDataFrame(rows, "length int, ends long")


@query("g06_neighbourhood", "with h as (select source_id as id from p_edge where kind = 'calls' group by source_id order by count(*) desc, source_id limit 1), r as (select e.* from p_edge e join p_node a on a.id = e.source_id join p_node b on b.id = e.target_id where e.kind in ('calls','references')) select source_id, target_id, kind, file_path, line, 'out' as direction from r where source_id in (select id from h) union all select source_id, target_id, kind, file_path, line, 'in' from r where target_id in (select id from h)")
def _(t):
    hub = t("p_edge").where("kind = 'calls'").groupBy("source_id").count().orderBy(F.desc("count"), "source_id").first()[0]
    return graph.neighbourhood(t("p_edge"), t("p_node"), hub)


@query("g07_related_tests", "with h as (select target_id as id from p_edge e join p_sym s on s.id = e.source_id where e.kind = 'calls' and s.is_test and coalesce(e.confidence, 'static') <> 'heuristic' group by target_id order by count(*) desc, target_id limit 1) select n.id, strpos(lower(n.name), lower((select name from p_sym where id = (select id from h)))) > 0 as by_name, n.file_path = (select file_path from p_sym where id = (select id from h)) as same_file from p_node n where n.is_test and n.id <> (select id from h) and n.id in (select source_id from p_edge where target_id = (select id from h) and coalesce(confidence, 'static') <> 'heuristic' union select target_id from p_edge where source_id = (select id from h) and coalesce(confidence, 'static') <> 'heuristic')")
def _(t):
    edges, nodes = t("p_edge"), t("p_node")
    calls = graph.static_calls(edges).join(t("p_sym").where("is_test").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    hub = calls.groupBy("target_id").count().orderBy(F.desc("count"), "target_id").first()[0]
    of = nodes.where(F.col("id") == hub).first()
    return graph.related_tests(edges, nodes, hub, of["name"], of["file_path"]).select("id", "by_name", "same_file")


# --- paging and sets ------------------------------------------------------------


@query("l02_page", f"select {_NODE} from p_node order by file_path, start_line, id limit 21 offset 40")
def _(t):
    return scan.in_order(t("p_node").select(NODE)).offset(40).limit(21)


@query("l07_outline", f"select {_NODE} from p_node where file_path = 'src/n3/building.ts' and kind <> 'variable' order by start_line, id limit 50")
def _(t):
    return scan.in_order(structure.top_level(scan.nodes_where(t("p_node"), file_path="src/n3/building.ts"), t("p_sym")).where("kind <> 'variable'")).limit(50).select(NODE)


@query("u03_changed_names", "select name from p_sym where k % 5 = 0 union select name from p_sym where k % 7 = 0 union select name from p_class")
def _(t):
    return mutate.changed_names(t("p_sym").where("k % 5 = 0"), t("p_sym").where("k % 7 = 0"), t("p_class"))


@query("u04_exact_union", f"select {_NODE} from p_node where name = 'Box1' or (file_path like 'src/n1/%' and name <> 'Box1')")
def _(t):
    return mutate.exact_first(scan.nodes_where(t("p_node"), name="Box1").select(NODE), scan.nodes_where(t("p_node"), prefix="src/n1"))


# --- scalar functions -------------------------------------------------------------


@query("f01_id", "select id from p_sym")
def _(t):
    return t("p_sym").select(N.node_id(F.col("kind"), F.col("file_path"), F.col("name"), F.col("start_line")).alias("id"))


_TEST_IN = "select k, case k % 6 when 0 then 'python' when 1 then 'go' when 2 then 'rust' when 3 then 'typescript' when 4 then 'lua' else 'java' end as language, case k % 5 when 0 then concat('test_', name) when 1 then concat('Test', name) when 2 then concat(name, 'Test') when 3 then 'describe' else name end as name, case k % 4 when 0 then file_path when 1 then concat('a/tests/', file_path) when 2 then replace(file_path, '.ts', '.spec.ts') else concat(file_path, '_test.go') end as path, kind from p_sym"


@query(
    "f06_is_test",
    f"select k, case language when 'python' then starts_with(lower(name), 'test_') or starts_with(name, 'Test') or strpos(lower(path), '/tests/') > 0 or strpos(lower(path), '/test_') > 0 or ends_with(lower(path), '_test.py') when 'go' then starts_with(name, 'Test') or starts_with(name, 'Benchmark') or starts_with(name, 'Example') or ends_with(lower(path), '_test.go') when 'rust' then starts_with(lower(name), 'test_') or name = 'test' or strpos(lower(path), '/tests/') > 0 or ends_with(lower(path), '_test.rs') or (strpos(lower(path), 'test') > 0 and strpos(lower(name), 'test') > 0) when 'typescript' then lower(name) in ('describe','it','test','xit','xdescribe') or ((strpos(lower(path), '.test.') > 0 or strpos(lower(path), '.spec.') > 0) and kind in ('function','method','variable')) when 'java' then starts_with(lower(name), 'test') or ends_with(name, 'Test') or ends_with(name, 'Tests') or ends_with(name, 'Spec') or strpos(lower(path), '/test/') > 0 or strpos(lower(path), 'test.java') > 0 or strpos(lower(path), 'test.kt') > 0 else strpos(lower(name), 'test') > 0 and (strpos(lower(path), 'test') > 0 or strpos(lower(path), 'spec') > 0) end as is_test from ({_TEST_IN}) x",
)
def _(t):
    part = lambda a, b: F.expr(_TEST_IN.split(a, 1)[0].rsplit(b, 1)[1].strip())
    lang = part(" as language", "select k,")
    name = part(" as name,", "as language,")
    path = part(" as path,", "as name,")
    rows = t("p_sym").select("k", lang.alias("language"), name.alias("name"), path.alias("path"), "kind")
    return rows.select("k", N.is_test(F.col("name"), F.col("path"), F.col("language"), F.col("kind")).alias("is_test"))


@query("f08_normalize_path", "select k, concat('src/', name, '/x') as path from p_sym")
def _(t):
    messy = F.concat(F.lit("./../src//a/../"), F.col("name"), F.lit("/./b/c/../../x/."))
    return t("p_sym").select("k", N.normalize_path(messy).alias("path"))


_UNITS = "flatten(list_transform(string_split(concat(name, 'é😀'), ''), lambda c: case when ord(c) > 65535 then [55296 + (ord(c) - 65536) // 1024, 56320 + (ord(c) - 65536) % 1024] else [ord(c)] end))"


@query(
    "f11_simple_hash",
    f"select k, concat(case when h < 0 then '-' else '' end, coalesce(nullif(ltrim(array_to_string(list_transform(range(6, -1, -1), lambda d: substr('0123456789abcdefghijklmnopqrstuvwxyz', cast(abs(h) // cast(pow(36, d) as bigint) % 36 as int) + 1, 1)), ''), '0'), ''), '0')) as hash from (select k, list_reduce(list_prepend(cast(0 as bigint), cast({_UNITS} as bigint[])), lambda a, b: ((a * 31 + b + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) as h from p_sym) x",
)
def _(t):
    return t("p_sym").select("k", N.simple_hash(F.concat("name", F.lit("é😀"))).alias("hash"))


# --- stored rows -------------------------------------------------------------------

_KIND_IN = "case k % 6 when 0 then 'field' when 1 then 'const' when 2 then 'package' when 3 then 'Function' when 4 then 'method' else 'gadget' end"
_KIND_OUT = "case k % 6 when 0 then 'property' when 1 then 'constant' when 2 then 'namespace' when 3 then 'variable' when 4 then 'method' else 'variable' end"
_LANG_IN = "case k % 5 when 0 then 'GoLang' when 1 then 'C++' when 2 then 'rust' when 3 then 'klingon' else 'Shell' end"
_LANG_OUT = "case k % 5 when 0 then 'go' when 1 then 'cpp' when 2 then 'rust' when 3 then 'typescript' else 'bash' end"
_META = "case k % 4 when 0 then concat('{\"body\": \"fn ', name, '\", \"exported\": true}') when 1 then '{\"body\": 7, \"exported\": \"yes\"}' when 2 then 'no json' end"


@query("s16_decode_nodes", f"select id, {_KIND_OUT} as kind, {_LANG_OUT} as language, case when k % 4 = 0 then concat('fn ', name) end as body, case when k % 4 = 0 then true end as exported from p_sym")
def _(t):
    stored = t("p_sym").select("id", F.expr(_KIND_IN).alias("kind"), F.expr(_LANG_IN).alias("language"), F.expr(_META).alias("metadata"))
    return rows.decoded_nodes(stored)


@query("s16_decode_edges", "select id as source_id, case when k % 3 = 0 then 'calls' else 'references' end as kind, case when k % 2 = 0 then file_path else concat('old/', file_path) end as file_path, cast(case when k % 4 < 2 then start_line when k % 4 = 2 then 12 else 0 end as int) as line, case when k % 4 = 2 then 'heuristic' end as confidence from p_sym")
def _(t):
    stored = t("p_sym").select(F.col("id").alias("source_id"), F.expr("case k % 3 when 0 then 'calls' when 1 then 'Calls' end").alias("kind"), F.expr("case when k % 2 = 0 then file_path else '' end").alias("file_path"), F.expr("cast(case when k % 4 < 2 then start_line else 0 end as int)").alias("line"), F.expr("concat('{\"filePath\": \"old/', file_path, '\", \"line\": ', case when k % 4 = 2 then '\"12\", \"confidence\": \"heuristic\"' else '\"x\"' end, '}')").alias("properties"))
    return rows.decoded_edges(stored)


@query("f03_loose_names", f"select k, {_KIND_OUT} as kind, {_LANG_OUT} as language, case when k % 3 = 0 then 'calls' else 'references' end as edge_kind from p_sym")
def _(t):
    edge = F.expr("case when k % 3 = 0 then 'calls' else 'CALLS' end")
    return t("p_sym").select("k", N.kind_or(F.expr(_KIND_IN), "variable").alias("kind"), N.language_or(F.expr(_LANG_IN), "typescript").alias("language"), N.edge_kind_or(edge, "references").alias("edge_kind"))


@query("f07_rust_tests", "select k, k % 4 in (0, 1, 3) as is_test from p_sym")
def _(t):
    body = F.expr("case k % 4 when 0 then concat('#[test]\nfn ', name) when 1 then concat('  #[cfg(x)]\n#[tokio::test(flavor = \"x\")]\nasync fn ', name) when 2 then concat('fn ', name, '() { #[test] }') else 'fn x' end")
    qualified = F.expr("case when k % 4 = 3 then concat('tests.', name) else concat('contests.', name) end")
    return t("p_sym").select("k", N.rust_test_marks(body, qualified).alias("is_test"))


@query("f14_json_value", "select k, case when k % 4 = 0 then concat('fn ', name) end as body from p_sym")
def _(t):
    return t("p_sym").select("k", rows.json_text(F.expr(_META), "body").alias("body"))


@query("f16_truncated", "select doc_id, cast(case when octet_length(encode(text)) <= 100 then length(text) else list_count(list_filter(range(1, 101), lambda i: octet_length(encode(substr(text, 1, i))) <= 100)) end as int) as chars, substr(text, 1, case when octet_length(encode(text)) <= 100 then length(text) else list_count(list_filter(range(1, 101), lambda i: octet_length(encode(substr(text, 1, i))) <= 100)) end) as head from documents")
def _(t):
    return t("documents").select("doc_id", N.truncated(F.col("text"), 100).alias("head")).select("doc_id", F.length("head").alias("chars"), "head")


@query("f19_envelopes", "select k, concat('{\"startColumn\":3,\"endColumn\":9', case when k % 2 = 0 then concat(',\"body\":\"', name, '\"') else '' end, case when exported then ',\"exported\":true' else ',\"exported\":false' end, '}') as node, concat('{\"confidence\":\"static\",\"filePath\":\"', file_path, '\",\"line\":\"', cast(start_line as varchar(20)), '\"}') as edge from p_sym")
def _(t):
    nodes = t("p_sym").withColumn("start_column", F.lit(3)).withColumn("end_column", F.lit(9)).withColumn("body", F.expr("case when k % 2 = 0 then name end"))
    props = F.create_map(F.lit("confidence"), F.lit("static"), F.lit("line"), F.lit("0"))
    return nodes.select("k", rows.node_envelope(nodes).alias("node"), rows.edge_envelope(props, F.col("file_path"), F.col("start_line")).alias("edge"))


@query("x27_links", "select file_path, i, case when i % 2 = 0 then 'part-one' else 'intro' end as target from p_md where lvl is not null union all select file_path, i, 'intro' from p_md where lvl is not null and i % 2 = 0")
def _(t):
    line = F.expr("case when lvl is null then '![x](#part-one) `[y](#intro)` plain' when i % 2 = 0 then 'a [b](#Part One) ![no](#x) [c](<#intro>) `[d](#d)`' else 'see [e]( #Intro )' end")
    return markdown.links(t("p_md").select("file_path", "i", line.alias("line")))


@query("l01_limits", "select k, cast(greatest(1, least(50, case when k % 7 = 0 then 20 else k % 90 - 10 end)) as int) as most from p_sym")
def _(t):
    return t("p_sym").select("k", page.bounded_limits(F.expr("case when k % 7 <> 0 then cast(k % 90 - 10 as int) end")).alias("most"))


@query("a14_providers", "select case when language in ('typescript', 'tsx', 'javascript', 'jsx') then 'typescript-language-server' when language = 'rust' then 'rust-analyzer' end as provider, count(distinct language) as languages, count(*) as n from (select case k % 5 when 0 then 'typescript' when 1 then 'tsx' when 2 then 'rust' when 3 then 'go' else 'python' end as language from p_sym) x group by 1")
def _(t):
    nodes = t("p_sym").select(F.expr("case k % 5 when 0 then 'typescript' when 1 then 'tsx' when 2 then 'rust' when 3 then 'go' else 'python' end").alias("language"))
    return aggregate.providers(nodes)


# --- workflows ---------------------------------------------------------------------


@query("map_report", "select 'symbols' as fact, kind as label, count(*) as n from p_node group by kind union all select 'relationships', kind, count(*) from p_edge group by kind union all select 'files', language, count(*) from p_hash group by language union all select 'unresolved', 'import', count(*) from p_edge where kind = 'imports' and target_id like 'module:%'")
def _(t):
    return aggregate.report(t("p_node"), t("p_edge"), t("p_hash"), scan.unresolved(t("p_edge")))


@query(
    "expand_symbol",
    "with h as (select source_id as id from p_edge where kind = 'calls' group by source_id order by count(*) desc, source_id limit 1), r as (select e.* from p_edge e join p_node a on a.id = e.source_id join p_node b on b.id = e.target_id) select case when kind = 'calls' then 'callees' else 'references_out' end as section, target_id as other, line from r where kind in ('calls','references') and source_id in (select id from h) union all select case when kind = 'calls' then 'callers' else 'references_in' end, source_id, line from r where kind in ('calls','references') and target_id in (select id from h)",
)
def _(t):
    hub = t("p_edge").where("kind = 'calls'").groupBy("source_id").count().orderBy(F.desc("count"), "source_id").first()[0]
    return graph.sections(graph.neighbourhood(t("p_edge"), t("p_node"), hub))


# --- more of the same families ---------------------------------------------------


@query("s13_hash_table", "select file_path, content_hash, language from p_hash")
def _(t):
    return scan.hash_table(t("p_hash"))


@query("s14_hash_join", "select n.id, h.content_hash from p_node n left join p_hash h on h.file_path = n.file_path")
def _(t):
    return scan.symbol_facts(t("p_node"), t("p_hash")).select("id", F.col("source_hash").alias("content_hash"))


@query("p05_kind", f"select {_NODE} from p_node where kind = 'method' and file_path = 'src/n3/building.ts'")
def _(t):
    return scan.nodes_where(t("p_node"), kind="method", file_path="src/n3/building.ts").select(NODE)


@query("m09_hash_upsert", f"select file_path, case when file_path in ({_PATHS}) then 'new' else content_hash end as content_hash from p_hash union select file_path, 'new' from p_sym where k % 17 = 3")
def _(t):
    new = _paths(t).withColumn("content_hash", F.lit("new"))
    return mutate.upsert(t("p_hash").select("file_path", "content_hash"), new, ["file_path"])


@query("m10_remove_file", f"select 'edge' as fact, source_id as what, line from p_edge where file_path not in ({_PATHS}) union all select 'hash', file_path, 0 from p_hash where file_path not in ({_PATHS}) union all select 'unresolved', substr(target_id, 8, 1000), line from p_edge where kind = 'imports' and target_id like 'module:%' and file_path not in ({_PATHS})")
def _(t):
    edges, hashes, lost = mutate.remove_files(t("p_edge"), t("p_hash"), scan.unresolved(t("p_edge")), _paths(t))
    row = lambda df, fact, what, line: df.select(F.lit(fact).alias("fact"), F.col(what).alias("what"), line.alias("line"))
    return row(edges, "edge", "source_id", F.col("line")).unionByName(row(hashes, "hash", "file_path", F.lit(0))).unionByName(row(lost, "unresolved", "specifier", F.col("line")))


@query("m08_unresolved", f"with u as (select source_id, substr(target_id, 8, 1000) as specifier, file_path, line from p_edge where kind = 'imports' and target_id like 'module:%') select source_id, specifier, file_path, line from u where file_path not in ({_PATHS}) union select source_id, concat(specifier, '.new'), file_path, line from u where file_path in ({_PATHS})")
def _(t):
    old = scan.unresolved(t("p_edge"))
    new = old.join(_paths(t), "file_path", "left_semi").select("source_id", F.concat("specifier", F.lit(".new")).alias("specifier"), "file_path", "line")
    return mutate.replace_unresolved(old, _paths(t), new)


@query("j03_related_tests", "with t as (select id from p_node where is_test) select distinct t.id from t where exists (select 1 from p_edge e where e.source_id = t.id and e.kind = 'calls' and coalesce(e.confidence, 'static') <> 'heuristic') or exists (select 1 from p_edge e where e.target_id = t.id and e.kind = 'calls' and coalesce(e.confidence, 'static') <> 'heuristic')")
def _(t):
    return graph.tested(t("p_edge"), t("p_node"))


@query("j07_confirmed", "select e.source_id, e.target_id, e.kind, e.file_path, e.line from p_edge e join p_node a on a.id = e.source_id join p_node b on b.id = e.target_id where e.kind = 'calls' order by e.source_id, e.target_id, e.line limit 50")
def _(t):
    found = graph.real(t("p_edge").where("kind = 'calls'"), t("p_node"))
    return found.orderBy("source_id", "target_id", "line").limit(50).select(EDGE)


@query("j21_reparsed_exclusion", f"select {_NODE} from p_node where file_path not in ({_PATHS})")
def _(t):
    return mutate.vanished(t("p_node"), _paths(t)).select(NODE)


@query("a01_count_nodes", "select count(*) as n from p_node")
def _(t):
    return aggregate.node_stats(t("p_node")).select(F.col("nodes").alias("n"))


@query("a03_count_files", "select count(distinct file_path) as n from p_node")
def _(t):
    return aggregate.node_stats(t("p_node")).select(F.col("files").alias("n"))


@query("a06_lang_symbols", "select coalesce(h.language, 'none') as language, count(*) as n from p_node n left join p_hash h on h.file_path = n.file_path group by 1")
def _(t):
    return aggregate.by_language(t("p_node"), t("p_hash"))


@query("a10_unresolved_count", "select count(*) as n from p_edge where kind = 'imports' and target_id like 'module:%'")
def _(t):
    return scan.raw_imports(t("p_edge")).agg(F.count("*").alias("n"))


@query("t02_prefix_phrases", f"with tok as (select doc_id, i, w from (select doc_id, unnest(a) as w, unnest(range(1, len(a)+1)) as i from (select doc_id, list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as a from documents) y) z) select a.doc_id, count(*) as tf from tok a join tok b on b.doc_id = a.doc_id and b.i = a.i + 1 where a.w = 'of' and b.w like 'th%' group by a.doc_id")
def _(t):
    return text.phrase_hits(_docs_index(t).postings, ["of", "th"], "doc_id")


@query("t04_name_tokens", f"select k, concat(case when strpos(trim(replace({_SPLIT}, '_', ' ')), ' ') > 0 then concat(name, ' ', lower(trim(replace({_SPLIT}, '_', ' ')))) else name end, ' Outer ', case when strpos(trim(replace({_SPLIT}, '_', ' ')), ' ') > 0 then concat(name, ' ', lower(trim(replace({_SPLIT}, '_', ' ')))) else name end) as tokens from ({_NAMES}) x")
def _(t):
    name = F.expr("case k % 4 when 0 then name when 1 then replace(name, 'handle', 'HTTPHandle') when 2 then concat(lower(name), '_part_', cast(k as string)) else upper(name) end")
    return t("p_sym").select("k", N.name_tokens(name, F.concat(F.lit("Outer."), name)).alias("tokens"))


@query("u01_retained_union", f"select {_NODE} from p_node where file_path not in ({_PATHS}) union select {_NODE} from p_sym where file_path in ({_PATHS})")
def _(t):
    return mutate.retained(t("p_node").select(NODE), _paths(t), t("p_sym"))


@query("u02_difference", f"select distinct file_path from p_node where file_path not in ({_PATHS})")
def _(t):
    return mutate.vanished(t("p_node").select("file_path"), _paths(t)).distinct()


@query("f09_alias", _PROBED.split(", l as")[0] + " select okey, base from b")
def _(t):
    spec = F.expr(_IMPORT.split("file_path, ", 1)[1].split(" as specifier")[0])
    return t("p_import").select("okey", N.import_base(F.col("file_path"), spec).alias("base"))


@query("f13_anchor", "select k, concat('the-', lower(name), case when k % 2 = 0 then '-a--b' else '-x_y' end) as anchor from p_sym")
def _(t):
    title = F.concat(F.lit("  The "), F.col("name"), F.expr("case when k % 2 = 0 then '! a - b' else ' x_y?' end"))
    return t("p_sym").select("k", N.anchor(title).alias("anchor"))


@query("f23_specificity", "select distinct kind, case kind when 'variable' then 0 when 'function' then 2 else 3 end as rank from p_node")
def _(t):
    return t("p_node").select("kind", N.specificity(F.col("kind")).alias("rank")).distinct()


@query("search_page", f"select {_NODE} from p_node where name = 'Box1' or (name <> 'Box1' and starts_with(lower(name), 'box1')) order by case when name = 'Box1' then 0 else 1 end, file_path, start_line, id limit 20")
def _(t):
    found = text.search(t("p_node"), text.stored(text.index(t("p_node"), "id", ["name"])), "Box1")
    return found.orderBy("block", "file_path", "start_line", "id").limit(20).select(NODE)


@query("outline_page", f"select {_NODE} from p_node v where file_path = 'src/n1/automobile.ts' and (kind <> 'variable' or not exists (select 1 from p_sym s where s.file_path = v.file_path and s.start_line <= v.start_line and s.end_line >= v.end_line)) order by start_line, id limit 20 offset 2")
def _(t):
    rows = scan.nodes_where(t("p_node"), file_path="src/n1/automobile.ts")
    return scan.in_order(structure.top_level(rows, rows)).offset(2).limit(20).select(NODE)


@query(
    "path_query",
    _LEVELS + ", l as (select id, min(level) as level from b group by id), goal as (select max(id) as id from l where level = 3), f as (select t.id as target_id, t.level, min({'s': x.source_id, 'p': x.file_path, 'l': x.line}) as e from l t join l s on s.level = t.level - 1 join p_edge x on x.source_id = s.id and x.target_id = t.id and x.kind = 'calls' and coalesce(x.confidence, 'static') <> 'heuristic' group by t.id, t.level), g3 as (select * from f where target_id = (select id from goal)), g2 as (select * from f where target_id = (select e.s from g3)), g1 as (select * from f where target_id = (select e.s from g2)) select level, e.s as source_id, target_id, e.p as file_path, e.l as line from (select * from g1 union all select * from g2 union all select * from g3) z",
)
def _(t):
    steps = _path(t, _start(t)) or []
    rows = [(i, x["source_id"], x["target_id"], x["file_path"], x["line"]) for i, x in enumerate(steps, 1)]
    return t("p_edge").sparkSession.createDataFrame(rows, "level int, source_id string, target_id string, file_path string, line int")
