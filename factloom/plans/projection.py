"""Fact-shaped views of the test tables, one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_STR = "varchar(20)"
_COUNT = "(select count(*) from customer)"

VIEWS = {
    "p_sym": f"""
with b as (select c_custkey as k,
  concat('src/n', cast(c_nationkey as {_STR}), '/', lower(c_mktsegment), '.ts') as file_path,
  concat('handle', upper(substr(c_mktsegment,1,1)), lower(substr(c_mktsegment,2)), cast(case when c_custkey % 2 = 0 then c_custkey else c_custkey % 97 end as {_STR})) as name,
  case when c_custkey % 5 = 0 then 'method' else 'function' end as kind,
  c_custkey % 3 = 0 as exported, c_custkey % 11 = 0 as is_test from customer),
r as (select *, 10*row_number() over (partition by file_path order by k) - 9 as start_line from b)
select concat(kind, ':', file_path, ':', name, ':', cast(start_line as {_STR})) as id, kind, name, file_path,
  cast(start_line as int) as start_line, cast(start_line + 8 as int) as end_line, exported, is_test, k from r""",
    "p_var": f"""
select concat('variable:', s.file_path, ':', replace(p.p_name,' ','_'), ':', cast(case when p.p_partkey % 4 = 0 then 100000 + p.p_partkey else s.start_line + 2 end as {_STR})) as id,
 'variable' as kind, replace(p.p_name,' ','_') as name, s.file_path,
 cast(case when p.p_partkey % 4 = 0 then 100000 + p.p_partkey else s.start_line + 2 end as int) as start_line,
 cast(case when p.p_partkey % 4 = 0 then 100000 + p.p_partkey else s.start_line + 2 end as int) as end_line, false as exported, false as is_test, p.p_partkey as k
from part p join p_sym s on s.k = p.p_partkey % {_COUNT}""",
    "p_class": f"""
select concat('class:src/n', cast(s_nationkey as {_STR}), '/automobile.ts:Box', cast(s_suppkey as {_STR}), ':', cast(1 + 30 * (s_suppkey % 4) as {_STR})) as id,
 'class' as kind, concat('Box', cast(s_suppkey as {_STR})) as name, concat('src/n', cast(s_nationkey as {_STR}), '/automobile.ts') as file_path,
 cast(1 + 30 * (s_suppkey % 4) as int) as start_line, cast(90000 - 10 * s_suppkey as int) as end_line, s_suppkey % 2 = 0 as exported, false as is_test, s_suppkey as k from supplier""",
    "p_node": """
select id, kind, name, file_path, start_line, end_line, exported, is_test from p_sym
union all select id, kind, name, file_path, start_line, end_line, exported, is_test from p_class
union all select min(id), 'variable', name, file_path, start_line, end_line, false, false from p_var group by name, file_path, start_line, end_line""",
    "p_call": f"""
select s.id as source_id, t.name as target_name, t.k as target_k, s.file_path, cast(s.start_line + 1 + o.o_orderkey % 7 as int) as line,
 case when o.o_orderkey % 3 = 0 then 'member' end as call_form, o.o_orderkey % 50 = 1 as constructor, o.o_orderkey as okey
from orders o join p_sym s on s.k = o.o_custkey join p_sym t on t.k = (o.o_orderkey * 7919 + 13) % {_COUNT}
where o.o_orderkey % 4 < 2""",
    "p_edge": f"""
select c.source_id, t.id as target_id, 'calls' as kind, c.file_path, c.line, max(c.target_name) as target_name, case when min(c.okey) % 6 = 1 then 'heuristic' when min(c.okey) % 5 = 0 then 'static' end as confidence
from p_call c join p_sym t on t.k = c.target_k group by c.source_id, t.id, c.file_path, c.line
union all
select s.id, t.id, 'references', s.file_path, s.start_line, t.name, 'static' from p_sym s join p_sym t on t.k = (s.k * 31 + 7) % {_COUNT} where s.k % 4 = 1
union all
select concat('file:', s.file_path), concat('module:./', lower(s.name)), 'imports', s.file_path, s.start_line, cast(null as varchar(20)), cast(null as varchar(20)) from p_sym s where s.k % 7 = 2
union all
select concat('file:', s.file_path), t.id, 'imports', s.file_path, s.start_line, t.name, 'static' from p_sym s join p_sym t on t.k = (s.k * 17 + 3) % {_COUNT} where s.k % 9 = 4""",
    "p_hash": "select distinct file_path, sha256x(file_path) as content_hash, 'typescript' as language from p_sym where k % 13 <> 5",
    "p_import": f"""
select o.o_orderkey as okey, s.file_path,
 concat(case o.o_orderkey % 4 when 0 then './' when 1 then '../' when 2 then '@/' else 'pkg' end,
  case o.o_orderkey % 4 when 0 then substr(t.file_path, strpos_last(t.file_path) + 1, 1000) when 1 then substr(t.file_path, 5, 1000) when 2 then substr(t.file_path, 5, 1000) else 'x' end,
  case when o.o_orderkey % 11 = 0 then '.missing' else '' end) as raw
from orders o join p_sym s on s.k = o.o_custkey join p_sym t on t.k = (o.o_orderkey * 131 + 5) % {_COUNT} where o.o_orderkey % 10 < 4""",
    "p_lines": "<lines>",
    "p_md": f"""
select doc_id, i, line, case when i % 4 = 0 then 1 + cast(floor(i/4) as int) % 3 end as lvl, concat('docs/', cast(doc_id as {_STR}), '.md') as file_path from p_lines""",
}

_LINES = {
    "spark": "select doc_id, cast(pos+1 as int) as i, line from documents lateral view posexplode(split(text, '\\\\n')) x as pos, line",
    "duckdb": "select doc_id, cast(i as int) as i, a[i] as line from (select doc_id, string_split(text, chr(10)) as a from documents) z, unnest(range(1, len(a)+1)) u(i)",
}
_DIALECT = {
    "spark": {"sha256x(": "sha2x(", "strpos_last(t.file_path)": "(length(t.file_path) - locate('/', reverse(t.file_path)) + 1)"},
    "duckdb": {"sha256x(": "sha256(", "strpos_last(t.file_path)": "(length(t.file_path) - strpos(reverse(t.file_path), '/') + 1)"},
}
_TABLES = ["customer", "orders", "part", "supplier", "documents", "labels", "events", "lineitem", "nation", "region", "pages", "conversations", "benchmark"]


def _text(view: str, dialect: str) -> str:
    sql = _LINES[dialect] if view == "p_lines" else VIEWS[view]
    for a, b in _DIALECT[dialect].items():
        sql = sql.replace(a, b)
    return sql.replace("sha2x(file_path)", "sha2(file_path, 256)")


def _needed(sql: str) -> list[str]:
    """Views that the SQL reads, those they read before them."""
    out: list[str] = []
    for v in VIEWS:
        if v in sql and v not in out:
            out += [x for x in _needed(_text(v, "spark")) if x not in out] + [v]
    return out


def oracle(sql: str) -> str:
    """The SQL with the views that it reads, for DuckDB."""
    own = [v for v in _needed(sql)]
    if not own:
        return sql
    views = ", ".join(f"{v} as ({_text(v, 'duckdb')})" for v in own)
    body = sql.strip()
    recursive = body.lower().startswith("with recursive ")
    if body.lower().startswith("with "):
        return ("with recursive " if recursive else "with ") + views + ", " + body[len("with recursive ") if recursive else len("with ") :]
    return f"with {views} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection, or a table of the folder."""
    if name in _TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    own = [(v, _text(v, "spark")) for v in _needed(name)]
    if any(_COUNT in text for _, text in own):  # from the files' footers; as a literal it leaves the joins on keys
        n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
        own = [(v, text.replace(_COUNT, str(max(n, 1)))) for v, text in own]
    tables = [f"{t} as (select * from parquet.`{sf_dir}/{t}.parquet`)" for t in _TABLES if any(t in text for _, text in own)]
    return spark.sql("with " + ", ".join([*tables, *(f"{v} as ({text})" for v, text in own)]) + f" select * from {name}")
