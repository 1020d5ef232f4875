"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

_WHERE = {
    "op1_site_quality": "quality_classifier",
    "op2_quality_rules": "quality_rules",
    "op3_private_data": "private",
    "op4_template_text": "html",
    "op5_pivotal_mix": "mixing",
    "op6_language_id": "language",
    "op10_minmax_groups": "minmax",
    "op7_byte_bpe": "bpe",
    "op8_recurrent_lm": "lm",
    "op9_closed_syncmers": "fingerprint",
}

_NEAR = """
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else w[i] || ' ' || w[i+1] || ' ' || w[i+2] end as sh from d, unnest(range(1, greatest(len(w) - 1, 2))) u(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
e as (select a.doc_id as a, b.doc_id as b from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  where 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) group by a.doc_id, b.doc_id having 100 * count(*) >= 85 * (max(x.n) + max(y.n) - count(*))),
r as (select doc_id, doc_id as c from documents union select r.doc_id, e.b from r join e on e.a = r.c)
select r.doc_id, coalesce(max(n.n), 0) as n_shingles, min(r.c) as component_id, min(r.c) = r.doc_id as kept from r left join n on n.doc_id = r.doc_id group by r.doc_id"""

#: The other queries have a model, a random draw or a tokenizer that SQL lacks; tests hold them against brute force.
ORACLES: dict[str, str] = {"op10_minmax_groups": _NEAR}


def _lazy(module: str, name: str):
    return lambda spark, sf_dir: getattr(import_module(f"factloom.llm.{module}"), name)(spark, sf_dir)


def queries() -> dict:
    return {name: _lazy(module, name) for name, module in _WHERE.items()}
