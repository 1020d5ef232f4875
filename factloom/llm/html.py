"""Main-text extraction by equivalence-class template deduction.

A page is read as tokens: each tag and each text node, qualified by the path of elements around it. A
token's occurrence vector over the distinct pages of one host is summed into two linear fingerprints, so equal
vectors meet without any page list. Copies of a page have one vote together: each row weighs the inverse of
their number modulo PRIME, so the sums over all rows are exactly those over distinct pages.

Tokens of one host with equal vectors form an equivalence class, in the order of their mean places. It is valid
if it has two tokens or more and stands in two distinct pages or more, SUPPORT of the host's at least. A class
nests in the slot between two neighbours of another if all its tokens stand there. The nested classes are the
host's template. On a page, a class holds where its tokens come in its order, once or again and again, each time
in the slot that it nests in; elsewhere its tokens are content like any other. What stands between the tokens of
the classes that hold fills the slots of the template.

Marks (elements, roles, words of class or id) only choose among slots: those in navigation, headers, footers,
asides, adverts, notices, forms and comments go, and if the page has an article or main element, only slots in
it count. Text of the template itself counts as follows. In an article it belongs to the text, except before
the first heading where that heading is a slot, as there it is a label. Without an article it goes, unless it
outweighs what fills the slots: then the pages are copies of each other and all of it stays.

Cases: a null page counts as empty, and an empty page gives the empty text; a null or odd url belongs to the
host ''; a host with one distinct page has no template, so the page is one slot and its marks alone decide;
broken markup is read as far as it goes, in linear time; repeated rows and null ids are rows of their own; an
empty table gives an empty table; columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import re
from html import unescape
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import discard, materialize, table

SUPPORT = 0.3
#: Template tokens to broadcast at most; beyond, pages are joined with templates by a shuffle.
BROADCAST_TOKENS = 200_000
#: Above any count or sum of places of a host; sums of residues of 2**18 tasks stay below 2**63.
PRIME = 2**45 - 55
_FLUSH = 150_000

# Fixed values of HTML: elements without content, with raw content, and that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe".split())
BLOCK = frozenset("address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Marks of page furniture: elements, roles, and words of a class or id.
FURNITURE = frozenset("nav footer aside form button select dialog menu".split())
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu menubar".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus reply replies respond share sharing social related recommended footer widget pagination pager toolbar masthead".split())
OUTER = frozenset("header topbar".split())
# What an opening tag closes, up to the nearest of the second set.
CLOSES = {"p": ({"p"}, {"article", "section", "div", "body", "main", "td", "li", "blockquote", "footer", "aside"}), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSES |= {t: CLOSES["p"] for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}

_name = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)").match
_attributes = re.compile(r"""(?:[^>"']|"[^"]*+"|'[^']*+')*+>""").match
_mark = re.compile(r"""(?:\A|[\s"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I).findall
_words = re.compile(r"[a-z]+").findall
_space = re.compile(r"\s+").sub


class _Level:
    __slots__ = ("name", "path", "drop", "main")

    def __init__(self, name, path, drop, main):
        self.name, self.path, self.drop, self.main = name, path, drop, main


def _furniture(name: str, attributes: str, main: bool) -> tuple[bool, str]:
    """Whether the element is furniture, and its class and id for the path."""
    if not attributes:
        return name in FURNITURE or name == "header" and not main, ""
    drop, label = name in FURNITURE or name == "header" and not main, []
    for key, *value in _mark(attributes):
        key, value = key.lower(), "".join(value).lower()
        if key in ("class", "id"):
            found = set(_words(value))
            drop = drop or name not in ("body", "html", "article", "main") and bool(found & MARKS or not main and found & OUTER)
            label.append(value)
        elif key == "role":
            drop = drop or value in ROLES
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            drop = drop or name not in ("body", "html")
    return drop, " ".join(label)


class _Stack:
    """The open elements, and where each name is open."""

    def __init__(self):
        self.levels, self.at = [_Level("", 0, False, False)], {}

    def push(self, level: _Level) -> None:
        self.at.setdefault(level.name, []).append(len(self.levels))
        self.levels.append(level)

    def last(self, names) -> int:
        """The innermost open element of these names; 0 if there is none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def close(self, k: int) -> None:
        while len(self.levels) > k:
            self.at[self.levels.pop().name].pop()


def read(html: str):
    """The page's tokens in order: (path hash, tag or None, text, drop, main).

    Every step takes what it has looked at: a tag that never ends is text to the end of the page, and after a
    quote that never ends quotes mean nothing.
    """
    stack, at, size, from_, quotes = _Stack(), 0, len(html), 0, True

    def text(end):
        top = stack.levels[-1]
        return (top.path, None, html[from_:end], top.drop, top.main)

    while (at := html.find("<", at)) >= 0:
        m = _name(html, at + 1)
        if m is None and html[at + 1 : at + 2] not in ("!", "?"):
            at += 1
            continue
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4) + 3
            end = size if end == 2 else end
        elif html.startswith("<![CDATA[", at):
            end = html.find("]]>", at + 9) + 3
            end = size if end == 2 else end
        else:
            whole = _attributes(html, m.end()) if m and quotes else None
            quotes = quotes and (m is None or whole is not None)
            end = whole.end() if whole else html.find(">", at) + 1
            if not end:
                break  # no tag ends after this
        if at > from_:
            yield text(at)
        from_ = at = end
        if m is None:
            continue
        name, attributes = m[2].lower(), html[m.end() : end - 1]
        if m[1]:
            if k := stack.last((name,)):
                stack.close(k)
            top = stack.levels[-1]
            yield top.path, "/" + name, "", top.drop, top.main
            continue
        if closing := CLOSES.get(name):
            if (k := stack.last(closing[0])) > stack.last(closing[1]):
                stack.close(k)
        top = stack.levels[-1]
        drop, label = _furniture(name, attributes, top.main)
        path = xxhash.xxh64_intdigest(f"{name} {label}", top.path)
        level = _Level(name, path, top.drop or drop, top.main or name in ("article", "main"))
        yield path, name, label, level.drop, level.main
        if name in RAW:
            last = re.compile(f"</{name}", re.I).search(html, at)
            if last is None:
                return
            from_ = at = html.find(">", last.end()) + 1 or size
        elif name not in VOID and not attributes.endswith("/"):
            stack.push(level)
    if from_ < size:
        yield text(size)


def node_key(path: int, tag: str | None, text: str) -> int:
    return xxhash.xxh64_intdigest(tag if tag is not None else "\0" + text, path) >> 1


def tidy(text: str) -> str:
    return _space(" ", unescape(text)).strip()


def _host():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def weighted(pages: DataFrame) -> DataFrame:
    """`host`, `html` and `copies`, the number of the host's rows with the same page."""
    keyed = pages.select("host", "html", F.xxhash64("html").alias("digest"))
    repeated = materialize(keyed.groupBy("host", "digest").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    few = repeated.count() <= BROADCAST_TOKENS
    return keyed.join(F.broadcast(repeated) if few else repeated, ["host", "digest"], "left").select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))


def occurrences(pages: DataFrame) -> DataFrame:
    """For each host and token over distinct pages: fingerprints f1, f2 of its occurrence vector, pages, times, places, whether text."""

    def run(batches):
        sums: dict[tuple[str, int], list] = {}

        def rows():
            keys, values = list(sums), [[*(x % PRIME for x in v[:5]), v[5]] for v in sums.values()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *[pa.array([v[i] for v in values], pa.int64()) for i in range(6)]], ["host", "token", "f1", "f2", "pages", "times", "places", "is_text"])

        for batch in batches:
            for host, html, copies in zip(*(c.to_pylist() for c in batch.columns)):
                weight = pow(copies, -1, PRIME)
                page: dict[int, list] = {-1: [1, 0, 0]}
                for k, (path, tag, text, _, _) in enumerate(read(html or "")):
                    if tag is None and not (text := tidy(text)):
                        continue
                    seen = page.setdefault(node_key(path, tag, text), [0, 0, int(tag is None)])
                    seen[0] += 1
                    seen[1] += k
                digest = xxhash.xxh64_intdigest(html or "")
                h1, h2 = digest >> 34, digest & (2**30 - 1)
                for token, (times, places, is_text) in page.items():
                    s = sums.setdefault((host, token), [0, 0, 0, 0, 0, is_text])
                    s[0] += h1 * times * weight
                    s[1] += h2 * times * weight
                    s[2] += weight
                    s[3] += times * weight
                    s[4] += places * weight
                if len(sums) > _FLUSH:
                    yield rows()
        yield rows()

    found = weighted(pages).mapInArrow(run, "host string, token long, f1 long, f2 long, pages long, times long, places long, is_text long")
    return found.groupBy("host", "token").agg(*[(F.sum(c) % PRIME).alias(c) for c in ("f1", "f2", "pages", "times", "places")], F.max("is_text").alias("is_text"))


def laid_out(tokens: list[tuple]) -> list[tuple]:
    """(token, class, rank, size, depth, outer class or -1, slot, flag) of a host's valid tokens (token, class key, mean place, flag)."""
    by: dict = {}
    for token, key, place, flag in tokens:
        by.setdefault(key, []).append((place, token, flag))
    classes = sorted((sorted(v) for v in by.values()), key=lambda c: (c[0][0] - c[-1][0], c[0][1]))  # widest first
    out, spans = [], []
    for k, members in enumerate(classes):
        low, high = members[0][0], members[-1][0]
        depth, outer, slot = 0, -1, 0
        for j, (places, d) in enumerate(spans):
            i = int(np.searchsorted(places, low))
            if 0 < i < len(places) and high <= places[i] and d + 1 > depth:  # inside one slot of that class
                depth, outer, slot = d + 1, j, i - 1
        spans.append((np.array([m[0] for m in members]), depth))
        out += [(token, k, rank, len(members), depth, outer, slot, flag) for rank, (_, token, flag) in enumerate(members)]
    return out


def nested(tokens: list[tuple]) -> list[tuple[int, int, int, bool]]:
    """(token, class, depth, flag) of a host's valid tokens."""
    return [(token, k, depth, flag) for token, k, _, _, depth, _, _, flag in laid_out(tokens)]


def templates(pages: DataFrame) -> DataFrame:
    """`host`, `tokens` (their number) and `template`, the packed layout, for hosts with two distinct pages or more."""
    seen = materialize(occurrences(pages), "occurrences")
    hosts = seen.where("token = -1 and pages > 1").select("host", F.col("pages").alias("all_pages"))
    often = seen.where("token <> -1 and pages > 1").join(hosts, "host").where(F.col("pages") >= F.col("all_pages") * SUPPORT)
    often = materialize(often, "often")
    key = ["host", "f1", "f2", "pages", "times"]
    valid = often.join(often.groupBy(*key).count().where("count > 1").drop("count"), key)
    listed = valid.groupBy("host").agg(F.collect_list(F.struct("token", F.struct("f1", "f2", "pages", "times").alias("key"), (F.col("places") / F.col("times")).alias("place"), F.col("is_text"))).alias("tokens"))

    def run(batches):
        for batch in batches:
            made = [laid_out([(t["token"], tuple(t["key"].values()), t["place"], t["is_text"]) for t in tokens]) for tokens in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, made)), pa.int64()), pa.array([np.array(x, np.int64).tobytes() for x in made], pa.binary())], ["host", "tokens", "template"])

    out = materialize(listed.mapInArrow(run, "host string, tokens long, template binary"), "templates")
    discard(seen, often)
    return out


def unpacked(template: bytes | None) -> dict[int, tuple]:
    """token to (class, rank, size, outer class, slot)."""
    rows = np.frombuffer(template or b"", np.int64).reshape(-1, 8).tolist()
    return {t: (k, rank, size, outer, slot) for t, k, rank, size, _, outer, slot, _ in rows}


def holding(keys: list[int], template: dict[int, tuple]) -> set[int]:
    """The classes that hold on a page whose tokens have these keys."""
    last: dict[int, int] = {}
    broken = set()
    for key in keys:
        if place := template.get(key):
            k, rank, size, outer, slot = place
            if rank != (last.get(k, -1) + 1) % size or outer >= 0 and outer not in broken and last.get(outer) != slot:
                broken.add(k)
            last[k] = rank
    whole = {k: rank + 1 for k, rank in last.items()}
    return {k for k, rank, size, _, _ in template.values() if rank == 0 and k not in broken and whole.get(k) == size}


def main_text(html: str, template) -> str:
    """The text of the page's main slots, a line for each block. template: token to (class, rank, size, outer class, slot)."""
    template = template or {}
    page = [(tag, text, drop, main, node_key(path, tag, text if tag is not None else tidy(text))) for path, tag, text, drop, main in read(html)]
    holds = holding([key for *_, key in page], template) if template else ()
    regions: tuple[list, list] = ([], [])  # of the article and of the rest: (block, text, from the template, heading)
    block, heading, open_heading = 0, 0, False
    for tag, text, drop, main, key in page:
        if tag is not None:
            if tag.removeprefix("/") in BLOCK:
                block += 1
            if tag.removeprefix("/") in HEADINGS:
                open_heading = tag in HEADINGS
                heading += open_heading
        elif not drop:
            regions[0 if main else 1].append((block, text, key in template and template[key][0] in holds, heading if open_heading else 0))
    inside, outside = regions
    if any(t.strip() for _, t, _, _ in inside):
        first = next((h for *_, h in inside if h), 0)
        titled = first and any(h == first and not fixed and t.strip() for _, t, fixed, h in inside)
        at = next(i for i, (*_, h) in enumerate(inside) if h == first) if titled else 0
        chosen = [(b, t) for i, (b, t, fixed, _) in enumerate(inside) if i >= at or not fixed]
    else:
        of_template, of_slots = (sum(len(t.strip()) for _, t, fixed, _ in outside if fixed is kind) for kind in (True, False))
        chosen = [(b, t) for b, t, fixed, _ in outside if not fixed or of_template > of_slots]
    lines = (tidy("".join(t for _, t in part)) for _, part in groupby(chosen, key=lambda x: x[0]))
    return "\n".join(filter(None, lines))


def extracted(pages: DataFrame) -> DataFrame:
    """`page_id`, `url` and `text` of every row."""
    rows = pages.select("page_id", "url", "html", _host().alias("host"))
    made = templates(rows.select("host", "html"))
    few = (made.agg(F.sum("tokens")).first()[0] or 0) <= BROADCAST_TOKENS
    if few:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: bytes(r["template"]) for r in made.collect()})
        joined = rows.select("page_id", "url", "html", "host")
    else:
        joined = rows.join(made.select("host", "template"), "host", "left").select("page_id", "url", "html", "template")
    schema = joined.select("page_id", "url", F.lit("").alias("text")).schema

    def run(batches):
        held: dict = {}
        for batch in batches:
            texts = []
            for page, key in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if key not in held:
                    if len(held) > 100:
                        held.clear()
                    held[key] = unpacked(sent.value.get(key) if few else key)
                texts.append(main_text(page, held[key]) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, schema)


def op4_template_text(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
