"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find.

Base spans come from four fixed patterns. They are the first seeds: the last word before a seed (its cue), alone
or with the seed's shape, makes a lexical pattern. Tokens of an identifier's shape that no base span covers, and
runs of neighbouring tokens that have it together, are the candidates. Patterns and instances form a graph that
Spark scores ROUNDS times: a pattern's confidence is the sum of its instances' scores over its cue's occurrences
anywhere in the corpus (so a cue that ordinary words follow is worth little), and an instance's score is one minus
the product of its cues' doubts, seeds staying at 1. A pattern with CONFIDENT or more and SEEDS different seeds is
good; instances under a good one become seeds of the next round, whatever their shape, and so make patterns that
no base span could. Candidates under a good pattern are found, as spans of kind `found` after the base ones.
A cue before fewer than SEEDS different instances can't make a good pattern and is left out of the graph; the
others are counted in a second pass.

Cases: a null text counts as empty and has no spans; an empty text likewise; very long runs of one character
class are matched in linear time; repeated rows and null ids are rows of their own; an empty table gives an
empty table; columns besides id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from hashlib import blake2b

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import byte_words, discard, materialize, sliced, table, tidy

ROUNDS = 3
CONFIDENT = 0.5
SEEDS = 3
#: The shape in a pattern of a cue alone.
ANY = "*"
PRIOR = 1.0
#: Spans to broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Cues to broadcast at most; beyond, every word is counted and the counts meet the cues in a join.
BROADCAST_CUES = 1_000_000
#: Words that a task counts, and rows that it gathers, before it sends them on.
_FLUSH, _ROWS = 100_000, 10_000

_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+").match
_local_end = re.compile(r"[A-Za-z0-9._%+-]+\Z").search
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_digits = re.compile(r"[0-9]").findall
_token = re.compile(r"[^\x20\x09-\x0D]+").finditer
_inner = re.compile(r"[0-9A-Za-z+][^\x20\x09-\x0D]*[0-9A-Za-z]").search
_inner_run = re.compile(r"[0-9A-Za-z].*[0-9A-Za-z]").search
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> list[tuple[int, int]]:
    """Looks left and right of each @, which matches what the pattern finds from left to right."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _domain(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        else:
            last = at
        at = text.find("@", max(last, at + 1))
    return out


def luhn(digits: list[str]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in _ip(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split("."))]
    for m in _card(text):
        if 16 <= len(m[0]) and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _phone(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def as_text(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def shape(value: str) -> str | None:
    """Coarse shape of an identifier; None for anything that is not like one."""
    digits = sum("0" <= c <= "9" for c in value)
    if "@" in value:
        return "at" if len(value) > 4 else None
    if digits >= 6 and not any(c.isalpha() for c in value):
        return "number"
    return "mixed" if digits >= 3 and len(value) >= 8 and sum(c.isalpha() for c in value) >= 1 else None


_ZERO = {ord(c): "0" for c in "123456789"}


def cue_of(word: str) -> str:
    """A word as a cue: lower case, digits alike, outer punctuation off; empty if nothing is left."""
    w = word.lower().translate(_ZERO)
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while b > a and not w[b - 1].isalnum():
        b -= 1
    return w[a:b]


def cues_before(text: str, starts: list[tuple[int, int]]) -> list[str]:
    """For each (start, end) in order, the nearest of the three words before it that is a cue, else ''.

    Words end at white space and at the ends of earlier spans, so all walks together stay linear.
    """
    places = [m.span() for m in _token(text)] if starts else []
    begins, known, out, last = [a for a, _ in places], {}, [], 0

    def whole(k: int) -> str:
        if k not in known:
            known[k] = bounded_cue(text[slice(*places[k])])
        return known[k]

    for start, end in starts:
        k = bisect_right(begins, start) - 1
        own = text[max(last, begins[k]) : start] if k >= 0 else ""
        near = [bounded_cue(own)] if own else []
        near += (whole(j) for j in range(k - 1, max(-1, k - 4 + len(near)), -1))
        out.append(next(filter(None, near), ""))
        last = max(last, end)
    return out


def bounded_cue(word: str) -> str:
    """The cue of a word; a very long one by its digest."""
    c = cue_of(word)
    return c if len(c) <= 64 else blake2b(c.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def key_of(value: str) -> str:
    """An instance as a key: without white space, and long runs by their digest."""
    v = "".join(value.split())
    return v if len(v) <= 64 else blake2b(v.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


_has_id = re.compile(r"[0-9][^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*[0-9]|@").search
_group = r"\(?(?=[A-Za-z]*+[0-9])[0-9A-Za-z]++(?:[-/.][0-9A-Za-z]++)*+\)?(?=[\x20\x09-\x0D,;.:!?]|\Z)"
#: Groups with digits, one blank apart; groups of capitals only between them.
_runs = re.compile(rf"(?<![^\x20\x09-\x0D]){_group}(?:[\x20\x09](?:[A-Z]++[\x20\x09])?{_group})++").finditer


def candidates(text: str, taken: list[tuple[str, int, int]]):
    """(start, end, shape) of identifier-like tokens, and of runs of tokens, that no base span touches."""
    busy = sorted((a, b) for _, a, b in taken)

    def free():
        k = 0

        def test(a, b):
            nonlocal k
            while k < len(busy) and busy[k][1] <= a:
                k += 1
            return not any(x < b and y > a for x, y in busy[k : k + 8])

        return test

    if _has_id(text):
        clear = free()
        for m in _token(text):
            if (value := _inner(m[0])) and (kind := shape(value[0])):
                a, b = m.start() + value.start(), m.start() + value.end()
                if clear(a, b):
                    yield a, b, kind
    clear = free()
    for m in _runs(text):
        value = _inner_run(m[0])
        if (kind := shape(value[0])) and not all(map(shape, value[0].split())):  # else each token is one by itself
            a, b = m.start() + value.start(), m.start() + value.end()
            if clear(a, b):
                yield a, b, kind


_ROW = "tag string, row long, doc_id long, base string, cue string, shape string, value string, s long, e long, digest long"


def _digest(text):
    return F.xxhash64(text)


def _scan(docs: DataFrame) -> DataFrame:
    """One pass: a `doc` row for each document, with its text's digest, `seed` and `new` rows for instances."""

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in sliced(batches):
            out: list[tuple] = []
            for doc_id, text, digest in zip(*(c.to_pylist() for c in batch.columns)):
                text, row = text or "", row + 1
                spans = base_spans(text)
                out.append(("doc", row, doc_id, as_text(spans), None, None, None, None, None, digest))
                new = list(candidates(text, spans))
                every = sorted([("seed", a, b, shape(text[a:b]) or "number") for _, a, b in spans] + [("new", a, b, kind) for a, b, kind in new], key=lambda x: x[1:3])
                for (tag, a, b, kind), cue in zip(every, cues_before(text, [x[1:3] for x in every])):
                    out.append((tag, row, doc_id, None, cue, kind, key_of(text[a:b]), a, b, None))
                if len(out) >= _ROWS:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    return docs.select(F.col("doc_id").cast("long"), "text", _digest("text")).mapInArrow(tidy(run), _ROW)


_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_KINDS = [pa.string() if x.endswith("string") else pa.int64() for x in _ROW.split(", ")]


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(_KINDS)], _NAMES)


def cue_counts(docs: DataFrame, cues: DataFrame) -> DataFrame:
    """`cue` and `seen`, how often each of the stored cues (cue) stands anywhere in the texts."""
    few = cues.count() <= BROADCAST_CUES
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(r["cue"] for r in cues.collect()) if few else None)

    def run(batches):
        wanted, words = sent.value, Counter()

        def sums() -> pa.RecordBatch:
            out: Counter = Counter()
            while words:
                w, n = words.popitem()
                c = bounded_cue(w.decode())
                if c and (wanted is None or c in wanted):
                    out[c] += n
            return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], ["cue", "n"])

        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                words.update(byte_words(text))
                if len(words) > _FLUSH:
                    yield sums()
        yield sums()

    counts = docs.select("text").mapInArrow(tidy(run), "cue string, n long")
    if not few:
        counts = counts.join(cues, "cue", "left_semi")
    return counts.groupBy("cue").agg(F.sum("n").alias("seen"))


def _good():
    return (F.col("confidence") >= CONFIDENT) & (F.col("seeds") >= SEEDS)


def _of_pattern(left, right):
    return (left["cue"] == right["cue"]) & ((right["shape"] == left["shape"]) | (right["shape"] == ANY))


def scored_patterns(docs: DataFrame, scan: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """`cue`, `shape` (ANY for the cue alone), `confidence`, `seeds` of the patterns that some seed induced."""
    edges = scan.where("tag in ('seed', 'new') and cue <> ''").groupBy("cue", "shape", "value").agg(F.max((F.col("tag") == "seed").cast("int")).alias("seed"), F.count("*").alias("times"))
    all_edges = materialize(edges, "all-edges")
    cues = materialize(all_edges.groupBy("cue", "value").agg(F.lit(1)).groupBy("cue").agg(F.count("*").alias("values")).where(F.col("values") >= SEEDS).select("cue"), "cues")
    edges = materialize(all_edges.join(cues, "cue", "left_semi"), "edges")
    seen = materialize(cue_counts(docs, cues), "seen")
    discard(all_edges, cues)
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for k in range(rounds):
        patterns = scored.withColumn("shape", F.explode(F.array("shape", F.lit(ANY)))).groupBy("cue", "shape").agg(F.sum(F.col("score") * F.col("times")).alias("mass"), F.sum("seed").alias("seeds")).where("seeds > 0")
        share = F.col("mass") / (F.greatest(F.coalesce("seen", F.lit(0)), "mass") + PRIOR)
        confidence = materialize(patterns.join(seen, "cue", "left").select("cue", "shape", "seeds", F.least(F.lit(1.0), share).alias("confidence")), f"confidence-{k}")
        if k + 1 < rounds:
            held = confidence.select("cue", "shape", "confidence", _good().alias("good"))
            by_cue = edges.join(held, _of_pattern(edges, held)).groupBy("value", edges["cue"]).agg(F.max("confidence").alias("confidence"), F.max("good").alias("good"))
            new = by_cue.groupBy("value").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("new"), F.max("good").alias("good"))
            seed = F.when((F.col("seed") == 1) | F.coalesce("good", F.lit(False)), 1).otherwise(0)
            score = F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("new", F.lit(0.0)))
            if k:
                discard(scored)
            scored = materialize(edges.join(new, "value", "left").withColumn("seed", seed).withColumn("score", score).drop("new", "good"), f"scored-{k}")
    return confidence.select("cue", "shape", "confidence", "seeds")


def extract(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(`row`, `doc_id`, `base`, `digest`) of every row and (`row`, `doc_id`, `s`, `e`) of what the patterns found."""
    scan = materialize(_scan(docs), "scan")
    good = scored_patterns(docs, scan).where(_good()).select("cue", "shape")
    new = scan.where("tag = 'new'")
    found = materialize(new.join(good, _of_pattern(new, good), "left_semi").select("row", "doc_id", "s", "e"), "found")
    return scan.where("tag = 'doc'").select("row", "doc_id", "base", "digest"), found


def spans_of(docs: DataFrame) -> DataFrame:
    """`doc_id`, `base` and `spans` (texts of kind:start:end) and `n_found` of every row."""
    base, found = extract(docs)
    each = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("more"))
    text = F.transform("more", lambda x: F.concat_ws(":", F.lit("found"), x["s"], x["e"]))
    joined = base.join(each, "row", "left")
    return joined.select("doc_id", "base", F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), text).alias("spans"), F.greatest(F.size(F.coalesce("more", F.array().cast("array<struct<s:bigint,e:bigint>>"))), F.lit(0)).cast("long").alias("n_found"))


def op3_private_data(spark, sf_dir: str) -> DataFrame:
    rows = spans_of(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter(F.split("base", ","), lambda x: x.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", count("email"), count("ip"), count("card"), count("phone"), F.sha2("base", 256).alias("base_sha256"), "spans", "n_found")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch that spans cover replaced by its first span's kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def masked_batches(batches, at: int, names: list[str]):
    """A task's rows with the column at masked; the spans found are the column after those named."""

    def safe(text, found):
        more = [("found", x["s"], x["e"]) for x in found or () if text and x["e"] <= len(text)]
        spans = [*base_spans(text), *more] if text else []
        return mask(text, spans) if spans else text

    for batch in sliced(batches):
        columns = [batch.column(i) for i in range(len(names))]
        columns[at] = pa.array(map(safe, batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()), pa.string())
        yield pa.RecordBatch.from_arrays(columns, names)


def masked(docs: DataFrame) -> DataFrame:
    """docs with every base and found span of `text` masked, and `n_chars`, if there is one, to match.

    Spans follow from the text, so they meet their rows by id (a null one, too) and the text's digest.
    """
    base, found = extract(docs)
    of_text = found.join(base.select("row", F.col("digest").alias("_digest")), "row")
    each = materialize(of_text.groupBy(F.col("doc_id").alias("_id"), "_digest").agg(F.collect_set(F.struct("s", "e")).alias("_found")), "found-of")
    few = each.count() <= BROADCAST_ROWS
    same = docs["doc_id"].eqNullSafe(each["_id"]) & (_digest(docs["text"]) == each["_digest"])
    joined = docs.join(F.broadcast(each) if few else each, same, "left").select(*[docs[c] for c in docs.columns], "_found")
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        yield from masked_batches(batches, at, schema.names)

    out = joined.mapInArrow(tidy(run), schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else out
