import hashlib
import random
import re

from factloom.llm import private

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum((x * 2 - 9 * (x > 4)) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_against_the_patterns():
    r = random.Random(0)
    bits = ["a@b.c", "@", ".", "a", "-", "+", "1", "255", "256", "0", " ", "(", ")", "é", "x@y", "a.b%", "4111111111111111", "4111 1111-1111 1111", "+1 (499) 555-6503", "10.0.0.1"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        assert private.base_spans(text) == brute(text), text


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "." * 300_000 + "@a"):
        private.base_spans(text)


def test_mask():
    assert private.mask("x a@b.c y", [("email", 2, 7)]) == "x <email> y"
    assert private.mask("0123456789", [("ip", 2, 6), ("card", 4, 8)]) == "01<ip>89"


def test_query_and_bootstrap(spark, tmp_path):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "4222222222222220004"]
    rows = [(i, f"pay with acct: {c} now") for i, c in enumerate(cards)]
    rows += [(10, "pay with acct: 99887766554 now"), (11, "there were 99887766554 of them"), (12, None), (13, ""), (None, "me@x.org"), (0, rows[0][1]), (14, "é a@b.co 1.2.3.4")]
    rows += [(100 + i, "there were some") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) as n_chars", "1 as row", "'q' as cue")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = private.op3_private_data(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    have = sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got), key=str)
    want = []
    for i, t in rows:
        s = brute(t or "")
        n = lambda k: sum(x[0] == k for x in s)
        want.append((i, n("email"), n("ip"), n("card"), n("phone"), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()))
    assert have == sorted(want, key=str)
    found = {r["doc_id"]: r["spans"] for r in got if r["n_found"]}
    assert found == {10: "found:15:26"}
    clean = {r["doc_id"]: r for r in private.masked(docs).collect()}
    assert clean[10]["text"] == "pay with acct: <found> now" and clean[14]["text"] == "é <email> <ip>" and clean[11]["text"] == rows[5][1]
    assert clean[12]["text"] is None and clean[10]["n_chars"] == len(clean[10]["text"])
    assert private.masked(docs).columns == docs.columns
    assert private.spans_of(docs.limit(0)).count() == 0


def test_found_spans_are_masked_without_an_id(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881"]
    rows = [(i, f"pay with acct: {c} now") for i, c in enumerate(cards)]
    rows += [(None, "pay with acct: 99887766554 now"), (None, "an innocent text, long enough"), (None, None), (7, "acct: 88776655443"), (7, "a text of the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["text"] for r in private.masked(docs).collect() if r["doc_id"] in (None, 7)), key=str)
    assert got == sorted(["pay with acct: <found> now", "an innocent text, long enough", None, "acct: <found>", "a text of the same id"], key=str)


def test_runs_of_tokens_are_candidates():
    found = lambda t: [t[a:b] for a, b, _ in private.candidates(t, private.base_spans(t))]
    assert found("call 555 867 5309, now") == ["555 867 5309"]
    assert found("IBAN DE89 3704 0044 0532 0130 00.") == ["DE89 3704 0044 0532 0130 00"]
    assert found("GB29 NWBK 6016 1331 9268 19 IBAN") == ["GB29 NWBK 6016 1331 9268 19"]
    assert found("(555) 867 5309") == ["555) 867 5309"] and found("in 5 of 12 cases") == []
    assert found("99887766554 88776655443") == ["99887766554", "88776655443"]
    for text in ("1 " * 200_000, "A1 " * 100_000 + "é", "A" * 300_000, "1." * 100_000, "1 A " * 100_000):
        list(private.candidates(text, []))


def test_bootstrap_reaches_other_shapes_and_cues(spark):
    hosts = [f"via host 10.0.0.{i} ok" for i in range(1, 5)] + ["via host 10002000 ok"]
    cards = [f"pay with acct: {c} now" for c in ("4111111111111111", "5500005555555559", "4012888888881881")]
    ibans = ["DE89370400440532013000", "GB29NWBK60161331926819", "FR1420041010050500013M02606"]
    texts = [*hosts, *cards, *(f"pay with acct: {i} now" for i in ibans), *(f"their iban: {i} now" for i in ibans), "their iban: NL91ABNA0417164300 now", "pay with acct: 555 867 5309 now", "nothing like NL91ABNA0417164301 now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in private.masked(docs).collect()}
    assert got[4] == "via host <found> ok"
    assert [got[i] for i in (8, 9, 10, 15)] == ["pay with acct: <found> now"] * 4
    assert [got[i] for i in (11, 12, 13, 14)] == ["their iban: <found> now"] * 4
    assert got[16] == texts[16]


def test_cues_have_no_window():
    cue = lambda t, *spans: private.cues_before(t, list(spans))
    assert cue("acct: 123", (6, 9)) == ["acct"] and cue("123", (0, 3)) == [""] and cue("", ) == []
    far = "Acct:" + " " * 5000 + "123"
    assert cue(far, (5005, 5008)) == ["acct"]
    assert cue("a -- .. 123", (8, 11)) == ["a"] and cue("a -- .. !! 123", (11, 14)) == [""]
    assert cue("acct:123,456", (5, 8), (9, 12)) == ["acct", ""]
    one, two = cue("x" * 500 + " 1234567 " + "y" + "x" * 499 + " 1234568", (501, 508), (1010, 1017))
    assert one != two and len(one) == len(two) == 32
    for text in ("1.2.3.4," * 50_000, "a" * 400_000 + " 1.2.3.4" * 20_000, "\n" * 400_000 + "1.2.3.4"):
        spans = [(a, b) for _, a, b in private.base_spans(text)]
        assert len(private.cues_before(text, spans)) == len(spans)


def plain_scores(texts, rounds):
    """The pattern scores by dictionaries, from the definition."""
    edges, seen = {}, {}
    for t in texts:
        spans = private.base_spans(t)
        every = sorted([(a, b, private.shape(t[a:b]) or "number", 1) for _, a, b in spans] + [(a, b, k, 0) for a, b, k in private.candidates(t, spans)])
        for (a, b, kind, seed), c in zip(every, private.cues_before(t, [x[:2] for x in every])):
            if c:
                old = edges.get((c, kind, private.key_of(t[a:b])), [0, 0])
                edges[c, kind, private.key_of(t[a:b])] = [max(old[0], seed), old[1] + 1]
        for w in re.findall(r"[^\x20\x09-\x0D]+", t):
            seen[private.bounded_cue(w)] = seen.get(private.bounded_cue(w), 0) + 1
    values = {}
    for c, _, v in edges:
        values.setdefault(c, set()).add(v)
    edges = {e: v for e, v in edges.items() if len(values[e[0]]) >= private.SEEDS}
    seeds = {e: v[0] for e, v in edges.items()}
    score = {e: float(v[0]) for e, v in edges.items()}
    for k in range(rounds):
        mass, held = {}, {}
        for (c, kind, v), (_, times) in edges.items():
            for p in ((c, kind), (c, private.ANY)):
                mass[p] = mass.get(p, 0) + score[c, kind, v] * times
                held[p] = held.get(p, 0) + seeds[c, kind, v]
        conf = {p: min(1, m / (max(seen.get(p[0], 0), m) + private.PRIOR)) for p, m in mass.items() if held[p]}
        good = {p for p in conf if conf[p] >= private.CONFIDENT and held[p] >= private.SEEDS}
        if k + 1 < rounds:
            by = {}
            for c, kind, v in edges:
                for p in ((c, kind), (c, private.ANY)):
                    if p in conf:
                        d = by.setdefault(v, {})
                        d[c] = max(d.get(c, 0), conf[p])
                        d[None] = d.get(None, False) or p in good
            for e in edges:
                d = by.get(e[2], {})
                seeds[e] = 1 if seeds[e] or d.get(None) else 0
                doubt = 1.0
                for c, x in d.items():
                    doubt *= max(1 - x, 1e-6) if c is not None else 1
                score[e] = 1.0 if seeds[e] else (1 - doubt if d else 0.0)
    return {(c, kind): (conf[c, kind], held[c, kind]) for c, kind in conf}


def test_pattern_scores_against_plain_ones(spark, monkeypatch):
    r = random.Random(3)
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "6011000990139424", "a@b.co", "c@d.org", "10.0.0.7"]
    other = [f"AB{r.randrange(10**6):06d}X" for _ in range(8)] + [str(r.randrange(10**8, 10**9)) for _ in range(8)]
    cues = ["acct:", "Card", "iban", "ref", "the", "mail"]
    texts = [" ".join(r.choice([r.choice(cues), f"{r.choice(cues)} {r.choice(cards + other)}", "the"]) for _ in range(r.randint(0, 12))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scan = private.materialize(private._scan(docs), "test")
    for rounds, most in ((1, 10), (3, 10), (3, 0)):
        monkeypatch.setattr(private, "BROADCAST_CUES", most)
        got = {(x["cue"], x["shape"]): (x["confidence"], x["seeds"]) for x in private.scored_patterns(docs, scan, rounds).collect()}
        want = plain_scores(texts, rounds)
        assert set(got) == set(want) and len(got) > 5
        assert all(abs(got[p][0] - want[p][0]) < 1e-9 and got[p][1] == want[p][1] for p in got)
