import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.operators import page
from factloom.sources import extract


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def python_words(name: str) -> list[str]:
    """words_of for one string."""
    out, word = [], ""
    for i, c in enumerate(name):
        if c in "_-.":
            out, word = out + [word] * bool(word), ""
            continue
        if word and c.isupper():
            after_small = name[i - 1].islower() or name[i - 1] in "0123456789"
            before_small = i + 1 < len(name) and name[i + 1].islower()
            if after_small or len(word.encode()) > 1 and before_small:
                out, word = out + [word], ""
        word += c
    return out + [word] * bool(word)


def test_split_identifier(spark):
    names = ["loadTileCache", "RiverBank", "fold_left_right", "LONG_UPPER_NAME", "CSVWriter", "q", "", "v3Beta", "UDPSocket4You", "__call__", "dash-ed.part", "QRs", "éÀb", "lowerÀB"]
    assert column(spark, names, N.words_of) == [python_words(n) for n in names]
    assert column(spark, ["loadTileCache", "fold_left2Right", "PlainHTTPHop", "solo"], N.split_identifier) == ["loadTileCache load tile cache", "fold_left2Right fold left2 right", "PlainHTTPHop plain http hop", "solo"]


def test_paths(spark):
    paths = ["lib/maps/../tiles/./hex", "../../q", "m//n/", ".", "x/../../y/z/.."]
    assert column(spark, paths, N.normalize_path) == [N.normalized(p) for p in paths]
    assert N.normalized(paths[0]) == "lib/tiles/hex"


def test_simple_hash(spark):
    def plain(s):
        h = 0
        for c in memoryview(s.encode("utf-16-le")).cast("H"):
            h = (31 * h + c) & 0xFFFFFFFF
        h -= (h >> 31) << 32
        digits, n = "", abs(h)
        while n:
            n, r = divmod(n, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
        return ("-" if h < 0 else "") + (digits or "0")

    texts = ["", "q", "two words", "y" * 60, "Mixed Case 456 text", "é", "a😀b"]
    assert column(spark, texts, N.simple_hash) == [plain(t) for t in texts]


def test_anchors(spark):
    titles = ["Install It!", "a - b", "a- b", "--x--", "!!!", "Snake_case Ünïx", "a  b", "x -"]
    assert column(spark, titles, N.anchor) == ["install-it", "a--b", "a--b", "x", "section", "snake_case-ünïx", "a-b", "x"]


def test_test_marks(spark):
    rows = [("test_a", "x.py", "python", "function", True), ("TestA", "x.go", "go", "function", True), ("a", "b/a.spec.ts", "typescript", "function", True), ("a", "b/a.spec.ts", "typescript", "class", False), ("latest", "src/a.lua", "lua", "function", False), ("latest", "spec/a.lua", "lua", "function", True), ("a", "x/Tests/y.swift", "swift", "class", True)]
    df = spark.createDataFrame(rows, "n string, p string, l string, k string, w boolean")
    assert df.where(N.is_test(F.col("n"), F.col("p"), F.col("l"), F.col("k")) != F.col("w")).count() == 0


def test_languages(spark):
    paths = ["a.ts", "b/c.TS", "x.tar.hpp", ".ts", "a", "b.R", "d.kts"]
    assert column(spark, paths, N.by_extension) == [N.language_of(p) for p in paths] == ["typescript", None, "cpp", None, None, "r", "kotlin"]
    assert N.parse_language("C++") == "cpp" and N.parse_kind("field") == "property" and N.parse_kind("nope") is None


def test_probes(spark):
    df = spark.createDataFrame([("src/a/b.ts", "./config.js"), ("src/a/b.ts", "../x"), ("b.ts", "@/c"), ("b.ts", "react")], "f string, s string")
    got = [r[0] for r in df.select(N.probe_paths(N.import_base(F.col("f"), F.col("s")))).collect()]
    assert got[0] == ["src/a/config.js", "src/a/config.ts", "src/a/config.tsx", "src/a/config.d.ts"]
    assert got[1][:3] == ["src/x", "src/x.ts", "src/x.tsx"] and got[2][0] == "src/c" and got[3] is None


@given(st.text(max_size=300), st.integers(1, 100))
def test_bounded_never_cuts_a_character(text, most):
    out = N.bounded(text, most, "")
    assert text.startswith(out) and len(out.encode()) <= most


@given(st.integers(0, 10**6), st.integers(0, 10**6))
def test_cursors_round_trip(generation, offset):
    assert page.offset_of(page.cursor(generation, offset, "s"), 0, generation, "s") == offset


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(sorted(extract.PATTERNS)), st.text(alphabet="abc(){}[];:\"'`/*#= \nfunction classimportdef.->", max_size=200))
def test_extraction_never_fails(language, text):
    for f in extract.facts(language, text):
        assert f["start_line"] <= f["end_line"] <= text.count("\n") + 1 and f["name"]


def test_extraction_of_languages():
    found = lambda lang, text: {(f["kind"], f["name"]) for f in extract.facts(lang, text) if f["tag"] == "node"}
    assert ("function", "make") in found("cpp", "Foo* make(int a) {\n}\nint* B::go() { return 0; }\n")
    assert {("method", "m"), ("class", "A"), ("variable", "X")} <= found("python", "class A:\n  def m(self): pass\nX = 1\n")
    assert ("method", "Go") in found("go", "func (s *S) Go() {}\n") and ("class", "S") in found("go", "type S struct {\n}\n")
    assert ("class", "User") in found("ruby", "class User < Base\n  def x\n  end\nend\n") and not found("clojure", "(defn a [])")
    java = extract.facts("java", '@GetMapping("/a")\nclass C { void m() { run(); } }\n')
    assert any(f["name"] == "GET /a" for f in java) and any(f["tag"] == "call" and f["name"] == "run" for f in java)
    assert all(re.match(r"\w", f["name"]) for f in java)


def test_truncated_never_cuts_a_character(spark):
    texts = ["", "abc", "é" * 60, "a" + "€" * 50, "ab" + "😀" * 40, "x" * 101, "x" * 99 + "é"]
    assert column(spark, texts, lambda c: N.truncated(c, 100)) == [N.bounded(t, 100, "") for t in texts]


def test_ignore_rules(tmp_path):
    from factloom.sources.repository import list_files

    made = ["a.py", "b/a.py", "b/c/d.py", "logs/x.py", "b/logs/y.py", "gen/deep/er/z.py", "keep/z.py", "keep/w.py", "x1.py", "xa.py", "top.py", "b/top.py"]
    for path in made:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x = 1\n")
    (tmp_path / ".git").mkdir()
    left = lambda rules: sorted(set(made) - set(list_files(str(tmp_path)))) if not (tmp_path / ".gitignore").write_text(rules) is None else []
    assert left("") == []
    assert left("/top.py\n") == ["top.py"] and left("top.py\n") == ["b/top.py", "top.py"]
    assert left("logs/\n") == ["b/logs/y.py", "logs/x.py"] and left("/logs\n") == ["logs/x.py"]
    assert left("b/*.py\n") == ["b/a.py", "b/top.py"] and left("b/**/*.py\n") == ["b/a.py", "b/c/d.py", "b/logs/y.py", "b/top.py"]
    assert left("gen/**\n") == ["gen/deep/er/z.py"] and left("**/er\n") == ["gen/deep/er/z.py"]
    assert left("keep/*\n!keep/w.py\n") == ["keep/z.py"] and left("x[0-9].py\n") == ["x1.py"] and left("x[!0-9].py\n") == ["xa.py"]
    assert left("# no\n\\#x\nx?.py  \n") == ["x1.py", "xa.py"]
    (tmp_path / ".gitignore").write_text("a.py\n")
    assert list_files(str(tmp_path / "b")) == ["c/d.py", "logs/y.py", "top.py"]


def test_imported_names():
    found = lambda text: [(f["name"], f["names"], f["reexport"]) for f in extract.facts("typescript", text) if f["tag"] == "import"]
    assert found("import { p, type Q as R } from './m';\nimport def from './n';\nimport * as all from './o';\nimport './side';\n") == [("./m", ["p", "Q"], None), ("./n", None, None), ("./o", None, None), ("./side", None, None)]
    assert found("export { a as b } from './m';\nexport * from './n';\n") == [("./m", ["a"], True), ("./n", None, True)]
    python = [f["names"] for f in extract.facts("python", "from .m import a, b as c\nfrom n import *\n") if f["tag"] == "import"]
    assert python == [["a", "b"], None]
