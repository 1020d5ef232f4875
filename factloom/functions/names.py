"""Enumerations, identifiers, paths and names: plain functions and the Column forms that Spark can run itself."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension.
EXTENSIONS = {
    "typescript": [".ts"],
    "tsx": [".tsx"],
    "javascript": [".js", ".mjs", ".cjs"],
    "jsx": [".jsx"],
    "python": [".py"],
    "go": [".go"],
    "rust": [".rs"],
    "java": [".java"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hxx", ".hh"],
    "csharp": [".cs"],
    "php": [".php"],
    "ruby": [".rb"],
    "swift": [".swift"],
    "kotlin": [".kt", ".kts"],
    "bash": [".sh", ".bash", ".zsh"],
    "scala": [".scala", ".sc"],
    "dart": [".dart"],
    "zig": [".zig"],
    "lua": [".lua"],
    "verilog": [".v", ".vh", ".sv", ".svh"],
    "haskell": [".hs", ".lhs"],
    "elixir": [".ex", ".exs"],
    "groovy": [".groovy", ".gradle"],
    "powershell": [".ps1", ".psm1", ".psd1"],
    "clojure": [".clj", ".cljs", ".cljc", ".edn"],
    "julia": [".jl"],
    "r": [".r", ".R", ".Rmd"],
    "erlang": [".erl", ".hrl"],
    "elm": [".elm"],
    "fortran": [".f90", ".f95", ".f03", ".f08", ".f", ".for", ".fpp"],
    "nix": [".nix"],
    "markdown": [".md", ".mdx"],
}
# Other spellings of languages and kinds.
LANGUAGE_ALIASES = {"golang": "go", "c++": "cpp", "c#": "csharp", "c_sharp": "csharp", "shell": "bash", "sh": "bash", "systemverilog": "verilog", "sv": "verilog", "hs": "haskell", "ex": "elixir", "ps1": "powershell", "clj": "clojure", "jl": "julia", "erl": "erlang", "f90": "fortran", "md": "markdown", "mdx": "markdown"}
KINDS = ["function", "class", "method", "interface", "type_alias", "enum", "variable", "struct", "trait", "module", "property", "namespace", "constant", "heading", "endpoint"]
KIND_ALIASES = {"field": "property", "package": "namespace", "const": "constant"}
EDGE_KINDS = ["imports", "calls", "contains", "extends", "implements", "references"]
# How specific a kind is; the higher one stands where two share a file, name and line.
SPECIFICITY = {"variable": 0, "type_alias": 1, "heading": 1, "endpoint": 1, "function": 2, "module": 2, "namespace": 2, "property": 2, "constant": 2, "class": 3, "struct": 3, "enum": 3, "method": 3, "interface": 4, "trait": 4}
CONTAINERS = ["class", "interface", "struct", "trait", "enum"]
CALLABLES = ["function", "method"]

# Names of built-in types, which make no type references.
BUILTIN_TYPES = frozenset(
    """string number boolean void undefined null any unknown never object symbol bigint Array Object String Number Boolean
    Function Symbol Promise Map Set WeakMap WeakSet Record Partial Required Readonly Pick Omit Exclude Extract ReturnType
    Parameters InstanceType Awaited int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 float32 float64 complex64
    complex128 byte rune error i8 i16 i32 i64 i128 u8 u16 u32 u64 u128 f32 f64 char str Vec Option Result Box Rc Arc HashMap
    HashSet BTreeMap BTreeSet long short float double Integer Long Short Byte Float Double Character List ArrayList decimal
    dynamic var Dictionary IEnumerable Task Action Func unsigned signed size_t ptrdiff_t auto nullptr_t array mixed callable
    iterable self static parent Int Unit Nothing Any MutableList MutableMap MutableSet bool""".split()
)

# What marks a test, by language. name_* look at the lower-cased name, exact_* at the name as it is.
_TESTS = {
    "rust": {"name_starts": ["test_"], "exact": ["test"], "path_has": ["/tests/"], "path_ends": ["_test.rs"], "both": ["test"]},
    "python": {"name_starts": ["test_"], "exact_starts": ["Test"], "path_has": ["/tests/", "/test_"], "path_ends": ["_test.py"]},
    "go": {"exact_starts": ["Test", "Benchmark", "Example"], "path_ends": ["_test.go"]},
    "java": {"name_starts": ["test"], "exact_ends": ["Test", "Tests", "Spec"], "path_has": ["/test/", "test.java", "test.kt"]},
    "ruby": {"name_starts": ["test_"], "path_has": ["_test.rb", "_spec.rb", "/spec/", "/test/"]},
    "elixir": {"name_starts": ["test ", "test_"], "path_has": ["/test/"], "path_ends": ["_test.exs"]},
    "csharp": {"name_starts": ["test"], "exact_ends": ["Test", "Tests"], "path_has": ["/tests/", "test.cs"]},
    "swift": {"name_starts": ["test"], "exact_ends": ["Tests"], "path_has": ["tests/", "test.swift"]},
    "php": {"name_starts": ["test"], "exact_ends": ["Test"], "path_has": ["/tests/", "test.php"]},
}
for _same in ("kotlin", "scala", "groovy"):
    _TESTS[_same] = _TESTS["java"]
_SCRIPT = ["typescript", "tsx", "javascript", "jsx"]
_SCRIPT_NAMES = ["describe", "it", "test", "xit", "xdescribe"]
_SCRIPT_PATHS = [".test.", ".spec.", "__tests__"]


def _any(tests):
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def is_test(name: Column, path: Column, language: Column, kind: Column) -> Column:
    """Whether a symbol is a test by its name and path."""
    low, at = F.lower(name), F.lower(path)
    script_file = _any(at.contains(x) for x in _SCRIPT_PATHS)
    script = low.isin(_SCRIPT_NAMES) | script_file & (kind.isin("function", "method", "variable") | low.startswith("test") | low.endswith("test") | low.startswith("spec"))
    out = F.when(language.isin(_SCRIPT), script)
    for lang, r in _TESTS.items():
        marks = [low.startswith(x) for x in r.get("name_starts", [])] + [name == x for x in r.get("exact", [])]
        marks += [name.startswith(x) for x in r.get("exact_starts", [])] + [name.endswith(x) for x in r.get("exact_ends", [])]
        marks += [at.contains(x) for x in r.get("path_has", [])] + [at.endswith(x) for x in r.get("path_ends", [])]
        marks += [low.contains(x) & at.contains(x) for x in r.get("both", [])]
        out = out.when(language == lang, _any(marks))
    return out.otherwise(low.contains("test") & (at.contains("test") | at.contains("spec")))


def rust_test_marks(body: Column, qualified: Column) -> Column:
    """Attributes before a Rust item that end in `test`, or a scope named tests."""
    lead = F.regexp_extract(F.coalesce(body, F.lit("")), r"^\s*((?:#\[[^\]]*\]\s*)*)", 1)
    return lead.rlike(r"#\[\s*(?:[^\]()]*::)?test\s*[\](]") | F.array_contains(F.split(F.coalesce(qualified, F.lit("")), r"\."), "tests")


def by_extension(path: Column) -> Column:
    """The language of a path; null if its extension is none of ours. Case counts."""
    out = F.lit(None).cast("string")
    ext = F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)
    for lang, exts in EXTENSIONS.items():
        out = F.when(ext.isin(exts), lang).otherwise(out)
    return out


def language_of(path: str) -> str | None:
    m = re.search(r"[^/](\.[^./]+)$", path)
    return next((lang for lang, exts in EXTENSIONS.items() if m and m[1] in exts), None)


def parse_language(text: str) -> str | None:
    low = text.lower()
    return low if low in EXTENSIONS else LANGUAGE_ALIASES.get(low)


def parse_kind(text: str) -> str | None:
    return text if text in KINDS else KIND_ALIASES.get(text)


def parse_edge_kind(text: str) -> str | None:
    return text if text in EDGE_KINDS else None


def _mapped(value: Column, known: dict[str, str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.element_at(table, F.coalesce(value, F.lit(""))), F.lit(default))


def kind_or(value: Column, default: str) -> Column:
    """The kind that a spelling means, else the default."""
    return _mapped(value, {k: k for k in KINDS} | KIND_ALIASES, default)


def language_or(value: Column, default: str) -> Column:
    return _mapped(F.lower(value), {k: k for k in EXTENSIONS} | LANGUAGE_ALIASES, default)


def edge_kind_or(value: Column, default: str) -> Column:
    return _mapped(value, {k: k for k in EDGE_KINDS}, default)


def truncated(text: Column, most: int) -> Column:
    """At most `most` bytes of UTF-8, cut between characters, in the JVM."""
    raw = F.encode(text, "UTF-8")
    cut = lambda n: F.substring(raw, 1, most - n)
    whole = lambda n: F.is_valid_utf8(cut(n).cast("string"))
    kept = F.when(whole(0), cut(0)).when(whole(1), cut(1)).when(whole(2), cut(2)).otherwise(cut(3))
    return F.when(F.octet_length(text) <= most, text).otherwise(kept.cast("string"))


def node_id(kind: Column, path: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", kind, path, name, line.cast("string"))


def specificity(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, v in SPECIFICITY.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


_BREAK = r"(?<=[\p{Ll}0-9])(?=\p{Lu})|(?<=[^_.\- ][^_.\- ])(?=\p{Lu}\p{Ll})"


def words_of(name: Column) -> Column:
    """The words of an identifier: separators _ - . and changes of case."""
    return F.filter(F.split(F.regexp_replace(name, _BREAK, " "), r"[_.\- ]+"), lambda w: w != "")


def split_identifier(name: Column) -> Column:
    words = words_of(name)
    return F.when(F.size(words) > 1, F.concat_ws(" ", name, F.transform(words, F.lower))).otherwise(name)


def name_tokens(name: Column, qualified: Column) -> Column:
    parts = F.concat_ws(" ", F.transform(F.split(qualified, r"\."), split_identifier))
    return F.when(qualified.isNotNull() & (qualified != name), F.concat_ws(" ", split_identifier(name), parts)).otherwise(split_identifier(name))


def normalize_path(path: Column) -> Column:
    """Drops empty and `.` parts; `..` takes the part before it, if there is one."""
    step = lambda done, part: (
        F.when(part.isin("", "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    )
    return F.concat_ws("/", F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step))


def normalized(path: str) -> str:
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def import_base(importer: Column, specifier: Column) -> Column:
    """The path that a relative or aliased specifier names, before extensions; null for packages."""
    folder = F.regexp_extract(importer, r"^(.*)/[^/]*$", 1)
    relative = normalize_path(F.when(folder == "", specifier).otherwise(F.concat_ws("/", folder, specifier)))
    return F.when(specifier.rlike(r"^\.\.?/"), relative).when(specifier.rlike("^[@~]/"), F.concat(F.lit("src/"), F.substring(specifier, 3, 100_000)))


# What may follow a path without extension, in order.
PROBES = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", ".py", ".rs", ".go", ".java", ".rb", ".php", ".swift", ".kt", ".kts"]


def probe_paths(base: Column) -> Column:
    """Candidate files of an import base, in order."""
    cut = lambda ext: F.regexp_replace(base, rf"\.{ext}$", "")
    more = F.when(base.endswith(".js"), F.array(*[F.concat(cut("js"), F.lit(x)) for x in (".ts", ".tsx", ".d.ts")]))
    more = more.when(base.endswith(".jsx"), F.array(*[F.concat(cut("jsx"), F.lit(x)) for x in (".tsx", ".ts")]))
    more = more.when(F.element_at(F.split(base, "/"), -1).contains("."), F.array().cast("array<string>"))
    return F.when(base.isNotNull(), F.concat(F.array(base), more.otherwise(F.array(*[F.concat(base, F.lit(x)) for x in PROBES]))))


def simple_hash(text: Column) -> Column:
    """31 * h + c over UTF-16 units in 32 bits, in base 36 with a sign."""
    wrap = lambda h: F.pmod(h + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("...."), 0)
    h = F.aggregate(units, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + F.conv(c, 16, 10).cast("long")))
    return F.lower(F.conv(h.cast("string"), 10, -36))


def anchor(title: Column) -> Column:
    """The link anchor of a heading."""
    kept = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\-\s]", "")
    gap = F.regexp_replace(kept, r"[\s-]*-[\s-]*\s(?=[^\s-])", "\1\1")  # a dash, then space before a word: two dashes
    gap = F.regexp_replace(F.regexp_replace(gap, r"[\s-]*-[\s-]*", "\1"), r"\s+", "\1")
    out = F.translate(F.regexp_replace(gap, "^\1+|\1+$", ""), "\1", "-")
    return F.when(out == "", "section").otherwise(out)


def extractor_of(kind: str, language: str | None) -> str:
    """What a fact was read by."""
    return {"endpoint": "route-pattern", "heading": "markdown-heading"}.get(kind, "python-ast" if language == "python" else "declaration-pattern")


def bounded(text: str, most: int, mark: str = "...") -> str:
    """At most `most` bytes of UTF-8, cut between characters, with a mark if anything went."""
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode("utf-8", "ignore") + mark


def _folding() -> tuple[str, str]:
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) if (d := unicodedata.normalize("NFD", chr(c))) and d[0].isascii() and len(d) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case without the diacritics of Latin letters."""
    plain = F.octet_length(text) == F.length(text)  # one byte a character: nothing to fold
    return F.lower(F.when(plain, text).otherwise(F.translate(text, *_folding())))


def search_terms(text: Column) -> Column:
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def in_path(path: Column, prefix: str) -> Column:
    """The file itself or anything below the folder; never a pattern."""
    return (path == prefix) | path.startswith(prefix.rstrip("/") + "/")
