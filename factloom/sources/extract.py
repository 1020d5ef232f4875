"""Facts of one source file: declarations and raw references, without any other file.

Python is read by its own parser. Languages with braces are read from a copy of the text in which comments
and strings are blanked, so that lines and columns stay: declarations by pattern, their ends by matching
braces. The remaining languages are read by declaration patterns alone; their ranges end where `end`,
indentation or the line says. What a pattern can't see (macros, unusual layouts) is not reported.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right

from factloom.functions.names import BUILTIN_TYPES, bounded

BODY_BYTES = 2000

FIELDS = ("tag", "kind", "name", "start_line", "end_line", "start_column", "end_column", "exported", "body", "doc", "module", "parent", "object", "constructor", "handlers", "match_index", "names", "reexport")


def _fact(tag, name, line, **more):
    out = dict.fromkeys(FIELDS) | {"tag": tag, "name": name, "start_line": line, "end_line": line, "start_column": 0, "end_column": 0}
    return out | more


_SCRIPT = {"typescript", "tsx", "javascript", "jsx"}
_HASH_COMMENTS = {"bash", "ruby", "elixir", "julia", "r", "nix", "powershell", "python"}
_DASH_COMMENTS = {"lua", "haskell", "elm"}


def blanked(text: str, language: str) -> str:
    """The text with the insides of strings and comments as blanks."""
    parts = [r'"(?:\\.|[^"\\\n])*"']
    if language in _HASH_COMMENTS | {"php"}:
        parts.append(r"#(?!\[)[^\n]*")
    elif language in _DASH_COMMENTS:
        parts.append(r"--[^\n]*")
    if language not in _HASH_COMMENTS | _DASH_COMMENTS:
        parts += [r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"]
    if language in _SCRIPT | {"go", "kotlin"}:
        parts.append(r"`(?:\\.|[^`\\])*`")
    if language not in {"rust", "haskell", "elm", "verilog"}:
        parts.append(r"'(?:\\.|[^'\\\n])*'")
    else:
        parts.append(r"'(?:\\.|[^'\\\n])'")
    blank = lambda m: re.sub(r"[^\n]", " ", m[0]) if len(m[0]) < 2 or m[0][0] not in "\"'`" else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1]
    return re.sub("|".join(parts), blank, text, flags=re.S)


_ID = r"[A-Za-z_$][\w$]*"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|sealed|readonly|open|data|inline|suspend|partial|extern|unsafe|const|synchronized|native|default|export|declare|pub(?:\([^)]*\))?|inner|companion|lateinit|mutating|fileprivate|implicit|lazy|case)\s+)*"
_TYPE = r"[\w$:.<>\[\],?*& ]+?"
# Patterns by language: (kind, pattern with the group name).
_COMMON = [("class", rf"\bclass\s+(?P<name>{_ID})"), ("enum", rf"\benum\s+(?:class\s+)?(?P<name>{_ID})")]
_TS = [
    ("function", rf"\bfunction\s*\*?\s*(?P<name>{_ID})"),
    *_COMMON,
    ("interface", rf"\binterface\s+(?P<name>{_ID})"),
    ("type_alias", rf"(?m)^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+(?P<name>{_ID})[^=\n]*="),
    ("function", rf"\b(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=\n]+)?=>|{_ID}\s*=>)"),
    ("variable", rf"\b(?:const|let|var)\s+(?P<name>{_ID})"),
    ("method", rf"(?m)^[ \t]+{_MODS}(?:get\s+|set\s+|\*\s*)?#?(?P<name>{_ID})\s*(?:<[^>\n]*>)?\([^;{{}}]*\)\s*(?::[^;{{}}=]+)?\{{"),
]
_JAVA = [*_COMMON, ("interface", rf"\binterface\s+(?P<name>{_ID})"), ("method", rf"(?m)^[ \t]+{_MODS}(?:<[^>]+>\s*)?(?:{_TYPE}\s+)?(?P<name>{_ID})\s*\([^;{{}}]*\)\s*(?:throws[^{{;]+)?[{{;]"), ("variable", rf"(?m)^[ \t]+{_MODS}[\w$.<>\[\],?]+\s+(?P<name>{_ID})\s*(?:=|;)")]
_C = [
    ("class", rf"\b(?:struct|union|class)\s+(?P<name>{_ID})\s*(?::[^{{;]*)?\{{"),
    ("enum", rf"\benum\s+(?:class\s+)?(?P<name>{_ID})"),
    ("type_alias", rf"\btypedef\b[^;{{]*?(?P<name>{_ID})\s*;"),
    ("function", rf"(?m)^#define\s+(?P<name>{_ID})\("),
    ("function", rf"(?m)^(?:[\w:<>,~]+[\s*&]+)+(?P<name>[~\w]+)\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:noexcept\s*)?[{{;]"),
    ("method", rf"(?m)^(?:[\w:<>,~]+[\s*&]+)*{_ID}::(?P<name>[~\w]+)\s*\([^;{{}}]*\)[^;{{}}]*\{{"),
]
PATTERNS = {
    **dict.fromkeys(["typescript", "tsx"], _TS),
    **dict.fromkeys(["javascript", "jsx"], [p for p in _TS if p[0] not in ("interface", "type_alias", "enum")]),
    "rust": [("function", rf"\bfn\s+(?P<name>{_ID})"), ("function", rf"\bmacro_rules!\s*(?P<name>{_ID})"), ("struct", rf"\bstruct\s+(?P<name>{_ID})"), ("enum", rf"\benum\s+(?P<name>{_ID})"), ("interface", rf"\btrait\s+(?P<name>{_ID})"), ("type_alias", rf"\btype\s+(?P<name>{_ID})[^=;]*="), ("variable", rf"\b(?:const|static|let)\s+(?:mut\s+)?(?P<name>{_ID})\s*[:=]"), ("variable", rf"\bmod\s+(?P<name>{_ID})")],
    "go": [("method", rf"(?m)^func\s*\([^)]*\)\s*(?P<name>{_ID})"), ("function", rf"(?m)^func\s+(?P<name>{_ID})"), ("class", rf"\btype\s+(?P<name>{_ID})\s+struct\b"), ("interface", rf"\btype\s+(?P<name>{_ID})\s+interface\b"), ("type_alias", rf"(?m)^type\s+(?P<name>{_ID})\s+(?!struct\b|interface\b)"), ("variable", rf"(?m)^(?:var|const)\s+(?P<name>{_ID})")],
    "java": _JAVA,
    "c": [p for p in _C if p[0] != "method"],
    "cpp": _C,
    "csharp": [("class", rf"\b(?:class|struct|record)\s+(?P<name>{_ID})"), ("interface", rf"\binterface\s+(?P<name>{_ID})"), ("enum", rf"\benum\s+(?P<name>{_ID})"), *[p for p in _JAVA if p[0] in ("method", "variable")]],
    "php": [("class", rf"\bclass\s+(?P<name>{_ID})"), ("interface", rf"\b(?:interface|trait)\s+(?P<name>{_ID})"), ("enum", rf"\benum\s+(?P<name>{_ID})"), ("function", rf"\bfunction\s+&?(?P<name>{_ID})"), ("variable", rf"(?m)^\s*{_MODS}(?:\w+\s+)?\$(?P<name>\w+)\s*=")],
    "kotlin": [("class", rf"\b(?:class|object|interface)\s+(?P<name>{_ID})"), ("function", rf"\bfun\s+(?:<[^>]+>\s*)?(?:[\w.]+\.)?(?P<name>{_ID})"), ("type_alias", rf"\btypealias\s+(?P<name>{_ID})"), ("variable", rf"\b(?:val|var)\s+(?P<name>{_ID})")],
    "swift": [("class", rf"\b(?:class|struct|enum|extension|actor)\s+(?P<name>{_ID})"), ("interface", rf"\bprotocol\s+(?P<name>{_ID})"), ("function", rf"\bfunc\s+(?P<name>{_ID})"), ("variable", rf"\b(?:let|var)\s+(?P<name>{_ID})")],
    "scala": [("class", rf"\b(?:class|object)\s+(?P<name>{_ID})"), ("interface", rf"\btrait\s+(?P<name>{_ID})"), ("function", rf"\bdef\s+(?P<name>{_ID})"), ("variable", rf"\b(?:val|var)\s+(?P<name>{_ID})"), ("type_alias", rf"\btype\s+(?P<name>{_ID})\s*=")],
    "dart": [*_COMMON, ("function", rf"(?m)^(?:[\w<>?]+\s+)(?P<name>{_ID})\s*\([^;{{}}]*\)\s*(?:async\s*)?[{{=]")],
    "groovy": [*_COMMON, ("interface", rf"\binterface\s+(?P<name>{_ID})"), ("function", rf"\bdef\s+(?P<name>{_ID})\s*\(")],
    "powershell": [("function", rf"(?i)\bfunction\s+(?P<name>[\w-]+)"), ("class", rf"(?i)\bclass\s+(?P<name>{_ID})"), ("enum", rf"(?i)\benum\s+(?P<name>{_ID})")],
    "bash": [("function", r"(?m)^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)"), ("variable", r"(?m)^\s*(?:export\s+|local\s+|readonly\s+)?(?P<name>[A-Za-z_]\w*)=")],
    "zig": [("function", rf"\bfn\s+(?P<name>{_ID})"), ("variable", rf"\b(?:const|var)\s+(?P<name>{_ID})")],
    "ruby": [("method", r"(?m)^\s*def\s+(?:self\.)?(?P<name>[\w?!=]+)"), ("class", r"(?m)^\s*(?:class|module)\s+(?P<name>\w+)"), ("variable", r"(?m)^\s*(?P<name>[A-Z@]\w*)\s*=[^=~]")],
    "lua": [("function", r"\bfunction\s+(?P<name>\w+)\s*\("), ("method", r"\bfunction\s+\w+[.:](?P<name>\w+)\s*\("), ("variable", r"(?m)^\s*(?:local\s+)?(?P<name>\w+)\s*=[^=]")],
    "elixir": [("class", r"\bdefmodule\s+(?P<name>[\w.]+)"), ("function", r"(?m)^\s*defp?\s+(?P<name>[\w?!]+)")],
    "julia": [("function", r"(?m)^\s*(?:function|macro)\s+(?P<name>[\w!]+)"), ("class", r"(?m)^\s*(?:mutable\s+)?struct\s+(?P<name>\w+)"), ("variable", r"(?m)^(?:const\s+)?(?P<name>\w+)\s*=[^=]")],
    "erlang": [("function", r"(?m)^(?P<name>[a-z]\w*)\s*\([^)]*\)[^.]*?->"), ("class", r"(?m)^-(?:module|record)\((?P<name>\w+)"), ("variable", r"(?m)^-define\((?P<name>\w+)")],
    "haskell": [("class", r"(?m)^(?:data|newtype)\s+(?P<name>\w+)"), ("interface", r"(?m)^class\s+(?:.*=>\s*)?(?P<name>\w+)"), ("function", r"(?m)^(?P<name>[a-z]\w*)\s*::")],
    "elm": [("type_alias", r"(?m)^type\s+(?:alias\s+)?(?P<name>\w+)"), ("function", r"(?m)^(?P<name>[a-z]\w*)\s*:"), ("variable", r"(?m)^(?P<name>[a-z]\w*)\s*=")],
    "fortran": [("function", r"(?im)^\s*(?:[\w()*]+\s+)*?(?:subroutine|function)\s+(?P<name>\w+)"), ("variable", r"(?im)^\s*(?:integer|real|logical|character)[^\n]*::\s*(?P<name>\w+)")],
    "verilog": [("class", r"\b(?:module|class)\s+(?P<name>\w+)"), ("interface", r"\binterface\s+(?P<name>\w+)"), ("function", r"\b(?:function|task)\s+(?:\w+\s+)*?(?P<name>\w+)\s*[(;]")],
    "r": [("function", r"(?P<name>[\w.]+)\s*(?:<-|=)\s*function\b")],
    "nix": [("variable", r"(?m)^\s*(?P<name>[\w-]+)\s*=[^=]")],
    "clojure": [],
}
_COMPILED = {lang: [(k, re.compile(p)) for k, p in ps] for lang, ps in PATTERNS.items()}
_BRACES = {"typescript", "tsx", "javascript", "jsx", "rust", "go", "java", "c", "cpp", "csharp", "php", "kotlin", "swift", "scala", "dart", "groovy", "powershell", "bash", "zig", "r"}
_ENDS = {"ruby", "lua", "elixir", "julia", "fortran"}
_NOT_NAMES = frozenset("if for while switch catch return function else do try new throw typeof await async super this in of case default sizeof defined match loop unless elif fn func def class struct enum interface impl use with yield and or not foreach using lock when assert print echo isset unset array list delete instanceof static_assert decltype alignof".split())
_CALLED = re.compile(rf"(?:(?P<object>[\w$.\])]*[\w$\])])\s*(?:\?\.|\.|->|::)\s*)?(?<![\w$])(?P<new>new\s+)?(?P<name>{_ID})\s*(?:::<[^>()]*>|<[\w, ]*>)?!?\s*\(")
_NO_CALLS = {"haskell", "elm", "fortran", "groovy", "dart", "powershell", "verilog", "clojure", "nix"}
_IMPORTS = {
    **dict.fromkeys(_SCRIPT, [r"""\bimport\s+(?:(?P<clause>[^'"();]*?)\bfrom\s*)?(['"])(?P<spec>[^'"\n]+)\2""", r"""\b(?P<reexport>export)\s+(?P<clause>[^'"();]*?)\bfrom\s*(['"])(?P<spec>[^'"\n]+)\3""", r"""\brequire\s*\(\s*(['"])(?P<spec>[^'"\n]+)\1"""]),
    "rust": [r"(?m)^\s*(?:pub\s+)?use\s+(?P<spec>[^;{]+?)\s*(?:::\{|;)"],
    "go": [r'(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"(?P<spec>[^"\n]+)"\s*$'],
    **dict.fromkeys(["java", "kotlin", "scala"], [r"(?m)^\s*import\s+(?:static\s+)?(?P<spec>[\w.*]+)"]),
    **dict.fromkeys(["c", "cpp"], [r'(?m)^\s*#include\s*[<"](?P<spec>[^>"\n]+)[>"]']),
    "csharp": [r"(?m)^\s*using\s+(?P<spec>[\w.]+)\s*;"],
    "php": [r"(?m)^\s*use\s+(?P<spec>[\w\\]+)", r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"](?P<spec>[^'\"\n]+)"],
    "ruby": [r"""\brequire(?:_relative)?\s*\(?\s*['"](?P<spec>[^'"\n]+)"""],
    "swift": [r"(?m)^\s*import\s+(?P<spec>\w+)"],
    "lua": [r"""\brequire\s*\(?\s*['"](?P<spec>[^'"\n]+)"""],
    "bash": [r"(?m)^\s*(?:source|\.)\s+(?P<spec>\S+)"],
    "elixir": [r"(?m)^\s*(?:import|alias|use|require)\s+(?P<spec>[\w.]+)"],
    "julia": [r"(?m)^\s*(?:using|import)\s+(?P<spec>[\w.]+)"],
    "erlang": [r"(?m)^-(?:include|include_lib|import)\(\s*\"?(?P<spec>[\w./]+)"],
    "haskell": [r"(?m)^import\s+(?:qualified\s+)?(?P<spec>[\w.]+)"],
    "elm": [r"(?m)^import\s+(?P<spec>[\w.]+)"],
    "fortran": [r"(?im)^\s*use\s+(?P<spec>\w+)"],
}
_HERITAGE = re.compile(rf"\b(?:class|interface|struct|object)\s+(?P<child>{_ID})[^{{;\n]*?(?:\bextends\s+(?P<up>[\w$., ]+?))?\s*(?:\bimplements\s+(?P<does>[\w$., ]+?))?\s*(?:\{{|$)", re.M)
_COLON = re.compile(rf"\b(?:class|struct|interface)\s+(?P<child>{_ID})[^:{{;\n]*:\s*(?P<up>[^{{\n]+)")
_TYPED = re.compile(rf"[:]\s*(?P<name>[A-Z][A-Za-z0-9_$]*)")
_RECEIVERS = frozenset("app api router route routes server fastify hono".split())
_ROUTE = re.compile(rf"(?P<object>{_ID}(?:\.{_ID})*)\s*\.\s*(?P<verb>get|post|put|patch|delete|head)\s*\(")
_MAPPING = re.compile(r"@(?P<verb>Get|Post|Put|Patch|Delete)Mapping\s*(?P<rest>\([^)]*\))?")


class _Text:
    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)


def _close(text: str, at: int) -> int | None:
    """The end of the braces that open at or after `at`, unless a statement ends first."""
    depth, parens = 0, 0
    for m in re.compile(r"[{}();]").finditer(text, at):
        c, i = m[0], m.start()
        if c in "()":
            parens += 1 if c == "(" else -1
        elif c == ";" and depth == 0 and parens <= 0:
            return i
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return i
            if depth < 0:
                return None
    return None


def _comment_above(lines: list[str], line: int) -> str | None:
    out, i = [], line - 2
    while i >= 0 and re.match(r"\s*(?://|/?\*|\*/|#(?!\[|include|define|!)|--)", lines[i]):
        out.append(re.sub(r"^\s*(?:///?!?|/\*\*?|\*/|\*|#|--)\s?|\*/\s*$", "", lines[i]).rstrip())
        i -= 1
    doc = "\n".join(reversed(out)).strip()
    return doc or None


def _imported(clause: str) -> list[str] | None:
    """The names between braces, before any `as`; None for whole modules and defaults."""
    inside = re.search(r"\{([^}]*)\}", clause)
    names = [re.sub(r"^type\s+", "", n.strip()).split(" as ")[0].strip() for n in inside[1].split(",")] if inside else []
    return [n for n in names if re.fullmatch(_ID, n)] or None


def _patterned(text: str, language: str) -> list[dict]:
    code, at = blanked(text, language), _Text(text)
    lines, out = text.split("\n"), []
    exports = language in _SCRIPT
    classes: list[tuple[int, int]] = []
    if language in _BRACES:
        opener = r"\b(?:impl|trait)\b[^;{]*\{" if language == "rust" else rf"\b(?:class|interface|struct|object|trait|enum|record|extension|protocol)\s+{_ID}[^;{{]*\{{"
        classes = [(m.start(), e) for m in re.finditer(opener, code) if (e := _close(code, m.end() - 1))]
    modules = [(m.start(), e, m[1]) for m in re.finditer(rf"\bmod\s+({_ID})\s*\{{", code) if (e := _close(code, m.end() - 1))] if language == "rust" else []
    named = set()
    for k, (kind, pattern) in enumerate(_COMPILED.get(language, [])):
        for m in pattern.finditer(code):
            name = m["name"]
            if name in _NOT_NAMES or kind == "method" and language in _SCRIPT | {"java", "csharp"} and not any(a < m.start("name") < b for a, b in classes):
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            inside = any(a < start < b for a, b in classes)
            if kind == "function" and inside and language in ("rust", "php", "kotlin", "swift", "scala", "dart", "groovy", "cpp"):
                kind_here = "method" if language in ("rust", "php", "swift", "cpp") else kind
            else:
                kind_here = kind
            end = None
            if kind != "variable" or "=>" in m[0]:
                end = _close(code, m.end() - 1 if m[0].endswith(("{", ";")) else m.end()) if language in _BRACES else None
            first, last = at.line(start), at.line(end if end is not None else max(start, m.end() - 1))
            if language in _ENDS and kind != "variable":
                indent = len(lines[first - 1]) - len(lines[first - 1].lstrip())
                last = next((i + 1 for i in range(first, len(lines)) if re.match(rf"\s{{0,{indent}}}end\b", lines[i])), first)
            lead = code.rfind("\n", 0, start) + 1
            exported = exports and bool(re.match(r"\s*export\b", code[lead:] if code[lead:start].strip() == "" or code[lead:].lstrip().startswith("export") else ""))
            body = "\n".join(lines[first - 1 : last])
            if language == "rust":
                i = first - 2
                while i >= 0 and lines[i].strip().startswith("#["):
                    body, i = lines[i].strip() + "\n" + body, i - 1
            module = ".".join([n for a, b, n in modules if a < start < b]) or None
            named.add(m.start("name"))
            out.append(_fact("node", name, first, kind=kind_here, end_line=max(first, last), start_column=start - at.starts[first - 1], exported=exported, body=bounded(body, BODY_BYTES), doc=_comment_above(lines, first), module=module, match_index=k * 1_000_000 + len(out)))
    for pattern in _IMPORTS.get(language, []):
        source = text if "['" in pattern or '"' in pattern else code
        if language == "go" and "import" not in text:
            continue
        for m in re.finditer(pattern, source):
            if source is text and code[m.start()] == " " != text[m.start()]:
                continue
            groups = m.groupdict()
            out.append(_fact("import", m["spec"].strip(), at.line(m.start("spec")), names=_imported(groups.get("clause") or ""), reexport=True if groups.get("reexport") else None))
    if language not in _NO_CALLS and language in _COMPILED:
        for m in _CALLED.finditer(code):
            name = m["name"]
            if name in _NOT_NAMES or m.start("name") in named or re.search(r"\b(?:function|fn|func|def|fun|class|interface)\s+$", code[max(0, m.start("name") - 12) : m.start("name")]):
                continue
            out.append(_fact("call", name, at.line(m.start("name")), object=m["object"], constructor=bool(m["new"])))
    if language in _SCRIPT | {"java", "php", "scala"}:
        for m in _HERITAGE.finditer(code):
            for tag, group in (("extends", "up"), ("implements", "does")):
                out += [_fact(tag, n.strip(), at.line(m.start()), parent=m["child"]) for n in (m[group] or "").split(",") if n.strip()]
    elif language in {"csharp", "kotlin", "swift", "cpp"}:
        for m in _COLON.finditer(code):
            bases = [re.sub(r"\(.*|<.*|\b(?:public|private|protected|virtual)\b", "", n).strip() for n in m["up"].split(",")]
            out += [_fact("extends", n, at.line(m.start()), parent=m["child"]) for n in bases if re.fullmatch(r"[\w.:]+", n)]
    elif language == "ruby":
        out += [_fact("extends", m[2], at.line(m.start()), parent=m[1]) for m in re.finditer(r"\bclass\s+(\w+)\s*<\s*(\w+)", code)]
    if language in {"typescript", "tsx", "csharp", "php", "kotlin"}:
        out += [_fact("type", m["name"], at.line(m.start("name"))) for m in _TYPED.finditer(code) if m["name"] not in BUILTIN_TYPES]
    out += _endpoints(text, code, language, at)
    return out


def _arguments(text: str, code: str, open_at: int) -> list[str]:
    depth, start, out = 0, open_at + 1, []
    for i in range(open_at, len(code)):
        c = code[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth == 0:
                out.append(text[start:i].strip())
                return [a for a in out if a]
        elif c == "," and depth == 1:
            out.append(text[start:i].strip())
            start = i + 1
    return []


def _endpoints(text: str, code: str, language: str, at: _Text) -> list[dict]:
    found = []
    if language in _SCRIPT:
        for m in _ROUTE.finditer(code):
            last = m["object"].rsplit(".", 1)[-1].lower()
            if last not in _RECEIVERS and not last.endswith(("router", "routes")):
                continue
            args = _arguments(text, code, m.end() - 1)
            first = args[0] if args else ""
            if len(first) > 1 and first[0] in "'\"`" and first[-1] == first[0]:
                path = first[1:-1]
            elif first.startswith("/") and "/" in first[1:]:
                path = first
            else:
                continue
            found.append((at.line(m.start()), m["verb"].upper(), path, [a for a in args[1:] if re.fullmatch(_ID, a)]))
    elif language == "java":
        for m in _MAPPING.finditer(text):
            if q := re.search(r"""(["'])((?:\\.|(?!\1).)*)\1""", m["rest"] or ""):
                found.append((at.line(m.start()), m["verb"].upper(), q[2], []))
    unique = sorted({(line, verb, path): handlers for line, verb, path, handlers in reversed(found)}.items())
    return [_fact("node", f"{verb} {path}", line, kind="endpoint", handlers=handlers, match_index=10**9 + i) for i, ((line, verb, path), handlers) in enumerate(unique)]


def _python(text: str) -> list[dict]:
    tree = ast.parse(text)
    lines, out = text.split("\n"), []

    def node(kind, n, name):
        doc = ast.get_docstring(n) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else None
        out.append(_fact("node", name, n.lineno, kind=kind, end_line=n.end_lineno or n.lineno, start_column=n.col_offset, end_column=n.end_col_offset or 0, exported=False, body=bounded("\n".join(lines[n.lineno - 1 : n.end_lineno]), BODY_BYTES), doc=_comment_above(lines, n.lineno) or doc, match_index=len(out)))

    def walk(n, in_class, top):
        for child in ast.iter_child_nodes(n):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                node("method" if in_class else "function", child, child.name)
                walk(child, False, False)
            elif isinstance(child, ast.ClassDef):
                node("class", child, child.name)
                out.extend(_fact("extends", b.attr if isinstance(b, ast.Attribute) else b.id, child.lineno, parent=child.name) for b in child.bases if isinstance(b, (ast.Name, ast.Attribute)))
                walk(child, True, False)
            else:
                if top and isinstance(child, (ast.Assign, ast.AnnAssign)):
                    for target in child.targets if isinstance(child, ast.Assign) else [child.target]:
                        if isinstance(target, ast.Name):
                            node("variable", child, target.id)
                if isinstance(child, ast.ImportFrom):
                    out.append(_fact("import", "." * child.level + (child.module or ""), child.lineno, names=[a.name for a in child.names if a.name != "*"] or None))
                if isinstance(child, ast.Call):
                    f = child.func
                    if isinstance(f, ast.Name):
                        out.append(_fact("call", f.id, f.lineno, constructor=False))
                    elif isinstance(f, ast.Attribute):
                        out.append(_fact("call", f.attr, f.end_lineno, object=ast.unparse(f.value)[:80], constructor=False))
                walk(child, False, False)

    walk(tree, False, True)
    return out


def facts(language: str, text: str) -> list[dict]:
    """The declarations and raw references of a text; Markdown is read elsewhere, line by line."""
    if language == "python":
        try:
            return _python(text)
        except (SyntaxError, ValueError, RecursionError):
            lines = enumerate(text.split("\n"), 1)
            return [_fact("node", m[2], i, kind="class" if m[1] == "class" else "function", exported=False, match_index=i) for i, line in lines if (m := re.match(r"\s*(?:async\s+)?(def|class)\s+(\w+)", line))]
    return _patterned(text, language)
