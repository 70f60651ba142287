"""Symbols, imports, calls, heritage, types and assignments of source files.

Each file is worked on alone in a task (``mapInPandas``): Python by its own
``ast``, the other languages by tables of patterns over the text with comments
and strings blanked, so that a place in one is the same place in the other.
Blocks end at their matching brace, in Ruby at the ``end`` of their indentation.
A language without a table gets general patterns.

Records come in one schema; ``kind`` says which columns count. A file that is
too large or doesn't parse gives one record of kind ``error``. Rows are in order
of place within a file. Null contents give nothing; an empty table none.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import language

#: Characters of the largest file that is read.
MAX_CHARS = 10_000_000
RECORD = "filePath string, language string, kind string, name string, label string, owner string, receiver string, other string, line int, endLine int, signature string, exported boolean, parameterCount int, returnType string, parameterTypes string, description string"
COLUMNS = [c.split()[0] for c in RECORD.split(", ")]
TYPES = frozenset("Class Struct Interface Trait Enum Record Union Impl".split())
FUNCTIONS = frozenset("Function Method Constructor".split())


@dataclass
class Found:
    """A definition with its extent."""

    label: str
    name: str
    start: int
    end: int
    owner: str = ""
    row: dict = field(default_factory=dict)


# Text


def blanked(text: str, line: str, block: tuple[str, str] | None, quotes: str) -> str:
    """The text with comments and the insides of strings as blanks, line ends kept."""
    parts = [re.escape(x) + r"[^\n]*" for x in line.split()]
    if block:
        parts.append(re.escape(block[0]) + r".*?(?:" + re.escape(block[1]) + r"|\Z)")
    parts += [rf"{q}{q}{q}.*?(?:{q}{q}{q}|\Z)" for q in quotes if q in "\"'" and q * 3 in text]
    parts += [r"`[^`]*(?:`|\Z)" if q == "`" else rf"{q}(?:\\.|[^{q}\\\n])*(?:{q}|(?=\n)|\Z)" for q in quotes]

    def blank(m: re.Match) -> str:
        s = m[0]
        keep = 1 if s[0] in quotes else 0
        inner = re.sub(r"[^\n]", " ", s[keep : len(s) - keep if len(s) > 1 else len(s)])
        return s[:keep] + inner + (s[-1:] if keep and len(s) > 1 else "")

    return re.sub("|".join(parts), blank, text, flags=re.S)


def matching(code: str, at: int, pair: str = "{}") -> int:
    """Place after the bracket that closes the one at ``at``; the end if none does."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(code, at):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return m.end()
    return len(code)


def description_of(text: str, at: int) -> str | None:
    """The comment that ends just above a definition, without its marks and XML tags."""
    out: list[str] = []
    for line in reversed(text[: text.rfind("\n", 0, at) + 1].splitlines()):
        s = line.strip()
        if re.match(r"(///?|#(?!\[|include|define|if|end|pragma)|/?\*|--)", s) or s.endswith("*/"):
            out.append(re.sub(r"^(///?!?|/\*\*?|\*/|\*|#+|--+)|\*/$", "", s).strip())
        elif not re.match(r"(@|#\[|\[)", s):
            break
    clean = " ".join(re.sub(r"<[^>]*>", "", x).strip() for x in reversed(out))
    return clean.strip() or None


def parameters(raw: str, order: str) -> tuple[int, str]:
    """Number of parameters and ``name:type`` of each; ``order`` is name-first or type-first."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(raw + ","):
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0:
            parts.append(raw[last:i].strip())
            last = i + 1
    parts = [p for p in parts if p and p not in ("self", "&self", "&mut self", "mut self", "void", "this")]
    out = []
    for p in parts:
        p = re.sub(r"\s*=.*$", "", re.sub(r"@\w+(\([^)]*\))?\s*|\b(final|const|var|val|readonly|public|private|protected|out|ref|in|params|inout|override|mut|implicit)\s+", "", p, flags=re.S))
        if order == "colon":
            name, _, kind = (x.strip() for x in p.partition(":"))
            name = name.split()[-1] if name.split() else name
        elif order == "name":
            name, _, kind = (x.strip() for x in p.partition(" "))
        else:
            m = re.match(r"(.*?)([*&$\s]*)([\w$]+)(\[\])*$", p, re.S)
            name, kind = (m[3], (m[1] + m[2].strip()).strip()) if m else (p, "")
        out.append(f"{name.lstrip('$.?&*')}:{kind}" if kind else name.lstrip("$.?&*"))
    return len(parts), ", ".join(out)


# Languages

ID = r"[A-Za-z_$][\w$]*"
GEN = r"(?:<[^{}()]*?>)?"
MOD = r"(?P<mods>(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|async|virtual|export|default|partial|readonly|inline|suspend|data|case|implicit|lazy|native|synchronized|unsafe|extern|fileprivate|mutating|convenience|required|declare|enum|inner|operator|infix|tailrec|annotation|value|strictfp|transient|volatile|const|new)\s+)*)"
HEAD = r"(?P<head>[^{};]*)"
ARGS = r"\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)"


def _rules(*rows: tuple[str, str]) -> list[tuple[str, re.Pattern]]:
    return [(label, re.compile(p, re.M)) for label, p in rows]


_JS = _rules(
    ("Class", rf"^\s*{MOD}class\s+(?P<name>{ID}){GEN}{HEAD}\{{"),
    ("Interface", rf"^\s*{MOD}interface\s+(?P<name>{ID}){GEN}{HEAD}\{{"),
    ("Enum", rf"^\s*{MOD}enum\s+(?P<name>{ID})\s*\{{"),
    ("TypeAlias", rf"^\s*{MOD}type\s+(?P<name>{ID}){GEN}\s*="),
    ("Function", rf"^\s*{MOD}function\s*\*?\s*(?P<name>{ID})\s*{GEN}{ARGS}(?:\s*:\s*(?P<ret>[^{{;]+))?\s*\{{"),
    ("Function", rf"^\s*{MOD}(?:let|var)?\s*(?P<name>{ID})\s*(?::[^=\n]+)?=\s*(?:async\s*)?{ARGS}\s*(?::\s*(?P<ret>[^=\n]+))?=>"),
    ("Method", rf"^[ \t]+{MOD}(?:get\s+|set\s+|\*\s*)?(?P<name>{ID})\s*{GEN}{ARGS}\s*(?::\s*(?P<ret>[^{{;\n]+))?\{{"),
    ("Property", rf"^[ \t]+(?P<mods>(?:public|private|protected|static|readonly|declare)\s+)+(?P<name>{ID})\s*[?!]?\s*(?::\s*(?P<ret>[^=;\n]+))?[=;]"),
)
_JAVA = _rules(
    ("Class", rf"^\s*{MOD}class\s+(?P<name>{ID}){GEN}{HEAD}\{{"),
    ("Interface", rf"^\s*{MOD}interface\s+(?P<name>{ID}){GEN}{HEAD}\{{"),
    ("Annotation", rf"^\s*{MOD}@interface\s+(?P<name>{ID})\s*\{{"),
    ("Enum", rf"^\s*(?P<mods>(?:public|private|protected|static)\s+)*enum\s+(?P<name>{ID}){HEAD}\{{"),
    ("Record", rf"^\s*{MOD}record\s+(?P<name>{ID}){GEN}\s*{ARGS}{HEAD}[{{;]"),
    ("Struct", rf"^\s*{MOD}struct\s+(?P<name>{ID}){GEN}{HEAD}\{{"),
    ("Namespace", rf"^\s*(?P<mods>)namespace\s+(?P<name>[\w.]+)\s*[{{;]"),
    ("Delegate", rf"^\s*{MOD}delegate\s+(?P<ret>[\w<>\[\],.? ]+?)\s+(?P<name>{ID}){GEN}\s*{ARGS}\s*;"),
    ("Constructor", rf"^[ \t]*(?P<mods>(?:public|private|protected|internal)\s+)(?P<name>[A-Z]\w*)\s*{ARGS}{HEAD}\{{"),
    ("Method", rf"^[ \t]+{MOD}{GEN}\s*(?P<ret>(?!return\b|new\b|else\b|throw\b)[A-Za-z_][\w<>\[\],.? ]*?)\s+(?P<name>{ID})\s*{GEN}{ARGS}(?:\s*throws[^{{;]*)?\s*(?:\{{|;|=>)"),
    ("Property", rf"^[ \t]+(?P<mods>(?:public|private|protected|internal|static|final|readonly|volatile)\s+)+(?P<ret>[\w<>\[\],.?]+)\s+(?P<name>{ID})\s*(?:=|;|\{{\s*get)"),
)
#: name: (comment of a line, of a block, quotes, order of a parameter's name and type, definitions)
LANGUAGES: dict[str, tuple[str, tuple[str, str] | None, str, str, list[tuple[str, re.Pattern]]]] = {
    "go": ("//", ("/*", "*/"), "\"'`", "name", _rules(
        ("Method", rf"^func\s*\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<name>\w+)\s*{ARGS}[ \t]*(?P<ret>[^{{\n]*)\{{"),
        ("Function", rf"^func\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?{ARGS}[ \t]*(?P<ret>[^{{\n]*)\{{"),
        ("Struct", r"^(?:type)?[ \t]*(?P<name>\w+)(?:\[[^\]]*\])?[ \t]+struct[ \t]*\{"),
        ("Interface", r"^(?:type)?[ \t]*(?P<name>\w+)(?:\[[^\]]*\])?[ \t]+interface[ \t]*\{"),
        ("TypeAlias", r"^type[ \t]+(?P<name>\w+)[ \t]+=?[ \t]*(?!struct\b|interface\b)(?P<ret>[^\n{]+)$"),
        ("Const", r"^const[ \t]+(?P<name>\w+)"),
        ("Variable", r"^var[ \t]+(?P<name>\w+)"),
    )),
    "javascript": ("//", ("/*", "*/"), "\"'`", "colon", _JS),
    "typescript": ("//", ("/*", "*/"), "\"'`", "colon", _JS),
    "java": ("//", ("/*", "*/"), "\"'", "type", _JAVA),
    "csharp": ("//", ("/*", "*/"), "\"'", "type", _JAVA),
    "kotlin": ("//", ("/*", "*/"), "\"'", "colon", _rules(
        ("Interface", rf"^\s*{MOD}interface\s+(?P<name>\w+){GEN}(?P<head>[^{{}}\n]*)"),
        ("Class", rf"^\s*{MOD}(?:class|object)\s+(?P<name>\w+){GEN}(?:\s*(?P<mods2>(?:private|internal)?\s*(?:constructor)?)\s*{ARGS})?(?P<head>[^{{}}\n]*)"),
        ("Function", rf"^\s*{MOD}fun\s+{GEN}\s*(?:[\w.<>]+\.)?(?P<name>\w+)\s*{ARGS}(?:\s*:\s*(?P<ret>[^{{=\n]+))?"),
        ("Property", rf"^\s*{MOD}va[lr]\s+(?P<name>\w+)(?:\s*:\s*(?P<ret>[^=\n{{]+))?"),
    )),
    "scala": ("//", ("/*", "*/"), "\"", "colon", _rules(
        ("Trait", rf"^\s*{MOD}trait\s+(?P<name>\w+)(?:\[[^\]]*\])?(?P<head>[^{{}}\n]*)"),
        ("Class", rf"^\s*{MOD}(?:class|object)\s+(?P<name>\w+)(?:\[[^\]]*\])?(?:\s*{ARGS})?(?P<head>[^{{}}\n]*)"),
        ("Function", rf"^\s*{MOD}def\s+(?P<name>\w+)(?:\[[^\]]*\])?(?:{ARGS})?(?:\s*:\s*(?P<ret>[^{{=\n]+))?"),
        ("Property", rf"^\s*{MOD}va[lr]\s+(?P<name>\w+)(?:\s*:\s*(?P<ret>[^=\n{{]+))?"),
    )),
    "swift": ("//", ("/*", "*/"), "\"", "colon", _rules(
        ("Class", rf"^\s*{MOD}(?:class|actor|extension)\s+(?P<name>\w+){GEN}{HEAD}\{{"),
        ("Struct", rf"^\s*{MOD}struct\s+(?P<name>\w+){GEN}{HEAD}\{{"),
        ("Interface", rf"^\s*{MOD}protocol\s+(?P<name>\w+){HEAD}\{{"),
        ("Enum", rf"^\s*{MOD}enum\s+(?P<name>\w+){GEN}{HEAD}\{{"),
        ("Constructor", rf"^\s*{MOD}(?P<name>init)[?!]?\s*{ARGS}{HEAD}\{{"),
        ("Function", rf"^\s*{MOD}(?:class\s+)?func\s+(?P<name>\w+)\s*{GEN}{ARGS}(?:[^{{\n]*?->\s*(?P<ret>[^{{\n]+))?"),
        ("Property", rf"^\s*{MOD}(?:let|var)\s+(?P<name>\w+)\s*:\s*(?P<ret>[^={{\n]+)"),
    )),
    "rust": ("//", ("/*", "*/"), "\"", "colon", _rules(
        ("Struct", rf"^\s*(?P<mods>pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+){GEN}"),
        ("Enum", rf"^\s*(?P<mods>pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+){GEN}"),
        ("Trait", rf"^\s*(?P<mods>pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+){GEN}{HEAD}\{{"),
        ("Impl", rf"^\s*(?:unsafe\s+)?impl{GEN}\s+(?:(?P<trait>[\w:]+){GEN}\s+for\s+)?(?P<name>\w+){GEN}{HEAD}\{{"),
        ("Function", rf"(?:^|(?<=[{{;}}]))\s*(?P<mods>pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+)*fn\s+(?P<name>\w+){GEN}\s*{ARGS}(?:\s*->\s*(?P<ret>[^{{;]+))?"),
        ("Macro", r"^\s*macro_rules!\s*(?P<name>\w+)"),
        ("Module", r"^\s*(?P<mods>pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>\w+)"),
        ("Const", r"^\s*(?P<mods>pub(?:\([^)]*\))?\s+)?const\s+(?P<name>\w+)\s*:"),
        ("Static", r"^\s*(?P<mods>pub(?:\([^)]*\))?\s+)?static\s+(?:mut\s+)?(?P<name>\w+)\s*:"),
        ("TypeAlias", r"^\s*(?P<mods>pub(?:\([^)]*\))?\s+)?type\s+(?P<name>\w+)"),
    )),
    "c": ("//", ("/*", "*/"), "\"'", "type", _rules(
        ("Function", rf"^(?P<mods>(?:static|inline|extern)\s+)*(?P<ret>[A-Za-z_][\w \t]*?[\s*]+)(?P<name>[A-Za-z_]\w*)\s*{ARGS}\s*\{{"),
        ("Struct", r"^\s*(?:typedef\s+)?struct\s+(?P<name>\w+)\s*\{"),
        ("Union", r"^\s*(?:typedef\s+)?union\s+(?P<name>\w+)\s*\{"),
        ("Enum", r"^\s*(?:typedef\s+)?enum\s+(?P<name>\w+)\s*\{"),
        ("Macro", r"^\s*#\s*define\s+(?P<name>\w+)"),
        ("Typedef", r"^\s*typedef\s+[^;{]*?\b(?P<name>\w+)\s*;"),
    )),
    "cpp": ("//", ("/*", "*/"), "\"'", "type", _rules(
        ("Namespace", r"^\s*namespace\s+(?P<name>[\w:]+)\s*\{"),
        ("Class", rf"^\s*(?:template\s*<[^>]*>\s*)?class\s+(?P<name>\w+){HEAD}\{{"),
        ("Struct", rf"^\s*(?:typedef\s+)?struct\s+(?P<name>\w+){HEAD}\{{"),
        ("Enum", rf"^\s*enum\s+(?:class\s+)?(?P<name>\w+){HEAD}\{{"),
        ("Method", rf"^(?P<ret>[A-Za-z_][\w:<>,*& \t]*?[\s*&]+)?(?P<owner>\w+)::(?P<name>~?\w+)\s*{ARGS}[^;{{]*\{{"),
        ("Function", rf"^[ \t]*(?P<mods>(?:static|inline|virtual|constexpr|explicit|friend)\s+)*(?P<ret>(?!return\b|else\b|new\b|delete\b)[A-Za-z_][\w:<>,*& \t]*?[\s*&]+)(?P<name>[A-Za-z_]\w*)\s*{ARGS}[^;{{()=]*\{{"),
        ("Macro", r"^\s*#\s*define\s+(?P<name>\w+)"),
    )),
    "php": ("// #", ("/*", "*/"), "\"'", "type", _rules(
        ("Namespace", r"^\s*namespace\s+(?P<name>[\w\\]+)"),
        ("Class", rf"^\s*{MOD}class\s+(?P<name>\w+){HEAD}\{{"),
        ("Interface", rf"^\s*interface\s+(?P<name>\w+){HEAD}\{{"),
        ("Trait", rf"^\s*trait\s+(?P<name>\w+){HEAD}\{{"),
        ("Enum", rf"^\s*enum\s+(?P<name>\w+){HEAD}\{{"),
        ("Function", rf"^\s*{MOD}function\s+&?(?P<name>\w+)\s*{ARGS}(?:\s*:\s*(?P<ret>[^{{;\n]+))?"),
        ("Property", r"^\s*(?P<mods>(?:public|private|protected|static|readonly)\s+)+(?P<ret>\??[\w\\|]+\s+)?\$(?P<name>\w+)\s*[=;]"),
    )),
    "ruby": ("#", ("=begin", "=end"), "\"'", "colon", _rules(
        ("Module", r"^[ \t]*module\s+(?P<name>[\w:]+)"),
        ("Class", r"^[ \t]*class\s+(?P<name>[A-Z][\w:]*)(?P<head>[^\n;]*)"),
        ("Function", r"^[ \t]*def\s+(?:self\.)?(?P<name>\w+[?!=]?)(?:[ \t]*\((?P<params>[^)]*)\))?"),
        ("Const", r"^[ \t]*(?P<name>[A-Z][A-Z0-9_]+)\s*="),
    )),
}
GENERIC = ("// #", ("/*", "*/"), "\"'", "colon", _rules(
    ("Class", rf"^\s*{MOD}(?:class|struct|interface|trait|protocol|object)\s+(?P<name>\w+){HEAD}"),
    ("Function", rf"^\s*{MOD}(?:func|fun|fn|def|function|sub|proc)\s+(?P<name>\w+)\s*(?:{ARGS})?"),
))

# Words before a bracket that call nothing.
NOT_CALLS = frozenset(
    "if for while switch return catch else match when new throw typeof sizeof func function fn def fun await yield in and or not elif except with lambda print assert del raise class struct interface enum "
    "case select go defer chan map range var let const import super this self using lock foreach elsif unless until do loop where impl trait type union static_assert decltype alignof noexcept".split()
) - {"print", "map", "range"}
# Words that begin a statement where a definition could stand.
CONTROL = frozenset("if for while switch return catch else new throw await yield do try using lock foreach elsif unless until with super function".split())
CALL = re.compile(r"(?:(?P<receiver>[A-Za-z_$][\w$]*|\)|\])\s*(?:\.|->|::|\?\.|!!\.)\s*)?(?P<name>[A-Za-z_$][\w$]*[?!]?)\s*(?:::)?(?:<[\w, .:\[\]]*>)?\s*\(")
SPAWNS = {
    "go": r"\bgo\s+(?:(?P<receiver>\w+)\.)?(?P<name>\w+)\s*\(", "rust": r"\b(?:thread|tokio|task)::spawn\s*\(\s*(?:(?P<receiver>\w+)(?:\.|::))?(?P<name>\w+)\s*[(,)]", "javascript": r"\bnew\s+Worker\s*\(\s*(?P<receiver>)(?P<name>\w+)",
    "typescript": r"\bnew\s+Worker\s*\(\s*(?P<receiver>)(?P<name>\w+)", "java": r"\bnew\s+Thread\s*\(\s*(?:(?P<receiver>\w+)(?:::|\.))?(?P<name>\w+)", "kotlin": r"\b(?:launch|async)\s*(?:\([^)]*\))?\s*\{\s*(?:(?P<receiver>\w+)\.)?(?P<name>\w+)\s*\(",
    "csharp": r"\bTask\.Run\s*\(\s*(?:\(\)\s*=>\s*)?(?:(?P<receiver>\w+)\.)?(?P<name>\w+)", "cpp": r"\bstd::(?:thread|async)\s*(?:\w+)?\s*\(\s*&?(?:(?P<receiver>\w+)::)?(?P<name>\w+)", "swift": r"\bTask\s*\{\s*(?:await\s+)?(?:(?P<receiver>\w+)\.)?(?P<name>\w+)\s*\(",
    "ruby": r"\bThread\.new\s*\{\s*(?:(?P<receiver>\w+)\.)?(?P<name>\w+)",
}
IMPORTS = {
    "go": r"^\s*(?:import\s+)?(?:(?P<alias>[\w.]+)\s+)?[\"`](?P<source>[^\"`\n]+)[\"`]\s*$", "java": r"^\s*import\s+(?:static\s+)?(?P<source>[\w.*]+)\s*;", "kotlin": r"^\s*import\s+(?P<source>[\w.*]+)(?:\s+as\s+(?P<alias>\w+))?",
    "scala": r"^\s*import\s+(?P<source>[\w.*]+)", "csharp": r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:(?P<alias>\w+)\s*=\s*)?(?P<source>[\w.]+)\s*;", "rust": r"^\s*(?:pub\s+)?use\s+(?P<source>[\w:*]+)(?:\s+as\s+(?P<alias>\w+))?",
    "c": r"^\s*#\s*include\s*[\"<](?P<source>[^\">\n]+)[\">]", "cpp": r"^\s*#\s*include\s*[\"<](?P<source>[^\">\n]+)[\">]", "php": r"^\s*(?:use\s+(?P<source>[\w\\]+)(?:\s+as\s+(?P<alias>\w+))?\s*;|(?:require|include)(?:_once)?\s*\(?\s*(?:__DIR__\s*\.\s*)?[\"'](?P<file>[^\"'\n]+)[\"'])",
    "ruby": r"^\s*require(?:_relative)?\s*\(?\s*[\"'](?P<source>[^\"'\n]+)[\"']", "swift": r"^\s*(?:@\w+\s+)?import\s+(?:class\s+|struct\s+|func\s+)?(?P<source>[\w.]+)",
    "javascript": r"(?:\bimport\s+(?:type\s+)?(?P<what>[\w$*{}\s,]+?)\s+from\s*|\bimport\s*|\bexport\s+[\w*{}\s,]+\s+from\s*|(?:(?:const|let|var)\s+(?P<what2>[\w${}\s,:]+?)\s*=\s*)?\brequire\s*\(\s*)[\"'](?P<source>[^\"'\n]+)[\"']",
    "": r"^\s*(?:import|include|use|require|using|open)\s*[(\"'<]?\s*(?P<source>[\w./:\\-]+)",
}
IMPORTS["typescript"] = IMPORTS["javascript"]
BINDINGS = {
    "go": [r"\b(?P<name>\w+)\s*:?=\s*&?(?:\w+\.)?(?P<type>[A-Z]\w*)\s*\{", r"\b(?P<name>\w+)(?:\s*,\s*\w+)?\s*:?=\s*(?:\w+\.)?New(?P<type>[A-Z]\w*)\s*\(", r"\bvar\s+(?P<name>\w+)\s+\*?(?:\w+\.)?(?P<type>[A-Z]\w*)"],
    "": [r"\b(?P<name>\w+)\s*(?::[^=\n;]+)?=\s*(?:await\s+)?new\s+(?:\w+\.)*(?P<type>[A-Z]\w*)", r"\b(?:let|var|val|const)\s+(?:mut\s+)?(?P<name>\w+)\s*:\s*&?(?:mut\s+)?(?P<type>[A-Z]\w*)", r"\b(?:let|var|val|const)\s+(?:mut\s+)?(?P<name>\w+)\s*=\s*(?P<type>[A-Z]\w*)(?:::\w+|\.new)?\s*[({]", r"^\s*(?:final\s+)?(?P<type>[A-Z]\w*)(?:<[^>\n]*>)?[*&\s]+(?P<name>[a-z_]\w*)\s*[=;]", r"\b(?P<name>[a-z_]\w*)\s*=\s*(?P<type>[A-Z]\w*)\.new\b", r"\$(?P<name>\w+)\s*=\s*new\s+\\?(?:\w+\\)*(?P<type>\w+)"],
}
COPY = re.compile(r"\b(?:(?:let|var|val|const)\s+)?(?P<name>[a-z_]\w*)\s*:?=\s*(?P<from>[a-z_]\w*)\s*[;\n]")
ASSIGN = re.compile(r"\$?\b(?P<receiver>this|self|\w+)\s*(?:\.|->)\s*(?P<name>\w+)\s*(?:[-+*/|&%]|<<|>>)?=(?![=>])")


def _exported(lang: str, name: str, mods: str) -> bool:
    """Whether other files see a symbol, by the language's own rule."""
    if lang == "go":
        return name[:1].isupper()
    if lang in ("javascript", "typescript"):
        return "export" in mods or "public" in mods
    if lang == "rust":
        return "pub" in mods
    if lang in ("java", "csharp"):
        return "public" in mods
    if lang in ("kotlin", "scala", "php", "swift"):
        return "private" not in mods and ("protected" not in mods or lang == "kotlin") and "fileprivate" not in mods
    if lang in ("c", "cpp"):
        return "static" not in mods
    return not name.startswith("_")


def _heritage(lang: str, label: str, head: str, owner: str) -> Iterator[tuple[str, str]]:
    """(parent, extends or implements) of a type's header."""
    names = lambda s: [re.sub(r"<.*|\(.*|\[.*", "", x, flags=re.S).strip().split(".")[-1].split("\\")[-1].split("::")[-1] for x in re.split(r",|\bwith\b|&", re.sub(r"<[^<>]*>|\([^()]*\)", "", s))]
    if lang == "ruby":
        m = re.search(r"<\s*([\w:]+)", head)
        yield from ((n, "extends") for n in (names(m[1]) if m else []))
        return
    for word, kind in (("extends", "extends"), ("implements", "implements")):
        m = re.search(rf"\b{word}\b(.*?)(?=\bextends\b|\bimplements\b|\bpermits\b|\bwhere\b|$)", head, re.S)
        if m:
            for i, n in enumerate(names(m[1])):
                yield n, "implements" if lang == "scala" and i > 0 else kind
    if lang in ("csharp", "kotlin", "swift", "cpp"):
        m = re.search(r":(?!:)(.*)$", re.split(r"\bwhere\b", head)[0], re.S)
        for n in names(re.sub(r"\b(public|private|protected|virtual)\b", "", m[1])) if m else []:
            yield n, "implements" if lang == "csharp" and re.match(r"I[A-Z]", n) or label == "Struct" and lang == "swift" else "extends"


def _others(path: str, lang: str, text: str) -> Iterator[dict]:
    """Records of a file of any language but Python."""
    line_mark, block, quotes, order, rules = LANGUAGES.get(lang, GENERIC)
    code = blanked(text, line_mark, block, quotes)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line_of = lambda at: bisect_right(starts, at)

    def end_of(m: re.Match, label: str) -> int:
        if lang == "ruby":
            indent = re.match(r"[ \t]*", m[0])[0]
            e = re.compile(rf"^{indent}end\b", re.M).search(code, m.end())
            return e.end() if e and label in ("Class", "Module", "Function") else m.end()
        if label in ("Macro", "Const", "Variable", "Property", "Typedef", "Static", "Delegate"):
            return m.end()
        open_ = code.find("{", m.end() - 1 if m[0].endswith("{") else m.end())
        stop = re.compile(r"[;]|\n\s*\n").search(code, m.end())
        if m[0].endswith("{"):
            return matching(code, m.end() - 1)
        return matching(code, open_) if open_ >= 0 and (stop is None or open_ < stop.start()) and "}" not in code[m.end() : open_] else m.end()

    found: list[Found] = []
    taken: set[tuple[str, int]] = set()
    for label, rule in rules:
        for m in rule.finditer(code):
            g = m.groupdict()
            at = m.start("name")
            # The first rule of a name and place is the more specific one.
            if g["name"] in CONTROL and lang in ("java", "csharp", "c", "cpp", "javascript", "typescript") or (g["name"], line_of(at)) in taken:
                continue
            taken.add((g["name"], line_of(at)))
            mods = (g.get("mods") or "") + m[0][: at - m.start()]
            n, kinds = parameters(text[m.start("params") : m.end("params")], order) if g.get("params") is not None else (None, None)
            head = text[m.start("head") : m.end("head")] if g.get("head") is not None else ""
            first = m.start() + len(m[0]) - len(m[0].lstrip())
            row = {"signature": " ".join(text[first : m.end()].rstrip("{ \n\t").split()), "exported": _exported(lang, g["name"], mods), "parameterCount": n, "returnType": (g.get("ret") or "").strip() or None, "parameterTypes": kinds or None, "description": description_of(text, first), "head": head, "trait": g.get("trait"), "params": g.get("params"), "mods": mods}
            found.append(Found(label, g["name"], first, end_of(m, label), g.get("owner") or "", row))
    found.sort(key=lambda f: (f.start, -f.end))

    def enclosing(at: int, labels: frozenset[str], but: Found | None = None) -> Found | None:
        near = [f for f in found if f is not but and f.label in labels and f.start <= at < f.end]
        return min(near, key=lambda f: f.end - f.start, default=None)

    for f in found:
        outer = enclosing(f.start, TYPES | {"Module"} if lang == "ruby" else TYPES, f)
        if outer is not None and not f.owner:
            f.owner = outer.name
            if f.label == "Function":
                f.label = "Method"
        if f.label in ("Method", "Property") and not f.owner:
            f.label = "Function" if f.label == "Method" else "Variable"
    inside = lambda at: (lambda f: f"{f.owner}.{f.name}" if f and f.owner else f.name if f else "")(enclosing(at, FUNCTIONS))
    for f in found:
        if f.label in FUNCTIONS or f.label not in ("Variable", "Property") or enclosing(f.start, FUNCTIONS, f) is None:
            if f.label != "Impl":
                yield {"kind": "symbol", "name": f.name, "label": f.label, "owner": f.owner, "line": line_of(f.start), "endLine": line_of(max(f.start, f.end - 1)), **{k: v for k, v in f.row.items() if k not in ("head", "trait", "params", "mods")}}
        if f.row.get("trait"):
            yield {"kind": "heritage", "name": f.name, "other": f.row["trait"].split("::")[-1], "label": "implements", "line": line_of(f.start)}
        if f.label in TYPES:
            for parent, kind in _heritage(lang, f.label, f.row["head"], f.name):
                if re.fullmatch(r"\w+", parent or ""):
                    yield {"kind": "heritage", "name": f.name, "other": parent, "label": kind, "line": line_of(f.start)}
        # Parameters of a type's own header, and of a constructor that declares them, are its properties.
        if f.row.get("params") and (f.label in ("Class", "Record") or f.name == "constructor"):
            for p in re.finditer(r"(?:\b(va[lr]|public|private|protected|readonly)\s+)?(?:(\w+)\s*[?]?:\s*([\w<>\[\]?.]+)|([\w<>\[\]]+)\s+(\w+))", f.row["params"]):
                if f.label == "Record" or lang == "scala" and "case" in f.row["mods"] or p[1]:
                    yield {"kind": "symbol", "name": p[2] or p[5], "label": "Property", "owner": f.owner if f.name == "constructor" else f.name, "line": line_of(f.start), "endLine": line_of(f.start), "returnType": p[3] or p[4], "exported": p[1] not in ("private", "protected")}
    # Methods that a Go interface names belong to it.
    for f in (x for x in found if lang == "go" and x.label == "Interface"):
        for m in re.finditer(rf"^\s*(?P<name>\w+){ARGS}[ \t]*(?P<ret>[^\n{{]*)$", code[f.start : f.end], re.M):
            n, kinds = parameters(m["params"], order)
            yield {"kind": "symbol", "name": m["name"], "label": "Method", "owner": f.name, "line": line_of(f.start + m.start("name")), "endLine": line_of(f.start + m.end()), "signature": m[0].strip(), "exported": m["name"][:1].isupper(), "parameterCount": n, "parameterTypes": kinds or None, "returnType": m["ret"].strip() or None}
    block_of = [(m.start(), m.end()) for m in re.finditer(r"^import\s*\([^)]*\)", text, re.M)] if lang == "go" else []
    for m in re.finditer(IMPORTS.get(lang, IMPORTS[""]), text, re.M):
        g = m.groupdict()
        source = g.get("source") or g.get("file")
        at = m.start("source") if g.get("source") else m.start("file")
        if lang == "go" and not m[0].lstrip().startswith("import") and not any(a < at < b for a, b in block_of):
            continue
        if code[m.start() : at].strip() == "" and lang not in ("go",):
            continue  # in a comment
        what = g.get("what") or g.get("what2") or ""
        names = [(x[1] or x[0], x[0]) for x in re.findall(r"(\w+)(?:\s*(?:as|:)\s+(\w+))?", what) if x[0] not in ("type", "as")] if what else []
        if not names:
            last = re.split(r"[./:\\]", re.sub(r"[.:\\]\*$|/v\d+$", "", source))[-1]
            names = [(g.get("alias") or last, last)]
        for alias, original in names:
            yield {"kind": "import", "name": source, "receiver": alias, "other": original, "line": line_of(at)}
    if lang == "ruby":
        for m in re.finditer(r"^\s*(include|extend|prepend|attr_accessor|attr_reader|attr_writer)\s+(.+)$", code, re.M):
            owner = enclosing(m.start(2), frozenset(("Class", "Module")))
            for x in re.findall(r":?([\w:]+)", m[2]) if owner else []:
                if m[1].startswith("attr"):
                    yield {"kind": "symbol", "name": x.strip(":"), "label": "Property", "owner": owner.name, "line": line_of(m.start(2)), "endLine": line_of(m.start(2)), "exported": True}
                else:
                    yield {"kind": "heritage", "name": owner.name, "other": x.split("::")[-1], "label": "implements", "line": line_of(m.start(2))}
    names_at = {f.start + (code[f.start : f.end].find(f.name)) for f in found if f.label in FUNCTIONS}
    spawned: set[int] = set()
    for m in re.finditer(SPAWNS[lang], code) if lang in SPAWNS else []:
        spawned.add(m.start("name"))
        yield {"kind": "spawn", "name": m["name"], "receiver": m["receiver"] or "", "owner": inside(m.start()), "line": line_of(m.start())}
    for m in CALL.finditer(code):
        at = m.start("name")
        if m["name"] in NOT_CALLS or at in spawned or at in names_at or re.search(r"\b(func|function|def|fn|fun|sub|class|define)\s+$", code[max(0, at - 20) : at]):
            continue
        receiver = m["receiver"] if m["receiver"] not in (None, ")", "]") else ""
        yield {"kind": "call", "name": m["name"], "receiver": receiver, "owner": inside(at), "line": line_of(at)}
        close = matching(code, m.end() - 1, "()")
        for x in re.finditer(r"[(,]\s*&?(?:(?P<receiver>\w+)(?:\.|::))?(?P<name>[A-Za-z_]\w*)\s*(?=[,)])", code[m.end() - 1 : close]) if close - m.end() < 400 else []:
            yield {"kind": "delegate", "name": x["name"], "receiver": x["receiver"] or "", "owner": inside(at), "line": line_of(m.end() - 1 + x.start("name"))}
    if lang in ("kotlin", "scala"):
        for m in re.finditer(r"\b(?P<receiver>[a-z]\w*)[ \t]+(?P<name>[a-z]\w*)[ \t]+(?=[\w(\"])", code):
            if not {m["receiver"], m["name"]} & (NOT_CALLS | {"val", "private", "public", "override", "extends", "package", "object", "protected", "is", "to", "as", "by", "internal", "open", "data", "abstract", "sealed", "final", "lazy", "implicit", "null", "true", "false"}):
                yield {"kind": "call", "name": m["name"], "receiver": m["receiver"], "owner": inside(m.start("name")), "line": line_of(m.start("name"))}
    types: dict[tuple[str, str], str] = {}
    for f in found:
        for p in (f.row.get("parameterTypes") or "").split(", ") if f.label in FUNCTIONS else []:
            name, _, kind = p.partition(":")
            kind = re.sub(r"^[*&\[\]?]+|^(mut|dyn|const)\s+|<.*|[?*&]+$", "", kind.strip()).split(".")[-1].split("::")[-1].strip()
            if re.fullmatch(r"[A-Z]\w*", kind):
                types.setdefault((f"{f.owner}.{f.name}" if f.owner else f.name, name), kind)
    for rule in BINDINGS.get(lang, BINDINGS[""]):
        for m in re.finditer(rule, code, re.M):
            types.setdefault((inside(m.start("name")), m["name"]), m["type"])
    for f in found:
        if lang == "go" and f.label == "Method":
            m = re.match(r"func\s*\(\s*(\w+)\s", code[f.start :])
            if m:
                types.setdefault((f"{f.owner}.{f.name}", m[1]), f.owner)
    for m in COPY.finditer(code):
        scope = inside(m.start())
        if (scope, m["from"]) in types:
            types.setdefault((scope, m["name"]), types[scope, m["from"]])
    for (scope, name), kind in types.items():
        yield {"kind": "binding", "name": name, "other": kind, "owner": scope, "line": 0}
    for m in ASSIGN.finditer(code):
        yield {"kind": "assignment", "name": m["name"], "receiver": m["receiver"], "owner": inside(m.start()), "line": line_of(m.start())}


# Python


class _Python(ast.NodeVisitor):
    """Records of a Python file, by its syntax tree."""

    def __init__(self, text: str) -> None:
        self.rows: list[dict] = []
        self.lines = text.splitlines()
        self.owners: list[str] = []
        self.scope: list[str] = []
        self.types: dict[tuple[str, str], str] = {}

    @property
    def inside(self) -> str:
        return self.scope[-1] if self.scope else ""

    def add(self, kind: str, node: ast.AST | None, **row) -> None:
        self.rows.append({"kind": kind, "line": getattr(node, "lineno", 0), **row})

    @staticmethod
    def name_of(e: ast.AST | None) -> str:
        while isinstance(e, ast.Subscript):
            e = e.value
        return e.id if isinstance(e, ast.Name) else e.attr if isinstance(e, ast.Attribute) else e.value if isinstance(e, ast.Constant) and isinstance(e.value, str) else ""

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("import", node, name=a.name, receiver=a.asname or a.name.split(".")[0], other=a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        source = "." * node.level + (node.module or "")
        for a in node.names:
            self.add("import", node, name=source if node.module else source + a.name, receiver=a.asname or a.name, other=a.name)
            if node.module and a.name != "*":
                # The name may be a module of the package.
                self.add("import", node, name=f"{source}.{a.name}", receiver=a.asname or a.name, other=a.name)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.add("symbol", node, name=node.name, label="Class", owner=".".join(self.owners), endLine=node.end_lineno, signature=self.lines[node.lineno - 1].strip().rstrip(":"), exported=not node.name.startswith("_"), description=ast.get_docstring(node))
        for b in node.bases:
            if self.name_of(b):
                self.add("heritage", node, name=node.name, other=self.name_of(b), label="extends")
        self.owners.append(node.name)
        for x in node.body:
            if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
                self.add("symbol", x, name=x.target.id, label="Property", owner=node.name, endLine=x.end_lineno, returnType=ast.unparse(x.annotation), exported=not x.target.id.startswith("_"))
        self.generic_visit(node)
        self.owners.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        owner = self.owners[-1] if self.owners else ""
        args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
        args = args[1:] if owner and args and args[0].arg in ("self", "cls") else args
        kinds = ", ".join(f"{a.arg}:{ast.unparse(a.annotation)}" if a.annotation else a.arg for a in args)
        self.add("symbol", node, name=node.name, label="Method" if owner else "Function", owner=owner, endLine=node.end_lineno, signature=self.lines[node.lineno - 1].strip().rstrip(":"), exported=not node.name.startswith("_"), parameterCount=len(args), parameterTypes=kinds or None, returnType=ast.unparse(node.returns) if node.returns else None, description=ast.get_docstring(node))
        for d in node.decorator_list:
            self.visit(d)
        self.scope.append(f"{owner}.{node.name}" if owner else node.name)
        owners, self.owners = self.owners, []
        for a in args:
            if a.annotation and self.name_of(a.annotation):
                self.bind(a.arg, self.name_of(a.annotation))
        if owner:
            self.bind("self", owner)
        for x in [*node.args.defaults, *node.body]:
            self.visit(x)
        self.owners = owners
        self.scope.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def bind(self, name: str, kind: str) -> None:
        self.types.setdefault((self.inside, name), kind)

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            self.assigned(t, node.value, node)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if isinstance(node.target, ast.Name) and self.name_of(node.annotation):
            self.bind(node.target.id, self.name_of(node.annotation))
        self.assigned(node.target, node.value, node)
        self.generic_visit(node)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        self.assigned(node.target, None, node)
        self.generic_visit(node)

    def assigned(self, t: ast.AST, value: ast.AST | None, node: ast.AST) -> None:
        if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name):
            self.add("assignment", node, name=t.attr, receiver=t.value.id, owner=self.inside)
        if isinstance(t, ast.Name):
            if isinstance(value, ast.Call) and self.name_of(value.func)[:1].isupper():
                self.bind(t.id, self.name_of(value.func))
            elif isinstance(value, ast.Name) and (self.inside, value.id) in self.types:
                self.bind(t.id, self.types[self.inside, value.id])
            if not self.scope and not self.owners and t.id.isupper():
                self.add("symbol", node, name=t.id, label="Const", owner="", endLine=getattr(node, "end_lineno", None), exported=not t.id.startswith("_"))

    def visit_Call(self, node: ast.Call) -> None:
        name = self.name_of(node.func) if isinstance(node.func, ast.Name | ast.Attribute) else ""
        receiver = node.func.value.id if isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name) else ""
        target = next((k.value for k in node.keywords if k.arg == "target"), None)
        if name:
            self.add("call", node, name=name, receiver=receiver, owner=self.inside)
        spawned = target if name in ("Thread", "Process") and target is not None else node.args[0] if name in ("submit", "create_task", "apply_async") and node.args else None
        if isinstance(spawned, ast.Call):
            spawned = spawned.func
        if isinstance(spawned, ast.Name | ast.Attribute):
            self.add("spawn", node, name=self.name_of(spawned), receiver=spawned.value.id if isinstance(spawned, ast.Attribute) and isinstance(spawned.value, ast.Name) else "", owner=self.inside)
        for a in [*node.args, *(k.value for k in node.keywords)]:
            if a is not spawned and isinstance(a, ast.Name | ast.Attribute):
                self.add("delegate", node, name=self.name_of(a), receiver=a.value.id if isinstance(a, ast.Attribute) and isinstance(a.value, ast.Name) else "", owner=self.inside)
        self.generic_visit(node)


def _python(path: str, text: str) -> Iterator[dict]:
    v = _Python(text)
    v.visit(ast.parse(text))
    yield from v.rows
    for (scope, name), kind in v.types.items():
        yield {"kind": "binding", "name": name, "other": kind, "owner": scope, "line": 0}


def records_of(path: str, lang: str, text: str) -> list[dict]:
    """All records of one file, in order of place."""
    if len(text) > MAX_CHARS:
        return [{"kind": "error", "name": "file is too large", "line": 0}]
    try:
        rows = list(_python(path, text) if lang == "python" else _others(path, lang, text))
    except (SyntaxError, ValueError, RecursionError) as e:
        return [{"kind": "error", "name": f"{type(e).__name__}: {e}", "line": getattr(e, "lineno", 0) or 0}]
    return sorted(rows, key=lambda r: (r["kind"], r["line"], r.get("name") or "", r.get("owner") or ""))


def extract(files: DataFrame) -> DataFrame:
    """Records of all files (filePath, content); a task takes its largest files first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, lang, text in zip(batch["filePath"], batch["language"], batch["content"]):
                for r in records_of(path, lang, text):
                    rows.append([path, lang, *(r.get(c) for c in COLUMNS[2:])])
            out = pd.DataFrame(rows, columns=COLUMNS)
            yield out.astype({"line": "Int32", "endLine": "Int32", "parameterCount": "Int32", "exported": "boolean"})

    known = files.filter("filePath is not null and content is not null").select("filePath", language(F.col("filePath")).alias("language"), "content")
    return known.filter("language <> ''").sortWithinPartitions(F.desc(F.length("content")), "filePath").mapInPandas(run, RECORD)
