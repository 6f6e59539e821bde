"""Source files as declarations and references: Python by its syntax tree, others by a scanner."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.folders import written

DECLARATIONS = "path string, id string, entity_type string, name string, line int, place int, source_text string"
REFERENCES = "path string, kind string, name string, line int, col int, enclosing string"


@dataclass(frozen=True)
class Found:
    declarations: list[tuple[str, str, int, str]]
    #: (kind, name, line from 0, column from 0, enclosing function or None)
    references: list[tuple[str, str, int, int, str | None]]


def python(text: str) -> Found:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return Found([], [])
    declared: list = []
    used: list = []
    todo: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while todo:
        node, inside = todo.pop()
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            kind = "Class" if isinstance(node, ast.ClassDef) else "Function"
            declared.append((kind, node.name, node.lineno, ast.get_source_segment(text, node) or ""))
            inside = node.name
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                used.append(("CALLS", f.id, f.lineno - 1, f.col_offset, inside))
            elif isinstance(f, ast.Attribute):
                used.append(("CALLS", f.attr, f.end_lineno - 1, f.end_col_offset - len(f.attr), inside))
        elif isinstance(node, ast.Import | ast.ImportFrom):
            names = [a.name for a in node.names if not a.asname and a.name != "*"]
            if isinstance(node, ast.ImportFrom) and node.module:
                names.insert(0, node.module)
            used += [("IMPORTS", n, node.lineno - 1, node.col_offset, None) for n in names]
        todo += [(child, inside) for child in ast.iter_child_nodes(node)]
    return Found(sorted(declared, key=lambda d: d[2]), sorted(used, key=lambda r: r[2:4]))


_BLANKS = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_RUST_BLANKS = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.S)
_WORDS_NO_CALL = {"if", "for", "while", "switch", "catch", "function", "return", "match", "fn", "loop", "typeof", "super", "await", "new", "constructor", "import"}


def _blanked(text: str, pattern: re.Pattern) -> str:
    """Comments and strings as blanks, so that places stay."""
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _body_end(code: str, at: int) -> int:
    """End of the block that opens at or after `at`, or of the statement if none does before `;`."""
    depth = 0
    for m in re.compile(r"[{};]").finditer(code, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.end() if depth == 0 else m.start()
        elif depth == 0:
            return m.end()
    return len(code)


def _scan(text: str, blanks: re.Pattern, classes: str, functions: list[str], calls: str, imports: Callable[[str], list[tuple[str, int]]]) -> Found:
    code = _blanked(text, blanks)
    spans = []
    for kind, patterns in (("Class", [classes]), ("Function", functions)):
        for p in patterns:
            for m in re.finditer(p, code, re.M):
                if m["name"] not in _WORDS_NO_CALL:
                    spans.append((m.start("decl"), _body_end(code, m.end()), kind, m["name"]))
    spans.sort()

    def place(at: int) -> tuple[int, int]:
        return code.count("\n", 0, at), at - (code.rfind("\n", 0, at) + 1)

    def around(at: int) -> str | None:
        return next((s[3] for s in reversed(spans) if s[0] <= at < s[1] and s[2] == "Function"), None)

    declared = [(k, n, place(a)[0] + 1, text[a:b].rstrip(";")) for a, b, k, n in spans]
    heads = {a for a, *_ in spans}
    used = [("IMPORTS", n, *place(at), None) for n, at in imports(code if blanks is _RUST_BLANKS else code)]
    for m in re.finditer(calls, code):
        last = re.split(r"::", m["name"])[-1]
        if last not in _WORDS_NO_CALL and not any(a <= m.start() < a + 200 and code[a : m.start("name")].strip() in ("", "fn", "pub fn", "async", "function", "async function") for a in heads):
            used.append(("CALLS", m["name"], *place(m.start("name")), around(m.start())))
    return Found(declared, sorted(used, key=lambda r: r[2:4]))


def _ts_imports(code: str) -> list[tuple[str, int]]:
    out = []
    for m in re.finditer(r"^\s*import\s+(?:type\s+)?([^;\n]*?(?:\{[^}]*\})?[^;\n]*?)\s+from\b", code, re.M):
        for n in re.finditer(r"\{([^}]*)\}|(?<![\w*{,]\s)\b([A-Za-z_$][\w$]*)", m[1]):
            names = [x.strip().split(" as ")[0].strip() for x in n[1].split(",")] if n[1] is not None else [n[2]]
            out += [(x, m.start(1) + n.start()) for x in names if x and x not in ("as", "type")]
    return out


def typescript(text: str) -> Found:
    name = r"(?P<name>[A-Za-z_$][\w$]*)"
    functions = [
        rf"(?P<decl>(?:async\s+)?function\s*\*?\s*{name})\s*[(<]",
        rf"(?:const|let|var)\s+(?P<decl>{name})\s*(?::[^=\n]*)?=\s*(?:async\s*)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=\n{{]*)?=>|[\w$]+\s*=>)",
        rf"^[ \t]+(?P<decl>(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*{name})\s*(?:<[^>\n]*>)?\([^;\n]*\)\s*(?::[^;{{\n]*)?(?=\{{)",
    ]
    return _scan(text, _BLANKS, rf"(?P<decl>(?:abstract\s+)?class\s+{name})", functions, r"(?<![\w$])(?P<name>[A-Za-z_$][\w$]*)\s*\(", _ts_imports)


def rust(text: str) -> Found:
    name = r"(?P<name>[A-Za-z_]\w*)"

    def imports(code: str) -> list[tuple[str, int]]:
        return [(m[1].strip(), m.start(1)) for m in re.finditer(r"^\s*(?:pub\s+)?use\s+([\w:]+)\s*;", code, re.M)]

    visible = r"(?:pub(?:\([^)]*\))?\s+)?"
    functions = [rf"(?P<decl>{visible}(?:(?:async|const|unsafe|extern)\s+)*fn\s+{name})"]
    return _scan(text, _RUST_BLANKS, rf"(?P<decl>{visible}(?:struct|enum|trait)\s+{name})", functions, r"(?<!\w)(?P<name>(?:[A-Za-z_]\w*::)*[A-Za-z_]\w*)\s*\(", imports)


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    parse: Callable[[str], Found]


#: Languages and their file extensions.
LANGUAGES = (
    Language("TypeScript", ("ts", "tsx", "js", "jsx"), typescript),
    Language("Python", ("py",), python),
    Language("Rust", ("rs",), rust),
)
_BY_EXTENSION = {e: lang for lang in LANGUAGES for e in lang.extensions}


def languages(spark: SparkSession) -> DataFrame:
    """(name, extensions) of what can be parsed."""
    return spark.createDataFrame([(x.name, list(x.extensions)) for x in LANGUAGES], "name string, extensions array<string>")


def _parse(path: str, text: str | None) -> Found:
    lang = _BY_EXTENSION.get(path.rpartition(".")[2])
    return lang.parse(text or "") if lang else Found([], [])


def declarations(files: DataFrame) -> DataFrame:
    """`DECLARATIONS` of `files` (path, content): ids are path:name, place is their order in the file;
    files of no known language give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, f"{p}:{n}", k, n, line, at, src) for p, t in zip(pdf["path"], pdf["content"], strict=True) for at, (k, n, line, src) in enumerate(_parse(p, t).declarations)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DECLARATIONS.split(", ")])

    return files.select("path", "content").mapInPandas(run, DECLARATIONS)


def references(files: DataFrame) -> DataFrame:
    """`REFERENCES` of `files`: pending until `resolve` finds what they mean."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *r) for p, t in zip(pdf["path"], pdf["content"], strict=True) for r in _parse(p, t).references]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REFERENCES.split(", ")])

    return files.select("path", "content").mapInPandas(run, REFERENCES)


def asked(refs: DataFrame) -> DataFrame:
    """(path, kind, name, from_id) of `REFERENCES`: by the last part of the name, from what encloses it."""
    last = F.regexp_extract("name", r"([^:.]+)$", 1)
    sender = F.when(F.col("enclosing").isNull(), F.col("path")).otherwise(F.concat("path", F.lit(":"), "enclosing"))
    return refs.select("path", "kind", last.alias("name"), sender.alias("from_id")).distinct()


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "[^/]*$", "")


#: Declarations of a name that references meet in one row.
FEW = 64


def answered(refs: DataFrame, declared: DataFrame, **more: Column) -> DataFrame:
    """`refs` (path, kind, name, from_id) with to_id of the declaration (id, name, path) that answers each, else
    null, and with `more`, columns of `refs` by name. It is written.

    The nearest counts: of the same file, else of the same folder, else any; where the nearest are
    several, a reference has no answer. References are dealt by name once, and each meets its name's
    declarations as one row. A name that has more than a few is looked up by place (`_by_place`) instead, so
    that a common one never meets all its declarations.
    """
    first = declared.select("id", "name", "path").withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("id"))).where(F.col("k") <= FEW + 1)
    rows = first.groupBy("name").agg(F.collect_list(F.struct("path", _folder(F.col("path")).alias("folder"), "id")).alias("all"))
    asking = refs.select("path", "kind", "name", "from_id", *[c.alias(k) for k, c in more.items()], _folder(F.col("path")).alias("folder")).join(rows, "name", "left")
    same_file, same_folder = F.filter("all", lambda x: x["path"] == F.col("path")), F.filter("all", lambda x: x["folder"] == F.col("folder"))
    near = F.when(F.size(same_file) > 0, same_file).when(F.size(same_folder) > 0, same_folder).otherwise(F.col("all"))["id"]
    many = F.coalesce(F.size("all") > FEW, F.lit(False))
    kept = ["path", "kind", "name", "from_id", *more]
    found = asking.select(*kept, "all", F.inline(F.array(F.struct(many.alias("many"), F.when(~many, near).alias("near")))))
    out = written(found.select(*kept, F.when(F.array_min("near") == F.array_max("near"), F.array_min("near")).alias("to_id"), "many"), "answered")
    rest = out.where("many")
    few = out.where("not many").drop("many")
    return few if rest.isEmpty() else written(few.unionByName(_by_place(rest.select(*kept), declared)), "answered")


def _by_place(refs: DataFrame, declared: DataFrame) -> DataFrame:
    """`refs` with to_id; declarations are brought to one row a name and place first."""
    names = refs.select("name").distinct()
    known = declared.join(names, "name", "left_semi").select("name", F.col("path").alias("near_0"), _folder(F.col("path")).alias("near_1"), F.lit("").alias("near_2"), "id")
    found = refs.withColumns({"near_0": F.col("path"), "near_1": _folder(F.col("path")), "near_2": F.lit("")})
    for level in range(3):
        near, least, most = (f"{x}_{level}" for x in ("near", "least", "most"))
        found = found.join(known.groupBy("name", near).agg(F.min("id").alias(least), F.max("id").alias(most)), ["name", near], "left")
    least, most = (F.coalesce(*[F.col(f"{x}_{level}") for level in range(3)]) for x in ("least", "most"))
    return found.select(*refs.columns, F.when(least == most, least).alias("to_id"))


def nearest(refs: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, kind, name, from_id, to_id) of `refs` that are `answered`."""
    return answered(refs, declared).where("to_id is not null")


def links(found: DataFrame) -> DataFrame:
    """(from_id, to_id, relationship, properties) of answered references."""
    return found.select("from_id", "to_id", F.col("kind").alias("relationship"), F.to_json(F.struct(F.lit("name").alias("resolver"))).alias("properties")).distinct()


def resolve(refs: DataFrame, declared: DataFrame) -> DataFrame:
    """(from_id, to_id, relationship, properties): references joined by name with declarations (id, name,
    path). It stands in for a language server, which this engine does not run."""
    return links(nearest(asked(refs), declared))
