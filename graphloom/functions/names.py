"""Column functions over node ids (`file::Owner.name(types)`), labels and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.payload import ColumnLike, _c

#: Extensions of C and C++ files, compared as they are written.
C_EXTENSIONS = (".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hxx", ".c++")
#: Visibilities of entry points, and functions without a name of their own.
ENTRY = ("public", "external")
SPECIAL = ("constructor", "fallback", "receive")


def without_parameters(name: Column) -> Column:
    """Cut from the first parenthesis on, unless it is the first character."""
    at = F.instr(name, "(")
    return F.when(at > 1, F.substring(name, F.lit(1), at - 1)).otherwise(name)


def qualified_label(node_id: ColumnLike) -> Column:
    """The id without file and parameters, its last two parts at most."""
    node_id = _c(node_id)
    parts = F.split(node_id, "::")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
    last = F.concat(F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0))), F.array(without_parameters(F.element_at(rest, -1))))
    kept = F.slice(last, F.greatest(F.size(last) - 1, F.lit(1)), 2)
    return F.when(F.size(parts) < 2, node_id).otherwise(F.array_join(kept, "::"))


def short_variable(node_id: ColumnLike) -> Column:
    return F.substring_index(F.substring_index(_c(node_id), "::", -1), ".", -1)


def contract_key(node_id: ColumnLike) -> Column:
    """The file and the owner before the first dot of the second part; null where there is none."""
    parts = F.split(_c(node_id), "::")
    return F.when(F.size(parts) > 1, F.concat(parts[0], F.lit("::"), F.substring_index(F.get(parts, 1), ".", 1)))


def parent_id(node_id: ColumnLike) -> Column:
    """The file and all that stands before the first dot after it; empty where there is no file."""
    node_id = _c(node_id)
    at = F.instr(node_id, "::")
    rest = F.substring(node_id, at + 2, F.length(node_id))
    return F.when(at > 0, F.concat(F.substring(node_id, F.lit(1), at + 1), F.substring_index(rest, ".", 1))).otherwise("")


def bare_id(node_id: ColumnLike) -> Column:
    return without_parameters(_c(node_id))


def extension(path: ColumnLike) -> Column:
    """The last dot of the file name and what follows; empty where there is none or only a leading one."""
    return F.regexp_extract(F.substring_index(_c(path), "/", -1), r"[^.].*?(\.[^.]*)$", 1)


def is_c_file(path: ColumnLike) -> Column:
    return extension(path).isin(*C_EXTENSIONS)


def like(column: ColumnLike, text: str) -> Column:
    """Contains the text, whose % and _ are wildcards, whatever the case of ASCII letters."""
    escape = "\x01"
    return F.expr(f"lower({_name(column)}) LIKE lower({_literal('%' + text + '%')}) ESCAPE '{escape}'")


def _name(column: ColumnLike) -> str:
    return ".".join(f"`{p}`" for p in column.split(".")) if isinstance(column, str) else column._jc.toString()


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def has_parameters(signature: ColumnLike) -> Column:
    """A pair of parentheses with something between, by the first of each."""
    s = F.coalesce(_c(signature), F.lit(""))
    return (F.instr(s, "(") > 0) & (F.instr(s, ")") > F.instr(s, "(") + 1)


def is_entry(visibility: ColumnLike = "visibility") -> Column:
    return _c(visibility).isin(*ENTRY)


def name_tokens(name: ColumnLike) -> Column:
    """The lower-case parts of a snake_case, kebab-case or CamelCase name."""
    parts = F.split(_c(name), "[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
    return F.array_distinct(F.transform(F.filter(parts, lambda x: x != ""), F.lower))


def path_hint(path: ColumnLike, hint: str) -> Column:
    """Some segment of the path is the hint, or begins or ends with it and - or _."""
    p = F.lit(hint.lower())
    return F.exists(F.split(F.lower(_c(path)), "/"), lambda s: (s == p) | s.startswith(f"{hint.lower()}-") | s.startswith(f"{hint.lower()}_") | s.endswith(f"-{hint.lower()}") | s.endswith(f"_{hint.lower()}"))


def repository_path(uri: ColumnLike, root: str = "") -> Column:
    """A file URI or path, with forward slashes, relative to root."""
    p = F.regexp_replace(F.translate(_c(uri), "\\", "/"), "^file://(localhost)?", "")
    if root:
        p = F.when(p.startswith(root.rstrip("/") + "/"), F.substring(p, F.lit(len(root.rstrip("/")) + 2), F.length(p))).otherwise(p)
    return F.regexp_replace(p, r"^(\./)+", "")
