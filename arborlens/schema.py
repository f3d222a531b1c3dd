"""The closed schema of the property graph: four node tables and one typed edge table."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "long": T.LongType(), "boolean": T.BooleanType()}


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in text.split(", "))])


#: The columns of the tables, in their order.
FILES = _struct("path string, hash string, last_modified long")
FUNCTIONS = _struct("id string, name string, file_path string, start_line long, end_line long, docstring string, is_exported boolean, ast_hash string")
CLASSES = _struct("id string, name string, file_path string, docstring string, type_category string, ast_hash string")
VARIABLES = _struct("id string, name string, file_path string, type_hint string")
EDGES = _struct("src string, src_type string, dst string, dst_type string, label string")
TABLES = {"files": FILES, "functions": FUNCTIONS, "classes": CLASSES, "variables": VARIABLES, "edges": EDGES}

#: Every legal (label, source type, target type).
ALLOWED = (
    ("CALLS", "Function", "Function"),
    ("IMPORTS", "File", "File"), ("IMPORTS", "File", "Class"), ("IMPORTS", "File", "Function"), ("IMPORTS", "File", "Variable"),
    ("CONTAINS", "File", "Function"), ("CONTAINS", "File", "Class"), ("CONTAINS", "File", "Variable"),
    ("CONTAINS", "Class", "Function"), ("CONTAINS", "Class", "Variable"),
    ("IMPLEMENTS", "Class", "Class"),
)
#: The extensions of source files, in the order in which an import tries them.
EXTENSIONS = (".go", ".py", ".js", ".jsx", ".ts", ".tsx", ".java")
CONFIG_DIR, IGNORE_FILE, RULES_FILE = ".arborlens", ".arborignore", "boundaries.json"
