"""Escapers of the text renderers (driver side: results are bounded before they get here)."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First characters that spreadsheets read as formulas.
FORMULA_STARTS = "=+-@\t\r\n"


def json_text(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def dot(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r") + '"'


def d2(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("$", "\\$") + '"'


def mermaid(text: str) -> str:
    """Quoted label; what Mermaid would read as markup becomes numeric references."""
    return '"' + "".join(f"#{ord(c)};" if c in '"#<>&[]{}|`\n\r' else c for c in text) + '"'


def html_text(text: str) -> str:
    return html.escape(text, quote=True)


def neutral_csv(value: Column) -> Column:
    """A cell that would start a formula is led by an apostrophe."""
    return F.when(value.rlike(r"\A[=+\-@\t\r\n]"), F.concat(F.lit("'"), value)).otherwise(value)
