"""A Markdown report of a build from its small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

MISSING = "NOT YET MEASURED"


def markdown_table(df: DataFrame | None, most: int = 200) -> str:
    """Up to `most` rows of a small table; a placeholder where there is none."""
    if df is None:
        return MISSING
    rows = df.limit(most).collect()
    lines = [" | ".join(df.columns), "|".join("-" for _ in df.columns)] + [" | ".join("" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v) for v in r) for r in rows]
    return "\n".join(f"| {x} |" if "|-" not in x and x != "-" else f"|{x}|" for x in lines)


def report(title: str, sections: dict[str, DataFrame | dict | None]) -> str:
    """Sections of tables or of named values, in order."""
    out = [f"# {title}"]
    for name, content in sections.items():
        out.append(f"## {name}")
        if isinstance(content, dict):
            out.append("\n".join(f"- {k}: {MISSING if v is None else f'{v:,}' if isinstance(v, (int, float)) and not isinstance(v, bool) else v}" for k, v in content.items()) or MISSING)
        else:
            out.append(markdown_table(content))
    return "\n\n".join(out) + "\n"
