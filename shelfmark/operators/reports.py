"""Reports on the driver: small frames of metrics as Markdown or as plain text, and a journal that keeps both."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.sources.sinks import save_text

#: Sections of the diagnostics, in order, by the letter of their heading.
SECTIONS = {
    "A": "Sources",
    "B": "Schema and keys",
    "C": "Missing values",
    "D": "Duplicates",
    "E": "Ratings and times",
    "F": "Text quality",
    "G": "Join quality",
    "H": "Cleaning",
    "I": "Split",
}


def percent(share: float | None, places: int = 2) -> str:
    return "-" if share is None else f"{100 * share:.{places}f} %"


def number(value: object) -> str:
    """Whole numbers with thousands apart, others to four places, nothing for null, lists by commas."""
    if value is None:
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, int):
        return f"{value:,}"
    if isinstance(value, float):
        return f"{value:,.4f}".rstrip("0").rstrip(".")
    return ", ".join(map(str, value)) if isinstance(value, list | tuple) else str(value)


def rows_of(df: DataFrame, most: int = 200) -> tuple[list[str], list[list[str]], bool]:
    """Columns, rows as text, and whether more rows were left out; a report is read by people."""
    found = df.limit(most + 1).collect()
    return df.columns, [[number(v) for v in r] for r in found[:most]], len(found) > most


def markdown(df: DataFrame, most: int = 200) -> str:
    names, rows, more = rows_of(df, most)
    escape = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    lines = [escape(names), "|" + " --- |" * len(names), *map(escape, rows)]
    return "\n".join(lines + (["", f"Only the first {most} rows are shown."] if more else []))


def plain(df: DataFrame, most: int = 20) -> str:
    names, rows, more = rows_of(df, most)
    widths = [max(len(r[i]) for r in [names, *rows]) for i in range(len(names))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in [names, *rows]]
    return "\n".join(lines + (["..."] if more else []))


def diagnostics(title: str, sections: dict[str, Iterable[tuple[str, DataFrame]]]) -> str:
    """Markdown with a heading for each section letter and a table for each named frame in it; sections without frames say so."""
    out = [f"# {title}"]
    for letter, name in SECTIONS.items():
        frames = list(sections.get(letter, ()))
        out += ["", f"## {letter}. {name}"] + ([] if frames else ["", "Nothing to report."])
        for heading, df in frames:
            out += ["", f"### {heading}", "", markdown(df)]
    return "\n".join(out) + "\n"


def console(sections: dict[str, Iterable[tuple[str, DataFrame]]]) -> str:
    """The same for a terminal."""
    out = []
    for letter, name in SECTIONS.items():
        for heading, df in sections.get(letter, ()):
            out += ["", f"[{letter}. {name}] {heading}", plain(df)]
    return "\n".join(out).lstrip("\n")


class Journal:
    """Lines and tables in the order they were noted, as plain text and as Markdown."""

    def __init__(self, title: str):
        self.title, self.notes = title, []

    def log(self, line: str) -> Journal:
        self.notes.append((line, line))
        return self

    def add_table(self, name: str, df: DataFrame, most: int = 20) -> Journal:
        self.notes.append((f"{name}\n{plain(df, most)}", f"**{name}**\n\n{markdown(df, most)}"))
        return self

    def to_text(self) -> str:
        return "\n".join(t for t, _ in self.notes)

    def to_markdown(self) -> str:
        return f"# {self.title}\n\n" + "\n\n".join(m for _, m in self.notes) + "\n"

    def save(self, spark: SparkSession, path: str) -> None:
        save_text(spark, self.to_markdown(), path)
