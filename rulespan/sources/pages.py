"""Reader of a page with one table of roles: cells are a small language, read strictly.

Whatever the page says that the language doesn't have is an error and never skipped: a
cell that is read wrongly would make a class that has never been.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from rulespan.sources.base import SourceError, whole

# The table's columns after the substance, as (system, role, band), and the pathways of each system.
COLUMNS = (
    ("CYP", "inhibitor", "strong"), ("CYP", "inhibitor", "moderate"), ("CYP", "inhibitor", "weak"),
    ("CYP", "inducer", "strong"), ("CYP", "inducer", "moderate"), ("CYP", "inducer", "weak"),
    ("CYP", "substrate", "sensitive"), ("CYP", "substrate", "moderate sensitive"),
    ("transporter", "inhibitor", None), ("transporter", "substrate", None),
)
PATHWAYS = {
    "CYP": ("1A2", "2B6", "2C8", "2C9", "2C19", "2D6", "3A"),
    "transporter": ("P-gp", "BCRP", "OATP1B1", "OATP1B3", "OATP1B", "OAT1", "OAT3", "OCT2", "MATE1", "MATE2-K"),
}
#: Markers that the page uses without a footnote.
UNDEFINED = ("b",)
ROLE = re.compile(r"(?:\b(?P<band>(?:moderate(?:ly)?\s+)?sensitive|strong|moderate(?:ly)?|weak)\s+)?\b(?P<role>inhibitor|inducer|substrate)s?$", re.I)
SPLIT = re.compile(r"[;,]|\band\b", re.I)
STAMP = re.compile(r"(?P<month>\d\d)/(?P<day>\d\d)/(?P<year>\d{4})\s*-\s*(?P<clock>\d\d:\d\d)")
TUPLE = "path string, release string, row int, raw_substance string, substance string, heading string, raw_cell string, system string, pathway string, role string, potency string, row_markers string, cell_markers string, markers string, footnote string"


class _Page(HTMLParser):
    """The first table's rows of cells, the stamps, and the notes under the footnotes' heading."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.tables = 0
        self.cell: list[str] | None = None
        self.heading: list[str] | None = None
        self.note: list[str] | None = None
        self.notes: list[str] = []
        self.in_notes = self.found_notes = False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables += 1
        elif self.tables == 1 and tag == "tr":
            self.rows.append([])
        elif self.tables == 1 and tag in ("td", "th") and self.rows:
            self.cell = []
        elif tag in ("h1", "h2"):
            self.in_notes, self.heading = False, []
        elif tag == "p" and self.in_notes:
            self.note = []
        for held in (self.cell, self.note):
            if held is not None:
                held.append(" ")
        if tag == "sup" and self.note is not None and not "".join(self.note).strip():
            self.note.append("\x00")

    def handle_endtag(self, tag):
        for held in (self.cell, self.note):
            if held is not None:
                held.append("\x01" if tag == "sup" and held is self.note else " ")
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table":
            # Only the first table is the data; what follows it is not.
            self.tables += 1
        elif tag in ("h1", "h2") and self.heading is not None:
            if tag == "h2" and "".join(self.heading).strip().lower() == "footnotes":
                self.in_notes = self.found_notes = True
            self.heading = None
        elif tag == "p" and self.note is not None:
            self.notes.append("".join(self.note))
            self.note = None

    def handle_data(self, data):
        for held in (self.cell, self.heading, self.note):
            if held is not None:
                held.append(data)


def release_of(page: str) -> str:
    """The page's own stamp as 2026-05-29T14:00; all of its stamps must agree."""
    raw = re.findall(r'"dateModified"\s*:\s*"([^"]+)"', page) + re.findall(r'(?:article:modified_time|og:updated_time)"\s+content="([^"]+)"', page)
    read = {"{year}-{month}-{day}T{clock}".format(**m.groupdict()) for m in map(STAMP.search, raw) if m}
    if len(read) != 1:
        raise SourceError(f"the page's stamps say {sorted(read) or raw or 'nothing'}")
    return read.pop()


def footnotes_of(page: _Page) -> dict[str, str]:
    """Each marker's text."""
    out = {}
    for note in page.notes:
        if "\x00" in note and "\x01" in note:
            marker, text = note.split("\x00", 1)[1].split("\x01", 1)
            if re.fullmatch(r"\w+", marker.strip()):
                out[marker.strip()] = " ".join(text.replace("\x01", " ").split())
    if not out:
        raise SourceError("the footnotes are empty" if page.found_notes else "the page has no footnotes")
    return out


def without_markers(text: str) -> tuple[str, list[str]]:
    """The text without the numbers and single letters that trail it, and these."""
    words, marks = text.split(), []
    while len(words) > 1 and re.fullmatch(r"(?:\d+|[a-z]),?", words[-1]):
        marks.append(words.pop().rstrip(","))
    return " ".join(words), marks[::-1]


def cell_facts(cell: str, column: int) -> list[tuple[str, list[str]]]:
    """(pathway, markers) of each item of a cell in one of ``COLUMNS``.

    A cell lists pathways, separated by semicolons, commas or the word and, each with
    its own markers, and ends in the role that holds for all; the role and its band
    must be the column's."""
    system, role, band = COLUMNS[column]
    body, marks = without_markers(cell)
    end = ROLE.search(body)
    if not end:
        raise SourceError(f"no role in {cell!r}")
    said = " ".join((end["band"] or "").lower().split()).replace("moderately", "moderate")
    if end["role"].lower() != role or bool(said) != bool(band) or (band and not band.startswith(said)):
        raise SourceError(f"{cell!r} contradicts its column, {band or ''} {role}")
    items: list[str] = []
    listed = re.sub(r"\b(?:transporters?|enzymes?)\b", "", body[: end.start()], flags=re.I)
    for part in filter(None, (p.strip() for p in SPLIT.split(listed))):
        # A lone marker belongs to the item before it.
        if items and re.fullmatch(r"\d+|[a-z]", part):
            items[-1] += f" {part}"
        else:
            items.append(part)
    names = {p.upper(): p for p in PATHWAYS[system]}
    out = []
    for item in items:
        name, own = without_markers(ROLE.sub("", item).strip())
        name = re.sub(r"^cyp", "", name, flags=re.I).strip()
        if not name:
            continue
        if name.upper() not in names:
            raise SourceError(f"{name!r} in {cell!r} is no {system} pathway")
        out.append((names[name.upper()], list(dict.fromkeys(marks + own))))
    return out


def note_of(markers: list[str], notes: dict[str, str]) -> str | None:
    """The texts of all markers that have one; none at all is an error, but for markers known to lack one."""
    found = [notes[m] for m in markers if m in notes]
    if markers and not found and set(markers) - set(UNDEFINED):
        raise SourceError(f"no footnote of {markers}")
    return " / ".join(found) or None


def page_facts(text: str) -> Iterator[tuple]:
    """All facts of a page, a row for each (row, column, pathway)."""
    page = _Page(text)
    if not page.rows:
        raise SourceError("the page has no table with rows")
    for i, row in enumerate(page.rows):
        if len(row) != len(COLUMNS) + 1:
            raise SourceError(f"row {i} has {len(row)} cells instead of {len(COLUMNS) + 1}")
    release, notes, headings = release_of(text), footnotes_of(page), page.rows[0]
    for number, row in enumerate(page.rows[1:], 1):
        substance, of_row = without_markers(row[0])
        for column, cell in enumerate(row[1:]):
            for pathway, of_cell in cell_facts(cell, column) if cell else ():
                system, role, band = COLUMNS[column]
                text_of = lambda m: ", ".join(m) or None
                yield release, number, row[0], substance, headings[column + 1], cell, system, pathway, role, band, text_of(of_row), text_of(of_cell), text_of(of_row + of_cell), note_of(of_row + of_cell, notes)


def _facts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in TUPLE.split(", ")]
    for frame in frames:
        rows = [(path, *fact) for path, page in zip(frame["path"], frame["page"]) for fact in page_facts(page or "")]
        yield pd.DataFrame(rows, columns=names)


def role_tables(spark: SparkSession, path: str) -> DataFrame:
    """The facts of every page under a path; a page that can't be read fails the job."""
    return whole(spark, path).mapInPandas(_facts, TUPLE)


def class_code(system: str, pathway: str, role: str, band: str | None) -> str:
    return ":".join(filter(None, (system.lower(), re.sub("[- ]", "", pathway.lower()), role, (band or "").replace(" ", "-"))))


def class_name(system: str, pathway: str, role: str, band: str | None, tag: str = "FDA-CYP") -> str:
    return f"{'CYP' if system == 'CYP' else ''}{pathway} {band + ' ' if band else ''}{role} [{tag}]"


# Fields of a list's entries, and the axes that one may name.
TEXTS = ("subject_name", "object_medrt_code", "object_name", "axis", "citation")
AXES = ("CI_MoA", "CI_PE", "CI_EPC")
ENTRY = "entry string, subject_unii string, subject_code string, subject_name string, object_code string, object_name string, axis string, citation string, applies boolean, severity string, evidence string, mechanism string, management string"


def _optional(block: dict, key: str, entry: str) -> str | None:
    value = block.get(key)
    if value is not None and not isinstance(value, str):
        raise SourceError(f"{entry}: {key} is no text")
    return value if value and value.strip() else None


def entries(text: str) -> list[tuple]:
    """The entries of a curated list in TOML: what a paper says of a pair, and our judgement of it."""
    out: list[tuple] = []
    for raw in tomllib.loads(text).get("entry") or []:
        entry = _optional(raw, "entry_id", "an entry")
        if entry is None or entry in {e[0] for e in out}:
            raise SourceError(f"entry {entry} has no name of its own")
        said, ruled = (raw.get(k) for k in ("candidate", "judgement"))
        if not isinstance(said, dict) or not isinstance(ruled, dict):
            raise SourceError(f"{entry}: no candidate or no judgement")
        texts = [_optional(said, k, entry) for k in TEXTS]
        subjects = [_optional(said, k, entry) for k in ("subject_unii", "subject_medrt_code")]
        if None in texts or sum(s is not None for s in subjects) != 1 or texts[3] not in AXES:
            raise SourceError(f"{entry}: a text is missing, or there isn't one subject, or the axis is unknown")
        grades = [_optional(ruled, k, entry) for k in ("severity", "evidence_grade")]
        applies = ruled.get("applies")
        if not isinstance(applies, bool) or any((g is None) == applies for g in grades):
            raise SourceError(f"{entry}: grades must be there exactly if it applies")
        out.append((entry, *subjects, *texts, applies, *grades, *[_optional(ruled, k, entry) for k in ("mechanism", "management")]))
    if not out:
        raise SourceError("the list has no entries")
    return out


def curated_list(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a curated list: a short file, read whole."""
    return spark.createDataFrame(entries(whole(spark, path).first()["page"]), ENTRY)
