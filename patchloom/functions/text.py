"""Text scalars as Column expressions, all inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "N/A"
MISSING_IN_SUMMARY = "N/A_in_summary"
#: The section names that a labelled answer may have, in the order in which they follow each other.
LABELLED_SECTIONS = (
    ("source", "Vulnerability Source (Precise):"),
    ("sink", "Vulnerability Sink (Precise):"),
    ("path", "Vulnerability Path Description:"),
    ("specific", "CWE-Specific Repair Strategy:"),
    ("pre_state", "Pre-Repair State:"),
    ("abstract", "Abstract Repair Strategy:"),
    ("concrete", "Concrete Repair Strategy:"),
    ("post_state", "Post-Repair State:"),
)
COUNTED_SECTIONS = ("specific", "pre_state", "abstract", "concrete", "post_state")


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(F.regexp_replace(text, r"\s+", " ")) == "")


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Lines of a text; one line feed at its end opens no line."""
    return F.split(F.regexp_replace(text, "\n$", ""), "\n", -1)


def number_lines(text: Column, width: int = 0) -> Column:
    """'1 | first line' and so on, numbers padded to width; a blank text stays as it is."""
    form = f"%{width}d | %s" if width else "%d | %s"
    numbered = F.transform(lines(text), lambda line, i: F.format_string(form, i + 1, line))
    return F.when(blank(text), text).otherwise(F.array_join(numbered, "\n"))


def pick_lines(text: Column, wanted: Column) -> Column:
    """'3: text' for the distinct wanted line numbers that exist, in ascending order."""
    all_lines = lines(text)
    valid = F.array_sort(F.array_distinct(F.filter(wanted, lambda n: n.isNotNull() & (n >= 1) & (n <= F.size(all_lines)))))
    return F.array_join(F.transform(valid, lambda n: F.format_string("%d: %s", n, F.element_at(all_lines, n.cast("int")))), "\n")


def strip_line_comments(text: Column) -> Column:
    """Lines without // comments and outer blanks."""
    return F.transform(lines(text), lambda line: F.trim(F.regexp_replace(line, r"//.*$", "")))


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n(?:[ \t]*\n)+", "\n\n")


def squeeze(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"\s+", "")


def contains_either_way(a: Column, b: Column) -> Column:
    return F.contains(squeeze(a), squeeze(b)) | F.contains(squeeze(b), squeeze(a))


def marked_section(text: Column, name: str) -> Column:
    """What stands between NAME_START: and NAME_END:, or null."""
    found = F.regexp_extract(text, rf"(?s){name}_START:\s*(.*?)\s*{name}_END:", 1)
    return F.when(F.contains(text, F.lit(f"{name}_START:")) & F.contains(text, F.lit(f"{name}_END:")), found)


def comma_list(text: Column) -> Column:
    """Trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(text, ","), lambda x: strip(x)), lambda x: x != "")


def labelled_sections(text: Column) -> dict[str, Column]:
    """Each section up to the next known label, 'N/A' where there is none or nothing; and the status."""
    labels = [label for _, label in LABELLED_SECTIONS]
    found = {}
    for i, (name, label) in enumerate(LABELLED_SECTIONS):
        ends = "|".join([rf"\s*\Q{x}\E" for x in labels[i + 1 :]] + [r"\z"])
        got = strip(F.regexp_extract(text, rf"(?is)\Q{label}\E\s*(.*?)(?={ends})", 1))
        found[name] = F.when(text.isNull() | (got == ""), F.lit(MISSING)).otherwise(got)
    present = sum((F.when(found[n] != MISSING, 1).otherwise(0) for n in COUNTED_SECTIONS), F.lit(0))
    found["status"] = F.when(present == len(COUNTED_SECTIONS), "success").when(present > 0, "partial").otherwise("failed")
    return found


def verdict(text: Column, default_feedback: str) -> tuple[Column, Column]:
    """(correct?, feedback) of 'Result: Correct|Incorrect' and 'Feedback: ...'."""
    result = F.lower(F.regexp_extract(text, r"(?i)Result:\s*(Correct|Incorrect)", 1))
    feedback = strip(F.regexp_extract(text, r"(?is)Feedback:\s*(.*)", 1))
    return F.coalesce(result == "correct", F.lit(False)), F.when(text.isNull() | (feedback == ""), F.lit(default_feedback)).otherwise(feedback)


def json_in_prose(text: Column) -> Column:
    """The JSON text of an answer: a fenced block, else the outermost braces; null without either."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```", 1)
    greedy = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(greedy != "", greedy)


def valid_line_numbers(json_text: Column, schema: str) -> Column:
    """Positive integers in the lines arrays of {"name", "lines"} entries, distinct and sorted."""
    entries = F.from_json(json_text, schema)
    flat = F.flatten(F.transform(entries, lambda e: F.coalesce(e["lines"], F.array().cast("array<string>"))))
    whole = F.transform(flat, lambda x: F.when(x.rlike(r"^\d+$"), x.cast("long")))
    return F.array_sort(F.array_distinct(F.filter(whole, lambda n: n.isNotNull() & (n > 0))))


def first_code_block(text: Column) -> Column:
    """What the first fence holds, without its language; empty without one."""
    return strip(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)```[\w+-]*\n(.*?)```", 1))


def hunk_bounds(header: Column) -> tuple[Column, Column, Column, Column]:
    """(old start, old count, new start, new count) of '@@ -a,b +c,d @@'; a count that is not written is 1."""
    pattern = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    part = lambda i: F.regexp_extract(header, pattern, i)
    count = lambda i: F.when(part(i) == "", F.lit(1)).otherwise(part(i).cast("int"))
    ok = header.rlike(pattern)
    return tuple(F.when(ok, x) for x in (part(1).cast("int"), count(2), part(3).cast("int"), count(4)))


def _run(start: Column, count: Column, wanted: Column) -> Column:
    return F.when(wanted & (count > 0), F.sequence(start, start + count - 1)).otherwise(F.array().cast("array<int>"))


def hunk_lines(header: Column) -> tuple[Column, Column, Column]:
    """(modified old lines, deleted old lines, added new lines) of a zero-context hunk."""
    a, b, c, d = hunk_bounds(header)
    return _run(a, b, (b > 0) & (d > 0)), _run(a, b, (b > 0) & (d == 0)), _run(c, d, d > 0)


def path_parts(path: Column) -> Column:
    """Nodes of 'A<>B<>C'."""
    return F.split(path, "<>")


def first_present(columns: Sequence[Column], default: str) -> Column:
    return F.coalesce(*columns, F.lit(default))


def word_tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores in any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def level_rank(level: Column) -> Column:
    """High 4, Medium 3, Low 2, Inconsistent 1."""
    return F.when(level == "High", 4).when(level == "Medium", 3).when(level == "Low", 2).when(level == "Inconsistent", 1)


def yes_no(answer: Column) -> Column:
    """Whether a JSON answer in prose says yes; an answer that cannot be read says no."""
    said = F.get_json_object(json_in_prose(answer), "$.answer")
    return F.coalesce(F.lower(F.trim(said)) == "yes", F.lit(False))
