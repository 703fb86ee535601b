"""String functions on columns. Lengths are in bytes where a cap is in bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings that take "es" and separators that end a first clause, in order.
SIBILANTS = ["s", "x", "ch"]
CLAUSE_ENDS = [" — ", ", so ", " with "]


def slug(s: Column, keep: int = 72) -> Column:
    """Runs of other than ASCII letters and digits become a hyphen; the last ``keep`` characters stay."""
    dashed = F.btrim(F.regexp_replace(s, "[^A-Za-z0-9]+", "-"), F.lit("-"))
    return F.btrim(F.right(dashed, F.lit(keep)), F.lit("-"))


def ask_id(kind: Column, subject: Column) -> Column:
    """The kind, and the subject's slug if there is one."""
    tail = slug(F.coalesce(subject, F.lit("")))
    return F.when(tail == "", kind).otherwise(F.concat_ws("-", kind, tail))


def snake(s: Column) -> Column:
    """An underscore before every ASCII capital but a first one, in lower case: TraceID gives trace_i_d."""
    return F.lower(F.regexp_replace(s, "(?<!^)([A-Z])", "_$1"))


def last_segment(s: Column, separator: str) -> Column:
    return F.substring_index(s, separator, -1)


def table_names(type_name: Column) -> Column:
    """The table names under which a type may be stored: as it is and in its plurals."""
    name = snake(last_segment(type_name, "."))
    ies = F.when(name.endswith("y"), F.concat(F.left(name, F.length(name) - 1), F.lit("ies")))
    es = F.when(name.rlike(f"(?:{'|'.join(SIBILANTS)})$"), F.concat(name, F.lit("es")))
    return F.array_compact(F.array(name, F.concat(name, F.lit("s")), ies, es))


def test_name(scenario: Column) -> Column:
    """Test and the parts of a hyphenated id, each with a capital."""
    return F.concat(F.lit("Test"), F.replace(F.initcap(F.replace(F.lower(scenario), F.lit("-"), F.lit(" "))), F.lit(" "), F.lit("")))


def target_file(directory: Column, family: Column, size: Column, tag: str = "") -> Column:
    """The file of a test in the directory of its entry; tag is the tool's own mark in the name."""
    ending = F.when(size == "small", f"{tag}_test.go").otherwise(f"{tag}_integration_test.go")
    return F.concat_ws("/", F.when(directory == "", ".").otherwise(directory), F.concat(F.lower(family), ending))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def diagram_id(s: Column) -> Column:
    """The last part of the package and the symbol; runs of other than ASCII letters and digits become an underscore."""
    package = F.substring_index(s, "#", 1)
    symbol = F.substring(s, F.length(package) + 2, F.length(s))
    joined = F.when(F.instr(s, "#") > 0, F.concat(last_segment(package, "/"), F.lit("_"), symbol)).otherwise(s)
    return F.btrim(F.regexp_replace(joined, "[^A-Za-z0-9]+", "_"), F.lit("_"))


def html_escape(s: Column) -> Column:
    out = F.replace(s, F.lit('"'), F.lit("&quot;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def short_type(s: Column) -> Column:
    return last_segment(s, "/")


def byte_prefix(s: Column, n: int) -> Column:
    """The first n bytes, without a character that they would cut."""
    cut = F.try_validate_utf8(F.substring(s.cast("binary"), 1, n).cast("string"))
    shorter = [F.try_validate_utf8(F.substring(s.cast("binary"), 1, n - k).cast("string")) for k in (1, 2, 3)]
    return F.coalesce(cut, *shorter)


def first_clause(s: Column, most: int = 58) -> Column:
    """Up to the first separator of the list that occurs after the start, else at most ``most`` bytes."""
    found = None
    for end in CLAUSE_ENDS:
        at = F.instr(s, end)
        cut = F.left(s, at - 1)
        found = F.when(at > 1, cut) if found is None else found.when(at > 1, cut)
    return found.when(F.octet_length(s) > most, F.concat(byte_prefix(s, most), F.lit("…"))).otherwise(s)


def first_line(s: Column, most: int = 160) -> Column:
    line = F.split(F.btrim(s, F.lit(" \t\r\n")), "\n")[0]
    return F.when(F.octet_length(line) > most, byte_prefix(line, most)).otherwise(line)


def first_heading(s: Column) -> Column:
    """The first line that starts with #, without the marks; empty if there is none."""
    return F.trim(F.regexp_extract(s, "(?m)^#[# ]*(.*)$", 1))


def ellipsis(s: Column, most: int) -> Column:
    cut = byte_prefix(s, most) if most <= 3 else F.concat(byte_prefix(s, most - 3), F.lit("..."))
    return F.when(F.octet_length(s) > most, cut).otherwise(s)


def capped(s: Column, most: int = 1200, mark: str = "\n… truncated") -> Column:
    text = F.btrim(s, F.lit(" \t\r\n"))
    return F.when(F.octet_length(text) > most, F.concat(byte_prefix(text, most), F.lit(mark))).otherwise(text)


def or_list(items: Column) -> Column:
    return F.array_join(F.sort_array(items), " or ")


def strip_title(s: Column) -> Column:
    """Without what comes up to the first line that starts with "# ", if it is among the first five, and without that line."""
    return F.regexp_replace(s, r"^(?:(?!# )[^\n]*\n){0,4}# [^\n]*(?:\n|$)", "")


def indent(s: Column, pad: str) -> Column:
    return F.regexp_replace(s, "(?m)^", pad)


def same_field(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def any_of(have: Column, names: list[str], singular: bool = False) -> Column:
    """Whether an array holds one of the names, or with singular one of them without a last s."""
    every = [*names, *([n.removesuffix("s") for n in names] if singular else [])]
    return F.arrays_overlap(have, F.array(*[F.lit(n) for n in dict.fromkeys(every)]))


def any_within(blob: Column, parts: list[str]) -> Column:
    """Whether a text holds one of the parts."""
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(blob, F.lit(p))
    return found


def occurrences(s: Column, word: Column) -> Column:
    """How often a word occurs in a text, without overlaps; texts without it are only searched."""
    n = ((F.octet_length(s) - F.octet_length(F.replace(s, word, F.lit("")))) / F.octet_length(word)).cast("long")
    return F.when(F.contains(s, word), n).when(s.isNotNull(), 0).cast("long")


def strip_comments(s: Column) -> Column:
    """Without the lines that hold only a // comment; those after other text stay."""
    return F.regexp_replace(s, r"(?m)^[ \t]*//.*$", "")


def question_text(subject: Column, text: Column, true_or_false: Column) -> Column:
    """A question with its subject and the shape of its answer."""
    shape = F.when(true_or_false, F.lit("Answer true or false.")).otherwise(F.lit("Answer in words."))
    return F.concat_ws(" ", F.when(F.coalesce(subject, F.lit("")) != "", F.concat(subject, F.lit(":"))), text, shape)
