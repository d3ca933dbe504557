"""Programs, tests and outputs of model replies as column expressions (F6, F7, F18, F33). Only what needs Python's parsers is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx
from .code import statements, wrong_json

# What ends a function at the top level, and a number that stands alone.
TOP_LEVEL_STOPS = ["def ", "class ", "# Test", "# test", "if __name__", "print("]
LONE_NUMBER = r"(?<![\w.])-?\d+(?:\.\d+)?(?![\w.])"


def _rstripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(tx.WHITE_SPACE))


def function_only(code: Column, name: Column) -> Column:
    """the code up to the end of the named function, which the next line that starts something else without indent ends.

    Lines carry their places; the head is the first that defines the name, the end the first stop behind it. Without a head the code stays as it is.
    """
    head_of = F.concat(F.lit(r"^def\s+\Q"), name, F.lit(r"\E\s*\("))
    starts = lambda x: F.exists(F.array(*map(F.lit, TOP_LEVEL_STOPS)), lambda s: F.startswith(x, s))
    first = lambda rows, holds: F.array_min(F.transform(F.filter(rows, holds), lambda r: r["i"]))

    def from_head(rows: Column, head: Column) -> Column:
        end = F.coalesce(first(rows, lambda r: (r["i"] > head) & starts(r["x"])), F.size(rows))
        return F.when(head.isNotNull(), F.concat(F.array_join(F.transform(F.slice(rows, F.lit(1), end), lambda r: r["x"]), "\n"), F.lit("\n")))

    def kept(rows: Column) -> Column:
        return tx.bound(first(rows, lambda r: F.rlike(r["x"], head_of)), lambda head: from_head(rows, head))

    return F.coalesce(tx.bound(F.transform(tx.lines(code), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), kept), code)


def assembled(prompt: Column, completion: Column, entry_point: Column | None = None, code_prefix: bool = True) -> Column:
    """the program of a prompt and a completion. ``code_prefix``: the prompt is the program's beginning, which a completion may repeat; the
    whole is cut to the named function and to what stands before the first stop string. Otherwise the completion is a program of its own."""
    answer = tx.strip_fences(completion)
    if not code_prefix:
        return F.concat(_rstripped(answer), F.lit("\n"))
    named = F.lit("") if entry_point is None else F.coalesce(entry_point, F.lit(""))
    whole = tx.bound(answer, lambda a: tx.strip_fences(F.concat(F.when(a.startswith(prompt), F.lit("")).otherwise(prompt), a)))
    whole = tx.bound(whole, lambda w: F.when(named == "", w).otherwise(function_only(w, named)))
    return F.concat(_rstripped(tx.bound(whole, tx.truncated)), F.lit("\n"))


def clean_test(reply: Column) -> Column:
    """the first line of a reply's test, out of its fence if it stands in one."""

    def line(own: Column) -> Column:
        bare = tx.strip(F.regexp_replace(tx.strip(F.regexp_replace(own, r"\A```(?i:python)?", "")), r"```\z", ""))
        return F.get(tx.lines(F.when(own.startswith("```"), bare).otherwise(own)), F.lit(0))

    return tx.strip(F.coalesce(tx.bound(tx.strip(reply), line), F.lit("")))


def reason(test: Column, entry_point: Column, longest: int = 500) -> Column:
    """why a test is no good, the first of the reasons in this order; '' if none holds."""
    kind = statements(test)
    name = F.coalesce(entry_point, F.lit(""))
    fails = {
        "not_assert": ~test.startswith("assert "),
        "too_long": F.length(test) > longest,
        "missing_entry_point": (name != "") & ~F.contains(test, name),
        "syntax_error": kind == "none",
        "not_single_assert": kind == "other",
    }
    return F.coalesce(*(F.when(failed, F.lit(r)) for r, failed in fails.items()), F.lit(""))


def wrong_output(output: Column) -> Column:
    """another output of the same kind: another JSON value; the other of YES and NO; its first lone number and one; or, of other text, its first
    character that isn't white space made B if it is A, else A. Raises for an output that has none of these."""
    word = tx.strip(output)
    at = F.regexp_instr(output, F.lit(LONE_NUMBER))
    number = F.regexp_extract(output, LONE_NUMBER, 0)
    more = F.when(number.contains("."), (F.try_to_number(number, F.lit("S" + "9" * 18 + "." + "9" * 18)).cast("double") + 1).cast("string")).otherwise((number.cast("decimal(38,0)") + 1).cast("decimal(38,0)").cast("string"))
    first = F.instr(output, F.left(word, F.lit(1)))
    letter = F.when(F.left(word, F.lit(1)) == "A", "B").otherwise("A")
    spliced = lambda new, place, size: F.concat(F.substr(output, F.lit(1), place - 1), new, F.substr(output, place + size))
    return (
        F.when(wrong_json(output).isNotNull(), wrong_json(output))
        .when(F.upper(word) == "YES", "NO")
        .when(F.upper(word) == "NO", "YES")
        .when(at > 0, spliced(more, at, F.length(number)))
        .when(word != "", spliced(letter, first, F.lit(1)))
        .otherwise(F.raise_error(F.lit("no output to make wrong")).cast("string"))
    )
