"""Scans over the lines or the characters of a text, as folds with a small state (F11, F19, F37). No Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# What opens an example, what ends the text it stands in, and what stands before a listed assertion.
PROMPT = ">>> "
TEXT_ENDS = ['"""', "'''"]
BULLETS = "-*0123456789. "

_TEXTS = "array<string>"


def _ends(line: Column) -> Column:
    return F.endswith(line, F.lit(TEXT_ENDS[0])) | F.endswith(line, F.lit(TEXT_ENDS[1]))


def example_assertions(text: Column) -> Column:
    """an assertion for each example of a text: the expression behind the prompt, and the lines below it, up to the next prompt or the end of the text it stands
    in, joined by spaces. Examples without either are left out."""
    shape = "struct<open: boolean, expression: string, wanted: array<string>, out: array<string>>"

    def closed(s: Column) -> Column:
        """The assertions, with the open example's."""
        full = s["open"] & (s["expression"] != "") & (F.size(s["wanted"]) > 0)
        return F.when(full, F.array_append(s["out"], F.concat(F.lit("assert "), s["expression"], F.lit(" == "), F.array_join(s["wanted"], " ")))).otherwise(s["out"])

    def state(is_open: Column, expression: Column, wanted: Column, out: Column) -> Column:
        return F.struct(is_open.alias("open"), expression.alias("expression"), wanted.alias("wanted"), out.alias("out")).cast(shape)

    none, yes, no = F.array().cast(_TEXTS), F.lit(True), F.lit(False)

    def one(s: Column, line: Column) -> Column:
        return (
            F.when(line.startswith(PROMPT), state(yes, tx.strip(F.substr(line, F.lit(len(PROMPT) + 1))), none, closed(s)))
            .when(_ends(line), state(no, F.lit(""), none, closed(s)))
            .when(s["open"] & (line != ""), state(s["open"], s["expression"], F.array_append(s["wanted"], line), s["out"]))
            .otherwise(s)
        )

    trimmed = F.transform(tx.lines(text), lambda x: tx.strip(x))
    return F.aggregate(trimmed, state(no, F.lit(""), none, none), one, closed)


def _outside(text: Column, ends: bool) -> Column:
    """The lines outside of examples. ``ends``: an example lasts to the end of the text it stands in, and that line stays; else to a blank line, which goes."""
    shape = "struct<inside: boolean, kept: array<string>>"
    state = lambda inside, kept: F.struct(inside.alias("inside"), kept.alias("kept")).cast(shape)

    def one(s: Column, line: Column) -> Column:
        own = tx.strip(line)
        stop = state(F.lit(False), F.array_append(s["kept"], line)) if ends else state(F.lit(False), s["kept"])
        last = _ends(own) if ends else own == ""
        return F.when(own.startswith(PROMPT), state(F.lit(True), s["kept"])).when(~s["inside"], state(F.lit(False), F.array_append(s["kept"], line))).when(last, stop).otherwise(s)

    return F.array_join(F.aggregate(tx.lines(text), state(F.lit(False), F.array().cast(_TEXTS)), one)["kept"], "\n")


def prompt_without_examples(prompt: Column) -> Column:
    """a program's head without the examples of its docstrings."""
    return F.concat(F.rtrim(_outside(prompt, True), F.lit(tx.WHITE_SPACE)), F.lit("\n"))


def docstring_without_examples(text: Column) -> Column:
    """a docstring without its examples."""
    return tx.strip(_outside(text, False))


def listed_assertions(text: Column) -> Column:
    """the lines that assert something once bullets and numbers before them are gone."""
    bare = F.transform(tx.lines(text), lambda x: F.ltrim(tx.strip(x), F.lit(BULLETS)))
    return F.filter(bare, lambda x: x.startswith("assert "))


def braced_block(text: Column) -> Column:
    """from the first opening brace or bracket to the last closing one; '' if there is no such block."""
    first = F.least(F.nullif(F.instr(text, "{"), F.lit(0)), F.nullif(F.instr(text, "["), F.lit(0)))
    back = F.reverse(text)
    last = F.length(text) + 1 - F.least(F.nullif(F.instr(back, "}"), F.lit(0)), F.nullif(F.instr(back, "]"), F.lit(0)))
    return F.when(last > first, F.substr(text, first, last - first + 1)).otherwise("")


def json_spans(text: Column) -> Column:
    """start and end (from 1, both included) of every bracket or brace that a matching one closes, read as JSON from there on.

    Whether a place is inside of a quoted text depends on where reading starts: from a start that itself stands between quotes, inside and outside
    are exchanged. So brackets are matched on two stacks, one for those at places that are outside when read from the text's start and one for the others: a start and
    all brackets that count from there are on one stack. A closing bracket of the other kind makes all that is open on its stack worthless.
    """
    pairs, gaps = r"([^\[\]{}\x22\\]*)([\[\]{}\x22]|\\[\x22\\]?|$)", "array<struct<start: int, end: int>>"
    tokens = F.arrays_zip(F.transform(F.regexp_extract_all(text, F.lit(pairs), 1), F.length).alias("gap"), F.regexp_extract_all(text, F.lit(pairs), 2).alias("token"))
    stack = "array<struct<at: int, kind: string>>"
    shape = f"struct<at: int, quoted: boolean, plain: {stack}, other: {stack}, out: {gaps}>"

    def state(at: Column, quoted: Column, plain: Column, other: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), quoted.alias("quoted"), plain.alias("plain"), other.alias("other"), out.alias("out")).cast(shape)

    def one(s: Column, t: Column) -> Column:
        token = t["token"]
        begin = s["at"] + t["gap"]
        after = begin + F.length(token)
        own = F.when(s["quoted"], s["other"]).otherwise(s["plain"])
        top = F.try_element_at(own, F.lit(-1))
        fits = ((token == "]") & (top["kind"] == "[")) | ((token == "}") & (top["kind"] == "{"))
        opened = F.array_append(own, F.struct(begin.alias("at"), token.alias("kind")).cast("struct<at: int, kind: string>"))
        popped = F.when(F.coalesce(fits, F.lit(False)), F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0)))).otherwise(F.array().cast(stack))
        new = F.when(token.isin("[", "{"), opened).otherwise(popped)
        out = F.when(F.coalesce(fits, F.lit(False)), F.array_append(s["out"], F.struct(top["at"].alias("start"), begin.alias("end")).cast("struct<start: int, end: int>"))).otherwise(s["out"])
        moved = state(after, s["quoted"], F.when(s["quoted"], s["plain"]).otherwise(new), F.when(s["quoted"], new).otherwise(s["other"]), out)
        return F.when(token.isin("[", "]", "{", "}"), moved).otherwise(state(after, s["quoted"] != (token == '"'), s["plain"], s["other"], s["out"]))

    empty = F.array().cast(stack)
    return F.aggregate(tokens, state(F.lit(1), F.lit(False), empty, empty, F.array().cast(gaps)), one)["out"]


def json_candidates(text: Column) -> Column:
    """every piece of a text that begins with a bracket or brace and is JSON (of unrepeated keys), in order of their starts."""

    def pieces(whole: Column) -> Column:
        found = F.transform(F.array_sort(json_spans(whole)), lambda s: F.substr(whole, s["start"], s["end"] - s["start"] + 1))
        return F.filter(found, lambda x: F.try_parse_json(x).isNotNull())

    return tx.bound(text, pieces)  # an expression would be computed again for every piece


def cases_of(pieces: Column) -> Column:
    """the cases (JSON texts) of the last of a reply's pieces of JSON (json_candidates()) that has any, as a list or as the ``tests`` of an object."""

    def cases(piece: Column) -> Column:
        def listed(v: Column) -> Column:
            return F.coalesce(F.try_variant_get(v, "$.tests", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))

        found = tx.bound(F.try_parse_json(piece), listed)
        return F.transform(F.filter(found, lambda x: F.schema_of_variant(x).startswith("OBJECT")), lambda x: F.to_json(x))

    # from the last piece back, pieces behind the first one found are not read
    start = F.lit(None).cast(_TEXTS)
    last = F.aggregate(F.reverse(pieces), start, lambda s, piece: F.when(s.isNull(), tx.bound(cases(piece), lambda c: F.when(F.size(c) > 0, c))).otherwise(s))
    return F.coalesce(last, F.array().cast(_TEXTS))


def reply_cases(text: Column) -> Column:
    """the cases (JSON texts) that a reply gives: of the last piece of JSON in it that has any, as a list or as the ``tests`` of an object."""
    return cases_of(json_candidates(text))
