"""Text functions as column expressions.

Fixed lists and patterns (keywords, stop strings, titles of blocks) stand together at the top.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Starts of lines of code, an assignment, stop strings, titles, literal tokens.
CODE_STARTS = ["def ", "class ", "import ", "from ", "if ", "elif ", "else:", "for ", "while ", "try:", "except ", "with ", "return ", "print("]
ASSIGNMENT = r"^[A-Za-z_][A-Za-z0-9_,\s\[\]]*\s*="
STOPS = ["\n\nif __name__", "\n\nprint(", "\n\n```", "\n```", "\nThis solution", "\nThe solution", "\nExplanation:", "\n###"]
ANSWER, VISIBLE_CASES, EXAMPLE_INPUTS = "### Answer\n", "### Visible Test Cases\n", "### Example Inputs\n"
LITERALS = ["[]", "()", "{}", "''", '""', "None", "True", "False"]
CASE_LITERALS = ["[]", "{}", '""', "''", "true", "false", "null"]
TOKENS = r"[A-Za-z_]+|-?\d+"
SEED_BASE, SEED_MODULUS = 131, 2147483647


# The characters that Python strips, and those that end its lines.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_ENDS = ["\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
# The layouts of worked examples in problem statements, and the headings that open and close a list of examples.
EXAMPLES_TO_CONSTRAINTS = r"(?is)\n\s*Example\s+1\s*:.*?(\n\s*Constraints\s*:)"
SAMPLES_TO_END = r"(?is)\n\s*Sample\s+Input\s+1\b.*\z"
EXAMPLES_TO_END = r"(?is)\n\s*Examples?\s*\n.*\z"
OPENS_EXAMPLES = r"(?i)^(?:examples?(?:\s+\d+)?\s*:|for examples?\b)"
CLOSES_EXAMPLES = r"(?i)^(?:### |constraints\b|notes?\s*:|assumptions\b|you (?:may|can|should|must)\b)"


def _lit(x: str) -> Column:
    return F.lit(x)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once for a row, however often ``use`` names it: a column that is named often, in columns that are named
    often, makes a plan of exponential size. No Python UDF may stand in ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def strip_thinking(text: Column) -> Column:
    """without finished reasoning blocks."""
    return F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", "")


def lines(text: Column) -> Column:
    """The lines of a text; a last line end opens no further line, and an empty text has none. Plain replacements and one separator cost far less than a pattern."""
    cut = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)
    for end in LINE_ENDS:
        text = F.replace(text, _lit(end), _lit("\n"))
    return bound(F.split(text, "\n"), cut)


def is_code_line(line: Column) -> Column:
    stripped = strip(line)
    out = stripped.rlike(ASSIGNMENT)
    for start in CODE_STARTS:
        out = out | stripped.startswith(start)
    return out


def code_score(text: Column) -> Column:
    """how many lines look like code."""
    return F.size(F.filter(lines(text), is_code_line))


def is_placeholder(text: Column) -> Column:
    """a stub instead of code."""
    low = F.lower(text)
    return low.contains("your implementation here") | low.contains("todo") | (strip(low) == "pass")


def without_language(segment: Column) -> Column:
    """a fenced segment without its language tag."""
    return F.regexp_replace(segment, r"^\s*(?i:python|py)(?=\s|$)", "")


def strip_fences(text: Column) -> Column:
    """F2: the best fenced segment of code (by score, then length, the first of equals), stubs only if there is nothing else; what stands before
    the first fence if no segment is code; the text itself if there is no fence."""

    def ranked(x: Column, i: Column) -> Column:
        return F.struct(F.when(is_placeholder(x), 0).otherwise(1).alias("real"), code_score(x).alias("score"), F.length(x).alias("size"), (-i).alias("place"), x.alias("text"))

    def chosen(trimmed: Column, clean: Column) -> Column:
        best = F.array_max(F.filter(F.transform(trimmed, ranked), lambda x: (x["score"] > 0) & (x["size"] > 0)))
        before = F.nullif(F.get(trimmed, F.lit(0)), _lit(""))
        return F.coalesce(F.concat(best["text"], _lit("\n")), F.concat(before, _lit("\n")), clean)

    def cut(clean: Column) -> Column:
        parts = F.transform(F.split(clean, "```"), lambda x, i: strip(F.regexp_replace(F.when(i == 0, x).otherwise(without_language(x)), r"^\s+|\s+$", "")))
        return F.when(~clean.contains("```"), clean).otherwise(bound(parts, lambda trimmed: chosen(trimmed, clean)))

    return bound(strip_thinking(text), cut)


def truncated(text: Column) -> Column:
    """F8: up to the first of the stop strings."""
    places = [F.nullif(F.instr(text, s), F.lit(0)) for s in STOPS]
    return F.substr(text, F.lit(1), F.coalesce(F.least(*places) - 1, F.length(text)))


def without_public_examples(text: Column) -> Column:
    """a problem statement without its worked examples, in three layouts."""
    out = F.regexp_replace(text, "\r\n", "\n")
    out = F.regexp_replace(out, EXAMPLES_TO_CONSTRAINTS, "$1")
    out = F.regexp_replace(out, SAMPLES_TO_END, "")
    out = F.regexp_replace(out, EXAMPLES_TO_END, "")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def without_problem_examples(text: Column) -> Column:
    """lines from an example's heading to the next section's are left out; a fold over the lines, with a flag as state."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def one(state: Column, line: Column) -> Column:
        own = strip(line)
        inside = (state["inside"] | own.rlike(OPENS_EXAMPLES)) & ~own.rlike(CLOSES_EXAMPLES)
        return F.struct(inside.alias("inside"), F.when(inside, state["kept"]).otherwise(F.array_append(state["kept"], line)).alias("kept"))

    kept = F.aggregate(lines(F.regexp_replace(text, r"(\r\n|\n|\r)$", "")), start, one)["kept"]
    return F.concat(F.array_join(kept, "\n"), _lit("\n"))


def assertions(text: Column) -> Column:
    """the trimmed lines that assert something."""
    return F.filter(F.transform(lines(text), lambda x: strip(x)), lambda x: x.startswith("assert "))


def with_tests(prompt: Column, tests: Column, inputs_only: bool = False) -> Column:
    """numbered tests put before the answer's heading (or at the end)."""
    numbered = F.array_join(F.transform(tests, lambda x, i: F.concat(_lit("Test "), (i + 1).cast("string"), _lit("\n"), x)), "\n\n")
    block = F.concat(_lit(EXAMPLE_INPUTS if inputs_only else VISIBLE_CASES), numbered, _lit("\n\n"))
    at = F.instr(prompt, ANSWER)
    before = F.when(at > 0, F.substr(prompt, F.lit(1), at - 1)).otherwise(prompt)
    after = F.when(at > 0, F.substr(prompt, at)).otherwise(_lit(""))
    return F.when(F.size(tests) == 0, prompt).otherwise(F.concat(F.regexp_replace(before, r"\s+$", ""), _lit("\n\n"), block, after))


def tests_of(prompt: Column) -> Column:
    """the tests put into a prompt by with_tests()."""
    block = F.split_part(F.substring_index(prompt, VISIBLE_CASES, -1), _lit(ANSWER), F.lit(1))
    parts = F.transform(F.split(F.regexp_replace(block, r"^\s+|\s+$", ""), r"(?:^|\n\n)Test \d+\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.when(prompt.contains(VISIBLE_CASES), F.filter(parts, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def squeezed(text: Column) -> Column:
    """F16: without any white space, as a key; by plain replacements, as a pattern costs some times as much."""
    for space in " \t\n\x0b\f\r":
        text = F.replace(text, _lit(space), _lit(""))
    return text


def entry_point(code: Column) -> Column:
    """name of the first function that is defined; '' without one."""
    return F.regexp_extract(code, r"(?m)^\s*def\s+(\w+)\s*\(", 1)


def tokens(text: Column) -> Column:
    """the distinct words and integers."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({TOKENS})"), 1))


def token_distance(a: Column, b: Column) -> Column:
    """1 - Jaccard of the tokens; the difference of lengths if neither has any."""
    x, y = tokens(a), tokens(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.abs(F.length(a) - F.length(b)).cast("double")).otherwise(1 - F.size(F.array_intersect(x, y)) / union)


def safe_id(text: Column) -> Column:
    """slashes and spaces as underscores."""
    return F.translate(text, "/ ", "__")


# The conditions' names, and the forms with a suffix of a count or of a quality and a count.
CONDITIONS = ["nl_only", "nl_tests", "shuffled_tests", "irrelevant_tests", "asserts_only", "test_names_only"]
COUNTED = r"^(nl_tests|asserts_only|test_names_only|shuffled_tests|irrelevant_tests)_k?(\d+|all)$"
GRADED = r"^(nl_tests|asserts_only|test_names_only)_(high|low|diverse)(\d+|all)$"
#: A count beyond this asks for all tests that an array can hold.
MOST_TESTS = 2**31 - 1


def condition_spec(condition: Column) -> Column:
    """base, quality ('original' if none is named) and count (null for all) of a condition's name; null if it is no such name.

    A line feed may end the name. A count that no array reaches is given as MOST_TESTS.
    """

    def spec(base: Column, quality: Column, count: Column) -> Column:
        digits = F.ltrim(count, F.lit("0"))
        n = F.when(count == "all", F.lit(None)).when(F.length(digits) > 10, MOST_TESTS).otherwise(F.least(F.concat(F.lit("0"), digits).cast("long"), F.lit(MOST_TESTS)))
        return F.struct(base.alias("base"), quality.alias("quality"), n.cast("int").alias("n"))

    original = _lit("original")
    # (?d): only a line feed is a line's end, as the names' grammar has it
    counted, graded = (lambda i: F.regexp_extract(condition, "(?d)" + COUNTED, i)), (lambda i: F.regexp_extract(condition, "(?d)" + GRADED, i))
    return (
        F.when(condition.isin(CONDITIONS), spec(condition, original, _lit("all")))
        .when(condition.rlike("(?d)" + COUNTED), spec(counted(1), original, counted(2)))
        .when(condition.rlike("(?d)" + GRADED), spec(graded(1), graded(2), graded(3)))
    )


def stable_seed(text: Column) -> Column:
    """a polynomial hash over code points."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda t, c: F.pmod(t * SEED_BASE + c, F.lit(SEED_MODULUS).cast("long")))
    return F.when(F.length(text) > 0, total).otherwise(F.lit(0).cast("long"))


def ids_hash(ids: Column) -> Column:
    """digest of comma-joined ids."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def error_class(text: Column) -> Column:
    """what stands before the first colon."""
    return F.substring_index(text, ":", 1)


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def head(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def _contains_count(text: Column, words: list[str]) -> Column:
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def fallback_score(text: Column) -> Column:
    """quality of a test that can't be parsed."""
    return F.least(F.length(text), F.lit(300)) / 100 + F.regexp_count(text, F.lit(r"-?\d+")) * 0.25 + _contains_count(text, LITERALS)


def case_score(text: Column) -> Column:
    """quality of an input/output case, given as one text: length, numbers (the first 100), literals and lines."""
    numbers = F.transform(F.slice(F.regexp_extract_all(text, F.lit(r"(-?\d+)"), 1), 1, 100), lambda x: x.cast("double"))
    small = F.size(F.filter(numbers, lambda x: F.abs(x) <= 1))
    large = F.size(F.filter(numbers, lambda x: F.abs(x) >= 100))
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.least(F.length(text), F.lit(1000)) / 200 + F.least(F.size(numbers), F.lit(20)) * 0.2 + small * 0.2 + large * 0.1 + _contains_count(text, CASE_LITERALS) + newlines * 0.1


def combined_score(score: Column, kill_rate: Column, weight: float = 10.0) -> Column:
    """F31."""
    return score + weight * kill_rate


def log_length_ratio(a: Column, b: Column) -> Column:
    """F34."""
    return F.abs(F.log(F.greatest(F.lit(1), F.length(a)) / F.greatest(F.lit(1), F.length(b))))


def rotated(values: Column) -> Column:
    """outputs moved by one place; fewer than two distinct values raise."""
    moved = F.concat(F.slice(values, F.lit(2), F.size(values)), F.slice(values, 1, 1))
    return F.when(F.size(F.array_distinct(values)) < 2, F.raise_error(F.lit("fewer than two distinct values")).cast("array<string>")).otherwise(moved)


def case_variants(tests: Column) -> tuple[Column, Column]:
    """each test in parentheses; the tests backwards."""
    return F.transform(tests, lambda t: F.when(t.startswith("assert "), F.concat(_lit("assert ("), F.substr(t, F.lit(8)), _lit(")"))).otherwise(t)), F.reverse(tests)


def first_id(*columns: Column) -> Column:
    """the first that isn't blank."""
    return F.coalesce(*(F.nullif(strip(c.cast("string")), _lit("")) for c in columns))


def namespaced(source: Column, own: Column) -> Column:
    """F49."""
    return F.concat_ws("::", source, own)


def to_bool(value: Column) -> Column:
    """Boolean from its usual spellings; anything else raises, null and '' are null."""
    own = F.lower(strip(value.cast("string")))
    return F.when(own.isin("true", "1"), True).when(own.isin("false", "0"), False).when(own.isNull() | (own == ""), F.lit(None).cast("boolean")).otherwise(F.raise_error(F.concat(_lit("no boolean: "), own)).cast("boolean"))
