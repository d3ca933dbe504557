"""Prompts and tests of experiment conditions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .code import quality_scores

# Datasets whose prompts have headings, marks of expected outputs, and the lines that introduce tests.
STRUCTURED = ["livecodebench", "mbppplus", "humanevalplus"]
OUTPUT_MARKS = ["\nexpected output: ", "\nexpected stdout: "]
EQUALS = " == "
COMMENT_TESTS = "# The implementation should satisfy these tests:\n"
COMMENT_ONLY = "# Implement the function so that the assertions pass.\n"
COMMENT_NAMES = "\n# Tests:\n"
VISIBLE_NAMES, SIGNATURE = "### Visible Test Names\n", "### Function Signature\n```python\n"
WRITE_SOLUTION = "### Answer\nWrite a complete Python solution. Return only the code inside a Python markdown block.\n```python\n"

_TEXTS = "array<string>"


def _rstripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(tx.WHITE_SPACE))


def _numbered(tests: Column, head: str, sep: str) -> Column:
    return F.array_join(F.transform(tests, lambda t, i: F.concat(F.lit(head), (i + 1).cast("string"), F.lit(sep), t)), "\n" if head.startswith("-") else "\n\n")


def _commented(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda t: F.concat(F.lit("# "), t)), "\n")


def _before_answer(prompt: Column, block: Column) -> Column:
    """A block of text put before the answer's heading, or at the end."""
    at = F.instr(prompt, tx.ANSWER)
    before = F.when(at > 0, F.substr(prompt, F.lit(1), at - 1)).otherwise(prompt)
    return F.concat(_rstripped(before), F.lit("\n\n"), block, F.when(at > 0, F.substr(prompt, at)).otherwise(F.lit("")))


def is_structured(dataset: Column) -> Column:
    low = F.lower(dataset)
    return low.startswith(STRUCTURED[0]) | low.startswith(STRUCTURED[1]) | low.startswith(STRUCTURED[2])


def first_signature(prompt: Column) -> Column:
    """the first line that begins a function, trimmed; '' without one."""
    found = F.filter(F.transform(tx.lines(prompt), lambda x: tx.strip(x)), lambda x: x.startswith("def "))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def with_tests(prompt: Column, dataset: Column, tests: Column) -> Column:
    """a prompt and its tests: under a heading before the answer, or as comments behind it."""
    structured = _before_answer(prompt, F.concat(F.lit(tx.VISIBLE_CASES), _numbered(tests, "Test ", "\n"), F.lit("\n\n")))
    plain = F.concat(_rstripped(prompt), F.lit("\n\n" + COMMENT_TESTS), _commented(tests), F.lit("\n\n"))
    return F.when(F.size(tests) == 0, prompt).when(is_structured(dataset), structured).otherwise(plain)


def with_names(prompt: Column, dataset: Column, entry_point: Column, tests: Column) -> Column:
    """a prompt and the names of its tests only."""
    names = F.transform(tests, lambda t, i: F.concat(F.lit("test_"), (i + 1).cast("string"), F.lit(": "), entry_point))
    listed = F.array_join(F.transform(names, lambda t: F.concat(F.lit("- "), t)), "\n")
    structured = _before_answer(prompt, F.concat(F.lit(VISIBLE_NAMES), listed, F.lit("\n\n")))
    return F.when(is_structured(dataset), structured).otherwise(F.concat(prompt, F.lit(COMMENT_NAMES), _commented(names), F.lit("\n\n")))


def tests_only(prompt: Column, dataset: Column, imports: Column, signature: Column, tests: Column) -> Column:
    """a signature and tests instead of a description; the prompt's first function is the signature where none is given."""
    own = tx.strip(signature)
    own = F.when(own == "", first_signature(prompt)).otherwise(own)
    head = F.when(tx.strip(imports) == "", "").otherwise(F.concat(tx.strip(imports), F.lit("\n\n")))
    structured = F.concat(F.lit(SIGNATURE), head, own, F.lit("\n```\n\n" + tx.VISIBLE_CASES), _numbered(tests, "Test ", "\n"), F.lit("\n\n" + WRITE_SOLUTION))
    return F.when(is_structured(dataset), structured).otherwise(F.concat(head, F.lit(COMMENT_ONLY), _commented(tests), F.lit("\n\n"), own, F.lit("\n")))


def output_parts(test: Column) -> Column:
    """what stands before a test's expected output, and that output; raises where there is no one place that parts them.

    A test is parted at its first mark of an output, or, if it is an assertion, at its only ``==``.
    """
    places = [F.instr(test, mark) for mark in OUTPUT_MARKS]
    single = test.startswith("assert ") & (F.size(F.split(test, EQUALS)) == 2)
    size = F.when(places[0] > 0, places[0] + len(OUTPUT_MARKS[0])).when(places[1] > 0, places[1] + len(OUTPUT_MARKS[1])).when(single, F.instr(test, EQUALS) + len(EQUALS))
    at = F.coalesce(size, F.raise_error(F.lit("no expected output found in a test")).cast("int")) - 1
    return F.struct(F.substr(test, F.lit(1), at).alias("given"), F.substr(test, at + 1).alias("output"))


def shuffled_outputs(tests: Column, seed: Column) -> Column:
    """the tests with their outputs permuted by the seed, never all at their own places; raises with fewer than two different outputs."""
    def place(i: Column) -> Column:
        return F.md5(F.concat_ws("-", seed.cast("string"), i.cast("string")))

    def changed(parts: Column) -> Column:
        outputs = F.transform(parts, lambda p: p["output"])
        keyed = F.array_sort(F.transform(parts, lambda p, i: F.struct(place(i).alias("k"), p["output"].alias("x"))))
        turned = F.concat(F.slice(outputs, F.lit(2), F.size(parts)), F.slice(outputs, 1, 1))
        mixed = tx.bound(F.transform(keyed, lambda s: s["x"]), lambda m: F.when(m == outputs, turned).otherwise(m))
        fixed = F.raise_error(F.lit("no permutation of the outputs changes these tests")).cast(_TEXTS)
        return F.when(F.size(F.array_distinct(outputs)) < 2, fixed).otherwise(F.zip_with(parts, mixed, lambda p, x: F.concat(p["given"], x)))

    return tx.bound(F.transform(tests, output_parts), changed)


def diverse(scored: Column) -> Column:
    """O5 within one row: tests (score, seed, text) from the best one on, each next one the farthest from those before it, by tokens; ties by score, then
    smaller seed, then place."""
    placed = F.transform(scored, lambda s, i: F.struct(s["score"].alias("score"), (-s["seed"]).alias("less"), (-i).alias("place"), s["text"].alias("text")))
    kind = "array<struct<score: double, less: bigint, place: int, text: string>>"
    start = F.struct(F.array().cast(kind).alias("chosen"), placed.cast(kind).alias("rest"))

    def one(state: Column, _: Column) -> Column:
        def ranked(x: Column) -> Column:
            nearest = F.array_min(F.transform(state["chosen"], lambda c: tx.token_distance(x["text"], c["text"])))
            return F.struct(F.coalesce(nearest, F.lit(0.0)).alias("d"), x["score"].alias("score"), x["less"].alias("less"), x["place"].alias("place"), x["text"].alias("text"))

        best = F.array_max(F.transform(state["rest"], ranked))
        own = F.struct(best["score"].alias("score"), best["less"].alias("less"), best["place"].alias("place"), best["text"].alias("text"))
        return F.struct(F.array_append(state["chosen"], own).cast(kind).alias("chosen"), F.filter(state["rest"], lambda x: x["place"] != best["place"]).alias("rest"))

    return F.transform(F.aggregate(placed, start, one)["chosen"], lambda x: x["text"])


def graded(tests: Column, task: Column, quality: str) -> Column:
    """tests as they are ('original'), best ('high') or worst ('low') first, or 'diverse'; ties by a seed of task and test."""
    if quality == "original":
        return tests
    sign = -1 if quality == "low" else 1
    scored = F.zip_with(tests, quality_scores(tests), lambda t, q: F.struct((q * sign).alias("score"), tx.stable_seed(F.concat(task.cast("string"), t)).alias("seed"), t.alias("text")))
    if quality == "diverse":
        return diverse(scored)
    keyed = F.transform(scored, lambda s, i: F.struct((-s["score"]).alias("a"), s["seed"].alias("b"), i.alias("c"), s["text"].alias("text")))
    return F.transform(F.array_sort(keyed), lambda s: s["text"])


def spec_of(condition: str) -> tuple[str, str, int | None]:
    """F23 for a name that is known when a plan is built: base, quality, count (None for all); raises for another name."""
    if condition in tx.CONDITIONS:
        return condition, "original", None
    if found := re.match(tx.COUNTED, condition):
        return found[1], "original", None if found[2] == "all" else int(found[2])
    if found := re.match(tx.GRADED, condition):
        return found[1], found[2], None if found[3] == "all" else int(found[3])
    raise ValueError(f"unknown condition: {condition}")


#: Columns of a task: its id, prompt, dataset, function, imports and signature; its tests, those of another task, and what is prepared for a condition.
TASK = "task_id string, prompt string, dataset string, entry_point string, imports string, signature string, visible array<string>, irrelevant array<string>, condition_tests map<string, array<string>>, condition_prompts map<string, string>"


def _selected(condition: str, prepared: bool) -> tuple[Column, Column]:
    """Tests and prompt of a condition. prepared: the name may be unknown, as all tasks have both ready."""
    ready_tests, ready_prompt = F.try_element_at("condition_tests", F.lit(condition)), F.try_element_at("condition_prompts", F.lit(condition))
    try:
        base, quality, count = spec_of(condition)
    except ValueError:
        if not prepared:
            raise
        missing = F.raise_error(F.lit(f"unknown condition: {condition}"))
        return F.coalesce(ready_tests, missing.cast(_TEXTS)), F.coalesce(ready_prompt, missing.cast("string"))
    if base == "nl_only":
        tests = F.array().cast(_TEXTS)
    elif base == "irrelevant_tests":
        tests = F.coalesce("irrelevant", F.array().cast(_TEXTS))
    elif base == "shuffled_tests":
        tests = shuffled_outputs(F.col("visible"), tx.stable_seed(F.col("task_id")))
    else:
        tests = graded(F.col("visible"), F.col("task_id"), quality)
    tests = F.coalesce(ready_tests, tests if count is None else F.slice(tests, 1, min(count, 2**31 - 1)))
    prompt, dataset, blank = F.col("prompt"), F.col("dataset"), lambda c: F.coalesce(c, F.lit(""))
    if base == "nl_only":
        built = prompt
    elif base == "asserts_only":
        built = tests_only(prompt, dataset, blank("imports"), blank("signature"), tests)
    elif base == "test_names_only":
        built = with_names(prompt, dataset, blank("entry_point"), tests)
    else:
        built = with_tests(prompt, dataset, tests)
    return tests, F.coalesce(ready_prompt, built)


def for_conditions(tasks: DataFrame, conditions: list[str], prepared: bool = False, keep: list[str] | None = None) -> DataFrame:
    """a row for each task (columns as in TASK) and condition: task_id, condition, tests, prompt. One pass over the tasks, without a join. ``keep``: other columns to keep.

    What a task has prepared for a condition goes before what its name asks for. An unknown name raises; with ``prepared`` only for a
    task that has nothing ready for it.
    """
    made = []
    for c in conditions:
        tests, prompt = _selected(c, prepared)
        made.append(F.struct(F.lit(c).alias("condition"), tests.alias("tests"), prompt.alias("prompt")))
    own = ["task_id", *(keep or [])]
    return tasks.select(*own, F.explode(F.array(*made)).alias("_c")).select(*own, "_c.*")
