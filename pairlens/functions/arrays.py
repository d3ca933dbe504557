"""Array, JSON and flag functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .code import python_text, spaced_json
from .text import strip


def all_true(flags: Column) -> Column:
    """every flag holds; an empty array does, too."""
    return F.forall(flags, lambda x: F.coalesce(x, F.lit(False)))


def sections(flags: Column, sizes: list[Column]) -> list[Column]:
    """consecutive slices of the given sizes."""
    out, start = [], F.lit(1)
    for n in sizes:
        out.append(F.when(n > 0, F.slice(flags, start, n)).otherwise(F.slice(flags, 1, 0)))
        start = start + n
    return out


def both_hold(own: Column, common: Column, expected: Column) -> Column:
    """as many flags as expected, all of them and all common ones true."""
    return (F.size(own) == expected) & all_true(own) & all_true(common)


def json_or_null(text: Column, schema: str) -> Column:
    """parsed JSON, null if it isn't any."""
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema))


def fenced_json(text: Column) -> Column:
    """the JSON text within a reply: a fenced block, or from the first brace or bracket to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1)
    return F.when(F.try_parse_json(F.nullif(strip(fenced), F.lit(""))).isNotNull(), strip(fenced)).when(F.try_parse_json(F.nullif(bare, F.lit(""))).isNotNull(), bare)


def cases(text: Column) -> Column:
    """cases (input, output, testtype) from a JSON array, or from an object of parallel arrays."""
    rows = F.from_json(text, "array<struct<input:string,output:string,testtype:string>>")
    both = F.from_json(text, "struct<inputs:array<string>,outputs:array<string>>")
    zipped = F.zip_with(both["inputs"], both["outputs"], lambda a, b: F.struct(a.alias("input"), b.alias("output"), F.lit(None).cast("string").alias("testtype")))
    return F.when(strip(text).startswith("["), rows).when(both["inputs"].isNotNull(), zipped)


def shown(value: Column) -> Column:
    """a JSON value (variant) as Python shows it: text as it is, null as None, lists and objects with its spaces and quotes; null for no value."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind == "STRING", text).when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(python_text(F.to_json(value)))


def case_text(case: Column) -> Column:
    """a case (JSON text) as it is shown: its input and output, or its stdin and stdout, where it has both; else all of it."""
    v = F.try_parse_json(case)

    def pair(given: str, wanted: str) -> Column:
        a, b = (F.try_variant_get(v, f"$.{k}", "variant") for k in (given, wanted))
        return F.when(a.isNotNull() & b.isNotNull(), F.concat(F.lit(f"{given}: "), shown(a), F.lit(f"\nexpected {wanted}: "), shown(b)))

    return F.coalesce(pair("input", "output"), pair("stdin", "stdout"), F.when(v.isNotNull(), spaced_json(case)), case)


def case_list(text: Column) -> Column:
    """the cases (JSON text each) of an array, of an object's test_cases, or of a single object; what is no object is left out."""
    v = F.try_parse_json(F.nullif(strip(text), F.lit("")))
    listed = F.try_variant_get(v, "$.test_cases", "array<variant>")
    whole = F.try_variant_get(v, "$", "array<variant>")
    own = F.when(listed.isNotNull(), listed).when(whole.isNotNull(), whole).otherwise(F.array(v))
    objects = F.filter(own, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    return F.coalesce(F.transform(objects, lambda x: F.to_json(x)), F.array().cast("array<string>"))


def canonical_lines(text: Column) -> Column:
    """each line as canonical JSON where it parses, trimmed where it doesn't."""
    return F.array_join(F.transform(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n"), lambda x: F.coalesce(F.to_json(F.try_parse_json(F.nullif(strip(x), F.lit("")))), strip(x))), "\n")


def without_inputs(inputs: Column, results: Column, excluded: Column) -> Column:
    """(input, result) pairs whose input isn't excluded; raises if none is left."""
    kept = F.filter(F.arrays_zip(inputs.alias("input"), results.alias("result")), lambda x: ~F.array_contains(excluded, x["0"]))
    return F.when(F.size(kept) > 0, kept).otherwise(F.raise_error(F.lit("no tests left")).cast("array<struct<`0`:string,`1`:string>>"))


def json_type(text: Column) -> Column:
    """structural type of a JSON value; null if it isn't JSON."""
    return F.schema_of_variant(F.try_parse_json(text))
