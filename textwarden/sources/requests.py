"""JSON request bodies, read field by field so that absent, null and wrongly typed fields are told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.operators import validate
from textwarden.util import settle

BAD_BODY = "bad_body"
ERRORS = "errors"


def _field(body: Column, name: str) -> Column:
    """A field of a variant, as a variant; null if the body has no such field."""
    return F.try_variant_get(body, f"$.{name}", "variant")


def _is(value: Column, kind: str) -> Column:
    """Whether a variant is of a JSON kind; false for absent fields."""
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(kind)), F.lit(False))


def _wrong(value: Column, right: Column) -> Column:
    """Whether a field is there, not null, and of another type."""
    return value.isNotNull() & ~F.is_variant_null(value) & ~right


def _number(value: Column) -> Column:
    """A variant as a number: numbers, numbers in quotes, and booleans as 0 and 1; else null."""
    return F.try_variant_get(value, "$", "double")


def parse_typed_requests(df: DataFrame, body: str, batch: bool = False) -> DataFrame:
    """Replace a column of JSON bodies by the request's fields and ``errors``, the reasons to reject it.

    Fields are ``text`` (``texts`` of a ``batch``), ``threshold`` and ``thresholds``; a field in error is null. Reasons
    come in the order of the fields, at most one of each. A body that is missing, broken, repeats a
    field or is no object is ``bad_body`` and has no other reason. A required field is ``missing_<field>`` if it
    is absent, ``null_<field>`` if it is null. The types' reasons are ``text_not_a_string``, ``texts_not_an_array``,
    ``texts_not_strings``, ``threshold_not_a_number``, ``thresholds_not_an_object`` and ``thresholds_not_numbers``;
    thresholds outside of 0 to 1 are ``threshold_out_of_range``, and texts are held to the rules of
    :mod:`textwarden.operators.validate`. Numbers may stand in quotes. Other fields do not count.
    """
    given = [name for name in df.columns if name not in (body, ERRORS)]
    read = settle(df.withColumn("_body", F.try_parse_json(body)), "_body")
    bad = ~_is(F.col("_body"), "OBJECT")
    names = ["texts" if batch else "text", "threshold", "thresholds"]
    read = settle(read.withColumns({f"_{n}": _field(F.col("_body"), n) for n in names}), *[f"_{n}" for n in names])

    main, threshold, thresholds = (F.col(f"_{name}") for name in names)
    number = _number(threshold)
    by_label = F.try_variant_get(thresholds, "$", "map<string,variant>")
    numbers = F.transform_values(by_label, lambda _, v: _number(v))
    in_numbers = F.forall(F.map_values(numbers), lambda x: x.isNotNull())
    required = [
        validate.rule(main.isNull(), f"missing_{names[0]}"),
        validate.rule(F.is_variant_null(main), f"null_{names[0]}"),
    ]
    if batch:
        items = F.try_variant_get(main, "$", "array<variant>")
        strings = F.forall(items, lambda x: _is(x, "STRING"))
        value = F.when(strings, F.transform(items, lambda x: F.try_variant_get(x, "$", "string")))
        required += [
            validate.rule(_wrong(main, _is(main, "ARRAY")), "texts_not_an_array"),
            validate.rule(F.size(items) == 0, "batch_empty"),
            validate.rule(~strings, "texts_not_strings"),
            validate.batch_rules(items)[2],
        ]
    else:
        value = F.when(_is(main, "STRING"), F.try_variant_get(main, "$", "string"))
        required += [validate.rule(_wrong(main, _is(main, "STRING")), "text_not_a_string"), *validate.text_rules(value)[1:]]
    own = [
        validate.rule(_wrong(threshold, number.isNotNull()), "threshold_not_a_number"),
        validate.threshold_rule(number),
    ]
    labels = [
        validate.rule(_wrong(thresholds, _is(thresholds, "OBJECT")), "thresholds_not_an_object"),
        validate.rule(~in_numbers, "thresholds_not_numbers"),
        validate.rule(F.exists(F.map_values(numbers), lambda x: ~x.between(0.0, 1.0)), "threshold_out_of_range"),
    ]
    reasons = F.array_distinct(F.array_compact(F.array(*[F.coalesce(*field) for field in (required, own, labels)])))
    found = {
        ERRORS: F.when(bad, F.array(F.lit(BAD_BODY))).otherwise(reasons),
        names[0]: value,
        "threshold": F.when(number.between(0.0, 1.0), number),
        "thresholds": F.when(in_numbers, numbers),
    }
    out = read.withColumns(found).select(*[n for n in given if n not in found], *found)
    return settle(out, *found)
