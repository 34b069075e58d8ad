"""Record validation as one array-of-messages expression."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, functions as F

from ..config import FAILURE_REASONS, NUMERIC_FEATURES, PAYMENT_METHODS, REQUIRED_FEATURES
from .scalars import text, texts

# Number syntax accepted from text input.
_NUMBER = "^(?i)[+-]?([0-9]+[.]?[0-9]*(e[+-]?[0-9]+)?|[.][0-9]+(e[+-]?[0-9]+)?|inf|infinity|nan)$"


@dataclass(frozen=True)
class FieldView:
    """How to look at one field of a record, whatever the container (SQL text)."""

    present: Callable[[str], str]
    is_null: Callable[[str], str]
    number: Callable[[str], str]   # double, NULL when not numeric
    shown: Callable[[str], str]    # as printed in messages


def typed_fields(df: DataFrame) -> FieldView:
    """View over the columns of a table; an absent column counts as missing."""
    types = dict(df.dtypes)

    def number(name: str) -> str:
        if name not in types:
            return "cast(null as double)"
        return number_of_text(name) if types[name] == "string" else f"cast({name} as double)"

    return FieldView(
        present=lambda n: "true" if n in types else "false",
        is_null=lambda n: f"{n} is null" if n in types else "false",
        number=number,
        shown=lambda n: f"cast({n} as string)" if n in types else "cast(null as string)",
    )


def unpack_json(df: DataFrame, value: str) -> DataFrame:
    """Add one struct column ``_<field>`` per required field of a JSON event.

    Parsing to ``MAP<STRING, VARIANT>`` keeps the difference between a missing key and
    a JSON null, and between ``true`` and ``"true"``.
    """
    def field(name: str) -> str:
        item = f"_record[{text(name)}]"
        shown = f"try_variant_get({item}, '$', 'string')"
        return (f"named_struct('present', coalesce(map_contains_key(_record, {text(name)}), false), "
                f"'is_null', coalesce(is_variant_null({item}), false), 'shown', {shown}, "
                f"'flag', case when schema_of_variant({item}) = 'BOOLEAN' then "
                f"try_variant_get({item}, '$', 'boolean') end) _{name}")

    return df.selectExpr("*", f"from_json({value}, 'map<string, variant>') _record").selectExpr(
        "*", *map(field, REQUIRED_FEATURES)).withColumns({
            f"_{n}_number": F.expr(f"case when _{n}.flag is not null then double(int(_{n}.flag)) "
                                   f"else {number_of_text(f'_{n}.shown')} end")
            for n in NUMERIC_FEATURES + ("is_subscription",)})


# View over the columns unpack_json adds.
JSON_FIELDS = FieldView(
    present=lambda n: f"_{n}.present",
    is_null=lambda n: f"_{n}.is_null",
    number=lambda n: f"_{n}_number",
    shown=lambda n: f"_{n}.shown",
)


def number_of_text(value: str) -> str:
    return f"case when trim({value}) rlike '{_NUMBER}' then try_cast(trim({value}) as double) end"


def _number_error(view: FieldView, name: str, rule: str, message: str, integral: bool = False) -> str:
    """First complaint about one numeric field, NULL when it is fine."""
    v = f"({view.number(name)})"
    whole = f"when {v} <> floor({v}) then '{name} must be an integer' " if integral else ""
    return (f"case when {v} is null then '{name} must be numeric' "
            f"when isnan({v}) or abs({v}) = double('infinity') then '{name} must be finite' "
            f"{whole}when not ({v} {rule}) then '{name} {message}' end")


def _domain_error(view: FieldView, name: str, domain: tuple[str, ...]) -> str:
    value = view.shown(name)
    return (f"case when {value} not in ({texts(domain)}) "
            f"then concat('Unsupported {name}: ', {value}) end")


def missing_errors(view: FieldView) -> str:
    """Complaints about absent and NULL fields."""
    return "array_compact(array(" + ", ".join(
        f"case when not {view.present(n)} then 'Missing required feature: {n}' "
        f"when {view.is_null(n)} then '{n} cannot be null' end" for n in REQUIRED_FEATURES) + "))"


def value_errors(view: FieldView) -> str:
    """Complaints about field values, in contract order."""
    number = lambda *args: _number_error(view, *args)
    return "array_compact(array(" + ", ".join([
        number("payment_amount", "> 0", "must be greater than 0"),
        number("customer_tenure_months", ">= 0", "must be >= 0"),
        number("past_successful_payments", ">= 0", "must be >= 0", True),
        number("past_failed_payments", ">= 0", "must be >= 0", True),
        number("historical_success_rate", "between 0 and 1", "must be between 0 and 1"),
        number("time_since_last_success_days", ">= 0", "must be >= 0"),
        number("days_overdue", ">= 0", "must be >= 0"),
        number("recovery_attempts_so_far", ">= 0", "must be >= 0", True),
        number("is_subscription", "in (0, 1)", "must be 0 or 1", True),
        _domain_error(view, "failure_reason", FAILURE_REASONS),
        _domain_error(view, "payment_method", PAYMENT_METHODS),
    ]) + "))"


def with_errors(df: DataFrame, view: FieldView) -> DataFrame:
    """Add ``errors`` and ``is_valid``; missing or NULL fields end validation early."""
    return df.selectExpr("*", f"{missing_errors(view)} _missing").selectExpr(
        "* except (_missing)",
        f"case when size(_missing) > 0 then _missing else {value_errors(view)} end errors",
    ).selectExpr("*", "size(errors) = 0 is_valid")


def probability_error(p: str) -> str:
    """Complaint about a model output, NULL when it is a probability."""
    v = f"try_cast({p} as double)"
    return (f"case when {v} is null then 'prediction probability must be numeric' "
            f"when isnan({v}) or abs({v}) = double('infinity') "
            "then 'prediction probability must be finite' "
            f"when {v} not between 0 and 1 "
            "then 'prediction probability must be between 0 and 1' end")
