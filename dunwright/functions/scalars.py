"""Small reusable expressions: numbers, text, keys and draws."""

from __future__ import annotations

from decimal import Decimal


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(values) -> str:
    """Comma-separated string literals, for IN lists and array()."""
    return ", ".join(text(v) for v in values)


def double(value: float) -> str:
    return f"{float(value)!r}D"


def dec(value: float, precision: int = 14, scale: int = 2) -> str:
    """A decimal literal, so that money comparisons stay exact."""
    return f"cast({Decimal(str(value))} as decimal({precision},{scale}))"


def clip(value: str, low: float, high: float) -> str:
    """Clip to [low, high]; NaN and NULL stay as they are."""
    number = f"cast({value} as double)"
    return (f"case when {number} < {double(low)} then {low} "
            f"when {number} > {double(high)} and not isnan({number}) then {high} "
            f"else {value} end")


def is_finite(value: str) -> str:
    """True for a number that is not NULL, NaN or infinite."""
    number = f"cast({value} as double)"
    return (f"({number} is not null and not isnan({number}) "
            f"and abs({number}) <> double('infinity'))")


def ratio(numerator: str, denominator: str) -> str:
    """numerator/denominator as double, 0 where the denominator is not positive."""
    return (f"(case when ({denominator}) > 0 then cast(({numerator}) as double) / "
            f"cast(({denominator}) as double) else 0.0D end)")


def fixed(value: str, scale: int) -> str:
    """Plain decimal text with ``scale`` digits, ties rounded away from zero."""
    return f"cast(cast(round(cast({value} as decimal(30,8)), {scale}) as decimal(28,{scale})) as string)"


def rupees(value: str) -> str:
    """₹ with two digits and thousands separators."""
    return f"concat('₹', format_number(round(cast({value} as decimal(30,8)), 2), 2))"


def rupees_plain(value: str) -> str:
    """₹ with two digits, no separators."""
    return f"concat('₹', {fixed(value, 2)})"


def keyed_uniform(key: str) -> str:
    """A stable draw in [0, 1): the first 52 bits of SHA-256 of the key."""
    head = f"conv(substring(sha2(cast({key} as string), 256), 1, 13), 16, 10)"
    return f"(cast(cast({head} as bigint) as double) / {double(2 ** 52)})"


def stable_id(kind: str, *parts: str) -> str:
    """A repeatable 32-digit hex identifier, safe under task retries."""
    return f"substring(sha2(concat_ws('|', {text(kind)}, {', '.join(parts)}), 256), 1, 32)"


def audit_id(payment_id: str, strategy: str, timestamp_text: str) -> str:
    """First 16 hex digits of SHA-256 over ``id_strategy_timestamp``."""
    return f"substring(sha2(concat_ws('_', {payment_id}, {strategy}, {timestamp_text}), 256), 1, 16)"


def join_factors(factors: str) -> str:
    return f"concat_ws(' | ', {factors})"


def split_factors(joined: str) -> str:
    """Inverse of :func:`join_factors`; empty text gives an empty array."""
    return (f"case when coalesce({joined}, '') = '' then cast(array() as array<string>) "
            f"else split({joined}, ' [|] ') end")


def utc_text(moment: str = "current_timestamp()") -> str:
    """ISO-8601 UTC text of a timestamp."""
    return (f"date_format(to_utc_timestamp({moment}, current_timezone()), "
            "\"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'\")")


def padded_id(prefix: str, number: str, width: int) -> str:
    return f"concat({text(prefix)}, lpad(cast({number} as string), {width}, '0'))"


def truthy(value: str) -> str:
    """NULL for empty text, the text otherwise."""
    return f"nullif(cast({value} as string), '')"
