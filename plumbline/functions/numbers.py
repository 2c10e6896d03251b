"""Numbers inside text, kept in a canonical form so that two spellings of one value compare equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number, thousands separator, ordinal and numeral patterns.
NUMBER = r"\d+(?:\.\d+)?"
THOUSANDS = r"(?<=\d),(?=\d{3}(?!\d))"
ORDINAL = r"(?m)\*\*?\d+[.、:：]\s|^\s*\d+[.、:：]\s|第\s*\d+\s*[名位条项个]|前\s*\d+\s*[名位条项个]"
RANK_NUMERAL = r"(?:第|排名)\s*([一二两三四五六七八九十]+)"
TOP_N = r"前\s*([一二两三四五六七八九十]+|\d+)\s*[名位]"
PERIOD_IN_ANSWER = r"\d{4}\s*[Qq]\s*[1-4]"
NUMERALS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, even where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def join_thousands(text: Column) -> Column:
    return F.regexp_replace(text, THOUSANDS, "")


def canonical(number: Column) -> Column:
    """Two decimals, then no trailing zeros: ``4.20`` and ``4.2`` are one value, ``7.00`` is ``7``.

    A number with more digits than a decimal holds keeps all of them; only outer zeros go.
    """
    plain = F.round(number.try_cast("decimal(38,6)"), 2).cast("string")
    bare = F.regexp_replace(number, r"^0+(\d)", "$1")
    literal = F.when(F.contains(bare, F.lit(".")), F.regexp_replace(bare, r"\.?0+$", "")).otherwise(bare)
    return F.coalesce(F.regexp_replace(plain, r"\.?0+$", ""), literal)


def canonical_numbers(text: Column) -> Column:
    """Distinct numbers of a text in canonical form, sorted."""
    found = F.regexp_extract_all(join_thousands(text), F.lit(NUMBER), F.lit(0))
    return F.sort_array(F.array_distinct(F.transform(found, canonical)))


def numeral(text: Column) -> Column:
    """Digits, a single numeral, or ``十x``; NULL when it is none of these or no int."""
    one = F.create_map(*[F.lit(x) for pair in NUMERALS.items() for x in pair])
    return (
        F.when(text.rlike(r"^\d+$"), text.try_cast("int"))
        .when(F.length(text) == 1, F.element_at(one, text))
        .when((F.length(text) == 2) & text.startswith("十"), F.lit(10) + F.element_at(one, F.substring(text, 2, 1)))
    )


def answer_numbers(text: Column, with_ranks: bool = True) -> Column:
    """Numbers an answer states: quarter tokens are coordinates, and ``第一`` is the number 1."""
    body = F.regexp_replace(text, PERIOD_IN_ANSWER, " ")
    numbers = canonical_numbers(body)
    if not with_ranks:
        return numbers
    words = F.transform(F.regexp_extract_all(body, F.lit(RANK_NUMERAL), F.lit(1)), lambda w: numeral(w).cast("string"))
    known = F.filter(words, lambda w: w.isNotNull())
    return F.sort_array(F.array_distinct(F.concat(numbers, known)))
