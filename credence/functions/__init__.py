"""Column expressions: numbers and dates out of untidy strings."""

from credence.functions.parsing import MISSING_TOKENS, coerce_numeric, coerced, missing_to_null, parse_issue_date, parses_as_number

__all__ = ["MISSING_TOKENS", "coerce_numeric", "coerced", "missing_to_null", "parse_issue_date", "parses_as_number"]
