"""Text expressions."""

from pyspark.sql import Column, functions as F

from viewmart.fixed_values import NULL_TOKENS

_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{Lt}"
_INNER_START = f"(?<=[^{_CASED} ])(?=[{_CASED}])"
_MARK = "\uffff "  # a code point that no text may hold, and the space that initcap looks for


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest.

    Any non-letter starts a new word (``top's`` -> ``Top'S``). ``initcap`` only looks at
    spaces, so other starts of words get a marked space first; most texts need none.
    """
    marked = F.initcap(F.regexp_replace(text, _INNER_START, _MARK))
    return F.when(text.rlike(_INNER_START), F.replace(marked, F.lit(_MARK), F.lit(""))).otherwise(F.initcap(text))


def null_tokens_to_null(text: Column) -> Column:
    """NULL for the texts that mean "no value", else the text."""
    return F.when(~text.isin(NULL_TOKENS), text)
