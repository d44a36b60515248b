"""Text of pages as column expressions. Patterns keep to what Java and RE2 both know."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from searchlake.functions.stopwords import STOP_WORDS

SPACE = r"[ \t\n\f\r]+"
TAG = r"(?s)<[^>]*>"
SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"
STYLE = r"(?is)<style[^>]*>(.*?)</style>"
COMMENT = r"(?s)<!--.*?-->"
META = r"(?i)<meta[^>]*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
SIGNS = r"[^A-Za-z0-9 \t\n\f\r]"
WORTHY = r"^([a-z]{2,20}|[0-9]{2,4})$"
#: Weight of tokens of scripts and styles (fixed value).
CODE_WEIGHT = 0.001


def without(text: Column, *patterns: str) -> Column:
    """A text with each match of the patterns, in turn, replaced by a space."""
    for p in patterns:
        text = F.regexp_replace(text, p, " ")
    return text


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, without empty ones."""
    return F.filter(F.split(F.lower(without(text, SIGNS)), SPACE), lambda t: t != "")


def is_worth_indexing(token: Column) -> Column:
    """2 to 20 letters, or 2 to 4 digits."""
    return token.rlike(WORTHY)


def tokens(html: Column) -> Column:
    """Tokens of a page's statistics: tags are cut, but scripts and styles stay."""
    return F.filter(words(without(html, TAG)), is_worth_indexing)


def visible_text(html: Column) -> Column:
    return without(html, SCRIPT, STYLE, COMMENT, META, TAG)


def weighted_tokens(html: Column) -> Column:
    """All tokens of a page in order of position, as structs of token and weight.

    Visible words come first with weight 1, then those of scripts and of styles that have at
    least two characters, with CODE_WEIGHT. Tokens that aren't worth indexing keep their places.
    """

    def code(pattern: str) -> Column:
        content = F.array_join(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), " ")
        return F.filter(words(content), lambda t: F.length(t) >= 2)

    seen = F.transform(words(visible_text(html)), lambda t: F.struct(t.alias("token"), F.lit(1.0).alias("weight")))
    hidden = F.transform(F.concat(code(SCRIPT), code(STYLE)), lambda t: F.struct(t.alias("token"), F.lit(CODE_WEIGHT).alias("weight")))
    return F.concat(seen, hidden)


def page_title(html: Column, longest: int | None = None) -> Column:
    """The first title without tags and commas, spaces collapsed; cut only where a length is given."""
    raw = without(F.regexp_extract(html, TITLE, 1), TAG)
    title = F.trim(F.regexp_replace(F.replace(raw, F.lit(","), F.lit(" ")), SPACE, " "))
    return title if longest is None else F.substring(title, 1, longest)


def is_stop_word(token: Column) -> Column:
    return token.isin(STOP_WORDS)


def query_terms(query: str) -> list[str]:
    """A user's query as terms: signs become spaces, letters lower case."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in query).lower().split()


def snippet(html: Column, terms: list[str], before: int = 80, after: int = 350, least: int = 50) -> Column:
    """A part of a page's visible text around the first query term that it holds, or its beginning.

    Terms of one letter are passed over. Texts under `least` characters have no snippet.
    """
    text = F.trim(F.regexp_replace(visible_text(html), SPACE, " "))
    at = F.coalesce(*[F.nullif(F.locate(t, F.lower(text)), F.lit(0)) for t in terms if len(t) >= 2], F.lit(0))
    begin = F.greatest(at - 1 - before, F.lit(0))
    end = F.least(F.greatest(at - 1, F.lit(0)) + after, F.length(text))
    cut = F.concat(F.when(begin > 0, "...").otherwise(""), F.substring(text, begin + 1, end - begin), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(F.length(text) < least, "").otherwise(cut)


def escape_html(text: Column, quotes: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&#39;")] if quotes else [])
    for sign, reference in pairs:
        text = F.replace(text, F.lit(sign), F.lit(reference))
    return text


def highlight(text: Column, terms: list[str], tag: str = "mark") -> Column:
    """A text, escaped, with whole-word matches of terms of at least two letters in a tag."""
    text = escape_html(text)
    wanted = [t for t in dict.fromkeys(terms) if len(t) >= 2]
    return F.regexp_replace(text, rf"(?i)\b({'|'.join(wanted)})\b", f"<{tag}>$1</{tag}>") if wanted else text


def fixed(value: Column, decimals: int) -> Column:
    """A number with a fixed count of decimals; NaN and infinity are 0."""
    finite = F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(value)
    return F.format_string(f"%.{decimals}f", F.round(finite, decimals))
