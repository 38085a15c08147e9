"""HTML to text with built-in expressions only."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafwork.functions.text import let, strip

# One left-to-right pass over everything that hides text: comments, processing
# instructions and subtrees whose text is not shown. The name of an element is
# whole: white space, "/" or ">" follow it. An unclosed one runs to the end of the
# document, but for rt and rp, whose end tags are optional: they last to the next
# of them or to the end of their ruby. Possessive quantifiers keep the matcher iterative,
# so a long document cannot exhaust the stack.
HIDDEN_PATTERN = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<(script|style|noscript|template)(?=[\s/>])[^>]*+>.*?(?:</\1\s*+>|\z)"
    r"|<r[tp](?=[\s/>])[^>]*+>.*?(?:</r[tp]\s*+>|(?=<r[tp][\s/>])|(?=</?(?:ruby|rtc)[\s/>])|\z)"
)
# A tag, declaration or bogus comment. Quoted attribute values may hold '>'.
TAG_PATTERN = (
    r"(?s)</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    r"|</?[a-zA-Z][^>]*+>"
    r"|<!(?i:doctype)(?:[^>\[\"']++|\"[^\"]*+\"|'[^']*+'|\[(?:[^\]\"']++|\"[^\"]*+\"|'[^']*+')*+\])*+>"
    r"|<[!?][^>]*+>"
)
# Named references need their semicolon; numeric ones may lack it.
ENTITY_PATTERN = (
    r"&(?:#[xX][0-9a-fA-F]*+;?|#[0-9]*+;?|[a-zA-Z_:][-a-zA-Z0-9_:.]*+;)"
)
COMMON_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0"}


def _entity_table() -> Column:
    """HTML 4 entities by name, from the standard library's table."""
    pairs = ", ".join(f"'{name}', '{chr(code)}'" for name, code in name2codepoint.items())
    return F.expr(f"map({pairs})")


def _code_point(code: Column) -> Column:
    """Character of a numeric reference, nothing if it is none that text may
    hold; UTF-32 decoding builds it natively."""
    allowed = (
        code.isin(9, 10, 13)
        | code.between(0x20, 0xD7FF)
        | code.between(0xE000, 0xFFFD)
        | code.between(0x10000, 0x10FFFF)
    )
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(allowed, char).otherwise("")


def _decode_entity(ref: Column) -> Column:
    body = F.btrim(ref, F.lit("&;"))
    named = F.when(F.lit(False), ref)
    for name, char in COMMON_ENTITIES.items():
        named = named.when(body == name, F.lit(char))
    named = named.otherwise(F.coalesce(F.try_element_at(_entity_table(), body), ref))
    # More than eight hex digits or a number beyond 2**63 stand for no character.
    digits = F.ltrim(F.substr(body, F.lit(3)), F.lit("0"))
    hex_code = F.when(F.char_length(digits) <= 8, F.conv(digits, 16, 10).try_cast("long"))
    return (
        F.when(body.startswith("#x") | body.startswith("#X"), _code_point(hex_code))
        .when(body.startswith("#"), _code_point(F.ltrim(F.substr(body, F.lit(2)), F.lit("0")).try_cast("long")))
        .otherwise(named)
    )


def decode_entities(text: Column) -> Column:
    """Single-pass entity decoding, so ``&amp;lt;`` becomes ``&lt;``."""

    def rebuild(t: Column) -> Column:
        refs = F.transform(
            F.regexp_extract_all(t, F.lit(ENTITY_PATTERN), F.lit(0)), _decode_entity
        )
        plain = F.split(t, ENTITY_PATTERN, -1)
        return F.array_join(
            F.zip_with(plain, refs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
        )

    return F.when(F.contains(text, F.lit("&")), let(text, rebuild)).otherwise(text)


def visible_html(html: Column) -> Column:
    """What hides text - comments, subtrees that are not shown - replaced by an empty tag."""
    return F.regexp_replace(html, HIDDEN_PATTERN, "<!>")


def text_nodes(visible: Column) -> Column:
    """Text nodes of visible HTML, stripped, blank ones dropped, one per line."""
    nodes = F.split(visible, TAG_PATTERN, -1)
    texts = F.transform(nodes, lambda n: strip(decode_entities(n)))
    return F.array_join(F.filter(texts, lambda n: n != ""), "\n")


def html_text(html: Column) -> Column:
    """Visible text nodes, stripped, blank ones dropped, one per line."""
    return text_nodes(visible_html(html))
