"""Text helpers: Unicode trim, line splitting (E8) and HTML to text.

The fast paths are JVM expressions.  ``with_html_text`` sends to a vectorised
Python helper only the rows whose markup the regular expressions don't read in
full (anything but whole comments, whole script, style and template blocks and
well-formed tags, or an entity that is not on the list), so whole-stage code
generation covers almost every row.
"""

from __future__ import annotations

import html
import html.entities
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal Python's str.strip / str.splitlines behaviour).
# Whitespace removed by str.strip(): Unicode White_Space plus \x1c-\x1f.
WS_CLASS = r"[\s\x{1c}-\x{1f}]"
# Line boundaries of str.splitlines(): \r\n, \n, \r, \v, \f, \x1c, \x1d, \x1e,
# \x85, U+2028, U+2029.
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
# Dropped with their content: comments, script, style, template.
DROP_BLOCKS = (r"(?is)<!--.*?-->|<(script|style|template)(?:\s[^<>]*)?(?<!/)>.*?</\1\s*>")
# A start or end tag whose attribute values are quoted in pairs or plain, or a declaration.
WHOLE_TAG = (r"</?[a-zA-Z][^\s\"'<>/=]*+(?:\s++[^\s\"'<>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'=<>`]++))?+)*+\s*+/?>"
             r"|<![a-zA-Z][^<>\[\]\"']*+>")
# What is left of a block that is not whole.
BLOCK_REST = r"(?i)</?(?:script|style|template)\b"
# Named entities decoded on the fast path (others go to the exact helper).
FAST_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", "\u00a0"), ("&middot;", "·"), ("&copy;", "©"), ("&reg;", "®"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"),
    ("&amp;", "&"),
]
# ---------------------------------------------------------------------------

_FAST_NAMES = "|".join(re.escape(k[1:-1]) for k, _ in FAST_ENTITIES)
# an ampersand that starts something other than a fast-path entity
_OTHER_ENTITY = r"&(?!(" + _FAST_NAMES + r");)(#|[A-Za-z])"


def utrim(c: Column) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(c, rf"(?U)^{WS_CLASS}+|{WS_CLASS}+$", "")


def split_lines(c: Column) -> Column:
    """``[l.strip() for l in c.splitlines() if l.strip()]`` (NULL/empty -> [])."""
    parts = F.split(F.coalesce(c, F.lit("")), LINE_BREAK)
    return F.filter(F.transform(parts, utrim), lambda x: x != "")


def join_lines(arr: Column) -> Column:
    return F.array_join(arr, "\n")


def _decode_fast(c: Column) -> Column:
    for ent, ch in FAST_ENTITIES:  # &amp; last so "&amp;lt;" stays "&lt;"
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def without_tags(c: Column) -> Column:
    """``STRUCT<text, whole>``: the HTML with blocks and whole tags replaced by
    line breaks, and whether that read all of its markup."""
    blocks = F.transform(F.array(c), lambda x: F.regexp_replace(x, DROP_BLOCKS, "\n"))
    both = F.transform(blocks, lambda x: F.struct(F.regexp_replace(x, WHOLE_TAG, "\n").alias("text"),
                                                  x.rlike(BLOCK_REST).alias("rest")))
    return F.transform(both, lambda x: F.struct(
        x["text"].alias("text"),
        (~(x["rest"] | x["text"].contains("<") | x["text"].rlike(_OTHER_ENTITY))).alias("whole")))[0]


def text_lines(stripped: Column) -> Column:
    """The text of ``without_tags`` as trimmed non-blank lines, entities decoded."""
    return join_lines(split_lines(_decode_fast(stripped)))


# Named character references by name (with and without the trailing ";").
_ENTITY_CHARS = {k.rstrip(";"): v for k, v in html.entities.html5.items()}


class _TextNodes(HTMLParser):
    """Collect text nodes the way an HTML tree's ``get_text('\\n')`` does.

    Character references are resolved by the handlers below rather than by
    ``html.unescape``: a known name is decoded with or without ``;`` when
    the parser sees it end, an unknown name stays as written (without its
    ``;``), and a number under 256 is read as windows-1252.

    Whatever is not text ends a text node: tags, comments, declarations.  Text
    within script, style and template is left out, to the end if they aren't closed."""

    _SKIP = {"script", "style", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.parts: list[str] = []
        self._skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in self._SKIP:
            self._skip += 1
        self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self._SKIP and self._skip:
            self._skip -= 1
        self.parts.append("\n")

    def handle_startendtag(self, tag, attrs):
        self.parts.append("\n")

    def handle_comment(self, data):
        self.parts.append("\n")

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self.parts.append("\n")
        if data.upper().startswith("CDATA["):
            self.handle_data(data[6:])
            self.parts.append("\n")

    def handle_data(self, data):
        if not self._skip:
            self.parts.append(data)

    def handle_entityref(self, name):
        self.handle_data(_ENTITY_CHARS.get(name, "&" + name))

    def handle_charref(self, name):
        try:
            code = int(name[1:], 16) if name[:1] in ("x", "X") else int(name)
        except ValueError:
            self.handle_data("&#" + name)
            return
        ch = None
        if code < 256:
            try:
                ch = bytes([code]).decode("windows-1252")
            except UnicodeDecodeError:
                ch = None
        if ch is None:
            try:
                ch = chr(code)
            except (ValueError, OverflowError):
                ch = "\ufffd"
        self.handle_data(ch)


def html_to_text(raw: str | None) -> str | None:
    """Exact E9 on one fragment (stdlib parser); used for gated rows only."""
    if raw is None:
        return None
    p = _TextNodes()
    p.feed(raw)
    p.close()
    text = "".join(p.parts)
    return "\n".join(s.strip() for s in text.splitlines() if s.strip())


@F.pandas_udf(T.StringType())
def _html_to_text_udf(s: pd.Series) -> pd.Series:
    return s.map(html_to_text, na_action="ignore")


def with_html_text(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add, for each ``out: html`` of ``columns``, the HTML fragment's
    trimmed non-blank text lines joined by ``\\n``.

    Staged as columns, so the tags of a row are read once.  Only rows whose
    markup was not read in full reach Python; the helper gets NULL for the others."""
    keep = [c for c in df.columns if c not in columns]
    staged = df.withColumns({f"_{out}": without_tags(F.col(html)) for out, html in columns.items()})
    texts = [F.when(F.col(f"_{out}.whole"), text_lines(F.col(f"_{out}.text")))
              .otherwise(_html_to_text_udf(F.when(~F.col(f"_{out}.whole"), F.col(html)))).alias(out)
             for out, html in columns.items()]
    return staged.select(*keep, *texts)
