"""Problem 7: markup residue in texts, by template deduction from equivalence classes of tokens.

The delimiters of all texts of a host are its template tokens; words aren't, or else sentences that
pages share would be cut out. Tokens with the same occurrence vector (the same number of times in
each text of the host) form an equivalence class; vectors are compared by order-free fingerprints,
so that none is ever gathered. A class is valid if its tokens come in one order in all texts.

Classes decide what is markup. A delimiter that stands by itself (a tag, a character reference, a
heading's sign, a command) is its own class. One that needs a partner counts where a class holds
both: a valid class of the host with enough support takes in all their occurrences, also those that
stand on different lines; otherwise the tokens are told apart by their role, and only those that
face a partner on their line are in a class with it. Delimiters without a partner are text.

Valid classes are nested, rounds that cross an open one being no part of the template, and the text
is put together from the slots that are left: tokens become marks of headings, items, rows, code and
formulas, or vanish.

Nulls: rows with a null id or text take no part; a null or odd url is a host of its own name "".
Empty texts have no markup. Repeated rows give one row a kind; in supports they count as texts.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.entities import html5
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlake.operators.skew import heavy_key_hashes, salted_join
from searchlake.session import materialize, spread, table

#: Texts of a host in which a class of delimiters on different lines must come to be believed.
LEAST_SUPPORT = 3

#: Names of HTML elements (fixed values).
TAGS = (
    "a abbr address article aside b blockquote body br button caption center cite code col dd div dl dt em fieldset figure font footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html i iframe img input label li link main mark meta nav ol option p pre q s script section select small span strike strong style sub sup table tbody "
    "td textarea tfoot th thead time title tr tt u ul video"
).split()
#: Commands of LaTeX that need no braces to be known (fixed values).
COMMANDS = "item alpha beta gamma delta lambda frac sum prod int sqrt cdot times le ge leq geq ne neq infty ln log text textbf textit emph cite ref label section subsection chapter footnote begin end".split()

#: A delimiter of any kind, real or not. Every sign that the grammars below begin with is one: texts without any are passed over.
LEXEME = regex.compile(
    r"""<!--|<!(?i:doctype)|-->|</?[A-Za-z][\w:-]*|/?>|&(?:\#\w+|\w+);|`+|\*+|(?<!\w)_+|_+(?!\w)|~~|~(?=\\)|(?m:^\#+)|(?m:^={2,})|={2,}(?=\s*$)|(?m:^[;:+>-]+(?=\s))|(?m:^[;:]+)|\[\[|\]\]|\{\{|\}\}|\{\||\|\}|\|-+|\|\||\||!!|!?\[|\]\(|\]|'{2,5}|\\[A-Za-z]+\*?|\\[\[\]()]|\$|\{|\}""",
    regex.M,
)

_NAMES = "|".join(sorted(TAGS, key=len, reverse=True))
TAG = regex.compile(rf"</?(?:{_NAMES})(?:\s[^<>\n]*)?/?>|<!--.*?(?:-->|$)|<!doctype[^>\n]*>?", regex.I | regex.S)
CUT_END = regex.compile(r"</?[A-Za-z][^<>\n]*$", regex.M)
CUT_BEGIN = regex.compile(r"^(?:\.\.\.)?(?:[a-z]{1,12}\d?|(?:[\w-]*=)?\"?[^\s\"<>=]*\"|[\w-]*=\"[^\"<>\n]*\"|--)/?>", regex.M)
ESCAPED = regex.compile(r"&lt;/?\w[^&<>\n]*&gt;")
REFERENCE = regex.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")

MARKDOWN = {
    "heading": regex.compile(r"^#{1,6}[ \t]+\S", regex.M),
    "strong": regex.compile(r"(?<![\*\w\\])(\*{1,3})(?=[^\s*])([^*\n]+?)(?<=[^\s*])\1(?![\*\w])"),
    "stress": regex.compile(r"(?<![\w\\])(_{1,3})(?=[^\s_])([^_\n]+?)(?<=[^\s_])\1(?!\w)"),
    "struck": regex.compile(r"~~(?=\S)([^~\n]+)(?<=\S)~~"),
    "code": regex.compile(r"`[^`\n]+`|^\s*```", regex.M),
    "link": regex.compile(r"!?\[[^\[\]\n]*\]\([^()\s]+(?: [^()\n]*)?\)"),
    "rule": regex.compile(r"^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$", regex.M),
    "row": regex.compile(r"^\|[^|\n]+(?:\|[^|\n]+)+\|\s*$", regex.M),
    "quote": regex.compile(r"^> \S", regex.M),
}
BULLET = regex.compile(r"^\*+ \S", regex.M)

WIKI = {
    "link": regex.compile(r"\[\[[^\[\]\n]+\]\]|\[\[[^\[\]\n]*$|\[https?://\S+ [^\]\n]+\]", regex.M),
    "template": regex.compile(r"\{\{[^{}]+\}\}|\{\{[A-Za-z][^{}\n]*$", regex.M),
    "table": regex.compile(r"^\{\||^\|-+(?:\s[^|\n]*)?$|^\|\}|^[|!][^\n]*(?:\|\||!!)", regex.M),
    "strong": regex.compile(r"(?<!')('{2,5})(?=[^\s'])([^'\n]+)(?<=[^\s'])\1(?!')"),
    "heading": regex.compile(r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*\1\s*$", regex.M),
    "definition": regex.compile(r"^;\s*\S[^:\n]*\s:\s*\S", regex.M),
    "indent": regex.compile(r"^:+\s*\S", regex.M),
}

LATEX = {
    "command": regex.compile(rf"\\(?:{'|'.join(COMMANDS)})\b|\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{{"),
    "display": regex.compile(r"\\\[|\\\(|\\\]|\\\)|\$\$"),
    "inline": regex.compile(r"(?<![\\\w$])\$(?=[^\s$])([^$\n]*[\\^_{}=][^$\n]*|[A-Za-z])(?<=[^\s$])\$(?![\w$])"),
}

#: Delimiters that need a partner (fixed values): the opening one and the closing one.
PARTNERS = {"[[": "]]", "{{": "}}", "[": "](", "[http": "]", "`": "`)", "$": "$)"} | {f"{s}(": f"{s})" for s in (*("*" * k for k in (1, 2, 3)), *("_" * k for k in (1, 2, 3)), "~~", *("'" * k for k in range(2, 6)), *("=" * k for k in range(2, 7)))}
PARTNER_OF = PARTNERS | {b: a for a, b in PARTNERS.items()}

FENCE = regex.compile(r"(?ms)^\s*```[^\n]*\n(.*?)(?:^\s*```\s*?$|\Z)")
CODE_LINES = regex.compile(r"(?ms)^\s*```.*?(?:^\s*```\s*?$|\Z)")
CODE_SPAN = regex.compile(r"`[^`\n]+`")
PRE = regex.compile(r"(?is)<pre>\s*(?:<code>)?(.*?)(?:</code>)?\s*</pre>")
EQUATION = regex.compile(r"\\begin\{equation\*?\}\s*(.*?)\s*(?:\\end\{equation\*?\}|\Z)|\\\[\s*(.*?)\s*\\\]|\$\$\s*(.*?)\s*\$\$", regex.S)
TAG_NAME = regex.compile(r"</?[a-z][a-z0-9]*|<!--|<!doctype", regex.I)
ADDRESS = regex.compile(r"\[(https?://\S+ )[^\]\n]+\]")
NAMED_LINK = regex.compile(r"\[\[(?:Category|File|Image)[^\[\]\n]*\]\]")
LINE_ITEM = regex.compile(r"^(?:[;:]+\s*|(?:[*+-]+|>) )(?=\S)", regex.M)
REFERRED = regex.compile(r"~?\\(?:cite|ref|label|pageref)\{[^{}\n]*\}|\\(?:begin|end)\{[^{}\n]*\}")
BRACED = regex.compile(r"\\(?:text\w*|emph|underline|footnote|mbox|((?:sub)*(?:section|chapter|paragraph)\*?))\{")
ITEM = regex.compile(r"^(?:[;:]+\s*|(?:[*+-]+|>) )(?=\S)", regex.M)
REFERRED = regex.compile(r"~?\\(?:cite|ref|label|pageref)\{[^{}\n]*\}|\\(?:begin|end)\{[^{}\n]*\}")
UNWRAPPED = regex.compile(r"\\(?:text\w*|emph|underline|footnote|mbox)\{$")
SECTION = regex.compile(r"\\(?:sub)*(?:section|chapter|paragraph)\*?\{$")
ITEM = regex.compile(r"^\s*\\item\s*", regex.M)
FLANKS = {
    "*": (regex.compile(r"(?<![\*\w\\])\*{1,3}(?=[^\s*])"), regex.compile(r"(?<=[^\s*])\*{1,3}(?![\*\w])")),
    "_": (regex.compile(r"(?<![\w\\])_{1,3}(?=[^\s_])"), regex.compile(r"(?<=[^\s_])_{1,3}(?!\w)")),
    "'": (regex.compile(r"(?<!')'{2,5}(?=[^\s'])"), regex.compile(r"(?<=[^\s'])'{2,5}(?!')")),
}


class Token(NamedTuple):
    """A delimiter: where it is, its name, its kind of markup, if it needs no partner (0), has one (its number) or lacks one (-1), and what stands for it in the plain text; None keeps it."""

    start: int
    end: int
    name: str
    kind: str
    pair: int
    act: str | None


def _labelled(label: str, body: str) -> str:
    return "\n" + "\n".join(f"[{label}] {x.strip()}" for x in body.strip("\n").split("\n") if x.strip()) + "\n"


def _tag_act(name: str, text: str, start: int) -> str:
    if name in ("<h1", "<h2", "<h3", "<h4", "<h5", "<h6"):
        return "\n[heading] "
    if name in ("<td", "<th"):
        return " ; " if regex.search(r"</t[dh]>\s*$", text[max(0, start - 40) : start], regex.I) else ""
    if name in ("<li", "<tr"):
        return "\n[item] " if name == "<li" else "\n[row] "
    return "\n" if name in ("<br", "</p", "</div", "</ul", "</ol", "</table", "</h1", "</h2", "</h3", "</h4", "</h5", "</h6") else ""


def _closing_brace(text: str, at: int) -> int:
    """Where the brace that was opened before `at` is closed on its line, or -1."""
    depth = 1
    for m in regex.compile(r"[{}\n]").finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m[0], -99)
        if depth <= 0:
            return m.start() if depth == 0 else -1
    return -1


def lex(text: str) -> list[Token]:
    """The delimiters of a text. Whether they are markup is for their classes to say."""
    out: list[Token] = []
    n_pairs = 0

    def lone(start: int, end: int, name: str, kind: str, act: str | None = None) -> None:
        out.append(Token(start, end, name, kind, 0, act))

    def pair(a: int, b: int, c: int, d: int, name: str, kind: str, act: str = "") -> None:
        nonlocal n_pairs
        n_pairs += 1
        out.append(Token(a, b, name, kind, n_pairs, act))
        out.append(Token(c, d, PARTNERS[name], kind, n_pairs, ""))

    def strays(sign: str, opening: regex.Pattern, closing: regex.Pattern, kind: str) -> None:
        """Delimiters without a partner; one that could open and close is left out."""
        taken = {p for t in out if t.pair > 0 and t.name[0] == sign for p in (t.start, t.end)}
        left, right = ([m for m in p.finditer(text) if m.start() not in taken and m.end() not in taken] for p in (opening, closing))
        both = {m.start() for m in left} & {m.start() for m in right}
        for found, side in ((left, "("), (right, ")")):
            out.extend(Token(m.start(), m.end(), m[0] + side, kind, -1, "") for m in found if m.start() not in both and m[0] + side in PARTNER_OF)

    bare = text
    if "`" in text:
        for m in FENCE.finditer(text):
            lone(m.start(), m.end(), "```", "markdown", _labelled("code", m[1]))
        for m in MARKDOWN["code"].finditer(text):
            if m[0].lstrip().startswith("```"):
                lone(m.start(), m.end(), "```", "markdown")
            else:
                pair(m.start(), m.start() + 1, m.end() - 1, m.end(), "`", "markdown")
        blank = lambda m: " " * len(m[0])
        bare = CODE_SPAN.sub(blank, CODE_LINES.sub(blank, text))
    if "<" in text:
        for m in PRE.finditer(text):
            lone(m.start(), m.end(), "<pre", "html", _labelled("code", html.unescape(m[1])))
        for m in TAG.finditer(text):
            name = TAG_NAME.match(m[0])[0].lower()
            lone(m.start(), m.end(), name, "html", _tag_act(name, text, m.start()))
        for m in CUT_END.finditer(text):
            lone(m.start(), m.end(), "<cut", "html", "")
    if ">" in text:
        for m in CUT_BEGIN.finditer(text):
            lone(m.start(), m.end(), "cut>", "html", "")
        for m in MARKDOWN["quote"].finditer(text):
            lone(m.start(), m.end() - 1, ">", "markdown", "[item] ")
    if "&" in text:
        for m in ESCAPED.finditer(text):
            tag = TAG_NAME.match(html.unescape(m[0]))
            lone(m.start(), m.end(), "&lt;", "html", _tag_act(tag[0].lower(), text, m.start()) if tag else "")
        for m in REFERENCE.finditer(text):
            if m[0][1] == "#" or m[0][1:] in html5:
                lone(m.start(), m.end(), "&", "html", html.unescape(m[0]).replace("\xa0", " "))
    if "#" in text:
        for m in MARKDOWN["heading"].finditer(text):
            lone(m.start(), m.end() - 1, "#", "markdown", "[heading] ")
    for sign, names in (("*", ("strong",)), ("_", ("stress",))):
        if sign in text:
            for m in MARKDOWN[names[0]].finditer(text):
                pair(m.start(), m.end(1), m.end(2), m.end(), m[1] + "(", "markdown")
            strays(sign, *FLANKS[sign], "markdown")
    if "~~" in text:
        for m in MARKDOWN["struck"].finditer(text):
            pair(m.start(), m.start() + 2, m.end() - 2, m.end(), "~~(", "markdown")
    if "](" in text:
        for m in MARKDOWN["link"].finditer(text):
            close = text.index("](", m.start())
            pair(m.start(), m.start() + 1 + (m[0][0] == "!"), close, m.end(), "[", "markdown")
    if "|" in text:
        for m in MARKDOWN["rule"].finditer(text):
            lone(m.start(), m.end(), "|---", "markdown", "")
        for m in MARKDOWN["row"].finditer(text):
            end = m.start() + len(m[0].rstrip())
            for c in regex.compile(r"[ \t]*\|[ \t]*").finditer(text, m.start(), end):
                name, act = ("|row", "[row] ") if c.start() == m.start() else ("|end", "") if c.end() == end else ("|cell", " ; ")
                lone(c.start(), c.end(), name, "markdown", act)
    for m in LINE_ITEM.finditer(bare):
        sign = m[0][0]
        kind = "bullet" if sign == "*" and m[0].strip("*") == " " else ""
        if sign in ";:":
            kind = "wiki" if WIKI["indent" if sign == ":" else "definition"].match(bare, m.start()) else ""
        if sign != ">":
            lone(m.start(), m.end(), sign, kind, "[item] ")
    if "[" in bare:
        for m in NAMED_LINK.finditer(bare):
            lone(m.start(), m.end(), "[[name", "wiki", "")
        for m in WIKI["link"].finditer(bare):
            if not m[0].startswith("[["):
                pair(m.start(), m.start() + 1 + len(ADDRESS.match(m[0])[1]), m.end() - 1, m.end(), "[http", "wiki")
            elif m[0].endswith("]]"):
                target = m[0].rfind("|")
                pair(m.start(), m.start() + 2 if target < 0 else m.start() + target + 1, m.end() - 2, m.end(), "[[", "wiki")
            else:
                lone(m.end(), m.end(), "[[cut", "wiki")  # where its partner was cut off
    if "{{" in bare:
        for m in WIKI["template"].finditer(bare):
            if m[0].endswith("}}"):
                lone(m.start(), m.end(), "{{}}", "wiki", "")
            else:
                lone(m.start(), m.end(), "{{cut", "wiki")
    taken = {t.start for t in out if (t.pair > 0 and t.name in ("[[", "]]")) or t.name == "[[name"}
    for sign in ("[[", "]]"):
        at = bare.find(sign)
        while at >= 0:
            if at not in taken and not any(t.start < at < t.end for t in out if t.name == "[[name"):
                out.append(Token(at, at + 2, sign, "wiki", -1, ""))
            at = bare.find(sign, at + 2)
    if "|" in bare or "!!" in bare:
        for m in regex.compile(r"^\{\|[^\n]*$|^\|-[^\n]*$|^\|\}\s*$", regex.M).finditer(bare):
            lone(m.start(), m.end(), m[0][:2], "wiki" if WIKI["table"].match(bare, m.start()) else "", "")
        for m in regex.compile(r"^[|!][^\n]*(?:\|\||!!)[^\n]*$", regex.M).finditer(bare):
            first = m.end() - len(m[0][1:].lstrip())
            lone(m.start(), first, "|wiki", "wiki", "[row] ")
            for c in regex.compile(r"[ \t]*(?:\|\||!!)[ \t]*").finditer(bare, first, m.end()):
                lone(c.start(), c.end(), "||", "wiki", " ; ")
        for m in WIKI["table"].finditer(bare):
            lone(m.start(), m.start(), "|table", "wiki", "")
    if "''" in bare:
        for m in WIKI["strong"].finditer(bare):
            pair(m.start(), m.end(1), m.end(2), m.end(), m[1] + "(", "wiki")
        strays("'", *FLANKS["'"], "wiki")
    if "==" in bare:
        for m in WIKI["heading"].finditer(bare):
            pair(m.start(), m.start(2), m.end(2), m.end(), m[1] + "(", "wiki", "[heading] ")
    if "\\" in bare or "$" in bare:
        for m in EQUATION.finditer(bare):
            lone(m.start(), m.end(), "\\[", "latex", _labelled("formula", m[1] or m[2] or m[3] or ""))
        for m in REFERRED.finditer(bare):
            lone(m.start(), m.end(), "\\ref", "latex", "")
        for m in ITEM.finditer(bare):
            lone(m.start(), m.end(), "\\item", "latex", "[item] ")
        for m in LATEX["command"].finditer(bare):
            lone(m.start(), m.end(), "\\command", "latex")
        for m in BRACED.finditer(bare):
            if (close := _closing_brace(bare, m.end())) >= 0:
                lone(m.start(), m.end(), "\\command", "latex", "[heading] " if m[1] else "")
                lone(close, close + 1, "}", "latex", "")
        for m in LATEX["display"].finditer(bare):
            lone(m.start(), m.end(), "\\display", "latex")
        for m in LATEX["inline"].finditer(bare):
            pair(m.start(), m.start() + 1, m.end() - 1, m.end(), "$", "latex")
    return out


def decided(kinds: set[str]) -> list[str]:
    """Kinds in alphabetical order; bullets are those of Markdown where nothing shows another one with bullets."""
    if "bullet" in kinds:
        kinds = kinds - {"bullet"} | (set() if kinds & {"markdown", "wiki"} else {"markdown"})
    return sorted(kinds)


def kinds_of(text: str) -> list[str]:
    """The kinds of markup of a text that is alone on its host: each partner faces the other, and no class spans lines."""
    return decided({t.kind for t in lex(text) if t.pair >= 0} - {""})


def slots(text: str, tokens: list[Token]) -> str:
    """The slots that tokens leave of a text, with the marks that stand for tokens between them."""
    within = {c for c, _, _ in nest([(t.start, t.name, t.pair, True) for t in tokens if t.pair > 0])}
    out, at = [], 0
    dropped: set[int] = set()
    for t in sorted(tokens, key=lambda t: (t.start, -t.end)):
        if t.act is None:
            continue
        if t.start < at or t.pair in dropped or (t.pair > 0 and t.pair not in within):
            dropped.add(t.pair if t.pair > 0 else -9)
            continue
        out += [text[at : t.start], t.act]
        at = t.end
    whole = "".join([*out, text[at:]])
    return regex.sub(r"\n{2,}", "\n", regex.sub(r"[ \t]+(?=\n|$)", "", regex.sub(r"(\n\[\w+\] )\s+", r"\1", whole))).strip()


def plain_text(text: str) -> str:
    """A text that is alone on its host without its markup. Lines begin with [heading], [item], [code], [row] or [formula] where they were one."""
    return slots(text, [t for t in lex(text) if t.pair >= 0])


def host_of(url: Column) -> Column:
    """A url's host in lower case, "" where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(F.regexp_replace(url, r"[\s\x{200b}\"<(]", "")), r"^[a-z]+://([^/:?#]+)", 1), F.lit(""))

_TOKENS = "array<struct<token:string,kind:string,partner:string,n:bigint,paired:bigint,places:array<int>>>"


def _lex(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for host, i, text in zip(batch["host"], batch["id"], batch["text"]):
            if not LEXEME.search(text):
                continue
            found: dict[tuple[str, str], list[Token]] = {}
            for t in lex(text):
                found.setdefault((t.name, t.kind), []).append(t)
            if found:
                rows.append((host, i, [(name, kind, PARTNER_OF.get(name), len(ts), sum(t.pair >= 0 for t in ts), sorted(t.start for t in ts)) for (name, kind), ts in found.items()]))
        yield pd.DataFrame(rows, columns=["host", "id", "tokens"])


def _vector(count: str) -> Column:
    """A fingerprint of how often a token comes in which texts, whatever their order; of three sums, each far from the end of its range."""
    h = F.xxhash64("id", count)
    part = lambda k: F.sum(F.when(F.col(count) > 0, F.pmod(F.shiftright(h, 21 * k), F.lit(1 << 21))).otherwise(0))
    return F.xxhash64(*[part(k) for k in range(3)])


def classified(texts: DataFrame) -> DataFrame:
    """(host, id, tokens) of texts (host, id, text) with any delimiter: each token with its class.

    A token has class_id, support (texts of its class), in_order, `complete` (its class holds its
    partner too) and `faced` (where it faces a partner on its line, that one is in its class). A host
    has at most as many tokens as there are names, so that its classes are one row.
    """
    kind = dict(texts.dtypes)["id"]
    lexed = materialize(spread(texts).mapInPandas(_lex, f"host string, id {kind}, tokens {_TOKENS}"), "tokens")
    heavy = heavy_key_hashes(lexed.select("host"), ["host"], 0.01)
    each = lexed.select("host", "id", F.explode("tokens").alias("t")).select("host", "id", "t.token", "t.partner", "t.n", "t.paired")
    tokens = each.groupBy("host", "token").agg(_vector("n").alias("vector"), _vector("paired").alias("facing"), F.max("partner").alias("partner"), F.count(F.lit(1)).alias("support"))
    entry = F.struct("token", "partner", F.xxhash64("host", "vector", "support").alias("class_id"), "facing", "support")
    hosts = tokens.groupBy("host").agg(F.collect_list(entry).alias("all"))

    def in_class(x: Column, field: str) -> Column:
        return F.exists("all", lambda y: (y["token"] == x["partner"]) & (y[field] == x[field]))

    known = F.transform("all", lambda x: F.struct(x["token"].alias("key"), F.struct(x["class_id"].alias("class_id"), x["support"].alias("support"), in_class(x, "class_id").alias("complete"), in_class(x, "facing").alias("faced")).alias("value")))
    hosts = hosts.select("host", F.map_from_entries(known).alias("known"))
    named = F.transform("tokens", lambda t: F.struct(*[t[c].alias(c) for c in ("token", "kind", "partner", "paired", "places")], *[F.col("known")[t["token"]][c].alias(c) for c in ("class_id", "support", "complete", "faced")]))
    placed = materialize(salted_join(lexed, hosts, ["host"], ["id"], heavy).select("host", "id", named.alias("tokens")), "classes")

    def round_of(c: Column) -> Column:
        """The names of a class in a text by first place, and if they come in that order round after round."""
        own = F.array_sort(F.transform(F.filter("tokens", lambda t: t["class_id"] == c), lambda t: F.struct(t["places"].alias("p"), t["token"].alias("t"))))
        flat = F.array_sort(F.flatten(F.transform(own, lambda t: F.transform(t["p"], lambda p: F.struct(p.alias("p"), t["t"].alias("t"))))))
        return F.struct(c.alias("class_id"), F.transform(own, lambda t: t["t"]).alias("names"), F.transform(flat, lambda e: e["t"]).alias("each"))

    several = F.array_distinct(F.transform("tokens", lambda t: t["class_id"]))
    rounds = placed.where(F.size(several) < F.size("tokens")).select("host", F.explode(F.transform(several, round_of)).alias("r")).where(F.size("r.names") > 1)
    # regular: the sequence is its first round again and again
    whole = F.flatten(F.array_repeat("r.names", (F.size("r.each") / F.size("r.names")).cast("int")))
    rounds = rounds.select("host", "r.class_id", F.xxhash64("r.names").alias("names"), (whole == F.col("r.each")).alias("regular"))
    broken = rounds.groupBy("host", "class_id").agg((F.every("regular") & (F.min("names") == F.max("names"))).alias("ok")).where("NOT ok")
    broken = broken.groupBy("host").agg(F.collect_list("class_id").alias("broken"))
    judged = salted_join(placed, broken, ["host"], ["id"], heavy, how="left")
    ordered = F.transform("tokens", lambda t: t.withField("in_order", ~F.coalesce(F.array_contains("broken", t["class_id"]), F.lit(False))))
    return judged.select("host", "id", ordered.alias("tokens"))


def token_classes(texts: DataFrame) -> DataFrame:
    """(host, id, token, places, class_id, support, in_order) of each delimiter of texts (host, id, text)."""
    each = classified(texts).select("host", "id", F.explode("tokens").alias("t"))
    return each.select("host", "id", *[f"t.{c}" for c in ("token", "places", "class_id", "support", "in_order")])


def nest(tokens: list[tuple[int, str, int, bool]]) -> list[tuple[int, int, int]]:
    """(class, begin, end) of the rounds of valid classes in a text, each inside of the one before that holds it.

    Rounds that cross an open one aren't part of the template.
    """
    spans: dict[int, list[int]] = {}
    for place, _, c, valid in sorted(tokens):
        if valid:
            spans.setdefault(c, [place, place])[1] = place
    out, open_ends = [], []
    for c, (b, e) in sorted(spans.items(), key=lambda x: (x[1][0], -x[1][1])):
        while open_ends and open_ends[-1] < b:
            open_ends.pop()
        if not open_ends or e <= open_ends[-1]:
            out.append((c, b, e))
            open_ends.append(e)
    return out


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for i, text, kinds, valid, spanning in zip(batch["id"], batch["text"], batch["kinds"], batch["valid"], batch["spanning"]):
            valid, spanning = set(valid), set(spanning)
            tokens = [t for t in lex(text) if t.name in valid and (t.pair >= 0 or t.name in spanning)]
            rows.append((i, list(kinds), slots(text, tokens)))
        yield pd.DataFrame(rows, columns=["id", "kinds", "plain"])


def marked_texts(texts: DataFrame) -> DataFrame:
    """(id, kinds, valid, spanning) of texts (host, id, text) with markup, one row an id.

    A token is markup if it stands by itself, faces a partner of its class, or its valid class holds
    both. `valid` names the tokens that are, `spanning` those that are so without a partner on their line.
    """
    t = F.col("t")
    spans = t["complete"] & t["in_order"] & (t["support"] >= LEAST_SUPPORT)
    each = classified(texts).select("id", F.explode("tokens").alias("t")).withColumn("spans", spans)
    each = each.where(t["partner"].isNull() | ((t["paired"] > 0) & t["faced"]) | F.col("spans")).select("id", "t.token", "t.kind", "spans")
    found = each.groupBy("id").agg(F.collect_set("kind").alias("kinds"), F.collect_set("token").alias("valid"), F.collect_set(F.when(F.col("spans"), F.col("token"))).alias("spanning"))
    others = F.filter("kinds", lambda k: (k != "bullet") & (k != ""))
    bullets = F.array_contains("kinds", "bullet") & ~F.arrays_overlap("kinds", F.array(F.lit("markdown"), F.lit("wiki")))
    kinds = F.array_sort(F.when(bullets, F.concat(others, F.array(F.lit("markdown")))).otherwise(others))
    return found.select("id", kinds.alias("kinds"), "valid", "spanning")


def texts_of(df: DataFrame, id_col: str, url: str, text: str) -> DataFrame:
    """(host, id, text) of the rows that have an id and a text."""
    return df.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(host_of(F.col(url)).alias("host"), F.col(id_col).alias("id"), F.col(text).alias("text"))


def cleaned_texts(df: DataFrame, id_col: str, url: str, text: str) -> DataFrame:
    """(id, kinds, plain) of each text with markup; others are plain already."""
    texts = texts_of(df, id_col, url, text)
    marked = marked_texts(texts).where(F.size("kinds") > 0)
    kind = dict(texts.dtypes)["id"]
    return texts.select("id", "text").join(marked, "id").mapInPandas(_extract, f"id {kind}, kinds array<string>, plain string").dropDuplicates(["id"])


def _previews(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "search_results")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each preview with each kind of markup that it holds."""
    marked = marked_texts(texts_of(_previews(spark, folder), "result_id", "url", "preview"))
    return marked.select(F.col("id").alias("result_id"), F.explode("kinds").alias("markup"))


def p7_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every preview with its plain text; null and empty ones stay as they are."""
    rows = _previews(spark, folder)
    clean = cleaned_texts(rows, "result_id", "url", "preview").select(F.col("id").alias("result_id"), "plain")
    return rows.select("result_id", "preview").join(clean, "result_id", "left").select("result_id", F.coalesce("plain", "preview").alias("text"))


def p7_templates(spark: SparkSession, folder: str) -> DataFrame:
    """The equivalence classes of each host: tokens, number of texts, and if they come in one order."""
    classes = token_classes(texts_of(_previews(spark, folder), "result_id", "url", "preview"))
    found = classes.groupBy("host", "class_id").agg(F.array_sort(F.collect_set("token")).alias("tokens"), F.max("support").alias("n_texts"), F.every("in_order").alias("in_order"))
    return found.select("host", "tokens", "n_texts", "in_order")


QUERIES = {"p7_found": p7_found, "p7_text": p7_text, "p7_templates": p7_templates}
SQL: dict[str, str] = {}
