"""Problem 5: a page's own text apart from what its site puts on every page.

Texts are rendered as a browser lays them out: a tree builder closes the elements that HTML lets
open, leaves out what isn't visible, and emits the text of each block with its source line, with
spacing between blocks, marks of list items and cells of tables in aligned columns. Each emitted
block knows the regions and the structure that it lies in.

What isn't the page's own is judged by layout. Blocks are cut at the ends of sentences, and each
piece is scored by how it stands there: in a region of navigation, in a list, table, code or formula
(which is content), at the edge of the text, with separators, few words, many capitals, no end of a
sentence, the site's name, and on how many sites the same piece, digits aside, stands. The wording is
learned from the collection: words and pairs of words are weighed by the layout of all pieces that
hold them, and once more by the scores that come of that; a piece is foreign if its best run of words
and its layout say so. That finds furniture beside own text, of any language and wording that the
collection has. Known wordings, four languages of notices, menus and buttons, are one more feature,
for collections too small to learn from; it can be left out.

Nulls: a null text has no lines; a null url only means that the name of the site isn't known.
Empty lines are no cases. Repeated rows come out once. Cut tags are no text; the lines after them are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp, log
from html.parser import HTMLParser

import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlake.operators.skew import heavy_key_hashes, salted_join
from searchlake.session import materialize, spread, table

#: Element classes of HTML (fixed values).
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = set("script style head title template noscript iframe object svg select textarea option".split())
BLOCKS = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main nav ol p pre section table td th tr ul".split())
REGIONS = set("nav footer aside".split())
#: Elements whose text is content by its structure, unless they lie in a region.
STRUCTURE = set("li td th dt dd pre code h1 h2 h3 h4 h5 h6".split())
#: What an open element is closed by (fixed values of the standard).
CLOSED_BY = {
    "p": BLOCKS - {"td", "th", "tr", "li", "dd", "dt", "html", "body"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "tr": {"tr", "tbody", "thead", "tfoot"},
    "option": {"option"},
}
SPACES = re.compile(r"\s+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
REGION_NAME = regex.compile(r"(?<![a-z])(?:nav|navbar|navigation|menu|foot|footer|sidebar|aside|breadcrumbs?|cookie|cookies|consent|banner|ads?|advert|promo|share|social|comments?|related|newsletter|legal)(?![a-z])", regex.I)

#: The part of a tag before a line's end, and a tag of several lines: a bare attribute is on the line of what comes before it, a value in quotes may have more lines.
CUT_TAG = regex.compile(r"</?[A-Za-z][^<>\n]*(?=\n)")
LONG_TAG = regex.compile(r"""</?[A-Za-z][\w:-]*+(?:\s+[\w:@.-]++\s*=\s*(?:"[^"<>]*"|'[^'<>]*')|\s+[\w:@.-]++=[^\s"'<>=]++|[ \t]+[\w:@.-]++(?![ \t]*=))*+\s*/?>""")


class Block:
    """A piece of visible text: its source line, text, region, the cell or item that it begins, if it is a link, and if it stands in a structure."""

    __slots__ = ("line", "text", "region", "mark", "link", "structure")

    def __init__(self, line: int, text: str, region: str, mark: str, link: bool = False, structure: bool = False):
        self.line, self.text, self.region, self.mark, self.link, self.structure = line, text, region, mark, link, structure


class Renderer(HTMLParser):
    """Builds the tree of open elements and emits blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, str]] = []  # name, hidden, region
        self.blocks: list[Block] = []
        self.mark = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
            self.open.pop()
        at = {k: v or "" for k, v in attrs}
        if tag in BLOCKS or tag == "br":
            begins_row = self.mark in ("row", "table")
            self.mark = {"li": "item", "td": "cell", "th": "cell", "tr": "row", "table": "table"}.get(tag, "block")
            if self.mark == "cell" and begins_row:
                self.mark = "row"
        if tag in VOID:
            return
        hidden = tag in HIDDEN or "hidden" in at or bool("style" in at and UNSEEN.search(at["style"]))
        named = REGION_NAME.search(at.get("id", "") + " " + at.get("class", "") + " " + at.get("role", "")) if tag in BLOCKS else None
        above = self.open[-1] if self.open else ("", False, "")
        region = tag if tag in REGIONS else named[0].lower() if named else above[2]
        self.open.append((tag, hidden or above[1], region))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.mark = self.mark or "block"
        if any(name == tag for name, _, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        _, hidden, region = self.open[-1] if self.open else ("", False, "")
        line = self.getpos()[0]
        names = {name for name, _, _ in self.open}
        pre, link = "pre" in names, "a" in names
        for k, text in enumerate(data.split("\n")):
            if k:
                self.mark = self.mark or "line"
            if not hidden and text.strip():
                self.blocks.append(Block(line + k, text if pre else SPACES.sub(" ", text), region, self.mark, link, bool(names & STRUCTURE)))
                self.mark = ""
            elif not hidden and text and not self.mark and k == 0 and self.blocks:
                self.blocks[-1].text += " "


def without_cut_tags(text: str) -> str:
    """A text without the tags that are cut at a line's end; the parser would take all up to the next `>` for such a tag.

    A tag that goes on in the next lines with attributes alone stays. All lines keep their numbers.
    """
    return CUT_TAG.sub(lambda m: m[0] if LONG_TAG.match(text, m.start()) else "", text)


def render(text: str) -> list[Block]:
    """The visible blocks of a text, which may be a whole page or a cut piece of one."""
    if "<" not in text and "&" not in text:
        return [Block(i, " ".join(x.split()), "", "line") for i, x in enumerate(text.split("\n"), 1) if x.strip()]
    parser = Renderer()
    try:
        parser.feed(without_cut_tags(text))
        parser.close()
    except AssertionError:  # markup that the parser gives up on is text
        return [Block(i, x, "", "line") for i, x in enumerate(text.split("\n"), 1) if x.strip()]
    return parser.blocks


def layout(blocks: list[Block]) -> str:
    """The text of blocks with line breaks between them, list marks, and table columns of equal width."""
    lines: list[str] = []
    rows: list[list[str]] = []

    def close() -> None:
        rows[:] = [[x.rstrip() for x in r] for r in rows]
        widths = [max((len(r[c]) for r in rows if c < len(r)), default=0) for c in range(max(map(len, rows), default=0))]
        lines.extend("  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in rows if r)
        rows.clear()

    for b in blocks:
        if b.mark in ("table", "row", "cell"):
            if b.mark != "cell" or not rows:
                rows.append([])
            rows[-1].append(b.text.lstrip())
        elif not b.mark and rows:
            rows[-1][-1] += b.text
        elif not b.mark and lines:
            lines[-1] += b.text
        else:
            close()
            lines.append(("- " if b.mark == "item" else "") + b.text.lstrip())
    close()
    return "\n".join(x.rstrip() for x in lines)


#: Entries of menus and footers in several languages (fixed values).
MENU = (
    "Home|Start|News|Blog|Forum|Help|About|About us|Contact|Archive|Topics|Events|Maps|Shop|Gallery|Jobs|FAQ|Search|Log in|Log out|Sign in|Sign up|Register|Login|Careers|Support|Docs|Categories|"
    "Sitemap|Press|Imprint|Privacy|Privacy policy|Accessibility|Terms of use|Terms|Cookie settings|Cookies|Legal notice|"
    "Startseite|Über uns|Termine|Kontakt|Archiv|Karte|Impressum|Datenschutz|Barrierefreiheit|Presse|AGB|Suche|Anmelden|"
    "Accueil|Article|Actualités|Villes|Dossiers|Mentions légales|Confidentialité|Plan du site|À propos|Contact|Recherche|"
    "Inicio|Temas|Mapas|Artículo|Noticias|Aviso legal|Privacidad|Contacto|Buscar|"
    "Mail|Print|Feed|Post|Copy link|Share|Imprimir|Drucken|Teilen"
)
_ENTRY = rf"(?:{'|'.join(sorted(set(MENU.split('|')), key=len, reverse=True))})"
_SEPARATOR = r"\s*[|·•»/>,–—]\s*|\s+"
_BUTTON = r"Accept all|Accept|Reject|Reject all|OK, got it|Only necessary|Manage choices|Read our policy|Tout accepter|Tout refuser|En savoir plus|Alle akzeptieren|Ablehnen|Mehr erfahren|Einstellungen öffnen|Aceptar todo|Rechazar|Configurar"

#: What marks a line, or a part of one, as furniture.
FURNITURE = {
    "menu": regex.compile(rf"(?<![\w-]){_ENTRY}(?:(?:{_SEPARATOR}){_ENTRY}){{2,}}(?![\w-])"),
    "entries": regex.compile(r"(?:^|(?<=[.!?…:]\s))\p{Lu}[\p{L}’' ]{1,24}(?:\s+[|·•»]\s+\p{Lu}[\p{L}’' ]{1,24}){2,}\s*$"),
    "two entries": regex.compile(rf"(?:^|(?<=[.!?…]\s)){_ENTRY}\s+[|·•»]\s+{_ENTRY}\s*$"),
    "trail": regex.compile(r"(?:^|(?<=[.!?…]\s))(?:You are here:\s*)?(?:Home|Start|Startseite|Accueil|Inicio)\s*[>»/›]\s*\S|\bYou are here:"),
    "jump": regex.compile(r"(?:^|(?<=[.!?…]\s))(?:Skip to (?:main )?(?:content|navigation)|Jump to (?:navigation|content)|Toggle navigation|Open search|Close ×|Zum Inhalt springen|Aller au contenu principal|Ir al contenido|Saltar al contenido|Back to top|Nach oben|Haut de page|Volver arriba)\b|☰|Back to top ↑|Nach oben ↑|Close ×"),
    "cookies": regex.compile(
        r"\b(?:we|this (?:web)?site|site) uses? cookies\b|\buse of cookies\b|\bcookies help us\b|\bstores? small files on your device\b|\bYour privacy matters to us\b|\b[Dd]iese (?:Website|Seite) verwendet Cookies\b|\b[Nn]ous utilisons des cookies\b|\b[Uu]samos cookies\b|\b[Ww]ir verwenden Cookies\b|\bUtilizamos cookies\b",
        regex.I,
    ),
    "button": regex.compile(rf"(?:^|(?<=[.!?;…–|]\s))(?:{_BUTTON})\s*(?:$|\|)"),
    "legal": regex.compile(r"©|\bCopyright\b|\(c\) \d{4}|\b[Aa]ll rights reserved\b|\b[Tt]ous droits réservés\b|\bAlle Rechte vorbehalten\b|\b[Tt]odos los derechos reservados\b|\bAll content on this (?:web)?site belongs to\b"),
    "advert": regex.compile(r"\bADVERTISEMENT\b|(?:^|(?<=[.!?…]\s))(?:Advertisement|Sponsored content|Sponsored|Anzeige|Publicité|Publicidad)\s*$|^(?:Advertisement|Sponsored content|Anzeige|Publicité|Publicidad)\s+(?=[\p{Lu}\d“¿¡«.])|(?:^|(?<=[.!?…]\s))Ad · "),
    "subscribe": regex.compile(
        r"\b[Ss]ubscribe to our\b|\bJoin [\d,.]+ readers\b|\bsign up free\b|\bCreate an account to read on\b|(?:^|(?<=[.!?…]\s))Get \p{Lu}[^.]* by mail every\b|\b(?:Newsletter|Rundbrief|kostenlos) abonnieren\b|\b[Jj]etzt [^.]{0,40}abonnieren\b|\bAbonnez-vous\b|\bSuscríbete\b|\bSubscribe (?:now|today)\b",
    ),
    "related": regex.compile(r"(?:^|(?<=[.!?…]\s))(?:You may also like|Read next|Related|Most read|Trending now|Recommended|More from \p{Lu}[\p{L} ]*:|À lire aussi|Les plus lus|Lo más leído|También te puede interesar|Das könnte Sie auch interessieren|Mehr zum Thema|Meistgelesen|Auch interessant|Lesen Sie auch|Articles liés|Te puede interesar)(?=[\s:–-]|$)"),
    "share": regex.compile(r"(?:^|(?<=[.!?…]\s))(?:Share(?: this(?: page| article)?)?:|Spread the word\b|Follow (?:us|\p{Lu}[\p{L} ]*) on\b|Compartir en\b|Partager(?: sur)?\b|Teilen(?: auf)?\b)"),
    "comment": regex.compile(r"\b\d[\d,.]* comments?\b\s*[–|-]|\blog in to (?:answer|reply|comment)\b|\bLeave a (?:reply|comment)\b|\bYour mail address will not be published\b|\bYour email address will not be published\b|\bWas this (?:page|article) helpful\b|\bReport a (?:problem|bug) with this page\b"),
    "tags": regex.compile(r"(?:^|(?<=[.!?…]\s))(?:Tags?|Filed under|Categories|Schlagwörter|Mots-clés|Etiquetas|Posted in)\s*[:»]\s*\S"),
    "engine": regex.compile(r"(?:^|(?<=[.!?…]\s))(?:Powered by \p{Lu}|Site built with \p{Lu}|Page loaded in \d|Proudly (?:powered|presented) by|Last (?:updated|modified)\b)"),
}

#: Words of a title that a site puts around the page's own.
SECTION = r"(?:Home|Start|Topics|Articles|Archive|Blog|News|Forum|Help|Guides?|Docs|Pages|Posts|Sections?|Magazine|Startseite|Themen|Artikel|Accueil|Dossiers|Inicio|Temas)"
TITLE = {
    "trail": regex.compile(rf"^{SECTION}\s*[>»/›|]\s|\s[>»/›]\s{SECTION}\s*$|^{SECTION}\s[-–:]\s"),
    "section": regex.compile(rf"\s[-–|·]\s{SECTION}(?:\s[-–|·]\s|\s*$)"),
    "call": regex.compile(r"[|(–—·-]\s*(?:Sign in|Sign up|Log in|Log in or register|Register|Subscribe(?: today| now)?|Read more|Print|Share|Login|Join(?: now| free)?|Advertisement|Sponsored)\b[^|]*\)?\s*$|^Skip to (?:main )?content\b|^(?:Sign in|Log in|Subscribe(?: today| now)?|Advertisement|Sponsored)\s*[|:–-]\s|^\(\d+\)\s|☰|^Menu\b|©"),
    "page": regex.compile(r"\bPage \d+ of \d+\b|\bSeite \d+ von \d+\b"),
    "address": regex.compile(r"@\s*(?:[\w-]+\.)+[a-z]{2,}\s*$|[|·–—-]\s*(?:www\.)?[\w-]+(?:\.[\w-]+)*\.(?:example|test|invalid|com|org|net)\s*$"),
}
#: The name of a site whose url isn't known: a name and a usual second word (fixed values).
_SITE = r"\p{Lu}\p{L}+\s(?:Review|Hub|Wiki|Online|Atlas|Gazette|Labs|Museum|Forum|Daily|Notes|Archive|Press|Times|Journal|Portal|Magazine)"
_EDGE = r"\s*(?:\||·|•|–|—|-|::|:|«|»|@|/|>|,)\s*"


HOST = re.compile(r"[a-z]+://([^/:?#]+)")
ODD_SIGNS = re.compile(r"[\s​\"<(]")


def site_label(url: str | None) -> str | None:
    """The name in a url's host before its last part, in lower case."""
    m = HOST.match(ODD_SIGNS.sub("", url or "").lower())
    parts = m[1].split(".") if m else []
    return parts[-2] if len(parts) >= 2 else None


def title_is_dressed(title: str, label: str | None) -> str | None:
    """Why a title holds more than the page's own, or null."""
    for why, pattern in TITLE.items():
        if pattern.search(title):
            return why
    if label:
        name = rf"{regex.escape(label)}(?:\s\p{{Lu}}\p{{L}}*){{0,3}}"
        if regex.search(rf"^{name}{_EDGE}\S|\S(?:\s*(?:\||·|•|–|—|::|«|»|@|/|>|,)|\s+-)\s*{name}\s*$", title, regex.I):
            return "site"
    elif regex.search(rf"\S\s+(?:\||·|–|—|-|::|«)\s+{_SITE}\s*$|^{_SITE}(?:\s+(?:\||·|–|—|-|::|«|»)|:)\s+\S", title):
        return "site"
    return None


def line_furniture(text: str) -> str | None:
    """Why a line holds more than the page's own, or null."""
    for why, pattern in FURNITURE.items():
        if pattern.search(text):
            return why
    return None


def judged_lines(text: str) -> list[tuple[int, str, str | None]]:
    """(line number, visible text, why it is furniture or null) of each line with visible text."""
    lines: dict[int, list[Block]] = {}
    for b in render(text):
        lines.setdefault(b.line, []).append(b)
    out = []
    for line, blocks in sorted(lines.items()):
        visible = "".join(b.text if not b.mark else f" {b.text}" for b in blocks).strip()
        region = next((b.region for b in blocks if b.region), None)
        out.append((line, visible, region or line_furniture(visible)))
    return out


def page_body(text: str) -> str:
    """The own text of a page or preview, laid out: its rendered lines outside of regions that aren't furniture or links alone."""
    def own(line: list[Block]) -> bool:
        return not any(b.region for b in line) and not all(b.link for b in line) and not line_furniture("".join(b.text for b in line).strip())

    return layout([b for line in rendered_lines(text) if own(line) for b in line])


#: What stands for the name of the site in a piece (a character that texts don't use).
SITE = "\ue000"
#: Ends of sentences within a line, tokens, and lines that markup or code makes content.
SENTENCE_END = regex.compile(r"(?<=[.!?…][\")»”]?)\s+(?=[\p{Lu}\d¿¡«“\"©☰])")
MAY_END = re.compile(r"[.!?…][\")»”]?\s")
TOKEN = re.compile(r"\ue000|[^\W\d_]+(?:['’][^\W\d_]+)*|[|·•»>/©☰↑×–—:;]|\d+|[.!?…]")
CONTENT = re.compile(r"^(?:#{1,6}\s|[|!{}]|[*+;:-]+\s*\S|\d+[.)]\s|```|\\|\[\[|\{\{|>\s|={2,}|\.\.\.$)|[={}\\_`\[\]*^]|\w\(|''|^<|<[\s=]|&\w+;")
ENDED = re.compile(r"[.!?…][\"”»)]?$")
#: Tags that were escaped, or cut at a text's beginning, and are text to a browser.
TAG_TEXT = regex.compile(r"</?[A-Za-z][^<>\n]*>|</?[A-Za-z]\w*$|^(?:[a-z]{1,12}\d?|[\w-]*=\"?[^\s\"<>=]*\"?)/?>")
SEPARATORS = frozenset("|·•»>/☰↑×©")
#: An n-gram is weighed if it is in at least LEAST pieces and in this share of all, which bounds their number.
LEAST, LEAST_SHARE = 3, 1 / 20_000
#: A piece is foreign above this score.
FOREIGN = 3.0
PIECES = "site string, line long, block long, edge boolean, text string, base double, ended boolean, content boolean, region boolean, known boolean"


def rendered_lines(text: str) -> list[list[Block]]:
    """The blocks of each rendered line of a text."""
    lines: list[list[Block]] = []
    for b in render(text):
        if b.mark or not lines:
            lines.append([])
        lines[-1].append(b)
    return lines


def pieces(text: str, label: str | None, known: bool = True) -> list[tuple]:
    """The pieces of a text, as rows of PIECES: `base` is what their own layout says, more for furniture."""
    name = re.compile(re.escape(label), re.I) if label else None
    found, code = [], False
    for block, line in enumerate(rendered_lines(text)):
        visible = "".join(b.text for b in line)
        visible = (TAG_TEXT.sub(" ", visible) if "<" in visible or ">" in visible else visible).strip()
        b = line[0]
        link, structure, region = all(x.link for x in line), all(x.structure for x in line), any(x.region for x in line)
        fence = visible.startswith("```")
        code ^= fence
        for t in SENTENCE_END.split(visible) if MAY_END.search(visible) else (visible,):
            tokens, words, capitals, separators, any_text = [], 0, 0, 0, False
            for x in TOKEN.findall(name.sub(SITE, t) if name and label in t.lower() else t):
                c = x[0]
                if c.isalpha() or x == SITE:
                    capitals += words > 0 and c.isupper()
                    words += 1
                elif c.isdigit():
                    x, any_text = "0", True
                elif x in SEPARATORS:
                    separators += 1
                    any_text = any_text or x in "©☰"
                tokens.append(x)
            if not words and not any_text:
                continue
            content = not region and (fence or code or structure or bool(CONTENT.search(t)))
            ended = bool(ENDED.search(t))
            base = (-3.0 if ended else 1.2) + 1.2 * min(3, separators) + (1.0 if words <= 5 else 0.0 if words < 10 else -1.0)
            base += 1.5 if words > 2 and capitals > 0.6 * (words - 1) else 0.0
            base += 1.0 if SITE in tokens else 0.0
            base += 1.5 if link else 0.0
            # a known wording is no evidence against a sentence of some length
            hit = known and not content and not (ended and len(tokens) >= 7) and line_furniture(t) is not None
            found.append([label, b.line, block, False, " ".join(tokens), base, ended, content, region, hit])
    for at in {0, len(found) - 1} if found else ():
        found[at][3] = True
    return [tuple(f) for f in found]


def _cut(batches: Iterator[pd.DataFrame], known: bool) -> Iterator[pd.DataFrame]:
    names = ["id", *(c.split()[0] for c in PIECES.split(", "))]
    for batch in batches:
        yield pd.DataFrame([(i, *p) for i, url, text in zip(batch["id"], batch["url"], batch["text"]) if text for p in pieces(text, site_label(url), known)], columns=names)


def _sums(batches: Iterator[pd.DataFrame], weights: dict[str, float] | None, most: int = 300_000) -> Iterator[pd.DataFrame]:
    """(gram, n, f): in how many pieces each word and pair of words is, and how foreign these seem; "" stands for all pieces.

    Without weights a piece's layout says how foreign it seems, with them its score.
    """
    sums: dict[str, list[float]] = {}
    for batch in batches:
        for text, n, seed, content in zip(batch["text"], batch["n"], batch["seed"], batch["content"]):
            x = seed if weights is None or content else score(text, seed, weights) - 1.0
            f = 0.0 if content or x < -30 else n / (1.0 + exp(-x))
            words = text.lower().split(" ")
            for g in {"", *words, *map(" ".join, zip(["^", *words], [*words, "$"]))}:
                if g in sums:
                    sums[g][0] += n
                    sums[g][1] += f
                else:
                    sums[g] = [n, f]
        if len(sums) > most:
            yield pd.DataFrame([(g, *v) for g, v in sums.items()], columns=["gram", "n", "f"])
            sums = {}
    yield pd.DataFrame([(g, *v) for g, v in sums.items()], columns=["gram", "n", "f"])


def weigh(alike: DataFrame, total: int, weights: Broadcast | None = None) -> dict[str, float]:
    """The log odds of each frequent n-gram, by how foreign the pieces that hold it seem."""
    counts = alike.mapInPandas(lambda b: _sums(b, weights and weights.value), "gram string, n double, f double").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    found = {r[0]: (r[1], r[2]) for r in counts.where(F.col("n") >= max(LEAST, total * LEAST_SHARE)).collect()}  # at most 1 / LEAST_SHARE times a piece's n-grams
    n_all, foreign = found.pop("", (total, 0.0))
    return {g: log((f + 0.3) / (foreign + 1)) - log((n - f + 0.3) / (n_all - foreign + 1)) for g, (n, f) in found.items()}


def best_run(text: str, weights: dict[str, float]) -> float:
    """The weight of the best run of words that may be furniture: a whole piece or much of it, or a run between capitals or signs."""
    shown = text.split(" ")
    words = ["^", *(w.lower() for w in shown), "$"]
    values = [0.6 * weights.get(f"{a} {b}", -0.3) + (0.4 * weights.get(b, -0.3) if b != "$" else 0.0) for a, b in zip(words, words[1:])]
    best, total, begin = 0.0, 0.0, 0
    for k, v in enumerate(values):
        if total <= 0:
            total, begin = 0.0, k
        total += v
        if total > best and begin < len(shown):
            end = min(k + 1, len(shown))
            bounded = (begin == 0 or not shown[begin][0].islower()) and (end == len(shown) or not shown[end][0].islower())
            if bounded or end - begin >= 0.4 * len(shown):
                best = total
    return best


def score(text: str, seed: float, weights: dict[str, float]) -> float:
    """How foreign a piece is by its best run of words and its layout."""
    return best_run(text, weights) + 0.5 * seed - 2.0


def _judge(batches: Iterator[pd.DataFrame], weights: dict[str, float]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        values = zip(batch["text"], batch["seed"], batch["content"], batch["region"], batch["known"])
        yield batch[[not c and (r or score(t, x, weights) + 6.0 * k > FOREIGN) for t, x, c, r, k in values]]


def foreign_pieces(texts: DataFrame, known: bool = True) -> DataFrame:
    """(id, line, block) of the pieces of texts (id, url, text) that aren't the page's own.

    Equal pieces are scored once, so that no frequent one is a burden. `known` is the feature of known
    wordings.
    """
    kind = dict(texts.dtypes)["id"]
    cut = materialize(spread(texts).mapInPandas(lambda b: _cut(b, known), f"id {kind}, {PIECES}"), "pieces")
    layout_of = ["text", "base", "ended", "content", "region", "known"]
    sites = cut.groupBy(*layout_of, "site").agg(F.count(F.lit(1)).alias("n"), F.count_if("edge").alias("edges"))
    alike = sites.groupBy(*layout_of).agg(F.sum("n").alias("n"), F.sum("edges").alias("edges"), F.count(F.lit(1)).alias("sites"))
    spreading = F.least(F.log2("sites"), F.lit(4.0)) * F.when(F.col("ended"), 0.3).otherwise(1.0) - F.when(F.col("sites") == 1, 0.5).otherwise(0.0)
    seed = F.when(F.col("region"), 6.0).otherwise(F.col("base") + spreading + F.col("edges") / F.col("n") - 0.6 + F.when(F.col("known"), 4.0).otherwise(0.0))
    alike = materialize(alike.select("text", "ended", "content", "region", "known", "n", seed.alias("seed")), "alike")
    total = alike.agg(F.sum("n")).first()[0] or 0
    context = texts.sparkSession.sparkContext
    weights = context.broadcast(weigh(alike, total))
    weights = context.broadcast(weigh(alike, total, weights))
    foreign = alike.mapInPandas(lambda b: _judge(b, weights.value), alike.schema).select("text", "ended", "region", "known").distinct()
    keys = ["text", "ended", "region", "known"]
    candidates = cut.where("NOT content").select("id", "line", "block", *keys)
    found = salted_join(candidates, foreign, keys, ["id", "line"], heavy_key_hashes(candidates, keys, 0.01), how="left_semi")
    return found.select("id", "line", "block")


def _judge_titles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for i, url, title in zip(batch["id"], batch["url"], batch["title"]):
            if title and title.strip():
                visible = " ".join(b.text.strip() for b in render(title))
                if title_is_dressed(visible, site_label(url)) or line_furniture(visible):
                    rows.append((i, "title", 1))
        yield pd.DataFrame(rows, columns=["id", "field_name", "line_no"])


def foreign_lines(df: DataFrame, id_col: str, url: str, title: str, preview: str, known: bool = True) -> DataFrame:
    """(id, field_name, line_no) of each line that isn't the page's own alone."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *[F.col(c).alias(n) for n, c in (("url", url), ("title", title), ("text", preview))])
    titles = spread(rows.select("id", "url", "title")).mapInPandas(_judge_titles, f"id {dict(rows.dtypes)['id']}, field_name string, line_no long")
    lines = foreign_pieces(rows.select("id", "url", "text"), known).select("id", F.lit("preview").alias("field_name"), F.col("line").alias("line_no"))
    return titles.unionByName(lines).distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each line of a preview or title that holds anything that isn't the page's own."""
    found = foreign_lines(table(spark, folder, "search_results"), "result_id", "url", "title", "preview")
    return found.select(F.col("id").alias("result_id"), "field_name", "line_no")


def _bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        bodies = []
        for text, foreign in zip(batch["text"], batch["foreign"]):
            foreign = set() if foreign is None else set(foreign)
            lines = enumerate(rendered_lines(text) if text else [])
            own = [b for k, line in lines if k not in foreign and not any(b.region for b in line) and not all(b.link for b in line) for b in line]
            bodies.append(None if text is None else layout(own))
        yield pd.DataFrame({"id": batch["id"], "body": bodies})


def page_bodies(df: DataFrame, id_col: str, url: str, html: str, known: bool = True) -> DataFrame:
    """(id, body): the own text of each page, laid out: its rendered lines without regions, lines of links alone, and foreign pieces."""
    rows = df.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(html).alias("text"))
    foreign = foreign_pieces(rows.where("id IS NOT NULL AND text IS NOT NULL"), known).groupBy("id").agg(F.collect_set("block").alias("foreign"))
    both = rows.select("id", "text").join(foreign, "id", "left")
    return both.mapInPandas(_bodies, f"id {dict(rows.dtypes)['id']}, body string")


def p5_page_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The main body of each page."""
    return page_bodies(table(spark, folder, "pages"), "page_id", "url", "html").select(F.col("id").alias("page_id"), "body")


QUERIES = {"p5_found": p5_found, "p5_page_bodies": p5_page_bodies}
SQL: dict[str, str] = {}
