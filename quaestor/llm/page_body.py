"""Per-page analysis shared by the main-content and residue operators (pure Python, no Spark).

``analyze(text)`` works on one page at a time and looks only at that page, so that it can run inside
any Arrow batch.  It strips markup, weighs each line by the length of its text, whatever the text says,
sums the weights over a sliding window of lines and takes the surge and dive points of that distribution
as the limits of the main content, relative to how dense the page's text is:

* outside the *outer* points (``OUTER``) nothing is main content;
* between the outer and the *core* points (``CORE``) only lines that have the form of content are: table rows,
  list entries, notes, long paragraphs, but no short loose sentences, whatever they say.

What else does not belong to it is then sorted out line by line, by form and by known phrases.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Number of lines in the sliding window whose text lengths are summed.
WINDOW = 3
#: Shares of the page's usual window sum (its mean, weighted by text) at which the distribution surges and dives.
CORE, OUTER = 0.4, 0.1
#: Characters that a line counts for at most, so that one endless line is not all there is.
MAX_WEIGHT = 240
#: A loose sentence shorter than this needs the core.
SHORT = 90
#: A line with so many words in small letters is a sentence, even without a full stop.
SENTENCE_WORDS = 5

# --- fixed values: phrases by which site furniture is known, in Polish, English and German -----------
#: A line that begins so is furniture.
FURNITURE = (
    # cookies and consent
    "akceptuję wszystkie", "akceptuj wszystkie", "zgadzam się", "accept all", "i agree", "alle annehmen", "alle akzeptieren", "ich stimme zu",
    "dbamy o prywatność", "your privacy", "wir achten", "pozostając na", "by staying on", "mit der nutzung", "używamy plików",
    # languages
    "pl | en", "polski · english", "pl | de", "en | pl", "de | en", "pl en",
    # printing, sharing, following, going up
    "wydrukuj", "drukuj", "print this", "seite drucken", "udostępnij", "podziel się", "share th", "beitrag teilen", "podoba ci się", "like it?",
    "gefällt es", "gefällt ihnen", "gefällt dir", "polub nas", "follow us", "folgen sie", "powrót na górę", "back to top", "nach oben", "zum seitenanfang",
    # counters, ratings, comments, tags
    "czas czytania", "reading time", "lesezeit", "oceń ten", "rate this", "bewerten sie", "liczba odsłon", "liczba wyświetleń", "odwiedzin", "wyświetle",
    "views:", "aufrufe:", "komentarze (", "komentarz (", "comments (", "comment (", "kommentare (", "kommentar (", "tagi:", "etykiety:", "słowa kluczowe:",
    "tags:", "labels:", "keywords:", "filed under", "schlagw", "stichw", "kategoria:", "kategorie:", "category:",
    # bylines and dates of change
    "redakcja:", "redaktion:", "edited by", "opublikował", "opublikowano", "opracował", "posted", "published", "veröffentlicht", "autor:", "author:",
    "verfasst", "data dodania", "dodano", "added on", "hinzugefügt", "ostatnia aktualizacja", "zaktualizowano", "last updated", "updated on", "stand:",
    "zuletzt geändert", "letzte änderung", "data publikacji", "data modyfikacji", "written by", "eingestellt von", "artykuł dodał",
    # addresses of the office, makers, sponsors, rights
    "tel.", "ext.", "durchwahl", "projekt i wykonanie", "design and build", "gestaltung:", "realizacja:", "co-funded", "gefördert", "kofinanziert",
    "serwis współfinansowany", "wszelkie materiały", "all material", "alle inhalte", "alle rechte", "all rights", "wszelkie prawa", "treści mają charakter",
    "contents are for information", "alle angaben ohne", "administratorem danych", "personal data are", "verantwortlich für den datenschutz",
    "masz prawo dostępu", "you may ask to see", "sie können auskunft", "sie haben das recht", "sie dürfen ihre daten", "©", "(c)", "copyright",
    # logging in
    "nie pamiętasz hasła", "forgot your", "kennwort vergessen", "nazwa użytkownika", "user name", "username", "benutzername", "logowanie", "zaloguj",
    "sign in", "log in", "im panel anmelden", "anmeldung im", "anmelden",
    # banners
    "zapraszamy na jubileusz", "join the jubilee", "feiern sie", "wir laden zum jubil", "uwaga, prace serwisowe", "maintenance works in",
    "wartungsarbeiten im bereich", "wartung im bereich", "achtung, wartung", "komunikat specjalny", "special notice", "sondermitteilung", "sonderhinweis",
    "besondere mitteilung",
)
#: A line of at most MAX_FURNITURE characters that holds one of these is furniture.
FURNITURE_INSIDE = ("cookie", "ciastecz", "newsletter", "privacy@", "iod@", "datenschutz@")
FURNITURE_WHOLE = ("anmeldung", "menu", "menü", "szukaj", "search", "suche")
FURNITURE_END = ("gmach główny", "main building", "hauptgebäude", "rundbrief")
MAX_FURNITURE = 220
#: Reader comments.
COMMENT = re.compile(
    r"^(?:go[sś][cć]|guest|gast)\s+\S+,\s.*\d|^\S+\s+(?:pisze|writes|schreibt|napisa[lł]a?|wrote|meint):|^\S+:\s+(?:czy|does|gilt|gelten|is|will)\b.*\?$",
    re.I,
)
#: Headings of link lists; the titles below them lead to other pages.
LINK_HEAD = re.compile(
    r"^(?:powi[aą]zane|zobacz\s+tak[zż]e|zobacz\s+te[zż]|nadchodz[aą]ce\s+wydarzenia|najnowsze\s+wpisy|ostatnie\s+wpisy|popularne|polecamy|czytaj\s+te[zż]|"
    r"related|see\s+also|upcoming(?:\s+events)?|latest\s+posts|recent\s+posts|popular|read\s+more|"
    r"siehe\s+auch|termine|neueste\s+beitr[aä]ge|beliebt(?:e\s+beitr[aä]ge)?|meistgelesen|verwandte?s?(?:\s+beitr[aä]ge)?|weitere\s+beitr[aä]ge|mehr\s+zum\s+thema)\s*:?$",
    re.I,
)
#: Breadcrumbs start at the home page.
CRUMB = re.compile(r"^(?:strona\s+g[lł][oó]wna|home|start|startseite)\s*(?:>|»|/|›|→|::|\|)", re.I)
#: Short notes that belong to a body.
NOTE = re.compile(
    r"^(?:prowadz[aą]c[ya]|opiekun(?:ka)?|zapisy|kontakt|lecturer|tutor|sign-up|leitung|betreuung|anmeldung|dozent(?:in)?|eintrag(?:ung)?|einschreibung)\s*:\s*\S|"
    r"^(?:sala|pok[oó]j|room|raum|zimmer)\s+\d+\w?,\s*\S",
    re.I,
)
#: Beginnings of a body's subheadings, which are not page titles.
SUBHEAD = re.compile(
    r"^(?:kontakt\s+w\s+sprawie|zasady\s+zaliczenia|terminy|zakres|contact\s+about|assessment\s+rules|dates\s+for|scope\s+of|ansprechpartner|termine|umfang|inhalt|pr[uü]fung|pr[uü]fungsregeln|bewertung|leistungsnachweis)(?=\s)",
    re.I,
)
# --- end of fixed values ------------------------------------------------------------------------

_IMAGE = re.compile(r"!\[[^\]]*\]\([^)]*\)")
_LINK = re.compile(r"\[([^\]]*)\]\(([^)\s]*)[^)]*\)")
_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>")
_LEAD = re.compile(r"^(?:[\s>#*•·–—+~-]|\d{1,3}[.)]\s)+")
_TRAIL = " \t\r\n\f\v\u00a0*_#~"
_HIDDEN = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]+")
_WORD = re.compile(r"[^\W_]")
_CLOSED = re.compile(r"[.!?…][\"”»')\]*_]*$")
_MENU = re.compile(r"\s[|·•»]\s")


@dataclass
class Line:
    """One line of a page: ``no`` from 1, visible ``text``, and ``kind``: blank, furniture, link, note, body or title."""

    no: int
    raw: str
    text: str
    kind: str = "blank"
    weight: int = 0
    heading: bool = False


@dataclass
class Page:
    lines: list[Line]
    body: list[Line] = field(default_factory=list)
    heading: list[Line] = field(default_factory=list)


def visible(raw: str, hidden: bool = True) -> tuple[str, int]:
    """The text of a line without markup and, if there are ``hidden`` characters, without those, and how many of its characters are link text."""
    s, linked = raw, 0
    if "](" in s:
        s = _IMAGE.sub(" ", s)
        linked = sum(len(m.group(1)) for m in _LINK.finditer(s))
        s = _LINK.sub(r"\1", s)
    if "<" in s:
        s = _TAG.sub(" ", s)
    s = _LEAD.sub("", s)
    s = s.rstrip(_TRAIL)
    if hidden:
        s = _HIDDEN.sub("", s)
    return " ".join(s.split()), linked


def _kind(raw: str, text: str, linked: int) -> str:
    if not text or not _WORD.search(text):
        return "blank" if not raw or raw.isspace() else "rule"
    if linked and linked >= 0.6 * len(text):
        return "link"
    closed = text.count(" ") >= 3 and _CLOSED.search(text[-12:]) is not None
    if len(text) > MAX_FURNITURE:
        return "body" if closed or not _MENU.search(text) else "furniture"
    low = text.lower()
    if low in FURNITURE_WHOLE or low.startswith(FURNITURE) or low.endswith(FURNITURE_END):
        return "furniture"
    if raw.lstrip(" \t>*_").startswith("|") and raw.count("|") >= 3:
        return "body"
    if any(x in low for x in FURNITURE_INSIDE) or COMMENT.search(text) or CRUMB.search(text):
        return "furniture"
    if closed:
        return "body"
    if len(text) < 40 and LINK_HEAD.match(text):
        return "linkhead"
    if NOTE.match(text):
        return "note"
    if _MENU.search(text):
        return "furniture"
    if len(text) >= 160 or (len(text) >= 30 and sum(w.strip(".,;:()").islower() for w in text.split()) >= SENTENCE_WORDS):
        return "body"
    return "title"


def _weight(text: str, linked: int) -> int:
    """Characters of a line's own text: no link texts, of a menu in one line only the longest entry."""
    if linked:
        if linked >= 0.6 * len(text):
            return 0
    elif _MENU.search(text):
        text = max(_MENU.split(text), key=len)
    return min(len(text) - linked, MAX_WEIGHT)


def lines_of(text: str) -> list[Line]:
    """All lines of a page with their kinds; titles under a link heading are links."""
    out: list[Line] = []
    in_links = False
    hidden = not text.isascii() and _HIDDEN.search(text) is not None
    for no, raw in enumerate(text.split("\n"), 1):
        shown, linked = visible(raw, hidden)
        kind = _kind(raw, shown, linked)
        if kind == "linkhead":
            in_links = True
        elif in_links and kind == "title":
            kind = "link"
        elif kind not in ("link", "linkhead"):
            in_links = False
        out.append(Line(no, raw, shown, kind, _weight(shown, linked), raw.lstrip(" \t>*").startswith("#")))
    return out


def analyze(text: str) -> Page:
    """The main content of one page: its heading and its body lines.

    Null-like input (blank text) gives a page without heading and body.  Very long texts are read
    whole, in time linear in their length.
    """
    lines = lines_of(text)
    page = Page(lines)
    first, before = len(lines), ""
    full = [i for i, x in enumerate(lines) if x.kind != "blank"]  # windows are of lines with something in them
    (start, end), (core_start, core_end) = limits([lines[i].weight for i in full])
    for at in range(start, end):
        i = full[at]
        x = lines[i]
        inside = core_start <= at < core_end or not _loose(x)
        if x.kind in ("body", "note") and inside:
            page.body.append(x)
            first = min(first, i)
        elif x.kind == "title" and first < i and _inner(x, before):
            page.body.append(x)
        if x.kind != "rule":
            before = x.kind
    while page.body and page.body[-1].kind == "title":  # nothing follows that it could head
        page.body.pop()
    page.heading = _heading(lines, first)
    return page


def limits(weight: list[int], core: float = CORE, outer: float = OUTER) -> tuple[tuple[int, int], tuple[int, int]]:
    """The surge and dive points of the line-block distribution, as ranges of lines: the outer and the core one.

    The distribution surges where a window that begins with text reaches the limit, and dives behind the
    last window that ends with text and does.
    """
    n = len(weight)
    block = [sum(weight[i : i + WINDOW]) for i in range(n)]
    total = sum(weight)
    usual = sum(w * b for w, b in zip(weight, block)) / total if total else 0

    def between(share: float) -> tuple[int, int]:
        limit = share * usual
        surge = next((i for i in range(n) if weight[i] and block[i] >= limit), n)
        dive = next((i for i in range(n - 1, -1, -1) if weight[i] and block[max(0, i - WINDOW + 1)] >= limit), -1)
        return surge, dive + 1

    return between(outer), between(core)


#: Lines in the form of a table row, a list entry or a heading.
_FORM = re.compile(r"^[\s>*_]*(?:\||#|[-•+–]\s|\*\s|\d{1,3}[.)]\s)")


def _loose(x: Line) -> bool:
    """A short sentence that stands by itself, not in the form of a table row, list entry or note."""
    return x.kind == "body" and len(x.text) < SHORT and not _FORM.match(x.raw)


def _inner(x: Line, before: str) -> bool:
    """A title between body lines is a subheading unless it follows a link."""
    return before not in ("link", "linkhead") or x.heading or bool(SUBHEAD.match(x.text))


def _heading(lines: list[Line], first: int) -> list[Line]:
    """The titles directly above the body: the nearest one, and those above it while it is a mere subheading."""
    out: list[Line] = []
    i = min(first, len(lines)) - 1
    while i >= 0:
        x = lines[i]
        if x.kind == "title":
            out.insert(0, x)
            if not SUBHEAD.match(x.text):
                break
        i -= 1
    return out
