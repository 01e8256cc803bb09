"""Is a page left over by the publishing system?  Pure Python, one page at a time, no Spark.

Unfilled placeholders are found by one small grammar per delimiter; error messages, script notices and
filler text by patterns.  What stands in code, in a formula or in a sentence that speaks *about*
templates is discounted.  Placeholders count by density: delimiters of one character, which proper text
uses too, need a second placeholder on the page as a witness, and all of them a share of the words.
Messages count only where they make up most of a page's content, so that a page that merely mentions an
error is kept.
"""

from __future__ import annotations

import re

from quaestor.llm.page_body import Line, Page, analyze

_NAME = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]+)*"
#: One alternative for each pair of delimiters; a placeholder holds one dotted identifier.
PLACEHOLDER = re.compile(
    rf"""
      \{{\{{\s*{_NAME}\s*\}}\}}
    | \{{%-?\s*{_NAME}\s*-?%\}}
    | \$\{{\s*{_NAME}\s*\}}(?!\$)
    | \[\[\s*{_NAME}\s*\]\]
    | (?<![\w\]!\[])\[(?P<square>{_NAME})\](?![(\[\w\]:])
    | @@\s*{_NAME}\s*@@
    | <%=?\s*{_NAME}\s*%>
    | (?<![\w_])__(?P<under>[A-Za-z][A-Za-z0-9.]*(?:_[A-Za-z0-9.]+)*)__(?![\w_])
    | (?<![\w\#&/])\#(?P<hash>[A-Za-z][A-Za-z0-9_.]*)\#(?![\w\#])
    | (?<![\w%])%(?P<percent>[A-Za-z][A-Za-z0-9_.]*)%(?![\w%])
    | <(?P<angle>{_NAME})>
    | (?<![\w{{}}\\^_$\])"'])\{{(?P<brace>[A-Za-z_][\w.]*(?:\ [A-Za-z_][\w.]*){{0,2}})\}}(?![{{\w^_])
    """,
    re.X,
)
_HINT = re.compile(r"[{\[@<%#_]")
_WEAK = ("square", "under", "hash", "percent", "angle", "brace")
#: Placeholders per 100 words from which a page is a template: any, and a single one of a weak kind with a name like ``first_name`` or in a label.
DENSITY, DENSITY_ALONE = 0.1, 0.5

# --- fixed values --------------------------------------------------------------------------------
#: Names in angle brackets that are markup and not placeholders.
HTML_NAMES = frozenset(
    "a abbr address article aside audio b blockquote body br button canvas caption center cite code col dd del details div dl dt em "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark "
    "meta nav ol option p picture pre q s samp script section select small source span strike strong style sub summary sup svg table "
    "tbody td textarea tfoot th thead time title tr tt u ul var video wbr".split()
)
#: Words of sentences that speak about templates, formulas or forms.
ABOUT = re.compile(
    r"szablon|template|vorlage|sk[lł]adni|syntax|symbol\b|\bwrite\b|\bschreib(?:e|en|t)\b|zapis(?:u|em)?\s|oznacza|denotes|bezeichnet|placeholder|platzhalter|"
    r"replaced|zast[eę]p|ersetzt|wpisuje|filled\s+in\s+by|ausgef[uü]llt|eingetragen|tutorial|samouczek|zmienn|variable|\bformu[lł]",
    re.I,
)
#: Whole lines that are messages of a server or an application.
MESSAGE = re.compile(
    r"""
      ^(?:b[lł][aą]d|error|fehler|http)?\s*(?:40[0-9]|41[0-9]|50[0-9])\b(?:\s*[:–-]|\s+(?:forbidden|not\s+found|unauthori[sz]ed|internal|bad\s+(?:gateway|request)|service|gateway|gone))
    | ^(?:b[lł][aą]d|fehler|error)\s+\d{3}\b
    | ^(?:not\s+found|forbidden|access\s+denied|bad\s+gateway|service\s+(?:temporarily\s+)?unavailable|internal\s+server\s+error|gateway\s+time-?out|unauthori[sz]ed)\b
    | ^(?:nie\s+ma\s+takiej\s+strony|strony?\s+nie\s+znaleziono|nie\s+znaleziono\s+strony|die\s+seite\s+.*(?:gibt\s+es\s+nicht|nicht\s+gefunden)|seite\s+nicht\s+gefunden)
    | ^we\s+could\s+not\s+find\s+the\s+page | ^(?:the\s+)?page\s+(?:you\s+.*\s+)?(?:was\s+|could\s+)?not\s+(?:be\s+)?found
    | ^(?:ups|oops|hoppla)\b | \bsomething\s+went\s+wrong\b | \betwas\s+ist\s+schief\s*gegangen\b
    | ^(?:brak\s+dost[eę]pu|dost[eę]p\s+zabroniony|odmowa\s+dost[eę]pu|nie\s+masz\s+uprawnie[nń]|zugriff\s+verweigert|kein\s+zugriff|you\s+(?:do\s+not|don't)\s+have\s+permission)
    | ^wyst[aą]pi[lł]\s+b[lł][aą]d | ^interner\s+serverfehler | ^serverfehler | ^b[lł][aą]d\s+(?:serwera|po[lł][aą]czenia|wewn[eę]trzny) | ^error\s+establishing\b | ^(?:fatal|uncaught)\s+(?:error|exception)\b
    | ^keine\s+verbindung\s+zur\s+datenbank | ^brak\s+po[lł][aą]czenia\s+z\s+baz
    | ^przekroczono\s+(?:czas|limit) | ^zeit[uü]berschreitung | \b(?:request|connection)\s+timed\s+out\b
    | ^(?:sesja|your|ihre|die\s+sitzung|twoja\s+sesja)\b.{0,60}(?:wygas[lł]a|has\s+(?:timed\s+out|expired)|abgelaufen)
    | ^serwis\s+(?:chwilowo\s+|jest\s+)*niedost[eę]pny | ^strona\s+(?:chwilowo\s+)?niedost[eę]pna | ^trwaj[aą]\s+prace\s+(?:techniczne|konserwacyjne)
    | ^wartungsarbeiten:?\s.*\b(?:wieder\s+da|nicht\s+erreichbar)\b | ^der\s+dienst\s+.*nicht\s+(?:verf[uü]gbar|erreichbar) | ^(?:down\s+for|under|scheduled)\s+maintenance\b
    | ^(?:aby|żeby)\s+wy[sś]wietli[cć]\b.*javascript | ^w[lł][aą]cz\s+(?:obs[lł]ug[eę]\s+)?(?:javascript|skrypty) | ^(?:please\s+)?(?:enable|turn\s+on|activate)\s+(?:javascript|scripts)
    | ^(?:this|the)\s+(?:content|page|site|service|resource|item|post|video|document)\s+(?:isn't|is\s+not|is\s+no\s+longer|is\s+(?:currently\s+|temporarily\s+)?un)\s?(?:available|accessible|reachable)
    | ^(?:an?\s+|some\s+)?(?:unexpected\s+|unknown\s+|internal\s+)?error\s+(?:has\s+|have\s+)?(?:occurred|happened)\b | ^javascript\s+(?:must|has\s+to|needs\s+to|should)\s+be\s+(?:turned\s+on|enabled|activated|switched\s+on)
    | ^(?:error:?\s+)?p[aá]gina\s+no\s+(?:encontrada|disponible) | ^no\s+(?:se\s+)?(?:ha\s+|pudimos\s+|hemos\s+)?(?:encontrad[oa]|encontrar|encuentra)\s+la\s+p[aá]gina | ^acceso\s+(?:denegado|restringido)
    | ^(?:ha\s+ocurrido|se\s+ha\s+producido|se\s+produjo)\s+un\s+error | ^(?:habilite|active|activa|habilita)\s+javascript | ^(?:este|el)\s+(?:contenido|servicio|sitio)\s+(?:ya\s+)?no\s+est[aá]\s+disponible | ^javascript\s+(?:debe\s+estar|est[aá])\s
    | ^page\s+(?:introuvable|non\s+trouv[eé]e) | ^acc[eè]s\s+(?:refus[eé]|interdit) | ^une\s+erreur\s+(?:inattendue\s+)?(?:est\s+survenue|s'est\s+produite) | ^(?:veuillez\s+)?active[rz]\s+javascript | ^ce\s+(?:contenu|service|site)\s+(?:n'est\s+pas|n'est\s+plus|est)\s+(?:in)?disponible
    | ^you\s+need\s+to\s+enable\s+javascript | ^bitte\s+aktivieren\s+sie\s+(?:javascript|skripte) | ^ohne\s+(?:skripte|javascript)\s+kann | ^(?:this|diese)\s+(?:site|page|app|seite|anwendung)\s.*(?:requires?|ben[oö]tigt|braucht)\s+(?:scripts|javascript|skripte)
    | ^ta\s+(?:aplikacja|strona)\b.*\bwymaga\s+(?:skrypt[oó]w|javascript) | \bblokuje\s+skrypty\b.*nie\s+mo[zż]e | \bnoscript\s+version\b | javascript\s+(?:is\s+(?:disabled|required)|ist\s+deaktiviert|jest\s+wy[lł][aą]czon)
    | ^(?:checking\s+your\s+browser|sprawdzamy,\s+czy\s+po[lł][aą]czenie|wir\s+pr[uü]fen\s+(?:ihren\s+browser|die\s+verbindung)|ihr\s+browser\s+(?:wird\s+gepr[uü]ft|blockiert))
    | ^(?:verify|potwierd[zź]|bitte\s+best[aä]tigen).{0,30}(?:human|robot|mensch) | ^(?:please\s+)?log\s+in\s+to\s+(?:continue|view|see)\b | ^zaloguj\s+si[eę],?\s+aby | ^bitte\s+melden\s+sie\s+sich\s+an
    """,
    re.I | re.X,
)
#: Lines of filler text put in where the real text was never written.
FILLER = re.compile(
    r"^(?:tu\s+(?:wpisz|wstaw)\s+tekst|tutaj\s+(?:wpisz|wstaw)|do\s+uzupe[lł]nienia\b|tre[sś][cć]\s+w\s+przygotowaniu|strona\s+w\s+(?:budowie|przygotowaniu)|nowa\s+strona\b.*\bbez\s+tytu[lł]u|"
    r"your\s+(?:text|content|title)\s+(?:goes\s+)?here|(?:insert|enter|add)\s+(?:your\s+)?text\s+here|untitled\b|new\s+page\b.*\buntitled|under\s+construction|content\s+coming\s+soon|"
    r"hier\s+steht\s+(?:bald|sp[aä]ter)|(?:hier\s+)?text\s+(?:hier\s+)?einf[uü]gen|neue\s+seite\b.*ohne\s+titel|blindtext|seite\s+im\s+aufbau|noch\s+auszuf[uü]llen|"
    r"todo\b|tbd\b|tba\b|fixme\b|xxx+\b|lorem\s+ipsum\s+dolor)|"
    r"^(\w+)(?:\s+\1){2,}\b",
    re.I,
)
#: Longer lines are held against the patterns sentence by sentence.
MAX_MESSAGE = 240
#: What the further sentences of a long line speak of that begins as a message.
NOTICE = re.compile(
    r"java\s?script|s[ck]ript|skrypt|browser|przegl[aą]dar|cookie|ciastecz|serwer|server|administrator|webmaster|uprawnie|permission|authori[sz]|berechtig|dost[eę]p|access|zugriff|"
    r"zalog|\blog(?:ged)?\s?in\b|sign\s+in|anmeld|eingeloggt|reload|refresh|od[sś]wie[zż]|neu\s+laden|again|ponownie|erneut|later|p[oó][zź]niej|sp[aä]ter|request|[zż][aą]dani|anfrage|"
    r"error|b[lł][aą]d|b[lł][eę]d|fehler|time-?out|exception|stack|\burl\b|adres|address|captcha|robot|firewall|proxy|session|sesj|sitzung|maintenance|wartung|konserwac|technicz|"
    r"unavailable|niedost[eę]pn|verf[uü]gbar|erreichbar|enabled?\b|disabled|w[lł][aą]cz|aktivier|\bpage\b|\bstron|\bseite|support|contact|kontakt",
    re.I,
)
#: The same for a long line that begins as filler.
UNWRITTEN = re.compile(r"\btext|\btekst|inhalt|content|tre[sś][cć]|\bedit|replace|zast[aą]p|ersetz|\bpage\b|\bstron|\bseite|soon|wkr[oó]tce|\bbald\b|folg(?:t|en)|click|klikn|klick|paragraph|akapit|absatz|placeholder|platzhalter", re.I)
#: Frames of a stack trace.
FRAME = re.compile(r"\bat\s+[\w.$<>/]+\s?\([^()\s]*:\d+\)|\bFile\s+\"[^\"]+\",\s+line\s+\d+|(?<!\S)\#\d+\s+(?:\S+\(\d+\)|\{main\})")
#: Diagnostic tails of messages.
TRACE = re.compile(r"^(?:trace|ref|id|request\s+id|incident|kod\s+b[lł][eę]du|error\s+code|fehlercode|vorgangsnummer|stack)\b[:\s]\s*[\w.-]+$", re.I)
#: Frequent short words; a long line without any of them is no text in these languages.
STOPWORDS = frozenset(
    "i w z na do się jest nie że o od przez dla po za jest są oraz lub a ze przy który która które ten ta to jak "
    "the of and to in is for by on at with as be are it this that from or an "
    "der die das und in ist von zu mit den dem des im am auf für bis ein eine es nach bei wird hat steht gibt".split()
)
#: Frequent words of the customary filler text.
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua".split())
#: Frequent short words that Latin has too.
ALSO_LATIN = frozenset("a at do in".split())
# --- end of fixed values ----------------------------------------------------------------------------

_WORDS = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(STOPWORDS)) + r")(?![^\W_])")
_LOREM = re.compile(r"\blorem\b.*\b(?:dolor|ipsum)\b", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
#: Some word of each part of MESSAGE that may stand anywhere in a line; without one, looking at the beginning is enough.
_INSIDE = ("wrong", "schief", "timed", "skrypt", "noscript", "javascript")
_CODE_SPAN = re.compile(r"`[^`]*`|<(code|pre)\b[^>]*>.*?</\1>", re.I)


def placeholders(raw: str) -> tuple[int, int, int]:
    """How many unfilled placeholders a line holds: of strong delimiters, of weak ones, and how many of the latter have a name like ``first_name`` or stand in a mere label.

    None in code spans or in sentences about templates.
    """
    if not _HINT.search(raw):
        return 0, 0, 0
    s = _CODE_SPAN.sub(" ", raw) if ("`" in raw or "<" in raw) else raw
    strong = weak = shaped = 0
    for m in PLACEHOLDER.finditer(s):
        if (m.group("angle") or "").lower() in HTML_NAMES:
            continue
        a, b = m.span()
        start = max(s.rfind(". ", 0, a), s.rfind("! ", 0, a), s.rfind("? ", 0, a)) + 1
        end = s.find(". ", b)
        if ABOUT.search(s[start : end if end >= 0 else len(s)]):
            continue
        name = next((m.group(k) for k in _WEAK if m.group(k)), None)
        if name is None:
            strong += 1
        else:
            weak += 1
            shaped += "_" in name or "." in name or (len(name) > 2 and name.isupper()) or (s.count(" ") < 6 and not s.rstrip().endswith((".", "!", "?")))
    return strong, weak, shaped


def is_template(strong: int, weak: int, shaped: int, words: int) -> bool:
    """Whether a page with so many placeholders among so many words was never filled in."""
    if strong + weak >= 2 or strong:
        return 100 * (strong + weak) >= DENSITY * words
    return bool(shaped) and 100 * weak >= DENSITY_ALONE * words


def is_latin_filler(text: str) -> bool:
    """A long line of words without any frequent word of the known languages whose words recur, or lorem ipsum."""
    if len(text) < 40 or (_STOP.search(text) and not _LOREM.search(text)):
        return False
    words = [w.lower() for w in _WORDS.findall(text)]
    if len(words) < 10:
        return False
    if sum(w in LOREM for w in words) >= max(5, 0.4 * len(words)):
        return True
    return not any(w in STOPWORDS for w in words) and len(set(words)) <= 0.85 * len(words)


def _line_class(x: Line, inside: bool) -> str:
    """What a short line is; only where ``inside``, messages are looked for elsewhere than at its beginning."""
    if MESSAGE.search(x.text) if inside else MESSAGE.match(x.text):
        return "message"
    if FILLER.match(x.text):
        return "filler"
    if TRACE.match(x.text):
        return "trace"
    return "filler" if is_latin_filler(x.text) else "text"


def _begins_lorem(text: str) -> bool:
    return is_latin_filler(text) or (_LOREM.match(text) is not None and FILLER.match(text) is not None)


def _long_line(text: str) -> dict[str, int]:
    """Characters of a long line by class.

    Each sentence goes by itself, so that a paragraph which merely mentions a message stays text.  If the
    line begins as a message or filler, sentences that speak of the same count too; behind a sentence of
    lorem ipsum, all up to the first with a frequent word of the known languages.
    """
    count = {"message": 0, "filler": 0, "text": 0}
    if is_latin_filler(text):
        count["filler"] = len(text)
        return count
    low = text.lower()
    inside, some = any(w in low for w in _INSIDE), "lorem" in low
    frames = ("(" in text or 'File "' in text) and len(FRAME.findall(text)) > 1
    begun, latin = "", False
    for k, s in enumerate(_SENTENCE.split(text)):
        latin = some and (_begins_lorem(s) or (latin and not any(w in STOPWORDS and w not in ALSO_LATIN for w in _WORDS.findall(s.lower()))))
        if latin:
            what = "filler"
        elif (MESSAGE.search(s) if inside else MESSAGE.match(s)) or (frames and FRAME.search(s)):
            what = "message"
        elif FILLER.match(s):
            what = "filler"
        elif (begun == "message" and NOTICE.search(s)) or (begun == "filler" and UNWRITTEN.search(s)):
            what = begun
        else:
            what = "text"
        if not k and not latin:
            begun = what
        count[what] += len(s)
    return count


def residue_kind(page: Page) -> str | None:
    """``placeholder``, ``message`` or ``filler`` for a page to be excluded, None for proper content.

    Blank pages are no cases.  Placeholders count anywhere in heading and body, by their number among the
    words there; messages and filler only where they make up at least half of the content below the heading.
    """
    first = page.heading[0].no if page.heading else 0
    body = {x.no for x in page.body}
    fenced = False
    found = {"message": 0, "filler": 0}
    other = 0
    marks, inside = [0, 0, 0], False
    short: list[Line] = []
    for x in page.lines:
        if x.raw.startswith(("```", "~~~")):
            fenced = not fenced
            continue
        if x.kind not in ("body", "note", "title", "rule", "furniture"):
            continue
        if x.kind != "furniture" and not fenced:
            held = placeholders(x.raw)
            if any(held):  # one in heading or body makes a case, any other one is a witness
                marks = [a + b for a, b in zip(marks, held)]
                inside = inside or x.no in body or x.no >= first
        if x.kind == "rule":
            continue
        if len(x.text) <= MAX_MESSAGE:
            short.append(x)
        else:
            count = _long_line(x.text)
            found["message"] += count["message"]
            found["filler"] += count["filler"]
            other += count["text"] if x.no in body else 0
    if inside and is_template(*marks, sum(x.text.count(" ") + 1 for x in page.lines if x.kind in ("body", "note", "title"))):
        return "placeholder"
    if other > found["message"] + found["filler"] + sum(len(x.text) for x in short):
        return None  # whatever the short lines are, paragraphs outweigh them
    low = "\n".join(x.text for x in short).lower()
    inside = any(w in low for w in _INSIDE)
    for x in short:
        what = _line_class(x, inside)
        if what in found:
            found[what] += max(1, len(x.text))
        elif what == "text" and x.no in body and x.kind != "title":
            other += len(x.text)
    total = found["message"] + found["filler"]
    if total and total >= other:
        return "message" if found["message"] >= found["filler"] else "filler"
    return None


def residue_of(text: str) -> str | None:
    return residue_kind(analyze(text))
