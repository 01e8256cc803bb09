"""Broken prompt and response pairs: which answers are no proper answer, and why.

Per pair, in Arrow batches: a suffix automaton of the prompt is traversed with the response and gives how
much of it is copied; an Aho-Corasick automaton finds refusals; a stack of delimiters and the shape of
the last statement tell truncation; votes of frequent words tell the languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.languages import COMMON, language, other_than

# --- fixed values --------------------------------------------------------------------------------
#: What stands for "no value".
NO_VALUE = frozenset("none null nil nan n/a na undefined void brak puste empty leer keine nichts tbd todo unknown nieznane unbekannt -".split())
#: Labels and headings that are no content.
LABELS = frozenset(
    "sources source źródła źródło quellen quelle answer odpowiedź antwort question pytanie frage query zapytanie anfrage q a p o f response reply references literatur bibliografia przypisy "
    "context kontekst user assistant asystent użytkownik".split()
)
#: Who refuses, how, and what: a refusal is one of each, in this order, with at most two words between the last two.
_REFUSING = {
    "en": (
        "i|we",
        "cannot|can not|can't|could not|couldn't|won't|will not|would rather not|may not|do not|don't|am not|'m not|are not|am unable|'m unable|are unable|unable|decline|refuse",
        "answer|respond|reply|help|assist|provide|share|give|disclose|reveal|discuss|comment|tell|say|know|have access|have the|have any|have enough|able to|allowed to|permitted to|authori[sz]ed to|to answer|to help|to say",
    ),
    "pl": (
        "nie",
        "mogę|możemy|jestem w stanie|jesteśmy w stanie|potrafię|potrafimy|umiem|wolno mi|wolno nam|będę|udzielam|udzielamy|mam|mamy|posiadam|posiadamy|znam|znamy",
        "odpowied|pom[oó]|udziel|poda|ujawn|przekaz|udostęp|powiedz|rozmawia|komentowa|dostęp|inform|danych|wiedzy|uprawnie|takich|odpowiedzi",
    ),
}
#: Other ways to decline: with the verb at the end, of what is not there, or of what lies outside.
_DECLINING = (
    # English
    r"\b(?:i|we)\b.{0,12}\b(?:must|have to|need to|has to)\s+(?:decline|refuse)\b",
    r"\b(?:outside|beyond|out of)\s+(?:of\s+)?(?:what\s+(?:i|we)\b|my\b|our\b|the\s+scope)",
    r"\b(?:context|sources?|documents?|materials?|texts?)\b.{0,30}\b(?:(?:says?|contains?|mentions?|gives?|holds?)\s+(?:nothing|no)\b|(?:do(?:es)?\s+not|don't|doesn't)\s+(?:say|contain|mention|give|cover|answer))",
    r"\b(?:i|we)\s+(?:have|hold|found|find)\s+no\s+(?:\w+\s+)?(?:access|information|data|details|answer|knowledge)\b|\bno\s+(?:information|data|details)\s+(?:is|are|was|were|on|about|regarding|concerning)\s+(?:this|that|it|available|found|given|the\s+question)\b",
    r"\black(?:s|ing)?\s+the\s+(?:\w+\s+)?(?:data|information|details)\b",
    # Polish
    r"\bmusz(?:ę|ymy)\s+odmówić\b|\bodmawiam(?:y)?\b",
    r"\bwykracza(?:ją)?\s+poza\s+(?:mój|moje|moją|nasz|nasze|zakres|to,?\s+co)",
    r"\b(?:kontekst|źródła|źródło|dokument\w*|materiały)\b.{0,30}\b(?:nic\s+(?:\w+\s+)?(?:o\s+tym|na\s+ten\s+temat)|nie\s+(?:zawiera|mówi|wspomina|podaje|obejmuje))",
    r"\bbrak\s+(?:\w+\s+)?(?:informacji|danych)\s+(?:na\s+ten\s+temat|o\s+tym|w\s+tej\s+sprawie)",
    # German: the negation and the verb stand apart from the modal verb
    r"\b(?:kann|darf|könnte|möchte|werde)\s+ich\b.{0,60}\b(?:nichts?|keine?n?)\b.{0,40}(?:beantwort|antwort|helf|auskunft|geb|mitteil|nenn|sag|teil|besprech|verrat|dien)",
    r"\bich\s+(?:kann|darf|könnte|möchte|werde)\b.{0,60}\b(?:nichts?|keine?n?)\b.{0,40}(?:beantwort|antwort|helf|auskunft|geb|mitteil|nenn|sag|teil|besprech|verrat|dien)",
    r"\b(?:muss|müssen)\b.{0,40}\bablehnen\b|\blehne\b.{0,40}\bab\b|\bfehlen\s+(?:mir|uns)\b|\baußerhalb\s+(?:dessen|meines|unseres)\b|\bübersteigt\s+(?:mein|unser|das,?\s+was)",
    r"\b(?:kontext|quellen?|unterlagen|dokumente?)\b.{0,30}\b(?:nichts|keine)\b|\bhabe(?:n)?\s+(?:ich|wir)?\s*(?:\w+\s+)?keine?n?\s+(?:\w+\s+)?(?:zugriff|informationen|daten|auskunft|angaben)|\b(?:gebe|erteile)\s+(?:ich\s+)?(?:\w+\s+)?keine\b",
    r"\bnicht\s+in\s+der\s+lage\b|\bweiß\s+ich\s+(?:\w+\s+)?nicht\b",
)
#: Parts of words, one of which each way to decline has: what the automaton looks for.
_ANCHORS = (
    "cannot can not can't could not couldn't won't will not rather not may not do not don't am not 'm not are not unable decline refuse outside beyond out of nothing no access no information no data no details "
    "no answer no knowledge says no say no contain mention cover lack not say nie mog nie możem nie jest nie potraf nie umie nie woln nie będ nie udziel nie mam nie posiad nie zna odmówić odmawia wykracza kontekst źródł dokument "
    "materiał brak nicht kein ablehnen lehne fehlen außerhalb übersteigt nichts"
)
#: Beginnings of sentences that go with a refusal and answer nothing.
CLOSINGS = (
    "spróbuj", "proszę skontaktować", "proszę zwrócić", "proszę zapytać", "proszę spytać", "skontaktuj", "zapytaj", "zwróć się", "czy mogę", "czy w czymś", "chętnie pomogę", "dziękuję", "proszę o",
    "przepraszam", "przykro mi", "niestety", "bardzo żałuję", "jako asystent", "napisz do", "w razie pytań", "zadaj inne",
    "please", "try ", "can i", "may i", "is there", "feel free", "sorry", "i'm sorry", "i am sorry", "unfortunately", "i regret", "as an assistant", "thank", "ask ", "contact ", "you may ask", "you could ask",
    "bitte", "kann ich", "versuchen sie", "fragen sie", "wenden sie", "leider", "es tut mir leid", "bedauerlicherweise", "danke", "vielen dank", "als assistent", "stellen sie", "gern", "darf es",
)
#: Turns that lead from a reservation to an answer.
TURNS = re.compile(r"\b(?:ale|lecz|jednak|natomiast|but|still|however|yet|aber|jedoch|doch|dennoch|allerdings)\b[,:]?\s+(.*)", re.I)
#: Abbreviations that cannot end a statement.
OPEN_ABBREVIATION = re.compile(
    r"(?:^|[\s(„\"'])(?:dr|dr\s+inż|dr\s+hab|inż|hab|prof|mgr|np|tzn|tzw|m\.in|ul|al|godz|str|poz|nr|ref|no|mr|mrs|ms|e\.g|i\.e|vs|z\.b|bzw|ca|str|herr|frau|dr\.-ing|doz|tel|zob|por)\.$", re.I
)
#: A German ordinal date that breaks off before the month, or a Polish or English day without one.
OPEN_DATE = re.compile(r"\b(?:am|bis|vom|zum|ab|seit|den|der|do|od|dnia|by|on)\s+\d{1,2}\.$", re.I)
# --- end of fixed values -----------------------------------------------------------------------------

_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad\u180e]+")
_CITE = re.compile(r"\[\s*S?\d+(?:\s*[,;]\s*S?\d+)*\s*\]", re.I)
_SOURCES = re.compile(r"(?:^|\n)[\s*_#>]*(?:sources?|źródł[ao]|quellen?|references)\s*:\**[\s\S]*\Z", re.I)
_WORD = re.compile(r"[^\W_]+")
_MARKUP = re.compile(r"[*_`#>~|{}]+|</?[a-zA-Z][^<>]*>")
_SENTENCE_END = re.compile(r"(?<=[.!?…])[\"”’)*]*\s+")


class SuffixAutomaton:
    """All parts of a sequence of words, for matching another sequence against it in linear time."""

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            cur = self._state({}, self.length[last] + 1)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    twin = self._state(dict(self.next[q]), self.length[p] + 1)
                    self.link[twin] = self.link[q]
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            last = cur

    def _state(self, moves: dict[str, int], length: int) -> int:
        self.next.append(moves), self.link.append(-1), self.length.append(length)
        return len(self.next) - 1

    def copied(self, words: list[str], least: int) -> list[bool]:
        """For each word, whether it lies in a run of at least ``least`` words that the automaton's sequence holds too."""
        out = [False] * len(words)
        state = size = 0
        for k, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                size += 1
            else:
                size = 0
            if size >= least:
                out[k - size + 1 : k + 1] = [True] * size
        return out


_REFUSAL = re.compile(
    "|".join(
        [rf"(?<!\w)(?:{who})(?:\s+(?:really|simply|just|currently|therefore|unfortunately|regrettably|sadly|also))?\s*(?:{how})(?:\s+\w+){{0,2}}?\s+(?:be\s+)?(?:{what})" for who, how, what in [_REFUSING["en"]]]
        + [rf"(?<!\w)(?:{who})\s+(?:{how})(?:\s+\w+){{0,2}}?\s+(?:{what})" for who, how, what in [_REFUSING["pl"]]]
        + list(_DECLINING)
    )
)


@lru_cache(maxsize=1)
def _refusal_automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for m in re.finditer(r"(?:(?:nie|no|do|am|are|may|can|could|will|rather|not|says|say|out|'m)\s+)?\S+", _ANCHORS):
        a.add_word(m.group(0), len(m.group(0)))
    a.make_automaton()
    return a


def refuses(statement: str) -> re.Match | None:
    """Where a statement in small letters declines to answer: the automaton finds the places worth looking at, the grammar decides."""
    return _REFUSAL.search(statement) if next(_refusal_automaton().iter(statement), None) is not None else None


def _visible(text: str) -> str:
    return text if text.isascii() else _INVISIBLE.sub("", text)


def _plain(text: str) -> str:
    """A text without citations and the list of sources behind it."""
    if ":" in text:
        text = _SOURCES.sub(" ", text)
    return _CITE.sub(" ", text) if "[" in text else text


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    if len(answer) > _MOST_EMPTY:
        answer = _plain(answer)
        if len(answer) > _MOST_EMPTY and sum(w not in LABELS for w in _WORD.findall(answer[:_MOST_EMPTY].lower())) > 3:
            return False  # enough words at once
    answer = _visible(answer)
    words = _WORD.findall(_MARKUP.sub(" ", _CITE.sub(" ", answer)).lower())
    rest = _MARKUP.sub(" ", _plain(answer)).strip(" \t\r\n.,:;!?\"'„”“-–—()[]").lower()
    return not words or all(w in LABELS for w in words) or not rest or rest in NO_VALUE or all(w in LABELS for w in _WORD.findall(rest))


#: Longer answers are looked at closely only if their beginning has hardly any words.
_MOST_EMPTY = 200


def is_copy(query: list[str], answer: list[str], copied: list[bool]) -> bool:
    """Nothing but the query: all words but labels are copied, and they cover most of the query."""
    rest = [w for w, c in zip(answer, copied) if not c]
    return bool(query) and any(copied) and all(w in LABELS for w in rest) and sum(copied) >= 0.8 * len(query)


def is_refusal(statements: list[str]) -> bool:
    """Some statement refuses, and every other one only goes with a refusal."""
    refused = False
    for s in statements:
        low = " ".join(s.lower().replace("’", "'").split())
        if not _WORD.search(low):
            continue
        found = refuses(low)
        if found:
            rest = low[found.end() :]
            turn = TURNS.search(rest)
            if turn and len(_WORD.findall(turn.group(1))) >= 3 and not refuses(turn.group(1)):
                return False
            words = _WORD.findall(low)
            if len(words) > 16 and any(any(ch.isdigit() for ch in w) for w in words):
                return False
            refused = True
        elif not low.lstrip("*_->#• ").startswith(CLOSINGS):
            return False
        elif any(ch.isdigit() for ch in low) and len(_WORD.findall(low)) > 12:
            return False
    return refused


def is_truncated(answer: str, query: str = "") -> bool:
    """The last statement or list entry breaks off."""
    text = _visible(answer).rstrip()
    if ":" in text:
        text = _SOURCES.sub("", text).rstrip()
    if text.endswith(("]", "].", "],", "];")):
        text = re.sub(r"(?:\s*\[\s*S?\d+(?:\s*[,;]\s*S?\d+)*\s*\][.,;]?)+$", lambda m: m.group(0)[-1] if m.group(0)[-1] in ".,;" else "", text, flags=re.I).rstrip()
    bare = text.rstrip("*_` \t\r\n")
    if any(re.fullmatch(r"\s*(?:[-*•+–]|\d{1,3}[.)])", x[x.rfind("\n") + 1 :]) for x in (text, bare)):
        return True  # a list entry that was never written
    if not bare:
        return False
    tail = bare.rsplit(None, 1)[-1]
    if re.search(r"(?:https?://|www\.)\S+$|\S+@\S+\.\w+$", tail):
        return False
    if re.search(r"(?:[:;]-?[)D(]|\^\^)$", tail):
        bare = re.sub(r"(?:[:;]-?[)D(]|\^\^)$", "", bare).rstrip()
        return _open_delimiter(bare)
    if _open_delimiter(bare):
        return True
    end = bare[-1]
    if end in ".!?…":
        return bool(OPEN_ABBREVIATION.search(bare[-40:]) or OPEN_DATE.search(bare[-40:]))  # patterns of the end alone
    if end in ",:;-–—/&+(„":
        return True
    if not end.isalnum():
        return False  # closed quotes and brackets, symbols, pictures
    last_line = bare.rsplit("\n", 1)[-1].strip()
    if re.match(r"(?:[-*•+–]|\d{1,3}[.)])\s", last_line):
        return _open_entry(last_line)
    last = _last_statement(last_line)
    last = re.sub(r"^(?:\[\s*S?\d+\s*\]\s*)+", "", last)
    words = last.split()
    if len(words) > 6 or last != bare:
        return True  # a sentence without an end, or one that follows finished ones
    return not (words[-1][0].isupper() or any(ch.isdigit() for ch in words[-1]) or words[0].lower().rstrip(",") in ("tak", "nie", "yes", "no", "ja", "nein") or len(words) <= 2)


def _last_statement(line: str) -> str:
    """What follows the last full stop that is not part of an abbreviation."""
    at = 0
    for m in _SENTENCE_END.finditer(line):
        if not OPEN_ABBREVIATION.search(line[max(0, m.start() - 12) : m.start()]):
            at = m.end()
    return line[at:]


_DELIMITER = re.compile(r"[()\[\]{}„“”\"]")


def _open_delimiter(text: str) -> bool:
    """An opening bracket or quotation mark is left on the stack, and not from a finished sentence long before."""
    stack: list[tuple[str, int]] = []
    pairs = {")": "(", "]": "[", "}": "{", "”": "„“", "“": "„"}
    for m in _DELIMITER.finditer(text):
        ch, k = m.group(0), m.start()
        if ch == "„" or ch in "([{":
            stack.append((ch, k))
        elif ch == "“" and not (stack and stack[-1][0] == "„"):
            stack.append((ch, k))
        elif ch in pairs:
            if stack and stack[-1][0] in pairs[ch]:
                stack.pop()
        elif ch == '"':
            if stack and stack[-1][0] in '"„':
                stack.pop()
            else:
                stack.append((ch, k))
    return bool(stack) and not re.search(r"[.!?]\s", text[stack[-1][1] :])


def _open_entry(line: str) -> bool:
    """A list entry is open if it ends in a joining word or its words after a label are missing."""
    body = re.sub(r"^(?:[-*•+–]|\d{1,3}[.)])\s+", "", line)
    words = body.split()
    if not words:
        return True
    if len(words) > 8:
        return True  # a whole sentence without an end
    return words[-1].lower() in JOINING


#: Words that cannot end a statement (fixed values).
JOINING = frozenset(
    "oraz i w z na do o od przez dla po za ze przy a ale bo ponieważ że gdyż lub albo czy który która które jednak także "
    "and or because but the of to in for by on at with as which that a an "
    "und oder weil aber der die das den dem des von zu mit im am für bis dass sowie".split()
)


def defect(query: str | None, answer: str | None) -> str | None:
    """``empty``, ``copy``, ``refusal``, ``wrong_language``, ``truncated`` or None for a proper answer."""
    if is_empty(answer):
        return "empty"
    plain = _MARKUP.sub(" ", _plain(_visible(answer)))
    words = _WORD.findall(plain.lower())
    asked = _WORD.findall((query or "").lower())
    copied = _copied(asked, words)
    if copied and is_copy(asked, words, copied):
        return "copy"
    own = plain
    echoed = bool(asked) and words[: len(asked)] == asked
    if echoed:  # the query stands in front
        own = _after(plain, len(asked))
    if next(_refusal_automaton().iter(own.lower().replace("’", "'")), None) and is_refusal([s for line in own.split("\n") for s in _SENTENCE_END.split(line)]):
        return "refusal"
    there = language(asked) if asked else None
    if there:
        if echoed or not copied:
            named = set(asked) - COMMON
            text = _QUOTED.sub(" ", own) if '"' in own or "„" in own else own
            spoken = [w for w, low in zip(_WORD.findall(text), _WORD.findall(text.lower())) if low not in named]
        else:
            spoken = [w for w, c in zip(_WORD.findall(plain), copied) if not c]
        if other_than(there, spoken):
            return "wrong_language"
    if is_truncated(answer, query or ""):
        return "truncated"
    return None


_QUOTED = re.compile(r"„[^”“\"]*[”“\"]|\"[^\"]*\"")


def _copied(asked: list[str], words: list[str]) -> list[bool]:
    """Which words of an answer lie in a run copied from the query; empty if there is none.

    The automaton is built only where the answer holds some such run, which a search for each of the query's shortest runs tells.
    """
    least = min(3, len(asked))
    if not least or len(words) < least:
        return []
    line = " " + " ".join(words) + " "
    if not any(" " + " ".join(asked[k : k + least]) + " " in line for k in range(len(asked) - least + 1)):
        return []
    return SuffixAutomaton(asked).copied(words, least)


def _after(text: str, n: int) -> str:
    """The text behind its first n words."""
    for k, m in enumerate(_WORD.finditer(text), 1):
        if k == n:
            return text[m.end() :].lstrip(" ?!.:\n")
    return ""


def defective_answers(answers: DataFrame, queries: DataFrame) -> DataFrame:
    """``(answer_id, query_id, defect)``: one row per defective answer.

    A query delivered more than once is taken once, the earliest non-null text of it; an answer whose
    query is missing or blank is judged on its own.  Null answers are ``empty``.  Repeated answers are
    judged one by one.  An empty table gives no rows.
    """
    asked = queries.where("query is not null").groupBy("query_id").agg(F.min_by("query", F.struct("asked_at", "query")).alias("query"))
    pairs = answers.select("answer_id", "query_id", "answer").join(asked, "query_id", "left").select("answer_id", "query_id", "query", "answer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [defect(q, a) for q, a in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            keep = pa.array([x is not None for x in found])
            kept = batch.filter(keep)
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array([x for x in found if x], pa.string())], ["answer_id", "query_id", "defect"])

    return pairs.mapInArrow(run, "answer_id long, query_id long, defect string")
