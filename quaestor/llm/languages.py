"""Which language a text is in, by votes of stopwords and of letters."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

# --- fixed values: function words (articles, pronouns, prepositions, conjunctions, auxiliaries, question words, common adverbs) ---
STOPWORDS = {
    "pl": "a aby albo ale ani aż bardzo będą będzie bez bo by być był była było były bym chce chcę choć co coś czego czemu czy czyli dla dlaczego dlatego do dokąd dopiero dość gdy gdyż gdzie go i ich ile im inne inny iż ja ją jak jaka jaki "
    "jakie jakich jakim jako je jednak jednakże jego jej jemu jest jestem jeszcze jeśli jeżeli już każda każde każdy kiedy kim kogo komu kto która które którego której który których którym którzy lecz lub ma mają mam mi mieć mimo mną "
    "mnie mogą mogę może można mój moja moje mu musi muszę my na nad nam nami nas nasz nasza nasze nawet nic nich nie niech niej niego nigdy nim niż no o obok od ok on ona one oni ono oraz oto po pod podczas ponad ponieważ poza "
    "powinien powinna proszę przeciw przed przede przez przy raz również są sam się skąd swoje szukam ta tak taka taki takie także tam te tego tej ten też to tobie trzeba tu tutaj twój ty tych tylko tym u w wam we według wiele więc "
    "wszystko wy z za zaś zanim zawsze ze znów że żeby",
    "en": "a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do does doing down during each few for from further had has have having he her here hers "
    "him his how i if in into is it its me more most must my no nor not of off on once only or other our out over own please same she should so some such than that the their them then there these they this those through to too under "
    "until up upon very was we were what when where whether which while who whom whose why will with within without would yes you your",
    "de": "aber alle allem allen als also am an ander andere auch auf aus bei bin bis bist da damit dann das dass dein dem den der des dessen die dies diese diesem diesen dieser dieses doch dort du durch ein eine einem einen einer eines er es "
    "etwas euch für gegen gibt habe haben hat hatte hier hinter ich ihm ihn ihnen ihr ihre ihrem ihren im in ins ist ja jede jedem jeden jeder jedes jetzt kann kein keine können könnte man mein mich mir mit muss müssen nach nein "
    "nicht nichts noch nun nur ob oder ohne sehr sein seine sich sie sind so soll sollte sondern sonst über um und uns unser unter vom von vor während wann war waren warum was weil welche welchem welchen welcher welches wenn wer wem "
    "werde werden wie wieder will wir wird wo wohin wurde wurden zu zum zur zwar zwischen",
    "fr": "à afin ai ainsi alors au aucun aussi autre aux avant avec avez avoir bien car ce ceci cela celle celui ces cet cette ceux chaque chez comme comment dans de depuis des deux doit donc dont du elle elles en encore entre es est et étaient "
    "était été êtes être eux faut fait il ils je jusqu la le les leur leurs lors lui ma mais me même mes moi mon ne ni non nos notre nous on ont ou où par parce pas pendant peu peut plus pour pourquoi qu quand que quel quelle quelles quels qui "
    "quoi sa sans se sera ses si son sont sous sur ta te tes toi ton tous tout toute toutes très tu un une vers voici vos votre vous y",
    "es": "a al algo algunos ante antes aquí así aunque cada como cómo con contra cual cuál cuando cuándo cuánto de del desde donde dónde dos durante e el él ella ellas ellos en entre era es esa ese eso esta está están estas este esto estos fue "
    "ha hacia han hasta hay la las le les lo los más me mi mientras mis muy nada ni no nos nosotros nuestro o os otra otro para pero poco por porque puede pues que qué quien quién se sea según ser si sí sido sin sobre son su sus también tan "
    "tanto te tiene todo todos tu tú un una uno unos usted y ya yo",
    "it": "a ad ai al alla alle allo anche ancora avere c che chi ci ciò coi col come con cosa cui da dagli dai dal dalla dalle degli dei del dell della delle dello di dove due e è ed era gli ha hanno ho i il in io la le lei li lo loro lui ma "
    "me mi mia mio ne negli nei nel nella nelle no noi non nostro o ogni per perché però più può poi qual quale quali quando quanto quella quelle quello questa queste questi questo qui sarà se sei senza si sia sono sopra su sua sue sui sul "
    "sulla suo suoi tra tu tua tuo tutti tutto un una uno vi voi",
    "pt": "a ainda ao aos aquela aquele aqui as às até cada com como da das de dela dele depois do dos e é ela elas ele eles em entre era essa esse esta está estão este eu foi foram há isso isto já lhe mais mas me mesmo meu minha muito na não nas "
    "nem no nos nós num numa o onde os ou para pela pelas pelo pelos pode por porque porquê qual quando quanto que quem são se seja sem ser seu seus só sobre sua suas também te tem têm tu tua um uma você vocês vos",
    "nl": "aan al alles als altijd andere ben bij daar dan dat de der deze die dit doch doen door dus een en er ge geen geweest haar had heb hebben heeft hem het hier hij hoe hun iemand iets ik in is ja je jij kan kon kunnen maar me meer men met mij "
    "mijn moet na naar niet niets nog nu of om omdat onder ons ook op over reeds te tegen toch toen tot u uit uw van veel voor waar waarom wanneer want waren was wat welke werd wezen wie wij wil worden wordt zal ze zelf zich zij zijn zo zonder zou",
    "cs": "a aby ale ani ano až bez bude budou by byl byla bylo byly být co což či do ho i jak jaký jako je jeho její jejich jen jenž ještě ji již jsem jsme jsou k každý kam kde kdo kdy kdyby když ke kolik která které který kteří ku ma má mají "
    "máte me mezi mě mi mít mně mnou můj může my na nad nám námi naše ne nebo nech není než nic o od on ona oni ono pak po pod podle pokud potom pouze pro proč proto protože před přes při s se si sice svůj ta tak také tam tato te tě tedy "
    "ten tento této tím to toho tohoto tom tomto tu ty tyto u už v vám vás ve však více všechno vy z za zda ze že",
    "sv": "alla allt att av blev bli blir de dem den denna deras dess det detta dig din dina du där efter ej eller en er ett från för ha hade han hans har henne hon honom hur här i icke ingen inom inte jag ju kan kunde man med mellan men mig min mina "
    "mot mycket ni nu när någon något några och om oss på samma sedan sig sin sina ska skulle som så till under upp ut utan vad var vara varför varit vem vi vid vilken är",
    "da": "af alle alt anden at blev blive bliver da de dem den denne der deres det dette dig din disse dog du efter eller en end er et for fra få ham han hans har havde hende hun hvad hvem hver hvis hvor hvordan hvornår i ikke ind ja jeg jer kan kunne "
    "man mange med meget men mig min mod må ned nej noget nogle nu når og også om op os over på selv sig skal skulle som sådan thi til ud under var vi vil ville vor være været",
    "hu": "a az abban ahhoz ahogy aki akik akkor alatt ami amely arra át azok azt be csak de e ebben egy egyik el ez ezek ezt és fel hanem hogy hol honnan hova ha igen ill is itt jó kell ki kicsoda le lehet lesz maga meg mert mely mi miért mikor mint "
    "mit most nagyon ne nem nincs ott ő ők össze pedig saját sem semmi són szerint tehát te ti több után utolsó vagy vagyok van vannak volt volna",
}
#: Letters that belong to few of the languages, and to which.
LETTERS = {
    "ą": "pl", "ę": "pl", "ł": "pl", "ń": "pl", "ś": "pl", "ź": "pl", "ż": "pl", "ć": "pl", "ß": "de", "ü": "de hu", "ä": "de sv", "ö": "de sv hu", "å": "sv da", "æ": "da", "ø": "da", "ñ": "es", "ã": "pt", "õ": "pt", "ç": "fr pt",
    "ó": "pl cs es hu", "ê": "fr pt", "è": "fr it", "ù": "fr it", "ì": "it", "ò": "it", "œ": "fr", "î": "fr", "û": "fr", "ř": "cs", "ě": "cs", "ů": "cs", "č": "cs", "š": "cs", "ž": "cs", "ý": "cs", "ő": "hu", "ű": "hu",
}
#: Letter groups that are frequent in few of the languages, and in which.
GROUPS = {
    "rz": "pl", "cz": "pl", "dz": "pl", "gz": "pl", "sz": "pl hu", "uje": "pl cs", "ych": "pl cs", "th": "en", "wh": "en", "gh": "en", "sh": "en", "sch": "de", "tz": "de", "pf": "de", "eau": "fr", "oux": "fr", "eux": "fr", "ll": "es en", "gli": "it",
    "zz": "it", "lh": "pt", "nh": "pt", "ij": "nl", "oe": "nl", "aa": "nl da", "sj": "sv nl da", "gy": "hu", "ly": "hu en", "hv": "da",
}
# --- end of fixed values -----------------------------------------------------------------------------

_OF_WORD: dict[str, tuple[str, ...]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in _words.split():
        _OF_WORD[_w] = (*_OF_WORD.get(_w, ()), _lang)
_OF_LETTER = {letter: tuple(langs.split()) for letter, langs in LETTERS.items()}

#: All function words of all languages.
COMMON = frozenset(_OF_WORD)


@lru_cache(maxsize=1 << 16)
def _lettered(word: str) -> tuple[str, ...]:
    """The languages that some letter of the word belongs to."""
    return tuple({lang for ch in word for lang in _OF_LETTER.get(ch, ())})


def votes(words: list[str]) -> dict[str, float]:
    """A vote for each stopword of a language, less for one that many languages have, and one for each word with letters of its own."""
    out: dict[str, float] = {}
    for langs, n in Counter(map(_OF_WORD.get, words)).items():
        for lang in langs or ():
            out[lang] = out.get(lang, 0.0) + n / (0.85 + 0.15 * len(langs))
    for langs, n in Counter(_lettered(w) for w in words if not w.isascii()).items():
        for lang in langs:
            out[lang] = out.get(lang, 0.0) + n
    return out


def language(words: list[str], margin: float = 0.5) -> str | None:
    """The language with the most votes, if it has about two at least and leads the next one."""
    ranked = sorted(votes(words).items(), key=lambda x: -x[1])
    if not ranked or ranked[0][1] < 1.5 or (len(ranked) > 1 and ranked[0][1] < ranked[1][1] + margin):
        return None
    return ranked[0][0]


_GROUP = re.compile("|".join(sorted(GROUPS, key=len, reverse=True)))
#: Up to so many words letter groups vote too: few stopwords are to be expected.
FEW_WORDS = 40


def other_than(lang: str, words: list[str], margin: float = 0.65) -> bool:
    """The words are clearly in another language, whichever it is.

    In short texts each word has half a vote more for languages with its letter groups; words with a
    capital letter, which may be names from anywhere, have none.
    """
    kept = [w for w in words if len(w) > 1 or w.islower() or w == "I"]  # other capitals alone are marks
    counted = votes(" ".join(kept).lower().split(" "))
    if len(words) <= FEW_WORDS:
        for w in words:
            if w.islower():
                for lang_of in {x for g in _GROUP.findall(w) for x in GROUPS[g].split()}:
                    counted[lang_of] = counted.get(lang_of, 0.0) + 0.5
    own = counted.get(lang, 0.0)
    most = max(counted.values(), default=0.0)
    return most >= 1.5 and most >= own + margin and most >= 1.5 * own
