import random

from quaestor.llm import page_body, pages, residue
from quaestor.llm.page_body import analyze

SENTENCE = "The council passed a resolution on the curriculum, presented by Ms Abcd in room 12."
PAGE = "\n".join(
    [
        "x.example stores cookies to remember your settings.",
        "I agree   Decline   More",
        "* [News](https://x.example/news/)",
        "Home » News » Class rules",
        "**See also",
        "Placements at Qwerty",
        "",
        "# Class rules Zxcvb",
        "Edited by Dr Q",
        SENTENCE,
        "- [Another page](https://x.example/other)",
        "Lecturer: Ms Nodr",
        "## Dates for Abc",
        "| 7:00 | Logic | 12 |",
        "|---|---|---|",
        SENTENCE + " " + SENTENCE,
        "",
        "Print this page",
        "Guest Abc, 2020-01-01: the X link is broken",
        "See also",
        "Session plan Abc",
        "© 2001 X",
    ]
)


def test_body_of_a_page():
    page = analyze(PAGE)
    assert [x.no for x in page.heading] == [8]
    assert [x.no for x in page.body] == [10, 12, 13, 14, 16]


def built(rng, head, foot):
    """A page with furniture of the given lines, and the numbers of its body lines."""
    words = "alpha beta gamma delta the of and room course term paper student".split()
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(12, 25))).capitalize() + "."
    body = ["# Title " + rng.choice(words)]
    for _ in range(rng.randint(3, 7)):
        body.append(" ".join(sentence() for _ in range(rng.randint(2, 4))))
        if rng.random() < 0.4:
            body += ["- " + sentence() for _ in range(rng.randint(2, 4))]
    menu = [w.title() for w in rng.sample(words, 7)]
    lines = [*head, *menu, *body, *rng.sample(menu, 4), *foot]
    first = len(head) + len(menu) + 1
    return "\n".join(lines), set(range(first, first + len(body)))


#: Furniture in phrases that no list has.
UNKNOWN_HEAD = ["We store small files on your device to measure visits.", "Hold the handset upright for a better view.", "Switch to the dark colours if you read at night."]
UNKNOWN_FOOT = ["Reported by the web team on 3 May.", "Tell your friends about this page.", "A hundred people looked at it this week.", "Come back to the top when you are done."]


def score(rng, n=60):
    true = found = both = 0
    for _ in range(n):
        text, body = built(rng, rng.sample(UNKNOWN_HEAD, 2), rng.sample(UNKNOWN_FOOT, 3))
        page = analyze(text)
        got = {x.no for x in page.heading + page.body}
        true, found, both = true + len(body), found + len(got), both + len(got & body)
    return both / found, both / true


def test_the_distribution_finds_the_body_between_unknown_phrases(monkeypatch):
    precision, recall = score(random.Random(3))
    assert precision >= 0.9 and recall >= 0.9
    whole = page_body.limits
    monkeypatch.setattr(page_body, "limits", lambda weight: whole(weight, 0, 0))
    without, _ = score(random.Random(3))
    assert without < 0.8  # the surge and dive points make the difference


def test_limits():
    assert page_body.limits([]) == ((0, 0), (0, 0))
    assert page_body.limits([0, 0]) == ((2, 0), (2, 0))
    assert page_body.limits([10, 10, 10, 200, 200, 200, 10, 10, 10]) == ((1, 8), (1, 8))
    assert page_body.limits([10] * 6 + [200] * 9 + [10] * 6)[1] == (4, 17)


def test_every_input_has_a_result(spark):
    texts = [None, "", " \r\n\t", PAGE, PAGE, PAGE.replace("\n", "\r\n"), "a" * 100_000, (SENTENCE + "\n") * 5000, "title\n" * 20_000, "\x00<b"]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)] + [(None, PAGE, None, None)], "page_id long, text string, id string, line_no int")
    got = {}
    for i, n, role in pages.body_lines(df).collect():
        got.setdefault(i, []).append((n, role))
    assert sorted(got[3]) == sorted(got[4]) == sorted(got[5]) == sorted(got[None]) == [(8, "heading"), (10, "body"), (12, "body"), (13, "body"), (14, "body"), (16, "body")]
    assert len(got[7]) == 5000 and 0 not in got and 1 not in got and 2 not in got
    texts_out = dict(pages.main_text(df.where("page_id is not null")).collect())
    assert set(texts_out) == set(range(10)) and texts_out[0] == texts_out[1] == "" and texts_out[3].startswith("Class rules Zxcvb\n")
    assert pages.body_lines(df.limit(0)).collect() == pages.residue_pages(df.limit(0)).collect() == []


def page(*body):
    return "\n".join(["I agree   Decline   More", "", "# Class rules Zxcvb", *body, "", "Print this page", "© 2001 X"])


def test_residue(spark):
    cases = {
        "message": ["404 Not Found – /x/", "Nie ma takiej strony: Plan. Sprawdź adres i spróbuj ponownie.", "Bitte aktivieren Sie JavaScript, um Plan zu sehen.", "Your Abc session has timed out, please log in again"],
        "filler": ["Your text goes here (Abc)", "asdf asdf asdf asdf Abc", "Hier steht bald Text zu Abc", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor."],
        "placeholder": ["Room Abc: {{room}}", "Raum: ${raum}", "Sala: [[sala]]", "Date: %exam_date%", "X: @@ROOM@@", "Y: <tutor.email>", "Z: <%= ects %>", "Q: __semestr__", "W: #sala#", "E: {%x%}", "R: [ects]"],
        None: [SENTENCE, "In the Abc class we discuss templates where {{ name }} is replaced by engine X1.", "If the task server answers 404 Not Found, Mr X asks group Y to check the address.", "Write ${x_i}$ for the Abc sample; [NAME] in form F1 is filled in by Dr Q.", "Some **bold** and <b>more</b> [link](x) `{{code}}` text stands here, it does."],
    }
    for kind, bodies in cases.items():
        for body in bodies:
            assert residue.residue_of(page(body)) == kind, body
    assert residue.residue_of(page(SENTENCE * 4, "404 Not Found – /x/")) is None
    assert residue.residue_of(page(SENTENCE * 4, "The exam of {{name}} is on Monday in room twelve of the house.")) == "placeholder"
    assert residue.residue_of(page("```", "{{name}}", "```", SENTENCE)) is None
    for body in ("This content isn't available right now.", "An unexpected error has occurred while loading this content.", "JavaScript must be turned on to view this page.", "Página no encontrada", "Une erreur est survenue."):
        assert residue.residue_of(page(body)) == "message", body
    assert residue.residue_of(page("Dear {first name}, welcome to {faculty}.")) == "placeholder"
    for body in ("The talk is in [room] today. " + SENTENCE * 20, "The method __init__ is called when an object is made.", "The #hashtag# was used by all speakers at the meeting.", SENTENCE * 80 + " The mark {{x}} stands there."):
        assert residue.residue_of(page(body)) is None, body
    df = spark.createDataFrame([(1, page("Room: {{room}}"), 5), (2, page(SENTENCE), 5), (3, None, 5)], "page_id long, text string, kind int")
    assert [tuple(r) for r in pages.residue_pages(df).collect()] == [(1, "placeholder")]


LOREM = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. "
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum."
)


def test_residue_in_one_long_line():
    cases = {
        "filler": [LOREM, "Opis: " + LOREM, "Your text goes here. Click here to edit this paragraph and to replace it with the text of the class. You may add further paragraphs, and you may move the text up and down as you like. The content of this page is shown to all visitors as soon as you save it, so write the text first."],
        "message": [
            "Please enable JavaScript in your browser to view the timetable of the Abc class. The page loads its content by scripts, and without them nothing can be shown here. If your browser blocks scripts, allow them for this address and reload the page. Contact the administrator if this message stays.",
            "Brak dostępu do strony Abc. Nie masz uprawnień, aby zobaczyć tę stronę, albo Twoja sesja wygasła po dłuższym czasie bez żadnej czynności. Zaloguj się ponownie lub zgłoś się do administratora serwisu, podając adres tej strony oraz godzinę, o której pojawił się błąd, i nazwę używanej przeglądarki.",
            "Fatal error: Uncaught Exception: no connection in /srv/abc/plan.php:12 Stack trace: " + " ".join(f"#{k} /srv/abc/lib/part{k}.php({k}): load('plan', 'abc')" for k in range(6)) + " #6 {main} thrown in /srv/abc/plan.php on line 12",
            "java.lang.IllegalStateException: no plan for Abc " + " ".join(f"at org.abc.plan.Step{k}.run(Step{k}.java:{k + 10})" for k in range(8)),
        ],
        None: [
            SENTENCE * 4,
            "Lorem ipsum dolor sit amet is how the customary filler begins. " + SENTENCE + " It is taken from a work by Cicero, and the class reads the passage in the second week. " + SENTENCE,
            "Access denied is what the task server answers to group Y. " + " ".join([SENTENCE] * 4),
            " ".join([SENTENCE] * 3) + " If something went wrong in the Abc sample, write to Mr X, and please do so in time. " + SENTENCE,
        ],
    }
    for kind, bodies in cases.items():
        for body in bodies:
            assert len(body) > residue.MAX_MESSAGE and residue.residue_of(page(body)) == kind, body
    assert residue.residue_of(page(" ".join([SENTENCE] * 8), LOREM)) is None
