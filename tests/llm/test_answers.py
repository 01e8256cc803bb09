import random

import pytest

from quaestor.llm.answers import SuffixAutomaton, defect, defective_answers

Q = "Jak złożyć wniosek ABC1234D?"
E = "How do I hand in form ABC1234D?"
D = "Wann ist die Prüfung in „Modale Logik”?"


@pytest.mark.parametrize(
    "query, answer, want",
    [
        (Q, None, "empty"),
        (Q, " \u200b\n", "empty"),
        (Q, "[S1] [S2]", "empty"),
        (Q, "Źródła:\n- [S1]", "empty"),
        (Q, "n/a", "empty"),
        (Q, "```\n```", "empty"),
        (Q, Q, "copy"),
        (Q, f"**Pytanie: {Q.upper()}** [S1]", "copy"),
        (Q, f"{Q}\n{Q}", "copy"),
        (Q, f"{Q} Formularz przyjmuje dr Abc, a termin upływa 3 maja 2020 r.", None),
        (Q, "Przykro mi, ale nie mogę odpowiedzieć na to pytanie. Spróbuj zadać inne pytanie.", "refusal"),
        (E, "As an assistant I must decline to answer. Please ask the student office.", "refusal"),
        (D, "Leider muss ich die Antwort ablehnen.", "refusal"),
        (Q, "Nie mogę potwierdzić sali, jednak pewne jest, że formularz przyjmuje dr Abc.", None),
        (E, "I cannot confirm every detail, still the form is taken by Dr Q.", None),
        (Q, "Przepraszam za zwłokę. Formularz przyjmuje dr Abc.", None),
        (Q, "The form is taken by Dr Q, and the deadline is 3 May 2020.", "wrong_language"),
        (E, "Formularz przyjmuje dr Abc, a termin upływa 3 maja 2020 r.", "wrong_language"),
        (D, "Egzamin odbędzie się w sali 12 i prowadzi go dr Abc.", "wrong_language"),
        (Q, "Formularz przyjmuje dr Abc, a termin upływa", "truncated"),
        (Q, "Formularz przyjmuje dr Abc [S1]. Prakt", "truncated"),
        (Q, "Formularz przyjmuje dr Abc [S", "truncated"),
        (Q, "Formularz przyjmuje dr Abc [S2] („", "truncated"),
        (E, "The form is taken by Dr Q.\n2.", "truncated"),
        (E, "The form is taken by Dr Q because", "truncated"),
        (E, "The form is taken by Dr Q [S1].\n2. [S3]", "truncated"),
        (E, f"Query – {E}", "copy"),
        (E, "Termin to 7/11/2016, godzina 19:45, sala 438, a egzaminuje dr hab. Abc.", "wrong_language"),
        (E, "The form is taken by Dr Q.\n- Room 12, Abc building\n- Tutor: Ms Q", None),
        (E, "The form is taken by Dr Q. More: https://x.example/abc", None),
        (E, "The form is taken by Dr Q. (Abcdef)", None),
        (Q, "Formularz przyjmuje dr Abc. „Qwerty”", None),
        (E, "Room 12B", None),
        (E, "No, it is optional.", None),
        (Q, "dr inż. Abcdef", None),
        (Q, "Tak, 8/04/2017", None),
        (Q, "Formularz przyjmuje dr Abc. 👍", None),
        (E, "There is no information desk on Sundays.", None),
        (E, "Students are not allowed to vote twice in one ballot.", None),
        (D, "Das darf ich jeden Tag von acht bis zwanzig Uhr.", None),
        (E, "As per policy I won't be answering that.", "refusal"),
        (E, "Sorry, we are unable to comment on this matter.", "refusal"),
        (E, "I cannot help with that. The office is in room 5 and opens at nine.", None),
        (Q, "Nie, w sobotę biuro nie podaje numerów.", None),
        (E, "Le bureau est ouvert de neuf heures à midi.", "wrong_language"),
        (E, "Está abierto hasta las cinco de la tarde.", "wrong_language"),
        (E, "Tak, do piątku.", "wrong_language"),
        (D, "Het kantoor is open van negen tot twaalf uur.", "wrong_language"),
        (None, "Formularz przyjmuje dr Abc.", None),
        ("", "Formularz przyjmuje", None),
        (Q, "Ala ma kota. " * 20_000, None),
    ],
)
def test_defects(query, answer, want):
    assert defect(query, answer) == want


def test_suffix_automaton_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        a = rng.choices("abc", k=rng.randint(0, 9))
        b = rng.choices("abcd", k=rng.randint(0, 12))
        least = rng.randint(1, 3)
        parts = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        want = [any(tuple(b[i:j]) in parts for i in range(k + 1) for j in range(k + 1, len(b) + 1) if j - i >= least) for k in range(len(b))]
        assert SuffixAutomaton(a).copied(b, least) == want


def test_tables(spark):
    answers = spark.createDataFrame([(1, 1, None, "x"), (2, 1, "Ok, to jest odpowiedź.", "x"), (3, 9, "", "x"), (4, None, "-", "x"), (2, 1, None, "x")], "answer_id long, query_id long, answer string, defect string")
    queries = spark.createDataFrame([(1, Q, 1), (1, Q, 2), (1, None, 0), (None, Q, 3)], "query_id long, query string, asked_at int")
    got = sorted((tuple(r) for r in defective_answers(answers, queries).collect()), key=str)
    assert got == sorted([(1, 1, "empty"), (2, 1, "empty"), (3, 9, "empty"), (4, None, "empty")], key=str)
    assert defective_answers(answers.limit(0), queries).collect() == []
    assert defective_answers(answers, queries.limit(0)).count() == 4
