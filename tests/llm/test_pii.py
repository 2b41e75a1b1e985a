"""Names, addresses and numbers that the training has never seen."""

import os

import pytest

from sedimenta.llm import pii as P
from sedimenta.llm import pii_train

pytestmark = pytest.mark.skipif(not os.path.isdir(P.VOCABULARIES), reason="no vocabularies")

# Held-out names of many languages; none of their given names is in the list of the module.
NAMES = (
    "Adaeze Nwachukwu", "Sipho Ndlovu", "Chen Haoran", "Folasade Akinola", "Yaw Owusu", "Aoife Brennan", "Zbigniew Nowicki", "Lakshmi Subramanian", "Keiko Watanabe", "Zhao Mingyu", "Soo-jin Kim",
    "Leyla Karimova", "Yousef Haddad", "Itzel Ramirez", "Pekka Lehtonen", "Tane Wihongi", "Ifeanyi Obi", "Nomvula Mthembu", "Oksana Petrenko", "Emre Demir", "Ananya Banerjee", "Iker Mendizabal", "Gunther Hofstadter",
    "Cerys Pritchard", "Eleni Georgiou", "Temitope Lawal", "Harish Reddy", "Taras Bondarenko", "Lungile Khoza", "Xu Jiahui", "Bartosz Zielinski", "Solveig Bakken", "Naoki Fujimoto", "Declan Fitzgerald", "Burcu Kaya", "Annika Löfgren",
)
PLACES = ("{} wrote the patch last week.", "The crash was seen by {}, who is away.", "please ping {} before you merge", "Reviewed-by: {}", "Regards,\n{}\n", "We spoke with {} at noon.", "maintainer: {} (on leave)")
PHRASES = (
    "Pull Request", "Virtual Machine", "Release Candidate", "Hello World", "Quick Start", "Known Limits", "Garden Gate", "Silver Table", "Error Handling", "Open Issues", "Build Server", "Access Control", "Unit Test", "Memory Leak",
    "Remote Desktop", "Signal Handler", "First Steps", "Command Line", "Front Page", "Central Park", "Tuesday Evening", "Data Store",
)


def found(text):
    return [(text[s.start : s.end], s.type) for s in P.find(text, P.trained_weights())]


def test_names_that_no_list_holds():
    assert not {p for n in NAMES for p in n.lower().split()[:1]} & P.GIVEN
    tries = [(n, c.format(n)) for n in NAMES for c in PLACES]
    recall = sum((n, "name") in found(t) for n, t in tries) / len(tries)
    false = sum(any(k == "name" for _, k in found(c.format(p))) for p in PHRASES for c in PLACES) / len(PHRASES) / len(PLACES)
    print(f"recall {recall:.3f}, false {false:.3f}")
    assert recall >= 0.8 and false <= 0.08


def test_lines_of_training_are_found_again():
    import random

    rng = random.Random(99)
    hit = want = got = 0
    for _ in range(600):
        text, spans = pii_train.line(rng)
        mine = {(s.start, s.end, s.type) for s in P.find(text, P.trained_weights())}
        hit, want, got = hit + len(mine & set(spans)), want + len(spans), got + len(mine)
    assert hit / want > 0.85 and hit / got > 0.88


def test_boundaries_are_chosen_within_a_run_of_capitals():
    assert found("On Tuesday Ngozi Eze called; Kwame Mensah-Boateng wasn't in.") == [("Ngozi Eze", "name"), ("Kwame Mensah-Boateng", "name")]
    assert found("Ordered by Kwame Mensah-Boateng, 14 Rosewood Parkway, Springfield") == [("Kwame Mensah-Boateng", "name"), ("14 Rosewood Parkway, Springfield", "address")]


@pytest.mark.parametrize("text", ["2024-01-03 10 INFO start", "2024-01-03 10:22:11 at 2024-01-03 10\n2024-01-04 11 x", "took 3 of 4, see 2.1 and 17.10.2023 12", "f :: Either Wexlil Int", "## Gültige Speicher\nder Speicher ist nicht leer und wird mit der Prüfung gelesen"])
def test_dates_types_and_headings_are_no_items(text):
    assert found(text) == []


def test_items_on_both_sides_of_a_long_log():
    log = "".join(f"2024-05-{1 + i % 28:02} 12:{i % 60:02}:11 epoch 17000{i:05} build {i}.{i % 7}.{i % 9}\n" for i in range(1000))
    got = found(f"mail first.one@example.com\n{log}and second.one@example.com")
    assert [x for x in got if x[1] == "email"] == [("first.one@example.com", "email"), ("second.one@example.com", "email")]


def test_long_runs_of_capitals_stay_linear():
    import time

    began = time.perf_counter()
    P.find("Large Title Case Words " * 4000, P.trained_weights())
    assert time.perf_counter() - began < 12
